"""Reading and writing raw incidents, records and configuration."""
