"""Operators over records and search documents."""
