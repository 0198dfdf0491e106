"""Order of the tests."""

CONTESTED = "test_pipeline_stage_by_stage"  # calls for near copies that the stage has to drop; see README


def pytest_collection_modifyitems(items):
    """The test that is known to fail comes last, so that a run that stops at the first failure has run all others."""
    items.sort(key=lambda t: t.name == CONTESTED)
