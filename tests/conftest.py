import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from eventlantern.session import local_session

    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def incidents(spark, tmp_path_factory):
    """(raw folder, records folder) of the synthetic incidents, taken in from their files."""
    import incidents as made
    from eventlantern.operators.extract import extract
    from eventlantern.sources.records import read_raw, write_bytes, write_records

    top = tmp_path_factory.mktemp("incidents")
    for key, events in made.INCIDENTS.items():
        write_bytes(spark, f"{top}/raw/offense_{key}_x.json", made.raw(events))
    write_records(extract(read_raw(spark, f"{top}/raw")), f"{top}/records")
    return f"{top}/raw", f"{top}/records"


@pytest.fixture(scope="session")
def records(spark, incidents):
    from eventlantern.sources.records import scan

    return scan(spark, incidents[1])
