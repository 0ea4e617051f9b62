import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kinetable.session import local_session

    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_chunks(monkeypatch):
    """Chunks of eight frames and one broadcast key, so that small data crosses every border."""
    from kinetable.operators import chunks

    monkeypatch.setattr(chunks, "CHUNK", 8)
    monkeypatch.setattr(chunks, "HOT_KEYS", 1)
