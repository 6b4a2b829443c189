import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from asofkit.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", spark__sql__shuffle__partitions="3")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def at():
    return lambda text: dt.datetime.fromisoformat(text)


@pytest.fixture
def rows():
    """Rows of a frame as dictionaries in a stable order."""
    def collect(frame, *keys):
        out = [r.asDict(recursive=True) for r in frame.collect()]
        return sorted(out, key=lambda r: tuple(str(r[k]) for k in keys or sorted(r)))
    return collect
