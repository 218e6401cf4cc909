import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from auditweave.session import local_session

    session = local_session(4, "6g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
