import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from rentscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "rentscope-tests")
