import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from strandflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session(cores="4", shuffle_partitions=4, memory="4g")
