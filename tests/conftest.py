import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from plotmerge.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    return local_session(**{"spark.checkpoint.dir": str(shared)})
