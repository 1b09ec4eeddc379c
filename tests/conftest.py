import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomwork.session import session

    found = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    found.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return found
