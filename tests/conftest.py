import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from corrweave.session import get_spark

    session = get_spark("tests", cores=4, shuffle_partitions=4)
    yield session
    session.stop()


DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def sf_small():
    path = DATA / "sf0.001"
    if not path.is_dir():
        pytest.skip("the driver's tables are not here")
    return str(path)
