import os
import sys

os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH")) if x)
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from recipeframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
