import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from diffloom.operators.parse import parse_patches  # noqa: E402
from diffloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", memory="6g")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def parse(spark):
    """File table of one or more patch texts; ids are p0, p1, ..."""

    def run(*texts):
        rows = [(f"p{i}", text) for i, text in enumerate(texts)]
        return parse_patches(spark.createDataFrame(rows, "patch_id string, content string"))

    return run
