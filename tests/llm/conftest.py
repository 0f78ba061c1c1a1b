import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest  # noqa: E402


@pytest.fixture(autouse=True, scope="module")
def tidy(spark):
    yield
    from loomwork.llm.common import drop_scratch

    drop_scratch(spark)
