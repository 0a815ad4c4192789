import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from topicspan.llm.common import short_batches  # noqa: E402


@pytest.fixture(autouse=True)
def _batches(request):
    if "spark" in request.fixturenames:
        short_batches(request.getfixturevalue("spark"))
