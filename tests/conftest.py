from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from tilefold.session import build_session

    return build_session(8, partitions=4, memory="6g")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
