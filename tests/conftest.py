"""Fixtures only: names to import live in ``market_fixtures``."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from marketframe.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="marketframe-tests")
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
