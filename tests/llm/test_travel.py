"""The corpus queries on executors that have no copy of the package."""

import pytest

from tests.test_travel import run_elsewhere


@pytest.mark.parametrize("prefix", ["op", "pipeline"])
def test_queries_elsewhere(tmp_path, prefix):
    run_elsewhere(tmp_path, prefix)
