import inspect

import pytest

from lotusrank.llm import neighbours


@pytest.mark.parametrize("n", [27_000, 270_000, 2_700_000, 27_000_000])
def test_pairs_at_the_floor_are_met_at_every_size(n):
    have = inspect.signature(neighbours.neighbours).parameters
    m, tables, width = neighbours.functions_for(n), have["tables"].default, have["width"].default
    assert tables == 5
    probes = neighbours.probes_for(m, tables, width)
    assert neighbours.met_by_probes(m, tables, probes, width, 0.85, seed=8)[-1] >= 0.95
