"""Keys with a large share, by summaries of fixed size."""

import numpy as np
import pytest

from sitrep.llm import heavy


def drawn(seed, n):
    draw = np.random.default_rng(seed)
    rare = draw.integers(1000, 1 << 40, n).astype(np.uint64)
    common = draw.choice(np.arange(20, dtype=np.uint64), n, p=np.arange(20, 0, -1) / 210)
    return np.where(draw.random(n) < 0.7, rare, common)


def exact(keys, share):
    found, n = np.unique(keys, return_counts=True)
    return set(found[n > 2 * share * len(keys)].tolist()), set(found[n > share * len(keys)].tolist())


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_summaries_in_any_split(parts):
    keys, share = drawn(parts, 60_000), 0.004
    whole = heavy.Summary(250)
    for some in np.array_split(keys, parts):
        part = heavy.Summary(250)
        for batch in np.array_split(some, 3):
            part.add(*np.unique(batch, return_counts=True), len(batch))
            assert len(part.keys) <= 250
        whole.add(part.keys, part.counts, part.total)
    assert whole.total == len(keys) and len(whole.keys) <= 250
    must, may = exact(keys, share)
    found = set(whole.keys[whole.counts > share * whole.total].tolist())
    assert must <= found <= may and must


def test_one_row_leaves_a_task(spark):
    """200 tasks, a text family in all of them: as many rows as tasks, and the same keys as in one task."""
    keys = drawn(5, 40_000)
    rows = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(200)

    def keys_of(b):
        return b["k"].to_numpy().view(np.uint64)

    must, may = exact(keys, 0.004)
    found = heavy.heavy_keys(rows, keys_of, 0.004)
    assert must <= set(found.tolist()) <= may and len(found) <= 250
    assert list(found) == sorted(found)
    assert len(heavy.heavy_keys(rows.where("k < 0"), keys_of, 0.004)) == 0
