"""The log looked up by key: same rows as a plain log, level reads, removed parts."""

import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from sitrep import schemas
from sitrep.sources.keyed import KeyedLog

ROWS = schemas.struct("k string, v bigint")


def keyed(spark, path, **options):
    options = {"fan": 4, **options}
    return KeyedLog(spark, str(path), ROWS, ["k"], **options)


def rows(spark, values):
    return spark.createDataFrame(values, ROWS).coalesce(1)


def bytes_of(df):
    """Bytes of the files that rows come from."""
    files = df.select(F.input_file_name().alias("f")).distinct().collect()
    return sum(os.path.getsize(urlparse(r.f).path) for r in files)


@pytest.mark.parametrize("merge", [False, True])
def test_same_rows_as_a_plain_log(spark, tmp_path, merge):
    draw = random.Random(1)
    last = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
    log = keyed(spark, tmp_path, fan=2, **({"merge": last} if merge else {}))
    told = []
    for batch in range(12):
        if batch in (5, 6):
            continue  # numbers may be left out
        log.settle(batch)
        own = [(f"k{draw.randint(0, 9)}", draw.randint(0, 999)) for _ in range(5)]
        log.append(rows(spark, [("lost", 0)]), batch)
        log.append(rows(spark, own), batch)  # a batch that is run again replaces itself
        want = dict_of(told) if merge else sorted(told)
        wanted = [("k3", 0), ("k4", 0), ("none", 0)]
        near = [tuple(r) for r in log.near(rows(spark, wanted), batch).collect() if r.k in ("k3", "k4")]
        hit = [r for r in told if r[0] in ("k3", "k4")]
        assert (dict_of(near) if merge else sorted(near)) == (dict_of(hit) if merge else sorted(hit))
        told += own
    found = [tuple(r) for r in log.read().collect()]
    assert (dict_of(found) if merge else sorted(found)) == (dict_of(told) if merge else sorted(told))
    assert log.last() == 11 and keyed(spark, tmp_path / "new").read().count() == 0
    assert not (tmp_path / "batch=000000000000").exists() and len(list(tmp_path.iterdir())) < 14


def dict_of(pairs):
    out = {}
    for k, v in pairs:
        out[k] = max(v, out.get(k, v))
    return out


def test_bytes_read_stay_level(spark, tmp_path):
    """A history of ten times as many batches: a batch's look-up reads about as much as before."""
    log = keyed(spark, tmp_path)
    draw = random.Random(2)
    read = {}
    for batch in range(81):
        log.settle(batch)
        if batch in (8, 80):
            read[batch] = bytes_of(log.near(rows(spark, [("k7", 0)]), batch))
        if batch < 80:
            own = [(f"k{draw.randint(0, 10**9)}", draw.randint(0, 10**15)) for _ in range(400)]
            log.append(rows(spark, own), batch)
    assert 0 < read[80] < 3 * read[8]
    whole = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert read[80] < whole / 10
