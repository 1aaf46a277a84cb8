import pytest
from pyspark.sql import functions as F

from sitrep import schemas
from sitrep.operators import tables
from sitrep.skew import heavy_keys, one_per_key, salted_join
from sitrep.sources.tables import BatchLog, VersionedTable


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_insert_if_absent(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a"), (3, "c")], "k int, v string")
    assert as_set(tables.absent_rows(source, target, ["k"], ["v"])) == {(2, "a"), (3, "c")}
    assert as_set(tables.insert_counts(source, target, ["k"])) == {(2, 2)}
    again = target.unionByName(tables.absent_rows(source, target, ["k"], ["v"]))
    assert tables.absent_rows(source, again, ["k"], ["v"]).count() == 0
    assert as_set(tables.insert_counts(source.limit(0), target, ["k"])) == {(0, 0)}


def test_upsert_is_field_level(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    source = spark.createDataFrame([(2, None, "new"), (3, "c", "new")], "k int, v string, extra string")
    assert as_set(tables.upsert(target, source, ["k"])) == {
        (1, "a", 1, None), (2, None, 2, "new"), (3, "c", None, "new"),
    }


def test_subscriptions(spark):
    subs = spark.createDataFrame(
        [("a@x", ["johor"], 1.0, 1.0), ("b@x", ["kedah"], 1.0, 1.0)], schemas.SUBSCRIBERS
    )
    asks = spark.createDataFrame(
        [("a@x", ["perak"]), ("c@x", ["sabah"]), ("d@x", [])], "email string, locations array<string>"
    )
    got = {r.email: (r.locations, r.createdAt, r.updatedAt) for r in
           tables.upsert_subscriptions(subs, asks, 9.0).collect()}
    assert got == {
        "a@x": (["perak"], 1.0, 9.0), "b@x": (["kedah"], 1.0, 1.0), "c@x": (["sabah"], 9.0, 9.0),
    }
    assert [r.email for r in tables.rejected_subscriptions(asks).collect()] == ["d@x"]
    twice = spark.createDataFrame(
        [("a@x", ["perak"], 2), ("a@x", ["sabah"], 1), (None, ["sabah"], 1)],
        "email string, locations array<string>, at int",
    )
    got = tables.upsert_subscriptions(subs, twice, 9.0, order_by=["at"]).collect()
    assert [r.locations for r in got if r.email == "a@x"] == [["perak"]] and len(got) == 2


def test_rows_without_a_key_are_not_stored(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    none = spark.createDataFrame([], "k string, v int")
    assert as_set(tables.absent_rows(df, none, ["k"], ["v"])) == {("a", 2)}
    assert as_set(tables.keyless_rows(df, ["k"])) == {(None, 1)}


def test_delete(spark):
    target = spark.createDataFrame([("a",), ("b",)], "email string")
    doomed = spark.createDataFrame([("a",), ("z",)], "email string")
    assert as_set(tables.delete_keys(target, doomed, ["email"])) == {("b",)}
    assert as_set(tables.delete_report(target, doomed, ["email"])) == {("a", True), ("z", False)}


def test_bulk_update_and_pending(spark):
    posts = spark.createDataFrame(
        [("1", "old", None), ("2", None, None), ("3", "keep", True)],
        "postId string, keywords string, keywords_generated boolean",
    )
    topics = spark.createDataFrame([("1", "new"), ("2", None)], "post_id string, topic string")
    assert as_set(tables.set_topics(posts, topics).select("postId", "keywords", "keywords_generated")) == {
        ("1", "new", True), ("2", None, True), ("3", "keep", True),
    }
    flagged = posts.where(tables.not_flagged(F.col("keywords_generated")))
    assert {r.postId for r in flagged.collect()} == {"1", "2"}
    waiting = tables.pending(posts, topics, "postId", "post_id")
    assert [r.postId for r in waiting.collect()] == ["3"]
    assert [r.postId for r in tables.oldest_batch(posts, "postId", 2).collect()] == ["1", "2"]


def test_needs_geo(spark):
    ddl = "id int, geo_processed boolean, geo_data struct<state: string, confidence_score: double>"
    rows = [
        (1, None, None), (2, True, ("Unknown State", 0.9)), (3, True, ("johor", 0.2)),
        (4, True, ("johor", 0.3)), (5, False, ("johor", 1.0)), (6, True, None),
    ]
    got = tables.needs_geo(spark.createDataFrame(rows, ddl), 0.3)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 5]


def test_move_raw_geo(spark):
    row = ("1", 1.0, 2.0, "loc", "addr", "city")
    df = spark.createDataFrame(
        [row], "postId string, latitude double, longitude double, location string, address string, city string"
    )
    moved = tables.move_raw_geo(df)
    assert moved.columns == ["postId", "raw_geo"] and tuple(moved.first().raw_geo) == row[1:]


@pytest.mark.parametrize("keep,expected", [("first", {(1, "a", 1), (2, None, 0)}), ("last", {(1, "b", 2), (2, "z", 5)})])
def test_one_per_key(spark, keep, expected):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "z", 5), (2, None, 0)], "k int, v string, n int")
    assert as_set(one_per_key(df, ["k"], ["n"], keep)) == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_salted_join_equals_join(spark, how):
    big = spark.range(2000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, v string")
    salted = salted_join(big, small, ["k"], how, spread=["id"], salts=5)
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(
        map(tuple, big.join(small, ["k"], how).collect()), key=str
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_join_salted_by_counts_equals_join(spark, how):
    keys = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 40)
    big = spark.range(3000).select(keys.alias("k"), "id")
    small = spark.createDataFrame([(7, "a"), (1, "b"), (1, "c"), (None, "d")], "k long, v string")
    salted = salted_join(big, small, ["k"], how, spread=["id"], target=100)
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(
        map(tuple, big.join(small, ["k"], how).collect()), key=str
    )


def test_only_heavy_keys_are_split(spark):
    """Half of all rows have one key: no task holds more than twice the median."""
    big = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 4000).alias("k"), "id")
    small = spark.range(4000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in heavy_keys(counts, ["k"], 100).collect()] == [(0, 200)]
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        joined = salted_join(big, small, ["k"], spread=["id"], target=100).select("k", "id", "v")
        sizes = sorted(r[0] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40_000 and len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), schemas.struct("k int, v string"))
    assert table.read().count() == 0
    table.write(spark.createDataFrame([(1, "a")], "k int, v string"))
    current = table.read()
    table.write(current.unionByName(spark.createDataFrame([(2, "b")], "k int, v string")))
    assert table.versions() == [0, 1] and table.read().count() == 2 and table.read(0).count() == 1
    (tmp_path / "t" / "v000000000002").mkdir()  # an unfinished write is not read
    assert table.versions() == [0, 1] and table.read().count() == 2


def test_batch_log(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "l"), schemas.struct("k int"))
    for batch in (0, 1, 1, 2):
        log.append(spark.createDataFrame([(batch,)], "k int"), batch)
    assert sorted(r.k for r in log.read().collect()) == [0, 1, 2]
    assert sorted(r.k for r in log.read(before=2).collect()) == [0, 1]
    assert [r.k for r in log.read(before=2, after=0).collect()] == [1] and log.last() == 2
    log.compact(through=1, merge=lambda df: df.selectExpr("max(k) AS k"))
    assert sorted(r.k for r in log.read().collect()) == [1, 2]
    assert [r.k for r in log.read(before=1).collect()] == [0]
