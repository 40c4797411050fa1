"""The tile comparison of a hot block value is dealt into groups of bounded size and gives few pairs."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.brute import components
from tideframe.llm import jaccard_join as J


def test_lots_of_a_hot_key(spark):
    n = 20000
    left = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("doc_id"), F.col("id").alias("comp"), F.lit(-(-n // J.TILE)).cast("int").alias("tiles"))
    lots = J._lots(left)
    sizes = [r["count"] for r in lots.groupBy("lot").count().collect()]
    assert sum(sizes) == n * -(-n // J.TILE) and max(sizes) <= 4 * J.LOT
    assert lots.groupBy("i", "j").agg(F.count_distinct("lot").alias("c")).where("c > 1").isEmpty()


def test_hot_block_value(spark, monkeypatch):
    """Families that share their one-shingle blocks, over many small tiles and lots, against brute force."""
    monkeypatch.setattr(J, "TILE", 4)
    monkeypatch.setattr(J, "LOT", 8)
    common = [f"c{k}" for k in range(12)]
    rows = []
    for family in range(12):
        own = [f"f{family}w{k}" for k in range(30)]
        for copy in range(3):
            rows.append((len(rows), " ".join(common + own + [f"x{family}y{copy}"] * (copy > 0))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs, 4, 85).collect()}
    assert out == components(rows, 4, 85) and len({c for _, c in out.values()}) == 12


def test_crowded_block_value(spark, monkeypatch):
    """The same families, a passage in all of them, with every mixed block value taken as crowded and cut by its shingles."""
    monkeypatch.setattr(J, "TILE", 1)
    monkeypatch.setattr(J, "LOT", 8)
    monkeypatch.setattr(J, "CROWD", 3)
    monkeypatch.setattr(J, "COMMON", 0.3)
    cut, sizes = J._by_rare_shingles, []

    def counted(*args):
        out = cut(*args)
        sizes.append((args[1].count(), J._mixed(out).count()))
        return out

    monkeypatch.setattr(J, "_by_rare_shingles", counted)
    common = [f"c{k}" for k in range(14)]
    rows = []
    for family in range(40):
        own = [f"f{family}w{k}" for k in range(12)]
        for copy in range(3):
            rows.append((len(rows), " ".join(common + own + [f"x{family}y{copy}"] * (copy > 0))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs, 4, 85).collect()}
    assert out == components(rows, 4, 85) and len({c for _, c in out.values()}) == 40
    assert len(sizes) == 1 and sizes[0][0] > 0


def test_forest_of_a_tile():
    """Documents of one block value that are all alike but in no component yet give a pair each, not all pairs."""
    for n in (200, 400):
        ids, size = np.arange(n), np.full(n, 100)
        bits, every = np.zeros((n, 8), np.uint8), np.arange(n)
        assert len(J._within(ids, ids, size, bits, every, every, True, 85, True)) == n - 1
        two = np.where(ids < n // 2, 0, n // 2)
        assert len(J._within(ids, two, size, bits, every, every, True, 85, True)) == 1


def test_owners_of_hot_keys(spark):
    """A key that holds most rows is split; owners are those of a plain grouping."""
    from tideframe.llm.shared import HOT, with_owner

    n = 6 * HOT
    rows = spark.range(n).select(F.when(F.col("id") % 3 < 2, -1).otherwise(F.floor(F.col("id") / 12)).cast("long").alias("k"), F.col("id").alias("doc_id"))
    out = with_owner(rows, ["k"], "doc_id")
    expected = {}
    for d in range(n):
        expected.setdefault(-1 if d % 3 < 2 else d // 12, []).append(d)
    assert sorted((r["k"], r["doc_id"], r["owner"]) for r in out.collect()) == sorted((k, d, v[0]) for k, v in expected.items() if len(v) > 1 for d in v)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < n
