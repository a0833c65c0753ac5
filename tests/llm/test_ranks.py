"""Ranks, the mix and the shards on many small sources, rows without ids, skewed sizes and awkward rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, ranks, sharding
from test_llm import water_fill

ROWS = "doc_id long, text string, source string"


@pytest.fixture()
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_are_even(many_ranges, monkeypatch):
    """100,000 sources of one row, one source with a third of the rows, null ids, equal rows: no range gets much more than its part."""
    spark = many_ranges
    single = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    hot = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("hot").alias("source"))
    rows, largest, made = single.unionByName(hot), [], ranks.numbered

    def watched(*args):
        placed = made(*args)
        if args[2] in ("by-source", "by-fraction", "by-size"):
            largest.append(placed.groupBy(F.shiftright("_at", ranks.IN_RANGE)).count().agg(F.max("count")).first()[0])
        return placed

    monkeypatch.setattr(ranks, "numbered", watched)
    got = sharding.interleaved_shards(rows, 8)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [18_750] * 8
    assert got.select("position").distinct().count() == 150_000
    # Shares of 50,000 rows among shards that hold 100,000 sources of one row at places of chance.
    hot_share = [r["count"] for r in got.where("source = 'hot'").groupBy("shard").count().collect()]
    assert max(hot_share) - min(hot_share) <= 300
    assert mixing.mix_sources(rows).count() == 150_000
    assert len(largest) == 3 and max(largest) <= 3 * 150_000 / 16


@pytest.mark.parametrize("rows", [[], [(None, None, None)] * 5, [(1, "a", "x")], [(1, "", "x"), (2, None, None), (2, None, None)], [(5, "a b", None), (5, "a b", None), (5, "c", "z"), (None, "a b", None)]])
def test_awkward_tables(spark, rows):
    clash = "rank row first rows size h total position shard _n s open lam words docs target rate slice".split()
    df = spark.createDataFrame([r + (3,) * len(clash) for r in rows], ROWS + ", " + ", ".join(f"{c} int" for c in clash))
    shards = sharding.interleaved_shards(df, 3).collect()
    assert sorted(r["position"] for r in shards) == list(range(len(rows)))
    assert {r["doc_id"] for r in shards} == {r[0] for r in rows}
    for s in range(3):
        assert sorted(r["slot"] for r in shards if r["shard"] == s) == list(range(sum(r["shard"] == s for r in shards)))
    mixed = mixing.mix_sources(df).collect()
    assert len(mixed) == len(rows) and all(0 <= r["copies"] <= 3 for r in mixed)
    assert sorted(((r["doc_id"], r["source"]) for r in mixed), key=repr) == sorted(((r[0], r[2]) for r in rows), key=repr)


@pytest.mark.parametrize("share", [1e-6, 0.2, 1.5, 2.999])
def test_multipliers_meet_skewed_targets(spark, share):
    rng = random.Random(8)
    sizes = {s: sorted({max(1, int(rng.paretovariate(0.6))) for _ in range(400)}) for s in ("a", "b", None)}
    cells = [(s, x, rng.randrange(1, 50)) for s, xs in sizes.items() for x in xs]
    whole = {s: sum(x * n for t, x, n in cells if t == s) for s in sizes}
    grid = spark.createDataFrame(cells, "source string, size long, docs long")
    sources = spark.createDataFrame([(s, n, n * share) for s, n in whole.items()], "source string, source_size long, target double")
    got = {r["source"]: r for r in mixing.solve(grid, sources, 3).collect()}
    for s, r in got.items():
        words = math.fsum(x * n * math.exp(min(math.log(3), r["lam"] * x / r["scale"])) for t, x, n in cells if t == s)
        assert abs(words - r["target"]) <= max(2 * mixing.RESIDUAL_WORDS, 1e-9 * r["target"])


def test_targets_are_filled(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i:02d}" if i % 5 else None if i == 0 else f"t{i}": rng.choice([0, 1, 5, 100, 10_000, 10**7]) for i in range(n)}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = water_fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
