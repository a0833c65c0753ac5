"""Mixing sources to target weights by entropy balancing.

Rates minimise their Kullback-Leibler divergence from one copy of each
document, subject to one token constraint per source and to a most number of
copies. The convex dual has one multiplier per source; a document of size x
gets the exponentially tilted rate ``min(most, exp(multiplier * x / scale))``.
A rate depends on source and size only, so the iterations run over the written
(source, size) counts: each is one small job, a sum per source, and they stop at
a stated residual. Rates are rounded into copies by systematic rounding along
the sizes, which keeps a source's words within one largest document of its target.

DataFrame functions only; of the data, no row but a maximum or a sum is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestone.llm.ranks import ranked, with_row
from lodestone.llm.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 20
#: A source's words under its rates differ from its target by this many, or this share of it, at most.
RESIDUAL_WORDS, RESIDUAL_SHARE = 0.25, 1e-11
MOST_ROUNDS = 400


def word_count(text: Column) -> Column:
    """Words of ASCII white-space separated text, by counting their last characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]|\z)")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: int = 3, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, ..., ``weights``, repeating.
    They share the sum of all sizes by weight; none gets more than ``most``
    times its size, and the excess is shared again by weight until none is
    above. Every round is a sum over all sources, in whole numbers.
    """
    own = ranked(materialise(sizes, "sources"), [F.col("source").asc_nulls_last()], "sources-by-name")
    own = materialise(own.withColumn("weight", (F.col("rank") - 1) % weights + 1).withColumn("cap", F.col("source_size") * most).drop("rank"), "weights")
    level, filled = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > F.col("cap")
        sums = own.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("caps"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weights"), F.count_if(over).alias("filled")).first()
        if sums["all"] is None or sums["filled"] == filled:
            break
        filled = sums["filled"]
        if sums["weights"]:
            level = (sums["all"] - sums["caps"]) / sums["weights"]
    target = F.lit(0.0) if level is None else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return own.select("source", "source_size", target.alias("target"))


def solve(grid: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, source_size, target, scale, lam): the multipliers that bring each source's words to its target.

    ``grid`` holds (source, size, docs), ``sources`` (source, source_size,
    target). Newton's steps solve log(words) = log(target), the stationarity of
    the dual, inside a bracket that halves where a step leaves it. Sources
    without a target or at their most need no multiplier: theirs is null.
    """
    docs = grid.groupBy("source").agg(F.sum("docs").alias("docs"))
    state = sources.join(docs.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs")).alias("scale"))
    ratio = F.col("target") / F.col("source_size")
    state = state.withColumn("open", (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most))
    state = state.withColumns({"lam": F.when(F.col("open"), 0.0), "low": F.when(F.col("open"), F.least(F.lit(0.0), F.log(ratio) * F.col("scale")) - 1.0), "high": F.when(F.col("open"), F.log(F.lit(float(most))) * F.col("scale") + 1.0)})
    state = materialise(state, "multipliers")
    own = ["source", "source_size", "target", "scale", "open", "lam", "low", "high"]
    x, word_sum = F.col("size") / F.col("scale"), F.col("docs") * F.col("size")
    rate = F.exp(F.col("lam") * x)
    cells = grid.where("size > 0").select(F.col("source").alias("s"), "size", "docs")
    for _ in range(MOST_ROUNDS):
        # The sums of a source's cells are made before they meet its row again: no hot source is in one task.
        parts = cells.join(state.where("open").select("source", "scale", "lam"), F.col("s").eqNullSafe(F.col("source"))).groupBy("s").agg(
            F.sum(word_sum * F.least(F.lit(float(most)), rate)).alias("words"), F.sum(F.when(rate < most, word_sum * x * rate).otherwise(0.0)).alias("slope")
        )
        met = state.join(parts, F.col("source").eqNullSafe(F.col("s")), "left")
        gap = F.col("words") - F.col("target")
        met = met.withColumn("open", F.coalesce(F.abs(gap) > F.greatest(F.lit(RESIDUAL_WORDS), F.col("target") * RESIDUAL_SHARE), F.lit(False)) & (F.col("high") - F.col("low") > F.lit(1e-14) * F.greatest(F.abs("lam"), F.lit(1e-3))))
        met = met.withColumns({"low": F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))})
        step = F.when(F.col("slope") > 0, F.col("lam") - (F.log("words") - F.log("target")) * F.col("words") / F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        met = met.withColumn("lam", F.when(~F.col("open"), F.col("lam")).when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle))
        seen = Observation()
        state = materialise(met.select(*own).observe(seen, F.max("open").alias("open")), "multipliers")
        if not seen.get["open"]:
            return state.drop("open", "low", "high")
    raise ArithmeticError("the multipliers don't settle")


def mix_sources(docs: DataFrame, weights: int = 3, most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken, text_hash) of every document.

    ``taken = copies * size`` and copies is at most ``most``. A document without
    words has size 0, one copy and takes 0 words; a source without words has
    target 0. Null sources form one source; null ids are kept and repeated rows are
    separate documents. Which of equally sized documents of a source get the
    extra copy is decided by a hash of seed and id, then of the text, so that
    reruns agree; of rows equal in both any may get it. Other columns are
    ignored. An empty table gives none.
    """
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    base = with_row(base.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"))), "sizes")
    # One order serves all: documents of equal source and size follow each other, shuffled.
    rows = ranked(base, [F.col(c).asc() for c in ("source", "size", "h", "doc_id", "text_hash", "row")], "by-size")
    grid = materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"), F.min("rank").alias("first")), "grid")
    sources = targets(grid.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size")), weights, most)
    solved = solve(grid, sources, most)
    grid = grid.join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    tilted = F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))
    grid = grid.withColumn("rate", F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(most)).otherwise(tilted))

    # Systematic rounding in fixed point: sums are exact, so their order doesn't matter.
    whole = F.floor("rate")
    grid = grid.withColumn("base", F.when(F.col("size") == 0, 1).otherwise(F.least(whole, F.lit(most)))).withColumn("part", F.when((F.col("size") == 0) | (F.col("rate") >= most), 0).otherwise(F.floor((F.col("rate") - whole) * UNIT)) * F.col("docs"))
    upto = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("run", F.sum("part").over(upto))
    half = UNIT // 2
    grid = grid.withColumn("extra", F.expr(f"(run + {half}) div {UNIT} - (run - part + {half}) div {UNIT}"))
    grid = materialise(grid.select("source", "size", "first", "source_size", "target", "rate", "base", "extra"), "rates")

    joined = rows.alias("r").join(grid.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")) & (F.col("r.size") == F.col("g.size")))
    copies = (F.col("base") + F.when(F.col("rank") - F.col("first") < F.col("extra"), 1).otherwise(0)).cast("int")
    return joined.select("r.doc_id", "r.source", "r.size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("r.size")).cast("long").alias("taken"), "r.text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, repeated as often as it has copies.

    Rows find their copies by id, source and text, nulls included. Rows that
    agree in all three share the sum of their copies as evenly as it goes; which
    of them get what is left over is arbitrary.
    """
    mix = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    found = mix.groupBy("doc_id", "source", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    found = found.withColumn("key", F.xxhash64("doc_id", "source", "text_hash"))

    # The row travels as one struct, so that its columns may have any names.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("from"), F.xxhash64(F.col(text_col)).alias("hash")).withColumn("own", F.xxhash64("id", "from", "hash"))
    same = (F.col("own") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("hash") == F.col("text_hash"))
    # The join deals rows by own: numbering those of one key needs no other exchange.
    place = F.row_number().over(Window.partitionBy("own", "id", "from", "hash").orderBy("own"))
    share = F.expr("copies div rows") + F.when(place <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    shared = rows.join(found, same).select("row", share.cast("int").alias("copies")).where("copies > 0")
    return shared.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
