"""Citations in answers: extraction, grounding in retrieved spans, and the outcome of the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import basename, stem

#: Patterns of citations, and the sentence that refuses.
STRICT = r"(?U)([\w./\\-]+\.\w+):(\d+)(?:-(\d+))?"
LENIENT = r"(?U)\b([\w./\\-]+)\[(\d+)(?:-(\d+))?\]"
REFUSAL = "I don't have enough information in the retrieved context to answer this confidently."


def extract(answer: Column, pattern: str = STRICT) -> Column:
    """array<struct<path, first, last>> of an answer's citations; last is first where it isn't given."""
    part = lambda i: F.regexp_extract_all(answer, F.lit(pattern), i)
    number = lambda s: F.expr(f"try_cast({s} as bigint)")  # noqa: E731, F841
    found = F.arrays_zip(part(1).alias("path"), part(2).alias("a"), part(3).alias("b"))
    return F.coalesce(F.transform(found, lambda x: F.struct(x["path"].alias("path"), x["a"].try_cast("long").alias("first"), F.coalesce(F.nullif(x["b"], F.lit("")).try_cast("long"), x["a"].try_cast("long")).alias("last"))), F.array().cast("array<struct<path:string,first:bigint,last:bigint>>"))


def segments(answer: Column, pattern: str = STRICT) -> Column:
    """array<struct<cited, text>>: an answer as its citations and the texts between them, in order; blank-free joining gives it back."""
    between = F.split(answer, pattern, -1)
    cited = F.regexp_extract_all(answer, F.lit(pattern), 0)
    both = F.flatten(F.transform(between, lambda t, i: F.array(F.struct(F.lit(False).alias("cited"), t.alias("text")), F.struct(F.lit(True).alias("cited"), F.get(cited, i).alias("text")))))
    return F.filter(both, lambda x: x["text"].isNotNull() & (x["text"] != ""))


def validate(answers: DataFrame, answer: str = "answer", chunks: str = "chunks") -> DataFrame:
    """Adds step and valid. ``chunks`` is array<struct<file_path, start_line, end_line>>.

    1 no chunks: invalid. 3 strict citations: each path is retrieved, or has a
    retrieved file's stem, or is the tail of a retrieved path with blanks that
    the answer cites, and its lines overlap a span of that path, else of its
    name, else of its stem; a key without spans asks for no lines. 4 lenient
    citations: paths only. 5 a cited path with blanks: valid. 6: invalid.
    """
    out = answers.withColumns({"_strict": extract(F.col(answer), STRICT), "_lenient": extract(F.col(answer), LENIENT), "_c": F.coalesce(F.col(chunks), F.array().cast("array<struct<file_path:string,start_line:int,end_line:int>>"))})
    quoted = lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E:\d+"))
    out = out.withColumn("_paths", F.transform("_c", lambda c: c["file_path"]))
    out = out.withColumn("_stems", F.transform("_paths", lambda p: stem(basename(p))))
    out = out.withColumn("_spaced", F.filter("_paths", lambda p: p.contains(" ") & F.regexp(F.col(answer), quoted(p))))
    out = out.withColumn("_tails", F.transform("_spaced", lambda p: F.substring_index(p, " ", -1)))
    grounded = lambda x: F.array_contains(F.col("_paths"), x["path"]) | F.array_contains(F.col("_stems"), stem(basename(x["path"]))) | F.array_contains(F.col("_tails"), x["path"])

    def spans(key):
        return F.filter("_c", lambda c: (c["file_path"] == key) | (basename(c["file_path"]) == key) | (stem(basename(c["file_path"])) == key))

    def lines_fit(x):
        first, second, third = spans(x["path"]), spans(basename(x["path"])), spans(stem(basename(x["path"])))
        chosen = F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(third)
        return (F.size(chosen) == 0) | F.exists(chosen, lambda c: (x["first"] <= c["end_line"]) & (x["last"] >= c["start_line"]))

    strict, lenient = F.size("_strict") > 0, F.size("_lenient") > 0
    step = F.when(F.size("_c") == 0, 1).when(strict, 3).when(lenient, 4).when(F.size("_spaced") > 0, 5).otherwise(6)
    valid = F.when(F.size("_c") == 0, False).when(strict, F.forall("_strict", lambda x: grounded(x) & lines_fit(x))).when(lenient, F.forall("_lenient", grounded)).otherwise(F.size("_spaced") > 0)
    return out.withColumns({"step": step, "valid": valid}).drop("_strict", "_lenient", "_c", "_paths", "_stems", "_spaced", "_tails")


def refuses(answer: Column) -> Column:
    return F.coalesce(F.lower(answer).contains(REFUSAL.lower()), F.lit(False))


def refusal_rate(answers: DataFrame, by: list[str], refused: str = "refused") -> DataFrame:
    """Answers, refusals and their share."""
    return answers.groupBy(*by).agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col(refused)).alias("refusals"), F.round(F.count_if(F.col(refused)) / F.count(F.lit(1)), 6).alias("rate"))


def outcome(has_chunks: Column, valid1: Column, refusal1: Column, valid2: Column, refusal2: Column) -> Column:
    """What the gate returns: no context, first answer, second answer, or a refusal after one retry."""
    return F.when(~has_chunks, "refused_no_context").when(refusal1, "refused").when(valid1, "answered").when(refusal2, "refused_retry").when(valid2, "answered_retry").otherwise("refused_closed")
