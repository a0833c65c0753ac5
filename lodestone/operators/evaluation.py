"""Retrieval quality: judged cases, metric means against thresholds, recall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdicts(scores: DataFrame) -> DataFrame:
    """(metric, n, mean, verdict) from (metric, score, threshold); metrics without scores are n/a."""
    out = scores.groupBy("metric").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.max("threshold").alias("threshold"))
    return out.select("metric", "n", "mean", F.when(F.col("n") == 0, "n/a").when(F.col("mean") >= F.col("threshold"), "PASS").otherwise("FAIL").alias("verdict"))


def recall(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, relevant, found): how many relevant documents are among the first k."""
    hits = truth.join(ranking.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.count("hit").alias("found"))


def judged(cases: DataFrame, make: Callable, metrics: dict[str, float]) -> DataFrame:
    """(metric, score, threshold) of every case (question, answer, contexts) by a judge that is made once in each task; a failed call gives a null score."""
    import pandas as pd

    def run(batches):
        judge = make()
        for batch in batches:
            rows = []
            for question, answer, contexts in zip(batch["question"], batch["answer"], batch["contexts"], strict=True):
                for metric, threshold in metrics.items():
                    try:
                        score = float(judge.score(metric, question, answer, list(contexts)))
                    except Exception:  # a provider's failure must not lose the other scores
                        score = None
                    rows.append((metric, score, threshold))
            yield pd.DataFrame(rows, columns=["metric", "score", "threshold"])

    return cases.select("question", "answer", "contexts").mapInPandas(run, "metric string, score double, threshold double")
