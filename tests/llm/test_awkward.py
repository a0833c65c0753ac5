"""Repeated rows, missing ids, very long texts, clashing names and empty tables, operator by operator, and the pipeline as a whole."""

import hashlib

import pytest

import corpus_pipeline
from lodestone.llm import licenses, media, tokens
from test_llm import DOCS, awkward, library  # noqa: F401


def test_media_of_awkward_rows(awkward):
    got = sorted(((r["doc_id"], r["n_bytes"]) for r in media.media_features(media.store_texts(awkward)).collect()), key=repr)
    assert got == sorted(((r["doc_id"], len((r["text"] or "").encode())) for r in awkward.collect()), key=repr)


def test_licences_of_awkward_rows(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, mit), (1, mit), (None, mit), (2, None), (2, ""), (3, "filler words here " * 120_000 + mit)]
    df = spark.createDataFrame([r + (5, 6) for r in rows], "doc_id long, text string, coverage int, matched_words int")
    got = licenses.scan_licenses(df, ["doc_id"]).where("license = 'mit'").collect()
    assert sorted((str(r["doc_id"]), r["coverage"]) for r in got) == [("1", 1.0), ("1", 1.0), ("3", 1.0), ("None", 1.0)]
    assert licenses.scan_licenses(df.limit(0), ["doc_id"]).count() == 0


def test_codec_of_awkward_rows(awkward):
    lib = library()
    rows = tokens.encode_decode(awkward, ["doc_id", "n_chars"], digests=True).collect()
    want = [(r["doc_id"], r["n_chars"], lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in awkward.collect()]
    import numpy as np

    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted(((r["doc_id"], r["n_chars"], r["n_tokens"], r["ids_sha256"]) for r in rows), key=repr) == sorted(((i, n, len(ids), digest(ids)) for i, n, ids in want), key=repr)


@pytest.mark.parametrize("some", [False, True])
def test_pipeline_runs(spark, awkward, tmp_path, some):
    rows = awkward.select(*corpus_pipeline.COLUMNS)
    (rows if some else rows.limit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = [r["doc_id"] for r in got.collect()]
    # Of the six texts in a known language three stay, each at most three times.
    assert set(ids) <= {1, None} and len(ids) <= 9 and bool(ids) == some
