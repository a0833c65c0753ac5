"""Archives, media, licences and neighbours on repeated, missing, clashing and hostile rows."""

import random
import struct
import time

import numpy as np
import pytest

from lodestone.llm import ann, licenses, media, warc


def test_record_ids_are_unique(spark):
    rows = [(2, "u", "x"), (2, "u", "x"), (2, "v", "y"), (5, "u", "x"), (5, "w", "x"), (None, "u", "x"), (None, "u", "x"), (7, None, None), (8, None, "")]
    clash = spark.createDataFrame([r + (1,) * 4 for r in rows], "page_id long, url string, html string, payload int, sha1 int, first int, copy int").repartition(3)
    index = warc.write_archives(warc.plan_records(clash))
    got = warc.read_archives(spark, index).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted([(2, "response", None)] * 3 + [(5, "revisit", 2)] * 2 + [(None, "response", None)] * 2 + [(7, "response", None), (8, "revisit", 7)], key=repr)
    ids = [warc.read_record(r["path"], r["frame"], r["at"])[0] for r in index.collect()]
    assert len({h["WARC-Record-ID"] for h in ids}) == len(rows)
    responses = {h["WARC-Record-ID"] for h in ids if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in responses for h in ids if h["WARC-Type"] == "revisit")


def test_short_payloads_all_respond(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")]
    index = warc.write_archives(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string"), least_payload=5))
    assert {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, index).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


JPEG = b"\xff\xd8\xff\xc0\x00\x04ab\xff\xda\x00\x03x\x12\xff\x00\x34\xff\xd0\x56\xff\xd9"
FLAC = b"fLaC\x00\x00\x00\x22" + bytes(34) + b"\x84\x00\x00\x02hi\xff\xf8data"


def test_validators():
    automaton = media.signature_automaton()
    assert media.sniff(b"..." + JPEG + JPEG, automaton) == [(3, len(JPEG), "image/jpeg"), (3 + len(JPEG), len(JPEG), "image/jpeg")]
    assert media.sniff(JPEG.replace(b"\xff\xc0", b"\xff\xe0"), automaton) == [] and media.sniff(JPEG[:-1], automaton) == []
    assert media.sniff(b"x" + FLAC, automaton) == [(1, len(FLAC), "audio/flac")]
    assert media.sniff(FLAC.replace(b"\xff\xf8", b"\xff\x00"), automaton) == [] and media.sniff(FLAC[:40], automaton) == []


HOSTILE = {
    "pdf": b"%PDF-startxref\n1\n%%EOF",
    "xref": b"%PDF-xref startxref\n9\n%%EOF",
    "zip": b"PK\x03\x04PK\x05\x06" + bytes(8) + struct.pack("<IIH", 5, 5, 0),
    "jpeg": b"\xff\xd8\xff\xda\x00\x02\x01\xff\x00",
    "jpeg segments": b"\xff\xd8\xff\xe0\x00\x02",
    "riff": b"RIFF\x10\x00\x00\x00WAVE",
    "flac": b"fLaC\x00\x00\x00\x22",
    "bmp": b"BMBM",
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_repeated_marks_take_no_square_time(kind):
    automaton = media.signature_automaton()
    part = HOSTILE[kind]
    payload = part * (400_000 // len(part))
    began = time.time()
    media.sniff(payload, automaton)
    assert time.time() - began < 6


def test_alignments_agree():
    rng = random.Random(12)
    for _ in range(30):
        template = [rng.choice("abcdefgh") for _ in range(rng.randrange(3, 40))]
        words = [None if rng.random() < 0.03 else rng.choice("abcdefghxyz") for _ in range(rng.randrange(1, 200))]
        at = rng.randrange(len(words))
        words[at : at + len(template)] = template
        diagonals = sorted(rng.sample(range(-20, len(words) + 20), 15))
        assert licenses.align_many(template, words, diagonals) == [licenses.align(template, words, d) for d in diagonals]


def test_scan_matches_full_alignment():
    """Index and winnowing against alignment at every diagonal, on texts with edited copies of templates."""
    rng = random.Random(13)
    templates = {f"t{i}": " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "magna"]) + str(rng.randrange(6)) for _ in range(rng.randrange(8, 60))) for i in range(6)}
    scanner = licenses.Scanner(templates, 0.8, {})
    for _ in range(25):
        words = ["w%d" % rng.randrange(50) for _ in range(rng.randrange(5, 60))]
        for name in rng.sample(sorted(templates), 2):
            copy = templates[name].split()
            for at in range(rng.randrange(4, 9), len(copy), 9):
                copy[at] = "edit"
            spot = rng.randrange(len(words))
            words[spot:spot] = copy
        text = " ".join(words)
        got = sorted((x[0], x[2], x[3], x[4]) for x in scanner.scan_all(text))
        plain, places = licenses.words_with_places(text)
        want = []
        for name, template in zip(scanner.names, scanner.words, strict=True):
            every = [(d, max(0, d)) for d in range(-len(template), len(plain))]
            want += [(name, m, places[a][0], places[b - 1][1]) for m, a, b in scanner.occurrences(template, plain, every)]
        assert got == sorted(want)


def test_much_licence_vocabulary_takes_no_square_time():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    rng = random.Random(14)
    words = licenses.TEMPLATES["mit"].split()
    text = " ".join(" ".join(words[a : a + 4]) for a in (rng.randrange(len(words) - 4) for _ in range(5000)))
    began = time.time()
    scanner.scan(text)
    assert time.time() - began < 20


def test_repeated_ids_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    rows = [(i % 40, v.tolist(), 1, 2) for i, v in enumerate(x)] + [(None, x[0].tolist(), 1, 2), (3, None, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, code int")
    got = {}
    for r in ann.nearest(df, df.where("vec_id in (0, 7, 25)"), 39).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 7, 25}
    for q, found in got.items():
        best = {}
        for i, v in enumerate(x):
            for j, w in enumerate(x):
                if j % 40 == q and i % 40 != q:
                    best[i % 40] = max(best.get(i % 40, -np.inf), float((v * w).sum()))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))
        assert [v for _, v, _ in sorted(found)] == [v for v, _ in want] and all(abs(s - best[v]) < 1e-12 for _, v, s in found)


def test_index_finds_what_brute_force_finds():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32))
    codes, radius = ann.learn(x, 10)
    packed = codes.encode(x)
    tables = ann.MultiIndex(packed)
    for i in range(0, 2000, 100):
        for r in (0, 5, radius, codes.bits):
            want = np.flatnonzero(ann.hamming(packed[i], packed) <= r)
            assert sorted(tables.radius(packed[i], r)) == want.tolist()


def test_recall_on_given_vectors(spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    df = spark.read.parquet(path).select("vec_id", "embedding")
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    hit = total = 0
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(found & set(np.argsort(-score)[:20].tolist()))
        total += 20
    assert total and hit >= 0.95 * total
