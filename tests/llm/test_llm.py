"""Corpus operators against brute force, round trips and awkward rows."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, langid, licenses, media, mixing, ngram_join, sharding, sstable, tokens, warc
from lodestone.llm.wordbpe import Encoder, Lexicon, WordBPE, build_lexicon, default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near old stone walls under pale light".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows, base = [], []
    for i in range(60):
        base.append([rng.choice(WORDS) + rng.choice(["", "s", "x"]) for _ in range(rng.randrange(1, 120))])
    for i in range(240):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(9)
        rows.append((i, " ".join(words), "en", f"s{i % 3}" if i % 7 else None, 1))
    rows += [(900, None, "en", "s0", 1), (901, "", None, "s1", 1), (902, " \n\t", "en", None, 1), (903, "12 34", "en", "s0", 1), (904, "word " * 30_000, "en", "s2", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (3, 1, 1)])
def test_jaccard_components(docs, n, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_components(docs, n, num, den).collect()}
    assert got == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], n, num, den)


def test_jaccard_large_bucket(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 1500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 7, 10).collect()}
    assert got == brute_components(rows, 3, 7, 10)


def test_jaccard_awkward_rows(spark, empty):
    assert ngram_join.near_duplicate_components(empty).count() == 0
    rows = [(1, "a b c d e f", 9), (1, "a b c d e f", 9), (None, "a b c d e f", 9), (2, None, 9), (2, "x y", 9)]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect())
    assert got == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (2, 1, 2)]


def test_partenum_loses_no_pair():
    rng = np.random.default_rng(1)
    rule = ngram_join.PartEnum(85, 100)
    least, bound, families = rule.bands()
    for _ in range(300):
        n = int(rng.integers(1, 400 if rng.random() < 0.5 else 50))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop = int(n * 0.15 * rng.random())
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 12) + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not len(b) or not rule.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        made = []
        for h in (a, b):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(ngram_join.mix(h + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
            band = int(np.searchsorted(least, len(h), "right")) - 1
            made.append({int(s) for j in (band, band + 1) for s in ngram_join.signatures(h, sums, j, bound[j], families[j])})
            own = set()
            for j, lowest in ((band, 1), (band + 1, int(least[band + 1]))):
                k = rule.own_bound(len(h), lowest, int(least[j]) * 100 // 85)
                if k >= 0:
                    k = min(k, bound[j])
                    found, kind = ngram_join.signatures(h, sums, j, k, families[j]), families[j]
                    assert len(found) == kind.n1 * len(kind.subsets) - kind.agree(k) + 1
                    assert kind.n2 == 1 and len(found) == k + 1 or kind.n2 == 3
                    own |= {int(s) for s in found}
            made.append(own)
        assert made[0] & made[2] and made[1] & made[3]


def test_media_round_trip(docs, empty):
    got = {r["doc_id"]: r for r in media.media_features(media.store_texts(docs)).collect()}
    for r in docs.collect():
        text = (r["text"] or "").encode()
        payload = text + b"\xff" * (-len(text) % 576 or (576 if not text else 0))
        one = got[r["doc_id"]]
        assert (one["n_bytes"], one["payload_bytes"], one["payload_sha256"], one["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert one["media_sha256"] == hashlib.sha256(media.as_wave(text)).hexdigest() and one["detected"] == "audio/wav"
    assert media.media_features(media.store_texts(empty)).count() == 0


def test_sniffing(spark):
    import struct

    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")
    rows = [(1, png, "image/jpeg"), (2, b"xx" + png + b"BM tail GIF89a", "x/y"), (3, png[:-1], None), (4, None, "a/b"), (5, media.as_wave(b"hi"), "audio/wav")]
    got = {r["id"]: r for r in media.sniff_media(spark.createDataFrame(rows, "id int, p binary, d string"), "p", "d", ["id"]).collect()}
    assert got[1]["detected"] == "image/png" and got[1]["corrected"]
    assert got[2]["detected"] is None and [tuple(x) for x in got[2]["embedded"]] == [(2, len(png), "image/png")]
    assert got[3]["detected"] is None and got[4]["detected"] is None and not got[5]["corrected"]


def test_language_held_out(spark, empty):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    rows = spark.read.parquet(path).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    got = langid.predict(rows, langid.train(rows.where("not held")), ["doc_id", "lang", "held"]).where("held and lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert langid.predict(rows.limit(2), langid.train(empty), ["doc_id"]).first()["lang_pred"] == "und"


def test_language_awkward_rows(docs):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.train(docs), ["doc_id"]).collect()}
    assert [got[i] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "und", "en"] and len(got) == 245


def naive_model(rows, bits, smoothing=0.5):
    """Counts and log-probabilities by loops over characters."""
    counts, docs_of = {}, {}
    for text, lang in rows:
        table = counts.setdefault(lang, [0] * (1 << bits))
        for f in naive_features(text, bits):
            table[f] += 1
        docs_of[lang] = docs_of.get(lang, 0) + 1
    langs = sorted(counts)
    logs = [[math.log((c + smoothing) / (sum(counts[x]) + smoothing * (1 << bits))) for c in counts[x]] for x in langs]
    return langs, logs, [math.log(docs_of[x] / sum(docs_of.values())) for x in langs]


def naive_features(text, bits):
    points = [ord(c) for c in f" {text.lower()} "]
    for order in langid.ORDERS:
        for at in range(len(points) - order + 1):
            h = order * 0x27D4EB2F & 0xFFFFFFFF
            for i in range(order):
                h ^= points[at + i] * langid._PRIMES[i] & 0xFFFFFFFF
                h = (h << 13 | h >> 19) & 0xFFFFFFFF
                h = h * 5 & 0xFFFFFFFF
            yield (h * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - bits


def test_language_matches_loops(spark, monkeypatch):
    rng = random.Random(6)
    letters = {"aa": "abcde éü", "bb": "defgh ß", "cc": "xyzab '", "dd": "日本ab"}
    rows = [("".join(rng.choices(letters[lang], k=rng.randrange(1, 60))), lang) for lang in rng.choices(sorted(letters), k=120)]
    rows += [("long " * 300, "aa"), ("a", "bb"), ("123", "cc"), ("", "dd")]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)] + [(900, None, "aa"), (901, "ab", None)], "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(langid, "POINTS", 100)
    model = langid.train(df, bits=9)
    taught = [(t, lang) for t, lang in rows if any(c.isalpha() for c in t)]
    langs, logs, priors = naive_model(taught, 9)
    assert model[0] == langs and np.allclose(model[1].T, logs, rtol=0, atol=1e-12) and np.allclose(model[2], priors)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model, ["doc_id"]).collect()}
    for i, (text, _) in enumerate(rows):
        if not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        total = [priors[j] + sum(logs[j][f] for f in naive_features(text, 9)) for j in range(len(langs))]
        best = max(range(len(langs)), key=lambda j: total[j])
        assert got[i][0] == langs[best] and abs(got[i][1] - 1 / sum(math.exp(t - total[best]) for t in total)) < 1e-9
    assert got[900] == ("und", 0.0) and got[901][0] in langs
    texts = [t for t, _ in rows if t]
    alone = [langid.decide([t], model) for t in texts]
    together, sure = langid.decide(texts, model)
    assert together == [a[0][0] for a in alone] and np.allclose(sure, [a[1][0] for a in alone], rtol=0, atol=1e-12)


def test_language_edges(spark, empty, monkeypatch):
    assert langid.predict(empty, langid.train(empty), ["doc_id"]).count() == 0
    monkeypatch.setattr(langid, "MATRIX", 1 << 12)
    rows = spark.createDataFrame([(i, f"text of number {chr(97 + i)}", f"l{i:02d}") for i in range(12)], "doc_id long, text string, lang string")
    langs, matrix, _ = langid.train(rows)
    assert len(langs) == 12 and matrix.shape == (256, 12)


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, fixed = {n: i % 3 + 1 for i, n in enumerate(names)}, {}
    while True:
        free = [n for n in names if n not in fixed]
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[n] for n in free) if free else 0
        over = [n for n in free if weight[n] * level > 3 * sizes[n]]
        if not over:
            return {n: fixed.get(n, weight[n] * level) for n in names}
        fixed |= {n: 3.0 * sizes[n] for n in over}


def test_mix_meets_targets(docs, empty):
    got = mixing.mix_sources(docs).collect()
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert {(r["doc_id"], r["copies"]) for r in got} == again and len(got) == 245
    sizes, taken, largest = {}, {}, {}
    for r in got:
        s = r["source"]
        assert r["size"] == len((next(x["text"] for x in docs.where(F.col("doc_id") == r["doc_id"]).collect()) or "").split()) if r["doc_id"] > 899 else True
        sizes[s], taken[s], largest[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], max(largest.get(s, 0), r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = water_fill(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in sizes)
    assert mixing.mix_sources(empty).count() == 0


def test_shards(docs, empty):
    got = sharding.interleaved_shards(docs, 8).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert len(got) == 245 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    share = [sum(r["source"] == "s1" for r in rows) for rows in by.values()]
    assert max(share) - min(share) <= 2
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    assert sharding.interleaved_shards(empty).count() == 0


def test_licenses(spark, empty):
    mit = licenses.TEMPLATES["mit"]
    words = mit.split()
    del words[20:23]
    rows = [(1, "Intro words. " + mit + " More."), (2, "x y. Released under the MIT License. z"), (3, " ".join(words)), (4, None), (5, ""), (6, "the software is nice")]
    got = [(r["doc_id"], r["license"], r["coverage"], r["first_char"], r["end_char"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()]
    assert sorted(x[:2] for x in got) == [(1, "mit"), (2, "mit-notice"), (3, "mit")]
    first = next(x for x in got if x[0] == 1)
    assert first[2] == 1.0 and rows[0][1][first[3] : first[4]] == mit.rstrip(".")
    assert next(x for x in got if x[0] == 3)[2] < 1.0
    assert licenses.scan_licenses(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", ["mit-notice", "cc-by-nc-4.0-notice", "apache-2.0-notice", "gpl-3.0-notice"])
@pytest.mark.parametrize("between", ["\n", " and ", " with a few words more "])
def test_repeated_notices(name, between):
    notice, scanner = licenses.TEMPLATES[name], licenses.Scanner(licenses.TEMPLATES, 0.8)
    for times in (1, 2, 3, 6, 50):
        text = between.join([notice] * times)
        got = [x for x in scanner.scan(text) if x[0] == name]
        starts = [i * (len(notice) + len(between)) for i in range(times)]
        assert got == [(name, 1.0, len(scanner.words[scanner.names.index(name)]), s, s + len(notice.rstrip("."))) for s in starts]


def test_licenses_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    lines = {
        "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
        "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
        "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
        "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0",
        "bsd-notice": "Released under the BSD License.",
    }
    for name, line in lines.items():
        assert [x[0] for x in scanner.scan(line)] == [name]
    assert [x[0] for x in scanner.scan(" \n".join(lines.values()))] == list(lines)
    for name, text in licenses.TEMPLATES.items():
        found = scanner.scan(text)
        assert name in {x[0] for x in found if x[1] == 1.0}
        assert {licenses.KIND.sub("", x[0]) for x in found} == {licenses.KIND.sub("", name)}, name


def test_warc(spark):
    rows = [(5, "http://a/é x", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "u", None), (7, "u", ""), (1, "u", "ü" * 300_000), (None, "u", "<p>one</p>")]
    index = warc.write_archives(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = {r["page_id"]: r for r in warc.read_archives(spark, index, payload=True).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 7), 7: ("response", None), 1: ("response", None), None: ("response", None)}
    assert got[1]["payload"].decode() == "ü" * 300_000 and got[5]["payload_bytes"] == 10 and got[5]["payload_digest"] == warc.payload_digest(b"<p>one</p>")
    place = index.where("page_id = 2").first()
    head, block = warc.read_record(place["path"], place["frame"], place["at"])
    assert block == b"<p>one</p>" and head["WARC-Record-ID"] == warc.record_uri(2, warc.payload_digest(block))
    nothing = warc.write_archives(warc.plan_records(spark.createDataFrame([], "page_id long, url string, html string")))
    assert warc.read_archives(spark, nothing).count() == 0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_token_shards(docs, empty):
    manifest = sstable.write_tokens(docs, default_tokenizer())
    got = {r["doc_id"]: r for r in sstable.read_tokens(manifest, with_ids=True).collect()}
    lib, start = library(), 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        one = got[r["doc_id"]]
        assert (one["start"], one["n_tokens"], one["ids"], one["ids_crc32"]) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sstable.lookup(manifest, 17).tolist() == got[17]["ids"] and sstable.lookup(manifest, 5000) is None and sstable.lookup(manifest, -1) is None
    assert sstable.read_tokens(sstable.write_tokens(empty, default_tokenizer())).count() == 0


HARD = ["", "  ", "a\x1cb c\x1d", "ΑΣ ΟΔΟΣ", "é café İstanbul", "<|endoftext|> x<|startoftext|>y <|endoftext", "it's 'tis we'll' \"'s", "日本語 123 ４５ ²½", "👩‍👩‍👧 z", "a" * 300, "ﬁ ß ẞ", " x　y\x85z\xa0", "_u_s__ 'T'Re", "\x00\x01", "e\u0301 \u0301x"]


@pytest.mark.parametrize("lexicon", [None, {"cafe": [1]}, "real"])
def test_bpe_is_exact(lexicon):
    bpe, lib = WordBPE(default_tokenizer()), library()
    words = ["the", "quick", "there", "then", "walls"]
    made = None
    if lexicon == "real":
        made = Lexicon.mapped(build_lexicon({w.encode(): bpe.merge_words([w.encode()])[0].tolist() for w in words}))
        assert all(x >= 0 for x in made.find([b"the", b"walls"])) and made.find([b"th", b"thex", b"zz"]).tolist() == [-1, -1, -1]
    coder = Encoder(bpe, made)
    for text, got in zip(HARD, coder.encode_batch(HARD), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == want and coder.decode(ids) == lib.decode(want, skip_special_tokens=False)
    shards = sstable.LibraryEncoder(default_tokenizer())
    assert [np.frombuffer(x, shards.kind).tolist() for x in shards.encode_batch(HARD)] == [lib.encode(t, add_special_tokens=False).ids for t in HARD]


def test_codec_over_rows(docs, empty):
    lib = library()
    for r in tokens.encode_decode(docs, ["doc_id", "text"]).collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert tokens.encode_decode(empty, ["doc_id"], digests=True).count() == 0


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q, found in got.items():
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(3000), -score))[:10]
        hit += len({v for v, _ in found.values()} & set(want.tolist()))
        assert len(found) == 10 and all(abs(s - score[v]) < 1e-12 for v, s in found.values())
    assert len(got) == 60 and hit >= 0.9 * 600
    assert [got[100][r][0] for r in range(1, 11)] == list(range(101, 111))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few, few.where("vec_id = 0"), 10).count() == 2


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as c

    first = c.language_stage(spark, docs, "")
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in first.collect()} == {900, 901, 902, 903}
    second = c.duplicates_stage(spark, first, "").cache()
    brute = brute_components([(r["doc_id"], r["text"]) for r in first.collect()], 5, 80, 100)
    assert {r["doc_id"] for r in second.collect()} == {i for i, (_, root) in brute.items() if i == root}
    third = c.mixing_stage(spark, second, "").cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(second).collect()}
    assert {r["doc_id"]: r["count"] for r in third.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    last = c.tokens_stage(spark, third, "").collect()
    assert len(last) == sum(copies.values()) and [k for k, _ in c.STAGES] == ["language_id", "ngram_jaccard_join", "source_mix", "bpe_codec"]


FOX, TALE = "the quick brown fox jumps over the dog", "hello there my old friend of mine"
AWKWARD = [(1, FOX, "en", "a", 1), (1, FOX, "en", "a", 1), (None, FOX, "en", "a", 1), (None, TALE, "en", None, 1), (None, TALE, "en", None, 2), (1, "another text with the same id", "en", "a", 1), (2, None, None, None, None), (2, "", "en", "b", 0)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids, repeated rows, null and empty texts, and columns with the operators' own names."""
    clash = "key n c th component component_id text_hash size source_size target rank slice rows h score lang_pred row scored copies id from hash place copy maybe own many".split()
    return spark.createDataFrame([r + (7,) * len(clash) for r in AWKWARD], DOCS + ", " + ", ".join(f"{c} int" for c in clash)).repartition(3)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_duplicates_leave_one_row(awkward):
    rest = ngram_join.without_near_duplicates(awkward).cache()
    assert rest.columns == awkward.columns
    assert kept(rest) == sorted([(1, FOX), (None, TALE), (1, "another text with the same id"), (2, None), (2, "")], key=repr)
    assert kept(ngram_join.without_near_duplicates(awkward.limit(0))) == []


def test_mix_repeats_every_row(awkward):
    mixed = mixing.mixed_documents(awkward)
    sums = {}
    for r in mixing.mix_sources(awkward).collect():
        sums[r["doc_id"], r["source"], r["size"]] = sums.get((r["doc_id"], r["source"], r["size"]), 0) + r["copies"]
    got = {}
    for r in mixed.collect():
        key = r["doc_id"], r["source"], len((r["text"] or "").split())
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in sums.items() if n} and "key" in mixed.columns
    tale = mixed.where(F.col("text") == TALE).groupBy("n_chars").count().collect()
    shared = sums[None, None, len(TALE.split())]
    assert sorted((r["n_chars"], r["count"]) for r in tale) == [(1, -(-shared // 2)), (2, shared // 2)]
    assert mixing.mixed_documents(awkward.limit(0)).count() == 0


def test_language_keeps_columns_of_any_name(awkward):
    got = langid.accepted(awkward, langid.train(awkward))
    assert got.columns == awkward.columns and got.count() == 6 and {r["score"] for r in got.collect()} == {7}


def test_token_shards_without_ids(spark, awkward):
    manifest = sstable.write_tokens(awkward, default_tokenizer())
    got = sorted(sstable.read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, None, 1, 1, 1, 2, 2]
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    lib = library()
    for doc_id, text in ((None, TALE), (2, "")):
        assert sstable.lookup(manifest, doc_id).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 1]
    assert sstable.lookup(manifest, 3) is None


def test_partenum_subsets_left_whole():
    """The least number of whole subsets, by trying every way to damage parts."""
    from itertools import combinations_with_replacement

    for kind in (ngram_join.Family(1, 3, 2), ngram_join.Family(2, 3, 2), ngram_join.Family(3, 3, 2), ngram_join.Family(2, 4, 2), ngram_join.Family(5, 1, 1)):
        parts = [(r, p) for r in range(kind.n1) for p in range(kind.n2)]
        for k in range(5):
            worst = min(sum(not any((r, p) in hit for p in subset) for r in range(kind.n1) for subset in kind.subsets) for hit in map(set, combinations_with_replacement(parts, k)))
            assert kind.agree(k) == worst
    for k in range(1, 40):
        assert ngram_join.family(k).agree(k) >= 1
