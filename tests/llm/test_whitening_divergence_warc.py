"""Whitening, the divergence audit and web archives on small tables with odd rows, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, transducer, warc, whitening

VECTORS = "vec_id long, embedding array<float>, n string, whitened string, label int"


def plain_whitening(x, count):
    """Eigenvectors and values of the covariance of ``x``, centred first."""
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return values[::-1][:count], vectors[:, ::-1][:, :count], c, np.trace(c.T @ c / n)


def grid(vectors):
    return np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    made = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    rows = [(i, [float(c) for c in v], "x", "y", i % 3) for i, v in enumerate(made)]
    rows += [rows[0], rows[0], (None, [0.0] * 12, None, None, None)]
    odd = [(900, None), (901, [float("nan")] * 12), (902, [1.0] * 11 + [None]), (903, [float("inf")] + [0.0] * 11)]
    return rows, [(i, v, "x", "y", None) for i, v in odd]


def test_whitening_against_eigenvectors(spark, vectors):
    good, odd = vectors
    df = spark.createDataFrame(good + odd, VECTORS).repartition(5)
    got = whitening.whiten(df, components=5).collect()
    assert len(got) == len(good)
    x = grid([r[1] for r in good])
    values, axes, c, trace = plain_whitening(x, 5)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    plain = c @ axes / np.sqrt(values)
    place = {r[0]: i for i, r in enumerate(good)}
    ours = np.array([r["whitened"] for r in got])
    theirs = plain[[place[r["vec_id"]] for r in got]]
    signs = np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours - theirs * signs).max() < 1e-10
    assert all(r["deviation"] == deviation[place[r["vec_id"]]] and r["n"] == n and r["label"] == good[place[r["vec_id"]]][4] for r in got)
    assert np.abs(np.array(got[0]["explained"]) / (values / trace) - 1).max() < 1e-12
    assert got[0]["identity_error"] < 1e-10


def test_whitening_finds_values_that_occur_several_times(spark):
    # The covariance of +-e_i is a multiple of the identity: one start vector shows one component only.
    rows = [(2 * i + s, [(1.0 if s else -1.0) if k == i else 0.0 for k in range(8)], "", "", 0) for i in range(8) for s in range(2)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS), components=6).collect()
    assert {len(r["whitened"]) for r in got} == {6} and got[0]["identity_error"] < 1e-12
    assert np.allclose(got[0]["explained"], 1 / 8)


def test_whitening_leaves_out_components_without_deviation(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a), float(a), float(b), 7.0], "", "", 0) for i, (a, b) in enumerate(rng.integers(0, 50, (40, 2)))]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {len(r["whitened"]) for r in got} == {2} and got[0]["identity_error"] < 1e-9
    alike = whitening.whiten(spark.createDataFrame(rows[:1] * 3, VECTORS)).collect()
    assert [r["whitened"] for r in alike] == [[]] * 3 and {r["deviation"] for r in alike} == {0}


def test_whitening_of_other_lengths_large_entries_and_nothing(spark, vectors):
    good, odd = vectors
    short = [(1000 + i, [float(i), float(i * i)], "", "", 0) for i in range(6)] + [(2000, [], "", "", 0)]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(good[:20] + short, VECTORS), components=2).collect()}
    assert got[0]["n"] == 20 and got[1001]["n"] == 6 and got[2000]["n"] == 1 and got[2000]["whitened"] == []
    assert len(got[1001]["whitened"]) == 2
    huge = [(i, [3e38 * (-1) ** i, float(i)], "", "", 0) for i in range(4)]
    large = whitening.whiten(spark.createDataFrame(huge, VECTORS)).collect()
    assert len(large) == 4 and {r["deviation"] for r in large} == {None}
    for rows in ([], odd):
        none = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert none.count() == 0 and {"n", "deviation", "whitened", "explained", "identity_error"} <= set(none.columns)


def test_whitening_adds_up_many_tasks_in_lanes(spark, vectors, monkeypatch):
    good, _ = vectors
    df = spark.createDataFrame(good, VECTORS).repartition(6)
    fit = whitening.stored(whitening.on_grid(df, "embedding", 64, 1_000_000).select("__x"), "test")
    whole, error = whitening.fitted(fit, 4)
    monkeypatch.setattr(whitening, "LANES", 1)
    lanes, _ = whitening.fitted(fit.repartition(5), 4)
    assert np.abs(whole.values / lanes.values - 1).max() < 1e-12 and error < 1e-10
    assert np.abs(np.abs((whole.vectors * lanes.vectors).sum(axis=0)) - 1).max() < 1e-12


def test_whitening_stops_early_on_long_vectors():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 120)) * (2.0 ** -np.arange(120) + 1e-3)
    a -= a.mean(axis=0)

    def products(columns):
        return whitening.of_last(a, a @ columns)

    found = whitening.Bidiagonalisation(products, 120, np.linalg.norm(a), 4)
    found.find()
    assert found.passes < 60
    u, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.abs(found.values / s[:4] - 1).max() < 1e-12
    assert np.abs(np.abs((found.vectors * v[:4].T).sum(axis=0)) - 1).max() < 1e-12


def test_transducer_against_a_sorted_list():
    rng = random.Random(2)
    for size in (0, 1, 5, 400):
        terms = sorted({bytes(rng.choice(b"abc\xc3\xa4") for _ in range(rng.randint(1, 7))) for _ in range(size)})
        made = transducer.Transducer.from_bytes(transducer.build(terms).to_bytes())
        asked = terms + [b"", b"zz", b"abcabcabc"] + [t + b"b" for t in terms[:50]] + [t[:-1] for t in terms[:50]]
        data = np.frombuffer(b"".join(asked), np.uint8)
        ends = np.cumsum([len(t) for t in asked])
        starts = ends - [len(t) for t in asked]
        number = {t: i for i, t in enumerate(terms)}
        assert made.ordinals(data, starts, ends).tolist() == [number.get(t, -1) for t in asked]
    with pytest.raises(ValueError):
        transducer.build([b"b", b"a"])


def test_transducer_is_minimal():
    # All words of two letters and an ending: one path of four states.
    terms = sorted(bytes([a, b]) + b"ing" for a in b"abcdef" for b in b"ghijkl")
    made = transducer.build(terms)
    assert len(made.accepting) == 6 and made.accepting.sum() == 1


def plain_audit(docs, least, top):
    def terms(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]

    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        seen[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    found = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)

        def odds(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        of = {s: odds(counts[lang, s]) for s in sources}
        whole = odds(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(of[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, rows in (("pair", pairs), ("term", over)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                found += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(rows) if part == "pair" or i < top]
    return sorted(found)


AUDITED = "text string, lang string, source string, rank string, value double"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["ta", "Tab", "tabs", "été", "日本", "x", "o_o", "don't", "ÄRGER", "end"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(6)]
    made = []
    for _ in range(260):
        source = rng.choice(["a", "b", "c", "ä", "", None])
        pick = words if source != "b" else words[20:]
        made.append((" ".join(rng.choice(pick) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), source, "r", 0.5))
    made += [(None, "en", "nothing", "r", None), ("", None, None, None, None), ("12 34 !", "fr", "a", None, None), ("one", "fr", "b", None, None)]
    return made + [made[0]] * 4 + [("hot words here " * 4000, "en", "a", None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, texts, monkeypatch, small):
    if small:
        for name, value in (("SHARD_TERMS", 5), ("PART_BYTES", 2000), ("SOURCES", 2), ("TERMS", 7), ("BLOCK_BYTES", 300)):
            monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame(texts, AUDITED).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, least=4, top=6).collect())
    assert got == plain_audit([t[:3] for t in texts], 4, 6)


def test_audit_of_nothing(spark):
    none = divergence.audit(spark.createDataFrame([], AUDITED))
    assert none.collect() == [] and none.columns == ["lang", "source", "part", "item", "value", "rank"]
    rare = divergence.audit(spark.createDataFrame([("a b", "en", "x", None, None), ("c", "en", "y", None, None)], AUDITED))
    assert sorted(tuple(r) for r in rare.collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


PAGES = "page_id long, url string, html string, kind string, record long"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    bodies = ["".join(rng.choice("ab\r\n é日") for _ in range(rng.choice([0, 1, 10, 99, 100, 101, 350, 3000]))) for _ in range(40)]
    bodies += ["\r\n\r\n" * 60, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "\r\n", "x\r\n\r", None, None, ""]
    rows = [(i, f"http://e.org/{i}", b, "k", 1) for i, b in enumerate(bodies)]
    rows += [(100 + i, "http://e.org/é x\r\nWARC-Type: bad", bodies[i], None, None) for i in range(0, 12, 2)]
    rows += [(None, None, bodies[3], None, None), (None, None, "no id", None, None), rows[5], rows[5], rows[5]]
    return rows + [(200 + i, None, "many copies " * 40, None, None) for i in range(30)]


def plain_archive(rows):
    def key(row):
        return -1 if row[0] is None else row[0]

    best = {}
    for row in rows:
        best[row[2] or ""] = max(best.get(row[2] or "", -2), key(row))
    found, given = [], set()
    for row in rows:
        body = row[2] or ""
        response = key(row) == best[body] and body not in given
        if response:
            given.add(body)
        refers = None if response or best[body] < 0 else best[body]
        digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        found.append((row[0], len(body.encode()), digest, "response" if response else "revisit", refers))
    return sorted(found, key=repr)


@pytest.mark.parametrize("chunk_bytes", [100, warc.CHUNK_BYTES])
def test_archive_round_trip(spark, pages, tmp_path, chunk_bytes):
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    folder = f"{tmp_path}/archives"
    got = warc.archive(df, folder, chunk_bytes=chunk_bytes).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["kind"], r["refers_to"]) for r in got), key=repr) == plain_archive(pages)
    # The payloads themselves come back, put together from their chunks.
    chunks = warc.read_archives(spark, folder).collect()
    assert max(len(r["data"]) for r in chunks) <= chunk_bytes
    whole = defaultdict(bytes)
    for r in sorted(chunks, key=lambda r: (r["record"], r["chunk"])):
        whole[r["record"]] += r["data"]
    responses = {r["record"] for r in got if r["kind"] == "response"}
    assert sorted(whole[r] for r in responses) == sorted({(row[2] or "").encode() for row in pages})
    assert all(whole[r["record"]] == b"" for r in got if r["kind"] == "revisit")


def test_archive_carries_digests_from_chunk_to_chunk(spark):
    df = spark.createDataFrame([(1, "u", "abcdefg", None, None)], PAGES)
    rows = warc.chunked(df, chunk_bytes=3).orderBy("chunk").collect()
    assert [bytes(r["data"]) for r in rows] == [b"abc", b"def", b"g"] and [r["last"] for r in rows] == [False, False, True]
    assert [bytes(r["sha1"]) for r in rows] == [hashlib.sha1(t).digest() for t in (b"abc", b"abcdef", b"abcdefg")]
    assert [r["bytes_so_far"] for r in rows] == [3, 6, 7]


def test_archive_files_are_plain_warc(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "http://a/", "hello", None, None), (2, "http://b/", "hello", None, None)], PAGES).coalesce(1)
    warc.archive(df, f"{tmp_path}/w")
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("part-*.gz")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    assert b"WARC-Target-URI: http://b/\r\n" in data and data.count(b"hello") == 1 and b"WARC-Type: revisit" in data


def test_archive_cut_off_is_an_error(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "http://a/", "hello world", None, None)], PAGES).coalesce(1)
    warc.archive(df, f"{tmp_path}/w")
    part = next((tmp_path / "w").glob("part-*.gz"))
    (tmp_path / "cut").mkdir()
    with gzip.open(tmp_path / "cut" / "part.gz", "wb") as out:
        out.write(gzip.open(part).read()[:-12])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, f"{tmp_path}/cut").collect()


def test_archive_of_nothing(spark):
    none = warc.archive(spark.createDataFrame([], PAGES))
    assert none.select("page_id", "payload_bytes", "payload_digest", "kind", "refers_to").collect() == []


def test_sketch_loses_no_id(spark):
    rows = spark.range(500).withColumn("record", F.concat(F.lit("0-"), "id"))
    maybe, surely = warc.split_by_ids(rows, "record", rows.filter("id % 7 = 0").select("record"))
    assert maybe.count() + surely.count() == 500 and maybe.filter("id % 7 = 0").count() == math.ceil(500 / 7)
