"""The operators on small tables with nulls, empty and long texts, ties, repeats and odd columns, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import jaccard, line_dedup, mixing, packing, quality_model, quality_rules, substrings, suffixes, tokens, vantage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, clean_text string, size string, n_tokens string"


def prose(rng, words, sentence=12):
    made = ["".join(rng.choice(["ta", "ri", "on", "el", "sha", "mu", "der"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    lines = [" ".join(made[i : i + sentence]).capitalize() + "." for i in range(0, words, sentence)]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, shared lines and passages, junk, and the odd cases."""
    rng = random.Random(7)
    base = [prose(rng, rng.choice([3, 40, 90, 160])) for _ in range(40)]
    passage = prose(rng, 120)
    texts = list(base)
    texts += base[:4] + [base[5].replace("ta", "to", 1), base[6] + " End of it.", base[7].replace(" ", "  ")]
    texts += [passage + "\n" + base[8], base[9] + "\n" + passage, passage]
    texts += ["a" * 3000, "nav | home | about | us\n" * 30, "WORD!! " * 80, "", "   \n\t", None, None, "one", "one two", "naïve “quotes” 日本 don't <|endoftext|>"]
    texts += [prose(rng, 30_000)]
    found = [(i, t, "en", rng.choice(["a", "b", "ä", None]), None, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return [*found, found[1], found[1], (None, "text without an id, " * 30, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def key(row):
    return tuple(str(v) for v in row)


def test_quality_rules(docs, none, rows):
    def plain(text):
        w = words(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        repeat = len(covered)
        return (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat,
            len(w) < 50 or 100 * repeat > 50 * len(w),
        )

    result = quality_rules.clean_lines(docs)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted(map(key, result.select(*columns).collect()))
    assert got == sorted(key((r[0], *plain(r[1]))) for r in rows)
    kept = {r["doc_id"]: r for r in result.collect()}
    assert not kept[51]["kept"] and kept[51]["n_bad_lines"] == 30 and kept[51]["clean_text"] == ""
    assert kept[2]["kept"] == (not kept[2]["base_failed"])
    assert quality_rules.clean_lines(none).count() == 0


def test_quality_rules_run_no_python(docs):
    plan = quality_rules.clean_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


def test_repeated_starts_against_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        length = rng.choice([15, 16, 20, 29, 57, 70])
        letters = rng.choice([b"a", b"ab", b"\x00\xff", b"abcd", bytes(range(256))])
        strings = []
        for _ in range(rng.randint(1, 10)):
            piece = bytes(rng.choice(letters) for _ in range(rng.randint(0, 150)))
            if strings and rng.random() < 0.6:
                whole = rng.choice(strings)
                a, b = sorted((rng.randint(0, len(whole)), rng.randint(0, len(whole))))
                piece = piece[:3] + whole[a:b] + piece[3:6]
            strings.append(piece)
        weights = [rng.choice([1, 1, 2]) for _ in strings]
        count = Counter()
        for s, w in zip(strings, weights):
            for i in range(len(s) - length + 1):
                count[s[i : i + length]] += w
        expected = [[i for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1] for s in strings]
        assert [x.tolist() for x in suffixes.repeated_starts(strings, weights, length)] == expected


def test_only_new_intervals_are_extended():
    """The expansion starts from the boundaries of exactly ``SEED - 1`` common bytes; all others were extended before."""
    rng = random.Random(11)
    for letters in (b"ab", b"\x00\xff", bytes(range(256))):
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(8)]
        strings += [strings[0][5:] + b"a", strings[1], strings[2][:40]]
        text, order, first, young, left = suffixes.suffix_order(strings, 60)
        suffix = [tuple(text[p : p + left[p]].tolist()) for p in order.tolist()]
        common = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffix, suffix[1:])]
        assert young.tolist() == [i for i, n in enumerate(common, 1) if n == suffixes.SEED - 1]
        assert np.flatnonzero(first).tolist() == [0, *(i for i, n in enumerate(common, 1) if n < suffixes.SEED), len(order)]


def test_ordered_pairs_of_narrow_and_wide_keys():
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 5, 400), rng.integers(0, 1 << 21, 3)[rng.integers(0, 3, 400)].astype(np.int32)
    high[:9] = (1 << 21) - 1
    pairs = sorted(zip(high.tolist(), low.tolist()))
    for bits in (21, 22, 31):
        order, new = suffixes.ordered_pairs(high, low, bits)
        assert list(zip(high[order].tolist(), low[order].tolist())) == pairs
        assert new.tolist() == [x != y for x, y in zip(pairs, pairs[1:])]
    high[:9] = (1 << 31) - 2
    order, _ = suffixes.ordered_pairs(high, low, 31)
    assert list(zip(high[order].tolist(), low[order].tolist())) == sorted(zip(high.tolist(), low.tolist()))


@pytest.mark.parametrize("shard", [substrings.SHARD_BYTES, 2000])
def test_substrings(docs, none, rows, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    monkeypatch.setattr(substrings, "PIECE", 5000)
    length = 120
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(t[i : i + length] for _, t in raw for i in range(len(t) - length + 1))
    expected = []
    for doc_id, text in raw:
        mask = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(text, mask) if not m)
        expected.append((doc_id, len(text), sum(mask), sum(1 for x in bytes(mask).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    found = substrings.repeated_substrings(docs, length, 60).collect()
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found]
    assert sorted(map(key, got)) == sorted(map(key, expected))
    if shard == 2000:
        assert substrings.repeated_substrings(none).count() == 0


def test_token_counts(docs, none, rows):
    reference = Tokenizer.from_file(TOKENIZER)
    expected = []
    for r in rows:
        n = len(reference.encode(r[1] or "", add_special_tokens=False).ids)
        expected.append((r[0], len((r[1] or "").encode()), n, n > 2048))
    got = tokens.count_tokens(docs, TOKENIZER).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(key, got)) == sorted(map(key, expected))
    assert tokens.count_tokens(none, TOKENIZER).count() == 0


def test_encoder_on_odd_texts():
    source = open(TOKENIZER).read()
    encoder, reference = tokens.Encoder(source, tokens.whole_tokens(source)), Tokenizer.from_file(TOKENIZER)
    odd = ["İstanbul ǅ ŉ", "don't I'LL 's", "a<|endoftext|>b <|STARTOFTEXT|><|startoftext|>", "é ΣΑΣ", "x\x1cy\x85z w　",
           "½²3４ ٣", "\x00\x01a", "😀😀 ok", "ﬁ ß ẞ ª º µ", "\xad soft\xadhyphen", "i̇", "<|", "`^_~", "a" * 3000]
    for text in odd:
        raw = encoder.encode(text.encode())
        got = [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]
        assert got == reference.encode(text, add_special_tokens=False).ids, text


def test_proven_pieces_are_not_merged_in_any_script():
    source = open(TOKENIZER).read()
    whole = tokens.whole_tokens(source)
    encoder, reference = tokens.Encoder(source, whole), Tokenizer.from_file(TOKENIZER)
    asked = []
    merge = encoder.pieces.tokenize
    encoder.pieces.tokenize = encoder.spelled.tokenize = lambda letters: asked.append(letters) or merge(letters)
    for text in ("the people of “the” city — and the river", "the people of the city and the river", "люди the людей город"):
        asked.clear()
        ids = encoder.encode(text.encode())
        assert len(ids) == 2 * len(reference.encode(text, add_special_tokens=False).ids)
        assert not set(asked) & {"the", "people", "of", "city", "and", "river"}
        asked.clear()
        assert encoder.encode(text.encode()) == ids and not asked


def test_bounded_table_of_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    source = open(TOKENIZER).read()
    encoder, reference = tokens.Encoder(source, tokens.whole_tokens(source)), Tokenizer.from_file(TOKENIZER)
    text = "qzxv wvkq zzkx qjjx vvzq qzxv"
    assert len(encoder.encode(text.encode())) == 2 * len(reference.encode(text, add_special_tokens=False).ids)


def test_packing(docs, none, rows):
    import numpy as np
    from zlib import crc32

    reference = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(docs, TOKENIZER).collect()
    ids = {}
    for r in rows:
        ids[r[0]] = reference.encode(r[1] or "", add_special_tokens=False).ids + [1]
    by_doc, by_sequence = Counter(), {}
    for p in pieces:
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        by_doc[p.doc_id] += p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    times = Counter(r[0] for r in rows)
    assert by_doc == Counter({d: times[d] * len(i) for d, i in ids.items()})
    for parts in by_sequence.values():
        total = 0
        for offset, length in sorted(parts):
            assert offset == total
            total += length
        assert total <= 2048 and total & (total - 1) == 0
    groups = Counter()
    for s, g, t in {(p.sequence_id, p.step_group, p.tier) for p in pieces}:
        groups[g] += t
    assert max(groups.values()) <= packing.STEP_TOKENS
    assert packing.pack(none, TOKENIZER).count() == 0


def components_of(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("join, block", [(jaccard.Join(), jaccard.BLOCK), (jaccard.Join(2, 60), 3)])
def test_jaccard(spark, docs, none, rows, monkeypatch, join, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LOCAL", 3)
    rng = random.Random(3)
    base = prose(rng, 80).split(" ")
    near = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz") * 3
        near.append((1000 + i, " ".join(copy), None, None, None, None, None, None, None))
    sets = {}
    for r in rows + near:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(r[1])]
        grams = zip(*(w[k:] for k in range(join.words)))
        sets[r[0]] = frozenset(grams) if len(w) >= join.words else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    links = [
        (a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and join.linked(len(sets[a] & sets[b]), len(sets[a] | sets[b]))
    ]
    group = components_of(links, ids)
    found = jaccard.similar_documents(docs.unionByName(spark.createDataFrame(near, SCHEMA)), join).collect()
    assert sorted(map(key, found)) == sorted(key((r[0], len(sets[r[0]]), group.get(r[0]))) for r in rows + near)
    if block == 3:
        assert jaccard.similar_documents(none).count() == 0


def test_prefixes_grow_where_shingles_are_frequent():
    import numpy as np

    assert jaccard.choose_matches(np.ones(100), 90, 100) == 1
    assert jaccard.choose_matches(np.full(100, 500.0), 90, 100) > 1


def test_line_dedup(spark, none, rows):
    rng = random.Random(11)
    line = [rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) for _ in range(12)]
    variants = [line, line[:5] + ["new"] + line[6:], line[:3] + line[4:], line + ["more"], line[:4] + ["x", "y"] + line[6:], line[::-1]]
    more = [(2000 + i, "\n".join(" ".join(v) for v in rng.sample(variants, 4)), None, None, None, None, None, None, None) for i in range(8)]
    everything = rows + more
    order = lambda i, p: (i is None, i or 0, p)
    bounds = line_dedup.Bounds()
    first, texts = {}, {(r[0], r[1]) for r in everything}
    for i, text in texts:
        for p, x in enumerate((text or "").split("\n")):
            w = tuple(words(x))
            if len(w) >= bounds.least_words:
                first[w] = min(first.get(w, order(i, p)), order(i, p))
    near = {a for a in first for b in first if min(len(a), len(b)) >= bounds.least_fuzzy and first[b] < first[a] and line_dedup.one_edit(list(a), list(b))}

    def plain(i, text):
        if text is None:
            return 0, 0, None
        lines = text.split("\n")
        gone = [p for p, x in enumerate(lines) if len(w := tuple(words(x))) >= bounds.least_words and (w in near or first[w] != order(i, p))]
        return len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)

    found = line_dedup.dedup_lines(spark.createDataFrame(everything, SCHEMA).repartition(3))
    got = found.select("doc_id", "n_lines", "n_removed", "clean_text").collect()
    assert near and sorted(map(key, got)) == sorted(key((r[0], *plain(r[0], r[1]))) for r in everything)
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_short_lines(spark):
    texts = ["Yes.\nAll rights reserved.\nYes.\n\n\nNo.", "No.\n  Yes.\nall rights reserved.", "one two three four five\n\nNo. \nsix", "one two other four five\none two three four"]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_lines, r.n_removed, r.clean_text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {
        (0, 6, 1, "Yes.\nAll rights reserved.\n\n\nNo."), (1, 3, 2, "all rights reserved."),
        (2, 4, 1, "one two three four five\n\nsix"), (3, 2, 1, "one two three four"),
    }


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "same line\nother", "text", 5, [7]), (2, "same line", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, places long, gone array<int>")
    found = sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect())
    assert found == [(*rows[0], 2, 0, "same line\nother"), (*rows[1], 1, 1, "")]
    longs = spark.createDataFrame([(1, "a", 17)], "doc_id long, text string, uid long")
    assert line_dedup.dedup_lines(longs).first()["uid"] == 17


def test_line_dedup_of_texts_of_one_id(spark):
    line = "one line of words that stands in both of the texts"
    docs = [(7, line + "\nmine"), (7, line + "\nyours"), (8, "a b c d e f"), (8, "a b c d e g"), (9, "twice"), (9, "twice")]
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(key, ((r.doc_id, r.n_removed) for r in found))) == sorted(map(key, [(7, 0), (7, 1), (8, 0), (8, 1), (9, 0), (9, 0)]))


def test_mixing(docs, none, rows):
    found = mixing.mix(docs).collect()
    size = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    total = 1.5 * sum(size.values())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = total - sum(2.0 * size[s] for s in capped)
        free = [s for s in size if s not in capped]
        target = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if target[s] > 2 * size[s]}
        if not above:
            break
        capped |= above
    target |= {s: 2.0 * size[s] for s in capped}
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    largest = max(len(words(r[1])) for r in rows)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((key((r["doc_id"], r["taken"])) for r in again)) == sorted(key((r["doc_id"], r["taken"])) for r in found)
    assert mixing.mix(none).count() == 0


def test_residual_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 30), "hot" if i % 3 else "cold") for i in range(400)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("hot", "cold"):
        own = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 30


def test_pivotal_pairs_keep_expectations():
    tallies = Counter()
    for seed in range(3000):
        done, left = mixing.round_pairs([("a", 3, 0.2), ("b", 5, 0.7), ("c", 2, 0.5)], seed)
        tallies.update(done)
        if left:
            tallies[left[0]] += left[2]
    for name, p in (("a", 0.2), ("b", 0.7), ("c", 0.5)):
        assert tallies[name] / 3000 == pytest.approx(p, abs=0.04)


def test_vantage_points(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 6)).astype(np.float32)
    vectors[50:90] = vectors[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(500, None), (520, [0.0] * 6), (540, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (560, [float("nan")] * 6), (580, [float("inf")] * 6), (600, [1.0, 2.0]), rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vantage.nearest(df, df.filter("vec_id % 20 = 0"), k=7, shard_rows=90, block_queries=8).collect()
    exact = vectors.astype(np.float64)
    expected = []
    for q in range(0, 400, 20):
        scores = np.zeros(400)
        for j in range(6):
            scores += exact[:, j] * exact[q, j]
        best = [i for i in np.lexsort((np.arange(400), -scores)) if i != q]
        # The repeated row of id 40 is a candidate as often as it stands.
        best = [x for i in best for x in [i] * (2 if i == 40 else 1)][:7]
        expected += [(q, n + 1, int(i), scores[i]) for n, i in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(expected)
    assert vantage.nearest(df.filter("vec_id < 0"), df.filter("vec_id < 0")).count() == 0


@pytest.mark.parametrize("kind", ["ties", "long", "own"])
def test_vantage_points_lose_none(spark, kind):
    import numpy as np

    rng = np.random.default_rng(6)
    if kind == "ties":
        vectors = rng.integers(-1, 2, size=(3000, 16)).astype(float)
        vectors[:, 0] = 1
    else:
        vectors = rng.normal(size=(3000, 16))
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids = np.arange(3000)
    if kind == "long":
        vectors[1500] *= 1e8
    if kind == "own":
        vectors[100:140], ids[100:130] = vectors[100], 100
    df = spark.createDataFrame(list(zip(ids.tolist(), vectors.tolist())), "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in vantage.nearest(df, df.filter("vec_id % 20 = 0")).collect()]
    expected = []
    for q in np.unique(ids[ids % 20 == 0]):
        scores = np.zeros(3000)
        for j in range(16):
            scores += vectors[:, j] * vectors[q, j]
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:20]
        expected += [(ids[q], ids[i], scores[i]) for i in best]
    assert sorted(got) == sorted(expected)


def test_relaxed_bound_prunes():
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 2))
    tree, queries = vantage.Tree(points), points[:50]
    exact, _ = tree.search(queries, 5, 1.0)
    full = tree.seen
    relaxed, _ = tree.search(queries, 5, 2.0)
    assert full < 50 * 3000 and tree.seen <= full
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact, relaxed)]) >= 0.9


def test_quality_model(spark, none):
    rng = random.Random(9)
    good = [prose(rng, 60) for _ in range(150)]
    bad = [" | ".join(words(prose(rng, 60))) for _ in range(75)] + ["BUY!! NOW!! " * 20 + prose(rng, 5) for _ in range(75)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), None) for i in range(300)] + [(900, None, 1)], "doc_id long, quality int, toxic int")
    found = quality_model.score_quality(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    tested = [r for r in found if r.held_out and r.doc_id < 300]
    assert len(tested) > 40 and sum(r.predicted == int(r.doc_id < 150) for r in tested) >= 0.95 * len(tested)
    one_kind = quality_model.score_quality(docs, labels.filter("quality = 1")).collect()
    assert {r.score for r in one_kind} == {0.5}
    assert quality_model.score_quality(none, labels).count() == 0


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(5)
    texts = [prose(rng, 25) if i % 2 else " # ".join(words(prose(rng, 25))) for i in range(80)]
    docs = spark.createDataFrame([(i % 70, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, quality int")


def test_quality_model_does_not_depend_on_layout(graded):
    docs, labels = graded
    models = [quality_model.fit(docs.repartition(n), labels.repartition(n), sample=40) for n in (2, 7)]
    for one, other in zip(*models):
        assert np.array_equal(one, other)
    assert models[0][1].any()


def test_log_count_ratios_and_dual_solution_by_plain_versions(graded):
    docs, labels = graded
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.text, quality[r.doc_id]) for r in docs.collect()]
    alone = [quality_model.features([t.encode()])[0] for t, _ in rows]
    together = quality_model.features([t.encode() for t, _ in rows])
    assert all(sorted(a) == sorted(b) and len(set(a)) == len(a) for a, b in zip(alone, together))

    counts = {k: Counter(f for ids, (_, label) in zip(alone, rows) if label == k for f in ids) for k in (0, 1)}
    sums = {k: sum(counts[k].values()) + quality_model.FEATURES for k in (0, 1)}
    expected = [np.log(((counts[1][f] + 1) / sums[1]) / ((counts[0][f] + 1) / sums[0])) for f in range(quality_model.FEATURES)]
    training = docs.sparkSession.createDataFrame(rows, "text string, label int").repartition(3)
    ratios = quality_model.log_count_ratios(training)
    assert np.array_equal(ratios, expected)

    vectors = [quality_model.vector(ids, ratios) for ids in alone]
    y = np.array([label for _, label in rows]) * 2 - 1
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())

    def gap(epochs):
        """Primal less dual value, relative to the primal, with the multipliers the weights stand for."""
        weights = quality_model.dual_descent(vectors, y, epochs, 1.0)
        slack = np.maximum(0, 1 - y * np.array([weights[p] @ v for p, v in vectors]))
        alpha, back = slack / share, np.zeros_like(weights)
        for a, label, (p, v) in zip(alpha, y, vectors):
            back[p] += a * label * v
        primal = weights @ weights / 2 + (slack**2 / share).sum() / 2
        return (primal - (alpha.sum() - back @ back / 2 - (share * alpha**2).sum() / 2)) / primal

    assert -1e-9 <= gap(400) < 1e-9 and gap(quality_model.EPOCHS) < 0.01


def test_kept_documents_are_computed_once(docs):
    kept = quality_rules.kept_documents(docs)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    assert sorted(map(key, kept.collect())) == sorted(map(key, quality_rules.clean_lines(docs).filter("kept").collect()))


def test_mixed_documents_take_what_the_mix_takes(docs, none):
    mixed = mixing.mix_documents(docs).collect()
    sizes = Counter()
    for row in mixed:
        sizes[row["source"]] += row["copies"] * len(words(row["text"]))
        assert row["copies"] <= 2
    targets = {r["source"]: (r["target"], r["taken"]) for r in mixing.mix(docs).groupBy("source", "target").agg({"taken": "sum"}).toDF("source", "target", "taken").collect()}
    largest = max(len(words(r["text"])) for r in docs.collect())
    assert all(abs(sizes[s] - target) <= largest for s, (target, _) in targets.items())
    assert mixing.mix_documents(none).count() == 0


def test_mixed_documents_that_repeat(spark, docs):
    rows = docs.filter("doc_id = 1").limit(1).collect() * 7
    mixed = mixing.mix_documents(spark.createDataFrame(rows, docs.schema)).collect()
    assert len(mixed) == 7 and sorted(r["copies"] for r in mixed) in ([1] * 4 + [2] * 3, [1] * 3 + [2] * 4)


def test_vectors_without_an_id_take_no_part(spark):
    rows = [(None, [9.0, 9.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in vantage.nearest(df, df, k=2).collect())
    assert [f[:3] for f in found] == [(0, 1, 2), (0, 2, 1), (1, 1, 2), (1, 2, 0), (2, 1, 0), (2, 2, 1)]
