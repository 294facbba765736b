"""Jaccard join of word shingles with adaptive multi-match prefixes.

A document's set is its distinct shingles. Shingles are put in one order for all documents, rare ones first,
and a document offers the first of them, its prefix. Two sets that overlap enough must share ``l`` of
their prefixes lengthened by ``l - 1``. Each document picks its own ``l``: where the shingles of its prefix are
frequent, so that many candidates are to be expected, a longer prefix asks for more common ones. A pair is
verified only if it shares as many as the smaller ``l`` of the two.

What keeps large groups of copies linear or bounded:

* documents of equal sets are one from the start;
* first, each prefix shingle's documents are held against one of them only (a star), which joins groups of
  mutual copies at once;
* then pairs of the same shingle that are not joined yet are looked at inside tasks, in blocks of at
  most ``BLOCK`` by ``BLOCK`` documents, where lengths, a bitmap bound on the overlap and the multi-match
  count drop pairs before any is returned.

No pair that can be linked is dropped at any point. Links are verified on whole sets.

Defined results: a null or empty text, or one without words, has an empty set and is its own component; a text with fewer words than a
shingle is one shingle; rows with one id are one document of the graph; rows without id are linked with nothing and have component null;
an empty table gives an empty table; further columns are ignored. Equal 64-bit hashes count as equal shingles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.hashing import mixed, shingles, weighed_shingles, words
from ledgerloom.llm.shared import split_by_ids, stored, text_blocks

#: Frequent shingles whose count is told to every task (at most 1.6 MB): those met LOCAL times or more among the
#: documents of CHUNK shingles, by their sum. They shape the order only, never the result.
FREQUENT, LOCAL, CHUNK = 100_000, 4, 2_000_000
#: Counters of words, by hash, told to every task (2 MB): they too shape the order only.
WORD_SLOTS = 1 << 18
MOST_MATCHES, VERIFY_COST = 8, 16.0
BLOCK = 4096
#: Bits of a document's bitmap: a power of two, as many as its shingles within these bounds.
LEAST_BITS, MOST_BITS = 512, 16384


@dataclass(frozen=True)
class Join:
    """``words`` in a shingle; link where ``100 * overlap >= percent * union``."""

    words: int = 3
    percent: int = 90

    def linked(self, overlap, union) -> bool:
        return 100 * overlap >= self.percent * union


def statistics(docs: DataFrame, join: Join):
    """Counts of the most frequent shingles, in sorted arrays, and of words by slot, all from all documents."""
    import numpy as np

    def counted(batches):
        import pyarrow as pa

        def result(keys, counts, word):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(np.full(len(keys), word))], ["key", "count", "word"])

        def frequent(held):
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL
            return result(found[often], counts[often], False)

        held, size, slots = [], 0, np.zeros(WORD_SLOTS, np.int64)
        for _, texts in text_blocks(batches):
            hashes, counts = words(texts, True)
            slots += np.bincount((hashes % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=WORD_SLOTS)
            for s, _ in weighed_shingles(hashes, counts, join.words):
                held.append(s)
                size += len(s)
            if size >= CHUNK:
                yield frequent(held)
                held, size = [], 0
        if held:
            yield frequent(held)
        used = np.flatnonzero(slots)
        yield result(used, slots[used], True)

    counts = docs.select("text").mapInArrow(counted, "key long, count long, word boolean")
    counts = stored(counts.groupBy("word", "key").agg(F.sum("count").alias("count")), "counts")
    rows = counts.filter("NOT word").orderBy(F.desc("count"), "key").limit(FREQUENT).toArrow()
    shingle, count = np.asarray(rows["key"]).view(np.uint64), np.asarray(rows["count"])
    order = np.argsort(shingle)
    rows = counts.filter("word").toArrow()
    slots = np.zeros(WORD_SLOTS)
    slots[np.asarray(rows["key"])] = np.asarray(rows["count"])
    return shingle[order], count[order], slots


def choose_matches(counts, needed: int, size: int) -> int:
    """The ``l`` of least estimated cost: postings read, and candidates with ``l`` matches verified.

    ``counts``: how often the document's shingles occur, in order. At most one candidate per ``l`` postings of
    other documents can have ``l`` matches.
    """
    best, least = 1, None
    for matches in range(1, min(MOST_MATCHES, needed) + 1):
        prefix = counts[: size - needed + matches]
        others = float(prefix.sum() - len(prefix))
        cost = len(prefix) + others + VERIFY_COST * others / matches
        if least is None or cost < least:
            best, least = matches, cost
    return best


SIGNATURE = "doc_id long, n long, k1 long, k2 long, l int, rare array<long>, often array<long>, bits binary"


def signatures(docs: DataFrame, join: Join) -> DataFrame:
    """Set size, 128-bit set key, prefix and bitmap of each document; of the prefix, the shingles known to be frequent apart."""
    frequent, counts, slots = statistics(docs, join)
    total = max(slots.sum(), 1.0)
    # Of a window's words, the logarithms of their shares; a window of words that come independently is met exp(sum) * total times.
    known = docs.sparkSession.sparkContext.broadcast((frequent, counts, np.log(np.maximum(slots, 1.0) / total), total, float(counts.min(initial=LOCAL))))

    def signed(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        frequent, counts, weights, total, least = known.value
        for rows, texts in text_blocks(batches):
            made = []
            for s, weight in weighed_shingles(*words(texts, True), join.words, weights):
                n = len(s)
                if not n:
                    made.append((0, 0, 0, 0, [], [], b""))
                    continue
                key = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                often = np.zeros(n, bool)
                occurs = 1.0 + np.minimum(np.exp(weight) * total, least)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    often = frequent[at] == s
                    occurs[often] = 1.0 + counts[at[often]] + least
                order = np.argsort(occurs, kind="stable")
                needed = -(-join.percent * n // 100)
                matches = choose_matches(occurs[order], needed, n)
                prefix = order[: n - needed + matches]
                rare, often = (s[prefix[often[prefix] == x]].view(np.int64) for x in (False, True))
                width = min(max(LEAST_BITS, 1 << (n - 1).bit_length()), MOST_BITS)
                flips = np.bincount((mixed(s) % np.uint64(width)).astype(np.int64), minlength=width) % 2
                bits = np.packbits(flips.astype(np.uint8)).tobytes()
                made.append((n, int(key[0]), int(key[1]), matches, rare, often, bits))
            n, k1, k2, matches, rare, often, bits = zip(*made)
            long, longs = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")).cast(long), pa.array(n, long), pa.array(k1, long), pa.array(k2, long),
                 pa.array(matches, pa.int32()), pa.array(rare, longs), pa.array(often, longs), pa.array(bits, pa.binary())],
                ["doc_id", "n", "k1", "k2", "l", "rare", "often", "bits"],
            )

    return docs.select("doc_id", "text").mapInArrow(signed, SIGNATURE)


def long_enough(join: Join, n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= join.percent * F.greatest(n, m)


def folded(bits, width: int):
    """Rows of bitmaps, as 64-bit words, brought down to ``width`` bytes; halves of a bitmap add up without carry."""
    while bits.shape[1] * 8 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def room_for_overlap(apart, total, percent: int):
    """Whether sets of ``total`` elements in sum can be similar enough: bitmaps are ``apart`` by no more than the sets."""
    return 200 * ((total - apart) // 2) >= percent * (total + apart)


def star_candidates(pairs: DataFrame, join: Join) -> DataFrame:
    """The ``pairs`` (a, b, a_n, b_n, a_l, b_l, a_tokens, b_tokens, a_bits, b_bits) that pass the bounds."""
    percent = join.percent

    def check(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns[2:]))
            keep = np.zeros(batch.num_rows, bool)
            for i, (n, m, k, l, ours, theirs, x, y) in enumerate(rows):
                width = min(len(x), len(y))
                x, y = (folded(np.frombuffer(z, np.uint64)[None, :], width) for z in (x, y))
                apart = int(np.bitwise_count(x ^ y).sum())
                keep[i] = room_for_overlap(apart, n + m, percent) and len(set(ours) & set(theirs)) >= min(k, l)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], ["a", "b"])

    columns = ["a", "b", *(f"{side}_{c}" for c in ("n", "l", "tokens", "bits") for side in "ab")]
    return pairs.filter(long_enough(join, F.col("a_n"), F.col("b_n"))).select(*columns).mapInArrow(check, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """The ``pairs`` (a, b) of documents whose whole sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(whole_sets(docs, stored(ids, "pair-ids"), join), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "a_set", "b_set")

    def check(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = join.linked(overlap, len(x) + len(y) - overlap)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def whole_sets(docs: DataFrame, ids: DataFrame, join: Join) -> DataFrame:
    """The sets of the documents ``ids``, as sorted 64-bit numbers packed into bytes."""

    def packed(batches):
        import pyarrow as pa

        for rows, texts in text_blocks(batches):
            made = pa.array([s.tobytes() for s in shingles(texts, join.words)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("id")), made], ["id", "shingles"])

    wanted, _ = split_by_ids(docs.select(F.col("doc_id").alias("id"), "text"), "id", ids)
    wanted = wanted.join(ids, "id", "left_semi")
    return wanted.mapInArrow(packed, "id long, shingles binary")


def candidates_in_blocks(rows: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) within a shingle's block that pass all bounds, each from its first common shingle only.

    ``rows``: token, side (0 or 1), half, id, component, n, l, tokens, bits; half tells the two sides of a block of two apart,
    of which only pairs across are looked at, as each side by itself is another block.
    """
    percent = join.percent

    def pairs_of(batches):
        import numpy as np
        import pyarrow as pa

        def blocks():
            """Lists of rows of one block, as they come sorted."""
            key, held = None, []
            for batch in batches:
                for row in zip(*(column.to_pylist() for column in batch.columns)):
                    if row[:3] != key:
                        if len(held) > 1:
                            yield key, held
                        key, held = row[:3], []
                    held.append(row[3:])
            if len(held) > 1:
                yield key, held

        found = []
        for (token, i, j), rows in blocks():
            half, ids, comps, n, l, tokens, bits = zip(*rows)
            half, ids, comps, n = np.array(half), np.array(ids), np.array(comps), np.array(n)
            width = np.array([len(b) for b in bits])
            # Bitmaps by width: those as wide or wider, folded to it.
            maps = {}
            for w in np.unique(width).tolist():
                maps[w] = np.zeros((len(ids), w // 8), np.uint64)
                for v in np.unique(width[width >= w]).tolist():
                    at = np.flatnonzero(width == v)
                    maps[w][at] = folded(np.frombuffer(b"".join(bits[k] for k in at), np.uint64).reshape(len(at), -1), w)
            sets = [frozenset(t) for t in tokens]
            for x in range(len(ids)):
                ok = (comps != comps[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
                ok &= (half > half[x]) if i != j else (np.arange(len(ids)) > x)
                near = np.flatnonzero(ok)
                if not len(near):
                    continue
                common_width = np.minimum(width[near], width[x])
                apart = np.empty(len(near), np.int64)
                for w in np.unique(common_width).tolist():
                    at = common_width == w
                    apart[at] = np.bitwise_count(maps[w][near[at]] ^ maps[w][x]).sum(axis=1, dtype=np.int64)
                for y in near[room_for_overlap(apart, n[near] + n[x], percent)].tolist():
                    common = sets[x] & sets[y]
                    if len(common) >= min(l[x], l[y]) and token == min(common):
                        found.append((int(ids[x]), int(ids[y])))
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    key = ("token", "i", "j")
    ordered = rows.select(*key, "half", "id", "component", "n", "l", "tokens", "bits").repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(pairs_of, "a long, b long")


def similar_documents(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs`` (``doc_id, text``)."""
    signed = stored(signatures(docs, join), "signatures")
    worded = signed.filter("n > 0 AND doc_id IS NOT NULL")
    key = ["n", "k1", "k2"]
    classes = worded.groupBy(*key).agg(F.min("doc_id").alias("first"))
    member = stored(worded.select("doc_id", *key).join(classes, key).select("doc_id", "first").distinct(), "members")

    # Prefix shingles that several documents offer. The frequent ones are known to be; the others come in small
    # groups, in which a document stays if the next shorter or longer one of the group may be similar to it.
    def offered_of(kind):
        return worded.select(F.col("doc_id").alias("id"), "n", F.explode(kind).alias("token"))

    by_length = Window.partitionBy("token").orderBy("n", "id")
    # A document at either end of its group stands beside none, which is as if beside one of no shingles.
    shorter, longer = (F.coalesce(place("n").over(by_length), F.lit(0)) for place in (F.lag, F.lead))
    beside = long_enough(join, F.col("n"), shorter) | long_enough(join, F.col("n"), longer)
    several = offered_of("rare").withColumn("beside", beside).filter("beside").select("id", "n", "token")
    repeated = stored(several.unionByName(offered_of("often")), "repeated-shingles")
    firsts = member.filter("doc_id = first").select(F.col("doc_id").alias("id"))
    offered = repeated.join(firsts, "id", "left_semi").groupBy("id", "token").agg(F.min("n").alias("n"), F.max("n").alias("most"))
    shared = offered.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("id", "n", "most")).alias("pivot")).filter("size > 1")
    postings = stored(offered.join(shared, "token"), "postings")
    about = postings.groupBy("id").agg(F.collect_set("token").alias("tokens"))
    about = about.join(worded.select(F.col("doc_id").alias("id"), "n", "l", "bits").dropDuplicates(["id"]), "id")
    about = stored(about, "candidates")

    # Each shingle's documents against the first of them.
    # An id of several texts has several lengths.
    may = long_enough(join, F.col("n"), F.col("pivot.n")) | (F.col("n") < F.col("most")) | (F.col("pivot.n") < F.col("pivot.most"))
    star = postings.filter(may & (F.col("id") != F.col("pivot.id"))).select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct()
    a, b = (about.select(*[F.col(c).alias(f"{side}_{c}") for c in about.columns]) for side in "ab")
    star = star.join(b, F.col("b") == F.col("b_id")).join(a, F.col("a") == F.col("a_id"))
    star = stored(star_candidates(star, join), "star-pairs")
    joined = member.filter("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    links = stored(verified(docs, star, join), "star-links")
    groups = stored(components(links), "star-components")

    # What is not joined yet, in blocks.
    left = postings.filter("id <> pivot.id AND size > 2").select("id", "token", "size").join(groups, "id", "left")
    left = left.withColumn("component", F.coalesce("component", "id"))
    mixed = left.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    parts = F.ceil(F.col("size") / BLOCK)
    chunk = F.pmod(F.xxhash64("id"), parts)
    blocks = left.join(mixed.select("token"), "token", "left_semi").withColumn("half", chunk)
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    blocks = blocks.select("token", F.least("half", "other").alias("i"), F.greatest("half", "other").alias("j"), "half", "id", "component")
    rest = stored(candidates_in_blocks(blocks.join(about, "id"), join), "block-pairs")
    more = stored(verified(docs, rest, join), "block-links")

    grouped = stored(components(links.unionByName(more).unionByName(joined)), "components")
    result = signed.select("doc_id", F.col("n").alias("n_shingles")).join(grouped, F.col("doc_id") == F.col("id"), "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
