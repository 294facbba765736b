"""Removal of repeated substrings: bytes covered by a string of ``length`` bytes that also begins anywhere else.

The corpus is dealt so that equal strings meet, whatever documents they lie in. In each stretch of
``length`` bytes one window of ``anchor`` bytes is chosen by the smallest hash, the leftmost among
equals; equal stretches choose equal windows. Stretches next to each other mostly choose the same one, and the bytes they
cover are a fragment. Only fragments whose anchor occurs again can hold anything repeated; equal ones among
them are kept once, with the number of copies as weight. Anchors are dealt into shards of bounded
size, and each shard's suffixes are ordered, transformed and expanded to the threshold (see
:mod:`ledgerloom.llm.suffixes`). What is found is carried back to all copies of a fragment.

An anchor whose distinct fragments do not fit a shard is compared by hashes of single stretches,
which needs no task to hold it; nothing is left out.

Matches never cross documents. Defined results: a null text is empty; texts shorter than ``length`` keep all; rows are known
by id and text, so rows repeated whole remove each other's stretches and a null id is as good as any; an empty
table gives an empty table; further columns are ignored. Texts of any length are read in pieces of
bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.hashing import MIX, inverse_powers, joined, mixed, powers
from ledgerloom.llm.shared import split_by_ids, stored, text_blocks
from ledgerloom.llm.suffixes import repeated_starts

LENGTH, ANCHOR = 400, 200
SHARD_BYTES = 1_500_000
PIECE = 1 << 20

# Inverse powers of the hash's base, kept from block to block of a task.
_inverse = [()]

FRAGMENT = "anchor long, fragment long, uid long, first long, size int, step int, times int"


def cut_fragments(data, starts, length: int, anchor: int):
    """Fragments of the texts joined in ``data`` (see :func:`ledgerloom.llm.hashing.joined`).

    Arrays: anchor hash, first byte and end of each fragment, the distance at which it comes again, and how often it comes
    one after another; in a text that repeats a short piece over and over, that is most of it.
    """
    import numpy as np

    empty = np.empty(0, np.int64)
    n = len(data)
    if n < length:
        return empty.view(np.uint64), empty, empty, empty, empty
    with np.errstate(over="ignore"):
        if len(_inverse[0]) < n:
            _inverse[0] = inverse_powers(n)
        inverse = _inverse[0]
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        windows = sums[anchor:] - sums[: n - anchor + 1]
        windows *= inverse[: n - anchor + 1]
    windows = mixed(windows ^ np.uint64(MIX[0]))
    bits = np.uint64(n.bit_length())
    least = (windows >> bits << bits) | np.arange(len(windows), dtype=np.uint64)
    width, reach = length - anchor + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # A stretch must end within its text, before the line feed that follows.
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
        at[max(start, stop - length) : stop] = -1
    edges = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
    lasts = np.append(edges[1:], len(at)) - 1
    real = at[edges] >= 0
    edges, lasts = edges[real], lasts[real]
    keys, ends = windows[at[edges]], lasts + length
    with np.errstate(over="ignore"):
        whole = (sums[ends] - sums[edges]) * inverse[edges]
    # A fragment that is like the one before, in bytes and in distance, belongs to its run.
    text = np.searchsorted(starts, edges, "right")
    steps = np.diff(edges, append=0)
    like = np.zeros(len(edges), bool)
    like[1:] = (keys[1:] == keys[:-1]) & (whole[1:] == whole[:-1]) & (np.diff(ends - edges) == 0) & (np.diff(text) == 0)
    like[2:] &= ~like[1:-1] | (steps[1:-1] == steps[:-2])
    head = np.flatnonzero(~like)
    times = np.diff(np.append(head, len(edges)))
    return keys[head], edges[head], ends[head], np.where(times > 1, steps[head], 0), times


def pieces_of(uids, texts, length: int):
    """Blocks ``(uids, texts, offsets)``; a long text is cut into pieces that overlap by all but one byte of a stretch."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        for offset in range(0, len(texts[0]) - length + 1, PIECE):
            yield uids, [texts[0][offset : offset + PIECE + length - 1]], [offset]
    else:
        yield uids, texts, [0] * len(texts)


def fragments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """The fragments of all documents (``uid``, ``text``)."""

    def cut(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        for rows, block in text_blocks(batches):
            for uids, texts, offsets in pieces_of(rows.column(rows.schema.get_field_index("uid")).to_pylist(), block, length):
                data, starts = joined(texts)
                keys, firsts, ends, steps, times = cut_fragments(data, starts, length, anchor)
                doc = np.searchsorted(starts, firsts, "right") - 1
                raw = data.tobytes()
                hashes = b"".join(blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(firsts.tolist(), ends.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.array(uids)[doc]),
                     pa.array(firsts - starts[doc] + np.array(offsets)[doc]), pa.array((ends - firsts).astype(np.int32)),
                     pa.array(steps.astype(np.int32)), pa.array(times.astype(np.int32))],
                    ["anchor", "fragment", "uid", "first", "size", "step", "times"],
                )

    return docs.select("uid", "text").mapInArrow(cut, FRAGMENT)


def runs(places, length: int):
    """Starts and ends of the bytes covered by stretches that begin at the sorted ``places``."""
    import numpy as np

    cut = np.flatnonzero(np.diff(places) > length)
    starts, ends = places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)] + length
    return starts.astype(np.int32), ends.astype(np.int32)


COVERED = "anchor long, fragment long, starts array<int>, ends array<int>"


def covered_in_shards(held: DataFrame, length: int) -> DataFrame:
    """What is repeated within each ``shard`` of ``anchor, fragment, copies, bytes``."""

    def expand(table):
        import pyarrow as pa

        strings, copies = table.column("bytes").to_pylist(), table.column("copies").to_pylist()
        found = [
            (a, f, *runs(places, length))
            for a, f, places in zip(
                table.column("anchor").to_pylist(), table.column("fragment").to_pylist(), repeated_starts(strings, copies, length)
            )
            if len(places)
        ]
        columns = list(zip(*found)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "fragment", "starts", "ends"])

    return held.groupBy("shard").applyInArrow(expand, COVERED)


def covered_by_hash(held: DataFrame, length: int, anchor: int) -> DataFrame:
    """What is repeated among the fragments of each anchor, by 128-bit hashes of single stretches."""

    def stretches(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for key, fragment, copies, raw in zip(*(batch.column(c).to_pylist() for c in range(4))):
                count = len(raw) - length + 1
                hashes = b"".join(blake2b(raw[i : i + length], digest_size=16).digest() for i in range(count))
                pair = np.frombuffer(hashes, np.int64).reshape(-1, 2)
                same = [pa.array(np.full(count, x)) for x in (key, fragment, copies)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.arange(count, dtype=np.int32))],
                    ["anchor", "fragment", "copies", "h1", "h2", "at"],
                )

    schema = "anchor long, fragment long, copies long, h1 long, h2 long, at int"
    all_stretches = held.select("anchor", "fragment", "copies", "bytes").mapInArrow(stretches, schema)
    again = all_stretches.groupBy("h1", "h2").agg(F.sum("copies").alias("times")).filter("times > 1").select("h1", "h2")
    places = all_stretches.join(again, ["h1", "h2"]).groupBy("anchor", "fragment").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    return places.withColumn("ends", F.transform("starts", lambda x: x + length))


def repeated_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of each row of ``docs`` (``doc_id, text``).

    ``spans``: the removed runs of bytes as (start, end), maximal and in order; ``kept``: the other bytes.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text")
    everything = stored(fragments(docs.filter(F.octet_length("text") >= length), length, anchor), "fragments")
    again = everything.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    live = stored(everything.join(again, "anchor"), "live-fragments")
    where = F.struct("uid", "first", "size")
    distinct = live.groupBy("anchor", "fragment").agg(F.sum("times").alias("copies"), F.min(where).alias("at"))
    distinct = stored(distinct.select("anchor", "fragment", "copies", "at.*"), "distinct-fragments")

    weight = distinct.groupBy("anchor").agg(F.sum("size").alias("bytes"))
    total = weight.agg(F.sum(F.when(F.col("bytes") <= SHARD_BYTES, F.col("bytes")))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    large = weight.filter(F.col("bytes") > SHARD_BYTES).select("anchor", F.lit(True).alias("large"))

    wanted = distinct.groupBy("uid").agg(F.collect_list(F.struct("anchor", "fragment", "copies", "first", "size")).alias("wanted"))

    def fetch(batches):
        import pyarrow as pa

        for batch in batches:
            for text, want in zip(batch.column(0), batch.column(1)):
                text, want = text.as_py(), want.as_py()
                columns = [[w[c] for w in want] for c in ("anchor", "fragment", "copies")]
                columns.append([text[w["first"] : w["first"] + w["size"]] for w in want])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["anchor", "fragment", "copies", "bytes"],
                )

    holders, _ = split_by_ids(docs, "uid", distinct)
    held = holders.join(wanted, "uid").select("text", "wanted").mapInArrow(fetch, "anchor long, fragment long, copies long, bytes binary")
    held = held.dropDuplicates(["anchor", "fragment"]).join(large, "anchor", "left")
    held = stored(held.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))), "held-fragments")
    small = covered_in_shards(held.filter("large IS NULL").drop("large"), length)
    covered = stored(small.unionByName(covered_by_hash(held.filter("large"), length, anchor)), "covered")

    spans = live.join(covered, ["anchor", "fragment"]).select("uid", F.struct("first", "step", "times", "starts", "ends").alias("run"))
    spans = stored(spans.distinct().groupBy("uid").agg(F.collect_list("run").alias("runs")), "spans")

    def remove(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for rows, texts in text_blocks(batches):
            found = rows.column(rows.schema.get_field_index("runs")).to_pylist()
            spans, kept = [], []
            for text, runs_of in zip(texts, found):
                pairs = sorted(
                    (at + a, at + b)
                    for r in runs_of or ()
                    for at in range(r["first"], r["first"] + r["times"] * max(r["step"], 1), max(r["step"], 1))
                    for a, b in zip(r["starts"], r["ends"])
                )
                merged: list[list[int]] = []
                for a, b in pairs:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                places = [0, *(x for pair in merged for x in pair), len(text)]
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(text[a:b] for a, b in zip(places[::2], places[1::2])) if merged else text)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    losing, whole = split_by_ids(docs, "uid", spans)
    read = losing.join(spans, "uid", "left").unionByName(whole.withColumn("runs", F.lit(None).cast(spans.schema["runs"].dataType)))
    return read.select("doc_id", "text", "runs").mapInArrow(remove, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
