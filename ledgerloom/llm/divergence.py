"""Audit of how far the sources of each language diverge in their terms, over a transducer vocabulary.

Terms are runs of ASCII letters, lower-cased, and of all characters beyond ASCII. Texts are read twice. The first
reading counts, per language, in how many documents a term occurs; terms in enough of them are kept. They are sorted
and numbered, and tasks build minimal acyclic transducers of them, of a bounded number of terms each, whose outputs
are lexicographic ordinals. The second reading streams the texts through the transducers, so that what is shuffled and
summed are ordinals and counts, not strings; ordinals then also break ties.

Each group of language and source, and each language, gives each kept term the smoothed probability
``1 + floor(1000000000 * (count + 5) / (N + 5 * V))`` in whole numbers. ``pair`` rows rank the other sources of the language by the
sum of absolute differences over all kept terms; ``term`` rows rank the terms that a group has more of than its language.

The driver knows each transducer's size. Those that go to tasks together take ``PART_BYTES`` at most; a larger vocabulary is
gone through in several readings, so no broadcast grows with the data and no term is dropped. Pairs of sources are
compared in tasks of at most 2 x ``SOURCES`` sources by ``TERMS`` terms; their number is that of the result.

Defined results: null text, language and source are empty strings; every row is a document, also a repeated one; a group without kept
terms has count 0 for each; a language without kept terms gives pairs of value 0 and no ``term`` rows; a language of one source
gives no pairs; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.hashing import LOWER, joined, runs
from ledgerloom.llm.shared import stored, text_blocks
from ledgerloom.llm.transducer import Transducer, build

LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a transducer; bytes of transducers sent to tasks at once; text of a block.
SHARD_TERMS, PART_BYTES, BLOCK_BYTES = 1 << 17, 32 << 20, 4 << 20
#: A block of sources, and of terms, compared in one task.
SOURCES, TERMS = 256, 4096

RESULT = "lang string, source string, part string, item string, value long, rank int"

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def terms_of(texts: list[bytes]):
    """Distinct terms of a block (as bytes one after another, and where each begins and ends), each occurrence's term, and its text."""
    data, starts = joined(texts)
    inside = LETTERS[data]
    begins, ends = runs(inside)
    of_text = np.searchsorted(starts, begins, "right") - 1
    letters, offsets = LOWER[data[inside]], np.concatenate([[0], np.cumsum(ends - begins)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), of_text


def counted(keys: np.ndarray, size: int):
    """Distinct ``keys`` below ``size ** 2`` as two numbers each, and how often they occur."""
    found, times = np.unique(keys, return_counts=True)
    return found // size, found % size, times


def document_counts(docs: DataFrame) -> DataFrame:
    """``lang, term, docs``: parts of the number of documents a term occurs in."""

    def count(batches):
        for rows, texts in text_blocks(batches, max_bytes=BLOCK_BYTES):
            distinct, code, of_text = terms_of(texts)
            if not len(code):
                continue
            size = max(len(distinct), 1)
            langs, lang_of = np.unique(np.array(rows.column(1).to_pylist(), object), return_inverse=True)
            texts_with = np.unique(of_text * size + code)
            lang, term, docs = counted(lang_of[texts_with // size] * size + texts_with % size, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs[lang].tolist(), pa.string()), distinct.take(pa.array(term)).cast(pa.binary()), pa.array(docs)], ["lang", "term", "docs"]
            )

    return docs.select("text", "lang").mapInArrow(count, "lang string, term binary, docs long")


def vocabulary(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms ``lang, term, ordinal``, and transducers ``lang, base, terms, data``."""
    kept = document_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = stored(kept.select("lang", "term"), "kept-terms")
    ranges = max(1, -(-kept.count() // SHARD_TERMS))
    ranged = stored(kept.repartitionByRange(ranges, "lang", "term").withColumn("range", F.spark_partition_id()), "ranged-terms")
    place = F.row_number().over(Window.partitionBy("lang", "range").orderBy("term")) - 1
    sizes = sorted((r["lang"], r["range"], r["count"]) for r in ranged.groupBy("lang", "range").count().collect())
    bases, before = [], {}
    for lang, at, count in sizes:
        bases.append((lang, at, before.get(lang, 0)))
        before[lang] = before.get(lang, 0) + count
    base = docs.sparkSession.createDataFrame(bases, "lang string, range int, before long")
    numbered = ranged.withColumn("place", place).join(base, ["lang", "range"]).select("lang", "term", "range", (F.col("place") + F.col("before")).alias("ordinal"), F.floor(F.col("place") / SHARD_TERMS).alias("shard"))
    numbered = stored(numbered, "vocabulary")

    def make(table):
        table = table.sort_by("term")
        made = build(table.column("term").to_pylist())
        first = table.column("ordinal")[0].as_py()
        return pa.table({"lang": table.column("lang")[:1], "base": [first], "size": [made.size], "data": pa.array([made.to_bytes()], pa.binary())})

    made = numbered.groupBy("lang", "range", "shard").applyInArrow(make, "lang string, base long, size long, data binary")
    return numbered.select("lang", "term", "ordinal"), stored(made, "transducers")


def parts(transducers: DataFrame) -> list[list[tuple[str, int]]]:
    """Transducers (by language and base) that go to tasks together."""
    found, held = [], 0
    for row in transducers.select("lang", "base", "size").orderBy("lang", "base").collect():
        if not found or held + row["size"] > PART_BYTES:
            found.append([])
            held = 0
        found[-1].append((row["lang"], row["base"]))
        held += row["size"]
    return found


def recounted(docs: DataFrame, transducers: DataFrame) -> DataFrame:
    """``lang, source, ordinal, count`` of the kept terms that a group has."""
    counts = None
    for part in parts(transducers):
        wanted = docs.sparkSession.createDataFrame(part, "lang string, base long")
        held: dict[str, list] = {}
        for row in transducers.join(wanted, ["lang", "base"]).select("lang", "base", "data").collect():
            held.setdefault(row["lang"], []).append((row["base"], bytes(row["data"])))

        def count(batches, held=held):
            built = {lang: [(base, Transducer.from_bytes(data)) for base, data in of] for lang, of in held.items()}
            for rows, texts in text_blocks(batches, max_bytes=BLOCK_BYTES):
                distinct, code, of_text = terms_of(texts)
                groups: dict[tuple, int] = {}
                group_of = np.array([groups.setdefault(g, len(groups)) for g in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())])
                names, of_word = list(groups), group_of[of_text]
                ends = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
                data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8) if len(distinct) else np.empty(0, np.uint8)
                for lang in {name[0] for name in names} & built.keys():
                    mine = np.array([name[0] == lang for name in names])[of_word]
                    words, place = np.unique(code[mine], return_inverse=True)
                    ordinal = np.full(len(words), -1, np.int64)
                    for base, transducer in built[lang]:
                        found = transducer.ordinals(data, ends[words], ends[words + 1])
                        ordinal = np.where(found >= 0, base + found, ordinal)
                    kept = ordinal >= 0
                    hit, size = kept[place], max(len(words), 1)
                    group, word, times = counted(of_word[mine][hit] * size + place[hit], size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(word), pa.string()), pa.array([names[g][1] for g in group], pa.string()), pa.array(ordinal[word]), pa.array(times)],
                        ["lang", "source", "ordinal", "count"],
                    )

        found = docs.mapInArrow(count, "lang string, source string, ordinal long, count long")
        counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        return docs.sparkSession.createDataFrame([], "lang string, source string, ordinal long, count long")
    return counts.groupBy("lang", "source", "ordinal").agg(F.sum("count").alias("count"))


def probability(count: str, total: str, terms: str):
    """Smoothed and in whole numbers, in decimals so that nothing overflows."""
    return F.expr(
        f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {SMOOTHING} AS DECIMAL(20, 0)))"
        f" div CAST({total} + {SMOOTHING} * {terms} AS DECIMAL(20, 0))"
    )


def group_totals(docs: DataFrame, counts: DataFrame, terms: DataFrame) -> DataFrame:
    """Every group ``lang, source`` with its number ``sid`` among the language's, its ``total``, and the language's ``terms``, ``sources``."""
    of_lang = Window.partitionBy("lang")
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    return groups.select(
        "lang",
        "source",
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("sid"),
        F.count("*").over(of_lang).alias("sources"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("terms", F.lit(0)).alias("terms"),
    )


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for the pairs ``a < b`` of source numbers of each language."""

    def dealt(df, terms_from):
        own = F.floor(F.col("sid") / SOURCES)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / SOURCES)))
        spread = df.withColumn("terms_from", terms_from).withColumn("other", other)
        return spread.withColumns({"low": F.least(own, "other"), "high": F.greatest(own, "other")}).groupBy("lang", "terms_from", "low", "high")

    cells = counts.join(groups.filter("terms > 0"), ["lang", "source"])
    cells = cells.select("lang", "sid", "sources", "ordinal", probability("count", "total", "terms").alias("p"))
    base = F.when(F.col("terms") > 0, F.expr(f"1 + {SCALE * SMOOTHING}L div (total + {SMOOTHING} * terms)")).otherwise(0)
    wholes = groups.select(*[F.col(c).alias(c) for c in ("lang", "sid", "sources", "terms")], base.alias("p0"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("terms") - 1, F.lit(0)) / TERMS)))

    def compare(cells, wholes):
        order = np.argsort(sid := np.asarray(wholes.column("sid")))
        sid, p0 = sid[order], np.asarray(wholes.column("p0"))[order]
        first = wholes.column("terms_from")[0].as_py() * TERMS
        width = min(TERMS, wholes.column("terms")[0].as_py() - first)
        p = np.repeat(p0[:, None], width, axis=1)
        if cells.num_rows:
            p[np.searchsorted(sid, np.asarray(cells.column("sid"))), np.asarray(cells.column("ordinal")) - first] = np.asarray(cells.column("p"))
        low, high = wholes.column("low")[0].as_py(), wholes.column("high")[0].as_py()
        found = []
        for i in np.flatnonzero(sid // SOURCES == low):
            js = np.flatnonzero((sid // SOURCES == high) & (sid > sid[i]))
            found.append((np.full(len(js), sid[i]), sid[js], np.abs(p[js] - p[i]).sum(axis=1)))
        a, b, value = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.empty(0, np.int64),) * 3
        lang = pa.array([wholes.column("lang")[0].as_py()] * len(a), pa.string())
        return pa.table({"lang": lang, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})

    left = dealt(cells, F.floor(F.col("ordinal") / TERMS))
    right = dealt(wholes.withColumn("of_terms", blocks), F.col("of_terms"))
    sums = left.cogroup(right).applyInArrow(compare, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def diverging_sources(counts: DataFrame, groups: DataFrame) -> DataFrame:
    sums = stored(pair_sums(counts, groups), "pair-sums")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = both.join(groups.select("lang", F.col("sid").alias("a"), "source"), ["lang", "a"])
    named = named.join(groups.select("lang", F.col("sid").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def diverging_terms(counts: DataFrame, groups: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("count").alias("lang_count"))
    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    q = of_lang.join(lang_totals, "lang")
    rated = counts.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).join(q, ["lang", "ordinal"])
    rated = rated.withColumns({"p": probability("count", "total", "terms"), "q": probability("lang_count", "lang_total", "terms")})
    over = rated.filter("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))
    ranked = over.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for ``docs`` (``text, lang, source``)."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    terms, transducers = vocabulary(docs, least)
    counts = stored(recounted(docs, transducers), "term-counts")
    groups = stored(group_totals(docs, counts, terms), "groups")
    found = diverging_sources(counts, groups).unionByName(diverging_terms(counts, groups, terms, top))
    return found.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
