"""Removal of lines that repeat an earlier line up to one word.

Lines are sequences of words; white space does not count. Equal lines are put together per document and then grouped by
hash, and the earliest, by document id and place, is kept, however short they are. Distinct lines are then joined by deletion neighbourhoods: a line emits, as hashed
keys, itself and every variant without one of its words. Two lines are one word edit apart exactly if

* they give the same variant with the word at the same place removed (one word replaced), or
* one is a variant of the other (one word more).

A variant's lines are held against their earliest only, which has all of them within one edit, so large
groups of variants of one line stay linear. The edit distance of each pair found is verified on the
words, and the later line is removed wherever it stands.

So that not every line of a large corpus emits all its variants, lines first have to share one half
with a line of about their length, as lines one edit apart always do.

Defined results: a null or empty text has no line that can go and stays as it is; lines of fewer than ``least_words`` words are
kept, by default those without a word; those of fewer than ``least_fuzzy`` go only if equal; rows repeated whole (id and text) are one document and are treated alike, other texts of its id are
further documents, in the order of a hash where places are equal; a null id
comes after all others; an empty table gives an empty table; further columns are kept, except that columns named like a result
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.hashing import Lines
from ledgerloom.llm.shared import split_by_ids, stored, text_blocks

RESULTS = ("n_lines", "n_removed", "clean_text")


@dataclass(frozen=True)
class Bounds:
    """Fewest words of a line that can be removed, and of one that can go for a line one word apart.

    In lines of under five words another word is another line: "Yes." and "No." are one word apart.
    """

    least_words: int = 1
    least_fuzzy: int = 5


LINES = "uid long, doc_id long, places array<int>, h1 long, h2 long, size int, halves array<long>"


def hashed_lines(docs: DataFrame, bounds: Bounds) -> DataFrame:
    """The distinct lines of each of ``docs`` (uid, doc_id, text) that can be removed, with their places in order."""

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for rows, texts in text_blocks(batches):
            lines = Lines(texts)
            keep = np.flatnonzero(lines.size >= bounds.least_words)
            h1, h2 = lines.keys()[keep], lines.keys(1)[keep]
            order = np.lexsort((lines.place[keep], h2, h1, lines.of[keep]))
            keep, h1, h2 = keep[order], h1[order], h2[order]
            new = np.ones(len(keep), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (np.diff(lines.of[keep]) != 0)
            places = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(keep)).astype(np.int32)), pa.array(lines.place[keep].astype(np.int32)))
            keep, h1, h2 = keep[new], h1[new], h2[new]
            of = pa.array(lines.of[keep])
            halves = lines.halves()[keep].view(np.int64)
            fuzzy = lines.size[keep] >= bounds.least_fuzzy
            offsets = np.concatenate([[0], np.cumsum(4 * fuzzy)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("uid")).take(of), rows.column(rows.schema.get_field_index("doc_id")).take(of),
                 places, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                 pa.array(lines.size[keep].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(halves[fuzzy].ravel()))],
                ["uid", "doc_id", "places", "h1", "h2", "size", "halves"],
            )

    return docs.select("uid", "doc_id", "text").mapInArrow(hashed, LINES)


def neighbourhoods(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text and variants of the ``wanted`` lines (h1, h2, rank, uid, place), each read where it stands first."""
    places = wanted.groupBy("uid").agg(F.collect_list(F.struct("h1", "h2", "rank", "place")).alias("wanted"))

    def emit(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("rank", RANK_ARROW()), ("line", pa.string()), ("variants", pa.list_(pa.int64()))])
        for rows, texts in text_blocks(batches):
            lines, first = Lines(texts), 0
            made = []
            for text, want in zip(texts, rows.column(rows.schema.get_field_index("wanted")).to_pylist()):
                split = text.decode("utf-8", "replace").split("\n")
                for w in want:
                    variants = lines.without_each(first + w["place"]).view(np.int64)
                    made.append({"h1": w["h1"], "h2": w["h2"], "rank": w["rank"], "line": split[w["place"]], "variants": variants})
                first += len(split)
            yield pa.RecordBatch.from_pylist(made, schema)

    holders, _ = split_by_ids(docs, "uid", wanted)
    read = holders.join(places, "uid").select("text", "wanted")
    return read.mapInArrow(emit, f"h1 long, h2 long, rank {RANK}, line string, variants array<long>")


#: Where a line stands: nulls last by the flag, then document, then place.
RANK = "struct<no_id: boolean, doc_id: long, place: int>"


def RANK_ARROW():
    import pyarrow as pa

    return pa.struct([("no_id", pa.bool_()), ("doc_id", pa.int64()), ("place", pa.int32())])


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two sequences of words are at most one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``h1`` and ``h2`` of the distinct lines that are one word edit from an earlier one."""
    # This filter may let a line of the same h1 through; from here on lines go by both hashes.
    keyed = distinct.select("h1", F.explode("halves").alias("half")).distinct()
    again = keyed.groupBy("half").agg(F.count("*").alias("lines")).filter("lines > 1").select("half")
    wanted = keyed.join(again, "half").select("h1").distinct()
    wanted = stored(distinct.join(wanted, "h1").select("h1", "h2", "rank", "uid", "place"), "near-candidates")
    lines = stored(neighbourhoods(docs, wanted), "neighbourhoods")
    lines = lines.dropDuplicates(["h1", "h2"])

    key = F.struct("h1", "h2")
    me = F.struct("rank", key.alias("line")).alias("me")
    variants = lines.select(me, F.posexplode("variants").alias("at", "variant"))
    wholes = lines.select(F.col("h1").alias("variant"), me)

    def earliest(df, *by):
        return df.groupBy(*by).agg(F.min("me").alias("first"))

    # One word replaced; one word less than an earlier line; one word more.
    replaced = variants.join(earliest(variants, "variant", "at"), ["variant", "at"])
    shorter = wholes.join(earliest(variants, "variant"), "variant")
    longer = variants.join(wholes.select("variant", F.col("me").alias("first")), "variant")
    pairs = replaced.select("me", "first").unionByName(shorter.select("me", "first")).unionByName(longer.select("me", "first"))
    pairs = pairs.filter("first < me").groupBy("me").agg(F.min("first").alias("first"))
    pairs = pairs.select(F.col("me.line").alias("a"), F.col("first.line").alias("b"))
    text = lines.select(key, "line")
    both = pairs.join(text.toDF("a", "a_line"), "a").join(text.toDF("b", "b_line"), "b").select("a", "a_line", "b_line")

    def check(batches):
        import re

        import pyarrow as pa

        words = re.compile("[^\x20\x09-\x0d]+").findall
        for batch in batches:
            keep = [one_edit(words(x), words(y)) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], ["a"])

    return both.mapInArrow(check, "a struct<h1: long, h2: long>").select("a.*")


def dedup_lines(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with the text left, and how many lines it had and lost."""
    docs = docs.drop(*RESULTS)
    # Under names of their own: columns of the caller may be called uid or gone.
    known = docs.withColumn("__uid", F.xxhash64("doc_id", "text"))
    brief = known.select(F.col("__uid").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    lines = stored(hashed_lines(brief, bounds), "lines")

    def rank(place):
        return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", place.alias("place"))

    line = F.struct(rank(F.get("places", F.lit(0))).alias("rank"), "uid", "size", "halves")
    distinct = lines.groupBy("h1", "h2").agg(F.min(line).alias("first"), F.sum(F.size("places")).alias("times"))
    distinct = stored(distinct.select("h1", "h2", "times", "first.*", F.col("first.rank.place").alias("place")), "distinct-lines")
    fuzzy = distinct.filter(F.size("halves") > 0)
    near = stored(near_lines(brief, fuzzy), "near-lines").withColumn("near", F.lit(True))

    affected = distinct.join(near, ["h1", "h2"], "left").filter("times > 1 OR near").select("h1", "h2", F.struct("rank", "uid").alias("first"), "near")
    later = F.filter("places", lambda p: F.coalesce("near", F.lit(False)) | (F.struct(rank(p).alias("rank"), "uid") > F.col("first")))
    gone = lines.join(affected, ["h1", "h2"]).select("uid", later.alias("gone")).filter(F.size("gone") > 0)
    gone = stored(gone.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "lines-gone")

    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("clean_text", T.StringType())])

    def remove(batches):
        import pyarrow as pa

        for rows, texts in text_blocks(batches):
            null = rows.column(rows.schema.get_field_index("text")).is_null().to_pylist()
            made = []
            for text, lost, is_null in zip(texts, rows.column(rows.schema.get_field_index("__gone")).to_pylist(), null):
                split, lost = text.decode("utf-8", "replace").split("\n"), set(lost or ())
                left = "\n".join(x for i, x in enumerate(split) if i not in lost) if lost else "\n".join(split)
                made.append((0, 0, None) if is_null else (len(split), len(lost), left))
            results = [pa.array(c, k) for c, k in zip(zip(*made), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in columns), *results], [*columns, *RESULTS])

    gone = gone.select(F.col("uid").alias("__uid"), F.col("gone").alias("__gone"))
    losing, whole = split_by_ids(known, "__uid", gone)
    read = losing.join(gone, "__uid", "left").unionByName(whole.withColumn("__gone", F.lit(None).cast("array<int>")))
    return read.select(*[F.col(f"`{c}`") for c in columns], "__gone").mapInArrow(remove, schema)
