"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; a document's fractional number of copies is its source's
target over its source's words. Whole copies are taken as they are. The fractions are rounded in
pairs: mass moves at random from one document of a pair to the other, weighed by size so that the
source's words stay what they were, until one of the two is integral and drops out. The odds are
such that every document keeps its expectation.

Documents of a source are dealt into shards by id; each shard rounds its own documents and leaves at
most one fraction. These residuals are combined by further rounds, a fixed number at a time, until
one is left per source: a reduction tree, so no task sees a whole source. The last residual is
rounded by itself, so a source's words differ from its target by less than one document.

Random numbers are hashes of the seed and the ids that meet, so reruns agree, however the rows
lie in files and partitions.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; repeated
rows are rounded each for themselves (copies of one row share a shard); a source without words has target 0; an empty table gives an
empty table; further columns are kept, except that columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SHARD_ROWS, FAN_IN = 4096, 256

RESULTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (
        F.size(parts)
        - F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    ).cast("long")


def ordered_sources(sizes: DataFrame) -> DataFrame:
    """One row per source with its place in code-point order, null last.

    Sources are dealt into ranges, numbered within a range, and shifted by the ranges before, of which the
    driver sees one count each.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_source = (F.col("source").isNull().alias("last"), F.col("source"))
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    ranged = stored(
        summed.repartitionByRange(parts, *by_source).withColumn("range", F.spark_partition_id()), "sources"
    )
    before, shifts = 0, []
    for row in ranged.groupBy("range").count().orderBy("range").collect():
        shifts.append((row["range"], before))
        before += row["count"]
    shift = spark.createDataFrame(shifts, "range int, before long")
    within = F.row_number().over(Window.partitionBy("range").orderBy(*by_source)) - 1
    return ranged.withColumn("place", within).join(shift, "range").select(
        "source", "source_size", "source_rows", (F.col("place") + F.col("before")).alias("place")
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Each source's words, rows and target.

    ``share`` of all words goes to the sources by weight; no target is over ``most`` times its
    source's words, and what is above goes to the others by weight, until none is above.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = stored(
        ordered_sources(sizes).withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))),
        "ordered-sources",
    )
    cap, weight = most * F.col("source_size"), F.col("weight")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, count = 0.0, -1
    while True:
        # Words a unit of weight gets if the sources above the former level are held at their cap.
        above = weight * level > cap
        held, free, capped = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(weight)),
            F.sum(F.when(above, 1).otherwise(0)),
        ).first()
        if not free or capped == count:
            break
        level, count = max(0.0, total - held) / free, capped
    target = F.when(weight * level > cap, cap).otherwise(weight * level)
    return sources.select("source", "source_size", "source_rows", target.alias("target"))


def draw(*parts) -> float:
    """A number in [0, 1) that depends on ``parts`` alone."""
    digest = hashlib.blake2b(repr(parts).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def round_pairs(rows, seed: int):
    """Pivotal rounding of ``rows`` (key, size, fraction), sizes positive, in the order given.

    Returns ``{key: 0 or 1}`` for the rounded rows, and the row left with a fraction, or None.
    """
    rounded, left = {}, None
    for row in rows:
        if left is None:
            left = row
            continue
        (a, a_size, p), (b, b_size, q) = left, row
        # Words that can move from b to a, and from a to b, until one of the two is integral.
        to_a = min((1 - p) * a_size, q * b_size)
        to_b = min(p * a_size, (1 - q) * b_size)
        moved = to_a if draw(seed, a, b) * (to_a + to_b) < to_b else -to_b
        p, q = p + moved / a_size, q - moved / b_size
        left = None
        for key, size, x in ((a, a_size, p), (b, b_size, q)):
            if min(x, 1 - x) < 1e-9:
                rounded[key] = round(x)
            else:
                left = (key, size, x)
    return rounded, left


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: int = 0, size: Column | None = None) -> DataFrame:
    """``docs`` with the size of each document, its source's words and target, its copies and words taken."""
    import pyarrow as pa

    sized = docs.drop(*RESULTS).withColumn("size", word_count(F.col("text")) if size is None else size)
    columns = sized.columns
    targets = stored(source_targets(sized.select("source", "size"), weights, share, most), "targets")
    sized, by = sized.alias("d"), targets.alias("t")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(by, F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.*", "t.source_size", "t.target", F.floor(rate).cast("long").alias("copies"), (rate - F.floor(rate)).alias("__part"),
        F.pmod(F.xxhash64("d.doc_id"), F.ceil(F.col("t.source_rows") / SHARD_ROWS)).alias("__shard"),
    )

    def shard(table):
        """Rounds a shard in order of size, so that pairs are alike."""
        import numpy as np

        sizes, parts, ids = (table.column(c).to_pylist() for c in ("size", "__part", "doc_id"))
        order = sorted(
            (i for i in range(len(sizes)) if sizes[i] > 0 and parts[i] > 0),
            key=lambda i: (sizes[i], ids[i] is not None, ids[i] or 0),
        )
        rounded, left = round_pairs([((ids[i], i_of_id), sizes[i], parts[i]) for i_of_id, i in enumerate(order)], seed)
        extra = np.zeros(len(sizes), np.int64)
        for (_, place), copy in rounded.items():
            extra[order[place]] = copy
        pending = np.full(len(sizes), np.nan)
        if left:
            pending[order[left[0][1]]] = left[2]
        copies = pa.array(np.asarray(table.column("copies")) + extra)
        table = table.set_column(table.schema.get_field_index("copies"), "copies", copies)
        return table.append_column("__pending", pa.array(pending))

    schema = T.StructType([*joined.schema.fields, T.StructField("__pending", T.DoubleType())])
    rounded = stored(joined.groupBy("source", "__shard").applyInArrow(shard, schema), "rounded")
    pending = ~F.isnan("__pending")
    residuals = rounded.filter(pending).select(
        "source", "__shard", F.col("__shard").alias("node"), F.col("size").cast("double").alias("size"), F.col("__pending").alias("part"),
        F.lit(None).cast("long").alias("copy"),
    )

    def combine(group):
        key = [("residual", int(n)) for n in group["__shard"]]
        done, left = round_pairs(list(zip(key, group["size"], group["part"])), seed)
        group["copy"] = [done.get(k) for k in key]
        group["copy"] = group["copy"].astype("Int64")
        if left:
            group["part"] = [left[2] if k == left[0] else p for k, p in zip(key, group["part"])]
        return group

    settled, nodes = None, targets.agg(F.max(F.ceil(F.col("source_rows") / SHARD_ROWS))).first()[0] or 0
    while nodes > 1:
        level = residuals.withColumn("node", F.floor(F.col("node") / FAN_IN))
        level = level.repartition("source", "node").sortWithinPartitions("__shard")
        level = stored(level.groupBy("source", "node").applyInPandas(lambda g: combine(g.sort_values("__shard")), level.schema), "residuals")
        done = level.filter("copy IS NOT NULL")
        settled = done if settled is None else settled.unionByName(done)
        residuals, nodes = level.filter("copy IS NULL"), -(-nodes // FAN_IN)
    # The last residual of a source stands by itself.
    last = F.pmod(F.xxhash64(F.lit(seed), "source", "__shard"), F.lit(1 << 30)) / float(1 << 30) < F.col("part")
    residuals = residuals.withColumn("copy", F.when(last, 1).otherwise(0).cast("long"))
    settled = residuals if settled is None else settled.unionByName(residuals)
    settled = settled.select(F.col("source").alias("__of"), F.col("__shard").alias("__leaf"), "copy")
    match = pending & F.col("source").eqNullSafe(F.col("__of")) & (F.col("__shard") == F.col("__leaf"))
    copies = F.col("copies") + F.coalesce(F.col("copy"), F.lit(0))
    return rounded.join(settled, match, "left").select(
        *[F.col(f"`{c}`") for c in columns], "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: int = 0) -> DataFrame:
    """``docs`` (``doc_id, text, source``) with ``copies``, how often the mix takes each row.

    Mixed are the rows' ids, sources, sizes and two hashes of their texts; texts move once, to meet their copies. Rows
    equal in all of these share their copies as evenly as whole numbers allow.
    """
    hashes = F.xxhash64("text").alias("__h1"), F.xxhash64(F.lit(1), "text").alias("__h2")
    key = ["doc_id", "source", "__h1", "__h2"]
    docs = docs.drop("copies", "__h1", "__h2")
    brief = docs.select("doc_id", "source", *hashes, word_count(F.col("text")).alias("__words"))
    mixed = mix(brief, weights, share, most, seed, F.col("__words"))
    taken = mixed.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("times"))
    taken = stored(taken.filter("copies > 0"), "copies").select(*[F.col(c).alias(f"of_{c}") for c in key], "copies", "times")
    known = docs.select("*", *hashes)
    match = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = known.join(taken.filter("times = 1"), match).select(*columns, "copies")
    repeated = known.join(taken.filter("times > 1"), match)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*key)) - 1
    share_of = F.floor(F.col("copies") / F.col("times")) + F.when(place < F.col("copies") % F.col("times"), 1).otherwise(0)
    return alone.unionByName(repeated.select(*columns, share_of.cast("long").alias("copies")))
