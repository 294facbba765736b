"""Reading input tables and keeping intermediate tables where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a folder of its own, as in tests;
    on a cluster that would not be shared, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="ledgerloom-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage cut, size known, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_blocks(batches, columns=("text",), max_bytes=1 << 20):
    """Arrow record batches cut into lists of rows holding about ``max_bytes`` of text each.

    Yields ``(rows, texts)``: the columns as a table slice and the texts as bytes (null: empty).
    A row whose text alone is longer makes a block of its own.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(batch.schema.get_field_index(columns[0])).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > max_bytes:
                yield batch.slice(start, i - start), [x or b"" for x in text.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += size
        yield batch.slice(start), [x or b"" for x in text.slice(start).to_pylist()]


#: Slots of the filter below: a sketch of 1 MB at most, whatever the size of the data.
SLOTS = 1 << 23


def split_by_ids(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` may be among ``ids``, and rows whose key surely is not.

    ``ids`` has a column of that name. Its hashes are put into a bitmap of fixed size, which is
    broadcast, so that wide rows need no shuffle to learn that nothing happens to them. Where ``ids`` fill the bitmap,
    more rows may be among them; no row that is goes amiss.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)) + 1
    marked = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("__bucket"))
    sketch = stored(marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits")), "sketch")
    place = F.bitmap_bit_position(slot)
    octet = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.floor(octet / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))
    tested = df.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(sketch), "__bucket", "left")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return tested.filter(found).select(*columns), tested.filter(~found).select(*columns)
