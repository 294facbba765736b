"""Web archives by way of a chunked record table: payloads as rows of record and chunk number, never whole.

``chunked`` cuts each payload into chunks as views of the batch it came in. Every chunk carries the length and the
digests of the payload up to its end, kept up incrementally, so the last chunk has those of the whole. Of records with
equal payloads (equal in length, SHA-1 and SHA-256), one becomes the response and the others revisit it.

``write_archives`` writes each chunk as a WARC/1.1 record: the first of a payload as ``response`` with its HTTP head, further
ones as ``continuation`` segments, revisits without a payload. ``read_archives`` streams the files
back into a chunked table, holding one chunk at a time; ``records`` computes the digests anew. Payloads in one
chunk are digested where they are read. The chunks of longer ones are brought together by record and streamed in
order, one hash state at a time.

Files are written and read by Spark's text source, with the blank lines that end a WARC record's parts as its separator, so
they can be in any store, tasks that are lost are repeated, and compression keeps files whole.

Defined results: a null payload is empty; empty payloads are equal; a null id is below all others; of rows with the largest id and equal
payloads one is the response (repeated rows are told apart by their place in the chunked table); a null target is left out and
control characters in it are percent-encoded; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import shared_folder, split_by_ids, stored

#: Bytes of a chunk, and of the chunks that leave a task at once.
CHUNK_BYTES, BATCH_BYTES = 1 << 16, 4 << 20
BREAK = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

CHUNKS = "record string, page_id long, target string, chunk long, data binary, bytes_so_far long, sha1 binary, sha256 binary, last boolean"
PARSED = "record string, page_id long, target string, kind string, refers_record string, refers_to long, chunk long, last boolean, data binary, file string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def rows_out(rows: list[tuple], schema: str):
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), arrow[k]) for c, k in zip(columns, kinds)], list(names))


def in_batches(rows, schema: str):
    """Rows ``(bytes held, row)`` as record batches of about ``BATCH_BYTES``."""
    out, held = [], 0
    for size, row in rows:
        out.append(row)
        held += size + 256
        if held > BATCH_BYTES:
            yield rows_out(out, schema)
            out, held = [], 0
    if out:
        yield rows_out(out, schema)


def chunked(pages: DataFrame, payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of ``pages`` (``page_id, url``, the payload)."""

    def pieces(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            payloads = batch.column(2).cast(pa.large_binary())
            for page_id, target, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads):
                record, number = f"{part}-{number}", number + 1
                view = memoryview(whole.as_buffer() if whole.is_valid else b"")
                sha1, sha256 = hashlib.sha1(), hashlib.sha256()
                for chunk, start in enumerate(range(0, max(len(view), 1), chunk_bytes)):
                    data = view[start : start + chunk_bytes]
                    sha1.update(data)
                    sha256.update(data)
                    end = start + len(data)
                    yield len(data), (record, page_id, target, chunk, bytes(data), end, sha1.digest(), sha256.digest(), end == len(view))

    def run(batches):
        return in_batches(pieces(batches), CHUNKS)

    columns = F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")
    return pages.select(*columns, F.col(f"`{payload}`").cast("binary").alias("payload")).mapInArrow(run, CHUNKS)


def revisits(chunks: DataFrame) -> DataFrame:
    """``record, refers_record, refers_to`` of the records that are not the response of their payload."""
    whole = chunks.filter("last").select("record", "page_id", "bytes_so_far", "sha1", "sha256")
    key = ["bytes_so_far", "sha1", "sha256"]
    # Structs compare by their fields in order; a null id is below all.
    of_payload = whole.groupBy(*key).agg(F.max(F.struct("page_id", "record")).alias("response"), F.count("*").alias("times"))
    repeated = stored(of_payload.filter("times > 1"), "repeated-payloads")
    found = whole.join(repeated, key).filter(F.col("record") != F.col("response.record"))
    return found.select("record", F.col("response.record").alias("refers_record"), F.col("response.page_id").alias("refers_to"))


def urn(record: str, page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{record}>"


def of_urn(text: str):
    """Record and page of ``urn``."""
    _, _, page_id, record = text.strip("<>").split(":", 3)
    return record, int(page_id) if page_id else None


def quoted(target: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in target)


def segment(row: dict) -> bytes:
    """A chunk as a WARC record, without the break that ends it."""
    revisit, chunk, alone = row["refers_record"] is not None, row["chunk"], row["last"] and row["chunk"] == 0
    kind = "revisit" if revisit else "continuation" if chunk else "response"
    block = b"" if chunk else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if not revisit:
        block += row["data"]
    identity = urn(row["record"], row["page_id"])
    fields = [("WARC-Type", kind), ("WARC-Date", DATE), ("WARC-Record-ID", f"{identity[:-1]}:{chunk}>" if chunk else identity)]
    if row["target"]:
        fields.append(("WARC-Target-URI", quoted(row["target"])))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", urn(row["refers_record"], row["refers_to"])))
    if not alone and not revisit:
        fields.append(("WARC-Segment-Number", str(chunk + 1)))
        if chunk:
            fields.append(("WARC-Segment-Origin-ID", identity))
        if row["last"]:
            fields.append(("WARC-Segment-Total-Length", str(row["bytes_so_far"])))
    if row["last"] or revisit:
        fields.append(("WARC-Payload-Digest", "sha1:" + base32(row["sha1"])))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def write_archives(chunks: DataFrame, revisited: DataFrame, folder: str) -> None:
    """The chunked table as gzipped WARC files. Chunks of which surely no revisit is made are not shuffled."""
    maybe, surely = split_by_ids(chunks, "record", revisited)
    none = {"refers_record": F.lit(None).cast("string"), "refers_to": F.lit(None).cast("long")}
    # A payload of several chunks is revisited by one record: of its chunks, the last is kept as it has the digest.
    maybe = maybe.join(revisited, "record", "left").filter(F.col("refers_record").isNull() | F.col("last"))
    maybe = maybe.withColumn("chunk", F.when(F.col("refers_record").isNull(), F.col("chunk")).otherwise(0))
    chunks = surely.withColumns(none).unionByName(maybe)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([segment(row) for row in batch.to_pylist()], pa.binary())], ["value"])

    texts = chunks.mapInArrow(run, "value binary").select(F.expr("CAST(value AS STRING)").alias("value"))
    texts.write.option("lineSep", BREAK.decode()).option("compression", "gzip").text(folder)


class Reader:
    """WARC records out of a stream of bytes. Holds what has come of one record, at most a head and a chunk."""

    def __init__(self):
        self.held, self.fields, self.need = bytearray(), None, 0

    def feed(self, data: bytes):
        self.held += data
        while True:
            if self.fields is None:
                end = self.held.find(BREAK)
                if end < 0:
                    return
                version, *lines = bytes(self.held[:end]).split(b"\r\n")
                if not version.startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {version[:40]!r}")
                pairs = (line.partition(b": ") for line in lines)
                self.fields = {name.decode().lower(): value.decode() for name, _, value in pairs}
                self.need = int(self.fields["content-length"])
                del self.held[: end + len(BREAK)]
            if len(self.held) < self.need + len(BREAK):
                return
            block = bytes(self.held[: self.need])
            del self.held[: self.need + len(BREAK)]
            yield self.fields, block
            self.fields = None


def parsed(fields: dict, block: bytes, file: str):
    kind = fields["warc-type"]
    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
    record, page_id = of_urn(origin)
    refers_record, refers_to = of_urn(fields["warc-refers-to"]) if kind == "revisit" else (None, None)
    if kind != "continuation":
        block = block[block.index(BREAK) + len(BREAK) :]
    chunk = int(fields.get("warc-segment-number", 1)) - 1
    last = "warc-segment-number" not in fields or "warc-segment-total-length" in fields
    return record, page_id, fields.get("warc-target-uri"), kind, refers_record, refers_to, chunk, last, block, file


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The chunked table of the WARC files below ``folder``."""

    def rows(batches):
        reader, file = None, None
        for batch in batches:
            for data, of in zip(batch.column(0), batch.column(1).to_pylist()):
                if of != file:
                    if reader:
                        yield from ((len(x[1]), parsed(*x, file)) for x in ended(reader, file))
                    reader, file = Reader(), of
                    found = reader.feed(data.as_py())
                else:
                    # The source has taken off what stood between two pieces.
                    found = reader.feed(BREAK + data.as_py())
                yield from ((len(block), parsed(fields, block, file)) for fields, block in found)
        if reader:
            yield from ((len(x[1]), parsed(*x, file)) for x in ended(reader, file))

    def ended(reader, file):
        yield from reader.feed(BREAK)
        if reader.held.strip(b"\r\n") or reader.fields is not None:
            raise ValueError(f"{file} ends within a record")

    def run(batches):
        return in_batches(rows(batches), PARSED)

    pieces = spark.read.option("lineSep", BREAK.decode()).text(folder)
    return pieces.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file")).mapInArrow(run, PARSED)


def records(chunks: DataFrame) -> DataFrame:
    """``record, page_id, target, kind, refers_record, refers_to, payload_bytes, payload_digest`` of a chunked table as read.

    Revisits have the bytes and digest of the record they refer to.
    """
    made = "record string, page_id long, target string, kind string, refers_record string, refers_to long, payload_bytes long, payload_digest string"

    def digest(batches):
        """Chunks in order of record and number; a hash state is carried from one to the next."""
        key, sha1, size = None, hashlib.sha1(), 0
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("record", "page_id", "target", "kind", "refers_record", "refers_to", "chunk", "last")]
            for row, data in zip(zip(*columns), batch.column(batch.schema.get_field_index("data"))):
                if row[0] != key:
                    key, sha1, size, due = row[0], hashlib.sha1(), 0, 0
                if row[6] != due:
                    raise ValueError(f"record {key} lacks chunk {due}")
                sha1.update(data.as_buffer())
                due, size = due + 1, size + len(data.as_buffer())
                if row[7]:
                    out.append((len(key), ("response" if row[3] == "continuation" else row[3], size, base32(sha1.digest()), row)))
            yield rows_out([(r[0], r[1], r[2], kind, r[4], r[5], size, digest) for _, (kind, size, digest, r) in out], made)

    alone = (F.col("chunk") == 0) & F.col("last")
    longer = chunks.filter(~alone).repartition("record").sortWithinPartitions("record", "chunk")
    found = stored(chunks.filter(alone).mapInArrow(digest, made).unionByName(longer.mapInArrow(digest, made)), "archived-records")
    responses = found.filter("kind <> 'revisit'")
    of_response = responses.select(F.col("record").alias("refers_record"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest"))
    revisited = found.filter("kind = 'revisit'").join(of_response, "refers_record", "left")
    revisited = revisited.withColumns({"payload_bytes": F.col("__bytes"), "payload_digest": F.col("__digest")}).drop("__bytes", "__digest")
    return responses.unionByName(revisited)


def archive(pages: DataFrame, folder: str | None = None, payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes a WARC record per row of ``pages`` into ``folder`` (a new one in the shared folder) and returns the records read back from it."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/llm-warc-{uuid.uuid4().hex}"
    chunks = stored(chunked(pages, payload, chunk_bytes), "chunks")
    write_archives(chunks, stored(revisits(chunks), "revisits"), folder)
    return records(read_archives(spark, folder))
