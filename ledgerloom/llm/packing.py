"""Hierarchical packing of documents into context windows of several lengths.

A document is its token ids and an end id. Its full windows of the longest tier are sequences of
their own. What remains is routed to the shortest tier that holds it and opens a window there,
longest first; the gap behind it is filled with whole remainders of shorter tiers, longest that
fits first, and closed exactly by cutting one. What is left when a partition ends is cut into
windows of powers of two, so no sequence needs padding.

Sequences of one tier are dealt into step groups of equal token budget. Each partition packs by
itself with a bounded buffer: nothing is shuffled, and a partition read again is packed the same way.

Defined results: a null or empty text is its end id alone; repeated rows are packed each for
themselves; an empty table gives an empty table; further columns are not carried along. A text of
any length is packed whole.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import DataFrame

from ledgerloom.llm.shared import text_blocks
from ledgerloom.llm.tokens import Encoder, encoder_parts

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 8 * 2048
#: Remainders that stay in the buffer to choose fillers from.
WAITING = 512

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, step_group long"
)


class Packer:
    """Packs the documents of one partition; ``rows`` holds finished pieces."""

    def __init__(self, partition: int, tiers=TIERS):
        self.base = partition << 40
        self.tiers, self.longest = tiers, tiers[-1]
        self.waiting: list[tuple] = []  # (length, order, document, start), shortest first
        self.orders = self.sequences = 0
        self.step_tokens: dict[int, int] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids) -> None:
        """``ids``: array of unsigned 32-bit ids, end id included."""
        document = (doc_id, ids)
        whole = len(ids) - len(ids) % self.longest
        for start in range(0, whole, self.longest):
            self.sequence(self.longest, [(self.longest, document, start)])
        if whole < len(ids):
            self.wait(len(ids) - whole, document, whole)
        while len(self.waiting) > WAITING:
            self.window()

    def wait(self, length: int, document, start: int) -> None:
        self.orders += 1
        insort(self.waiting, (length, self.orders, document, start), key=lambda w: w[:2])

    def window(self) -> None:
        """One window opened by the longest remainder, its gap filled from shorter ones."""
        length, _, document, start = self.waiting.pop()
        tier = next(t for t in self.tiers if t >= length)
        pieces, gap = [(length, document, start)], tier - length
        while gap and self.waiting:
            fits = bisect_right(self.waiting, gap, key=lambda w: w[0]) - 1
            length, _, document, start = self.waiting.pop(max(fits, 0))
            if length > gap:
                self.wait(length - gap, document, start + gap)
                length = gap
            pieces.append((length, document, start))
            gap -= length
        if gap:
            self.powers(pieces)
        else:
            self.sequence(tier, pieces)

    def powers(self, pieces) -> None:
        """Sequences of powers of two holding all of ``pieces``."""
        left = sum(p[0] for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            taken = []
            while size:
                length, document, start = pieces.pop(0)
                if length > size:
                    pieces.insert(0, (length - size, document, start + size))
                    length = size
                taken.append((length, document, start))
                size -= length
            self.sequence(sum(p[0] for p in taken), taken)

    def sequence(self, tier: int, pieces) -> None:
        from zlib import crc32

        number, offset = self.base + self.sequences, 0
        self.sequences += 1
        tokens = self.step_tokens.get(tier, 0)
        self.step_tokens[tier] = tokens + tier
        group = self.base + (tier << 28) + tokens // STEP_TOKENS
        for length, (doc_id, ids), start in pieces:
            checked = crc32(ids[start : start + length].tobytes())
            self.rows.append((doc_id, start, length, checked, len(ids), number, offset, tier, group))
            offset += length

    def finish(self) -> None:
        while self.waiting:
            self.window()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers=TIERS) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence."""
    parts = encoder_parts(docs, tokenizer_path)
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def packed(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, packer = Encoder(*parts.value), Packer(TaskContext.get().partitionId(), tiers)
        end = np.array([end_id], "<u4")
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

        def batch():
            columns = zip(*packer.rows)
            made = [pa.array(values, kind) for values, kind in zip(columns, types)]
            packer.rows = []
            return pa.RecordBatch.from_arrays(made, names)

        for rows, texts in text_blocks(batches):
            for doc_id, text in zip(rows.column(rows.schema.get_field_index("doc_id")).to_pylist(), texts):
                ids = np.frombuffer(encoder.encode(text), "<u2").astype("<u4")
                packer.add(doc_id, np.concatenate([ids, end]))
            if packer.rows:
                yield batch()
        packer.finish()
        if packer.rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA)
