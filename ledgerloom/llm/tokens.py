"""Token counts with a whole-token shortcut, and token ids the same way.

The tokenizer is a byte-pair encoding with word ends, lower case and white space dropped, read from
the JSON file of the ``tokenizers`` library. Offline, on the driver, each vocabulary string that ends
a word is merged on its own; those that come out as one token are proven whole. In tasks the text is
split into pre-tokens, a pre-token that is proven whole counts one without any merging, and only the
rest go through the library's merges, once per distinct pre-token held in a bounded table.

Texts of Latin letters are split by a pattern over exactly the characters it lists; a text with any
other character is normalized and split by the library itself. Both look each pre-token up in the same
way, the second spelled in the letters that stand for bytes. The strings of special tokens inside
a text give their own id, as is the library's default.

Defined results: a null or empty text has no tokens; repeated rows are counted each for themselves;
an empty table gives an empty table; further columns are kept, except that columns named like a
result are replaced. Texts of any length are read whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import text_blocks

#: Pre-tokens kept with their ids besides the proven ones, and the longest that is kept.
KEPT_PIECES = 200_000
KEPT_LENGTH = 64


def byte_letters() -> str:
    """The character that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, are the characters
    from U+0100 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in visible else chr(next(others)) for b in range(256))


def latin_pattern() -> tuple[str, str]:
    """Patterns for lower-cased Latin text: of a whole text it applies to, and of its pre-tokens."""
    chars = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x250)) if chr(c) != "\xad"]
    kinds = {c: unicodedata.category(c)[0] for c in chars}
    letters, digits = ("".join(re.escape(c) for c in chars if kinds[c] == k) for k in "LN")
    others = "".join(re.escape(c) for c in chars if kinds[c] not in "LNZ")
    whole = "[" + "".join(re.escape(c) for c in chars) + r"\t\n\ṙ]*"
    # U+0307 arises from lower-casing U+0130; it is neither letter nor number.
    return whole, rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[{others}̇]+"


def whole_tokens(tokenizer_json: str) -> dict[str, int]:
    """Pre-tokens proven to be one token, with its id."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(tokenizer_json).model
    vocabulary = json.loads(tokenizer_json)["model"]
    end = vocabulary["end_of_word_suffix"]
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    proven = {}
    for name, token in vocabulary["vocab"].items():
        letters = name.removesuffix(end)
        if letters == name or not letters:
            continue
        if [t.id for t in model.tokenize(letters)] != [token]:
            continue
        try:
            proven[bytes(to_byte[c] for c in letters).decode()] = token
        except UnicodeDecodeError:
            continue
    return proven


def byte_spelling(piece: str) -> str:
    """A pre-token in the letters that stand for its UTF-8 bytes."""
    return piece.encode().decode("latin-1").translate(SPELLING)


SPELLING = dict(enumerate(byte_letters()))


class Pieces(dict):
    """Packed ids by pre-token: the proven ones, and others as they come up to a bound.

    ``spell`` turns a key into the letters that stand for bytes; keys may be so spelled already.
    """

    def __init__(self, tokenizer, whole: dict[str, int], spell=byte_spelling):
        self.tokenize, self.spell = tokenizer.model.tokenize, spell
        self.whole = {piece: struct.pack("<H", token) for piece, token in whole.items()}
        super().__init__(self.whole)

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.tokenize(self.spell(piece))]
        packed = struct.pack(f"<{len(ids)}H", *ids)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= len(self.whole) + KEPT_PIECES:
                self.clear()
                self.update(self.whole)
            self[piece] = packed
        return packed


class Encoder:
    """Token ids of whole texts, as unsigned 16-bit numbers packed into bytes."""

    def __init__(self, tokenizer_json: str, whole: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.pieces = Pieces(self.tokenizer, whole)
        self.spelled = Pieces(self.tokenizer, {byte_spelling(piece): token for piece, token in whole.items()}, str)
        applies, piece = latin_pattern()
        self.applies = re.compile(applies).fullmatch
        self.split = re.compile(piece).findall
        special = {t["content"]: t["id"] for t in json.loads(tokenizer_json)["added_tokens"]}
        self.special = {name: struct.pack("<H", token) for name, token in special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, special)) + ")").split

    def plain(self, text: str) -> bytes:
        lower = text.lower()
        if self.applies(lower) and "̇" not in text:
            return b"".join(map(self.pieces.__getitem__, self.split(lower)))
        text = self.tokenizer.normalizer.normalize_str(text)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return b"".join(self.spelled[letters] for letters, _ in split)

    def encode(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if "<|" in text:
            parts = self.special_split(text)
            return b"".join(self.special[p] if i % 2 else self.plain(p) for i, p in enumerate(parts))
        return self.plain(text)


def encoder_parts(docs: DataFrame, tokenizer_path: str):
    """What tasks need for an :class:`Encoder`, sent to each executor once: the file, and the proof."""
    source = Path(tokenizer_path).read_text()
    return docs.sparkSession.sparkContext.broadcast((source, whole_tokens(source)))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` instead of the text."""
    parts = encoder_parts(docs, tokenizer_path)
    results = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in (text, *results)]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counted(batches):
        import pyarrow as pa

        encoder = Encoder(*parts.value)
        for rows, texts in text_blocks(batches, (text,)):
            tokens = pa.array([len(encoder.encode(t)) // 2 for t in texts], pa.int64())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in kept), sizes, tokens], [*kept, "n_bytes", "n_tokens"])

    read = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))
    return read.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
