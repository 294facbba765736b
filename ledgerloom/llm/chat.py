"""Chat formatting from an event log.

A conversation is a log of events, put in order of its sequence and folded into messages:

* ``open``: a message of ``role`` begins;
* ``delta``: ``text`` is added to the message begun last;
* ``edit``: the text of message ``target`` (counted from 0) becomes ``text``;
* ``regenerate``: message ``target`` and all after it are dropped, and a message of the same role begins.

The log is dealt by conversation and sorted by sequence, and each partition is read as a stream.
Messages that no later event of the conversation touches are rendered one by one, so memory holds a
message and not a conversation; conversations in which something is edited or regenerated (flagged
by a row that sorts first) hold their messages until they end.

A turn is rendered between control strings of its role; an assistant's text is under the loss mask.
In texts and roles a backslash is doubled and a control string gets a backslash after its first
character, so no control string of a text appears in the output, and :func:`read_back` finds the
texts again.

Defined results: a null text is empty, a null or unknown role is written out by name; events of one
sequence are ordered by kind, role and text; edits and regenerations of messages that do not exist
change nothing, as do deltas before any message; repeated rows are repeated turns; an empty table gives an empty table; further columns are not
carried along.
"""

from __future__ import annotations

import re
from hashlib import sha256
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings by role.
MARKS = {
    "system": ("<s>[SYS]", "[/SYS]</s>"),
    "user": ("<s>[INST]", "[/INST]</s>"),
    "assistant": ("<s>[OUT]", "[/OUT]</s>"),
}
OTHER = ("<s>[ROLE]", "[/ROLE]", "[/TURN]</s>")
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[/OUT]", "[ROLE]", "[/ROLE]", "[/TURN]")
LOSS_ROLE = "assistant"
DELTA_CHARS = 512

ESCAPED = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
UNESCAPED = re.compile(r"\\(\\?)")
TURN = re.compile(
    "|".join(
        [rf"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items()]
        + [rf"{re.escape(OTHER[0])}(?P<name>.*?){re.escape(OTHER[1])}(?P<other>.*?){re.escape(OTHER[2])}"]
    ),
    re.DOTALL,
)


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """A turn, and where in it the text under the loss mask begins and ends (both 0: nowhere)."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role or "") + OTHER[1], OTHER[2]
    body = escape(text)
    loss = (len(before), len(before) + len(body)) if role == LOSS_ROLE else (0, 0)
    return before + body + after, *loss


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted string."""
    found = []
    for m in TURN.finditer(formatted):
        role = m.lastgroup
        if role == "other":
            found.append((unescape(m["name"]), unescape(m["other"])))
        else:
            found.append((role, unescape(m[role])))
    return found


def events_of(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text): each is opened and streamed in deltas."""
    text = F.coalesce("text", F.lit(""))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / delta_chars) - 1, F.lit(0)).cast("int")),
        lambda i: F.substring(text, i * delta_chars + 1, F.lit(delta_chars)),
    )
    opened = F.array(F.struct(F.lit("open").alias("kind"), F.lit("").alias("text")))
    deltas = F.transform(pieces, lambda p: F.struct(F.lit("delta").alias("kind"), p.alias("text")))
    # Turns of one number are told apart by what they hold, so that each keeps its deltas together; rows repeated whole
    # by where they lie, which changes nothing in the result.
    seq = F.struct(F.col("turn"), F.col("role").alias("of"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("copy"))
    return turns.select("conv_id", seq.alias("seq"), "role", F.posexplode(F.concat(opened, deltas)).alias("part", "event")).select(
        "conv_id", F.struct("seq.*", "part").alias("seq"), "event.kind", F.lit(None).cast("long").alias("target"), "role", "event.text"
    )


def fold(rows):
    """Messages ``(conv_id, number, role, text)`` of events ``(conv_id, kind, target, role, text)``.

    Events come sorted by conversation and sequence; a conversation whose first event is ``hold`` has edits
    or regenerations, and its messages are held until it ends.
    """
    for conv_id, events in groupby(rows, key=lambda row: row[0]):
        hold, number, messages = False, 0, []
        for _, kind, target, role, text in events:
            if kind == "hold":
                hold = True
            elif kind == "open":
                if messages and not hold:
                    yield conv_id, number, messages[0][0], "".join(messages.pop()[1])
                    number += 1
                messages.append((role, []))
            elif kind == "delta" and messages:
                messages[-1][1].append(text or "")
            elif kind == "edit" and target is not None and 0 <= target < len(messages):
                messages[target][1][:] = [text or ""]
            elif kind == "regenerate" and target is not None and 0 <= target < len(messages):
                messages[target:] = [(messages[target][0], [])]
        for role, parts in messages:
            yield conv_id, number, role, "".join(parts)
            number += 1


FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long"


def format_conversations(events: DataFrame) -> DataFrame:
    """One row per turn of the final conversation, in order: its rendering and the span under the loss mask.

    Rows of a conversation follow each other in one partition; concatenated they are its training text.
    ``events`` has ``conv_id``, ``seq`` (of any type that sorts), ``kind``, ``target``, ``role`` and ``text``.
    """
    rows = events.select("conv_id", F.lit(1).alias("after"), "seq", "kind", "target", "role", "text")
    nothing = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("target", "role", "text")]
    holds = (
        events.filter(F.col("kind").isin("edit", "regenerate")).select("conv_id").distinct()
        .select("conv_id", F.lit(0).alias("after"), F.lit(None).cast(events.schema["seq"].dataType).alias("seq"), F.lit("hold").alias("kind"), *nothing)
    )
    ordered = (
        rows.unionByName(holds).repartition("conv_id").sortWithinPartitions("conv_id", "after", "seq", "kind", "role", "text")
        .select("conv_id", "kind", "target", "role", "text")
    )

    def rendered(batches):
        import pyarrow as pa

        def events_in_order():
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        turns = ((c, n, *render(role, text)) for c, n, role, text in fold(events_in_order()))
        yield from in_batches(turns, FORMATTED, pa)

    return ordered.mapInArrow(rendered, FORMATTED)


def in_batches(rows, schema: str, pa, count: int = 2000, chars: int = 1 << 22):
    """Record batches of ``rows``, each of at most ``count`` rows and about ``chars`` characters of text."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]

    def batch():
        columns = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(columns, fields)], [n for n, _ in fields])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= count or size >= chars:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What :func:`format_conversations` returned, read back: one row per conversation.

    The rows of a conversation are taken as they come, so nothing may reorder them in between.
    """

    def digest(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        def conversations():
            for conv_id, turns in groupby(rows(), key=lambda row: row[0]):
                said, loss = sha256(), sha256()
                count = loss_chars = chars = 0
                for _, _, text, start, end in turns:
                    chars += len(text)
                    for role, body in read_back(text):
                        count += 1
                        said.update(f"{role}\n{body}\n".encode())
                    masked = unescape(text[start:end])
                    loss_chars += len(masked)
                    loss.update(masked.encode())
                yield conv_id, count, said.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from in_batches(conversations(), DIGEST, pa)

    return formatted.mapInArrow(digest, DIGEST)
