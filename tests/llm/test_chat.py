"""Chat formatting: events folded one by one, rendered and read back."""

from __future__ import annotations

import hashlib
import random

from ledgerloom.llm import chat

NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<s", "s>", "<<s>", "[ROLE]x[/ROLE]", "a\nb", "[/TURN]</s>", "日本 ½"]


def test_texts_come_back():
    for role in ("user", "assistant", "system", "tool", "[ROLE]", "a\\", None):
        for text in NASTY:
            formatted, start, end = chat.render(role, text)
            assert chat.read_back(formatted) == [(role or "", text)]
            assert chat.unescape(formatted[start:end]) == (text if role == "assistant" else "")
            body = chat.escape(text)
            assert not any(c in body for c in chat.CONTROLS)


def plain(rows):
    """Digests of finished turns, by conversation."""
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, str(r[2] or ""))):
        found.setdefault(conv, []).append((role or "", text or ""))
    return {
        c: (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            sum(len(t) for r, t in turns if r == "assistant"), hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest(),
        )
        for c, turns in found.items()
    }


def test_whole_conversations(spark):
    rng = random.Random(1)
    rows = [(c, n, ("user", "assistant")[n % 2], rng.choice(NASTY) * rng.choice([1, 1, 400])) for c in range(40) for n in range(rng.randint(1, 9))]
    rows += [(50, n, ("user", "assistant")[n % 2], f"turn {n}") for n in range(3000)]
    rows += [(51, 0, None, None), (51, None, "tool", "first"), (52, 1, "user", "same"), (52, 1, "user", "same"), (None, 0, "user", "x")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).withColumnRenamed("x", "y").selectExpr("*", "'odd' AS formatted", "1 AS seq").repartition(5)
    found = chat.digests(chat.format_conversations(chat.events_of(df))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == plain(rows)
    empty = spark.createDataFrame([], schema)
    assert chat.digests(chat.format_conversations(chat.events_of(empty))).count() == 0


def test_edits_and_regenerations(spark):
    log = [
        (1, 0, "open", None, "user", None), (1, 1, "delta", None, None, "What"), (1, 2, "delta", None, None, " now?"),
        (1, 3, "open", None, "assistant", None), (1, 4, "delta", None, None, "Bad "), (1, 5, "delta", None, None, "answer"),
        (1, 6, "regenerate", 1, None, None), (1, 7, "delta", None, None, "Good"), (1, 8, "edit", 0, None, "What next?"),
        (1, 9, "delta", None, None, " answer"), (1, 10, "edit", 9, None, "nobody"), (1, 11, "regenerate", None, None, None),
        (2, 0, "delta", None, None, "lost"), (2, 1, "open", None, "user", None),
        (3, 0, "open", None, "user", None), (3, 1, "delta", None, None, "a"), (3, 2, "open", None, "assistant", None), (3, 3, "delta", None, None, "b"),
        (3, 4, "regenerate", 0, None, None), (3, 5, "delta", None, None, "c"),
    ]
    random.Random(2).shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string")
    found = {}
    for r in chat.format_conversations(events).collect():
        found.setdefault(r.conv_id, []).extend(chat.read_back(r.formatted))
    assert found == {1: [("user", "What next?"), ("assistant", "Good answer")], 2: [("user", "")], 3: [("user", "c")]}
