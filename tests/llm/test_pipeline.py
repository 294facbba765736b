"""The pipeline's stages, one by one, on a small table against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import TOKENIZER, components_of, prose, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    base = [prose(rng, rng.choice([70, 120, 200])) for _ in range(25)]
    texts = base + base[:3] + ["nav | home | about\n" * 40, "", None, "too short"]
    for text in base[3:9]:
        copy = text.split(" ")
        # Every line gets two new words, so that whole documents stay near and their lines do not.
        texts.append("\n".join(x + " qq zz" if i % 4 == 0 else x.replace("ta", "tu", 1) + " ww" for i, x in enumerate(" ".join(copy).split("\n"))))
    rows = [(i, t, "en", rng.choice(["a", "b", None]), None, "x") for i, t in enumerate(texts)]
    rows += [rows[0], (None, base[10] + " Without an id.", "en", "a", 1, "y")]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS

    kept = Counter(r.doc_id for r in seen["quality_rules"])
    assert kept == Counter(r.doc_id for r in seen["documents"] if len(words(r.text)) >= 50 and "|" not in r.text)
    whole = {r.doc_id: r.text for r in seen["documents"]}
    assert all(r.text == whole[r.doc_id] and r.n_chars == len(r.text) for r in seen["quality_rules"])

    ids = Counter(r.doc_id for r in seen["line_dedup"])
    assert not {25, 26, 27} & set(ids) and ids[0] == 2 and ids[None] == 1
    lines = Counter(tuple(words(x)) for r in {(r.doc_id, r.text) for r in seen["line_dedup"]} for x in r[1].split("\n") if len(words(x)) >= 4)
    assert max(lines.values()) == 1

    sets = {}
    for r in seen["line_dedup"]:
        w = words(r.text.lower())
        sets[r.doc_id] = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])
    known = [i for i in sets if i is not None]
    links = [(a, b) for a in known for b in known if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = components_of(links, known)
    assert Counter(r.doc_id for r in seen["near_duplicates"]) == Counter([None, *{first[i] for i in known}])

    taken = Counter(r.doc_id for r in seen["mixing"])
    assert set(taken) <= {r.doc_id for r in seen["near_duplicates"]} and max(taken.values()) <= 2
    size = sum(len(words(r.text)) for r in seen["near_duplicates"])
    assert sum(len(words(r.text)) for r in seen["mixing"]) == pytest.approx(1.5 * size, abs=3 * 210)

    count = Tokenizer.from_file(TOKENIZER)
    tokens = sum(len(count.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["mixing"])
    assert sum(r.length for r in seen["packing"]) == tokens
    again = corpus_pipeline.run(spark, folder)
    assert sum(r.length for r in again.collect()) == tokens


def test_near_duplicates_of_one_id(spark):
    rng = random.Random(5)
    a, b, c = (prose(rng, 90) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, c), (3, c + " more"), (4, a + " more"), (0, "short"), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3), "").collect())
    third = [k for k in found if k[0] == 3]
    assert len(third) == 1 and third[0][1] in (c, c + " more")
    assert found == Counter([(1, a), (1, b), third[0], (0, "short"), (None, a), (None, a)])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
