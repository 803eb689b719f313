"""The pipeline on the smallest tables, and each of its stages against what it must do."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P  # noqa: E402
from panelforge.llm import minhash  # noqa: E402
from panelforge.llm.common import read_table  # noqa: E402


def test_stages_follow_each_other(spark, small):
    docs = read_table(spark, small, "documents")
    first = P.drop_toxic(spark, docs, small).persist()
    assert first.columns == P.COLUMNS and 0 < first.count() <= docs.count()
    second = P.drop_near_duplicates(spark, first, small).persist()
    assert second.columns == P.COLUMNS
    groups = minhash.near_duplicates(first).select("component_id").distinct().count()
    assert second.count() == groups and second.select("doc_id").distinct().count() == groups
    third = P.drop_repeats(spark, second, small).persist()
    assert third.columns == P.COLUMNS and third.count() <= second.count()
    whole = third.selectExpr("sum(length(text))").first()[0]
    assert whole <= second.selectExpr("sum(length(text))").first()[0]
    packed = P.pack(spark, third, small)
    assert packed.select("doc_id").distinct().count() == third.count()
    assert packed.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`) <= 1024").first()[0]


def test_pipeline_is_registered(spark, small):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_passages_of_over_50_words_go(spark, small):
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))

    passages = [prose(n) for n in (51, 53, 57, 60, 65)]
    assert min(len(p) for p in passages) < 400
    texts = {i: f"{prose(90)} {passages[i % 5]} {prose(80)}" for i in range(10)} | {i: prose(200) for i in range(10, 20)}
    rows = [(i, t, "en", "web", len(t)) for i, t in texts.items()]
    got = {r["doc_id"]: r["text"] for r in P.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), small).collect()}
    assert all(passages[i % 5] not in got[i] and len(texts[i]) - len(got[i]) <= len(passages[i % 5]) + 4 for i in range(10))
    assert all(got[i] == texts[i] for i in range(10, 20))
