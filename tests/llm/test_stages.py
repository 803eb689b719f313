"""Each stage of the pipeline on odd rows: nulls, empty and very long texts, ties, repeated rows, clashing names, an empty table; planted passages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from panelforge.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
STAGES = dict(P.STAGES)
CLASHES = ["kept_id", "score", "spans", "id", "sequence_id", "node", "key", "n_removed", "kept_text", "component_id", "piece", "toxic"]
ODD = 10**6


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    long = sentence(rng, 60_000)
    one, two = sentence(rng, 80), sentence(rng, 80)
    return [
        (ODD + 1, None, None, None, None),
        (ODD + 2, "", "en", "a", 0),
        (ODD + 3, "  \n ", "en", None, 4),
        (ODD + 4, long, "en", "a", len(long)),
        (ODD + 5, one, "en", "a", len(one)),
        (ODD + 6, one, None, "b", None),  # a tie with the row before
        (ODD + 7, two, "de", "b", len(two)),
        (ODD + 7, two, "de", "b", len(two)),  # the row repeated
        (None, sentence(rng, 70), "en", "a", 3),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


def counted(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"] and r["doc_id"] - ODD, []).append(r)
    return out


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, odd, name):
    assert STAGES[name](spark, odd.limit(0), SMALL).collect() == []


def test_toxicity_keeps_odd_rows(spark, odd):
    """Beside documents to learn from, every odd row that is clean stays as it is, repeated ones twice."""
    docs = read_table(spark, SMALL, "documents").select(*P.COLUMNS).unionByName(odd, allowMissingColumns=True)
    out = STAGES["toxicity"](spark, docs, SMALL)
    assert out.columns == P.COLUMNS
    got = counted(out.where(f"doc_id > {ODD} or doc_id is null"))
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, None: 1}
    assert got[1][0].text is None and got[4][0].text == odd_rows()[3][1]


def test_near_dedup_on_odd_rows(spark, odd):
    """Of a tie the smaller id stays, of a repeated row one; rows without words stay."""
    out = STAGES["near_dedup"](spark, odd, SMALL)
    assert out.columns == P.COLUMNS
    assert {k: len(v) for k, v in counted(out).items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, None: 1}


def test_suffix_dedup_on_odd_rows(spark, odd):
    """Rows of one long enough text go whole, null, blank and unrepeated ones stay as they are."""
    out = STAGES["suffix_dedup"](spark, odd, SMALL)
    assert out.columns == P.COLUMNS
    got = counted(out)
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, None: 1}
    assert got[1][0].text is None and got[3][0].text == "  \n " and got[4][0].text == odd_rows()[3][1]


def test_packing_of_odd_rows(spark, odd):
    """Null and empty texts are one piece of the end id, long ones whole sequences and a rest, repeated rows twice as many."""
    out = STAGES["packing"](spark, odd, SMALL)
    got = counted(out)
    assert [(r.piece, r.length) for r in got[1]] == [(r.piece, r.length) for r in got[2]] == [(0, 1)]
    assert len(got[4]) > 50 and sorted(r.length for r in got[4])[1:] == [1024] * (len(got[4]) - 1)
    assert len(got[7]) == 2 * len({r.piece for r in got[7]}) and [r.length for r in got[5]] == [r.length for r in got[6]]
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert full <= 1024


@pytest.mark.parametrize("n", [51, 58, 65])
def test_planted_passages_go(spark, n):
    """A passage of over 50 words of each language in two documents each goes; the words around it stay."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rng, rows, passages = random.Random(n), [], {}
    for k, lang in enumerate(["en", "de", "fr", "es"]):
        texts = [r.text for r in docs.where((F.col("lang") == lang) & (F.length("text") > 3000)).orderBy("doc_id").limit(1).select("text").collect()]
        w = texts[0].split()
        passages[lang] = " ".join(w[20 : 20 + n])
        for i in range(2):
            rows.append((10 * k + i, f"{sentence(rng, 40)} {passages[lang]} {sentence(rng, 40)}", lang, "a", 0))
        rows.append((10 * k + 5, sentence(rng, 120), lang, "a", 0))
    out = STAGES["suffix_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SMALL)
    kept = {r.doc_id: r.text for r in out.collect()}
    for doc, text, lang, *_ in rows:
        gone = len(text) - len(kept[doc])
        if doc % 10 == 5:
            assert kept[doc] == text
        else:  # neighbours may agree in a letter or two beside the passage
            assert passages[lang] not in kept[doc] and len(passages[lang]) <= gone <= len(passages[lang]) + 6
