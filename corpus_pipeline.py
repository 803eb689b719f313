"""From raw documents to packed sequences: four stages, each over all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``, of which
any may be null, and read no other; further columns of any name are left out. Null texts count as
empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import minhash, packing, suffixes, toxicity
from panelforge.llm.common import read_table, ship, written
from panelforge.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A repeated passage goes if it has over 50 words. Bytes that so many words reach, and of the grams that name their strings.
WORDS, REPEAT, GRAM = 51, 200, 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 stay, as they are; null and empty texts have the score of no features.

    Texts are scored whole whatever their length; repeated rows, and rows that tie at the threshold, fare alike.
    """
    ship(spark)
    model = toxicity.train(toxicity.labelled_rows(docs, read_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where("score < 0.7").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once if its row is repeated.

    Documents without words are near nothing; a null id is the smallest. Rows of one id and different texts
    that are all kept stay. Texts are compared whole whatever their length; among equal ones the smallest id decides.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    joined = docs.join(written(kept).hint("merge"), F.col("doc_id").eqNullSafe(F.col("kept_id")))
    return joined.select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``WORDS`` words or more that stand elsewhere too go; documents with nothing left of them go.

    Such a passage is a run of bytes in which every string of ``REPEAT`` bytes occurs twice. Null, empty and
    shorter texts stay as they are; rows of one text go whole. A text of any length is judged whole.
    """
    ship(spark)
    cut = suffixes.remove_repeats(docs.select(*COLUMNS), length=REPEAT, gram=GRAM, least_words=WORDS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text")
    left = (F.col("n_removed") == 0) | (F.trim("kept_text") != "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars")
    return cut.where(left).select("doc_id", text, "lang", "source", n_chars)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it; a null or empty text is one piece of the end id.

    A text of any length falls into pieces of whole sequences; a repeated row is packed as often as it occurs.
    """
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("suffix_dedup", drop_repeats), ("packing", pack)]

#: No stage can be expressed in SQL as a whole; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again by the next."""
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
