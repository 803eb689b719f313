"""Homomorphic multiset hashes of documents, on DataFrame functions alone.

A document is the multiset of its paragraphs: its lines, and within a line its sentences, so that a
text of one long line has parts too. Every paragraph is hashed to a wide vector of 0 and 1; the
fingerprint is the sum of the vectors, component-wise modulo 2**20, next to the sum of 60-bit hashes
modulo 2**60, which makes equal fingerprints of unequal multisets improbable. The sum does not depend on
the order, and a paragraph is put in or taken out by adding or subtracting its vector (``combine``).

Three components of 20 bits share a 64-bit integer, each with a bit above it that is cleared after every
addition, so the whole vector takes few integer additions and no component carries into the next.
A component counts the paragraphs whose hash has its bit. The difference of two fingerprints has, in
each component, a variance in proportion to the paragraphs that only one of them has; its squares
estimate that number, and from it the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID

#: Hashes a paragraph, and integers of three components each that one hash fills.
HASHES = 3
SHIFTS = 20
FIELD = 21
_ONES = (1 << 2 * FIELD) | (1 << FIELD) | 1
_FIELD = (1 << 20) - 1
_FIELDS = _ONES * _FIELD
_WIDE = (1 << 60) - 1
#: Borders of buckets that a row is held against at a time, and buckets at most.
STEP, BUCKETS = 256, 1 << 16
COMPONENTS = HASHES * SHIFTS * 3


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, blank ones left out."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])\s+")
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def _hashed(parts: Column, seed: int) -> Column:
    return F.transform(parts, lambda p: F.xxhash64(p, F.lit(seed)))


def vector(parts: Column) -> Column:
    """The sum of the vectors of ``parts``: packed counts, then the paragraph count and the wide sum."""
    sums: list[Column] = []
    for k in range(HASHES):
        hashed = _hashed(parts, k)
        zero = F.array_repeat(F.lit(0).cast("long"), SHIFTS)
        sums.append(
            F.aggregate(
                hashed,
                zero,
                lambda acc, h: F.transform(acc, lambda a, i: (a + F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(_ONES))).bitwiseAND(F.lit(_FIELDS))),
            )
        )
    wide = F.aggregate(
        parts,
        F.lit(0).cast("long"),
        lambda acc, p: (acc + F.xxhash64(p, F.lit(HASHES)).bitwiseAND(F.lit(_WIDE))).bitwiseAND(F.lit(_WIDE)),
    )
    return F.concat(*sums, F.array(F.size(parts).cast("long"), wide))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of the multiset sum of two documents, or with ``sign`` -1 of the first without the second.

    Each packed component is added or subtracted modulo 2**20, the wide sum modulo 2**60.
    """
    last = HASHES * SHIFTS

    def one(x: Column, y: Column, i: Column) -> Column:
        fields = F.lit(0).cast("long")
        for j in range(3):
            f = (F.shiftright(x, FIELD * j).bitwiseAND(F.lit(_FIELD)) + sign * F.shiftright(y, FIELD * j).bitwiseAND(F.lit(_FIELD))).bitwiseAND(F.lit(_FIELD))
            fields = fields.bitwiseOR(F.shiftleft(f, FIELD * j))
        plain = (x + sign * y).bitwiseAND(F.lit(_WIDE))
        return F.when(i < last, fields).otherwise(plain)

    zipped = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(zipped, lambda s, i: one(s["x"], s["y"], i))


def as_text(v: Column) -> Column:
    """A fingerprint as hexadecimal text."""
    return F.array_join(F.transform(v, lambda x: F.lower(F.hex(x))), "-")


def likeness(a: Column, b: Column) -> Column:
    """Shared paragraphs over the mean number of either side's, estimated from vectors; 1 where they are equal.

    Two documents without paragraphs are alike.
    """
    n = HASHES * SHIFTS

    def total(x: Column, y: Column) -> Column:
        out = F.lit(0.0)
        for j in range(3):
            f = F.shiftright(x, FIELD * j).bitwiseAND(F.lit(_FIELD)) - F.shiftright(y, FIELD * j).bitwiseAND(F.lit(_FIELD))
            out = out + f * f
        return out

    size_a, size_b = F.element_at(a, n + 1), F.element_at(b, n + 1)
    first_a, first_b = F.slice(a, 1, n), F.slice(b, 1, n)
    squares = F.aggregate(F.zip_with(first_a, first_b, total), F.lit(0.0), lambda acc, x: acc + x)
    # a component of the difference has mean gap/2 and a variance of a quarter of the unshared paragraphs
    gap = size_a - size_b
    unshared = 4 * (squares / float(COMPONENTS) - gap * gap / 4.0)
    unshared = F.greatest(unshared, F.abs(gap).cast("double"))
    both = F.greatest(size_a + size_b, F.lit(1))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - unshared / both))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``vector``: the fingerprint of each whole text (null: of no paragraphs). No shuffle."""
    return docs.withColumn("vector", vector(paragraphs(F.col(text))))


def followed(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs(id, text, …)`` with the next row's ``next_text`` and ``next_vector``, in order of (id, text).

    After the last row comes the first. Rows are dealt into ``buckets`` ranges of ids, whose borders are
    approximate quantiles; each bucket also gets a copy of the first row after it, so one window a
    bucket sees all neighbours, and a text moves once.
    """
    spark = docs.sparkSession
    borders = sorted(set(docs.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.2 / buckets))) if buckets > 1 else []
    edges = F.array(*[F.lit(int(b)) for b in borders]) if borders else F.array().cast("array<long>")
    # every STEP-th border first, then those after it, so that a row is held against few of many borders
    coarse = F.array(*[F.lit(int(b)) for b in borders[STEP - 1 :: STEP]]) if len(borders) >= STEP else F.array().cast("array<long>")
    below = lambda some: F.size(F.filter(some, lambda e: e <= F.col("id")))
    placed = docs.withColumn("bucket", below(coarse)).withColumn("bucket", F.col("bucket") * STEP + below(F.slice(edges, F.col("bucket") * STEP + 1, STEP)))
    # a row a bucket: the smallest id of each, and whose follower it is
    firsts = placed.groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()
    if not firsts:
        return placed.select(*docs.columns, F.lit("").alias("next_text"), F.col("vector").alias("next_vector"))
    after = [(f["id"], firsts[i - 1]["bucket"]) for i, f in enumerate(firsts)]
    ghosts = placed.drop("bucket").join(F.broadcast(spark.createDataFrame(after, "id long, bucket int")), "id")
    both = placed.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    order = Window.partitionBy("bucket").orderBy("ghost", "id", "text")
    seen = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_vector", F.lead("vector").over(order))
    return seen.where("not ghost").drop("bucket", "ghost")


def with_edits(docs: DataFrame, rows_a_bucket: int = 4000) -> DataFrame:
    """The fingerprints of ``docs(doc_id, text)`` and of their edited texts, with likenesses.

    The last half of a text's code points is replaced by the first as many of the next text in
    ascending doc_id (rows of one id by text; a null id comes first; after the last the first). Null
    texts are empty; an empty table gives an empty result; repeated rows follow each other.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = int(max(1, min(BUCKETS, rows.count() // rows_a_bucket)))
    seen = followed(fingerprint(rows), buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    seen = seen.select("doc_id", n.cast("long").alias("n_chars"), "vector", "next_vector", edited.alias("edited"))
    seen = seen.withColumn("edited_vector", vector(paragraphs(F.col("edited"))))
    return seen.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
