"""Quotation linking: who answers whom, from quoted passages, on DataFrame functions alone.

A line's quote level is the number of ``>`` before it. Neighbouring lines of one level are a passage.
Passages and their lines are normalised (lower case, runs of anything but letters and digits as one
space) and hashed. The unquoted ones are summed up to the first message of the conversation that has
each, the original; quoted ones of every level are joined to these on conversation and hash. Of the levels
of a message of which something is found the lowest counts: it answers the earlier message from which
most of its characters come. Links are followed to the first message of a thread by doubling, which also
strings the turns on the way together to a path; then quotes and the lines that announce them are
taken out. Sorted by conversation and path, a conversation reads in reply order: every message comes after
the one that it answers and before the next branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, forget, written

#: A level's marks and what follows; a line that announces a quotation (fixed patterns).
QUOTED = r"^((?:[ \t]?>)+)[ \t]?(.*)$"
ANNOUNCES = r"(?i)^(on|le|am|el|in)\b.*\b(wrote|a écrit|schrieb|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def levelled(text: Column) -> Column:
    """Lines as ``level, body``."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    marks = lambda x: F.regexp_extract(x, QUOTED, 1)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"),
            F.when(marks(x) == "", x).otherwise(F.regexp_extract(x, QUOTED, 2)).alias("body"),
        ),
    )


def passages(lines: Column) -> Column:
    """Passages of one level as ``level, body`` in order, from levelled lines."""
    n = F.size(lines)
    at = F.sequence(F.lit(1), n)
    level = lambda i: F.element_at(lines, i)["level"]
    starts = F.filter(at, lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))
    stops = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n + 1))
    return F.zip_with(
        starts,
        stops,
        lambda a, b: F.struct(level(a).alias("level"), F.array_join(F.transform(F.slice(lines, a, b - a), lambda x: x["body"]), "\n").alias("body")),
    )


def _units(parsed: DataFrame, quoted: bool) -> DataFrame:
    """``conv, turn_key, level, hash, check, chars`` of the passages and lines, each once a level, quoted or not."""
    of = (lambda x: x["level"] > 0) if quoted else (lambda x: x["level"] == 0)
    parts = [F.transform(F.filter(c, of), lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("unit"))) for c in ("passages", "lines")]
    units = parsed.select("conv", "turn_key", F.explode(F.array_distinct(F.concat(*parts))).alias("of")).select("conv", "turn_key", "of.level", "of.unit")
    return units.where("unit <> ''").select("conv", "turn_key", "level", F.xxhash64("unit").alias("hash"), F.xxhash64("unit", F.lit(1)).alias("check"), F.length("unit").alias("chars"))


def path_step(turn: Column) -> Column:
    """A turn as text whose order is that of turns: for 0 and more a letter for the number of digits and these, else 16 hexadecimal ones."""
    digits = turn.cast("string")
    return F.when(turn >= 0, F.concat(F.char(F.length(digits) + 96), digits)).otherwise(F.concat(F.lit("A"), F.lpad(F.hex(turn), 16, "0")))


def in_reply_order(linked: DataFrame) -> DataFrame:
    """The messages of ``link_quotations`` as conversations, one after the other, each in reply order.

    Rows are sorted by ranges of (conversation, path), so a conversation of any size is spread over tasks.
    """
    return linked.orderBy("conv_id", "reply_path")


def link_quotations(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, parent_turn, root_turn, depth, n_quoted, reply_path`` of every row of ``messages``.

    ``text`` is without quotes. ``parent_turn`` is the message it answers, null where nothing quoted is
    found in an earlier message of the conversation; such a message opens a thread. In the order of
    conv_id and ``reply_path`` a thread reads branch by branch. ``n_quoted`` counts quoted lines. Null
    texts are empty; rows of one conversation and turn, repeated ones too, are one message for links and
    share its path; null ids and turns are each a value of their own, below all others; an empty table
    gives an empty result; other columns are not read.
    """
    parsed = messages.select(
        "conv_id", "turn", "role", levelled(F.col("text")).alias("lines"), F.coalesce("conv_id", F.lit(NO_ID)).alias("conv"), F.coalesce("turn", F.lit(NO_ID)).alias("turn_key")
    ).withColumn("passages", passages(F.col("lines")))
    originals = _units(parsed, quoted=False).groupBy("conv", "hash", "check").agg(F.min("turn_key").alias("original"))
    found = (
        _units(parsed, quoted=True)
        .join(originals.hint("merge"), ["conv", "hash", "check"])
        .where("original < turn_key")
        .groupBy("conv", "turn_key", "level", "original")
        .agg(F.sum("chars").alias("chars"))
        .groupBy("conv", "turn_key")
        .agg(F.max_by("original", F.struct(-F.col("level"), "chars", "original")).alias("parent"))
    )
    links = written(found)
    threads = links.select("conv", "turn_key", "parent", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth"), path_step(F.col("turn_key")).alias("path"))
    moved = links.limit(1).count()
    while moved:
        up = threads.select("conv", F.col("turn_key").alias("top"), F.col("top").alias("above"), F.col("depth").alias("more"), F.col("path").alias("before"))
        joined = threads.join(up.hint("merge"), ["conv", "top"], "left")
        longer = written(
            joined.select(
                "conv",
                "turn_key",
                "parent",
                F.coalesce("above", "top").alias("top"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.concat(F.coalesce("before", F.lit("")), "path").alias("path"),
                F.col("above").isNotNull().alias("moved"),
            )
        )
        moved = longer.where("moved").limit(1).count()
        forget(threads)
        threads = longer
    own = F.filter("lines", lambda x: x["level"] == 0)
    any_quote = F.exists("lines", lambda x: x["level"] > 0)
    said = F.transform(F.filter(own, lambda x: ~(any_quote & x["body"].rlike(ANNOUNCES))), lambda x: x["body"])
    out = parsed.join(threads.drop("moved").hint("merge"), ["conv", "turn_key"], "left")
    value = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.regexp_replace(F.array_join(said, "\n"), r"^\s+|\s+$", "").alias("text"),
        value("parent").alias("parent_turn"),
        F.when(F.col("top").isNull(), F.col("turn")).otherwise(value("top")).alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.concat(path_step(F.coalesce("top", "turn_key")), F.coalesce("path", F.lit(""))).alias("reply_path"),
    )
