"""Toxicity score of whole texts: character n-grams scaled by naive Bayes log-count ratios, linear.

Features are the n-grams of characters (code points, lower-cased) of ``ORDERS`` lengths, hashed into a table; a text has or has not a feature. From labelled texts the count of every slot in
either class is summed over all labelled rows in Spark; the log ratio of the smoothed frequencies
scales the slot's feature. A logistic regression over the scaled features of a bounded sample of
labelled texts then gives the weights. Only slots that tell the classes apart beyond chance are kept,
so most n-grams of a text need one table look-up and nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_hint, written

#: Lengths of n-grams in characters, and bits of the feature table.
ORDERS = (4, 5, 6, 7)
BITS = 20
#: Folds and thresholds of the cross-validation, the score that decides there, and rows of a class that it fits at most.
FOLDS, TELLS, CUT, JUDGED = 3, (2.0, 2.5, 3.0), 0.7, 500
#: Steps of a regression, in cross-validation and of the last one, and features that it adds up at a time.
STEPS, LAST_STEPS, HELD = 60, 300, 1 << 20
#: Columns of the counts.
COUNTS = [f"{c}_{k}" for k in range(FOLDS) for c in ("clean", "toxic")]


@dataclass
class Model:
    """``weight`` of each kept slot (0 elsewhere), already multiplied by its log-count ratio."""

    weight: np.ndarray
    bias: float


def _slots(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each length the slots of all n-grams of a text, one after the other."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", errors="replace"), dtype="<u4")
    x = raw * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    x ^= x >> np.uint32(15)
    h = x
    for n in range(2, max(orders) + 1):
        if len(raw) < n:
            return
        h = h[:-1] * np.uint32(0x85EBCA6B) + x[n - 1 :]
        if n in orders:
            mixed = h * np.uint32(0xC2B2AE35) + np.uint32(n)
            mixed ^= mixed >> np.uint32(13)
            yield (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)


def features(text: str | None, kept: np.ndarray | None = None) -> np.ndarray:
    """The distinct slots that a text has, those under ``kept`` only where it is given."""
    found = [s if kept is None else s[kept[s]] for s in _slots(text or "")]
    if not found:
        return np.zeros(0, dtype=np.uint32)
    slots = np.sort(np.concatenate(found))
    return slots[np.append(True, slots[1:] != slots[:-1])] if len(slots) else slots


def slot_counts(labelled: DataFrame) -> DataFrame:
    """``slot, clean_k, toxic_k``: in how many texts of either class of fold k each slot occurs, over all labelled rows.

    Slot -1 counts the texts. Each task sums its own texts first, so at most one row a slot leaves it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2 * FOLDS, 1 << BITS), dtype=np.int32)
        seen = np.zeros(2 * FOLDS, dtype=np.int32)
        for b in batches:
            for toxic, fold, text in zip(*(c.to_pylist() for c in b.columns)):
                counts[2 * fold + toxic][features(text)] += 1
                seen[2 * fold + toxic] += 1
        slots = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
        for at in range(0, len(slots), 1 << 16):
            part = slots[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c[part]) for c in counts)], names=["slot", *COUNTS])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (-1, *seen.tolist())], names=["slot", *COUNTS])

    counted = labelled.select(F.col("toxic").cast("int").alias("toxic"), _fold(), "text").where("toxic in (0, 1)")
    counts = counted.mapInArrow(run, "slot int, " + ", ".join(f"{c} int" for c in COUNTS))
    return counts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _fold():
    """The fold of a row, by a hash of its id."""
    return F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")


def telling_slots(counts: DataFrame, seen: dict[str, int], least: float, without: int | None = None) -> DataFrame:
    """``slot, ratio, apart`` of the slots whose smoothed shares lie over ``least`` standard errors apart.

    Fold ``without`` is left out of the counts.
    """
    folds = [k for k in range(FOLDS) if k != without]
    clean, toxic = (sum(seen[f"{c}_{k}"] for k in folds) for c in ("clean", "toxic"))
    n_clean, n_toxic = (sum((F.col(f"{c}_{k}") for k in folds), F.lit(0)) for c in ("clean", "toxic"))
    p, q = (n_toxic + 1) / F.lit(toxic + 2.0), (n_clean + 1) / F.lit(clean + 2.0)
    error = F.sqrt(p * (1 - p) / float(toxic) + q * (1 - q) / float(clean))
    apart = counts.where("slot >= 0").select("slot", F.log(p / q).alias("ratio"), (F.abs(p - q) / error).alias("apart"))
    return apart.where(F.col("apart") > least)


def _sparse(rows: DataFrame, shares: list[float], slots: np.ndarray) -> tuple[np.ndarray, ...]:
    """Label and fold of a sample of rows, and row and place in ``slots`` of each feature that they have."""
    picked = rows.where(F.col("h") < F.when(F.col("toxic") == 1, F.lit(shares[1] * 2**20)).when(F.col("toxic") == 0, F.lit(shares[0] * 2**20)))
    sent = rows.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << BITS, dtype=bool)
        mask[sent.value] = True
        for b in batches:
            found = [features(t, mask).tolist() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "fold", "slots"])

    sample = picked.select("toxic", "fold", "text").mapInArrow(run, "toxic int, fold int, slots array<int>").toArrow()
    index = np.full(1 << BITS, -1, dtype=np.int32)
    index[slots] = np.arange(len(slots), dtype=np.int32)
    lists = sample.column("slots").combine_chunks()
    column = index[lists.flatten().to_numpy()]
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    del lists
    return sample.column("toxic").to_numpy().astype(np.float64), sample.column("fold").to_numpy(), owner, column


def choose_tells(counts: DataFrame, seen: dict[str, int], rows: DataFrame, sample_rows: int) -> float:
    """The threshold of ``TELLS`` with the fewest wrong decisions at ``CUT`` on folds left out, then the least loss.

    Slots are counted without the fold they are judged on. Rows are about ``sample_rows`` of each class at
    most, and weigh as many as they stand for. Folds that leave a class empty aren't judged.
    """
    total = [sum(seen[f"{c}_{k}"] for k in range(FOLDS)) for c in ("clean", "toxic")]
    folds = [k for k in range(FOLDS) if all(n > seen[f"{c}_{k}"] for n, c in zip(total, ("clean", "toxic")))]
    tables = {k: telling_slots(counts, seen, min(TELLS), k).select("slot", "ratio", "apart").toArrow() for k in folds}
    if not folds:
        return TELLS[len(TELLS) // 2]
    shares = [min(1.0, sample_rows / n) for n in total]
    union = np.unique(np.concatenate([t.column("slot").to_numpy() for t in tables.values()]))
    y, fold, owner, column = _sparse(rows, shares, union)
    stands = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    judged = {t: np.zeros(2) for t in TELLS}
    for k, table in tables.items():
        at = np.searchsorted(union, table.column("slot").to_numpy())
        scale, apart = np.zeros(len(union)), np.zeros(len(union))
        scale[at], apart[at] = table.column("ratio").to_numpy(), table.column("apart").to_numpy()
        fit_row, place = fold != k, np.cumsum(fold != k) - 1
        held_place = np.cumsum(fold == k) - 1
        for t in TELLS:
            new = np.cumsum(apart > t) - 1
            kept = apart[column] > t
            learn, held = kept & fit_row[owner], kept & ~fit_row[owner]
            some = scale[apart > t]
            weight, bias = _logistic(place[owner[learn]], new[column[learn]], some, y[fit_row], STEPS)
            margin = np.bincount(held_place[owner[held]], weights=(weight * some)[new[column[held]]], minlength=int((~fit_row).sum())) + bias
            truth, weigh = y[~fit_row], stands[~fit_row]
            wrong = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) >= CUT) != (truth == 1)
            judged[t] += (weigh[wrong].sum(), (weigh * np.logaddexp(0, np.where(truth == 1, -margin, margin))).sum())
    return min(TELLS, key=lambda t: tuple(judged[t]))


def train(labelled: DataFrame, sample_rows: int = 1_500, tells: float | None = None, seed: int = 0) -> Model:
    """Fit on ``labelled(doc_id, text, toxic)``; rows with another label than 0 or 1 are left out.

    The class counts cover all labelled rows; all slots beyond ``tells`` standard errors become features, as
    many as the table has at most. ``tells`` is chosen by cross-validation unless given. The regression
    fits on about ``sample_rows`` rows of each class at most, taken by a hash of the id. Without both
    classes the score is the constant 0.
    """
    counts = written(slot_counts(labelled))
    first = counts.where("slot = -1").first()
    seen = first.asDict() if first else dict.fromkeys(COUNTS, 0)
    total = [sum(seen[f"{c}_{k}"] or 0 for k in range(FOLDS)) for c in ("clean", "toxic")]
    if not all(total):
        return Model(np.zeros(1 << BITS, dtype=np.float32), -np.inf)
    rows = labelled.select(F.col("toxic").cast("int").alias("toxic"), _fold(), "text", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)).alias("h"))
    if tells is None:
        tells = choose_tells(counts, seen, rows, min(sample_rows, JUDGED))
    telling = telling_slots(counts, seen, tells).orderBy("slot").toArrow()
    slots, scale = telling.column("slot").to_numpy(), telling.column("ratio").to_numpy()
    y, _, owner, column = _sparse(rows, [min(1.0, sample_rows / n) for n in total], slots)
    weight, bias = _logistic(owner, column, scale, y)
    table = np.zeros(1 << BITS, dtype=np.float32)
    table[slots] = weight * scale
    return Model(table, bias)


class _Sums:
    """Sums over ``picks`` of the values of a table, one for each of ``groups``, whose sorted numbers stand beside the picks.

    A part of at most ``HELD`` picks, and one group more, is held at a time, so that memory doesn't grow with the sample.
    """

    def __init__(self, groups: np.ndarray, picks: np.ndarray, width: int):
        counts = np.bincount(groups, minlength=width)
        self.picks, self.width, self.some = picks, width, np.flatnonzero(counts)
        self.starts = np.append(0, np.cumsum(counts[self.some]))
        self.cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(picks), HELD)), len(self.some)))

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            low = self.starts[a]
            out[self.some[a:b]] = np.add.reduceat(values[self.picks[low : self.starts[b]]], self.starts[a:b] - low)
        return out


def _logistic(owner: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray, steps: int = LAST_STEPS, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression over sparse features (owner, column) of size ``scale``, ordered by owner."""
    rows, width = len(y), len(scale)
    weight, bias = np.zeros(width), float(np.log(max(y.sum(), 1) / max((1 - y).sum(), 1)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    by_column = np.argsort(column, kind="stable").astype(np.int32)
    margins = _Sums(owner, column.astype(np.int32), rows)
    slopes = _Sums(column[by_column], owner[by_column].astype(np.int32), width)
    del by_column
    for step in range(1, steps + 1):
        margin = bias + margins.of(weight * scale)
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / max(rows, 1)
        grad = np.append(scale * slopes.of(slope) + decay * weight, slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weight -= move[:-1]
        bias -= move[-1]
    return weight, bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1 from whole texts; a null text is empty, an empty one scores by the bias.

    Repeated rows get equal scores and an empty table gives an empty result. All columns are kept but one
    called score, which is replaced. The model goes to the workers as its kept slots, bounded by the table.
    """
    spark = docs.sparkSession
    docs = docs.drop("score")
    slots = np.flatnonzero(model.weight).astype(np.uint32)
    sent = spark.sparkContext.broadcast((slots, model.weight[slots], model.bias))
    names = docs.columns
    schema = docs.withColumn("score", F.lit(0.0)).schema
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values, bias = sent.value
        kept = np.zeros(1 << BITS, dtype=bool)
        kept[slots] = True
        weight = np.zeros(1 << BITS, dtype=np.float64)
        weight[slots] = values
        for b in batches:
            margins = np.array([weight[features(t, kept)].sum() for t in b.column(text_at).to_pylist()]) + bias
            scores = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, schema)


def in_training(doc_id: str = "doc_id"):
    """Rows whose labels may be learned: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of the documents whose label may be learned.

    A document with several labels counts once for each of them, a repeated row as often as it stands there;
    null ids and ids without a label are left out, null texts are empty. Other columns are not read.
    """
    known = labels.where(in_training()).select("doc_id", "toxic").where("toxic is not null")
    return docs.select("doc_id", "text").join(sized_hint(written(known)), "doc_id")
