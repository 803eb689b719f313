"""Best-fit packing of token pieces with certified bin counts and exchange between partitions.

Each partition packs its pieces by best-fit decreasing. Dual feasible functions give a lower bound on
the bins that its pieces need; where the count equals the bound the partition is done, certified. Else
the pieces of its emptiest bins and of some others are packed again, as long as that gains.
Partitions with a gap hand the pieces of their emptiest bins to the next round, in which fewer
partitions receive the pieces of several, pack them together and are certified in turn. Each round
holds only what partitions exchange, which is a bounded number of bins a partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import written


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that ``lengths`` need at least: the largest of the bounds by dual feasible functions.

    The functions are the identity (total size) and, for each threshold t up to half a bin, the one
    that rounds pieces over capacity - t up to a bin and drops those under t.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    best = -(-int((count * sizes).sum()) // capacity)
    number, total = np.cumsum(count), np.cumsum(count * sizes)
    for t in range(1, capacity // 2 + 1):
        whole = number[capacity] - number[capacity - t]
        middle = total[capacity - t] - total[t - 1]
        best = max(best, int(whole) - (-int(middle) // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and what each bin holds."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # a bit for each room that some open bin has
    fill: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, dtype=np.int64)


def exact_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing bin by bin: each is closed by the one piece, or the two, that fill it exactly, if there are any."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]  # by length
    for i in range(len(lengths) - 1, -1, -1):
        left[int(lengths[i])].append(i)
    count = np.bincount(lengths, minlength=capacity + 1)
    sizes = sum(1 << n for n in np.flatnonzero(count).tolist())  # a bit for each length that is left
    fill: list[int] = []

    def put(n: int) -> None:
        nonlocal sizes
        i = left[n].pop()
        bins[i], offsets[i] = len(fill) - 1, fill[-1]
        fill[-1] += n
        count[n] -= 1
        if not count[n]:
            sizes &= ~(1 << n)

    while sizes:
        fill.append(0)
        put(sizes.bit_length() - 1)
        while room := capacity - fill[-1]:
            fits = sizes & ((1 << (room + 1)) - 1)
            if not fits:
                break
            largest = fits.bit_length() - 1
            if largest < room:
                half = count[1:room]
                pairs = np.flatnonzero((half > 0) & (half[::-1] > 0))[::-1] + 1
                pair = next(((x, room - x) for x in pairs[:2].tolist() if x != room - x or count[x] > 1), None)
                if pair:
                    put(pair[0])
                    put(pair[1])
                    break
            put(largest)
    return bins, offsets, np.array(fill, dtype=np.int64)


def repack(lengths: np.ndarray, capacity: int, emptiest: int = 24, others: int = 100, tries: int = 240, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing, then packed again in parts until the lower bound certifies the count.

    Each time the pieces of the ``emptiest`` bins and of ``others`` at random are packed anew; what comes
    out stays if it has fewer bins, or as many and emptier ones. ``tries`` without gain end it.
    """
    bins, offsets, fill = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    rng = np.random.default_rng(seed)
    failed, n_bins = 0, len(fill)
    members = np.split(np.argsort(bins, kind="stable"), np.cumsum(np.bincount(bins, minlength=n_bins))[:-1]) if n_bins else []
    while n_bins > bound and failed < tries:
        order = np.argsort(fill, kind="stable")
        low, rest = order[:emptiest], order[emptiest:]
        picked = np.concatenate([low, rng.choice(rest, size=min(len(rest), others), replace=False)])
        items = np.concatenate([members[b] for b in picked.tolist()])
        failed += 1
        for method in (best_fit, exact_fit):
            new, at, filled = method(lengths[items], capacity)
            if len(filled) < len(picked) or len(filled) == len(picked) and np.sort(filled)[:8].sum() < fill[low[:8]].sum():
                if len(filled) < len(picked):
                    failed = 0
                offsets[items] = at
                kept = np.ones(n_bins, dtype=bool)
                kept[picked] = False
                parts = np.split(items[np.argsort(new, kind="stable")], np.cumsum(np.bincount(new))[:-1])
                members = [members[b] for b in np.flatnonzero(kept).tolist()] + parts
                fill = np.concatenate([fill[kept], filled])
                n_bins = len(fill)
                break
    for b, m in enumerate(members):
        bins[m] = b
    return bins, offsets, fill


def _packer(capacity: int, exchanged: int, last: bool):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece_key", kind="stable")
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        bins, offsets, fill = repack(lengths, capacity)
        handed = np.zeros(len(fill), dtype=bool)
        if not last and (len(fill) > lower_bound(lengths, capacity) or fill.min() < capacity // 2):
            handed[np.argsort(fill, kind="stable")[:exchanged]] = True
        first = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(first, bins, pdf["piece_key"].to_numpy())
        return pdf.drop(columns="_group").assign(sequence_id=first[bins], offset=offsets, open=handed[bins])

    return packed


def pack(pieces: DataFrame, capacity: int = 1024, group_rows: int = 50_000, exchanged: int = 8, fan_in: int = 16) -> DataFrame:
    """Pack ``pieces`` (any columns with ``length`` and a unique ``piece_key``) into few bins.

    Returns the columns with ``sequence_id`` (the smallest key in the bin) and ``offset``. A piece as
    long as a bin fills one alone.
    ``group_rows`` bounds what one task packs; a partition with a gap hands on the pieces of the
    ``exchanged`` emptiest bins, and ``fan_in`` partitions exchange with each other at a time. Ties are
    broken by ``piece_key``, an empty table gives an empty result, a piece longer than a bin raises.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    groups = max(1, -(-n // group_rows))
    full = pieces.where(F.col("length") >= capacity)
    done = [
        full.select(
            *names,
            F.col("piece_key").alias("sequence_id"),
            F.when(F.col("length") > capacity, F.raise_error(F.lit("a piece is longer than a bin")).cast("long")).otherwise(0).cast("long").alias("offset"),
        )
    ]
    schema = rest.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("open")).schema
    rest = rest.withColumn("_group", F.pmod(F.xxhash64("piece_key"), F.lit(groups)))
    while True:
        last = groups == 1

        out = written(rest.groupBy("_group").applyInPandas(_packer(capacity, exchanged, last), schema))
        done.append(out.where("not open").drop("open"))
        if last:
            break
        groups = -(-groups // fan_in)
        rest = out.where("open").select(*names, F.pmod(F.xxhash64("piece_key"), F.lit(groups)).alias("_group"))
    result = done[0]
    for other in done[1:]:
        result = result.unionByName(other)
    return result


def token_pieces(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32``, the first one short.

    A null or empty text is the end id alone.
    """
    spark = docs.sparkSession
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(tokenizer).encode, np.array([end], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([encode(text), close])
                data, n = ids.tobytes(), len(ids)
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                at = 0
                for k, stop in enumerate(stops):
                    rows.append((key, k, at, stop - at, zlib.crc32(data[4 * at : 4 * stop])))
                    at = stop
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Tokenise, cut and pack whole documents: the pieces with ``sequence_id`` and ``offset``.

    Repeated rows are packed as often as they stand in the table.
    """
    pieces = written(token_pieces(docs, tokenizer, end, capacity).withColumn("piece_key", F.monotonically_increasing_id()))
    return pack(pieces, capacity).drop("piece_key")
