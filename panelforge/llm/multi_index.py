"""Near-duplicate vectors by an inverted multi-index.

Each half of a vector has a codebook of its own, fitted on a bounded sample; the product of the two is
a grid of cells and every vector lies in the cell of its nearest codewords. A vector visits cells in
the order of their distance, the sum of both halves' distances, by multi-sequence traversal, until the
target recall: as many cells as lead from a vector to others at the threshold itself, measured on the
sample. All vectors of visited cells are verified by cosine in double precision.

Equal vectors are one class. Each pair of classes is verified in one place only and counted there, so
pairs are never listed; what leaves a task is a count for each class and a spanning forest of its links.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, connected_components, forget, written

#: Vectors of a cell that meet in one task at a time.
BLOCK = 1024


@dataclass
class Index:
    """Codebooks of both halves and the number of cells that a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squares(unit[:, :half], self.first), _squares(unit[:, half:], self.second)

    def home(self, unit: np.ndarray) -> np.ndarray:
        one, two = self.distances(unit)
        return one.argmin(axis=1) * len(self.second) + two.argmin(axis=1)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]


def _codebook(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    centers = x[rng.choice(len(x), size=size, replace=len(x) < size)]
    for _ in range(rounds):
        near = _squares(x, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=size)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), size=size)])
    return centers


def traverse(one: np.ndarray, two: np.ndarray, visits: int) -> list[int]:
    """The ``visits`` nearest cells of a grid with distances ``one[i] + two[j]``, nearest first."""
    rows, columns = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    a, b = one[rows].tolist(), two[columns].tolist()
    width = len(b)
    heap = [(a[0] + b[0], 0, 0)]
    out: list[int] = []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(rows[i] * width + columns[j])
        if j + 1 < width:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def fit(sample: np.ndarray, rows: int, threshold: float, recall: float = 0.995, seed: int = 0) -> Index:
    """Codebooks from unit vectors; cells hold about 64 of all ``rows`` vectors, a codebook an eighth of the sample at most."""
    rng = np.random.default_rng(seed)
    size = int(max(4, min(np.sqrt(rows / 64), len(sample) / 8)))
    half = sample.shape[1] // 2
    index = Index(_codebook(sample[:, :half], size, rng), _codebook(sample[:, half:], size, rng), size * size)
    probes = sample[rng.choice(len(sample), size=min(len(sample), 1000), replace=False)]
    aside = rng.normal(size=probes.shape)
    aside -= (aside * probes).sum(axis=1)[:, None] * probes
    aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-300)[:, None]
    near = index.home(threshold * probes + np.sqrt(max(0.0, 1 - threshold**2)) * aside)
    one, two = index.distances(probes)
    bound = one[np.arange(len(near)), near // size] + two[np.arange(len(near)), near % size]
    ranks = np.array([np.searchsorted(np.sort(y), t - x).sum() + 1 for x, y, t in zip(one, two, bound)])
    # a pair is met if either of the two visits the other's cell
    index.visits = int(np.quantile(ranks, 1 - np.sqrt(1 - recall), method="higher"))
    return index


def _unit(raw: np.ndarray) -> np.ndarray:
    norms = np.sqrt((raw * raw).sum(axis=1))
    return raw / norms[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph with edges a[i], b[i]."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _verified(rows: dict[str, np.ndarray], threshold: float, same_block: bool):
    """Within one block, or two, of a cell: who links with whom, each pair of classes in one place."""
    home = np.flatnonzero(rows["home"] == rows["cell"])
    if not len(home):
        return None
    unit, n = rows["unit"], rows["n"]
    counts = np.zeros(len(n), dtype=np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    cell = rows["cell"][0]
    for at in range(0, len(n), 256):
        part = np.arange(at, min(at + 256, len(n)))
        near = unit[part] @ unit[home].T >= threshold
        near &= rows["rep"][part][:, None] != rows["rep"][home][None, :]
        if not same_block:
            near &= rows["own"][part][:, None] != rows["own"][home][None, :]
        at_home = rows["home"][part] == cell
        near[at_home] &= rows["rep"][part[at_home]][:, None] < rows["rep"][home][None, :]
        for i in np.flatnonzero(~at_home & near.any(axis=1)):
            from_ = rows["home"][part[i]]
            if from_ < cell:  # the other may visit this one's cell too; the pair then counts there
                near[i] &= ~(rows["visits"][home] == from_).any(axis=1)
        x, y = np.nonzero(near)
        if len(x):
            x, y = part[x], home[y]
            np.add.at(counts, x, n[y])
            np.add.at(counts, y, n[x])
            ends.append((rows["rep"][x], rows["rep"][y]))
    if not ends:
        return None
    return counts, _forest(*(np.concatenate(e) for e in zip(*ends)))


def links(vectors: DataFrame, threshold: float = 0.95, sample_rows: int = 20_000, recall: float = 0.995) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``.

    Null vectors, zero vectors, vectors with null or non-finite components and vectors of another
    length than most link with nothing. Equal vectors are linked with each other. Repeated rows count
    as vectors of their own; a null id counts as the smallest and is given back as null. Codebooks and
    the number of visited cells come from ``sample_rows`` vectors by hash of the id; all are indexed.
    """
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"  # then vectors move as such
    rows = vectors.select("vec_id", F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(good, F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast("float" if single else "double")).otherwise(x))))
    usual = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = usual["d"] if usual else 0
    rows = rows.withColumn("v", F.when(F.size("v") == width, F.col("v")))
    classes = written(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    total = classes.count()
    linked = None
    if total and width > 1:
        sample = classes.select("v").orderBy(F.xxhash64("id", "rep")).limit(sample_rows).toArrow().column("v").combine_chunks()
        index = fit(_unit(_matrix(sample)), total, threshold, recall)
        linked = _links(classes, index, threshold)
        edges = linked.where("b is not null").select(F.col("rep").alias("a"), "b")
        components = connected_components(edges)
    else:
        linked = classes.select("rep", F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("links"))
        components = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    counts = linked.where("b is null").groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(counts.hint("merge"), "rep", "left").join(components.hint("merge"), classes["rep"] == components["node"], "left")
    named = written(named.select("v", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    forget(classes, linked, components)
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(least.hint("merge"), "component").select("v", "n_links", "least")
    out = rows.join(named.hint("merge"), "v", "left").withColumn("least", F.coalesce("least", "id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("least") != NO_ID, F.col("least")).alias("component_id"),
        (F.col("id") == F.col("least")).alias("kept"),
    )


def _links(classes: DataFrame, index: Index, threshold: float) -> DataFrame:
    """``rep, b, links``: partial counts of links (b null) and edges of spanning forests (links null); written.

    Visits move as ids; a vector goes to the cells of its visits once the blocks of each cell are known.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(_matrix(b.column(1)))
            one, two = index.distances(unit)
            cells = np.array([traverse(x, y, index.visits) for x, y in zip(one, two)], dtype=np.int32).reshape(b.num_rows, -1)
            raw = [x.tobytes() for x in cells]
            at = pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), b.column(0).take(at), pa.array(raw, pa.binary()).take(at)], names=["cell", "rep", "visits"])

    visits = written(classes.select("rep", "v").mapInArrow(visit, "cell int, rep long, visits binary"))
    blocks = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = visits.join(blocks.hint("merge"), "cell").join(classes.select("rep", "n", "v").hint("merge"), "rep")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "n", "visits", "v")
    placed = placed.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "rep")

    def solved(held: list) -> pa.RecordBatch:
        cell, lo, hi, own, rep, n, seen, v = zip(*held)
        seen = np.frombuffer(b"".join(seen), dtype=np.int32).reshape(len(held), -1)
        rows = {"cell": np.array(cell), "own": np.array(own), "rep": np.array(rep), "n": np.array(n), "home": seen[:, 0], "visits": seen}
        rows["unit"] = _unit(np.array(v, dtype=np.float64))
        found = _verified(rows, threshold, lo[0] == hi[0])
        out: list[tuple] = []
        if found:
            counts, forest = found
            at = np.flatnonzero(counts)
            out = [(r, None, c) for r, c in zip(rows["rep"][at].tolist(), counts[at].tolist())] + [(x, y, None) for x, y in forest]
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield solved(held)
                    held = []
                held.append(row)
        if held:
            yield solved(held)

    found = written(placed.mapInArrow(run, "rep long, b long, links long"))
    forget(visits)
    return found
