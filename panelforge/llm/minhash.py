"""Near duplicates by MinHash: a signature-coordinate inverted join, confirmed on full shingle sets.

Every distinct shingle set gets a signature of ``COORDINATES`` minima. Two sets are compared on their full
sets where at least a number of coordinates agree, chosen from the threshold so that a pair exactly at
it has fewer with a probability under ``MISSED`` (pairs above it far less). Documents are posted under
coordinate-value pairs. If m of the coordinates must agree, COORDINATES - m can disagree, and so among
COORDINATES - m + 1 disjoint groups of coordinates one agrees as a whole: these groups are the prefix that
is posted, three coordinates together where so many groups fit, else two. The other coordinates are
never posted; they are skipped to and counted only for sets that met in the prefix.

Copies of a set are one class and post once. Three steps find the links. First each class meets the
smallest class of each of its postings. Then it meets the class of another component that agrees with it
most. Last, classes of one posting that agree enough and are still in different components hang together, each told by the
smallest class it hangs together with there. What hangs together is a cluster; its classes are dealt into blocks by their
own hash, and signatures and texts of every two blocks meet in one task, which finds the candidates there by their signatures,
confirms them on full sets, and gives back a spanning forest of the links. So neither pairs nor partners are ever
listed, and no link between components is passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, connected_components, forget, sized_hint, written

COORDINATES = 128
#: Probability with which a pair exactly at the threshold may fail to agree on enough coordinates.
MISSED = 1e-6

#: Classes of one posting that meet in one task at a time; classes of a cluster, and their shingles, in one block.
BLOCK = 1024
CELL, CELL_SHINGLES = 1024, 1 << 20

_MIX = np.uint64(0xFF51AFD7ED558CCD)


def prefix(percent: int) -> tuple[int, int, int]:
    """Coordinates that must agree at a threshold, groups that are posted, and coordinates of a group."""
    p, tail, m = percent / 100, 0.0, 0
    while m < COORDINATES:
        tail += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if tail > MISSED:
            break
        m += 1
    m = max(m, 1)
    groups = COORDINATES - m + 1
    return m, groups, max(1, min(3, COORDINATES // groups))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


_table = np.random.default_rng(20_240_607).integers(1, 2**63, size=256, dtype=np.uint64)
_SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.where(_SPACES, np.uint64(0), _table[_LOWER])
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0]


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text with fewer words is one shingle.

    Words are runs of bytes other than space and 9 to 13, with A to Z in lower case. No word: no shingle.
    """
    raw = np.frombuffer((text or "").encode(errors="replace"), dtype=np.uint8)
    space = _SPACES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    forward = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * forward[: len(raw)], out=total[1:])
    word = _mixed((total[stops] - total[starts]) * _powers[1][starts] + (stops - starts).astype(np.uint64))
    n = min(words, len(word))
    h = word[: len(word) - n + 1].copy()
    for k in range(1, n):
        h = _mixed(h * np.uint64(0xC4CEB9FE1A85EC53)) + word[k : len(word) - n + 1 + k]
    return np.unique(_mixed(h + np.uint64(n)))


_draw = np.random.default_rng(7)
_ODD = _draw.integers(0, 2**63, size=COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 2**63, size=COORDINATES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of ``COORDINATES`` hash functions over a set, as 32-bit values."""
    out = np.full(COORDINATES, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 1024):
        mixed = hashes[at : at + 1024, None] * _ODD[None, :] + _ADD[None, :]
        np.minimum(out, mixed.min(axis=0), out=out)
    return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, fp, n_shingles, node, sig``: the set's own 128-bit hash and signature; null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, nodes, sigs = [], [], []
            for text in b.column(2).to_pylist():
                h = shingles(text, words)
                counts.append(len(h))
                if len(h):
                    both = np.array([_mixed(h).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mixed(h + np.uint64(1)))])
                    nodes.append(both.tobytes())
                    sigs.append(signature(h).tobytes())
                else:
                    nodes.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "fp", "n_shingles", "node", "sig"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("fp"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long, n_shingles long, node binary, sig binary")


def _postings(classes: DataFrame, percent: int) -> DataFrame:
    """``place, key, node``: a class under each posted group of its coordinates, as a 64-bit key."""
    _, groups, width = prefix(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(groups, dtype=np.int16)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            part = sig[:, : groups * width].reshape(len(sig), groups, width).astype(np.uint64)
            keys = _mixed(places.astype(np.uint64) + np.uint64(1)) + np.zeros((len(sig), groups), dtype=np.uint64)
            for k in range(width):
                keys = _mixed(keys * np.uint64(0xD6E8FEB86659FD93) + part[:, :, k])
            nodes = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), groups)))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(places, len(sig))), pa.array(keys.view(np.int64).ravel()), nodes], names=["place", "key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "place short, key long, node binary")


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree on enough coordinates and whose sizes allow a link."""
    least = prefix(percent)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            near = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    left = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    right = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    sized = both.where(F.col("n_a") * 100 >= F.col("n_b") * percent).where(F.col("n_b") * 100 >= F.col("n_a") * percent)
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def _met(shared: DataFrame, components: DataFrame, classes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Agreeing pairs of different components among the classes of each posting, each pair where it is first shared.

    With ``best`` rows ``node, partner, agree``: for each class of a posting the partner that agrees most.
    Else ``node, root``: a class and the smallest one that it hangs together with in the block. Postings of one component are left out before signatures are
    fetched. A posting is dealt into blocks, and every two blocks meet in one place, so no task holds more than two.
    """
    least, groups, width = prefix(percent)
    members = shared.select("place", "key", "node").join(components.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("one"), F.max("component").alias("two"))
    blocks = sizes.where("one <> two").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(classes.select("node", "n_shingles", "sig").hint("merge"), "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component", "n_shingles", "sig", "place"
    )
    placed = placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    names = ["node", "partner", "agree"] if best else ["node", "root"]
    kinds = [pa.binary(), pa.binary(), pa.int32()][: len(names)]

    def met(rows: list) -> Iterator[tuple]:
        parts = {c: i for i, c in enumerate(dict.fromkeys(r[5] for r in rows))}
        if len(parts) < 2:
            return
        sig = np.frombuffer(b"".join([r[7] for r in rows]), dtype=np.uint32).reshape(-1, COORDINATES)
        short = sig.astype(np.uint8)  # agrees wherever ``sig`` does
        part = np.array([parts[r[5]] for r in rows])
        own, n, place = np.array([r[3] for r in rows]), np.array([r[6] for r in rows]), rows[0][8]
        across = rows[0][1] != rows[0][2]
        nodes = [r[4] for r in rows]
        root, most, partner = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1)
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            like = np.bitwise_count(np.packbits(short[rest] == short[i], axis=1).view(np.uint64)).sum(axis=1)
            may = (like >= least) & (part[rest] != part[i]) & (n[rest] * 100 >= n[i] * percent) & (n[i] * 100 >= n[rest] * percent)
            if across:
                may &= own[rest] != own[i]
            at = np.flatnonzero(may) + i + 1
            if not len(at):
                continue
            same = sig[at] == sig[i]
            agree = same.sum(axis=1)
            first = same[:, : groups * width].reshape(len(at), groups, width).all(axis=2).argmax(axis=1) == place
            good = (agree >= least) & first
            at, agree = at[good], agree[good]
            if not len(at):
                continue
            if best:
                j = int(agree.argmax())
                if agree[j] > most[i]:
                    most[i], partner[i] = agree[j], at[j]
                more = agree > most[at]
                most[at[more]], partner[at[more]] = agree[more], i
                continue
            ends = np.append(root[at], root[i])
            root[np.isin(root, ends)] = ends.min()
        for i in range(len(rows)):
            if best and partner[i] >= 0:
                yield nodes[i], nodes[partner[i]], int(most[i])
            elif not best and root[i] != i:
                yield nodes[i], nodes[root[i]]

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            out: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += met(held)
                    held = []
                held.append(row)
            yield table(out)
        if held:
            yield table(list(met(held)))

    return placed.mapInArrow(run, "node binary, partner binary, agree int" if best else "node binary, root binary")


def _texts(classes: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` for the classes in ``nodes(node)``: the text of the document that stands for each; written."""
    wanted = written(classes.join(nodes.hint("merge"), "node").select("node", F.col("rep.id").alias("id"), F.col("rep.fp").alias("fp")))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("fp"), "text")
    texts = written(rows.join(sized_hint(wanted), ["id", "fp"]).dropDuplicates(["node"]).select("node", "text"))
    forget(wanted)
    return texts


def _resolved(candidates: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A spanning forest ``a, b`` of the links between components within the clusters of ``candidates(node, root)``, confirmed on full sets.

    Every two blocks of a cluster meet once, so a cluster of b blocks moves each of its texts b times, and a row back is a link.
    """
    least = prefix(percent)[0]
    clusters = connected_components(candidates.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "cluster")
    sized = written(clusters.join(classes.select("node", "n_shingles").hint("merge"), "node"))
    most = F.greatest(F.count("*") / CELL, F.sum("n_shingles") / CELL_SHINGLES)
    blocks = written(sized.groupBy("cluster").agg(F.ceil(most).cast("long").alias("blocks")))
    dealt = written(
        sized.select("node", "cluster")
        .join(blocks.hint("merge"), "cluster")
        .withColumn("own", F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long") % F.col("blocks"))
    )
    texts = _texts(classes, dealt.select("node"), docs)
    whole = dealt.join(components.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = whole.join(classes.select("node", "sig").hint("merge"), "node").join(texts.hint("merge"), "node")
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = whole.select("cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component", "sig", F.col("text").cast("binary").alias("body"))
    placed = placed.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node")

    def solved(rows: list) -> list[tuple[bytes, bytes]]:
        first = dict[bytes, int]()
        root = np.array([first.setdefault(r[5], i) for i, r in enumerate(rows)])  # what is linked already is one
        if len(first) < 2:
            return []
        nodes, own = [r[4] for r in rows], np.array([r[3] for r in rows])
        across = rows[0][1] != rows[0][2]
        sig = np.frombuffer(b"".join([r[6] for r in rows]), dtype=np.uint32).reshape(-1, COORDINATES)
        short = sig.astype(np.uint8)  # agrees wherever ``sig`` does
        found = [shingles(r[7].decode(errors="replace"), words) for r in rows]
        n = np.array([len(x) for x in found])
        stops = np.cumsum(n)
        _, flat = np.unique(np.concatenate(found), return_inverse=True)
        its = [flat[b - k : b] for b, k in zip(stops.tolist(), n.tolist())]
        mark = np.zeros(int(flat.max()) + 1, dtype=bool)
        out = []

        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            may = (root[rest] != root[i]) & (n[rest] * 100 >= n[i] * percent) & (n[i] * 100 >= n[rest] * percent)
            if across:
                may &= own[rest] != own[i]
            at = np.flatnonzero(may) + i + 1
            at = at[np.bitwise_count(np.packbits(short[at] == short[i], axis=1).view(np.uint64)).sum(axis=1) >= least]
            at = at[(sig[at] == sig[i]).sum(axis=1) >= least]
            if not len(at):
                continue
            mark[its[i]] = True
            for k in range(0, len(at), 256):
                some = at[k : k + 256]
                some = some[root[some] != root[i]]
                if not len(some):
                    continue
                borders = np.cumsum(n[some]) - n[some]
                both = np.add.reduceat(mark[np.concatenate([its[j] for j in some.tolist()])].astype(np.int64), borders)
                for j in some[100 * both >= percent * (n[i] + n[some] - both)].tolist():
                    if root[j] != root[i]:
                        out.append((nodes[i], nodes[j]))
                        root[root == max(root[i], root[j])] = min(root[i], root[j])
            mark[its[i]] = False
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            out: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += solved(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
        out = solved(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    forest = written(placed.mapInArrow(run, "a binary, b binary"))
    forget(clusters, sized, blocks, dealt, texts)
    return forest


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` that are links on their full sets; written."""
    pairs = written(pairs)
    texts = _texts(classes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            linked: list[bool] = []
            for key, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if last[0] != key:
                    last = (key, shingles(x, words))
                one, two = last[1], shingles(y, words)
                inter = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * inter >= percent * (len(one) + len(two) - inter))
            good = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")  # pairs of one ``a`` come one after the other
    out = written(both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"))
    forget(pairs, texts)
    return out


def _exhausted(shared: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between different components, as many as join all that can be joined."""
    candidates = written(_met(shared, components, classes, percent, best=False).distinct())
    if not candidates.limit(1).count():
        return candidates.select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = _resolved(candidates, components, classes, docs, words, percent)
    forget(candidates)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text)``.

    Rows are linked where 100 * intersection >= ``percent`` * union of their shingle sets, of ``words``
    words each. A component's id is the smallest doc_id in it; ``kept`` marks rows with that id. Null
    and blank texts have no shingles and stand alone; a text with fewer words is one shingle; equal
    sets are linked; repeated rows get equal results; a null id counts as the smallest and is given
    back as null. Other columns are not read. An empty table gives an empty result.
    """
    sketches = written(_sketches(docs, words))
    rows = sketches.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    classes = written(
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct("id", "fp")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    )
    postings = written(_postings(classes, percent))
    centers = postings.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(postings.join(centers.hint("merge"), "key").where("node <> center"))
    forget(postings)
    star = shared.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = _confirmed(_agreeing(star, classes, percent), classes, docs, words, percent)
    components = connected_components(links)
    best = _met(shared, components, classes, percent, best=True).groupBy("node").agg(F.max_by("partner", F.struct("agree", "partner")).alias("b"))
    best = best.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    for step in (lambda: _confirmed(best, classes, docs, words, percent), lambda: _exhausted(shared, components, classes, docs, words, percent)):
        more = step()
        if more.limit(1).count():
            known = (links, more, components)
            links = written(links.unionByName(more))
            components = connected_components(links)
            forget(*known)
    forget(shared, links)
    ids = classes.select("node", F.col("rep.id").alias("id")).join(components.hint("merge"), "node", "left")
    ids = ids.withColumn("component", F.coalesce("component", "node"))
    smallest = ids.groupBy("component").agg(F.min("id").alias("least"))
    named = ids.join(smallest.hint("merge"), "component").select("node", "least")
    out = rows.join(named.hint("merge"), "node", "left").withColumn("least", F.coalesce("least", "id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("least") != NO_ID, F.col("least")).alias("component_id"),
        (F.col("id") == F.col("least")).alias("kept"),
    )
