"""Source divergence: how each source's terms differ from those of its lang's other sources, by two counting passes.

The first pass counts in how many documents of its lang each term stands; terms of at least ``least`` documents are kept, exactly.
The kept terms of a lang are sharded by hash, and every shard gets a minimal perfect hash (levels of bit arrays, in
which a key that is alone at its place on a level has it; the few that never are come last) with its keys in slot order.
The second pass looks terms up there, compares the stored key, and increments a dense row of slots for each group that the task meets.

What is broadcast is bounded: shards of the terms with the most documents, up to ``SHARD_BYTES``. Terms beyond that bound
are rare ones, which tasks add up by group and term; these go to their shards' tasks and are looked up there. So one
scan counts every kept term at any size of the vocabulary.

Counts then meet by lang, shard and block of sources, where the shares of all groups of two blocks, of terms absent from a group
too, are compared slot by slot in 64-bit integers.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, partitions, written

#: Bytes of keys and their overhead in the broadcast, and what a key costs beside its bytes.
SHARD_BYTES, KEY_COST = 64_000_000, 32
#: Keys of a shard, and sources of a block, on average.
SHARD_KEYS, BLOCK_SOURCES = 4096, 128
#: Terms and slots that a task holds before it gives them out; ways in which a shard's counts are added up before they meet.
HELD_TERMS, HELD_SLOTS, SALTS = 1_000_000, 10_000_000, 8
#: One share in so many; the first ranks of terms that are told.
WHOLE, TOLD = 1_000_000_000, 200

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))
_LEVELS = 24


def terms(text: bytes | None) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A to Z in lower case."""
    return (text or b"").translate(_TERMS).split()


def hashed(keys: list[bytes]) -> np.ndarray:
    """The hash that Spark's ``xxhash64`` gives these bytes."""
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), dtype=np.uint64, count=len(keys))


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n keys, one each; a key that isn't among them has slot -1."""

    def __init__(self, sizes: list[int], bits: bytes, keys: bytes):
        self.keys = bytes(keys).split(b" ") if keys else []
        self.sizes, self.levels, self.ranks = sizes, [], []
        at = base = 0
        for size in sizes:
            own = np.unpackbits(np.frombuffer(bits[at : at + size // 8], dtype=np.uint8), bitorder="little").astype(bool)
            self.levels.append(own)
            self.ranks.append((np.cumsum(own) - 1 + base).astype(np.int32))
            at, base = at + size // 8, base + int(own.sum())
        self.last = {k: i for i, k in enumerate(self.keys[base:], start=base)}

    @staticmethod
    def built(keys: list[bytes]) -> tuple[list[int], bytes, bytes]:
        """Sizes of the levels, their bits, and the keys in slot order, for different keys without spaces."""
        h, left, sizes, bits, order = hashed(keys), np.arange(len(keys)), [], [], []
        while len(left) and len(sizes) < _LEVELS:
            size = -(-2 * len(left) // 8) * 8
            at = _place(h[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").tobytes())
            here = alone[at]
            order += left[here][np.argsort(at[here])].tolist()
            left = left[~here]
        order += left.tolist()
        return sizes, b"".join(bits), b" ".join([keys[i] for i in order])

    def slots(self, keys: list[bytes], h: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = _place(h[open_], level, size)
            found = self.levels[level][at]
            out[open_[found]] = self.ranks[level][at[found]]
            open_ = open_[~found]
            if not len(open_):
                break
        if self.last:
            for i in open_.tolist():
                out[i] = self.last.get(keys[i], -1)
        stored = self.keys
        wrong = [i for i, s in enumerate(out.tolist()) if s >= 0 and stored[s] != keys[i]]
        out[wrong] = -1
        return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``lang, term, df``: in how many rows of ``docs(lang, text)`` a term stands, by lang."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], schema=schema)
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = held[lang]
                before = len(own)
                own.update(set(terms(text.as_py())))
                size += len(own) - before
                if size >= HELD_TERMS:
                    yield from told()
                    size = 0
        yield from told()

    return docs.mapInArrow(run, "lang string, term binary, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def _broadcast_from(vocabulary: DataFrame, least: int, most_bytes: int) -> int:
    """Fewest documents of a term that is broadcast: all kept terms if they fit the bound, else a power of two."""
    cost = (F.octet_length("term") + KEY_COST).alias("cost")
    by_size = vocabulary.select(F.floor(F.log2("df")).cast("int").alias("k"), cost).groupBy("k").agg(F.sum("cost").alias("cost")).collect()
    total, out = 0, None
    for r in sorted(by_size, key=lambda r: -r["k"]):
        total += r["cost"]
        if total > most_bytes:
            return 1 << (r["k"] + 1) if out is None else out
        out = 1 << r["k"]
    return least


def _sharded(vocabulary: DataFrame, hot_from: int) -> tuple[DataFrame, DataFrame]:
    """The perfect hashes of all shards (lang, shard, hot, n, sizes, bits, keys), written, and their numbers by lang (v, hot_shards, shards)."""
    hot = F.col("df") >= hot_from
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.ceil(F.count_if(hot) / SHARD_KEYS).cast("int").alias("hot_shards"), F.ceil(F.count_if(~hot) / SHARD_KEYS).cast("int").alias("cold_shards"))
    langs = written(langs.select("lang", "v", "hot_shards", (F.col("hot_shards") + F.col("cold_shards")).alias("shards")))
    placed = vocabulary.join(langs.hint("merge"), "lang").select("lang", _shard(hot).alias("shard"), hot.alias("hot"), "term")
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("hot", pa.bool_()), ("n", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("keys", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys = None, []
        for b in batches:
            for *key, term in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    if at:
                        yield _batch([(*at, len(keys), *PerfectHash.built(keys))], schema)
                    at, keys = key, []
                keys.append(term)
        if at:
            yield _batch([(*at, len(keys), *PerfectHash.built(keys))], schema)

    dealt = placed.repartition(partitions(vocabulary.sparkSession), "lang", "shard").sortWithinPartitions("lang", "shard")
    return written(dealt.mapInArrow(run, "lang string, shard int, hot boolean, n int, sizes array<int>, bits binary, keys binary")), langs


def _shard(hot: Column) -> Column:
    """A term's shard in its lang: hot ones are numbered before the others."""
    high = F.shiftrightunsigned(F.xxhash64("term"), 32)
    return F.when(hot, F.pmod(high, F.greatest("hot_shards", F.lit(1)))).otherwise(F.col("hot_shards") + F.pmod(high, F.greatest(F.col("shards") - F.col("hot_shards"), F.lit(1)))).cast("int")


class Lookup:
    """The broadcast shards of all langs."""

    def __init__(self, rows: list[tuple]):
        self.shards: dict[str, list[PerfectHash]] = defaultdict(list)
        self.base: dict[str, np.ndarray] = {}
        for lang, _, *parts in sorted(rows, key=lambda r: r[:2]):
            self.shards[lang].append(PerfectHash(*parts))
        for lang, own in self.shards.items():
            self.base[lang] = np.concatenate([[0], np.cumsum([len(p.keys) for p in own])])

    def slots(self, lang: str, keys: list[bytes]) -> np.ndarray:
        """The dense slot of each key in its lang, -1 for one that isn't there."""
        own, h = self.shards.get(lang, []), hashed(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        if own:
            shard = ((h >> np.uint64(32)) % np.uint64(len(own))).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(len(own) + 1))
            for s, p in enumerate(own):
                at = order[edge[s] : edge[s + 1]]
                if len(at):
                    found = p.slots([keys[i] for i in at.tolist()], h[at])
                    out[at] = np.where(found >= 0, found + self.base[lang][s], -1)
        return out


_lookups: dict[str, Lookup] = {}
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary()), ("term", pa.binary()), ("count", pa.int64())])


def _recounted(docs: DataFrame, sent, cold: bool) -> DataFrame:
    """The second pass, written: slots and counts by group and shard, one row without a shard a group met, and with ``cold`` a row a term not found."""

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _lookups:  # once a worker
            _lookups.clear()
            _lookups[name] = Lookup(sent.value)
        lookup = _lookups[name]
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)
        dense: dict[tuple[str, str], np.ndarray] = {}
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            rows, slots = [], sum(map(len, dense.values()))
            for group, counts in held.items():
                lang, keys = group[0], list(counts)
                at = lookup.slots(lang, keys)
                c = np.fromiter(counts.values(), dtype=np.int64, count=len(keys))
                if group not in dense:
                    dense[group] = np.zeros(int(lookup.base[lang][-1]) if lang in lookup.base else 0, dtype=np.int64)
                    slots += len(dense[group])
                dense[group][at[at >= 0]] += c[at >= 0]
                if cold:
                    rows += [(*group, None, None, None, keys[i], int(c[i])) for i in np.flatnonzero(at < 0).tolist()]
                if slots >= HELD_SLOTS:
                    yield from told()
                    slots = 0
            held.clear()
            if rows:
                yield _batch(rows, _PARTIAL)

        def told() -> Iterator[pa.RecordBatch]:
            rows = []
            for group, counts in dense.items():
                rows.append((*group, None, None, None, None, None))
                at = np.flatnonzero(counts)
                base = lookup.base.get(group[0], np.zeros(1, dtype=np.int64))
                edge = np.searchsorted(at, base)
                for s, (i, j) in enumerate(zip(edge, edge[1:])):
                    if i < j:
                        rows.append((*group, s, (at[i:j] - base[s]).astype("<i4").tobytes(), counts[at[i:j]].tobytes(), None, None))
            dense.clear()
            yield _batch(rows, _PARTIAL)

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = held[lang, source]
                before = len(own)
                own.update(terms(text.as_py()))
                size += len(own) - before
                if size >= HELD_TERMS:
                    yield from settle()
                    size = 0
        yield from settle()
        yield from told()

    return written(docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, shard int, slots binary, counts binary, term binary, count long"))


def _added(sums: dict, key, slots: np.ndarray, counts: np.ndarray) -> None:
    held = sums.get(key)
    top = int(slots.max()) + 1 if len(slots) else 0
    if held is None or len(held) < top:
        more = np.zeros(max(top, SHARD_KEYS), dtype=np.int64)
        if held is not None:
            more[: len(held)] = held
        sums[key] = held = more
    np.add.at(held, slots, counts)


def _merged(partials: DataFrame, hashes: DataFrame, langs: DataFrame, cold: bool) -> DataFrame:
    """``lang, shard, source, total, slots, counts``, written: partial counts added up by shard in ``SALTS`` ways; a null source is the whole lang."""
    salt = F.pmod(F.xxhash64("source", F.spark_partition_id()), F.lit(SALTS)).cast("int").alias("salt")
    nothing = {"keys": F.lit(None).cast("binary"), "bits": F.lit(None).cast("binary"), "sizes": F.lit(None).cast("array<int>")}
    columns = ["lang", "shard", "salt", "kind", "source", "slots", "counts", "term", "count", "sizes", "bits", "keys"]
    rows = partials.where("shard is not null").select("*", salt, F.lit(1).alias("kind")).withColumns(nothing).select(*columns)
    if cold:
        # A term that isn't kept falls into a shard too, whose stored keys don't have it.
        rare = partials.where("term is not null").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
        rare = rare.join(langs.where("shards > hot_shards").hint("merge"), "lang").withColumn("shard", _shard(F.lit(False)))
        rare = rare.withColumns({**nothing, "slots": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")}).select("*", F.pmod(F.xxhash64("source", "term"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"))
        keyed = hashes.where("not hot").select("lang", "shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), "sizes", "bits", "keys")
        rows = rows.unionByName(rare.select(*columns)).unionByName(keyed, allowMissingColumns=True)
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("source", pa.string()), ("total", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, own, waiting = None, {}, None, defaultdict(dict)

        def done() -> pa.RecordBatch:
            for source, counts in waiting.items():
                keys = list(counts)
                found = own.slots(keys, hashed(keys)) if own else np.full(len(keys), -1)
                c = np.fromiter(counts.values(), dtype=np.int64, count=len(keys))
                if (found >= 0).any():
                    _added(sums, source, found[found >= 0], c[found >= 0])
            waiting.clear()
            whole: dict = {}
            for counts in sums.values():
                _added(whole, None, np.arange(len(counts)), counts)
            out = []
            for source, counts in [*sums.items(), *whole.items()]:
                s = np.flatnonzero(counts)
                out.append((at[0], at[1], source, int(counts.sum()), s.astype("<i4").tobytes(), counts[s].tobytes()))
            return _batch(out, schema)

        for b in batches:
            for lang, shard, salt, kind, source, slots, counts, term, count, sizes, bits, keys in zip(*(c.to_pylist() for c in b.columns)):
                if (lang, shard, salt) != at:
                    if at and (sums or waiting):
                        yield done()
                    at, sums, own = (lang, shard, salt), {}, None
                    waiting.clear()
                if kind == 0:
                    own = PerfectHash(sizes, bits, keys)
                elif term is not None:
                    waiting[source][term] = waiting[source].get(term, 0) + count
                else:
                    _added(sums, source, np.frombuffer(slots, dtype="<i4"), np.frombuffer(counts, dtype=np.int64))
        if at and (sums or waiting):
            yield done()

    dealt = rows.repartition(partitions(partials.sparkSession), "lang", "shard", "salt").sortWithinPartitions("lang", "shard", "salt", "kind")
    return written(dealt.mapInArrow(run, "lang string, shard int, source string, total long, slots binary, counts binary"))


def share(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """``1 + floor(WHOLE * (count + 1) / (n + v))`` by long division in thousands, exact while ``n + v`` is below 9e15."""
    d, rest, out = np.int64(n + v), count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // d
        rest = rest % d
    return out + 1


def _better(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:TOLD]


class _Unit:
    """One shard of a lang under two blocks of sources."""

    def __init__(self):
        self.n, self.keys, self.groups, self.counts = 0, [], {}, {}

    def shares(self) -> dict[str | None, np.ndarray]:
        out = {}
        for source, (_, n, v) in self.groups.items():
            c = np.zeros(self.n, dtype=np.int64)
            held = self.counts.get(source)
            if held is not None:
                c[: min(self.n, len(held))] = held[: self.n]
            self.counts[source] = c
            out[source] = share(c, n, v)
        return out

    def compare(self, lo: int, hi: int, pairs: dict, best: dict) -> None:
        p = self.shares()
        sides = {side: [s for s, (block, _, _) in self.groups.items() if s is not None and block == side] for side in {lo, hi}}
        other = np.stack([p[s] for s in sides[hi]]) if sides[hi] else None
        for a in sides[lo]:
            if other is not None:
                gap = p[a] - other
                gap *= gap
                there, back = (gap // other).sum(axis=1), (gap // p[a]).sum(axis=1)
                for b, x, y in zip(sides[hi], there.tolist(), back.tolist()):
                    if a != b:
                        pairs[a, b] += x
                        if lo != hi:
                            pairs[b, a] += y
            if lo == hi:
                q = p[None]
                at = np.flatnonzero((self.counts[a] > 0) & (p[a] > q))
                if len(at):
                    gap = p[a][at] - q[at]
                    f = gap * gap // q[at]
                    if len(f) > TOLD:
                        keep = f >= np.partition(f, len(f) - TOLD)[len(f) - TOLD]
                        at, f = at[keep], f[keep]
                    best[a] = _better([*best.get(a, []), *((x, self.keys[i]) for i, x in zip(at.tolist(), f.tolist()))])


def _compared(counts: DataFrame, hashes: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """``lang, source, item, term, value``, written: sums of pairs (item), to be added up, and the best terms of parts of the shards (term)."""
    block = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.col("blocks")).cast("int")
    blocked = groups.join(langs.hint("merge"), "lang").withColumn("block", F.when(F.col("source").isNotNull(), block))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    columns = ["lang", "lo", "hi", "shard", "kind", "source", "block", "n", "v", "slots", "counts", "keys"]

    def met(df: DataFrame, kind: int) -> DataFrame:
        """Rows at every pair of blocks that has theirs; those of a whole lang where a block meets itself."""
        df = df.withColumn("other", F.explode(others)).withColumn("block_", F.coalesce("block", "other"))
        at = {"lo": F.least("block_", "other"), "hi": F.greatest("block_", "other"), "kind": F.lit(kind)}
        return df.withColumns(at).select(*[c for c in columns if c in df.columns or c in at])

    headers = met(blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))), 1)
    at_blocks = blocked.select("lang", "source", "block", "blocks")
    joined = counts.join(at_blocks.hint("merge"), (counts.lang == at_blocks.lang) & counts.source.eqNullSafe(at_blocks.source))
    rows = met(joined.select(counts.lang, "shard", counts.source, "block", "blocks", "slots", "counts"), 2)
    keyed = hashes.join(langs.hint("merge"), "lang").withColumn("lo", F.explode(others)).withColumn("hi", F.explode(F.sequence("lo", F.col("blocks") - 1)))
    keyed = keyed.select("lang", "lo", "hi", "shard", F.lit(0).alias("kind"), F.col("n").cast("long").alias("n"), F.when(F.col("lo") == F.col("hi"), F.col("keys")).alias("keys"))
    union = headers.unionByName(rows, allowMissingColumns=True).unionByName(keyed, allowMissingColumns=True).select(*columns)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("term", pa.binary()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, unit = None, None, _Unit()
        pairs: dict = defaultdict(int)
        best: dict = {}

        def told() -> pa.RecordBatch:
            rows = [(at[0], a, b, None, x) for (a, b), x in pairs.items()]
            rows += [(at[0], a, None, term, f) for a, its in best.items() for f, term in its]
            pairs.clear()
            best.clear()
            return _batch(rows, schema)

        for b in batches:
            for lang, lo, hi, own_shard, kind, source, own_block, n, v, slots, counts_, keys in zip(*(c.to_pylist() for c in b.columns)):
                if (lang, lo, hi) != at or own_shard != shard:
                    if at:
                        unit.compare(at[1], at[2], pairs, best)
                        if (lang, lo, hi) != at:
                            yield told()
                    at, shard, unit = (lang, lo, hi), own_shard, _Unit()
                if kind == 0:
                    unit.n, unit.keys = n, keys.split(b" ") if keys else []
                elif kind == 1:
                    unit.groups[source] = (own_block, n, v)
                else:
                    _added(unit.counts, source, np.frombuffer(slots, dtype="<i4"), np.frombuffer(counts_, dtype=np.int64))
        if at:
            unit.compare(at[1], at[2], pairs, best)
            yield told()

    dealt = union.repartition(partitions(counts.sparkSession), "lang", "lo", "hi", "shard").sortWithinPartitions("lang", "lo", "hi", "shard", "kind")
    return written(dealt.mapInArrow(run, "lang string, source string, item string, term binary, value long"))


def divergences(docs: DataFrame, least: int = 3, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """Of every (lang, source) of ``docs(lang, source, text)``: how far the lang's other sources are from it, and its most telling terms.

    Returns lang, source, part, item, value and rank. Part ``pair`` has each other source of the lang with the sum of
    (p - q)² / q, rounded down, over all kept terms; part ``term`` the terms with p above the lang's, to rank 200. Null lang, source and
    text count as empty; a group without terms has pairs only; ties go by the bytes of the item; repeated rows are documents of
    their own; very long texts are counted whole; an empty table has no rows; further columns aren't read.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    vocabulary = written(document_frequencies(plain.select("lang", "text")).where(F.col("df") >= least))
    hot_from = _broadcast_from(vocabulary, least, most_bytes)
    hashes, langs = _sharded(vocabulary, hot_from)
    cold = hot_from > least
    shards = hashes.where("hot").select("lang", "shard", "sizes", "bits", "keys")
    # All hot shards of a lang have keys but by rare chance; an empty one stands for the missing.
    sent = spark.sparkContext.broadcast(_whole([tuple(r) for r in shards.collect()], {r["lang"]: r["hot_shards"] for r in langs.where("hot_shards > 0").collect()}))
    partials = _recounted(plain, sent, cold)
    counts = _merged(partials, hashes, langs, cold)
    seen = partials.where("shard is null").select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("n"))
    known = seen.join(totals.hint("merge"), ["lang", "source"], "left").unionByName(totals.where("source is null"))
    v = langs.select("lang", "v", "shards")
    groups = written(known.join(v.select("lang", "v").hint("merge"), "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    sized = groups.where("source is not null").groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"))
    found = _compared(counts, hashes, groups, written(v.select("lang", "shards").join(sized.hint("merge"), "lang")))
    forget(partials, counts, vocabulary)
    one = groups.where("source is not null").select("lang", "source")
    both = one.join(one.withColumnRenamed("source", "item").hint("merge"), "lang").where("source <> item")
    sums = found.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = both.join(sums.hint("merge"), ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    told = found.where("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    return ranked(pairs).unionByName(ranked(told).where(F.col("rank") <= TOLD))


def _whole(rows: list[tuple], shards: dict[str, int]) -> list[tuple]:
    """The shards of every lang, with empty ones where no key fell."""
    have = {r[:2] for r in rows}
    return rows + [(lang, s, [], b"", b"") for lang, n in shards.items() for s in range(n) if (lang, s) not in have]

