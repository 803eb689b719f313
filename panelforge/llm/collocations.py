"""Phrase collocations by Toivonen's sampling: a sample proposes, full passes count exactly until nothing is missed.

Texts are lower-cased in A to Z and split into pieces and words; a phrase is up to ``LONGEST`` words of one piece, counted by lang.
All phrases with a count of at least ``least`` are wanted, exactly counted.

1. Phrases of a sample of documents are counted level by level, a phrase only where the phrases without its first and without
   its last word are proposed; those that reach a lowered count are proposed.
2. A full pass counts proposed phrases by their words, and the phrases of the negative border, which are not proposed though both
   parts are, in slots of a 64-bit hash. A slot under ``least`` proves that none of its phrases is frequent.
3. Slots that reach ``least`` are failures of the border. A frequent phrase that is neither proposed nor of the border holds a smallest
   phrase that isn't proposed; that one is of the border and as frequent, so it failed. An expansion pass therefore counts by their words all phrases
   that hold a failure, of any length, and with that the result is closed, whatever the sample held.

Proposals are known to the tasks by a Bloom filter of at most ``FILTER_BITS`` bits, built by segments in Spark, so what is
broadcast has a bound at every size. A phrase that passes by chance is counted too and falls under ``least`` at the end.
Counts move as packed arrays by ranges of the hash, one row a range and task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, partitions, written

LONGEST = 4
#: One document of so many is in the sample; its share of ``least``, halved, is what a proposal must reach there.
SAMPLE_OF = 4
#: Bits of the filter of proposals, and of the segments in which it is built.
FILTER_BITS, SEGMENT_BITS = 1 << 30, 1 << 18
#: Words that a task holds before it counts them, and phrases and known words that it holds.
HELD_WORDS, HELD_PHRASES, KNOWN_WORDS = 800_000, 200_000, 300_000

_END = b"."
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def tokens(text: bytes | None) -> list[bytes]:
    """Words in order, with a full stop, which is no word, at the end of each piece."""
    return ((text or b"").translate(_PIECES).replace(_END, b" . ") + b" .").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> np.uint64(29))


def _probes(h: np.ndarray, segments: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The segment of each hash, and its three bits there."""
    x = _mixed(h * _B)
    mask = np.uint64(SEGMENT_BITS - 1)
    return ((h >> np.uint64(32)) & np.uint64(segments - 1)).astype(np.int64), [((x >> np.uint64(s)) & mask).astype(np.int64) for s in (0, 18, 36)]


def passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through: all that are in it, and few others."""
    segment, probes = _probes(h, len(bits) * 8 // SEGMENT_BITS)
    out = np.ones(len(h), dtype=bool)
    for p in probes:
        out &= (bits[segment * (SEGMENT_BITS // 8) + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


def filter_of(hashes: DataFrame, segments: int) -> np.ndarray:
    """The filter over ``hashes(h)``: Spark sets the bits by segments, and the driver puts these side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            h, own = b.column(1).to_numpy().view(np.uint64), b.column(0).to_numpy()
            _, probes = _probes(h, segments)
            for s in np.unique(own):
                if int(s) not in held and held:
                    yield from _segments(held)
                    held = {}
                bits = held.setdefault(int(s), np.zeros(SEGMENT_BITS, dtype=bool))
                for p in probes:
                    bits[p[own == s]] = True
        yield from _segments(held)

    placed = hashes.select(F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(segments - 1)).cast("int").alias("segment"), "h")
    rows = placed.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, bits binary")
    out = np.zeros(segments * SEGMENT_BITS // 8, dtype=np.uint8)
    for r in rows.collect():
        out[r["segment"] * (SEGMENT_BITS // 8) : (r["segment"] + 1) * (SEGMENT_BITS // 8)] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _segments(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if held:
        packed = [np.packbits(v, bitorder="little").tobytes() for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["segment", "bits"])


class _Known(dict):
    """Ids of words in the order in which they are met; 0 is the end of a piece."""

    def __init__(self):
        self.words: list[bytes] = []
        self[_END]  # noqa: B018

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.words)
        self.words.append(word)
        return out


def _dense(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One number for each different pair of numbers below 2**31."""
    return np.unique((x << 32) | y, return_inverse=True)[1]


def _first_places(a: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different phrase of ``n`` words that starts at ``at``, and how often it does; exact on ids."""
    if n == 1:
        key = a[at]
    elif n == 2:
        key = (a[at] << 32) | a[at + 1]
    elif n == 3:
        key = (_dense(a[at], a[at + 1]) << 32) | a[at + 2]
    else:
        key = (_dense(a[at], a[at + 1]) << 32) | _dense(a[at + 2], a[at + 3])
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return at[first], count


class Counter:
    """Counts of one task: phrases by their words, the border in hash slots."""

    def __init__(self, shards: int, proposed: np.ndarray | None, failed: np.ndarray | None, level: int | None):
        #: With a level, phrases of so many words go to slots (a sample's pass); with a filter of failures, what holds one is counted by words.
        self.shards, self.proposed, self.failed, self.level = shards, proposed, failed, level
        self.known, self.hashes, self.size = _Known(), np.zeros(0, dtype=np.uint64), 0
        self.held: dict[str, list[np.ndarray]] = defaultdict(list)
        self.phrases: dict[tuple[str, int], dict[bytes, list[int]]] = defaultdict(dict)
        self.n_phrases = 0

    def add(self, lang: str, text: bytes | None) -> Iterator[tuple]:
        words = tokens(text)
        self.held[lang].append(np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words)))
        self.size += len(words)
        if self.size >= HELD_WORDS:
            yield from self.count()

    def count(self) -> Iterator[tuple]:
        new = self.known.words[len(self.hashes) :]
        more = np.fromiter(map(xxhash.xxh3_64_intdigest, new), dtype=np.uint64, count=len(new))
        self.hashes = np.concatenate([self.hashes, more])
        slots: list[np.ndarray] = []
        for lang, arrays in self.held.items():
            a = np.concatenate(arrays)
            if self.failed is None:
                self._count(lang, a, slots)
            else:
                self._expand(lang, a)
        self.held.clear()
        self.size = 0
        h, c = np.unique(np.concatenate([*slots, np.zeros(0, dtype=np.uint64)]), return_counts=True)
        if len(h):
            yield from _by_shard(h, c, self.shards)
        if self.n_phrases >= HELD_PHRASES:
            yield from self.told()
        if len(self.known) >= KNOWN_WORDS:
            self.known, self.hashes = _Known(), np.zeros(0, dtype=np.uint64)

    def _levels(self, lang: str, a: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the hash at each place, and whether the phrase lies in one piece."""
        ok = a > 0
        h = _mixed(self.hashes[a] + np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
        yield 1, h, ok
        for n in range(2, (self.level or LONGEST) + 1):
            h = _mixed(h[:-1] * _B + self.hashes[a[n - 1 :]])
            ok = ok[:-1] & (a[n - 1 :] > 0)
            yield n, h, ok

    def _count(self, lang: str, a: np.ndarray, slots: list[np.ndarray]) -> None:
        """A sample's level, or the proposals by words and the border in slots."""
        inside = None
        for n, h, ok in self._levels(lang, a):
            eligible = ok if inside is None else inside[:-1] & inside[1:]
            if self.level == n:
                slots.append(h[eligible])
                return
            at = np.flatnonzero(eligible)
            at = at[passes(h[at], self.proposed)]
            inside = np.zeros(len(h), dtype=bool)
            inside[at] = True
            if self.level is None:
                slots.append(h[eligible & ~inside])
                self._named(lang, a, n, h, at)
        own = self.phrases[lang, 0]
        own[b""] = [len(lang) % self.shards, own.get(b"", [0, 0])[1] + int((a > 0).sum())]

    def _expand(self, lang: str, a: np.ndarray) -> None:
        """Phrases that hold a failure, but for those that the first pass counted by words."""
        hashes: list[np.ndarray] = []

        def counted(at: np.ndarray, n: int) -> np.ndarray:
            out = passes(hashes[n - 1][at], self.proposed)
            if n > 1 and len(at):
                out &= counted(at, n - 1) & counted(at + 1, n - 1)
            return out

        holds = None
        for n, h, ok in self._levels(lang, a):
            hashes.append(h)
            own = passes(h, self.failed) & ok
            holds = own if holds is None else (own | holds[:-1] | holds[1:]) & ok
            at = np.flatnonzero(holds)
            self._named(lang, a, n, h, at[~counted(at, n)])

    def _named(self, lang: str, a: np.ndarray, n: int, h: np.ndarray, at: np.ndarray) -> None:
        if not len(at):
            return
        first, count = _first_places(a, at, n)
        own, words = self.phrases[lang, n], self.known.words
        shard = ((h[first] >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)
        for ids, s, c in zip(np.stack([a[first + i] for i in range(n)], axis=1).tolist(), shard.tolist(), count.tolist()):
            phrase = b" ".join([words[i] for i in ids])
            if phrase in own:
                own[phrase][1] += c
            else:
                own[phrase] = [s, c]
                self.n_phrases += 1

    def told(self) -> Iterator[tuple]:
        """All phrases counted so far, as a row a range, lang and length, and none held after that."""
        for (lang, n), counts in self.phrases.items():
            dealt: dict[int, list] = defaultdict(list)
            for phrase, (shard, c) in counts.items():
                dealt[shard].append((phrase, c))
            for shard, rows in dealt.items():
                names, c = zip(*rows)
                yield shard, lang, n, b"\t".join(names), np.array(c, dtype="<i8").tobytes()
        self.phrases.clear()
        self.n_phrases = 0


def _by_shard(h: np.ndarray, c: np.ndarray, shards: int) -> Iterator[tuple]:
    """Sorted hashes and their counts, a row a range of hashes."""
    shard = (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for i, j in zip(edge, [*edge[1:], len(h)]):
        yield int(shard[i]), None, -1, h[i:j].tobytes(), c[i:j].astype("<u4").tobytes()


_PARTIAL = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_COUNTED = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.binary()), ("count", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, c = h[order], c[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[edge], np.add.reduceat(c, edge)


def counted(docs: DataFrame, least: int, proposed: np.ndarray | None, failed: np.ndarray | None = None, level: int | None = None) -> DataFrame:
    """One pass over ``docs(lang, text)``, written: slots with at least ``least`` (h), and phrases by their words with as many.

    With a ``level``, phrases of that length alone, in slots; with ``failed``, those that hold a failure. The row with n = 0 has all words of a lang.
    """
    spark = docs.sparkSession
    shards = partitions(spark)
    sent = spark.sparkContext.broadcast((proposed, failed))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Counter(shards, *sent.value, level)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows = list(task.add(lang, text.as_py()))
                if rows:
                    yield _batch(rows, _PARTIAL)
        yield _batch([*task.count(), *task.told()], _PARTIAL)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hs, cs, pending = None, [], [], 0
        names: dict[tuple, int] = defaultdict(int)

        def done() -> pa.RecordBatch:
            rows: list[tuple] = [(None, lang, n, phrase, c) for (lang, n, phrase), c in names.items() if c >= least or n == 0]
            if hs:
                h, c = _summed(np.concatenate(hs), np.concatenate(cs))
                rows += [(x, None, -1, None, None) for x in h[c >= least].view(np.int64).tolist()]
            return _batch(rows, _COUNTED)

        for b in batches:
            for shard, lang, n, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                if shard != at:
                    if at is not None:
                        yield done()
                    at, hs, cs, pending = shard, [], [], 0
                    names.clear()
                if n >= 0:
                    for phrase, c in zip(keys.split(b"\t"), np.frombuffer(counts, dtype="<i8").tolist()):
                        names[lang, n, phrase] += c
                else:
                    hs.append(np.frombuffer(keys, dtype=np.uint64))
                    cs.append(np.frombuffer(counts, dtype="<u4").astype(np.int64))
                    pending += len(hs[-1])
                    if pending > 2_000_000:  # sums take the place of what they sum
                        h, c = _summed(np.concatenate(hs), np.concatenate(cs))
                        hs, cs, pending = [h], [c], 0
        if at is not None:
            yield done()

    rows = docs.select("lang", "text").mapInArrow(scan, "shard int, lang string, n int, keys binary, counts binary")
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return written(dealt.mapInArrow(merge, "h long, lang string, n int, phrase binary, count long"))


def _segments_for(n: int) -> int:
    """Segments of a filter with 32 bits a proposal, within the bound."""
    wanted = max(1, -(-32 * n // SEGMENT_BITS))
    return min(FILTER_BITS // SEGMENT_BITS, 1 << (wanted - 1).bit_length())


def frequent_phrases(docs: DataFrame, least: int = 30, sample_of: int = SAMPLE_OF) -> DataFrame:
    """``lang, n, phrase, count``, written, of all phrases of ``docs(doc_id, lang, text)`` that occur ``least`` times in their lang, and a row with n = 0 a lang for all its words.

    A null lang is ``und``; null and empty texts have no phrases; repeated rows count each time; an empty table has no rows.
    """
    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"), F.col("doc_id"))
    sample = written(plain.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample_of)) == 0).select("lang", "text"))
    plain = plain.select("lang", "text")
    # Half of the sample's share of ``least``: what reaches ``least`` in all is seldom under it.
    lowered = max(2, least // sample_of // 2)
    proposals: list[DataFrame] = []
    proposed = None
    for level in range(1, LONGEST + 1):
        proposals.append(counted(sample, lowered, proposed, level=level))
        proposed = _filter(proposals)
    parts = [counted(plain, least, proposed)]
    failures = parts[0].where("h is not null")
    if failures.limit(1).count():
        parts.append(counted(plain, least, proposed, _filter([failures])))
    forget(sample, *proposals)
    named = parts[0].where("n >= 0")
    for p in parts[1:]:
        named = named.unionByName(p.where("n >= 0"))
    out = written(named.select("lang", "n", F.col("phrase").cast("string").alias("phrase"), "count"))
    forget(*parts)
    return out


def _filter(parts: list[DataFrame]) -> np.ndarray:
    """A filter over the slots of ``parts``."""
    hashes = parts[0].select("h")
    for p in parts[1:]:
        hashes = hashes.unionByName(p.select("h"))
    hashes = hashes.where("h is not null")
    return filter_of(hashes, _segments_for(hashes.count()))


def _ratio_floor(a: str, d: str) -> Column:
    """``floor(2000000 * a / d)`` by long division in thousands, exact for ``d`` below 4e15."""
    return F.expr(f"({a} * 2000 div {d}) * 1000 + ({a} * 2000 % {d}) * 1000 div {d}")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80) -> DataFrame:
    """Each lang's ``top`` phrases of 2 to 4 words by how much their words belong together.

    Returns lang, rank, phrase, a (its count), l and r (counts of its parts at the lowest-scoring cut), n (words of the lang) and score.
    A phrase is left out if ``percent`` of its count lie within one longer phrase. Order of ties: score, a, phrase. Null langs are
    ``und``, null and empty texts hold nothing, repeated rows count each time, texts are counted whole; empty tables give no rows,
    further columns aren't read.
    """
    all_phrases = frequent_phrases(docs, least)
    phrases = all_phrases.where("n > 0")
    w = F.split("phrase", " ")
    longer = phrases.where("n > 1").withColumn("w", w)
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    first, rest = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ")
    cuts = cuts.select("lang", "phrase", F.col("count").alias("a"), "k", first.alias("first"), rest.alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r"))
    both = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"])
    scored = both.withColumn("score", _ratio_floor("a", "(l + r)"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    spans = [(i, m) for m in range(2, LONGEST) for i in range(1, LONGEST - m + 2)]
    inner = F.array(*[F.when((F.col("n") > m) & (F.col("n") >= i + m - 1), F.array_join(F.slice("w", i, m), " ")) for i, m in spans])
    within = longer.select("lang", F.explode(inner).alias("phrase"), "count").where("phrase is not null").groupBy("lang", "phrase").agg(F.max("count").alias("inside"))
    kept = best.join(within.hint("merge"), ["lang", "phrase"], "left").where(F.col("inside").isNull() | (100 * F.col("inside") < percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = all_phrases.where("n = 0").groupBy("lang").agg(F.sum("count").alias("n"))
    return ranked.join(words.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
