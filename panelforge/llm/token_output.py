"""Token ids as Re-Pair compressed shards, written, read back and decoded at random places.

A shard holds documents in ascending id order. Within it the ids of all documents, each closed by the
end id, are compressed by Re-Pair: every round counts adjacent pairs exactly, gives each pair of at least
``LEAST`` occurrences a nonterminal and replaces it, the more frequent first where two overlap; rounds go
on until no pair is that frequent. After the first round only pairs next to a replaced one, and those
that lost an overlap, can be frequent, so only these are counted. A pair with the end id is never
replaced, so every document keeps a place of its own in the compressed sequence.

File format of a shard (little-endian): ``RPR2``; unsigned 32-bit numbers of documents, rounds, rules
and symbols, and bytes a symbol; document ids (64-bit, ``NO_ID`` for null); per document the tokens and
the place of its first symbol (32-bit); first symbol of each round's rules (32-bit); per rule its left
and right symbol and expansion length (32-bit); the low 16 bits of all symbols, then, where a symbol
needs them, bits 16 to 23 (8-bit), then bits 24 to 31 (8-bit). Expansion lengths lead a reader from a
token's position to its symbol and down the rules, so that any stretch of ids is decoded alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import NO_ID, partitions, written

MAGIC = b"RPR2"
#: Occurrences from which on a pair gets a nonterminal: a rule takes the space of about as many symbols.
LEAST = 12

_MANY = 2**22


def _ranked(pairs: np.ndarray, values: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``pairs`` of those among ``values``, their ranks, and the places of others in their slots.

    Of values that share a slot the most frequent is found; the others wait for the next round.
    """
    bits = max(12, min(20, 4 + int(len(values)).bit_length()))
    slot = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    table = np.full(1 << bits, -1, dtype=np.int32)
    by_rank = np.argsort(-rank)
    table[slot(values[by_rank])] = by_rank  # the most frequent of a slot is put in last
    of = table[slot(pairs)]
    at = np.flatnonzero(of >= 0)
    of = of[at]
    same = values[of] == pairs[at]
    return at[same], rank[of[same]], at[~same]


def compress(ids: np.ndarray, end: int, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over ``ids``: symbols, first symbol of each round, left and right sides of all rules."""
    seq, symbol, firsts, lefts, rights = ids.astype(np.uint32), vocabulary, [], [], []
    hot = np.ones(len(seq), dtype=bool)  # a frequent pair may start here
    while len(seq) > 1:
        at = np.flatnonzero(hot[:-1])
        left, right = seq[at], seq[at + 1]
        inner = (left != end) & (right != end)
        at = at[inner]
        pairs = left[inner].astype(np.uint64) << np.uint64(32)
        pairs |= right[inner]
        ordered = np.sort(pairs)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.concatenate([starts, [len(ordered)]]))
        frequent = counts >= least
        if not frequent.any():
            break
        values, counts = ordered[starts[frequent]], counts[frequent]
        rank = np.empty(len(values), dtype=np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(values), dtype=np.int32)
        found, r, missed = _ranked(pairs, values, rank)
        places = at[found]
        near = np.diff(places) == 1
        equal = near & (r[1:] == r[:-1])  # of a run of one symbol every second pair
        order = np.arange(len(r))
        run = np.maximum.accumulate(np.where(np.concatenate([[True], ~equal]), order, 0))
        taken = (order - run) % 2 == 0
        taken[1:] &= ~(near & (r[:-1] < r[1:]))
        taken[:-1] &= ~(near & (r[1:] < r[:-1]))
        done = np.bincount(r[taken], minlength=len(values))
        rules = np.flatnonzero(done >= max(2, least // 4))
        number = np.full(len(values), -1, dtype=np.int64)
        number[rules] = symbol + np.arange(len(rules))
        taken &= number[r] >= 0
        where = places[taken]
        of = np.empty(len(values), dtype=np.int64)
        of[rank] = np.arange(len(values))
        firsts.append(symbol)
        lefts.append((values[of[rules]] >> np.uint64(32)).astype(np.uint32))
        rights.append(values[of[rules]].astype(np.uint32))
        symbol += len(rules)
        seq[where] = number[r[taken]].astype(np.uint32)
        # counts only fall where nothing changes, so pairs that were under ``least`` stay there
        hot[:] = False
        hot[places] = True
        if len(found) < counts.sum():
            hot[at[missed]] = True
        hot[where] = True
        hot[where - 1] = True
        keep = np.ones(len(seq), dtype=bool)
        keep[where + 1] = False
        seq, hot = seq[keep], hot[keep]
    none = np.zeros(0, dtype=np.uint32)
    return seq, np.array(firsts, dtype=np.uint32), np.concatenate([none, *lefts]), np.concatenate([none, *rights])


class Rules:
    """What the nonterminals of a shard stand for."""

    def __init__(self, firsts: np.ndarray, left: np.ndarray, right: np.ndarray, spans: np.ndarray):
        self.first = int(firsts[0]) if len(firsts) else 2**32 - 1
        self.left, self.right, self.spans = left, right, spans.astype(np.int64)
        self.rounds = [*firsts[1:].tolist(), self.first + len(left)] if len(firsts) else []
        self.flat = self.starts = None

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), dtype=np.int64)
        at = np.flatnonzero(symbols >= self.first)
        out[at] = self.spans[symbols[at] - np.uint32(self.first)]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for, round by round from the last."""
        for stop in reversed([self.first, *self.rounds[:-1]] if self.rounds else []):
            at = np.flatnonzero(symbols >= stop)
            if len(at):
                rules = symbols[at] - np.uint32(self.first)
                times = np.ones(len(symbols), dtype=np.int64)
                times[at] = 2
                symbols = np.repeat(symbols, times)
                at = at + np.arange(len(at))
                symbols[at], symbols[at + 1] = self.left[rules], self.right[rules]
        return symbols

    def expand_all(self, symbols: np.ndarray) -> np.ndarray:
        """The same, by what every rule stands for, each written out once; round by round if that is long."""
        if int(self.spans.sum()) > _MANY:
            return self.expand(symbols)
        if self.flat is None:
            self.starts = np.cumsum(self.spans) - self.spans
            self.flat = np.zeros(int(self.spans.sum()), dtype=np.uint32)
            begin = self.first
            for stop in self.rounds:
                rules = slice(begin - self.first, stop - self.first)
                sides = np.stack([self.left[rules], self.right[rules]], axis=1).ravel()
                a, b = int(self.starts[rules.start]), int(self.starts[rules.stop]) if rules.stop < len(self.starts) else len(self.flat)
                self.flat[a:b] = self._written(sides)
                begin = stop
        return self._written(symbols)

    def _written(self, symbols: np.ndarray) -> np.ndarray:
        spans = self.lengths(symbols)
        stops = np.cumsum(spans)
        out = np.repeat(symbols, spans)
        at = np.flatnonzero(out >= self.first)
        rules = out[at] - np.uint32(self.first)
        out[at] = self.flat[self.starts[rules] + at - np.repeat(stops - spans, spans)[at]]
        return out


def _lengths(firsts: np.ndarray, left: np.ndarray, right: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each rule expands to; a rule refers to earlier rounds only."""
    spans = np.ones(vocabulary + len(left), dtype=np.int64)
    stops = [*firsts[1:].tolist(), vocabulary + len(left)]
    for first, stop in zip(firsts.tolist(), stops):
        rules = slice(first - vocabulary, stop - vocabulary)
        spans[first:stop] = spans[left[rules]] + spans[right[rules]]
    return spans[vocabulary:]


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray], end: int, vocabulary: int) -> bytes:
    """``ids`` are those of each document with the end id."""
    tokens = np.array([len(x) for x in ids], dtype="<u4")
    seq, firsts, left, right = compress(np.concatenate(ids), end, vocabulary)
    spans = _lengths(firsts, left, right, vocabulary)
    closes = np.flatnonzero(seq == end)  # an end id inside a document is as good a border as any
    if len(closes) != len(ids):
        reached = np.cumsum(Rules(firsts, left, right, spans).lengths(seq))
        closes = np.searchsorted(reached, np.cumsum(tokens, dtype=np.int64))
    places = np.concatenate([[0], closes[:-1] + 1])
    top = vocabulary + len(left)
    width = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
    return b"".join(
        [
            MAGIC,
            struct.pack("<5I", len(ids), len(firsts), len(left), len(seq), width),
            np.array([NO_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
            tokens.tobytes(),
            places.astype("<u4").tobytes(),
            firsts.astype("<u4").tobytes(),
            left.astype("<u4").tobytes(),
            right.astype("<u4").tobytes(),
            spans.astype("<u4").tobytes(),
            (seq & np.uint32(0xFFFF)).astype("<u2").tobytes(),
            *((seq >> np.uint32(shift)).astype(np.uint8).tobytes() for shift in (16, 24)[: width - 2]),
        ]
    )


class Shard:
    """A shard as read: ``ids(i)`` decodes document ``i`` alone, ``some(i, start, stop)`` a stretch of it, ``all_ids()`` the whole shard."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        docs, rounds, rules, symbols, width = struct.unpack_from("<5I", raw, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.doc_ids, self.tokens, self.places = take("<i8", docs), take("<u4", docs), take("<u4", docs)
        self.rules = Rules(take("<u4", rounds), take("<u4", rules), take("<u4", rules), take("<u4", rules))
        self.symbols = take("<u2", symbols).astype(np.uint32)
        for shift in (16, 24)[: width - 2]:
            self.symbols |= take("u1", symbols).astype(np.uint32) << np.uint32(shift)

    def _symbols(self, i: int) -> np.ndarray:
        stop = self.places[i + 1] if i + 1 < len(self.places) else len(self.symbols)
        return self.symbols[self.places[i] : stop]

    def ids(self, i: int) -> np.ndarray:
        return self.rules.expand(self._symbols(i))

    def some(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``i``: its symbols are found by their expansion lengths, and what lies outside isn't decoded."""
        symbols, rules = self._symbols(i), self.rules
        reached = np.cumsum(rules.lengths(symbols))
        stop = min(stop, int(reached[-1]))
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        a, b = int(np.searchsorted(reached, start, "right")), int(np.searchsorted(reached, stop, "left"))
        at = int(reached[a - 1]) if a else 0
        todo = []
        for s in symbols[a : b + 1].tolist():
            todo.append((s, at))
            at += int(rules.spans[s - rules.first]) if s >= rules.first else 1
        todo.reverse()
        out: list[np.ndarray] = []
        while todo:
            s, at = todo.pop()
            n = int(rules.spans[s - rules.first]) if s >= rules.first else 1
            if start <= at and at + n <= stop:
                out.append(rules.expand(np.array([s], dtype=np.uint32)))
            elif at < stop and at + n > start:
                left, right = int(rules.left[s - rules.first]), int(rules.right[s - rules.first])
                middle = at + (int(rules.spans[left - rules.first]) if left >= rules.first else 1)
                todo += [(right, middle), (left, at)]
        return np.concatenate(out)

    def all_ids(self) -> np.ndarray:
        return self.rules.expand_all(self.symbols)


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 2, vocabulary: int = 50_257, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending id order into shards of about ``shard_tokens`` ids.

    Returns the written table of shards: ``part, shard, n_docs, n_tokens, payload``. Parts are ranges
    of ids in order, shards are numbered within a part. A null text is empty, a null id comes first,
    rows of one id are ordered by text; an empty table gives no shards.
    """
    spark = docs.sparkSession
    schema = "part int, shard int, n_docs long, n_tokens long, payload binary"
    fields = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        close = np.array([end], dtype="<u4")
        keys: list = []
        ids: list = []
        held = number = 0

        def row() -> pa.RecordBatch:
            payload = write_shard(keys, ids, end, vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((part, number, len(ids), held, payload), fields)], schema=fields)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                ids.append(np.concatenate([encode(text), close]))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield row()
                    keys, ids, held, number = [], [], 0, number + 1
        if ids:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(shards, schema))


def read_tokens(shards: DataFrame) -> DataFrame:
    """Decode written shards: ``doc_id, start, n_tokens, ids_crc32`` of every document.

    ``start`` counts the ids of all documents before it. The offsets of parts are a running sum over
    one row a part; there are as many parts as write tasks, so that table is small at any input size.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shard = Shard(raw)
                ids = shard.all_ids().astype("<u4")
                stops = np.cumsum(shard.tokens, dtype=np.int64)
                starts = stops - shard.tokens
                data = ids.tobytes()
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(crcs), pa.int32()),
                        pa.array([number] * len(crcs), pa.int32()),
                        pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NO_ID),
                        pa.array(starts, pa.int64()),
                        pa.array(shard.tokens.astype(np.int64), pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("part", "shard", "payload").mapInArrow(decode, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        shards.select("part", "shard", "n_tokens")
        .withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(F.broadcast(parts), "part")
        .select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    )
    return docs.join(places.hint("merge"), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
