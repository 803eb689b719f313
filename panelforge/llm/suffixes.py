"""Removal of repeated strings across a corpus by sorting suffixes, deep-shallow.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting every
suffix would move every text many times over. Instead each string of ``length`` bytes names one suffix
inside it, the one that starts with its smallest hashed ``gram`` bytes: equal strings name the same place,
so suffixes that no string names need no sorting, and about one in 150 does. Named suffixes with equal
grams meet in one group with what stands before and after them, as far as a string of ``length`` can
reach. Equal contexts, known by a hash of 128 bits, are counted before anything is moved to its group and
stand there once. The different contexts of a group are sorted by deep-shallow sorting, forwards and, for
what stands before, backwards: multikey quicksort to a shallow depth, then blind tries for those that
still share all of it. The common prefixes of neighbours in the two orders cut each order into classes
at every depth; two suffixes in one class of both orders share a string of ``length`` bytes.

``LARGEST`` bounds the memory of a task: of a group with more different contexts the classes are found by
hashes of the strings instead, counted over all tasks; the spans are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, forget, written

#: Different contexts of a group that one task sorts.
LARGEST = 50_000
#: Multikey quicksort compares this many bytes at once, up to this depth.
WORD, SHALLOW = 8, 64

_table = np.random.default_rng(41).integers(1, 2**63, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xC4CEB9FE1A85EC53)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _prefix_hash(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_table[raw] * _power(len(raw) + 1)[0][: len(raw)], out=total[1:])
    return total


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def named_suffixes(raw: np.ndarray, length: int, gram: int):
    """Places of the suffixes that the strings of a text name, their keys, both halves of their contexts' hashes, and their reaches."""
    total = _prefix_hash(raw)
    inverse = _power(len(raw) + 1)[1]
    n = len(raw) - gram + 1
    grams = _mixed((total[gram:] - total[:n]) * inverse[:n])
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    smallest = (sliding_minimum(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = smallest[np.concatenate([[True], np.diff(smallest) != 0])]
    left = np.minimum(at, length - gram)
    right = np.minimum(len(raw) - at, length)
    view = memoryview(raw)
    digests = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip((at - left).tolist(), (at + right).tolist())])
    context, check = np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T
    return at, grams[at].view(np.int64), (context + left.astype(np.uint64) * _ODD).view(np.int64), check.view(np.int64), left, right


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """``group`` in the order of its strings, by a trie that knows branching places only.

    A leaf is a list of equal strings; an inner node is a tuple of its depth and its branches by byte
    (-1: the string ends). A string is led down by branching bytes alone, compared once with the leaf
    it reaches, and put in where the two part.
    """
    root: list | tuple = [group[0]]
    for i in group[1:]:
        s = strings[i]
        path: list[tuple] = []
        node = root
        while isinstance(node, tuple):
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            continue
        mine = s[depth] if depth < len(s) else -1
        theirs = other[depth] if depth < len(other) else -1
        while path and path[-1][0] > depth:
            node = path.pop()
        if path and path[-1][0] == depth:
            path[-1][1][mine] = [i]
            continue
        new = (depth, {theirs: node, mine: [i]})
        if path:
            up = path[-1]
            up[1][s[up[0]] if up[0] < len(s) else -1] = new
        else:
            root = new
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of ``strings``: multikey quicksort down to ``shallow`` bytes, below that blind tries."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out.extend(group)
        elif depth >= shallow:
            out.extend(_blind_trie(strings, group))
        else:
            words = [strings[i][depth : depth + WORD] for i in group]
            pivot = words[len(words) // 2]
            less = [i for i, w in zip(group, words) if w < pivot]
            same = [i for i, w in zip(group, words) if w == pivot]
            more = [i for i, w in zip(group, words) if w > pivot]
            stack.append((more, depth))
            if len(pivot) < WORD:  # all of these end here
                stack.extend(([i], depth) for i in reversed(same))
            else:
                stack.append((same, depth + WORD))
            stack.append((less, depth))
    return out


def _sorted(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``strings`` and how much each shares with the next."""
    order = deep_shallow_sort(strings)
    return np.array(order), np.array([common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])], dtype=np.int64)


def resolve(befores: list[bytes], afters: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far to either side repeats reach from each suffix of a group; 0 and 0 where none does.

    ``befores`` hold what stands before each suffix, backwards. A string that starts b bytes before a suffix
    is repeated if another shares b bytes before and ``length`` - b after it. The largest and the smallest
    such b are common prefixes of neighbours in one of the orders, so only these are tried.
    """
    n = len(afters)
    (by_before, back), (by_after, ahead) = _sorted(befores), _sorted(afters)
    reach = np.zeros((2, n), dtype=np.int64)
    if n < 2:
        return reach[0], reach[1]
    most_back, most_ahead = back.max(), ahead.max()
    x, y = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for b in np.unique(np.concatenate([back, length - ahead])).tolist():
        if b < 0 or b > most_back or length - b > most_ahead:
            continue
        x[by_before[1:]], y[by_after[1:]] = np.cumsum(back < b), np.cumsum(ahead < length - b)
        x[by_before[0]] = y[by_after[0]] = 0
        both = x * n + y
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        hit = np.concatenate([order[1:][same], order[:-1][same]])
        reach[0, hit] = np.maximum(reach[0, hit], b)
        reach[1, hit] = np.maximum(reach[1, hit], length - b)
    return reach[0], reach[1]


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["key", "context", "check", "id", "fp", "pos", "back", "ahead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for id_, fp, text in zip(*(c.to_pylist() for c in b.columns)):
                raw = np.frombuffer((text or "").encode(errors="replace"), dtype=np.uint8)
                if len(raw) >= length:
                    at, key, context, check, left, right = named_suffixes(raw, length, gram)
                    one = np.ones(len(at), dtype=np.int64)
                    parts.append((key, context, check, one * id_, one * fp, at, left, right))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                kinds = [pa.int64()] * 5 + [pa.int32()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds)], names=names)

    return rows.select("id", "fp", "text").mapInArrow(run, "key long, context long, check long, id long, fp long, pos int, back int, ahead int")


def _by_sorting(contexts: DataFrame, length: int) -> DataFrame:
    """``id, fp, start, stop`` of the single contexts of each group, the groups sorted one after the other."""

    def solved(rows: list) -> list[tuple]:
        rows = list({r[1:3]: r for r in rows}.values())
        if len(rows) < 2:
            return []
        back, ahead = resolve([r[7][::-1] for r in rows], [r[8] for r in rows], length)
        return [(r[4], r[5], r[6] - x, r[6] + y) for r, x, y in zip(rows, back.tolist(), ahead.tolist()) if y and r[3] == 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += solved(held)
                    held = []
                held.append(row)
            yield _spans(out)
        if held:
            yield _spans(solved(held))

    dealt = contexts.repartition("key").sortWithinPartitions("key", "context", "check")
    return dealt.select("key", "context", "check", "n", "id", "fp", "pos", "before", "after").mapInArrow(run, "id long, fp long, start int, stop int")


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "fp", "start", "stop"])


def _by_counting(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same spans for groups of any size: every string of a context is counted by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, context, check, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(before + after, dtype=np.uint8)
                backs = np.arange(max(0, length - len(after)), len(before) + 1)
                if not len(backs):
                    continue
                total, first = _prefix_hash(raw), len(before) - backs
                h = _mixed((total[first + length] - total[first]) * _power(len(raw) + 1)[1][first])
                n = len(backs)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(n, x)) for x in (key, context, check)), pa.array(backs.astype(np.int32)), pa.array(h.view(np.int64))],
                    names=["key", "context", "check", "back", "string"],
                )

    strings = written(contexts.select("key", "context", "check", "before", "after").mapInArrow(run, "key long, context long, check long, back int, string long"))
    twice = strings.groupBy("key", "back", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    reach = strings.join(twice.hint("merge"), ["key", "back", "string"]).groupBy("key", "context", "check").agg(F.max("back").alias("x"), (length - F.min("back")).alias("y"))
    found = contexts.where("n = 1").join(reach.hint("merge"), ["key", "context", "check"])
    return found.select("id", "fp", (F.col("pos") - F.col("x")).alias("start"), (F.col("pos") + F.col("y")).cast("int").alias("stop"))


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 100) -> DataFrame:
    """``id, fp, spans`` of the texts with repeated strings: sorted (start, stop) in bytes, they may overlap.

    ``id`` is the doc_id (``NO_ID`` for null), ``fp`` the xxhash64 of the text; both name a text, of which
    the table may hold several rows. Only the strings of ``docs`` itself count.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("fp"), "text")
    anchors = written(_anchors(rows, length, gram))
    twice = written(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    alive = written(anchors.join(twice.hint("merge"), "key"))
    forget(anchors, twice)
    contexts = written(
        alive.groupBy("key", "context", "check").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp", "pos", "back", "ahead")).alias("rep"))
    )
    settled = (
        alive.join(contexts.where("n > 1").select("key", "context", "check").hint("merge"), ["key", "context", "check"])
        .where(F.col("back") + F.col("ahead") >= length)
        .select("id", "fp", (F.col("pos") - F.col("back")).alias("start"), (F.col("pos") + F.col("ahead")).alias("stop"))
    )
    groups = contexts.groupBy("key").agg(F.count("*").alias("variants"), F.min("n").alias("least")).where("variants > 1 and least = 1")
    open_ = written(contexts.join(groups.select("key", "variants").hint("merge"), "key").select("key", "context", "check", "n", "variants", "rep.*"))
    # contexts with what stands before and after; repeated rows of a text give repeated contexts
    raw = rows.select("id", "fp", F.col("text").cast("binary").alias("raw")).join(open_.hint("merge"), ["id", "fp"])
    before, after = F.expr("substring(raw, pos - back + 1, back)"), F.expr("substring(raw, pos + 1, ahead)")
    cut = raw.select("key", "context", "check", "n", "variants", "id", "fp", "pos", before.alias("before"), after.alias("after"))
    large = open_.where(F.col("variants") > LARGEST).limit(1).count()
    if large:
        cut = written(cut)
    found = settled.unionByName(_by_sorting(cut.where(F.col("variants") <= LARGEST) if large else cut, length))
    if large:
        found = found.unionByName(_by_counting(cut.where(F.col("variants") > LARGEST).dropDuplicates(["key", "context", "check"]), length, gram))
    spans = written(found.groupBy("id", "fp").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")))
    forget(alive, contexts, open_, cut)
    return spans


ADDED = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept_text": "string"}


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 100, least_words: int = 0) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256, kept_text`` added; columns of these names are replaced, all others kept.

    Every copy of a repeated string goes, the first included; with ``least_words`` a maximal run of bytes to
    remove stays if it has fewer words. Null texts are empty; a text shorter than ``length`` bytes keeps
    everything; repeated rows of that length go whole; a null id is an id like others; an empty table
    gives an empty result. Where removal cuts a character of several bytes, ``kept_text`` leaves out its
    rest; ``kept_sha256`` is of the bytes.
    """
    names = [c for c in docs.columns if c not in ADDED]
    kept = {f"c{i}": docs.schema[c].dataType.simpleString() for i, c in enumerate(names)}
    keyed = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(kept, names)], F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("fp"))
    both = keyed.join(repeated_spans(docs, length, gram).hint("merge"), ["id", "fp"], "left").select(*kept, "spans")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [remaining(text, spans, least_words) for text, spans in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*kept, *ADDED])

    schema = ", ".join(f"`{k}` {t}" for k, t in (kept | ADDED).items())
    return both.mapInArrow(run, schema).toDF(*names, *ADDED)


def remaining(text: str | None, spans: list | None, least_words: int = 0) -> tuple[int, int, int, str, str]:
    """Bytes, bytes removed, maximal removed runs, hash of the rest and the rest as text."""
    raw = (text or "").encode(errors="replace")
    runs: list[list[int]] = []
    for span in spans or ():
        if runs and span["start"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], span["stop"])
        else:
            runs.append([span["start"], span["stop"]])
    if least_words:
        runs = [r for r in runs if len(raw[r[0] : r[1]].split()) >= least_words]
    borders = [0, *(x for r in runs for x in r), len(raw)]
    rest = b"".join([raw[a:b] for a, b in zip(borders[::2], borders[1::2])])
    return len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore")
