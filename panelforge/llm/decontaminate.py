"""Benchmark decontamination by Aho-Corasick automata over normalised test questions and answers.

A word is a run of digits, letters and characters beyond ASCII, with A to Z in lower case; a text is normalised
to its words with one space between. A window is ``size`` consecutive words of an item; an item of fewer words,
but not none, is one window. All windows, each between two spaces, are the patterns of one automaton, which every
task builds from a broadcast, and a document is scanned once. A match is carried back from the normalised text to words, and
from words to code points of the text as it came.

What is broadcast is bounded: where the windows have more than ``PATTERN_BYTES`` bytes, they are dealt by hash into so
many parts that none has more, and the parts are scanned for one after another, each pass adding to what the last one
found, which is written in between.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Bytes of windows and item ids in one automaton; a node takes about 60 bytes of memory for each.
PATTERN_BYTES = 4_000_000
#: What a window costs beside its bytes.
ROW_BYTES = 32

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def windows_of(text: bytes | None, size: int) -> list[bytes]:
    """The windows of an item, normalised; none if it has no words."""
    words = (text or b"").translate(_WORDS).split()
    n = min(size, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``window, item`` of ``items(item_id, text)``, each pair once; ``item`` is the id as text, null for a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, i) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in windows_of(t, size)]
            window, item = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(window, pa.binary()), pa.array(item, pa.string())], names=["window", "item"])

    plain = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "window binary, item string").distinct()


def automaton(rows: Sequence[tuple[bytes, str | None]]) -> ahocorasick.Automaton:
    """An automaton over windows; the value of each is its number of words and the items that have it."""
    held: dict[bytes, list] = {}
    for window, item in rows:
        held.setdefault(window, []).append(item)
    out = ahocorasick.Automaton()
    for window, its in held.items():
        out.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, [i for i in its if i is not None]))
    if held:
        out.make_automaton()
    return out


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open runs, sorted, with those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(text: bytes | None, found: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged runs of hit words, and items with a window among them."""
    words = (text or b"").translate(_WORDS).split()
    if not words or not len(found):
        return len(words), [], set()
    plain = b" " + b" ".join(words) + b" "
    hits = list(found.iter(plain.decode("latin-1")))
    if not hits:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)
    stops = np.searchsorted(spaces, [end for end, _ in hits]).tolist()
    return len(words), _merged([(b - n, b) for b, (_, (n, _)) in zip(stops, hits)]), {i for _, (_, its) in hits for i in its}


def code_points(text: bytes, runs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as half-open stretches of code points of the text as it came."""
    raw = np.frombuffer(text, dtype=np.uint8)
    blank = np.frombuffer(text.translate(_WORDS), dtype=np.uint8) == 32
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, stops = edge[::2], edge[1::2]
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(before[starts[a]]), int(before[stops[b - 1]])) for a, b in runs]


_SCANNED = "n_words long, runs array<int>, items array<string>, spans array<struct<start:int,stop:int>>"


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10, carry: Sequence[str] = ()) -> DataFrame:
    """What of each document of ``docs(doc_id, text)`` stands in ``items(item_id, text)``: one row a document.

    Returns doc_id, the columns of ``carry``, n_words, n_hit (words in an occurring window), n_items and items (ids as text,
    sorted as strings, of items with an occurring window), spans (stretches of hit words as code points of the text, stop
    excluded) and contaminated (``n_hit > 0``). Null and empty texts have no words; empty items or documents give no hits or no
    rows. Very long texts are scanned whole; repeated rows give repeated results; an item that occurs twice is named once. An
    item with a null id marks words and is named nowhere. Further columns of either table, of any name, aren't read.
    """
    spark = docs.sparkSession
    pairs = written(item_windows(items, size))
    cost = F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + ROW_BYTES
    total = pairs.agg(F.sum(cost)).first()[0] or 0
    # A part has its share of the bytes but for the scatter of the hash; half the bound leaves room for that.
    parts = max(1, -(-2 * total // PATTERN_BYTES)) if total > PATTERN_BYTES else 1
    keep = list(dict.fromkeys(["doc_id", "text", *carry]))
    state = docs.select(*keep).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    kept = [f"c{i}" for i in range(len(keep))]
    shown = [c for i, c in enumerate(kept) if i != 1 or "text" in carry]
    for part in range(parts):
        own = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == part) if parts > 1 else pairs
        sent = spark.sparkContext.broadcast([(bytes(r["window"]), r["item"]) for r in own.collect()])
        last = part == parts - 1
        scanned = _scan(state, shown if last else kept, sent, first=part == 0)
        if not last:
            before, state = state, written(scanned)
            forget(before)
        else:
            state = scanned
    names = [F.col(c).alias(keep[int(c[1:])]) for c in shown]
    return state.select(*names, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def _scan(state: DataFrame, kept: list[str], sent, first: bool) -> DataFrame:
    """One pass with one automaton; later passes add to the runs and items of the earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(sent.value)
        for b in batches:
            n_words, n_hit, runs, items, spans = [], [], [], [], []
            before = [([], [])] * b.num_rows if first else zip(b.column("runs").to_pylist(), b.column("items").to_pylist())
            for t, (old_runs, old_items) in zip(b.column("_raw"), before):
                raw = t.as_py()
                n, own, its = matches(raw, found)
                own = _merged([*zip(old_runs[::2], old_runs[1::2]), *own])
                n_words.append(n)
                n_hit.append(sum(y - x for x, y in own))
                runs.append([x for r in own for x in r])
                items.append(sorted(its.union(old_items)))
                spans.append([{"start": x, "stop": y} for x, y in code_points(raw, own)] if own else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            found_here = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *found_here], names=[*kept, "n_words", "n_hit", "runs", "items", "spans"])

    wanted = [*kept, *([] if first else ["runs", "items"]), F.col("c1").cast("binary").alias("_raw")]
    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema if f.name in kept)
    return state.select(*wanted).mapInArrow(run, f"{plain}, n_words long, n_hit long, runs array<int>, items array<string>, spans array<struct<start:int,stop:int>>")
