"""Divergence, collocations and decontamination against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelforge.llm import collocations, decontaminate, divergence
from panelforge.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, rank int, score string, term string, shard int, n int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def frame(spark, rows):
    """Documents with further columns whose names the operators use."""
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], DOCS).repartition(3)


def corpus(seed=0, n=220):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)] + ["é", "ÉA", "Bé", "x1y"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[: 12 if i % 3 else 44]) + rng.choice([" ", " ", " ", "  ", ". ", "\t", ",", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, rng.choice([text, text, text.upper(), "alpha beta gamma delta " + text]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    rows += [(i, None, "en", "d") for i in range(2)] + [(900, "", "xx", "only"), (901, "", "xx", "other"), (None, "alpha beta", None, None)]
    rows.append((950, "alpha beta gamma " * 4000, "de", "b"))
    return rows + rows[:5]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_divergence(rows, least=3):
    df, cnt, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        its = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        g = (lang or "", source or "")
        groups.add(g)
        df[g[0]].update(set(its))
        cnt[g].update(its)
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, c in df[lang].items() if c >= least}
        own = sorted(g for g in groups if g[0] == lang)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = {g: shares(cnt[g]) for g in own}
        q = shares(sum((cnt[g] for g in own), Counter()))
        for g in own:
            pairs = sorted(((-sum((p[g][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o[1].encode()) for o in own if o != g))
            told = sorted((-((p[g][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if cnt[g][t] > 0 and p[g][t] > q[t])[:200]
            for part, its in (("pair", pairs), ("term", told)):
                out += [(*g, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(its)]
    return sorted(out)


@pytest.mark.parametrize("most_bytes, block", [(divergence.SHARD_BYTES, 128), (600, 128), (0, 2)])
def test_divergence(spark, monkeypatch, most_bytes, block):
    """All terms broadcast, some, and none; all sources in one block and in several."""
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block)
    rows = corpus()
    got = divergence.divergences(frame(spark, rows), most_bytes=most_bytes)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows)


def test_divergence_of_nothing(spark):
    assert divergence.divergences(frame(spark, []).limit(0)).collect() == []
    got = divergence.divergences(frame(spark, [(1, None, None, None), (2, "", "", "b")])).collect()
    assert sorted(tuple(r) for r in got) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_perfect_hash():
    keys = [f"k{i}é".encode() for i in range(3000)]
    own = divergence.PerfectHash(*divergence.PerfectHash.built(keys))
    others = [f"other{i}".encode() for i in range(3000)]
    at = own.slots(keys + others, divergence.hashed(keys + others))
    assert sorted(at[:3000]) == list(range(3000)) and (at[3000:] == -1).all()
    assert [own.keys[i] for i in at[:3000]] == keys


def test_shares_pass_64_bits():
    count, n, v = 6 * 10**12, 4 * 10**14, 10**9
    assert divergence.share(np.array([count]), n, v)[0] == 1 + 10**9 * (count + 1) // (n + v)


def plain_phrases(rows):
    f = defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for n in range(1, 5):
                f[lang or "und"].update((n, " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
    return f


def plain_collocations(rows, least, top):
    out = []
    for lang, f in plain_phrases(rows).items():
        total = sum(c for (n, _), c in f.items() if n == 1)
        count = {p: c for (_, p), c in f.items() if c >= least}
        kept = []
        for phrase, a in count.items():
            w = phrase.split(" ")
            if len(w) < 2:
                continue
            cuts = [(2_000_000 * a // (count[" ".join(w[:k])] + count[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            inside = [c for p, c in count.items() if len(p.split(" ")) > len(w) and f" {phrase} " in f" {p} "]
            if not any(100 * c >= 80 * a for c in inside):
                kept.append((-score, -a, phrase.encode(), count[" ".join(w[:k])], count[" ".join(w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, top, held", [(30, 2000, 1_500_000), (4, 25, 50)])
def test_collocations(spark, monkeypatch, least, top, held):
    """One count a task, and one every few texts; a low count, at which the sample misses much."""
    monkeypatch.setattr(collocations, "HELD_WORDS", held)
    rows = corpus(1)
    got = collocations.collocations(frame(spark, rows), least=least, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, least, top)


def test_border_failures_are_counted(spark):
    """A sample of almost nothing proposes almost nothing; passes go on until all is found."""
    rows = corpus(2, 60)
    got = collocations.frequent_phrases(frame(spark, rows), least=5, sample_of=10**9).where("n > 0").collect()
    want = [(lang, n, p, c) for lang, f in plain_phrases(rows).items() for (n, p), c in f.items() if c >= 5]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None, None), (2, " . ", "en", "a")])).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(7 * 10**13 + 1, 10**14 + 3), (1, 3), (5 * 10**14, 10**15)]
    got = spark.createDataFrame(rows, "a long, d long").select(collocations._ratio_floor("a", "(d)").alias("x")).collect()
    assert [r.x for r in got] == [2_000_000 * a // d for a, d in rows]


def plain_hits(rows, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for doc, text, *_ in rows:
        w, hit, its = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    its |= windows[tuple(w[k : k + n])]
        names = sorted(str(i) for i in its if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaks():
    rng = random.Random(3)
    words = [f"Word{i}" for i in range(30)] + ["É9", "née"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 10, 25])))) for i in range(12)] + [(12, None), (13, " - "), (None, "nobody's own words"), (3, "twice named")]
    items.append((20, items[4][1]))
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        if i % 3 == 0:
            text = f"{text}, ¿{items[i % 12][1].upper().replace(' ', '\n--')}! {text}"
        rows.append((i, text, "en", "a"))
    rows += [(70, None, None, None), (71, "", "en", None), (72, "NOBODY'S own Words", "en", "b"), (None, items[3][1], "en", "b"), (80, (items[5][1] + " . ") * 3000, "en", "b")]
    return rows + rows[:4], items


@pytest.mark.parametrize("most", [decontaminate.PATTERN_BYTES, 900])
def test_decontamination(spark, monkeypatch, most):
    """One automaton, and several, one after another."""
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", most)
    rows, items = leaks()
    found = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), carry=["text", "score"]).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found]
    assert sorted(got, key=repr) == plain_hits(rows, items)
    for r in found:  # the stretches hold the hit words and nothing else but what is between them
        assert sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(r.text[s.start : s.stop]))) for s in r.spans) == r.n_hit
        assert all(r.text[s.start : s.stop].strip() == r.text[s.start : s.stop] for s in r.spans)


def test_decontamination_of_nothing(spark):
    rows, items = leaks()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, []).limit(0), benchmark).collect() == []
    assert not decontaminate.contaminated(frame(spark, rows), benchmark.limit(0)).where("contaminated or n_items > 0").count()
