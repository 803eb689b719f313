"""Near duplicates where many documents are almost near enough: nothing that is written lists their pairs."""

from __future__ import annotations

import random

import pytest

from panelforge.llm import minhash
from panelforge.llm.common import ship


def misses(n, words=400, kept=0.95, seed=0):
    """Documents that share about ``kept`` of their words with one text each, so that two of them are a little less alike."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(words), int(words * (1 - kept))):
            own[k] = f"x{i}y{k}"
        out.append((i, " ".join(own)))
    return out


def plain(rows, words, percent):
    sets = {i: {tuple(t.split()[k : k + words]) for k in range(len(t.split()) - words + 1)} for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("cell, kept", [(1024, 0.97), (16, 0.97), (16, 0.975), (7, 0.98)])
def test_clusters_in_blocks(spark, monkeypatch, cell, kept):
    """One block a cluster and several; likeness around the threshold, so that some are linked and most are not."""
    ship(spark)
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "BLOCK", cell)
    rows = misses(60, kept=kept)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == plain(rows, 3, 85)


def test_nothing_lists_pairs(spark, monkeypatch):
    """Twice the documents, about twice the rows and bytes that are written, though four times the pairs come near."""
    ship(spark)
    seen = {}

    def spy(candidates, *rest):
        width = sum(len(r.node) + len(r.root) for r in candidates.collect())
        out = resolved(candidates, *rest)
        seen[size] = (candidates.count(), width, out.count())
        return out

    resolved = minhash._resolved
    monkeypatch.setattr(minhash, "_resolved", spy)
    for size in (60, 120):
        rows = misses(size, kept=0.968)
        minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    (few, few_bytes, _), (many, many_bytes, _) = seen[60], seen[120]
    assert many <= 3 * few and many_bytes <= 3 * few_bytes
