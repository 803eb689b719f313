"""Each operator on small frames: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from panelforge.llm import bpe, fingerprints, html_extract, minhash, multi_index, packing, prefix_bpe, quotations, suffixes, token_output, toxicity  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor sit amet. " * 4000
ODD = [(1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (5, LONG), (None, "no id at all here now"), (7, "日本 ▁ x y <|endoftext|>  z"), (8, "one two three four five six")]


def docs(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"key": F.lit(1), "score": F.lit("s"), "node": F.lit(None).cast("string"), "vector": F.lit(0)}) if extra else df


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


# HTML extraction


def test_extract_main_text(spark):
    page = '<html><head><title>T</title><script>"<p>no</p>"</script></head><body><nav><ul><li><a href=a>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  line<br>of the text.<p>Second one is here, with <b>bold</b> words.</article><div class="comments"><p>Nice post, thanks.</p></div><footer>&copy; site</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", page)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    want = "A & B First line of the text. Second one is here, with bold words."
    assert got == {1: (want, len(want)), 4: (want, len(want)), 2: ("", 0), 3: ("", 0)}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


#: Pages of other layouts, written and labelled by hand: what must be in the text, and what must not.
LAYOUTS = [
    (
        '<body><header class="site-header"><a href="/">Daily</a></header><div id="cookie-banner"><p>We use cookies.</p><button>Accept</button></div>'
        '<main><h1>Rivers rise</h1><p>The river rose by two metres on Monday, and the road was closed.</p><figure><img src=a><figcaption>The bridge at noon.</figcaption></figure>'
        '<p>Officials said that it would fall again by Friday.</p></main><aside class="related"><h3>Related</h3><ul><li><a href=b>Older story</a></li></ul></aside>'
        '<section class="comments"><h2>2 comments</h2><p>I was there, it was awful.</p></section><footer><p>All rights reserved.</p></footer></body>',
        ["Rivers rise", "The river rose", "Officials said"],
        ["Daily", "cookies", "Accept", "Older story", "I was there", "rights reserved"],
    ),
    (
        '<body><div class="navbar"><ul><li><a href=1>News</a></li><li><a href=2>Sport</a></li></ul></div><form class="search-form"><label>Search</label><input name=q></form>'
        '<div class="post-content"><h1>How to plant beans</h1><p>Beans need sun, water and patience, and a little string.</p><ol><li>Dig a hole.</li><li>Drop the bean.</li></ol>'
        '<div class="advertisement"><p>Buy our seeds now!</p></div><p>After ten days the first leaves will show above the soil.</p></div>'
        '<div class="sidebar"><p>Subscribe to our letters.</p></div><div class="footer">&copy; Garden</div></body>',
        ["How to plant beans", "Beans need sun", "Dig a hole.", "After ten days"],
        ["Sport", "Search", "Buy our seeds", "Subscribe", "Garden"],
    ),
    (
        '<body><nav><a href=1>Home</a> | <a href=2>About</a></nav><article><h1>On sleep</h1><p>Sleep is not idle time; the brain sorts what the day has left.</p>'
        '<blockquote>We are such stuff as dreams are made on.</blockquote><p>So go to bed.</p></article>'
        '<div id="disqus_thread"><div class="comment"><p>Good read, thank you.</p></div></div><p class="disclaimer">Ads may follow you.</p></body>',
        ["On sleep", "Sleep is not idle", "such stuff as dreams", "So go to bed."],
        ["Home", "About", "Good read", "Ads may follow"],
    ),
]


def test_pages_labelled_by_hand():
    field = html_extract.train(html_extract.labelled_pages())
    for page, inside, outside in LAYOUTS:
        text = html_extract.main_text(page, field)
        assert [x for x in inside if x not in text] == [] and [x for x in outside if x in text] == []


def test_blocks_of_long_and_broken_pages_take_one_pass():
    import time

    for unit in ('<a "', "<div>", "</div>", '<a "> "', '<div class="x', "<!--", "<script>", "<", "<p>x"):
        began = time.process_time()
        html_extract.blocks(unit * 20_000)
        assert time.process_time() - began < 5
    assert [b[0] for b in html_extract.blocks('a < b <p title="x>y">c</p> <b>d<!-- e --> f<style>g</style> <i "h>i')] == ["a < b", "c", "d f i"]
    assert [b[0] for b in html_extract.blocks("<p>x</p> 1 < 2")] == ["x", "1 < 2"]


def test_field_on_held_out_layouts():
    field = html_extract.train(html_extract.labelled_pages(250, seed=5), steps=80)
    pages = html_extract.labelled_pages(100, seed=6)
    pairs = [(a, b) for page, labels in pages for a, b in zip(field.decode(html_extract.blocks(page)), labels)]
    assert np.mean([a == b for a, b in pairs]) > 0.97


def test_viterbi_is_the_best_path():
    import itertools

    field = html_extract.Field({"bias": (0.1, 0.3), "sentence": (-0.5, 0.9), "in:nav": (1.0, -1.0)}, np.array([0.2, -0.1]), np.array([[0.5, -0.4], [-0.2, 0.6]]))
    page = html_extract.blocks("<nav>a b</nav><p>Some text.</p><p>x</p><nav>More.</nav><p>y z.</p>")

    def total(labels):
        s = field.start[labels[0]] + sum(field.moves[a][b] for a, b in zip(labels, labels[1:]))
        return s + sum(field._sum(html_extract.path_features(p) + html_extract.text_features(t, k))[y] for (t, p, k), y in zip(page, labels))

    assert tuple(field.decode(page)) == max(itertools.product((0, 1), repeat=len(page)), key=total)


# Suffix-array dedup


def test_deep_shallow_sort_orders():
    rng = random.Random(3)
    for _ in range(100):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) * rng.randint(1, 9) for _ in range(rng.randint(1, 40))]
        assert [strings[i] for i in suffixes.deep_shallow_sort(strings, 16)] == sorted(strings)


def brute_repeats(texts, length):
    from collections import Counter

    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("largest", [50_000, 2])
def test_repeats_against_brute_force(spark, monkeypatch, largest):
    monkeypatch.setattr(suffixes, "LARGEST", largest)
    rng = random.Random(8)
    shared = [words(rng, 30) for _ in range(4)]
    texts = []
    for _ in range(40):
        part = [words(rng, rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            part += [s[a : a + rng.randint(20, 140)], words(rng, rng.randint(0, 9))]
        texts.append("é".join(part))
    texts += [None, "", texts[3], "ab" * 200, LONG[:3000]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.remove_repeats(df, length=60, gram=16).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute_repeats(texts, 60)


def test_runs_of_few_words_stay():
    spans = [{"start": 0, "stop": 5}, {"start": 4, "stop": 9}, {"start": 12, "stop": 20}]
    assert suffixes.remaining("aa bb cc dd eeeeeeeeee", spans, 3)[1:3] == (9, 1)
    assert suffixes.remaining("aa bb cc dd eeeeeeeeee", spans)[1:3] == (17, 2)


def test_resolve_against_all_pairs():
    rng = random.Random(5)
    for _ in range(150):
        n, length = rng.randint(1, 12), 12
        befores = [bytes(rng.choices(b"ab", weights=[9, 1], k=rng.randint(0, 8))) for _ in range(n)]
        afters = [b"gram" + bytes(rng.choices(b"ab", weights=[9, 1], k=rng.randint(0, 8))) for _ in range(n)]
        back, ahead = suffixes.resolve(befores, afters, length)
        for i in range(n):
            pairs = [(suffixes.common_prefix(befores[i], befores[j]), suffixes.common_prefix(afters[i], afters[j])) for j in range(n) if j != i]
            good = [p for p in pairs if sum(p) >= length]
            assert (back[i], ahead[i]) == (max((p[0] for p in good), default=0), max((p[1] for p in good), default=0))


def test_repeats_edge_cases(spark):
    clashing = docs(spark).withColumns({"spans": F.lit("s"), "n_bytes": F.lit("n"), "id": F.lit("i"), "fp": F.lit(0.5), "a.b": F.lit(1), "kept_text": F.lit(2)})
    out = suffixes.remove_repeats(clashing)
    assert sorted(out.columns) == sorted({*clashing.columns, *suffixes.ADDED}) and dict(out.dtypes)["spans"] == "string" and dict(out.dtypes)["n_bytes"] == "bigint"
    assert out.count() == len(ODD) and out.where("spans = 's' and id = 'i' and fp = 0.5").count() == len(ODD)
    assert {r["n_removed"] for r in out.where("doc_id = 5").collect()} == {len(LONG)}
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


# Fingerprints


def test_fingerprints(spark):
    rows = [(3, "Gamma one.\nGamma two.\nGamma three.\nGamma four."), (1, "Alpha one.\nAlpha two.\nAlpha three.\nAlpha four."), (2, None), (9, ""), (7, "Alpha one.\nAlpha two.\nAlpha three.\nAlpha four.")]
    got = {r["doc_id"]: r for r in fingerprints.with_edits(docs(spark, rows)).collect()}
    order = sorted(r[0] for r in rows)
    text = {k: v or "" for k, v in rows}
    for i, k in enumerate(order):
        t, nxt = text[k], text[order[(i + 1) % len(order)]]
        h = len(t) // 2
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
    assert got[1]["fingerprint"] == got[7]["fingerprint"] != got[3]["fingerprint"]
    assert got[2]["near_next"] < 0.1 and got[1]["near_edited"] > 0.3
    assert fingerprints.with_edits(docs(spark, ODD)).count() == len(ODD)
    assert fingerprints.with_edits(docs(spark, [])).count() == 0


def test_fingerprints_over_many_buckets(spark):
    rows = [(i * 3, f"text {i}.") for i in range(50)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.with_edits(docs(spark, rows), rows_a_bucket=5).collect()}
    for i, (k, t) in enumerate(rows):
        h = len(t) // 2
        assert got[k] == hashlib.sha256((t[: len(t) - h] + rows[(i + 1) % 50][1][:h]).encode()).hexdigest()


def test_vectors_are_homomorphic(spark):
    df = spark.createDataFrame([("A b.\nC d.", "E f.", "E f.\nA b.\nC d.")], "x string, y string, z string")
    v = {c: fingerprints.vector(fingerprints.paragraphs(F.col(c))) for c in "xyz"}
    r = df.select(fingerprints.combine(v["x"], v["y"]).alias("s"), v["z"].alias("z"), fingerprints.combine(v["z"], v["y"], -1).alias("d"), v["x"].alias("x")).first()
    assert r["s"] == r["z"] and r["d"] == r["x"]
    many = spark.range(1).select(F.array_repeat(F.lit("same"), 2**20 + 3).alias("p"), F.array_repeat(F.lit("same"), 3).alias("few"))
    r = many.select(fingerprints.vector(F.col("p")).alias("v"), fingerprints.vector(F.col("few")).alias("few")).first()
    n = fingerprints.HASHES * fingerprints.SHIFTS
    assert r["v"][:n] == r["few"][:n]  # each component is modulo 2**20 by itself


# SentencePiece


def test_pieces_against_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    mine = prefix_bpe.PrefixEncoder(PIECES)
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "a", "the", "é", "日本", "▁", "\t", "12", "😀", "ing", "</s>", "<0x0A>", " " * 18, "�", "Th", "\x00"]
    for _ in range(1500):
        t = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        ids = model.encode(t)
        assert mine.encode(t) == ids and mine.decode(ids) == model.decode(ids)
        ids = [rng.choice([rng.randint(0, 31_999), rng.randint(0, 260)]) for _ in range(6)]
        assert mine.decode(ids) == model.decode(ids)
    got = prefix_bpe.digest_documents(docs(spark), PIECES).collect()
    want = sorted((len(model.encode(t or "")) + 1, hashlib.sha256(" ".join(map(str, [*model.encode(t or ""), 2])).encode()).hexdigest(), hashlib.sha256(model.decode(model.encode(t or "")).encode()).hexdigest()) for _, t in ODD)
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    back = prefix_bpe.decode_documents(prefix_bpe.encode_documents(docs(spark, ODD[:4]), PIECES), PIECES)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: ODD[0][1], 2: "", 3: "", 4: " \n\t"}


# Toxicity


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 30) + (" zzyzx qqqq " + words(rng, 5) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 300"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(300, 400))
    scored = toxicity.score(docs(spark), model)
    assert scored.where("score between 0 and 1").count() == len(ODD) and sorted(scored.columns) == sorted(docs(spark).columns)
    assert len({r["score"] for r in scored.where("doc_id = 5").collect()}) == 1
    none = toxicity.train(df.where("doc_id < 0"))
    assert max(r["score"] for r in toxicity.score(docs(spark), none).collect()) < 1e-9
    assert toxicity.score(docs(spark, []), model).count() == 0
    odd = df.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id"))).unionAll(df).withColumn("text", F.when(F.col("doc_id") % 50 > 0, F.col("text")))
    assert np.isfinite(toxicity.train(odd).bias)


def test_toxicity_counts_and_scores_against_brute_force(spark):
    from collections import Counter

    rng = random.Random(12)
    rows = [(i, rng.choice(["Ünï ", "日本語日本語 ", ""]) + words(rng, 12) + (" bad words" if i % 3 == 0 else " good words"), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")

    def grams(text):
        t = text.lower()
        return {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}

    slot_of = {g: int(next(s for n, s in zip(toxicity.ORDERS, toxicity._slots(g, (len(g),))))[0]) for _, t, _ in rows for g in grams(t)}
    want = Counter((slot, y) for _, t, y in rows for slot in {slot_of[g] for g in grams(t)})
    got = Counter()
    for r in toxicity.slot_counts(df).where("slot >= 0").collect():
        for k in range(toxicity.FOLDS):
            got[r["slot"], 0] += r[f"clean_{k}"]
            got[r["slot"], 1] += r[f"toxic_{k}"]
    assert +got == want
    model = toxicity.train(df)
    for r in toxicity.score(df, model).collect():
        margin = sum(float(model.weight[s]) for s in {slot_of[g] for g in grams(r["text"])}) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_toxicity_tells_by_long_grams(spark):
    """All grams of 4 and 5 bytes stand in both classes; only those of 6 and 7 tell them apart."""
    every = "aaaaabaaabbaababaabbbababbabbbbb"  # each string of five over a and b, around its end
    every += every[:4]
    rows = [(i, every + ("b" * 7 if i % 2 else "a" * 7), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.select("doc_id", "text"), toxicity.train(df)).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) and (got[i] <= 0.3) == (not i % 2) for i in got)


def test_toxicity_keeps_all_telling_slots(spark):
    rng = np.random.default_rng(3)
    words = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(300)) for _ in range(2)]
    df = spark.createDataFrame([(i, words[i % 2], i % 2) for i in range(24)], "doc_id long, text string, toxic int")
    assert (toxicity.train(df, tells=2.5).weight != 0).sum() > 10_000


# Token output


def test_re_pair_round_trip():
    rng = np.random.default_rng(1)
    docs_ = [np.append(rng.choice([5, 6, 7, 2, 9], size=n, p=[0.4, 0.3, 0.1, 0.1, 0.1]), 2).astype("<u4") for n in (0, 1, 50, 3000, 2, 700)]
    raw = token_output.write_shard([4, None, 1, 2, 3, 9], docs_, 2, 50_257)
    shard = token_output.Shard(raw)
    assert (shard.all_ids() == np.concatenate(docs_)).all()
    assert all((shard.ids(i) == d).all() for i, d in enumerate(docs_))
    assert len(shard.symbols) < sum(map(len, docs_)) and shard.rules.spans.max() > 2
    for i, d in enumerate(docs_):  # any stretch is decoded alone
        a, b = sorted(rng.integers(0, len(d) + 1, size=2).tolist())
        assert (shard.some(i, a, b) == d[a:b]).all()


def test_re_pair_goes_on_to_its_end():
    rng = np.random.default_rng(7)
    ids = np.concatenate([rng.choice(40, size=30_000), np.full(5000, 9), np.tile(rng.choice(900, size=60), 40)]).astype("<u4")
    ids[rng.choice(len(ids), size=50)] = 2
    seq, firsts, left, right = token_output.compress(ids, 2, 1000, least=12)
    pairs = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
    counts = np.unique(pairs[(seq[:-1] != 2) & (seq[1:] != 2)], return_counts=True)[1]
    assert counts.max() < 12 and len(firsts) > 5
    assert (token_output.Rules(firsts, left, right, token_output._lengths(firsts, left, right, 1000)).expand(seq) == ids).all()


def test_tokens_are_read_back(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    starts = np.cumsum([0, *map(len, ids)])
    got = token_output.read_tokens(token_output.write_tokens(docs(spark), BPE, shard_tokens=20_000)).collect()
    want = sorted(((k, int(s), len(i), zlib.crc32(i.tobytes())) for (k, _), s, i in zip(rows, starts, ids)), key=str)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == want
    assert token_output.read_tokens(token_output.write_tokens(docs(spark, []), BPE)).count() == 0


def test_ids_against_the_library():
    mine = bpe.TextEncoder(BPE)
    rng = random.Random(1)
    bits = [" ", "  ", "\n", " \n", "a", "the", "é", "日本", ".", ".,", "'s", "<|endoftext|>", "\t", "\xa0", "1", "²", "\x1c", "\x1d", "\x85", "\u3000", "İ", "…", "ª", "-", "ñ"]
    for _ in range(8000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert mine.encode(t).tolist() == mine.library.encode(t, add_special_tokens=False).ids


# MinHash


def brute_components(texts, n, percent):
    sets = {}
    for k, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, n, percent):
    rng = random.Random(9)
    texts: dict[int, str | None] = {}
    for k in range(120):
        base = rng.choice(list(texts.values()) or [None]) if texts and rng.random() < 0.6 else None
        w = (base or words(rng, rng.randint(1, 120))).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if w:
                w[rng.randrange(len(w))] = words(rng, 1)
        texts[k] = " ".join(w).title() if rng.random() < 0.2 else " ".join(w)
    texts |= {200: None, 201: "", 202: " ", 203: "two words", 204: "Two  words"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, n, percent).collect()}
    assert got == brute_components(texts, n, percent)


def test_near_duplicates_edge_cases(spark):
    out = minhash.near_duplicates(docs(spark)).collect()
    assert len(out) == len(ODD)
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (None, None), (7, 7), (8, 1)}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.prefix(80)[0] < minhash.prefix(85)[0] and minhash.prefix(85)[1] * minhash.prefix(85)[2] <= minhash.COORDINATES


# Quotations


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there, how are you?\nI need help."),
        (1, 1, "assistant", "On Monday, Bob wrote:\n> I need help.\nSure."),
        (1, 2, "user", "> > I need help.\n> Sure.\n\nThanks!"),
        (1, 3, "user", "New topic"),
        (1, 4, "assistant", ">  hello THERE how are you\n> not said\nfine"),
        (2, 0, "user", None),
        (None, None, "x", "> Sure."),
        (1, 5, "user", "> fine\nok"),
        (1, 6, "user", "> never said\n> > ok\ndeep"),
        (1, 12, "user", "> Sure.\nlate"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(0))
    got = {(r["conv_id"], r["turn"]): (r["text"], r["parent_turn"], r["root_turn"], r["depth"]) for r in quotations.link_quotations(df).collect()}
    assert got == {
        (1, 0): ("Hello there, how are you?\nI need help.", None, 0, 0), (1, 1): ("Sure.", 0, 0, 1), (1, 2): ("Thanks!", 1, 0, 2), (1, 3): ("New topic", None, 3, 0),
        (1, 4): ("fine", 0, 0, 1), (2, 0): ("", None, 0, 0), (None, None): ("", None, None, 0), (1, 5): ("ok", 4, 0, 2),
        (1, 6): ("deep", 5, 0, 3), (1, 12): ("late", 1, 0, 2),
    }
    order = [r["turn"] for r in quotations.in_reply_order(quotations.link_quotations(df)).where("conv_id = 1").collect()]
    assert order == [0, 1, 2, 12, 4, 5, 6, 3]
    twice = quotations.link_quotations(df.unionAll(df).withColumn("text", F.when(F.col("turn") == 0, F.concat("text", F.lit("\n" + "x y. " * 30_000))).otherwise(F.col("text"))))
    assert twice.count() == 2 * len(rows) and twice.where("turn = 5 and depth = 2 and root_turn = 0").count() == 2
    assert quotations.link_quotations(df.where("conv_id = 99")).count() == 0


def test_paths_sort_like_turns(spark):
    turns = [-(2**63), -300, -1, 0, 3, 9, 10, 99, 100, 2**40]
    df = spark.createDataFrame([(t,) for t in turns], "t long").select("t", quotations.path_step(F.col("t")).alias("p"))
    assert [r["t"] for r in sorted(df.collect(), key=lambda r: r["p"])] == turns


def brute_parents(messages):
    """The turn that each message answers, message by message: quoted lines and passages looked up in all earlier ones."""
    import re
    from itertools import groupby

    def units(text, quoted):
        lines = []
        for line in (text or "").split("\n"):
            m = re.match(r"^((?:[ \t]?>)+)[ \t]?(.*)$", line)
            lines.append((m[1].count(">"), m[2]) if m else (0, line))
        blocks = [(k, "\n".join(x[1] for x in g)) for k, g in groupby(lines, key=lambda x: x[0])]
        plain = {(k, re.sub(r"[^a-z0-9]+", " ", body.lower()).strip()) for k, body in lines + blocks}
        return {(k, u) for k, u in plain if u and (k > 0) == quoted}

    out = {}
    for conv, turn, text in messages:
        sums = {}
        for level, unit in units(text, True):
            having = [t for c, t, x in messages if c == conv and (0, unit) in units(x, False)]
            if having and min(having) < turn:
                key = (-level, min(having))
                sums[key] = sums.get(key, 0) + len(unit)
        best = max(((k[0], n, k[1]) for k, n in sums.items()), default=None)
        out[conv, turn] = best and best[2]
    return out


def test_parents_against_brute_force(spark):
    rng = random.Random(11)
    messages, said = [], {}
    for conv in range(6):
        for turn in range(12):
            lines = []
            for _ in range(rng.randint(0, 3)):
                old = rng.choice(said.get(conv, [words(rng, 4)]))
                lines.append("> " * rng.randint(1, 3) + (old if rng.random() < 0.8 else words(rng, 3)))
            mine = [rng.choice([words(rng, 3), "yes", "ok then"]) for _ in range(rng.randint(1, 3))]
            said.setdefault(conv, []).extend(mine)
            messages.append((conv, turn, "\n".join(lines + mine)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in messages], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quotations.link_quotations(df).collect()}
    assert got == brute_parents(messages) and any(v is not None for v in got.values())


# Embeddings


def test_vector_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + 0.05 * rng.normal(size=(30, 16)), base[:5], base[:1] * 2])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    y = np.array(x, dtype=np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    got = {r["vec_id"]: r for r in multi_index.links(df).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.where(near, label[None, :], len(x)).min(axis=1)
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(500, 505))
    assert multi_index.links(df.where("vec_id < 0")).count() == 0


def test_recall_on_many_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 24))
    x = np.concatenate([base, base[:2400] + rng.normal(size=(2400, 24)) * 0.15, base[:300] + rng.normal(size=(300, 24)) * 0.1]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (3, x[3].tolist()), (3, x[3].tolist())], "vec_id long, embedding array<float>")
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = np.concatenate([y, y[[0, 3, 3]]])
    want = (y @ y.T >= 0.95).sum() - len(y)
    got = multi_index.links(df)
    found = got.agg(F.sum("n_links")).first()[0]
    assert want > 3000 and 0.9 * want <= found <= want
    assert got.where("vec_id is null").first()["component_id"] is None and got.where("vec_id = 3").count() == 3
    assert got.where("vec_id = 0").first()["component_id"] is None  # the null id is the smallest


def test_traversal_goes_by_distance():
    rng = np.random.default_rng(0)
    one, two = rng.random(7), rng.random(5)
    cells = multi_index.traverse(one, two, 35)
    sums = [one[c // 5] + two[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)


# Packing


def test_lower_bound_and_best_fit():
    lengths = np.array([600, 600, 600, 400, 400, 300, 100, 1024])
    assert packing.lower_bound(lengths, 1024) == 4
    bins, offsets, fill = packing.best_fit(lengths, 1024)
    assert fill.max() <= 1024 and len(fill) <= 5
    assert packing.lower_bound(np.array([513, 513, 513]), 1024) == 3 and packing.lower_bound(np.array([], dtype=int), 1024) == 0


def test_pieces_are_packed_once(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 900))) for i in range(60)] + ODD[1:6]
    got = packing.pack_documents(docs(spark, rows), BPE).toPandas()
    mine = bpe.TextEncoder(BPE)
    want = sum(len(mine.encode(t)) + 1 for _, t in rows)
    assert got["length"].sum() == want and got["length"].max() <= 1024
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= packing.lower_bound(got["length"].to_numpy(), 1024) + 2
    assert packing.pack_documents(docs(spark, []), BPE).count() == 0


def test_packed_pieces_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rng = random.Random(13)
    rows = [(i, words(rng, rng.randint(0, 700)) + rng.choice(["", "\n\n", " é  x"])) for i in range(30)] + ODD
    want = []
    for k, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        at = 0
        for piece, stop in enumerate(range(first, len(ids) + 1, 1024)):
            want.append((k, piece, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
            at = stop
    got = packing.pack_documents(docs(spark, rows), BPE).collect()
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=str) == sorted(want, key=str)


def test_bins_against_the_optimum():
    def optimum(lengths, capacity):
        best = len(lengths)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + lengths[i] <= capacity:
                    place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
            place(i + 1, [*bins, lengths[i]])

        place(0, [])
        return best

    rng = random.Random(14)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 9))])
        least = optimum(lengths.tolist(), 20)
        assert packing.lower_bound(lengths, 20) <= least <= len(packing.repack(lengths, 20)[2]) <= least + 1


def test_partitions_exchange(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.randint(1, 1024)) for i in range(3000)], "piece_key long, length long")
    got = packing.pack(df, group_rows=300).toPandas()
    assert len(got) == 3000 and (got.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert got["sequence_id"].nunique() <= 1.02 * packing.lower_bound(got["length"].to_numpy(), 1024)


def test_repacking_keeps_pieces_and_gains():
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(300, 1000, 1500), rng.integers(20, 400, 900)])
    bins, offsets, fill = packing.repack(lengths, 1024)
    assert (np.bincount(bins, weights=lengths) == fill).all() and fill.max() <= 1024
    for b in range(0, len(fill), 37):
        m = np.flatnonzero(bins == b)
        m = m[np.argsort(offsets[m])]
        assert (offsets[m] == np.cumsum(lengths[m]) - lengths[m]).all()
    assert packing.lower_bound(lengths, 1024) <= len(fill) <= len(packing.best_fit(lengths, 1024)[2])
    assert packing.exact_fit(np.array([600, 400, 300, 124, 1024]), 1024)[2].tolist() == [1024, 1024, 400]
    assert len(packing.repack(np.array([], dtype=np.int64), 1024)[2]) == 0
