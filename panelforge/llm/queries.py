"""The registered queries of the operators, each a thin layer that gives its operator's contract."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, divergence, fingerprints, html_extract, minhash, multi_index, packing, prefix_bpe, quotations, suffixes, token_output, toxicity
from .common import read_table, ship


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(read_table(spark, sf_dir, "documents"))


def op4_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digest_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.labelled_rows(docs, read_table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        (~toxicity.in_training()).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_output.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_output.read_tokens(shards)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(read_table(spark, sf_dir, "conversations"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.links(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_OPERATORS = (op1_html_extraction, op2_suffix_dedup, op3_fingerprints, op4_prefix_table, op5_toxicity, op6_token_output, op7_minhash, op8_quotations, op9_multi_index, op10_best_fit_packing, op11_source_divergence, op12_collocations, op13_decontamination)


def _with_package(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: _with_package(f) for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}


#: A suffix is hexadecimal here, two digits a byte; runs are those of the bytes that a repeated string covers.
OP2 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 399, 0))) AS p, h FROM d),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS s FROM starts),
twice AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM strings SEMI JOIN twice USING (s)),
runs AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, list(b ORDER BY a) AS stops, list(a ORDER BY a) AS starts, sum(b - a) AS gone FROM spans GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, h, coalesce(gone, 0) AS gone, coalesce(len(starts), 0) AS n,
         list_concat([0], coalesce(stops, [])) AS froms, list_concat(coalesce(starts, []), [length(h) // 2]) AS tos
  FROM d LEFT JOIN edges USING (doc_id))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda i: substr(h, 2 * froms[i] + 1, 2 * (tos[i] - froms[i]))), ''))) AS kept_sha256
FROM kept
"""

OP7 = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM d),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = doc_id
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE links.a = vec_id) AS BIGINT) AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM embeddings JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = vec_id
"""


OP11 = """
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents),
occ AS (SELECT row, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1) // (n + v) AS BIGINT) AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN size ON size.lang = g.lang LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term),
q AS (
  SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (sum(c) + 1) // (any_value(n) + any_value(v)) AS BIGINT) AS q
  FROM p JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY lang) USING (lang) JOIN size USING (lang) GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
told AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM told) QUALIFY part = 'pair' OR rank <= 200
"""

OP12 = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
words AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS c, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, m, c AS a, w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.c AS l, y.c AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (x.c + y.c) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[k + 1:cuts.m], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (SELECT lang, c, w, m, s, unnest(range(1, m - s + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS s) WHERE s < m),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(c) AS c FROM inner_of GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE inside.c IS NULL OR 100 * inside.c < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""

#: Windows of a document's words are joined to those of the items by length, as short items are windows of fewer words.
OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
sized AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM sized),
lengths AS (SELECT DISTINCT n FROM win),
starts AS (SELECT row, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT row, i, starts.n, item FROM starts JOIN win ON win.n = starts.n AND win.s = array_to_string(w[i:i + starts.n - 1], ' ')),
hit_words AS (SELECT row, count(DISTINCT p) AS c FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row),
hit_items AS (SELECT row, count(DISTINCT item) AS c, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.c, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.c, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.c, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (row) LEFT JOIN hit_items t USING (row)
"""


def oracle_sql() -> dict:
    """The operators that SQL can express on whole tables; the others are tested against brute force, the libraries or held-out labels."""
    return {"op2_suffix_dedup": OP2, "op7_minhash": OP7, "op9_multi_index": OP9, "op11_source_divergence": OP11, "op12_collocations": OP12, "op13_decontamination": OP13}
