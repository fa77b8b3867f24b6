"""The registered queries opN_<name>, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, divergence, langid, maxent_lm, ngram_join, packing, piece_lattice, quality, token_output, topk, toxicity, url_filters

#: A dated list: (list_name, scope, pattern, verdict, action, day of 2024).
ENTRIES = [
    ("spam", "host", "spam-farm.example.org", "block", "add", 0),
    ("spam", "domain", "tiontion.example.com", "block", "add", 10),
    ("spam", "domain", "tiontion.example.com", "block", "remove", 120),
    ("spam", "domain", "tiontion.example.com", "block", "add", 200),
    ("spam", "host", "m.tiontion.example.com", "allow", "add", 250),
    ("spam", "host", "tionsh.example.net", "block", "add", 30),
    ("spam", "host", "tionsh.example.net", "block", "remove", 60),
    ("spam", "host", "tionsh.example.net", "block", "add", 300),
    ("legal", "path", "tionsh.example.net/de", "block", "add", 0),
    ("legal", "path", "tionsh.example.net/en/100", "allow", "add", 0),
    ("legal", "domain", "example.org", "block", "add", 180),
    ("legal", "domain", "example.org", "block", "remove", 270),
    ("partner", "host", "ththth.example.org", "allow", "add", 90),
    ("partner", "domain", "ththth.example.org", "allow", "add", 190),
    ("partner", "path", "blog.tionble.example.com/fr", "allow", "add", 0),
    ("legal", "host", "blog.tionble.example.com", "block", "add", 45),
    ("legal", "host", "blog.tionble.example.com", "block", "add", 145),
    ("legal", "url", "https://ththan.example.net/en/1", "block", "add", 1),
    ("legal", "host", "m.ththin.example.org", "block", "add", 5),
    ("legal", "host", "m.ththin.example.org", "block", "remove", 5),
]
_DAY0 = 1704067200


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}', '{e}', timestamp_seconds({_DAY0 + 86400 * day}))" for a, b, c, d, e, day in ENTRIES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(list_name, scope, pattern, verdict, action, at)")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture; ``pages`` has no fetch time, so page_id sets a minute of a year of 365 days."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.pmod(F.col("page_id") * 7919, F.lit(525600)) * 60 + _DAY0).alias("fetched_at"))
    return url_filters.filter_urls(pages, entries(spark)).drop("url")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(docs)
    got = langid.identify(docs, langid.train(docs, learn=~held))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "entropy")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.ann_search(table(spark, sf_dir, "embeddings"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.training_order(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op8_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.digest_nbest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "learned_count", "insult_count", "disguised_count")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_quality_classifier, op3_language_id, op4_ngram_jaccard, op5_ann, op6_token_output, op7_exact_topk, op8_piece_nbest, op9_packing, op10_lm_scoring, op11_source_divergence, op12_toxicity, op13_centroid_clustering)}

_ENTRY_ROWS = ", ".join(f"('{a}', '{b}', '{c}', '{d}', '{e}', make_timestamp({(_DAY0 + 86400 * day) * 1000000}))" for a, b, c, d, e, day in ENTRIES)

#: Of an authority what comes after the last @, without a port and without dots at the end.
_HOST = "lower(rtrim(regexp_replace(list_last(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@')), ':[0-9]*$', ''), '.'))"


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and floored means, one pair of common tables after the other."""
    steps = [
        """w AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS cluster, v FROM w WHERE vec_id IS NOT NULL QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT w.row, w.vec_id, w.v, c.cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (w.v[i] - c.v[i]) * (w.v[i] - c.v[i]))) AS BIGINT) AS distance
  FROM w CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY w.row ORDER BY distance, c.cluster) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


ORACLES = {
    "op1_url_filters": f"""
WITH entries(list_name, scope, pattern, verdict, action, since) AS (VALUES {_ENTRY_ROWS}),
spans AS (
  SELECT list_name, scope, pattern, verdict, action, since AS valid_from,
         lead(since) OVER (PARTITION BY list_name, scope, pattern ORDER BY since, action, verdict) AS valid_to
  FROM (SELECT DISTINCT * FROM entries)
),
valid AS (SELECT * FROM spans WHERE action = 'add' AND (valid_to IS NULL OR valid_to > valid_from)),
captures AS (
  SELECT page_id, url, make_timestamp((((page_id * 7919) % 525600) * 60 + {_DAY0}) * 1000000) AS fetched_at,
         {_HOST} AS host,
         {_HOST} || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS place
  FROM pages
),
held AS (
  SELECT c.page_id, v.*, row_number() OVER (PARTITION BY c.page_id ORDER BY
           CASE scope WHEN 'url' THEN 4 WHEN 'path' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(pattern) DESC,
           CASE verdict WHEN 'allow' THEN 1 ELSE 0 END DESC, valid_from DESC, list_name DESC) AS pos,
         count(*) OVER (PARTITION BY c.page_id) AS n_active
  FROM captures c JOIN valid v ON c.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to) AND CASE scope
    WHEN 'url' THEN regexp_replace(c.url, '#.*$', '') = pattern
    WHEN 'host' THEN c.host = pattern
    WHEN 'path' THEN c.place = pattern OR starts_with(c.place, pattern || '/')
    ELSE c.host = pattern OR ends_with(c.host, '.' || pattern) END
)
SELECT c.page_id, c.host, c.fetched_at, coalesce(h.verdict, 'none') AS decision, h.list_name, h.scope, h.pattern, h.valid_from, coalesce(h.n_active, 0) AS n_active
FROM captures c LEFT JOIN held h ON h.page_id = c.page_id AND h.pos = 1
""",
    "op4_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM sets s
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
""",
    "op7_exact_topk": """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occ AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
size AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN own USING (lang, source) GROUP BY lang, source),
share AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, k.c AS whole,
    1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 1)) // (g.n + s.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (s.n::HUGEINT + s.v) AS q
  FROM grp g JOIN size s USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN pair p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM share WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op13_centroid_clustering": _clustering_sql(),
}
