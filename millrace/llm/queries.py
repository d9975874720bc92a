"""Queries of the subpackage: thin calls that fix production parameters and pick the result's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed_dedup, html_extract, lloyd, masked_lm, mixing, ngram_join, packing, resample, target_sampling, token_counts, toxicity, url_filter
from .common import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [
    url_filter.host_rule("com/en/", "block"),
    url_filter.host_rule("example.com/en/7", "allow"),
    url_filter.host_rule("net/de/", "allow"),
    url_filter.host_rule("example.net/de/8", "block"),
    url_filter.host_rule("org/es/", "block"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
m AS (SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.range_sorted(mixed).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY source IS NULL, source) - 1 AS BIGINT) AS rank FROM s),
w AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM k),
f AS (SELECT *, cap / weight AS full_at, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN max(CASE WHEN full_at > level THEN level END) OVER () IS NULL THEN cap
  ELSE least(cap, weight * max(CASE WHEN full_at > level THEN level END) OVER ()) END AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source
  ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(
  least(size, greatest(0, floor(target) - start)) + least(size, greatest(0, floor(target) - source_size - start))
  + least(size, greatest(0, floor(target) - 2 * source_size - start)) AS BIGINT) AS taken FROM c
"""



def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where(~held_out() & (F.col("quality") == 1))
    return resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.fit_score(docs)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.fit(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxic_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = token_counts.Tokenizer(public_tokenizers.path("word_bpe_49k.json"), spaces=True, lower=True)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), words)


OP8_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, c.root FROM c JOIN l ON c.id = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, (SELECT min(root) FROM c WHERE c.id = v.vec_id) AS component_id,
  vec_id = (SELECT min(root) FROM c WHERE c.id = v.vec_id) AS kept FROM v
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n s ON s.doc_id = a JOIN n t ON t.doc_id = b WHERE 100 * k >= 80 * (s.n + t.n - k)),
c(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON c.id = l.a),
m AS (SELECT id, min(root) AS component_id FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""

#: One round of OP11_SQL: assignment, component sums, moved centroids.
_ROUND = """
a{i} AS MATERIALIZED (SELECT r, q, (min({{'d': list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT, 'k': k}})).k AS k FROM v, c{i} GROUP BY r, q),
s{i} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY k, i),
c{j} AS MATERIALIZED (SELECT k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{i} GROUP BY k) m USING (k)),"""

OP11_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, vec_id, q) - 1)::INT AS k, q AS c
  FROM (SELECT sha256('1:' || vec_id) AS h, vec_id, q FROM v ORDER BY h, vec_id, q LIMIT 16)),""" + "".join(_ROUND.format(i=i, j=i + 1) for i in range(3)) + """
f AS (SELECT r, vec_id, min({'d': list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT, 'k': k}) AS f FROM v, c3 GROUP BY r, vec_id)
SELECT vec_id, f.k AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (sum(f.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.c, ',')) AS centroid_sha256 FROM f JOIN c3 ON c3.k = f.k
"""

#: crc32 by its rule: 0xEDB88320 is 3988292384, the register starts and ends inverted.
OP12_SQL = r"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t),
d AS (SELECT 0 AS of, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT of, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
g AS MATERIALIZED (SELECT of, r, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS k FROM
  (SELECT of, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(n)) GROUP BY 1, 2, 3),
x AS MATERIALIZED (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM g)),
b AS MATERIALIZED (SELECT g, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
  lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295), 4294967295) % 10000 AS b FROM x, tab),
p AS MATERIALIZED (SELECT of, r, b, sum(k)::BIGINT AS k FROM g JOIN b USING (g) GROUP BY 1, 2, 3),
c AS (SELECT b, coalesce(sum(k) FILTER (of = 0), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (of = 1), 0)::DOUBLE AS t FROM p GROUP BY 1),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
e AS (SELECT b, floor(1000 * ln((c.t + 1) * (a.s + 10000) / ((c.s + 1) * (a.t + 10000))))::BIGINT AS e FROM c, a),
m AS (SELECT r, sum(k)::BIGINT AS n_features, sum(k * e)::BIGINT AS weight FROM p JOIN e USING (b) WHERE of = 0 GROUP BY 1),
z AS (SELECT r, doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN m USING (r) WHERE of = 0),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, 5 * count(*) OVER () // 100 AS k FROM z WHERE words >= 20)
SELECT doc_id, n_features, weight, score, o.rank FROM z LEFT JOIN o ON o.r = z.r AND o.rank <= o.k
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_masked_lm": op6_masked_lm,
    "op7_html_extraction": op7_html_extraction,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_target_resampling": op12_target_resampling,
    "op13_token_counts": op13_token_counts,
}
ORACLE = {"op2_url_filter": OP2_SQL, "op4_mixing": OP4_SQL, "op8_embedding_dedup": OP8_SQL, "op10_ngram_join": OP10_SQL, "op11_centroid_clustering": OP11_SQL, "op12_target_resampling": OP12_SQL}
