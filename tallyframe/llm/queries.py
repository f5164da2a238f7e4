"""The numbered queries over the tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM words, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, s.n AS n_shingles, m.component_id FROM sizes s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = s.doc_id
"""


def op2_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import fresh_path
    from .sharding import shard_documents

    store = shard_documents(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    return store.read().select("doc_id", F.length("text").cast("long").alias("n_code_points"), F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_code_points, sha256(text) AS text_sha256 FROM documents"


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2)


def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicate

    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", "text")


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, l[i] AS line, CAST(len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) AS INTEGER) AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i)),
b AS (SELECT *, sum(words) OVER w AS e, sum(words) OVER w - words AS s FROM lines WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
-- The shortest runs of 50 and more words, forwards and backwards.
f AS (SELECT doc_id, list(line) OVER w AS ls, min(pos) OVER w AS a, max(pos) OVER w AS z, sum(words) OVER w AS n FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
g AS (SELECT doc_id, list(line) OVER w AS ls, min(pos) OVER w AS a, max(pos) OVER w AS z, sum(words) OVER w AS n FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
runs AS (SELECT DISTINCT doc_id, ls, a, z FROM (SELECT * FROM f UNION ALL SELECT * FROM g) WHERE n >= 50),
first AS (SELECT ls, min(doc_id) AS d FROM runs GROUP BY ls),
first_at AS (SELECT r.ls, r.doc_id AS d, min(r.a) AS a, min(r.z) AS z FROM runs r JOIN first t ON r.ls = t.ls AND r.doc_id = t.d GROUP BY r.ls, r.doc_id),
later AS (SELECT r.doc_id, r.a, r.z FROM runs r JOIN first_at t ON r.ls = t.ls WHERE r.doc_id <> t.d OR r.a > t.z),
gone AS (SELECT DISTINCT doc_id, pos FROM later, unnest(range(a, z + 1)) AS r(pos)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(list_transform(q.e, lambda x: CAST(x AS DOUBLE)), list_transform(v.e, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def _op11_round(i: int) -> str:
    """Assignments of all parts by codebook i - 1, and codebook i."""
    return f"""
n{i} AS MATERIALIZED (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.row, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts p JOIN b{i - 1} b USING (part)) GROUP BY 1, 2),
u{i} AS MATERIALIZED (SELECT part, entry, list(x ORDER BY i) AS x FROM (
  SELECT p.part, a.entry, r.i, CAST(floor(sum(p.x[r.i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM parts p JOIN n{i} a USING (row, part), range(1, 9) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{i} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM b{i - 1} b LEFT JOIN u{i} u USING (part, entry)),"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p AS part, e[p * 8 + 1:p * 8 + 8] AS x FROM v, range(0, 8) r(p)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM parts WHERE row <= 16),{"".join(map(_op11_round, range(1, 8)))}
c AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n7 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (row) CROSS JOIN h
"""


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
fails AS (
  SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
    100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM w),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
x AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM fails LEFT JOIN l USING (doc_id)),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS own, string_split(filter_order[1:s - 1], '') AS before FROM orders, range(1, 6) AS r(s)),
m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k, i: f[i]) AS failed, count(*) AS n, count(CASE WHEN good THEN 1 END) AS good, count(CASE WHEN toxic THEN 1 END) AS toxic FROM x GROUP BY ALL),
y AS (
  SELECT part, filter_order, step, own, CAST(sum(CASE WHEN own NOT IN failed AND NOT list_has_any(failed, before) THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN own IN failed AND NOT list_has_any(failed, before) THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN own IN failed AND list_has_any(failed, before) THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed = [own] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN own IN failed AND NOT list_has_any(failed, before) THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN own IN failed AND NOT list_has_any(failed, before) THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM m CROSS JOIN steps GROUP BY ALL)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y
"""

def op13_naive_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality, train

    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_size_tiered_sharding,
        op3_spaced_seed_decontamination,
        op4_token_wavelet,
        op5_string_kernel_toxicity,
        op6_markov_secret_scan,
        op7_semi_markov_pii,
        op8_byte_bpe,
        op9_winnowed_line_dedup,
        op10_exact_topk,
        op11_vector_codes,
        op12_filter_interaction_audit,
        op13_naive_bayes_quality,
    )
}
#: The others have no SQL form that could run over whole tables; their tests compare with brute force.
ORACLES = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_size_tiered_sharding": OP2_SQL,
    "op9_winnowed_line_dedup": OP9_SQL,
    "op10_exact_topk": OP10_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_filter_interaction_audit": OP12_SQL,
}
