"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.chat import transcript_table
from tablewright.llm.collocations import collocations
from tablewright.llm.fingerprints import fingerprint_table
from tablewright.llm.hard_negatives import mine_embeddings
from tablewright.llm.jaccard_join import similar_documents
from tablewright.llm.line_dedup import dedup_lines
from tablewright.llm.metric_tree import largest_products_by_rule
from tablewright.llm.mixing import mix_sources
from tablewright.llm.neighbours import nearest_by_rule
from tablewright.llm.packing import pack_documents
from tablewright.llm.quality import quality_table
from tablewright.llm.secrets import find_secrets
from tablewright.llm.token_files import token_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(func: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = func
        if sql is not None:
            ORACLES[name] = sql
        return func

    return register


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SECRETS_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pats(kind, rank, p) AS (VALUES
  ('assign', 1, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 2, 'AKIA[A-Z0-9]{12,}'),
  ('hex', 3, '[0-9a-f]{32,}'),
  ('identifier', 4, '(?i)(?:\b(?:user(?:name)?|login|account|client_id|access_key_id)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@+-]{3,})|(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)'),
  ('secret', 5, '[A-Za-z0-9+/_=-]{20,}'),
  ('endpoint', 6, '(?i)(?:[0-9+.-]*[A-Za-z][A-Za-z0-9+.-]+://[^\x09-\x0D\x20"''<>]+)|(?:\b(?:host|hostname|endpoint|server)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.:-]{3,})|(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?)'),
  ('break', 0, '\n[ \t\r]*\n')),
raw AS (SELECT doc_id, kind, rank, string_split_regex(t, p) AS g, regexp_extract_all(t, p) AS m FROM docs CROSS JOIN pats),
hit AS (SELECT doc_id, kind, rank, unnest(range(1, len(m) + 1)) AS no, g, m FROM raw WHERE len(m) > 0),
pos AS (SELECT doc_id, kind, rank, no, m[no] AS hit, length(m[no]) AS n,
          sum(length(g[no]) + length(m[no])) OVER (PARTITION BY doc_id, kind ORDER BY no) AS "end" FROM hit),
kept AS (SELECT doc_id,
          CASE WHEN kind = 'assign' AND length(regexp_extract(hit, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) < 8 THEN 'secret' ELSE kind END AS kind,
          "end" - n AS start, "end" FROM pos
         WHERE kind <> 'secret' OR (regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]'))),
ranked AS (SELECT *, CASE kind WHEN 'assign' THEN 1 WHEN 'access' THEN 2 WHEN 'hex' THEN 3 WHEN 'identifier' THEN 4 WHEN 'secret' THEN 5 WHEN 'endpoint' THEN 6 ELSE 0 END AS rank,
             kind IN ('assign', 'access', 'hex') AS base, kind IN ('assign', 'hex', 'secret') AS sec FROM kept),
scoped AS (SELECT *, count(*) FILTER (kind = 'break') OVER w AS scope,
             max("end") FILTER (base) OVER w AS bb,
             min(start) FILTER (base) OVER (PARTITION BY doc_id ORDER BY start, rank, "end" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ba
           FROM ranked WINDOW w AS (PARTITION BY doc_id ORDER BY start, rank, "end" ROWS UNBOUNDED PRECEDING)),
parts AS (SELECT * FROM scoped WHERE kind <> 'break' AND (base OR kind <> 'secret' OR NOT (coalesce(bb, -1) > start OR coalesce(ba, "end") < "end"))),
linked AS (SELECT a.*, base OR EXISTS (SELECT 1 FROM parts b WHERE b.doc_id = a.doc_id AND b.scope = a.scope AND b.sec <> a.sec
             AND (CASE WHEN (b.start, b.rank, b."end") < (a.start, a.rank, a."end") THEN a.start - b."end" ELSE b.start - a."end" END) <= 200) AS keep FROM parts a),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh,
          string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, rank, "end") FILTER (base) AS b,
          string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, rank, "end") AS s, count(*) FILTER (NOT base) AS nl
        FROM linked WHERE keep GROUP BY doc_id)
SELECT d.doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(nl, 0) AS n_linked
FROM docs d LEFT JOIN per USING (doc_id)
"""


@query("op1_secret_scan", SECRETS_SQL)
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=0)


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1)


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_document_fingerprints")
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(table(spark, sf_dir, "documents"))


@query("op10_hash_prefix_forest")
def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_rule(table(spark, sf_dir, "embeddings"))


LINE_DEDUP_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM split),
w AS (SELECT doc_id, pos, trim(line) AS a, lead(pos) OVER d AS pos2, lead(trim(line)) OVER d AS b, lead(pos, 2) OVER d AS pos3, lead(trim(line), 2) OVER d AS c
      FROM l WHERE trim(line) <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, first_value(doc_id) OVER k AS fd, first_value(pos) OVER k AS f1, first_value(pos2) OVER k AS f2, first_value(pos3) OVER k AS f3
      FROM w WHERE pos3 IS NOT NULL WINDOW k AS (PARTITION BY a, b, c ORDER BY doc_id, pos)),
later AS (SELECT * FROM f WHERE (doc_id, pos) <> (fd, f1)),
cov AS (SELECT doc_id, fd, f1, f2, f3, unnest([pos, pos2, pos3]) AS pos FROM later),
gone AS (SELECT DISTINCT doc_id, pos FROM cov WHERE doc_id <> fd OR pos NOT IN (f1, f2, f3)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS text
         FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op7_line_dedup", LINE_DEDUP_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents"), report=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


@query("op8_source_mixing")
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_start")


@query("op6_transcript_roles")
def op6_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_table(table(spark, sf_dir, "conversations"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\f\r]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM words),
tokens AS (SELECT doc_id, len(g) AS n, unnest(g) AS token FROM grams),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
           FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM common WHERE c >= 0.8 * (na + nb - c)),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
SELECT d.doc_id, coalesce(least(d.doc_id, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id)), d.doc_id) AS class_id,
  (SELECT count(*) FROM both_ways e WHERE e.a = d.doc_id) AS n_links
FROM documents d
"""


@query("op2_jaccard_join", JACCARD_SQL)
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


METRIC_TREE_SQL = r"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op11_metric_tree", METRIC_TREE_SQL)
def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_products_by_rule(table(spark, sf_dir, "embeddings"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM w, range(1, 6) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, m, g, a, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
cut AS (SELECT c.lang, c.g, c.m, c.a, c.k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:c.m] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
sub AS (SELECT lang, a AS longer, m, g, unnest(range(2, m)) AS size FROM f WHERE m >= 3),
inner_part AS (SELECT lang, longer, unnest(list_transform(range(1, m - size + 2), lambda i: g[i:i + size - 1])) AS g FROM sub),
gone AS (SELECT DISTINCT b.lang, b.g FROM best b JOIN inner_part i ON i.lang = b.lang AND i.g = b.g AND 100 * i.longer >= 100 * b.a),
kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b ANTI JOIN gone ON gone.lang = b.lang AND gone.g = b.g),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query("op12_collocations", COLLOCATIONS_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


HARD_NEGATIVES_SQL = r"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""


@query("op13_hard_negatives", HARD_NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_embeddings(table(spark, sf_dir, "embeddings"))
