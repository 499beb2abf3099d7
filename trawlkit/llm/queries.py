"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlkit.llm import divergence, language, lines, packing, personal_data, pieces, quality, repeats, shingle_join, topk, toxicity, vector_codes, vector_neighbours
from trawlkit.llm.common import table
from trawlkit.session import written_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLES[make.__name__] = sql
        return make

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@query()
def op1_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    predicted = language.predict(docs.select("doc_id", "text"), language.train(docs), keep_text=False)
    return predicted.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT q.vec_id AS query_id, q.c AS asked, v.vec_id,
    CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
""")
def op2_top_k(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op3_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query()
def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.grade_labels(table(spark, folder, "labels")), n_grades=3)
    return toxicity.predict(docs, model, keep_text=False)


@query("""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reached(node, other) AS (
  SELECT vec_id, vec_id FROM usable UNION SELECT r.node, p.b FROM reached r JOIN pairs p ON r.other = p.a
), named AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT u.vec_id, coalesce(c.n, 0) AS n_links, n.component_id, u.vec_id = n.component_id AS kept
FROM usable u JOIN named n ON u.vec_id = n.node LEFT JOIN counted c ON u.vec_id = c.a
""")
def op5_near_vectors(spark, folder):
    return vector_neighbours.near_vectors(table(spark, folder, "embeddings"))


@query()
def op6_personal_data(spark, folder):
    found = personal_data.find_personal_data(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(personal_data.joined_spans("base_spans"), 256).alias("base_sha256"),
        personal_data.joined_spans("personal_spans").alias("spans"),
    )


@query()
def op7_sentencepiece(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256")
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), columns=wanted)


@query(f"""
WITH parts AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), bare AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM parts
), spread AS (
  SELECT body FROM bare WHERE body <> '' GROUP BY body HAVING count(DISTINCT source) >= {lines.MIN_SITES}
), judged AS (
  SELECT b.*, s.body IS NOT NULL AS common FROM bare b LEFT JOIN spread s ON b.body = s.body
), kept AS (
  SELECT doc_id, bool_or(body <> '' AND NOT common) AS own,
    count(*) AS n_lines, count(*) FILTER (common) AS n_common,
    coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT common), '') AS cleaned
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines,
  CASE WHEN k.own THEN k.n_common ELSE 0 END AS n_removed,
  CASE WHEN k.own THEN k.cleaned ELSE d.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""")
def op8_line_dedup(spark, folder):
    kept = lines.drop_spread_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "text")


@query()
def op10_ngram_join(spark, folder):
    return shingle_join.similar_documents(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op9_repeats(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, keep_bytes=False)


@query(f"""
WITH words AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc_id) >= {divergence.LEAST_DOCUMENTS}
), sizes AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY lang
), found AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), sums AS (
  SELECT g.lang, g.source, CAST(coalesce(sum(f.n), 0) AS HUGEINT) AS n
  FROM groups g LEFT JOIN found f ON g.lang = f.lang AND g.source = f.source GROUP BY g.lang, g.source
), dense AS (
  SELECT s.lang, s.source, k.term, coalesce(f.n, 0) AS n,
    1 + CAST({divergence.UNIT} AS HUGEINT) * (coalesce(f.n, 0) + 1) // (s.n + z.v) AS p,
    1 + CAST({divergence.UNIT} AS HUGEINT) * (k.total + 1) // (z.n + z.v) AS q
  FROM sums s JOIN kept k ON s.lang = k.lang JOIN sizes z ON s.lang = z.lang
  LEFT JOIN found f ON s.lang = f.lang AND s.source = f.source AND k.term = f.term
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON a.lang = f.lang AND a.source = f.source AND b.source = f.item
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM dense WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM items
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TERM_RANKS}
""")
def op11_source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))


def _vector_codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Full scans in every round."""
    steps = [f"""v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), cut AS MATERIALIZED (
  SELECT vec_id, j, list_slice(c, j * (len(c) // {parts}) + 1, (j + 1) * (len(c) // {parts})) AS x
  FROM v CROSS JOIN (SELECT unnest(range({parts})) AS j)
), book0 AS MATERIALIZED (
  SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k, x FROM cut
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
)"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, j, any_value(x) AS x, min({{'d': d, 'k': k}}) AS best FROM (
    SELECT c.vec_id, c.j, c.x, b.k, CAST(list_sum(list_transform(list_zip(c.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM cut c JOIN book{r} b ON c.j = b.j) GROUP BY vec_id, j
)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.j, b.k, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT j, k, list(CAST(floor(s / n) AS BIGINT) ORDER BY place) AS x FROM (
      SELECT j, best.k AS k, place, sum(x[place]) AS s, count(*) AS n
      FROM (SELECT j, best, x, unnest(range(1, len(x) + 1)) AS place FROM near{r}) GROUP BY j, best.k, place)
    GROUP BY j, k) m ON b.j = m.j AND b.k = m.k
)""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.k), '' ORDER BY j) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, k)) AS codebooks_sha256 FROM book{rounds}
)
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, d.codebooks_sha256, v.label
FROM v JOIN coded c ON v.vec_id = c.vec_id CROSS JOIN digest d"""


@query(_vector_codes_sql())
def op12_vector_codes(spark, folder):
    return vector_codes.compress(table(spark, folder, "embeddings"))[0]


@query()
def op13_quality(spark, folder):
    described = written_table(quality.describe(table(spark, folder, "documents").select("doc_id", "text")), "statistics")
    scored = quality.score(described, quality.train(described, table(spark, folder, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
