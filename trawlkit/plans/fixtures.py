"""Crawl tables derived from the test tables, written once for Spark and for DuckDB.

Each is a SELECT over base tables or other derived tables in braces; both engines accept it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["events", "documents", "pages"]

_JOB = "regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1)"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_DOC_URL = "concat('http://', {0}.source, '.example/', {0}.lang, '/', CAST({0}.doc_id AS STRING))"

DERIVED = {
    "url_strings": "SELECT page_id AS id, url FROM {pages}",
    "queued_urls": """SELECT page_id AS id, page_id AS url_string_id,
        CASE page_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'error' WHEN 2 THEN 'in_progress'
          WHEN 3 THEN 'skipped' ELSE 'todo' END AS status FROM {pages}""",
    "old_urls": "SELECT id, url_string_id AS url_str_id, status FROM {queued_urls}",
    "seeds": f"SELECT {_JOB} AS job, page_id AS ord, url FROM {{pages}} WHERE url LIKE '%/'",
    "candidates": f"SELECT {_JOB} AS job, page_id AS seq, url, url NOT LIKE '%#top' AS verdict FROM {{pages}}",
    "patterns": """SELECT * FROM (VALUES ('global', 1, '[?&]utm_source='), ('global', 2, '^https?://www[.]'),
        ('global', 3, '# a comment'), ('global', 4, ''),
        ('site', 1, '^https?://{{any_start_netloc}}/.+[?&]ref='), ('site', 2, '^https?://{{any_start_netloc}}/de/'),
        ('site', 3, '[?&]utm_source='), ('user', 1, '/es/'), ('user', 2, '^https?://(m|blog)[.]ththan[.]example[.]net/'),
        ('user', 3, '[?&[]id=[[0-4]'), ('user', 4, '/{{id}}|1{{2}}/|[a&&b]/[#t]'))
        AS t(set_name, line_no, pattern)""",
    "pattern_lines": "SELECT 'notes' AS set_name, CAST(doc_id AS INT) AS line_no, concat(CASE WHEN lang = 'de' THEN '#' ELSE '' END, CASE WHEN n_chars < 40 THEN '' ELSE source END) AS pattern FROM {documents}",
    "fetches": """SELECT event_id AS seq, ts, concat('job', CAST(user_id % 8 AS STRING)) AS job,
        event_id % (SELECT count(*) FROM {pages}) AS page_id,
        CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 302 WHEN 'purchase' THEN 206 WHEN 'signup' THEN 404 END AS status_code,
        CASE WHEN event_type = 'error' THEN 'timeout' END AS error,
        CAST(floor(value * 100) AS BIGINT) AS body_size FROM {events}""",
    "queue_events": """SELECT event_id AS seq, concat('job', CAST(user_id % 8 AS STRING)) AS job,
        CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'queued' WHEN event_type = 'purchase' THEN 'dequeued' ELSE 'other' END AS event
        FROM {events}""",
    "heads": f"""SELECT e.event_id AS seq, e.ts, concat('job', CAST(e.user_id % 8 AS STRING)) AS job,
        CASE WHEN e.k % 15 = 4 THEN concat(p.url, '.MP4') ELSE p.url END AS url,
        CASE WHEN e.k % 30 = 11 THEN 'none' ELSE CAST(e.k * 1000 AS STRING) END AS content_length,
        CASE WHEN e.k % 10 = 0 THEN 'Video/mp4' ELSE 'text/html' END AS content_type,
        CASE WHEN e.k % 25 = 3 THEN 'ICY' ELSE 'HTTP/1.1' END AS version,
        CASE WHEN e.k % 20 = 7 THEN 'Icecast 2.4' ELSE 'nginx' END AS server,
        CASE WHEN e.k % 20 = 9 THEN 'Ice-audio-info' ELSE 'X-Other' END AS extra_name
        FROM (SELECT *, {_K} AS k, event_id % (SELECT count(*) FROM {{pages}}) AS page_id FROM {{events}}) AS e
        JOIN {{pages}} AS p ON e.page_id = p.page_id""",
    "bodies": "SELECT doc_id AS seq, concat('http://', source, '.example/', CAST(doc_id AS STRING)) AS url, text AS body FROM {documents}",
    "bodies_near": """SELECT page_id AS seq, url, html AS body FROM {pages} UNION ALL
        SELECT page_id + 1000000 AS seq, url, concat(html, '<!-- gen ', CAST(1700000000 + page_id AS STRING), ' -->') AS body FROM {pages}""",
    "pairs": "SELECT doc_id AS left_seq, doc_id + 1 AS right_seq FROM {documents}",
    "doc_urls": f"SELECT d.doc_id, d.source, d.lang, {_DOC_URL.format('d')} AS url FROM {{documents}} AS d",
    "crawl_links": """SELECT 'crawl' AS job, s.url AS src, d.url AS dst, s.inline
        FROM (SELECT url, doc_id * 2 + 1 AS dst_id, false AS inline FROM {doc_urls} UNION ALL
              SELECT url, doc_id * 2 + 2 AS dst_id, true AS inline FROM {doc_urls}) AS s
        JOIN {doc_urls} AS d ON d.doc_id = s.dst_id""",
    "source_seeds": """SELECT 'crawl' AS job, u.url FROM {doc_urls} AS u JOIN
        (SELECT source, min(doc_id) AS doc_id FROM {doc_urls} GROUP BY source) AS f ON u.doc_id = f.doc_id""",
    "root_seed": "SELECT 'crawl' AS job, url FROM {doc_urls} WHERE doc_id = (SELECT min(doc_id) FROM {doc_urls})",
    # Every event is a line of the log; some texts are refused, and hours make lines of one instant.
    "controls": f"""SELECT job, CASE event_type WHEN 'view' THEN 'max_content_length' WHEN 'click' THEN 'delay' WHEN 'purchase' THEN 'concurrency'
          WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'igoff' ELSE 'video' END ELSE CASE WHEN k >= 98 THEN 'stop' ELSE 'scrape' END END AS name,
        CASE WHEN event_type = 'view' THEN CASE WHEN k % 7 = 0 THEN 'soon' WHEN k % 7 = 1 THEN concat(' ', CAST(k * 1000 AS STRING), ' ') ELSE CAST(k * 1000 AS STRING) END
          WHEN event_type = 'click' THEN CASE k % 7 WHEN 0 THEN '-' WHEN 1 THEN concat(CAST(k AS STRING), '-x') WHEN 2 THEN concat(CAST(k AS STRING), '-', CAST(k * 2 AS STRING)) ELSE CAST(k AS STRING) END
          WHEN event_type = 'purchase' THEN CASE WHEN k % 7 = 0 THEN '' ELSE CAST(k - 50 AS STRING) END
          WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'off' ELSE 'maybe' END
          WHEN k >= 98 THEN 'on' WHEN k % 11 = 0 THEN 'bad' WHEN k < 20 AND k % 2 = 0 THEN 'off' ELSE 'on' END AS value,
        date_trunc('hour', effective_ts) AS effective_ts, seq
        FROM (SELECT event_id AS seq, event_type, concat('job', CAST(user_id % 8 AS STRING)) AS job, {_K} AS k, CAST(ts AS TIMESTAMP) AS effective_ts
              FROM {{events}}) AS e""",
    "crawls": """SELECT job, concat('id-', job) AS ident, concat('http://', job, '.example/') AS url, CAST(1704067200 AS DOUBLE) AS started_at
        FROM (SELECT DISTINCT job FROM {fetches}) AS j""",
    "result_urls": "SELECT f.*, p.url FROM {fetches} AS f JOIN {pages} AS p ON f.page_id = p.page_id",
    "refusals": """SELECT e.event_id * 2 + 1 AS seq, e.ts, concat('job', CAST(e.user_id % 8 AS STRING)) AS job, p.url, concat('^', substr(p.url, 1, 12)) AS pattern,
        CASE WHEN e.event_id % 3 = 0 THEN 'response' ELSE 'url' END AS stage
        FROM (SELECT *, event_id % (SELECT count(*) FROM {pages}) AS page_id FROM {events}) AS e JOIN {pages} AS p ON e.page_id = p.page_id
        WHERE e.event_type IN ('view', 'error')""",
    "candidate_times": "SELECT c.*, e.ts FROM {candidates} AS c JOIN {events} AS e ON c.seq = e.event_id",
    "candidate_controls": f"""SELECT c.job, 'igoff' AS name, CASE e.k % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'off' ELSE '?' END AS value, CAST(e.ts AS TIMESTAMP) AS effective_ts, e.seq
        FROM {{candidates}} AS c JOIN (SELECT event_id AS seq, ts, {_K} AS k, event_id % (SELECT count(*) FROM {{pages}}) AS page_id FROM {{events}}) AS e ON c.seq = e.page_id""",
    "igset_log": """SELECT c.job, 'igsets' AS name, CASE c.seq % 4 WHEN 0 THEN 'global,site' WHEN 1 THEN 'site' WHEN 2 THEN ' ' ELSE 'user,global' END AS value,
        CAST(date_trunc('hour', e.ts) AS TIMESTAMP) AS effective_ts, c.seq FROM {candidates} AS c JOIN {events} AS e ON c.seq = e.event_id WHERE c.seq % 3 = 0""",
    "rule_versions": """SELECT set_name, line_no, pattern, CAST(NULL AS TIMESTAMP) AS effective_ts FROM {patterns} UNION ALL
        SELECT v.set_name, v.line_no, v.pattern, m.effective_ts FROM (SELECT * FROM (VALUES ('site', 1, '^https?://{{any_start_netloc}}/en/'), ('site', 2, '/fr/[0-9]+[#?]'),
          ('own:de', 1, '/de/[0-9]+$'), ('own:en', 1, '[.]html$'), ('unused', 1, '.')) AS t(set_name, line_no, pattern)) AS v
        CROSS JOIN (SELECT max(effective_ts) AS effective_ts FROM {igset_log} WHERE seq <= (SELECT max(seq) / 2 FROM {igset_log})) AS m""",
    "telemetry": """SELECT concat('c', job) AS conn_id, CAST(-1 AS BIGINT) AS seq,
        concat('{{"type":"hello","mode":"', CASE WHEN job = 'job7' THEN 'dashboard' ELSE 'grabber' END, '","url":"http://', job, '/"}}') AS payload
        FROM (SELECT DISTINCT job FROM {fetches}) AS j UNION ALL
        SELECT concat('c', job) AS conn_id, seq, concat('{{"type":"', CASE WHEN page_id % 9 = 0 THEN 'other' ELSE 'download' END,
          '","job_data":{{"ident":"', job, '","note":null,"extra":{{"z":[1,2,null],"a":"x"}}}},"url":"http://x/', CAST(page_id AS STRING), '","response_code":',
          CAST(coalesce(status_code, 0) AS STRING), ',"response_message":', CASE WHEN page_id % 5 = 0 THEN 'null' ELSE concat('"', coalesce(error, 'ok'), '"') END, '}}') AS payload
        FROM {fetches}""",
    "sitemaps": """SELECT DISTINCT concat(regexp_extract(url, '^(https?://[^/]+)', 1), '/sitemap.xml') AS url,
        concat('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>', url, '</loc></url><url><loc>', url, 'x</loc></url></urlset>') AS body
        FROM {pages}""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


class Crawl:
    """Tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._made[name] = self.sql(DERIVED[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        frames = {n: self[n] for n in _needs(text)}
        return self.spark.sql(text, **frames) if frames else self.spark.sql(text.format())


def duckdb_sql(text: str) -> str:
    """The query with the derived tables it names as CTEs."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in _needs(sql):
            if name in DERIVED and name not in order:
                visit(DERIVED[name])
                order.append(name)

    visit(text)
    names = {n: n for n in [*BASE, *DERIVED]}
    ctes = [f"{n} AS ({DERIVED[n].format(**names)})" for n in order]
    body = text.format(**names)
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body.lstrip()[len("WITH RECURSIVE"):]
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body.lstrip()[len("WITH"):]
    return "WITH " + ", ".join(ctes) + " " + body
