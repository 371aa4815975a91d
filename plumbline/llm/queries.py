"""The ``opN_`` queries: each operator over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact_dedup, language, near_dedup, packing, quality, token_counts, toxicity, url_filter, warc
from plumbline.session import fresh_path, table

URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, fold("doc_id", 4) != 2)
    return language.identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.content_sort(docs, keep="max").drop("text")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_toxicity, op2_language, op3_packing, op4_warc, op5_quality, op6_near_dedup,
        op7_exact_dedup, op8_bpe, op9_token_counts, op10_url_filter,
    ]
    return {f.__name__: f for f in own}


def _url_sql() -> str:
    """The URL filter in SQL: rules, Witten-Bell models as joins of counts, scores, threshold, verdict."""
    u = url_filter
    a, unit, width = u.ALPHABET, u.UNIT, 8 * u.UNIT / u.BINS
    folded = f"translate(coalesce(url, ''), '{u.UPPER}123456789', '{u.LETTERS}{'0' * 9}')"
    fits = lambda r: "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    pick = lambda i: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[i]}'" for r in sorted(URL_RULES, key=lambda r: -len(r[0]))) + " END"
    return f"""
        WITH h AS (SELECT row_number() OVER () AS n, page_id, url, {folded} AS s,
              translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{u.UPPER}', '{u.LETTERS}') AS host,
              regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r AS (SELECT *, {pick(0)} AS rule, {pick(1)} AS ruled FROM h),
        t AS (SELECT n, ruled, md5(coalesce(url, ''))[1] < '4' AS held FROM r WHERE ruled IS NOT NULL),
        c AS (SELECT n, [{u.START}, {u.START}] || list_transform(range(1, length(s) + 1),
              lambda i: CASE WHEN instr('{u.SYMBOLS}', substr(s, i, 1)) > 0 THEN instr('{u.SYMBOLS}', substr(s, i, 1)) - 1 ELSE {u.OTHER} END) AS c FROM r),
        g AS (SELECT n, c[i] AS x, c[i + 1] AS y, c[i + 2] AS z FROM c, unnest(range(1, len(c) - 1)) AS t(i)),
        l AS (SELECT ruled AS k, x, y, z, count(*) AS m FROM g JOIN t USING (n) WHERE NOT held GROUP BY ALL),
        n0 AS (SELECT k, z, sum(m) AS m FROM l GROUP BY ALL), t0 AS (SELECT k, sum(m) AS t, count(*) AS d FROM n0 GROUP BY ALL),
        n1 AS (SELECT k, y, z, sum(m) AS m FROM l GROUP BY ALL), t1 AS (SELECT k, y, sum(m) AS t, count(*) AS d FROM n1 GROUP BY ALL),
        t2 AS (SELECT k, x, y, sum(m) AS t, count(*) AS d FROM l GROUP BY ALL),
        q AS (SELECT DISTINCT k, x, y, z FROM g CROSS JOIN t0),
        p0 AS (SELECT q.*, (coalesce(n0.m, 0) + t0.d * (1.0::DOUBLE / {a})) / (t0.t + t0.d) AS p FROM q JOIN t0 USING (k) LEFT JOIN n0 USING (k, z)),
        p1 AS (SELECT p0.* EXCLUDE (p), CASE WHEN t1.t IS NULL THEN p ELSE (coalesce(n1.m, 0) + t1.d * p) / (t1.t + t1.d) END AS p
               FROM p0 LEFT JOIN t1 USING (k, y) LEFT JOIN n1 USING (k, y, z)),
        p2 AS (SELECT p1.* EXCLUDE (p), CASE WHEN t2.t IS NULL THEN p ELSE (coalesce(l.m, 0) + t2.d * p) / (t2.t + t2.d) END AS p
               FROM p1 LEFT JOIN t2 USING (k, x, y) LEFT JOIN l USING (k, x, y, z)),
        w AS (SELECT x, y, z, round((max(ln(p)) FILTER (k = 'allow') - max(ln(p)) FILTER (k = 'block')) * {unit})::BIGINT AS w FROM p2 GROUP BY ALL),
        sc AS (SELECT n, sum(w)::BIGINT / count(*) AS score FROM g LEFT JOIN w USING (x, y, z) GROUP BY 1),
        s AS (SELECT r.*, coalesce(score, 0) AS score FROM r LEFT JOIN sc USING (n)),
        b AS (SELECT greatest(0, least({u.BINS - 1}, floor((score + {4 * unit}) / {width})))::INT AS bin, t.ruled FROM s JOIN t USING (n) WHERE held),
        e AS (SELECT i, (1 - (SELECT count(*) FROM b WHERE ruled = 'allow' AND bin <= i) / (SELECT count(*) FROM b WHERE ruled = 'allow'))
              + (SELECT count(*) FROM b WHERE ruled = 'block' AND bin <= i) / (SELECT count(*) FROM b WHERE ruled = 'block') AS v FROM range({u.BINS}) t(i)),
        th AS (SELECT coalesce((SELECT (i + 1) * {width} - {4 * unit} FROM e WHERE isfinite(v) ORDER BY round(v, 12) DESC, i LIMIT 1), 0) AS cutoff)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cutoff THEN 'allow' ELSE 'block' END) AS verdict, score / {unit} AS score
        FROM s CROSS JOIN th"""


def oracle_sql() -> dict[str, str]:
    return {
        "op10_url_filter": _url_sql(),
        "op4_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            q AS (SELECT page_id, strlen(body) AS n, sha256(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
            SELECT page_id, n AS payload_bytes, h AS payload_digest,
                   CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
            FROM q""",
        "op7_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   row_number() OVER (PARTITION BY body ORDER BY doc_id DESC) = 1 AS kept,
                   sha256(body) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY body)""",
    }
