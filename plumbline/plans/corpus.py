"""Queries of corpus preparation: filters, clusters, keywords, triplets, names, generated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import corpus as C
from plumbline.operators import vectors as V
from plumbline.plans.common import ASG, TRIPLETS, assigned, rounded, triplets, vectors
from plumbline.session import table
from plumbline.sources import io

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Texts with a few planted headings, blanks and short ones.
RAW = f"""raw AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN ' = Title ' || doc_id || ' = ' WHEN doc_id % 50 = 8 THEN '   '
  WHEN doc_id % 50 = 9 THEN ' short text ' ELSE ' ' || text || ' ' END AS text FROM documents),
cl AS (SELECT doc_id, trim(text, {WS}) AS text FROM raw),
rs AS (SELECT doc_id, text, CASE WHEN text = '' THEN 'empty' WHEN regexp_full_match(text, '=+\\s.*\\s=+\\s*', 's') THEN 'heading'
  WHEN length(text) < 50 THEN 'short' END AS reason FROM cl)"""


def raw(spark, sf):
    m = F.col("doc_id") % 50
    text = (
        F.when(m == 7, F.concat(F.lit(" = Title "), F.col("doc_id").cast("string"), F.lit(" = ")))
        .when(m == 8, "   ")
        .when(m == 9, " short text ")
        .otherwise(F.concat(F.lit(" "), F.col("text"), F.lit(" ")))
    )
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


def filtered(spark, sf):
    return C.keep_first(C.clean(raw(spark, sf)), "doc_id", 300).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def assignments(spark, sf):
    d = V.centroid_distances(vectors(spark, sf).withColumn("cluster_label", F.when(F.col("cluster_label") == 9, -1).otherwise(F.col("cluster_label"))), "cluster_label")
    rows = d.select(
        "text_id", "cluster_label", T.domain_name(F.col("cluster_label"), F.lit(None).cast("array<string>")).alias("domain"),
        (F.col("cluster_label") == -1).alias("is_noise"), F.round("distance_to_centroid", 6).alias("distance_to_centroid"),
    )
    return io.assignment_rows(rows)[0]


def with_noise(spark, sf):
    return assigned(spark, sf).withColumn("cluster_label", F.when(F.col("cluster_label") == 9, -1).otherwise(F.col("cluster_label")))


def keywords(spark, sf):
    return C.top_keywords(assigned(spark, sf), "cluster_label", "text_id")


def domains(spark, sf):
    k = C.keyword_lists(keywords(spark, sf), "cluster_label")
    return k.select("cluster_label", T.domain_name(F.col("cluster_label"), F.col("keywords")).alias("domain"), F.array_join("keywords", "|").alias("keywords"))


def summary_rows(spark, sf):
    s = C.cluster_sizes(assigned(spark, sf))
    k = C.keyword_lists(keywords(spark, sf), "cluster_label")
    return io.summary_rows(s.join(k, "cluster_label", "left")).select("cluster_label", "size", "ratio", "is_noise", "keywords")


def split_counts(spark, sf):
    t = triplets(spark, sf)
    return t.groupBy("triplet", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text_id").alias("texts"), F.sum("text_id").alias("id_sum"))


def manifest_stats(spark, sf):
    return triplets(spark, sf).agg(F.count_distinct("triplet").alias("n_triplets"), F.count_distinct("cluster_label").alias("n_domains"), F.count(F.lit(1)).alias("n_samples"))


def representatives(spark, sf):
    return triplets(spark, sf).groupBy("cluster_label").agg(F.min("triplet").alias("triplet"))


NAMES = ["7", "triple_12_x", "triplet_003", "foo", " 15 ", "x_triplet_4_y", ""]
PICKS = "triplet_004, 3  triplet_003,7;x,3 foo"


def names(spark, sf):
    n = spark.createDataFrame([(x,) for x in NAMES], "name string").select("name", T.canonical_triplet(F.col("name")).alias("canonical"))
    number = F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(canonical, 'triplet_(\\d+)$', 1), '') AS int)"), F.lit(1_000_000_000))
    return n.withColumn("number", number)


def picks(spark, sf):
    return spark.range(1).select(F.posexplode(T.selection(F.lit(PICKS))).alias("pos", "name")).select("pos", "name", T.canonical_triplet(F.col("name")).alias("canonical"))


def qa_records(spark, sf):
    """User turns and the assistant's next turn as question and answer, with prompt."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    qa = nxt.filter("role = 'user' AND r2 = 'assistant'").select("conv_id", "turn", T.as_question(F.col("text")).alias("q"), T.collapse(F.col("t2")).alias("a"))
    return qa.select("conv_id", "turn", F.md5("q").alias("question"), F.md5("a").alias("answer"), F.md5(T.closed_book_prompt(F.col("q"))).alias("prompt"))


def qa_outputs(spark, sf):
    """(conv_id, turn, form, raw): each user turn and the assistant's next as a generated text, in six forms that take turns."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    qa = nxt.filter("role = 'user' AND r2 = 'assistant'").withColumn("form", (F.col("conv_id") + F.col("turn")) % 6)
    pair = F.to_json(F.struct(F.col("text").alias("question"), F.col("t2").alias("answer")))
    draft = F.lit('draft {"question": "Draft?", "answer": "wrong"} assistantfinal ')
    forms = (
        pair, F.concat(F.lit("```json\n"), pair, F.lit("\n```")), F.concat(draft, pair, F.lit(" end")), F.regexp_replace(pair, '"}$', ""),
        F.concat(F.lit("\u0130\u0130 thinks: Final answer:= "), pair), F.concat(F.lit("Final: "), F.col("text")),
    )
    return qa.select("conv_id", "turn", "form", F.element_at(F.array(*forms), F.col("form").cast("int") + 1).alias("raw"))


def qa_parse(spark, sf):
    q, a, why = T.parse_answer(F.col("raw"))
    return qa_outputs(spark, sf).select("conv_id", "turn", F.md5(q).alias("question"), F.md5(a).alias("answer"), why.alias("reason"))


def sampled(spark, sf):
    a = assigned(spark, sf)
    return C.sample_per_group(a, "cluster_label", "text_id", 7).select("cluster_label", "text_id")


def indexed(spark, sf):
    return io.add_index(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


def raw_stats(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.trim(t) == "").alias("blank"), F.sum(F.length(t)).alias("chars"))


STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
KEYWORDS = (
    ASG
    + f""",
kw AS (SELECT cluster_label, text_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM asg),
kc AS (SELECT cluster_label, term, count(DISTINCT text_id) AS df, count(*) AS total FROM kw WHERE length(term) >= 3 AND term NOT IN ({STOP}) GROUP BY 1, 2),
km AS (SELECT *, max(df) OVER (PARTITION BY cluster_label) AS most FROM kc),
top AS (SELECT cluster_label, row_number() OVER (PARTITION BY cluster_label ORDER BY total DESC, term) AS rank, term, total FROM km WHERE df >= least(5, most)
        QUALIFY rank <= 10)"""
)
NOISY = ASG.replace("e.label AS", "CASE WHEN e.label = 9 THEN -1 ELSE e.label END AS")
_VALUES = ", ".join(f"('{n}')" for n in NAMES)
QUERIES = {
    "raw_stats": (raw_stats, "SELECT count(*) AS rows, count(*) FILTER (trim(coalesce(text, '')) = '') AS blank, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents"),
    "filter_reasons": (lambda s, sf: C.filter_stats(C.clean(raw(s, sf))), f"WITH {RAW} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM rs GROUP BY 1"),
    "filtered_texts": (filtered, f"WITH {RAW} SELECT doc_id, length(text) AS n, md5(text) AS digest FROM rs WHERE reason IS NULL ORDER BY doc_id LIMIT 300"),
    "cluster_summary": (
        lambda s, sf: rounded(C.cluster_summary(with_noise(s, sf))),
        f"""WITH {NOISY}, n AS (SELECT cluster_label, count(*) AS n FROM asg GROUP BY 1)
        SELECT sum(n)::BIGINT AS n_texts, count(*) FILTER (cluster_label <> -1) AS n_clusters, coalesce(sum(n) FILTER (cluster_label = -1), 0)::BIGINT AS noise_count,
        round(coalesce(sum(n) FILTER (cluster_label = -1), 0) / sum(n), 6) AS noise_ratio, max(n) FILTER (cluster_label <> -1) AS largest,
        min(n) FILTER (cluster_label <> -1) AS smallest, floor(quantile_cont(n, 0.5) FILTER (cluster_label <> -1))::INT AS median FROM n""",
    ),
    "cluster_sizes": (
        lambda s, sf: rounded(C.cluster_sizes(with_noise(s, sf))),
        f"WITH {NOISY} SELECT cluster_label, count(*) AS size, round(count(*) / (SELECT count(*) FROM asg), 6) AS ratio, cluster_label = -1 AS is_noise FROM asg GROUP BY 1",
    ),
    "cluster_keywords": (keywords, f"WITH {KEYWORDS} SELECT * FROM top"),
    "domain_names": (
        domains,
        f"""WITH {KEYWORDS} SELECT cluster_label, string_agg(term, '_' ORDER BY rank) FILTER (rank <= 3) AS domain, string_agg(term, '|' ORDER BY rank) AS keywords FROM top GROUP BY 1""",
    ),
    "summary_rows": (
        summary_rows,
        f"""WITH {KEYWORDS}, k AS (SELECT cluster_label, string_agg(term, '|' ORDER BY rank) AS keywords FROM top GROUP BY 1)
        SELECT cluster_label, size, printf('%.8f', size / total) AS ratio, cluster_label = -1 AS is_noise, keywords
        FROM (SELECT cluster_label, count(*) AS size FROM asg GROUP BY 1) CROSS JOIN (SELECT count(*) AS total FROM asg) LEFT JOIN k USING (cluster_label)""",
    ),
    "assignments": (
        assignments,
        """WITH e AS (SELECT vec_id AS text_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        x AS (SELECT text_id, cluster_label, unnest(v) AS x, unnest(range(len(v))) AS p FROM e),
        c AS (SELECT cluster_label, p, avg(x) AS m FROM x WHERE cluster_label <> -1 GROUP BY 1, 2),
        d AS (SELECT text_id, sqrt(sum((x.x - m) * (x.x - m))) AS d FROM x JOIN c USING (cluster_label, p) GROUP BY 1)
        SELECT text_id, cluster_label, CASE WHEN cluster_label = -1 THEN 'noise' ELSE 'cluster_' || cluster_label END AS domain, cluster_label = -1 AS is_noise,
        coalesce(printf('%.6f', round(d, 6)), '') AS distance_to_centroid FROM e LEFT JOIN d USING (text_id)""",
    ),
    "triplet_splits": (triplets, f"WITH {TRIPLETS} SELECT * FROM trip"),
    "triplet_skips": (
        lambda s, sf: C.triplet_skips(assigned(s, sf), "cluster_label", (50, 50, 50), 10),
        f"WITH {ASG} SELECT cluster_label, count(*) AS cluster_size, 150 AS required_cluster_size, 10 AS skipped_triplets FROM asg WHERE cluster_label <> -1 GROUP BY 1 HAVING count(*) < 150",
    ),
    "split_disjointness": (split_counts, f"WITH {TRIPLETS} SELECT triplet, split, count(*) AS n, count(DISTINCT text_id) AS texts, sum(text_id)::BIGINT AS id_sum FROM trip GROUP BY 1, 2"),
    "manifest_stats": (manifest_stats, f"WITH {TRIPLETS} SELECT count(DISTINCT triplet) AS n_triplets, count(DISTINCT cluster_label) AS n_domains, count(*) AS n_samples FROM trip"),
    "cluster_representatives": (representatives, f"WITH {TRIPLETS} SELECT cluster_label, min(triplet) AS triplet FROM trip GROUP BY 1"),
    "sample_per_cluster": (
        sampled,
        f"WITH {ASG} SELECT cluster_label, text_id FROM asg QUALIFY row_number() OVER (PARTITION BY cluster_label ORDER BY md5('42:' || cluster_label || ':' || text_id), text_id) <= 7",
    ),
    "sample_rows": (
        lambda s, sf: C.sample_rows(assigned(s, sf), "text_id", 100).select("text_id", "cluster_label"),
        f"WITH {ASG} SELECT text_id, cluster_label FROM asg ORDER BY md5('42:' || text_id), text_id LIMIT 100",
    ),
    "ordinal_index": (indexed, 'SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS "index" FROM documents'),
    "canonical_names": (
        names,
        f"""WITH n AS (SELECT * FROM (VALUES {_VALUES}) t(name)), d AS (SELECT name, trim(name) AS t FROM n),
        e AS (SELECT name, t, coalesce(nullif(regexp_extract(t, '^(\\d+)$', 1), ''), nullif(regexp_extract(t, 'triplet_(\\d+)', 1), ''), nullif(regexp_extract(t, 'triple_(\\d+)', 1), '')) AS k FROM d),
        f AS (SELECT name, CASE WHEN k IS NULL THEN t ELSE 'triplet_' || lpad(k::INT::VARCHAR, 3, '0') END AS canonical FROM e)
        SELECT name, canonical, coalesce(try_cast(nullif(regexp_extract(canonical, 'triplet_(\\d+)$', 1), '') AS INT), 1000000000) AS number FROM f""",
    ),
    "selection_parse": (
        picks,
        f"""WITH p AS (SELECT unnest(x) AS name, unnest(range(len(x))) AS i FROM (SELECT list_filter(regexp_split_to_array('{PICKS}', '[,\\s]+'), lambda y: y <> '') AS x)),
        q AS (SELECT name, min(i) AS i FROM p GROUP BY 1)
        SELECT (row_number() OVER (ORDER BY i) - 1)::INT AS pos, name,
        CASE WHEN regexp_matches(name, '^\\d+$') THEN 'triplet_' || lpad(name, 3, '0') ELSE name END AS canonical FROM q""",
    ),
    "qa_records": (
        qa_records,
        """WITH n AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        a AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q, trim(regexp_replace(t2, '\\s+', ' ', 'g')) AS a FROM n WHERE role = 'user' AND r2 = 'assistant'),
        b AS (SELECT conv_id, turn, a, CASE WHEN q = '' OR q LIKE '%?' THEN q ELSE regexp_replace(q, '[.!]+$', '') || '?' END AS q FROM a)
        SELECT conv_id, turn, md5(q) AS question, md5(a) AS answer, md5('Question: ' || q || chr(10) || 'Answer:') AS prompt FROM b""",
    ),
    "qa_parse": (
        qa_parse,
        """WITH n AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        a AS (SELECT conv_id, turn, (conv_id + turn) % 6 = 5 AS lost, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q, trim(regexp_replace(t2, '\\s+', ' ', 'g')) AS a
              FROM n WHERE role = 'user' AND r2 = 'assistant'),
        b AS (SELECT *, CASE WHEN q = '' OR q LIKE '%?' THEN q ELSE regexp_replace(q, '[.!]+$', '') || '?' END AS asked FROM a)
        SELECT conv_id, turn, CASE WHEN NOT lost THEN md5(asked) END AS question, CASE WHEN NOT lost THEN md5(a) END AS answer,
        CASE WHEN lost THEN 'unparsable' END AS reason FROM b""",
    ),
}
