"""Queries of the vector operators (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import frame
from ..operators import vectors as v

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


COS = """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT label AS prompt, min_by(e, vec_id) AS q FROM x GROUP BY label),
c AS (SELECT vec_id, prompt, list_cosine_similarity(e, q) AS cosine FROM x CROSS JOIN p),
w AS (SELECT *, exp(100 * (cosine - max(cosine) OVER (PARTITION BY vec_id))) AS ex FROM c),
s AS (SELECT *, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM w),
b AS (SELECT vec_id, prompt, p FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, prompt) = 1) """


def _scores(spark, sf):
    x = frame(spark, sf, "embeddings")
    return v.similarities(x, v.first_prompts(x))


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM x) SELECT vec_id, CASE WHEN round(e[1] / n, 6) = 0 THEN 0.0::DOUBLE ELSE round(e[1] / n, 6) END AS first, CASE WHEN round(list_sum(list_transform(e, lambda y: y / n)), 5) = 0 THEN 0.0::DOUBLE ELSE round(list_sum(list_transform(e, lambda y: y / n)), 5) END AS total FROM n")
def m1_normalise(spark, sf):
    x = frame(spark, sf, "embeddings").select("vec_id", v.normalise(F.col("embedding")).alias("u"))
    return x.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query(COS + "SELECT vec_id, prompt, CASE WHEN round(cosine, 5) = 0 THEN 0.0::DOUBLE ELSE round(cosine, 5) END AS cosine FROM c")
def m2_cosine(spark, sf):
    return _scores(spark, sf).withColumn("cosine", F.round("cosine", 5))


@query("""WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT x.vec_id, y.vec_id AS prompt, list_cosine_similarity(x.e, list_transform(y.e, lambda a: -a)) AS cosine FROM x CROSS JOIN x AS y)
SELECT vec_id, prompt, round(cosine, 5) AS cosine FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, prompt) = 1""")
def m2_nearest_prompt(spark, sf):
    """The opposite of every vector is a prompt, in many blocks; the nearest is the vector that differs most."""
    x = frame(spark, sf, "embeddings")
    prompts = x.select(F.col("vec_id").alias("prompt"), F.transform("embedding", lambda a: -a).alias("prompt_vector"))
    return v.nearest_prompt(x, prompts, block=64).withColumn("cosine", F.round("cosine", 5))


@query(COS + "SELECT vec_id, prompt, round(p, 5) AS p FROM s")
def m3_softmax(spark, sf):
    return v.softmax(_scores(spark, sf)).select("vec_id", "prompt", F.round("p", 5).alias("p"))


@query(COS + "SELECT vec_id, prompt AS label, round(p, 4) AS score FROM b")
def m4_best_label(spark, sf):
    return v.best_label(v.softmax(_scores(spark, sf)))


@query(COS + "SELECT b.vec_id, round(b.p, 4) >= 0.6 OR coalesce(trim(d.text), '') <> '' AS present, CASE WHEN coalesce(trim(d.text), '') <> '' THEN md5(left(trim(d.text), 200)) END AS snippet FROM b LEFT JOIN documents d ON d.doc_id = b.vec_id")
def m5_text_presence(spark, sf):
    d = frame(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    x = v.best_label(v.softmax(_scores(spark, sf))).join(d, "vec_id", "left").select("vec_id", v.text_presence(F.col("score"), F.col("text")).alias("x"))
    return x.select("vec_id", "x.present", F.md5("x.snippet").alias("snippet"))


@query(COS + """, r AS (SELECT vec_id, prompt, round(p, 6) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 6) DESC, CAST(prompt AS VARCHAR)) AS k FROM s),
f AS (SELECT vec_id, max(CASE WHEN k = 1 THEN prompt END) AS l1, max(CASE WHEN k = 1 THEN p END) AS p1, max(CASE WHEN k = 2 THEN prompt END) AS l2, max(CASE WHEN k = 2 THEN p END) AS p2,
      max(CASE WHEN prompt = 1 THEN p END) > 0.5 OR max(CASE WHEN prompt = 2 THEN p END) > 0.22 OR max(CASE WHEN prompt = 3 THEN p END) > 0.22 AS veto FROM r GROUP BY vec_id),
g AS (SELECT vec_id, CASE WHEN p1 < 0.4 THEN 'Unknown' WHEN l1 = 0 AND (p1 < 0.65 OR veto) THEN CASE WHEN p2 >= 0.4 THEN CAST(l2 AS VARCHAR) ELSE 'Unknown' END ELSE CAST(l1 AS VARCHAR) END AS subject FROM f)
SELECT vec_id, subject, subject = '0' AS force_text FROM g""")
def m6_subject_cascade(spark, sf):
    s = v.softmax(_scores(spark, sf)).select("vec_id", F.struct(F.col("prompt").cast("string").alias("k"), F.round("p", 6).alias("v")).alias("e"))
    s = s.groupBy("vec_id").agg(F.map_from_entries(F.collect_list("e")).alias("scores"))
    return s.select("vec_id", v.subject_cascade(F.col("scores"), "0", "1", ("2", "3")).alias("x")).select("vec_id", "x.subject", "x.force_text")


@query(COS + "SELECT x.vec_id, b.prompt AS label FROM x JOIN b USING (vec_id)")
def m7_apply_labels(spark, sf):
    x = frame(spark, sf, "embeddings").select("vec_id", "label")
    return v.apply_labels(x, v.best_label(v.softmax(_scores(spark, sf))).select("vec_id", "label"), "vec_id", "label")[0]


@query(COS + "SELECT count(*) AS n, count(*) AS matched, CAST(0 AS BIGINT) AS unmatched, CAST(sum(CASE WHEN x.label IS DISTINCT FROM b.prompt THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM x JOIN b USING (vec_id)")
def m7_label_summary(spark, sf):
    x = frame(spark, sf, "embeddings").select("vec_id", "label")
    return v.apply_labels(x, v.best_label(v.softmax(_scores(spark, sf))).select("vec_id", "label"), "vec_id", "label")[1]
