"""One query per operator over the whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, collocations, decontaminate, mixing, pii, quality, rules, secrets, simhash, substring, toxicity, urls, vptree
from .common import crc_fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; learned from the labelled rows of folds 1 to 4."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_on=crc_fold() != 0)
    return toxicity.score(docs, model).withColumn("held_out", crc_fold() == 0)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the span classifier learns from the votes over all of them."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the decision list learns from the labelled rows of folds 1 to 4."""
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels"), train_on=crc_fold() != 0))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; the score limits come from the tokens and natural text of all of them."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from the labelled rows of folds 1 to 4."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train_on=crc_fold() != 0)
    return quality.score(docs, model).select("doc_id", (crc_fold() == 0).alias("held_out"), "score", "predicted")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without those in 13-word windows that a document with a smaller id holds too."""
    found = substring.remove_duplicates(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: 4-word shingles, at most 4 bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, d=4)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; urls under no rule are judged by the model."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.fit(urls.training_urls(spark)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of the test items, and the items found."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 highest-scoring phrases of two or three words."""
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, min_count=10, share=50, top=2000)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors for each whose id is divisible by 100, by exact search."""
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, relax=1.0)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents that score highest for each test item."""
    return balltree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_pii, op3_rules, op4_secrets, op5_quality, op6_substring, op7_simhash, op8_urls, op9_mixing, op10_decontamination, op11_collocations, op12_neighbours, op13_ranked)}


OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win
         FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT win, min(doc_id) AS f FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM wins JOIN first USING (win) WHERE doc_id > f),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone.n, 0) AS n_removed,
       sha256(CASE WHEN gone.n IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce((SELECT string_agg(x.word, ' ' ORDER BY x.p) FROM (SELECT unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS p) x
                             WHERE NOT list_contains(gone.ps, x.p)), '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, rk % 3 + 1 AS weight, 3 * source_size AS most FROM k),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(most) OVER o, 0))::DOUBLE
               / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY most / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most <= level * weight AS filled FROM l),
t AS (SELECT source, source_size,
             CASE WHEN filled THEN CAST(most AS DOUBLE)
                  ELSE (SELECT level FROM f WHERE NOT filled ORDER BY most / weight, rk LIMIT 1) * weight END AS target,
             CAST(('0x' || substr(md5(coalesce(source, '') || '#9'), 1, 8)) AS BIGINT) / 4294967296.0 AS u
      FROM f),
n AS (SELECT d.*, t.source_size, t.target, CAST(t.u AS DOUBLE) AS u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS r,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS i,
             count(*) OVER (PARTITION BY d.source) AS n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
top AS (SELECT source, any_value(r) AS r, any_value(u) AS u, list(size ORDER BY i DESC) AS sizes FROM n WHERE n - i < 256 GROUP BY source),
g AS (SELECT source, r, u, sizes, 0 AS j, CAST(0 AS BIGINT) AS upto, CAST(0 AS BIGINT) AS took, CAST([] AS BIGINT[]) AS copies FROM top
      UNION ALL
      SELECT source, r, u, sizes, j + 1, upto + s, took + c * s, list_append(copies, c)
      FROM (SELECT *, sizes[j + 1] AS s,
                   CAST(CASE WHEN sizes[j + 1] > 0
                        THEN least(greatest(floor((r * (upto + sizes[j + 1]) - took) / sizes[j + 1] + u), 0), 3) ELSE 0 END AS BIGINT) AS c
            FROM g WHERE j < len(sizes))),
w2 AS (SELECT source, upto, took, copies FROM g WHERE j = len(sizes)),
x AS (SELECT n.*, w2.copies,
             CASE WHEN source_size > upto THEN least(greatest((target - took) / (source_size - upto), 0.0), 3.0) ELSE 0.0 END AS rest
      FROM n JOIN w2 ON n.source IS NOT DISTINCT FROM w2.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN n - i < 256 THEN copies[n - i + 1]
            ELSE CAST(least(floor(i * rest + u) - floor((i - 1) * rest + u), 3) AS BIGINT) END * size AS taken
FROM x
"""

OP10_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS m FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, CAST(len(w) - least(len(w), 10) + 2 AS BIGINT))) AS i FROM items WHERE len(w) > 0)),
spots AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM words, sizes WHERE len(w) >= m)),
found AS (SELECT s.doc_id, s.i, s.m, v.item FROM spots s JOIN wins v ON s.win = v.win AND s.m = v.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(named.n_items, 0) AS n_items,
       sha256(coalesce(named.names, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP11_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
one AS (SELECT lang, unnest(w) AS phrase FROM w),
two AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, CAST(len(w) AS BIGINT))) AS i FROM w WHERE len(w) >= 2)),
three AS (SELECT lang, array_to_string(w[i : i + 2], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS i FROM w WHERE len(w) >= 3)),
f AS MATERIALIZED (
  SELECT lang, phrase, count(*) AS f, 1 AS size FROM one GROUP BY lang, phrase UNION ALL
  SELECT lang, phrase, count(*), 2 FROM two GROUP BY lang, phrase UNION ALL
  SELECT lang, phrase, count(*), 3 FROM three GROUP BY lang, phrase),
n AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail
        FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, cut.k, x.f AS l, y.f AS r,
                  CAST((1000000::HUGEINT * cut.a * cut.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
           FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = cut.head JOIN f AS y ON y.lang = cut.lang AND y.phrase = cut.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE size = 3)
  GROUP BY lang, phrase)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase, a, l, r, n.n, score
FROM best JOIN n ON n.lang = best.lang LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
WHERE longer.longer IS NULL OR 100 * longer.longer < 50 * a
QUALIFY row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) <= 2000
"""

OP12_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - e.v[i]) * (q.v[i] - e.v[i])), lambda x, y: x + y)) AS score
      FROM e AS q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""

OP13_SQL = """
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
i AS (SELECT row, item_id, unnest(w) AS term
      FROM (SELECT row_number() OVER () AS row, item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark)),
q AS (SELECT row, item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM w WHERE len(w) > 0),
m AS (SELECT row, doc_id, w, 100 - 75 + (75 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM w, s WHERE len(w) > 0),
t AS MATERIALIZED (SELECT row, doc_id, m, term, count(*) AS tf FROM (SELECT row, doc_id, m, unnest(w) AS term FROM m)
                   WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
      FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
r AS (SELECT q.row, item_id, t.row AS doc, doc_id, CAST(sum(weight * times * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN d USING (term) JOIN t USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring": OP6_SQL, "op9_mixing": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_collocations": OP11_SQL, "op12_neighbours": OP12_SQL, "op13_ranked": OP13_SQL}
