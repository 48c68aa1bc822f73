"""URL filters: host rules first, else a logistic regression on hashed character n-grams.

Everything a page passes through is a column expression; the model is fitted by Spark's own
logistic regression on a small labelled table.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

# Rules (verdict, host and path), and labelled URLs.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
LABELLED = tuple((u, 0) for u in (
    "http://news.example.org/en/2041", "https://www.example.net/en/17.html",
    "https://example.org/de/3301/", "http://m.example.net/de/77", "https://blog.example.org/fr/9",
    "https://library.example.edu/catalog/item/88", "https://docs.example.org/guide/install.html",
    "https://history.example.org/articles/rome", "http://school.example.edu/courses/physics",
    "https://www.example.gov/health/report-2020", "https://travel.example.org/es/madrid",
    "https://recipes.example.net/soup/tomato", "https://science.example.org/papers/1204.html",
    "https://www.example.net/about", "https://forum.example.org/thread/5512",
    "https://wiki.example.org/wiki/Mountain", "https://museum.example.org/en/exhibits",
    "http://garden.example.net/plants/rose.html", "https://weather.example.org/de/berlin",
    "https://code.example.org/project/readme", "https://thther.example.org/en/685",
    "https://tionsh.example.net/de/18382.html", "https://m.ththth.example.net/en/25",
    "https://www.example.org/es/402/", "https://edreon.example.net/en/9013/",
    "https://sport.example.org/fr/football", "https://radio.example.net/en/podcast/3",
)) + tuple((u, 1) for u in (
    "http://free-casino-bonus.example.org/slots/win", "https://bestcasino777.example.net/bet",
    "http://poker-online.example.org/jackpot", "http://xxx-video.example.net/watch/porn",
    "https://hot-sex-cam.example.org/live", "http://adult-xxx.example.net/gallery/nude",
    "http://cheap-viagra-pills.example.org/buy", "https://buy-cialis.example.net/discount",
    "http://replica-watches.example.org/cheap", "http://crack-keygen.example.net/download/warez",
    "http://torrent-warez.example.org/full-crack", "http://free-money-win.example.net/claim-prize",
    "http://click-prize.example.org/winner.php", "http://betting-slots.example.net/casino",
    "https://porn-hub-free.example.org/sex", "http://payday-loans.example.net/fast-cash",
    "http://loans-cash-now.example.org/apply-cheap", "http://xxx-nude.example.net/cam",
    "http://malware-download.example.org/exe/setup.exe", "http://phish-login.example.net/verify-account",
    "http://verify-bank-login.example.org/account", "http://casino-slots-bonus.example.net/play",
    "http://viagra-discount.example.net/pills", "http://sexy-porn-cam.example.org/xxx",
))
DIMENSIONS = 1024
GRAM = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit("")))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's. The list is part
    of the program, so it becomes one expression, longest rule first.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def buckets(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams of host and path; digits count as one character."""
    text = F.concat(F.lit("^"), F.regexp_replace(F.concat(host, path), "[0-9]+", "0"), F.lit("$"))
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.transform(places, lambda i: F.pmod(
        F.xxhash64(F.substring(text, i, F.lit(GRAM))), F.lit(DIMENSIONS)).cast("int"))


def train(spark: SparkSession, labelled=LABELLED) -> tuple[float, list[float]]:
    """(intercept, weight of each bucket), fitted on counts of n-grams."""
    host, path = host_and_path(F.col("url"))
    named = spark.createDataFrame(list(labelled), "url string, label int").coalesce(1).withColumn(
        "b", buckets(host, path))
    counts = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.size(
        F.filter("b", lambda x: x == i)).cast("double"))
    ready = named.select(F.col("label").cast("double").alias("label"),
                         array_to_vector(counts).alias("features"))
    model = LogisticRegression(maxIter=100, regParam=0.02, standardization=False).fit(ready)
    return float(model.intercept), [float(w) for w in model.coefficients]


def block_score(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    intercept, weights = model
    table = F.array(*map(F.lit, weights))
    total = F.aggregate(buckets(host, path), F.lit(intercept),
                        lambda s, b: s + F.element_at(table, b + 1))
    return 1 / (1 + F.exp(-total))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every url.

    One row per input row, repeated ones and null ids included; a null url, or one without a host,
    has empty host and path and is judged by the model on that.
    """
    model = train(pages.sparkSession, labelled)
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"),
                         path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = split.select("*", rule.alias("rule"), verdict.alias("ruled"),
                          block_score(F.col("host"), F.col("path"), model).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
        .alias("verdict"), "score")
