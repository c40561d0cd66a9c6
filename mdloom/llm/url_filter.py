"""URL filters (5): host and path rules, and gradient-boosted trees on lexical features for the rest.

The rules label what they fit; the trees learn from a bounded sample of those labelled URLs and judge the others. One pair
of features, the shares of blocked URLs by host suffix, is counted over all labelled rows.
"""

import math
from collections import Counter

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdloom.llm.common import join_counted, written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url_col: str) -> DataFrame:
    """page_id, url, host, path."""
    cut = F.instr("url", "://")
    rest = F.when(cut > 0, F.substr("url", cut + 3)).otherwise("")
    out = pages.withColumn("rest", F.coalesce(rest, F.lit("")))
    out = out.withColumn("host", lower_ascii(F.regexp_extract("rest", r"\A([^/?#]*)", 1)))
    return out.withColumn("path", F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1)).drop("rest")


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def suffix(labels: int) -> Column:
    return F.substring_index("host", ".", -labels)


def lexical(url: str, host: str, path: str) -> list[float]:
    n = len(url)
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    digits = sum(c.isdigit() for c in url)
    query = url.partition("?")[2].partition("#")[0]
    first = path.split("/")[1] if path.count("/") else ""
    return [float(n), float(path.count("/")), digits / n if n else 0.0, entropy, float(len([x for x in query.split("&") if x])), float("#" in url), float(len(host)), float(host.count(".")), float(host.count("-")), float(url.startswith("https")), float(len(path)), float(len(first)), float(sum(map(ord, first[:2])))]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(url: pd.Series, host: pd.Series, path: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
    """one, two: shares of blocked URLs by the host's last label and last two."""
    return pd.Series([[*lexical(u or "", h, p), a, b] for u, h, p, a, b in zip(url, host, path, one, two, strict=True)])


def url_verdicts(pages: DataFrame, rules=RULES, max_labelled: int = 20_000, rounds: int = 10, depth: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (of block, null where a rule decides).

    Host and path are empty for null URLs and those without ``://``; such rows fit no rule and are judged by the trees like
    others. Repeated rows and null ids are judged one by one; an empty table gives an empty one. At most max_labelled
    distinct labelled URLs are learnt from, the first of each verdict by a hash of the URL, in proportion but with a
    twentieth of either at least; with labels of one kind only, that is the verdict of all others, and without labels it is
    allow. Only id and URL are read, so further columns may have any name; an empty URL is judged by the trees, a very long one
    whole; equal URLs get equal verdicts. Counts by suffix, which all rows make, are joined back to the rows.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    name, verdict = rule_of(rules)
    ruled = with_parts(base, url_col).withColumn("rule", name).withColumn("verdict", verdict)
    blocks = F.col("verdict") == "block"
    distinct = ruled.where("verdict is not null").select("url", "host", "path", "verdict").distinct()
    n = {r.verdict: r["count"] for r in distinct.groupBy("verdict").count().collect()}
    if len(n) < 2:
        only = next(iter(n), "allow")
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    least = max(1, max_labelled // 20)
    share = round(max_labelled * n["block"] / (n["block"] + n["allow"]))
    most = {"block": max(min(least, n["block"]), min(share, max_labelled - min(least, n["allow"])))}
    most["allow"] = max_labelled - most["block"]
    rows = []  # at most max_labelled
    for kind, top in most.items():
        place = F.pmod(F.xxhash64("url"), F.lit(1 << 30))  # few rows beyond those taken go to the driver
        few = distinct.where((F.col("verdict") == kind) & (place <= int(min(1.0, (1.2 * top + 100) / n[kind]) * (1 << 30)))).orderBy(place, "url").limit(top)
        rows += [(r.url, r.host, r.path, float(kind == "block")) for r in few.collect()]
    each = ruled.select(F.explode(F.array_distinct(F.array(suffix(1), suffix(2)))).alias("suffix"), blocks.alias("label"))
    seen = written(each.groupBy("suffix").agg(F.count("*").alias("rows"), F.count("label").alias("labelled"), F.count_if("label").alias("blocked")), "suffixes")
    total = ruled.where("verdict is not null").agg(F.avg(blocks.cast("double"))).first()[0]
    rates = seen.select("suffix", "rows", ((F.col("blocked") + 5 * total) / (F.col("labelled") + 5)).alias("rate"))

    def rated(df: DataFrame) -> DataFrame:
        for i in (1, 2):
            df = join_counted(df.withColumn("suffix", suffix(i)), rates, ["suffix"], "rows").drop("suffix", "rows").withColumnRenamed("rate", f"rate{i}")
        return df

    vector = array_to_vector(features("url", "host", "path", "rate1", "rate2"))
    spark = pages.sparkSession
    known = rated(spark.createDataFrame(rows, "url string, host string, path string, label double"))
    known = spark.createDataFrame(sorted(known.collect()), known.schema)  # in one order, so that the fit is too
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7).fit(known.select(vector.alias("features"), "label").coalesce(2))
    judged = model.transform(rated(ruled).withColumn("features", vector))
    score = F.when(F.col("verdict").isNull(), F.get(vector_to_array("probability"), F.lit(1)))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))

