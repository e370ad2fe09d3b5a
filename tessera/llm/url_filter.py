"""URL filter with DataFrame operations only: host and path rules, else a logistic regression on hashed
character n-grams of host and path, trained from a small labelled table of URLs."""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER

#: (host, path prefix, verdict)
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
BUCKETS = 4096
GRAMS = (3, 4)
REGULARISATION = 0.005

#: The default training table: invented hosts and paths, 1 is to be blocked.
URLS = "urls.csv"
#: Of the table's host names those with this remainder modulo HELD_OF by crc32 are kept for measuring, with all rows.
HELD_OUT, HELD_OF = 1, 4
#: A host's name: what is left of it without what the table's hosts share before and behind it.
HOST_NAME = r"^(?:(?:www|cdn|blog|m)\.)?(.+?)(?:24|-online)?\.(?:example\.[a-z]+|test)$"


def default_urls() -> list[tuple[str, int]]:
    """The small labelled table that comes with the package."""
    with resources.files(__package__).joinpath(URLS).open(encoding="utf-8", newline="") as f:
        return [(r["url"], int(r["label"])) for r in csv.DictReader(f)]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string and its verdict; both null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, prefix, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def hashed_grams(host: Column, path: Column) -> Column:
    """The distinct buckets of the n-grams of host and of path, each with marks at both ends."""

    def of_length(kind: str, marked: Column, n: int) -> Column:
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - (n - 1)))
        hashed = F.transform(
            starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(marked, i, F.lit(n))), F.lit(BUCKETS)).cast("int")
        )
        return F.coalesce(hashed, F.array().cast("array<int>"))

    def grams(kind: str, part: Column) -> Column:
        marked = F.concat(F.lit("\2"), part, F.lit("\3"))
        return F.concat(*[of_length(kind, marked, n) for n in GRAMS])

    return F.array_distinct(F.concat(grams("h", host), grams("p", path)))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> tuple[list[float], float]:
    """Weights and intercept of a logistic regression over hashed_grams; the table is small by contract."""
    host, path = url_parts(F.col(url_col))
    found = labelled.select(hashed_grams(host, path).alias("grams"), F.col(label_col).cast("double").alias("label"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda i: F.when(F.array_contains(F.col("grams"), i), 1.0).otherwise(0.0),
    )
    rows = found.where("label is not null").select(array_to_vector(dense).alias("features"), "label").coalesce(1)
    model = LogisticRegression(maxIter=50, regParam=REGULARISATION, standardization=False).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def default_labelled(spark: SparkSession) -> DataFrame:
    """url, label, held_out of the default table; a few hundred rows. No host name is on both sides."""
    rows = ", ".join(f"('{url}', {label})" for url, label in default_urls())
    found = spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")
    name = F.regexp_extract(url_parts(F.col("url"))[0], HOST_NAME, 1)
    return found.withColumn("held_out", F.crc32(name.cast("binary")) % HELD_OF == HELD_OUT)


def judge(pages: DataFrame, model: tuple[list[float], float], rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every row's page_id, host, path, rule, verdict and block_score (the method's probability of block).

    A null url, or one without ://, has empty host and path and is judged on those; repeated rows are each
    judged; an empty table gives an empty result; other columns are not read.
    """
    weights, intercept = model
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    table = F.array(*[F.lit(w) for w in weights])
    margin = F.aggregate(
        hashed_grams(F.col("host"), F.col("path")), F.lit(intercept), lambda total, i: total + F.get(table, i)
    )
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-margin))
    return parts.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), score.alias("block_score")).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "block_score",
    )
