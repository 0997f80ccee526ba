"""URL filters: host-suffix and path-prefix expressions against a rule table.

Each URL is expanded into the expressions that a rule fitting it could have;
short hash prefixes of the expressions are equi-joined with those of the
rules, then full digests are compared and the rules' precedence decides. All
of it is DataFrame expressions, worked out once per distinct (host, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT_VERDICT = "allow"  # where no rule fits
HASH_BYTES = 4


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """(host, path, expression) rows: every label suffix of the host that has as
    many labels as some rule's host, with every prefix of the path whose length
    some rule's path has, a space between. ``labels`` and ``lengths`` are those
    numbers, at most one for each label and character of the longest rule."""
    held = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1
    suffixes = F.filter(F.array(*[F.when(held >= n, F.substring_index("host", ".", -n)) for n in labels]), lambda x: x.isNotNull())
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    return (urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
            .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
            .select("host", "path", F.concat_ws(" ", "suffix", "prefix").alias("expression")))


def digested(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 2 * HASH_BYTES))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. The longest rule wins; of equally long ones a block before an allow,
    then the first by name. Null or malformed urls have an empty host and path
    and fit no rule, as does a rule with an empty host; rules with nulls are
    left out. Repeated rows and repeated rules change nothing."""
    rules = rules.select("verdict", "host", "path").dropna().where(F.col("host") != "").distinct()
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().orderBy(F.length("path")).collect()]
    labels = [r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect()]
    rules = digested(rules.select("verdict", F.concat("host", "path").alias("rule"), F.length(F.concat("host", "path")).alias("n"),
                                  F.concat_ws(" ", "host", "path").alias("expression"))).drop("expression").withColumnRenamed("digest", "rule_digest")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    spelled = digested(expressions(rows.where(F.col("host") != "").select("host", "path").distinct(), labels, lengths))
    found = spelled.join(rules, "short").where(F.col("digest") == F.col("rule_digest"))
    order = F.struct(-F.col("n"), F.when(F.col("verdict") == "block", 0).otherwise(1), "rule", "verdict")
    best = found.groupBy("host", "path").agg(F.min(order).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return (rows.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
