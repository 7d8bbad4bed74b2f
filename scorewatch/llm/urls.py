"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Every step is a DataFrame or SQL expression; the trees are Spark ML's. URLs that a rule
decides are the labelled URLs. The classifier is fitted on at most `MAX_LABELLED` different
ones, taken in the order of a seeded hash of the url and weighted by their copies, and
judges every url that no rule fits.

Features: lengths of url, host and path; path depth; digit ratio; character entropy;
numbers of parameters, dots, hyphens; scheme; and the smoothed share of blocked urls
among all labelled rows by host suffix and by registered domain (suffix statistics). For a url of
the fit, rows of its own fold of urls do not count: its label is not in its features.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged
by the classifier; with labelled urls of one verdict only, all others get that verdict;
with none, they are allowed. Repeated rows get one row each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import table, written

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_LABELLED = 20_000
ROUNDS, DEPTH, SEED, FOLDS, SALTS = 15, 4, 17, 5, 16
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ["f_len", "f_host_len", "f_path_len", "f_depth", "f_digits", "f_entropy", "f_params", "f_query_len", "f_dots",
            "f_hyphens", "f_secure", "f_suffix", "f_domain"]


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add `host` (A-Z lower-cased) and `path`."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return (df.withColumn("host", F.translate(host, LETTERS, LETTERS.lower()))
            .withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Add `rule` and `ruled` (its verdict): the longest rule that fits, else null."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return df.withColumn("rule", rule).withColumn("ruled", ruled)


def _entropy(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    share = F.transform(F.array_distinct(F.split(text, "")),
                        lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the lexical features and the keys `suffix`, `domain` of the statistics."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    count = lambda s, ch: (F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))).cast("double")
    return df.select(
        "*", F.element_at(F.split("host", r"\."), -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"),
        F.length(u).cast("double").alias("f_len"), F.length("host").cast("double").alias("f_host_len"),
        F.length("path").cast("double").alias("f_path_len"), count(F.col("path"), "/").alias("f_depth"),
        (F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1))).alias("f_digits"),
        _entropy(u).alias("f_entropy"), F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0).alias("f_params"),
        F.length(query).cast("double").alias("f_query_len"), count(F.col("host"), ".").alias("f_dots"),
        count(u, "-").alias("f_hyphens"), u.startswith("https://").cast("double").alias("f_secure"))


KEYS = ("suffix", "domain")


class UrlModel:
    """The fitted trees with the suffix and domain statistics they were trained on."""

    def __init__(self, labelled: DataFrame, max_labelled: int, rounds: int, depth: int, seed: int):
        """`labelled`: (label, copies, url_hash, url, suffix, domain, features) of every different labelled url."""
        self.trees, self.only = None, "allow"
        counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.sum("copies").alias("n")).collect()}
        self.prior = counts.get(1.0, 0) / max(1, sum(counts.values()))
        each = labelled.withColumn("fold", F.pmod("url_hash", F.lit(FOLDS)))
        self.folds = {k: written(each.groupBy(k, "fold").agg(F.sum(F.col("label") * F.col("copies")).alias("b"), F.sum("copies").alias("n")), f"url-{k}") for k in KEYS}
        if len(counts) == 1:
            self.only = "block" if 1.0 in counts else "allow"
        elif counts:
            sample = each.orderBy("url_hash", "url").limit(max_labelled)
            stages = [VectorAssembler(inputCols=FEATURES, outputCol="features"),
                      GBTClassifier(labelCol="label", featuresCol="features", predictionCol="blocked", maxIter=rounds,
                                    maxDepth=depth, seed=seed, stepSize=0.2, weightCol="copies")]
            self.trees = Pipeline(stages=stages).fit(written(self._out_of_fold(sample), "url-sample"))

    def _share(self, b: Column, n: Column) -> Column:
        return (F.coalesce(b, F.lit(0.0)) + 5 * self.prior) / (F.coalesce(n, F.lit(0)) + 5)

    def _out_of_fold(self, df: DataFrame) -> DataFrame:
        for k, stat in self.folds.items():
            total = stat.groupBy(k).agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
            df = df.join(total, k, "left").join(stat, [k, "fold"], "left")
            df = df.withColumn(f"f_{k}", self._share(F.col("all_b") - F.coalesce("b", F.lit(0.0)), F.col("all_n") - F.coalesce("n", F.lit(0)))).drop("all_b", "all_n", "b", "n")
        return df

    def _joined(self, df: DataFrame) -> DataFrame:
        # A merge join at every size: the statistics have as many rows as the labelled urls have domains. One domain
        # may hold most pages, so every key is dealt over SALTS tasks.
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")  # copies of a url too
        for k, stat in self.folds.items():
            total = stat.groupBy(k).agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
            total = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            df = df.withColumn("salt", salt).join(total.hint("merge"), [k, "salt"], "left").withColumn(f"f_{k}", self._share(F.col("all_b"), F.col("all_n"))).drop("all_b", "all_n", "salt")
        return df

    def judge(self, df: DataFrame) -> DataFrame:
        """`df` with parts, rule and features, plus `verdict`."""
        if self.trees is None:
            return df.withColumn("verdict", F.coalesce("ruled", F.lit(self.only)))
        scored = self.trees.transform(self._joined(df))
        return scored.withColumn("verdict", F.coalesce("ruled", F.when(F.col("blocked") == 1.0, "block").otherwise("allow")))


def prepared(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """(page_id, url) with parts, rule and features."""
    return with_features(with_rule(with_parts(pages.select("page_id", url), url), rules), url)


def fit(df: DataFrame, url: str = "url", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, depth: int = DEPTH,
        seed: int = SEED) -> UrlModel:
    """Fit on at most `max_labelled` different urls that a rule decides (`df` from `prepared`); the statistics are of all."""
    rows = df.where(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == "block").cast("double"))
    own = [f for f in FEATURES if f not in ("f_suffix", "f_domain")]
    # Copies of a url are counted first: it has one verdict, and one set of features.
    labelled = rows.groupBy(url, "label").agg(F.count(F.lit(1)).cast("double").alias("copies"), *[F.first(c).alias(c) for c in (*KEYS, *own)])
    labelled = labelled.withColumn("url_hash", F.xxhash64(F.lit(seed), F.col(url))).withColumnRenamed(url, "url")
    return UrlModel(written(labelled, "url-labelled"), max_labelled, rounds, depth, seed)


def q_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepared(table(spark, sf_dir, "pages"))
    return fit(df).judge(df).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op8_url_trees": q_urls}
ORACLE: dict[str, str] = {}
