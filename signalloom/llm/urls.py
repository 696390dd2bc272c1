"""URL filter: host rules, then gradient-boosted trees on lexical features trained from labelled URLs."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.tables import discard, materialise

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_tld", "f_domain", "f_section")
#: Suffixes whose blocked share is a feature: last label, last two labels, these with the first part of the path.
SUFFIXES = ("_tld", "_domain", "_section")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (lower-cased A-Z) and path; both empty for a null url or one without ://."""
    start = F.instr(F.col(url), "://")
    rest = F.when(start > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(F.col("_rest"), r"^[^/?#]*", 0)
    df = df.withColumn("_rest", rest).withColumn("_raw", raw)
    path = F.regexp_extract(F.expr("substring(_rest, length(_raw) + 1)"), r"^[^?#]*", 0)
    return df.withColumn("host", F.translate("_raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path).drop("_rest", "_raw")


def match_rule(rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits a character of the text's own character distribution; 0 for an empty text."""
    n = F.length(text)
    each = F.transform(F.array_distinct(F.split(text, "")), lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda acc, p: acc + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features but the suffix statistics, and the suffixes."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    return df.withColumns({
        "f_length": F.length(text).cast("double"),
        "f_depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
        "f_digits": (n - F.length(F.translate(text, "0123456789", ""))) / n.cast("double"),
        "f_entropy": entropy(text),
        "f_params": count("=").cast("double"),
        "f_labels": (F.length("host") - F.length(F.translate("host", ".", ""))).cast("double"),
        "_tld": F.substring_index("host", ".", -1),
        "_domain": F.substring_index("host", ".", -2),
        "_section": F.concat(F.substring_index("host", ".", -2), F.regexp_extract("path", r"^/[^/]*", 0)),
    })


def suffix_rates(labelled: DataFrame, key: str, prior: float = 4.0) -> DataFrame:
    """A suffix's share of blocked URLs, drawn to one half by `prior` URLs; a row per suffix of the bounded sample."""
    return labelled.groupBy(F.col(key).alias(f"{key}_k")).agg(((F.sum("label") + prior / 2) / (F.count(F.lit(1)) + prior)).alias(f"{key}_rate"))


def with_fold_rates(labelled: DataFrame, key: str, prior: float = 4.0, folds: int = 5) -> DataFrame:
    """Adds f{key}: the suffix's rate among the URLs of the other folds, so that no URL's own label is in its features."""
    rows = labelled.withColumn("_fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(folds)).cast("int"))
    sums = [F.sum("label").alias("_blocked"), F.count(F.lit(1)).alias("_n")]
    own = rows.groupBy(key, "_fold").agg(*sums)
    every = own.groupBy(key).agg(F.sum("_blocked").alias("_all_blocked"), F.sum("_n").alias("_all_n"))
    # Both have at most as many rows as the bounded sample.
    joined = rows.join(F.broadcast(own), [key, "_fold"]).join(F.broadcast(every), key)
    rate = (F.col("_all_blocked") - F.col("_blocked") + prior / 2) / (F.col("_all_n") - F.col("_n") + prior)
    return joined.withColumn(f"f{key}", rate).drop("_fold", "_blocked", "_n", "_all_blocked", "_all_n")


class UrlModel:
    """Trained trees with their suffix statistics."""

    def __init__(self, trees: GBTClassificationModel | None, rates: dict[str, DataFrame], constant: str):
        self.trees, self.rates, self.constant = trees, rates, constant

    def verdicts(self, df: DataFrame) -> DataFrame:
        """Adds method_verdict to rows with host, path and features."""
        if self.trees is None:
            return df.withColumn("method_verdict", F.lit(self.constant))
        out = self.trees.transform(assembled(df, self.rates))
        return out.withColumn("method_verdict", F.when(F.col("_block") > 0.5, "block").otherwise("allow"))


def assembled(df: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    for key, table in rates.items():
        df = df.join(F.broadcast(table), F.col(key) == F.col(f"{key}_k"), "left").withColumn(f"f{key}", F.coalesce(F.col(f"{key}_rate"), F.lit(0.5))).drop(f"{key}_k", f"{key}_rate")
    return vectors(df)


def vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(df)


def train(labelled: DataFrame, bound: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fits the trees on (url, label 1.0 = block) with host, path and features, from at most `bound` labelled urls.

    Each url counts once, however many rows have it; they are the first by a hash, the same on each run. A URL learns
    from suffix statistics of the other folds; those for new URLs come from all of the same rows, so the tables that
    are broadcast have at most `bound` rows. With one class or no rows the verdict is constant: that class, or allow.
    """
    rows = materialise(labelled.dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(bound), "labelled")
    seen = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if len(seen) < 2:
        discard(rows)
        return UrlModel(None, {}, "block" if seen == [1.0] else "allow")
    rates = {}
    for key in SUFFIXES:
        found = suffix_rates(rows, key).collect()
        schema = f"{key}_k string, {key}_rate double"
        rates[key] = labelled.sparkSession.createDataFrame([tuple(r) for r in found], schema)
    fit = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_block", maxIter=trees, maxDepth=depth, seed=seed).setProbabilityCol("_probability").setRawPredictionCol("_raw_prediction")
    learned = rows
    for key in SUFFIXES:
        learned = with_fold_rates(learned, key)
    # Each tree reads its rows anew: they are joined once, and kept.
    learned = materialise(learned.coalesce(2), "learned")
    ready = vectors(learned).select("_features", "label").persist()
    model = fit.fit(ready)
    ready.unpersist()
    for table in (learned, rows):
        discard(table)
    return UrlModel(model, rates, "allow")


def url_filter(pages: DataFrame, rules: tuple = RULES, bound: int = 20_000) -> DataFrame:
    """Adds host, path, rule, method_verdict and verdict to rows with a url.

    URLs that a rule decides are the labelled ones: the trees learn from them, and judge every URL; a rule's
    verdict goes before theirs. A null or unparsable url has empty host and path, fits no rule and is judged by
    its features like the others. Repeated urls are judged alike; an empty table gives an empty result.
    Columns of the added names, and those that begin with an underscore or f_, are replaced.
    """
    rule, said = match_rule(rules)
    rows = with_features(with_parts(pages)).withColumn("rule", rule).withColumn("_said", said)
    labelled = rows.where(F.col("_said").isNotNull()).withColumn("label", (F.col("_said") == "block").cast("double"))
    model = train(labelled.select("url", "label", *SUFFIXES, *[f for f in FEATURES if f[1:] not in SUFFIXES]), bound)
    judged = model.verdicts(rows)
    return judged.withColumn("verdict", F.coalesce("_said", "method_verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "method_verdict")
