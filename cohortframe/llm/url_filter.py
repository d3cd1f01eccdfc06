"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

DataFrame functions and MLlib's tree booster only, so all rows stay in the JVM.

Features are lexical, and none is looked up by folder. Statistics of host
suffixes are cross-fitted: a URL that the trees learn from has its suffix's
rate from the other folds of the sample, so no label is its own feature.

Cases: null url, or one without "://", has empty host and path, null rule, and
is judged by the trees; where the sample has labels of one class alone, that
class is every unruled verdict, and without any labels it is `allow`; an empty
table gives no rows; repeated rows are judged each, and count once in the
sample; URLs of any length are judged whole; rules of equal length that both
fit cannot differ in text, so none tie. Columns of the names host, path, rule,
verdict and score are replaced; all others stay as they are, whatever their names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): host and path prefix in one text. Rules are few; they become one expression.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Before the names of columns that judging adds and takes away again.
OWN = "_url_filter_"
FEATURES = ("length", "host_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "parameters", "fragment", "suffix_rate", "suffix_weight")
#: Those that say what labels a suffix has; the others describe a URL by itself.
SUFFIX_FEATURES = ("suffix_rate", "suffix_weight")
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty if there is no "://"."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda x: len(x[0])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def lexical_features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the lexical features that need no statistics, named with a prefix of their own."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    letters = F.split(F.lower(url), "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns(
        {
            OWN + "length": F.length(url).cast("double"),
            OWN + "host_length": F.length(OWN + "host").cast("double"),
            OWN + "labels": F.size(F.split(OWN + "host", r"\.")).cast("double"),
            OWN + "depth": (F.length(OWN + "path") - F.length(F.regexp_replace(OWN + "path", "/", ""))).cast("double"),
            OWN + "digit_ratio": F.length(F.regexp_replace(url, r"[^0-9]", "")) / size,
            OWN + "hyphens": (F.length(OWN + "host") - F.length(F.regexp_replace(OWN + "host", "-", ""))).cast("double"),
            OWN + "entropy": -F.aggregate(counts, F.lit(0.0), lambda a, p: a + p * F.log2(p)),
            OWN + "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            OWN + "fragment": F.when(url.contains("#"), 1.0).otherwise(0.0),
            OWN + "suffix": suffix_of(F.col(OWN + "host")),
        }
    )


@dataclass
class UrlModel:
    """Trained trees (null if the sample had one class), the features that they take, and statistics of host suffixes: of the
    whole sample, and for each fold of the others."""

    trees: GBTClassificationModel | None
    only: float
    features: tuple[str, ...]
    suffixes: dict[str, tuple[float, float]]
    apart: list[dict[str, tuple[float, float]]]
    prior: float


def _looked_up(key: Column, table: dict[str, tuple[float, float]], which: int, default: float) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[which]))), key), F.lit(default))


def with_statistics(rows: DataFrame, model: UrlModel, fold: Column | None = None) -> DataFrame:
    """rows with their suffix's statistics: of the whole sample, or where a fold is given of all other folds."""
    added = {}
    for name, which, default in (("suffix_rate", 0, model.prior), ("suffix_weight", 1, 0.0)):
        value = _looked_up(F.col(OWN + "suffix"), model.suffixes, which, default)
        if fold is not None:
            for i, table in enumerate(model.apart):
                value = F.when(fold == i, _looked_up(F.col(OWN + "suffix"), table, which, default)).otherwise(value)
        added[OWN + name] = value
    return rows.withColumns(added)


def fold_of(url: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(folds)).cast("int")


def _statistics(sample: DataFrame, prior: float, most: int) -> tuple[dict[str, tuple[float, float]], list[dict[str, tuple[float, float]]]]:
    """Smoothed block rates and weights of the sample's commonest `most` suffixes, over all folds and without each of them."""
    by = [f(F.when(fold_of(F.col("url")) == i, x)).alias(f"{name}_{i}") for i in range(FOLDS) for name, f, x in (("n", F.count, F.lit(1)), ("bad", F.sum, F.col("label")))]
    rows = sample.groupBy(F.col(OWN + "suffix").alias("k")).agg(F.count("*").alias("n"), F.sum("label").alias("bad"), *by).orderBy(F.desc("n"), "k").limit(most).collect()
    entry = lambda bad, n: ((bad + 5 * prior) / (n + 5), float(n) ** 0.25)
    apart = [{r["k"]: entry(r["bad"] - (r[f"bad_{i}"] or 0.0), r["n"] - r[f"n_{i}"]) for r in rows} for i in range(FOLDS)]
    return {r["k"]: entry(r["bad"], r["n"]) for r in rows}, apart


def _featured(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=[OWN + x for x in features], outputCol=OWN + "features", handleInvalid="keep").transform(rows)


def train_url_model(labelled: DataFrame, rows: int = 20_000, trees: int = 10, depth: int = 4, statistics: int = 100, features: tuple[str, ...] = FEATURES) -> UrlModel:
    """Fits on at most `rows` distinct labelled URLs (url, label 1.0 for block), chosen by a hash of the URL; of a URL with
    both labels the mean counts. Rates are kept for the commonest `statistics` suffixes, others have the overall rate.
    Those bounds are the documented parameters; every URL is judged."""
    parts = labelled.select("url", F.col("label").cast("double").alias("label")).filter("url is not null and label is not null")
    distinct = parts.groupBy("url").agg(F.round(F.avg("label")).alias("label"))
    sample = distinct.orderBy(F.xxhash64("url"), "url").limit(rows)
    sample = lexical_features(with_parts(sample)).cache()
    total = sample.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    n, bad = total["n"], total["bad"] or 0.0
    model = UrlModel(None, 1.0 if n and bad == n else 0.0, features, {}, [], bad / n if n else 0.0)
    if 0 < bad < n:
        model.suffixes, model.apart = _statistics(sample, model.prior, statistics)
        ready = _featured(with_statistics(sample, model, fold_of(F.col("url"))), features)
        model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, featuresCol=OWN + "features", labelCol="label").fit(ready.select(OWN + "features", "label").coalesce(2))
    sample.unpersist()
    return model


def evaluate(labelled: DataFrame, **settings: object) -> dict[str, float]:
    """How well labels of URLs kept out of the fit (a fifth, by a hash) are told: area under the ROC curve with all features,
    and without those of suffixes; and how much each feature weighs in the trees."""
    out: dict[str, float] = {}
    aside = F.pmod(F.xxhash64("url", F.lit("aside")), F.lit(5)) == 0
    for name, features in (("auc", FEATURES), ("auc_without_suffixes", tuple(x for x in FEATURES if x not in SUFFIX_FEATURES))):
        model = train_url_model(labelled.filter(~aside), features=features, **settings)
        tested = judge(labelled.filter(aside).filter("label is not null").select("url", "label"), model, ())
        out[name] = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(tested)
        if features is FEATURES and model.trees is not None:
            out |= dict(zip(features, model.trees.featureImportances.toArray().tolist(), strict=True))
    return out


def with_parts(urls: DataFrame) -> DataFrame:
    return urls.withColumn(OWN + "host", host_of(F.col("url"))).withColumn(OWN + "path", path_of(F.col("url")))


def judge(urls: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """urls with host, path, rule, verdict and score (the trees' probability of block)."""
    parts = with_parts(urls.withColumn("url", F.col("url").cast("string")))
    parts = parts.withColumn(OWN + "fit", rule_for(F.col(OWN + "host"), F.col(OWN + "path"), rules))
    if model.trees is None:
        scored, score = parts, F.lit(model.only)
    else:
        ready = _featured(with_statistics(lexical_features(parts), model), model.features)
        trees = model.trees.copy().setFeaturesCol(OWN + "features").setProbabilityCol(OWN + "probability").setRawPredictionCol(OWN + "raw").setPredictionCol(OWN + "prediction")
        scored, score = trees.transform(ready), vector_to_array(OWN + "probability")[1]
    fit = F.col(OWN + "fit")
    verdict = F.coalesce(fit["verdict"], F.when(score >= 0.5, "block").otherwise("allow"))
    added = {"host": F.col(OWN + "host"), "path": F.col(OWN + "path"), "rule": fit["rule"], "verdict": verdict, "score": score}
    keep = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in added]
    return scored.select(*keep, *(x.alias(c) for c, x in added.items()))


def ruled_urls(urls: DataFrame) -> DataFrame:
    """url and label: 1.0 where a rule blocks it, 0.0 where one allows it, else null."""
    ruled = rule_for(host_of(F.col("url")), path_of(F.col("url")))
    return urls.select("url", F.when(ruled["verdict"] == "block", 1.0).when(ruled["verdict"] == "allow", 0.0).alias("label"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' own verdicts are the labels: the trees learn from every URL that a rule judges."""
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(urls, train_url_model(ruled_urls(urls))).select("page_id", "host", "path", "rule", "verdict", "score")
