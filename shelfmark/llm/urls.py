"""URL filters: rules on host and path, and a logistic regression where no rule fits."""

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = 1 << 12    # buckets for the n-grams of the host, and as many for those of the path
SIZES = (2, 3)        # characters in an n-gram
SAMPLE = 8_000        # labelled addresses the model is fitted on, the first in the order of a hash


class Rule(NamedTuple):
    verdict: str      # allow or block
    host: str         # fits this host and all its subdomains
    path: str         # fits paths that start with it

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From behind the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"\A[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"\A[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def _first_fit(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """`value` of the longest rule that fits; of rules of one length, a blocking one first, then as listed."""
    ordered = sorted(rules, key=lambda r: (-len(str(r)), r.verdict != "block"))
    return F.coalesce(*[F.when(_fits(r, host, path), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))


def with_parts(urls: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """`urls` with _host, _path, and _rule and _ruling of the longest rule that fits, null where none does."""
    parts = urls.withColumn("_host", host_of(F.col(url))).withColumn("_path", path_of(F.col(url)))
    host, path = F.col("_host"), F.col("_path")
    return parts.withColumn("_rule", _first_fit(rules, host, path, str)) \
        .withColumn("_ruling", _first_fit(rules, host, path, lambda r: r.verdict))


def _features() -> list:
    """Hashed character n-grams of host and path, each in buckets of its own."""
    stages, vectors = [], []
    for part in ("host", "path"):
        for n in SIZES:
            grams, vector = f"_{part}_grams_{n}", f"_{part}_vector_{n}"
            stages += [NGram(n=n, inputCol=f"_{part}_letters", outputCol=grams),
                       HashingTF(numFeatures=FEATURES, binary=True, inputCol=grams, outputCol=vector)]
            vectors.append(vector)
    return [*stages, VectorAssembler(inputCols=vectors, outputCol="_features")]


def _lettered(parts: DataFrame) -> DataFrame:
    def letters(part):
        return F.split(F.concat(F.lit("^"), F.substr(part, F.lit(1)), F.lit("$")), "")
    return parts.withColumn("_host_letters", letters(F.col("_host"))).withColumn("_path_letters", letters(F.col("_path")))


def fit(labelled: DataFrame, url: str = "url", label: str = "label") -> PipelineModel | str:
    """A model of P(allow) from (url, label) rows, label `allow` or `block`; others are left out.

    At most SAMPLE different rows are learnt from; a row that repeats counts once. Their order is that of a hash and they are one partition, so that a repeated
    fit gives the same model. With labels of one kind that verdict is the model, without any `allow`.
    """
    rows = labelled.where(F.col(label).isin("allow", "block")).select(F.col(url).alias("url"), F.col(label).alias("label")).distinct()
    sample = rows.orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLE)
    kinds = [r.label for r in sample.select("label").distinct().orderBy("label").collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else "allow"
    ready = _lettered(with_parts(sample.coalesce(1), [])).withColumn("_label", F.col("label").eqNullSafe("allow").cast("double"))
    regression = LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_prediction", probabilityCol="_probability",
                                    rawPredictionCol="_raw", regParam=0.001, maxIter=30, aggregationDepth=2)
    return Pipeline(stages=[*_features(), regression]).fit(ready)


def judge(urls: DataFrame, rules: list[Rule], model: PipelineModel | str, url: str = "url") -> DataFrame:
    """`urls` with _host, _path, _rule and _verdict, allow or block: the longest rule's, else the model's.

    A null address, or one without `://`, has an empty host and path, which no rule with a host fits, and is judged by
    the model. All rows and columns stay; names that begin with an underscore are this operator's. Repeated rows are
    judged alike, an empty table gives no rows. Each row is judged on its own, nothing is shuffled.
    """
    parts = with_parts(urls, rules, url)
    if isinstance(model, str):
        learnt = parts.withColumn("_learnt", F.lit(model))
    else:
        judged = model.transform(_lettered(parts))
        learnt = judged.withColumn("_learnt", F.when(F.col("_prediction") == 1.0, "allow").otherwise("block"))
    return learnt.withColumn("_verdict", F.coalesce("_ruling", "_learnt")) \
        .select(*[F.col(f"`{c}`") for c in urls.columns], "_host", "_path", "_rule", "_verdict")
