"""Classifiers over the feature matrix, exact AUC and permutation importance."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline.config import DEFAULTS
from weftline.operators.lineage import cut
from weftline.operators.pairstats import running_counts


BUCKETS = 4096


def auc(scored: DataFrame, score: str = "score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, positives, auc), exact: average ranks of ties; of no rows n is 0 and the rest null.

    Scores are first grouped by value and stored; ranks are sums over buckets of values, and within each.
    """
    s = F.col(score).cast("double")
    values = cut(scored.groupBy(*by, s.alias("v")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(label).cast("double")).alias("p")))
    finite = (F.abs("v") < float("inf")) & ~F.isnan("v")
    span = values.where(finite).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    part = F.try_divide(F.col("v") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    bucket = F.when(F.col("v") == float("-inf"), -1).when(finite, F.coalesce(F.floor(part * BUCKETS), F.lit(0))).when(F.col("v").isNotNull(), BUCKETS + 1).otherwise(-2)
    ranked = running_counts(values.crossJoin(span), bucket, by).withColumn("rank", F.col("below") + (F.col("c") + 1) / 2.0)
    t = ranked.groupBy(*by).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum("p").alias("pos"), F.sum(F.col("rank") * F.col("p")).alias("ranks"))
    value = F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos")))
    return t.select(*by, "n", F.col("pos").cast("long").alias("positives"), value.alias("auc"))


def accuracy(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return scored.agg(F.avg(((F.col(score) > 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def logistic(train: DataFrame, features: list[str], label: str, balanced: bool = False) -> PipelineModel | None:
    """Standardised logistic regression with the penalty of one unit over the whole training set; None of no rows."""
    n = train.count()
    if not n:
        return None
    columns = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    fit = LogisticRegression(labelCol=label, maxIter=1000, regParam=1.0 / n, standardization=False)
    if balanced:
        sizes = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
        weight = F.lit(0.0)
        for k, c in sizes.items():
            weight = F.when(F.col(label) == k, n / (len(sizes) * c)).otherwise(weight)
        train, fit = train.withColumn("__weight", weight), fit.setWeightCol("__weight")
    return Pipeline(stages=[*columns, fit]).fit(train)


def boosted(train: DataFrame, features: list[str], label: str, depth: int = 3, step: float = 0.05, rounds: int = 400, seed: int = DEFAULTS.seed) -> PipelineModel | None:
    """Boosted trees; None of no rows."""
    if train.isEmpty():
        return None
    trees = GBTClassifier(labelCol=label, featuresCol="features", maxDepth=depth, stepSize=step, maxIter=rounds, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(train)


def score(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """``df`` with ``score``, the probability of the label 1; without a model no row is scored."""
    if model is None:
        return df.where(F.lit(False)).withColumn("score", F.lit(None).cast("double"))
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.select(*df.columns, "score")


def permutation_importance(model: PipelineModel | None, df: DataFrame, features: list[str], label: str, repeats: int = 8, seed: int = DEFAULTS.seed, block_rows: int = 10_000) -> DataFrame:
    """(feature, importance): the mean loss of AUC when a feature's values are dealt anew.

    All repeats of a feature are one pass: rows fall into blocks at random, and within a block each takes
    the value of the next in an order by hash, so values are permuted without a global order.
    """
    blocks = max(1, -(-df.count() // block_rows))
    own = F.xxhash64(*df.columns)
    base = auc(score(model, df), label=label).select(F.col("auc").alias("__base"))
    lost = None
    for k, f in enumerate(features):
        dealt = df.withColumn("__repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        dealt = dealt.withColumn("__order", F.xxhash64(own, F.lit(seed + 1000 * k) + F.col("__repeat")))
        dealt = dealt.withColumn("__block", F.pmod(F.xxhash64("__order"), F.lit(blocks)))
        block = W.Window.partitionBy("__repeat", "__block")
        order = block.orderBy("__order", *df.columns)
        following = F.struct(F.lead(f).over(order).alias("x"), (F.row_number().over(order) < F.count(F.lit(1)).over(block)).alias("inside"))
        first = F.first(f).over(order)
        dealt = dealt.withColumns({"__next": following, "__first": first}).withColumn(f, F.when(F.col("__next.inside"), F.col("__next.x")).otherwise(F.col("__first")))
        each = auc(score(model, dealt.select(*df.columns, "__repeat")), label=label, by=("__repeat",))
        part = each.crossJoin(base).agg(F.avg(F.col("__base") - F.col("auc")).alias("importance")).select(F.lit(f).alias("feature"), "importance")
        lost = part if lost is None else lost.union(part)
    return lost.orderBy(F.desc("importance"), "feature")


def news_lift(train: DataFrame, test: DataFrame, base: list[str], news: list[str], label: str = "target_up", rounds: int = 400) -> DataFrame:
    """(auc_base, auc_news, lift) of boosted trees on the same rows, without and with the news columns; null where an AUC is."""
    got = [auc(score(boosted(train, f, label, rounds=rounds), test), label=label).first()["auc"] for f in (base, base + news)]
    lift = None if None in got else got[1] - got[0]
    return train.sparkSession.createDataFrame([(*got, lift)], "auc_base double, auc_news double, lift double")
