"""Failure prediction: forest classifier, scores, risk, time to failure and advice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.functions.labels import severity


#: Ranges of the hash in which rows are counted before any are ranked.
HASH_RANGES = 4096


def stratified_split(df: DataFrame, label: str, order: Sequence[str], test_tenths: int = 2, seed: int = 42) -> DataFrame:
    """Add ``part``: the rounded fifth of each class tests, halves up; the rest trains.

    The test rows of a class are those with the least hashes. Rows are counted by ranges of the hash, whole ranges go to
    one part, and only the range in which the fifth ends is ranked, so no class meets in one task. Ties by hash go by all columns;
    what still ties is equal rows, of which it does not matter which. A null label is a class. Read the result from a
    written table where several passes must agree on such rows.
    """
    taken = {c.lower() for c in df.columns}
    h, at = (next(n for n in (stem, stem + "_", stem + "__") if n not in taken) for stem in ("_hash", "_range"))
    drawn = df.withColumn(h, F.xxhash64(*[F.col(f"`{c}`") for c in order], F.col(f"`{label}`"), F.lit(seed)))
    drawn = drawn.withColumn(at, F.pmod(F.col(h), F.lit(HASH_RANGES)).cast("int"))
    counts = drawn.groupBy(F.col(f"`{label}`").alias("b_label"), F.col(at).alias("b_range")).agg(F.count("*").alias("n"))
    # At most HASH_RANGES rows a class.
    per_class = Window.partitionBy("b_label")
    summed = counts.withColumn("past", F.sum("n").over(per_class.orderBy("b_range"))).withColumn("total", F.sum("n").over(per_class))
    wanted = F.floor((F.col("total") * test_tenths + 5) / 10)
    border = (
        summed.withColumn("wanted", wanted).where((F.col("past") - F.col("n") < F.col("wanted")) & (F.col("past") >= F.col("wanted")))
        .select("b_label", "b_range", (F.col("wanted") - (F.col("past") - F.col("n"))).alias("b_take"))
    )  # one row a class, none for a class whose fifth rounds to nothing
    placed = drawn.join(F.broadcast(border), F.col(f"`{label}`").eqNullSafe(F.col("b_label")), "left")
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != "part"]
    whole = placed.where(F.col("b_range").isNull() | (F.col(at) != F.col("b_range"))).select(
        *columns, F.when(F.col(at) < F.col("b_range"), "test").otherwise("train").alias("part")
    )
    ties = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    rank = F.row_number().over(Window.partitionBy("b_label", at).orderBy(h, ties))
    ranked = placed.where(F.col(at) == F.col("b_range")).withColumn("b_rank", rank).select(
        *columns, F.when(F.col("b_rank") <= F.col("b_take"), "test").otherwise("train").alias("part")
    )
    return whole.unionByName(ranked)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weights that make both classes count the same: the alternative to oversampling."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    one = F.lit(1).alias("_one")
    weights = counts.select("*", one).join(total.select("*", one), "_one").select(
        label, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("class_weight")
    )
    return df.join(F.broadcast(weights), label)  # two rows


def fit_classifier(
    train: DataFrame, features: Sequence[str], label: str, weight: str | None = None, trees: int = 100, depth: int = 10
) -> PipelineModel:
    """100 trees of depth 10 with two rows per leaf, on the library's distributed forest."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=42,
        **({"weightCol": weight} if weight else {}),
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, forest]).fit(train)


def feature_importances(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature and importance, highest first; as many rows as features."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    rows = [(name, value) for name, value in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def failure_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Probability, prediction, risk and hours to failure per row.

    A forest that has met no failure knows class 0 alone: its vectors end there, and the probability of a failure is 0.
    """
    failing = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    scored = model.transform(df).withColumn("failure_probability", failing)
    out = scored.withColumn("failure_prediction", F.col("prediction").cast("int"))
    return with_risk(out.drop("features", "rawPrediction", "probability", "prediction"))


def with_risk(df: DataFrame, probability: str = "failure_probability") -> DataFrame:
    p = F.col(probability)
    return df.withColumns(
        {
            "risk_level": severity(p),
            "time_to_failure_hours": F.greatest(F.lit(fixed.FAILURE_HORIZON_HOURS) * (1 - p), F.lit(1.0)),
        }
    )


def recommendations(scored: DataFrame, probability: str = "failure_probability") -> DataFrame:
    """Advice for rows of medium risk and above."""
    risk, p, hours = F.col("risk_level"), F.bround(F.col(probability) * 100, 1), F.bround("time_to_failure_hours", 1)

    def per_risk(make):
        return reduce(lambda acc, kv: acc.when(risk == kv[0], make(kv[1])), fixed.FAILURE_ADVICE.items(), F)

    def described(advice):
        wanted = [hours, p] if advice[1].count("%.1f") == 2 else [p]
        return F.format_string(advice[1], *wanted)

    return scored.where(risk.isin(*fixed.FAILURE_ADVICE)).withColumns(
        {
            "action": per_risk(lambda a: F.lit(a[0])),
            "description": per_risk(described),
            "suggested_actions": per_risk(lambda a: F.array(*[F.lit(x) for x in a[2]])),
        }
    )
