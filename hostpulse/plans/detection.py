"""Train and run the anomaly detectors over a fleet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.operators import baseline, cleaning, ensemble, isolation, neighbours, windows
from hostpulse.operators.aggregates import to_long, to_wide
from hostpulse.session import materialised

HOST = ["host"]


@dataclass(frozen=True)
class Detector:
    """Fitted tables, all keyed by host; ``features`` fixes the columns and their order."""

    features: list[str]
    scaling: DataFrame
    forest: DataFrame
    lof: DataFrame
    offsets: DataFrame
    baseline: DataFrame


def training_frame(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """Prepared training rows; metrics a host had to drop are 0 for it."""
    prepared = cleaning.prepare_training(to_long(wide, features))
    return cleaning.aligned(to_wide(prepared, features), features)


def fit_detector(training: DataFrame, features: Sequence[str], contamination: float = 0.1) -> Detector:
    features = list(features)
    rows = materialised(training, "detector-training")
    scaling = materialised(cleaning.fit_scaling(rows, features, "standard"), "detector-scaling")
    even = materialised(cleaning.scaled(rows, features, scaling), "detector-scaled")
    forest = materialised(isolation.fit_forest(even, features), "forest")
    lof = materialised(neighbours.fit_lof(even, features), "lof")
    forest_scores = isolation.forest_scores(even, forest, features)
    each = neighbours.as_points(even.select("host", "clock", *features), features).join(
        lof.select("host", "point", (-F.col("lof")).alias("lof_score")), ["host", "point"]
    )
    offsets = isolation.score_offsets(forest_scores, "if_score", contamination).join(
        isolation.score_offsets(each, "lof_score", contamination), HOST
    )
    return Detector(
        features, scaling, forest, lof, materialised(offsets, "offsets"),
        materialised(baseline.fit_baseline(to_long(rows, features)), "detector-baseline"),
    )


def detector_flags(wide: DataFrame, model: Detector) -> DataFrame:
    """Per row: both scores, three flags, the vote, and the confidence."""
    rows = materialised(cleaning.aligned(wide, model.features), "scored-rows")
    even = cleaning.scaled(rows, model.features, model.scaling)
    scored = isolation.forest_scores(even, model.forest, model.features)
    scored = neighbours.lof_scores(scored, model.lof, model.features)
    marked = isolation.flagged(scored, model.offsets.select("host", "if_score_offset"), "if_score", "if_flag")
    marked = isolation.flagged(marked, model.offsets.select("host", "lof_score_offset"), "lof_score", "lof_flag")
    votes = baseline.statistical_vote(to_long(rows, model.features), model.baseline).select("host", "clock", "stat_flag")
    together = ensemble.voted(marked.drop(*model.features).join(votes, ["host", "clock"]).join(rows, ["host", "clock"]))
    return materialised(ensemble.with_confidence(together), "detections")


def detect(wide: DataFrame, model: Detector, severity: str | None = None) -> DataFrame:
    """Anomaly records with the metrics behind them, highest confidence first."""
    flags = detector_flags(wide, model)
    hits = flags.where(F.col("is_anomaly") == 1)
    causes = baseline.explained(to_long(hits.select("host", "clock", *model.features), model.features), model.baseline)
    return ensemble.of_severity(ensemble.anomaly_records(hits, causes), severity)


def evaluate(flags: DataFrame, label: str | None = None) -> DataFrame:
    out = ensemble.detection_metrics(flags).join(ensemble.agreement(flags), HOST)
    if label is not None:
        out = out.join(ensemble.supervised_metrics(flags, label, "is_anomaly"), HOST)
    return out


def contamination_scores(
    training: DataFrame, features: Sequence[str], grid: Sequence[float] = tuple(fixed.CONTAMINATION_GRID)
) -> DataFrame:
    """Mean held-out forest decision per key and contamination, over three time blocks.

    One forest per (host, block) is grown on the other two blocks; the contaminations
    differ only in the offset, so they share it.
    """
    folded = materialised(windows.fold_by_time(cleaning.aligned(training, features)), "folds")
    held = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    every = folded.select("*", held.alias("held_out"))
    rest = every.where(F.col("fold") != F.col("held_out")).drop("fold")
    out = every.where(F.col("fold") == F.col("held_out")).drop("fold")
    by = ["host", "held_out"]
    forest = materialised(isolation.fit_forest(rest, features, by), "fold-forests")
    offsets = isolation.score_offsets(isolation.forest_scores(rest, forest, features, by), "if_score", grid, by)
    decisions = isolation.forest_scores(out, forest, features, by).groupBy(*by).agg(F.avg("if_score").alias("_mean"))
    shares = F.array(*[F.lit(float(c)) for c in grid])
    per_fold = decisions.join(offsets, by).select(
        "host", "_mean", F.posexplode("if_score_offsets").alias("_i", "_offset")
    )
    return per_fold.groupBy("host", F.get(shares, F.col("_i")).alias("contamination")).agg(
        F.avg(F.coalesce(F.col("_mean") - F.col("_offset"), F.lit(0.0))).alias("mean_decision")
    )


def best_contamination(scores: DataFrame) -> DataFrame:
    """The contamination with the best mean decision per host; the smaller one on equal scores.

    A larger share raises the offset, so the smallest share tends to win.
    """
    order = F.struct("mean_decision", (-F.col("contamination")).alias("_small"))
    return scores.groupBy("host").agg(F.max_by("contamination", order).alias("contamination"))


def fallback_range(samples: DataFrame, as_of: int, hours: int = 24, minimum: int = fixed.MIN_DETECTOR_ROWS) -> DataFrame:
    """Per host the first of the ranges (h, 2h, 1 hour) that has enough distinct times, else NULL."""
    ranges = [hours, hours * 2, 1]
    moments = samples.where(F.col("clock") >= as_of - max(ranges) * 3600).groupBy("host", "clock").agg(F.lit(1).alias("_one"))
    counts = moments.groupBy("host").agg(
        *[F.count_if(F.col("clock") >= as_of - h * 3600).alias(f"rows_{i}") for i, h in enumerate(ranges)]
    )
    pick = F
    for i, h in enumerate(ranges):
        pick = pick.when(F.col(f"rows_{i}") >= minimum, h)
    return counts.select("host", pick.otherwise(None).alias("hours_back"))


def accuracy_flags(wide: DataFrame, features: Sequence[str], contamination: float = 0.1) -> DataFrame:
    """Forest outlier flag per row, for the quality score's accuracy."""
    rows = materialised(cleaning.aligned(wide, features), "quality-rows")
    scored = materialised(
        isolation.forest_scores(rows, isolation.fit_forest(rows, features), features), "quality-scores"
    )
    return isolation.flagged(scored, isolation.score_offsets(scored, "if_score", contamination), "if_score", "outlier")
