"""Classification, attack and detection metrics over prediction and flag tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.functions.numeric import int_div, lit, r4, ratio, round_to

KEY = ("run", "round")
COUNTS = ["tp", "tn", "fp", "fn"]
SCORES = [
    "clean_accuracy", "precision", "recall", "specificity", "fpr", "fnr", "f1", "mcc",
    "balanced_accuracy",
]


def confusion(preds: DataFrame, by: Sequence[str] = KEY, positive: int = 1) -> DataFrame:
    """True and false positives and negatives per group: four conditional counts, one pass."""
    truth = F.col("y_true").cast("int") == positive
    guess = F.col("y_pred").cast("int") == positive
    return preds.groupBy(*by).agg(
        F.count_if(guess & truth).alias("tp"),
        F.count_if(~guess & ~truth).alias("tn"),
        F.count_if(guess & ~truth).alias("fp"),
        F.count_if(~guess & truth).alias("fn"),
    )


def classification(counts: DataFrame) -> DataFrame:
    """Nine scores from confusion counts, 0 on empty denominators, rounded at the end."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in COUNTS)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    specificity = ratio(tn, tn + fp)
    scale = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    scores = {
        "clean_accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
        "f1": ratio(2 * precision * recall, precision + recall),
        "mcc": F.when(scale > C.METRIC_EPS, (tp * tn - fp * fn) / scale).otherwise(lit(0)),
        "balanced_accuracy": (recall + specificity) / 2,
    }
    return counts.select("*", *[r4(score).alias(name) for name, score in scores.items()])


def attack_success(
    triggered: DataFrame, by: Sequence[str] = (*KEY, "trigger"), target: int = C.TARGET_LABEL
) -> DataFrame:
    """Share of triggered positives that are given the target label."""
    hit = (F.col("pred").cast("int") == target).cast("int")
    return triggered.groupBy(*by).agg(r4(F.coalesce(F.avg(hit), lit(0))).alias("asr"))


def net_asr(asr: Column, floor: Column) -> Column:
    """Success rate beyond that of a clean model on the same inputs."""
    return r4(F.greatest(lit(0), asr - floor))


def ca_drop(baseline: Column, accuracy: Column) -> Column:
    return r4(baseline - accuracy)


def delta_asr(undefended: Column, defended: Column) -> Column:
    return r4(undefended - defended)


def ca_recovery(baseline: Column, attacked: Column, defended: Column) -> Column:
    """Share of the lost accuracy regained; null when nothing was lost."""
    lost = baseline - attacked
    return F.when(F.abs(lost) >= C.RECOVERY_EPS, r4((defended - attacked) / lost))


def stable_flags(flags: DataFrame) -> DataFrame:
    """Clients flagged in at least max(1, rounds // 2) rounds of their run.

    ``flags`` is ``(run, round, client_id, flagged)`` with a row per client and round.
    """
    rounds = flags.groupBy("run").agg(F.count_distinct("round").alias("_rounds"))
    counts = flags.groupBy("run", "client_id").agg(F.count_if("flagged").alias("flagged_rounds"))
    needed = F.greatest(F.lit(1), F.floor(F.col("_rounds") / 2))
    return counts.join(rounds, "run").filter(F.col("flagged_rounds") >= needed).drop("_rounds")


def detection(flagged: DataFrame, clients: DataFrame) -> DataFrame:
    """How well flags name the malicious clients, per run.

    ``flagged`` lists ``(run, client_id)``, repeats allowed; ``clients`` lists every
    ``(run, client_id, is_malicious)``.
    """
    marks = flagged.select("run", "client_id").distinct().withColumn("_hit", F.lit(True))
    joined = clients.join(marks, ["run", "client_id"], "left")
    hit, bad = F.coalesce("_hit", F.lit(False)), F.col("is_malicious")
    tp, fp, fn = F.count_if(hit & bad), F.count_if(hit & ~bad), F.count_if(~hit & bad)
    return joined.groupBy("run").agg(
        r4(ratio(tp, tp + fn)).alias("detection_rate"),
        r4(ratio(fp, F.count_if(~bad))).alias("false_exclusion_rate"),
        r4(ratio(tp, tp + fp)).alias("detection_precision"),
        tp.alias("detected_malicious"),
        fn.alias("missed_malicious"),
        fp.alias("wrongly_excluded"),
    )


def evaluation_rows(
    preds: DataFrame, triggered: DataFrame, keys: Sequence[str] = KEY, triggers: Sequence[str] = C.ATTACKS
) -> DataFrame:
    """One history row per run and round: scores and the success rate of every trigger."""
    keys = list(keys)
    rates = attack_success(triggered, [*keys, "trigger"])
    wide = rates.groupBy(*keys).agg(
        *[F.max(F.when(F.col("trigger") == t, F.col("asr"))).alias(f"asr_{t}") for t in triggers]
    )
    scored = classification(confusion(preds, keys))
    joined = scored.join(wide, keys, "left")
    return joined.fillna(0.0, subset=[f"asr_{t}" for t in triggers])


def round_seconds(times: DataFrame, slices: int = 4096) -> DataFrame:
    """Seconds since the previous evaluation of the run ended, and seconds of evaluation.

    ``times`` has ``(run, round, start_us, end_us)``.  The time range is cut into equal
    slices, so a run with most of the rows is spread over tasks: within a slice the
    previous row is a window away, and the first row of a slice takes the last end of
    the run's previous slice (at most ``slices`` rows per run).
    """
    span = times.agg(F.min("start_us").alias("low"), F.max("start_us").alias("high"))
    width = span.select(F.greatest(F.lit(1), int_div(F.col("high") - F.col("low"), slices) + 1)).scalar()
    cut = times.withColumn("_slice", F.call_function("div", F.col("start_us"), width))
    ends = cut.groupBy("run", "_slice").agg(F.max_by("end_us", F.struct("start_us", "round")).alias("_end"))
    earlier = ends.select(
        "run", "_slice", F.lag("_end").over(Window.partitionBy("run").orderBy("_slice")).alias("_before")
    )
    order = Window.partitionBy("run", "_slice").orderBy("start_us", "round")
    placed = cut.withColumn("_lag", F.lag("end_us").over(order)).join(earlier, ["run", "_slice"])
    since = F.col("start_us") - F.coalesce("_lag", "_before")
    return placed.select(
        "run", "round",
        round_to(since / 1e6, 2).alias("round_seconds"),
        round_to((F.col("end_us") - F.col("start_us")) / 1e6, 2).alias("eval_seconds"),
    )
