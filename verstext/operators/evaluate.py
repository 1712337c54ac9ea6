"""Scores of predicted labels and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verstext.functions.uniform import hash_uniform
from verstext.operators.match import SENT_PAIR
from verstext.operators.ordering import dense_position, rolling_mean

# The cutoffs that are tried, 0 to 0.6 in steps of 0.02.
CUTOFF_STEP, CUTOFF_COUNT = 0.02, 31


def _f1(p: Column, r: Column) -> Column:
    return F.try_divide(2 * p * r, p + r)


def cutoff_sweep(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of predicted arcs below each cutoff, and which cutoff has the best F1.

    ``predicted`` has a ``distance``. An arc counts from the first cutoff above its distance on,
    so arcs are counted once per first cutoff and the 31 totals are sums of those counts. Every
    cutoff has a row; one below which no arc lies has NULL precision and recall 0. Of equally
    good cutoffs the lowest is the best one.
    """
    arcs = predicted.select(*SENT_PAIR, "distance", F.lit(0).alias("t")).unionByName(
        truth.select(*SENT_PAIR, F.lit(None).cast("double").alias("distance"), F.lit(1).alias("t"))
    )
    both = arcs.groupBy(*SENT_PAIR).agg(F.min("distance").alias("d"), F.max("t").alias("t"))
    first = F.floor(F.round(F.col("d") / CUTOFF_STEP, 6)).cast("int") + 1
    counts = both.groupBy(first.alias("first")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("hits")
    )
    all_true = truth.select(*SENT_PAIR).distinct().agg(F.count(F.lit(1)).alias("_t")).scalar()
    steps = F.explode(F.sequence(F.least("first", F.lit(CUTOFF_COUNT)), F.lit(CUTOFF_COUNT)))
    sums = (
        counts.where("first IS NOT NULL").withColumn("k", steps).where(F.col("k") < CUTOFF_COUNT)
        .groupBy("k").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    )
    every = predicted.sparkSession.range(CUTOFF_COUNT).select(F.col("id").cast("int").alias("k"))
    totals = every.join(sums, "k", "left").na.fill(0, ["n", "hits"])
    p, r = F.try_divide(F.col("hits"), F.col("n")), F.try_divide(F.col("hits"), all_true)
    scored = totals.select(
        F.round(F.col("k") * CUTOFF_STEP, 2).alias("cutoff"), p.alias("precision"), r.alias("recall"),
        _f1(p, r).alias("f1"),
    )
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("f1"), "cutoff")) == 1  # of 31 rows
    return scored.withColumn("best", best & F.col("f1").isNotNull())


def confusion(df: DataFrame, truth: str, pred: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def class_f1(df: DataFrame, truth: str, pred: str, by: list[str] = []) -> DataFrame:
    """Precision, recall and F1 per class from one confusion table."""
    conf = confusion(df, truth, pred, by)
    sides = conf.select(
        *by, F.explode(F.array(
            F.struct(F.col("y").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said")),
            F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said")),
        )).alias("s"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
    )
    per = sides.groupBy(*by, "s.class").agg(
        F.sum("s.actual").alias("support"), F.sum("s.said").alias("predicted"),
        (F.sum("hit") / 2).cast("long").alias("hits"),
    )
    p = F.try_divide(F.col("hits"), F.col("predicted"))
    r = F.try_divide(F.col("hits"), F.col("support"))
    return per.select(
        *by, "class", "support", "predicted", "hits",
        F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"),
        F.coalesce(_f1(p, r), F.lit(0.0)).alias("f1"),
    )


def overall_f1(per_class: DataFrame, by: list[str] = []) -> DataFrame:
    """Macro, weighted and micro F1 of a table of classes."""
    return per_class.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("micro_f1"),
    )


def conditional_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Scores restricted to the rows whose target is 1, and to those whose target is 0."""
    kept = df.where(F.col(truth).isin(0, 1)).withColumn("target", F.col(truth))
    return overall_f1(class_f1(kept, truth, pred, ["target"]), ["target"])


def mse(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(pred) - F.col(truth), 2)).alias("mse"))


def baseline_scores(df: DataFrame, truth: str, key: str, n_classes: int) -> DataFrame:
    """Scores of always saying the most frequent class and of guessing evenly."""
    top = df.groupBy(truth).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max(F.struct(F.col("n"), (-F.col(truth)).alias("v")))["v"].alias("v")
    )
    rows = df.withColumn("majority", -top.select("v").scalar()).withColumn(
        "guess", F.floor(hash_uniform(key) * n_classes).cast("int")
    )
    out = None
    for name in ("majority", "guess"):
        scores = overall_f1(class_f1(rows, truth, name)).select(F.lit(name).alias("baseline"), "*")
        out = scores if out is None else out.unionByName(scores)
    return out


def worker_accuracy(tasks: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of the given answer/truth pairs that agree per task."""
    hits = sum((F.col(a).eqNullSafe(F.col(b)).cast("int") for a, b in pairs), F.lit(0))
    return tasks.withColumn("accuracy", hits / len(pairs))


def worker_means(scored: DataFrame, worker: str) -> DataFrame:
    return scored.groupBy(worker).agg(F.avg("accuracy").alias("mean_accuracy"), F.count(F.lit(1)).alias("tasks"))


def worker_trend(scored: DataFrame, worker: str, task: str, size: int = 10) -> DataFrame:
    """Mean accuracy of each worker's last ``size`` tasks, NULL for the first ones."""
    numbered = scored.join(dense_position(scored, [worker], task, "position"), [worker, task])
    return rolling_mean(numbered, [worker], "position", "accuracy", size, "rolling_accuracy")


def worker_effort(tasks: DataFrame, worker: str, seconds: str) -> DataFrame:
    return tasks.groupBy(worker).agg(F.count(F.lit(1)).alias("tasks"), F.sum(seconds).alias("total_seconds"))


def minutes_histogram(tasks: DataFrame, seconds: str) -> DataFrame:
    return tasks.groupBy(F.floor(F.col(seconds) / 60).alias("minutes")).agg(F.count(F.lit(1)).alias("n"))


def annotation_totals(payload: DataFrame) -> DataFrame:
    """Connections, nodes and possible connections of annotation payloads."""
    def side(v):
        return F.size(F.filter("nodes", lambda n: n["version"] == F.col("version_x") + v)).cast("long")

    return payload.agg(
        F.sum(F.size("arcs")).alias("connections"), F.sum(F.size("nodes")).alias("nodes"),
        F.sum(side(0) * side(1)).alias("possible_connections"),
    )


def bin_accuracy(df: DataFrame, truth: str, pred: str, by: str) -> DataFrame:
    """Accuracy and macro F1 per group."""
    acc = df.groupBy(by).agg(F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    f1 = overall_f1(class_f1(df, truth, pred, [by]), [by]).select(by, "macro_f1")
    return acc.join(f1, by)


LOG_LINE = r"^(\S+ \S+) \[(\w+)\] step=(\d+) (\{.*\})$"


def parse_logs(lines: DataFrame) -> DataFrame:
    """Time, level, step, metric and score of log lines; other lines are dropped."""
    rows = lines.where(F.col("value").rlike(LOG_LINE))
    body = F.from_json(F.regexp_extract("value", LOG_LINE, 4), "metric string, score double")
    return rows.select(
        F.regexp_extract("value", LOG_LINE, 2).alias("level"),
        F.regexp_extract("value", LOG_LINE, 3).cast("long").alias("step"), body.alias("_b"),
    ).select("level", "step", "_b.metric", "_b.score")


EVALUATION = "{'eval_loss"


def _json(literal) -> Column:
    """JSON text of a written-out dictionary of plain values."""
    quoted = F.regexp_replace(literal, "'", '"')
    for word, value in (("True", "true"), ("False", "false"), ("None|nan", "null")):
        quoted = F.regexp_replace(quoted, rf"(?<![\w\"])(?:{word})(?![\w\"])", value)
    return quoted


def parse_evaluations(lines: DataFrame) -> DataFrame:
    """``scores``, a map of metric to value, of every log line that holds evaluation results."""
    found = lines.where(F.col("value").contains(EVALUATION))
    body = F.expr(f"""substring(value, instr(value, "{EVALUATION}"))""")
    return found.select(F.from_json(_json(body), "map<string, double>").alias("scores"))


def parse_parameters(logs: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """``params``, a map of name to value, of the block of parameters in each whole log; NULL without one."""
    block = F.regexp_extract(text, r"(?s)MODEL PARAMS:[^\n]*\n(\{.*?\n\})", 1)
    return logs.select(*keys, F.when(block != "", F.from_json(block, "map<string, string>")).alias("params"))


def parse_predictions(lines: DataFrame) -> DataFrame:
    """``pred``, ``doc_id`` and ``y_true`` of lines such as ``[1] (12, 3) {label:0}``; other lines are dropped."""
    parts = [F.regexp_extract("value", r"^\[(-?\d+)\].*?\((.*)\).*?:(\d+)\}", k) for k in (1, 2, 3)]
    rows = lines.select(parts[0].alias("pred"), parts[1].alias("doc_id"), parts[2].alias("y_true")).where("pred <> ''")
    return rows.select(F.col("pred").cast("int").alias("pred"), "doc_id", F.col("y_true").cast("int").alias("y_true"))


def results_pivot(scores: DataFrame, trial: str, metric: str, score: str, metrics: list[str]) -> DataFrame:
    """One row per trial with a column per metric."""
    return scores.groupBy(trial).pivot(metric, metrics).agg(F.max(score))


def best_results(scores: DataFrame, trial: str, metric: str, score: str) -> DataFrame:
    """Best value and trial of every metric."""
    return scores.groupBy(metric).agg(
        F.max(score).alias("best"), F.min_by(trial, F.struct(-F.col(score), F.col(trial))).alias("trial")
    )


def distance_histogram(distances: DataFrame, column: str, bins_per_unit: int) -> DataFrame:
    return distances.groupBy(F.floor(F.col(column) * bins_per_unit).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
