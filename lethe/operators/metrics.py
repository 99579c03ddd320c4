"""Evaluation aggregates.

Classification reports come from one ``groupBy(label, pred).count()`` (at most
K x K rows), so the per-class arithmetic runs on a table the size of the class
set.  ROC/PR areas reduce the scored rows to distinct scores first (partial
aggregation) and take running sums with the range-partitioned prefix operator,
never a single-partition window over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_sums


# A1 / A2 -------------------------------------------------------------------------
def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): balanced weights total / (n_classes * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()  # one row per class
    total = sum(r["n"] for r in rows)
    k = len(rows)
    return counts.withColumn("weight", F.lit(float(total)) / (F.lit(float(k)) * F.col("n")))


def row_weights(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """A2: per-row class weight (the class table is tiny: broadcast)."""
    return df.join(F.broadcast(weights.select(label, "weight")), label, "left")


# A16 ----------------------------------------------------------------------------
def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


# A15 ----------------------------------------------------------------------------
def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(cls, precision, recall, f1, support) plus rows 'accuracy', 'macro avg', 'weighted avg'.

    Undefined ratios are 0 (zero_division = 0).
    """
    role = lambda cls, **n: F.struct(cls.cast("string").alias("cls"), *[F.lit(n.get(k, 0)).alias(k) for k in ("sup", "np", "tp")])
    cm = confusion(df, label, pred)
    per = (cm.select("n", F.explode(F.array(role(F.col(label), sup=1), role(F.col(pred), np=1),
                                            role(F.when(F.col(label) == F.col(pred), F.col(label)), tp=1))).alias("r"))
           .where("r.cls is not null").groupBy("r.cls")
           .agg(*[F.sum(F.col("n") * F.col(f"r.{k}")).alias(k) for k in ("sup", "np", "tp")]))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumn("precision", ratio(F.col("tp"), F.col("np"))).withColumn("recall", ratio(F.col("tp"), F.col("sup")))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    # one row per class: the class table is the only thing that meets in one task
    parts = ("precision", "recall", "f1")
    row = lambda name, exprs, n: F.struct(F.lit(name).alias("cls"), *[e.alias(c) for c, e in zip(parts, exprs)], n.cast("bigint").alias("support"))
    n = F.sum("sup")
    whole = per.agg(F.collect_list(F.struct("cls", *parts, F.col("sup").cast("bigint").alias("support"))).alias("classes"),
                    row("accuracy", [F.sum("tp") / n] * 3, n).alias("accuracy"),
                    row("macro avg", [F.avg(c) for c in parts], n).alias("macro"),
                    row("weighted avg", [F.sum(F.col(c) * F.col("sup")) / n for c in parts], n).alias("weighted"))
    return whole.select(F.explode(F.concat("classes", F.array("accuracy", "macro", "weighted"))).alias("r")).select("r.*")


# W1 / W2 ------------------------------------------------------------------------
def score_counts(df: DataFrame, score: str = "p", label: str = "y", positive=1.0) -> DataFrame:
    """(score, pos, neg) per distinct score."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == F.lit(positive), 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(label) == F.lit(positive), 0).otherwise(1)).cast("bigint").alias("neg"))


def curve_points(df: DataFrame, score: str = "p", label: str = "y", positive=1.0) -> DataFrame:
    """Cumulative (tp, fp) at every distinct threshold, highest score first."""
    sc = score_counts(df, score, label, positive)
    return running_sums(sc, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})


def roc_pr_auc(df: DataFrame, score: str = "p", label: str = "y", positive=1.0) -> DataFrame:
    """One row (roc_auc, pr_auc) with trapezoid areas like scikit-learn's curves.

    ROC starts at (0, 0); the PR curve starts at (recall 0, precision 1) and is cut
    at the first threshold reaching full recall.  Each area term only needs the
    cumulative counts at its own threshold and the one before it, which is the
    cumulative value minus the counts at this score, so no lag is needed.
    """
    pts = curve_points(df, score, label, positive)
    # the last running sums are the totals, read from the checkpoint under the curve
    tot = pts.agg(F.max("tp").alias("P"), F.max("fp").alias("N")).collect()[0]
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    roc = ((fp - fp0) / F.lit(N if N else 1.0)) * ((tp + tp0) / F.lit(P if P else 1.0)) / 2.0
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    prec0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    pr = F.when(tp0 < F.lit(P), ((tp - tp0) / F.lit(P if P else 1.0)) * (prec + prec0) / 2.0).otherwise(0.0)
    return pts.agg(F.sum(roc).alias("roc_auc"), F.sum(pr).alias("pr_auc"))


# A21 ----------------------------------------------------------------------------
def majority_vote(preds: DataFrame, key: str = "row_id", pred: str = "pred", n_classes: int = 10) -> DataFrame:
    """(key, vote, probs): votes per (row, class) softmaxed; ties go to the lowest class.

    ``preds`` has one row per (row, model).  The count is a partial aggregate.
    """
    counts = preds.groupBy(key, pred).agg(F.count(F.lit(1)).alias("n"))
    per_row = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(pred, "n"))).alias("m"))
    per_row = per_row.select(key, F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                                              lambda c: F.coalesce(F.element_at(F.col("m"), c), F.lit(0)).cast("double")).alias("v"))
    # each stage is a column of its own: a lambda would evaluate it once per class
    per_row = per_row.withColumn("mx", F.array_max("v")).withColumn("ex", F.transform("v", lambda v: F.exp(v - F.col("mx"))))
    per_row = per_row.withColumn("tot", F.aggregate("ex", F.lit(0.0), lambda a, v: a + v))
    return per_row.select(key, (F.array_position("v", F.col("mx")) - 1).cast("int").alias("vote"),
                          F.transform("ex", lambda v: v / F.col("tot")).alias("probs"))


def binary_vote(preds: DataFrame, key: str = "row_id", pred: str = "pred") -> DataFrame:
    """+1 iff strictly more +1 than -1 votes (binary tie -> -1)."""
    return preds.groupBy(key).agg(
        F.when(F.sum(F.when(F.col(pred) > 0, 1).otherwise(-1)) > 0, 1.0).otherwise(-1.0).alias("vote"))


# W6 -----------------------------------------------------------------------------
def best_epoch(log: DataFrame, group: list[str], loss: str = "val_loss", epoch: str = "epoch") -> DataFrame:
    """First epoch with the minimum loss per group (min_by over (loss, epoch))."""
    return log.groupBy(*group).agg(F.min_by(F.col(epoch), F.struct(F.col(loss), F.col(epoch))).alias("best_epoch"),
                                   F.min(loss).alias("best_loss"))


# W7 -----------------------------------------------------------------------------
def early_stop(log: DataFrame, patience: int, group: str = "run", loss: str = "loss", epoch: str = "epoch") -> DataFrame:
    """(group, stop_epoch, least): the first epoch with ``patience`` epochs since the last new minimum,
    or the last epoch; ``least`` is the minimum up to there.  A log has one row an epoch."""
    w = Window.partitionBy(group).orderBy(epoch)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("least", F.min(loss).over(so_far)).withColumn("old", F.min(loss).over(before))
    rows = rows.withColumn("last_new", F.max(F.when(F.col("old").isNull() | (F.col(loss) < F.col("old")), F.col(epoch))).over(so_far))
    stop = F.coalesce(F.min(F.when(F.col(epoch) - F.col("last_new") >= patience, F.struct(epoch, "least"))), F.max(F.struct(epoch, "least")))
    return rows.groupBy(group).agg(stop.alias("s")).select(group, F.col(f"s.{epoch}").alias("stop_epoch"), "s.least")
