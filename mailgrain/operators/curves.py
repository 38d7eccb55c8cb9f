"""Score curves: running class counts over ordered scores, and everything read off them.

A running sum over all distinct scores must not end in one task. `running_totals` range-partitions
the (already aggregated) scores, sums every partition, runs one window over those per-partition
totals (as many rows as there are partitions) and adds the offsets back inside the partitions.
Grid searches never build such a curve: they count mails per grid cell first, so their windows see
at most the number of grid points.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..session import durable
from .joins import cross_with_structs, one_row

F1_GRID = 981  # 0.010, 0.011, ... 0.990


def running_totals(df: DataFrame, keys, order: str, sums, descending: bool = True) -> DataFrame:
    """Add `<s>_run` (inclusive running sum in `order`) for every column in `sums`; `order` must be unique per key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()))
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy(direction("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    within = Window.partitionBy(*keys, "_part").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, [*keys, "_part"])
    return joined.select(*df.columns, *[(F.sum(s).over(within) + F.col(f"_o_{s}")).alias(f"{s}_run") for s in sums])


def score_curve(df: DataFrame, score: str = "score", label: str = "label", keys=()) -> DataFrame:
    """One row per distinct score: class counts (pos, neg), counts at or above it, class sizes (P, N)."""
    keys = list(keys)
    counted = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    run = running_totals(counted, keys, "score", ["pos", "neg"]).withColumnsRenamed({"pos_run": "tp", "neg_run": "fp"})
    sizes = df.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("P"), F.count_if(F.col(label) == 0).alias("N"))
    if keys:
        return run.join(sizes, keys)
    total = one_row(sizes)
    return run.withColumns({"P": total["P"], "N": total["N"]})


def curve_summary(curve: DataFrame, keys=(), fpr_limit: float = 0.01, prevalence: float | None = None) -> DataFrame:
    """ROC-AUC, average precision, best-F1 threshold and the cut for a false-alarm limit."""
    P, N, tp, fp = (F.col(c).cast("double") for c in ("P", "N", "tp", "fp"))
    both = (F.first("P") > 0) & (F.first("N") > 0)
    weight = F.lit(1.0) if prevalence is None else F.try_divide(F.lit((1 - prevalence) / prevalence) * P, N)
    f1 = 2 * tp / (tp + fp + P)
    allowed = F.floor(F.lit(fpr_limit) * N)
    # fp counts at or above the score: legitimate mails strictly below it are N - fp
    area = F.sum(F.col("pos") * (N - fp + F.col("neg") / 2.0))
    return curve.groupBy(*keys).agg(
        F.when(both, F.try_divide(area, F.first("P").cast("double") * F.first("N"))).alias("roc_auc"),
        F.when(both, F.sum(F.try_divide(F.col("pos"), P) * F.try_divide(tp, tp + weight * fp))).alias("pr_auc"),
        F.max_by("score", F.struct(F.round(f1, 12), -F.col("score"))).alias("best_f1_threshold"),
        F.max(f1).alias("best_f1"),
        F.max(F.when(F.col("fp") > allowed, F.col("score"))).alias("cut_above"),
    )


def percentiles(df: DataFrame, value: str, shares: dict, keys=()) -> DataFrame:
    """Interpolated percentiles `{name: share}` per key; nulls do not count, no value gives null.

    Equal values are counted first and ranks come from running totals, so no task holds all values of a key.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    run = running_totals(counted, keys, "_value", ["_n"], descending=False)
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = run.join(sizes, keys) if keys else run.withColumn("_all", one_row(sizes)["_all"])

    def at(rank):
        return F.max(F.when((F.col("_n_run") - F.col("_n") <= rank) & (rank < F.col("_n_run")), F.col("_value")))

    out = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * F.lit(float(share))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return ranked.groupBy(*keys).agg(*out)


# ---------------------------------------------------------------- F1 over the fixed threshold grid
def _grid_cell(score: Column) -> Column:
    """Index of the largest grid value not above the score (-1 below the grid)."""
    c = F.floor(score * 1000)
    fixed = F.when((c + 1) / F.lit(1000.0) <= score, c + 1).when(c / F.lit(1000.0) > score, c - 1).otherwise(c)
    return F.greatest(F.lit(-1), F.least(F.lit(F1_GRID - 1), fixed - 10)).cast("int")


def f1_grid_curve(df: DataFrame, score: str, label: str = "label", keys=("fold",)) -> DataFrame:
    """F1 at every grid threshold per key. The window input has at most 981 rows per key."""
    keys = list(keys)
    cells = df.groupBy(*keys, _grid_cell(F.col(score)).alias("cell")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    sizes = cells.groupBy(*keys).agg(F.sum("pos").alias("P"))
    grid = sizes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(F1_GRID - 1))))
    above = Window.partitionBy(*keys).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = grid.join(cells, [*keys, "cell"], "left").select(
        *keys, "cell", "P", F.sum(F.coalesce("pos", F.lit(0))).over(above).alias("tp"),
        F.sum(F.coalesce("neg", F.lit(0))).over(above).alias("fp"))
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    return run.select(*keys, "cell", ((F.col("cell") + 10) / F.lit(1000.0)).alias("threshold"), "tp", "fp",
                      (2 * tp / F.greatest(tp + fp + F.col("P"), F.lit(1.0))).alias("f1"))


def plateau_threshold(fold_curves: DataFrame, keys=(), rule: str = "plateau") -> DataFrame:
    """Threshold from fold F1 curves: the peak of the mean, or the middle of the run within one standard error."""
    keys = list(keys)
    mean = fold_curves.groupBy(*keys, "cell").agg(
        F.round(F.avg("f1"), 12).alias("mean"), F.stddev_samp("f1").alias("sd"), F.count("*").alias("folds"))
    per_key = Window.partitionBy(*keys)  # at most 981 rows per key
    peak = F.max_by(F.struct("cell", "mean", "sd", "folds"), F.struct("mean", -F.col("cell"))).over(per_key)
    marked = mean.withColumn("_peak", peak).withColumn(
        "_ok", F.col("mean") >= F.col("_peak.mean") - F.coalesce(F.col("_peak.sd"), F.lit(0.0)) / F.sqrt(F.col("_peak.folds")))
    ordered = per_key.orderBy("cell")
    island = F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("_island", island).where("_ok")
    own = runs.groupBy(*keys, "_island").agg(
        F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.first("_peak").alias("peak")).where(
        (F.col("lo") <= F.col("peak.cell")) & (F.col("hi") >= F.col("peak.cell")))
    value = lambda c: (c + 10) / F.lit(1000.0)
    middle = F.round((value(F.col("lo")) + value(F.col("hi"))) / 2, 4)
    return own.select(
        *keys, value(F.col("peak.cell")).alias("peak"), F.round(F.col("peak.mean"), 4).alias("peak_f1"),
        value(F.col("lo")).alias("plateau_lo"), value(F.col("hi")).alias("plateau_hi"),
        F.round(F.coalesce(F.col("peak.sd"), F.lit(0.0)) / F.sqrt(F.col("peak.folds")), 5).alias("f1_se"),
        (value(F.col("peak.cell")) if rule == "max" else middle).alias("threshold"))


def best_weight(curves: DataFrame) -> DataFrame:
    """The weight with the highest F1 of a table (weight, f1); of equal ones the last."""
    return curves.agg(F.max_by("weight", F.struct("f1", "weight")).alias("weight"), F.max("f1").alias("f1"))


# ---------------------------------------------------------------- minimum cost over the logit grid
def cost_grid() -> list[float]:
    edge = math.log(lx.COST_GRID_EDGE / (1 - lx.COST_GRID_EDGE))
    steps = lx.COST_GRID_STEPS - 1
    return [1 / (1 + math.exp(-(edge - 2 * edge * i / steps))) for i in range(lx.COST_GRID_STEPS)]


def min_cost_threshold(df: DataFrame, score: str, label: str, cells: list[dict], keys=()) -> DataFrame:
    """Cheapest threshold per (cost ratio, prevalence): the middle of the longest optimal run of the grid.

    Mails are counted per grid cell first; costs are computed on 2,001 rows per key and parameter pair.
    """
    keys = list(keys)
    grid = cost_grid()
    edge = math.log(lx.COST_GRID_EDGE / (1 - lx.COST_GRID_EDGE))
    step = -2 * edge / (len(grid) - 1)
    table = F.lit(grid)
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(score)))
    guess = F.greatest(F.lit(0), F.least(F.lit(len(grid) - 1), F.floor((F.ln(p / (1 - p)) - edge) / step))).cast("int")
    at = lambda i: F.get(table, i)
    # number of grid values not above the score: those thresholds flag the mail
    cell = (F.when((guess + 1 < len(grid)) & (at(guess + 1) <= F.col(score)), guess + 2)
            .when(at(guess) <= F.col(score), guess + 1).otherwise(guess))
    counted = df.groupBy(*keys, cell.alias("cell")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    sizes = counted.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    points = sizes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(grid)))))
    upto = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    run = points.join(counted, [*keys, "cell"], "left").select(
        *keys, "cell", "P", "N", F.sum(F.coalesce("pos", F.lit(0))).over(upto).alias("missed"),
        F.sum(F.coalesce("neg", F.lit(0))).over(upto).alias("passed")).where(F.col("cell") < len(grid))
    costed = cross_with_structs(run, cells)
    cost = (F.col("prevalence") * F.col("cost_ratio") * F.coalesce(F.try_divide("missed", "P"), F.lit(0.0))
            + (1 - F.col("prevalence")) * F.coalesce(1 - F.try_divide("passed", "N"), F.lit(0.0)))
    by = [*keys, "cost_ratio", "prevalence"]
    w = Window.partitionBy(*by)
    best = costed.withColumn("cost", cost).withColumn("_min", F.min("cost").over(w))
    best = best.withColumn("_ok", F.abs(F.col("cost") - F.col("_min")) <= 1e-15 + 1e-9 * F.abs(F.col("_min")))
    island = F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    runs = best.withColumn("_island", island).where("_ok").groupBy(*by, "_island").agg(
        F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.min("_min").alias("cost"))
    longest = runs.groupBy(*by).agg(F.max_by(F.struct("lo", "hi", "cost"), F.struct(F.col("hi") - F.col("lo"), -F.col("lo"))).alias("r"))
    return longest.select(*by, at(F.floor((F.col("r.lo") + F.col("r.hi")) / 2).cast("int")).alias("threshold"), F.col("r.cost").alias("cost"))
