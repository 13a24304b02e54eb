"""Run grids and run parameters as tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.operators.diagnostics import ALPHAS

# Default settings by distribution model.
# model, rho, rho_list, df, sparsity share of p
DISTRIBUTION = [
    ("gaussian", 0.5, None, None, None),
    ("gmm", None, [0.3, 0.5, 0.7], None, None),
    ("mstudent", 0.5, None, 10, None),
    ("mixed_student", 0.5, None, 10, None),
    ("mixed", 0.5, None, None, None),
    ("sparse", None, None, None, 0.3),
]
# model, GAMMA, LAMBDA, DELTA
TRAINING = [
    ("gaussian", 1.0, 1.0, 1.0),
    ("gmm", 1.0, 1.0, 1.0),
    ("mstudent", 1.0, 0.01, 0.01),
    ("sparse", 1.0, 0.1, 1.0),
    ("mixed", 1.0, 0.00324, 0.01),
    ("mixed_student", 1.0, 0.01, 0.01),
]
# model, n, elasticnet_alpha
FDR_TEST = [
    ("gaussian", 150, 0.1),
    ("gmm", 150, 0.1),
    ("mstudent", 200, 0.0),
    ("sparse", 200, 0.0),
]


def distribution_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISTRIBUTION, "model STRING, rho DOUBLE, rho_list ARRAY<DOUBLE>, df INT, sparsity_share DOUBLE")


def training_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRAINING, "model STRING, gamma DOUBLE, lambda DOUBLE, delta DOUBLE")


def fdr_test_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FDR_TEST, "model STRING, test_n INT, elasticnet_alpha DOUBLE")


def _linspace(low, high, num):
    if num < 1:
        raise ValueError("num must be at least 1")
    step = 0.0 if num == 1 else (high - low) / (num - 1)
    last = num - 1
    return F.transform(F.sequence(F.lit(0), F.lit(last)),
                       lambda k: F.when((k == last) & F.lit(num > 1), F.lit(float(high))).otherwise(k * F.lit(step) + F.lit(float(low))))


def param_grid(spark: SparkSession, lambdas: tuple[float, float, int], deltas: tuple[float, float, int]) -> DataFrame:
    """All (lambda, delta) of two evenly spaced ranges, given as (first, last, number)."""
    one = spark.range(1)
    return one.select(F.posexplode(_linspace(*lambdas)).alias("li", "lambda")).select(
        "li", "lambda", F.posexplode(_linspace(*deltas)).alias("di", "delta")
    ).select((F.col("li") * deltas[2] + F.col("di")).alias("run_id"), "lambda", "delta")


def listed_pairs(spark: SparkSession, pairs: Sequence[tuple[float, float]]) -> DataFrame:
    """Named (lambda, delta) pairs instead of a product."""
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(pairs)], "run_id INT, lambda DOUBLE, delta DOUBLE")


def sweep_dimension(grid: DataFrame, p_list: Sequence[int]) -> DataFrame:
    """Repeat the grid for every number of features."""
    sizes = F.array(*[F.lit(int(p)) for p in p_list])
    return grid.select("*", F.posexplode(sizes).alias("_k", "p")).withColumn(
        "run_id", (F.col("run_id") * len(p_list) + F.col("_k")).cast("int")
    ).drop("_k")


def lookup_params(runs: DataFrame) -> DataFrame:
    """Defaults by model.  Unknown models fail, except that test settings may be absent."""
    spark = runs.sparkSession
    known = F.lit(True).alias("_known")
    joined = (
        runs.join(F.broadcast(distribution_defaults(spark)), "model", "left")
        .join(F.broadcast(training_defaults(spark).select("model", F.col("gamma"), F.col("lambda").alias("default_lambda"),
                                                          F.col("delta").alias("default_delta"), known)), "model", "left")
        .join(F.broadcast(fdr_test_defaults(spark)), "model", "left")
    )
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown model: "), F.col("model")))).otherwise(F.col("model"))
    return joined.withColumn("model", checked).drop("_known")


def override_params(runs: DataFrame) -> DataFrame:
    """Run-level lambda and delta over the defaults."""
    out = {}
    for name in ("lambda", "delta"):
        default = F.col(f"default_{name}")
        out[name] = F.coalesce(F.col(name), default) if name in runs.columns else default
    return runs.withColumns(out).drop("default_lambda", "default_delta")


def _short(c):
    """A number with at most four decimals and no trailing zeros."""
    return F.regexp_replace(F.bround(c, 4).cast("decimal(20,4)").cast("string"), r"(\.\d*?[1-9]|\.0)0*$", "$1")


def run_label(runs: DataFrame, with_p: bool = False, at: str | None = None) -> DataFrame:
    """``model_lambda_delta[_p_size][timestamp]``; ``at`` names a timestamp column."""
    parts = [F.col("model"), _short(F.col("lambda")), _short(F.col("delta"))]
    if with_p:
        parts += [F.lit("p"), F.col("p").cast("string")]
    label = F.concat_ws("_", *parts)
    if at:
        cents = F.lpad(F.floor(F.date_format(at, "SSSSSS").cast("int") / 10000).cast("string"), 2, "0")
        label = F.concat(label, F.lit("_"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-"), cents)
    return runs.withColumn("run_label", label)


def assemble_run_config(df: DataFrame, runs: DataFrame, target_corr: DataFrame, chunk_list: Sequence[int] = (),
                        cat_var_idx: Sequence[int] = (), batch_frac: float = 0.5, epochs: int = 50, epoch_length: int = 100,
                        lr: float = 0.01, mixed_data: bool | None = None, n: int | None = None) -> DataFrame:
    """One complete parameter record per run.

    The row count of the feature table (``n``, where an analysis has counted it) and
    the target correlations, in the order of the features that have one, enter every record as constants.
    """
    n = df.count() if n is None else n
    target = np.array([r["v"] for r in target_corr.select("i", "v").orderBy("i").collect()])
    mixed = bool(chunk_list) if mixed_data is None else mixed_data
    ints = lambda values: F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")
    return runs.withColumns({
        "p": F.lit(int(target.size)),
        "n": F.lit(n).cast("long"),
        "target_corr": F.array(*[F.lit(float(v)) for v in target]),
    }).withColumns({
        "epochs": F.lit(epochs),
        "epoch_length": F.lit(epoch_length),
        "family": F.lit("continuous"),
        "cat_var_idx": ints(cat_var_idx),
        "chunk_list": ints(chunk_list),
        "use_weighting": F.lit(False),
        "kappa": F.lit(1),
        "diff_decorr": F.lit(False),
        "mixed_data": F.lit(mixed),
        "test_size": F.lit(0),
        "batch_size": F.floor(F.lit(batch_frac) * F.col("n")).cast("long"),
        "lr": F.lit(float(lr)),
        "lr_milestones": F.array(F.lit(epochs)),
        "dim_h": F.col("p") * 10,
        "sparsity": F.floor(F.col("sparsity_share") * F.col("p")).cast("int"),
        "alphas": F.array(*[F.lit(a) for a in ALPHAS]),
    }).drop("sparsity_share")
