"""Model fitting on Spark ML: boosted trees with early stopping, refit, seeds, residual targets, controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored

CATEGORIES = ["line", "stop", "direction"]


def vocabulary(*frames: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """The categories of several datasets in one list: column_name, value."""
    out = None
    for df in frames:
        one = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out.filter("value is not null").distinct()


def shared_indices(*frames: DataFrame, categories: Sequence[str] = CATEGORIES) -> PipelineModel:
    """One indexer for each column: indices of the categories of all frames together, in order of their values; those of no frame get one index more.

    The distinct values are found by Spark; a model holds them whole, in the driver too."""
    labels: dict[str, list[str]] = {c: [] for c in categories}
    for r in vocabulary(*frames, columns=categories).collect():
        labels[r["column_name"]].append(r["value"])
    # One model for all columns would pad the shorter lists with nulls.
    make = lambda c: StringIndexerModel.from_labels(sorted(labels[c], key=lambda v: v.encode()), c, "_i_" + c, handleInvalid="keep")
    return PipelineModel([make(c) for c in categories])


def stages(numbers: Sequence[str], indices: PipelineModel) -> list:
    """Categories as the indexers have them; numbers with missing values filled by the median."""
    filled = ["_f_" + c for c in numbers]
    return [
        *indices.stages,
        Imputer(inputCols=list(numbers), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled + [i.getOutputCol() for i in indices.stages], outputCol="_features", handleInvalid="keep"),
    ]


#: Rows that one task holds for the trees.
PART_ROWS = 250_000
WEIGHT = "_weight"


def weighted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that are equal in these columns are one, with their number as weight."""
    return stored(df.groupBy(*columns).agg(F.count("*").cast("double").alias(WEIGHT)))


def fit_trees(train: DataFrame, valid: DataFrame | None, numbers: Sequence[str], label: str = "y", seed: int = 0, rounds: int = 20, depth: int = 4, least_bins: int = 64, categories: Sequence[str] = CATEGORIES, others: Sequence[DataFrame] = ()) -> PipelineModel:
    """Trees on the absolute error. With valid rows, fitting stops when they no longer gain; without, it runs `rounds`.
    Categories are those of train, valid and `others` (frames that are to be predicted).
    There are as many bins as the largest category has values, at least `least_bins`.
    Rows that are equal in all that the trees see are one with their number as weight, so the passes over the rows go
    through distinct ones only."""
    numbers = list(numbers)
    marked = train.withColumn("_valid", F.lit(False))
    if valid is not None:
        marked = marked.unionByName(valid.withColumn("_valid", F.lit(True)), allowMissingColumns=True)
    marked = marked.withColumns({c: F.col(c).cast("double") for c in [*numbers, label]})
    distinct = weighted(marked, list(dict.fromkeys([*numbers, *categories, label, "_valid"])))
    indices = shared_indices(distinct, *others, categories=categories)
    prepared = Pipeline(stages=stages(numbers, indices)).fit(marked)  # medians are those of all rows
    most = max((len(i.labels) for i in indices.stages), default=0) + 1  # and one for unknown values
    trees = GBTRegressor(
        featuresCol="_features", labelCol=label, predictionCol="_pred", lossType="absolute", weightCol=WEIGHT, maxIter=rounds, maxDepth=depth, maxBins=max(least_bins, most), seed=seed
    )
    if valid is not None:
        trees = trees.setValidationIndicatorCol("_valid")
    n = distinct.filter("not _valid").count()
    if n < trees.getMaxBins():  # there must be as many rows as bins, so each is cut into rows of equal weight
        cuts = 1 << (trees.getMaxBins() // max(n, 1)).bit_length()
        distinct = distinct.withColumn(WEIGHT, F.explode(F.array_repeat(F.col(WEIGHT) / cuts, cuts)))
    parts = max(train.sparkSession.sparkContext.defaultParallelism, n // PART_ROWS + 1)
    return PipelineModel([*prepared.stages, trees.fit(prepared.transform(distinct.repartition(parts)))])


def predict(model: PipelineModel, df: DataFrame, name: str = "pred", numbers: Sequence[str] = ()) -> DataFrame:
    rows = df.withColumns({c: F.col(c).cast("double") for c in numbers})
    out = model.transform(rows)
    return out.withColumn(name, F.col("_pred")).drop(*[c for c in out.columns if c.startswith(("_f_", "_i_"))], "_features", "_pred")


def rounds_used(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def fit_and_refit(train: DataFrame, valid: DataFrame, refit_rows: DataFrame, numbers: Sequence[str], least_rounds: int = 1, **options) -> PipelineModel:
    """Size found with early stopping on valid, then fitted anew on all rows with that size."""
    size = max(least_rounds, rounds_used(fit_trees(train, valid, numbers, **options)))
    return fit_trees(refit_rows, None, numbers, **options | {"rounds": size})


def importances(model: PipelineModel, spark: SparkSession, numbers: Sequence[str], categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """feature, importance: how much each column gains in the trees; one row per column."""
    found = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip([*numbers, *categories], found)), "feature string, importance double")


def seed_average(models: Sequence[PipelineModel], df: DataFrame, numbers: Sequence[str], name: str = "pred") -> DataFrame:
    """The mean prediction of models that differ by seed."""
    out, cols = df, []
    for i, m in enumerate(models):
        cols.append(f"_p{i}")
        out = predict(m, out, cols[-1], numbers)
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return out.withColumn(name, total / len(cols)).drop(*cols)


def residual(df: DataFrame, baseline: str = "baseline") -> DataFrame:
    """y minus the baseline as label; rows without a baseline have none and are left out."""
    return df.filter(F.col(baseline).isNotNull()).withColumn("residual", F.col("y") - F.col(baseline))
