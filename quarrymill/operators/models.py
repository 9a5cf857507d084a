"""Models on tables: encoding, price regression, isolation forest, segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import boosting, forest
from quarrymill.operators.reports import quantiles
from quarrymill.operators.sampling import fixed_size, split
from quarrymill.sources import files

#: Columns that the models use. Fixed values.
CATEGORICAL = ("product_group", "category", "brand", "brand_solution", "sales_channel")
NUMERIC = ("weight_kg", "rating", "stock_qty", "units_sold_12m")
ANOMALY = ("price_zar", "cost_zar", "margin_pct", "weight_kg")
SEGMENT = ("price_zar", "margin_pct", "units_sold_12m", "rating")
ANOMALY_COLUMNS = ("product_id", "product_name", "category", "brand", *ANOMALY, "anomaly_raw")


def ordinal(train: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """Alphabetical codes from 0 for the values of each column, as <column>_code; unseen and null values come last."""
    indexer = StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_code" for c in columns], stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    return Pipeline(stages=[indexer]).fit(train)


def encoded(df: DataFrame, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Codes as integers, -1 for unseen and null values."""
    labels = model.stages[0].labelsArray
    out = model.transform(df)
    for c, known in zip(columns, labels, strict=True):
        code = F.col(f"{c}_code")
        out = out.withColumn(f"{c}_code", F.when(code < len(known), code.cast("int")).otherwise(-1))
    return out


def price_model(df: DataFrame, cap: int | None = None, settings: boosting.Settings = boosting.Settings()) -> tuple[DataFrame, DataFrame]:
    """Boosted trees for the price; (the model's nodes, predictions on the test fifth). cap bounds the rows used, None: all.

    Categories are numbered by their alphabet in the training rows; one that these don't have is -1, a null is missing like
    a missing number, and the trees learn which side missing values go to.
    """
    rows = df.dropna(subset=["price_zar", "weight_kg", "rating"]).select("product_id", "price_zar", *CATEGORICAL, *NUMERIC)
    if cap:
        rows = fixed_size(rows, "product_id", cap, settings.seed)
    path = files.scratch(df.sparkSession, "price_rows")
    files.write_parquet(rows, path)
    rows = files.scan_parquet(df.sparkSession, path)
    train, test = split(rows, "product_id", 0.2, settings.seed)
    codes = ordinal(train, CATEGORICAL)
    names = [f"{c}_code" for c in CATEGORICAL]

    def numbered(side: DataFrame) -> DataFrame:
        return encoded(side, codes, CATEGORICAL).withColumns({n: F.when(F.col(c).isNotNull(), F.col(n)) for n, c in zip(names, CATEGORICAL, strict=True)})

    features = [*names, *NUMERIC]
    nodes = boosting.fit(numbered(train), features, "price_zar", "product_id", settings)
    return nodes, boosting.predicted(numbered(test), nodes, features)


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: r2, mae, mean_label, n."""
    y, p = F.col(label), F.col(prediction)
    sums = df.agg(
        F.count(y).alias("n"), F.avg(y).alias("mean_label"), F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("variance"),
    )
    r2 = 1 - F.try_divide(F.col("sse"), F.col("variance") * F.col("n"))
    return sums.select(F.round(r2, 4).alias("r2"), F.round("mae", 2).alias("mae"), F.round("mean_label", 2).alias("mean_label"), "n")


# Isolation forest -----------------------------------------------------------------------------------------------------


def isolation_forest(df: DataFrame, features: Sequence[str], trees: int = 100, subsample: int = 256, seed: int = 42) -> DataFrame:
    """Adds score, lower for outliers, by a forest grown on the table itself; the forest's nodes are written once."""
    nodes = forest.forest(df, features, "product_id", trees, subsample, seed)
    path = files.scratch(df.sparkSession, "forest")
    files.write_parquet(nodes, path)
    return forest.scored(df, files.scan_parquet(df.sparkSession, path), features)


def flag_lowest(scored: DataFrame, score: str, share: float = 0.005) -> DataFrame:
    """Adds anomaly_raw (score less the threshold below which the share lies) and is_anomaly."""
    cut = quantiles(scored, score, share).select(F.col("quantile").alias("_cut"))
    out = scored.join(F.broadcast(cut), how="cross")  # one row
    return out.withColumn("anomaly_raw", F.col(score) - F.col("_cut")).withColumn("is_anomaly", F.col("anomaly_raw") < 0).drop("_cut")


def scores(df: DataFrame, **options) -> DataFrame:
    """product_id and score, written: the threshold's passes read the scores, and no row walks down the trees again."""
    return files.sized(isolation_forest(df, ANOMALY, **options).select("product_id", "score"), "scores")


def anomalies(df: DataFrame, most: int = 2000, cap: int | None = None, **options) -> DataFrame:
    """The lowest-scored rows among the flagged ones, by ids that name rows. cap bounds the rows scored, by the keys' hash; None: all."""
    if cap:
        df = fixed_size(df.dropna(subset=list(ANOMALY)), "product_id", cap)
    flagged = flag_lowest(scores(df, **options), "score").where("is_anomaly")
    lowest = files.sized(flagged.orderBy("anomaly_raw", "product_id").limit(most).select("product_id", "anomaly_raw"), "lowest")
    found = df.join(F.broadcast(lowest), "product_id")  # most rows at most
    return found.orderBy("anomaly_raw", "product_id").select(*ANOMALY_COLUMNS)


# Segments -------------------------------------------------------------------------------------------------------------


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds <column>_z: zero mean and unit population deviation; 0 for a constant column."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stats), how="cross")  # one row
    for c in columns:
        out = out.withColumn(f"{c}_z", F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


#: Points that starting centres are drawn from, at most; whole numbers in a unit of a standardised value; most passes.
STARTS, UNIT, PASSES = 4096, 1_000_000, 50


def starting_centres(points: np.ndarray, k: int, restarts: int, seed: int) -> np.ndarray:
    """(restarts, k, columns): k-means++ draws, each start with its own numbers."""
    out = np.empty((restarts, k, points.shape[1]))
    for r in range(restarts):
        generator = np.random.default_rng([seed, r])
        out[r, 0] = points[generator.integers(len(points))]
        away = ((points - out[r, 0]) ** 2).sum(1)
        for j in range(1, k):
            total = away.sum()
            at = generator.choice(len(points), p=away / total) if total > 0 else generator.integers(len(points))
            out[r, j] = points[at]
            away = np.minimum(away, ((points - out[r, j]) ** 2).sum(1))
    return out


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centre of each point, and its squared distance: columns are added in their order."""
    away = np.zeros((len(points), len(centres)))
    for c in range(points.shape[1]):
        away += (points[:, c, None] - centres[None, :, c]) ** 2
    at = away.argmin(1)
    return at, away[np.arange(len(points)), at]


def lloyd_pass(points: DataFrame, centres: np.ndarray, open_: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over the points for all open starts: sums and counts by start and centre, and each start's cost.

    Every task sums its own points as whole numbers, so that the result doesn't depend on their order: restarts * k short
    rows of each task are shuffled.
    """
    names, (_, k, width) = points.columns, centres.shape

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, costs = np.zeros((len(centres), k, width), np.int64), np.zeros((len(centres), k), np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy() for n in names])
            whole = np.rint(x * UNIT).astype(np.int64)
            for r in open_:
                at, away = nearest(x, centres[r])
                np.add.at(sums[r], at, whole)
                counts[r] += np.bincount(at, minlength=k)
                costs[r] += np.rint(away * UNIT).astype(np.int64).sum()
        rows = [(r, j, *sums[r, j], counts[r, j], costs[r] if not j else 0) for r in open_ for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=fields)

    fields = ["r", "j", *[f"s{c}" for c in range(width)], "n", "cost"]
    found = points.mapInArrow(sum_up, ", ".join(f"{f} long" for f in fields)).groupBy("r", "j").agg(*[F.sum(f).alias(f) for f in fields[2:]]).collect()
    sums, counts, costs = np.zeros(centres.shape), np.zeros(centres.shape[:2], np.int64), np.zeros(len(centres), np.int64)
    for row in found:
        sums[row.r, row.j], counts[row.r, row.j] = [row[f"s{c}"] / UNIT for c in range(width)], row.n
        costs[row.r] += row.cost
    return sums, counts, costs


def kmeans(df: DataFrame, columns: Sequence[str], k: int, restarts: int, key: str, seed: int) -> tuple[np.ndarray, float]:
    """(centres, cost) of the best of several starts. All starts advance in one pass over the points; those that rest, stop.

    Starts are drawn by k-means++ from a hash-picked sample of STARTS points at most. A centre without points stays.
    """
    picked = fixed_size(df.select(key, *columns), key, STARTS, seed).orderBy(key).select(*columns).toPandas().to_numpy(dtype=np.float64)
    if not len(picked):
        return np.zeros((k, len(columns))), 0.0
    centres = starting_centres(picked, k, restarts, seed)
    points, costs, open_ = df.select(*columns), np.zeros(restarts), list(range(restarts))
    for _ in range(PASSES):
        sums, counts, found = lloyd_pass(points, centres, open_)
        moved = []
        for r in open_:
            costs[r] = found[r] / UNIT
            new = np.where(counts[r][:, None] > 0, sums[r] / np.maximum(counts[r], 1)[:, None], centres[r])
            if np.abs(new - centres[r]).max() > 1e-4:
                moved.append(r)
                centres[r] = new
        open_ = moved
        if not open_:
            break
    best = int(costs.argmin())
    return centres[best], float(costs[best])


def assigned(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], name: str = "segment") -> DataFrame:
    """Adds the first nearest of given centres, as a column expression. Null where a column is null."""
    away = [F.struct(sum((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre, strict=True)).alias("away"), F.lit(j).alias("j")) for j, centre in enumerate(centres)]
    known = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        known &= F.col(c).isNotNull()
    return df.withColumn(name, F.when(known, F.array_min(F.array(*away))["j"]))


def segments(df: DataFrame, k: int = 4, restarts: int = 5, columns: Sequence[str] = SEGMENT, seed: int = 42, cap: int | None = None) -> DataFrame:
    """Adds segment: k-means on standardised columns, the best of several starts by cost; rows with nulls are left out.

    cap bounds the rows used, by the keys' hash; None: all.
    """
    rows = df.dropna(subset=list(columns))
    if cap:
        rows = fixed_size(rows, "product_id", cap, seed)
    names = [f"{c}_z" for c in columns]
    path = files.scratch(df.sparkSession, "points")
    files.write_parquet(standardised(rows, columns), path)
    points = files.scan_parquet(df.sparkSession, path)
    centres, _ = kmeans(points, names, k, restarts, "product_id", seed)
    return assigned(points, names, centres.tolist()).drop(*names)
