"""Models over the training frame: one-event backtest, scenarios, boosted trees."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.fixed_values import SCENARIO_FEATURES, SECTOR_FEATURES
from eventide.functions.linear import dot, solve
from eventide.session import stage_table


def recency_weights(train: DataFrame, low: float = 0.5, high: float = 2.0, day: str = "day") -> DataFrame:
    """Weights that grow in a straight line over the training span."""
    first = train.agg(F.min(F.unix_date(day))).scalar()
    last = train.agg(F.max(F.unix_date(day))).scalar()
    position = F.coalesce(F.try_divide((F.unix_date(day) - first).cast("double"), (last - first).cast("double")), F.lit(0.0))
    return train.withColumn("w", low + (high - low) * position)


def fit_lines(train: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Weighted least-squares line per group, as one aggregate."""
    w, cx, cy = F.col("w"), F.col(x).cast("double"), F.col(y)
    sums = train.groupBy(*by).agg(
        F.sum(w).alias("sw"), F.sum(w * cx).alias("swx"), F.sum(w * cy).alias("swy"),
        F.sum(w * cx * cx).alias("swxx"), F.sum(w * cx * cy).alias("swxy"), F.min(cx).alias("x_low"), F.max(cx).alias("x_high"), F.count(F.lit(1)).alias("train_rows"),
    )
    sw, swx, swy = F.col("sw"), F.col("swx"), F.col("swy")
    has_range = F.col("x_low") < F.col("x_high")
    slope = F.when(has_range, (sw * F.col("swxy") - swx * swy) / (sw * F.col("swxx") - swx * swx)).otherwise(0.0)
    return sums.withColumn("slope", slope).select(
        *by, "slope", ((F.col("swy") - F.col("slope") * F.col("swx")) / F.col("sw")).alias("level"), "train_rows"
    )


def last_event_day(frame: DataFrame) -> Column:
    """Day of the last event, as a scalar; ``frame`` still holds the rows that a trim takes."""
    return frame.where(F.col("is_event_day") == 1).agg(F.max("day")).scalar()


def with_lines(rows: DataFrame, lines: DataFrame, pooled: DataFrame, by: str = "category") -> DataFrame:
    """Rows with the line of their class, or the pooled line, a single row, where the class has none.

    There is one line per class at most, so the join is broadcast by its size.
    """
    names = ["slope", "level", "train_rows"]
    one = pooled.select(F.struct(*names)).scalar()
    joined = rows.join(lines, by, "left")
    own = F.col("train_rows").isNotNull()
    return joined.withColumns({c: F.when(own, F.col(c)).otherwise(one[c]) for c in names})


def backtest_rows(
    frame: DataFrame, last: Column, x: str = "honing_mat_demand", y: str = "excess_return", by: str = "category"
) -> DataFrame:
    """Forecasts for the last event day by lines fitted on the days before it.

    A class without rows before that day is scored by the line of all classes.
    """
    train = recency_weights(frame.where(F.col("day") < last))
    test = frame.where(F.col("day") == last)
    return (
        with_lines(test, fit_lines(train, [by], x, y), fit_lines(train, [], x, y), by)
        .withColumn("predicted_excess", F.col("level") + F.col("slope") * F.col(x))
        .withColumn("error", F.col("predicted_excess") - F.col(y))
        .select("item", "day", by, "predicted_excess", y, "error", "train_rows")
    )


def ridge_line(train: DataFrame, features: list[str], y: str, ridge: float = 1e-3) -> DataFrame:
    """Weighted least-squares line over many features, as one row: level, means and slopes.

    Rows with equal features are summed first. Features of a day and a class leave days x classes
    rows, whatever the number of bars, and the cross products are taken of those. The ridge on the
    slopes solves indicators that add up to one.
    """
    w, n = F.col("w"), len(features)
    cells = scenario_vectors(train, features).select("f", "w", F.col(y).alias("y")).groupBy("f").agg(
        F.sum("w").alias("w"), F.sum(w * F.col("y")).alias("wy"), F.count(F.lit(1)).alias("n")
    )
    pairs = F.array(*[w * F.get("f", F.lit(i)) * F.get("f", F.lit(j)) for i in range(n) for j in range(n)])
    terms = F.concat(F.array(w, "wy"), F.transform("f", lambda v: w * v), F.transform("f", lambda v: F.col("wy") * v), pairs)
    sums = cells.select("n", F.posexplode(terms).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    packed = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]).alias("s"), F.max("n").alias("train_rows"))
    total, label = F.get("s", F.lit(0)), F.get("s", F.lit(1))

    def cut(start: int, size: int) -> Column:
        return F.transform(F.slice("s", start + 1, size), lambda v: v / total)

    means, with_y, level = cut(2, n), cut(2 + n, n), label / total
    packed = packed.select("train_rows", level.alias("level"), means.alias("means"), with_y.alias("with_y"), cut(2 + 2 * n, n * n).alias("pairs"))
    rhs = F.zip_with("with_y", "means", lambda v, m: v - m * F.col("level"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda j: F.get("pairs", i * n + j) - F.get("means", i) * F.get("means", j) + F.when(i == j, ridge).otherwise(0.0),
    ))
    return packed.where("level is not null").select("train_rows", "level", "means", solve(rows, rhs).alias("slopes"))


def backtest_features(frame: DataFrame, last: Column, features: list[str], y: str = "excess_return") -> DataFrame:
    """Forecasts for the last event day by one line over all features, fitted on the days before it.

    A class without earlier rows has slope 0 for its indicator: it is scored by what all classes share.
    """
    train = recency_weights(frame.where(F.col("day") < last))
    model = stage_table(ridge_line(train, features, y), "ridge_line")
    test = scenario_vectors(frame.where(F.col("day") == last), features)
    scored = ridge_scores(test, model).withColumnRenamed("predicted_excess_return", "predicted_excess")
    scored = scored.withColumn("error", F.col("predicted_excess") - F.col(y))
    return scored.select("item", "day", "category", "predicted_excess", y, "error")


def top_movers(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k items with the highest forecast, and the k with the highest outcome."""

    def top(kind: str, column: str) -> DataFrame:
        best = rows.orderBy(F.desc(column), "item").limit(k)
        place = F.row_number().over(Window.orderBy(F.desc(column), "item"))
        return best.select(
            F.lit(kind).alias("kind"), place.alias("place"), "item", "predicted_excess", "excess_return", "error"
        )

    return top("predicted", "predicted_excess").unionByName(top("actual", "excess_return"))


def class_grid(scenarios: DataFrame, classes: list[str], by: str = "category") -> DataFrame:
    """Each scenario once per item class, with the class indicators.

    Forecasts depend on the scenario and on the item's class only, so there is
    no grid of scenarios and items.
    """
    grid = scenarios.withColumn(by, F.explode(F.lit(classes)))
    return grid.withColumns({f"is_{c}": (F.col(by) == c).cast("int") for c in classes})


def rank_items(scored: DataFrame, items: DataFrame, scenario_id: str, by: str = "category", top: int = 10) -> DataFrame:
    """The best ``top`` items of each scenario by predicted excess return.

    ``scored`` has one forecast per scenario and class. Items of a class tie,
    so its first ``top`` names stand for it, and each scenario ranks at most
    classes x top rows.
    """
    in_class = Window.partitionBy(by).orderBy("item")
    shortlist = items.withColumn("place", F.row_number().over(in_class)).where(F.col("place") <= top).drop("place")
    names = shortlist.groupBy(by).agg(F.sort_array(F.collect_list("item")).alias("names"))
    best = Window.partitionBy(scenario_id).orderBy(F.desc("predicted_excess_return"), "item")
    return (
        scored.join(names, by)
        .select(scenario_id, F.explode("names").alias("item"), by, "predicted_excess_return")
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= top)
        .withColumn("score", F.col("predicted_excess_return") * 100.0)
    )


def scenario_vectors(grid: DataFrame, features: list[str] = SCENARIO_FEATURES) -> DataFrame:
    """Scenarios and classes with all features in fixed order in ``f``; one that the grid lacks, or a null, counts as 0."""
    held = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) if f in grid.columns else F.lit(0.0) for f in features]
    return grid.withColumn("f", F.array(*held))


def ridge_scores(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """Forecast of each scenario and class by the line over all features; null if ``model`` has no row."""
    line = model.select(F.struct("level", "slopes", "means")).scalar()
    pred = F.col("line.level") + dot(F.col("line.slopes"), F.zip_with("f", "line.means", lambda x, m: x - m))
    return vectors.withColumn("line", line).withColumn("predicted_excess_return", pred).drop("line")


def line_scores(grid: DataFrame, lines: DataFrame, pooled: DataFrame, x: str = "honing_mat_demand", by: str = "category") -> DataFrame:
    """Forecast of each scenario and class from the class's fitted line, or the pooled one if it has none."""
    return with_lines(grid, lines, pooled, by).withColumn("predicted_excess_return", F.col("level") + F.col("slope") * F.col(x))


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    """The features as numbers under names of their own; a missing value counts as 0."""
    return rows.withColumns({f"filled_{f}": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})


def boosted_model(
    rows: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 100, depth: int = 5,
    rate: float = 0.05, seed: int = 7,
):
    """Gradient-boosted trees over named features, trained by Spark ML on all rows.

    A missing feature counts as 0, in training and in scoring, so no row is left out.
    """
    booster = GBTRegressor(
        featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed
    )
    if weight is not None:
        booster = booster.setWeightCol(weight)
    assembler = VectorAssembler(inputCols=[f"filled_{f}" for f in features], outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, booster]).fit(_filled(rows, features))


def boosted_scores(model, rows: DataFrame, keep: list[str]) -> DataFrame:
    features = [c.removeprefix("filled_") for c in model.stages[0].getInputCols()]
    return model.transform(_filled(rows, features)).select(*keep, F.col("prediction").alias("pred"))


def feature_importance(model, features: list[str], rows: DataFrame) -> DataFrame:
    """Features ranked by importance; one row per feature."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    table = rows.sparkSession.createDataFrame(list(zip(features, values)), "feature STRING, importance DOUBLE")
    return table.orderBy(F.desc("importance"), "feature")


def assemble(rows: DataFrame, features: list[str] = SECTOR_FEATURES) -> DataFrame:
    """Feature vector in fixed order, as an array column for inspection."""
    vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)
    return vector.withColumn("feature_values", vector_to_array("features"))


def sector_indicator(sectors: list[str]) -> dict[str, Column]:
    return {f"is_{s.lower()}": (F.col("sector") == s).cast("double") for s in sectors}
