"""Registered queries: each binds an operator to the given tables.

A query takes (spark, sf_dir) and returns a DataFrame. Sums of values that are
not whole numbers are rounded at this edge, since their last bits depend on
the order in which tasks finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.fixed_values import FRAME_FEATURES, SCENARIO_FEATURES, SECTOR_FEATURES, TYPE_LABELS
from eventide.functions.columns import intraday_features, number_or
from eventide.operators import bars, beta, calendar, enrich, evaluate, extract, ingest, models, season, sector_models, study
from eventide.operators import walkforward as wf
from eventide.session import stage_path, stage_table
from eventide.sources import driver_tables as dt
from eventide.sources import readers, sinks
from eventide.streaming import jobs
from eventide import schemas

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- ticks, bars


@query
def scan_prune(spark, sf_dir):
    """Typed scan of five columns with filters that reach the Parquet reader."""
    since = F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    lines = dt.table(spark, sf_dir, "lineitem")
    return lines.where((F.col("l_shipdate") >= since) & (F.col("l_returnflag") != "R")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day"), "l_extendedprice"
    )


@query
def normalize_ticks(spark, sf_dir):
    ticks = bars.normalize_ticks(dt.raw_ticks(spark, sf_dir))
    return ticks.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def daily_bars(spark, sf_dir):
    return rounded(bars.daily_bars(dt.ticks(spark, sf_dir)), 4, "price_std")


@query
def tick_store(spark, sf_dir):
    """Daily sums per part and item from the bucketed store: no exchange between the scans and the join or the sums."""
    ticks, items = dt.tick_store(spark, sf_dir, stage_path(spark, "tick_store"))
    joined = ticks.hint("merge").join(items, "part")
    return joined.groupBy("part", "item", "day").agg(F.sum("price").alias("price_sum"), F.count(F.lit(1)).alias("tick_count"))


@query
def tick_months(spark, sf_dir):
    """Bars of one year from ticks stored by month, of which other months are not read."""
    path = stage_path(spark, "tick_months")
    sinks.write_ticks_by_month(dt.ticks(spark, sf_dir).select("item", "day", "price"), path)
    year = spark.read.parquet(path).where((F.col("month") >= "1996-01") & (F.col("month") <= "1996-12"))
    return rounded(bars.daily_bars(year), 4, "price_std")


@query
def price_file(spark, sf_dir):
    """Daily prices through the sorted CSV sink and back, with the schema that readers declare."""
    path = stage_path(spark, "price_file")
    sinks.write_sorted_csv(_prices(spark, sf_dir).select("item", "day", "price", "trade_count"), path, ["item", "day"])
    return spark.read.schema("item string, day date, price double, trade_count bigint").option("header", True).csv(path)


@query
def family_daily(spark, sf_dir):
    return bars.family_daily(dt.ticks(spark, sf_dir), "AR")


def _prices(spark, sf_dir) -> DataFrame:
    """Daily prices as a stage table: several branches read them."""
    return stage_table(bars.daily_prices(dt.ticks(spark, sf_dir)), "prices")


@query
def dense_grid(spark, sf_dir):
    return bars.dense_grid(_prices(spark, sf_dir))


@query
def dense_grid_no_lookahead(spark, sf_dir):
    return bars.dense_grid(_prices(spark, sf_dir), backfill=False)


@query
def forward_return_7d(spark, sf_dir):
    prices = bars.daily_prices(dt.ticks(spark, sf_dir)).select("item", "day", "price")
    return bars.forward_return(prices)


@query
def forward_return_calendar(spark, sf_dir):
    """The return over seven calendar days, on the dense grid."""
    grid = bars.dense_grid(_prices(spark, sf_dir)).select("item", "day", "price")
    return bars.forward_return(grid)


@query
def seasonality(spark, sf_dir):
    out = season.seasonality(bars.daily_prices(dt.ticks(spark, sf_dir)), price="price")
    out = rounded(out, 6, *season.WEEKDAY_COLUMNS, "volatility_cv")
    return rounded(out, 3, "global_mean", "global_std")


@query
def excess_return(spark, sf_dir):
    prices = _prices(spark, sf_dir)
    out = season.excess_return(prices, season.seasonality(prices, price="price"), price="price")
    return rounded(out, 6, "excess_return").select("item", "day", "price", "weekday", "excess_return")


@query
def category_onehot(spark, sf_dir):
    parts = dt.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return season.category_onehot(parts, "p_name", dt.PART_CLASSES)


@query
def price_volume(spark, sf_dir):
    return bars.price_volume(dt.official_volume(dt.ticks(spark, sf_dir)))


@query
def preview(spark, sf_dir):
    """The first 10,000 feature rows: a bounded look at a large table."""
    prices = bars.daily_prices(dt.ticks(spark, sf_dir))
    return bars.preview(prices, ["item", "day"], 10_000)


@query
def stage_funnel(spark, sf_dir):
    ticks = dt.ticks(spark, sf_dir)
    events = dt.calendar(spark, sf_dir)
    return evaluate.stage_funnel(
        [
            ("raw ticks", dt.table(spark, sf_dir, "lineitem")),
            ("daily bars", ticks.select("item", "day").distinct()),
            ("events", events),
            ("strong events", events.where(F.col("honing_mat_demand") >= 7)),
        ]
    )


@query
def volume_dedup(spark, sf_dir):
    """Volume history appended by two fetches; the later fetch of a day wins."""
    ticks = dt.ticks(spark, sf_dir).where(F.col("feed").isin("N", "R"))
    fetches = ticks.groupBy("item", "day", (F.col("feed") == "R").cast("int").alias("fetch")).agg(
        F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("trade_count")
    )
    return bars.dedup_volume(fetches, "fetch")


@query
def volume_enrich(spark, sf_dir):
    ticks = dt.ticks(spark, sf_dir)
    out = bars.volume_enrich(bars.daily_bars(dt.market_feed(ticks)), dt.official_volume(ticks))
    return rounded(out, 4, "price_std")


def _merged_bars(spark, sf_dir) -> DataFrame:
    ticks = dt.ticks(spark, sf_dir)
    return bars.volume_backfill(bars.daily_bars(dt.market_feed(ticks)), dt.official_volume(ticks))


@query
def volume_backfill(spark, sf_dir):
    return rounded(_merged_bars(spark, sf_dir), 4, "price_std")


# -------------------------------------------------------------------- calendar


@query
def daily_events(spark, sf_dir):
    return calendar.daily_events(dt.calendar(spark, sf_dir))


@query
def event_lead_time(spark, sf_dir):
    events = dt.calendar(spark, sf_dir).select("event_id", "date", "announcement_date")
    return calendar.event_lead_time(events)


@query
def event_dedup(spark, sf_dir):
    return calendar.event_dedup(dt.calendar(spark, sf_dir))


@query
def numeric_coerce(spark, sf_dir):
    """Account balances stored as text, some of them unreadable."""
    text = F.when(F.col("c_mktsegment") == "BUILDING", "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return dt.table(spark, sf_dir, "customer").select("c_custkey", number_or(text).alias("balance"))


@query
def event_search(spark, sf_dir):
    return calendar.event_search(dt.calendar(spark, sf_dir), "update|summary|event", "Event", TYPE_LABELS)


@query
def summary_merge(spark, sf_dir):
    """Announced events, plus the stream summaries they lack."""
    cols = ["event_id", "date", "event_type", "title"]
    events = dt.calendar(spark, sf_dir)
    base = events.where(F.col("announcement_date").isNotNull()).select(*cols).withColumn("source", F.lit("impact"))
    extra = events.where(F.col("event_type") == "Stream Summary").select(*cols).withColumn("source", F.lit("summary"))
    return calendar.summary_merge(base, extra)


@query
def decision_rules(spark, sf_dir):
    return calendar.decision_rules(dt.calendar(spark, sf_dir))


FLAGS = list(dt.FLAG_WORDS)


def _day_features(spark, sf_dir) -> DataFrame:
    """One row per calendar day; written, so that its size is known to the join."""
    return stage_table(calendar.daily_event_features(dt.flagged_calendar(spark, sf_dir), FLAGS), "day_features")


@query
def event_feature_join(spark, sf_dir):
    ticks = dt.ticks(spark, sf_dir).select("item", "day", "price", "feed")
    return calendar.event_feature_join(ticks, _day_features(spark, sf_dir), FLAGS)


@query
def daily_features(spark, sf_dir):
    prices = bars.daily_prices(dt.ticks(spark, sf_dir)).select("item", "day", "price")
    return calendar.daily_features(prices, _day_features(spark, sf_dir), FLAGS)


def _training_frame(spark, sf_dir) -> DataFrame:
    return calendar.training_frame(_merged_bars(spark, sf_dir), calendar.daily_events(dt.calendar(spark, sf_dir)))


@query
def training_frame(spark, sf_dir):
    return rounded(_training_frame(spark, sf_dir), 4, "price_std")


# ----------------------------------------------------------------- event study


def _sector_index(spark, sf_dir) -> DataFrame:
    return study.sector_index(_prices(spark, sf_dir), dt.SECTORS)


def _curves(spark, sf_dir, digits: int | None = None) -> DataFrame:
    """One row per date; written, so that joins to events know its size."""
    return stage_table(study.date_curves(_sector_index(spark, sf_dir), digits=digits), "curves")


@query
def sector_index(spark, sf_dir):
    return rounded(_sector_index(spark, sf_dir), 4, "price")


@query
def event_trajectory(spark, sf_dir):
    return study.event_trajectory(dt.calendar(spark, sf_dir), _curves(spark, sf_dir, digits=4))


@query
def trajectory_wide(spark, sf_dir):
    curves = study.date_curves(_sector_index(spark, sf_dir))
    wide = stage_table(study.date_wide(curves, list(dt.SECTORS)), "wide_curves")
    return study.trajectory_wide(dt.calendar(spark, sf_dir), wide)


# ----------------------------------------------------------------- item betas


def _windows(spark, sf_dir) -> DataFrame:
    return beta.price_windows(bars.daily_prices(dt.ticks(spark, sf_dir)))


@query
def event_base_price(spark, sf_dir):
    dates = dt.calendar(spark, sf_dir).select("date").distinct()
    return _windows(spark, sf_dir).join(dates, "date").select("item", "date", "base_price", "base_source")


@query
def forward_window(spark, sf_dir):
    dates = dt.calendar(spark, sf_dir).select("date").distinct()
    out = _windows(spark, sf_dir).join(dates, "date").where(F.col("days_seen") > 0)
    return out.select("item", "date", "max_price", "mean_price", "days_seen")


def _betas(spark, sf_dir) -> DataFrame:
    returns = beta.event_returns(_windows(spark, sf_dir), beta.strong_dates(dt.calendar(spark, sf_dir)))
    return beta.item_betas(returns)


@query
def item_betas(spark, sf_dir):
    return rounded(_betas(spark, sf_dir), 4, "avg_return", "win_rate").orderBy(F.desc("avg_return"), "item")


@query
def listed_betas(spark, sf_dir):
    """Betas of the items on the hand-kept list, some of which have no prices."""
    windows = beta.price_windows(beta.listed_items(bars.daily_prices(dt.ticks(spark, sf_dir)), dt.LISTED_ITEMS))
    out = beta.item_betas(beta.event_returns(windows, beta.strong_dates(dt.calendar(spark, sf_dir))))
    return rounded(out, 4, "avg_return", "win_rate")


@query
def tier_picks(spark, sf_dir):
    out = beta.tier_picks(_betas(spark, sf_dir), beta.tier_mapping_table(spark, dt.TIERS))
    return rounded(out, 4, "avg_return", "win_rate")


@query
def hourly_deviation(spark, sf_dir):
    hours = season.hour_sides(season.hourly_deviation(dt.intraday_ticks(spark, sf_dir)))
    return rounded(hours, 6, "avg_deviation_pct")


@query
def tick_hours(spark, sf_dir):
    """Hour and weekday of every intraday tick."""
    ticks = dt.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("item"), "ts")
    return ticks.withColumns(intraday_features(F.col("ts"))).drop("ts")


@query
def best_hours(spark, sf_dir):
    best = season.best_hours(season.hourly_deviation(dt.intraday_ticks(spark, sf_dir)))
    return rounded(best, 6, "buy_dev", "sell_dev", "net_margin_pct")


# --------------------------------------------------------------- walk-forward


def _labels(spark, sf_dir) -> DataFrame:
    """Labels as a stage table: dates x sectors x horizons, whatever the number of events."""
    events = calendar.event_dedup(dt.calendar(spark, sf_dir))
    return stage_table(wf.label_table(events, _curves(spark, sf_dir)), "labels")


@query
def sample_weights(spark, sf_dir):
    out = wf.sample_weights(_labels(spark, sf_dir)).select("sector", "h", "date", "score", "w")
    return rounded(out, 4, "w")


@query
def walk_forward_folds(spark, sf_dir):
    """Fold report of one series; all series share the dates."""
    dates = dt.calendar(spark, sf_dir).select("date").distinct()
    series = dates.withColumns({"sector": F.lit("all"), "h": F.lit(0)})
    return wf.fold_report(wf.fold_starts(series))


@query
def walk_forward(spark, sf_dir):
    out = wf.walk_forward(_labels(spark, sf_dir))
    return rounded(out.select("sector", "date", "h", "fold_start", "pred"), 3, "pred")


@query
def walk_forward_purged(spark, sf_dir):
    out = wf.walk_forward_purged(_labels(spark, sf_dir))
    return rounded(out.select("sector", "date", "h", "pred"), 3, "pred")


@query
def final_overwrite(spark, sf_dir):
    out = wf.final_overwrite(_labels(spark, sf_dir))
    return rounded(out.select("sector", "date", "h", "pred", "source"), 3, "pred")


@query
def trajectory_arrays(spark, sf_dir):
    """Trajectory arrays, opened again so that rows can be compared."""
    arrays = wf.trajectory_arrays(wf.walk_forward(_labels(spark, sf_dir)))
    points = F.posexplode(F.arrays_zip("horizons", "predicted_trajectory"))
    out = arrays.select("sector", "date", points.alias("pos", "p")).select(
        "sector", "date", "pos", F.col("p.horizons").alias("h"), F.col("p.predicted_trajectory").alias("pred")
    )
    return rounded(out, 3, "pred")


@query
def forecast_choice(spark, sf_dir):
    """Display frame of every event; the stored forecasts cover all dates of the calendar."""
    stored = stage_table(wf.final_overwrite(_labels(spark, sf_dir)), "stored_forecasts")
    events = calendar.event_lead_time(dt.calendar(spark, sf_dir))
    return evaluate.forecast_choice(events, stored, stored, digits=3)


@query
def forecast_live(spark, sf_dir):
    """Display frame where the stored history ends early: later events take the live model's forecast."""
    labels = _labels(spark, sf_dir)
    kept = stage_table(wf.final_overwrite(labels), "stored_forecasts")
    stored = kept.where(F.col("date") < F.lit("1998-01-01").cast("date"))
    live = stage_table(wf.live_forecasts(labels), "live_forecasts")
    events = calendar.event_lead_time(dt.calendar(spark, sf_dir))
    return evaluate.forecast_choice(events, stored, kept, live=live, digits=3)


@query
def directional_accuracy(spark, sf_dir):
    forecasts = wf.final_overwrite(_labels(spark, sf_dir)).where((F.col("sector") == "Honing") & (F.col("h") == 7))
    per_date = dt.calendar(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n_events"))
    out = evaluate.directional_accuracy(forecasts, per_date)
    return rounded(out, 6, "accuracy", "recall", "precision")


@query
def directional_by_date(spark, sf_dir):
    forecasts = wf.final_overwrite(_labels(spark, sf_dir)).where((F.col("sector") == "Honing") & (F.col("h") == 7))
    return rounded(evaluate.directional_by_date(forecasts), 3, "y", "pred")


@query
def horizon_errors(spark, sf_dir):
    out = evaluate.horizon_errors(wf.walk_forward(_labels(spark, sf_dir)))
    return rounded(out, 4, "rmse", "mae", "avg_rmse")


def _feature_labels(spark, sf_dir) -> DataFrame:
    """Labels with all event scores, as a stage table."""
    events = calendar.event_dedup(dt.calendar(spark, sf_dir)).select("date", *SECTOR_FEATURES)
    return stage_table(sector_models.feature_labels(events, _curves(spark, sf_dir)), "feature_labels")


@query
def walk_forward_grams(spark, sf_dir):
    """Normal equations of every fold: weighted sums over all earlier dates."""
    rows = sector_models.fold_grams(_feature_labels(spark, sf_dir))
    names = list(sector_models.gram_terms(len(SECTOR_FEATURES)))
    out = rows.select("sector", "h", "fold_start", *names).dropDuplicates(["sector", "h", "fold_start"])
    return rounded(rounded(out, 0, *[n for n in names if n.endswith("y")]), 2, *[n for n in names if not n.endswith("y")])


@query
def walk_forward_lines(spark, sf_dir):
    """Past-only forecasts by all four scores."""
    out = sector_models.walk_forward_lines(_feature_labels(spark, sf_dir))
    return rounded(out.select("sector", "date", "h", "fold_start", "pred"), 3, "pred")


@query
def sector_first_trees(spark, sf_dir):
    """Leaves of the first tree of each sector and horizon."""
    series = sector_models.boosted_series(_feature_labels(spark, sf_dir), trees=1)
    return sector_models.leaf_table(series).withColumn("gives", F.round("gives", 6) + 0.0)


@query
def sector_trees(spark, sf_dir):
    """Forecasts of the final trees, one monotone model for each sector and horizon."""
    labels = _feature_labels(spark, sf_dir)
    series = stage_table(sector_models.boosted_series(labels), "sector_trees")
    return sector_models.boosted_forecasts(series, labels)


@query
def isotonic_fit(spark, sf_dir):
    out = wf.isotonic_levels(_labels(spark, sf_dir))
    return rounded(out, 3, "weight", "mean_index", "isotonic_index")


# ---------------------------------------------------------------------- models


def _frames(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training frame, whole, and with classes and excess returns, outliers trimmed; both as stage tables."""
    frame = stage_table(_training_frame(spark, sf_dir), "training_frame")
    excess = season.excess_return(frame, season.seasonality(frame))
    return frame, stage_table(season.category_onehot(excess, "item", dt.CLASSES), "scored_frame")


def _scored_frame(spark, sf_dir) -> DataFrame:
    return _frames(spark, sf_dir)[1]


def _backtest_errors(frame: DataFrame, rows: DataFrame) -> DataFrame:
    """Errors of a backtest beside the sizes of the whole frame, which has one row of them."""
    errors = evaluate.error_metrics(rows, ["day"], "excess_return", "predicted_excess")
    sizes = frame.agg(
        F.countDistinct(F.when(F.col("is_event_day") == 1, F.col("day"))).alias("event_days"),
        F.countDistinct("item").alias("items"),
        F.count(F.lit(1)).alias("frame_rows"),
    )
    one = sizes.select(F.struct("*")).scalar()
    columns = [one[c].alias(c) for c in ("event_days", "items", "frame_rows")]
    return rounded(errors.select("day", "rmse", "mae", F.col("n").alias("test_rows"), *columns), 6, "rmse", "mae")


@query
def backtest_last_event(spark, sf_dir):
    frame, scored = _frames(spark, sf_dir)
    return _backtest_errors(frame, models.backtest_rows(scored, models.last_event_day(frame)))


@query
def backtest_features(spark, sf_dir):
    """Errors of the backtest by one line over all twelve features of the frame."""
    frame, scored = _frames(spark, sf_dir)
    return _backtest_errors(frame, models.backtest_features(scored, models.last_event_day(frame), FRAME_FEATURES))


@query
def backtest_feature_rows(spark, sf_dir):
    """The same forecasts, item by item."""
    frame, scored = _frames(spark, sf_dir)
    out = models.backtest_features(scored, models.last_event_day(frame), FRAME_FEATURES)
    return rounded(out, 6, "predicted_excess", "excess_return", "error")


@query
def top_movers(spark, sf_dir):
    frame, scored = _frames(spark, sf_dir)
    rows = stage_table(models.backtest_rows(scored, models.last_event_day(frame)), "backtest_rows")
    return rounded(models.top_movers(rows), 6, "predicted_excess", "excess_return", "error").drop("train_rows")


CLASS_LABELS = [label for label, _ in dt.CLASSES] + ["other"]


@query
def scenario_scores(spark, sf_dir):
    """Every event day as a scenario; the ten best items for each, by fitted lines."""
    frame = _scored_frame(spark, sf_dir)
    train = models.recency_weights(frame)
    lines, pooled = (models.fit_lines(train, by, "honing_mat_demand", "excess_return") for by in (["category"], []))
    scenarios = calendar.daily_events(dt.calendar(spark, sf_dir)).select("date", "honing_mat_demand")
    scored = models.line_scores(models.class_grid(scenarios, CLASS_LABELS), lines, pooled)
    out = models.rank_items(scored, frame.select("item", "category").distinct(), "date")
    return rounded(out, 6, "predicted_excess_return", "score")


@query
def scenario_feature_scores(spark, sf_dir):
    """The same ranking by one line over all fourteen features; the supply scores, which no frame holds, count as 0."""
    frame = _scored_frame(spark, sf_dir)
    model = stage_table(models.ridge_line(models.recency_weights(frame), SCENARIO_FEATURES, "excess_return"), "scenario_line")
    days = calendar.daily_events(dt.calendar(spark, sf_dir))
    grid = models.class_grid(days.withColumn("is_weekend", (F.weekday("date") >= 5).cast("int")), CLASS_LABELS)
    scored = models.ridge_scores(models.scenario_vectors(grid), model).withColumn("predicted_excess_return", F.round("predicted_excess_return", 8))
    out = models.rank_items(scored.select("date", "category", "predicted_excess_return"), frame.select("item", "category").distinct(), "date")
    return rounded(out, 6, "score")


@query
def scenario_model_scores(spark, sf_dir):
    """The same ranking by boosted trees over all features of the frame."""
    frame = _scored_frame(spark, sf_dir)
    model = models.boosted_model(frame, FRAME_FEATURES, "excess_return")
    days = calendar.daily_events(dt.calendar(spark, sf_dir))
    grid = models.class_grid(days.withColumn("is_weekend", (F.weekday("date") >= 5).cast("int")), CLASS_LABELS)
    scored = models.boosted_scores(model, grid, ["date", "category"]).withColumnRenamed("pred", "predicted_excess_return")
    return models.rank_items(scored, frame.select("item", "category").distinct(), "date")


@query
def feature_vectors(spark, sf_dir):
    """Feature vector of each event in fixed order, opened to position and value."""
    events = calendar.event_dedup(dt.calendar(spark, sf_dir))
    vectors = models.assemble(events, SECTOR_FEATURES)
    return vectors.select("event_id", F.posexplode("feature_values").alias("pos", "feature_value"))


def _pooled_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Labels of all sectors and horizons in one table, weighted."""
    events = calendar.event_dedup(dt.calendar(spark, sf_dir)).select("date", *SECTOR_FEATURES)
    indicators = models.sector_indicator(list(dt.SECTORS))
    rows = wf.sample_weights(_labels(spark, sf_dir)).join(events, "date").withColumns(indicators)
    return stage_table(rows, "pooled_rows"), [*SECTOR_FEATURES, "h", *indicators]


@query
def gbt_scores(spark, sf_dir):
    """Final boosted trees over all sectors and horizons, trained in one distributed fit."""
    rows, features = _pooled_rows(spark, sf_dir)
    model = models.boosted_model(rows.where("y is not null"), features, "y", "w")
    return models.boosted_scores(model, rows, ["sector", "date", "h"])


@query
def gbt_importance(spark, sf_dir):
    """Features of the excess-return trees, by importance."""
    frame = _scored_frame(spark, sf_dir)
    model = models.boosted_model(frame, FRAME_FEATURES, "excess_return")
    return models.feature_importance(model, FRAME_FEATURES, frame)


# ------------------------------------------------------------------- documents


@query
def event_flags(spark, sf_dir):
    sentiment = F.lit("unknown")
    for lang, label in dt.SENTIMENT_OF_LANG.items():
        sentiment = F.when(F.col("lang") == lang, label).otherwise(sentiment)
    docs = dt.table(spark, sf_dir, "documents").select("doc_id", "text", sentiment.alias("sentiment"))
    flags = enrich.event_flags(docs, "text", "sentiment", dt.FLAG_WORDS)
    return flags.select("doc_id", *dt.FLAG_WORDS, "sentiment_score")


@query
def content_filter(spark, sf_dir):
    """Main content of pages that pass the type and quality filter."""
    content = extract.page_text(dt.table(spark, sf_dir, "pages"), keep=["url"])
    kind = F.when(F.col("url").startswith("https:"), "Official Notice").otherwise("Cash Shop")
    kept = enrich.content_filter(content.withColumn("event_type", kind))
    return kept.select("page_id", "event_type", F.length("content").alias("content_length"))


@query
def broadcast_filter(spark, sf_dir):
    posts = dt.posts(spark, sf_dir).withColumn("date", F.to_date("ts"))
    kept = enrich.broadcast_filter(posts, "text", dt.BROADCAST_WORDS, dt.BROADCAST_EXCLUDED, "2024-01-10")
    return kept.select("link", "date", "author")


def _scored_posts(spark, sf_dir) -> DataFrame:
    return enrich.post_score(
        dt.posts(spark, sf_dir), dt.PRIORITY_SOURCE, "text", "text",
        stream_words=dt.STREAM_WORDS, type_words=dt.TYPE_WORDS, bonus=dt.BONUS_WORDS,
    )


@query
def post_score(spark, sf_dir):
    scored = _scored_posts(spark, sf_dir)
    out = scored.select("link", "author", "reco", "title_score", "score", "legacy_score", "is_candidate")
    return rounded(out, 3, "legacy_score")


@query
def best_post(spark, sf_dir):
    """Best post for each broadcast; every intraday event stands for one."""
    shows = dt.table(spark, sf_dir, "events").select("event_id", "ts")
    candidates = _scored_posts(spark, sf_dir).where("is_candidate")
    links = F.array(*[F.struct(F.to_date(F.lit(d)).alias("target_date"), F.lit(n).cast("bigint").alias("manual_link")) for d, n in dt.MANUAL_LINKS])
    manual = spark.range(1).select(F.inline(links))
    return enrich.best_post(shows, candidates, manual).select("event_id", "link", "score", "origin")


@query
def post_dedup(spark, sf_dir):
    """Stored posts are the labelled ones; a new crawl returns all with more votes, a third of them again later."""
    posts = dt.posts(spark, sf_dir).select("link", "author", "reco")
    labelled = dt.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("link")).distinct()
    stored = posts.join(labelled, "link", "left_semi")
    again = posts.where("link % 3 = 0").withColumn("reco", F.col("reco") + 5)
    crawl = posts.withColumn("reco", F.col("reco") + 1).unionByName(again)
    return ingest.post_dedup(stored, crawl, order=[-F.col("reco")])


@query
def recent_context(spark, sf_dir):
    """Context text for each intraday event, found once per day."""
    events = dt.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"))
    candidates = _scored_posts(spark, sf_dir).where("is_candidate")
    context = stage_table(enrich.recent_context(events.select("date").distinct(), candidates), "context")
    return events.join(context, "date", "left").select(
        "event_id", "date", F.coalesce("context", F.lit("None")).alias("context")
    )


@query
def nearest_summary(spark, sf_dir):
    """The stream summary closest to each official notice, within a day."""
    events = dt.calendar(spark, sf_dir)
    summaries = events.where(F.col("event_type") == "Stream Summary").select(
        F.col("event_id").alias("summary_id"), F.coalesce("announcement_date", "date").alias("date")
    )
    nearest = stage_table(enrich.nearest_by_date(summaries), "nearest")
    notices = events.where(F.col("event_type") == "Official Notice").select("event_id", "date")
    return notices.join(nearest, "date", "left").select("event_id", "date", "summary_id", "diff_days")


@query
def keyword_override(spark, sf_dir):
    """Override over whole documents, with scores derived from their ids."""
    docs = dt.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"),
        (F.col("doc_id") % 11).cast("int").alias("honing_mat_supply"),
        (F.col("doc_id") * 3 % 11).cast("int").alias("honing_mat_demand"),
        F.lit("Analysis").alias("mechanisms_applied"),
    )
    return enrich.keyword_override(docs, "content", dt.SUPPLY_WORDS, dt.DEMAND_WORDS).drop("content")


@query
def target_item_filter(spark, sf_dir):
    """Texts as comma lists; the pieces of the benchmark passages are the known items."""
    docs = dt.table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = F.explode(F.split("text", ","))
    known = dt.table(spark, sf_dir, "benchmark").select(pieces.alias("item")).select(F.trim("item").alias("item"))
    return enrich.target_item_filter(docs, known, "doc_id", "text", dt.FORBIDDEN_WORDS)


@query
def broadcast_time(spark, sf_dir):
    """Start times read back from announcements written in three notations."""
    day = F.to_date("o_orderdate")
    hour = (F.col("o_orderkey") % 12 + 1).cast("int")
    half = F.when(F.col("o_custkey") % 2 == 0, "오전").otherwise("오후")
    anchor = F.date_sub(day, (F.col("o_custkey") % 20).cast("int"))
    minute = F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")
    kind = F.col("o_orderpriority")
    text = (
        F.when(kind == "1-URGENT", F.concat(F.lit("LIVE "), F.date_format(day, "yyyy.M.d"), F.lit(" start "), hour, F.lit(":"), minute))
        .when(kind == "2-HIGH", F.concat(F.year(day), F.lit("년 "), F.month(day), F.lit("월 "), F.day(day), F.lit("일(수) "), half, F.lit(" "), hour, F.lit("시\n방송")))
        .when(kind == "3-MEDIUM", F.concat(F.lit("안내\n"), F.month(day), F.lit("월 "), F.day(day), F.lit("일 "), hour, F.lit("시")))
        .when(kind == "4-NOT SPECIFIED", F.concat(F.month(day), F.lit("/"), F.day(day), F.lit(" "), hour, F.lit(":"), minute))
        .otherwise("no time given")
    )
    orders = dt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), text.alias("text"), anchor.alias("anchor"))
    return extract.broadcast_times(orders, "text", "anchor").drop("text")


def _listing(spark, sf_dir) -> DataFrame:
    """Orders as board listings from new to old, dated by month and day only."""
    age = F.lit(12000) - F.unix_date(F.to_date("o_orderdate"))
    return dt.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("link"),
        F.col("o_orderpriority").alias("board"),
        F.floor(age / 7).cast("int").alias("page"),
        age.alias("age"),
        F.date_format("o_orderdate", "MM-dd").alias("month_day"),
    )


def _dated_listing(spark, sf_dir) -> DataFrame:
    """The listing with years, from the order of its rows alone."""
    return extract.board_years(_listing(spark, sf_dir), F.lit(2001), order=["age", "link"])


@query
def board_year(spark, sf_dir):
    """Year of each listed post; some posts show a clock time or a full date instead of month and day."""
    link, shown = F.col("link"), F.col("month_day")
    shown = F.when(link % 7 == 0, F.date_format(F.date_from_unix_date(F.lit(12000) - F.col("age")), "yyyy-MM-dd")).when(link % 11 == 0, "12:34").otherwise(shown)
    listing = _listing(spark, sf_dir).withColumn("month_day", shown)
    out = extract.board_years(listing, F.lit(2001), order=["age", "link"])
    return out.select("link", "board", "page", "month_day", "year")


@query
def page_spans(spark, sf_dir):
    """Date span of each listing page."""
    dated = _dated_listing(spark, sf_dir)
    crawled = F.to_timestamp_ntz(F.lit("2001-08-01 00:00:00"))
    dated = dated.withColumn("post_date", extract.post_date(F.col("month_day"), F.col("year"), crawled))
    return extract.page_date_spans(dated)


def _notice_feed(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("notice_id"), "ts", (F.floor(F.col("value")) % 10 + 1).cast("int").alias("score")
    )


@query
def news_alerts(spark, sf_dir):
    return enrich.news_alerts(_notice_feed(dt.table(spark, sf_dir, "events")))


# ------------------------------------------------------- responses and merges


@query
def json_profile(spark, sf_dir):
    return enrich.json_profile(dt.table(spark, sf_dir, "events"), "props")


@query
def json_landing(spark, sf_dir):
    landed = enrich.json_landing(dt.responses(spark, sf_dir))
    return landed.select(
        "event_id", "honing_mat_demand", "gem_demand", "gold_sink", "confidence_score", "target_items",
        "trajectory_pattern", "mechanisms_applied", "parse_error",
    )


@query
def reaction_landing(spark, sf_dir):
    """Reaction responses with their eight fields, written from the labels; every seventh is unreadable."""
    flag = F.when(F.col("quality") == 1, "true").otherwise("false")
    raw = F.concat(
        F.lit('```json {"is_gold_nerf": '), flag, F.lit(', "key_features": ["a", "doc '), F.col("doc_id").cast("string"),
        F.lit('"], "predicted_market_direction": "Rise", "confidence_score": '), F.col("toxic").cast("string"), F.lit("} ```"),
    )
    raw = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("no answer for "), F.col("doc_id").cast("string"))).otherwise(raw)
    landed = enrich.reaction_landing(dt.table(spark, sf_dir, "labels").select("doc_id", raw.alias("raw")))
    return landed.select(
        "doc_id", "is_gold_nerf", "is_new_raid", F.array_join("key_features", "|").alias("key_features"),
        "predicted_market_direction", "confidence_score", "parse_error", "raw_response",
    )


@query
def roadmap_explode(spark, sf_dir):
    out = enrich.roadmap_explode(dt.roadmap_responses(spark, sf_dir))
    keep = ["link", "pos", "date", "event_type", "title", "is_pre_announced", "announcement_date", "gem_demand", "gold_sink"]
    keep += ["confidence_score", *enrich.ROADMAP_TEXTS]
    return out.select(*keep)


@query
def history_flatten(spark, sf_dir):
    """Item histories packed as API responses per item and month, then flattened."""
    volume = dt.official_volume(dt.ticks(spark, sf_dir))
    stat = F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("Date"), F.col("avg_price").alias("AvgPrice"), F.col("trade_count").alias("TradeCount")
    )
    packed = volume.groupBy("item", F.date_format("day", "yyyy-MM").alias("month")).agg(F.collect_list(stat).alias("Stats"))
    response = F.to_json(F.array(F.struct(F.col("item").alias("Name"), F.col("Stats"))))
    return ingest.history_flatten(packed.select(response.alias("response")))


@query
def dim_dedup(spark, sf_dir):
    """Items by id from line items as listing records; the last one decides the name."""
    records = dt.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("grade"), F.col("l_suppkey").alias("seller"),
        "l_shipdate", "l_orderkey", "l_linenumber",
    )
    order = [F.col(c) for c in ["l_shipdate", "l_orderkey", "l_linenumber", "seller", "grade"]]
    return ingest.discover_items(records, order, dt.GRADES).select("item_id", "grade", "seller")


@query
def analysis_upsert(spark, sf_dir):
    """Post analyses, where the labelled posts are analysed anew."""
    history = dt.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_link"), F.struct(F.col("lang").alias("verdict"), F.array("source").alias("tags")).alias("analysis")
    )
    fresh = dt.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("post_link"),
        F.struct(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("verdict"), F.array(F.lit("new")).alias("tags")).alias("analysis"),
    )
    merged = ingest.replace_by_key(history, fresh, "post_link")
    return merged.select("post_link", "analysis.verdict", F.array_join("analysis.tags", ",").alias("tags"))


@query
def notice_extract(spark, sf_dir):
    return extract.listing_links(dt.table(spark, sf_dir, "pages"), r'<li><a href="([^"]*)">([^<]*)</a></li>')


def _listing_pages(spark, sf_dir) -> DataFrame:
    """Pages written as notice listings: a notice row, a plain row and a row without id."""
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    number = F.col("page_id").cast("string")
    row = F.concat(
        F.lit('<li class="list__item notice">\n<a href="/News/Notice/Views/'), number, F.lit('?page=1">'),
        F.lit('<span class="icon icon--notice">공지</span><span class="list__title"> '), title, F.lit(" </span>"),
        F.lit('<div class="list__date" title="x">2024.01.'), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</div></a></li>"),
    )
    plain = F.concat(F.lit('<li class="list__item"><a href="/News/Notice/NoticeViews/9'), number, F.lit('?x">no title</a></li>'))
    empty = F.lit('<li class="list__item"><a href="/elsewhere">x</a></li>')
    return dt.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<ul>"), empty, row, plain, F.lit("</ul>")).alias("html"))


@query
def notice_rows(spark, sf_dir):
    return extract.notice_rows(_listing_pages(spark, sf_dir), keep=["page_id"])


@query
def latest_notice(spark, sf_dir):
    return extract.latest_notice(extract.notice_rows(_listing_pages(spark, sf_dir), keep=["page_id"]))


@query
def page_text(spark, sf_dir):
    return extract.page_text(dt.table(spark, sf_dir, "pages"))


@query
def notice_upsert(spark, sf_dir):
    return ingest.notice_upsert(dt.stored_notices(spark, sf_dir), dt.notice_batch(spark, sf_dir))


@query
def incremental_append(spark, sf_dir):
    return ingest.incremental_append(dt.notice_batch(spark, sf_dir), dt.stored_notices(spark, sf_dir), ["link"])


@query
def processed_dates(spark, sf_dir):
    """Official notices on days without a processed stream summary."""
    events = dt.calendar(spark, sf_dir)
    notices = events.where(F.col("event_type") == "Official Notice").select("event_id", F.col("date").alias("broadcast_date"))
    return ingest.unprocessed(notices, events, "Stream Summary")


# ----------------------------------------------------------------------- files


@query
def source_cascade(spark, sf_dir):
    """The richest calendar file that exists, with its lineage tag."""
    candidates = [
        ("events_impact_analyzed.parquet", "Impact Analyzed", spark.read.parquet),
        ("events_enriched.parquet", "Enriched", spark.read.parquet),
        ("orders.parquet", "Raw", lambda path: dt.calendar_columns(spark.read.parquet(path)).drop("gold_sink")),
    ]
    return readers.source_cascade(spark, sf_dir, candidates, schemas.CALENDAR, {"gold_sink": 0})


@query
def latest_snapshot(spark, sf_dir):
    """The file whose name sorts last among those that start with 'p'."""
    return spark.read.parquet(readers.latest_snapshot(spark, sf_dir, "p", ".parquet"))


# --------------------------------------------------------------------- streams


def _table_stream(spark, sf_dir, name: str) -> DataFrame:
    """A table as a stream; the one-name pattern takes a single file as well as a folder."""
    return jobs.file_stream(spark, f"{sf_dir}/{{{name}}}.parquet")


def _tick_stream(spark, sf_dir) -> DataFrame:
    events = _table_stream(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("item"), "ts", dt.hundredths(F.col("value")).alias("price"))


@query
def stream_hourly_bars(spark, sf_dir):
    return jobs.hourly_bars(_tick_stream(spark, sf_dir), stage_path(spark, "hourly"))


@query
def stream_daily_state(spark, sf_dir):
    return jobs.daily_state(_tick_stream(spark, sf_dir), stage_path(spark, "daily"))


@query
def stream_alerts(spark, sf_dir):
    feed = _notice_feed(_table_stream(spark, sf_dir, "events"))
    return jobs.alerts(feed, stage_path(spark, "alerts"))


@query
def stream_upsert(spark, sf_dir):
    batches = dt.fresh_listing(_table_stream(spark, sf_dir, "pages"))
    return jobs.upsert_notices(batches, dt.stored_notices(spark, sf_dir), stage_path(spark, "upsert"))


@query
def stream_prices(spark, sf_dir):
    """Trajectories of all events after on-time ticks and then late ones; the late ones rewrite only the dates they move."""
    folder, landed = stage_path(spark, "prices"), stage_path(spark, "landed")
    ticks = dt.ticks(spark, sf_dir).select("item", "day", "price", "feed")
    events = stage_table(dt.calendar(spark, sf_dir).select("event_id", "date"), "stored_events")
    for late in (False, True):
        ticks.where((F.col("feed") == "R") == late).drop("feed").write.mode("append").parquet(landed)
        out = jobs.refresh_prices(jobs.file_stream(spark, landed), events, folder, dt.SECTORS, digits=4)
    return out


@query
def stream_refresh(spark, sf_dir):
    events = dt.calendar_columns(_table_stream(spark, sf_dir, "orders"))
    return jobs.refresh_trajectories(events, _curves(spark, sf_dir, digits=4), stage_path(spark, "refresh"))
