"""Declared schemas of the stored tables, and projection onto them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.fixed_values import EVENT_SCORES


INT, LONG, DOUBLE, TEXT, FLAG, DAY = (
    T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.DateType()
)


def _struct(names: str = "", kind: T.DataType = TEXT, **typed: T.DataType) -> T.StructType:
    """Fields named in a string share one type; the others follow with their own."""
    fields = [T.StructField(n, kind) for n in names.split()] + [T.StructField(n, t) for n, t in typed.items()]
    return T.StructType(fields)


RAW_TICKS = _struct("date item_name", price=DOUBLE, timestamp=TEXT)
VOLUME = _struct("item_name date", avg_price=DOUBLE, trade_count=LONG)
NOTICES = _struct("date category title link")
NOTICES_HEADERLESS = _struct("date event_type category event_name link")
NOTICE_CONTENT = _struct("date event_type original_category title link content")
ENRICHED_EVENTS = _struct(
    "date event_type title link is_pre_announced announcement_date",
    **{score: INT for score in EVENT_SCORES},
    package_category=TEXT, trajectory_pattern=TEXT, target_items=TEXT, confidence_score=INT, mechanisms_applied=TEXT,
)
EVENTS_V2 = _struct("date event_type title link keywords", impact_score=DOUBLE, sentiment=TEXT, reasoning=TEXT)
EVENTS_V1 = _struct("date event_type title link market_impact")
POSTS = _struct(
    "title link", reco=INT, content=TEXT, date=TEXT, score=DOUBLE, board=TEXT, is_target=FLAG
)
POST_LISTING = _struct(page=INT, date_str=TEXT, title=TEXT, link=TEXT)
POST_ANALYSES = _struct(
    "date event_name post_title post_link",
    analysis=_struct(
        key_announcements=T.ArrayType(TEXT), market_sentiment=TEXT, recommended_action=TEXT,
        target_items=T.ArrayType(TEXT), buy_timing_strategy=TEXT, confidence_score=INT,
    ),
    analyzed_at=TEXT,
)
SEASONALITY = _struct(
    "item", **{f"day_{k}": DOUBLE for k in range(7)}, global_mean=DOUBLE, global_std=DOUBLE, volatility_cv=DOUBLE
)
HOURLY_TRENDS = _struct(hour=INT, avg_deviation_pct=DOUBLE)
ITEM_BETAS = _struct("item", avg_return=DOUBLE, win_rate=DOUBLE, sample_size=LONG)
PREDICTIONS = _struct("sector date", predicted_trajectory=T.ArrayType(DOUBLE), horizons=T.ArrayType(INT))
REACTION = _struct(
    "is_gold_nerf is_new_raid is_t4_update is_progression_event", FLAG,
    key_features=T.ArrayType(TEXT), predicted_market_direction=TEXT, market_reasoning=TEXT, confidence_score=INT,
)
CALENDAR = _struct(
    event_id=LONG, date=DAY, event_type=TEXT, title=TEXT, link=TEXT, is_pre_announced=FLAG, announcement_date=DAY,
    honing_mat_demand=INT, gem_demand=INT, gold_inflation=INT, gold_sink=INT, content_difficulty=INT,
)


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Project onto ``schema``: absent columns and nulls take their default.

    Values that do not fit the declared type become null, not an error.
    """
    defaults = defaults or {}
    have = set(df.columns)
    out = []
    for field in schema.fields:
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        if field.name in have:
            value = F.col(field.name).try_cast(field.dataType)
            value = F.coalesce(value, default) if field.name in defaults else value
        else:
            value = default
        out.append(value.alias(field.name))
    return df.select(*out)
