"""The market domain as views over the given tables.

All views read whole tables. Prices are whole hundredths, held as doubles:
their sums are exact below 2^53, so means do not depend on the order in which
tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.sources.sinks import write_bucketed

SECTORS = {
    "Honing": ["Brand#1", "Brand#2", "Brand#3", "Brand#4"],
    "Gem": ["Brand#5", "Brand#6", "Brand#7"],
    "Engraving": ["Brand#8", "Brand#9"],
}
CLASSES = [
    ("honing_mat", ["#1"]),
    ("gem", ["#2", "#3"]),
    ("engraving", ["#4"]),
    ("consumable", ["#5", "#6"]),
]
LISTED_ITEMS = [f"Brand#{k}" for k in range(1, 40, 3)]
PART_CLASSES = [
    ("honing_mat", ["anvil", "bolt"]),
    ("gem", ["ring"]),
    ("engraving", ["plate"]),
    ("consumable", ["widget", "gear"]),
]
TIERS = {"Brand#1": "Brand#11", "Brand#2": "Brand#11", "Brand#3": None}
EVENT_TYPES = {
    "1-URGENT": "Update",
    "2-HIGH": "Roadmap Item",
    "3-MEDIUM": "Event",
    "4-NOT SPECIFIED": "Official Notice",
    "5-LOW": "Stream Summary",
}
FLAG_WORDS = {
    "is_gold_nerf": ["license", "copyright"],
    "is_new_raid": ["that", "with"],
    "is_t4": ["tion of", "the and"],
    "is_gem": ["pour"],
    "is_package": ["nicht"],
}
SENTIMENT_OF_LANG = {"en": "positive", "fr": "neutral", "de": "negative"}
STREAM_WORDS = ["that", "dans", "nicht"]
TYPE_WORDS = ["with", "pour", "sich"]
BONUS_WORDS = {"that": 50, "with": 30, "orantion": 20}
PRIORITY_SOURCE = "src3"
BROADCAST_WORDS = ["the", "que"]
BROADCAST_EXCLUDED = ["nicht", "token"]
SUPPLY_WORDS = ["license", "with"]
DEMAND_WORDS = ["token", "elle"]
FORBIDDEN_WORDS = ["license", "token", "the "]
GRADES = ["A", "N"]
MANUAL_LINKS = [("2024-01-01", -1)]
EPOCH_OF_POSTS = "2024-01-01 00:00:00"
TICKS_PER_BUCKET = 1 << 19
#: Spark's own bound on the buckets of a table (spark.sql.sources.bucketing.maxBuckets).
MOST_BUCKETS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths(amount: Column) -> Column:
    return F.floor(amount * 100.0 + 0.5).cast("double")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ticks of items, from every line item."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"), F.col("p_type").alias("family"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.to_date("l_shipdate").alias("day"),
        hundredths(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_returnflag").alias("feed"),
    )
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def tick_store(spark: SparkSession, sf_dir: str, folder: str, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """Ticks and the item dimension as bucketed tables of the part key, written under ``folder`` once.

    Every later job joins and groups them by part without moving a tick. A bucket is one task's, so
    there are ``buckets`` of them or as many more as hold ``TICKS_PER_BUCKET`` ticks or parts each on average.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("day"),
        hundredths(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_returnflag").alias("feed"),
    )
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("item"), F.col("p_type").alias("family"))
    most = max(lines.count(), items.count())
    buckets = max(buckets, min(-(-most // TICKS_PER_BUCKET), MOST_BUCKETS))
    name = folder.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    stored = write_bucketed(lines, f"{name}_ticks", f"{folder}/ticks", "part", buckets, ["day"])
    return stored, write_bucketed(items, f"{name}_items", f"{folder}/items", "part", buckets)


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks whose time is text in mixed notations; some of it unreadable."""
    ship = F.col("l_shipdate")
    kind = F.col("l_linenumber")
    text = (
        F.when(kind == 1, F.date_format(ship, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 2, F.concat(F.date_format(ship, "yyyy-MM-dd HH:mm:ss"), F.lit(".000000000")))
        .when(kind == 3, F.date_format(ship, "yyyy/MM/dd HH:mm:ss"))
        .when(kind == 4, F.date_format(ship, "yyyy-MM-dd"))
        .when(kind == 5, F.date_format(ship, "yyyy.MM.dd"))
        .when(kind == 6, F.concat(F.date_format(ship, "yyyy-MM-dd"), F.lit("T"), F.date_format(ship, "HH:mm:ss")))
        .otherwise("not a date")
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("price"), text.alias("date")
    )


def market_feed(ticks_df: DataFrame) -> DataFrame:
    """Ticks seen by the price collector."""
    return ticks_df.where(F.col("feed").isin("A", "N"))


def official_volume(ticks_df: DataFrame) -> DataFrame:
    """Daily price and trade count seen by the official history."""
    return (
        ticks_df.where(F.col("feed").isin("N", "R"))
        .groupBy("item", "day")
        .agg(F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("trade_count"))
    )


def intraday_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-frequency ticks with microsecond times."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("item"), "ts", hundredths(F.col("value")).alias("price")
    )


def _event_type() -> Column:
    out = F.lit(None).cast("string")
    for priority, kind in EVENT_TYPES.items():
        out = F.when(F.col("o_orderpriority") == priority, kind).otherwise(out)
    return out


def calendar_columns(orders: DataFrame) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    date = F.to_date("o_orderdate")
    return orders.select(
        key.alias("event_id"),
        date.alias("date"),
        _event_type().alias("event_type"),
        F.concat_ws(" ", _event_type(), key.cast("string")).alias("title"),
        F.concat(F.lit("/notice/"), key.cast("string")).alias("link"),
        (F.col("o_orderpriority") == "2-HIGH").alias("is_pre_announced"),
        F.when(F.col("o_orderstatus") != "P", F.date_sub(date, (cust % 30).cast("int"))).alias("announcement_date"),
        (key * 7 % 11).cast("int").alias("honing_mat_demand"),
        (cust * 3 % 11).cast("int").alias("gem_demand"),
        (key % 11).cast("int").alias("gold_inflation"),
        (cust * 5 % 11).cast("int").alias("gold_sink"),
        (cust % 11).cast("int").alias("content_difficulty"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events, one per order."""
    return calendar_columns(table(spark, sf_dir, "orders"))


def flagged_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with keyword flags, impact and sentiment."""
    events = calendar(spark, sf_dir)
    demand = F.col("gem_demand")
    return events.select(
        "event_id",
        "date",
        "event_type",
        (F.col("gold_inflation") >= 9).cast("int").alias("is_gold_nerf"),
        (F.col("content_difficulty") >= 8).cast("int").alias("is_new_raid"),
        (F.col("gold_sink") >= 8).cast("int").alias("is_t4"),
        (F.col("gem_demand") >= 9).cast("int").alias("is_gem"),
        (F.col("event_type") == "Roadmap Item").cast("int").alias("is_package"),
        F.col("gold_inflation").cast("double").alias("impact_score"),
        F.when(demand > 7, 1).when(demand < 3, -1).otherwise(0).alias("sentiment_score"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community posts, one per document, spread over a month of minutes."""
    minute = F.col("doc_id") * 37 % 43200
    ts = F.to_timestamp_ntz(F.lit(EPOCH_OF_POSTS)) + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("link"),
        F.concat_ws("/", "source", "lang").alias("title"),
        "text",
        F.col("source").alias("author"),
        (F.col("doc_id") % 40).cast("int").alias("reco"),
        ts.alias("ts"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model responses, one per event: fenced, listed, in prose, broken or empty."""
    k = F.get_json_object("props", "$.k").cast("int")
    score = (k % 11).cast("string")
    body = F.concat(
        F.lit('{"honing_mat_demand": '), score, F.lit(', "gem_demand": "'), score,
        F.lit('", "target_items": "'), F.col("event_type"), F.lit('", "confidence_score": '), (k % 10).cast("string"), F.lit("}"),
    )
    kind = F.col("user_id") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Here is the result: "), body, F.lit(" Hope it helps.")))
        .when(kind == 2, body)
        .when(kind == 3, F.concat(F.lit("```json {"), F.lit('"honing_mat_demand": '), F.lit("```")))
        .otherwise("")
    )
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def roadmap_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored roadmap responses: lists of two events, or a lone object."""
    label = F.col("event_type")
    user = F.col("user_id").cast("string")
    stream = F.concat(F.lit('{"event_label": "Hype '), label, F.lit('", "event_type": "Stream Summary", "gem_demand": '), (F.col("user_id") % 11).cast("string"),
        F.lit(', "target_items": "'), label, F.lit('", "confidence_score": '), (F.col("user_id") % 10).cast("string"), F.lit("}"))
    future = F.concat(F.lit('{"event_label": "Next '), user, F.lit('", "event_type": "Roadmap Item", "estimated_date": "2024-03-0'), (F.col("user_id") % 9 + 1).cast("string"), F.lit('"}'))
    is_list = F.col("event_type") != "error"
    raw = F.when(is_list, F.concat(F.lit("```json ["), stream, F.lit(", "), future, F.lit("] ```"))).otherwise(future)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("link"), F.col("event_type").alias("title"), F.to_date("ts").alias("announced"), raw.alias("raw")
    )


def stored_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices already stored: the pages with a secure address."""
    pages = table(spark, sf_dir, "pages").where(F.col("url").startswith("https:"))
    return pages.select(F.col("url").alias("link"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


def notice_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh listing of pages."""
    return fresh_listing(table(spark, sf_dir, "pages"))


def fresh_listing(pages: DataFrame) -> DataFrame:
    """All pages but the German ones already stored, some with a changed title."""
    pages = pages.where(~F.col("html").contains('lang="de"') | ~F.col("url").startswith("https:"))
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    changed = F.when(F.col("url").contains("#"), F.concat(title, F.lit(" (updated)"))).otherwise(title)
    return pages.select(F.col("url").alias("link"), changed.alias("title"))
