"""Event and post enrichment: flags, scores, matching, stored model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide import fixed_values as fixed
from eventide.functions.columns import contains_any, lower_all
from eventide.schemas import REACTION


def event_flags(
    events: DataFrame,
    text_col: str,
    sentiment_col: str | None = None,
    flags: dict[str, list[str]] = fixed.EVENT_FLAGS,
) -> DataFrame:
    """0/1 keyword flags and the sentiment as 1, 0 or -1; unknown sentiment is 0."""
    text = F.col("lower_text")
    out = {name: contains_any(text, lower_all(words)).cast("int") for name, words in flags.items()}
    if sentiment_col is not None:
        code = F.lit(0)
        for label, value in fixed.SENTIMENT.items():
            code = F.when(F.col(sentiment_col) == label, value).otherwise(code)
        out["sentiment_score"] = code
    return events.withColumn("lower_text", F.lower(text_col)).withColumns(out).drop("lower_text")


def content_filter(
    notices: DataFrame, types: list[str] = fixed.SCORED_TYPES, min_length: int = fixed.MIN_CONTENT_LENGTH
) -> DataFrame:
    """Notices of the scored types that carry real content."""
    content = F.col("content")
    return notices.where(
        F.col("event_type").isin(types) & (F.length(content) >= min_length) & (content != fixed.MISSING_CONTENT)
    )


def broadcast_filter(
    notices: DataFrame,
    title_col: str = "title",
    words: list[str] = fixed.BROADCAST_WORDS,
    excluded: list[str] = fixed.BROADCAST_EXCLUDED,
    since: str | None = None,
    date_col: str = "date",
) -> DataFrame:
    """Broadcast notices: any of the words, none of the excluded ones, from a day on."""
    title = F.col(title_col)
    kept = notices.where(contains_any(title, words) & ~contains_any(title, excluded))
    return kept if since is None else kept.where(F.col(date_col) >= F.lit(since).cast("date"))


def title_score(
    text: Column,
    stream_words: list[str] = fixed.POST_STREAM_WORDS,
    type_words: list[str] = fixed.POST_TYPE_WORDS,
    bonus: dict[str, int] = fixed.POST_BONUS,
) -> Column:
    """100 when both a stream word and a type word occur, plus bonuses; else 0.

    ``text`` is in lower case.
    """
    passed = contains_any(text, lower_all(stream_words)) & contains_any(text, lower_all(type_words))
    points = F.lit(100)
    for word, extra in bonus.items():
        points = points + F.when(contains_any(text, [word.lower()]), extra).otherwise(0)
    return F.when(passed, points).otherwise(0)


def post_score(
    posts: DataFrame,
    priority_author: str,
    text_col: str = "title",
    content_col: str = "content",
    min_length: int = fixed.MIN_POST_LENGTH,
    **words,
) -> DataFrame:
    """Scores of posts, and whether a post is a candidate.

    Posts of the priority author always pass and outrank all others.
    """
    is_priority = F.col("author") == priority_author
    length = F.length(content_col)
    base = title_score(F.col("lower_text"), **words)
    base = F.when(is_priority, F.greatest(base, F.lit(100))).otherwise(base)
    score = F.col("reco") * 0.5 + F.col("title_score") + F.when(is_priority, fixed.PRIORITY_BONUS).otherwise(0)
    return (
        posts.withColumn("lower_text", F.lower(text_col))
        .withColumn("title_score", base)
        .drop("lower_text")
        .withColumn("score", score)
        .withColumn("legacy_score", F.col("reco") * 0.5 + length * 0.2)
        .withColumn("is_candidate", (F.col("title_score") >= 100) & (is_priority | (length >= min_length)))
    )


_MINUTE = 60_000_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _minute(ts: Column) -> Column:
    return F.floor(_micros(ts) / _MINUTE)


def _best_score() -> Column:
    return F.struct(F.col("score").cast("double").alias("score"), (-F.col("link")).alias("neg_link"))


def _best_at_edges(candidates: DataFrame, wanted: DataFrame, time: str, reach: int, span: int) -> DataFrame:
    """Best candidate from ``reach`` before each wanted time to the end of that block of ``span``, or
    from the start of the block ``reach`` after it up to there. Running maxima over the distinct times
    of a block: each row is looked at once, and no post is ever paired with a broadcast."""
    best_type = "struct<score: double, neg_link: bigint>"
    posts = candidates.groupBy(F.col(time).alias("place")).agg(F.max(_best_score()).alias("best")).select(
        "place", "best", F.lit(None).cast("bigint").alias(time), F.lit(False).alias("is_start")
    )
    edges = F.array(
        F.struct((F.col(time) - reach).alias("place"), F.lit(True).alias("is_start")),
        F.struct((F.col(time) + reach).alias("place"), F.lit(False).alias("is_start")),
    )
    asked = wanted.select(time).distinct().select(time, F.inline(edges)).select(
        "place", F.lit(None).cast(best_type).alias("best"), time, "is_start"
    )
    rows = posts.unionByName(asked).withColumn("block", F.floor(F.col("place") / span))
    block = Window.partitionBy("block")
    to_end, from_start = F.max("best").over(block.orderBy(F.desc("place"))), F.max("best").over(block.orderBy("place"))
    return (
        rows.withColumn("found", F.when(F.col("is_start"), to_end).otherwise(from_start))
        .where(F.col(time).isNotNull() & F.col("found").isNotNull())
        .groupBy(time)
        .agg(F.max("found").alias("found"))
        .select(time, (-F.col("found.neg_link")).alias("link"), F.col("found.score").alias("score"))
    )


def best_post_by_minute(candidates: DataFrame, wanted: DataFrame, window_minutes: int = 24 * 60) -> DataFrame:
    """Best candidate within the window of whole minutes around each wanted minute.

    Posts are reduced to the best one of each minute; what remains is bounded
    by the clock. The time line is cut into blocks as long as the window, so
    any window is the end of one block plus the start of the next.
    """
    return _best_at_edges(candidates, wanted, "minute", window_minutes, 2 * window_minutes + 1)


def best_post(
    broadcasts: DataFrame, candidates: DataFrame, manual: DataFrame | None = None, window_minutes: int = 24 * 60
) -> DataFrame:
    """The post that best sums up each broadcast; a manual link beats all.

    ``broadcasts`` has ``ts``, ``candidates`` has ``ts``, ``link`` and ``score``,
    ``manual`` has ``target_date`` and ``manual_link``. Broadcasts without a
    post drop out. Times are exact: the whole minutes inside the window (at
    least a minute long) come from the best post of each minute, and the two
    minutes cut by its ends from the distinct times in them.
    """
    shows = broadcasts.withColumns({"at": _micros(F.col("ts")), "minute": _minute(F.col("ts")), "target_date": F.to_date("ts")})
    times = candidates.groupBy(_micros(F.col("ts")).alias("at")).agg(F.max(_best_score()).alias("b"))
    posts = times.select(
        "at", F.floor(F.col("at") / _MINUTE).alias("minute"), (-F.col("b.neg_link")).alias("link"), F.col("b.score").alias("score")
    )
    inside = best_post_by_minute(posts, shows, window_minutes - 1).select("minute", _best_score().alias("inside"))
    at_ends = _best_at_edges(posts, shows, "at", window_minutes * _MINUTE, _MINUTE).select("at", _best_score().alias("at_ends"))
    best = F.greatest("inside", "at_ends")
    out = shows.join(inside, "minute", "left").join(at_ends, "at", "left")
    out = out.withColumns({"link": -best["neg_link"], "score": best["score"]}).drop("inside", "at_ends", "at")
    if manual is not None:
        is_manual = F.col("manual_link").isNotNull()
        out = (
            out.join(manual, "target_date", "left")
            .withColumn("link", F.coalesce("manual_link", "link"))
            .withColumn("score", F.when(is_manual, float(fixed.PRIORITY_BONUS)).otherwise(F.col("score")))
            .withColumn("origin", F.when(is_manual, "manual").otherwise("board"))
            .drop("manual_link")
        )
    else:
        out = out.withColumn("origin", F.lit("board"))
    return out.where(F.col("link").isNotNull()).drop("minute")


def recent_context(days: DataFrame, posts: DataFrame, look_back: int = 60, top: int = 3) -> DataFrame:
    """Text of the latest posts up to midnight of each day.

    ``days`` has distinct ``date`` values. Only the latest posts of a day can
    be among the latest of any later day, so each day keeps ``top`` posts (the
    ranking is cut per task before its shuffle) and spreads those over the
    days that look back on it.
    """
    seen = posts.select(
        "ts", "link", "title", "score", F.to_date("ts").alias("posted"),
        (F.date_trunc("day", F.col("ts")) == F.col("ts")).alias("at_midnight"),
    )
    newest = [F.desc("ts"), F.asc("link")]
    per_day = Window.partitionBy("posted", "at_midnight").orderBy(*newest)
    kept = seen.withColumn("place", F.row_number().over(per_day)).where(F.col("place") <= top)
    visible_from = F.when(F.col("at_midnight"), F.col("posted")).otherwise(F.date_add("posted", 1))
    spread = kept.withColumn("date", F.explode(F.sequence(visible_from, F.date_add("posted", look_back))))
    per_date = Window.partitionBy("date").orderBy(*newest)
    line = F.format_string(
        "- [%s] %s (Score: %s)", F.date_format("ts", "yyyy-MM-dd"), F.col("title"), F.col("score").cast("string")
    )
    lines = (
        spread.join(days, "date", "left_semi")
        .withColumn("place", F.row_number().over(per_date))
        .where(F.col("place") <= top)
        .groupBy("date")
        .agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    )
    return lines.select("date", F.array_join(F.col("lines.line"), "\n").alias("context"))


def nearest_by_date(summaries: DataFrame, reach: int = 1) -> DataFrame:
    """For each date in reach of a summary, the closest summary.

    One summary per date is kept first, so the result has at most
    ``2 * reach + 1`` rows per summary date. An exact date beats a
    neighbour, then the earlier date and the lower id win.
    """
    per_date = summaries.groupBy(F.col("date").alias("summary_date")).agg(F.min("summary_id").alias("summary_id"))
    spread = per_date.select(
        "summary_date",
        "summary_id",
        F.explode(F.sequence(F.date_sub("summary_date", reach), F.date_add("summary_date", reach))).alias("date"),
    ).withColumn("diff_days", F.datediff("summary_date", "date"))
    best = F.min(F.struct(F.abs("diff_days"), F.col("diff_days"), F.col("summary_id"), F.col("summary_date")))
    return spread.groupBy("date").agg(best.alias("b")).select("date", "b.summary_id", "b.summary_date", "b.diff_days")


def keyword_override(
    events: DataFrame,
    content_col: str = "content",
    supply_words: list[str] = fixed.SUPPLY_WORDS,
    demand_words: list[str] = fixed.DEMAND_WORDS,
) -> DataFrame:
    """Weak scores become 8 when the notice holds a trigger word; each change is tagged.

    The whole notice is searched.
    """
    out = events
    for score, words, tag in [
        ("honing_mat_supply", supply_words, fixed.SUPPLY_TAG),
        ("honing_mat_demand", demand_words, fixed.DEMAND_TAG),
    ]:
        current = F.coalesce(F.col(score), F.lit(0))
        hit = contains_any(F.col(content_col), words) & (current < 5)
        out = out.withColumns(
            {
                score: F.when(hit, F.lit(8)).otherwise(current),
                "mechanisms_applied": F.when(
                    hit, F.concat(F.coalesce("mechanisms_applied", F.lit("")), F.lit(tag))
                ).otherwise(F.col("mechanisms_applied")),
            }
        )
    return out


def target_item_filter(
    events: DataFrame,
    tradeable: DataFrame,
    key: str,
    list_col: str = "target_items",
    forbidden: list[str] = fixed.FORBIDDEN_ITEM_WORDS,
) -> DataFrame:
    """Comma lists reduced to tradeable items; nothing left reads 'None'.

    ``tradeable`` has the known items as ``item``. Every event keeps a row.
    Empty and forbidden pieces go before the join, and only hits are grouped.
    """
    parts = F.transform(F.split(F.coalesce(F.col(list_col), F.lit("")), ","), lambda p: F.trim(p))
    exploded = events.select(key, F.posexplode(parts).alias("pos", "item"))
    allowed = (F.col("item") != "") & ~contains_any(F.col("item"), forbidden)
    known = tradeable.select("item").distinct()
    kept = F.sort_array(F.collect_list(F.struct("pos", "item")))
    hits = exploded.where(allowed).join(known, "item").groupBy(key).agg(kept.alias("kept"))
    return events.select(key).distinct().join(hits, key, "left").select(
        key,
        F.when(F.col("kept").isNotNull(), F.size("kept")).otherwise(0).alias("n_items"),
        F.coalesce(F.array_join(F.col("kept.item"), ", "), F.lit("None")).alias("target_items"),
    )


def json_block(raw: Column) -> Column:
    """First object or list in a model response, without code fences."""
    plain = F.replace(F.replace(raw, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return F.regexp_substr(plain, F.lit(fixed.JSON_BLOCK))


def json_landing(responses: DataFrame, scores: list[str] = fixed.EVENT_SCORES, raw_col: str = "raw") -> DataFrame:
    """Stored responses to typed event fields with defaults.

    A response without readable JSON keeps its row: scores 0 and 'Error' as
    the reasoning.
    """
    text_fields = {
        "package_category": "None", "trajectory_pattern": "general_update", "target_items": "None",
        "mechanisms_applied": "None", "announcement_date": "None", "is_pre_announced": "false",
    }
    number_fields = [*scores, "confidence_score"]
    schema = T.StructType(
        [T.StructField(f, T.StringType()) for f in [*number_fields, *text_fields, "_corrupt_record"]]
    )
    parsed = responses.withColumn(
        "p", F.from_json(json_block(F.col(raw_col)), schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    )
    failed = F.col("p").isNull() | F.col("p._corrupt_record").isNotNull()

    def text(name: str, default: str) -> Column:
        fallback = F.when(failed & (F.lit(name) == "mechanisms_applied"), "Error").otherwise(default)
        return F.coalesce(F.when(~failed, F.col(f"p.{name}")), fallback).alias(name)

    numbers = [
        F.coalesce(F.when(~failed, F.col(f"p.{f}").try_cast("int")), F.lit(0)).alias(f) for f in number_fields
    ]
    texts = [text(n, d) for n, d in text_fields.items()]
    rest = [c for c in responses.columns if c != raw_col]
    return parsed.select(*rest, *numbers, *texts, failed.alias("parse_error"))


def reaction_landing(responses: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Stored reaction responses to their eight typed fields.

    A response without readable JSON keeps its row: no fields, a mark and its raw text.
    """
    schema = T.StructType([*REACTION.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = responses.withColumn(
        "p", F.from_json(json_block(F.col(raw_col)), schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    )
    failed = F.col("p").isNull() | F.col("p._corrupt_record").isNotNull()
    fields = [F.when(~failed, F.col(f"p.{f.name}")).alias(f.name) for f in REACTION.fields]
    rest = [c for c in responses.columns if c != raw_col]
    return parsed.select(*rest, *fields, failed.alias("parse_error"), F.when(failed, F.col(raw_col)).alias("raw_response"))


ROADMAP_TEXTS = {
    "package_category": "None", "trajectory_pattern": "general_update", "target_items": "None", "mechanisms_applied": "Analysis",
}
ROADMAP_SCHEMA = T.ArrayType(
    T.StructType(
        [T.StructField(f, T.StringType()) for f in ["event_label", "estimated_date", "event_type", *ROADMAP_TEXTS]]
        + [T.StructField(s, T.IntegerType()) for s in [*fixed.EVENT_SCORES, "confidence_score"]]
    )
)


def roadmap_explode(responses: DataFrame, raw_col: str = "raw", scores: list[str] = fixed.EVENT_SCORES) -> DataFrame:
    """Roadmap responses to one event row per element; a lone object counts as a list.

    ``responses`` has ``link``, the broadcast notice's ``title`` and the
    broadcast day ``announced``. Only roadmap items count as announced in
    advance.
    """
    block = json_block(F.col(raw_col))
    as_list = F.when(block.startswith("{"), F.concat(F.lit("["), block, F.lit("]"))).otherwise(block)
    exploded = responses.select(
        "link", "title", "announced", F.posexplode(F.from_json(as_list, ROADMAP_SCHEMA)).alias("pos", "e")
    )
    label = F.coalesce(F.col("e.event_label"), F.col("title"))
    kind = F.coalesce(F.col("e.event_type"), F.lit("Stream Summary"))
    return exploded.select(
        "link",
        "pos",
        F.coalesce(F.col("e.estimated_date").try_cast("date"), F.col("announced")).alias("date"),
        kind.alias("event_type"),
        F.format_string("[%s] %s", F.coalesce(F.col("e.event_type"), F.lit("Event")), label).alias("title"),
        (kind == "Roadmap Item").alias("is_pre_announced"),
        F.col("announced").alias("announcement_date"),
        *[F.coalesce(F.col(f"e.{s}"), F.lit(0)).alias(s) for s in [*scores, "confidence_score"]],
        *[F.coalesce(F.col(f"e.{name}"), F.lit(default)).alias(name) for name, default in ROADMAP_TEXTS.items()],
    )


def json_profile(docs: DataFrame, json_col: str) -> DataFrame:
    """Keys of flat JSON objects with counts and numeric range."""
    entries = F.explode(F.from_json(F.col(json_col), "map<string, string>"))
    number = F.col("value").try_cast("double")
    return (
        docs.select(entries)
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(number).alias("n_numeric"),
            F.min(number).alias("min_value"),
            F.max(number).alias("max_value"),
        )
    )


def news_alerts(notices: DataFrame, threshold: int = fixed.ALERT_SCORE) -> DataFrame:
    """First sighting of each notice, kept when its importance reaches the threshold."""
    first = F.min(F.struct("ts", "score")).alias("first")
    return notices.groupBy("notice_id").agg(first).select("notice_id", "first.ts", "first.score").where(F.col("score") >= threshold)
