"""Facts from text: notice listings, page text, broadcast times, years of listed dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide import fixed_values as fixed
from eventide.functions.columns import strip_tags, text_lines, year_near
from eventide.session import stage_table


def _group_or(text: Column, pattern: str, group: int, placeholder: str | None) -> Column:
    found = F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, group)))
    return found if placeholder is None else F.coalesce(found, F.lit(placeholder))


def notice_rows(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Notice listing rows from raw pages: id, title, category, date, pinned.

    Each page is searched once; the parts come from its rows. Missing parts
    get placeholders; a dotted date becomes ISO, any other text stays as it is.
    """
    rows = F.regexp_extract_all(F.col(html_col), F.lit(fixed.NOTICE_ROW), F.lit(0))
    listed = pages.select(*(keep or []), F.posexplode(rows).alias("pos", "row")).withColumn(
        "body", F.regexp_extract("row", fixed.NOTICE_ROW, 2)
    )
    body = F.col("body")
    shown_date = _group_or(body, fixed.NOTICE_DATE, 1, "Unknown Date")
    iso = F.date_format(F.try_to_timestamp(shown_date, F.lit("yyyy.MM.dd")), "yyyy-MM-dd")
    return listed.where(body.rlike(fixed.NOTICE_ID)).select(
        *(keep or []),
        "pos",
        F.regexp_extract(body, fixed.NOTICE_ID, 1).alias("notice_id"),
        _group_or(body, fixed.NOTICE_TITLE, 1, "Unknown Title").alias("title"),
        _group_or(body, fixed.NOTICE_CATEGORY, 1, "General").alias("category"),
        F.coalesce(iso, shown_date).alias("date"),
        F.lower(F.regexp_extract("row", fixed.NOTICE_ROW, 1)).contains("noti").alias("is_pinned"),
    )


def latest_notice(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """The top notice of each listing page."""
    return rows.groupBy(key).agg(F.min_by(F.struct("notice_id", "title"), "pos").alias("n")).select(key, "n.*")


def listing_links(pages: DataFrame, row_pattern: str, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every list entry of a page: position, address and label.

    The pattern has the address in group 1 and the label in group 2.
    """
    rows = F.regexp_extract_all(F.col(html_col), F.lit(row_pattern), F.lit(0))
    return pages.select(key, F.posexplode(rows).alias("pos", "row")).select(
        key,
        "pos",
        F.regexp_extract("row", row_pattern, 1).alias("href"),
        strip_tags(F.regexp_extract("row", row_pattern, 2)).alias("label"),
    )


def page_text(
    pages: DataFrame,
    title_pattern: str = r"(?s)<title>.*?</title>",
    body_pattern: str = r"(?s)<article>.*?</article>",
    key: str = "page_id",
    html_col: str = "html",
    keep: list[str] | None = None,
) -> DataFrame:
    """Title and main content as text, with placeholders for what is missing.

    The patterns match whole elements; their own tags go with all others.
    """
    text = F.col(html_col)
    title = strip_tags(F.regexp_substr(text, F.lit(title_pattern)))
    body = text_lines(F.regexp_substr(text, F.lit(body_pattern)))
    return pages.select(
        key,
        *(keep or []),
        F.coalesce(title, F.lit("Unknown Title")).alias("title"),
        F.coalesce(body, F.lit(fixed.MISSING_CONTENT)).alias("content"),
    )


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _build_ts(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    return F.try_make_timestamp_ntz(year, month, day, hour, minute, F.lit(0))


def broadcast_times(df: DataFrame, text_col: str, anchor_col: str) -> DataFrame:
    """Start time announced in a text, as ``starts_at``; three notations in order of priority.

    A notation that matches decides alone, so impossible parts give null. The
    year of the anchor date fills in for a missing one. Each notation is
    searched once; its parts are then read from the short match.
    """
    text = F.replace(F.col(text_col), F.lit("\n"), F.lit(" "))
    patterns = [fixed.BROADCAST_TIME_DOTTED, fixed.BROADCAST_TIME_KOREAN, fixed.BROADCAST_TIME_SLASHED]
    found = df.withColumns({f"hit_{k}": F.regexp_substr(text, F.lit(p)) for k, p in enumerate(patterns)})
    anchor = F.col(anchor_col)

    def part(k: int, group: int) -> Column:
        return _part(F.col(f"hit_{k}"), patterns[k], group)

    from_dotted = _build_ts(*[part(0, g) for g in range(1, 6)])

    month, day, hour = part(1, 2), part(1, 3), part(1, 5)
    half = F.regexp_extract("hit_1", patterns[1], 4)
    hour24 = (
        F.when((half == fixed.AFTERNOON) & (hour < 12), hour + 12)
        .when((half == fixed.MORNING) & (hour == 12), F.lit(0))
        .otherwise(hour)
    )
    from_korean = _build_ts(F.coalesce(part(1, 1), year_near(anchor, month)), month, day, hour24, F.lit(0))

    month, day, hour, minute = [part(2, g) for g in range(1, 5)]
    from_slashed = _build_ts(year_near(anchor, month), month, day, hour, minute)

    starts_at = (
        F.when(F.col("hit_0").isNotNull(), from_dotted)
        .when(F.col("hit_1").isNotNull(), from_korean)
        .when(F.col("hit_2").isNotNull(), from_slashed)
    )
    return found.withColumn("starts_at", starts_at).drop("hit_0", "hit_1", "hit_2")


def post_date(shown: Column, year: Column, crawled_at: Column) -> Column:
    """Date of a listed post: 'HH:mm' is the crawl day, 'MM-dd' takes ``year``, else ISO."""
    clock = r"^\d{1,2}:\d{2}$"
    month_day = r"^(\d{2})-(\d{2})$"
    return (
        F.when(shown.rlike(clock), F.to_date(crawled_at))
        .when(
            shown.rlike(month_day),
            F.to_date(
                F.try_make_timestamp_ntz(
                    year, _part(shown, month_day, 1), _part(shown, month_day, 2), F.lit(0), F.lit(0), F.lit(0)
                )
            ),
        )
        .otherwise(shown.try_cast("date"))
    )


def board_years(
    listing: DataFrame, anchor_year: Column, block_rows: int | None = None, order: list[str] = ("pos",), block: Column | None = None
) -> DataFrame:
    """Years of 'MM-dd' dates in a listing that runs from new to old.

    ``order`` names the columns that give the place in the listing, unique per
    board. Going down the list, a month-day later than the last one before it
    means a year boundary was crossed; the year is the anchor's minus the
    boundaries so far. Other notations (clock times, full dates) say nothing
    about the year and are passed over.

    The running count is taken in two levels, so no task holds a whole board:
    within blocks, then over one summary row per block and board. By default the rows are
    dealt by range of board and place, whatever gaps the places have, and a block is one such
    partition; a board of a third of all rows spreads over a third of them. ``block_rows``
    takes blocks of so many places of ``pos`` instead, ``block`` any number that does not fall along the order.
    """
    day = F.when(F.col("month_day").rlike(r"^\d{2}-\d{2}$"), F.col("month_day"))
    rows = listing.withColumn("listed_day", day)
    if block is not None or block_rows is not None:
        rows = rows.withColumn("block", F.floor(F.col("pos") / block_rows) if block is None else block)
    else:
        ranged = rows.repartitionByRange("board", *order).withColumn("block", F.spark_partition_id())
        rows = stage_table(ranged, "listing-ranges")
    in_block = Window.partitionBy("board", "block").orderBy(*order)
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    crossed = F.coalesce((F.col("listed_day") > F.last("listed_day", ignorenulls=True).over(earlier)).cast("int"), F.lit(0))
    rows = rows.withColumn("crossed", crossed)

    place = F.when(F.col("listed_day").isNotNull(), F.struct(*order))
    blocks = rows.groupBy("board", "block").agg(
        F.sum("crossed").alias("inside"),
        F.min_by("listed_day", place).alias("head"),
        F.max_by("listed_day", place).alias("tail"),
    )
    by_board = Window.partitionBy("board").orderBy("block")
    last_tail = F.last("tail", ignorenulls=True).over(by_board.rowsBetween(Window.unboundedPreceding, -1))
    at_border = F.coalesce((F.col("head") > last_tail).cast("int"), F.lit(0))
    before = by_board.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (
        blocks.withColumn("at_border", at_border)
        .withColumn("offset", F.sum(F.col("at_border") + F.col("inside")).over(before) - F.col("inside"))
        .select("board", "block", "offset")
    )
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("local", F.sum("crossed").over(so_far))
        .join(offsets, ["board", "block"])
        .withColumn("year", (anchor_year - F.col("local") - F.col("offset")).cast("int"))
        .drop("block", "listed_day", "crossed", "local", "offset")
    )


def page_date_spans(dated: DataFrame) -> DataFrame:
    """Newest and oldest date of each listing page."""
    return dated.groupBy("board", "page").agg(
        F.max("post_date").alias("latest"), F.min("post_date").alias("oldest"), F.count(F.lit(1)).alias("posts")
    )
