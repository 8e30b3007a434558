"""Secrets in texts: certain forms by pattern, weak ones only where the parts of a credential meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventide.session import stage_table

# The certain kinds, and the least length of what each must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Weak kinds: a named account, a mixed run that names nothing, an address of a service.
ACCOUNT = r"""(?i)(?:access_?key_?id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
RUN = "[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?i)(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+|(?:endpoint|host|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,}"""
BLANK = r"\n[\x20\x09\x0D]*\n"

KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": "[0-9a-f]{24,}", "account": ACCOUNT, "run": RUN, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")
ROLE = {"assign": "secret", "hex": "secret", "run": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(finds: DataFrame) -> DataFrame:
    """Matches with code-point starts and ends: running sums of the lengths of gaps and matches."""
    order = Window.partitionBy("row", "kind").orderBy("i")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    parts = finds.select("row", "kind", F.posexplode(F.arrays_zip("gaps", "matches")).alias("i", "p"))
    parts = parts.select("row", "kind", "i", "p.gaps", F.col("p.matches.n").alias("n"), F.col("p.matches.ok").alias("ok"))
    parts = parts.withColumn("start", F.sum("gaps").over(upto) + F.coalesce(F.sum("n").over(before), F.lit(0)))
    return parts.where("ok").select("row", "kind", "start", (F.col("start") + F.col("n")).alias("end"))


def _passes(kind: str, match: Column) -> Column:
    """Whether a match has the length, or for a nameless run the mix of letters and digits, of its kind."""
    if kind == "assign":
        return F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST["assign"]
    if kind == "access":
        return F.char_length(match) >= LEAST["access"]
    if kind == "run":
        return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def _lengths(kind: str, pattern: str) -> Column:
    """What a text's matches of one kind leave of it: lengths of the gaps between them, and of the matches."""
    gaps = F.transform(F.split("body", pattern, -1), lambda gap: F.char_length(gap).cast("long"))
    matches = F.transform(kind, lambda m: F.struct(F.char_length(m).cast("long").alias("n"), _passes(kind, m).alias("ok")))
    return F.when(F.size(kind) > 0, F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), matches.alias("matches")))


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """Weak parts whose complement lies in the same scope and at most ``reach`` code points away.

    Blank lines number the scopes. Parts then meet by an interval join: a weak part, widened by the
    reach, and the others go to the bins of ``reach`` code points that they touch, and bins of one
    scope are joined. Parts of one kind never overlap, so a bin holds a bounded number of them
    however long its text is, and no pair leaves the join: each weak part keeps only which roles it met.
    """
    here = Window.partitionBy("row").orderBy("start", F.col("kind") != "blank")
    parts = parts.withColumn("scope", F.sum((F.col("kind") == "blank").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    # A weak part that touches a certain one adds nothing: starts and ends of certain parts before and after it.
    certain = F.col("kind").isin(*BASE)
    ends = F.max(F.when(certain, F.col("end"))).over(Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    starts = F.min(F.when(certain, F.col("start"))).over(Window.partitionBy("row").orderBy("start").rangeBetween(0, Window.unboundedFollowing))
    parts = parts.withColumn("touches", (F.coalesce(ends, F.lit(-1)) > F.col("start")) | (F.coalesce(starts, F.col("end")) < F.col("end")))
    parts = parts.where(F.col("kind") != "blank").where(certain | ~F.col("touches"))
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair]), F.col("kind"))
    parts = stage_table(parts.select("row", "scope", "kind", "start", "end", role.alias("role")), "parts")

    def bins(by: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col("start") - by) / reach), F.floor((F.col("end") + by) / reach)))

    weak = parts.where(~F.col("kind").isin(*BASE)).withColumn("bin", bins(reach))
    other = parts.select("row", "scope", F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("met"), bins(0).alias("bin"))
    near = ((F.col("s") >= F.col("end")) & (F.col("s") - F.col("end") <= reach)) | ((F.col("start") >= F.col("e")) & (F.col("start") - F.col("e") <= reach))
    met = weak.join(other, ["row", "scope", "bin"]).where(near).groupBy("row", "kind", "start", "end", "role").agg(
        F.max((F.col("met") == "identifier").cast("int")).alias("an_identifier"), F.max((F.col("met") == "secret").cast("int")).alias("a_secret"),
    )
    whole = F.when(F.col("role") == "identifier", F.col("a_secret")).when(F.col("role") == "secret", F.col("an_identifier")).otherwise(F.col("a_secret") * F.col("an_identifier"))
    return met.where(whole == 1).select("row", "kind", "start", "end")


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 400) -> DataFrame:
    """Secrets of each text. One row per input row: ``key``, n_assign, n_access, n_hex, base and spans
    (arrays of kind, start, end by start, then kind; code points, end exclusive).

    Certain kinds are always reported: ``assign`` (a named value), ``access`` (an access identifier),
    ``hex`` (a long hex run). Weak kinds are parts of a credential that prove nothing alone: ``account``
    (a named account), ``run`` (a nameless run of 20 or more letters of either case and digits) and
    ``endpoint`` (an address). A weak part is reported only where its complement lies in the same
    scope, the text between two blank lines, and at most ``reach`` code points away: an account needs a
    secret, a run needs an identifier, an endpoint needs both. Certain parts count as complements; a
    weak part that overlaps a certain one is part of it, and no part completes itself.

    Patterns run in the scan, over whole texts; from there on only lengths and places travel, and only
    for rows that hold a match. A null or empty text has no spans; a very long one is one row of the scan, its
    matches are dealt by place; repeated rows and null or repeated keys are rows of their own; an empty
    table gives no rows; other columns are ignored. DataFrame functions only.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), body.alias("body"))
    found = found.select("row", "key", "body", *[_found(F.col("body"), p).alias(k) for k, p in KINDS.items()])
    held = [F.size(k) > 0 for k in KINDS]
    weak, strong = held[3] | held[4] | held[5], sum((h.cast("int") for h in held[1:]), held[0].cast("int")) > 1
    # Blank lines matter only where a weak part has company.
    found = found.withColumn("blank", F.when(weak & strong, _found(F.col("body"), BLANK)).otherwise(F.array().cast("array<string>")))
    every = {**KINDS, "blank": BLANK}
    finds = [_lengths(kind, pattern) for kind, pattern in every.items()]
    found = stage_table(found.select("row", "key", F.array_compact(F.array(*finds)).alias("finds")), "finds")
    parts = stage_table(_placed(found.where(F.size("finds") > 0).select("row", F.inline("finds"))), "places")
    base = parts.where(F.col("kind").isin(*BASE))
    # Rows without a weak part need no join.
    company = parts.groupBy("row").agg(F.max((~F.col("kind").isin(*BASE, "blank")).cast("int")).alias("w"), F.sum((F.col("kind") != "blank").cast("int")).alias("n"))
    linked = _linked(parts.join(company.where("w = 1 and n > 1").select("row"), "row", "left_semi"), reach)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    both = base.unionByName(linked).select("row", F.struct("start", rank.alias("rank"), "kind", "end").alias("part"), F.col("kind").isin(*BASE).alias("certain"))
    count = [F.count(F.when(F.col("part.kind") == k, 1)).alias(f"n_{k}") for k in BASE]
    spans = F.array_sort(F.collect_list("part"))
    sure = F.array_sort(F.collect_list(F.when(F.col("certain"), F.col("part"))))
    per_row = both.groupBy("row").agg(*count, sure.alias("base"), spans.alias("spans"))
    plain = "array<struct<kind:string,start:bigint,end:bigint>>"

    def shown(name: str) -> Column:
        return F.coalesce(F.transform(name, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), F.array().cast(plain)).alias(name)

    return found.select("row", "key").join(per_row, "row", "left").select(
        F.col("key").alias(key), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], shown("base"), shown("spans")
    )
