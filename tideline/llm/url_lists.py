"""URL filter lists joined as of the time of fetching.

Dated list entries (block, allow, remove) become validity intervals, and every capture is held against the entries that were
active on its day. A capture is looked up by its page, its first path folder, its host and every parent domain of two labels or
more; of the active entries the most specific one decides.

Intervals are cut at month borders, so the join key is (kind, pattern, month): a host with a third of all captures is spread over
months, a key holds at most a month of intervals, and Spark may split the captures of a hot key because no order or grouping is
asked of the join. Texts and pages are not carried.

Null or unparsable urls and null days match nothing and are kept. Of several entries for one pattern on one day the strictest
holds (block before allow before remove). Repeated captures give a row each. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

#: How specific a kind is; a longer parent domain is more specific than a shorter one.
PAGE, FOLDER, HOST, DOMAIN = 4000, 3000, 2000, 1000
STRICTNESS = {"remove": 0, "allow": 1, "block": 2}


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def folder_of(url: Column) -> Column:
    """Host and first path folder; null if the path has none."""
    first = F.regexp_extract(path_of(url), r"^/([^/]+)", 1)
    return F.when(first != "", F.concat(host_of(url), F.lit("/"), first))


def page_of(url: Column) -> Column:
    """Host and path, without query and fragment."""
    return F.concat(host_of(url), path_of(url))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of at least two labels, longest first."""
    labels = F.split(host, r"\.")
    many = F.size(labels)
    return F.when(many >= 2, F.transform(F.sequence(F.lit(1), many - 1), lambda i: F.array_join(F.slice(labels, i, many - i + 1), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals [``valid_from``, ``valid_to``) of ``kind, pattern, action, on_date`` rows; an open end is null.

    One row per pattern and day reaches the window, so a pattern's entries there are bounded by the calendar.
    """
    rank = F.coalesce(*[F.when(F.col("action") == a, F.lit(r)) for a, r in STRICTNESS.items()])
    usable = entries.filter(F.col("pattern").isNotNull() & F.col("on_date").isNotNull() & F.col("action").isin(*STRICTNESS))
    daily = usable.groupBy("kind", "pattern", "on_date").agg(F.max(rank).alias("_rank"))
    order = W.partitionBy("kind", "pattern").orderBy("on_date")
    changes = daily.withColumn("_before", F.lag("_rank").over(order)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("_rank")))
    spans = changes.withColumn("valid_to", F.lead("on_date").over(order)).filter(F.col("_rank") > 0)
    action = F.when(F.col("_rank") == STRICTNESS["block"], "block").otherwise("allow")
    return spans.select("kind", "pattern", action.alias("action"), F.col("on_date").alias("valid_from"), "valid_to")


def lookups(captures: DataFrame, url_col: str, day_col: str) -> DataFrame:
    """One row per capture and pattern that could cover it; ``_capture`` tells captures apart."""
    url = F.col(url_col)
    host = host_of(url)

    def key(kind, pattern, level):
        return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(level).alias("level") if isinstance(level, int) else level.alias("level"))

    parents = F.transform(domains_of(host), lambda d: key("domain", d, F.lit(DOMAIN) + F.size(F.split(d, r"\."))))
    nothing = F.expr("cast(array() as array<struct<kind:string,pattern:string,level:int>>)")
    keys = F.concat(F.array(key("page", page_of(url), PAGE), key("folder", folder_of(url), FOLDER), key("host", host, HOST)), F.coalesce(parents, nothing))
    rows = captures.withColumn("_key", F.explode(F.filter(keys, lambda k: k["pattern"].isNotNull())))
    return rows.select("_capture", F.col(day_col).alias("_day"), "_key.kind", "_key.pattern", "_key.level")


def by_month(spans: DataFrame, last_day: Column) -> DataFrame:
    """Intervals once for each month they touch, up to the last day that is asked for."""
    end = F.coalesce(F.date_sub("valid_to", 1), last_day)
    first = F.trunc("valid_from", "month")
    months = F.when(end >= F.col("valid_from"), F.sequence(first, F.trunc(end, "month"), F.expr("interval 1 month")))
    return spans.withColumn("_month", F.explode(months))


def verdicts(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, day_col: str) -> DataFrame:
    """Every capture with the entry that decides it: id, url, day, ``n_active``, ``kind``, ``pattern``, ``action``, ``since`` and ``kept``."""
    asked = captures.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{day_col}`").alias("_on"))
    asked = asked.withColumn("_capture", F.struct("_id", "_url", "_on"))
    last = asked.agg(F.max("_on")).first()[0]
    distinct = asked.filter(F.col("_on").isNotNull()).select("_capture", "_url", "_on")
    spans = by_month(intervals(entries), F.lit(last).cast("date"))
    wanted = lookups(distinct, "_url", "_on").withColumn("_month", F.trunc("_day", "month"))
    inside = (F.col("valid_from") <= F.col("_day")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))
    hits = wanted.join(spans, ["kind", "pattern", "_month"]).filter(inside)
    missing = F.lit(None)
    every = hits.select("_capture", F.struct("level", "kind", "pattern", "action", F.col("valid_from").alias("since")).alias("_hit")).unionByName(
        asked.select("_capture", missing.cast("struct<level:int,kind:string,pattern:string,action:string,since:date>").alias("_hit"), F.lit(1).alias("_row")), allowMissingColumns=True
    )
    best = every.groupBy("_capture").agg(F.sum("_row").alias("_rows"), F.count("_hit").alias("_hits"), F.max("_hit").alias("_best"))
    rows = best.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    kept = F.coalesce(F.col("_best.action") != "block", F.lit(True))
    return rows.select(
        F.col("_capture._id").alias(id_col), F.col("_capture._url").alias(url_col), F.col("_capture._on").alias(day_col),
        F.expr("_hits div _rows").alias("n_active"), "_best.kind", "_best.pattern", "_best.action", "_best.since", kept.alias("kept"),
    )
