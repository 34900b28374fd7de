"""Cost, health, usage, coverage and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions.numeric import decade
from kelpgrid.functions.vector import only_row
from kelpgrid.operators.order import percentiles

# What the event types stand for.
STATUS = {"signup": "started", "purchase": "completed", "error": "failed"}
FEEDBACK = {"click": "like", "view": "save", "error": "dislike"}


def mapped(column: str, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)]


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 part / whole, rounded; null if there is no whole."""
    return F.round(F.when(whole != 0, 100.0 * part / whole), digits)


def cost_rollup(calls: DataFrame, as_of: str) -> DataFrame:
    """Cost in all, today, in 7 days and projected for 30, in total and by each of two keys, in one pass of grouping sets."""
    at = F.lit(as_of).cast("timestamp_ntz")
    within = lambda days: F.sum(F.when(F.col("ts") >= at - F.make_dt_interval(F.lit(days)), F.col("cost")).otherwise(0.0))
    sums = [F.round(F.sum("cost"), 4).alias("total"), F.round(within(1), 4).alias("day"), F.round(within(7), 4).alias("week"), F.round(within(7) / 7 * 30, 4).alias("month")]
    sets = calls.groupingSets([[F.col("operation")], [F.col("model")], []], "operation", "model")
    return sets.agg(*sums, F.grouping_id().cast("int").alias("level"))


def budget(spent: Column, limit: float, days_gone: int, days: int) -> dict[str, Column]:
    """Money left, percent used, daily burn, and days until it is gone (null if nothing burns)."""
    burn = spent / days_gone
    return {"remaining": F.round(limit - spent, 4), "pct": F.round(100.0 * spent / limit, 4), "burn": F.round(burn, 4), "eta_days": F.round(F.when(burn > 0, (limit - spent) / burn), 4)}


def call_price(rates: DataFrame, calls: DataFrame) -> DataFrame:
    """``usd`` of every call: fresh input, cache reads at a tenth, cache writes at five quarters, thinking as output; unknown models cost 0."""
    fresh = F.greatest(F.lit(0), F.col("tokens_in") - F.col("cache_read") - F.col("cache_write"))
    usd = (fresh * F.col("rate_in") + F.col("cache_read") * F.col("rate_in") * 0.1 + F.col("cache_write") * F.col("rate_in") * 1.25 + (F.col("tokens_out") + F.col("thinking")) * F.col("rate_out")) / 1e6
    return calls.join(rates, "model", "left").withColumn("usd", F.round(F.coalesce(usd, F.lit(0.0)), 6)).drop("rate_in", "rate_out")


def completion_health(events: DataFrame, by: str) -> DataFrame:
    """Attempts, successes and latency percentiles: attempts are starts, or else the ends."""
    n = lambda s: F.count_if(F.col("status") == s)
    grouped = events.groupBy(by).agg(n("started").alias("started"), n("completed").alias("completed"), n("failed").alias("failed"))
    done = percentiles(events.where("status = 'completed'").select(by, "latency"), [by], "latency", {"p50": 0.5, "p95": 0.95})
    done = done.select(F.col(by).alias("by_"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    grouped = grouped.join(done, F.col(by).eqNullSafe(F.col("by_")), "left").drop("by_")
    attempts = F.when(F.col("started") > 0, F.col("started")).otherwise(F.col("completed") + F.col("failed"))
    return grouped.withColumn("attempts", attempts).withColumn("success", F.round(F.when(F.col("attempts") > 0, F.col("completed") / F.col("attempts")), 6))


def floor_percentile(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """The value at floor(p (n - 1)) of each group's values in order."""
    return percentiles(rows, [by], value, {"value_": p}, interpolated=False).select(by, F.col("value_").alias("value"), "n")


def event_matrix(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)


def day_activity(events: DataFrame, day: str, top: int = 4) -> DataFrame:
    """``user_id, first_ts, summary``: each user's first event of a day and the most frequent types as 'type×n'."""
    today = events.where(F.to_date("ts") == F.lit(day).cast("date"))
    counts = today.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))
    marked = counts.withColumn("nth", nth)
    said = F.when(F.col("nth") <= top, F.struct("nth", F.concat_ws("×", "event_type", F.col("n").cast("string")).alias("s")))
    return marked.groupBy("user_id").agg(F.min("first_ts").alias("first_ts"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x.s), ", ").alias("summary"))


def daily_usage(events: DataFrame) -> DataFrame:
    """``user_id, total, days, series``: each user's events by day, latest first."""
    daily = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    series = F.transform(F.sort_array(F.collect_list(F.struct("day", "n")), asc=False), lambda x: F.concat_ws(":", x.day.cast("string"), x.n.cast("string")))
    return daily.groupBy("user_id").agg(F.sum("n").alias("total"), F.count("*").alias("days"), F.array_join(series, ",").alias("series"))


def rate(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.agg(F.round(F.avg(F.col("event_type").isin(*kinds).cast("double")), 6).alias("rate"), F.count("*").alias("n"))


def sms_band(level: Column) -> Column:
    return F.when(level == 0, "0").when(level.isin(1, 2), "1-2").when(level == 3, "3").when(level.isin(4, 5), "4-5").otherwise("other")


def evidence_distribution(works: DataFrame, by: str, now: int) -> DataFrame:
    """Counts by level band, region, age and citations, and the rounded median year, of each group."""
    band = lambda b: F.count_if(sms_band(F.col("sms_level")) == b)
    return works.groupBy(by).agg(
        F.count("*").alias("n"),
        band("0").alias("sms_0"),
        band("1-2").alias("sms_1_2"),
        band("3").alias("sms_3"),
        band("4-5").alias("sms_4_5"),
        band("other").alias("sms_other"),
        F.count_if(F.col("region") == "LAC").alias("lac"),
        F.count_if((F.col("citation_count") >= 75) & (F.col("year") < 2020)).alias("foundational"),
        F.count_if(F.col("year") >= now - 5).alias("recent"),
        F.floor(F.percentile("year", F.lit(0.5)) + 0.5).cast("int").alias("median_year"),
        F.min(decade(F.col("year"))).alias("first_decade"),
    )


def so_what(works: DataFrame, by: str) -> DataFrame:
    """``strong_share`` (percent, rounded half up) and ``lac``: strong methods and regional works of each group."""
    strong = F.floor(100.0 * F.count_if(F.col("sms_level") >= 4) / F.count("*") + 0.5).cast("int")
    return works.groupBy(by).agg(strong.alias("strong_share"), F.count_if(F.col("region") == "LAC").alias("lac"))


def mixed_evidence(works: DataFrame, by: str) -> DataFrame:
    """Whether a group has at least three graded works, one strong and one weak."""
    graded, strong, weak = F.count("sms_level"), F.count_if(F.col("sms_level") >= 4), F.count_if(F.col("sms_level") <= 2)
    return works.groupBy(by).agg(graded.alias("graded"), strong.alias("strong"), weak.alias("weak"), ((graded >= 3) & (strong >= 1) & (weak >= 1)).alias("mixed"), F.floor(F.when(F.count("*") > 0, 100.0 * strong / F.count("*")) + 0.5).cast("int").alias("strong_share"))


def coverage_profile(works: DataFrame, rules: DataFrame) -> DataFrame:
    """``label, n, strong, newest``: works whose text matches a rule's pattern, for every rule of (label, pattern).

    Rules are parameters: at most 1000 rows, read on the driver and matched in one pass.
    """
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    marks = F.array_compact(F.array(*[F.when(text.rlike(r.pattern), F.lit(r.label)) for r in only_row(rules, 1000)]))
    hits = works.withColumn("label", F.explode(F.array_distinct(marks)))
    found = hits.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("sms_level") >= 4).alias("strong"), F.max("year").alias("newest"))
    return rules.select("label").distinct().join(found, "label", "left").na.fill(0, ["n", "strong"])


def gap_kind(n: Column, strong: Column, lac: Column, newest: Column) -> Column:
    """The first gap that a topic shows: none found, few found, no strong method, no regional work."""
    return F.when(n == 0, "research").when(n < 5, "retrieval").when(strong == 0, "methodological").when(lac == 0, "regional").otherwise("none")


def null_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``column, filled, percent`` in one pass."""
    one = rows.agg(F.count("*").alias("n"), F.array(*[F.count(c) for c in columns]).alias("filled"))
    names = F.array(*[F.lit(c) for c in columns])
    exploded = one.select("n", F.explode(F.arrays_zip(names.alias("name"), F.col("filled"))).alias("x"))
    return exploded.select(F.col("x.name").alias("column"), F.col("x.filled").alias("filled"), percent(F.col("x.filled"), F.col("n")).alias("percent"))


def venue_profile(works: DataFrame, top: int = 8) -> DataFrame:
    """Rows, years and the most frequent topics of each venue as text, count desc and value asc."""
    base = works.groupBy("venue").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.col("year") < 1990).alias("early"))
    counts = works.groupBy("venue", "topic").agg(F.count("*").alias("k"))
    nth = F.row_number().over(Window.partitionBy("venue").orderBy(F.desc("k"), "topic"))
    said = F.struct("nth", F.concat_ws(":", "topic", F.col("k").cast("string")).alias("s"))
    tops = counts.withColumn("nth", nth).where(F.col("nth") <= top).groupBy("venue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x.s), ",").alias("topics"))
    return base.join(tops, "venue", "left")


def channel_overlap(hits: DataFrame) -> DataFrame:
    """``channel, n, exclusive, shared``: works of each channel that no other, or another too, found."""
    width = F.count("*").over(Window.partitionBy("id"))
    marked = hits.select("id", "channel").distinct().withColumn("width", width)
    return marked.groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.col("width") == 1).alias("exclusive"), F.count_if(F.col("width") > 1).alias("shared"))


def alerts(events: DataFrame, as_of: str, error_rate: float = 0.1, quiet_hours: int = 24) -> DataFrame:
    """``alert, severity, value``: a high share of errors, slow purchases, a quiet stream."""
    one = events.agg(F.avg((F.col("event_type") == "error").cast("double")).alias("errors"), F.percentile(F.when(F.col("event_type") == "purchase", F.col("value")), F.lit(0.95)).alias("slow"), F.max("ts").alias("last"))
    hours = F.round((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / 3600.0, 4)
    rows = F.array(
        F.struct(F.lit("errors").alias("alert"), F.when(F.col("errors") >= error_rate, "high").otherwise("ok").alias("severity"), F.round("errors", 6).alias("value")),
        F.struct(F.lit("latency").alias("alert"), F.when(F.col("slow") >= 90, "medium").otherwise("ok").alias("severity"), F.round("slow", 6).alias("value")),
        F.struct(F.lit("quiet").alias("alert"), F.when(hours >= quiet_hours, "low").otherwise("ok").alias("severity"), hours.alias("value")),
    )
    return one.select(F.explode(rows).alias("x")).select("x.*")
