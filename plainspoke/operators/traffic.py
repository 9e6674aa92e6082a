"""Traffic, usage and ledger reports: filters, grouped and windowed aggregates over page views and transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

from .folds import folded


def between(df: DataFrame, since: str, until: str, ts: str = "ts") -> DataFrame:
    """Half-open range, pushed to the scan."""
    return df.where((F.col(ts) >= F.lit(since).cast("timestamp_ntz")) & (F.col(ts) < F.lit(until).cast("timestamp_ntz")))


def without(df: DataFrame, column: str, fragments: list[str]) -> DataFrame:
    """Rows whose lowered column holds none of the fragments (bots, scanners)."""
    return df.where(~F.exists(F.array(*map(F.lit, fragments)), lambda f: F.contains(F.lower(column), f)))


def period_counts(views: DataFrame, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: visitors and hits of each named half-open period, in one pass."""
    out = []
    for name, (a, b) in periods.items():
        own = (F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))
        out += [F.count_distinct(F.when(own, F.col("ip"))).alias(f"{name}_visitors"), F.count_if(own).alias(f"{name}_hits")]
    return views.agg(*out)


def top_groups(views: DataFrame, by: str, k: int) -> DataFrame:
    """The k groups with most distinct visitors, then most hits, then by name."""
    return views.groupBy(by).agg(F.count_distinct("ip").alias("visitors"), F.count("*").alias("hits")).orderBy(F.desc("visitors"), F.desc("hits"), by).limit(k)


def visitor_profiles(views: DataFrame) -> DataFrame:
    """Hits, distinct paths and their names in order, last seen and largest referrer of each visitor."""
    return views.groupBy("ip").agg(F.count("*").alias("hits"), F.count_distinct("path").alias("pages"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"), F.max("ts").alias("last_seen"), F.max("referrer").alias("referrer"))


def repeat_visitors(views: DataFrame, days: int = 2) -> DataFrame:
    return views.groupBy("ip").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count("*").alias("hits")).where(F.col("days") >= days)


def engaged_visitors(views: DataFrame, pages: int = 5) -> DataFrame:
    return views.groupBy("ip").agg(F.count_distinct("path").alias("pages"), F.max("ts").alias("last_seen"), F.min("path").alias("first_path")).where(F.col("pages") >= pages)


def daily(views: DataFrame) -> DataFrame:
    return views.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("ip").alias("visitors"), F.count("*").alias("hits"))


def hourly(views: DataFrame) -> DataFrame:
    """Hits of each hour of the day and its bar as whole per cent of the largest."""
    got = views.groupBy(F.concat(F.date_format("ts", "HH"), F.lit(":00")).alias("hour")).agg(F.count("*").alias("hits"))
    return got.withColumn("bar", F.floor(F.col("hits") * 100 / F.max("hits").over(W.partitionBy())).cast("long"))  # 24 rows at most


def entry_counts(views: DataFrame) -> DataFrame:
    """Visitor-days of each path: every path of a day counts once."""
    return views.groupBy("ip", F.to_date("ts").alias("day"), "path").count().groupBy("path").agg(F.count("*").alias("entries"))


def first_touches(views: DataFrame) -> DataFrame:
    """The first view of each visitor and day."""
    w = W.partitionBy("ip", F.to_date("ts")).orderBy("ts", "id")
    return views.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("ip", F.to_date("ts").alias("day"), "path", "id")


def period_change(views: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """Visitors of two adjoining periods and the change in per cent, rounded and truncated toward zero."""
    got = period_counts(views, {"before": (start, middle), "now": (middle, end)})
    change = (F.col("now_visitors") - F.col("before_visitors")) * 100 / F.greatest(F.col("before_visitors"), F.lit(1))
    return got.select("before_visitors", "now_visitors", F.round(change).cast("long").alias("change"), change.cast("long").alias("change_cut"))


def funnel(views: DataFrame, a: str, b: str) -> DataFrame:
    """Visitors of path b as whole per cent of those of path a."""
    n = lambda p: F.count_distinct(F.when(F.col("path") == p, F.col("ip")))
    return views.agg(n(a).alias("a"), n(b).alias("b")).withColumn("ratio", F.floor(F.col("b") * 100 / F.greatest("a", F.lit(1))).cast("long"))


def rolling_visitors(views: DataFrame, days: int = 7) -> DataFrame:
    """Distinct visitors of each day and the days before it. Visitors are first reduced to one row a day, and each row counts for the days it reaches."""
    per_day = views.select(F.to_date("ts").alias("day"), "ip").distinct()
    reach = per_day.select("ip", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add("day", i))).alias("day")).distinct()
    got = reach.groupBy("day").agg(F.count("*").alias("visitors"))
    return got.join(per_day.select("day").distinct(), "day", "left_semi")


def monthly_usage(views: DataFrame) -> DataFrame:
    return views.groupBy(F.col("ip").alias("api_key"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("calls"))


def slow_share(views: DataFrame, above: float) -> DataFrame:
    """Attainment of a latency target by path: good, total, and whole per mille."""
    return views.groupBy("path").agg(F.count_if(F.col("latency") <= above).alias("good"), F.count("*").alias("total")).withColumn("per_mille", F.floor(F.col("good") * 1000 / F.col("total")).cast("long"))


def rate_limited(views: DataFrame, per_minute: int) -> DataFrame:
    """Calls beyond the allowance of their key and minute."""
    minute = F.date_format("ts", "yyyy-MM-dd HH:mm")
    w = W.partitionBy("ip", minute).orderBy("ts", "id")
    return views.select("id", "ip", minute.alias("minute"), F.row_number().over(w).alias("nth")).where(F.col("nth") > per_minute)


def running_balance(ledger: DataFrame) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    return ledger.select("id", "user_id", "cents", F.sum("cents").over(w).alias("balance"))


def low_balance_crossings(ledger: DataFrame, at_most: int = 100) -> DataFrame:
    """For each user and deposit epoch, the first transaction that leaves at most so much."""
    w = W.partitionBy("user_id").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    got = ledger.select("id", "user_id", "ts", F.sum("cents").over(w).alias("balance"), F.count_if(F.col("type") == "deposit").over(w).alias("epoch"))
    return got.where(F.col("balance") <= at_most).groupBy("user_id", "epoch").agg(F.min_by("id", F.struct("ts", "id")).alias("id"))


def charge_step(balance: int, cents: int | None) -> tuple[int, tuple]:
    take = cents is not None and balance + cents >= 0
    after = balance + cents if take else balance
    return after, (take, after)


def accepted_charges(ledger: DataFrame) -> DataFrame:
    """(id, user_id, cents, accepted, balance): a charge beyond the balance is rejected. Order decides, so each user's rows are folded in order of ts and id."""
    rows = ledger.select("id", "user_id", "ts", F.col("cents").cast("long").alias("cents"))
    return folded(rows, "user_id", ["ts", "id"], "cents", 0, charge_step, ["id", "user_id", "cents"], {"accepted": "boolean", "balance": "long"})


def spend_alerts(ledger: DataFrame, threshold: int) -> DataFrame:
    return ledger.where("type = 'charge'").groupBy("user_id").agg((-F.sum("cents")).alias("spent")).where(F.col("spent") > threshold)


def rollout(users: DataFrame, flag: str, percent: int, bucket: Column) -> DataFrame:
    return users.select("user_id", bucket.alias("bucket")).withColumn("enabled", F.col("bucket") < percent).withColumn("flag", F.lit(flag))


def rollouts(users: DataFrame, flags: DataFrame) -> DataFrame:
    """(flag, user_id, enabled, why) of every flag (flag, on, percent, users, orgs: JSON arrays of texts) for every user (user_id, org_id): off; a listed user; a listed organisation; all; the bucket. Lists come first.

    Each flag meets each user, as that is what is asked; flags are a bounded table of settings.
    """
    listed = flags.select("flag", "on", "percent", F.from_json("users", "array<string>").alias("_u"), F.from_json("orgs", "array<string>").alias("_o"))
    met = users.join(listed, F.lit(True))
    inside = lambda c, x: F.coalesce(F.array_contains(c, F.col(x).cast("string")), F.lit(False))
    bucket = T.rollout_bucket(F.col("flag"), F.col("user_id").cast("string"))
    why = F.when(~F.col("on"), "off").when(inside("_u", "user_id"), "user").when(inside("_o", "org_id"), "organisation").when(F.col("percent") >= 100, "all").when(bucket < F.col("percent"), "bucket").otherwise("none")
    return met.select("flag", "user_id", ~why.isin("off", "none"), why.alias("why")).toDF("flag", "user_id", "enabled", "why")


def budgets(views: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, day, good, total, per_mille, met, left) against targets (path, most latency, target in per mille): good requests of each day, whether they are enough, and what is left of the bad ones that the target allows, in per mille; null where it allows none. Paths without a target are left out."""
    t = targets.select(F.col("path").alias("_p"), "most", "target")
    own = views.join(t, F.col("path") == F.col("_p")).groupBy("path", F.to_date("ts").alias("day"), "target").agg(F.count_if(F.col("latency") <= F.col("most")).alias("good"), F.count("*").alias("total"))
    allowed = F.col("total") * (1000 - F.col("target"))  # thousandths of a request
    left = F.when(allowed > 0, F.floor((allowed - (F.col("total") - F.col("good")) * 1000) * 1000 / allowed).cast("long"))
    return own.select("path", "day", "good", "total", F.floor(F.col("good") * 1000 / F.col("total")).cast("long").alias("per_mille"), (F.col("good") * 1000 >= F.col("total") * F.col("target")).alias("met"), left.alias("left"))


def covering(events: DataFrame, schedule: DataFrame) -> DataFrame:
    """The schedule row that covers each event's time, the lowest order first; no row without cover. The schedule is laid out by day, so the join is on equal days and each event looks through that day's rows in order."""
    own = F.struct("escalation", "person", "start_time", "end_time")
    days = schedule.select(F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time"))).alias("_day"), own.alias("s")).groupBy("_day").agg(F.array_sort(F.collect_list("s")).alias("_s"))
    met = events.withColumn("_day", F.to_date("ts")).join(days, "_day")
    first = F.get(F.filter("_s", lambda s: F.col("ts").between(s["start_time"], s["end_time"])), 0)
    return met.select("id", first["person"].alias("person")).where("person is not null")


def as_of(facts: DataFrame, history: DataFrame, key: str, ts: str, since: str, value: str) -> DataFrame:
    """``facts`` with the last ``value`` of ``history`` (key, since, value) at or before each ts: a union and one window, no range join."""
    a = facts.select(key, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(dict(history.dtypes)[value]).alias("_v"), F.struct(*[c for c in facts.columns]).alias("_row"))
    b = history.select(key, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = W.partitionBy(key).orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("as_of", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("as_of").alias(value))


def since(df: DataFrame, as_of: str, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the ``days`` before ``as_of`` and later."""
    return df.where(F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz"))


def without_prefixes(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose column starts with none of the prefixes; null is kept."""
    skipped = F.lit(False)
    for p in prefixes:
        skipped = skipped | F.startswith(column, F.lit(p))
    return df.where(~F.coalesce(skipped, F.lit(False)))


def client_ip(forwarded: Column) -> Column:
    """The first address of a forwarding header."""
    return F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))


def filled(column: Column) -> Column:
    """Whether a text is neither null nor blank."""
    return F.coalesce(F.trim(column) != "", F.lit(False))


def lookup(df: DataFrame, equal: dict[str, object], order: list[Column], most: int) -> DataFrame:
    """The first rows in order of those whose columns have these values."""
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    return df.orderBy(*order).limit(most)


def monthly_meters(events: DataFrame, org: str, meter: str, quantity: str, ts: str = "ts") -> DataFrame:
    """(org, period, id, quantity, since, until): a meter's rounded sum a month, named org:meter:period, with the month's half-open bounds."""
    month = F.date_trunc("month", F.col(ts))
    got = events.groupBy(F.col(org).alias("org"), month.alias("_m")).agg(F.sum(F.round(quantity).cast("long")).alias("quantity"))
    period = F.date_format("_m", "yyyy-MM")
    return got.select("org", period.alias("period"), F.concat_ws(":", "org", F.lit(meter), period).alias("id"), "quantity", F.col("_m").cast("timestamp_ntz").alias("since"), F.add_months(F.to_date("_m"), 1).cast("timestamp_ntz").alias("until"))


def vitals(views: DataFrame, page: str, value: str) -> DataFrame:
    """Samples, mean and least in hundredths, and the exact lower median and third quartile of a measure for each page."""
    cents = F.round(F.col(value) * 100).cast("long")
    quantile = lambda q: F.expr(f"percentile_disc({q}) within group (order by `{value}`)")
    return views.groupBy(page).agg(F.count("*").alias("n"), F.floor(F.sum(cents) / F.count(cents)).cast("long").alias("mean"), F.min(cents).alias("least"), quantile(0.5).alias("p50"), quantile(0.75).alias("p75"))


#: The insights, in order.
METRICS = ("hits", "visitors", "paths", "slow", "referred", "days", "purchases", "errors", "signups", "buyers", "nightly", "weekend", "very_slow")


def insights(views: DataFrame) -> DataFrame:
    """(place, metric, value): thirteen ordered figures out of one wide aggregate."""
    on = lambda p: F.count_if(F.col("path") == p)
    wide = views.agg(
        F.count("*").alias("hits"), F.count_distinct("ip").alias("visitors"), F.count_distinct("path").alias("paths"), F.count_if(F.col("latency") > 100).alias("slow"), F.count("referrer").alias("referred"), F.count_distinct(F.to_date("ts")).alias("days"), on("/purchase").alias("purchases"),
        on("/error").alias("errors"), on("/signup").alias("signups"), F.count_distinct(F.when(F.col("path") == "/purchase", F.col("ip"))).alias("buyers"), F.count_if(F.hour("ts") < 6).alias("nightly"), F.count_if(F.dayofweek("ts").isin(1, 7)).alias("weekend"), F.count_if(F.col("latency") > 150).alias("very_slow"),
    )
    return wide.select(F.expr(f"stack({len(METRICS)}, " + ", ".join(f"{i}, '{m}', {m}" for i, m in enumerate(METRICS, 1)) + ") as (place, metric, value)"))


def changes_before(facts: DataFrame, changes: DataFrame, key: str, days: int) -> DataFrame:
    """(id, changes, latest): how many changes (key, since) lie within ``days`` before each fact (id, key, ts), and the last; facts without any are left out. A range window over the union, so no pair is made."""
    a = facts.select(key, "id", F.col("ts").alias("_t"), F.lit(None).cast("timestamp_ntz").alias("_c"))
    b = changes.select(key, F.lit(None).cast("long").alias("id"), F.col("since").alias("_t"), F.col("since").alias("_c"))
    micros = F.unix_micros(F.col("_t").cast("timestamp"))
    w = W.partitionBy(key).orderBy("_u").rangeBetween(-days * 86_400_000_000, 0)
    both = a.unionByName(b).withColumn("_u", micros)
    got = both.select("id", F.count("_c").over(w).alias("changes"), F.max("_c").over(w).alias("latest"))
    return got.where("id is not null and changes > 0")


def limited_by_tier(calls: DataFrame, tiers: DataFrame, key: str = "ip") -> DataFrame:
    """(id, key, limit) of the calls (id, key, ts, tier) beyond their tier's allowance: "minute" beyond rpm calls of a key and minute, else "month" beyond monthly ones. tiers: tier, rpm, monthly."""
    minute, month = F.date_format("ts", "yyyy-MM-dd HH:mm"), F.date_format("ts", "yyyy-MM")
    nth = lambda by: F.row_number().over(W.partitionBy(key, by).orderBy("ts", "id"))
    got = calls.join(tiers, "tier").withColumn("_n", nth(minute)).withColumn("_m", nth(month))
    return got.select("id", key, F.when(F.col("_n") > F.col("rpm"), "minute").when(F.col("_m") > F.col("monthly"), "month").alias("limit")).where("limit is not null")


def tenant_minutes(views: DataFrame, tenant: str = "ip") -> DataFrame:
    """(tenant, minute, requests, errors, mean): each tenant's minute with the mean latency in hundredths, rounded down."""
    cents = F.round(F.col("latency") * 100).cast("long")
    got = views.groupBy(F.col(tenant).alias("tenant"), F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("path") == "/error").alias("errors"), F.floor(F.sum(cents) / F.count("*")).cast("long").alias("mean"))
    return got.select("tenant", F.col("w.start").alias("minute"), "requests", "errors", "mean")
