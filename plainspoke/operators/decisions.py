"""Decisions and composites: access, entitlements, scopes, settings, gates, status codes, risk, market state, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Defaults and bounds of a relay's settings.
SETTINGS = {"audit_threshold": (0.0, 1.0), "max_passes": (1, 5), "token_ceiling": (100, 8000)}
GATE_MODES = ("standard", "strict", "permissive")


def access(requests: DataFrame, policies: DataFrame, id: str) -> DataFrame:
    """(id, allowed, policy): of the active policies for a request's resource and action, the one of the highest priority whose conditions all hold decides; none allows.

    requests: id, resource, action, attributes map. policies: policy, resource,
    action, priority, effect, conditions map of attribute to allowed values.
    """
    p = policies.select(F.col("resource").alias("_r"), F.col("action").alias("_a"), "policy", "priority", "effect", "conditions")
    met = requests.join(p, (F.col("resource") == F.col("_r")) & (F.col("action") == F.col("_a")), "left")
    holds = F.forall(F.map_entries("conditions"), lambda e: F.coalesce(F.array_contains(e["value"], F.try_element_at("attributes", e["key"])), F.lit(False)))
    order = F.struct("priority", -F.col("policy"))
    best = met.groupBy(id).agg(F.max_by(F.when(holds, F.struct("effect", "policy")), F.when(holds, order)).alias("_p"))
    return best.select(id, F.coalesce(F.col("_p.effect") == "allow", F.lit(True)).alias("allowed"), F.col("_p.policy").alias("policy"))


def entitlement(asked: DataFrame, granted: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """``keys``, allowed and reason of each asked feature: no_entitlement, trial_expired, limit_exceeded, or null. granted: keys, limit_type, limit_value, used, trial_ends."""
    met = asked.join(granted.withColumn("_has", F.lit(True)), keys, "left")
    over = (F.col("limit_type") == "count") & (F.col("limit_value") > 0) & (F.col("used") >= F.col("limit_value"))
    reason = F.when(F.col("_has").isNull(), "no_entitlement").when(F.col("trial_ends") < as_of, "trial_expired").when(over, "limit_exceeded")
    return met.select(*keys, reason.alias("reason")).withColumn("allowed", F.col("reason").isNull())


def scope(token: Column, key: Column, call_id: Column) -> Column:
    """Struct (kind, effective_id, fell_back) of a session scope token: call, session:<id>, account or shared:<topic>; what is not granted falls back to call."""
    t = F.lower(F.trim(F.coalesce(token, F.lit("call"))))
    own = F.trim(F.substring(t, 9, 1000))
    ok = F.rlike(own, F.lit(r"^[a-z0-9_-]{1,64}$"))
    call = F.concat(F.lit("call_"), F.substring(F.md5(call_id.cast("string")), 1, 12))
    session, account = F.startswith(t, F.lit("session:")) & ok, (t == "account") & key.isNotNull()
    named = F.concat(F.lit("session_"), F.when(key.isNotNull(), F.concat(F.substring(key, 1, 8), F.lit("_"))).otherwise(""), own)
    kind = F.when(session, "session").when(account, "account").otherwise("call")
    asked = (t != "call") & (t != "")
    return F.struct(kind.alias("kind"), F.when(session, named).when(account, F.concat(F.lit("account_"), key)).otherwise(call).alias("effective_id"), (asked & ~session & ~account).alias("fell_back"))


def settings(asked: dict[str, Column], stored: dict[str, Column], defaults: dict[str, object]) -> list[Column]:
    """One column a setting: as asked, else as stored, else the default; numbers kept in their bounds, an unknown gate mode is standard."""
    out = []
    for name, default in defaults.items():
        value = F.coalesce(asked.get(name, F.lit(None)), stored.get(name, F.lit(None)), F.lit(default))
        if name in SETTINGS:
            low, high = SETTINGS[name]
            value = F.greatest(F.lit(low), F.least(F.lit(high), value.cast(type(low).__name__.replace("float", "double"))))
        elif name == "gate_mode":
            value = F.when(value.isin(*GATE_MODES), value).otherwise("standard")
        out.append(value.alias(name))
    return out


def gated(audited: DataFrame, mode: str, score: str = "score", violations: str = "violations") -> Column:
    """Whether a text with this structural score (hundredths) passes: strict below 80 or with any violation not, standard below 60 not, permissive always."""
    if mode == "strict":
        return (F.col(score) >= 80) & (F.size(violations) == 0)
    return F.col(score) >= 60 if mode == "standard" else F.lit(True)


def provenance(df: DataFrame, as_of: str, zone: str, build: str, request: Column) -> DataFrame:
    """``df`` with as_of, zone, build and request_id: what a stored result says about where it comes from."""
    return df.withColumns({"as_of": F.lit(as_of).cast("timestamp_ntz"), "zone": F.lit(zone), "build": F.lit(build), "request_id": request})


def status_code(outcome: Column) -> Column:
    """200 for ok, 422 for gated, 502 for anything else."""
    return F.when(outcome == "ok", 200).when(outcome == "gated", 422).otherwise(502)


def governance_hint(structural: Column, edge: Column) -> Column:
    """Route from scores in hundredths: sound and calm to the machine, unsound and calm back to the writer, sound and tense to a person if possible, else to a person."""
    s, e = F.coalesce(structural, F.lit(0)), F.coalesce(edge, F.lit(0))
    return F.when((s >= 75) & (e < 60), "AI_OPTIMAL").when((s < 75) & (e < 40), "CLARIFICATION_REQUIRED").when((s >= 75) & (e >= 60), "HUMAN_RECOMMENDED").otherwise("HUMAN_REQUIRED")


def risk_composite(structural: Column, edge: Column) -> Column:
    """60 parts of what the structure lacks and 40 of the edge, both in hundredths; in ten-thousandths."""
    held = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(x, F.lit(0))))
    return ((100 - held(structural)) * 60 + held(edge) * 40).cast("int")


def market_state(daily: DataFrame, lead: str, broad: str, fear: str) -> DataFrame:
    """(day, state, call, confidence) of each day with a close of ``lead`` and one before: 500 thousandths, 5 times the lead's change, -50 or +20 for fear above 25 or below 15, 20 either way where lead and broad agree; held in 0 to 1000.

    daily: ticker, day, close. A ticker that a day lacks adds nothing.
    """
    w = W.partitionBy("ticker").orderBy("day")
    moved = daily.select("ticker", "day", "close", F.lag("close").over(w).alias("before"))
    wide = moved.groupBy("day").agg(*(F.max(F.when(F.col("ticker") == t, F.col(c))).alias(f"{n}_{c}") for t, n in ((lead, "l"), (broad, "b"), (fear, "f")) for c in ("close", "before")))
    change = lambda n: F.when(F.col(f"{n}_before") > 0, (F.col(f"{n}_close") - F.col(f"{n}_before")) / F.col(f"{n}_before"))
    wide = wide.select("day", F.coalesce(change("l"), F.lit(0.0)).alias("lead"), change("b").alias("broad"), "f_close", F.col("l_before").isNotNull().alias("known"))
    fearful = F.when(F.col("f_close") > 25, -50).when(F.col("f_close") < 15, 20).otherwise(0)
    breadth = F.when((F.col("broad") > 0) & (F.col("lead") > 0), 20).when((F.col("broad") < 0) & (F.col("lead") < 0), -20).otherwise(0)
    state = F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(500 + F.col("lead") * 5000 + 0.5) + fearful + breadth)).cast("long")
    got = wide.where("known").select("day", state.alias("state"))
    s = F.col("state")
    return got.select("day", "state", F.when(s > 550, "UP").when(s < 450, "DOWN").otherwise("FLAT").alias("call"), F.when((s >= 650) | (s <= 350), "HIGH").when((s > 550) | (s < 450), "MODERATE").otherwise("LOW").alias("confidence"))


def feed_environment(scored: DataFrame, feed: str, score: str = "score") -> DataFrame:
    """(feed, n, mean, environment, delta): CLEAR from a mean score of 70 adds 2 hundredths, MIXED from 50 none, NOISY takes 3. Halves round to even."""
    mean = F.bround(F.sum(score) / F.greatest(F.count(score), F.lit(1))).cast("int")
    got = scored.groupBy(feed).agg(F.count(score).alias("n"), F.coalesce(mean, F.lit(0)).alias("mean"))
    return got.select(feed, "n", "mean", F.when(F.col("mean") >= 70, "CLEAR").when(F.col("mean") >= 50, "MIXED").otherwise("NOISY").alias("environment"), F.when(F.col("mean") >= 70, 2).when(F.col("mean") >= 50, 0).otherwise(-3).alias("delta"))


def lifecycle(checks: DataFrame, **children: tuple[DataFrame, Column]) -> DataFrame:
    """``checks`` (request_id) with what each child table has for the request: each is aggregated first, so no join multiplies rows."""
    out = checks
    for name, (df, value) in children.items():
        out = out.join(df.groupBy("request_id").agg(F.count("*").alias(f"n_{name}"), value.alias(name)), "request_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def unlocked(steps: DataFrame, owner: str, order: str, done: str) -> DataFrame:
    """(owner, order, state): a step that isn't done is open where the one before is done or there is none, else locked."""
    before = F.lag(F.col(done), 1).over(W.partitionBy(owner).orderBy(order))
    return steps.select(owner, order, F.when(F.col(done), "completed").when(F.coalesce(before, F.lit(True)), "open").otherwise("locked").alias("state"))


def versioned(target: DataFrame, writes: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The written rows with their versions: one more than the row they overwrite, else 1."""
    return writes.join(target.select(key, F.col(version).alias("_v")), key, "left").withColumn(version, F.coalesce("_v", F.lit(0)) + 1).drop("_v")


def best_links(links: DataFrame, page: str, kind: str, confidence: str, priority: dict[str, int], most: int = 6) -> DataFrame:
    """Of each page the best link of each kind, by confidence, then the kind's priority, ``most`` at most. Ties go to the first place."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv)), F.col(kind)), F.lit(99))
    one = links.withColumn("_k", F.row_number().over(W.partitionBy(page, kind).orderBy(F.desc(confidence), "nth"))).where("_k = 1")
    best = one.withColumn("place", F.row_number().over(W.partitionBy(page).orderBy(F.desc(confidence), rank, "nth"))).where(F.col("place") <= most)
    return best.drop("_k")
