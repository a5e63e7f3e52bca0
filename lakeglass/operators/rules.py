"""Rule engines: lifecycle, tiering, quota, policy, notification, retention, failover.

Small rule sets are compiled into expressions, so evaluation is a projection; rule
tables are joined on an equality wherever the rules have one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age_days(ts: Column, now: str) -> Column:
    """Whole days since ``ts``, at least 0."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    return F.greatest(F.expr("0L"), F.floor(seconds / 86400))


@dataclass(frozen=True)
class LifecycleRule:
    """Expiry and transition of objects under a prefix that carry all of ``tags``."""

    id: str
    prefix: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    expire_days: int | None = None
    expire_date: str | None = None
    transition_days: int | None = None
    transition_class: str | None = None
    noncurrent_expire_days: int | None = None
    noncurrent_transition_days: int | None = None
    noncurrent_class: str | None = None
    enabled: bool = True


def lifecycle_action(rules: Sequence[LifecycleRule], *, key: Column, age: Column, storage_class: Column, now: str, is_latest: Column | None = None, tags: Column | None = None) -> Column:
    """``rule:action`` of the first rule that acts, else null; expiry comes before transition."""
    latest = F.lit(True) if is_latest is None else is_latest
    out = F.lit(None).cast("string")
    for r in reversed([r for r in rules if r.enabled]):
        fits = key.startswith(r.prefix)
        for name, value in r.tags.items():
            fits &= F.lit(False) if tags is None else F.coalesce(F.element_at(tags, name) == value, F.lit(False))
        steps: list[tuple[Column, str]] = []
        if r.expire_date is not None:
            steps.append((latest & F.lit(now >= r.expire_date), "expire"))
        if r.expire_days is not None:
            steps.append((latest & (age >= r.expire_days), "expire"))
        if r.transition_days is not None and r.transition_class is not None:
            steps.append((latest & (age >= r.transition_days) & (storage_class != r.transition_class), r.transition_class))
        if r.noncurrent_expire_days is not None:
            steps.append((~latest & (age >= r.noncurrent_expire_days), "expire"))
        if r.noncurrent_transition_days is not None and r.noncurrent_class is not None:
            steps.append((~latest & (age >= r.noncurrent_transition_days) & (storage_class != r.noncurrent_class), r.noncurrent_class))
        for when, action in reversed(steps):
            out = F.when(fits & when, F.lit(f"{r.id}:{action}")).otherwise(out)
    return out


def tier_decision(*, idle_days: Column, rate_per_day: Column, current: Column, protected: Column, active: Column) -> Column:
    """Target class: a hot object to STANDARD, 30 idle days to ARCHIVE, 7 to IA; null to leave it."""
    target = F.when(rate_per_day >= 1.0, "STANDARD").when(idle_days >= 30, "ARCHIVE").when(idle_days >= 7, "IA")
    return F.when(protected | active | (target == current), None).otherwise(target)


def recommend_tier(pattern: Column, idle_days: Column) -> Column:
    return (
        F.when(pattern == "repeated", "STANDARD").when((pattern == "write_once_read_many") & (idle_days < 30), "STANDARD")
        .when(idle_days >= 90, "ARCHIVE").when(idle_days >= 30, "IA").otherwise("STANDARD")
    )


def replication_factor(pattern: Column) -> Column:
    return F.when(pattern == "write_once_read_many", 3).when(pattern == "write_heavy", 1).otherwise(2)


def percent_used(current: Column, limit: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * current, limit.cast("double")), F.lit(0.0))


def quota_verdict(current: Column, requested: Column, hard: Column, soft: Column, grace: Column, thresholds: Sequence[float] = (95.0, 90.0, 80.0)) -> Column:
    """denied, grace, soft, the first reached of ``thresholds`` as ``warn<percent>``, or ok."""
    new = current + requested
    out = F.when(new > hard, F.when(grace, "grace").otherwise("denied")).when(new > soft, "soft")
    for t in thresholds:
        out = out.when(percent_used(new, hard) >= t, f"warn{t:g}")
    return out.otherwise("ok")


def quota_alerts(usage: DataFrame, scope: str, used: str, limit: str, thresholds: Sequence[float]) -> DataFrame:
    """One row per scope and threshold reached."""
    p = percent_used(F.col(used), F.col(limit))
    reached = F.array_compact(F.array(*[F.when(p >= t, F.lit(float(t))) for t in thresholds]))
    return usage.select(scope, p.alias("percent"), F.explode(reached).alias("threshold"))


def quota_usage(events: DataFrame, scope: str, size: str, deleted: Column, order: Sequence[str]) -> DataFrame:
    """Bytes and objects per scope; every delete subtracts, and usage never falls below 0 on the way.

    A sum that stops at 0 is the running sum less its lowest value so far, or 0 where
    that is above; so windows carry it and no scope is collected.
    """
    sign = F.when(deleted, -1).otherwise(1)
    w = Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("_b", F.sum((sign * F.col(size)).cast("long")).over(w)).withColumn("_o", F.sum(sign.cast("long")).over(w)).withColumn("_at", F.struct(*order))
    zero = F.lit(0).cast("long")
    level = lambda c: F.max_by(c, "_at") - F.least(F.min(c), zero)
    return run.groupBy(scope).agg(level("_b").alias("bytes"), level("_o").alias("objects"))


# Patterns and policies ------------------------------------------------------------


def glob_regex(pattern: str, question: bool = True) -> str:
    """A regular expression for a glob with ``*`` and, if asked, ``?``."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" and question else re.escape(c) for c in pattern) + "$"


def matches_any(value: Column, patterns: Sequence[str]) -> Column:
    """Whether a value matches a glob; patterns without a wildcard are plain comparisons."""
    tests = [value == p if not re.search(r"[*?]", p) else value.startswith(p[:-1]) if re.fullmatch(r"[^*?]*\*", p) else value.rlike(glob_regex(p)) for p in patterns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


@dataclass(frozen=True)
class Statement:
    """A policy statement; the ``not_`` variants take precedence over the plain ones."""

    effect: str
    actions: tuple[str, ...] = ()
    resources: tuple[str, ...] = ()
    principals: tuple[str, ...] = ("*",)
    not_actions: tuple[str, ...] = ()
    not_resources: tuple[str, ...] = ()
    conditions: dict[str, dict[str, Any]] = field(default_factory=dict)


def condition(conditions: dict[str, dict[str, Any]], context: dict[str, Column]) -> Column:
    """Whether all conditions hold; a list of expected values means any of them; unknown operators pass."""
    out = F.lit(True)
    for op, tests in conditions.items():
        for name, expected in tests.items():
            x = context.get(name, F.lit(None).cast("string"))
            values = expected if isinstance(expected, (list, tuple)) else [expected]
            number = x.try_cast("double")
            day = x.try_cast("timestamp")
            test = {
                "StringEquals": lambda x=x, v=values: x.isin(*v),
                "StringNotEquals": lambda x=x, v=values: ~x.isin(*v),
                "StringEqualsIgnoreCase": lambda x=x, v=values: F.lower(x).isin(*[s.lower() for s in v]),
                "StringLike": lambda x=x, v=values: matches_any(x, v),
                "StringNotLike": lambda x=x, v=values: ~matches_any(x, v),
                "NumericEquals": lambda n=number, v=values: n.isin(*map(float, v)),
                "NumericLessThan": lambda n=number, v=values: n < max(map(float, v)),
                "NumericLessThanEquals": lambda n=number, v=values: n <= max(map(float, v)),
                "NumericGreaterThan": lambda n=number, v=values: n > min(map(float, v)),
                "NumericGreaterThanEquals": lambda n=number, v=values: n >= min(map(float, v)),
                "DateLessThan": lambda d=day, v=values: d < F.lit(max(v)).cast("timestamp"),
                "DateGreaterThan": lambda d=day, v=values: d > F.lit(min(v)).cast("timestamp"),
                "Bool": lambda x=x, v=values: F.lower(x).isin(*[str(s).lower() for s in v]),
                "ArnLike": lambda x=x, v=values: matches_any(x, v),
                "Null": lambda x=x, v=values: x.isNull() == F.lit(str(v[0]).lower() == "true"),
            }.get(op)
            if test is not None:
                out &= F.coalesce(test(), F.lit(False))
    return out


def policy_decision(statements: Sequence[Statement], *, principal: Column, action: Column, resource: Column, context: dict[str, Column] | None = None) -> Column:
    """Deny if any denying statement applies, else Allow if an allowing one does, else NotApplicable."""
    applies = {"Allow": F.lit(False), "Deny": F.lit(False)}
    for s in statements:
        act = ~matches_any(action, s.not_actions) if s.not_actions else matches_any(action, s.actions)
        res = ~matches_any(resource, s.not_resources) if s.not_resources else matches_any(resource, s.resources)
        who = F.lit(True) if "*" in s.principals else principal.isin(*s.principals)
        applies[s.effect] |= who & act & res & condition(s.conditions, context or {})
    return F.when(applies["Deny"], "Deny").when(applies["Allow"], "Allow").otherwise("NotApplicable")


@dataclass(frozen=True)
class Notification:
    """Events of some types under a key prefix and suffix go to a destination."""

    destination: str
    events: tuple[str, ...]
    prefix: str = ""
    suffix: str = ""


def route_events(events: DataFrame, notifications: Sequence[Notification], event_type: str, key: str) -> DataFrame:
    """One row per event and destination it goes to, each destination once."""
    goes = [F.when(matches_any(F.col(event_type), n.events) & F.col(key).startswith(n.prefix) & F.col(key).endswith(n.suffix), F.lit(n.destination)) for n in notifications]
    return events.withColumn("destination", F.explode(F.array_distinct(F.array_compact(F.array(*goes)))))


def can_delete(mode: Column, retain_until: Column, legal_hold: Column, now: str, bypass: bool) -> Column:
    """Expired retention, or governance with bypass, and no legal hold."""
    expired = retain_until.isNull() | (retain_until <= F.lit(now).cast("timestamp"))
    return ~F.coalesce(legal_hold, F.lit(False)) & (expired | ((mode == "GOVERNANCE") & F.lit(bypass)))


def failover(retries: Column, max_retries: int, reason: Column, healthy: Column, cooling: Column, alternative: Column) -> Column:
    """Abort at the retry limit; retry the edge after a transient failure; else reroute; else abort."""
    transient = reason.isin("timeout", "transfer_failed")
    return F.when(retries >= max_retries, "abort").when(transient & healthy & ~cooling, "retry").when(alternative.isNotNull(), "reroute").otherwise("abort")


def reoptimise(cooling: Column, drift: Column, stale: Column, manual: Column, affected: Column, threshold: float) -> Column:
    """Pause in the cool-down; a full plan on drift, staleness or demand; partial for affected edges."""
    return F.when(cooling, "pause").when((drift >= threshold) | stale | manual, "full").when(affected > 0, "partial").otherwise("none")


def parity_for_loss(loss: Column) -> Column:
    """Parity shards advised for a loss rate."""
    return F.when(loss < 0.01, 2).when(loss < 0.05, 3).when(loss < 0.1, 4).when(loss < 0.2, 6).otherwise(8)


def partition_state(unreachable: Column, members: Column, seconds: Column, confirm_after: int, was: Column) -> Column:
    return (
        F.when((unreachable == 0) & was.isin("suspected", "confirmed"), "healed").when(unreachable == 0, "healthy")
        .when(seconds >= confirm_after, "confirmed").otherwise("suspected")
    )


def scrub_due(paused: Column, load: Column, max_load: float, last_run: Column, now: str, every_seconds: int) -> Column:
    """Whether a scrub should run: not paused, load low, never run or long ago."""
    elapsed = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last_run.cast("timestamp"))
    return ~paused & (load < max_load) & (last_run.isNull() | (elapsed >= every_seconds))


def compression_hint(entropy: Column, compressed_share: Column) -> Column:
    return F.when((compressed_share > 0.5) | (entropy > 0.95), "none").when(entropy > 0.7, "fast").when(entropy > 0.3, "balanced").otherwise("maximum")


def lock_status(mode: Column, retain_until: Column, legal_hold: Column, now: str) -> Column:
    """held, expired, governance or compliance; unlocked without any retention."""
    expired = retain_until <= F.lit(now).cast("timestamp")
    return F.when(F.coalesce(legal_hold, F.lit(False)), "held").when(retain_until.isNull(), "unlocked").when(expired, "expired").when(mode == "GOVERNANCE", "governance").otherwise("compliance")


def pending_repairs(blocks: DataFrame, repaired: Column, attempts: Column, most: int) -> DataFrame:
    """Quarantined blocks that are not repaired and may be tried again."""
    return blocks.where(~repaired & (attempts < most))
