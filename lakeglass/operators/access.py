"""Access-log analytics: hot and cold items, runs, bursts, co-access, predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.operators.numbering import number_rows


def access_stats(log: DataFrame, item: str, op: str, size: Column, latency: str, reads: Sequence[str], writes: Sequence[str]) -> DataFrame:
    """Reads, writes, bytes and latency bounds per item."""
    return log.groupBy(item).agg(
        F.count_if(F.col(op).isin(*reads)).alias("reads"), F.count_if(F.col(op).isin(*writes)).alias("writes"), F.sum(size).alias("bytes"),
        F.min(latency).alias("min_latency"), F.max(latency).alias("max_latency"), F.max("ts").alias("last_access"),
    )


def hot_items(log: DataFrame, item: str, threshold: int) -> DataFrame:
    """Items with at least ``threshold`` accesses."""
    return log.groupBy(item).agg(F.count("*").alias("accesses")).where(F.col("accesses") >= threshold)


def top_items(log: DataFrame, item: str, k: int, minutes: int) -> DataFrame:
    """The ``k`` items with the highest integer rate per minute; ties to the smaller item."""
    rate = F.expr(f"count(*) div {minutes + 1}")
    return log.groupBy(item).agg(F.count("*").alias("accesses"), rate.alias("rate")).orderBy(F.desc("rate"), F.desc("accesses"), item).limit(k)


def cold_items(catalog: DataFrame, log: DataFrame, item: str, now: str, days: int) -> DataFrame:
    """Catalogue items never accessed, or last accessed more than ``days`` before ``now``."""
    last = log.groupBy(item).agg(F.max("ts").alias("last_access"))
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return catalog.join(last, item, "left").where(F.col("last_access").isNull() | (F.col("last_access") < cutoff))


def peak(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Modal hour and modal weekday (Monday 0) as rows ``kind, value, n``; ties to the smaller."""
    per = log.groupBy(F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday")).agg(F.count("*").alias("n"))
    kinds = F.array(F.struct(F.lit("hour").alias("kind"), F.col("hour").alias("value")), F.struct(F.lit("weekday").alias("kind"), F.col("weekday").alias("value")))
    totals = per.select(F.explode(kinds).alias("e"), "n").groupBy("e.kind", "e.value").agg(F.sum("n").alias("n"))
    return totals.groupBy("kind").agg(F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("m"), "value")).alias("best")).select("kind", "best.value", "best.n")


def sequential_runs(log: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, least: int = 2) -> DataFrame:
    """Runs of records whose value changes by 1 in one direction.

    A reversal starts a run that shares the turning record, so a run's length is its
    steps plus one.  Rows: partition, first value, length, direction.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    step = F.col(value) - F.lag(value).over(w)
    d = log.withColumn("_d", F.when(F.abs(step) == 1, step).otherwise(F.lit(0)).cast("int")).withColumn("_from", F.lag(value).over(w))
    starts = F.when((F.col("_d") != 0) & (F.coalesce(F.lag("_d").over(w), F.lit(0)) != F.col("_d")), 1).otherwise(0)
    runs = d.withColumn("_run", F.sum(starts).over(w)).withColumn("_i", F.row_number().over(w)).where("_d <> 0")
    return (
        runs.groupBy(*partition, "_run", "_d")
        .agg(F.min_by("_from", "_i").alias("start"), (F.count("*") + 1).alias("length"))
        .where(F.col("length") >= least)
        .select(*partition, "start", "length", F.col("_d").alias("direction"))
    )


def burst_gaps(log: DataFrame, partition: str, millis: Column, order: Sequence[str], factor: int = 3) -> DataFrame:
    """Per partition: records, integer mean gap, gaps longer than ``factor`` times it, mean burst length, verdict.

    Bursty means at least 10 records, 2 long gaps, and 5 records per burst.
    """
    w = Window.partitionBy(partition).orderBy(*order)
    gaps = log.withColumn("_ms", millis).withColumn("_gap", F.col("_ms") - F.lag("_ms").over(w))
    mean = gaps.withColumn("_mean", F.floor(F.avg("_gap").over(Window.partitionBy(partition))))
    per = mean.groupBy(partition).agg(F.count("*").alias("records"), F.max("_mean").alias("mean_gap"), F.count_if(F.col("_gap") > factor * F.col("_mean")).alias("long_gaps"))
    burst = F.floor(F.col("records") / (F.col("long_gaps") + 1))
    return per.withColumn("mean_burst", burst).withColumn("bursty", (F.col("records") >= 10) & (F.col("long_gaps") >= 2) & (burst >= 5))


def co_access(log: DataFrame, item: str, order: Sequence[str], session: Sequence[str], reach: int, k: int) -> DataFrame:
    """For each item the ``k`` items most often among the next ``reach`` records of its session.

    The neighbours come from one ordered pass (leads), not from a join of the log
    with itself.
    """
    w = Window.partitionBy(*session).orderBy(*order)
    ahead = log.select(F.col(item).alias("item"), F.array(*[F.lead(item, i).over(w) for i in range(1, reach + 1)]).alias("next"))
    pairs = ahead.select("item", F.explode("next").alias("other")).where("other is not null and other <> item").groupBy("item", "other").agg(F.count("*").alias("n"))
    best = Window.partitionBy("item").orderBy(F.desc("n"), "other")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def keep_last(log: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Retention by count: the first ``n`` rows of ``order`` in every partition."""
    return log.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def keep_since(log: DataFrame, ts: str, now: str, max_age_seconds: int) -> DataFrame:
    """Retention by age."""
    return log.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {max_age_seconds} seconds"))


def recent_window(log: DataFrame, session: str, order: Sequence[str], item: str, n: int) -> DataFrame:
    """Each record with the session's last ``n`` items up to it."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(-n + 1, 0)
    return log.withColumn("recent", F.collect_list(item).over(w))


def sequential_keys(log: DataFrame, partition: Sequence[str], order: Sequence[str], key: str, max_step: int = 5, ascending: bool = False) -> DataFrame:
    """Whether keys count up: the share of neighbours whose trailing numbers differ by at most ``max_step``.

    ``ascending`` takes all digits of the key and only steps above 0.
    """
    digits = F.regexp_replace(key, r"\D", "") if ascending else F.regexp_extract(key, r"(\d+)$", 1)
    w = Window.partitionBy(*partition).orderBy(*order)
    d = log.withColumn("_x", digits.try_cast("bigint")).withColumn("_d", F.col("_x") - F.lag("_x").over(w))
    near = (F.col("_d") > 0) & (F.col("_d") <= max_step) if ascending else F.abs("_d") <= max_step
    share = F.coalesce(F.avg(F.when(F.col("_d").isNotNull(), near.cast("int"))), F.lit(0.0))
    return d.groupBy(*partition).agg(F.count("*").alias("records"), share.alias("share"), ((share > 0.5) & (F.count("*") >= 5)).alias("sequential"))


def access_pattern(reads: Column, writes: Column, sequential: Column) -> Column:
    """Ordered rules: write once, write heavy, repeated, sequential, random."""
    total = reads + writes
    return (
        F.when((writes == 1) & (reads > 0), "write_once_read_many")
        .when(F.coalesce(F.try_divide(reads, total), F.lit(0.0)) < 0.3, "write_heavy")
        .when(reads > 100, "repeated")
        .when(sequential, "sequential")
        .otherwise("random")
    )


def score_predictions(items: DataFrame, runs: DataFrame, hot: DataFrame, neighbours: int = 2, ahead: int = 4) -> DataFrame:
    """Likelihood of each item: near a hot item, or ahead of a run; the best of all patterns.

    Patterns are expanded into the few items they favour, so scoring is an equi-join.
    """
    near = hot.select(F.explode(F.sequence(F.col("item") - neighbours, F.col("item") + neighbours)).alias("item"), (F.lit(0.9)).alias("s"))
    reach = runs.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda i: F.struct((F.col("last") + i * F.col("direction")).alias("item"), (1.0 - 0.15 * (i - 1)).cast("double").alias("s")))).alias("e")).select("e.item", "e.s")
    return items.join(near.unionByName(reach).groupBy("item").agg(F.max("s").alias("score")), "item", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def prediction_batches(scored: DataFrame, batch: int) -> DataFrame:
    """Batches in order of score, with their items, mean confidence and priority."""
    ranked = number_rows(scored.withColumn("_worst", -F.col("score")), ["_worst", "item"], "_i")
    grouped = ranked.groupBy(F.expr(f"cast(_i div {batch} as int)").alias("batch")).agg(F.sort_array(F.collect_list("item")).alias("items"), F.avg("score").alias("confidence"))
    return grouped.withColumn("priority", F.when(F.col("confidence") > 0.8, "high").when(F.col("confidence") > 0.5, "normal").otherwise("low"))


def increment_key(key: Column) -> Column:
    """The key with its last number one higher, padded to the same width; null without a number."""
    head, number, tail = (F.regexp_extract(key, r"^(.*?)(\d+)(\D*)$", i) for i in (1, 2, 3))
    following = (number.try_cast("bigint") + 1).cast("string")
    return F.when(number != "", F.concat(head, F.when(F.length(following) < F.length(number), F.lpad(following, F.length(number), F.lit("0"))).otherwise(following), tail))


def access_totals(log: DataFrame, item: str, latency: str, hot: int) -> DataFrame:
    """Accesses, distinct items, mean latency, and how many items are hot (at least ``hot`` accesses) and their share."""
    per = log.groupBy(item).agg(F.count("*").alias("n"), F.sum(latency).alias("ms"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per.agg(
        total.alias("accesses"), F.count("*").alias("items"), F.coalesce(F.try_divide(F.sum("ms"), total.cast("double")), F.lit(0.0)).alias("mean_latency"),
        F.count_if(F.col("n") >= hot).alias("hot"), F.coalesce(F.try_divide(F.count_if(F.col("n") >= hot).cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("hot_share"),
    )


#: Parts of a key that tell a workload, by kind; training shows in ascending batches.
WORKLOADS = {
    "checkpointing": ("checkpoint", ".ckpt", ".pt", ".safetensors"),
    "preprocessing": ("preprocess", "transform", "augment"),
    "evaluation": ("eval", "valid", "test"),
    "inference": ("model", "weight"),
}


def workload(log: DataFrame, session: str, order: Sequence[str], key: str) -> DataFrame:
    """The workload of every session, by what its keys contain; ordered rules, the first that holds."""
    holds = {kind: F.bool_or(_any_of(F.col(key), parts)) for kind, parts in WORKLOADS.items()}
    holds["inference"] = F.bool_or(_any_of(F.col(key), WORKLOADS["inference"]) | F.col(key).endswith(".bin"))
    marks = log.groupBy(session).agg(*[c.alias(f"_{kind}") for kind, c in holds.items()])
    batches = sequential_keys(log, [session], order, key, 10, ascending=True).select(session, (F.col("share") > 0.5).alias("_training"))
    rule = F.when(F.col("_checkpointing"), "checkpointing").when(F.col("_training"), "training")
    for kind in ("preprocessing", "evaluation", "inference"):
        rule = rule.when(F.col(f"_{kind}"), kind)
    return marks.join(batches, session).select(session, rule.otherwise("unknown").alias("workload"))


def _any_of(key: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(key, F.lit(p))
    return out


def related_files(keys: DataFrame, session: str, key: str, order: Sequence[str], most: int = 20) -> DataFrame:
    """Weight files that go with the model files a session has read: ``session, at, file``, the first ``most``."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(key, r"(\.bin)+$", ""), r"(\.pt)+$", ""), r"(\.safetensors)+$", "")
    w = Window.partitionBy(session).orderBy(*order)
    found = keys.where(F.contains(F.col(key), F.lit("model"))).withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") * 2 < most)
    files = F.posexplode(F.array(F.concat(base, F.lit(".bin")), F.concat(base, F.lit(".safetensors")))).alias("_i", "file")
    return found.select(session, "_n", files).select(session, (F.col("_n") * 2 + F.col("_i")).alias("at"), "file").where(F.col("at") < most)


def prefetch(scored: DataFrame, item: str, score: str, threshold: float, k: int) -> DataFrame:
    """The ``k`` best items that reach the threshold; ties to the smaller item."""
    return scored.where(F.col(score) >= threshold).orderBy(F.desc(score), item).limit(k)


def first_suggestions(predictions: DataFrame, session: str, order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` predictions of every session, as they come."""
    return keep_last(predictions, [session], [F.col(c) for c in order], k)


def recent_sequential(log: DataFrame, partition: Sequence[str], order: Sequence[str], key: str, is_read: Column, recent: int = 100, max_step: int = 5) -> DataFrame:
    """:func:`sequential_keys` over the last ``recent`` records of a partition, of which only reads count."""
    newest = keep_last(log, partition, [F.desc(c) for c in order], recent)
    return sequential_keys(newest.where(is_read), partition, order, key, max_step)


def next_keys(keys: DataFrame, key: str, n: int) -> DataFrame:
    """The next ``n`` keys after each: its last number counted up, padded to the same width."""
    head, number, tail = (F.regexp_extract(key, r"^(.*?)(\d+)(\D*)$", i) for i in (1, 2, 3))
    following = lambda i: (number.try_cast("bigint") + i).cast("string")
    padded = lambda x: F.when(F.length(x) < F.length(number), F.lpad(x, F.length(number), F.lit("0"))).otherwise(x)
    ahead = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("step"), F.concat(head, padded(following(i)), tail).alias("next")))
    return keys.where(number != "").select(key, F.explode(ahead).alias("_n")).select(key, "_n.step", "_n.next")


def key_parts(key: Column) -> dict[str, Column]:
    """Folder (with its slash), name and ending (without the dot) of a key; empty where there is none."""
    name = F.substring_index(key, "/", -1)
    return {"folder": F.regexp_extract(key, r"^(.*/)?", 1), "name": name, "ending": F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)}


def payload(objects: DataFrame, key: str, size: str, entropy: Column, sample: int = 50) -> DataFrame:
    """Objects, bytes, and the mean entropy over every n-th object by key, ``sample`` of them at most."""
    from lakeglass.operators.numbering import number_rows

    numbered = number_rows(objects, [key], "_i")
    n = objects.count()
    step = max(1, -(-n // sample))
    picked = numbered.where(F.col("_i") % step == 0).agg(F.avg(entropy).alias("mean_entropy"), F.count("*").alias("sampled"), F.lit(1).alias("_one"))
    total = objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.lit(1).alias("_one"))
    return total.join(picked, "_one").drop("_one")
