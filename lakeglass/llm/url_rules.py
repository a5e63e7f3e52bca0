"""URL filters: fixed host/path rules, then mined association rules (native).

Spark's FP-growth mines combinations of URL tokens from labelled pages.  Rules
``tokens => bad`` or ``tokens => good`` that pass the support and confidence
bounds are kept, and a rule is dropped if a rule with fewer of the same tokens is
at least as sure.  Pages meet rules through an inverted index, token -> rule: a rule
is listed under its rarest token, and fires where the page has the others too.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeglass.llm.session import materialise

BAD, GOOD = "label:bad", "label:good"


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed rules of the standard policy.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """The host with A-Z lower-cased; empty for a null url or one without ``://``."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty like :func:`host_of`."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, both null where none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: scheme, host, its suffixes, path words, file ending, query keys, fragment.

    Path parts made of digits name single pages and are left out.
    """
    labels = F.split(host, r"\.")
    suffixes = F.when(
        F.size(labels) > 1,
        F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))),
    ).otherwise(F.array(F.concat(F.lit("host:"), host)))
    words = F.transform(
        F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda p: (p != "") & ~p.rlike(r"^\d+$")),
        lambda p: F.concat(F.lit("path:"), F.lower(p)),
    )
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda k: k != ""), lambda k: F.concat(F.lit("query:"), F.substring_index(k, "=", 1)))
    extra = F.array_compact(
        F.array(
            F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
            F.when(ending != "", F.concat(F.lit("ending:"), F.lower(ending))),
            F.when(F.instr(url, "#") > 0, F.lit("fragment")),
        )
    )
    return F.array_sort(F.array_distinct(F.concat(suffixes, words, keys, extra)))


def mine_rules(labelled: DataFrame, *, min_support: float, min_confidence: float, min_pages: int = 5) -> DataFrame:
    """Mine ``rule_id, tokens, n_tokens, verdict, confidence, support`` from ``tokens, bad``.

    A rule needs the part ``min_support`` of the labelled pages, and ``min_pages`` of them.

    Dominated rules (a subset of the tokens gives the same verdict at least as
    surely) are pruned.
    """
    spark = labelled.sparkSession
    schema = "rule_id bigint, tokens array<string>, n_tokens int, verdict string, confidence double, support double"
    baskets = materialise(labelled.select(F.concat("tokens", F.array(F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD)))).alias("items")))
    if not (n := baskets.count()):
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_pages / n)), minConfidence=min_confidence).fit(baskets)
    side = F.col("consequent")[0]
    labels = F.array(F.lit(BAD), F.lit(GOOD))
    rules = model.associationRules.where(side.isin(BAD, GOOD) & ~F.arrays_overlap("antecedent", labels)).select(
        F.array_sort("antecedent").alias("tokens"), F.when(side == BAD, "block").otherwise("allow").alias("verdict"), "confidence", "support"
    )
    rules = materialise(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")))
    # A dominating rule has a proper subset of the tokens: they meet on a shared token.
    small = rules.select(F.col("rule_id").alias("small_id"), F.col("tokens").alias("small"), F.col("verdict"), F.col("confidence").alias("small_confidence"), F.explode("tokens").alias("token"))
    large = rules.select("rule_id", "tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    dominated = (
        large.join(small, ["token", "verdict"])
        .where((F.size("small") < F.size("tokens")) & (F.col("small_confidence") >= F.col("confidence")) & (F.size(F.array_except("small", "tokens")) == 0))
        .select("rule_id")
        .distinct()
    )
    return materialise(rules.join(dominated, "rule_id", "left_anti").select("rule_id", "tokens", F.size("tokens").alias("n_tokens"), "verdict", "confidence", "support"))


def apply_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each row of ``key, tokens`` the surest rule that fires (no row where none does).

    Frequent tokens (a scheme that every page has) list no rule that has a rarer one,
    so a page meets few rules that do not fire.
    """
    met = token_sets.select("key", "tokens", F.explode("tokens").alias("token"))
    listed = rules.select("rule_id", F.explode("tokens").alias("token"))
    # size: tokens of the rules, each on a share min_support of the labelled pages at least
    often = met.join(F.broadcast(listed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("often"))
    rarest = listed.join(often, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    index = rules.join(rarest, "rule_id").select("rule_id", F.col("tokens").alias("wanted"), "verdict", "confidence", "support", "token")
    fired = met.join(index, "token").where(F.size(F.array_except("wanted", "tokens")) == 0)
    # Surest first; at equal confidence the better supported, then block, then the smaller id.
    best = F.max(F.struct("confidence", "support", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"), -F.col("rule_id").alias("order"), "verdict", "rule_id"))
    return fired.groupBy("key", "tokens").agg(best.alias("best")).select("key", "tokens", F.col("best.verdict").alias("mined_verdict"), F.col("best.rule_id").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, *, rules: Sequence[HostRule] = HOST_RULES, min_support: float = 0.005, min_confidence: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: ``page_id, host, path, rule, verdict`` and the mined rule behind it.

    ``labels`` has ``doc_id, quality, toxic``; the last number in a path names the
    document that the page shows, and a page is bad if its document has quality 0
    or toxic 1 in any of its label rows.  A fixed rule decides first; else the
    surest mined rule; else the page is allowed.

    A null url, or one without ``://``, has an empty host and path and is allowed
    unless a mined rule fires.  Empty tables, no labels or no surviving rules give
    the fixed verdicts and ``allow``.  Repeated rows and null ids each get a row; at
    equal confidence the better supported rule decides, then block, then the smaller
    rule id.  A very long url is one set of tokens like any other.  Only the named
    columns are read, so other columns cannot clash.
    """
    url = F.col("_url")
    base = pages.select(F.col(id_col).alias("_page"), F.col(url_col).alias("_url"))
    base = base.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    tokens = url_tokens(F.coalesce(url, F.lit("")), F.col("host"), F.col("path"))
    doc = F.regexp_extract("path", r"(\d{1,18})[^\d]*$", 1)
    judged = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    labelled = base.where(doc != "").select(doc.cast("long").alias("doc_id"), tokens.alias("tokens")).join(judged, "doc_id").select("tokens", "bad")
    mined = mine_rules(labelled, min_support=min_support, min_confidence=min_confidence)
    # Pages with equal token sets are judged once, so a host with a third of all pages is one row here.
    base = base.withColumn("tokens", tokens).withColumn("key", F.xxhash64("tokens"))
    sets = base.select("key", "tokens").distinct()
    hits = materialise(apply_rules(sets, mined))
    name, verdict = match_rules(F.col("host"), F.col("path"), rules)
    return base.join(hits, ["key", "tokens"], "left").select(
        F.col("_page").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, "mined_verdict", F.lit("allow")).alias("verdict"), "mined_rule", "mined_confidence"
    )
