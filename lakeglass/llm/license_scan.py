"""License scans: Dice coefficient over word bigrams against templates (native).

A text is cut into candidate segments at three grains (lines, sentences, the
whole text).  A segment and a template are compared only if their bigram counts
allow the threshold: with Dice ``2c / (a + b) >= t`` and ``c <= min(a, b)``, ``a``
must lie between ``b * t / (2 - t)`` and ``b * (2 - t) / t``.  Besides, wherever
two neighbouring words are an anchor bigram of a template, the words around are
compared with it in a window of the template's length, laid so that the bigram
stands where the template has it; line breaks and sentence ends play no part, so a
statement that is wrapped, or in the middle of a sentence, is found.

Before any splitting, a text must hold an anchor word.  The anchors of a template
are a few words whose bigrams cannot all be missing from a match (a match
holds at least ``b * t / (2 - t)`` of the template's bigrams), so the test never
loses one.  Anchor bigrams are those with an anchor word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Licence statements, one per line as (identifier, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
    ("Proprietary", "All rights reserved"),
)


def normalise(text: str) -> list[str]:
    """Words of a text: ASCII letters and digits, lower-cased, everything else a gap."""
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams(words: list[str]) -> list[str]:
    """Distinct word bigrams in order of first appearance."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


@dataclass(frozen=True)
class Template:
    """A licence statement ready for matching; ``low``/``high`` bound a segment's bigrams."""

    license: str
    number: int
    words: tuple[str, ...]
    bigrams: tuple[str, ...]
    low: int
    high: int


def prepare(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    out = []
    for i, (name, text) in enumerate(templates):
        grams = bigrams(normalise(text))
        b = len(grams)
        out.append(Template(name, i, tuple(normalise(text)), tuple(grams), math.ceil(round(b * threshold / (2 - threshold), 9)), math.floor(round(b * (2 - threshold) / threshold, 9))))
    return out


def anchors(templates: list[Template], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every possible match holds at least one."""
    chosen: set[str] = set()
    for t in templates:
        need = math.ceil(round(len(t.bigrams) * threshold / (2 - threshold), 9))
        left = [g.split() for g in t.bigrams if not chosen & set(g.split())]
        while len(left) >= need:  # a match could consist of these alone
            # Long words are rare in other text; among them the one in most bigrams, then the first.
            words = [w for g in left for w in g]
            word = max(Counter(w for g in left for w in set(g)).items(), key=lambda x: (len(x[0]) >= 6, x[1], -words.index(x[0])))[0]
            chosen.add(word)
            left = [g for g in left if word not in g]
    return sorted(chosen)


def anchor_bigrams(templates: list[Template], known: list[str]) -> list[tuple[str, int, Template]]:
    """(bigram, its place, template) of every anchor bigram."""
    return [(f"{a} {b}", i, t) for t in templates for i, (a, b) in enumerate(zip(t.words, t.words[1:], strict=False)) if a in known or b in known]


def _words(segment: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(segment, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _windows(words: Column, templates: list[Template], known: list[str], threshold: float) -> Column:
    """The best match of a window at every anchor bigram, as ``dice, order, license``."""
    marks = anchor_bigrams(templates, known)
    table = F.array(
        *[F.struct(F.lit(g).alias("g"), F.lit(i).alias("at"), F.lit(len(t.words)).alias("k"), F.lit(t.license).alias("license"), F.lit(t.number).alias("number"), _strings(t.bigrams).alias("grams")) for g, i, t in marks]
    )
    bigram = lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))
    wanted = _strings(sorted({g for g, _, _ in marks}))
    first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: (i < F.size(words)) & F.array_contains(wanted, bigram(i)))

    def best(i: Column) -> Column:
        def score(t: Column) -> Column:
            begin = F.greatest(i - t["at"], F.lit(1))
            g = _grams(F.slice(words, begin, i - t["at"] + t["k"] - begin))
            dice = F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"]))
            return F.struct(dice.alias("dice"), (-t["number"]).alias("order"), t["license"].alias("license"))

        return F.array_max(F.transform(F.filter(table, lambda t: t["g"] == bigram(i)), score))

    return F.filter(F.transform(first, best), lambda m: m["dice"] >= threshold)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``n_matches``, ``licenses`` (sorted, distinct), ``best_license``, ``best_dice``.

    A segment counts as a match for its best template (highest Dice, then the
    first template), and so do the windows at one anchor bigram.  ``n_matches`` is
    the number of templates matched.  A document's best match is the highest Dice,
    ties to the smallest identifier.  Documents without a match, null or empty texts
    give 0, an empty list and nulls; an empty table gives an empty result.  Rows are
    judged one by one, so repeated rows, null ids, ties and skew cannot matter, and
    only the two named columns are read.  A very long text is scanned whole; beside
    its words only a number for each anchor bigram is held.
    """
    ready = prepare(templates, threshold)
    low = F.translate(F.coalesce(F.col("_text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = anchors(ready, threshold)
    anchor_re = "(?<![a-z0-9])(?:" + "|".join(known) + ")(?![a-z0-9])"
    has_anchor = F.lit(False)
    for word in known:
        # Looking for a string is much faster than the expression that also tests the edges.
        has_anchor = has_anchor | F.contains(F.col("_low"), F.lit(word))
    has_anchor = has_anchor & F.col("_low").rlike(anchor_re)
    least, most = min(t.low for t in ready), max(t.high for t in ready)
    lines = F.split(F.col("_low"), "\n")
    sentences = F.split(F.regexp_replace("_low", r"([.!?;])[^a-z0-9.\n]*[ \t\n\r]", "$1\n"), "\n")
    # Cheap tests first: an anchor, and as many characters as the smallest number of bigrams takes.
    segments = F.filter(F.array_distinct(F.concat(lines, sentences, F.array(F.col("_low")))), lambda s: (F.length(s) > 2 * least) & s.rlike(anchor_re))
    grams = F.transform(segments, lambda s: _grams(_words(s)))
    grams = F.filter(grams, lambda g: F.size(g).between(least, most))
    table = F.array(*[F.struct(F.lit(t.license).alias("license"), F.lit(t.number).alias("number"), F.lit(t.low).alias("low"), F.lit(t.high).alias("high"), _strings(t.bigrams).alias("grams")) for t in ready])

    def best(g: Column) -> Column:
        fit = F.filter(table, lambda t: F.size(g).between(t["low"], t["high"]))
        scored = F.transform(
            fit,
            lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"]))).alias("dice"), (-t["number"]).alias("order"), t["license"].alias("license")),
        )
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

    whole = F.filter(F.transform(grams, best), lambda m: m.isNotNull())
    matches = F.concat(whole, _windows(F.col("_words"), ready, known, threshold))
    top = F.array_max(F.transform(F.col("_matches"), lambda m: m["dice"]))
    empty = F.array().cast("array<struct<dice:double,order:int,license:string>>")
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .withColumn("_low", low)
        .withColumn("_words", F.when(has_anchor, _words(F.col("_low"))))
        .select("_id", F.when(F.col("_words").isNotNull(), matches).otherwise(empty).alias("_matches"))
        .select(
            F.col("_id").alias(id_col),
            F.size(F.array_distinct(F.transform("_matches", lambda m: m["order"]))).alias("n_matches"),
            F.array_sort(F.array_distinct(F.transform("_matches", lambda m: m["license"]))).alias("licenses"),
            F.array_min(F.transform(F.filter("_matches", lambda m: m["dice"] == top), lambda m: m["license"])).alias("best_license"),
            top.alias("best_dice"),
        )
    )


def _grams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def duckdb_sql(source: str = "documents", templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan for DuckDB, with ``licenses`` joined by commas: no anchor words, every segment meets every template."""
    ready = prepare(templates, threshold)

    def listed(grams) -> str:
        return "[" + ", ".join("'" + g + "'" for g in grams) + "]"

    values = ", ".join(f"('{t.license}', {t.number}, {t.low}, {t.high}, {len(t.words)}, {listed(t.bigrams)})" for t in ready)
    marks = ", ".join(f"('{g}', {i}, {t.number})" for g, i, t in anchor_bigrams(ready, anchors(ready, threshold)))
    return f"""
with t(license, number, low, high, k, grams) as (values {values}), e(bigram, place, number) as (values {marks}),
d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from {source}),
s as (select r, unnest(list_distinct(list_concat(list_concat(string_split(low, chr(10)), string_split(regexp_replace(low, '([.!?;])[^a-z0-9.\\n]*[ \\t\\n\\r]', '\\1' || chr(10), 'g'), chr(10))), [low]))) as seg from d),
w as (select r, seg, list_filter(string_split(regexp_replace(seg, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as words from s),
g as (select r, seg, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams from w),
m as (select r, max((dice, -number, license)) as best
      from (select g.r, g.seg, t.license, t.number, 2.0::double * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) as dice from g join t on len(g.grams) between t.low and t.high)
      where dice >= {threshold} group by r, seg),
x as (select r, list_filter(string_split(regexp_replace(low, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as words from d),
p as (select r, i, words[i] || ' ' || words[i + 1] as bigram from (select r, words, unnest(range(1, len(words))) as i from x)),
a as (select p.r, p.i, t.license, t.number, t.grams, greatest(p.i - e.place, 1) as b, p.i - e.place + t.k - 1 as z from p join e on p.bigram = e.bigram join t on t.number = e.number),
c as (select a.r, a.i, a.license, a.number, a.grams, x.words[a.b:a.z] as part from a join x on a.r = x.r),
y as (select r, i, license, number, grams, list_distinct(list_transform(range(1, len(part)), lambda j: part[j] || ' ' || part[j + 1])) as found from c),
n as (select r, max((dice, -number, license)) as best from (select r, i, license, number, 2.0::double * len(list_intersect(found, grams)) / (len(found) + len(grams)) as dice from y) where dice >= {threshold} group by r, i),
q as (select r, best[1] as dice, best[2] as number, best[3] as license from (select * from m union all select * from n)),
top as (select r, max(dice) as dice from q group by r),
per as (select q.r, count(distinct q.number) as n, array_to_string(list_sort(list(distinct license)), ',') as licenses, min(license) filter (where q.dice = top.dice) as best_license, max(q.dice) as best_dice from q join top on q.r = top.r group by q.r)
select d.doc_id, cast(coalesce(n, 0) as int) as n_matches, coalesce(licenses, '') as licenses, best_license, best_dice from d left join per on d.r = per.r"""
