import random
import zlib

from pyspark.sql import functions as F

from lakeglass.llm import kd_sharding, license_scan, url_rules


def check_shards(rows, n_shards, largest):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total = [sum(r["size"] for r in by.get(s, [])) for s in range(n_shards)]
    mean = sum(total) / n_shards
    # Every cut may miss by one document and the tolerance.
    assert max(abs(t - mean) for t in total) <= 3 * largest + 0.01 * mean
    return by


def test_shards_are_even_with_a_hot_text(spark):
    rnd = random.Random(1)
    hot = "the same words " * 20
    rows = [(i, hot if i % 3 == 0 else "x" * rnd.randrange(10, 900), "a", "src0" if i % 2 else f"s{i % 9}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    got = kd_sharding.kd_shard(df, n_shards=24).collect()
    assert len(got) == 4000
    check_shards(got, 24, 908)
    texts = {i: t.encode() for i, t, _, _ in rows}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in got)


def test_shards_do_not_depend_on_the_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = {tuple(r) for r in kd_sharding.kd_shard(docs, n_shards=7).collect()}
    assert a == {tuple(r) for r in kd_sharding.kd_shard(docs.repartition(5).orderBy(F.rand(3)), n_shards=7).collect()}


def cut_by_hand(rows, first, k, span):
    """The tree over rows (size, places, hash), cut where the sorted rows' bytes come closest to the share."""
    if k == 1 or not rows:
        return {id(r): first for r in rows}
    ranges = [max(r[1][d] for r in rows) - min(r[1][d] for r in rows) for d in range(len(span))]
    dim = max(range(len(span)), key=lambda d: (ranges[d] / span[d], -d))
    order = sorted(rows, key=lambda r: (r[1][dim], r[2]))
    target, total, at = sum(r[0] for r in rows) * (k // 2) / k, 0, 0
    while at < len(order) and total + order[at][0] < target:
        total += order[at][0]
        at += 1
    if at < len(order) and target - total > total + order[at][0] - target:
        at += 1
    return cut_by_hand(order[:at], first, k // 2, span) | cut_by_hand(order[at:], first + k // 2, k - k // 2, span)


def test_tree_like_brute_force(spark, small, odd_docs):
    for docs, k in ((spark.read.parquet(f"{small}/documents.parquet"), 24), (odd_docs, 5)):
        meta = kd_sharding.coordinates(docs, "doc_id", "text", ("source", "lang"))
        rows = [(r["size"], r["_places"], r["_hash"], r["_id"], r["text_crc32"]) for r in meta.collect()]
        span = [max(1, max(r[1][d] for r in rows) - min(r[1][d] for r in rows)) for d in range(4)]
        want = cut_by_hand(rows, 0, k, span)
        got = kd_sharding.grow(meta, k).collect()
        key = lambda r: (r["_id"], r["text_crc32"], tuple(r["_hash"]), r["shard"])
        assert sorted(map(key, got)) == sorted((r[3], r[4], tuple(r[2]), want[id(r)]) for r in rows)


def test_many_leaves(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97 + 3).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5000).alias("source"), F.lit("en").alias("lang"))
    got = kd_sharding.kd_shard(df, n_shards=2000).groupBy("shard").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 2000 and all(r["n"] == r["m"] + 1 for r in got)
    mean = sum(r["w"] for r in got) / 2000
    assert max(abs(r["w"] - mean) for r in got) <= 4 * 107


def test_hot_and_null_ids_are_cut(spark):
    rows = [(7, "the same text", "a", "s")] * 3000 + [(None, "x" * (i % 50), None, "s") for i in range(3000)] + [(i, "y" * (i % 90), "b", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(6)
    got = kd_sharding.kd_shard(df, n_shards=24).collect()
    assert len(got) == 9000
    check_shards(got, 24, 98)


def test_target_bytes_and_odd_rows(odd_docs, no_docs):
    got = kd_sharding.kd_shard(odd_docs, target_bytes=60_000).collect()
    assert len(got) == odd_docs.count() and {r["doc_id"]: r["size"] for r in got}[2] == 8
    assert kd_sharding.kd_shard(no_docs, n_shards=24).count() == 0
    assert {r["shard"] for r in kd_sharding.kd_shard(odd_docs, n_shards=1).collect()} == {0}


URLS = [
    ("http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"), ("https://a.example.org/en/12?x#y", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("ftp://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://com/de/q", "com", "/de/q", "com/de/", "block"), ("http://x.com/dex", "x.com", "/dex", None, "allow"),
    ("http://x.org", "x.org", "", None, "allow"), ("http://x.org?/a", "x.org", "", None, "allow"), ("x.org/es/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
    ("http://x.net/a://b/c", "x.net", "/a://b/c", None, "allow"), ("http://ÀB.org/", "Àb.org", "/", "org/", "allow"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], "c", "d") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, key string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.filter_urls(df, labels).collect()}
    assert [(g["host"], g["path"], g["rule"], g["verdict"]) for g in (got[i] for i in range(len(URLS)))] == [u[1:] for u in URLS]
    assert url_rules.filter_urls(df.where("false"), labels).count() == 0


def mined_by_hand(baskets, support, confidence):
    """All rules by counting every subset of every basket."""
    from itertools import combinations

    counts, bad = {}, {}
    for tokens, is_bad in baskets:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                counts[c] = counts.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + is_bad
    out = {}
    for c, n in counts.items():
        for verdict, m in (("block", bad[c]), ("allow", n - bad[c])):
            if m >= support * len(baskets) and m / n >= confidence:
                out[c, verdict] = m / n
    return {(c, v): p for (c, v), p in out.items() if not any(v == w and set(d) < set(c) and q >= p for (d, w), q in out.items())}


def test_mining_like_brute_force(spark):
    rnd = random.Random(3)
    baskets = []
    for _ in range(300):
        tokens = sorted({rnd.choice(["host:a", "host:b"]), rnd.choice(["path:x", "path:y", "path:z"]), rnd.choice(["query:q", "fragment", "scheme:http"])})
        baskets.append((tokens, rnd.random() < (0.9 if "host:a" in tokens and "path:x" in tokens else 0.2)))
    df = spark.createDataFrame(baskets, "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(df, min_support=0.03, min_confidence=0.6)
    got = {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in rules.collect()}
    want = mined_by_hand(baskets, 0.03, 0.6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert (("host:a", "path:x"), "block") in got
    sets = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(baskets)], "key bigint, tokens array<string>")
    hits = {r["key"]: (r["mined_verdict"], r["mined_confidence"]) for r in url_rules.apply_rules(sets, rules).collect()}
    for i, (tokens, _) in enumerate(baskets):
        fits = [p for (c, v), p in want.items() if set(c) <= set(tokens)]
        assert (i in hits) == bool(fits) and (not fits or abs(hits[i][1] - max(fits)) < 1e-12)


def test_verdicts_like_brute_force(spark):
    """The whole operator: labels by the number in the path, every subset mined, every rule tried on every page."""
    rnd = random.Random(6)
    hosts = ["a.example.org", "b.example.com", "shop.net", "news.net"]
    rows = [(i, f"{rnd.choice(['http', 'https'])}://{rnd.choice(hosts)}/{rnd.choice(['fr', 'de', 'es', 'buy'])}/{i}{rnd.choice(['.html', '', '?ref=x'])}") for i in range(240)] + [(900, None), (901, "no scheme"), (902, "http://news.net/buy/")]
    labels = [(i, 0 if "buy" in u and "shop" in u or rnd.random() < 0.1 else 1, int("/de/" in u and rnd.random() < 0.8)) for i, u in rows[:200]]
    labels += [(3, None, None), (3, 1, 0), (77_777, 0, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    url, host, path = F.col("url"), url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    tokens = {r["page_id"]: r["t"] for r in pages.select("page_id", url_rules.url_tokens(F.coalesce(url, F.lit("")), host, path).alias("t")).collect()}
    bad = {}
    for i, quality, toxic in labels:
        bad[i] = bad.get(i, False) or quality == 0 or toxic == 1
    baskets = [(tokens[i], bad[i]) for i, _ in rows if i in bad]
    support = max(0.02, 5 / len(baskets))
    rules = mined_by_hand(baskets, support, 0.6)
    counts = {(c, v): sum(set(c) <= set(t) and b == (v == "block") for t, b in baskets) for c, v in rules}
    got = {r["page_id"]: r for r in url_rules.filter_urls(pages, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), min_support=0.02).collect()}
    assert len(got) == len(rows)
    fired_any = 0
    for i, u in rows:
        fires = [(p, counts[c, v] / len(baskets), v == "block") for (c, v), p in rules.items() if set(c) <= set(tokens[i])]
        fired_any += bool(fires)
        mined = ("block" if max(fires)[2] else "allow") if fires else "allow"
        fixed = [r for r in url_rules.HOST_RULES if u and (got[i]["host"] == r.host or got[i]["host"].endswith("." + r.host)) and got[i]["path"].startswith(r.path)]
        want = max(fixed, key=lambda r: len(r.name)).verdict if fixed else mined
        assert got[i]["verdict"] == want and got[i]["rule"] == (max(fixed, key=lambda r: len(r.name)).name if fixed else None), u
    assert fired_any > 100


def scan_by_hand(text, threshold=license_scan.THRESHOLD):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = low.split("\n") + re.sub(r"([.!?;])[^a-z0-9.\n]*[ \t\n\r]", r"\1\n", low).split("\n") + [low]
    ready = license_scan.prepare()

    def dice(words, t):
        g = set(license_scan.bigrams(words))
        return (2.0 * len(g & set(t.bigrams)) / (len(g) + len(t.bigrams)), -t.number, t.license)

    found = []
    for part in dict.fromkeys(parts):
        words = license_scan.normalise(part)
        scored = [dice(words, t) for t in ready if len(words) > 1]
        if scored and max(scored)[0] >= threshold:
            found.append(max(scored))
    # Windows: every template is laid over every anchor bigram of the whole text.
    words, known = license_scan.normalise(low), set(license_scan.anchors(ready))
    for i in range(len(words) - 1):
        scored = []
        for t in ready:
            for j in range(len(t.words) - 1):
                if t.words[j : j + 2] == tuple(words[i : i + 2]) and known & set(t.words[j : j + 2]):
                    scored.append(dice(words[max(0, i - j) : i - j + len(t.words)], t))
        if scored and max(scored)[0] >= threshold:
            found.append(max(scored))
    top = max((f[0] for f in found), default=None)
    return len({f[1] for f in found}), sorted({f[2] for f in found}), min((f[2] for f in found if f[0] == top), default=None), top


def test_wrapped_and_embedded_notices_are_found(spark):
    calm = "The river runs by the old house and the mill\nand on to the sea. "
    wrapped = {
        "Apache-2.0": "Licensed under the Apache License,\n * Version 2.0",
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
        "GPL-3.0": "This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License version 3",
        "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
        "Proprietary": "copyright of the mill, all rights reserved by the owner of it",
    }
    rows = [(name, calm * 20 + "which is " + text + " as everybody knows who " + calm * 20) for name, text in wrapped.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r["doc_id"]: r["licenses"] for r in license_scan.scan(df).collect()} == {name: [name] for name in wrapped}
    close = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"
    got = license_scan.scan(spark.createDataFrame([("a", calm + close + " and " + calm)], "doc_id string, text string")).first()
    assert got["licenses"] == ["CC-BY-SA-4.0"]


def test_licenses_like_brute_force(spark, odd_docs, no_docs):
    rnd = random.Random(8)
    texts = []
    for name, t in license_scan.TEMPLATES:
        words = t.split()
        texts += [t, t.upper(), "First. " + t + ". Then more words follow here\nand here", " ".join(words[: len(words) // 2])]
        for _ in range(6):
            w = list(words)
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["foo", "the", "License", "under"])
            texts.append("intro line\n" + " ".join(w) + rnd.choice([".", "!\n", " ; tail of words"]))
    texts += [None, "", "no license here", "license " * 50, "Of%%% Licensed%%% under*** the&&& Apache%%% License,*** Version%%% 2.0."]
    texts += ["some words before " + t.replace(" ", "\n", 3) + " and some behind, " + t for _, t in license_scan.TEMPLATES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in license_scan.scan(df).collect():
        assert (r["n_matches"], r["licenses"], r["best_license"], r["best_dice"]) == scan_by_hand(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert license_scan.scan(odd_docs).count() == odd_docs.count() and license_scan.scan(no_docs).count() == 0


def test_anchors_are_in_every_possible_match():
    ready = license_scan.prepare()
    known = set(license_scan.anchors(ready))
    for t in ready:
        without = [g for g in t.bigrams if not known & set(g.split())]
        a = len(t.bigrams) - len(without)
        # Even a segment of exactly the bigrams without an anchor stays below the threshold.
        assert 2 * len(without) / (len(without) + len(t.bigrams)) < license_scan.THRESHOLD and a > 0


def test_plans_have_no_python(spark, small):
    from lakeglass.llm import queries

    for name in ("op4_url_filters", "op5_sharding", "op10_license_scans"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow")), name
