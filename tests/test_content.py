import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeglass.functions import content


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([16, 64, 256]))
def test_chunks_cover_the_data(data, target):
    for cut in (content.monotone_chunks, content.rolling_chunks):
        parts = cut(data, target)
        assert b"".join(data[o : o + n] for o, n in parts) == data
        assert all(n <= 4 * target for _, n in parts)
        assert all(n >= target // 4 for _, n in parts[:-1])


def test_monotone_cut():
    assert content.monotone_chunks(b"\x09" * 20 + b"\x01\x02\x03\x04\x05" + b"\x00" * 10, 16) == [(0, 25), (25, 10)]


def test_layers_nest():
    data = random.Random(1).randbytes(40_000) + b"ab" * 4000
    layers = content.chunk_layers(data, (64, 512, 4096))
    for below, above in zip(layers, layers[1:]):
        assert {o for o, _ in above} <= {o for o, _ in below}
        assert sum(n for _, n in above) == len(data)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4096))
def test_entropy_bounds(data):
    assert 0 <= content.entropy(data) <= 1


def test_entropy_known():
    assert content.entropy(b"") == 0 and content.entropy(b"aaaa") == 0
    assert content.entropy(bytes(range(256))) == 1.0


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=500), st.integers(1, 6), st.integers(1, 4), st.randoms())
def test_erasure_round_trip(data, k, m, rnd):
    shards = content.erasure_encode(data, k, m)
    lost = set(rnd.sample(range(k + m), m))
    assert content.erasure_decode([None if i in lost else s for i, s in enumerate(shards)], k, m, len(data)) == data


def test_period():
    assert content.period(b"abcabcabc") == 3 and content.period(b"abcd") == 4 and content.period(b"") == 0


def test_merkle(spark):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(7)]

    def root(nodes):
        while len(nodes) > 1:
            nodes = [hashlib.sha256(nodes[i] + nodes[min(i + 1, len(nodes) - 1)]).digest() for i in range(0, len(nodes), 2)]
        return nodes[0]

    rows = [(n, leaves[:n]) for n in range(0, 8)]
    df = spark.createDataFrame(rows, "n int, x array<binary>").select("n", content.merkle_root(F.col("x")).alias("r"))
    for r in df.collect():
        assert bytes(r["r"]) == (root(leaves[: r["n"]]) if r["n"] else bytes(32))
    proofs = [(leaves[i], content.merkle_proof(leaves, i), root(leaves), i) for i in range(7)]
    ok = spark.createDataFrame(proofs, "leaf binary, proof array<binary>, root binary, i int")
    assert ok.select(content.merkle_verify(F.col("leaf"), F.col("proof"), F.col("root"), F.col("i")).alias("ok")).where("ok").count() == 7
    assert ok.select(content.merkle_verify(F.col("leaf"), F.col("proof"), F.col("root"), F.col("i") + 1).alias("ok"), "i").where("ok and i < 6").count() == 0


def test_weight(spark):
    h = hashlib.sha256(b"x").hexdigest()
    got = spark.range(1).select(content.weight(F.lit(h)).alias("w")).first()["w"]
    assert int(got) == int.from_bytes(bytes.fromhex(h)[:8], "little")


def test_columns_agree_with_the_functions(spark):
    import os
    import random
    import struct

    rnd = random.Random(3)
    values = [b"", b"a", bytes(range(256)) * 3, b"aaaabbbb" * 9, os.urandom(300), struct.pack("<16f", *[rnd.random() * 10**rnd.randrange(0, 13) for _ in range(16)])]
    values += [struct.pack("<f", x) * 8 for x in (1e10, 9.99e9, 1.0000001e10, float("inf"), float("nan"), -1e9)] + [bytes(rnd.choice([100, 110, 120, 200]) for _ in range(50)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, data binary")
    rows = df.select("k", content.entropy_of(F.col("data")).alias("e"), content.looks_like_floats(F.col("data")).alias("f"), content.neighbours_close(F.col("data")).alias("n")).collect()
    for r in rows:
        v = values[r["k"]]
        assert r["e"] == pytest.approx(content.entropy(v)) and r["f"] == content.is_float_array(v) and r["n"] == content.spatially_correlated(v), v


def test_weights_and_zeros(spark):
    hashes = ["0000000000000000", "0100000000000000", "0000000000000080", "0008000000000000", "ffffffffffffffff", "0000000000100000"]
    df = spark.createDataFrame([(h + "00" * 24,) for h in hashes], "h string")
    for r in df.select("h", content.weight(F.col("h")).cast("string").alias("w"), content.trailing_zeros(F.col("h")).alias("z")).collect():
        w = int.from_bytes(bytes.fromhex(r["h"][:16]), "little")
        assert int(r["w"]) == w and r["z"] == (64 if w == 0 else (w & -w).bit_length() - 1)


def test_proofs_as_columns(spark):
    import hashlib

    for n in (1, 2, 5, 8, 13):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        df = spark.createDataFrame([(leaves, i) for i in range(n)], "leaves array<binary>, i int")
        for r in df.select("i", content.merkle_proof_of(F.col("leaves"), F.col("i")).alias("p")).collect():
            assert [bytes(p) for p in r["p"]] == content.merkle_proof(leaves, r["i"])


def test_objects_in_shards_survive_losses(spark):
    import os

    data = [(i, os.urandom(n)) for i, n in enumerate((1, 2, 7, 100, 1001))] + [(90, b""), (91, None)]
    df = spark.createDataFrame(data, "k int, data binary")
    shards = content.encode_objects(df, "k", "data", 3, 2)
    back = {r["k"]: bytes(r["data"]) for r in content.decode_objects(shards.where("shard not in (0, 4)"), "k", 3, 2).collect()}
    assert back == {k: d for k, d in data if d}


def test_chunks_of_objects_cover_them(spark):
    import hashlib
    import random

    rnd = random.Random(2)
    data = [(i, bytes(rnd.randrange(256) for _ in range(n))) for i, n in enumerate((0, 1, 50, 5000, 20_000))] + [(9, None)]
    df = spark.createDataFrame(data, "k int, data binary")
    for method, cut in (("monotone", content.monotone_chunks), ("rolling", content.rolling_chunks)):
        got = sorted(tuple(r) for r in content.chunk_objects(df, "k", "data", 512, method).collect())
        assert got == [(k, i, o, n, hashlib.sha256(d[o : o + n]).hexdigest()) for k, d in data if d for i, (o, n) in enumerate(cut(d, 512))]
