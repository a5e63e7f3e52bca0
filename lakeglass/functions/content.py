"""Functions of object content: entropy, classification, chunking, hash trees, erasure codes.

Expressions where Spark has them; Arrow-batched numpy kernels for work on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entropy and classification --------------------------------------------------------


def entropy(data: bytes) -> float:
    """Shannon entropy of the bytes over 8, so 0 to 1; 0 for nothing."""
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    return float(max(0.0, -(p * np.log2(p)).sum() / 8.0))


def entropies(data: list[bytes | None]) -> np.ndarray:
    """:func:`entropy` of many values in one pass over their bytes."""
    sizes = np.fromiter((len(d) if d else 0 for d in data), dtype=np.int64, count=len(data))
    whole = np.frombuffer(b"".join(d for d in data if d), dtype=np.uint8)
    owner = np.repeat(np.arange(len(data)), sizes)
    counts = np.bincount(owner * 256 + whole, minlength=256 * len(data)).reshape(len(data), 256)
    p = counts / np.maximum(sizes, 1)[:, None]
    logs = np.log2(p, out=np.zeros_like(p), where=p > 0)
    return np.maximum(0.0, -(p * logs).sum(axis=1) / 8.0)


#: Bytes whose entropy is counted together.
ENTROPY_BYTES = 8_000_000


def entropy_of(column: Column) -> Column:
    @F.pandas_udf("double")
    def kernel(values: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        part: list[bytes | None] = []
        held = 0
        for v in values:
            part.append(v)
            held += len(v) if v else 0
            if held > ENTROPY_BYTES or len(part) == 4096:
                out.append(entropies(part))
                part, held = [], 0
        out.append(entropies(part))
        return pd.Series(np.concatenate(out), dtype=float)

    return kernel(column.cast("binary"))


def compression_strategy(e: Column) -> Column:
    return F.when(e > 0.95, "none").when(e > 0.7, "fast").when(e > 0.3, "balanced").otherwise("maximum")


def text_ratios(text: Column, size: Column | None = None) -> tuple[Column, Column]:
    """(share of ASCII bytes, share of printable bytes) of a text of ``size`` bytes, by default its own; 0 when empty."""
    n = (F.octet_length(text) if size is None else size).cast("double")
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7E\t\n\r]", ""))
    return F.coalesce(F.try_divide(ascii_.cast("double"), n), F.lit(0.0)), F.coalesce(F.try_divide(printable.cast("double"), n), F.lit(0.0))


# Leading bytes of known formats, as hexadecimal.
MAGIC = (
    ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("25504446", "application/pdf"), ("504B0304", "application/zip"),
    ("1F8B", "application/gzip"), ("28B52FFD", "application/zstd"), ("04224D18", "application/lz4"), ("7F454C46", "application/elf"), ("50415231", "application/parquet"),
)


def content_type(data: Column, least: int = 256) -> Column:
    """Type by leading bytes; short content is unknown; text by its share of printable ASCII; else binary."""
    head = F.hex(F.substring(data.cast("binary"), 1, 8))
    out = F.when(head.startswith(MAGIC[0][0]), MAGIC[0][1])
    for magic, kind in MAGIC[1:]:
        out = out.when(head.startswith(magic), kind)
    start = F.substring(data.cast("binary"), 1, 4096)
    ascii_, printable = text_ratios(F.decode(start, "ISO-8859-1"), F.octet_length(start))
    return out.when(F.octet_length(data) < least, "unknown").when((printable > 0.9) & (ascii_ > 0.85), "text/plain").otherwise("application/octet-stream")


def is_float_array(data: bytes) -> bool:
    """Whether at least three quarters of the first 16 floats are finite and below 1e10."""
    n = min(len(data), 64) // 4
    if n == 0:
        return False
    with np.errstate(invalid="ignore"):
        v = np.frombuffer(data[: 4 * n], dtype="<f4").astype(np.float64)
        return bool((np.isfinite(v) & (np.abs(v) < 1e10)).mean() >= 0.75)


def spatially_correlated(data: bytes) -> bool:
    """Whether most neighbouring bytes differ by at most 16."""
    d = np.abs(np.diff(np.frombuffer(data, dtype=np.uint8).astype(np.int16)))
    return bool(len(d)) and bool((d <= 16).mean() > 0.6)


def temporally_correlated(data: bytes) -> bool:
    """Whether the bytes cross their middle value at a tenth to half of the steps."""
    side = np.frombuffer(data, dtype=np.uint8) >= 128
    if len(side) < 2:
        return False
    return bool(0.1 <= (side[1:] != side[:-1]).mean() < 0.5)


def weight(hash_hex: Column) -> Column:
    """First 8 bytes of a hash as a little-endian unsigned number."""
    swapped = F.concat(*[F.substring(hash_hex, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def trailing_zeros(hash_hex: Column) -> Column:
    """Zero bits at the end of the weight: those of its lowest bytes first; 64 where all are zero."""
    byte = [F.conv(F.substring(hash_hex, 2 * i + 1, 2), 16, 10).cast("int") for i in range(8)]
    # A number and its negative agree in the lowest set bit only.
    low = lambda b: F.bit_count(b.bitwiseAND(-b) - 1)
    out = F.lit(64)
    for i in reversed(range(8)):
        out = F.when(byte[i] != 0, 8 * i + low(byte[i])).otherwise(out)
    return out


def _byte(data: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")


def looks_like_floats(data: Column) -> Column:
    """Whether at least three quarters of the first 16 little-endian floats are finite and below 1e10.

    Judged by the exponent, the top bits of a float: 255 is not finite, and 1e10 has an exponent of 160.
    """
    n = F.least(F.floor(F.octet_length(data) / 4), F.lit(16)).cast("int")

    def small(i: Column) -> Column:
        bits = (_byte(data, 4 * i + 4) % 128) * 65536 + _byte(data, 4 * i + 3) * 256 + _byte(data, 4 * i + 2)
        # The float 1e10 is 0x501502F9: compared by its upper three bytes, then the last.
        top = F.lit(0x501502)
        return (bits < top) | ((bits == top) & (_byte(data, 4 * i + 1) < 0xF9))

    good = F.size(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), small))
    return F.when(n > 0, good >= 0.75 * n).otherwise(False)


def neighbours_close(data: Column) -> Column:
    """Whether most neighbouring bytes differ by at most 16."""
    n = F.octet_length(data)
    near = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.abs(_byte(data, i) - _byte(data, i + 1)) <= 16)
    return F.when(n > 1, F.size(near) > 0.6 * (n - 1)).otherwise(False)


def z_array(data: bytes) -> np.ndarray:
    """For each position, how long the text from there agrees with its beginning."""
    n = len(data)
    z = np.zeros(n, dtype=np.int64)
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, int(z[i - left])) if i < right else 0
        while i + k < n and data[k] == data[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def period(data: bytes) -> int:
    """Smallest period of the bytes (their length when they do not repeat)."""
    z = z_array(data)
    whole = np.flatnonzero(z + np.arange(len(data)) == len(data))
    return int(whole[whole > 0][0]) if (whole > 0).any() else len(data)


# Chunking --------------------------------------------------------------------------

RUN = 5


def monotone_chunks(data: bytes, target: int) -> list[tuple[int, int]]:
    """Content-defined chunks (offset, length): cut after a rising run of ``RUN`` bytes.

    A chunk has at least ``target / 4`` bytes (but the last) and at most ``4 * target``.
    Bytes compare as unsigned numbers, and a run lies within one chunk.
    """
    least, most = max(RUN, target // 4), 4 * target
    b = np.frombuffer(data, dtype=np.uint8)
    n = len(b)
    if n == 0:
        return []
    up = np.concatenate(([0], np.cumsum(b[1:] > b[:-1])))  # rises before each byte
    ends = np.arange(RUN - 1, n)
    cuts = ends[up[ends] - up[ends - RUN + 1] == RUN - 1] + 1
    out, begin = [], 0
    while begin < n:
        i = np.searchsorted(cuts, begin + least)
        end = min(int(cuts[i]) if i < len(cuts) else n, begin + most, n)
        out.append((begin, end - begin))
        begin = end
    return out


# Window and seed of the rolling hash; its table comes from a xorshift generator with shifts 13, 7 and 17.
ROLLING_WINDOW, ROLLING_SEED = 48, 0x123456789ABCDEF


def rolling_chunks(data: bytes, target: int, window: int = ROLLING_WINDOW, seed: int = ROLLING_SEED) -> list[tuple[int, int]]:
    """Chunks cut where a rotating hash of the last ``window`` bytes ends in zero bits.

    The hash is a XOR of rotated table entries, so it is found for all positions at
    once; the table comes from a xorshift generator.
    """
    mask64 = (1 << 64) - 1
    state, table = seed, np.empty(256, dtype=np.uint64)
    for i in range(256):
        state ^= (state << 13) & mask64
        state ^= state >> 7
        state ^= (state << 17) & mask64
        table[i] = state
    b = np.frombuffer(data, dtype=np.uint8)
    n = len(b)
    if n == 0:
        return []
    least, most = max(1, target // 4), 4 * target
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(window, n)):
        r = k % 64
        t = table[b[: n - k]]
        rotated = t if r == 0 else (t << np.uint64(r)) | (t >> np.uint64(64 - r))
        h[k:] ^= rotated
    bits = np.uint64((1 << (target.bit_length() - 1)) - 1)
    cuts = np.flatnonzero((h & bits) == 0) + 1
    out, begin = [], 0
    while begin < n:
        i = np.searchsorted(cuts, begin + least)
        end = min(int(cuts[i]) if i < len(cuts) else n, begin + most, n)
        out.append((begin, end - begin))
        begin = end
    return out


def chunk_objects(objects: DataFrame, key: str, content: str, target: int, method: str = "monotone") -> DataFrame:
    """Rows ``key, index, offset, size, hash`` of every object's chunks.

    An object is chunked by one task, since every cut depends on the one before; only
    the cuts come from Python, the chunks are hashed where the object is.
    """
    cut = {"monotone": monotone_chunks, "rolling": rolling_chunks}[method]

    @F.pandas_udf("array<bigint>")
    def offsets(values: pd.Series) -> pd.Series:
        return pd.Series([np.array([o for o, _ in cut(v, target)], dtype=np.int64) if v else np.empty(0, dtype=np.int64) for v in values])

    held = objects.select(key, F.col(content).cast("binary").alias("_data")).withColumn("_at", offsets("_data"))

    def chunk(begin: Column, i: Column) -> Column:
        size = F.coalesce(F.get("_at", i + 1), F.octet_length("_data").cast("bigint")) - begin
        return F.struct(i.alias("index"), begin.alias("offset"), size.alias("size"), F.sha2(F.substring(F.col("_data"), begin.cast("int") + 1, size.cast("int")), 256).alias("hash"))

    return held.select(key, F.explode(F.transform("_at", chunk)).alias("_c")).select(key, "_c.*")


def chunk_layers(data: bytes, targets: tuple[int, ...]) -> list[list[tuple[int, int]]]:
    """A chunk tree: each layer groups the chunks of the one below, so its cuts are among theirs.

    Runs of a short period become one chunk up to the layer's maximum.
    """
    layers: list[list[tuple[int, int]]] = []
    below = monotone_chunks(data, targets[0]) if targets else []
    for target in targets:
        grouped: list[tuple[int, int]] = []
        for o, n in below:
            if grouped:
                a, m = grouped[-1]
                small = m < target // 2
                repeats = m + n <= 4 * target and period(data[a : a + min(m, 256)]) <= 32 and data[a : a + min(m, n)] == data[o : o + min(m, n)]
                if (small and m + n <= 4 * target) or repeats:
                    grouped[-1] = (a, m + n)
                    continue
            grouped.append((o, n))
        layers.append(grouped)
        below = grouped
    return layers


# Hash trees -------------------------------------------------------------------------


def merkle_root(leaves: Column) -> Column:
    """Root over an array of binary hashes: pairs are hashed level by level, an odd one with itself.

    A single leaf is its own root; no leaves give 32 zero bytes.
    """
    n = F.size(leaves)
    levels = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")

    def level(nodes: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)
        return F.transform(pairs, lambda i: F.unhex(F.sha2(F.concat(F.get(nodes, 2 * i), F.get(nodes, F.least(2 * i + 1, F.size(nodes) - 1))), 256)))

    root = F.get(F.aggregate(F.sequence(F.lit(1), levels), leaves, level), F.lit(0))
    return F.when(n == 0, F.unhex(F.lit("00" * 32))).when(n == 1, F.get(leaves, F.lit(0))).otherwise(root)


def merkle_proof(leaves: list[bytes], index: int) -> list[bytes]:
    """Siblings from a leaf to the root."""
    import hashlib

    out, level = [], list(leaves)
    while len(level) > 1:
        out.append(level[min(index ^ 1, len(level) - 1)])
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
        index //= 2
    return out


def merkle_proof_of(leaves: Column, index: Column) -> Column:
    """Siblings from a leaf to the root, as an array; level by level, for one array of leaves."""
    n = F.size(leaves)
    levels = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    start = F.struct(leaves.alias("nodes"), index.cast("int").alias("i"), F.array().cast("array<binary>").alias("proof"))

    def step(acc: Column, _: Column) -> Column:
        nodes = acc["nodes"]
        pairs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)
        above = F.transform(pairs, lambda i: F.unhex(F.sha2(F.concat(F.get(nodes, 2 * i), F.get(nodes, F.least(2 * i + 1, F.size(nodes) - 1))), 256)))
        sibling = F.get(nodes, F.least(F.when(acc["i"] % 2 == 0, acc["i"] + 1).otherwise(acc["i"] - 1), F.size(nodes) - 1))
        return F.struct(above.alias("nodes"), F.floor(acc["i"] / 2).cast("int").alias("i"), F.concat(acc["proof"], F.array(sibling)).alias("proof"))

    proof = F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), start, step, lambda acc: acc["proof"])
    return F.when(n > 1, proof).otherwise(F.array().cast("array<binary>"))


def merkle_sample(trees: DataFrame, leaves: str, sample: int, seed: int) -> DataFrame:
    """``checked`` and ``valid`` of a random sample of a tree's leaves, each verified through its proof.

    The sample is drawn by a hash of the leaf's place and the seed, so it can be repeated.
    """
    each = trees.withColumn("_root", merkle_root(F.col(leaves))).select("_root", F.col(leaves), F.posexplode(leaves).alias("_i", "_leaf"))
    picked = each.orderBy(F.xxhash64("_i", F.lit(seed)), "_i").limit(sample)
    ok = merkle_verify(F.col("_leaf"), merkle_proof_of(F.col(leaves), F.col("_i")), F.col("_root"), F.col("_i"))
    return picked.agg(F.count("*").alias("checked"), F.count_if(ok).alias("valid"))


def merkle_verify(leaf: Column, proof: Column, root: Column, index: Column) -> Column:
    """Whether a proof leads from a leaf to the root; the index's bits say on which side."""
    start = F.struct(leaf.alias("h"), index.cast("long").alias("i"))

    def step(acc: Column, sibling: Column) -> Column:
        pair = F.when(acc["i"] % 2 == 0, F.concat(acc["h"], sibling)).otherwise(F.concat(sibling, acc["h"]))
        return F.struct(F.unhex(F.sha2(pair, 256)).alias("h"), F.floor(acc["i"] / 2).cast("long").alias("i"))

    return F.aggregate(proof, start, step, lambda acc: acc["h"]) == root


# Erasure codes ------------------------------------------------------------------------


def _field() -> tuple[np.ndarray, np.ndarray]:
    exp, log = np.zeros(512, dtype=np.uint8), np.zeros(256, dtype=np.int64)
    x = 1
    for i in range(255):
        exp[i], log[x] = x, i
        x <<= 1
        if x & 256:
            x ^= 0x11D
    exp[255:510] = exp[:255]
    return exp, log


_EXP, _LOG = _field()


def gf_mul(a: int, b: np.ndarray) -> np.ndarray:
    """Product of a number and an array in GF(256)."""
    return np.zeros_like(b) if a == 0 else np.where(b == 0, 0, _EXP[_LOG[a] + _LOG[b]]).astype(np.uint8)


def gf_inverse(a: int) -> int:
    return int(_EXP[255 - _LOG[a]])


def _coding_rows(k: int, m: int) -> np.ndarray:
    """Identity over a Cauchy matrix: any ``k`` rows can be inverted."""
    cauchy = [[gf_inverse((k + i) ^ j) for j in range(k)] for i in range(m)]
    return np.vstack([np.eye(k, dtype=np.uint8), np.array(cauchy, dtype=np.uint8).reshape(m, k)])


def shard_size(n: int, k: int) -> int:
    """Bytes of a shard: an equal part, rounded up to an even number."""
    return -(-n // k) + (-(-n // k)) % 2


def erasure_encode(data: bytes, k: int, m: int) -> list[bytes]:
    """``k`` data shards (the padded data itself) and ``m`` parity shards."""
    if not data:
        raise ValueError("nothing to encode")
    size = shard_size(len(data), k)
    rows = np.frombuffer(data.ljust(k * size, b"\0"), dtype=np.uint8).reshape(k, size)
    parity = [np.bitwise_xor.reduce([gf_mul(int(c), r) for c, r in zip(row, rows, strict=True)]) for row in _coding_rows(k, m)[k:]]
    return [r.tobytes() for r in (*rows, *parity)]


def erasure_decode(shards: list[bytes | None], k: int, m: int, length: int) -> bytes:
    """The data from any ``k`` of its shards (None where lost)."""
    have = [i for i, s in enumerate(shards) if s is not None][:k]
    if len(have) < k:
        raise ValueError(f"{len(have)} shards of {k} needed")
    matrix = _coding_rows(k, m)[have].copy()
    rows = np.stack([np.frombuffer(shards[i], dtype=np.uint8) for i in have]).copy()
    for c in range(k):
        p = next(r for r in range(c, k) if matrix[r, c])
        matrix[[c, p]], rows[[c, p]] = matrix[[p, c]], rows[[p, c]]
        inverse = gf_inverse(int(matrix[c, c]))
        matrix[c], rows[c] = gf_mul(inverse, matrix[c]), gf_mul(inverse, rows[c])
        for r in range(k):
            if r != c and matrix[r, c]:
                f = int(matrix[r, c])
                matrix[r] ^= gf_mul(f, matrix[c])
                rows[r] ^= gf_mul(f, rows[c])
    return rows.tobytes()[:length]


def shard_size_of(size: Column, k: int) -> Column:
    """:func:`shard_size` as an expression."""
    part = F.ceil(size / F.lit(k)).cast("bigint")
    return part + part % 2


def encode_objects(objects: DataFrame, key: str, data: str, k: int, m: int) -> DataFrame:
    """Every object's shards: ``key, shard, content, length``; objects without bytes have none."""
    key_type = objects.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch[key], batch["_data"], strict=True):
                if raw is not None and len(raw):
                    shards = erasure_encode(bytes(raw), k, m)
                    yield pd.DataFrame({key: [name] * (k + m), "shard": range(k + m), "content": shards, "length": [len(raw)] * (k + m)})

    return objects.select(key, F.col(data).cast("binary").alias("_data")).mapInPandas(run, f"`{key}` {key_type}, shard int, content binary, length bigint")


def decode_objects(shards: DataFrame, key: str, k: int, m: int) -> DataFrame:
    """``key, data`` of every object of which at least ``k`` shards are there; an error if fewer are."""
    held = F.slice(F.array_sort(F.collect_list(F.struct("shard", "content"))), 1, k)
    per = shards.groupBy(key).agg(held.alias("_s"), F.max("length").alias("_n"))
    key_type = shards.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for some, n in zip(batch["_s"], batch["_n"], strict=True):
                have: list[bytes | None] = [None] * (k + m)
                for s in some:
                    have[s["shard"]] = bytes(s["content"])
                out.append(erasure_decode(have, k, m, int(n)))
            yield pd.DataFrame({key: batch[key], "data": out})

    return per.mapInPandas(run, f"`{key}` {key_type}, data binary")


def xor_parity(stripes: DataFrame, group: list[str], position: str, byte: str) -> DataFrame:
    """Parity by XOR over the members of a stripe, for single losses, as an aggregation."""
    return stripes.groupBy(*group, position).agg(F.bit_xor(F.col(byte).cast("int")).alias("parity"))


# Tensors -----------------------------------------------------------------------------

#: Bytes of one element by type.
ELEMENT_SIZE = {"float64": 8, "int64": 8, "uint64": 8, "float32": 4, "int32": 4, "uint32": 4, "float16": 2, "bfloat16": 2, "int16": 2, "int8": 1, "uint8": 1, "bool": 1}


def element_size(dtype: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ELEMENT_SIZE.items() for x in pair]), dtype)


def shard_ranges(tensors: DataFrame, key: str, size: str, shard_bytes: int, most: int) -> DataFrame:
    """Byte ranges of every tensor's shards; an error if a tensor needs more than ``most``."""
    n = F.ceil(F.col(size) / F.lit(shard_bytes)).cast("int")
    checked = F.when(n > most, F.raise_error(F.lit("too many shards")).cast("int")).otherwise(n)
    spread = tensors.select(key, size, checked.alias("_n")).where("_n > 0").select(key, size, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("shard"))
    start = F.col("shard").cast("long") * shard_bytes
    return spread.select(key, "shard", start.alias("offset"), F.least(F.lit(shard_bytes).cast("long"), F.col(size) - start).alias("size"))


def find_tensors(catalogue: DataFrame, name: str | None = None, dtype: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Tensors by a glob on the name, the element type, and bounds of the size; what is not given does not filter."""
    out = catalogue
    if name is not None:
        out = out.where(F.col("name").like(name.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")))
    if dtype is not None:
        out = out.where(F.col("dtype") == dtype)
    if least is not None:
        out = out.where(F.col("size") >= least)
    return out if most is None else out.where(F.col("size") <= most)


def pack_floats(tensors: DataFrame, key: str, values: str) -> DataFrame:
    """``key, data``: the values as little-endian 32-bit floats."""
    key_type = tensors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "data": [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in batch[values]]})

    return tensors.select(key, values).mapInPandas(run, f"`{key}` {key_type}, data binary")


def unpack_floats(tensors: DataFrame, key: str, data: str) -> DataFrame:
    """``key, values``: little-endian 32-bit floats from bytes; null where the bytes are no whole number of them."""
    key_type = tensors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "values": [None if d is None or len(d) % 4 else np.frombuffer(bytes(d), dtype="<f4") for d in batch[data]]})

    return tensors.select(key, data).mapInPandas(run, f"`{key}` {key_type}, values array<float>")


def read_savings(size: Column, fields: list[Column]) -> Column:
    """Bytes that reading only some fields of an object spares."""
    out = size
    for f in fields:
        out = out - F.coalesce(F.octet_length(f), F.lit(0))
    return out


def chunk_count(size: Column, chunk: int) -> Column:
    return F.ceil(size / F.lit(chunk))


def overhead_ratio(k: int, m: int) -> float:
    return (k + m) / k

