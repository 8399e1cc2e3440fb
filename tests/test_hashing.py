import numpy as np
from pyspark.sql import functions as F

from sketchgraph.functions import hashing
from sketchgraph.operators import bloom

FIXED_64 = [11239542818895821884, 584566915021039271, 6220508851333379873, 14846292297954449589, 8138346585592239007, 5273429754382883119, 9641424149210398560, 7351585467605002562, 17294501757292903523]
FIXED_32 = [275646681, 2731586172, 316155434, 479470107, 2971317748, 461995741, 1870650108, 3948500121, 3339539933]
IN, OUT = [f"Key {i * i} of {chr(65 + i)}" for i in range(25)], [f"other {i} {chr(97 + i)}" for i in range(25)]


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_fnv_values():
    assert [int(s) for s in hashing.fnv_salts(3)] == [-3984979485530852511, -965654445758638612, -1438438931337756312]
    assert hashing.fnv64_of("a") == -5808590958014384194


def test_positions(spark):
    row = keys(spark, ["Tennessee"]).select(hashing.fnv_positions(F.lower("key"), 4, 800).alias("f"), hashing.murmur_positions(F.lower("key"), 4, 800).alias("m")).head()
    assert row["f"] == [468, 784, 7, 664]
    assert row["m"] == [757, 300, 760, 263]


def test_java_hashes(spark):
    df = spark.createDataFrame([("tennis", [1, -2, 3]), ("", []), (None, None)], "s string, a array<int>")
    rows = df.select(hashing.java_string_hash(F.col("s")).alias("s"), hashing.java_array_hash(F.col("a")).alias("a")).collect()
    assert [r["s"] for r in rows] == [-877324069, 0, None]
    assert rows[1]["a"] == 1 and rows[0]["a"] == ((31 * (31 * (31 + 1) - 2)) + 3)


def murmur64_by_definition(data: bytes, seed: int) -> int:
    """MurmurHash2, 64A, a byte at a time in whole numbers."""
    m, mask = 0xC6A4A7935BD1E995, (1 << 64) - 1
    h = seed & 0xFFFFFFFF ^ len(data) * m & mask
    for i in range(0, len(data) - 7, 8):
        k = sum(data[i + j] << 8 * j for j in range(8)) * m & mask
        h = (h ^ (k ^ k >> 47) * m & mask) * m & mask
    if rest := data[len(data) // 8 * 8 :]:
        h = (h ^ sum(b << 8 * j for j, b in enumerate(rest))) * m & mask
    h = (h ^ h >> 47) * m & mask
    return h ^ h >> 47


def murmur32_by_definition(data: bytes, seed: int) -> int:
    m, mask = 0x5BD1E995, (1 << 32) - 1
    h = (seed ^ len(data)) & mask
    for i in range(0, len(data) - 3, 4):
        k = sum(data[i + j] << 8 * j for j in range(4)) * m & mask
        h = h * m & mask ^ (k ^ k >> 24) * m & mask
    if rest := data[len(data) // 4 * 4 :]:
        h = (h ^ sum(b << 8 * j for j, b in enumerate(rest))) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


def test_murmur_by_definition():
    for n in range(34):
        data = bytes((7 * i + 200 + n) % 256 for i in range(n))
        rows = np.frombuffer(data, np.uint8).reshape(1, -1)
        assert [int(hashing.murmur64(rows, s)[0]) for s in (0, 7, -5)] == [murmur64_by_definition(data, s) for s in (0, 7, -5)]
        assert [int(hashing.murmur32(rows, s)[0]) for s in (0, 7)] == [murmur32_by_definition(data, s) for s in (0, 7)]


def test_murmur_fixed_values():
    """Fixed values, of each length of the last word."""
    words = [b"abcdefgh"[:n] for n in range(9)]
    of = lambda f: [int(f(np.frombuffer(w, np.uint8).reshape(1, -1))[0]) for w in words]
    assert of(hashing.murmur64) == FIXED_64 and of(hashing.murmur32) == FIXED_32


def test_hash_columns(spark):
    texts = ["a", None, "hello world!", "", "é", "hello world?"]
    df = spark.createDataFrame([(t, i - 2) for i, t in enumerate(texts)], "key string, seed long")
    rows = df.coalesce(1).select(hashing.fnv64_hash("key").alias("f"), hashing.murmur64_hash("key", "seed").alias("m"), hashing.murmur32_hash("key").alias("n")).collect()
    assert rows[0]["f"] == -5808590958014384194 and list(rows[1]) == [None] * 3
    signed = lambda x, bits: x - (1 << bits) if x >> bits - 1 else x
    for i, t in enumerate(texts):
        if t is not None:
            assert rows[i]["m"] == signed(murmur64_by_definition(t.encode(), i - 2), 64) and rows[i]["n"] == signed(murmur32_by_definition(t.encode(), hashing.MURMUR32_SEED), 32)


def test_primes():
    assert [hashing.next_prime(n) for n in (0, 1, 2, 3, 13, 192_000_000)] == [2, 2, 3, 5, 17, 192_000_043]
    assert [bloom.BloomSpec(10, b).hashes for b in (4, 8, 16)] == [3, 6, 12]


def places_by_definition(kind: str, key: str, spec: bloom.BloomSpec) -> set[int]:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    if kind == "fnv":
        return {hashing.fnv64_of(key.lower() + salt) % spec.size for salt in hashing.fnv_salts(spec.hashes)}
    out, seed = set(), hashing.MURMUR64_SEED
    for _ in range(spec.hashes):
        h = murmur64_by_definition(key.lower().encode(), seed)
        out, seed = out | {signed(h) % spec.size}, h & 0xFFFFFFFF
    return out


def test_filters(spark):
    for kind in ("murmur", "fnv", "ran"):
        spec = bloom.BloomSpec(50, 16, kind)
        on = bloom.build(keys(spark, IN), spec)
        got = {r["key"]: r["appears"] for r in bloom.appears(keys(spark, IN + OUT), on, spec).collect()}
        assert all(got[n] for n in IN)
        if kind != "ran":
            want = set().union(*(places_by_definition(kind, n, spec) for n in IN))
            assert {r["pos"] for r in on.collect()} == want
            assert all(got[n] == (places_by_definition(kind, n, spec) <= want) for n in OUT)


def test_filter_metadata(spark):
    spec = bloom.BloomSpec(50, 16)
    row = bloom.metadata(keys(spark, ["a", "b", "b", "c", "d"]), spec).head()
    assert (row["data_size"], row["num_hashes"], row["filter_size"]) == (5, 12, 800)
    bits = bloom.printed(bloom.build(keys(spark, ["a"]), spec), spec).head()[0]
    assert len(bits) == 800 and 1 <= bits.count("X") <= 12


def test_filter_of_nothing(spark):
    spec = bloom.BloomSpec(50, 16)
    got = bloom.appears(keys(spark, ["a", None]), bloom.build(keys(spark, []), spec), spec).collect()
    assert [tuple(r) for r in got] == [("a", False)]


def test_false_positive_rates(spark):
    rows = bloom.false_positives(spark, 500, 8, 2000).collect()
    assert [r["kind"] for r in rows] == ["fnv", "murmur", "ran"] and all(r["probes"] == 2000 and r["hits"] < 400 for r in rows)
