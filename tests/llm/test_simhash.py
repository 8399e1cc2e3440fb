import random
import re

import numpy as np
import xxhash

from sketchgraph.llm import components, queries, simhash


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    parent = [*range(len(prints))]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    r = random.Random(1)
    texts = ["", None, " \t\n\x0b\x0c\r ", "One", "ÀB a b", "A b C d", "x " * 50_000]
    texts += ["".join(r.choice("ab AÉ\t\n\x1c ") for _ in range(40)) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint(t or "") & (1 << 64) - 1 == brute_print(t), repr(t)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = queries.QUERIES["op5_simhash_near_dedup"](spark, sf).orderBy("doc_id").collect()
    prints = [brute_print(d["text"]) for d in docs]
    assert [r["fingerprint"] for r in got] == [f"{p:016x}" for p in prints]
    assert [r["component_id"] for r in got] == [docs[g]["doc_id"] for g in brute_groups(prints)]


def grouped(spark, prints):
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    roots = components.components(simhash.links(df))
    root = {r["node"]: r["root"] for r in roots.collect()} if roots else {}
    return [root.get(simhash._signed(p), simhash._signed(p)) for p in prints]


def test_dense_and_sparse_groups(spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    prints = {0, 1, 3, 7, 15, 1 << 63, (1 << 63) | 7}
    for _ in range(600):  # one ball with many values to a key
        x = base
        for _ in range(r.randint(0, 3)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    for _ in range(60):  # chains
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            prints.add(x)
            for b in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << b
    prints = sorted(prints)
    want, got = brute_groups(prints), grouped(spark, prints)
    assert len({*zip(want, got)}) == len({*want}) == len({*got})


def test_every_pair_within_distance_shares_a_chain():
    r = random.Random(3)
    for _ in range(3000):
        differ = sum(1 << b for b in r.sample(range(64), r.randint(0, 2)))
        assert any(all((differ & m).bit_count() <= budget for m, budget in simhash.chain(i)) for i in range(simhash.SEGMENTS))


def test_components(spark):
    r = random.Random(4)
    for n, m in ((1, 1), (60, 20), (60, 80), (300, 299)):
        pairs = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        roots = components.components(spark.createDataFrame([*pairs, (5, None)], "a long, b long"))
        root = {x["node"]: x["root"] for x in roots.collect()} if roots else {}
        parent = {i: i for i in range(n)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        got = [root.get(i, i) for i in range(n)]
        assert len({*zip(map(find, range(n)), got)}) == len({*got}) == len({find(i) for i in range(n)})


def test_edge_cases(spark):
    schema = "doc_id long, text string, fp string, component_id int"
    df = spark.createDataFrame([(3, None, "x", 0), (2, "", "x", 0), (None, "a b c d", "x", 0), (5, "A B c d", "x", 0), (5, "A B c d", "x", 0), (7, "other words entirely here", "x", 0)], schema)
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {(3, 2), (2, 2), (None, 5), (5, 5), (7, 7)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 7]
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


def test_keep_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "x y z"), (None, "n"), (None, "n")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=str) == [(1, "a b c"), (1, "x y z"), (None, "n")]
