import random
import re

import corpus_pipeline
from sketchgraph.llm import near_copies, simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(rows):
    sets, parent = [brute(t) for _, t in rows], [*range(len(rows))]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def test_near_copies_beyond_two_bits_go(spark):
    r = random.Random(6)
    say = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    rows, near = [], 0
    for _ in range(25):
        base = say(r.randint(60, 400))
        rows.append(" ".join(base))
        for edits in (len(base) // 60, len(base) // 50, len(base) // 40, len(base) // 25):
            copy = [*base]
            for at in r.sample(range(len(copy)), max(1, edits)):
                copy[at] = "new"
            rows.append(" ".join(copy))
    rows = [*enumerate(rows)]
    pairs = [(a, b) for i, (_, a) in enumerate(rows) for _, b in rows[:i] if alike(brute(a), brute(b))]
    near = sum((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > simhash.DISTANCE for a, b in pairs)
    assert near > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    assert sorted(x["doc_id"] for x in simhash.keep_one(df).collect()) == want and len(want) < len(rows)


def test_a_key_that_many_share(spark):
    """A chain of edits: the first and the last are not alike, all have keys in common."""
    r = random.Random(7)
    text = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(3 * near_copies.FEW):
        rows.append(" ".join(text))
        text[r.randrange(150, 300)] = f"e{i}"
    rows += [" ".join([f"w{i}" for i in range(150)] + [f"o{k}_{i}" for i in range(150)]) for k in range(3 * near_copies.FEW)]
    rows = [*enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.keep_one(df).collect()) == brute_kept(rows)


def test_links_of_fingerprints_count(spark):
    """Texts of fingerprints at most two bits apart are near duplicates, though they have few of their shingles in common."""
    base = " ".join(f"w{i}" for i in range(21))
    say = lambda x: " ".join([base] * 200 + [f"{x}{i}" for i in range(30)])
    rows = [(1, say("a")), (2, say("b")), (3, " ".join(f"o{i}" for i in range(200)))]
    a, b = rows[0][1], rows[1][1]
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= simhash.DISTANCE and not alike(brute(a), brute(b))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.near_duplicates(df).select("component_id").distinct().withColumnRenamed("component_id", "doc_id").collect()) == [1, 3]
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 3]
