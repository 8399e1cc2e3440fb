import pytest
from pyspark.sql import functions as F

from sketchgraph import reports
from sketchgraph.operators import minhash, search
from sketchgraph.sources import text_files

TEXTS = {
    "example1.txt": "The quick brown fox jumps over the lazy dog\n\nThe fox jumps over the lazy dog\n",
    "example2.txt": "Quick quick?  Fox fox\n\nFox!",
    "example3.txt": "red blue green\n\nyellow red\n\nwhite\n\n\nblack?",
}
WANT = {
    "quick fox": (1.0, 0.17206, 0.66882),
    "fox quick": (0.11765, 0.17206, 0.13941),
    "fox": (0, 0.14254, 0.05702),
    "quick": (0, 0.10079, 0.04032),
    "blue": (0, 0, 0),
    "black": (0, 0, 0),
    "blue black": (0.11765, 0, 0.07059),
    "black blue": (0.11765, 0, 0.07059),
    "blue brown": (0.11765, 0.19310, 0.14783),
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    for name, text in TEXTS.items():
        (folder / name).write_text(text)
    return search.PositionalIndex.build(text_files.documents(spark, str(folder), "UTF-8"))


def test_scores(index):
    got = {r["query"]: r for r in index.scores([*WANT]).where("doc = 'example1.txt'").collect()}
    for i, want in enumerate(WANT.values()):
        assert all(abs(a - b) < 1.5e-5 for a, b in zip((got[i]["tp"], got[i]["vs"], got[i]["relevance"]), want)), (i, got[i])


def test_top(index):
    rows = index.top_k(["quick fox", "red"], 2).orderBy("query", "place").collect()
    assert [(r["query"], r["doc"]) for r in rows] == [(0, "example2.txt"), (0, "example1.txt"), (1, "example3.txt"), (1, "example1.txt")]
    line = index.top_k(["quick fox"], 1).select(reports.score_line()).head()[0]
    assert line.startswith("example2.txt") and len(line) == len(reports.SCORE_HEADER)
    with pytest.raises(ValueError):
        index.scores(["?"])


def test_postings(index):
    lists = {r["term"]: r["list"] for r in index.postings_lists(['fox', 'black', 'none']).collect()}
    assert lists["fox"] == "[<example1.txt:3,10>,<example2.txt:2,3,4>]" and len(lists) == 2 and lists["black"] == "[<example3.txt:6>]"


def test_weights(spark):
    docs = spark.createDataFrame([("doc1", "and the x"), ("doc2", "and canada the the"), ("doc3", "england england")], "doc string, text string")
    got = {(r["doc"], r["term"]): r["weight"] for r in search.PositionalIndex.build(docs).weights().collect()}
    assert abs(got["doc1", "and"] - 0.176091) < 1e-5 and abs(got["doc2", "the"] - 0.249030) < 1e-5 and abs(got["doc3", "england"] - 0.674751) < 1e-5 and abs(got["doc2", "canada"] - 0.477121) < 1e-5


def test_distances(spark):
    df = spark.createDataFrame([([1, 10], [3, 40], [], [20])], "a array<int>, b array<int>, c array<int>, d array<int>")
    d = lambda x, y: df.select(search.ordered_distance(F.col(x), F.col(y))).head()[0]
    assert (d("a", "b"), d("b", "a"), d("a", "c"), d("a", "d"), d("d", "a")) == (2, 7, 17, 10, 17)
    assert df.select(search.nearness([F.col("a"), F.col("b"), F.col("d")])).head()[0] == 3 / (2 + 17)
    assert df.select(search.nearness([F.col("a")])).head()[0] == 0
    with pytest.raises(ValueError):
        search.nearness([])


def test_empty_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "doc int, text string")
    rows = search.PositionalIndex.build(docs).scores(["one two"]).orderBy("doc").collect()
    assert [round(r["tp"], 4) for r in rows] == [0.1176, 0.1176, 2.0] and rows[0]["vs"] == 0


def test_decoding(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes("é".encode("latin-1"))
    assert tuple(text_files.documents(spark, str(tmp_path)).head()) == ("d.txt", "é")


def test_saved_index(spark, index, tmp_path):
    again = index.save(str(tmp_path / "index"))
    queries = [*WANT]
    assert sorted(map(tuple, again.scores(queries).collect())) == sorted(map(tuple, index.scores(queries).collect()))
    opened = search.PositionalIndex.open(spark, str(tmp_path / "index"))
    assert opened.n == index.n and opened.entries().count() == index.entries().count()


def test_numbered_lines_of_splits(spark, tmp_path):
    lines = ["" if i % 11 == 0 else f"line {i} " + "x" * (i % 50) for i in range(3000)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = text_files.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert sorted((r["line_no"], r["line"]) for r in got.collect()) == sorted([(i + 1, x) for i, x in enumerate(lines) if x] * 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def shuffles(df):
    return df._jdf.queryExecution().toString().count("Exchange ")


def test_terms_are_counted_where_documents_lie(spark):
    """Counts, entries and their texts need no shuffle; rows of one id count as one document."""
    texts = [(1, "one two one"), (2, None), (3, "two ünïcode 𝄞𝄞𝄞 two"), (None, "null null one")]
    docs, again = (spark.createDataFrame(t, "doc int, text string") for t in (texts, [*texts, (1, "two one"), (None, "one")]))
    assert not shuffles(minhash.term_frequencies(docs)) and not shuffles(search.PositionalIndex.build(docs).entries())
    counts = lambda df: {(r["doc"], r["term"]): r["tf"] for r in minhash.term_frequencies(df).collect()}
    once = {(1, "one"): 2, (1, "two"): 1, (3, "two"): 2, (3, "ünïcode"): 1, (3, "𝄞𝄞𝄞"): 1, (None, "null"): 2, (None, "one"): 1}
    assert counts(docs) == once and counts(again) == once | {(1, "one"): 3, (1, "two"): 2, (None, "one"): 2}
    entries = {(r["doc"], r["term"]): r["entry"] for r in search.PositionalIndex.build(again).entries().collect()}
    assert entries[1, "one"] == "<1:0,1,2>" and entries[1, "two"] == "<1:0,1>" and entries[3, "two"] == "<3:0,2>"
    assert tuple(minhash.corpus_counts(again, minhash.term_frequencies(again)).head()) == (3, 5, 13)


def test_gaps(spark):
    df = spark.createDataFrame([([1, 10, 41], [3, 40]), ([5], [5]), (None, [1]), ([7], [1, 2, 9])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(search.first_gap("a", "b")).collect()] == [2, None, None, 2]


def test_java_hashes():
    from sketchgraph.functions.hashing import java_hashes

    assert java_hashes(["", "a", "hello", "ü", "𝄞", "polygenelubricants"]).tolist() == [0, 97, 99162322, 252, 1772394, -(1 << 31)]
