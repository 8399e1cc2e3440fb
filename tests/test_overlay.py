from pyspark.sql import functions as F

from sketchgraph import reports
from sketchgraph.operators import bloom, overlay
from sketchgraph.sources import text_files

LINES = ["a b c d 1990 10 5 1991 12 7", "a b c d 1 2 3 ", "e f g h 2000 1 1 ", "too short", "i j k l x y z ", ""]


def lines(spark, rows):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(rows)], "line_no long, line string")


def test_parsing(spark):
    rows = text_files.parse_records(lines(spark, LINES)).orderBy("line_no").collect()
    assert [(r["line_no"], r["phrase"], [tuple(a) for a in r["appearances"]]) for r in rows] == [(1, "a b c d", [(1990, 10, 5)]), (2, "a b c d", [(1, 2, 3)]), (3, "e f g h", [(2000, 1, 1)])]
    lenient = text_files.parse_records(lines(spark, LINES[:1]), lenient=True)
    assert [tuple(a) for a in lenient.head()["appearances"]] == [(1990, 10, 5), (1991, 12, 7)]
    assert lenient.select(text_files.printed_record(F.col("phrase"), F.col("appearances"))).head()[0] == LINES[0]


def test_lookup(spark):
    base = text_files.parse_records(lines(spark, LINES))
    diff = text_files.parse_records(lines(spark, ["E F G H 2001 2 2 ", "e f g h 9 9 9 "]))
    keys = spark.createDataFrame([("A b c d",), ("e f g h",), ("nothing",), (None,), ("e f g h",)], "key string")
    spec = bloom.BloomSpec(100, 16)
    want = [(None, None), ("A b c d", 1990), ("e f g h", 2001), ("e f g h", 2001), ("nothing", None)]
    year = F.col("record.appearances")[0]["year"]
    for got in (overlay.lookup(keys, base, diff), overlay.lookup_with_filter(keys, base, diff, spec)):
        assert sorted(map(tuple, got.select("key", year).collect()), key=str) == sorted(want, key=str)
    counts = {r["method"]: (r["accesses"], r["lines"]) for r in overlay.access_counts(keys.where("key is not null"), base, diff, spec).collect()}
    # naive: two lines of the differential, then the base, for each of the two keys it hasn't; one line for the others
    assert counts["naive"] == (6, (2 + 1) + (2 + 3) + 1 + 1)
    assert counts["bloom"] == (1 + 4, 2 + 1 + 3 + 1 + 1)
    saved = overlay.saved(overlay.access_counts(keys.where("key is not null"), base, diff, spec))
    assert "accesses" in reports.saved_line(saved).head()[0]


def test_made_up_lines(spark, tmp_path):
    rows = text_files.fake_ngrams(spark, 200)
    parsed = text_files.parse_records(rows)
    assert parsed.count() == 200 and 5 <= rows.where("in_diff").count() <= 45
    assert parsed.where(F.exists("appearances", lambda a: ~a["year"].between(1500, 1999) | ~a["times"].between(10, 59) | ~a["books"].between(5, 24))).isEmpty()
    path = tmp_path / "lines.txt"
    path.write_bytes(b"one\r\ntwo\n\nthree")
    assert [tuple(r) for r in text_files.numbered_lines(spark, str(path)).orderBy("line_no").collect()] == [(1, "one"), (2, "two"), (4, "three")]


def test_sparse_filter_lets_no_other_key_through(spark):
    """200 keys of the differential fill a filter for 50 of them; one sized by the differential holds all other keys back."""
    rows = lambda n, low: spark.range(low, low + n).select(F.col("id").alias("line_no"), F.concat(F.lit("k "), "id").alias("phrase"))
    base, diff, keys = rows(3000, 0), rows(200, 3000), rows(3000, 0).select(F.col("phrase").alias("key"))
    accesses = lambda spec: {r["method"]: r["accesses"] for r in overlay.access_counts(keys, base, diff, spec).collect()}["bloom"]
    assert accesses(bloom.BloomSpec(50, 16)) > 3001
    assert accesses(overlay.sparse(diff, 50, 16)) == 3001 and overlay.sparse(diff, 50_000, 16).set_size == 50_000


def test_packed_filter(spark):
    keys = spark.range(500).select(F.concat(F.lit("Key "), "id").alias("key"))
    probes = keys.unionAll(spark.createDataFrame([("none",), (None,)], "key string"))
    for kind in bloom.KINDS:
        spec = bloom.BloomSpec(70_000, 16, kind)
        want = {r["key"]: r["appears"] for r in bloom.appears(probes, bloom.build(keys, spec), spec).collect()}
        got = probes.select("key", bloom.packed(keys, spec)(F.col("key")).alias("appears")).collect()
        assert {r["key"]: r["appears"] for r in got} == want | {None: False} and not want["none"]
