from pyspark.sql import functions as F

import corpus_pipeline
from sketchgraph.llm import queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in before.collect()}
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()}
    whole = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert last == whole and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in whole.values())
    assert all(r["n_chars"] == len(r["text"]) for r in whole.values())


def test_stages_keep_and_drop(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").head()["text"]
    good = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["n_chars"] > 800][:40]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in good]
    extra = [(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (9003, "x " + bench, "en", "s", 9), (9004, rows[0][1].replace(",", " ,"), "en", "s", 9), (9005, rows[0][1], None, "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows + extra, schema)
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    ids = lambda out: {r["doc_id"] for r in out.collect()}
    assert ids(df) - ids(stage["language ID"](spark, df, sf)) == {9001, 9002}
    assert 9005 not in ids(stage["SimHash near-dedup"](spark, df, sf)) and rows[0][0] in ids(stage["SimHash near-dedup"](spark, df, sf))
    assert 9003 in ids(df) - ids(stage["benchmark decontamination"](spark, df, sf))
    empty = spark.createDataFrame([], schema)
    for f in stage.values():
        assert f(spark, empty, sf).count() == 0


def test_stages_hand_on_columns(spark, sf):
    """Clashing names, repeated rows, ties, nulls and very long texts through all stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = ["__row", "__text", "__id", "row", "id", "fp", "n", "keys", "form", "leaf", "items", "window", "ids", "__lang_pred", "first"]
    good = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    long = (9100, "".join(t[1] + " " for t in good[:80] if t[2] == "en") * 4, None, None, None)
    rows = good + good[:3] + [long, (9101, None, "en", "s", 1), (None, good[5][1] + " and something more", None, "s", 1), (9102, "x" * 300_000, None, "s", 1)]
    names = [*docs.columns, *clash]
    df = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], ", ".join(f"`{c}` {t}" for c, t in [*docs.dtypes, *((c, "int") for c in clash)]))
    kept = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == names, name
        got = kept.collect()
        assert all(r["form"] == clash.index("form") and r["ids"] == clash.index("ids") for r in got)
        kept = spark.createDataFrame(got, df.schema)
        if name == "language ID":
            assert {r["lang"] for r in got if r["doc_id"] == 9100} == {"en"} and 9101 not in {r["doc_id"] for r in got}
        if name == "SimHash near-dedup":
            assert len(got) == len({(r["doc_id"], r["text"]) for r in got})
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert last.columns == [*(c for c in names if c != "ids"), "ids", "n_tokens", "round_trip"] and all(r["round_trip"] for r in last.collect())
    bare = df.select("doc_id", "text")
    for _, stage in corpus_pipeline.STAGES:
        bare = spark.createDataFrame((out := stage(spark, bare.withColumn("lang", F.lit("en")) if "lang" not in bare.columns else bare, sf)).collect(), out.schema)
    assert bare.count() > 0


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert {*queries.ORACLE_SQL} <= {*names}
