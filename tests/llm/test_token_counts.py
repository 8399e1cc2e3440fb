import random
import zlib

import numpy as np
import pytest

from sketchgraph.llm import bpe_merges, queries, records, sentencepiece_codec, token_counts
from sketchgraph.llm.word_table import LONGEST, WordTable, span_keys

LETTERS = "aabcdestrvmlT'  \n\t.,!?12éß好🙂‍ -=_\x00\x1c\x85\xa0"
PATH, PIECES = queries.tokenizer(queries.BYTE_BPE), queries.tokenizer(queries.PIECES)


def odd_texts(n=800, seed=1):
    r = random.Random(seed)
    wild = lambda: chr(r.choice([r.randint(0, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x10FFFF)]))
    out = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(n)]
    out += ["".join(wild() for _ in range(r.randint(0, 30))) for _ in range(n)]
    out += ["", " ", "a", "\n\na", " a  ", "x's", "don't 'tis ''s \n's 've'll'd're'ret 'RE", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<s> </s><0x41>", "▁a ▁"]
    return out + [" " * 700 + "x", "-" * 900, "a" * 3000, "the" * 200, "=" * LONGEST + " " + "=" * (LONGEST + 1), "word " * 20_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def pieces():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def test_counts_like_the_library(library):
    bpe, texts = token_counts.ByteBPE(PATH), odd_texts()
    n_bytes, n_tokens = token_counts.count_texts(bpe, texts)
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]
    assert n_tokens.tolist() == [len(x) for x in library(texts)]
    assert [len(x) for x in token_counts.count_texts(bpe, [])] == [0, 0]


def test_counts_after_forgetting(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 500)
    bpe, texts = token_counts.ByteBPE(PATH), odd_texts(150, 3)
    for _ in range(3):
        assert token_counts.count_texts(bpe, texts)[1].tolist() == [len(x) for x in library(texts)]


def long_words():
    r = random.Random(12)
    of = lambda parts, n: "".join(r.choice(parts) for _ in range(n))
    letters, mixed = "abcdefghijklmnopqrstuvwxyz", ["the", "ing", "tion", "and", "er", "Inter", "national", "qu", "x", "ß", "é", "日本", "語", "🙂"]
    out = ["a" * 200_000, "ab" * 30_000, "abcabcabd" * 5000, of(letters, 60_000), of(mixed, 20_000), "=" * 20_000, of("0123456789", 5000), " " * 5000 + "x"]
    return out + [" ".join(of(letters[:8], r.choice((3, 9, 1000, 1030, 2100, 2560, 7000))) for _ in range(60)) + " end"]


def test_long_words_like_the_library(library, monkeypatch):
    bpe, texts = token_counts.ByteBPE(PATH), long_words()
    want = [len(x) for x in library(texts)]
    assert token_counts.count_texts(bpe, texts)[1].tolist() == want
    monkeypatch.setattr(token_counts, "PIECE", 1 << 13)
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 5000)
    monkeypatch.setattr(token_counts, "WARM", 1)  # guesses that are mostly wrong
    monkeypatch.setattr(token_counts, "PLACES", 1)
    assert token_counts.count_texts(token_counts.ByteBPE(PATH), texts[-3:])[1].tolist() == want[-3:]
    assert token_counts.count_texts(token_counts.ByteBPE(PATH), texts[3:5])[1].tolist() == want[3:5]


def test_one_megabyte_without_white_space(library, pieces):
    """Twenty times the library's seconds, or some seconds on a busy machine, at most."""
    import time

    def seconds(f) -> float:
        start = time.perf_counter()
        f()
        return time.perf_counter() - start

    r = random.Random(13)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    bpe, codec = token_counts.ByteBPE(PATH), sentencepiece_codec.Codec(sentencepiece_codec.piece_model(PIECES))
    assert seconds(lambda: token_counts.count_texts(bpe, [text])) < max(20, 20 * seconds(lambda: library([text])))
    assert seconds(lambda: codec.encode([text])) < max(10, 20 * seconds(lambda: pieces.encode(text)))


def test_every_code_point_is_split_like_the_library(library):
    chars = [chr(c) for c in [*range(0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x110000, 101)]]
    texts = [f"a{c}{c} {c}1{c}\n" for c in chars]
    assert token_counts.count_texts(token_counts.ByteBPE(PATH), texts)[1].tolist() == [len(x) for x in library(texts)]


def test_stable_pairs():
    bpe = token_counts.ByteBPE(PATH)
    r = np.random.default_rng(0)
    ids = np.array([*bpe.tokens.values()])
    a, b = r.choice(ids, 20_000), r.choice(ids[:3000], 20_000)
    many = bpe.table.stable_many(a, b)
    assert many.tolist() == [bpe.table.stable(int(x), int(y)) for x, y in zip(a, b)]
    assert isinstance(bpe.table, bpe_merges.MergeTable) and not many.all()


def test_word_table():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(1, 1 << 63, 200_000).astype(np.uint64) | np.uint64(1))
    table = WordTable(4)
    for part in np.array_split(keys, 7):
        table.add(part)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()
    points = np.array([ord(c) for c in "abcabcab"], np.uint32)
    k = span_keys(points, np.array([0, 3, 6, 1]), np.array([3, 6, 8, 4]))
    assert k[0] == k[1] and len({*k.tolist()}) == 3


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")


def test_words_of_equal_keys(pieces, monkeypatch):
    from sketchgraph.llm import word_table

    monkeypatch.setattr(word_table, "span_keys", lambda points, starts, ends: span_keys(points, starts, ends) % np.uint64(7) | np.uint64(1))
    texts = odd_texts(200, 4)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.piece_model(PIECES))
    for _ in range(2):
        ids, starts = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == pieces.encode(texts)


def test_long_words_in_pieces(pieces, monkeypatch):
    texts = long_words()
    codec = sentencepiece_codec.Codec(sentencepiece_codec.piece_model(PIECES))
    want = pieces.encode(texts)
    for chars in (1 << 18, 1000):
        monkeypatch.setattr(sentencepiece_codec, "INDEX_CHARS", chars)
        ids, starts = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == want


def test_count_tokens(spark, library):
    texts = [None, "", "same", "same", *odd_texts(20)]
    got = token_counts.count_tokens(rows(spark, texts), PATH).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(x) for x in library([t or "" for t in texts])]
    assert token_counts.count_tokens(rows(spark, []), PATH).count() == 0


def test_records(spark, library, tmp_path):
    texts = [None, "", "same", "same", *odd_texts(60)]
    df = rows(spark, texts).unionByName(spark.createDataFrame([(None, "null id", 0), (2, "another 2", 0)], "doc_id long, text string, n_tokens int")).repartition(3)
    manifest = records.write_records(df, PATH, to=f"file://{tmp_path}/out")
    got = sorted(map(tuple, records.read_records(manifest).collect()), key=lambda r: r[1])
    want = sorted(((i, t or "") for i, t, _ in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(i, [*ids, 0]) for (i, _), ids in zip(want, library([t for _, t in want]))]
    assert [(i, np.frombuffer(ids, "<u4").tolist()) for i, _, ids in got] == want
    sizes = np.array([len(ids) for _, ids in want])
    assert [s for _, s, _ in got] == (np.cumsum(sizes) - sizes).tolist()
    shard = manifest.orderBy("shard").head()
    key, ids = records.record_at(shard["path"], 1)
    assert (key, ids.tolist()) == want[1]
    assert records.read_records(records.write_records(rows(spark, []), PATH)).count() == 0


def test_damaged_records(spark):
    import io

    good = records.frame(7, np.array([1, 70_000], np.uint32)) + records.frame(None, np.array([], np.uint32))
    assert [(k, i.tolist()) for k, i in records.frames(io.BytesIO(good))] == [(7, [1, 70_000]), (None, [])]
    for at in (0, 9, 14, 30, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(records.frames(io.BytesIO(good[:-2])))


def test_record_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = queries.QUERIES["op8_binary_records"](spark, sf).orderBy("doc_id").collect()
    ids = [np.array([*x, 0], "<u4") for x in library([d["text"] or "" for d in docs])]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(x), zlib.crc32(x.tobytes())) for x in ids]


def test_codec_like_the_library(pieces):
    codec, texts = sentencepiece_codec.Codec(sentencepiece_codec.PieceModel(PIECES)), odd_texts()
    for _ in range(2):  # the second time from memory
        ids, at = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == pieces.encode(texts, num_threads=1)
    for a, b, t in zip(at, at[1:], texts):
        assert codec.decode(ids[a:b].tolist()) == (t if "▁" not in t else t.replace("▁", " "))


def test_suffix_array():
    r = random.Random(2)
    for n in (1, 2, 50, 300):
        text = np.array([r.randint(0, 2) for _ in range(n)])
        key = lambda i: tuple(np.append(text[i : i + 8], np.zeros(8, int))[:8])
        order = sentencepiece_codec.suffix_array(text, 8).tolist()
        assert sorted(order) == [*range(n)] and all(key(a) <= key(b) for a, b in zip(order, order[1:]))


def test_occurrences():
    model = sentencepiece_codec.PieceModel(PIECES)
    text = "the theory of others, then thé"
    at, row = sentencepiece_codec.occurrences(np.array([ord(c) + 1 for c in text]), model)
    names = ["".join(chr(c - 1) for c in model.chars[i][: model.lengths[i]]) for i in range(len(model.ids))]
    want = {(i, p) for p in names for i in range(len(text)) if text.startswith(p, i)}
    assert {(int(a), names[b]) for a, b in zip(at, row)} == want and len(at) == len(want)


def test_encode_and_decode(spark, pieces):
    texts = [None, "", "same", "same", *odd_texts(20)]
    coded = sentencepiece_codec.encode(rows(spark, texts), PIECES, check_col="ok")
    got = sentencepiece_codec.decode(coded, PIECES).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in got] == pieces.encode([t or "" for t in texts], num_threads=1)
    assert all(r["ok"] == (r["decoded"] == (r["text"] or "")) and r["n_tokens"] == 1 for r in got)
    assert sentencepiece_codec.encode(rows(spark, []), PIECES).count() == 0
    clash = sentencepiece_codec.encode(rows(spark, texts[:4]).withColumnRenamed("text", "__text"), PIECES, text_col="__text", ids_col="n_tokens")
    assert clash.columns == ["doc_id", "__text", "n_tokens"] and [list(r["n_tokens"]) for r in clash.orderBy("doc_id").collect()][2] == pieces.encode("same")
    back = sentencepiece_codec.decode(clash, PIECES, ids_col="n_tokens", text_col="__text")
    assert {r["__text"] for r in back.collect()} == {"", "same"} and {*back.columns} == {*clash.columns}


def test_few_files_of_many_shards(spark, library):
    """The manifest of many shards is one file, and more shards than TASKS for each core are read by so many tasks, in order."""
    texts = [(i, f"text number {i} of all " * (i % 5)) for i in range(300)]
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = records.write_records(spark.createDataFrame(texts, "doc_id long, text string"), PATH)
        out = records.read_records(manifest)
        most = records.TASKS * spark.sparkContext.defaultParallelism
        assert manifest.count() > most >= out.rdd.getNumPartitions() and len(manifest.inputFiles()) == 1
        got = sorted(map(tuple, out.collect()))
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    at = 0
    for (i, _), own, (doc, start, ids) in zip(texts, library([t for _, t in texts]), got, strict=True):
        want = np.array([*own, 0], "<u4")
        assert (doc, start, ids) == (i, at, want.tobytes())
        at += len(want)
