"""Token ids as length-delimited binary records.

A shard holds records in ascending order of their id; the shards follow one another in the order of their numbers.
A record, all numbers little-endian, is

    length of the payload (8 bytes), masked checksum of these 8 bytes (4), payload, masked checksum of it (4)

and its payload is the bytes of a token id (2 if all in the record are below 65,536, else 4), a flag byte (1: the id is
not null), the id (8 bytes, signed) and the token ids (unsigned). A checksum is a CRC-32, rotated right by 15 bits plus 0xA282EAD8, so that checksums of data that holds
checksums stay apart. Beside each shard lies an index: the offset of each record (8 bytes each), for shuffled reads.

A task writes files under names of its own, and the manifest lists those of the attempt that Spark took; a
task that is run again leaves files that nothing refers to.

Inputs: null and empty texts become records with the end id alone; equal ids are ordered by their text and then
by chance, which only equal rows can notice; null ids come first; other columns are not read; an empty table gives no
shard and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, shared_path, slices, texts_of, written
from .token_counts import word_starts
from .word_table import WordMemo

MANIFEST = "shard int, path string, n_records long, n_ids long"
HEAD, CRC, KEY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BBq")
#: Tasks for each core that read records.
TASKS = 4
#: Words whose ids a worker keeps, with about 60 bytes each.
MAX_WORDS = 1_200_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    payload = KEY.pack(width, key is not None, key or 0) + ids.astype(f"<u{width}").tobytes()
    size = HEAD.pack(len(payload))
    return b"".join((size, CRC.pack(masked(size)), payload, CRC.pack(masked(payload))))


def frames(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of an open shard; ValueError if a checksum or a length is wrong."""
    while head := stream.read(12):
        if len(head) < 12 or CRC.unpack_from(head, 8)[0] != masked(head[:8]):
            raise ValueError("the length of a record is damaged")
        size = HEAD.unpack_from(head)[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or CRC.unpack_from(body, size)[0] != masked(body[:size]):
            raise ValueError("a record is damaged")
        width, there, key = KEY.unpack_from(body)
        yield key if there else None, np.frombuffer(body[KEY.size : size], f"<u{width}")


def record_at(path: str, index: int) -> tuple[int | None, np.ndarray]:
    """One record of a shard by its number, through the index."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{name}.idx") as file:
        offset = HEAD.unpack(file.read_at(HEAD.size, HEAD.size * index))[0]
    with store.open_input_file(name) as file:
        file.seek(offset)
        return next(frames(file))


class Encoder:
    """Ids of whole texts. The library encodes each word once; words never share a token."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        if (t := type(self.library.pre_tokenizer).__name__) != "ByteLevel" or self.library.normalizer:
            raise ValueError(f"word by word encoding needs a byte-level tokenizer, not {t}")
        self.memo = WordMemo(MAX_WORDS)

    def encode(self, texts: list[str], end_id: int | None) -> list[np.ndarray]:
        """Ids of each text (uint32), with the end id after them."""
        parts: list[list[tuple[str, int | None]]] = []
        for text in texts:
            pieces: list[tuple[str, int | None]] = [(text, None)]
            for s, i in self.special.items():
                if s in text:
                    pieces = [y for p, k in pieces for j, x in enumerate(p.split(s) if k is None else [p]) for y in ([(s, i)] * (j > 0) + [(x, k)])]
            parts.append(pieces)
        plain = [x if k is None else "" for pieces in parts for x, k in pieces]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        starts = np.cumsum(sizes) - sizes
        data = "".join(plain)
        points = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        begins = np.flatnonzero(word_starts(points, starts[sizes > 0]))
        ends = np.append(begins[1:], len(points)) if len(begins) else begins

        def words(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = self.library.encode_batch([data[a:b] for a, b in zip(starts.tolist(), stops.tolist())], add_special_tokens=False)
            got = [e.ids for e in got]
            return np.fromiter((i for ids in got for i in ids), np.int32), np.fromiter(map(len, got), np.int64, len(got))

        out, total = self.memo.ids(points, begins, ends, words)
        out = out.astype(np.uint32)
        place = total[np.searchsorted(begins, np.append(starts, len(points)))].tolist()
        end = np.array([] if end_id is None else [end_id], np.uint32)
        rows, i = [], 0
        for pieces in parts:
            row = []
            for _, k in pieces:
                row.append(out[place[i] : place[i + 1]] if k is None else np.array([k], np.uint32))
                i += 1
            rows.append(np.concatenate([*row, end]))
        return rows


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(df: DataFrame, tokenizer_path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", to: str | None = None) -> DataFrame:
    """Writes the encoded texts in ascending order of id_col below `to` (else the shared folder); returns the manifest, a row for each shard."""
    to = to or shared_path(df.sparkSession, "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(to)
        shard, out, offsets, n_ids, at = TaskContext.get().partitionId(), None, [], 0, 0
        for batch in batches:
            for part in slices(batch):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                for key, ids in zip(part.column("id").to_pylist(), encoder(tokenizer_path).encode(texts_of(part), end_id)):
                    offsets.append(at)
                    at += out.write(frame(key, ids))
                    n_ids += len(ids)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{folder}/{name}.idx", compression=None) as index:
                index.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{to}/{name}"], "n_records": [len(offsets)], "n_ids": [n_ids]})

    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    return written(map_arrow(rows, run, MANIFEST).repartition(1), "manifest")  # a row for each shard: one file, not one for each


def read_records(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The records of all shards: id_col, start (ids of all records before it) and ids (binary, 4 bytes each, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(some: list) -> pa.RecordBatch:
            keys, starts, ids = zip(*some)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["id", "start", "ids"])

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                some, size = [], 0
                with store.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    for key, ids in frames(stream):
                        some.append((key, start, ids.astype("<u4").tobytes()))
                        start += len(ids)
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield rows(some)
                            some, size = [], 0
                if some:
                    yield rows(some)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    # Some shards to a task, if there are more than the cores need: a task holds a part of one shard at a time.
    shards = shards.repartition(max(1, min(manifest.count(), TASKS * manifest.sparkSession.sparkContext.defaultParallelism)))
    return map_arrow(shards, run, "id long, start long, ids binary").withColumnRenamed("id", id_col)
