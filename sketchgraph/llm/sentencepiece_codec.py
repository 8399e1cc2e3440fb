"""SentencePiece BPE encoding by suffix arrays, and decoding.

The words of a batch (white space and what follows it; no piece reaches over) are concatenated and indexed by a
suffix array, sorted by as many characters as the longest piece has. A binary search for every piece of the
vocabulary gives its range of occurrences; the occurrences are edges between positions. Sorted by the position
where they end, they are relaxed from left to right: of the edges into a position exactly one follows its
predecessor stably (see `bpe_merges`), and it is the last token of the encoding up to there. Words are relaxed side by
side; a word over `LONG` characters is relaxed on its own, edge by edge, and indexed in stretches that overlap by the longest
piece. Characters without a piece fall back to their bytes. Words that a worker has encoded are remembered.

Inputs: null and empty texts have no tokens; decoding gives the text back unless it holds U+2581 itself, which
the vocabulary uses for spaces; repeated rows are encoded each on its own; other columns of the input are not read;
an empty table gives an empty result; a text of any length is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from ._common import fresh, map_arrow, slices, texts_of
from .bpe_merges import MergeTable
from .word_table import WordMemo

SPACE = "▁"
#: Words a worker remembers, and characters that it indexes at once.
MAX_WORDS, INDEX_CHARS = 1_000_000, 1 << 18
#: Characters from which on a word is relaxed on its own, and pairs of tokens remembered for that.
LONG, MAX_PAIRS = 1024, 2_000_000


def merged(text: str, pieces: dict[str, int], score: list[float]) -> tuple[list[str], tuple[str, str] | None]:
    """The pieces of a short text by the definition of BPE (best score first, then leftmost), and the last two that were merged."""
    parts, last = list(text), None
    while True:
        best = None
        for i in range(len(parts) - 1):
            t = pieces.get(parts[i] + parts[i + 1])
            if t is not None and (best is None or score[t] > best[0]):
                best = score[t], i
        if best is None:
            return parts, last
        i = best[1]
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class PieceModel:
    """What a .model file of a BPE with byte fallback holds. A character without a piece is token `size` until its bytes replace it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        sp = SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(sp.serialized_model_proto())
        norm, kinds = spec.normalizer_spec, spec.SentencePiece.Type
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or norm.precompiled_charsmap or not norm.escape_whitespaces or norm.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is not a BPE that leaves texts as they are")
        self.prefix = norm.add_dummy_prefix
        self.size = n = len(spec.pieces)
        self.names = [p.piece for p in spec.pieces]
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError(f"{path} has user-defined or unused pieces")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        if len(self.bytes) != 256:
            raise ValueError(f"{path} has no byte fallback")
        pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        score = [p.score for p in spec.pieces]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"{path} has pieces over several words")
        order = {s: i for i, s in enumerate(sorted({score[i] for i in pieces.values()}, reverse=True))}
        merges, parts, ranks, made = {}, {}, {}, {}
        for text, t in pieces.items():
            for i in range(1, len(text)):
                if (a := pieces.get(text[:i])) is not None and (b := pieces.get(text[i:])) is not None:
                    merges[a, b] = order[score[t]]
            got, last = merged(text, pieces, score)
            if len(got) == 1:
                made[text] = t
                if last:
                    parts[t], ranks[t] = (pieces[last[0]], pieces[last[1]]), order[score[t]]
        words = [t for text, t in pieces.items() if len(text) > 1 and text.strip(SPACE)]
        if len({score[t] for t in words}) < len(words):
            raise ValueError(f"{path} has pieces of equal score")
        self.table = MergeTable.of(n + 1, merges, parts, ranks)
        # Runs of spaces may have equal scores, so their merges are not ordered by rank; the definition decides.
        runs = [p for p in made if not p.strip(SPACE)]
        self.runs = np.array([made[p] for p in runs], np.int64)
        self.run_stable = np.array([[merged(a + b, pieces, score)[0] == [a, b] for b in runs] for a in runs], bool).reshape(len(runs), len(runs))
        self.longest = max(map(len, made))
        self.lengths = np.array([len(p) for p in made], np.int64)
        self.ids = np.array([*made.values()], np.int64)
        self.chars = np.zeros((len(made), self.longest), np.int64)
        for row, p in zip(self.chars, made):
            row[: len(p)] = [ord(c) + 1 for c in p]
        self.surface = [b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.encode() for p in spec.pieces]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may follow token a, remembered."""
        known = self.table.known
        if (got := known.get((a, b))) is None:
            if len(known) > MAX_PAIRS:
                known.clear()
            got = known[a, b] = bool(self.stable(np.array([a]), np.array([b]))[0]) if self.surface_is_run(a) and self.surface_is_run(b) else self.table._stable(a, b, 1 << 62)
        return got

    def surface_is_run(self, token: int) -> bool:
        return token < self.size and not self.names[token].strip(SPACE)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.table.stable_many(a, b)
        place = np.full(self.size + 1, -1)
        place[self.runs] = np.arange(len(self.runs))
        both = np.flatnonzero((place[a] >= 0) & (place[b] >= 0))
        out[both] = self.run_stable[place[a[both]], place[b[both]]]
        return out


def packed(text: np.ndarray, at: np.ndarray, skip: int, take: int, bits: int) -> np.ndarray:
    """The numbers of a text from at + skip on, `take` of them in one; past the end counts as 0."""
    padded = np.append(text, np.zeros(skip + take, text.dtype))
    out = np.zeros(len(at), np.int64)
    for j in range(take):
        out = out << bits | padded[at + (skip + j)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a text of small numbers in the order of the `depth` (or more) numbers that begin there; past the end counts as 0."""
    bits = max(1, int(text.max(initial=0)).bit_length())
    take, every = min(depth, 62 // bits), np.arange(len(text))
    return np.lexsort([packed(text, every, skip, take, bits) for skip in range(0, depth, take)][::-1])


def occurrences(text: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Position and row of the model's piece of each occurrence of a piece in a text of code points plus 1, with a 0 in it."""
    alphabet, dense = np.unique(text, return_inverse=True)
    dense = dense.astype(np.int64)
    place = np.searchsorted(alphabet, model.chars)
    there = (alphabet[np.minimum(place, len(alphabet) - 1)] == model.chars) | (model.chars == 0)
    rows = np.flatnonzero(there.all(1))
    wanted, lengths = place[rows], model.lengths[rows]
    order = suffix_array(dense, model.longest)
    # The first characters of suffixes and pieces as one number each; shorter pieces stand for a range of numbers.
    bits = max(1, int(dense.max(initial=0)).bit_length())
    take = min(model.longest, 62 // bits)
    keys = packed(dense, order, 0, take, bits)
    least = np.zeros(len(rows), np.int64)
    for j in range(take):
        least = least << bits | wanted[:, j]
    most = least + (np.int64(1) << (bits * np.maximum(take - lengths, 0))) - 1
    low, high = np.searchsorted(keys, least, "left"), np.searchsorted(keys, most, "right")
    # Longer pieces: binary search by all of their characters within that range.
    long = np.flatnonzero((lengths > take) & (low < high))
    padded = np.append(dense, np.zeros(model.longest, dense.dtype))
    span = np.arange(model.longest)[None, :]
    bounds = []
    for upper in (False, True):
        left, right, open_ = low[long].copy(), high[long].copy(), np.arange(len(long))
        while len(open_ := open_[left[open_] < right[open_]]):
            middle = (left[open_] + right[open_]) // 2
            mine = wanted[long[open_]]
            here = padded[order[middle][:, None] + span]
            differ = (here != mine) & (span < lengths[long[open_]][:, None])
            first = differ.argmax(1)[:, None]
            step = np.take_along_axis(here, first, 1)[:, 0] - np.take_along_axis(mine, first, 1)[:, 0]
            after = differ.any(1) & (step < 0) | ~differ.any(1) & upper
            left[open_[after]], right[open_[~after]] = middle[after] + 1, middle[~after]
        bounds.append(left)
    low[long], high[long] = bounds
    n = high - low
    total = np.cumsum(n) - n
    at = np.repeat((low - total).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
    return order[at].astype(np.int32), np.repeat(rows.astype(np.int32), n)


def encode_words(model: PieceModel, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words (arrays of code points plus 1) in one array, and their numbers. 0 stands between words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(words), np.int64)
    text[np.delete(np.arange(len(text)), starts + sizes)] = np.concatenate(words)
    at, row = occurrences(text, model)
    length, piece = model.lengths[row].astype(np.int32), model.ids[row].astype(np.int32)
    single = np.zeros(len(text), bool)
    single[at[length == 1]] = True
    bare = np.flatnonzero(~single & (text != 0)).astype(np.int32)
    at, length, piece = np.append(at, bare), np.append(length, np.ones_like(bare)), np.append(piece, np.full_like(bare, model.size))
    begin = np.repeat(starts.astype(np.int32), sizes + 1)
    offset = at - begin[at] + length
    order = np.argsort(offset.astype(np.uint16) if len(offset) and offset.max() < 1 << 16 else offset, kind="stable")
    at, length, piece, offset = at[order], length[order], piece[order], offset[order]
    last, back, count = np.full(len(text), -1), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    begins = np.zeros(len(text), bool)
    begins[starts] = True
    edges = np.append(np.flatnonzero(np.append(True, offset[1:] != offset[:-1])), len(offset)) if len(offset) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        source, token, to = at[a:b], piece[a:b], at[a:b] + length[a:b]
        ok = begins[source]
        later = np.flatnonzero(~ok)
        ok[later] = model.stable(last[source[later]], token[later])
        last[to[ok]], back[to[ok]], count[to[ok]] = token[ok], source[ok], count[source[ok]] + 1
    ends = starts + sizes
    n = count[ends]
    base, out = np.cumsum(n) - n, np.zeros(int(n.sum()), np.int64)
    word, here = np.arange(len(words)), ends
    while len(word):
        token = last[here]
        out[base[word] + count[here] - 1] = np.where(token == model.size, -text[here - 1], token)
        here = back[here]
        left = here > starts[word]
        word, here = word[left], here[left]
    if len(bare := np.flatnonzero(out < 0)):
        chars, inverse = np.unique(-out[bare], return_inverse=True)
        fallback = [[model.bytes[b] for b in chr(c - 1).encode("utf-8", "replace")] for c in chars.tolist()]
        width = np.ones(len(out), np.int64)
        width[bare] = np.array([len(f) for f in fallback])[inverse]
        spread = np.repeat(out, width)
        spread[np.repeat(out < 0, width)] = np.concatenate([fallback[i] for i in inverse.tolist()])
        n = np.add.reduceat(width, base) if len(base) else n
        out = spread
    return out, n


def encode_long(model: PieceModel, word: np.ndarray) -> list[int]:
    """Ids of one word (an array of code points plus 1): its edges in the order in which they begin, relaxed one by one."""
    n = len(word)
    last, back, follows = [-1] * (n + 1), [0] * (n + 1), model.follows
    for start in range(0, n, INDEX_CHARS):
        text = np.append(word[start : start + INDEX_CHARS + model.longest], 0)
        at, row = occurrences(text, model)
        length, piece = model.lengths[row], model.ids[row]
        single = np.zeros(len(text), bool)
        single[at[length == 1]] = True
        bare = np.flatnonzero(~single & (text != 0))
        at, length, piece = np.append(at, bare), np.append(length, np.ones_like(bare)), np.append(piece, np.full_like(bare, model.size))
        order = np.argsort(at, kind="stable")
        order = order[at[order] < INDEX_CHARS]
        for a, step, token in zip((at[order] + start).tolist(), length[order].tolist(), piece[order].tolist()):
            if a == 0 or follows(last[a], token):
                last[a + step], back[a + step] = token, a
    out, here = [], n
    while here:
        out.append(last[here] if last[here] != model.size else -int(word[here - 1]))
        here = back[here]
    spread = []
    for token in reversed(out):
        if token < 0:
            spread += [model.bytes[b] for b in chr(-token - 1).encode("utf-8", "replace")]
        else:
            spread.append(token)
    return spread


class Codec:
    def __init__(self, model: PieceModel):
        self.model, self.memo = model, WordMemo(MAX_WORDS)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (and the last ones end)."""
        texts = [(SPACE if self.model.prefix else "") + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        space = points == ord(SPACE)
        first = space & ~np.append(False, space[:-1])[: len(space)]
        first[starts[sizes > 0]] = True
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], len(points)) if len(begins) else begins

        def words(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n, parts = np.zeros(len(a), np.int64), [np.zeros(0, np.int64)] * len(a)
            for i in np.flatnonzero(b - a > LONG).tolist():
                parts[i] = np.array(encode_long(self.model, points[a[i] : b[i]].astype(np.int64) + 1), np.int64)
                n[i] = len(parts[i])
            short = np.flatnonzero(b - a <= LONG)
            out, x, y = [], a[short], b[short]
            total, i = np.cumsum(y - x), 0
            while i < len(x):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + INDEX_CHARS, side="right")))
                out.append(encode_words(self.model, [points[p:q].astype(np.int64) + 1 for p, q in zip(x[i:j].tolist(), y[i:j].tolist())]))
                i = j
            if len(short) == len(a):
                return np.concatenate([ids for ids, _ in out]), np.concatenate([n for _, n in out])
            for k, ids in zip(short.tolist(), (x for ids, n in out for x in np.split(ids, np.cumsum(n)[:-1]))):
                parts[k], n[k] = ids, len(ids)
            return np.concatenate(parts), n

        ids, total = self.memo.ids(points, begins, ends, words)
        return ids, total[np.searchsorted(begins, np.append(starts, len(points)))]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.model.surface.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def _codec(model: PieceModel) -> Codec:
    if (codec := _codecs.get(0)) is None or codec.model is not model:
        codec = _codecs[0] = Codec(model)
    return codec


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """df's columns (all, or those named) with the ids of text_col (array of int) in ids_col, in place of one of that name.

    check_col, if named, says whether decoding the ids gives the text back (null counts as empty). The model, bounded by
    its vocabulary, is broadcast.
    """
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(piece_model(model_path))
    new = {ids_col: "array<int>"} | ({check_col: "boolean"} if check_col else {})
    columns = [c for c in (df.columns if columns is None else columns) if c not in new]
    source = fresh(df, "__text")
    rows = df.select(*columns, df[text_col].alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            for part in slices(batch, source):
                texts = texts_of(part, source)
                ids, starts = codec.encode(texts)
                out = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))]
                if check_col:
                    out.append(pa.array([codec.decode(ids[a:b].tolist()) == t for a, b, t in zip(starts[:-1].tolist(), starts[1:].tolist(), texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = [*columns, *new]
    return _mapped(rows, columns, run, new)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of ids_col in text_col, in place of a column of that name; null ids give an empty text."""
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(piece_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [codec.decode(x or []) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*columns, text_col])

    columns = [c for c in df.columns if c != text_col]
    return _mapped(df.select(*columns, df[ids_col].alias(fresh(df, "__ids"))), columns, run, {text_col: "string"})


def _mapped(df: DataFrame, columns: Sequence[str], run, new: dict[str, str]) -> DataFrame:
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns} | new
    return map_arrow(df, run, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))
