"""Token counts by compiled finite-state transducers.

Two deterministic transducers stand for a byte-level BPE tokenizer:

* the splitter reads classes of characters and marks where words begin. Its states are few, so a chunk of
  text is a map from the state before it to the state after it; the maps of all chunks are composed by a
  parallel prefix scan, which gives each chunk its first state;
* the counter reads the bytes of words. A state holds what later tokens can depend on: the last bytes that
  may begin a longer token, the last token at each of their borders, and how many tokens lie between them. Each
  transition carries the number of tokens that it adds to (or takes from) the count. States are compiled when
  they are first met and forgotten together beyond `MAX_TRANSITIONS`.

Words restart the counter, so chunks of whole words run side by side as numpy lanes. A long word is cut into chunks as well.
The map of a chunk says for the states that may come before it which state and how many tokens follow; these states are
guessed by runs that begin shortly before the chunk at several places. The maps are composed by a prefix scan from the
word's first state on; where a map lacks a state that comes before its chunk it gets that state, until none is missing. So
the counts are exact whatever was guessed.

Inputs: null and empty texts count 0 tokens; repeated rows and ids are counted each on its own; other columns of
the input are not read; an empty table gives an empty result; a word of any length is counted whole, `PIECE` bytes of it at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from ._common import map_arrow, slices, texts_of
from .bpe_merges import MergeTable

SCHEMA = "n_bytes long, n_tokens long"
#: Transitions a worker keeps (about 100 bytes each, with their states).
MAX_TRANSITIONS = 1_500_000
CHUNK, LANES = 256, 4096
#: Bytes of words that are cut into chunks, of a chunk, of the run before it, and places at which such runs begin.
LONG, STEP, WARM, PLACES = 2048, 512, 48, 4
#: Bytes of a word whose chunks are composed at once.
PIECE = 1 << 20

# Classes of characters.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# States of the splitter.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
#: Fixed values of the byte-level pattern: the endings after an apostrophe, by length.
ENDINGS = (("s", "t", "m", "d"), ("re", "ve", "ll"))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 stands for itself, the rest counts up from 256."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """What a tokenizers .json of a byte-level BPE holds, in the form the transducers need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError(f"{path} asks for options that the transducer doesn't have")
        self.special = []
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"added token {t['content']!r} strips or needs word borders")
            self.special.append(t["content"])
        to_byte = byte_alphabet()
        special, vocab = set(self.special), model["vocab"]
        self.tokens = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        merges, parts, ranks = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ids = vocab[a], vocab[b]
            merges.setdefault(ids, rank)
            if (t := vocab[a + b]) not in parts:
                parts[t], ranks[t] = ids, rank
        self.table = MergeTable.of(max(vocab.values()) + 1, merges, parts, ranks)
        # A vocabulary entry that its own merges don't make never comes out of an encoding.
        self.tokens = {t: i for t, i in self.tokens.items() if self.table.made(i)}


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(name, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    out[0x20] = SPACE
    return out


def symbol(kind: int, before_text: bool, ending: int, first: bool) -> int:
    """What the splitter reads: a class, whether a character other than white space follows, the length of the ending that follows an apostrophe, whether a text begins."""
    return ((kind * 2 + before_text) * 3 + ending) * 2 + first


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """By symbol * 8 + state: the next state, and 1 if a word begins."""
    step, begins = np.zeros((60, 8), np.uint8), np.zeros((60, 8), np.uint8)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for kind in range(5):
        for before_text in (False, True):
            for ending in range(3):
                for first in (False, True):
                    for state in range(8):
                        s, now = symbol(kind, before_text, ending, first), BEGIN if first else state
                        if now in (ONE_LEFT, TWO_LEFT):
                            to, begin = (BEGIN if now == ONE_LEFT else ONE_LEFT), 0
                        elif kind in run:
                            begin = int(now not in (run[kind], AFTER_SPACE))
                            to = run[kind] if not (ending and begin) else (ONE_LEFT, TWO_LEFT)[ending - 1]
                        elif before_text:  # the last white space goes with the word after it if it's a space
                            to, begin = (AFTER_SPACE if kind == SPACE else BEGIN), 1
                        else:
                            to, begin = IN_WHITE, int(now != IN_WHITE)
                        step[s, state], begins[s, state] = to, begin
    return step.ravel(), begins.ravel()


def word_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """1 where a word begins. points: code points of all texts; firsts: where texts that aren't empty begin."""
    n = len(points)
    kinds = char_classes()[points]
    white = kinds >= SPACE
    begin = np.zeros(n + 1, bool)
    begin[firsts] = begin[n] = True
    before_text = np.append(~white[1:], False) & ~begin[1:]
    ending = np.zeros(n, np.int64)
    quotes = np.flatnonzero(points == ord("'"))
    room = np.append(begin, [True, True])
    padded = np.append(points, [0, 0])
    for size, group in enumerate(ENDINGS, 1):
        for text in group:
            ok = np.ones(len(quotes), bool)
            for i, c in enumerate(text, 1):
                ok &= (padded[quotes + i] == ord(c)) & ~room[quotes + i]
            ending[quotes[ok]] = size
    symbols = symbol(kinds.astype(np.int64), before_text, ending, begin[:n])
    step, begins = splitter()
    # States that every symbol takes to the same state need one track of a chunk's map.
    _, tracks, track_of = np.unique(step.reshape(-1, 8), axis=1, return_index=True, return_inverse=True)
    track_of = track_of.ravel()
    rows = -(-n // CHUNK)
    grid = np.zeros(rows * CHUNK, np.int64)
    grid[:n] = symbols * 8
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.tile(tracks.astype(np.uint8), (rows, 1)).T
    for column in grid:
        maps = step[column + maps]
    maps = np.ascontiguousarray(maps.T)
    reach = 1
    while reach < rows:  # inclusive scan: after it, row i maps the state before all to the state after chunk i
        maps[reach:] = np.take_along_axis(maps[reach:], track_of[maps[:-reach]], 1)
        reach *= 2
    state = np.append(np.uint8(BEGIN), maps[:-1, track_of[BEGIN]]) if rows else maps[:, 0]
    out = np.empty((CHUNK, rows), np.uint8)
    for i, column in enumerate(grid):
        at = column + state
        out[i], state = begins[at], step[at]
    return out.T.ravel()[:n]


class Counter:
    """The counting transducer, compiled as it meets its input."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.live = {t[:i] for t in bpe.tokens for i in range(1, len(t))} | {b""}
        self.reset()

    def reset(self) -> None:
        self.bpe.table.known.clear()
        first = (b"", (None,), (0,))
        self.states, self.ids, self.n = [first], {first: 0}, 0
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        old = self.__dict__.get("keys") if self.n else None
        values = (self.keys[old >= 0], self.next[old >= 0], self.adds[old >= 0]) if old is not None else None
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys, self.next, self.adds = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int16)
        if values:
            left = values
            at = self._home(left[0])
            while len(left[0]):  # of those that meet in a slot the first gets it, the others go on
                free = self.keys[at] < 0
                _, one = np.unique(at, return_index=True)
                win = np.zeros(len(at), bool)
                win[one] = True
                win &= free
                self.keys[at[win]], self.next[at[win]], self.adds[at[win]] = (x[win] for x in left)
                left, at = tuple(x[~win] for x in left), (at[~win] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte, and the tokens it adds."""
        seen, tokens, counts = self.states[state]
        text, known, stable = seen + bytes((byte,)), self.bpe.tokens, self.bpe.table.stable
        for k in range(len(text), 0, -1):
            token = known.get(text[-k:])
            if token is not None and (before := tokens[k - 1]) != -1 and (before is None or stable(before, token)):
                add = counts[k - 1] + 1
                break
        keep = next(k for k in range(len(text), -1, -1) if text[len(text) - k :] in self.live)
        all_tokens, all_counts = (token, *tokens), (0, *(c - add for c in counts))
        need = [k == 0 or text[len(text) - k :] in self.live for k in range(keep + 1)]
        to = (text[len(text) - keep :], tuple(t if ok else -1 for t, ok in zip(all_tokens, need)), tuple(c if ok else 0 for c, ok in zip(all_counts, need)))
        return self.state(to), add

    def add(self, key: int) -> None:
        to, add = self.compiled(key >> 8, key & 255)
        if 2 * self.n > self.mask:
            self._grow(2 * (self.mask + 1))
        at = int(self._home(np.array([key]))[0])
        while self.keys[at] >= 0:
            at = (at + 1) & self.mask
        self.keys[at], self.next[at], self.adds[at], self.n = key, to, add, self.n + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where the transitions are in the table."""
        while True:
            at = self._home(keys)
            wrong = np.flatnonzero(self.keys[at] != keys)
            missing = []
            while len(wrong):
                missing.append(wrong[self.keys[at[wrong]] < 0])
                wrong = wrong[self.keys[at[wrong]] >= 0]
                at[wrong] = (at[wrong] + 1) & self.mask
                wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
            if not missing or not len(new := np.unique(keys[np.concatenate(missing)])):
                return at
            for key in new.tolist():
                self.add(key)

    def counts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Tokens that each byte adds. begins: True where a word does."""
        if self.n > MAX_TRANSITIONS:
            self.reset()
        starts = np.flatnonzero(begins)
        out = np.zeros(len(data), np.int16)
        if not len(starts):
            return out
        lanes = np.unique(starts[np.searchsorted(starts, np.linspace(0, starts[-1], min(LANES, len(starts))).astype(np.int64))])
        ends = np.append(starts[1:], len(data))
        long = ends - starts > LONG
        if long.any():
            begin, end = starts[long], ends[long]
            lanes = np.setdiff1d(np.union1d(lanes, end[end < len(data)]), begin)
            cut = np.union1d(lanes, begin)
            sizes = np.append(cut[1:], len(data))[np.searchsorted(cut, lanes)] - lanes
        else:
            sizes = np.append(lanes[1:], len(data)) - lanes
        data, restart = data.astype(np.int64), ~begins
        self.run(data, restart, lanes, sizes, np.zeros(len(lanes), np.int64), out)
        if long.any():
            self.words(data, begin, end, out)
        return out

    def run(self, data: np.ndarray, restart: np.ndarray | None, at: np.ndarray, sizes: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The states after stretches of data that begin in the given ones; out gets the tokens that each byte adds. restart: 0 where a word begins."""
        order = np.argsort(-sizes, kind="stable")
        at, sizes, state = at[order], sizes[order], state[order]
        after = state.copy()
        alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else np.zeros(0, np.int64)
        for n in alive.tolist():
            at, state = at[:n], state[:n]
            keys = (state if restart is None else state * restart[at]) << 8
            where = self.find(keys + data[at])
            if out is not None:
                out[at] = self.adds[where]
            after[:n] = state = self.next[where]
            at = at + 1
        back = np.empty_like(after)
        back[order] = after
        return back

    def words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
        """Fills out for long words, a piece of each at a time."""
        state = np.zeros(len(begin), np.int64)
        while len(begin):
            if self.n > MAX_TRANSITIONS:
                kept = [self.states[i] for i in state.tolist()]
                self.reset()
                state = np.array([self.state(x) for x in kept], np.int64)
            stop = np.minimum(begin + PIECE, end)
            state = self.chunks(data, begin, stop, state, out)
            more = stop < end
            begin, end, state = stop[more], end[more], state[more]

    def state(self, of: tuple) -> int:
        if (at := self.ids.get(of)) is None:
            at = self.ids[of] = len(self.states)
            self.states.append(of)
        return at

    def chunks(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Fills out for stretches of long words that begin in the given states; the states after them."""
        number = -(-(end - begin) // STEP)
        word = np.repeat(np.arange(len(begin)), number)
        first = np.cumsum(number) - number
        place = np.arange(len(word)) - first[word]
        at = begin[word] + place * STEP
        size = np.minimum(at + STEP, end[word]) - at
        # The domains of the maps, as chunk << 32 | state: the first chunks' states are known, the others' guessed.
        inner = np.flatnonzero(place)
        guesses = [(first << 32) | state]
        for i in range(PLACES):
            early = np.maximum(at[inner] - WARM - i, begin[word[inner]])
            known = np.where(early == begin[word[inner]], state[word[inner]], 0)
            guesses.append(inner << 32 | self.run(data, None, early, at[inner] - early, known))
        domain, after = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.unique(np.concatenate(guesses))
        last = np.append(word[1:] != word[:-1], True)
        while True:
            chunk = new >> 32
            there = self.run(data, None, at[chunk], size[chunk], new & 0xFFFFFFFF)
            domain, after = np.append(domain, new), np.append(after, there)
            order = np.argsort(domain)
            domain, after = domain[order], after[order]
            chunk = domain >> 32
            wanted = np.where(last[chunk], -1, (chunk + 1) << 32 | after)
            step = np.minimum(np.searchsorted(domain, wanted), len(domain) - 1)
            missing = (domain[step] != wanted) & (wanted >= 0)
            # The prefix scan: a map's composition with itself covers twice as many chunks each time.
            none = len(domain)
            step = np.append(np.where(missing | (wanted < 0), none, step), none)
            reached = np.full(len(word), none)
            reached[first] = np.searchsorted(domain, first << 32 | state)
            reach = 1
            while reach < number.max():
                mine = np.flatnonzero((place >= reach) & (place < 2 * reach))
                reached[mine] = step[reached[mine - reach]]
                step = step[step]
                reach *= 2
            if (reached < none).all():
                break
            new = np.unique(wanted[missing])
        self.run(data, None, at, size, domain[reached] & 0xFFFFFFFF, out)
        return after[reached[last]]


_counters: dict[int, Counter] = {}


def count_texts(bpe: ByteBPE, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    if (counter := _counters.get(0)) is None or counter.bpe is not bpe:
        counter = _counters[0] = Counter(bpe)
    parts, owner, extra = [], [], []
    for i, text in enumerate(texts):
        pieces = [text]
        for s in bpe.special:
            pieces = [x for p in pieces for x in p.split(s)]
        parts += pieces
        owner += [i] * len(pieces)
        extra.append((len(pieces) - 1, len(text.encode())))
    n_special, n_bytes = np.array(extra, np.int64).reshape(-1, 2).T
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = "".join(parts)
    points = np.frombuffer(data.encode("utf-32-le"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data.encode(), np.uint8)
    begins = np.zeros(len(raw), bool)
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    begins[chars] = word_starts(points, starts[sizes > 0])
    total = np.concatenate([[0], np.cumsum(counter.counts(raw, begins), dtype=np.int64)])
    edge = np.append(chars, len(raw))
    each = total[edge[starts + sizes]] - total[edge[starts]]
    return n_bytes, n_special + np.bincount(owner, each, len(n_bytes)).astype(np.int64)


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and n_tokens of each row. The tables of the tokenizer, bounded by its vocabulary, are broadcast."""
    ship(df.sparkSession)
    bpe = df.sparkSession.sparkContext.broadcast(ByteBPE(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n_bytes, n_tokens = count_texts(bpe.value, texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(n_tokens)], [part.schema.names[0], "n_bytes", "n_tokens"])

    ids = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = ids.schema["id"].dataType.simpleString()
    return map_arrow(ids, run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
