"""Benchmark items in documents, found by canonical templates.

Texts become sequences of template words: a number is the placeholder for numbers, a word of measure after a number
that for units, a capitalised word within a sentence that for names; neighbouring placeholders of a kind are one;
other words are taken in lower case and punctuation is left out. Windows of `WINDOW` template words are hashed and
joined to those of the benchmark, so an item is met with other numbers, names and units in it too. The windows of a
document and an item at one distance must then agree on their slots: a value of the item always stands for the
same value of the document, and two values for two. Distances that are no further apart than the item is long are
put together, those of most windows first, as far as their slots agree. An item leaks if they cover `COVERAGE` of its windows.

A capitalised word that begins a sentence may be a name or not. So each text is read twice, with these words as plain
ones and as names; a place of an item is covered if it is met in either reading.

Only windows that may be the benchmark's leave a worker: a bitmap of fixed size, whatever the benchmark's, sorts out
the others, and the join on the hash is exact.

Inputs: null and empty texts, and items without a word, match nothing; a text of fewer than WINDOW template words is one
window of its own length, and one of `LEAST_WITHIN` to WINDOW - 1 words is met in longer documents, too; rows with equal
id and text are one document; repeated items are items of their own; other columns are not read; an empty table on either
side gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import map_arrow, slices, texts_of, written

WINDOW, COVERAGE = 5, 0.8
#: Shorter items are met only as whole texts.
LEAST_WITHIN = 3
BITMAP_BITS = 24
MAX_WORDS = 200_000
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]")
#: Fixed words for numbers, of English, German, French and Spanish: from 0 (articles left out) to 20, then tens, then powers of ten.
COUNTS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty",
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig",
    "zéro - deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize - - - vingt",
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte",
)
TENS = ("thirty forty fifty sixty seventy eighty ninety", "dreißig vierzig fünfzig sechzig siebzig achtzig neunzig", "trente quarante cinquante soixante - - -", "treinta cuarenta cincuenta sesenta setenta ochenta noventa")
POWERS = {"hundred": 100, "hundert": 100, "cent": 100, "cien": 100, "ciento": 100, "thousand": 1000, "tausend": 1000, "mille": 1000, "mil": 1000, "million": 10**6, "millions": 10**6, "millionen": 10**6, "millón": 10**6, "millones": 10**6, "billion": 10**9, "milliarde": 10**9, "milliarden": 10**9, "milliard": 10**9, "milliards": 10**9}
NUMBER_WORDS = {w: n for words in COUNTS for n, w in enumerate(words.split())} | {w: 30 + 10 * n for words in TENS for n, w in enumerate(words.split())} | POWERS
#: Fixed words for measures, of the same languages.
UNIT_WORDS = frozenset(
    "mm cm dm m km meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres millimeter millimeters inch inches foot feet yard yards mile miles"
    " mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons"
    " second seconds minute minutes hour hours day days week weeks month months year years s min h percent cents dollar dollars euro euros usd eur"
    " mph kmh degree degrees celsius fahrenheit kelvin watt watts volt volts joule joules newton newtons hz khz mhz ghz byte bytes kb mb gb"
    " metern kilometern zentimeter millimeter meile meilen zoll fuß gramm kilogramm kilo kilos pfund tonne tonnen litern sekunde sekunden minute minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent cent pfennig grad"
    " mètre mètres kilomètre kilomètres centimètre centimètres millimètre millimètres mille milles pouce pouces pied pieds gramme grammes kilogramme kilogrammes livre livres seconde secondes heure heures jour jours semaine semaines mois an ans année années pour degré degrés"
    " metro metros kilómetro kilómetros centímetro centímetros milímetro milímetros milla millas pulgada pulgadas pie pies gramo gramos kilogramo kilogramos libra libras tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años ciento céntimo céntimos dólar dólares grado grados".split()
) - frozenset(("pour", "mille", "ciento"))
PLAIN, NUMBER, TITLE, UNIT = range(4)
_ENDER, _P = 4, [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
SLOT = {NUMBER: np.uint64(0x1111111111111110), TITLE: np.uint64(0x2222222222222220), UNIT: np.uint64(0x3333333333333330)}


class _Words(dict):
    """A word's 61-bit hash, above 3 bits for its kind."""

    def __missing__(self, word: str) -> int:
        low = code = word.lower()
        if word in ".!?:\n":
            kind = _ENDER
        elif word[0].isdigit() or low in NUMBER_WORDS:
            kind, code = NUMBER, str(NUMBER_WORDS.get(low, low))
        elif low in UNIT_WORDS:
            kind = UNIT
        else:
            kind = TITLE if len(word) > 1 and word[0].isupper() and word[1:].islower() else PLAIN
        raw = code.encode("utf-8", "replace")
        got = (((zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1] + b"#")) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) & ~7 | kind
        if len(self) > MAX_WORDS:
            self.clear()
        self[word] = got
        return got


_words = _Words()


def _changes(x: np.ndarray) -> np.ndarray:
    return np.append(True, x[1:] != x[:-1])


class _Sequence:
    """The template words of texts in one reading. names: a capitalised word that begins a sentence is a name, too."""

    def __init__(self, kinds: np.ndarray, codes: np.ndarray, owner: np.ndarray, starts: np.ndarray, names: bool):
        new_text = _changes(owner)
        number_before = np.append(False, kinds[:-1] == NUMBER) & ~new_text
        title = (kinds == TITLE) & (names | ~starts)
        slot = np.where((kinds == NUMBER) | (kinds == UNIT) & number_before | title, kinds, PLAIN)
        head = _changes(slot) | (slot == PLAIN) | new_text | title & starts
        self.names, self.first, self.of_word = names, np.flatnonzero(head), np.cumsum(head) - 1
        # The value of a slot of several words depends on their order.
        step = (np.arange(len(codes)) - self.first[self.of_word] + 1).astype(np.uint64)
        values = np.add.reduceat(codes * step, self.first)
        slot, self.codes, self.owner = slot[self.first], codes[self.first], owner[self.first]
        for kind, code in SLOT.items():
            self.codes[slot == kind] = code
        self.values = np.where(slot == PLAIN, np.uint64(0), values | np.uint64(1))
        begin = np.flatnonzero(_changes(self.owner))
        length = np.diff(np.append(begin, len(self.owner)))
        self.begin, self.length = np.repeat(begin, length), np.repeat(length, length)
        self.place = np.arange(len(self.owner)) - self.begin

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        out = np.full(len(at), width + 16 * self.names, np.uint64)
        for i in range(width):
            out += self.codes[at + i] * _P[i]
            out ^= out >> np.uint64(31)
        return out * _P[0]

    def slots(self, at: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(at), WINDOW), np.uint64)
        for i in range(width):
            out[:, i] = self.values[at + i]
        return out


def _readings(texts: list[str]) -> list[_Sequence]:
    got = [_TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, got), np.int64, len(got))
    codes = np.fromiter(map(_words.__getitem__, chain.from_iterable(got)), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    kinds, codes = (codes & np.uint64(7)).astype(np.int8), codes & ~np.uint64(7)
    word = kinds != _ENDER
    if not word.any():
        return []
    starts = (np.append(True, ~word[:-1]) | _changes(owner))[word]
    return [_Sequence(kinds[word], codes[word], owner[word], starts, names) for names in (False, True)]


def _joined(parts: list[tuple]) -> tuple:
    """owner, at, place, names, width, hash and slots of windows."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, WINDOW), np.uint64))
    return tuple(np.concatenate(x) for x in zip(empty, *parts))


def windows(texts: list[str], seen: np.ndarray, within: tuple[int, ...]) -> tuple:
    """The windows of documents that seen, a bitmap, has: those of WINDOW words or of a whole shorter text, and those of the widths within."""
    parts = []
    for s in _readings(texts):
        for width in range(1, WINDOW + 1):
            long_enough = s.length >= width if width in (WINDOW, *within) else s.length == width
            at = np.flatnonzero(long_enough & (s.place <= s.length - width))
            if not len(at):
                continue
            hashes = s.hashes(at, width)
            keep = np.flatnonzero(seen[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
            at, hashes = at[keep], hashes[keep]
            parts.append((s.owner[at], s.place[at], s.place[at], np.full(len(at), s.names), np.full(len(at), width), hashes, s.slots(at, width)))
    return _joined(parts)


def item_windows(texts: list[str]) -> tuple:
    """The windows of items, at their place in the plain reading; those of the reading with names stand for the places that they begin at."""
    parts = []
    if readings := _readings(texts):
        s = readings[0]
        at = np.flatnonzero(s.place <= s.length - np.minimum(s.length, WINDOW))
        for q in readings:
            mine = q.of_word[s.first[at]]
            mine = np.minimum(mine, q.begin[mine] + np.maximum(q.length[mine] - WINDOW, 0))
            for width in range(1, WINDOW + 1):
                pick = np.flatnonzero(np.minimum(q.length[mine], WINDOW) == width)
                to = mine[pick]
                parts.append((s.owner[at[pick]], s.place[at[pick]], q.place[to], np.full(len(to), q.names), np.full(len(to), width), q.hashes(to, width), q.slots(to, width)))
    return _joined(parts)


def _rows(df: DataFrame, id_col: str, text_col: str, seen: np.ndarray | None = None, within: tuple[int, ...] = ()) -> DataFrame:
    """id, row (hash of the text), at, place (in the window's own reading), names (that reading), width, window and slots of each window; n: places of the text. seen: bitmap of windows that matter; without it, texts are items."""
    ship(df.sparkSession)
    shared = None if seen is None else df.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                owner, at, place, names, width, hashes, slots = item_windows(texts) if shared is None else windows(texts, shared.value, within)
                if len(owner):
                    n = np.bincount(owner[~names], minlength=part.num_rows)
                    take, flat = pa.array(owner), slots.view(np.int64).ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, WINDOW), pa.int32()), pa.array(flat))
                    arrays = [part.column(0).take(take), part.column(1).take(take), *map(pa.array, (at, place, names, width)), pa.array(hashes.view(np.int64)), lists, pa.array(n[owner])]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "row", "at", "place", "names", "width", "window", "slots", "n"])

    texts = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("row"), df[text_col].alias("text"))
    return map_arrow(texts, run, f"id {texts.schema['id'].dataType.simpleString()}, row long, at long, place long, names boolean, width long, window long, slots array<long>, n long")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, row (xxhash64 of the text), item and coverage of each document that holds an item."""
    items = _rows(benchmark, item_col, item_text_col).select(F.col("id").alias("item"), F.col("at").alias("item_at"), F.col("place").alias("item_place"), F.col("names").alias("reading"), "width", "window", F.col("slots").alias("item_slots"), F.col("n").alias("item_n"))
    items = written(items.unionAll(_opening(benchmark, item_col, item_text_col)), "items")
    seen = np.zeros(1 << BITMAP_BITS, bool)
    seen[items.select(F.shiftrightunsigned("window", 64 - BITMAP_BITS).alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    within = tuple(r["width"] for r in items.select("width").distinct().collect() if LEAST_WITHIN <= r["width"] < WINDOW)
    met = _rows(docs, id_col, text_col, seen, within).drop("width").join(items, "window")
    pairs = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != 0)
    met = met.groupBy("id", "row", "item", "item_n", "reading", (F.col("place") - F.col("item_place")).alias("distance"))
    met = met.agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_list(pairs))).alias("pairs")).where(_one_to_one(F.col("pairs")))
    # Distances no further apart than the item is long share a stretch.
    stretch = F.floor(F.col("distance") / F.col("item_n"))
    met = met.withColumn("stretch", F.explode(F.array(stretch, stretch + 1)))
    part = F.struct(F.size("places").alias("n"), (-F.col("distance")).alias("at"), "reading", "places", "pairs")
    met = met.groupBy("id", "row", "item", "item_n", "stretch").agg(F.sort_array(F.collect_list(part), asc=False).alias("parts"))
    met = met.select("id", "row", "item", (F.size(_together(F.col("parts"))) / F.col("item_n")).alias("coverage"))
    return met.groupBy("id", "row", "item").agg(F.max("coverage").alias("coverage")).where(F.col("coverage") >= COVERAGE)


def _one_to_one(pairs: Column) -> Column:
    """Whether each value of an item has one value of the document, and the other way round."""
    distinct = lambda c: F.size(F.array_distinct(F.transform(pairs, lambda x: x[c])))
    return (F.size(pairs) == distinct("a")) & (F.size(pairs) == distinct("b"))


def _together(parts: Column) -> Column:
    """The places of the parts, in their order, whose slots agree with those taken before."""
    def step(so_far: Column, x: Column) -> Column:
        pairs = F.array_union(so_far["pairs"], x["pairs"])
        return F.when(_one_to_one(pairs), F.struct(F.array_union(so_far["places"], x["places"]).alias("places"), pairs.alias("pairs"))).otherwise(so_far)

    none = F.struct(F.array().cast("array<bigint>").alias("places"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("pairs"))
    return F.aggregate(parts, none, step)["places"]


def _opening(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """The first window of each item as it is within a sentence, where its first word is a name to the template."""
    again = benchmark.select(F.col(item_col).alias("__item"), F.concat(F.lit("x "), F.col(text_col)).alias("__text"))
    whole = _rows(benchmark, item_col, text_col).groupBy(F.col("id").alias("item")).agg(F.max("n").alias("item_n"))
    zero = F.lit(0).cast("long")
    second = _rows(again, "__item", "__text").where("at = 1 and not names").select(F.col("id").alias("item"), zero.alias("item_at"), zero.alias("item_place"), F.col("names").alias("reading"), "width", "window", F.col("slots").alias("item_slots"))
    return second.join(whole, "item").select("item", "item_at", "item_place", "reading", "width", "window", "item_slots", "item_n")


def flag_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, leaked items (array, ascending; empty if none) and the largest coverage (0 if none) of each row of docs."""
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).groupBy("id", "row").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("coverage").alias("coverage"))
    keys = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__row"))
    kind = found.schema["items"].dataType.simpleString()
    return keys.join(found, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__row") == F.col("row")), "left").select(F.col("__id").alias(id_col), F.coalesce("items", F.array().cast(kind)).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item of the benchmark."""
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col("id").alias("__leak_id"), F.col("row").alias("__leak_row")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["__leak_id"]) & (F.xxhash64(docs[text_col]) == found["__leak_row"]), "left_anti")
