"""Document fingerprints as Merkle trees.

A text is cut, without losing a character, into sections (which end with an empty line), these into paragraphs (lines with
their break) and these into phrases, the leaves. A phrase ends with a word (what stands up to the next word, white space and
punctuation included) whose first code point is a multiple of `PHRASE`, or with its paragraph: the rule asks for no language,
and an edit moves no border but those beside it. A node's hash is that of its children's hashes, so equal roots mean
equal texts (up to a collision of 64 bits of MD5) and a walk down from the root finds the branches that differ. The
fingerprint is the tree as text:

    root (16 hex digits), then for each section "/" and its hash (8), for each of its paragraphs ":" and its leaves (8 each)

Likeness is the share of leaves, as the fingerprint holds them, that two trees have in common, 2 |A and B| / (|A| + |B|)
over distinct leaves.

Only DataFrame functions are used. The document after each one comes from a window within ranges of ids: the ranges
are cut at ids that occur, and the row at a cut is dealt to both sides, so no window spans the whole table.

Inputs: null and empty texts have the tree without leaves, and two of these are alike by 1; a null id sorts
below all others; rows with equal ids follow each other by the hash of their text and share one range; ids are integers;
the columns of the input other than id and text are not read; an empty table gives an empty result; a table of one row
has itself as the next one; texts and lines of any length are cut whole, in time that grows with their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHRASE = 4
PARAGRAPHS = r"[^\n]*\n|[^\n]+"
_GAP = r"\s\x0B\p{P}"
WORDS = rf"[^{_GAP}]*[{_GAP}]+|[^{_GAP}]+"
#: Ranges for each shuffle partition, so that hashed ranges spread evenly.
RANGES = 8
#: Ranges at most, as their cuts are literals of the plan; larger tables have longer ranges, no fewer rows.
MOST_RANGES = 20_000
#: Whole numbers from here on aren't all doubles, as which quantiles come.
EXACT = 1 << 53


def _runs(of: Column, ends) -> Column:
    """An array cut after each element that ends a run, and at its end."""
    def cut(xs: Column) -> Column:
        n = F.size(xs)
        at = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ends(F.get(xs, i - 1)))
        before = F.concat(F.array(F.lit(0)), F.slice(at, F.lit(1), F.size(at) - 1))
        return F.when(n > 0, F.zip_with(before, at, lambda a, b: F.slice(xs, a + 1, b - a))).otherwise(F.filter(F.array(xs), lambda x: F.lit(False)))

    return F.transform(F.array(of), cut)[0]


def _hash(of: Column) -> Column:
    return F.left(F.md5(F.array_join(of, "").cast("binary")), F.lit(16))


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tree(text: Column) -> Column:
    """The hashes of leaves (16 hex digits each), by section and paragraph."""
    phrases = lambda p: F.transform(_runs(_pieces(p, WORDS), lambda w: F.ascii(w) % PHRASE == 0), _hash)
    return F.transform(_runs(_pieces(F.coalesce(text, F.lit("")), PARAGRAPHS), lambda p: p == "\n"), lambda s: F.transform(s, phrases))


def leaves(of: Column) -> Column:
    """The distinct leaves as a fingerprint holds them."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(of)), lambda x: F.left(x, F.lit(8))))


def paragraphs(of: Column) -> Column:
    """The hash of each paragraph, by section."""
    return F.transform(of, lambda s: F.transform(s, _hash))


def printed(of: Column) -> Column:
    """The fingerprint of a tree."""
    section = lambda s, h: F.concat(F.lit("/"), F.left(h, F.lit(8)), F.lit(":"), F.array_join(F.transform(s, lambda p: F.array_join(F.transform(p, lambda x: F.left(x, F.lit(8))), "")), ":"))
    with_sections = lambda hashes: F.concat(_hash(hashes), F.array_join(F.zip_with(of, hashes, section), ""))
    return F.transform(F.array(F.transform(paragraphs(of), _hash)), with_sections)[0]


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct leaves."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def n_changed(a: Column, b: Column) -> Column:
    """Of two trees: the number of different paragraphs of the first that the second hasn't anywhere."""
    return F.size(F.array_except(F.flatten(paragraphs(a)), F.flatten(paragraphs(b)))).cast("long")


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Of two trees: section and paragraph numbers (from 0) of the first where it has what the second hasn't anywhere, found top down; what only moved doesn't differ.

    The time grows with the number of paragraphs times that of the differing ones.
    """
    def inside(there: Column) -> Column:
        new_sections, new = F.array_except(F.transform(there["a"], _hash), F.transform(there["b"], _hash)), F.array_except(F.flatten(there["a"]), F.flatten(there["b"]))
        place = lambda i: lambda p, j: F.when(F.array_contains(new, p), F.struct(i.alias("section"), j.alias("paragraph")))
        found = F.transform(there["a"], lambda s, i: F.when(F.array_contains(new_sections, _hash(s)), F.transform(s, place(i))).otherwise(F.array()))
        return F.filter(F.flatten(found), lambda x: x.isNotNull())

    return F.transform(F.array(F.struct(paragraphs(a).alias("a"), paragraphs(b).alias("b"))), inside)[0]


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and next_text: the text of the next lower id; after the lowest comes the highest."""
    rows = df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 63))))
    n = min(MOST_RANGES, RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.select("key")
    cuts = keys.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n)
    top = keys.agg(F.max("key")).head()[0]
    if top is None:
        return rows.select("id", "text", F.col("text").alias("next_text"))
    cuts = sorted({c for c in map(int, cuts) if c < top}) + [top]
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("key")))

    def ranges(cuts: list[int]) -> tuple[Column, Column, Column]:
        """Group, range and the cuts of the group of a key."""
        width = max(1, int(len(cuts) ** 0.5))
        groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
        group, nested = below(literal([g[-1] for g in groups])), F.array(*map(literal, groups))
        return group, F.col("group") * width + below(F.get(nested, F.col("group"))), nested

    if any(abs(c) >= EXACT for c in cuts):  # a cut need not be an id that occurs: its range ends at the last one that does
        group, place, _ = ranges(cuts)
        cuts = sorted(r["last"] for r in keys.withColumn("group", group).groupBy(place.alias("range")).agg(F.max("key").alias("last")).collect())
    group, place, nested = ranges(cuts)
    rows = rows.withColumn("group", group).withColumn("range", place)
    at_cut = F.array_contains(F.get(nested, F.col("group")), F.col("key"))
    after = F.when(F.col("key") == top, F.lit(0)).otherwise(F.col("range") + 1)
    places = F.when(at_cut, F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(after.alias("range"), F.lit(True).alias("guest"))))
    places = places.otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("guest"))))
    dealt = rows.select("id", "key", "text", F.explode(places).alias("place")).select("id", "key", "text", "place.*")
    order = Window.partitionBy("range").orderBy("guest", F.desc("key"), F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("not guest").select("id", "text", "next_text")


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with n_chars, its edited text (the last half replaced by as much of the next text's beginning) and next_text."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    out = with_next(df, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))


def fingerprints(df: DataFrame, text_cols: dict[str, str]) -> DataFrame:
    """df with a tree for each text column, under the name given for it."""
    return df.withColumns({to: tree(F.col(c)) for c, to in text_cols.items()})


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and their edited texts, with the likeness of each to its edited and its next text and the number of the edited text's paragraphs that differ."""
    rows = fingerprints(edited(df, id_col, text_col), {"text": "own", "edited_text": "new", "next_text": "next"})
    rows = rows.withColumns({f"{c}_leaves": leaves(F.col(c)) for c in ("own", "new", "next")})
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own_leaves"), F.col("new_leaves")).alias("near_edited"),
        likeness(F.col("own_leaves"), F.col("next_leaves")).alias("near_next"),
        n_changed(F.col("new"), F.col("own")).alias("n_changed"),
    )
