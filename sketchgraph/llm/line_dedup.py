"""Lines that recur across documents, found by a tree of line templates.

The tree has a fixed depth: the number of tokens of a line, its `LEADING` first tokens, and in each leaf the templates of
its lines. Tokens with a digit are variable fields from the start; where such fields outnumber the other tokens, masked
lines would say too little, so they stand as they are. Other variable fields are learnt from the lines of a leaf: a line
is cut into up to `PARTS` parts (each token one, in lines of up to that many), and lines that agree in `ALIKE` of their
parts have one template, in which the parts that differ are wildcards.

Lines that agree so share at least one run of parts, if the parts beyond the leading tokens are cut into one run more
than may differ. Of the lines of a leaf that share a run the first one founds the template, and each of the others is
compared with it. A line that agrees with no founder is compared with every earlier line of its runs that up to `FEW` forms
share. In a run that more share, it's compared with those that have one of its first differences from the founder, in an order
that is the same for all: of one more than may differ, lines that agree have one in common. Where that many lines share such a
difference, they meet at the rests that their parts leave without those that may differ, one for each choice of these: two lines
agree if and only if they have a rest in common, so the first line of each rest is all that is needed. So the work is linear
however many lines share a run, and no two lines that agree are missed.

A line goes if an earlier document (by id, then by the hash of its text) has it in the same form or has one that agrees with
it; so a text that is copied as a whole stays once. As the wildcards of two pairs may lie in different places, a line can be
dropped for one that itself is dropped for an earlier one. `templates` gives what is recurring.

Only DataFrame functions are used; lines travel as hashes of bounded number, and a text moves once, to its list of lines to drop.

Inputs: null texts stay null, empty ones empty; lines without a token are never dropped; rows with equal id and text are
one document and are treated alike; null ids come first; a template within one document only is not recurring; all
columns of the input come back, whatever their names; an empty table gives an empty result; texts and lines of any length
are handled whole.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

LEADING, PARTS = 3, 1 << 4
#: Share of equal parts, as a fraction.
ALIKE = (4, 5)
#: Forms of a run up to which a line is compared with each; above, with those it can agree with. Either way is exact.
FEW = 32
SPACES = " \t\r\f\x0B"
_DOC = ("id", "hash")


def tokens(line: Column) -> Column:
    """The tokens of a line that has any, those with a digit as <*> unless they outnumber the others."""
    def masked(words: Column) -> Column:
        fields = F.transform(words, lambda t: t.rlike("[0-9]"))
        most = 2 * F.size(F.filter(fields, lambda x: x)) > F.size(words)
        return F.when(most, words).otherwise(F.zip_with(words, fields, lambda t, x: F.when(x, F.lit("<*>")).otherwise(t)))

    words = F.split(F.btrim(line, F.lit(SPACES)), f"[{SPACES}]+", -1)
    return F.when(line.rlike("[0-9]"), F.transform(F.array(words), masked)[0]).otherwise(words)


def leaves(lines: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns and form (hash of the masked line), leaf (hash of the number of tokens and the leading ones) and parts (a hash each) of each line, in column text, that has a token."""
    rows = lines.where(F.btrim("text", F.lit(SPACES)) != "").select(*columns, tokens(F.col("text")).alias("t")).withColumn("n", F.size("t"))
    begin = lambda i: F.shiftright(i * F.col("n"), PARTS.bit_length() - 1)
    stretches = F.transform(F.array(*map(F.lit, range(PARTS))), lambda i: F.hash(F.slice("t", begin(i) + 1, begin(i + 1) - begin(i))))
    parts = F.when(F.col("n") <= PARTS, F.transform("t", lambda t: F.hash(t))).otherwise(stretches)
    return rows.select(*columns, F.xxhash64("n", "t").alias("form"), F.xxhash64("n", F.slice("t", 1, LEADING)).alias("leaf"), parts.alias("parts"))


def _cut(i: Column, n: Column, of: Column) -> Column:
    """Where the i-th of `of` equal stretches of n begins."""
    return F.call_function("div", i * n, of).cast("int")


def _may_differ(parts: Column) -> Column:
    return _cut(F.size(parts), F.lit(ALIKE[1] - ALIKE[0]), F.lit(ALIKE[1]))


def _free(parts: Column) -> Column:
    """The parts but those that are leading tokens, which all lines of a leaf have in common."""
    return F.when(F.size(parts) < PARTS, F.slice(parts, LEADING + 1, PARTS)).otherwise(parts)


def runs(leaf: Column, parts: Column) -> Column:
    """The numbers and hashes of a line's runs of parts, one more than may differ; none where none may."""
    free = _free(parts)
    count, n = _may_differ(parts) + 1, F.size(free)
    run = lambda i: F.struct(i.alias("i"), F.xxhash64(leaf, i, F.slice(free, _cut(i, n, count) + 1, _cut(i + 1, n, count) - _cut(i, n, count))).alias("run"))
    return F.when(count > 1, F.transform(F.sequence(F.lit(0), count - 1), run)).otherwise(F.array().cast("array<struct<i:int,run:bigint>>"))


def _choices(left: Column, may: Column) -> Column:
    """Each choice of `may` (or all) of `left` places, as a number with five bits for each place; 31 for none."""
    sizes = set()
    for n in range(1, PARTS + 1):
        k, free = n * (ALIKE[1] - ALIKE[0]) // ALIKE[1], n - LEADING if n < PARTS else n
        sizes |= {(free - (i + 1) * free // (k + 1) + i * free // (k + 1), k) for i in range(k + 1) if k}
    out = F.lit(None).cast("array<bigint>")
    for n, k in sorted(sizes):
        codes = (sum(x << 5 * j for j, x in enumerate((*c, *[31] * (k - len(c))))) for c in combinations(range(n), min(n, k)))
        out = F.when((left == n) & (may == k), F.expr(f"array({', '.join(f'{c}L' for c in codes)})")).otherwise(out)
    return out


def rests(members: DataFrame, *columns: str) -> DataFrame:
    """The columns and rest (a hash) of each choice of parts that may differ, from run, i (its number) and parts of each row."""
    free, may = _free(F.col("parts")), _may_differ(F.col("parts"))
    n, inside = F.size(free), lambda at: (at >= _cut(F.col("i"), n, may + 1)) & (at < _cut(F.col("i") + 1, n, may + 1))
    left = F.filter(F.transform(free, lambda p, at: F.when(~inside(at), F.xxhash64(at, p))), lambda h: h.isNotNull())
    rows = members.select(*columns, "run", left.alias("left"), may.alias("may"))
    whole = F.aggregate("left", F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(h))
    rows = rows.select(*columns, "run", "left", "may", whole.alias("rest"), F.explode(_choices(F.size("left"), F.col("may"))).alias("choice"))
    rest = F.col("rest")
    for j in range(PARTS * (ALIKE[1] - ALIKE[0]) // ALIKE[1]):
        rest = rest.bitwiseXOR(F.when(F.lit(j) < F.col("may"), F.coalesce(F.get("left", F.shiftright("choice", 5 * j).bitwiseAND(31).cast("int")), F.lit(0))).otherwise(F.lit(0)))
    return rows.select(*columns, F.xxhash64("run", "choice", rest).alias("rest"))


def _doc_of(x: str) -> Column:
    return F.struct(*(F.col(f"{x}.{c}") for c in _DOC))


def _other(a: str, b: str) -> Column:
    return ~_doc_of(a).eqNullSafe(_doc_of(b))


def _agree(a: str, b: str) -> Column:
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))
    return (F.size(a) == F.size(b)) & (differ <= _may_differ(F.col(a)))


def templates(lines: DataFrame) -> DataFrame:
    """form, first (id and hash of the first document that has it) and agrees (whether a line of an earlier document does) of each recurring form of lines.

    lines: id, hash, line (its number), form, leaf and parts of each line, as `leaves` gives them.
    """
    at = F.struct("id", "hash", "line")
    forms = lines.groupBy("form").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.first("leaf").alias("leaf"), F.first("parts").alias("parts"))
    forms = written(forms, "forms")
    keys = forms.select("form", "first", F.explode(runs(F.col("leaf"), F.col("parts"))).alias("k")).select("form", "first", "k.i", "k.run")
    founders = keys.groupBy("run").agg(F.min(F.struct("first", "form")).alias("founder"), F.max("first").alias("last"), F.count(F.lit(1)).alias("n")).select("run", F.col("founder.first").alias("keeper"), F.col("founder.form").alias("founder"), "last", "n")
    founders = written(founders.where(_other("keeper", "last")).drop("last"), "founders")  # an exchange of its own, so that Spark can split a hot run in the join
    later = written(keys.join(founders, "run").where(_other("first", "keeper")).select("form", "run", "founder", "n"), "later")
    own, theirs = forms.select("form", "parts"), forms.select(F.col("form").alias("founder"), F.col("parts").alias("others"))
    alike = later.select("form", "founder").distinct().join(own, "form").join(theirs, "founder").where(_agree("parts", "others"))
    alike = written(alike.select("form").distinct(), "alike")
    asking = written(later.where("n > 2").join(alike, "form", "left_anti"), "asking")
    if not asking.isEmpty():
        alike = alike.unionAll(_meeting(forms, keys, asking)).distinct()
    found = forms.select("form", "first", "last").join(alike.withColumn("agrees", F.lit(True)), "form", "left")
    return found.where(F.col("agrees") | _other("first", "last")).select("form", _doc_of("first").alias("first"), F.coalesce("agrees", F.lit(False)).alias("agrees"))


def _narrowed(members: DataFrame) -> DataFrame:
    """members, each once for each of its first differences from the founder's parts (base), and so in smaller runs."""
    free, base = _free(F.col("parts")), _free(F.col("base"))
    differences = F.filter(F.transform(free, lambda p, at: F.when(p != F.get(base, at), F.xxhash64("run", at, p))), lambda h: h.isNotNull())
    first = F.slice(F.array_sort(differences), F.lit(1), _may_differ(F.col("parts")) + 1)
    rows = members.select("form", "i", "doc", "parts", "asks", F.explode(first).alias("run"))
    sizes = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asked")).where("asked and n > 1")
    return rows.join(written(sizes.select("run", "n"), "sizes"), "run")


def _meeting(forms: DataFrame, keys: DataFrame, asking: DataFrame) -> DataFrame:
    """form of each of the asking ones (form, run, its founder and n, the forms of it) that agrees with any of its runs of an earlier document."""
    members = keys.select("form", "i", "run").join(asking.select("run", "founder", "n").distinct(), "run")
    members = members.join(asking.select("form", "run", F.lit(True).alias("asks")), ["form", "run"], "left")
    members = written(members.join(forms.select("form", _doc_of("first").alias("doc"), "parts"), "form"), "members")
    many = members.where(F.col("n") > FEW).join(forms.select(F.col("form").alias("founder"), F.col("parts").alias("base")), "founder")
    columns = ["run", "n", "i", "form", "doc", "parts", "asks"]
    members = written(members.where(F.col("n") <= FEW).select(columns).unionAll(_narrowed(many).select(columns)), "members")
    few, many = members.where(F.col("n") <= FEW), members.where(F.col("n") > FEW)
    others = few.select("run", F.col("doc").alias("other"), F.col("parts").alias("others"))
    found = few.where("asks").select("run", "form", "doc", "parts").join(others, "run").where((F.col("other") < F.col("doc")) & _agree("parts", "others")).select("form")
    if many.isEmpty():
        return found
    firsts = rests(many, "doc", "asks").groupBy("rest").agg(F.min("doc").alias("other"), F.max("doc").alias("last"), F.max("asks").alias("asks"))
    firsts = written(firsts.where("asks and other < last").select("rest", "other"), "rests")
    return found.unionAll(rests(many.where("asks"), "form", "doc").join(firsts, "rest").where("other < doc").select("form"))


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """df with recurring lines taken out of text_col, and the number of those in dropped_col if that is named, in place of a column of that name."""
    lines = F.split(F.col("__text"), "\n", -1)
    docs = df.select(F.struct("*").alias("__row"), df[id_col].alias("__id"), df[text_col].alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    at = docs.select(F.col("__id").alias("id"), F.col("__hash").alias("hash"), F.posexplode(lines).alias("line", "text"))
    at = written(leaves(at, ("id", "hash", "line")), "lines")
    doc = F.struct(*_DOC)
    shared = at.groupBy("leaf").agg(F.min(doc).alias("first"), F.max(doc).alias("last")).where("not (first <=> last)").select("leaf")
    at = written(at.join(written(shared, "leaves"), "leaf"), "shared")
    recurring = written(templates(at), "recurring")
    drops = at.join(recurring, "form").where(F.col("agrees") | ~doc.eqNullSafe(F.col("first"))).groupBy("id", "hash").agg(F.sort_array(F.collect_set("line")).alias("__drop"))
    drops = drops.select(F.col("id").alias("__drop_id"), F.col("hash").alias("__drop_hash"), "__drop")
    joined = docs.join(drops, F.col("__id").eqNullSafe(F.col("__drop_id")) & (F.col("__hash") == F.col("__drop_hash")), "left")
    n = F.size("__drop")
    # The lines between one dropped line and the next.
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("__drop"), i - 1) + 1)
    end = lambda i: F.when(i == n, F.size(F.col("__lines"))).otherwise(F.get(F.col("__drop"), i))
    left = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(F.col("__lines"), begin(i) + 1, end(i) - begin(i))))
    joined = joined.withColumn("__lines", F.when(F.col("__drop").isNotNull(), lines))
    text = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(F.array_join(left, "\n"))
    out = [text.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in df.columns if c != dropped_col]
    count = [F.coalesce(F.when(F.col("__drop").isNotNull(), n), F.lit(0)).cast("long").alias(dropped_col)] if dropped_col else []
    return joined.select(*out, *count)
