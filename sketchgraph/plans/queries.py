"""The queries of the core operators over the tables, each over all rows, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text, vectors
from ..operators import bloom, graph, linalg, links, lsh, minhash, overlay, robots, search, weighted
from ..operators import crawl as crawling
from ..sources import text_files
from ..sources.pages import TableFetcher
from ..spread import spread
from . import ranker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters that Spark and SQL share.
K, PRIME, BANDS = 12, 1_000_003, 4
PARAMS = minhash.permutation_params(K, PRIME, seed=11)
SEARCHES = ("of the", "the of", "was with", "que de", "unknownword", "that that and")
TOP = 10
KEYWORDS = ("the", "de", "ein", "thand")
ROBOTS = ("User-agent: Special", "Disallow: /all", "User-agent: *", "Disallow: /wiki/Talk:", "Allow: /wiki/", "disallow: /w/", "Crawl-delay: 5", "User-Agent: *", "Disallow: /trap", "user-agent: other", "Disallow: /")
#: Documents that are looked up against all: every id divisible by this.
EVERY = 50


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


# Terms

TERMS_SQL = """terms as (
    select doc_id as doc, t.term from documents, lateral (select unnest(list_filter(
        list_transform(regexp_extract_all(text, '\\S+'), lambda x: regexp_replace(lower(x), '\\.|,|:|;|''', '', 'g')),
        lambda x: length(x) not in (1, 2) and x <> 'the')) as term) t),
tf as (select doc, term, count(*) as tf from terms group by all)"""


@query(f"with {TERMS_SQL} select doc, term, tf from tf")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.term_frequencies(documents(spark, sf_dir))


@query(f"with {TERMS_SQL} select (select count(distinct doc_id) from documents) as documents, count(distinct term) as terms, sum(tf)::bigint as total from tf")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return minhash.corpus_counts(docs, minhash.term_frequencies(docs))


STEPS = (text.extract_pattern("[A-Za-z]+"), text.lower(), text.remove_pattern("e|th"), text.drop_lengths((0, 1, 3)), text.drop_words(("OF", "nd")))


@query("""select doc, term, count(*) as tf from (select doc_id as doc, unnest(list_filter(list_filter(
    list_transform(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)), lambda x: regexp_replace(x, 'e|th', '', 'g')),
    lambda x: length(x) not in (0, 1, 3)), lambda x: lower(x) not in ('of', 'nd'))) as term from documents) group by all""")
def term_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline of single steps, as users compose them."""
    return minhash.term_frequencies(documents(spark, sf_dir), steps=STEPS)


@query(f"""with {TERMS_SQL}, n as (select doc, sum(tf) as n, count(*) as terms from tf group by doc),
met as (select a.doc as doc_a, b.doc as doc_b, sum(least(a.tf, b.tf)) as common, count(*) as shared from tf a join tf b using (term) group by all)
select doc_a, doc_b, round(common / (x.n + y.n - common), 6) as multiset_jaccard, round(shared / (x.terms + y.terms - shared), 6) as set_jaccard from met join n x on doc_a = x.doc join n y on doc_b = y.doc""")
def exact_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = minhash.term_frequencies(documents(spark, sf_dir))
    both = minhash.similarities(tf, tf)
    return both.select("doc_a", "doc_b", F.round("multiset", 6).alias("multiset_jaccard"), F.round("set", 6).alias("set_jaccard"))


# MinHash and LSH

JAVA_HASH = "(list_reduce(list_prepend(0::bigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296))"
WRAP = "(case when ({0}) >= 2147483648 then ({0}) - 4294967296 else ({0}) end)"
SIGNATURE_SQL = f"""{TERMS_SQL},
hashed as (select term, {WRAP.format('u')} as h from (select term, {JAVA_HASH.format('term')} as u from (select distinct term from tf))),
params as (select unnest({[a for a, _ in PARAMS]}) as a, unnest({[b for _, b in PARAMS]}) as b, unnest(range({K})) as place),
slots as (select doc, place, min({WRAP.format('v')} % {PRIME})::int as slot from (select doc, place, ((a * h + b) % 4294967296 + 4294967296) % 4294967296 as v from tf join hashed using (term), params) group by all),
sigs as (select doc_id as doc, case when count(slot) = 0 then list_transform(range({K}), lambda i: 2147483647) else list(slot order by place) end as signature from documents left join slots on doc = doc_id group by doc_id)"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return minhash.signatures(minhash.term_frequencies(docs), PARAMS, PRIME, docs)


@query(f"with {SIGNATURE_SQL} select doc, array_to_string(signature, ',') as signature from sigs")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(spark, sf_dir).select("doc", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query(f"""with {SIGNATURE_SQL}
select * from (select a.doc as doc_a, b.doc as doc_b, round(len(list_filter(list_zip(a.signature, b.signature), lambda p: p[1] = p[2])) / {K}, 6) as estimate from sigs a, sigs b where a.doc % 50 = 0 and a.doc <> b.doc) where estimate > 0""")
def minhash_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..checkpoints import written

    sigs = written(signatures(spark, sf_dir), "signatures")
    found = minhash.estimates(sigs.where(F.col("doc") % EVERY == 0), sigs, K)
    return found.withColumn("estimate", F.round("estimate", 6))


@query(f"""with {SIGNATURE_SQL}, n as (select doc, sum(tf) as n from tf group by doc),
met as (select a.doc as doc_a, b.doc as doc_b, sum(least(a.tf, b.tf)) as common from tf a join tf b using (term) where a.doc <> b.doc group by all),
rows as (select len(list_filter(list_zip(x.signature, y.signature), lambda p: p[1] = p[2])) / {K} as estimate, common / (p.n + q.n - common) as exact from met join sigs x on x.doc = doc_a join sigs y on y.doc = doc_b join n p on p.doc = doc_a join n q on q.doc = doc_b)
select count(*) as pairs, count(*) filter (abs(exact - estimate) > 0.1) as bad from rows""")
def minhash_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tf = minhash.term_frequencies(docs)
    return minhash.accuracy_of_met(tf, minhash.signatures(tf, PARAMS, PRIME, docs), K, 0.1)


BUCKET_SQL = f"""{SIGNATURE_SQL},
bands as (select doc, signature, unnest(range({BANDS})) as band from sigs),
buckets as (select doc, band, list_reduce(list_prepend(1::bigint, list_transform(signature[band * {K // BANDS} + 1 : (band + 1) * {K // BANDS}], lambda x: x::bigint)), lambda h, x: ((h * 31 + x) % 4294967296 + 4294967296) % 4294967296) as u from bands)"""


@query(f"with {BUCKET_SQL} select doc, band::int as band, {WRAP.format('u')}::int as key from buckets")
def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.buckets(signatures(spark, sf_dir), K, BANDS)


@query(f"""with {BUCKET_SQL}, met as (select distinct a.doc as query, b.doc from buckets a join buckets b using (band, u) where a.doc % 50 = 0 and a.doc <> b.doc)
select doc_id as doc, coalesce(string_agg(met.doc::varchar, ',' order by met.doc), '') as near from documents left join met on query = doc_id where doc_id % 50 = 0 group by doc_id""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..checkpoints import written

    sigs = written(signatures(spark, sf_dir), "signatures")
    threshold = (1 / BANDS) ** (BANDS / K)  # where the curve of BANDS bands is steepest
    near = lsh.near_duplicates_of(sigs.where(F.col("doc") % EVERY == 0), sigs, K, threshold)
    return near.select("doc", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("near"))


@query("select * from (values (600, 0.85, 30, 20), (600, 0.4, 120, 5), (400, 0.5, 80, 5), (100, 0.8, 10, 10)) t(k, threshold, bands, band_rows)".replace("0.85", "0.85::double").replace("0.4,", "0.4::double,").replace("0.5,", "0.5::double,").replace("0.8,", "0.8::double,"))
def band_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, t, b := lsh.band_count(k, t), k // b) for k, t in ((600, 0.85), (600, 0.4), (400, 0.5), (100, 0.8))]
    return spark.createDataFrame(rows, "k int, threshold double, bands int, band_rows int")


# Bloom filters


def _bloom_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))
    return names, names.unionAll(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key")))


def _bloom(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    keys, probes = _bloom_keys(spark, sf_dir)
    spec = bloom.BloomSpec(200_000, 8, kind, seed=3)
    return bloom.appears(probes, bloom.build(keys, spec), spec)


_SPEC = bloom.BloomSpec(200_000, 8, "ran", seed=3)
_FNV_STEP = f"((h * {hashing.FNV_PRIME}::hugeint) % 18446744073709551616)"
_SIGNED = "(case when {0} >= 9223372036854775808 then {0}::hugeint - 18446744073709551616 else {0}::hugeint end)"


def _ran_sql(spec: bloom.BloomSpec) -> str:
    """The places of a key by the hash `ran`, a list."""
    return "[" + ", ".join(f"((({WRAP.format(JAVA_HASH.format('lower(key)'))}::hugeint * {a} + {b}) % {spec.prime} % {spec.size} + {spec.size}) % {spec.size})::bigint" for a, b in spec.params) + "]"


def _fnv_sql(spec: bloom.BloomSpec) -> str:
    return f"""list_transform({hashing.fnv_salts(spec.hashes)}, lambda salt: (
    list_transform([list_reduce(list_prepend({hashing.FNV_BASIS}::hugeint, list_transform(string_split(lower(key) || salt, ''), lambda c: unicode(c)::hugeint)), lambda h, c: xor({_FNV_STEP}::ubigint, c::ubigint)::hugeint)],
        lambda u: (({_SIGNED.format('u')} % {spec.size} + {spec.size}) % {spec.size})::bigint)[1]))"""


def _murmur_sql(spec: bloom.BloomSpec) -> str:
    """For keys of ASCII: their bytes in words of eight, mixed; then a hash for each seed, the low half of the hash before."""
    times = lambda x: f"(({x})::uhugeint * {hashing.MURMUR64_M}::uhugeint % 18446744073709551616::uhugeint)::ubigint"
    fold = lambda x: f"xor({x}, {x} >> {hashing.MURMUR64_R})"
    byte = "unicode(lower(key)[8 * j + i + 1 : 8 * j + i + 1])::hugeint"
    word = f"list_sum(list_transform(range(8), lambda i: case when 8 * j + i < length(key) then {byte} * (1::hugeint << (i * 8)::hugeint) else 0::hugeint end))::ubigint"
    mixed = f"list_transform(range((length(key) + 7) // 8), lambda j: list_transform([{word}], lambda k: case when 8 * j + 8 <= length(key) then list_transform([{times('k')}], lambda t: {times(fold('t'))})[1] else k end)[1])"
    start = f"xor(seed & 4294967295::ubigint, {times('length(key)')})"
    body = f"list_reduce(list_prepend({start}, words), lambda h, k: {times('xor(h, k)')})"
    hash_ = f"list_transform([{body}], lambda h: list_transform([{times(fold('h'))}], lambda t: {fold('t')})[1])[1]"
    chain = f"list_reduce(list_prepend([{hashing.MURMUR64_SEED}::ubigint], list_transform(range({spec.hashes}), lambda n: [0::ubigint])), lambda so_far, n: list_concat(so_far, list_transform([so_far[len(so_far)]], lambda seed: {hash_})))"
    return f"list_transform(list_transform([{mixed}], lambda words: {chain})[1][2:], lambda u: (({_SIGNED.format('u')} % {spec.size} + {spec.size}) % {spec.size})::bigint)"


PLACES = {"ran": _ran_sql, "fnv": _fnv_sql, "murmur": _murmur_sql}
BLOOM_SQL = """with keys as (select distinct c_name as key, true as member from customer union all select distinct s_name, false from supplier),
places as (select key, member, {places} as pos from keys),
bits as (select distinct pos from (select unnest(pos) as pos from places where member)),
met as (select key, unnest(list_distinct(pos)) as pos from (select distinct key, pos from places))
select key, bool_and(pos in (select pos from bits)) as appears from met group by key"""


@query(BLOOM_SQL.format(places=_ran_sql(_SPEC)))
def bloom_ran(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bloom(spark, sf_dir, "ran")


@query(BLOOM_SQL.format(places=_fnv_sql(_SPEC)))
def bloom_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bloom(spark, sf_dir, "fnv")


@query(BLOOM_SQL.format(places=_murmur_sql(_SPEC)))
def bloom_murmur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bloom(spark, sf_dir, "murmur")


def _false_positives_sql(size: int = 10_000, bits: int = 16, probes: int = 100_000) -> str:
    uuid = lambda name: f"regexp_replace(md5('{name} ' || i), '(.{{{{8}}}})(.{{{{4}}}})(.{{{{4}}}})(.{{{{4}}}})(.{{{{12}}}})', '\\1-\\2-\\3-\\4-\\5')".replace("{{", "{").replace("}}", "}")
    parts = [f"keys as (select {uuid('in')} as key, true as member from range({size}) t(i) union all select {uuid('out')}, false from range({probes}) t(i))"]
    for kind in bloom.KINDS:
        parts.append(f"""{kind}_places as materialized (select key, member, unnest({PLACES[kind](bloom.BloomSpec(size, bits, kind))}) as pos from keys),
{kind}_bits as materialized (select distinct pos from {kind}_places where member),
{kind}_hits as (select key from {kind}_places p left join {kind}_bits b on b.pos = p.pos where not member group by key having count(*) = count(b.pos))""")
    rows = [f"select '{kind}' as kind, {probes}::bigint as probes, count(*) as hits, 100.0::double * count(*) / {probes} as measured, {100 * bloom.RATE**bits!r}::double as theoretical from {kind}_hits" for kind in bloom.KINDS]
    return "with " + ", ".join(parts) + " " + " union all ".join(rows)


@query(_false_positives_sql())
def bloom_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.false_positives(spark)


@query("select (select count(*) from customer) + 3 as data_size, 6::bigint as num_hashes, 1600000::bigint as filter_size")
def bloom_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, _ = _bloom_keys(spark, sf_dir)
    return bloom.metadata(keys.unionAll(keys.limit(3)), _SPEC)


# Differential lookups: orders are the base; the urgent ones, at twice the price, override them.


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    base = orders.select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("phrase"), F.col("o_totalprice").alias("price"))
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT")
    diff = urgent.select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit("ORDER "), F.col("o_orderkey")).alias("phrase"), (2 * F.col("o_totalprice")).alias("price"))
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select(F.concat(F.lit("order "), F.col("l_orderkey")).alias("key"))
    return keys.unionAll(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"))), base, diff


LOOKUP_SQL = """select 'order ' || l_orderkey as key, round(case when o_orderpriority = '1-URGENT' then 2 * o_totalprice else o_totalprice end, 4) as price
from (select distinct l_orderkey from lineitem) left join orders on o_orderkey = l_orderkey union all select n_name, null from nation"""


@query(LOOKUP_SQL)
def differential_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.lookup(*_orders(spark, sf_dir)).select("key", F.round("record.price", 4).alias("price"))


@query(LOOKUP_SQL)
def differential_lookup_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, base, diff = _orders(spark, sf_dir)
    return overlay.lookup_with_filter(keys, base, diff, bloom.BloomSpec(2_000_000, 16)).select("key", F.round("record.price", 4).alias("price"))


@query("""with k as (select l_orderkey as o from (select distinct l_orderkey from lineitem) union all select null from nation), d as (select o_orderkey as o from orders where o_orderpriority = '1-URGENT'),
n as (select (select count(*) from orders) as base, (select count(*) from d) as diff)
select 'naive' as method, count(*) + count(*) filter (d.o is null) as accesses,
    sum(coalesce(d.o, n.diff) + case when d.o is null then coalesce(orders.o_orderkey, n.base) else 0 end)::bigint as lines
from k left join d on k.o = d.o left join orders on orders.o_orderkey = k.o, n""")
def differential_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.access_counts(*_orders(spark, sf_dir))


@query("""with k as (select l_orderkey as o from (select distinct l_orderkey from lineitem) union all select null from nation), d as (select o_orderkey as o from orders where o_orderpriority = '1-URGENT'),
n as (select (select count(*) from orders) as base, (select count(*) from d) as diff), rows as (select d.o as d, orders.o_orderkey as b, n.* from k left join d on k.o = d.o left join orders on orders.o_orderkey = k.o, n)
select 'naive' as method, count(*) + count(*) filter (d is null) as accesses, sum(coalesce(d, diff) + case when d is null then coalesce(b, base) else 0 end)::bigint as lines from rows
union all select 'bloom', count(*) + 1, (sum(coalesce(d, b, base)) + max(diff))::bigint from rows""")
def differential_access_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter is so sparse, whatever the size of the differential, that it lets no other key through."""
    keys, base, diff = _orders(spark, sf_dir)
    return overlay.access_counts(keys, base, diff, spec=overlay.sparse(diff, 2_000_000, 16))


@query("""select o_orderkey as line_no, 'a b c ' || o_custkey as phrase, 'a b c ' || o_custkey || ' ' || year(o_orderdate) || ' ' || (o_orderkey % 50) || ' ' || (o_custkey % 20) as printed from orders where o_orderstatus <> 'P'""")
def ngram_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as n-gram lines, parsed and printed again; pending ones make a line that doesn't parse."""
    triple = F.concat_ws(" ", F.year("o_orderdate"), F.col("o_orderkey") % 50, F.col("o_custkey") % 20)
    line = F.concat(F.lit("a b c "), F.col("o_custkey"), F.lit(" "), triple, F.lit(" "), F.when(F.col("o_orderstatus") == "P", F.lit("x y z ")).otherwise(F.lit("")))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return text_files.parse_records(lines).select("line_no", "phrase", text_files.printed_record(F.col("phrase"), F.col("appearances")).alias("printed"))


# Files, written from the tables and read back


def _files(spark: SparkSession, rows: DataFrame, by: str | None = None) -> str:
    from ..checkpoints import shared_path

    path = shared_path(spark, "files")
    (rows.write.partitionBy(by) if by else rows.write).text(path)
    return path


@query("select 'UTF-8' as encoding, text, length(text)::int + 1 as n_chars from benchmark union all select 'ISO-8859-1', null, strlen(text)::int + 1 from benchmark")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a file for each item, read in two encodings."""
    path = _files(spark, table(spark, sf_dir, "benchmark").select(F.col("text").alias("value"), "item_id").repartition("item_id"), "item_id")
    utf8, latin = (text_files.documents(spark, f"{path}/*", *e).withColumn("n_chars", F.length("text")) for e in (("UTF-8",), ()))
    utf8 = utf8.select(F.lit("UTF-8").alias("encoding"), F.regexp_replace("text", "\n$", "").alias("text"), "n_chars")
    return utf8.unionAll(latin.select(F.lit("ISO-8859-1"), F.lit(None).cast("string"), "n_chars"))


@query("select n_name as key from nation")
def key_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.key_lines(spark, _files(spark, table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))))


@query("select row_number() over (order by o_orderkey) as line_no, 'order ' || o_orderkey as line from orders qualify o_orderkey % 7 <> 0")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of one file, some of them empty."""
    orders = table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("order "), F.col("o_orderkey"))).otherwise("")
    from ..checkpoints import shared_path

    path = shared_path(spark, "files")
    text_files.write_lines(orders.select("o_orderkey", line.alias("value")), ["o_orderkey"], path)
    return text_files.numbered_lines(spark, path)


# Graphs: suppliers point to the parts they have sold, and parts of one size to their suppliers' customers' orders no more.

EDGES_SQL = """edges as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select distinct 'p' || l_partkey, 's' || (l_suppkey % 7) from lineitem where l_partkey % 3 = 0)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    sold = items.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    back = items.where(F.col("l_partkey") % 3 == 0).select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("dst"))
    return sold.unionAll(back)


DEGREES_SQL = f"""{EDGES_SQL}, ids as (select src as id from edges union select dst from edges),
degrees as (select id, (select count(*) from edges where src = id) as out_degree, (select count(*) from edges where dst = id) as in_degree from ids)"""


@query(f"with {DEGREES_SQL} select * from degrees")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


@query(f"with {EDGES_SQL} select count(*) as edges from edges")
def edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_count(_edges(spark, sf_dir))


@query(f"with {EDGES_SQL} select src, dst, (select count(*) from (select src from edges union select dst from edges))::int as vertices from edges")
def edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as a file of the crawler's format, written and read."""
    from ..checkpoints import shared_path, written

    edges, path = written(graph.clean(_edges(spark, sf_dir)), "edges"), shared_path(spark, "edges")
    text_files.write_edge_list(edges, graph.vertices(edges).count(), path)
    vertices, back = text_files.edge_list(spark, path)
    return back.withColumn("vertices", F.lit(vertices))


def _rank_sql(steps: int) -> str:
    parts = [DEGREES_SQL, "r0 as (select id, out_degree, 1.0::double as rank from degrees)"]
    for i in range(steps):
        parts.append(f"""r{i + 1} as materialized (select r.id, r.out_degree, 0.85 * coalesce(g.given, 0) + 0.85 * s.dangling / s.n + 0.15 * s.total / s.n as rank from r{i} r
            left join (select dst as id, sum(rank / out_degree) as given from edges join r{i} on src = id group by dst) g on r.id = g.id, (select count(*) as n, sum(rank) as total, coalesce(sum(rank) filter (out_degree = 0), 0) as dangling from r{i}) s)""")
    return "with " + ", ".join(parts)


@query(f"{_rank_sql(4)} select id, round(rank, 6) as rank from r4")
def page_rank_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.page_rank(_edges(spark, sf_dir), iterations=4).select("id", F.round("rank", 6).alias("rank"))


def _converged_sql(approximation: float, before: str = EDGES_SQL) -> str:
    """CTEs up to r: turn, id, degrees, rank and the change of all ranks by that turn, until it is within the approximation."""
    return f"""{before}, ids as (select src as id from edges union select dst from edges),
outs as (select src as id, count(*) as out_degree from edges group by src), ins as (select dst as id, count(*) as in_degree from edges group by dst),
degrees as materialized (select id, coalesce(out_degree, 0) as out_degree, coalesce(in_degree, 0) as in_degree from ids left join outs using (id) left join ins using (id)),
r as (
    select 0 as turn, id, out_degree, in_degree, 1.0::double as rank, 1e300::double as change from degrees
    union all select turn, id, out_degree, in_degree, rank, sum(abs(rank - before)) over () as change from (
        select r.turn + 1 as turn, r.id, r.out_degree, r.in_degree, 0.85 * coalesce(g.given, 0) + 0.85 * s.dangling / s.n + 0.15 * s.total / s.n as rank, r.rank as before
        from r left join (select dst as id, sum(rank / out_degree) as given from edges join r on src = id group by dst) g on r.id = g.id,
            (select count(*) as n, sum(rank) as total, coalesce(sum(rank) filter (out_degree = 0), 0) as dangling from r) s
        where r.change > {approximation}))"""


@query(f"with recursive {_converged_sql(0.01)} select id, round(rank, 5) as rank, out_degree, in_degree from r where turn = (select max(turn) from r)")
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.page_rank(_edges(spark, sf_dir), approximation=0.01).withColumn("rank", F.round("rank", 5))


@query(f"{_rank_sql(4)} select id, round(rank, 6) as rank from r4 order by rank desc, id limit {TOP}")
def top_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_k(page_rank_steps(spark, sf_dir), "rank", TOP)


@query(f"with {DEGREES_SQL} select id, in_degree from degrees order by in_degree desc, id limit {TOP}")
def top_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_k(degrees(spark, sf_dir), "in_degree", TOP).select("id", "in_degree")


@query(f"with {DEGREES_SQL} select id, out_degree from degrees order by out_degree desc, id limit {TOP}")
def top_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_k(degrees(spark, sf_dir), "out_degree", TOP).select("id", "out_degree")


def _rankings_sql(before: str = EDGES_SQL) -> str:
    """CTEs up to ranked: list, place and id."""
    degree = lambda name, c: f"select '{name}' as list, row_number() over (order by {c} desc, id) as place, id from degrees"
    lists = [degree("A", "out_degree"), degree("B", "in_degree")]
    for i, a in enumerate(ranker.APPROXIMATIONS):
        lists.append(f"select '{chr(ord('C') + i)}', row_number() over (order by round(rank, {ranker.DIGITS}) desc, id), id from r where turn = (select min(turn) from r where change <= {a})")
    return f"{_converged_sql(min(ranker.APPROXIMATIONS), before)}, ranked as materialized (select list, place::int as place, id from ({' union all '.join(lists)}) where place <= {ranker.TOP})"


@query(f"""with recursive {_rankings_sql()}, sets as (select list, list(id) as ids from ranked group by list)
select a.list as list_a, b.list as list_b, len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))) as jaccard from sets a join sets b on a.list < b.list""")
def rankings_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's second half: five rankings of a graph, and how alike they are."""
    return ranker.likeness(ranker.rankings(_edges(spark, sf_dir)))


# Vectors and matrices


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), q as (select v as first from e where vec_id = (select min(vec_id) from embeddings))
select vec_id, round(list_sum(list_transform(v, lambda x: abs(x))), 5) as l1, round(coalesce(list_cosine_similarity(v, first), 0), 5) as cosine, round(list_sum(list_transform(list_zip(v, first), lambda p: abs(p[1] - p[2]))), 5) as l1_distance from e, q""")
def vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    first = F.array(*map(F.lit, rows.orderBy("vec_id").select("v").head()[0]))
    v = F.col("v")
    return rows.select("vec_id", F.round(vectors.l1_norm(v), 5).alias("l1"), F.round(vectors.cosine(v, first), 5).alias("cosine"), F.round(vectors.l1_norm(vectors.subtract(v, first)), 5).alias("l1_distance"))


CELLS_SQL = "cells as (select vec_id as row, unnest(embedding)::double as value, unnest(range(len(embedding))) as col from embeddings)"


@query(f"with {CELLS_SQL} select a.col::int as row, b.col::int as col, round(sum(a.value * b.value), 4) as value from cells a join cells b using (row) group by a.col, b.col")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = linalg.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return linalg.multiply(linalg.transpose(cells), cells).withColumn("value", F.round("value", 4))


@query(f"with {CELLS_SQL} select row, round(sum(value * (col + 1)), 4) as value from cells group by row")
def matrix_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = linalg.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    vector = cells.select(F.col("col").alias("row")).distinct().select("row", (F.col("row") + 1.0).alias("value"))
    return linalg.multiply_vector(cells, vector).withColumn("value", F.round("value", 4))


# Links and crawling


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages twice: as they are, and with their menus, which stand before the first paragraph, counted in."""
    pages = spread(table(spark, sf_dir, "pages").select("url", "html"))
    both = F.array(F.struct("url", "html"), F.struct(F.concat(F.lit("all "), F.col("url")).alias("url"), F.concat(F.lit("<p>"), F.col("html")).alias("html")))
    return pages.select(F.explode(both).alias("page")).select("page.*")


def _links_sql(keywords: tuple[str, ...], drop_self: bool) -> str:
    """CTEs from whole (url, html) to links (url, href, weight, seq)."""
    named = " or ".join(f"contains(lower(href), '{k}')" for k in keywords)
    return f"""bodies as (select url, regexp_extract(html, '(?is)<p>.*') as body from whole),
listed as (select url, regexp_extract_all(body, '(?i)<a\\s+[^>]*>|</a>|[a-zA-Z0-9_-]+|<[^>]*>') as t from bodies),
tokens as (select url, unnest(t) as token, unnest(range(len(t))) as i from listed),
kinds as (select *, case when regexp_matches(token, '(?i)^<a\\s') and regexp_matches(token, '(?i)^<a.*href="([^"]*)".*>') then regexp_extract(token, '(?i)^<a.*href="([^"]*)".*>', 1) end as href, token[1] <> '<' as word from tokens),
events as (select *, case when href is not null and not contains(href, '#') and not contains(href, ':') and not starts_with(href, '//') then 'open' when lower(token) = '</a>' then 'close' end as event from kinds),
placed as (select *, case when word then sum(word::int) over w - 1 end as pos, count(event) over w as part from events window w as (partition by url order by i)),
kw as (select url, pos as k from placed where word and lower(token) in {keywords}),
parts as (select url, part, arg_min(event, i) as event, arg_min(href, i) as href, coalesce(min(pos), -1) as b, coalesce(max(pos), -1) as e from placed where part > 0 group by url, part),
closed as (select * from (select *, lead(event) over (partition by url order by part) as next from parts) where event = 'open' and next = 'close'),
near as (select c.url, c.part, c.href, min(least(abs(b - k), abs(e - k))) as d, coalesce(bool_or(k between b and e), false) as inside from closed c left join kw using (url) group by all),
weighted as (select url, href, part as seq, case when inside or {named} then 1.0 when d <= 17 then 1.0 / (d + 2) else 0.0 end::double as weight from near),
best as (select *, row_number() over (partition by url, href order by weight desc, seq) as r from weighted),
links as (select url, href, weight, seq from best where r = 1{" and lower(href) <> lower(url)" if drop_self else ""})"""


@query(f"""with whole as (select url, html from pages union all select 'all ' || url, '<p>' || html from pages), {_links_sql(KEYWORDS, True)}
select url, href, round(weight, 6) as weight, seq from links""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(_pages(spark, sf_dir), KEYWORDS).withColumn("weight", F.round("weight", 6))


@query(f"""with l as (select unnest({list(ROBOTS)}) as line, unnest(range({len(ROBOTS)})) as n),
a as (select *, last_value(case when regexp_matches(line, '(?i)^user-agent:\\s*(.*)$') then regexp_extract(line, '(?i)^user-agent:\\s*(.*)$', 1) = '*' end ignore nulls) over (order by n) as applies from l),
p as (select regexp_extract(line, '(?i)^disallow:\\s*(.*)$', 1) as prefix from a where applies and regexp_matches(line, '(?i)^disallow:\\s*(.*)$')),
paths as (select url, page_id % 3 as host, case when page_id % 2 = 0 then '/wiki/Talk:' else '/wiki/' end || page_id as path from pages)
select url, case host when 0 then exists (select 1 from p where starts_with(path, prefix)) when 1 then starts_with(path, '/wiki/1') else false end as disallowed from paths""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of three hosts, of which one has no rules."""
    lines = [(0, i, x) for i, x in enumerate(ROBOTS)] + [(1, 0, "User-agent: *"), (1, 1, "Disallow: /wiki/1")]
    rules = robots.rules_by_host(spark.createDataFrame(lines, "host long, line_no int, line string"))
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/wiki/Talk:").otherwise("/wiki/"), F.col("page_id"))
    paths = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 3).alias("host"), path.alias("path"))
    return robots.flag_disallowed(paths, rules).select("url", "disallowed")


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site of customers whose pages link to others of it."""
    rows = table(spark, sf_dir, "customer")
    n = rows.count()
    link = lambda key: F.format_string('<a href="/c/%d">see %s</a>', F.pmod(key, F.lit(n)) + 1, F.lower("c_mktsegment"))
    body = F.concat_ws(" ", F.lit("<p>"), F.col("c_name"), F.lower("c_mktsegment"), *[link(F.col("c_custkey") * m + a) for m, a in ((3, 1), (7, 5), (11, 2), (1, 0))], F.lit('about building <a href="/c/1">home</a> </p>'))
    return rows.select(F.concat(F.lit("/c/"), F.col("c_custkey")).alias("url"), body.alias("html"))


SITE_ROBOTS, SITE_KEYWORDS, MOST = ("User-agent: *", "Disallow: /c/13", "Disallow: /c/99"), ("building", "machinery"), 500
#: The queue of the crawl as a list in a row for each step: entries of a weight (negated), a number and a url.
CRAWL_SQL = f"""size as (select count(*) as n from customer),
whole as (
    select '/c/' || c_custkey as url, concat_ws(' ', '<p>', c_name, lower(c_mktsegment), {", ".join(f"""'<a href="/c/' || ((c_custkey * {m} + {a}) % n + 1) || '">see ' || lower(c_mktsegment) || '</a>'""" for m, a in ((3, 1), (7, 5), (11, 2), (1, 0)))}, 'about building <a href="/c/1">home</a> </p>') as html
    from customer, size),
{_links_sql(SITE_KEYWORDS, False)},
linked as materialized (select url, list({{'h': href, 'w': weight}} order by weight desc, seq) as o from links group by url),
steps as (
    select 0 as step, [{{'w': 0.0::double, 's': 0::bigint, 'u': '/c/1'}}] as queue, []::varchar[] as visited, 1::bigint as seq
    union all select step + 1,
        list_concat(list_filter(rest, lambda x: len(list_filter(o, lambda y: y.h = x.u and y.w > -x.w)) = 0),
            list_filter(list_transform(o, lambda y, i: {{'w': -y.w, 's': seq + i, 'u': y.h}}), lambda z: len(list_filter(rest, lambda x: x.u = z.u and x.w <= z.w)) = 0)),
        case when barred then visited else list_append(visited, url) end, seq + len(o)
    from (
        select step, rest, visited, seq, p.url, barred, case when barred then [] else coalesce(o, []) end as o from (
            select step, list_filter(queue, lambda x: x.s <> best.s) as rest, visited, seq, best.u as url, list_contains(visited, best.u) or starts_with(best.u, '/c/13') or starts_with(best.u, '/c/99') as barred
            from (select *, list_sort(queue)[1] as best from steps where len(queue) > 0 and len(visited) < {MOST})) p left join linked on linked.url = p.url)),
seen as (select unnest(visited) as url, unnest(range(len(visited))) as place from (select visited from steps order by step desc limit 1)),
found as (select url as src, unnest(o).h as dst, row_number() over (order by place, i) - 1 as seq from (select seen.url, place, unnest(list_transform(o, lambda x: [x])) as o, unnest(range(len(o))) as i from seen join linked using (url))),
crawled as materialized (select src, dst, seq from found where dst in (select url from seen))"""


def _site_prefixes(spark: SparkSession) -> list[str]:
    lines = spark.createDataFrame([*enumerate(SITE_ROBOTS)], "line_no int, line string")
    return [r[0] for r in robots.disallowed_prefixes(lines, standard=True).collect()]  # one host's file


@query(f"with recursive {CRAWL_SQL} select src, dst, seq from crawled")
def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a crawl of up to 500 pages that its robots.txt allows."""
    return crawling.crawl("/c/1", TableFetcher(_site(spark, sf_dir)), SITE_KEYWORDS, MOST, prefixes=_site_prefixes(spark))[1]


@query(f"with recursive {_rankings_sql(CRAWL_SQL + ', edges as materialized (select distinct src, dst from crawled)')} select list, place, id from ranked")
def crawl_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.crawl_and_rank("/c/1", TableFetcher(_site(spark, sf_dir)), SITE_KEYWORDS, MOST, prefixes=_site_prefixes(spark))[1]


@query("""select item, weight, seq, position::int as position from (select *, row_number() over (order by weight desc, seq, item) as position from (
    select l_partkey as item, l_quantity::double as weight, l_orderkey * 10 + l_linenumber as seq from lineitem qualify row_number() over (partition by l_partkey order by l_quantity desc, l_orderkey * 10 + l_linenumber) = 1)) where position <= 50""")
def weighted_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 items of a queue."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_quantity").cast("double").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return weighted.first(weighted.heaviest(items), 50)


# Search

INDEX_SQL = """words as (select doc_id as doc, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
postings as (select doc, unnest(w) as term, unnest(range(len(w))) as pos from words),
counts as (select doc, term, count(*) as tf from postings group by all),
dfs as (select term, count(*) as df from counts group by term), n as (select count(distinct doc_id) as n from documents)"""


@query(f"with {INDEX_SQL} select term, df from dfs")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"with {INDEX_SQL} select term, doc, '<' || doc || ':' || string_agg(pos::varchar, ',' order by pos) || '>' as entry from postings group by term, doc")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.PositionalIndex.build(documents(spark, sf_dir)).entries()


@query(f"with {INDEX_SQL} select doc, term, round((sqrt(tf) * log10(n / df))::float::double, 3) as weight from counts join dfs using (term), n")
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = search.PositionalIndex.build(documents(spark, sf_dir)).weights()
    return weights.withColumn("weight", F.round(F.col("weight").cast("double"), 3))


def _wanted() -> str:
    rows = []
    for i, q in enumerate(SEARCHES):
        terms = search.query_terms(q)
        distinct = [*dict.fromkeys(terms)]
        rows += [f"({i}, {k}, '{t}', {terms.count(t)}, {len(distinct)})" for k, t in enumerate(distinct)]
    return ", ".join(rows)


SCORES_SQL = f"""{INDEX_SQL}, wanted(query, place, term, qtf, size) as (values {_wanted()}),
grid as (select distinct query, size, doc_id as doc from documents, (select distinct query, size from wanted)),
weights as (select doc, term, (sqrt(tf) * log10(n / df))::float::double as w from counts join dfs using (term), n),
norms as (select doc, sqrt(sum(w * w)) as norm from weights group by doc),
qweights as (select query, term, (sqrt(qtf) * log10(n / df))::float::double as q from wanted join dfs using (term), n),
qnorms as (select query, sqrt(sum(q * q)) as qnorm from qweights group by query),
dots as (select query, doc, sum(w * q) as dot from weights join qweights using (term) group by all),
gaps as (select a.query, p.doc, a.place, min(r.pos - p.pos) as gap from wanted a join wanted b on a.query = b.query and b.place = a.place + 1 join postings p on p.term = a.term join postings r on r.term = b.term and r.doc = p.doc and r.pos > p.pos group by all),
near as (select query, doc, sum(least(gap, 17)) as near, count(*) as found from gaps group by all),
scores as (select query, doc, case when size = 1 then 0 else size / (coalesce(near, 0) + 17 * (size - 1 - coalesce(found, 0))) end as tp, (case when coalesce(norm * qnorm, 0) = 0 then 0 else coalesce(dot, 0) / (norm * qnorm) end)::float as vs
    from grid left join near using (query, doc) left join dots using (query, doc) left join norms using (doc) left join qnorms using (query))"""


@query(f"with {SCORES_SQL} select query::int as query, doc, round(tp, 6) as tp, round(vs::double, 4) as vs, round(0.6 * tp + 0.4 * vs::double, 4) as relevance from scores")
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = search.PositionalIndex.build(documents(spark, sf_dir)).scores(SEARCHES)
    return scores.select("query", "doc", F.round("tp", 6).alias("tp"), F.round(F.col("vs").cast("double"), 4).alias("vs"), F.round("relevance", 4).alias("relevance"))


@query(f"with {SCORES_SQL}, r as (select *, row_number() over (partition by query order by 0.6 * tp + 0.4 * vs::double desc, doc) as place from scores) select query::int as query, place::int as place, doc from r where place <= {TOP}")
def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.PositionalIndex.build(documents(spark, sf_dir)).top_k(SEARCHES, TOP).select("query", "place", "doc")
