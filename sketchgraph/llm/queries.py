"""The queries of this subpackage, each over its whole tables, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, line_dedup, merkle, quality, records, sentencepiece_codec, simhash, token_counts
from ._common import table

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_TOKENS = 512


def tokenizer(name: str) -> str:
    """Path of a vocabulary file: in the folder that SKETCHGRAPH_TOKENIZERS names, else in the installed public_tokenizers."""
    if folder := os.environ.get("SKETCHGRAPH_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(quality.remainder("doc_id", 5) == 0, F.lit(False))
    scores = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = sentencepiece_codec.encode(docs, tokenizer(PIECES), check_col="round_trip", columns=["doc_id"])
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = decontaminate.flag_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return flags.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", F.round("coverage", 6).alias("coverage"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_lines(docs, dropped_col="n_dropped")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(quality.remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.learn(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))
    return records.read_records(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, keep=("url",)).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_sentencepiece, op3_decontamination, op4_token_counts, op5_simhash_near_dedup, op6_line_dedup, op7_language_id, op8_binary_records, op9_document_fingerprints, op10_html_extraction)}

#: The digits, white space and fractions are those of line_dedup; a hash there is the string itself here.
LINE_DEDUP_SQL = """
with docs as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as line_no from docs),
words as (select doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \t\r\f\v]+'), lambda t: t <> '') as w from lines),
tokens as (
    select doc_id, line_no, case when 2 * len(list_filter(w, lambda t: regexp_matches(t, '[0-9]'))) > len(w) then w else list_transform(w, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) end as t
    from words where len(w) > 0),
firsts as (select t, min({'d': doc_id, 'l': line_no}) as first, max(doc_id) as last from tokens group by t),
forms as (select t, first, last, list_transform(range(least(len(t), 16)), lambda i: array_to_string(t[i * len(t) // least(len(t), 16) + 1 : (i + 1) * len(t) // least(len(t), 16)], ' ')) as p from firsts),
agreeing as (
    select distinct f.t from forms f join forms g on len(f.t) = len(g.t) and f.t[1:3] = g.t[1:3]
    where g.first.d < f.first.d and len(list_filter(list_zip(f.p, g.p), lambda x: x[1] <> x[2])) <= len(f.p) // 5),
drops as (select doc_id, line_no from tokens join firsts using (t) where doc_id <> first.d or t in (from agreeing)),
dropped as (select doc_id, list(line_no) as gone from drops group by doc_id)
select doc_id,
    case when gone is null then text else array_to_string(list_filter(lines, lambda l, i: not list_contains(gone, i - 1)), chr(10)) end as text,
    coalesce(len(gone), 0)::bigint as n_dropped
from docs left join dropped using (doc_id)
"""

#: The tree of merkle, level by level: a phrase is known by document, side and the numbers of its section, paragraph and place.
FINGERPRINTS_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
nexts as (select doc_id, text, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as next_text from docs),
sides as (
    select doc_id, 'own' as side, text from nexts union all select doc_id, 'next', next_text from nexts
    union all select doc_id, 'new', substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) from nexts),
lines as (select doc_id, side, unnest(p) as p, unnest(range(len(p))) as line from (select *, regexp_extract_all(text, '[^
]*
|[^
]+') as p from sides)),
placed as (select *, coalesce(sum((p = chr(10))::int) over (partition by doc_id, side order by line rows between unbounded preceding and 1 preceding), 0) as section from lines),
pieces as (select doc_id, side, line, section, unnest(w) as w, unnest(range(len(w))) as i from (select *, regexp_extract_all(p, '[^\s\p{P}]*[\s\p{P}]+|[^\s\p{P}]+') as w from placed)),
cut as (select *, coalesce(sum((unicode(w) % 4 = 0)::int) over (partition by doc_id, side, line order by i rows between unbounded preceding and 1 preceding), 0) as place from pieces),
phrases as (select doc_id, side, line, section, place, left(md5(string_agg(w, '' order by i)), 16) as leaf from cut group by all),
paragraphs as (select doc_id, side, line, section, left(md5(string_agg(leaf, '' order by place)), 16) as hash, string_agg(left(leaf, 8), '' order by place) as shown from phrases group by all),
sections as (select doc_id, side, section, left(md5(string_agg(hash, '' order by line)), 16) as hash, string_agg(shown, ':' order by line) as shown from paragraphs group by all),
trees as (select doc_id, side, left(md5(string_agg(hash, '' order by section)), 16) || string_agg('/' || left(hash, 8) || ':' || shown, '' order by section) as print from sections group by all),
leaves as (select distinct doc_id, side, left(leaf, 8) as leaf from phrases),
sizes as (select doc_id, count(*) filter (side = 'own') as own, count(*) filter (side = 'new') as new, count(*) filter (side = 'next') as next from leaves group by doc_id),
common as (select a.doc_id, count(*) filter (b.side = 'new') as new, count(*) filter (b.side = 'next') as next from leaves a join leaves b on a.doc_id = b.doc_id and a.leaf = b.leaf where a.side = 'own' and b.side <> 'own' group by a.doc_id),
changed as (select doc_id, count(distinct hash) as n from paragraphs a where side = 'new' and not exists (select 1 from paragraphs b where b.doc_id = a.doc_id and b.side = 'own' and b.hash = a.hash) group by doc_id)
select n.doc_id, length(n.text)::bigint as n_chars, sha256(e.text) as edited_sha256, coalesce(o.print, left(md5(''), 16)) as fingerprint, coalesce(w.print, left(md5(''), 16)) as edited_fingerprint,
    case when coalesce(s.own, 0) + coalesce(s.new, 0) = 0 then 1.0::double else 2.0::double * coalesce(c.new, 0) / (s.own + s.new) end as near_edited,
    case when coalesce(s.own, 0) + coalesce(s.next, 0) = 0 then 1.0::double else 2.0::double * coalesce(c.next, 0) / (s.own + s.next) end as near_next,
    coalesce(d.n, 0)::bigint as n_changed
from nexts n join sides e on e.doc_id = n.doc_id and e.side = 'new' left join trees o on o.doc_id = n.doc_id and o.side = 'own' left join trees w on w.doc_id = n.doc_id and w.side = 'new'
left join sizes s on s.doc_id = n.doc_id left join common c on c.doc_id = n.doc_id left join changed d on d.doc_id = n.doc_id
"""
ORACLE_SQL: dict[str, str] = {"op6_line_dedup": LINE_DEDUP_SQL, "op9_document_fingerprints": FINGERPRINTS_SQL}
