"""The registered queries of this subpackage: thin, with the parameters of production."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip_digests
from .chat import conversation_parts, link_turns
from .counts import Rollup
from .decontaminate import decontaminate
from .langid import identify_language
from .neardup import near_duplicates
from .quality import quality_rules
from .repeats import remove_repeats
from .secrets import scan_secrets
from .shared import shared_root, written
from .urls import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("cleaned_text")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "th")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations in reply order without quotes, in parts of 1,024 turns, which bound a row."""
    return conversation_parts(written(link_turns(_table(spark, sf_dir, "conversations")), "chat-linked"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).drop("score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches over all documents: inserts, deletes of exact copies, a new tokenizer, its counts revised; one is committed twice.

    Version ``words-1`` counts runs without white space.  ``words-2`` takes its place and
    splits at punctuation, which its revision counts too.  Of copies that of the least id
    stays, a null id coming last.  Rows of one text, source and language are first counted
    together, so neither a hot text nor a hot source meets in one task.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    measured = docs.select(
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "source", "lang", F.sha2("text", 256).alias("sha"),
        n(r"[^\x20\x09-\x0D]+").alias("w1"), n(r"[^\x20\x09-\x0D.,!?]+").alias("w2"), n(r"[.,!?]").alias("marks"),
    )
    alike = measured.groupBy("sha", "source", "lang").agg(
        F.count("*").alias("rows"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("w1", "w2", "marks")]
    )
    alike = written(alike, "counts-alike")
    place = F.struct("least", "source", "lang")
    firsts = alike.groupBy(F.col("sha").alias("s")).agg(F.min(place).alias("first"))
    marked = written(alike.join(firsts, F.col("sha") == F.col("s")).withColumn("keeps", place.eqNullSafe(F.col("first"))), "counts-marked")

    def change(rows: DataFrame, kind: str, tokenizer: str, new: str, times: Column | None = None, old: Column | None = None) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.expr(new).alias("n_tokens"),
            (old if old is not None else F.lit(None).cast("long")).alias("old_tokens"), (times if times is not None else F.lit(1).cast("long")).alias("times"),
        )

    store = Rollup(spark, f"{shared_root(spark)}/counts-{uuid.uuid4().hex[:8]}")
    load = change(marked, "insert", "words-1", "w1", F.col("rows"))
    kept = marked.filter("keeps")
    store.commit("1-load", load)
    store.commit("2-copies", change(marked, "delete", "words-1", "w1", F.col("rows") - F.col("keeps").cast("long")))
    store.commit("1-load", load)
    store.commit("3-retokenize", change(kept, "delete", "words-1", "w1").union(change(kept, "insert", "words-2", "w2")))
    store.compact()
    store.commit("4-count-marks", change(kept, "revise", "words-2", "w2 + marks", old=F.col("w2")))
    return store.totals().select("level", "source", "lang", "tokenizer", "n_docs", "n_tokens")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh
  from w
), n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all
), links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as node, doc_id as other from documents
  union
  select r.node, e.b from reach r join both_ways e on e.a = r.other
), comp as (select node, min(other) as component_id from reach group by node)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, comp.component_id, d.doc_id = comp.component_id as kept
from documents d join comp on comp.node = d.doc_id left join n on n.doc_id = d.doc_id
""",
    "op9_decontaminate": r"""
with t as (
  select 'd' as side, cast(doc_id as varchar) as id, text from documents union all select 'b', cast(item_id as varchar), text from benchmark
), w as (
  select side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from t
), items as (
  select id as item_id, least(len(ws), 13) as n, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i+12], ' '))) as g
  from w where side = 'b' and len(ws) > 0
), sizes as (select distinct n from items),
grams as (
  select id, sizes.n, unnest(range(1, len(ws) - sizes.n + 2)) as p, ws from w, sizes where side = 'd' and len(ws) >= sizes.n
), hits as (
  select distinct grams.id, p, grams.n, item_id from grams join items on items.n = grams.n and items.g = array_to_string(ws[p:p+grams.n-1], ' ')
), pos as (select distinct id, unnest(range(p, p + n)) as q from hits),
nh as (select id, count(*) as n_hit from pos group by id),
ni as (select id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from hits group by id)
select d.doc_id, cast(len(w.ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w.ws) as contaminated
from documents d join w on w.side = 'd' and w.id = cast(d.doc_id as varchar) left join nh on nh.id = w.id left join ni on ni.id = w.id
""",
    "op7_token_counts": r"""
with m as (
  select doc_id, source, lang, coalesce(text, '') as t from documents
), f as (
  select m.*, row_number() over (partition by t order by doc_id nulls last, source nulls first, lang nulls first) as place, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w1,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D.,!?]+|[.,!?]')) as w2 from m
), x as (
  select source, lang, 'words-1' as tokenizer, 1 as d, w1 as n from f
  union all select source, lang, 'words-1', -1, -w1 from f where place > 1
  union all select source, lang, 'words-1', -1, -w1 from f where place = 1
  union all select source, lang, 'words-2', 1, w2 from f where place = 1
), g as (
  select source, lang, tokenizer, sum(d) as n_docs, sum(n) as n_tokens from x group by all
)
select cast(3 - (case grouping(source, lang, tokenizer) when 0 then 0 when 1 then 1 when 3 then 2 else 3 end) as integer) as level,
  source, lang, tokenizer, cast(sum(n_docs) as bigint) as n_docs, cast(sum(n_tokens) as bigint) as n_tokens
from g group by rollup (source, lang, tokenizer)
""",
}
