"""Queries that apply the operators of this subpackage to their whole tables, and SQL for the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramo.llm import audit, bpe, chat, exact_dedup, langid, mixing, ngram_join, pivot_index, quality, sharding, token_file, toxicity, trie
from tramo.llm.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sources 0 to 11 are web pages, 12 to 16 books, others reference works.
MIX = mixing.Mixture(
    weights=({"web": 5, "books": 3, "reference": 2}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {"src0": 2}),
    budget_permille=900,
    max_epochs=3,
)


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    number = F.coalesce(F.regexp_extract("source", r"^src(\d{1,6})$", 1).try_cast("int"), F.lit(99))
    return docs.withColumn(name, F.when(number <= 11, "web").when(number <= 16, "books").otherwise("reference"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents")).withColumn("n_tokens", mixing.n_words(F.col("text")))
    return mixing.select(stage(docs.select("doc_id", "domain", "lang", "source", "n_tokens"), "counted"), MIX)


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.encode_to_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    records = chat.records_of_rows(rows.unionByName(planted), "conv_id", "turn", "role", "text", mixed=True)
    formatted = stage(chat.format_chats(chat.to_turns(records, "conv_id"), "conv_id"), "chats")
    return chat.digest(formatted, "conv_id")


def multilingual_bpe() -> bpe.Bpe:
    return bpe.Bpe.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), multilingual_bpe())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), ngram_join.Join(k=3, percent=90))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.judge(table(spark, sf_dir, "documents"))


def op10_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sources(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_bit_planes": op2_bit_planes,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_language": op7_language,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_sharding": op9_sharding,
    "op10_pivot_index": op10_pivot_index,
    "op11_audit": op11_audit,
    "op12_quality": op12_quality,
    "op13_trie": op13_trie,
}


def _share_sql(name: str, parent: list[str], key: str, source: str) -> str:
    """CTEs that share a parent's budget among siblings, as mixing.share() does."""
    part = f"partition by {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, key])
    return f"""
{name}_a as (select *, least(budget, sum(cap) over ({part})) as b,
  coalesce(sum(cap) over ({part} order by cap / w, {key} rows between unbounded preceding and 1 preceding), 0) as bef,
  sum(w) over ({part} order by cap / w, {key} rows between current row and unbounded following) as later from {source}),
{name}_b as (select *, cap * later <= (b - bef) * w as is_full from {name}_a),
{name}_c as (select *, b - sum(case when is_full then cap else 0 end) over ({part}) as lft,
  sum(case when is_full then 0 else w end) over ({part}) as wl from {name}_b),
{name}_d as (select *, case when is_full then cap else (lft * w) // greatest(wl, 1) end as part,
  case when is_full then -1 else (lft * w) % greatest(wl, 1) end as frac from {name}_c),
{name} as (select {keys}, cast(part + case when not is_full and row_number() over ({part} order by frac desc, {key}) <= b - sum(part) over ({part}) then 1 else 0 end as hugeint) as budget from {name}_d)"""


_MIX_SQL = f"""
with docs as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  case when coalesce(try_cast(regexp_extract(source, '^src([0-9]{{1,6}})$', 1) as int), 99) <= 11 then 'web'
       when coalesce(try_cast(regexp_extract(source, '^src([0-9]{{1,6}})$', 1) as int), 99) <= 16 then 'books' else 'reference' end as domain,
  cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as n_tokens from documents),
base as (select * from docs where n_tokens > 0),
leaves as (select domain, lang, source, cast(sum(n_tokens) as hugeint) as supply,
  case domain when 'web' then 5 when 'books' then 3 else 2 end as w1,
  case lang when 'en' then 6 when 'de' then 2 when 'fr' then 2 when 'es' then 1 else 1 end as w2,
  case source when 'src0' then 2 else 1 end as w3 from base group by all),
n1 as (select domain, w1 as w, sum(supply * 3)::hugeint as cap, (select (sum(supply) * 900) // 1000 from leaves)::hugeint as budget from leaves group by all),
{_share_sql("s1", [], "domain", "n1")},
n2 as (select domain, lang, w2 as w, sum(supply * 3)::hugeint as cap, any_value(budget) as budget from leaves join s1 using (domain) group by all),
{_share_sql("s2", ["domain"], "lang", "n2")},
n3 as (select domain, lang, source, w3 as w, (supply * 3)::hugeint as cap, budget from leaves join s2 using (domain, lang)),
{_share_sql("s3", ["domain", "lang"], "source", "n3")},
alloc as (select domain, lang, source, budget // supply as whole, budget % supply as rest from leaves join s3 using (domain, lang, source)),
picked as (select base.*, e.epoch, whole, rest, sum(n_tokens) over (partition by domain, lang, source, e.epoch
  order by md5(concat_ws(':', '17', cast(e.epoch as varchar), cast(doc_id as varchar))), doc_id, n_tokens rows between unbounded preceding and current row) - n_tokens as bef
  from base join alloc using (domain, lang, source) join (select unnest(range(0, 4)) as epoch) e on e.epoch <= whole)
select doc_id, domain, lang, source, n_tokens, cast(epoch as bigint) as epoch,
  cast(case when epoch < whole then n_tokens else least(n_tokens, rest - bef) end as bigint) as take_tokens
from picked where epoch < whole or bef < rest
"""

_DEDUP_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
g as (select *, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AUDIT_SQL = f"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
tok as (select id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*) as total from tok group by all having count(distinct id) >= 10),
counts as (select lang, source, term, count(*) as n from tok join (select lang, term from kept) k using (lang, term) group by all),
grp as (select distinct lang, source from d),
sized as (select lang, source, coalesce(sum(n), 0) as size from grp left join counts using (lang, source) group by all),
langs as (select lang, count(term) as v, coalesce(sum(total), 0) as nl from (select distinct lang from grp) x left join kept using (lang) group by all),
shares as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (size + 2 * v) as p, 1 + (1000000000::hugeint * (total + 2)) // (nl + 2 * v) as q
  from sized join langs using (lang) join kept using (lang) left join counts using (lang, source, term)),
far as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0) as value from grp g join grp h on g.lang = h.lang and g.source <> h.source left join far f on f.lang = g.lang and f.source = g.source and f.item = h.source
  union all select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10
"""

# CRC-32, bit by bit
_CRC_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x // 2, 3988292384 * (x % 2)))))"
_TRIE_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
placed as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos, concat(length(role), ':', role, text) as k, length(text) as chars from c),
convs as (select conv_id, conv_id - conv_id % 100 as b, {_CRC_SQL.format("cast(conv_id as varchar)")} % 6 as h from (select distinct conv_id from c) x),
turns as (select v.conv_id, pos, k, chars from convs v join placed p on p.conv_id = v.b where pos < h union all select v.conv_id, pos, k, chars from convs v join placed p on p.conv_id = v.conv_id where pos >= h),
paths as (select v.conv_id, coalesce(list(sha256(k) order by pos) filter (where k is not null), []) as path, coalesce(list(chars order by pos) filter (where k is not null), []) as chars from convs v left join turns using (conv_id) group by v.conv_id),
starts as (select conv_id, d, path[1:d] as node, path[1:d - 1] as parent, case when d > 0 then chars[d] else 0 end as ch, len(path) = d as is_end from (select *, unnest(range(0, len(path) + 1)) as d from paths) x),
nodes as (select node, d as depth, any_value(parent) as parent, any_value(ch) as ch, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where is_end), '') as ends from starts group by node, d),
kids as (select parent as node, count(*) as n_children from nodes where depth > 0 group by parent),
full_ as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (node)),
above as (select node[1:d] as node, sum(leaf) as n_leaves, sum(save) as saved_tokens from (select node, (n_children = 0)::int as leaf, (n_convs - 1) * ch as save, unnest(range(0, depth + 1)) as d from full_) x group by 1)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(f.ends) as ends_sha256
from full_ f join above using (node) left join nodes p on f.depth > 0 and p.node = f.parent
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": _MIX_SQL,
    "op5_exact_dedup": _DEDUP_SQL,
    "op11_audit": _AUDIT_SQL,
    "op13_trie": _TRIE_SQL,
}
