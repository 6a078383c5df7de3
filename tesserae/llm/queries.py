"""The queries of this folder's operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digests, format_chats, with_planted
from .class_lm import score_texts
from .common import table
from .exact_topk import exact_top_k
from .language_id import identify
from .licences import scan_licences
from .mixing import mixed_epochs
from .near_dedup import near_duplicates
from .oracles import ORACLES as LONG
from .packing import pack
from .permutation_index import nearest
from .url_filter import judge, path_of


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return exact_top_k(e, e.where(F.col("vec_id") % 50 == 0), 5)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path ends in the number of its document (``/en/5.html``); labels of documents are labels of pages."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    last = F.regexp_extract(path_of(F.col("url")), r"^.*/([0-9]{1,18})(?:[/.].*)?$", 1)
    number = pages.select("page_id", F.try_to_number(F.nullif(last, F.lit("")), F.lit("9" * 18)).cast("long").alias("doc_id")).where("doc_id is not null")
    return judge(pages, number.join(bad, "doc_id").select("page_id", "bad"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(format_chats(with_planted(table(spark, sf_dir, "conversations"))))


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.where(F.col("vec_id") % 20 == 0), 20)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed_epochs(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), repetition=1.25)
    return out.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_position").alias("position"), F.col("_tokens").alias("n_tokens"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``matches`` as text: licence, Dice coefficient in ten-thousandths, first word and words of each."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    match = lambda m: F.concat_ws(" ", m["licence"], F.floor(m["dice"] * 10000), m["first_word"], m["n_words"])
    return found.withColumn("matches", F.concat_ws(", ", F.transform("matches", match)))


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_SQL = f"""
with recursive d as (select doc_id, {WORDS} as w from documents),
s as (select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) = 1 then [w[1]]
      else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from d),
e as (select doc_id, unnest(s) as g from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b using (g) where a.doc_id <> b.doc_id group by 1, 2),
l as (select c.a, c.b from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b where 100 * c.n >= 80 * (len(x.s) + len(y.s) - c.n)),
r as (select doc_id as x, doc_id as y from s union select r.x, l.b from r join l on r.y = l.a),
m as (select x, min(y) as y from r group by x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.y as component_id, s.doc_id = m.y as kept from s join m on m.x = s.doc_id
"""

OP5_SQL = """
with v as (select vec_id, list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

OP7_SQL = r"""
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (select *, regexp_replace(text, '(\\|<turn>|</turn>|### )', '\\\1', 'g') as body,
  case role when 'system' then 'System' when 'user' then 'User' when 'assistant' then 'Assistant' end as name from c)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<turn>### ' || name || ': ' || body || '</turn>' || chr(10))) as bigint) as formatted_chars,
  (min(case when role = 'system' then turn else 0 end) = 0 and count(*) filter (where role = 'system' and turn <> 0) = 0
   and bool_and(role = 'system' or role = case when (turn - (select count(*) from f s where s.conv_id = f.conv_id and s.role = 'system')) % 2 = 0 then 'user' else 'assistant' end)
   and max_by(role, turn) = 'assistant') as valid
from f group by conv_id
"""
QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_near_dedup, op3_language_id, op4_class_lm, op5_exact_topk, op6_url_filter, op7_chat_format, op8_permutation_index, op9_source_mix, op10_licence_scan)}
ORACLES = {"op2_near_dedup": OP2_SQL, "op5_exact_topk": OP5_SQL, "op7_chat_format": OP7_SQL} | LONG
