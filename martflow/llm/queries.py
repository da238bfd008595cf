"""The queries of this folder's operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from martflow.llm import (
    conversations,
    licenses,
    mtree,
    ngram,
    packing,
    pieces,
    pstable,
    quality,
    repair,
    substring,
    toxicity,
    warc,
    whitening,
)
from martflow.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_VALID_SQL = """embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""

_TOP_SQL = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings where {_VALID_SQL}),
p as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score
      from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from p)
select query_id, n::int as rank, vec_id, score from r where n <= 20
"""


@query("op1_mtree_top_k", _TOP_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return mtree.top_k(table(spark, sf, "embeddings"), F.col("_id") % 20 == 0)


_JACCARD_SQL = """
with recursive t as (
  select text, min(doc_id) as first, count(*) as n, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws
  from documents where text is not null group by text),
c as (select text, first, n, ws from t where len(ws) > 0),
s as (select first, unnest(list_distinct(case when len(ws) < 5 then [array_to_string(ws, ' ')] else
        list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end)) as g from c),
z as (select first, count(*) as k from s group by first),
p as (select a.first as a, b.first as b, count(*) as common from s a join s b on a.g = b.g and a.first <> b.first group by all),
l as (select p.a, p.b, cb.n from p join z za on za.first = p.a join z zb on zb.first = p.b join c cb on cb.first = p.b
      where 5 * common >= 4 * (za.k + zb.k - common)),
r as (select first as a, first as b from c union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as component from r group by a),
d as (select doc_id, first, n from documents join c on documents.text = c.text),
k as (select a, sum(n)::bigint as k from l group by a)
select documents.doc_id, coalesce(d.first, documents.doc_id) as class_id,
       (coalesce(k.k, 0) + coalesce(d.n, 1) - 1)::bigint as n_links,
       coalesce(m.component, documents.doc_id) as component_id,
       coalesce(m.component, documents.doc_id) = documents.doc_id as kept
from documents left join d on d.doc_id = documents.doc_id left join k on k.a = d.first left join m on m.a = d.first
"""


@query("op2_ngram_jaccard_join", _JACCARD_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return ngram.links(table(spark, sf, "documents")).drop("_key")


_WINDOWS_SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from d),
r as (select doc_id, i, row_number() over (partition by array_to_string(ws[i:i+19], ' ') order by doc_id, i) as n from w),
g as (select doc_id, list(distinct k) as gone
      from (select doc_id, unnest(range(i, i + 20)) as k from r where n > 1) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, j: not list_contains(coalesce(gone, []::bigint[]), j)), ' ')) as kept_sha256
from d left join g on d.doc_id = g.doc_id
"""


@query("op3_cover_anchor_dedup", _WINDOWS_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    kept = substring.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query("op4_neighbour_quality")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rate(table(spark, sf, "documents"), table(spark, sf, "labels"))


_COSINE_SQL = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where {_VALID_SQL} and list_inner_product(embedding, embedding) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as component from r group by a),
k as (select a, count(*) as k from l group by a)
select vec_id, coalesce(k, 0)::bigint as n_links, coalesce(component, vec_id) as component_id,
       coalesce(component, vec_id) = vec_id as kept
from embeddings left join m on m.a = vec_id left join k on k.a = vec_id
"""


@query("op5_pstable_near_dedup", _COSINE_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return pstable.near(table(spark, sf, "embeddings")).drop("class_id")


@query("op6_nnls_packing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_shared_prefix_pieces")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(table(spark, sf, "documents"), path), path)
    return back.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


_PAGES_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
g as (select h, max(page_id) as top from p group by h),
r as (select p.page_id, p.html, p.h, case when g.top is null or p.page_id = g.top then null else g.top end as refers_to
      from p join g on p.h = g.h),
-- Eight characters for each five bytes of the digest, from forty bits each.
b as (select *, list_transform(generate_series(0, 3), lambda k: ('0x' || substr(h, 1 + 10 * k, 10))::bigint) as quads from r)
select page_id, strlen(html)::bigint as payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((quads[1 + i // 8] >> (35 - 5 * (i % 8))) & 31)::bigint, 1)), '') as payload_digest,
       case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from b
"""


@query("op8_warc_archive", _PAGES_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf, "pages"))
    back = warc.read_records(index, shared_dir(spark), text=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_dice_licenses")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query("op10_repair_shards")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    shards = repair.write_shards(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    back = repair.read_shards(shards, shared_dir(spark))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op11_noisy_channel_toxicity")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.rate(table(spark, sf, "documents"), table(spark, sf, "labels"))


# The checksum goes bit by bit over the place's bytes; then the cheapest letters to each role
# state are found row by row, a path being its cost, its letters and its text.
_REPAIR_SQL = """
with recursive o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place
  from conversations),
c as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, len(place) + 1),
      lambda i: [ord(place[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end)) % 20 as kind
  from o),
d as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from c),
n as (
  select *, row_number() over w as i, left(role, 1) as initial, lag(left(role, 1)) over w as former,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
         right(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'), 1) as last
  from d window w as (partition by conv_id order by turn nulls first, role, sha256(text), copy)),
f as (
  select *, case when last = '' then 'blank' when seen > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated'
            else 'sound' end as fault from n),
-- States: 0 nothing yet, 1 system, 2 user, 3 assistant.
ins as (
  select * from (values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'),
    (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 2, 2, 'I', chr(10) || 'user:'),
    (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'))
  as t(q, p, cost, letters, added)),
keep as (select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) as t(q, initial, p)),
turned as (select * from (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) as t(q, p, role)),
path as (
  select conv_id, 0::bigint as i, 0 as q, {'cost': 0, 'letters': '', 'text': ''} as best from (select distinct conv_id from conversations)
  union all
  select conv_id, i, q, min(best) from (
    select f.conv_id, f.i, edit.p as q, {'cost': path.best.cost + ins.cost + edit.cost,
      'letters': path.best.letters || ins.letters || edit.letter, 'text': path.best.text || ins.added || edit.added} as best
    from path join f on f.conv_id is not distinct from path.conv_id and f.i = path.i + 1 join ins on ins.q = path.q,
    lateral (
      select ins.p as p, 3 as cost, 'D' as letter, '' as added
      union all select keep.p, (f.fault = 'truncated')::int, 'K', chr(10) || f.role || ':' || f.text from keep
        where keep.q = ins.p and keep.initial = f.initial and f.fault in ('truncated', 'sound')
      union all select turned.p, 2 + (f.fault = 'truncated')::int, 'R', chr(10) || turned.role || ':' || f.text from turned
        where turned.q = ins.p and f.fault in ('truncated', 'sound')) as edit)
  group by conv_id, i, q),
t as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
         count(*) filter (fault = 'blank')::bigint as blank, count(*) filter (fault = 'duplicate')::bigint as duplicate,
         count(*) filter (fault = 'truncated')::bigint as truncated,
         count(*) filter (i > 1 and former || initial not in ('su', 'ua', 'au'))::bigint as illegal, max(i) as rows
  from f group by conv_id),
e as (
  select path.conv_id, min({'cost': path.best.cost + ins.cost, 'letters': path.best.letters || ins.letters, 'text': path.best.text || ins.added}) as best
  from path left join t on t.conv_id is not distinct from path.conv_id join ins on ins.q = path.q
  where path.i = coalesce(t.rows, 0) and ins.p in (0, 3) group by path.conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.cost::bigint as cost,
       best.letters as audit, sha256(substr(best.text, 2)) as repaired_sha256
from e left join t on t.conv_id is not distinct from e.conv_id
"""


@query("op12_integer_weight_repair", _REPAIR_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.summarise(conversations.damage(table(spark, sf, "conversations")), times="times")


@query("op13_bidiagonal_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
