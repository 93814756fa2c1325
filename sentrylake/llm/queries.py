"""The queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    dealt = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, train(docs)).drop("all")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, sample, training_rows

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), sample(training_rows(docs)))
    return found.select("doc_id", (crc_of_id(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_turns, read_back, to_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    records = rows.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return digests(read_back(format_turns(to_turns(records))))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where("doc_id % 50 = 0"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_pii": op2_pii,
    "op3_pieces": op3_pieces,
    "op4_simhash": op4_simhash,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_lm": op7_lm,
    "op8_sharding": op8_sharding,
    "op9_chat": op9_chat,
    "op10_search": op10_search,
    "op11_negatives": op11_negatives,
    "op12_repeats": op12_repeats,
    "op13_divergence": op13_divergence,
}
ORACLE_SQL: dict[str, str] = {
    "op6_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('6:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 12))::bigint::double as u,
    case when length(text) > 0 then greatest(0.05, 1 - len(regexp_extract_all(text, '[0-9|%*&#@+=<>{}\[\]\\^~_$/]')) / length(text)) else 0.05 end as rate
  from documents),
k as (select *, -ln((u + 0.5) / 281474976710656.0) / rate as k from d),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as nth from k group by source),
w as (select *, ((nth - 1) % 3 + 1)::double as w, source_size * 3.0 as most from s),
x as (
  select *, (sum(source_size) over () - coalesce(sum(most) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as x
  from w window o as (order by most / w, w, source is null, source rows between unbounded preceding and 1 preceding)),
y as (select *, (select arg_min(x, (most / w, nth)) from x where x * w <= most) as level from x),
t as (select source, source_size, round(coalesce(least(most, level * w), most), 6) as target from y),
g as (select *, case when source_size > 0 then floor(target / source_size) else 1 end as whole from t),
p as (
  select k.doc_id, k.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size as rest,
    sum(k.size) over (partition by k.source order by k.k, coalesce(k.doc_id, -1), k.size rows unbounded preceding) as upto
  from k join g on k.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (whole + case when rest > 0 and upto - size < rest and upto - size / 2 <= rest then 1 else 0 end))::bigint as taken from p""",
    "op9_chat": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(17 + length(regexp_replace(role, '([\\>])', '\\\1', 'g')) + length(regexp_replace(text, '(\\|</?turn)', '\\\1', 'g')))::bigint as formatted_chars
from c group by conv_id""",
    "op11_negatives": r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor, r.vec_id as id, a.label = r.label as same, list_sum(list_transform(list_zip(a.v, r.v), lambda x: x[1] * x[2]))::bigint as score
  from v a join v r on a.vec_id % 100 = 0 and (a.label <> r.label or a.vec_id <> r.vec_id) and len(a.v) = len(r.v)),
p as (select anchor, id, score from s where same qualify row_number() over (partition by anchor order by score desc, id) <= 5),
n as (
  select p.anchor, p.id as positive, p.score as positive_score, s.id as negative, s.score as negative_score, row_number() over (partition by p.anchor, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor = p.anchor and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor as anchor_id, positive as positive_id, rank::int as rank, negative as negative_id, positive_score, negative_score from n where rank <= 10""",
    "op12_repeats": r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select rid, doc_id, w, unnest(range(1, len(w) + 1)) as pos from d),
x as (select rid, pos, w[pos] as word, case when pos + 34 <= len(w) then md5(array_to_string(w[pos : pos + 34], ' ')) end as h from p),
r as (select h from x where h is not null group by h having count(*) > 1),
y as (select x.rid, x.pos, x.word, r.h is not null as again from x left join r using (h)),
z as (select rid, pos, word, coalesce(bool_or(again) over (partition by rid order by pos rows between 34 preceding and current row), false) as gone from y),
k as (select rid, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by pos) filter (not gone) as kept from z group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join k using (rid)""",
    "op13_divergence": r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from t group by all having count(distinct i) >= 3),
c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by all),
g as (select lang, source, coalesce(v, 0) as v, coalesce((select sum(n) from c where c.lang = x.lang and c.source = x.source), 0)::bigint as size from (select distinct lang, source from d) x left join v using (lang)),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.size + g.v) as p
  from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, 1 + 1000000000::hugeint * (sum(n) + 1)::hugeint // (sum(sum(n)) over (partition by lang) + count(*) over (partition by lang))::hugeint as q from c group by lang, term),
f as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
o as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::bigint from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from o)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200""",
}
