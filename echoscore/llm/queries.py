"""One query per operator over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoscore.llm import alignment, ann, chat, collocations, digests, discriminant, lm, neardup, packing, pieces, pii, quality, secrets, toxicity
from echoscore.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def remainder(column: str, divisor: int):
    """crc32 of the id's decimal text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string")) % divisor


@query
def op1_packing(spark, d):
    return packing.packed(table(spark, d, "documents"))


# --- quality rules ----------------------------------------------------------------------------

QUALITY_COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_exclamations", "n_stop_words",
)


@query
def op4_quality_rules(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return quality.judged(docs).select(F.col("row.doc_id").alias("doc_id"), *QUALITY_COLUMNS[1:])


def _rule_sql(rule: quality.Rule) -> str:
    part, whole = (f"100 * {rule.part}", rule.whole) if rule.whole else (rule.part, "1")
    bounds = [f"{part} {op} {bound} * {whole}" for op, bound in (("<", rule.low), (">", rule.high)) if bound is not None]
    return " or ".join(bounds)


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    sql = r"""
with split as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
grams as (
  select r, i, count(*) over (partition by r, w) as n
  from (select r, unnest(range(1, len(ws) - 1)) as i,
      unnest(list_transform(list_zip(ws[:-3], ws[2:-2], ws[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) as w
    from split where len(ws) > 2)),
covered as (
  select r, count(distinct i + k) as n_repeat_words from grams, (values (0), (1), (2)) as o(k) where n > 1 group by r),
measured as (
  select doc_id, len(ws) as n_words, list_sum(list_transform(ws, lambda x: length(x))) as word_chars_,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, length(regexp_replace(t, '[^!]', '', 'g')) as n_exclamations,
    len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) in (STOP))) as n_stop_words
  from split left join covered using (r))
select doc_id, n_words::bigint as n_words, coalesce(word_chars_, 0)::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, (BASE) as base_failed, not (ANY) as kept,
  n_lines::bigint as n_lines, n_exclamations::bigint as n_exclamations, n_stop_words::bigint as n_stop_words
from (select *, coalesce(word_chars_, 0) as word_chars from measured)"""
    either = lambda rules: " or ".join(f"({_rule_sql(r)})" for r in rules)
    return sql.replace("STOP", stop).replace("BASE", either(quality.BASE)).replace("ANY", either(quality.RULES))


ORACLE["op4_quality_rules"] = _quality_sql()


# --- toxicity ---------------------------------------------------------------------------------


def toxicity_model(spark, d):
    """Learned from the labels of documents whose remainder is not 1."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return toxicity.fit(docs, labels.where(remainder("id", 3) != 1))


@query
def op10_toxicity(spark, d):
    scored = table(spark, d, "documents").select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        toxicity.score(spark, toxicity_model(spark, d)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


# --- quality classifier -----------------------------------------------------------------------


@query
def op11_quality_classifier(spark, d):
    """Learned from the labels of documents whose remainder is not 0."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    found = discriminant.scored(table(spark, d, "documents"), labels.where(remainder("id", 5) != 0))
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(remainder("id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= discriminant.THRESHOLD).cast("int").alias("predicted"),
    )


# --- near duplicates --------------------------------------------------------------------------


@query
def op8_near_duplicates(spark, d):
    return neardup.near_duplicates(table(spark, d, "documents")).drop("text_hash")


ORACLE["op8_near_duplicates"] = r"""
with recursive words as (
  select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
shingles as (
  select distinct r, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(list_zip(ws[:-5], ws[2:-4], ws[3:-3], ws[4:-2], ws[5:]), lambda x: concat_ws(' ', x[1], x[2], x[3], x[4], x[5])) end) as s
  from words),
sizes as (select r, count(*) as n from shingles group by r),
pairs as (
  select a.r as x, b.r as y, count(*) as common from shingles a join shingles b on a.s = b.s and a.r <> b.r group by a.r, b.r),
links as (
  select x, y from pairs join sizes i on i.r = x join sizes j on j.r = y where 100 * common >= 85 * (i.n + j.n - common)),
reach as (
  select r as x, r as y from words union select reach.x, links.y from reach join links on reach.y = links.x),
smallest as (select x as r, min(doc_id) as component_id from reach join words on words.r = reach.y group by x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from words left join sizes using (r) join smallest using (r)"""


# --- secrets ----------------------------------------------------------------------------------


def secrets_network(docs):
    return secrets.fit(docs.select(F.col("doc_id").alias("id"), "text"))


@query
def op3_secrets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secrets.findings(spark, secrets_network(docs)).alias("found"))
    spans, base = F.col("found"), digests.only(F.col("found"), secrets.KINDS[:3])
    return found.select(
        "doc_id", *[digests.count_of(spans, k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(digests.listed(base), 256).alias("base_sha256"), digests.listed(spans).alias("spans"),
    )


# --- personal data ----------------------------------------------------------------------------


@query
def op2_pii(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    weights = pii.fit(docs.select(F.col("doc_id").alias("id"), "text"))
    found = docs.select("doc_id", pii.findings(spark, weights).alias("found"))
    spans, base = F.col("found"), F.filter("found", lambda s: s["base"])
    return found.select(
        "doc_id", *[digests.count_of(base, k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(digests.listed(base), 256).alias("base_sha256"), digests.listed(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


# --- language model, subwords -----------------------------------------------------------------


@query
def op5_lm_scores(spark, d):
    docs, fold = table(spark, d, "documents"), remainder("doc_id", 7)
    return lm.scored(docs, fold != 2, fold == 2)


@query
def op9_pieces(spark, d):
    found = pieces.encoded(table(spark, d, "documents"))
    ids = F.concat_ws(",", F.transform("ids", lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_alignment(spark, d):
    found = alignment.digests(table(spark, d, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


# --- vectors ----------------------------------------------------------------------------------


@query
def op6_nearest(spark, d):
    rows = table(spark, d, "embeddings")
    return ann.nearest(rows, F.col("vec_id") % 100 == 0)


# --- chat -------------------------------------------------------------------------------------


@query
def op7_chat_formatting(spark, d):
    return chat.formatted(table(spark, d, "conversations"))


ORACLE["op7_chat_formatting"] = """
with turns as (select distinct conv_id, turn, role, text from conversations where conv_id is not null and turn is not null),
logged as (
  select conv_id, list((turn, role, text) order by turn, role nulls first, text nulls first) as ts,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), ''
      order by turn, role nulls first, text nulls first) as rendered
  from turns group by conv_id),
one as (select ts, min(conv_id) as conv_id, any_value(rendered) as rendered from logged group by ts)
select conv_id, len(ts)::bigint as n_turns, rendered from one a
where not exists (select 1 from one b where len(b.ts) > len(a.ts) and b.ts[1:len(a.ts)] = a.ts and b.ts[len(a.ts) + 1][1] <> a.ts[len(a.ts)][1])"""


# --- phrases ----------------------------------------------------------------------------------


@query
def op12_collocations(spark, d):
    return collocations.mined(table(spark, d, "documents"))


# Plain scans and group-bys over occurrences; hugeint arithmetic is exact up to 2^127.
ORACLE["op12_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
split as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
totals as (select lang, sum(len(ws))::bigint as n from split group by lang),
rows_ as (
  select lang, unnest(ws) as w1, unnest(ws[2:]) as w2, unnest(ws[3:]) as w3 from split where len(ws) > 0),
grams as (
  select lang, w1, null as w2, null as w3, count(*) as f from rows_ group by all having count(*) >= 10
  union all select lang, w1, w2, null, count(*) from rows_ where w2 is not null group by all having count(*) >= 10
  union all select lang, w1, w2, w3, count(*) from rows_ where w3 is not null group by all having count(*) >= 10),
words as (select lang, w1 as w, f from grams where w2 is null),
pairs as (select lang, w1 as u, w2 as v, f from grams where w2 is not null and w3 is null),
threes as (select * from grams where w3 is not null),
around as (
  select lang, u, v, max(f) as longest from (select lang, w1 as u, w2 as v, f from threes union all select lang, w2, w3, f from threes) group by all),
cuts as (
  select p.lang, p.u || ' ' || p.v as phrase, p.f as a, 1 as k, x.f as l, y.f as r
  from pairs p join words x on x.lang = p.lang and x.w = p.u join words y on y.lang = p.lang and y.w = p.v
  left join around z on z.lang = p.lang and z.u = p.u and z.v = p.v where z.longest is null or 100 * z.longest < 50 * p.f
  union all select t.lang, w1 || ' ' || w2 || ' ' || w3, t.f, 1, x.f, y.f
  from threes t join words x on x.lang = t.lang and x.w = t.w1 join pairs y on y.lang = t.lang and y.u = t.w2 and y.v = t.w3
  union all select t.lang, w1 || ' ' || w2 || ' ' || w3, t.f, 2, x.f, y.f
  from threes t join pairs x on x.lang = t.lang and x.u = t.w1 and x.v = t.w2 join words y on y.lang = t.lang and y.w = t.w3),
weakest as (
  select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts
  qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from weakest) join totals using (lang)
where rank <= 2000"""
