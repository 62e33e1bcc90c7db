"""The catalogue queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

from echoscore import constants as K

ORACLE: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- expressions ----------------------------------------------------------------------------

SPACES = r"E' \t\n\r\f'"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def collapse(x: str) -> str:
    return rf"regexp_replace({x}, '\s\s+', ' ', 'g')"


def norm(x: str) -> str:
    return strip(rf"regexp_replace({collapse(f'lower({x})')}, '\p{{P}}', '', 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split({strip(collapse(x))}, ' '), lambda w: w <> '')"


def no_end_mark(x: str) -> str:
    return strip(f"replace({x}, '[EOT]', '')")


def two_digits(x: str) -> str:
    """%.2f with ties away from zero, decided on the shortest decimal form."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(30,20)), 2) as decimal(18,2))"


def mean_percent(x: str) -> str:
    """Mean in percent, two decimals, ties up; in integers, as the metrics here have three decimals."""
    return f"((20 * sum(round({x} * 1000)::bigint) + count(*)) // (2 * count(*)))::double / 100"


# --- views ----------------------------------------------------------------------------------

SAMPLES = """samples as (
  select doc_id as id, text as transcription, '/corpus/' || lang || '/audio/' || grp || '/' || doc_id || '.wav' as file_path,
         lang, grp as "group", coalesce(quality = 1, false) as medical_yn, coalesce(toxic = 1, false) as toxic
  from (select *, case when n_chars < 1000 then 'dev' when n_chars < 2500 then 'test' else 'train' end as grp from documents)
  left join labels using (doc_id))"""

CHUNKED = SAMPLES + """, chunked as (
  select *, idx // 50 as chunk_idx, cast(idx % 50 as integer) as pos
  from (select *, row_number() over (order by lang, "group", id) - 1 as idx from samples))"""

CHUNK_LABELS = CHUNKED + """, chunk_labels as (
  select chunk_idx, list(quality = 1 order by pos) as labels
  from chunked join labels on labels.doc_id = chunked.id group by chunk_idx)"""

# first n usable labelled samples per language, indexed among all labelled samples
def first_labelled(n: int, valid: str) -> str:
    return SAMPLES + f""", labelled as (
  select *, row_number() over (order by lang, "group", id) - 1 as idx from samples where medical_yn), chosen as (
  select * from (select *, row_number() over (partition by lang order by "group", id) - 1 as rank from labelled where {valid})
  where rank < {n})"""


PICK = """noise as (
  select 'noise' || vec_id as noise_id, embedding as samples,
         row_number() over (order by md5('noise' || vec_id), 'noise' || vec_id) - 1 as pick from embeddings
  where vec_id % 10 not in (3, 5, 7))"""


def draw(x: str) -> str:
    return f"(('0x' || substr(md5('0:' || {x}), 1, 8))::bigint % (select count(*) from noise))"


NOISE_PLAN = first_labelled(100, "not toxic") + f""", {PICK}, noisy as (
  select id, lang, "group", rank, idx, group_name, noise_id,
         '/audio/noisy/' || lang || '-' || group_name || '-' || idx || '-' || id || '-' || noise_id || '.wav' as noisy_output_path,
         transcription
  from (select *, case when rank < 50 then 'train' else 'test' end as group_name from chosen)
  join noise on noise.pick = {draw("lang || ':' || \"group\" || ':' || id")})"""

_SILENCE_PLAN = """silence as (
  select id, lang, "group", rank, idx, silence_position,
         '/audio/silence/' || lang || '-' || silence_position || '-' || idx || '-' || id || '-silence.wav' as silence_output_path
  from (select *, case when rank < 10 then 'front' when rank < 20 then 'middle' else 'back' end as silence_position from chosen_silent))"""
SILENCE_PLAN = first_labelled(30, "true").replace("chosen as", "chosen_silent as") + ", " + _SILENCE_PLAN
BOTH_PLANS = NOISE_PLAN + """, chosen_silent as (
  select * from (select *, row_number() over (partition by lang order by "group", id) - 1 as rank from labelled) where rank < 30), """ + _SILENCE_PLAN

GRID = """grid as (
  select 'test' as "group", 'normal' as kind, '' as sfx, * from langs, models, (values
    ('default', 'none', null, null, null, null),
    ('temperature', '{"audio_timestamp":true,"temperature":0.2}', true, 0.2, null, null),
    ('audio_ts_true', '{"audio_timestamp":true,"topK":1,"topP":0.1}', true, null, 1, 0.1)) c(config_name, params, audio_timestamp, temperature, "topK", "topP")
  union all
  select 'silence', 'silence', '_silence', * from langs, models, (values
    ('default', 'none', null, null, null, null),
    ('temperature', '{"audio_timestamp":true,"topK":1,"topP":0.1}', true, null, 1, 0.1),
    ('audio_ts_true', '{"audio_timestamp":true,"temperature":0.2}', true, 0.2, null, null)) c(config_name, params, audio_timestamp, temperature, "topK", "topP")),
jobs as (
  select *, "group" || '_' || lang as splitter, "group" || '_' || lang || '_' || model || '-' || config_name || '_' || slug as job_id
  from grid)"""
LANGS = """langs as (select distinct lang, 'prompt_v3_' || lang || '.txt' as prompt_version, 'prompt_v3_' || lang as slug from documents),
models(model) as (values ('model-a'), ('model-b'), ('model-c'))"""

TURNS = """turns as (
  select conv_id * 100 + turn as id, text as transcription, lang, grp as "group",
         'gs://bucket/batch_audio/' || grp || '_' || lang || '/' || (conv_id * 100 + turn) || '.wav' as gcs_uri
  from (select *, case when regexp_matches(text, '[êèç]') then 'fr' when regexp_matches(text, '[äöüß]') then 'de'
                       when regexp_matches(text, '[ñíáóú]') then 'es' else 'en' end as lang,
               case role when 'assistant' then 'train' when 'user' then 'test' else 'silence' end as grp
        from conversations))"""

TRANSCRIPTS = TURNS + """, transcripts as (
  select *, "group" || '_' || lang || '_' || model || '-' || config || '_' || replace(prompt_version, '.txt', '') as job_id from (
    select id, transcription, lang, "group", gcs_uri, model, config, prompt_version,
           case "group" when 'silence' then '' when 'test' then heard || ' [EOT]' else heard end as prediction
    from (
      select *, 'model-a' as model, 'default' as config, 'prompt_v2.txt' as prompt_version,
             replace(replace(transcription, 'th', 't'), '. ', ' uh ') as heard from turns
      union all
      select *, 'model-a', 'temperature', 'prompt_v2.txt', regexp_replace(transcription, ' (the|la|die|el|of|le) ', ' ', 'g') from turns
      union all
      select *, 'model-b', 'default', 'prompt_v3_' || lang || '.txt', replace(transcription, 'e', 'a') from turns)))"""


def scored(hypothesis: str) -> str:
    """transcripts -> scored with edit counts.

    Words: the distance table row by row, each row a window over the hypothesis words (a running
    minimum carries insertions). Characters: DuckDB's byte-wise levenshtein over one ASCII byte per
    distinct character of the pair.
    """
    return f"""{TRANSCRIPTS}, texts as materialized (
  select *, row_number() over () as k, {norm('transcription')} as r, {norm(hypothesis)} as h from transcripts),
tok as materialized (select k, {words('r')} as rw, {words('h')} as hw from texts where r <> ''),
ref_words as materialized (select k, unnest(rw) as w, generate_subscripts(rw, 1) as i from tok),
dist as (
  select k, 0 as i, (generate_subscripts(list_prepend('', hw), 1) - 1)::int as j,
         (generate_subscripts(list_prepend('', hw), 1) - 1)::int as e, unnest(list_prepend('', hw)) as w from tok
  union all
  select k, i, j, (j + min(v - j) over (partition by k order by j))::int, w from (
    select dist.k, ref_words.i::int as i, j, dist.w,
           least(e + 1, coalesce(lag(e) over (partition by dist.k order by j), 1000000)
                        + case when dist.w = ref_words.w then 0 else 1 end)::int as v
    from dist join ref_words on dist.k = ref_words.k and ref_words.i = dist.i + 1)),
word_counts as (
  select tok.k, e as word_edits, len(rw) as ref_words from dist join tok on dist.k = tok.k
  where dist.i = len(rw) and dist.j = len(hw)),
chars as (
  select k, r, h, list_distinct(string_split(r || h, '')) as v from texts where r <> ''),
char_counts as (
  select k, length(r) as ref_chars, levenshtein(
    array_to_string(list_transform(string_split(r, ''), lambda c: chr(32 + list_position(v, c)::int)), ''),
    array_to_string(list_transform(list_filter(string_split(h, ''), lambda c: c <> ''), lambda c: chr(32 + list_position(v, c)::int)), '')
  ) as char_edits from chars),
scored as (
  select texts.*, word_edits, ref_words, char_edits, ref_chars,
         coalesce(word_edits::double / ref_words, 0.0) as wer, coalesce(char_edits::double / ref_chars, 0.0) as cer
  from texts left join word_counts using (k) left join char_counts using (k))"""


ROW_SCORED = "with recursive " + scored(no_end_mark("prediction"))
CORPUS_SCORED = "with recursive " + scored("prediction")
SETTING = 'lang, "group", model, config, prompt_version'
RATES = """count(*) as n_scored, sum(word_edits)::bigint as word_edits, sum(ref_words)::bigint as ref_words,
  sum(char_edits)::bigint as char_edits, sum(ref_chars)::bigint as ref_chars,
  round(sum(word_edits)::double / sum(ref_words)::double, 6) as wer, round(sum(char_edits)::double / sum(ref_chars)::double, 6) as cer"""

# runs are chosen by corpus rates (marks kept), rows are shown with row rates (marks removed)
CORPUS_CER = f""", kept as materialized (
  select k, {norm('prediction')} as h2 from texts),
summary as (
  select {SETTING}, sum(char_edits2)::double / sum(ref_chars) as cer from (
    select scored.*, levenshtein(
      array_to_string(list_transform(string_split(r, ''), lambda c: chr(32 + list_position(v2, c)::int)), ''),
      array_to_string(list_transform(list_filter(string_split(h2, ''), lambda c: c <> ''), lambda c: chr(32 + list_position(v2, c)::int)), '')
    ) as char_edits2 from (select scored.*, h2, list_distinct(string_split(r || h2, '')) as v2 from scored join kept using (k) where r <> '') scored)
  group by {SETTING})"""

RUNS = """raw_runs as (
  select *, '/results/evaluation_' || "group" || '_' || lang || '_' || model || '-' || config || '_'
            || coalesce(replace(prompt_version, '.txt', ''), 'default') || '.csv' as local_inference_csv_path
  from (
    select o_orderkey as run_seq, lower(n_name) as lang,
      case o_orderstatus when 'F' then 'test' when 'O' then 'train' else 'silence' end as "group",
      o_orderpriority as model, c_mktsegment as config,
      case when c_acctbal >= 0 then 'prompt_v' || (year(o_orderdate) - 1990)
           || case when month(o_orderdate) <= 6 then '' else '_' || lower(n_name) end || '.txt' end as prompt_version,
      case when c_acctbal >= 0 then floor(c_acctbal / 10) / 1000 end as wer0, floor(o_totalprice / 1000) / 1000 as cer
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)),
runs as (select * exclude (wer0), wer0 as wer from raw_runs), report_runs as (select * exclude (wer0), coalesce(wer0, 0.0) as wer from raw_runs)"""
RUN_OUT = 'run_seq, lang, "group", model, config, prompt_version, wer, cer'


def first_of(source: str, keys: str, order: str, columns: str = RUN_OUT, where: str = "true") -> str:
    return (
        f"select {columns} from (select *, row_number() over (partition by {keys} order by {order}) as rn "
        f"from {source} where {where}) where rn = 1"
    )


def report_order(*names: str) -> str:
    return ", ".join(f"coalesce({n}, '')" for n in names) + ", run_seq"


BEST_PER_LANG = first_of("runs", "lang", "cer nulls last, wer nulls last, run_seq", where="\"group\" = 'test'")

# --- text and metrics -----------------------------------------------------------------------

ORACLE["normalize_text"] = f"select doc_id, {norm('text')} as normalized from documents"

ORACLE["row_wer_cer"] = ROW_SCORED + " select id, model, config, round(wer, 6) as wer, round(cer, 6) as cer from scored"

ORACLE["corpus_wer_cer"] = CORPUS_SCORED + f" select {SETTING}, {RATES} from scored where ref_chars is not null group by {SETTING}"

ORACLE["eval_counts"] = f"""with {TRANSCRIPTS}
select {SETTING}, count(*) as n_rows, count_if(prediction <> '')::bigint as n_predicted,
       count_if({norm('transcription')} <> '')::bigint as n_scoreable from transcripts group by {SETTING}"""

ORACLE["evaluation_summary"] = CORPUS_SCORED + f"""
select {SETTING}, '/results/evaluation_' || "group" || '_' || lang || '_' || model || '-' || config || '_' || replace(prompt_version, '.txt', '') || '.csv' as local_inference_csv_path,
  count(*) as n_scored, round(sum(word_edits)::double / sum(ref_words)::double, 6) as wer, round(sum(char_edits)::double / sum(ref_chars)::double, 6) as cer
from scored where ref_chars is not null and lang <> 'es' group by {SETTING}"""

ORACLE["run_table"] = CORPUS_SCORED + f""", summary_ as (
  select {SETTING}, case when lang in ('es', 'fr') then 1 else 2 end as round, count(*) as n_scored,
    sum(word_edits)::double / sum(ref_words)::double as w, sum(char_edits)::double / sum(ref_chars)::double as c
  from scored where ref_chars is not null group by {SETTING}),
ranked as (
  select *, "group" = 'test' and row_number() over (partition by lang, "group" order by c, w, "group" || '_' || lang || '_' || model || '-' || config || '_' || replace(prompt_version, '.txt', '')) = 1 as best
  from summary_)
select {SETTING}, round, n_scored, round(w, 6) as wer, round(c, 6) as cer, best, true as logged from ranked"""

# --- samples --------------------------------------------------------------------------------

ORACLE["ingest_union"] = """with raw as (
  select doc_id as id, text as transcription, doc_id as seq, lang,
         case when n_chars < 1000 then 'dev' when n_chars < 2500 then 'test' else 'train' end as "group" from documents
  union all select item_id, text, item_id + 1000000000000, 'en', 'dev' from benchmark)
select id, transcription, '/corpus/' || lang || '/audio/' || "group" || '/' || id || '.wav' as file_path, lang, "group"
from (select *, row_number() over (partition by lang, "group", id order by seq) as rn from raw) where rn = 1"""

ORACLE["dedup_first"] = """select doc_id, lang, source, text_md5 from (
  select doc_id, lang, source, md5(text) as text_md5, row_number() over (partition by lang, md5(text) order by doc_id) as rn from documents)
where rn = 1"""

ORACLE["label_filter"] = f'with {SAMPLES} select id, lang, "group", file_path from samples where medical_yn'

ORACLE["dataset_shape"] = f'with {SAMPLES} select lang, "group", count(*) as n from samples group by lang, "group"'

ORACLE["first_n_per_lang"] = f"""with {SAMPLES}
select id, lang, "group", transcription, rank from (
  select *, row_number() over (partition by lang order by "group", id) as rank from samples where not toxic) where rank <= 100"""

ORACLE["noise_plan"] = f"with {NOISE_PLAN} select * from noisy"

ORACLE["silence_plan"] = f"with {SILENCE_PLAN} select * from silence"

ORACLE["audio_path_fallback"] = f"""with {SAMPLES}
select id, case when medical_yn then '/noisy/' || lang || '/' || id when toxic then '/silence/' || id
                when "group" <> 'dev' then file_path end as audio_path from samples"""

ORACLE["quality_checks"] = f"with {SAMPLES} select lang, count(*) as n from samples where medical_yn group by lang having count(*) < 100"

ORACLE["sync_plan"] = f"""with {SAMPLES}, p as (
  select id, medical_yn, case when "group" <> 'dev' then '/audio/noisy/' || lang || '-' || id || '.wav' end as noisy_output_path,
         'gs://bucket/batch_audio/' || "group" || '_' || lang || '/' || lang || '-' || id || '.wav' as uri,
         exists (select 1 from pages where page_id = id) as on_disk from samples), s as (
  select *, case when noisy_output_path is null then 'no_path' when medical_yn then 'reuse' when on_disk then 'upload' else 'missing' end as status from p)
select id, noisy_output_path, status, case when status in ('reuse', 'upload') then uri end as gcs_uri from s"""

# --- chunked labelling ----------------------------------------------------------------------

_PROMPTS = f"""with {CHUNKED}, prompts as (
  select chunk_idx, count(*) as n,
         {quoted(K.CLASSIFY_PROMPT)} || string_agg('[' || pos || '] ' || transcription || chr(10), '' order by pos) as prompt
  from chunked group by chunk_idx)"""
ORACLE["chunk_prompts"] = _PROMPTS + " select * from prompts"
ORACLE["classify_requests"] = _PROMPTS + """
select chunk_idx, 'req-' || chunk_idx as key, 'user' as role, prompt, 'application/json' as mime from prompts"""

ORACLE["strip_fence"] = f"select conv_id, turn, {strip('text')} as answer from conversations"

ORACLE["parse_chunk_labels"] = f"""with {CHUNK_LABELS}
select chunk_idx, len(labels) as n_labels, array_to_string(list_transform(labels, lambda x: x::varchar), ',') as labels from chunk_labels"""

ORACLE["chunk_label_apply"] = f"""with {CHUNK_LABELS}
select id, lang, "group", idx, chunk_idx, pos, coalesce(labels[pos + 1], false) as medical_yn
from chunked left join chunk_labels using (chunk_idx)"""

ORACLE["chunk_shortfalls"] = f"""with {CHUNK_LABELS}
select chunk_idx, count(*) as n, coalesce(max(len(labels)), 0) as n_labels
from chunked left join chunk_labels using (chunk_idx) group by chunk_idx having count(*) <> coalesce(max(len(labels)), 0)"""

# --- jobs, requests, responses --------------------------------------------------------------

ORACLE["job_grid"] = f"""with {LANGS}, {GRID}
select job_id, kind, lang, "group", splitter, model, config_name, prompt_version, slug, job_id || sfx || '_requests.jsonl' as request_file,
  'gs://bucket/batch_input' || sfx || '/' || splitter || '/' || job_id || sfx || '_requests.jsonl' as gcs_input_uri,
  'gs://bucket/batch_output' || sfx || '/' || job_id as gcs_output_base_uri,
  '/results/evaluation_' || job_id || sfx || '.csv' as local_output_csv, params from jobs"""

_FANOUT = f"""with {BOTH_PLANS}, {LANGS}, {GRID}, fanned as (
  select jobs.*, n.id, n.idx, 'gs://bucket/batch_audio/' || n."group" || '_' || n.lang || '/' || string_split(noisy_output_path, '/')[-1] as uri
  from jobs join noisy n on jobs.kind = 'normal' and jobs.lang = n.lang and jobs."group" = n.group_name
  union all
  select jobs.*, s.id, s.idx, 'gs://bucket/batch_audio_silence/' || s."group" || '_' || s.lang || '/' || string_split(silence_output_path, '/')[-1]
  from jobs join silence s on jobs.kind = 'silence' and jobs.lang = s.lang)"""
ORACLE["job_sample_fanout"] = _FANOUT + " select job_id, kind, id, idx from fanned"
ORACLE["request_json"] = _FANOUT + """, n as (select lang, count(distinct source) as n from documents group by lang)
select job_id, 'req-' || idx || '-' || slug as key, 'user' as role, 'audio/wav' as mime, uri,
  'Language ' || fanned.lang || ', {' || n.n || '} sources.' as prompt, config_name <> 'default' as has_config,
  audio_timestamp, temperature::double as temperature, "topK", "topP"::double as "topP"
from fanned join n on n.lang = fanned.lang where id in (select page_id from pages)"""

ORACLE["config_conflicts"] = """select config_name, count(distinct params) as n_param_sets from (
  select l_returnflag || '-' || l_linenumber || '-' || floor(l_quantity)::bigint as config_name,
         '{"temperature": ' || round(l_discount * 100)::int || '}' as params from lineitem)
group by config_name having count(distinct params) > 1"""

ORACLE["parse_responses"] = f"with {TRANSCRIPTS} select job_id, gcs_uri, prediction from transcripts where \"group\" <> 'silence'"

ORACLE["malformed_responses"] = f"""with {TRANSCRIPTS}
select id, job_id, '{{"key": "req-' || id as raw from transcripts where "group" = 'silence'"""

ORACLE["join_predictions"] = f"with {TRANSCRIPTS} select id, job_id, gcs_uri, transcription, prediction from transcripts"

ORACLE["run_progress"] = f"""with {TRANSCRIPTS}
select job_id, count(distinct gcs_uri) as n_expected, count(distinct case when "group" <> 'silence' then gcs_uri end) as n_received,
       count(distinct case when "group" <> 'silence' then gcs_uri end) >= count(distinct gcs_uri) as complete from transcripts group by job_id"""

ORACLE["stream_scores"] = CORPUS_SCORED + """
select job_id, count(*) as n_scored, round(sum(word_edits)::double / sum(ref_words)::double, 6) as wer,
  round(sum(char_edits)::double / sum(ref_chars)::double, 6) as cer, count(distinct gcs_uri) as n_expected, count(distinct gcs_uri) as n_received,
  true as complete
from scored where ref_chars is not null and "group" <> 'silence' group by job_id"""

ORACLE["run_completions"] = CORPUS_SCORED + """
select job_id, count(distinct gcs_uri) as n_expected, count(distinct gcs_uri) as n_answered, count(*) as n_scored,
  round(sum(word_edits)::double / sum(ref_words)::double, 6) as wer, round(sum(char_edits)::double / sum(ref_chars)::double, 6) as cer
from scored where ref_chars is not null and "group" <> 'silence' group by job_id"""

_LOG = f"""with {RUNS}, log as (
  select run_seq, lang, "group", prompt_version, case when prompt_version is null
    then '/results/run_' || run_seq || case when "group" = 'silence' then '_prompt_v1_silence' else '' end || '.csv'
    else '/results/run_' || run_seq || '_' || replace(prompt_version, '.txt', '') || '.csv' end as result_path from runs)"""
ORACLE["normalize_output_path"] = _LOG + " select run_seq, result_path from log"
ORACLE["incremental_runs"] = _LOG + """
select run_seq, lang, "group", result_path as local_inference_csv_path from log
where prompt_version is not null and run_seq not in (select l_orderkey from lineitem where l_returnflag = 'R')"""

ORACLE["summary_files"] = f"with {RUNS} select run_seq, {SETTING}, wer, cer from runs"

# --- run selection --------------------------------------------------------------------------

ORACLE["dedup_last"] = f"with {RUNS} " + first_of(
    "runs", SETTING, "run_seq desc", RUN_OUT + ", coalesce(replace(prompt_version, '.txt', ''), 'default') as version_label",
    "\"group\" = 'train'",
)
ORACLE["best_run_per_lang"] = f"with {RUNS} {BEST_PER_LANG}"
ORACLE["best_run_per_group_lang"] = f"with {RUNS} " + first_of(
    "report_runs", '"group", lang', "cer, " + report_order("model", "config", "prompt_version")
)
ORACLE["best_report_lang"] = f"with {RUNS} " + first_of(
    "report_runs", "lang", "cer, " + report_order('"group"', "model", "config", "prompt_version"),
    where="\"group\" in ('test', 'silence')",
)


def _last(keys: str, view: str) -> str:
    order = ", ".join(f"coalesce({c}, '') desc" for c in ("lang", '"group"', "model", "config", "prompt_version"))
    return first_of("report_runs", keys, f"cer, {order}, run_seq desc", f"{view} as view, {RUN_OUT}")


ORACLE["best_view_setting"] = f"with {RUNS} " + _last("1", "'all'") + " union all " + _last('lang, "group"', "lang || '/' || \"group\"")

ORACLE["next_version"] = rf"""with {RUNS}, best as ({BEST_PER_LANG})
select (coalesce(max(coalesce(try_cast(regexp_extract(prompt_version, 'v(\d+)', 1) as int), 0)), 0) + 1)::int as next_version from best"""

ORACLE["best_to_train_run"] = f"""with {RUNS}, best as ({first_of('runs', SETTING, 'run_seq desc', '*', "\"group\" = 'test'")}),
train as ({first_of('runs', 'lang, model, config, prompt_version', 'run_seq desc', '*', "\"group\" = 'train'")})
select b.lang, b.model, b.config, b.prompt_version, b.run_seq as best_run_seq, b.cer as best_cer, b.wer as best_wer,
       t.run_seq as train_run_seq, t.local_inference_csv_path
from best b join train t on b.lang = t.lang and b.model = t.model and b.config = t.config and b.prompt_version is not distinct from t.prompt_version"""

# --- error analysis -------------------------------------------------------------------------


def _worst(n: int) -> str:
    return ROW_SCORED + f""", worst as (
  select * from (select *, row_number() over (partition by {SETTING} order by cer desc, wer desc, id) as case_no from scored)
  where case_no <= {n})"""


def _cases(n: int, audio: str = "") -> str:
    return _worst(n) + f""", cases as (
  select {SETTING}, string_agg('## Case ' || case_no || chr(10) || 'Ground Truth: ' || transcription || chr(10)
    || 'Prediction:   ' || {no_end_mark('prediction')} || chr(10)
    || 'WER: ' || {two_digits('wer')} || ', CER: ' || {two_digits('cer')} || chr(10){audio} || chr(10), '' order by case_no) as error_cases_text
  from worst group by {SETTING})"""


ORACLE["worst_cases"] = _worst(20) + f" select {SETTING}, id, case_no, transcription, round(wer, 6) as wer, round(cer, 6) as cer from worst"
ORACLE["error_case_text"] = _cases(15, " || 'Audio File:   ' || string_split(gcs_uri, '/')[-1] || chr(10)") + " select * from cases"
_HEAD, _TAIL = K.CRITIC_PROMPT.replace("{top_n}", "20").split("{error_cases_text}")
ORACLE["critic_prompt"] = _cases(20) + f"""
select {SETTING}, replace({quoted(_HEAD)}, '{{lang}}', lang) || error_cases_text || {quoted(_TAIL)} as prompt from cases"""

_CRITIQUES = """critiques as (
  select conv_id, turn, 1 as critique_no, role as error_pattern, 'Case ' || turn as affected_cases, text as reason_for_failure,
         'Keep: ' || text as generalizable_improvement from conversations
  union all select conv_id, turn, 2, 'Other', 'all', md5(text), text from conversations)"""
ORACLE["critic_rows"] = f"with {_CRITIQUES} select * from critiques"
_CRITIQUE_TEXT = _CRITIQUES + """, critique_texts as (
  select conv_id, turn, string_agg('## Critique ' || critique_no || chr(10) || 'Error Pattern: ' || error_pattern || chr(10)
    || 'Affected Cases: ' || affected_cases || chr(10) || 'Reason for Failure: ' || reason_for_failure || chr(10)
    || 'Generalizable Improvement: ' || generalizable_improvement || chr(10) || chr(10), '' order by critique_no) as critiques_text
  from critiques group by conv_id, turn)"""
ORACLE["critique_text"] = f"with {_CRITIQUE_TEXT} select * from critique_texts"

ORACLE["critic_fallback"] = f"""with {RUNS}, train as (
  {first_of('runs', SETTING, 'run_seq desc', "*, coalesce(replace(prompt_version, '.txt', ''), 'default') as version_label", "\"group\" = 'train'")}),
exact as (
  select lang, model, config, coalesce(replace(prompt_version, '.txt', ''), 'default') as version_label, run_seq as critique_no,
         'pattern ' || run_seq as error_pattern, 'case ' || run_seq as affected_cases, model as reason_for_failure, config as generalizable_improvement
  from runs where "group" = 'train' and cer >= 0.4),
general as (
  select lower(n_name) as lang, n_nationkey as critique_no, n_name as error_pattern, 'all' as affected_cases, r_name as reason_for_failure,
         'See ' || r_name as generalizable_improvement from nation join region on n_regionkey = r_regionkey),
own as (select train.run_seq, 'run' as critic_source, exact.* exclude (lang, model, config, version_label)
        from train join exact using (lang, model, config, version_label))
select * from own
union all
select run_seq, case when critique_no is null then 'none' else 'language' end, general.* exclude (lang)
from train left join general on train.lang = general.lang where run_seq not in (select run_seq from own)"""

ORACLE["prompt_fallback"] = f"""with {RUNS}, main as (select 'prompt_v' || item_id || '.txt' as prompt_version, text as t from benchmark),
modified as (select 'prompt_v4_' || lower(n_name) || '.txt' as prompt_version, 'Rules for ' || n_name as t from nation)
select run_seq, runs.prompt_version, coalesce(main.t, modified.t, (select t from main where prompt_version = 'prompt_v2.txt'), '{K.MISSING_PROMPT}') as used_prompt
from runs left join main on runs.prompt_version = main.prompt_version left join modified on runs.prompt_version = modified.prompt_version"""

ORACLE["render_prompt"] = f"""with {_CRITIQUE_TEXT}
select conv_id, turn, replace(replace(
    'Model ' || role || ', config default {{keep this}}.' || chr(10) || '# Prompt' || chr(10) || '{{error_cases_text}} ' || text || chr(10)
    || '# Cases' || chr(10) || '{{error_cases_text}}' || chr(10) || '# Critiques' || chr(10) || '{{critiques_text}}',
    '{{error_cases_text}}', 'Cases of ' || text), '{{critiques_text}}', critiques_text) || {quoted(K.PROMPT_BLOCK_REQUEST)} as analysis_prompt
from conversations join critique_texts using (conv_id, turn)"""

ORACLE["extract_fenced"] = f"""select 'prompt_v' || turn || '_' || role || '.txt' as prompt_version, role as lang, {strip('text')} as text,
  md5(case role
    when 'assistant' then 'Old:' || chr(10) || '```text' || chr(10) || 'old' || chr(10) || '```' || chr(10) || 'New:' || chr(10)
                          || '```prompt' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
    when 'user' then '1. **Analysis**' || chr(10) || '3. **Optimized Prompt Proposal**' || chr(10) || ' ' || text
    else text end) as report_md5 from conversations"""

# best test run per language, the worst 15 rows of its training run, the nation rows of the language as critiques
ORACLE["rewrite_requests"] = ROW_SCORED + CORPUS_CER + f""",
kept_words as (  -- a last word that matches nothing: best of inserting it and of putting it against a reference word
  select k, 1 + min(case when i = len(rw) then e else e + len(rw) - 1 - i end) as word_edits2
  from dist join tok using (k) where j = len(hw) group by k),
word_rates as (
  select lang, model, config, prompt_version, sum(word_edits2)::double / sum(ref_words)::double as wer
  from scored join kept_words using (k) where "group" = 'test' group by lang, model, config, prompt_version),
candidates as (
  select *, ('0x' || substr(md5('/results/evaluation_test_' || lang || '_' || model || '-' || config || '_'
                               || replace(prompt_version, '.txt', '') || '.csv'), 1, 15))::bigint as run_seq
  from summary join word_rates using (lang, model, config, prompt_version) where "group" = 'test'),
best as (
  select * from (select *, row_number() over (partition by lang order by cer, wer, run_seq) as rn from candidates) where rn = 1),
worst as (
  select * from (
    select scored.*, row_number() over (partition by lang order by scored.cer desc, scored.wer desc, id) as case_no
    from scored join best using (lang, model, config, prompt_version) where scored."group" = 'train') where case_no <= 15),
cases as (
  select lang, model, config, prompt_version, string_agg('## Case ' || case_no || chr(10) || 'Ground Truth: ' || transcription || chr(10)
    || 'Prediction:   ' || {no_end_mark('prediction')} || chr(10)
    || 'WER: ' || {two_digits('wer')} || ', CER: ' || {two_digits('cer')} || chr(10)
    || 'Audio File:   ' || string_split(gcs_uri, '/')[-1] || chr(10) || chr(10), '' order by case_no) as cases
  from worst group by lang, model, config, prompt_version),
critiques as (
  select case n_regionkey when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'none' end as lang,
    string_agg('## Critique ' || n_nationkey || chr(10) || 'Error Pattern: ' || n_name || chr(10) || 'Affected Cases: all' || chr(10)
      || 'Reason for Failure: ' || n_name || chr(10) || 'Generalizable Improvement: ' || n_name || chr(10) || chr(10), '' order by n_nationkey) as critiques
  from nation group by 1)
select cases.lang, model, config, prompt_version,
  'Model ' || model || ', config ' || config || ' {{keep this}}.' || chr(10) || '# Prompt' || chr(10)
  || (select text from benchmark where item_id = 2) || chr(10) || '# Cases' || chr(10) || cases || chr(10)
  || '# Critiques' || chr(10) || coalesce(critiques, '') || {quoted(K.PROMPT_BLOCK_REQUEST)} as analysis_prompt
from cases left join critiques using (lang)"""

# --- report ---------------------------------------------------------------------------------

ORACLE["summary_sorted"] = f"with {RUNS} select {RUN_OUT}, local_inference_csv_path from report_runs"

ORACLE["report_dims"] = f"""with {RUNS} select distinct 'lang' as dim, lang as value from report_runs
union all select distinct 'group', "group" from report_runs"""

ORACLE["report_chart"] = f"""with {RUNS}, bars as (
  select {SETTING}, {mean_percent('wer')} as avg_wer, {mean_percent('cer')} as avg_cer from report_runs where "group" = 'test' group by {SETTING})
select {SETTING}, model || ' (' || config || ') [' || coalesce(prompt_version, 'default') || '] [' || lang || ']' as label, avg_wer, avg_cer,
       avg_wer = min(avg_wer) over () as best_wer, avg_cer = min(avg_cer) over () as best_cer from bars"""

ORACLE["report_views"] = f"""with {RUNS}, bars as (
  select {SETTING}, {mean_percent('wer')} as avg_wer, {mean_percent('cer')} as avg_cer from report_runs group by {SETTING}),
lowest as (
  select grouping(lang, "group") as s, lang as l, "group" as g, min(avg_wer) as w, min(avg_cer) as c from bars
  group by grouping sets ((lang, "group"), (lang), ("group"), ()))
select case when s >= 2 then 'all' else lang end as view_lang, case when s % 2 = 1 then 'all' else "group" end as view_group, {SETTING},
  model || ' (' || config || ') [' || coalesce(prompt_version, 'default') || ']' || case when s >= 2 then ' [' || lang || ']' else '' end
    || case when s % 2 = 1 then ' [' || "group" || ']' else '' end as label,
  avg_wer, avg_cer, avg_wer = w as best_wer, avg_cer = c as best_cer
from bars join lowest on (s >= 2 or l = lang) and (s % 2 = 1 or g = "group")"""

ORACLE["remembered_answers"] = """with asked as (select distinct text from conversations where role = 'user')
select conv_id, turn, 'chars ' || length(c.text) as answer,
  case when c.text is null then null when a.text is not null then 'first' else 'second' end as asked_in
from conversations c left join asked a on a.text = c.text"""

ORACLE["report_flags"] = f"""with {RUNS}, named as (select * replace (nullif("group", 'silence') as "group") from report_runs)
select {RUN_OUT}, wer = min(wer) over (partition by lang, "group") as best_wer,
  cer = min(cer) over (partition by lang, "group") as best_cer from named"""

ORACLE["report_detail"] = ROW_SCORED + CORPUS_CER + """,
best as (
  select * from (select *, row_number() over (partition by "group", lang order by cer, model, config, prompt_version) as rn from summary) where rn = 1),
numbered as (
  select scored.*, row_number() over (partition by {s} order by id) as row_no from scored)
select n."group", n.lang, row_no, n.id, n.transcription, {p} as prediction, round(n.wer, 6) as wer, round(n.cer, 6) as cer,
  n.gcs_uri as audio_path
from numbered n join best b on n.lang = b.lang and n."group" = b."group" and n.model = b.model and n.config = b.config and n.prompt_version = b.prompt_version
where row_no <= 20 and n.r <> ''""".format(s=SETTING, p=no_end_mark("n.prediction"))

ORACLE["html_escape"] = "select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from pages"

_ASSETS = r"""assets as (select distinct '/' || w as path from (select unnest(regexp_split_to_array(text, '[ \n]')) as w from benchmark) where w <> ''),
links as (
  select page_id, unnest(v) as encoded, generate_subscripts(v, 1) as pos
  from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as v from pages)),
known as (select distinct encoded, 'audio/' || url_encode(string_split(url_decode(encoded), '/')[-1]) as new_link, url_decode(encoded) as path
  from links where encoded <> '' and url_decode(encoded) in (select path from assets))"""
ORACLE["asset_manifest"] = f"""with {_ASSETS}
select path, new_link, count(*) as n_links from links join known using (encoded) group by path, new_link"""
ORACLE["asset_rewrite"] = f"""with {_ASSETS}, changed as (
  select page_id, string_agg(piece || coalesce('href="' || coalesce(new_link, links.encoded) || '"', ''), '' order by pos) as html
  from (select page_id, unnest(p) as piece, generate_subscripts(p, 1) as pos
        from (select page_id, regexp_split_to_array(html, 'href="[^"]*"') as p from pages))
  left join links using (page_id, pos) left join known on known.encoded = links.encoded group by page_id)
select * from changed"""

# --- audio ----------------------------------------------------------------------------------

_CLIPS = """clips as (select vec_id as id, list_concat(embedding, list_reverse(embedding)) as main from embeddings)"""


def rms(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}, lambda s: s::double * s::double)) / len({x}))"


_MIXED = f"""with {_CLIPS}, {PICK}, mixed as (
  select id, noise_id, main, samples, {rms('main')} / {rms('samples')} * 0.3 as gain from clips join noise on noise.pick = {draw('id')})"""
ORACLE["audio_dbfs"] = f"with {_CLIPS} select id, round(20 * log10({rms('main')}), 5) as dbfs from clips"
ORACLE["noise_gain"] = _MIXED + " select id, noise_id, round(gain, 6) as gain from mixed"
ORACLE["noise_mix"] = _MIXED + """
select id, (pos - 1)::int as pos, round(greatest(-1.0, least(1.0, x::double + gain * samples[((pos - 1) % len(samples)) + 1]::double))::float::double, 4) as sample
from (select id, gain, samples, unnest(main) as x, generate_subscripts(main, 1) as pos from mixed)"""
ORACLE["usable_clips"] = "select 'noise' || vec_id as noise_id, vec_id % 10 not in (3, 5, 7) as usable from embeddings"
ORACLE["silence_insert"] = f"""with {_CLIPS}, gap as (select list_transform(range(16), lambda i: 0.0::float) as z), placed as (
  select id, 'front' as position, list_concat(z, main) as c from clips, gap
  union all select id, 'middle', list_concat(list_concat(main[1:len(main) // 2], z), main[len(main) // 2 + 1:]) from clips, gap
  union all select id, 'back', list_concat(main, z) from clips, gap)
select id, position, (generate_subscripts(c, 1) - 1)::int as pos, round(unnest(c)::double, 4) as sample from placed"""
ORACLE["noise_mix_blocks"], ORACLE["silence_insert_blocks"] = ORACLE["noise_mix"], ORACLE["silence_insert"]

# --- job states -----------------------------------------------------------------------------

_STATUS = """with latest as (
  select 'job-' || user_id as job_name, case event_type when 'view' then 'JOB_STATE_PENDING' when 'click' then 'JOB_STATE_RUNNING'
      when 'signup' then 'JOB_STATE_QUEUED' when 'purchase' then 'JOB_STATE_SUCCEEDED' else 'JOB_STATE_FAILED' end as state
  from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1), flagged as (
  select *, state in ('JOB_STATE_PENDING', 'JOB_STATE_RUNNING', 'JOB_STATE_QUEUED') as is_active,
         state in ('JOB_STATE_SUCCEEDED', 'JOB_STATE_FAILED') as is_terminal from latest)"""
ORACLE["job_status"] = _STATUS + " select * from flagged"
ORACLE["job_state_counts"] = _STATUS + " select state, is_active, is_terminal, count(*) as n_jobs from flagged group by all"
ORACLE["job_union_distinct"] = "select 'job-' || o_custkey as job_name from orders union select 'job-' || user_id from events"
ORACLE["newest_log_jobs"] = """select 'job-' || o_orderkey as job_name from orders where o_orderdate = (select max(o_orderdate) from orders)"""
