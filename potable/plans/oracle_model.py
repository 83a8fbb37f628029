"""DuckDB oracle SQL for language fields, requests, replies, attempts and merge.

Replies of the pseudo provider are rebuilt here with DuckDB's JSON builder and
checked with DuckDB's JSON functions (``json_valid``, ``json_type``,
``json_keys``), independent of Spark's VARIANT path.
"""

from __future__ import annotations

from potable.functions.text import JS_WS_CLASS_RE2 as WS
from potable.functions.text import PLACEHOLDER_PATTERN
from potable.operators.locale import ISO_639_1, LANGUAGES, PLURAL_RULES, SAMPLE_SEARCH_MAX
from potable.operators.request import BASE_SYSTEM_MESSAGE, DEFAULT_MODEL, PROJECT_SECTION_HEADER
from potable.operators.attempts import CATEGORY_ADVICE
from potable.plans.options import JOB_CONFIG
from potable.plans.oracle import ORACLE, blank, jtrim, marker, numbered_cte, oracle, untrans, with_entries


# The recorded service's errors by mode 0..8 (status, code, message), and its number of modes.
N_MODES = 89
API_ERRORS = [
    (429, None, "Rate limit reached for requests"),
    (429, "insufficient_quota", "You exceeded your current quota, please check your plan"),
    (500, None, "The server had an error while processing your request"),
    (503, None, "The engine is currently overloaded, please try again later"),
    (401, None, "Incorrect API key provided"),
    (403, None, "Country, region, or territory not supported"),
    (400, None, "Invalid schema for response_format 'translation_payload'"),
    (400, None, "Invalid value for 'messages'"),
    (404, None, "The model does not exist"),
]


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_ISO = ", ".join(f"'{code}'" for code in ISO_639_1)


def _langdim() -> str:
    rows = ", ".join(
        f"({_q(code)}, {_q(fam)}, {PLURAL_RULES[fam][0]}, {_q(PLURAL_RULES[fam][1])})" for code, fam in LANGUAGES.items()
    )
    return f"langdim as (select * from (values {rows}) t(code, family, nplurals, formula))"


def _rule() -> str:
    arms = " ".join(f"when family = '{name}' then ({expr})" for name, (_, _, expr) in PLURAL_RULES.items())
    return f"(case {arms} end)"


CT = "'Content-Type: text/plain; charset=UTF-8' || chr(10)"

CATALOGS = f"""
{_langdim()},
cat0 as (
  select source, lang, source || '.' || lang as catalog_id,
    coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint), 0) as srcn
  from documents group by source, lang
),
cat1 as (select c.*, coalesce(l.formula, '') as fml from cat0 c left join langdim l on l.code = c.lang),
cat as (
  select catalog_id, source, lang, srcn, case srcn % 5
    when 0 then 'Language: ' || lang || chr(10) || 'Plural-Forms: ' || fml || chr(10) || {CT}
    when 1 then 'Plural-Forms: ' || fml || chr(10) || {CT}
    when 2 then 'Language: ' || chr(10) || {CT}
    when 3 then 'language: ' || lang || '_' || upper(lang) || chr(10) || 'plural-forms: ' || fml || chr(10) || {CT}
    else 'Language: xx' || chr(10) || 'X-Generator: potable' || chr(10) || 'Language: ' || chr(9) || lang
         || ' extra' || chr(10) || 'MIME-Version: 1.0' || chr(10) || {CT} end as header_text
  from cat1
),
hl as (
  select catalog_id, i, string_split(header_text, chr(10))[i] as line
  from (select *, unnest(range(1, len(string_split(header_text, chr(10))) + 1)) as i from cat) z
),
hk as (
  select catalog_id, i, lower({jtrim("split_part(line, ':', 1)")}) as low,
    case when strpos(line, ':') > 0 then {jtrim("substr(line, strpos(line, ':') + 1)")} else '' end as value
  from hl
),
hw as (select *, array_to_string(list_transform(string_split(low, '-'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '-') as words from hk),
hn as (
  select catalog_id, i, value, case when starts_with(low, 'mime') then 'MIME' || substr(words, 5)
    when starts_with(low, 'pot-') then 'POT' || substr(words, 4) when starts_with(low, 'po-') then 'PO' || substr(words, 3)
    else words end as key
  from hw
),
hd as (select catalog_id, key, value from (select *, row_number() over (partition by catalog_id, key order by i desc) as rn from hn where key <> '') q where rn = 1),
hagg as (
  select catalog_id, max(case when key = 'Language' then value end) as language,
    max(case when key = 'Plural-Forms' then value end) as plural_forms,
    string_agg(key || '=' || value, chr(31) order by key || '=' || value) as headers_text
  from hd group by catalog_id
),
catl as (
  select c.catalog_id, c.source, c.lang, c.srcn, h.language, h.plural_forms, h.headers_text,
    coalesce(h.language, 'en') as target_language, coalesce(h.plural_forms, '') as formula
  from cat c left join hagg h using (catalog_id)
),
catx as (select *, regexp_split_to_array({jtrim('target_language')}, '{WS}')[1] as locale from catl),
ln as (select l.code, l.family, l.nplurals, r.n, {_rule()} as form from langdim l, range(0, {SAMPLE_SEARCH_MAX + 1}) r(n)),
ls as (select code, form, coalesce(min(case when n >= 1 then n end), 0) as sample from ln group by code, form),
lst as (
  select code, max(l.nplurals) as nplurals, string_agg(form || ':' || sample, ',' order by form) as samples_text,
    count(*) as n_samples
  from ls join langdim l using (code) group by code
)"""


def _overrides() -> str:
    return """
ovr as (
  select catalog_id, lang, srcn,
    case when srcn % 4 = 0 then ' ' || upper(lang) || ' ' when srcn % 4 = 1 then 'zz' when srcn % 4 = 3 then lang || '-x' end as source_lang,
    case when srcn % 3 = 0 then 'gpt-4.1' end as model,
    case when srcn % 5 = 0 then true when srcn % 5 = 1 then false end as include_fuzzy,
    case when srcn % 2 = 0 then false when srcn % 7 = 1 then true end as add_fuzzy,
    case when srcn % 6 = 0 then 0 when srcn % 6 = 1 then 76 end as fold_length,
    case when srcn % 7 = 0 then 'Use formal tone' when srcn % 7 = 1 then '   ' end as context,
    case when srcn % 8 = 0 then true end as debug
  from cat
),
opt as (
  select catalog_id,
    coalesce(source_lang, {sl}) as source_lang,
    coalesce(model, {model}) as model,
    coalesce(include_fuzzy, {inc}, false) as include_fuzzy,
    coalesce(add_fuzzy, {add}, false) as add_fuzzy,
    cast(coalesce(fold_length, {fold}) as bigint) as fold_length,
    coalesce(context, {ctx}) as context,
    coalesce(debug, {dbg}, false) as debug
  from ovr
)""".format(
        sl=_q(JOB_CONFIG["source_lang"]),
        model=f"cast({_q(JOB_CONFIG['model'])} as varchar)",
        inc=_bool(JOB_CONFIG["include_fuzzy"]),
        add=_bool(JOB_CONFIG["add_fuzzy"]),
        fold="NULL" if JOB_CONFIG["fold_length"] is None else str(JOB_CONFIG["fold_length"]),
        ctx=_q(JOB_CONFIG["context"]),
        dbg=_bool(JOB_CONFIG["debug"]),
    )


def _bool(v: bool | None) -> str:
    return "cast(NULL as boolean)" if v is None else ("true" if v else "false")


def _status_case(field: int) -> str:
    arms = []
    for k, e in enumerate(API_ERRORS):
        v = e[field]
        arms.append(f"when {k} then {v if field == 0 else _q(v)}")
    default = "200" if field == 0 else "NULL"
    return f"(case m {' '.join(arms)} else {default} end)"


_DROP = "%[a-z]|\\{[a-z]*\\}|<[^>]*>"
_FENCE = f"(?s)^```(?:json)?{WS}*\\n?(.*?)\\n?```{WS}*$"

REQUESTS = f"""
rq as (select catalog_id, batch_no, count(*) as n_items from nb group by catalog_id, batch_no),
rqx as (
  select rq.*, c.target_language, c.formula, c.locale, coalesce(s.n_samples, 0) as n_samples, s.samples_text
  from rq join catx c using (catalog_id) left join lst s on s.code = c.locale
),
it as (select nb.*, r.n_items, r.target_language, r.n_samples from nb join rqx r using (catalog_id, batch_no)),
att as (
  select r.*, k.attempt,
    cast(((coalesce(try_cast(regexp_extract(r.catalog_id, '^src([0-9]+)', 1) as bigint), 0) * 7
      + ascii(string_split(r.catalog_id, '.')[-1])) * 19 + r.batch_no * 13 + k.attempt * 3) % {N_MODES} as bigint) as m
  from rqx r, (select range as attempt from range(1, 5)) k
),
el0 as (
  select it.*, a.attempt, a.m,
    case when a.m = 16 and it.pos = 0 then it.msgctxt || '#' else it.msgctxt end as ctx_out,
    (a.m = 22 and it.msgctxt = '') as omit_ctx,
    (a.m = 18 and it.pos = it.n_items - 1) as omit_str,
    '[' || it.target_language || '] ' || case when a.m in (23, 24) then regexp_replace(it.msgid, '{_DROP}', '', 'g') else it.msgid end as text,
    case when a.m = 17 and it.pos = 0 then it.msgid || '#' else it.msgid end as id_out,
    case when a.m = 17 and it.pos = 0 then it.msgid_plural || '#' else it.msgid_plural end as pl_out,
    case when a.m in (23, 24) then regexp_replace(it.msgid_plural, '{_DROP}', '', 'g') else it.msgid_plural end as pl_src,
    case when it.n_samples > 0 then it.n_samples else 2 end as nf
  from it join att a using (catalog_id, batch_no)
),
el1 as (select *, list_transform(range(0, nf), lambda f: '[' || target_language || '#' || f || '] ' || pl_src) as forms from el0),
el as (
  select catalog_id, batch_no, attempt, m, pos, n_items,
    case when msgid_plural is null then (case
        when m = 20 then json_object('msgid', id_out, 'msgctxt', ctx_out, 'msgstr', [text])
        when m = 19 then json_object('msgid', id_out, 'msgid_plural', NULL, 'msgctxt', ctx_out, 'msgstr', text)
        when omit_ctx then json_object('msgid', id_out, 'msgstr', text)
        when omit_str then json_object('msgid', id_out, 'msgctxt', ctx_out)
        else json_object('msgid', id_out, 'msgctxt', ctx_out, 'msgstr', text) end)
    else (case
        when m = 20 then json_object('msgid_plural', pl_out, 'msgctxt', ctx_out, 'msgstr', forms[1])
        when m = 19 then json_object('msgid', 'x', 'msgid_plural', pl_out, 'msgctxt', ctx_out, 'msgstr', forms)
        when omit_ctx then json_object('msgid_plural', pl_out, 'msgstr', forms)
        when omit_str then json_object('msgid_plural', pl_out, 'msgctxt', ctx_out)
        when m = 21 then json_object('msgid_plural', pl_out, 'msgctxt', ctx_out, 'msgstr', forms[1:nf - 1])
        else json_object('msgid_plural', pl_out, 'msgctxt', ctx_out, 'msgstr', forms) end) end as ej
  from el1
),
bd as (
  select catalog_id, batch_no, attempt,
    '{{"translations":[' || coalesce(string_agg(cast(ej as varchar), ',' order by pos) filter (where not (m = 15 and pos = n_items - 1)), '') || ']}}' as body
  from el group by catalog_id, batch_no, attempt
),
ct as (
  select a.catalog_id, a.batch_no, a.attempt, a.m, a.n_items, a.n_samples,
    {_status_case(0)} as status, {_status_case(1)} as code, {_status_case(2)} as message,
    case when a.m < {len(API_ERRORS)} then NULL
      when a.m = 9 then '```json' || chr(10) || b.body || chr(10) || '```'
      when a.m = 10 then NULL
      when a.m = 11 then ' ' || chr(10) || ' '
      when a.m = 12 then 'nope ' || substr(b.body, 1, 20)
      when a.m = 13 then '[]'
      when a.m = 14 then '{{"translations":{{}}}}'
      else b.body end as content
  from att a left join bd b using (catalog_id, batch_no, attempt)
),
vd0 as (select *, {jtrim('content')} as raw from ct),
vd1 as (select *, case when regexp_matches(raw, '{_FENCE}') then {jtrim(f"regexp_extract(raw, '{_FENCE}', 1)")} else raw end as stripped from vd0),
vd as (
  select *, case when status <> 200 then 'API_ERROR'
    when {blank('content')} then 'EMPTY'
    when not json_valid(stripped) then 'NOT_JSON'
    when json_type(stripped) <> 'OBJECT' or not list_contains(json_keys(stripped), 'translations') then 'NO_TRANSLATIONS'
    when json_type(stripped, '$.translations') <> 'ARRAY' then 'TRANSLATIONS_NOT_ARRAY'
    when json_array_length(stripped, '$.translations') <> n_items then 'COUNT_MISMATCH' end as doc
  from vd1
),
ev0 as (
  select it.catalog_id, it.batch_no, d.attempt, it.pos, it.seq, it.msgctxt, it.msgid, it.msgid_plural, it.n_samples,
    json_extract(d.stripped, '$.translations[' || it.pos || ']') as x
  from it join vd d using (catalog_id, batch_no) where d.doc is null
),
ev as (
  select *, case
    when coalesce(json_type(x), '') <> 'OBJECT' or not list_contains(json_keys(x), 'msgstr') then 'MISSING_MSGSTR'
    when (case when json_type(x, '$.msgctxt') = 'VARCHAR' then json_extract_string(x, '$.msgctxt') else '' end) <> msgctxt then 'CTX_MISMATCH'
    when msgid_plural is null then (case
      when not coalesce(json_type(x, '$.msgid') = 'VARCHAR' and json_extract_string(x, '$.msgid') = msgid, false) then 'ID_MISMATCH'
      when list_contains(json_keys(x), 'msgid_plural') then 'UNEXPECTED_PLURAL'
      when coalesce(json_type(x, '$.msgstr'), '') <> 'VARCHAR' then 'MSGSTR_NOT_STRING' end)
    else (case
      when not coalesce(json_type(x, '$.msgid_plural') = 'VARCHAR' and json_extract_string(x, '$.msgid_plural') = msgid_plural, false) then 'PLURAL_MISMATCH'
      when list_contains(json_keys(x), 'msgid') then 'UNEXPECTED_MSGID'
      when coalesce(json_type(x, '$.msgstr'), '') <> 'ARRAY'
        or len(list_filter(json_type(x, '$.msgstr[*]'), lambda t: t <> 'VARCHAR')) > 0 then 'MSGSTR_NOT_STRING_ARRAY'
      when n_samples > 0 and json_array_length(x, '$.msgstr') <> n_samples then 'PLURAL_LENGTH' end) end as ecode
  from ev0
),
ef as (select catalog_id, batch_no, attempt, arg_min(ecode, pos) as ecode, min(pos) as epos from ev where ecode is not null group by catalog_id, batch_no, attempt),
va as (
  select vd.*, coalesce(vd.doc, ef.ecode, 'OK') as error_code, ef.epos as error_pos,
    case when vd.status <> 200 then vd.status in (429, 500, 503)
         else coalesce(vd.doc, ef.ecode, 'OK') in ('CTX_MISMATCH', 'ID_MISMATCH', 'PLURAL_MISMATCH') end as retryable
  from vd left join ef using (catalog_id, batch_no, attempt)
),
term as (select *, (error_code = 'OK' or not retryable or attempt >= 4) as terminal from va),
fin as (select catalog_id, batch_no, min(attempt) filter (where terminal) as final_attempt from term group by catalog_id, batch_no),
lg0 as (select t.*, f.final_attempt from term t join fin f using (catalog_id, batch_no) where t.attempt <= f.final_attempt),
-- batch by batch: the first one that failed for good ends its catalog
ends as (select catalog_id, min(batch_no) as stop_batch from lg0 where attempt = final_attempt and error_code <> 'OK' group by catalog_id),
lg as (select l.* exclude (final_attempt) from lg0 l left join ends e using (catalog_id) where e.stop_batch is null or l.batch_no <= e.stop_batch),
outc as (
  select l.catalog_id, l.batch_no, count(*) as n_attempts, max(f.final_attempt) as final_attempt,
    max(case when l.attempt = f.final_attempt then l.error_code end) as final_code
  from lg l join fin f using (catalog_id, batch_no) group by l.catalog_id, l.batch_no
),
outc2 as (select *, case when final_code = 'OK' then 'succeeded' else 'failed' end as outcome from outc),
stops as (select catalog_id, min(batch_no) as stop_batch from outc2 where outcome <> 'succeeded' group by catalog_id),
com as (
  select o.*, (o.outcome = 'succeeded' and (s.stop_batch is null or o.batch_no < s.stop_batch)) as committed
  from outc2 o left join stops s using (catalog_id)
),
okx as (
  select it.catalog_id, it.batch_no, d.attempt, it.pos, it.seq, it.msgctxt, it.msgid, it.msgid_plural,
    json_extract(d.stripped, '$.translations[' || it.pos || ']') as x
  from it join va d using (catalog_id, batch_no) where d.error_code = 'OK'
),
okr as (
  select *, case when msgid_plural is null then [json_extract_string(x, '$.msgstr')]
    else coalesce(json_extract_string(x, '$.msgstr[*]'), cast([] as varchar[])) end as rmsgstr
  from okx
),
res as (select r.* from okr r join com c on c.catalog_id = r.catalog_id and c.batch_no = r.batch_no and c.final_attempt = r.attempt where c.committed),
mg as (
  select d.*, r.rmsgstr is not null as translated_now, coalesce(r.rmsgstr, d.msgstr) as new_msgstr,
    case when r.rmsgstr is null then d.translator
      when d.translator is null or length(d.translator) = 0 then 'ai-translated'
      when {marker('d.translator')} then d.translator
      else d.translator || chr(10) || 'ai-translated' end as new_translator
  from d left join res r on r.catalog_id = d.catalog_id and r.msgctxt = d.msgctxt and r.msgid = d.msgid
)"""


def model(*extra: str, numbered: str | None = None) -> str:
    return with_entries(CATALOGS.strip(), (numbered or numbered_cte()).strip(), REQUESTS.strip(), *extra)


_PER_CATALOG_WORK = (
    "(untranslated or (fuzzy and catalog_id in (select catalog_id from opt where include_fuzzy))) "
    f"and catalog_id in (select catalog_id from opt where lower({jtrim('source_lang')}) in ({_ISO}))"
)


def _clear(x: str) -> str:
    rest = f"array_to_string(list_filter(list_transform(string_split({x}, ','), lambda t: {jtrim('t')}), lambda t: lower(t) <> 'fuzzy'), ', ')"
    return f"(case when {x} is null or length({x}) = 0 then {x} when {rest} = '' then NULL else {rest} end)"


def _add(x: str) -> str:
    tokens = f"list_filter(list_transform(string_split({x}, ','), lambda t: {jtrim('t')}), lambda t: t <> '')"
    return (
        f"(case when {x} is null or length({x}) = 0 then 'fuzzy' "
        f"when len(list_filter({tokens}, lambda t: lower(t) = 'fuzzy')) > 0 then {x} "
        f"else array_to_string(list_append({tokens}, 'fuzzy'), ', ') end)"
    )


def cats(*extra: str) -> str:
    return with_entries(CATALOGS.strip(), *extra)


# ------------------------------------------------------------------------- language

oracle("po_headers", cats() + "select catalog_id, headers_text from catl")
oracle("catalog_language", cats() + "select catalog_id, language from catl")
oracle("catalog_plural_forms", cats() + "select catalog_id, plural_forms from catl")
oracle("target_language", cats() + "select catalog_id, target_language, formula from catl")
oracle("normalized_locale", cats() + "select catalog_id, locale from catx")
oracle(
    "lookup_plural_samples",
    cats() + "select c.catalog_id, c.locale, s.samples_text from catx c left join lst s on s.code = c.locale",
)
# the rules of ``document_formulas`` as SQL over their numbers; no formula is read
oracle(
    "plural_formula_samples",
    """
with d as (
  select *, doc_id % a as b from (
    select doc_id, doc_id % 6 as kind, doc_id % 9 + 2 as a, doc_id % 13 + 1 as c from documents where doc_id is not null) z
),
sized as (
  select *, case kind when 0 then 2 when 1 then 3 when 2 then 4 when 3 then doc_id // 6 % 4 when 4 then 2
    else (case when doc_id % 9 <> 2 then 2 end) end as forms from d
),
forms_at as (
  select *, case kind when 0 then cast(n % a > b as bigint)
    when 1 then case when n % a = b then 0 when (n >= c and n % c = 0) or n = 0 then 1 else 2 end
    when 2 then (n // a + c - n % a + 40) % 4
    when 3 then n % a
    when 4 then case when doc_id % 12 = 4 then cast(n > c and 100 // greatest(n - c, 1) > b as bigint)
      else cast(n = c or (n < c and b > 0) or (n > c and 100 // greatest(n - c, 1) < b)
        or n = 0 or (n >= 2 and 7 % greatest(n - 1, 1) <> 0) as bigint) end
    else cast(n > b as bigint) end as form
  from sized, range(0, 201) r(n)
),
judged as (
  select doc_id, case when kind = 5 and doc_id % 9 = 2 then 'missing'
    when kind = 3 and forms = 0 then 'nplurals'
    when kind = 5 and doc_id % 9 = 5 then 'syntax'
    when kind = 4 and doc_id % 12 <> 4 and c > 1 and b = 0 then 'division'
    when kind = 3 and a > forms then 'range' end as fault
  from sized
),
reached as (
  select doc_id, form, coalesce(min(n) filter (n >= 1), 0) as sample from forms_at group by doc_id, form
)
select s.doc_id, case when j.fault in ('missing', 'nplurals') then -1 else cast(s.forms as bigint) end as nplurals,
  case when j.fault is null then (
    select string_agg(f || ':' || coalesce(cast(r.sample as varchar), '-'), ',' order by f)
    from range(0, s.forms) t(f) left join reached r on r.doc_id = s.doc_id and r.form = f) end as samples_text,
  j.fault
from sized s join judged j using (doc_id)""",
)
oracle(
    "own_plural_samples",
    cats()
    + """select c.catalog_id, c.locale,
  case when starts_with(c.formula, 'nplurals') then 'formula' when s.code is not null then 'locale' end as samples_from,
  coalesce(case when starts_with(c.formula, 'nplurals') then o.samples_text end, s.samples_text) as samples_text
from catx c left join lst s on s.code = c.locale left join lst o on o.code = split_part(c.catalog_id, '.', 2)""",
)
oracle(
    "plural_samples",
    cats()
    + "select s.code as lang, cast(s.nplurals as bigint) as nplurals, s.samples_text from lst s "
    "where s.code in (select distinct lang from documents)",
)
oracle(
    "invalid_source_lang",
    cats(_overrides().strip())
    + f"select catalog_id, source_lang from ovr where source_lang is not null and lower({jtrim('source_lang')}) not in ({_ISO})",
)
oracle(
    "resolve_options",
    cats(_overrides().strip())
    + "select catalog_id, source_lang, model, include_fuzzy, add_fuzzy, coalesce(fold_length, -1) as fold_length, context, debug from opt",
)
oracle(
    "system_message",
    cats(_overrides().strip())
    + f"""
select catalog_id, (context is not null and not {blank('context')}) as has_project_section,
  {_q(BASE_SYSTEM_MESSAGE)} || case when context is not null and not {blank('context')}
    then {_q(PROJECT_SECTION_HEADER)} || context else '' end as message
from opt""",
)

# ------------------------------------------------------------------------- requests

oracle(
    "build_payload",
    model()
    + """
, tr as (select catalog_id, batch_no, string_agg(cast(case when msgid_plural is null then json_object('msgid', msgid, 'msgctxt', msgctxt)
    else json_object('msgid_plural', msgid_plural, 'msgctxt', msgctxt) end as varchar), ',' order by pos) as items from it group by all)
select r.catalog_id, r.batch_no,
  'formula,target_language,source_language,translations' || case when r.n_samples > 0 then ',plural_samples' else '' end as keys_text,
  r.formula, r.target_language, 'en' as source_language, cast(r.n_items as bigint) as n_translations,
  md5('{"formula":' || cast(to_json(r.formula) as varchar) || ',"target_language":' || cast(to_json(r.target_language) as varchar)
    || ',"source_language":"en","translations":[' || tr.items || ']'
    || case when r.n_samples > 0 then ',"plural_samples":[' || array_to_string(list_transform(string_split(r.samples_text, ','),
      lambda s: '{"plural":' || split_part(s, ':', 1) || ',"sample":' || split_part(s, ':', 2) || '}'), ',') || ']' else '' end
    || '}') as payload_md5,
  cast(r.n_samples as bigint) as n_samples
from rqx r join tr using (catalog_id, batch_no)""".replace("\n, tr as", ", tr as", 1),
)
oracle(
    "request_params",
    model()
    + f"""
select catalog_id, batch_no, {_q(DEFAULT_MODEL)} as model, cast(0 as bigint) as temperature, 'json_schema' as response_type,
  'translation_payload' as schema_name, 'true' as strict
from rqx""",
)

# ------------------------------------------------------------------ replies (all attempts)

oracle(
    "strip_json_fences",
    model() + "select catalog_id, batch_no, attempt, stripped from lg where content is not null",
)
oracle(
    "validate_responses",
    model()
    + "select catalog_id, batch_no, attempt, error_code, cast(coalesce(error_pos, -1) as bigint) as error_pos, retryable from lg",
)
oracle(
    "normalize_msgctxt",
    model()
    + """
select catalog_id, batch_no, attempt, cast(pos as bigint) as pos,
  case when json_type(x, '$.msgctxt') = 'VARCHAR' then json_extract_string(x, '$.msgctxt') else '' end as msgctxt_norm
from ev0 semi join lg using (catalog_id, batch_no, attempt)""",
)
oracle(
    "coerce_result",
    model()
    + """
select catalog_id, batch_no, attempt, cast(pos as bigint) as pos, array_to_string(rmsgstr, chr(31)) as msgstr_text,
  cast(len(rmsgstr) as bigint) as n_forms
from okr semi join lg using (catalog_id, batch_no, attempt)""",
)
oracle(
    "classify_api_error",
    model()
    + """
select catalog_id, batch_no, attempt, cast(status as bigint) as status, case
  when status = 401 then 'invalid_api_key' when status = 403 then 'region_unsupported'
  when status = 429 then (case when coalesce(code, '') = 'insufficient_quota' or regexp_matches(coalesce(message, ''), '(?i)quota')
    then 'quota_exceeded' else 'rate_limited' end)
  when status = 400 then (case when regexp_matches(coalesce(message, ''), '(?i)response_format|json_schema|structured')
    then 'schema_unsupported' else 'invalid_request' end)
  when status = 500 then 'server_error' when status = 503 then 'overloaded' else 'generic' end as category
from lg where status <> 200""",
)
oracle(
    "is_retryable",
    model()
    + """
select catalog_id, batch_no, attempt,
  coalesce(status in (429, 500, 503), false) or coalesce(error_code in ('CTX_MISMATCH', 'ID_MISMATCH', 'PLURAL_MISMATCH'), false) as retryable
from lg""",
)

# ------------------------------------------------------------------- the actual run

oracle("retry_rounds", model() + "select catalog_id, batch_no, attempt, cast(status as bigint) as status from lg")
oracle(
    "translate_batches",
    model()
    + "select catalog_id, batch_no, attempt, cast(status as bigint) as status, code, message, md5(content) as content_md5 from lg",
)
oracle(
    "backoff_ms",
    model()
    + "select catalog_id, batch_no, attempt, cast([1000, 2000, 4000][attempt - 1] as bigint) as backoff_ms from lg where attempt > 1",
)
oracle(
    "resolve_attempts",
    model()
    + """
select catalog_id, batch_no, n_attempts, cast(final_attempt as bigint) as final_attempt, final_code,
  cast(0 as bigint) as n_invalid, outcome
from outc2""",
)
oracle("committed_prefix", model() + "select catalog_id, batch_no, outcome, committed from com")
oracle(
    "align_response",
    model()
    + """
select catalog_id, batch_no, cast(pos as bigint) as pos, seq, msgctxt, msgid, msgid_plural,
  array_to_string(rmsgstr, chr(31)) as msgstr_text
from res""",
)
oracle(
    "translate_entries",
    model() + "select catalog_id, seq, msgid, array_to_string(rmsgstr, chr(31)) as msgstr_text from res",
)
oracle(
    "report_lines",
    model()
    + """
select catalog_id, batch_no, cast(pos as bigint) as pos, case when msgid_plural is null
  then '  ' || msgid || ' => ' || coalesce(rmsgstr[1], '')
  else '  ' || msgid_plural || ' (plural) => ' || array_to_string(rmsgstr, ' | ') end as line
from res""",
)

_PH = "(" + PLACEHOLDER_PATTERN + ")"


def _ph(x: str) -> str:
    return f"list_sort(list_filter(regexp_extract_all(coalesce({x}, ''), {_q(_PH)}, 1), lambda p: p <> '%%'))"


oracle(
    "placeholder_parity",
    model()
    + f"""
, pp as (select *, {_ph('coalesce(msgid_plural, msgid)')} as src from res)
select catalog_id, seq, array_to_string(src, ' ') as source_placeholders,
  len(list_filter(rmsgstr, lambda f: {_ph('f')} <> src)) = 0 as parity_ok
from pp""".replace("\n, pp as", ", pp as", 1),
)

# ------------------------------------------------------------------------------ merge

oracle(
    "apply_translations",
    model()
    + """
select catalog_id, seq, msgctxt, msgid, array_to_string(new_msgstr, chr(31)) as msgstr_text, translated_now from mg""",
)
oracle(
    "merge_batches",
    model() + "select catalog_id, seq, array_to_string(new_msgstr, chr(31)) as msgstr_text, flag, new_translator as translator from mg",
)
oracle(
    "mark_machine_translated",
    with_entries()
    + f"""
select catalog_id, seq, case when translator is null or length(translator) = 0 then 'ai-translated'
  when {marker('translator')} then translator else translator || chr(10) || 'ai-translated' end as translator
from d""",
)
oracle(
    "add_fuzzy",
    with_entries()
    + f"""
, tk as (select *, list_filter(list_transform(string_split(flag, ','), lambda x: {jtrim('x')}), lambda x: x <> '') as tokens from d)
select catalog_id, seq, case when flag is null or length(flag) = 0 then 'fuzzy'
  when len(list_filter(tokens, lambda x: lower(x) = 'fuzzy')) > 0 then flag
  else array_to_string(list_append(tokens, 'fuzzy'), ', ') end as flag
from tk""".replace("\n, tk as", ", tk as", 1),
)
oracle(
    "clear_fuzzy",
    with_entries()
    + f"""
, tk as (select *, array_to_string(list_filter(list_transform(string_split(flag, ','), lambda x: {jtrim('x')}), lambda x: lower(x) <> 'fuzzy'), ', ') as rest from d)
select catalog_id, seq, case when flag is null or length(flag) = 0 then flag when rest = '' then NULL else rest end as flag
from tk""".replace("\n, tk as", ", tk as", 1),
)

def per_catalog_model() -> str:
    return with_entries(CATALOGS.strip(), _overrides().strip(), numbered_cte(_PER_CATALOG_WORK).strip(), REQUESTS.strip())


oracle(
    "translate_catalog_options",
    per_catalog_model()
    + f"""
, m1 as (select mg.*, o.include_fuzzy as o_inc, o.add_fuzzy as o_add from mg left join opt o using (catalog_id)),
m2 as (select *, case when translated_now and o_inc then {_clear('flag')} else flag end as flag1 from m1),
m3 as (select *, case when translated_now and o_add then {_add('flag1')} else flag1 end as flag2 from m2)
select catalog_id, seq, array_to_string(new_msgstr, chr(31)) as msgstr_text, flag2 as flag, new_translator as translator
from m3""".replace("\n, m1 as", ", m1 as", 1),
)

oracle(
    "api_error_summary",
    model()
    + """
select case
  when status = 401 then 'invalid_api_key' when status = 403 then 'region_unsupported'
  when status = 429 then (case when coalesce(code, '') = 'insufficient_quota' or regexp_matches(coalesce(message, ''), '(?i)quota')
    then 'quota_exceeded' else 'rate_limited' end)
  when status = 400 then (case when regexp_matches(coalesce(message, ''), '(?i)response_format|json_schema|structured')
    then 'schema_unsupported' else 'invalid_request' end)
  when status = 500 then 'server_error' when status = 503 then 'overloaded' else 'generic' end as category,
  count(*) as n_attempts
from lg where status <> 200 group by 1""",
)
ORACLE["api_error_summary"] = (
    "select category, n_attempts, case category "
    + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in CATEGORY_ADVICE.items())
    + " end as advice from ("
    + ORACLE["api_error_summary"]
    + ") s"
)

oracle(
    "flagship",
    model()
    + f"""
, bef as (select catalog_id, count(*) as n_entries, count_if(untranslated) as untranslated_before,
    count_if({marker('translator')}) as machine_before from st group by catalog_id),
aft as (select catalog_id, count_if({untrans('new_msgstr')}) as untranslated_after,
    count_if({marker('new_translator')}) as machine_after from mg where msgid <> '' group by catalog_id),
bat as (select catalog_id, count(*) as n_batches, count_if(committed) as n_committed,
    count_if(outcome = 'failed') as n_failed from com group by catalog_id)
select b.catalog_id, b.n_entries, cast(b.untranslated_before as bigint) as untranslated_before,
  cast(a.untranslated_after as bigint) as untranslated_after, cast(b.machine_before as bigint) as machine_before,
  cast(a.machine_after as bigint) as machine_after, cast(coalesce(t.n_batches, 0) as bigint) as n_batches,
  cast(coalesce(t.n_committed, 0) as bigint) as n_committed, cast(coalesce(t.n_failed, 0) as bigint) as n_failed
from bef b join aft a using (catalog_id) left join bat t using (catalog_id)""".replace("\n, bef as", ", bef as", 1),
)
