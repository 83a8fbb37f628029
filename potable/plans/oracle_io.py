"""DuckDB oracle SQL for the file round trip, commits, response log and streaming."""

from __future__ import annotations

from potable.plans.oracle import blank, jtrim, numbered_cte, oracle, untrans, with_entries
from potable.plans.oracle_model import CATALOGS, model, per_catalog_model

oracle(
    "po_scan",
    with_entries()
    + f"""
select catalog_id, msgctxt, msgid, msgid_plural,
  case when msgid_plural is null then coalesce(msgstr[1], '')
       when len(coalesce(msgstr, cast([] as varchar[]))) = 0 then NULL
       else array_to_string(list_transform(msgstr, lambda x: coalesce(x, '')), chr(31)) end as msgstr_text,
  case when flag is null or flag = '' then NULL else {jtrim('flag')} end as flag,
  case when translator is null or translator = '' then NULL else translator end as translator
from d where not (msgctxt = '' and msgid = '')""",
)

oracle(
    "po_scan_rejects",
    with_entries()
    + """
select catalog_id, case when seq % 37 = 5 then 'unterminated string' when seq % 41 = 7 then 'unknown line' else 'kept' end as reason,
  count(*) as n_entries
from d where not (msgctxt = '' and msgid = '') group by all""",
)

# a file keeps one string of an entry without plural, and its header comes first
_FILE_WORK = f"case when msgid_plural is null then {blank('msgstr[1]')} else untranslated end"
_FILE_ORDER = "ctx_int is null, ctx_int, msgctxt <> '', ctx_first, id_int is null, id_int, seq"

oracle(
    "translate_po_files",
    model(numbered=numbered_cte(_FILE_WORK, _FILE_ORDER))
    + f"""
select catalog_id, msgctxt, msgid, msgid_plural,
  case when msgid_plural is null then coalesce(new_msgstr[1], '')
       when len(coalesce(new_msgstr, cast([] as varchar[]))) = 0 then NULL
       else array_to_string(list_transform(new_msgstr, lambda x: coalesce(x, '')), chr(31)) end as msgstr_text,
  case when flag is null or flag = '' then NULL else {jtrim('flag')} end as flag,
  case when new_translator is null or new_translator = '' then NULL else new_translator end as translator
from mg where not (msgctxt = '' and msgid = '')""",
)

oracle(
    "po_scan_headers",
    with_entries(CATALOGS.strip())
    + """
, hv as (select catalog_id, key, case when key = 'Content-Type' and strpos(lower(value), 'charset=') > 0
    then substr(value, 1, strpos(value, 'charset=') + 7) || lower(substr(value, strpos(value, 'charset=') + 8)) else value end as value
  from hd)
select c.catalog_id, h.headers_text, c.target_language
from catl c left join (select catalog_id, string_agg(key || '=' || value, chr(31) order by key || '=' || value) as headers_text
  from hv group by catalog_id) h using (catalog_id)""".replace("\n, hv as", ", hv as", 1),
)

oracle(
    "po_compile_stats",
    with_entries(CATALOGS.strip())
    + """
select c.catalog_id, cast(coalesce(n.n_msgid, 0) + 1 as bigint) as n_msgid_lines, cast(coalesce(n.n_ctx, 0) as bigint) as n_msgctxt_lines
from catl c left join (select catalog_id, count(*) as n_msgid, count_if(msgctxt <> '') as n_ctx
  from d where not (msgctxt = '' and msgid = '') group by catalog_id) n using (catalog_id)""",
)

# ------------------------------------------------------------------ compiled text


def _esc(x: str) -> str:
    steps = [("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(9)", "'\\t'"), ("chr(13)", "'\\r'"), ("chr(10)", "'\\n'")]
    for old, new in steps:
        x = f"replace({x}, {old}, {new})"
    return x


def _behind(x: str, mark: str) -> str:
    """Pieces with ``mark`` at their end, the rest last; none is empty."""
    parts = f"string_split({x}, {mark})"
    return f"list_filter(list_transform({parts}, lambda q, j: case when j < len({parts}) then q || {mark} else q end), lambda q: q <> '')"


def _plain_lines(x: str) -> str:
    return f"list_transform({_behind(f'coalesce({x}, {chr(39)}{chr(39)})', 'chr(10)')}, lambda p: {_esc('p')})"


def _folded_lines(x: str, width: int) -> str:
    """Words taken into the last line while they fit; lines are kept apart by a newline (never in escaped text)."""
    units = (
        f"flatten(list_transform({_behind('p', chr(39) + ' ' + chr(39))}, lambda w: case when length({_esc('w')}) > {width} "
        f"then regexp_extract_all({_esc('w')}, '(?s)\\\\.|[^\\\\]') else [{_esc('w')}] end))"
    )
    last = f"string_split(right(acc, {width + 1}), chr(10))[-1]"
    fold = (
        f"string_split(list_reduce({units}, lambda acc, u: case when length({last}) + length(u) <= {width} or {last} = '' "
        f"then acc || u else acc || chr(10) || u end), chr(10))"
    )
    return f"flatten(list_transform({_behind(f'coalesce({x}, {chr(39)}{chr(39)})', 'chr(10)')}, lambda p: {fold}))"


def _quoted(key: str, lines: str) -> str:
    return (
        f"(case when len({lines}) < 2 then {key} || ' \"' || coalesce({lines}[1], '') || '\"' "
        f"else {key} || ' \"\"' || chr(10) || '\"' || array_to_string({lines}, '\"' || chr(10) || '\"') || '\"' end)"
    )


def _compile_sql(lines) -> str:
    comment = "case when {0} is not null and length({0}) > 0 then array_to_string(list_transform(regexp_split_to_array({0}, '\\r?\\n|\\r'), lambda l: '{1}' || l), chr(10)) end"
    return with_entries(CATALOGS.strip()) + f"""
, x as (select catalog_id, seq, msgctxt, msgid_plural, flag, translator, {lines('msgctxt')} as l_ctx, {lines('msgid')} as l_id,
    {lines('msgid_plural')} as l_pl, {lines('msgstr[1]')} as l_str,
    list_transform(coalesce(msgstr, cast([] as varchar[])), lambda m: {lines('m')}) as l_forms
  from d where not (msgctxt = '' and msgid = '')),
y as (select catalog_id, seq, concat_ws(chr(10),
    {comment.format('translator', '# ')}, {comment.format('flag', '#, ')},
    case when msgctxt <> '' then {_quoted("'msgctxt'", 'l_ctx')} end, {_quoted("'msgid'", 'l_id')},
    case when coalesce(length(msgid_plural), 0) > 0 then {_quoted("'msgid_plural'", 'l_pl')} else {_quoted("'msgstr'", 'l_str')} end,
    case when coalesce(length(msgid_plural), 0) > 0 and len(l_forms) > 0 then array_to_string(list_transform(l_forms,
      lambda f, i: {_quoted("('msgstr[' || (i - 1) || ']')", 'f')}), chr(10)) end) as text from x),
hp as (select catalog_id, i, key, case when key = 'Content-Type' and strpos(lower(value), 'charset=') > 0
    then substr(value, 1, strpos(value, 'charset=') + 7) || lower(substr(value, strpos(value, 'charset=') + 8)) else value end as value
  from (select *, row_number() over (partition by catalog_id, key order by i desc) as rn from hn where key <> '') q where rn = 1),
ht as (select c.catalog_id, coalesce(string_agg(p.key || ': ' || p.value || chr(10), '' order by p.i), '') as head
  from catl c left join hp p using (catalog_id) group by c.catalog_id),
hc as (select catalog_id, concat_ws(chr(10), {comment.format('translator', '# ')}, {comment.format('flag', '#, ')}) as notes
  from d where msgctxt = '' and msgid = '')
select catalog_id, seq, md5(text) as text_md5 from y
union all
select catalog_id, cast(0 as bigint), md5(case when coalesce(notes, '') <> '' then notes || chr(10) else '' end
  || 'msgid ""' || chr(10) || {_quoted("'msgstr'", 'hl')}) from (
  select catalog_id, notes, {_plain_lines('head')} as hl from ht left join hc using (catalog_id))""".replace("\n, x as", ", x as", 1)


oracle("po_compile", _compile_sql(_plain_lines))
oracle("po_compile_folded", _compile_sql(lambda x: _folded_lines(x, 76)))

_COMMITTED = """
select '{run}' as run_id, 'result' as kind, catalog_id, batch_no, cast(pos as bigint) as n, array_to_string(rmsgstr, chr(31)) as value from res
union all
select '{run}', 'attempt', catalog_id, batch_no, cast(attempt as bigint), cast(status as varchar) from lg"""

oracle(
    "commit_results",
    f"select * from ({model()} {_COMMITTED.format(run='run-1')}) union all select * from ({per_catalog_model()} {_COMMITTED.format(run='run-2')})",
)

oracle(
    "response_log_scan",
    model()
    + "select catalog_id, batch_no, attempt, cast(status as bigint) as status, md5(content) as content_md5 from ct",
)

# both editions by file order; the second sends what the first did not hold, behind its batches
oracle(
    "incremental_worklist",
    with_entries()
    + f"""
, blanks as (select * from d where msgid <> '' and {_FILE_WORK.replace('untranslated', untrans('msgstr'))}),
e1 as (select *, 0 as edition, 0 as upto, row_number() over (partition by catalog_id order by {_FILE_ORDER.replace('ctx_first', 'c1')}) as n
  from (select a.*, f.c1 from blanks a join (select catalog_id, msgctxt, min(seq) as c1 from d where seq % 5 <> 0 or msgid = '' group by all) f
    using (catalog_id, msgctxt) where seq % 5 <> 0) q),
b1 as (select catalog_id, cast(ceil(count(*) / 15) as bigint) as upto from e1 group by catalog_id),
e2 as (select a.*, 1 as edition, coalesce(b1.upto, 0) as upto, row_number() over (partition by a.catalog_id order by {_FILE_ORDER}) as n
  from blanks a left join b1 using (catalog_id) where seq % 5 = 0),
both_editions as (select catalog_id, edition, upto, n, msgctxt, msgid, msgid_plural from e1 union all
  select catalog_id, edition, upto, n, msgctxt, msgid, msgid_plural from e2)
select catalog_id, cast(edition as bigint) as edition, cast(upto + floor((n - 1) / 15) + 1 as bigint) as batch_no,
  cast((n - 1) % 15 as bigint) as pos, msgctxt, coalesce(msgid_plural, msgid) as asked
from both_editions""".replace("\n, blanks as", ", blanks as", 1),
)
