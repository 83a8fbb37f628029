"""DuckDB SQL for each registered query (the correctness oracle).

The oracle rebuilds the entries table from ``documents`` with plain window
functions (``row_number``) and evaluates every rule with DuckDB's own string,
list and JSON functions, so it shares no execution path with the Spark side.
"""

from __future__ import annotations

from potable.functions.text import JS_WS_CLASS_RE2 as WS

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# ------------------------------------------------------------------ SQL helper snippets


def blank(x: str) -> str:
    return f"regexp_full_match(coalesce({x}, ''), '{WS}*')"


def jtrim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def untrans(m: str) -> str:
    return f"(len(list_filter(coalesce({m}, cast([] as varchar[])), lambda x: not {blank('x')})) = 0)"


def fuzzy(f: str) -> str:
    return f"(len(list_filter(string_split(coalesce({f}, ''), ','), lambda x: lower({jtrim('x')}) = 'fuzzy')) > 0)"


def marker(t: str) -> str:
    return (
        f"coalesce(len(list_filter(regexp_split_to_array({t}, '\\r?\\n|\\r'), "
        f"lambda x: {jtrim('x')} = 'ai-translated')) > 0, false)"
    )


def int_key(x: str) -> str:
    return (
        f"(case when regexp_full_match({x}, '0|[1-9][0-9]{{0,9}}') and try_cast({x} as bigint) <= 4294967294 "
        f"then try_cast({x} as bigint) end)"
    )


# The entries table of FIXTURES.md §3 (header rows included) as CTEs.
ENTRIES = f"""
lines as (
  select doc_id, lang, source, cast(i - 1 as bigint) as line_no, string_split(text, chr(10))[i] as line
  from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)
),
u as (select *, source || '.' || lang as catalog_id, doc_id * 31 + line_no * 7 as h, line as base from lines),
e as (
  select catalog_id, lang, row_number() over (partition by catalog_id order by doc_id, line_no) as seq, h, base,
    case when doc_id % 17 = 1 then cast(doc_id % 4 as varchar) when doc_id % 3 = 0 then 'ctx' || cast(doc_id % 2 as varchar) else '' end as msgctxt,
    case when h % 101 = 0 then '' when h % 97 = 5 then cast(h % 50 as varchar)
         when h % 97 = 6 then cast(h % 50 as varchar) || chr(10) when line_no % 5 = 1 then base || ' %d'
         when line_no % 5 = 2 then '<b>' || base || '</b> {{name}}' else base end as msgid,
    case when h % 8 = 0 then 'fuzzy' when h % 8 = 1 then 'c-format, fuzzy' when h % 8 = 2 then 'c-format'
         when h % 8 = 3 then ' Fuzzy ' when h % 8 = 4 then 'fuzzy-ish' when h % 8 = 5 then '' end as flag,
    case when h % 9 = 0 then 'ai-translated' when h % 9 = 1 then 'TODO' || chr(10) || 'ai-translated'
         when h % 9 = 2 then 'note' when h % 9 = 3 then '' end as translator,
    case when starts_with(catalog_id, 'src19.') then list_value('t:' || base)
         when h % 11 = 0 then null when h % 7 = 0 then cast([] as varchar[]) when h % 13 = 5 then list_value(chr(133))
         when h % 13 = 6 then list_value(base || ' ' || chr(133)) when h % 7 = 1 then list_value('')
         when h % 7 = 2 then list_value(chr(9) || chr(160)) when h % 7 = 3 then list_value('', 'x')
         else list_value('t:' || base) end as msgstr
  from u
),
f as (select *, case when h % 6 = 0 then msgid || ' (pl)' end as msgid_plural from e),
-- a key keeps its first place and its last content; a context is where its first line is
ky as (select catalog_id, msgctxt, msgid, min(seq) as place, max(seq) as latest from f group by all),
cx as (select catalog_id, msgctxt, min(seq) as ctx_first from f group by all),
d as (
  select f.* replace (ky.place as seq), cx.ctx_first, {int_key('f.msgctxt')} as ctx_int, {int_key('f.msgid')} as id_int
  from ky join f on f.catalog_id = ky.catalog_id and f.seq = ky.latest
  join cx on cx.catalog_id = f.catalog_id and cx.msgctxt = f.msgctxt
),
st as (select *, {untrans('msgstr')} as untranslated, {fuzzy('flag')} as fuzzy from d where msgid <> '')
"""


# position in the parser's iteration order inside a catalog
PORDER = "ctx_int is null, ctx_int, ctx_first, id_int is null, id_int, seq"
ORDER_NO = f"cast(row_number() over (partition by catalog_id order by {PORDER}) as bigint) as order_no"


def worklist_cte(include_fuzzy: bool | str) -> str:
    """``include_fuzzy``: job-wide flag, or a SQL condition (per-catalog options)."""
    if isinstance(include_fuzzy, str):
        cond = include_fuzzy
    else:
        cond = "untranslated or fuzzy" if include_fuzzy else "untranslated"
    return f"""
w as (
  select *,
    case when msgid_plural is not null
         then (case when fuzzy and not untranslated then cast([] as varchar[]) else msgstr end)
         else (case when fuzzy and not untranslated then cast([] as varchar[]) end) end as req_msgstr
  from st where {cond}
)"""


def numbered_cte(include_fuzzy: bool | str = False, order: str = PORDER) -> str:
    return (
        worklist_cte(include_fuzzy)
        + f""",
nb as (
  select *, item_no, cast(floor((item_no - 1) / 15) + 1 as bigint) as batch_no, cast((item_no - 1) % 15 as bigint) as pos
  from (select *, cast(row_number() over (partition by catalog_id order by {order}) as bigint) as item_no from w) z
)"""
    )


def with_entries(*ctes: str) -> str:
    parts = [ENTRIES.strip()] + [c.strip() for c in ctes]
    return "with " + ",\n".join(parts) + "\n"


# ------------------------------------------------------------------------------ queries

oracle(
    "dedupe_keys",
    with_entries()
    + """
select catalog_id, seq, msgctxt, msgid, msgid_plural, flag, translator,
  array_to_string(msgstr, chr(31)) as msgstr_text, cast(coalesce(len(msgstr), -1) as bigint) as n_forms
from d""",
)

oracle("skip_header", with_entries() + "select catalog_id, seq, msgctxt, msgid from d where msgid <> ''")

oracle("is_untranslated", with_entries() + "select catalog_id, seq, untranslated from st")

oracle("is_fuzzy", with_entries() + "select catalog_id, seq, fuzzy from st")

oracle(
    "js_trim",
    with_entries()
    + f"""
select catalog_id, seq, 'msgstr' as field, cast(k - 1 as bigint) as k, {jtrim('msgstr[k]')} as trimmed
from (select *, unnest(range(1, len(msgstr) + 1)) as k from d where msgstr is not null) a
union all
select catalog_id, seq, 'flag' as field, cast(k - 1 as bigint) as k, {jtrim("string_split(flag, ',')[k]")} as trimmed
from (select *, unnest(range(1, len(string_split(flag, ',')) + 1)) as k from d where flag is not null) b""",
)

oracle(
    "untranslated_msgids",
    with_entries() + f"select catalog_id, {ORDER_NO}, seq, msgctxt, msgid from st where untranslated",
)

_WORK_SELECT = """
select catalog_id, seq, msgctxt, msgid, msgid_plural,
  cast(coalesce(len(req_msgstr), -1) as bigint) as req_n, array_to_string(req_msgstr, chr(31)) as req_text
from w"""

oracle("worklist", with_entries(worklist_cte(False)) + _WORK_SELECT)
oracle("worklist_include_fuzzy", with_entries(worklist_cte(True)) + _WORK_SELECT)

oracle(
    "request_shape",
    with_entries(worklist_cte(True))
    + """
select catalog_id, seq, msgid_plural is not null as is_plural, req_msgstr is not null as has_msgstr,
  cast(coalesce(len(req_msgstr), -1) as bigint) as req_n
from w""",
)

oracle("entry_keys", with_entries(worklist_cte(False)) + f"select catalog_id, {ORDER_NO}, seq, msgctxt as context, msgid from w")

oracle(
    "request_item",
    with_entries(worklist_cte(False))
    + """
select catalog_id, seq, case when msgid_plural is null then msgid end as item_msgid,
  msgid_plural as item_msgid_plural, msgctxt as item_msgctxt
from w""",
)

oracle(
    "nothing_to_do",
    with_entries(worklist_cte(False))
    + """
select catalog_id from (select distinct source || '.' || lang as catalog_id from documents) c
where catalog_id not in (select catalog_id from w)""",
)

oracle("parser_order", with_entries() + f"select catalog_id, seq, {ORDER_NO} from st")

oracle("dry_run", with_entries(worklist_cte(False)) + f"select catalog_id, {ORDER_NO}, seq, msgid from w")
oracle("dry_run_include_fuzzy", with_entries(worklist_cte(True)) + f"select catalog_id, {ORDER_NO}, seq, msgid from w")

oracle(
    "batch_number",
    with_entries(numbered_cte()) + "select catalog_id, seq, item_no, batch_no, pos from nb",
)

oracle(
    "batch_requests",
    with_entries(numbered_cte())
    + """
select catalog_id, batch_no, cast(count(*) as bigint) as n_items, arg_min(seq, pos) as first_seq, arg_max(seq, pos) as last_seq,
  string_agg(coalesce(msgid_plural, msgid), chr(31) order by pos) as items_text
from nb group by catalog_id, batch_no""",
)

oracle(
    "batch_summary",
    with_entries(numbered_cte())
    + """
, b as (select catalog_id, batch_no, cast(count(*) as bigint) as n_items from nb group by catalog_id, batch_no),
t as (select catalog_id, cast(ceil(sum(n_items) / 15) as bigint) as total_batches from b group by catalog_id)
select b.catalog_id, b.batch_no, t.total_batches, b.n_items,
  'Translating batch ' || b.batch_no || '/' || t.total_batches || ' (' || b.n_items || ' phrase'
  || case when b.n_items = 1 then '' else 's' end || ')...' as progress
from b join t using (catalog_id)""".replace("\n, b as", ", b as", 1),
)

oracle(
    "catalog_coverage",
    with_entries()
    + f"""
select catalog_id, count(*) as n_entries, cast(count_if(untranslated) as bigint) as n_untranslated,
  cast(count_if(fuzzy) as bigint) as n_fuzzy, cast(count_if(untranslated) as bigint) as n_selected,
  cast(count_if({marker('translator')}) as bigint) as n_machine, cast(count_if(msgid_plural is not null) as bigint) as n_plural
from st group by catalog_id""",
)
