"""Scan gettext PO files into the entries and catalogs tables.

A multi-file scan job: files are read in splits, and every line is classified where it
is read and written once, with its place: split, and running number in the task that
read the split. Chunks of lines within a split are counted; prefix sums over these
counts give line numbers, and windows inside a chunk carry the current keyword onto
continuation lines and number the entries: a new entry starts whenever a line belongs
to an earlier section than the line before it (comments < msgctxt < msgid <
msgid_plural < msgstr), so entries that follow without a blank line are still split.
Entries are then assembled from their lines, a handful each, where the chunk's lines
are (``line_parts``): lines are shuffled once. Only the first and last entry of a chunk
may go on in another one, and only their parts are put together by a second grouping.
An entry's place in its catalog comes from the written entries by counts per chunk.

No line falls out: each is blank, or belongs to an entry, to opaque text (obsolete
``#~`` blocks with their comments, comments without an entry) or to the rejects. An
entry with a faulty line is rejected whole, with the reason of its first fault, so
its strings never reach a neighbour. Of equal keys in one catalog the last entry
wins, at the place of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from potable.functions.text import js_trim
from potable.operators.locale import parse_headers, with_language_fields
from potable.operators.numbering import materialize, n_bytes
from potable.operators.spread import spread_join
from potable.sources.fixture import dedupe_keys
from potable.sources.po_reader import numbered_parts, read_parts, split_table

_SENTINEL = "\u0000"


def unescape(col: Column) -> Column:
    """PO string body -> text: ``\\\\`` first (via a sentinel), then ``\\"``, ``\\n``, ``\\t``, ``\\r``.

    Literal replaces, and only for bodies that contain a backslash at all."""
    s = F.replace(col, F.lit("\\\\"), F.lit(_SENTINEL))
    s = F.replace(s, F.lit('\\"'), F.lit('"'))
    s = F.replace(s, F.lit("\\n"), F.lit("\n"))
    s = F.replace(s, F.lit("\\t"), F.lit("\t"))
    s = F.replace(s, F.lit("\\r"), F.lit("\r"))
    s = F.replace(s, F.lit(_SENTINEL), F.lit("\\"))
    return F.when(F.instr(col, "\\") > 0, s).otherwise(col)


_KW = r'(?s)\A(msgctxt|msgid_plural|msgid|msgstr(?:\[[0-9]+\])?)[ \t]*"(.*)"[ \t]*\z'
_CONT = r'(?s)\A"(.*)"[ \t]*\z'
_KW_NAME = r"\A(msgctxt|msgid_plural|msgid|msgstr)(?![A-Za-z0-9_])"
_RANK = {"comment": 0, "msgctxt": 1, "msgid": 2, "msgid_plural": 3, "msgstr": 4, "obsolete": 5}

#: reasons for which an entry is rejected
UNTERMINATED, UNKNOWN = "unterminated string", "unknown line"
NO_KEYWORD, NO_MSGID, TWICE = "string without keyword", "entry without msgid", "keyword twice"


def catalog_id_of(path: Column, root: str) -> Column:
    """``.../catalog_id=X/...`` (partitioned writes), or the file's path below ``root``
    without ``.po`` or ``.po.gz`` (``de/LC_MESSAGES/app``); the file stem where ``root`` is the file."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    part = F.regexp_extract(plain, "catalog_id=([^/]+)", 1)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    at = F.instr(plain, base)
    below = F.when(at > 0, F.substring(plain, at + len(base), 1 << 30)).otherwise(F.substring_index(plain, "/", -1))
    return F.when(part != "", part).otherwise(F.regexp_replace(below, r"\.po(\.gz)?\z", ""))


CHUNK_LINES = 100_000


def read_po_lines(spark: SparkSession, path: str, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Placed lines of every file under ``path``, read in splits: one large file is
    spread over many tasks."""
    return place_lines(_raw_lines(spark, path), chunk_lines)


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.col("value").alias("line"),
    )


def _closed(body: Column) -> Column:
    """Whether a string's body has no bare quote, and no backslash that escapes its end."""
    rest = F.replace(F.replace(body, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    return ~rest.contains('"') & ~rest.endswith("\\")


def place_lines(raw: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(path, __block, line) rows straight from a text scan -> a written table of all lines
    with their place (block, chunk, at), kind, keyword and fault, each text once.

    ``at`` is taken before any shuffle, so it counts the lines of a split in their
    order; chunks are cut by it. Regexes only run on the lines they apply to.
    """
    x = raw.withColumn("at", F.monotonically_increasing_id()).withColumn("lead", _lead(F.col("line")))
    lead = F.col("lead")
    x = x.withColumn("__kw", F.when(lead.startswith("msg"), F.regexp_extract("lead", _KW, 1))).withColumn(
        "__name", F.when(lead.startswith("msg"), F.regexp_extract("lead", _KW_NAME, 1))
    )
    kind = (
        F.when(lead.startswith("#~"), F.lit("obsolete"))
        .when(lead.startswith("#"), F.lit("comment"))
        .when(F.coalesce(F.col("__name"), F.lit("")) != "", F.lit("keyword"))
        .when(lead.startswith('"'), F.lit("cont"))
        .when(js_trim("lead") == "", F.lit("blank"))
        .otherwise(F.lit("unknown"))
    )
    piece = F.when(F.col("kind") == "keyword", F.regexp_extract("lead", _KW, 2)).otherwise(F.regexp_extract("lead", _CONT, 1))
    whole = F.when(F.col("kind") == "keyword", F.col("__kw") != "").otherwise(lead.rlike(_CONT))
    is_string = F.col("kind").isin("keyword", "cont")
    placed = (
        x.withColumn("kind", kind)
        .withColumn("kw_here", F.when(F.col("kind") == "keyword", F.coalesce(F.nullif("__kw", F.lit("")), F.col("__name"))).when(
            F.col("kind").isin("comment", "obsolete"), F.col("kind")))
        .withColumn("fault", F.when(is_string & ~(whole & _closed(piece)), F.lit(UNTERMINATED)).when(
            F.col("kind") == "unknown", F.lit(UNKNOWN)))
    )
    return materialize(
        placed.select(
            "path", F.col("__block").alias("block"), F.floor(F.col("at") / chunk_lines).cast("bigint").alias("chunk"), "at",
            "kind", "kw_here", "fault", "line",
        ),
        "po-lines", "zstd",
    )


def _lead(line: Column) -> Column:
    """A line from its first character that is neither blank nor a byte order mark."""
    return F.regexp_replace(line, "^\\ufeff?[ \\t]+|^\\ufeff", "")


def _piece() -> Column:
    """The string on a keyword or continuation line without fault: all between its first and last quote."""
    start = F.instr("line", '"')
    text = F.rtrim(F.col("line"), F.lit(" \t"))
    return F.when(F.col("kind").isin("keyword", "cont") & F.col("fault").isNull(), F.substring(text, start + 1, F.length(text) - start - 1))


def _rank_of(kw: Column) -> Column:
    section = F.when(kw.startswith("msgstr"), F.lit("msgstr")).otherwise(kw)
    return F.coalesce(*[F.when(section == k, F.lit(v)) for k, v in _RANK.items()])


CHUNK = ["path", "block", "chunk"]


def classify_line_rows(placed: DataFrame) -> DataFrame:
    """One row per line that is not blank, with line and entry number, keyword in force and fault.

    Every window is bounded: it runs inside a chunk, and what a chunk inherits (lines
    before it, the last keyword, the entries started before it) comes from prefix sums
    over one row per chunk; these are written, so that lines needn't be shuffled to them.
    ``open`` marks the lines of entries that may have lines in another chunk too."""
    per_chunk = placed.groupBy(*CHUNK).agg(
        F.count(F.lit(1)).alias("__lines"), F.min("at").alias("__first"),
        F.max_by(F.col("kw_here"), F.when(F.col("kw_here").isNotNull(), F.col("at"))).alias("__last_kw"),
    )
    earlier = Window.partitionBy("path").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *CHUNK, "__first", F.coalesce(F.sum("__lines").over(earlier), F.lit(0)).alias("__lines_before"),
        F.last("__last_kw", ignorenulls=True).over(earlier).alias("__carry_kw"),
    )
    w = Window.partitionBy(*CHUNK).orderBy("at")
    sig = placed.where(F.col("kind") != "blank").join(materialize(carry, "po-chunks"), on=CHUNK, how="inner")
    sig = sig.withColumn(
        "kw",
        F.coalesce(F.last("kw_here", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("__carry_kw")),
    ).withColumn("rank", _rank_of(F.col("kw")))
    prev = F.coalesce(F.lag("rank").over(w), _rank_of(F.col("__carry_kw")))
    keyword = F.col("kind") == "keyword"
    # an obsolete block takes the comments before it, but never a live entry's lines;
    # a msgid or msgctxt never goes on in an entry that has one
    again = keyword & (((F.col("kw") == "msgid") & (prev >= 2)) | ((F.col("kw") == "msgctxt") & (prev >= 1)))
    fresh = prev.isNull() | (F.col("rank") < prev) | ((F.col("kind") == "obsolete") & prev.between(1, 4)) | again
    sig = sig.withColumn("__start", F.when(F.coalesce(fresh, F.lit(False)), 1).otherwise(0))
    starts = sig.groupBy(*CHUNK).agg(F.sum("__start").alias("__n"))
    before = starts.select(*CHUNK, "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    sig = sig.join(materialize(before, "po-starts"), on=CHUNK, how="inner").withColumn(
        "entry_no", F.col("__before") + F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    loose = (F.col("kind") == "cont") & F.coalesce(F.col("kw").isin("comment", "obsolete"), F.lit(True))
    return sig.select(
        *CHUNK, (F.col("__lines_before") + F.col("at") - F.col("__first")).alias("line_no"), "entry_no", "kind", "kw",
        F.coalesce("fault", F.when(loose, F.lit(NO_KEYWORD))).alias("fault"), "line",
        ((F.col("entry_no") == F.col("__before")) | (F.col("entry_no") == F.col("__before") + F.col("__n"))).alias("open"),
    )


#: lines of an obsolete block that are kept in one row
OBSOLETE_LINES = 1000


def _group_fault() -> Column:
    """Why a group (``first``, ``kws``, ``strings``) is rejected, or null."""
    return F.coalesce(
        F.col("first.fault"), F.when(F.size(F.array_distinct("kws")) < F.size("kws"), F.lit(TWICE)),
        F.when(F.col("strings") & ~F.array_contains("kws", "msgid"), F.lit(NO_MSGID)),
    )


def line_parts(lines: DataFrame, hashed: bool = False) -> DataFrame:
    """Classified lines -> one row per entry and chunk: (path, entry_no, open, n_lines, entry), and where ``entry`` is null, what
    decides about the group (``kws``, ``first``, ``strings``) with its lines (``rows``).

    ``entry`` is there for entries without fault that lie in one chunk. An obsolete block is
    cut into rows of ``OBSOLETE_LINES``. ``hashed`` adds the lines' hash, ``content``.
    The grouping keeps to the chunks, in which the lines are already: nothing is shuffled.
    """
    row = F.struct("line_no", "kind", "kw", "fault", "line", _piece().alias("v"))
    slice_no = F.when(F.col("kw") == "obsolete", F.floor(F.col("line_no") / OBSOLETE_LINES) + 1).otherwise(F.lit(0))
    content = [F.bit_xor(F.xxhash64("line_no", "line")).alias("content")] if hashed else []
    g = lines.groupBy(*CHUNK, "entry_no", slice_no.alias("slice")).agg(
        F.first("open").alias("open"), F.sort_array(F.collect_list(row)).alias("rows"), *content
    )
    faulty = F.filter("rows", lambda r: r["fault"].isNotNull())
    g = g.select(
        "path", "entry_no", (F.col("open") | (F.col("slice") > 0)).alias("open"),
        F.size("rows").cast("bigint").alias("n_lines"), "rows",
        F.transform(F.filter("rows", lambda r: r["kind"] == "keyword"), lambda r: r["kw"]).alias("kws"),
        F.when(F.size(faulty) > 0, F.struct(faulty[0]["line_no"].alias("line_no"), faulty[0]["fault"].alias("fault"))).alias("first"),
        F.exists("rows", lambda r: r["kind"].isin("keyword", "cont")).alias("strings"), *([c for c in ["content"] if hashed]),
    )
    whole = ~F.col("open") & F.array_contains("kws", "msgid") & _group_fault().isNull()
    g = g.withColumn("entry", F.when(whole, entry_of(F.col("rows"))))
    rest = F.col("entry").isNull()
    slim = F.transform("rows", lambda r: F.struct(r["line_no"], r["kind"], r["kw"], r["line"], r["v"]))
    return g.select(
        "path", "entry_no", "open", "n_lines", "entry", *[F.when(rest, F.col(c)).alias(c) for c in ("kws", "first", "strings")],
        F.when(rest, slim).alias("rows"), *([c for c in ["content"] if hashed]),
    )


def _parts(lines: DataFrame) -> DataFrame:
    return lines if "rows" in lines.columns else line_parts(lines)


def _judged(parts: DataFrame) -> DataFrame:
    """Rows of ``line_parts`` without ``entry``, each with its whole group's ``fault`` and ``has_msgid``."""
    rest = parts.where("entry is null")
    named = [_group_fault().alias("fault"), F.array_contains("kws", "msgid").alias("has_msgid")]
    closed = rest.where("not open").select("path", "entry_no", "open", "n_lines", "rows", *named)
    opened = rest.where("open")
    groups = opened.groupBy("path", "entry_no").agg(
        F.flatten(F.collect_list("kws")).alias("kws"), F.min("first").alias("first"), F.bool_or("strings").alias("strings")
    ).select("path", "entry_no", *named)
    return closed.unionByName(
        opened.join(groups, ["path", "entry_no"]).select("path", "entry_no", "open", "n_lines", "rows", "fault", "has_msgid")
    )


def line_groups(lines: DataFrame) -> DataFrame:
    """(path, entry_no, fault, has_msgid) of every group of classified lines."""
    parts = _parts(lines)
    good = parts.where("entry is not null").select("path", "entry_no", F.lit(None).cast("string").alias("fault"), F.lit(True).alias("has_msgid"))
    return good.unionByName(_judged(parts).select("path", "entry_no", "fault", "has_msgid").distinct())


def _joined(rows: Column, cond, value, sep: str) -> Column:
    parts = F.filter(rows, cond)
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, value), sep))


def entry_of(rows: Column) -> Column:
    """The entry that a group's lines, in their order, give: fields as a struct."""

    def strings(kw: str) -> Column:
        return _joined(rows, lambda r: r["kind"].isin("keyword", "cont") & (r["kw"] == kw), lambda r: r["v"], "")

    def comments(ctype: str) -> Column:
        def of(r: Column) -> Column:
            return (r["kind"] == "comment") & (F.substring(_lead(r["line"]), 1, 2) == ctype)

        return _joined(rows, of, lambda r: js_trim(F.substring(_lead(r["line"]), F.lit(3), F.length(r["line"]))), "\n")

    # translator comments: '#' not followed by one of the typed markers
    translator = _joined(
        rows, lambda r: (r["kind"] == "comment") & ~F.substring(_lead(r["line"]), 1, 2).isin("#,", "#:", "#.", "#|"),
        lambda r: js_trim(F.substring(_lead(r["line"]), F.lit(2), F.length(r["line"]))), "\n",
    )
    said = F.filter(rows, lambda r: r["kind"].isin("keyword", "cont") & r["kw"].startswith("msgstr"))
    forms = F.array_sort(F.transform(said, lambda r: F.struct(
        F.coalesce(F.regexp_extract(r["kw"], r"\[([0-9]+)\]", 1).try_cast("int"), F.lit(0)).alias("k"),
        r["line_no"].alias("line_no"), r["v"].alias("v"),
    )))
    # msgstr[k] pieces: join the pieces of each form, forms in k order
    per_form = F.aggregate(
        forms,
        F.array().cast("array<struct<k:int,v:string>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["k"] == x["k"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(x["k"].alias("k"), F.concat(F.element_at(acc, -1)["v"], x["v"]).alias("v"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["k"].alias("k"), x["v"].alias("v"))))),
    )
    one = F.array(unescape(strings("msgstr")))
    single = F.forall(said, lambda r: r["kw"] == "msgstr")
    noted = F.exists(rows, lambda r: r["kind"] == "comment")
    other = F.array(*[
        F.struct(F.lit(name).alias("key"), F.when(noted, comments(ctype)).alias("value"))
        for name, ctype in (("reference", "#:"), ("extracted", "#."), ("previous", "#|"))
    ])
    return F.struct(
        F.coalesce(unescape(strings("msgctxt")), F.lit("")).alias("msgctxt"),
        unescape(strings("msgid")).alias("msgid"),
        unescape(strings("msgid_plural")).alias("msgid_plural"),
        F.when(F.size(said) > 0, F.when(single, one).otherwise(F.transform(per_form, lambda f: unescape(f["v"])))).alias("msgstr"),
        F.when(noted, comments("#,")).alias("flag"),
        F.when(noted, translator).alias("translator"),
        F.map_from_entries(F.filter(other, lambda e: e["value"].isNotNull())).alias("other_comments"),
    )


def assemble_entries(lines: DataFrame, root: str) -> DataFrame:
    """Entries of classified lines or their parts (``entry_no`` = number within the file).
    Opaque and rejected groups give no entry."""
    parts = _parts(lines)
    whole = parts.where("entry is not null").select("path", "entry_no", "entry")
    cut = _judged(parts).where("open and fault is null and has_msgid").groupBy("path", "entry_no").agg(
        F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows")
    ).select("path", "entry_no", entry_of(F.col("rows")).alias("entry"))
    return whole.unionByName(cut).select(
        catalog_id_of(F.col("path"), root).alias("catalog_id"), "path", F.col("entry_no").cast("bigint").alias("entry_no"), "entry.*"
    )


#: wide shuffles of a job on many files go in up to so many shards of catalogs, of about so many bytes at least
SHARDS, SHARD_BYTES = 8, 48 << 20


def shard_count(spark: SparkSession, path: str) -> int:
    return max(1, min(SHARDS, n_bytes(spark, path) // SHARD_BYTES))


def catalog_shard(shards: int) -> Column:
    """Number of the shard that a row's catalog is in."""
    return F.pmod(F.xxhash64("catalog_id"), F.lit(shards)).cast("int")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_parts`` of every file under ``path``, written once for all that is made of them.
    Entries are assembled in the tasks that read the lines (``po_reader``)."""
    read = materialize(read_parts(_raw_lines(spark, path)), "po-parts", "zstd")
    return numbered_parts(read, materialize(split_table(read), "po-splits"))


def _lines_of(judged: DataFrame, root: str) -> DataFrame:
    return judged.withColumn("catalog_id", catalog_id_of(F.col("path"), root)).withColumn("r", F.explode("rows"))


def opaque_lines(lines: DataFrame, root: str) -> DataFrame:
    """``#~`` lines, the comments that belong to them and comments without an entry
    (catalog_id, path, line_no, line): the sink carries them to the end of the catalog."""
    which = _judged(_parts(lines)).where("fault is null and not has_msgid")
    return _lines_of(which, root).select("catalog_id", "path", F.col("r.line_no").alias("line_no"), F.col("r.line").alias("line"))


def rejected_lines(lines: DataFrame, root: str) -> DataFrame:
    """All lines of rejected entries: catalog_id, path, entry_no, line_no (from 1), reason
    (of the entry's first fault) and line."""
    which = _judged(_parts(lines)).where("fault is not null")
    return _lines_of(which, root).select(
        "catalog_id", "path", "entry_no", (F.col("r.line_no") + 1).alias("line_no"), F.col("fault").alias("reason"),
        F.col("r.line").alias("line"),
    )


def line_accounts(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """Per file: all lines, and how many are blank, in entries, opaque and rejected (they add up)."""
    parts = _parts(lines)
    good = parts.where("entry is not null").select("path", "n_lines", F.lit(None).cast("string").alias("fault"), F.lit(True).alias("has_msgid"))
    of = good.unionByName(_judged(parts).select("path", "n_lines", "fault", "has_msgid"))
    n, fault = F.col("n_lines"), F.col("fault")
    kinds = of.groupBy("path").agg(
        F.sum(F.when(fault.isNull() & F.col("has_msgid"), n)).alias("n_entry_lines"),
        F.sum(F.when(fault.isNull() & ~F.col("has_msgid"), n)).alias("n_opaque"),
        F.sum(F.when(fault.isNotNull(), n)).alias("n_rejected"),
    )
    read = placed.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("kind") == "blank").alias("n_blank"))
    zero = {c: 0 for c in ("n_entry_lines", "n_opaque", "n_rejected")}
    return read.join(kinds, "path", "left").fillna(zero)


def po_scan_obsolete(spark: SparkSession, path: str) -> DataFrame:
    return opaque_lines(scan_lines(spark, path), path)


def po_scan_rejects(spark: SparkSession, path: str) -> DataFrame:
    return rejected_lines(scan_lines(spark, path), path)


def file_order(entries: DataFrame) -> DataFrame:
    """``seq`` = number of the entry in its catalog, counted with what gave no entry: a catalog
    may be written as several ordered part files, so an entry's number in its file stands behind
    the numbers of the files before it, by (part number, file path). One row per file is ordered."""
    part = F.coalesce(F.regexp_extract("path", "/part-([0-9]+)[^/]*\\z", 1).try_cast("bigint"), F.lit(0))
    files = entries.groupBy("catalog_id", "path").agg(F.max("entry_no").alias("__n"))
    before = Window.partitionBy("catalog_id").orderBy(part, "path").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("path", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return entries.join(materialize(starts, "po-files"), "path").withColumn("seq", F.col("__start") + F.col("entry_no")).drop("__start")


def scanned_entries(lines: DataFrame, root: str) -> DataFrame:
    """Lines or their written parts -> entries as a keyed map gives them: the last of equal keys wins
    and stands where the first one stood; with the sort key of the parser's order."""
    ents = file_order(assemble_entries(lines, root))
    # a context is first seen on the first of some key, which keeps that place
    first = ents.groupBy("catalog_id", "msgctxt").agg(F.min("seq").alias("ctx_first"))
    return spread_join(dedupe_keys(ents), materialize(first, "po-contexts"), ["catalog_id", "msgctxt"], by=["seq"])


def scanned_catalogs(entries: DataFrame) -> DataFrame:
    """One row per catalog that has a header entry: its header map and language fields."""
    head = entries.where((F.col("msgctxt") == "") & (F.col("msgid") == "")).select(
        "catalog_id", F.coalesce(F.try_element_at("msgstr", F.lit(1)), F.lit("")).alias("header_text")
    )
    return with_language_fields(head.withColumn("headers", parse_headers("header_text")))


def po_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, catalogs) of every PO file under ``path``.

    Entries keep the header row (``msgid ''``); catalogs carry the parsed
    header map and language fields. What could not be read: ``po_scan_rejects``.
    """
    ents = scanned_entries(scan_lines(spark, path), path)
    return ents, scanned_catalogs(ents)
