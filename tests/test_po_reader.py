import re
import uuid

import pytest

from potable.sources import po_text
from potable.sources.po_reader import JS_WS, numbered_parts, read_parts, split_table
from tests.test_po_io import BROKEN, PO, REAL


def _both(spark, folder):
    """Entries, opaque lines and rejects of a folder: by windows over lines, and as the reader gives them."""
    slow = po_text.line_parts(po_text.classify_line_rows(po_text.read_po_lines(spark, folder)))
    read = read_parts(po_text._raw_lines(spark, folder)).localCheckpoint()
    fast = numbered_parts(read, split_table(read))

    def rows(parts):
        entries = po_text.assemble_entries(parts, folder)
        found = [po_text.opaque_lines(parts, folder), po_text.rejected_lines(parts, folder)]
        return [sorted(map(repr, (dict(r.asDict()) for r in df.collect()))) for df in (entries, *found)]

    return rows(slow), rows(fast)


def test_js_whitespace_is_the_same_set():
    from potable.functions.text import JS_WS_CLASS

    assert {c for c in map(chr, range(0x10000)) if re.fullmatch(JS_WS_CLASS, c)} == set(JS_WS)


@pytest.mark.parametrize("split", [40, 150, 1 << 20])
def test_reader_gives_what_windows_over_lines_give(spark, tmp_path, split):
    d = tmp_path / "in"
    d.mkdir()
    odd = [
        "  #: a.c:1", "#. why ", "#| msgid \"was\"", "#,fuzzy", '\tmsgid "tab"', ' msgid "nbsp"', 'msgid_plural "p"', 'msgstr[1] "b"',
        '"b2"', 'msgstr[0] "a"', 'msgstr[01] "c"', 'msgstr[99999999999999] "d"', "",
        'msgid "one"', 'msgid_plural "x"', 'msgstr "s"', 'msgstr[2] "t\\\\n\\t\\""', "", 'msgidx "no"', 'msgstr[a] "no"', " ", "\x0b",
        'msgctxt "c"', 'msgctxt "d"', 'msgid "e"', 'msgstr "E" ', '#~ msgid "o"', '"cont of an obsolete"', 'msgid "f"', '# in between', 'msgstr "F"',
        'msgid ""', '"m1 "', '', '"m2"', 'msgstr', '"open', 'msgid "g"', 'msgid "h"', 'msgstr "', 'msgstr ""',
    ]
    files = {"uk": PO, "real": REAL, "broken": "\n".join(BROKEN), "odd": "\n".join(odd), "junk": '<html>\n"lost"\n"too"\n\nmsgid "l"\nmsgstr "L"\n',
             "blank": "\n\n", "bom": '﻿msgid "k"\r\nmsgstr "K"\r\n', "notes": "# one\n# two\n", "long": 'msgid ""\n' + '"abc "\n' * 60 + 'msgstr "x"\n'}
    for name, text in files.items():
        (d / f"{name}.po").write_text(text, encoding="utf-8", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        slow, fast = _both(spark, str(d))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [len(x) for x in slow] == [len(x) for x in fast] and len(slow[0]) > 15 and len(slow[2]) > 30
    assert slow == fast


def test_obsolete_blocks_and_other_bytes(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    gone = "".join(f'#~ msgid "o{i}"\n' for i in range(2500))
    (d / "x.po").write_bytes(b'msgid "a"\nmsgstr "caf\xe9"\n\n# \xff why\nmsgid "b"\nmsgstr ""\n\nmsgid "c"\nmsgstr ""\n# of the old\n' + gone.encode())
    read = read_parts(po_text._raw_lines(spark, str(d))).localCheckpoint()
    parts = numbered_parts(read, split_table(read))
    assert parts.agg({"n_lines": "max"}).first()[0] <= 1001
    assert [r["line"] for r in po_text.opaque_lines(parts, str(d)).orderBy("line_no").collect()] == ["# of the old", *gone.splitlines()]
    told = po_text.assemble_entries(parts, str(d)).selectExpr("msgid", "hex(msgstr[0]) as s", "hex(translator) as t").orderBy("msgid").collect()
    assert [tuple(r) for r in told] == [("a", "636166E9", None), ("b", "", "FF20776879"), ("c", "", None)]


def test_job_in_shards_keeps_nothing_it_only_read(spark, tmp_path, monkeypatch):
    """Tables, files and requests are the whole job's; scratch tables are gone, and the files may be compressed."""
    from pyspark.sql import functions as F

    from potable.operators.numbering import scratch
    from potable.plans import translate
    from potable.providers.recorded import recorded_provider

    src = tmp_path / "in"
    src.mkdir()
    head = 'msgid ""\nmsgstr "Language: uk\\n"\n\n'
    for c in range(9):
        entries = "".join(f'msgid "m{c}-{i}"\nmsgstr ""\n\n' for i in range(40))
        (src / f"src{c}.uk.po").write_text(head + entries + ('msgid "bad\n' if c == 4 else '#~ msgid "old"\n'), encoding="utf-8")
    ents, cats = po_text.po_scan(spark, str(src))
    log = translate.service_log(translate.request_rows(ents, cats))
    base = translate.run_folder(spark, "")
    files, sent = [], []
    for n, codec in ((1, None), (3, "gzip")):
        monkeypatch.setattr(translate, "shard_count", lambda spark, path, n=n: n)
        out, run_id, before = tmp_path / f"out{n}", f"shards-{uuid.uuid4().hex}", set(_names(base))
        with scratch(spark):
            tables = translate.translate_files(
                spark, str(src), str(out), recorded_provider(log), run_id=run_id, codec=codec, keep_merged=False)
            assert "merged" not in tables
            sent.append([sorted(tuple(r) for r in tables[name].select(*cols).collect()) for name, cols in (
                ("requests", ["catalog_id", "batch_no", "n_items"]), ("attempts", ["catalog_id", "batch_no", "attempt", "error_code"]),
                ("results", ["catalog_id", "msgid"]), ("outcomes", ["catalog_id", "batch_no", "committed"]), ("rejects", ["catalog_id", "line"]))])
        assert set(_names(base)) - before == {f"run-{run_id}"}
        names = [p.name for p in out.glob("*/part-*")]
        assert (out / "_SUCCESS").exists() and names and all(x.endswith(".gz") == bool(codec) for x in names)
        back, _ = po_text.po_scan(spark, str(out))
        files.append(sorted(tuple(r) for r in back.select("catalog_id", "seq", "msgid", F.array_join("msgstr", "|"), "translator").collect()))
        opaque = po_text.po_scan_obsolete(spark, str(out))
        assert sorted(r["catalog_id"] for r in opaque.collect()) == [f"src{c}.uk" for c in range(9) if c != 4]
    assert files[0] == files[1] and len(files[0]) == 8 * 41 and sent[0] == sent[1] and sent[0][2]


def _names(base):
    import os

    base = base.removeprefix("file:")
    return [x for x in os.listdir("/" + base.lstrip("/")) if not x.startswith(".")]
