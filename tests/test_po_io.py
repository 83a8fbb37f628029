from pyspark.sql import functions as F

from potable.operators import batching
from potable.operators import select as sel
from potable.sinks.po_compile import catalog_blocks, pieces, write_catalogs
from potable.sources.po_text import po_scan, po_scan_obsolete

PO = r'''msgid ""
msgstr ""
"Language: uk\n"
"Plural-Forms: nplurals=3; plural=(n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2);\n"
"Content-Type: text/plain; charset=UTF-8\n"

# TODO: review
#, fuzzy, c-format
msgctxt "auth"
msgid ""
"Hello \\n %s"
"second \"part\""
msgstr "Привіт"

#~ msgid "Old"
#~ msgstr "Старе"

msgid "%d item"
msgid_plural "%d items"
msgstr[0] ""
msgstr[1] ""
msgid "Next"
msgstr ""
'''


def _scan(spark, folder):
    ents, cats = po_scan(spark, str(folder))
    return {(r["msgctxt"], r["msgid"]): r for r in ents.collect()}, cats.collect()


def test_scan_fixture(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "uk.po").write_text(PO, encoding="utf-8")
    ents, cats = _scan(spark, d)
    assert len(ents) == 4
    hello = ents[("auth", 'Hello \\n %ssecond "part"')]
    assert hello["flag"] == "fuzzy, c-format" and hello["translator"] == "TODO: review"
    assert hello["msgstr"] == ["Привіт"] and hello["catalog_id"] == "uk"
    assert ents[("", "%d item")]["msgstr"] == ["", ""] and ents[("", "%d item")]["msgid_plural"] == "%d items"
    assert ents[("", "Next")]["msgstr"] == [""]
    assert cats[0]["target_language"] == "uk"


def test_compile_round_trip(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "uk.po").write_text(PO, encoding="utf-8")
    ents, cats = po_scan(spark, str(d))
    out = tmp_path / "out"
    write_catalogs(catalog_blocks(ents, cats, obsolete=po_scan_obsolete(spark, str(d))), str(out))
    text = _read_all(out / "catalog_id=uk")
    assert "charset=utf-8" in text and text.startswith('msgid ""\nmsgstr ""\n"Language: uk\\n"')
    assert "\n\nmsgctxt \"auth\"" not in text  # comments come before msgctxt
    # obsolete entries are never parsed but carried through, last, as written
    assert text.rstrip("\n").endswith('#~ msgid "Old"\n#~ msgstr "Старе"')
    again, _ = _scan(spark, out)
    first, _ = _scan(spark, d)
    # the header differs only by the charset, which the sink writes in lower case
    strip = lambda m: {k: (v["msgid_plural"], v["msgstr"], v["flag"], v["translator"]) for k, v in m.items() if k != ("", "")}
    assert strip(again) == strip(first)
    assert again[("", "")]["msgstr"][0] == first[("", "")]["msgstr"][0].replace("UTF-8", "utf-8")


def _read_all(folder):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))


def test_hot_catalog_written_as_ordered_parts(spark, tmp_path):
    rows = [("hot", i, "", f"m{i:05d}", None, [""], None, None) for i in range(1, 3001)]
    rows += [("cold", 1, "", "x", None, [""], None, None)]
    ents = spark.createDataFrame(rows, "catalog_id string, seq long, msgctxt string, msgid string, msgid_plural string, msgstr array<string>, flag string, translator string")
    cats = spark.createDataFrame([("hot",), ("cold",)], "catalog_id string").withColumn(
        "headers", F.create_map(F.lit("Language"), F.lit("uk")))
    out = tmp_path / "out"
    write_catalogs(catalog_blocks(ents, cats), str(out), num_parts=8)
    parts = sorted((out / "catalog_id=hot").glob("part-*"))
    assert len(parts) > 1
    back, back_cats = po_scan(spark, str(out))
    got = [r["msgid"] for r in back.where("catalog_id = 'hot' and msgid <> ''").orderBy("seq").collect()]
    assert got == [f"m{i:05d}" for i in range(1, 3001)]
    assert {r["catalog_id"]: r["target_language"] for r in back_cats.collect()} == {"hot": "uk", "cold": "uk"}


def test_fold(spark, tmp_path):
    # the 76th character falls inside "upstairs", so the cut is behind "goes"
    long = "Every second lamp in the corridor stays dark until the night porter goes upstairs and turns the old brass key twice."
    ents = spark.createDataFrame([("c", 1, "", long, None, [""], None, None)],
                                 "catalog_id string, seq long, msgctxt string, msgid string, msgid_plural string, msgstr array<string>, flag string, translator string")
    cats = spark.createDataFrame([("c",)], "catalog_id string").withColumn("headers", F.create_map())
    flat = " ".join(r["text"] for r in catalog_blocks(ents, cats).collect())
    assert f'msgid "{long}"' in flat
    folded = " ".join(r["text"] for r in catalog_blocks(ents, cats, fold_length=76).collect())
    assert 'msgid ""\n"Every second lamp in the corridor stays dark until the night porter goes "' in folded
    values = [("a\nb",), ("x" * 200,), ("one " * 40,), ("\\" * 100,), ('a"b ' + "\t" * 60,), ("  " * 60 + "end",), ("",), (None,), ("\n\n",), ("a" * 76 + " b",)]
    for value, lines in spark.createDataFrame(values, "v string").select("v", pieces(F.col("v"), 76)).collect():
        assert all(0 < len(x) <= 76 for x in lines)
        plain = "".join(lines).replace("\\\\", "\0").replace('\\"', '"').replace("\\n", "\n").replace("\\t", "\t").replace("\0", "\\")
        assert plain == (value or "")
        assert all(x.endswith("\\n") == (i < (value or "").count("\n")) for i, x in enumerate(lines)) or "\n" not in (value or "")
        # greedy: no line could have taken the first word of the next
        assert all(len(x) + len(y.split(" ")[0]) + 1 > 76 or x.endswith("\\n") for x, y in zip(lines, lines[1:]))
    plural = spark.createDataFrame([("c", 1, "", "one", "many", [long, "x"], None, None)],
                                   "catalog_id string, seq long, msgctxt string, msgid string, msgid_plural string, msgstr array<string>, flag string, translator string")
    ptext = " ".join(r["text"] for r in catalog_blocks(plural, cats, fold_length=76).collect())
    assert 'msgstr[0] ""\n"Every second lamp in the corridor stays dark until the night porter goes "' in ptext
    assert 'msgstr[1] "x"' in ptext


def test_repeated_flag_lines_are_newline_joined(spark, tmp_path):
    # T6: '#, a' twice reaches the entry newline-joined, so 'fuzzy' on a second
    # line is not seen by the comma split
    d = tmp_path / "in"
    d.mkdir()
    (d / "x.po").write_text('#, c-format\n#, fuzzy\nmsgid "A"\nmsgstr "B"\n', encoding="utf-8")
    from potable.functions.text import is_fuzzy

    ents, _ = po_scan(spark, str(d))
    row = ents.select("flag", is_fuzzy("flag").alias("z")).first()
    assert row["flag"] == "c-format\nfuzzy" and row["z"] is False


def test_split_read_is_the_same_for_any_chunk(spark, tmp_path):
    from potable.sources.po_text import assemble_entries, classify_line_rows, read_po_lines

    d = tmp_path / "in"
    d.mkdir()
    (d / "uk.po").write_text(PO, encoding="utf-8")
    (d / "de.po").write_text('#, c-format\n#, fuzzy\nmsgid "A"\nmsgstr "B"\nmsgid "C"\nmsgstr ""\n"D"\n', encoding="utf-8")

    def key(df):
        return sorted(
            (r["catalog_id"], r["entry_no"], r["msgctxt"], r["msgid"], r["msgid_plural"], tuple(r["msgstr"] or []), r["flag"], r["translator"])
            for r in df.collect()
        )

    found = [key(assemble_entries(classify_line_rows(read_po_lines(spark, str(d), chunk_lines=c)), str(d))) for c in (100_000, 1, 2, 3)]
    assert [(r[0], r[3]) for r in found[0] if r[0] == "de"] == [("de", "A"), ("de", "C")]
    assert found[1:] == [found[0]] * 3


REAL = """# Copyright holders
#, fuzzy
msgid ""
msgstr "Language: de\\n"

msgid "D"
msgstr ""

#, fuzzy
#~ msgid "Old"
#~ msgstr "Alt"

msgid "Next"
msgstr "Weiter"
msgid"a\u2028b"
msgstr ""
"x\u0085y"
#~ msgid "Gone"
#~ msgstr "Weg"
msgid "D"
msgstr "done"
"""


def test_files_as_merge_tools_write_them(spark, tmp_path):
    d = tmp_path / "in"
    for lang in ("de", "fr"):
        (d / lang / "LC_MESSAGES").mkdir(parents=True)
        (d / lang / "LC_MESSAGES" / "app.po").write_text(REAL, encoding="utf-8")
    ents, cats = po_scan(spark, str(d))
    rows = {(r["catalog_id"], r["msgid"]): r for r in ents.collect()}
    assert {c for c, _ in rows} == {"de/LC_MESSAGES/app", "fr/LC_MESSAGES/app"} and cats.count() == 2
    one = {m: r for (c, m), r in rows.items() if c.startswith("de")}
    # the flag belongs to the obsolete block; the last of equal keys wins, in place; separators stay inside strings
    assert set(one) == {"", "D", "Next", "a\u2028b"}
    assert one["Next"]["flag"] is None and one["D"]["msgstr"] == ["done"] and one["a\u2028b"]["msgstr"] == ["x\u0085y"]
    gone = [r["line"] for r in po_scan_obsolete(spark, str(d)).where("catalog_id like 'de%'").orderBy("line_no").collect()]
    assert gone == ["#, fuzzy", '#~ msgid "Old"', '#~ msgstr "Alt"', '#~ msgid "Gone"', '#~ msgstr "Weg"']
    text = catalog_blocks(ents, cats).where("catalog_id like 'de%' and h = 0").first()["text"]
    assert text.startswith("# Copyright holders\n#, fuzzy\nmsgid")


def test_overwritten_keys_keep_their_place(spark, tmp_path):
    # a key met again takes the later content, where the key first stood
    d = tmp_path / "in"
    d.mkdir()
    entry = 'msgid "{}"\nmsgstr "{}"\n'
    (d / "x.po").write_text(entry.format("a", "old") + entry.format("b", "") + entry.format("a", ""), encoding="utf-8")
    ents, _ = po_scan(spark, str(d))
    listed = sel.dry_run(sel.worklist(ents)).orderBy("order_no").collect()
    assert [r["msgid"] for r in listed] == ["a", "b"]


def test_overwritten_keys_across_batch_borders(spark, tmp_path):
    # contexts: "late" is first seen on an entry that a later one overwrites
    d = tmp_path / "in"
    d.mkdir()
    blocks = [("late", "k0", "done")] + [("", f"m{i}", "") for i in range(31)] + [("", "7", "")]
    blocks += [("", f"m{i}", "x" if i == 3 else "") for i in range(20, 0, -1)]  # again, backwards; m3 is done now
    blocks += [("late", "k1", ""), ("late", "k0", "")]
    text = "\n".join((f'msgctxt "{c}"\n' if c else "") + f'msgid "{m}"\nmsgstr "{s}"\n' for c, m, s in blocks)
    (d / "x.po").write_text(text, encoding="utf-8")
    ents, _ = po_scan(spark, str(d))
    reqs = batching.batch_requests(batching.number_batches(sel.worklist(ents))).orderBy("batch_no").collect()
    seen: dict = {}  # what a map of maps that keeps insertion order holds
    for c, m, s in blocks:
        seen.setdefault(c, {})[m] = s
    ordered = [(c, m) for c, of in seen.items() for m in sorted(of, key=lambda m: (m != "7")) if of[m] == ""]
    got = [(i["msgctxt"], i["msgid"]) for r in reqs for i in r["items"]]
    assert got == ordered and [r["n_items"] for r in reqs] == [15, 15, len(ordered) - 30]


BROKEN = [
    'msgid "a"', 'msgstr "A"', "",
    'msgid "broken', 'msgstr "must not reach a"', "",  # no end quote
    "# why", 'msgid "b"', 'msgstr ""', '"one "', '"two', '"three"', "",  # a continuation without its end
    'msgid "c"', 'msgstr "C"', "what is this?", "",
    'msgid "quo"te"', 'msgstr ""', "",
    'msgid "d"', 'msgstr "D\\\\"', "",  # escaped backslash: closed
    'msgid "e"', 'msgstr "E\\"', "",  # escaped quote: open
    'msgctxt "only"', 'msgstr "x"', "",
    'msgid "f"', 'msgid_plural "fs"', 'msgid_plural "ff"', 'msgstr[0] ""', "",
    'msgid "g"', 'msgid "h"', 'msgstr "H"', "  ", "\t",
    "#~ msgid \"old\"", "#~ msgstr \"alt\"", "",
    "# a comment", '"behind it"', "",
    'msgstr[x] "no"', "",
    'msgid "i"', 'msgstr "I"', "# the end",
]


def test_faulty_entries_are_rejected_whole_and_no_line_is_lost(spark, tmp_path):
    from potable.sources.po_text import classify_line_rows, line_accounts, po_scan_rejects, read_po_lines, rejected_lines

    d = tmp_path / "in"
    d.mkdir()
    (d / "x.po").write_text("\n".join(BROKEN), encoding="utf-8")
    (d / "bom.po").write_text('﻿msgid "k"\nmsgstr "K"\n', encoding="utf-8")
    (d / "junk.po").write_text('<html>\n"lost"\n\nmsgid "l"\nmsgstr "L"\n', encoding="utf-8")
    (d / "blank.po").write_text("\n\n", encoding="utf-8")
    ents, _ = po_scan(spark, str(d))
    got = {(r["catalog_id"], r["msgid"]): r["msgstr"] for r in ents.collect()}
    assert got == {
        ("x", "a"): ["A"], ("x", "d"): ["D\\"], ("x", "g"): None, ("x", "h"): ["H"], ("x", "i"): ["I"],
        ("bom", "k"): ["K"], ("junk", "l"): ["L"],
    }
    rejects = po_scan_rejects(spark, str(d)).orderBy("path", "line_no").collect()
    reasons: dict = {}
    for r in rejects:
        reasons.setdefault((r["catalog_id"], r["entry_no"], r["reason"]), []).append(r["line_no"])
    assert sorted((c, why, lines) for (c, _, why), lines in reasons.items()) == sorted([
        ("x", "unterminated string", [4, 5]), ("x", "unterminated string", [7, 8, 9, 10, 11, 12]), ("x", "unknown line", [14, 15, 16]),
        ("x", "unterminated string", [18, 19]), ("x", "unterminated string", [24, 25]), ("x", "entry without msgid", [27, 28]),
        ("x", "keyword twice", [30, 31, 32, 33]), ("x", "string without keyword", [43, 44, 46]),
        ("junk", "unknown line", [1]), ("junk", "string without keyword", [2]),
    ])
    assert all(BROKEN[r["line_no"] - 1] == r["line"] for r in rejects if r["catalog_id"] == "x")
    for chunk in (100_000, 1, 3):
        placed = read_po_lines(spark, str(d), chunk)
        lines = classify_line_rows(placed)
        accounts = {r["path"].rsplit("/", 1)[-1]: r for r in line_accounts(placed, lines).collect()}
        for r in accounts.values():
            assert r["n_lines"] == r["n_blank"] + r["n_entry_lines"] + r["n_opaque"] + r["n_rejected"]
        assert accounts["x.po"]["n_lines"] == len(BROKEN) and accounts["x.po"]["n_opaque"] == 3 and accounts["blank.po"]["n_blank"] == 2
        assert rejected_lines(lines, str(d)).count() == len(rejects)


def test_large_file_read_in_many_splits(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    body = "".join(f'msgid "m{i}"\nmsgstr ""\n"x{i}"\n\n' for i in range(4000))
    (d / "x.po").write_text(body, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        ents, _ = po_scan(spark, str(d))
        got = [(r["msgid"], r["msgstr"], r["seq"]) for r in ents.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(f"m{i}", [f"x{i}"], i + 1) for i in range(4000)]


def test_files_with_faults_and_fold_lengths(spark, tmp_path):
    from potable.plans.translate import Options, translate_files
    from potable.providers.live import live_provider

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    head = 'msgid ""\nmsgstr "Language: {}\\n"\n\n'
    long = "word " * 30
    (src / "good.po").write_text(head.format("uk") + f'msgid "{long}"\nmsgstr ""\n\n# last words\n', encoding="utf-8")
    (src / "flat.po").write_text(head.format("uk") + f'msgid "{long}"\nmsgstr ""\n', encoding="utf-8")
    (src / "bad.po").write_text(head.format("uk") + 'msgid "x"\nmsgstr ""\n\nmsgid "y\nmsgstr ""\n', encoding="utf-8")

    def call(model, system, payload):
        import json

        asked = json.loads(payload)["translations"]
        return 200, None, None, json.dumps({"translations": [{**a, "msgstr": "так " * 30} for a in asked]})

    options = spark.createDataFrame(
        [(c, "en", None, False, False, n, None, False) for c, n in (("good", 40), ("flat", None), ("bad", 40))],
        "catalog_id string, source_lang string, model string, include_fuzzy boolean, add_fuzzy boolean, fold_length int, context string, debug boolean",
    )
    tables = translate_files(spark, str(src), str(out), live_provider(call), Options(per_catalog=True), options=options)
    # nothing of the file with a fault is sent or written
    assert {r["catalog_id"] for r in tables["requests"].collect()} == {"good", "flat"}
    assert sorted(p.name for p in out.iterdir() if p.is_dir()) == ["catalog_id=flat", "catalog_id=good"]
    assert [(r["catalog_id"], r["line_no"], r["reason"]) for r in tables["rejects"].orderBy("line_no").collect()] == [
        ("bad", 7, "unterminated string"), ("bad", 8, "unterminated string")]
    good, flat = _read_all(out / "catalog_id=good"), _read_all(out / "catalog_id=flat")
    assert max(len(line) for line in good.splitlines()) <= 42 and good.rstrip().endswith("# last words")
    assert f'msgid "{long}"' in flat and "так так" in flat


def test_lines_are_shuffled_once_and_texts_written_once(spark, tmp_path):
    from potable.sources.po_text import classify_line_rows, line_parts, opaque_lines, read_po_lines

    d = tmp_path / "in"
    d.mkdir()
    old = "".join(f'#~ msgid "o{i}"\n#~ msgstr ""\n' for i in range(1300))
    (d / "x.po").write_text("".join(f'msgid "m{i}"\nmsgstr "x{i}"\n\n' for i in range(9)) + 'msgid "bad\nmsgstr ""\n\n' + old, encoding="utf-8")
    for chunk in (100_000, 700):
        parts = line_parts(classify_line_rows(read_po_lines(spark, str(d), chunk)))
        assert parts._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
        rows = parts.collect()
        # an entry's texts are its fields or its lines, and no row holds more than 1000 obsolete lines
        assert all((r["entry"] is None) != (r["rows"] is None) for r in rows) and sum(r["entry"] is not None for r in rows) >= 8
        assert max(r["n_lines"] for r in rows) <= 1000 and sum(r["n_lines"] for r in rows) == 18 + 2 + 2600
        gone = [r["line"] for r in opaque_lines(parts, str(d)).orderBy("line_no").collect()]
        assert gone == old.splitlines()
