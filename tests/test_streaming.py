import os
import time

import pytest
from pyspark.sql import functions as F

from potable.streaming import incremental
from potable.streaming.incremental import incremental_worklist, take_changes

HEAD = 'msgid ""\nmsgstr ""\n"Language: {}\\n"\n\n'


def _po(entries, lang="uk"):
    """(context, msgid, plural or None, text) entries as a file."""
    out = HEAD.format(lang)
    for context, msgid, plural, text in entries:
        out += f'msgctxt "{context}"\n' if context else ""
        out += f'msgid "{msgid}"\n' + (f'msgid_plural "{plural}"\nmsgstr[0] "{text}"\n\n' if plural else f'msgstr "{text}"\n\n')
    return out


class Folder:
    """Catalog files whose times never repeat."""

    def __init__(self, spark, root):
        self.spark, self.src, self.out, self.ckpt = spark, root / "in", str(root / "out"), str(root / "ckpt")
        self.src.mkdir()
        self.clock = time.time() - 1000

    def put(self, name, entries):
        path = self.src / f"{name}.po"
        path.write_text(_po(entries), encoding="utf-8")
        self.touch(name)

    def touch(self, name):
        self.clock += 1
        os.utime(self.src / f"{name}.po", (self.clock, self.clock))

    def run(self):
        incremental_worklist(self.spark, str(self.src), self.out, self.ckpt, shards=4)

    def requests(self):
        rows = self.spark.read.parquet(f"{self.out}/requests").collect()
        return sorted((r["catalog_id"], r["batch_no"], tuple((i["msgctxt"], i["msgid_plural"] or i["msgid"]) for i in r["items"])) for r in rows)

    def table(self, name):
        return self.spark.read.parquet(f"{self.out}/{name}")


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, tmp_path)


def _blank(*names):
    return [("", n, None, "") for n in names]


def test_new_and_edited_files_send_only_their_new_items(folder):
    names = [f"m{i}" for i in range(17)]
    folder.put("uk", _blank(*names) + [("", "done", None, "так")])
    folder.put("de", _blank("a"))
    folder.run()
    first = [("de", 1, (("", "a"),)), ("uk", 1, tuple(("", n) for n in names[:15])), ("uk", 2, (("", "m15"), ("", "m16")))]
    assert folder.requests() == first

    folder.run()  # nothing new
    assert folder.requests() == first

    # edited: entries in front, one filled in meanwhile, one with a new plural, one blank again
    folder.put("uk", _blank("zero") + [("", "m0", None, "є")] + _blank(*names[1:16]) + [("", "m16", "m16 many", ""), ("ctx", "m1", None, ""), ("", "done", None, "")])
    folder.put("fr", _blank("b"))
    folder.run()
    second = [("fr", 1, (("", "b"),)), ("uk", 3, (("", "zero"), ("", "m16 many"), ("", "done"), ("ctx", "m1")))]
    assert folder.requests() == sorted(first + second)

    folder.touch("de")  # same content: read again, nothing sent
    folder.put("uk", _blank("zero", "one more"))
    folder.run()
    assert folder.requests() == sorted(first + second + [("uk", 4, (("", "one more"),))])
    rows = folder.table("versions").orderBy("epoch").collect()
    assert [r["same"] for r in rows if r["catalog_id"] == "de"] == [False, True]
    assert not any(r["same"] for r in rows if r["catalog_id"] == "uk")


def test_catalogs_without_work_have_a_row(folder):
    folder.put("uk", [("", "done", None, "так")])
    folder.put("de", _blank("a"))
    folder.run()
    got = {r["catalog_id"]: (r["n_items"], r["n_batches"]) for r in folder.table("catalogs").collect()}
    assert got == {"uk": (0, 0), "de": (1, 1)}


def test_a_replayed_batch_doubles_nothing(spark, folder, monkeypatch):
    folder.put("uk", _blank("a", "b"))
    folder.run()
    folder.put("uk", _blank("a", "c"))
    broken = []

    def breaks_off(*of):
        take_changes(*of)  # all written, but the stream never hears of it
        broken.append(1)
        raise RuntimeError("the driver went down")

    monkeypatch.setattr(incremental, "take_changes", breaks_off)
    with pytest.raises(Exception):
        folder.run()
    monkeypatch.setattr(incremental, "take_changes", take_changes)
    folder.run()
    assert broken and folder.requests() == [("uk", 1, (("", "a"), ("", "b"))), ("uk", 2, (("", "c"),))]
    assert folder.table("sent").count() == 3
    assert folder.table("sent").groupBy("k1", "k2").count().where(F.col("count") > 1).count() == 0


def test_a_batch_that_broke_off_is_taken_again_and_a_lost_stream_does_no_harm(folder, monkeypatch):
    folder.put("uk", _blank("a"))
    monkeypatch.setattr(incremental, "classify_line_rows", None)  # breaks before anything is kept
    with pytest.raises(Exception):
        folder.run()
    monkeypatch.undo()
    folder.run()
    first = [("uk", 1, (("", "a"),))]
    assert folder.requests() == first
    folder.ckpt += "-new"  # a stream that remembers nothing reads all manifests again
    folder.put("uk", _blank("a", "b"))
    folder.run()
    assert folder.requests() == first + [("uk", 2, (("", "b"),))]
