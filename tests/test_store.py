"""The store: what a write touches, readers beside writers, erasure; threads made anew in part."""

import random
import threading
from pathlib import Path

import pytest

from postloom.operators import filters, threads
from postloom.functions.text import html_text
from postloom.sources import mail
from postloom.store import ReadOnlyError, Store

ROW = "message_id string, subject string, body_text string"


def parts(root, name):
    return {str(p.relative_to(root)) for p in Path(root).glob(f"{name}/d-*/*/*.parquet")}


def test_appends_add_files_and_merges_touch_their_buckets(rows, spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=8)
    s.append("messages", rows([(f"m{i}", "s", "b") for i in range(40)], ROW))
    before = parts(tmp_path, "messages")
    s.append("messages", rows([("n1", "s", "b")], ROW))
    assert before < parts(tmp_path, "messages") and s.read("messages").count() == 41
    number, listed = s._current("messages")
    s.merge("messages", rows([("m3", "new", "b")], ROW), ["message_id"])
    after = s._current("messages")
    assert after[0] == number + 1 and len({b for d, b in after[1]} - {b for d, b in listed}) == 0
    assert len([p for p in after[1] if p not in listed]) == 1  # one bucket was written
    assert {r["subject"] for r in s.read("messages").filter("message_id = 'm3'").collect()} == {"new"} and s.read("messages").count() == 41
    s.compact("messages", most=1)
    assert s.read("messages").count() == 41 and len(s._current("messages")[1]) <= 8
    # NULL keys, no rows, extra columns
    s.merge("messages", rows([(None, "x", "y", 1)], ROW + ", more int"), ["message_id"])
    s.merge("messages", rows([(None, "x", "y", 1)], ROW + ", more int"), ["message_id"])
    assert s.read("messages").filter("message_id is null").count() == 2
    s.append("messages", rows([], ROW))
    assert s.read("messages").count() == 43 and s.read("facts").count() == 0


def test_a_reader_beside_writers_sees_whole_tables_and_no_write_is_lost(rows, spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=2)
    s.append("messages", rows([("a", "s", "b")], ROW))
    seen, stop, failed = [], threading.Event(), []

    def read():
        while not stop.is_set():
            seen.append(Store(spark, str(tmp_path), readonly=True)._current("messages"))

    def write(k):
        try:
            for i in range(4):
                Store(spark, str(tmp_path)).append("messages", rows([(f"{k}{i}", "s", "b")], ROW))
        except Exception as x:  # noqa: BLE001
            failed.append(x)

    reader = threading.Thread(target=read)
    writers = [threading.Thread(target=write, args=(k,)) for k in "xy"]
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    stop.set()
    reader.join()
    assert not failed and s.read("messages").count() == 9
    assert all(p for _, p in seen) and [n for n, _ in seen] == sorted(n for n, _ in seen)


def test_erased_rows_leave_no_file(rows, spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=2)
    s.append("messages", rows([("a", "s", "secret words"), ("b", "s", "other")], ROW))
    s.append("messages", rows([("c", "s", "third")], ROW))
    s.merge("messages", rows([("a", "s", "")], ROW), ["message_id"], erase=True)
    assert s.read("messages").count() == 3
    assert not any("secret words" in str(r) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "messages")).collect())
    with pytest.raises(ReadOnlyError):
        Store(spark, str(tmp_path), readonly=True).append("messages", rows([], ROW))


def test_threads_made_anew_in_part_equal_all(rows):
    rnd = random.Random(5)
    schema = "message_id string, subject string, sent_at string, in_reply_to string, references_json string"
    data = [(f"m{i}", rnd.choice(["Re: a", "", "", "A", f"t{i}", f"u{i}"]), f"2024-01-{i:02d}", f"m{rnd.randrange(30)}" if rnd.random() < 0.2 else None, f'["m{rnd.randrange(30)}","gone{rnd.randrange(9)}"]' if rnd.random() < 0.1 else None) for i in range(1, 28)]
    old, all_ = rows(data[:22], schema), rows(data, schema)
    touched = threads.affected(all_, rows([(x[0],) for x in data[22:]], "message_id string"))
    some = {r[0] for r in touched.collect()}
    assert {x[0] for x in data[22:]} <= some and len(some) < 27
    get = lambda df: {r["message_id"]: r["thread_id"] for r in threads.assign(df).collect()}
    part = get(all_.join(touched, "message_id", "left_semi"))
    assert get(all_) == {k: v for k, v in get(old).items() if k not in some} | part


def test_sources_keep_path_order_and_read_nothing_too_large(spark, tmp_path, monkeypatch):
    (tmp_path / "b.eml").write_bytes(b"Message-ID: <1@x>\nSubject: late\n\nx\n")
    (tmp_path / "a.eml").write_bytes(b"Message-ID: <1@x>\nSubject: early\n\nx\n")
    monkeypatch.setattr(mail, "OVERSIZE", 60)
    (tmp_path / "c.eml").write_bytes(b"Message-ID: <2@x>\nSubject: large\n\n" + b"y" * 100)
    got = mail.parsed(mail.folder(spark, str(tmp_path))).orderBy("ord").collect()
    assert [r["subject"] for r in got] == ["early", "late", None] and got[2]["error"] == "oversize" and got[2]["content"] is None
    assert mail.single(spark, str(tmp_path / "a.eml")).count() == 1


def test_html_breaks_and_names_in_any_case(rows):
    df = rows([("a<br clear='all'>b< / p >c&AMP;d&Lt;e&amp;lt;",), (None,), ("",)], "h string").select(html_text("h").alias("t"))
    assert [r["t"] for r in df.collect()] == ["a\nb\nc&d<e&lt;", None, ""]


def test_exposed_columns():
    assert "blob_hash" in filters.EXPOSED["messages"] and "in_reply_to" not in filters.EXPOSED["messages"]
