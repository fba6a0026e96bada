"""Six formats from end to end: listing, deduplication, and every action, for real and dry."""

import mailbox
import os
from pathlib import Path

import pytest

from kindred import schema
from kindred.config import ACTIONS, BOX_FORMATS, FOLDER_FORMATS, Config
from kindred.operators import sinks
from kindred.plans.dedup import Dedup, hash_only
from kindred.sources import boxes, mail

from .mails import box, contents, make

A, B, C = make("one", message_id="<a@x>"), make("two", message_id="<b@x>"), make("three", message_id="<c@x>")


def run(spark, sources, **options):
    d = Dedup(spark, Config(**options))
    for s in sources:
        d.add_source(s)
    d.config.check(True)
    d.build_sets()
    d.act()
    d.check_stats()
    return d, d.stats().first().asDict()


@pytest.mark.parametrize("kind", BOX_FORMATS)
def test_formats(spark, tmp_path, kind):
    path = box(tmp_path / "in", kind, [A, A, B, C])
    d, s = run(spark, [path], input_format=kind, strategies=("select-one",), action="copy-selected", export=str(tmp_path / "out"), export_format=kind)
    assert (s["mail_found"], s["mail_hashes"], s["mail_unique"], s["mail_selected"], s["mail_copied"]) == (4, 3, 2, 1, 3)
    assert len(contents(tmp_path / "out", kind)) == 3
    assert contents(tmp_path / "out", kind) == sorted(set(contents(path, kind)))
    d, s = run(spark, [path], input_format=kind, strategies=("select-one",), action="delete-discarded")
    assert s["mail_deleted"] == 1 and len(contents(path, kind)) == 3


@pytest.mark.parametrize("dry", [True, False])
@pytest.mark.parametrize("action", ACTIONS)
def test_actions(spark, tmp_path, action, dry):
    path = box(tmp_path / "in", "maildir", [A, A, A, B])
    before = contents(path, "maildir")
    export = {"export": str(tmp_path / "out")} if action.split("-")[0] in ("copy", "move") else {}
    d, s = run(spark, [path], strategies=("select-one",), action=action, dry_run=dry, **export)
    n = 2 if action.endswith("discarded") else 2
    done = {"copy": "mail_copied", "move": "mail_moved", "delete": "mail_deleted", "hardlink": "mail_hardlinked"}[action.split("-")[0]]
    assert s[done] == n
    if dry:
        assert contents(path, "maildir") == before and not (tmp_path / "out").exists()
    elif action.startswith(("move", "delete")):
        assert len(contents(path, "maildir")) == 2
    if action.startswith("hardlink") and not dry:
        inodes = {os.stat(p).st_ino for p in Path(path, "new").iterdir()}
        assert len(inodes) == 2 and len(contents(path, "maildir")) == 4
        again, s = run(spark, [path], strategies=("select-one",), action=action)
        assert s["mail_hardlink_skipped"] == 2 and again.done["reasons"] == {"the mail shares the copy's file already": 2}
    elif export and not dry:
        assert len(contents(tmp_path / "out", "mbox")) == 2
        with pytest.raises(FileExistsError):
            run(spark, [path], strategies=("select-one",), action=action, **export)


def test_hardlink_refusals(spark, tmp_path):
    first, second = make("same", X_Any="1"), make("same", X_Any="2")
    path = box(tmp_path / "in", "maildir", [first, second])
    d, s = run(spark, [path], strategies=("select-one",), action="hardlink-discarded")
    assert s["mail_hardlinked"] == 0 and d.done["reasons"] == {"the mail differs from the copy": 1}
    d, s = run(spark, [path], strategies=("select-one",), action="hardlink-discarded", hardlink_differing=True)
    assert s["mail_hardlinked"] == 1 and d.done["bytes"] > 0
    packed = box(tmp_path / "box", "mbox", [A, A])
    d, s = run(spark, [packed], strategies=("select-one",), action="hardlink-discarded")
    assert s["mail_hardlink_skipped"] == 1 and "no file of their own" in next(iter(d.done["reasons"]))
    assert sinks.look(str(tmp_path / "gone"), str(tmp_path / "gone2"), True)[3] == "No such file or directory"


def test_time_family(spark, tmp_path):
    dates = [f"2024-01-15T10:0{m}:00" for m in (3, 2, 1, 0) for _ in range(2)]
    left = {"select-older": 2, "select-oldest": 6, "select-newer": 2, "select-newest": 6, "discard-newest": 2, "discard-older": 6}
    for i, (name, n) in enumerate(left.items()):
        path = box(tmp_path / f"b{i}", "maildir", [make(date=d) for d in dates])
        run(spark, [path], strategies=(name,), action="delete-selected")
        assert len(contents(path, "maildir")) == n


def test_undated_rejected_and_line_ends(spark, tmp_path):
    path = box(tmp_path / "a", "mbox", [make(date=None), make(date=None)])
    _, s = run(spark, [path], strategies=("select-newest",), action="delete-discarded")
    assert s["set_skipped_timestamp"] == 1
    path = box(tmp_path / "b", "eml", [b"Subject: lonely\n\nx\n", A, A.replace(b"\n", b"\r\n")])
    d, s = run(spark, [path], strategies=("select-one",), action="delete-discarded")
    assert s["mail_rejected"] == 1 and s["set_deduplicated"] == 1
    assert [r.rejection for r in d.decided.filter("rejection is not null").collect()] == ["1 headers found out of 10."]
    _, s = run(spark, [box(tmp_path / "c", "eml", [A, A])], action="delete-selected", dry_run=True)
    assert s["set_skipped_strategy"] == 1


def test_body_modes_and_ctime(spark, tmp_path):
    path = box(tmp_path / "a", "eml", [make("a b"), make("ab"), make("a b")])
    for mode, n in (("skip", 1), ("raw", 2), ("normalized", 1)):
        _, s = run(spark, [path], hash_body=mode, action="delete-selected", dry_run=True)
        assert s["mail_hashes"] == n
    for i, f in enumerate(sorted(Path(path).iterdir())):
        os.utime(f, (1, 1))
    d, s = run(spark, [path], time_source="ctime", strategies=("select-newest", "select-one"), action="delete-discarded", dry_run=True)
    assert s["set_deduplicated"] == 1 and all(r.timestamp > 1e9 for r in d.decided.collect())


def test_two_sources_meet(spark, tmp_path):
    one = box(tmp_path / "one", "mbox", [A, B, C])
    two = box(tmp_path / "two", "maildir", [A, B, make("four", message_id="<d@x>"), make("five", message_id="<e@x>")])
    _, s = run(spark, [one, two], strategies=("select-one",), action="copy-selected", export=str(tmp_path / "out"))
    assert s["mail_found"] == 7 and s["mail_hashes"] == 5 and s["mail_copied"] == 5
    assert len(contents(tmp_path / "out", "mbox")) == 5
    found = {r.source_path: r["count"] for r in mail.list_mails(spark, [one, two]).groupBy("source_path").count().collect()}
    assert found == {one: 3, two: 4}
    with pytest.raises(ValueError):
        d = Dedup(spark, Config())
        d.add_source(one)
        d.add_source(one)


def test_detection_and_nesting(tmp_path):
    for name in ("INBOX", "Archive", "Dev/GitHub"):
        (tmp_path / "all" / name).parent.mkdir(parents=True, exist_ok=True)
        box(tmp_path / "all" / name, "maildir", [A])
    got = boxes.plan([str(tmp_path / "all")])
    assert [Path(p).name for p, _ in got] == ["Archive", "GitHub", "INBOX"] and {k for _, k in got} == {"maildir"}
    root = box(tmp_path / "root", "maildir", [A])
    mailbox.Maildir(root).add_folder("Old")
    box(tmp_path / "root" / "Sub", "maildir", [B])
    assert [Path(p).name for p, _ in boxes.plan([root])] == ["root", ".Old", "Sub"]
    tree = tmp_path / "tree"
    (tree / "deep").mkdir(parents=True)
    (tree / ".hidden").mkdir()
    for name in ("b.eml", "deep/A.EML", ".x.eml", ".hidden/c.eml", "note.txt"):
        (tree / name).write_bytes(A)
    assert [r[1] for r in boxes.listing(str(tree), "eml")] == ["b.eml", "deep/A.EML"]
    assert boxes.detect(tree) == "eml" and boxes.detect(tree / "b.eml") == "mbox"
    (tmp_path / "void").mkdir()
    for bad in (tmp_path / "void", tmp_path / "nowhere"):
        with pytest.raises(ValueError):
            boxes.detect(bad)
    assert [p for p, _ in boxes.plan([str(tmp_path / "all"), str(tmp_path / "all" / "INBOX")])].count(str(tmp_path / "all" / "INBOX")) == 1


def test_locks(tmp_path):
    path = box(tmp_path / "b", "mbox", [A])
    Path(f"{path}.lock").write_text("")
    with pytest.raises(mailbox.ExternalClashError):
        sinks.lock(boxes.open_box(path, "mbox"), False)
    held = boxes.open_box(path, "mbox")
    sinks.lock(held, True)
    held.unlock()
    held.close()


def test_views(spark, tmp_path):
    d, _ = run(spark, [box(tmp_path / "b", "eml", [A, A, B])], strategies=("select-one",), action="delete-discarded", dry_run=True)
    d.views()
    got = spark.sql("select s.n, d.decision from duplicate_sets s join decisions d using (mail_hash) join mails m using (source_path, mail_id) order by 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, "unique"), (2, "discarded"), (2, "selected")]


def test_hashes_only(spark, tmp_path):
    path = box(tmp_path / "b", "eml", [A, A, B])
    rows = hash_only(spark, [path], Config(hash_only=True)).collect()
    assert len(rows) == 3 and len({r.header_hash for r in rows}) == 2 and len(rows[0].header_hash) == 56
    assert [h.id for h in rows[0].canonical_headers][:4] == ["date", "from", "to", "subject"]


def test_vanished_file_is_a_rejection(spark, tmp_path):
    path = box(tmp_path / "b", "eml", [A, B])
    listed = mail.list_mails(spark, [path]).cache()
    listed.count()
    next(Path(path).iterdir()).unlink()
    errors = [r.parse_error for r in mail.parse(listed).collect()]
    assert sorted(e or "" for e in errors)[1].startswith("unreadable file") and len(FOLDER_FORMATS) == 3


def test_maildir_flags_survive_a_copy(spark, tmp_path):
    m = mailbox.MaildirMessage(A)
    m.set_subdir("cur")
    m.set_flags("FS")
    b = mailbox.Maildir(str(tmp_path / "in"))
    b.add(m)
    run(spark, [str(tmp_path / "in")], action="copy-selected", export=str(tmp_path / "out"), export_format="maildir")
    assert [x.get_flags() for x in mailbox.Maildir(str(tmp_path / "out"), create=False)] == ["FS"]


def test_a_deletion_that_runs_again_deletes_nothing_more(spark, tmp_path):
    """A task that is retried after it is done finds the note that says so; a box that changed is left alone."""
    path = tmp_path / "box"
    box = mailbox.mbox(str(path))
    for i in range(4):
        box.add(f"Subject: {i}\n\nbody {i}\n")
    box.close()
    listed = mail.list_mails(spark, [path]).filter("mail_id in ('0', '2')").collect()
    rows = spark.createDataFrame(listed, schema.LISTING)
    subjects = lambda: [m["Subject"] for m in mailbox.mbox(str(path))]
    notes = []
    unlink = sinks.os.unlink
    try:
        sinks.os.unlink = lambda p: notes.append(p) if sinks.NOTE_PREFIX in str(p) else unlink(p)
        assert sinks.delete(rows) == 2 and subjects() == ["1", "3"]
        assert sinks.delete(rows) == 2 and subjects() == ["1", "3"]
    finally:
        sinks.os.unlink = unlink
    unlink(notes[0])
    with pytest.raises(Exception, match="has changed since it was listed"):
        sinks.delete(rows)
    assert subjects() == ["1", "3"]
