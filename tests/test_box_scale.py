"""Boxes are written, listed and read mail by mail: what a worker holds doesn't follow the size of a box."""

import os

import pandas as pd
import pyarrow as pa
import pytest

from kindred.sources import boxes, mail, tables
from tests.mails import box, contents, make


def test_mh_box_is_listed_once_for_all_adds(tmp_path, monkeypatch):
    """scan_mh: adding a mail doesn't list the box anew."""
    b, seen = boxes.open_box(tmp_path / "mh", "mh", create=True), []
    listdir, scandir, iterkeys = os.listdir, os.scandir, boxes.CLASSES["mh"].iterkeys
    monkeypatch.setattr(os, "listdir", lambda *a: seen.append(a) or listdir(*a))
    monkeypatch.setattr(os, "scandir", lambda *a: seen.append(a) or scandir(*a))
    monkeypatch.setattr(boxes.CLASSES["mh"], "iterkeys", lambda self: seen.append(self) or iterkeys(self))
    assert [b.add(make(message_id=f"<{i}@x>")) for i in range(50)] == [*range(1, 51)]
    assert len(seen) <= 3
    monkeypatch.undo()
    (tmp_path / "mh" / "51").write_bytes(make(message_id="<other@x>"))  # another writer's
    assert b.add(make(message_id="<51@x>")) == 52
    with pytest.raises(TypeError):
        b.add(object())
    assert sorted(b.keys()) == [*range(1, 53)] and b.get_message(52)["Message-Id"] == "<51@x>"
    assert boxes.open_box(tmp_path / "mh", "mh").add(make()) == 53


def test_rows_to_write_come_one_by_one():
    """scan_maildir, scan_babyl: a task that writes boxes asks for a batch when the one before is written."""
    asked = []

    def batches():
        for i in range(3):
            asked.append(i)
            yield pa.RecordBatch.from_pydict({"box": ["a", "b"], "doc_id": [i, i], "text": ["x", "y"]})

    rows = tables._mails(batches())
    assert next(rows) == ("a", 0, "x") and asked == [0]
    assert [*rows][-1] == ("b", 2, "y") and asked == [0, 1, 2]


@pytest.mark.parametrize("kind", ["mbox", "mmdf", "babyl", "maildir", "mh", "eml"])
def test_long_mails_go_on_in_small_batches(tmp_path, kind):
    """scan_mbox, scan_mmdf: parsed mails don't wait for the whole batch of their listing."""
    mails = [make("w" * 500_000 + f"\n{i}", message_id=f"<{i}@x>") for i in range(20)]
    path = box(tmp_path / "b", kind, mails)
    listing = pd.DataFrame([*boxes.listing(path, kind)], columns=mail.LISTED)
    out = [*mail.parsed(iter([listing, listing.head(0), listing.head(1)]))]
    assert [len(x) for x in out] == [8, 8, 4, 1]
    whole = pd.concat(out[:3], ignore_index=True)
    assert whole.mail_id.tolist() == listing.mail_id.tolist() and whole.parse_error.isna().all()
    assert sorted(int(lines[-1]) for lines in whole.body_lines) == [*range(20)]


@pytest.mark.parametrize("kind", ["mbox", "mh", "maildir"])
def test_tables_become_whole_boxes(spark, kind):
    rows = spark.range(0, 300, 1, 7).selectExpr("concat('src', id % 3) box", "id doc_id", "concat('text ', id) text")
    paths = sorted(tables.boxes_from_table(rows, kind))
    assert [os.path.basename(p) for p in paths] == ["src0", "src1", "src2"]
    for k, p in enumerate(paths):
        found = contents(p, kind)
        assert sorted(found) == sorted(x for x in found if x.endswith(f"text {x[1:].split('@')[0]}")) and len(found) == 100
        assert {int(x[1:].split("@")[0]) % 3 for x in found} == {k}
