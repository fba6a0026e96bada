import os
from pathlib import Path

import pytest

from kindred.config import Config
from kindred.functions import hashing
from kindred.operators.memo import Memo
from kindred.plans.dedup import Dedup
from kindred.sources import mail

from .mails import box, make


def hashes(spark, sources, cache, **more):
    d = Dedup(spark, Config(cache_path=str(cache), strategies=("select-newest", "select-one"), action="delete-discarded", dry_run=True, **more))
    for s in sources:
        d.add_source(s)
    opened = []
    parse = mail.parse
    try:
        mail.parse = lambda df, body=True: opened.append(df.count()) or parse(df, body)
        keys = sorted((r.mail_id, r.mail_hash, r.timestamp, r.size) for r in d.hash_all().filter("rejection is null").collect())
    finally:
        mail.parse = parse
    return keys, opened[0], d


@pytest.mark.parametrize("kind", ["maildir", "eml", "mbox"])
def test_warm_is_cold(spark, tmp_path, kind):
    path = box(tmp_path / "b", kind, [make(message_id=i) for i in ("<a>", "<a>", "<b>")])
    cold, n, _ = hashes(spark, [path], tmp_path / "memo", input_format=kind)
    warm, m, d = hashes(spark, [path], tmp_path / "memo", input_format=kind)
    plain, _, _ = hashes(spark, [path], tmp_path / "other", input_format=kind)
    assert cold == warm == plain and (n, m) == (3, 0)
    d.build_sets()
    d.act()
    d.check_stats()


def test_changes_are_seen(spark, tmp_path):
    path = box(tmp_path / "b", "eml", [make(message_id=i) for i in ("<a>", "<b>", "<c>")])
    hashes(spark, [path], tmp_path / "memo")
    first, second, _ = sorted(Path(path).iterdir())
    first.write_bytes(make("longer than it was", message_id="<z>"))
    second.unlink()
    _, n, d = hashes(spark, [path], tmp_path / "memo")
    assert n == 1
    store = Memo(spark, str(tmp_path / "memo"), hashing.settings_fingerprint(d.config.hash_headers, "skip", "date-header"))
    assert store.load().count() == 2 and len(list(store.folder.glob("v-*"))) == 2


def test_other_boxes_other_settings_and_rejections(spark, tmp_path):
    one, two = box(tmp_path / "one", "eml", [make()]), box(tmp_path / "two", "eml", [make(), b"Subject: few\n\n"])
    hashes(spark, [one], tmp_path / "memo")
    hashes(spark, [two], tmp_path / "memo")
    _, n, _ = hashes(spark, [one], tmp_path / "memo")
    assert n == 0  # a run over another box forgets nothing
    _, n, _ = hashes(spark, [two], tmp_path / "memo")
    assert n == 1  # the rejected mail is read again
    _, n, _ = hashes(spark, [one], tmp_path / "memo", hash_body="raw")
    assert n == 1 and len([p for p in (tmp_path / "memo").iterdir() if p.is_dir()]) == 1


def test_trouble_with_memories_is_no_trouble(spark, tmp_path):
    path = box(tmp_path / "b", "eml", [make()])
    (tmp_path / "file").write_text("in the way")
    keys, n, _ = hashes(spark, [path], tmp_path / "file")
    assert len(keys) == 1 and n == 1


def test_ctime_is_never_restored(spark, tmp_path):
    path = box(tmp_path / "b", "eml", [make()])
    hashes(spark, [path], tmp_path / "memo", time_source="ctime")
    f = next(Path(path).iterdir())
    os.chmod(f, 0o600)
    keys, n, _ = hashes(spark, [path], tmp_path / "memo", time_source="ctime")
    assert n == 0 and keys[0][2] == pytest.approx(os.stat(f).st_ctime)
