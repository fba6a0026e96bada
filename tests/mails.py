"""Mails and boxes for tests."""

from __future__ import annotations

import email
import email.utils
from datetime import datetime, timezone

from kindred.sources import boxes


def make(body: str = "Привет, как дела?", date: str | datetime | None = "2024-01-15T10:00:00", message_id: str = "<one@nohost.com>", raw_date: str | None = None, **headers: str) -> bytes:
    if raw_date is None and date is not None:
        at = date if isinstance(date, datetime) else datetime.fromisoformat(date)
        raw_date = email.utils.format_datetime(at.replace(tzinfo=at.tzinfo or timezone.utc))
    lines = {"Return-path": "<foo@bar.com>", "Date": raw_date, "From": "foo@bar.com", "To": "baz", "Message-Id": message_id, "Subject": "A mail", "Mime-Version": "1.0", "Content-Type": 'text/plain; charset="utf-8"', "Content-Transfer-Encoding": "8bit"} | {k.replace("_", "-"): v for k, v in headers.items()}
    return ("".join(f"{k}: {v}\n" for k, v in lines.items() if v is not None) + "\n" + body + "\n").encode()


def box(path, kind: str, mails: list[bytes]) -> str:
    b = boxes.open_box(str(path), kind, create=True)
    b.lock()
    for m in mails:
        b.add(m)
    b.flush()
    b.unlock()
    b.close()
    return str(path)


def contents(path, kind: str) -> list[str]:
    """Bodies and ids of a box's mails, sorted."""
    b = boxes.open_box(str(path), kind)
    out = []
    for key in boxes.keys(b, kind):
        m = b.get_message(key)
        out.append(f"{m['Message-Id']}|{m['Date']}|{str(m.get_payload()).strip()}")
    b.close()
    return sorted(out)


def parse(raw: bytes) -> email.message.Message:
    return email.message_from_bytes(raw)
