"""Schemas of the tables that flow through a run."""

from __future__ import annotations

LISTING = "source_path string, mail_id string, path string, box_format string, file_size bigint, mtime_ns bigint, ctime double"
HEADERS = "array<struct<name:string,value:string>>"
PARSED = f"{LISTING}, headers {HEADERS}, parsed_date double, body_lines array<string>, parse_error string, encoding_error boolean"
CACHE = "source_path string, mail_id string, file_size bigint, mtime_ns bigint, mail_hash string, timestamp double, size bigint, body_hash string"

#: Counters of a run and what they count, mails first.
STATS = {
    "mail_found": "mails found in the sources",
    "mail_rejected": "mails without enough headers, or unreadable",
    "mail_retained": "mails with a key",
    "mail_hashes": "different keys",
    "mail_unique": "mails alone in their set",
    "mail_duplicates": "mails in sets of two or more",
    "mail_skipped": "mails left alone",
    "mail_discarded": "mails that strategies left out",
    "mail_selected": "mails that strategies picked",
    "mail_copied": "mails copied",
    "mail_moved": "mails moved",
    "mail_deleted": "mails deleted",
    "mail_hardlinked": "mails replaced by hard links",
    "mail_hardlink_skipped": "mails that could not become hard links",
    "set_total": "sets",
    "set_single": "sets of one mail",
    "set_skipped_encoding": "sets skipped for undecodable bodies",
    "set_skipped_size": "sets skipped for their sizes",
    "set_skipped_content": "sets skipped for their contents",
    "set_skipped_timestamp": "sets skipped for missing dates",
    "set_skipped_strategy": "sets in which no strategy decided",
    "set_deduplicated": "sets with a decision",
}
