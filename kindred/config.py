"""What a run is asked to do, checked before anything is read."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

# The headers that make up a key, in order, unless others are asked for.
DEFAULT_HEADERS = ("date", "from", "to", "subject", "mime-version", "content-type", "content-disposition", "user-agent", "x-priority", "message-id")
# Fixed value: a record with fewer of its key's headers (or than the key has) is rejected.
MINIMAL_HEADERS = 4

BODY_MODES = ("skip", "raw", "normalized")
TIME_SOURCES = ("date-header", "ctime")
BOX_FORMATS = ("maildir", "mbox", "mh", "babyl", "mmdf", "eml")
#: Formats that give each mail a file of its own.
FOLDER_FORMATS = ("maildir", "mh", "eml")
ACTIONS = ("copy-selected", "copy-discarded", "move-selected", "move-discarded", "delete-selected", "delete-discarded", "hardlink-discarded")


def header_ids(ids: Iterable[str]) -> tuple[str, ...]:
    """Lower-cased, in order, each once; names need printable ASCII without spaces, and one is needed."""
    out = tuple(dict.fromkeys(i.strip().lower() for i in ids))
    if not out:
        raise ValueError("no header to make a key of")
    for i in out:
        if not i or any(not 33 <= ord(c) <= 126 for c in i):
            raise ValueError(f"not a header name: {i!r}")
    return out


@dataclass(frozen=True)
class Config:
    hash_headers: tuple[str, ...] = DEFAULT_HEADERS
    hash_body: str = "skip"
    time_source: str = "date-header"
    strategies: tuple[str, ...] = ()
    regexp: str | None = None
    size_threshold: int = 512
    content_threshold: int = 768
    action: str = "copy-selected"
    export: str | None = None
    export_format: str = "mbox"
    export_append: bool = False
    hardlink_differing: bool = False
    dry_run: bool = False
    hash_only: bool = False
    input_format: str | None = None
    force_unlock: bool = False
    cache: bool = False
    cache_path: str | None = None
    show_diff: bool = False
    seed: int = 0
    #: Compare sizes with the extremes of the whole set, evicted records included.
    stale_size_extremes: bool = False

    def __post_init__(self) -> None:
        from kindred.operators.strategies import canonical

        object.__setattr__(self, "hash_headers", header_ids(self.hash_headers))
        object.__setattr__(self, "strategies", canonical(self.strategies))
        if self.cache_path:
            object.__setattr__(self, "cache", True)
        for name, allowed in (("hash_body", BODY_MODES), ("time_source", TIME_SOURCES), ("action", ACTIONS), ("export_format", BOX_FORMATS), ("input_format", (None, *BOX_FORMATS))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {', '.join(map(str, allowed))}")
        for name in ("size_threshold", "content_threshold"):
            if getattr(self, name) < -1:
                raise ValueError(f"{name} is -1 (off) or more")
        if self.regexp is not None:
            re.compile(self.regexp)

    def check(self, sources: bool) -> None:
        """Demands of options on one another; nothing is demanded without sources or for hashes only."""
        if not sources or self.hash_only:
            return
        by_path = any(s.endswith("matching-path") for s in self.strategies)
        if by_path and self.regexp is None:
            raise ValueError("strategies on paths need a regular expression")
        if self.regexp is not None and not by_path:
            raise ValueError("a regular expression is of use to strategies on paths only")
        exports = self.action.split("-")[0] in ("copy", "move")
        if exports and self.export is None:
            raise ValueError(f"{self.action} needs an export path")
        if self.export is not None and not exports:
            raise ValueError(f"{self.action} exports nothing")
