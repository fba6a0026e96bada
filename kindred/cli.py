"""Command line: ``python -m kindred [options] source...``"""

from __future__ import annotations

import argparse
import configparser
import dataclasses
import json
import logging
import os
import sys
import tomllib
from pathlib import Path

from kindred.config import ACTIONS, BODY_MODES, BOX_FORMATS, TIME_SOURCES, Config

ENVIRONMENT = "KINDRED_"


def parser() -> argparse.ArgumentParser:
    from kindred.operators.strategies import STRATEGIES

    p = argparse.ArgumentParser(prog="kindred", description="Find and resolve duplicate mails in any number of boxes.")
    yes = {"action": argparse.BooleanOptionalAction, "default": None}
    p.add_argument("sources", nargs="*", help="boxes, or folders of them")
    p.add_argument("-i", "--input-format", choices=BOX_FORMATS, help="read all sources in this format")
    p.add_argument("-u", "--force-unlock", **yes, help="take away locks that are in the way")
    p.add_argument("-H", "--hash-only", **yes, help="print keys and stop")
    p.add_argument("-k", "--hash-header", dest="hash_headers", action="append", help="header of the key; again for more")
    p.add_argument("-b", "--hash-body", choices=BODY_MODES, help="what of the body the key has")
    p.add_argument("--cache", **yes, help="remember keys from run to run")
    p.add_argument("--cache-path", help="where to remember them")
    p.add_argument("-s", "--strategy", dest="strategies", action="append", choices=sorted(STRATEGIES), help="what to pick of a set; again for what to try next")
    p.add_argument("-t", "--time-source", choices=TIME_SOURCES)
    p.add_argument("-r", "--regexp", help="pattern for strategies on paths")
    p.add_argument("-S", "--size-threshold", type=int, help="characters that sizes may differ by; -1: any")
    p.add_argument("-C", "--content-threshold", type=int, help="characters that a diff may have; -1: any")
    p.add_argument("-d", "--show-diff", **yes, help="print the diffs of contested sets")
    p.add_argument("-a", "--action", choices=ACTIONS)
    p.add_argument("-E", "--export", help="box to copy or move to")
    p.add_argument("-e", "--export-format", choices=BOX_FORMATS)
    p.add_argument("--export-append", **yes)
    p.add_argument("--hardlink-differing", **yes)
    p.add_argument("-n", "--dry-run", **yes)
    p.add_argument("--jobs", type=int, help="local cores for Spark")
    p.add_argument("--config", help="TOML, JSON or INI file of options")
    return p


def from_file(path: str) -> dict:
    """Options of a file, under ``kindred`` if it has such a section; unknown ones are errors."""
    text, suffix = Path(path).read_text(), Path(path).suffix.lower()
    if suffix == ".toml":
        found = tomllib.loads(text)
    elif suffix == ".json":
        found = json.loads(text)
    elif suffix in (".yaml", ".yml"):
        import yaml

        found = yaml.safe_load(text)
    else:
        ini = configparser.ConfigParser()
        ini.read_string(text)
        found = {k: json.loads(v) if v[:1] in "[0123456789-\"tf" else v for k, v in ini["kindred"].items()}
    found = found.get("kindred", found)
    return {k.replace("-", "_"): v for k, v in found.items()}


def options(args: list[str], environ: dict[str, str] | None = None) -> tuple[list[str], Config, dict]:
    """(sources, config, rest): the command line beats the environment, which beats the file."""
    known = {f.name: f for f in dataclasses.fields(Config)}
    given = {k: v for k, v in vars(parser().parse_args(args)).items() if v is not None}
    sources, path, jobs = given.pop("sources", []), given.pop("config", None), given.pop("jobs", None)
    values: dict = from_file(path) if path else {}
    for k in list(values):
        if k not in known:
            raise SystemExit2(f"{path}: no such option: {k}")
    for name in known:
        if (v := (os.environ if environ is None else environ).get(ENVIRONMENT + name.upper())) is not None:
            kind = type(known[name].default)
            values[name] = v.lower() in ("1", "true", "yes", "on") if kind is bool else int(v) if kind is int else v.split() if kind is tuple else v
    values |= given
    for name in ("hash_headers", "strategies"):
        if name in values:
            values[name] = tuple(values[name])
    try:
        config = Config(**values)
        config.check(bool(sources))
    except (ValueError, TypeError) as e:
        raise SystemExit2(str(e)) from None
    return sources, config, {"jobs": jobs}


class SystemExit2(SystemExit):
    """A usage error: says why, exits with 2."""

    def __init__(self, why: str):
        print(f"kindred: {why}", file=sys.stderr)
        super().__init__(2)


def ignored(config: Config) -> list[str]:
    """Options of later steps that hash-only leaves unused."""
    later = ("strategies", "regexp", "size_threshold", "content_threshold", "action", "export", "export_format", "export_append", "dry_run", "hardlink_differing", "show_diff")
    plain = Config()
    return [name for name in later if getattr(config, name) != getattr(plain, name)]


def main(args: list[str] | None = None, spark=None) -> int:
    sources, config, rest = options(sys.argv[1:] if args is None else args)
    if not sources:
        parser().print_help()
        return 0
    from kindred.plans.dedup import Dedup, hash_only
    from kindred.session import local_session

    spark = spark or local_session(rest["jobs"])
    try:
        if config.hash_only:
            for name in ignored(config):
                logging.warning("--hash-only makes no use of %s", name)
            for r in hash_only(spark, sources, config).orderBy("source_path", "mail_id").toLocalIterator():
                print(*(f"{h.id}: {h.value}" for h in r.canonical_headers), f"Hash: {r.header_hash}", "", sep="\n")
            return 0
        run = Dedup(spark, config)
        for s in sources:
            run.add_source(s)
        run.run().show(100, truncate=False)
        if config.show_diff:
            from kindred.operators.diffs import contested_diffs

            for r in contested_diffs(run).toLocalIterator():
                print(r.diff)
        return 0
    except (ValueError, OSError) as e:
        logging.error("%s", e)
        return 1
