"""Schemas of the tables that the library reads and writes, and its settings."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass

REPO = "repo_id bigint, name string, full_name string, html_url string, license string, language string, last_pushed string, head_branch string, head_sha string, tags array<struct<name:string,commit_sha:string>>, branches array<struct<name:string,commit_sha:string>>"
TAG = "id bigint, tag_name string, sha string"
FILE = "id bigint, data_id bigint, file_index bigint, path_id bigint, tag_id bigint"
NAME = "id bigint, name string"
SNIPPET = "id bigint, internal_id bigint, licence_id bigint, data_id bigint, data_index bigint"
LICENCE = "id bigint, licence string"
RAW_SNIPPET = "id bigint, snippet_id bigint, date string, licence string, code string"
RULE = "dir string, block string, type string, db_file string, search_file string, reason string, comment string, cve string, status string"
SCAN = "group_id bigint, project_id bigint, version_id bigint, scan_id bigint, name string, type string, status string, max_count int, finished_count int"

#: Units over this size are not scanned.
MAX_BYTES = 1024 * 1024
#: Symbols of a search window, and the least that a strict search takes.
WINDOW = 64


@dataclass(frozen=True)
class Settings:
    """Folders and search window. The two servers are not part of this library; their addresses are kept for those who run them."""

    database: str
    work: str
    data: str
    scans: str
    window: int = WINDOW
    scan_server: tuple[str, int] = ("127.0.0.1", 9080)
    update_server: tuple[str, int] = ("127.0.0.1", 9081)


def read_settings(path: str) -> Settings:
    """Settings from an INI file; relative folders are taken from the file's own folder."""
    # Sections, keys and defaults are fixed by the format.
    parser = configparser.ConfigParser(interpolation=None)
    parser.read(path)
    base = os.path.dirname(os.path.abspath(path))
    folder = lambda key: os.path.normpath(os.path.join(base, parser.get("pathes", key, fallback="")))
    server = lambda name, port: (parser.get(name, "addr", fallback="127.0.0.1"), parser.getint(name, "port", fallback=port))
    return Settings(
        folder("dbPath"), folder("workPath"), folder("dataPath"), folder("scanPath"),
        parser.getint("search", "windowSize", fallback=WINDOW), server("ScanServer", 9080), server("UpdateServer", 9081),
    )
