"""Path globs, compiled on the driver to one regular expression each."""

from __future__ import annotations

import re

from pyspark.sql import Column

# Directories and files that are not scanned; the last is this engine's own state.
DEFAULT_EXCLUDES = (
    "vendor/**",
    "node_modules/**",
    ".git/**",
    "testdata/**",
    "CHANGELOG*",
    "CHANGES*",
    "HISTORY*",
    "NEWS*",
    "third_party/**",
    "3rdparty/**",
    "extern/**",
    "external/**",
    "bower_components/**",
    "wwwroot/lib/**",
    "eval/**",
    ".beads/**",
    ".lodestrata/**",
)
# Directories of demonstrations and others where tests and owners are not expected.
DEMO_PATHS = (
    "examples/**",
    "example/**",
    "tutorials/**",
    "tutorial/**",
    "demos/**",
    "demo/**",
    "samples/**",
    "sample/**",
    "_examples/**",
    "docs/**",
    "doc/**",
    "extras/**",
    "packaging/**",
    "scripts/**",
    "tools/**",
    "contrib/**",
    "misc/**",
    "build/**",
    "deploy/**",
    ".github/**",
    ".ci/**",
)


def _piece(glob: str) -> str:
    out = ""
    for c in glob:
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
    return out


def to_regex(glob: str) -> str:
    """dir/** matches below dir at any depth; a pattern without a slash matches the last segment; else the whole path."""
    if glob.endswith("/**"):
        return f"^(?:.*/)?{_piece(glob[:-3])}/.*$"
    if "**" in glob:
        head, _, tail = glob.partition("**")
        return f"^{_piece(head)}(?:.*/)?{_piece(tail.lstrip('/'))}$"
    return f"^{_piece(glob)}$" if "/" in glob else f"^(?:.*/)?{_piece(glob)}$"


def matches(path: Column, *globs: str) -> Column:
    return path.rlike("|".join(f"(?:{to_regex(g)})" for g in globs))


def is_demo(path: Column) -> Column:
    return matches(path, *DEMO_PATHS)
