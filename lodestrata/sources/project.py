"""What the files at the top of a project tell: its tools, files kept elsewhere, branches, commits; and secrets kept out of messages."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ancestors
from .globs import matches

# Files at the top that tell a tool, its name and the commands that go with it.
TOOLS = {
    "go.mod": ("Go", ("go build ./...", "go test ./...")),
    "package.json": ("Node.js", ("npm install", "npm test")),
    "Makefile": ("Make", ("make",)),
    "Cargo.toml": ("Rust", ("cargo build", "cargo test")),
    "pyproject.toml": ("Python", ("pytest",)),
    "requirements.txt": ("Python", ("pip install -r requirements.txt",)),
    "Dockerfile": ("Docker", ("docker build .",)),
    ".goreleaser.yml": ("GoReleaser", ()),
    ".goreleaser.yaml": ("GoReleaser", ()),
}
#: A version within the file, where there is one.
VERSIONS = {"go.mod": r"(?m)^go\s+(\d+\.\d+)", "Cargo.toml": r'(?m)^edition\s*=\s*"(\d+)"', "pyproject.toml": r'(?m)^requires-python\s*=\s*"([^"]+)"', "Dockerfile": r"(?m)^FROM\s+(\S+)"}
# Variables whose values never show in messages.
SENSITIVE = ("GITHUB_TOKEN", "GH_TOKEN", "ANTHROPIC_API_KEY", "OPENAI_API_KEY")


def tools(files: DataFrame) -> DataFrame:
    """files(path, content): path, tool, version, commands of the files at the top that tell a tool."""
    rows = F.lit(None).cast("struct<tool:string,commands:array<string>>")
    version = F.lit("")
    for name, (tool, commands) in TOOLS.items():
        given = F.array(*[F.lit(c) for c in commands]) if commands else F.array().cast("array<string>")
        rows = F.when(F.col("path") == name, F.struct(F.lit(tool).alias("tool"), given.alias("commands"))).otherwise(rows)
    for name, pattern in VERSIONS.items():
        version = F.when(F.col("path") == name, F.regexp_extract("content", pattern, 1)).otherwise(version)
    x = files.where(F.col("path").isin(*TOOLS)).select("path", "content", rows.alias("t"))
    return x.select("path", "t.tool", version.alias("version"), "t.commands")


def make_targets(files: DataFrame) -> DataFrame:
    """target: the targets of the Makefile at the top that can be asked for by name."""
    x = files.where(F.col("path") == "Makefile").select(F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^([A-Za-z][A-Za-z0-9_-]*)\s*:(?!=)"), F.lit(1))).alias("target"))
    return x.distinct()


def workspace_folders(files: DataFrame, globs: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """dir: the directories of files(path) that a workspace's globs name; ** is any depth."""
    above = files.select(F.explode(ancestors(F.col("path"))).alias("dir")).distinct()
    form = lambda g: "^" + re.sub(r"\\\*\\\*", ".*", re.escape(g.strip("/"))).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"
    any_of = lambda gs: F.col("dir").rlike("|".join(form(g) for g in gs)) if gs else F.lit(False)
    return above.where(any_of(globs) & ~any_of(excluded))


def stored_elsewhere(lines: DataFrame) -> DataFrame:
    """lines(path, line, text): pattern: the globs that .gitattributes at the top sends to large-file storage."""
    text = F.trim("text")
    x = lines.where((F.col("path") == ".gitattributes") & ~text.startswith("#") & F.contains(text, F.lit("filter=lfs")))
    return x.select(F.regexp_extract(text, r"^(\S+)", 1).alias("pattern")).distinct()


def not_stored_elsewhere(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """files(path, …) that none of a project's globs matches, by its last segment or whole."""
    return files.where(~matches(F.col("path"), *patterns)) if patterns else files


def branch_refs(text: DataFrame) -> DataFrame:
    """text(value), lines of `git for-each-ref --format='%(refname)%09%(committerdate:iso-strict)%09%(authorname)'`: name, last, author of local branches."""
    p = F.split("value", "\t")
    x = text.where(F.col("value").startswith("refs/heads/"))
    return x.select(F.regexp_replace(p[0], "^refs/heads/", "").alias("name"), F.to_timestamp(F.get(p, F.lit(1))).alias("last"), F.get(p, F.lit(2)).alias("author"))


def commit_log(text: DataFrame) -> DataFrame:
    """text(value), lines of `git log --format='%H%x09%an%x09%aI%x09%P%x09%s'`: sha, author, ts, is_merge, subject."""
    p = F.split("value", "\t", 5)
    x = text.where(F.col("value").rlike(r"^[0-9a-f]{40}\t"))
    return x.select(p[0].alias("sha"), p[1].alias("author"), F.to_timestamp(p[2]).alias("ts"), (F.size(F.split(p[3], " ")) >= 2).alias("is_merge"), F.get(p, F.lit(4)).alias("subject"))


def redacted(text: str, environment: Mapping[str, str] | None = None, names: tuple[str, ...] = SENSITIVE) -> str:
    """The text without the values of sensitive variables of four characters or more."""
    env = os.environ if environment is None else environment
    secrets = sorted({env[n] for n in names if len(env.get(n, "")) >= 4}, key=len, reverse=True)
    return re.sub("|".join(map(re.escape, secrets)), "[REDACTED]", text) if secrets else text
