"""Source code as relations: imports, the modules they name, definitions, and functions with their lengths and branches.

Everything is told by extension and regular expression; there is no syntax tree. Lines
and definitions are column expressions; only where a function ends needs the lines that
follow it, which Python finds file by file over Arrow batches.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import extension, folder_of, is_test_file, joined_path

# The lines that import, by extension; the first group that matched names what is imported.
IMPORTS = {
    (".go",): r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"',
    (".js", ".ts", ".jsx", ".tsx"): r"(?:import|export)\s+.*?from\s+['\"]([^'\"]+)['\"]|require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    (".py",): r"^\s*from\s+([\w.]+)\s+import|^\s*import\s+([\w.]+)",
    (".java",): r"^\s*import\s+(?:static\s+)?([\w.]+)",
    (".rs",): r"^\s*(?:pub\s+)?use\s+crate::(\w+)",
    (".rb",): r"^\s*require_relative\s+['\"]([^'\"]+)['\"]",
    (".php",): r"^\s*use\s+([\w\\]+)",
    (".c", ".cpp", ".h", ".hpp"): r'^\s*#\s*include\s+"([^"]+)"',
}
# The lines that begin a function and how its body ends.
FUNCTIONS = {
    (".go",): (r"^\s*func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(", "brace"),
    (".py",): (r"^\s*def\s+(\w+)\s*\(", "dedent"),
    (".js", ".ts", ".jsx", ".tsx"): (
        r"(?:^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\()"
        r"|(?:^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=])\s*=>)"
        r"|(?:^\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{)",
        "brace",
    ),
    (".java",): (r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*\w[\w<>\[\],\s]*\s+(\w+)\s*\(", "brace"),
    (".rs",): (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "brace"),
    (".rb",): (r"^\s*def\s+(\w+[?!]?)", "end"),
    (".php",): (r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+(\w+)\s*\(", "brace"),
    (".swift",): (r"^\s*(?:(?:public|private|fileprivate|internal|open|static|class|override|@objc|mutating)\s+)*func\s+(\w+)", "brace"),
    (".scala",): (r"^\s*(?:(?:private|protected|override|final|abstract)\s+)*def\s+(\w+)", "brace"),
    (".ex", ".exs"): (r"^\s*(?:defp?|defmacrop?)\s+(\w+[?!]?)", "end"),
}
# The lines that define a type.
TYPES = {
    (".go",): r"^\s*type\s+(\w+)\s+(?:struct|interface)\s*\{",
    (".py",): r"^\s*class\s+(\w+)",
    (".js", ".jsx"): r"^\s*(?:export\s+)?class\s+(\w+)",
    (".ts", ".tsx"): r"^\s*(?:export\s+)?(?:class|interface|type)\s+(\w+)",
    (".java",): r"^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum)\s+(\w+)",
    (".rs",): r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)",
    (".rb",): r"^\s*class\s+(\w+)",
    (".php",): r"^\s*(?:(?:abstract|final)\s+)?class\s+(\w+)",
    (".swift",): r"^\s*(?:(?:public|private|fileprivate|internal|open|final)\s+)*(?:class|struct|enum|protocol)\s+(\w+)",
    (".scala",): r"^\s*(?:(?:private|protected|abstract|sealed|final|case)\s+)*(?:class|object|trait)\s+(\w+)",
    (".ex",): r"^\s*defmodule\s+([\w.]+)",
}
# What counts as a branch, lines that are comments only, and what opens and closes a block that ends with a word.
BRANCH = r"\b(?:if|else\s+if|elif|elsif|for|while|switch|case|catch|except|guard|when|unless)\b|&&|\|\|"
COMMENT_LINE = r"^\s*(?://|#|/\*|\*\s|\*/|--)\s*"
OPENS = r"\b(?:def|class|module|do|if|unless|while|until|for|case|begin)\b"
CLOSES = r"\bend\b"


def _by_extension(ext: Column, text: Column, patterns: dict) -> Column:
    """The first of the groups that matched something in the extension's pattern; null without a match.

    The pattern is a value that changes from file to file, so that a line meets one and the
    compiled code stays small; patterns with fewer groups get some that never match.
    """
    found = {e: p if isinstance(p, str) else p[0] for exts, p in patterns.items() for e in exts}
    many = {e: re.compile(p).groups for e, p in found.items()}
    most = max(many.values())
    pattern = F.lit(None).cast("string")
    for exts, p in patterns.items():
        own = found[exts[0]]
        pattern = F.when(ext.isin(*exts), F.lit(own if many[exts[0]] == most else f"(?:{own})(?:{'()' * (most - many[exts[0]])}){{0}}")).otherwise(pattern)
    group = lambda k: F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(k)), F.lit(""))
    rest = [F.when(ext.isin(*[e for e, n in many.items() if n >= k]), group(k)) for k in range(2, most + 1)]
    return F.coalesce(group(1), *rest)


def module_of(path: Column) -> Column:
    """The module that a file belongs to, as imports of its language name it."""
    ext, folder = extension(path), folder_of(path)
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    after_src = F.regexp_replace(F.regexp_extract(path, r"(?:^|.*?/)src/([^/]+)", 1), r"\.rs$", "")
    rust = F.when(after_src.isin("main", "lib"), "crate").when(after_src != "", after_src).otherwise(F.regexp_extract(stem, r"([^/]*)$", 1))
    return (
        F.when(ext == ".go", folder)
        .when(ext.isin(".js", ".ts", ".jsx", ".tsx", ".rb"), stem)
        .when(ext == ".py", F.replace(stem, F.lit("/"), F.lit(".")))
        .when(ext == ".java", F.replace(folder, F.lit("/"), F.lit(".")))
        .when(ext == ".rs", rust)
        .when(ext == ".php", F.replace(folder, F.lit("/"), F.lit("\\")))
        .otherwise(path)
    )


def import_edges(lines: DataFrame, go_module: str = "") -> DataFrame:
    """lines(path, line, text) of whole files: src, dst, the modules of files and those that they import; imports of other projects go.

    Each import is a few candidates with ranks, which meet the modules by equality, in a
    shuffle at every size: a dotted name and its parents, of which the longest counts; a
    relative path and its index; all others as written. What is found is dealt by src once.
    """
    x = lines.select("path", "text", extension(F.col("path")).alias("ext")).where(F.col("ext").isin(*[e for exts in IMPORTS for e in exts]))
    x = x.select("path", "ext", F.explode(F.array(_by_extension(F.col("ext"), F.col("text"), IMPORTS))).alias("name")).where(F.col("name").isNotNull())
    x = x.select("path", "ext", "name", module_of(F.col("path")).alias("src"))
    name, folder = F.col("name"), folder_of(F.col("path"))
    script = F.col("ext").isin(".js", ".ts", ".jsx", ".tsx")
    plain = F.regexp_replace(joined_path(folder, name), r"\.(?:js|ts|jsx|tsx)$", "")
    parts = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    without_last = lambda mark: F.regexp_extract(name, rf"^(.*){mark}[^{mark}]*$", 1)
    go = F.when(name.startswith(go_module + "/"), F.substring(name, len(go_module) + 2, 10_000)) if go_module else F.lit(None).cast("string")
    candidates = (
        F.when(F.col("ext") == ".go", F.array(go))
        .when(script, F.when(name.startswith("."), F.array(plain, F.concat(plain, F.lit("/index")))))
        .when(F.col("ext") == ".py", parents)
        .when(F.col("ext") == ".java", F.array(without_last(r"\.")))
        .when(F.col("ext") == ".rb", F.array(F.regexp_replace(joined_path(folder, name), r"\.rb$", "")))
        .when(F.col("ext") == ".php", F.array(without_last(r"\\")))
        .otherwise(F.array(name))
    )
    # not made distinct, so that a common name's rows can be split among tasks
    modules = lines.where("line = 1").select(module_of(F.col("path")).alias("dst"))
    python = F.col("ext") == ".py"
    hits = x.select("src", F.when(python, name).alias("dotted"), F.posexplode(candidates).alias("nth", "dst")).where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")) | F.col("dotted").isNotNull()).join(modules.hint("merge"), "dst", "left_semi")
    # of a dotted name only the longest that exists counts; of paths, each
    each = hits.repartition("src").groupBy("src", "dotted", F.when(F.col("dotted").isNull(), F.col("dst")).alias("dst")).agg(F.min("nth").alias("nth"))
    of = F.split("dotted", r"\.")
    return each.select("src", F.coalesce("dst", F.array_join(F.slice(of, F.lit(1), F.size(of) - F.col("nth")), ".")).alias("dst")).where("src <> dst").distinct()


def symbols(lines: DataFrame) -> DataFrame:
    """symbol, path, line, kind, ext, exported, internal: definitions of functions and types."""
    x = lines.withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(*{e for exts in (*FUNCTIONS, *TYPES) for e in exts}))
    kinds = {"unused-function": FUNCTIONS, "unused-type": TYPES}
    found = F.array(*[F.struct(F.lit(k).alias("kind"), _by_extension(F.col("ext"), F.col("text"), p).alias("symbol")) for k, p in kinds.items()])
    x = x.select("path", "line", "text", "ext", F.explode(found).alias("d")).where(F.col("d.symbol").isNotNull()).select("d.symbol", "path", "line", "d.kind", "ext", "text")
    upper = F.col("symbol").rlike("^[A-Z]")
    exported = F.when(F.col("ext").isin(".go", ".java"), upper).when(F.col("ext") == ".rs", F.contains("text", F.lit("pub "))).when(F.col("ext").isin(".py", ".rb"), ~F.col("symbol").startswith("_")).otherwise(True)
    return x.select("symbol", "path", "line", "kind", "ext", exported.alias("exported"), F.contains("path", F.lit("internal/")).alias("internal"))


def tokens(lines: DataFrame) -> DataFrame:
    """token, path, is_test: every run of word characters; lines may be whole files, too."""
    x = lines.select("path", "text", is_test_file(F.col("path")).alias("is_test"))
    return x.select(F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).alias("token"), "path", "is_test")


def body_end(lines: list[str], begin: int, mode: str) -> tuple[int, int]:
    """(last line of the body + 1, last line of the function) of one that begins at a line: where a running level is back where it was."""
    rest = lines[begin:]
    if mode == "dedent":
        width = lambda t: len(t[: len(t) - len(t.lstrip(" \t"))].replace("\t", "    "))
        free = np.array([not t.strip() or t.strip().startswith("#") for t in rest])
        level = np.array([width(t) for t in rest])
        held = np.flatnonzero(~free[1:]) + 1
        if not len(held) or level[held[0]] <= level[0]:
            return begin, begin
        out = held[level[held] <= level[0]]
        stop = begin + (int(out[0]) if len(out) else len(rest))
        return stop, stop - 1
    if mode == "end":
        change = np.array([0 if not t.strip() or t.strip().startswith("#") else len(re.findall(OPENS, t)) - len(re.findall(CLOSES, t)) for t in rest])
        change[0] = 1
        back = np.flatnonzero(np.cumsum(change)[1:] <= 0) + 1
    else:
        change = np.array([t.count("{") - t.count("}") for t in rest])
        opened = np.cumsum([t.count("{") for t in rest]) > 0
        back = np.flatnonzero(opened & (np.cumsum(change) <= 0))
    if len(back):
        return begin + int(back[0]), begin + int(back[0])
    return (len(lines), len(lines) - 1) if len(rest) > 1 else (begin, begin)


def functions(files: DataFrame, least_lines: int = 1) -> DataFrame:
    """files(path, content): path, name, start, stop, lines (not blank), branches, score; a function within another is part of it."""
    table = {e: (re.compile(p, re.ASCII), mode) for exts, (p, mode) in FUNCTIONS.items() for e in exts}
    branch, comment = re.compile(BRANCH, re.ASCII), re.compile(COMMENT_LINE)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = re.search(r"(\.[^./]*)$", path or "")
                if not at or at[1] not in table:
                    continue
                begins, mode = table[at[1]]
                lines = (content or "").removesuffix("\n").split("\n")
                free = 0
                for i, line in enumerate(lines):
                    m = begins.search(line) if i >= free else None
                    if not m:
                        continue
                    stop, last = body_end(lines, i, mode)
                    body = lines[i + 1 : stop]
                    free = last + 1
                    if len(body) >= least_lines:
                        held = [t for t in body if t.strip()]
                        n = sum(len(branch.findall(t)) for t in held if not comment.match(t))
                        rows.append((path, next(g for g in m.groups() if g), i + 1, last + 1, len(held), n, len(held) / 50 + n))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "name", "start", "stop", "lines", "branches", "score"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, start int, stop int, lines long, branches long, score double")


def source_folders(docs: DataFrame, files: DataFrame, prefixes: tuple[str, ...] = ("internal/", "src/", "pkg/", "")) -> DataFrame:
    """docs(doc): doc, dir: the directory that a document is about, by its name below the first of some directories; documents at the top are about everything."""
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("dir"), "path").where("dir <> path").select("dir").distinct()
    stem = F.regexp_replace(F.regexp_extract("doc", r"([^/]*)$", 1), r"\.[^.]*$", "")
    wanted = F.when(folder_of(F.col("doc")) == ".", F.array(F.lit("."))).otherwise(F.array(*[F.concat(F.lit(p), stem) for p in prefixes]))
    x = docs.select("doc", F.posexplode(wanted).alias("nth", "dir"))
    top = x.where("dir = '.'").select("doc", "dir")
    found = x.where("dir <> '.'").join(above, "dir", "left_semi").groupBy("doc").agg(F.min_by("dir", "nth").alias("dir"))
    return top.union(found)


def is_document(path: Column) -> Column:
    """Markdown, reStructuredText and plain text: at the top by name, elsewhere within a directory of documents."""
    kind = F.lower(path).rlike(r"\.(?:md|rst|txt)$")
    top = F.upper(path).rlike("^(?:README|CONTRIBUTING|CHANGELOG|CHANGES|HISTORY)[^/]*$")
    return kind & (top | F.lower(path).rlike("(?:^|/)docs?/"))


