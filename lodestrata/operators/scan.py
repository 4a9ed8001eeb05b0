"""The scan: collectors over the roles of a repository, united, validated, deduplicated, boosted and cut to one relation of signals.

A role is a table: files(path, content), commits(path, author, ts), branches(name, last),
owned(dir, author, ts) and so on. A collector runs where its roles are there; all of them
are lazy, so what a selection leaves out is never computed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import extension, folder_of, is_test_file
from ..sources import code as S
from ..sources.globs import is_demo, matches
from . import collectors as C
from . import graph as G
from . import signals as U

Roles = Mapping[str, DataFrame]
# Kinds that say nothing in demonstrations.
QUIET_IN_DEMOS = ("missing-tests", "low-test-ratio", "low-lottery-risk")
# Extensions of source code for the tests' sake.
SOURCE_EXTENSIONS = (".go", ".js", ".ts", ".jsx", ".tsx", ".py", ".rb", ".java", ".kt", ".rs", ".cs", ".php", ".scala", ".ex", ".swift")


@dataclass(frozen=True)
class Options:
    now: str = "1970-01-01 00:00:00"
    markers: Mapping[str, float] = field(default_factory=lambda: dict(C.MARKERS))
    comment: str = C.COMMENT
    large_lines: int = 1500
    tested_lines: int = 20
    test_roots: tuple[str, ...] = ("tests", "test", "spec")
    churn_days: int = 90
    churn_least: int = 10
    go_module: str = ""
    fan_out: int = 10
    clone_lines: int = 6
    function_lines: int = 5
    score: float = 6.0
    include_demos: bool = False
    #: Cycles square the edges of a graph; meant for graphs of modules.
    cycles: bool = True


def _signals(df: DataFrame, source: str, kind, path, title: Column, confidence, line=0, tags: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*C.signal(source, kind, path, line, title, confidence), F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"))


def lines_of(files: DataFrame) -> DataFrame:
    x = files.select("path", F.posexplode(F.split(F.regexp_replace("content", r"\n$", ""), "\n")).alias("pos", "text"))
    return x.select("path", (F.col("pos") + 1).cast("int").alias("line"), "text")


def todos(r: Roles, o: Options) -> list[DataFrame]:
    return [C.markers(lines_of(r["files"]), o.markers, o.comment)]


def patterns(r: Roles, o: Options) -> list[DataFrame]:
    lines = lines_of(r["files"])
    large = C.large_files(lines, o.large_lines)
    n = F.col("n_lines").cast("string")
    out = [_signals(large, "patterns", "large-file", F.col("path"), F.concat(F.lit("Large file: "), "path", F.lit(" ("), n, F.lit(" lines)")), F.col("confidence"), tags=("large-file",))]
    own = r["files"].where(extension(F.col("path")).isin(*SOURCE_EXTENSIONS))
    below = F.col("path").rlike(rf"^(?:{'|'.join(o.test_roots)})/")
    tool = F.coalesce(F.contains(F.split("content", "\n", 2)[0], F.lit("Code generated")), F.lit(False)) | F.col("path").endswith("_string.go")
    sized = own.where(~is_test_file(F.col("path")) & ~below & ~tool).withColumn("n", F.size(F.split(F.regexp_replace("content", r"\n$", ""), "\n"))).where(F.col("n") >= o.tested_lines)
    bare = C.without_counterpart(sized.select("path", C.test_candidates(F.col("path")).alias("candidates")), r["files"].select("path"))
    out.append(_signals(bare, "patterns", "missing-tests", F.col("path"), F.concat(F.lit("No test file found for "), "path"), 0.3, tags=("missing-tests",)))
    ratio = C.test_ratio(own.select(folder_of(F.col("path")).alias("dir"), is_test_file(F.col("path")).alias("is_test"))).where("low")
    title = F.concat(F.lit("Low test ratio in "), "dir", F.lit(": "), F.col("test_files").cast("string"), F.lit(" test files / "), F.col("source_files").cast("string"), F.lit(" source files"))
    return [*out, _signals(ratio, "patterns", "low-test-ratio", F.col("dir"), title, 0.4, tags=("low-test-ratio",))]


def gitlog(r: Roles, o: Options) -> list[DataFrame]:
    hot = C.churn(r["commits"], o.now, o.churn_days, o.churn_least)
    title = F.concat(F.lit("High churn: "), "path", F.lit(" (modified "), F.col("changes").cast("string"), F.lit(f" times in {o.churn_days} days)"))
    out = [_signals(hot, "gitlog", "churn", F.col("path"), title, F.col("confidence"), tags=("churn",))]
    if "branches" in r:
        old = C.stale_branches(r["branches"], o.now)
        title = F.concat(F.lit("Stale branch: "), "name", F.lit(" (last activity "), F.col("days").cast("string"), F.lit(" days ago)"))
        out.append(_signals(old, "gitlog", "stale-branch", "", title, F.col("confidence"), tags=("stale-branch",)))
    return out


def githygiene(r: Roles, o: Options) -> list[DataFrame]:
    return [C.hygiene(lines_of(r["files"]), r["files"])]


def lotteryrisk(r: Roles, o: Options) -> list[DataFrame]:
    owners = C.ownership(r["owned"], o.now)
    risk = C.lottery_risk(owners).where("risk <= 2")
    first = owners.groupBy("dir").agg(F.min_by(F.struct("author", "share"), F.struct(-F.col("share"), "author")).alias("top"))
    label = F.when(F.col("risk") <= 1, "Critical").when(F.col("risk") == 2, "High").otherwise("Moderate")
    title = F.concat(label, F.lit(" lottery risk: "), "dir", F.lit(" (lottery risk "), F.col("risk").cast("string"), F.lit(", primary: "), F.col("top.author"), F.lit(" "), F.round(100 * F.col("top.share")).cast("int").cast("string"), F.lit("%)"))
    return [_signals(risk.join(first, "dir"), "lotteryrisk", "low-lottery-risk", F.col("dir"), title, F.col("confidence"), tags=("low-lottery-risk",))]


def coupling(r: Roles, o: Options) -> list[DataFrame]:
    edges = S.import_edges(lines_of(r["files"]), o.go_module)
    wide = C.fan_out(edges, o.fan_out)
    title = F.concat(F.lit("High coupling: "), "src", F.lit(" imports "), F.col("n").cast("string"), F.lit(" modules"))
    tags = ("architecture", "coupling")
    out = [_signals(wide, "coupling", "high-coupling", F.col("src"), title, F.col("confidence"), tags=tags)]
    if not o.cycles:
        return out
    rings = G.cycles(edges)
    names = F.split("members", ",")
    path = F.concat(F.array_join(names, " → "), F.lit(" → "), names[0])
    return [*out, _signals(rings, "coupling", "circular-dependency", F.col("cycle"), F.concat(F.lit("Circular dependency: "), path), F.col("confidence"), tags=tags)]


def complexity(r: Roles, o: Options) -> list[DataFrame]:
    x = S.functions(r["files"], o.function_lines).where(F.col("score") >= o.score)
    conf = F.when(F.col("score") >= 15, 0.8).when(F.col("score") >= 8, 0.6 + 0.2 * (F.col("score") - 8) / 7).otherwise(0.5 + 0.1 * (F.col("score") - 6) / 2)
    title = F.concat(F.lit("Complex function: "), "name", F.lit(" (score "), F.format_string("%.1f", "score"), F.lit(", "), F.col("lines").cast("string"), F.lit(" lines, "), F.col("branches").cast("string"), F.lit(" branches)"))
    return [_signals(x, "complexity", "complex-function", F.col("path"), title, conf, F.col("start"), ("complexity", "refactor-candidate"))]


def deadcode(r: Roles, o: Options) -> list[DataFrame]:
    files = r["files"].where(extension(F.col("path")).isin(*{e for exts in S.FUNCTIONS for e in exts}))
    named = S.symbols(lines_of(files.where(~is_test_file(F.col("path")))))
    dead = C.dead_symbols(named, S.tokens(files.select("path", F.col("content").alias("text"))))
    conf = C.dead_code_confidence(F.col("ext"), F.col("exported"), F.col("internal"), F.col("test_only"))
    title = F.concat(F.lit("Unused "), F.regexp_replace("kind", "^unused-", ""), F.lit(": "), "symbol")
    return [_signals(dead, "deadcode", F.col("kind"), F.col("path"), title, conf, F.col("line"), ("dead-code", "cleanup-candidate"))]


def duplication(r: Roles, o: Options) -> list[DataFrame]:
    blocks = C.merged_clones(C.file_windows(r["files"], o.clone_lines), o.clone_lines)
    first = blocks.groupBy("clone", "lines", "locations", "confidence").agg(F.min(F.struct("path", "start")).alias("f"))
    title = F.concat(F.lit("Duplicated block ("), F.col("lines").cast("string"), F.lit(" lines, "), F.col("locations").cast("string"), F.lit(" locations)"))
    return [_signals(first, "duplication", "code-clone", F.col("f.path"), title, F.col("confidence"), F.col("f.start"), ("code-clone", "duplication"))]


#: Collectors by name, with the roles that they need.
REGISTRY: dict[str, tuple[Callable[[Roles, Options], list[DataFrame]], tuple[str, ...]]] = {
    "todos": (todos, ("files",)),
    "gitlog": (gitlog, ("commits",)),
    "patterns": (patterns, ("files",)),
    "lotteryrisk": (lotteryrisk, ("owned",)),
    "githygiene": (githygiene, ("files",)),
    "coupling": (coupling, ("files",)),
    "complexity": (complexity, ("files",)),
    "deadcode": (deadcode, ("files",)),
    "duplication": (duplication, ("files",)),
}


def chosen(include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), disabled: tuple[str, ...] = ()) -> list[str]:
    """The names that run: those included, else all that are not disabled; less those excluded."""
    unknown = {*include, *exclude} - set(REGISTRY)
    if unknown:
        raise ValueError(f"unknown collectors: {', '.join(sorted(unknown))}; there are {', '.join(REGISTRY)}")
    names = [n for n in REGISTRY if n in include] if include else [n for n in REGISTRY if n not in disabled]
    return [n for n in names if n not in exclude]


def without_demos(signals: DataFrame) -> DataFrame:
    """Signals of the kinds that say nothing in demonstrations go, where they stand in one."""
    path = F.coalesce("file_path", F.lit(""))
    return signals.where(~(F.col("kind").isin(*QUIET_IN_DEMOS) & (is_demo(path) | is_demo(F.concat(path, F.lit("/"))))))


def collected(roles: Roles, o: Options = Options(), names: list[str] | None = None, paths: tuple[str, ...] = ()) -> DataFrame:
    """The signals of the collectors, with the columns of U.SCHEMA; paths restricts files to globs."""
    if paths and "files" in roles:
        roles = {**roles, "files": roles["files"].where(matches(F.col("path"), *paths))}
    run = [REGISTRY[n] for n in (chosen() if names is None else names)]
    parts = [x for f, needs in run if all(n in roles for n in needs) for x in f(roles, o)]
    spark = next(iter(roles.values())).sparkSession
    whole = U.union_all([spark.createDataFrame([], U.SCHEMA), *parts])
    return whole if o.include_demos else without_demos(whole)


def scan(roles: Roles, o: Options = Options(), *, names: list[str] | None = None, paths: tuple[str, ...] = (), most: int = 0, confidence: float = 0.0) -> DataFrame:
    """Valid signals, one for each id with the greatest confidence, raised where weighty kinds share the file, at least so confident, at most so many."""
    own = U.with_id(U.valid(collected(roles, o, names, paths)))
    one = U.deduplicated(own, ["title", "description"])
    out = U.boosted(one)
    if confidence:
        out = U.at_least(out, confidence)
    return U.capped(out, most, ["file_path", "line", "title"]) if most else out


def summary(signals: DataFrame) -> DataFrame:
    """What a dry run tells: source, n."""
    return signals.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
