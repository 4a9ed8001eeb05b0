"""The scan path, source code as relations, states and sections, on small fixtures."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tree(spark):
    long = "\n".join(f"    x{i} = {i}" for i in range(25))
    files = {
        "app/models.py": "import app.views\nclass Model:\n    pass\n\ndef load(a):\n    if a:\n        for b in a:\n            return b\n    return Model\n",
        "app/views.py": "from app.models import Model\n\n\ndef show(x):\n    # TODO: cache this\n" + long + "\n    return load(x)\n",
        "app/test_views.py": "from app.views import show\n\ndef test_show():\n    only_here(show(1))\n",
        "lib/index.js": "import a from './util'\nconst f = (x) => {\n  if (x && 1) { return { y: 2 } }\n  return 0\n}\n",
        "lib/util/index.js": "export function help(a) {\n  return a\n}\n",
        "examples/big.py": "import os\n" + long + "\n",
        "cfg/internal/a.go": "package a\n\nfunc Lonely() int {\n\treturn 1\n}\n\nfunc main() {\n}\n",
        "k.rb": "def twice(x)\n  if x\n    x.each do |y|\n      y\n    end\n  end\nend\n\ndef other?\n  1\nend\n",
    }
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_fixed_values():
    from lodestrata.functions.expressions import STOP_WORDS
    from lodestrata.operators import collectors as C
    from lodestrata.sources.globs import DEFAULT_EXCLUDES, DEMO_PATHS

    assert "that" in STOP_WORDS and "are" not in STOP_WORDS and len(STOP_WORDS) == 20
    assert {"GOPATH", "GOROOT", "NODE_ENV"} <= set(C.WELL_KNOWN) and len(C.WELL_KNOWN) == 11
    assert len(DEFAULT_EXCLUDES) == 17 and len(DEMO_PATHS) == 21
    assert {"fn", "impl", "defer"} <= set(C.KEYWORDS) and "bool" not in C.KEYWORDS


@pytest.mark.parametrize("path", ["a_test.go", "x/b.spec.tsx", "test_a.py", "a_test.py", "b_spec.rb", "test_b.rb", "FooSpec.kt", "src/test/java/a/B.java", "tests/x.rs", "benches/a/b.rs", "ATests.cs", "tests/a.php", "XSuite.scala", "a_test.exs", "Tests/a.swift"])
def test_test_files(spark, path):
    from lodestrata.functions.expressions import is_test_file

    assert spark.range(1).select(is_test_file(F.lit(path))).first()[0]


@pytest.mark.parametrize("path", ["a.go", "Test.java", "contest.py", "tests/x.py", "latest.rb", "src/main/java/Test.kt", "a.spec.py"])
def test_other_files(spark, path):
    from lodestrata.functions.expressions import is_test_file

    assert not spark.range(1).select(is_test_file(F.lit(path))).first()[0]


def test_paths_are_cleaned_before_they_are_judged(spark):
    from lodestrata.functions.expressions import clean_path
    from lodestrata.operators import signals as S

    want = {"a/../../etc": "../etc", "./a//b/": "a/b", "a/b/../..": ".", "..": "..", "../../x": "../../x", "a/..b": "a/..b"}
    rows = spark.createDataFrame([(p, "s", "t", 0.5) for p in want], "file_path string, source string, title string, confidence double")
    assert {r[0]: r[1] for r in rows.select("file_path", clean_path(F.col("file_path"))).collect()} == want
    assert {r.file_path for r in S.rejects(rows).where("reasons = 'traversal'").collect()} == {"a/../../etc", "..", "../../x"}


def test_functions(tree):
    from lodestrata.sources import code as Y

    got = {(r.path, r.name): (r.start, r.stop, r.lines, r.branches) for r in Y.functions(tree).collect()}
    assert got["app/models.py", "load"] == (5, 9, 4, 2)
    assert got["lib/index.js", "f"] == (2, 5, 2, 2)
    assert got["k.rb", "twice"] == (1, 7, 5, 1) and got["k.rb", "other?"] == (9, 11, 1, 0)
    assert got["cfg/internal/a.go", "Lonely"] == (3, 5, 1, 0)


def test_imports(tree):
    from lodestrata.operators.scan import lines_of
    from lodestrata.sources import code as Y

    got = {(r.src, r.dst) for r in Y.import_edges(lines_of(tree)).collect()}
    assert got == {("app.models", "app.views"), ("app.views", "app.models"), ("app.test_views", "app.views"), ("lib/index", "lib/util/index")}


def test_imports_are_dealt_out(spark, tmp_path):
    from lodestrata.operators.scan import lines_of
    from lodestrata.plans import roles as P
    from lodestrata.sources import code as Y

    files = {
        "a/b.py": "import a.c.d.e\nimport a.c\nfrom a.c.x import y\nimport a.b\nimport zz\nimport a.b.own\nimport a.c.d.e\n", "a/c.py": "import a\n", "a/c/d.py": "", "a.py": "import a.c..d\n", "n.py": None,
        "w/k.ts": "import x from './m'\nexport * from './k'\nconst q = require('../w/m/index')\nimport y from 'react'\n", "w/m.js": "", "w/m/index.js": "import n from '../k'\n",
        "j/k/A.java": "import static l.m.B;\nimport j.k.C;\n", "l/m/B.java": "", "r/one.rb": "require_relative 'two'\n", "r/two.rb": "", "p/x.php": "use q\\Y;\n", "q/Y.php": "", "src/u.rs": "use crate::v;\n", "src/v.rs": "", "c/x.c": '#include "c/y.h"\n', "c/y.h": "",
    }
    x = spark.createDataFrame(list(files.items()), "path string, content string")
    got = {(r.src, r.dst) for r in Y.import_edges(lines_of(x)).collect()}
    assert {e for e in got if e[0].startswith("a")} == {("a.b", "a.c.d"), ("a.b", "a.c"), ("a.c", "a"), ("a", "a.c")}
    assert {e for e in got if not e[0].startswith("a")} == {("w/k", "w/m"), ("w/k", "w/m/index"), ("w/m/index", "w/k"), ("j.k", "l.m"), ("r/one", "r/two"), ("p", "q"), ("u", "v"), ("c/x.c", "c/y.h")}
    spark.range(100).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    plan = Y.import_edges(lines_of(P.code_files(spark, str(tmp_path))))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(src") == 1


def test_dead_code(tree):
    from lodestrata.operators import scan as N

    got = {(r.kind, r.title): r.confidence for x in N.deadcode({"files": tree}, N.Options()) for r in x.collect()}
    assert got["unused-function", "Unused function: Lonely"] == 0.6
    assert ("unused-function", "Unused function: main") not in got and ("unused-function", "Unused function: load") not in got
    # show is mentioned in a test only
    assert got["unused-function", "Unused function: show"] == 0.3


def test_dead_code_is_never_gathered_in_the_driver(spark, tmp_path):
    from lodestrata.operators import collectors as C
    from lodestrata.operators import scan as N
    from lodestrata.plans import roles as P

    spark.range(100).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    dead = N.deadcode({"files": P.code_files(spark, str(tmp_path))}, N.Options())[0]
    assert "Broadcast" not in dead._jdf.queryExecution().executedPlan().toString()
    # a token's path is its own, another's, a test's or a null one
    at = [("once", "a", False), ("twice", "a", False), ("twice", "a", False), ("both", "a", False), ("both", "b", False), ("mixed", "a", False), ("mixed", "t", True), ("apart", "t", True), ("apart", "u", True), ("again", "t", True), ("again", "t", True), ("again", "u", True), ("lost", None, False)]
    tokens = spark.createDataFrame(at, "token string, path string, is_test boolean")
    named = spark.createDataFrame([(t, p) for t, p in (("once", "a"), ("once", "b"), ("twice", "a"), ("both", "a"), ("mixed", "a"), ("apart", "t"), ("apart", "a"), ("again", "t"), ("again", "u"), ("lost", None), ("never", "a"))], "symbol string, path string")
    got = {(r.symbol, r.path, r.test_only) for r in C.dead_symbols(named, tokens).collect()}
    assert got == {("once", "a", False), ("mixed", "a", True), ("apart", "t", True), ("apart", "a", True), ("again", "u", True), ("never", "a", False)}
    plain = {(r.symbol, r.path) for r in C.dead_symbols(named, tokens.drop("is_test")).collect()}
    assert plain == {("once", "a"), ("never", "a")}


def test_only_words_that_may_be_dead_symbols_are_grouped(spark, tmp_path):
    """Neither words that are no symbol nor each line of a common first word go into a shuffle."""
    from lodestrata import queries as Q
    from lodestrata.operators import collectors as C

    text = "\n".join(f"Common w{k} mentioned{k} x{k}" for k in range(3000))
    rows = [(1, f"{text}\nLonely begins\rNot a line\n\n  Inside\nOther", "s"), (2, f"{text}\n Other\nAlso\n", "s"), (3, "Null", None), (4, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sc = spark.sparkContext
    listed = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed())}
    before = stages()
    got = {(r.symbol, r.path, r.test_only) for r in Q.dead_symbols(spark, str(tmp_path)).collect()}
    assert got == {("Lonely", "s/1.md", False), ("Also", "s/2.md", False)}
    # the words of the bitmap do not grow with the input
    assert sum(n for k, n in stages().items() if k not in before) - getattr(C, "MARKED_WORDS", 0) < 2000


def test_code_files_are_made_on_all_cores(spark, tmp_path):
    from lodestrata.plans import roles as P

    spark.range(100).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = P.code_files(spark, str(tmp_path))
    files.write.parquet(f"{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("part-*"))) >= spark.sparkContext.defaultParallelism


def test_scan(tree, spark):
    from lodestrata.operators import scan as N

    commits = spark.createDataFrame([("app/views.py", "a", "2024-01-20 00:00:00")] * 12, "path string, author string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    roles = {"files": tree, "commits": commits}
    o = N.Options(now="2024-01-31 00:00:00")
    got = N.scan(roles, o).collect()
    kinds = {(r.kind, r.file_path) for r in got}
    assert {("todo", "app/views.py"), ("churn", "app/views.py"), ("circular-dependency", "app.models"), ("low-test-ratio", "app")} & kinds >= {("todo", "app/views.py"), ("churn", "app/views.py"), ("circular-dependency", "app.models")}
    assert len({r.signal_id for r in got}) == len(got)
    # the marker stands in a file that changes often
    assert next(r.confidence for r in got if r.kind == "todo") == pytest.approx(0.55)
    assert not any(r.kind == "missing-tests" and r.file_path.startswith("examples/") for r in got)
    assert any(r.kind == "missing-tests" and r.file_path.startswith("examples/") for r in N.collected(roles, N.Options(include_demos=True), ["patterns"]).collect())
    assert {r.file_path for r in N.scan(roles, o, names=["todos"], paths=("lib/**",)).collect()} == set()
    assert N.scan(roles, o, most=2).count() == 2
    assert N.chosen(exclude=("todos",), disabled=("gitlog",))[0] == "patterns" and N.chosen(include=("gitlog",), disabled=("gitlog",)) == ["gitlog"]
    with pytest.raises(ValueError):
        N.chosen(include=("nothing",))


def test_merged_clones(spark):
    from lodestrata.operators import collectors as C

    block = [f"line {i} of the block" for i in range(10)]
    rows = [(p, i + 1, t) for p, own in (("a", ["a1", *block, "a2"]), ("b", ["b1", "b2", *block])) for i, t in enumerate(own)]
    lines = spark.createDataFrame(rows, "path string, line int, text string")
    got = C.merged_clones(C.clone_windows(lines, 6), 6).collect()
    assert {(r.path, r.start, r.stop) for r in got} == {("a", 2, 11), ("b", 3, 12)}
    assert {(r.lines, r.locations, round(r.confidence, 6)) for r in got} == {(10, 2, 0.4)}


def test_clones_are_told_file_by_file(spark):
    from lodestrata.operators import collectors as C
    from lodestrata.operators.scan import lines_of

    block = [f"line {i} of the block" for i in range(9)]
    far, other = [f"far {i}" for i in range(4)], [f"other {i}" for i in range(5)]
    text = {
        "a": [*block, "", "# no line", *other, *far],
        "b": ["b", *other, *block, *far],
        "c": ["", *block[:6], "c"],
        "d": ["same"] * 7,
        "e": ["e", "same", "same", "same", "same", "x"],
    }
    files = spark.createDataFrame([(p, "\n".join(t) + "\n") for p, t in text.items()] + [("f", None), ("g", "")], "path string, content string")
    windows, want = C.file_windows(files, 4), C.clone_windows(C.normalised_lines(lines_of(files)), 4)
    assert windows.columns == want.columns and sorted(map(tuple, windows.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in windows._jdf.queryExecution().executedPlan().toString()
    got = {(r.path, r.start, r.stop, r.lines, r.locations) for r in C.merged_clones(windows, 4).collect()}
    # three files have the block's beginning; two have its end and the rest, which begins within four lines of each other
    three, two = {("a", 1, 6, 6, 3), ("b", 7, 12, 6, 3), ("c", 2, 7, 6, 3)}, {("a", 4, 20, 18, 2), ("b", 2, 19, 18, 2)}
    assert got == three | two | {("d", 1, 7, 7, 5), ("e", 2, 5, 7, 5)}


def test_links_are_seen_from_their_document(spark):
    from lodestrata.operators import collectors as C

    links = spark.createDataFrame([("docs/a.md", "b.md"), ("docs/a.md", "../x.md#top"), ("docs/a.md", "#here"), ("docs/a.md", "gone.md"), ("docs/a.md", "https://e.org")], "doc string, target string")
    files = spark.createDataFrame([("docs/b.md",), ("x.md",)], "path string")
    assert [r.target for r in C.broken_links(links, files).collect()] == ["gone.md"]


def test_retracted_versions(spark):
    from lodestrata.operators import collectors as C

    text = ["module m", "retract v1.0.0 // bad", "retract (", "\tv1.1.0", "\t[v1.2.0, v1.3.0] // range", ")", "require (", "\tx v9.9.9", ")"]
    x = spark.createDataFrame([("go.mod", i + 1, t) for i, t in enumerate(text)], "path string, line int, text string")
    assert [(r.line, r.title) for r in C.retracted_versions(x).orderBy("line").collect()] == [(2, "Retracted version: v1.0.0"), (4, "Retracted version: v1.1.0"), (5, "Retracted version: [v1.2.0, v1.3.0]")]


def test_source_folders(spark):
    from lodestrata.sources import code as Y

    docs = spark.createDataFrame([("docs/auth.md",), ("README.md",), ("docs/none.md",)], "doc string")
    files = spark.createDataFrame([("src/auth/a.go",), ("pkg/auth/b.go",), ("none",)], "path string")
    assert {tuple(r) for r in Y.source_folders(docs, files).collect()} == {("docs/auth.md", "src/auth"), ("README.md", ".")}


def test_states_and_documents(spark, tmp_path):
    from lodestrata.operators import state as D

    assert D.read_state(spark, str(tmp_path / "none")) is None
    a = spark.createDataFrame([("1", "a.go", 1, "t")], "signal_id string, file_path string, line int, title string")
    D.write_state(a, str(tmp_path / "s"), "0001")
    D.write_state(a.union(a), str(tmp_path / "s"), "0002")
    assert D.read_state(spark, str(tmp_path / "s")).count() == 2 and D.read_state(spark, str(tmp_path / "s"), "0001").count() == 1
    (tmp_path / "b.jsonl").write_text('{"id": "x-1", "title": "T", "priority": 2}\n{bad\n')
    with pytest.raises(Exception):
        D.read_backlog(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "s.sarif").write_text('{"runs": [{"results": [{"ruleId": "todo", "level": "note", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.go"}, "region": {"startLine": 3}}}], "partialFingerprints": {"k/v1": "abc"}}]}]}')
    r = D.read_sarif(spark, str(tmp_path / "s.sarif")).first()
    assert (r.rule, r.file_path, r.line, r.signal_id) == ("todo", "a.go", 3, "abc")


def test_leader_groups_are_led(spark):
    from lodestrata.operators import similarity as M

    rows = spark.createDataFrame([("p", 1, "fix the login page"), ("p", 2, "fix login page"), ("p", 3, "other words here"), ("q", 4, "fix login page")], "part string, ord long, title string")
    assert {(r.ord, r.leader) for r in M.leader_groups(rows).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_project_files(spark):
    from lodestrata.operators.scan import lines_of
    from lodestrata.sources import project as J

    files = spark.createDataFrame([("go.mod", "module m\n\ngo 1.22\n"), ("sub/Cargo.toml", ""), ("Makefile", "build: a\nX := 1\ntest:\n\tgo test\n"), (".gitattributes", "# c\n*.bin filter=lfs diff=lfs\nassets/*.png filter=lfs\n*.txt text\n")], "path string, content string")
    assert [(r.path, r.tool, r.version) for r in J.tools(files).orderBy("path").collect()] == [("Makefile", "Make", ""), ("go.mod", "Go", "1.22")]
    assert {r.target for r in J.make_targets(files).collect()} == {"build", "test"}
    globs = [r.pattern for r in J.stored_elsewhere(lines_of(files)).collect()]
    assert set(globs) == {"*.bin", "assets/*.png"}
    paths = spark.createDataFrame([("x/a.bin",), ("assets/b.png",), ("assets/c/d.png",), ("e.txt",)], "path string")
    assert {r.path for r in J.not_stored_elsewhere(paths, globs).collect()} == {"assets/c/d.png", "e.txt"}
    refs = spark.createDataFrame([("refs/heads/fix/a\t2024-01-02T03:04:05+00:00\tAda",), ("refs/remotes/o/x\t2024-01-02T03:04:05+00:00\tAda",)], "value string")
    assert [(r.name, r.author) for r in J.branch_refs(refs).collect()] == [("fix/a", "Ada")]
    log = spark.createDataFrame([("a" * 40 + "\tAda\t2024-01-02T03:04:05+00:00\t" + "b" * 40 + " " + "c" * 40 + "\tMerge\tx",)], "value string")
    r = J.commit_log(log).first()
    assert (r.author, r.is_merge, r.subject) == ("Ada", True, "Merge\tx")
    assert J.redacted("see tok-12345 and abc", {"GH_TOKEN": "tok-12345", "GITHUB_TOKEN": "abc"}) == "see [REDACTED] and abc"


def test_groups_by_directory(spark):
    from lodestrata.operators import similarity as M

    rows = spark.createDataFrame([("p", 1, "one thing", "a"), ("p", 2, "something else", "a"), ("p", 3, "third matter", "."), ("p", 4, "fourth item", ".")], "part string, ord long, title string, dir string")
    assert {(r.ord, r.leader) for r in M.leader_groups(rows).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_allowed_lines_hold_no_secrets(spark):
    from lodestrata.operators import collectors as C

    text = ['password = "hunter2hunter2"', 'password = "example-password"']
    lines = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(text)], "path string, line int, text string")
    files = spark.createDataFrame([("a", "x")], "path string, content string")
    assert [r.line for r in C.hygiene(lines, files, allowed=("example-",)).collect()] == [1]


def test_links_to_directories(spark):
    from lodestrata.operators import collectors as C

    links = spark.createDataFrame([("docs/a.md", "../src"), ("docs/a.md", "../lib")], "doc string, target string")
    assert [r.target for r in C.broken_links(links, spark.createDataFrame([("src/x/y.go",)], "path string")).collect()] == ["../lib"]


def test_workspaces_and_reports(spark):
    import json

    from lodestrata.sources import project as J
    from lodestrata.sources import sinks as K

    files = spark.createDataFrame([("packages/a/x.js",), ("packages/b/c/y.js",), ("tools/z.js",)], "path string")
    assert {r.dir for r in J.workspace_folders(files, ["packages/*"], ["packages/b"]).collect()} == {"packages/a"}
    assert {r.dir for r in J.workspace_folders(files, ["packages/**"]).collect()} == {"packages/a", "packages/b", "packages/b/c"}
    some = {"Files": files, "None": files.where("1 = 0")}
    text = K.report_text(some, most=2)
    assert "packages/a/x.js" in text and "and more" in text and "nothing found" in text
    assert [x["status"] for x in json.loads(K.report_json(some))["sections"]] == ["ok", "skipped"]
