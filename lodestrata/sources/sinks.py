"""Sinks: signals as backlog lines, SARIF documents, Markdown and tasks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import priority

# The type of a backlog item by kind; all others are tasks.
TYPES = {"bug": "bug", "fixme": "bug", "hack": "chore", "xxx": "chore", "optimize": "chore"}
LEVELS = ("error", "warning", "note", "none")


def backlog_lines(signals: DataFrame, prefix: str = "str-") -> DataFrame:
    """value: one JSON object a signal (with signal_id), ready to be written as text."""
    place = F.when(F.col("line") > 0, F.concat_ws(":", "file_path", F.col("line").cast("string"))).otherwise(F.col("file_path"))
    kind = F.coalesce(*[F.when(F.col("kind") == k, t) for k, t in TYPES.items()], F.lit("task"))
    row = F.struct(
        F.concat(F.lit(prefix), "signal_id").alias("id"),
        F.col("title"),
        F.concat(F.lit("Location: "), place).alias("description"),
        kind.alias("type"),
        priority(F.col("confidence")).alias("priority"),
        F.lit("open").alias("status"),
        F.array_distinct(F.array("kind", F.lit("generated"), "source")).alias("labels"),
    )
    return signals.select(F.to_json(row).alias("value"))


def sarif_rules(signals: DataFrame) -> DataFrame:
    """kind, rule_index, results, level of the most urgent result."""
    g = signals.groupBy("kind").agg(F.count(F.lit(1)).alias("results"), F.min(priority(F.col("confidence"))).alias("p"))
    return g.select("kind", (F.dense_rank().over(Window.orderBy("kind")) - 1).alias("rule_index"), "results", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("p")).alias("level"))


def sarif(signals: DataFrame, tool: str = "lodestrata") -> str:
    """A SARIF 2.1.0 document; rows come to the driver, as a document is one file."""
    rules = {r["kind"]: r["rule_index"] for r in sarif_rules(signals).collect()}
    results = [
        {"ruleId": r["kind"], "ruleIndex": rules[r["kind"]], "level": LEVELS[r["p"] - 1], "rank": r["confidence"] * 100, "message": {"text": r["title"]}, "partialFingerprints": {"signalId/v1": r["signal_id"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file_path"]}, "region": {"startLine": max(1, r["line"])}}}]}
        for r in signals.withColumn("p", priority(F.col("confidence"))).orderBy("file_path", "line", "title").toLocalIterator()
    ]
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": k} for k in sorted(rules)]}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})


def markdown(signals: DataFrame) -> str:
    out = ["# Signals", ""]
    last = None
    for r in signals.orderBy("source", "file_path", "line", "title").toLocalIterator():
        if r["source"] != last:
            last = r["source"]
            out += [f"## {last}", ""]
        out.append(f"- **{r['title']}** `{r['file_path']}:{r['line']}` ({r['confidence']:.2f})")
    return "\n".join(out) + "\n"


def envelope(signals: DataFrame, generated_at: str) -> str:
    rows = [json.loads(r["j"]) for r in signals.orderBy("source", "file_path", "line", "title").select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    return json.dumps({"signals": rows, "metadata": {"total": len(rows), "collectors": sorted({r["source"] for r in rows}), "generated_at": generated_at}})


def tasks(signals: DataFrame) -> DataFrame:
    """value: one JSON object a signal (with signal_id), as a list of tasks shows it."""
    named = F.lower("title").startswith(F.concat("kind", F.lit(":")))
    subject = F.when(named, F.col("title")).otherwise(F.concat_ws(": ", F.upper("kind"), "title"))
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("kind"), F.col("kind"), F.lit("file"), F.coalesce("file_path", F.lit("")), F.lit("signal_id"), F.col("signal_id"), F.lit("confidence"), F.format_number("confidence", 2))
    return signals.select(F.to_json(F.struct(subject.alias("subject"), F.concat(F.lit("Working on "), F.col("title")).alias("activeForm"), F.lit("pending").alias("status"), meta.alias("metadata"))).alias("value"))


def html(signals: DataFrame, title: str = "Signals") -> str:
    """One page: counts by source and kind, then a table of all signals."""
    from html import escape

    counts = signals.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy("source", F.desc("n"), "kind").toLocalIterator()
    head = "".join(f"<tr><td>{escape(r['source'])}</td><td>{escape(r['kind'])}</td><td>{r['n']}</td></tr>" for r in counts)
    rows = signals.orderBy("source", "file_path", "line", "title").toLocalIterator()
    body = "".join(f"<tr><td>{escape(r['kind'])}</td><td>{escape(r['file_path'] or '')}:{r['line']}</td><td>{escape(r['title'])}</td><td>{r['confidence']:.2f}</td></tr>" for r in rows)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{head}</table><table>{body}</table></body></html>"


def report_text(sections: dict[str, DataFrame], most: int = 50) -> str:
    """Sections as aligned text tables; a section is a report's, of few rows, of which ``most`` are shown and the rest counted."""
    out = []
    for title, df in sections.items():
        rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(most + 1).collect()]
        more = len(rows) > most
        table = [list(df.columns), *rows[:most]]
        widths = [max(len(r[k]) for r in table) for k in range(len(df.columns))]
        lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in table]
        out.append("\n".join([title, "-" * len(title), *(lines if rows else ["nothing found"]), *(["and more"] if more else [])]))
    return "\n\n".join(out) + "\n"


def report_json(sections: dict[str, DataFrame], most: int = 50) -> str:
    """Sections as JSON: status ok with rows, or skipped where there are none."""
    rows = {t: [json.loads(x) for x in (r[0] for r in df.limit(most).select(F.to_json(F.struct(*df.columns))).collect())] for t, df in sections.items()}
    return json.dumps({"sections": [{"name": t, "status": "ok" if r else "skipped", "rows": r} for t, r in rows.items()]}, ensure_ascii=False, indent=2)
