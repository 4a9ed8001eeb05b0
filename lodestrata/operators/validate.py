"""Checks of backlog lines, field by field, with suggestions for misspelt values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the fields may hold.
ITEM_TYPES = ("task", "bug", "feature", "epic", "chore")
STATES = ("open", "in_progress", "blocked", "closed")


def _nearest(value: Column, allowed: tuple[str, ...]) -> Column:
    best = F.array_min(F.array(*[F.struct(F.levenshtein(F.lower(value), F.lit(a)).alias("d"), F.lit(a).alias("a")) for a in allowed]))
    return F.when(best["d"] <= 3, F.concat(F.lit("; did you mean "), best["a"], F.lit("?"))).otherwise("")


def line_errors(lines: DataFrame) -> DataFrame:
    """lines(line, value): line, field, message for each fault; blank lines are none."""
    text = lambda k: F.get_json_object("value", f"$.{k}")
    broken = F.try_parse_json("value").isNull() | ~F.btrim("value", F.lit(" \t\r")).startswith("{")
    err = lambda field, when, message: F.when(when, F.struct(F.lit(field).alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message")))
    missing = [err(k, F.coalesce(F.trim(text(k)), F.lit("")) == "", "is required") for k in ("id", "title")]
    kind, state, level = text("type"), text("status"), text("priority")
    checks = [
        *missing,
        err("type", kind.isNotNull() & ~kind.isin(*ITEM_TYPES), F.concat(F.lit("unknown type "), kind, _nearest(kind, ITEM_TYPES))),
        err("status", state.isNotNull() & ~state.isin(*STATES), F.concat(F.lit("unknown status "), state, _nearest(state, STATES))),
        err("priority", level.isNotNull() & ~level.rlike("^[0-4]$"), "must be an integer from 0 to 4"),
        *[err(k, text(k).isNotNull() & F.try_to_timestamp(text(k)).isNull(), "is not an ISO 8601 time") for k in ("created_at", "updated_at", "closed_at")],
        err("labels", text("labels").isNotNull() & F.from_json(text("labels"), "array<string>").isNull(), "must be a list of strings"),
    ]
    x = lines.where(F.btrim("value", F.lit(" \t\r")) != "")
    found = F.when(broken, F.array(F.struct(F.lit("").alias("field"), F.lit("is not a JSON object").alias("message")))).otherwise(F.array_compact(F.array(*checks)))
    return x.select("line", F.explode(found).alias("e")).select("line", "e.field", "e.message")
