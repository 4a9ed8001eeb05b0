"""Quality rules: word and line statistics, and robust multivariate outliers by language and source.

Each document becomes a vector of transformed statistics. For each language and
source a minimum-covariance-determinant estimate is found by concentration steps: the
``support`` share of rows nearest to the present centre give the next mean and
covariance. Steps begin from three centres (the quartiles of each statistic); after
``first_steps`` the start with the least determinant goes on until no group's
determinant falls by more than ``settled``, at most ``steps`` times. All rows take part
in every step. A document is rejected when its squared Mahalanobis distance exceeds the
limit.

A step is two partially aggregated group-bys. Rows meet their group's estimate by a
broadcast if the group holds more than one in ``HEAVY`` rows (fewer than that many
groups do), all others by a shuffle on the group: no hot source is dealt to one task.

Groups of fewer than ``min_rows`` rows use the estimate of their language, or else
of all documents. Estimates rest on the statistics that there are: a form of document
that is rare in its group, such as tables, is an outlier there.

Defined results: null and empty texts have no words, all counts 0, and fail the base
rules; null language or source form groups of their own; repeated rows and repeated
ids are judged one by one; empty tables give empty results; columns of the input may
have any names, they are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._cluster import fresh_name, key_of, map_arrow, met, written

FEATURES = ("word_length", "symbols", "repeats", "duplicate_lines", "capitals", "exclamations")
#: Deviations below these are not told apart: they are added, squared, to each group's variances.
FLOORS = (0.06, 0.06, 0.10, 0.12, 0.15, 0.10)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_letters_ascii long, n_exclamations long"
N_STATS = 9
#: Groups of a larger share of all rows than one in so many are broadcast to their rows.
HEAVY = 1024
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Share of a group's rows that each concentration step keeps.
    support: float = 0.6
    first_steps: int = 2
    steps: int = 10
    #: By how much of itself a determinant must fall for another step.
    settled: float = 0.01
    #: Probability that a document drawn from the fitted normal distribution is kept.
    keep: float = 0.999
    min_rows: int = 60


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of the counts in STATS for each text."""
    out = np.zeros((len(texts), N_STATS), np.int64)
    for lo, hi, buf, starts in A.blocks(texts):
        n = hi - lo
        ws, we = A.word_bounds(buf)
        owner = np.searchsorted(starts, ws, "right") - 1
        words = np.bincount(owner, minlength=n)[:n]
        inner = starts[:-1]
        total = lambda mask: np.add.reduceat(mask, inner, dtype=np.int64)
        hashes = A.span_hashes(buf, ws, we)
        out[lo:hi, 0] = words
        out[lo:hi, 1] = total(A.code_points(buf) & ~A._SPACE[buf])
        out[lo:hi, 2] = total(_SYMBOL[buf])
        out[lo:hi, 6] = total((buf >= 65) & (buf <= 90))
        out[lo:hi, 7] = total(((buf | 32) >= 97) & ((buf | 32) <= 122))
        out[lo:hi, 8] = total(buf == 33)

        ends = np.flatnonzero(buf == 10)
        begins = np.concatenate(([0], ends[:-1] + 1))
        held = np.searchsorted(ws, ends) > np.searchsorted(ws, begins)
        begins, ends = begins[held], ends[held]
        line_owner = np.searchsorted(starts, begins, "right") - 1
        line_hash = A.span_hashes(buf, begins, ends) if len(begins) else np.empty(0, np.uint64)
        tri, at = A.windows(hashes, owner, 3)
        covered = np.zeros(len(ws) + 3, bool)
        # equal windows of one document: sort by a hash of document and window
        for h, own in ((line_hash, line_owner), (tri, owner[at])):
            if not len(h):
                continue
            k = A.mix64(h ^ A.mix64(own.astype(np.uint64)))
            order = np.argsort(k, kind="stable")
            s = k[order]
            same = s[1:] == s[:-1]
            if h is line_hash:
                out[lo:hi, 3] = np.bincount(own[order[1:][same]], minlength=n)[:n]
                out[lo:hi, 5] = np.bincount(own, minlength=n)[:n]
            else:
                twice = np.zeros(len(h), bool)
                twice[1:] = same
                twice[:-1] |= same
                hit = at[order[twice]]
                for d in range(3):
                    covered[hit + d] = True
        out[lo:hi, 4] = np.bincount(owner[covered[: len(ws)]], minlength=n)[:n]
    return out


def _struct_type():
    from pyspark.sql import types as T

    return T._parse_datatype_string(STATS)


def with_statistics(docs: DataFrame, text: str = "text", *, as_column: str, keep_text: bool) -> DataFrame:
    """Adds a struct column of STATS computed from whole texts; without keep_text the text column is dropped."""
    import pyarrow as pa

    fields = [f.strip().split()[0] for f in STATS.split(",")]
    from pyspark.sql import types as T

    schema = T.StructType([f for f in docs.schema.fields if keep_text or f.name != text])
    schema = schema.add(as_column, _struct_type())

    def run(batches):
        for b in batches:
            s = statistics(A.as_bytes(b.column(b.schema.get_field_index(text))))
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names) if keep_text or n != text}
            cols[as_column] = pa.StructArray.from_arrays([pa.array(s[:, i]) for i in range(N_STATS)], names=fields)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return map_arrow(docs, run, schema)


def feature_columns(s: str) -> list[Column]:
    """The transformed statistics; s names the struct of STATS. 0 for documents without words."""
    c = lambda n: F.col(f"`{s}`.{n}").cast("double")
    words, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    return [
        F.log(F.greatest(c("word_chars"), F.lit(1.0)) / words),
        F.log1p(c("n_symbols") / words),
        c("n_repeat_words") / words,
        F.greatest(c("n_dup_lines") - 1, F.lit(0.0)) / lines,
        c("n_capitals") / F.greatest(c("n_letters_ascii"), F.lit(1.0)),
        F.log1p(c("n_exclamations") / words),
    ]


P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi2_quantile(q: float, p: int) -> float:
    """Wilson and Hilferty's approximation."""
    z = NormalDist().inv_cdf(q)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def squared_distance(x: str, mean: str, inverse: str) -> Column:
    """x and mean: array columns of P doubles; inverse: the symmetric inverse covariance, row by row."""
    d = [F.col(x)[i] - F.col(mean)[i] for i in range(P)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(inverse)[i * P + j] * d[i] * d[j]
    return total


def dealt(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """left joined with right, a row a group that has its number of rows in ``size``: large groups by broadcast, others by shuffle."""
    total = right.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) > total / HEAVY
    heavy, light = F.broadcast(right.where(large)), right.where(~large)  # heavy: fewer than HEAVY rows
    out = left.join(heavy, key)
    if light.isEmpty():
        return out
    return out.unionByName(met(left.join(heavy.select(key).distinct(), key, "left_anti"), light, key))


def _inverses(moments: DataFrame) -> DataFrame:
    """One row an estimate with n, sums and products of features gives its mean, inverse covariance and the logarithm of the determinant; rows are independent."""
    floors = np.diag(np.square(FLOORS))

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for g, start, size, n, s, q in zip(f["g"], f["start"], f["size"], f["n"], f["s"], f["q"], strict=True):
                mean = np.asarray(s, float) / n
                cov = np.zeros((P, P))
                for k, (i, j) in enumerate(PAIRS):
                    cov[i, j] = cov[j, i] = q[k] / n - mean[i] * mean[j]
                cov += floors
                rows.append((g, start, size, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(rows, columns=["g", "start", "size", "mean", "inverse", "det"])

    return moments.mapInPandas(run, "g string, start int, size long, mean array<double>, inverse array<double>, det double")


def _step(member: DataFrame, params: DataFrame, rules: QualityRules) -> DataFrame:
    """member(g, x), params(g, start, size, mean, inverse): a concentration step of every estimate."""
    distance = squared_distance("x", "mean", "inverse")
    key = ["g", "start"]
    limit = dealt(member, params, "g", "size").select(*key, distance.alias("d")).groupBy(*key).agg(F.percentile_approx("d", F.lit(rules.support), F.lit(2000)).alias("limit"))
    limited = written(params.select("g", "start", "size", "mean", "inverse").join(limit, key))
    near = dealt(member, limited, "g", "size").where(distance <= F.col("limit"))
    moments = near.groupBy("g", "start", "size").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(P)]).alias("s"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS]).alias("q"),
    )
    return written(_inverses(moments))


def fit(vectors: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """vectors: lang_key, source_key, x array<double>. Gives g, size (rows of the group), mean, inverse, factor: a row for each language and source."""
    levels = group_keys(F.col("lang_key"), F.col("source_key"))
    member = vectors.select("x", F.explode(F.array(*levels)).alias("g"))
    each = [F.col("x")[i] for i in range(P)]
    quart = member.groupBy("g").agg(F.count(F.lit(1)).alias("size"), *[F.percentile_approx(e, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, e in enumerate(each)])
    var = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2 for i in range(P)]
    diagonal = F.array(*[(1 / var[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.array(*[F.col(f"q{i}")[k] for i in range(P)]).alias("mean")) for k in range(3)]))
    params = written(quart.select("g", "size", starts.alias("s"), diagonal.alias("inverse")).select("g", "size", "s.start", "s.mean", "inverse"))
    for _ in range(rules.first_steps):
        params = _step(member, params, rules)
    best = F.min_by(F.struct("start", "size", "mean", "inverse", "det"), F.struct("det", "start")).alias("p")
    params = written(params.groupBy("g").agg(best).select("g", "p.*"))
    for _ in range(rules.steps - rules.first_steps):
        new = _step(member, params, rules)
        fall = new.join(params.select("g", F.col("det").alias("before")), "g").agg(F.max(F.col("before") - F.col("det"))).first()[0]
        params = new
        if fall is None or fall <= rules.settled:
            break
    far = dealt(member, params, "g", "size").select("g", squared_distance("x", "mean", "inverse").alias("d"))
    # half of a normal sample lies within the median of chi square: scales the shrunken covariance
    scale = far.groupBy("g").agg(F.percentile_approx("d", F.lit(0.5), F.lit(2000)).alias("mid"))
    factor = F.least(F.lit(1.0), chi2_quantile(0.5, P) / F.greatest("mid", F.lit(1e-12)))
    every = written(params.join(scale, "g").select("g", "size", F.struct("mean", "inverse", factor.alias("factor"), F.col("size").alias("rows")).alias("own")))
    # what each language and source uses: its own estimate, that of the language, or that of all
    groups = vectors.groupBy("lang_key", "source_key").agg(F.count(F.lit(1)).alias("size"))
    for k, level in enumerate(levels):
        groups = groups.withColumn(f"g{k}", level).join(every.select(F.col("g").alias(f"g{k}"), F.col("own").alias(f"p{k}")), f"g{k}", "left")
    enough = lambda k: F.col(f"p{k}.rows") >= rules.min_rows
    used = F.when(enough(0), F.col("p0")).when(enough(1), F.col("p1")).otherwise(F.col("p2"))
    return written(groups.select(F.col("g0").alias("g"), "size", used.alias("p")).select("g", "size", "p.mean", "p.inverse", "p.factor"))


def group_keys(lang: Column, source: Column) -> list[Column]:
    """Of the language and source, of the language, of all."""
    return [F.concat_ws("\t", F.lit("2"), lang, source), F.concat_ws("\t", F.lit("1"), lang), F.lit("0")]


def judged(rows: DataFrame, fits: DataFrame, stats: str, lang: str, source: str, rules: QualityRules = QualityRules()) -> tuple[DataFrame, Column, Column, Column]:
    """Rows that carry the struct of STATS with helper columns of fresh names; and the base verdict, the squared distance, and the final verdict."""
    x, g, mean, inverse, factor, size = (fresh_name(rows, f"__{n}") for n in ("x", "g", "mean", "inverse", "factor", "size"))
    own = rows.withColumn(x, F.array(*feature_columns(stats))).withColumn(g, group_keys(key_of(lang), key_of(source))[0])
    out = dealt(own, fits.select(*[F.col(c).alias(n) for c, n in zip(("g", "size", "mean", "inverse", "factor"), (g, size, mean, inverse, factor), strict=True)]), g, size)
    words, repeats = F.col(f"`{stats}`.n_words"), F.col(f"`{stats}`.n_repeat_words")
    failed = (words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * words)
    distance = squared_distance(x, mean, inverse) * F.col(factor)
    return out, failed, distance, ~failed & (distance <= chi2_quantile(rules.keep, P))


def _vectors(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row a document: doc_id, counts, base_failed, distance, kept."""
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    stats = written(with_statistics(own, as_column="stats", keep_text=False))
    fits = fit(stats.select(key_of("lang").alias("lang_key"), key_of("source").alias("source_key"), F.array(*feature_columns("stats")).alias("x")), rules)
    rows, failed, distance, kept = judged(stats, fits, "stats", "lang", "source", rules)
    return rows.select("doc_id", "stats.*", failed.alias("base_failed"), distance.alias("distance"), kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that are kept, with their columns unchanged."""
    stats = written(with_statistics(_vectors(docs, text, lang, source), as_column="stats", keep_text=False))
    fits = fit(stats.select(key_of("lang").alias("lang_key"), key_of("source").alias("source_key"), F.array(*feature_columns("stats")).alias("x")), rules)
    name = fresh_name(docs, "__quality")
    rows, _, _, kept = judged(with_statistics(docs, text, as_column=name, keep_text=True), fits, name, lang, source, rules)
    return rows.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
