"""Personal data: patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, payment cards and telephone numbers.
They are the protected entities. A term is a run of letters (ASCII letters and all
other characters beyond ASCII), compared with A to Z in lower case. From the whole
corpus: in how many documents a term occurs, in how many of them it stands within
``near_words`` terms of an entity of a kind, and near each single entity. A term
discloses a kind of entity, or one entity, if the share of its documents in which it
stands near one reaches a threshold, and if that share is no chance: the log-likelihood
ratio, in bits, against a term that falls on places near such entities, or near this
one, as often as any place does. Support is counted in rows, copies and repeated rows
among them, everywhere alike. The evidence grows with the documents, so it can be
reached however frequent a kind is. Wherever such a term occurs, it is a span of kind ``term``; ``sanitised``
generalises spans to their kind, and removes terms beyond a second threshold.

Only fixed-size bitmaps of term hashes are broadcast; what passes them is joined
exactly, so any number of terms may be disclosing.

Defined results: null texts are empty and have no spans; of repeated rows each has the
same spans; a null id is an id of its own; an empty corpus discloses nothing. Spans are
in code points, end exclusive. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._cluster import fresh_name, written

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does, which finds the same as without that condition, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile("[A-Za-z\u0080-\U0010ffff]+")
#: Marks of the bitmaps of term hashes.
BITS = 22
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Disclosure:
    near_words: int = 3
    #: Shorter terms, in UTF-8 bytes, disclose nothing.
    term_bytes: int = 4
    #: Documents in which a term has to stand near an entity.
    documents: int = 3
    share: float = 0.6
    #: Evidence, as a log-likelihood ratio, that a term is a span, and that it is removed.
    bits: float = 5.0
    remove_bits: float = 9.0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is all that may stand before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def nearby_terms(text: str, start: int, end: int, d: Disclosure) -> list[tuple[int, str]]:
    """The nearest whole terms on either side and where they begin; at most a few hundred characters away."""
    reach = 64 * d.near_words
    lo = max(0, start - reach)
    left = [(lo + m.start(), m[0]) for m in TERM.finditer(text[lo:start])]
    if start > reach and left and TERM.match(text, start - reach - 1):
        left = left[1:]
    right = [(end + m.start(), m[0]) for m in TERM.finditer(text[end : end + reach])]
    if end + reach < len(text) and right and TERM.match(text, end + reach):
        right = right[:-1]
    return [(at, t.translate(ASCII_LOWER)) for at, t in left[-d.near_words :] + right[: d.near_words] if len(t.encode()) >= d.term_bytes]


def near_rows(text: str, spans: list[tuple[int, int, int]], d: Disclosure) -> list[dict]:
    """One row a place near an entity. 1 or 0: new and own, whether the place was not yet near the kind or this entity; of_kind and of_entity, whether the term was not."""
    out, seen = [], set()

    def first(*what) -> int:
        fresh = what not in seen
        seen.add(what)
        return int(fresh)

    for s, k, e in spans:
        entity = text_key(text[s:e])
        for at, x in nearby_terms(text, s, e, d):
            out.append({"term": x, "kind": k, "entity": entity, "new": first("new", k, at), "own": first("own", k, entity, at), "of_kind": first("kind", x, k), "of_entity": first("entity", x, k, entity)})
    return out


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


BASE = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:int,kind:int,end:int>>, near array<struct<term:string,kind:int,entity:long,new:int,own:int,of_kind:int,of_entity:int>>"


def found(docs: DataFrame, d: Disclosure) -> DataFrame:
    """docs(doc_id, text): base spans of each document, and the terms near them."""

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        close = pa.list_(pa.struct([("term", pa.string()), ("kind", pa.int32()), ("entity", pa.int64()), *((n, pa.int32()) for n in ("new", "own", "of_kind", "of_entity"))]))
        for b in batches:
            keys, counts, base, near = [], [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                spans = base_spans(t)
                keys.append(text_key(t))
                counts.append([sum(k == n for _, k, _ in spans) for n in range(4)])
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                near.append(near_rows(t, spans, d))
            c = np.array(counts, np.int64).reshape(-1, 4)
            cols = [b.column(0), pa.array(keys, pa.int64()), *(pa.array(c[:, n]) for n in range(4)), pa.array(base, span), pa.array(near, close)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", "near"])

    return docs.mapInArrow(run, BASE)


def marks(terms: DataFrame) -> np.ndarray:
    """A bitmap of a fixed size in which the terms' hashes are set."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            h = term_hashes(A.as_bytes(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64))], names=["at"])

    words = terms.select("term").mapInArrow(run, "at long").groupBy((F.col("at") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("m")).collect()  # at most 2**BITS / 64 rows
    out = np.zeros((1 << BITS) // 64, np.int64)
    for r in words:
        out[r["w"]] = r["m"]
    return out


def term_hashes(terms: list[bytes]) -> np.ndarray:
    out = np.empty(len(terms), np.uint64)
    for lo, hi, buf, starts in A.blocks(terms):
        out[lo:hi] = A.span_hashes(buf, starts[:-1], starts[1:] - 1) >> np.uint64(64 - BITS)
    return out


class Matcher:
    """Occurrences in texts of terms whose hashes are marked."""

    def __init__(self, bitmap: np.ndarray, d: Disclosure):
        self.set = np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)
        self.least = d.term_bytes
        #: Terms seen so far, marked or not.
        self.places = 0

    def __call__(self, texts: list[bytes]):
        """Yields (text's number, term, start, end in code points)."""
        for lo, _, buf, starts in A.blocks(texts):
            buf = A.lower_ascii(buf)
            letter = LETTER[buf]
            edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
            if letter[0]:
                edge = np.concatenate(([0], edge))
            s, e = edge[0::2], edge[1::2]
            ok = e - s >= self.least
            s, e = s[ok], e[ok]
            self.places += len(s)
            if not len(s):
                continue
            hit = np.flatnonzero(self.set[(A.span_hashes(buf, s, e) >> np.uint64(64 - BITS)).astype(np.int64)])
            if not len(hit):
                continue
            point = np.concatenate(([0], np.cumsum(A.code_points(buf))))
            owner = np.searchsorted(starts, s[hit], "right") - 1
            for k, o in zip(hit.tolist(), owner.tolist(), strict=True):
                first = point[starts[o]]
                yield lo + o, buf[s[k] : e[k]].tobytes().decode("utf-8", "replace"), int(point[s[k]] - first), int(point[e[k]] - first)


def disclosing(docs: DataFrame, base: DataFrame, d: Disclosure) -> DataFrame:
    """(term, bits): terms that reach the thresholds for some kind of entity or some entity."""
    seen = base.select(F.explode("near").alias("x")).select("x.*")
    enough = F.col("near") >= d.documents
    by_kind = seen.groupBy("term", "kind").agg(F.sum("of_kind").alias("near")).where(enough)
    by_entity = seen.groupBy("term", "kind", "entity").agg(F.sum("of_entity").alias("near")).where(enough)
    of_kind = seen.groupBy("kind").agg(F.sum("new").alias("places"))  # at most four rows
    of_entity = seen.groupBy("kind", "entity").agg(F.sum("own").alias("places"))
    wanted = ["term", "near", "places"]
    asked = written(by_kind.join(F.broadcast(of_kind), "kind").select(*wanted).union(by_entity.join(of_entity, ["kind", "entity"]).select(*wanted)))
    bitmap = marks(asked.select("term").distinct())

    def run(batches):
        import pyarrow as pa

        match = Matcher(bitmap, d)
        for b in batches:
            count: dict[str, list[int]] = {}
            last: dict[str, int] = {}
            before = match.places
            for o, term, _, _ in match(A.as_bytes(b.column(0))):
                c = count.setdefault(term, [0, 0])
                c[0] += last.get(term) != o
                c[1] += 1
                last[term] = o
            rows = [(None, 0, match.places - before), *((t, n, m) for t, (n, m) in count.items())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["term", "n", "m"])

    # how often each asked term occurs; the row without a term has the occurrences of all terms
    occurring = written(docs.select("text").mapInArrow(run, "term string, n long, m long").groupBy("term").agg(F.sum("n").alias("docs"), F.sum("m").alias("times")))
    every = occurring.where("term is null").select("times").first()
    places = float(every["times"]) if every else 0.0
    told = asked.join(occurring.where("term is not null"), "term").where(F.col("near") >= d.share * F.col("docs"))
    told = told.withColumn("bits", evidence(F.col("near"), F.col("docs"), F.col("times"), F.col("places") / max(places, 1.0))).where(F.col("bits") >= d.bits)
    return written(told.groupBy("term").agg(F.max("bits").alias("bits")))


def evidence(near, docs, times, place):
    """Bits of a log-likelihood ratio: near of docs documents, against the chance that one of the term's occurrences in a document is among the share place of all places; none below chance."""
    chance = F.least(1 - F.pow(1 - F.least(place, F.lit(1.0)), times / docs), F.lit(1 - 1e-9))
    share = F.least(near / docs, F.lit(1.0))
    rest = F.when(share < 1, (1 - share) * F.log2((1 - share) / (1 - chance))).otherwise(0.0)
    return F.when(share > chance, docs * (share * F.log2(share / chance) + rest)).otherwise(0.0)


def spans(docs: DataFrame, id: str = "doc_id", text: str = "text", d: Disclosure = Disclosure()) -> DataFrame:
    """One row a document: doc_id, text_key, counts of base kinds, base, terms (arrays of start, kind, end)."""
    own = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    base = written(found(own, d))
    terms = disclosing(own, base, d)
    bitmap = marks(terms)

    def run(batches):
        import pyarrow as pa

        match = Matcher(bitmap, d)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), A.as_bytes(b.column(1))
            rows = list(match(texts))
            keys = {o: text_key(texts[o].decode("utf-8", "replace")) for o in {r[0] for r in rows}}
            cols = [[ids[o] for o, *_ in rows], [keys[o] for o, *_ in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "text_key", "term", "start", "end"])

    hits = own.mapInArrow(run, "doc_id long, text_key long, term string, start int, end int").join(terms, "term")
    per_doc = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end", "bits")).alias("terms"))
    both = base.drop("near").join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k")
    return both


def joined_spans(c):
    """kind:start:end, sorted by start and kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def all_spans():
    plain = F.transform(F.coalesce("terms", F.expr("array()")), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat(F.col("base"), plain))


def sanitised(docs: DataFrame, id: str = "doc_id", text: str = "text", d: Disclosure = Disclosure()) -> DataFrame:
    """The documents with their columns; spans give way to their kind in brackets, terms beyond remove_bits to nothing."""
    every = F.transform(F.coalesce("terms", F.expr("array()")), lambda x: F.struct(x["start"].alias("start"), F.when(x["bits"] >= d.remove_bits, 5).otherwise(x["kind"]).alias("kind"), x["end"].alias("end")))
    cut = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat(F.col("base"), every))
    key, d_, k_, cut_ = (fresh_name(docs, x) for x in ("__text_key", "__d", "__k", "__cut"))
    marked = spans(docs, id, text, d).select(F.col("doc_id").alias(d_), F.col("text_key").alias(k_), cut.alias(cut_)).where(F.size(cut_) > 0).dropDuplicates([d_, k_])

    @F.pandas_udf("long")
    def keyed(s):
        return s.fillna("").map(text_key)

    @F.pandas_udf("string")
    def replaced(s, cuts):
        import pandas as pd

        return pd.Series([t if c is None else redacted(t or "", [(x["start"], x["kind"], x["end"]) for x in c]) for t, c in zip(s, cuts, strict=True)])

    whole = F.col(f"`{text}`")
    rows = docs.withColumn(key, keyed(whole)).join(marked, F.col(f"`{id}`").cast("long").eqNullSafe(F.col(d_)) & (F.col(key) == F.col(k_)), "left")
    new = F.when(F.col(cut_).isNull(), whole).otherwise(replaced(whole, F.col(cut_)))
    return rows.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def redacted(text: str, cuts: list[tuple[int, int, int]]) -> str:
    """Overlapping spans become one, named after the first."""
    out, at = [], 0
    for s, k, e in sorted(cuts):
        if s >= at:
            out += [text[at:s], "" if k == 5 else f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
