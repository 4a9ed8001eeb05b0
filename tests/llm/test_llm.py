"""The training-data operators against brute force on small fixtures, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta. " * 3 + "\nA line that comes again.\nOther words stand here.", "en", "a"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta. " * 3 + "\nA line that comes again.\nOther words stand here.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "ñandú über é 中文 字 words\n\n  \n" + "mail me at x.y@mail.example.com or +1 (555) 010-9999", "de", "b"),
    (5, "ñandú über é 中文 字 words\n\n  \n" + "mail me at x.y@mail.example.com or +1 (555) 010-9999", "de", "b"),
    (None, "a row without an id", "fr", None),
    (6, "w" * 30_000, "en", "a"),
    (7, " ".join(f"tok{i % 97}" for i in range(6000)), "en", "a"),
    (8, "one two three", "en", "c"),
    (9, "one two three", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1.5, 7) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, score double, size long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_fingerprints(spark, docs, none):
    from lodestrata.llm import fingerprint as FP

    got = FP.with_successor_edits(docs).collect()
    assert len(got) == len(ROWS) and FP.with_successor_edits(none).count() == 0
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, r in enumerate(order):
        t, u = r[1] or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want[r[0], len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((g.doc_id, g.n_chars, g.edited_sha256) for g in got) == want
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    codes = FP.digests([b"some text that is long enough", b"some text that is long enough", b""])
    assert (codes[0] == codes[1]).all() and FP.likeness(codes[:1], codes[1:2])[0] == 1
    assert (FP.decode(FP.encode(codes)[0]) == codes[0]).all()


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    from lodestrata.llm import packing as K

    t = Tokenizer.from_file(K.default_tokenizer())
    odd = ["<|endoftext|> it's   we'll\n\n  x", "a<|endoftext|><|endoftext|> b <|endof text|>", "<|endoftext|>", "tab\t\tq ", "a b 12 345!!", "日本語 ñ", "'s 'S  end  "]
    fast = K.encoder(K.default_tokenizer())
    assert all(fast(x) == t.encode(x, add_special_tokens=False).ids for x in odd)
    want = Counter()
    for i, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0] if len(ids) <= 1024 else list(range(len(ids) % 1024 - 1024 if len(ids) % 1024 else 0, len(ids), 1024))
        for n, s in enumerate(cuts):
            part = ids[max(0, s) : min(s + 1024, len(ids)) if len(ids) > 1024 else len(ids)]
            want[i, n, max(0, s), len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = K.packed_documents(docs, keep_ids=True)
    rows = got.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert {r.sequence_id: len(r.ids) for r in K.sequences(got).collect()} == {k: sum(n for _, n in v) for k, v in seqs.items()}
    assert K.packed_documents(none).count() == 0


def test_packing_plan_is_tight():
    import random

    from lodestrata.llm.packing import plan

    for seed in range(100):
        rng = random.Random(seed)
        counts = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(40)}
        rows, bins = plan(counts, 100)
        fill = Counter()
        for size, lo, hi, first, each, _ in rows:
            for r in range(lo, hi):
                fill[first + (r - lo) // each] += size
        assert max(fill.values()) <= 100 and len(fill) == bins
        assert sum(hi - lo for _, lo, hi, *_ in rows) == sum(counts.values())
        large = sum(n for s, n in counts.items() if s > 50)
        assert bins <= max(large, -(-sum(s * n for s, n in counts.items()) // 100)) * 1.25 + 2


def test_quality_counts(spark, docs, none):
    from lodestrata.llm import quality as Q

    texts = [r[1] or "" for r in ROWS] + ["a b c a b c\nx | y\nx | y\n \n\n", "#*$%&|<> é　ü"]
    got = Q.statistics([t.encode() for t in texts])
    for t, g in zip(texts, got, strict=True):
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {i + d for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for d in range(3)}
        assert tuple(g[:5]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)), t[:60]
    assert Q.quality(docs).count() == len(ROWS) and Q.quality(none).count() == 0
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns


def test_quality_rejects_outliers(spark):
    import random

    from lodestrata.llm import quality as Q

    rng = random.Random(3)
    text = lambda end: " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 9))) + end for _ in range(120))
    rows = [(i, text(""), "en", "s") for i in range(120)] + [(1000 + i, text("###"), "en", "s") for i in range(15)]
    kept = {r.doc_id for r in Q.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(120))


def components(sets):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {k: root(k) for k in keys}


def test_ngram_join(spark, docs, none):
    import random

    from lodestrata.llm import ngram_join as N

    rng = random.Random(1)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(n)] for n in (3, 7, 12, 40, 40, 150, 400)]
    rows = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(["X", "y", "zz"])
            rows.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"u{k}_{i}" for i in range(rng.randint(10, 90))) for k in range(30)] + ["", None, "One two", "one TWO"]
    sets = {}
    low = {c: c + 32 for c in range(65, 91)}
    for i, t in enumerate(rows):
        w = [x.translate(low) for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    got = {r.id: (r.n, r.component) for r in N.joined(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert N.joined(none).count() == 0
    assert N.joined(docs).count() == len(ROWS)
    stay = N.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(["1", "3", "4", "5", "None", "6", "7", "8"])


def test_signatures_never_miss():
    from lodestrata.llm.ngram_join import Signer

    rng, s = np.random.default_rng(7), Signer()
    met = 0
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 17, 18, 22, 28, 34, 46, 60, 73, 130, 400, 1500):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            d = int(rng.integers(0, size // 4 + 1))
            cut = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate((a[cut:], rng.integers(0, 2**64, d - cut, dtype=np.uint64))))
            n = len(np.intersect1d(a, b))
            if n and 100 * n >= 80 * (len(a) + len(b) - n) and len(np.setxor1d(a, b)):
                # within some group either set may leave out its spare signatures; equal sets need none
                left = [len(np.intersect1d(x, y)) - 1 - max(p, q) for x, p in s.signatures(a) for y, q in s.signatures(b)]
                assert max(left) >= 0, size
                met += 1
    assert met > 500


def test_block_links_join_components():
    from lodestrata.llm.setjoin import block_links

    a = np.arange(100)
    rows = [(1, 1, a), (2, 2, a[5:]), (3, 3, np.arange(1000, 1100)), (4, 1, a[:50])]
    assert block_links(rows, 80) == [(1, 2)]


def test_line_dedup(spark, docs, none):
    from lodestrata.llm import line_dedup as L

    long = "The quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge near the river"
    rows = [(1, f"{long}\nkept\n\nLes."), (2, f"first\n  {long.upper()}  \nlast"), (3, long.replace("seven", "eight")), (4, None), (5, ""), (6, "Les.\nkept too"), (None, long)]
    x = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, drop string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in L.without_repeated_lines(x, counts=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("first\nlast", 1), 3: ("", 1), 4: (None, 0), 5: ("", 0), 6: ("kept too", 1), None: (long, 0)}
    left = L.without_repeated_lines(x)
    assert left.columns == x.columns and {r.doc_id for r in left.collect()} == {1, 2, 4, 5, 6, None}
    assert L.without_repeated_lines(none).count() == 0
    assert L.without_repeated_lines(docs, counts=True).count() == len(ROWS)


def test_line_dedup_shares_shifts_between_bands_only():
    """A shift of the shingles' hashes serves three minimum hashes, no two of one band."""
    from lodestrata.llm import line_dedup as L

    assert 3 * len(L.SHIFTS) == L.HASHES and sorted(i for three in L.SHIFTED for i in three) == list(range(L.HASHES))
    assert all(len({i % 4 for i in three}) == 1 and all(len(set(three) & set(band)) < 2 for band in L.BAND_ROWS.tolist()) for three in L.SHIFTED)
    import pyarrow as pa

    texts = ["aaaaaaaa", "ab", "abcdefg abcdefg", "xaaaaaaaa"]
    got = L.elements(pa.array([t.encode() for t in texts]))
    assert [len(x) for x in got] == [len({t[k : k + 5] for k in range(max(1, len(t) - 4))}) for t in texts]
    assert all((x[1:] > x[:-1]).all() for x in got) and np.isin(got[0], got[3]).all()


def test_line_dedup_recall():
    import random

    from lodestrata.llm import line_dedup as L

    rng = random.Random(8)
    lines, pairs = [], 0
    while pairs < 6000:
        n = rng.randint(50, 250)
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        b = list(a)
        for at in rng.sample(range(n), max(1, round(n / rng.uniform(38, 60)))):
            b[at] = rng.choice("0123456789")
        b = "".join(b)
        p, q = ({x[k : k + 5] for k in range(n - 4)} for x in (a, b))
        if 80 * len(p | q) <= 100 * len(p & q) <= 85 * len(p | q):
            lines += [a, b]
            pairs += 1
    block = L.Lines([x.encode() for x in lines])
    sigs = L.band_hashes(*block.shingles(np.arange(len(lines))))
    assert (sigs[0::2] == sigs[1::2]).any(axis=1).mean() >= 0.9985


def test_line_dedup_sketches():
    """The values depend on the set of a line's shingles only, and more pairs of similarity 0.8 meet than by minimum hashes alone."""
    from lodestrata.llm import line_dedup as L

    rng = np.random.default_rng(11)
    pairs = []
    for union, count in ((5, 10000), (20, 10000), (100, 10000), (400, 4000)):
        for x in rng.integers(0, 1 << 64, (count, union), dtype=np.uint64):
            both, cut = round(0.8 * union), int(rng.integers(round(0.8 * union), union + 1))
            pairs += [x[:cut], np.concatenate((x[:both], x[cut:]))]
    sigs = L.band_hashes(np.concatenate(pairs), np.cumsum([0] + [len(x) for x in pairs[:-1]]))
    assert (sigs[0::2] == sigs[1::2]).any(axis=1).mean() >= 0.9995
    assert len(np.unique(sigs[:2000])) > 0.5 * sigs[:2000].size
    some = [pairs[k] for k in (0, 7, 20001, 40003, 60002)]
    long = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 2, 40, 3000)]
    for x in some + long:
        alone = L.band_hashes(x, np.array([0]))
        shuffled = rng.permutation(np.concatenate([x] * (1 + 1000 // len(x))))  # repeats are taken out of lines that stay open
        assert (L.band_hashes(np.concatenate([pairs[3], shuffled, pairs[4]]), np.array([0, len(pairs[3]), len(pairs[3]) + len(shuffled)]))[1] == alone[0]).all()


def test_line_dedup_does_not_sort_texts(spark, docs):
    from lodestrata.llm import line_dedup as L

    plan = L.without_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_line_dedup_signs_and_places_lines_in_one_pass(spark, tmp_path, monkeypatch):
    from lodestrata.llm import line_dedup as L

    rows = [(2, "one line of some words\nand another line here"), (1, "one line of some words\n\none line of some words"), (1, "x\ny\nzz\nOne line of some words"), (3, "of its own\nand another line here!"), (2, "one line of some words")]
    spark.createDataFrame(rows, "doc_id long, texts_of_test string").write.parquet(str(tmp_path / "docs"))
    plans, written = [], L.written

    def watched(df, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, **more)

    monkeypatch.setattr(L, "written", watched)
    got = L.repeated_lines(spark.read.parquet(str(tmp_path / "docs")), text="texts_of_test").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 3), (2, 0), (3, 1)]
    assert sum("texts_of_test" in p and "MapInArrow" in p for p in plans) == 1


def test_line_dedup_first_places():
    from lodestrata.llm import line_dedup as L

    rng = np.random.default_rng(3)
    node = rng.integers(0, 1 << 64, 300, dtype=np.uint64)[rng.integers(0, 300, 20000)]
    id, line = rng.integers(-40, 40, 20000), rng.integers(0, 30, 20000).astype(np.int32)
    pieces: dict[int, list[bytes]] = {}
    for part in np.array_split(np.arange(20000), 7):
        for k, x in L.spread_places(node[part], id[part], line[part], 12):
            pieces.setdefault(k, []).append(x)
    again = set(zip(*[x.tolist() for x in L.places(pieces.pop(-1))[1:]], strict=True))
    first = []
    for x in pieces.values():
        for n, i, k, f in zip(*[a.tolist() for a in L.first_places(x)], strict=True):
            first += [(n, i, k)] if f else []
            again |= set() if f else {(i, k)}
    want: dict[int, set] = {}
    for n, i, k in zip(node.tolist(), id.tolist(), line.tolist(), strict=True):
        want.setdefault(n, set()).add((i, k))
    assert sorted(first) == sorted((n, *min(x)) for n, x in want.items())
    assert again == {p for x in want.values() for p in x - {min(x)}}


def test_components(spark):
    import random

    from lodestrata.llm.setjoin import components as join

    rng = random.Random(2)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.id: r.component for r in join(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_mixing(spark, docs, none):
    from lodestrata.llm import mixing as M

    got = M.taken(docs).collect()
    assert len(got) == len(ROWS) and M.taken(none).count() == 0
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), rows in by.items():
        assert target <= 2 * size and abs(sum(r.taken for r in rows) - target) <= len(rows)
    assert sorted(map(tuple, M.taken(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    mix = M.mixture(docs)
    assert mix.columns == docs.columns
    assert sum(len(words(r.text)) for r in mix.collect()) == sum(r.taken for r in got)


def test_mixture_follows_the_schedule(spark):
    from lodestrata.llm import mixing as M

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(64 + i % 5)), f"s{i % 3}") for i in range(300)]
    x = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mixture(x, slot="at").collect()
    at = [r["at"] for r in got]
    assert at == sorted(at)
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, r["at"])
    assert {r.id: r.first_slot for r in M.taken(x).collect() if r.first_slot is not None} == seen
    # every run of the mix holds each source about as often as its target says
    share = Counter(r.source for r in got)
    for lo in range(0, len(got) - 60, 60):
        part = Counter(r.source for r in got[lo : lo + 60])
        assert all(abs(part[s] - 60 * n / len(got)) <= 8 for s, n in share.items())
    # another order of points gives another mix of the same amounts
    golden = M.golden_point
    M.golden_point = lambda i: M.F.lit(0.0) + i * 0
    try:
        plain = M.taken(x).collect()
    finally:
        M.golden_point = golden
    assert {(r.id, r.taken) for r in plain} == {(r.id, r.taken) for r in M.taken(x).collect()}
    assert [(r.id, r.first_slot) for r in sorted(plain, key=str)] != [(r.id, r.first_slot) for r in sorted(M.taken(x).collect(), key=str)]


def test_operators_leave_columns_of_any_name_alone(spark):
    import corpus_pipeline as P

    words_ = [f"word{k}" for k in range(97)]
    rows = [(i, " ".join(words_[(i * 7 + k * (i % 11 + 1)) % 97] + str(i) for k in range(60)), "en", "s", 1, 2, 3, 4, 5, 6, None, 7) for i in range(30)]
    rows += [rows[0], (99, None, None, None, *[None] * 8), (100, "", "en", None, *[None] * 8)]
    names = ["base_failed", "__x", "__take", "__gone", "__cut", "__nth", "a.b", "__key"]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    from lodestrata.llm.pii import sanitised

    for name, stage in [*P.STAGES[:-1], ("sanitised", lambda _, d, __: sanitised(d))]:
        got = stage(spark, x, "")
        assert got.columns == x.columns, name
        kept = got.collect()
        assert kept and all(tuple(r)[4:] == (1, 2, 3, 4, 5, 6, None, 7) for r in kept if (r.doc_id if r.doc_id is not None else 99) < 99), name
        assert stage(spark, x.where("1 = 0"), "").count() == 0, name
    assert P.STAGES[-1][1](spark, x, "").count() == len(rows)


def test_chat(spark):
    from lodestrata.llm import chat as C

    m = spark.createDataFrame(
        [("t", 1, None, "user", "hi </s> \\ [INST]", 0.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", None, 5.0), ("t", 9, 8, "user", "orphan", None), ("u", 1, 2, "user", "loop", 1.0), ("u", 2, 1, "user", "loop", 1.0), (None, 1, None, "assistant", "alone<|im_end|>", 1.0)],
        "tree string, id long, parent long, role string, text string, score double",
    )
    got = {(r.tree, r["rank"]): r for r in C.read_back(C.formatted(m, "tree", "id", "parent", score="score", top=None)).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("t", 3), (None, 1)}
    assert [(x.role, x.text) for x in got["t", 1].turns] == [("user", "hi </s> \\ [INST]"), ("assistant", "good"), ("user", "")]
    assert got["t", 1].loss_text == "good" and got["t", 2].loss_text == "bad"
    assert got[None, 1].loss_text == "alone<|im_end|>" and "alone<|im_end|>" not in got[None, 1].formatted
    c = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(70)], "conv_id long, turn long, role string, text string")
    r = C.conversation_digests(c).first()
    assert (r.n_turns, r.loss_sha256) == (70, hashlib.sha256("".join(f"text {i}" for i in range(1, 70, 2)).encode()).hexdigest())
    assert C.conversation_digests(c.where("1 = 0")).count() == 0


def test_pii(spark, docs, none):
    from lodestrata.llm import pii as P

    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in ("a@b.c@d.e.f", "x@@y.z a@b", "é.q@host.de,", "@a.b c%+-@1.2.3."):
        assert P.emails(t) == [m.span() for m in mail.finditer(t)]
    assert P.base_spans("1.2.3.4.5 999.1.1.1; 4111 1111 1111 1111 +1 (555) 010-9999") == [(0, 1, 7), (21, 2, 40), (41, 3, 58)]
    rows = [(i, f"Contact Wolfgang at w{i}.q@mail.example.com today, thanks") for i in range(8)] + [(100 + i, f"today thanks {i} words about other things at length") for i in range(400)]
    x = spark.createDataFrame([*rows, (900, "Wolfgang was here")], "doc_id long, text string")
    got = {r.doc_id: [P.KINDS[s.kind] for s in (r.terms or [])] for r in P.spans(x).collect()}
    assert got[900] == ["term"] and got[100] == [] and "term" in got[0]
    clean = {r.doc_id: r.text for r in P.sanitised(x).collect()}
    assert "Wolfgang" not in clean[900] and "[EMAIL]" in clean[0] and clean[105] == rows[13][1]
    assert P.spans(docs).count() == len(ROWS) and P.spans(none).count() == 0


def base_by_contract(text):
    """The patterns as stated, each leftmost and non-overlapping, failing matches dropped."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        odd = digits[::-1][0::2]
        even = [sum(divmod(2 * x, 10)) for x in digits[::-1][1::2]]
        if 12 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_base_spans_against_the_patterns(spark):
    import random
    import time

    from lodestrata.llm import pii as P
    from lodestrata.llm.queries import op7_pii  # noqa: F401

    rng = random.Random(12)
    pieces = ["1", "2", "25", "255", "256", "0", "00", ".", ".", "-", " ", "+", "(", ")", "a", "@", "@b", ".c", "é", "\n", "4111", "1111", "4111111111111111", "%"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(20000)]
    assert all(P.base_spans(t) == base_by_contract(t) for t in texts)
    assert sum(map(len, map(base_by_contract, texts))) > 2000
    for long in ("7" * 400_000, "1.2." * 100_000, "+1" * 200_000, "a" * 400_000 + "@"):
        at = time.time()
        P.base_spans(long)
        assert time.time() - at < 20
    names = ("email", "ip", "card", "phone")
    some = [t for t in texts if base_by_contract(t)][:300]
    rows = P.spans(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", P.joined_spans(P.F.col("base")).alias("s")).collect()
    for r in rows:
        want = base_by_contract(some[r.doc_id])
        assert r.s == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]


def test_pii_repeated_rows_disclose_alike(spark):
    from lodestrata.llm import pii as P

    rows = [(i, f"Contact Wolfgang at w{i}.q@mail.example.com today, thanks") for i in range(8)] + [(100 + i, f"today thanks {i} words about other things at length") for i in range(400)]
    x = spark.createDataFrame([*rows, (900, "Wolfgang was here")], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in (r.terms or [])] for r in P.spans(x.union(x)).collect()}
    assert got[900] == [4] and got[100] == []


def test_pii_terms_of_a_frequent_kind(spark):
    import random

    from lodestrata.llm import pii as P

    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choice(["ka", "lo", "mi", "ren", "tu"]) for _ in range(3)) for _ in range(n))
    # 30 % of the documents hold an address, 12 of them beside the name
    rows = [(i, f"{filler(30)} {'Wolfgang' if i < 12 else filler(1)} w{i}@example.com {filler(30)}") for i in range(120)] + [(200 + i, filler(60)) for i in range(280)]
    x = spark.createDataFrame([*rows, (900, f"{filler(20)} Wolfgang {filler(20)}")], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in (r.terms or [])] for r in P.spans(x).collect()}
    assert got[900] == [4] and not any(got[200 + i] for i in range(280))


def test_pii_terms_of_a_single_entity(spark):
    from lodestrata.llm import pii as P

    word = lambda i: "".join("klmnoprstu"[int(c)] for c in f"{i:05d}")
    rows = [(i, f"{word(3 * i)} {word(3 * i + 1)} Wolfgang at office@example.com {word(3 * i + 2)} and so on at length") for i in range(6)]
    # every document's address is written between words that stand near many others
    rows += [(100 + i, f"common words a{i}@example.com common words other things at length {i}") for i in range(200)]
    x = spark.createDataFrame([*rows, (900, "Wolfgang was here")], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in (r.terms or [])] for r in P.spans(x).collect()}
    assert got[900] == [4] and 4 in got[0]
    assert "Wolfgang" not in {r.doc_id: r.text for r in P.sanitised(x).collect()}[900]


def test_language(spark, docs, none):
    import random

    from lodestrata.llm import langid as L

    rng = random.Random(4)
    syll = {"en": ["the", "ing", "ion", "er"], "de": ["sch", "ung", "keit", "ä"]}
    rows = [(i, " ".join(rng.choice(syll[g]) + rng.choice(syll[g]) for _ in range(30)), g) for i in range(240) for g in [rng.choice(["en", "de"])]]
    x = spark.createDataFrame([*rows, (900, "123 !!", "en"), (901, None, "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identified(x).collect()}
    held = [i for i, _, g in rows if got[i].held_out]
    assert held and sum(got[i].lang_pred == g for i, _, g in rows if got[i].held_out) >= 0.95 * len(held)
    assert got[900].lang_pred == got[901].lang_pred == "und"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert L.identified(docs).count() == len(ROWS) and L.identified(none).count() == 0


def test_every_language_is_learned(spark):
    from lodestrata.llm import langid as L

    rows = [(i, f"{'abcde'[i % 5] * 3} words of {'vwxyz'[i % 5] * 4}", f"l{i % 5}") for i in range(200)]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = L.Settings(features=1 << 10, languages=2)
    assert L.learn(x, s).languages == [f"l{k}" for k in range(5)]
    held = [(r.lang_pred, f"l{r.doc_id % 5}") for r in L.identified(x, s=s).collect() if r.held_out]
    assert sum(p == g for p, g in held) >= 0.9 * len(held)


def test_toxicity(spark, docs, none):
    import random

    from lodestrata.llm import toxicity as X

    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ren", "tu"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choice(["horrid", "wretched"]) if bad and rng.random() < 0.08 else word() for _ in range(80)), int(bad)))
    x = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    y = spark.createDataFrame([(i, v) for i, _, v in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.scored(x, y).collect()}
    held = [(got[i].predicted, v) for i, _, v in rows if got[i].held_out]
    assert sum(p == v for p, v in held) >= 0.95 * len(held)
    assert X.scored(docs, y).count() == len(ROWS) and X.scored(none, y).count() == 0
    assert X.scored(docs, y.where("1 = 0")).count() == len(ROWS)


def test_toxicity_of_phrases_and_rare_words():
    import random

    from lodestrata.llm import toxicity as X

    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ren", "tu"]) for _ in range(3)) for _ in range(60)]
    first, second = vocabulary[:2]

    def text(bad):
        w = [rng.choice(vocabulary) for _ in range(60)]
        w = [x for k, x in enumerate(w) if not (x == second and k and w[k - 1] == first)]
        for at in rng.sample(range(1, len(w) - 1), 3) if bad else ():
            w[at : at + 1] = [first, second]
        return " ".join(w).encode()

    rows = [(text(i % 2), i % 2, int(i % 5 > 2)) for i in range(600)]
    score = X.fit(rows, {0: 1.0, 1: 1.0}).scorer()
    new = list(zip((p >= 0.7 for p in score([text(i % 2) for i in range(200)])), (i % 2 for i in range(200)), strict=True))
    assert sum(p == y for p, y in new) >= 190
    # 5 of 1000 toxic texts hold the word, which no cap on frequency may leave out
    own = [text(0) + (b" abominable" if i < 5 else b"") for i in range(1000)]
    other = [text(0) for _ in range(6000)]
    assert b"abominable" in X.train_dictionary(own, other, X.Settings())


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as P

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in P.STAGES][0] == "quality rules" and len(P.STAGES) == 5
    rows = P.run(spark, str(tmp_path)).collect()
    assert all(r.length <= 1024 for r in rows)


def test_line_dedup_meets_signatures():
    from lodestrata.llm import line_dedup as L

    rng = np.random.default_rng(5)
    nodes = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    sigs = rng.integers(0, 1 << 64, (4000, L.BANDS), dtype=np.uint64)
    sigs[:3000, 0] = sigs[0, 0]  # many lines have one signature, some two have one, in one call and in several
    sigs[100:300, 3] = sigs[2100:2300, 3]
    sigs[10:20, 5] = sigs[30:40, 5]
    lines = [np.arange(0, 1500), np.arange(1400, 2500), np.arange(2500, 4000)]  # a hundred of them in two calls
    buckets: dict[int, list[bytes]] = {}
    for part in lines:
        for k, piece in L.spread(sigs[part].ravel(), np.repeat(nodes[part], L.BANDS), 40):
            buckets.setdefault(k, []).append(piece)
    rows = [(s, x) for k, pieces in buckets.items() for s, x in zip(*[a.tolist() for a in L.gathered(k, pieces)], strict=True)]
    found: dict[int, set[int]] = {}
    for s, x in rows:
        found.setdefault(s, set()).add(x)
    want: dict[int, set[int]] = {}
    for k, line in enumerate(sigs.tolist()):
        for s in line:
            want.setdefault(s, set()).add(int(nodes[k]))
    assert sorted(sorted(x) for x in found.values()) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    # packed: half of what a row of two longs takes, and the hot signature is no bucket's load
    assert sum(len(p) for k, pieces in buckets.items() for p in pieces if k >= 0) <= 13 * sum(len(part) for part in lines) * L.BANDS
    assert max(sum(len(p) // 13 for p in pieces) for k, pieces in buckets.items() if k >= 0) < 4100


def test_components_by_rounds(spark, monkeypatch):
    from lodestrata.llm import setjoin as S

    monkeypatch.setattr(S, "ONE_TASK", 0)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(50, 129), (-3, 60)]
    rounds = {r.id: r.component for r in S.components(spark.createDataFrame(links, "a long, b long")).collect()}
    monkeypatch.setattr(S, "ONE_TASK", 1000)
    assert {r.id: r.component for r in S.components(spark.createDataFrame(links, "a long, b long")).collect()} == rounds
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_links_of_few_and_many():
    from lodestrata.llm import setjoin as S

    rng = np.random.default_rng(4)
    for n in (2, 9, S.PAIRWISE, S.PAIRWISE + 1, 40):
        base = [np.unique(rng.integers(0, 1 << 40, 60, dtype=np.uint64)) for _ in range(4)]
        rows = [(k, int(rng.integers(0, n)), np.unique(np.concatenate((base[k % 4][rng.random(len(base[k % 4])) < 0.93], rng.integers(0, 1 << 40, 2, dtype=np.uint64))))) for k in range(n)]

        def groups(links, rows=rows):
            comp = {c: c for _, c, _ in rows}
            of = {k: c for k, c, _ in rows}
            for x, y in links:
                p, q = comp[of[x]], comp[of[y]]
                comp = {c: min(p, q) if r in (p, q) else r for c, r in comp.items()}
            return comp

        every = [(x, y) for x, _, a in rows for y, _, b in rows if x < y and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))]
        links = S.block_links(rows, 80)
        assert set(links) <= set(every) and groups(links) == groups(every)


def test_components_of_few_links_take_few_jobs(spark):
    from lodestrata.llm.setjoin import components as join

    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        assert {(r.id, r.component) for r in join(links).collect()} == {(i, 0) for i in range(1, 61)}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert 0 < jobs <= 8
