"""Operators 1, 3 and 4 against brute force."""

import hashlib
import random

import pytest

from loomcat.llm import near_dup, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, n_words long, starts string, anchor string, sig string, words string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, -1, "x", None, "s", "w") for i, t in rows], SCHEMA).repartition(3)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["größe", "naïve x", "Émile", "The", "THE"]
    make = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [make(k) for k in (49, 50, 51, 80, 130)]
    hot = make(70)
    docs = []
    for i in range(n):
        parts = [make(rng.randint(0, 90))] + [rng.choice(shared) for _ in range(rng.randint(0, 2))] + [make(rng.randint(0, 40))]
        if i % 3 == 0:
            parts.insert(1, hot)
        docs.append(rng.choice([" ", "\n", "\t\x0b"]).join(parts))
    base = make(300).split()
    for k in range(12):  # near copies
        w = base[:]
        for _ in range(k):
            w[rng.randrange(len(w))] = "edit"
        docs.append(" ".join(w))
    docs += [docs[0]] * 3 + ["", None, "one", "one two", "One  TWO", "x " * 300, "ab" * 900, "ab" * 900 + "c", "é" * 500]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


def words(t):
    return (t or "").encode().split()


def brute_passages(rows, w=50):
    rows = sorted(rows)
    first = {}
    for i, t in rows:
        ws = words(t)
        for k in range(len(ws) - w + 1):
            first.setdefault(tuple(ws[k : k + w]), i)
    out = {}
    for i, t in rows:
        ws = words(t)
        keep = [True] * len(ws)
        for k in range(len(ws) - w + 1):
            if first[tuple(ws[k : k + w])] < i:
                keep[k : k + w] = [False] * w
        kept = b" ".join(x for x, y in zip(ws, keep, strict=True) if y)
        out[i] = (len(ws), len(ws) - sum(keep), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed,shard,salt", [(1, 100_000, 60_000), (2, 3, 4), (5, 400, 7)])
def test_passages(spark, monkeypatch, seed, shard, salt):
    monkeypatch.setattr(substring_dedup, "SHARD_WINDOWS", shard)
    monkeypatch.setattr(substring_dedup, "SALT_ROWS", salt)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(frame(spark, rows)).collect()}
    assert got == brute_passages(rows)


@pytest.mark.parametrize("window", [7, 12])
def test_automata_find_every_window(window):
    rng = random.Random(window)
    phrases = [[rng.choice("abc") for _ in range(rng.randint(window, 30))] for _ in range(20)]
    stretches = [[rng.choice("abc") for _ in range(rng.randint(window, 60))] for _ in range(30)] + [p[1:] + ["x"] + p for p in phrases if len(p) > window]
    join = lambda ws: " ".join(ws).encode()
    automata = substring_dedup.Automata([join(p) for p in phrases], list(range(20)), window)
    codes, begin = substring_dedup.c.word_codes([w.encode() for s in stretches for w in s]), [0]
    for s in stretches:
        begin.append(begin[-1] + len(s))
    at, _ = automata.matches(codes, substring_dedup.np.array(begin))
    known = {tuple(p[i : i + window]) for p in phrases for i in range(len(p) - window + 1)}
    want = {begin[k] + i for k, s in enumerate(stretches) for i in range(len(s) - window + 1) if tuple(s[i : i + window]) in known}
    assert set(at.tolist()) == want and want


def test_nothing_is_removed_without_the_automata(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_locate", lambda window: lambda batches: (pdf[["doc_id"]].iloc[:0].assign(starts=0, ends=0) for pdf in batches))
    rows = [(i, f"{'x ' * i} " + " ".join(f"p{k}" for k in range(60))) for i in range(3)]
    assert all(r.n_removed == 0 for r in substring_dedup.digest(frame(spark, rows)).collect())


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = " ".join(f"v{rng.randint(0, 3000)}" for _ in range(120_000))
    rows = [(1, long), (2, "a b " + long[:400_000] + " c"), (3, "z " * 200_000), (4, "z " * 100_000 + "y")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(frame(spark, rows)).collect()}
    assert got == brute_passages(rows)


def test_passage_texts_and_spans(spark):
    p = " ".join(f"p{k}" for k in range(50))
    rows = [(1, f"a {p} b"), (2, f"c d {p} e"), (3, "nothing here"), (4, None)]
    _, removals = substring_dedup.find_passages(frame(spark, rows))
    r = removals.collect()
    assert [(x.doc_id, x.n_removed, x.starts, x.ends, x.kept_text) for x in r] == [(2, 50, [2], [52], "c d e")]
    out = {x.doc_id: x for x in substring_dedup.drop_passages(frame(spark, rows)).collect()}
    assert out[2].text == "c d e" and out[1].text == rows[0][1] and out[4].text is None and out[2].n_words == -1


def brute_bytes(rows, n=400):
    count = {}
    for _, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - n + 1):
            count[raw[k : k + n]] = count.get(raw[k : k + n], 0) + 1
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        keep = [True] * len(raw)
        for k in range(len(raw) - n + 1):
            if count[raw[k : k + n]] > 1:
                keep[k : k + n] = [False] * n
        spans = sum(1 for k in range(len(raw)) if not keep[k] and (k == 0 or keep[k - 1]))
        out[i] = (len(raw), len(raw) - sum(keep), spans, hashlib.sha256(bytes(x for x, y in zip(raw, keep, strict=True) if y)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeated_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5_000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rows = corpus(3)
    profile, removals = suffix_dedup.find_repeats(frame(spark, rows), hot=hot)
    cut = {r.doc_id: r for r in removals.collect()}
    got = {}
    for r in profile.collect():
        x = cut.get(r.doc_id)
        got[r.doc_id] = (r.n_bytes, x.n_removed if x else 0, len(x.starts) if x else 0, hashlib.sha256(x.kept).hexdigest() if x else r.sha256)
    assert got == brute_bytes(rows)


def test_periodic_and_very_long_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij ") for _ in range(60_000))
    rows = [(1, "a" * 5_000), (2, "ab" * 2_000 + "c" * 300 + "ab" * 150), (3, long), (4, "x" + long[20_000:41_000] + "y"), (5, "é" * 401), (6, "abc" * 133), (7, long[100:499])]
    profile = {r.doc_id: r for r in suffix_dedup.find_repeats(frame(spark, rows))[0].collect()}
    assert len(profile) == 7
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(frame(spark, rows)).collect()}
    assert got == brute_bytes(rows)
    runs = next(suffix_dedup._profile(400, 160)(iter([__import__("pandas").DataFrame({"doc_id": [1], "text": ["ab" * 500_000]})])))
    assert len(runs["anchor"][0]) <= 8 and len(runs["sure_starts"][0]) == 1


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [bytes(rng.integers(97, 99, 30).astype(np.uint8)) for _ in range(40)]
    group, off = np.repeat(np.arange(8), 5), rng.integers(0, 11, 40)
    want = [x.tolist() for x in suffix_dedup.recurring(group, off, data, 12)]
    monkeypatch.setattr(suffix_dedup.c, "prefix_hash", lambda codes: np.zeros(len(codes) + 1, np.uint64))  # all collide
    assert [x.tolist() for x in suffix_dedup.recurring(group, off, data, 12)] == want
    brute = []
    for g, o, d in zip(group, off, data, strict=True):
        hits = []
        for k in range(max(0, o - len(d)), o + 1):
            if k + 12 <= len(d) and sum(g2 == g and 0 <= o2 - (o - k) and o2 - (o - k) + 12 <= len(d2) and d2[o2 - (o - k) : o2 - (o - k) + 12] == d[k : k + 12] for g2, o2, d2 in zip(group, off, data, strict=True)) > 1:
                hits.append(k)
        brute.append(hits)
    assert want == brute


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [near_dup.BLOCK, 2])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus(4, 30)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    for k in range(40):  # a group whose members are linked to some others only
        w = base[:]
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"e{k}"
        rows.append((1000 + k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.digest(frame(spark, rows)).collect()}
    assert got == brute_components(rows, 3, 85, 100)
    kept = {r.doc_id for r in near_dup.keep_one(frame(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in brute_components(rows, 5, 4, 5).items() if i == c}


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(7)
    long = [f"v{rng.randint(0, 9000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:59_000] + ["x"] * 900)), (3, " ".join(long[:30_000])), (4, "z " * 150_000), (5, "z z z")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.digest(frame(spark, rows)).collect()}
    assert got == brute_components(rows, 3, 85, 100) and got[2][1] == 1 and got[3][1] == 3 and got[5][1] == 4


def test_estimates_are_unbiased():
    import numpy as np

    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 1000).astype(np.uint64)
        a, b = np.unique(x[:800]), np.unique(x[200:])
        e = near_dup.estimated(*(np.frombuffer(near_dup.packed(near_dup.minima(s)), np.uint8) for s in (a, b)))
        errors.append(float(e) - 0.6)
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2


@pytest.mark.parametrize("op", [substring_dedup.digest, suffix_dedup.digest, near_dup.digest])
def test_empty_and_repeated_rows(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a " * 300), (1, "a " * 300), (2, None), (2, "b"), (None, "c"), (3, "a " * 300)]
    got = op(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3]


@pytest.mark.parametrize("threshold,rows", [(0.95, 8), (0.85, 5), (0.8, 4), (0.5, 2), (0.3, 1), (0.12, 1)])
def test_bands_follow_the_threshold(threshold, rows):
    r = near_dup.band_rows(threshold)
    assert r == rows and (1 - threshold**r) ** (near_dup.MINIMA // r) <= near_dup.MISSED


def test_thresholds_that_bands_cannot_serve():
    with pytest.raises(ValueError, match="too few"):
        near_dup.band_rows(0.05)
