"""Operators 11, 12 and 13 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from loomcat.llm import collocations, fill_in_middle, simhash

ODD = [None, "", " ", "\t\n", "one", "One two", "x " * 300, "é" * 500, "\U0001f600 ü ß", "a\x00b"]


def frame(spark, rows):
    """Documents (doc_id, lang, text) with extra columns whose names clash with the operators' own."""
    schema = "doc_id long, lang string, text string, block long, id long, n long, word string, fp long, form string, component_id long, rank long, phrase string"
    return spark.createDataFrame([(*r, -1, -2, -3, "w", 7, "psm", -4, 0, "p") for r in rows], schema).repartition(3)


# --- 11: collocations


def brute_phrases(rows, least, top, share=80, scale=2_000_000):
    f = collections.Counter()
    n = collections.Counter()
    for _, lang, text in rows:
        lang = lang or "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = collections.defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for (lang, w), a in candidates.items():
        if inside[lang, w] and 100 * inside[lang, w] >= share * a:
            continue
        score, _, left, right = min((scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def prose(seed, n):
    rng = random.Random(seed)
    vocab = ["The", "the", "of", "ÉTÉ", "été", "a", "b", "c", "d"] + [f"w{k}" for k in range(12)]
    fixed = ["one two three four five", "New  York\tCity", "x y x y x", "of the"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        rows.append((i, rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", " ", ". ", "\n", ",", "\t", "\r\n"]) for p in parts)))
    return rows + [(n + i, "fr", t) for i, t in enumerate(ODD)] + [(n, "fr", None), (None, "de", "one two three")] + rows[:5]


@pytest.mark.parametrize("block, least, top", [(1 << 20, 5, 2000), (40, 3, 7), (1, 30, 50)])
def test_phrases(spark, monkeypatch, block, least, top):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = prose(block, 250)
    got = collocations.collocations(frame(spark, rows), least=least, top=top).drop("words")
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, least, top)
    assert want and sorted(map(tuple, got.collect())) == want


def test_ties_are_in_byte_order(spark):
    rows = [(i, "x", "b c. B c. é z. a퟿ z. Z z. z \U0001f600. z ￮") for i in range(4)]
    got = collocations.collocations(frame(spark, rows), least=2).orderBy("rank")
    assert [tuple(r)[:-1] for r in got.collect()] == brute_phrases(rows, 2, 2000)


def test_long_texts_go_on_in_more_blocks():
    tokens = collocations.words_and_breaks("a b. c d e f g; h")
    assert tokens == [b"a", b"b", b"\n", b"c", b"d", b"e", b"f", b"g", b"\n", b"h", b"\n"]
    assert [tokens[s:t] for s, t in collocations.cuts(tokens, 4)] == [tokens[:3], tokens[3:9], tokens[9:]]
    assert collocations.cuts(tokens, 100) == [(0, len(tokens))]


def test_scores_pass_64_bits(spark):
    big = 2**62
    df = spark.createDataFrame([(big, [big - 1, 2**60], [2**61, 2**62])], "f long, heads array<long>, tails array<long>")
    row = collocations.scored(df, 2_000_000).first()
    assert (row.score, row.l, row.r) == min((2_000_000 * big // (x + y), x, y) for x, y in ((big - 1, 2**61), (2**60, 2**62)))


def test_no_phrases(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "en", "a b")])).count() == 0
    with pytest.raises(ValueError, match="longest"):
        collocations.collocations(frame(spark, []), longest=1)


# --- 12: SimHash


def brute_fingerprint(text, k):
    w = re.findall("[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def edited(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["Straße", "The", "THE"]
    docs = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 60, 400]))]
        for _ in range(rng.randint(1, 6)):
            w = base[:]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    docs += docs[:4] + ODD
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return [(i, None, t) for i, t in zip(ids, docs, strict=True)]


@pytest.mark.parametrize("shingle, most, few, longest", [(4, 4, 16, 1 << 15), (4, 4, 1, 3), (5, 2, 2, 4), (5, 4, 16, 0), (3, 0, 16, 100)])
def test_simhash(spark, monkeypatch, shingle, most, few, longest):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "LIST", longest)
    monkeypatch.setattr(simhash, "ROWS", 64)  # lists go on over many batches
    rows = edited(most + few, 40)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, rows), shingle, most).collect()}
    prints = {i: brute_fingerprint(t, shingle) for i, _, t in rows}
    assert {i: x[0] for i, x in got.items()} == prints
    want = brute_components(prints, most)
    assert {i: x[1] for i, x in got.items()} == want
    assert len(set(want.values())) < len(set(prints.values())) or not most


def planted(seed, n, spread):
    """Fingerprints around a few centres, as signed numbers."""
    rng = np.random.default_rng(seed)
    out = set(rng.integers(0, 2**63, n).tolist())
    for centre in list(out)[:3]:
        for _ in range(n):
            out.add(centre ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, spread)).tolist())))
    return sorted(x - 2**64 if x >> 63 else x for x in out)


@pytest.mark.parametrize("few, longest, batch", [(16, 1 << 15, 1 << 16), (2, 40, 50), (16, 10, 7), (4, 0, 1000)])
def test_links_join_what_is_linked(spark, monkeypatch, few, longest, batch):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "LIST", longest)
    monkeypatch.setattr(simhash, "ROWS", batch)
    fps = planted(longest, 70, 6)
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4).collect()
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= 4 for r in found)
    joined = brute_components({x: x % 2**64 for x in fps}, 4)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = sorted((find(r.a), find(r.b)))
        root[b] = a
    assert {x: find(x) for x in fps} == joined


def test_each_pair_of_short_lists_is_given_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 1000)
    fps = planted(5, 40, 4)
    found = [tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4).collect()]
    assert sorted(found) == [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) % 2**64).count("1") <= 4]


def test_crowded_lists_are_never_held():
    import pandas as pd

    mask, fps = 0xFFFFFFFF, np.arange(1000, dtype=np.uint64) << np.uint64(32)
    rows = [pd.DataFrame({"mask": np.full(50, mask, np.int64), "fp": fps[i : i + 50].view(np.int64)}) for i in range(0, 1000, 50)]
    out = list(simhash._lists(4, 16, 120)(iter(rows)))
    assert max(map(len, out)) <= 170 and sum(map(len, out)) == 1000 and all(x["b"].isna().all() for x in out)


def test_simhash_edges(spark):
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0
    rows = [(3, None, None), (1, None, ""), (1, None, "a b c d e"), (None, None, "a b"), (9, "x", "q r s t u v")]
    assert {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()} >= {(1, 0, 1), (3, 0, 1)}
    assert {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()} == {1, 9}
    long = " ".join(f"w{k % 5003}" for k in range(200_000))
    assert simhash.fingerprint(long, 4) == brute_fingerprint(long, 4)
    with pytest.raises(ValueError, match="most"):
        simhash.near_duplicates(frame(spark, rows), most=3)


# --- 13: fill in the middle


def brute_example(doc_id, text, cut=90, first=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < first else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < first else "psm", len(p), len(m), out


def examples_corpus():
    rng = random.Random(1)
    signs = ["a", "Z", "[", "`", "{", "@", "é", "ſ", "K", "\U0001f600", "\n", " ", "<", "P", ">", "S", "<S", "<P", "M>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [(i, "x", t) for i, t in enumerate(texts + ODD + ["<P>", "a<M>b", "ab <S> c" * 9, "long word " * 50_000])]


@pytest.mark.parametrize("cut, first", [(90, 20), (100, 0), (100, 100), (0, 50)])
def test_examples(spark, cut, first):
    rows = examples_corpus()
    made = fill_in_middle.examples(frame(spark, rows), fill_in_middle.Plan(cut, first))
    got = made.withColumn("back", fill_in_middle.restored(made["output"], made["form"])).collect()
    assert sorted(tuple(r)[:6] for r in got) == [brute_example(i, t, cut, first) for i, _, t in rows]
    texts = {i: t or "" for i, _, t in rows}
    assert all(r.back == texts[r.doc_id] for r in got)


def test_examples_edges(spark):
    assert fill_in_middle.digest(frame(spark, []).limit(0)).count() == 0
    rows = [(1, None, "a b"), (1, None, "a b"), (None, None, "c"), (-5, None, None)]
    got = sorted(r.doc_id for r in fill_in_middle.digest(frame(spark, rows)).collect())
    assert got == [-5, 1, 1]
    with pytest.raises(ValueError, match="percent"):
        fill_in_middle.Plan(cut=101)
