"""Operators 2, 5 and 7: brute force and held-out accuracy."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcat.llm import chat_format, language_id, quality

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": "ba ke lu mo ni".split(), "bb": "stra oing eck tul ph".split(), "cc": "éa ñi ço üx ßt".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(1)
    rows = [(i, speech(rng, lang, rng.randint(3, 60)), lang, "x", 0.5) for i, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), 300))]
    rows += [(1000, None, "aa", None, None), (1001, "12 !? 3", "bb", None, None), (1002, "", None, None, None), (1003, speech(rng, "bb", 200_000), None, None, None), (0, rows[0][1], "aa", "x", 0.5)]
    got = language_id.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[1003].lang_pred == "bb"
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(held) > 50 and np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_scores_are_brute_force_scores(spark):
    """Every prediction of the query is the softmax of the mean embedding, by plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    m = language_id.learn(docs.select("doc_id", "text", "lang"), ~held_out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language_id.predict(docs, m).collect():
        at, n = language_id.features([texts[r.doc_id]])[0]
        mean = [sum(float(m["table"][b, k]) * int(x) for b, x in zip(at, n, strict=True)) / int(n.sum()) for k in range(language_id.DIM + 1)]
        logits = [(sum(mean[k] * m["layer"][k, j] for k in range(language_id.DIM)) + m["bias"][j]) / m["heat"] for j in range(len(m["langs"]))]
        e = [math.exp(x - max(logits)) for x in logits]
        assert r.score == pytest.approx(max(e) / sum(e), rel=1e-4)
        assert r.lang_pred == m["langs"][e.index(max(e))]
        if abs(r.score - m["reject"]) > 1e-5 and abs(mean[-1] - m["familiar"]) > 1e-5:
            assert r.rejected == (r.score < m["reject"] or mean[-1] < m["familiar"])


@pytest.mark.parametrize("n", [60, 600])
def test_language_rejection_is_alike_at_all_sizes(spark, n):
    rng = random.Random(n)
    rows = [(i, speech(rng, ("aa", "bb")[i % 2], rng.randint(20, 60)), ("aa", "bb")[i % 2]) for i in range(n)]
    rows += [(10_000 + i, speech(rng, "cc", 40), None) for i in range(60)] + [(20_000 + i, "".join(chr(rng.randint(0x3B1, 0x3C9)) for _ in range(80)), None) for i in range(60)]
    got = {r.doc_id: r for r in language_id.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    known = [got[i] for i in range(n) if got[i].held_out]
    assert np.mean([r.rejected for r in known]) < 0.16 and np.mean([r.lang_pred == rows[r.doc_id][2] for r in known]) > 0.97
    assert np.mean([got[10_000 + i].rejected for i in range(60)]) > 0.9 and np.mean([got[20_000 + i].rejected for i in range(60)]) > 0.9


def test_language_many_languages(spark):
    rng = random.Random(2)
    kinds = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for k in range(300)}
    rows = [(k * 6 + i, " ".join(rng.choice(w) for _ in range(40)), x) for k, (x, w) in enumerate(kinds.items()) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.learn(docs, F.lit(True))
    assert m["langs"] == sorted(kinds)
    got = language_id.predict(docs, m).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.3 > 100 / len(kinds) / 6


def test_no_language_is_lost_from_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 40)
    rows = [(10 * i + k, chr(0x4E00 + i) * 5 + f" {k}", f"l{i}") for i in range(100) for k in range(i % 4 + 1)] + [(None, "x", "none"), (1, "y y", "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert language_id.learn(docs.where("doc_id IS NOT NULL"), F.lit(True))["langs"] == sorted({f"l{i}" for i in range(100)})
    monkeypatch.setattr(language_id, "SAMPLE", 10_000)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 1)
    seen = []
    monkeypatch.setattr(language_id, "train", lambda rows: seen.extend(rows))
    language_id.learn(docs.where("doc_id IS NOT NULL"), F.lit(True))
    assert len({r[0] for r in seen}) == 100 and len(seen) <= 102


def test_language_counts_are_brute_force_counts():
    texts = ["Abc d1!", "", "é" * 3]
    for text, (at, n) in zip(texts, language_id.features(texts), strict=True):
        x = [ord(ch.lower()) if ch.isalpha() else 0 for ch in text] + [0, 0]
        want: Counter = Counter()
        for size in (1, 2, 3):
            for k in range(len(text)):
                if any(x[k : k + size]):
                    want[int(language_id._hashed(np.array(x[k : k + size] + [0] * (3 - size) if size < 3 else x[k : k + 3], np.uint32), size)[0])] += 1
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == dict(want)


def test_language_blocks_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [speech(rng, "aa", n) for n in (1, 50, 300)] + [""]
    table = np.random.default_rng(1).normal(size=(language_id.BUCKETS, 3))
    table[0] = 0
    want = language_id.totals(texts, table)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    got = language_id.totals(texts, table)
    assert np.allclose(want[0], got[0]) and (want[1] == got[1]).all()


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.digest(docs).collect()} == {"und"}
    assert language_id.digest(docs.where("false")).count() == 0


class Kneser:
    """A plain interpolated modified Kneser-Ney model."""

    def __init__(self, texts, order):
        self.levels, grams = {}, Counter()
        for t in texts:
            t = " " * (order - 1) + t
            grams.update(t[i : i + order] for i in range(len(t) - order + 1))
        for n in range(order, 0, -1):
            k = Counter(grams.values())
            n1, n2, n3, n4 = (max(1, k[x]) for x in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            drop = [min(max(v, 0.05), x) for x, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
            total, free = Counter(), Counter()
            for g, v in grams.items():
                total[g[:-1]] += v
                free[g[:-1]] += drop[min(v, 3) - 1]
            self.levels[n] = grams, drop, total, free
            if n > 1:
                grams = Counter(g[1:] for g in grams)
        self.size = len(grams) + 1

    def p(self, g):
        if not g:
            return 1 / self.size
        grams, drop, total, free = self.levels[len(g)]
        low, h = self.p(g[1:]), g[:-1]
        if not total[h]:
            return low
        v = grams[g]
        return (max(v - drop[min(v, 3) - 1], 0) if v else 0) / total[h] + free[h] / total[h] * low


@pytest.mark.parametrize("most", [quality.BROADCAST_ROWS, 0])
def test_kneser_ney_is_the_brute_force_model(spark, most):
    rng = random.Random(5)
    rows = [(i, speech(rng, "aa", rng.randint(1, 40)), "aa") for i in range(80)] + [(100 + i, speech(rng, "bb", 30), "bb") for i in range(60)]
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "zzzz qqqq idiot.", "aa"), (203, "x", None), (204, speech(rng, "aa", 20_000), "aa")]
    labels = [(i, 1, 0) for i, _, _ in rows if i < 200] + [(0, 1, 0), (202, 0, 1), (None, 1, 0), (205, None, None)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, quality string").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, labels, broadcast_rows=most).collect()}
    half = {r.doc_id: r.half for r in got.values()}
    for lang in ("aa", "bb"):
        m = Kneser([t for i, t, x in rows if x == lang and half[i] == 0], 4)
        for i, t, x in rows:
            if x == lang and t and i != 204:
                padded = "   " + t
                bits = [-math.log2(m.p(padded[k : k + 4])) for k in range(len(t))]
                assert got[i].bits == pytest.approx(sum(bits) / len(bits), rel=1e-4)
                peak, at = 0, 0
                for w in t.split(" "):
                    core = w[:-1] if w[-1:] in (".", ",") else w
                    if len(core) >= 4 and core.isalpha():
                        end = min(at + len(core) + 1, len(t))
                        peak = max(peak, sum(bits[at:end]) / (end - at))
                    at += len(w) + 1
                assert got[i].peak == pytest.approx(peak, rel=1e-4)
    judged = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert not judged[202].kept and judged[200].kept and judged[201].kept and judged[203].kept
    assert len(judged) == len(rows)
    assert set(quality.keep_good(docs, labels).columns) == {"doc_id", "text", "lang", "quality"}
    assert quality.digest(docs.where("false"), labels).count() == 0
    assert quality.digest(docs, labels.where("false")).count() == len(rows)


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels, "doc_id").groupBy("lang", "quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {(x.lang, x.quality, x.toxic): (x.kept, x.n) for x in rows}
    for lang in ("de", "en", "es", "fr"):
        assert kept[lang, 1, 0][0] >= 0.95 and kept[lang, 0, 0][0] < 0.1, kept
    bad = [x for (_, q, t), x in kept.items() if (q, t) == (0, 0)]
    assert sum(k * n for k, n in bad) / sum(n for _, n in bad) < 0.05


def test_quality_sees_repeated_words(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(speech(rng, "aa", 6).capitalize() + "." for _ in range(8)), "aa") for i in range(300)]
    rows += [(1000, "Ba. " * 60, "aa"), (1001, "lumo " * 60, "aa"), (1002, " ".join(f"{w}!!" for w in rows[0][1].split()), "aa"), (1003, "lumo", "aa")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert not got[1000].kept and not got[1001].kept and not got[1002].kept
    assert got[1001].repeated == 1 and got[1001].bits < got[1001].most_bits
    assert got[1003].repeated is None and np.mean([got[i].kept for i in range(300)]) > 0.95


def test_quality_judges_languages_with_few_labels(spark):
    rng = random.Random(4)
    rows = [(i, speech(rng, "aa", 40), "aa") for i in range(150)] + [(200 + i, speech(rng, "bb", 40), "bb") for i in range(12)]
    rows += [(300 + i, t, x) for i, (t, x) in enumerate(itertools.product(("zzzz qqqq idiot. " * 9, speech(rng, "cc", 40)), ("aa", "bb")))]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i < 300], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(r.most_bits is not None for r in got.values()) and {r.lang for r in got.values()} == {"aa", "bb"}
    assert not any(got[i].kept for i in range(300, 304))
    assert all(got[200 + i].kept for i in range(12)) and np.mean([got[i].kept for i in range(150)]) > 0.95
    crossed = {r.doc_id: r for r in quality.score(docs, labels, crossed=True).collect()}
    for h in (0, 1):
        m = Kneser([t for i, t, x in rows if x == "bb" and crossed[i].half == h], 4)
        for i, t, x in rows:
            if x == "bb" and crossed[i].half == 1 - h:
                padded = "   " + t
                assert crossed[i].bits == pytest.approx(np.mean([-math.log2(m.p(padded[k : k + 4])) for k in range(len(t))]), rel=1e-4)


def test_quality_of_languages_with_two_trusted_texts_and_with_none(spark):
    rng = random.Random(8)
    rows = [(i, speech(rng, "aa", 40), "aa") for i in range(120)]
    hashed = dict(spark.range(1000, 1200).selectExpr("id", "pmod(xxhash64(id), 2)").collect())
    two = [i for i in hashed if hashed[i] == 1][:2]
    rows += [(i, speech(rng, "bb", 60), "bb") for i in two]  # both in one half
    trusted = {i for i, _, _ in rows} | {3000}
    rows += [(2000, "zzzz qqqq idiot. " * 9, "bb"), (2001, speech(rng, "bb", 40), "bb"), (3000, speech(rng, "cc", 40), "dd")]
    rows += [(2002, speech(rng, "cc", 40), "cc"), (2003, "lumo " * 60, "cc"), (2004, "", "cc"), (2005, None, "cc"), (2006, "lumo " * 60, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(rows) and {got[i].half for i in two} == {0, 1}
    assert got[2000].bits is not None and not got[2000].kept and all(got[i].kept for i in (*two, 2001, 3000))
    assert got[2002].bits is None and got[2002].kept and not got[2003].kept and got[2003].repeated == 1
    assert got[2004].kept and got[2005].kept and not got[2006].kept
    crossed = {r.doc_id: r for r in quality.score(docs, labels, crossed=True).collect()}
    a, b = (dict((i, t) for i, t, _ in rows)[i] for i in two)
    for i, own, other in ((two[0], a, b), (two[1], b, a)):
        m, padded = Kneser([other], 4), "   " + own
        assert crossed[i].bits == pytest.approx(np.mean([-math.log2(m.p(padded[k : k + 4])) for k in range(len(own))]), rel=1e-4)


def test_quality_peak_without_punctuation():
    class Letters:
        def bits(self, points):
            return (points[3:] == ord("z")).astype(float)

    got = quality.surprise(["az \u201czzzz\u201d!", "zz1zz zzzz9 a-zzzz", "", "zzzz az"], Letters())
    assert got["peak"][:2].tolist() == [0.8, 0] and np.isnan(got["peak"][2]) and got["peak"][3] == 0.8
    assert got["boundary"][3] == 0.5 and got["repeated"][3] == 0


def test_viterbi_is_the_best_path():
    rng = random.Random(1)
    counts = {("start", s, ""): rng.random() * 9 for s in (0, 2, 4)} | {("move", s, str(t)): rng.random() * 9 for s in range(6) for t in (0, 2, 4, s // 2 * 2 + 1)}
    counts |= {("marker", s, v): rng.random() * 9 for s in range(6) for v in "abc"}
    m = chat_format.Model(counts)
    for n in (1, 2, 4):
        feats = [{"marker": rng.choice("abcz")} for _ in range(n)]
        best = max(
            sum([m.start[p[0]]] + [m.move[a, b] for a, b in zip(p[:-1], p[1:], strict=True)] + [m.emission(f)[s] for s, f in zip(p, feats, strict=True)])
            for p in itertools.product(range(6), repeat=n)
        )
        path, got = m.viterbi(feats)
        assert got == pytest.approx(best)
        assert sum([m.start[path[0]]] + [m.move[a, b] for a, b in zip(path[:-1], path[1:], strict=True)] + [m.emission(f)[s] for s, f in zip(path, feats, strict=True)]) == pytest.approx(best)


def test_markers():
    lines = ["User: hi", "### Assistant", "[Support] yes", "**Q:** what", "Robin: a", "Kim: b", "Robin: c", "plain text", "word", "<|system|> be kind"]
    assert [k for k, _ in chat_format.markers(lines)[0]] == ["user", "assistant", "assistant", "user", "name1", "name2", "name1", "none", "none", "system"]


def test_canonical_turns_come_back():
    found = [("system", "be <|end|>\nkind"), ("user", ""), ("assistant", "a\nb")]
    assert chat_format.parse_canonical(chat_format.render(found)) == found


def test_chat_held_out(spark):
    """Every style is learned from and tested, and each comes back."""
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    got = chat_format.digest(conv).collect()
    assert {r.conv_id for r in got} == {r.conv_id for r in conv.select("conv_id").distinct().collect()}
    held = [r for r in got if r.held_out]
    assert {(r.held_out, chat_format.style_of(r.conv_id)) for r in got} == set(itertools.product((True, False), range(6)))
    for style in range(6):
        own = [r for r in held if chat_format.style_of(r.conv_id) == style]
        assert sum(r.agreement * r.n_lines for r in own) / sum(r.n_lines for r in own) > 0.9, style


def chats():
    rng = random.Random(6)
    rows = [(k, t, rng.choice(("user", "assistant", "system", "other", None)), rng.choice((" a  \nbob: c", "text?", "\n\n", "", None, "x\n\ny <|user|> ", "Zed: hi", "Ann: ho", "User:")), "z") for k in range(40) for t in range(rng.randint(1, 30))]
    rows += [(100, 0, None, None, "z"), (None, 1, "user", "x", "z"), (101, None, "user", "hey", "z"), (101, None, "user", "hey", "z"), (102, 0, "user", "line\n" * 3000, "z")]
    return rows


def test_long_chats_are_parsed_whole(spark):
    """Pieces of any size give the result of one Viterbi pass over the whole transcript."""
    rows = chats()
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string").repartition(5)
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    whole = {k: chat_format.raw_transcript(k, [(r[2], r[3]) for r in g]) for k, g in itertools.groupby(sorted((r for r in rows if r[0] is not None), key=key), key=lambda r: r[0])}
    counts: Counter = Counter()
    for k, (text, states) in whole.items():
        if chat_format.STYLES and __import__("zlib").crc32(str(k).encode()) % 2 == 0:
            chat_format._tally([tuple(s.split(" ")) for s in states], text, counts)
    model = chat_format.Model(counts)
    for part in (500, 4, 1):
        got: dict = {}
        for r in sorted(chat_format.digest(conv, part).collect(), key=lambda r: (r.conv_id, r.part)):
            got.setdefault(r.conv_id, []).append(r)
        assert set(got) == set(whole)
        for k, (text, _) in whole.items():
            turns, line_roles = chat_format.turns(text, model)
            assert "".join(r.rendered for r in got[k]) == chat_format.render(turns), (part, k)
            assert sum(r.n_lines for r in got[k]) == len(line_roles) and sum(r.n_turns for r in got[k]) == len(turns)
            assert chat_format.parse_canonical("".join(r.rendered for r in got[k])) == turns


def test_chat_edges(spark):
    conv = spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string, rendered string")
    got = {(r.conv_id, r.part): r for r in chat_format.digest(conv).collect()}
    assert got[100, 0].rendered == "" or got[100, 0].n_lines == 1
    assert got[101, 0].n_turns == 2 and got[102, 0].n_lines >= 3000 and len(got) == 43
    assert chat_format.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert chat_format.turns(None, chat_format.Model({})) == ([], [])
    rows = spark.createDataFrame([(1, "User: a\nAssistant: b", "x"), (2, None, "y")], "id long, text string, turns string")
    assert {r.id: len(r.turns) for r in chat_format.parse(rows, chat_format.Model({})).collect()}[2] == 0
