"""Operators 8, 9 and 10, and the pipeline."""

import base64
import hashlib
import random
import struct

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from loomcat.llm import decontaminate, near_dup, quality, sentencepiece_codec, substring_dedup, warc

SF = "/root/testdata/sf0.001"


def brute_tiles(a, b, least):
    """Greedy string tiling by definition: mark the longest free common run, again and again."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n
        out.append((i, j, n))


@pytest.mark.parametrize("seed", range(12))
def test_tiles_cover_what_greedy_tiling_covers(seed):
    rng = random.Random(seed)
    a = [rng.randint(1, 40) for _ in range(120)]
    b = a[30:55] + [99] + a[60:67] + [98] + a[5:9] + a[90:99]
    b[10] = 97
    code = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = decontaminate.tiles(code(a), code(b), 4)
    assert sorted(n for *_, n in got) == sorted(n for *_, n in brute_tiles(a, b, 4))
    used = [k for i, _, n in got for k in range(i, i + n)]
    assert len(used) == len(set(used)) and all(a[i : i + n] == b[j : j + n] for i, j, n in got)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_contaminated(spark, most):
    rng = random.Random(2)
    say = lambda n: [f"v{rng.randint(0, 3000)}" for _ in range(n)]
    items = {k: say(rng.randint(8, 50)) for k in range(12)}
    items |= {20: items[3], 21: ["only", "three", "words"], 22: []}
    docs = {}
    for k in range(40):
        text = say(rng.randint(0, 200))
        if k % 3 == 0:
            item = items[k % 12]
            cut = len(item) // 2
            part = [item, item[cut:] + ["x"] + item[:cut], item[: len(item) // 3]][k // 3 % 3]
            text = text[:50] + part + text[50:]
        docs[k] = " ".join(w.upper() + "," if w.endswith("7") else w for w in text)
    docs |= {50: "so: Only three WORDS!", 51: None, 52: "", 53: " ".join(items[5]) + " y" * 50_000, 54: docs[0]}
    d = spark.createDataFrame([(i, t, 0.5, "s") for i, t in docs.items()], "doc_id long, text string, coverage double, item_id string")
    b = spark.createDataFrame([*((k, " ".join(x)) for k, x in items.items()), (23, None), (None, "v1 v2"), (0, " ".join(items[0]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.covered) for r in decontaminate.contaminated(d, b, broadcast_bytes=most).collect()}
    want = {}
    for i, t in docs.items():
        ws = decontaminate.words(t)
        for k, x in items.items():
            x = [w.encode() for w in x]
            if x and any(ws[p : p + min(5, len(x))] == x[q : q + min(5, len(x))] for q in range(len(x)) for p in range(len(ws)) if len(x) - q >= min(5, len(x)) and ws[p] == x[q]):
                covered = sum(n for *_, n in brute_tiles(ws if len(ws) < 1000 else ws[:200], x, min(5, len(x))))
                if 2 * covered >= len(x):
                    want[i, k] = (len(x), covered)
    assert got == want and (0, 0) in got and (54, 0) in got and (50, 21) in got
    left = decontaminate.drop_contaminated(d, b, broadcast_bytes=most)
    assert {r.doc_id for r in left.collect()} == set(docs) - {i for i, _ in want}
    assert decontaminate.contaminated(d.where("false"), b).count() == 0 and decontaminate.contaminated(d, b.where("false")).count() == 0


def test_both_ways_agree_on_very_common_seeds(spark):
    rng = random.Random(4)
    line = "all rights reserved by the owner of this text".split()
    say = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    items = {k: say(4) + line + say(rng.randint(0, 20)) for k in range(30)} | {99: line, 98: line[:4]}
    docs = {k: say(20) + line + (items[k % 30][rng.randint(0, 9) :] if k % 4 == 0 else []) + say(9) for k in range(300)}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    one, other = (sorted(map(tuple, decontaminate.contaminated(d, b, broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert one == other and {r[1] for r in one} >= {98, 99} and len(one) > 600


def test_words_of_all_scripts():
    split = lambda t: [w.decode() for w in decontaminate.words(t)]
    assert split("«Größe» — x_1, ĳ\u00a0A\u0301b…") == ["größe", "x", "1", "ĳ", "a\u0301b"]
    assert split("中文、テスト3月。") == ["中", "文", "テ", "ス", "ト", "3", "月"]
    assert split("ไทย") and "".join(split("ทดสอบภาษาไทย ๑๒ ครับ")) == "ทดสอบภาษาไทย๑๒ครับ"
    assert split("\ud800 \u2009 ,") == []
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("abÄß19 ,._-ÿƀ\n'") for _ in range(30)).lower()
        assert split(text) == [m[0] for m in decontaminate._WORD.finditer(text)]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_contaminated_in_scripts_without_spaces(spark, most):
    rng = random.Random(6)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randint(0x0E01, 0x0E2E)) for _ in range(n))
    items = {1: han(40), 2: thai(120), 3: "été à l’ombre — d’une forêt profonde"}
    docs = {1: han(300) + items[1] + han(50), 2: han(90) + items[1][20:] + "，" + han(7) + items[1][:20], 3: thai(300) + items[2] + thai(80), 4: han(400) + thai(400), 5: "x “" + items[3].upper() + "”. y", 6: items[1][:15] + han(60)}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b, broadcast_bytes=most).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 3)}
    assert got[1, 1].covered == got[1, 1].n_words == 40 and got[2, 1].n_tiles == 2


@pytest.mark.parametrize("most", [1 << 20, -1])
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc.write, "__defaults__", (None, most))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300_000)
    monkeypatch.setattr(warc, "READ", 4_000)
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", rng.choice(["", "same", "é\r\n\r\nWARC/1.1", "p" * rng.randint(0, 3000), None]), "x") for i in range(200)]
    rows += [(500, None, "z" * 2_000_000, "x"), (7, *rows[7][1:]), (None, "u", "v", "x"), (501, "a b\r\nX: y", "q", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in warc.digest(pages).collect()}
    first, want = {}, {r[0]: (r[2] or "").encode() for r in rows if r[0] is not None}
    for i, p in sorted(want.items()):
        first.setdefault(p, i)
    assert set(got) == set(want)
    for i, p in want.items():
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[p] == i else ("revisit", first[p]))
    assert warc.digest(pages.where("false")).count() == 0


def test_warc_files_are_plain_gzip(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"body {i // 2} " * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    row = warc.write(pages).orderBy("offset").collect()
    raw = open(row[0].archive.removeprefix("file:").replace("//", "/"), "rb").read()
    whole = gzip.decompress(raw)
    assert whole.count(b"WARC/1.1\r\n") == 20 and whole.count(b"WARC-Type: revisit") == 10 and sum(r.length for r in row) == len(raw)
    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        store, base = warc._filesystem(uri)
        assert store.get_file_info(base).is_file is False and base == str(tmp_path)


def test_warc_selected_reads(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"body {i} " * i) for i in range(60)], "page_id long, url string, html string")
    index = warc.write(pages)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(index.where("page_id % 7 = 3")).collect()}
    assert got == {i: f"body {i} " * i for i in range(3, 60, 7)}
    with pytest.raises(Exception, match="record"):
        warc.read(index.where("page_id = 5").withColumn("offset", index["offset"] + 1)).collect()


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(*parts):
    out = b""
    for f, v in parts:
        if isinstance(v, bytes):
            out += _varint(f << 3 | 2) + _varint(len(v)) + v
        elif isinstance(v, float):
            out += _varint(f << 3 | 5) + struct.pack("<f", v)
        else:
            out += _varint(f << 3) + _varint(v)
    return out


def hand_made(model_type, fallback, squeeze):
    """A small model put together by hand: no training."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{x:02X}>", 0.0, 6) for x in range(256)] if fallback else []
    pieces += [(p, -float(k) - 0.5, 1) for k, p in enumerate(["▁", "a", "b", "c", "ab", "▁a", "▁ab", "abc", "bc", "▁abc", "ca", "é"])]
    body = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    return body + _message((2, _message((3, model_type), (35, int(fallback)))), (3, _message((1, b"identity"), (3, 1), (4, int(squeeze)), (5, 1))))


@pytest.mark.parametrize("model_type", [1, 2])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_parity_on_hand_made_models(model_type, fallback, squeeze):
    import sentencepiece

    raw = hand_made(model_type, fallback, squeeze)
    own, tok = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepiece_codec.build(raw)
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("aaabbcc é ") for _ in range(rng.randint(0, 14)))
        assert tok.encode(t, add_special_tokens=False).ids == own.encode(t), t
    codec, texts = sentencepiece_codec.Codec(raw, 1), ["".join(rng.choice("aabbc é ▁") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for t, (ids, back, same) in zip(texts, codec.coded(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == own.encode(t) and same == (back == own.decode(own.encode(t))), t


def test_codec_on_the_public_model(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "  two  spaces "), (-4, "<s> ▁ \x00   🎈"), (-5, "a" * 300_000), (-5, "a" * 300_000), (None, "x")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = sentencepiece_codec.encode(rows.withColumn("ids", rows.text)).collect()
    assert len(got) == rows.count()
    for r in got:
        if r.text is None:
            assert r.ids is None and r.n_tokens is None and r.decoded is None
        else:
            ids = np.frombuffer(r.ids, "<i4").tolist()
            assert ids == own.encode(r.text) and r.n_tokens == len(ids) and r.decoded == own.decode(ids) and r.parity
    assert all(r.round_trip for r in sentencepiece_codec.digest(docs).collect())
    assert sentencepiece_codec.digest(docs.where("false")).count() == 0


def test_parity_of_every_document(spark):
    docs = spark.createDataFrame([(k, f"a \u2003 text\t{k}  \U0001f600\x07" * (k % 3)) for k in range(300)] + [(300, None)], "doc_id long, text string")
    got = {r.doc_id: r.parity for r in sentencepiece_codec.digest(docs).collect()}
    assert got[300] is None and all(got[k] is not None for k in range(300))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = [n for n, _ in corpus_pipeline.STAGES], docs.toPandas()
    assert names == ["quality", "near_dup", "substring_dedup", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        source = spark.createDataFrame(before)
        after = stage(spark, source, SF).toPandas()
        if name != "sentencepiece":
            assert list(after.columns) == list(docs.columns)
        if name == "quality":
            judged = quality.judge(source, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").select("doc_id").collect()
            assert set(after.doc_id) == {r.doc_id for r in judged}
        elif name == "near_dup":
            from tests.llm.test_dedup import brute_components

            found = brute_components(list(zip(before.doc_id, before.text, strict=True)), 5, 4, 5)
            assert set(after.doc_id) == {i for i, (_, c) in found.items() if i == c}
        elif name == "substring_dedup":
            from tests.llm.test_dedup import brute_passages

            found = brute_passages(list(zip(before.doc_id, before.text, strict=True)))
            old = before.set_index("doc_id").text
            assert len(after) == len(before)
            for r in after.itertuples():
                if found[r.doc_id][1]:
                    assert hashlib.sha256(r.text.encode()).hexdigest() == found[r.doc_id][2]
                else:
                    assert r.text == old[r.doc_id]
                assert r.n_chars == len(r.text)
        elif name == "decontamination":
            bench = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            seeds = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
            gone = set()
            for r in before.itertuples():
                ws = decontaminate.words(r.text)
                near = [x for x in bench if seeds(x) & seeds(ws)]
                gone |= {r.doc_id for x in near if 2 * sum(n for *_, n in brute_tiles(ws, x, 5)) >= len(x)}
            assert set(after.doc_id) == set(before.doc_id) - gone and gone
        else:
            assert set(after.doc_id) == set(before.doc_id) and (after.decoded == after.text).all()
        before = after
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(before.doc_id) and dict(zip(got.doc_id, map(bytes, got.ids), strict=True)) == dict(zip(before.doc_id, map(bytes, before.ids), strict=True))


def test_every_number_has_a_query():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_defaults_are_five_words_and_four_fifths():
    assert near_dup.near_duplicates.__defaults__ == (5, 4, 5) and substring_dedup.WINDOW == 50
