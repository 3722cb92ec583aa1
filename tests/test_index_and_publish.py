"""The trigram index against plain search, and publication by several writers."""

import random
import re
import threading

import pytest

from loomcat.functions import text as t
from loomcat.operators import trigrams
from loomcat.operators.trigrams import TrigramIndex
from loomcat.sources import publish

SCHEMA = "k long, body string, n long, keys string, gram string, _n int"


def texts(seed, n=300):
    rng = random.Random(seed)
    signs = ["a", "b", "A", "É", "é", " ", "\n", "\U0001f600", "\U0001f601", "z", "the "]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    rows += [(n, None), (None, "abab the "), (0, "again aAb\n"), (0, "again aAb\n"), (n + 1, ""), (n + 2, "x" * 5000 + "Needle")]
    return [(*r, 1, "c", "g", 2) for r in rows]


@pytest.mark.parametrize("per_block, share, rarest", [(40, 0.1, 4), (1000, 1.0, 1), (7, 0.0, 2), (50, 0.5, 99)])
def test_indexed_search_is_plain_search(spark, tmp_path, per_block, share, rarest):
    rows = spark.createDataFrame(texts(per_block), SCHEMA)
    TrigramIndex.build(rows, "k", "body", str(tmp_path / "i"), per_block, share)
    index = TrigramIndex.open(spark, str(tmp_path / "i"))
    for needle in ("the", "THE ", "aba", "é\n", "ÉÉ\U0001f600", "\U0001f600\U0001f601 ", "abaab", "needle", "xxxxxx", "zéz", "q%_", "", "a", "the the the"):
        want = rows.where("k IS NOT NULL").where(t.contains("body", needle))
        got = index.search(needle, rarest)
        assert got.columns == rows.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), needle


def test_search_reads_candidate_blocks_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i} with much the same words") for i in range(2000)], "k long, body string")
    index = TrigramIndex.build(rows, "k", "body", str(tmp_path / "i"), per_block=100)
    assert index.plan("text 17")[0] == "postings" and index.plan("words") == ("scan", []) and index.plan("qqqq") == ("none", []) and index.plan("te") == ("scan", [])
    found = index.search("text 1777 with")
    assert [r.k for r in found.collect()] == [1777]
    assert index.candidates(index.plan("text 1777 with")[1]).select("_block").distinct().count() < 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1]
    assert "_block" in filters and len(re.findall(r"\b\d+\b(?!L?#)", filters.replace("_block#", ""))) < 10 and "In(gram" in plan


def test_blocks_that_are_too_many_to_be_named_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "NAMED_BLOCKS", 1)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "k long, body string")
    index = TrigramIndex.build(rows, "k", "body", str(tmp_path / "i"), per_block=10, most_share=1.0)
    assert index.search("xt 1").count() == rows.where(t.contains("body", "xt 1")).count() == 111


def test_postings_lie_by_parts_of_a_block(spark, tmp_path):
    rows = [(i, c * 3_000_000 + "Same É\U0001f600") for i, c in enumerate("abcd")] + [(i, f"x{i} sAme") for i in range(4, 50)]
    index = TrigramIndex.build(spark.createDataFrame(rows, "k long, body string"), "k", "body", str(tmp_path / "i"), most_share=1.0)
    folded = {k: trigrams.folded(x) for k, x in rows}
    parts = {}
    for r in spark.read.parquet(str(tmp_path / "i/postings")).collect():
        assert r.n == len(r["keys"]) == len(set(r["keys"])) and all(r.gram in folded[k] for k in r["keys"])
        parts.setdefault(r._part, set()).update(r["keys"])
    assert len(parts) > 2 and sum(map(len, parts.values())) == len(rows)  # every row lies in one part
    assert all(sum(len(folded[k].encode()) for k in ks) < 2 * trigrams.PART for ks in parts.values())
    counts = {r.gram: r.n for r in spark.read.parquet(str(tmp_path / "i/grams")).collect()}
    assert counts == {g: sum(g in x for x in folded.values()) for g in {x[i : i + 3] for x in folded.values() for i in [*range(min(60, len(x) - 2)), *range(max(0, len(x) - 12), len(x) - 2)]}}
    assert {r.k for r in index.search("SAME").collect()} == set(folded) and {r.k for r in index.search("aas").collect()} == {0}


def test_index_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "k string, body string")
    index = TrigramIndex.build(rows, "k", "body", str(tmp_path / "i"))
    assert index.search("abc").count() == index.search("a").count() == 0


def numbers(spark, n):
    return spark.range(n).withColumnRenamed("id", "x")


def in_threads(*work):
    out, faults = [None] * len(work), []

    def run(i, f):
        try:
            out[i] = f()
        except Exception as e:  # noqa: BLE001  told below
            faults.append(e)

    threads = [threading.Thread(target=run, args=x) for x in enumerate(work)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not faults, faults
    return out


def test_two_writers_of_one_batch(spark, tmp_path):
    root = str(tmp_path)
    meet = threading.Barrier(2, timeout=60)
    paths = in_threads(*[lambda: publish.publish(numbers(spark, 5), root, lambda _: meet.wait() and None, "one")] * 2)
    assert paths[0] == paths[1]
    assert [(m["number"], m["batch"]) for m in publish.manifests(spark, root)] == [(0, "one")]
    assert len(list((tmp_path / "versions").iterdir())) == 1 and publish.sweep(spark, root, 0) == 0


def test_writers_of_several_batches_take_numbers_in_turn(spark, tmp_path):
    root = str(tmp_path)
    meet = threading.Barrier(4, timeout=60)
    in_threads(*(lambda n=n: publish.publish(numbers(spark, n), root, lambda _: meet.wait() and None, f"b{n}") for n in (1, 2, 3, 4)))
    known = publish.manifests(spark, root)
    assert [m["number"] for m in known] == [0, 1, 2, 3] and {m["batch"] for m in known} == {"b1", "b2", "b3", "b4"}
    for m in known:
        assert publish.current(spark, root, m["number"]).count() == int(m["batch"][1:])
    assert publish.current(spark, root).count() == int(known[-1]["batch"][1:])


def test_a_writer_that_meets_another_one_between_its_look_and_its_claim(spark, tmp_path, monkeypatch):
    root, claim = str(tmp_path), publish._claim

    def beaten(*args):
        monkeypatch.setattr(publish, "_claim", claim)
        publish.publish(numbers(spark, 9), root, lambda _: None, "zz")
        return claim(*args)

    monkeypatch.setattr(publish, "_claim", beaten)
    publish.publish(numbers(spark, 3), root, lambda _: None, "aa")
    assert [(m["number"], m["batch"]) for m in publish.manifests(spark, root)] == [(0, "zz"), (1, "aa")]
    assert publish.current(spark, root).count() == 3


def test_a_writer_that_dies_before_its_claim(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    publish.publish(numbers(spark, 2), root, lambda _: None, "old")

    def dies(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(publish, "_claim", dies)
        publish.publish(numbers(spark, 7), root, lambda _: None, "new")
    assert publish.current(spark, root).count() == 2 and len(publish.manifests(spark, root)) == 1
    assert publish.sweep(spark, root) == 0 and publish.sweep(spark, root, 0) == 2  # data and manifest
    publish.publish(numbers(spark, 7), root, lambda _: None, "new")
    assert publish.current(spark, root).count() == 7 and publish.current(spark, root, 0).count() == 2 and publish.current(spark, root, 5) is None


def test_enrichment_with_a_repeated_key(spark):
    base = numbers(spark, 2)
    with pytest.raises(ValueError, match="repeated x"):
        publish.enrich(base, base.union(base), "x", "replies")
