import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomcat.functions import storage
from loomcat.operators import activity, checks, mining, reviews, translation
from loomcat.operators.mining import Classifier, Highlighter, Longest, Matcher, Rules
from loomcat.sources import catalog_json, publish

T0 = reviews.YEAR[0]


def test_featured_then_newest(spark):
    rows = [(k, T0 + k * 10, "x" * (6 * (k % 4)), "review" if k % 2 else "request", k % 3) for k in range(1, 25)] + [(90, T0 - 1, "x" * 900, "review", 50), (91, reviews.YEAR[1], "y", "review", 50)]
    threads = spark.createDataFrame(rows, "pid long, posted_at long, content string, post_kind string, relevant_reply_count long")
    marked, by = reviews.default_order(threads)
    got = [r.pid for r in marked.orderBy(*by).collect()]
    score = {p: (120 if k == "review" else 0) + n * 40 + min(len(c), 900) // 6 for p, _, c, k, n in rows}
    best = sorted((p for p, at, *_ in rows if T0 <= at < reviews.YEAR[1]), key=lambda p: (-score[p], -p))[:10]
    rest = sorted((r for r in rows if r[0] not in best), key=lambda r: (-r[1], -r[0]))
    assert got == best + [r[0] for r in rest]


def test_score_of_null_content_is_null(spark):
    row = spark.createDataFrame([(None, "review", 1)], "content string, post_kind string, relevant_reply_count long")
    assert row.select(reviews.quality()).first()[0] is None


def test_search_and_metadata(spark):
    threads = spark.createDataFrame([(1, "Alpha 100%"), (2, "b"), (3, "c"), (4, None)], "pid long, content string")
    entries = spark.createDataFrame([(2, "has ALPHA"), (4, None)], "pid long, content string")
    courses = spark.createDataFrame([(3, "ab上")], "pid long, search_name string")
    hit = lambda q: sorted(r.pid for r in reviews.search_threads(threads, entries, courses, q).collect())
    assert hit("alpha") == [1, 2] and hit("Ａ·B 上") == [3] and hit("0%") == [1] and hit("%") == [1] and hit(" ") == [1, 2, 3, 4] and hit("—") == []
    rows = lambda *x: spark.createDataFrame(list(x), "key string, value string")
    dates = spark.createDataFrame([(None, "2024-01-02")], "start_date string, end_date string")
    got = reviews.metadata_payload(rows(("uncachedReplyDifference", "3"), ("cachedReplyCoveragePercent", "95.5"), ("highlight_version", "3"), ("other", "x"), (None, "y")), dates).first()
    assert (got.uncached_reply_difference, got.cached_reply_coverage_percent, got.start_date, got.end_date, got.source_posts, got.highlight_version, got.snapshot_date) == (3, 95.5, "", "2024-01-02", 0, "3", "")
    assert reviews.metadata_payload(rows().limit(0), dates).first().matched_threads == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        reviews.metadata_payload(rows(("source_posts", "many")), dates).first()


def test_health(spark):
    ids = lambda *x, name="id": spark.createDataFrame([(i,) for i in x], f"{name} long")
    tr = ids(1, name="course_id")
    ok = lambda a, b, t=tr: checks.catalog_health(ids(*a), ids(*b, name="course_id"), t).first().healthy
    assert ok((1, 2), (1, 2)) and not ok((1, 2), (1,)) and not ok((1, 2), (1, 3)) and not ok((1, 1), (1, 1)) and not ok((1, 2), (1, 2), ids(9, name="course_id"))


def test_review_health(spark):
    threads, entries = spark.createDataFrame([(1,)], "pid long"), spark.createDataFrame([("p1", "post", "abcdef")], "entry_key string, kind string, content string")
    replies, aliases = spark.createDataFrame([(1,)], "pid long"), spark.createDataFrame([("course", "a")], "entity_type string, normalized_alias string")
    marks = lambda *s: spark.createDataFrame([("p1", a, b, "course", "full") for a, b in s], "entry_key string, start_offset int, end_offset int, entity_type string, match_kind string")
    meta = {"matched_threads": "1", "matched_entries": "1", "snapshot_replies": "1", "course_aliases": "1", "teacher_aliases": "0", "course_highlights": "2", "teacher_highlights": "0", "course_alias_highlights": "0", "teacher_alias_highlights": "0", "highlight_version": "3"}
    said = lambda m: spark.createDataFrame(list(m.items()), "key string, value string")
    run = lambda h, m: checks.review_health(threads, entries, replies, h, aliases, said(m))
    assert run(marks((0, 2), (2, 6)), meta) == []
    for bad in (((0, 3), (2, 6)), ((-1, 2), (3, 4)), ((0, 2), (3, 7)), ((0, 2), (4, 4))):
        assert run(marks(*bad), meta) == ["invalid highlight spans"]
    assert run(marks((0, 2), (2, 6)), meta | {"highlight_version": "2"}) and run(marks((0, 2)), meta) and run(marks((0, 2), (2, 6)), meta | {"matched_threads": "x"})


def test_duplicates(spark):
    rows = spark.createDataFrame([("k", "a"), ("k", "a"), ("j", "b"), ("j", "c"), ("n", None), ("n", None)], "key string, name string")
    kept, conflicts = checks.collapse(rows, ["key"])
    assert kept.count() == 4 and [r.key for r in conflicts.collect()] == ["j"]
    with pytest.raises(checks.CheckFailed, match="'key': 'j'"):
        checks.require_none(conflicts, "conflicting rows")


def test_links(spark):
    good = "https://h.example/a/b?course_seq_no=7&x=1"
    bad = {"http" + good[5:]: "scheme", "https://o.example/a/b?course_seq_no=7": "host", "https://h.example/a?course_seq_no=7": "path", "https://h.example/a/b?course_seq_no=8": "number", "https://u@h.example/a/b?course_seq_no=7": "user", good + "&": "trailing", "": "missing"}
    rows = spark.createDataFrame([(u, "7") for u in (good, *bad)], "url string, seq string")
    got = {r.url: r.fault for r in rows.select("url", checks.link_fault(F.col("url"), "h.example", "/a/b", F.col("seq")).alias("fault")).collect()}
    assert got == {good: None, **bad}


def test_visits(spark):
    now = 1_700_000_000
    rows = [(now, "a", "Mozilla"), (now + 1, "a", "Mozilla"), (now, "b", "Googlebot/2"), (now, "c", ""), (now - 30 * 86400, "d", "Mozilla"), (now, "e", None), (now - 86400, "a", "Mozilla")]
    days = activity.visit_days(spark.createDataFrame(rows, "at long, ip_hash string, agent string"))
    s = activity.visit_stats(days, now).first()
    assert (s.today_views, s.today_visitors, s.week_views, s.week_visitors, s.total_views, s.total_visitors) == (2, 1, 3, 1, 4, 2)
    tr = [r.views for r in activity.trend(days, now).orderBy("day").collect()]
    assert tr == [0, 0, 0, 0, 0, 1, 2]
    merged = activity.merge_days(days, days).where("ip_hash = 'd'").first()
    assert merged.views == 2
    assert activity.visit_stats(days.limit(0), now).first().total_views == 0
    edge = spark.createDataFrame([(57600 - 1,), (57600,)], "at long")
    assert [r[0] for r in edge.select(activity.t.beijing_day("at")).collect()] == ["1970-01-01", "1970-01-02"]


def test_limiter(spark):
    rows = [("a", 100 + k, k) for k in range(7)] + [("b", 100, 50), ("a", 100 + 3600, 51), ("a", 100 + 3601, 52)]
    got = {r.id: r.ok for r in activity.accepted(spark.createDataFrame(rows, "sender string, at long, id long")).collect()}
    assert [got[k] for k in range(7)] == [True] * 5 + [False] * 2 and got[50] and got[51] and got[52]
    ok, _ = activity.admit(list(range(0, 30 * 3600, 3600)), activity.LIMITS)
    assert sum(ok[:24]) == 20


def test_redaction(spark):
    text = "notes by wechat: reader_of_maps，15900001111 or me.too@post.example，qq 号 7654321\x00 end"
    got = spark.createDataFrame([(text,), (None,)], "x string").select(mining.redact("x").alias("x")).collect()
    assert not any(s in got[0].x for s in ("reader_of_maps", "15900001111", "me.too@post.example", "7654321", "\x00")) and mining.HIDDEN in got[0].x and got[1].x is None


NAMES = [("90000001", "Harbour Law"), ("90000002", "Go"), ("90000003", "Harbour Law and Trade"), ("90000004", "Tides"), ("", "Ink"), ("", "Maps （North）")]
RULES = Rules(context=("course", "teacher", "exam"), near=12, not_before=(" as a hobby",), nicknames={"HLT": "Harbour Law and Trade", "sea": "Seamanship"}, boundaries=("seaside",), titles=(" teaches", " (Prof.)"))


def test_matcher():
    m = Matcher(NAMES, RULES)
    assert m.match("Harbour Law and Trade twice, Tides once") == {"Harbour Law and Trade", "Tides"}
    assert m.match("Harbour Law and Tradition") == {"Harbour Law"} and m.match("see 90000004") == {"Tides"}
    assert m.match("we Go there") == set() and m.match("the course Go is hard", allow_short=True) == {"Go"} and m.match("we Go home now", allow_short=True) == set()
    assert m.match("•Go\n•Ink", allow_short=True) == {"Go", "Ink"} and m.match("Maps North") == {"Maps （North）"}
    assert m.match("HLT or sea") == {"Harbour Law and Trade", "Seamanship"} and m.match("a seaside walk") == set()
    assert m.match_contextual("Tides as a hobby: no exam") == set() and m.match_contextual("the Tides exam") == {"Tides"} and m.match_contextual("Tides and nothing else at all") == set()
    assert m.match(None) == set() and m.match("") == set() and Matcher([]).match("x") == set()


@pytest.mark.parametrize("seed", range(5))
def test_longest_is_the_sorted_alternation(seed):
    rng = random.Random(seed)
    names = {"".join(rng.choice("aé海b") for _ in range(rng.randint(1, 5))) for _ in range(12)}
    text = "".join(rng.choice("aé海bc🎈") for _ in range(400))
    pattern = re.compile("|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n)))))
    assert Longest(names).spans(text) == [m.span() for m in pattern.finditer(text)]


def test_highlighter(spark):
    rows = [("Harbour Law", "Ada Quill(chair),Ben Ost"), ("Harbour Law and Trade", "Cy Dorn"), ("Tides", "Ada Quill"), ("Maps （North）", None)]
    h = Highlighter(rows, RULES, [("Cy Dorn", "CD"), ("Ada Quill", "adq")])
    cut = lambda t, c: [(t[s:e], kind, how) for s, e, kind, how in h.match(t, c)]
    assert cut("Harbour Law with Ada Quill and Ben Ost", {"Harbour Law"}) == [("Harbour Law", "course", "full"), ("Ada Quill", "teacher", "full"), ("Ben Ost", "teacher", "full")]
    assert cut("Ada Quill was late", set()) == [] and cut("Ada Quill teaches well", set()) == [("Ada Quill", "teacher", "full")]
    assert cut("Harbour Law and Trade", {"Harbour Law and Trade", "Harbour Law"}) == [("Harbour Law and Trade", "course", "full")]
    assert cut("Maps North", {"Maps （North）"}) == [("Maps North", "course", "full")] and cut("HLT and CD", {"Harbour Law and Trade"}) == [("HLT", "course", "alias"), ("CD", "teacher", "alias")]
    assert cut("HLT and cd, adq", {"Harbour Law and Trade", "Tides"}) == [("HLT", "course", "alias"), ("adq", "teacher", "alias")]
    entries = spark.createDataFrame([("p1", "oh Tides", ["Tides"]), ("p2", None, None)], "entry_key string, content string, courses array<string>")
    got = {r.entry_key: r.highlights for r in mining.highlight(entries, spark.createDataFrame(rows, "course_name string, teacher string"), rules=RULES).collect()}
    assert (got["p1"][0].start_offset, got["p1"][0].end_offset) == (3, 8) and got["p2"] == []
    tags = mining.tag_courses(entries, spark.createDataFrame(NAMES, "code string, name string")).collect()
    assert [(r.entry_key, r.course_name) for r in tags] == [("p1", "Tides")]


def test_teacher_initials(spark):
    names = spark.createDataFrame([("山水田",), ("木火",), ("木石",), ("山Smith",), ("山",), (None,)], "teacher string")
    table = [("山", "shan"), ("水", "shui"), ("田", "dian"), ("木", "Mo"), ("田", "tian"), ("木", "mu"), ("火", "huo"), ("石", "lz")]
    got = mining.teacher_initials(names, spark.createDataFrame(table, "letter string, syllable string"), noise=("ml",)).collect()
    assert {(r.teacher, r.initials) for r in got} == {("山水田", "sst"), ("山水田", "ssd"), ("木火", "mh")}


def test_entity_pairs_both_ways(spark):
    texts = spark.createDataFrame([(1, "one two three four five"), (2, "four five"), (3, None), (4, "")], "k long, t string")
    names = spark.createDataFrame([(7, "two three four"), (8, "five"), (9, ""), (10, None), (11, "five")], "n long, s string")
    want = {(1, 7), (1, 8), (2, 8), (1, 11), (2, 11)}
    for most in (100, 1):
        assert {tuple(r) for r in mining.entity_pairs(texts, names, "k", "t", "n", "s", most).collect()} == want


def test_longest_matches_both_ways(spark):
    rng = random.Random(3)
    texts = [(k, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 60)))) for k in range(30)] + [(30, None), (31, "")]
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 16))) for _ in range(40)} | {"", "ab" * 9}
    pattern = re.compile("|".join(map(re.escape, sorted(words - {""}, key=lambda n: (-len(n), n)))))
    want = {(k, m[0], *m.span()) for k, t in texts for m in pattern.finditer(t or "")}
    t, n = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "name string")
    for most in (100, 1):
        assert {tuple(r) for r in mining.longest_matches(t, "k", "t", n, most=most, gram=3).collect()} == want
    assert mining.longest_matches(t, "k", "t", n.limit(0)).count() == 0


def test_classifier_is_naive_bayes(spark):
    rng = random.Random(1)
    words = {"review": "clear strict fair 认真 slides".split(), "request": "which when anyone 请问 seek".split(), "dropped": "sell flat 出租 tickets deal".split()}
    say = lambda kind: " ".join(rng.choice(words[kind] if rng.random() < 0.7 else ["the", "a", "課", "of"]) for _ in range(12))
    rows = [(k, say(kind), kind) for k, kind in enumerate(list(words) * 30)]
    m = Classifier.learn(spark.createDataFrame([*rows[:60], (99, "x", None)], "id long, text string, kind string"))
    tests = spark.createDataFrame([*rows[60:], (200, None, None), (201, "unseen", None)], "id long, text string, kind string")
    got = {r.id: r for r in m.classify(tests.drop("kind"), "id", "text").collect()}
    assert m.kinds == ("dropped", "request", "review") and len(got) == 32
    of = lambda t: set(re.findall("[a-z0-9]+", t)) | {t[i : i + 2] for i in range(len(t) - 1) if all("\u4e00" <= ch <= "\u9fff" for ch in t[i : i + 2])}
    seen = {f for _, t, _ in rows[:60] for f in of(t)}
    counts = {k: Counter(f for _, t, x in rows[:60] if x == k for f in of(t)) for k in m.kinds}
    for i, t, kind in rows[60:]:
        s = sorted((sum(math.log((counts[k][f] + 1) / (sum(counts[k].values()) + len(seen))) for f in of(t) & seen) + math.log(1 / 3), k) for k in m.kinds)
        assert got[i].kind == s[-1][1] and got[i].margin == pytest.approx(s[-1][0] - s[-2][0])
    assert sum(got[i].kind == kind for i, _, kind in rows[60:]) >= 28 and got[200].margin == got[201].margin == 0
    with pytest.raises(ValueError, match="kinds"):
        Classifier.learn(tests.where("kind IS NULL"))


def test_kept_replies(spark):
    r = spark.createDataFrame([(1, 1, "x", [], True), (1, 2, "y", ["own"], True), (1, 3, "z", [], False), (2, 4, "z", None, True), (3, 5, "q", [], True), (1, 6, "n", [], None)], "pid long, cid long, content string, courses array<string>, useful boolean")
    posts = spark.createDataFrame([(1, ["one"]), (2, ["one", "two"])], "pid long, courses array<string>")
    assert {(x.cid, *x.courses) for x in mining.kept_replies(r, posts).collect()} == {(1, "one"), (2, "own"), (4,)}


def test_translation_selection(spark):
    rows = spark.createDataFrame([(1, " One "), (2, "  "), (3, "Three"), (4, None)], "id long, english_name string")
    tr = spark.createDataFrame([(3, "course_name", "en", "x"), (1, "notes", "en", " ")], "course_id long, field string, lang string, text string")
    assert [(r.course_id, r.text) for r in translation.reuse_english(rows, tr, 5).collect()] == [(1, "One")]
    gaps = translation.gaps(translation.field_matrix(rows, "id", {"english_name": "notes"}), tr, ["en", "de"]).collect()
    assert {(r.id, r.missing) for r in gaps} == {(1, "de,en"), (3, "de,en")}


def test_json_sources(spark, tmp_path):
    row = {"课程类型": "必修", "数据学期": "x", "详情链接": "l", "课程序号": "1", "基本信息": {"课程号": "c", "课程名": "n", "学分": "2.0", "上课时间及教室": "1~2周 每周周一1~2节 一教101"}, "详细信息": {"英文名称": "e"}}
    (tmp_path / "a.json").write_text(json.dumps([row], ensure_ascii=False))
    got = catalog_json.listing_columns(catalog_json.read_listings(spark, str(tmp_path / "a.json"))).first()
    assert (got.course_name, got.english_name, got.syllabus, got.credits) == ("n", "e", "", "2.0")
    parts = spark.createDataFrame([(got.schedule,)], "schedule string").select(*(x.alias(k) for k, x in catalog_json.schedule_parts().items())).first()
    assert (parts.weekdays, parts.first_period, parts.classroom) == ("周一", 1, "一教101")
    (tmp_path / "b.json").write_text(json.dumps([row | {"基本信息": "none"}], ensure_ascii=False))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        catalog_json.read_listings(spark, str(tmp_path / "b.json")).collect()
    shard = {"version": 2, "key": "2024-01", "posts": {"5": {"pid": 5, "text": "t", "timestamp": 9, "url": "u", "authorTag": "secret", "comments": [{"cid": 1, "floor": 1, "text": "r", "timestamp": 10}, {"cid": 2, "floor": 2, "text": " ", "timestamp": 11}]}}}
    (tmp_path / "s.json").write_text(json.dumps(shard))
    posts = catalog_json.shard_posts(catalog_json.read_shards(spark, str(tmp_path / "s.json")))
    assert "authorTag" not in str(posts.schema) and [(r.pid, r.ordinal, r.cid) for r in catalog_json.post_replies(posts).collect()] == [(5, 0, 1)]
    (tmp_path / "t.json").write_text(json.dumps(shard | {"posts": {"5": {"pid": 5, "comments": {}}}}))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        catalog_json.read_shards(spark, str(tmp_path / "t.json")).collect()


def test_publishing(spark, tmp_path):
    root, rows = str(tmp_path), spark.createDataFrame([(1,), (2,)], "x long")
    publish.publish(rows, root, lambda _: None, "one")
    publish.publish(rows.limit(1), root, lambda _: None, "one")  # the same batch again

    def reject(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        publish.publish(rows.limit(1), root, reject, "two")
    assert publish.current(spark, root).count() == 2
    publish.publish(rows.limit(1), root, lambda _: None, "three")
    assert publish.current(spark, root).count() == 1
    raw = spark.createDataFrame([(b"{bad",)], "body binary")
    with pytest.raises(ValueError):
        publish.archive(raw, root + "/a", reject)
    assert publish.current(spark, root + "/a") is None and spark.read.parquet(root + "/a/raw/*").first().body == b"{bad"
    with pytest.raises(ValueError, match="missing 1 replies"):
        publish.enrich(rows, rows.limit(1).withColumn("y", F.lit(1)), "x", "replies")


def test_messages_within_limits(spark):
    old = spark.createDataFrame([(5, 100, "m", "a"), (6, 200, "m", "a")], "id long, posted_at long, content string, ip_hash string")
    tries = [(1, 300, "x", "a"), (2, 301, "y", "a"), (3, 302, "z", "b"), (4, 4000, "late", "a"), (None, 5, "q", "a")]
    got = activity.post_messages(old, spark.createDataFrame(tries, "attempt long, posted_at long, content string, ip_hash string"), ((3600, 3), (86400, 20)))
    assert sorted(map(tuple, got.collect())) == [(7, 300, "x", "a"), (8, 302, "z", "b"), (9, 4000, "late", "a")]
    assert activity.post_messages(old.limit(0), spark.createDataFrame(tries[:1], "attempt long, posted_at long, content string, ip_hash string")).first().id == 1


def test_tables_are_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    storage.table(spark.range(3), "x")
    assert list(tmp_path.glob("tables-*/x-*"))
    storage.drop_tables(spark)
    assert not list(tmp_path.glob("tables-*"))


@pytest.mark.parametrize("master,fine", [("local[2]", True), ("spark://h:7077", False), ("yarn", False)])
def test_shared_folder_where_it_is_unset(master, fine):
    class Context:
        folder = None
        getCheckpointDir = lambda self: self.folder
        setCheckpointDir = lambda self, x: setattr(self, "folder", f"{x}/1")

    class Session:
        conf = {}
        sparkContext = Context()  # noqa: N815  Spark's name

    Session.sparkContext.master = master
    if fine:
        assert storage.shared_dir(Session()).endswith("/checkpoints/1") == (storage.shared_dir(Session()) == Session.sparkContext.folder)
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(Session())


def test_redaction_leaves_longer_words_and_numbers(spark):
    say = {
        "order 202613900000000012345": None, "see faq 123456": None, "see FAQ123456 and 213812345678": None, "qq 123456789012": None, "avx abcdef": None, "a@b": None,
        "tel 13812345678, 13912345678.": "tel H, H.", "x13812345678y": "xHy", "Q123456": "H", "qq群：1234567x": "Hx", "加微信abcde_1 ok": "加H ok", "(VX: abcdef)": "(H)", "mail a.b+c@d-e.org!": "mail H!", "": "", "\x00a": "a",
    }
    rows = spark.createDataFrame(list(enumerate(say)), "k int, x string").select("k", mining.redact("x", hidden="H").alias("y")).orderBy("k").collect()
    assert [r.y for r in rows] == [x if y is None else y for x, y in say.items()]
