"""The rate limiter against a plain loop, with senders of very many attempts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomcat.operators import activity
from loomcat.streaming import activity as streams

LIMITS = ((60, 3), (600, 8))


def brute(rows, limits=LIMITS):
    ok, past = set(), defaultdict(list)
    for at, who, i in sorted({(at, who, i) for who, at, i in rows}, key=lambda x: (str(x[1]), x[0], x[2])):
        if all(sum(t > at - w for t in past[who]) < n for w, n in limits):
            past[who].append(at)
            ok.add((who, at, i))
    return ok


def attempts(seed, n, hot=0.5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        who = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None, ""])
        rows.append((who, rng.choice([0, 5000, 9000, 9600, 10199, 10200, 30000]) + rng.choice([rng.randint(0, 40), rng.randint(0, 900)]), i))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_limits_are_kept_in_order(spark, seed):
    rows = attempts(seed, 600)
    df = spark.createDataFrame(rows + rows[:20], "sender string, at long, id long").repartition(5)
    got = activity.accepted(df, LIMITS).collect()
    assert len(got) == len(rows) + 20
    want = brute(rows)
    assert all(r.ok == ((r.sender, r.at, r.id) in want) for r in got) and any(r.ok for r in got) and not all(r.ok for r in got)


def test_gaps_cut_a_sender(spark):
    df = spark.createDataFrame([("a", x, x) for x in (0, 599, 1198, 1798, 5000, 5599, 6199)] + [("b", 100, 1)], "sender string, at long, id long")
    got = {(r.sender, r.at): r.piece for r in activity.pieces(df, 600).collect()}
    assert [got["a", x] for x in (0, 599, 1198, 1798, 5000, 5599, 6199)] == [1, 1, 1, 2, 3, 3, 4] and got["b", 100] == 1


def test_a_sender_with_half_the_rows_is_dealt_out(spark):
    """Many attempts in few seconds: a task is given a bounded number of each second's."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 997)).alias("sender"), (F.col("id") % 40 * 1000).alias("at"), "id")
    known = rows.where("sender = 'hot'")
    assert known.count() == 20_000
    got = activity.accepted(rows, LIMITS)
    assert got.count() == 40_000 and got.where("sender = 'hot' AND ok").count() == 20 * 3
    cut = activity.pieces(rows.dropDuplicates(["sender", "at"]), 600)
    assert cut.where("sender = 'hot'").select("piece").distinct().count() == 20


def test_rows_that_cannot_be_decided(spark):
    rows = [("a", None, 1), ("a", 5, None), (None, 5, 2), ("a", 5, 3)]
    got = {(r.sender, r.at, r.id): r.ok for r in activity.accepted(spark.createDataFrame(rows, "sender string, at long, id long"), LIMITS).collect()}
    assert got == {("a", None, 1): None, ("a", 5, None): None, (None, 5, 2): True, ("a", 5, 3): True}
    assert activity.accepted(spark.createDataFrame([], "sender string, at long, id long")).count() == 0


def test_streams_decide_alike_and_count_what_came_late(spark, tmp_path):
    rows = sorted([r for r in attempts(9, 400) if r[0]], key=lambda r: r[1])
    schema = "sender string, at long, id long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(streams.STATE_STORE)
    got, late = streams.decided_and_late(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), LIMITS)
    want = brute(rows)
    assert late == 0 and {(r.sender, r.at, r.id): r.ok for r in got.collect()} == {r: r in want for r in rows}
    assert spark.conf.get(streams.STATE_STORE) == before
    spark.createDataFrame([("a", 10**6, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "two"))
    spark.createDataFrame([("b", 5, 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "two"))
    one_by_one = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "two"))
    got, late = streams.decided_and_late(one_by_one, LIMITS, "1 minute")
    assert got.count() + late == 2


def test_frames_are_read_one_by_one():
    import pandas as pd

    class Handle:
        def registerTimer(self, at):  # noqa: N802
            pass

    class Past:
        held: list = []

        def get(self):
            return self.held

        def put(self, rows):
            self.held = rows

    limiter = streams.Limiter(LIMITS)
    limiter.handle, limiter.past = Handle(), Past()
    rows = [("x", at, i) for i, at in enumerate([5, 5, 7, 5, 5, 5, 900, 7, 5, 900, 900, 900, 900, 0])]
    frames = [pd.DataFrame(rows[i : i + 3], columns=["sender", "at", "id"]) for i in range(0, len(rows), 3)]
    out = pd.concat(list(limiter.handleInputRows(("x",), iter(frames), None)))
    want = brute(rows)
    assert {(r.sender, r.at, r.id): bool(r.ok) for r in out.itertuples()} == {r: r in want for r in rows}
