import random

import pytest
from pyspark.sql import functions as F

from rosterlake.functions.months import month_number
from rosterlake.operators import intervals as I
from rosterlake.operators.interval_map import IntervalMap, periods_and_gaps
from rosterlake.streaming.intervals import stream_periods


def brute(spans):
    covered = {m for s, e in spans for m in range(s, e)}
    out, start = [], None
    for m in sorted(covered):
        if m - 1 not in covered:
            start = m
        if m + 1 not in covered:
            out.append((start, m + 1))
    return out


def test_interval_map_random():
    rng = random.Random(5)
    for _ in range(300):
        spans = [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(rng.randint(1, 14)))]
        m = IntervalMap()
        for s, e in spans:
            m.insert(s, e)
        assert list(m.periods()) == brute(spans)
        assert list(m.gaps()) == [(a[1], b[0]) for a, b in zip(brute(spans), brute(spans)[1:])]


def test_hot_key_meets_under_salts(spark):
    rows = [("hot", (i * 37) % 4000, (i * 37) % 4000 + 1) for i in range(6000) if (i * 37) % 4000 % 3] + [("cold", 5, 9)]
    df = spark.createDataFrame(rows, "key string, a int, b int").repartition(2)
    out = periods_and_gaps(df, "key", "a", "b").collect()
    want = brute([(s, e) for k, s, e in rows if k == "hot"])
    assert sorted((r["a"], r["b"]) for r in out if r["key"] == "hot" and r["span_kind"] == "period") == want
    assert sorted((r["a"], r["b"]) for r in out if r["key"] == "hot" and r["span_kind"] == "gap") == [(x[1], y[0]) for x, y in zip(want, want[1:])]
    assert len(out) == 2 * len(want)


def test_periods_and_gaps(spark):
    rng = random.Random(6)
    rows = [(f"k{rng.randint(0, 9) if i % 3 else 0}", s, s + rng.randint(-1, 9), "x") for i, s in enumerate(rng.randint(0, 400) for _ in range(3000))]
    rows += [("k1", None, 5, "x"), ("k1", 5, None, "x"), (None, 1, 9, "x")]
    df = spark.createDataFrame(rows, "key string, a int, b int, span_kind string").repartition(5)
    got = {(r["key"], r["a"], r["b"]) for r in periods_and_gaps(df, "key", "a", "b").collect() if r["span_kind"] == "period"}
    want = set()
    for k in {r[0] for r in rows if r[0]}:
        want |= {(k, s, e) for s, e in brute([(a, b) for key, a, b, _ in rows if key == k and a is not None and b is not None and b > a])}
    assert got == want
    assert periods_and_gaps(df.limit(0), "key", "a", "b").count() == 0


def test_stream_gives_the_same(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"k{rng.randint(0, 3)}", s, s + rng.randint(1, 6)) for s in (rng.randint(0, 80) for _ in range(60))]
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], "key string, s int, e int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, s int, e int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_periods(stream).writeStream.format("memory").queryName("spans").outputMode("update").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    out = spark.sql("SELECT * FROM spans").toPandas()
    last = out.groupby("key").version.transform("max")
    now = out[(out.version == last) & (out.span_kind == "period")]
    for k in {r[0] for r in rows}:
        assert sorted(zip(now[now.key == k].span_start, now[now.key == k].span_end)) == brute([(s, e) for key, s, e in rows if key == k])


@pytest.mark.parametrize(
    ("text", "month"),
    [
        ("2011-04", 2011 * 12 + 4), ("2011-4", 2011 * 12 + 4), ("2011/04", 2011 * 12 + 4), ("2011.04", 2011 * 12 + 4), ("04/2011", 2011 * 12 + 4),
        ("2011-04-30", 2011 * 12 + 4), (" 2011-04 ", 2011 * 12 + 4), ("Apr 2011", 2011 * 12 + 4), ("APRIL, 2011", 2011 * 12 + 4), ("2011", 2011 * 12 + 6),
        ("2011-13", None), ("2011-00", None), ("tbc", None), ("", None), (None, None), ("1850", None), ("present", None), ("13/2011", None),
    ],
)
def test_months(spark, text, month):
    assert spark.createDataFrame([(text,)], "t string").select(month_number(F.col("t")).alias("m")).first()["m"] == month


def test_years_of_experience(spark):
    def years(rows):
        df = spark.createDataFrame(rows, "id string, s int, e int, is_current boolean, duration_months int, kind string")
        return I.years_of_experience(df, "id", 2026 * 12, F.col("kind") == "paid").first()["years"]

    a = 2020 * 12 + 1
    assert years([("x", a, a + 24, False, None, "paid"), ("x", a + 12, a + 36, False, None, "paid")]) == 3.0
    assert years([("x", a, a + 24, False, None, "club")]) == 0.0
    assert years([("x", None, None, False, None, "paid")]) is None
    assert years([("x", None, None, False, 6, "paid")]) == 0.5


def test_concurrent_equals_all_pairs(spark):
    rng = random.Random(9)
    rows = [("k", i, s, s + rng.randint(1, 90)) for i, s in enumerate(rng.randint(0, 300) for _ in range(60))]
    df = spark.createDataFrame(rows, "k string, pos int, s int, e int")
    got = {(r["first"], r["second"], r["months"]) for r in I.concurrent(df, "k", "pos", 2).collect()}
    want = {(i, j, min(e, f) - max(s, t)) for _, i, s, e in rows for _, j, t, f in rows if i < j and min(e, f) - max(s, t) >= 2}
    assert got == want


def test_month_text(spark):
    row = spark.range(1).select(I.month_text(F.lit(2020 * 12 + 12)).alias("a"), I.month_text(F.lit(2021 * 12 + 1)).alias("b")).first()
    assert (row["a"], row["b"]) == ("2020-12", "2021-01")
