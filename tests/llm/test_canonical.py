import random
import re
from pathlib import Path

import pytest

from rosterlake.llm import canonical
from rosterlake.llm.canonical import map_to_reference
from rosterlake.session import trim_driver

REF = [
    (1, "location", "Port Alda, Japan", "APAC", ["PALD", "Old Aldus"]),
    (2, "location", "Port Alda, Peru", "LatAm", None),
    (3, "location", "Süssberg, Germany", "Europe", None),
    (9, "region", "Europe", "Europe", None),
    (11, "current_firm_type", "hedge_fund", None, None),
    (12, "current_firm_type", "asset_owner", None, None),
]


def frames(spark, rows):
    ref = spark.createDataFrame(REF, "value_id long, field_name string, canonical string, market string, aliases array<string>")
    return spark.createDataFrame(rows, "candidate_id string, location string, region string, current_firm_type string, value_id int"), ref


def run(spark, rows):
    df, ref = frames(spark, rows)
    out = map_to_reference(df, "candidate_id", ["location", "region", "current_firm_type"], ref)
    return {(r["candidate_id"], r["field_name"]): r["value_id"] for r in out.collect()}


def test_ways_to_write(spark):
    ways = {
        "Port Alda, JP": 1, "JPN - port alda": 1, "Pt. Alda (Japan)": 1, "near PALD": 1, "Old Aldus, Japan 12345": 1, "PORT-ALDA / Peru": 2,
        "Susberg, Germany": 3, "Suessberg": 3, "Greater Süssberg Area": 3, "Süssbegr, DE": 3, "Deutschland: Süssberg": 3, "Portland": 0, "TBD": 0, "?": 0,
    }
    got = run(spark, [(str(i), w, None, None, 0) for i, w in enumerate(ways)])
    assert {w: got[str(i), "location"] for i, w in enumerate(ways)} == ways


def test_kinds(spark):
    got = run(spark, [("a", None, "EU", "HF", 0), ("b", "", "Eurpoe", "Asset  Ownr", 0), ("c", " ", "Global", "hegde-fund", 0), ("d", None, "Europe", "hedge_fund", 0)])
    assert got == {("a", "region"): 9, ("a", "current_firm_type"): 11, ("b", "region"): 9, ("b", "current_firm_type"): 12, ("c", "region"): 0, ("c", "current_firm_type"): 11}


def test_pigeonhole_loses_nothing(spark):
    """Every single edit of a form is found."""
    rng = random.Random(2)
    base = "port alda, peru"
    typed = set()
    for i in range(len("port alda")):
        typed |= {base[:i] + base[i + 1 :], base[:i] + "x" + base[i:], base[:i] + "q" + base[i + 1 :], base[:i] + base[i : i + 2][::-1] + base[i + 2 :]}
    typed = sorted(t for t in typed if t != base)
    rng.shuffle(typed)
    got = run(spark, [(str(i), t, None, None, 0) for i, t in enumerate(typed)])
    assert [t for i, t in enumerate(typed) if got[str(i), "location"] != 2] == []


def test_edges(spark):
    df, ref = frames(spark, [("a", "x" * 5000, None, None, 0), ("a", "x" * 5000, None, None, 0), (None, "y", None, None, 0)])
    fields = ["location", "region", "current_firm_type"]
    assert [r["value_id"] for r in map_to_reference(df, "candidate_id", fields, ref).collect()] == [0]
    assert map_to_reference(df.limit(0), "candidate_id", fields, ref).count() == 0
    assert map_to_reference(df, "candidate_id", fields, ref.limit(0)).count() == 1


def test_plans_stay_small(spark, monkeypatch):
    """No step computes what another shares with it again: large plans fill the driver's memory."""
    joins, cut = [], canonical.cut

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut(df)

    monkeypatch.setattr(canonical, "cut", counted)
    assert run(spark, [("a", "Pt. Alda, JP", "EU", "HF", 0)]) == {("a", "location"): 1, ("a", "region"): 9, ("a", "current_firm_type"): 11}
    assert max(joins) <= 10


def test_few_jobs(spark):
    """The fixed list is worked up by one task a step: each job more is planned, and kept, in the driver."""
    context = spark.sparkContext
    context.setJobGroup("few jobs", "")
    try:
        assert run(spark, [("a", "Pt. Alda, JP", "EU", "HF", 0)]) == {("a", "location"): 1, ("a", "region"): 9, ("a", "current_firm_type"): 11}
        jobs = len(context.statusTracker().getJobIdsForGroup("few jobs"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 85, jobs


def test_driver_hands_memory_back(spark):
    """After a run the driver's JVM holds few MB that it has freed."""
    run(spark, [("a", "Pt. Alda, JP", "EU", "HF", 0)])
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) >> 10

    before = resident()
    if not trim_driver(spark):
        pytest.skip("this JVM can't hand memory back")
    assert before - resident() < 80, (before, resident())
