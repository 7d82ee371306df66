import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import canonical  # noqa: E402

PLAIN = {n for m in entry.MODULES if "llm" not in m.__name__ for n in m.QUERIES}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_query(spark, small, duck, name):
    got = entry.queries()[name](spark, small).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert canonical(got) == canonical(duck.execute(sql).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_match_invariants(spark, small):
    rows = entry.queries()["match_exact_near"](spark, small).collect()
    exact = {(r["requisition_id"], r["candidate_id"]) for r in rows if r["result"] == "exact"}
    near = {(r["requisition_id"], r["candidate_id"]) for r in rows if r["result"] == "near"}
    assert not exact & near
    assert all((r["gap"] is None) == (r["result"] == "exact") and 0 <= r["score"] <= 1 for r in rows)
    total = next(r for r in entry.queries()["confusion_matrix"](spark, small).collect() if r["requisition_id"] is None)
    assert total["tp"] + total["fp"] + total["fn"] + total["tn"] == total["judged"]


def test_presentation_of_all_results(spark, small):
    def pairs(name):
        return sorted((r["requisition_id"], r["candidate_id"]) for r in entry.queries()[name](spark, small).collect())

    rows = entry.queries()["match_exact_near"](spark, small).collect()
    exact = sorted((r["requisition_id"], r["candidate_id"]) for r in rows if r["result"] == "exact")
    assert max(r["rank"] for r in rows) > 20
    assert pairs("result_lines") == sorted((r["requisition_id"], r["candidate_id"]) for r in rows)
    assert pairs("outreach_text") == exact and sorted(set(pairs("score_ledger"))) == sorted(set(exact))
