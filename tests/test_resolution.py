"""Resolution and what builds on it against plain Python, over whole tables and on cases of their own."""

import difflib
import re
import unicodedata

import __spark_entry__ as entry
from rosterlake.operators import resolve as R

LEGAL = "ltd limited llc llp lp inc incorporated corp corporation co plc pvt private group holdings company management".split()
PLATFORM = {"multi_strategy_platform", "pod_shop"}
BUY = {"pod_shop", "multi_strategy_platform", "hedge_fund", "crossover", "long_only", "asset_owner", "alternative_manager"}
SELL = {"sell_side", "investment_bank"}


def plain_fold(name):
    t = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().replace("&", " and ")
    for c in ".,'\"()-–—/":
        t = t.replace(c, " ")
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in " ".join(w for w in t.split() if w not in LEGAL)).split()
    return " ".join(words)


class Book:
    """A plain resolver over a list of (canonical, aliases)."""

    def __init__(self, firms):
        self.index, self.own = {}, set()
        for canonical, aliases in firms:
            self.index[plain_fold(canonical)] = canonical
            self.own.add(plain_fold(canonical))
            for a in aliases or []:
                self.index.setdefault(plain_fold(a), canonical)
        self.index.pop("", None)
        self.names = {c for c, _ in firms}

    def resolve(self, raw):
        if raw in self.names:
            return raw, "exact"
        key = plain_fold(raw)
        if key in self.index:
            return self.index[key], "exact" if key == plain_fold(self.index[key]) else "alias"
        head = raw.split(",")[0].strip() if "," in raw else ""
        if len(head) > 3 and (found := self.resolve(head))[0]:
            return found[0], "division"
        words = set(key.split())
        if words and len({c for k, c in self.index.items() if words < set(k.split())}) > 1:
            return None, "ambiguous"
        scored = sorted(((difflib.SequenceMatcher(None, key, k).ratio(), k) for k in self.index), reverse=True)[:4]
        if scored and scored[0][0] >= 0.88:
            near = {self.index[k] for r, k in scored if r > scored[0][0] - 0.06}
            return (self.index[scored[0][1]], "fuzzy") if len(near) == 1 else (None, "ambiguous")
        return None, "unresolved"


CASES = [("Société Brenne Holdings", ["Brenne SA"]), ("Harrow Point Capital", None), ("Harrow Lane Partners", None), ("Ostrava Group LLC", ["Ostrava Research"])]


def test_fold_keeps_accented_letters(spark):
    df = spark.createDataFrame([("Société Générale Holdings Co.",), ("Müller & Söhne GmbH",), ("Group Ltd",), (None,), ("ＡＢＣ plc",)], "n string")
    got = [r[0] for r in df.select(R.fold_name(df.n)).collect()]
    assert got == ["societe generale", "muller and sohne gmbh", "", None, "abc"]


def test_cascade(spark):
    raws = [
        "Societe Brenne", "Société Brenne Holdings", "brenne sa", "Société Brenne, Risk Desk", "Harrow", "Harrow Point", "Harow Point Capital", "Ostrava",
        "OSTRAVA RESEARCH Ltd.", "Brenne S.A.", "Zzz", "日本", "Soc", "a, b",
    ]
    firms = spark.createDataFrame([(c, a, i) for i, (c, a) in enumerate(CASES)], "canonical string, aliases array<string>, ord int")
    names = spark.createDataFrame([(r,) for r in raws], "firm string")
    book = Book(CASES)
    got = {r["raw"]: (r["canonical"], r["resolution"]) for r in R.resolve_fully(names, firms).collect()}
    assert got == {r: book.resolve(r) for r in raws}
    assert got["Harrow"] == (None, "ambiguous") and got["Société Brenne, Risk Desk"] == ("Société Brenne Holdings", "division")


def test_index_precedence(spark):
    firms = [("Alda Ltd", ["Boro"], 0), ("Boro Inc", ["Alda"], 1), ("Alda Group", None, 2), ("Cora", ["Dena"], 3), ("Emma", ["Dena"], 4)]
    got = {r["key"]: r["canonical"] for r in R.name_index(spark.createDataFrame(firms, "canonical string, aliases array<string>, ord int")).collect()}
    assert got == {"alda": "Alda Group", "boro": "Boro Inc", "cora": "Cora", "dena": "Cora", "emma": "Emma"}


def rows_of(spark, small, name):
    return [r.asDict() for r in spark.read.parquet(f"{small}/{name}.parquet").collect()]


def test_queries_through_resolved_names(spark, small):
    firms = rows_of(spark, small, "firms")
    book, kind, parent = Book([(f["canonical"], f["aliases"]) for f in firms]), {f["canonical"]: f["firm_type"] for f in firms}, {f["canonical"]: f["parent"] for f in firms}
    work = {(p["candidate_id"], p["pos"], p["firm"], p["title"], p["employment_type"], p["is_current"]) for p in rows_of(spark, small, "positions")}
    found = {p[2]: book.resolve(p[2]) for p in work if p[2] and p[2].strip()}
    sides, alumni, current, edges = {}, {}, {}, set()
    for cid, pos, firm, title, employment, now in sorted(work, key=lambda p: (p[0], p[1], str(p[2]))):
        canonical, how = found.get(firm, (None, None))
        kinds = sides.setdefault(cid, set())
        if canonical:
            kinds.add(kind[canonical])
            if how in ("exact", "alias", "fuzzy"):
                edges.add((cid, canonical))
        if employment == "professional" and canonical:
            at, seen = canonical, []
            while at and at not in seen:
                seen.append(at)
                if kind.get(at) in PLATFORM and (p := parent.get(at) or at) not in alumni.setdefault(cid, []):
                    alumni[cid].append(p)
                at = parent.get(at)
        if now and employment == "professional":
            current.setdefault(cid, (pos, canonical or firm, kind.get(canonical)))
    q = entry.queries()
    got = {r["candidate_id"]: (r["buy"], r["sell"]) for r in q["market_sides"](spark, small).collect()}
    assert got == {c: (bool(k & BUY), bool(k & SELL)) for c, k in sides.items()}
    got = {r["candidate_id"]: r["platforms"] for r in q["platform_alumni"](spark, small).collect()}
    assert got == {c: "; ".join(p) for c, p in alumni.items() if p}
    got = {r["candidate_id"]: (r["pos"], r["employer"], r["firm_type"]) for r in q["current_role"](spark, small).collect()}
    assert got == current
    net = q["network_edges"](spark, small).toPandas()
    assert edges == {(a, b) for a, b in net[net.kind == "employment"][["a", "b"]].itertuples(index=False, name=None)}


def test_short_names(spark, small):
    got = {(r["candidate_id"], r["short_name"]) for r in entry.queries()["text_short_name"](spark, small).collect()}
    want = set()
    for cid, name in {(c["candidate_id"], c["name"]) for c in rows_of(spark, small, "candidates")}:
        words = re.sub(r"^((dr|mr|ms|mrs|prof)\.?\s+)+", "", name or "", flags=re.I).split()
        kept = [w for w in words if not w.startswith("(")]
        want.add((cid, kept[-1] if kept else None))
    assert got == want
