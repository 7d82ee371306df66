import difflib
import io
import random
import re
import zipfile

from pyspark.sql import functions as F

from rosterlake.functions import text as T
from rosterlake.operators import checks as C
from rosterlake.operators import resolve as R
from rosterlake.plans.pool_queries import network_edges
from rosterlake.plans.resolve_queries import platform_alumni
from rosterlake.plans.text_queries import text_short_name
from rosterlake.sources.documents import read_csv, read_records, scan_directory
from rosterlake.sources.export import cache_misses, write_csv, write_json


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_repair(spark):
    r = one(spark, T.repair, "Quan�ta�ve Por�olio  ofﬁce\n\n\n\nx ")
    assert (r["text"], r["repairs"], r["remaining"]) == ("Quantitative Portfolio office\n\nx", 3, 0)
    r = one(spark, T.repair, "a clean line")
    assert (r["text"], r["repairs"], r["remaining"]) == ("a clean line", 0, 0)


def test_loose(spark):
    assert one(spark, T.loose, "  Sector-coverage,\n of 12 names! ") == "sector coverage of 12 names"
    assert one(spark, T.loose, None) is None


def test_short_name_of_all_scripts(spark, small):
    names = [
        "José Núñez", "Иван Петров", "Ελένη Παππά", "王 小明", "王\u3000小明", "Dr. Zoë\u00a0Brontë", "Søren Ødegård (він)", "Li\u200b Na", "Ann\u2003Lee",
        "Prof.\u00a0Dr. Łukasz Żak", "plain name",
    ]
    got = [r["v"] for r in spark.createDataFrame([(n,) for n in names], "t string").select(T.short_name(F.col("t")).alias("v")).collect()]
    assert got == [[w for w in n.split() if not w.startswith("(")][-1] for n in names]
    people = spark.read.parquet(f"{small}/candidates.parquet").select("candidate_id", "name", "source_file").distinct()
    assert text_short_name(spark, small).count() == people.count()


def test_lineage_with_cycle_and_self_loop(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("s", "s")]
    got = R.lineage(spark.createDataFrame(rows, "canonical string, parent string")).collect()
    up = {}
    for r in sorted(got, key=lambda r: r["lvl"]):
        up.setdefault(r["root"], []).append(r["ancestor"])
    assert up["a"] == ["b", "c"] and up["b"] == ["c"] and up["x"] == ["y", "x"] and "c" not in up


def test_resolver_tiers(spark):
    firms = spark.createDataFrame(
        [("Alpha Beta Bank", ["AB Bank"]), ("Alpha Gamma Capital", None), ("Delta Partners Ltd", None)], "canonical string, aliases array<string>"
    )
    names = spark.createDataFrame(
        [("Alpha Beta Bank",), ("alpha beta bank",), ("AB Bank",), ("Delta Partners, Risk Group",), ("Alpha",), ("Nowhere",), (None,), ("",)], "firm string"
    )
    got = {r["raw"]: (r["canonical"], r["resolution"]) for r in R.resolve_names(names, firms).collect()}
    assert got["Alpha Beta Bank"] == ("Alpha Beta Bank", "exact")
    assert got["alpha beta bank"] == ("Alpha Beta Bank", "exact")
    assert got["AB Bank"] == ("Alpha Beta Bank", "alias")
    assert got["Delta Partners, Risk Group"] == ("Delta Partners Ltd", "division")
    assert got["Alpha"] == (None, "ambiguous") and got["Nowhere"] == (None, "unresolved")
    assert len(got) == 6


def test_fuzzy_against_plain_python(spark):
    rng = random.Random(4)
    words = ["north", "river", "stone", "maple", "harbor", "summit", "copper", "meadow"]
    listed = sorted({" ".join(rng.sample(words, 3)) for _ in range(25)})
    typed = set()
    for n in listed:
        i = rng.randrange(len(n))
        typed |= {n[:i] + n[i + 1 :], n + " x", " ".join(rng.sample(words, 2))}
    firms = spark.createDataFrame([(n, None) for n in listed], "canonical string, aliases array<string>")
    names = spark.createDataFrame([(t,) for t in typed], "firm string")
    got = {r["raw"]: (r["canonical"], r["resolution"]) for r in R.fuzzy_resolve(names, firms).collect()}
    for t in typed:
        key = re.sub(" +", " ", t).strip()
        ranked = sorted(((difflib.SequenceMatcher(None, key, n).ratio(), n) for n in listed), reverse=True)[:4]
        near = {n for q, n in ranked if q > ranked[0][0] - 0.06}
        want = (None, "unresolved") if ranked[0][0] < 0.88 else (None, "ambiguous") if len(near) > 1 else (ranked[0][1], "fuzzy")
        assert got.get(t, (None, "unresolved")) == want, t


def test_fuzzy_keeps_names_without_candidates(spark):
    firms = spark.createDataFrame([("Northriver Stonebridge", None)], "canonical string, aliases array<string>")
    names = ["Northriver Stonebrige", "Zorkbaster Skorkalt", "Hulkgysk, Hulkgon", "北方", "&", "Northriver"]
    rows = R.fuzzy_resolve(spark.createDataFrame([(n,) for n in [*names, None]], "firm string"), firms).collect()
    assert sorted(r["raw"] for r in rows) == sorted(names)
    got = {r["raw"]: (r["canonical"], r["resolution"], r["ratio"]) for r in rows}
    ratio = difflib.SequenceMatcher(None, "northriver stonebrige", "northriver stonebridge").ratio()
    assert got.pop(names[0]) == ("Northriver Stonebridge", "fuzzy", ratio)
    assert set(got.values()) == {(None, "unresolved", None)}


FIRM_ROWS = [("Delta Partners Ltd", ["DP Bank"], "pod_shop", "Omega Holdings"), ("Omega Holdings", None, "multi_strategy_platform", None), ("Northriver Stonebridge", None, "hedge_fund", None)]


def test_resolve_fully(spark):
    firms = spark.createDataFrame(FIRM_ROWS, "canonical string, aliases array<string>, firm_type string, parent string")
    want = {
        "Delta Partners Ltd": ("Delta Partners Ltd", "exact"), "delta partners": ("Delta Partners Ltd", "exact"), "DP Bank": ("Delta Partners Ltd", "alias"),
        "Northriver Stonebrige": ("Northriver Stonebridge", "fuzzy"), "Northriver Stonebrige, Macro": ("Northriver Stonebridge", "division"),
        "DP Bank, Risk Group": ("Delta Partners Ltd", "division"), "Nowhere, Else": (None, "unresolved"), "北方": (None, "unresolved"),
    }
    names = spark.createDataFrame([(n,) for n in [*want, None, " "]], "firm string")
    rows = R.resolve_fully(names, firms).collect()
    assert {r["raw"]: (r["canonical"], r["resolution"]) for r in rows} == want and len(rows) == len(want)


def test_edges_and_platforms_of_resolved_names(spark, tmp_path):
    firms = spark.createDataFrame(FIRM_ROWS, "canonical string, aliases array<string>, firm_type string, parent string")
    firms.write.parquet(f"{tmp_path}/firms.parquet")
    typed = ["Delta Partners Ltd", "DP BANK", "Omega Holdngs", "DP Bank, Risk Group", "Nowhere"]
    rows = [(str(i), 0, n, "2020-01", "2021-01", False, "professional") for i, n in enumerate(typed)]
    kind = "candidate_id string, pos int, firm string, start_date string, end_date string, is_current boolean, employment_type string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/positions.parquet")
    edges = {(r["a"], r["b"]) for r in network_edges(spark, str(tmp_path)).collect()}
    # "Holdings" carries no identity, so its misspelling leaves a name that is not like "omega"
    assert edges == {("0", "Delta Partners Ltd"), ("1", "Delta Partners Ltd"), ("Delta Partners Ltd", "Omega Holdings")}
    platforms = {r["candidate_id"]: r["platforms"] for r in platform_alumni(spark, str(tmp_path)).collect()}
    assert platforms == dict.fromkeys("013", "Omega Holdings")


def words_of(s):
    return {w for w in re.findall("[a-z]{4,}", s.lower()) if w not in T.FLAG_STOP_WORDS}


def test_flag_merge_against_plain_python(spark):
    rng = random.Random(8)
    vocabulary = "table overlap months email column damaged shorter career pages letters dates city".split()
    cases = []
    for n in range(150):
        def some(k):
            return [(rng.choice(["formatting", "date_anomaly"]), "warning", " ".join(rng.choices(vocabulary, k=rng.randint(0, 5)))) for _ in range(rng.randint(0, k))]

        cases.append((n, some(3), some(5)))
    kind = "array<struct<category:string,severity:string,summary:string>>"
    df = spark.createDataFrame(cases, f"n int, a {kind}, b {kind}")
    got = {r["n"]: [tuple(f) for f in r["m"]] for r in df.select("n", C.merge_flags(F.col("a"), F.col("b")).alias("m")).collect()}

    def topic(s):
        return next((t for t, p in C.TOPICS if re.search(p, s.lower())), None)

    for n, a, b in cases:
        out, covered = list(a), {topic(f[2]) for f in a} - {None}
        for f in b:
            if topic(f[2]) in covered:
                continue
            if any(
                g[0] == f[0] and (least := min(len(words_of(g[2])), len(words_of(f[2])))) and 2 * len(words_of(g[2]) & words_of(f[2])) >= least
                for g in out
            ):
                continue
            out.append(f)
        assert got[n] == out


def docx(parts):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{parts}</w:body></w:document>")
    return buf.getvalue()


def test_directory_scan(spark, tmp_path):
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    cell = "<w:tc>" + p + "</w:tc>"
    box = "<w:p><w:r><w:txbxContent>" + p.format("Boxed") + "</w:txbxContent></w:r></w:p>"
    row = "<w:tbl><w:tr>" + cell.format("A") + cell.format("A") + cell.format("B") + "</w:tr></w:tbl>"
    (tmp_path / "one.docx").write_bytes(docx(p.format("First") + row + box + p.format("Last")))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "two.txt").write_text("plain")
    (tmp_path / "skip.bin").write_bytes(b"x")
    got = {r["source_file"]: r for r in scan_directory(spark, str(tmp_path)).collect()}
    assert got["one.docx"]["text"] == "Boxed\nFirst\nA | B\nLast" and got["one.docx"]["table_count"] == 1
    assert got["bad.docx"]["text"] == "" and got["bad.docx"]["warnings"]
    assert got["two.txt"]["text"] == "plain" and len(got) == 3


def test_files_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, \"b\"\nc"), (2, None)], "id int, text string")
    write_csv(df.filter("id = 1").withColumn("text", F.regexp_replace("text", "\n", " ")), str(tmp_path / "c"))
    assert read_csv(spark, str(tmp_path / "c"), "id int, text string").first()["text"] == 'a, "b" c'
    write_json(df, str(tmp_path / "j"))
    assert sorted(r["id"] for r in read_records(spark, str(tmp_path / "j"), "id int, text string", multi_line=False).collect()) == [1, 2]
    (tmp_path / "list.json").write_text('[{"id": 7, "text": "x"}, {"id": 8}]')
    assert [r["id"] for r in read_records(spark, str(tmp_path / "list.json"), "id int, text string").collect()] == [7, 8]
    (tmp_path / "bad.json").write_text('{"id": 7}\n{"id": "seven"}\n')
    got = read_records(spark, str(tmp_path / "bad.json"), "id int, text string", multi_line=False).collect()
    assert [(r["id"], r["_corrupt"] is None) for r in got] == [(7, True), (None, False)]
    assert [r["id"] for r in cache_misses(df, df.filter("id = 1"), "text", "v1").collect()] == [2]
    assert cache_misses(df, df.filter("id = 1"), "text", "v1").columns == ["id", "text", "cache_key"]
