from rosterlake.operators.layout import detect_columns, group_lines, render_columns


def page(name, right):
    rows = [(name, 20.0 + 30 * i, 12.0 * r + 0.4 * i, f"l{r}{i}") for r in range(8) for i in range(4)]
    return rows + ([(name, 330.0 + 30 * i, 12.0 * r, f"r{r}{i}") for r in range(8) for i in range(4)] if right else [])


def test_columns(spark):
    wide = [("wide", 20.0 + 40 * i, 12.0 * r, "w") for r in range(6) for i in range(13)]
    words = spark.createDataFrame(page("two", True) + page("one", False) + wide, "page string, x0 double, top double, text string")
    assert [(r["page"], r["split"]) for r in detect_columns(words, ["page"], 600.0).filter("page <> 'wide'").collect()] == [("two", 327.0)]
    text = {(r["page"], r["column"]): r["text"] for r in render_columns(words, ["page"], 300.0).collect()}
    assert text["two", 0].split("\n")[0] == "l00 l01 l02 l03" and text["two", 1].split("\n")[7] == "r70 r71 r72 r73"
    assert ("one", 1) not in text
    lines = {(r["page"], r["line"]): r["text"] for r in group_lines(words, ["page"]).collect()}
    assert lines["two", 0] == "l00 l01 l02 l03 r00 r01 r02 r03"
    assert detect_columns(words.limit(0), ["page"], 600.0).count() == 0
