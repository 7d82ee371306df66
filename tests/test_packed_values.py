import itertools
import math
import random

import pytest

from rosterlake.operators.packed_values import Model, _lattice, atoms, lex, split_packed, viterbi


def chunks(text):
    return [c for c, _ in lex(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a; b;c", ["a", "b", "c"]),
        ("1. alpha\n2. beta", ["alpha", "beta"]),
        ("(1) alpha one (2) beta", ["alpha one", "beta"]),
        ("- alpha\n- beta", ["alpha", "beta"]),
        ('["alpha", "beta, gamma"]', ["alpha", "beta, gamma"]),
        ('"the ""street"" view"; b', ['the "street" view', "b"]),
        ("'alpha; beta'; b", ["alpha; beta", "b"]),
        ("analysts' revisions; b", ["analysts' revisions", "b"]),
        ("Bank One (full-time, intern) | Bank Two", ["Bank One (full-time, intern)", "Bank Two"]),
        ("a;; ;b;", ["a", "b"]),
        ("  ", []),
        (None, []),
        ('"never closed; b', ['"never closed', "b"]),
        ("30+ names; C++ work", ["30+ names", "C++ work"]),
    ],
)
def test_lex(text, want):
    assert chunks(text) == want


def test_viterbi_is_the_best_of_all_splits():
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "dd ee", "ff"]
    for _ in range(60):
        chunk = ", ".join(rng.choice(words) for _ in range(rng.randint(2, 5)))
        scores = {w: (rng.random() * 9 + 0.1, rng.choice([0.0, 3.0]), rng.randint(0, 4)) for w in words}
        scores["aa, bb"] = (4.0, 4.0, 1.0)
        model = Model(30.0, 2.0, -1.0, {", ".strip() + "_a__s": 0.6})
        k, _, edges = _lattice(chunk, scores, model, False, 8)
        score = {(i, j): s for i, j, _, s in edges}
        best = max(
            (
                sum(score[a, b - 1] for a, b in zip((0, *cut), (*cut, k)))
                for n in range(k)
                for cut in itertools.combinations(range(1, k), n)
            ),
            default=-math.inf,
        )
        items = viterbi(chunk, scores, model, False, 8)
        spans, _ = atoms(chunk)
        at, total = 0, 0.0
        for item in items:
            end = next(e for e in range(at, k) if chunk[spans[at][0] : spans[e][1]] == item)
            total += score[at, end]
            at = end + 1
        assert at == k and total == pytest.approx(best)


def test_learned_split(spark):
    sure = ["red", "green", "blue", "salt, oil and wine"] * 6
    rows = [(f"s{i}", f'"{v}"') for i, v in enumerate(sure)]
    rows += [(f"h{i}", f"{a}; {b}") for i, (a, b) in enumerate(itertools.product(sure[:3], repeat=2))]
    rows += [("x1", "red, green"), ("x2", "blue and red"), ("x3", "salt, oil and wine"), ("x4", "green, salt, oil and wine")]
    df = spark.createDataFrame(rows, "id string, colours string")
    got = {(r["id"], r["item_pos"]): r["item"] for r in split_packed(df, "id", ["colours"]).collect()}
    assert got["x1", 0] == "red" and got["x1", 1] == "green"
    assert got["x2", 0] == "blue" and got["x2", 1] == "red"
    assert got["x3", 0] == "salt, oil and wine"
    assert [got["x4", i] for i in range(2)] == ["green", "salt, oil and wine"]


def test_edge_cases(spark):
    long = "; ".join(f"value {i}" for i in range(3000))
    rows = [("a", None, 1), ("a", "", 1), ("b", " ; ", 1), ("c", "x; x", 1), ("c", "x; x", 1), (None, "y", 1), ("d", long, 1)]
    df = spark.createDataFrame(rows, "id string, v string, item int")
    got = split_packed(df, "id", ["v"]).collect()
    assert sorted((r["item_pos"], r["item"]) for r in got if r["id"] == "c") == [(0, "x"), (1, "x")]
    assert sum(r["id"] == "d" for r in got) == 3000
    assert {r["id"] for r in got} == {"c", "d"}
    assert split_packed(df.limit(0), "id", ["v"]).count() == 0
