import pytest

from rosterlake.llm.lookalikes import Trie, block_keys, by_table, choose, pieces, plain_forms, skeleton, surface


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ａｎｎａ　Ｂ．", "Anna B."), ("A​nna  X⁠", "Anna X"), ("Renée", "Renée"), ("Weiﬆ", "Weist"), ("a‐b‑c", "a-b-c"),
        ("ｶﾅ", "カナ"), ("  a  b ", "a b"), ("한", "한"), ("", ""), ("​", ""),
    ],
)
def test_surface(text, want):
    assert surface(text) == want


def test_by_table_and_skeleton():
    assert by_table("Hugо", "LATIN") == "Hugo"
    assert by_table("Mирoн", "CYRILLIC") == "Мирон"
    assert by_table("Ζ̌ilkoνa", "LATIN") == "Žilkova"
    assert skeleton("Hugо") == skeleton("Hugo") != skeleton("Hugi")


def test_trie_budget():
    t = Trie()
    for w in ("hugo", "huga", "anna"):
        t.add(w, 1)
    assert [w for _, _, w in t.spellings("hugо​")] == ["hugo"]
    assert {w for _, _, w in t.spellings("hugo", budget=1.0)} == {"hugo", "huga"}
    assert t.spellings("hugx") == []


def test_raw_words_through_the_automaton():
    t = Trie()
    for w, n in (("Hugo", 9), ("Hugh", 4), ("Renée", 5), ("Weist", 3)):
        t.add(w, n)
    for raw, want in {"H\u200bugо": "Hugo", "Ｈｕｇｈ": "Hugh", "Rene\u0301e": "Renée", "Weiﬆ": "Weist", "Hugу": None, "Hugi": None}.items():
        got = choose(raw, "LATIN", t)
        assert (got and got[2]) == want and (not got or got[0] == 0), raw
    # a look-alike that no table has costs a half and is decided by the vocabulary; the table alone would leave it
    got = choose("HuᏀo", "LATIN", t)
    assert got == (0.5, 9, "Hugo") and by_table("HuᏀo", "LATIN") == "HuᏀo"
    assert choose("HugᏀ", "LATIN", t) is None  # Hugo and Hugh are as near as each other


def test_keys_are_looser_than_words():
    assert set(block_keys("HuᏀoline")) & set(block_keys("Hugoline"))
    assert [w for w, word in pieces("Нu\u200bgo  O'Neil-7x") if word] == ["Нu\u200bgo", "O", "Neil", "x"]


def test_plain_forms(spark):
    rows = [
        ("a", "Hugo Maren", 1), ("b", "Нugо Maren", 1), ("b", "Нugо Maren", 1), ("c", "Мирон Скала", 1), ("d", "Mирoн Скала", 1), ("e", "Jonas Н. Weber", 1),
        ("k", "HuᏀo Maren", 1), ("m", "Hugo Skala", 1), ("l", "王Ab 书", 1), ("f", None, 1), ("g", " ", 1), ("h", "Anna  Weber ", 1), ("i", "王书宁", 1), (None, "Ａ", 1), ("j", "Ｘ" * 3000, 1),
    ]
    df = spark.createDataFrame(rows, "candidate_id string, name string, plain int")
    got = {r["candidate_id"]: r["plain"] for r in plain_forms(df, "candidate_id", ["name"]).collect()}
    assert got == {"k": "Hugo Maren", "b": "Hugo Maren", "d": "Мирон Скала", "e": "Jonas H. Weber", "h": "Anna Weber", "j": "X" * 3000}
    assert plain_forms(df.limit(0), "candidate_id", ["name"]).count() == 0
