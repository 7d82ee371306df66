"""One consistent form for texts that look alike but differ in their characters.

A vocabulary trie, built from the words of the column that are plain already, is traversed with a weighted edit automaton
over the raw words of the others. Look-alike letters of other scripts, other widths, ligatures, accents written apart and
ignorable characters cost nothing; a letter foreign to the word's script that no table knows as a look-alike costs half;
any other edit costs one. Within the budget (a half: one unknown look-alike; misspellings stay as they are) the cheapest
spelling in the script of the word is taken, then the most frequent; one that costs something must also be the only one
at its cost and be used ``margin`` times or more. Words without such a spelling are normalised letter by letter with the
character tables, and so is what stands between words.

The vocabulary is sharded by length and by the look-alike classes of the first two or the last two letters of a word, a
looser key than the word itself, so that an unknown letter leaves one key intact; no task holds all of the vocabulary, and
only words that share a key with an odd word are kept.

Defined results: null and blank values give no row; values that are plain already give none; letter case, accents and
misspellings stay; repeated records count once; a text of only invisible characters has an empty plain form.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import cut

# Fixed values, of the Unicode confusables data (UTS 39): letters that look alike, as Latin, Cyrillic and Greek ("-" where the script has none).
LOOKALIKES = """
a а -   c с -   d ԁ -   e е -   h һ -   i і -   j ј -   o о ο   p р -   q ԛ -   s ѕ -   v ѵ ν   w ԝ -   x х -   y у -
A А Α   B В Β   C С -   E Е Ε   H Н Η   I І Ι   J Ј -   K К Κ   M М Μ   N - Ν   O О Ο   P Р Ρ   S Ѕ -   T Т Τ   X Х Χ
Y У Υ   Z - Ζ   Q Ԛ -   W Ԝ -
"""
# Fixed values, of the same data: look-alikes from elsewhere, with the Latin letter they stand for.
STRAYS = dict(
    zip("ɑ ɡ օ ս հ ո զ ց ꞵ ᴏ ᴠ ᴡ ᴢ ᴄ ꜱ ӏ Ӏ ա".split(), "a g o u h n q g b o v w z c s l I w".split())
)
HYPHENS = dict.fromkeys("‐‑‒–—―−﹣－⁃", "-")
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
EXPANDED = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>"}


def _tables() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Look-alike class of each letter (its first spelling), and for each script its letter of each class."""
    cells = LOOKALIKES.split()
    klass, to = {}, {s: {} for s in SCRIPTS}
    for i in range(0, len(cells), 3):
        group = cells[i : i + 3]
        for script, letter in zip(SCRIPTS, group):
            if letter != "-":
                klass[letter] = group[0]
                to[script][group[0]] = letter
    for stray, letter in STRAYS.items():
        if len(stray) == 1 and stray not in klass:
            klass[stray] = klass.get(letter, letter)
            klass.setdefault(letter, letter)
            to["LATIN"].setdefault(klass[stray], letter)
    return klass, to


CLASS, TO = _tables()


@lru_cache(maxsize=65536)
def script_of(ch: str) -> str:
    """Script of a letter by its name; look-alikes from elsewhere count as no script."""
    if ch in STRAYS:
        return "STRAY"
    name = unicodedata.name(unicodedata.normalize("NFD", ch)[0], "")
    return next((s for s in SCRIPTS if name.startswith(s)), "OTHER" if unicodedata.category(ch)[0] == "L" else "")


def ignorable(ch: str) -> bool:
    """Characters that show nothing: format characters, joiners, variation selectors, fillers, controls."""
    return (
        unicodedata.category(ch) in ("Cf", "Cc", "Cn") and ch not in "\t\n\r\x0b\x0c\x85"
        or ch in "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
        or "︀" <= ch <= "️"
        or "\U000e0100" <= ch <= "\U000e01ef"
    )


@lru_cache(maxsize=65536)
def _expand(ch: str) -> str:
    if ch in HYPHENS:
        return "-"
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in EXPANDED:
        out = "".join(chr(int(x, 16)) for x in rest.split())
        if not (out[0] == " " and len(out) > 1):
            return "".join(_expand(c) for c in out)
    return ch


def surface(text: str) -> str:
    """Normal width, composed accents, ordinary hyphens, single spaces, nothing invisible; scripts untouched."""
    text = "".join(_expand(c) for c in text if not ignorable(c))
    return " ".join(unicodedata.normalize("NFC", text).split())


def pieces(text: str) -> list[tuple[str, bool]]:
    """(text, whether it is a word) of every run of letters, with their marks and ignorables, and of every run between."""
    out: list[tuple[str, bool]] = []
    run, word = "", False
    for c in text:
        kind = unicodedata.category(c)[0]
        inside = kind == "L" or word and (kind == "M" or ignorable(c))
        if inside != word and run:
            out.append((run, word))
            run = ""
        run, word = run + c, inside
    return [*out, (run, word)] if run else out


def anchors(word: str) -> Counter:
    """Letters of a word, by script, that no other script has a look-alike of."""
    return Counter(s for c in unicodedata.normalize("NFD", word) if c not in CLASS and (s := script_of(c)) in SCRIPTS)


def context_script(text: str) -> str:
    """The script most of the text is written in."""
    count = anchors(text)
    return max(SCRIPTS, key=lambda s: count[s]) if count else "LATIN"


def suspicious(word: str, context: str) -> bool:
    """Whether a word mixes scripts, holds stray letters, or stands unanchored in a script foreign to its text."""
    scripts = [s for c in unicodedata.normalize("NFD", word) if (s := script_of(c))]
    found = set(scripts)
    if "OTHER" in found:  # a few letters of a further script among those of the three may be unknown look-alikes
        return 2 * scripts.count("OTHER") < len(scripts)
    return len(found) > 1 or "STRAY" in found or bool(found) and not anchors(word) and found != {context}


def skeleton(word: str) -> str:
    """The word with every letter replaced by its look-alike class: equal for words that look alike."""
    return "".join(CLASS.get(c, c) for c in unicodedata.normalize("NFD", surface(word)))


class Trie:
    """Vocabulary of plain words with their frequency."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node[""] = (word, node.get("", (word, 0))[1] + count)

    def spellings(self, word: str, budget: float = 0.0, other: float = 1.0, unknown: float = 0.5) -> list[tuple[float, int, str]]:
        """(cost, frequency, word) of vocabulary words reachable within the budget; look-alikes and ignorables are free.

        ``unknown`` is the cost of a letter of another script than most of the word that has no look-alike in the tables.
        """
        text = [c for raw in word for e in ("" if ignorable(raw) else _expand(raw)) for c in unicodedata.normalize("NFD", e)]
        own = word_script("".join(text), "LATIN")
        todo: list[tuple[dict, int, float]] = [(self.root, 0, 0.0)]
        best: dict[str, tuple[float, int]] = {}
        while todo:
            node, i, cost = todo.pop()
            if i == len(text):
                if "" in node:
                    w, n = node[""]
                    if w not in best or cost < best[w][0]:
                        best[w] = (cost, n)
            else:
                klass = CLASS.get(text[i], text[i])
                strange = klass == text[i] and script_of(text[i]) not in (own, "") and text[i] not in CLASS
                price = unknown if strange else other
                for c, child in node.items():
                    if c and CLASS.get(c, c) == klass:
                        todo.append((child, i + 1, cost))
                    elif c and cost + price <= budget:
                        todo.append((child, i + 1, cost + price))
                if cost + other <= budget:
                    todo.append((node, i + 1, cost + other))
            if cost + other <= budget:
                todo.extend((child, i, cost + other) for c, child in node.items() if c)
        return [(cost, n, w) for w, (cost, n) in best.items()]


def block_keys(word: str) -> list[str]:
    """The keys under which words that may be spellings of each other meet."""
    s = skeleton(word)
    return sorted({f"{len(s)}^{s[:2]}", f"{len(s)}{s[-2:]}$"})


def word_script(word: str, context: str) -> str:
    """The script a word is written in: of its anchored letters, else of its text."""
    count = anchors(word)
    return max(SCRIPTS, key=lambda s: (count[s], s == context)) if count else context


def by_table(word: str, script: str) -> str:
    """A word with every letter of another script replaced by its look-alike of ``script``."""
    out = []
    for c in unicodedata.normalize("NFD", word):
        k = CLASS.get(c)
        out.append(c if k is None or script_of(c) == script else TO[script].get(k, c))
    return unicodedata.normalize("NFC", "".join(out))


def choose(word: str, context: str, trie: Trie, budget: float = 0.5, margin: int = 2) -> tuple[float, int, str] | None:
    """(cost, frequency, spelling) of the canonical spelling of an odd word, if the vocabulary has one."""
    script = word_script(surface(word), context)
    found = [(cost, -n, w) for cost, n, w in trie.spellings(word, budget) if word_script(w, script) == script]
    if not found:
        return None
    cost, n, w = min(found)
    if cost > 0 and (-n < margin or sum(c == cost for c, _, _ in found) > 1):
        return None
    return cost, -n, unicodedata.normalize("NFC", w)


def plain_forms(
    records: DataFrame, id_col: str, fields: list[str], words_per_shard: int = 20_000, budget: float = 0.5, margin: int = 2
) -> DataFrame:
    """(id, field_name, plain) of every value of ``fields`` that differs from its plain form."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields])
    cells = (
        records.select(F.col(id_col).alias("_id"), F.explode(pairs).alias("_p"))
        .select("_id", F.col("_p.f").alias("_field"), F.col("_p.v").alias("_value"))
        .filter(F.col("_value").rlike(r"(?U)\S") & F.col("_id").isNotNull())
        .distinct()
    )

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for value, n in zip(pdf["_value"], pdf["_n"]):
                ctx = context_script(surface(value))
                odd, good = [], []
                for w, word in pieces(value):
                    if word:
                        flat = surface(w)
                        (odd if flat != w or suspicious(flat, ctx) else good).append(w)
                rows.append((value, ctx, odd, good, n))
            yield pd.DataFrame(rows, columns=["_value", "_ctx", "_odd", "_good", "_n"])

    values = cut(
        cells.groupBy("_value")
        .agg(F.count("*").alias("_n"))
        .mapInPandas(words_of, "_value string, _ctx string, _odd array<string>, _good array<string>, _n long")
    )
    odd = values.select("_ctx", F.explode("_odd").alias("_word")).distinct()
    good = values.select(F.explode("_good").alias("_word"), "_n").groupBy("_word").agg(F.sum("_n").alias("_n"))

    @F.pandas_udf("array<string>")
    def keys(words: pd.Series) -> pd.Series:
        return words.map(block_keys)

    odd = cut(odd.withColumn("_key", F.explode(keys("_word"))))
    good = good.withColumn("_key", F.explode(keys("_word"))).join(odd.select("_key").distinct(), "_key", "left_semi")
    shards = odd.count() // words_per_shard + 1
    shard = F.pmod(F.xxhash64("_key"), F.lit(shards))

    def spell(odd_words: pd.DataFrame, vocabulary: pd.DataFrame) -> pd.DataFrame:
        tries: dict[str, Trie] = {}
        for w, n, k in zip(vocabulary["_word"], vocabulary["_n"], vocabulary["_key"]):
            tries.setdefault(k, Trie()).add(w, int(n))
        rows = []
        for w, c, k in zip(odd_words["_word"], odd_words["_ctx"], odd_words["_key"]):
            if k in tries and (found := choose(w, c, tries[k], budget, margin)):
                rows.append((w, c, *found))
        return pd.DataFrame(rows, columns=["_word", "_ctx", "_cost", "_freq", "_to"])

    spelt = (
        odd.withColumn("_shard", shard)
        .groupBy("_shard")
        .cogroup(good.withColumn("_shard", shard).groupBy("_shard"))
        .applyInPandas(spell, "_word string, _ctx string, _cost double, _freq long, _to string")
        .groupBy("_word", "_ctx")
        .agg(F.min_by("_to", F.struct("_cost", -F.col("_freq"), "_to")).alias("_to"))
    )

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value, ctx, to in zip(pdf["_value"], pdf["_ctx"], pdf["_map"]):
                known = {x["_word"]: x["_to"] for x in to if x["_to"] is not None}
                text = []
                for w, word in pieces(value):
                    flat = surface(w) if word else w
                    if word and w in known:
                        flat = known[w]
                    elif word and suspicious(flat, ctx):
                        flat = by_table(flat, word_script(flat, ctx))
                    text.append(flat)
                out.append(surface("".join(text)))
            yield pd.DataFrame({"_value": pdf["_value"], "_plain": out})

    mapped = (
        values.select("_value", "_ctx", F.explode_outer(F.array_distinct("_odd")).alias("_word"))
        .join(spelt, ["_word", "_ctx"], "left")
        .groupBy("_value", "_ctx")
        .agg(F.collect_list(F.struct("_word", "_to")).alias("_map"))
        .mapInPandas(rewrite, "_value string, _plain string")
    )
    changed = mapped.filter("_plain <> _value")
    return cells.join(changed, "_value").select(
        F.col("_id").alias(id_col), F.col("_field").alias("field_name"), F.col("_plain").alias("plain")
    )
