"""Split fields that hold several values in one string into one row per value.

Delimiters differ from record to record, some values contain delimiters themselves, and some are quoted. Each string
is lexed into chunks; quoted and bracketed spans are atomic. A chunk that holds only *possible* delimiters (comma,
slash, ampersand, plus, "and") is a lattice of segmentations. Value frequencies and the rate at which each class of
possible delimiter really separates are learned from the whole column by expectation-maximisation (forward-backward
over the lattices); Viterbi then picks the likeliest split of every chunk. New values get the mass that Good-Turing gives
them (values seen once), spelt out letter by letter; a "value" that is seen only beside possible delimiters and never
standing alone (a department behind a comma, say) is doubted the more, the more often that happens.

Defined results: null, empty and blank strings give no row; empty places take no position; repeated values stay;
an unclosed quotation mark is an ordinary character; records delivered twice with the same content count once.
In a chunk of ``wide`` possible delimiters or fewer every stretch may be a value; in longer ones a value holds at most
``wide`` of them or as many as the longest value of the column that stands alone, or is the whole chunk, which keeps a
lattice linear in the length of its text. The rounds of expectation-maximisation end when the likelihood of the column
grows by less than ``settled`` of itself. Uses expected less than once in a million chunks are no uses: otherwise every
stretch never seen as a value would slowly gain on the values it is made of.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.session import cut, spread

HARD = set(";|\n\r\t·•‣；｜")
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»"}
#: A list mark at the start of an item: (1) 1) 1. - * and bullets, each followed by white space.
MARK = re.compile(r"(?:\(\d{1,3}\)|\d{1,3}[.)]|[-*•‣–])(?=\s)\s*")
INLINE_MARK = re.compile(r"\s\(\d{1,3}\)\s+")
SOFT = re.compile(r"(?:\s*,\s*(?:and|&)\s+|\s*[,/]\s*|\s+(?:and|&|\+)\s+)+", re.IGNORECASE)
EDGE = re.compile(r"^[\s,/]+|[\s,/]+$")
KIND = re.compile(r"\s*\(([^()]*)\)\s*$")
CHAR_COST = math.log(27)


def _quoted(text: str, at: int) -> tuple[str, int] | None:
    """The unquoted value and the end of a span quoted from ``at``, if the closing mark ends the item."""
    close, j = QUOTES[text[at]], at + 1
    while (j := text.find(close, j)) >= 0:
        if text[j + 1 : j + 2] == close:
            j += 2
            continue
        rest = text[j + 1 :]
        after = rest.lstrip("  ")
        if not after or after[0] in HARD or after[0] == "]" or SOFT.match(rest) or INLINE_MARK.match(rest):
            return text[at + 1 : j].replace(close * 2, close).strip(), j + 1
        j += 1
    return None


def lex(text: str | None) -> list[tuple[str, bool]]:
    """Chunks of one string as (text, open): open chunks may still be split at possible delimiters."""
    if not text or not text.strip():
        return []
    text = text.strip()
    if text[0] == "[" and text[-1] == "]":
        text = text[1:-1]
    out: list[tuple[str, bool]] = []
    n, i, start, depth, fresh = len(text), 0, 0, 0, True

    def close(end: int) -> None:
        if chunk := EDGE.sub("", text[start:end]):
            out.append((chunk, SOFT.search(chunk) is not None))

    numbered = re.match(r"\s*\(\d{1,3}\)\s", text) is not None
    line_start = True
    while i < n:
        if fresh:
            while i < n and text[i].isspace() and text[i] not in HARD:
                i += 1
            if i >= n:
                break
            if line_start and (m := MARK.match(text, i)):
                i = m.end()
            start, fresh, line_start = i, False, False
            if i < n and text[i] in QUOTES and (q := _quoted(text, i)):
                if q[0]:
                    out.append((q[0], False))
                i = start = q[1]
                m = SOFT.match(text, i)
                if m and m.end() < n + 1 and m.end() > i:
                    i = m.end()
                    start, fresh = i, True
                continue
            continue
        ch = text[i]
        if ch in "()":
            if numbered and depth == 0 and ch == "(" and i and (m := INLINE_MARK.match(text, i - 1)):
                close(i)
                i = m.end()
                start, fresh = i, True
                continue
            depth = depth + 1 if ch == "(" else max(0, depth - 1)
        elif ch in HARD:
            close(i)
            depth, fresh, line_start = 0, True, True
            start = i + 1
        elif depth == 0 and (m := SOFT.match(text, i)) and m.end() > i:
            j = m.end()
            if j < n and text[j] in QUOTES and _quoted(text, j):  # a quoted value follows: a sure separator
                close(i)
                start, fresh = j, True
                i = j
                continue
            i = j
            continue
        i += 1
    if not fresh:
        close(n)
    return out


def atoms(chunk: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of the atoms of an open chunk and the class of the possible delimiter after each but the last."""
    spans, classes, depth, last, i = [], [], 0, 0, 0
    while i < len(chunk):
        ch = chunk[i]
        if ch in "()":
            depth = max(0, depth + (1 if ch == "(" else -1))
        elif depth == 0 and i > last and (m := SOFT.match(chunk, i)) and m.end() < len(chunk):
            mark = m.group()
            kind = re.sub(r"\s+", "", mark).lower()
            space = ("b" if mark[0].isspace() else "") + ("a" if mark[-1].isspace() else "")
            spans.append((last, i))
            classes.append(f"{kind}_{space}_{')' if chunk[i - 1] == ')' else ''}")
            last = i = m.end()
            continue
        i += 1
    return [*spans, (last, len(chunk))], classes


def value_key(item: str) -> str:
    """The form under which equal values are counted: letter case, underscores and bracketed kinds don't matter."""
    m = KIND.search(item)
    if m and m.start() and (re.search(r"[a-z ,-]", m.group(1)) or len(m.group(1)) > 5):
        item = item[: m.start()]
    return re.sub(r"[\s_]+", " ", item).strip().lower()


class Model(NamedTuple):
    """What is learned of one field: uses in all, mass of new values, log doubt per unsure use, rate per delimiter class."""

    total: float
    new: float
    doubt: float
    rates: dict[str, float]


def _ends(i: int, k: int, max_inner: int) -> list[int]:
    """Last atoms of the values that may begin with atom ``i`` of ``k``: those within reach, and the last for the first."""
    near = list(range(i, min(k, i + max_inner + 1)))
    return [*near, k - 1] if i == 0 and near[-1] < k - 1 else near


def _lattice(chunk: str, scores: dict[str, tuple[float, float, float]], model: Model, hard: bool, max_inner: int):
    spans, classes = atoms(chunk)
    k = len(spans)
    flag = "h" if hard else "s"
    split = [min(max(model.rates.get(f"{c}_{flag}", 0.5), 1e-6), 1 - 1e-6) for c in classes]
    log_split, log_keep = [math.log(r) for r in split], [math.log(1 - r) for r in split]
    gaps = [CHAR_COST * (spans[x + 1][0] - spans[x][1]) for x in range(k - 1)]
    edges = []
    for i in range(k):
        inner = 0.0
        for j in _ends(i, k, max_inner):
            if j > i:
                inner = sum(log_keep[i:j]) if j == k - 1 > i + max_inner else inner + log_keep[j - 1]
            text = chunk[spans[i][0] : spans[j][1]]
            key = value_key(text)
            base = math.log(model.new) - CHAR_COST * len(key)
            count, sure, seen = scores.get(key, (0.0, 0.0, 0.0))
            mass = base
            if count > 0:
                top = max(base, math.log(count))
                mass = top + math.log(math.exp(base - top) + math.exp(math.log(count) - top))
            if sure == 0 and j - i < k - 1:
                mass += model.doubt * max(0.0, seen - 1)
            s = mass - math.log(model.total + model.new) + inner - CHAR_COST * (len(text) - len(key))
            if j < k - 1:
                s += log_split[j] - gaps[j]
            edges.append((i, j, key, s))
    return k, classes, edges


def expected(chunk: str, scores: dict, model: Model, hard: bool, max_inner: int):
    """Expected uses of each value, log likelihood, and expected uses of each delimiter class of one chunk (forward-backward)."""
    k, classes, edges = _lattice(chunk, scores, model, hard, max_inner)
    fwd, bwd = [-math.inf] * (k + 1), [-math.inf] * (k + 1)
    fwd[0] = bwd[k] = 0.0

    def add(a: float, b: float) -> float:
        if a == -math.inf:
            return b
        m = max(a, b)
        return m + math.log(math.exp(a - m) + math.exp(b - m))

    for i, j, _, s in edges:
        fwd[j + 1] = add(fwd[j + 1], fwd[i] + s)
    for i, j, _, s in reversed(edges):
        bwd[i] = add(bwd[i], bwd[j + 1] + s)
    values: dict[str, float] = {}
    cuts = [0.0] * (k - 1)
    for i, j, key, s in edges:
        p = math.exp(fwd[i] + s + bwd[j + 1] - fwd[k])
        if p > 1e-6:
            values[key] = values.get(key, 0.0) + p
            if j < k - 1:
                cuts[j] += p
    return values, fwd[k], [(f"{c}_{'h' if hard else 's'}", x) for c, x in zip(classes, cuts)]


def viterbi(chunk: str, scores: dict, model: Model, hard: bool, max_inner: int) -> list[str]:
    """The items of the likeliest split of one chunk."""
    k, _, edges = _lattice(chunk, scores, model, hard, max_inner)
    best, back = [-math.inf] * (k + 1), [0] * (k + 1)
    best[0] = 0.0
    for i, j, _, s in edges:
        if best[i] + s > best[j + 1]:
            best[j + 1], back[j + 1] = best[i] + s, i
    spans, _ = atoms(chunk)
    out, at = [], k
    while at:
        out.append(chunk[spans[back[at]][0] : spans[at - 1][1]].strip())
        at = back[at]
    return out[::-1]


CHUNKS = "array<struct<text:string,open:boolean>>"


def _lex_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        chunks = [lex(t) for t in pdf["_text"]]
        yield pd.DataFrame(
            {
                "_id": pdf["_id"],
                "_field": pdf["_field"],
                "_chunks": [[{"text": t, "open": o} for t, o in c] for c in chunks],
                "_hard": [len(c) > 1 for c in chunks],
                "_any": [any(o for _, o in c) for c in chunks],
            }
        )


def _score_frame(spans: DataFrame, freq: DataFrame) -> DataFrame:
    """Every open chunk with the frequencies of its possible values."""
    return (
        spread(spans.join(freq, ["_field", "_key"], "left"), "_field", "_chunk", "_hard")
        .groupBy("_field", "_chunk", "_hard")
        .agg(
            F.first("_n").alias("_n"),
            F.collect_list(F.when(F.col("_freq").isNotNull(), F.struct("_key", "_freq", "_sure", "_seen"))).alias("_known"),
        )
    )


def split_packed(
    records: DataFrame,
    id_col: str,
    fields: list[str],
    wide: int = 32,
    settled: float = 1e-2,
    most_rounds: int = 20,
) -> DataFrame:
    """(id, field_name, item_pos, item) for every value of ``fields``; see the module docstring.

    Rows with the same id, field and text count once. Every stage is a keyed shuffle over distinct texts, so repeated
    texts and hot values collapse before they are moved; only the delimiter rates (a few dozen) and the number of
    values per field reach the driver.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields])
    cells = (
        records.select(F.col(id_col).alias("_id"), F.explode(pairs).alias("_p"))
        .select("_id", F.col("_p.f").alias("_field"), F.col("_p.t").alias("_text"))
        .filter(F.col("_text").rlike(r"\S") & F.col("_id").isNotNull())
    )
    cells = spread(cells, "_id", "_field", "_text").dropDuplicates(["_id", "_field", "_text"])
    schema = f"_id string, _field string, _chunks {CHUNKS}, _hard boolean, _any boolean"
    lexed = cut(cells.select(F.col("_id").cast("string"), "_field", "_text").mapInPandas(_lex_batches, schema))

    pieces = lexed.select("_field", "_hard", F.explode("_chunks").alias("_c"))
    distinct = pieces.groupBy("_field", "_hard", F.col("_c.text").alias("_chunk"), F.col("_c.open").alias("_open")).agg(
        F.count("*").alias("_n")
    )

    alone = distinct.filter("not _open").select((F.size(F.regexp_extract_all("_chunk", F.lit(r"([,/&+]|\band\b)"), F.lit(1)))).alias("n"))
    max_inner = max(wide, alone.agg(F.max("n")).first()[0] or 0)

    def spans_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, h, c, n, o in zip(pdf["_field"], pdf["_hard"], pdf["_chunk"], pdf["_n"], pdf["_open"]):
                if not o:
                    rows.append((f, h, None, float(n), value_key(c), True))
                    continue
                spans, _ = atoms(c)
                if len(spans) == 1:
                    rows.append((f, h, None, float(n), value_key(c), True))
                    continue
                last = len(spans) - 1
                keys = {
                    (value_key(c[spans[i][0] : spans[j][1]]), j - i == last)
                    for i in range(last + 1)
                    for j in _ends(i, last + 1, max_inner)
                }
                rows.extend((f, h, c, float(n), k, w) for k, w in keys)
            yield pd.DataFrame(rows, columns=["_field", "_hard", "_chunk", "_n", "_key", "_whole"])

    keyed = cut(
        spread(distinct, "_chunk").mapInPandas(
            spans_of, "_field string, _hard boolean, _chunk string, _n double, _key string, _whole boolean"
        )
    )
    sure = keyed.filter("_chunk is null").groupBy("_field", "_key").agg(F.sum("_n").alias("_sure"))
    spans = keyed.filter("_chunk is not null")

    def known_of(known) -> dict[str, tuple[float, float, float]]:
        return {x["_key"]: (x["_freq"], x["_sure"], x["_seen"]) for x in known}

    none = Model(1.0, 1.0, 0.0, {})
    # Uses of a key as a part of some chunk: what counts against a key that never stands alone.
    part = spans.filter("not _whole").groupBy("_field", "_key").agg(F.sum("_n").alias("_seen"))
    none_yet = F.lit(0.0)
    counts = sure.select("_field", "_key", "_sure", F.col("_sure").alias("_freq"), none_yet.alias("_seen")).unionByName(
        part.select("_field", "_key", none_yet.alias("_sure"), none_yet.alias("_freq"), "_seen")
    )
    total = [F.sum(c).alias(c) for c in ("_freq", "_sure", "_seen")]
    freq = cut(counts.groupBy("_field", "_key").agg(*total))
    start = freq
    base = {
        r["_field"]: (r["s"], r["once"])
        for r in start.groupBy("_field").agg(F.sum("_sure").alias("s"), F.count_if(F.col("_sure") == 1).alias("once")).collect()
    }

    def learned(unsure: dict[str, float], rates: dict[str, dict[str, float]]) -> dict[str, Model]:
        """Models of the fields, from the uses that had to be guessed and the rates of the delimiter classes."""
        return {
            f: Model(s + (n := unsure.get(f, 0.0)), max(1.0, once), math.log(max(1 - s / (s + n + 1), 1e-3)), rates.get(f, {}))
            for f, (s, once) in base.items()
        }

    models = learned({}, {})
    before = None
    for _ in range(most_rounds):

        def e_step(batches: Iterator[pd.DataFrame], models=models) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for f, c, h, n, known in zip(pdf["_field"], pdf["_chunk"], pdf["_hard"], pdf["_n"], pdf["_known"]):
                    values, fit, cuts = expected(c, known_of(known), models.get(f, none), h, max_inner)
                    rows.append((f, "l", "", n * fit, 0.0))
                    rows.extend((f, "v", k, n * p, 0.0) for k, p in values.items())
                    rows.extend((f, "d", k, n * p, n) for k, p in cuts)
                out = pd.DataFrame(rows, columns=["_field", "_sort", "_key", "_freq", "_of"])
                yield out.groupby(["_field", "_sort", "_key"], as_index=False).sum() if len(out) else out

        soft = cut(
            _score_frame(spans, freq)
            .mapInPandas(e_step, "_field string, _sort string, _key string, _freq double, _of double")
            .groupBy("_field", "_sort", "_key")
            .agg(F.sum("_freq").alias("_freq"), F.sum("_of").alias("_of"))
        )
        rates: dict[str, dict[str, float]] = {f: {} for f in fields}
        unsure: dict[str, float] = {}
        fit = 0.0
        mark = F.when(F.col("_sort") == "d", F.col("_key")).alias("k")
        for r in soft.groupBy("_field", "_sort", mark).agg(F.sum("_freq").alias("n"), F.sum("_of").alias("of")).collect():
            if r["_sort"] == "l":
                fit += r["n"]
            elif r["k"] is None:
                unsure[r["_field"]] = r["n"]
            else:
                rates[r["_field"]][r["k"]] = (r["n"] + 0.05) / (r["of"] + 0.1)
        models = learned(unsure, rates)
        found = soft.filter("_sort = 'v'").select(
            "_field", "_key", "_freq", none_yet.alias("_sure"), none_yet.alias("_seen")
        )
        freq = start.unionByName(found).groupBy("_field", "_key").agg(*total)
        if before is not None and fit - before < settled * abs(fit):
            break
        before = fit

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = [
                viterbi(c, known_of(known), models.get(f, none), h, max_inner)
                for f, c, h, known in zip(pdf["_field"], pdf["_chunk"], pdf["_hard"], pdf["_known"])
            ]
            yield pd.DataFrame({"_field": pdf["_field"], "_chunk": pdf["_chunk"], "_hard": pdf["_hard"], "_items": items})

    splits = _score_frame(spans, freq).mapInPandas(
        decide, "_field string, _chunk string, _hard boolean, _items array<string>"
    )
    whole = lexed.filter(~F.col("_any")).select("_id", "_field", F.transform("_chunks", lambda c: c["text"]).alias("_items"))
    parts = (
        lexed.filter("_any")
        .withColumn("_row", F.xxhash64("_chunks"))  # one id may hold several texts of a field
        .select("_id", "_field", "_row", "_hard", F.posexplode("_chunks").alias("_at", "_c"))
        .withColumn("_chunk", F.col("_c.text"))
        .join(splits, ["_field", "_chunk", "_hard"], "left")
        .groupBy("_id", "_field", "_row")
        .agg(F.collect_list(F.struct("_at", F.coalesce("_items", F.array("_chunk")).alias("items"))).alias("_all"))
        .select("_id", "_field", F.flatten(F.transform(F.array_sort("_all"), lambda x: x["items"])).alias("_items"))
    )
    return (
        whole.unionByName(parts)
        .select("_id", "_field", F.posexplode(F.filter("_items", _filled)).alias("item_pos", "item"))
        .select(F.col("_id").alias(id_col), F.col("_field").alias("field_name"), "item_pos", "item")
    )


def _filled(item: Column) -> Column:
    return F.length(F.trim(item)) > 0
