"""Reading level of documents by smoothed unigram language models, one per level.

Each level's model is trained on graded texts: word frequencies interpolated with those of all levels, so a word that a
level never uses keeps a share of its general frequency. Texts hold some sentences of other levels, so a text's
likelihood under a level lets each sentence come from any level's model, as often as graded texts of that level show.
A document gets the level with the highest posterior likelihood. Words no graded text uses (names, headings, foreign words) and pieces without letters
(tables of figures, list marks, rules) say nothing about the level and are left out.

The models are fitted on at most ``max_samples`` graded texts a level (the lowest ids), so their size is bounded and
they are shipped with the scoring function; scoring reads every document whole in one pass without a shuffle.

Defined results: null, empty and short texts (fewer than ``min_words`` pieces between white space) give no row; a text
without any known word, and an exact tie, get the lowest level concerned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import widen

BREAK = re.compile(r"[.!?;:]+\s+|\n\s*(?:[-*•–]|\d{1,3}[.)])\s+|\n\s*\n")
WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")


def words_of(text: str | None) -> list[str]:
    """Lower-case words of the running text; lines hyphenated or wrapped by hand read on."""
    return WORD.findall((text or "").lower())


def sentences(text: str | None) -> list[Counter]:
    """Word counts of each sentence or list item that has words."""
    return [c for part in BREAK.split(text or "") if (c := Counter(words_of(part)))]


class Models(NamedTuple):
    """Word log likelihoods per level, and how the sentences of a text of one level spread over the levels (log)."""

    levels: list[int]
    words: dict[str, list[float]]
    spread: list[list[float]]

    def of(self, sentence: Counter) -> list[float]:
        """Log likelihood of a sentence under each level's model."""
        score = [0.0] * len(self.levels)
        for w, n in sentence.items():
            if (logs := self.words.get(w)) is not None:
                score = [x + n * y for x, y in zip(score, logs)]
        return score

    def posterior(self, text: str | None) -> list[float]:
        """Log posterior of each level for a text, up to a constant; levels are equally likely beforehand."""
        total = [0.0] * len(self.levels)
        for s in sentences(text):
            own = self.of(s)
            if not any(own):
                continue
            for i, row in enumerate(self.spread):
                both = [x + y for x, y in zip(row, own)]
                top = max(both)
                total[i] += top + math.log(sum(math.exp(x - top) for x in both))
        return total

    def level(self, text: str | None) -> int:
        score = self.posterior(text)
        return self.levels[max(range(len(score)), key=lambda i: (score[i], -i))]


def train(samples: list[tuple[int, str]], weight: float = 0.9, rounds: int = 3) -> Models:
    """Models from (level, text) pairs.

    A graded text also holds sentences of other levels. The first models take every sentence at the level of its text;
    each round then shares sentences out by their posterior and re-estimates the models and the spread.
    ``weight`` is the share of a level's own frequencies against those of all levels.
    """
    levels = sorted({int(level) for level, _ in samples})
    texts = [(levels.index(int(level)), sentences(text)) for level, text in samples]
    k = len(levels)
    share = [[[float(i == j) for j in range(k)] for _ in body] for i, body in texts]
    models = Models(levels, {}, [])
    for _ in range(rounds + 1):
        counts: list[Counter] = [Counter() for _ in levels]
        spread = [[0.5 + (i == j) for j in range(k)] for i in range(k)]
        for (i, body), own in zip(texts, share):
            for sentence, post in zip(body, own):
                for j, p in enumerate(post):
                    spread[i][j] += p
                    if p > 1e-9:
                        for w, n in sentence.items():
                            counts[j][w] += n * p
        general: Counter = sum(counts, Counter())
        size, total = [max(1.0, sum(c.values())) for c in counts], max(1.0, sum(general.values()))
        words = {
            w: [math.log(weight * c[w] / z + (1 - weight) * n / total) for c, z in zip(counts, size)]
            for w, n in general.items()
        }
        models = Models(levels, words, [[math.log(x / sum(row)) for x in row] for row in spread])
        for (i, body), own in zip(texts, share):
            for m, sentence in enumerate(body):
                both = [x + y for x, y in zip(models.spread[i], models.of(sentence))]
                top = max(both)
                z = sum(math.exp(x - top) for x in both)
                own[m] = [math.exp(x - top) / z for x in both]
    return models


def reading_levels(
    documents: DataFrame,
    samples: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 60,
    max_samples: int = 5000,
    weight: float = 0.9,
) -> DataFrame:
    """(id, reading_level) of every document of at least ``min_words`` words."""
    rank = F.row_number().over(Window.partitionBy("reading_level").orderBy("sample_id"))
    rows = (
        samples.filter("reading_level is not null and text is not null")
        .select("sample_id", "reading_level", "text")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= max_samples)
        .select("reading_level", "text")
        .collect()
    )
    models = train([(r["reading_level"], r["text"]) for r in rows], weight)
    if not models.levels:
        return documents.select(F.col(id_col), F.lit(None).cast("int").alias("reading_level")).limit(0)

    @F.pandas_udf("int")
    def level(texts: pd.Series) -> pd.Series:
        return texts.map(models.level).astype("int32")

    text = F.col(text_col)
    pieces = F.size(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "))
    long = documents.select(id_col, text_col).filter(text.isNotNull() & (pieces >= min_words))
    return widen(long).select(F.col(id_col), level(text).alias("reading_level"))

