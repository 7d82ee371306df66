"""Dictionary joins and entity resolution: tiered resolvers, lineage, longest-term lookups, canonical spellings."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.text import fold_name
from rosterlake.session import cut, spread


def name_index(firms: DataFrame) -> DataFrame:
    """(key, canonical, is_alias): one entry per folded name: of the last canonical name that has it, else of the first alias.

    The order of the list is its column ``ord``, where it has one, else that of the canonical names.
    """
    place = F.col("ord").cast("long") if "ord" in firms.columns else F.lit(0).cast("long")
    named = firms.select("canonical", F.col("canonical").alias("name"), F.lit(False).alias("is_alias"), (-place).alias("at")).unionByName(
        firms.select("canonical", F.explode("aliases").alias("name"), F.lit(True).alias("is_alias"), place.alias("at"))
    )
    keyed = named.withColumn("key", fold_name(F.col("name"))).filter("key <> ''")
    best = Window.partitionBy("key").orderBy("is_alias", "at", "canonical")
    return keyed.withColumn("r", F.row_number().over(best)).filter("r = 1").select("key", "canonical", "is_alias")


def resolve_names(names: DataFrame, firms: DataFrame, raw: str = "firm") -> DataFrame:
    """(raw, canonical, resolution) of distinct names by the first tier that answers.

    Tiers: exact (the canonical name, or its folded form), alias, division (the text before the first comma, of more
    than three characters, resolves), ambiguous (its words are a proper part of names of several firms), unresolved.
    Each tier is an equality join on folded keys; the ambiguity tier joins on words, the rarest first.
    """
    index = name_index(firms)
    distinct = names.select(F.col(raw).alias("raw")).filter("raw is not null and trim(raw) <> ''").distinct()
    keyed = distinct.withColumn("key", fold_name(F.col("raw"))).withColumn(
        "head", F.when(F.contains("raw", F.lit(",")), F.trim(F.split_part("raw", F.lit(","), F.lit(1))))
    )
    keyed = keyed.withColumn("head_key", F.when(F.length("head") > 3, fold_name(F.col("head"))))
    head = index.select(F.col("key").alias("head_key"), F.col("canonical").alias("of_head"))
    own = firms.select("canonical", fold_name(F.col("canonical")).alias("own_key"))
    tiered = (
        keyed.join(index, "key", "left")
        .join(head, "head_key", "left")
        .join(own, "canonical", "left")
        .select("raw", "key", "canonical", "of_head", "own_key")
    )
    many = ambiguous_names(tiered.filter("canonical is null and of_head is null").select("raw", "key"), index)
    return tiered.join(many, "raw", "left").select(
        "raw",
        F.coalesce("canonical", "of_head").alias("canonical"),
        F.when((F.col("raw") == F.col("canonical")) | (F.col("key") == F.col("own_key")), "exact")
        .when(F.col("canonical").isNotNull(), "alias")
        .when(F.col("of_head").isNotNull(), "division")
        .when(F.col("n_firms") > 1, "ambiguous")
        .otherwise("unresolved")
        .alias("resolution"),
    )


def ambiguous_names(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """(raw, n_firms): firms that have a name of which the words of ``key`` are a proper part.

    An equality join on words and a count of the words met, so no pair of names is formed that shares none.
    """
    words = keyed.select("raw", F.explode(F.array_distinct(F.split("key", " "))).alias("w")).filter("w <> ''")
    need = words.groupBy("raw").agg(F.count("*").alias("need"))
    known = index.select("key", "canonical", F.array_distinct(F.split("key", " ")).alias("ws"))
    met = (
        words.join(known.select("key", "canonical", F.size("ws").alias("has"), F.explode("ws").alias("w")), "w")
        .groupBy("raw", "key", "canonical", "has")
        .agg(F.count("*").alias("met"))
        .join(need, "raw")
        .filter("met = need and has > need")
    )
    return met.groupBy("raw").agg(F.countDistinct("canonical").alias("n_firms"))


def fuzzy_resolve(names: DataFrame, firms: DataFrame, accept: float = 0.88, margin: float = 0.06) -> DataFrame:
    """(raw, canonical, resolution, ratio) by sequence similarity against the curated list, ambiguous names kept apart.

    The best name of the list must reach ``accept``; if among the four best another firm's name comes within ``margin``,
    the result is ambiguous. Equal ratios pick the lexicographically greatest key. Names as alike as ``accept`` asks share
    a run of letters, so candidates come from an equality join on pieces of the names. Names without candidates are
    unresolved as well; unresolved names have no ratio, as not all of the list was compared with them.
    """
    index = name_index(firms)
    raw = names.select(F.col("firm").alias("raw")).filter("raw is not null").distinct().withColumn("key", fold_name(F.col("raw")))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    def grams(key: str) -> Column:
        """Pieces of four letters; of two as well for short keys."""

        def of(n: int) -> Column:
            at = F.sequence(F.lit(1), F.greatest(F.length(key) - (n - 1), F.lit(1)))
            return F.transform(at, lambda i: F.substring(key, i, n))

        return F.array_distinct(F.when(F.length(key) < 12, F.concat(of(4), of(2))).otherwise(of(4)))

    # A ratio of ``accept - margin`` bounds the difference in length.
    left = raw.select("raw", "key", F.explode(grams("key")).alias("g"))
    right = index.select(F.col("key").alias("name"), "canonical", F.explode(grams("key")).alias("g"))
    pairs = left.join(right, "g").select("raw", "key", "name", "canonical").distinct()
    bound = 2 * F.least(F.length("key"), F.length("name")) / (F.length("key") + F.length("name"))
    pairs = spread(pairs.filter(bound >= accept - margin), "raw")
    ranked = pairs.withColumn("ratio", ratio("key", "name")).withColumn(
        "r", F.row_number().over(Window.partitionBy("raw").orderBy(F.desc("ratio"), F.desc("name")))
    )
    top = ranked.filter("r <= 4").groupBy("raw").agg(
        F.max("ratio").alias("ratio"),
        F.min_by("canonical", "r").alias("best"),
        F.collect_list(F.struct("ratio", "canonical")).alias("four"),
    )
    close = F.size(F.array_distinct(F.transform(F.filter("four", lambda x: x["ratio"] > F.col("ratio") - margin), lambda x: x["canonical"])))
    alike = F.coalesce(F.col("ratio") >= accept, F.lit(False))
    return raw.join(top, "raw", "left").select(
        "raw",
        F.when(alike & (close == 1), F.col("best")).alias("canonical"),
        F.when(~alike, "unresolved").when(close > 1, "ambiguous").otherwise("fuzzy").alias("resolution"),
        F.when(alike, F.col("ratio")).alias("ratio"),
    )


def resolve_fully(names: DataFrame, firms: DataFrame, raw: str = "firm") -> DataFrame:
    """(raw, canonical, resolution) of distinct names through all tiers: those of :func:`resolve_names`, then similarity.

    Similarity is asked for names that are unresolved, not for ambiguous ones; a name whose text before the first comma
    is resolved by similarity is a division.
    """
    tiered = resolve_names(names, firms, raw).withColumn(
        "head",
        F.when(F.col("canonical").isNull() & F.contains("raw", F.lit(",")), F.trim(F.split_part("raw", F.lit(","), F.lit(1)))),
    )
    tiered = cut(tiered.withColumn("head", F.when(F.length("head") > 3, F.col("head"))))
    heads = tiered.filter("head is not null").select(F.col("head").alias("firm"))
    asked = resolve_names(heads, firms).unionByName(tiered.select("raw", "canonical", "resolution"))
    alike = fuzzy_resolve(asked.filter("resolution = 'unresolved'").select(F.col("raw").alias("firm")), firms)
    alike = cut(alike.filter("resolution <> 'unresolved'"))
    whole = alike.select("raw", F.col("canonical").alias("alike"), F.col("resolution").alias("how"))
    first = alike.filter("resolution = 'fuzzy'").select(F.col("raw").alias("head"), F.col("canonical").alias("of_head"))
    both = tiered.join(first, "head", "left").join(whole, "raw", "left")
    return both.select(
        "raw",
        F.coalesce("canonical", "of_head", F.when(F.col("resolution") == "unresolved", F.col("alike"))).alias("canonical"),
        F.when(F.col("of_head").isNotNull(), "division")
        .when(F.col("resolution") == "unresolved", F.coalesce("how", "resolution"))
        .otherwise(F.col("resolution"))
        .alias("resolution"),
    )


def lineage(firms: DataFrame) -> DataFrame:
    """(root, ancestor, lvl): the ancestors of every firm, nearest first; cycles end where they would repeat."""
    return firms.sparkSession.sql(
        """
        WITH RECURSIVE up(root, cur, lvl, path) AS (
          SELECT canonical, canonical, 0, array(canonical) FROM {firms}
          UNION ALL
          SELECT u.root, f.parent, u.lvl + 1, array_append(u.path, f.parent)
          FROM up u JOIN {firms} f ON f.canonical = u.cur
          WHERE f.parent IS NOT NULL AND NOT array_contains(slice(u.path, 1, size(u.path) - 1), u.cur))
        SELECT root, cur AS ancestor, lvl FROM up WHERE lvl > 0
        """,
        firms=firms,
    )


def longest_term(texts: DataFrame, terms: DataFrame, id_cols: list[str], text: str) -> DataFrame:
    """(ids, term, value): the longest term standing in the text as whole words; earlier terms win ties.

    ``terms``: term (lower case), value, ord. The text's word n-grams, as long as the longest term, are joined with the
    terms by equality, so the work grows with the text and not with texts times terms.
    """
    max_words = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    words = F.filter(F.split(F.lower(F.col(text)), r"[\s,;:()|/]+"), lambda w: w != "")
    toks = texts.select(*id_cols, words.alias("_w")).filter(F.size("_w") > 0)
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(max_words)),
            lambda n: F.transform(
                F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: i + n - 1 <= F.size("_w")),
                lambda i: F.array_join(F.slice("_w", i, n), " "),
            ),
        )
    )
    found = toks.select(*id_cols, F.explode(F.array_distinct(grams)).alias("term")).join(terms, "term")
    best = found.groupBy(*id_cols).agg(F.max_by(F.struct("term", "value"), F.struct(F.length("term"), -F.col("ord"))).alias("b"))
    return best.select(*id_cols, "b.term", "b.value")


def all_terms(texts: DataFrame, terms: DataFrame, id_cols: list[str], text: str) -> DataFrame:
    """(ids, value): every value one of whose terms, of any number of words, stands in the text between non-letters."""
    max_words = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z]+)"), F.lit(1))
    toks = texts.select(*id_cols, words.alias("_w")).filter(F.size("_w") > 0)
    grams = F.flatten(
        F.transform(F.sequence(F.lit(1), F.lit(max_words)), lambda n: F.transform(
            F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: i + n - 1 <= F.size("_w")), lambda i: F.array_join(F.slice("_w", i, n), " ")))
    )
    toks = toks.select(*id_cols, F.explode(F.array_distinct(grams)).alias("term"))
    return toks.join(terms.select("term", "value"), "term").select(*id_cols, "value").distinct()


def band_of(years: Column, bands: list[tuple[str, float]]) -> Column:
    """The first band whose upper bound is not exceeded, else the last; null for null."""
    out = F.when(years.isNull(), None)
    for band, top in bands[:-1]:
        out = out.when(years <= top, band)
    return out.otherwise(bands[-1][0])


def first_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The label of the first pattern found in the lower-case text, else null."""
    out = F.when(text.isNull(), None)
    for label, pattern in patterns:
        out = out.when(F.lower(text).rlike(pattern), label)
    return out


def canonical_spelling(values: DataFrame, aliases: DataFrame, raw: str, boundary: bool = True) -> DataFrame:
    """(raw, canonical): the longest spelling equal to, or standing inside, the value; the trimmed value where none does.

    With ``boundary`` a spelling must stand between non-alphanumerics; without, any substring counts (as short
    spellings such as "r" then match inside other words, this is for parity only). ``aliases``: spelling, canonical,
    ord; a small curated list, joined by containment with the distinct values.
    """
    distinct = values.select(F.col(raw).alias("raw")).filter("raw is not null and trim(raw) <> ''").distinct()
    low = F.lower(F.trim("raw"))
    inside = F.contains(low, F.col("spelling"))
    if boundary:
        framed = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9+#&./-]+", " "), F.lit(" "))
        inside = F.contains(framed, F.concat(F.lit(" "), F.col("spelling"), F.lit(" ")))
    hit = distinct.join(F.broadcast(aliases), inside, "left")
    best = hit.groupBy("raw").agg(F.max_by("canonical", F.struct(F.length("spelling"), -F.col("ord"))).alias("canonical"))
    return best.select("raw", F.coalesce("canonical", F.trim("raw")).alias("canonical"))
