"""Map freely typed values to the entries of a reference list, in Spark SQL only.

Both sides get one folded form (lower case, no accents, no punctuation or spaces). The ways to write an entry are derived
from the list itself: its aliases; shortenings of its words (leading letters, first and last letters, without vowels,
initials); words left out, where no word of the entry recurs in other entries; and for entries "name, country" the
country's names and codes in either order, from the locale data of the Java runtime (ISO 3166 and CLDR). The typed side is
written out as well: without words that no entry uses or that stand in many values of the column, and, for entries whose words do not recur, without other words,
without its last letters, or as a blend of the beginnings of its words. Each way has a cost.

A partition-based pigeonhole join finds every pair within ``EDITS`` edits: a reference form cut into EDITS + 1 segments
must share one of them with the typed form at nearly the same place, so an equality join on (length, segment, substring)
finds all candidates; the built-in ``levenshtein`` verifies them, equal forms being those at distance 0. One rule accepts:
an edit needs five letters, a second one ten more, and a swap of neighbours counts a little less than one. The cheapest way
wins. Two more passes learn from the column: values still without an entry whose records, by their other fields, belong to
one market in nearly all cases get the field's entry of that market; and what matched becomes a way to write its entry for
values misspelt once more. What no entry answers is found by an anti-join and reported with value 0.

Defined results: null and blank values give no row; a value equal to a canonical entry letter for letter gives none; among
several entries at the same cost the one listed first wins; repeated records count once. The reference list is small and
fixed (a curated list); typed values are deduplicated before anything is joined.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import settle_lean as cut
from rosterlake.session import settle_small

EDITS = 2
# Common English names of countries that the locale data does not have, by ISO 3166 code.
MORE_NAMES = {
    "GB": ["Great Britain", "Britain", "England"],
    "US": ["United States of America"],
    "NL": ["Holland"],
    "KR": ["Korea"],
    "HK": ["Hong Kong"],
}


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their plain letters, by decomposition; a few letters that have none."""
    plain = {"ø": "o", "đ": "d", "ł": "l", "ı": "i", "ß": "s", "æ": "a", "œ": "o", "ð": "d", "þ": "t"}
    pairs = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]}
    pairs = {k: v for k, v in pairs.items() if k != v and v.isascii() and k == k.lower()} | plain
    return "".join(pairs), "".join(pairs.values())


def folded(column: str) -> str:
    """SQL for the folded form with single spaces: letters and digits only, without accents."""
    src, dst = _accents()
    marks = f"regexp_replace({column}, r'[\\pM\\pC]+', '')"
    return f"trim(regexp_replace(translate(replace(lower({marks}), '&', ' and '), '{src}', '{dst}'), '[^a-z0-9]+', ' '))"


def _digraphs(column: str) -> str:
    out = f"regexp_replace({column}, r'[\\u0308]', 'e')"
    for letter, pair in {"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe", "ß": "ss"}.items():
        out = f"replace(replace({out}, '{letter}', '{pair}'), '{letter.upper()}', '{pair}')"
    return out


def country_ways(reference: DataFrame) -> DataFrame:
    """(code, way, english): ISO codes, English names and initials of every country, folded; of the countries that the
    reference list names also their names in their own languages.

    From java.util.Locale of the runtime: a fixed list of some thousand short texts. Only the codes of the countries
    named, at most those there are, reach the driver, so that no other languages' data are loaded there.
    """
    spark = reference.sparkSession
    locale = spark._jvm.java.util.Locale
    english = locale.forLanguageTag("en")
    ways = []
    for code in locale.getISOCountries():
        here = locale.forLanguageTag(f"und-{code}")
        name = here.getDisplayCountry(english)
        initials = "".join(w[0] for w in name.split() if w[0].isupper())
        ways += [(code, w, True) for w in (code, here.getISO3Country(), name, *([initials] if len(initials) > 1 else []), *MORE_NAMES.get(code, []))]

    def both(rows: list[tuple]) -> DataFrame:
        frame = spark.createDataFrame(rows, "code string, name string, english boolean").coalesce(1)
        return frame.select("code", F.expr(folded("name")).alias("way"), "english").union(
            frame.select("code", F.expr(folded(_digraphs("name"))), "english")
        )

    plain = both(ways).coalesce(1)
    named = reference.select(F.expr(folded("split_part(canonical, ',', -1)")).alias("way")).distinct()
    codes = {r["code"] for r in settle_small(plain.join(named, "way").select("code").distinct()).collect()}
    own = [(x.getCountry(), x) for x in locale.getAvailableLocales() if x.getCountry() in codes and not x.getScript() and not x.getVariant()]
    native = [(code, x.getDisplayCountry(x), False) for code, x in own]
    out = plain.union(both(native)).coalesce(1) if native else plain
    return out.filter("way <> ''").groupBy("code", "way").agg(F.bool_or("english").alias("english"))


VOWEL_FREE = "regexp_replace({0}, '(?<=.)[aeiou]', '')"


def reference_heads(reference: DataFrame, ways: DataFrame) -> DataFrame:
    """(field_name, value_id, land, cost, ws): words of each entry's name, its aliases and, for a country, its other names.

    ``land``: the country code of entries "name, country".
    """
    return reference.sparkSession.sql(
        rf"""
        WITH entry AS (
          SELECT r.field_name, r.value_id, r.canonical, coalesce(r.aliases, array()) AS aliases, p.code AS land, o.code AS own
          FROM {{ref}} r
          LEFT JOIN {{ways}} p ON r.canonical LIKE '%,%' AND {folded("split_part(r.canonical, ',', -1)")} = p.way
          LEFT JOIN {{ways}} o ON {folded("r.canonical")} = o.way
          WHERE r.value_id IS NOT NULL),
        head AS (
          SELECT field_name, value_id, land, 0 AS cost, CASE WHEN land IS NULL THEN canonical ELSE split_part(canonical, ',', 1) END AS text FROM entry
          UNION ALL SELECT field_name, value_id, land, 0, explode(aliases) FROM entry
          UNION ALL SELECT e.field_name, e.value_id, e.land, 1, w.way FROM entry e JOIN {{ways}} w ON e.own = w.code AND w.english AND length(w.way) > 2),
        twin AS (SELECT field_name, value_id, land, cost, explode(array(text, {_digraphs("text")})) AS text FROM head),
        plain AS (SELECT DISTINCT field_name, value_id, land, cost, {folded("text")} AS text FROM twin)
        SELECT field_name, value_id, land, cost, split(text, ' ') AS ws FROM plain WHERE text <> ''
        """,
        ref=reference,
        ways=ways,
    )


def reference_forms(heads: DataFrame, ways: DataFrame) -> DataFrame:
    """(field_name, form, value_id, cost, proper): every way an entry may be written, without spaces.

    ``proper`` entries are names of places or share words with other entries: their words are only shortened where they
    recur as first words (Port, Upper), and never left out.
    """
    spark = heads.sparkSession
    bare = VOWEL_FREE.format("w")
    thin = f"regexp_replace({bare}, r'(.)\\1', '$1')"
    family = spark.sql(
        rf"""
        WITH spelt AS (SELECT * FROM {{heads}}),
        word AS (SELECT field_name, value_id, w, i = 0 AND size(ws) > 1 AS opens FROM spelt LATERAL VIEW posexplode(ws) AS i, w),
        shared AS (SELECT field_name, w, bool_or(opens) AS opens FROM word GROUP BY ALL HAVING count(DISTINCT value_id) > 1),
        family AS (
          SELECT s.*, s.land IS NOT NULL OR exists(s.ws, w -> array_contains(coalesce(f.ws, array()), w)) AS proper,
                 coalesce(f.opens, array()) AS opens
          FROM spelt s LEFT JOIN (SELECT field_name, collect_list(w) AS ws, collect_list(CASE WHEN opens THEN w END) AS opens FROM shared GROUP BY 1) f
            ON s.field_name = f.field_name)
        SELECT * FROM family
        """,
        heads=heads,
    )
    family = settle_small(family)
    short = spark.sql(
        rf"""
        WITH choice AS (
          SELECT field_name, value_id, land, cost, proper, ws, transform(ws, (w, i) -> filter(flatten(array(
            array(struct(w AS t, 0 AS c)),
            CASE WHEN proper AND i = 0 AND size(ws) > 1 AND array_contains(opens, w) THEN
              transform(array(left(w, 1), left(w, 2), {bare}, {thin}, left(w, 1) || right(w, 1), left(w, 1) || right(w, 2)), t -> struct(t, 1 AS c))
            ELSE array() END,
            CASE WHEN NOT proper AND length(w) > 3 THEN
              transform(sequence(CASE WHEN size(ws) > 1 THEN 3 ELSE 2 END, length(w) - 1), n -> struct(left(w, n) AS t, CASE WHEN 5 * n >= 3 * length(w) THEN 1 ELSE 2 END AS c))
            ELSE array() END,
            CASE WHEN NOT proper THEN array(struct({bare} AS t, 1 AS c), struct(replace(w, 'cross', 'x') AS t, 1 AS c), struct(left(w, 1) || right(w, 1) AS t, 2 AS c))
            ELSE array() END,
            CASE WHEN NOT proper AND size(ws) > 1 THEN array(struct(left(w, 1) AS t, 2 AS c), struct('' AS t, 3 AS c)) ELSE array() END)),
            x -> true)) AS options FROM {{family}}),
        made AS (
          SELECT field_name, value_id, land, proper, x.t AS form, cost + x.c AS cost FROM choice LATERAL VIEW explode(
            aggregate(options, array(struct('' AS t, 0 AS c, 0 AS n)), (acc, o) -> flatten(transform(acc, a -> transform(o, b ->
              struct(a.t || b.t AS t, a.c + b.c AS c, a.n + CASE WHEN b.t = '' THEN 0 ELSE 1 END AS n)))))) AS x
          WHERE 2 * x.n >= size(ws)
          UNION ALL
          SELECT field_name, value_id, land, proper, array_join(transform(ws, w -> left(w, 1)), ''), cost + 1 FROM {{family}} WHERE NOT proper AND size(ws) > 1),
        short AS (
          SELECT field_name, value_id, land, proper, form, min(cost) AS cost FROM made
          WHERE length(form) > 2 OR length(form) = 2 AND cost <= 2 OR cost = 0 GROUP BY ALL)
        SELECT * FROM short
        """,
        family=family,
    )
    return spark.sql(
        """
        WITH form AS (
          SELECT field_name, value_id, proper, form, cost FROM {short}
          UNION ALL SELECT s.field_name, s.value_id, s.proper, s.form || replace(w.way, ' ', ''), s.cost FROM {short} s JOIN {ways} w ON s.land = w.code
          UNION ALL SELECT s.field_name, s.value_id, s.proper, replace(w.way, ' ', '') || s.form, s.cost FROM {short} s JOIN {ways} w ON s.land = w.code)
        SELECT field_name, form, value_id, min(cost) AS cost, bool_or(proper) AS proper FROM form WHERE form <> '' GROUP BY field_name, form, value_id
        """,
        short=cut(short),
        ways=ways,
    )


def typed_words(typed: DataFrame) -> DataFrame:
    """(field_name, value, ws): the folded words of distinct typed values; numbers are no words of a value."""
    return typed.sparkSession.sql(
        rf"""SELECT field_name, value, filter(split({folded("value")}, ' '), w -> w <> '' AND NOT w RLIKE '^[0-9]+$') AS ws FROM {{typed}}""",
        typed=typed,
    )


def typed_forms(words: DataFrame, heads: DataFrame, forms: DataFrame, ways: DataFrame) -> DataFrame:
    """(field_name, value, form, cost, loose, lost, blend) of distinct typed values; see the module docstring.

    ``loose`` forms may differ by edits, the others must be met exactly; ``lost`` forms lack a word that entries use, and
    ``lost`` and ``blend`` forms only meet entries that are not proper.
    """
    spark = words.sparkSession
    used = spark.sql(
        """
        SELECT field_name, explode(ws) AS w FROM {heads}
        UNION SELECT h.field_name, explode(split(w.way, ' ')) FROM (SELECT DISTINCT field_name, land FROM {heads}) h JOIN {ways} w ON w.code = h.land
        """,
        heads=heads,
        ways=ways,
    )
    known = spark.sql(
        r"""
        WITH noise AS (
          SELECT t.field_name, t.w, true AS noise FROM (SELECT field_name, value, explode(array_distinct(ws)) AS w FROM {words}) t
          JOIN (SELECT field_name, count(*) AS n FROM {words} GROUP BY 1) a ON t.field_name = a.field_name
          LEFT ANTI JOIN {used} u ON t.field_name = u.field_name AND t.w = u.w
          GROUP BY t.field_name, t.w, a.n HAVING count(*) >= greatest(4, 0.002 * a.n)),
        kinds AS (SELECT DISTINCT field_name, true AS free FROM {forms} WHERE NOT proper),
        told AS (SELECT t.*, coalesce(k.free, false) AS free FROM {words} t LEFT JOIN kinds k ON t.field_name = k.field_name),
        known AS (
          SELECT o.field_name, o.value, any_value(o.ws) AS ws, any_value(o.free) AS free, collect_set(u.w) AS used,
                 collect_set(CASE WHEN n.noise THEN o.w END) AS noise
          FROM (SELECT *, explode(ws) AS w FROM told) o LEFT JOIN {used} u ON o.field_name = u.field_name AND o.w = u.w
          LEFT JOIN noise n ON o.field_name = n.field_name AND o.w = n.w GROUP BY o.field_name, o.value)
        SELECT * FROM known
        """,
        words=words,
        used=settle_small(used),
        forms=forms,
    )
    return spark.sql(
        r"""
        WITH part AS (
          SELECT field_name, value, explode(CASE WHEN free AND size(ws) BETWEEN 2 AND 5 THEN
            aggregate(ws, array(struct(cast(array() AS array<string>) AS k, 0 AS c, false AS l)), (acc, w) -> flatten(transform(acc, a -> array(
              struct(array_append(a.k, w) AS k, a.c AS c, a.l AS l),
              struct(a.k AS k, a.c + CASE WHEN array_contains(used, w) THEN 3 ELSE 1 END AS c, a.l OR array_contains(used, w) AS l)))))
            ELSE array(struct(ws AS k, 0 AS c, false AS l)) END) AS x
          FROM {known}
          UNION ALL
          SELECT field_name, value, explode(array(
            struct(filter(ws, w -> array_contains(used, w)) AS k, 1 AS c, false AS l),
            struct(filter(ws, (w, i) -> NOT array_contains(noise, w) AND NOT (i > 0 AND i < size(ws) - 1 AND w IN ('in', 'of', 'to', 'at', 'the'))) AS k, 1 AS c, false AS l)))
          FROM {known}),
        blends AS (
          SELECT field_name, value, explode(aggregate(filter(ws, w -> NOT w IN ('and', 'of', 'the')), array(''),
            (acc, w) -> flatten(transform(acc, a -> array(a || left(w, 1), a || left(w, 2), a || left(w, 3)))))) AS form
          FROM {known} WHERE free AND size(filter(ws, w -> NOT w IN ('and', 'of', 'the'))) BETWEEN 2 AND 4),
        stems AS (
          SELECT field_name, value, left(ws[0], n) AS form, (length(ws[0]) - n + 1) div 2 AS cost
          FROM {known} LATERAL VIEW explode(sequence(greatest(5, (3 * length(ws[0]) + 4) div 5), length(ws[0]) - 1)) AS n
          WHERE free AND size(ws) = 1 AND length(ws[0]) BETWEEN 6 AND 40)
        SELECT field_name, value, form, min(cost) AS cost, bool_or(loose) AS loose, bool_and(lost) AS lost, bool_and(blend) AS blend FROM (
          SELECT field_name, value, array_join(x.k, '') AS form, x.c AS cost, x.c <= 1 AS loose, x.l AS lost, false AS blend FROM part WHERE size(x.k) > 0
          UNION ALL SELECT field_name, value, form, 2, false, false, true FROM blends
          UNION ALL SELECT field_name, value, form, cost, false, false, true FROM stems)
        GROUP BY field_name, value, form
        """,
        known=cut(known),
    )


def segment_join(typed: DataFrame, forms: DataFrame, most: int = 8) -> DataFrame:
    """(field_name, value, value_id, cost) of every typed form and reference form near each other, at a cost of ``most`` or less."""
    n = EDITS + 1
    return typed.sparkSession.sql(
        f"""
        WITH segment AS (
          SELECT f.*, length(form) AS len, s, (length(form) * s) div {n} + 1 AS at, (length(form) * (s + 1)) div {n} - (length(form) * s) div {n} AS width
          FROM {{forms}} f LATERAL VIEW explode(sequence(0, {EDITS})) AS s),
        piece AS (
          SELECT DISTINCT t.*, l AS len, s, substr(form, p, (l * (s + 1)) div {n} - (l * s) div {n}) AS part
          FROM {{typed}} t
          LATERAL VIEW explode(CASE WHEN loose THEN sequence(greatest(1, length(form) - {EDITS}), length(form) + {EDITS}) ELSE array(length(form)) END) AS l
          LATERAL VIEW explode(CASE WHEN loose THEN sequence(0, {EDITS}) ELSE array({EDITS}) END) AS s
          LATERAL VIEW explode(CASE WHEN loose THEN sequence(greatest(1, (l * s) div {n} + 1 - {EDITS}), (l * s) div {n} + 1 + {EDITS}) ELSE array((l * s) div {n} + 1) END) AS p
          WHERE (l * (s + 1)) div {n} > (l * s) div {n} AND p + (l * (s + 1)) div {n} - (l * s) div {n} - 1 <= length(form)),
        pair AS (
          SELECT DISTINCT p.field_name, p.value, p.form AS typed, p.cost AS tc, g.form, g.value_id, g.cost AS rc
          FROM piece p JOIN segment g ON p.field_name = g.field_name AND p.len = g.len AND p.s = g.s AND p.part = substr(g.form, g.at, g.width)
          WHERE (p.loose OR p.form = g.form) AND NOT (g.proper AND (p.lost OR p.blend))),
        verified AS (SELECT *, levenshtein(typed, form, {EDITS}) AS edits FROM pair),
        judged AS (
          SELECT *, CASE WHEN edits = 2 AND length(form) = length(typed) AND array_sort(split(form, '')) = array_sort(split(typed, '')) THEN 0.8D ELSE edits END AS off
          FROM verified WHERE edits >= 0)
        SELECT field_name, value, value_id, min(cast(2 * off + 0.5 AS int) + tc + rc) AS cost FROM judged WHERE 10 * off <= length(form) + 5
        GROUP BY ALL HAVING cost <= {most}
        """,
        typed=typed,
        forms=forms,
    )


def map_to_reference(
    records: DataFrame, id_col: str, fields: list[str], reference: DataFrame, agree: float = 0.85, witnesses: int = 8
) -> DataFrame:
    """(id, field_name, value_id) of every typed value that is not itself canonical; value_id 0 where none is meant.

    ``agree``, ``witnesses``: a value is learned by its market if at least that share of at least that many records agree.
    """
    spark = records.sparkSession
    reference = reference.coalesce(1)
    stack = ", ".join(f"'{f}', cast({f} as string)" for f in fields)
    whole = cut(spark.sql(
        f"""SELECT DISTINCT {id_col} AS id, field_name, value
            FROM (SELECT {id_col}, stack({len(fields)}, {stack}) AS (field_name, value) FROM {{records}})
            WHERE value RLIKE r'\\S' AND {id_col} IS NOT NULL""",
        records=records,
    ))
    # Each table that several steps read is computed once; plans stay small for the driver.
    cells = cut(spark.sql(
        "SELECT c.* FROM {cells} c LEFT ANTI JOIN {ref} r ON c.field_name = r.field_name AND c.value = r.canonical", cells=whole, ref=reference
    ))
    distinct = cut(spark.sql("SELECT DISTINCT field_name, value FROM {cells}", cells=cells))
    ways = settle_small(country_ways(reference))
    heads = settle_small(reference_heads(reference, ways))
    forms = cut(reference_forms(heads, ways))
    words = cut(typed_words(distinct))
    typed = cut(typed_forms(words, heads, forms, ways))
    cheapest = "SELECT field_name, value, min(struct(cost, value_id)) AS b FROM {near} GROUP BY field_name, value"
    first = cut(spark.sql(f"SELECT field_name, value, b.value_id, b.cost FROM ({cheapest})", near=segment_join(typed, forms)))

    # Markets of the records by their other fields teach values that no way of writing answers.
    one = settle_small(spark.sql(
        "SELECT field_name, market, min(value_id) AS value_id FROM {ref} WHERE market IS NOT NULL GROUP BY ALL HAVING count(*) = 1", ref=reference
    ))
    unanswered = cut(spark.sql(
        """SELECT c.id, c.field_name, c.value, array_join(w.ws, ' ') AS text FROM {cells} c JOIN {words} w ON c.field_name = w.field_name AND c.value = w.value
           LEFT ANTI JOIN {first} f ON c.field_name = f.field_name AND c.value = f.value
           WHERE c.field_name IN (SELECT field_name FROM {one})""",
        cells=cells, words=words, first=first, one=one,
    ))
    taught = spark.sql(
        f"""
        WITH entry AS (SELECT field_name, value_id, canonical, market FROM {{ref}} WHERE market IS NOT NULL),
        placed AS (
          SELECT c.id, c.field_name, e.market FROM {{cells}} c JOIN {{first}} f ON c.field_name = f.field_name AND c.value = f.value JOIN entry e ON f.value_id = e.value_id
          UNION SELECT c.id, c.field_name, e.market FROM {{whole}} c JOIN entry e ON c.field_name = e.field_name AND c.value = e.canonical),
        seen AS (
          SELECT o.field_name, o.text, p.market, count(*) AS n FROM {{open}} o JOIN placed p ON o.id = p.id AND o.field_name <> p.field_name WHERE o.text <> '' GROUP BY ALL),
        clear AS (SELECT field_name, text, max_by(market, n) AS market FROM seen GROUP BY ALL HAVING sum(n) >= {witnesses} AND max(n) >= {agree} * sum(n))
        SELECT DISTINCT o.field_name, o.value, one.value_id, 9 AS cost FROM {{open}} o JOIN clear c ON o.field_name = c.field_name AND o.text = c.text
        JOIN {{one}} one ON one.field_name = c.field_name AND one.market = c.market
        """,
        cells=cells, whole=whole, first=first, ref=reference, open=unanswered, one=one,
    )
    found = cut(spark.sql("SELECT * FROM {first} UNION ALL SELECT * FROM {taught}", first=first, taught=taught))

    # What often matched is a way to write its entry, for values misspelt once more.
    learned = spark.sql(
        f"""SELECT f.field_name, array_join(w.ws, '') AS form, min(f.value_id) AS value_id, 1 AS cost, false AS proper
            FROM {{found}} f JOIN {{cells}} c ON f.field_name = c.field_name AND f.value = c.value
            JOIN {{words}} w ON f.field_name = w.field_name AND f.value = w.value
            JOIN (SELECT DISTINCT field_name FROM {{forms}} WHERE NOT proper) k ON f.field_name = k.field_name
            GROUP BY 1, 2 HAVING count(DISTINCT f.value_id) = 1 AND count(*) >= {witnesses}""",
        found=found, cells=cells, forms=forms, words=words,
    )
    again = segment_join(typed.filter("loose"), cut(learned))
    best = spark.sql(
        f"SELECT field_name, value, b.value_id FROM ({cheapest.replace('{near}', '(SELECT * FROM {found} UNION ALL SELECT * FROM {again})')})",
        found=found.select("field_name", "value", "value_id", "cost"), again=again,
    )
    best = cut(best)
    unmatched = spark.sql(
        """SELECT t.field_name, t.value, 0L AS value_id FROM {typed} t
           LEFT ANTI JOIN {best} b ON t.field_name = b.field_name AND t.value = b.value""",
        typed=distinct,
        best=best,
    )
    return spark.sql(
        f"""SELECT DISTINCT c.id AS {id_col}, c.field_name, m.value_id
            FROM {{cells}} c JOIN (SELECT * FROM {{best}} UNION ALL SELECT * FROM {{unmatched}}) m
            ON c.field_name = m.field_name AND c.value = m.value""",
        cells=cells,
        best=best,
        unmatched=unmatched,
    )
