"""Text normal forms and extractions as column expressions; Arrow functions only where Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that say nothing about a requirement.
STOP_WORDS = [
    "and", "the", "for", "with", "from", "into", "across", "their", "this", "that", "have", "has", "are", "was", "were",
    "which", "including", "such", "based", "using", "used", "within", "under", "over", "through", "other",
]
# Words that say nothing about what a flag is about.
FLAG_STOP_WORDS = [
    "resume", "candidate", "however", "which", "there", "their", "these", "this", "that", "with", "from", "have", "been",
    "does", "given", "into", "under", "listed", "stated", "appears", "written", "between", "while", "left", "exactly",
    "would", "guess", "text", "source", "entry", "role", "roles", "position", "positions", "explain", "interval", "recorded",
]
HONORIFICS = r"(?i)^((dr|mr|ms|mrs|prof)\.?\s+)+"
# White space of all scripts; \s alone is that of ASCII.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def loose(text: Column) -> Column:
    """Lower case with every run of other characters than letters a-z and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct tokens of two characters or more, in order of first use, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9+#]{2,})"), F.lit(1)))
    words = STOP_WORDS if stop is None else stop
    return F.array_except(found, F.array(*[F.lit(w) for w in words])) if words else found


def flag_tokens(text: Column) -> Column:
    """Distinct words of four letters or more of a flag's summary, without its stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{4,})"), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(w) for w in FLAG_STOP_WORDS]))


def slug(name: Column, fallback: Column) -> Column:
    """Letters and digits joined by hyphens; of the file name without its ending where there is no name."""
    base = F.coalesce(F.nullif(name, F.lit("")), F.regexp_replace(fallback, r"\.[^.]*$", ""))
    return F.regexp_replace(F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def name_from_file(file: Column) -> Column:
    """A person's name from a file name: ending, separators, and words such as resume or final taken out."""
    base = F.regexp_replace(F.regexp_replace(file, r"\.[^.]*$", ""), "[_-]+", " ")
    base = F.regexp_replace(base, r"(?i)\b(resume|cv|final|updated|[0-9]{4,})\b", " ")
    return F.initcap(F.trim(F.regexp_replace(base, r"\s+", " ")))


def display_name(name: Column) -> Column:
    """Without leading honorifics; names in capitals get initial capitals."""
    bare = F.regexp_replace(name, HONORIFICS, "")
    return F.when(F.upper(bare) == bare, F.initcap(bare)).otherwise(bare)


def short_name(name: Column) -> Column:
    """The last word of a name that is neither an honorific nor bracketed."""
    words = F.filter(
        F.split(F.trim(F.regexp_replace(name, HONORIFICS.replace(r"\s", SPACE), "")), SPACE + "+"), lambda w: (w != "") & ~w.startswith("(")
    )
    return F.try_element_at(words, F.lit(-1))


def label_of(value: Column) -> Column:
    """Underscores as spaces, initial capitals; a dash for null."""
    return F.coalesce(F.initcap(F.replace(value, F.lit("_"), F.lit(" "))), F.lit("—"))


def credential_label(text: Column) -> Column:
    """``code · status`` of ``CODE - Full name (status)``; the code alone without a status."""
    code = F.trim(F.split_part(text, F.lit(" - "), F.lit(1)))
    status = F.regexp_extract(text, r"\(([^()]*)\)\s*$", 1)
    bare = F.trim(F.regexp_replace(code, r"\([^()]*\)\s*$", ""))
    return F.when(status == "", code).otherwise(F.concat(bare, F.lit(" · "), status))


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def dedupe_cells(cells: Column) -> Column:
    """Trimmed cells that are not empty, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(cells, lambda x: F.trim(x)), lambda x: x != ""))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form (ligatures, widths); no built-in has it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def repair(text: Column) -> Column:
    """struct(text, repairs, remaining): compatibility form, damaged letter pairs restored, blanks and blank lines squeezed.

    A replacement character in "por?olio" stands for "tf", between other letters for "ti"; repairs counts these only.
    """
    damaged = nfkc(text)
    tf, ti = r"(?<=[Pp]or)�(?=olio)", r"(?<=[A-Za-z])�(?=[A-Za-z])"
    first = F.regexp_replace(damaged, tf, "tf")
    both = F.regexp_replace(first, ti, "ti")
    count = F.regexp_count(damaged, F.lit(tf)) + F.regexp_count(first, F.lit(ti))
    tidy = F.regexp_replace(F.regexp_replace(both, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    body = F.trim(F.array_join(F.transform(F.split(tidy, "\n"), lambda x: F.trim(x)), "\n"))
    return F.struct(body.alias("text"), count.alias("repairs"), F.regexp_count(both, F.lit("�")).alias("remaining"))


@F.pandas_udf(StringType())
def unaccented(text: pd.Series) -> pd.Series:
    """Compatibility form without combining marks (no built-in has it)."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


# Legal forms and words that carry no identity of an organisation.
LEGAL_FORMS = "ltd limited llc llp lp inc incorporated corp corporation co plc pvt private group holdings company management".split()


def fold_name(name: Column) -> Column:
    """Organisation names for comparison: no accents, lower case, "&" as and, no punctuation, legal forms or other letters."""
    t = F.replace(F.lower(unaccented(name)), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, r"[.,'\"()\-–—/]", " ")
    t = F.regexp_replace(t, rf"\b({'|'.join(LEGAL_FORMS)})\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]+", " "), r"\s+", " "))
