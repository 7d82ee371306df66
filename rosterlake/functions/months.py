"""Hand-written dates as month numbers (year * 12 + month), in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def month_number(text: Column, first_year: int = 1900, last_year: int = 2100) -> Column:
    """The month a date names; a year alone counts as its June; null where no existing month is named.

    Understood: 2011-04, 2011/4, 2011.04, 2011-04-30, 04/2011, 30/04/2011, Apr 2011, APRIL, 2011, 2011 April, 2011.
    """
    # Each step rewrites one way of writing to year-month; what is left as written names no month.
    steps = [
        (r"^(\d{4}) ?[-/.] ?(\d{1,2})(?: ?[-/.] ?\d{1,2})?(?:[ t].*)?$", "$1-$2"),
        (r"^(?:\d{1,2} ?[-/.] ?)?(\d{1,2}) ?[-/.] ?(\d{4})$", "$2-$1"),
        (rf"^(?:\d{{1,2}}\.? )?({'|'.join(MONTHS)})[a-z]*\.?[ '/-]*(\d{{4}})$", "$2-$1"),
        (rf"^(\d{{4}})[ /-]*({'|'.join(MONTHS)})[a-z]*\.?$", "$1-$2"),
        (r"^(\d{4})$", "$1-6"),
    ]
    t = F.lower(F.trim(F.regexp_replace(text, r"(?U)[\s,]+", " ")))
    for pattern, to in steps:
        t = F.regexp_replace(t, pattern, to)
    # What is written as year-month already, most dates, needs none of the steps.
    t = F.when(text.rlike(r"^\d{4}-\d{2}$"), text).otherwise(t)
    pair = F.when(t.rlike(r"^\d{4}-(\d{1,2}|[a-z]{3})$"), t)

    def number(p: Column) -> Column:
        year, mark = F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.split_part(p, F.lit("-"), F.lit(2))
        by_name = F.floor((F.instr(F.lit("".join(MONTHS)), mark) + 2) / 3).cast("int")
        month = F.when(mark.rlike("^[a-z]"), by_name).otherwise(mark.try_cast("int"))
        return F.when(year.between(first_year, last_year) & month.between(1, 12), year * 12 + month)

    return F.get(F.transform(F.array(pair), number), F.lit(0))
