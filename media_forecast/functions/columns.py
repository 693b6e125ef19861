"""Column-level helpers shared by every operator.

All helpers return ``pyspark.sql.Column`` expressions so they stay inside
whole-stage codegen; nothing here runs Python per row.

Numeric policy (kept identical in the SQL oracles):

* money and other fractional measures are summed as ``DECIMAL(28,6)`` so a
  total does not depend on partition or task order, then cast back to double;
* ratios use a safe division where a zero or missing denominator gives 0.0;
* published figures are rounded once, at the output, through a decimal so the
  rounding is HALF_UP on the decimal text of the value (not on its binary
  approximation).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text tokens a CSV reader treats as missing. These are the
# documented defaults of the pandas CSV reader, which the vendor exports were
# written for.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Micros and fractional conversions stay exact: six places, 22 digits before the point.
MONEY = "decimal(28,6)"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact(c) -> Column:
    """A fractional measure as an exact 6-dp decimal (input to exact sums)."""
    return col_of(c).cast(MONEY)


def exact_sum(c) -> Column:
    """Order-independent sum of a double measure; empty/all-null sums to 0.0."""
    return F.coalesce(F.sum(exact(c)).cast("double"), F.lit(0.0))


def exact_sum_nullable(c) -> Column:
    """Like :func:`exact_sum` but keeps SQL null for an all-null input."""
    return F.sum(exact(c)).cast("double")


def safe_ratio(num, den) -> Column:
    """num / den; 0.0 when the denominator is 0 or either side is missing, NaN or not a number."""
    return F.coalesce(F.try_divide(number(num), number(den)), F.lit(0.0))


def number(c) -> Column:
    """A measure as double; text that is no number and NaN become null."""
    return nan_to_null(col_of(c).try_cast("double"))


def out_round(c, digits: int = 2) -> Column:
    """Round a published figure HALF_UP via its decimal value, return double.

    The reference rounds half-to-even on the binary value; both engines used
    here round half-up on the decimal text, which we keep for reproducibility.
    """
    return F.round(col_of(c).cast("decimal(38,6)"), digits).cast("double")


def nan_to_null(c) -> Column:
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clean_text(c) -> Column:
    """Missing-token text → null (CSV inputs read as strings)."""
    c = col_of(c)
    return F.when(F.trim(c).isin(MISSING_TOKENS), F.lit(None).cast("string")).otherwise(c)


def week_start(c) -> Column:
    """Monday of the ISO week containing the date."""
    return F.to_date(F.date_trunc("week", col_of(c)))


# Campaign-type keywords tested against the lower-cased campaign
# name, first match wins; anything else (or a missing name) is "Other".
CAMPAIGN_TYPE_RULES = [
    ("Prospecting", ["prospecting"]),
    ("Retargeting", ["retargeting", "remarketing"]),
    ("DPA", ["dpa"]),
    ("Generic", ["generic"]),
]
CAMPAIGN_TYPE_DEFAULT = "Other"


def campaign_type_from_name(name) -> Column:
    lowered = F.lower(col_of(name))
    expr = None
    for label, words in CAMPAIGN_TYPE_RULES:
        cond = None
        for w in words:
            hit = lowered.contains(w)
            cond = hit if cond is None else (cond | hit)
        cond = F.coalesce(cond, F.lit(False))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(CAMPAIGN_TYPE_DEFAULT))


def shortest_number(x: float) -> str:
    """Shortest text of a number as used in source labels (2.0 → "2", 2.5 → "2.5")."""
    return format(float(x), "g")
