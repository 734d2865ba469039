"""Salary parsing and normalisation to INR lakh per annum (LPA).

Two distinct readings exist on purpose: the ranker (``parse_salary``) and the
filter's floor check (``floor_mid_lpa``) differ in period matching, defaults
and rupee detection.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the published behaviour) -----------------------
# Currency -> INR conversion factors; unknown currency converts at 1.0.
FX_TO_INR = {"INR": 1.0, "USD": 86.0, "EUR": 92.0, "GBP": 108.0, "SGD": 64.0}
MONTHS_PER_YEAR = 12
HOURS_PER_YEAR = 40 * 52
RUPEES_PER_LAKH = 100_000
# Range and single-value salary mentions in free text (case-insensitive).
RANGE_LPA_PATTERN = (r"(?i)(\d{1,3}(?:\.\d{1,2})?)\s*(?:-|to|–|—)\s*(\d{1,3}(?:\.\d{1,2})?)"
                     r"\s*(?:LPA|lakh|lakhs|lacs|L\.P\.A)")
SINGLE_LPA_PATTERN = r"(?i)(\d{1,3}(?:\.\d{1,2})?)\s*(?:LPA|lakh|lakhs|lacs|L\.P\.A)\b"
# -----------------------------------------------------------------------------


def _fx_map() -> Column:
    return F.create_map(*[x for k, v in FX_TO_INR.items() for x in (F.lit(k), F.lit(v))])


def _blank_to_null(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def fx_rate(currency: Column) -> Column:
    """INR per unit of a currency; 1.0 if it is unknown."""
    return F.coalesce(F.try_element_at(_fx_map(), F.upper(currency)), F.lit(1.0))


def to_lpa(value: Column, currency: Column, period: Column) -> Column:
    """Annualise (exact ``monthly``/``hourly`` words only), convert, round to 2."""
    p = F.lower(period)
    annual = (F.when(p == "monthly", value * MONTHS_PER_YEAR)
              .when(p == "hourly", value * HOURS_PER_YEAR)
              .otherwise(value))
    return F.round(annual * fx_rate(currency) / RUPEES_PER_LAKH, 2)


def midpoint(lo: Column, hi: Column) -> Column:
    return F.coalesce((lo + hi) / 2, lo, hi)


def parse_salary(min_salary: Column, max_salary: Column, currency: Column,
                 period: Column, description: Column) -> Column:
    """Structured fields, else a range mention, else a single mention, else missing.

    Returns ``struct<min_lpa double, max_lpa double, mid_lpa double, currency string,
    source string>``. Zero and NULL amounts count as absent.
    """
    lo_raw = F.when(min_salary != 0, min_salary.cast("double"))
    hi_raw = F.when(max_salary != 0, max_salary.cast("double"))
    cur = F.coalesce(_blank_to_null(F.upper(currency)), F.lit("INR"))
    per = F.coalesce(_blank_to_null(F.lower(period)), F.lit("annual"))
    s_lo, s_hi = to_lpa(lo_raw, cur, per), to_lpa(hi_raw, cur, per)

    desc = F.coalesce(description, F.lit(""))
    has_range = desc.rlike(RANGE_LPA_PATTERN)
    has_single = desc.rlike(SINGLE_LPA_PATTERN)
    r_lo = F.regexp_extract(desc, RANGE_LPA_PATTERN, 1).cast("double")
    r_hi = F.regexp_extract(desc, RANGE_LPA_PATTERN, 2).cast("double")
    r_one = F.regexp_extract(desc, SINGLE_LPA_PATTERN, 1).cast("double")

    structured = lo_raw.isNotNull() | hi_raw.isNotNull()
    lo = (F.when(structured, s_lo).when(has_range, r_lo).when(has_single, r_one))
    hi = (F.when(structured, s_hi).when(has_range, r_hi).when(has_single, r_one))
    source = (F.when(structured, "structured").when(has_range | has_single, "regex")
              .otherwise("missing"))
    out_cur = (F.when(structured, cur).when(has_range | has_single, "INR")
               .otherwise(F.coalesce(F.upper(currency), F.lit(""))))
    return F.struct(lo.alias("min_lpa"), hi.alias("max_lpa"), midpoint(lo, hi).alias("mid_lpa"),
                    out_cur.alias("currency"), source.alias("source"))


def floor_mid_lpa(min_salary: Column, max_salary: Column, currency: Column,
                  period: Column) -> Column:
    """Salary midpoint used by the floor filter: INR only (missing currency = INR),
    period matched by prefix, default yearly, values above 1000 read as rupees."""
    cur = F.upper(F.coalesce(_blank_to_null(currency), F.lit("INR")))
    per = F.lower(F.coalesce(_blank_to_null(period), F.lit("yearly")))

    def one(v: Column) -> Column:
        f = (F.when(per.startswith("month"), v * MONTHS_PER_YEAR)
             .when(per.startswith("hour"), v * HOURS_PER_YEAR).otherwise(v))
        return F.when(f > 1000, f / RUPEES_PER_LAKH).otherwise(f)

    lo, hi = one(min_salary.cast("double")), one(max_salary.cast("double"))
    mean = F.coalesce((lo + hi) / 2, lo, hi)
    return F.when(cur == "INR", mean)
