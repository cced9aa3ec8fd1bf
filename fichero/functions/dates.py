"""Date rules. Dates stay text, as in the registry; run time and run day are job parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fichero.functions.text import py_trim

# Spanish month names.
MONTHS = [
    "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO",
    "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE",
]

DAY_MONTH_YEAR = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})$"
DATE_IN_TEXT = r"(?<![0-9/])([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/])"


def resolution_day(c: Column) -> Column:
    """Struct of day, month name and year, or null. The day is not range-checked."""
    text = py_trim(c)
    # only texts of the form reach the casts: a failing cast costs far more than the test
    form = text.rlike(DAY_MONTH_YEAR)
    month = F.when(form, F.regexp_extract(text, DAY_MONTH_YEAR, 2).cast("int"))
    year = F.regexp_extract(text, DAY_MONTH_YEAR, 3)
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.when(
        form & month.between(1, 12),
        F.struct(
            F.regexp_extract(text, DAY_MONTH_YEAR, 1).try_cast("int").cast("string").alias("day"),
            F.get(names, month - 1).alias("month"),
            F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year).alias("year"),
        ),
    )


def issue_date(day: Column) -> Column:
    return F.date_format(day, "dd-MM-yyyy")


def run_stamp(ts: Column) -> Column:
    """UTC time of the run, in seconds, marked with Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def audit_stamp(stamp: Column) -> Column:
    return F.translate(stamp, "T", " ")


def latest_date(c: Column) -> Column:
    """Latest valid ``dd/mm/yyyy`` date named in a text, in the same form; null without any."""
    found = F.regexp_extract_all(c, F.lit(DATE_IN_TEXT), 1)
    latest = F.array_max(F.transform(found, lambda d: F.try_to_date(d, "d/M/yyyy")))
    return F.date_format(latest, "dd/MM/yyyy")
