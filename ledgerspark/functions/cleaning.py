"""Column expressions that clean and check text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted date forms in order of preference with their ISO rewriting, e-mail pattern, checksum weights.
DATE_FORMS = (
    (r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{4})$", "$4-$3-$1"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"),
    (r"^([0-9]{1,2})/([0-9]{1,2})/(69|[7-9][0-9])$", "19$3-$2-$1"),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$", "20$3-$2-$1"),
)
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
CHECKSUM_WEIGHTS = (2, 1, 2, 1, 2, 1, 2, 1, 2)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(c) -> Column:
    """Text with dots for thousands and a decimal comma to double; null where it is not a number."""
    digits = F.replace(F.trim(_col(c)), F.lit("."), F.lit(""))
    return F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")


def comma_number(c) -> Column:
    """Text with a decimal comma only; dots stay."""
    return F.replace(F.trim(_col(c)), F.lit(","), F.lit(".")).try_cast("double")


def clean_date(c) -> Column:
    """Day-first, ISO and compact dates to a date; an unreadable date is null and the row survives.

    The text is rewritten to ISO form and cast. A cast of a bad day gives null at once, while a failing format
    parser raises and catches an exception for every row and format. Two-digit years 69-99 belong to 19xx.
    """
    text = F.trim(_col(c))
    for pattern, iso in DATE_FORMS:
        text = F.regexp_replace(text, pattern, iso)
    return F.regexp_extract(text, ISO_DATE, 0).try_cast("date")


def normal_header(name: str) -> str:
    return name.replace("﻿", "").strip().upper().replace(" ", "_")


def with_normal_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_header(c) for c in df.columns])


def email_valid(c) -> Column:
    return F.coalesce(_col(c).rlike(EMAIL_PATTERN), F.lit(False))


def national_id_valid(c) -> Column:
    """Ten digits, known province, third digit at most 5 and a matching modulo-10 check digit."""
    text = _col(c)
    ten = text.rlike(r"^[0-9]{10}$")
    digit = [F.substring(text, i + 1, 1).try_cast("int") for i in range(10)]
    terms = [F.when(d * w > 9, d * w - 9).otherwise(d * w) for d, w in zip(digit, CHECKSUM_WEIGHTS)]
    province = digit[0] * 10 + digit[1]
    known = province.between(1, 24) | (province == 30)
    check = (F.lit(10) - sum(terms) % 10) % 10
    return F.coalesce(ten & known & (digit[2] <= 5) & (check == digit[9]), F.lit(False))


def ruc_problem(c) -> Column:
    """Reason why a 13-digit tax number is refused, null when it is accepted."""
    text = F.coalesce(_col(c), F.lit(""))
    shape = F.format_string(
        "RUC '%s' inválido: debe contener exactamente 13 dígitos numéricos (tiene %d caracteres).", text, F.length(text)
    )
    ending = F.format_string(
        "RUC '%s' inválido: los tres últimos dígitos deben ser '001' (tiene '%s').", text, F.right(text, F.lit(3))
    )
    return F.when(~text.rlike("^[0-9]{13}$"), shape).when(~text.endswith("001"), ending)


def price_clean(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), "[£$,]", "")).try_cast("double")


def stock_label(c) -> Column:
    text = F.trim(_col(c))
    return F.when(text.contains("In stock"), "In Stock").when(text.contains("Out of stock"), "Out of Stock").otherwise(text)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace ``[name]`` marks by column values."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit(f"[{name}]"), value)
    return text


def file_key(c, size: int = 60) -> Column:
    """Upper-case name usable in a path: letters, digits, underscore and dash."""
    kept = F.regexp_replace(F.upper(_col(c)), r"(?U)[^\w\s-]", "")
    return F.substring(F.regexp_replace(F.trim(kept), r"\s+", "_"), 1, size)


def shortened(c, size: int, mark: str) -> Column:
    text = _col(c)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def full_years(start, ref) -> Column:
    """Completed calendar years, never negative."""
    a, b = _col(start), _col(ref)
    early = (F.month(b) * 100 + F.dayofmonth(b)) < (F.month(a) * 100 + F.dayofmonth(a))
    return F.greatest(F.year(b) - F.year(a) - early.cast("int"), F.lit(0))


def calendar_months(start, ref) -> Column:
    """Difference of calendar months; the day of the month does not count."""
    a, b = _col(start), _col(ref)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def days_apart(a, b) -> Column:
    return F.abs(F.datediff(_col(b), _col(a)))


def month_label(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def quarter_label(c) -> Column:
    return F.concat(F.lit("T"), F.quarter(_col(c)).cast("string"), F.lit(" "), F.year(_col(c)).cast("string"))
