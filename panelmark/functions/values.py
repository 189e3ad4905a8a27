"""Money, quantities, units, dates and boxes as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.functions.text import lookup, may_have, norm_whitespace, text


def found(column: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null (not empty) when there is none."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def number(column: Column) -> Column:
    return column.try_cast("double")


def decimal_comma(column: Column) -> Column:
    """Reads 245,00 as 245.00."""
    return F.regexp_replace(column, ",", ".").try_cast("double")


def thousands_comma(column: Column) -> Column:
    """Reads 1,245 as 1245."""
    return F.regexp_replace(column, ",", "").try_cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``.

    A long chain of alternatives over one expression would otherwise repeat
    that expression in every branch and outgrow the code generator.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _whole(value: Column) -> Column:
    return value.try_cast("decimal(38,0)").cast("string")


def shown_number(value: Column) -> Column:
    """12.0 as ``12``, 12.5 as ``12.5``."""
    return F.when(value % 1 == 0, F.coalesce(_whole(value), value.cast("string"))).otherwise(
        plain_number(value)
    )


def plain_number(value: Column) -> Column:
    """A double as text without an exponent: ``12.0``, ``12345678.5``."""
    tail = F.regexp_replace(value.try_cast("decimal(38,10)").cast("string"), "0+$", "")
    return (
        F.when(F.abs(value) < 1e7, value.cast("string"))
        .when(value % 1 == 0, F.concat(_whole(value), F.lit(".0")))
        .otherwise(F.coalesce(tail, value.cast("string")))
    )


# ----------------------------------------------------------- money, quantity


def money(column: str | Column) -> Column:
    return number(found(norm_whitespace(column), r"([0-9]+(?:\.[0-9]{1,2})?)"))


def money_text(column: str | Column) -> Column:
    cleaned = norm_whitespace(column)

    def shown(value: Column) -> Column:
        return (
            F.when(value.isNull(), cleaned)
            .when(value % 1 == 0, F.concat(F.lit("₹"), _whole(value)))
            .otherwise(F.format_string("₹%.2f", value))
        )

    return F.when(text(column) != "", let(money(column), shown))


def norm_unit(column: str | Column) -> Column:
    key = F.lower(F.trim(text(column)))
    return lookup(C.UNIT_SPELLINGS, key, key)


_AMOUNT = r"([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)"
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def quantity(column: str | Column) -> Column:
    cleaned = norm_whitespace(column)
    return number(F.coalesce(found(cleaned, _AMOUNT, 1), found(cleaned, _NUMBER)))


def quantity_unit(column: str | Column) -> Column:
    cleaned = norm_whitespace(column)
    unit = found(cleaned, _AMOUNT, 2)
    return F.when(unit.isNotNull(), norm_unit(unit)).when(
        found(cleaned, _NUMBER).isNotNull(), F.lit("")
    )


def quantity_text(column: str | Column) -> Column:
    cleaned = norm_whitespace(column)
    value = quantity(column)
    unit = found(cleaned, _AMOUNT, 2)
    return (
        F.when(text(column) == "", F.lit(None))
        .when(unit.isNotNull(), F.concat(shown_number(value), F.lit(" "), norm_unit(unit)))
        .when(value.isNotNull(), plain_number(value))
        .otherwise(cleaned)
    )


def legal_unit(column: str | Column) -> Column:
    return F.lower(F.trim(text(column))).isin(C.LEGAL_UNITS)


# --------------------------------------------------------------------- dates


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """A date from digit texts, null when the calendar has no such day."""
    joined = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return joined.try_cast("date")


def pivot_year(two_digits: Column, pivot: int) -> Column:
    """Two-digit years: below ``pivot`` is 20xx, from it on 19xx."""
    value = two_digits.try_cast("int")
    return (F.when(value < pivot, 2000).otherwise(1900) + value).cast("string")


def month_number(name: Column) -> Column:
    """Month from its three-letter or full English name."""
    table = {n: str(i + 1) for i, n in enumerate(C.MONTHS)}
    table |= {n: str(i + 1) for i, n in enumerate(C.MONTH_NAMES)}
    return lookup(table, F.upper(name), F.lit(None).cast("string"))


def short_month_number(name: Column) -> Column:
    table = {n: str(i + 1) for i, n in enumerate(C.MONTHS)}
    return lookup(table, F.upper(name), F.lit(None).cast("string"))


def label_date(column: str | Column) -> Column:
    """A label's date: whole-text shapes first, then two searches inside it."""
    edges = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
    return let(F.regexp_replace(F.trim(text(column)), edges, ""), lambda v: F.when(v.rlike(_DATE_LIKE), _date_of(v)))


#: every shape of a date fits one of these
_DATE_LIKE = r"[0-9][/\-.][0-9]|^[A-Za-z]+[\s\-/']*[0-9]+$|^[0-9]+[\s\-/]+[A-Za-z]+[\s\-/]+[0-9]+$"


def _date_of(value: Column) -> Column:
    one = F.lit("1")

    def dmy(separator: str, years: str) -> tuple[Column, Column, Column]:
        pattern = rf"^([0-9]{{1,2}}){separator}([0-9]{{1,2}}){separator}([0-9]{{{years}}})$"
        return tuple(found(value, pattern, g) for g in (3, 2, 1))

    def my(separators: str, years: str) -> tuple[Column, Column]:
        pattern = rf"^([0-9]{{1,2}})[{separators}]([0-9]{{{years}}})$"
        return found(value, pattern, 2), found(value, pattern, 1)

    attempts = [iso_date(*dmy(sep, "4")) for sep in ("/", "-", r"\.")]
    ymd = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    attempts.append(iso_date(*(found(value, ymd, g) for g in (1, 2, 3))))
    year, month = my(r"/\-.", "4")
    attempts.append(iso_date(year, month, one))
    for sep in ("/", "-"):
        year, month, day = dmy(sep, "2")
        attempts.append(iso_date(pivot_year(year, 69), month, day))
    year, month = my(r"/\-", "2")
    attempts.append(iso_date(pivot_year(year, 69), month, one))

    word_year = r"^([A-Za-z]{3})(?:\s+|-|/|)([0-9]{4})$"
    attempts.append(iso_date(found(value, word_year, 2), short_month_number(found(value, word_year)), one))
    full_year = r"^([A-Za-z]+)\s+([0-9]{4})$"
    attempts.append(iso_date(found(value, full_year, 2), month_number(found(value, full_year)), one))
    word_short = r"^([A-Za-z]{3})(?:\s+'?|)([0-9]{2})$"
    attempts.append(
        iso_date(pivot_year(found(value, word_short, 2), 69), short_month_number(found(value, word_short)), one)
    )
    for sep in (r"\s+", "-", "/"):
        shape = rf"^([0-9]{{1,2}}){sep}([A-Za-z]{{3}}){sep}([0-9]{{4}})$"
        attempts.append(
            iso_date(found(value, shape, 3), short_month_number(found(value, shape, 2)), found(value, shape))
        )
    inner = r"([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})"
    raw_year = found(value, inner, 3)
    wide_year = F.when(raw_year.try_cast("int") < 100, (raw_year.try_cast("int") + 2000).cast("string"))
    attempts.append(
        iso_date(F.coalesce(wide_year, raw_year), found(value, inner, 2), found(value, inner))
    )
    tail = r"([0-9]{1,2})[/\-.]([0-9]{4})"
    attempts.append(iso_date(found(value, tail, 2), found(value, tail), one))
    return F.coalesce(*attempts)


_RELATIVE = r"(?i)(?:MONTHS?|DAYS?|WEEKS?|YEARS?|BEST\s*BEFORE|MANUFACTURE|PACKAGING)"


def repair_date_text(column: str | Column) -> Column:
    """Slashes that were read as 1, l, I or a bar; relative texts stay."""
    value = F.trim(text(column))
    fixed = F.regexp_replace(value, r"([0-9]{1,2}[/.\-])([0-9]{1,2})[1lI|]([0-9]{2,4})", "$1$2/$3")
    fixed = F.regexp_replace(fixed, r"([0-9]{1,2})[1lI|]([0-9]{1,2}[/.\-][0-9]{2,4})", "$1/$2")
    plain = fixed.rlike(r"^[0-9]{1,2}[.\-][0-9]{1,2}[.\-][0-9]{2,4}$")
    fixed = F.when(plain, F.regexp_replace(fixed, r"[.\-]", "/")).otherwise(fixed)
    return F.when(value.rlike(_RELATIVE), norm_whitespace(value)).otherwise(fixed)


def utc_time(column: str | Column) -> Column:
    """Server time text as UTC: a text without a zone is taken as UTC."""
    value = F.regexp_replace(F.trim(text(column)), "T", " ")
    zoned = value.rlike(r"(Z|[+\-][0-9]{2}(:?[0-9]{2})?)$")
    return F.when(value != "", F.when(zoned, value).otherwise(F.concat(value, F.lit("Z")))).try_cast(
        "timestamp"
    )


# -------------------------------------------------------------- field values


def value_kind(field: Column) -> Column:
    """What a field holds: MONEY, QUANTITY, UNIT, DATE or LICENCE, null for plain text."""
    name = F.lower(field)
    return (
        F.when(may_have(name, ["mrp", "price"]), "MONEY")
        .when(may_have(name, ["quantity", "qty", "weight"]), "QUANTITY")
        .when(name.contains("unit"), "UNIT")
        .when(may_have(name, ["date", "mfg", "exp", "pkd", "use_by", "best_before"]), "DATE")
        .when(may_have(name, ["fssai", "license"]), "LICENCE")
    )


def date_part(kind: Column, cleaned: Column) -> Column:
    """The date of a text with even blanks, null for another kind."""
    return F.when(kind == "DATE", label_date(cleaned))


def normal_text(kind: Column, cleaned: Column, date: Column) -> Column:
    """The normalised form of a text with even blanks; ``date`` is its ``date_part``."""
    digits = F.regexp_replace(cleaned, "[^0-9]", "")
    return (
        F.when(kind == "MONEY", F.coalesce(money_text(cleaned), cleaned))
        .when(kind == "QUANTITY", F.coalesce(quantity_text(cleaned), cleaned))
        .when(kind == "UNIT", norm_unit(cleaned))
        .when(kind == "DATE", F.coalesce(F.date_format(date, "dd/MM/yyyy"), cleaned))
        .when((kind == "LICENCE") & (F.length(digits) == 14), digits)
        .otherwise(cleaned)
    )


def normalised_parts(field: Column, value: Column) -> dict[str, Column]:
    """The five normalised columns of a declaration, chosen by its field name."""
    kind, cleaned = value_kind(field), norm_whitespace(value)
    date = date_part(kind, cleaned)
    missing = value.isNull()
    return {
        "raw_value": F.trim(value),
        "normalized_value": F.when(~missing, normal_text(kind, cleaned, date)),
        "numeric_value": F.when(kind == "MONEY", money(cleaned)).when(kind == "QUANTITY", quantity(cleaned)),
        "unit": F.when(missing, F.lit(None).cast("string"))
        .when(kind == "MONEY", F.lit("INR"))
        .when(kind == "QUANTITY", quantity_unit(cleaned))
        .when(kind == "UNIT", norm_unit(cleaned)),
        "date_value": date,
    }


# --------------------------------------------------------------------- boxes


def polygon_box(points: Column) -> Column:
    """Corner points [[x, y], ...] to an upright box struct."""
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.when(
        F.size(points) >= 2,
        F.struct(
            F.array_min(xs).alias("x1"),
            F.array_min(ys).alias("y1"),
            F.array_max(xs).alias("x2"),
            F.array_max(ys).alias("y2"),
        ),
    )


def flat_box(corners: Column) -> Column:
    """[x1, y1, x2, y2] to a box struct."""
    return F.when(
        F.size(corners) == 4,
        F.struct(*[F.get(corners, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]),
    )


def scaled_confidence(column: str | Column, default: float = C.DEFAULT_CONFIDENCE) -> Column:
    """0-1 scores to 0-100; missing and zero become the default."""
    raw = F.col(column) if isinstance(column, str) else column
    value = F.coalesce(F.nullif(raw.cast("double"), F.lit(0.0)), F.lit(default))
    return F.when((value > 0) & (value <= 1), value * 100).otherwise(value)
