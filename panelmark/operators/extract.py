"""Field extraction: label lines in, declarations out, set-based.

All line patterns of an operator are matched in one projection over the lines
and picked by one ``min_by`` aggregate per package, so a package of any size
is reduced before the shuffle. Spatial and whole-text branches run only on the
packages that the line patterns left without a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.functions import values as vx
from panelmark.functions.text import (
    bad_generic_name, bad_ingredient, fix_glyphs, has_any, indic_digits, is_barcode, may_have, text,
)
from panelmark.operators import tokens as tk
from panelmark.session import cut, spread

# --------------------------------------------------------------------------
# Patterns of printed declarations
# --------------------------------------------------------------------------
_GAP = r"[\s:.\-–—]*"
_MONEY = r"[0-9]+(?:[.,][0-9]{1,2})?"
PRICE_ANCHORED = (
    r"(?i)(?:M\.?\s*R\.?\s*P\.?|MAX(?:\.|\s+)?RETAIL(?:\.|\s+)?PRICE|MAXIMUM\s+RETAIL\s+PRICE|"
    r"RETAIL\s+PRICE|SELLING\s+PRICE|PRICE|M\.R\.P)" + _GAP + r"[A-Z\s()]*" + _GAP
    + r"(?:₹|RS\.?|INR)?\s*(" + _MONEY + r")"
)
PRICE_CURRENCY = r"(?i)(?:₹|RS\.?|INR)\s*(" + _MONEY + r")"
TAX_STATED = (
    r"(?i)(?:INCL(?:USIVE)?\.?\s*(?:OF)?\s*ALL\s*TAX(?:ES)?|ALL\s*TAX(?:ES)?\s*INCL(?:USIVE)?|"
    r"TAX(?:ES)?\s*INCL(?:UDED)?|INCLUDING\s*ALL\s*TAX(?:ES)?)"
)
_UNITS_LONG = (
    r"kg|kgs|kilograms?|g|gm|gms|grams?|mg|milligrams?|l|ltr|litres?|liters?|ml|millilitres?|"
    r"milliliters?|cl|m|cm|mm|sq\.m|sq\.cm|units?|pieces?|pcs|count|pack|n"
)
QUANTITY_ANCHORED = (
    r"(?i)(?:NET\s*(?:QTY|QUANTITY|WT\.?|WEIGHT|CONTENTS?|VOLUME)|SHUDDHA\s+MATRA|NET\s+MASS|QUANTITY|"
    r"TOTAL\s*WEIGHT)" + _GAP + r"([0-9]+(?:\.[0-9]+)?)\s*(" + _UNITS_LONG + r")\b"
)
QUANTITY_BARE = (
    r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(kg|kgs|kilograms?|g|gm|gms|grams?|mg|milligrams?|l|ltr|litres?|liters?|ml|millilitres?|"
    r"milliliters?|cl|m|cm|mm|sq\.m|units?|pieces?|pcs|count|pack|n)\b"
)
MADE_PREFIX = (
    r"(?i)(?:MFD\.?|MFG\.?|DATE\s*OF\s*MFG|MANUFACTURED\s*(?:ON|DATE)?|PKD\.?|PACKED\s*(?:ON|DATE)?|"
    r"PACKAGING\s*DATE|BATCH\s*&\s*MFD|PRODUCED\s*ON|MFG\s*DATE)"
)
EXPIRY_PREFIX = (
    r"(?i)(?:EXP\.?|EXPIRY\s*(?:DATE)?|EXP\.?\s*DATE|USE\s*BY|BEST\s*BEFORE|USE\s*BEFORE|"
    r"VALID\s*(?:UPTO|TILL)|EXPIRATION)"
)
SHELF_LIFE = (
    r"(?i)(?:BEST\s+BEFORE|USE\s+WITHIN|SHELF\s+LIFE\s*(?:OF)?|VALID\s+FOR)\s*([0-9]+)\s*"
    r"(days?|weeks?|months?|years?)\s*"
    r"(?:FROM\s+(?:THE\s+)?(?:DATE\s+OF\s+)?(MFD|MFG|PKD|PACKAGING|MANUFACTURE|PACKED|DATE))?"
)
_DAY, _MON, _YEAR = r"(0?[1-9]|[12][0-9]|3[01])", r"(0?[1-9]|1[0-2])", r"((?:19|20)[0-9]{2})"
_SEP = r"[\s/.\-]"
DATE_SHAPES = [
    ("dmy", r"\b" + _DAY + _SEP + _MON + _SEP + _YEAR + r"\b"),
    ("ymd", r"\b" + _YEAR + _SEP + _MON + _SEP + _DAY + r"\b"),
    ("dby", r"\b" + _DAY + _SEP + r"([a-zA-Z]{3,9})" + _SEP + _YEAR + r"\b"),
    ("by", r"\b([a-zA-Z]{3,9})" + _SEP + _YEAR + r"\b"),
    ("my", r"\b" + _MON + _SEP + _YEAR + r"\b"),
    ("mY", r"\b" + _MON + _SEP + r"([0-9]{2})\b"),
]
TOLL_FREE = r"(?i)\b1800[-\s]?[0-9]{3}[-\s]?[0-9]{4}\b|\b1800[0-9]{6,8}\b"
PHONE = (
    r"(?i)(?:(?:TEL|PHONE|MOBILE|HELPLINE|CALL|CARE|CONTACT|NO\.?)" + _GAP + r")?(?:\+?91[\s\-]?)?"
    r"(?:\(?0[0-9]{2,4}\)?[\s\-]?)?(\b[6-9][0-9]{9}\b|\b[0-9]{3,4}[-\s][0-9]{6,8}\b)"
)
EMAIL = r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
SITE = r"(?i)\b(?:https?://)?(?:www\.)[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?:/[^\s]*)?\b"
ORIGIN = r"(?i)(?:COUNTRY\s*OF\s*ORIGIN|MADE\s*IN|PRODUCT\s*OF)" + _GAP + r"([A-Za-z\s]+)"
UNIT_PRICE = (
    r"(?i)(?:USP|UNIT\s*SALE\s*PRICE|UNIT\s*PRICE)" + _GAP + r"(?:₹|RS\.?|INR)?\s*(" + _MONEY
    + r")\s*(?:/|PER)\s*([0-9]*(?:\.[0-9]+)?\s*(?:g|gm|gms|kg|ml|l|ltr|u|unit|n|m|cm|mm|sq\.m))"
)
MAKER = (
    r"(?i)(?:MFD\.?\s*BY|MANUFACTURED\s*BY|PACKED\s*BY|PKD\.?\s*BY|MARKETED\s*BY|PRODUCED\s*BY)"
    + _GAP + r"([^\n|;]+)"
)
BATCH = r"(?i)(?:BATCH\s*(?:NO\.?|NUMBER)?|LOT\s*(?:NO\.?|NUMBER)?)" + _GAP + r"((?=.*[0-9])[A-Za-z0-9\-_/]{3,})"

# The fault-tolerant set used for the full declaration table
#: characters that may stand between a key and what belongs to it, across lines
PROMO_REACH, PRICE_REACH = 120, 80
_TAX_CLAUSE = r"\(?\s*INCL(?:USIVE)?\.?\s*(?:OF\s*)?ALL\s*TAXES?\.?\s*\)?"
LABEL_PRICE = (
    r"(?i)(?:^|\b|\s)(?:M\s*\.?\s*R\s*\.?\s*P\s*\.?|MAX(?:IMUM)?\s*RETAIL\s*PRICE)\b" + _GAP
    + r"(?:IN\s*)?(?:Rs\.?|₹|INR)?\s*(?:(" + _TAX_CLAUSE + r")\s*)?(?:(?:Rs\.?|₹|INR)[\s:.\-–—]*)?("
    + _MONEY + r")(?:\s*(" + _TAX_CLAUSE + r"))?(?:\s*(?:[-–/|]|USP|UNIT\s*PRICE)?\s*(?:Rs\.?|₹)?\s*("
    + _MONEY + r")\s*(?:/|PER)\s*([a-zA-Z0-9]+))?"
)
_PRICE_KEY = r"(?:M\s*\.?\s*R\s*\.?\s*P\s*\.?|MAX(?:IMUM)?\s*RETAIL\s*PRICE)"
_PRICE_KEY_OPEN = r"(?:M\s*\.?(?:\s*R\s*\.?)?|MAX(?:IMUM)?(?:\s*RETAIL)?)\s*$"
PRICE_ACROSS = r"(?i)" + _PRICE_KEY + r"[\s\S]{0," + str(PRICE_REACH) + r"}?(?:Rs\.?|₹|INR)?\s*(" + _MONEY + r")"
TAX_NEAR = (
    r"(?i)(?:[I1l|]n[cl1]{1,2}(?:usive)?[\s.\-_]*(?:of\s*)?(?:all\s*)?Ta[xa-z]*s?|"
    r"all[\s.\-_]*Ta[xa-z]*s?[\s.\-_]*[I1l|]n[cl1]{1,2}(?:usive)?|"
    r"incl(?:usive)?\s*(?:of\s*)?all\s*tax(?:es)?|inclusive\s*of\s*all\s*taxes|mrp\s*incl)"
)
INLINE_UNIT_PRICE = r"(?i)(?:(?:Rs\.?|₹|INR)\s*)?([0-9]+(?:[.,][0-9]{1,2})?)\s*(?:/|per)\s*([a-zA-Z]+)"
_UNITS_SHORT = r"kg|g|gm|gms|ml|l|ltr|litres?|m|cm|mm|n|nos?|units?|pcs?"
_NET = r"NET\s*(?:WT|WEIGHT|QTY|QUANTITY|CONTENTS?|VOL(?:UME)?)|QUANTITY|SHUDDHA\s+MATRA"
LABEL_QUANTITY = (
    r"(?i)(?:^|\b|\s)(?:NET\s*\.?\s*(?:WT|WEIGHT|QTY|QUANTITY|CONTENTS?|VOL(?:UME)?)|QUANTITY|"
    r"SHUDDHA\s+MATRA)\b[^0-9]*([0-9]+(?:[.,][0-9]+)?)\s*(" + _UNITS_SHORT + r")\b"
)
PROMO_QUANTITY = (
    r"(?i)(?:" + _NET + r")[\s\S]{0," + str(PROMO_REACH) + r"}?(?:=\s*|TOTAL\s*[:\s\-]*)\s*([0-9]+(?:[.,][0-9]+)?)\s*("
    + _UNITS_SHORT + r")\b"
)
BARE_QUANTITY = r"(?i)\b([0-9]+(?:[.,][0-9]+)?)\s*(" + _UNITS_SHORT + r")\b"
_MONTH_WORD = (
    r"(?:JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUN(?:E)?|JUL(?:Y)?|AUG(?:UST)?|"
    r"SEP(?:TEMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)"
)
CALENDAR = (
    r"(?:(?:[0-3]?[0-9][\s.\-/|]+)?" + _MONTH_WORD + r"[a-z]*[\s.\-/|]*(?:20[0-9]{2}|[0-9]{2})|"
    r"[0-9]{1,2}[/.\-|][0-9]{1,2}[/.\-|](?:20[0-9]{2}|[0-9]{2}))"
)
_COUNT_WORD = r"(?:[0-9]+|[A-Za-z0-9]+)"
_SINCE = (
    r"(?:\s*(?:FROM|OF)\s*(?:PACKAGING|PACKING|MFG|MANUFACTURE|"
    r"DATE\s*(?:OF\s*)?(?:PACKAGING|PACKING|MFG|MANUFACTURE)|PURCHASE))?"
)
TYPED_DATE = (
    r"(?i)\b(DATE\s*(?:OF\s*)?(?:PACKAGING|PACKING|MFG)|PACKAGING\s*DATE|PACKING\s*DATE|MFD|MFG|PACKED|"
    r"PKD|EXP(?:IRY)?|USE\s*BY|BEST\s*BEFORE)\b" + _GAP + r"(" + CALENDAR + r"|(?:\b" + _COUNT_WORD
    + r"\s+)?(?:MONTHS?|DAYS?|YEARS?|WEEKS?)" + _SINCE + r")"
)
RELATIVE_DATE = (
    r"(?i)\b((?:BEST\s*BEFORE[\s:.\-–—]*)?(?:\b" + _COUNT_WORD
    + r"\s+)?(?:MONTHS?|DAYS?|YEARS?|WEEKS?)" + _SINCE + r")"
)
MADE_TYPES = ["MFD", "MFG", "PKD", "PACKED", "DATE OF PACKAGING", "PACKAGING DATE", "PACKING DATE", "DATE OF MFG"]
EXPIRY_TYPES = ["EXP", "EXPIRY", "USE BY", "BEST BEFORE"]
MADE_KEY = r"\b(?:DATE\s*(?:OF\s*)?(?:PACKAGING|PACKING|MFG)|PACKAGING\s*DATE|PACKING\s*DATE|PKD|PACKED|MFD|MFG)"
EXPIRY_KEY = r"(?:USE\s*BY|EXP(?:IRY)?|BEST\s*BEFORE)"
LABEL_BATCH = (
    r"(?i)\b(?:BATCH\s*(?:NO\.?|NUM(?:BER)?|CODE)?|LOT\s*(?:NO\.?|NUM(?:BER)?)?|B\.?\s*NO\.?)\b" + _GAP
    + r"((?![0-9]+\s*(?:g|gm|kg|ml|l|m|cm|mm|oz)\b)(?=.*[A-Za-z\-])[A-Za-z0-9\-/]{3,})"
)
BATCH_KEY = r"(?:BATCH|LOT)(?:\s*NO\.?|\s*NUM)?|B\.?\s*NO\.?"
BATCH_VALUE = r"(?!^[0-9]+\s*(?:g|gm|kg|ml|l|m|cm|mm)$)(?=.*[0-9])[A-Za-z0-9\-/]{3,}"
BATCH_NOISE = r"(?i)(?:BEST|BEFORE|BEBE|EXPORT|QUALITY|NET|WEIGHT|PACKED|MFG|INGREDIENT)"
CARE = (
    r"(?i)(1800[-\s]?[0-9]{3}[-\s]?[0-9]{4}|1800[0-9]{6,8}|(?:\+?91[\s\-]?)?[6-9][0-9]{9}|"
    r"\(0[0-9]{2,4}\)\s*[0-9]{6,8}|\b0[0-9]{2,4}[-\s][0-9]{6,8}\b|(?:\+?91[\s\-]?)?[0-9]{3,4}[-\s][0-9]{6,8})|"
    r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})|(www\.[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
)
LICENCE = (
    r"(?i)(?:^|\b|\s)(?:(?:FSSAI|FSSAL|FSSAT|FSSA1|FSSAR|ISSAI)\s*(?:LIC(?:ENSE)?|REG(?:ISTRATION)?|NO\.?|NUM)?|"
    r"L[icI1l|]{1,3}\.?\s*(?:[Jj]?[Nn]|[Jj])[oO0]?\.?|LIC(?:ENSE)?\s*(?:NO\.?|NUM)?)\b" + _GAP + r"(\b[0-9]{14}\b)"
)
LICENCE_LOGO = r"(?i)\b(?:fssai|fssat|fssal|fssaii|fssa1|fssar|issai)\b"
LICENCE_SPACED = r"(?i)L[icI1l|]{1,3}\.?\s*(?:[Jj]?[Nn]|[Jj])[oO0]?\.?[\s:.\-–—]*([0-9\s]{10,18})"
LABEL_ORIGIN = r"(?i)\b(?:COUNTRY\s*OF\s*ORIGIN|MADE\s*IN|PRODUCT\s*OF)\b" + _GAP + r"([A-Za-z\s]+)"
MAKER_ANCHOR = (
    r"(?i)(?:MFD\.?\s*BY|M[anr]{0,2}u[tf]act[a-z]*\s*BY|[a-z]*t?c?t?red\s*BY|PACKED\s*BY|MKTD\.?\s*BY|MARKETED\s*BY)"
)
INGREDIENTS = r"(?i)\b(?:INGREDIENTS?|CONTAINS?|SAMAGRI|GHATAK|COMPOSITION)\b" + _GAP + r"([^\n\r]+)"
INGREDIENT_STOP = (
    r"(?i)(?:BEST|BEFORE|BEBE|EXPORT|QUALITY|NET|WEIGHT|PACKED|MFG|B\.NO|BATCH|LOT|FSSAI|MRP|PRICE|TAX|KEEP|"
    r"STORE|GENERIC|NAME)"
)
GENERIC_NAME = r"(?i)(?:GENERIC\s*NAME|NAME\s*OF\s*COMMODITY|COMMODITY|PRODUCT\s*NAME)[:\s.\-]*([^\n]+)"
COMMODITY_WORDS = (
    r"(?i)\b(?:MASALA|GARAM\s*MASALA|POWDER|CHILLI|TURMERIC|SPICE|ATTA|OIL|SALT|TEA|COFFEE|RICE|FLOUR|SUGAR|"
    r"BISCUIT|MILK|GHEE)\b"
)
# Single-line price reader
LINE_PRICE_ANCHOR = (
    r"(?i)(?:M\s*\.?\s*R\s*\.?\s*P\s*\.?|MAX(?:IMUM)?\s*RETAIL\s*PRICE|MAX\.\s*RETAIL\s*PRICE|MRPinINR|"
    r"MRP\s*in\s*INR)"
)
LINE_PRICE_CURRENCY = r"(?i)(?:Rs\.?|₹|INR|\bMRP\b)\s*[:\s\-]*[0-9]+(?:\.[0-9]{1,2})?"
LINE_TAX = (
    r"(?i)(?:[I1l|]n[cl1]{1,2}[a-z]*[\s.\-_]*(?:of\s*)?(?:all\s*)?Ta[xa-z]*[s.]?|Inclusie|Taes|"
    r"incl(?:usive|usie|usve)?\s*(?:of\s*)?(?:all\s*)?tax(?:es|s|e)?|inclusive\s*of\s*all\s*taxes|"
    r"all[\s.\-_]*Ta[xa-z]*s?[\s.\-_]*[I1l|]n[cl1]{1,2}(?:usive)?|mrp\s*incl|Iscly|Inci|MRPinINR|"
    r"MRP\s*in\s*INR|tax(?:es|s)?)"
)

_BOX = ["x1", "y1", "x2", "y2"]


def readable(tokens: DataFrame) -> DataFrame:
    """Digits of other scripts in ``text`` as 0-9, one for one; ``raw_line`` keeps the text as it was."""
    return tokens.withColumns({"raw_line": F.col("text"), "text": indic_digits("text")})


def _first(condition: Column, *columns: Column) -> Column:
    """Struct of the columns on the first line that meets the condition."""
    return F.min_by(F.struct(*columns), F.when(condition, F.col("line_no")))


def _told(condition: Column, *columns: Column) -> Column:
    """Struct of the columns where the line meets the condition, else null."""
    return F.when(condition, F.struct(*columns))


def _picks(told: dict[str, Column], last: tuple[str, ...] = ()) -> list[Column]:
    """What the first line tells, for each name; the last line for those in ``last``."""
    return [(F.max_by if n in last else F.min_by)(c, F.when(c.isNotNull(), F.col("line_no"))).alias(n) for n, c in told.items()]


def _hit(pattern: str, group: int = 1) -> Column:
    return vx.found(text("text"), pattern, group)


def _may(*words: str) -> Column:
    """True where the line holds any of the words, in capitals or not (a few letters more count as equal)."""
    return may_have(F.upper(text("text")), list(words))


def confident_lines(tokens: DataFrame, least: float = C.LINE_MIN_CONFIDENCE) -> DataFrame:
    """Drops unreliable lines; scores may be 0-1 or 0-100, missing counts as 1."""
    score = F.coalesce("confidence", F.lit(1.0))
    return tokens.where(F.when(score > 1, score / 100.0).otherwise(score) >= least)


# ------------------------------------------------------- first match per line


def extract_mrp(tokens: DataFrame) -> DataFrame:
    """Anchored price, else the first amount with a currency sign."""
    lines = tokens.select(
        "inspection_id", "line_no", *_BOX,
        vx.thousands_comma(_hit(PRICE_ANCHORED)).alias("_price"),
        vx.thousands_comma(_hit(PRICE_CURRENCY)).alias("_loose"),
        text("text").rlike(TAX_STATED).alias("_taxed"),
        F.lower(text("text")).contains("all taxes").alias("_all_taxes"),
    )
    price, loose, taxed = F.col("_price"), F.col("_loose"), F.col("_taxed")
    stated = taxed | F.col("_all_taxes")
    box = [F.col(c) for c in _BOX]
    picked = lines.groupBy("inspection_id").agg(
        _first(price.isNotNull(), price.alias("price"), stated.alias("tax_stated"), F.col("line_no"), *box).alias("a"),
        _first(loose.isNotNull(), loose.alias("price"), taxed.alias("tax_stated"), F.col("line_no"), *box).alias("b"),
    )
    return picked.select("inspection_id", F.coalesce("a", "b").alias("m")).where("m IS NOT NULL").select(
        "inspection_id", "m.*"
    )


def with_units(df: DataFrame, value: str, unit: str, units: DataFrame) -> DataFrame:
    """Canonical unit and base value; unknown units stand for themselves."""
    key = F.lower(F.trim(text(unit)))
    joined = df.join(units, key == F.col("spelling"), "left")
    return joined.withColumns(
        {
            "shown_unit": F.coalesce("shown_unit", key),
            "base_unit": F.coalesce("base_unit", key),
            "base_value": F.coalesce(F.round(F.col(value) * F.col("multiplier"), 4), F.col(value)),
        }
    ).drop("spelling", "multiplier")


# an amount of months on a line about dates is a duration
_MONTHS, _DATED = ("m", "month", "months"), "best|before|pkd"


def _bare_quantity() -> Column:
    unit = F.lower(_hit(QUANTITY_BARE, 2))
    duration = F.coalesce(unit.isin(*_MONTHS), F.lit(False)) & F.lower(text("text")).rlike(_DATED)
    return _hit(QUANTITY_BARE, 1).isNotNull() & ~duration


def extract_net_quantity(tokens: DataFrame, units: DataFrame) -> DataFrame:
    lines = tokens.select(
        "inspection_id", "line_no",
        _hit(QUANTITY_ANCHORED, 1).alias("_amount"), F.lower(_hit(QUANTITY_ANCHORED, 2)).alias("_unit"),
        _hit(QUANTITY_BARE, 1).alias("_loose"), F.lower(_hit(QUANTITY_BARE, 2)).alias("_loose_unit"),
        F.lower(text("text")).rlike(_DATED).alias("_dated"),
    )
    amount, unit, loose, loose_unit = (F.col(c) for c in ("_amount", "_unit", "_loose", "_loose_unit"))
    duration = loose_unit.isin(*_MONTHS) & F.col("_dated")
    picked = lines.groupBy("inspection_id").agg(
        _first(amount.isNotNull(), vx.number(amount).alias("quantity"), unit.alias("unit"), F.col("line_no")).alias("a"),
        _first(
            loose.isNotNull() & ~duration,
            vx.number(loose).alias("quantity"), loose_unit.alias("unit"), F.col("line_no"),
        ).alias("b"),
    )
    rows = picked.select("inspection_id", F.coalesce("a", "b").alias("m")).where("m IS NOT NULL").select(
        "inspection_id", "m.*"
    )
    return with_units(rows, "quantity", "unit", units)


def _month_of(name: Column) -> Column:
    return F.coalesce(vx.short_month_number(F.substring(name, 1, 3)), F.lit("1"))


def line_date(column: Column) -> Column:
    """First date shape found on the line, as ``yyyy-MM-dd`` or ``yyyy-MM`` text."""

    def attempts(value: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return vx.found(value, pattern, group)

        def two(digits: Column) -> Column:
            return F.lpad(digits, 2, "0")

        shapes = dict(DATE_SHAPES)
        dmy, ymd, dby, by, my, short = (shapes[k] for k in ("dmy", "ymd", "dby", "by", "my", "mY"))
        dash = F.lit("-")
        return F.coalesce(
            F.concat(part(dmy, 3), dash, two(part(dmy, 2)), dash, two(part(dmy, 1))),
            F.concat(part(ymd, 1), dash, two(part(ymd, 2)), dash, two(part(ymd, 3))),
            F.concat(part(dby, 3), dash, two(_month_of(part(dby, 2))), dash, two(part(dby, 1))),
            F.concat(part(by, 2), dash, two(_month_of(part(by, 1)))),
            F.concat(part(my, 2), dash, two(part(my, 1))),
            F.concat(vx.pivot_year(part(short, 2), 70), dash, two(part(short, 1))),
        )

    return vx.let(column, attempts)


def extract_dates(tokens: DataFrame) -> DataFrame:
    """Manufacturing and expiry date of each package.

    Reads like a scan from the top: a line with a making prefix sets the first,
    a line with an expiry prefix (or a shelf life) the second, and a date
    without a prefix the first only while neither is known. Two aggregates
    instead of the scan: the first settles the manufacturing line, the second
    may then use it.
    """
    lines = tokens.select(
        "inspection_id",
        "line_no",
        line_date(text("text")).alias("iso"),
        text("text").rlike(MADE_PREFIX).alias("made"),
        text("text").rlike(EXPIRY_PREFIX).alias("expires"),
        _hit(SHELF_LIFE, 0).alias("life"),
        F.concat_ws(
            " ", _hit(SHELF_LIFE, 1), F.lower(_hit(SHELF_LIFE, 2)), F.lit("from"),
            F.coalesce(_hit(SHELF_LIFE, 3), F.lit("MFD")),
        ).alias("statement"),
    ).where("iso IS NOT NULL OR life IS NOT NULL")
    dated = F.col("iso").isNotNull()
    relative = F.col("expires") & F.col("life").isNotNull()
    no = F.col("line_no")
    facts = lines.groupBy("inspection_id").agg(
        F.min(F.when(F.col("made") & dated, no)).alias("made_line"),
        F.min(F.when(~F.col("made") & ~F.col("expires") & dated, no)).alias("plain_line"),
        F.min(F.when(relative | (F.col("expires") & dated & ~F.col("made")), no)).alias("expiry_line"),
    )
    big = F.lit(2**31 - 1)
    plain_first = (F.col("plain_line") < F.coalesce("made_line", big)) & (
        F.col("plain_line") < F.coalesce("expiry_line", big)
    )
    facts = facts.select(
        "inspection_id",
        F.when(plain_first, F.col("plain_line")).otherwise(F.col("made_line")).alias("made_at"),
    )
    joined = lines.join(spread(facts), "inspection_id")
    expiry = relative | (
        F.col("expires") & dated & (~F.col("made") | (F.col("line_no") > F.coalesce("made_at", big)))
    )
    picked = joined.groupBy("inspection_id").agg(
        F.max(F.when(F.col("line_no") == F.col("made_at"), F.col("iso"))).alias("manufacturing_date"),
        F.min_by(
            F.struct(F.when(~relative, F.col("iso")).alias("iso"), F.when(relative, F.col("statement")).alias("said")),
            F.when(expiry, no),
        ).alias("e"),
    )
    return picked.select(
        "inspection_id", "manufacturing_date", F.col("e.iso").alias("expiry_date"),
        F.col("e.said").alias("shelf_life"),
    ).where("manufacturing_date IS NOT NULL OR expiry_date IS NOT NULL OR shelf_life IS NOT NULL")


def extract_relative_expiry(tokens: DataFrame) -> DataFrame:
    hit = text("text").rlike(EXPIRY_PREFIX) & _hit(SHELF_LIFE, 1).isNotNull()
    picked = tokens.groupBy("inspection_id").agg(
        _first(
            hit,
            _hit(SHELF_LIFE, 1).try_cast("int").alias("amount"),
            F.lower(_hit(SHELF_LIFE, 2)).alias("unit"),
            F.upper(F.coalesce(_hit(SHELF_LIFE, 3), F.lit("MFD"))).alias("event"),
        ).alias("m")
    )
    return picked.where("m IS NOT NULL").select("inspection_id", "m.*")


def contact_hits(tokens: DataFrame) -> DataFrame:
    """Every contact on every line, with its place in reading order."""

    def hits(kind: str, rank: int, pattern: str, group: int) -> Column:
        found = F.regexp_extract_all(text("text"), F.lit(pattern), F.lit(group))
        return F.transform(
            found,
            lambda v, i: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("place"), v.alias("value")),
        )

    every = F.concat(
        hits("toll_free", 0, TOLL_FREE, 0), hits("phone", 1, PHONE, 1), hits("email", 2, EMAIL, 0),
        hits("site", 3, SITE, 0),
    )
    rows = tokens.select("inspection_id", "line_no", F.explode(every).alias("c")).select(
        "inspection_id", "line_no", "c.*"
    )
    digits = F.regexp_replace("value", "[^0-9]", "")
    is_phone = F.col("kind").isin("toll_free", "phone")
    rows = rows.withColumn("key", F.when(is_phone, digits).otherwise(F.lower("value")))
    return rows.where((F.col("kind") != "phone") | F.length("key").between(8, 12))


def extract_contacts(tokens: DataFrame) -> DataFrame:
    """First mention of each number, e-mail and site; numbers by their digits."""
    family = F.when(F.col("kind").isin("toll_free", "phone"), "number").otherwise(F.col("kind"))
    first = F.struct("line_no", "rank", "place")
    return contact_hits(tokens).groupBy("inspection_id", family.alias("family"), "key").agg(
        F.min_by(F.struct("kind", "value", "line_no", "rank", "place"), first).alias("c")
    ).select(
        "inspection_id",
        F.when((F.col("c.kind") == "phone") & F.col("key").startswith("1800"), "toll_free")
        .otherwise(F.col("c.kind")).alias("kind"),
        F.when(F.col("c.kind") == "email", F.lower("c.value")).otherwise(F.col("c.value")).alias("value"),
        "key", "c.line_no", "c.rank", "c.place",
    )


def customer_care(tokens: DataFrame) -> DataFrame:
    """Distinct phones and e-mails, the first site and the primary contact."""
    contacts = extract_contacts(tokens)
    order = F.struct("line_no", "rank", "place", "value")

    def listed(kinds: list[str]) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col("kind").isin(kinds), order)))
        return F.array_join(F.transform(items, lambda i: i["value"]), ", ")

    def lead(kinds: list[str]) -> Column:
        return F.min_by("value", F.when(F.col("kind").isin(kinds), order))

    phones = ["toll_free", "phone"]
    return contacts.groupBy("inspection_id").agg(
        listed(phones).alias("phones"),
        listed(["email"]).alias("emails"),
        lead(["site"]).alias("site"),
        F.coalesce(lead(phones), lead(["email"]), lead(["site"])).alias("primary_contact"),
    )


#: fourteen digits, whatever blanks, dots and hyphens stand between them
_FOURTEEN = r"(?:[0-9][\s.\-]*+){14}"


def _licence_hits() -> dict[str, Column]:
    value = text("text")
    may = value.rlike(_FOURTEEN)
    squeezed = F.regexp_replace(value, r"[\s.\-]", "")
    spaced = F.regexp_replace(text(_hit(LICENCE_SPACED)), "[^0-9]", "")
    return {
        "_l_anchored": F.when(may, _hit(LICENCE)),
        "_l_bare": F.when(may, F.coalesce(
            vx.found(squeezed, r"\b([12][0-9]{13})\b"), vx.found(value, r"\b([12][0-9]{13})\b")
        )),
        "_l_spaced": F.when(may, F.when(F.length(spaced) == 14, spaced)),
        "_l_logo": _may("SSA") & value.rlike(LICENCE_LOGO),
    }


def _licence_told() -> dict[str, Column]:
    """Anchored licence (the last one counts), bare one, spaced one, logo."""
    rest = [F.col("confidence"), F.col("line_no"), *[F.col(c) for c in _BOX]]
    anchored, bare, spaced = (F.col(c) for c in ("_l_anchored", "_l_bare", "_l_spaced"))
    return {
        "l_a": _told(anchored.isNotNull(), anchored.alias("licence"), *rest),
        "l_b": _told(bare.isNotNull(), bare.alias("licence"), *rest),
        "l_c": _told(spaced.isNotNull(), spaced.alias("licence"), *rest),
        "l_d": _told(F.col("_l_logo"), F.lit(None).cast("string").alias("licence"), *rest),
    }


_LAST = ("l_a",)


def _licence_rows_of(picked: DataFrame) -> DataFrame:
    chosen = F.coalesce("l_a", "l_b", "l_c", "l_d")
    logo = F.col("l_a").isNotNull() | F.col("l_d").isNotNull()
    return picked.select("inspection_id", chosen.alias("m"), logo.alias("logo")).where("m IS NOT NULL").select(
        "inspection_id", "m.*", "logo")


def extract_licence(tokens: DataFrame) -> DataFrame:
    hits = tokens.withColumns(_licence_hits())
    return _licence_rows_of(hits.groupBy("inspection_id").agg(*_picks(_licence_told(), _LAST)))


def extract_origin(tokens: DataFrame) -> DataFrame:
    country = F.expr("trim(BOTH ' .:-' FROM c)")
    picked = tokens.withColumn("c", _hit(ORIGIN)).groupBy("inspection_id").agg(
        _first(F.col("c").isNotNull(), F.col("c"), F.col("line_no")).alias("m")
    )
    return picked.where("m IS NOT NULL").select("inspection_id", "m.*").select(
        "inspection_id", country.alias("country"), F.lower("c").contains("india").alias("is_home"), "line_no"
    )


def extract_unit_price(tokens: DataFrame) -> DataFrame:
    price = vx.thousands_comma(_hit(UNIT_PRICE))
    return _simple(tokens, price.isNotNull(), price.alias("unit_price"), F.trim(_hit(UNIT_PRICE, 2)).alias("per"))


def _simple(tokens: DataFrame, condition: Column, *columns: Column) -> DataFrame:
    picked = tokens.groupBy("inspection_id").agg(_first(condition, *columns, F.col("line_no")).alias("m"))
    return picked.where("m IS NOT NULL").select("inspection_id", "m.*")


def extract_maker(tokens: DataFrame) -> DataFrame:
    return _simple(tokens, _hit(MAKER).isNotNull(), F.trim(_hit(MAKER)).alias("maker"))


def extract_batch(tokens: DataFrame) -> DataFrame:
    """Batch code: at least one letter or dash, never a weight or a barcode."""
    code = F.trim(_hit(LABEL_BATCH))
    return _simple(tokens, code.isNotNull() & ~is_barcode(code), code.alias("batch"), F.col("confidence"))


def extraction_summary(tokens: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Which of the five core fields were found, and whether that is enough (``units`` has no part in that).

    One pass: whether a reader finds its field follows from flags of the lines
    and, for dates, from the first and last lines of their kinds. A line with
    both prefixes gives an expiry date only below the manufacturing date.
    """
    value, no = text("text"), F.col("line_no")
    phone = F.exists(
        F.regexp_extract_all(value, F.lit(PHONE), F.lit(1)),
        lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 12))
    marks = tokens.select(
        "inspection_id", "line_no",
        (vx.thousands_comma(_hit(PRICE_ANCHORED)).isNotNull() | vx.thousands_comma(_hit(PRICE_CURRENCY)).isNotNull()).alias("price"),
        (_hit(QUANTITY_ANCHORED, 1).isNotNull() | _bare_quantity()).alias("amount"),
        (value.rlike(TOLL_FREE) | value.rlike(EMAIL) | value.rlike(SITE) | phone).alias("care"),
        line_date(value).isNotNull().alias("dated"), value.rlike(MADE_PREFIX).alias("made"), value.rlike(EXPIRY_PREFIX).alias("expires"),
        _hit(SHELF_LIFE, 0).isNotNull().alias("life"),
    )
    ends = F.col("expires") & (F.col("life") | (F.col("dated") & ~F.col("made")))

    def any_line(name: str) -> Column:
        return F.coalesce(F.max(name), F.lit(False))

    seen = marks.groupBy("inspection_id").agg(
        any_line("price").alias("mrp"), any_line("amount").alias("net_quantity"), any_line("care").alias("customer_care"),
        F.min(F.when(F.expr("made AND dated"), no)).alias("_made"),
        F.min(F.when(F.expr("NOT made AND NOT expires AND dated"), no)).alias("_plain"),
        F.min(F.when(ends, no)).alias("_ends"),
        F.max(F.when(F.expr("made AND expires AND dated"), no)).alias("_both"),
    )
    big = F.lit(2**31 - 1)
    plain_first = (F.col("_plain") < F.coalesce("_made", big)) & (F.col("_plain") < F.coalesce("_ends", big))
    made_at = F.when(plain_first, F.col("_plain")).otherwise(F.col("_made"))
    result = seen.withColumns({
        "manufacturing_date": made_at.isNotNull(),
        "expiry_date": F.col("_ends").isNotNull() | F.coalesce(F.col("_both") > made_at, F.lit(False)),
    })
    missing = F.array_compact(F.array(*[F.when(~F.col(f), F.lit(f)) for f in C.CHECKLIST_FIELDS]))
    return result.select(
        "inspection_id",
        (F.lit(len(C.CHECKLIST_FIELDS)) - F.size(missing)).alias("found"),
        F.array_join(missing, ",").alias("missing"),
        (F.size(missing) <= 1).alias("ok"),
    )


# ------------------------------------------------------------ one-line readers


def _line_price_of(value: Column) -> Column:
    exact = vx.number(vx.found(value, r"\b([0-9]{1,5}\.[0-9]{1,2})\b"))
    loose = vx.thousands_comma(vx.found(value, r"(?i)(?:Rs\.?|₹|INR|:)?\s*([0-9,]+(?:[.,][0-9]{1,2})?)"))
    return F.coalesce(F.when(exact.between(0.5, 50000), exact), F.when(loose.between(0.5, 50000), loose))


def line_price(tokens: DataFrame) -> DataFrame:
    """Price and tax verdict of each price line."""
    value = text("text")
    is_price = value.rlike(LINE_PRICE_ANCHOR) | value.rlike(LINE_PRICE_CURRENCY)
    unclear = F.col("confidence") < C.EXTRACTION_MIN_CONFIDENCE
    price = vx.let(value, lambda v: _line_price_of(v))
    taxed = value.rlike(LINE_TAX)
    verdict = (
        F.when(unclear | F.col("price").isNull(), "CANNOT_VERIFY")
        .when(F.col("tax_stated"), "CONFORMING")
        .otherwise("VIOLATION")
    )
    return (
        tokens.where((value != "") & (unclear | is_price))
        .withColumn("price", F.when(~unclear, price))
        .withColumn("tax_stated", ~unclear & F.col("price").isNotNull() & taxed)
        .withColumn("verdict", verdict)
    )


def line_dates(tokens: DataFrame) -> DataFrame:
    """First and second date of a line, assigned by its keywords."""
    slashed = F.translate(text("text"), ".-", "//")
    dates = F.transform(
        F.regexp_extract_all(slashed, F.lit(r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\b"), F.lit(1)), fix_glyphs
    )
    lowered = F.lower(slashed)
    made = F.when(lowered.rlike("mfg|pkd|mfd"), F.get(dates, F.lit(0)))
    last = F.when(F.size(dates) == 1, F.get(dates, F.lit(0))).otherwise(F.get(dates, F.lit(1)))
    expiry = F.when(lowered.rlike("exp|use by|best before"), last)
    return tokens.withColumn("mfg", made).withColumn("exp", expiry)


def route_by_region(tokens: DataFrame) -> DataFrame:
    """Licence, price and dates from the lines of their region, else any line.

    A region line and a plain line count alike once read; what decides is the
    order of the lines, because each extractor also runs on every line.
    """
    priced = line_price(tokens).where("price IS NOT NULL")
    from panelmark.functions.text import licence_14

    licence = licence_14("text")
    base = line_dates(tokens).withColumn("licence", licence)
    picked = base.groupBy("inspection_id").agg(
        F.min_by("licence", F.when(F.col("licence").isNotNull(), F.col("line_no"))).alias("licence"),
        F.min_by("mfg", F.when(F.col("mfg").isNotNull(), F.col("line_no"))).alias("mfg"),
        F.min_by("exp", F.when(F.col("exp").isNotNull(), F.col("line_no"))).alias("exp"),
        F.max(text("text").rlike(LINE_TAX)).alias("any_tax"),
    )
    price = priced.groupBy("inspection_id").agg(
        F.min_by(F.struct("price", "verdict", "confidence"), "line_no").alias("p")
    )
    return picked.join(spread(price), "inspection_id", "left").select(
        "inspection_id", "licence", "mfg", "exp", "p.price", "p.verdict", "any_tax"
    )


def global_tax_override(prices: DataFrame, tokens: DataFrame) -> DataFrame:
    """Any tax phrase in the package makes its price verdict conforming."""
    taxed = tokens.groupBy("inspection_id").agg(F.max(text("text").rlike(LINE_TAX)).alias("_any"))
    joined = prices.join(spread(taxed), "inspection_id", "left")
    return joined.withColumn(
        "verdict",
        F.when(F.coalesce("_any", F.lit(False)) & F.col("price").isNotNull(), "CONFORMING").otherwise(F.col("verdict")),
    ).drop("_any")


# -------------------------------------------------------------- typed dates


#: every typed date holds one of these, and one that is no calendar date one of the spans
_SPANS = ["MONTH", "DAY", "WEEK", "YEAR"]
_DATE_KEYS = ["PACK", "MFD", "MFG", "PKD", "EXP", "USE", "BEST"]
_DATE_WORD = r"(?i)MONTH|DAY|WEEK|YEAR|PACKAGING|PACKING|MFD|MFG|PACKED|PKD|EXP|USE\s*BY|BEST\s*BEFORE"


def line_typed_dates() -> Column:
    """Typed dates of one line as an array of (stage, place, type, date_text), null on a line without any of their words.

    Relative statements have stage 0, anchored dates stage 1. A making date
    is dropped when it is a duration or follows a best-before phrase.
    """
    value = text("text")
    lasts = r"(?i)(?:MONTHS?|DAYS?|WEEKS?|YEARS?)"

    def item(stage: int, place: Column, kind: Column, raw: Column) -> Column:
        return F.struct(
            F.lit(stage).alias("stage"), place.alias("place"), kind.alias("type"),
            vx.let(raw, vx.repair_date_text).alias("date_text"),
        )

    none = F.array().cast("array<struct<stage: int, place: int, type: string, date_text: string>>")
    span = _may(*_SPANS)
    relative = F.transform(
        F.filter(
            F.transform(F.regexp_extract_all(value, F.lit(RELATIVE_DATE), F.lit(1)), lambda v: F.trim(v)),
            lambda v: v.rlike(lasts) & (F.length(v) >= 4),
        ),
        lambda v, i: item(0, i, F.lit("BEST BEFORE"), v),
    )
    kinds = F.regexp_extract_all(value, F.lit(TYPED_DATE), F.lit(1))
    texts = F.regexp_extract_all(value, F.lit(TYPED_DATE), F.lit(2))
    whole = F.regexp_extract_all(value, F.lit(TYPED_DATE), F.lit(0))
    between = F.split(value, TYPED_DATE, -1)

    def before(i: Column) -> Column:
        return F.array_join(
            F.transform(
                F.slice(between, 1, i + 1),
                lambda b, j: F.concat(b, F.when(j < i, text(F.get(whole, j))).otherwise("")),
            ),
            "",
        )

    def acceptable(v: Column, i: Column) -> Column:
        making = F.upper(F.get(kinds, i)).rlike("PACKAGING|PACKING|MFG|MFD")
        return ~(making & (v.rlike(lasts) | before(i).rlike(r"(?i)(?:BEST\s*BEFORE|MONTHS?\s*FROM)")))

    anchored = F.filter(
        F.transform(
            texts,
            lambda v, i: F.when(acceptable(v, i), item(1, i, F.upper(F.get(kinds, i)), F.trim(v))),
        ),
        lambda d: d.isNotNull(),
    )
    # what neither has a span nor a digit is no date, whatever its key
    keyed = _may(*_DATE_KEYS) & (span | value.rlike("[0-9]"))
    found = F.concat(F.when(span, relative).otherwise(none), F.when(keyed, anchored).otherwise(none))
    return F.when((span | _may(*_DATE_KEYS)) & value.rlike(_DATE_WORD), found)


def typed_dates(tokens: DataFrame) -> DataFrame:
    """All typed dates of a package.

    Per type a text that contains, or is contained in, an earlier one is
    dropped. Equal texts are reduced by an aggregate first; the fold then sees
    distinct date texts of one type only.
    """
    rows = readable(tokens).select(
        "inspection_id", "line_no", "confidence", *_BOX, F.explode(line_typed_dates()).alias("d")
    ).select("inspection_id", "line_no", "confidence", *_BOX, "d.*")
    first = F.struct("stage", "line_no", "place")
    distinct = rows.groupBy("inspection_id", "type", "date_text").agg(
        F.min_by(F.struct("stage", "line_no", "place", "confidence", *_BOX), first).alias("r")
    )
    item = F.struct("r.stage", "r.line_no", "r.place", "date_text", "r.confidence", *[f"r.{c}" for c in _BOX])
    folded = distinct.groupBy("inspection_id", "type").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    kept = F.aggregate(
        "_all",
        F.slice("_all", 1, 0),
        lambda done, d: F.when(
            F.exists(done, lambda k: d["date_text"].contains(k["date_text"]) | k["date_text"].contains(d["date_text"])), done
        ).otherwise(F.concat(done, F.array(d))),
    )
    return folded.select("inspection_id", "type", F.explode(kept).alias("k")).select("inspection_id", "type", "k.*")


_RELATIVE_TEXT = r"(?i)(?:MONTHS?|DAYS?|WEEKS?|YEARS?|BEST\s*BEFORE|FROM\s*(?:PACKAGING|MFG|MANUFACTURE))"


def _date_hits() -> dict[str, Column]:
    """Making, expiry and making-with-duration date of a line: the first fitting item of its ``_dates`` stands for it."""

    def making(d: Column) -> Column:
        return d["type"].isin(MADE_TYPES)

    def lasting(d: Column) -> Column:
        return d["date_text"].rlike(_RELATIVE_TEXT)

    fits = {
        "d_m": lambda d: making(d) & ~lasting(d), "d_e": lambda d: d["type"].isin(EXPIRY_TYPES), "d_r": lambda d: making(d) & lasting(d)}
    return {n: F.when(F.size("_dates") > 0, F.get(F.filter("_dates", fit), F.lit(0))) for n, fit in fits.items()}


def _date_told() -> dict[str, Column]:
    """Where the dates of ``_date_hits`` stand, and what they say."""
    told = {}
    for n in ("d_m", "d_e", "d_r"):
        best = F.col(n)
        told[f"{n}_at"] = _told(best.isNotNull(), best["stage"].alias("stage"), F.col("line_no"), best["place"].alias("place"))
        told[n] = _told(best.isNotNull(), best["date_text"].alias("date_text"), F.col("confidence"), *[F.col(c) for c in _BOX])
    return told


def _date_picks() -> list[Column]:
    """Earliest making, expiry and making-with-duration date of a package."""
    return [c for n in ("d_m", "d_e", "d_r") for c in (F.min(f"{n}_at").alias(f"{n}_at"), F.min_by(n, f"{n}_at").alias(n))]


def _expiry_of() -> Column:
    """A duration under a making anchor is the expiry if nothing came before it."""
    early = F.col("d_r_at").isNotNull() & (F.col("d_m_at").isNull() | (F.col("d_r_at") < F.col("d_m_at")))
    use_r = early & (F.col("d_e_at").isNull() | (F.col("d_r_at") < F.col("d_e_at")))
    return F.when(use_r, F.col("d_r")).otherwise(F.col("d_e"))


# --------------------------------------------------------------- whole labels


def promo_quantity(tokens: DataFrame) -> DataFrame:
    """Total of a promotional pack, such as ``54g + 9g EXTRA = 63g``.

    The phrase may run over line ends; only packages that have both an anchor
    and a sign of a total are read in rows, and only rows near an anchor are
    put together.
    """
    tokens = readable(tokens).drop("raw_line")
    value = text("text")
    flags = tokens.groupBy("inspection_id").agg(
        F.max(value.rlike(f"(?i){_NET}")).alias("_net"), F.max(value.rlike("(?i)=|TOTAL")).alias("_sum")
    ).where("_net AND _sum")
    return _promo_of(tokens.join(spread(flags.select("inspection_id")), "inspection_id", "left_semi"))


_TOTAL_KEY = rf"(?i){_NET}|(?:NET|SHUDDHA)\s*$"


def _promo_of(lines: DataFrame) -> DataFrame:
    near = behind_keys(lines, _TOTAL_KEY, PROMO_REACH)
    amount, unit = vx.found(F.col("_said"), PROMO_QUANTITY, 1), vx.found(F.col("_said"), PROMO_QUANTITY, 2)
    return near.where(amount.isNotNull()).groupBy("inspection_id").agg(
        F.min_by(F.struct(vx.decimal_comma(amount).alias("quantity"), F.lower(unit).alias("unit")), "_key_row").alias("m")
    ).select("inspection_id", "m.*")


#: characters behind a key beyond the reach: a broken key, a currency and some blanks
_ROOM = 64
PRICE_ACROSS_CONFIDENCE = 92.0


def behind_keys(tokens: DataFrame, key: str, reach: int) -> DataFrame:
    """Reading text from each row where a key starts, or may start, as far as ``reach`` characters behind the key can lie.

    (inspection_id, _key_row, _said). The text of a page is never put together.
    A row and its break hold two characters or more, which bounds the rows; runs
    of more than some thirty blanks are not bridged.
    """
    span = (reach + _ROOM) // 2 + 1
    rows = tk.row_texts(tk.reading_rows(tokens)).select("inspection_id", "row_no", "row_text").where("inspection_id IS NOT NULL")
    # a page is laid out in blocks of rows: a key reaches its own block and the next, so a row goes there and to the one before
    block = F.floor(F.col("row_no") / span)
    laid = rows.withColumn("_own", block).withColumn("_block", F.explode(
        F.when(F.col("_own") > 0, F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own"))))
    keyed = (F.col("_own") == F.col("_block")) & F.col("row_text").rlike(key)
    blocks = laid.groupBy("inspection_id", "_block").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "row_text"))).alias("_rows"),
        F.array_sort(F.collect_list(F.when(keyed, F.col("row_no")))).alias("_keys")).where(F.size("_keys") > 0)

    def strung(start: Column) -> Column:
        reached = F.filter("_rows", lambda r: (r["row_no"] >= start) & (r["row_no"] < start + span))
        return F.aggregate(
            reached,
            F.struct(F.lit("").alias("said"), F.lit(reach + _ROOM + 1).alias("room")),
            lambda done, r: F.when(done["room"] <= 0, done).otherwise(F.struct(
                F.concat(done["said"], F.when(r["row_no"] > start, F.lit("\n")).otherwise(F.lit("")), r["row_text"]).alias("said"),
                # the key's own row is free
                (done["room"] - F.when(r["row_no"] > start, F.length(r["row_text"]) + 1).otherwise(0)).alias("room"))))["said"]

    found = F.transform("_keys", lambda start: F.struct(start.alias("_key_row"), strung(start).alias("_said")))
    return blocks.select("inspection_id", F.explode(found).alias("_f")).select("inspection_id", "_f._key_row", "_f._said")


def price_across_lines(tokens: DataFrame) -> DataFrame:
    """First price whose amount stands within ``PRICE_REACH`` characters of its key in the reading text."""
    near = behind_keys(tokens, f"(?i){_PRICE_KEY}|{_PRICE_KEY_OPEN}", PRICE_REACH)
    amount = vx.found(F.col("_said"), PRICE_ACROSS)
    return near.where(amount.isNotNull()).groupBy("inspection_id").agg(
        F.min_by(F.struct(amount.alias("amount"), vx.found(F.col("_said"), PRICE_ACROSS, 0).alias("raw_line")), "_key_row").alias("m")
    ).select("inspection_id", "m.*")


def price_beyond_line(tokens: DataFrame) -> DataFrame:
    """Price of labels whose key and amount stand on different lines.

    Beside or below the key first, else across lines in the reading text; the
    box is then that of the first line that shows the amount.
    """
    money = r"(?:Rs\.?|₹|INR)?\s*[0-9]+(?:[.,][0-9]{1,2})?"
    beside = tk.spatial_pair(tokens, _PRICE_KEY, money).select(
        "inspection_id", F.lit(0).alias("_stage"), vx.decimal_comma(vx.found(F.col("value"), f"({_MONEY})")).alias("price"),
        F.col("value").alias("raw_line"), "confidence", "box.*")
    across = price_across_lines(tokens.join(spread(beside.select("inspection_id")), "inspection_id", "left_anti"))
    shown = tokens.join(spread(across.select("inspection_id", "amount")), "inspection_id").where(F.col("text").contains(F.col("amount")))
    boxes = shown.groupBy("inspection_id").agg(F.min_by(F.struct(*_BOX), "line_no").alias("box"))
    across = across.join(spread(boxes), "inspection_id", "left").select(
        "inspection_id", F.lit(1).alias("_stage"), vx.decimal_comma(F.col("amount")).alias("price"), "raw_line",
        F.lit(PRICE_ACROSS_CONFIDENCE).alias("confidence"), *[F.col("box")[c].alias(c) for c in _BOX])
    return beside.unionByName(across)


def price_with_verdict(tokens: DataFrame) -> DataFrame:
    """Price, inline unit price and the three-way tax verdict.

    The price of the first line that holds key and amount, else that of a key
    whose amount stands on another line. The tax clause counts on the price
    line, within five reading rows of it, or on any token of the package.
    """
    lines = readable(tokens)
    value = text("text")
    price = vx.decimal_comma(_hit(LABEL_PRICE, 2))
    same_line = _hit(LABEL_PRICE, 1).isNotNull() | _hit(LABEL_PRICE, 3).isNotNull()
    unit_price = vx.decimal_comma(_hit(INLINE_UNIT_PRICE))
    picked = cut(lines.groupBy("inspection_id").agg(
        _first(
            price.isNotNull(), price.alias("price"), same_line.alias("_same"), F.col("confidence"), F.col("line_no"),
            vx.decimal_comma(_hit(LABEL_PRICE, 4)).alias("unit_price"), _hit(LABEL_PRICE, 5).alias("per"),
            F.col("raw_line"), *[F.col(c) for c in _BOX],
        ).alias("m"),
        F.max(value.rlike(TAX_NEAR)).alias("_anywhere"),
        F.max(value.rlike(f"(?i){_PRICE_KEY}|{_PRICE_KEY_OPEN}")).alias("_key"),
        _first(unit_price.isNotNull(), unit_price.alias("unit_price"), F.lower(_hit(INLINE_UNIT_PRICE, 2)).alias("per")).alias("_inline"),
    ))
    on_line = picked.where("m IS NOT NULL").select("inspection_id", "m.*", "_anywhere")
    open_ = picked.where("m IS NULL AND _key")
    columns = ["inspection_id", "line_no", "text", "confidence", *_BOX]
    laid_out = cut(lines.select(*columns).join(spread(open_.select("inspection_id")), "inspection_id", "left_semi"))
    beyond = price_beyond_line(laid_out).join(
        spread(open_.select("inspection_id", "_anywhere", "_inline")), "inspection_id")
    # a pair of lines tells no unit price, the reading text may
    told = F.when(F.col("_stage") == 1, F.col("_inline"))
    return cut(on_line.unionByName(beyond.select(
        "inspection_id", "price", F.col("_anywhere").alias("_same"), "confidence", F.lit(None).cast("int").alias("line_no"),
        told["unit_price"].alias("unit_price"), told["per"].alias("per"), "raw_line", *_BOX, "_anywhere")))


def near_rows_tax(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """Packages whose tax clause is split over tokens of a row near the price."""
    open_ = prices.where("NOT _same AND NOT _anywhere AND line_no IS NOT NULL").select("inspection_id", "line_no")
    lines = tokens.join(spread(open_.select("inspection_id")), "inspection_id", "left_semi")
    placed = tk.reading_rows(lines)
    rows = tk.row_texts(placed)
    anchors = placed.join(spread(open_), ["inspection_id", "line_no"]).groupBy("inspection_id").agg(F.min("row_no").alias("_anchor"))
    near = rows.join(spread(anchors), "inspection_id").where(
        (F.abs(F.col("row_no") - F.col("_anchor")) <= 5) & F.col("row_text").rlike(TAX_NEAR)
    )
    return near.select("inspection_id").distinct()


def with_price_verdict(prices: DataFrame, near: DataFrame) -> DataFrame:
    joined = prices.join(spread(near.withColumn("_near", F.lit(True))), "inspection_id", "left")
    taxed = F.col("_same") | F.col("_anywhere") | F.coalesce("_near", F.lit(False))
    unclear = F.col("confidence") < C.EXTRACTION_MIN_CONFIDENCE
    return joined.withColumn("tax_stated", taxed).withColumn(
        "verdict",
        F.when(unclear, "CANNOT_VERIFY").when(taxed, "CONFORMING").otherwise("VIOLATION"),
    ).drop("_same", "_anywhere", "_near")


_ING_KEY = r"(?:INGREDIENTS?|CONTAINS?|SAMAGRI|GHATAK)"


_ING_WORDS = ["INGREDIENT", "CONTAIN", "SAMAGRI", "GHATAK", "COMPOSITION"]


def _ingredient_hits() -> dict[str, Column]:
    hit = F.when(_may(*_ING_WORDS), _hit(INGREDIENTS))
    said = F.trim(text(hit))
    anchor = hit.isNotNull()
    good = anchor & (F.length(said) >= 2) & ~bad_ingredient(said)
    return {
        "_i_said": said,
        "_i_good": good,
        "_i_weak": anchor & ~good,
        "_i_key": _may(*_ING_WORDS) & text("text").rlike(f"(?i){_ING_KEY}"),
    }


def _ingredient_told() -> dict[str, Column]:
    return {"i_direct": _told(F.col("_i_good"), F.col("_i_said").alias("ingredients"), F.col("confidence"), *[F.col(c) for c in _BOX],
                              F.col("line_no").alias("anchor_line"))}


def _ingredient_marks() -> list[Column]:
    return [
        F.min(F.when(F.col("_i_weak"), F.col("line_no"))).alias("i_weak_line"),
        F.max("_i_key").alias("i_key"),
    ]


def _ingredients_of(line: DataFrame, tokens: DataFrame) -> DataFrame:
    """Best ingredients: the anchored line, the lines below it, or a neighbour.

    ``tokens`` may be limited to packages that need more than the first.
    """
    direct = line.where("i_direct IS NOT NULL").select("inspection_id", "i_direct.*")
    # an anchor with nothing useful behind it counts if it stands above the good one
    early = line.where(
        "i_weak_line IS NOT NULL AND (i_direct IS NULL OR i_weak_line < i_direct.anchor_line)"
    ).select("inspection_id")
    placed = tk.reading_rows(tokens.join(spread(early), "inspection_id", "left_semi"))
    weak = placed.withColumns(_ingredient_hits()).where("_i_weak").select(
        "inspection_id", F.col("line_no").alias("anchor_line"), F.col("row_no").alias("anchor_row"), "_i_said",
        "confidence", *_BOX)
    more = tk.continuation_lines(
        tk.row_texts(placed), weak.select("inspection_id", "anchor_line", "anchor_row"), INGREDIENT_STOP)
    whole = F.trim(F.regexp_replace(
        F.trim(F.concat_ws(" ", F.nullif("_i_said", F.lit("")), F.col("continuation"))), r"[.:;\-]+$", ""))
    continued = (
        weak.join(spread(more), ["inspection_id", "anchor_line"], "left").withColumn("ingredients", whole)
        .where((F.length("ingredients") >= 2) & ~bad_ingredient("ingredients"))
        .select("inspection_id", "ingredients", "confidence", *_BOX, "anchor_line")
    )
    found = cut(direct.unionByName(continued).groupBy("inspection_id").agg(
        F.min_by(F.struct("ingredients", "confidence", *_BOX), "anchor_line").alias("m")
    ).select("inspection_id", "m.*"))
    keyed = line.where("i_key").select("inspection_id").join(spread(found), "inspection_id", "left_anti")
    near = tk.spatial_pair(
        tokens.join(spread(keyed), "inspection_id", "left_semi"), _ING_KEY, r"[A-Za-z]{3,}(?:[\s,]+[A-Za-z]{3,})*")
    cleaned = F.trim(F.regexp_replace(F.trim("value"), r"[.:;\-]+$", ""))
    near = near.where(~bad_ingredient("value") & ~bad_ingredient(cleaned) & (F.length(F.trim("value")) >= 2))
    return found.unionByName(near.select("inspection_id", cleaned.alias("ingredients"), "confidence", "box.*"))


def extract_ingredients(tokens: DataFrame) -> DataFrame:
    """Ingredients after their anchor, else the lines below it, else nearby."""
    line = tokens.withColumns(_ingredient_hits()).groupBy("inspection_id").agg(*_picks(_ingredient_told()), *_ingredient_marks())
    return _ingredients_of(cut(line), tokens)


def _name_hits(lines: DataFrame) -> DataFrame:
    """What a line tells about the name; whether it is boilerplate is only asked of lines that could be one."""
    value, said = F.trim(text("text")), F.col("_n_said")
    long_ = F.length(value) >= 3
    may = lines.withColumns({
        "_n_said": F.trim(text(F.when(_may("NAME", "COMMODITY"), _hit(GENERIC_NAME)))),
        "_n_plain": long_ & ~has_any(F.upper(value), C.PLAIN_LINE_SKIP) & ~value.rlike(r"^[0-9\s.,:;\-/]+$"),
        "_n_word": long_ & value.rlike(COMMODITY_WORDS),
    }).withColumns({
        # branches, as what an "and" holds twice would be worked out ahead of it, on every line; written out twice it is too long to be compiled
        "_n_good": F.when(F.length(said) > 2, vx.let(said, lambda v: ~bad_generic_name(v))),
        "_fine": F.when(F.col("_n_plain") | F.col("_n_word"), ~bad_generic_name(text("text"))),
    })
    return may.withColumns({name: F.col(name) & F.col("_fine") for name in ("_n_plain", "_n_word")})


def _name_told() -> dict[str, Column]:
    value, rest = F.trim(text("text")), [F.col("confidence"), *[F.col(c) for c in _BOX]]
    return {
        "n_anchored": _told(F.col("_n_good"), F.col("_n_said").alias("name"), *rest),
        "n_plain": _told(F.col("_n_plain"), value.alias("name"), *rest),
        "n_word": _told(F.col("_n_word"), value.alias("name"), *rest),
    }


def _names_of(line: DataFrame, tokens: DataFrame, ingredients: DataFrame) -> DataFrame:
    single = ingredients.where(
        ~bad_generic_name("ingredients") & ~bad_ingredient("ingredients") & ~F.col("ingredients").rlike("[,;]")
        & (F.size(F.split(F.trim("ingredients"), r"\s+")) <= 4)
    ).select("inspection_id", F.struct(F.col("ingredients").alias("name"), "confidence", *_BOX).alias("s"))
    step = cut(line.select("inspection_id", "n_anchored", "n_plain", "n_word").join(spread(single), "inspection_id", "left"))
    done = step.where("n_anchored IS NOT NULL OR s IS NOT NULL").select(
        "inspection_id", F.coalesce("n_anchored", "s").alias("m"), F.col("n_anchored").isNotNull().alias("anchored"), "n_word")
    open_ = step.where("n_anchored IS NULL AND s IS NULL")
    titles = tk.title_fallback(tokens.join(spread(open_.select("inspection_id")), "inspection_id", "left_semi"))
    titled = open_.join(
        spread(titles.select("inspection_id", F.struct(F.col("title").alias("name"), "confidence", *_BOX).alias("t"))),
        "inspection_id", "left",
    ).select("inspection_id", F.coalesce("t", "n_plain").alias("m"), F.lit(False).alias("anchored"), "n_word")
    return done.unionByName(titled)


def extract_generic_name(tokens: DataFrame) -> DataFrame:
    """Anchored name, single ingredient, title lettering, first plain line."""
    hits = _name_hits(tokens.withColumns(_ingredient_hits()))
    line = cut(hits.groupBy("inspection_id").agg(*_picks(_ingredient_told() | _name_told()), *_ingredient_marks()))
    names = _names_of(line, tokens, _ingredients_of(line, tokens))
    return names.where("m IS NOT NULL").select("inspection_id", "m.*", "anchored")


# ------------------------------------------------------- the declaration table


def _care_parts() -> Column:
    """Contacts of a line as an array of (kind, line, place, value)."""

    def hits(kind: int, mark: str = "") -> Column:
        # a line without the mark has none of the kind
        value = F.when(_may(mark), text("text")).otherwise("") if mark else text("text")
        return F.transform(
            F.regexp_extract_all(value, F.lit(CARE), F.lit(kind + 1)),
            lambda v, i: F.struct(F.lit(kind).alias("kind"), F.col("line_no").alias("line_no"), i.alias("place"), v.alias("value")),
        )

    every = F.filter(F.concat(hits(0), hits(1, "@"), hits(2, "WWW.")), lambda c: c["value"] != "")
    # cheap test first: a contact has 1800, six digits in a row, an @ or www
    return F.when(_may("1800", "@", "WWW.") | text("text").rlike("[0-9]{6}"), every)


_DECLARED = {"confidence": "double", "numeric_value": "double", "unit": "string", "verdict": "string", "tax_in_block": "boolean", "raw_line": "string"}


def _said(field: str, value: Column, when: Column | None = None, **more: Column) -> Column:
    """One declaration as a struct, null where ``when`` is not met."""
    columns = {"confidence": F.col("confidence")} | more
    said = F.struct(F.lit(field).alias("field_name"), value.cast("string").alias("value"),
                    *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in _DECLARED.items()])
    return said if when is None else F.when(when, said)


def _decls(df: DataFrame, *said: Column) -> DataFrame:
    """The declarations of each row; what they are drawn from is worked out once."""
    several = F.filter(F.array(*said), lambda d: d.isNotNull())
    rows = df.select("inspection_id", *[F.col(c).cast("double").alias(c) for c in _BOX], F.explode(several).alias("_d"))
    return rows.select("inspection_id", "_d.field_name", "_d.value", *_BOX, *[f"_d.{n}" for n in _DECLARED])


def _decl(df: DataFrame, field: str, value: Column, **more: Column) -> DataFrame:
    return _decls(df, _said(field, value, **more))


_QUANTITY_KEY = r"NET\s*\.?\s*(?:WT|WEIGHT|QTY|QUANTITY|CONTENTS?|VOL(?:UME)?)"


def label_facts(tokens: DataFrame) -> DataFrame:
    """Everything single lines can tell, one row per package, from one scan.

    A long pattern is only tried on lines that hold a word it cannot do
    without; the partial aggregate keeps one candidate per field and task, so
    the shuffle moves packages, not lines.
    """
    value = text("text")
    keyed = readable(tokens).withColumns({
        "_p_key": _may("M") & value.rlike(f"(?i){_PRICE_KEY}|{_PRICE_KEY_OPEN}"),
        "_tax": _may("TA", "MRP") & value.rlike(TAX_NEAR),
        "_u_may": _may("/", "PER") & value.rlike(r"(?i)[0-9]\s*(?:/|per)"),
        "_q_may": _may("NET", "QUANTITY", "SHUDDHA"),
        "_q_bare_may": value.rlike(r"(?i)[0-9]\s*[kgmlcnup]"),
        "_q_key": _may("NET", "QUANTITY", "SHUDDHA") & value.rlike(f"(?i){_NET}"),
        "_q_sum": _may("=", "TOTAL") & value.rlike("(?i)=|TOTAL"),
        "_b_key": (_may("BATCH", "LOT") | (_may("B") & _may("NO"))) & value.rlike(f"(?i){BATCH_KEY}"),
        "_o_may": _may("ORIGIN", "MADE", "PRODUCT"),
        "_m_key": _may("BY") & value.rlike(MAKER_ANCHOR),
        "_d_key": _may("PACK", "PKD", "MFD", "MFG") & value.rlike(f"(?i){MADE_KEY}"),
        "_e_key": _may("USE", "EXP", "BEST") & value.rlike(f"(?i){EXPIRY_KEY}"),
    })

    def where(may: str, column: Column) -> Column:
        return F.when(F.col(may), column)

    hits = _name_hits(keyed.withColumns(
        {
            "_p": where("_p_key", vx.decimal_comma(_hit(LABEL_PRICE, 2))),
            "_p_clause": where("_p_key", _hit(LABEL_PRICE, 1).isNotNull() | _hit(LABEL_PRICE, 3).isNotNull()),
            "_p_unit": where("_p_key", vx.decimal_comma(_hit(LABEL_PRICE, 4))),
            "_p_per": where("_p_key", _hit(LABEL_PRICE, 5)),
            "_p_loose": F.when(_may("₹", "RS", "INR"), vx.decimal_comma(_hit(PRICE_CURRENCY))),
            "_u": where("_u_may", vx.decimal_comma(_hit(INLINE_UNIT_PRICE))),
            "_u_per": where("_u_may", F.lower(_hit(INLINE_UNIT_PRICE, 2))),
            "_q": where("_q_may", vx.decimal_comma(_hit(LABEL_QUANTITY, 1))),
            "_q_unit": where("_q_may", F.lower(_hit(LABEL_QUANTITY, 2))),
            "_q_bare": where("_q_bare_may", vx.decimal_comma(_hit(BARE_QUANTITY, 1))),
            "_q_bare_unit": where("_q_bare_may", F.lower(_hit(BARE_QUANTITY, 2))),
            "_b": where("_b_key", F.trim(_hit(LABEL_BATCH))),
            "_o": where("_o_may", F.trim(_hit(LABEL_ORIGIN))),
            "_m": where("_m_key", F.trim(text(vx.found(value, MAKER_ANCHOR + r"[:\s.\-]*([^\n]+)")))),
            "_c": _care_parts(),
            "_dates": line_typed_dates(),
            **_licence_hits(),
            **_ingredient_hits(),
        }
    ))
    rest = [F.col("confidence"), *[F.col(c) for c in _BOX]]

    def found(name: str) -> Column:
        return F.col(name).isNotNull()

    told = {
        "price": _told(found("_p"), F.col("_p").alias("price"), F.col("_p_clause").alias("_same"), F.col("_p_unit").alias("unit_price"),
                       F.col("_p_per").alias("per"), F.col("raw_line"), F.col("line_no"), *rest),
        "loose": _told(found("_p_loose"), F.col("_p_loose").alias("price"), F.col("raw_line"), *rest),
        "tax_line": _told(F.col("_tax"), *rest),
        "inline": _told(found("_u"), F.col("_u").alias("unit_price"), F.col("_u_per").alias("per")),
        "quantity": _told(found("_q"), F.col("_q").alias("amount"), F.col("_q_unit").alias("unit"), *rest),
        "bare": _told(found("_q_bare"), F.col("_q_bare").alias("amount"), F.col("_q_bare_unit").alias("unit"), *rest),
        "batch": _told(found("_b") & ~is_barcode("_b"), F.col("_b").alias("batch"), *rest),
        "origin": _told(F.col("_o") != "", F.col("_o").alias("origin"), *rest),
        "maker": _told(F.length("_m") > 2, F.col("_m").alias("maker"), *rest),
        "care_box": _told(F.size("_c") > 0, *[F.col(c) for c in _BOX]),
        **_licence_told(),
        **_ingredient_told(),
        **_name_told(),
    }
    marks = ["p_key", "q_key", "q_sum", "b_key", "m_key", "d_key", "e_key"]
    # put together before the aggregate, which sorts what does not fit its table: most lines tell little
    narrow = hits.withColumns(_date_hits()).select(
        "inspection_id", "line_no", *[F.col(f"_{m}") for m in marks], "_tax", "_i_weak", "_i_key",
        F.when(F.size("_c") > 0, F.col("_c")).alias("_c"), *[c.alias(n) for n, c in (told | _date_told()).items()])
    return narrow.groupBy("inspection_id").agg(
        *_picks({n: F.col(n) for n in told}, _LAST),
        *[F.max(f"_{m}").alias(m) for m in marks],
        F.max("_tax").alias("taxed"),
        F.flatten(F.collect_list("_c")).alias("care"),
        *_date_picks(),
        *_ingredient_marks(),
    )


def declaration_table(tokens: DataFrame) -> DataFrame:
    """Lines of a label to its standard declarations, one row per field found.

    The facts of single lines come from one scan. Packages that still need
    their layout (a value beside or below its key, a promotional total, a
    title) are written aside once, and only they are looked at again.
    """
    facts = cut(label_facts(tokens))
    # each line is told what its package still needs, so that no branch has to look its packages up again
    wanted = facts.select("inspection_id", *[F.coalesce(F.expr(c), F.lit(False)).alias(n) for n, c in _NEEDS.items()],
                          F.coalesce(_expiry_of().isNull() & F.col("e_key"), F.lit(False)).alias("_w_expiry"))
    some = reduce(lambda a, b: a | b, [F.col(n) for n in (*_NEEDS, "_w_expiry")])
    laid_out = cut(readable(tokens).select(*_LINE).join(spread(wanted.where(some)), "inspection_id"))
    # most packages need a title only, and a need has many readers: what the others are for is written by itself
    few = cut(laid_out.where(" OR ".join(n for n in wanted.columns if n not in ("inspection_id", "_w_title"))))
    parts = [
        _price_rows(few, facts),
        _quantity_rows(few, facts),
        _date_rows(few, facts),
        _batch_rows(few, facts),
        _care_rows(facts),
        _licence_rows(facts),
        _decl(facts.where("origin IS NOT NULL").select("inspection_id", "origin.*"), "country_of_origin", F.col("origin")),
        _maker_rows(few, facts),
        _name_rows(laid_out, few, facts),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


_LINE = ["inspection_id", "line_no", "text", "confidence", *_BOX]
#: what a package may need its layout for
_NEEDS = {
    "_w_price": "price IS NULL AND p_key",
    "_w_tax": "price IS NOT NULL AND NOT price._same AND NOT taxed",
    "_w_promo": "q_key AND q_sum",
    "_w_quantity": "quantity IS NULL AND q_key",
    "_w_made": "d_m IS NULL AND d_key",
    "_w_batch": "batch IS NULL AND b_key",
    "_w_maker": "maker IS NULL AND m_key",
    "_w_made_of": "i_weak_line IS NOT NULL OR (i_direct IS NULL AND i_key)",
    "_w_title": "n_anchored IS NULL",
}


def _of(tokens: DataFrame, need: str) -> DataFrame:
    return cut(tokens.where(need).select(*_LINE))


def _price_rows(tokens: DataFrame, facts: DataFrame) -> DataFrame:
    found = facts.where("price IS NOT NULL").select("inspection_id", "price.*", F.col("taxed").alias("_anywhere"), "inline")
    near = near_rows_tax(_of(tokens, "_w_tax"), found)
    anchored = with_price_verdict(found, near).drop("line_no")
    beyond = price_beyond_line(_of(tokens, "_w_price")).select(
        "inspection_id", "_stage", F.struct("price", "raw_line", "confidence", *_BOX).alias("beyond"))
    rest = facts.where("price IS NULL").select("inspection_id", "taxed", "loose", "inline").join(spread(beyond), "inspection_id", "left")
    chosen = rest.withColumn("use", F.coalesce("beyond", "loose")).where("use IS NOT NULL")
    # a price without any key has no verdict, only what the text states
    unclear = F.col("use.confidence") < C.EXTRACTION_MIN_CONFIDENCE
    verdict = F.when(F.col("beyond").isNotNull(), F.when(unclear, "CANNOT_VERIFY").when(F.col("taxed"), "CONFORMING").otherwise("VIOLATION"))
    others = chosen.select(
        "inspection_id", "use.*", F.col("taxed").alias("tax_stated"), verdict.alias("verdict"),
        F.lit(None).cast("double").alias("unit_price"), F.lit(None).cast("string").alias("per"),
        F.when(F.col("_stage") == 1, F.col("inline")).alias("inline"))
    every = anchored.unionByName(others)
    per_price, per = F.coalesce("unit_price", "inline.unit_price"), F.coalesce("per", "inline.per")
    said = _decls(
        every,
        _said("mrp", F.format_string("₹%.2f", F.col("price")), numeric_value=F.col("price"), verdict=F.col("verdict"),
              tax_in_block=F.col("tax_stated") & (F.coalesce("verdict", F.lit("")) == "CONFORMING"), raw_line=F.col("raw_line")),
        _said("mrp_inclusive_tax", F.lit("Inclusive of all taxes"), F.col("tax_stated")),
        _said("unit_sale_price", F.concat(F.format_string("₹%.2f/", per_price), per), per_price > 0, numeric_value=per_price, unit=per))
    alone = rest.where("beyond IS NULL AND loose IS NULL AND taxed").select("inspection_id").join(
        spread(facts.select("inspection_id", "tax_line.*")), "inspection_id")
    return said.unionByName(_decl(alone, "mrp_inclusive_tax", F.lit("Inclusive of all taxes")))


def _quantity_rows(tokens: DataFrame, facts: DataFrame) -> DataFrame:
    promo = _promo_of(_of(tokens, "_w_promo")).select("inspection_id", F.struct(
        F.col("quantity").alias("amount"), "unit", F.lit(95.0).alias("confidence"),
        *[F.lit(None).cast("double").alias(c) for c in _BOX]).alias("promo"))
    near = tk.spatial_pair(
        _of(tokens, "_w_quantity"), _QUANTITY_KEY,
        r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:" + _UNITS_SHORT + r")\b",
    ).select("inspection_id", F.struct(
        vx.decimal_comma(vx.found(F.col("value"), r"([0-9]+(?:[.,][0-9]+)?)\s*[a-zA-Z]+")).alias("amount"),
        F.lower(vx.found(F.col("value"), r"[0-9]+(?:[.,][0-9]+)?\s*([a-zA-Z]+)")).alias("unit"),
        "confidence", "box.*").alias("near"))
    joined = facts.select("inspection_id", "quantity", "bare").join(spread(promo), "inspection_id", "left").join(
        spread(near), "inspection_id", "left")
    rows = joined.select("inspection_id", F.coalesce("promo", "quantity", "near", "bare").alias("m")).where(
        "m IS NOT NULL").select("inspection_id", "m.*")
    shown = F.concat(vx.plain_number(F.col("amount")), F.lit(" "), F.col("unit"))
    return _decls(rows, _said("net_quantity", shown, numeric_value=F.col("amount"), unit=F.col("unit")),
                  _said("net_quantity_unit", F.col("unit"), unit=F.col("unit")))


def _date_rows(tokens: DataFrame, facts: DataFrame) -> DataFrame:
    known = facts.select("inspection_id", F.col("d_m").alias("m"), _expiry_of().alias("e"))
    made = tk.spatial_pair(
        _of(tokens, "_w_made"), MADE_KEY, CALENDAR,
        r"\b(?:USE\s*BY|EXP(?:IRY)?|BEST\s*BEFORE|MONTHS?\s*FROM)\b")
    lasting = r"(?:\b" + _COUNT_WORD + r"\s+)?(?:MONTHS?|DAYS?|YEARS?)(?:\s*(?:FROM|OF)\s*(?:PACKAGING|PACKING|MFG|MANUFACTURE))?"
    ends = tk.spatial_pair(_of(tokens, "_w_expiry"), EXPIRY_KEY, f"(?:{CALENDAR}|{lasting})", "PKD|MFD")

    def rows(df: DataFrame) -> DataFrame:
        return df.select("inspection_id", vx.repair_date_text("value").alias("date_text"), "confidence", "box.*")

    first = known.where("m IS NOT NULL").select("inspection_id", "m.*").unionByName(rows(made))
    second = known.where("e IS NOT NULL").select("inspection_id", "e.*").unionByName(rows(ends))
    ends_at = [_said(field, F.col("date_text")) for field in ("expiry_date", "best_before")]
    return _decl(first, "manufacturing_date", F.col("date_text")).unionByName(_decls(second, *ends_at))


def _batch_rows(tokens: DataFrame, facts: DataFrame) -> DataFrame:
    near = tk.spatial_pair(
        _of(tokens, "_w_batch"), BATCH_KEY, BATCH_VALUE, r"USE\s*BY|EXP|PKD|MFD", own_line=r"(?i)^B\.?\s*NO"
    ).select("inspection_id", F.col("value").alias("batch"), "confidence", "box.*")
    rows = facts.where("batch IS NOT NULL").select("inspection_id", "batch.*").unionByName(near)
    good = rows.where(~is_barcode("batch") & (F.col("confidence") >= 85.0) & ~F.col("batch").rlike(BATCH_NOISE))
    return _decl(good, "batch_number", F.col("batch"))


def _care_rows(facts: DataFrame) -> DataFrame:
    values = F.transform(F.array_sort("care"), lambda c: c["value"])
    rows = facts.where(F.size("care") > 0).select(
        "inspection_id", F.array_join(values, " | ").alias("care"), F.lit(90.0).alias("confidence"), "care_box.*")
    return _decl(rows, "consumer_care", F.col("care"))


def _licence_rows(facts: DataFrame) -> DataFrame:
    rows = _licence_rows_of(facts)
    shown = F.coalesce("licence", F.when(F.col("logo"), "FSSAI Logo Verified"))
    return _decl(rows.where(shown.isNotNull()), "fssai_license", shown)


def _maker_rows(tokens: DataFrame, facts: DataFrame) -> DataFrame:
    below = tk.below_anchor(_of(tokens, "_w_maker"), MAKER_ANCHOR)
    rows = facts.where("maker IS NOT NULL").select("inspection_id", "maker.*").unionByName(
        below.select("inspection_id", "maker", "confidence", *_BOX))
    return _decl(rows, "manufacturer", F.col("maker"))


def _name_rows(tokens: DataFrame, few: DataFrame, facts: DataFrame) -> DataFrame:
    ingredients = _ingredients_of(facts, _of(few, "_w_made_of"))
    names = _names_of(facts, tokens.where("_w_title").select(*_LINE), ingredients)
    good = F.col("m").isNotNull() & ~bad_generic_name("m.name")
    titles = names.select("inspection_id", "anchored", F.when(good, F.col("m")).otherwise(F.col("n_word")).alias("m"))
    titles = titles.where("m IS NOT NULL").select("inspection_id", "anchored", "m.*")
    # a single commodity that names itself is its own ingredient
    own = titles.where(F.col("anchored") & has_any(F.upper("name"), C.SINGLE_COMMODITIES)).join(
        spread(ingredients.select("inspection_id")), "inspection_id", "left_anti")
    eaten = ingredients.unionByName(own.select("inspection_id", F.col("name").alias("ingredients"), "confidence", *_BOX))
    eaten = eaten.where(~bad_ingredient("ingredients"))
    named = [_said(f, F.col("name")) for f in ("generic_name", "common_generic_name", "product_name")]
    made_of = [_said(f, F.col("ingredients")) for f in ("ingredients", "ingredient_list")]
    return _decls(titles, *named).unionByName(_decls(eaten, *made_of))
