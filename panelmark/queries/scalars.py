"""Scalar operators, each run over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark import fixtures as fx
from panelmark.functions import text as tx
from panelmark.functions import values as vx
from panelmark.operators import extract as ex
from panelmark.operators import slices
from panelmark.queries.registry import EXTRA_VIEWS, query


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_map(mapping: dict[str, str], key: str, default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {key} {cases} ELSE {default} END"


def sql_any(expression: str, phrases) -> str:
    return "(" + " OR ".join(
        f"contains({expression}, '{p}')" for p in phrases
    ) + ")"


# A document cut into lines: free text for the screens.
EXTRA_VIEWS["vx_doc_lines"] = r"""
SELECT doc_id, cast(u.line_no AS integer) AS line_no, list_extract(parts, u.line_no) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d,
     LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS line_no) u
"""


def doc_lines(spark, sf):
    documents = fx.table(spark, sf, "documents")
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).select(
        "doc_id", (F.col("line_no") + 1).alias("line_no"), "text"
    )


_WS = r"'\s+', ' ', 'g'"
query("norm_whitespace", rf"""
SELECT doc_id, trim(regexp_replace(text, {_WS})) AS text_norm FROM documents
""")(lambda spark, sf: fx.table(spark, sf, "documents").select(
    "doc_id", tx.norm_whitespace("text").alias("text_norm")))

query("normalise_line", rf"""
SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\s*\.\s*', '.', 'g'), '\s*:\s*', ': ', 'g'), '\s*,\s*', ', ', 'g'), {_WS})) AS text_norm
FROM vx_doc_lines
""")(lambda spark, sf: doc_lines(spark, sf).select(
    "doc_id", "line_no", tx.normalise_line("text").alias("text_norm")))

query("valid_value", f"""
SELECT inspection_id, seq, NOT (trim(coalesce(category, '')) = ''
  OR lower(trim(category)) IN ({sql_list(C.ABSENT_TEXTS)})) AS is_valid FROM fx_inspections
""")(lambda spark, sf: fx.inspections(spark, sf).select(
    "inspection_id", "seq", tx.valid_value("category").alias("is_valid")))

query("min_confidence", """
SELECT inspection_id, line_no, c AS confidence FROM (SELECT *, CASE seq % 3 WHEN 0 THEN confidence - 20 WHEN 1 THEN confidence / 100.0 - 0.3 END AS c FROM fx_label_lines) t
WHERE c IS NULL OR c >= 40 OR c BETWEEN 0.4 AND 1
""")(lambda spark, sf: ex.confident_lines(fx.label_lines(spark, sf).withColumn(
    "confidence", F.expr("CASE seq % 3 WHEN 0 THEN confidence - 20 WHEN 1 THEN confidence / 100.0D - 0.3D END")))
     .select("inspection_id", "line_no", "confidence"))

_DIGITS = r"regexp_replace(text, '[^0-9]', '', 'g')"
query("is_barcode", rf"""
SELECT inspection_id, line_no, regexp_matches(regexp_replace(trim(tail), '[\s\-]+', '', 'g'),
  '^[0-9]{{12,14}}$') AS is_barcode FROM (SELECT *, substr(text, 15) AS tail FROM fx_label_lines) t
""")(lambda spark, sf: fx.label_lines(spark, sf)
     .withColumn("tail", F.expr("substring(text, 15)"))
     .select("inspection_id", "line_no", tx.is_barcode("tail").alias("is_barcode")))

_LOW = "lower(trim(text))"
_PACKED = f"regexp_replace({_LOW}, '[ :_]', '', 'g')"
SQL_BAD_NAME = rf"""(text = '' OR {sql_any(_LOW, C.GENERIC_NAME_PHRASES)} OR {sql_any(_PACKED, C.GENERIC_NAME_PHRASES)}
  OR (regexp_matches(trim(text), '^[A-Za-z0-9\-_]{{4,}}$') AND regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Za-z]'))
  OR (len(regexp_extract_all(text, '[A-Za-z]')) >= 5 AND
      len(regexp_extract_all(text, '[aeiouyAEIOUY]')) < 0.18 * len(regexp_extract_all(text, '[A-Za-z]')))
  OR regexp_matches(trim(text), '^[0-9\s.,:;\-/]+$')
  OR regexp_matches(upper(trim(text)), '^(BATCH|LOT|B\.NO|L\.NO|MFD|MFG|PKD|EXP|MRP|USE BY)'))"""
query("generic_name_blacklist", f"""
SELECT doc_id, line_no, {SQL_BAD_NAME} AS rejected FROM vx_doc_lines
""")(lambda spark, sf: doc_lines(spark, sf).select(
    "doc_id", "line_no", tx.bad_generic_name("text").alias("rejected")))

query("ingredient_blacklist", f"""
SELECT inspection_id, line_no, (text = '' OR (length(trim(text)) <= 40 AND
  ({sql_any(_LOW, C.INGREDIENT_PHRASES)} OR {sql_any(_PACKED, C.INGREDIENT_PHRASES)}))) AS rejected
FROM fx_label_lines
""")(lambda spark, sf: fx.label_lines(spark, sf).select(
    "inspection_id", "line_no", tx.bad_ingredient("text").alias("rejected")))

_WORDS = r"list_filter(regexp_split_to_array(trim(text), '[^\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Za-z]{5,}$'))"
_VOW = "len(regexp_extract_all(lower(w), '[aeiouy]'))"
SQL_SUSPICIOUS = rf"""coalesce('placeholder: ' || list_filter([{sql_list(C.PLACEHOLDER_PHRASES)}], lambda p: contains(lower(text), p))[1],
  list_filter(list_transform({_WORDS}, lambda w: CASE
    WHEN {_VOW} = 0 OR (length(w) - {_VOW}) / length(w) > 0.85 THEN 'consonant density: ' || w
    WHEN regexp_matches(lower(w), '[bcdfghjklmnpqrstvwxyz]{{5,}}') THEN 'consonant run: ' || w END),
    lambda r: r IS NOT NULL)[1])"""
query("suspicious_text", f"""
SELECT doc_id, line_no, reason IS NOT NULL AS is_suspicious, reason FROM (
SELECT doc_id, line_no, {SQL_SUSPICIOUS} AS reason FROM vx_doc_lines) t
""")(lambda spark, sf: doc_lines(spark, sf).select(
    "doc_id", "line_no", tx.suspicious_text("text").alias("reason"))
     .withColumn("is_suspicious", F.col("reason").isNotNull()))

# ------------------------------------------------------------ money and units

_CLEAN = rf"trim(regexp_replace(text, {_WS}))"
_MONEY = rf"try_cast(nullif(regexp_extract({_CLEAN}, '([0-9]+(?:\.[0-9]{{1,2}})?)', 1), '') AS double)"
query("norm_currency", f"""
SELECT inspection_id, line_no, money, CASE WHEN money IS NULL THEN {_CLEAN}
  WHEN money % 1 = 0 THEN concat('₹', cast(money AS bigint)) ELSE printf('₹%.2f', money) END AS money_text
FROM (SELECT *, {_MONEY} AS money FROM fx_label_lines) t
""")(lambda spark, sf: fx.label_lines(spark, sf).select(
    "inspection_id", "line_no", vx.money("text").alias("money"), vx.money_text("text").alias("money_text")))

EXTRA_VIEWS["vx_unit_words"] = r"""
SELECT inspection_id, line_no, nullif(regexp_extract(text, '[0-9]\s*([a-zA-Z.]+)', 1), '') AS unit
FROM fx_label_lines
"""


def unit_words(spark, sf):
    return fx.label_lines(spark, sf).select(
        "inspection_id", "line_no", vx.found(F.col("text"), r"[0-9]\s*([a-zA-Z.]+)").alias("unit"))


_UNIT_KEY = "lower(trim(coalesce(unit, '')))"
query("norm_unit", f"""
SELECT inspection_id, line_no, {sql_map(C.UNIT_SPELLINGS, _UNIT_KEY, _UNIT_KEY)} AS unit_norm FROM vx_unit_words
""")(lambda spark, sf: unit_words(spark, sf).select(
    "inspection_id", "line_no", vx.norm_unit("unit").alias("unit_norm")))

query("legal_unit_flag", f"""
SELECT inspection_id, line_no, {_UNIT_KEY} IN ({sql_list(C.LEGAL_UNITS)}) AS is_legal FROM vx_unit_words
""")(lambda spark, sf: unit_words(spark, sf).select(
    "inspection_id", "line_no", vx.legal_unit("unit").alias("is_legal")))

_QTY = r"([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)"
_NUM = r"([0-9]+(?:\.[0-9]+)?)"
SQL_SHOWN = "CASE WHEN quantity % 1 = 0 THEN cast(cast(quantity AS hugeint) AS varchar) ELSE cast(quantity AS varchar) END"
query("parse_quantity", rf"""
SELECT inspection_id, line_no, quantity,
  CASE WHEN u IS NOT NULL THEN {sql_map(C.UNIT_SPELLINGS, 'lower(u)', 'lower(u)')}
       WHEN quantity IS NOT NULL THEN '' END AS unit,
  CASE WHEN u IS NOT NULL THEN concat({SQL_SHOWN}, ' ', {sql_map(C.UNIT_SPELLINGS, 'lower(u)', 'lower(u)')})
       WHEN quantity IS NOT NULL THEN cast(quantity AS varchar) ELSE t END AS quantity_text
FROM (SELECT inspection_id, line_no, t, nullif(regexp_extract(t, '{_QTY}', 2), '') AS u,
  try_cast(coalesce(nullif(regexp_extract(t, '{_QTY}', 1), ''), nullif(regexp_extract(t, '{_NUM}', 1), '')) AS double)
    AS quantity FROM (SELECT *, {_CLEAN} AS t FROM fx_label_lines) a) b
""")(lambda spark, sf: fx.label_lines(spark, sf).select(
    "inspection_id", "line_no", vx.quantity("text").alias("quantity"),
    vx.quantity_unit("text").alias("unit"), vx.quantity_text("text").alias("quantity_text")))

# -------------------------------------------------------------------- dates


def date_texts(spark, sf):
    """Order dates written in fourteen label styles, some impossible on purpose."""
    return fx.table(spark, sf, "orders").selectExpr("o_orderkey", f"{_DATE_STYLES} AS text")


_PARTS = {
    "d": "cast(1 + o_orderkey % 31 AS {s})",
    "dd": "lpad(cast(1 + o_orderkey % 31 AS {s}), 2, '0')",
    "m": "cast(1 + o_custkey % 12 AS {s})",
    "mm": "lpad(cast(1 + o_custkey % 13 AS {s}), 2, '0')",
    "y": "cast(1990 + o_custkey % 40 AS {s})",
    "yy": "lpad(cast(o_custkey % 100 AS {s}), 2, '0')",
    "mon": "substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(1 + 3 * (o_custkey % 12) AS int), 3)",
}
_STYLES = [
    ("dd", "'/'", "mm", "'/'", "y"), ("d", "'-'", "m", "'-'", "y"), ("dd", "'.'", "mm", "'.'", "y"),
    ("y", "'-'", "mm", "'-'", "dd"), ("m", "'/'", "y"), ("mm", "'-'", "y"), ("dd", "'/'", "mm", "'/'", "yy"),
    ("mm", "'/'", "yy"), ("mon", "' '", "y"), ("mon", "y"), ("mon", "' '", "yy"), ("dd", "' '", "mon", "' '", "y"),
    ("'(on '", "dd", "'/'", "mm", "'/'", "yy", "' approx)'"), ("'lot '", "mm", "'-'", "y", "' x'"),
]
_DATE_STYLES_RAW = "CASE o_orderkey % 14 " + " ".join(
    f"WHEN {i} THEN concat({', '.join(_PARTS.get(p, p) for p in style)})" for i, style in enumerate(_STYLES)
) + " END"
_DATE_STYLES = _DATE_STYLES_RAW.replace("{s}", "string")
EXTRA_VIEWS["vx_date_texts"] = f"SELECT o_orderkey, {_DATE_STYLES_RAW.replace('{s}', 'varchar')} AS text FROM orders"


def sql_label_date(expression: str) -> str:
    v = rf"regexp_replace(trim({expression}), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')"

    def g(pattern: str, group: int) -> str:
        return f"regexp_extract({v}, '{pattern}', {group})"

    def d(y: str, m: str, day: str) -> str:
        return f"try_cast(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({day}, 2, '0') AS date)"

    def pivot(y: str) -> str:
        return f"cast(CASE WHEN try_cast({y} AS integer) < 69 THEN 2000 ELSE 1900 END + try_cast({y} AS integer) AS varchar)"

    def mon(name: str, full: bool = False) -> str:
        table = {n: str(i + 1) for i, n in enumerate(C.MONTHS)}
        if full:
            table |= {n: str(i + 1) for i, n in enumerate(C.MONTH_NAMES)}
        return sql_map(table, f"upper({name})", "NULL")

    parts = []
    for s in ("/", "-", r"\."):
        p = f"^([0-9]{{1,2}}){s}([0-9]{{1,2}}){s}([0-9]{{4}})$"
        parts.append(d(g(p, 3), g(p, 2), g(p, 1)))
    p = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    parts.append(d(g(p, 1), g(p, 2), g(p, 3)))
    p = r"^([0-9]{1,2})[/\-.]([0-9]{4})$"
    parts.append(d(g(p, 2), g(p, 1), "'1'"))
    for s in ("/", "-"):
        p = f"^([0-9]{{1,2}}){s}([0-9]{{1,2}}){s}([0-9]{{2}})$"
        parts.append(d(pivot(g(p, 3)), g(p, 2), g(p, 1)))
    p = r"^([0-9]{1,2})[/\-]([0-9]{2})$"
    parts.append(d(pivot(g(p, 2)), g(p, 1), "'1'"))
    p = r"^([A-Za-z]{3})(?:\s+|-|/|)([0-9]{4})$"
    parts.append(d(g(p, 2), mon(g(p, 1)), "'1'"))
    p = r"^([A-Za-z]+)\s+([0-9]{4})$"
    parts.append(d(g(p, 2), mon(g(p, 1), True), "'1'"))
    p = r"^([A-Za-z]{3})(?:\s+''?|)([0-9]{2})$"
    parts.append(d(pivot(g(p, 2)), mon(g(p, 1)), "'1'"))
    for s in (r"\s+", "-", "/"):
        p = f"^([0-9]{{1,2}}){s}([A-Za-z]{{3}}){s}([0-9]{{4}})$"
        parts.append(d(g(p, 3), mon(g(p, 2)), g(p, 1)))
    p = r"([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})"
    y = g(p, 3)
    parts.append(d(f"CASE WHEN try_cast({y} AS integer) < 100 THEN cast(try_cast({y} AS integer) + 2000 AS varchar) ELSE {y} END",
                   g(p, 2), g(p, 1)))
    p = r"([0-9]{1,2})[/\-.]([0-9]{4})"
    parts.append(d(g(p, 2), g(p, 1), "'1'"))
    return "coalesce(" + ",\n  ".join(parts) + ")"


query("parse_label_date", f"""
SELECT o_orderkey, text, {sql_label_date('text')} AS parsed FROM vx_date_texts
""")(lambda spark, sf: date_texts(spark, sf).withColumn("parsed", vx.label_date("text")))

_REPAIR_IN = "CASE WHEN o_orderkey % 3 = 0 THEN replace(text, '/', '1') WHEN o_orderkey % 3 = 1 THEN text ELSE concat(text, ' 6 MONTHS') END"
query("repair_date_text", rf"""
SELECT o_orderkey, CASE WHEN regexp_matches(v, '(?i)(?:MONTHS?|DAYS?|WEEKS?|YEARS?|BEST\s*BEFORE|MANUFACTURE|PACKAGING)')
  THEN trim(regexp_replace(v, {_WS}))
  WHEN regexp_matches(r2, '^[0-9]{{1,2}}[.\-][0-9]{{1,2}}[.\-][0-9]{{2,4}}$') THEN regexp_replace(r2, '[.\-]', '/', 'g')
  ELSE r2 END AS date_text FROM (
SELECT *, regexp_replace(r1, '([0-9]{{1,2}})[1lI|]([0-9]{{1,2}}[/.\-][0-9]{{2,4}})', '\1/\2', 'g') AS r2 FROM (
SELECT *, regexp_replace(v, '([0-9]{{1,2}}[/.\-])([0-9]{{1,2}})[1lI|]([0-9]{{2,4}})', '\1\2/\3', 'g') AS r1 FROM (
SELECT o_orderkey, trim({_REPAIR_IN}) AS v FROM vx_date_texts) a) b) c
""")(lambda spark, sf: date_texts(spark, sf).select(
    "o_orderkey", vx.repair_date_text(F.expr(_REPAIR_IN)).alias("date_text")))

query("utc_time", """
SELECT event_id, ts AS parsed, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events
""")(lambda spark, sf: fx.table(spark, sf, "events").select(
    "event_id",
    F.to_timestamp_ntz(F.date_format(vx.utc_time(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"),
                       F.date_format("ts", "HH:mm:ss.SSSSSS"))), "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("parsed"),
    F.date_format(vx.utc_time(F.col("ts").cast("string")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso")))

# ------------------------------------------------------------------- glyphs

query("fix_glyphs", """
SELECT inspection_id, line_no, translate(text, 'OoIl|ZzSsBGq', '001112255869') AS digits_text FROM fx_label_lines
""")(lambda spark, sf: fx.label_lines(spark, sf).select(
    "inspection_id", "line_no", tx.fix_glyphs("text").alias("digits_text")))

SQL_LICENCE = r"""nullif(regexp_extract(translate(regexp_replace(text, '(?i)[fsailcno|.:\s]', '', 'g'),
  'OoIl|ZzSsBGq', '001112255869'), '\b([12][0-9]{13})\b', 1), '')"""
query("extract_licence_14", f"SELECT inspection_id, line_no, {SQL_LICENCE} AS licence FROM fx_label_lines")(
    lambda spark, sf: fx.label_lines(spark, sf).select(
        "inspection_id", "line_no", tx.licence_14("text").alias("licence")))

_DEVA = "०१२३४५६७८९"
_ALL_INDIC = "".join(chr(z + i) for z in C.INDIC_ZEROES for i in range(10))
query("indic_digits", f"""
SELECT inspection_id, line_no, translate(translate(text, '0123456789', '{_DEVA}'), '{_ALL_INDIC}',
  '{"0123456789" * 9}') AS text_ascii FROM fx_label_lines
""")(lambda spark, sf: fx.label_lines(spark, sf).select(
    "inspection_id", "line_no",
    tx.indic_digits(F.translate("text", "0123456789", _DEVA)).alias("text_ascii")))


def _mask_sql() -> str:
    """One pattern after the other: what it hits joins the registry, the text between stays."""
    sql = "SELECT inspection_id, line_no, text, text AS masked, CAST([] AS varchar[]) AS hits FROM fx_label_lines"
    for number, pattern in enumerate(tx.PROTECTED_PATTERNS):
        regex = pattern if number in tx.CASED_PATTERNS else "(?i)" + pattern
        sql = f"""SELECT inspection_id, line_no, text, array_to_string(list_transform(string_split(regexp_replace(masked, '{regex}', chr(1), 'g'), chr(1)),
  lambda part, i: CASE WHEN i <= len(new) THEN concat(part, '__NUM_', len(hits) + i - 1, '__') ELSE part END), '') AS masked, list_concat(hits, new) AS hits
FROM (SELECT *, regexp_extract_all(masked, '{regex}') AS new FROM ({sql}) a{number}) b{number}"""
    return f"SELECT inspection_id, line_no, masked, array_to_string(hits, '|') AS numbers, text AS restored, 0 AS digits_left FROM ({sql}) t"


@query("mask_numbers", _mask_sql())
def _mask(spark, sf):
    masked = tx.mask_numbers(fx.label_lines(spark, sf), "text")
    return masked.select(
        "inspection_id",
        "line_no",
        "masked",
        F.array_join("registry", "|").alias("numbers"),
        tx.unmask_numbers("masked", "registry").alias("restored"),
        F.regexp_count(F.regexp_replace("masked", "__NUM_[0-9]+__", ""),
                       F.lit(r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])")).alias("digits_left"),
    )


query("language_code", f"""
SELECT doc_id, lang, {sql_map(C.LANGUAGES, "lower(trim(lang))", f"'{C.DEFAULT_LANGUAGE}'")} AS lang_code FROM documents
""")(lambda spark, sf: fx.table(spark, sf, "documents").select(
    "doc_id", "lang", tx.language_code("lang").alias("lang_code")))

query("script_of", """
SELECT inspection_id, line_no, CASE WHEN regexp_matches(t, '[ऀ-ॿ]')
  THEN 'Bilingual (Latin + Devanagari)' ELSE 'Latin (English)' END AS script FROM (
SELECT *, CASE WHEN seq % 2 = 0 THEN translate(text, '0123456789', '०१२३४५६७८९') ELSE text END AS t FROM fx_label_lines) a
""")(lambda spark, sf: fx.label_lines(spark, sf).select("inspection_id", "line_no", tx.script_of(
    F.when(F.col("seq") % 2 == 0, F.translate("text", "0123456789", _DEVA)).otherwise(F.col("text"))).alias("script")))

_REGION_IN = "CASE line_no WHEN 2 THEN ' Net_Weight' WHEN 3 THEN 'MRP' WHEN 4 THEN 'mfg' WHEN 5 THEN 'expiry' WHEN 7 THEN 'fssai' WHEN 11 THEN 'ingredients' WHEN 12 THEN 'qr_code' ELSE 'sticker' END"
query("region_label", f"""
SELECT inspection_id, line_no, {sql_map(C.REGION_LABELS, f"lower(trim({_REGION_IN}))", f"'{C.DEFAULT_REGION}'")} AS region
FROM fx_label_lines
""")(lambda spark, sf: fx.label_lines(spark, sf).select(
    "inspection_id", "line_no", tx.region_label(F.expr(_REGION_IN)).alias("region")))

_FIELD_IN = "CASE line_no % 6 WHEN 0 THEN 'MRP' WHEN 1 THEN 'net-quantity' WHEN 2 THEN 'shelf_life_note' WHEN 3 THEN 'batch number' WHEN 4 THEN '' ELSE field_name END"
query("friendly_field", f"""
SELECT inspection_id, line_no, {sql_map(C.FIELD_LABELS, r"regexp_replace(lower(f), '[\s\-]+', '_', 'g')",
  "CASE WHEN f = '' THEN 'Statutory Requirement' ELSE array_to_string(list_transform(string_split(replace(f, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') END")} AS label
FROM (SELECT *, {_FIELD_IN} AS f FROM fx_checks) t
""")(lambda spark, sf: fx.checks(spark, sf).select(
    "inspection_id", "line_no", tx.friendly_field(F.expr(_FIELD_IN)).alias("label")))

_TYPED = "CASE l_linenumber % 7 WHEN 0 THEN concat('IMG_', cast(l_partkey AS {s})) WHEN 1 THEN 'photo.png' WHEN 2 THEN 'item' WHEN 3 THEN 'Hzdfljdfif' WHEN 4 THEN concat('AB', cast(100000 + l_partkey AS {s})) WHEN 5 THEN 'Red Rice' ELSE '' END"
_DETECTED = "CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'in powder form' WHEN 2 THEN 'TURMERIC' ELSE 'Wheat Flour' END"
query("clean_title", rf"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE
  WHEN i = '' OR lower(i) IN ({sql_list(C.DEFAULT_TITLES)}) THEN coalesce(d, '{C.DEFAULT_TITLE}')
  WHEN regexp_matches(i, '(?i)\.(?:jpg|jpeg|png|webp|bmp|tiff|heic)$') THEN coalesce(d, regexp_replace(i, '\.[^.]+$', ''))
  WHEN regexp_matches(i, '(?i)^(?:IMG|DSC|PXL|PHOTO|IMAGE|SCREENSHOT|WHATSAPP|SCAN|DOC)[_\-\s0-9]')
    OR (len(regexp_extract_all(i, '[A-Za-z]')) >= 6 AND len(regexp_extract_all(i, '(?i)[aeiouy]')) < 0.18 * len(regexp_extract_all(i, '[A-Za-z]')))
    THEN coalesce(d, '{C.DEFAULT_TITLE}')
  WHEN d IS NOT NULL AND regexp_matches(i, '^[A-Za-z0-9_\-]{{8,}}$') THEN d
  WHEN length(i) >= 3 THEN i ELSE coalesce(d, i) END AS title
FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_TYPED.replace('{s}', 'varchar')} AS i,
  CASE WHEN l_suppkey % 4 = 2 THEN 'TURMERIC' WHEN l_suppkey % 4 = 3 THEN 'Wheat Flour' END AS d FROM lineitem) t
""")(lambda spark, sf: fx.table(spark, sf, "lineitem").select(
    "l_orderkey", "l_linenumber", "l_partkey",
    tx.clean_title(F.expr(_TYPED.replace("{s}", "string")), F.expr(_DETECTED)).alias("title")))

query("json_or_default", """
SELECT event_id, coalesce(try_cast(json_extract_string(CASE WHEN event_id % 3 = 0 THEN 'broken {' ELSE props END, '$.k') AS bigint), -1) AS k
FROM (SELECT event_id, props FROM events) t WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 3 = 0
""")(lambda spark, sf: fx.table(spark, sf, "events").select(
    "event_id",
    F.coalesce(F.from_json(F.when(F.col("event_id") % 3 == 0, "broken {").otherwise(F.col("props")),
                           "k bigint")["k"], F.lit(-1)).alias("k")))

# -------------------------------------------------------------------- boxes

query("box_canonical", """
SELECT inspection_id, line_no, x1, y1, x2, y2, greatest(y2 - y1, 0) AS height FROM fx_label_lines
""")(lambda spark, sf: fx.label_lines(spark, sf).select(
    "inspection_id", "line_no",
    F.coalesce(
        vx.polygon_box(F.when(F.col("line_no") % 2 == 0, F.array(
            F.array("x2", "y1"), F.array("x1", "y1"), F.array("x1", "y2"), F.array("x2", "y2")))),
        vx.flat_box(F.array("x1", "y1", "x2", "y2"))).alias("box"))
     .select("inspection_id", "line_no", "box.*", F.greatest(F.col("box.y2") - F.col("box.y1"), F.lit(0.0)).alias("height")))

query("canonical_token", """
SELECT inspection_id, line_no, trim(text) AS text,
  CASE WHEN seq % 2 = 0 THEN confidence ELSE confidence / 100.0 * 100 END AS confidence,
  CASE WHEN seq % 5 = 0 THEN 0.0 ELSE x1 END AS x, CASE WHEN seq % 5 = 0 THEN line_no * 40.0 ELSE y1 END AS y
FROM fx_label_lines
""")(lambda spark, sf: fx.label_lines(spark, sf)
     .withColumn("translated_text", F.when(F.col("seq") % 3 == 0, F.col("text")))
     .withColumn("text", F.when(F.col("seq") % 3 != 0, F.col("text")))
     .withColumn("score", F.when(F.col("seq") % 2 == 0, F.col("confidence")).otherwise(F.col("confidence") / 100.0))
     .withColumn("box", F.when(F.col("seq") % 5 != 0, F.struct("x1", "y1", "x2", "y2")))
     .select(
         "inspection_id", "line_no",
         F.trim(F.coalesce("text", "translated_text")).alias("text"),
         vx.scaled_confidence("score").alias("confidence"),
         F.coalesce("box.x1", F.lit(0.0)).alias("x"),
         F.coalesce("box.y1", F.col("line_no") * 40.0).alias("y")))

query("evidence_id", """
SELECT inspection_id, line_no, concat('EVID_', field, '_', lpad(cast(n AS varchar), cast(greatest(2, length(cast(n AS varchar))) AS integer), '0'))
  AS evidence_id FROM (
SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY line_no) AS n,
  CASE WHEN line_no % 2 = 0 THEN 'DATE' ELSE 'MRP' END AS field FROM fx_label_lines) t
""")(lambda spark, sf: slices.running_position(
    fx.label_lines(spark, sf).select("inspection_id", "line_no"), ["inspection_id"], [F.col("line_no")], "n")
     .select("inspection_id", "line_no", F.format_string(
         "EVID_%s_%02d", F.when(F.col("line_no") % 2 == 0, "DATE").otherwise("MRP"), F.col("n")).alias("evidence_id")))
