"""Field extraction and token queries over label lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark import fixtures as fx
from panelmark.operators import extract as ex
from panelmark.operators import tokens as tk
from panelmark.plans import catalog
from panelmark.queries.registry import EXTRA_VIEWS, query
from panelmark.queries.scalars import SQL_BAD_NAME, sql_any, sql_list


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def hit(pattern: str, group: int = 1, column: str = "text") -> str:
    return f"nullif(regexp_extract({column}, {rx(pattern)}, {group}), '')"


def has(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {rx(pattern)})"


def first(value: str, condition: str) -> str:
    return f"arg_min({value}, line_no) FILTER ({condition})"


lines = fx.label_lines

# ------------------------------------------------------------ field extraction

_P, _L = f"try_cast(replace({hit(ex.PRICE_ANCHORED)}, ',', '') AS double)", f"try_cast(replace({hit(ex.PRICE_CURRENCY)}, ',', '') AS double)"
_TAX = has(ex.TAX_STATED)
query("extract_mrp", f"""
SELECT inspection_id, coalesce(a_price, b_price) AS price,
  CASE WHEN a_price IS NOT NULL THEN a_tax ELSE b_tax END AS tax_stated FROM (
SELECT inspection_id, {first(_P, _P + ' IS NOT NULL')} AS a_price,
  {first(f"{_TAX} OR contains(lower(text), 'all taxes')", _P + ' IS NOT NULL')} AS a_tax,
  {first(_L, _L + ' IS NOT NULL')} AS b_price, {first(_TAX, _L + ' IS NOT NULL')} AS b_tax
FROM fx_label_lines GROUP BY inspection_id) t WHERE coalesce(a_price, b_price) IS NOT NULL
""")(lambda spark, sf: ex.extract_mrp(lines(spark, sf)).select("inspection_id", "price", "tax_stated"))

_UNIT_VALUES = ", ".join(f"('{s}', '{u}', '{b}', {m!r}::double)" for s, (u, b, m) in C.UNITS.items())
EXTRA_VIEWS["vx_units"] = f"SELECT * FROM (VALUES {_UNIT_VALUES}) AS t(spelling, shown, base, multiplier)"
_Q, _QU = hit(ex.QUANTITY_ANCHORED, 1), f"lower({hit(ex.QUANTITY_ANCHORED, 2)})"
_S, _SU = hit(ex.QUANTITY_BARE, 1), f"lower({hit(ex.QUANTITY_BARE, 2)})"
_SKIP = f"({_SU} IN ('m', 'month', 'months') AND regexp_matches(lower(text), 'best|before|pkd'))"
query("extract_net_quantity", f"""
SELECT inspection_id, quantity, unit, coalesce(shown, unit) AS shown_unit, coalesce(base, unit) AS base_unit,
  coalesce(round(quantity * multiplier, 4), quantity) AS base_value FROM (
SELECT inspection_id, cast(coalesce(q, s) AS double) AS quantity, CASE WHEN q IS NOT NULL THEN qu ELSE su END AS unit FROM (
  SELECT inspection_id, {first(_Q, _Q + ' IS NOT NULL')} AS q, {first(_QU, _Q + ' IS NOT NULL')} AS qu,
    {first(_S, f'{_S} IS NOT NULL AND NOT {_SKIP}')} AS s, {first(_SU, f'{_S} IS NOT NULL AND NOT {_SKIP}')} AS su
  FROM fx_label_lines GROUP BY inspection_id) a WHERE coalesce(q, s) IS NOT NULL) b LEFT JOIN vx_units ON spelling = unit
""")(lambda spark, sf: ex.extract_net_quantity(lines(spark, sf), catalog.unit_table(spark)).select(
    "inspection_id", "quantity", "unit", "shown_unit", "base_unit", "base_value"))


@query("unit_lookup", r"""
SELECT inspection_id, line_no, unit, coalesce(shown, unit) AS shown_unit, coalesce(base, unit) AS base_unit,
  coalesce(round(quantity * multiplier, 4), quantity) AS base_value FROM (
SELECT inspection_id, line_no, cast(nullif(regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)', 1), '') AS double) AS quantity,
  lower(regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)', 2)) AS unit FROM fx_label_lines) t
LEFT JOIN vx_units ON spelling = unit WHERE unit <> ''
""")
def _units(spark, sf):
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]+)"
    amounts = lines(spark, sf).select(
        "inspection_id", "line_no",
        F.regexp_extract("text", pattern, 1).try_cast("double").alias("quantity"),
        F.lower(F.regexp_extract("text", pattern, 2)).alias("unit"),
    ).where("unit <> ''")
    return ex.with_units(amounts, "quantity", "unit", catalog.unit_table(spark)).select(
        "inspection_id", "line_no", "unit", "shown_unit", "base_unit", "base_value")


def sql_line_date(column: str) -> str:
    shapes = dict(ex.DATE_SHAPES)

    def g(name: str, group: int) -> str:
        return hit(shapes[name], group, column)

    def two(x: str) -> str:
        return f"lpad({x}, 2, '0')"

    def mon(x: str) -> str:
        cases = " ".join(f"WHEN '{m}' THEN '{i + 1:02d}'" for i, m in enumerate(C.MONTHS))
        return f"CASE WHEN {x} IS NULL THEN NULL ELSE CASE upper(substr({x}, 1, 3)) {cases} ELSE '01' END END"

    y = g("mY", 2)
    return f"""coalesce({g('dmy', 3)} || '-' || {two(g('dmy', 2))} || '-' || {two(g('dmy', 1))},
  {g('ymd', 1)} || '-' || {two(g('ymd', 2))} || '-' || {two(g('ymd', 3))},
  {g('dby', 3)} || '-' || {mon(g('dby', 2))} || '-' || {two(g('dby', 1))},
  {g('by', 2)} || '-' || {mon(g('by', 1))}, {g('my', 2)} || '-' || {two(g('my', 1))},
  cast(CASE WHEN cast({y} AS integer) < 70 THEN 2000 ELSE 1900 END + cast({y} AS integer) AS varchar) || '-' || {two(g('mY', 1))})"""


query("extract_dates", f"""
WITH l AS (SELECT inspection_id, line_no, {sql_line_date('text')} AS iso, {has(ex.MADE_PREFIX)} AS made,
    {has(ex.EXPIRY_PREFIX)} AS expires, {hit(ex.SHELF_LIFE, 0)} IS NOT NULL AS life,
    concat_ws(' ', {hit(ex.SHELF_LIFE, 1)}, lower({hit(ex.SHELF_LIFE, 2)}), 'from', coalesce({hit(ex.SHELF_LIFE, 3)}, 'MFD')) AS said
  FROM fx_label_lines),
m AS (SELECT inspection_id, min(line_no) FILTER (made AND iso IS NOT NULL) AS made_at,
    min(line_no) FILTER (NOT made AND NOT expires AND iso IS NOT NULL) AS plain_at,
    min(line_no) FILTER (expires AND (life OR iso IS NOT NULL)) AS exp_at FROM l GROUP BY inspection_id),
n AS (SELECT inspection_id, exp_at, CASE WHEN plain_at < coalesce(made_at, 99) AND plain_at < coalesce(exp_at, 99)
    THEN plain_at ELSE made_at END AS made_at FROM m)
SELECT n.inspection_id, a.iso AS manufacturing_date, CASE WHEN NOT b.life THEN b.iso END AS expiry_date,
  CASE WHEN b.life THEN b.said END AS shelf_life FROM n
LEFT JOIN l a ON a.inspection_id = n.inspection_id AND a.line_no = n.made_at
LEFT JOIN l b ON b.inspection_id = n.inspection_id AND b.line_no = n.exp_at
WHERE n.made_at IS NOT NULL OR n.exp_at IS NOT NULL
""")(lambda spark, sf: ex.extract_dates(lines(spark, sf)))

query("extract_relative_expiry", f"""
SELECT inspection_id, cast({hit(ex.SHELF_LIFE, 1)} AS integer) AS amount, lower({hit(ex.SHELF_LIFE, 2)}) AS unit,
  upper(coalesce({hit(ex.SHELF_LIFE, 3)}, 'MFD')) AS event FROM fx_label_lines
WHERE {has(ex.EXPIRY_PREFIX)} AND {hit(ex.SHELF_LIFE, 1)} IS NOT NULL
""")(lambda spark, sf: ex.extract_relative_expiry(lines(spark, sf)))

EXTRA_VIEWS["vx_contacts"] = f"""
SELECT inspection_id, line_no, 'toll_free' AS kind, v AS value, regexp_replace(v, '[^0-9]', '', 'g') AS key, 0 AS rank
  FROM (SELECT inspection_id, line_no, unnest(regexp_extract_all(text, {rx(ex.TOLL_FREE)})) AS v FROM fx_label_lines) a
UNION ALL SELECT inspection_id, line_no, 'phone', v, regexp_replace(v, '[^0-9]', '', 'g'), 1
  FROM (SELECT inspection_id, line_no, unnest(regexp_extract_all(text, {rx(ex.PHONE)}, 1)) AS v FROM fx_label_lines) b
  WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 8 AND 12
UNION ALL SELECT inspection_id, line_no, 'email', lower(v), lower(v), 2
  FROM (SELECT inspection_id, line_no, unnest(regexp_extract_all(text, {rx(ex.EMAIL)})) AS v FROM fx_label_lines) c
UNION ALL SELECT inspection_id, line_no, 'site', v, lower(v), 3
  FROM (SELECT inspection_id, line_no, unnest(regexp_extract_all(text, {rx(ex.SITE)})) AS v FROM fx_label_lines) d
"""
query("extract_contacts", """
SELECT DISTINCT ON (inspection_id, CASE WHEN kind = 'phone' THEN 'toll_free' ELSE kind END, key) inspection_id,
  CASE WHEN kind = 'phone' AND key LIKE '1800%' THEN 'toll_free' ELSE kind END AS kind, value, line_no FROM vx_contacts
ORDER BY inspection_id, CASE WHEN kind = 'phone' THEN 'toll_free' ELSE kind END, key, line_no, rank
""")(lambda spark, sf: ex.extract_contacts(lines(spark, sf)).select("inspection_id", "kind", "value", "line_no"))

query("customer_care_rollup", """
SELECT inspection_id, coalesce(string_agg(value, ', ' ORDER BY line_no) FILTER (rank < 2), '') AS phones,
  coalesce(string_agg(value, ', ' ORDER BY line_no) FILTER (rank = 2), '') AS emails,
  min(value) FILTER (rank = 3) AS site,
  coalesce(arg_min(value, line_no) FILTER (rank < 2), arg_min(value, line_no) FILTER (rank = 2), min(value) FILTER (rank = 3)) AS primary_contact
FROM (SELECT DISTINCT ON (inspection_id, key) * FROM vx_contacts ORDER BY inspection_id, key, line_no, rank) t GROUP BY inspection_id
""")(lambda spark, sf: ex.customer_care(lines(spark, sf)))

_LA, _LB = hit(ex.LICENCE), r"nullif(regexp_extract(regexp_replace(text, '[\s.\-]', '', 'g'), '\b([12][0-9]{13})\b', 1), '')"
query("extract_licence", f"""
SELECT inspection_id, coalesce(arg_max({_LA}, line_no) FILTER ({_LA} IS NOT NULL), {first(_LB, _LB + ' IS NOT NULL')}) AS licence,
  bool_or({_LA} IS NOT NULL OR {has(ex.LICENCE_LOGO)}) AS logo FROM fx_label_lines GROUP BY inspection_id
HAVING bool_or({_LA} IS NOT NULL OR {has(ex.LICENCE_LOGO)} OR {_LB} IS NOT NULL)
""")(lambda spark, sf: ex.extract_licence(lines(spark, sf)).select("inspection_id", "licence", "logo"))

_O = f"trim({hit(ex.ORIGIN)}, ' .:-')"
query("extract_origin", f"""
SELECT inspection_id, {_O} AS country, contains(lower({_O}), 'india') AS is_home FROM fx_label_lines WHERE {_O} IS NOT NULL
""")(lambda spark, sf: ex.extract_origin(lines(spark, sf)).select("inspection_id", "country", "is_home"))

query("extract_unit_price", f"""
SELECT inspection_id, cast({hit(ex.UNIT_PRICE)} AS double) AS unit_price, trim({hit(ex.UNIT_PRICE, 2)}) AS per
FROM fx_label_lines WHERE {hit(ex.UNIT_PRICE)} IS NOT NULL
""")(lambda spark, sf: ex.extract_unit_price(lines(spark, sf)).select("inspection_id", "unit_price", "per"))

query("extract_maker", f"""
SELECT inspection_id, trim({hit(ex.MAKER)}) AS maker FROM fx_label_lines WHERE {hit(ex.MAKER)} IS NOT NULL
""")(lambda spark, sf: ex.extract_maker(lines(spark, sf)).select("inspection_id", "maker"))

query("extract_batch", r"""
SELECT inspection_id, regexp_extract(text, '(?i)\bBATCH\s*NO\.?[\s:.\-]*([A-Za-z0-9\-/]{3,})', 1) AS batch
FROM fx_label_lines WHERE line_no = 6
""")(lambda spark, sf: ex.extract_batch(lines(spark, sf)).select("inspection_id", "batch"))

query("first_match_per_field", f"""
SELECT inspection_id, 'country' AS field, arg_min({_O}, line_no) FILTER ({_O} IS NOT NULL) AS value FROM fx_label_lines
  GROUP BY inspection_id HAVING bool_or({_O} IS NOT NULL)
UNION ALL SELECT inspection_id, 'maker', arg_min(trim({hit(ex.MAKER)}), line_no) FILTER ({hit(ex.MAKER)} IS NOT NULL)
  FROM fx_label_lines GROUP BY inspection_id HAVING bool_or({hit(ex.MAKER)} IS NOT NULL)
""")(lambda spark, sf: ex.extract_origin(lines(spark, sf)).select(
    "inspection_id", F.lit("country").alias("field"), F.col("country").alias("value")).unionByName(
    ex.extract_maker(lines(spark, sf)).select("inspection_id", F.lit("maker").alias("field"), F.col("maker").alias("value"))))

query("explicit_over_fallback", f"""
SELECT inspection_id, coalesce(a, b) AS price, CASE WHEN a IS NULL THEN 'loose' ELSE 'anchored' END AS strategy FROM (
SELECT inspection_id, {first(_P, _P + ' IS NOT NULL')} AS a, {first(_L, _L + ' IS NOT NULL')} AS b
FROM fx_label_lines GROUP BY inspection_id) t WHERE coalesce(a, b) IS NOT NULL
""")(lambda spark, sf: ex.extract_mrp(lines(spark, sf)).join(
    lines(spark, sf).where(F.col("text").rlike(ex.PRICE_ANCHORED)).select("inspection_id", F.lit("anchored").alias("strategy")).distinct(),
    "inspection_id", "left").select("inspection_id", "price", F.coalesce("strategy", F.lit("loose")).alias("strategy")))

_FLAGS = f"""
SELECT inspection_id, bool_or({_P} IS NOT NULL OR {_L} IS NOT NULL) AS p,
  bool_or({_Q} IS NOT NULL OR ({_S} IS NOT NULL AND NOT {_SKIP})) AS q,
  bool_or(line_no = 4) AS m, bool_or(line_no = 5) AS e, bool_or(line_no = 8) AS c FROM fx_label_lines GROUP BY inspection_id
"""
query("extraction_summary", f"""
SELECT inspection_id, cast(p::int + q::int + m::int + e::int + c::int AS integer) AS found,
  array_to_string(list_filter([CASE WHEN NOT p THEN 'mrp' END, CASE WHEN NOT q THEN 'net_quantity' END,
    CASE WHEN NOT m THEN 'manufacturing_date' END, CASE WHEN NOT e THEN 'expiry_date' END,
    CASE WHEN NOT c THEN 'customer_care' END], lambda x: x IS NOT NULL), ',') AS missing,
  p::int + q::int + m::int + e::int + c::int >= 4 AS ok FROM ({_FLAGS}) t
""")(lambda spark, sf: ex.extraction_summary(lines(spark, sf)))

# ------------------------------------------------------------- one-line readers

_EXACT = r"try_cast(nullif(regexp_extract(text, '\b([0-9]{1,5}\.[0-9]{1,2})\b', 1), '') AS double)"
_LOOSE = r"try_cast(replace(nullif(regexp_extract(text, '(?i)(?:Rs\.?|₹|INR|:)?\s*([0-9,]+(?:[.,][0-9]{1,2})?)', 1), ''), ',', '') AS double)"
EXTRA_VIEWS["vx_line_price"] = f"""
SELECT inspection_id, line_no, confidence, price, coalesce(confidence >= 60 AND price IS NOT NULL AND taxed, false) AS tax_stated,
  CASE WHEN confidence < 60 OR price IS NULL THEN 'CANNOT_VERIFY' WHEN taxed THEN 'CONFORMING' ELSE 'VIOLATION' END AS verdict
FROM (SELECT *, CASE WHEN confidence >= 60 THEN coalesce(CASE WHEN {_EXACT} BETWEEN 0.5 AND 50000 THEN {_EXACT} END,
    CASE WHEN {_LOOSE} BETWEEN 0.5 AND 50000 THEN {_LOOSE} END) END AS price, {has(ex.LINE_TAX)} AS taxed,
    confidence < 60 OR {has(ex.LINE_PRICE_ANCHOR)} OR {has(ex.LINE_PRICE_CURRENCY)} AS is_price FROM fx_label_lines) t WHERE is_price
"""
query("extract_price_line", "SELECT inspection_id, line_no, price, tax_stated, verdict FROM vx_line_price")(
    lambda spark, sf: ex.line_price(lines(spark, sf)).select("inspection_id", "line_no", "price", "tax_stated", "verdict"))

_D = r"regexp_extract_all(translate(text, '.-', '//'), '\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\b', 1)"
EXTRA_VIEWS["vx_line_dates"] = f"""
SELECT inspection_id, line_no, CASE WHEN regexp_matches(lower(text), 'mfg|pkd|mfd') THEN {_D}[1] END AS mfg,
  CASE WHEN regexp_matches(lower(text), 'exp|use by|best before') THEN CASE WHEN len({_D}) = 1 THEN {_D}[1] ELSE {_D}[2] END END AS exp
FROM fx_label_lines
"""
query("extract_dates_line", "SELECT inspection_id, line_no, mfg, exp FROM vx_line_dates")(
    lambda spark, sf: ex.line_dates(lines(spark, sf)).select("inspection_id", "line_no", "mfg", "exp"))

_LIC14 = r"""nullif(regexp_extract(translate(regexp_replace(text, '(?i)[fsailcno|.:\s]', '', 'g'),
  'OoIl|ZzSsBGq', '001112255869'), '\b([12][0-9]{13})\b', 1), '')"""
EXTRA_VIEWS["vx_routed"] = f"""
SELECT d.inspection_id, l.licence, d.mfg, d.exp, p.price, p.verdict, l.any_tax FROM
 (SELECT inspection_id, arg_min(mfg, line_no) FILTER (mfg IS NOT NULL) AS mfg, arg_min(exp, line_no) FILTER (exp IS NOT NULL) AS exp
  FROM vx_line_dates GROUP BY inspection_id) d
JOIN (SELECT inspection_id, arg_min({_LIC14}, line_no) FILTER ({_LIC14} IS NOT NULL) AS licence, bool_or({has(ex.LINE_TAX)}) AS any_tax
      FROM fx_label_lines GROUP BY inspection_id) l USING (inspection_id)
LEFT JOIN (SELECT inspection_id, arg_min(price, line_no) AS price, arg_min(verdict, line_no) AS verdict
      FROM vx_line_price WHERE price IS NOT NULL GROUP BY inspection_id) p USING (inspection_id)
"""
query("route_by_region", "SELECT * FROM vx_routed")(lambda spark, sf: ex.route_by_region(lines(spark, sf)))
query("global_tax_override", """
SELECT inspection_id, price, CASE WHEN any_tax AND price IS NOT NULL THEN 'CONFORMING' ELSE verdict END AS verdict FROM vx_routed
""")(lambda spark, sf: ex.global_tax_override(
    ex.route_by_region(lines(spark, sf)).select("inspection_id", "price", "verdict"), lines(spark, sf)))

# ------------------------------------------------------------------ whole label


_ALL_DIGITS = "".join(chr(zero + i) for zero in C.INDIC_ZEROES for i in range(10))
EXTRA_VIEWS["vx_priced_lines"] = f"""
SELECT inspection_id, line_no, translate(text, '{_ALL_DIGITS}', '{"0123456789" * 9}') AS text, confidence FROM fx_label_lines
UNION ALL SELECT inspection_id, line_no, translate(text, '{_ALL_DIGITS}', '{"0123456789" * 9}'), confidence FROM fx_split_lines
"""
# keys and amounts of the split labels lie too far apart for a pair of lines, so the reading text decides
EXTRA_VIEWS["vx_price_across"] = f"""
SELECT inspection_id, replace(regexp_extract(page, {rx(ex.PRICE_ACROSS)}, 1), ',', '.') AS amount, regexp_extract(page, {rx(ex.PRICE_ACROSS)}) AS found
FROM (SELECT inspection_id, string_agg(text, chr(10) ORDER BY line_no) AS page FROM vx_priced_lines GROUP BY 1) t WHERE amount <> ''
"""
EXTRA_VIEWS["vx_priced"] = f"""
SELECT inspection_id, coalesce(line_price, cast(nullif(amount, '') AS double)) AS price, line_price IS NULL AS beyond,
  CASE WHEN line_price IS NULL THEN 92.0 ELSE line_confidence END AS confidence, taxed, u, per FROM (
SELECT inspection_id, arg_min(cast(replace({hit(ex.LABEL_PRICE, 2)}, ',', '.') AS double), line_no) FILTER ({hit(ex.LABEL_PRICE, 2)} IS NOT NULL) AS line_price,
  arg_min(confidence, line_no) FILTER ({hit(ex.LABEL_PRICE, 2)} IS NOT NULL) AS line_confidence, bool_or({has(ex.TAX_NEAR)}) AS taxed,
  arg_min(cast({hit(ex.INLINE_UNIT_PRICE)} AS double), line_no) FILTER ({hit(ex.INLINE_UNIT_PRICE)} IS NOT NULL) AS u,
  arg_min(lower({hit(ex.INLINE_UNIT_PRICE, 2)}), line_no) FILTER ({hit(ex.INLINE_UNIT_PRICE)} IS NOT NULL) AS per
FROM vx_priced_lines GROUP BY 1) l LEFT JOIN vx_price_across USING (inspection_id)
WHERE coalesce(line_price, cast(nullif(amount, '') AS double)) IS NOT NULL
"""


def priced_lines(spark, sf):
    """All labels, those with split prices and digits of other scripts among them."""
    return lines(spark, sf).unionByName(fx.split_lines(spark, sf))


@query("price_with_verdict", """
SELECT inspection_id, price, taxed AS tax_stated,
  CASE WHEN confidence < 60 THEN 'CANNOT_VERIFY' WHEN taxed THEN 'CONFORMING' ELSE 'VIOLATION' END AS verdict FROM vx_priced
""")
def _verdict(spark, sf):
    tokens = priced_lines(spark, sf)
    prices = ex.price_with_verdict(tokens)
    return ex.with_price_verdict(prices, ex.near_rows_tax(tokens, prices)).select(
        "inspection_id", "price", "tax_stated", "verdict")


query("price_across_lines", """
SELECT a.inspection_id, cast(amount AS double) AS price, found AS raw_line FROM vx_price_across a
""")(lambda spark, sf: ex.price_across_lines(ex.readable(priced_lines(spark, sf)).drop("raw_line")).select(
    "inspection_id", F.col("amount").cast("double").alias("price"), "raw_line"))

# what the split labels declare, apart from names, which every line may give
EXTRA_VIEWS["vx_split_decl"] = f"""
SELECT inspection_id, 'mrp' AS field_name, printf('₹%.2f', price) AS value, price AS numeric_value, confidence,
  CASE WHEN confidence < 60 THEN 'CANNOT_VERIFY' WHEN taxed THEN 'CONFORMING' ELSE 'VIOLATION' END AS verdict,
  CASE WHEN beyond THEN found ELSE raw END AS raw_line
FROM vx_priced JOIN (SELECT inspection_id, arg_min(text, line_no) AS raw FROM fx_split_lines GROUP BY 1) r USING (inspection_id)
LEFT JOIN vx_price_across USING (inspection_id)
UNION ALL SELECT inspection_id, 'mrp', printf('₹%.2f', cast({hit(ex.PRICE_CURRENCY)} AS double)), cast({hit(ex.PRICE_CURRENCY)} AS double), confidence, NULL, text
FROM fx_split_lines WHERE {hit(ex.PRICE_CURRENCY)} IS NOT NULL AND inspection_id NOT IN (SELECT inspection_id FROM vx_priced)
UNION ALL SELECT inspection_id, 'mrp_inclusive_tax', 'Inclusive of all taxes', NULL, confidence, NULL, NULL FROM vx_priced
  WHERE taxed AND starts_with(inspection_id, 'SPL-')
UNION ALL SELECT inspection_id, 'mrp_inclusive_tax', 'Inclusive of all taxes', NULL, arg_min(confidence, line_no), NULL, NULL FROM fx_split_lines
  WHERE {has(ex.TAX_NEAR)} AND inspection_id NOT IN (SELECT inspection_id FROM vx_priced) GROUP BY 1
UNION ALL SELECT inspection_id, 'unit_sale_price', concat(printf('₹%.2f', u), '/', per), u, confidence, NULL, NULL FROM vx_priced
  WHERE u IS NOT NULL AND starts_with(inspection_id, 'SPL-')
UNION ALL SELECT inspection_id, unnest(['net_quantity', 'net_quantity_unit']), unnest([concat(q, '.0 g'), 'g']), unnest([cast(q AS double), NULL]), confidence, NULL, NULL FROM (
  SELECT inspection_id, regexp_extract(translate(text, '{_ALL_DIGITS}', '{"0123456789" * 9}'), '[0-9]+') AS q, confidence FROM fx_split_lines
  WHERE starts_with(text, 'Net Quantity')) n
UNION ALL SELECT inspection_id, 'manufacturing_date', substr(translate(text, '{_ALL_DIGITS}', '{"0123456789" * 9}'), 6), NULL, confidence, NULL, NULL
FROM fx_split_lines WHERE starts_with(text, 'PKD')
"""
_SPLIT_FIELDS = ["mrp", "mrp_inclusive_tax", "unit_sale_price", "net_quantity", "net_quantity_unit", "manufacturing_date"]
query("split_declarations", "SELECT * FROM vx_split_decl")(
    lambda spark, sf: ex.declaration_table(fx.split_lines(spark, sf)).where(F.col("field_name").isin(_SPLIT_FIELDS)).select(
        "inspection_id", "field_name", "value", "numeric_value", "confidence", "verdict", "raw_line"))

query("promo_quantity", f"""
SELECT inspection_id, cast(regexp_extract(page, {rx(ex.PROMO_QUANTITY)}, 1) AS double) AS quantity,
  lower(regexp_extract(page, {rx(ex.PROMO_QUANTITY)}, 2)) AS unit FROM (
SELECT inspection_id, string_agg(text, chr(10) ORDER BY line_no) AS page FROM fx_label_lines GROUP BY inspection_id) t
WHERE regexp_extract(page, {rx(ex.PROMO_QUANTITY)}, 1) <> ''
""")(lambda spark, sf: ex.promo_quantity(lines(spark, sf)))

query("typed_dates", r"""
SELECT inspection_id, CASE WHEN line_no = 4 THEN 'PKD' WHEN text LIKE 'BEST%' THEN 'BEST BEFORE' ELSE 'EXP' END AS type,
  CASE WHEN text LIKE 'BEST%' THEN text ELSE regexp_extract(text, '[0-9/]+$') END AS date_text, line_no
FROM fx_label_lines WHERE line_no IN (4, 5)
""")(lambda spark, sf: ex.typed_dates(lines(spark, sf)).select("inspection_id", "type", "date_text", "line_no"))

# in this view an ingredients line always says something and nothing else is an anchor
EXTRA_VIEWS["vx_ingredients"] = """
SELECT inspection_id, substr(text, 14) AS ingredients, confidence, x1, y1, x2, y2 FROM fx_label_lines WHERE starts_with(text, 'Ingredients: ')
"""
query("extract_ingredients", "SELECT * FROM vx_ingredients")(lambda spark, sf: ex.extract_ingredients(lines(spark, sf)))

_UPPER = "upper(trim(text))"
_SKIP_TITLE = sql_any(_UPPER, C.TITLE_SKIP)
EXTRA_VIEWS["vx_titles"] = rf"""
WITH e AS (SELECT *, min(y1) OVER p AS top, max(y2) OVER p AS bottom, count(*) OVER p AS n,
    row_number() OVER (PARTITION BY inspection_id ORDER BY y1, line_no) AS rank FROM fx_label_lines WINDOW p AS (PARTITION BY inspection_id)),
c AS (SELECT *, CASE WHEN y2 - y1 > 1.8 * greatest(1, x2 - x1) THEN x2 - x1 ELSE y2 - y1 END AS size FROM e
  WHERE (y1 <= top + 0.20 * greatest(1.0, bottom - top) OR rank <= greatest(1, cast(round_even(n * 0.20 + 0.5, 0) AS bigint)))
    AND NOT {SQL_BAD_NAME} AND NOT {_SKIP_TITLE} AND len(regexp_extract_all(text, '[A-Za-z]')) >= 3
    AND NOT regexp_matches(regexp_replace(trim(text), '[\s\-]+', '', 'g'), '^[0-9]{{12,14}}$')),
b AS (SELECT inspection_id, arg_min(y1, (-size, line_no)) AS best_y, max(size) AS best_size FROM c GROUP BY inspection_id)
SELECT inspection_id, string_agg(trim(text), ' ' ORDER BY x1, line_no) AS title, avg(confidence) AS confidence, min(x1) AS x1, min(y1) AS y1,
  max(x2) AS x2, max(y2) AS y2 FROM c JOIN b USING (inspection_id) WHERE abs(y1 - best_y) <= greatest(15.0, best_size * 0.45) AND size >= best_size * 0.55 GROUP BY inspection_id
"""
EXTRA_VIEWS["vx_names"] = rf"""
SELECT inspection_id, coalesce(s.ingredients, t.title, q.name) AS name, coalesce(s.confidence, t.confidence, q.confidence) AS confidence,
  coalesce(s.x1, t.x1, q.x1) AS x1, coalesce(s.y1, t.y1, q.y1) AS y1, coalesce(s.x2, t.x2, q.x2) AS x2, coalesce(s.y2, t.y2, q.y2) AS y2
FROM (SELECT DISTINCT inspection_id FROM fx_label_lines) i
LEFT JOIN (SELECT * FROM vx_ingredients WHERE NOT contains(ingredients, ',')) s USING (inspection_id) LEFT JOIN vx_titles t USING (inspection_id)
LEFT JOIN (SELECT inspection_id, arg_min(trim(text), line_no) AS name, arg_min(confidence, line_no) AS confidence, arg_min(x1, line_no) AS x1,
    arg_min(y1, line_no) AS y1, arg_min(x2, line_no) AS x2, arg_min(y2, line_no) AS y2 FROM fx_label_lines
  WHERE length(trim(text)) >= 3 AND NOT {sql_any(_UPPER, C.PLAIN_LINE_SKIP)} AND NOT {SQL_BAD_NAME} GROUP BY inspection_id) q USING (inspection_id)
WHERE coalesce(s.ingredients, t.title, q.name) IS NOT NULL
"""
query("extract_generic_name", "SELECT inspection_id, name, round(confidence, 6) AS confidence, x1, y1, x2, y2 FROM vx_names")(
    lambda spark, sf: ex.extract_generic_name(lines(spark, sf)).drop("anchored").withColumn("confidence", F.round("confidence", 6)))

_MRP_LINE = f"{hit(ex.LABEL_PRICE, 2)} IS NOT NULL"
_DECIMAL = "cast(replace({}, ',', '.') AS double)"
_RAW = "coalesce(inline_price, u)"
EXTRA_VIEWS["vx_price_facts"] = f"""
SELECT inspection_id, arg_min({_DECIMAL.format(hit(ex.LABEL_PRICE, 2))}, line_no) FILTER ({_MRP_LINE}) AS p,
  arg_min(confidence, line_no) FILTER ({_MRP_LINE}) AS pc,
  arg_min({_DECIMAL.format(hit(ex.PRICE_CURRENCY))}, line_no) FILTER ({hit(ex.PRICE_CURRENCY)} IS NOT NULL) AS l,
  arg_min(confidence, line_no) FILTER ({hit(ex.PRICE_CURRENCY)} IS NOT NULL) AS lc, bool_or({has(ex.TAX_NEAR)}) AS taxed,
  arg_min({_DECIMAL.format(hit(ex.INLINE_UNIT_PRICE))}, line_no) FILTER ({hit(ex.INLINE_UNIT_PRICE)} IS NOT NULL) AS u,
  arg_min(lower({hit(ex.INLINE_UNIT_PRICE, 2)}), line_no) FILTER ({hit(ex.INLINE_UNIT_PRICE)} IS NOT NULL) AS per FROM fx_label_lines GROUP BY inspection_id
"""
_SHOWN_Q = "CASE WHEN q % 1 = 0 THEN concat(cast(cast(q AS bigint) AS varchar), '.0') ELSE cast(q AS varchar) END"
_QUANTITY_OK = f"{hit(ex.LABEL_QUANTITY, 1)} IS NOT NULL"
_BARE_OK = f"{hit(ex.BARE_QUANTITY, 1)} IS NOT NULL"
EXTRA_VIEWS["vx_quantity_facts"] = f"""
SELECT inspection_id, coalesce(pq, q, b) AS q, CASE WHEN pq IS NOT NULL THEN pu WHEN q IS NOT NULL THEN u ELSE bu END AS u,
  CASE WHEN pq IS NOT NULL THEN 95.0 WHEN q IS NOT NULL THEN c ELSE bc END AS c FROM (
SELECT inspection_id, arg_min({_DECIMAL.format(hit(ex.LABEL_QUANTITY, 1))}, line_no) FILTER ({_QUANTITY_OK}) AS q,
  arg_min(lower({hit(ex.LABEL_QUANTITY, 2)}), line_no) FILTER ({_QUANTITY_OK}) AS u, arg_min(confidence, line_no) FILTER ({_QUANTITY_OK}) AS c,
  arg_min({_DECIMAL.format(hit(ex.BARE_QUANTITY, 1))}, line_no) FILTER ({_BARE_OK}) AS b, arg_min(lower({hit(ex.BARE_QUANTITY, 2)}), line_no) FILTER ({_BARE_OK}) AS bu,
  arg_min(confidence, line_no) FILTER ({_BARE_OK}) AS bc FROM fx_label_lines GROUP BY inspection_id) a
LEFT JOIN (SELECT inspection_id, cast(regexp_extract(page, {rx(ex.PROMO_QUANTITY)}, 1) AS double) AS pq, lower(regexp_extract(page, {rx(ex.PROMO_QUANTITY)}, 2)) AS pu FROM (
  SELECT inspection_id, string_agg(text, chr(10) ORDER BY line_no) AS page FROM fx_label_lines GROUP BY 1) t
  WHERE regexp_extract(page, {rx(ex.PROMO_QUANTITY)}, 1) <> '') b USING (inspection_id) WHERE coalesce(pq, q, b) IS NOT NULL
"""
# one SELECT per field; lines missing from a label leave no key behind, so the layout search adds nothing here
EXTRA_VIEWS["vx_label_decl"] = f"""
SELECT inspection_id, 'mrp' AS field_name, printf('₹%.2f', coalesce(p, l)) AS value, CASE WHEN p IS NOT NULL THEN pc ELSE lc END AS confidence,
  CASE WHEN p IS NULL THEN NULL WHEN pc < 60 THEN 'CANNOT_VERIFY' WHEN taxed THEN 'CONFORMING' ELSE 'VIOLATION' END AS verdict FROM vx_price_facts WHERE coalesce(p, l) IS NOT NULL
UNION ALL SELECT inspection_id, 'mrp_inclusive_tax', 'Inclusive of all taxes', CASE WHEN p IS NOT NULL THEN pc ELSE lc END, NULL FROM vx_price_facts WHERE taxed
UNION ALL SELECT inspection_id, 'unit_sale_price', concat(printf('₹%.2f', u), '/', per), CASE WHEN p IS NOT NULL THEN pc ELSE lc END, NULL FROM vx_price_facts
  WHERE u > 0 AND p IS NOT NULL
UNION ALL SELECT inspection_id, 'net_quantity', concat({_SHOWN_Q}, ' ', u), c, NULL FROM vx_quantity_facts
UNION ALL SELECT inspection_id, 'net_quantity_unit', u, c, NULL FROM vx_quantity_facts
UNION ALL SELECT inspection_id, 'manufacturing_date', regexp_extract(text, '[0-9/]+$'), confidence, NULL FROM fx_label_lines WHERE line_no = 4
UNION ALL SELECT inspection_id, unnest(['expiry_date', 'best_before']), CASE WHEN starts_with(text, 'BEST') THEN text ELSE regexp_extract(text, '[0-9/]+$') END, confidence, NULL
  FROM fx_label_lines WHERE line_no = 5
UNION ALL SELECT inspection_id, 'batch_number', substr(text, 11), confidence, NULL FROM fx_label_lines WHERE line_no = 6 AND confidence >= 85
UNION ALL SELECT inspection_id, 'consumer_care', regexp_replace(substr(text, 16), ' [|] ', ' | '), 90.0, NULL FROM fx_label_lines WHERE line_no = 8
UNION ALL SELECT inspection_id, 'fssai_license', substr(text, 15), confidence, NULL FROM fx_label_lines WHERE line_no = 7
UNION ALL SELECT inspection_id, 'country_of_origin', substr(text, 20), confidence, NULL FROM fx_label_lines WHERE line_no = 9
UNION ALL SELECT inspection_id, 'manufacturer', substr(text, 18), confidence, NULL FROM fx_label_lines WHERE line_no = 10
UNION ALL SELECT inspection_id, unnest(['generic_name', 'common_generic_name', 'product_name']), name, confidence, NULL FROM vx_names
UNION ALL SELECT inspection_id, unnest(['ingredients', 'ingredient_list']), ingredients, confidence, NULL FROM vx_ingredients
"""
query("declaration_table", "SELECT inspection_id, field_name, value, round(confidence, 6) AS confidence, verdict FROM vx_label_decl")(
    lambda spark, sf: ex.declaration_table(lines(spark, sf)).select(
        "inspection_id", "field_name", "value", F.round("confidence", 6).alias("confidence"), "verdict"))

# ---------------------------------------------------------------------- tokens

EXTRA_VIEWS["vx_noisy"] = """
SELECT inspection_id, seq, line_no, text, confidence, x1, y1, x2, y2, 0 AS pass_no FROM fx_label_lines
UNION ALL SELECT inspection_id, seq, line_no, text, confidence - 5 + seq % 11, x1 + 3, y1 + 2, x2 + 3, y2 + 2, 1 FROM fx_label_lines
WHERE line_no % 2 = 0
"""


def noisy(spark, sf):
    """Two reads of a page, the second a few pixels off."""
    columns = ["inspection_id", "seq", "line_no", "text", "confidence", "x1", "y1", "x2", "y2"]
    tokens = lines(spark, sf).select(*columns)
    again = tokens.where("line_no % 2 = 0").withColumn("confidence", F.expr("confidence - 5 + seq % 11"))
    return tk.union_passes([(tokens, 0.0, 0.0), (again, 3.0, 2.0)])


_BOXED = "inspection_id, line_no, pass_no, x1, y1, x2, y2"
query("union_passes", f"SELECT {_BOXED} FROM vx_noisy")(
    lambda spark, sf: noisy(spark, sf).select(*_BOXED.split(", ")))

query("rotate_back", """
SELECT inspection_id, line_no, CASE seq % 3 WHEN 1 THEN y1 / 2.0 WHEN 2 THEN (1199 - y2) / 2.0 ELSE x1 / 2.0 END AS x1,
  CASE seq % 3 WHEN 1 THEN (1999 - x2) / 2.0 WHEN 2 THEN x1 / 2.0 ELSE y1 / 2.0 END AS y1,
  CASE seq % 3 WHEN 1 THEN y2 / 2.0 WHEN 2 THEN (1199 - y1) / 2.0 ELSE x2 / 2.0 END AS x2,
  CASE seq % 3 WHEN 1 THEN (1999 - x1) / 2.0 WHEN 2 THEN x2 / 2.0 ELSE y2 / 2.0 END AS y2 FROM fx_label_lines
""")(lambda spark, sf: tk.rotate_back(
    lines(spark, sf).withColumn("turn", F.expr("CASE seq % 3 WHEN 1 THEN 90 WHEN 2 THEN 270 ELSE 0 END")),
    "turn", F.lit(2.0), F.lit(2000.0), F.lit(1200.0)).select("inspection_id", "line_no", "x1", "y1", "x2", "y2"))

query("grid_dedup", """
SELECT DISTINCT ON (inspection_id, lower(trim(text)), cx, cy) inspection_id, line_no, confidence FROM (
SELECT *, floor(floor((x1 + x2) / 2) / 15) AS cx, floor(floor((y1 + y2) / 2) / 15) AS cy FROM vx_noisy) t
ORDER BY inspection_id, lower(trim(text)), cx, cy, line_no, confidence
""")(lambda spark, sf: tk.grid_dedup(noisy(spark, sf)).select("inspection_id", "line_no", "confidence"))

# in this view a line overlaps only its own second read, so greedy removal
# leaves the more confident of the two
query("nms_dedup", """
SELECT DISTINCT ON (inspection_id, line_no) inspection_id, line_no, pass_no, confidence FROM vx_noisy
ORDER BY inspection_id, line_no, confidence DESC, pass_no
""")(lambda spark, sf: tk.nms_dedup(noisy(spark, sf)).select("inspection_id", "line_no", "pass_no", "confidence"))

query("reading_order", """
SELECT inspection_id, line_no, row_number() OVER (PARTITION BY inspection_id ORDER BY floor(y1 / 10), x1, line_no) AS position
FROM fx_label_lines
""")(lambda spark, sf: tk.reading_order(lines(spark, sf)).select("inspection_id", "line_no", "position"))

query("reading_rows", f"""
WITH RECURSIVE t AS (SELECT inspection_id, line_no, y1 * 0.4 AS y FROM fx_label_lines),
s AS (SELECT inspection_id, min(y) AS start, 1 AS row_no FROM t GROUP BY inspection_id
  UNION ALL SELECT s.inspection_id, (SELECT min(t.y) FROM t WHERE t.inspection_id = s.inspection_id AND t.y > s.start + 45), row_no + 1
  FROM s WHERE start IS NOT NULL)
SELECT t.inspection_id, t.line_no, cast(max(s.row_no) AS integer) AS row_no FROM t JOIN s ON s.inspection_id = t.inspection_id AND s.start <= t.y
GROUP BY t.inspection_id, t.line_no
""")(lambda spark, sf: tk.reading_rows(
    lines(spark, sf).withColumn("y1", F.col("y1") * 0.4)).select("inspection_id", "line_no", "row_no"))

query("full_text", """
SELECT inspection_id, string_agg(text, chr(10) ORDER BY line_no) AS full_text FROM fx_label_lines GROUP BY inspection_id
""")(lambda spark, sf: tk.full_text(lines(spark, sf)))

query("tax_neighbourhood", """
SELECT p.inspection_id, p.line_no, count(t.line_no) FILTER (abs(t.line_no - p.line_no) <= 5) > 0 AS near,
  count(t.line_no) > 0 AS tax_found FROM (SELECT * FROM fx_label_lines WHERE line_no = 12) p
LEFT JOIN (SELECT * FROM fx_label_lines WHERE contains(lower(text), 'taxes') OR contains(text, 'Nepal')) t USING (inspection_id)
GROUP BY p.inspection_id, p.line_no
""")(lambda spark, sf: tk.tax_neighbourhood(
    lines(spark, sf).withColumn("row_no", F.col("line_no")), F.col("line_no") == 12,
    F.lower("text").contains("taxes") | F.col("text").contains("Nepal")).select("inspection_id", "line_no", "near", "tax_found"))

EXTRA_VIEWS["vx_declared_boxes"] = """
SELECT inspection_id, line_no, x1 + shift AS x1, y1 + 1 AS y1, x2 - 20 + shift AS x2, y2 - 1 AS y2
FROM (SELECT *, CASE WHEN line_no IN (2, 3, 6) THEN 2 ELSE (x2 - x1) / 2 + 6 END AS shift FROM fx_label_lines) t
"""


def declared_boxes(spark, sf):
    """A box for every line; on lines 2, 3 and 6 it covers the text, elsewhere less than half of it."""
    shift = F.expr("CASE WHEN line_no IN (2, 3, 6) THEN 2 ELSE (x2 - x1) / 2 + 6 END")
    return lines(spark, sf).withColumn("shift", shift).selectExpr(
        "inspection_id", "line_no", "x1 + shift AS x1", "y1 + 1 AS y1", "x2 - 20 + shift AS x2", "y2 - 1 AS y2")


query("unmapped_tokens", """
SELECT inspection_id, line_no FROM fx_label_lines t WHERE NOT EXISTS (SELECT 1 FROM vx_declared_boxes b
 WHERE b.inspection_id = t.inspection_id AND least(t.x2, b.x2) > greatest(t.x1, b.x1) AND least(t.y2, b.y2) > greatest(t.y1, b.y1)
   AND (least(t.x2, b.x2) - greatest(t.x1, b.x1)) * (least(t.y2, b.y2) - greatest(t.y1, b.y1)) > 0.5 * (t.x2 - t.x1) * (t.y2 - t.y1))
""")(lambda spark, sf: tk.unmapped_tokens(lines(spark, sf), declared_boxes(spark, sf)).select("inspection_id", "line_no"))

query("unmapped_union", """
SELECT inspection_id, string_agg(text, ' | ' ORDER BY line_no) AS texts, count(*) AS n FROM fx_label_lines
WHERE line_no NOT IN (2, 3, 6) GROUP BY inspection_id
""")(lambda spark, sf: tk.unmapped_tokens(lines(spark, sf), declared_boxes(spark, sf)).groupBy("inspection_id").agg(
    F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda p: p["text"]), " | ").alias("texts"),
    F.count("*").alias("n")))

_PACK = "upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
EXTRA_VIEWS["vx_values"] = """
SELECT inspection_id, 'mrp' AS field_name, regexp_extract(text, '[0-9]+\\.[0-9]+') AS value FROM fx_label_lines WHERE line_no = 3
UNION ALL SELECT inspection_id, 'manufacturer', substr(text, 18) FROM fx_label_lines WHERE line_no = 10
UNION ALL SELECT inspection_id, 'batch_number', text FROM fx_label_lines WHERE line_no = 6
UNION ALL SELECT inspection_id, concat('line ', cast(line_no AS varchar)), concat('Care of ', text) FROM fx_label_lines WHERE line_no NOT IN (3, 6, 10)
"""


def values(spark, sf):
    value = F.expr(r"CASE line_no WHEN 3 THEN regexp_extract(text, '[0-9]+[.][0-9]+', 0) WHEN 10 THEN substr(text, 18)"
                   " WHEN 6 THEN text ELSE concat('Care of ', text) END")
    name = F.expr("CASE line_no WHEN 3 THEN 'mrp' WHEN 10 THEN 'manufacturer' WHEN 6 THEN 'batch_number' ELSE concat('line ', line_no) END")
    return lines(spark, sf).select("inspection_id", name.alias("field_name"), value.alias("value"))


_WORDS = "list_distinct(regexp_extract_all(upper({}), '[A-Z0-9]{{3,}}'))"
_COMMON = f"len(list_intersect({_WORDS.format('value')}, {_WORDS.format('text')}))"
EXTRA_VIEWS["vx_scored"] = rf"""
SELECT inspection_id, field_name, line_no, confidence, x1, y1, x2, y2, CASE WHEN v = d THEN 3.0 WHEN contains(d, v) THEN 2.0
  WHEN length(d) >= 3 AND contains(v, d) THEN 1.5
  WHEN length(num) >= 2 AND (contains(d, num) OR contains(upper(text), num)) THEN 1.8
  WHEN {_COMMON} > 0 THEN 1.0 + {_COMMON} / len({_WORDS.format('value')}) END AS score FROM (
SELECT a.field_name, a.value, t.*, {_PACK.format('a.value')} AS v,
  upper(regexp_replace(t.text, '[^\p{{L}}\p{{N}}_]', '', 'g')) AS d, regexp_extract(regexp_extract(a.value, '[0-9]+(?:[.,][0-9]+)?'), '^[^.]*') AS num
FROM vx_values a JOIN fx_label_lines t USING (inspection_id)) u
"""
query("evidence_match", """
SELECT inspection_id, field_name, max(score) AS score, arg_min(confidence, (-score, line_no)) AS confidence, min(x1) AS x1, min(y1) AS y1,
  max(x2) AS x2, max(y2) AS y2, count(*) AS matches FROM vx_scored WHERE score IS NOT NULL GROUP BY inspection_id, field_name
""")(lambda spark, sf: tk.evidence_match(values(spark, sf), lines(spark, sf)).drop("line_no"))

query("token_intersection", f"""
SELECT inspection_id, field_name, line_no, {_COMMON} AS common,
  round({_COMMON} / len({_WORDS.format('value')}), 6) AS ratio FROM vx_values JOIN fx_label_lines USING (inspection_id)
WHERE {_COMMON} > 0
""")(lambda spark, sf: tk.token_intersection(values(spark, sf), lines(spark, sf)).withColumn("ratio", F.round("ratio", 6)))

SQUEEZED = r"upper(regexp_replace({}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"
FALLBACK_WORDS = "list_distinct(regexp_extract_all({}, '[A-Z0-9]{{3,}}'))"
query("evidence_fallback", rf"""
SELECT inspection_id, rule_id, max(score) AS score, arg_min(line_no, (-score, line_no)) AS line_no FROM (
SELECT inspection_id, field_name AS rule_id, line_no, CASE WHEN contains(d, v) OR contains(v, d) THEN 2.0
  WHEN num <> '' AND (contains(d, num) OR contains(text, num)) THEN 1.5
  ELSE len(list_intersect({FALLBACK_WORDS.format('v')}, {FALLBACK_WORDS.format('d')})) / nullif(len({FALLBACK_WORDS.format('v')}), 0) END AS score FROM (
  SELECT a.field_name, t.*, {SQUEEZED.format('a.value')} AS v, {SQUEEZED.format('t.text')} AS d, regexp_extract(a.value, '[0-9]+(?:\.[0-9]+)?') AS num
  FROM vx_values a JOIN fx_label_lines t USING (inspection_id)) u) w WHERE score > 0 GROUP BY inspection_id, rule_id
""")(lambda spark, sf: tk.evidence_fallback(
    values(spark, sf).select("inspection_id", F.col("field_name").alias("rule_id"), F.col("value").alias("observed")),
    lines(spark, sf)).select("inspection_id", "rule_id", "score", "line_no"))

# value on the next line, 60 px below its key
_SPLIT = "CASE WHEN line_no = 3 THEN 'MRP' ELSE text END"
query("spatial_pair", rf"""
SELECT DISTINCT ON (inspection_id) inspection_id, value, value_line, confidence FROM (
SELECT k.inspection_id, v.line_no AS value_line, v.confidence, abs(v.x1 - k.x1) * 5.0 + abs(v.y1 - k.y1) * 0.5 AS a, v.x1 - k.x1 AS dx, v.y1 - k.y1 AS dy,
  trim(regexp_extract(v.text, '(?i)(?:Rs\.?|₹|INR)?\s*[0-9]+(?:[.,][0-9]{{1,2}})?')) AS value, v.text FROM
 (SELECT * FROM fx_label_lines WHERE line_no = 3) k JOIN (SELECT * FROM fx_label_lines WHERE line_no IN (1, 2, 4, 5)) v USING (inspection_id)) t
WHERE value <> '' AND upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) NOT IN ({sql_list(C.STOP_WORDS)}) AND (abs(dx) <= 25 AND abs(dy) <= 150)
ORDER BY inspection_id, a, value_line
""")(lambda spark, sf: tk.spatial_pair(
    lines(spark, sf).withColumn("text", F.expr(_SPLIT)),
    r"(?:M\s*\.?\s*R\s*\.?\s*P\s*\.?|MAX(?:IMUM)?\s*RETAIL\s*PRICE)",
    r"(?:Rs\.?|₹|INR)?\s*[0-9]+(?:[.,][0-9]{1,2})?").select("inspection_id", "value", "value_line", "confidence"))

query("below_anchor", """
SELECT a.inspection_id, b.text AS maker FROM (SELECT * FROM fx_label_lines WHERE line_no = 10) a
JOIN (SELECT * FROM fx_label_lines WHERE line_no = 11) b USING (inspection_id)
""")(lambda spark, sf: tk.below_anchor(lines(spark, sf), ex.MAKER_ANCHOR).select("inspection_id", "maker"))

query("continuation_lines", """
SELECT inspection_id, string_agg(text, ' ' ORDER BY line_no) AS continuation FROM (
SELECT t.*, min(CASE WHEN contains(text, 'Consumer') OR contains(text, 'Country') THEN line_no END) OVER (PARTITION BY inspection_id) AS stop
FROM fx_label_lines t WHERE line_no > 3) u WHERE (stop IS NULL OR line_no < stop)
  AND inspection_id IN (SELECT inspection_id FROM fx_label_lines WHERE line_no = 3) GROUP BY inspection_id
""")(lambda spark, sf: tk.continuation_lines(
    lines(spark, sf).select("inspection_id", F.col("line_no").alias("row_no"), F.col("text").alias("row_text")),
    lines(spark, sf).where("line_no = 3").select("inspection_id", F.col("line_no").alias("anchor_line"), F.col("line_no").alias("anchor_row")),
    "Consumer|Country").select("inspection_id", "continuation"))

query("title_fallback", "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM vx_titles")(
    lambda spark, sf: tk.title_fallback(lines(spark, sf)).withColumn("confidence", F.round("confidence", 6)))

query("translation_memory", """
SELECT inspection_id, line_no, coalesce(d.target, t.text) AS translated, d.target IS NOT NULL AS cached FROM fx_label_lines t
LEFT JOIN (SELECT p_name AS source, min(concat('tr:', upper(p_name))) AS target FROM part WHERE p_size > 25 GROUP BY p_name) d ON d.source = t.text
""")(lambda spark, sf: tk.translation_memory(
    lines(spark, sf), fx.table(spark, sf, "part").where("p_size > 25").selectExpr("p_name AS source", "concat('tr:', upper(p_name)) AS target"))
     .select("inspection_id", "line_no", "translated", "cached"))
