"""Plans that must hold at size: nothing that grows with the input is collected or judged in one place."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.functions import text as tx
from panelmark.functions import values as vx
from panelmark.operators import extract as ex
from panelmark.operators import measures as ms
from panelmark.operators import tokens as tk
from panelmark.plans import applicability as ap
from panelmark.plans import catalog, screening
from panelmark.sources import sinks

TOKENS = ("inspection_id string, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")


def page(spark, packages=3):
    said = ["MRP", "Rs. 45 (incl. of all taxes)", "Net Quantity: 5 g", "Manufactured by:", "ABC Foods"]
    return spark.createDataFrame(
        [(f"P{p}", n, t, 90.0, 40.0, 60.0 * n, 40.0 + 10 * len(t), 60.0 * n + 30) for p in range(packages) for n, t in enumerate(said)], TOKENS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def decl(tokens):
    return tokens.select("inspection_id", F.concat(F.lit("f"), "line_no").alias("field_name"), F.col("text").alias("value"), "confidence",
                         "x1", "y1", "x2", "y2", F.lit(0).alias("image_index"))


@pytest.mark.parametrize("query", [
    lambda t: tk.reading_rows(t), lambda t: tk.evidence_match(decl(t), t), lambda t: tk.token_intersection(decl(t), t),
    lambda t: tk.evidence_fallback(decl(t).select("inspection_id", F.col("field_name").alias("rule_id"), F.col("value").alias("observed")), t),
    lambda t: tk.unmapped_tokens(t, t.limit(4)), lambda t: tk.spatial_pair(t, "MRP", "[0-9]+"), lambda t: tk.below_anchor(t, ex.MAKER_ANCHOR),
    lambda t: ex.price_across_lines(t), lambda t: ex.promo_quantity(t),
    lambda t: sinks.session_documents(t.select("inspection_id").distinct(), decl(t)),
])
def test_lines_are_never_broadcast(spark, query):
    # small as these tables are, the optimizer would broadcast any of them
    assert "BroadcastExchange" not in plan(query(page(spark)))


def told(spark):
    packages = spark.createDataFrame([(f"P{i}", ["Cosmetics", "ALL", None, "pre_packaged_food"][i % 4], True) for i in range(40)],
                                     "inspection_id string, category string, quality_ok boolean")
    return packages, catalog.rules(spark)


def test_packages_meet_rules_without_moving(spark):
    packages, rules = told(spark)
    found = ap.applicable_rules(packages, rules, date(2026, 1, 15))
    text = plan(found)
    assert text.count("BroadcastHashJoin") == 1 and "BuildRight" in text and "SortMergeJoin" not in text


def test_many_rules_meet_shares_of_a_category(spark, monkeypatch):
    packages, rules = told(spark)
    packages = packages.unionByName(packages.limit(5)).unionByName(spark.createDataFrame([(None, "ALL", True)], packages.schema))
    few = ap.applicable_rules(packages, rules, date(2026, 1, 15))
    want = sorted(map(str, few.collect()))
    monkeypatch.setattr(ap, "TRAVELLING", 0)
    many = ap.applicable_rules(packages, rules, date(2026, 1, 15))
    assert many.columns == few.columns and sorted(map(str, many.collect())) == want and want
    assert "BroadcastHashJoin" not in plan(many)


def test_explained_rows_broadcast_constant_tables_only(spark):
    tokens = page(spark)
    checks = decl(tokens).select(
        "inspection_id", F.col("field_name").alias("rule_id"), "field_name", F.lit("PASS").alias("status"), F.lit("").alias("extracted_value"),
        F.col("value").alias("observed"), F.lit("").alias("expected_requirement"), F.lit("").alias("reason"), F.lit("LOW").alias("severity"),
        F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("box"))
    rows = ms.explain_checks(checks, decl(tokens), catalog.explain_alias_table(spark), catalog.box_fallback_table(spark), tokens)
    assert "BroadcastExchange" not in plan(rows) and rows.count() == checks.count()


def test_keys_meet_rows_of_their_block_and_the_next(spark):
    # 70 rows above each key put keys and amounts on both sides of a block's end
    lines = []
    for p, gap in enumerate([1, 3, 40]):
        for n in range(200):
            said = {70: "MRP", 70 + gap: "Rs. 9", 144: "MRP", 144 + gap: "Rs. 7"}.get(n, ".")
            lines.append((f"P{p}", n, said, 90.0, 40.0, 60.0 * n, 80.0, 60.0 * n + 30))
    lines.append((None, 0, "MRP Rs. 5", 90.0, 40.0, 60.0, 80.0, 90.0))
    tokens = spark.createDataFrame(lines, TOKENS)
    near = ex.behind_keys(tokens, "MRP", 80)
    found = {(r["inspection_id"], r["_key_row"]): r["_said"] for r in near.collect()}
    rows = {(r["inspection_id"], r["row_no"]): r["row_text"] for r in tk.row_texts(tk.reading_rows(tokens)).collect()}
    assert sorted(found) == sorted(k for k, text in rows.items() if "MRP" in text and k[0])
    for (package, key), said in found.items():
        whole = "\n".join(rows[package, n] for n in range(key, 201) if (package, n) in rows)
        assert whole.startswith(said) and (len(said) >= 80 + len("MRP") or said == whole)
    prices = {r["inspection_id"]: r["amount"] for r in ex.price_across_lines(tokens).collect()}
    assert prices == {"P0": "9", "P1": "9", "P2": "9"}
    # the one join is that of the reading rows: no row meets a copy of a key for each of the rows below it
    assert plan(ex.behind_keys(tokens, "MRP", 80)).count("Join") == 1


def test_a_line_is_told_once_what_its_package_needs(spark):
    # every branch used to look its packages up again in a join with all lines
    assert plan(ex.declaration_table(page(spark))).count("SortMergeJoin") <= 100


@pytest.mark.parametrize("said, field, value", [
    ("M . R . P : 45.50 only", "mrp", "₹45.50"), ("maximum   retail price 7,25", "mrp", "₹7.25"), ("net . wt 5 KG", "net_quantity", "5.0 kg"),
    ("12 Nos", "net_quantity", "12.0 nos"), ("LOT a-77", "batch_number", "a-77"), ("made  in Nepal", "country_of_origin", "Nepal"),
    ("mkTd. bY: Acme Foods", "manufacturer", "Acme Foods"), ("1.0 0-1 2 0 1 3 0 0 0 1 2 3", "fssai_license", "10012013000123"),
    ("use  by 01/02/2027", "expiry_date", "01/02/2027"), ("pkd 03.04.2026", "manufacturing_date", "03/04/2026"),
    ("Composition: wheat and rye", "ingredients", "wheat and rye"), ("commodity: Rye Bread", "generic_name", "Rye Bread"),
    ("tea of the hills", "generic_name", "tea of the hills"), ("MRP 9 mrp  incl", "mrp_inclusive_tax", "Inclusive of all taxes")])
def test_no_pattern_is_kept_from_a_line_it_reads(spark, said, field, value):
    lines = spark.createDataFrame([("P", 1, said, 90.0, 40.0, 60.0, 300.0, 90.0)], TOKENS)
    assert [r.value for r in ex.declaration_table(lines).where(F.col("field_name") == field).collect()] == [value]


def said(spark, rows):
    return spark.createDataFrame(rows, "inspection_id string, field_name string, value string, confidence double, raw_line string")


def test_declarations_are_read_once(spark):
    # synonyms and what is derived used to read, and work out, all lines again for themselves
    rows = said(spark, [("P", "mrp", "Rs. 10", 90.0, "MRP Rs. 10 incl. of all taxes")])
    assert plan(rows).count("ExistingRDD") == 1
    for fields in (None, spark.createDataFrame([("mrp",), ("uom",)], "field string")):
        assert plan(screening.resolve_aliases(rows, fields)).count("Scan ExistingRDD[inspection_id") == 1


def test_resolution_picks_synonyms_before_what_is_derived(spark):
    rows = said(spark, [
        ("P", "mrp", "Rs. 10", 0.9, "MRP Rs. 10 incl. of all taxes"), ("P", "net_quantity", "5 kg", 80.0, None), ("P", "net_quantity", "null", 70.0, None),
        ("P", "batch_no", "B2", 70.0, None), ("P", "batch_no", "B1", 60.0, None), ("P", "batch_number", " ", 99.0, None),
        ("Q", "unit", "ml", 50.0, None), ("Q", "net_quantity", "7 g", 0.0, None), ("R", "mrp", "unknown", 90.0, "tax"), (None, "uom", "g", 90.0, None)])
    got = {(r.inspection_id, r.field): (r.entry.value, r.entry.confidence, r.priority) for r in screening.resolve_aliases(rows).collect()}
    assert got["P", "mrp"] == ("Rs. 10", 90.0, 0) and got["P", "net_quantity"] == ("5 kg", 80.0, 0)
    # the largest text of a field stands for it in what is derived
    assert ("P", "uom") not in got and got["P", "tax_clause"] == ("Inclusive of all taxes", 0.9, 1000)
    assert got["P", "batch_no"] == ("B1", 60.0, 0) and got["P", "batch_number"][:2] == ("B1", 60.0) and 0 < got["P", "batch_number"][2] < 1000
    assert got["Q", "unit"] == ("ml", 50.0, 0) and got["Q", "uom"] == ("g", 90.0, 1000) and got["Q", "net_quantity"] == ("7 g", 90.0, 0)
    assert ("R", "mrp") not in got and got["R", "tax_clause"][2] == 1000 and got[None, "uom"] == ("g", 90.0, 0)
    fields = spark.createDataFrame([("uom",), ("batch_number",)], "field string")
    few = {(r.inspection_id, r.field): (r.entry.value, r.entry.confidence, r.priority) for r in screening.resolve_aliases(rows, fields).collect()}
    assert few == {k: v for k, v in got.items() if k[1] in ("uom", "batch_number")}


def longest_method(spark, df):
    """Bytes of the longest method generated for a plan; the JIT leaves those of more than 8000 to the interpreter."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:([0-9]+)", code))


def test_generated_methods_are_short_enough_to_be_compiled(spark):
    # what is derived of price and quantity used to make one method of 63972 bytes, and was worked out once more by a filter
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        rows = said(spark, [("P", "mrp", "Rs. 10", 90.0, "MRP Rs. 10 incl. of all taxes"), ("P", "net_quantity", "5 kg", 80.0, None)])
        maps = screening.field_maps(screening.normalise_entries(screening.resolve_aliases(rows)))
        packages = spark.createDataFrame([("P", "ALL", 90.0, True)], "inspection_id string, category string, overall_confidence double, quality_ok boolean")
        for df in (maps, screening.screen(packages, rows, catalog.rules(spark), date(2026, 1, 15)), ex.label_facts(page(spark))):
            assert 0 < longest_method(spark, df) < 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", limit)


def test_lines_reach_the_aggregate_narrow(spark):
    # the aggregate sorts its input: a struct per field that is null on most lines instead of 45 columns, many of them parts of one field
    optimized = ex.label_facts(page(spark))._jdf.queryExecution().optimizedPlan()
    assert optimized.toString().startswith("Aggregate") and optimized.children().head().output().size() <= 40


def test_what_the_rule_alone_tells_is_worked_out_once(spark):
    packages, rules = told(spark)
    rows = said(spark, [("P1", "mrp", "Rs. 10", 90.0, None)])
    found = screening.screen(packages.withColumn("overall_confidence", F.lit(90.0)), rows, rules, date(2026, 1, 15))
    # whether a rule is marked as voluntary used to be looked up for every pair of a package and a rule
    assert "ALLERGEN" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_found_as_they_are(spark):
    pick = random.Random(7)
    lists = [C.GENERIC_NAME_PHRASES, C.INGREDIENT_PHRASES, C.PLAIN_LINE_SKIP, C.TITLE_SKIP, C.TAX_WORDS, C.SINGLE_COMMODITIES, ["a-b", "^x", "]y", "a-", "a&b"]]
    for phrases in lists:
        lines = [pick.choice(phrases)[: pick.randint(1, 9)] + pick.choice(["", " ", "-", "x"]) + pick.choice(phrases)[pick.randint(0, 2):] for _ in range(200)]
        df = spark.createDataFrame([(t,) for t in [*lines, *phrases, "", "^", None]], "t string")
        for r in df.select("t", tx.has_any(F.col("t"), phrases).alias("got")).collect():
            assert r.got == (None if r.t is None else any(p in r.t for p in phrases))


def test_cheap_tests_judge_as_the_long_ones(spark):
    pick = random.Random(8)
    texts = ["".join(pick.choice("aEyb1Z -.:_\n") for _ in range(pick.randint(0, 24))) for _ in range(600)]
    texts += ["1234 5678-9012", " 12345678901234 ", "123456789012345", "12-34\t567890\n12", "-123456789012", "1234567890x2", "ab1-", "ab1_ ", "BCDFG", "BCDFGa", "bcdfgh ae"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", tx.is_barcode("t").alias("barcode"), tx._vowel_share_low(F.col("t"), 5).alias("low"), tx.bad_generic_name("t").alias("bad")).collect()
    for r in got:
        value = r.t.strip(" ")
        letters, vowels = len(re.findall("[A-Za-z]", r.t)), len(re.findall("[aeiouyAEIOUY]", r.t))
        assert r.barcode == bool(re.fullmatch("[0-9]{12,14}", re.sub(r"[\s\-]+", "", value))), r.t
        assert r.low == (letters >= 5 and (vowels == 0 or vowels / letters < 0.18)), r.t
        if re.fullmatch(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9\-_]{4,}", value):
            assert r.bad, r.t
    fields = spark.createDataFrame([("MRP",), ("pack_qty",), ("units",), ("use_by",), ("License",), ("note",), (None,)], "f string")
    kinds = [r[0] for r in fields.select(vx.value_kind(F.col("f"))).collect()]
    assert kinds == ["MONEY", "QUANTITY", "UNIT", "DATE", "LICENCE", None, None]
