"""Named expectations of rule evaluation."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelmark.functions import text as tx
from panelmark.functions import values as vx
from panelmark.operators import measures as ms
from panelmark.operators import rollup
from panelmark.plans import applicability as ap
from panelmark.plans import catalog, screening

TODAY = date(2026, 9, 1)
FOOD = {
    "product_name": "Wheat Flour", "manufacturer": "ABC Foods, Pune", "net_quantity": "500 g", "unit_of_measurement": "g",
    "manufacturing_date": "01/08/2026", "expiry_date": "01/02/2027", "mrp": "₹55", "mrp_inclusive_tax": "Inclusive of all taxes",
    "consumer_care": "1800-123-4567 care@abc.in", "batch_number": "B12-X", "unit_sale_price": "₹0.11/g", "country_of_origin": "India",
    "ingredients": "Wheat", "fssai_license": "10012011000123",
}


def rule(**changed):
    base = catalog._rule("T-1", "s", "ALL", "mrp", "MANDATORY_FIELD", {"operator": "present"}, True, "HIGH", None)
    return base | changed


def verdict(spark, rules, fields, confidence=95.0, quality=True, category="ALL", entry_confidence=95.0):
    packages = spark.createDataFrame([("P", category, confidence, quality)],
                                     "inspection_id string, category string, overall_confidence double, quality_ok boolean")
    decl = spark.createDataFrame([("P", k, v, entry_confidence) for k, v in fields.items()] or [("Q", "x", "y", 1.0)],
                                 "inspection_id string, field_name string, value string, confidence double")
    table = catalog.literal_table(spark, rules, catalog.RULE_SCHEMA)
    return {r.rule_id: r.status for r in screening.screen(packages, decl, table, TODAY).collect()}


@pytest.mark.parametrize("confidence,quality,want", [(92, True, "FAIL"), (60, True, "NEEDS_REVIEW"), (95, False, "NEEDS_REVIEW")])
def test_missing_field(spark, confidence, quality, want):
    r = rule(field_name="manufacturer")
    assert verdict(spark, [r], {}, float(confidence), quality) == {"T-1": want}


@pytest.mark.parametrize("value,want", [("g", "PASS"), ("pounds", "FAIL")])
def test_unit(spark, value, want):
    r = rule(field_name="unit_of_measurement", rule_type="UNIT", condition='{"operator": "one_of", "values": ["g", "kg"]}')
    assert verdict(spark, [r], {"unit_of_measurement": value})["T-1"] == want


@pytest.mark.parametrize("value,want", [("10012011000123", "PASS"), ("100120", "FAIL")])
def test_licence(spark, value, want):
    r = rule(field_name="fssai_license", rule_type="FORMAT_CHECK", condition='{"operator": "regex", "pattern": "^\\\\d{14}$"}')
    assert verdict(spark, [r], {"fssai_license": value})["T-1"] == want


@pytest.mark.parametrize("expiry,want", [("01/02/2027", "PASS"), ("01/02/2020", "FAIL"), ("best before 6 months", "PASS")])
def test_expiry(spark, expiry, want):
    r = rule(field_name="expiry_date", rule_type="DATE_CHECK",
             condition='{"operator": "date_after_or_equal", "compare_with": "manufacturing_date"}')
    assert verdict(spark, [r], {"expiry_date": expiry, "manufacturing_date": "01/08/2026"})["T-1"] == want


def test_bad_pattern_does_not_fail_the_job(spark):
    r = rule(field_name="batch_number", rule_type="FORMAT", condition='{"operator": "regex", "pattern": "([a-z"}')
    assert verdict(spark, [r], {"batch_number": "abc"})["T-1"] == "REVIEW"


def test_named_groups_are_understood(spark):
    r = rule(field_name="batch_number", rule_type="FORMAT", condition='{"operator": "regex", "pattern": "^(?P<code>[a-z]+)$"}')
    assert verdict(spark, [r], {"batch_number": "abc"})["T-1"] == "PASS"


def test_rules_are_data(spark):
    r = rule(field_name="net_quantity", rule_type="NUMERIC", condition='{"min": 100}')
    fields = {"net_quantity": "500 g"}
    assert verdict(spark, [r], fields)["T-1"] == "PASS"
    assert verdict(spark, [r | {"condition": '{"min": 1000}'}], fields)["T-1"] == "FAIL"
    assert verdict(spark, [r | {"is_active": False}], fields) == {}


def test_food_label_is_compliant(spark):
    packages = spark.createDataFrame([("P", None, 95.0, True)],
                                     "inspection_id string, category string, overall_confidence double, quality_ok boolean")
    decl = spark.createDataFrame([("P", k, v, 95.0) for k, v in FOOD.items()],
                                 "inspection_id string, field_name string, value string, confidence double")
    ready = screening.infer_category(packages, decl)
    rules = catalog.rules(spark).where("rule_id <> 'PK-06-1-C-RANGE'")
    result = rollup.judge(screening.screen(ready, decl, rules, TODAY)).first()
    assert ready.first().category == "Food & Beverages"
    assert (result.overall_status, result.failed) == ("COMPLIANT", 0)


def test_category_wildcards_and_parts(spark):
    categories = spark.createDataFrame([("Food & Beverages",), ("a_c",), ("ALL",), ("100%",)], "category string")
    texts = spark.createDataFrame([("Beverages only",), ("xabcx",), ("Overall",), ("nothing",), ("pre-packaged general",)],
                                  "product_category string")
    got = {(r.category, r.product_category) for r in ap.category_matches(categories, texts).collect()}
    assert ("Food & Beverages", "Beverages only") in got
    assert ("a_c", "xabcx") in got
    # ALL is a substring test, and the underscore of a generic name is a wildcard
    assert ("a_c", "Overall") in got and ("100%", "pre-packaged general") in got
    assert not any(t == "nothing" for _, t in got)


def test_category_matches_are_those_of_like(spark):
    rng = random.Random(11)
    words = ["food", "Tea", "im", "ported", "a", "B_v", "100%", "&", "all", "%", "é", "İz"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(n)))
    names, rules = sorted({text(4) for _ in range(80)}), sorted({text(7) for _ in range(120)} | {"long " * 2000 + "tea shop"})
    categories = spark.createDataFrame([(n,) for n in names], "category string")
    texts = spark.createDataFrame([(r,) for r in rules] + [(None,)], "product_category string")
    got = sorted(map(tuple, ap.category_matches(categories, texts).collect()))
    every = categories.select("category", F.explode(ap.candidate_texts(F.col("category"))).alias("c")).crossJoin(texts)
    want = every.where("product_category ILIKE concat('%', c, '%')").select("category", "product_category").distinct()
    assert got == sorted(map(tuple, want.collect())) and any(len(r) > 9000 for _, r in got)


def test_price_gate_and_verdicts(spark):
    r = [rule(), rule(rule_id="T-2", field_name="mrp_inclusive_tax", rule_type="TEXT_CHECK")]
    assert verdict(spark, r, {"mrp": "₹5 incl of all taxes"}) == {"T-1": "PASS", "T-2": "PASS"}
    assert verdict(spark, r, {"mrp": "₹5"}, entry_confidence=80.0)["T-1"] == "NEEDS_REVIEW"


@pytest.mark.parametrize("area,height,printing,confidence,scale,required,difference,result", [
    (150.0, 3.0, "normal", 90.0, True, 2.5, 0.5, "COMPLIANT"),
    (150.0, 1.5, "normal", 90.0, True, 2.5, -1.0, "POTENTIAL_VIOLATION"),
    (150.0, 2.5, "normal", 90.0, True, 2.5, 0.0, "COMPLIANT"),
    (150.0, 2.2, "normal", 90.0, True, 2.5, -0.3, "POTENTIAL_VIOLATION"),
    (None, 3.0, "normal", 90.0, True, None, None, "NEEDS_OFFICER_VERIFICATION"),
    (150.0, 3.0, "normal", 90.0, False, 2.5, None, "NEEDS_OFFICER_VERIFICATION"),
    (150.0, 3.0, "normal", 70.0, True, 2.5, 0.5, "NEEDS_OFFICER_VERIFICATION"),
    (150.0, 4.5, "Embossed", 90.0, True, 4.0, 0.5, "COMPLIANT"),
])
def test_letter_height(spark, area, height, printing, confidence, scale, required, difference, result):
    df = spark.createDataFrame([(area, height, printing, confidence, scale)],
                               "area double, height double, printing string, confidence double, scale_ok boolean")
    row = ms.letter_height(df).first()
    assert (row.required, row.difference, row.result) == (required, difference, result)


@pytest.mark.parametrize("value,bad", [("Xxgfchf Brand", True), ("This is lorem ipsum", True), ("Aashirvaad Whole Wheat Flour", False)])
def test_suspicious(spark, value, bad):
    row = spark.createDataFrame([(value,)], "t string").select(tx.suspicious_text("t").alias("r")).first()
    assert (row.r is not None) == bad


@pytest.mark.parametrize("value,want", [
    ("24/08/2026", date(2026, 8, 24)), ("8/2026", date(2026, 8, 1)), ("31-02-2025", date(2025, 2, 1)),
    ("12/05/68", date(2068, 5, 12)), ("12/05/69", date(1969, 5, 12)), ("JAN 2026", date(2026, 1, 1)), ("October 2025", date(2025, 10, 1)),
    ("MAR2024", date(2024, 3, 1)), ("15 JUL 2023", date(2023, 7, 15)), ("on 5.6.24!", date(2024, 6, 5)), ("soon", None),
])
def test_label_date(spark, value, want):
    got = spark.createDataFrame([(value,)], "t string").select(vx.label_date("t").alias("d")).first().d
    assert got == want


def test_review_status_falls_in_no_bucket(spark):
    df = spark.createDataFrame([("P", "REVIEW", "HIGH"), ("P", "PASS", "HIGH")], "inspection_id string, status string, severity string")
    row = rollup.judge(df).first()
    assert (row.review, row.unverified, row.overall_status, row.percent) == (1, 0, "NEEDS REVIEW", 50.0)


def test_physical_height(spark):
    df = spark.createDataFrame([(100.0, 15.0, 1500.0), (30.0, None, None)], "height_px double, panel_cm double, image_px double")
    assert [(r.mm, r.calibrated) for r in ms.physical_height(df).collect()] == [(10.0, True), (10.0, False)]


def test_a_cycle_leaves_the_other_trees_alone(spark):
    from panelmark.operators.lineage import climb

    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")]
    found = {r["node"]: (r["root"], r["path"], r["reason"]) for r in climb(spark.createDataFrame(rows, "id string, up string"), "id", "up").collect()}
    assert found["c"] == ("a", "a/b/c", None) and {found[n] for n in "xyzs"} == {(None, None, "cycle")} and len(found) == 7


def test_two_changes_for_one_row_do_not_multiply_it(spark):
    from panelmark.operators import changes as ch

    insp = spark.sql("SELECT 'I' AS inspection_id, 'a' AS officer_id, 'b' AS officer_name, 'c' AS inspector_id, 'd' AS inspector_name")
    users = spark.sql("SELECT concat('U', id) AS user_id, concat('N', id) AS name FROM range(4)")
    work = spark.createDataFrame([("I", "U0", "officer_review", 1), ("I", "U1", "officer_review", 2), ("I", "U2", "inspector_dispatch", 1)],
                                 "inspection_id string, user_id string, assignment_type string, change_no int")
    done = ch.assign_work(insp, users, work, "change_no")[0].collect()
    assert [(r["officer_id"], r["officer_name"], r["inspector_id"], r["inspector_name"]) for r in done] == [("U1", "N1", "U2", "N2")]


def test_rule_feeds_of_mixed_shape(spark):
    lines = [
        '{"rule_id": "A", "applicability": ["x", "cosmetics"], "validation_type": "UNIT", "parameters": {"allowed_units": ["g"]}, "provision": {"chapter": "Chapter II"}}',
        '{"rule_id": "B", "applicability": "frozen, cosmetics", "rule_type": "my_check", "condition": {"operator": "present"}, "parameters": "{\\"min\\": 1}"}',
        '{"rule_id": "C", "applicability": [], "rule_type": "numeric", "parameters": "{\\"min\\": 1}", "provision": {"chapter": "Retail sale"}}',
        '{"rule_id": "D", "rule_type": "my_check", "condition": "", "parameters": [1, 2], "required": true}',
        '{"rule_id": "E", "applicability": null, "parameters": "{broken", "provision": null}',
        '{"rule_id": "LM-CR-008", "applicability": "ALL", "parameters": {}, "provision": {"chapter": "II"}}',
        '{"rule_id": "F", "parameters": {"mandatory": false}, "provision": {"chapter": "II"}}',
    ]
    fields = ["rule_id", "validation_type", "rule_type", "field", "description", "severity", "required"]
    read = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "source_rank int, line string").withColumn("v", F.parse_json("line"))
    feed = read.select("source_rank", *[F.try_variant_get("v", f"$.{f}", "boolean" if f == "required" else "string").alias(f) for f in fields],
                       *[F.try_variant_get("v", f"$.{f}", "variant").alias(f) for f in ("applicability", "parameters", "condition", "provision")])
    want = {
        "A": ("Cosmetics", "VALUE_CHECK", '{"operator":"one_of","values":["g"]}', True),
        "B": ("frozen, cosmetics", "my_check", '{"operator":"present"}', False),
        "C": ("ALL", "RANGE_CHECK", '{"min": 1}', True),
        "D": ("ALL", "my_check", "{}", True),
        "E": ("ALL", "MANDATORY_FIELD", '{"operator":"present"}', False),
        "LM-CR-008": ("ALL", "MANDATORY_FIELD", '{"operator":"present"}', False),
        "F": ("ALL", "MANDATORY_FIELD", '{"operator":"present"}', False),
    }
    texts = [F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).otherwise(F.nullif(F.to_json(c), F.lit("null"))).alias(c)
             for c in ("applicability", "parameters", "condition", "provision")]
    for shaped in (feed, feed.select("source_rank", *fields, *texts)):
        got = {r.rule_id: (r.product_category, r.rule_type, r.condition, r.required) for r in ap.canonicalise_rules(shaped).collect()}
        assert got == want


def test_dates_and_blanks_are_read_as_before_they_were_screened(spark):
    draw = random.Random(7)
    parts = ["05", "1", "12", "2025", "25", "/", "-", ".", " ", "  ", "\t", "'", "JAN", "March", "may", "\n", "x", "é", "EXP"]
    rows = [("".join(draw.choice(parts) for _ in range(draw.randint(1, 7))),) for _ in range(6000)]
    rows += [(f"{d}{s}{m}{s}{y}",) for s in ["/", "-", ".", " "] for d in ("5", "05") for m in ("3", "Mar", "MAR") for y in ("25", "2025")]
    edges = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
    bare = F.regexp_replace(F.trim("t"), edges, "")
    table = spark.createDataFrame(rows, "t string").withColumns({
        "plain": vx.let(bare, vx._date_of), "screened": vx.label_date("t"),
        "even": F.trim(F.regexp_replace("t", r"\s+", " ")), "blanks": tx.norm_whitespace("t")})
    got = table.collect()
    assert [r.plain for r in got] == [r.screened for r in got] and sum(r.plain is not None for r in got) > 50
    assert [r.even for r in got] == [r.blanks for r in got]
