"""Extraction on small labels, and layout operators against brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from panelmark import constants as C
from panelmark.functions import text as tx
from panelmark.operators import extract as ex
from panelmark.operators import tokens as tk
from panelmark.plans import catalog
from panelmark.sources import sinks

SCHEMA = "inspection_id string, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def label(spark, lines, page="L", step=60, confidence=95.0):
    rows = [(page, i + 1, t, confidence, 40.0, float(step * (i + 1)), 40.0 + 10 * len(t), float(step * (i + 1) + 30))
            for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, lines, **more):
    table = ex.declaration_table(label(spark, lines, **more))
    return {r.field_name: r for r in table.collect()}


def test_ten_lines(spark):
    tokens = label(spark, [
        "PREMIUM BASMATI RICE", "MRP Rs. 245.50 (Incl. of all taxes)", "Net Weight: 1 kg", "PKD: 24/08/2026",
        "Best before 12 months from PKD", "Customer Care: 1800-123-4567", "care@brand.in", "FSSAI Lic No: 10012011000123",
        "Made in India", "Manufactured by: ABC Foods",
    ])
    price = ex.extract_mrp(tokens).first()
    assert (price.price, price.tax_stated) == (245.5, True)
    amount = ex.extract_net_quantity(tokens, catalog.unit_table(spark)).first()
    assert (amount.quantity, amount.unit, amount.base_value, amount.base_unit) == (1.0, "kg", 1000.0, "g")
    dates = ex.extract_dates(tokens).first()
    assert (dates.manufacturing_date, dates.shelf_life) == ("2026-08-24", "12 months from PKD")
    care = ex.customer_care(tokens).first()
    assert (care.phones, care.emails) == ("1800-123-4567", "care@brand.in")
    summary = ex.extraction_summary(tokens, catalog.unit_table(spark)).first()
    assert (summary.found, summary.ok) == (5, True)


def test_declarations_of_a_whole_label(spark):
    got = found(spark, [
        "GENERIC NAME: Chilli Powder", "MRP Rs. 245.00 Incl. of all taxes", "NET WEIGHT: 54g + 9g EXTRA = 63g", "PKD: 23/06126",
        "BEST BEFORE 12 MONTHS FROM PACKAGING", "BATCH NO: TX-91", "FSSAI Lic No: 10012011000123",
        "call 1800-123-4567 or a@b.co", "Country of Origin: India", "Manufactured by: ABC Foods",
    ])
    value = {k: r.value for k, r in got.items()}
    assert value["mrp"] == "₹245.00" and got["mrp"].verdict == "CONFORMING"
    assert value["mrp_inclusive_tax"] == "Inclusive of all taxes"
    assert value["net_quantity"] == "63.0 g" and value["net_quantity_unit"] == "g"
    assert value["expiry_date"] == "BEST BEFORE 12 MONTHS FROM PACKAGING"
    assert value["batch_number"] == "TX-91"
    assert value["fssai_license"] == "10012011000123"
    assert value["consumer_care"] == "1800-123-4567 | a@b.co"
    assert value["country_of_origin"] == "India" and value["manufacturer"] == "ABC Foods"
    assert value["generic_name"] == value["product_name"] == "Chilli Powder"
    assert value["ingredients"] == value["ingredient_list"] == "Chilli Powder"


def test_values_beside_and_below_their_keys(spark):
    rows = [
        ("S", 1, "SAMBHAR", 90.0, 40.0, 10.0, 240.0, 80.0), ("S", 2, "MASALA", 90.0, 260.0, 12.0, 420.0, 78.0),
        ("S", 3, "M.R.P", 90.0, 40.0, 300.0, 90.0, 320.0), ("S", 4, "Rs 55.00", 90.0, 150.0, 302.0, 240.0, 322.0),
        ("S", 5, "NET WT", 90.0, 40.0, 500.0, 100.0, 520.0), ("S", 6, "200 g", 90.0, 42.0, 545.0, 100.0, 565.0),
        ("S", 7, "PKD", 90.0, 40.0, 700.0, 100.0, 720.0), ("S", 8, "12/05/2025", 90.0, 160.0, 701.0, 260.0, 721.0),
        ("S", 9, "Marketed by", 90.0, 40.0, 900.0, 140.0, 920.0), ("S", 10, "Delta", 90.0, 44.0, 950.0, 90.0, 970.0),
        ("S", 11, "Mills", 90.0, 100.0, 952.0, 150.0, 972.0),
    ]
    got = {r.field_name: r.value for r in ex.declaration_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["mrp"] == "₹55.00"
    assert got["net_quantity"] == "200.0 g"
    assert got["manufacturing_date"] == "12/05/2025"
    assert got["manufacturer"] == "Delta Mills"
    assert got["generic_name"] == "SAMBHAR MASALA"
    assert "mrp_inclusive_tax" not in got


def test_ingredients_run_over_lines(spark):
    got = found(spark, ["TITLE WORDS", "INGREDIENTS: paste", "Coriander Seed and Cumin", "Red Chilli and Black Pepper", "KEEP in a dry place"])
    assert got["ingredients"].value == "paste Coriander Seed and Cumin Red Chilli and Black Pepper"


def test_tax_clause_split_over_tokens(spark):
    rows = [("T", 1, "MRP Rs. 20.00", 90.0, 40.0, 100.0, 200.0, 120.0), ("T", 2, "Incl of", 90.0, 40.0, 160.0, 100.0, 180.0),
            ("T", 3, "all Taxes", 90.0, 120.0, 161.0, 200.0, 181.0)]
    tokens = spark.createDataFrame(rows, SCHEMA)
    prices = ex.price_with_verdict(tokens)
    assert ex.with_price_verdict(prices, ex.near_rows_tax(tokens, prices)).first().verdict == "CONFORMING"


def test_typed_dates_drop_contained_texts(spark):
    tokens = label(spark, ["EXP: 12/05/2025", "EXP 12/05/2025", "MFG 6 MONTHS", "BEST BEFORE SIX MONTHS", "PKD 01.02.2025"])
    got = sorted((r.type, r.date_text) for r in ex.typed_dates(tokens).collect())
    assert ("EXP", "12/05/2025") in got and got.count(("EXP", "12/05/2025")) == 1
    assert ("PKD", "01/02/2025") in got
    assert not any(t == "MFG" for t, _ in got)


# -------------------------------------------------------------- brute force


@pytest.fixture(scope="module")
def scattered(spark):
    rng = random.Random(3)
    words = ["MRP", "Rs 10", "salt", "NET WT", "12 g", "tea", "Rs. 5.50"]
    rows = []
    for page in range(12):
        for i in range(40):
            x, y = rng.randrange(0, 500), rng.randrange(0, 700)
            rows.append((f"P{page}", i, rng.choice(words), float(rng.randrange(50, 99)), float(x), float(y), float(x + 60), float(y + 25)))
    return rows


def iou_kills(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    if w <= 0 or h <= 0:
        return False
    inter, one, two = w * h, (a[6] - a[4]) * (a[7] - a[5]), (b[6] - b[4]) * (b[7] - b[5])
    small = inter / min(one, two)
    return inter / (one + two - inter) >= 0.45 or small > 0.65 or (a[2] == b[2] and small > 0.25)


def test_nms_is_the_greedy_result(spark, scattered):
    tokens = spark.createDataFrame(scattered, SCHEMA).withColumn("pass_no", F.lit(0))
    got = {(r.inspection_id, r.line_no) for r in tk.nms_dedup(tokens).collect()}
    want = set()
    for page in {r[0] for r in scattered}:
        kept = []
        for t in sorted((r for r in scattered if r[0] == page), key=lambda r: (-r[3], r[1])):
            if not any(iou_kills(t, k) for k in kept):
                kept.append(t)
        want |= {(k[0], k[1]) for k in kept}
    assert got == want


def test_reading_rows_are_the_greedy_rows(spark, scattered):
    got = {(r.inspection_id, r.line_no): r.row_no for r in tk.reading_rows(spark.createDataFrame(scattered, SCHEMA)).collect()}
    for page in {r[0] for r in scattered}:
        rows = []
        for t in sorted((r for r in scattered if r[0] == page), key=lambda r: (r[5], r[1])):
            for number, row in enumerate(rows):
                if abs(row[0][5] - t[5]) <= 45:
                    row.append(t)
                    break
            else:
                rows.append([t])
                number = len(rows) - 1
            assert got[(t[0], t[1])] == number + 1


def test_nms_of_a_large_page_in_one_band(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        # a third is one stack, the rest one long band; few confidences, so many ties
        x, y = (rng.random() * 8, rng.random() * 4) if i % 3 == 0 else (rng.random() * 6000, rng.random() * 60)
        rows.append(("hot" if i % 10 else None, i, rng.choice(["tea", "salt", "oil"]), float(rng.choice([60, 70])), x, y, x + 60 + rng.random(), y + 25))
    rows += [("hot", 2000, "flat", 50.0, 5.0, 5.0, 5.0, 9.0), ("hot", 2001, "no box", 50.0, None, None, None, None)]
    rows += [("small", r[1], *r[2:]) for r in rows[:60]]
    got = {(r.inspection_id, r.line_no) for r in tk.nms_dedup(spark.createDataFrame(rows, SCHEMA).withColumn("pass_no", F.lit(0))).collect()}
    want = set()
    for page in ("hot", "small", None):
        kept = []
        for t in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[3], r[1])):
            if t[4] is None or not any(k[4] is not None and iou_kills(t, k) for k in kept):
                kept.append(t)
        want |= {(k[0], k[1]) for k in kept}
    assert got == want


def test_rows_of_a_page_with_fractional_edges(spark):
    rng = random.Random(7)
    rows, y = [], -300.0
    for i in range(3000):
        y += rng.choice([0.0, rng.random() * 20, 44.9, 45.0, 45.1, 200.0 if i % 50 == 0 else 1.5])
        rows.append(("hot" if i % 3 else None, i, "t", 90.0, 0.0, y, 10.0, y + 5))
    rows.append(("hot", 5000, "t", 90.0, 0.0, None, 10.0, 5.0))
    got = {(r.inspection_id, r.line_no): r.row_no for r in tk.reading_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and got[("hot", 5000)] == 0
    for page in ("hot", None):
        start, number = None, 0
        for t in sorted((r for r in rows if r[0] == page and r[5] is not None), key=lambda r: r[5]):
            if start is None or t[5] - start > 45:
                start, number = t[5], number + 1
            assert got[(page, t[1])] == number


def test_unmapped_tokens_of_a_hot_package(spark):
    rng = random.Random(9)
    tokens, boxes = [], []
    for i in range(1200):
        x, y, w = rng.random() * 3000 - 500, rng.random() * 3000 - 500, rng.choice([0.0, 30.0, 700.0])
        tokens.append(("hot" if i % 3 else f"P{i % 7}", i, "t", 90.0, x, y, x + w, y + 20))
    for i in range(150):
        x, y = rng.random() * 3000 - 500, rng.random() * 3000 - 500
        boxes.append(("hot" if i % 3 else f"P{i % 7}", i, "b", 90.0, x, y, x + rng.choice([-5.0, 40.0, 900.0]), y + rng.choice([12.0, 300.0])))
    boxes += [("hot", 900, "b", 90.0, -1e9, -1e9, -1e8, 1e9), ("hot", 901, "b", 90.0, None, None, None, None), (None, 902, "b", 90.0, 0.0, 0.0, 9e3, 9e3)]
    boxes.append(("P3", 903, "b", 90.0, -1e12, -1e12, 1e12, 1e12))
    tokens.append((None, 5000, "t", 90.0, 1.0, 1.0, 9.0, 9.0))

    def covers(b, t):
        if b[0] != t[0] or b[0] is None or b[4] is None:
            return False
        w, h = min(t[6], b[6]) - max(t[4], b[4]), min(t[7], b[7]) - max(t[5], b[5])
        own = (t[6] - t[4]) * (t[7] - t[5])
        return w > 0 and h > 0 and own > 0 and w * h > 0.5 * own

    got = sorted(r.line_no for r in tk.unmapped_tokens(spark.createDataFrame(tokens, SCHEMA), spark.createDataFrame(boxes, SCHEMA)).collect())
    assert got == sorted(t[1] for t in tokens if not any(covers(b, t) for b in boxes))


def test_spatial_pair_picks_the_cheapest(spark, scattered):
    got = {r.inspection_id: (r.key_line, r.value_line) for r in tk.spatial_pair(
        spark.createDataFrame(scattered, SCHEMA), "MRP", r"Rs\.?\s*[0-9]+(?:\.[0-9]+)?").collect()}
    for page in {r[0] for r in scattered}:
        tokens = [r for r in scattered if r[0] == page]
        answer = None
        for k in sorted((t for t in tokens if t[2] == "MRP"), key=lambda t: t[1]):
            options = []
            for v in tokens:
                if v[1] == k[1] or v[2] in ("MRP", "NET WT") or not v[2].startswith("Rs"):
                    continue
                dx, dy = v[4] - k[4], v[5] - k[5]
                ax, ay = abs(dx), abs(dy)
                if ax <= 25 and ay <= 150:
                    cost = ax * 5 + ay * 0.5
                elif dx > 0 and ay <= 40 and dx <= 250:
                    cost = 10 + ay * 2 + dx * 0.5
                elif 0 < dy <= 90 and ax <= 50:
                    cost = 20 + dy * 1.2 + ax
                elif 0 < dy <= 140 and ax <= 120:
                    cost = 40 + dy + ax * 1.5
                elif -90 <= dy < 0 and ax <= 50:
                    cost = 30 - dy + ax * 1.2
                else:
                    continue
                options.append((cost, v[1]))
            if options:
                answer = (k[1], min(options)[1])
                break
        assert got.get(page) == answer


def test_text_of_a_page_longer_than_a_block(spark):
    tokens = spark.range(2000).selectExpr("'P' AS inspection_id", "cast(id AS int) AS line_no", "concat('t', id) AS text")
    assert tk.full_text(tokens).first().full_text == "\n".join(f"t{i}" for i in range(2000))


def _plain_match(values, reads):
    """Best score, first line, number of matches by field, all pairs."""
    found = {}
    for field, value in values:
        value = (value or "").strip(" ")
        v = re.sub("[^A-Za-z0-9]", "", value).upper()
        if not v:
            continue
        number = re.search(r"[0-9]+(?:[.,][0-9]+)?", value)
        number = number.group().split(".")[0] if number else ""
        words = set(re.findall("[A-Z0-9]{3,}", value.upper()))
        for line, text in reads:
            up = (text or "").strip(" ").upper()
            d = re.sub(r"[\W]", "", up)
            if not d:
                continue
            shared = words & set(re.findall("[A-Z0-9]{3,}", up))
            if v == d:
                score = 3.0
            elif v in d:
                score = 2.0
            elif len(d) >= 3 and d in v:
                score = 1.5
            elif len(number) >= 2 and (number in d or number in up):
                score = 1.8
            elif shared:
                score = 1.0 + len(shared) / len(words)
            else:
                continue
            best, count = found.get(field, ((0.0, 0), 0))
            found[field] = (min(best, (-score, line)), count + 1)
    return {f: (-best[0], best[1], n) for f, (best, n) in found.items()}


def _plain_fallback(values, reads):
    found = {}
    for rule, value in values:
        value = (value or "").strip(" ")
        if not value:
            continue
        v = re.sub(r"[\W]", "", value).upper()
        number = re.search(r"[0-9]+(?:\.[0-9]+)?", value)
        words = set(re.findall("[A-Z0-9]{3,}", v))
        for line, text in reads:
            d = re.sub(r"[\W]", "", text or "").upper()
            if not d:
                continue
            if v in d or d in v:
                score = 2.0
            elif number and (number.group() in d or number.group() in text):
                score = 1.5
            else:
                score = len(words & set(re.findall("[A-Z0-9]{3,}", d))) / len(words) if words else 0.0
            if score > 0:
                found[rule] = min(found.get(rule, (0.0, 0)), (-score, line))
    return {r: (-score, line) for r, (score, line) in found.items()}


@pytest.mark.parametrize("one_field", [False, True])
def test_evidence_of_a_package_with_many_values(spark, one_field):
    """Packages on both sides of the limit give what all pairs give."""
    rng = random.Random(5)
    bits = ["MRP", "Rs", "245.00", "12", "7", "Net", "500 g", "Batch", "B-12", "Oil", "x", "—", "", "care@x.in", "1,250.50", "तेल", "Pure Oil"]
    values, reads = {}, {}
    for page, n in (("hot", 300), ("edge", 64), ("over", 65), ("small", 5)):
        values[page] = [(f"f{i % 9 if one_field else i}", " ".join(rng.choices(bits, k=rng.randrange(1, 4)))) for i in range(n)]
        reads[page] = [(i, " ".join(rng.choices(bits, k=rng.randrange(1, 5)))) for i in range(60 if n < 300 else 400)]
        values[page] += [("none", None), ("mark", "—")]
        reads[page] += [(900, None), (901, ""), (902, "—"), (903, reads[page][0][1])]
    decl = spark.createDataFrame([(p, *v) for p, vs in values.items() for v in vs], "inspection_id string, field_name string, value string")
    tokens = spark.createDataFrame([(p, i, t, float(i), 1.0 + i, 50.0, 9.0 + i, 60.0) for p, rs in reads.items() for i, t in rs],
                                   "inspection_id string, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {(r.inspection_id, r.field_name): (r.score, r.line_no, r.matches) for r in tk.evidence_match(decl, tokens).collect()}
    assert got == {(p, f): want for p in values for f, want in _plain_match(values[p], reads[p]).items()}
    asked = decl.withColumnsRenamed({"field_name": "rule_id", "value": "observed"})
    got = {(r.inspection_id, r.rule_id): (r.score, r.line_no) for r in tk.evidence_fallback(asked, tokens).collect()}
    assert got == {(p, f): want for p in values for f, want in _plain_fallback(values[p], reads[p]).items()}
    empty = tk.evidence_match(decl.limit(0), tokens)
    assert empty.isEmpty()


def _odd(line):
    for p in C.PLACEHOLDER_PHRASES:
        if p in line.strip(" ").lower():
            return f"placeholder: {p}"
    for word in re.split(r"[\W]+", line.strip(" ")):
        if re.fullmatch("[A-Za-z]{5,}", word):
            low = word.lower()
            vowels = sum(c in "aeiouy" for c in low)
            if vowels == 0 or (len(word) - vowels) / len(word) > 0.85:
                return f"consonant density: {word}"
            if re.search("[bcdfghjklmnpqrstvwxyz]{5}", low):
                return f"consonant run: {word}"
    return None


def test_words_that_look_made_up(spark):
    rng = random.Random(11)
    letters = ["b", "c", "D", "f", "g", "H", "k", "l", "M", "n", "s", "t", "a", "E", "i", "y", "Y", "o", "_", "7", "é", "-", " "]
    lines = ["".join(rng.choices(letters, weights=[3] * 12 + [1] * 11, k=rng.randrange(0, 40))) for _ in range(3000)]
    lines += ["", " ", "bcdfghja", "bcdafgh", "bcdfgéhjk", "strengths", "rhythms bcdfg", "LOREM IPSUM bcdfg", "x" * 50000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, text string")
    got = {r.i: r.reason for r in table.select("i", tx.suspicious_text("text").alias("reason")).collect()}
    assert got == {i: _odd(t) for i, t in enumerate(lines)}
    assert sum(v is not None for v in got.values()) > 500


def test_numbers_are_masked_pattern_by_pattern(spark):
    rng = random.Random(12)
    bits = ["Rs", "Rs.", "INR", "₹", "12", "1,250.50", "5", " ", "kg", "g", "N", "/", "-", ".", "2025", "1800", "123", "4567", "04012345678901", "__NUM_3__", "x", "rs"]
    lines = ["".join(rng.choices(bits, k=rng.randrange(0, 12))) for _ in range(2000)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, text string")
    got = {r.i: (r.masked, list(r.registry)) for r in tx.mask_numbers(table, "text").collect()}
    for i, line in enumerate(lines):
        held = []

        def keep(hit):
            held.append(hit.group())
            return f"__NUM_{len(held) - 1}__"

        for k, pattern in enumerate(tx.PROTECTED_PATTERNS):
            line = re.sub(pattern, keep, line, flags=0 if k in tx.CASED_PATTERNS else re.IGNORECASE)
        assert got[i] == (line, held)


def test_summary_says_what_the_readers_find(spark):
    """One pass over the lines against the five readers, with lines of both date prefixes among them."""
    rng = random.Random(13)
    bits = ["MFG: 01/02/2025", "EXP 03/04/2026", "MFD 05/2025 EXP 06/2026", "PKD use by 07/08/2026", "09/10/2025", "Best before 6 months", "500 g", "Net Wt: 1 kg",
            "6 m", "MRP Rs. 45.00", "Rs 12", "1800-123-4567", "call 022 12345678", "care@x.in", "www.x.in", "tea", "", None]
    rows = [(f"p{page}", line, rng.choice(bits), 90.0, 0.0, 40.0 * line, 90.0, 40.0 * line + 30) for page in range(1500) for line in range(rng.randrange(1, 5))]
    tokens = spark.createDataFrame(rows, SCHEMA).cache()
    found = {}
    for field, ids in {
        "mrp": ex.extract_mrp(tokens), "net_quantity": ex.extract_net_quantity(tokens, catalog.unit_table(spark)), "customer_care": ex.contact_hits(tokens),
        "manufacturing_date": ex.extract_dates(tokens).where("manufacturing_date IS NOT NULL"),
        "expiry_date": ex.extract_dates(tokens).where("expiry_date IS NOT NULL OR shelf_life IS NOT NULL"),
    }.items():
        for r in ids.select("inspection_id").distinct().collect():
            found.setdefault(r.inspection_id, set()).add(field)
    got = {r.inspection_id: (r.found, r.missing, r.ok) for r in ex.extraction_summary(tokens).collect()}
    for page in {r[0] for r in rows}:
        missing = [f for f in C.CHECKLIST_FIELDS if f not in found.get(page, set())]
        assert got[page] == (5 - len(missing), ",".join(missing), len(missing) <= 1)
    tokens.unpersist()


def test_ledger_evidence_of_odd_packages(spark):
    """No lines or declarations, repeated ones, nulls, and texts that JSON has to escape."""
    packages = spark.createDataFrame(
        [("a", "Tea", "Food", 70.0), ("b", "Packaged Commodity Item", None, None), ("c", None, "Food", 69.9)],
        "inspection_id string, product_name string, category string, quality_score double")
    decl = spark.createDataFrame(
        [("a", "manufacturer", "Old Ltd", 50.0, None, None), ("a", "manufacturer", "New Ltd", 90.0, None, None), ("a", "net_quantity", "75 ml", 90.0, 75.0, "ML"),
         ("a", "mrp", "5", 90.0, 5.0, None), ("c", "net_quantity", "some", None, None, None), ("c", "consumer_care", None, None, None, None)],
        "inspection_id string, field_name string, value string, confidence double, numeric_value double, unit string")
    tokens = spark.createDataFrame(
        [("a", 2, 'say "hi",\n[5]', 90.0, 1.0, 2.0, 3.0, 4.0), ("a", 1, "first", None, None, 2.0, 3.0, 4.0), ("c", 700, "late", 90.0, 1.0, 2.0, 3.0, 4.0)], SCHEMA)
    rows = {r.inspection_id: r for r in sinks.ledger_evidence(packages, decl, tokens).collect()}
    a, b, c = (rows[k] for k in "abc")
    assert json.loads(a.company_profile_json) == {"company_name": "New Ltd", "product_name": "Tea", "category": "Food", "fssai_license": "Not Detected"}
    assert json.loads(a.quantity_mpe_json) == {"declared_quantity": "75 ml", "mpe_display": "4.5 ml"}
    assert a.ocr_raw_text_immutable == 'first\nsay "hi",\n[5]' and a.image_quality_passed
    assert [(x["line_no"], x["text"], x["bbox"]) for x in json.loads(a.bounding_boxes_json_immutable)] == [
        (1, "first", [None, 2.0, 3.0, 4.0]), (2, 'say "hi",\n[5]', [1.0, 2.0, 3.0, 4.0])]
    assert json.loads(b.company_profile_json) == {"company_name": "Not Detected", "product_name": "Unidentified Product Label", "fssai_license": "Not Detected"}
    assert json.loads(b.quantity_mpe_json) == {"declared_quantity": "Not Detected", "mpe_display": "N/A"}
    assert (b.ocr_raw_text_immutable, b.bounding_boxes_json_immutable, b.customer_care_json, b.image_quality_passed) == ("", "[]", "{}", False)
    assert json.loads(c.quantity_mpe_json) == {"declared_quantity": "some", "mpe_display": "1.5%"} and not c.image_quality_passed


def test_promotional_totals_across_lines(spark):
    """Rows near the anchors say what the whole page says, at both sides of the reach."""
    rng = random.Random(14)
    bits = ["NET WEIGHT: 54g", "NET", "WEIGHT", "net qty", "+ 9g EXTRA", "= 63g", "=", "63 g", "TOTAL: 70 ml", "TOTAL", "tea", "x" * 20, "y" * 57, "z" * 119, "quantity"]
    pages = {f"p{i}": [rng.choice(bits) for _ in range(rng.randrange(1, 12))] for i in range(400)}
    pages |= {f"far{n}": ["NET WEIGHT", "x" * n, "= 63g"] for n in (116, 117, 118, 119, 120)}
    pages["rows"] = ["NET WEIGHT", *["x"] * 58, "= 63g"]
    rows = [(page, i, t, 90.0, 40.0, 60.0 * i, 90.0, 60.0 * i + 30) for page, lines in pages.items() for i, t in enumerate(lines)]
    got = {r.inspection_id: (r.quantity, r.unit) for r in ex.promo_quantity(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for page, lines in pages.items():
        anchored = any(re.search(f"(?i){ex._NET}", t) for t in lines) and any(re.search("(?i)=|TOTAL", t) for t in lines)
        hit = re.search(ex.PROMO_QUANTITY, "\n".join(lines))
        if anchored and hit:
            want[page] = (float(hit[1].replace(",", ".")), hit[2].lower())
    assert got == want and {"far118", "rows"} <= set(got) and "far120" not in got
