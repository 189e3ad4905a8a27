"""The dealt operators against brute force, round trips and held-out rows, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmark.llm import (
    chat, compression, decontaminate, forest, hilbert, langid, mixing, pseudonyms, substrings, toxicity,
)
from panelmark.llm.common import window_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, part int, shard int, found string, tokens int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(seed: int, n: int, stock=WORDS) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(stock) + str(draw.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows; columns named like those inside."""
    long_text = sentence(1, 60_000)
    rows = [(0, sentence(2, 80)), (1, sentence(2, 80)), (1, sentence(2, 80)), (2, None), (3, ""), (4, "  \n\t "), (5, "one two"),
            (6, "one two"), (None, sentence(3, 70)), (None, sentence(3, 70)), (7, long_text), (8, long_text + " end"),
            (9, sentence(2, 79) + " other"), (10, "x" * 100_000), (11, "Ünï ©ode " * 30)]
    return spark.createDataFrame(
        [(i, t, "en" if i is None or i % 2 else None, None if i == 5 else f"src{(i or 0) % 3}", None, "f", 1, 2, "z", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def links_by_force(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    linked = [[i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    return sets, linked


def test_jaccard_links_on_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _, linked = links_by_force(rows)
    expected = sorted(((i, sum(linked[k])) for k, (i, _) in enumerate(rows)), key=repr)
    found = forest.jaccard_links(odd).collect()
    assert sorted(((r["doc_id"], r["n_links"]) for r in found), key=repr) == expected
    groups = {r["doc_id"]: r["group_id"] for r in found}
    assert groups[1] == groups[0] == groups[9] == 0 and groups[8] == 7 and groups[3] == 3
    assert forest.jaccard_links(none).count() == 0


def test_jaccard_finds_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 16)
    rows, draw = [], random.Random(7)
    for group in range(3):
        base = sentence(100 + group, 60).split()
        for k in range(40):
            own = list(base)
            for _ in range(draw.randrange(4)):
                own[draw.randrange(60)] = f"new{draw.randrange(9)}"
            rows.append((group * 100 + k, " ".join(own)))
    sets, linked = links_by_force(rows)
    found = {r["doc_id"]: r for r in forest.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    total, met = sum(map(sum, linked)), sum(r["n_links"] for r in found.values())
    assert all(found[i]["n_links"] <= sum(linked[k]) for k, (i, _) in enumerate(rows))
    assert met >= 0.999 * total > 0


def test_jaccard_finds_pairs_at_the_threshold_beside_a_large_group(spark):
    assert forest.chance(0.8, forest.depths_for(0.8, forest.TARGET)[-1]) >= forest.TARGET and forest.depths_for(0.95, forest.TARGET) == [4]
    # 22 words, the last two different: 16 of 20 shingles are shared
    pairs = [(k, sentence(k, 22)) for k in range(3000)]
    pairs += [(3000 + k, text.rsplit(" ", 2)[0] + f" other end{k}") for k, text in pairs]
    base = sentence(9999, 400).split()
    hot = [(6000 + k, " ".join([*base[:200], f"new{k}", *base[201:]])) for k in range(500)]
    found = forest.jaccard_links(spark.createDataFrame(pairs + hot, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_links"]) for r in found} == {(i, 1 if i < 6000 else 499) for i, _ in pairs + hot}


def test_jaccard_keeps_ids_beyond_doubles_beside_nulls(spark):
    base = [sentence(70 + k, 60) for k in range(3)]
    near = [[t, t.rsplit(" ", 1)[0] + " other", t + " more"] for t in base]
    rows = [(2**60 + 10 * g + k + 1, t) for g, texts in enumerate(near) for k, t in enumerate(texts)]
    rows += [(None, sentence(99, 60)), (-(2**62) - 1, None), (2**53 + 1, sentence(98, 60)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    _, linked = links_by_force(rows)
    found = forest.jaccard_links(df).collect()
    assert sorted(((r["doc_id"], r["n_links"]) for r in found), key=repr) == sorted(((i, sum(linked[k])) for k, (i, _) in enumerate(rows)), key=repr)
    assert {r["doc_id"]: r["group_id"] for r in found if r["n_links"]} == {2**60 + 10 * g + k: 2**60 + 10 * g + 1 for g in range(3) for k in (1, 2, 3)}
    kept = [r["doc_id"] for r in forest.keep_first(df).collect()]
    assert sorted(kept, key=repr) == sorted([2**60 + 1, 2**60 + 11, 2**60 + 21, None, None, -(2**62) - 1, 2**53 + 1], key=repr)


def test_a_shared_notice_brings_few_texts_together(spark):
    notice = sentence(5, 60)
    rows = [(k, f"{sentence(2000 + k, 220)} {notice}") for k in range(600)] + [(600 + k, f"{sentence(2000 + k, 219)} end {notice}") for k in range(5)]
    classes = forest._describe(spark.createDataFrame(rows, "doc_id long, text string")).select("fp", "labels")
    members = forest._members(classes, forest.depths_for(0.8, forest.TARGET)).groupBy("depth", "tree", "node").count().collect()
    # 182,710 pairs of texts, of which five are near copies
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in members) < 1800
    links = forest.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links > 0")
    assert sorted(r["doc_id"] for r in links.collect()) == [0, 1, 2, 3, 4, 600, 601, 602, 603, 604]


def test_keep_first_leaves_one_of_each_group(odd, none):
    kept = forest.keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert [i for i in ids if i in (0, 1, 9)] == [0] and [i for i in ids if i in (7, 8)] == [7] and [i for i in ids if i in (5, 6)] == [5]
    assert {2, 3, 4, 10, 11} <= set(ids) and ids.count(None) == 1
    assert forest.keep_first(none).count() == 0


def test_keep_first_tells_rows_with_one_id_apart(spark):
    base = [sentence(k, 80) for k in range(4)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in base]
    rows = [
        (1, base[0]), (None, near[0]), (None, "clean text without an id"), (None, None), (1, "clean text under the id of a first one"),
        (2, base[1]), (2, near[1]), (2, "clean text under the id of two copies"), (9, near[1] + " more"),
        (None, base[2]), (None, near[2]), (None, base[2]),
        (3, base[3]), (4, near[3]), (4, "clean text under the id of a copy"), (4, None), (4, "")]
    kept = [tuple(r) for r in forest.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    copies = [[base[k], near[k], near[k] + " more"] for k in range(4)]
    lone = [r for r in rows if not any(r[1] in c for c in copies)]
    assert sorted((r for r in kept if not any(r[1] in c for c in copies)), key=repr) == sorted(lone, key=repr)
    assert [[i for i, t in kept if t in c] for c in copies] == [[1], [2], [None], [3]]


def test_components_on_a_long_chain(spark):
    edges = spark.range(60).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("fp"), F.lpad((F.col("id") + 1).cast("string"), 3, "0").alias("other"))
    assert {r["root"] for r in forest.components(edges).collect()} == {"000"}


def test_overlaps_match_sets():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 9000, n, dtype=np.uint64)) for n in (0, 5, 700, 6000, 1)]
    assert forest.overlaps(sets, sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def substring_by_force(rows):
    first, out = {}, []
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    for i, text in rows:
        w = words(text)
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k:k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def test_substrings_on_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, substrings.remove_repeats(odd).collect()), key=repr) == substring_by_force(rows)
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_with_shifted_passages(spark):
    draw, rows = random.Random(5), []
    passages = [sentence(50 + k, draw.randrange(10, 30)) for k in range(12)]
    for i in range(60):
        parts = [sentence(1000 * i + k, draw.randrange(1, 15)) + " " + draw.choice(passages) for k in range(4)]
        rows.append((i, "\n".join(parts)))
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == substring_by_force(rows)


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_window_hashes_do_not_depend_on_place():
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert window_hashes(h, 13)[20:].tolist() == window_hashes(h[20:], 13).tolist()


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one, two"), (2, None), (3, "..."), (3, sentence(2, 30)), (3, sentence(2, 30)), (None, "zzz")], "item_id long, text string")
    found = {(r["doc_id"], r["n_words"]): r for r in decontaminate.find_contamination(odd, items).collect()}
    assert found[(5, 2)]["contaminated"] and found[(5, 2)]["n_hit"] == 2
    assert found[(5, 2)]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert found[(0, 80)]["n_hit"] == 30 and found[(0, 80)]["n_items"] == 1
    assert found[(2, 0)]["n_words"] == 0 and not found[(2, 0)]["contaminated"]
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and not {0, 1, 5, 6} & {r["doc_id"] for r in kept.collect()}
    assert decontaminate.find_contamination(none, items).count() == 0
    assert decontaminate.find_contamination(odd, items.where("false")).where("contaminated").count() == 0


def contaminated_by_force(rows, items, width=13):
    """rows and items: (id, text); per row its n_words, n_hit, digest of items and verdict."""
    windows = {}
    for item, text in items:
        w = decontaminate.normal_words(text or "")
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[i:i + width]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, names = decontaminate.normal_words(text or ""), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    names |= windows[tuple(w[a:a + n])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("max_windows", [1 << 17, 40, 7])
def test_decontamination_in_any_number_of_sets(spark, max_windows):
    items = [(k, sentence(500 + k, 8 + 3 * k)) for k in range(12)] + [(3, sentence(503, 17)), (99, None), (98, "?!"), (97, sentence(500, 8).upper())]
    rows = [(None if k == 4 else k, " ".join([sentence(k, 30), items[k % 12][1], sentence(k + 50, 5), items[(k + 5) % 12][1][: 40 + k]])) for k in range(40)]
    rows += [(40, None), (41, ""), (42, items[11][1]), (42, items[11][1])]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, tests, max_windows=max_windows).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(contaminated_by_force(rows, items), key=repr)


def test_decontamination_spans_name_the_original_words():
    text = "Well... THE Ébène-cat, sat"
    words = decontaminate.normal_words(text)
    row = decontaminate._verdict(text, len(words), *decontaminate.Automaton({b"the": ["7"], "Ébène cat".encode(): ["8"]}).find(words), 20)
    assert [text[a:b] for a, b in zip(row[5], row[6])] == ["THE Ébène-cat"] and row[1] == 3 and row[2] == 2


def test_compression_base_rules_by_force(odd, none):
    for r in compression.measure(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        w = words(r["text"])
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        often = {x for x in windows if windows.count(x) > 1} if len(w) < 5000 else None
        if often is not None:
            assert r["n_repeat_words"] == len({i + j for i, x in enumerate(windows) if x in often for j in range(3)})
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        if r["kept"]:
            assert not r["base_failed"]
    assert compression.measure(none).count() == 0 and compression.keep_good(odd).columns == odd.columns


def test_compression_bands_tell_noise_and_repeats():
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    noise = random.Random(1)
    junk = " ".join("".join(noise.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(200))
    good = " ".join(noise.choice(["the", "cat", "sat", "upon", "some", "very", "long", "wall", "today", "again"]) + noise.choice(["s", "ed", "", "ly"]) for _ in range(600))
    assert not compression.judge(junk, pack)[6] and compression.judge(good, pack)[6]
    lines = "a\nb\n\na\n \na"
    assert compression.repeated_lines(lines) == 2
    assert b"".join(compression.chunks_of(b"x" * 10_000, 4096)) == b"x" * 10_000


def test_compression_limits_reject_what_the_base_rules_let_pass(spark):
    stock = [sentence(k, 1, WORDS) for k in range(4000)]
    plain = [(k, " ".join(random.Random(k).choices(stock, k=150 + k % 60))) for k in range(900)]
    parts = [" ".join(random.Random(9000 + k).choices(stock, k=4)) for k in range(12)]
    # each four-word part comes up again and again, but in any order, so few windows of three words repeat in a row of other parts
    packed = [(1000 + k, " ".join(random.Random(k).choice(stock).upper() + " " + p[: 10 + 3 * k] for p in random.Random(k).choices(parts, k=40))) for k in range(5)]
    noise = [(2000 + k, " ".join("".join(chr(random.Random(k * 999 + i).randrange(0x4E00, 0x9FA5)) for i in range(j, j + 5)) for j in range(0, 500, 5))) for k in range(5)]
    docs = spark.createDataFrame(plain + packed + noise, "doc_id long, text string")
    limits = compression.fit(docs)
    assert limits and all(a < b and c < d for a, b, c, d in limits.values())
    found = {r["doc_id"]: r for r in compression.measure(docs).collect()}
    assert all(found[i]["kept"] for i, _ in plain)
    alone = [i for i, r in found.items() if not r["base_failed"] and not r["kept"]]
    assert set(alone) >= {i for i, _ in noise} and not [i for i, _ in noise if found[i]["base_failed"]]
    assert compression.fit(docs.where("false")) == {}


def test_pseudonyms_keep_format_link_and_can_be_undone(odd, none):
    card, iban = "4041894974608795", "DE89 3704 0044 0532 0130 00"
    text = (f"pay {card} or {card}, call +1 (988) 555-2485, from 70.123.182.155. IBAN {iban} born 1984-02-29, 13/12/1999, 12/25/1999, "
            "31.01.2001; mail bob.s-7@mail1.example.com SSN 219-09-9999; keep 4041894974608796 and 2023-02-30, version 3.4, 999.1.1.1")
    network = pseudonyms.Feistel(b"k")
    out, n, *counts = pseudonyms.change(text, network.hide)
    assert n == 11 and dict(zip(pseudonyms.KINDS, counts)) == {"card": 2, "iban": 1, "ssn": 1, "phone": 1, "ip": 1, "date": 4, "email": 1}
    for gone in (card, iban, "555-2485", "70.123", "1984-02-29", "12/25/1999", "bob.s-7"):
        assert gone not in out
    assert "4041894974608796 and 2023-02-30, version 3.4, 999.1.1.1" in out and "@mail1.example.com" in out
    cards = re.findall(r"\b4\d{15}\b", out)
    assert cards[0] == cards[1] and pseudonyms.luhn_digit(cards[0][:-1]) == cards[0][-1]
    assert pseudonyms.change(out, network.show)[0] == text
    assert sorted(network.hide(x, 1000, "t") for x in range(1000)) == list(range(1000))
    rows = {r["doc_id"]: r for r in pseudonyms.pseudonymise(odd, b"k").collect()}
    assert rows[2]["text"] is None and rows[3]["text"] == "" and pseudonyms.pseudonymise(none, b"k").count() == 0
    assert pseudonyms.replace_text(odd, b"k").columns == odd.columns


@pytest.mark.parametrize("text", [
    "pay {card} 123", "{card} 12/25", "in 12 {spaced}", "{spaced} 123", "x 123 456 789 012 {spaced} 7", "{card}-123", "12-{card}",
    "{card} {card} 99", "{card} 123 {spaced} 456 {card}", "{card} 12.50", "{iban} BANK AB", "{iban} INTERNATIONAL X", "AB12 CDEF {iban} BANKING",
    "{wide} AB", "IBAN {iban} {card} 12/25"])
def test_pseudonyms_of_values_next_to_numbers_and_words(text):
    hide, show = pseudonyms.Feistel(b"k").hide, pseudonyms.Feistel(b"k").show
    values = {"card": "4041894974608795", "spaced": "4041 8949 7460 8795", "iban": "AT611904300234573201", "wide": "DE89 3704 0044 0532 0130 00"}
    alone = {k: pseudonyms.change(v, hide)[0] for k, v in values.items()}
    assert alone["card"] == alone["spaced"].replace(" ", "") and all(alone[k] != v for k, v in values.items())
    out, n, *_ = pseudonyms.change(text.format(**values), hide)
    assert out == text.format(**alone) and n == text.count("{")
    assert pseudonyms.change(out, show)[0] == text.format(**values)


def test_pseudonyms_can_be_undone_among_numbers():
    network, draw, met = pseudonyms.Feistel(b"k"), random.Random(3), 0
    for _ in range(1000):
        text = " ".join(str(draw.randrange(10 ** draw.randrange(1, 6))) for _ in range(14))
        out, n, *_ = pseudonyms.change(text, network.hide)
        assert pseudonyms.change(out, network.show)[0] == text
        met += n
    assert met > 500


_WHOLE_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def test_emails_match_one_pattern_and_take_linear_time():
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice("ab9.-_+@@ é") for _ in range(draw.randrange(40))) + draw.choice(["", "@b.com", "a.co"])
        assert list(pseudonyms._emails(text)) == [m.span() for m in _WHOLE_EMAIL.finditer(text)], text
    start = time.perf_counter()
    for text in ("a" * 1_000_000 + " b@c.com", "a." * 500_000 + "b@c", "a@b." * 250_000, "@" + "a" * 1_000_000):
        list(pseudonyms._emails(text))
    assert time.perf_counter() - start < 10


def test_pseudonyms_query_can_be_undone(spark):
    from panelmark.llm.queries import KEY, QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in QUERIES["op2_pseudonyms"](spark, sf).collect()}
    show, changed = pseudonyms.Feistel(KEY).show, 0
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        assert pseudonyms.change(found[i]["text"], show)[0] == text
        # a plain search: whatever is surely a card or an address is replaced by another one of its form
        for pattern in (r"(?<![\w-])4\d{15}(?![\w-])", r"(?<![\w.%+-])[a-z0-9]+@[a-z0-9]+\.(?:com|org|net)(?![\w.-])"):
            for value in re.findall(pattern, text or ""):
                if "@" in value or pseudonyms.luhn_digit(value[:-1]) == value[-1]:
                    changed += 1
                    assert value not in found[i]["text"]
        assert (text != found[i]["text"]) == (found[i][2] > 0)
    assert changed > 0


def test_language_learns_scripts_without_blanks(spark):
    draw = random.Random(8)
    stocks = {"ja": "のはをがにでとたしていますこれそれ日本語文字", "zh": "的是在了不有和人这中大为上个国我以要他时来用们"}
    rows = [(i, "".join(draw.choice(stocks[lang]) for _ in range(300)), lang) for i in range(60) for lang in stocks]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marked = docs.withColumn("told", langid.predictor(docs, langid.fit(docs))(F.col("text")))
    assert marked.where("told.lang_pred <> lang").count() == 0


def test_expected_uses_of_long_words():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba"] + [f"<0x{b:02X}>" for b in range(256)]
    own, chance = langid.Pieces(pieces), np.random.default_rng(1).random(262).tolist()
    small, large = {}, {}
    own.expected("abab", [c * 1e-3 for c in chance], 1.0, small)
    own._expected_in_logs("abab", [[], *_edges(own, "abab", [c * 1e-3 for c in chance])], 1.0, large)
    assert small.keys() == large.keys() and all(np.isclose(small[k], large[k]) for k in small)
    # far below the smallest number: the pieces still cover each letter once
    own.expected("ab" * 5000, [c * 1e-2 for c in chance], 1.0, found := {})
    assert np.isclose(found[1] + 2 * found[3] + found.get(4, 0) * 2 + found[2] + 3 * found[5], 10_000)


def _edges(own, word, chance):
    return [[(end - n, own.ids[word[end - n:end]], chance[own.ids[word[end - n:end]]]) for n in range(1, min(end, 3) + 1) if word[end - n:end] in own.ids]
            for end in range(1, len(word) + 1)]


def test_language_on_odd_rows_and_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"), sample_per_language=60)
    told = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs, "doc_id")
    assert told.where("lang = lang_pred").count() >= 0.97 * told.count()
    rows = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[10]["lang_pred"] != "und"
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none)
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba"] + [f"<0x{b:02X}>" for b in range(256)]
    own = langid.Pieces(pieces)
    chance = np.vstack([np.random.default_rng(1).random((len(pieces), 2)), np.zeros(2)])

    def force(word, g):
        if not word:
            return 1.0
        return sum(chance[own.ids[word[:n]], g] * force(word[n:], g) for n in range(1, 4) if word[:n] in own.ids and n <= len(word))

    for word in ("a", "abab", "babaab", "ab" * 30):
        found = np.exp(own.forward([word], chance)[0])
        if len(word) < 10:
            assert np.allclose(found, [force(word, g) for g in range(2)])
        assert np.isfinite(own.forward([word * 40], chance)).all()


def test_toxicity_on_odd_rows(spark, odd, none):
    rows = [(i, sentence(i, 40) + (" vile nasty scorn" if i % 4 == 0 else "") + (" foul vilest" if i % 8 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.graded(table, table.where("doc_id < 300")))
    found = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    assert all(found[i]["rejected"] == bool(toxic) for i, _, toxic in rows)
    assert found[0]["severity"] > found[4]["severity"] > found[1]["severity"] and len(model["thresholds"]) == 2
    assert toxicity.keep_harmless(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    nothing = toxicity.fit(toxicity.graded(none, table))
    assert toxicity.score(odd, nothing).where("rejected").count() == 0


def water_by_force(children, budget):
    """Shares of (capacity, weight) by repeated proportional filling, exact fractions."""
    given, open_ = {}, dict(children)
    while open_:
        left, weights = Fraction(budget - sum(given.values())), sum(w for _, w in open_.values())
        full = {k for k, (c, w) in open_.items() if c <= left * w / weights}
        if not full:
            return given | {k: int(left * w / weights) for k, (_, w) in open_.items()}
        for k in full:
            given[k] = open_.pop(k)[0]
    return given


def test_shares_match_filling(spark):
    draw = random.Random(4)
    children = {f"c{k}": (draw.randrange(1, 1000), draw.randrange(1, 9)) for k in range(30)}
    for budget in (0, 10, 3000, sum(c for c, _ in children.values())):
        df = spark.createDataFrame([(k, c, w, budget) for k, (c, w) in children.items()], "name string, capacity long, weight long, budget long")
        found = {r["name"]: r["granted"] for r in mixing.share_out(df, [], "name").collect()}
        assert found == water_by_force(children, budget)


def test_mixing_on_odd_rows(odd, none):
    mixed = mixing.mix(odd, F.lit("d"), {("d",): 1}, Fraction(1, 2), seed=3)
    total = sum(len(words(r["text"])) for r in odd.collect())
    assert mixed.columns[:len(odd.columns)] == odd.columns
    assert mixed.agg(F.sum("mix_tokens")).first()[0] <= total // 2
    everything = mixing.mix(odd, F.lit("d"), {}, Fraction(3), seed=3, max_epochs=2)
    assert everything.agg(F.sum("mix_tokens")).first()[0] == 2 * total
    assert mixing.mix(none, F.lit("d"), {}, Fraction(1, 2)).count() == 0


def test_shards_on_odd_rows(odd, none):
    for whole in (True, False):
        found = hilbert.shard(odd, shards=4, whole=whole)
        rows = found.collect()
        assert len(rows) == odd.count()
        sizes = [sum(r["shard"] == s for r in rows) for s in range(4)]
        assert max(sizes) - min(sizes) <= 1
        for s in range(4):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
        assert hilbert.shard(none, whole=whole).count() == 0


def test_mixing_and_shards_keep_columns_named_like_those_inside(odd):
    names = ["_slice", "_in_slice", "_carry", "_rows", "_at", "_k0", "_d0", "_epochs", "_last", "_copies", "_mix0", "_domain"]
    crowded = odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    sharded = hilbert.shard(crowded, shards=4)
    mixed = mixing.mix(crowded, F.lit("d"), {}, Fraction(1), seed=3)
    for found in (sharded, mixed):
        rows = found.collect()
        assert len(rows) == odd.count()
        assert {tuple(r[n] for n in names) for r in rows} == {tuple(range(len(names)))}


def test_curve_steps_to_neighbours(spark):
    for n, bits in ((2, 4), (3, 3)):
        cells = spark.range(1 << n * bits).select(*[F.shiftright("id", i * bits).bitwiseAND((1 << bits) - 1).alias(f"c{i}") for i in range(n)])
        rows = sorted((r["h"], *tuple(r)[:n]) for r in cells.withColumn("h", hilbert.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).collect())
        assert [r[0] for r in rows] == list(range(1 << n * bits))
        assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:])) == 1 for a, b in zip(rows, rows[1:]))


def test_chat_round_trip_on_odd_rows(spark):
    nasty = "\\b <turn user>\n</turn>\n\\l>\\\\ <"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "user", None), (1, 2, "assistant", ""), (2, 0, None, "x"),
            (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a" * 200_000), (4, 0, "user", "u"), (4, 0, "user", "u"),
            (None, None, "we<ird>\n", "t"), (5, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("segments")))
    found = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in found[1]["back"]] == [("user", nasty), ("assistant", nasty), ("assistant", ""), ("user", "")]
    assert found[1]["loss"] == nasty and not found[1]["valid"] and found[1]["error_turn"] == 2
    assert found[3]["valid"] and found[3]["loss"] == "a" * 200_000
    assert [tuple(t) for t in found[None]["back"]] == [("we<ird>\n", "t")] and tuple(found[2]["back"][0]) == ("", "x")
    assert found[4]["error_turn"] == 1 and found[5]["error_turn"] == 1 and len(found[4]["back"]) == 2
    assert chat.format_chats(df.where("false")).count() == 0


def test_compression_limits_come_from_every_document(spark):
    # a hundred texts of one length among many short ones: a draw of two thirds would leave too few of them
    usual = [(k, " ".join(random.Random(k).choices([sentence(j, 1, WORDS) for j in range(300)], k=70))[:900].ljust(900, "x")) for k in range(compression.ENOUGH)]
    docs = spark.createDataFrame(usual, "doc_id long, text string").unionByName(spark.range(1000, 31_000).selectExpr("id AS doc_id", "cast(id AS string) AS text"))
    assert list(compression.fit(docs)) == [9]
    by_limits = {r["doc_id"]: r["kept"] for r in compression.measure(docs, compression.fit(docs)).where("doc_id < 1000").collect()}
    assert by_limits == {r["doc_id"]: r["kept"] for r in compression.measure(docs).where("doc_id < 1000").collect()}
