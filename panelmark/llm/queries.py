"""Named queries of the operators, over whole tables, and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm import (
    chat, compression, decontaminate, forest, hilbert, langid, mining, mixing, pseudonyms, substrings, toxicity, urlfilter, whitening,
)
from panelmark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: a key for the test tables; real runs bring their own secret
KEY = b"key of the test tables"


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    # a row without an id is none of the held-out ones
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    told = langid.predictor(docs, model)(F.col("text"))
    return docs.select("doc_id", held_out.alias("held_out"), told.alias("found")).select("doc_id", "held_out", "found.*")


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(toxicity.graded(docs, table(spark, sf, "labels"))))


@query
def op6_compression_bands(spark: SparkSession, sf: str) -> DataFrame:
    return compression.measure(table(spark, sf, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("span_starts", "span_ends")


@query
def op2_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf, "documents"), KEY)


@query
def op8_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert.shard(table(spark, sf, "documents"), whole=False)


@query
def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    chats = chat.format_chats(turns.unionByName(tricky))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("_turns", chat.read_turns(F.col("formatted"))).withColumn("_loss", chat.read_loss(F.col("segments"))).select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "error_turn")


ORACLES["op9_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w - 1 AS k
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (
  SELECT *, length(text) + length(role) + length(regexp_replace(text || role, '[^\\<>]', '', 'g')) + 16 AS chars,
    CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN k = 1 AND role = 'user'
         WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END AS fine
  FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(fine) AND max_by(role, k) = 'assistant' AS valid,
  CASE WHEN NOT bool_and(fine) THEN min(k) FILTER (WHERE NOT fine)
       WHEN max_by(role, k) <> 'assistant' THEN count(*) END::INTEGER AS error_turn
FROM m GROUP BY conv_id
"""


#: the tree of the test tables: one large crawl, and two kinds of smaller sources
DOMAIN = "CASE WHEN source = 'src0' THEN 'crawl' WHEN source RLIKE '[02468]$' THEN 'books' ELSE 'forum' END"
WEIGHTS = {
    ("crawl",): 2, ("books",): 5, ("forum",): 3,
    ("books", "en"): 4, ("books", "de"): 3, ("books", "fr"): 2, ("forum", "en"): 3, ("forum", "es"): 2,
    ("books", "en", "src2"): 3, ("forum", "en", "src1"): 2,
}


@query
def op4_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf, "documents"), F.expr(DOMAIN), WEIGHTS, Fraction(4, 5), seed=11, max_epochs=2)
    return chosen.select("doc_id", "lang", "source", "mix_domain", "mix_tokens", "mix_epoch")


def _mix_oracle() -> str:
    """Water-filling level by level, then prefix sums of the seeded order."""
    weight = {d: " ".join(f"WHEN '{chr(31).join(p)}' THEN {w}" for p, w in WEIGHTS.items() if len(p) == d) for d in (1, 2, 3)}
    levels = ["mix_domain", "lang", "source"]
    ctes, before = [], "root"
    for d in (1, 2, 3):
        path, up = ", ".join(levels[:d]), ", ".join(levels[:d - 1])
        part = f"PARTITION BY {up}" if up else ""
        parent = f"JOIN {before} USING ({up})" if up else f"CROSS JOIN {before}"
        name = " || chr(31) || ".join(levels[:d])
        ctes.append(f"""
n{d} AS (SELECT {path}, sum(tokens)::HUGEINT * 2 AS capacity FROM leaves GROUP BY ALL),
w{d} AS (SELECT n.*, budget, CASE {name} {weight[d]} ELSE 1 END::HUGEINT AS weight FROM n{d} n {parent}),
r{d} AS (SELECT *, coalesce(sum(capacity) OVER b, 0)::HUGEINT AS used,
    (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER b, 0))::HUGEINT AS rest
  FROM w{d} WINDOW b AS ({part} ORDER BY capacity::DOUBLE / weight, {levels[d - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{d} AS (SELECT *, capacity * rest <= (budget - used) * weight AS is_full FROM r{d}),
b{d} AS (SELECT {path}, CASE WHEN is_full THEN capacity ELSE least(capacity,
    ((budget - coalesce(sum(capacity) FILTER (WHERE is_full) OVER ({part}), 0)::HUGEINT) * weight)
    // (sum(weight) FILTER (WHERE NOT is_full) OVER ({part}))::HUGEINT) END AS budget FROM f{d}),""")
        before = f"b{d}"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_matches(source, '[02468]$') THEN 'books' ELSE 'forum' END AS mix_domain,
    coalesce(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')), 0) AS tokens, lang AS lang0, source AS source0
  FROM documents),
leaves AS (SELECT mix_domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
root AS (SELECT (sum(tokens)::HUGEINT * 4) // 5 AS budget FROM leaves),
{"".join(ctes)}
p AS (SELECT *, budget // tokens AS epochs, budget % tokens AS rest FROM b3 JOIN leaves USING (mix_domain, lang, source) WHERE tokens > 0),
k AS (SELECT d.*, epochs, rest, md5('11|' || epochs::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM d JOIN p USING (mix_domain, lang, source)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY mix_domain, lang, source ORDER BY key) <= rest AND rest > 0 AS fits FROM k)
SELECT doc_id, lang0 AS lang, source0 AS source, mix_domain, tokens AS mix_tokens,
  unnest(range((epochs + CASE WHEN fits THEN 1 ELSE 0 END)::BIGINT)) AS mix_epoch FROM s
"""


ORACLES["op4_source_mix"] = _mix_oracle()


@query
def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf, "documents"), with_text=False)


ORACLES["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_id FROM h) WHERE first_id < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM m),
c AS (SELECT doc_id, count(*) AS n_removed, list(k) AS ks FROM x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF ks IS NULL OR NOT list_contains(ks, j)], ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
ORACLES["op7_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM v),
h AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN z WHERE len(w) >= n)),
m AS (SELECT doc_id, i, h.n, item_id FROM h JOIN v ON h.n = v.n AND h.s = v.s),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id)
"""


@query
def op3_jaccard_forest(spark: SparkSession, sf: str) -> DataFrame:
    return forest.jaccard_links(table(spark, sf, "documents"))


ORACLES["op3_jaccard_forest"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (
  SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
c AS (SELECT h, min(doc_id) AS class_id, count(*) AS members, any_value(n) AS n FROM z GROUP BY h),
r AS (SELECT class_id, members, n, g FROM c JOIN s ON s.doc_id = class_id),
p AS (SELECT a.class_id AS a, b.class_id AS b, any_value(b.members) AS members
  FROM r a JOIN r b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id HAVING 5 * count(*) >= 4 * (any_value(a.n) + any_value(b.n) - count(*))),
t(a, root) AS (SELECT class_id, class_id FROM c UNION SELECT p.b, t.root FROM t JOIN p ON p.a = t.a WHERE t.root < p.b),
m AS (SELECT a, min(root) AS group_id FROM t GROUP BY a),
l AS (SELECT a, sum(members) AS linked, count(*) AS classes FROM p GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(m.group_id, d.doc_id) AS group_id,
  coalesce(c.members - 1 + coalesce(linked, 0), 0)::BIGINT AS n_links, coalesce(classes, 0)::BIGINT AS n_linked_classes
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN c ON c.h = z.h LEFT JOIN l ON l.a = c.class_id LEFT JOIN m ON m.a = c.class_id
"""


@query
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mining.mine(table(spark, sf, "embeddings"), F.col("embedding"), F.col("vec_id"), moved, F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@query
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"), F.col("embedding"), F.col("vec_id"))


RULES = [
    urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"), urlfilter.Rule("block", "com", "/de/"),
]
#: names of sites whose pages are on the list of the test tables
LISTED = r"(^|\.)(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)\."


@query
def op13_url_cascade(spark: SparkSession, sf: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf, "pages").select("page_id", "url"), RULES, F.col("host").rlike(LISTED))
    return judged.select("page_id", "host", "path", "rule", "listed", "verdict")


ORACLES["op13_url_cascade"] = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
u AS (SELECT *, '.' || host AS h FROM p),
v AS (SELECT *, CASE
    WHEN ends_with(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with(h, '.org') AND starts_with(path, '/') THEN 'org/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/' END AS rule,
  host || path IN (SELECT host || path FROM p
    WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)\.')) AS listed FROM u)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""
