"""Which rules apply to which package, and which rules are well formed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantType

from panelmark import constants as C
from panelmark.functions.text import lookup, text
from panelmark.plans.catalog import CONDITION_SCHEMA
from panelmark.session import cut, spread


def candidate_texts(category: Column) -> Column:
    """Texts that a rule's category may contain to apply to this category."""
    target = F.trim(F.coalesce(category, F.lit("ALL")))
    generic = F.array(*[F.lit(c) for c in C.GENERIC_CATEGORIES])
    parts = F.transform(F.split(target, "&"), lambda p: F.trim(p))
    own = F.when(
        (target == "") | target.isin(C.GENERIC_CATEGORIES), F.array().cast("array<string>")
    ).otherwise(
        F.when(target.contains("&"), F.concat(F.array(target), parts)).otherwise(F.array(target))
    )
    return F.array_distinct(F.concat(generic, own))


GRAM = 3


def _grams(column: Column, length: int) -> Column:
    """Distinct pieces of ``length`` characters."""
    starts = F.sequence(F.lit(1), F.length(column) - (length - 1))
    return F.when(F.length(column) >= length, F.array_distinct(F.transform(starts, lambda at: F.substring(column, at, F.lit(length))))).otherwise(
        F.array().cast("array<string>"))


def category_matches(categories: DataFrame, rule_categories: DataFrame) -> DataFrame:
    """(category, product_category) pairs where the rule text contains a candidate.

    Both inputs are vocabularies of distinct texts. The test is a case-blind
    LIKE with the candidate's own wildcards, so it is run as an equi join: rule
    texts are indexed by their pieces of up to three characters, a candidate is
    looked up by the piece of its plain runs that the fewest texts have; LIKE
    then decides on the pairs that are left. A candidate without a run of three
    characters is looked up by its longest run.
    """
    lowered = F.lower("product_category")
    pieces = F.concat(F.array(F.lit("")), *[_grams(lowered, n) for n in range(1, GRAM + 1)])
    indexed = rule_categories.where(F.col("product_category").isNotNull()).select("product_category", F.explode(pieces).alias("_key"))
    named = categories.select("category", F.explode(candidate_texts(F.col("category"))).alias("candidate"))
    runs = F.split(F.lower("candidate"), "[_%]")
    longest = F.aggregate(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    keys = F.when(F.length(longest) >= GRAM, F.flatten(F.transform(runs, lambda run: _grams(run, GRAM)))).otherwise(F.array(longest))
    offered = named.select("candidate").distinct().select("candidate", F.explode(keys).alias("_key"))
    frequency = indexed.groupBy("_key").agg(F.count("*").alias("_texts"))
    # a piece that no text has is the rarest, and then finds none
    looked_up = offered.join(frequency, "_key", "left").groupBy("candidate").agg(
        F.min_by("_key", F.struct(F.coalesce("_texts", F.lit(0)), "_key")).alias("_key"))
    fits = F.expr("product_category ILIKE concat('%', candidate, '%')")
    matched = looked_up.join(indexed, "_key").where(fits).select("candidate", "product_category")
    return named.join(matched, "candidate").select("category", "product_category").distinct()


def applicable_rules(
    packages: DataFrame,
    rules: DataFrame,
    evaluation_date: date | None = None,
    regulation: str | None = None,
) -> DataFrame:
    """(package, rule) pairs: active rules whose date window and category fit.

    ``packages`` needs inspection_id and category, and evaluation_date unless
    one date is given for all. The text match runs on distinct categories, the
    packages themselves take part in equi joins only.
    """
    live = rules.where(
        F.coalesce("is_active", F.lit(False)) & (F.coalesce("field_name", F.lit("")) != "")
    )
    if regulation and regulation.strip():
        wanted = f"%{regulation.strip()}%"
        live = live.where(
            F.col("regulation").ilike(wanted) | F.coalesce("statutory_reference", F.lit("")).ilike(wanted)
        )
    if evaluation_date is not None:
        packages = packages.withColumn("evaluation_date", F.lit(evaluation_date))
    keyed = packages.withColumn("category", F.coalesce("category", F.lit("ALL")))
    # a rule without a category applies to all of them, and so does "ALL"
    live = live.withColumn("product_category", F.coalesce("product_category", F.lit("ALL")))
    matched = category_matches(
        keyed.select("category").distinct(), live.select("product_category").distinct()
    )
    per_category = matched.join(live, "product_category").dropDuplicates(["category", "rule_id"])
    in_force = (
        F.col("effective_from").isNull() | (F.col("effective_from") <= F.col("evaluation_date"))
    ) & (F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("evaluation_date")))
    return _meet(keyed, per_category).where(in_force)


#: (category, rule) rows that travel to every task; more are dealt with the packages over this many shares of a category
TRAVELLING, SHARES = 20_000, 64


def _meet(packages: DataFrame, per_category: DataFrame) -> DataFrame:
    """Each package with the rules of its category.

    There are far fewer categories than packages, so packages must not be dealt
    by category alone: a few tasks would judge them all. The rules of the
    categories are written once; as long as they are few they travel, else each
    share of a category meets a copy of its rules.
    """
    per_category = cut(per_category)
    if per_category.limit(TRAVELLING + 1).count() <= TRAVELLING:
        return packages.join(F.broadcast(per_category), "category")
    share = F.pmod(F.xxhash64("inspection_id"), F.lit(SHARES)).cast("int")
    copies = per_category.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return packages.withColumn("_share", share).join(spread(copies), ["category", "_share"]).drop("_share")


# ------------------------------------------------------------- rule loading


def validate_rules(rules: DataFrame) -> DataFrame:
    """Adds ``reason``: why a rule must be rejected, null when it is fine."""
    start = F.col("effective_from").cast("string").try_cast("timestamp")
    end = F.col("effective_to").cast("string").try_cast("timestamp")
    both = (F.coalesce(F.col("effective_from").cast("string"), F.lit("")) != "") & (
        F.coalesce(F.col("effective_to").cast("string"), F.lit("")) != ""
    )
    reason = (
        F.when(F.trim(text("rule_id")) == "", "rule id is missing")
        .when(
            ~F.coalesce("rule_type", F.lit("MANDATORY_FIELD")).isin(C.RULE_TYPES),
            F.concat(F.lit("unknown rule type: "), F.col("rule_type")),
        )
        .when(both & (start.isNull() | end.isNull()), "a date is not readable")
        .when(both & (end < start), "effective_to is before effective_from")
    )
    return rules.withColumn("reason", reason)


def applicability_category(applicability: Column) -> Column:
    """Category of the first known tag; unknown tags stand for themselves."""
    chosen = F.when(F.size(applicability) == 0, F.lit("ALL"))
    for tag, category in C.APPLICABILITY_CATEGORIES:
        chosen = chosen.when(F.array_contains(applicability, tag), F.lit(category))
    return chosen.otherwise(F.array_join(applicability, ", "))


def _is_string(raw: DataFrame, name: str) -> bool:
    return isinstance(raw.schema[name].dataType, StringType)


def _json_text(raw: DataFrame, name: str) -> Column:
    """A column of a feed as text: texts as they are, lists and objects as JSON; null where the feed has no such column."""
    if name not in raw.columns:
        return F.lit(None).cast("string")
    if _is_string(raw, name):
        return F.col(name)
    if isinstance(raw.schema[name].dataType, VariantType):
        plain = F.try_variant_get(name, "$", "string")
        return F.when(F.schema_of_variant(name) == "STRING", plain).otherwise(F.nullif(F.to_json(name), F.lit("null")))
    return F.to_json(name)


def _shape(json: Column) -> Column:
    """ARRAY, OBJECT or another kind of JSON, null for text that is none."""
    return F.regexp_extract(F.schema_of_variant(F.try_parse_json(F.when(json.rlike(r"^\s*[\[{]"), json))), "^[A-Z]+", 0)


def _given(json: Column) -> Column:
    """Null instead of an empty text, list or object."""
    return F.when(~F.regexp_replace(json, r"\s", "").isin("", "[]", "{}"), json)


def canonicalise_rules(raw: DataFrame) -> DataFrame:
    """Raw catalogue rows to executable rules, whatever shape the feed gives them.

    ``applicability`` is one tag (comma or not), a list of tags, or a list
    written as JSON text; ``parameters`` an object or its JSON text, anything
    else counting as no parameters. Both columns, and ``condition`` and
    ``provision``, may be texts, lists, objects or variants that hold now one,
    now the other. The type stands in ``validation_type``, else in
    ``rule_type``; a rule of an unknown type keeps its own ``rule_type`` and its
    own ``condition``, if it has them. The chapter stands in ``chapter`` or in
    the provision, and a given ``required`` overrules what follows from it.
    """
    def column(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast(kind)

    def filled(name: str) -> Column:
        return F.nullif(column(name), F.lit(""))

    kind = F.upper(F.coalesce(filled("validation_type"), filled("rule_type"), F.lit("PRESENCE")))
    applicability, parameters = _json_text(raw, "applicability"), _json_text(raw, "parameters")
    listed = F.from_json(F.when(_shape(applicability) == "ARRAY", applicability), "array<string>")
    single = F.when(F.coalesce(applicability, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(applicability))
    tags = F.coalesce(listed, single)
    plain = F.when(_shape(parameters) == "OBJECT", parameters).otherwise("{}")
    params = F.from_json(
        plain,
        "allowed_units array<string>, allowed_terms array<string>, format string, "
        "required_phrases_any_of array<string>, required_phrase_all string, mandatory boolean",
    )

    def condition(operator: str, values: Column) -> Column:
        return F.to_json(F.struct(F.lit(operator).alias("operator"), values.alias("values")))

    units = F.coalesce(
        F.col("_params.allowed_units"), F.array(*[F.lit(u) for u in C.DEFAULT_ALLOWED_UNITS])
    )
    phrases = F.array(*[F.lit(p) for p in C.TAX_PHRASES])
    has_phrases = F.col("_params.required_phrases_any_of").isNotNull() | F.col(
        "_params.required_phrase_all"
    ).isNotNull()
    known = dict(C.RULE_TYPE_ALIASES)
    built = (
        F.when(kind == "PRESENCE", F.lit('{"operator":"present"}'))
        .when(kind == "UNIT", condition("one_of", units))
        .when((kind == "FORMAT") & has_phrases, condition("contains_any", phrases))
        .when(
            (kind == "FORMAT") & F.col("_params.allowed_terms").isNotNull(),
            condition("one_of", F.col("_params.allowed_terms")),
        )
        .when(
            kind == "DATE",
            F.to_json(
                F.struct(
                    F.lit("is_valid_date").alias("operator"),
                    F.coalesce("_params.format", F.lit("DD/MM/YYYY or MM/YYYY")).alias("format"),
                )
            ),
        )
        .when(~kind.isin(list(known)), F.coalesce(_given(_json_text(raw, "condition")), plain))
        .otherwise(plain)
    )
    chapter = F.coalesce(column("chapter"), F.get_json_object(_json_text(raw, "provision"), "$.chapter"), F.lit(""))
    second_chapter = chapter.contains("II") | chapter.contains("Retail sale")
    not_required = (
        F.col("rule_id").isin(C.NOT_REQUIRED_RULE_IDS)
        | ~F.coalesce("_params.mandatory", F.lit(True))
        | ~second_chapter
        | kind.isin("APPLICABILITY_EXCLUSION", "DIMENSION")
    )
    field = F.coalesce(filled("field"), column("field_name"), F.lit(""))
    return raw.withColumn("_params", params).select(
        "rule_id",
        "source_rank",
        applicability_category(tags).alias("product_category"),
        field.alias("field_name"),
        F.coalesce(lookup(known, kind, F.lit(None)), filled("rule_type"), F.lit("MANDATORY_FIELD")).alias("rule_type"),
        built.alias("condition"),
        F.coalesce(column("required", "boolean"), ~not_required).alias("required"),
        F.coalesce("severity", F.lit("HIGH")).alias("severity"),
        F.coalesce(
            filled("error_message"),
            filled("description"),
            F.concat(F.lit("Declaration '"), field, F.lit("' is not in order.")),
        ).alias("error_message"),
        F.coalesce(column("version"), F.lit("2026.1.0")).alias("version"),
        (F.coalesce(column("verification_status"), F.lit("")) != "DEPRECATED").alias("is_active"),
    )


def dedup_rules(rules: DataFrame, rank: str = "source_rank") -> DataFrame:
    """First row per rule id in source order, retired ids dropped."""
    kept = rules.where(~F.col("rule_id").isin(C.RETIRED_RULE_IDS) & (text("rule_id") != ""))
    row = F.struct(*[F.col(c) for c in rules.columns])
    first = kept.groupBy("rule_id").agg(F.min_by(row, rank).alias("_row"))
    return first.select("_row.*")


def parse_conditions(rules: DataFrame) -> DataFrame:
    """Adds ``cond`` and a checked, Java-ready ``pattern`` with ``pattern_ok``."""
    parsed = rules.withColumn("cond", F.from_json("condition", CONDITION_SCHEMA))
    pattern = F.regexp_replace(F.coalesce("cond.pattern", F.lit("")), r"\(\?P<", "(?<")
    return parsed.withColumn("pattern", pattern).withColumn(
        "pattern_ok",
        F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern")).isNotNull(),
    )


def canonical_type(rule_type: Column) -> Column:
    upper = F.upper(F.coalesce(rule_type, F.lit("MANDATORY_FIELD")))
    return lookup(C.RULE_TYPE_ALIASES, upper, upper)


def mandatory_flag(rules: DataFrame) -> Column:
    field = F.lower(F.trim(text("field_name")))
    marked = F.upper(F.trim(text("rule_id"))).rlike("ALLERGEN|VOLUNTARY")
    inferred = (
        F.when(field.isin(C.OPTIONAL_FIELDS) | marked, F.lit(False))
        .when(field.isin(C.CORE_FIELDS), F.lit(True))
        .otherwise(F.coalesce("required", F.lit(True)))
    )
    if "is_mandatory" in rules.columns:
        return F.coalesce("is_mandatory", inferred)
    return inferred


OPTIONAL_TEXT = "Optional field"
REQUIRED_TEXT = "Must be declared on the package."


def expected_text(mandatory: Column, given: Column) -> Column:
    stated = F.coalesce(F.nullif(given, F.lit("")), F.lit(REQUIRED_TEXT))
    return (
        F.when(~mandatory, F.lit(OPTIONAL_TEXT))
        .when(F.lower(stated).contains("optional"), F.lit(REQUIRED_TEXT))
        .otherwise(stated)
    )
