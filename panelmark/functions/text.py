"""Text columns: cleaning, screening and small look-ups, all JVM-side.

Word boundaries follow Unicode letters and digits, so accented prose behaves
the same as plain ASCII labels.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark import constants as C

# A word edge that treats accented letters as letters, unlike Java's plain \b.
WORD_CHARS = r"\p{L}\p{N}_"


def text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lookup(mapping: dict[str, str], key: Column, default: Column) -> Column:
    """Constant table as a literal map: no join, no shuffle."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def any_of(phrases: list[str]) -> str:
    """Pattern that finds any of the (constant) phrases.

    Phrases with a beginning in common share a branch, and one class of first
    characters keeps the search from trying every phrase at every place.
    """
    def tree(rests: list[str]) -> str:
        if "" in rests:
            return ""
        heads = {c: [r[1:] for r in rests if r[0] == c] for c in dict.fromkeys(r[0] for r in rests)}
        branches = [re.escape(c).replace(r"\ ", " ") + tree(rest) for c, rest in heads.items()]
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    if not phrases or "" in phrases:
        return ""
    first = "".join(dict.fromkeys(re.escape(p[0]).replace(r"\ ", " ") for p in phrases))
    return f"(?=[{first}])" + tree(list(phrases))


def has_any(column: Column, phrases: list[str]) -> Column:
    """True when any of the (constant) phrases occurs: one compiled pattern."""
    return column.rlike(any_of(phrases))


def may_have(column: Column, words: list[str]) -> Column:
    """True where any of the (constant) words occurs; compares bytes, so it is the cheap test in front of a pattern."""
    return reduce(lambda a, b: a | b, [column.contains(w) for w in words])


def norm_whitespace(column: str | Column) -> Column:
    # a single blank stays as it is, so most texts are not written anew
    return F.trim(F.regexp_replace(text(column), r"[^\S ]\s*| \s+", " "))


def valid_value(column: str | Column) -> Column:
    """A value was really read: not null, not blank, not a placeholder word."""
    cleaned = F.lower(F.trim(text(column)))
    return (cleaned != "") & ~cleaned.isin(C.ABSENT_TEXTS)


def is_barcode(column: str | Column) -> Column:
    return F.trim(text(column)).rlike(r"^[\s\-]*+(?:[0-9][\s\-]*+){12,14}$")


def normalise_line(column: str | Column) -> Column:
    """Even out the spacing around full stops, colons and commas."""
    spaced = F.regexp_replace(text(column), r"\s*\.\s*", ".")
    spaced = F.regexp_replace(spaced, r"\s*:\s*", ": ")
    spaced = F.regexp_replace(spaced, r"\s*,\s*", ", ")
    return norm_whitespace(spaced)


def fix_glyphs(column: str | Column) -> Column:
    """Letters that scanners take for digits, turned back."""
    return F.translate(text(column), "OoIl|ZzSsBGq", "001112255869")


def licence_14(column: str | Column) -> Column:
    """Fourteen digits starting with 1 or 2 after removing noise letters.

    The noise class holds single letters, not words, and keeps the hyphen.
    """
    squeezed = F.regexp_replace(text(column), r"(?i)[fsailcno|.:\s]", "")
    return F.nullif(
        F.regexp_extract(fix_glyphs(squeezed), r"\b([12][0-9]{13})\b", 1), F.lit("")
    )


def indic_digits(column: str | Column) -> Column:
    digits = "".join(chr(zero + i) for zero in C.INDIC_ZEROES for i in range(10))
    value = text(column)
    # a text of single bytes has none, and is not written anew
    plain = F.octet_length(value) == F.length(value)
    return F.when(plain, value).otherwise(F.translate(value, digits, "0123456789" * len(C.INDIC_ZEROES)))


def language_code(column: str | Column) -> Column:
    return lookup(C.LANGUAGES, F.lower(F.trim(text(column))), F.lit(C.DEFAULT_LANGUAGE))


def region_label(column: str | Column) -> Column:
    return lookup(C.REGION_LABELS, F.lower(F.trim(text(column))), F.lit(C.DEFAULT_REGION))


def script_of(column: str | Column) -> Column:
    devanagari = text(column).rlike("[ऀ-ॿ]")
    return F.when(devanagari, "Bilingual (Latin + Devanagari)").otherwise("Latin (English)")


def friendly_field(field: str | Column) -> Column:
    """Report label of a field; unknown fields are title-cased word by word."""
    raw = text(field)
    key = F.regexp_replace(F.lower(raw), r"[\s\-]+", "_")
    words = F.transform(
        F.split(F.regexp_replace(raw, "_", " "), " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
    )
    shown = F.array_join(words, " ")
    fallback = F.when(shown == "", "Statutory Requirement").otherwise(shown)
    return lookup(C.FIELD_LABELS, key, fallback)


# ---------------------------------------------------------------- screening


def _vowel_share_low(column: Column, least: int) -> Column:
    # what is left is measured: counting matches would write each of them
    letters = F.length(F.regexp_replace(column, "[^A-Za-z]+", ""))
    vowels = F.length(F.regexp_replace(column, "[^aeiouyAEIOUY]+", ""))
    # a fifth of all characters is more than the share asked of the letters, which then need no count
    low = (letters >= least) & ((vowels == 0) | (vowels / letters < 0.18))
    return F.when(vowels * 5 < F.length(column), low).otherwise(F.lit(False))


def _phrase_hit(column: Column, phrases: list[str]) -> Column:
    lowered = F.lower(F.trim(column))
    packed = lowered
    for c in " :_":
        packed = F.replace(packed, F.lit(c), F.lit(""))
    return has_any(lowered, phrases) | has_any(packed, phrases)


def bad_generic_name(column: str | Column) -> Column:
    """Boilerplate, codes, unpronounceable, numeric or header text."""
    value = F.trim(text(column))
    code = value.rlike(r"^(?=[A-Za-z0-9\-_]{4,}+$)(?=.*[0-9])(?=.*[A-Za-z])")
    numeric = value.rlike(r"^[0-9\s.,:;\-/]+$")
    header = F.upper(value).rlike("^(" + "|".join(re.escape(h) for h in C.GENERIC_NAME_HEADERS) + ")")
    return (
        (text(column) == "")
        | _phrase_hit(value, C.GENERIC_NAME_PHRASES)
        | code
        | _vowel_share_low(value, 5)
        | numeric
        | header
    )


def bad_ingredient(column: str | Column) -> Column:
    value = F.trim(text(column))
    return (text(column) == "") | (
        (F.length(value) <= 40) & _phrase_hit(value, C.INGREDIENT_PHRASES)
    )


# A word without vowels or with more than 85 % of other letters has three of them in a row, and seven letters if it has a vowel
_ODD_WORD = (
    f"(?<![{WORD_CHARS}])(?:(?=[A-Za-z]*(?i:[bcdfghjklmnpqrstvwxyz]{{5}}))[A-Za-z]{{5,}}+"
    f"|(?=[A-Za-z]*(?i:[bcdfghjklmnpqrstvwxz]{{3}}))[A-Za-z]{{7,}}+)(?![{WORD_CHARS}])"
)


def suspicious_text(column: str | Column) -> Column:
    """First reason why the text looks made up, null when it looks fine.

    One pattern finds the words that may be gibberish; only these are counted out.
    """
    value = F.trim(text(column))
    lowered = F.lower(value)
    placeholder = F.coalesce(*[F.when(lowered.contains(p), F.lit(p)) for p in C.PLACEHOLDER_PHRASES])
    words = F.regexp_extract_all(value, F.lit(_ODD_WORD), F.lit(0))

    def reason(word: Column) -> Column:
        size = F.length(word)
        vowels = F.regexp_count(F.lower(word), F.lit("[aeiouy]"))
        dense = (vowels == 0) | ((size - vowels) / size > 0.85)
        run = F.lower(word).rlike("[bcdfghjklmnpqrstvwxyz]{5,}")
        return F.when(dense, F.concat(F.lit("consonant density: "), word)).when(
            run, F.concat(F.lit("consonant run: "), word)
        )

    gibberish = F.get(F.array_compact(F.transform(words, reason)), F.lit(0))
    return F.coalesce(F.concat(F.lit("placeholder: "), placeholder), gibberish)


def clean_title(given: str | Column, detected: str | Column) -> Column:
    """Product title: the typed one unless it is a file name, hash or gibberish."""
    found = F.trim(text(detected))
    found = F.when(bad_generic_name(found), F.lit("")).otherwise(found)
    typed = F.trim(text(given))
    has_found = found != ""
    file_name = typed.rlike(r"(?i)\.(?:jpg|jpeg|png|webp|bmp|tiff|heic)$")
    camera = typed.rlike(
        r"(?i)^(?:IMG|DSC|PXL|PHOTO|IMAGE|SCREENSHOT|WHATSAPP|SCAN|DOC)[_\-\s0-9]"
    )
    hashed = typed.rlike(r"^[A-Za-z0-9_\-]{8,}$")
    default = F.lit(C.DEFAULT_TITLE)
    return (
        F.when((typed == "") | F.lower(typed).isin(C.DEFAULT_TITLES),
               F.when(has_found, found).otherwise(default))
        .when(file_name, F.when(has_found, found).otherwise(F.regexp_replace(typed, r"\.[^.]+$", "")))
        .when(camera | _vowel_share_low(typed, 6), F.when(has_found, found).otherwise(default))
        .when(has_found & hashed, found)
        .when(F.length(typed) >= 3, typed)
        .when(has_found, found)
        .otherwise(typed)
    )


# ------------------------------------------------------------ number masks

# What a translator must not touch, in this order
PROTECTED_PATTERNS = [
    r"(?:₹|Rs\.?|INR)\s*[\d,]+(?:\.\d{1,2})?",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{2}[/-]\d{4}\b",
    r"\b\d+(?:\.\d+)?\s*(?:kg|g|gm|gms|mg|l|ml|ltr|litres?|m|cm|mm|units?|pieces?|N)\b",
    r"\b\d{14}\b",
    r"\b1800[-\s]?\d{3}[-\s]?\d{4}\b|\b1800\d{6,8}\b",
    r"\b\d+(?:\.\d+)?\b",
]
# The ones that tell capitals from small letters
CASED_PATTERNS = {1, 3, 4, 5}


def mask_numbers(df: DataFrame, column: str) -> DataFrame:
    """Adds ``masked`` (numbers replaced by ``__NUM_k__``) and ``registry`` (by k)."""
    masked = df.withColumn("masked", indic_digits(column)).withColumn(
        "registry", F.array().cast("array<string>")
    )
    for index, pattern in enumerate(PROTECTED_PATTERNS):
        regex = ("(?U)" if index in CASED_PATTERNS else "(?iU)") + pattern
        masked = (
            masked.withColumn("_hits", F.regexp_extract_all("masked", F.lit(regex), F.lit(0)))
            .withColumn("_parts", F.split("masked", regex, -1))
            .withColumn("_base", F.size("registry"))
            .withColumn(
                "masked",
                F.array_join(
                    F.transform(
                        "_parts",
                        lambda part, i: F.when(
                            i < F.size("_hits"),
                            F.concat(part, F.lit("__NUM_"), F.col("_base") + i, F.lit("__")),
                        ).otherwise(part),
                    ),
                    "",
                ),
            )
            .withColumn("registry", F.concat("registry", "_hits"))
            .drop("_hits", "_parts", "_base")
        )
    return masked


def unmask_numbers(masked: str | Column, registry: str | Column) -> Column:
    """Puts the registered numbers back into (translated) text."""
    column = F.col(masked) if isinstance(masked, str) else masked
    numbers = F.col(registry) if isinstance(registry, str) else registry
    parts = F.split(column, "(?i)__NUM_[0-9]+__", -1)
    slots = F.regexp_extract_all(column, F.lit("(?i)__NUM_([0-9]+)__"), F.lit(1))
    return F.array_join(
        F.transform(
            parts,
            lambda part, i: F.concat(
                part, F.coalesce(F.get(numbers, F.get(slots, i).try_cast("int")), F.lit(""))
            ),
        ),
        "",
    )
