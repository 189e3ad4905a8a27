"""Quality rules with compression bands.

Two zstandard ratios (bytes of the text over bytes of its frame) are taken:
one of the whole document, and those of its fixed chunks. Text that repeats
itself packs too well, noise packs too badly. What is usual depends on the
length, so the limits are learned for each band of lengths (a band reaches from
one power of two bytes to the next): from the quartiles of the logarithm of the
ratio they lie ``REACH`` times the distance of the quartiles away. For chunks
the least and the greatest ratio of a document are judged alike. They are
learned from every document that passes the base rules, the quartiles being
those of the logarithms rounded to ``STEP``; as much as a quarter of a band may
be odd on either side without moving them far. A band with fewer than
``ENOUGH`` of them, and any text if nothing is learned, has the wide limits of
``BANDS``.

A text is kept if it passes the base rules and all limits of its bands. The
base rules count words ``[^\\x20\\x09-\\x0D]+``, symbols, repeated lines and
words in repeated three-word windows.

Defined cases: a null or empty text has no words, so the base rules reject it;
its ratios are null. Rows that repeat are judged alike. Texts of any length
are packed whole; chunks cover all of the text, a last chunk shorter than half
a chunk belongs to the one before.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import ascii_words, free_name, text_udf
from panelmark.session import cut

Limits = dict[int, tuple[float, float, float, float]]
#: where nothing is learned: bytes below -> least and greatest ratio; the last band has no upper end
BANDS: tuple[tuple[float, float, float], ...] = (
    (512, 0.90, 4.0),
    (2048, 1.15, 5.0),
    (8192, 1.30, 6.0),
    (float("inf"), 1.40, 7.0),
)
CHUNK = 4096
#: fewest documents in a band, how far from the quartiles the limits lie, and what logarithms are rounded to
ENOUGH, REACH, STEP = 100, 3.0, 1e-5
SYMBOLS = re.compile(r"[#*$%&|<>]")
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, chunk_min double, chunk_max double"
)


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 1 << 20:  # three ids would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(known) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:shift + n - 2] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return repeats


def within(size: int, ratio: float, bands=BANDS) -> bool:
    low, high = next((low, high) for below, low, high in bands if size < below)
    return low <= ratio <= high


def chunks_of(data: bytes, chunk: int) -> list[bytes]:
    cuts = list(range(0, len(data), chunk))
    if len(cuts) > 1 and len(data) - cuts[-1] < chunk / 2:
        cuts.pop()
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]


def band_of(size: int) -> int:
    """The band of a length: below 512 bytes 8, then one for each power of two."""
    return max(8, size.bit_length() - 1)


def judge(text: str | None, pack, limits: Limits | None = None, chunk: int = CHUNK) -> tuple:
    if not text:
        return 0, 0, 0, 0, 0, True, False, None, None, None
    data = text.encode("utf-8", "surrogatepass")
    words = ascii_words(text)
    n, repeats = len(words), repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    ratio = len(data) / len(pack(data))
    parts = chunks_of(data, chunk)
    ratios = [len(p) / len(pack(p)) for p in parts] if len(parts) > 1 else [ratio]
    own = (limits or {}).get(band_of(len(data)))
    if own:
        good = own[0] <= ratio <= own[1] and own[2] <= min(ratios) and max(ratios) <= own[3]
    else:
        good = within(len(data), ratio) and all(within(len(p), r) for p, r in zip(parts, ratios))
    return (
        n, chars, len(SYMBOLS.findall(text)), repeated_lines(text), repeats, failed, good and not failed,
        ratio, min(ratios), max(ratios),
    )


def quality(limits: Limits | None = None, chunk: int = CHUNK, level: int = 3):
    """The column function that judges a text."""

    def start():
        import zstandard

        pack = zstandard.ZstdCompressor(level=level).compress
        return lambda text: judge(text, pack, limits, chunk)

    return text_udf(SCHEMA, start)


def _measured(docs: DataFrame, *columns: str, chunk: int = CHUNK) -> DataFrame:
    """``columns``, the band and the judgement by the wide limits."""
    size = F.octet_length(F.col("text").cast("string"))
    band = F.greatest(F.lit(8), F.floor(F.log2(size.cast("double")))).cast("int")
    return docs.select(*columns, band.alias("band"), quality(None, chunk)(F.col("text").cast("string")).alias("found"))


def _limits(measured: DataFrame) -> Limits:
    """Limits from all measured documents that pass the base rules.

    Rounded logarithms are counted first, so a quartile takes a count per
    distinct value, not the values.
    """
    names = ("ratio", "chunk_min", "chunk_max")
    logs = F.array(*[F.struct(F.lit(n).alias("side"), F.round(F.ln(F.col(f"found.{n}")) / STEP).cast("long").alias("at")) for n in names])
    sides = measured.where("NOT found.base_failed").select("band", F.explode(logs).alias("l"))
    counted = sides.groupBy("band", "l.side", "l.at").agg(F.count("*").alias("n"))
    quartiles = counted.groupBy("band", "side").agg(F.sum("n").alias("n"), F.percentile("at", [0.25, 0.75], F.col("n")).alias("q"))
    found: dict[int, dict[str, list[float]]] = {}
    for row in quartiles.where(F.col("n") >= ENOUGH).collect():
        found.setdefault(row["band"], {})[row["side"]] = [q * STEP for q in row["q"]]
    limits = {}
    for band, side in found.items():
        (a, b), (c, d), (e, f) = (side[n] for n in names)
        logs = (a - REACH * (b - a), b + REACH * (b - a), c - REACH * (d - c), f + REACH * (f - e))
        limits[band] = tuple(math.exp(x) for x in logs)
    return limits


def fit(docs: DataFrame, chunk: int = CHUNK) -> Limits:
    """The limits of each band: least and greatest ratio, least and greatest ratio of a chunk."""
    return _limits(_measured(docs.where("text IS NOT NULL"), chunk=chunk))


def measure(docs: DataFrame, limits: Limits | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id and the judgement (SCHEMA); without ``limits`` these are learned from ``docs``.

    Then the figures of each text are written once; the limits are learned from
    them and judge them, and no text is packed twice.
    """
    if limits is not None:
        judged = docs.select("doc_id", quality(limits, chunk)(F.col("text").cast("string")).alias("found"))
        return judged.select("doc_id", "found.*")
    measured = cut(_measured(docs, "doc_id", chunk=chunk))
    kept = F.col("found.kept")
    for band, (low, high, chunk_low, chunk_high) in sorted(_limits(measured).items()):
        usual = F.col("found.ratio").between(low, high) & (F.col("found.chunk_min") >= chunk_low) & (F.col("found.chunk_max") <= chunk_high)
        kept = F.when((F.col("band") == band) & ~F.col("found.base_failed"), usual).otherwise(kept)
    return measured.select("doc_id", "found.*", kept.alias("_kept")).withColumn("kept", F.col("_kept")).drop("_kept")


def keep_good(docs: DataFrame, limits: Limits | None = None, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    limits = fit(docs, chunk) if limits is None else limits
    name = free_name(docs, "_found")
    judged = docs.withColumn(name, quality(limits, chunk)(F.col("text").cast("string")))
    return judged.where(F.col(name)["kept"]).drop(name)
