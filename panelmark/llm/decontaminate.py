"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts and items are normalised alike: A-Z become lower case, words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. All runs of ``width`` item words (a
shorter item is one run) go into one automaton over the numbers of the item
words, which reads the words of each text once. A match names the words it
covers, and these carry their place in the original text.

An automaton takes about a kilobyte for each window, so its windows are counted
before it is built. If the test items have more than ``MAX_WINDOWS`` windows,
they are dealt by hash into sets of at most about as many, with an automaton
each; the texts are then read once for each set, hits of earlier sets are
carried along, and the result is the same.

Defined cases: a null or empty text has no words, no hits and is not
contaminated. A null or wordless item has no window. Items that repeat an id
count once. Rows that repeat are judged alike, one by one. Without items
nothing is hit. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import built, free_name
from panelmark.session import cut

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: bytes that part words become blanks, A-Z become lower case; bytes of other scripts stay
_NORMAL = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
#: windows of one automaton, which every Python worker holds
MAX_WINDOWS = 1 << 17
HITS = "spans array<int>, items array<string>"
SCHEMA = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "span_starts array<int>, span_ends array<int>"
)


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def item_windows(item: str | None, width: int) -> list[bytes]:
    words = normal_words(item or "")
    if not words:
        return []
    return [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]


class Automaton:
    """All windows over numbered words; a word of no window has number 0."""

    def __init__(self, windows: dict[bytes, list[str]]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows.items():
            words = window.split(b" ")
            self.machine.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), (len(words), items))
        if windows:
            self.machine.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (end not included) that hold a window, and the items of these windows."""
        spans: set[tuple[int, int]] = set()
        items: set[str] = set()
        if words and len(self.machine):
            get = self.numbers.get
            for last, (length, names) in self.machine.iter(tuple([get(w, 0) for w in words])):
                spans.add((last - length + 1, last + 1))
                items.update(names)
        return united(spans), items


def united(spans) -> list[tuple[int, int]]:
    """The spans in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _verdict(text: str | None, n: int, spans: list[tuple[int, int]], items: set[str], ratio: int) -> tuple:
    n_hit, names = sum(b - a for a, b in spans), sorted(items)
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    if not n_hit:
        return n, 0, 0, digest, False, [], []
    places = [m.span() for m in WORD.finditer(text)]
    return n, n_hit, len(names), digest, ratio * n_hit >= n, [places[a][0] for a, _ in spans], [places[b - 1][1] for _, b in spans]


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """The distinct (window, item) of all items (item_id, text)."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"]):
                windows = list(dict.fromkeys(item_windows(text, width)))
                yield pd.DataFrame({"window": windows, "item": [item] * len(windows)}, dtype=object)

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.where("text IS NOT NULL").mapInPandas(cut_up, "window binary, item string").distinct()


def _scan(windows: dict[bytes, list[str]], docs: DataFrame, ratio: int, last: bool):
    """The UDF from a text and the hits so far to the hits, or at last to the judgement."""
    shared, key = docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex
    names = [c.split()[0] for c in (SCHEMA if last else HITS).split(", ")]

    @F.pandas_udf(SCHEMA if last else HITS)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = built(key, lambda: Automaton(shared.value))
        for texts, spans, items in batches:
            rows = []
            for text, flat, before in zip(texts, spans, items):
                words = normal_words(text or "")
                found, named = automaton.find(words)
                if flat is not None and len(flat):
                    found, named = united([*found, *zip(flat[::2].tolist(), flat[1::2].tolist())]), named | set(before)
                rows.append(_verdict(text, len(words), found, named, ratio) if last else ([x for span in found for x in span], list(named)))
            yield pd.DataFrame(rows, columns=names)

    return scan


def marked(docs: DataFrame, items: DataFrame, name: str, width: int = 13, ratio: int = 20, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with the judgement (SCHEMA) as the struct column ``name``."""
    windows = cut(windows_of(items, width))
    sets = max(1, math.ceil(windows.count() / max_windows))
    part = F.pmod(F.xxhash64("window", "item"), F.lit(sets).cast("long"))
    text, spans, found = F.col("text").cast("string"), F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>")
    for number in range(sets):
        own: dict[bytes, list[str]] = {}
        for window, item in windows.where(part == number).collect():
            own.setdefault(bytes(window), []).append(item)
        last = number == sets - 1
        docs = docs.withColumn(name, _scan(own, docs, ratio, last)(text, spans, found))
        if not last:
            # one automaton at a time: the next set reads what this one wrote
            docs = cut(docs)
            spans, found = F.col(name)["spans"], F.col(name)["items"]
    return docs


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 13, ratio: int = 20, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id and the judgement (SCHEMA), spans in characters of the original text."""
    return marked(docs.select("doc_id", "text"), items, "found", width, ratio, max_windows).select("doc_id", "found.*")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, ratio: int = 20, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    name = free_name(docs, "_found")
    judged = marked(docs, items, name, width, ratio, max_windows)
    return judged.where(~F.col(name)["contaminated"]).drop(name)
