"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public
vocabulary. The probability of a word is the sum over all ways to cut it into
pieces, which a forward algorithm adds up; that of a text is the product over
its words. The piece probabilities are learned by expectation maximisation:
every training word gives each piece its expected number of uses.

Words are the runs of non-ASCII bytes and letters of the lower-cased text,
with the vocabulary's word mark in front. A character outside the vocabulary
falls back to the pieces of its bytes.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
Rows that repeat are judged alike. If nothing can be learned (an empty table,
labels or texts all null) every text is ``und``. Languages that tie go by name.
Long words and texts are taken whole. Only ``text`` is read for a prediction.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import built
from panelmark.session import cut

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
MARK = "▁"
LETTER = regex.compile(r"\p{L}")
_NORMAL = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: words a worker remembers at once, and the longest that it remembers
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64
#: characters scored together
TOGETHER = 1 << 20


def normal_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def read_vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces; those of single bytes are written <0xNN>."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


class Pieces:
    """Places of the pieces inside words."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.bytes = [self.ids.get(f"<0x{b:02X}>", self.ids.get("<unk>", 0)) for b in range(256)]
        self.none = len(pieces)  # a row of zeros stands after the last piece

    def fallback(self, char: str, table: np.ndarray) -> np.ndarray:
        return table[[self.bytes[b] for b in char.encode("utf-8", "replace")]].prod(axis=0)

    def forward(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """log P of each word by language; words of equal length go side by side."""
        result = np.empty((len(words), table.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, rows in by_length.items():
            step = max(1, (1 << 18) // (length + 1))
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                result[part] = self._forward([words[i] for i in part], length, table)
        return result

    def _forward(self, words: list[str], length: int, table: np.ndarray) -> np.ndarray:
        get, none = self.ids.get, self.none
        alpha = np.zeros((self.longest + 1, len(words), table.shape[1]))  # a ring of the last places
        alpha[0] = 1.0
        scale = np.zeros(alpha.shape[1:])
        ring = len(alpha)
        for end in range(1, length + 1):
            here = np.zeros(alpha.shape[1:])
            for size in range(1, min(end, self.longest) + 1):
                ids = [get(w[end - size:end], none) for w in words]
                if size == 1:
                    chance = table[ids]
                    for i in [i for i, x in enumerate(ids) if x == none]:
                        chance[i] = self.fallback(words[i][end - 1], table)
                    here += alpha[(end - 1) % ring] * chance
                elif min(ids) < none:
                    here += alpha[(end - size) % ring] * table[ids]
            alpha[end % ring] = here
            if end % 8 == 0:  # keep long words above the smallest number
                top = alpha.max(axis=0)
                alpha /= top
                scale += np.log(top)
        return np.log(alpha[length % ring]) + scale

    def expected(self, word: str, chance: np.ndarray, n: float, into: dict[int, float]) -> None:
        """Adds the expected uses of each piece in ``n`` times this word."""
        get, length = self.ids.get, len(word)
        edges: list[list[tuple[int, int, float]]] = [[]]
        alpha = [1.0] + [0.0] * length
        for end in range(1, length + 1):
            own = []
            for size in range(1, min(end, self.longest) + 1):
                piece = get(word[end - size:end])
                if piece is not None:
                    own.append((end - size, piece, chance[piece]))
                elif size == 1:
                    p = 1.0
                    for b in word[end - 1].encode("utf-8", "replace"):
                        p *= chance[self.bytes[b]]
                    own.append((end - 1, -1, p))
            edges.append(own)
            alpha[end] = sum(alpha[start] * p for start, _, p in own)
        if alpha[length] < 1e-290:
            self._expected_in_logs(word, edges, n, into)
            return
        beta = [0.0] * length + [1.0]
        for end in range(length, 0, -1):
            if beta[end]:
                for start, piece, p in edges[end]:
                    beta[start] += p * beta[end]
                    use = n * alpha[start] * p * beta[end] / alpha[length]
                    if piece >= 0:
                        into[piece] = into.get(piece, 0.0) + use
                    else:
                        for b in word[end - 1].encode("utf-8", "replace"):
                            into[self.bytes[b]] = into.get(self.bytes[b], 0.0) + use


    def _expected_in_logs(self, word: str, edges: list[list[tuple[int, int, float]]], n: float, into: dict[int, float]) -> None:
        """The same for words whose chance is below the smallest number, as sentences without blanks are."""
        none = float("-inf")

        def add(parts: list[float]) -> float:
            top = max(parts, default=none)
            return top + math.log(sum(math.exp(x - top) for x in parts)) if top > none else none

        logs = [[(start, piece, math.log(p)) for start, piece, p in own if p > 0] for own in edges]
        alpha = [0.0]
        for own in logs[1:]:
            alpha.append(add([alpha[start] + p for start, _, p in own]))
        behind: list[list[float]] = [[] for _ in alpha]
        behind[-1] = [0.0]
        for end in range(len(alpha) - 1, 0, -1):
            beta = add(behind[end])
            for start, piece, p in logs[end] if beta > none else ():
                behind[start].append(beta + p)
                use = n * math.exp(alpha[start] + p + beta - alpha[-1])
                for i in [piece] if piece >= 0 else [self.bytes[b] for b in word[end - 1].encode("utf-8", "replace")]:
                    into[i] = into.get(i, 0.0) + use


def _word_counts(train: DataFrame) -> DataFrame:
    """(lang, word, n); each task adds up its own rows first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                counts.setdefault(lang, Counter()).update(normal_words(text))
            for lang, words in counts.items():
                yield pd.DataFrame({
                    "lang": lang, "word": [w.decode("utf-8", "replace") for w in words], "n": list(words.values())})

    rows = train.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 2, smoothing: float = 0.05,
    sample_per_language: int = 1000, max_languages: int = 1000,
) -> dict:
    """Learns from the rows of ``docs`` (lang, text) in which neither is null.

    At most about ``sample_per_language`` texts of a language are used; a hash
    of the text picks them. The model has one number per piece and language,
    so its size is bounded by the vocabulary and ``max_languages``.
    """
    train = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(sizes)
    pieces = read_vocabulary(vocabulary)
    if not languages:
        return {"languages": [], "pieces": pieces, "table": None, "key": uuid.uuid4().hex}
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(sample_per_language / sizes[lang]))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(1 << 30)
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    counts = cut(_word_counts(train.where(draw < share[F.col("lang")])).repartition(tasks))
    number = {lang: i for i, lang in enumerate(languages)}
    total = np.ones((len(pieces), len(languages)))
    for _ in range(rounds):
        chances = (total + smoothing) / (total + smoothing).sum(axis=0)
        shared = docs.sparkSession.sparkContext.broadcast((pieces, chances))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, chance = shared.value
            own = Pieces(names)
            columns = {lang: chance[:, i].tolist() for lang, i in number.items()}
            uses: dict[str, dict[int, float]] = {}
            for batch in batches:
                for lang, word, n in zip(batch["lang"], batch["word"], batch["n"]):
                    own.expected(MARK + word, columns[lang], float(n), uses.setdefault(lang, {}))
            for lang, found in uses.items():
                yield pd.DataFrame({"lang": lang, "piece": list(found), "uses": list(found.values())})

        found = counts.mapInPandas(expect, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses"))
        total = np.zeros_like(total)
        for lang, piece, uses in found.collect():  # at most pieces times languages
            total[piece, number[lang]] = uses
        shared.unpersist()
    return {"languages": languages, "pieces": pieces, "table": (total + smoothing) / (total + smoothing).sum(axis=0),
            "key": uuid.uuid4().hex}


class Scorer:
    """Scores texts; remembers the words it has met."""

    def __init__(self, model: dict):
        self.languages = model["languages"]
        self.own = Pieces(model["pieces"])
        self.table = np.vstack([model["table"], np.zeros(len(self.languages))])
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.known = np.empty((1024, len(self.languages)), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        start = len(self.place)
        if start + len(words) > len(self.known):
            grown = np.empty((2 * (start + len(words)), len(self.languages)), np.float32)
            grown[:start] = self.known[:start]
            self.known = grown
        self.known[start:start + len(words)] = self._score(words)
        self.place.update(zip(words, range(start, start + len(words))))

    def _score(self, words: list[bytes]) -> np.ndarray:
        return self.own.forward([MARK + w.decode("utf-8", "replace") for w in words], self.table)

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        bags = [normal_words(t) if t and LETTER.search(t) else [] for t in texts]
        if len(self.place) > REMEMBERED:
            self.forget()
        new = {w for bag in bags for w in bag} - self.place.keys()
        short = [w for w in new if len(w) <= REMEMBERED_LENGTH]
        self._learn(short)
        long = [w for w in new if len(w) > REMEMBERED_LENGTH]
        longs = dict(zip(long, self._score(long))) if long else {}
        names, scores = [], np.zeros(len(texts))
        for i, bag in enumerate(bags):
            if not bag:
                names.append(UNKNOWN)
                continue
            ids = [self.place[w] for w in bag if w not in longs] if longs else [self.place[w] for w in bag]
            total = self.known[ids].sum(axis=0, dtype=np.float64)
            if longs:
                total = total + sum(longs[w] for w in bag if w in longs)
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores[i] = 1.0 / np.exp(total - total[best]).sum()
        return names, scores


def predictor(docs: DataFrame, model: dict):
    """The column function from a text to (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key, learned = model["key"], bool(model["languages"])

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = built(key, lambda: Scorer(shared.value)) if learned else None
        for texts in batches:
            names, scores = [], []
            start, size, values = 0, 0, texts.tolist()
            for i, text in enumerate(values):
                size += len(text or "")
                if size >= TOGETHER or i == len(values) - 1:
                    part = values[start:i + 1]
                    found = scorer.texts(part) if learned else ([UNKNOWN] * len(part), np.zeros(len(part)))
                    names += found[0]
                    scores += found[1].tolist()
                    start, size = i + 1, 0
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score."""
    told = predictor(docs, model)(F.col("text").cast("string"))
    return docs.select("doc_id", told.alias("found")).select("doc_id", "found.*")
