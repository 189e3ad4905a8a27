"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Validated values are permuted inside their own format with a keyed Feistel
network, so a value gives the same pseudonym in every document and the key
holder can undo it. What is validated:

card     13-19 digits in whole groups, Luhn; the first digit stays, the check digit is made anew
iban     country, two check digits, mod 97; digits stay digits, letters letters
ssn      AAA-GG-SSSS with the ranges in use
phone    +1 (AAA) EEE-NNNN in the usual spellings, area and exchange from 200 on
ip       four numbers up to 255
date     YYYY-MM-DD, DD.MM.YYYY, DD/MM/YYYY or, if that is none, MM/DD/YYYY; years 1900 to 2099
email    letters and digits of the local part

Values that do not validate stay as they are, and so does all other text.

Cards and IBANs are looked for at all borders of groups, so numbers, codes,
dates or words next to them do no harm. Of spans that overlap a validated IBAN
wins; then a card written in one group or in the usual ones (4-4-4-4, 4-6-5,
4-6-4), then in groups of four with a shorter last one or 6 and more; then the
other kinds as listed; last cards in any other groups. Within these the first
span that validates wins, so a number that happens to validate together with
a part of a card (one in ten, if its groups look like a card's) is taken for
one. A pseudonym that would make an overlapping span of better standing valid
is permuted again, as otherwise it could not be undone; only there do equal
values get different pseudonyms.

Defined cases: a null text stays null, with zero counts; an empty one stays
empty. Rows that repeat get equal results. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import free_name, text_udf

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
PATTERNS = {
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){12,}"),  # a run of groups; _cards has the borders
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+?\d[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w)(?!\.\d)"),
    "date": re.compile(r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-])(?!\.\d)"),
    "email": re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),  # _emails adds what stands before it
}
#: total length by country; others are tried at each blank
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29,
}
_USUAL = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
SCHEMA = "text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS)
_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Feistel:
    """A keyed permutation of 0..size-1: a balanced network on enough bits, walked until it lands inside."""

    ROUNDS = 10

    def __init__(self, key: bytes):
        self.key = key[:64]

    def _round(self, label: str, turn: int, half: int, bits: int) -> int:
        data = f"{label}/{turn}/{half}".encode()
        wanted = (bits + 7) // 8
        out = b""
        while len(out) < wanted:
            out += hashlib.blake2b(data + bytes([len(out) & 255]), key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:wanted], "big") & ((1 << bits) - 1)

    def _walk(self, x: int, size: int, label: str, turns, good: Callable[[int], bool] | None) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, label = (1 << half) - 1, f"{label}/{size}"
        while True:
            left, right = x >> half, x & mask
            for turn in turns:
                if turns[0] == 0:
                    left, right = right, left ^ self._round(label, turn, right, half)
                else:
                    left, right = right ^ self._round(label, turn, left, half), left
            x = left << half | right
            if x < size and (good is None or good(x)):
                return x

    def hide(self, x: int, size: int, label: str, good: Callable[[int], bool] | None = None) -> int:
        """``good`` narrows the format to a part of the numbers that holds x."""
        return self._walk(x, size, label, range(self.ROUNDS), good)

    def show(self, x: int, size: int, label: str, good: Callable[[int], bool] | None = None) -> int:
        return self._walk(x, size, label, range(self.ROUNDS - 1, -1, -1), good)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _like(form: str, chars: str) -> str:
    """``chars`` in the places that letters and digits have in ``form``."""
    rest = iter(chars)
    return "".join(next(rest) if c.isalnum() else c for c in form)


def _mixed(move, text: str, label: str) -> str:
    """Permutes digits among digits and letters among letters of their case."""
    bases = [("0123456789", 10) if c.isdigit() else ("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz", 26) for c in text]
    value, size = 0, 1
    for c, (letters, base) in zip(text, bases):
        value, size = value * base + letters.index(c), size * base
    shape = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" for c in text)
    value = move(value, size, f"{label}/{shape}")
    out = []
    for letters, base in reversed(bases):
        value, at = divmod(value, base)
        out.append(letters[at])
    return "".join(reversed(out))


def _card(move, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    size = 10 ** (len(digits) - 2)
    payload = digits[0] + str(move(int(digits[1:-1]), size, f"card/{digits[0]}")).zfill(len(digits) - 2)
    return _like(found, payload + luhn_digit(payload))


def _iban_rest(country: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(move, found: str) -> str | None:
    plain = found.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or int(check) != 98 - _iban_rest(country, account):
        return None
    account = _mixed(move, account, f"iban/{country}")
    return _like(found, country + f"{98 - _iban_rest(country, account):02d}" + account)


def _ssn_good(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(move, found: str) -> str | None:
    x = int(found.replace("-", ""))
    return _like(found, f"{move(x, 10**9, 'ssn', _ssn_good):09d}") if _ssn_good(x) else None


def _phone(move, found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    prefix, (area, exchange, line) = digits[:-10], (int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:]))
    if prefix not in ("", "1") or area < 200 or exchange < 200:
        return None
    x = move(((area - 200) * 800 + exchange - 200) * 10**4 + line, 800 * 800 * 10**4, "phone")
    return _like(found, f"{prefix}{x // 10**4 // 800 + 200}{x // 10**4 % 800 + 200}{x % 10**4:04d}")


def _ip(move, found: str) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _as_date(year: str, month: str, day: str) -> int | None:
    try:
        days = (date(int(year), int(month), int(day)) - _FIRST_DAY).days
    except ValueError:
        return None
    return days if 0 <= days < _DAYS else None


def _date(move, found: str) -> str | None:
    a, b, c = re.split(r"[./-]", found)
    if "-" in found:
        x, form = _as_date(a, b, c), "%Y-%m-%d"
    else:
        x, form = _as_date(c, b, a), f"%d{found[2]}%m{found[2]}%Y"
    good = None
    if x is None and "/" in found:
        # only a day past the twelfth tells month/day, so the pseudonym keeps to such days
        x, form = _as_date(c, a, b), "%m/%d/%Y"
        good = lambda n: (_FIRST_DAY + timedelta(n)).day > 12
    if x is None:
        return None
    return (_FIRST_DAY + timedelta(move(x, _DAYS, f"date/{form}", good))).strftime(form)


def _email(move, found: str) -> str | None:
    local, at, host = found.rpartition("@")
    return _like(local, _mixed(move, "".join(c for c in local if c.isalnum()), "email")) + at + host


_CHANGE = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "email": _email}
#: the number behind a digit that is no country prefix, or ends a card
_LOCAL_PHONE = re.compile(PATTERNS["phone"].pattern.replace(r"(?:\+?\d[ .-]?)?", ""))
_DIGIT, _GROUP = re.compile(r"[0-9]"), re.compile(r"[0-9]+")


def _standing(sizes: tuple[int, ...]) -> int:
    if len(sizes) == 1 or sizes in _USUAL:
        return 0
    fours = len(sizes) > 1 and all(n == 4 for n in sizes[:-1]) and sizes[-1] <= 4
    return 1 if fours or len(sizes) == 2 and sizes[0] == 6 else 2


def _cards(text: str) -> list[tuple[int, int, int]]:
    """(standing, start, end) of all runs of 13 to 19 digits between borders of groups, best first.

    A word of groups with hyphens between them counts if all of it stands free.
    """
    out = []
    for run in PATTERNS["card"].finditer(text):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, *run.span())]
        word, words = 0, []
        for k, (a, _) in enumerate(groups):
            word += k > 0 and text[a - 1] == " "
            words.append(word)
        left = run.start() == 0 or not re.match(r"[\w.+-]", text[run.start() - 1])
        right = not re.compile(r"[\w-]|\.\d").match(text, run.end())
        for i, (a, _) in enumerate(groups):
            if not left and words[i] == 0:
                continue
            sizes: tuple[int, ...] = ()
            for j in range(i, len(groups)):
                sizes += (groups[j][1] - groups[j][0],)
                if sum(sizes) > 19 or not right and words[j] == word:
                    break
                if sum(sizes) < 13:
                    continue
                cut = i and words[i - 1] == words[i] or j + 1 < len(groups) and words[j + 1] == words[j]
                out.append((2 if cut and words[i] != words[j] else _standing(sizes), a, groups[j][1]))
    return sorted(out, key=lambda x: (x[0], x[1], -x[2]))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start: the length of the country first, then all ends at blanks, longest first."""
    m = PATTERNS["iban"].search(text)
    while m:
        ends = [m.end(), *(k for k in range(m.end() - 1, m.start(), -1) if text[k] == " ")]
        own = _IBAN_LENGTHS.get(m[0][:2])
        for end in sorted(ends, key=lambda e: len(text[m.start():e].replace(" ", "")) != own):
            yield m.start(), end
        m = PATTERNS["iban"].search(text, m.start() + 1)


_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ with a host to the left, so that a long run of letters is read once."""
    last = 0
    for m in PATTERNS["email"].finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _BEFORE_AT:
            a -= 1
        while a < m.start() and not text[a].isalnum():
            a += 1
        if a < m.start():
            yield a, m.end()
            last = m.end()


def _spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Where values may be, in the order in which they are taken."""
    digits = _DIGIT.search(text)
    if digits:
        yield from (("iban", *span) for span in _ibans(text))
        cards = _cards(text)
        yield from (("card", a, b) for standing, a, b in cards if standing < 2)
    for kind in KINDS[2:]:
        if kind == "email":
            yield from ((kind, *span) for span in _emails(text))
        elif digits:
            yield from ((kind, *m.span()) for m in PATTERNS[kind].finditer(text))
        if kind == "phone" and digits:
            yield from ((kind, *m.span()) for m in _LOCAL_PHONE.finditer(text))
    if digits:
        yield from (("card", a, b) for standing, a, b in cards if standing == 2)


def _valid(kind: str, found: str) -> bool:
    return found.isascii() and _CHANGE[kind](lambda x, *_: x, found) is not None


def _meets(spans: list[tuple], a: int, b: int) -> bool:
    """Whether one of the spans, sorted and apart from each other, overlaps a..b."""
    k = bisect_left(spans, (b,))
    return k > 0 and spans[k - 1][1] > a


def change(text: str | None, move) -> tuple:
    """Replaces all values of a text; ``move`` is Feistel.hide, or .show to undo it."""
    counts = dict.fromkeys(KINDS, 0)
    if not text:
        return text, 0, *counts.values()
    chosen: list[tuple[int, int, str]] = []
    failed: list[tuple[int, int, str]] = []
    turns: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for kind, a, b in _spans(text):
        if _meets(taken, a, b):
            continue
        if _valid(kind, text[a:b]):
            insort(taken, (a, b))
            turns.append((a, b, kind))
            counts[kind] += 1
        else:
            failed.append((a, b, kind))
    failed.sort()
    longest = max((b - a for a, b, _ in failed), default=0)
    now = list(text) if failed else []
    undo = getattr(move, "__func__", None) is Feistel.show
    for a, b, kind in reversed(turns) if undo else turns:
        new = _CHANGE[kind](move, text[a:b])
        # spans that were tried before and overlap; an address of another length moves none of them
        rivals = [x for x in failed[bisect_left(failed, (a - longest,)):bisect_left(failed, (b,))] if x[1] > a] if len(new) == b - a else []
        if failed and len(new) == b - a:
            now[a:b] = new
        while any(_valid(k, "".join(now[x:y])) for x, y, k in rivals):
            new = _CHANGE[kind](move, new)
            now[a:b] = new
        chosen.append((a, b, new))
    out, last = [], 0
    for a, b, new in sorted(chosen):
        out += [text[last:a], new]
        last = b
    return "".join(out) + text[last:], len(chosen), *counts.values()


def pseudonymiser(key: bytes, undo: bool = False):
    """The column function from a text to SCHEMA."""

    def start():
        network = Feistel(key)
        move = network.show if undo else network.hide
        return lambda text: change(text, move)

    return text_udf(SCHEMA, start)


def pseudonymise(docs: DataFrame, key: bytes, undo: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, the changed text and how much was found."""
    done = docs.select("doc_id", pseudonymiser(key, undo)(F.col("text").cast("string")).alias("found"))
    return done.select("doc_id", "found.*")


def replace_text(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with changed texts and all its columns."""
    name = free_name(docs, "_found")
    done = docs.withColumn(name, pseudonymiser(key)(F.col("text").cast("string")))
    return done.withColumn("text", F.col(name)["text"]).drop(name)
