"""Personal data found through disguises, reported in source characters.

Four transducers rewrite a text and remember which source characters every written character stands for: look-alike
characters become ASCII letters and digits, runs of spelled digits become digits, at/dot disguises become "@" and
"." (also the dots between the four groups of an address). The identifier patterns run on the text itself (base spans) and on the rewritten one; spans of the latter are
mapped back and added where they reach beyond the base spans.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")

# Characters that look like ASCII ones.
LOOK_ALIKES = dict(zip(
    "АВЕКМНОРСТХаеорсухѕіјԁɡӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορν",
    "ABEKMHOPCTXaeopcyxsijdgl" "ABEZHIKMNOPTYXaopv",
))
INVISIBLE = "­​‌‍‎‏⁠﻿"
# Digit words, words for "+", "@" and ".".
DIGIT_WORDS = {
    "0": "zero oh null cero zéro", "1": "one eins uno un", "2": "two zwei zwo dos deux", "3": "three drei tres trois",
    "4": "four vier cuatro quatre", "5": "five fünf cinco cinq", "6": "six sechs seis six", "7": "seven sieben siete sept",
    "8": "eight acht ocho huit", "9": "nine neun nueve neuf",
}
PLUS_WORDS = "plus más mas"
AT_WORDS = "at arobase arroba"
DOT_WORDS = "dot punkt punto point"

LEAST_SPELLED = 7  # digits in a run before spelled digits count as a number (outside an address)

_LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A later start inside a run of digits meets the same end, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, in one pass over the "@" signs."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _LABEL.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Rewritten:
    """A text with, for every character, the source range it stands for."""

    def __init__(self, text: str, starts: list[int], ends: list[int]):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Rewritten:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Ranges (ascending, apart) replaced; each new character stands for its whole range's source."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        return Rewritten("".join(text) + self.text[at:], starts + self.starts[at:], ends + self.ends[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def fold_character(c: str) -> str | None:
    """The ASCII form of a look-alike, empty for an invisible character, None if there is none."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in INVISIBLE:
        return ""
    try:
        return str(unicodedata.digit(c))
    except ValueError:
        plain = unicodedata.normalize("NFKC", c)
        return plain if len(plain) == 1 and plain.isascii() and plain != " " else None


_STRANGE = re.compile("[^\x00-\xac\xae-ɏ‐-‧‰-⁞₠-⃏]|[²³¹]|[\xad]")


def fold_look_alikes(r: Rewritten) -> Rewritten:
    if not _STRANGE.search(r.text):
        return r
    edits = []
    for m in _STRANGE.finditer(r.text):
        new = fold_character(m.group())
        if new is not None:
            edits.append((m.start(), m.end(), new))
    return r.replace(edits)


def _one_of(words: str) -> str:
    return "|".join(sorted(set(words.split()), key=lambda w: (-len(w), w)))


_VALUE = {w: d for d, words in DIGIT_WORDS.items() for w in words.split()}
_SPELLED = _one_of(" ".join(DIGIT_WORDS.values()))
_RUN = re.compile(
    rf"(?<!\w)(?:(?:{_one_of(PLUS_WORDS)})[\s-]+|\+\s?)?(?:(?:{_SPELLED}|[0-9])[\s,-]{{1,2}}){{{LEAST_SPELLED - 1},}}(?:{_SPELLED}|[0-9])(?!\w)",
    re.IGNORECASE,
)
# Spelled digits beside digit groups.
_MIXED = re.compile(
    rf"(?<![\w.])(?:(?:{_one_of(PLUS_WORDS)})[\s-]+|\+\s?)?(?:(?:{_SPELLED}|[0-9]+)[\s,-]{{1,2}})+(?:{_SPELLED}|[0-9]+)(?!\w)",
    re.IGNORECASE,
)
_PART = re.compile(rf"{_one_of(PLUS_WORDS)}|{_SPELLED}|[0-9]+", re.IGNORECASE)
_PLUS = frozenset(PLUS_WORDS.split())


def digits_of_words(r: Rewritten) -> Rewritten:
    """Runs of single digits with at least one word among them become a number; separators go. Then the same for runs
    of words and groups of digits."""
    return _joined_runs(_joined_runs(r, _RUN), _MIXED)


def _joined_runs(r: Rewritten, runs: re.Pattern) -> Rewritten:
    edits = []
    for m in runs.finditer(r.text):
        parts = list(_PART.finditer(r.text, *m.span()))
        words = [p.group().lower() for p in parts]
        if not any(w in _VALUE for w in words) or sum(len(_VALUE.get(w, w)) for w in words if w not in _PLUS) < LEAST_SPELLED:
            continue
        first = m.start()
        if r.text[first] == "+":
            edits.append((first, first + 1, "+"))
            first += 1
        for k, p in enumerate(parts):
            end = parts[k + 1].start() if k + 1 < len(parts) else m.end()
            word = p.group().lower()
            # the separator after a digit goes with it, except that the last digit ends where the word does
            edits.append((p.start() if k else first, p.end() if end == m.end() else end,
                          "+" if word in _PLUS else _VALUE.get(word, word)))
    return r.replace(edits)


_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_BRACKETED = re.compile(
    rf"(?<=[A-Za-z0-9]){_OPEN}(?:(?P<at>{_one_of(AT_WORDS)}|@)|(?P<dot>{_one_of(DOT_WORDS)}|\.)){_CLOSE}(?=[A-Za-z0-9])",
    re.IGNORECASE,
)
_BARE = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?P<at>\s(?:{_one_of(AT_WORDS)})\s|\s?@\s?)"
    rf"(?P<host>[A-Za-z0-9-]{{1,63}}(?:(?:\s(?:{_one_of(DOT_WORDS)})\s|\.)[A-Za-z0-9-]{{1,63}}){{1,5}})(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
_BARE_DOT = re.compile(rf"\s(?:{_one_of(DOT_WORDS)})\s", re.IGNORECASE)
_DOT_WORDS = tuple(DOT_WORDS.split())


def _hints(low: str) -> bool:
    return any(w in low for w in _DOT_WORDS) and _BARE_DOT.search(low) is not None


def undo_at_and_dot(r: Rewritten) -> Rewritten:
    """Bracketed disguises, then bare ones: a bare "at" counts only before a host with a spelled dot, an "@" between
    spaces also before one with real dots that ends in a name (not "5 @ 3.50")."""
    if any(c in r.text for c in "[({<"):
        r = r.replace([(*m.span(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(r.text)])
    if "@" not in r.text and not _hints(r.text.lower()):
        return r
    edits = []
    for m in _BARE.finditer(r.text):
        dots = list(_BARE_DOT.finditer(r.text, *m.span("host")))
        apart = len(m["at"]) == 3 and m["at"][1] == "@"  # "@john.doe" after a space is a name
        if dots or apart and any(c.isalpha() for c in m["host"].rpartition(".")[2]):
            edits += [(*m.span("at"), "@"), *((*d.span(), ".") for d in dots)]
    return r.replace(edits)


_GROUP = rf"(?:[0-9]+|(?:{_SPELLED}|[0-9])(?:[\s,-]{{1,2}}(?:{_SPELLED}|[0-9])){{0,2}})"
_ADDRESS_DOT = rf"(?:\s(?:{_one_of(DOT_WORDS)})\s|\.)"
_ADDRESS = re.compile(rf"(?<!\w){_GROUP}(?:{_ADDRESS_DOT}{_GROUP}){{3}}(?!\w)", re.IGNORECASE)
_ADDRESS_PART = re.compile(rf"(?P<dot>{_ADDRESS_DOT})|{_SPELLED}|[0-9]+", re.IGNORECASE)


def undo_spelled_addresses(r: Rewritten) -> Rewritten:
    """Four groups of digits or digit words, with spelled or real dots between them, become an address."""
    edits = []
    for m in _ADDRESS.finditer(r.text):
        parts = list(_ADDRESS_PART.finditer(r.text, *m.span()))
        for k, p in enumerate(parts):
            word = p.group().lower()
            # the separator inside a group goes with the digit before it
            joins = k + 1 < len(parts) and not p["dot"] and not parts[k + 1]["dot"]
            new = "." if p["dot"] else _VALUE.get(word, word)
            end = parts[k + 1].start() if joins else p.end()
            if new != r.text[p.start() : end]:
                edits.append((p.start(), end, new))
    return r.replace(edits)


# A digit word beside a digit, or a real dot between them.
_BESIDE = re.compile(
    rf"[0-9](?:[\s,-]{{1,2}}|\.)(?:{_SPELLED})(?!\w)|(?:{_SPELLED})(?:(?:[\s,-]{{1,2}}|\.)[0-9]|\.(?:{_SPELLED})(?!\w))"
)
_APART = re.compile(r"\s@\s")
_DIGITS = frozenset(_VALUE) | frozenset("0123456789")


def is_disguised(text: str) -> bool:
    """Whether any transducer could change the text."""
    if not text.isascii() and _STRANGE.search(text):
        return True
    low = text.lower()
    return (
        _hints(low)
        or "@" in text and _APART.search(text) is not None
        or any(c in text for c in "[({<") and _BRACKETED.search(text) is not None
        or sum(map(_DIGITS.__contains__, low.replace(",", " ").replace("-", " ").split())) >= LEAST_SPELLED - 1
        or _BESIDE.search(low) is not None
    )


def find_identifiers(text: str) -> tuple[list, list]:
    """(base spans, all spans), both by start, then kind."""
    base = base_spans(text)
    if not is_disguised(text):
        return base, base
    r = undo_spelled_addresses(undo_at_and_dot(digits_of_words(fold_look_alikes(Rewritten.of(text)))))
    if r.text == text:
        return base, base
    added = set()
    for kind, a, b in base_spans(r.text):
        a, b = r.source(a, b)
        if not any(x <= a and b <= y for _, x, y in base):
            added.add((kind, a, b))
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_added. Null counts as empty."""

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column(1):
                base, spans = find_identifiers(value.as_py() or "")
                n = Counter(k for k, _, _ in base)
                out.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                            len(spans) - len(base)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch(
                [batch.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )
