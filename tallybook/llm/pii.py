"""Personal data by anchor expansion.

An Aho-Corasick automaton finds what such data cannot be without: at-signs, schemes, plus signs,
digits and the words that announce an identifier. From each anchor a deterministic parser expands
to both sides, settles the boundaries and validates what it found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import carried, once, prepare, passed, passed_schema, restored, quoted, spread

RESULTS = ["spans", "masked"]
# The first four are the base kinds; their order settles ties.
KINDS = ["email", "ip", "card", "phone", "url", "ssn", "iban", "account"]

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_URL = _ALNUM | frozenset("-._~:/?#[]@!$&'()*+,;=%")
_HOST = re.compile("[^/?#]*")
_SCHEMES = ("http", "https", "ftp")
_CUES = {
    "iban": "iban",
    "ssn": "ssn",
    "social security": "ssn",
    **dict.fromkeys(("account", "accounts", "acct", "konto", "konten", "kto", "compte", "comptes", "cuenta", "cuentas"), "account"),
}
# Cues that other words end in, such as "décompte"; they only count as words of their own.
_WHOLE = frozenset(("kto", "compte", "comptes", "cuenta", "cuentas"))
# Words for "number", which may also be written together with the cue, as in "Kontonummer".
_NUMBER = frozenset("number numbers no nos nr num nummer nummern numero numéro número n nº n° º id".split())
_LINKS = _NUMBER | frozenset(
    "is are was the of my bank ist sind lautet lauten die der est sont le la de bancaire courant "
    "es son el bancaria corriente".split()
)
_BETWEEN = frozenset(" \t\r\n\u00a0\u202f:#=.-_°()\"'*|")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True
) -> DataFrame:
    """The columns of ``docs`` with ``spans`` and ``masked``.

    ``spans`` are structs of ``kind``, ``start`` and ``end`` in code points, by start and then by
    the order of ``KINDS``; ``masked`` is the text with every span, overlapping ones joined,
    replaced by the kind of its first in brackets. The base kinds are found from left to right
    without overlap within a kind, and what fails its check is dropped without another try:
    addresses of mail, dotted quads with parts up to 255, cards of 14 to 19 digits that pass the
    Luhn check, and numbers of 10 to 15 digits behind a plus sign. The others are addresses behind
    ``http``, ``https`` or ``ftp`` that carry a user, and identifiers behind an announcing word:
    social security numbers, IBANs with a valid check number, and account numbers of 8 to 20
    digits. Announcing words are English, German, French and Spanish and match in any case; a few
    separators and link words ("number", "no.", "is") may stand between them and the identifier.

    A null text has no spans and stays null when masked. Repeated rows each come out; input
    columns of the result's names are replaced, and without ``keep_text`` the text is left out.
    """
    prepare(docs.sparkSession)
    texts = carried(docs, id_col, text_col, RESULTS)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = once("pii_anchors", _anchors)
        for rows in batches:
            texts = rows.column("text").to_pylist()
            found = [spans_of(t or "", anchors) for t in texts]
            shown = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found]
            covered = [t if t is None else mask(t, spans) for t, spans in zip(texts, found)]
            yield passed(rows, keep_text, spans=pa.array(shown, kind), masked=pa.array(covered, pa.string()))

    schema = passed_schema(texts, keep_text, "spans array<struct<kind string, start int, end int>>, masked string")
    found = spread(texts, F.col("id"), F.col("text")).select("text", "rest").mapInArrow(run, schema)
    return found.select(*restored(docs, text_col, RESULTS, keep_text))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with joined spans replaced by the kind of the first of them."""
    out, at = [], 0
    open_to = -1
    for kind, start, end in spans:
        if start >= open_to:
            out += [text[at:start], f"[{kind.upper()}]"]
        open_to = at = max(open_to, end)
    return "".join(out) + text[at:] if out else text


def _anchors():
    """The automaton over everything data can start from."""
    automaton = ahocorasick.Automaton()
    for digit in _DIGITS:
        automaton.add_word(digit, "digit")
    for text, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        automaton.add_word(text, kind)
    for cue in _CUES:
        automaton.add_word(cue, cue)
    automaton.make_automaton()
    return automaton


def spans_of(text: str, automaton) -> list[tuple[str, int, int]]:
    """All spans of a text as kind, start and end."""
    found: list[tuple[str, int, int]] = []
    email_to = number_to = dotted_to = 0
    address_to = 0, 0
    lower = text.lower()
    if len(lower) != len(text):  # Only this letter becomes two; places have to stay the same.
        lower = text.replace("\u0130", "I").lower()
    for place, anchor in automaton.iter(lower):
        if anchor == "digit":
            if place >= number_to:
                end, digits = _chain(text, place)
                number_to = end
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", place, end))
            if place >= dotted_to:
                dotted_to = _dotted(text, place, found)
        elif anchor == "at":
            email_to = _email(text, place, email_to, found)
        elif anchor == "plus":
            _phone(text, place, found)
        elif anchor == "scheme":
            address_to = _address(text, place - 2, address_to, found)
        else:
            _identifier(text, lower, place + 1, anchor, found)
    if len(found) > 1:
        found = sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return found


def _run(text: str, at: int, allowed: frozenset) -> int:
    """The end of the characters allowed from here on."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, free: int, found: list) -> int:
    """Both sides of an at-sign; ``free`` is where the last address ended."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return free
    labels = 0
    while end < len(text) and text[end] == ".":
        after = _run(text, end + 1, _LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    if not labels:
        return free
    found.append(("email", start, end))
    return end


def _chain(text: str, at: int) -> tuple[int, str]:
    """Digits from here on, single blanks and hyphens between them allowed."""
    n, digits = len(text), [text[at]]
    at += 1
    while at < n:
        if text[at] in _DIGITS:
            digits.append(text[at])
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in _DIGITS:
            digits.append(text[at + 1])
            at += 2
        else:
            break
    return at, "".join(digits)


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _dotted(text: str, at: int, found: list) -> int:
    """Four numbers with dots between them from here on; where the next try may start."""
    start, first, parts = at, None, []
    while True:
        end = _run(text, at, _DIGITS)
        first = first or end
        parts.append(text[at:end])
        if len(parts) == 4:
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts):
                found.append(("ip", start, end))
            return end
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS:
            at = end + 1
        else:
            return first


def _phone(text: str, at: int, found: list) -> None:
    """A number behind a plus sign, up to the last digit that separators and digits lead to."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end > at + 3 and 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
        found.append(("phone", at, end))


def _address(text: str, at: int, known: tuple[int, int], found: list) -> tuple[int, int]:
    """An address behind a scheme, if it names a user before its host.

    Schemes in one run of address characters share its end: ``known`` and the result say where the
    last run ended, and where without closing punctuation.
    """
    start = at
    while start and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    if text[start:at].lower() not in _SCHEMES:
        return known
    full, end = known
    if at + 3 > full:
        full = end = _run(text, at + 3, _URL)
        while end > at + 3 and text[end - 1] in ".,;:!?)'":
            end -= 1
    end = max(end, at + 3)
    host = _HOST.match(text, at + 3, end).group()
    if "@" in host.strip("@"):
        found.append(("url", start, end))
    return full, end


def _identifier(text: str, lower: str, at: int, cue: str, found: list) -> None:
    """An identifier behind the word that announces it, a few separators and link words between them."""
    kind, start = _CUES[cue], at - len(cue)
    if cue in _WHOLE and start and text[start - 1].isalpha():
        return
    if at < len(text) and text[at].isalnum():
        at = _word(text, at)
        if lower[start + len(cue) : at] not in _NUMBER:
            return
    for _ in range(5):
        limit = min(len(text), at + 6)
        while at < limit and text[at] in _BETWEEN:
            at += 1
        end = _identified(text, at, kind)
        if end:
            found.append((kind, at, end))
            return
        after = _word(text, at)
        if lower[at:after] not in _LINKS:
            return
        at = after


def _word(text: str, at: int) -> int:
    """The end of the letters from here on."""
    n = min(len(text), at + 16)
    while at < n and text[at].isalpha():
        at += 1
    return at


def _identified(text: str, at: int, kind: str) -> int:
    """The end of a valid identifier that starts here, 0 if there is none."""
    if kind == "iban":
        end, characters = at, []
        while end < len(text) and (text[end] in _ALNUM or (text[end] == " " and _run(text, end + 1, _ALNUM) > end + 1)):
            characters += [] if text[end] == " " else [text[end].upper()]
            end += 1
            if len(characters) >= 15 and _iban("".join(characters)) and (end == len(text) or text[end] not in _ALNUM):
                return end
            if len(characters) > 34:
                return 0
    elif at < len(text) and text[at] in _DIGITS:
        end, digits = _chain(text, at)
        if len(digits) == 9 if kind == "ssn" else 8 <= len(digits) <= 20:
            return end
    return 0


def _iban(characters: str) -> bool:
    turned = characters[4:] + characters[:4]
    return characters[:2].isalpha() and characters[2:4].isdigit() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1
