"""Personal data: base patterns and offset-preserving deobfuscation.

A text is normalised by transducers that remember, for every character they
write, which source characters it came from: look-alike letters and digits
become ASCII, spelled-out digits become digits, and disguised at and dot become
signs. The same detectors run on the normalised text, and what they find is
mapped back to source spans, which join those of the base patterns.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import extended, free_name

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Fixed: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = str.maketrans("аеорсухіјѕԁԛԝАВЕКМНОРСТХУІЈЅαορνικτεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdqwABEKMHOPCTXYIJSaopviktEABEZHIKMNOPTYX")
#: Fixed: digits as words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: The parts of a disguised address: at and dot (plain or disguised), words, and all else, which ends an address.
_PART = re.compile(
    r"(?P<at>\s*+[\[({<]\s*+(?:at|@)\s*+[\])}>]\s*+|\s++at\s++|\s*+@\s*+)|(?P<dot>\s*+[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+|\s++dot\s++|\.)|(?P<word>[A-Za-z0-9_%+-]++)|\s++|.",
    re.I | re.S,
)
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus\s+)?(?:{'|'.join(DIGIT_WORDS)})(?:[\s,.-]+(?:{'|'.join(DIGIT_WORDS)}|dot|point)(?![^\W_]))+", re.I)
_SPELLED_WORD = re.compile(rf"plus|dot|point|{'|'.join(DIGIT_WORDS)}", re.I)
#: Cheap signs that a text may hold a disguise at all: what a hidden mail must hold, at any distance.
_MAY_HIDE_AT = re.compile(r"@|[\s\[({<]at[\s\])}>]", re.I)
_MAY_HIDE_MAIL = re.compile(r"\s@|@\s|[\[({<]\s*(?:at|@)\s*[\])}>]|[\[({<]\s*(?:dot|\.)\s*[\])}>]|\sdot\s", re.I)
_LOOKS = re.compile(r"[^\x00-ɏḀ-ỿ -⁯]")


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = "".join(filter(str.isdigit, found))
    return 16 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind in KINDS order, then start; linear in the text.

    Mail is found from its @: the local part is the run before it (after the
    last mail's end), which is what a scan from the left would take.
    """
    spans: list[tuple[str, int, int]] = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            spans.append(("email", start, end := m.end()))
    for kind, pattern, needs in (("ip", _IP, "."), ("card", _CARD, ""), ("phone", _PHONE, "+")):
        if needs in text:
            spans += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return spans


class Normalised:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, found: Iterable[tuple[int, int, str]]) -> None:
        """Replaces each span (apart, in order) by a string that then stands for the whole span; an empty one leaves it."""
        text, starts, ends, last = [], [], [], 0
        for i, j, value in found:
            if not value:
                continue
            text += [self.text[last:i], value]
            starts += self.starts[last:i] + [self.starts[i]] * len(value)
            ends += self.ends[last:i] + [self.ends[j - 1]] * len(value)
            last = j
        if text:
            self.text = "".join(text) + self.text[last:]
            self.starts, self.ends = starts + self.starts[last:], ends + self.ends[last:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _ascii(m: re.Match) -> str:
    c = m[0].translate(LOOK_ALIKES)
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and folded.isdecimal():
        return str(unicodedata.decimal(folded))
    return folded if folded.isascii() else m[0]


def _digits(m: re.Match) -> str:
    signs = {"plus": "+", "dot": ".", "point": "."}
    words = [w.lower() for w in _SPELLED_WORD.findall(m[0])]
    return "".join(signs.get(w) or DIGIT_WORDS[w] for w in words)


def _matches(pattern: re.Pattern, new: Callable[[re.Match], str], text: str) -> Iterator[tuple[int, int, str]]:
    for m in pattern.finditer(text):
        yield *m.span(), new(m)


def hidden_mails(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of disguised addresses with the addresses they mean, in one pass over the text's parts.

    An address is words joined by dots, an at, and at least two words joined
    by dots. It does not begin in the middle of a plain one. With nothing but
    the word at for a disguise it may be a sentence ("was at home.Then") and
    is left alone.
    """
    parts: list[tuple[str, str, int, int]] = []  # kind, text, start, end of the address so far
    at = 0  # place of its at among the parts; 0 before it

    def whole() -> tuple[int, int, str] | None:
        taken = parts[: -1 if parts[-1][0] == "dot" else None]
        if not at or len(taken) < at + 4:
            return None
        sign, hidden_dot = taken[at][1], any(p[0] == "dot" and p[1] != "." for p in taken)
        address = "".join({"at": "@", "dot": "."}.get(p[0], p[1]) for p in taken)
        return taken[0][2], taken[-1][3], address if hidden_dot or sign != "@" and sign.strip().lower() != "at" else ""

    place = 0
    while m := _PART.match(text, place):
        kind, found, (start, end) = m.lastgroup, m[0], m.span()
        last = parts[-1][0] if parts else None
        if not parts and kind in ("at", "dot") and found.strip().isalpha():  # the words at and dot, where no sign can be
            start += len(found) - len(found.lstrip())
            kind, found, end = "word", found.strip(), start + len(found.strip())
        place = end
        if kind == "word" and last is None:
            if start and text[start - 1] in _LOCAL:
                continue
        elif kind == "at" and last == "word" and at and len(parts) == at + 2:
            parts, at = parts[-1:], 1  # what should have been a domain is the name before the next at
        elif kind == "at" and last == "word" and not at:
            at = len(parts)
        elif not (kind == "word" and last in ("at", "dot") or kind == "dot" and last == "word"):
            if parts:  # the address ends here; words at and dot that it had no use for as signs are read again
                if address := whole():
                    yield address
                unused = [p for p in (parts[-1:] if address else [*parts[at : at + 1], parts[-1]]) if p[0] != "word" and p[1].strip().isalpha()]
                place = unused[0][2] if unused else m.start()
                parts, at = [], 0
            continue
        parts.append((kind, found, start, end))
    if parts and (address := whole()):
        yield address


def normalise(text: str) -> Normalised | None:
    """The text through all transducers; None if nothing in it could be a disguise."""
    looks, spelled, mail = _LOOKS.search(text), _SPELLED.search(text), _MAY_HIDE_AT.search(text) and _MAY_HIDE_MAIL.search(text)
    if not (looks or spelled or mail):
        return None
    out = Normalised(text)
    if looks:
        out.rewrite(_matches(_LOOKS, _ascii, out.text))
    if spelled or looks:
        out.rewrite(_matches(_SPELLED, _digits, out.text))
    out.rewrite(hidden_mails(out.text))
    return out if out.text != text else None


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans found only after normalisation; one that touches a base span must hold all of it, and be of its kind."""
    out = normalise(text)
    if out is None:
        return []
    ordered = sorted((s, e, k) for k, s, e in base)
    starts, reach = [s for s, _, _ in ordered], list(accumulate((e for _, e, _ in ordered), max))  # reach: the furthest end up to each
    covered = bytearray(len(text))
    found = []
    for kind, i, j in base_spans(out.text):
        start, end = out.source(i, j)
        if text[start:end] == out.text[i:j] or any(covered[start:end]):
            continue
        at = bisect_left(starts, end) - 1
        apart = True
        while apart and at >= 0 and reach[at] > start:
            s, e, k = ordered[at]
            apart = e <= start or k == kind and start <= s and e <= end and (s, e) != (start, end)
            at -= 1
        if apart:
            found.append((kind, start, end))
            covered[start:end] = b"\x01" * (end - start)
    return found


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs and n_email, n_ip, n_card, n_phone, base_sha256, pii_spans, pii_redacted.

    The counts and the digest are of the base spans; pii_spans lists all of
    them (kind:start:end in code points, end exclusive); pii_redacted is the
    text with every span replaced by its kind in brackets. A null text counts
    as empty and stays null when redacted. New names get underscores where the
    input has them. Repeated rows are searched each time.
    """
    names, new = docs.columns, []
    for n in (*(f"n_{k}" for k in KINDS), "base_sha256", "pii_spans", "pii_redacted"):
        new.append(free_name(n, [*names, *new]))
    at = names.index(docs.select(text_col).columns[0])
    schema = extended(docs.schema, {n: "long" if n.startswith("n_") else "string" for n in new})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(at):
                text = cell.as_py()
                base = base_spans(text or "")
                spans = base + added_spans(text or "", base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), redact(text, spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*names, *new])

    return docs.mapInArrow(run, schema)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced; of overlapping spans the first one names the whole stretch."""
    if not spans:
        return text
    parts, last = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= last:
            parts += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(parts) + text[last:]


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the redacted text in place of the text; the same columns."""
    found = find_personal_data(docs, text_col)
    return found.select(*(F.col(found.columns[-1]).alias(c) if c == docs.select(text_col).columns[0] else F.col(f"`{c}`") for c in docs.columns))
