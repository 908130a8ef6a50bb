"""Personal data, also disguised: texts are rewritten by transducers that remember where every character came from."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from hazardframe.llm.common import row_blocks

KINDS = ["email", "ip", "card", "phone"]  # fixed value: their order

# The base patterns of the contract.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
IP_START = re.compile(r"(?<![0-9])" + IP.pattern)  # the same matches: what fails at the first digit of a run fails at all of them
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9][0-9.]{6,}")  # every ip lies in such a run
NOT_DIGIT = re.compile(r"[^0-9]")

# Letters that look like Latin ones (Cyrillic, then Greek), and the Latin ones they are read as.
LOOKALIKES = "авекмнорстухісјѕԁԛԝАВЕКМНОРСТУХІЈЅ" + "αονρυιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
READ_AS = "abekmhopctyxicjsdqwABEKMHOPCTYXIJS" + "aovpuiABEZHIKMNOPTYX"
FOLD = dict(zip(map(ord, LOOKALIKES), READ_AS)) | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
FOLD |= {0x2024: ".", 0x3002: ".", 0xFF61: ".", 0xFE6B: "@", 0x2010: "-", 0x2011: "-", 0x2013: "-", 0x2212: "-", 0x00A0: " ", 0x202F: " "}
FOLD |= {base + d: str(d) for base in (0x0660, 0x06F0, 0x0966) for d in range(10)}
DROP = {0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in [*FOLD, *DROP]) + "]")

SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
# What a spelled number is made of; between two of them stand blanks, commas or hyphens, three at most.
TOKEN = re.compile(rf"(?i)\+|\b(?:plus|dot|{DIGIT_WORD})\b|(?<!\w)[0-9]+(?:\.[0-9]+)*(?![A-Za-z_])")
GAP = re.compile("[ ,-]{1,3}")
AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+)"
DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
# An address with a disguised at or dot: at least one of the two must be disguised, and a plain "at" needs a disguised dot.
# It starts where a run of its characters does, and no run is tried twice.
DISGUISED = re.compile(rf"(?i)(?<![A-Z0-9._%+-])\.*+[A-Z0-9_%+-][A-Z0-9._%+-]*+(?:{DOT}[A-Z0-9_%+-]++){{0,20}}(?:{AT}|@)[A-Z0-9-]+(?:(?:{DOT}|\.)[A-Z0-9-]+)+")
DISGUISED_IP = re.compile(rf"(?i)\b[0-9]{{1,3}}(?:{DOT}|\.)[0-9]{{1,3}}(?:{DOT}|\.)[0-9]{{1,3}}(?:{DOT}|\.)[0-9]{{1,3}}\b")
BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]")
SEPARATORS = re.compile("[,-]")
ATS, DOTS = re.compile(f"(?i){AT}"), re.compile(f"(?i){DOT}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping. Every at sign is looked at once, from it to the left and to the right: linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def detect(text: str) -> list[tuple[str, int, int]]:
    """The base patterns: for each kind leftmost and non-overlapping; failing matches are dropped, without another try."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for run in DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in IP_START.finditer(run[0]):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out.append(("ip", run.start() + m.start(), run.start() + m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


class Rewritten:
    """A text after edits (start, end, new text), with the way back to the source."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.edits = sorted(edits)
        out, self.at, self.source, here = [], [], [], 0
        place = 0
        for start, end, new in [*self.edits, (len(text), len(text), "")]:
            out.append(text[here:start])
            self.at.append(place)
            self.source.append((here, start, False))
            place += start - here
            out.append(new)
            self.at.append(place)
            self.source.append((start, end, True))
            place += len(new)
            here = end
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span, and whether an edit took part. What replaced something maps to all that it replaced."""
        i, j = self._piece(start), self._piece(end - 1)
        a, _, edited_a = self.source[i]
        b, c, edited_b = self.source[j]
        left = a if edited_a else a + start - self.at[i]
        right = c if edited_b else b + end - self.at[j]
        # Deleted characters leave empty pieces, so an edit inside shows in the piece numbers.
        return left, right, edited_a or edited_b or i != j

    def _piece(self, at: int) -> int:
        return bisect_right(self.at, at) - 1


def _fold(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), FOLD.get(ord(m[0]), "")) for m in ODD.finditer(text)]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Chains of spelled and plain digits, a plus in front and spelled dots among them, as plain numbers.

    A chain is rewritten when it has two spelled digits, or one and a plus or dot; whether it is an identifier is for :func:`detect`.
    """
    edits, chain, end = [], [], 0

    def close() -> None:
        while chain and chain[-1][2] == ".":
            chain.pop()
        spelled = sum(word for _, _, _, word in chain)
        if spelled > 1 or spelled and any(new in "+." for _, _, new, _ in chain):
            edits.append((chain[0][0], chain[-1][1], "".join(new for _, _, new, _ in chain)))
        chain.clear()

    for m in TOKEN.finditer(text):
        item = m[0].lower()
        new = "+" if item in ("+", "plus") else "." if item == "dot" else SPELLED.get(item, item)
        glued = chain and (GAP.fullmatch(text, end, m.start()) or chain[-1][2] == "+" and end == m.start())
        if not glued or new == "+":
            close()
        if chain or new != ".":
            chain.append((m.start(), m.end(), new, item in SPELLED))
        end = m.end()
    close()
    return edits


def _disguised(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in DISGUISED.finditer(text):
        ats, dots = list(ATS.finditer(m[0])), list(DOTS.finditer(m[0]))
        plain = ats and not any(c in ats[0][0] for c in "[({<")
        if plain and not dots:
            continue  # "look at example.com" is no address
        edits += [(m.start() + x.start(), m.start() + x.end(), "@") for x in ats[:1]]
        edits += [(m.start() + x.start(), m.start() + x.end(), ".") for x in dots if not ats or x.end() <= ats[0].start() or x.start() >= ats[0].end()]
    taken = {e[:2] for e in edits}
    for m in DISGUISED_IP.finditer(text):
        new = [(m.start() + x.start(), m.start() + x.end(), ".") for x in DOTS.finditer(m[0])]
        edits += [e for e in new if e[:2] not in taken]
    return edits


def _compose(outer: Rewritten | None, text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits of a rewritten text as edits of the source, earlier edits outside them kept."""
    if outer is None:
        return edits
    mapped = [(*outer.back(a, b)[:2], new) for a, b, new in edits]
    inside = lambda e: any(a <= e[0] and e[1] <= b for a, b, _ in mapped)
    return mapped + ([e for e in outer.edits if not inside(e)] if mapped else outer.edits)


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Identifiers that only show after normalising, as spans of the source text."""
    steps = []
    if not text.isascii() and ODD.search(text):
        steps = [_fold, _spelled, _disguised]
    else:
        words = set(SEPARATORS.sub(" ", text).lower().split() if "-" in text or "," in text else text.lower().split())
        if not words.isdisjoint(SPELLED):
            steps.append(_spelled)
        if "dot" in words or BRACKETED.search(text):
            steps.append(_disguised)
    done: Rewritten | None = None
    for step in steps:
        now = done.text if done else text
        edits = step(now)
        if edits:
            done = Rewritten(text, _compose(done, now, edits))
    if done is None:
        return []
    out = []
    for kind, a, b in detect(done.text):
        start, end, edited = done.back(a, b)
        if edited:
            out.append((kind, start, end))
    return out


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, then kind. The base spans, and disguised ones that no base span of their kind holds."""
    if not text:
        return []
    base = detect(text)
    out = [(*s, True) for s in base]
    for kind, a, b in disguised(text):
        if not any(k == kind and c <= a and b <= d for k, c, d in base):
            out.append((kind, a, b, False))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
                              StructField("base", BooleanType())]))


def personal_data(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Add ``into``: the spans (kind, start, end, base) of personal data in the whole text, in code points, end exclusive.

    A null or empty text has none. Each row is looked at by itself; no pattern starts twice in one run of its characters, so time
    follows the length of a text. Repeated rows get equal spans. The other columns pass through; one named ``into`` is replaced.
    """
    docs = docs.drop(into)
    kept, at = docs.columns, docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(into, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_blocks(batches, at):
            found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*kept, into])

    return docs.mapInArrow(run, schema)
