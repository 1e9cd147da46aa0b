"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, digits, plus signs, schemes, identifier
cues) in one pass; a deterministic local parser expands each anchor to its boundaries and
validates it. Kinds ``email``, ``ip``, ``card`` and ``phone`` follow fixed patterns (leftmost,
not overlapping within a kind, a match that fails validation is dropped); ``url``,
``account`` and ``address`` are added by their own anchors.

Why the local parsers see what a scan of the whole text would: each fixed pattern matches
inside one maximal run of its own alphabet that holds its anchor, so nothing outside the run
can change its matches. Cues and schemes count in any case; a street's number stands within 80 characters before its cue.

Defined results: a null or empty text has no spans; positions count code points, end
exclusive, over the whole text whatever its length; equal texts have equal spans; where matches of a kind could
overlap the leftmost one counts (of cues that end at one place, the longer); rows that repeat a doc_id or have a null one each count
as a document; an empty table gives an empty result; further columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.rows import map_rows, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "address")
# Anchors of the added kinds.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "mailto:", "ssh://")
ACCOUNT_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "account", "iban", "ssn", "passport", "user_id", "login", "akia")
STREET_CUES = (" street", " avenue", " road", " lane", " boulevard", " drive", " straße", " strasse", " platz", " rue ", " calle ", " avenida ")

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ZONE = frozenset("0123456789 .()+-")
_ZONE_END = re.compile(r"[0-9 .()+-]*")
#: Numbers joined by dots, as many as there are: taken at once, a run of digits is read once, not from each of its places.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_END = re.compile(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*")
_ACCOUNT = re.compile(r"[\"']?\s{0,3}(?:[:=#]|no\.?|number)\s{0,3}[\"']?([A-Za-z0-9][A-Za-z0-9_./+=-]{5,})")
_AKIA = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")
_HOUSE = re.compile(r"([0-9]{1,5}[A-Za-z]?,? (?:[^\W\d_][\w'.-]*,? ){0,3}[^\W\d_][\w'.-]*)\Z")
_AFTER = re.compile(r"[^\W\d_][\w'-]*(?: [^\W\d_][\w'-]*)? [0-9]{1,5}[A-Za-z]?\b")
_LOWER = {i: i + 32 for i in range(65, 91)}
_NON_DIGIT = re.compile(r"[^0-9]")


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", ""))
    for d in "0123456789":
        a.add_word(d, ("9", ""))
    for kind, words in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("address", STREET_CUES)):
        for w in words:
            a.add_word(w, (kind, w))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind in the order of KINDS, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    zone_end = email_end = 0
    cues: list[tuple[str, str, int]] = []
    lower = text.lower()
    if len(lower) != len(text):  # a few letters grow when lowered; positions must stay
        lower = text.translate(_LOWER)
    for last, (kind, word) in anchors.iter(lower):
        if kind == "9":
            if last < zone_end:
                continue
            start = last
            while start > zone_end and text[start - 1] in _ZONE:
                start -= 1
            zone_end = _ZONE_END.match(text, last).end()
            if zone_end - start >= 7:
                _numbers(text, start, zone_end, found)
        elif kind == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL_SET:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                found["email"].append((start, m.end()))
                email_end = m.end()
        else:
            cues.append((kind, word, last + 1))
    for kind, word, end in cues:
        _expand(kind, word, end, text, found[kind])
    return [(k, s, e) for k in KINDS for s, e in sorted(found[k])]


def _numbers(text: str, start: int, end: int, found: dict[str, list[tuple[int, int]]]) -> None:
    for m in _DOTTED.finditer(text, start, end):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):  # leftmost matches follow each other by four numbers
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in four):
                found["ip"].append((at, at + size))
            at += size + 1
    for m in _CARD.finditer(text, start, end):
        digits = _NON_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text, start, end):
        if 8 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
            found["phone"].append(m.span())


def _expand(kind: str, word: str, end: int, text: str, out: list[tuple[int, int]]) -> None:
    """Expand a scheme or cue that ends at ``end``; spans of a kind don't overlap."""
    at = end - len(word)
    floor = out[-1][1] if out else 0
    if at < floor:
        return
    if kind == "url":
        if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            return
        stop = _URL_END.match(text, end).end()
        while stop > end and text[stop - 1] in ".,;:!?'\")]":
            stop -= 1
        if stop > end and any(c.isalnum() for c in text[end:stop]):
            out.append((at, stop))
    elif kind == "account":
        if at and text[at - 1].isalnum():
            return
        if word == "akia":
            if text[at:end] == "AKIA" and (m := _AKIA.match(text, end)):
                out.append((at, m.end()))
        elif (m := _ACCOUNT.match(text, end)) and any(c.isdigit() for c in m[1]):
            out.append(m.span(1))
    elif word.endswith(" "):  # the number follows the street's name
        if m := _AFTER.match(text, end):
            out.append((at + 1, m.end()))
    elif end == len(text) or not text[end].isalnum():
        low = max(floor, at - 80)
        if m := _HOUSE.search(text[low:at]):
            out.append((low + m.start(1), end))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, and all spans."""

    def run(batch: pa.RecordBatch) -> list:
        anchors = automaton()
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            spans = spans_of(text, anchors)
            base = [x for x in spans if x[0] in BASE]
            rows.append((doc_id, *(sum(x[0] == k for x in base) for k in BASE), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
        return list(map(list, zip(*rows, strict=True)))

    return map_rows(texts(docs), run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the longest run is one."""
    out, at = [], 0
    for start, end, kind in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; other columns stay, n_chars follows the text."""
    schema = docs.schema

    def run(batches):
        anchors = automaton()
        for batch in batches:
            i = batch.schema.get_field_index("text")
            new = [None if t is None else mask(t, s) if (s := spans_of(t, anchors)) else t for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out
