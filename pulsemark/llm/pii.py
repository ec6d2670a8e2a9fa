"""Personal data by candidate gradient boosting.

Plain rules find the base spans: e-mail, ip, card and phone as their formats define them. Generators with high recall
then propose further, overlapping spans (addresses spelt with "at" and "dot", IPv6, phone numbers without a country
code, cards with unusual separators). Boosted trees score every proposal by format and context, and thresholds
calibrated for precision decide which are added; of overlapping additions the best scored stays. Base spans always stay.

The trees are trained on examples built here from rules (``examples``): no table holds labelled spans. Positions are
code points, ends exclusive. All patterns run in time linear in the text.

Edge cases: null texts are empty and have no spans; repeated rows give equal rows; other columns are ignored; ids are
passed through as they are.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemark.llm.boosting import Boosted
from pulsemark.llm.common import sliced

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# fixed values: the formats of the base kinds, each in a form that never scans a run of characters twice
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{ ]at[)\]} ]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses: each @ is tried once, with all the local part before it."""
    out: list[Span] = []
    free = 0  # the end of the last match
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append(("email", start, free))
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed in KINDS, then by start."""
    out = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- generators: spans that may be personal data ---------------------------------------------------------------
_SPELT = re.compile(r"(?: ?[(\[{] ?at ?[)\]}] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]{2,63})+")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.])[(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")


def _side_by_side(run: str, at: int) -> list[tuple[int, int]]:
    """A run of digit groups as two or more card numbers one after another, or nothing."""
    groups = list(re.finditer("[0-9]+", run))
    before: dict[int, int] = {0: 0}  # place among the groups -> where the card that ends there begins
    for i in range(len(groups)):
        if i not in before:
            continue
        digits = ""
        for j in range(i, len(groups)):
            digits += groups[j].group()
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn(digits):
                before.setdefault(j + 1, i)
    cards, end = [], len(groups)
    while end and end in before:
        cards.append((at + groups[before[end]].start(), at + groups[end - 1].end()))
        end = before[end]
    return cards[::-1] if end == 0 and len(cards) > 1 else []


def _is_ipv6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def proposals(text: str) -> list[Span]:
    out: list[Span] = []
    for m in _SPELT.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
    for m in _COLONS.finditer(text) if ":" in text else ():
        if m.group().count(":") >= 2 and re.search("[0-9A-Fa-f]", m.group()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 26:
            out += [("card", *span) for span in _side_by_side(m.group(), m.start())]
    for m in _NUMBER.finditer(text):
        n = len(_digits(m.group()))
        if 7 <= n <= 15:
            out.append(("phone", m.start(), m.end()))
        if 13 <= n <= 19:
            out.append(("card", m.start(), m.end()))
    return out


# --- features --------------------------------------------------------------------------------------------------
_HINTS = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|client|addr", re.I),
    "card": re.compile(r"card|visa|master|credit|amex|karte|tarjeta|carte|payment", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|cell|fax|dial|ring|reach|anruf|appel", re.I),
}
_AGAINST = re.compile(r"isbn|order|invoice|version|item|serial|model|sku|total|price|page|vol|ref|article|date|build|ticket|case|account|part no|\$|€", re.I)
_DATE = re.compile(r"^(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a proposal."""
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 28) : start], text[end : end + 16]
    digits = _digits(s)
    groups = re.findall("[0-9]+", s)
    marks = {c for c in s if not c.isalnum()}
    return [
        *(float(kind == k) for k in KINDS),
        float(len(digits)),
        float(len(s)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(marks)),
        float(len(s) - len(digits)),
        float(luhn(digits)) if digits else 0.0,
        float("(" in s and ")" in s and kind == "phone"),
        float(s.startswith("00")),
        float(bool(groups) and len(groups[-1]) == 4),
        float(s.count(":")),
        float("::" in s),
        float(bool(re.search(r"[(\[{] ?at ?[)\]}]", s))),
        float(bool(re.search(r"dot|\.", s))),
        float(bool(re.search(r"(?:dot ?[)\]}]? ?|\.)(?:com|org|net|edu|gov|io|de|fr|es|uk)$", s))),
        float(bool(_DATE.match(s))),
        float(len(set(digits))),
        float("." in marks),
        float("/" in marks),
        float(bool(_HINTS[kind].search(before))),
        float(bool(_AGAINST.search(before))),
        float(after[:1] in ("%", "$", "€")),
        float(":" in s and _is_ipv6(s)),
        float(s[:1] == "0"),
        float(s[:5].lower() in ("fe80:", "2001:", "2002:", "2a00:", "2a01:", "2a02:", "2a03:", "2606:", "fd00:", "fc00:")),
    ]


# --- training examples, built by rule --------------------------------------------------------------------------
def _card(rng: random.Random, valid: bool) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
    right = next(c for c in "0123456789" if luhn(body + c))
    return body + (right if valid else rng.choice([c for c in "0123456789" if c != right]))


def examples(n: int = 2400, seed: int = 11) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(features, labels, kinds) of ``n`` generated spans in context."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 8)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hex4 = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 4)))
    hints = {
        "email": ["mail", "contact", "write to"], "ip": ["ip", "host", "server"],
        "card": ["card", "visa", "credit card"], "phone": ["tel", "call", "phone", "mobile:"],
    }
    against = ["order", "invoice", "isbn", "item", "serial", "version", "ref", "total", "ticket", "case", "page"]
    rows, labels, kinds = [], [], []
    while len(rows) < n:
        kind = rng.choice(KINDS)
        side = rng.choices(["friend", "foe", "none"], [0.35, 0.3, 0.35])[0]
        good = rng.random() < 0.5
        if kind == "email":
            a, d = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), ("[at]", "."), ("{at}", "{dot}")])
            body = f"{word()}{rng.choice(['', '.', num(2)])}{word()}{a}{word()}{d}{rng.choice(['com', 'org', 'net', 'de'])}" if good else f"{word()} at {word()}.{word()}"
        elif kind == "ip":
            if good and rng.random() < 0.5:
                body = ":".join(hex4() for _ in range(8)) if rng.random() < 0.6 else f"{rng.choice(['fe80', '2001', '2a01'])}:{rng.choice(['', ':' + hex4() + ':'])}:{hex4()}".replace(":::", "::")
                good = side != "foe"
            elif good:
                body = f"{hex4()}::{hex4()}"  # short forms look like other things: only a word before tells
                good = side == "friend"
            else:
                body = rng.choice([":".join(num(2) for _ in range(3)), ":".join(num(2) for _ in range(4)), ":".join(num(2) for _ in range(6)), f"{num(1)}:{num(2)}:{num(2)}", "::" + num(1)])
        elif kind == "card":
            d = _card(rng, good)
            sep = rng.choice([".", "/", "  ", " ", "-", " ", ""]) if good else rng.choice(["", " ", "-", ".", ""])
            body = sep.join(d[i : i + 4] for i in range(0, 16, 4))
            if good and sep in ("", " ", "-"):  # alone it would be a base span
                other = _card(rng, True)
                body += (sep or " ") + sep.join(other[i : i + 4] for i in range(0, 16, 4))
        else:
            a, b, c = num(3), num(3), num(4)
            shape = rng.choice(["formatted", "local", "plain", "other"])
            if shape == "formatted":
                body = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{num(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a} {b} {c}"])
                good = side != "foe"
            elif shape == "local":
                body = rng.choice([f"0{num(2)} {num(7)}", f"0{num(3)}/{num(6)}", f"0{num(3)} {num(6)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{num(3)}-{num(4)}", f"{num(3)} {num(4)}"])
                good = side == "friend"
            elif shape == "plain":
                body = num(rng.randint(7, 11))
                good = side == "friend"
            else:
                body = rng.choice([num(rng.randint(12, 19)), f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}", f"{num(4)} {num(4)}", f"{num(1)}.{num(8)}", f"{num(3)}-{num(10)}", f"{num(4)}.{num(3)}.{num(2)}"])
                good = False
        lead = f"{word()} {word()} {rng.choice(hints[kind]) + ' ' if side == 'friend' else rng.choice(against) + ' ' if side == 'foe' else ''}"
        text = f"{lead}{body} {word()} {word()}"
        spans = [s for s in proposals(text) if s[0] == kind]
        if spans:
            rows.append(describe(text, max(spans, key=lambda s: s[2] - s[1])))
            labels.append(float(good))
            kinds.append(kind)
    return np.array(rows), np.array(labels), kinds


# hand-written lines, one span each between braces, with kind and label: thresholds are calibrated on them, no rule made them
CALIBRATION = """
phone 1 Ring me on {030 1234567} after six. | phone 1 tel {0171 2345678} | phone 1 Our number: {(555) 123-4567} | phone 1 call {5551234567} today | phone 1 Fax {01 44 55 66 77}
phone 1 Reach her at {555-123-4567}, please | phone 1 mobile {0044 20 7946 0958} | phone 1 Anruf unter {0221/123456} | phone 1 write to Jim or phone {555.867.5309} | phone 1 Service {800 555 0199}
phone 0 order {123-456-7890} was sent | phone 0 invoice {555-123-4567} is due | phone 0 ISBN {978-3-16-148410-0} | phone 0 on {2021-03-14} we met | phone 0 The sum of {1234567} units
phone 0 serial {8834 2211} | phone 0 ticket {800-555-0199} closed | phone 0 pages {1200 1300} | phone 0 version {10.2.4567.89} | phone 0 ran for {20210314 1530} hours
phone 0 in {1990-2000 2010} | phone 0 population {12345678} in total | phone 0 pi is {3.14159265} | phone 0 part no {0171 2345678} | phone 0 rooms {101 102 103}
card 1 my visa {4111.1111.1111.1111} | card 1 Cards {4111 1111 1111 1111} 5500 0000 0000 0004 | card 1 pay with {4012/8888/8888/1881} | card 1 5500-0000-0000-0004-{4111-1111-1111-1111} | card 1 She typed {4222.2222.2222.2222.0}
card 0 tracking {4111.1111.1111.1112} | card 0 serial {1234.5678.9012.3456} | card 0 the key {0000-1111-2222-3333} | card 0 value {3.14159265358979} | card 0 item {9876/5432/1098/7654}
ip 1 host {2001:db8:85a3:0:0:8a2e:370:7334} | ip 1 login from {fe80::1} | ip 1 server {2001:db8::ff00:42:8329} | ip 1 address {fe80::1ff:fe23:4567:890a} | ip 1 my ip is {2a01::5}
ip 0 at {12:30:45} sharp | ip 0 took {1:02:03} | ip 0 ratio {10:20:30:40} | ip 0 MAC {00:1b:44:11:3a:b7} | ip 0 see {12:30:45:07} in the film
email 1 write john (at) mail (dot) com | email 1 contact jane.doe[at]example.org | email 1 ping bob at corp dot net | email 1 mail sam{at}site{dot}de | email 0 we met at example.shop
email 0 dinner at Joe.then home | email 0 look at foo.bar now | email 0 arrive at noon.we eat | email 0 laughs at him.they go
"""


def calibration() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(features, labels, kinds) of the hand-written lines; e-mail lines are taken whole, for braces are part of some."""
    rows, labels, kinds = [], [], []
    for cell in CALIBRATION.strip().replace("\n", " | ").split(" | "):
        kind, label, line = cell.strip().split(" ", 2)
        text = line if kind == "email" else line.replace("{", "").replace("}", "")
        wanted = None if kind == "email" else (line.index("{"), line.index("}") - 1)
        spans = [s for s in proposals(text) if s[0] == kind and (wanted is None or s[1:] == wanted)]
        if spans:
            rows.append(describe(text, spans[0]))
            labels.append(float(label))
            kinds.append(kind)
    return np.array(rows), np.array(labels), kinds


@lru_cache(maxsize=1)
def trained() -> Boosted:
    """Boosted trees fitted on the generated examples, thresholds calibrated on the hand-written lines."""
    x, y, _ = examples()
    model = Boosted().fit(x, y)
    model.calibrate(*calibration())
    return model


def all_spans(text: str, model: Boosted) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), both by kind as listed, then start."""
    if not _ANY.search(text) and "::" not in text:
        return [], []
    base = base_spans(text)
    taken = [(a, b) for _, a, b in base]
    scored = []
    for span in proposals(text):
        if any(span[1] < b and a < span[2] for a, b in taken):
            continue
        score = model.score(describe(text, span))
        if score >= model.thresholds.get(span[0], 2.0):
            scored.append((-score, span[1], KINDS.index(span[0]), span))
    added: list[Span] = []
    for *_, span in sorted(scored):
        if not any(span[1] < b and a < span[2] for _, a, b in added):
            added.append(span)
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return base, sorted(base + added, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every covered stretch replaced by its kind in brackets; overlapping spans are one stretch."""
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < end:
            if b > end:
                end = at = b
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = end = b
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_added."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts = {k: [] for k in KINDS}
            digests, spans, added = [], [], []
            for text in batch.column(1):
                base, full = all_spans(text.as_py() or "", model)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(full))
                added.append(len(full) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_column`` replaced; null texts stay null, all columns stay."""
    model = trained()
    names = docs.columns
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text in batch.column(at):
                t = text.as_py()
                full = all_spans(t, model)[1] if t else []
                out.append(redact(t, full) if full else t)
            arrays = list(batch.columns)
            arrays[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, docs.schema)
