"""Personal data: generators of high recall propose overlapping spans, boosted trees judge them.

Spans of the base kinds (email, ip, card, phone) are kept by their own checks. Beside them, looser generators propose
candidates; trees score each by its format and its context, and calibrated thresholds select which are added.
No table labels spans, so the trees are trained on a seeded synthetic sample of SAMPLE candidates (half held out for
calibration and thresholds), built from the forms below in contexts for and against.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import shared
from plumbline.llm.boosting import BoostedTrees, threshold

#: Labelled candidates that the trees are fitted on, and the precision that thresholds hold on the other half.
SAMPLE, SEED, PRECISION = 6000, 11, 0.995
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ["email", "ip", "card", "phone"]

#: Generators of further candidates: (kind, pattern).
_GENERATORS = [
    ("card_plain", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("phone_plus", re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])")),
    ("phone_local", re.compile(r"(?<![\w.+-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![\w-]|\.[0-9])")),
    ("phone_intl", re.compile(r"(?<![\w.+-])00[0-9][\x20().0-9-]{7,16}[0-9](?![\w-])")),
    ("ssn", re.compile(r"(?<![\w.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![\w-]|\.[0-9])")),
    ("card_loose", re.compile(r"(?<![\w.-])[0-9]{4}(?:[\x20./-]{1,3}[0-9]{4}){2}[\x20./-]{1,3}[0-9]{1,7}(?![\w-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("email_written", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|＠)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{1,63}){1,4}(?![\w-])", re.I)),
    ("ip6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}|:)(?![\w:])")),
    ("mac", re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-])")),
]
KINDS = BASE + [kind for kind, _ in _GENERATORS]
_CUES = [
    re.compile(r"\b(?:tel|phone|call|cell|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono|dial|reach)\b", re.I),
    re.compile(r"\b(?:ssn|social|security|taxpayer|insurance)\b", re.I),
    re.compile(r"\b(?:card|visa|mastercard|amex|karte|carte|tarjeta|iban|account|konto|compte|cuenta|bank)\b", re.I),
    re.compile(r"\b(?:e-?mail|mail|contact|write|kontakt|contacto|courriel)\b", re.I),
    re.compile(r"\b(?:ip|address|host|server|client|mac|device)\b", re.I),
    re.compile(r"\b(?:order|invoice|version|ver|page|isbn|issn|item|part|serial|model|build|total|year|no|nr|ref|ticket|id|range|table|figure|hash|commit|time|score)\b", re.I),
]


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, each leftmost and without overlap in its kind, in linear time."""
    spans = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            spans.append(("email", start, match.end()))
        done = match.end() if match else at + 1
        at = text.find("@", done)
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            length = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                spans.append(("ip", start, start + length))
            start += length + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Candidate spans of all generators; they may overlap."""
    return [(kind, *m.span()) for kind, pattern in _GENERATORS for m in pattern.finditer(text)]


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = re.sub("[^0-9]", "", span)
    groups = [len(x) for x in re.findall("[0-9]+", span)]
    seps = re.sub("[0-9A-Za-z]", "", span)
    row = [float(kind == k) for k, _ in _GENERATORS]
    row += [len(span), len(digits), len(set(digits)), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0]
    row += [len(seps), len(set(seps)), seps.count(" "), seps.count("-"), seps.count("."), seps.count(":"), seps.count("("), seps.count("/")]
    row += [float(bool(digits) and len(digits) >= 12 and luhn(digits)), float(digits[:1] or -1), float(digits[:3] or -1), float(digits[-4:] == "0000"), float(digits[:3] in ("000", "666") or digits[:1] == "9")]
    row += [float(sum(c.isalpha() for c in span)), float(span.isupper()), float(sum(c in "abcdefABCDEF" for c in span))]
    for cue in _CUES:
        row += [float(bool(cue.search(before))), float(bool(cue.search(after[:20])))]
    near = before.rstrip()[-1:], after.lstrip()[:1]
    row += [float(near[0] in "#$€£="), float(near[0] == ":"), float(near[0].isdigit()), float(near[1].isdigit()), float(near[1] in "%$€£"), float(near[1] in ".,;)")]
    return row


def _sample() -> tuple[np.ndarray, np.ndarray]:
    """Synthetic labelled candidates in contexts for and against."""
    r = random.Random(SEED)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(3, 8)))
    filler = lambda: " ".join(name() for _ in range(r.randint(2, 7)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        return next(body + x for x in "0123456789" if luhn(body + x))

    area = lambda: str(r.randint(201, 989))
    yes = [
        ("card_plain", card), ("phone_plus", lambda: f"+{r.randint(1, 98)} ({area()}) {d(3)}-{d(4)}"), ("phone_plus", lambda: f"+{r.randint(1, 98)} {area()} {d(3)} {d(4)}"), ("phone_plus", lambda: f"+{r.randint(1, 9)}{area()}{d(7)}"),
        ("phone_local", lambda: f"({area()}) {d(3)}-{d(4)}"), ("phone_local", lambda: f"{area()}-{d(3)}-{d(4)}"), ("phone_local", lambda: f"{area()}.{d(3)}.{d(4)}"), ("phone_local", lambda: f"{area()} {d(3)} {d(4)}"),
        ("phone_intl", lambda: f"00{r.randint(1, 98)} {d(2)} {d(3)} {d(4)}"), ("ssn", lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1001, 9999)}"),
        ("card_loose", lambda: (lambda c: r.choice([". ", " / ", "  ", "."]).join(c[i : i + 4] for i in range(0, 16, 4)))(card())),
        ("iban", lambda: f"{r.choice(['DE', 'FR', 'ES', 'GB', 'NL', 'IT'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"), ("iban", lambda: f"{r.choice(['DE', 'FR', 'ES'])}{d(20)}"),
        ("email_written", lambda: f"{name()}{r.choice(['.' + name(), d(2), ''])}{r.choice(['(at)', ' (at) ', '[at]', ' [at] '])}{name()}{r.choice(['.', ' (dot) ', '[dot]'])}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"),
        ("ip6", lambda: ":".join(h(4) for _ in range(8))), ("ip6", lambda: f"2001:db8:{h(4)}::{h(3)}"), ("mac", lambda: r.choice(":-").join(h(2) for _ in range(6))),
    ]
    no = [
        ("card_plain", lambda: d(r.randint(13, 19))), ("card_plain", lambda: "20" + d(12)), ("phone_plus", lambda: f"+{d(1)} 0{d(2)} {d(3)} {d(4)}"), ("phone_plus", lambda: f"+{d(2)}.{d(3)}.{d(3)}.{d(4)}"),
        ("phone_local", lambda: d(10)), ("phone_local", lambda: f"{d(3)} {d(3)} {d(4)}"), ("phone_local", lambda: f"19{d(2)} {d(3)} 20{d(2)}"), ("phone_intl", lambda: f"000{d(9)}"), ("phone_intl", lambda: f"00{d(1)}.{d(3)}.{d(3)}.{d(3)}"),
        ("ssn", lambda: f"000-{d(2)}-{d(4)}"), ("ssn", lambda: f"9{d(2)}-{d(2)}-{d(4)}"), ("ssn", lambda: f"{d(3)} {d(2)} {d(4)}"),
        ("card_loose", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}"), ("card_loose", lambda: f"{d(4)}/{d(4)}/{d(4)}/{d(4)}"), ("card_loose", lambda: f"20{d(2)} 20{d(2)} 20{d(2)} 20{d(2)}"),
        ("iban", lambda: f"{r.choice(['AB', 'XX', 'QZ', 'ID'])}{d(2)}{h(8).upper()}"), ("iban", lambda: f"SN{d(2)} {h(4).upper()} {h(4).upper()}"), ("ip6", lambda: f"{d(2)}:{d(2)}:{d(2)}"), ("ip6", lambda: f"{d(1)}:{d(2)}:{d(2)}"), ("mac", lambda: "-".join(d(2) for _ in range(6))),
    ]
    cues = {"card_plain": ["card", "visa", "karte"], "phone_plus": ["call", "phone", "tel"], "phone_local": ["call", "phone", "tel", "reach me at"], "phone_intl": ["tel", "fax", "call"], "ssn": ["ssn", "social security"], "card_loose": ["card", "visa"], "iban": ["iban", "account"], "email_written": ["mail", "contact"], "ip6": ["host", "from", "client"], "mac": ["mac", "device"]}
    against = ["order", "invoice", "version", "part no", "serial", "ref", "isbn", "total", "page", "time", "score", "commit"]
    x, y = [], []
    while len(y) < SAMPLE:
        label = r.random() < 0.5
        kind, form = r.choice(yes if label else no)
        cue = r.choice(cues[kind]) if label and r.random() < 0.6 else r.choice(against) if not label and r.random() < 0.7 else ""
        span = form()
        left = f"{filler()} {cue}{r.choice([' ', ': ']) if cue else ' '}"
        text = f"{left}{span}{r.choice([' ', '. ', ', '])}{filler()}"
        x.append(describe(text, kind, len(left), len(left) + len(span)))
        y.append(float(label))
    return np.array(x), np.array(y)


@functools.lru_cache(maxsize=1)
def trained() -> tuple[BoostedTrees, float]:
    """The trees and their threshold; the same on every machine."""
    x, y = _sample()
    half = len(y) // 2
    model = BoostedTrees().fit(x[:half], y[:half]).calibrate(x[half:], y[half:])
    return model, max(0.5, threshold(model.probability(x[half:]), y[half:], PRECISION))


def find_personal(text: str, model: BoostedTrees, cutoff: float) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that the method adds); what overlaps a base span or a better candidate isn't added."""
    base = base_spans(text)
    proposed = candidates(text)
    if not proposed:
        return base, []
    taken = sorted((a, b) for _, a, b in base)
    free = [c for c in proposed if not any(a < c[2] and c[1] < b for a, b in taken)]
    if not free:
        return base, []
    p = model.probability(np.array([describe(text, *c) for c in free]))
    added: list[tuple[str, int, int]] = []
    held: set[int] = set()
    for i in sorted(range(len(free)), key=lambda i: (-p[i], free[i][1], -free[i][2])):
        covered = range(free[i][1], free[i][2])
        if p[i] >= cutoff and not held.intersection(covered):
            held.update(covered)
            added.append(free[i])
    return base, added


def _scan(model: BoostedTrees, cutoff: float):
    order = {k: i for i, k in enumerate(KINDS)}
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))
    nothing = ((0,) * 4, sha256(b"").hexdigest(), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = shared.as_bytes(batch["text"])
            rows = []
            for doc in docs:
                if not doc:
                    rows.append(nothing)
                    continue
                base, added = find_personal(doc.decode(), model, cutoff)
                rows.append((tuple(sum(k == kind for k, _, _ in base) for kind in BASE), sha256(joined(base).encode()).hexdigest(), joined(base + added)))
            counts = {f"n_{kind}": pa.array([r[0][i] for r in rows], pa.int64()) for i, kind in enumerate(BASE)}
            yield pa.record_batch({"doc_id": batch["doc_id"], **counts, "base_sha256": pa.array([r[1] for r in rows], pa.string()), "spans": pa.array([r[2] for r in rows], pa.string())})

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data of every row of docs, from whole texts; offsets are code points, ends exclusive.

    A null or empty text has none; rows that repeat and null ids keep rows of their own; an empty table gives none.
    Base spans come first by kind, then by start, added ones after them. Other columns of docs are not read.
    """
    model, cutoff = trained()
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return shared.texts(docs).mapInArrow(_scan(model, cutoff), schema)
