"""Personal data: base patterns, and boosted trees over high-recall candidates.

Base spans (email, ip, card, phone) always stand. Besides, generators of high recall propose
spans that may overlap: grouped digits (every sub-run of 7 to 15 digits: phones without a plus, national ids), account numbers
with a country code, spelled-out e-mail addresses, colon-separated hardware and network addresses.
Every candidate becomes a row of format features (digits, groups, separators, checksums) and context
features (telling words near it, what touches it). Boosted trees, trained here on a synthetic labelled set of
fixed seed, score it; the score is calibrated on a held-out third, and each kind has the
least threshold whose held-out precision is PRECISION. Of overlapping winners the likelier stays.

Defined results: a null text is an empty one; repeated rows are scanned alone; an empty table
gives no rows; extra columns are ignored by scan() and kept by redact(). Offsets are code
points, ends exclusive. All patterns are linear in the text, for runs of any length, and spans are compared in sorted order.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tesserix.llm.gbt import Boosted
from tesserix.llm.textmap import map_batches, map_texts, slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("call", "national_id", "account", "spelled_email", "hardware")
KINDS = BASE + ADDED
PRECISION = 0.99

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: what begins inside a run also begins at its start.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_GROUPED = re.compile(r"(?<![0-9A-Za-z_.+-])\(?[0-9][0-9 ().\-/]{5,}[0-9](?![0-9A-Za-z_])")
_DIGITS = re.compile(r"[0-9]+")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]? ?(?:at|AT) ?[\])]? ?[A-Za-z0-9-]{1,63}(?: ?[\[(]? ?(?:dot|DOT) ?[\])]? ?[A-Za-z]{2,24}){1,3}")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_WORDS = (
    r"tel|phone|call|fax|mobile|cell|dial|sms|whatsapp", r"ssn|social|tax id|national id|passport|insurance", r"iban|account|bank|konto|swift|bic",
    r"mail|contact|reach|write to", r"mac|host|ipv6|addr|device|interface",
    r"version|order|invoice|isbn|issn|page|item|total|price|sku|serial|part|date|id:|lot|ticket|build|ref",
)
_CONTEXT = [re.compile(rf"(?i)(?<![a-z])(?:{p})") for p in _WORDS]


def _sub_runs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of 7 to 15 digits from group to group of a run; at most 15 begin at a group."""
    groups = [m.span() for m in _DIGITS.finditer(text, start, end)]
    for i, (a, _) in enumerate(groups):
        n, first = 0, a - (a > start and text[a - 1] == "(")
        for x, b in groups[i:]:
            n += b - x
            if n > 15:
                break
            if n >= 7:
                yield first, b


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind index, start, end); high recall, may overlap."""
    for m in _GROUPED.finditer(text):
        for a, b in _sub_runs(text, m.start(), m.end()):
            yield 4, a, b
    if "-" in text:
        for m in _ID.finditer(text):
            yield 5, m.start(), m.end()
    for m in _ACCOUNT.finditer(text):
        yield 6, m.start(), m.end()
    if "dot" in text or "DOT" in text:
        for m in _SPELLED.finditer(text):
            yield 7, m.start(), m.end()
    if text.count(":") > 4:
        for m in _COLONS.finditer(text):
            yield 8, m.start(), m.end()


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    n = int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))
    return n % 97 == 1


_BEFORE = re.compile(r"([0-9]+)([ ().\-/]{1,4})$")
_AFTER = re.compile(r"([ ().\-/]{1,4})([0-9]+)")
_GAPS = re.compile(r"[^0-9]+")
_ALNUM = re.compile(r"[0-9A-Za-z]+")


def _joints(text: str, kind: int, a: int, b: int) -> list[float]:
    """Of grouped digits: the last group but one, widest and different gaps, and how the groups before and after are joined to the span."""
    if kind != 4:
        return [0.0] * 9
    span = text[a:b].lstrip("(")
    gaps, groups = _GAPS.findall(span), _DIGITS.findall(span)
    out = [float(len(groups[-2])) if len(groups) > 1 else 0.0, float(max(map(len, gaps), default=0)), float(len(set(gaps)))]
    left, right = _BEFORE.search(text[max(0, a - 20) : a]), _AFTER.match(text, b, b + 20)
    for m, digits, gap in ((left, 1, 2), (right, 2, 1)):
        out += [float(len(m[digits])), float(len(m[gap])), float(m[gap] == gaps[-1]) if gaps else 0.0] if m else [0.0] * 3
    return out


def features(text: str, kind: int, a: int, b: int) -> list[float]:
    span = text[a:b]
    near = text[max(0, a - 40) : a]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    seps = {c for c in span if not c.isalnum()}
    return [
        *(float(kind == k) for k in range(len(BASE), len(KINDS))),
        float(b - a), float(sum(c.isdigit() for c in span)), float(len(groups)), float(groups[0]), float(groups[-1]), float(max(groups)),
        float(len(seps)), float("." in seps), float("-" in seps), float("(" in seps), float("/" in seps),
        float(kind == 6 and _mod97(span)), float("(" in span or "[" in span), float(" at " in span.lower()),
        float(span.count(":")), float(sum(c.isalpha() for c in span)), float(max(map(len, _ALNUM.findall(span)))), float(span[:1] == "0"), *_joints(text, kind, a, b),
        *(float(bool(p.search(near))) for p in _CONTEXT),
        float(text[a - 1 : a] in "$#€£"if a else 0.0), float(text[b : b + 1] in "%$€£" if b < len(text) else 0.0),
    ]


def _training_set(n: int, seed: int) -> list[tuple[str, int, str]]:
    """Sentences around one number or address each, whether it is personal, and the number or address."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def local() -> str:
        return r.choice((word(), f"{word()}.{word()}", f"{word()}{d(1)}", f"{word()[0]}_{word()}"))

    def site() -> str:
        return r.choice((word(), word(), f"{word()}-{word()}"))

    def account() -> str:
        body = "".join(r.choice("0123456789") for _ in range(18))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        s = f"DE{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    good = (
        lambda: (r.choice(("call", "phone", "tel:", "my mobile is", "fax", "dial", "cell")), r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(6)}", f"{d(3)}/{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}"))),
        lambda: (r.choice(("", word(), "at")), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (r.choice(("ssn", "social security", "tax id", "national id")), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(("iban", "account", word(), "bank")), account()),
        lambda: (r.choice(("mail", "contact", word(), "write to")), r.choice((f"{local()} at {site()} dot com", f"{local()} (at) {site()} (dot) org", f"{local()}[at]{site()}[dot]net"))),
        lambda: (r.choice(("", word())), r.choice((f"{local()} (at) {site()} (dot) org", f"{local()} [at] {site()} [dot] net"))),
        lambda: (r.choice(("mac", "device", "host addr", word(), word(), word(), "")), r.choice((":".join(h(2) for _ in range(6)), ":".join(h(4) for _ in range(8))))),
    )
    bad = (
        lambda: (r.choice(("order", "invoice", "ticket", "serial", "item", word(), word(), "")), r.choice((d(r.randint(7, 19)), f"{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}{d(4)}{d(4)}{d(4)}"))),
        lambda: (r.choice(("on", "date", "since", word())), r.choice((f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"1{d(1)}/0{r.randint(1, 9)}/20{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"19{d(2)} - 20{d(2)}"))),
        lambda: (r.choice(("version", "build", "total", "price $", "page", "isbn", word())), r.choice((f"{d(1)}.{d(2)}.{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(2)}-{d(2)}-{d(4)}", f"{d(3)} {d(4)}"))),
        lambda: (r.choice(("part", "sku", word(), "lot", "ref")), r.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"))),
        lambda: (r.choice(("part", "sku", word(), "lot", "ref")), "AB" + d(2) + " " + d(4) + " " + d(4) + " " + d(4)),
        lambda: (word(), f"{word()} at {word()} dot {word()}"),
        lambda: (r.choice(("time", "ratio", word())), ":".join(d(1) for _ in range(r.randint(6, 8)))),
    )
    out = []
    for _ in range(n):
        y = int(r.random() < 0.5)
        lead, span = r.choice(good if y else bad)()
        out.append((f"{word()} {word()} {lead} {span}{r.choice((' ', ', ', '. ', ''))}{word()} ".replace("  ", " "), y, span))
    return out


def _lists(n: int, seed: int) -> list[tuple[str, int, tuple[str, ...]]]:
    """Sentences with several numbers in one run: phones in lists and next to dates, and runs without any."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))
    shapes = (lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}")
    date = lambda: r.choice((f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.20{d(2)}", f"{r.randint(1, 12):02d}/{r.randint(1, 28):02d}/20{d(2)}"))
    out = []
    for _ in range(n):
        cue = r.choice(("call", "phone", "tel:", "fax", "cell", "dial"))
        if r.random() < 0.7:
            shape = r.choice(shapes)
            phones = tuple(shape() for _ in range(r.choice((1, 2, 2, 3))))
            run = r.choice((" / ", "/", " - ", " ") if shape is not shapes[3] else (" / ", " - ")).join(phones)
            if len(phones) == 1 or r.random() < 0.3:
                run = f"{date()} {run}" if r.random() < 0.6 else f"{run} {date()}"
            out.append((f"{word()} {cue} {run} {word()} ", 1, phones))
        else:
            run = r.choice((lambda: f"{date()} {date()}", lambda: f"{date()} - {date()}", lambda: " ".join(d(4) for _ in range(r.randint(4, 8))), lambda: f"{date()} {d(2)}-{d(2)}", lambda: " ".join(d(r.randint(1, 5)) for _ in range(8))))()
            out.append((f"{word()} {r.choice(('date', 'order', 'from', word()))} {run} {word()} ", 0, ()))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, tuple[float, ...]]:
    """The trees, and a threshold for each added kind."""
    rows, y, kinds = [], [], []
    for text, label, spans in [(t, y, (span,)) for t, y, span in _training_set(6000, 17)] + _lists(900, 18):
        base = base_spans(text)
        for k, a, b in candidates(text):
            if not any(x < b and a < z for _, x, z in base):
                rows.append(features(text, k, a, b))
                # Of the sub-runs of a run only whole numbers are personal.
                y.append(label * int(k != 4 or text[a:b] in spans))
                kinds.append(k)
    x, y, kinds = np.array(rows), np.array(y, float), np.array(kinds)
    held = np.arange(len(y)) % 3 == 0
    trees = Boosted(rounds=60).fit(x, y, held)
    p = np.array([trees.probability(r) for r in x[held]])
    cuts = []
    for k in range(len(BASE), len(KINDS)):
        pk, yk = p[kinds[held] == k], y[held][kinds[held] == k]
        ok = [t for t in np.unique(pk) if t >= 0.5 and yk[pk >= t].mean() >= PRECISION]
        cuts.append(float(min(ok)) if ok else 2.0)
    return trees, tuple(cuts)


def _free(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether a:b meets none of the disjoint spans, given in order."""
    at = bisect_left(starts, b)
    return not at or ends[at - 1] <= a


def spans_of(text: str | None, trees: Boosted, cuts: tuple[float, ...]) -> tuple[list, list]:
    """Base spans and added spans, each (kind index, start, end)."""
    text = text or ""
    base = base_spans(text)
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    won = []
    for k, a, b in candidates(text):
        if _free(starts, ends, a, b):
            p = trees.probability(features(text, k, a, b))
            if p >= cuts[k - len(BASE)]:
                won.append((-p, k, a, b))
    more: list[tuple[int, int, int]] = []
    starts, ends = [], []
    for _, k, a, b in sorted(won):
        if _free(starts, ends, a, b):
            at = bisect_left(starts, a)
            starts.insert(at, a)
            ends.insert(at, b)
            more.append((k, a, b))
    return base, sorted(more)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, n_added, base_sha256, spans."""
    trees, cuts = model()

    def make():
        def each(doc_id, text) -> Iterator[tuple]:
            base, more = spans_of(text, trees, cuts)
            n = Counter(k for k, _, _ in base)
            say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
            yield doc_id, n[0], n[1], n[2], n[3], len(more), hashlib.sha256(say(base).encode()).hexdigest(), say(base + more)

        return each

    return map_texts(docs, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string", make)


def redacted(text: str | None, trees: Boosted, cuts: tuple[float, ...]) -> str | None:
    if text is None:
        return None
    base, more = spans_of(text, trees, cuts)
    out, done = [], 0
    for a, k, b in sorted((a, k, b) for k, a, b in base + more):
        if b <= done:
            continue
        out += [text[done : max(a, done)], f"<{KINDS[k].upper()}>"]
        done = b
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """The same columns; every span in text becomes its kind in angle brackets, and n_chars follows."""
    trees, cuts = model()
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            texts = [redacted(t, trees, cuts) for t in batch.column(names.index("text")).to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, run, docs.schema)
