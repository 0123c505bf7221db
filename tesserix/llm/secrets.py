"""Secret scan: three base patterns, and an assignment-aware lexer on top.

The lexer cuts source and configuration text into tokens (strings of one or many lines with their escapes, names, numbers
and other bare words, signs, brackets, line ends) in one pass, and reads name-literal pairs from them:

- ``name = value``, ``name: type = value``, ``name := value``, ``"name": value``, ``name => value``, ``--name=value`` and
  ``<name>value</name>``, with values that are literals, names, calls, lists or any of these joined by + or nothing;
- nesting: a pair inside a brace or bracket, an indented block under ``name:`` and a section ``[name]`` has the names around
  it in its path;
- constants: a name stands for what it was last bound to, through any number of assignments, and for nothing once it is bound
  to something unknown. A call passes its literals on.

Every expression is a node that points to its literals and to the nodes of the names in it, so a text that joins a name to
itself line after line costs one node a line. A literal is scored by the most sensitive path that reaches it, and by how much
it, or the value that it is joined into, looks like key material; from SCORE on it is a span of kind "literal", unless a
base span already holds it.

Defined results: a null text is an empty one; repeated rows are scanned alone; an empty table gives no rows; extra columns
are ignored, whatever their names. Offsets are code points, ends exclusive. Work grows in proportion to the text but for
sorting the spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tesserix.llm.textmap import map_texts

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")

SCORE = 0.6
LEAST_CHARS = 8
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|redacted|dummy|your[_-]|xxx|\*\*\*|^(?:true|false|null|none|undefined)$|^\$|^<|\{\{|localhost")
#: Sensitivity of a part of a target name; the parts add up.
NAMES = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9, "tokens": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "signing": 0.5, "encryption": 0.5,
    "access": 0.4, "api": 0.4, "key": 0.5, "keys": 0.5, "pin": 0.5, "session": 0.4, "cookie": 0.4, "salt": 0.5, "authorization": 0.9,
}
#: What a name loses of its weight with each level of nesting that lies between it and the value.
DEEPER = 0.75


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    return min(1.0, sum(NAMES.get(p.lower(), 0.0) for p in _PARTS.findall(name)))


class Value:
    """What the score of a string needs of it, so that joined values need not be built: length, shares of its characters, classes."""

    __slots__ = ("length", "shares", "classes", "placeholder")

    def __init__(self, text: str = ""):
        n = len(text)
        self.length = float(n)
        self.shares = {c: k / n for c, k in Counter(text).items()}
        self.classes = frozenset("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in self.shares)
        self.placeholder = bool(_PLACEHOLDER.search(text))

    def joined(self, other: Value) -> Value:
        if not self.length or not other.length:
            return other if other.length else self
        out = Value()
        # Beyond any real length only the shares matter.
        out.length = min(self.length + other.length, 1e15)
        mine = self.length / (self.length + other.length)
        out.shares = {c: mine * self.shares.get(c, 0.0) + (1 - mine) * other.shares.get(c, 0.0) for c in {*self.shares, *other.shares}}
        out.classes, out.placeholder = self.classes | other.classes, self.placeholder or other.placeholder
        return out

    def score(self) -> float:
        """0 to 1: long, mixed and irregular strings look like key material."""
        if self.length < LEAST_CHARS or self.placeholder:
            return 0.0
        bits = -sum(p * math.log2(p) for p in self.shares.values())
        return min(1.0, 0.15 * bits + 0.15 * len(self.classes)) if len(self.classes) > 1 or bits >= 3.5 else 0.3


def literal_score(value: str) -> float:
    return Value(value).score()


_TOKEN = re.compile(
    r"""(?P<long>\"{3}(?:[^"\\]|\\.|\"{1,2}(?!"))*\"{3}|'{3}(?:[^'\\]|\\.|'{1,2}(?!'))*'{3})"""
    r"""|(?P<text>(?<![A-Za-z0-9_])[rbfuRBFU]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|`[^`\n]*`)"""
    r"""|(?P<xml><(?P<tag>[A-Za-z_][A-Za-z0-9_.:-]*)>(?P<inner>[^<>\n]*)</)"""
    r"""|(?P<bare>[A-Za-z0-9_$@][A-Za-z0-9_./+@~$%^&*!-]*)"""
    r"""|(?P<sign>:=|=>|[=!<>]=|->|[=:+,;])|(?P<open>[\[{(])|(?P<close>[\]})])|(?P<line>\n[\x20\t]*)|(?P<other>[^\s"'`<A-Za-z0-9_$@=:+,;\[\](){}!>-]+|[^\s])""",
    re.S,
)
_NAME = re.compile(r"-{0,2}[A-Za-z_$@][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*\Z")
_WORDS = re.compile(r"[A-Za-z_$@][A-Za-z0-9_$.-]{0,60}\Z")


class _Reader:
    """Reads the pairs of one text. A node is (literals, nodes it is made of, its joined value)."""

    def __init__(self, text: str):
        self.text = text
        # The text begins with a line, too.
        self.tokens = [("line", -1, -1, None), *((m.lastgroup if m.lastgroup not in ("tag", "inner") else "xml", m.start(), m.end(), m) for m in _TOKEN.finditer(text))]
        self.nodes: list[tuple[list[tuple[int, int]], list[int], Value]] = []
        #: Most sensitive path that a node is bound to.
        self.reach: list[float] = []
        self.bound: dict[str, int] = {}
        self.values: dict[tuple[int, int], Value] = {}

    def _value(self, a: int, b: int) -> Value:
        if (a, b) not in self.values:
            self.values[(a, b)] = Value(self.text[a:b])
        return self.values[(a, b)]

    def _inside(self, kind: str, a: int, b: int) -> tuple[int, int]:
        if kind == "long":
            return a + 3, b - 3
        while self.text[a] not in "\"'`":  # a prefix
            a += 1
        return a + 1, b - 1

    def _label(self, i: int) -> str | None:
        """The name that token i spells, as a target."""
        kind, a, b, _ = self.tokens[i]
        if kind == "bare" and _NAME.match(self.text, a, b):
            return self.text[a:b].lstrip("-")
        if kind == "text" and _WORDS.match(self.text, a + 1, b - 1):
            return self.text[a + 1 : b - 1]
        return None

    def _sign(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if i < len(self.tokens) and self.tokens[i][0] == "sign" else ""

    def _padded(self, i: int, b: int) -> int:
        """Where a bare word ends with its padding: signs of equality that touch it and end the line or the member."""
        if self._sign(i + 1) in ("=", "==") and self.tokens[i + 1][1] == b and (i + 2 >= len(self.tokens) or self.tokens[i + 2][0] in ("line", "close") or self._sign(i + 2) in (",", ";")):
            return self.tokens[i + 1][2]
        return b

    def _expression(self, i: int, plain: bool) -> tuple[int, int | None]:
        """(token after it, its node or None) of the expression from token i on; it ends with its line, at a comma or at a bracket that it did not open.

        plain: a bare word with a digit is a literal although it could be a name.
        """
        tokens, literals, parts, value, depth, n = self.tokens, [], [], Value(), 0, len(self.tokens)
        first, last = i, ""  # last: kind of the term before, if nothing joins it to the next
        while i < n:
            kind, a, b, _ = tokens[i]
            if not depth and (kind in ("line", "close") or self._sign(i) in (",", ";")):
                break
            if not depth and (last == "bare" and kind in ("bare", "text", "long") or last and kind == "bare"):
                break  # terms are joined by a plus, or are strings side by side
            last = kind if kind in ("bare", "text", "long") else ""
            if kind == "open":
                if self.text[a] == "{" or self.text[a] == "[" and i == first:
                    if not literals and not parts:
                        break  # a block or a list: its members are pairs or values of their own
                depth += 1
            elif kind == "close":
                depth -= 1
            elif kind in ("text", "long"):
                if self._sign(i + 1) in (":", "=>"):
                    break  # the target of the next pair
                at = self._inside(kind, a, b)
                if at[1] > at[0]:
                    literals.append(at)
                    value = value.joined(self._value(*at))
            elif kind == "bare":
                end = self._padded(i, b)
                if depth == 0 and i > first and end == b and self._sign(i + 1) in (":", "=", ":=", "=>"):
                    break
                word = self.text[a:b]
                known = self.bound.get(word, self.bound.get(word.rpartition(".")[2]))
                if known is not None:
                    parts.append(known)
                    value = value.joined(self.nodes[known][2])
                elif not (i + 1 < n and tokens[i + 1][0] == "open") and (end > b or (plain or not _NAME.match(word)) and re.search("[0-9]", word)):
                    literals.append((a, end))
                    value = value.joined(self._value(a, end))
            elif kind == "sign" and self.text[a:b] not in ("+", ",", ":", "=") or kind in ("other", "xml") and not depth:
                break
            i += 1
        if not literals and not parts:
            return i, None
        self.nodes.append((literals, parts, value))
        self.reach.append(0.0)
        return i, len(self.nodes) - 1

    def _bind(self, names: list[str], path: float, node: int | None) -> None:
        for name in names:
            for key in {name, name.rpartition(".")[2]}:
                if node is None:
                    self.bound.pop(key, None)
                else:
                    self.bound[key] = node
        if node is not None:
            self.reach[node] = max(self.reach[node], path)

    def read(self) -> list[tuple[int, int, float]]:
        """(start, end, score) of the literals that reach a sensitive name."""
        tokens, text, n, i = self.tokens, self.text, len(self.tokens), 0
        scopes: list[float] = []  # weights of the brackets that are open
        indents: list[tuple[int, float]] = []  # (indent of the key, weight) of blocks by indentation
        section, indent, waiting = 0.0, 0, 0.0

        def around() -> float:
            return max([section, *scopes[-1:], *(w for _, w in indents[-1:])])

        while i < n:
            kind, a, b, m = tokens[i]
            if kind == "line":
                indent = max(0, b - a - 1)
                if i + 1 < n and tokens[i + 1][0] != "line":
                    while indents and indents[-1][0] >= indent:
                        indents.pop()
                # A section is a bracketed name alone on its line.
                if i + 3 < n and tokens[i + 1][0] == "open" and text[tokens[i + 1][1]] == "[" and tokens[i + 3][0] == "close" and (i + 4 >= n or tokens[i + 4][0] == "line") and (label := self._label(i + 2)):
                    section, i = name_score(label) * DEEPER, i + 4
                    continue
                waiting, i = 0.0, i + 1
            elif kind == "open":
                scopes.append(max(waiting, scopes[-1] if scopes else 0.0))
                waiting, i = 0.0, i + 1
            elif kind == "close":
                if scopes:
                    scopes.pop()
                i += 1
            elif kind == "xml":
                path = max(name_score(m["tag"]), around())
                node = None
                if m["inner"].strip():
                    self.nodes.append(([m.span("inner")], [], self._value(*m.span("inner"))))
                    self.reach.append(0.0)
                    node = len(self.nodes) - 1
                self._bind([m["tag"]], path, node)
                i += 1
            elif kind in ("text", "bare") and (label := self._label(i)):
                after, names = i + 1, [label]
                if kind == "bare" and after < n and text[tokens[after][1] : tokens[after][2]] == "?":
                    after += 1  # an optional member
                sign = self._sign(after)
                if sign == ":" and kind != "text":
                    # name: type = value. A type is what stands up to an equals sign on the same line.
                    j, level = after + 1, 0
                    while j < n and tokens[j][0] != "line" and j < after + 24 and not (self._sign(j) in ("=", ",", ":", ";") and level == 0):
                        level += (tokens[j][0] == "open") - (tokens[j][0] == "close")
                        if tokens[j][0] in ("text", "long") or level < 0:
                            break
                        j += 1
                    if j > after + 1 and self._sign(j) == "=" and level == 0:
                        after, sign = j, "="
                if sign not in ("=", ":", ":=", "=>") or text.startswith("//", tokens[after][2]):
                    # A member of a list under a sensitive name.
                    if kind == "text" and around():
                        _, node = self._expression(i, False)
                        if node is not None:
                            self.reach[node] = max(self.reach[node], around())
                    i += 1
                    continue
                own = max(map(name_score, names))
                path = min(1.0, max(own, around()) if not own or not around() else max(own, around(), own + around() * DEEPER))
                if after + 1 >= n or tokens[after + 1][0] == "line":
                    # Nothing on the line: a block by indentation.
                    if sign == ":":
                        indents.append((indent, path * DEEPER))
                    self._bind(names, 0.0, None)
                    i = after + 1
                    continue
                # Values of settings (a colon outside brackets, no blanks around the sign, a section) and of very sensitive names need no quotes.
                close = tokens[after][1] == b and tokens[after + 1][1] == tokens[after][2]
                end, node = self._expression(after + 1, path >= 0.9 or section > 0 or not scopes and (sign == ":" or close))
                self._bind(names, path, node)
                if end < n and tokens[end][0] == "open" and node is None:
                    waiting = path * DEEPER
                i = max(end, after + 1)
            elif kind in ("text", "long") and around():
                end, node = self._expression(i, False)
                if node is not None:
                    self.reach[node] = max(self.reach[node], around())
                i = max(end, i + 1)
            else:
                i += 1
        return self._scored()

    def _scored(self) -> list[tuple[int, int, float]]:
        """Weights go down from expressions to what they are made of, which was always there before."""
        whole = [0.0] * len(self.nodes)
        best: dict[tuple[int, int], float] = {}
        for k in range(len(self.nodes) - 1, -1, -1):
            literals, parts, value = self.nodes[k]
            s = self.reach[k]
            if not s:
                continue
            whole[k] = max(whole[k], s * value.score())
            for p in parts:
                self.reach[p] = max(self.reach[p], s)
                whole[p] = max(whole[p], whole[k])
            for at in literals:
                score = max(whole[k], s * self._value(*at).score())
                if score > best.get(at, 0.0):
                    best[at] = score
        return sorted((a, b, s) for (a, b), s in best.items() if s >= SCORE)


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name."""
    return _Reader(text).read()


def spans_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans, each (start, kind index, end)."""
    text = text or ""
    base = base_spans(text)
    if "=" not in text and ":" not in text and "</" not in text:
        return base, []
    starts, furthest, most = [x for x, _, _ in base], [], 0
    for _, _, z in base:
        most = max(most, z)
        furthest.append(most)
    # Inside a base span: of those that begin no later, one ends no earlier.
    more = [(a, 3, b) for a, b, _ in lexed(text) if not (at := bisect_right(starts, a)) or furthest[at - 1] < b]
    return base, more


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans."""

    def make():
        def each(doc_id, text) -> Iterator[tuple]:
            base, more = spans_of(text)
            counts = Counter(k for _, k, _ in base)
            say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            yield doc_id, counts[0], counts[1], counts[2], len(more), hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more))

        return each

    return map_texts(docs, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string", make)
