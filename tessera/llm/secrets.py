"""Secret scan by assignment-aware lexing.

``secret_spans(text)`` returns every finding of one text as
``array<struct<kind, start, end, name, score>>`` (code points, end exclusive),
ordered by start, then kind in the order assign, access, hex, lex.

* ``assign``, ``access`` and ``hex`` are pattern findings.
* ``lex`` findings come from name-literal pairs: the lexer reads assignments of
  source and configuration syntax (``name = "x"``, ``"name": 'x'``, ``name=x``,
  ``name := x``, ``name => x``, ``<name>x</name>``), with a type where one stands
  between (``name: str = "x"``, ``let name: &str = "x"``), reads literals in
  single and triple quotes, joins literals concatenated with ``+``, and
  propagates constants (``a = "x"; password = a``).  A literal's
  score is the weight of the most sensitive word in its target's name times the
  strength of the literal; findings have a score of at least 0.5.

Defined cases: a null or empty text has no finding; repeated rows get equal
findings; a text of any length is lexed in one linear pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import bound_batches

# ---- fixed values: the base patterns and their least lengths ----------------
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16+ are the runs of [0-9a-f]+ that long
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
# ---- sensitive words of target names and their weights ----------------------
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "pwd": 0.9,
             "token": 0.9, "credential": 0.9, "credentials": 0.9, "privatekey": 0.9, "accesskey": 0.9,
             "secretkey": 1.0, "auth": 0.7, "bearer": 0.7, "signature": 0.6}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 0.9, ("secret", "key"): 1.0,
                   ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("auth", "key"): 0.9}
SENSITIVE_STEMS = ("pass", "pwd", "secret", "key", "token", "cred", "auth", "bearer", "signature")
PLACEHOLDER = re.compile(r"(?i)(x+|\*+|\.+|none|null|nil|true|false|undefined|todo|your[-_ ].*|example.*|<.*>)\Z")
PLACEHOLDER_HEAD = re.compile(r"(?i)your[-_ ]|example")  # of the placeholders longer than a word
# ------------------------------------------------------------------------------

KINDS = ("assign", "access", "hex", "lex")
FINDINGS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))

SITE = re.compile(r"""(?<![\w.\-$])([A-Za-z_][\w.\-]*+)(?:["'`]?\]?|\[\w*+\]|[?!](?=:))[ \t]*+(:=|=>|=(?!=)|:(?![:/]))[ \t]*+""")
# a type between a name's colon and its equals sign; it has no single colon, so no part of a text is read for two names
TYPE = re.compile(r"(?:[\w.,|&*?<>\[\] \t]|::|'[A-Za-z_]\w*+(?!'))++")
TYPED = re.compile(r"=(?![=>])[ \t]*+")
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)>[ \t]*+([^<>\s]++)[ \t]*+</")
TRIPLE = re.compile(r"""[rRbBfFuU]{0,2}(?:\"{3}\s*+((?:[^"\\]|\\[\s\S]|"(?!""))*+)\"{3}|'{3}\s*+((?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3})""")
STRING = re.compile(r"""[rRbBfFuU]{0,2}(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)""")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#&|]++""")
REFERENCE = re.compile(r"\$\{?([A-Za-z_][\w.\-]*+)\}?|([A-Za-z_][\w.\-]*+)")
PLUS = re.compile(r"[ \t]*+\+[ \t\r\n]*+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def name_weight(name: str) -> float:
    """Weight of the most sensitive word (or pair of words) in a target name."""
    words = [w.lower() for w in WORDS.findall(name)]
    singles = (SENSITIVE.get(w, 0.0) for w in words)
    pairs = (SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:]))
    return max([0.0, *singles, *pairs])


FULL_BITS = 40.0
MANY = 1 << 41  # with two different characters, so many have more than FULL_BITS
PREFIX = 9  # the longest placeholder that is a fixed word


def _bits(counts: dict[str, int]) -> float:
    n = sum(counts.values())
    return -sum(c * math.log2(c / n) for c in counts.values())


class Value:
    """What the score of a value needs, without its text, and the places of its
    literals: its own ``spans`` and those of its ``parts``, which are shared.

    Information content never falls when text is added, so ``counts`` (None
    from ``FULL_BITS`` on) has few different characters."""

    __slots__ = ("n", "counts", "space", "alpha", "crosses", "head", "last", "quoted", "spans", "parts", "best")

    def __init__(self, text: str = "", quoted: bool = False, spans: tuple = ()):
        self.n, self.head, self.last = len(text), text[:PREFIX], text[-1:]
        self.counts: dict[str, int] | None = dict(Counter(text))
        self.space, self.alpha = any(c.isspace() for c in text), text.isalpha() or not text
        self.crosses = all(c in "xX" for c in self.counts)
        self.quoted, self.spans, self.parts, self.best = quoted, spans, (), None
        if _bits(self.counts) >= FULL_BITS:
            self.counts = None

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls()
        out.parts = tuple(parts)
        for p in parts:
            out.n, out.head, out.last = min(MANY, out.n + p.n), (out.head + p.head)[:PREFIX] if out.n < PREFIX else out.head, p.last or out.last
            out.space, out.alpha, out.crosses = out.space or p.space, out.alpha and p.alpha, out.crosses and p.crosses
            out.quoted = out.quoted or p.quoted
            if out.counts is None or p.counts is None:
                out.counts = None
                continue
            for c, k in p.counts.items():
                out.counts[c] = min(MANY, out.counts.get(c, 0) + k)
            if _bits(out.counts) >= FULL_BITS:
                out.counts = None
        return out

    def placeholder(self) -> bool:
        if self.n <= PREFIX:
            return bool(PLACEHOLDER.match(self.head))
        return bool(self.crosses or (self.counts is not None and len(self.counts) == 1 and self.last in "*.")
                    or (self.head[0] == "<" and self.last == ">") or PLACEHOLDER_HEAD.match(self.head))

    def strength(self) -> float:
        """0 for short or placeholder literals, else information content against
        40 bits; an unquoted plain word counts half."""
        if self.n < 8 or self.space or self.placeholder():
            return 0.0
        plain = not self.quoted and self.alpha
        return (1.0 if self.counts is None else min(1.0, _bits(self.counts) / FULL_BITS)) * (0.5 if plain else 1.0)


def _expression(text: str, at: int, known: dict[str, Value]) -> tuple[Value, int] | None:
    """Value and end of the expression at ``at``: literals and references to
    known names, concatenated with ``+``."""
    parts: list[Value] = []
    while True:
        if m := TRIPLE.match(text, at):
            k = m.lastindex or 1
            inner = m[k].rstrip()
            parts.append(Value(inner, True, ((m.start(k), m.start(k) + len(inner)),)))
            at = m.end()
        elif m := STRING.match(text, at):
            k = m.lastindex or 1
            parts.append(Value(m[k] or "", True, (m.span(k),)))
            at = m.end()
        elif m := REFERENCE.match(text, at):
            name = m[1] or m[2]
            if name in known and not (b := BARE.match(text, m.end())):
                parts.append(known[name])
                at = m.end()
            elif b := BARE.match(text, at):
                parts.append(Value(b[0], False, (b.span(),)))
                at = b.end()
            else:
                return None
        elif m := BARE.match(text, at):
            parts.append(Value(m[0], False, (m.span(),)))
            at = m.end()
        else:
            break
        if not (plus := PLUS.match(text, at)):
            break
        at = plus.end()
    return (Value.joined(parts), at) if parts else None


def _typed(text: str, at: int) -> int | None:
    """Where the value of an annotated assignment starts (its type is at ``at``)."""
    if not (kind := TYPE.match(text, at)) or not (sign := TYPED.match(text, kind.end())) or not kind[0].strip():
        return None
    depth = 0
    for c in kind[0]:
        depth += (c in "<[") - (c in ">]")
        if depth < 0 or (c == "," and not depth):
            return None
    if depth or kind[0][-1] in "|&*":
        return None
    # without a blank before the sign only a quoted value tells a type from a value that holds the sign
    return sign.end() if kind[0][-1] in " \t" or STRING.match(text, sign.end()) else None


def lexed(text: str) -> list[tuple]:
    """``lex`` findings: scored literals of assignments to sensitive names."""
    known: dict[str, Value] = {}
    values: list[Value] = []
    ranks = 0

    def score(name: str, value: Value) -> None:
        nonlocal ranks
        if (weight := name_weight(name)) and (s := weight * value.strength()) >= 0.5:
            ranks -= 1  # of equal scores the first name stays
            value.best = max(value.best or (0.0, 0, ""), (s, ranks, name))

    def take(name: str, at: int) -> Value | None:
        if not (pair := _expression(text, at, known)):
            return None
        known[name] = pair[0]
        values.append(pair[0])
        score(name, pair[0])
        return pair[0]

    past = 0
    for site in SITE.finditer(text):
        if site.start() < past:
            continue
        at = _typed(text, site.end()) if site[2] == ":" else None
        if at is not None:
            if (plain := _expression(text, at, known)) and plain[0].quoted:
                past = at
            else:  # it may also be a value with a sign in it
                take(site[1], site.end())
        take(site[1], site.end() if at is None else at)
    for m in ELEMENT.finditer(text):
        values.append(Value(m[2], True, (m.span(2),)))
        score(m[1], values[-1])
    # values come after their parts: from the last to the first, each passes its best on
    found: dict[tuple[int, int], tuple[float, int, str]] = {}
    for value in reversed(values):
        if value.best:
            for span in value.spans:
                found[span] = max(found.get(span, value.best), value.best)
            for part in value.parts:
                part.best = max(part.best or value.best, value.best)
                for span in part.spans:
                    found[span] = max(found.get(span, part.best), part.best)
    return [("lex", a, b, name, round(s, 4)) for (a, b), (s, _, name) in found.items() if a < b]


def findings(text: str | None) -> list[tuple]:
    """All findings of one text in span order."""
    if not text:
        return []
    low = text.lower()
    out = []
    if any(k in low for k in ASSIGN_KEYWORDS):
        out += [("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span(), None, 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span(), None, 0.5) for m in HEX.finditer(text)]
    # without a sensitive word no target can score, so there is nothing to lex
    if any(k in low for k in SENSITIVE_STEMS) and ("=" in text or ":" in text or "</" in text):
        out += lexed(text)
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0]), f[2])) if len(out) > 1 else out


def redacted(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with every found span (overlaps joined) replaced by ``mask``."""
    if not (spans := findings(text)):
        return text
    out, at, end = [], 0, -1
    for _, a, b, _, _ in spans:
        if a > end:
            if end >= 0:
                at = end
            out += [text[at:a], mask]
        end = max(end, b)
    return "".join([*out, text[end:]])


@F.pandas_udf(FINDINGS)
def _findings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    keys = ("kind", "start", "end", "name", "score")
    for texts in batches:
        yield pd.Series([[dict(zip(keys, f)) for f in findings(t)] for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([redacted(t) for t in texts], dtype=object)


def secret_spans(text: Column) -> Column:
    """Findings column of a text column."""
    bound_batches(SparkSession.active())
    return _findings(text)


def redact_secrets(text: Column) -> Column:
    """Text column with the spans of all findings masked."""
    bound_batches(SparkSession.active())
    return _redacted(text)


def span_string(found: Column) -> Column:
    """``kind:start:end`` of the given findings, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
