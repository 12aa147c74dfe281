"""Personal data: patterns with checks, and spans that a semi-Markov conditional random field adds.

Patterns find the plain forms of e-mail addresses, IP addresses, card numbers and
international phone numbers.  The model looks for further ones: it cuts the tokens
around digits and at-signs into segments, scores whole segments by features of
the span (shape, digits, checks, separators, the words around it) and the kinds of
neighbouring segments, and dynamic programming over segments of bounded length
chooses boundaries and kinds together.  Tokens far from any digit or at-sign can
be in no segment, so leaving them out changes no result.  Spans that overlap a
pattern's span are dropped; the pattern's stays.

The model is fitted on the driver by maximum likelihood, on windows from a bounded
sample of documents, labelled by the patterns, and on written-out families of forms of
each kind and of numbers that are none of them, between words of the sample.

Defined results: null and empty texts have no spans; texts of any length are
searched whole; positions are code points, ends exclusive; repeated rows give
equal results; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
# Tokens in the longest segment; no listed form of any kind has more.
REACH = 20
# Documents that the sample takes windows from, windows of each, and their reach in characters.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW = 200, 2, 120
# Documents looked into at first for each that the sample wants.
CANDIDATES = 8

# The forms that must be found.  A run of digits or address characters is tried from
# its start only; starts within a run end at the same place.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|(?i:\bat\b)")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed forms, by start, then kind."""
    out: list[Span] = []
    stop, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > stop and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            stop = domain.end()
            out.append(("email", start, stop))
        at = text.find("@", max(at + 1, stop))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def tokens(text: str, start: int = 0, stop: int | None = None) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, start, len(text) if stop is None else stop)]


@cache
def _shape(token: str) -> str:
    if token[0].isdigit() and token.isascii():
        return f"{min(len(token), 8)}"
    if token[0].isspace():
        return "_"
    if token[0].isalpha():
        word = token.lower()
        return word if word in ("at", "dot", "tel", "phone", "call", "fax", "mobile", "card", "visa", "mail", "com", "org", "net") else "a"
    return token


def possible(parts: list[str]) -> list[str]:
    """Kinds that a segment of tokens can be: what the features are worked out for at all."""
    first, last = parts[0], parts[-1]
    if first.isspace() or last.isspace():
        return []
    kinds = []
    n = sum(len(p) for p in parts if p.isascii() and p.isdigit())
    words = [p for p in parts if p[0].isalpha()]
    if last[-1].isdigit() and n >= 4:
        if not words and (first[0].isdigit() or first in "+("):
            if n >= 7:
                kinds.append("phone")
            if n >= 12:
                kinds.append("card")
        if first[0].isdigit() and all(p.lower() == "dot" for p in words) and parts.count(".") + len(words) == 3:
            kinds.append("ip")
    if words and last[-1].isalpha() and first[0].isalnum() and not any("\n" in p for p in parts):
        marks = [k for k, p in enumerate(parts) if p == "@" or p.lower() == "at"]
        if len(marks) == 1 and 0 < marks[0] < len(parts) - 1:
            k, tail = marks[0], parts[marks[0] + 1 :]
            # A written-out at needs brackets or a written-out dot; no sentence ends inside.
            sign = parts[k] == "@" or _written(parts[k - 1], "".join(tail))
            ended = any(p == "." and q.isspace() for p, q in zip(parts, parts[1:]))
            dots = [j for j, p in enumerate(tail) if p == "." or p.lower() == "dot"]
            # One word follows the last dot.
            if sign and not ended and dots and sum(p[0].isalnum() for p in tail[dots[-1] + 1 :]) == 1:
                kinds.append("email")
    return kinds


def features(kind: str, parts: list[str], before: str, after: str) -> list[str]:
    """Features of a whole span of a kind, with the tokens next to it."""
    digits = "".join(p for p in parts if p.isascii() and p.isdigit())
    shape = "".join(_shape(p) for p in parts)
    marks = "".join(sorted({p for p in parts if not p[0].isalnum()}))
    out = [
        "bias", f"shape={shape}" if len(shape) < 40 else "shape=long", f"n={len(digits)}", f"marks={marks}",
        f"first={_shape(parts[0])}", f"last={_shape(parts[-1])}", f"before={_shape(before) if before else '^'}",
        f"after={_shape(after) if after else '$'}", f"tokens={len(parts)}",
        f"closed={parts.count('(') == parts.count(')')}",
        f"groups={'-'.join(str(len(p)) for p in parts if p.isascii() and p.isdigit())}" if len(parts) < 12 else "groups=many",
    ]
    if kind == "phone":
        out.append(f"lead={parts[0] if parts[0] in '+(' else digits[:1] == '0'}")
    if kind == "card":
        out.append(f"luhn={12 <= len(digits) <= 19 and luhn(digits)}")
    if kind == "ip":
        out.append(f"octets={all(len(p) < 4 and int(p) < 256 for p in parts if p.isascii() and p.isdigit())}")
    if kind == "email":
        out += [f"word={p.lower()}" for p in parts[-1:]]
        # The name's parts: words, digits and what stands between them, a written-out dot as a dot.
        mark = next(k for k, p in enumerate(parts) if p == "@" or p.lower() == "at")
        local = "".join("." if p.lower() == "dot" else "w" if p[0].isalpha() else "d" if p[0].isdigit() else p[0] for p in parts[:mark])
        local = local.replace(" . ", ".").rstrip(" ([")
        out += [f"local={local}" if len(local) < 8 else "local=long", f"apart={' ' in local}"]
        out.append(f"spaced={any(p.isspace() for p in parts)},{'dot' in [p.lower() for p in parts]},{'@' in parts}")
    return [f"{kind}|{x}" for x in out]


def _written(before: str, after: str) -> bool:
    """Whether "at" can stand for an at-sign: in brackets, or with a written-out dot after it."""
    return (before in ("(", "[") and after[:1] in (")", "]")) or bool(re.search(r"(?i)\bdot\b", after))


class Model:
    """Weights of features and of neighbouring kinds."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def lattice(self, parts: list[str]) -> list[tuple[int, int, str, list[str]]]:
        """(start, end, kind, features) of all segments; "" is a token outside any span."""
        edges = [(k, k + 1, "", []) for k in range(len(parts))]
        for a in range(len(parts)):
            if parts[a].isspace():
                continue
            for b in range(a + 1, min(len(parts), a + REACH) + 1):
                for kind in possible(parts[a:b]):
                    edges.append((a, b, kind, features(kind, parts[a:b], parts[a - 1] if a else "", parts[b] if b < len(parts) else "")))
        return edges

    def score(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(x, 0.0) for x in names)

    def decode(self, parts: list[str]) -> list[tuple[int, int, str]]:
        """The best segmentation's spans, as token indices."""
        n = len(parts)
        best: list[dict[str, tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
        best[0][""] = (0.0, None)
        by_start: dict[int, list] = {}
        for e in self.lattice(parts):
            by_start.setdefault(e[0], []).append(e)
        get = self.weights.get
        for at in range(n):
            for _, end, kind, names in by_start.get(at, []):
                s = self.score(names)
                value, before = max((v + get(f"next|{k}|{kind}", 0.0), k) for k, (v, _) in best[at].items())
                if kind not in best[end] or value + s > best[end][kind][0]:
                    best[end][kind] = (value + s, (at, before))
        out, at = [], n
        kind = max(best[n], key=lambda k: best[n][k][0]) if best[n] else ""
        while at:
            start, before = best[at][kind][1]
            if kind:
                out.append((start, at, kind))
            at, kind = start, before
        return out[::-1]

    def gradient(self, parts: list[str], gold: set[tuple[int, int, str]]) -> tuple[float, dict[str, float]]:
        """Log-likelihood of the gold spans and its gradient, by forward and backward sums over segments."""
        n = len(parts)
        edges = [(a, b, k, names, self.score(names)) for a, b, k, names in self.lattice(parts)]
        kinds = ["", *KINDS]
        move = {(p, k): self.weights.get(f"next|{p}|{k}", 0.0) for p in kinds for k in kinds}
        lowest = -1e30

        def total(values: list[float]) -> float:
            top = max(values, default=lowest)
            return top if top <= lowest else top + math.log(sum(math.exp(v - top) for v in values))

        ends: dict[tuple[int, str], list] = {}
        starts: dict[int, list] = {}
        for e in edges:
            ends.setdefault((e[1], e[2]), []).append(e)
            starts.setdefault(e[0], []).append(e)
        ahead = {(0, ""): 0.0}
        for at in range(1, n + 1):
            for k in kinds:
                got = [
                    ahead[e[0], p] + move[p, k] + e[4] for e in ends.get((at, k), []) for p in kinds if (e[0], p) in ahead
                ]
                if got:
                    ahead[at, k] = total(got)
        back = {(n, k): 0.0 for k in kinds}
        for at in range(n - 1, -1, -1):
            for p in kinds:
                back[at, p] = total([move[p, e[2]] + e[4] + back[e[1], e[2]] for e in starts.get(at, [])])
        whole = total([v for (at, _), v in ahead.items() if at == n])
        grad: dict[str, float] = {}
        for a, b, k, names, s in edges:
            for p in kinds:
                if (a, p) in ahead:
                    chance = math.exp(ahead[a, p] + move[p, k] + s + back[b, k] - whole)
                    if chance > 1e-9:
                        for x in (*names, f"next|{p}|{k}"):
                            grad[x] = grad.get(x, 0.0) - chance
        known = {(a, b, k): (names, s) for a, b, k, names, s in edges}
        at, before, value = 0, "", 0.0
        inside = {a: (a, b, k) for a, b, k in gold}
        while at < n:
            a, b, k = inside.get(at, (at, at + 1, ""))
            names, s = known[a, b, k]
            value += s + move[before, k]
            for x in (*names, f"next|{before}|{k}"):
                grad[x] = grad.get(x, 0.0) + 1
            at, before = b, k
        return value - whole, grad

    def spans(self, text: str) -> list[Span]:
        """Spans in the whole text: decoded around digits and at-signs."""
        out: list[Span] = []
        for start, stop in regions(text):
            found = tokens(text, start, stop)
            out += [(kind, found[a][1], found[b - 1][2]) for a, b, kind in self.decode([t for t, _, _ in found])]
        return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text that hold all tokens within REACH of a trigger."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if m[0].lower() == "at" and not _written(text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 80]):
            continue
        # Every trigger has its own reach, also one inside the region of another.
        inside = bool(out) and m.start() < out[-1][1]
        # Characters that surely hold REACH tokens of ordinary length; cut at white space.
        stop = max(min(len(text), m.end() + 80), out[-1][1] if inside else 0)
        while stop < len(text) and not text[stop].isspace() and stop - m.end() < 200:
            stop += 1
        if inside:
            out[-1][1] = stop
            continue
        start = max(out[-1][1] if out else 0, m.start() - 60)
        while start > 0 and not text[start - 1].isspace() and m.start() - start < 120:
            start -= 1
        if out and start <= out[-1][1]:
            out[-1][1] = stop
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def forms(rng: random.Random) -> list[tuple[str, str, str]]:
    """(family, kind, text): one form of every family; kind "" is a number or word that is no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "bo", "el", "mi", "ra", "to", "su"]) for _ in range(rng.randint(2, 4)))
    mark = lambda *of: rng.choice(of)
    name = mark(word(), word(), f"{word()}.{word()}", f"{word()}_{word()}", word() + d(2), f"{word()}_{d(1)}")
    host = mark("mail", "post", "example", "site") + mark("", d(1))
    end = mark("com", "org", "net", "de", "fr")
    body = d(mark(14, 15, 15, 15))
    card = next(body + x for x in "0123456789" if luhn(body + x))
    fours = [card[k : k + 4] for k in range(0, len(card), 4)]
    octets = [str(rng.randint(0, 255)) for _ in range(4)]
    code = d(15)
    wrong = next(code + x for x in "0123456789" if not luhn(code + x))
    return [
        ("email plain", "email", f"{name}@{host}.{end}"), ("email plain", "email", f"{name}@{host}.example.{end}"),
        ("email words", "email", f"{name} at {host} dot {end}"), ("email square", "email", f"{name} [at] {host} [dot] {end}"),
        ("email round", "email", f"{name} (at) {host} (dot) {end}"), ("email tight", "email", f"{name}(at){host}.{end}"),
        ("email spaced", "email", f"{name} @ {host}.{end}"), ("email long words", "email", f"{word()} dot {word()} at {host} dot {end}"),
        ("email two dots", "email", f"{name} at {host} dot example dot {end}"), ("email mixed", "email", f"{name}@{host} dot {end}"),
        ("ip plain", "ip", ".".join(octets)), ("ip words", "ip", " dot ".join(octets)),
        ("ip square", "ip", "[.]".join(octets)), ("ip round", "ip", "(.)".join(octets)),
        ("card plain", "card", card), ("card spaces", "card", " ".join(fours)), ("card dashes", "card", "-".join(fours)),
        ("card dots", "card", ".".join(fours)), ("card slashes", "card", "/".join(fours)),
        ("phone one", "phone", f"+1 ({d(3)}) {d(3)}-{d(4)}"), ("phone area", "phone", f"({d(3)}) {d(3)}-{d(4)}"), ("phone area", "phone", f"({d(3)}) {d(3)} {d(4)}"),
        ("phone dashes", "phone", f"{d(3)}-{d(3)}-{d(4)}"), ("phone plus", "phone", f"+{d(2)} {d(3)} {d(3)} {d(4)}"), ("phone dots", "phone", f"{d(3)}.{d(3)}.{d(4)}"),
        ("phone national", "phone", f"0{d(3)} {d(7)}"), ("phone national", "phone", f"0{d(2)} {d(4)} {d(4)}"), ("phone pairs", "phone", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"),
        ("phone slash", "phone", f"0{d(2)}/{d(7)}"), ("phone slash", "phone", f"0{d(3)}/{d(6)}"), ("phone zeros", "phone", f"00{d(2)} {d(3)} {d(7)}"), ("phone bare", "phone", f"0{d(10)}"),
        ("part", "", f"{d(1)}.{d(1)}."), ("version", "", f"{d(1)}.{d(1)}.{d(2)}"), ("date", "", f"20{d(2)}-{d(2)}-{d(2)}"), ("time", "", f"{d(2)}:{d(2)}:{d(2)}"),
        ("number", "", mark("1", "2", "5", "9") + d(rng.randint(0, 17))), ("amount", "", f"{d(2)},{d(3)}.{d(2)}"), ("issue", "", f"#{d(8)}"), ("double", "", f"{d(8)}-{d(8)}"),
        ("longer", "", f"{d(3)}-{d(3)}-{d(4)}-{d(2)}"), ("moment", "", f"{d(2)}.{d(2)}.20{d(2)} {d(2)}"), ("moment", "", f"{d(2)}/{d(2)}/20{d(2)}"), ("range", "", f"{d(4)}-{d(4)}"),
        ("hash", "", "".join(rng.choice("0123456789abcdef") for _ in range(40))), ("key", "", "AKIA" + "".join(rng.choice("ABCDEFGHJK23456789") for _ in range(16))),
        ("secret", "", f"password={d(3)}ab{d(4)}f{d(3)}"), ("octets", "", f"300.{d(3)}.900.{d(2)}"), ("triple", "", f"{d(4)} {d(4)} {mark('1', '2', '7') + d(2)}"),
        ("sentence", "", f"meet at {word()} dot."), ("code", "", wrong), ("isbn", "", f"97{mark('8', '9')}-{d(1)}-{d(3)}-{d(5)}-{d(1)}"),
    ]


def variants(rng: random.Random, families: frozenset[str] | None = None, without: frozenset[str] = frozenset()) -> tuple[str, str]:
    """(kind, text) of a form of the given families (all, if none are given), but for those left out."""
    kind, text = rng.choice([(k, t) for f, k, t in forms(rng) if (families is None or f in families) and f not in without])
    if not kind and len(_digits(text)) == len(text) and luhn(text):
        text = text[:-1] + str((int(text[-1]) + 1) % 10)
    return kind, text


def _aligned(text: str, spans: list[Span]) -> tuple[list[str], set[tuple[int, int, str]]] | None:
    """Tokens and gold segments, or None if a span doesn't stand on token boundaries or isn't possible."""
    found = tokens(text)
    start = {a: k for k, (_, a, _) in enumerate(found)}
    stop = {b: k + 1 for k, (_, _, b) in enumerate(found)}
    gold = set()
    last = 0
    for kind, a, b in spans:
        if a not in start or b not in stop or start[a] < last:
            return None
        seg = start[a], stop[b], kind
        if seg[1] - seg[0] > REACH or kind not in possible([t for t, _, _ in found[seg[0] : seg[1]]]):
            return None
        gold.add(seg)
        last = seg[1]
    return [t for t, _, _ in found], gold


def train(
    windows: list[str], written: int = 1500, passes: int = 3, seed: int = 11, rate: float = 0.3, without: frozenset[str] = frozenset()
) -> Model:
    """Stochastic gradient ascent on the log-likelihood, with a little shrinkage; families of forms can be left out."""
    rng = random.Random(seed)
    words = [w for t in windows for w in t.split() if w.isalpha()][:5000] or ["and", "the", "or", "so", "then", "for"]
    examples = []
    for text in windows:
        ready = _aligned(text, pattern_spans(text))
        if ready:
            examples.append(ready)
    for _ in range(written):
        text, spans = "", []
        for _ in range(rng.randint(1, 2)):
            text += " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice([" ", " ", ": ", "\n"])
            kind, form = variants(rng, without=without)
            if kind:
                spans.append((kind, len(text), len(text) + len(form)))
            text += form + rng.choice([" ", " ", ", ", ". "])
        text += rng.choice(words)
        ready = _aligned(text, spans)
        if ready:
            examples.append(ready)
    model = Model()
    for turn in range(passes):
        rng.shuffle(examples)
        step = rate / (1 + turn)
        for parts, gold in examples:
            for name, g in model.gradient(parts, gold)[1].items():
                w = model.weights.get(name, 0.0)
                model.weights[name] = w + step * (g - 1e-3 * w)
    model.weights = {k: v for k, v in model.weights.items() if abs(v) > 1e-4}
    return model


def windows_of(text: str) -> list[str]:
    out = []
    for kind, a, b in pattern_spans(text)[:SAMPLE_WINDOWS]:
        left = text.find(" ", max(0, a - 40), a)
        right = text.rfind(" ", b, b + 40)
        out.append(text[left + 1 if left >= 0 else max(0, a - 1) : right if right >= 0 else b][: 2 * WINDOW])
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    """A model from at most SAMPLE_DOCS documents, the first with a pattern's mark in the order of a hash of the id.

    Only documents whose hash is below a threshold are looked into, one of each
    id; the threshold rises until enough are found.  So tasks pass on windows of
    a number of documents that doesn't grow with the table.
    """

    @F.arrow_udf("array<string>")
    def windows(rows: pa.Array) -> pa.Array:
        return pa.array([windows_of(t) for t in rows.to_pylist()], pa.list_(pa.string()))

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body")).withColumn("h", F.xxhash64("id"))
    share = CANDIDATES * SAMPLE_DOCS / max(docs.count(), 1)
    while True:
        below = narrow if share >= 1 else narrow.filter(F.col("h") < F.lit(int(share * 2**64) - 2**63))
        marked = below.filter(F.col("body").rlike(r"@|\+[0-9]|[0-9]{12}|[0-9]\.[0-9]+\.[0-9]"))
        one = marked.groupBy("h", "id").agg(F.min("body").alias("body"))
        chosen = one.select("h", "id", windows("body").alias("windows")).orderBy("h", "id").limit(SAMPLE_DOCS).collect()
        if share >= 1 or len(chosen) == SAMPLE_DOCS:
            return train([w for r in chosen for w in r.windows])
        share *= 8


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(text: Column, model: Model) -> Column:
    """Struct of ``base`` and ``spans``, each kind:start:end joined by commas."""
    weights = model.weights

    @F.arrow_udf("struct<base: string, spans: string>")
    def found(rows: pa.Array) -> pa.Array:
        m = Model()
        m.weights = weights
        out = []
        for t in rows.to_pylist():
            if not t or not _TRIGGER.search(t):
                out.append({"base": "", "spans": ""})
                continue
            base = pattern_spans(t)
            more = [s for s in m.spans(t) if all(s[2] <= a or s[1] >= b for _, a, b in base)]
            out.append({"base": told(base), "spans": told(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))))})
        return pa.array(out, pa.struct([("base", pa.string()), ("spans", pa.string())]))

    return found(text)


def personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, spans) for every row."""
    return docs.select(F.col(id_col), find_personal_data(F.col(text), model).alias("found")).select(id_col, "found.*")
