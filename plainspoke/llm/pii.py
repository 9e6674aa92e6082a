"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (e-mail, IP, card, phone). The field then labels
tokens that could be personal data at all, those with a digit or an ``@``; every
other token can only be background, so it needs no node. Nodes that follow each
other are linked, and so are repeats: tokens equal after trimming, or with the
same seven digits or more, are linked from each occurrence to the next however
far apart, which makes their labels agree throughout a document. Marginals come
from loopy belief propagation over all nodes of a batch at once, repeated for each
text until its messages settle, so that evidence reaches the last of any number of
repeats. A token whose
marginal for a kind is at least ``SURE`` and that touches no base span is added.

The weights are learned by maximum pseudo-likelihood on the base spans of at most
``SAMPLE_ROWS`` documents, chosen by a hash of their id and text, so that the field learns
what the look of a token and its neighbours say about the patterns' verdicts.

Defined results: null and empty texts have no spans. Patterns run in linear time
over whole texts of any length; the links of n repeats are n - 1. If the sample
holds no token to learn from, only base spans are returned. Overlapping base spans
all stay; an added span touches none of them. Repeated rows give repeated results, an
empty table none; no column but the text and the id is read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, lean, table

KINDS = ("email", "ip", "card", "phone")
#: Rows that training may see at most, whole texts.
SAMPLE_ROWS = 2000
SURE, ROUNDS, DAMPING = 0.95, 8, 0.5
#: A text's messages are settled when none changes by so much in a round, looked at every ``ROUNDS`` rounds.
SETTLED = 1e-4

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN, _MARK = re.compile(r"\S+"), re.compile(r"[0-9@]")
_TRIM = "\"'()[]{}<>,;:!?|="

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """The check sum of card numbers: doubled digits count as the sum of their digits."""
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(d * 2 - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses. Each ``@`` ends at most one run of local characters, so the text is read once."""
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            over = m.end()
        else:
            over = max(over, at + 1) if start == at else max(over, start)
        at = text.find("@", max(at + 1, over))


def base_spans(text: str | None) -> list[Span]:
    """(start, end, kind) in code points, by start, then kind as listed in ``KINDS``."""
    if not text:
        return []
    out: list[Span] = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
        out += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


_FEATURES = (
    lambda t, d: True,
    lambda t, d: "@" in t,
    lambda t, d: "@" in t and "." in t.rpartition("@")[2].strip("."),
    lambda t, d: t.startswith("+"),
    lambda t, d: t.startswith("("),
    lambda t, d: t.endswith(")"),
    lambda t, d: "-" in t,
    lambda t, d: t.count(".") == 3,
    lambda t, d: t.count(".") in (1, 2),
    lambda t, d: t.count(".") > 3,
    lambda t, d: any(c.isalpha() for c in t),
    lambda t, d: '"' in t or "=" in t,
    lambda t, d: t.isascii() and t.isdigit(),
    lambda t, d: len(d) == len(t),
    lambda t, d: len(d) == 0,
    lambda t, d: 1 <= len(d) <= 3,
    lambda t, d: 4 <= len(d) <= 6,
    lambda t, d: 7 <= len(d) <= 8,
    lambda t, d: 9 <= len(d) <= 11,
    lambda t, d: 12 <= len(d) <= 15,
    lambda t, d: 16 <= len(d) <= 19,
    lambda t, d: len(d) > 19,
    lambda t, d: 12 <= len(d) <= 19 and luhn(d),
    lambda t, d: len(t) > 24,
)
_K, _O = len(KINDS) + 1, len(KINDS)  # the last label is background


class Nodes:
    """The graph of one text: spans, features, chain links and skip links."""

    def __init__(self, text: str):
        self.spans: list[tuple[int, int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        last: dict[str, int] = {}
        feats = []
        for m in _TOKEN.finditer(text) if _MARK.search(text) else ():
            if not _MARK.search(m[0]):
                continue
            own = m[0].strip(_TRIM) or m[0]
            own = own.rstrip(".") or own
            start = m.start() + m[0].index(own)
            i, digits = len(self.spans), _only_digits(own)
            if i and m.start() - before <= 1:
                self.chain.append((i - 1, i))
            before = m.end()
            self.spans.append((start, start + len(own)))
            feats.append([f(m[0] if k in (3, 4, 5, 11) else own, digits) for k, f in enumerate(_FEATURES)])
            for key in {own.lower(), *([digits] if len(digits) >= 7 else [])}:
                if key in last and (not self.skip or self.skip[-1] != (last[key], i)):
                    self.skip.append((last[key], i))
                last[key] = i
        self.x = np.array(feats, np.float64).reshape(len(feats), len(_FEATURES))

    def labels(self, base: list[Span]) -> np.ndarray:
        """The kind of the base span that covers the middle of each token, else background."""
        y = np.full(len(self.spans), _O)
        for i, (a, b) in enumerate(self.spans):
            mid = (a + b) // 2
            y[i] = next((k for s, e, k in base if s <= mid < e), _O)
        return y


class SkipChain:
    """Weights: w (features, labels), t (label, next label), s (strength of agreement along skip links)."""

    def __init__(self) -> None:
        self.w, self.t, self.s = np.zeros((len(_FEATURES), _K)), np.zeros((_K, _K)), 0.0
        self.loose = np.zeros(0, bool)

    def fit(self, graphs: list[tuple[Nodes, np.ndarray]], steps: int = 300, rate: float = 0.1, ridge: float = 1e-3) -> None:
        """Maximum pseudo-likelihood: each node's label given its neighbours' labels."""
        x = np.concatenate([g.x for g, _ in graphs])
        y = np.concatenate([v for _, v in graphs])
        chain, skip = _links([g for g, _ in graphs])
        eye = np.eye(_K)
        left, right, same = (np.zeros((len(y), _K)) for _ in range(3))
        np.add.at(left, chain[:, 1], eye[y[chain[:, 0]]])
        np.add.at(right, chain[:, 0], eye[y[chain[:, 1]]])
        np.add.at(same, skip[:, 0], eye[y[skip[:, 1]]])
        np.add.at(same, skip[:, 1], eye[y[skip[:, 0]]])
        m = [np.zeros_like(self.w), np.zeros_like(self.t), 0.0]
        v = [np.zeros_like(self.w), np.zeros_like(self.t), 0.0]
        for i in range(1, steps + 1):
            p = _softmax(x @ self.w + left @ self.t + right @ self.t.T + self.s * same)
            d = (p - eye[y]) / len(y)
            grads = [x.T @ d + ridge * self.w, left.T @ d + d.T @ right + ridge * self.t, float((same * d).sum()) + ridge * self.s]
            new = []
            for j, (value, g) in enumerate(zip((self.w, self.t, self.s), grads, strict=True)):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                new.append(value - rate * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.99**i)) + 1e-8))
            self.w, self.t, self.s = new[0], new[1], float(max(0.0, new[2]))

    def marginals(self, graphs: list[Nodes]) -> np.ndarray:
        """Label marginals of all nodes by damped sum-product on the whole graph. ``loose`` says which graphs had not settled at the end."""
        unary = np.concatenate([g.x for g in graphs]) @ self.w
        chain, skip = _links(graphs)
        src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        pair = np.concatenate([np.broadcast_to(q, (n, _K, _K)) for q, n in ((self.t, len(chain)), (self.t.T, len(chain)), (self.s * np.eye(_K), 2 * len(skip)))])
        n, m = len(src), len(chain)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m), np.arange(2 * m + len(skip), n), np.arange(2 * m, 2 * m + len(skip))])
        sizes = np.array([len(g.spans) for g in graphs], np.int64)
        owner, at = np.repeat(np.arange(len(graphs)), sizes), np.arange(len(unary))
        # Evidence takes a round a link, damped two; past that only a graph that swings without end is left.
        most = 100 + 4 * sizes
        msg, belief, rounds = np.zeros((n, _K)), unary.copy(), 0
        self.loose = np.zeros(len(graphs), bool)
        while len(src):
            for _ in range(ROUNDS):
                total = unary.copy()
                np.add.at(total, dst, msg)
                out = (total[src] - msg[back])[:, :, None] + pair
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None]).sum(1))
                new -= new.max(1, keepdims=True)
                old, msg = msg, DAMPING * msg + (1 - DAMPING) * new
            rounds += ROUNDS
            total = unary.copy()
            np.add.at(total, dst, msg)
            belief[at] = total
            change = np.zeros(len(graphs))
            np.maximum.at(change, owner[dst], np.abs(msg - old).max(1))
            going = (change >= SETTLED) & (rounds < most)
            self.loose |= (change >= SETTLED) & ~going
            node, edge = going[owner], going[owner[dst]]
            places, links = np.cumsum(node) - 1, np.cumsum(edge) - 1
            src, dst, back = places[src[edge]], places[dst[edge]], links[back[edge]]
            unary, owner, at, pair, msg = unary[node], owner[node], at[node], pair[edge], msg[edge]
        return _softmax(belief)


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _links(graphs: list[Nodes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(g.spans) for g in graphs)])
    return tuple(np.array([(a + o, b + o) for g, o in zip(graphs, starts, strict=False) for a, b in getattr(g, kind)], np.int64).reshape(-1, 2) for kind in ("chain", "skip"))


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _touches(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    i = bisect.bisect_left(taken[0], b)
    return i > 0 and taken[1][i - 1] > a


def spans_of(texts: list[str | None], field: SkipChain | None, loose: set[int] | None = None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. ``loose`` is given the texts whose messages had not settled."""
    base = [base_spans(t) for t in texts]
    out = [(b, b) for b in base]
    graphs = [(i, g) for i, t in enumerate(texts) if field and t and (g := Nodes(t)).spans]
    if not graphs:
        return out
    prob, at = field.marginals([g for _, g in graphs]), 0
    if loose is not None:
        loose.update(i for (i, _), x in zip(graphs, field.loose, strict=True) if x)
    for i, g in graphs:
        own, at = prob[at : at + len(g.spans)], at + len(g.spans)
        near, taken = dict(g.chain), _merged(base[i])
        added: list[Span] = []
        open_ = -1
        for j, ((a, b), p) in enumerate(zip(g.spans, own, strict=True)):
            k = int(p[:_O].argmax())
            if p[k] < SURE or _touches(taken, a, b):
                continue
            if added and open_ == j - 1 and near.get(j - 1) == j and added[-1][2] == k and len(_only_digits(texts[i][added[-1][0] : b])) <= 19:
                added[-1] = (added[-1][0], b, k)
            else:
                added.append((a, b, k))
            open_ = j
        if added:
            out[i] = (base[i], sorted(base[i] + added, key=lambda s: (s[0], s[2])))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def train(docs: DataFrame, text: str = "text", order: str = "doc_id", rows: int = SAMPLE_ROWS) -> SkipChain | None:
    """A field fitted on at most ``rows`` documents that hold a digit or an ``@``; None if there are none. Their texts are read whole."""
    some = docs.where(F.col(text).rlike("[0-9@]"))
    got = bounded_sample(some, rows, [order, text], F.col(text).alias("t"))
    graphs = [(g, g.labels(base_spans(r.t))) for r in got if (g := Nodes(r.t)).spans]
    if not graphs:
        return None
    field = SkipChain()
    field.fit(graphs)
    return field


def found(field: SkipChain | None, text: Column) -> Column:
    """Struct (base, spans, settled) of a text column: arrays of (kind, start, end), end exclusive, in code points, and whether the field's messages settled."""
    one = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {one}, spans {one}, settled boolean")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in lean(batches):
            loose: set[int] = set()
            own = spans_of([t if isinstance(t, str) else None for t in texts], field, loose)
            rows = [[*([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in part] for part in pair), i not in loose] for i, pair in enumerate(own)]
            yield pd.DataFrame(rows, columns=["base", "spans", "settled"])

    return look(text)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(field: SkipChain | None, text: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced together, named by the first."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in lean(batches):
            out = []
            for t, (_, spans) in zip(texts, spans_of([t if isinstance(t, str) else None for t in texts], field), strict=True):
                if not spans:
                    out.append(t)
                    continue
                parts, at = [], 0
                for a, b, k in spans:
                    if a >= at:
                        parts += [t[at:a], f"<{KINDS[k].upper()}>"]
                    at = max(at, b)
                out.append("".join(parts) + t[at:])
            yield pd.Series(out, dtype=object)

    return mask(text)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    got = docs.select("doc_id", found(train(docs), F.col("text")).alias("_f")).select("doc_id", F.col("_f.base").alias("b"), F.col("_f.spans").alias("s"), "_f.settled")
    counts = [F.size(F.filter("b", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select("doc_id", *counts, F.sha2(digest(F.col("b")), 256).alias("base_sha256"), digest(F.col("s")).alias("spans"), F.size("s").cast("long").alias("n_spans"), "settled")
