"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read every UTF-8 byte of a text, one in each direction; a softmax on
their joined states labels every byte position, and a document's probability of
a language is the mean over its positions. The network is trained in numpy by
backpropagation through time on a bounded sample of labelled rows.

Texts are read whole: they are cut into windows of ``WINDOW`` bytes that run
side by side through the network, each with ``MARGIN`` bytes of its neighbours
on both sides to warm the states up, and every byte of the text is labelled in
exactly one window. Memory does not depend on the length of a text.

Defined results: null texts and texts without a letter (of any script; digits,
fractions and numerals such as "½" or "Ⅷ" are none) give ``und`` with score 0; if
there is nothing to learn from, every text gives ``und``. Of languages that are
equally probable, the first in order of name is given. Repeated rows give
repeated results, an empty table none; extra columns are never read. Rows without
a language or an id can be predicted, and the former are never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, lean, table

#: Rows that training may see at most, whole texts, and bytes of a window that it draws from them.
SAMPLE_ROWS, TRAIN_BYTES = 3000, 72
WINDOW, MARGIN = 192, 8
HIDDEN, STEPS, BATCH = 8, 300, 160
UND = "und"
_LETTER = regex.compile(r"\p{L}")


def _step(x: np.ndarray, h: np.ndarray, u_rz: np.ndarray, u_n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One GRU step. x: input projections (n, 3H). Sigmoids are written with tanh, which numpy vectorises."""
    k = h.shape[1]
    rz = np.tanh((x[:, : 2 * k] + h @ u_rz) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
    r, z = rz[:, :k], rz[:, k:]
    n = np.tanh(x[:, 2 * k :] + (r * h) @ u_n)
    return r, z, n, n + z * (h - n)


class ByteGru:
    """Parameters and passes. ``p`` maps names to float32 arrays, for each direction e (256, 3H), u (H, 2H), v (H, H); and w (2H, C), b (C)."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng, c = np.random.default_rng(seed), len(languages)
        self.languages, self.hidden = languages, hidden
        self.p = {f"{n}{d}": rng.normal(0, s, shape).astype(np.float32) for d in "fb" for n, s, shape in (("e", 0.3, (256, 3 * hidden)), ("u", 0.3, (hidden, 2 * hidden)), ("v", 0.3, (hidden, hidden)))}
        self.p |= {"w": rng.normal(0, 0.3, (2 * hidden, c)).astype(np.float32), "b": np.zeros(c, np.float32)}

    def _read(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (L, n, H) of direction d over bytes x (L, n), in order of position."""
        e, u, v = (self.p[k + d] for k in "euv")
        h = np.zeros((x.shape[1], self.hidden), np.float32)
        out, seen = np.empty((*x.shape, self.hidden), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            r, z, n, new = _step(e[x[t]], h, u, v)
            if keep:
                seen.append((t, h, r, z, n))
            h = out[t] = new
        return out, seen

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """States (L, H, n) of direction d without what training needs: rows of states, so that every operation runs over contiguous memory."""
        k, n = self.hidden, x.shape[1]
        e, u, v = (np.ascontiguousarray(self.p[name + d].T) for name in "euv")
        u *= np.float32(0.5)  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
        e[: 2 * k] *= np.float32(0.5)
        out = np.empty((len(x), k, n), np.float32)
        h, g, a, c, m = (np.zeros((rows, n), np.float32) for rows in (k, 3 * k, 2 * k, k, k))
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(e, x[t], axis=1, out=g, mode="clip")
            np.dot(u, h, out=a)
            a += g[: 2 * k]
            np.tanh(a, out=a)
            a += 1
            a *= 0.5
            np.multiply(a[:k], h, out=m)
            np.dot(v, m, out=c)
            c += g[2 * k :]
            np.tanh(c, out=c)
            np.subtract(h, c, out=m)
            m *= a[k:]
            h = np.add(c, m, out=out[t])
        return out

    def positions(self, x: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """Probabilities (C, n) of every position of bytes x (L, n), in order, times counts (L, n)."""
        k, b = self.hidden, self.p["b"][:, None]
        wf, wb = (np.ascontiguousarray(part.T) for part in (self.p["w"][:k], self.p["w"][k:]))
        p, q, total = (np.empty((rows, x.shape[1]), np.float32) for rows in (len(wf), len(wf), 1))
        for f, r, n in zip(self._states(x, "f"), self._states(x, "b"), counts, strict=True):
            np.dot(wf, f, out=p)
            np.dot(wb, r, out=q)
            p += q
            p += b
            np.clip(p, -60, 60, out=p)
            np.exp(p, out=p)
            np.sum(p, 0, out=total[0])
            np.divide(n, total[0], out=total[0])
            p *= total
            yield p

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        k, w = self.hidden, self.p["w"]
        (hf, sf), (hb, sb) = self._read(x, "f", True), self._read(x, "b", True)
        both = np.concatenate([hf, hb], -1)
        logits = both @ w + self.p["b"]
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        n = x.size
        at = np.arange(len(y))
        loss = -float(np.log(prob[:, at, y] + 1e-9).mean())
        prob[:, at, y] -= 1
        prob /= n
        g = {"w": np.einsum("lnh,lnc->hc", both, prob), "b": prob.sum((0, 1))}
        back = prob @ w.T
        for d, seen, dh_out in (("f", sf, back[..., :k]), ("b", sb, back[..., k:])):
            u, v = self.p["u" + d], self.p["v" + d]
            gu, gv, gx = np.zeros_like(u), np.zeros_like(v), np.empty((*x.shape, 3 * k), np.float32)
            carry = np.zeros_like(dh_out[0])
            for t, h, r, z, m in reversed(seen):
                dh = carry + dh_out[t]
                dm = dh * (1 - z) * (1 - m * m)
                d_rh = dm @ v.T
                dz = dh * (h - m) * z * (1 - z)
                dr = d_rh * h * r * (1 - r)
                d_rz = np.concatenate([dr, dz], 1)
                gv += (r * h).T @ dm
                gu += h.T @ d_rz
                gx[t, :, : 2 * k], gx[t, :, 2 * k :] = d_rz, dm
                carry = dh * z + d_rh * r + d_rz @ u.T
            ge, order = np.zeros_like(self.p["e" + d]), np.argsort(x, axis=None, kind="stable")
            of, first = np.unique(x.ravel()[order], return_index=True)
            ge[of] = np.add.reduceat(gx.reshape(n, -1)[order], first, axis=0)
            g |= {"e" + d: ge, "u" + d: gu, "v" + d: gv}
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam on windows x (n, L) of languages y (n). Returns the losses."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        losses = []
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            loss, g = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((a * a).sum() for a in g.values())))))
            lr = rate * (1 - 0.9 * i / steps)
            for k, a in g.items():
                a = a * np.float32(scale)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def documents(self, raws: list[bytes], group: int = 2048) -> np.ndarray:
        """Pooled probabilities (documents, C); zeros for empty texts."""
        total, n = np.zeros((len(raws), len(self.languages))), np.zeros(len(raws))
        queue: list[tuple[int, bytes, int, int]] = []
        for i, raw in enumerate(raws):
            for at in range(0, len(raw), WINDOW):
                lo = max(0, at - MARGIN)
                queue.append((i, raw[lo : at + WINDOW + MARGIN], at - lo, min(WINDOW, len(raw) - at)))
                if len(queue) == group:
                    self._pool(queue, total, n)
                    queue.clear()
        if queue:
            self._pool(queue, total, n)
        return total / np.maximum(n, 1)[:, None]

    def _pool(self, queue: list, total: np.ndarray, n: np.ndarray) -> None:
        width = max(len(part) for _, part, _, _ in queue)
        x = np.frombuffer(b"".join(part.ljust(width, b" ") for _, part, _, _ in queue), np.uint8).reshape(len(queue), width)
        doc, skip, own = (np.array([q[k] for q in queue]) for k in (0, 2, 3))
        pooled = np.zeros((len(self.languages), len(queue)), np.float32)
        t = np.arange(width)[:, None]
        for p in self.positions(np.ascontiguousarray(x.T), ((t >= skip) & (t < skip + own)).astype(np.float32)):
            pooled += p
        np.add.at(total, doc, pooled.T)
        np.add.at(n, doc, own)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", rows: int = SAMPLE_ROWS) -> ByteGru | None:
    """A network fitted on at most ``rows`` labelled rows, chosen by a hash of ``order`` and text; None without labelled text.

    The chosen texts come to the driver whole, so the sample is bounded in rows alone.
    Training draws its windows from all places of all of them.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    got = bounded_sample(known, rows, [order, text], F.col(text).alias("t"), F.col(lang).alias("lang"))
    pairs = [(raw, r.lang) for r in got if len(raw := r.t.encode("utf-8", "replace")) >= 24]
    if not pairs:
        return None
    languages = sorted({b for _, b in pairs})
    net = ByteGru(languages)
    if len(languages) > 1:
        net.fit(*windows([raw for raw, _ in pairs], np.array([languages.index(b) for _, b in pairs]), STEPS * BATCH))
    return net


def windows(raws: list[bytes], y: np.ndarray, most: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``most`` windows of ``TRAIN_BYTES`` (n, L) and their languages: texts in turn, each time at a random place of the whole text."""
    rng = np.random.default_rng(seed)
    of = np.arange(most) % len(raws)
    spare = np.array([max(0, len(r) - TRAIN_BYTES) for r in raws])[of]
    at = (rng.random(most) * (spare + 1)).astype(np.int64)
    joined = b"".join(raws[i][a : a + TRAIN_BYTES].ljust(TRAIN_BYTES, b" ") for i, a in zip(of.tolist(), at.tolist(), strict=True))
    return np.frombuffer(joined, np.uint8).reshape(most, TRAIN_BYTES), y[of]


def predict(net: ByteGru | None, text: Column) -> Column:
    """Struct (lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in lean(batches):
            some = [bool(isinstance(t, str) and net and _LETTER.search(t)) for t in texts]
            raws = [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, some, strict=True)]
            if not net:
                yield pd.DataFrame({"lang_pred": [UND] * len(texts), "score": 0.0})
                continue
            prob = net.documents(raws)
            best = prob.argmax(1) if len(raws) else np.zeros(0, int)
            yield pd.DataFrame({"lang_pred": [net.languages[b] if ok else UND for b, ok in zip(best, some, strict=True)], "score": np.where(some, np.clip(prob.max(1, initial=0), 0, 1), 0.0)})

    return label(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents kept from training: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; learns from the rows that are not held out."""
    net = train(docs.where(~held_out(doc_id)), text, lang, doc_id)
    return docs.select(doc_id, held_out(doc_id).alias("held_out"), predict(net, F.col(text)).alias("_p")).select(doc_id, "held_out", "_p.lang_pred", "_p.score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
