"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read windows of ``WINDOW`` bytes forwards and backwards; a softmax labels
every byte, and a document's probabilities are the mean over all its bytes. Training
runs in numpy on the driver: back-propagation through time with Adam on windows of a
bounded sample of the labelled rows (``docs_per_language`` documents of each language,
chosen by a hash of the id among ids of one row, ``WINDOWS_PER_DOC`` windows of each). Prediction reads
every byte of every text.

Defined results: null text, empty text and text without any letter give ``und`` with
score 0; a null doc_id is kept; repeated rows give repeated results; without a single
labelled row every text is ``und``. Columns other than the id, the text and (for
learning) the language are ignored. NUL bytes, which also pad windows, label nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches

HIDDEN, WINDOW, WINDOWS_PER_DOC, DOCS_PER_LANGUAGE = 8, 64, 4, 400
STEPS, BATCH, RATE, SEED = 150, 128, 0.02, 7
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")  # and some signs that count as numbers, such as superscripts and circled digits


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class ByteGru:
    """Weights of both directions, stacked on the first axis: x (2,256,3H), u (2,H,3H), v (2H,classes), c (classes)."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        self.w = {
            "x": rng.normal(0, 0.5, (2, 256, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(np.float32),
            "v": rng.normal(0, 0.3, (2 * hidden, len(classes))).astype(np.float32),
            "c": np.zeros(len(classes), np.float32),
        }

    def states(self, windows: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(2, T, N, H) states for windows of bytes (N, T); the second direction is stored at the byte that it has read last."""
        n, t = windows.shape
        h, x, u = self.hidden, self.w["x"], self.w["u"]
        out, state = np.empty((2, t, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for i in range(t):
            gates = np.stack([x[0].take(windows[:, i], 0), x[1].take(windows[:, t - 1 - i], 0)])
            rec = state @ u
            zr = _sigmoid(gates[..., : 2 * h] + rec[..., : 2 * h])
            new = np.tanh(gates[..., 2 * h :] + zr[..., h:] * rec[..., 2 * h :])
            before, state = state, new + zr[..., :h] * (state - new)
            out[0, i], out[1, t - 1 - i] = state
            if trace is not None:
                trace.append((before, zr, new, rec[..., 2 * h :]))
        return out

    def probabilities(self, windows: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(T, N, classes) label probabilities of every byte, and the joined states."""
        s = self.states(windows, trace)
        joined = np.concatenate([s[0], s[1]], -1)
        p = joined @ self.w["v"] + self.w["c"]
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(-1, keepdims=True)
        return p, joined

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all bytes that aren't padding, by back-propagation through time."""
        n, t = windows.shape
        h, trace = self.hidden, []
        p, joined = self.probabilities(windows, trace)
        p[:, np.arange(n), labels] -= 1
        mask = (windows.T != 0)[..., None]
        p *= mask / max(1, mask.sum())
        g = {"v": np.einsum("tnh,tnc->hc", joined, p), "c": p.sum((0, 1)), "x": np.zeros_like(self.w["x"]), "u": np.zeros_like(self.w["u"])}
        back = p @ self.w["v"].T
        carry, u_t = np.zeros((2, n, h), np.float32), self.w["u"].transpose(0, 2, 1)
        for i in reversed(range(t)):
            before, zr, new, rec = trace[i]
            z, r = zr[..., :h], zr[..., h:]
            d = carry + np.stack([back[i, :, :h], back[t - 1 - i, :, h:]])
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * rec * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new], -1)
            d_rec = np.concatenate([d_z, d_r, d_new * r], -1)
            g["u"] += before.transpose(0, 2, 1) @ d_rec
            np.add.at(g["x"][0], windows[:, i], d_in[0])
            np.add.at(g["x"][1], windows[:, t - 1 - i], d_in[1])
            carry = d * z + d_rec @ u_t
        return g

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> ByteGru:
        """Adam on batches with as many windows of each class."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.classes))]
        m, s = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by])
            for k, g in self.gradients(windows[pick], labels[pick]).items():
                g = g.astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                now = rate * (1 - 0.9 * step / steps)
                self.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def _label_sums(self, windows: np.ndarray) -> np.ndarray:
        """(N, classes): label probabilities summed over the bytes of each window, zeros (padding) left out.

        The same network as ``probabilities``, with the windows on the last axis and halved gate
        weights (a logistic is a tanh of half its argument), which numpy runs several times faster.
        """
        n, t = windows.shape
        h, half = self.hidden, np.repeat(np.float32([0.5, 0.5, 1]), self.hidden)[:, None]
        x = [np.ascontiguousarray(self.w["x"][d].T * half) for d in range(2)]
        u = [np.ascontiguousarray(self.w["u"][d].T * half) for d in range(2)]
        columns = np.ascontiguousarray(windows.T).astype(np.intp)
        states = np.empty((2, t, h, n), np.float32)
        gates, rec, part = (np.empty((k * h, n), np.float32) for k in (3, 3, 1))
        for d in range(2):
            state = np.zeros((h, n), np.float32)
            for i in range(t) if d == 0 else reversed(range(t)):
                np.take(x[d], columns[i], 1, gates, "clip")
                np.matmul(u[d], state, rec)
                zr, new, rec_new = gates[: 2 * h], gates[2 * h :], rec[2 * h :]
                zr += rec[: 2 * h]
                np.tanh(zr, zr)
                zr *= 0.5
                zr += 0.5
                rec_new *= zr[h:]
                new += rec_new
                np.tanh(new, new)
                np.subtract(state, new, part)
                part *= zr[:h]
                state = np.add(new, part, states[d, i])
        v = np.ascontiguousarray(self.w["v"].T)
        p = v[:, :h] @ states[0] + v[:, h:] @ states[1] + self.w["c"][:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, p)
        p *= ((columns != 0) / p.sum(1))[:, None].astype(np.float32)
        return p.sum(0).T

    def pooled(self, texts: list[bytes], block: int = 1024) -> np.ndarray:
        """(documents, classes): mean label probabilities over all bytes of each text; zeros for an empty one."""
        rows = -(-np.array([len(t) for t in texts], np.int64) // WINDOW)
        owner = np.repeat(np.arange(len(texts)), rows)
        windows = np.frombuffer(b"".join(t.ljust(r * WINDOW, b"\0") for t, r in zip(texts, rows.tolist())), np.uint8).reshape(-1, WINDOW)
        total = np.zeros((len(texts), len(self.classes)))
        for at in range(0, len(windows), block):
            np.add.at(total, owner[at : at + block], self._label_sums(windows[at : at + block]))
        return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def training_windows(docs: DataFrame, learn: Column, docs_per_language: int = DOCS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list:
    """(lang, windows) of a bounded sample of the rows for which ``learn`` holds."""
    usable = learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    ids = docs.where(usable).groupBy(F.col(id_col).alias("k")).agg(F.min(lang_col).alias("l"), F.count("*").alias("rows")).where("rows = 1 and k is not null")
    sizes = ids.groupBy("l").agg(F.count("*").alias("of"))
    # a language's ids below a cut of their hashes, some times as many as wanted, then exactly the first: no task ranks a whole language
    share = F.shiftrightunsigned(F.xxhash64("k"), 1) * 2.0**-63
    near = ids.join(broadcast_if_small(sizes, sizes.count(), 100_000), "l").where(share * F.col("of") < 4 * docs_per_language)
    order = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    ids = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language).select("k")
    spread = WINDOWS_PER_DOC

    def cut(batches):
        for batch in batches:
            for key, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode()
                rng = np.random.default_rng([SEED, len(raw), (hash(key) if isinstance(key, int) else 0) & 0xFFFFFFFF])
                starts = sorted(rng.integers(0, max(1, len(raw) - WINDOW), min(spread, max(1, len(raw) // WINDOW))).tolist())
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b"".join(raw[s : s + WINDOW].ljust(WINDOW, b"\0") for s in starts)], pa.binary())], ["lang", "windows"])

    # at most docs_per_language ids for each language
    few = docs.where(usable).join(F.broadcast(ids), F.col(id_col) == F.col("k"), "left_semi").select(id_col, F.col(lang_col).cast("string"), text_col)
    return few.mapInArrow(cut, "lang string, windows binary").collect()


def train(docs: DataFrame, learn: Column, **names) -> ByteGru | None:
    rows = sorted((r["lang"], bytes(r["windows"])) for r in training_windows(docs, learn, **names))
    rows = [r for r in rows if r[1].strip(b"\0")]
    if not rows:
        return None
    classes = sorted({r[0] for r in rows})
    windows = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    labels = np.repeat([classes.index(r[0]) for r in rows], [len(r[1]) // WINDOW for r in rows])
    return ByteGru(classes).fit(windows, labels)


def predict(spark: SparkSession, docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        net = sent.value
        for batch in batches:
            for part in small_batches(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                real = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
                if real:
                    p = net.pooled([texts[i].encode() for i in real])
                    for i, k, s in zip(real, p.argmax(1).tolist(), p.max(1).tolist()):
                        langs[i], scores[i] = net.classes[k], min(1.0, s)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
