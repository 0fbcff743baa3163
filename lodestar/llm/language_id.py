"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of bytes. Two recurrent passes, one from either end, label every byte of a
window with class probabilities; the mean over all bytes of the text decides. Gates are piecewise
linear, which keeps a step to a few array operations for thousands of windows at once. Training is
back-propagation through time in numpy with Adam, on a bounded sample of labelled windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


WIDTH, HIDDEN = 64, 8
#: Windows that are labelled together.
LANES = 2048
#: Bounds of the training sample: documents of a language, and windows of a document.
DOCS_PER_LANG, WINDOWS_PER_DOC = 400, 6
#: Parts of a language that are ranked before the whole.
PARTS = 16
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(body: bytes) -> bool:
    return bool(_ASCII_LETTER.search(body)) or any(c.isalpha() for c in body.decode("utf-8", "replace"))


class BiGru:
    """Parameters by name; ``f``/``b``: the pass from the left or right end. Arrays are (features, windows)."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h, self.p = hidden, {}
        for d in "fb":
            self.p["e" + d] = (r.normal(size=(3 * hidden, 256)) * 0.5).astype(np.float32)
            self.p["u" + d] = (r.normal(size=(3 * hidden, hidden)) * 0.4).astype(np.float32)
        self.p["w"] = (r.normal(size=(classes, 2 * hidden)) * 0.3).astype(np.float32)
        self.p["c"] = np.zeros((classes, 1), np.float32)

    def states(self, x: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """Hidden states (steps, hidden, windows) of one pass over bytes x (steps, windows)."""
        h, e, u, n = self.h, self.p["e" + d], self.p["u" + d], x.shape[1]
        out, state = np.empty((len(x), h, n), np.float32), np.zeros((h, n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, r = e.take(x[t], axis=1), u @ state
            gates = a[: 2 * h]
            gates += r[: 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            z, reset = gates[:h], gates[h:]
            new = reset * r[2 * h :]
            new += a[2 * h :]
            np.clip(new, -1, 1, out=new)
            if trace is not None:
                trace.append((t, state, z, reset, r[2 * h :], new))
            state = np.subtract(state, new, out=out[t])
            state *= z
            state += new
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, classes, windows)"""
        w, h = self.p["w"], self.h
        s = np.matmul(w[:, :h], self.states(x, "f")) + np.matmul(w[:, h:], self.states(x, "b")) + self.p["c"]
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean cross-entropy over all positions, by back-propagation through time, and the loss."""
        h, w, traces = self.h, self.p["w"], {"f": [], "b": []}
        both = np.concatenate([self.states(x, d, traces[d]) for d in "fb"], axis=1)
        s = np.matmul(w, both) + self.p["c"]
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        n = len(x) * x.shape[1]
        at = np.arange(x.shape[1])
        loss = -float(np.log(p[:, label, at] + 1e-9).mean())
        p[:, label, at] -= 1
        p /= n
        g = {"w": np.einsum("tcn,thn->ch", p, both), "c": p.sum(axis=(0, 2))[:, None]}
        back = np.matmul(w.T, p)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = self.p["u" + d]
            ge, gu = np.zeros_like(self.p["e" + d]), np.zeros_like(u)
            carry = np.zeros((h, x.shape[1]), np.float32)
            for t, state, z, reset, r, new in reversed(traces[d]):
                dh = back[t, part] + carry
                da = np.empty((3 * h, x.shape[1]), np.float32)
                dn = dh * (1 - z) * (np.abs(new) < 1)
                da[2 * h :] = dn
                da[:h] = dh * (state - new) * ((z > 0) & (z < 1)) * 0.25
                da[h : 2 * h] = dn * r * ((reset > 0) & (reset < 1)) * 0.25
                dr = da.copy()
                dr[2 * h :] *= reset
                carry = dh * z + u.T @ dr
                gu += dr @ state.T
                np.add.at(ge.T, x[t], da.T)
            g["e" + d], g["u" + d] = ge, gu
        return g, loss

    def fit(self, x: np.ndarray, label: np.ndarray, steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 11) -> "BiGru":
        """Adam on random batches of windows x (windows, steps)."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for i in range(1, steps + 1):
            at = r.integers(0, len(x), batch)
            g, _ = self.gradients(np.ascontiguousarray(x[at].T), label[at])
            lr = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            for k, a in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                a -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self


def windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows of WIDTH bytes, the last of a text filled with spaces), and how many each text has."""
    counts = np.array([-(-len(b) // WIDTH) for b in bodies], np.int64)
    raw = b"".join(b.lower().ljust(int(n) * WIDTH) for b, n in zip(bodies, counts, strict=True))
    return np.frombuffer(raw, np.uint8).reshape(-1, WIDTH), counts


def classify(net: BiGru, bodies: list[bytes]) -> np.ndarray:
    """Mean class probabilities over all bytes of each text (texts, classes); zero for an empty one."""
    x, counts = windows(bodies)
    per_window = np.zeros((len(x), len(net.p["w"])))
    used = np.full(len(x), WIDTH)
    last = np.cumsum(counts)[counts > 0] - 1
    lengths = np.array([len(b) for b in bodies])
    used[last] = lengths[counts > 0] - (counts[counts > 0] - 1) * WIDTH
    for at in range(0, len(x), LANES):
        p = net.probabilities(np.ascontiguousarray(x[at : at + LANES].T))
        short = np.flatnonzero(used[at : at + LANES] < WIDTH)
        total = p.sum(axis=0)
        if len(short):
            beyond = np.arange(WIDTH)[:, None] >= used[at : at + LANES][short]
            total[:, short] -= (p[:, :, short] * beyond[:, None, :]).sum(axis=0)
        per_window[at : at + LANES] = total.T
    sums = np.zeros((len(bodies), per_window.shape[1]))
    np.add.at(sums, np.repeat(np.arange(len(bodies)), counts), per_window)
    return sums / np.maximum(lengths, 1)[:, None]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5, held: int = 0, docs_per_lang: int = DOCS_PER_LANG) -> tuple[list[str], BiGru | None]:
    """(languages, network) from a sample of labelled documents whose crc32(id) mod ``fold`` is not ``held``.

    The sample takes the ``docs_per_lang`` documents of each language that come first by a hash of the
    id, and up to WINDOWS_PER_DOC windows spread over each whole text.
    """
    body = F.col(text_col).cast("string").cast("binary")
    key = F.col(id_col).cast("long")
    rows = docs.filter(F.col(lang_col).isNotNull() & body.isNotNull() & key.isNotNull() & (F.octet_length(body) > 0) & (F.crc32(key.cast("string").cast("binary")) % fold != held))
    spread = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)), lambda k: F.substring(body, F.floor(F.greatest(F.octet_length(body) - WIDTH, F.lit(0)) * k / (WINDOWS_PER_DOC - 1)).cast("int") + 1, F.lit(WIDTH)))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), key.alias("k"), F.array_distinct(spread).alias("x"))
    order = (F.xxhash64("k"), F.col("k"))
    for part in ([F.pmod(F.xxhash64("k"), F.lit(PARTS))], []):  # by part first, so that few rows of a language meet in one task
        rank = F.row_number().over(Window.partitionBy("lang", *part).orderBy(*order))
        rows = rows.withColumn("rank", rank).filter(F.col("rank") <= docs_per_lang).drop("rank")
    sample = rows.collect()
    sample.sort(key=lambda r: (r.lang, r.k))
    langs = sorted({r.lang for r in sample})
    if not langs:
        return [], None
    of = {lang: i for i, lang in enumerate(langs)}
    x = [(bytes(w).lower().ljust(WIDTH), of[r.lang]) for r in sample for w in r.x]
    x, label = np.frombuffer(b"".join(w for w, _ in x), np.uint8).reshape(-1, WIDTH), np.array([y for _, y in x])
    # languages in equal parts
    most = np.bincount(label).max()
    at = np.concatenate([np.resize(np.flatnonzero(label == k), most) for k in range(len(langs))])
    return langs, BiGru(len(langs)).fit(x[at], label[at])


def predict(docs: DataFrame, langs: list[str], net: BiGru | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs``, then the language and its score as ``names``; only the text decides them."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").cast("binary").alias("__body"))
    schema = StructType([*source.schema.fields[:-1], StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                bodies = [b.as_py() or b"" for b in some.column(some.num_columns - 1)]
                known = [net is not None and has_letter(b) for b in bodies]
                p = classify(net, [b if k else b"" for b, k in zip(bodies, known, strict=True)]) if any(known) else np.zeros((len(bodies), 1))
                best = p.argmax(axis=1)
                lang = pa.array([langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], pa.string())
                score = pa.array(np.where(known, np.minimum(p[np.arange(len(p)), best], 1.0), 0.0), pa.float64())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], lang, score], names=[*some.schema.names[:-1], *names])

    return source.mapInArrow(run, schema).toDF(*keep, *names)


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    ``und`` with score 0 where the text is null, empty or without a letter, or where no labelled row
    was there to learn from. A null id is in no fold. Repeated rows are all labelled. A text of any
    length is labelled whole. Only the named columns are read, so names of others can't clash. Empty
    table: no rows.
    """
    langs, net = train(docs, id_col, text_col, lang_col, fold, held)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False))
    return predict(slim, langs, net, keep=("doc_id",)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


