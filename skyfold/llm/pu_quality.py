"""Document quality by positive-unlabelled learning.

A small network is trained to minimise the non-negative unbiased PU risk: trusted positives are labelled rows of the training folds with quality 1, unlabelled rows
are a seeded sample of the same folds' documents, and the class prior is estimated from the score distributions of the two on rows that the rough network has not seen (best-bin
estimate). Inputs are statistics of the whole text (bytes, words, lines); labels, language, source and doc_id are never inputs. Labelled negatives are not used at all.

The fit sees some ``max_rows`` positives and unlabelled documents each, one row for each doc_id; every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

MAX_ROWS = 20_000
FOLDS = 5
HIDDEN, EPOCHS = 24, 60
NOT_LINE = np.ones(256, bool)
NOT_LINE[0x0A] = False
_UPPER, _LOWER, _DIGIT, _SPACE = (np.isin(np.arange(256), list(r)) for r in (range(65, 91), range(97, 123), range(48, 58), [32, 9, 11, 12, 13]))
_HIGH = np.arange(256) >= 128
_PUNCT = [33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 58, 59, 60, 61, 62, 63, 64, 91, 92, 93, 95, 96, 123, 124, 125, 126]
_WORDY = tk.ALNUM | _UPPER


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document, how many hashes differ, and the share of the most frequent one."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    distinct, most = np.zeros(len(n)), np.zeros(len(n))
    if len(hashes):
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(h)])
        distinct = np.bincount(d[at], minlength=len(n)).astype(float)
        np.maximum.at(most, d[at], size)
    return distinct / np.maximum(n, 1), most / np.maximum(n, 1)


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.float64)]
    return total[first[1:]] - total[first[:-1]]


def features_of(words: tk.Words, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each document of a chunk."""
    data, n_docs = words.data, len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), size)
    hist = np.bincount((doc << 8) | data, minlength=n_docs << 8).reshape(n_docs, 256).astype(float)
    total = np.maximum(size, 1).astype(float)[:, None]
    cols = [hist[:, m].sum(1) for m in (_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH)] + [hist[:, 10]] + [hist[:, b] for b in _PUNCT]
    share = np.stack(cols, 1) / total
    p = hist / total
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    n_words = np.diff(words.first)
    w = np.maximum(n_words, 1)
    length = (words.ends - words.starts).astype(float)
    h = tk.word_hashes(words)
    doc_w = words.doc_of()
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc_w[1:] == doc_w[:-1])
    pair = tk.mixed(h ^ (np.r_[h[1:], h[:1]] * tk.U(3))) if len(h) else h
    last, head = _WORDY[data[words.ends - 1]], _WORDY[data[words.starts]]
    caps = _UPPER[data[words.starts]] & _UPPER[data[words.ends - 1]]
    distinct, most = _distinct(h, words.first)
    distinct2, _ = _distinct(pair, words.first)
    lines = tk.words_of(data, offsets, NOT_LINE)
    n_lines = np.diff(lines.first)
    line_len = (lines.ends - lines.starts).astype(float)
    line_distinct, line_most = _distinct(tk.word_hashes(lines), lines.first)
    extra = [
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), entropy,
        _sum(length, words.first) / w, np.sqrt(np.maximum(0, _sum(length**2, words.first) / w - (_sum(length, words.first) / w) ** 2)),
        _sum(length <= 2, words.first) / w, _sum(length > 14, words.first) / w, _sum(same, words.first) / w,
        _sum(~last, words.first) / w, _sum(~head & ~last, words.first) / w, _sum(caps, words.first) / w,
        distinct, most, distinct2, line_distinct, line_most, np.log1p(_sum(line_len, lines.first) / np.maximum(n_lines, 1)),
        (n_words == 0).astype(float),
    ]
    return np.concatenate([np.sqrt(share), np.stack(extra, 1)], 1)


def features(column: pa.Array) -> np.ndarray:
    """Statistics of each text; a null is an empty text."""
    data, offsets = tk.buffers(column)
    out = []
    for words in tk.chunks(column, tk.SPACED, lower=False, size=1 << 20):
        at = offsets[words.row : words.row + len(words.first)]
        out.append(features_of(words, at - at[0]))
    return np.concatenate(out) if out else np.zeros((0, 0))


@dataclass
class Model:
    """A network of one hidden layer over standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -35, 35)))


def best_bin_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Ratio of the unlabelled to the positive upper tail, over the tail in which its upper confidence bound is least; both hold scores of rows that the network has not seen."""
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.95, 96)))
    tail_p, tail_u = (1 - np.searchsorted(np.sort(x), cuts) / len(x) for x in (p, u))
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((tail_u + (1 + gamma) * slack) / tail_p))
    return float(np.clip(tail_u[best] / tail_p[best], 0.02, 0.98))


def estimated_prior(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, hidden: int, epochs: int, seed: int) -> float:
    """The class prior by two networks, each judged on the half of the rows that the other was trained on."""
    half = np.random.default_rng(seed).permutation(len(x)) % 2
    found = []
    for k in (0, 1):
        own, other = half == k, half != k
        if min((own & positive).sum(), (own & unlabelled).sum(), (other & positive).sum(), (other & unlabelled).sum()) == 0:
            continue
        rough = train(x[own & positive], x[own & unlabelled], 0.5, hidden, epochs, seed)
        found.append(best_bin_prior(rough.logit(x[other & positive]), rough.logit(x[other & unlabelled])))
    return float(np.mean(found)) if found else 0.5


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 42) -> Model:
    """Minimise the non-negative PU risk with the logistic loss by Adam."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    n = xp.shape[1]
    par = [rng.normal(0, 1 / np.sqrt(n), (n, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(prior / (1 - prior)))]
    m1, m2, t = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    batch = 512
    steps = max(1, min(200, max(len(xp), len(xu)) // batch))
    for epoch in range(epochs):
        rate = 0.01 * (0.1 + 0.9 * (1 - epoch / epochs))
        for _ in range(steps):
            a, b = xp[rng.integers(0, len(xp), batch)], xu[rng.integers(0, len(xu), batch)]
            x = np.concatenate([a, b])
            z = np.tanh(x @ par[0] + par[1])
            s = 1 / (1 + np.exp(-np.clip(z @ par[2] + par[3], -35, 35)))
            sp, su = s[:batch], s[batch:]
            # losses: -log s for positive, -log(1 - s) for negative
            negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            g = np.concatenate([-prior * (1 - sp), np.zeros(batch)]) / batch
            part = np.concatenate([-prior * sp, su]) / batch
            g = g + part if negative >= 0 else -part  # a negative estimate is undone, not followed
            grad_z = g[:, None] * par[2] * (1 - z**2)
            grads = [x.T @ grad_z + 1e-4 * par[0], grad_z.sum(0), z.T @ g + 1e-4 * par[2], g.sum()]
            t += 1
            for i, gr in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * gr
                m2[i] = 0.999 * m2[i] + 0.001 * gr**2
                par[i] = par[i] - rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, par[0], par[1], par[2], float(par[3]), prior=prior)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit_rows(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, seed: int = 42) -> Model | None:
    """The network of given rows; None without a positive or an unlabelled one."""
    if not positive.any() or not unlabelled.any():
        return None
    order = np.lexsort((*x.T[:6], positive, unlabelled))  # the fit does not depend on the order in which tasks end
    x, positive, unlabelled = x[order], positive[order], unlabelled[order]
    prior = estimated_prior(x, positive, unlabelled, HIDDEN, EPOCHS // 3, seed)
    return train(x[positive], x[unlabelled], prior, seed=seed)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 42) -> Model | None:
    """Train on folds 1 to 4; None where they hold no positive label or no text.

    At most ``max_rows`` labelled ids count, and a hash of doc_id draws about as many unlabelled ones. Of rows with one doc_id the one with the least text checksum stands for
    all, within each task before it is sent, so that an id that a third of all rows share is one row for each task.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality = 1")
    ids = ids.filter(fold(F.col("doc_id")) != 0).select("doc_id").distinct()
    picked = ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows).withColumn("known", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    n = rows.agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).first()["n"]
    share = min(1.0, max_rows / max(n, 1))
    sampled = (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) & (fold(F.col("doc_id")) != 0)
    # at most max_rows pairs of numbers (under 1 MB) are sent to all tasks
    near = rows.join(F.broadcast(picked), "doc_id", "left").withColumn("u", sampled).withColumn("known", F.coalesce("known", F.lit(False))).filter("known OR u")
    near = near.select("doc_id", "known", "u", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            fresh = []
            for i, (key, crc) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("crc").to_pylist())):
                if key not in best or crc < best[key]:
                    best[key] = crc
                    fresh.append(i)
            if fresh:
                part = batch.take(pa.array(fresh, pa.int32()))
                x = features(part.column("text")).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "known", "u", "crc")), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "known", "u", "crc", "x"])

    one = near.mapInArrow(of, "doc_id long, known boolean, u boolean, crc long, x binary").groupBy("doc_id", "known", "u").agg(F.min(F.struct("crc", "x")).alias("m"))
    got = one.select("known", "u", F.col("m.x").alias("x")).collect()
    if not got:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(np.float64)
    return fit_rows(x, np.array([r["known"] for r in got]), np.array([r["u"] for r in got]), seed)


def score(docs: DataFrame, labels: DataFrame, accept: float = 0.3, max_rows: int = MAX_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, held_out, score (0 to 1) and predicted (1 if score is ``accept`` or more) for each row of ``docs``.

    A null text counts as empty and is scored like any other; a null doc_id is held out. Only labels 1 are used; a document with several labels counts as one if any of them is 1.
    Without a positive label or any text to train on, every score is 0.5. Repeated rows give repeated results, an empty table an empty one.
    """
    model = fit(docs, labels, max_rows)
    # a kept text is the scored one, and goes to Python once
    names = {c: "text" if c == "text" and dict(docs.dtypes)[c] == "string" else f"__keep{i}" for i, c in enumerate(keep)}
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if n != "text"], F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.full(batch.num_rows, 0.5) if model is None or not batch.num_rows else model.score(features(batch.column("text")))
            stay = [n for n in batch.schema.names if n != "text" or "text" in names.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in stay), pa.array(got, pa.float64())], [*stay, "score"])

    fields = ", ".join([*(f"`{n}` {t}" for n, t in out.dtypes if n != "text" or "text" in names.values()), "score double"])
    scored = out.mapInArrow(of, fields)
    return scored.select(*[F.col(n).alias(c) for c, n in names.items()], "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns.

    Null and empty texts are scored as empty ones. Repeated rows stay or go together, whatever their doc_id; without a positive label all rows stay. An empty table gives an empty result.
    """
    names = docs.columns
    got = score(docs, labels, accept, keep=tuple(names))
    return got.toDF(*names, "__held", "__score", "__ok").filter("__ok = 1").select(*names)
