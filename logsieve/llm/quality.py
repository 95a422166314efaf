"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows that labels mark 1; the unlabelled text is a sample of all training
documents, whatever their labels. The class prior is estimated from scores alone: a first model that tells
positives from unlabelled text orders both, and the least ratio of their upper tails (best bin) is the share of
positives in the unlabelled text. A small network on text statistics is then fitted to the non-negative
unbiased risk: prior x R+(P) + max(0, R-(U) - prior x R-(P)), stepping back where the bracket goes below zero.

Statistics come from the whole text alone: no label, language, source or id. Fitting reads at most POSITIVES
and UNLABELLED rows (bounds on the sample, as parameters of ``fit``); scoring reads every row.

Defined results: null text counts as empty and has a score; without positives or without text to learn from
every score is 0.5; repeated rows score alike. Other columns are never read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import cut, release
from logsieve.llm.folds import held_out, labelled

POSITIVES, UNLABELLED = 8000, 16000
HIDDEN = 24
_MARKS = "!|*%&$#@.,;:?-_()/\"'<>=+"
N_FEATURES = 16 + len(_MARKS)


def features(text: str | None) -> list[float]:
    """Statistics of a text, all bounded or logarithmic."""
    text = text or ""
    n = len(text)
    words, lines = text.split(), text.split("\n")
    w, k = max(1, len(words)), max(1, n)
    counts = Counter(words)
    low = text.lower()
    upper = sum(map(operator.ne, text, low)) if len(low) == n else sum(map(str.isupper, text))
    seen = Counter(lines)
    first = [
        np.log1p(n), np.log1p(len(words)), len(counts) / w, max(counts.values(), default=0) / w,
        sum(map(operator.eq, words, words[1:])) / w, sum(map(operator.eq, words, words[2:])) / w,
        upper / k, sum(map(text.count, "0123456789")) / k, text.count(" ") / k, text.count("\n") / k,
        len(seen) / max(1, len(lines)), sum(len(x) * (c - 1) for x, c in seen.items()) / k, sum(map(len, words)) / w / 10,
        max(map(len, words), default=0) / 100 if n else 0, np.log1p(w / max(1, text.count(".") + text.count("!") + text.count("?"))), float(not words),
    ]
    first[13] = min(1.0, first[13])
    return [*first, *(min(1.0, 10 * text.count(m) / k) for m in _MARKS)]


class Model:
    """A network of one hidden layer over standardised features."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = [r.normal(0, 0.3, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.blank = True

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def raw(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3], h

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.blank else _sigmoid(self.raw(self.standard(x))[0])

    def gradients(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = g[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """Share of positives in the unlabelled scores: the least ratio of upper tails, over tails that hold at least ``least`` of the positives, with a margin for their sampling error."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 60))
    above = lambda x: (x[None, :] >= cuts[:, None]).mean(1)
    p, u = above(positive), above(unlabelled)
    margin = np.sqrt(np.log(20) / (2 * len(positive))) + np.sqrt(np.log(20) / (2 * len(unlabelled)))
    best = int(np.argmin((u + margin) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def _train(model: Model, zp: np.ndarray, zu: np.ndarray, prior: float | None, epochs: int, seed: int, rate: float = 0.01, decay: float = 1e-4) -> None:
    """Adam on the non-negative risk with logistic losses; without a prior, on telling positives from unlabelled rows."""
    r = np.random.default_rng(seed)
    m, v, t = [np.zeros_like(a) for a in model.p], [np.zeros_like(a) for a in model.p], 0
    steps = max(1, min(60, (len(zp) + len(zu)) // 512))
    for epoch in range(epochs):
        order_p, order_u = np.array_split(r.permutation(len(zp)), steps), np.array_split(r.permutation(len(zu)), steps)
        for ip, iu in zip(order_p, order_u, strict=True):
            if not len(ip) or not len(iu):
                continue
            (fp, hp), (fu, hu) = model.raw(zp[ip]), model.raw(zu[iu])
            sp, su = _sigmoid(fp), _sigmoid(fu)
            if prior is None:
                gp, gu = (sp - 1) / len(ip) / 2, su / len(iu) / 2
            else:
                rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                if rest >= 0:
                    gp, gu = prior * ((sp - 1) - sp) / len(ip), su / len(iu)
                else:  # step back on the part that went below zero
                    gp, gu = prior * sp / len(ip), -su / len(iu)
            grads = [a + b + decay * w for a, b, w in zip(model.gradients(zp[ip], hp, gp), model.gradients(zu[iu], hu, gu), model.p, strict=True)]
            t += 1
            step = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                model.p[i] = model.p[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, epochs: int = 60, seed: int = 0) -> tuple[Model, float]:
    """A model from feature rows of trusted positives and of unlabelled text; the prior it used."""
    model = Model(seed)
    if len(positive) < 2 or len(unlabelled) < 2:
        return model, 0.5
    both = np.concatenate([positive, unlabelled])
    model.mean, model.scale, model.blank = both.mean(0), both.std(0) + 1e-3, False
    zp, zu = model.standard(positive), model.standard(unlabelled)
    if prior is None:
        half = (np.arange(len(zp)) % 2 == 0, np.arange(len(zu)) % 2 == 0)
        first = Model(seed + 1)
        _train(first, zp[half[0]], zu[half[1]], None, epochs // 2, seed + 1)
        prior = best_bin_prior(first.raw(zp[~half[0]])[0], first.raw(zu[~half[1]])[0])
    _train(model, zp, zu, prior, epochs, seed)
    return model, prior


_FEATURES = "label int, row long, x array<double>"


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), b.column("row"), pa.array(x, pa.list_(pa.float64()))], ["label", "row", "x"])
    release()


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> tuple[Model, float]:
    """A model from training rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    At most ``positives`` trusted and ``unlabelled`` other texts count, those with the smallest hashes of doc_id and
    text, and only their features reach the driver. Rows of one doc_id with several texts count each, rows that
    repeat both count once.
    """
    chosen = labelled(labels, "quality", positives).where("label = 1")
    n = docs.count()
    share = min(1.0, 1.25 * unlabelled / max(1, n))
    rows = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text", F.lit(7)))
    rows = rows.withColumn("lot", F.pmod("row", F.lit(1 << 30)) < int(share * (1 << 30))).join(F.broadcast(chosen), "doc_id", "left").where("lot OR label = 1")
    each = rows.withColumn("label", F.explode(F.filter(F.array(F.when(F.col("lot"), F.lit(0)), F.when(F.col("label") == 1, F.lit(1))), lambda c: c.isNotNull())))
    # which rows count is settled on their hashes, before any text is read for its features
    first = lambda k, most: each.where(F.col("label") == k).select("label", "row").distinct().orderBy("row").limit(most)
    picked = cut(first(0, unlabelled).unionByName(first(1, positives)), "quality-sample")
    found = each.join(F.broadcast(picked), ["label", "row"]).select("label", "row", "text").mapInArrow(_featurise, _FEATURES).dropDuplicates(["label", "row"]).toPandas()
    x = np.array(found["x"].tolist(), float).reshape(-1, N_FEATURES)
    x, y = x[np.lexsort(x.T)], found["label"].to_numpy()[np.lexsort(x.T)]
    return train(x[y == 1], x[y == 0], prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score double and predicted int; columns of those names are replaced, all others kept."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [features(t.as_py()) for t in b.column("text")]
            s = model.score(np.array(each).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, "score"])
            pa.default_memory_pool().release_unused()
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    out = docs.select(*kept).mapInArrow(run, f"{schema}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
