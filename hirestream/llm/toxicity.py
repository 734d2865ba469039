"""Toxicity by classifier chains over text features.

Categories are predicted one after the other: a category's linear model sees the text
and the probabilities of the categories before it. In training those are out-of-fold:
the labelled rows are cut into ``FOLDS`` by id hash, and a row's earlier probabilities
come from models that have not seen it, so later models learn what such probabilities are
worth on new texts. A category's threshold is set on its out-of-fold probabilities.

Models are fitted on at most ``MAX_TRAIN`` labelled rows (those with the smallest id hash,
a documented bound); every document is scored, on its whole text, in one pass without a
shuffle. Features are distinct words and word
beginnings, hashed, and the shape of the text.

Defined results: null or empty text has the models' base rates; labelled rows without a
document, and labels that are null, are left out; a category without both labels in
the sample has its base rate everywhere and flags nothing; repeated rows are scored
alike; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MAX_TRAIN = 12_000
FOLDS = 3
BITS = 18
PREFIXES = (4, 5, 6)
EPOCHS = 20
RATE = 0.3
L2 = 1e-4
LEAST_CHI2 = 20.0
LEAST_ROWS = 3
_TOKEN = re.compile(r"[^\W\d_]+")
_SIGNS = "!#*$%&|<>"


def features(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct words and word beginnings."""
    said = _TOKEN.findall(text.lower()) if text else []
    words = set(said)
    starts = {w[:k] for w in words for k in PREFIXES if len(w) > k}
    found = [zlib.crc32(w.encode("utf-8", "surrogatepass")) >> (32 - BITS) for w in words]
    found += [zlib.crc32(b"^" + w.encode("utf-8", "surrogatepass")) >> (32 - BITS) for w in starts]
    if said:  # how the text looks: tenths of new words, capitals and signs per word
        shape = (10 * len(words) // len(said), 10 * sum(map(str.isupper, text)) // len(text),
                 min(20, 10 * sum(map(text.count, _SIGNS)) // len(said)))
        found += [zlib.crc32(b"%d=%d" % x) >> (32 - BITS) for x in enumerate(shape)]
    return np.unique(np.array(found, np.int64)).astype(np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 9.21  # about -1 to 1


@dataclass
class Link:
    """One model of the chain: word weights, weights of earlier probabilities, bias."""
    words: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float = 0.5

    def score(self, at: np.ndarray, start: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.words[at], dtype=np.float64)))
        return _sigmoid(total[start[1:]] - total[start[:-1]] + earlier @ self.earlier + self.bias)


def _rows(at: np.ndarray, start: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(start)[keep]
    new = np.concatenate(([0], np.cumsum(n)))
    return at[np.repeat(start[:-1][keep] - new[:-1], n) + np.arange(new[-1])], new


def telling(at: np.ndarray, start: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features whose presence goes with the label beyond chance: chi-squared of
    ``LEAST_CHI2`` or more, in ``LEAST_ROWS`` rows or more. The others are not learned, so
    that rare words do not stand for the rows that happen to hold them."""
    n, pos = len(y), float(y.sum())
    seen = np.bincount(at, minlength=1 << BITS).astype(np.float64)
    hit = np.bincount(at, weights=np.repeat(y, np.diff(start)), minlength=1 << BITS)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (hit * n - seen * pos) ** 2 / (seen * (n - seen) * pos * (n - pos))
    return (np.nan_to_num(chi2) >= LEAST_CHI2) & (seen >= LEAST_ROWS)


def fit(at: np.ndarray, start: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Link:
    """Logistic regression over the telling features, by gradient steps whose size is set
    per weight; rows come in a fixed shuffle."""
    rate = float(y.mean()) if len(y) else 0.0
    if rate in (0.0, 1.0):
        p = min(max(rate, 1e-3), 1 - 1e-3)
        return Link(np.zeros(1 << BITS, np.float32), np.zeros(earlier.shape[1]), float(np.log(p / (1 - p))), 2.0)
    keep = telling(at, start, y)
    chosen = keep[at]
    start = np.concatenate(([0], np.cumsum(chosen)))[start]
    at = at[chosen]
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    e, eg2 = np.zeros(earlier.shape[1]), np.full(earlier.shape[1], 1e-2)
    b, bg2 = float(np.log(rate / (1 - rate))), 1e-2
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            a, s = _rows(at, start, part)
            z = np.concatenate(([0.0], np.cumsum(w[a])))
            err = _sigmoid(z[s[1:]] - z[s[:-1]] + earlier[part] @ e + b) - y[part]
            hit, inverse = np.unique(a, return_inverse=True)
            g = np.bincount(inverse, weights=np.repeat(err, np.diff(s)), minlength=len(hit)) / len(part) + L2 * w[hit]
            g2[hit] += g * g
            w[hit] -= RATE * g / np.sqrt(g2[hit])
            ge, gb = earlier[part].T @ err / len(part), float(err.mean())
            eg2 += ge * ge
            e -= RATE * ge / np.sqrt(eg2)
            bg2 += gb * gb
            b -= RATE * gb / bg2 ** 0.5
    return Link(w.astype(np.float32), e, b)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap above which F1 is best."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(len(p)) + 1 + y.sum())
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(at: np.ndarray, start: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> tuple[list[Link], np.ndarray]:
    """The chain's models, and the out-of-fold probabilities they were linked with."""
    n, k = labels.shape
    oof, chain = np.zeros((n, k)), []
    for c in range(k):
        earlier, y = _logit(oof[:, :c]), labels[:, c].astype(np.float64)
        for f in np.unique(fold):
            seen, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            a, s = _rows(at, start, seen)
            model = fit(a, s, earlier[seen], y[seen])
            a, s = _rows(at, start, held)
            oof[held, c] = model.score(a, s, earlier[held])
        model = fit(at, start, earlier, y)
        if model.threshold <= 1.0:
            model.threshold = best_threshold(oof[:, c], y)
        chain.append(model)
    return chain, oof


def score_chain(chain: Sequence[Link], at: np.ndarray, start: np.ndarray) -> np.ndarray:
    p = np.zeros((len(start) - 1, len(chain)))
    for c, link in enumerate(chain):
        p[:, c] = link.score(at, start, _logit(p[:, :c]))
    return p


def _ragged(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
          max_train: int = MAX_TRAIN, folds: int = FOLDS) -> list[Link]:
    """Models in the order of ``categories`` (name to 0/1 expression over ``labels``)."""
    small_batches(docs.sparkSession)
    names = list(categories)
    asked = (labels.select(F.col(id_col).cast("long").alias("label_id"), *[v.cast("int").alias(k) for k, v in categories.items()])
                   .dropna().groupBy("label_id").agg(*[F.max(k).alias(k) for k in names])
                   .orderBy(F.xxhash64("label_id"), "label_id").limit(max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], names=["found", "label_id", *names])

    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    # at most max_train ids; of rows that share an id one is taken, by a hash of the text
    one = (texts.join(F.broadcast(asked), "label_id").groupBy("label_id", *names)
                .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")))
    rows = (one.select("t.text", "label_id", *names)
                 .mapInArrow(run, "found binary, label_id long" + "".join(f", `{n}` int" for n in names)).toPandas())
    rows = rows.sort_values("label_id")
    at, start = _ragged([np.frombuffer(x, np.int32) for x in rows["found"]])
    fold = np.array([zlib.crc32(str(i).encode()) % folds for i in rows["label_id"]], np.int64)
    return fit_chain(at, start, rows[names].to_numpy(np.int64).reshape(len(rows), len(names)), fold)[0]


def predict(docs: DataFrame, chain: Sequence[Link], names: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, and ``p_<category>`` and ``<category>`` (flag) for each category."""
    small_batches(docs.sparkSession)
    # plain values: broadcasts are pickled by reference to their classes
    sent = docs.sparkSession.sparkContext.broadcast([(m.words, m.earlier, m.bias, m.threshold) for m in chain])
    out = ["doc_id", *[f"p_{n}" for n in names], *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Link(*m) for m in sent.value]
        for batch in batches:
            p = score_chain(models, *_ragged([features(t) for t in batch.column(1).to_pylist()]))
            flags = [pa.array(p[:, c] >= link.threshold) for c, link in enumerate(models)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, c]) for c in range(len(names))], *flags], names=out)

    fields = "doc_id long" + "".join(f", p_{n} double" for n in names) + "".join(f", `{n}` boolean" for n in names)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                .mapInArrow(run, fields))


def score_documents(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], **how) -> DataFrame:
    return predict(docs, train(docs, labels, categories, **how), list(categories))
