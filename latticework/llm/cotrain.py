"""Quality classification by co-training of two views of a document.

Text view: which words occur (hashed). Metadata view: no words; source, language, length, and unless
``page_layout`` is false the page's layout: line lengths, shares of capitals, digits, signs and
repeated lines, each in steps. Both are naive Bayes over hashed features, so a model is a table of counts and its training is a sum.

Each round, every document that a view is confident about lends its label, as that view sees it, to
the other view's counts; confidence is judged on calibrated scores. Thus the pseudo-labels of all
documents count, not of a sample. At the end both views are calibrated on labelled documents that
their counts leave out (two folds), a logistic combination of the calibrated logits is fitted on
the same ones, and all documents are scored.

The driver holds at most ``labelled_limit`` different labelled documents (the smallest hashes) for
calibration, and tables of ``BUCKETS`` rows; features stay in the shared folder.

Null texts have no words, null metadata is a value of its own. Documents whose id is null or has no
label are scored like all others; contradicting labels of an id count each. Without any label of
both kinds every score is the share of positive labels, or 0.5.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from dataclasses import field as attribute
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, field, map_batches, materialise, own_name, smallest, texts_of

BITS = 16
BUCKETS = 1 << BITS
WORD = re.compile(r"[^\W\d_]+")
FOLDS = 2


class _Rows(dict):
    """Table row of a word, computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 64 - BITS
        return h


def text_rows(text: str, known: _Rows) -> np.ndarray:
    """Distinct table rows of the words, sorted."""
    words = set(WORD.findall(text.lower()))
    return np.unique(np.fromiter(map(known.__getitem__, words), np.uint16, len(words)))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """0 other sign, 1 blank, 2 digit, 3 letter, 4 capital, for every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        out[c] = 4 if ch.isupper() and ch.isalpha() else 3 if ch.isalpha() else 2 if ch.isdigit() else 1 if ch == " " else 0
    return out


def layout(text: str) -> list[str]:
    """The page's layout in steps; no words."""
    n = max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=5).tolist()
    step = lambda share: math.ceil(math.log2(1 + 64 * share))  # noqa: E731  0, then doubling
    return [
        f"length {n.bit_length()}",
        f"line {(n // max(len(lines), 1)).bit_length()}",
        f"capitals {step(kinds[4] / n)}",
        f"digits {step(kinds[2] / n)}",
        f"blanks {step(kinds[1] / n)}",
        f"signs {step((kinds[0] + kinds[2]) / n)}",
        f"repeats {step(1 - len(set(lines)) / max(len(lines), 1))}",
    ]


def meta_rows(values: list[object], text: str, page_layout: bool = True) -> np.ndarray:
    names = [f"{i}={v}" for i, v in enumerate(values)] + (layout(text) if page_layout else [f"length {len(text).bit_length()}"])
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x) >> 64 - BITS for x in names], np.uint16))


def features(docs: DataFrame, *, carry: list[str], metadata: list[str], text: str, page_layout: bool = True) -> DataFrame:
    """``carry`` and binary ``_words`` and ``_meta``: sorted 16-bit table rows. Written down."""
    own = own_name(docs, "_text")
    names = [own_name(docs, f"_m{i}") for i, _ in enumerate(metadata)]
    schema = T.StructType([*[docs.schema[c] for c in carry], field("_words", "binary"), field("_meta", "binary")])

    def run(batches):
        known = _Rows()
        for b in batches:
            texts = texts_of(b, own)
            values = list(zip(*[column(b, n).to_pylist() for n in names], strict=True)) if names else [()] * len(texts)
            words = [text_rows(t, known).tobytes() for t in texts]
            metas = [meta_rows(list(v), t, page_layout).tobytes() for v, t in zip(values, texts, strict=True)]
            yield [*[b.column(i) for i in range(len(carry))], pa.array(words, pa.binary()), pa.array(metas, pa.binary())]

    picked = docs.select(*carry, F.col(text).alias(own), *[F.col(m).cast("string").alias(n) for m, n in zip(metadata, names, strict=True)])
    return materialise(map_batches(picked, run, schema, text=own), "features")


@dataclass
class Counts:
    """Documents with each feature, and documents, by class."""

    rows: np.ndarray = attribute(default_factory=lambda: np.zeros((2, BUCKETS)))
    docs: np.ndarray = attribute(default_factory=lambda: np.zeros(2))

    def __add__(self, other: Counts) -> Counts:
        return Counts(self.rows + other.rows, self.docs + other.docs)

    def weights(self, smooth: float = 0.5, sure: float = 2.5) -> tuple[np.ndarray, float]:
        """Log odds that each present feature adds, and those of the prior. A feature's log odds
        shrink by how many of their standard errors they are away from 0, to none at ``sure``."""
        rows, docs = self.rows + smooth, self.docs + 2 * smooth
        odds = np.log(rows[1] / docs[1]) - np.log(rows[0] / docs[0])
        far = np.abs(odds) / np.sqrt((1 / rows).sum(0))
        d = np.log(docs)
        return (odds * np.maximum(0, 1 - (sure / np.maximum(far, sure)) ** 2)).astype(np.float32), float(d[1] - d[0])

    def like(self, true: np.ndarray) -> Counts:
        """The same shares with the classes in the ratio ``true``, weighing as much as those
        documents at most; nothing where a class is missing."""
        by = min(1.0, float(np.min(self.docs / true)))
        factor = by * true / np.maximum(self.docs, 1)
        return Counts(self.rows * factor[:, None], self.docs * factor)


def logits(binary: pa.Array, weights: np.ndarray, prior: float) -> np.ndarray:
    """Log odds of each row, before calibration."""
    raw = [x or b"" for x in binary.to_pylist()]
    n = np.fromiter((len(x) // 2 for x in raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint16)
    upto = np.concatenate([[0.0], np.cumsum(weights[flat], dtype=np.float64)])
    ends = np.cumsum(n)
    return prior + upto[ends] - upto[ends - n]


def counts_of(lists: list[np.ndarray], y: np.ndarray) -> Counts:
    out = Counts()
    for k in (0, 1):
        mine = [x for x, v in zip(lists, y, strict=True) if v == k]
        out.docs[k] = len(mine)
        if mine:
            out.rows[k] = np.bincount(np.concatenate(mine), minlength=BUCKETS)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients (last: intercept) by Newton's method with halved steps where the loss would
    grow; Platt scaling with one column."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    aim = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))  # Platt's targets
    loss = lambda w: float(np.sum(np.logaddexp(0, z @ w) - aim * (z @ w)) + ridge / 2 * (w @ w))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - aim) + ridge * w)
        now = loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


VIEWS = ("_words", "_meta")


@dataclass
class Classifier:
    """Weights of both views, their calibrations and the combination."""

    views: list[tuple[np.ndarray, float]]
    scales: list[np.ndarray]
    combine: np.ndarray
    constant: float | None = None

    def calibrated(self, k: int, binary: pa.Array) -> np.ndarray:
        a, b = self.scales[k]
        return a * logits(binary, *self.views[k]) + b

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.constant is not None:
            return np.full(batch.num_rows, self.constant)
        both = [self.calibrated(k, column(batch, v)) for k, v in enumerate(VIEWS)]
        z = both[0] * self.combine[0] + both[1] * self.combine[1] + self.combine[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(parts: list[Counts], given: list[list[np.ndarray]], y: np.ndarray, folds: np.ndarray, lent: list[Counts]) -> Classifier:
    """Calibrate on labelled documents that the counts leave out, then use all counts.

    ``parts[v]`` holds the labelled counts of view v, ``lent[v]`` the pseudo-labelled ones."""
    out = np.zeros((len(y), 2))
    for v in (0, 1):
        for f in range(FOLDS):
            train = counts_of([x for x, g in zip(given[v], folds, strict=True) if g != f], y[folds != f]) + lent[v]
            mine = pa.array([x.tobytes() for x, g in zip(given[v], folds, strict=True) if g == f], pa.binary())
            out[folds == f, v] = logits(mine, *train.weights())
    scales = [logistic(out[:, [v]], y) for v in (0, 1)]
    both = np.column_stack([out[:, v] * scales[v][0] + scales[v][1] for v in (0, 1)])
    return Classifier([(parts[v] + lent[v]).weights() for v in (0, 1)], scales, logistic(both, y))


class Training:
    """What one target's rounds need: labelled features, folds, and the counts lent so far."""

    def __init__(self, taken: list, target: str) -> None:
        taken = [r for r in taken if r[target] in (0, 1)]
        self.y = np.array([r[target] for r in taken], np.int64)
        self.constant = None
        if len(self.y) < 4 or self.y.min() == self.y.max():
            self.constant = float(self.y.mean()) if len(self.y) else 0.5
            return
        self.given = [[np.frombuffer(bytes(r[v]), np.uint16) for r in taken] for v in VIEWS]
        self.folds = np.zeros(len(self.y), np.int64)
        for k in (0, 1):  # alternate within each class
            self.folds[self.y == k] = np.arange((self.y == k).sum()) % FOLDS
        self.parts = [counts_of(g, self.y) for g in self.given]
        self.lent = [Counts(), Counts()]

    def fit(self) -> Classifier:
        if self.constant is not None:
            return Classifier([], [], np.zeros(3), self.constant)
        return _fit(self.parts, self.given, self.y, self.folds, self.lent)

    def lend(self, found: list[Counts]) -> None:
        """Pseudo-labels of a view weigh as much as its true labels at most, in the same ratio."""
        if self.constant is None:
            self.lent = [c.like(np.bincount(self.y, minlength=2)) for c in found]


def cotrain(rows: DataFrame, taken: list, targets: list[str], *, rounds: int = 2, confident: float = 0.95) -> list[Classifier]:
    """A classifier for each target. ``rows``: features of all documents, written down, with a long
    ``_h`` (hash of the id); a round reads them once for all targets. ``taken``: features of labelled
    documents, with ``_h`` and the targets, of which only 0 and 1 count."""
    trainings = [Training(taken, t) for t in targets]
    bar = float(np.log(confident / (1 - confident)))
    hashes = np.array(sorted({r["_h"] for r in taken}), np.int64)
    for _ in range(rounds if any(t.constant is None for t in trainings) else 0):
        for t, found in zip(trainings, pseudo_labelled(rows, [t.fit() for t in trainings], bar, hashes), strict=True):
            t.lend(found)
    return [t.fit() for t in trainings]


def pseudo_labelled(rows: DataFrame, models: list[Classifier], bar: float, labelled_hashes: np.ndarray) -> list[list[Counts]]:
    """For each model, counts for each view from documents that the *other* view is confident about;
    all documents but the labelled ones. At most 2 * 2 * (BUCKETS + 1) sums a model go to the driver."""
    sent = rows.sparkSession.sparkContext.broadcast((models, labelled_hashes))  # tables of fixed size, hashes up to the limit
    schema = T.StructType([field("at", "int"), field("n", "bigint")])
    shape = (len(models), 2, 2, BUCKETS + 1)

    def run(batches):
        models, done = sent.value
        total = np.zeros(shape, np.int64)
        for b in batches:
            free = ~np.isin(column(b, "_h").to_numpy(zero_copy_only=False), done)
            raw = [column(b, v).to_pylist() for v in VIEWS]
            for i, m in enumerate(models):
                for teacher, pupil in ((0, 1), (1, 0)) if m.constant is None else ():
                    z = m.calibrated(teacher, column(b, VIEWS[teacher]))
                    for k, sure in ((0, free & (z <= -bar)), (1, free & (z >= bar))):
                        at = np.flatnonzero(sure)
                        total[i, pupil, k, :BUCKETS] += np.bincount(np.frombuffer(b"".join([raw[pupil][j] or b"" for j in at]), np.uint16), minlength=BUCKETS)
                        total[i, pupil, k, BUCKETS] += len(at)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        yield [pa.array(at.astype(np.int32)), pa.array(flat[at])]

    summed = map_batches(rows.select("_h", *VIEWS), run, schema, text=None).groupBy("at").agg(F.sum("n").alias("n"))
    flat = np.zeros(int(np.prod(shape)))
    for r in summed.toLocalIterator():
        flat[r["at"]] = r["n"]
    cube = flat.reshape(shape)
    return [[Counts(x[v, :, :BUCKETS], x[v, :, BUCKETS]) for v in (0, 1)] for x in cube]


def labelled_rows(rows: DataFrame, marks: DataFrame, limit: int) -> list:
    """At most ``limit`` different labelled documents, those with the smallest hashes of id and
    features, so that neither a repeated id nor a repeated row brings more of them to the driver."""
    ys = [c for c in marks.columns if c != "_of"]
    # at most ``limit`` marks, which bounds the broadcast
    sample = smallest(marks.withColumn("_l", F.xxhash64("_of")), "_l", limit)
    found = rows.join(F.broadcast(sample), F.col("_key") == F.col("_of")).select("_h", *VIEWS, *ys, F.xxhash64("_h", *VIEWS, *ys).alias("_l"))
    found = materialise(found.groupBy("_l").agg(*[F.first(c).alias(c) for c in ("_h", *VIEWS, *ys)]), "labelled")
    return sorted(smallest(found, "_l", limit).collect(), key=lambda r: r["_l"])


def classify(docs: DataFrame, labels: DataFrame, *, targets: tuple[str, ...] = ("quality", "toxic"), metadata: list[str] | None = None, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, labelled_limit: int = 20_000, page_layout: bool = True, **how) -> DataFrame:
    """``carry`` (``key`` alone if None) and a double ``<target>_score`` for each target: the
    probability of label 1."""
    carry = [key] if carry is None else carry
    metadata = ["source", "lang"] if metadata is None else metadata
    named = {c: f"_c{i}" for i, c in enumerate(carry)}
    slim = docs.select(*[F.col(c).alias(n) for c, n in named.items()], F.xxhash64(F.col(key)).alias("_h"), F.col(key).alias("_key"), F.col(text).alias("_t"), *[F.col(m).alias(f"_d{i}") for i, m in enumerate(metadata)])
    rows = features(slim, carry=[*named.values(), "_h", "_key"], metadata=[f"_d{i}" for i in range(len(metadata))], text="_t", page_layout=page_layout)
    marks = labels.select(F.col(key).alias("_of"), *[F.col(t).alias(f"_y{i}") for i, t in enumerate(targets)])
    valid = reduce(Column.__or__, [F.col(f"_y{i}").isin(0, 1) for i in range(len(targets))])
    taken = labelled_rows(rows, marks.filter(valid & F.col("_of").isNotNull()), labelled_limit)
    models = cotrain(rows, taken, [f"_y{i}" for i in range(len(targets))], **how)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType, True) for c in carry], *[field(f"{t}_score", "double") for t in targets]])

    def run(batches):
        for b in batches:
            yield [*[column(b, n) for n in named.values()], *[pa.array(m.score(b)) for m in sent.value]]

    return map_batches(rows, run, schema, text=None)
