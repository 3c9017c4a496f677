"""Operator 7, quality classifier: ordinal cumulative-link regression on graded
ratings. Hashed-text weights are shared by all grades, thresholds are ordered."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

DIM = 1 << 18
#: Labelled rows that the model is fitted on at most (those of smallest hash).
FIT_ROWS = 6_000
#: Features of documents that a step of the fit holds in 64 bits at once.
BLOCK = 1 << 17
#: A document stays if its probability of the best grade is at least this.
LEAST_TAIL = 0.5
#: Words whose features a Python worker remembers.
CACHED = 40_000
_cache: dict[str, tuple[int, ...]] = {}


def _hash(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) & (DIM - 1)


def _word_features(word: str) -> tuple[int, ...]:
    if word.isalnum():
        core, marks = word, ""
    else:
        core = word.strip(".,;:!?\"'()[]{}")
        marks = "".join([c for c in word if not c.isalnum()])
    low = core.lower()
    out = [_hash(low)]
    if len(low) > 4:
        out.append(_hash("\0start " + low[:4]))
    if marks:
        out.append(_hash("\0marks " + marks[:8]))
    if len(core) > 2 and core.isupper():
        out.append(_hash("\0upper"))
    return tuple(out)


def features(text: str | None) -> np.ndarray:
    """Hashed features of the whole text: words, their beginnings, marks around them, case, recurrence."""
    words = (text or "").split()
    distinct = set(words)
    ids: set[int] = set()
    if words:  # how often words recur, in half powers of two; also for texts of such a length
        often = int(2 * np.log2(len(words) / len(distinct)))
        ids |= {_hash(f"\0recur {often}"), _hash(f"\0recur {often} {len(words).bit_length()}")}
    for word in distinct:
        found = _cache.get(word)
        if found is None:
            found = _word_features(word)
            if len(_cache) < CACHED:  # the words met first, common ones among them
                _cache[word] = found
        ids.update(found)
    return np.fromiter(ids, np.int32, len(ids))


@dataclass
class Ordinal:
    """P(grade >= j) = sigmoid(weights . x - thresholds[j - 1])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, ids: np.ndarray) -> np.ndarray:
        z = float(self.weights[ids].sum()) - self.thresholds
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _sums(index: np.ndarray, sizes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives, for each group, the sum of ``v[i]`` over its indices in
    their order; groups stand one after another in ``index``. It works on about
    BLOCK indices at a time, so that no copy of all of them is made in 64 bits."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    cuts = [0]
    while cuts[-1] < len(sizes):
        to = int(np.searchsorted(offsets, offsets[cuts[-1]] + BLOCK, side="right")) - 1
        cuts.append(min(max(to, cuts[-1] + 1), len(sizes)))

    def sums(v: np.ndarray) -> np.ndarray:
        out = np.empty(len(sizes))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            group = np.repeat(np.arange(b - a), sizes[a:b])
            out[a:b] = np.bincount(group, weights=v[index[offsets[a] : offsets[b]]], minlength=b - a)
        return out

    return sums


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float = 0.05, rounds: int = 400, least: int = 5, common: float = 0.25) -> Ordinal:
    """Accelerated proximal gradient on the mean log-likelihood. Features of fewer
    than ``least`` rows or of more than a share ``common`` of them have weight 0, and
    an L1 penalty (``l1`` / sqrt(rows)) leaves words without evidence there. Without rows all weights are
    0 and the best grade is near certain."""
    weights = np.zeros(DIM, np.float32)
    if not len(rows):
        return Ordinal(weights, np.full(n_grades - 1, -50.0) + np.arange(n_grades - 1))
    n, y = len(rows), np.asarray(grades)
    l1 /= np.sqrt(n)
    count = np.zeros(DIM, np.int64)
    for r in rows:
        np.add.at(count, r, 1)
    chosen = (count >= least) & (count <= common * n)
    used, at = np.flatnonzero(chosen), np.cumsum(chosen, dtype=np.int32) - np.int32(1)
    kept = [at[r[chosen[r]]] for r in rows]
    sizes = np.array([len(k) for k in kept])
    place = np.concatenate(kept)
    del kept
    owner, holders = np.repeat(np.arange(n, dtype=np.int32), sizes), count[used]
    step = max(1, len(used) * BLOCK // max(1, len(place)))
    by_feature = np.empty_like(owner)
    done = 0
    for first in range(0, len(used), step):  # by feature, rows in their order
        some = np.flatnonzero((place >= first) & (place < first + step))
        by_feature[done : done + len(some)] = owner[some[np.argsort(place[some], kind="stable")]]
        done += len(some)
    del owner
    times, back = _sums(place, sizes), _sums(by_feature, holders)

    top, v = 1.0, np.ones(len(used))
    for _ in range(20):  # the largest curvature, by power iteration
        v = back(times(v / max(np.linalg.norm(v), 1e-12))) / n
        top = max(np.linalg.norm(v), 1e-6)
    pace = 1 / (0.25 * (top + 1))
    share = np.clip([(y >= j).mean() for j in range(1, n_grades)], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    w = np.zeros(len(used))
    seen, theta_seen, t = w, theta, 1.0
    for _ in range(rounds):
        z = times(seen)
        edge = np.concatenate([[-np.inf], theta_seen, [np.inf]])
        up = 1 / (1 + np.exp(-np.clip(z - edge[y], -50, 50)))  # P(grade >= y)
        down = 1 / (1 + np.exp(-np.clip(z - edge[y + 1], -50, 50)))  # P(grade > y)
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        g_theta = np.array([-du[y == j].sum() + dd[y == j - 1].sum() for j in range(1, n_grades)]) / n
        new = seen + pace * back((du - dd) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - pace * l1, 0)
        theta_new = np.maximum.accumulate(theta_seen + min(1.0, pace) * g_theta)
        theta_new = np.maximum(theta_new, theta_new[0] + 1e-6 * np.arange(n_grades - 1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((seen - new) * (new - w)).sum() > 0:  # overshot: momentum starts anew
            t_new = t = 1.0
        seen = new + (t - 1) / t_new * (new - w)
        theta_seen = np.maximum.accumulate(theta_new + (t - 1) / t_new * (theta_new - theta))
        w, theta, t = new, theta_new, t_new
    weights[used] = w
    return Ordinal(weights, theta)


N_GRADES = 3
ADDED = ("expected_grade", "p_best", "accepted")


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 2 for good and not toxic, 1 for one of both, 0 for neither;
    rows with a null are no ratings."""
    grade = F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade between 0 and 2")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ordinal:
    """Fitted on the ``fit_rows`` rated documents of smallest hash, whole texts.

    Ratings with a null and ids without a document are left out; rows that repeat an id
    all count, in a fixed order of (hash, id, grade, features). A null or empty text has
    no features. Without ratings the model accepts everything.
    """
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(fit_rows)
    joined = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column(0), "grade": batch.column(2), "ids": [features(x).tobytes() for x in batch.column(1).to_pylist()]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(joined.select("doc_id", "text", "grade"), kernel, f"doc_id {kind}, grade int, ids binary", 1)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "ids").limit(fit_rows).collect()
    return fit([np.frombuffer(r.ids, np.int32) for r in rows], np.array([r.grade for r in rows], np.int64), N_GRADES)


def grade(docs: DataFrame, model: Ordinal, least_tail: float = LEAST_TAIL) -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_best`` and ``accepted`` in place of such
    columns. The whole text is scored; a null text counts as empty (no features, so
    the prior decides); other columns pass unchanged; an empty table gives none.
    Rows are scored where they are read: only the weights (1 MB) travel."""
    slim = docs.select(*(c for c in docs.columns if c not in ADDED))
    text_at = slim.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = slim.columns

    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        tails = np.array([shared.value.tails(features(x)) for x in batch.column(text_at).to_pylist()]).reshape(batch.num_rows, -1)
        best = tails[:, -1]
        return {c: batch.column(i) for i, c in enumerate(names)} | {"expected_grade": tails.sum(axis=1), "p_best": best, "accepted": best >= least_tail}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema) + ", expected_grade double, p_best double, accepted boolean"
    return map_batches(slim, kernel, schema, text_at, 2_000_000)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
