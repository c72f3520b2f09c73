"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has ordered grades 0 to K - 1. The model is ``P(grade >= j) = s(w.x - t_j)``
with one weight vector for all thresholds ``t_1 <= t_2 <= ...``; ``x`` says which
words (hashed) a text has. It is fitted on the driver on a bounded, documented sample
of labelled documents and applied to whole texts in tasks; the expected severity is
the sum of ``P(grade >= j)`` over j.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, trim, worker_cache

SAMPLE = 10_000      # labelled documents that the model is fitted on, at most
FEATURES = 1 << 32   # hashed words
LEAST = 5            # sampled documents, different in text, that a feature needs
WORDS = 65_536       # features that reach the driver, at most
PAIRS = 4_000_000    # occurrences of features that reach the driver, at most
LARGEST = 12.0       # size of a weight
REMEMBERED = 150_000

_WORDS = re.compile(r"[^\W\d_]+").findall


def words(text: str) -> set[str]:
    return set(_WORDS(text.lower()))


def feature(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % FEATURES


@dataclass
class Model:
    weights: dict[int, float]    # by feature; features that do not matter are left out
    thresholds: list[float]      # rising; one fewer than there are grades

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade >= j)`` for j from 1, a column each."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -500, 500)))


def _descend(at, col, y, n, size, levels, l1, rounds):
    """Proximal gradient steps with momentum on the mean negative log likelihood plus
    ``l1`` times the weights' sizes; ``at`` and ``col`` are the rows and columns of the
    features that are there."""
    above = y[:, None] >= np.arange(1, levels + 1)[None, :]
    share = np.clip(above.mean(axis=0), 1e-6, 1 - 1e-6)
    t = np.log((1 - share) / share)
    # a step of its own for each weight, shorter the more often its word occurs
    step = 1.0 / np.maximum(np.bincount(col, minlength=size) / n, 1.0 / n)
    w = np.zeros(size)
    z, tz, momentum = w.copy(), t.copy(), 1.0
    row = np.arange(n)
    for _ in range(rounds):
        score = np.bincount(at, weights=z[col], minlength=n)
        s = 1 / (1 + np.exp(np.clip(tz[None, :] - score[:, None], -500, 500)))
        # P(y = k) is the difference of neighbouring chances
        upper = np.concatenate([np.ones((n, 1)), s], axis=1)[row, y]
        lower = np.concatenate([s, np.zeros((n, 1))], axis=1)[row, y]
        p = np.maximum(upper - lower, 1e-9)
        by_score = -(upper * (1 - upper) - lower * (1 - lower)) / p / n
        by_t = np.array([((s[:, j] * (1 - s[:, j]) / p)[y == j + 1].sum()
                          - (s[:, j] * (1 - s[:, j]) / p)[y == j].sum()) / n for j in range(levels)])
        fresh = z - step * np.bincount(col, weights=by_score[at], minlength=size)
        fresh = np.clip(np.sign(fresh) * np.maximum(np.abs(fresh) - step * l1, 0), -LARGEST, LARGEST)
        t_fresh = np.maximum.accumulate(np.clip(tz - by_t, -LARGEST, 4 * LARGEST))
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        z = fresh + (momentum - 1) / after * (fresh - w)
        tz = np.maximum.accumulate(t_fresh + (momentum - 1) / after * (t_fresh - t))
        w, t, momentum = fresh, t_fresh, after
    return w, t


def fit(at: np.ndarray, features: np.ndarray, grades: np.ndarray, rounds: int = 300) -> Model:
    """Fit on documents 0 to n - 1: document ``at[i]`` has feature ``features[i]``.

    Of the features that at least ``LEAST`` more documents above grade 0 have than
    chance would give, and twice as many, an L1 penalty selects those that others do
    not explain; weights and thresholds are then fitted without it. Grades that nobody
    has get no threshold. Without two grades nothing is toxic."""
    kinds = np.unique(grades)
    if len(kinds) < 2:
        return Model({}, [50.0])
    n, levels, y = len(grades), len(kinds) - 1, np.searchsorted(kinds, grades)
    words, features = np.unique(features, return_inverse=True)
    has = np.bincount(features)
    hit = np.bincount(features[y[at] > 0], minlength=len(words))
    expected = has * (y > 0).mean()
    used = np.flatnonzero((hit - expected >= LEAST) & (hit >= 2 * expected))
    for l1 in (1 / n, 0.0):
        if not len(used):
            return Model({}, [50.0])
        number = np.full(len(words), -1)
        number[used] = np.arange(len(used))
        col = number[features]
        w, t = _descend(at[col >= 0], col[col >= 0], y, n, len(used), levels, l1, rounds)
        used, w = used[w > 0.05], w[w > 0.05]
    return Model({int(k): float(v) for k, v in zip(words[used], w, strict=True)}, [float(x) for x in t])


def grade(at: np.ndarray, features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Severity grades from plain labels: 0 not toxic; of the toxic ones 2 if they have
    at least as many marked words as the median of those that have any, else 1. A word
    is marked if it is in ``LEAST`` toxic texts or more and in no other."""
    words, features = np.unique(features, return_inverse=True)
    bad = np.bincount(features[toxic[at] == 1], minlength=len(words))
    good = np.bincount(features[toxic[at] != 1], minlength=len(words))
    marked = (bad >= LEAST) & (good == 0)
    hits = np.bincount(at, weights=marked[features], minlength=len(toxic))
    some = hits[(toxic == 1) & (hits > 0)]
    severe = hits >= max(1.0, np.median(some)) if len(some) else np.zeros(len(toxic), dtype=bool)
    return np.where(toxic == 1, np.where(severe, 2, 1), 0)


def _features(batches):
    for batch in batches:
        found = [sorted({feature(w) for w in words(t)}) if t else [] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("text_hash"), batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))],
            ["text_hash", "toxic", "features"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, those whose id hashes lowest. Of
    equal texts one is used. Null labels and ids do not count; a document labelled
    twice counts as toxic if any label says so.

    Words are counted by Spark. Only those that the fit could use reach the driver: at
    most ``WORDS`` words that toxic texts have most in excess, and of these, from the
    first on, as many as occur ``PAIRS`` times in the sample, however long its texts."""
    asked = (labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).alias("_doc")).agg(F.max(toxic).cast("int").alias("toxic"))
             .orderBy(F.xxhash64("_doc"), "_doc").limit(sample))
    # bounded: two numbers for each of ``sample`` rows
    picked = (docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("text"))
              .join(F.broadcast(asked), "_doc")
              .select("text", "toxic", F.xxhash64("text").alias("text_hash")))
    found = settle(picked.mapInArrow(_features, "text_hash long, toxic int, features array<long>"), "features")
    kept = settle(found.groupBy("text_hash").agg(F.max("toxic").alias("toxic")).orderBy("text_hash").limit(sample), "kept")
    texts = kept.orderBy("text_hash").toArrow()
    if not len(texts):
        return Model({}, [50.0])
    flags = texts.column("toxic").to_numpy()
    pairs = (found.select("text_hash", F.explode("features").alias("feature")).distinct()
             .join(F.broadcast(kept), "text_hash"))
    excess = F.col("bad") - F.col("has") * float((flags == 1).mean())
    counts = pairs.groupBy("feature").agg(F.count("*").alias("has"), F.count_if(F.col("toxic") == 1).alias("bad"))
    useful = (counts.where((F.col("bad") >= LEAST) & ((F.col("bad") == F.col("has")) | (excess >= LEAST - 0.5)))
              .orderBy(excess.desc(), "feature").limit(WORDS).select("feature", "has").toArrow())
    fits = np.cumsum(useful.column("has").to_numpy()) <= PAIRS
    words = docs.sparkSession.createDataFrame(useful.select(["feature"]).filter(pa.array(fits, pa.bool_())))
    rows = pairs.join(F.broadcast(words), "feature").select("text_hash", "feature").toArrow()
    at = np.searchsorted(texts.column("text_hash").to_numpy(), rows.column("text_hash").to_numpy())
    order = np.lexsort((rows.column("feature").to_numpy(), at))
    at, features = at[order], rows.column("feature").to_numpy()[order]
    return fit(at, features, grade(at, features, flags))


def _score(model, place):
    def run(batches):
        known = worker_cache(f"toxic {hash(tuple(model.weights.items()))}", dict)

        def weight(word):
            w = known.get(word)
            if w is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                w = known[word] = model.weights.get(feature(word), 0.0)
            return w

        for batch in batches:
            score = np.array([sum(map(weight, words(t))) if t else 0.0 for t in batch.column(place).to_pylist()])
            chances = model.chances(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chances.sum(axis=1)), pa.array((chances >= 0.5).sum(axis=1), pa.int32())],
                [*batch.schema.names, "expected_severity", "grade"])
        trim()
    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with expected_severity (double), grade (int, the highest that is at least
    as likely as not) and toxic (grade above 0); columns of these names are replaced.
    A null, empty or wordless text has no feature, so the base rate's severity."""
    plain = docs.drop("expected_severity", "grade", "toxic").withColumn(text, F.col(text).cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(_score(model, plain.columns.index(text)),
                            f"{fields}, expected_severity double, grade int").withColumn("toxic", F.col("grade") > 0)
