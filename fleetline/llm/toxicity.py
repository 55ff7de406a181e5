"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights + sum over pairs of terms of <v_i, v_j>): the
pairwise part learns that two terms together (an insult with a group mention) mean
more than their sum.  Terms are lower-cased runs of letters and the first four to six
letters of longer ones (inflected and compounded insults), hashed; a document is the
set of its terms.  The model is fitted on at most ``max_rows`` labelled rows of
distinct texts (the first by a hash of the id), and all hashed terms that say more about
the label than chance would get parameters.  Scoring reads every whole text.

Cases: null or empty texts get the score of a text with no known term; no labelled
rows, or labels of one kind only, give a constant score (the share of toxic rows, 0
if there are none); repeated label rows of an id count once, toxic if any says so;
null labels are left out.  Nothing but the text enters a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import LONGEST_TOKEN, TOKEN_CACHE, materialise, remainder, text_of

_TERM = re.compile(r"[^\W\d_]+")
MAX_ROWS = 16_000
LEAST_STEPS = 600
BUCKETS = 1 << 20


def words_of(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def buckets_of(word: str) -> list[int]:
    """Hashed terms of a word: itself and its stems."""
    terms = [word, *(f"{word[:n]}*" for n in (4, 5, 6) if n < len(word))]
    return [xxhash.xxh3_64_intdigest(t.encode()) % BUCKETS for t in terms]


@dataclass
class FactorizationMachine:
    bias: float
    buckets: np.ndarray  # sorted hashed terms with parameters
    weights: np.ndarray
    factors: np.ndarray  # one row per hashed term

    def scores(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n documents; document rows[i] has the known term cols[i]."""
        linear = np.bincount(rows, self.weights[cols], n)
        v = self.factors[cols]
        pairs = sum(np.bincount(rows, v[:, k], n) ** 2 - np.bincount(rows, v[:, k] ** 2, n) for k in range(v.shape[1])) if len(rows) else 0
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * pairs, -30, 30)))


def _train(buckets: np.ndarray, docs: list[list[int]], y: np.ndarray, *, rank: int, epochs: int, rate: float, decay: float, seed: int) -> FactorizationMachine:
    """Fit on documents given as places in ``buckets`` (sorted hashed terms)."""
    share = float(y.mean()) if len(y) else 0.0
    bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if share in (0.0, 1.0):
        return FactorizationMachine(bias, np.empty(0, np.int64), np.empty(0), np.empty((0, rank)))
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    cols = np.fromiter((c for d in docs for c in d), np.int64, len(rows))
    start = np.searchsorted(rows, np.arange(len(docs) + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), rank))
    moments = [np.zeros_like(x) for x in (w, v, w, v)]
    b, step = bias, 0
    batch = min(256, max(16, len(docs) // 16))
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(docs)))):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            at = np.concatenate([np.arange(start[i], start[i + 1]) for i in some])
            r, c = np.repeat(np.arange(len(some)), start[some + 1] - start[some]), cols[at]
            vc = v[c]
            total = np.zeros((len(some), rank))
            np.add.at(total, r, vc)
            square = np.zeros((len(some), rank))
            np.add.at(square, r, vc * vc)
            z = b + np.bincount(r, w[c], len(some)) + 0.5 * (total**2 - square).sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            gw = np.bincount(c, err[r], len(w)) + decay * w
            gv = decay * v
            np.add.at(gv, c, err[r][:, None] * (total[r] - vc))
            b -= rate * err.sum()
            step += 1
            for x, g, m, s in ((w, gw, 0, 2), (v, gv, 1, 3)):
                moments[m] = 0.9 * moments[m] + 0.1 * g
                moments[s] = 0.999 * moments[s] + 0.001 * g * g
                x -= rate * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[s] / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(float(b), buckets, w, v)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_rows: int = MAX_ROWS, rank: int = 4, epochs: int = 12, rate: float = 0.02, decay: float = 2e-5, seed: int = 3) -> FactorizationMachine:
    """Fit on the texts of ``docs`` (doc_id, text) whose id ``labels`` (doc_id, label) marks.

    At most ``max_rows`` ids are used: those first in the order of a hash.
    """
    marked = labels.select(F.col("doc_id").alias("m_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("m_id").agg(F.max("y").alias("y"))
    marked = marked.orderBy(F.xxhash64(F.lit(seed), "m_id"), "m_id").limit(max_rows)
    some = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(marked), F.col("doc_id") == F.col("m_id"))

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({b for w in words_of(t) for b in buckets_of(w)}))

    some = some.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("y").alias("y"))  # copies count once
    rows = materialise(some.select("h", "y", hashed("text").alias("terms")), "toxic-terms")
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("share")).first()
    share = F.lit(min(max(total["share"], 1e-9), 1 - 1e-9))
    stats = rows.select("y", F.explode("terms").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    gain = part(F.col("n1"), F.col("n") * share) + part(F.col("n") - F.col("n1"), F.col("n") * (1 - share))
    stats = stats.select("b", "n", gain.alias("gain"))
    # more than the best of as many unrelated terms would show
    least = math.log(max(1, stats.count()))
    best = stats.filter(F.col("gain") >= least).select("b").toArrow()  # of BUCKETS at most
    buckets = np.sort(best.column("b").to_numpy().astype(np.int64))
    place = {int(b): i for i, b in enumerate(buckets)}

    @F.pandas_udf("array<int>")
    def known(terms: pd.Series) -> pd.Series:
        return terms.map(lambda ts: [place[t] for t in ts if t in place])

    sample = rows.select("h", "y", known("terms").alias("at")).orderBy("h").toPandas()
    return _train(buckets, list(sample["at"]), sample["y"].to_numpy(float), rank=rank, epochs=epochs, rate=rate, decay=decay, seed=seed)


class _Known(dict):
    """word -> places of the parameters of its terms."""

    def __init__(self, ids: np.ndarray):
        self.place = {int(b): i for i, b in enumerate(ids)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        at = tuple(self.place[b] for b in buckets_of(word) if b in self.place)
        if len(self) < TOKEN_CACHE and len(word) <= LONGEST_TOKEN:
            self[word] = at
        return at


def toxicity_score(model: FactorizationMachine, text: Column) -> Column:
    """Probability that a text is toxic, as a column."""
    known = None

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        nonlocal known
        if known is None:
            known = _Known(model.buckets)
        found = [np.fromiter({at for w in words_of(x) for at in known[w]}, np.int64) for x in texts]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        cols = np.concatenate(found) if found else np.empty(0, np.int64)
        return pd.Series(model.scores(rows, cols, len(found)))

    return score(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns only from rows whose crc32 of the id as text mod 5 isn't 0.
    """
    held = remainder(5) == 0
    model = fit_toxicity(docs.filter(~held), labels, **options)
    out = docs.select(F.col("doc_id"), held.alias("held_out"), toxicity_score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
