"""Katz backoff language model: counts, exact backoff weights and scoring as Spark jobs.

Tokens are words (A-Z lower-cased, split at ASCII white space), then one end per text;
the first token follows a start.  log10 probabilities follow the recursion

    P(w | h) = p(h, w)            if the pair (h, w) was seen
             = alpha(h) * P(w)    otherwise,    P(unknown w) = the unseen mass

with Good-Turing discounted counts up to ``GT_MAX``, and alpha(h) = (1 - sum of p(h, .))
/ (1 - sum of P(.) over the same words), so every history's probabilities sum to one
exactly.  No count is dropped.

Words are coded: the ``head`` most frequent ones (a fixed bound, broadcast) by rank, all
others by hash.  Every text's pairs are sorted and packed inside its task and shipped to
a bucket chosen by the history; a history that would fill much of a bucket is dealt over
several by the next word.  Buckets hold about ``bucket_tokens`` tokens, so their number
grows with the corpus.  A bucket counts its pairs, writes them as its part of the model,
and evaluates the tokens that meet a seen pair: what depends on the discounts, which are
known only when all buckets are done, stays symbolic (how many pairs of each small count).
Tokens that don't meet one go down the recursion: they are joined with the table of
backoff weights by history, and with that of words.

The model's tables (all in the shared folder): ``words`` (key, c); ``pairs`` (ctx, words,
counts; one row per history and bucket); ``backoff`` (ctx, c, below, alpha).

Cases: null and empty texts are one end token; a training set without rows gives every
text the score 0 (nothing is known: P(unknown) = 1); repeated rows count each, in
training and in the result; ids may be of any type; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import materialise, mix, remainder, scratch_path, text_of

GT_MAX = 5
HEAD = 1 << 20
BUCKET_TOKENS = 4_000_000
#: parts of a bucket that its task counts one after the other, which bounds its memory
SLICES = 8
#: tokens that a task packs at a time
GROUP_TOKENS = 1_000_000
#: distinct words whose codes a Python worker remembers
WORD_CACHE, WORD_CACHE_BYTES = 200_000, 32 << 20
_TAIL = np.uint64(1 << 63)  # codes of words outside the head
_NONE = np.uint32(0xFFFFFFFF)
START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))  # no word holds a space
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))

#: rows of the buckets' result, by kind
KINDS = 7
DOC, PAIRS, TIMES, HISTORY, TAIL_PAIR, TAIL_WORD, UNSEEN = range(KINDS)
_RESULT = (
    "kind int, id long, w long, m int, n_tokens long, known long, n long, nb long, nk long, "
    "x double, base double, hist array<int>, words array<long>, counts array<long>, least long"
)


def discounts(n_r: dict[int, int], most: int = GT_MAX) -> list[float]:
    """Discount factors of the counts 0..most (0 unused): Good-Turing as Katz scales it.

    Falls back to an absolute discount where the counts of counts don't allow it.
    """
    n = [n_r.get(r, 0) for r in range(most + 2)]
    if all(n[1:]):
        a = (most + 1) * n[most + 1] / n[1]
        d = [1.0] + [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a < 1 else 2.0 for r in range(1, most + 1)]
        if all(0 < x < 1 for x in d[1:]):
            return d
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    return [1.0] + [(r - min(cut, 0.9)) / r for r in range(1, most + 1)]


def _discounted(c: Column, d: list[float]) -> Column:
    return c * F.when(c <= GT_MAX, F.element_at(F.array(*[F.lit(x) for x in d]), (F.least(c, F.lit(GT_MAX)) + 1).cast("int"))).otherwise(1.0)


def _runs(values: np.ndarray) -> np.ndarray:
    """Places where a new run of a sorted array begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint64).view(np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """key, c of every word and the end; the start is counted too (its key: START)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n_held = worker_codes("", None), [], 0

        def counted() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(_signed(key)), pa.array(n)], ["key", "c"])

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = known.of([t.lower().split() for t in b.column(0).slice(lo, 500).to_pylist()])
                held += [*some, np.repeat(np.array([START, END]), len(some))]
                n_held += sum(map(len, some)) + 2 * len(some)
                if n_held >= GROUP_TOKENS:
                    yield counted()
                    held, n_held = [], 0
        if held:
            yield counted()

    return train.select(text_of().cast("binary").alias("text")).mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


class Head:
    """The most frequent words: sorted keys, their counts, and the model's unigram facts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n: int, v: int, d1: list[float], unseen: float, starts: int, buckets: int):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], np.r_[counts[order], starts]
        self.start = len(keys)  # the code of the start
        self.n, self.v, self.unseen, self.buckets = n, v, unseen, buckets
        self.factors = np.array([*d1, 1.0]) if d1 else None

    def p(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of words of the head."""
        c = self.counts[codes.astype(np.int64)].astype(float)
        if self.factors is None:
            return c / (self.n + 1)
        return self.factors[np.minimum(c, GT_MAX + 1).astype(np.int64)] * c / max(self.n, 1)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """Place among the head's keys, or the hash with its first bit set."""
        if not len(self.keys):
            return keys | _TAIL
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at.astype(np.uint64), keys | _TAIL)

    def bucket(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        splits = self.splits_of(ctx)
        own = mix(ctx, ctx)
        own = np.where(splits > 1, own + mix(ctx, word) % splits, own)
        return (own % np.uint64(self.buckets)).astype(np.int64)

    def slice(self, ctx: np.ndarray) -> np.ndarray:
        return (mix(ctx, ctx) >> np.uint64(40)).astype(np.int64) % SLICES

    def splits_of(self, ctx: np.ndarray) -> np.ndarray:
        """Over how many buckets a history is dealt: more than one if it has over an eighth of a bucket's tokens."""
        parts = np.where(ctx < _TAIL, self.counts[np.where(ctx < _TAIL, ctx, 0).astype(np.int64)], 0) * 8 * self.buckets // max(self.n, 1) + 1
        return np.minimum(parts, self.buckets).astype(np.uint64)


class WordCodes(dict):
    """word -> code (without a head: hash), emptied when it grows too large; frequent words come back at once."""

    def __init__(self, head: Head | None):
        self.head, self.held = head, 0

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self) > WORD_CACHE or self.held > WORD_CACHE_BYTES:
            self.clear()
            self.held = 0
        if fresh := list(set().union(*texts) - self.keys()):
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
            self.held += sum(map(len, fresh))
            self.update(zip(fresh, (self.head.codes(keys) if self.head else keys).tolist()))
        get = self.__getitem__
        return [np.fromiter(map(get, words), np.uint64, len(words)) for words in texts]


_WORKER: dict = {}


def worker_codes(model: str, head: Broadcast | None) -> WordCodes:
    """This worker's word codes for one model; they outlive a task."""
    if _WORKER.get("model") != model:
        _WORKER["model"], _WORKER["codes"] = model, WordCodes(head.value if head else None)
    return _WORKER["codes"]


def forget_codes() -> None:
    _WORKER.clear()


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte, so that like bytes stand together, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays), 1)


def _unplanes(data: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.decompress(data), np.uint8), 0, []
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _pack(ctx: np.ndarray, word: np.ndarray, slot: np.ndarray) -> bytes:
    """Tokens sorted by history and word, without what repeats."""
    pair = _runs_of_two(ctx, word)
    c, w = ctx[pair], word[pair]
    hist = _runs(c)
    far = w >= _TAIL
    sizes = np.array([len(hist), len(pair), int(far.sum()), len(ctx)], "<u4").tobytes()
    return sizes + _planes(
        c[hist], w[far], np.diff(np.r_[hist, len(pair)]).astype("<u4"), np.where(far, _NONE, w).astype("<u4"), np.diff(np.r_[pair, len(ctx)]).astype("<u4"), slot.astype("<u2")
    )


def _unpack(data: bytes) -> tuple:
    """History and word of the pairs, tokens per pair, slot of every token."""
    n_hist, n_pairs, n_far, n_tokens = np.frombuffer(data, "<u4", 4).tolist()
    hist, far, per_hist, low, per_pair, slot = _unplanes(data[16:], ("<u8", n_hist), ("<u8", n_far), ("<u4", n_hist), ("<u4", n_pairs), ("<u4", n_pairs), ("<u2", n_tokens))
    word = low.astype(np.uint64)
    word[low == _NONE] = far
    return np.repeat(hist, per_hist), word, per_pair.astype(np.int64), slot


def _runs_of_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)


def _packed(docs: DataFrame, model: str, head: Broadcast) -> DataFrame:
    """bucket, facts (of texts) or tokens of ``docs`` (rid, train, text).

    tokens: the texts they are from, then the packed tokens of each slice of the bucket.
    """

    def group(codes: list[np.ndarray], rids: list[int], train: list[bool], h: Head) -> Iterator[tuple]:
        rid, is_train = np.array(rids, np.int64), np.array(train, bool)
        n = np.array([len(c) for c in codes], np.int64)
        flat, doc = np.concatenate(codes), np.repeat(np.arange(len(n)), n)
        in_head = flat < h.start  # of the head but the start
        at = flat[in_head].astype(np.int64)
        base = np.bincount(doc[in_head], np.log10(h.counts[at] + 1), len(n)) - (n - 1) * np.log10(h.n + h.v + 1)
        known = np.bincount(doc[in_head], minlength=len(n))
        inner = doc[1:] == doc[:-1]
        ctx, word, doc = flat[:-1][inner], flat[1:][inner], doc[1:][inner]
        # small numbers instead of codes: the head's as they are, then those of this group's other words
        others = np.unique(flat[flat >= _TAIL])
        small = lambda x: np.where(x < _TAIL, x, np.searchsorted(others, x).astype(np.uint64) + np.uint64(h.start + 1))
        bucket = h.bucket(ctx, word) * SLICES + h.slice(ctx)
        bits = np.uint64(int(h.start + 1 + len(others)).bit_length())
        if 2 * int(bits) + (h.buckets * SLICES).bit_length() <= 64:
            order = np.argsort(bucket.astype(np.uint64) << bits + bits | small(ctx) << bits | small(word))
        else:
            order = np.lexsort((small(word), small(ctx), bucket))
        ctx, word, doc, bucket = ctx[order], word[order], doc[order], bucket[order]
        cut = np.r_[_runs(bucket // SLICES), len(bucket)]
        for a, e in zip(cut[:-1], cut[1:]):
            own, slot = np.unique(doc[a:e], return_inverse=True)
            ends = a + np.searchsorted(bucket[a:e] % SLICES, np.arange(SLICES + 1))
            packed = [_pack(ctx[x:y], word[x:y], slot[x - a : y - a]) for x, y in zip(ends[:-1], ends[1:])]
            yield int(bucket[a] // SLICES), None, [rid[own].tobytes() + is_train[own].astype(np.uint8).tobytes(), *packed]
        facts = b"".join([rid.tobytes(), (n - 1).tobytes(), known.astype(np.int64).tobytes(), base.tobytes()])
        yield int(mix(rid[:1].view(np.uint64), rid[:1].view(np.uint64))[0] % np.uint64(h.buckets)), facts, None

    def rows(found: Iterator[tuple]) -> pa.RecordBatch:
        found = list(found)
        return pa.record_batch([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.list_(pa.binary()))], ["bucket", "facts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        known = worker_codes(model, head)
        start, end = np.array([h.start], np.uint64), h.codes(np.array([END]))
        codes, rids, train, total = [], [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                rids += some.column(0).to_pylist()
                train += some.column(1).to_pylist()
                for own in known.of([t.lower().split() for t in some.column(2).to_pylist()]):
                    codes.append(np.concatenate([start, own, end]))
                    total += len(own) + 2
                if total >= GROUP_TOKENS or len(codes) >= 60_000:
                    yield rows(group(codes, rids, train, h))
                    codes, rids, train, total = [], [], [], 0
        if codes:
            yield rows(group(codes, rids, train, h))

    return docs.mapInArrow(run, "bucket int, facts binary, tokens array<binary>")


def _result(kind: int, n: int, /, **columns) -> pa.RecordBatch:
    """n rows of the buckets' result; columns not named are null."""
    types = {"kind": pa.int32(), "m": pa.int32(), "x": pa.float64(), "base": pa.float64(), "hist": pa.list_(pa.int32()), "words": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    columns["kind"] = np.full(n, kind, np.int32)
    names = [f.split()[0] for f in _RESULT.split(", ")]
    arrays = []
    for name in names:
        t = types.get(name, pa.int64())
        x = columns.get(name)
        arrays.append(pa.nulls(n, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t))
    return pa.record_batch(arrays, names)


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of GT_MAX numbers as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * GT_MAX, pa.int32()), pa.array(x.ravel().astype(np.int32)))


def _count_bucket(facts: list[bytes], tokens: list[list[bytes]], h: Head) -> Iterator[pa.RecordBatch]:
    """Count and evaluate what came to one bucket, a slice at a time."""
    for data in facts:
        n = len(data) // 32
        rid, n_tokens, known = np.frombuffer(data, "<i8", 3 * n).reshape(3, n)
        yield _result(DOC, n, id=rid, m=np.ones(n, np.int32), n_tokens=n_tokens, known=known, base=np.frombuffer(data, "<f8", n, 24 * n), x=np.zeros(n))
    if not tokens:
        return
    n_docs = [len(t[0]) // 9 for t in tokens]
    rids, own = np.unique(np.concatenate([np.frombuffer(t[0], "<i8", n) for t, n in zip(tokens, n_docs)]), return_inverse=True)
    is_train = np.zeros(len(rids), bool)
    is_train[own] = np.concatenate([np.frombuffer(t[0], "u1", n, 8 * n) for t, n in zip(tokens, n_docs)]).astype(bool)  # rows equal in id and text are on the same side
    first = np.cumsum([0] + n_docs)
    total, times = np.zeros(len(rids)), np.zeros((len(rids), GT_MAX), np.int64)
    for k in range(1, SLICES + 1):
        parts = [_unpack(t[k]) for t in tokens]
        ctx, word, per_pair = (np.concatenate([p[i] for p in parts]) for i in range(3))
        doc = np.concatenate([own[at + p[3].astype(np.int64)].astype(np.int32) for p, at in zip(parts, first)])
        del parts
        if len(doc):
            yield from _count_slice(ctx, word, per_pair, doc, rids, is_train, total, times, h)
    n = len(rids)
    zero = np.zeros(n, np.int64)
    yield _result(DOC, n, id=rids, m=np.zeros(n, np.int32), n_tokens=zero, known=zero, base=np.zeros(n), x=total, hist=_fixed(times))


def _count_slice(ctx: np.ndarray, word: np.ndarray, per_pair: np.ndarray, doc: np.ndarray, rids: np.ndarray, is_train: np.ndarray, total: np.ndarray, times: np.ndarray, h: Head) -> Iterator[pa.RecordBatch]:
    """Count and evaluate the histories of one slice; adds to texts' ``total`` and ``times``."""
    # the distinct pairs, in order of history and word, and the pair of every token
    key = mix(ctx, word)
    order = np.argsort(key)
    at = _runs(key[order])
    pair_of = np.empty(len(key), np.int64)
    pair_of[order] = np.cumsum(np.bincount(at, minlength=len(key))) - 1
    ctx, word = ctx[order[at]], word[order[at]]
    order = np.lexsort((word, ctx))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ctx, word, pair = ctx[order], word[order], np.repeat(rank[pair_of], per_pair)
    del key, order, rank, pair_of, per_pair
    c = np.bincount(pair[is_train[doc]], minlength=len(ctx)).astype(np.int64)

    hist = _runs(ctx)  # of each distinct history: its first pair
    hist_of = np.repeat(np.arange(len(hist)), np.diff(np.r_[hist, len(ctx)]))
    histories = ctx[hist]
    split = h.splits_of(histories) > 1
    c_hist = np.add.reduceat(c, hist)
    in_head = histories < _TAIL
    c_hist[in_head] = h.counts[histories[in_head].astype(np.int64)]
    large = np.where(c > 0, c, np.iinfo(np.int64).max)
    least = np.minimum.reduceat(large, hist)  # the smallest count of a seen pair here
    # a history all of whose mass is kept still leaves one count's share to the rest
    full = (least > GT_MAX) & (c_hist > 0)
    below = c_hist + (full & ~split)
    word_in_head = word < _TAIL
    p_word = np.zeros(len(word))
    p_word[word_in_head] = h.p(word[word_in_head])

    # the model: seen pairs and sums by history
    seen = c > 0
    n_r = np.bincount(np.minimum(c[seen], GT_MAX + 2), minlength=GT_MAX + 3)[: GT_MAX + 2]
    yield _result(TIMES, GT_MAX + 1, id=np.arange(1, GT_MAX + 2), n=n_r[1:])
    live = c_hist > 0
    kept_hist = np.bincount(hist_of[seen], minlength=len(hist))
    small = np.array([np.bincount(hist_of[c == r], minlength=len(hist)) for r in range(1, GT_MAX + 1)]).T
    most = np.bincount(hist_of, np.where(c > GT_MAX, c, 0), len(hist)).astype(np.int64)
    some = live & (kept_hist > 0)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, kept_hist[some]]), pa.int32()), pa.array(x, pa.int64()))
    yield _result(PAIRS, int(some.sum()), id=_signed(histories[some]), words=lists(_signed(word[seen])), counts=lists(c[seen]))
    yield _result(
        HISTORY, int(some.sum()), id=_signed(histories[some]), n=c_hist[some], nk=most[some], least=least[some], hist=_fixed(small[some]),
        x=np.bincount(hist_of, np.where(seen, p_word, 0.0), len(hist))[some],
    )
    far = seen & ~word_in_head
    yield _result(TAIL_PAIR, int(far.sum()), id=_signed(ctx[far]), w=_signed(word[far]))

    # the tokens
    k, n_docs = c[pair], len(rids)
    ok = k > 0
    x = np.zeros(len(c))
    x[seen] = np.log10(c[seen]) - np.log10(below[hist_of[seen]])
    x[~seen & word_in_head] = np.log10(p_word[~seen & word_in_head])
    total += np.bincount(doc, x[pair], n_docs)
    for r in range(1, GT_MAX + 1):
        times[:, r - 1] += np.bincount(doc[k == r], minlength=n_docs)
    far = ~word_in_head[pair]
    yield _result(TAIL_WORD, int(far.sum()), id=rids[doc[far]], w=_signed(word[pair[far]]), n=np.ones(int(far.sum()), np.int64), nb=(~ok[far]).astype(np.int64))
    # not seen, or seen under a history whose share for the rest other buckets decide
    open_ = (~ok & live[hist_of[pair]]) | (ok & (full & split)[hist_of[pair]])
    d, g, seen_ = doc[open_], hist_of[pair[open_]], ok[open_]
    order = np.lexsort((g, d))
    d, g, seen_ = d[order], g[order], seen_[order]
    at = _runs_of_two(d, g)
    if len(at):
        nk = np.add.reduceat(seen_.astype(np.int64), at)
        yield _result(UNSEEN, len(at), id=_signed(histories[g[at]]), w=rids[d[at]], nb=np.diff(np.r_[at, len(d)]) - nk, nk=nk)


def _counted(docs: DataFrame, model: str, head: Broadcast) -> str:
    """Path of the buckets' result: a table partitioned by kind, a file per task and kind; a reader of a kind opens its files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_codes()  # room for the bucket
        facts, tokens = [], []
        for b in batches:
            facts += b.column("facts").drop_null().to_pylist()
            tokens += b.column("tokens").drop_null().to_pylist()
        yield from _count_bucket(facts, tokens, head.value)

    path = scratch_path(docs.sparkSession, "katz-counts")
    rows = _packed(docs, model, head).groupBy("bucket").applyInArrow(run, _RESULT)
    conf, name = docs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(max(int(before), KINDS + 1)))  # a task keeps a file of each kind open, so its rows needn't be sorted by kind
    try:
        rows.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    finally:
        conf.set(name, before)
    return path


@dataclass
class KatzModel:
    """words (key, c); pairs (ctx, words, counts); backoff (ctx, c, below, alpha: log10).

    In ``pairs`` and ``backoff`` words are codes: places in ``head.keys``, then the
    start, or hashes with their first bit set.  n: training tokens, v: distinct ones.
    """

    words: DataFrame
    pairs: DataFrame
    backoff: DataFrame
    head: Head
    n: int
    v: int
    d1: list[float]
    d2: list[float]
    unseen: float


def train_and_score(docs: DataFrame, is_train: Column, *, head: int = HEAD, bucket_tokens: int = BUCKET_TOKENS) -> tuple[DataFrame, KatzModel]:
    """Learn from the rows of ``docs`` (doc_id, text) that ``is_train`` marks, and score all rows.

    Returns doc_id, train, n_tokens, n_known, base_score, score of every row, and the model.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(is_train, F.lit(False)).alias("train"), text_of().alias("text"), F.xxhash64("doc_id", text_of(), F.coalesce(is_train, F.lit(False))).alias("rid"))
    start = int(START.view(np.int64))
    words = materialise(word_counts(own.filter("train")), "katz-words")
    is_start = F.col("key") == start
    facts = words.agg(
        F.coalesce(F.sum(F.when(~is_start, F.col("c"))), F.lit(0)).alias("n"), F.count(F.when(~is_start, 1)).alias("v"), F.coalesce(F.max(F.when(is_start, F.col("c"))), F.lit(0)).alias("starts"),
        *[F.count(F.when(~is_start & (F.col("c") == r), 1)).alias(f"n{r}") for r in range(1, GT_MAX + 2)],
    ).first()
    n, v = facts["n"], facts["v"]
    tokens = words.filter(~is_start)
    d1 = discounts({r: facts[f"n{r}"] for r in range(1, GT_MAX + 2)})
    unseen = 1.0 - (tokens.agg(F.sum(_discounted(F.col("c"), d1) / F.lit(float(max(n, 1))))).first()[0] or 0.0)
    if unseen < 1e-9:
        d1, unseen = [], 1.0 / (n + 1)
    # texts of held-out rows come to the buckets too; a word takes about six characters
    total = docs.select(F.sum(F.length(text_of())).alias("n")).first()["n"] or 0
    top = tokens.orderBy(F.desc("c"), "key").limit(head).toArrow()
    keys, counts = top.column("key").to_numpy().astype(np.int64), top.column("c").to_numpy().astype(np.int64)
    buckets = max(1, -(-total // (6 * bucket_tokens)))
    found = Head(keys.view(np.uint64), counts, n, v, d1, unseen, facts["starts"], buckets)
    if len(keys) < head or not head:
        rest = tokens.limit(0) if head else tokens
    else:  # what comes after the last of the head, in the same order
        rest = tokens.filter((F.col("c") < int(counts[-1])) | ((F.col("c") == int(counts[-1])) & (F.col("key") > int(keys[-1]))))
    sent = spark.sparkContext.broadcast(found)

    path = _counted(own.select("rid", "train", F.col("text").cast("binary").alias("text")), uuid.uuid4().hex, sent)
    kind = lambda k: spark.read.schema(_RESULT).parquet(path).filter(F.col("kind") == k)
    d2 = discounts({r["id"]: r["n"] for r in kind(TIMES).groupBy("id").agg(F.sum("n").alias("n")).collect()})

    # words outside the head, for histories (sum of their probabilities) and for texts
    p = _discounted(F.col("c"), d1) / F.lit(float(max(n, 1))) if d1 else F.col("c") / F.lit(float(n + 1))
    rest = rest.select(F.col("key").bitwiseOR(F.lit(-(1 << 63)).cast("long")).alias("w"), "c", p.alias("p"))
    asked = kind(TAIL_PAIR).select("id", "w", F.lit(0).alias("n"), F.lit(0).alias("nb"), F.lit(True).alias("of_history"))
    asked = asked.unionByName(kind(TAIL_WORD).select("id", "w", "n", "nb", F.lit(False).alias("of_history")))
    met = asked.join(rest, "w", "left").groupBy("of_history", "id").agg(
        F.sum("p").alias("p"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("known"), F.sum(F.log10(F.col("c") + 1) * F.col("n")).alias("base"),
        F.sum(F.log10(F.coalesce("p", F.lit(unseen))) * F.col("nb")).alias("x"),
    )
    met = materialise(met, "katz-tail")

    hist = kind(HISTORY).groupBy("id").agg(
        F.max("n").alias("c"), F.sum("nk").alias("most"), F.sum("x").alias("p"), F.min("least").alias("least"), *[F.sum(F.col("hist")[r - 1]).alias(f"m{r}") for r in range(1, GT_MAX + 1)]
    )
    hist = hist.join(met.filter("of_history").select("id", F.col("p").alias("p_tail")), "id", "left")
    mass = F.col("most") + sum(F.col(f"m{r}") * F.lit(r * d2[r]) for r in range(1, GT_MAX + 1))
    below = F.col("c") + F.when(F.col("least") > GT_MAX, 1).otherwise(0)
    p_seen = F.col("p") + F.coalesce("p_tail", F.lit(0.0))
    alpha = F.when(1 - p_seen > 1e-12, (1 - mass / below) / (1 - p_seen)).otherwise(1.0)
    backoff = materialise(hist.select(F.col("id").alias("ctx"), "c", below.alias("below"), F.log10(alpha).alias("alpha")), "katz-backoff")

    # down the recursion: the backoff weight of the history for tokens whose pair wasn't seen
    log = [float(np.log10(x)) for x in d2]
    first = kind(DOC).select("id", "m", "n_tokens", "known", "base", (F.col("x") + sum(F.coalesce(F.col("hist")[r - 1], F.lit(0)) * F.lit(log[r]) for r in range(1, GT_MAX + 1))).alias("x"))
    none = lambda *names: [F.lit(0).cast("long").alias(x) for x in names]
    tail = met.filter("NOT of_history").select("id", *none("m", "n_tokens"), F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("x", F.lit(0.0)).alias("x"))
    down = kind(UNSEEN).select(F.col("id").alias("ctx"), F.col("w").alias("id"), "nb", "nk").join(backoff, "ctx")
    share = F.when(F.col("below") > F.col("c"), F.log10(F.col("below") / F.col("c"))).otherwise(0.0)
    down = down.select("id", *none("m", "n_tokens", "known"), F.lit(0.0).alias("base"), (F.col("nb") * F.col("alpha") - F.col("nk") * share).alias("x"))
    sums = first.unionByName(tail).unionByName(down).groupBy("id").agg(*[F.sum(x).alias(x) for x in ("m", "n_tokens", "known", "base", "x")])
    # rows equal in id and text share a key: `m` of them, each with the same sums
    m = F.col("m")
    out = own.select("doc_id", "train", "rid").join(sums, F.col("rid") == F.col("id"))
    out = out.select("doc_id", "train", (F.col("n_tokens") / m).cast("long").alias("n_tokens"), (F.col("known") / m).cast("long").alias("n_known"), (F.col("base") / m).alias("base_score"), (F.col("x") / m).alias("score"))
    pairs = kind(PAIRS).select(F.col("id").alias("ctx"), "words", "counts")
    return out, KatzModel(words, pairs, backoff, found, n, v, d1, d2, unseen)


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows whose crc32 of the id as text mod 7 isn't 2.
    """
    out, model = train_and_score(docs, remainder(7) != 2, **options)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
