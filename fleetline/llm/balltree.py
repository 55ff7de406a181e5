"""Exact ranked lexical search: sparse ball trees over document vectors, best first.

A document is a sparse vector of term impacts in whole numbers; an item is one of term
counts, so a score is an inner product in 64-bit integers.  Only terms of the items'
own vocabulary enter a document's vector: others add nothing to any score.

Documents are dealt into blocks of bounded size as they are read, with no shuffle of
vectors, and each block gets a ball tree: a node has the centroid of its documents, the
radius of the ball around it, and per term how far a document lies above the centroid
at most.  No document below a node can score more than q.c + |q| r, nor more than the
sum of q (c + rise) over the item's terms; both are computed in doubles and widened by
more than their rounding error, and the smaller is the node's bound.  A search opens nodes in order of
their bounds and ends where the best bound left is below the k-th score, so whole
subtrees are never looked at; documents of leaves are scored exactly.  A search starts from the
k-th score among a bounded sample of documents, which the whole table can only raise.
Per block at most k documents an item leave a task.

Items are searched in groups of at most ``GROUP_BYTES`` of text (an item that is longer is
a group alone), so that what a task holds of them is bounded.

Cases: a null text has no term; documents and items without terms aren't found and find
nothing; ids may be of any type that can be ordered; a null document id comes last among equal scores; repeated rows are
documents of their own; of equal item rows one is searched, and different texts of one
item id are ranked apart; an empty table on either side gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import materialise, text_of

TOP = 20
#: documents and vector entries of a block, documents of a leaf
BLOCK_DOCS, BLOCK_ENTRIES, LEAF_DOCS = 16_384, 4_000_000, 96
#: documents whose scores start the search, on average
SAMPLE_DOCS = 8_192
GROUP_BYTES = 2 << 20
#: relative width added to bounds; doubles lose less than 2^-52 an operation, and a bound has under 10^5 of them
SLACK = 1e-9
#: letters and digits in UTF-8: A-Z lowered, a-z, 0-9 and all bytes from 128 on; any other byte parts terms
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _rows_of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places begin[i] .. end[i] - 1 of all i, one after the other."""
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Node:
    __slots__ = ("lo", "hi", "terms", "centre", "rise", "radius", "left", "right")


class BallTree:
    """A ball tree over sparse vectors of positive integers.

    ``begin``: where each document's entries start, and the end; ``term``, ``value``: the
    entries.  ``place``: a document's rank by id, which decides between equal scores.
    """

    def __init__(self, begin: np.ndarray, term: np.ndarray, value: np.ndarray, place: np.ndarray, leaf: int = LEAF_DOCS):
        self.terms, local = np.unique(term, return_inverse=True)
        self.begin, self.term, self.value, self.leaf = begin, local, value, leaf
        self.order = np.arange(len(begin) - 1)
        self.square = np.add.reduceat(value.astype(float) ** 2, begin[:-1]) if len(self.order) else np.empty(0)
        self.root = self._grow(0, len(self.order))
        # entries in the order of the leaves, so that a leaf is one slice
        at = _rows_of(begin[:-1][self.order], begin[1:][self.order])
        n = np.diff(begin)[self.order]
        self.begin, self.term, self.value, self.place = np.r_[0, np.cumsum(n)], local[at], value[at], place[self.order]

    def _grow(self, lo: int, hi: int) -> Node:
        root = self._node(lo, hi)
        open_ = [root]
        while open_:
            node = open_.pop()
            if node.hi - node.lo > self.leaf:
                cut = self._split(node)
                node.left, node.right = self._node(node.lo, cut), self._node(cut, node.hi)
                open_ += [node.left, node.right]
        return root

    def _entries(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        docs = self.order[lo:hi]
        begin, end = self.begin[docs], self.begin[docs + 1]
        at = _rows_of(begin, end)
        return self.term[at], self.value[at].astype(float), np.r_[0, np.cumsum(end - begin)[:-1]]

    def _node(self, lo: int, hi: int) -> Node:
        node = Node()
        node.lo, node.hi, node.left, node.right = lo, hi, None, None
        term, value, first = self._entries(lo, hi)
        if not len(term):
            node.terms, node.centre, node.rise, node.radius = np.empty(0, np.int64), np.empty(0), np.empty(0), 0.0
            return node
        n_terms, size = len(self.terms), hi - lo
        centre, top = np.bincount(term, value, n_terms) / size, np.zeros(n_terms)
        np.maximum.at(top, term, value)
        # |d - c|^2 = |c|^2 + sum over d's entries of (d - c)^2 - c^2
        whole = float((centre**2).sum())
        apart = whole + np.add.reduceat((value - centre[term]) ** 2 - centre[term] ** 2, first)
        scale = whole + self.square[self.order[lo:hi]]
        node.radius = float(np.sqrt(np.maximum(apart, 0.0) + SLACK * scale).max())
        node.terms = np.flatnonzero(top)
        node.centre, node.rise = centre[node.terms], top[node.terms] - centre[node.terms]
        return node

    def _split(self, node: Node) -> int:
        """Parts a node's documents by which of two far ones they are nearer to; in halves if that parts badly."""
        lo, hi = node.lo, node.hi
        term, value, first = self._entries(lo, hi)
        dense = np.zeros(len(self.terms))
        dense[node.terms] = node.centre
        far = self._distances(term, value, first, lo, hi, dense).argmax()
        ends = np.r_[first, len(term)]
        one = np.zeros(len(self.terms))
        one[term[ends[far] : ends[far + 1]]] = value[ends[far] : ends[far + 1]]
        to_one = self._distances(term, value, first, lo, hi, one)
        other = to_one.argmax()
        two = np.zeros(len(self.terms))
        two[term[ends[other] : ends[other + 1]]] = value[ends[other] : ends[other + 1]]
        lean = to_one - self._distances(term, value, first, lo, hi, two)
        by_lean = np.argsort(lean, kind="stable")
        self.order[lo:hi] = self.order[lo:hi][by_lean]
        cut = int((lean <= 0).sum())
        size = hi - lo
        return lo + (cut if size // 8 < cut < size - size // 8 else size // 2)

    def _distances(self, term: np.ndarray, value: np.ndarray, first: np.ndarray, lo: int, hi: int, point: np.ndarray) -> np.ndarray:
        return self.square[self.order[lo:hi]] - 2 * np.add.reduceat(value * point[term], first) + float((point**2).sum())

    def _bound(self, node: Node, query: np.ndarray, weight: np.ndarray, norm: float) -> float:
        if not len(node.terms):
            return 0.0
        at = np.minimum(np.searchsorted(node.terms, query), len(node.terms) - 1)
        w = np.where(node.terms[at] == query, weight, 0.0)
        middle = float(w @ node.centre[at])
        return min(middle + norm * node.radius, middle + float(w @ node.rise[at])) * (1 + SLACK) + 1.0

    def search(self, query: np.ndarray, weight: np.ndarray, k: int, least: int = 1) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, document) of at least ``least``, in no order, and how many documents were scored."""
        at = np.searchsorted(self.terms, query)
        known = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == query) if len(self.terms) else np.zeros(len(query), bool)
        query, weight = at[known], weight[known]
        if not len(query):
            return [], 0
        wide, norm = weight.astype(float), float(np.sqrt((weight.astype(float) ** 2).sum())) * (1 + SLACK)
        dense = np.zeros(len(self.terms), np.int64)
        dense[query] = weight
        best: list[tuple[int, int, int]] = []  # score, less the place, document: the worst is first
        seen, n = 0, 0
        heap = [(-self._bound(self.root, query, wide, norm), n, self.root)]
        while heap:
            bound, _, node = heapq.heappop(heap)
            if -bound < least:
                break
            if node.left is not None:
                for child in (node.left, node.right):
                    own = self._bound(child, query, wide, norm)
                    if own >= least:
                        n += 1
                        heapq.heappush(heap, (-own, n, child))
                continue
            seen += node.hi - node.lo
            a, b = self.begin[node.lo], self.begin[node.hi]
            scores = np.add.reduceat(dense[self.term[a:b]] * self.value[a:b], self.begin[node.lo : node.hi] - a)
            for i in np.flatnonzero(scores >= least).tolist():
                found = (int(scores[i]), -int(self.place[node.lo + i]), int(self.order[node.lo + i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
                if len(best) == k:
                    least = max(least, best[0][0])
        return [(score, doc) for score, _, doc in best], seen


def item_groups(items: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[pa.Table]:
    """Distinct items (item_id, text) in groups of bounded size, one after the other."""
    rows = items.select("item_id", text_of().alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if total is None:
        return
    n = -(-int(total) * 2 // group_bytes) or 1
    dealt = materialise(rows.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "search-items") if n > 1 else rows.withColumn("g", F.lit(0))
    for g in range(n):
        own = dealt.filter(F.col("g") == g).drop("g").toArrow()
        if own.num_rows:
            yield own


def document_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), term (numbers in the vocabulary), tf of every document with a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                n, term, tf, keep = [], [], [], []
                for i, text in enumerate(some.column(1).to_pylist()):
                    found = terms_of(text)
                    if not found:
                        continue
                    own = Counter(map(get, found))
                    own.pop(None, None)
                    keep.append(i)
                    n.append(len(found))
                    term.append(list(own.keys()))
                    tf.append(list(own.values()))
                yield pa.record_batch([some.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(cut, f"doc_id {kind}, n long, term array<int>, tf array<long>")


class Impacts:
    """Whole-number weights of terms and lengths, from the statistics of all documents."""

    def __init__(self, n_docs: int, length: int, frequency: np.ndarray):
        self.n_docs, self.length = n_docs, length
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in frequency], np.int64)

    def of(self, n: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Impact of each entry; ``counts``: entries of each document of length ``n``."""
        m = np.repeat(75 + 25 * n * self.n_docs // self.length, counts)
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, docs, entries = [], 0, 0
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            some = b.slice(lo, 1024)
            held.append(some)
            docs += some.num_rows
            entries += pc.sum(pc.list_value_length(some.column("term"))).as_py() or 0
            if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, docs, entries = [], 0, 0
    if held and docs:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def tree_of(block: pa.RecordBatch, impacts: Impacts) -> tuple[BallTree, pa.Array]:
    """The tree of a block's documents that hold a term of the vocabulary with a weight, and their ids."""
    counts = block.column("term").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    term = _flat(block.column("term"))
    value = impacts.of(block.column("n").to_numpy(), counts, term, _flat(block.column("tf")))
    doc = np.repeat(np.arange(len(counts)), counts)[value > 0]
    term, value = term[value > 0], value[value > 0]
    own, first = np.unique(doc, return_index=True)
    ids = block.column("doc_id").take(pa.array(own))
    place = np.empty(len(own), np.int64)
    place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(own))
    return BallTree(np.r_[first, len(term)].astype(np.int64), term, value, place), ids


def _search(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], impacts: Impacts, k: int, least: np.ndarray) -> DataFrame:
    """item (its number), doc_id, score: of each block the documents that may be among an item's k best."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, impacts, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, impacts, least = shared.value
        for block in _blocks(batches):
            tree, ids = tree_of(block, impacts)
            item, doc, score = [], [], []
            for i, (term, weight) in enumerate(queries):
                for s, d in tree.search(term, weight, k, max(1, int(least[i])))[0] if len(ids) else ():
                    item.append(i)
                    doc.append(d)
                    score.append(s)
            yield pa.record_batch([pa.array(item, pa.int32()), ids.take(pa.array(doc, pa.int64())), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"item int, doc_id {kind}, score long")


def search_group(docs: DataFrame, items: pa.Table, k: int = TOP, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score for one group of items."""
    spark = docs.sparkSession
    counted = [Counter(terms_of(t.encode())) for t in items.column("text").to_pylist()]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
    queries = []
    for c in counted:
        pairs = sorted((vocabulary[t], n) for t, n in c.items())
        queries.append((np.array([t for t, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int64)))
    vectors = materialise(document_terms(docs, vocabulary), "search-vectors")
    n_docs, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    for t, d in vectors.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # one row a term of the items at most
        frequency[t] = d
    impacts = Impacts(n_docs, length, frequency)
    vectors = vectors.filter(F.size("term") > 0)
    least = np.ones(len(queries), np.int64)
    share = -(-n_docs // sample_docs)
    if share > 1:
        some = _search(vectors.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0), queries, impacts, k, least)
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
        for i, s in some.withColumn("nth", nth).filter(F.col("nth") == k).select("item", "score").collect():  # one row an item of the group
            least[i] = s
    found = _search(vectors, queries, impacts, k, least)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"i": pa.array(range(items.num_rows), pa.int32()), "item_id": items.column("item_id")}))
    return found.join(F.broadcast(names), F.col("item") == F.col("i")).select("item_id", "rank", "doc_id", "score")  # a group's items: bounded by its bytes


def search(docs: DataFrame, items: DataFrame, k: int = TOP, *, group_bytes: int = GROUP_BYTES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score.

    ``docs``: doc_id, text.  ``items``: item_id, text.
    """
    out = None
    for group in item_groups(items, group_bytes):
        own = search_group(docs, group, k, sample_docs=sample_docs)
        out = own if out is None else out.unionByName(own)
    if out is None:
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id"))]
        return docs.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    return out


_SPLIT = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), {_LOWER}) AS text FROM documents),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '{_SPLIT}')) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT r, unnest(regexp_extract_all(text, '{_SPLIT}')) AS term FROM d),
s AS (SELECT r, count(*) AS n FROM t GROUP BY r),
st AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM s),
v AS (SELECT t.r, t.term, count(*) AS tf FROM t JOIN (SELECT DISTINCT term FROM q) u ON u.term = t.term GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM v GROUP BY term), st),
x AS (SELECT v.r, v.term, w.w * ((1000000000 * v.tf) // (1000 * v.tf + 12 * (75 + ((25 * s.n * st.nd) // st.l)))) AS impact FROM v JOIN w ON w.term = v.term JOIN s ON s.r = v.r, st),
b AS (SELECT q.item_id, x.r, CAST(sum(q.k * x.impact) AS BIGINT) AS score FROM q JOIN x ON x.term = q.term GROUP BY ALL HAVING sum(q.k * x.impact) > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT b.item_id, d.doc_id, b.score, row_number() OVER (PARTITION BY b.item_id ORDER BY b.score DESC, d.doc_id) AS rank FROM b JOIN d ON d.r = b.r) WHERE rank <= {TOP}
"""
