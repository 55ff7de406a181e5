"""Near-duplicate detection by Order MinHash and banded alignment.

A text is its words (A-Z lower-cased, split at ASCII white space).  Its k-mers are the
runs of ``width`` words, each labelled with its occurrence number.  For each of
``sketches`` random orders the ``minima`` smallest k-mers are taken and *kept in text
order*: two texts share that entry if they share these k-mers in the same order, which
makes it sensitive to edit similarity.  Texts that share an entry are candidates, and
every two candidates end up in one class or are compared.  First, in every bucket each
text is compared with the bucket's smallest, those that fail again with the smallest of
the rest, ``rounds`` times; so groups of any size need about one comparison a member.
Then the buckets that still hold several classes are cut into blocks of about ``block``
texts, and texts of two classes in two blocks are compared where the blocks meet; only
links leave, and no bucket is ever gathered in one place.  A comparison counts words by bins first: the counts bound the edits from
below, so what they rule out can't be similar.  The rest is verified by word alignment
inside a diagonal band just wide enough for the edits that ``min_similarity`` allows:
similarity = 1 - edits / words of the longer text.  Alignment takes memory in proportion
to the texts' length.  Verified links are closed
to classes by alternating large-star and small-star steps.

Copies of a text share one node (a 64-bit hash of the text), so only different texts
are ever sketched into buckets, compared or linked.

Cases: null counts as the empty text, and empty texts are copies of each other; texts
shorter than ``width`` words are one k-mer; null ids and repeated rows are members like
any other; a class's id is its smallest id (null if all are null); an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import HashCache, free_kept, hashes, materialise, mix, text_of, window_hashes

WIDTH = 5
SKETCHES = 32
MINIMA = 3
ROUNDS = 3
BLOCK = 512
MIN_SIMILARITY = 0.8
_BINS, _COARSE = 512, 128  # words are counted by so many bins; first compared by fewer
_PLACES = 24  # bits that hold a k-mer's place in its text
_CHUNK = 1 << 16  # k-mers hashed at a time
_SHORT = 4096  # up to so many words, an alignment holds a mask for every word


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def labelled_kmers(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of every k-mer, mixed with how often it occurred before in the text."""
    h = window_hashes(words, min(width, len(words))) if len(words) else words
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.r_[False, s[1:] == s[:-1]] if len(s) else np.empty(0, bool)
    if not same.any():
        return h
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(same, 0, at))
    out = h.copy()
    out[order] = np.where(nth > 0, mix(s, nth.astype(np.uint64)), s)
    return out


class OrderMinHash:
    def __init__(self, sketches: int = SKETCHES, minima: int = MINIMA, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.minima = minima
        self.a = rng.integers(1, 1 << 63, (sketches, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (sketches, 1), dtype=np.uint64)
        self.salt = rng.integers(0, 1 << 63, sketches, dtype=np.uint64)

    def __call__(self, kmers: np.ndarray) -> np.ndarray:
        """One hash per sketch: its smallest k-mers in text order."""
        n = len(kmers)
        if n == 0:
            return np.empty(0, np.uint64)
        if n > self.minima:
            low = np.uint64((1 << _PLACES) - 1)
            best = np.empty((len(self.salt), 0), np.uint64)
            for lo in range(0, n, _CHUNK):
                x = (kmers[None, lo : lo + _CHUNK] ^ self.b) * self.a
                x ^= x >> np.uint64(32)
                x = (x * np.uint64(0xD6E8FEB86659FD93)) & ~low | (np.arange(lo, lo + x.shape[1], dtype=np.uint64) & low)[None, :]
                best = np.concatenate([best, x], axis=1)
                best = np.partition(best, self.minima - 1, axis=1)[:, : self.minima] if best.shape[1] > self.minima else best
            places = np.sort((best & low).astype(np.int64), axis=1)
            picked = kmers[places]
        else:
            picked = np.broadcast_to(kmers, (len(self.salt), n))
        out = self.salt
        for j in range(picked.shape[1]):
            out = mix(out, picked[:, j])
        return out


def _masks(a: list, most: int, width: int):
    """Function of a word and a row: bits of the row's band at which ``a`` has the word.

    Long texts have masks for their frequent words only, at most 1024 of them, and places
    for the others, so memory is in proportion to the length.
    """
    full, often = (1 << width) - 1, 0 if len(a) <= _SHORT else max(1, len(a) >> 10)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    masks: dict = {}
    for x in [x for x, at in places.items() if len(at) > often]:
        bits = bytearray(len(a) + most + 8 >> 3)
        for i in places.pop(x):
            bits[i + most >> 3] |= 1 << (i + most & 7)
        masks[x] = int.from_bytes(bits, "little")

    def at_row(x, j: int) -> int:
        if (mask := masks.get(x)) is not None:
            return (mask >> j) & full
        out = 0
        for i in places.get(x, ()):
            if 0 <= i + most - j < width:
                out |= 1 << (i + most - j)
        return out

    return at_row


def banded_edits(a: list, b: list, most: int) -> int:
    """Edits (insert, delete, substitute) that turn a into b, or most + 1 if more.

    Bit-parallel alignment inside the diagonal band |i - j| <= most: one machine word
    of the band's width moves down the diagonal, a row of b at a time.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    most = min(most, max(n, m))
    width = 2 * most + 1
    full = (1 << width) - 1
    at_row = _masks(a, most, width)
    # bit k of a band row j stands for column i = j - most + k of a
    vp, vn = (full << most) & full, 0
    dist = most  # value on the band's lower border, here of row -1
    row = 0
    top = 1 << (width - 1)
    for j in range(m):
        eq = at_row(b[j], j)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        # move along the diagonal through the band's last column
        if not d0 & top:
            dist += 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
        row = j
        last = j + most  # column of a at the band's end
        if last >= n - 1:
            break
    # the band's end has reached a's last column: follow that column down
    if last > n - 1:
        return _edits(a, b, most)
    mask = top >> 1
    for j in range(row + 1, m):
        eq = at_row(b[j], j)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        dist += bool(hp & mask) - bool(hn & mask)
        mask >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
    return min(dist, most + 1)


def _edits(a: list, b: list, most: int) -> int:
    """The same without a band, for texts not longer than the band."""
    n = len(a)
    at_row = _masks(a, 0, n)
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, dist = full, 0, n
    for x in b:
        eq = at_row(x, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        dist += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | 1) & full
        vp = ((hn << 1) | ~(d0 | hp)) & full
        vn = d0 & hp
    return min(dist, most + 1)


def similar(a: bytes, b: bytes, min_similarity: float = MIN_SIMILARITY) -> float:
    """Edit similarity of the words of two texts; 0 if under ``min_similarity``."""
    x, y = words_of(a), words_of(b)
    longer = max(len(x), len(y))
    if not longer:
        return 1.0
    most = int((1 - min_similarity) * longer + 1e-9)
    edits = banded_edits(x, y, most)
    return 0.0 if edits > most else 1 - edits / longer


def word_bins(words: np.ndarray) -> bytes:
    """Number of words in each bin of their hashes, 255 at most."""
    return np.minimum(np.bincount((words & np.uint64(_BINS - 1)).astype(np.int64), minlength=_BINS), 255).astype(np.uint8).tobytes()


def _may_match(n: np.ndarray, bins: np.ndarray, a: np.ndarray, b: np.ndarray, min_similarity: float) -> np.ndarray:
    """Whether texts a and b (places in n and bins) can be similar enough, pair by pair.

    An edit adds one word at most and takes one away at most, so there are no fewer
    edits than words too many on either side.
    """
    most = ((1 - min_similarity) * np.maximum(n[a], n[b]) + 1e-9).astype(np.int64)
    out = np.abs(n[a] - n[b]) <= most
    coarse = bins.reshape(len(bins), -1, _COARSE).sum(1, dtype=np.int16)
    for counts in (coarse, bins):
        at = np.flatnonzero(out)
        for lo in range(0, len(at), 1 << 14):
            k = at[lo : lo + (1 << 14)]
            d = counts[a[k]].astype(np.int16) - counts[b[k]]
            total = d.sum(1, dtype=np.int64)
            size = np.abs(d).sum(1, dtype=np.int64)
            out[k] = (size + np.abs(total)) // 2 <= most[k]
    return out


def _bins_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _BINS)


def sketch(docs: DataFrame, *, width: int = WIDTH, sketches: int = SKETCHES, minima: int = MINIMA) -> DataFrame:
    """node, sig, n_words, bins of every distinct text."""
    cache, hasher = HashCache(), OrderMinHash(sketches, minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_kept()
        for b in (batch.slice(lo, 500) for batch in batches for lo in range(0, batch.num_rows, 500)):
            words = [hashes(words_of(t), cache) for t in b.column(1).to_pylist()]
            sigs = [hasher(labelled_kmers(w, width)).view(np.int64) for w in words]
            cut = np.cumsum([0] + [len(s) for s in sigs]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            counts = [pa.array([len(w) for w in words], pa.int64()), pa.array(list(map(word_bins, words)), pa.binary())]
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)), *counts], ["node", "sig", "n_words", "bins"])

    rows = docs.select(F.xxhash64(text_of()).alias("node"), text_of().cast("binary").alias("text"))
    found = rows.mapInArrow(run, "node long, sig array<long>, n_words long, bins binary")
    return found.groupBy("node").agg(F.first("sig").alias("sig"), F.first("n_words").alias("n_words"), F.first("bins").alias("bins"))


def _possible(edges: DataFrame, facts: DataFrame, min_similarity: float) -> DataFrame:
    """The edges (a, b) that the counts of words don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_kept()
        for batch in batches:
            k = batch.num_rows
            n = np.concatenate([batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)])
            bins = np.concatenate([_bins_of(batch.column(4)), _bins_of(batch.column(5))])
            ok = _may_match(n, bins, np.arange(k), np.arange(k, 2 * k), min_similarity)
            yield batch.select([0, 1]).filter(pa.array(ok))

    left, right = (facts.select(F.col("node").alias(x), F.col("n_words").alias(f"{x}_n"), F.col("bins").alias(f"{x}_bins")) for x in "ab")
    both = edges.join(right, "b").join(left, "a").select("a", "b", "a_n", "b_n", "a_bins", "b_bins")
    return both.mapInArrow(run, "a long, b long")


def _unresolved(shared: DataFrame, links: DataFrame, facts: DataFrame, texts: DataFrame, min_similarity: float, block: int) -> DataFrame:
    """Verified links (a, b, similarity) between classes that ``links`` don't join, but a bucket does.

    Two blocks of a bucket are compared where they meet, and only links leave: at most one
    less than there are classes in the two.  A pair is compared in the first bucket it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_kept()
        for batch in batches:
            out = []
            for band, i, j, rows in zip(*(batch.column(c) for c in range(4))):
                out += _links_between(band.as_py(), i.as_py(), j.as_py(), rows.values, min_similarity)
            a, b, s = zip(*out) if out else ((), (), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    rows = shared.join(components(links), "node", "left").select("band", "entry", "node", F.coalesce("root", "node").alias("root"))
    rows = materialise(rows, "omh-rooted")
    mixed = rows.groupBy("band", "entry").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band", "entry")
    mixed = materialise(rows.join(mixed, ["band", "entry"], "left_semi").join(facts, "node"), "omh-mixed")
    # blocks are bounded in texts and in words
    size = mixed.groupBy("band", "entry").agg(F.greatest(F.count(F.lit(1)), F.sum("n_words") / 1000).alias("n"))
    mixed = mixed.join(size.select("band", "entry", F.ceil(F.col("n") / block).cast("int").alias("blocks")), ["band", "entry"])
    mixed = mixed.join(texts, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    blocks = mixed.select("*", other.alias("other")).groupBy("band", "entry", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    blocks = blocks.agg(F.collect_list(F.struct("node", "root", "n_words", "own", "bins", "sig", "text")).alias("rows")).filter(F.size("rows") > 1)
    return blocks.select("band", "i", "j", "rows").mapInArrow(run, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def _links_between(band: int, i: int, j: int, rows: pa.StructArray, min_similarity: float) -> list[tuple[int, int, float]]:
    """Links that join classes of blocks i and j of a bucket."""
    node, root, n, own = (rows.field(x).to_numpy(zero_copy_only=False) for x in range(4))
    bins, texts = _bins_of(rows.field(4)), rows.field(6)
    sig = rows.field(5).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
    x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
    pairs = root[x][:, None] != root[y][None, :]
    if i == j:
        pairs &= node[x][:, None] < node[y][None, :]
    p, q = np.nonzero(pairs)
    p, q = x[p], y[q]
    ok = np.flatnonzero(_may_match(n, bins, p, q, min_similarity))
    ok = ok[(sig[p[ok]] == sig[q[ok]]).argmax(1) == band]
    parent, out = {}, []

    def class_of(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            r = up
        return r

    for k in ok:
        a, b = int(p[k]), int(q[k])
        ra, rb = class_of(int(root[a])), class_of(int(root[b]))
        if ra != rb and (s := similar(texts[a].as_py(), texts[b].as_py(), min_similarity)):
            parent[max(ra, rb)] = min(ra, rb)
            out.append((min(int(node[a]), int(node[b])), max(int(node[a]), int(node[b])), s))
    return out


def _verify(edges: DataFrame, texts: DataFrame, min_similarity: float) -> DataFrame:
    """The edges (a, b) whose texts are similar enough, with the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_kept()
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            s = np.array([similar(x[i].as_py(), y[i].as_py(), min_similarity) for i in range(batch.num_rows)], float)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s)], ["a", "b", "similarity"]).filter(pa.array(s > 0))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    both = edges.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(run, "a long, b long, similarity double")


def near_links(docs: DataFrame, *, width: int = WIDTH, sketches: int = SKETCHES, minima: int = MINIMA, rounds: int = ROUNDS, min_similarity: float = MIN_SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b, similarity) between nodes, a < b; they join all similar texts that share an entry."""
    sigs = materialise(sketch(docs, width=width, sketches=sketches, minima=minima), "omh-sketches")
    entries = sigs.select("node", F.posexplode("sig").alias("band", "entry"))
    several = entries.groupBy("band", "entry").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "entry")
    shared = materialise(entries.join(several, ["band", "entry"], "left_semi"), "omh-buckets")
    nodes = shared.select("node").distinct()
    texts = docs.select(F.xxhash64(text_of()).alias("node"), text_of().cast("binary").alias("text"))
    texts = materialise(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "omh-texts")
    facts = sigs.join(nodes, "node", "left_semi")
    left, links = shared, None
    for k in range(rounds):
        lead = left.groupBy("band", "entry").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        star = left.join(lead, ["band", "entry"]).filter(F.col("node") != F.col("a")).select("band", "entry", "a", F.col("node").alias("b"))
        star = materialise(star, "omh-stars") if k + 1 < rounds else star
        edges = star.select("a", "b").distinct()
        edges = edges.join(links.select("a", "b"), ["a", "b"], "left_anti") if links is not None else edges
        found = materialise(_verify(_possible(edges, facts, min_similarity), texts, min_similarity), "omh-links")
        links = found if links is None else links.unionByName(found)
        if k + 1 < rounds:
            left = star.join(links.select("a", "b"), ["a", "b"], "left_anti").select("band", "entry", F.col("b").alias("node"))
            left = materialise(left, "omh-left")
    return links.unionByName(materialise(_unresolved(shared, links, facts, texts, min_similarity, block), "omh-links"))


def components(links: DataFrame) -> DataFrame:
    """node, root of every linked node but the roots; root is a class's smallest node.

    ``links``: a, b.  Alternates large-star and small-star until nothing changes.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u != v").distinct(), "stars")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        # large star: every larger neighbour of a node goes to the smallest around it
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*")
        edges = materialise(small.filter("u != v").distinct(), "stars")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, node, class_id, n_class for every row of ``docs`` (doc_id, text).

    class_id is the smallest id of the rows with the same or linked texts.
    """
    roots = components(near_links(docs, **options))
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("node"))
    rows = rows.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    rows = materialise(rows, "omh-members")
    classes = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_class"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"))
    joined = rows.join(classes, "root")
    is_first = (F.col("node") == F.col("first.node")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    return joined.select("doc_id", "node", "class_id", "n_class", is_first.alias("is_first"))


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of every class: the one with the smallest id (then text hash)."""
    keep = near_classes(docs, **options).filter("is_first").select(F.col("doc_id").alias("k_id"), F.col("node").alias("k_node")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("o_id"), F.xxhash64(text_of()).alias("o_node"))
    kept = packed.join(keep, F.col("o_node").eqNullSafe(F.col("k_node")) & F.col("o_id").eqNullSafe(F.col("k_id")), "left_semi")
    return kept.dropDuplicates(["o_node", "o_id"]).select("row.*")
