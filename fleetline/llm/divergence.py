"""Divergence of sources within a language, with identical texts collapsed first.

Identical texts of a language are grouped with how many rows each source has of them
(``collapse_texts``: partly where the rows are read, then by a hash of the text), each is
tokenised once, and its document frequencies and counts are added with those weights
(``term_cells``).  A language keeps the terms that ``min_docs`` or more of its documents
hold.  A source's share of a term, in billionths, is smoothed:
p = 1 + floor(10^9 (count + 5) / (N + 5 V)).  The divergence of two sources is the sum
of abs(p - q) over all kept terms, evaluated sparsely: a term that neither holds adds the
same difference of the two floors, a term that one holds depends on that one's count
alone (a histogram of shares), and only terms that both hold are met pair by pair, in
blocks of terms that add up all pairs of sources before anything is shuffled.

Shares go through decimals of 38 digits, the rest is 64-bit: every sum is below
4 * 10^9 + 4 V.  Nothing is collected; no table is broadcast but by Spark's own threshold.

Cases: null text, lang and source count as ''; a group without kept terms, or without any term, is a group
still; a language that keeps no term gives pairs of value 0 and no terms; repeated rows
are documents of their own; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import materialise

MIN_DOCS = 30
SMOOTHING = 5
TOP_TERMS = 50
BILLION = 1_000_000_000
#: bytes of text that a task holds before it hands on what it has collapsed
HELD_BYTES = 16 << 20
#: terms, and bytes of terms, that a task counts before it hands on its sums
HELD_TERMS, HELD_TERM_BYTES = 500_000, 32 << 20
#: cells of a block of terms in which pairs are added up
BLOCK_CELLS = 200_000
#: letters in UTF-8: A-Z lowered, a-z and all bytes from 128 on; any other byte parts terms
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and characters from U+0080 on, with A-Z lowered."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


_TEXTS = "lang string, text string, sources array<string>, copies array<long>"


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of this task's rows with the rows each source has of them; not all that are equal, but most."""
    held: dict[tuple[str, str], dict[str, int]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        return pa.record_batch([[k[0] for k in held], [k[1] for k in held], pa.array([list(v) for v in held.values()], pa.list_(pa.string())), pa.array([list(v.values()) for v in held.values()], pa.list_(pa.int64()))], ["lang", "text", "sources", "copies"])

    for b in batches:
        for lo in range(0, b.num_rows, 500):
            for lang, source, text in zip(*(b.column(i).slice(lo, 500).to_pylist() for i in range(3))):
                own = held.get((lang, text))
                if own is None:
                    own = held[lang, text] = {}
                    size += len(text)
                own[source] = own.get(source, 0) + 1
            if size > HELD_BYTES:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def collapse_texts(docs: DataFrame) -> DataFrame:
    """lang, text, sources, copies: texts by language, dealt by a hash so that equal ones are neighbours in one task."""
    texts = _clean(docs).mapInArrow(_collapse, _TEXTS).withColumn("h", F.xxhash64("lang", "text"))
    return texts.repartition("h").sortWithinPartitions("h")


_CELLS = "lang string, source string, term string, count long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document frequencies by language, source and term, each text tokenised once."""
    sums: dict[tuple[str, str], dict[bytes, int]] = {}  # count * 2^40 + documents
    near: dict[tuple[str, str], Counter] = {}  # the texts of one hash
    at = None

    def add() -> None:
        for (lang, text), copies in near.items():
            found = Counter(terms_of(text))
            for source, n in copies.items():
                own = sums.setdefault((lang, source), {})
                get = own.get
                for term, k in found.items():
                    own[term] = get(term, 0) + (k * n << 40) + n
        near.clear()

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in sums.items():
            items = list(own.items())
            for lo in range(0, len(items), 50_000):
                some = items[lo : lo + 50_000]
                terms = pa.array([t for t, _ in some], pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([lang] * len(some)), pa.array([source] * len(some)), terms, pa.array([v >> 40 for _, v in some], pa.int64()), pa.array([v & (1 << 40) - 1 for _, v in some], pa.int64())], ["lang", "source", "term", "count", "docs"])
        sums.clear()

    for b in batches:
        for lo in range(0, b.num_rows, 500):
            for lang, text, sources, copies, h in zip(*(b.column(i).slice(lo, 500).to_pylist() for i in range(5))):
                if h != at:
                    add()
                    at = h
                own = near.setdefault((lang, text), Counter())
                for source, n in zip(sources, copies):
                    own[source] += n
            if sum(map(len, sums.values())) > HELD_TERMS or sum(len(t) for own in sums.values() for t in own) > HELD_TERM_BYTES:
                yield from out()
    add()
    yield from out()


def term_cells(texts: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: sums over collapsed texts, weighted by their copies."""
    parts = texts.select("lang", "text", "sources", "copies", "h").mapInArrow(_count, _CELLS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_cells(cells: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The cells of terms that their language keeps, with the language's count of the term."""
    all_ = Window.partitionBy("lang", "term")
    rows = cells.select("*", F.sum("docs").over(all_).alias("lang_docs"), F.sum("count").over(all_).alias("lang_count"), F.row_number().over(all_.orderBy("source")).alias("nth"))
    return rows.filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "count", "lang_count", (F.col("nth") == 1).alias("is_first"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact for any 64-bit counts."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = wide(total) + wide(kept) * F.lit(SMOOTHING).cast("decimal(2,0)")
    above = (wide(count) + F.lit(SMOOTHING).cast("decimal(2,0)")) * F.lit(BILLION).cast("decimal(10,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", above, below))


def _shared(cells: pa.Table) -> pa.Table:
    """Of a block of terms of one language: for each pair of sources, what their common terms change in the sum."""
    held = cells.column("source").to_pylist()
    names = sorted(set(held))  # so that a pair is the same way round in all blocks
    number = {x: i for i, x in enumerate(names)}
    src = np.fromiter((number[x] for x in held), np.int64, len(held))
    term = cells.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    p, floor = cells.column("p").to_numpy(), np.zeros(len(names), np.int64)
    floor[src] = cells.column("p0").to_numpy()
    order = np.lexsort((term, src))
    src, term, p = src[order], term[order], p[order]
    begin = np.searchsorted(src, np.arange(len(names) + 1))
    a_names, b_names, value = [], [], []
    own = np.zeros(term.max() + 1, np.int64)
    for a in range(len(names) - 1):
        lo, hi = begin[a], begin[a + 1]
        own[term[lo:hi]] = p[lo:hi]
        x = own[term[hi:]]
        both = np.flatnonzero(x)  # a share is 1 at least
        b, x, y = src[hi:][both], x[both], p[hi:][both]
        total = np.zeros(len(names), np.int64)
        np.add.at(total, b, np.abs(x - y) - np.abs(x - floor[b]) - np.abs(y - floor[a]) + np.abs(floor[a] - floor[b]))
        for i in np.unique(b).tolist():
            a_names.append(names[a])
            b_names.append(names[i])
            value.append(int(total[i]))
        own[term[lo:hi]] = 0
    lang = [cells.column("lang")[0].as_py()] * len(value)
    return pa.table([pa.array(lang, pa.string()), pa.array(a_names, pa.string()), pa.array(b_names, pa.string()), pa.array(value, pa.int64())], ["lang", "a", "b", "v"])


def pair_divergence(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all pairs of sources of a language.

    ``cells``: lang, source, term, p, p0, blocks.  ``groups``: lang, source, p0, kept.
    """
    blocks = cells.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "p", "p0")
    shared = blocks.groupBy("lang", "block").applyInArrow(_shared, "lang string, a string, b string, v long").groupBy("lang", "a", "b").agg(F.sum("v").alias("shared"))
    shared = shared.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "shared").select("lang", "x.*", "shared")
    hist = cells.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"))
    alone = hist.join(other, "lang").filter(F.col("source") != F.col("item"))
    floors = F.abs(F.col("p0") - F.col("item_p0"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("item_p0")) - floors)).alias("alone"))
    back = alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("alone").alias("back"))
    pairs = groups.select("lang", "source", "p0", "kept").join(other, "lang").filter(F.col("source") != F.col("item"))
    out = pairs.join(alone, ["lang", "source", "item"], "left").join(back, ["lang", "source", "item"], "left").join(shared, ["lang", "source", "item"], "left")
    value = F.coalesce(F.col("kept") * floors, F.lit(0)) + sum(F.coalesce(c, F.lit(0)) for c in ("alone", "back", "shared"))
    return out.select("lang", "source", "item", value.cast("long").alias("value"))


def audit_sources(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources, and each source's most overused terms."""
    groups = _clean(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    cells = materialise(term_cells(collapse_texts(docs)), "term-cells")
    kept = materialise(kept_cells(cells, min_docs), "kept-cells")
    langs = kept.groupBy("lang").agg(F.count(F.when(F.col("is_first"), 1)).alias("kept"), F.sum("count").alias("lang_total"), F.ceil(F.count(F.lit(1)) / BLOCK_CELLS).alias("blocks"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = materialise(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "source-groups")
    rows = kept.join(groups, ["lang", "source"]).select("*", share(F.col("count"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_count"), F.col("lang_total"), F.col("kept")).alias("q"))
    pairs = pair_divergence(rows, groups)
    terms = rows.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_count FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
lt AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM tok t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({BILLION}::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (g.total + {SMOOTHING} * l.v) AS p,
        1 + ({BILLION}::HUGEINT * (k.lang_count + {SMOOTHING})) // (l.lang_total + {SMOOTHING} * l.v) AS q
      FROM gt g JOIN lt l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pv.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= {TOP_TERMS})
"""
