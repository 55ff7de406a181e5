"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text are replaced by typed placeholders; what is left
is its template.  Windows of ``width`` template tokens of documents and benchmark items
meet in a hash join.  A fixed-size Bloom filter of the benchmark's windows keeps
windows that can't match out of the shuffle; the join decides.  For each (document,
item), matched windows are grouped into placements of the item, and the slot values in
them are compared: a leak, verbatim or with new parameters, maps each value of the
item to one value of the document throughout.  Placements where the share of such
values is under ``min_consistency`` (1 without slots) are dropped; the share of the
item's windows found in the others is the pair's coverage, and it is a leak if that is
at least ``min_coverage``.  Windows with more placeholders than words match verbatim
only: their slot values enter the join.  So that an item with new parameters isn't held
to them, coverage is taken over all windows or over the others, whichever is more.

Items that differ in slot values alone are a family if the same slots are equal to each other
in all of them: a document then leaks all of the family's items alike.  The family is joined once, as
its first item; the document's own slot values are looked up among the family's, so that an item
that stands there verbatim is named.  Rows are therefore documents times families, not times items;
``item_families`` has the members.

Cases: ids may be of any type; null and empty texts match nothing; items shorter than ``width`` are one window
of their own length; those under ``least`` tokens match verbatim only (all their tokens in a row,
in any case), and those of one or two tokens only where they are a whole line; items
equal but for case are represented by the smallest id; of several texts of an item
the one with most coverage counts; repeated rows of a document count once; an empty
benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import LONGEST_TOKEN, TOKEN_CACHE, HashCache, hashes, materialise, mix, row_key, text_of, window_hashes

WIDTH = 8
LEAST = 5
#: items of fewer tokens match whole lines only
LEAST_INSIDE = 3
MIN_COVERAGE = 0.4
MIN_CONSISTENCY = 0.8
BLOOM_BITS = 1 << 23

# Units that follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees kb mb gb tb hz khz mhz ghz w kw kwh v a j kj cal kcal mph kph"
).split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
_START = re.compile(r"(?:^|[.!?:\n]\s*[\"'(]?)[^\W\d_]")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_UNITS, _NUMBER_WORDS = frozenset(UNITS), frozenset(NUMBER_WORDS)


def tokens_of(text: str) -> list[str]:
    """Numbers and runs of letters; the first letter of a sentence loses its case."""
    return _TOKEN.findall(_START.sub(lambda m: m[0].lower(), text))


def slot_of(token: str, before: str | None) -> str | None:
    """The placeholder of a token, or None for a word.  ``before``: the token before."""
    if token[0].isdigit() or token.lower() in _NUMBER_WORDS:
        return NUM
    if before is not None and before[0].isdigit() and token.lower() in _UNITS:
        return UNIT
    if token[0].isupper() and token[1:].islower():
        return NAME
    return None


class _Template(dict):
    """token -> hash of its lower-cased word; 1 or 2 for numbers and names."""

    def __missing__(self, token: str) -> int:
        slot = slot_of(token, None)
        h = {NUM: 1, NAME: 2}.get(slot) or xxhash.xxh3_64_intdigest(token.lower().encode())
        if len(self) < TOKEN_CACHE and len(token) <= LONGEST_TOKEN:
            self[token] = h
        return h


def template_hashes(tokens: list[str], cache: _Template) -> np.ndarray:
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    for i in np.flatnonzero(h[:-1] == 1) if len(h) else ():  # a unit after a number
        if slot_of(tokens[i + 1], tokens[i]) == UNIT:
            h[i + 1] = 3
    return h


def _windows(tokens: list[str], h: np.ndarray, width: int, cache: HashCache) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes, and which windows hold at least as many words as placeholders.

    The slot values of the others are part of their hash.
    """
    w = window_hashes(h, width)
    if not len(w):
        return w, np.empty(0, bool)
    slots = np.concatenate([[0], np.cumsum(h <= 3)])
    ok = (slots[width:] - slots[:-width]) * 2 <= width
    if not ok.all():
        literal, at = h.copy(), np.flatnonzero(h <= 3)
        literal[at] = hashes([tokens[i].lower().encode() for i in at], cache)
        w = np.where(ok, w, mix(w, window_hashes(literal, width)))
    return w, ok


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


_WINDOW = "hash long, pos int, slots array<string>"


def _rows(keys: list, found: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, int]], names: list[str]) -> pa.RecordBatch:
    """One row per selected window: the key's columns, hash, pos, slot values ("type value")."""
    take, hash_, pos, slots = [], [], [], []
    for d, (tokens, h, w, at, width) in enumerate(found):
        take += [d] * len(at)
        hash_.append(w[at].view(np.int64))
        pos.append(at)
        for i in at:
            slots.append([f"{h[j]} {tokens[j].lower()}" for j in range(i, i + width) if h[j] <= 3])
    cols = [k.take(pa.array(take, pa.int64())) for k in keys]
    cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.empty(0, t), type=pa.from_numpy_dtype(t))
    return pa.record_batch([*cols, cat(hash_, np.dtype(np.int64)), cat([p.astype(np.int32) for p in pos], np.dtype(np.int32)), pa.array(slots, pa.list_(pa.string()))], names)


_SHORT = np.uint64(0x5B1C_0FFE_E123_4567)  # keeps verbatim windows of short items apart from templates, by kind of place


def _verbatim(tokens: list[str], width: int, line: bool, cache: HashCache) -> np.ndarray:
    """Hashes of all runs of ``width`` tokens as they stand, but for case."""
    h = window_hashes(hashes([t.lower().encode() for t in tokens], cache), width)
    return mix(h, np.full(len(h), _SHORT + np.uint64(width * 2 + line), np.uint64)) if len(h) else h


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """item_id, v (hash of the item's text), family, values (slot values, each once), n_windows, wordy, width, inside, hash, pos, slots of every item's windows.

    ``inside``: 0 for a template, 1 for a verbatim window anywhere, 2 for a whole line.
    """
    cache, literals = _Template(), HashCache()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, family, values, n, wordy, widths, inside, found = [], [], [], [], [], [], [], [], []
            for i, v, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                tokens = tokens_of(text)
                if not tokens:
                    continue
                own, short = min(width, len(tokens)), len(tokens) < least
                if short:
                    line = len(tokens) < LEAST_INSIDE
                    h, w, ok, held = np.full(len(tokens), 4, np.uint64), _verbatim(tokens, own, line, literals), np.ones(1, bool), []
                    key = w.tobytes()
                else:
                    h = template_hashes(tokens, cache)
                    w, ok = _windows(tokens, h, own, literals)
                    said = [f"{x} {t.lower()}" for t, x in zip(tokens, h) if x <= 3]
                    held = list(dict.fromkeys(said))
                    number = {x: k for k, x in enumerate(held)}
                    # which slots are equal; windows that match verbatim only hold an item to its own values
                    key = h.tobytes() + np.array([number[x] for x in said], np.int64).tobytes() + (b"" if ok.all() else "\x00".join(held).encode())
                ids.append(i)
                texts.append(v)
                family.append(xxhash.xxh3_64_intdigest(key) - (1 << 63))
                values.append(held)
                n.append(len(w))
                wordy.append(np.flatnonzero(ok).tolist())
                widths.append(own)
                inside.append(1 + line if short else 0)
                found.append((tokens, h, w, np.arange(len(w)), own))
            keys = [pa.array(ids, b.schema.field(0).type), pa.array(texts, pa.int64()), pa.array(family, pa.int64()), pa.array(values, pa.list_(pa.string())), pa.array(n, pa.int32()), pa.array(wordy, pa.list_(pa.int32())), pa.array(widths, pa.int32()), pa.array(inside, pa.int32())]
            yield _rows(keys, found, ["item_id", "v", "family", "values", "n_windows", "wordy", "width", "inside", "hash", "pos", "slots"])

    items = benchmark.select("item_id", F.xxhash64("text").alias("v"), F.col("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    rows = items.dropDuplicates(["item_id", "v"]).mapInArrow(cut, f"item_id {_type(benchmark, 'item_id')}, v long, family long, values array<string>, n_windows int, wordy array<int>, width int, inside int, {_WINDOW}")
    return rows.withColumn("n_wordy", F.size("wordy")).withColumn("wordy", F.array_contains("wordy", F.col("pos")))


def item_families(benchmark: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """family, item_id: the members of each family, as ``find_leaks`` names families."""
    return benchmark_windows(benchmark, width, least).select("family", "item_id").distinct()


def _bloom(windows: DataFrame) -> np.ndarray:
    """A bit array of fixed size with one bit per window hash."""
    words = windows.selectExpr(f"cast(pmod(hash, {BLOOM_BITS}) div 32 as int) AS at", "shiftleft(1L, cast(pmod(hash, 32) as int)) AS b")
    found = words.groupBy("at").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    out[found["at"].to_numpy(int)] = found["b"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, least: int = LEAST, min_coverage: float = MIN_COVERAGE, min_consistency: float = MIN_CONSISTENCY) -> DataFrame:
    """One row per leaked (document, family), or (document, item) where an item's own values stand: k (row key), item_id,
    n_windows, n_matched, coverage, n_slots, consistency, family, n_items (of the family), verbatim.

    Without verbatim values ``item_id`` is the family's first item.
    """
    spark = docs.sparkSession
    every = materialise(benchmark_windows(benchmark, width, least), "item-windows")
    families = every.groupBy("family").agg(F.min(F.struct("item_id", "v")).alias("first"), F.count_distinct("item_id", "v").alias("n_items")).select("family", "first.*", "n_items")
    bench = every.join(families, ["family", "item_id", "v"]).drop("v")
    bloom = spark.sparkContext.broadcast(np.packbits(_bloom(bench)))
    shapes = {(r[0], r[1]) for r in bench.select("width", "inside").distinct().collect()}  # at most 2 * `width` of them
    widths, anywhere, lines = (sorted(w for w, i in shapes if i == k) for k in (0, 1, 2))
    cache, literals = _Template(), HashCache()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(bloom.value).astype(bool)
        # Spark's pmod of the signed hash: the low bits, as the size is a power of 2
        met = lambda w: np.flatnonzero(bits[(w & np.uint64(BLOOM_BITS - 1)).astype(np.int64)])
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                texts = some.column(2).to_pylist()
                docs_ = [(t, template_hashes(t, cache)) for t in map(tokens_of, texts)]
                sets = []
                for own in widths:
                    cuts = [_windows(tokens, h, own, literals)[0] for tokens, h in docs_]
                    sets.append([(tokens, h, w, met(w), own) for (tokens, h), w in zip(docs_, cuts)])
                plain = lambda tokens, w, own: (tokens, np.full(len(tokens), 4, np.uint64), w, met(w), own)  # noqa: E731  no slots
                for own in anywhere:
                    sets.append([plain(tokens, _verbatim(tokens, own, False, literals), own) for tokens, _ in docs_])
                for own in lines:
                    short = [[t for t in map(tokens_of, x.split("\n")) if len(t) == own] for x in texts]
                    cuts = [np.concatenate([np.empty(0, np.uint64), *[_verbatim(t, own, True, literals) for t in ts]]) for ts in short]
                    sets.append([plain([t for x in ts for t in x] or [""], w, 1) for ts, w in zip(short, cuts)])
                for found in sets:
                    if any(len(f[3]) for f in found):
                        yield _rows([some.column(0), some.column(1)], found, ["id", "h", "hash", "pos", "slots"])

    texts = docs.select(row_key().alias("k"), text_of().alias("text")).select("k.id", "k.h", "text")
    seen = texts.mapInArrow(cut, f"id {_type(docs, 'doc_id')}, h long, {_WINDOW}")
    seen = seen.select(F.struct("id", "h").alias("k"), "hash", F.col("pos").alias("d_pos"), F.col("slots").alias("d_slots"))
    both = seen.join(bench, "hash").filter(F.size("slots") == F.size("d_slots"))
    pair = F.transform(F.arrays_zip("slots", "d_slots"), lambda x: F.struct(x["slots"].alias("a"), x["d_slots"].alias("b")))
    # a placement of the item in the document: windows at one distance from the item's own places
    placed = both.groupBy("k", "family", (F.col("d_pos") - F.col("pos")).alias("shift")).agg(
        F.max("n_windows").alias("n_windows"), F.max("n_wordy").alias("n_wordy"), F.collect_set("pos").alias("at"), F.collect_set(F.when(F.col("wordy"), F.col("pos"))).alias("at_wordy"), F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"),
        F.first("values").alias("own"), F.first("item_id").alias("item_id"), F.first("n_items").alias("n_items"),
    )
    # an item's value is settled if it has one image among the pairs
    values = F.array_distinct(F.transform("pairs", lambda x: x["a"]))
    images = lambda v: F.filter("pairs", lambda x: x["a"] == v)
    settled = F.filter(values, lambda v: F.size(images(v)) == 1)
    consistency = F.when(F.size(values) == 0, 1.0).otherwise(F.size(settled) / F.size(values))
    said = F.transform("own", lambda v: F.when(F.size(images(v)) == 1, images(v)[0]["b"]))
    placed = placed.select("k", "family", "item_id", "n_items", "n_windows", "n_wordy", "at", "at_wordy", F.size(values).alias("n_slots"), consistency.alias("consistency"), F.when(F.forall(said, lambda v: v.isNotNull()), F.xxhash64(said)).alias("said")).filter(F.col("consistency") >= min_consistency)
    apart = lambda x: F.size(F.array_distinct(F.flatten(F.collect_list(x))))
    leaks = placed.groupBy("k", "family").agg(
        F.max("n_windows").alias("n_all"), F.max("n_wordy").alias("n_wordy"), apart("at").alias("m_all"), apart("at_wordy").alias("m_wordy"), F.max("n_slots").alias("n_slots"), F.min("consistency").alias("consistency"),
        F.first("item_id").alias("item_id"), F.first("n_items").alias("n_items"), F.collect_set("said").alias("said"),
    )
    wordy = F.coalesce(F.col("m_wordy") * F.col("n_all") > F.col("m_all") * F.col("n_wordy"), F.lit(False))
    leaks = leaks.withColumn("n_windows", F.when(wordy, F.col("n_wordy")).otherwise(F.col("n_all"))).withColumn("n_matched", F.when(wordy, F.col("m_wordy")).otherwise(F.col("m_all")))
    leaks = leaks.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).filter(F.col("coverage") >= min_coverage)
    # the family's items whose values are those of the document: one a placement at most, as equal items are one
    members = every.filter("pos = 0").groupBy("family", F.xxhash64("values").alias("said")).agg(F.min("item_id").alias("own_item"))
    stats = ["n_windows", "n_matched", "n_slots", "consistency", "coverage", "n_items"]
    named = leaks.select("k", "family", "item_id", *stats, F.explode_outer("said").alias("said")).join(members, ["family", "said"], "left")
    named = named.groupBy("k", "family").agg(F.collect_set("own_item").alias("items"), F.first("item_id").alias("item_id"), *[F.first(c).alias(c) for c in stats])
    verbatim = F.size("items") > 0
    named = named.select("k", "family", *stats, verbatim.alias("verbatim"), F.explode(F.when(verbatim, F.col("items")).otherwise(F.array("item_id"))).alias("item_id"))
    order = ("coverage", "consistency", "n_matched", "n_windows", "n_slots", "family", "n_items", "verbatim")
    best = named.groupBy("k", "item_id").agg(F.max(F.struct(*order)).alias("best"))
    return best.select("k", "item_id", *(f"best.{x}" for x in ("n_windows", "n_matched", "n_slots", "consistency", "coverage", "family", "n_items", "verbatim")))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    leaked = find_leaks(docs, benchmark, **options).select(F.col("k").alias("leaked_k")).distinct()
    packed = docs.select(F.struct("*").alias("row"), row_key().alias("own_k"))
    return packed.join(leaked, F.col("own_k").eqNullSafe(F.col("leaked_k")), "left_anti").select("row.*")
