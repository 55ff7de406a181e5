"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words; a document of it should be taken
``target / source size`` times (at most ``max_repeats``).  The whole part is certain,
the fractional part is a copy probability.  Pairs of documents play pivotal duels:
words are moved at random from one to the other until one of the two copies is
settled (probability 0 or 1), with the expectation of both kept and the sum of words
kept exactly.  Duels run inside blocks of a source; the one unsettled document of
each block meets those of other blocks in a reduction tree, until one document a
source is left, which a coin with its probability settles.  So a source's words miss
its target by less than one document.

Rows equal in id, text and source are settled by arithmetic: of c of them that are to be taken
p times on average, floor(c p) are taken, the fraction that is left is one document's
probability, and that one alone plays duels.  So copies of one row never meet in one task,
and a block is bounded however often a row is repeated.  Rows of size 0 play none.

Cases: ids may be of any type; null or empty text has size 0 and is never taken; a null source is a source
of its own (last in order); repeated rows are documents of their own; an empty table
gives an empty table; reruns give the same mix (order and coins come from hashes), of rows
equal in id, text and source any may be the one that is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import materialise, text_of, words_in

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_ROWS = 1024
FAN_IN = 64

#: copies of a repeated row that are numbered in one task
TURNS = 4096


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: its size, rows, target.  ``sized``: source, size.

    Targets share the sum of all sizes by weight, none above ``max_repeats`` times its
    source's size; the excess goes to the others by weight.  That is water filling:
    target = min(cap, level * weight), and the level follows from the sources in order
    of cap / weight.  The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("*", w.alias("weight"), (F.col("source_size") * max_repeats).cast("double").alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    # the level if all sources before this one are capped and this one and the later aren't
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), zero)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), zero)
    )
    per = per.select("*", level.alias("level"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    per = per.select("*", F.max(fits).over(everything).alias("final_level"))
    return per.select(
        "source", "source_size", "source_rows",
        F.least("cap", F.coalesce("final_level", F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


def _coin(seed: int, *what) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(repr(what).encode(), seed)))


def _duels(seed: int, last: bool):
    """Settle a block but for one document; with ``last``, that one too."""

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ord", "ascending"), ("text_hash", "ascending")])
        size, p = rows.column("size").to_numpy().astype(float), rows.column("p").to_numpy().copy()
        source, block = (k.as_py() for k in key)
        toss = _coin(seed, source, block).random(len(p) + 1)
        a = -1  # the document that is still open
        for i in range(len(p)):
            if p[i] <= 0 or p[i] >= 1:
                continue
            if a < 0:
                a = i
                continue
            to_a, to_i = min(size[a] * (1 - p[a]), size[i] * p[i]), min(size[a] * p[a], size[i] * (1 - p[i]))
            words = to_a if toss[i] * (to_a + to_i) < to_i else -to_i
            p[a] += words / size[a]
            p[i] -= words / size[i]
            for j in (a, i):
                if p[j] < 1e-9 or p[j] > 1 - 1e-9:
                    p[j] = round(p[j])
            a = a if 0 < p[a] < 1 else i if 0 < p[i] < 1 else -1
        if last and a >= 0:
            p[a] = float(toss[-1] < p[a])
        next_ = pa.array(rows.column("block").to_numpy() // FAN_IN)
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p)).set_column(rows.schema.get_field_index("block"), "block", next_)

    return settle


_GROUP = ["doc_id", "text_hash", "source"]


def _sized(docs: DataFrame, size: Column | None) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), F.col("source").cast("string").alias("source"), (words_in() if size is None else size).cast("long").alias("size"))


def mix_groups(docs: DataFrame, *, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 7, size: Column | None = None) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, n, whole, extra: one row per different row of ``docs``.

    Of its ``n`` rows each is taken ``whole`` times, and ``extra`` of them once more.
    """
    rows = materialise(_sized(docs, size).groupBy(*_GROUP, "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    per = source_targets(rows.withColumn("size", F.col("size") * F.col("n")), weights, max_repeats)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    own = F.when(F.col("size") == 0, 0.0).otherwise(F.greatest(rate - F.floor(rate + 1e-12), F.lit(0.0)))
    all_ = F.col("own") * F.col("n")  # copies to take of all equal rows, beyond the whole ones
    blocks = F.ceil(F.col("source_rows") / BLOCK_ROWS)
    rows = (
        rows.withColumnRenamed("source", "own_source")
        .join(per, F.col("own_source").eqNullSafe(F.col("source")))
        .select(*_GROUP, "size", "source_size", "target", "n", F.floor(rate + 1e-12).cast("int").alias("whole"), own.alias("own"), blocks.alias("blocks"))
        .select(*_GROUP, "size", "source_size", "target", "n", F.when(F.col("size") == 0, 0).otherwise(F.col("whole")).alias("whole"), F.floor(all_ + 1e-9).cast("long").alias("extra"), F.greatest(all_ - F.floor(all_ + 1e-9), F.lit(0.0)).alias("p"),
                F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), F.col("blocks")).alias("block"), F.xxhash64(F.lit(seed), "doc_id", "text_hash").alias("ord"), "blocks")
    )
    most = per.agg(F.max(F.ceil(F.col("source_rows") / BLOCK_ROWS))).first()[0] or 0
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    rows = rows.drop("blocks")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    open_, done = rows.filter(is_open), [rows.filter(~is_open)]
    while True:
        last = most <= 1
        settled = materialise(open_.groupBy("source", "block").applyInArrow(_duels(seed, last), fields), "mix-duels")
        done.append(settled.filter(~is_open))
        if last:
            break
        open_, most = settled.filter(is_open), -(-most // FAN_IN)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*_GROUP, "size", "source_size", "target", "n", "whole", (F.col("extra") + F.col("p").cast("long")).alias("extra"))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """How often to take each document: doc_id, text_hash, size, source_size, target, copies.

    ``docs``: doc_id, text, source.  One row per row of ``docs``.
    """
    groups = mix_groups(docs, **options)
    # a row that is repeated very often is dealt out in stretches
    starts = groups.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(TURNS).cast("long"))))
    turn = F.explode(F.sequence(F.col("start"), F.least(F.col("start") + TURNS, F.col("n")) - 1))
    return starts.withColumn("turn", turn).select("doc_id", "text_hash", "size", "source_size", "target", (F.col("whole") + (F.col("turn") < F.col("extra")).cast("int")).alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0 to max_repeats).

    Rows equal in id, text and source share out their copies: they are numbered in stretches of a
    stored random number, as all of them may be too many for one task.
    """
    groups = materialise(mix_groups(docs, **options), "mix-groups")
    taken = groups.filter((F.col("whole") > 0) | (F.col("extra") > 0))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k_id"), F.xxhash64(text_of()).alias("k_hash"), F.col("source").cast("string").alias("k_source"))
    same = F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_hash") == F.col("text_hash")) & F.col("k_source").eqNullSafe(F.col("source"))
    each = lambda df, copies: df.filter(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).select("row.*")
    even = (F.col("extra") == 0) | (F.col("extra") == F.col("n"))
    plain = each(packed.join(taken.filter(even), same), (F.col("whole") + (F.col("extra") > 0).cast("int")))
    uneven = taken.filter(~even)  # repeated rows of which some are taken once more
    stretch = F.floor(F.rand(5) * F.ceil(F.col("n") / TURNS)).cast("int")
    some = materialise(packed.join(uneven, same).select("row", "k_id", "k_hash", "k_source", "whole", "extra", stretch.alias("stretch")), "mix-repeats")
    key = ["k_id", "k_hash", "k_source"]
    counts = some.groupBy(*key, "stretch").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in (*key, "stretch")], before.alias("before"))
    turn = F.row_number().over(Window.partitionBy(*key, "stretch").orderBy("k_hash"))
    on = F.col("c_stretch") == F.col("stretch")
    for c in key:
        on = on & F.col(f"c_{c}").eqNullSafe(F.col(c))
    numbered = some.withColumn("turn", turn).join(counts, on)
    return plain.unionByName(each(numbered, F.col("whole") + (F.col("before") + F.col("turn") <= F.col("extra")).cast("int")))
