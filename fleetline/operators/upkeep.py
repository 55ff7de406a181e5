"""Keeping a stored daily aggregate in step with its inputs, date by date.

Each date has a fingerprint: of every input the number of its rows and the sum of their
hashes, which partial aggregation computes in one pass and no order of rows changes.  A refresh compares
them with those of the last one, builds the dates that differ, and replaces these alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.sources.dated import DatedTable


def _nulls(cols: list[Column]) -> list[Column]:
    """Which columns are null, sixty to a number: a null leaves the hash as it is."""
    return [reduce(Column.bitwiseOR, [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(cols[at : at + 60])]) for at in range(0, len(cols), 60)]


def _bits(h: Column) -> list[Column]:
    """A hash in pieces of 22 bits, whose sums stay in a long (a decimal's sum makes objects) for 2^41 rows a date."""
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit((1 << 22) - 1)) for k in (0, 22, 44)]


def fingerprints(inputs: dict[str, DataFrame], recipe: str = "") -> DataFrame:
    """service_date, print: changes if rows of any input change on the date, or ``recipe`` does.

    Rows without a date belong to no date.  Columns count by name, whatever their order.
    """
    out = None
    for name in sorted(inputs):
        df = inputs[name]
        cols = [F.col(c) for c in sorted(df.columns) if c != "service_date"]
        rows = df.filter("service_date IS NOT NULL").select("service_date", F.xxhash64(*cols, *_nulls(cols)).alias("h"))
        per = rows.groupBy("service_date").agg(F.count(F.lit(1)).alias("n"), *[F.sum(b).alias(f"h{i}") for i, b in enumerate(_bits(F.col("h")))])
        per = per.select("service_date", F.concat_ws(":", F.lit(name), *[F.col(c).cast("string") for c in per.columns[1:]]).alias("part"))
        out = per if out is None else out.unionByName(per)
    parts = F.array_join(F.array_sort(F.collect_list("part")), " ")  # one part an input
    return out.groupBy("service_date").agg(F.sha2(F.concat(F.lit(recipe), F.lit("|"), parts), 256).alias("print"))


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: dates built anew, dates that left the table, and dates left alone."""

    written: tuple[str, ...]
    gone: tuple[str, ...]
    same: tuple[str, ...]


def stale_dates(table: DatedTable, inputs: dict[str, DataFrame], recipe: str = "", told: dict[str, str] | None = None) -> tuple[dict[str, str], list[str], list[str]]:
    """({date: fingerprint} to build, dates without any input left, dates that are as they were).

    One row a date comes to the driver, which is what the manifest holds.  ``told``: {date: fingerprint} of further inputs.
    """
    fresh = {str(r["service_date"]): r["print"] for r in fingerprints(inputs, recipe).collect()} if inputs else {}
    if told is not None:
        fresh = {d: hashlib.sha256(f"{fresh.get(d, recipe)}|{told.get(d, '')}".encode()).hexdigest() for d in fresh.keys() | told.keys()}
    known = table.manifest()["notes"]
    return {d: p for d, p in fresh.items() if known.get(d) != p}, sorted(known.keys() - fresh.keys()), sorted(d for d, p in fresh.items() if known.get(d) == p)


def refresh(table: DatedTable, inputs: dict[str, DataFrame], build: Callable[[dict[str, DataFrame]], DataFrame], recipe: str = "", told: dict[str, dict[str, str]] | None = None) -> Refresh:
    """Bring ``table`` up to date.  ``build`` makes its rows of the inputs, which come cut down to the dates that changed.

    If it fails, the table stays as it was and the next refresh finds the same dates.  A change of
    ``recipe`` (the definition of the aggregate) rebuilds every date.

    ``told``: {input: {date: fingerprint}} of inputs that a table made before has already told apart (its manifest's
    notes cover all that it was made of), so that they aren't read once more for it.
    """
    told = told or {}
    known = {d: " ".join(f"{name}:{told[name].get(d, '')}" for name in sorted(told)) for d in {d for of in told.values() for d in of}} if told else None
    changed, gone, same = stale_dates(table, {k: df for k, df in inputs.items() if k not in told}, recipe, known)
    if not changed and not gone:
        return Refresh((), (), tuple(same))
    days = sorted(changed)
    only = {k: df.filter(F.col("service_date").isin([F.lit(d).cast("date") for d in days]) if days else F.lit(False)) for k, df in inputs.items()}
    written = table.replace(build(only), [*days, *gone], notes=changed)
    return Refresh(tuple(written), tuple(gone), tuple(same))
