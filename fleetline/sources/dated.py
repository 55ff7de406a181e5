"""Tables by service date whose dates are replaced, under a manifest.

A table is a folder: ``data/v=<version>/service_date=<date>/`` holds the rows, and
``manifest/<version>.json`` says which version of each date is the table's.  A writer
puts the dates that it replaces into a new version's folder and then renames a new
manifest into place, so the dates change together or not at all.  A reader opens the
folders that the newest manifest names, of the dates it asks for and no others, and
may go on reading them while later versions come: folders stay until ``keep`` further
manifests have been written.  One writer at a time.

A version that is written again (a micro-batch that is replayed) starts from the same predecessor and
takes its own earlier folder's place.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEEP = 3


class DatedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests

    def _place(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._hadoop.Path(self._place(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, before: int | None = None) -> dict:
        """The newest manifest (of a version below ``before``): its version, {date: version}, and the writer's notes."""
        known = [v for v in self.versions() if before is None or v < before]
        return self._load(known[-1]) if known else {"version": -1, "dates": {}, "notes": {}}

    def _publish(self, manifest: dict) -> None:
        target, draft = self._hadoop.Path(self._place(manifest["version"])), self._hadoop.Path(f"{self.path}/manifest/.{manifest['version']:012d}.draft")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        if self._fs.exists(target):  # a replay
            self._fs.delete(target, False)
        if not self._fs.rename(draft, target):
            raise OSError(f"{target} could not be put in place")

    def _expire(self) -> None:
        known = self.versions()
        old, kept = known[: -self.keep], [self._load(v) for v in known[-self.keep :]]
        used = {(d, v) for m in kept for d, v in m["dates"].items()}
        for version in old:
            for d, v in self._load(version)["dates"].items():
                if (d, v) not in used:
                    self._fs.delete(self._hadoop.Path(self._folder(d, v)), True)
            self._fs.delete(self._hadoop.Path(self._place(version)), False)

    # --- rows

    def _folder(self, day: str, version: int) -> str:
        return f"{self.path}/data/v={version}/service_date={day}"

    def read(self, dates: Iterable[date | str] | None = None, before: int | None = None) -> DataFrame:
        """The rows that the newest manifest (below ``before``) names, of ``dates`` if given; only their files are opened."""
        held = self.manifest(before)["dates"]
        days = sorted(held) if dates is None else sorted({str(d) for d in dates} & held.keys())
        if not days:
            return self.spark.createDataFrame([], self.schema)
        names = [f.name for f in self.schema]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema if f.name != "service_date")
        rows = self.spark.read.schema(f"{fields}, v long, service_date date").option("basePath", f"{self.path}/data").parquet(*[self._folder(d, held[d]) for d in days])
        return rows.select(*names)

    def replace(self, rows: DataFrame, dates: Iterable[date | str], *, version: int | None = None, notes: dict[str, str] | None = None) -> list[str]:
        """Put ``rows`` in place of what the table holds of ``dates``; a date without rows leaves the table.

        ``notes``: a text by date, kept in the manifest for the dates that ``dates`` names.  Returns the dates written.
        """
        replaced = {str(d) for d in dates}
        last = self.manifest(version)
        version = last["version"] + 1 if version is None else version
        folder = f"{self.path}/data/v={version}"
        rows.select(*[F.col(f.name) for f in self.schema]).write.mode("overwrite").partitionBy("service_date").parquet(folder)
        found = self._fs.globStatus(self._hadoop.Path(f"{folder}/service_date=*")) or []
        written = sorted(s.getPath().getName().split("=", 1)[1] for s in found)
        if extra := set(written) - replaced:
            raise ValueError(f"rows of dates that weren't to be replaced: {sorted(extra)[:5]}")
        kept = {d: v for d, v in last["dates"].items() if d not in replaced}
        told = {d: n for d, n in last["notes"].items() if d not in replaced} | {d: n for d, n in (notes or {}).items() if d in replaced}
        self._publish({"version": version, "dates": kept | {d: version for d in written}, "notes": told})
        self._expire()
        return written
