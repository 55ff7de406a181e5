"""What the corpus operators share: scratch tables, text columns, hashed tokens.

Rows are documents.  A null text counts as the empty text everywhere.  Operators
select the columns they need and pack whatever else a caller's table holds into a
struct, so extra columns and clashing names never meet the operators' own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.sources.scratch import scratch_path, shared_dir  # noqa: F401  also for the operators

#: Most distinct tokens whose hash a Python worker remembers; others are hashed anew.
TOKEN_CACHE = 400_000
#: bytes (or characters) of the longest token that is remembered, so that a cache is bounded in bytes too
LONGEST_TOKEN = 64


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme; one without is of the cluster's default file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, keeps what several branches read the same for all of them,
    and survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """Size of a table that ``materialise`` wrote, in bytes on disk."""
    spark = df.sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [paths(f) for f in df.inputFiles()]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return found[0].getFileSystem(conf).getContentSummary(found[0].getParent()).getLength() if found else 0


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a document's decision: its id and the hash of its text.

    Rows equal in both get equal decisions, so a repeated or null id is no trouble.
    """
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("h"))


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def words_in(name: str = "text") -> Column:
    """Number of runs of characters that aren't ASCII white space."""
    return F.regexp_count(text_of(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


#: what this Python worker keeps from task to task, by name
KEPT: dict[str, object] = {}


def free_kept() -> None:
    """Forget what tasks of other operators left in this worker, and give Arrow's unused memory back: for tasks that hold much."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()


class HashCache(dict):
    """bytes -> 64-bit hash; remembers the first TOKEN_CACHE tokens it meets."""

    def __missing__(self, token: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(token)
        if len(self) < TOKEN_CACHE and len(token) <= LONGEST_TOKEN:
            self[token] = h
        return h


def hashes(tokens: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of ordered pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15F39CC060))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` tokens; empty if there are fewer tokens."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n]
    for k in range(1, width):
        out = mix(out, h[k : n + k])
    return out
