"""Token ids of a corpus as Arrow files of fixed-size-list batches.

Documents are encoded in ascending order of id; each document's ids end with an end
id.  The stream of ids is cut into sequences of equal length.  Every file (one per
task) is an Arrow IPC file: column ``ids`` is a fixed-size list of unsigned ids,
``mask`` a fixed-size list of bits, false for the padding at the end of a
file's last sequence.  All batches but the last hold the same number of sequences, so
sequence s is row s % rows of batch s // rows: memory-mapped, it is read without a
copy.  An index (Parquet) has each document's file, place and number of ids.

Files are written under a name of their own per attempt, and the index names those of
the attempts that succeeded; a task that runs again leaves an unnamed file at worst.

A Python worker keeps the ids of the words it has met from task to task, bounded by bytes.
That needs a tokenizer that lowers case, takes runs of letters, digits and signs apart, and drops white
space (``_known_form`` reads that from its file); with any other one whole texts are encoded.

Cases: ids may be of any type that can be ordered; a null text is empty, so it is the end id alone; null ids come first; repeated
rows are encoded again (in order of a hash of the text); an empty table gives an empty
index and no file.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetline.llm.common import KEPT, qualified, scratch_path, text_of

END_ID = 1
#: bytes of words and their ids that a Python worker remembers (with what Python needs for each), and bytes of the longest word it does
CACHE_BYTES, LONGEST = 96 << 20, 64
_ENTRY = 190
#: bytes of text that are encoded at a time
STEP_BYTES = 8 << 20
SEQUENCE = 2048
BATCH_SEQUENCES = 256
_SIGNS = b".,;:!?#$%&*()-\""


def index_schema(docs: DataFrame) -> str:
    return f"part int, file string, ord long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, start_in_file long, n_tokens long"


def encoder_of(path: str) -> WordEncoder:
    """This worker's encoder.  Tasks name this function, so what it learned outlives them."""
    if path not in KEPT:
        KEPT[path] = WordEncoder(path)
    return KEPT[path]


def _known_form(tokenizer) -> bool:
    """Whether words may be encoded one by one: NFC, white space, lower case, then runs of letters, single digits, runs of signs."""
    form = json.loads(tokenizer.to_str())
    normal = form["normalizer"] or {}
    split = form["pre_tokenizer"] or {}
    steps, parts = [x["type"] for x in normal.get("normalizers", [])], split.get("pretokenizers", [])
    pattern = parts[0].get("pattern", {}).get("Regex", "") if parts else ""
    return (
        steps == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and [x["type"] for x in parts] == ["Split", "ByteLevel"]
        and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and not parts[1]["add_prefix_space"]
    )


class WordEncoder:
    """Ids of texts by a tokenizer that never joins words across white space.

    Words (runs without ASCII white space) are encoded once and remembered; those not
    met before are encoded together, joined by spaces.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = _known_form(self.tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.held, self.limit = 0, limit

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        for lo in range(0, len(words), 512):
            group = words[lo : lo + 512]
            parts = [w.decode("utf-8", "replace") for w in group]
            enc = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
            begin = np.cumsum([0] + [len(p) + 1 for p in parts])
            cut = np.searchsorted(np.array(enc.offsets, np.int64).reshape(-1, 2)[:, 0], begin)
            ids = np.array(enc.ids, self.dtype).tobytes()
            k = self.dtype.itemsize
            for w, a, b in zip(group, cut[:-1].tolist(), cut[1:].tolist()):
                out[w] = ids[a * k : b * k]
        return out

    @staticmethod
    def _letters(core: bytes) -> bool:
        """Whether the tokenizer sees letters alone: composing or lower-casing may give marks, which signs join."""
        if core.isalpha():  # bytes: ASCII
            return True
        word = core.decode("utf-8", "replace")
        return word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()

    def _learn(self, fresh: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met before; those of bounded length are remembered.  Letters and the
        signs after them are encoded apart (the tokenizer parts them too), as few words differ in letters."""
        known, split, parts = self.known, [], set()
        for w in fresh:
            core = w.rstrip(_SIGNS)
            if core and core is not w and self._letters(core):  # without signs rstrip gives the same object
                split.append((w, core, w[len(core) :]))
            else:
                parts.add(w)
        parts.update([a for _, a, _ in split])
        parts.update([b for _, _, b in split])
        parts.discard(b"")
        new = self._encode(list(parts.difference(known)))
        get = lambda x: new[x] if x in new else known[x]
        new.update([(w, get(a) + get(b)) for w, a, b in split])
        short = {w: x for w, x in new.items() if len(w) <= LONGEST}
        known.update(short)
        self.held += sum(map(len, short)) + sum(map(len, short.values())) + _ENTRY * len(short)
        return {w: x for w, x in new.items() if len(w) > LONGEST}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``, without the end id.

        The tokenizer ignores case, so A-Z are lowered first, but in texts that may spell
        one of its special tokens, which it takes as they stand.
        """
        if not self.by_word:
            found = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array(x.ids, self.dtype).tobytes() for x in found]
        flat, n = self.encode_flat(texts)
        return [x.tobytes() for x in np.split(flat, np.cumsum(n)[:-1])] if len(n) else []

    def encode_flat(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``end`` if given, and their number by text.

        Arrow parts the words and tells them apart, so Python meets each word of the batch once.
        """
        if not self.by_word:
            found = [np.frombuffer(x, self.dtype) for x in self.encode(texts)]
            flat, n = np.concatenate([np.empty(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64)
        else:
            flat, n = self._encode_words(texts)
        if end is None:
            return flat, n
        return np.insert(flat, np.cumsum(n), end), n + 1

    def _encode_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        as_text = pa.array(texts, pa.large_binary()).view(pa.large_string())  # unchecked: what follows looks at bytes of ASCII alone
        low = pc.if_else(pc.match_substring(as_text, "<|"), as_text, pc.ascii_lower(as_text))
        lists = pc.ascii_split_whitespace(low)  # an empty word at either end where white space stands there
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.view(pa.large_binary()).to_pylist()
        fresh = set(distinct).difference(self.known, [b""])
        apart = {b"": b""} | (self._learn(fresh) if fresh else {})
        known = self.known
        ids = [apart[w] if w in apart else known[w] for w in distinct]
        k = self.dtype.itemsize
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // k
        at, blob = np.cumsum(size) - size, np.frombuffer(b"".join(ids), self.dtype)
        of = words.indices.to_numpy()
        run = size[of]
        ends = np.cumsum(run)
        flat = blob[np.repeat(at[of] - ends + run, run) + np.arange(ends[-1] if len(ends) else 0)]
        n = np.diff(np.r_[0, ends][lists.offsets.to_numpy()])
        if self.held > self.limit:  # the words met first are the frequent ones
            self.known = dict(islice(self.known.items(), int(len(self.known) * 0.75 * self.limit / self.held)))
            self.held = sum(map(len, self.known)) + sum(map(len, self.known.values())) + _ENTRY * len(self.known)
        return flat, n


class TokenWriter:
    """Writes one file; ``add`` takes the ids of documents in order."""

    def __init__(self, uri: str, dtype: np.dtype, length: int = SEQUENCE, rows: int = BATCH_SEQUENCES):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.length, self.rows, self.dtype, self.total = length, rows, dtype, 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        step = self.length * self.rows
        while len(flat) >= step or last and len(flat):
            part, flat = flat[:step], flat[step:]
            short = -len(part) % self.length
            mask = np.r_[np.ones(len(part), bool), np.zeros(short, bool)]
            ids = np.r_[part, np.zeros(short, self.dtype)]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.held, self.n_held = [flat], len(flat)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()


class TokenReader:
    """Random access to the sequences and id ranges of one file."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.dtype = self.file.schema.field("ids").type.value_type.to_pandas_dtype()
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self._at, self._batch = -1, None

    def _get(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.file.get_batch(k)
        return self._batch

    def sequence(self, s: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids and mask of sequence s, both views of the file (bits aren't unpacked)."""
        batch, row = self._get(s // self.rows), s % self.rows
        a, b = row * self.length, (row + 1) * self.length
        return batch.column(0).values[a:b].to_numpy(), batch.column(1).values[a:b]

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from place ``start`` of the stream on."""
        step, parts = self.length * self.rows, []
        while n > 0:
            k, at = divmod(start, step) if step else (0, 0)
            if k >= self.file.num_record_batches:
                raise EOFError("the file ends before the ids asked for")
            part = self._get(k).column(0).values[at : min(step, at + n)].to_numpy()
            if not len(part):
                raise EOFError("the file ends before the ids asked for")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, self.dtype), *parts])


def write_tokens(docs: DataFrame, vocabulary: str, out: str | None = None, *, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``out``; returns the index.

    ``vocabulary``: path of a tokenizer file that every executor can read.
    ``out``: a URI; a new folder in the shared folder if none is given.
    """
    spark = docs.sparkSession
    out = qualified(spark, out or scratch_path(spark, "tokens"))
    fs, path = pafs.FileSystem.from_uri(out)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().cast("binary").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        task = TaskContext.get()
        file = f"{out}/part-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        writer, ord_ = None, 0
        for batch in batches:
            writer = writer or TokenWriter(file, encoder.dtype, length)
            before = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))  # texts are never null here
            lo = 0
            while lo < batch.num_rows:
                most = (before[lo - 1] if lo else 0) + STEP_BYTES
                k = max(1, int(np.searchsorted(before, most, "right")) - lo)
                some = batch.slice(lo, k)
                lo += k
                flat, n = encoder.encode_flat(some.column("text").to_pylist(), end_id)
                start = writer.total + np.cumsum(n) - n
                writer.add(flat)
                yield pa.record_batch(
                    [pa.array(np.full(k, task.partitionId(), np.int32)), pa.array([file] * k), pa.array(np.arange(ord_, ord_ + k)), some.column("doc_id"), pa.array(start), pa.array(n)],
                    ["part", "file", "ord", "doc_id", "start_in_file", "n_tokens"],
                )
                ord_ += k
        if writer:
            writer.close()

    schema = index_schema(docs)
    rows.mapInArrow(encode, schema).write.parquet(f"{out}/index")
    return spark.read.schema(schema).parquet(f"{out}/index")


def with_offsets(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all documents before each.  One row a file in the window."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("part").alias("f_part"), before.alias("before"))
    return index.join(files, F.col("part") == F.col("f_part")).select(index["*"], (F.col("before") + F.col("start_in_file")).alias("start"))


def token_digest(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            crc = []
            for file, start, n in zip(*(batch.column(c).to_pylist() for c in ("file", "start_in_file", "n_tokens"))):
                if file != name:
                    name, reader = file, TokenReader(file)
                crc.append(zlib.crc32(reader.read(start, n).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_offsets(index).mapInArrow(digest, f"doc_id {index.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    return token_digest(write_tokens(docs, vocabulary))
