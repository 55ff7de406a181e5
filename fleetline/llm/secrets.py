"""Secret scan: fixed patterns, and password guess cost for credential-context values.

Patterns mark assignments, access keys and long hex runs.  Beside them, values that
stand in a wider credential context ("pwd: ...", "passphrase is ...") are priced: the
cheapest segmentation into dictionary words, dates, repeats, alphabet and keyboard
walks and brute-force spans, found by dynamic programming over the whole value, gives
the number of guesses an attacker needs.  The dictionary is a short list of password
words, then all of the corpus' own words by rank (``ranked_words``: a table, counted over all texts;
equally frequent words share a rank).  Only the substrings of values that are to be priced are looked up in it, by
a join (``price_values``), so the dictionary has no bound and no task holds it.  A value that costs ``min_log10`` or more is marked as kind
``guess``; cheap ones ("changeme", "password1") are placeholders.  Prose isn't priced:
one word of letters, and, without ":" or "=" before it, words joined by signs.

Spans are (kind, start, end) in code points, end exclusive.  Null and empty texts
have none.  Whole texts and whole values are scanned, in time linear in their length: a
walk or repeat counts whole from its first character on, and up to ``STEP`` characters of it from any other.
Repeated rows have equal spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import materialise

MIN_LOG10 = 10.0
KINDS = ("assign", "access", "hex", "guess")

# letters of `assign`'s first part in either case, ASCII only
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"pass|secret|token|api|pwd|cred|auth|bearer", re.I | re.A)
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth|bearer)["']?(\x20*[:=]\x20*|\x20+is\x20+|\x20+)["']?([^\s"'<>|]{6,})""",
    re.I | re.A,
)

# Frequent password words, most frequent first.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 football baseball shadow sunshine princess "
    "iloveyou superman batman trustno1 hello freedom whatever starwars secret summer winter spring autumn monday friday january "
    "changeme default guest root test user example sample public private access server oracle system manager company"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: letters of a dictionary word, at least and at most
SHORTEST, LONGEST = 3, 20
#: words of the dictionary of ``word_ranks``; the corpus scan uses all
MOST_WORDS = 20_000
STEP = 64
_LETTERS = re.compile(rb"[a-z]{3,20}")
_JOINTS = re.compile(r"[-/.,;:()]+")
# Rows of a keyboard, and runs of the alphabet and the digits.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {(a, b) for row in WALKS for a, b in zip(row, row[1:])} | {(b, a) for row in WALKS for a, b in zip(row, row[1:])}
LEET = str.maketrans("0134578@$!", "oleastbasi")
_DATE = re.compile(r"(?:(?:19|20)\d\d[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _alphabet(value: str) -> int:
    """Number of symbols a brute-force attacker tries per place."""
    return max(10, sum(n for n, p in ((10, r"[0-9]"), (26, r"[a-z]"), (26, r"[A-Z]"), (33, r"[^0-9a-zA-Z]")) if re.search(p, value)))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the runs of letters of all texts (A-Z lower-cased)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0):
                found.update(_LETTERS.findall(t.as_py().lower()))
                if len(found) > 200_000:
                    yield rows()
                    found.clear()
        yield rows()

    words = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def ranked_words(docs: DataFrame) -> DataFrame:
    """word, rank of every word of the corpus: after the fixed words, one more than the number of words that are more frequent.

    The ranks follow from how many words have each count; those counts are few (a corpus
    of n words has under sqrt(2 n) different ones), and only they are ordered in one place.
    """
    words = materialise(word_counts(docs), "words")
    counts = words.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    above = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("n", (above + len(RANK) + 1).alias("rank"))
    return words.join(ranks, "n").select("word", "rank")


def word_ranks(docs: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """The ``most`` most frequent words with their ranks, as a dictionary of bounded size for ``find_secrets``."""
    top = ranked_words(docs).orderBy("rank", "word").limit(most).toArrow()
    return dict(zip(top.column("word").to_pylist(), top.column("rank").to_pylist())) | RANK


def price_values(values: DataFrame, words: DataFrame) -> DataFrame:
    """value, log10 of its guesses, with every word of ``words`` (word, rank) that stands in it."""

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, subs = [], []
        rows = lambda: pa.record_batch([pa.array(hs, pa.int64()), pa.array(subs, pa.string())], ["h", "word"])
        for b in batches:
            for h, v in zip(b.column(0).to_pylist(), b.column(1)):
                found = _words_in(v.as_py())
                hs += [h] * len(found)
                subs += found
                if len(subs) > 50_000:
                    yield rows()
                    hs, subs = [], []
        yield rows()

    # a value goes by its hash beside its substrings: they are as many as its letters, and it may be long
    own = values.select(F.xxhash64("value").alias("h"), "value")
    asked = own.mapInArrow(substrings, "h long, word string")
    found = asked.join(words, "word").groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("word", "rank"))).alias("ranks"))

    @F.pandas_udf("double")
    def price(value: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([guess_log10(v, dict(r if r is not None else {}) | RANK) for v, r in zip(value, ranks)], dtype=float)

    return own.join(found, "h", "left").select("value", price("value", "ranks").alias("log10"))


def _words_in(value: str) -> list[str]:
    """Every run of SHORTEST to LONGEST letters in a value, as it stands and without leet, in lower case."""
    low = value.lower()
    low = low if len(low) == len(value) else value
    out = set()
    for text in {low, low.translate(LEET)}:
        for m in re.finditer("[a-z]{3,}", text):
            run = m[0]
            out.update(run[i:j] for i in range(len(run) - SHORTEST + 1) for j in range(i + SHORTEST, min(len(run), i + LONGEST) + 1))
    return sorted(out)


def guess_log10(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``."""
    n, low = len(value), value.lower()
    low = low if len(low) == n else value  # a letter whose lower case is longer
    plain = low.translate(LEET)
    per_char = math.log10(_alphabet(value))
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + per_char)  # brute force, one place
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            best[m.end()] = min(best[m.end()], here + (2.1 if m.end() - i == 4 else 4.6))  # ~120 years, or days in them
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                cost = math.log10(rank + 1) + (0.3 if value[i:j] != low[i:j] else 0) + (0.3 if low[i:j] not in ranks else 0)
                best[j] = min(best[j], here + cost)
        j = i + 1  # keyboard and alphabet walks, from each of their steps
        far = n if not i or (low[i - 1], low[i]) not in NEXT else min(n, i + STEP)
        while j < far and (low[j - 1], low[j]) in NEXT:
            j += 1
            if j - i >= 3:
                best[j] = min(best[j], here + 1.7 + math.log10(j - i))
        for unit in (1, 2, 3, 4):  # repeats of a short unit
            j = i + unit
            far = n if not i or low[i - 1] != low[i - 1 + unit : i + unit] else min(n, i + STEP)
            while j + unit <= far and low[j : j + unit] == low[i : i + unit]:
                j += unit
                best[j] = min(best[j], here + unit * per_char + math.log10((j - i) / unit))
    return best[n]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three patterns, in order of start, then kind as listed."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def is_prose(value: str, assigned: bool) -> bool:
    """One word of letters; if nothing assigns the value, also words joined by signs."""
    one = lambda w: w.isalpha() and (w.islower() or w.isupper() or w[1:].islower())
    return one(value) or not assigned and all(one(w) for w in _JOINTS.split(value) if w)


def priced_spans(text: str, min_log10: float = MIN_LOG10) -> list[tuple[int, int, str]]:
    """(start, end, value) of credential-context values that aren't prose and that brute force alone would price high enough."""
    out = []
    if not _HINT.search(text):
        return out
    for m in CONTEXT.finditer(text):
        value = m[2].rstrip(".,;:)]}")
        if len(value) >= 6 and len(value) * math.log10(_alphabet(value)) >= min_log10 and not is_prose(value, ":" in m[1] or "=" in m[1]):
            out.append((m.start(2), m.start(2) + len(value), value))
    return out


def guess_spans(text: str, min_log10: float = MIN_LOG10, ranks: dict[str, int] = RANK) -> list[tuple[int, str, int]]:
    """Credential-context values that aren't prose and cost at least ``min_log10``."""
    return [(a, "guess", b) for a, b, value in priced_spans(text, min_log10) if guess_log10(value, ranks) >= min_log10]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def find_secrets(text: Column, min_log10: float = MIN_LOG10, ranks: dict[str, int] = RANK) -> Column:
    """Spans of a text as an array of structs: kind, start, end, in order of start and kind.

    ``ranks``: the dictionary, as ``word_ranks`` gives it (of bounded size).
    """

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(texts: pd.Series) -> pd.Series:
        order = KINDS.index
        return texts.map(
            lambda t: [{"kind": k, "start": s, "end": e} for s, k, e in sorted(base_spans(t) + guess_spans(t, min_log10, ranks), key=lambda x: (x[0], order(x[1])))]
        )

    return scan(F.coalesce(text, F.lit("")))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark`` (overlapping spans by one)."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str, spans) -> str:
            parts, at = [], 0
            for x in sorted(spans, key=lambda x: x["start"]):
                if x["start"] >= at:
                    parts += [t[at : x["start"]], mark]
                at = max(at, x["end"])
            return "".join([*parts, t[at:]])

        return pd.Series([one(t, s) if len(s) else t for t, s in zip(texts, found)])

    return cut(F.coalesce(text, F.lit("")), spans)


def scan_corpus(docs: DataFrame, min_log10: float = MIN_LOG10) -> DataFrame:
    """doc_id and found (array of kind, start, end, in order of start and kind) of every row, priced with all of the corpus' words.

    Texts are read twice: to count words, and to find spans.  Of rows with values to price, the values
    alone go on, each different one priced once.
    """
    span = "struct<kind:string,start:long,end:long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        asked = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                texts = some.column(1).to_pylist()
                base = [[{"kind": k, "start": s, "end": e} for s, k, e in base_spans(t)] for t in texts]
                values = [[{"start": s, "end": e, "value": v} for s, e, v in priced_spans(t, min_log10)] for t in texts]
                yield pa.record_batch([some.column(0), pa.array(base, pa.list_(kind)), pa.array(values, pa.list_(asked))], ["doc_id", "base", "asked"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, f"doc_id {kind}, base array<{span}>, asked array<struct<start:long,end:long,value:string>>")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    open_ = rows.filter(F.size("asked") > 0).select("row", F.explode("asked").alias("a")).select("row", "a.*")
    strong = price_values(materialise(open_.select("value").distinct(), "secret-values"), ranked_words(docs)).filter(F.col("log10") >= min_log10)
    guessed = open_.join(strong, "value").groupBy("row").agg(F.collect_list(F.struct(F.lit("guess").alias("kind"), "start", "end")).alias("guesses"))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    sorted_ = F.transform(F.array_sort(F.transform(F.concat("base", "guesses"), lambda x: F.struct(x["start"].alias("start"), F.element_at(order, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.join(guessed, "row", "left").select("doc_id", F.when(F.col("guesses").isNull(), F.col("base")).otherwise(sorted_).alias("found"))


def secret_digest(docs: DataFrame, min_log10: float = MIN_LOG10) -> DataFrame:
    """doc_id, counts per pattern, digest of the pattern spans, all spans joined."""
    rows = scan_corpus(docs, min_log10)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.filter("found", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), count("guess").alias("n_guess"),
    )
