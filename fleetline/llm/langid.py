"""Language identification of mixed text: script ranges, word scores, Viterbi.

Each word is scored under every language by character n-grams (2 and 3, with word
borders, add-one smoothed), learned from a bounded sample of labelled documents
(``max_rows`` shared evenly by the languages, ``LEAST_ROWS`` each at least; the first by
a hash of the id).  Words are runs of letters.  The script of a word's letters
narrows its candidates to the languages that were seen to use that script.  Viterbi
with a switching penalty then labels the words, so a text falls into spans of one
language each; the document's language is the one whose spans hold most letters.

Cases: null, empty or letterless text is ``und`` with score 0; without any labelled
document everything is ``und``; ties go to the better path score, then to the
smaller name; repeated rows are scored alike; rows with a null id are scored but not learned from.  Whole texts are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import LONGEST_TOKEN, materialise, remainder

MAX_ROWS = 6_000
LEAST_ROWS = 50
SWITCH_PENALTY = 6.0
#: bytes of words and their scores that a Python worker remembers
CACHE_BYTES = 64 << 20
#: texts labelled at a time; bounds what a Python worker holds
TEXTS_AT_ONCE = 1_500
_WORD = re.compile(r"[^\W\d_]+")
# First and last code point of script blocks; other letters are "Other".
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Thai", 0x0E00, 0x0E7F), ("Kana", 0x3040, 0x30FF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)


def _letters(m: re.Match) -> list[tuple[int, int]]:
    """Runs of letters in a match, which may hold numerals such as a superscript."""
    w, at = m[0], m.start()
    if w.isalpha():
        return [(at, m.end())]
    return [(at + x.start(), at + x.end()) for x in re.finditer("a+", "".join("a" if c.isalpha() else "-" for c in w))]


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [text[a:b] for m in _WORD.finditer(text) for a, b in _letters(m)]


def script_of(word: str) -> str:
    c = ord(word[0])
    return next((name for name, lo, hi in SCRIPTS if lo <= c <= hi), "Other")


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]


@dataclass
class LanguageModel:
    langs: list[str]
    place: dict[str, int]  # n-gram -> row of log_p; row 0 is an unseen one's
    log_p: np.ndarray  # a column per language
    scripts: dict[str, np.ndarray]  # script -> languages that use it
    penalty: float = SWITCH_PENALTY
    _word: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_word": {}, "_scores": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language; far less where its script rules one out."""
        if not words:
            return np.empty((0, len(self.langs)))
        found = [[self.place.get(g, 0) for g in grams(w)] for w in words]
        at = np.cumsum([0] + [len(f) for f in found[:-1]])
        s = np.add.reduceat(self.log_p[np.fromiter((i for f in found for i in f), np.int64)], at)
        if len(self.scripts) > 1 or not all(x.all() for x in self.scripts.values()):
            everyone = np.ones(len(self.langs), bool)
            allowed = np.array([self.scripts.get(script_of(w), everyone) for w in words])
            s = np.where(allowed, s, s.min(1, keepdims=True) - 50.0)
        return s

    def _score_table(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Row of the table for each word of all texts, and the table."""
        own = self._word
        fresh = list(set().union(*words) - own.keys())
        fresh.sort(key=lambda w: len(w) > LONGEST_TOKEN)  # long ones aren't remembered
        most = CACHE_BYTES // (8 * len(self.langs) + 150)
        known = len(own)
        room = min(max(0, most - known), sum(len(w) <= LONGEST_TOKEN for w in fresh))
        more = {w: known + i for i, w in enumerate(fresh[room:], room)}
        own.update((w, known + i) for i, w in enumerate(fresh[:room]))
        table = self.word_scores(fresh)
        table = np.vstack([self._scores, table]) if known else table
        self._scores = table[: len(own)]
        get = own.__getitem__ if not more else (lambda w: own[w] if w in own else more[w])
        return np.fromiter(map(get, chain.from_iterable(words)), np.int64), table

    def label(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each text and the number of the language of each."""
        words = [words_of(t.lower()) for t in texts]
        at, table = self._score_table(words)
        length = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")  # long texts first: those with a word t are a prefix
        longest, n = int(length.max(initial=0)), len(self.langs)
        active = np.searchsorted(-length[order], -np.arange(longest + 1), side="left")
        kind = np.int8 if n < 128 else np.int32
        before = np.empty((len(at), n), kind)  # best language of the word before, for each of this one
        state = np.zeros(len(texts), np.int64)
        v = np.zeros((len(texts), n))
        for t in range(longest):
            k = active[t]
            v, where = v[:k], start[order[:k]] + t
            if t:
                top = v.argmax(1)
                jump = (v[np.arange(k), top] - self.penalty)[:, None]
                switch = jump > v
                before[where] = np.where(switch, top[:, None], np.arange(n))
                v = np.where(switch, jump, v)
            v = v + table[at[where]]
            ends = active[t + 1]
            state[order[ends:k]] = v[ends:].argmax(1)
        flat = np.empty(len(at), kind)
        for t in range(longest - 1, -1, -1):
            docs = order[: active[t]]
            where = start[docs] + t
            flat[where] = state[docs]
            if t:
                state[docs] = before[where, state[docs]]
        return [(w, flat[a : a + k]) for w, a, k in zip(words, start, length)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language with most letters in its spans, and its share of the letters."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        out = []
        for words, labels in self.label(texts):
            if not words:
                out.append(("und", 0.0))
                continue
            letters = np.bincount(labels, [len(w) for w in words], len(self.langs))
            best = int(letters.argmax())  # ties to the smaller name
            out.append((self.langs[best], float(letters[best] / letters.sum())))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of the runs of words in one language, in code points."""
        found = [x for m in _WORD.finditer(text) for x in _letters(m)]
        if not self.langs or not found:
            return []
        # lower-casing may change a word's length, not its number among the words
        labels = self.label([" ".join(text[a:b] for a, b in found)])[0][1]
        out: list[tuple[int, int, str]] = []
        for (a, b), k in zip(found, labels):
            if out and out[-1][2] == self.langs[k]:
                out[-1] = (out[-1][0], b, out[-1][2])
            else:
                out.append((a, b, self.langs[k]))
        return out


def likely(h: Column, rows: Column, most: int) -> Column:
    """True for about ``most`` of ``rows`` rows, by a 64-bit hash; in doubles, so that no number of rows overflows."""
    return F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40) * rows.cast("double") < float(most)


def fit_languages(docs: DataFrame, *, max_rows: int = MAX_ROWS, penalty: float = SWITCH_PENALTY, seed: int = 5) -> LanguageModel:
    """Learn from text and lang of ``docs``; at most ``max_rows`` rows, or ``LEAST_ROWS`` a language.

    Every language with a sampled text that holds letters is learned.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    sizes = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = max(LEAST_ROWS, max_rows // max(1, sizes.count()))
    # twice as many rows by their hash, so that no language goes whole into one task; then the first of them
    rows = rows.join(sizes, "lang").filter(likely(F.xxhash64("h"), F.col("n"), 2 * each))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= each).select("doc_id", F.col("lang").alias("l"), "h").distinct()
    own = docs.select(F.col("doc_id").alias("d"), "text", "lang")
    rows = own.join(F.broadcast(rows), (F.col("d") == F.col("doc_id")) & (F.col("lang") == F.col("l"))).select("lang", "text")

    @F.pandas_udf("map<string,long>")
    def counted(texts: pd.Series) -> pd.Series:
        def one(t: str) -> dict[str, int]:
            out: Counter = Counter()
            for w, k in Counter(words_of(t.lower())).items():
                for g in grams(w):
                    out[g] += k
                out["script:" + script_of(w)] += k * len(w)
            return dict(out)

        return texts.map(one)

    per_gram = rows.select("lang", F.explode(counted("text")).alias("gram", "k")).groupBy("lang", "gram").agg(F.sum("k").alias("k")).toArrow().to_pandas()
    langs = sorted(per_gram["lang"].unique())
    place = {x: i for i, x in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for lang, gram, k in per_gram.itertuples(index=False):
        if lang in place:
            counts.setdefault(gram, np.zeros(len(langs)))[place[lang]] = k
    scripts = {g[7:]: c for g, c in counts.items() if g.startswith("script:")}
    letters = sum(scripts.values(), np.zeros(len(langs)))
    counts = {g: c for g, c in counts.items() if not g.startswith("script:")}
    k = np.array([np.zeros(len(langs)), *counts.values()])
    return LanguageModel(
        langs, {g: i for i, g in enumerate(counts, 1)}, np.log((k + 1) / (k.sum(0) + len(k))),
        {x: c >= 0.01 * letters for x, c in scripts.items() if (c >= 0.01 * letters).any()}, penalty,
    )


def language_of(model: LanguageModel, text: Column) -> Column:
    """Struct of lang and score for a text."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        order = np.argsort(texts.str.len().to_numpy(), kind="stable")  # texts of like length share their steps
        found: list = [None] * len(texts)
        for lo in range(0, len(order), TEXTS_AT_ONCE):
            some = order[lo : lo + TEXTS_AT_ONCE]
            for i, x in zip(some, model.predict(list(texts.iloc[some]))):
                found[i] = x
        return pd.DataFrame(found, columns=["lang", "score"])

    return predict(F.coalesce(text, F.lit("")))


def language_spans(model: LanguageModel, text: Column) -> Column:
    """Spans of a text as an array of structs: start, end, lang."""

    @F.pandas_udf("array<struct<start:long,end:long,lang:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "lang": x} for a, b, x in model.spans(t)])

    return spans(F.coalesce(text, F.lit("")))


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose crc32 of the id mod 3 isn't 1."""
    held = remainder(3) == 1
    model = fit_languages(docs.filter(~held), **options)
    found = docs.select("doc_id", held.alias("held_out"), language_of(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
