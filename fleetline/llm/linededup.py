"""Line dedup with a log-template tree, on DataFrame functions alone.

A line's tokens are what stands between ASCII white space, lower-cased.  A token
that holds a digit is a variable field (``<*>``) from the start.  The tree is of fixed
depth: its first level is the number of tokens, the next ``depth`` levels are the
leading tokens.  In a leaf, a token is constant at its place if at least the share
``constant`` of the leaf's lines have it there, else it is a variable field.  The
template of a line is its tokens with variable fields generalised.  If fewer than
``similarity`` of the tokens after the leading ones are constant, the line is too
unlike its leaf and stands for itself.  A template that ``min_docs`` documents or more
have recurs, and all its lines are dropped; a document counts once, however many of its
lines have the template.

Leaves with fewer than ``min_docs`` lines hold no recurring template, so only lines of
other leaves are kept past a first count.  Counts are partial sums before a shuffle;
joins are plain ones that AQE may split where a line, passage or text is hot.

Cases: null counts as the empty text; lines of under ``min_tokens`` tokens, blank ones
too, are kept and not counted; a text all of whose lines are dropped is empty; equal
texts get equal results and each counts as a document; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import bytes_of, materialise, text_of

DEPTH = 3
CONSTANT = 0.3
SIMILARITY = 0.7
MIN_DOCS = 4
MIN_TOKENS = 4
VARIABLE = "<*>"
#: a table of at most so many bytes (as Parquet) is broadcast, a larger one shuffled
BROADCAST_BYTES = 16 << 20
_SPACE = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\f\r"


def _tokens(line: Column) -> Column:
    return F.split(F.trim(line, F.lit(_BLANK)), _SPACE)


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.when(x.rlike("[0-9]"), VARIABLE).otherwise(x))


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """t (hash of the text), pos (from 0), tokens, leaf of every line that counts."""
    rows = docs.select(F.xxhash64(text_of()).alias("t"), F.posexplode(F.split(F.lower(text_of()), "\n")).alias("pos", "line"))
    rows = rows.select("t", "pos", _tokens(F.col("line")).alias("tokens")).filter(F.size("tokens") >= min_tokens)
    return rows.select("t", "pos", "tokens", F.xxhash64(F.size("tokens"), _masked(F.slice("tokens", 1, depth))).alias("leaf"))


def _small(df: DataFrame) -> DataFrame:
    """A materialised table, to be broadcast if its size allows it."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df


def recurring_lines(docs: DataFrame, *, depth: int = DEPTH, constant: float = CONSTANT, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """t, at (places of lines in the text), template, n_docs: every line with a recurring template."""
    busy = _lines(docs, depth, min_tokens).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("leaf")
    busy = _small(materialise(busy, "busy-leaves"))
    lines = _lines(docs, depth, min_tokens).join(busy, "leaf").select("t", "pos", "leaf", F.array_join(_masked(F.col("tokens")), " ").alias("masked"))
    lines = lines.groupBy("leaf", "masked", "t").agg(F.collect_set("pos").alias("at"), F.count(F.lit(1)).alias("n"))
    # rows of one text give a line's places as often as there are such rows
    lines = materialise(lines.select("leaf", "masked", "t", "at", (F.col("n") / F.size("at")).cast("long").alias("docs")), "lines")
    masked = lines.groupBy("leaf", "masked").agg(F.sum("docs").alias("docs"))
    leaves = masked.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs")).filter(F.col("leaf_docs") >= min_docs)
    masked = masked.join(leaves, "leaf")
    places = masked.select("leaf", "docs", "leaf_docs", F.posexplode(F.split("masked", " ")).alias("place", "token")).filter(F.col("place") >= depth)
    fixed = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n"), F.max("leaf_docs").alias("leaf_docs"))
    fixed = fixed.filter(F.col("n") >= F.col("leaf_docs") * constant)  # so 1 / constant tokens a place at most
    fixed = fixed.groupBy("leaf", "place").agg(F.collect_list("token").alias("tokens"))
    fixed = fixed.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("place", "tokens"))).alias("fixed"))
    is_fixed = F.transform(F.split("masked", " "), lambda x, i: (i < depth) | F.coalesce(F.array_contains(F.try_element_at("fixed", i), x), F.lit(False)))
    found = masked.join(fixed, "leaf", "left").select("leaf", "masked", "docs", is_fixed.alias("is_fixed"))
    alike = F.size(F.filter("is_fixed", lambda x: x)) - depth >= (F.size("is_fixed") - depth) * F.lit(similarity)
    general = F.array_join(F.transform(F.arrays_zip(F.split("masked", " ").alias("x"), "is_fixed"), lambda z: F.when(z["is_fixed"], z["x"]).otherwise(VARIABLE)), " ")
    found = found.select("leaf", "masked", "docs", F.when(alike, general).otherwise(F.col("masked")).alias("template"))
    found = materialise(found, "templates")
    # lines of one document may share a template: their sum is an upper bound only
    often = found.groupBy("leaf", "template").agg(F.sum("docs").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    found = found.join(often, ["leaf", "template"]).select("leaf", "masked", "template")
    own = lines.join(found, ["leaf", "masked"]).groupBy("leaf", "template", "t").agg(F.max("docs").alias("docs"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    own = materialise(own, "template-texts")
    often = own.groupBy("leaf", "template").agg(F.sum("docs").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return own.join(often, ["leaf", "template"]).select("t", "at", "template", "n_docs")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with recurring lines cut from ``text``; n_lines and n_dropped are added at the end."""
    drop = recurring_lines(docs, **options).groupBy("t").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("drop"))
    drop = _small(materialise(drop, "dropped-lines"))
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64(text_of()).alias("own_t"))
    both = packed.join(drop, F.col("own_t") == F.col("t"), "left")
    lines = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n")
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.size(gone) == 0, F.col("row.text")).otherwise(kept)
    return both.select(F.col("row").withField("text", text).alias("row"), F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped")).select("row.*", "n_lines", "n_dropped")


SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM doc),
tk AS (
  SELECT r, pos, list_transform(regexp_split_to_array(regexp_replace(lower(line), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
           '[\\x20\\x09-\\x0D]+'),
         lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{VARIABLE}' ELSE x END) AS tokens FROM ln),
li AS (SELECT r, list(pos) AS at, tokens, tokens[1:{DEPTH}] AS lead, len(tokens) AS k FROM tk WHERE len(tokens) >= {MIN_TOKENS} GROUP BY r, tokens),
masked AS (SELECT k, lead, tokens, count(*) AS docs FROM li GROUP BY k, lead, tokens),
leaves AS (SELECT k, lead, sum(docs) AS leaf_docs FROM masked GROUP BY k, lead HAVING sum(docs) >= {MIN_DOCS}),
places AS (SELECT m.k, m.lead, docs, leaf_docs, unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM masked m JOIN leaves l ON m.k = l.k AND m.lead = l.lead),
fixed AS (SELECT k, lead, list({{'place': place, 'token': token}}) AS fixed FROM
  (SELECT k, lead, place, token FROM places WHERE place >= {DEPTH} GROUP BY k, lead, place, token HAVING sum(docs) >= max(leaf_docs) * {CONSTANT}::DOUBLE) GROUP BY k, lead),
flags AS (
  SELECT m.k, m.lead, m.tokens, m.docs, list_transform(range(m.k), lambda i: i < {DEPTH} OR coalesce(list_contains(f.fixed, {{'place': i, 'token': m.tokens[i + 1]}}), false)) AS is_fixed
  FROM masked m JOIN leaves l ON m.k = l.k AND m.lead = l.lead LEFT JOIN fixed f ON m.k = f.k AND m.lead = f.lead),
temp AS (
  SELECT k, lead, tokens, docs, CASE WHEN len(list_filter(is_fixed, lambda x: x)) - {DEPTH} >= (k - {DEPTH}) * {SIMILARITY}::DOUBLE
    THEN list_transform(range(k), lambda i: CASE WHEN is_fixed[i + 1] THEN tokens[i + 1] ELSE '{VARIABLE}' END) ELSE tokens END AS template FROM flags),
own AS (SELECT li.r, li.at, t.k, t.lead, t.template FROM li JOIN temp t ON li.tokens = t.tokens),
often AS (SELECT k, lead, template FROM own GROUP BY k, lead, template HAVING count(DISTINCT r) >= {MIN_DOCS}),
gone AS (SELECT w.r, flatten(list(w.at)) AS drop FROM own w JOIN often o ON w.k = o.k AND w.lead = o.lead AND w.template = o.template GROUP BY w.r),
parts AS (SELECT d.r, d.doc_id, d.text, string_split(d.text, chr(10)) AS lines, coalesce(g.drop, []) AS drop FROM doc d LEFT JOIN gone g ON d.r = g.r)
SELECT doc_id,
       CASE WHEN len(drop) = 0 THEN text ELSE array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(drop, i)), lambda i: lines[i + 1]), chr(10)) END AS text,
       CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(drop) AS BIGINT) AS n_dropped FROM parts
"""
