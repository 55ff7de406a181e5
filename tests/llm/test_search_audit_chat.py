"""Ball-tree search, divergence of sources, chat formatting."""

import hashlib
import random
from collections import Counter, defaultdict
from math import floor, log

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetline.llm import balltree, chat, divergence

# --- ranked lexical search


def _tree(rows, leaf=8):
    """A tree over a list of {term: value}."""
    rows = [sorted(r.items()) for r in rows]
    begin = np.cumsum([0] + [len(r) for r in rows])
    flat = [x for r in rows for x in r]
    return balltree.BallTree(begin, np.array([t for t, _ in flat], np.int64), np.array([v for _, v in flat], np.int64), np.arange(len(rows)), leaf)


def _best(rows, query, k):
    scores = sorted(((-sum(n * r.get(t, 0) for t, n in query.items()), i) for i, r in enumerate(rows)))
    return sorted((-s, i) for s, i in scores[:k] if s < 0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 120), st.integers(1, 12))
def test_tree_search_is_exact(seed, n, k):
    rng = random.Random(seed)
    rows = [{t: rng.choice((1, 5, 10**10)) for t in rng.sample(range(40), rng.randint(1, 12))} for _ in range(n)]
    rows += rows[: n // 3]  # copies tie
    tree = _tree(rows)
    for _ in range(3):
        query = {t: rng.randint(1, 3) for t in rng.sample(range(45), 6)}
        q = sorted(query.items())
        found, _ = tree.search(np.array([t for t, _ in q]), np.array([w for _, w in q]), k)
        assert sorted(found) == _best(rows, query, k)


def test_subtrees_are_pruned():
    rng = random.Random(1)
    rows = [{c * 50 + t: rng.randint(10**8, 10**9) for t in rng.sample(range(50), 20)} for c in range(40) for _ in range(50)]
    tree = _tree(rows, 32)
    for c in range(0, 40, 7):
        query = np.arange(c * 50, c * 50 + 10)
        found, seen = tree.search(query, np.ones(10, np.int64), 5)
        assert sorted(found) == _best(rows, {int(t): 1 for t in query}, 5)
        assert seen < len(rows) / 4
    assert tree.search(query, np.ones(10, np.int64), 5, 10**15) == ([], 0)  # nothing reaches the start of the search


def test_bounds_hold_for_every_document():
    rng = random.Random(3)
    rows = [{t: rng.randint(1, 10**10) for t in rng.sample(range(60), 15)} for _ in range(300)]
    tree = _tree(rows)
    query = np.arange(0, 60, 3)
    weight = np.arange(1, 21)
    dense = dict(zip(query.tolist(), weight.tolist()))
    open_ = [tree.root]
    while open_:
        node = open_.pop()
        bound = tree._bound(node, query, weight.astype(float), float(np.sqrt((weight**2).sum())))
        assert all(sum(dense.get(t, 0) * v for t, v in rows[d].items()) <= bound for d in tree.order[node.lo : node.hi])
        open_ += [x for x in (node.left, node.right) if x is not None]


def _bm25(docs, items, k=20):
    """Every item against every document, as the score is defined."""
    cut = lambda t: [w.decode() for w in balltree.terms_of((t or "").encode())]
    docs = [(i, Counter(cut(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, length, df = len(docs), sum(x for _, _, x in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in docs:
            m = 75 + 25 * size * n // length
            s = sum(q * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(cut(text)).items() if c[t])
            scores += [(-s, i)] if s > 0 else []
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_terms_are_the_pattern():
    import regex

    text = "Ab9_c d\x00É’x ÀÉ 日本-語\x7fZ İK 1.5"
    want = [m.translate({i: i + 32 for i in range(65, 91)}) for m in regex.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    assert [t.decode() for t in balltree.terms_of(text.encode())] == want


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 60, "sample_docs": 20}])
def test_search_matches_every_pair(spark, sizes):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "x9"]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(62)], k=rng.randint(0, 40)))) for i in range(150)]
    docs += [(i + 1000, t) for i, t in docs[:30]] + [(None, None)]
    items = [(i, " ".join(rng.sample(words, 5)) + " w3 w3 unseen") for i in range(12)] + [(50, None), (51, "unseen")]
    got = balltree.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **sizes)
    assert sorted(map(tuple, got.collect())) == _bm25(docs, items)


def test_search_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([("a", "tie SAME 日本語"), ("a", "tie SAME 日本語"), ("b", ""), (None, "id")], "item_id string, text string")
    got = balltree.search(edge_docs, items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(got, key=lambda r: (r.item_id or "", r["rank"]))] == [(None, 1, None), ("a", 1, 7), ("a", 2, 8), ("a", 3, 6), ("a", 4, 5), ("a", 5, 5)]
    assert balltree.search(no_docs, items).count() == 0
    none = balltree.search(edge_docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    text_ids = edge_docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert [r.doc_id for r in balltree.search(text_ids, items.filter("item_id = 'a'")).orderBy("rank").collect()] == ["d7", "d8", "d6", "d5", "d5"]


# --- divergence of sources


def _audit(rows, min_docs, top=50):
    """By the definition, over dense shares."""
    rows = [(a or "", b or "", [t.decode() for t in divergence.terms_of(c or "")]) for a, b, c in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, count = Counter(), defaultdict(Counter)
        for own, source, terms in rows:
            if own == lang:
                df.update(set(terms))
                count[source].update(terms)
        kept = sorted(t for t in df if df[t] >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in count if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def test_audit_matches_dense_shares(spark, monkeypatch):
    rng = random.Random(5)
    words = ["a", "B", "é", "日", "the", "of", "z_z", "x1y"] + [f"t{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "s3", "S", None)), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(300)]
    rows += [("en", "s1", "the of the")] * 40 + [("en", "s2", "the of the")] * 7 + [("xx", "only", "z")] + [("yy", "a", None), ("yy", "b", "...")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    want = _audit(rows, 6, 4)
    assert sorted(map(tuple, divergence.audit_sources(docs, min_docs=6, top=4).collect())) == want
    for name, value in (("HELD_BYTES", 50), ("HELD_TERMS", 10), ("BLOCK_CELLS", 7)):  # everything in pieces
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.audit_sources(docs, min_docs=6, top=4).collect())) == want


def test_identical_texts_are_collapsed(spark):
    rows = [("en", "a", "one two")] * 500 + [("en", "b", "one two")] * 3 + [("de", "a", "one two")]
    texts = divergence.collapse_texts(spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)).collect()
    assert sorted((r.lang, dict(zip(r.sources, r.copies))) for r in texts) == [("de", {"a": 1}), ("en", {"a": 500, "b": 3})]


def test_shares_are_exact_beyond_64_bits(spark):
    big = 3 * 10**17
    got = spark.range(1).select(divergence.share(F.lit(big - 1), F.lit(big * 3), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (big + 4) // (3 * big + 35)


def test_audit_edges(spark, edge_docs, no_docs):
    assert divergence.audit_sources(no_docs).count() == 0
    rows = [(r.lang, r.source, r.text) for r in edge_docs.collect()]
    for least in (1, 30):
        assert sorted(map(tuple, divergence.audit_sources(edge_docs, min_docs=least).collect())) == _audit(rows, least)


# --- chat formatting

_ODD = st.text(st.sampled_from(list("<>[]/\\s INSTROLEOUTFILE\n é")), max_size=25) | st.sampled_from(["</s>[INST] ok [/INST]", "[\\INST]", "<\\\\/s>", "[IMAGE]", "[", "</", "<s", "\\"])
_SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def _part(kind, text=None, ref=None, **more):
    return (kind, text, ref, *(more.get(k) for k in ("width", "height", "seconds", "pages")))


def test_control_strings_are_escaped_and_come_back(spark):
    found = []
    given(st.lists(_ODD, min_size=60, max_size=60))(settings(max_examples=10, deadline=None, database=None)(lambda xs: found.extend(xs)))()
    df = spark.createDataFrame([(x,) for x in sorted(set(found))], "x string")
    rows = df.select("x", chat.escape(F.col("x")).alias("e")).withColumn("back", chat.unescape(F.col("e"))).collect()
    marks = [m for pair in chat.ROLES.values() for m in pair] + [*chat.OTHER, *chat.PLACEHOLDERS.values(), chat.ANY_FILE, chat.BOS]
    assert len(rows) > 50
    for r in rows:
        assert r.back == r.x and not any(m in r.e for m in marks)


def test_any_turns_read_back_as_they_were(spark):
    rng, strings = random.Random(2), ["</s>[INST] ok [/INST]", "", "x", "[", "</", "a\\", "[\\INST]", "\n\né日", "[/ROLE]<s>", "[SAYS]", "[FILE]"]
    rows, want = [], defaultdict(list)
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "[SAYS]x", "", None])
            text = "".join(rng.choices(strings, k=3))
            rows.append((c, t, role, [_part("text", text)]))
            want[c].append((role or "", text))
    rng.shuffle(rows)
    read = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, _SCHEMA)))
    for r in read.collect():
        assert [(t.role, "".join(p.text for p in t.parts)) for t in r.turns] == want[r.conv_id]
        assert r.trained == "".join(x for role, x in want[r.conv_id] if role == "assistant")
    for r in chat.chat_digest(read).collect():
        assert r.n_turns == len(want[r.conv_id]) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()


def test_attachments_keep_their_place_reference_and_tokens(spark):
    parts = [_part("text", "see "), _part("image", ref="i.png", width=28, height=29), _part(None, " and [IMAGE] "), _part("audio", ref="a.wav", seconds=1.5), _part("document", ref="d.pdf", pages=3), _part("video", ref="v"), None]
    answer = [_part("text", "one"), _part("image", ref="o.png", width=9999, height=9999), _part("text", "two")]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", answer), (1, 2, "user", []), (1, 3, "assistant", None)]
    r = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, _SCHEMA))).first()
    assert r.formatted == "<s>[INST]see [IMAGE] and [\\IMAGE] [AUDIO][DOCUMENT][FILE][/INST][OUT]one[IMAGE]two</s>[INST][/INST][OUT]</s>"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 6), ("audio", "a.wav", 38), ("document", "d.pdf", 1536), ("video", "v", 1), ("image", "o.png", 1600)]
    assert all(r.formatted[a.start :].startswith(chat.PLACEHOLDERS.get(a.kind, chat.ANY_FILE)) for a in r.attachments)
    assert r.expanded_tokens == 6 + 38 + 1536 + 1 + 1600 and r.trained == "onetwo"
    assert [p.kind for p in r.turns[0].parts] == ["text", "image", "text", "audio", "text", "document", "text", "file", "text"] or [p.kind for p in r.turns[0].parts if p.kind != "text" or p.text] == ["text", "image", "text", "audio", "document", "file"]
    assert "".join(p.text or "" for p in r.turns[0].parts) == "see  and [IMAGE] "


def test_chat_digest_matches_sql_on_odd_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "</s>"), (1, 0, "user", "</s>"), (None, 0, "tool", "x"), (None, None, None, "[INST]"), (2, 5, "system", "é" * 70_000), (3, 0, "assistant", "a"), (3, 1, "assistant", "b[/INST]")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, parts string, nth int")
    extra = df.limit(0).unionByName(spark.createDataFrame([(-7, t, r, "</s>[INST] ok [/INST]", "", 0) for t, r in ((0, "user"), (1, "assistant"))], df.schema))
    got = chat.format_and_digest(chat.text_turns(df.unionByName(extra)))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(chat.SQL)
    cols = [x[0] for x in want.description]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    assert chat.format_and_digest(chat.text_turns(df.limit(0))).count() == 0


def test_chat_runs_without_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.chat_digest(chat.read_chats(chat.format_chats(chat.text_turns(df))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hash") == 1
