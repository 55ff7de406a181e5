"""Near duplicates, decontamination, nearest neighbours, Katz scores, mixing, token files, pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetline.llm import ann, decontaminate, katz, mixing, neardup, tokenfile
from fleetline.llm.queries import vocabulary

# --- near duplicates


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.integers(0, 12))
def test_banded_alignment_counts_edits(a, b, most):
    assert neardup.banded_edits(a, b, most) == min(_edits(a, b), most + 1)


def test_long_texts_align_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    a = rng.integers(0, 60_000, 40_000).tolist()
    b = list(a)
    for at in rng.choice(len(b), 900, replace=False):
        b[at] = -1
    del b[17:27]
    tracemalloc.start()
    assert 880 <= neardup.banded_edits(a, b, 8_000) <= 910
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    short, n = neardup._SHORT, 300  # the same result with masks for frequent words only
    neardup._SHORT = 0
    try:
        for k in (0, 3, 40, 200):
            x = rng.integers(0, 400, n).tolist()
            y = [v if rng.random() > k / n else -1 for v in x][k // 10 :]
            assert neardup.banded_edits(x, y, 90) == min(_edits(x, y), 91)
    finally:
        neardup._SHORT = short


def test_occurrence_labels_and_order_enter_the_sketch():
    w = np.arange(1, 40, dtype=np.uint64)
    twice = neardup.labelled_kmers(np.r_[w[:6], w[:6]], 3)
    assert len(set(twice.tolist())) == len(twice)
    sketch = neardup.OrderMinHash()
    a, b = neardup.labelled_kmers(w), neardup.labelled_kmers(w)[::-1].copy()
    assert (sketch(a) == sketch(a)).all() and (sketch(a) == sketch(b)).mean() < 0.3


def _near_docs():
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 200)] for _ in range(30)]
    rows, group = [], {}
    for g, words in enumerate(base):
        for k in range(1 + g % 4):
            own = list(words)
            for _ in range(3 * (k > 0)):
                own[rng.integers(0, len(own))] = f"x{rng.integers(0, 9999)}"
            rows.append((100 * g + k, " ".join(own)))
            group[100 * g + k] = 100 * g
    rows += [(9000 + i, rows[0][1]) for i in range(5)]
    group |= {9000 + i: 0 for i in range(5)}
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(12):
        rows.append((7000 + i, " ".join(f"q{x}" for x in rng.integers(0, 9999, 150)) + " " + passage))
        group[7000 + i] = 7000 + i
    return rows, group


def test_near_classes_are_the_groups(spark):
    rows, group = _near_docs()
    out = neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == group
    size = Counter(group.values())
    assert all(r["n_class"] == size[r["class_id"]] for r in out)


def test_similar_texts_that_share_an_entry_are_in_one_class(spark):
    """Against brute force: scattered changes (pairs with a single common entry), and many families in a bucket."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    base = [[f"w{x}" for x in rng.integers(0, 5000, 100)] for _ in range(40)] + [[f"f{x}" for x in rng.integers(0, 5000, 60)] + passage for _ in range(10)]
    texts = []
    for words in base:
        for _ in range(3):
            own = list(words)
            for at in rng.choice(len(own), len(own) // 12, replace=False):
                own[at] = f"x{rng.integers(0, 99999)}"
            texts.append(" ".join(own))
    hasher = neardup.OrderMinHash()
    cache = neardup.HashCache()
    sigs = [hasher(neardup.labelled_kmers(neardup.hashes(neardup.words_of(t.encode()), cache))) for t in texts]
    pairs = [(i, j, int((sigs[i] == sigs[j]).sum())) for i in range(len(texts)) for j in range(i)]
    pairs = [(i, j, n) for i, j, n in pairs if n and neardup.similar(texts[i].encode(), texts[j].encode())]
    assert any(n == 1 for *_, n in pairs)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j, _ in pairs:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (neardup.BLOCK, 3):  # 3: buckets of several blocks
        out = neardup.near_classes(docs, block=block).collect()
        assert {r["doc_id"]: r["class_id"] for r in out} == {i: root(i) for i in range(len(texts))}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 3)], "a long, b long")
    roots = {r["node"]: r["root"] for r in neardup.components(links).collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {101: 100}


def test_near_edges(spark, edge_docs, no_docs):
    out = {(r["doc_id"], r["class_id"], r["n_class"]) for r in neardup.near_classes(edge_docs).collect()}
    assert {(7, 7, 2), (8, 7, 2), (5, 5, 2), (4, 4, 2), (1, 1, 3), (2, 1, 3), (None, 1, 3)} <= out
    kept = neardup.keep_one_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "None"]
    assert neardup.keep_one_each(no_docs).count() == 0


# --- decontamination

ITEM = "If Alice drives 120 km in 3 hours and then rests near the old stone bridge how far does Alice drive in 9 hours"


def _leaks(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["k"]["id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}


def test_leaks_verbatim_and_with_new_parameters(spark):
    new = ITEM.replace("Alice", "Robert").replace("120", "75").replace("3 hours", "5 hours").replace("km", "miles")
    other = "if you like to read and then rest near the old stone wall you can find a far better place than this one in hours"
    assert _leaks(spark, [f"x y z {ITEM} and so on", f"Before. {new}", other, "", None]) == {(0, 0), (1, 0)}


def test_inconsistent_slots_are_no_leak(spark):
    item = "we know that Alice walks to the old market and then Alice buys 12 apples because on the way home Alice eats 3 of them slowly"
    same = item.replace("Alice", "Robert").replace("12", "40")
    other = item.replace("Alice", "Robert", 1).replace("Alice", "Claudia", 1).replace("Alice", "Dora", 1)
    assert _leaks(spark, [same, other], [item]) == {(0, 0)}


def test_consistency_is_per_placement(spark):
    new = ITEM.replace("Alice", "Robert")
    assert _leaks(spark, [f"{ITEM} . {new}"]) == {(0, 0)}


def test_leaks_match_brute_force_windows(spark):
    rng = np.random.default_rng(1)
    items = [" ".join(f"v{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (30, 2))) for _ in range(5)]
    texts = []
    for i in range(40):
        filler = " ".join(f"z{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (50, 2)))
        cut = items[i % 5].split()[: [0, 10, 18, 24, 30][i // 8]]
        texts.append(" ".join([filler, *cut, filler]))
    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        have = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for k, item in enumerate(items):
            v = item.split()
            n = sum(tuple(v[i : i + 8]) in have for i in range(len(v) - 7))
            if n / (len(v) - 7) >= decontaminate.MIN_COVERAGE:
                want.add((d, k))
    assert want and _leaks(spark, texts, items) == want


FAMILY = "we know that Tom has 5 apples in the basket by the door and then buys {} more apples at the old market"


def test_items_of_one_template_are_matched_each(spark):
    bench = spark.createDataFrame([(0, FAMILY.format(5)), (1, FAMILY.format(7)), (2, ITEM), (2, FAMILY.format(5).replace("basket", "cellar"))], "item_id long, text string")
    docs = spark.createDataFrame([(0, FAMILY.format(7)), (1, ITEM), (2, FAMILY.format(5).replace("basket", "cellar").replace("door", "wall"))], "doc_id long, text string")
    found = {(r["k"]["id"], r["item_id"]): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert (0, 1) in found and found[0, 1]["coverage"] == 1  # was compared with item 0 alone, where 5 became 5 and 7
    assert (0, 0) not in found
    assert found[1, 2]["coverage"] == 1 and (2, 2) in found  # both texts of item 2


def test_items_of_placeholders_are_found_verbatim(spark):
    sums = "Compute 12 + 35 * 7 - 18 / 3"
    names = "Alice Robert Claudia Dora Emil Frida Gustav Hanna Ida Jonas"
    mixed = FAMILY.format(7) + " " + names  # held to its wordy windows where the names are new
    texts = [f"see here: {sums} and so on", f"they met {names} then", sums.replace("35", "36"), FAMILY.format(9).replace("Tom", "Ben") + " nobody else came"]
    assert _leaks(spark, texts, [sums, names, mixed]) == {(0, 0), (1, 1), (3, 2)}


def test_short_items_match_verbatim_on_word_borders(spark):
    items = ["Who wrote Hamlet?", "What is 2+2?", "Paris", "Good luck", "?!"]
    texts = ["He asked: who wrote HAMLET, then", "who wrote hamlets", "so what is 2 + 2 now", "what is 2 + 3", "in Paris they ate", "first\n  paris. \nlast", "good luck", "wish you good luck today", "?!"]
    assert _leaks(spark, texts, items) == {(0, 0), (2, 1), (5, 2), (6, 3)}


def test_a_family_is_joined_once_and_names_the_item_that_stands_there(spark):
    problem = "a farmer has {} cows and {} sheep on the green hill and wants to know how many animals there are in all"
    n = 300
    bench = spark.createDataFrame([(i, problem.format(i + 2, 5000 + i)) for i in range(n)] + [(n, problem.format(7, 7))], "item_id long, text string")
    docs = spark.createDataFrame([(i, "x " + problem.format(i + 2, 5000 + i)) for i in range(0, n, 2)] + [(1000 + i, problem.format(90_000 + i, 80_000 + i)) for i in range(150)] + [(5000, problem.format(66, 66))], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    by = {}
    for r in found:
        by.setdefault(r["k"]["id"], []).append(r)
    assert len(found) == 150 + 150 + 2  # linear in documents: the family, and for equal numbers the other family too
    assert all([r["item_id"] for r in by[i]] == [i] and by[i][0]["verbatim"] and by[i][0]["n_items"] == n for i in range(0, n, 2))
    assert all([r["item_id"] for r in by[1000 + i]] == [0] and not by[1000 + i][0]["verbatim"] for i in range(150))
    assert sorted(r["item_id"] for r in by[5000]) == [0, n]
    members = decontaminate.item_families(bench).groupBy("family").count().collect()
    assert sorted(r["count"] for r in members) == [1, n] and {r["family"] for r in members} == {r["family"] for r in found}


def test_decontamination_takes_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x", "So: " + ITEM), ("y", "nothing of it")], "doc_id string, text string")
    bench = spark.createDataFrame([("q1", ITEM)], "item_id string, text string")
    assert [(r["k"]["id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [("x", "q1")]
    assert [r["doc_id"] for r in decontaminate.drop_leaked(docs, bench).collect()] == ["y"]


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "a b c d e f"), (4, "one two"), (5, "the same row twice or so")], "item_id long, text string")
    assert decontaminate.drop_leaked(edge_docs, bench).count() == edge_docs.count()
    assert decontaminate.drop_leaked(edge_docs, bench).columns == edge_docs.columns
    assert decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.find_leaks(edge_docs, bench.limit(0)).count() == 0


# --- nearest neighbours


def test_nearest_reaches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 20)).astype(np.float32)
    x[40:60] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 20), (2002, [float("nan")] * 20), (2100, [1.0] * 3), (None, [1.0] * 20), (2200, [None] + [1.0] * 19)]
    vectors = ann.usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = ann.nearest(vectors, vectors.filter("id % 100 = 0"), 10, rerank=60, block_rows=1500, query_bytes=1000).toPandas()
    hit, d = 0, x.astype(float)
    for q in range(0, 1500, 100):
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        dist[q] = np.inf
        want = np.lexsort((np.arange(len(d)), dist))[:10]
        got = out[out.query_id == q].sort_values("rank")
        assert list(got["rank"]) == list(range(1, 11)) and np.all(np.diff(got.score) >= 0)
        assert np.allclose(got.score, dist[got.vec_id], rtol=1e-12)
        hit += len(set(want) & set(got.vec_id))
    assert hit >= 0.95 * 150
    assert list(out[out.query_id == 0].sort_values("rank").vec_id) == list(range(40, 50))


def test_recall_with_a_twentieth_of_a_block_ranked_again(spark):
    rng = np.random.default_rng(6)
    d = rng.normal(size=(4000, 32))
    vectors = ann.usable_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "vec_id long, embedding array<double>").coalesce(1))
    out = ann.nearest(vectors, vectors.filter("id % 100 = 0"), 10, rerank=160, block_rows=4000).toPandas()
    hit = 0
    for q in range(0, 4000, 100):
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        dist[q] = np.inf
        hit += len(set(np.argsort(dist)[:10]) & set(out[out.query_id == q].vec_id))
    assert hit >= 0.9 * 400


def test_only_queries_and_their_best_move(spark):
    """The scan is one stage over the index: no vector of the index is shuffled."""
    vectors = ann.usable_vectors(spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(500)], "vec_id long, embedding array<double>"))
    plan = ann.nearest(vectors, vectors.filter("id % 100 = 0"), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") and "Cogroup" not in plan and "Repartition" not in plan and "Join" not in plan


def test_nearest_edges(spark):
    few = ann.usable_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    out = ann.nearest(few, few.filter("id % 100 = 0"), 10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out) == [(0, 1, 100), (0, 2, 100), (0, 3, 1), (100, 1, 0), (100, 2, 1)]
    none = few.limit(0)
    assert ann.nearest(none, none).count() == 0


# --- Katz


def _katz_brute(train, texts):
    tok = lambda t: (t or "").encode().lower().split() + [b" e"]
    uni, pair, hist = Counter(), Counter(), Counter()
    for t in train:
        w = tok(t)
        uni.update(w)
        pair.update(zip([b" s", *w], w))
        hist.update([b" s", *w[:-1]])
    n = sum(uni.values())
    d1, d2 = katz.discounts(Counter(uni.values())), katz.discounts(Counter(pair.values()))
    dc = lambda c, d: c * (d[c] if c <= katz.GT_MAX else 1)
    p = {w: dc(c, d1) / n for w, c in uni.items()}
    unseen = 1 - math.fsum(p.values())
    if unseen < 1e-9:
        p, unseen = {w: c / (n + 1) for w, c in uni.items()}, 1 / (n + 1)
    mass, low = defaultdict(float), defaultdict(float)
    for (h, w), c in pair.items():
        mass[h] += dc(c, d2)
        low[h] += p[w]
    below = {h: hist[h] + (mass[h] > hist[h] * (1 - 1e-9)) for h in mass}
    alpha = {h: (1 - mass[h] / below[h]) / (1 - low[h]) for h in mass}
    prob = lambda h, w: dc(pair[h, w], d2) / below[h] if (h, w) in pair else alpha.get(h, 1.0) * p.get(w, unseen)
    for h in list(alpha)[:20]:  # each history's probabilities sum to one
        assert abs(sum(prob(h, w) for w in uni) + alpha[h] * unseen - 1) < 1e-9
    base = [sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in tok(t)) for t in texts]
    known = [sum(w in uni for w in tok(t)) for t in texts]
    return [sum(math.log10(prob(h, w)) for h, w in zip([b" s", *tok(t)], tok(t))) for t in texts], base, known, pair


@pytest.mark.parametrize("head, bucket_tokens", [(1 << 20, 4_000_000), (10, 100), (0, 60), (400, 30)])
def test_katz_matches_the_recursion(spark, head, bucket_tokens):
    """One bucket or many, all, some or no words in the head; no pair is dropped."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 300) for _ in range(200)] + [None, "", "never seen words", "tick w1 tick never tick"]
    texts[:8] = ["tick tock " * 30, "tick tock tick tack " * 12] * 4  # a history none of whose pairs is rare
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, model = katz.train_and_score(docs, F.col("doc_id") < 150, head=head, bucket_tokens=bucket_tokens)
    out = {r["doc_id"]: r for r in found.collect()}
    score, base, known, pair = _katz_brute(texts[:150], texts)
    assert len(out) == len(texts)
    for i, s in enumerate(score):
        assert abs(out[i]["score"] - s) < 1e-6 * max(1, abs(s)) and abs(out[i]["base_score"] - base[i]) < 1e-6 * abs(base[i]) and out[i]["n_known"] == known[i]
    assert out[201]["n_tokens"] == 1 and out[202]["n_known"] == 1
    stored = model.pairs.select(F.explode("counts").alias("c")).agg(F.count("c").alias("n"), F.sum("c").alias("c")).first()
    assert (stored["n"], stored["c"]) == (len(pair), sum(pair.values()))


def test_katz_edges(spark, edge_docs, no_docs):
    out = katz.score_documents(edge_docs)
    rows = out.collect()
    assert len(rows) == edge_docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert katz.score_documents(no_docs).count() == 0
    named = edge_docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert katz.score_documents(named).count() == len(rows)
    untrained = katz.train_and_score(edge_docs, F.lit(False))[0].collect()
    assert len(untrained) == len(rows) and all(r["score"] == 0 and r["n_known"] == 0 for r in untrained)


# --- mixing


def _water(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, total = {}, set(names), sum(sizes.values())
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over


def test_targets_are_the_reshared_shares(spark):
    sizes = {"a": 10, "b": 400, "c": 35, "d": 2, "e": 700, None: 90}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = _water(sizes, mixing.WEIGHTS)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_comes_near_its_targets_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).toPandas()
    again = mixing.mix_plan(docs.repartition(7)).toPandas()
    key = ["doc_id"]
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    assert plan.sort_values(key).copies.tolist() == again.sort_values(key).copies.tolist()
    assert plan.copies.between(0, 3).all() and len(plan) == len(rows)
    plan["taken"] = plan.copies * plan["size"]
    by = plan.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 40).all()


def test_mixed_documents_are_repeated(spark, edge_docs, no_docs):
    out = mixing.mix_documents(edge_docs)
    assert out.columns == edge_docs.columns
    plan = mixing.mix_plan(edge_docs)
    assert out.count() == plan.agg(F.sum("copies")).first()[0] and plan.count() == edge_docs.count()
    assert mixing.mix_documents(no_docs).count() == 0


def test_mixing_takes_ids_of_any_type(spark, edge_docs):
    docs = edge_docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    plan = mixing.mix_plan(docs)
    assert dict(plan.dtypes)["doc_id"] == "string" and plan.count() == docs.count()
    assert mixing.mix_documents(docs).count() == plan.agg(F.sum("copies")).first()[0]
    big = spark.createDataFrame([(2**60 + i, "a b c", "s") for i in range(50)] + [(None, "x", "s")], "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.mix_plan(big).collect()} == {2**60 + i for i in range(50)} | {None}


def test_repeated_rows_share_their_copies_and_meet_in_no_one_task(spark, monkeypatch):
    rows = [(None, "one two three", "hot", i) for i in range(3000)] + [(i, "w " * (i % 9 + 1), "hot" if i % 2 else "cold", i) for i in range(900)] + [(7000, "", "cold", 0)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    groups = mixing.mix_groups(docs)
    assert groups.count() == 902  # the repeated rows are one group, however many
    monkeypatch.setattr(mixing, "TURNS", 64)
    plan = mixing.mix_plan(docs).toPandas()
    assert len(plan) == len(rows) and (plan[plan["size"] == 0].copies == 0).all()
    hot = plan[plan.doc_id.isna()]
    assert len(hot) == 3000 and hot.copies.max() - hot.copies.min() <= 1
    by = plan.assign(taken=plan.copies * plan["size"]).groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 10).all()
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == plan.copies.sum()
    taken = out.filter("doc_id IS NULL").groupBy("extra").count().toPandas()["count"]
    assert taken.sum() == hot.copies.sum() and taken.max() <= hot.copies.max()


# --- token files

ODD = ["<|ENDOFTEXT|> AND <|endoftext|>", "don't we'll I'M <|endoftext|> a<|startoftext|>b", "ÀÉ İstanbul ΣΑΣ. straße Ǆ x y z\x1cq 3.14 éa,", "café?! ... --a-- 日本語テキスト。 русский, ١٢٣", "", "\n \t"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_their_text(text):
    enc = _encoder()
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode([text.encode("utf-8", "replace")])[0], enc.dtype).tolist() == want or "\ud800" <= max(text, default="") <= "\udfff"


def _encoder(cache={}):  # noqa: B006
    if not cache:
        cache["x"] = tokenfile.WordEncoder(vocabulary(), limit=10_000)
    return cache["x"]


def test_letters_marks_and_signs_encode_as_whole_texts():
    """Words of all kinds of letters, with marks, before and after signs."""
    rng = np.random.default_rng(11)
    import unicodedata

    letters = [chr(c) for c in range(0x24F) if unicodedata.category(chr(c))[0] == "L"] + list("İıſǅßΣςŉǰΐẞﬁKÅΩЁйअका日本한") + ["\u0307", "\u0301", "\u0338", "\u093c", "\u200d", "\u00a0", "\u1112\u1161\u11ab"]
    signs = list(".,;:!?#$%&*()-\"'“…·/@") + ["'s", "'ll", "<|", "|>", "1", "²"]
    enc, texts = _encoder(), ["TARİHİ, 1923.", "TEMİZLİĞİ!", "İ. İ İ.İ", "x\u0307. \u0307. K\u030c!"]
    for _ in range(5_000):
        words = ["".join(rng.choice(letters, rng.integers(0, 6))) + "".join(rng.choice(signs, rng.integers(0, 4))) + "".join(rng.choice(letters, rng.integers(0, 2))) for _ in range(4)]
        texts.append(" ".join(words))
    want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for lo in range(0, len(texts), 700):
        got = enc.encode([t.encode() for t in texts[lo : lo + 700]])
        for t, g, w in zip(texts[lo : lo + 700], got, want[lo : lo + 700]):
            assert np.frombuffer(g, enc.dtype).tolist() == w, t


def test_caches_are_bounded_in_bytes():
    enc = tokenfile.WordEncoder(vocabulary(), limit=20_000)
    blob = "q" * 3_000_000
    ids = np.frombuffer(enc.encode([f"one {blob} two".encode()])[0], enc.dtype)
    assert len(ids) > 1000 and not any(len(w) > tokenfile.LONGEST for w in enc.known)
    for i in range(50):
        enc.encode([" ".join(f"w{i}x{j}" for j in range(100)).encode()])
        assert enc.held <= 20_000 + 100 * 250
    assert enc.held == sum(map(len, enc.known)) + sum(map(len, enc.known.values())) + tokenfile._ENTRY * len(enc.known)
    from fleetline.llm.common import HashCache

    cache = HashCache()
    assert cache[b"z" * 100_000] and cache[b"short"] and list(cache) == [b"short"]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import public_tokenizers

    enc = tokenfile.WordEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert not enc.by_word and _encoder().by_word
    for text in ODD:
        assert np.frombuffer(enc.encode([text.encode()])[0], enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_odd_texts_encode_as_whole():
    enc = _encoder()
    for text in ODD:
        assert np.frombuffer(enc.encode([text.encode()])[0], enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_file_round_trip(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 49_000, n).astype("<u2") for n in (5, 0, 1000, 3, 77, 128)]
    w = tokenfile.TokenWriter(f"file://{tmp_path}/x.arrow", np.dtype("<u2"), length=16, rows=4)
    for d in docs:
        w.add(d)
    w.close()
    r = tokenfile.TokenReader(f"file://{tmp_path}/x.arrow")
    at = 0
    for d in docs:
        assert (r.read(at, len(d)) == d).all()
        at += len(d)
    flat = np.concatenate(docs)
    ids, mask = r.sequence(3)
    assert (ids == flat[48:64]).all() and all(mask.to_pylist())
    last, mask = r.sequence((len(flat) - 1) // 16)
    mask = np.array(mask.to_pylist())
    assert mask.sum() == (len(flat) - 1) % 16 + 1 and (last[~mask] == 0).all()
    with pytest.raises(EOFError):
        r.read(len(flat) + 600, 10)


def test_token_digest_is_that_of_whole_texts(spark, edge_docs, no_docs):
    rows = [(i * 7 % 50, t) for i, t in enumerate(ODD * 5) if i * 7 % 50 not in (7,)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in tokenfile.encode_documents(spark, docs, vocabulary()).collect()}
    at, enc = 0, _encoder()
    for d, t in sorted(rows):
        ids = np.array([*enc.tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (out[d]["start"], out[d]["n_tokens"], out[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    named = docs.select(F.format_string("d%03d", "doc_id").alias("doc_id"), "text")  # ids of any type
    assert {int(r["doc_id"][1:]): r["ids_crc32"] for r in tokenfile.encode_documents(spark, named, vocabulary()).collect()} == {d: r["ids_crc32"] for d, r in out.items()}
    assert tokenfile.encoder_of(vocabulary()) is tokenfile.encoder_of(vocabulary())
    assert tokenfile.encode_documents(spark, edge_docs, vocabulary()).count() == edge_docs.count()
    assert tokenfile.encode_documents(spark, no_docs, vocabulary()).count() == 0


# --- pipeline


def test_pipeline_stages_keep_the_schema_and_do_their_work(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 3000, 80))
    rows = [(i, text(), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "s0", 1) for i in range(10)]
    rows += [(300 + i, text() + " idiot", "en", "s1", 1) for i in range(30)]
    rows += [(400, text() + " " + ITEM + " " + text(), "en", "s2", 1), (500, None, None, None, None)]
    labels = [(i, 1, int(i >= 300)) for i in [*range(0, 100), *range(300, 325)]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        out = spark.read.parquet(f"{tmp_path}/out{i}")
        if name != "token_file":
            assert out.columns == docs.columns
        seen[name] = [r["doc_id"] for r in out.select("doc_id").collect()]
        docs = out
    assert set(seen["toxicity"]) == {r[0] for r in rows if not 300 <= r[0] < 400}
    assert set(seen["near_dedup"]) == set(seen["toxicity"]) - set(range(200, 210))
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {400}
    assert sorted(seen["token_file"]) == sorted(seen["mixing"]) and set(seen["mixing"]) <= set(seen["decontamination"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen["token_file"])


@pytest.mark.parametrize("kind", ["empty", "repeated", "clashing"])
def test_pipeline_runs_on_odd_tables(spark, tmp_path, kind):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, 40)), "en", f"s{i % 2}", 1) for i in range(40)]
    rows = {"empty": [], "repeated": rows[:5] * 12 + [(None, None, None, None, None)] * 9 + [(None, rows[0][1], "en", "s0", 1)] * 4, "clashing": rows}[kind]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if kind == "clashing":
        docs = docs.withColumns({c: F.lit(1) for c in ("row", "k", "h", "t", "p", "n", "size", "block", "copy", "score", "turn", "node", "root", "item_id", "target", "start")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    ids = [r.doc_id for r in out.collect()]
    if kind == "empty":
        assert ids == []
    elif kind == "clashing":
        assert len(set(ids)) > 25
    else:
        assert set(ids) <= {0, 1, 2, 3, 4, None} and ids


def test_words_of_a_batch_are_looked_up_once():
    enc = tokenfile.WordEncoder(vocabulary())
    looks = []

    class Seen(dict):
        def __getitem__(self, w):
            looks.append(w)
            return super().__getitem__(w)

    enc.known = Seen()
    texts = [t.encode() for t in [*ODD, " Twice twice\ttwice, ", "", "\n", "twice, " * 300] * 3]
    flat, n = enc.encode_flat(texts, 1)
    want = [[*enc.tokenizer.encode(t.decode(), add_special_tokens=False).ids, 1] for t in texts]
    assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    assert looks.count(b"twice,") <= 1 and looks.count(b"twice") <= 2
    assert [x.tolist() for x in enc.encode_flat([], 1)] == [[], []] and enc.encode([]) == [] and enc.encode([b""]) == [b""]
