"""N-gram join, embedding near-duplicates, top-k search, components."""

import collections
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from qforge.llm import cells, cover_tree, jaccard_join, m_tree, shingles
from qforge.llm.common import Scratch, components


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(30)] + [(7, 7)]
    frame = spark.createDataFrame(edges + edges[:5], "a long, b long")
    got = {r.node: r.root for r in components(frame, Scratch(spark, "cc")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(frame.limit(0), Scratch(spark, "cc")).count() == 0


def shingle_texts(text, width):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    passage = [rnd.choice(words) for _ in range(60)]
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 150))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    hot = [rnd.choice(words) for _ in range(120)]                # one large group of near copies
    for _ in range(150):
        copy = list(hot)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(120)] = rnd.choice(words)
        texts.append(" ".join(copy))
    for _ in range(80):                                          # a passage that many texts share
        texts.append(" ".join(passage + [rnd.choice(words) for _ in range(rnd.randint(1, 60))]))
    texts += ["", " \n", None, None, "one two", "ONE two", "one two three", "x" * 200_000 + " y", "w " * 30_000, "ａ b c d e f", texts[0].upper(), texts[0]]
    return texts


@pytest.mark.parametrize("width,num,den", [(4, 85, 100)])
def test_jaccard_join_equals_brute_force(spark, width, num, den):
    texts = corpus()
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(6)
    path = Scratch(spark, "t").keep(frame, "docs")
    got = jaccard_join.similar_texts(path, width, num, den).collect()
    assert len(got) == len(rows)
    sets = [shingle_texts(t, width) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i]
             and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    count = collections.Counter(x for e in links for x in e)
    root = groups(range(len(rows)), links)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    want = sorted(((d, len(sets[i]), count[i], least.get(root[i]) if sets[i] else d) for i, (d, _, _) in enumerate(rows)), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got), key=repr) == want
    assert len(links) > 1000
    # the filter keeps one row of each component and all rows without shingles
    kept = jaccard_join.one_of_each(path, width, num, den)
    assert kept.columns == path.columns
    assert kept.count() == len({root[i] for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)


def test_jaccard_join_of_mixed_levels(spark, monkeypatch):
    # texts of level 1 meet texts of higher levels; third texts share single shingles and so move hubs
    monkeypatch.setattr(jaccard_join, "choose_level", lambda n, cost, first: min(1 + n % 3, n - first + 1))
    rnd = random.Random(11)
    texts = []
    for _ in range(60):
        base = rnd.sample([f"w{i}" for i in range(400)], rnd.randint(4, 12))
        texts += [" ".join(base), " ".join(base[1:]), " ".join(base + [rnd.choice(base) + "x", f"w{rnd.randrange(400)}"])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = Scratch(spark, "t").keep(frame, "docs")
    sets = [shingle_texts(t, 1) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])]
    count = collections.Counter(x for e in links for x in e)
    root = groups(range(len(texts)), links)
    got = jaccard_join.similar_texts(path, 1, 60, 100).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == {i: (count[i], root[i]) for i in range(len(texts))}


def test_one_of_each_when_files_are_split_anew(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 2 if i % 3 else i}_{k}" for k in range(20))) for i in range(240)]
    path = Scratch(spark, "t").keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(12), "docs")
    survey, setting = jaccard_join.similar_texts, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)

    def survey_then_other_splits(*args):
        found = survey(*args)
        spark.conf.set(setting, "64k")
        return found
    monkeypatch.setattr(jaccard_join, "similar_texts", survey_then_other_splits)
    try:
        kept = [r.doc_id for r in jaccard_join.one_of_each(path).collect()]
    finally:
        spark.conf.set(setting, before)
    least = {}
    for i, t in reversed(rows):
        least[t] = i
    assert sorted(kept) == sorted(least.values()) and len(kept) < len(rows)


def test_jaccard_join_of_nothing(spark):
    frame = Scratch(spark, "t").keep(spark.createDataFrame([], "doc_id long, text string"), "docs")
    assert jaccard_join.similar_texts(frame).count() == 0


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 30))) for _ in range(400)).encode()
    whole = shingles.word_hashes(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(shingles, "PIECE", 97)
    assert (shingles.word_hashes(np.frombuffer(text, np.uint8)) == whole).all()
    by_word = dict(zip(text.split(), whole.tolist()))
    assert len(set(by_word.values())) == len(by_word)
    assert [by_word[w] for w in text.split()] == whole.tolist()


def test_choose_level_prefers_longer_prefixes_for_frequent_shingles():
    assert jaccard_join.choose_level(100, np.zeros(40), 16) == 1
    assert jaccard_join.choose_level(100, np.full(40, 500.0), 16) > 1
    assert jaccard_join.choose_level(1, np.zeros(1), 1) == 1


VECTORS = "vec_id long, embedding array<float>, label int, n_links string"


def vectors(seed=7, n=400, dim=8):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    rows = [(i, [float(x) for x in (centres[i % 12] + rnd.normal(size=dim) * 0.25).astype(np.float32)], i % 3, "x") for i in range(n)]
    rows += [(1000 + i, rows[5][1], rows[5][2], "x") for i in range(30)]           # one common vector
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1, "x"), (2001, [], 1, "x"), (2002, [0.0] * dim, 1, "x"), (2003, [nan] * dim, 1, "x"), (2004, [inf] + [1.0] * (dim - 1), 1, "x"),
             (2005, [None] + [1.0] * (dim - 1), 1, "x"), (2006, rows[5][1], None, "x"), (2007, [1.0, 2.0], 1, "x"), (2008, [1.0, 2.0], 1, "x"),
             (None, rows[5][1], rows[5][2], "x"), (7, rows[7][1], rows[7][2], "x"), (2009, [2 * x for x in rows[5][1]], rows[5][2], "x"), (2020, [1e30] * dim, 1, "x")]
    return rows


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(cover_tree, "CELL", 64)
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = cover_tree.near_vectors(frame, threshold=0.93).collect()
    links = []
    for i, (_, a, la, _) in enumerate(rows):
        for j in range(i):
            b, lb = rows[j][1], rows[j][2]
            if la is not None and la == lb and fine(a) and fine(b) and len(a) == len(b) and any(a) and any(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                    links.append((i, j))
    count = collections.Counter(x for e in links for x in e)
    root = groups(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(r[0], least.get(root[i], r[0]))
    want = sorted(((r[0], count[i], least.get(root[i], r[0]), least.get(root[i], r[0]) == r[0]) for i, r in enumerate(rows)), key=repr)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == want
    assert cover_tree.near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_of_extreme_size(spark):
    rows = [(1, [1e-200, 0.0], 0), (2, [2e-200, 0.0], 0), (3, [1e200, 1e200], 0), (4, [2e200, 2e200], 0), (5, [5e-324, 0.0], 0),
            (6, [1.7e308, 1.7e308], 0), (7, [0.0, 1e-310], 0), (8, [0.0, -3.0], 0), (9, [0.0, 1e-310, 0.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_vectors(frame).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (2, 3), 4: (2, 3), 6: (2, 3), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_cover_tree_levels():
    rnd = np.random.default_rng(8)
    x = np.stack([cover_tree._unit(v) for v in rnd.normal(size=(300, 4))])
    tree = cover_tree.CoverTree(x, np.arange(300))

    def walk(node):
        rows = node.members if not node.children else np.concatenate([walk(c) for c in node.children])
        assert (np.sqrt(((x[rows] - x[node.centre]) ** 2).sum(1)) <= node.radius + 1e-6).all()
        if node.children:
            assert node.children[0].centre == node.centre
            assert all(c.radius <= node.radius / 2 + 1e-6 for c in node.children)
        return rows
    assert sorted(walk(tree.root).tolist()) == list(range(300))


def in_64_bits(score):
    return max(-1 << 63, min((1 << 63) - 1, score))


def top_k_by_hand(rows, k):
    """query_id, rank, vec_id, score of every query, exactly."""
    ints = [[math.floor(64 * Fraction(x)) for x in v] for _, v in rows]
    out = []
    for i, (query, _) in enumerate(rows):
        if query % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[i], ints[j])), rows[j][0], j) for j in range(len(rows))
                          if j != i and len(ints[j]) == len(ints[i]))[:k]
            out += [(query, rank, vec_id, in_64_bits(-score)) for rank, (score, vec_id, _) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("count", [1, 2, 20, 21, 22])
def test_top_k_of_few_vectors(spark, count):
    """A query is no candidate of itself, however few there are."""
    rnd = random.Random(count)
    rows = [(20 * i, [rnd.uniform(-2, 2) for _ in range(3)]) for i in range(count)] + [(20 * i, [rnd.random()]) for i in range(count // 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert sorted(tuple(r) for r in m_tree.top_k(frame).collect()) == top_k_by_hand(rows, 20)


def test_top_k_far_out(spark, monkeypatch):
    """Scores up to and beyond 64 bits; nothing is left out."""
    monkeypatch.setattr(m_tree, "PAGE", 8)
    monkeypatch.setattr(m_tree, "BLOCK", 4)
    rnd = random.Random(9)
    sizes = [1, 1, 1e3, 4e7, 4e7, 1e12, 1e30, 1e160, 1.7e308]
    rows = [(i * 5, [rnd.choice((-1, 1)) * rnd.uniform(0.3, 1) * rnd.choice(sizes) for _ in range(2)]) for i in range(80)]
    rows += [(7, [4e7, 1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [0.0, 0.0]), (2, [-1e300, 1e300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in m_tree.top_k(frame, k=6).collect())
    assert got == top_k_by_hand(rows, 6) and any(r[3] == (1 << 63) - 1 for r in got) and (20, 1, 7) not in got
    values = [0, 1, -1, 255, 256, -255, -256, 1 << 900, -(1 << 900), (1 << 63), -(1 << 63) - 1] + [rnd.randint(-1 << 100, 1 << 100) for _ in range(50)]
    assert sorted(values) == sorted(values, key=m_tree._sortable)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rows = [(a, v, lb, x) for a, v, lb, x in vectors(n=500)]
    monkeypatch.setattr(m_tree, "PAGE", 64)
    monkeypatch.setattr(m_tree, "BLOCK", 8)
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = collections.defaultdict(list)
    for r in m_tree.top_k(frame, k=20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ints = [[math.floor(64 * Fraction(float(np.float32(x)))) for x in v] if fine(v) else None for _, v, _, _ in rows]
    assert any(max(map(abs, v)) > 1 << 90 for v in ints if v)
    last = 1 << 62
    for i, (vid, _, _, _) in enumerate(rows):
        if ints[i] is None or vid is None or vid % 20:
            continue
        best = sorted((-sum(a * b for a, b in zip(ints[i], ints[j])), last if rows[j][0] is None else rows[j][0])
                      for j in range(len(rows)) if j != i and ints[j] is not None and len(ints[j]) == len(ints[i]))[:20]
        assert sorted(got[vid]) == [(k + 1, None if v == last else v, in_64_bits(-s)) for k, (s, v) in enumerate(best)], vid
    assert m_tree.top_k(frame.limit(0)).count() == 0


def test_top_k_of_long_vectors(spark, monkeypatch):
    # components over 2^20, whose scores need more than 53 bits, beside short ones
    monkeypatch.setattr(m_tree, "PAGE", 32)
    rnd = np.random.default_rng(12)
    size = np.where(np.arange(200) % 4 == 0, 9e6, np.where(np.arange(200) % 4 == 1, 1.5e6, 1.0))
    rows = [(i, [float(x) for x in (rnd.normal(size=4).clip(-1.7, 1.7) * s).astype(np.float32)]) for i, s in enumerate(size)]
    rows += [(200 + i, [x + 4.0 * (k == i) for k, x in enumerate(rows[0][1])]) for i in range(4)]     # next to each other far out
    ints = [[math.floor(64 * float(np.float32(x))) for x in v] for _, v in rows]
    got = collections.defaultdict(list)
    for r in m_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), k=5, every=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i in range(0, len(rows), 5):
        best = sorted((-sum(a * b for a, b in zip(ints[i], ints[j])), j) for j in range(len(rows)) if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)], i


def test_page_search_skips_by_stored_distances():
    rnd = np.random.default_rng(9)
    p = np.concatenate([rnd.normal(size=(200, 5)) + c for c in (0, 20, 40)])
    q = np.ones((1, 5))
    m = float((p * p).sum(1).max())
    lifted = np.column_stack([p, np.sqrt(m - (p * p).sum(1))])
    page = m_tree.Page(lifted)
    seen = []

    def scores(members, queries):
        seen.extend(members.tolist())
        return q[queries] @ p[members].T
    none = np.float64(-2 ** 62)
    a, b, s, best = page.search(np.column_stack([q, [0.0]]), scores, 5, m, np.full(1, none), none)
    assert len(seen) < 600
    assert sorted(best[0].tolist()) == sorted((p @ np.ones(5)).tolist())[-5:]
    assert (np.sqrt(((lifted - page.centre) ** 2).sum(1)) <= page.radius + 1e-9).all()


def test_deal_is_even(spark, monkeypatch):
    rows = [(i, "g" if i % 3 else "h", np.array([i % 7, i % 5], float).tobytes()) for i in range(900)]
    frame = spark.createDataFrame(rows, "row long, grp string, p binary")
    sizes = [r["count"] for r in cells.deal(frame, Scratch(spark, "deal"), 50).groupBy("cell").count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 150
