"""N-gram join, decontamination and top-k against brute force, with nulls, empty and long texts, ties and repeats."""

import collections
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.llm.decontaminate import contamination, drop_contaminated, remove_spans
from tidewheel.llm.graph import components
from tidewheel.llm.ngram_join import keep_one_of_each, ngram_jaccard_join
from tidewheel.llm.topk import Block, exact_top_k

DOCS = "doc_id bigint, text string, score__ int, fp string, n_words int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS)


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    least = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "w%d" % rng.integers(3000)
    line = [word() for _ in range(25)]
    base = [word() for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  TWO"), (5, "one two three four five"), (6, " ".join(word() for _ in range(30_000)))]
    for k in range(60):  # near copies of one text, more than a small group holds, and a chain that drifts away
        w = list(base)
        w[rng.integers(120)] = word()
        rows.append((100 + k, " ".join(w)))
    for k in range(30):
        base[(4 * k) % 120] = word()
        rows.append((300 + k, " ".join(base)))
    rows += [(500 + k, " ".join([*line, *(word() for _ in range(20))])) for k in range(40)]  # a shared passage alone links nothing
    rows += [(600, rows[6][1]), (601, rows[6][1] + " more")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs(spark, rows)).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in keep_one_of_each(docs(spark, rows + rows[3:4])).collect()}
    assert kept == {c for _, c in got.values()}


def near_copies(n, words, changes, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.integers(words, size=rng.integers(1, changes + 1)):
            w[at] = f"x{rng.integers(10**6)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_a_large_group_that_links_in_part(spark, monkeypatch, hot):
    """500 near copies of which some link to many, some to few and some to none; with n-grams dealt as hot ones, too."""
    if hot:
        monkeypatch.setattr("tidewheel.llm.ngram_join.HOT_LEAST", 2)
    rows = near_copies(500, 130, 4, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs(spark, rows)).collect()}
    want = brute(rows)
    assert 1 < len({c for _, c in want.values()}) < 400
    assert got == want


def test_one_id_with_two_texts_and_clashing_names(spark):
    """Different texts under one id are different documents; of rows that repeat both one stays; null ids all stay."""
    schema = "doc_id bigint, text string, id__ int, hash__ string, bad_id__ int, comp int"
    a, b = "a b c d e f g", "q r s t u v w"
    rows = [(1, a, 1, "x", 1, 1), (1, b, 2, "x", 1, 1), (1, b, 2, "x", 1, 1), (2, a, 3, "x", 1, 1), (None, b, 4, "x", 1, 1), (None, None, 5, "x", 1, 1), (3, "", 6, "x", 1, 1), (4, None, 7, "x", 1, 1)]
    left = keep_one_of_each(spark.createDataFrame(rows, schema))
    assert left.columns == ["doc_id", "text", "id__", "hash__", "bad_id__", "comp"]
    assert sorted(r.id__ for r in left.collect()) == [1, 2, 4, 5, 6, 7]
    items = spark.createDataFrame([(1, a)], "item_id bigint, text string")
    assert sorted(r.id__ for r in drop_contaminated(spark.createDataFrame(rows, schema), items).collect()) == [2, 2, 4, 5, 6, 7]
    cut = remove_spans(spark.createDataFrame(rows, schema), items)
    assert cut.columns == left.columns and {r.text for r in cut.where("id__ in (1, 3)").collect()} == {""}


def test_links_are_counted_in_groups_of_near_copies(spark, monkeypatch):
    """60 near copies of one text, some that link and some only through others, exact copies and repeated rows."""
    monkeypatch.setattr("tidewheel.llm.ngram_join.DEALT", 16)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(160)]
    rows = [(0, None), (1, "alone one two"), (2, "two three"), (3, "Two  THREE")]
    for k in range(60):
        w = list(base)
        for at in rng.integers(160, size=1 + k % 2):
            w[at] = f"x{rng.integers(10**6)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, rows[10][1]) for k in range(3)]
    sets = {i: shingles(t) for i, t in rows}
    want = {i: sum(i != j and len(a & b) > 0 and 100 * len(a & b) >= 80 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    assert len(set(want.values())) > 5
    got = ngram_jaccard_join(docs(spark, rows + rows[-1:]), links=True).collect()
    assert len(got) == len(rows) + 1 and {r.doc_id: r.n_links for r in got} == want
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_join_of_nothing(spark):
    assert ngram_jaccard_join(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.comp for r in components(e).collect()} == {1}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_windows_are_verified_word_by_word(spark, monkeypatch, most):
    """Broadcast and shuffled look-ups give what a scan of all windows gives, for items of every length and long texts."""
    monkeypatch.setattr("tidewheel.llm.decontaminate.BROADCAST_WINDOWS", most)
    rng = np.random.default_rng(2)
    word = lambda: "v%d" % rng.integers(6)
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 8, 12, 13, 14, 40])]
    rows = [(100 + k, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for k in range(40)] + [(200, " ".join(["pad"] * 20_000 + items[7][1].split())), (201, "pad " * 30 + items[6][1].upper())]
    windows = {}
    for i, t in items:
        w = t.split()
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lens = {len(g) for g in windows}
    want = {}
    for i, t in rows:
        w, at, ids = t.lower().split(), set(), set()
        for n in lens:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    at |= set(range(k + 1, k + n + 1))
                    ids |= found
        want[i] = (sorted(at), sorted(ids))
    got = {r.doc_id: (list(r["at"]), list(r.item_ids)) for r in contamination(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == want and want[201][0]


def test_decontamination_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert contamination(docs(spark, []), items).count() == 0


def test_decontamination(spark):
    item = " ".join(f"b{k}" for k in range(15))
    items = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, "Short, item!", 1), (9, "...", 1), (10, None, 1)], "item_id bigint, text string, n_words int")
    rows = [(1, "a " + item.upper() + "; tail"), (2, "x short item"), (3, None), (4, ""), (5, "short x item"), (1, "a " + item.upper() + "; tail"), (6, " ".join(["pad"] * 500) + " short item")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in contamination(docs(spark, rows), items).collect())
    assert got == collections.Counter({(1, 17, 15, ("7",), True): 2, (2, 3, 2, ("8",), True): 1, (3, 0, 0, (), False): 1, (4, 0, 0, (), False): 1, (5, 3, 0, (), False): 1, (6, 502, 2, ("8",), False): 1})
    left = drop_contaminated(docs(spark, rows), items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6] and left.columns == DOCS.replace("string", "bigint").replace(" bigint", "").replace(" int", "").split(", ")
    cut = {r.doc_id: r.text for r in remove_spans(docs(spark, rows), items).collect()}
    assert cut[1] == "a; tail" and cut[2] == "x" and cut[3] is None
    assert contamination(docs(spark, rows), items.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_top_k(spark, k):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[10:20] = x[10]  # ties
    x[30] = 0
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)] + [(1001, None, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [1.0, 2.0], 0), (1005, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = exact_top_k(df, F.col("vec_id") % 50 == 0, k=k).toPandas()
    e = np.floor(256.0 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 300, 50):
        s = e @ e[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:k]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(order)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == sorted(want)
    assert isinstance(got, pd.DataFrame)


@pytest.mark.parametrize("most", [16 << 20, 64])
def test_large_components_and_repeated_rows(spark, monkeypatch, most):
    """Components past 2^26, whose products need more than 53 bits, on both sides of the broadcast bound; scores past 64 bits
    are the nearest ones; empty vectors meet each other."""
    monkeypatch.setattr("tidewheel.llm.topk.BROADCAST_BYTES", most)
    rng = np.random.default_rng(3)
    x = [[float(v) for v in rng.normal(size=4)] for _ in range(60)]
    x[0], x[7], x[8], x[50] = [1e7, -3.25, 1e6, 0.0], [2e7, 1.0, -1e6, 5.0], [1e30, 0.0, 0.0, 0.0], [1e30, 1.0, 0.0, 0.0]
    rows = [(i, v) for i, v in enumerate(x)] + [(5, x[5]), (100, []), (101, [])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, k=3).collect()
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    want = []
    for q in (0, 50, 100):
        v = dict(whole)[q]
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole if i != q and len(w) == len(v))[:3]
        want += [(q, r + 1, i, -m) for r, (m, i) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_the_index_prunes_clusters():
    """On clustered vectors the bounds leave under a tenth of the rows to rescore; on uniform ones the answer is as exact."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 64))
    for x, most in ((centre[rng.integers(20, size=4000)] + 0.3 * rng.normal(size=(4000, 64)), 0.1), (rng.uniform(-1, 1, size=(4000, 64)), 1.0)):
        e = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True) * 4)
        ids = np.arange(len(e))
        block = Block(ids, e)
        got = block.search(e[:40], 5, ids[:40])
        s = e[:40] @ e.T
        s[np.arange(40), np.arange(40)] = -np.inf
        for j, (found, score) in enumerate(got):
            order = np.lexsort((ids, -s[j]))[:5]
            assert found.tolist() == order.tolist() and score.tolist() == s[j][order].tolist()
        assert block.rescored <= most * 40 * len(e)


def test_top_k_of_nothing(spark):
    assert exact_top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
