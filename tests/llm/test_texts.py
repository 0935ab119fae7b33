"""Classifiers, language model, tokens, pieces, URL rules, archives and the pipeline."""

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tidewheel.llm.boosting import fit
from tidewheel.llm.lm import UNIGRAM, Draws, alone_table, leaving, score_documents, seat
from tidewheel.llm.pieces import CharacterMap, Codec, encode_decode
from tidewheel.llm.quality import classify_quality
from tidewheel.llm.tokens import allocate, load_ranks, token_counts
from tidewheel.llm.shared import stash
from tidewheel.llm.toxicity import classify_toxicity, label_model, train
from tidewheel.llm.url_rules import Rule, filter_urls, host_and_path, tokens
from tidewheel.llm.warc import read_archives, write_archives

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "plain words, é 你好 \x00 ▁ end"), (4, "plain words, é 你好 \x00 ▁ end"), (5, "word " * 40_000), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "y") for i, t in rows], "doc_id bigint, text string, score double, held_out string")


@pytest.mark.parametrize("classify, label", [(classify_quality, "quality"), (classify_toxicity, "toxic")])
def test_classifiers(spark, classify, label):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5)) == {0}
    hit = ((held.predicted == 1) & (held[label] == 1)).sum()
    rare = 1 - int(held[label].mean() > 0.5)  # a constant has none of the rarer class
    found = ((held.predicted == rare) & (held[label] == rare)).sum()
    assert hit / held.predicted.sum() > 0.9 and found / (held[label] == rare).sum() > {"quality": 0.9, "toxic": 0.6}[label]
    odd = classify(frame(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and {r.score for r in odd} == {0.5}
    assert classify(docs.limit(0), labels).count() == 0


def test_the_lexicon_holds_every_entry_past_the_threshold(spark):
    rng = np.random.default_rng(4)
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    rows = [(k, " ".join(word(j) for j in rng.choice(400, 70, replace=False) + 400 * (k % 2))) for k in range(1000)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id bigint, toxic int")
    assert len(train(frame(spark, rows), labels).lexicon.words) == 800


def test_toxicity_of_held_out_documents(spark):
    """On a larger sample: nine tenths of what is marked toxic, and nine tenths of what is found is."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = classify_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit >= 0.9 * held.toxic.sum() and hit >= 0.9 * held.predicted.sum()


def test_copies_of_a_toxic_text_make_none_of_its_words_toxic(spark):
    """40 near copies of one toxic text against 60 toxic texts with a word of their own kind; clean texts hold the copies' words."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + k) for k in rng.integers(26, size=4))
    common, odd = [word() for _ in range(300)], [word() for _ in range(40)]
    text = lambda *more: " ".join(rng.permutation([*rng.choice(common, 40), *more]))
    base = text(*odd).split()
    rows = [(k, " ".join([*base[:-1], word()]), 1) for k in range(40)] + [(100 + k, text("fool", "fool", "idler"), 1) for k in range(60)] + [(200 + k, text(*rng.choice(odd, 2)), 0) for k in range(300)]
    docs, labels = frame(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in classify_toxicity(docs, labels).collect()}
    assert sum(got[i] for i, _, y in rows if not y) <= 3 and sum(got[100 + k] for k in range(60)) >= 57


def test_the_label_model_learns_from_votes_without_labels():
    """Voters of unknown accuracy, two of them copies of each other; 30 of 3,000 rows have labels."""
    rng = np.random.default_rng(6)
    y = rng.random(3000) < 0.3
    fire = [(0.6, 0.1), (0.5, 0.05), (0.7, 0.2), (0.4, 0.1), (0.6, 0.15), (0.5, 0.5)]
    votes = np.stack([rng.random(3000) < np.where(y, a, b) for a, b in fire] , axis=1).astype(float)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)
    known = np.where(np.arange(3000) < 30, y, -1)
    q = label_model(votes, known)
    assert ((q > 0.5) == y)[30:].mean() > max(0.85, (votes[30:, 0] == y[30:]).mean())


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(0).normal(size=(2000, 3)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((fit(x, y).score(x) > 0.5) == y).mean() > 0.95


def test_language_model(spark):
    rows = [*ODD, *((k, "the cat sat on the mat again " * (k % 5 + 1)) for k in range(10, 60))]
    got = {(r.doc_id, r.n_tokens): r for r in score_documents(frame(spark, rows), least=3).collect()}
    train = collections.Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(train.values()), len(train)
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b"\n"]
        r = got[i, len(words)]
        assert r.train_tokens == n and r.n_known == sum(w in train for w in words) and r.score < 0
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
    assert got[10, 8].score > got[10, 8].base_score
    assert score_documents(frame(spark, [])).count() == 0
    table = alone_table(0.75)
    assert table[1, 1] == 1 and abs(table[5, 5] - 1) < 1e-9 and table[5, 1] == 0


def test_every_word_is_a_dish_and_a_context(spark):
    """Words of a few training occurrences have statistics of their own; unknown ones share what the dishes leave."""
    rows = [(k, f"rare{k % 25} follows{k % 25}") for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    asked = list(zip(held, ["rare1 follows1", "rare1 follows2", "rare1 unseen"], strict=True))
    got = {r.doc_id: r.score for r in score_documents(frame(spark, rows + asked)).collect()}
    assert got[held[0]] > got[held[1]] + 1 > got[held[2]] + 1


def test_seating_of_frequent_pairs_reaches_the_posterior():
    """Many copies of a restaurant with one dish of 10,000 customers, against the exact law of its number of tables."""
    d, strength, c, copies = 0.5, 1.0, 10_000, 400
    p = np.full(copies, 0.3)
    got = np.mean([s.mean() for s in seat(np.full(copies, c), np.arange(copies), p, copies, Draws(np.arange(copies), 5), d, strength)])
    t = np.arange(1, 400)
    log_s = np.array([log_c(c, int(k)) for k in t])
    rise = np.array([0, *np.cumsum(np.log(strength + d * t))])[: len(t)]
    w = log_s + t * math.log(0.3) + rise
    w = np.exp(w - w.max())
    want = (w * t).sum() / w.sum()
    assert abs(got - want) < 0.1 * want
    assert abs(leaving(np.array([500]), np.array([20]), d, alone_table(d))[0] / np.exp(log_c(499, 19) - log_c(500, 20)) - 1) < 0.05
    assert UNIGRAM[0] == d


def log_c(c, t):
    """Log of the generalised Stirling number of discount 1/2."""
    return math.lgamma(2 * c - t) - math.lgamma(c - t + 1) - math.lgamma(t) - (2 * c - 2 * t) * math.log(2)


def test_token_counts(spark):
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*ODD, (9, "a\n\nb  \n  c\n")]
    got = token_counts(frame(spark, rows), ranks, public_tokenizers.PATTERN).toPandas()
    for i, t in [(9, rows[-1][1]), (1, None), (5, rows[5][1])]:
        assert got[got.doc_id == i].n_tokens.sum() == len(coder.encode_ordinary(t or ""))
    assert got[got.doc_id.isna()].n_tokens.sum() == len(coder.encode_ordinary("no id"))
    text = "one two  three\n\n four five six \n\n\nseven é eight" * 30
    ids = coder.encode_ordinary(text)
    ends = np.cumsum([len(coder.decode_single_token_bytes(k)) for k in ids])
    begins, lines = np.concatenate([[0], ends[:-1]]), [0, *(k + 1 for k, c in enumerate(text.encode()[:-1]) if c == 10)]
    for rule in ("first", "last", "most"):
        want = collections.Counter()
        for a, b in zip(begins, ends, strict=True):
            held = collections.Counter(max(j for j, at in enumerate(lines) if at <= byte) for byte in range(a, b))
            want[{"first": min(held), "last": max(held), "most": min(held, key=lambda j: (-held[j], j))}[rule]] += 1
        got = token_counts(frame(spark, [(1, text)]), ranks, public_tokenizers.PATTERN, rule=rule).collect()
        assert {r.section: r.n_tokens for r in got} == {j: want[j] for j in range(len(lines))}
    assert token_counts(frame(spark, []), ranks, public_tokenizers.PATTERN).count() == 0
    begin, end, cut = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 4])
    assert [allocate(begin, end, cut, 6, rule)[0].tolist() for rule in ("first", "last", "most")] == [[2, 0, 1], [1, 0, 2], [2, 0, 1]]


def test_pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = encode_decode(frame(spark, ODD), path, ["doc_id"]).collect()
    text = {i: t or "" for i, t in ODD}
    for r in got:
        t, data = text[r.doc_id], text[r.doc_id].encode()
        assert r.ids == lib.encode(t) and r.decoded == lib.decode(lib.encode(t))
        assert b"".join(data[a:b] for a, b in zip(r.begins, r.ends, strict=True)) == data
    assert len(got) == len(ODD)
    clash = encode_decode(frame(spark, ODD[:1]).selectExpr("doc_id AS ids", "text"), path, ["ids"])
    assert clash.columns == ["ids_", "ids", "begins", "ends", "decoded"] and clash.first()["ids_"] == 1
    assert encode_decode(frame(spark, []), path, ["doc_id"]).count() == 0


def test_character_map_takes_the_longest_prefix():
    # a double array by hand: root -> 'a' (leaf value 0) -> 'b' (leaf value 2)
    units = np.zeros(512, np.uint32)
    put = lambda at, offset, label, leaf: units.__setitem__(at, (offset ^ at if offset is not None else 0) << 10 | leaf << 8 | label)
    units[0] = 256 << 10
    put(256 ^ 97, 128, 97, 1)
    units[128] = 0x80000000
    put(128 ^ 98, 320, 98, 1)
    units[320] = 0x80000000 | 2
    m = CharacterMap(len(units.tobytes()).to_bytes(4, "little") + units.tobytes() + b"X\0YZ\0")
    assert m.longest(b"abc", 0) == (2, b"YZ") and m.longest(b"ac", 0) == (1, b"X") and m.longest(b"c", 0) is None
    codec = Codec.__new__(Codec)
    codec.map, codec.suffix = m, False
    codec.spec = type("Spec", (), {"remove_extra_whitespaces": True, "escape_whitespaces": False, "add_dummy_prefix": False})
    norm, source = codec.normalised(b"  ab  ac ")
    assert norm == b"YZ Xc" and source.tolist() == [2, 2, 4, 6, 7, 9]


def test_url_rules(spark):
    rules = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("allow", "org", "/fr/")]
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, "https://net/"), (3, "http://fnet/"), (4, None), (5, "no scheme"), (6, "http://x.org/fr/1#z"), (7, "http://x.net"), (1, "http://A.Example.NET/en/x?y")]
    got = [tuple(r) for r in filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules).orderBy("page_id").collect()]
    assert got[0][:4] == got[1][:4] == (1, "a.example.net", "/en/x", "example.net/en/")
    assert [(r[0], r[3]) for r in got[2:]] == [(2, "net/"), (3, None), (4, None), (5, None), (6, "org/fr/"), (7, None)]
    assert got[4][1:3] == ("", "") and all(r[4] in ("allow", "block") for r in got)
    assert filter_urls(spark.createDataFrame([], "page_id bigint, url string"), rules).count() == 0


def test_a_hot_template_leaves_room_for_other_rules(spark):
    """All 8,191 token sets of a hot url are rules of confidence 1; the mined block rule of a rarer folder still counts."""
    rules = [Rule("block", "net", "/"), Rule("allow", "org", "/fr/")]
    rows = [(k, "http://a.example.org/fr/x.html?" + "&".join(f"k{j}={k}" for j in range(7))) for k in range(100)]
    rows += [(1000 + k, f"ftp://b.net/de/{k}") for k in range(50)] + [(2000, "gopher://c.com/de/y")]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    assert (got[2000].rule, got[2000].verdict) == (None, "block")


@pytest.mark.parametrize("n", [7, 9, 200])
def test_mined_verdicts_match_counted_itemsets(spark, n):
    """Every itemset counted by hand: rules of one verdict with support and confidence, simpler ones at least as sure first."""
    rng = np.random.default_rng(n)
    pick = lambda *c: c[rng.integers(len(c))]
    rules = [Rule("block", "net", "/"), Rule("allow", "org", "/")]
    rows = [(k, f"http://{pick('a', 'b', 'c')}.{pick('net', 'org')}/{pick('x', 'y')}/{k}.{pick('html', 'php')}") for k in range(n)]
    rows += [(1000 + k, f"{pick('http', 'ftp')}://{pick('a', 'b', 'c', 'd')}.com/{pick('x', 'y', 'z')}/{k}.{pick('html', 'php', 'gif')}") for k in range(60)] + [(5000, None), (5001, "http://a.com/" + "x/" * 20_000)]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id bigint, url string, host string, tokens int")
    got = {r.page_id: r for r in filter_urls(df, rules, support=0.05).collect()}
    held = df.selectExpr("page_id AS id__", "url AS url__")
    host, path = host_and_path(F.col("url__"))
    held = {r.id__: r.t for r in held.withColumns({"host": host, "path": path}).select("id__", tokens().alias("t")).collect()}
    marked = [(frozenset(held[i]), "block" if got[i].rule == "net/" else "allow") for i, _ in rows[:n]]
    both, alone = collections.Counter(), collections.Counter()
    for t, v in marked:
        for k in range(1, len(t) + 1):
            for s in itertools.combinations(sorted(t), k):
                alone[s] += 1
                both[s, v] += 1
    mined = {(s, v): (c / alone[s], c / n) for (s, v), c in both.items() if c >= math.ceil(0.05 * n) and c / alone[s] >= 0.6}
    best = [(-c, -sup, -len(s), s, v) for (s, v), (c, sup) in mined.items() if not any(set(s2) < set(s) and v2 == v and c2 >= c for (s2, v2), (c2, _) in mined.items())]
    for i, _ in rows[n:]:
        fits = sorted(r for r in best if set(r[3]) <= set(held[i] or []))
        assert got[i].verdict == (fits[0][4] if fits else "allow"), (i, fits[:2])


def test_archives_of_rows_without_ids(spark, tmp_path):
    """Each row has a record; null ids come before all others and refer to a response that may have none itself."""
    rows = [(None, "u", "same"), (None, "u", "same"), (None, "v", "other"), (4, "u", "same"), (None, None, "x" * 300_000), (9, None, None)]
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id bigint, url string, html string, kind int, hex string")
    got = read_archives(write_archives(df, folder), folder).collect()
    kinds = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert kinds == collections.Counter({(None, 4, "revisit", 4): 2, (4, 4, "response", None): 1, (None, 5, "response", None): 1, (None, 300_000, "response", None): 1, (9, 0, "response", None): 1})
    none = write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert read_archives(none, f"file://{tmp_path}/e").count() == 0


def test_archives(spark, tmp_path):
    rows = [(3, "http://a/\r\nb", "same"), (1, None, "same"), (3, "http://a/", "same"), (2, "http://c/", None), (5, "http://d/", "é" * 5000), (6, "u", "")]
    folder = f"file://{tmp_path}/w"
    manifest = write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), folder, roll_bytes=600)
    got = read_archives(manifest, folder).toPandas()
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert sorted(got.payload_digest) == sorted(digest(h) for *_, h in rows)
    kinds = collections.Counter((r.page_id, r.record_type, -1 if math.isnan(r.refers_to) else int(r.refers_to)) for r in got.itertuples())
    assert kinds == collections.Counter({(3, "response", -1): 1, (3, "revisit", 3): 1, (1, "revisit", 3): 1, (2, "revisit", 6): 1, (6, "response", -1): 1, (5, "response", -1): 1})
    assert got[got.page_id == 5].payload.iloc[0].decode() == "é" * 5000
    assert manifest.count() > 1 and not list((tmp_path / "w" / "_staged").iterdir())


def _words(text, letters):
    data = (text or "").encode().lower() if letters else (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    return data.split() if not letters else [w for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", data) if w]


def test_pipeline(spark):
    """Each stage on its own input: both classifiers against their operators' verdicts, the others against brute force."""
    cp = pytest.importorskip("corpus_pipeline")
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    for stage, verdict, stays in ((cp.quality, classify_quality, 1), (cp.toxicity, classify_toxicity, 0)):
        want = {r.doc_id for r in verdict(docs, labels).collect() if r.predicted == stays}
        kept = stash(stage(spark, docs, FOLDER), "kept")
        assert kept.columns == columns and rows(kept) == {x for x in rows(docs) if x[0] in want}
        docs = kept
    before = sorted(rows(docs))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := _words(t, False)) else frozenset() for _, t in before]
    holders, root = collections.defaultdict(list), list(range(len(before)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for k, s in enumerate(sets):
        for j, i in collections.Counter(j for g in s for j in holders[g] if j < k).items():
            if 100 * i >= 80 * (len(s) + len(sets[j]) - i):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    docs = stash(cp.near_duplicates(spark, docs, FOLDER), "kept")
    assert docs.columns == columns and rows(docs) == {before[k] for k in range(len(before)) if find(k) == k}
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = _words(r.text, True)
        windows |= {tuple(w[k : k + min(13, len(w))]) for k in range(len(w) - min(13, len(w)) + 1)} if w else set()
    lens = {len(g) for g in windows}
    clean = lambda w: not any(tuple(w[k : k + n]) in windows for n in lens for k in range(len(w) - n + 1))
    want = {x for x in rows(docs) if clean(_words(x[1], True))}
    docs = stash(cp.decontamination(spark, docs, FOLDER), "kept")
    assert docs.columns == columns and rows(docs) == want
    got = {r.doc_id: r for r in cp.pieces(spark, docs, FOLDER).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(got) == {i for i, _ in want}
    for i, t in want:
        ids = lib.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
