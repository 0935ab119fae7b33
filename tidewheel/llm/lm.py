"""Hierarchical Pitman-Yor language model of words, and its scores.

Every word of the training documents and the end of text are dishes of their own; words that only held-out texts hold
share the dish RARE. (With `least` above 1, so do words of fewer training occurrences; a Pitman-Yor distribution over
words holds within it.) Every context (the word before) is a restaurant; all share the unigram restaurant as parent, whose base is uniform. A restaurant's seating is sampled by
Gibbs: a customer leaves its table and sits again, in proportion to tables of its dish or to the parent's probability.
A sweep moves every customer. The unigram restaurant's customers are the contexts' tables; each word bucket seats its
own dishes of it and takes the other buckets' tables as its own times their share of the dishes.
Predictive probabilities are averaged over the samples.

Distribution: a task turns up to BATCH_TOKENS tokens into places in its own list of distinct words. Lists go to word
buckets, which count and answer; distinct pairs go to shards by context, which seat and answer. So what is shuffled is
pre-aggregated, hot words or pairs are one entry a batch, and no table of the vocabulary is ever gathered in one place.
The tokens themselves are never shuffled: they are written once to the shared folder, one file a task, and the tasks that
need them again read that file there, while only answers come to them by shuffle.

Draws are hashes of context, dish and number of the draw, so a pair's seating doesn't hang on which pairs share its task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import mix, stash, to_bytes, word_hashes

BATCH_TOKENS = 1_200_000
END, RARE, BEGIN = (np.uint64(k) for k in (1, 2, 3))
#: Counts up to which the chance that a customer sits alone is exact (ratios of generalised Stirling numbers).
EXACT = 64
#: Discount and strength of context restaurants and of the unigram restaurant (fixed parameters of the model).
CONTEXT, UNIGRAM = (0.75, 1.0), (0.5, 1.0)
BURN_IN, SAMPLES = 3, 3

_BLOB = "batch long, bucket int, kind int, a binary, b binary, c binary, d binary, v long, n long, r long, k long, n1 long, n2 long"
_NAMES = [x.split(" ")[0] for x in _BLOB.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 6]
STREAM, WORDS, COUNTS, PAIRS, SEATED, TABLES, SHARES, TOTAL, FILE = range(9)


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _squeezed(x: np.ndarray) -> bytes:
    """32-bit integers by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _rising(x: np.ndarray) -> bytes:
    """64-bit numbers in rising order, as differences by byte plane, compressed."""
    planes = np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _risen(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _short_floats(x: np.ndarray) -> bytes:
    """Floats to 16 significant bits, by byte plane, compressed."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return _squeezed((bits + np.uint32(128)) & np.uint32(0xFFFFFF00))


def _starts(u: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))


def _rows(t: pa.Table) -> list[dict]:
    return sorted(t.to_pylist(), key=lambda r: (r["kind"], r["batch"], r["bucket"]))


def _frugal(f):
    """f of a group, after which the worker gives memory that Arrow holds in reserve back to the machine."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        pa.default_memory_pool().release_unused()
        return out

    return run


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Ends of the runs of each bucket in sorted 64-bit keys; the bucket is their upper bits."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _scan(folds: int, held: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]):
        part, k = TaskContext.get().partitionId(), 0
        ids, held_out, hashes, size = [], [], [], 0

        def flush():
            nonlocal k, ids, held_out, hashes, size
            batch, k = (part << 24) + k, k + 1
            lens = np.array([len(h) for h in hashes], np.int64)
            vocab, at = np.unique(np.concatenate(hashes), return_inverse=True)
            state = np.array(held_out, np.uint8)
            count = np.bincount(at, np.repeat((state & 1) == 0, lens), len(vocab)).astype(np.uint32)
            order = np.argsort(-np.bincount(at, minlength=len(vocab)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(vocab), np.int64)
            rank[order] = np.arange(len(vocab))
            out = [{"batch": batch, "bucket": -1, "kind": STREAM, "a": _blob(np.array(ids, np.int64)), "b": _blob(lens), "c": _blob(state), "d": _squeezed(np.concatenate([order, rank[at]]))}]
            edge = _cuts(vocab, bits)
            out += [{"batch": batch, "bucket": j, "kind": WORDS, "a": _rising(vocab[a:b]), "b": _squeezed(count[a:b])} for j, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
            ids, held_out, hashes, size = [], [], [], 0
            return _table(out).to_batches()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = word_hashes(to_bytes(text.as_py()))
                ids.append(doc_id or 0)
                held_out.append((doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == held) + 2 * (doc_id is None))
                hashes.append(np.append(np.where(h < 4, h + np.uint64(4), h), END))
                size += len(h) + 1
                if size >= BATCH_TOKENS:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _count(least: int):
    """Of one word bucket: totals by word, sent back to every batch in its own order, and the bucket's sums."""

    def run(t: pa.Table) -> pa.Table:
        rows = _rows(t)
        lists = [_risen(r["a"]) for r in rows]
        word, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, np.concatenate([_spread(r["b"]) for r in rows]), len(word)).astype(np.int64)
        out, start = [], 0
        for r, n in zip(rows, map(len, lists), strict=True):
            out.append({"batch": r["batch"], "bucket": r["bucket"], "kind": COUNTS, "a": _squeezed(np.minimum(total[at[start : start + n]], 2**32 - 1))})
            start += n
        known = total > 0
        rare = known & (total < least) & (word != END)
        out.append({"batch": -1, "bucket": rows[0]["bucket"], "kind": TOTAL, "v": int(known.sum()), "n": int(total.sum()), "r": int(total[rare].sum()), "k": int(rare.sum()), "n1": int((total == 1).sum()), "n2": int((total == 2).sum())})
        return _table(out)

    return run


class Batch:
    """A batch with its words' counts, and its distinct pairs in shard order."""

    def __init__(self, rows: list[dict], least: int, bits: int, vocab: np.ndarray):
        s = next(r for r in rows if r["kind"] == STREAM)
        self.ids, self.lens, self.state = np.frombuffer(s["a"], np.int64), np.frombuffer(s["b"], np.int64), np.frombuffer(s["c"], np.uint8)
        coded = _spread(s["d"])
        self.at = coded[: len(vocab)].astype(np.int32)[coded[len(vocab) :]]
        self.count = np.concatenate([_spread(r["a"]) for r in rows if r["kind"] == COUNTS]).astype(np.int64)
        self.vocab = vocab
        self.own = (self.count >= least) | (vocab == END)
        dish = np.where(self.own, np.cumsum(self.own) - 1, self.own.sum())
        self.dishes = np.concatenate([vocab[self.own], [RARE, BEGIN]])  # the last two: rare words, begin of text
        now = dish[self.at]
        first = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        before = np.concatenate([[0], now[:-1]])
        before[first] = len(self.dishes) - 1
        key, self.pair = np.unique(before.astype(np.int64) * len(self.dishes) + now, return_inverse=True)
        train = np.repeat((self.state & 1) == 0, self.lens)
        c = np.bincount(self.pair, train, len(key)).astype(np.uint32)
        u, w = key // len(self.dishes), key % len(self.dishes)
        shard = mix(self.dishes[u])
        order = np.lexsort((w, shard))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))  # of each pair in shard order
        self.u, self.w, self.c, self.dish = self.dishes[u][order], self.dishes[w][order], c[order], w[order]
        self.edge = _cuts(shard[order], bits)
        self.first = first


def _batches_of(t: pa.Table) -> Iterator[list[dict]]:
    """The rows of each batch of one scanning task: those in its file and the answers that came here."""
    rows = t.to_pylist()
    fs, path = pa_fs.FileSystem.from_uri(next(r["a"] for r in rows if r["kind"] == FILE).decode())
    by: dict[int, list[dict]] = {}
    for r in [*pq.read_table(path, filesystem=fs).to_pylist(), *(r for r in rows if r["kind"] != FILE)]:
        by.setdefault(r["batch"], []).append(r)
    for batch in sorted(by):
        yield sorted(by[batch], key=lambda r: (r["kind"], r["bucket"]))


def _vocab(rows: list[dict]) -> np.ndarray:
    return np.concatenate([_risen(r["a"]) for r in rows if r["kind"] == WORDS])


def _pairs(least: int, bits: int, n: int, r: int):
    """Of one scanning task: the distinct pairs of its batches, for the shards of their contexts."""

    def run(t: pa.Table) -> pa.Table:
        out = []
        for rows in _batches_of(t):
            b = Batch(rows, least, bits, _vocab(rows))
            share = np.concatenate([b.count[b.own], [r, 0]]) / max(n, 1)
            p = np.log2(np.maximum(share[b.dish], 1e-12)).astype(np.float16)
            for j, (x, y) in enumerate(zip(b.edge[:-1], b.edge[1:], strict=True)):
                if y > x:  # each context once, with the number of its pairs; each dish once, with its place in the pairs
                    first = _starts(b.u[x:y])
                    runs = np.diff(first, append=y - x)
                    dish, one, at = np.unique(b.w[x:y], return_index=True, return_inverse=True)
                    out.append({"batch": rows[0]["batch"], "bucket": j, "kind": PAIRS, "a": _blob(b.u[x:y][first]), "b": _rising(dish), "c": _squeezed(np.concatenate([runs, b.c[x:y], at])), "d": _squeezed(p[x:y][one].view(np.uint16))})
        return _table(out)

    return run


def alone_table(d: float) -> np.ndarray:
    """[c, t]: chance that a customer of c at t tables sits alone: S(c - 1, t - 1) / S(c, t) in generalised Stirling numbers."""
    log_s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    log_s[0, 0] = 0
    out = np.zeros((EXACT + 1, EXACT + 1))
    for c in range(1, EXACT + 1):
        t = np.arange(1, c + 1)
        stay = np.where(c - 1 - t * d > 0, np.log(np.maximum(c - 1 - t * d, 1e-300)), -np.inf) + log_s[c - 1, 1 : c + 1]
        log_s[c, 1 : c + 1] = np.logaddexp(log_s[c - 1, :c], stay)
        out[c, 1 : c + 1] = np.exp(log_s[c - 1, :c] - log_s[c, 1 : c + 1])
    return out


def leaving(c: np.ndarray, t: np.ndarray, d: float, alone: np.ndarray) -> np.ndarray:
    """Chance that a customer of c at t tables sits alone; beyond EXACT from the last exact row, as c * chance / (d (t - 1))
    tends to a function of t / c^d alone."""
    small, last = c <= EXACT, np.arange(2, EXACT + 1)
    ratio = alone[EXACT, 2:] * (EXACT - 1) / (d * (last - 1))
    far = d * (t - 1) / np.maximum(c - 1, 1) * np.interp(t * (EXACT / c) ** d, last, ratio)
    return np.where(small, alone[np.minimum(c, EXACT), np.minimum(t, EXACT)], np.minimum(far, 1.0)) * (t > 1)


class Draws:
    """Uniform numbers in [0, 1) of entries: each is a hash of the entry's key and of the number of the draw."""

    def __init__(self, keys: np.ndarray, seed: int):
        self.keys, self.n = mix(keys.astype(np.uint64) + np.uint64(seed)), 0

    def __call__(self, e: np.ndarray) -> np.ndarray:
        self.n += 1
        step = np.uint64(self.n * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix(self.keys[e] + step) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seat(c: np.ndarray, u: np.ndarray, p: np.ndarray, n_u: int, draw: Draws, d: float = CONTEXT[0], strength: float | np.ndarray = CONTEXT[1]) -> Iterator[np.ndarray]:
    """SAMPLES draws of the number of tables of each (context, dish) with c customers; p: the parent's probabilities.

    Each sweep re-seats c customers of every entry, all entries side by side. Most moves change no number of tables, so
    how many pass before the next change is drawn at once: a sweep takes as many rounds as changes, not as customers."""
    alone, c = alone_table(d), c.astype(np.int64)
    types = np.bincount(u, minlength=n_u)
    likely = np.minimum(p * (strength + d * types[u]) * (1 - c ** -d) / d, 1e6)
    t = 1 + np.minimum(np.floor(likely + draw(np.arange(len(c)))).astype(np.int64), c - 1)
    total = np.bincount(u, t, n_u)
    for sweep in range(BURN_IN + SAMPLES):
        e = np.flatnonzero(c > 1)
        moves = c[e].astype(np.float64)
        while len(e):
            ce, te, ue = c[e], t[e], u[e]
            chance = leaving(ce, te, d, alone)
            sits = lambda left: (new := (strength + d * np.maximum(total[ue] - left, 1)) * p[e]) / (new + np.maximum(ce - 1 - d * (te - left), 1e-9))  # noqa: B023, E731
            up, down = (1 - chance) * sits(0) * (te < ce), chance * (1 - sits(1))
            change = np.clip(up + down, 1e-300, 1.0)
            with np.errstate(divide="ignore", over="ignore"):
                wait = np.where(change < 1, 1 + np.floor(np.log1p(-draw(e)) / np.log1p(-np.minimum(change, 1 - 1e-16))), 1.0)
            moved = wait <= moves
            step = np.where(draw(e) * (up + down) < up, 1, -1)[moved]
            t[e[moved]] += step
            total += np.bincount(ue[moved], step, n_u)
            e, moves = e[moved], (moves - wait)[moved]
            e, moves = e[moves > 0], moves[moves > 0]
        if sweep >= BURN_IN:
            yield t.copy()


def _seat_shard(bits: int, seed: int):
    """Of one shard of contexts: each pair's own part and its context's share for the parent, sent back; tables by dish."""

    def run(t: pa.Table) -> pa.Table:
        d, strength = CONTEXT
        rows = _rows(t)
        runs, u, w, c, p = [], [], [], [], []
        for r in rows:
            x = np.frombuffer(r["a"], np.uint64)
            coded = _spread(r["c"])
            n = (len(coded) - len(x)) // 2
            k = coded[len(x) + n :]
            runs.append(coded[: len(x)])
            u.append(np.repeat(x, runs[-1]))
            w.append(_risen(r["b"])[k])
            c.append(coded[len(x) : len(x) + n])
            p.append(_spread(r["d"]).astype(np.uint16).view(np.float16)[k])
        u, w, c, p = map(np.concatenate, (u, w, c, p))
        key, first, at = np.unique(mix(u) + w * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
        total = np.bincount(at, c, len(key)).astype(np.int64)
        context, cu = np.unique(u[first], return_inverse=True)
        w, p = w[first], p[first]
        del u, c
        n_u = np.bincount(cu, total, len(context))
        own, share = np.zeros(len(key)), np.zeros(len(context))
        some = np.flatnonzero(total)
        tables = np.zeros(len(key))
        for sample in seat(total[some], cu[some], np.exp2(p[some].astype(np.float64)), len(context), Draws(key[some], seed)):
            own[some] += np.maximum(total[some] - d * sample, 0) / (strength + n_u[cu[some]]) / SAMPLES
            share += (strength + d * np.bincount(cu[some], sample, len(context))) / (strength + n_u) / SAMPLES
            tables[some] += sample / SAMPLES
        share[n_u == 0] = 1
        own, share = own.astype(np.float32), share.astype(np.float32)
        out, start = [], 0
        for r, run in zip(rows, runs, strict=True):
            n = int(run.sum())
            k = at[start : start + n]
            lead = np.cumsum(run, dtype=np.int64) - run
            out.append({"batch": r["batch"], "bucket": r["bucket"], "kind": SEATED, "a": _short_floats(own[k]), "b": _blob(share[cu[k[lead]]])})
            start += n
        dish, back = np.unique(w, return_inverse=True)
        sums = np.bincount(back, tables, len(dish))
        edge = _cuts(dish, bits)
        out += [{"batch": rows[0]["bucket"], "bucket": j, "kind": TABLES, "a": _rising(dish[a:b]), "b": _blob(sums[a:b])} for j, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        return _table(out)

    return run


def _share_tables(dishes: int, seed: int):
    """Of one word bucket: the customers of its dishes in the unigram restaurant over all contexts, less the discount of
    their tables there, sent back to the batches; and their sums. `dishes` are those of all buckets."""

    def run(t: pa.Table) -> pa.Table:
        d, strength = UNIGRAM
        rows = _rows(t)
        got = [r for r in rows if r["kind"] == TABLES]
        dish, at = np.unique(np.concatenate([_risen(r["a"]) for r in got] or [np.empty(0, np.uint64)]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([np.frombuffer(r["b"], np.float64) for r in got] or [np.empty(0)]), len(dish))
        some = np.flatnonzero(sums)
        tables = np.zeros(len(dish))
        if len(some):
            others = max(dishes, len(some)) / len(some)
            c, p = np.maximum(np.rint(sums[some]), 1).astype(np.int64), np.full(len(some), others / (max(dishes, len(some)) + 1))
            for sample in seat(c, np.zeros(len(some), np.int64), p, 1, Draws(dish[some], seed + 1), d, strength / others):
                tables[some] += sample / SAMPLES
        own = np.maximum(sums - d * tables, 0)
        out = []
        for r in rows:
            if r["kind"] == WORDS:
                w = _risen(r["a"])
                k = np.minimum(np.searchsorted(dish, w), max(len(dish) - 1, 0))
                out.append({"batch": r["batch"], "bucket": r["bucket"], "kind": SHARES, "a": _squeezed((np.where(dish[k] == w, own[k], 0.0) if len(dish) else np.zeros(len(w))).astype(np.float32).view(np.uint32))})
        out.append({"batch": -1, "bucket": rows[0]["bucket"], "kind": TOTAL, "n": round(float(sums.sum()) * 1000), "k": round(float(tables.sum()) * 1000), "r": round(float(own[dish == RARE].sum()) * 1000)})
        return _table(out)

    return run


def _score(least: int, bits: int, totals: dict):
    g = totals

    def run(t: pa.Table) -> pa.Table:
        return pa.concat_tables([one(rows) for rows in _batches_of(t)])

    def one(rows: list[dict]) -> pa.Table:
        b = Batch(rows, least, bits, _vocab(rows))
        alike = np.concatenate([_spread(r["a"]).view(np.float32) for r in rows if r["kind"] == SHARES]).astype(np.float64)
        own = np.concatenate([_spread(r["a"]).view(np.float32) for r in rows if r["kind"] == SEATED]).astype(np.float64)
        share = np.concatenate([np.frombuffer(r["b"], np.float32) for r in rows if r["kind"] == SEATED]).astype(np.float64)
        share = np.repeat(share, np.diff(_starts(b.u), append=len(b.u)))
        d1, s1 = UNIGRAM
        top = np.concatenate([alike[b.own], [g["rare_own"], 0]])
        uniform = 1 / (g["v"] - g["rare_types"] + 1)  # over the dishes: words of their own, and RARE
        parent = (top + (s1 + d1 * g["tables"]) * uniform) / (g["customers"] + s1)
        log_pair = np.log10(own + share * parent[b.dish])
        dr = g["rare_discount"]
        within = (np.maximum(b.count - dr, 0) * (b.count > 0) + (1 + dr * g["rare_types"]) / (g["rare_types"] + 1)) / (g["rare"] + 1)
        token = log_pair[b.place[b.pair]] + np.where(b.own, 0, np.log10(within))[b.at]
        base = np.log10((b.count + 1) / (g["n"] + g["v"] + 1))[b.at]
        by_doc = lambda x: np.add.reduceat(x, b.first)
        ids = pa.array(b.ids, mask=(b.state & 2) > 0)
        held, known = (b.state & 1) > 0, (b.count > 0).astype(np.int64)[b.at]
        return pa.Table.from_arrays(
            [ids, pa.array(held), pa.array(b.lens), pa.array(by_doc(known)), pa.array(np.full(len(b.ids), g["n"], np.int64)), pa.array(by_doc(base)), pa.array(by_doc(token))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, least: int = 1, seed: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text).

    Learns from rows whose crc32 of the id as text, modulo folds, is not `held` (null ids learn too). A null or empty
    text is its end alone. base_score is the add-one unigram, score the model's log10 probability. Repeated rows count and
    are scored one by one; other columns are ignored."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    bits = min(16, max(6, int(np.ceil(np.log2(max(1, 2 * docs.rdd.getNumPartitions()))))))
    scan = stash(docs.mapInArrow(_scan(folds, held, bits), _BLOB), "lm-scan")
    words = scan.where(f"kind = {WORDS}")
    counts = stash(words.groupBy("bucket").applyInArrow(_frugal(_count(least)), _BLOB), "lm-counts")
    g = counts.where(f"kind = {TOTAL}").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n", "r", "k", "n1", "n2"))).first()
    part = F.shiftright("batch", 24).alias("part")  # batches of one scanning task, and of its one file
    none = [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in _BLOB.split(", ")) if c not in ("batch", "kind", "a")]
    files = scan.where(f"kind = {STREAM}").groupBy(part).agg(F.min(F.col("_metadata.file_path")).alias("path")).select("part", F.lit(-1).cast("long").alias("batch"), F.lit(FILE).alias("kind"), F.encode("path", "UTF-8").alias("a"), *none)
    answers_of = lambda df, kind: df.where(f"kind = {kind}").select(part, *_NAMES)
    of_part = files.select("part", *_NAMES).unionByName(answers_of(counts, COUNTS))
    pairs = of_part.groupBy("part").applyInArrow(_frugal(_pairs(least, bits, g.n, g.r)), _BLOB)
    seated = stash(pairs.groupBy("bucket").applyInArrow(_frugal(_seat_shard(bits, seed)), _BLOB), "lm-seated")
    shares = stash(words.unionByName(seated.where(f"kind = {TABLES}")).groupBy("bucket").applyInArrow(_frugal(_share_tables(g.v - g.k + (g.k > 0), seed)), _BLOB), "lm-shares")
    s = shares.where(f"kind = {TOTAL}").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "k", "r"))).first()
    totals = {"v": g.v, "n": g.n, "rare": g.r, "rare_types": g.k, "rare_discount": g.n1 / (g.n1 + 2 * g.n2) if g.n1 else 0.5, "customers": s.n / 1000, "tables": s.k / 1000, "rare_own": s.r / 1000}
    answers = of_part.unionByName(answers_of(seated, SEATED)).unionByName(answers_of(shares, SHARES))
    return answers.groupBy("part").applyInArrow(_frugal(_score(least, bits, totals)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
