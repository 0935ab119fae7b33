"""Toxicity by weak supervision.

Lexicon voters (words and beginnings of words mined from the training labels, dealt over voters of both directions), count
voters (how many words of a text any strong entry finds) and pattern voters see each text. A generative label model
estimates by expectation maximisation how often each voter fires under either class and how strongly voters repeat each
other; correlated voters share one voice. It starts from rates on the labelled rows, sees the votes of labelled and
unlabelled rows alike, and never their labels again; a linear classifier is then trained on its posterior labels of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.docstats import labelled
from tidewheel.llm.ngram_join import shingle_set
from tidewheel.llm.quality import kept, scored, verdicts
from tidewheel.llm.shared import fold, letter_hashes, letter_places, stash, to_bytes, unstash, word_hashes

#: Labelled rows, and unlabelled ones, that training reads at most; the lexicons hold every entry of the former that is far
#: enough from chance.
MAX_LABELLED, MAX_UNLABELLED, VOTERS = 12_000, 6_000, 16
#: Bytes of the beginnings of words that may enter a lexicon.
HEADS = (4, 5, 6, 7, 8)
#: |z| from which an entry enters the lexicons; an entry is strong from STRONG_Z on, as are the STRONGEST of each direction,
#: whose z few labels may keep below. Either way its odds must differ by a factor of e^LEAST_ODDS: with many labels the words
#: of a language that is toxic a little more often are far from chance, too.
LEAST_Z, STRONG_Z, STRONGEST, LEAST_ODDS = 2.5, 4.5, 24, 1.5
PATTERNS = ["shouting", "exclaiming", "repeating", "links", "digits", "short"]
#: Count voters: so many different words with a strong entry, and so large a share of all words where there are two or more.
COUNTS, SHARES = (1, 2, 3), (0.005, 0.01, 0.02)
ALONE = 2 * (len(COUNTS) + len(SHARES))
#: Further features: count voters of both directions, then log counts and shares of such words.
MORE = ALONE + 4


def patterns(text: str | None) -> np.ndarray:
    data = to_bytes(text)
    n, words = max(1, len(data)), word_hashes(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    again = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0
    return np.array([count[65:91].sum() / n > 0.2, count[33] / n > 0.005, again > 0.1, b"://" in data, count[48:58].sum() / n > 0.05, len(words) < 30], np.float32)


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior P(toxic) of each row of 0/1 votes; y holds 0, 1 or -1 for an unlabelled row.

    Parameters per voter: P(vote | class), begun from the labelled rows, whose rates stay as prior counts, as many as
    there are rows, and re-estimated from posteriors. A voter's log odds are divided by 1 + the sum of its correlations with others
    within the classes."""
    seen = y >= 0
    rate = (y[seen].sum() + 1) / (seen.sum() + 2)
    theta = prior = np.stack([((votes * (y == c)[:, None]).sum(0) + 0.5) / ((y == c).sum() + 1) for c in (0, 1)]).clip(1e-4, 1 - 1e-4)
    strength, q = max(20.0, float(len(y))), np.where(seen, y, rate).astype(np.float64)
    for _ in range(rounds):
        apart = votes - (q[:, None] * theta[1] + (1 - q)[:, None] * theta[0])
        cov = apart.T @ apart / len(votes)
        dev = np.sqrt(np.diag(cov) + 1e-9)
        shared = 1 + np.maximum(cov / np.outer(dev, dev) - np.eye(len(dev)), 0).sum(1)
        on, off = np.log(theta[1] / theta[0]) / shared, np.log((1 - theta[1]) / (1 - theta[0])) / shared
        margin = np.log(rate / (1 - rate)) + votes @ on + (1 - votes) @ off
        new = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
        theta = np.stack([((votes * w[:, None]).sum(0) + strength * prior[c]) / (w.sum() + strength) for c, w in ((0, 1 - q), (1, q))]).clip(1e-4, 1 - 1e-4)
        rate = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
    return new


class Sparse:
    """The features of rows that are not 0, as places and values."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        self.column = np.concatenate([at for at, _ in rows] or [np.empty(0, np.int32)])
        self.value = np.concatenate([v for _, v in rows] or [np.empty(0, np.float32)]).astype(np.float64)
        self.shape = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def sums(self, of_row: np.ndarray, power: int = 1) -> np.ndarray:
        """By column: the sum of its values, raised to a power, times the rows' numbers."""
        return np.bincount(self.column, self.value**power * of_row[self.row], self.shape[1])


@dataclass
class Lexicon:
    """Entries in order of their hashes with their distance from chance and log odds ratio; positive ones are toxic."""

    words: np.ndarray
    z: np.ndarray
    odds: np.ndarray

    def __post_init__(self):
        """side: 1 for strong toxic entries, -1 for strong ones of the other direction, 0 for the rest."""
        self.side = np.zeros(len(self.z), np.int64)
        for sign in (1, -1):
            z = sign * self.z
            order = np.argsort(-z, kind="stable")[:STRONGEST]
            self.side[((z >= STRONG_Z) | np.isin(np.arange(len(z)), order[z[order] > 0])) & (sign * self.odds >= LEAST_ODDS)] = sign

    def width(self) -> int:
        return 2 * len(self.words) + len(PATTERNS) + MORE


@dataclass
class Linear:
    """Logistic model over lexicon entries (presence and log count), patterns and counts of words with strong entries."""

    lexicon: Lexicon
    weight: np.ndarray
    bias: float

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.dot(self.weight) + self.bias, -35, 35)))


def features(text: str | None, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the features that are not 0."""
    data, words = to_bytes(text), lexicon.words
    h = letter_hashes(data, HEADS)
    found, count, more = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(MORE)
    if len(words) and len(h):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = words[at] == h
        at, place = at[hit], letter_places(data, HEADS)
        n_words, place = int(place.max()) + 1, place[hit]
        found, count = np.unique(at, return_counts=True)
        for side, sign in enumerate((1, -1)):
            strong = np.unique(place[lexicon.side[at] == sign])
            n, kinds = len(strong), len(np.unique(h[strong]))  # the first members of h are the words in order
            more[side * ALONE // 2 : (side + 1) * ALONE // 2] = [kinds >= k for k in COUNTS] + [kinds > 1 and n >= r * n_words for r in SHARES]
            more[ALONE + 2 * side :][:2] = np.log1p(n), min(1.0, 20 * n / n_words)
    p = np.concatenate([patterns(text), more])
    seen = np.flatnonzero(p)
    return np.concatenate([found, len(words) + found, 2 * len(words) + seen]).astype(np.int32), np.concatenate([np.ones(len(found)), np.log1p(count), p[seen]]).astype(np.float32)


def fit_linear(x: Sparse, q: np.ndarray, lexicon: Lexicon, l2: float = 1.0, rounds: int = 12) -> Linear:
    """Newton steps on the cross entropy with posterior labels, each solved by conjugate gradients as far as it pays."""
    w, ridge = np.zeros(x.shape[1] + 1), np.append(np.full(x.shape[1], l2), 1e-6)
    up = lambda r: np.append(x.sums(r), r.sum())
    out = lambda v: x.dot(v[:-1]) + v[-1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(out(w), -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        near = np.append(x.sums(curve, 2), curve.sum()) + ridge
        left, step = up(p - q) + ridge * w, np.zeros(len(w))
        way = left / near
        size = first = left @ way
        for _ in range(40):
            if size <= 1e-4 * first or size < 1e-12:
                break
            bent = up(curve * out(way)) + ridge * way
            far = size / (way @ bent)
            step += far * way
            left = left - far * bent
            now = left @ (left / near)
            way, size = left / near + now / size * way, now
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return Linear(lexicon, w[:-1], float(w[-1]))


def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of (doc_id, y, text): each word's documents of either class."""
    for b in batches:
        y = b.column(1).to_numpy(zero_copy_only=False)
        got = [np.unique(letter_hashes(to_bytes(t.as_py()), HEADS)) for t in b.column(2)]
        if not got:
            continue
        word, at = np.unique(np.concatenate(got), return_inverse=True)
        pos = np.bincount(at, np.repeat(y, [len(g) for g in got]), len(word)).astype(np.int64)
        every = np.bincount(at, minlength=len(word)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(pos), pa.array(every)], ["word", "pos", "n"])


def once_of_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, y, text) with one row of those that share the smallest of their 5-word shingles' hashes and the label: near
    copies of one toxic text would make every word of it look toxic. rows is the bounded sample."""

    def keyed(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            first = [int(s[:1].view(np.int64)[0]) if len(s) else 0 for s in (shingle_set(t.as_py(), 5) for t in b.column(2))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.int64())], ["doc_id", "y", "text", "copy"])

    k = rows.select("doc_id", "y", "text").mapInArrow(keyed, "doc_id long, y int, text string, copy long")
    one = k.groupBy("copy", "y").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", F.xxhash64("text"))).alias("r"))
    return one.select("r.doc_id", "y", "r.text")


def unlabelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, y = -1, text of at most `most` rows without a label and outside the held-out fold, in order of a hash of the
    id; the ids of the sample are what is broadcast."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(fold(F.col("doc_id"), 5) != 0)
    sample = ids.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.lit(-1).alias("y"), "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED, others: int = MAX_UNLABELLED) -> Linear:
    """Lexicon and voters from at most `most` labelled rows; posteriors of these and of at most `others` unlabelled ones."""
    rows = stash(once_of_copies(labelled(docs, labels, label, most)), "labelled")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n1, n0 = size.pos, size.n - size.pos
    none = Lexicon(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    if not n1 or not n0:
        rate = (n1 + 0.5) / (size.n + 1)
        return Linear(none, np.zeros(none.width()), float(np.log(rate / (1 - rate))))
    c = rows.mapInArrow(evidence, "word long, pos long, n long").groupBy("word").agg(F.sum("pos").alias("p"), F.sum("n").alias("n")).where("n >= 3")
    odds = f"ln((p + 0.5) / ({n1} - p + 0.5)) - ln((n - p + 0.5) / ({n0} - n + p + 0.5))"
    dev = f"sqrt(1 / (p + 0.5) + 1 / (n - p + 0.5) + 1 / ({n1} - p + 0.5) + 1 / ({n0} - n + p + 0.5))"
    top = c.selectExpr("word", f"{odds} AS odds", f"({odds}) / {dev} AS z").where(f"abs(z) >= {LEAST_Z}").toPandas()
    word = top.word.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    lexicon = Lexicon(word[order], top.z.to_numpy(np.float64)[order], top.odds.to_numpy(np.float64)[order])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def vectors(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = [features(t.as_py(), shared.value) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([a[k].tobytes() for a in x], pa.binary()) for k in (0, 1))], ["doc_id", "y", "at", "x"])

    every = rows.unionByName(unlabelled(docs, labels, others))
    got = every.mapInArrow(vectors, "doc_id long, y int, at binary, x binary").toPandas().sort_values(["doc_id", "y"], kind="stable")
    unstash(rows)
    x = Sparse([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(got["at"], got.x, strict=True)], lexicon.width())
    return fit_linear(x, label_model(deal(x, lexicon), got.y.to_numpy(np.int64)), lexicon)


def deal(x: Sparse, lexicon: Lexicon, voters: int = VOTERS) -> np.ndarray:
    """0/1 votes: each voter holds strong entries of one direction, strongest dealt first; patterns and counts vote alone."""
    z, voter, n = lexicon.z, np.full(x.shape[1], -1), 0
    for side in (1, -1):
        at = np.flatnonzero(lexicon.side == side)
        at = at[np.argsort(-np.abs(z[at]), kind="stable")]
        voter[at] = n + np.arange(len(at)) % voters
        n += min(voters, len(at))
    alone = len(PATTERNS) + ALONE
    voter[2 * len(z) : 2 * len(z) + alone] = n + np.arange(alone)
    votes, of = np.zeros((x.shape[0], n + alone)), voter[x.column]
    votes[x.row[of >= 0], of[of >= 0]] = 1
    return votes


def vectors_of(lexicon: Lexicon):
    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            yield b, Sparse([features(t.as_py(), lexicon) for t in texts], lexicon.width())

    return run


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    Learns from labels outside fold 0 of crc32(doc_id) mod 5 and from the texts of rows without a label. Null and empty
    texts score as texts without words; repeated rows score alike; without labels every score is 0.5, and an empty table
    gives no rows. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, labels, most=most)
    return verdicts(scored(docs, model, vectors_of(model.lexicon), ["doc_id"]), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs below the threshold, with their columns; null texts are judged as empty ones, repeated rows alike."""
    model = train(docs, labels, most=most)
    return kept(docs, model, lambda score: score < threshold, vectors_of(model.lexicon))
