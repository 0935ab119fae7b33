"""N-gram Jaccard self-join by vertical partitioning.

A document is the set of its distinct word n-grams as 64-bit hashes (two different n-grams share one with odds of
2^-64 a pair; nothing verifies that); documents with equal sets are one *class*.

1. Global order: n-grams by the number of classes that hold them, rare ones first, then by hash. Tasks send their
   n-grams, packed, to buckets of the hash range, which count them and give back only those that two classes share:
   the others come first in every set and can be in no overlap.
2. Candidates: two sets of Jaccard t share an n-gram among the first n - ceil(t n) + 1 of each in the global order, at
   places that leave room for enough further ones. Posting groups of up to SMALL classes give their pairs; a larger
   group gives links to HUBS members, again as long as that links components of the group, and at last the pairs between
   those that stay apart. So a group of N near copies costs about HUBS N pairs a round, not N^2.
3. Vertical fragments: the global order is cut into FRAGMENTS ranges of about equal numbers of postings and each
   candidate's set into one segment a range. Overlaps are counted range by range and summed a pair.
4. Components of the links, then the smallest document id of each.

Counts of links need every link, not only those that hold a component together: then all pairs of every posting group
are candidates, large groups dealt by salt. A group of N near copies costs N^2 pairs, as many as it may have links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.graph import components
from tidewheel.llm.shared import BASE, helper, mix, powers, stash, to_bytes, unstash, word_hashes

#: N-grams that a task packs at once, and about how many go to one bucket of the hash range.
BATCH, BUCKET = 2_000_000, 4_000_000
#: An n-gram that is at least this share of all, and so many, is dealt over SALTS groups instead of one.
HOT_SHARE, HOT_LEAST, SALTS = 2.0**-18, 1_000_000, 256
SMALL, HUBS, FRAGMENTS = 4, 2, 4
#: Members of a posting group that meet all others in one task, where every pair is a candidate.
DEALT = 256


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the whole text; fewer than n words make one n-gram, none an empty set."""
    h = word_hashes(to_bytes(text))
    if not len(h):
        return h
    width = min(n, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : len(h) - width + 1 + k] * powers(BASE, width + 1)[k + 1]
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def set_digest(s: np.ndarray) -> int:
    """64-bit digest of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(BASE)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


class _Batches:
    """Sets gathered up to BATCH n-grams, each set once as far as a task remembers."""

    def __init__(self):
        self.seen: set[int] = set()
        self.clear()

    def clear(self) -> None:
        self.sets, self.fps, self.size = [], [], 0

    def add(self, s: np.ndarray, fp: int) -> bool:
        """Whether the batch is full."""
        if fp not in self.seen:
            if len(self.seen) >= 1_000_000:
                self.seen.clear()
            self.seen.add(fp)
            self.sets.append(s)
            self.fps.append(fp)
            self.size += len(s)
        return self.size >= BATCH


def _members(n: int):
    """kind 0: doc_id, text_hash, n_shingles, fp of every row. kind 1: n-grams (as fp) that are many in a batch, with their number."""

    def frequent(b: _Batches) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(b.sets), return_counts=True)
        keep = c >= max(2, int(BATCH * HOT_SHARE))
        h, c = h[keep].view(np.int64), c[keep].astype(np.int64)
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), none, none, pa.array(c), pa.array(h)], ["kind", "doc_id", "text_hash", "n_shingles", "fp"])

    def run(batches: Iterator[pa.RecordBatch]):
        held = _Batches()
        for b in batches:
            sizes, fps = [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), n)
                sizes.append(len(s))
                fps.append(set_digest(s) if len(s) else None)
                if len(s) and held.add(s, fps[-1]):
                    yield frequent(held)
                    held.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sizes), np.int32)), b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64())], ["kind", "doc_id", "text_hash", "n_shingles", "fp"]
            )
        if held.sets:
            yield frequent(held)

    return run


def _packed(x: np.ndarray, width: int) -> bytes:
    """Integers by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


_BLOB = "bucket int, salt int, fps binary, hashes binary, places binary"


def _scan(n: int, bits: int, hot):
    """Each batch's n-grams as differences in rising order, with the places of their sets in a list, by bucket."""

    def blob(bucket: int, salt: int, h: np.ndarray, of: np.ndarray, fps: np.ndarray) -> tuple:
        used, at = np.unique(of, return_inverse=True)
        return bucket, salt, fps[used].tobytes(), _packed(np.diff(h, prepend=np.uint64(0)), 8), _packed(at, 4)

    def flush(b: _Batches) -> pa.RecordBatch:
        h, of, fps = np.concatenate(b.sets), np.repeat(np.arange(len(b.sets)), [len(s) for s in b.sets]), np.array(b.fps, np.int64)
        order = np.argsort(h, kind="stable")
        h, of, out = h[order], of[order], []
        if len(hot.value[0]):
            at = np.minimum(np.searchsorted(hot.value[0], h), len(hot.value[0]) - 1)
            much = hot.value[0][at] == h
            salt = (mix(fps.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64)[of]
            for k in np.unique(salt[much]):
                out.append(blob(-1, int(k), h[much & (salt == k)], of[much & (salt == k)], fps))
            h, of = h[~much], of[~much]
        edge = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(h)])
        for k in np.flatnonzero(edge[1:] > edge[:-1]):
            out.append(blob(int(k), 0, h[edge[k] : edge[k + 1]], of[edge[k] : edge[k + 1]], fps))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "salt", "fps", "hashes", "places"])

    def run(batches: Iterator[pa.RecordBatch]):
        held = _Batches()
        for b in batches:
            for text in b.column(0):
                s = shingle_set(text.as_py(), n)
                if len(s) and held.add(s, set_digest(s)):
                    yield flush(held)
                    held.clear()
        if held.sets:
            yield flush(held)

    return run


def _shared(hot):
    """fp, place, tok of a bucket's n-grams that two classes or more hold; place is the n-gram's in the global order."""

    def run(t: pa.Table) -> pa.Table:
        h, fp = [], []
        for fps, hashes, places in zip(t.column("fps"), t.column("hashes"), t.column("places"), strict=True):
            h.append(np.cumsum(_unpacked(hashes.as_py(), 8), dtype=np.uint64))
            fp.append(np.frombuffer(fps.as_py(), np.int64)[_unpacked(places.as_py(), 4)])
        h, fp = np.concatenate(h), np.concatenate(fp)
        order = np.argsort(h, kind="stable")
        alike = np.concatenate([[False], h[order][1:] == h[order][:-1], [False]])
        known = t.column("bucket")[0].as_py() < 0
        order = order if known else order[alike[1:] | alike[:-1]]
        h, fp = h[order], fp[order]
        order = np.lexsort((fp, h))
        h, fp = h[order], fp[order]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])])[: len(h)]
        h, fp = h[once], fp[once]
        if known:  # a part of the classes of hot n-grams, whose number is known
            c = hot.value[1][np.searchsorted(hot.value[0], h)]
        else:
            _, at, c = np.unique(h, return_inverse=True, return_counts=True)
            c = c[at]
            h, fp, c = h[c > 1], fp[c > 1], c[c > 1]
        place = (np.floor(4 * np.log2(np.maximum(c, 1))).astype(np.uint64) << np.uint64(48)) + (h >> np.uint64(16))
        return pa.Table.from_arrays([pa.array(fp), pa.array(place.astype(np.int64)), pa.array(h.view(np.int64))], names=["fp", "place", "tok"])

    return run


class Classes:
    """`members`: doc_id, text_hash, n_shingles, fp of every row (fp is null for an empty set). `sets`: fp, n and, in the
    global order, the (place, tok) that other classes share, for each class with any."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.percent = percent
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
        found = self.found = stash(docs.mapInArrow(_members(n), "kind int, doc_id long, text_hash long, n_shingles long, fp long"), "members")
        self.members = found.where("kind = 0").drop("kind")
        total = self.members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
        least = max(HOT_LEAST, int(total * HOT_SHARE / 2))
        hot = found.where("kind = 1").groupBy("fp").agg(F.sum("n_shingles").alias("c")).where(F.col("c") >= least).toPandas()  # fewer than 2 / HOT_SHARE
        h = hot.fp.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        hot = docs.sparkSession.sparkContext.broadcast((h[order], hot.c.to_numpy(np.int64)[order]))
        bits = max(0, int(np.ceil(np.log2(max(1, total / BUCKET)))))
        shared = docs.select("text").mapInArrow(_scan(n, bits, hot), _BLOB).groupBy("bucket", "salt").applyInArrow(_shared(hot), "fp long, place long, tok long")
        shared = stash(shared, "shared")  # before it is dealt anew, so that the packed n-grams are gone by then
        sizes = self.members.where("fp is not null").groupBy("fp").agg(F.min("n_shingles").cast("int").alias("n"))
        sets = shared.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("place", "tok"))).alias("s")).join(sizes, "fp")
        self.sets = stash(sets.select("fp", "n", F.col("s.place").alias("places"), F.col("s.tok").alias("toks")), "sets")
        unstash(shared)

    def groups(self) -> DataFrame:
        """Postings tok, fp, n, at, c: prefix n-grams that c classes share; at: the n-gram's place in its set.

        The n - |toks| n-grams that no other class holds come first. A posting that sizes and places allow no partner in
        its group is left out, as is one without a partner."""
        p = self.percent
        alone = "n - size(toks)"
        head = F.expr(f"slice(toks, 1, greatest(0, n - cast(ceil({p} * n / 100.0) as int) + 1 - ({alone})))")
        post = self.sets.where(f"{alone} < n - ceil({p} * n / 100.0) + 1").select("fp", "n", F.expr(alone).alias("alone"), F.posexplode(head).alias("at", "tok")).select("tok", "fp", "n", (F.col("alone") + F.col("at")).alias("at"))
        many = post.groupBy("tok").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1").drop("c")
        near = stash(post.join(many, "tok").where(f"{100 + p} * (n - at) >= {p} * (n + greatest(least, {p} * n / 100.0))").drop("least"), "posts")
        many = near.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
        out = stash(near.join(many, "tok"), "groups")
        unstash(near)
        return out

    def cuts(self) -> list[int]:
        """Places where the next of FRAGMENTS ranges of about equal numbers of postings begins."""
        by = self.sets.select(F.explode("places").alias("x")).groupBy((F.col("x") / 2**44).cast("long").alias("x")).agg(F.count("*").alias("c")).orderBy("x").toPandas()  # at most 16 parts of 256 ranges of counts
        if not len(by):
            return []
        reached = np.searchsorted(by.c.cumsum(), [by.c.sum() * k / FRAGMENTS for k in range(1, FRAGMENTS)])
        return [int(by.x[k] + 1) << 44 for k in reached]

    def verify(self, pairs: DataFrame, cuts: list[int]) -> DataFrame:
        """The pairs(a, b, na, nb) that link, as (u, v): partial overlaps by fragment, summed a pair.

        100 I >= p U with U = A + B - I means (100 + p) I >= p (A + B)."""
        p = self.percent
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        first = F.array(F.lit(0), *(F.expr(f"size(filter(places, x -> x < {c}L))") for c in cuts), F.size("toks"))
        s = self.sets.join(wanted, "fp", "left_semi").select("fp", "toks", first.alias("e")).select("fp", "toks", "e", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("f"))
        s = stash(s.where("e[f + 1] > e[f]").select("fp", "f", F.expr("slice(toks, e[f] + 1, e[f + 1] - e[f])").alias("toks")), "segments")
        side = lambda k, toks: s.select(F.col("fp").alias(k), "f", F.col("toks").alias(toks))
        part = pairs.join(side("a", "x"), "a").join(side("b", "y"), ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("part"))
        found = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("i")).where(f"{100 + p} * i >= {p} * (na + nb)")
        found = stash(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        unstash(s)
        return found


def _pairs(p: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of x and y that sizes and places allow to link.

    Of a linked pair's first shared n-gram, at places atx and aty, at most 1 + the shorter rest can be shared; that
    instance of the pair is always kept."""
    enough = f"{100 + percent} * least(nx - atx, ny - aty) >= {percent} * (nx + ny)"
    return (
        p.where(f"x <> y and 100 * least(nx, ny) >= {percent} * greatest(nx, ny) and {enough}")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.expr("if(x < y, nx, ny)").alias("na"), F.expr("if(x < y, ny, nx)").alias("nb"))
        .distinct()
    )


def _sides():
    return ([F.col(c).alias(c2) for c, c2 in (("fp", k), ("n", f"n{k}"), ("at", f"at{k}"))] for k in "xy")


def every_link(classes: Classes) -> DataFrame:
    """Every link (u, v) between classes, each once."""
    groups = classes.groups()
    x, y = _sides()
    deals = F.ceil(F.col("c") / DEALT).cast("int")
    one = groups.select("tok", F.pmod(F.xxhash64("fp"), deals).cast("int").alias("deal"), *x)
    all_ = groups.select("tok", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), *y)
    pairs = stash(_pairs(one.join(all_, ["tok", "deal"]).where("x < y").drop("tok", "deal"), classes.percent), "pairs")
    out = classes.verify(pairs, classes.cuts())
    unstash(groups), unstash(pairs)
    return out


def _hubs(at: DataFrame, seed: int) -> DataFrame:
    """tok, y, ny, aty, cy: up to HUBS members of each group, half of them random, half of those with the fewest n-grams of
    their own, which lie in the middle of a group of near copies."""
    member = F.struct("fp", "n", "at", "comp")
    key = lambda k: F.struct(F.lit(0) if k % 2 else F.col("at"), F.xxhash64("fp", F.lit(seed * HUBS + k)))
    draw = [F.min_by(member, key(k)).alias(f"h{k}") for k in range(HUBS)]
    hub = at.groupBy("tok").agg(*draw).select("tok", F.explode(F.array_distinct(F.array(*(f"h{k}" for k in range(HUBS))))).alias("h"))
    return hub.select("tok", F.col("h.fp").alias("y"), F.col("h.n").alias("ny"), F.col("h.at").alias("aty"), F.col("h.comp").alias("cy"))


def component_labels(classes: Classes) -> DataFrame:
    """(node, comp) of each class with a link: the components of all pairs of classes at or above the threshold."""
    groups, cuts, p = classes.groups(), classes.cuts(), classes.percent
    x, y = _sides()
    few, lots = groups.where(f"c <= {SMALL}"), groups.where(f"c > {SMALL}")
    mates = few.select("tok", *x).join(few.select("tok", *y), "tok").where("x < y")
    hubs = lots.select("tok", *x).join(_hubs(lots.withColumn("comp", F.col("fp")), 0).drop("cy"), "tok")
    pairs = [stash(_pairs(mates.unionByName(hubs).drop("tok"), p), "pairs")]
    found = classes.verify(pairs[0], cuts)
    label = components(found)
    unstash(found)
    k, settling = 0, True
    while True:
        k += 1
        at = lots.select("tok", "fp", "n", "at").join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        open_ = at.groupBy("tok").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).where("l < h").select("tok")
        at = stash(at.join(open_, "tok", "left_semi"), "open")
        one = at.select("tok", *x, F.col("comp").alias("cx"))
        if settling:
            new = one.join(_hubs(at, k), "tok").where("cx <> cy")
        else:  # what hubs could not settle: members of different components, each pair once
            new = one.join(at.select("tok", *y, F.col("comp").alias("cy")), "tok").where("cx < cy")
        tested = reduce(DataFrame.unionByName, pairs).select("a", "b")
        pairs.append(stash(_pairs(new, p).join(tested, ["a", "b"], "left_anti"), "pairs"))
        unstash(at)
        found = None if pairs[-1].isEmpty() else classes.verify(pairs[-1], cuts)
        linked = found is not None and not found.isEmpty()
        if linked:
            old, label = label, components(label.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(found))
            unstash(old)
        if found is not None:
            unstash(found)
        if not settling:
            break
        settling = linked  # hubs go on as long as they link any
    for t in (groups, *pairs):
        unstash(t)
    return label


def labelled_rows(docs: DataFrame, n: int, percent: int, links: bool = False) -> DataFrame:
    """doc_id, text_hash, n_shingles, comp of every row, and n_links where `links` asks for it; comp is null for empty sets."""
    classes = Classes(docs, n, percent)
    found = every_link(classes) if links else None
    label = components(found) if links else component_labels(classes)
    members = classes.members
    at = members.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    if links:
        rows = members.where("fp is not null").groupBy("fp").agg((F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("rows"))
        both = found.select(F.col("u").alias("fp"), F.col("v").alias("other")).union(found.select("v", "u"))
        far = both.join(rows.withColumnRenamed("fp", "other"), "other").groupBy("fp").agg(F.sum("rows").alias("far"))
        of_class = rows.join(far, "fp", "left").select("fp", (F.col("rows") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
        at = at.join(of_class, "fp", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    out = stash(at.drop("fp"), "labels")
    for t in (classes.sets, classes.found, label, *([found] if links else [])):
        unstash(t)
    return out


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, links: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, and n_links where `links` asks for it.

    Sets link when 100 |A and B| >= percent |A or B|. component_id is the smallest doc_id that links reach; n_links are
    the other rows that the row links to directly, rows that repeat an id counted once. Null, empty and blank texts have
    no n-grams and stay alone; a row without doc_id links to others, and alone has a null component_id. Repeated rows give
    one row each, an empty table none. Other columns are ignored."""
    at = labelled_rows(docs, n, percent, links)
    least = at.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    return at.join(least.where("rows > 1").drop("rows"), "comp", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), *(["n_links"] if links else []))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of links: that with the smallest doc_id, by a hash of the text where ids repeat.

    Rows without n-grams or without doc_id all stay; of rows that repeat id and text one stays. Different texts under one id
    are different documents. Columns of any name pass unchanged."""
    at = labelled_rows(docs, n, percent).where("doc_id is not null")
    id_, hash_ = helper(docs, "id"), helper(docs, "hash")
    keep = at.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("keep"), F.count("*").alias("rows")).where("rows > 1")
    gone = at.join(keep, "comp").where("struct(doc_id, text_hash) <> keep").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    left = docs.join(gone, same, "left_anti")
    again = stash(at.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.count("*").alias("c")).where("c > 1").drop("c"), "repeated")
    if again.isEmpty():
        return left
    one = left.join(again, same, "inner").dropDuplicates([id_, hash_]).select(docs.columns)
    return left.join(again, same, "left_anti").unionByName(one)
