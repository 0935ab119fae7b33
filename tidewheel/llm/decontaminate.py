"""Benchmark decontamination with SQL functions only.

A window is WIDTH consecutive words of a benchmark item, or a whole shorter item. Windows of documents are hashed inside
their row (each word once, then sums of two, four and eight neighbours' hashes combine), looked up by hash alone in a
broadcast table of the items' windows, and verified word by word. Only hits and word counts are shuffled; which items a
window belongs to is joined after the hits are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import ascii_lower, helper, stash, unstash

WIDTH = 13
#: Windows and bytes of their words up to which their table is broadcast; larger ones are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 128 << 20
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of letters, digits and all beyond ASCII, A-Z in lower case; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), APART), "")


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """len, hash, body (its words), item_id: the different windows of each item of items(item_id, text)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(width)))
    one = w.select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("body")).distinct()
    parts = [F.when(F.col("len") == n, F.element_at(window_hashes("transform(body, x -> xxhash64(x))", n), 1)) for n in range(1, width + 1)]
    return one.withColumn("hash", F.coalesce(*parts))


def window_hashes(h: str, n: int) -> Column:
    """The hash of every n neighbours in the array of word hashes `h` (none may be fewer than n).

    Blocks of 1, 2, 4, ... neighbours are hashed from two halves; the blocks that n is made of are hashed together."""
    levels, expr = [h], None
    for k in range(1, n.bit_length()):
        half = 1 << (k - 1)
        levels.append(f"transform(sequence(1, size(h{k - 1}) - {half}), i -> xxhash64(h{k - 1}[i - 1], h{k - 1}[i - 1 + {half}]))")
    at, parts = 0, []
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            parts.append(f"h{k}[i - 1 + {at}]")
            at += 1 << k
    # array(x) with transform binds a name to a value, so that each level is made once
    expr = f"transform(sequence(1, size(h0) - {n - 1}), i -> xxhash64({', '.join(parts)}))"
    for k in reversed(range(n.bit_length())):
        expr = f"transform(array({levels[k]}), h{k} -> {expr})[0]"
    return F.expr(expr)


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_words, at, item_ids for every row of docs(doc_id, text).

    at: positions (from 1) of words inside any window; empty as item_ids where nothing is hit."""
    of_item = stash(benchmark_windows(items, width), "windows")
    windows = of_item.select("len", "hash", "body").distinct()
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("body", " "))), F.lit(0)).alias("bytes"), F.collect_set("len").alias("lens")).first()  # lens: width of them at most
    small = size.n <= BROADCAST_WINDOWS and size.bytes <= BROADCAST_BYTES
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    rows = d.select("doc_id", "key", "text_hash", F.size("w").cast("long").alias("n_words"))
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    found = None
    for n in sorted(size.lens):
        scan = d.where(F.size("w") >= n).select("key", "text_hash", "w", F.posexplode(window_hashes("transform(w, x -> xxhash64(x))", n)).alias("i", "hash"))
        known = windows.where(F.col("len") == n).select("hash", "body")
        same = f"forall(sequence(0, {n - 1}), j -> w[i + j] = body[j])"  # no equality of columns: the join stays on the hash
        if small:
            hit = scan.join(F.broadcast(known), "hash").where(same)
        else:  # hashes meet in a shuffle without texts; the texts of documents with candidates come after
            may = scan.select("key", "text_hash", "i", "hash").join(known, "hash")
            hit = may.join(d.select("key", "text_hash", "w").dropDuplicates(["key", "text_hash"]), ["key", "text_hash"]).where(same)
        hit = hit.select("key", "text_hash", "i", F.lit(n).alias("len"), "hash")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        unstash(of_item)
        return rows.select("doc_id", "text_hash", "n_words", none[0].alias("at"), none[1].alias("item_ids"))
    found = stash(found.distinct(), "hits")
    at = found.groupBy("key", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(i + 1, i + len)"))))).alias("at"))
    ids = found.select("key", "text_hash", "len", "hash").distinct().join(of_item.select("len", "hash", "item_id"), ["len", "hash"])
    ids = ids.groupBy("key", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = rows.join(at.join(ids, ["key", "text_hash"]), ["key", "text_hash"], "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("at", none[0]).alias("at"), F.coalesce("item_ids", none[1]).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = 5) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, text_hash, n_words, n_hit, item_ids, at, contaminated.

    contaminated: any word is hit, and the hit ones are at least `percent` of the words. Null, empty and wordless texts
    have no words and are clean; without items everything is, and an empty table of documents gives no rows. Rows that
    repeat are judged one by one, items that repeat count once; other columns of docs are ignored."""
    n = F.size("at").cast("long")
    return hits(docs, items, width).select("doc_id", "text_hash", "n_words", n.alias("n_hit"), "item_ids", "at", ((n > 0) & (100 * n >= percent * F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = 5) -> DataFrame:
    """The rows of docs whose text is not contaminated, with their columns; at `percent` 0 any hit word contaminates.

    Null and empty texts stay, rows that repeat stay or go together, columns of any name pass unchanged."""
    bad_id, bad_text = helper(docs, "bad_id"), helper(docs, "bad_text")
    bad = contamination(docs, items, width, percent).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_text)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_text)), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with hit words, and the separators before them, cut out of `text`; untouched texts stay as they are.

    Null and empty texts stay, rows that repeat are cut alike, other columns of any name pass unchanged."""
    id_, hash_, at_ = helper(docs, "id"), helper(docs, "hash"), helper(docs, "at")
    cut = hits(docs, items, width).where("size(at) > 0").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("at").alias(at_)).dropDuplicates([id_, hash_])
    apart, word = APART[:-1], "[^" + APART[1:-1]
    parts = F.regexp_extract_all("text", F.lit(f"{apart}*{word}+"), F.lit(0))
    rest = F.regexp_extract("text", f"{apart}*$", 0)
    text = F.when(F.col(at_).isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(at_, i + 1)), ""), rest))
    return docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left").withColumn("text", text).select(docs.columns)
