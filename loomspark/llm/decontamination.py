"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A window that is similar enough to an item shares most of its word shingles, so the positions of shared
shingles say exactly where windows of that item's size can matter: every start whose window holds
enough of them, in any order, as disjoint ranges of starts. All these windows get a SimHash.
Fingerprints are cut in one block more than the radius: two within the radius agree in a block, so
equality of a block of the item finds every pair within it, and an exact weighted-shingle similarity
verifies the pairs. Windows keep the item they were enumerated for and are compared with no other, so
the positions select the pairs; at so wide a radius blocks agree for nearly all unrelated pairs too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.textbytes import WORD
from loomspark.storage import written

K, SIMILARITY = 5, 0.8
BITS, RADIUS = 64, 23
#: Bytes up to which a side is sent to all executors; beyond it, it is shuffled.
SMALL_BYTES = 64 << 20


def _small(df: DataFrame, array: str | None = None, item_bytes: int = 8) -> DataFrame:
    """df, marked for broadcast if it takes at most SMALL_BYTES as a hash table: its columns, its array's items, and twice that for the table."""
    held = F.size(array) * item_bytes if array else F.lit(0)
    size = 2 * (df.agg(F.sum(held + 16 * len(df.columns) + 32)).first()[0] or 0)
    return F.broadcast(df) if size <= SMALL_BYTES else df


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingle_hashes(words: Column, k: int = K) -> Column:
    """Hashes of the k-word shingles in order; fewer words: the whole sequence as one; none: none."""

    def of(ws: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k)))
        return F.when(F.size(ws) >= k, many).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), of)[0]  # a lambda variable, so that the words are cut once


def simhash(hashes: Column) -> Column:
    """The 64-bit fingerprint: each bit is the majority of that bit over the shingles, repeats counted.

    Bits are counted in lanes of a long, several at once: eight of 8 bits for up to 127 shingles (the top
    lane has the sign), then wider ones.
    """

    def by_lanes(width: int) -> Column:
        mask = sum(1 << at for at in range(0, BITS, width))

        def count(j: int) -> Column:
            return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(mask)))

        counts = F.array(*[count(j) for j in range(width)])

        def bit(held: Column, b: Column) -> Column:
            lane = F.call_function("shiftrightunsigned", F.element_at(held, (b % width + 1).cast("int")), (b - b % width).cast("int"))
            return F.when(lane.bitwiseAND(F.lit((1 << width) - 1)) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

        every = F.sequence(F.lit(0), F.lit(BITS - 1))
        return F.transform(F.array(counts), lambda held: F.aggregate(every, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(held, b))))[0]

    return F.when(F.size(hashes) < 1 << 7, by_lanes(8)).when(F.size(hashes) < 1 << 15, by_lanes(16)).otherwise(by_lanes(32))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """array<struct<block, value>>: radius + 1 blocks of bits."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts of each shingle."""
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def window_ranges(at: Column, m: Column, dn: Column, similarity: float) -> Column:
    """array<struct<a, b>>: disjoint ranges of starts (sorted positions at: shared with an item of m shingles, in a text of dn) whose window can be similar enough.

    Weighted similarity t of two sets of sizes w and m needs 2t / (1 + t) of m shared if w = m, and t of
    m at least if the text ends inside the window; each shared shingle of a window has its own position.
    The i-th range holds the starts whose window covers positions i to i + need - 1; both of its ends grow
    with i, so cutting each at its predecessor's end makes them disjoint.
    """
    kind = "array<struct<a:int,b:int>>"

    def covering(share: float, low: Column, high: Column) -> Column:
        need = F.ceil(m * share - 1e-9).cast("int")

        def end(i: Column) -> Column:
            return F.least(F.element_at(at, i), high)

        def held(i: Column) -> Column:
            a = F.greatest(F.element_at(at, i + need - 1) - m + 1, low)
            return F.struct(F.when(i > 1, F.greatest(a, end(F.greatest(i - 1, F.lit(1))) + 1)).otherwise(a).alias("a"), end(i).alias("b"))

        found = F.filter(F.transform(F.sequence(F.lit(1), F.size(at) - need + 1), held), lambda x: x["a"] <= x["b"])
        return F.when(F.size(at) >= need, found.cast(kind)).otherwise(F.array().cast(kind))

    whole = covering(2 * similarity / (1 + similarity), F.lit(0), dn - m)
    return F.concat(whole, covering(similarity, F.greatest(dn - m + 1, F.lit(0)), dn - 1))


#: Starts that a row holds while windows are cut: a text's windows are never all in one row.
CHUNK = 64


def _windows(texts: DataFrame, spots: DataFrame) -> DataFrame:
    """(id, th, key, n, start, ws): every window of the ranges of spots, cut from the shingles of texts."""
    both = texts.join(spots, [texts.id.eqNullSafe(spots.i), texts.th == spots.t]).select("id", "th", "dh", "key", "n", "m", "ranges")
    chunks = F.flatten(F.transform("ranges", lambda r: F.transform(F.sequence(r["a"], r["b"], F.lit(CHUNK)), lambda s: F.struct(s.alias("a"), F.least(s + (CHUNK - 1), r["b"]).alias("b")))))
    parts = F.transform(chunks, lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.slice("dh", c["a"] + 1, c["b"] - c["a"] + F.col("m")).alias("hs")))
    cut = both.select("id", "th", "key", "n", "m", F.explode(parts).alias("p"))
    cut = cut.select("id", "th", "key", "n", "m", "p", F.explode(F.sequence("p.a", "p.b")).alias("start"))
    return cut.select("id", "th", "key", "n", "start", F.slice("p.hs", F.col("start") - F.col("p.a") + 1, F.col("m")).alias("ws"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per (document, text) with a window similar to an item: id_col, __ls_text (hash of the text), item_id, similarity, window_start, window_words.

    The best window is given: highest similarity, then smallest item, then first start (in words from 0).
    Every start counts; the end of the text may cut a window. Items without words match nothing, items of
    fewer than k words only texts that are the item. Rows equal in identifier and text give one row, null
    texts count as empty. Nothing in, nothing out.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    # items may tie or be null: a key of their own joins them
    items = written(items.select(F.monotonically_increasing_id().alias("key"), "item", F.size("w").alias("n"), shingle_hashes(F.col("w"), k).alias("hs")), "benchmark-items")
    own = items.select("key", "n", F.size("hs").alias("m"), F.explode("hs").alias("h")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    hashed = rows.select("id", "th", shingle_hashes(words_of(F.col("text")), k).alias("dh"))
    hits = hashed.select("id", "th", F.size("dh").alias("dn"), F.posexplode("dh").alias("p", "h")).join(_small(own), "h")
    # Rows equal in identifier and text hit together: a set of positions counts them once.
    placed = hits.groupBy("id", "th", "key", "n", "m", "dn").agg(F.array_sort(F.collect_set("p")).alias("at"))
    spots = placed.select(F.col("id").alias("i"), F.col("th").alias("t"), "key", "n", "m", window_ranges(F.col("at"), F.col("m"), F.col("dn"), similarity).alias("ranges"))
    spots = written(spots.filter(F.size("ranges") > 0), "benchmark-spots")
    some = _small(spots.select("i", "t").distinct())
    texts = rows.join(some, [rows.id.eqNullSafe(some.i), rows.th == some.t], "left_semi").dropDuplicates(["id", "th"])
    texts = written(texts.select("id", "th", shingle_hashes(words_of(F.col("text")), k).alias("dh")), "benchmark-texts")
    windows = _windows(texts, _small(spots, "ranges"))
    marked = windows.withColumn("f", simhash(F.col("ws")))
    left = marked.select("*", F.explode(blocks(F.col("f"), radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    prints = items.select("key", simhash(F.col("hs")).alias("g"))
    right = prints.select("key", "g", F.explode(blocks(F.col("g"), radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    near = left.join(_small(right), ["key", "block", "value"]).filter(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius)
    # A pair within the radius may agree in many blocks: its first block reports it.
    first = F.size(F.filter(F.zip_with(blocks(F.col("f"), radius), blocks(F.col("g"), radius), lambda x, y: F.struct((x["value"] == y["value"]).alias("same"), x["block"].alias("block"))), lambda x: x["same"] & (x["block"] < F.col("block")))) == 0
    near = near.filter(first).join(_small(items.select("key", "item", "hs"), "hs"), "key")
    scored = near.withColumn("similarity", weighted_similarity(F.col("ws"), F.col("hs"))).filter(F.col("similarity") >= similarity - 1e-9)
    best = scored.groupBy("id", "th").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "item", "start", "n")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("th").alias("__ls_text"), F.col("b.item").alias("item_id"), (-F.col("b.s")).alias("similarity"), F.col("b.start").alias("window_start"), F.col("b.n").alias("window_words"))


def _matched(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    found = found.withColumnRenamed(id_col, "__ls_id")
    return docs.withColumn("__ls_own", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(found, [docs[id_col].eqNullSafe(F.col("__ls_id")), F.col("__ls_own") == F.col("__ls_text")], how)


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row per row of docs: id_col, contaminated, item_id, similarity, window_start, window_words (null where clean)."""
    found = written(contaminated(docs, benchmark, id_col, text_col, **options), "benchmark-found")
    slim = docs.select(id_col, text_col)
    out = _matched(slim, _small(found), id_col, text_col, "left")
    return out.select(slim[id_col], F.col("similarity").isNotNull().alias("contaminated"), "item_id", "similarity", "window_start", "window_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """docs without the contaminated documents; all columns stay. Clean, null and empty texts stay."""
    found = written(contaminated(docs, benchmark, id_col, text_col, **options), "benchmark-found")
    return _matched(docs, _small(found), id_col, text_col, "left_anti").drop("__ls_own")
