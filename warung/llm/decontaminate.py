r"""Benchmark decontamination in DataFrame functions alone.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.  A
window is ``n`` consecutive words of a benchmark item; an item of fewer words
is one window as a whole.  A document word inside any occurrence of a window
is hit.

1. The benchmark's windows are normalised to strings and written once.  A
   window's signature is a hash of its first, middle and last word.  Signatures
   make a bitmap of bounded size, a constant of the plan: the hash set that
   every token window of a document is looked up in, where it lies.
2. What the bitmap lets through (hits and some hundredth of the rest) is
   verified word by word: the window's words meet the benchmark's by an equi-join,
   broadcast while the windows' bytes are under a bound, else left to Spark.
   A bitmap that gets crowded only lets more through.
3. Verified hits are merged to spans per document.  Windows of the same items
   are one class, and documents hit by the same classes share one list of items,
   so a passage that many documents and items share is listed once.

Texts never travel: the scan writes ids, word counts and candidate windows.

Defined results: null has no words; an item without words has no window; rows
repeated in any column are documents each; items are told by their id, so a
repeated id counts once and a null one never (its windows still hit); empty
tables give no row, or rows without a hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from warung.llm.store import saved

#: ASCII characters that are no part of a word: they become spaces.
GAPS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words of a text, none for null."""
    spaced = F.translate(text, GAPS + UPPER, " " * len(GAPS) + LOWER)
    return F.array_remove(F.split(F.coalesce(spaced, F.lit("")), " "), "")


def signature(first: Column, hashes: str, start: Column, n: int) -> Column:
    """Hash of a window's first, middle and last word: what the hash set holds."""
    return F.xxhash64(F.lit(n), first, F.get(hashes, start + (n - 1) // 2), F.get(hashes, start + n - 1))


def window_text(tokens: str, start: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(tokens, start + j) for j in range(n)])


def _starts(tokens: str, n: int) -> Column:
    """Where a window of ``n`` words can start."""
    return F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))


# ----------------------------------------------------------------- benchmark
def benchmark_windows(spark: SparkSession, benchmark: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(windows(gram, size, hash, class), owners(class, item))``.

    Windows that stand in the same items are one class; what identifies the set
    of items is their number and two sums of hashes."""
    tokens = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w"))
    text = F.array_join("w", " ")
    tokens = tokens.where("size(w) > 0").select("item", text.alias("t"))
    texts = saved(spark, tokens.select("t").distinct().withColumn("text_id", F.monotonically_increasing_id()), "leak-texts")
    items = tokens.join(texts, "t").select("text_id", "item").distinct()
    split = texts.select("text_id", F.split("t", " ").alias("w"))
    long = split.where(F.size("w") >= n).select("text_id", F.explode(F.transform(_starts("w", n), lambda i: window_text("w", i, n))).alias("gram"))
    short = split.where(F.size("w") < n).select("text_id", F.array_join("w", " ").alias("gram"))
    found = saved(spark, long.unionByName(short).distinct(), "leak-found")
    sums = [F.sum(F.xxhash64(F.lit(k), "text_id").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    grams = found.groupBy("gram").agg(F.count("*").alias("k"), *sums)
    parts = F.transform(F.split("gram", " "), lambda x: F.xxhash64(x))
    grams = grams.withColumn("h", parts).withColumn("size", F.size("h"))
    by_size = reduce(lambda e, m: F.when(F.col("size") == m, signature(F.get("h", F.lit(0)), "h", F.lit(0), m)).otherwise(e), range(1, n + 1), F.lit(None).cast("long"))
    named = grams.groupBy("k", "s1", "s2").agg(F.min("gram").alias("sample"))
    named = saved(spark, named.withColumn("class", F.monotonically_increasing_id()), "leak-classes")
    windows = saved(spark, grams.join(named, ["k", "s1", "s2"]).select("gram", "size", by_size.alias("hash"), "class"), "leak-windows")
    owners = named.select("class", F.col("sample").alias("gram")).join(found, "gram").join(items, "text_id")
    return windows, saved(spark, owners.where("item IS NOT NULL").select("class", "item").distinct(), "leak-owners")


def _word_of(h: Column, bits: int) -> Column:
    """The top of the hash names a 64-bit word, its last six bits a bit there."""
    return F.shiftrightunsigned(h, 71 - bits.bit_length()).cast("int")


def bitmap(windows: DataFrame, bits: int) -> Column:
    """A constant array of ``bits / 64`` words with a bit set for every window's
    signature; only words with a bit come to the driver."""
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    filled = {r["word"]: r["b"] for r in windows.groupBy(_word_of(F.col("hash"), bits).alias("word")).agg(F.bit_or(bit).alias("b")).collect()}
    return F.split(F.lit(",".join(str(filled.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>")


# ---------------------------------------------------------------------- scan
def scan(docs: DataFrame, windows: DataFrame, *, sizes: list[int], bits: int, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, number of words and the windows (start, size,
    words) whose bit is set."""
    if not sizes:
        none = F.array().cast("array<struct<at:int,size:int,gram:string>>")
        return docs.select(*keep, F.col(id_col).alias("_id"), F.size(words(F.col(text_col))).cast("long").alias("n_words"), none.alias("maybe"))
    there = bitmap(windows, bits)
    rows = docs.select(*keep, F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_w"))
    rows = rows.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    for n in sizes:                                                    # a column each, so that nothing is hashed twice
        rows = rows.withColumn(f"_s{n}", F.transform("_h", lambda x, i: signature(x, "_h", i, n)))

    def is_set(h: Column) -> Column:
        return F.getbit(F.get(there, _word_of(h, bits)), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    def maybe(n: int) -> Column:
        inside = lambda i: i <= F.size("_w") - n
        starts = F.filter(F.array_compact(F.transform(f"_s{n}", lambda x, i: F.when(is_set(x), i))), inside)
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), window_text("_w", i, n).alias("gram")))

    found = [maybe(n) for n in sizes]
    return rows.select(*keep, "_id", F.size("_w").cast("long").alias("n_words"), (F.concat(*found) if len(found) > 1 else found[0]).alias("maybe"))


def hits(spark: SparkSession, scanned: DataFrame, windows: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``_rid, at, size, class`` of the windows whose words are a benchmark's."""
    size = windows.agg(F.sum(F.octet_length("gram") + 64)).first()[0] or 0
    known = windows.select("gram", "class")
    asked = scanned.select("_rid", F.inline("maybe"))
    return asked.join(F.broadcast(known) if size <= broadcast_bytes else known, "gram").select("_rid", "at", "size", "class")


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, n: int = 10, bits_per_window: int = 64, max_bits: int = 1 << 24,
           broadcast_bytes: int = 64 << 20, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """``keep`` columns of every document, its id, ``n_words, n_hit, n_items,
    items_sha256, contaminated`` and ``spans`` (start and end word of the hit
    runs, in order)."""
    keep = keep or []
    windows, owners = benchmark_windows(spark, benchmark, n, item_col, item_text_col)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())    # n of them at most
    bits = 1 << 16
    while bits < min(max_bits, bits_per_window * windows.count()):
        bits *= 2
    found = scan(docs, windows, sizes=sizes, bits=bits, keep=keep, id_col=id_col, text_col=text_col)
    scanned = saved(spark, found.withColumn("_rid", F.monotonically_increasing_id()), "leak-scan")
    sure = saved(spark, hits(spark, scanned, windows, broadcast_bytes), "leak-hits")

    # spans: a hit starts a run if it begins after all before it have ended
    by = W.partitionBy("_rid").orderBy("at", "size")                             # the hits of one document
    ends = F.max(F.col("at") + F.col("size")).over(by.rowsBetween(W.unboundedPreceding, -1))
    runs = sure.select("_rid", "at", "size").distinct().withColumn("new", F.coalesce(F.col("at") > ends, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by)).groupBy("_rid", "run").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("size")).alias("b"))
    runs = runs.groupBy("_rid").agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))

    # documents hit by the same classes share one list of items
    sets = sure.groupBy("_rid").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    sets = saved(spark, sets.withColumn("key", F.sha2(F.to_json("classes").cast("binary"), 256)), "leak-sets")
    lists = sets.groupBy("key").agg(F.first("classes").alias("classes")).select("key", F.explode("classes").alias("class"))
    lists = lists.join(owners, "class").select("key", F.col("item").cast("string").alias("item")).distinct()
    lists = lists.groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    listed = sets.select("_rid", "key").join(lists, "key", "left").select("_rid", "n_items", "items_sha256")

    zero = F.lit(0).cast("long")
    out = scanned.drop("maybe").join(runs, "_rid", "left").join(listed, "_rid", "left")
    n_hit = F.coalesce(F.col("n_hit").cast("long"), zero)
    return out.select(*keep, F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                      F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"))


# ------------------------------------------------------------------- removal
def without_spans(text: Column, spans: Column, filler: str = " ") -> Column:
    """The text with each hit run of words, and what lies between them, replaced
    by ``filler``."""
    gaps, own = F.split(text, WORD, -1), F.array_remove(F.split(text, rf"[{_class(GAPS)}]+"), "")
    hit = lambda i: F.exists(spans, lambda s: (s["a"] <= i) & (i < s["b"]))
    first = lambda i: F.exists(spans, lambda s: s["a"] == i)
    one = lambda i: F.when(~hit(i), F.concat(F.get(gaps, i), F.get(own, i))).when(first(i), F.concat(F.get(gaps, i), F.lit(filler))).otherwise("")
    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size(own) - 1), one), "")
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(kept, F.element_at(gaps, -1)))


def _class(chars: str) -> str:
    return "".join(f"\\x{ord(c):02X}" for c in chars)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without their contaminated documents (``remove="documents"``), or
    with the hit spans cut out of the texts (``remove="spans"``)."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    id_col = how.get("id_col", "doc_id")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    found = report(spark, rows, benchmark, keep=["_row"], **{**how, "id_col": "_key", "text_col": "_text"})
    if remove == "documents":
        return found.where("NOT contaminated").select("_row.*")
    cut = without_spans(F.col(f"_row.{text_col}"), F.col("spans"))
    return found.withColumn("_cut", cut).select(*[F.col("_cut").alias(c) if c == text_col else F.col(f"_row.{c}").alias(c) for c in docs.columns])
