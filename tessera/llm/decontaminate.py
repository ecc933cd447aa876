"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

Each window of an item is a set of shingles of two words (one word, where a window has one). A document that holds the window holds all
its shingles, so by the prefix filter one of them is enough to find it: the rarest, counted over all documents. Documents' shingles
are joined with these; a hit must leave room for the window in front and behind (position and length bounds), and then all of its words
are compared. The words stay where they were exploded, so a hit is verified without another join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import store

WINDOW = 10
#: Bytes of a benchmark's windows (their letters and 200 for each) up to which they travel to the documents; beyond, documents' shingles are
#: shuffled.
MAX_BROADCAST_BYTES = 64_000_000
# Fixed value: what stands between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words in lower case (A-Z only) between an empty string at either end. Null: no words."""
    t = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    # lower() changes letters beyond A-Z too; a text that has any is lowered by translate(), which is slower.
    low = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))
    return F.split(low, SEPARATORS)


def shingle(first: Column, second: Column | None = None) -> Column:
    return F.xxhash64(first) if second is None else F.xxhash64(first, second)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, at, w): size consecutive words each, or all of a shorter item. Windows that occur in several items stay apart."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("a")).withColumn("n", F.size("a") - 2).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - (size - 1), F.lit(1)))
    return items.select("item_id", "n", "a", F.explode(starts).alias("at")).select("item_id", "at", F.slice("a", F.col("at") + 1, F.least(F.lit(size), F.col("n"))).alias("w"))


def _window_shingles(w: DataFrame) -> DataFrame:
    """Windows with each of their shingles: key, and off, its place in the window."""
    last = F.greatest(F.size("w") - 1, F.lit(1))
    each = w.withColumn("off", F.explode(F.sequence(F.lit(0), last - 1)))
    first, second = F.get("w", F.col("off")), F.get("w", F.col("off") + 1)
    return each.withColumn("key", F.when(F.size("w") == 1, shingle(first)).otherwise(shingle(first, second)))


def _positions(docs: DataFrame, single: bool) -> DataFrame:
    """Documents exploded to pos and key; a (the words) goes along by reference. Position 0 is a document's head: its key is null."""
    each = docs.select("row", "a", F.posexplode("a").alias("pos", "word"))
    pair = shingle(F.col("word"), F.get("a", F.col("pos") + 1))
    head = F.col("pos") == 0
    if not single:
        return each.select("row", "a", "pos", F.when(~head, pair).alias("key"))
    both = F.array(pair, F.when(~head, shingle(F.col("word"))))
    each = each.select("row", "a", "pos", F.posexplode(both).alias("kind", "key"))
    return each.where(~head | (F.col("kind") == 0)).select("row", "a", "pos", F.when(F.col("pos") > 0, F.col("key")).alias("key"))


def _side(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs (row: any columns in a struct, text) to one row for each of its heads (item null, end = number of words) and each occurrence
    of a window (item, pos: first word from 1, end: behind the last)."""
    w = store(_window_shingles(windows(benchmark, size)), "windows")
    letters = F.when(F.col("off") == 0, F.octet_length(F.concat_ws(" ", "w")) + 200)
    n_bytes, n_single = w.agg(F.coalesce(F.sum(letters), F.lit(0)), F.count_if(F.size("w") == 1)).first()
    small, single = n_bytes <= max_broadcast, n_single > 0
    a = docs.select("row", words(F.col("text")).alias("a"))
    spread = _positions(a, single).select("key")
    counted = spread.join(_side(w.select("key").distinct(), small), "key").groupBy("key").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy("item_id", "at", "w").orderBy(F.coalesce("df", F.lit(0)), "off"))
    prefix = w.join(counted, "key", "left").withColumn("rank", rare).where("rank = 1").select("key", "item_id", "off", "w")
    prefix = store(prefix, "prefix")
    if small:
        # The document's head meets a row of its own, so that documents without a hit are told of as well.
        index = prefix.unionByName(prefix.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("key")), allowMissingColumns=True)
        spread = _positions(a, single)
        found = spread.join(F.broadcast(index.withColumnRenamed("key", "k")), F.col("key").eqNullSafe(F.col("k")))
    else:
        spread = _positions(a, single)
        heads = spread.where("key IS NULL").select("row", "a", "pos", "key")
        ready = _slices(spread.where("key IS NOT NULL"), size)
        found = heads.select("row", F.lit(None).cast(dict(prefix.dtypes)["item_id"]).alias("item_id"), F.lit(0).alias("pos"), (F.size("a") - 1).alias("end"))
        # around begins with the document's head: a window that starts before its first word is not sliced, and one that ends behind its last differs.
        start = F.col("pos") - F.col("off")
        same = F.when(start >= 1, F.slice("around", F.greatest(F.col("size0") - F.col("off"), F.lit(0)) + 1, F.size("w")) == F.col("w"))
        met = ready.join(prefix, "key").where(same)
        return found.unionByName(met.select("row", "item_id", start.alias("pos"), (start + F.size("w")).alias("end")))
    start, n = F.col("pos") - F.col("off"), F.size("a") - 2
    fits = (start >= 1) & (start + F.size("w") - 1 <= n)
    same = F.when(fits, F.slice("a", F.greatest(start, F.lit(0)) + 1, F.size("w")) == F.col("w"))
    found = found.where(F.col("item_id").isNull() & F.col("w").isNull() | same)
    return found.select("row", "item_id", F.coalesce(start, F.lit(0)).alias("pos"), F.when(F.col("w").isNull(), n + 1).otherwise(start + F.size("w")).alias("end"))


def _slices(spread: DataFrame, size: int) -> DataFrame:
    """For the shuffled join: each position with the words around it that a window could need, and not the whole text."""
    low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    return spread.select("row", "pos", "key", F.slice("a", low + 1, 2 * size).alias("around"), (F.col("pos") - low).alias("size0"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, n_words, n_hit, items (the item_ids as strings, sorted), contaminated, and fingerprint.

    One row for each row: those that repeat doc_id and text are worked out together and told of as often as they stand there. An item_id
    with several texts stands for the windows of all of them. A null or empty text has no words; null item_ids and empty items match
    nothing; with no items no document is hit, and no documents give no rows. Other columns are not read."""
    bench = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull())
    row = F.struct(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("print"))
    hits = find_hits(docs.select(row.alias("row"), "text"), bench, size, max_broadcast)
    # Covered words: the starts in order, each adding what lies behind the furthest end so far. A document's own hits are all that one row holds.
    spans = F.array_sort(F.collect_set(F.when(F.col("item_id").isNotNull(), F.struct("pos", "end"))))
    by = hits.groupBy("row").agg(
        F.max(F.when(F.col("pos") == 0, F.col("end") - 1)).alias("n_words"),
        F.count_if(F.col("pos") == 0).alias("copies"),  # every row has a head
        spans.alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["pos"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))
    covered = F.aggregate("spans", zero, step)["n"]
    by = by.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return by.select(
        F.col("row.doc_id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), "items",
        (F.size("spans") > 0).alias("contaminated"), F.col("row.print").alias("fingerprint"),
    )


def op1_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """decontaminate with windows of ten words, in the cases that it states, with the items as a digest."""
    d = decontaminate(documents, benchmark)
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


#: All n-grams of the documents against the items' windows.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, g.k k FROM g JOIN win ON g.k = win.k AND g.g = win.g),
c AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM h) GROUP BY 1),
x AS (SELECT doc_id, count(*) n_items, sha256(string_agg(s, ',' ORDER BY s)) digest FROM (SELECT DISTINCT doc_id, item_id::varchar s FROM h) GROUP BY 1)
SELECT doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, coalesce(digest, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""
