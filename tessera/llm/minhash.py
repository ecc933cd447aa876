"""MinHash near-duplicates with sequential Bayesian verification.

Documents with one sequence of words are one class. Classes meet in the buckets of banded signatures; a bucket's members are first compared
with one leader each, and links contract them to components, so a large group of near copies costs as many comparisons as it has members and
not as many as it has pairs. Only members of different components that still share a bucket are compared with each other, in blocks.
Every comparison reads the signatures batch by batch and ends once the posterior that the sets are similar enough is below the
miss probability; what survives is verified on the full sets of the words themselves. Hashes only lead to candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import files_of, map_batches, store, struct, tidy
from tessera.llm.components import components

# Fixed value: A-Z to a-z, all other bytes as they are.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

BANDS, ROWS, BATCH = 30, 5, 30  # at a similarity of 0.8, no band is shared with probability (1 - 0.8**5)**30 = 7e-6
MISS = 1e-6  # posterior below which a pair is given up
PERCENT, SIZE = 80, 5
LEADERS = 2  # rounds in which buckets are compared with one leader
SMALL = 24  # members of a bucket whose pairs are listed
BLOCK, BLOCK_BYTES = 400, 4 << 20  # members of a home's block and guests that meet there at a time, and bytes of the sets of either
PER_TASK = 4000  # pairs that a task verifies, where their number is known to be small
MB = 1  # text that is made into sets at a time
PIECE = 1 << 19  # bytes whose words are hashed at a time
MAX_BROADCAST_IDS = 200_000  # classes (some 50 bytes each) up to which they travel to the texts
MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LONG = 64  # bytes up to which a word's hash is a sum over its letters; a longer word's is a digest
WEIGHTS = np.random.default_rng(8).integers(1, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str) -> bytes:
    """The words in lower case (A-Z only), joined by single spaces."""
    return b" ".join(text.encode().translate(LOWER_BYTES).split())


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words between ASCII white space: 64 bits over all bytes of a word and its length."""
    b = np.frombuffer(data.translate(LOWER_BYTES), np.uint8)
    edge = np.diff(np.concatenate(([True], SPACE[b], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    low = np.flatnonzero(size <= LONG)
    # Some words at a time, so that what is worked out for each letter stays small.
    cuts = np.searchsorted(np.cumsum(size[low]), np.arange(PIECE, size[low].sum() + PIECE, PIECE), "right") if len(low) else []
    for one, upto in zip([0, *cuts[:-1]], cuts, strict=True) if len(low) else ():
        some = low[one:upto]
        if not len(some):
            continue
        n = size[some]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), n)
        letters = b[place + np.repeat(starts[some], n)].astype(np.uint64) + np.uint64(1)
        letters *= WEIGHTS[place]
        out[some] = mix(np.add.reduceat(letters, first) + n.astype(np.uint64))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(b[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return starts, out


def shingle_sets(texts: list[str], size: int = 2) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of size words; of all its words, if it has fewer; none without words."""
    data = [t.encode() for t in texts]
    at = np.cumsum([0, *(len(d) + 1 for d in data)])
    starts, h = word_hashes(b" ".join(data))
    cut = np.searchsorted(starts, at)
    out = []
    with np.errstate(over="ignore"):
        for i in range(len(texts)):
            w = h[cut[i] : cut[i + 1]]
            n = min(size, len(w))
            if not n:
                out.append(w)
                continue
            s = w[: len(w) - n + 1].copy()
            for k in range(1, n):
                s = mix(s) * np.uint64(3) + w[k : len(w) - n + 1 + k]
            out.append(np.unique(mix(s + np.uint64(n))))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """sets (none empty) x BANDS * ROWS minima of multiplied hashes, 32 bits each."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), len(MULTIPLIERS)), np.uint32)
    with np.errstate(over="ignore"):
        for k, m in enumerate(MULTIPLIERS):
            out[:, k] = np.minimum.reduceat((flat * m) >> np.uint64(32), first)
    return out


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Of n compared minima, the fewest that may agree: with a flat prior the posterior that the similarity is percent or more, given m
    of n, is the chance of at most m hits in n + 1 trials of that probability."""
    p, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Indices of rows of two signature matrices that no batch gives up."""
    alive, hits = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n in range(BATCH, a.shape[1] + 1, BATCH):
        part = slice(n - BATCH, n)
        hits = hits + (a[alive, part] == b[alive, part]).sum(1)
        stay = hits >= least_matches(n, percent, miss)
        alive, hits = alive[stay], hits[stay]
        if not len(alive):
            break
    return alive


def digest(words: bytes) -> tuple[int, int]:
    """128 bits that stand for a sequence of words."""
    d = hashlib.blake2b(words, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


SKETCH = T.StructType([*struct("n_shingles long, high long, low long").fields, T.StructField("sig", T.ArrayType(T.IntegerType()))])


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, high and low (the digest of its words; null without words) and sig."""
    schema = T.StructType([docs.schema["doc_id"], *SKETCH])

    def make() -> Callable[[list[dict]], list[tuple]]:
        def some(rows: list[dict]) -> list[tuple]:
            sets = shingle_sets([r["text"] or "" for r in rows], size)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full]).view(np.int32).tolist() if full else []
            by = dict(zip(full, sig, strict=True))
            return [(r["doc_id"], len(s), *(digest(normal(r["text"])) if len(s) else (None, None)), by.get(i)) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]

        return some

    return map_batches(docs.select("doc_id", "text"), make, schema, MB)


def bucket_table(reps: DataFrame) -> DataFrame:
    """(cls, sig) to (key, cls) for the bands' keys that several classes have."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, ROWS)))
    each = reps.select("cls", F.explode(bands).alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return each.join(shared, "key").select("key", "cls")


def prune(pairs: DataFrame, reps: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) whose sizes may be similar enough and that the signatures do not give up."""
    sa, sb = (reps.select(F.col("cls").alias(c), F.col("sig").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}")) for c in "ab")

    def make() -> Callable[[list[dict]], list[tuple]]:
        def some(rows: list[dict]) -> list[tuple]:
            x, y = np.array([r["sa"] for r in rows], np.int32), np.array([r["sb"] for r in rows], np.int32)
            return [(rows[i]["a"], rows[i]["b"]) for i in survivors(x, y, percent, miss).tolist()]

        return some

    fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return map_batches(pairs.join(sa, "a").join(sb, "b").where(fit).select("a", "b", "sa", "sb"), make, struct("a long, b long"), MB)


def full_words(classes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The stored words (cls, words) of some classes; their texts are read once."""
    need = store(classes.distinct().join(reps.select("cls", "rep", "high", "low"), "cls"), "need")
    side = F.broadcast(need) if need.count() <= MAX_BROADCAST_IDS else need
    texts = docs.join(side, docs["doc_id"].eqNullSafe(side["rep"])).select("cls", "high", "low", "text")

    def make() -> Callable[[list[dict]], list[tuple]]:
        def some(rows: list[dict]) -> list[tuple]:
            out = ((r, normal(r["text"] or "")) for r in rows)
            return [(r["cls"], w) for r, w in out if w and digest(w) == (r["high"], r["low"])]

        return some

    return store(map_batches(texts, make, struct("cls long, words binary"), MB).dropDuplicates(["cls"]), "words")


def shingles(words: bytes, size: int) -> set:
    """The runs of size words themselves, or all words as one run."""
    w = words.split(b" ")
    n = min(size, len(w))
    return set(zip(*(w[k:] for k in range(n)), strict=False))


def similar(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, words: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs whose full sets have percent of their union in common. words: of all classes that the pairs may have."""
    full = pairs.join(words.select(F.col("cls").alias("b"), F.col("words").alias("y")), "b").join(words.select(F.col("cls").alias("a"), F.col("words").alias("x")), "a")

    def check() -> Callable[[list[dict]], list[tuple]]:
        held: list = [None, set()]  # pairs come by a, so the last one's set is often due again

        def some(rows: list[dict]) -> list[tuple]:
            out = []
            for r in rows:
                if r["x"] != held[0]:
                    held[:] = r["x"], shingles(r["x"], size)
                if similar(held[1], shingles(r["y"], size), percent):
                    out.append((r["a"], r["b"]))
            return out

        return some

    return map_batches(full.select("a", "b", "x", "y"), check, struct("a long, b long"), MB)


def _label(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return buckets.withColumn("comp", F.col("cls"))
    return buckets.join(comps.select(F.col("id").alias("cls"), "component"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with m, the bucket's size, most, its largest component, and mass, the sum of m
    over a member's buckets: the middle of a group of near copies shares most buckets with most of them."""
    by = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    by = by.groupBy("key").agg(F.sum("n").alias("m"), F.count("*").alias("k"), F.max_by("comp", F.struct("n", "comp")).alias("most")).where("k > 1")
    each = members.join(by.select("key", "m", "most"), "key")
    return each.join(each.groupBy("cls").agg(F.sum("m").alias("mass")), "cls")


def _leader_pairs(members: DataFrame, step: int) -> DataFrame:
    """Each member with its bucket's leader, unless they are in one component. Leaders: the member of most mass; then that of most mass
    outside the largest component; then any."""
    may = members if step != 1 else members.where(F.col("comp") != F.col("most"))
    rank = F.xxhash64("cls", F.lit(step)) if step > 1 else -F.col("mass")
    lead = may.groupBy("key").agg(F.min(F.struct(rank.alias("h"), "cls", "comp")).alias("lead"))
    met = members.join(lead, "key").where(F.col("comp") != F.col("lead.comp"))
    return met.select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")).distinct()


def _small_pairs(members: DataFrame) -> DataFrame:
    """Pairs across components in buckets of SMALL members at most; listed within a row, so their number is bounded."""
    rows = members.where(F.col("m") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cls", "comp"))).alias("all"))
    one = rows.select("all", F.posexplode("all").alias("i", "x"))
    other = one.select("x", F.explode(F.slice("all", F.col("i") + 2, SMALL)).alias("y")).where(F.col("x.comp") != F.col("y.comp"))
    return other.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def _blocks() -> Column:
    """Into how many blocks a group's members go, by their number and by the bytes of their sets."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("long")


def _meetings(members: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(home, visits) of the members of larger buckets, without listing pairs.

    Every member has a home (cls, comp, h, part): a block of members of its largest bucket. Members outside a bucket's largest
    component visit (cls, comp, h, part) the homes of all that share a bucket with them, once each: where a bucket's members live in half
    the blocks of a home's bucket or more, all of its blocks, so the buckets that lead there are merged before the blocks are told apart."""
    big = store(members.where(F.col("m") > SMALL), "large")
    home = big.groupBy("cls", "comp").agg(F.max(F.struct("m", "key")).alias("h")).select("cls", "comp", F.col("h.key").alias("h"))
    home = store(home.join(reps.select("cls", "n_shingles"), "cls"), "homes")
    home = home.join(home.groupBy("h").agg(_blocks().alias("of")), "h").withColumn("part", F.pmod(F.xxhash64("cls"), "of"))
    home = store(home.select("cls", "comp", "h", "part", "n_shingles"), "home")
    homes = store(big.select("key", "cls").join(home.select("cls", "h", "part"), "cls").select("key", "h", "part").distinct(), "homes")
    parts = home.select("h", "part").distinct()
    there, all_ = homes.groupBy("key", "h").agg(F.count("*").alias("n")), parts.groupBy("h").agg(F.count("*").alias("of"))
    most = store(there.join(all_, "h").where(2 * F.col("n") >= F.col("of")).select("key", "h"), "most")
    guests = big.where(F.col("comp") != F.col("most")).select("key", "cls", "comp")
    whole = guests.join(most, "key").select("cls", "comp", "h").distinct().join(parts, "h").select("cls", "comp", "h", "part")
    some = guests.join(homes.join(most, ["key", "h"], "left_anti"), "key").select("cls", "comp", "h", "part")
    return home, store(whole.union(some).distinct().join(reps.select("cls", "n_shingles"), "cls"), "visits")


def hashed_sets(words: DataFrame, size: int) -> DataFrame:
    """words (cls, words) to the stored (cls, set: sorted 64-bit hashes), by which a meeting tells which pairs are worth verifying."""

    def make() -> Callable[[list[dict]], list[tuple]]:
        def some(rows: list[dict]) -> list[tuple]:
            sets = shingle_sets([r["words"].decode() for r in rows], size)
            return [(r["cls"], s.tobytes()) for r, s in zip(rows, sets, strict=True)]

        return some

    return store(map_batches(words, make, struct("cls long, set binary"), MB), "sets")


def common_counts(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes the sets x[i] and y[j] have in common. Each x[i] is marked among all hashes of y once."""
    names, flat = np.unique(np.concatenate(y), return_inverse=True)
    first = np.cumsum([0, *(len(s) for s in y[:-1])])
    out, mark = np.zeros(len(i), np.int64), np.zeros(len(names), np.int64)
    for k in np.unique(i).tolist():
        at = np.minimum(np.searchsorted(names, x[k]), len(names) - 1)
        at = at[names[at] == x[k]]
        mark[at] = 1
        mine = i == k
        out[mine] = np.add.reduceat(mark[flat], first)[j[mine]]
        mark[at] = 0
    return out


def _forest(a: list[int], b: list[int]) -> list[int]:
    """Which of the pairs, in their order, lead from one component to another that those before did not yet."""
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while (n := up.get(c, c)) != c:
            up[c] = c = up.get(n, n)
        return c

    out = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if (x := root(x)) != (y := root(y)):
            up[x] = y
            out.append(k)
    return out


def _met(home: DataFrame, visits: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b) that are worth verifying: in each home, guests in blocks and residents of other components are compared by
    signature, and what survives by the hashes of the sets; of the pairs that are similar by these, those that join components which
    others before them don't join, so a meeting gives fewer pairs than it has members."""
    about = reps.select("cls", "sig").join(sets, "cls")
    item = F.struct("cls", "comp", "sig", "set")
    count = visits.groupBy("h", "part").agg(_blocks().alias("of"))
    come = visits.join(count, ["h", "part"]).join(about, "cls")
    come = come.groupBy("h", "part", F.pmod(F.xxhash64("cls", F.lit(5)), "of").alias("sub")).agg(F.collect_list(item).alias("x"))
    live = home.join(count.select("h", "part"), ["h", "part"]).join(about, "cls").groupBy("h", "part").agg(F.collect_list(item).alias("y"))
    arrow = to_arrow_schema(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for c in ("x", "y"):
                    cls, comp, sig, full = batch.column(c)[k].values.flatten()
                    sides.append((cls.to_numpy(), comp.to_numpy(), sig.flatten().to_numpy().reshape(len(cls), -1), [np.frombuffer(v, np.uint64) for v in full.to_pylist()]))
                (ax, cx, sx, fx), (by, cy, sy, fy) = sides
                nx, ny = (np.array([len(v) for v in f]) for f in (fx, fy))
                fit = (cx[:, None] != cy[None, :]) & (100 * np.minimum(nx[:, None], ny) >= percent * np.maximum(nx[:, None], ny))
                i, j = np.nonzero(fit)
                keep = [some[survivors(sx[i[some]], sy[j[some]], percent, miss)] for some in np.array_split(np.arange(len(i)), -(-len(i) // 2048) or 1)]
                i, j = (v[np.concatenate(keep)] for v in (i, j))
                if len(i):
                    both = common_counts(fx, fy, i, j)
                    near = 100 * both >= percent * (nx[i] + ny[j] - both)
                    i, j = i[near], j[near]
                    due = _forest(cx[i].tolist(), cy[j].tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(ax[i[due]]), pa.array(by[j[due]])], schema=arrow)

    return come.join(live, ["h", "part"]).select("x", "y").mapInArrow(run, PAIRS)


PAIRS = struct("a long, b long")


@tidy
def near_documents(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, miss: float = MISS) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id, kept; other columns are not read. Words are what stands between ASCII white
    space, A-Z in lower case.

    One row for each row. Null, empty and blank texts link with nothing; rows that repeat a doc_id count as one document where a group's least
    doc_id is kept; a null doc_id is never the least of a group with others. An empty table gives none. Texts of any length are read whole;
    a set takes memory in proportion to its text. n_shingles counts 64-bit hashes; links compare the words themselves."""
    d = docs.select("doc_id", "text")
    rows = store(sketch(d, size), "sketch")
    has = rows.where(F.col("high").isNotNull())
    # Numbers are given once and stored, so that a class keeps its own and no two share one.
    classes = store(has.groupBy("high", "low").agg(F.min("doc_id").alias("rep")), "digests")
    classes = store(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    reps = has.join(classes, ["high", "low"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["cls"])
    reps = store(reps.select("cls", "rep", "high", "low", "n_shingles", "sig"), "reps")
    buckets = store(bucket_table(reps), "buckets")
    words = full_words(buckets.select("cls"), reps, d)
    links, comps, most = None, None, buckets.count()

    def merged(pairs: DataFrame, n: int | None) -> None:
        """Verifies pairs (n at most, if that is known); what is linked changes the components."""
        nonlocal links, comps
        new = store(verify(pairs, words, percent, size), "links", n, PER_TASK)
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            comps = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    for step in range(LEADERS + 1):
        members = store(_unsettled(_label(buckets, comps)), "members", most)
        if step:
            members = members.where("m > 2")  # a pair alone has been compared
        if members.isEmpty():
            break
        listed, n = (_leader_pairs(members, step), most) if step < LEADERS else (_small_pairs(members), SMALL * most)
        pairs = store(prune(listed, reps, percent, miss), "pairs", n, PER_TASK)
        merged(pairs, pairs.count())
    else:
        home, visits = _meetings(members, reps)
        if not visits.isEmpty():
            sets = hashed_sets(words.join(home.select("cls"), "cls"), size)
            met = _met(home, visits, reps, sets, percent, miss).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            met = store(met, "met")
            merged(met, met.count())
    ids = reps.select("cls", "rep")
    if comps is not None:
        known = ids.join(comps.withColumnRenamed("id", "cls"), "cls")
        low = known.groupBy("component").agg(F.min("rep").alias("component_id"))
        ids = ids.join(known.select("cls", "component").join(low, "component").select("cls", "component_id"), "cls", "left")
        ids = ids.select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    else:
        ids = ids.select("cls", F.col("rep").alias("component_id"))
    ids = classes.join(ids, "cls").select("high", "low", "component_id")
    out = rows.select("doc_id", "n_shingles", "high", "low").join(ids, ["high", "low"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return files_of(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), rows.count())


def op5_near_documents(documents: DataFrame) -> DataFrame:
    """near_documents with shingles of two words, in the cases that it states."""
    return near_documents(documents, size=2)


#: All pairs of documents that share a shingle, by their full sets, and the least doc_id that links lead to. Of two similar sets the smaller has
#: four fifths of the larger, so they share one of the rarest fifth of shingles of either, which keeps the pairs few.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN CASE WHEN len(w) = 1 THEN [w[1]] ELSE [] END ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) x FROM d),
e AS (SELECT doc_id, len(x) n, unnest(x) g FROM s),
q AS (SELECT *, count(*) OVER (PARTITION BY g) often FROM e),
f AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY often, g) k FROM q),
p AS (SELECT doc_id, n, g FROM f WHERE k <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id a, b.doc_id b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
m AS (SELECT a, b, len(x.x) + len(y.x) total, len(list_intersect(x.x, y.x)) shared FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b),
h AS (SELECT a, b FROM m WHERE 100 * shared >= 80 * (total - shared)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
t AS (SELECT a, min(b) low FROM r GROUP BY 1)
SELECT doc_id, len(x)::BIGINT n_shingles, least(doc_id, coalesce(low, doc_id)) component_id, doc_id <= coalesce(low, doc_id) kept FROM s LEFT JOIN t ON doc_id = a"""
