"""Embedding near-duplicates by iterative quantisation: a learned rotation to balanced binary codes, multi-index Hamming tables, and a
rerank with the original vectors in double precision.

Codes are cut into parts, each the key of a table; a part is two bits longer than the number of vectors needs, so chance meetings in a
table grow as the vectors do, and there are as many tables as keep a pair at the threshold. What shares a key is first compared with one
leader a bucket. Leaders gather groups around them: dense groups are then told of by groups and not by pairs. Two groups that share a key
are all linked, or not at all, or not known, by their leaders' angle and their radii; only the last are compared by blocked matrix products,
which give back counts and never pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import files_of, map_batches, store, struct, tidy
from tessera.llm.components import components

THRESHOLD = 0.95
#: Rows from which the rotations are learned: those of least hash. All rows are coded and searched.
MAX_SAMPLE = 4096
CODE_BITS, ROUNDS = 64, 30
#: Sampled vectors of one length that are no near copies of each other, from which rotations are learned; with fewer, random ones do.
LEAST_LEARNED = 256
#: The share of pairs at the threshold that must meet in a table, measured on the sample; the number of rotations follows from it.
LEAST_FOUND = 0.985
MAX_ROTATIONS = 80
MAX_GATHERINGS = 6  # rounds of leaders; what they leave is compared as it is
BLOCK_BYTES = 1 << 18  # of vectors on either side of a matrix product
EPS = 1e-9  # by which angles must clear a bound


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """dim x bits: directions, then the rotation that alternates between the nearest corners of the cube and the orthogonal map to them.
    The first seed takes the principal directions; the others random ones, so that codes of several rotations err on different pairs.
    Fewer dimensions than bits are filled with random ones, so codes keep their length."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    if seed == 0:
        _, _, vt = np.linalg.svd(np.cov(x, rowvar=False) + 1e-9 * np.eye(dim))
        base = vt.T[:, :bits]
    else:
        base = np.linalg.qr(rng.standard_normal((dim, min(dim, bits))))[0]
    if base.shape[1] < bits:
        base = np.hstack([base, rng.standard_normal((dim, bits - base.shape[1])) / np.sqrt(dim)])
    v = x @ base
    rot = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.where(v @ rot >= 0, 1.0, -1.0).T @ v)
        rot = (u @ wt).T
    return base @ rot


@dataclass(frozen=True)
class Codes:
    """Mean and rotations of a coder."""

    mean: np.ndarray
    rotations: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows of unit vectors to rows of signed 64-bit codes, one for each rotation."""
        out = []
        for r in self.rotations:
            on = ((x - self.mean) @ r >= 0).astype(np.uint64)
            out.append((on << np.arange(on.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64))
        return np.stack(out, 1)


def units(rows: list[list | None]) -> tuple[np.ndarray, np.ndarray]:
    """(good, vectors): which rows are vectors of finite numbers, not zero and of the longest length, and those as unit vectors in double
    precision. Each is divided by its largest component first, so that squares neither overflow nor vanish."""
    good = np.array([bool(r) and None not in r for r in rows], bool)
    size = max((len(r) for r, g in zip(rows, good, strict=True) if g), default=0)
    good &= np.array([g and len(r) == size for r, g in zip(rows, good, strict=True)], bool) if len(rows) else good
    x = np.array([r for r, g in zip(rows, good, strict=True) if g], float).reshape(-1, size)
    most = np.abs(x).max(1, initial=0)
    fine = np.isfinite(most) & (most > 0)
    good[np.flatnonzero(good)[~fine]] = False
    x = x[fine] / most[fine, None]
    return good, x / np.sqrt((x * x).sum(1))[:, None]


def usable(vector: str) -> Column:
    """Not null, and neither null, non-finite nor zero all over."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector).cast("array<double>")
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def key_bits(n: int) -> int:
    """Bits of a table's keys for n vectors."""
    return min(32, max(8, (max(n, 2) - 1).bit_length() + 2))


def parts(codes: np.ndarray, width: int) -> np.ndarray:
    """The keys of each row's tables, side by side."""
    c, mask = codes.view(np.uint64), np.uint64((1 << width) - 1)
    return np.concatenate([(c >> np.uint64(t * width)) & mask for t in range(CODE_BITS // width)], 1)


@lru_cache(32)
def unlearned(dim: int, width: int, threshold: float = THRESHOLD) -> Codes:
    """The coder of a length that the sample tells too little of: random directions through the origin, by which two vectors differ in a
    bit with a probability of their angle, so the number of tables follows without any measurement."""
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** width
    tables = int(np.ceil(np.log(1 - LEAST_FOUND) / np.log1p(-min(same, 0.99)))) + 2
    n = min(MAX_ROTATIONS, -(-tables // (CODE_BITS // width)))
    return Codes(np.zeros(dim), [np.random.default_rng((seed, dim)).standard_normal((dim, CODE_BITS)) for seed in range(n)])


def found_at(coder: Codes, x: np.ndarray, width: int, threshold: float) -> float:
    """The share of rows that meet a vector at the threshold's cosine, in a random direction, in some table."""
    rng = np.random.default_rng(11)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1)[:, None] * x
    size = np.sqrt((z * z).sum(1))[:, None]
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * z / np.where(size > 0, size, 1)
    return float((parts(coder(x), width) == parts(coder(y), width)).any(1).mean())


def learn_coder(x: np.ndarray, width: int, threshold: float) -> Codes:
    """The coder of one length from the sample's unit vectors x. Near copies count once: of those with one coarse code the first, so no
    group of them moves the mean. Rotations are added until both all rows and those that count find LEAST_FOUND of their neighbours;
    where even MAX_ROTATIONS don't, as for a group around the mean, random directions through the origin do."""
    _, first = np.unique(parts(unlearned(x.shape[1], 16, threshold)(x)[:, :1], 16)[:, 0], return_index=True)
    lone = x[first]
    if len(lone) < LEAST_LEARNED or x.shape[1] < 2:
        return unlearned(x.shape[1], width, threshold)
    mean, rotations = lone.mean(0), []
    most = 2 * len(unlearned(x.shape[1], width, threshold).rotations)
    while len(rotations) < min(most, MAX_ROTATIONS):
        rotations.append(learn_rotation(lone - mean, CODE_BITS, len(rotations)))
        coder = Codes(mean, rotations)
        if min(found_at(coder, x, width, threshold), found_at(coder, lone, width, threshold)) >= LEAST_FOUND:
            return coder
    return unlearned(x.shape[1], width, threshold)


def learn(df: DataFrame, width: int, threshold: float = THRESHOLD, max_sample: int = MAX_SAMPLE) -> dict[int, Codes]:
    """The coders by vector length, from at most max_sample of df's vectors v: for lengths that have LEAST_LEARNED of these."""
    rows = df.select("v").orderBy(F.xxhash64("v"), "v").limit(max_sample).collect()
    by_size = defaultdict(list)
    for r in rows:
        by_size[len(r["v"])].append(r["v"])
    return {dim: learn_coder(units(some)[1], width, threshold) for dim, some in by_size.items() if len(some) >= LEAST_LEARNED and dim > 1}


def coded(classes: DataFrame, coders: dict[int, Codes], width: int, threshold: float) -> DataFrame:
    """classes (cls, n, v) to cls, n, dim, unit (little-endian doubles), code, and order: cls mixed, by which leaders are chosen."""
    schema = T.StructType([*struct("cls long, n long, dim long, unit binary").fields, T.StructField("code", T.ArrayType(T.LongType()))])

    def make() -> Callable[[list[dict]], list[tuple]]:
        def some(rows: list[dict]) -> list[tuple]:
            out, by_size = [], defaultdict(list)
            for r in rows:
                by_size[len(r["v"])].append(r)
            for dim, alike in by_size.items():
                _, x = units([r["v"] for r in alike])
                code = coders.get(dim) or unlearned(dim, width, threshold)
                out += [(r["cls"], r["n"], dim, u.tobytes(), c) for r, u, c in zip(alike, x, code(x).tolist(), strict=True)]
            return out

        return some

    return map_batches(classes.select("cls", "n", "v"), make, schema).withColumn("order", F.xxhash64("cls"))


def table_keys(df: DataFrame, width: int, *cols: str) -> DataFrame:
    """cols and key, a row for each table: vectors of one length that agree in a part share its key."""
    per, mask = CODE_BITS // width, (1 << width) - 1
    piece = lambda c, t: F.shiftrightunsigned(c, t * width).bitwiseAND(F.lit(mask).cast("long"))
    keys = F.flatten(F.transform("code", lambda c, r: F.array(*(F.xxhash64("dim", r * per + t, piece(c, t)) for t in range(per)))))
    return df.select(*cols, F.explode(keys).alias("key"))


def apart(a: Column, b: Column) -> Column:
    """In how many bits two codes differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def may(a: Column, b: Column, angle: Column) -> Column:
    """Whether codes differ in no more bits than vectors at the angle do but for one time in many millions (six deviations)."""
    bits = F.size(a) * CODE_BITS
    p = F.least(angle / np.pi, F.lit(0.5))
    return (F.size(a) == F.size(b)) & (apart(a, b) <= 1.25 * bits * p + 6 * F.sqrt(bits * p * (1 - p)) + 2)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Binary vectors of one length as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def cosines(pairs: DataFrame) -> DataFrame:
    """pairs with columns ua and ub (unit vectors of one length in a row) in place of which comes cos."""
    keep = [c for c in pairs.columns if c not in ("ua", "ub")]
    schema = T.StructType([*(pairs.schema[c] for c in keep), T.StructField("cos", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) for x in batch.column("ua").to_pylist()])
            for dim in np.unique(size):
                some = batch.take(pa.array(np.flatnonzero(size == dim)))
                for at in range(0, some.num_rows, 4096):
                    part = some.slice(at, 4096)
                    cos = (_matrix(part.column("ua")) * _matrix(part.column("ub"))).sum(1)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(cos)], schema=arrow)

    return pairs.select(*keep, "ua", "ub").mapInArrow(run, schema)


def gather(codes: DataFrame, n: int, width: int, threshold: float) -> DataFrame:
    """(cls, grp, cos) of all n classes: grp is the class of its leader, cos its cosine with it. In a round every bucket's class of least
    order leads; a class that none leads is a leader for good, and each class goes to the nearest of those that lead it, at the
    threshold at least. The rest meet again without them, until a round gathers none; what no leader takes leads itself."""
    theta = F.lit(float(np.arccos(threshold)))
    left, taken = codes.select("cls", "order", "dim", "code"), None
    for _ in range(MAX_GATHERINGS):
        each = table_keys(left, width, "cls", "order")
        heads = each.groupBy("key").agg(F.min("order").alias("head"), F.count("*").alias("m")).where("m > 1")
        met = each.join(heads, "key").where("order <> head").select("cls", "head").distinct()
        one = left.select("cls", F.col("dim").alias("d"), F.col("code").alias("c"))
        other = left.select(F.col("order").alias("head"), F.col("cls").alias("lead"), "dim", "code")
        near = met.join(one, "cls").join(other, "head").where((F.col("d") == F.col("dim")) & may(F.col("c"), F.col("code"), theta)).select("cls", "lead")
        vectors = codes.select("cls", F.col("unit").alias("ua")), codes.select(F.col("cls").alias("lead"), F.col("unit").alias("ub"))
        led = store(cosines(near.join(vectors[0], "cls").join(vectors[1], "lead")).where(F.col("cos") >= threshold), "led")
        # Whoever is led by none leads for good.
        free = led.join(led.select(F.col("cls").alias("lead")).distinct(), "lead", "left_anti")
        new = free.groupBy("cls").agg(F.max(F.struct("cos", "lead")).alias("best")).select("cls", F.col("best.lead").alias("grp"), F.col("best.cos").alias("cos"))
        new = store(new, "gathered", n)
        if new.isEmpty():
            break
        taken = new if taken is None else taken.union(new)
        gone = new.select("cls").union(new.select("grp")).distinct()
        left = store(left.join(gone, "cls", "left_anti"), "left", n)
    own = codes.select("cls", F.col("cls").alias("grp"), F.lit(1.0).alias("cos"))
    return own if taken is None else taken.unionByName(own.join(taken.select("cls"), "cls", "left_anti"))


def close_groups(codes: DataFrame, members: DataFrame, groups: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, whole) of groups some of whose members share a key and that may hold links: whole if all of them are linked, by the angle of the
    leaders and the radii; else it is not known. Of two single classes it is known by the cosine."""
    theta = float(np.arccos(threshold))
    at = table_keys(codes.join(members.select("cls", "grp"), "cls"), width, "grp").distinct()
    shared = at.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    there = store(at.join(shared, "key").join(groups.select("grp", "dim", "code", "radius"), "grp"), "there")
    one, other = (there.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("grp", "dim", "code", "radius"))) for s in "ab")
    reach = F.lit(theta) + F.col("radius_a") + F.col("radius_b")
    met = one.join(other.hint("merge"), "key").where((F.col("grp_a") < F.col("grp_b")) & (F.col("dim_a") == F.col("dim_b")) & may(F.col("code_a"), F.col("code_b"), reach))
    pairs = met.select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b")).distinct()
    a = groups.select(F.col("grp").alias("a"), F.col("unit").alias("ua"), F.col("radius").alias("ra"), F.col("size").alias("na"))
    b = groups.select(F.col("grp").alias("b"), F.col("unit").alias("ub"), F.col("radius").alias("rb"), F.col("size").alias("nb"))
    told = cosines(pairs.join(a, "a").join(b, "b"))
    angle, single = F.acos(F.greatest(F.least(F.col("cos"), F.lit(1.0)), F.lit(-1.0))), (F.col("na") == 1) & (F.col("nb") == 1)
    whole = F.when(single, F.col("cos") >= threshold).otherwise(angle + F.col("ra") + F.col("rb") <= theta - EPS)
    none = F.when(single, F.col("cos") < threshold).otherwise(angle > theta + F.col("ra") + F.col("rb") + EPS)
    return told.where(~none).select("a", "b", whole.alias("whole"))


def blocks(rows: DataFrame, *by: str) -> DataFrame:
    """rows (by, cls, n, grp, unit, order) in blocks of about BLOCK_BYTES of vectors: by, part, block."""
    count = rows.groupBy(*by).agg(F.sum(F.length("unit")).alias("bytes")).select(*by, F.ceil(F.col("bytes") / BLOCK_BYTES).cast("long").alias("of"))
    dealt = rows.join(count, list(by)).withColumn("part", F.pmod("order", "of"))
    return dealt.groupBy(*by, "part").agg(F.collect_list(F.struct("cls", "n", "grp", "unit")).alias("block"))


def products(tasks: DataFrame, threshold: float) -> DataFrame:
    """tasks (x, y: blocks, y of one group; same: whether they are one) to a row for each class that has links in them: cls, others (the
    rows it is linked with on the other side), grp, and home, y's group."""
    arrow = to_arrow_schema(LINKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (pa.table(dict(zip(("cls", "n", "grp", "unit"), batch.column(c)[k].values.flatten(), strict=True))) for c in ("x", "y"))
                met = _matrix(x["unit"]) @ _matrix(y["unit"]).T >= threshold
                if same := batch.column("same")[k].as_py():
                    np.fill_diagonal(met, False)
                home = y["grp"][0].as_py()  # y is of one group; x may be of several
                for side, n in [(x, met @ y["n"].to_numpy())] + ([] if same else [(y, x["n"].to_numpy() @ met)]):
                    has = np.flatnonzero(n)
                    cols = side["cls"].to_numpy()[has], n[has].astype(np.int64), side["grp"].to_numpy()[has], np.full(len(has), home)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=arrow)

    return tasks.select("x", "y", "same").mapInArrow(run, LINKED)


LINKED = struct("cls long, others long, grp long, home long")


@tidy
def near_vectors(df: DataFrame, threshold: float = THRESHOLD, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """df (vec_id long, embedding array of numbers) to vec_id, n_links, component_id, kept; other columns are not read.

    One row for each row. Equal vectors are one class, known by its least vec_id; only classes are coded and compared, and a class's size
    stands for its members. Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a vec_id, link with
    nothing and are kept. Rows that repeat a vec_id with the same vector are links of each other like other copies. Vectors of different
    lengths are never linked, and those of each length are searched. An empty table gives none. threshold: over 0 and below 1."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = rows.where(usable("v") & F.col("vec_id").isNotNull())
    lone = rows.where(~(usable("v") & F.col("vec_id").isNotNull()))
    lone = lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = store(good.groupBy("v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n")), "classes")
    if not (n_classes := classes.count()):
        return lone
    # A vec_id may have several vectors: then its classes need names of their own.
    if classes.groupBy("cls").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
        classes = classes.withColumn("low", F.col("cls"))
    else:
        classes = store(classes.withColumnRenamed("cls", "low").withColumn("cls", F.monotonically_increasing_id()), "classes")
    width = key_bits(n_classes)
    codes = store(coded(classes, learn(classes, width, threshold, max_sample), width, threshold), "codes")
    members = store(gather(codes, n_classes, width, threshold).join(codes.select("cls", "n", "order"), "cls"), "members", n_classes)
    told = members.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("cos").alias("cos"))
    radius = F.when(F.col("size") == 1, F.lit(0.0)).otherwise(F.acos(F.least(F.col("cos"), F.lit(1.0))) + EPS)
    leaders = codes.select(F.col("cls").alias("grp"), "dim", "code", "unit")
    groups = store(told.withColumn("radius", radius).join(leaders, "grp"), "groups", n_classes)
    close = store(close_groups(codes, members, groups, width, threshold), "close")

    tight = 2 * F.col("radius") <= float(np.arccos(threshold)) - EPS  # all of such a group are linked
    weight = groups.select("grp", "weight", "size")
    whole = close.where("whole")
    beside = whole.select(F.col("a").alias("grp"), F.col("b").alias("to")).union(whole.select(F.col("b").alias("grp"), F.col("a").alias("to")))
    beside = beside.join(weight.select(F.col("grp").alias("to"), "weight"), "to").groupBy("grp").agg(F.sum("weight").alias("beside"))
    inside = groups.select("grp", F.when(tight, F.col("weight")).alias("inside"))
    # What is not known: within wide groups, and between groups; the smaller one's members are guests of the larger one.
    some = close.where("NOT whole")
    for side in "ab":
        some = some.join(weight.select(F.col("grp").alias(side), F.col("size").alias(f"n{side}")), side)
    swap = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    some = store(some.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("home"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("grp")), "some")
    wide = groups.where(~tight & (F.col("size") > 1)).select("grp")
    hosts = wide.union(some.select(F.col("home").alias("grp"))).distinct()
    vectors = members.select("cls", "n", "grp", "order").join(codes.select("cls", "unit"), "cls")
    home = store(blocks(vectors.join(hosts, "grp").withColumn("home", F.col("grp")), "home"), "blocks")
    guests = blocks(vectors.join(some, "grp"), "home").select("home", F.col("block").alias("x"))
    visits = guests.join(home.select("home", F.col("block").alias("y")), "home").select("x", "y", F.lit(False).alias("same"))
    own = home.join(wide.withColumnRenamed("grp", "home"), "home")
    mine = own.select("home", F.col("part").alias("p"), F.col("block").alias("x")).join(own.select("home", "part", F.col("block").alias("y")), "home")
    mine = mine.where("p <= part").select("x", "y", (F.col("p") == F.col("part")).alias("same"))
    linked = store(products(visits.union(mine), threshold), "linked")
    across = linked.where("grp <> home").select(F.col("grp").alias("src"), F.col("home").alias("dst"))
    comp = components(whole.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(across)).withColumnRenamed("id", "grp")

    counted = linked.groupBy("cls").agg(F.sum("others").alias("others"))
    by = members.select("cls", "grp", "n").join(inside, "grp").join(beside, "grp", "left").join(comp, "grp", "left").join(counted, "cls", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    links = zero("beside") + zero(F.col("inside") - F.col("n")) + zero("others") + F.col("n") - 1
    by = by.select("cls", links.alias("n_links"), F.coalesce("component", "grp").alias("label"))
    lows = classes.select("cls", "low").join(by.select("cls", "label"), "cls").groupBy("label").agg(F.min("low").alias("component_id"))
    by = classes.join(by, "cls").join(lows, "label").select("v", "n_links", "component_id")
    out = good.join(by, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return files_of(out.unionByName(lone), rows.count())


def op4_near_vectors(embeddings: DataFrame) -> DataFrame:
    """near_vectors with its defaults: the rows of embeddings whatever their labels, in the cases that near_vectors states."""
    return near_vectors(embeddings)


#: All pairs of vectors by their cosine, and the least vec_id that links lead to.
OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) n FROM l GROUP BY 1),
c AS (SELECT a, min(b) low FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT n_links, least(vec_id, coalesce(low, vec_id)) component_id, vec_id <= coalesce(low, vec_id) kept
FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a"""
