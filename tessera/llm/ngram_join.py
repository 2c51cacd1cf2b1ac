"""Exact self-join of documents by the Jaccard distance of their word shingles, as a metric-space join.

1. Documents with equal shingle sets are one point of the space; its smallest doc_id stands for it.
2. Nearly all points lie at distance 1 from each other, where the triangle inequality says nothing.  So the space is first
   cut by elements: two points within the radius share one of the first n - ceil(0.8 n) + 1 elements of their sets in any
   common order (frequent elements go last, else the order of hashes), and every point is placed in the region of each of
   these elements.  Each region takes its most central point as pivot; regions of one pivot are one region, in which every
   point is measured against the pivot.  Points within the radius are linked through it, so pairs inside that ball are
   never formed.  What is left of a region are its outside, the points not in the ball, and the window of the ball: the
   ball on one side and on the other the points up to twice the radius away.
3. These are joined recursively.  Pivots are chosen, every point goes to the Voronoi cell of its nearest pivot, and is
   copied as a guest to the cells of other pivots that are at most twice the radius farther from it, which by the triangle
   inequality is enough for every close pair to meet in the cell of one of its points.  Cells are cut again until they
   hold LEAF points, or until cutting stops making them smaller; then their pairs are compared.  Cells whose points are all
   linked already are finished.
4. Regions of more than TASK_POINTS points are cut by Spark, level by level, and those that cutting does not make smaller
   are joined block by block; all others are cut inside a task.

Distances between cells are those of sketches: counts of a set's elements in CLASSES hash classes.  2 |a - b| / (|a| + |b| +
|a - b|) of such counts is a metric, is never above the Jaccard distance, and needs no sets.  Pairs that it leaves are
measured exactly.  Links go between pivots and members or out of leaves; components are found by spreading smallest ids
with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import FEW_ROWS, HOT_KEYS, HOT_ROWS, SALTS, checkpointed, hot_keys, skew_join, staged, tasks_for
from tessera.llm.shingles import mixed, shingle_set

PERCENT = 80
#: Points of a leaf, of a block, and of a region that one task may cut; pivots of a cut, at most.
LEAF, BLOCK, TASK_POINTS, PIVOTS = 64, 512, 512, 64
#: A cut is given up where a cell keeps this share of the points.
STUCK = 0.9
#: A key counts as frequent from this many points on, and from 1 / FREQUENT_LIMIT of all keys on: at most
#: FREQUENT_LIMIT keys (8 MB) are frequent, however large the input.
FREQUENT, FREQUENT_LIMIT = 48, 1 << 20
#: Bits of the filter by which texts are picked for measuring; fixed, so what is broadcast is 8 MB at most.
FILTER_BITS = 1 << 26
#: Pairs to be measured that are broadcast at most.
FEW_ROLES = 1 << 20
CLASSES = 256


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(shingles: np.ndarray) -> bytes:
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=CLASSES)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _prefix(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The first elements of a set that any close set shares one of: in the order of hashes, frequent elements last."""
    p = prefix_length(len(s), percent) if len(s) else 0
    if len(often) and p:
        held = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
        if held[:p].any():
            s = np.concatenate([s[~held], s[held]])
    return _as_long(s[:p])


def _points(size: int, percent: int, frequent):
    """One row for each document: set size, a 128-bit name of its set, its first elements and its class counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        often = np.sort(frequent.value.view(np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ns, names, first, sketches = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, size)
                    ns.append(len(s))
                    names.append(xxhash.xxh3_128_digest(s.tobytes()))
                    first.append(_prefix(s, often, percent))
                    sketches.append(_sketch(s))
                both = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ns, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), prefix, pa.array(sketches, pa.binary())],
                    ["doc_id", "n", "s1", "s2", "prefix", "sketch"],
                )

    return run


POINTS = "doc_id long, n int, s1 long, s2 long, prefix array<long>, sketch binary"


def _local_counts(size: int, percent: int):
    """Prefix elements that occur more than once in this partition, with counts, and in a row without a key how many there are in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, none = [np.zeros(0, np.int64)], np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found += [_prefix(shingle_set(text, size), none, percent) for text in batch.slice(at, 1024).column(0).to_pylist()]
                found = [np.concatenate(found)]
        keys, counts = np.unique(found[0], return_counts=True)
        often = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(found[0])], pa.int64())], ["key", "n"])
        for at in range(0, int(often.sum()), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(keys[often][at : at + 65536]), pa.array(counts[often][at : at + 65536])], ["key", "n"])

    return run


def frequent_keys(docs: DataFrame, size: int, percent: int) -> tuple[np.ndarray, list[int]]:
    """Sorted frequent keys, and those of them that are hot (at most HOT_KEYS).

    Counts may fall short by one for each partition, which changes the order of elements and the way of rows only.
    """
    local = staged(docs.select("text").mapInArrow(_local_counts(size, percent), "key long, n long"))
    total = local.where("key is null").agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, total // FREQUENT_LIMIT + 1)
    found = local.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
    keys, n = (found.column(k).to_numpy().astype(np.int64) for k in range(2))
    return np.sort(keys), keys[n > max(HOT_ROWS, total // HOT_KEYS)].tolist()


def _sets(size: int, wanted):
    """Shingle sets of the documents that pass the filter, of each doc_id one in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            passed = np.flatnonzero(_holds(bits, _bit(ids, 0)) & _holds(bits, _bit(ids, 1)))
            passed = passed[np.unique(ids[passed], return_index=True)[1]]
            passed = passed[~np.isin(ids[passed], seen)]
            seen = np.union1d(seen, ids[passed])
            for at in range(0, len(passed), 512):
                part = batch.take(pa.array(passed[at : at + 512]))
                sets = [shingle_set(text, size).tobytes() for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "elements"])

    return run


def _bit(ids: np.ndarray, k: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(k * 0x51ED270B)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _holds(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        at = np.unique(np.concatenate([_bit(ids, 0), _bit(ids, 1)]))
        yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "bits"])


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A fixed-size Bloom filter of ids, FILTER_BITS bits in words of 32."""
    words = ids.mapInArrow(_bits_of, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    return out


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b).sum(axis=1, dtype=np.int64)


def _vectors(sketches: list[bytes], n: np.ndarray) -> np.ndarray:
    """Class counts, and as one more class the elements that the counts, which end at 255, leave out."""
    out = np.zeros((len(sketches), CLASSES + 1), dtype=np.int32)
    out[:, :CLASSES] = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, CLASSES)
    out[:, CLASSES] = n - out.sum(axis=1)
    return out


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower bounds of distances from class counts (columns p, rep, np, n, sketch_p, sketch)."""
    for batch in batches:
        np_, n = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
        apart = _gap(_vectors(batch.column(4).to_pylist(), np_), _vectors(batch.column(5).to_pylist(), n))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np_ + n), pa.array(apart)], ["p", "rep", "total", "apart"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact number of elements in only one of the two sets, for rows (p, member, doc_id, elements) sorted so that p's own set comes before its members."""
    at, own = None, None
    for batch in batches:
        p, member, ids, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        ps, reps, apart = [], [], []
        for k in range(batch.num_rows):
            elements = np.frombuffer(sets[k].as_buffer(), dtype=np.uint64)
            if not member[k]:
                at, own = p[k], elements.copy()
            elif p[k] == at:
                common = len(own) + len(elements) - len(np.union1d(own, elements))
                ps.append(at)
                reps.append(ids[k])
                apart.append(len(own) + len(elements) - 2 * common)
        yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(reps, pa.int64()), pa.array(apart, pa.int64())], ["p", "rep", "exact"])


def _close(apart: Column, total: Column, percent: int, times: int = 1) -> Column:
    """Whether the distance 2 * apart / (total + apart) is at most `times` radii, in whole numbers."""
    return 200 * apart <= times * (100 - percent) * (total + apart)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of edges (p, rep): smallest id reachable.

    Each round takes the smallest label among neighbours, then jumps to that label's label; the number of rounds grows
    with the logarithm of the longest chain.  Ids with very many neighbours, and labels of very many ids, are dealt over
    tasks.  Labels of up to FEW_ROWS edges are broadcast instead, and read by as few tasks as they need.
    """
    both = checkpointed(edges.select(F.col("p").alias("id"), F.col("rep").alias("to")).union(edges.select("rep", "p")).distinct())
    n = both.count()
    if n <= FEW_ROWS:
        return _few_components(both.coalesce(tasks_for(n)), tasks_for(n))
    labels = checkpointed(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component")))
    salts, hubs = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), hot_keys(both, ["to"])
    while True:
        near = skew_join(both, labels.withColumnRenamed("id", "to"), ["to"], hot=hubs).groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
        # Few ids are labels, so their rows can stand once for each salt.
        jump = labels.join(step.select(F.col("low").alias("id")).distinct(), "id").select(F.col("id").alias("low"), F.col("component").alias("jumped"), salts)
        new = checkpointed(step.join(jump, ["low", "salt"], "left").select("id", F.least("low", F.coalesce("jumped", "low")).alias("component"), F.col("component").alias("old")))
        changed = new.where(F.col("component") != F.col("old")).limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels


def _few_components(both: DataFrame, tasks: int) -> DataFrame:
    """The same rounds over edges (id, to) in both directions, with labels that are broadcast."""
    labels = checkpointed(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component")).coalesce(tasks))
    while True:
        near = both.join(F.broadcast(labels.withColumnRenamed("id", "to")), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = near.join(F.broadcast(labels), "id").select("id", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("jumped"))
        new = step.join(F.broadcast(jump), "low", "left").select("id", F.least("low", F.coalesce("jumped", "low")).alias("component"), F.col("component").alias("old"))
        new = checkpointed(new.coalesce(tasks))
        labels = new.select("id", "component")
        if new.where(F.col("component") != F.col("old")).isEmpty():
            return labels


def region_rows(points: DataFrame, hot: list[int]) -> DataFrame:
    """(key, rep, n, m, hot): the points of every region that has at least two, m being their number (about, where it is hot)."""
    spark = points.sparkSession
    reps = points.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"))
    chosen = points.where("n > 0").select("doc_id", "n", "prefix").join(reps, "doc_id", "left_semi")
    rows = chosen.select(F.col("doc_id").alias("rep"), "n", F.explode("prefix").alias("key"))
    # A window would bring a hot region into one task, so it is dealt over salts, each of which stands for its share.
    keys = F.broadcast(spark.createDataFrame([(k, True) for k in hot], "key long, hot boolean"))
    rows = rows.join(keys, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(0))
    m = F.count("*").over(Window.partitionBy("key", "salt")) * F.when(F.col("hot"), SALTS).otherwise(1)
    return staged(rows.withColumn("m", m).where("m > 1").select("key", "rep", "n", "m", "hot"))


def cells_of_pivots(regions: DataFrame) -> DataFrame:
    """(p, np, rep, n): each point once with the pivot of each of its regions.

    A point is central if its elements are shared by many, counting those that nobody shares: the original of a group of
    edited copies comes before its copies.  Regions that are not hot find their pivot where their points meet; hot ones,
    HOT_KEYS at most, have theirs broadcast.
    """
    central = F.sum("m").over(Window.partitionBy("rep")) / F.col("n")
    order = F.struct("central", (-F.col("rep")).alias("first"), F.col("rep").alias("p"), F.col("n").alias("np"))
    placed = regions.withColumn("central", central)
    cold = placed.where("not hot").withColumn("best", F.max(order).over(Window.partitionBy("key")))
    pivots = checkpointed(placed.where("hot").groupBy("key").agg(F.max(order).alias("best")))
    hot = placed.where("hot").join(F.broadcast(pivots), "key")
    both = cold.select("best.p", "best.np", "rep", "n").unionByName(hot.select("best.p", "best.np", "rep", "n"))
    return staged(both.where("rep <> p").distinct())


def _distances(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(p, rep, total, apart, known) of staged pairs (p, np, rep, n) whose sizes allow a link; p may have many partners.

    apart is exact where known, else a lower bound that already excludes a link.
    """
    spark = docs.sparkSession
    fit = pairs.where(100 * F.least("n", "np") >= percent * F.greatest("n", "np"))
    joined = skew_join(checkpointed(fit), sketches.select(F.col("doc_id").alias("p"), F.col("sketch").alias("sketch_p")), ["p"]).join(sketches.withColumnRenamed("doc_id", "rep"), "rep")
    bounded = staged(joined.select("p", "rep", "np", "n", "sketch_p", "sketch").mapInArrow(_bounds, "p long, rep long, total long, apart long"))
    near = checkpointed(bounded.where(_close(F.col("apart"), F.col("total"), percent)).select("p", "rep"))
    if near.isEmpty():
        return bounded.withColumn("known", F.lit(False))
    wanted = near.select(F.col("p").alias("doc_id")).union(near.select("rep")).distinct()
    bits = spark.sparkContext.broadcast(_filter_of(wanted))
    # Each set goes to the pivots that it is measured against, a pivot's own set too; the members of one with very many are
    # dealt over salts, and its set stands once for each.
    hot = spark.createDataFrame(hot_keys(near, ["p"]), "p long").withColumn("hot", F.lit(True))
    dealt = near.join(F.broadcast(hot), "p", "left")
    members = dealt.select(F.col("rep").alias("doc_id"), "p", F.lit(True).alias("member"), F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    owners = dealt.select("p", "hot").distinct().select(F.col("p").alias("doc_id"), "p", F.lit(False).alias("member"), F.explode(salts).alias("salt"))
    roles = checkpointed(members.unionByName(owners))
    sets = docs.where("doc_id is not null").mapInArrow(_sets(size, bits), "doc_id long, elements binary")
    # A table of up to FEW_ROLES rows (24 MB) goes to the sets; beyond that sets and roles meet by doc_id.
    few = roles.count() <= FEW_ROLES
    met = sets.join(F.broadcast(roles), "doc_id") if few else sets.dropDuplicates(["doc_id"]).join(roles, "doc_id")
    rows = met.repartition("p", "salt").sortWithinPartitions("p", "salt", "member")
    exact = rows.select("p", "member", "doc_id", "elements").mapInArrow(_measure, "p long, rep long, exact long")
    exact = exact.groupBy("p", "rep").agg(F.min("exact").alias("exact"))  # rows that share a doc_id
    out = bounded.join(exact, ["p", "rep"], "left")
    return staged(out.select("p", "rep", "total", F.coalesce("exact", "apart").alias("apart"), F.col("exact").isNotNull().alias("known")))


class Points:
    """Points of one region as arrays: sizes, labels, sides (-1: none), cores (others are guests) and class counts."""

    def __init__(self, n: np.ndarray, label: np.ndarray, side: np.ndarray, core: np.ndarray, sketches: list[bytes]) -> None:
        self.n, self.label, self.side, self.core = n.astype(np.int64), label, side, core.astype(bool)
        self.vectors = _vectors(sketches, self.n)
        self.coarse = self.vectors[:, :CLASSES].reshape(len(n), -1, 8).sum(axis=2)

    def distances(self, some: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        out = np.empty((len(some), len(pivots)))
        for k, q in enumerate(pivots):
            apart = _gap(self.vectors[some], self.vectors[q])
            out[:, k] = 2 * apart / np.maximum(self.n[some] + self.n[q] + apart, 1)
        return out

    def finished(self, some: np.ndarray) -> bool:
        """Whether no pair of these points needs to be looked at."""
        one_side = self.side[some[0]] >= 0 and (self.side[some] == self.side[some[0]]).all()
        return bool(one_side or (self.label[some] == self.label[some[0]]).all())

    def near(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (i, j) that bounds allow to be close and that are not linked."""
        n, within = self.n, lambda apart, i, j: 200 * apart <= (100 - percent) * (n[i] + n[j] + apart)
        fit = (self.label[i] != self.label[j]) & ((self.side[i] != self.side[j]) | (self.side[i] < 0)) & (self.core[i] | self.core[j])
        fit &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[fit], j[fit]
        for vectors in (self.coarse, self.vectors):
            fit = within(_gap(vectors[i], vectors[j]), i, j)
            i, j = i[fit], j[fit]
        return i, j

    def compared(self, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Close pairs of left and of left with right, some rows of left at a time."""
        both = np.concatenate([left, right])
        rows = max(1, 32768 // len(both))
        for at in range(0, len(left), rows):
            a, b = np.meshgrid(np.arange(at, min(at + rows, len(left))), np.arange(len(both)), indexing="ij")
            once = a < b
            yield self.near(both[a[once]], both[b[once]], percent)


def cut(points: Points, core: np.ndarray, guests: np.ndarray, pivots: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Core points and guests of the Voronoi cell of each pivot.

    A core point is a guest only in cells before its own; that is enough for a pair of core points to meet once.
    """
    d = points.distances(np.concatenate([core, guests]), pivots)
    nearest, window = d.argmin(axis=1)[: len(core)], d <= d.min(axis=1, keepdims=True) + 2 * (100 - percent) / 100 + 1e-9
    of_core, of_guests = window[: len(core)], window[len(core) :]
    return [(core[nearest == q], np.concatenate([core[(nearest > q) & of_core[:, q]], guests[of_guests[:, q]]])) for q in range(len(pivots))]


def close_pairs(points: Points, percent: int, leaf: int, depths: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that bounds allow to be close, by cells within cells; depths, if given, takes the depth of each leaf."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    todo = [(np.flatnonzero(points.core), np.flatnonzero(~points.core), 0)]
    while todo:
        core, guests, depth = todo.pop()
        if not len(core) or points.finished(np.concatenate([core, guests])):
            continue
        m = len(core) + len(guests)
        k = min(PIVOTS, len(core), max(8, m // leaf))
        cells = cut(points, core, guests, core[np.linspace(0, len(core) - 1, k).astype(int)], percent) if m > leaf else []
        if cells and max(len(c) + len(g) for c, g in cells) < STUCK * m:
            todo += [(c, g, depth + 1) for c, g in cells]
        else:
            found += points.compared(core, guests, percent)
            if depths is not None:
                depths.append(depth)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


CELL = "key string, rep long, n int, label long, side int, core boolean, sketch binary"
COUNTS = "key string, m long, low long, high long, one int, other int, any boolean"
COUNTED = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("m", "low", "high")), ("one", pa.int32()), ("other", pa.int32()), ("any", pa.bool_())])
PAIR = "p long, np int, rep long, n int"


def _points_of(table: pa.Table | pa.RecordBatch) -> Points:
    n, label, side, core = (table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in ("n", "label", "side", "core"))
    return Points(n, label, side, core, table.column("sketch").to_pylist())


def _pairs_of(table: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.Table:
    rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
    a, b = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
    return pa.table({"p": rep[a], "np": n[a], "rep": rep[b], "n": n[b]})


def _cut_regions(percent: int, leaf: int):
    """Close pairs of whole regions (CELL), which lie one behind the other in a partition sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def regions(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                part = table.slice(low, high - low)
                a, b = close_pairs(_points_of(part), percent, leaf)
                if len(a):
                    yield from _pairs_of(part, a, b).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            # What has the key of the last row may go on in the next batch.
            last = pa.compute.equal(batch.column("key"), batch.column("key")[-1]).to_numpy(zero_copy_only=False)
            tail = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
            if held and (tail or held[0].column("key")[0] != batch.column("key")[0]):
                whole = pa.Table.from_batches([*held, batch.slice(0, tail)] if tail else held)
                yield from regions(whole)
                held = []
            elif tail:
                yield from regions(pa.Table.from_batches([batch.slice(0, tail)]))
            held.append(batch.slice(tail))
        if held:
            yield from regions(pa.Table.from_batches(held))

    return run


def _cut_level(percent: int, counted: bool = False):
    """Rows of the next level from rows of CELL with the pivots of their region (sizes, sketches); counted: what COUNTS says of them instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").dictionary_encode()
            for at in range(len(keys.dictionary)):
                part = batch.filter(pa.compute.equal(keys.indices, at))
                sizes, sketches = part.column("sizes")[0].as_py(), part.column("sketches")[0].as_py()
                m, k = part.num_rows, len(sizes)
                points = Points(*(np.append(part.column(c).to_numpy(zero_copy_only=False), [fill] * k) for c, fill in (("n", 0), ("label", 0), ("side", -1), ("core", False))), part.column("sketch").to_pylist() + sketches)
                points.n[m:] = sizes
                points.vectors[m:] = _vectors(sketches, points.n[m:])
                core = np.flatnonzero(points.core[:m])
                for q, (own, guests) in enumerate(cut(points, core, np.flatnonzero(~points.core[:m]), np.arange(m, m + k), percent)):
                    rows = np.concatenate([own, guests])
                    if len(rows):
                        if counted:
                            label, side = points.label[rows].astype(np.int64), points.side[rows].astype(np.int32)
                            held = [len(rows), label.min(), label.max(), side.min(), side.max(), len(own) > 0]
                            yield pa.RecordBatch.from_pylist([{"key": f"{part.column('key')[0].as_py()}/{q}", **{c: x if isinstance(x, bool) else int(x) for c, x in zip(("m", "low", "high", "one", "other", "any"), held, strict=True)}}], COUNTED)
                            continue
                        cell = part.select(["key", "rep", "n", "label", "side", "core", "sketch"]).take(pa.array(rows))
                        key = pa.compute.binary_join_element_wise(cell.column("key"), f"{q}", "/")
                        kept = pa.array(np.arange(len(rows)) < len(own))
                        yield pa.RecordBatch.from_arrays([key, *(cell.column(c) for c in ("rep", "n", "label", "side")), kept, cell.column("sketch")], cell.schema.names)

    return run


def _sized(cells: DataFrame) -> DataFrame:
    """cells with m, the number of points of their region, without the regions that are finished."""
    info = cells.select("key", F.lit(1).cast("long").alias("m"), F.col("label").alias("low"), F.col("label").alias("high"), F.col("side").alias("one"), F.col("side").alias("other"), F.col("core").alias("any"))
    return staged(skew_join(cells, checkpointed(_unfinished(info)), ["key"], narrow=True))


def _unfinished(info: DataFrame) -> DataFrame:
    """key and m of the regions of which there is something left to look at, from COUNTS of their parts."""
    sums = info.groupBy("key").agg(F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("one").alias("one"), F.max("other").alias("other"), F.max("any").alias("any"))
    return sums.where("low < high and any and (one < 0 or one < other)").select("key", "m")


def recursive_join(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs (PAIR) that bounds allow to be close, of regions (CELL) of any size."""
    found, level, levels = [], _sized(cells), 0
    while True:
        large = level.where(F.col("m") > TASK_POINTS)
        inside = level.where(F.col("m") <= TASK_POINTS).drop("m").repartition("key").sortWithinPartitions("key")
        found.append(staged(inside.mapInArrow(_cut_regions(percent, LEAF), PAIR)))
        if large.isEmpty():
            break
        large = staged(large)
        # The smallest hash of each of PIVOTS classes of core points; no region is collected.
        place = F.xxhash64("rep", F.lit(levels))
        best = large.where("core").groupBy("key", "m", F.pmod(place, F.lit(PIVOTS)).alias("class")).agg(F.min(F.struct(place.alias("place"), "n", "sketch")).alias("best"))
        pivots = best.groupBy("key").agg(F.sort_array(F.collect_list("best")).alias("best"))
        pivots = pivots.select("key", F.col("best.n").alias("sizes"), F.col("best.sketch").alias("sketches"))
        pivots = staged(pivots)
        before = large.groupBy("key").agg(F.max("m").alias("before"))
        # Cells are counted before they are made: one of a stuck region may hold all its points, and there are PIVOTS of them.
        counts = skew_join(large.drop("m"), pivots, ["key"]).mapInArrow(_cut_level(percent, counted=True), COUNTS)
        cells = checkpointed(_unfinished(counts).withColumn("parent", F.regexp_extract("key", "^(.*)/", 1)))
        # A region that keeps a cell of nearly its own size is stuck; its points are joined in blocks instead.
        kept = cells.groupBy("parent").agg(F.max("m").alias("largest")).join(before.withColumnRenamed("key", "parent"), "parent")
        stuck = checkpointed(kept.where(F.col("largest") >= STUCK * F.col("before")).select(F.col("parent").alias("key")))
        found.append(_block_pairs(skew_join(large, stuck, ["key"], narrow=True), percent))
        going = checkpointed(cells.join(stuck.withColumnRenamed("key", "parent"), "parent", "left_anti").select("key", "m", "parent"))
        parents = checkpointed(going.select(F.col("parent").alias("key")).distinct())
        cut_rows = skew_join(skew_join(large.drop("m"), parents, ["key"], narrow=True), pivots, ["key"]).mapInArrow(_cut_level(percent), CELL)
        level = staged(skew_join(staged(cut_rows), going.drop("parent"), ["key"], narrow=True))
        levels += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _near_in_blocks(percent: int):
    """Pairs of one block pair (rows of CELL with block, lo, hi) whose bounds allow a link."""

    def run(table: pa.Table) -> pa.Table:
        points, block = _points_of(table), table.column("block").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        if lo == hi:
            found = list(points.compared(left, left[:0], percent))
        else:
            found = [points.near(np.repeat(left[at : at + 8], len(right)), np.tile(right, len(left[at : at + 8])), percent) for at in range(0, len(left), 8)]
        empty = np.zeros(0, np.int64)
        return _pairs_of(table, np.concatenate([empty, *(a for a, _ in found)]), np.concatenate([empty, *(b for _, b in found)]))

    return run


def _block_pairs(regions: DataFrame, percent: int) -> DataFrame:
    """Close pairs of regions (CELL and m) of any size, from tasks of two blocks each."""
    blocks = F.floor((F.col("m") + BLOCK - 1) / BLOCK)
    rows = regions.withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).drop("with", "m")
    return rows.groupBy("key", "lo", "hi").applyInArrow(_near_in_blocks(percent), PAIR)


def _remaining(pairs: DataFrame, measured: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """What the pivots leave, as regions (CELL): the outside of each pivot, and the window of its ball."""
    # A pair that was not measured, its sizes being too far apart, is bounded by its sizes.
    met = pairs.join(measured, ["p", "rep"], "left").withColumn("total", F.coalesce("total", F.col("n") + F.col("np"))).withColumn("apart", F.coalesce("apart", F.abs(F.col("n") - F.col("np"))))
    met = met.withColumn("ball", F.coalesce(F.col("known") & _close(F.col("apart"), F.col("total"), percent), F.lit(False)))
    named = labels.select(F.col("id").alias("rep"), F.col("component").alias("new"))
    met = staged(met.join(named, "rep", "left").select("p", "rep", "n", F.coalesce("new", "rep").alias("label"), "ball", (F.col("ball") | _close(F.col("apart"), F.col("total"), percent, 2)).alias("window")))
    outside = met.where("not ball").select(F.concat("p", F.lit("o")).alias("key"), "rep", "n", "label", F.lit(-1).alias("side"))
    window = met.where("window").select(F.concat("p", F.lit("w")).alias("key"), "rep", "n", "label", F.when(F.col("ball"), 0).otherwise(1).alias("side"))
    cells = _sized(staged(outside.unionByName(window).withColumn("core", F.lit(True)))).drop("m")
    return staged(cells.join(sketches.withColumnRenamed("doc_id", "rep"), "rep").select("key", "rep", "n", "label", "side", "core", "sketch"))


def ngram_jaccard_join(docs: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    Two documents are linked when their sets of shingles have a Jaccard similarity of percent / 100 or more; component_id
    is the smallest doc_id reachable.  Null or wordless texts have an empty set and are linked with nothing.  Rows without
    a doc_id keep null there; with the same set as others they take their component.  Rows that share a doc_id should hold
    one text.  Other columns are not read; an empty table gives an empty table.  Elements are 64-bit hashes of shingles.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent, hot = frequent_keys(docs, size, percent)
    points = staged(docs.mapInArrow(_points(size, percent, docs.sparkSession.sparkContext.broadcast(frequent)), POINTS))
    sketches = points.where("doc_id is not null").select("doc_id", "sketch").dropDuplicates(["doc_id"])
    pairs = cells_of_pivots(region_rows(points, hot))
    measured = _distances(pairs, sketches, docs, size, percent)
    linked = F.col("known") & _close(F.col("apart"), F.col("total"), percent)
    labels = components(measured.where(linked).select("p", "rep"))
    more = checkpointed(recursive_join(_remaining(pairs, measured, labels, sketches, percent), percent))
    more = _distances(more, sketches, docs, size, percent)
    labels = components(measured.unionByName(more).where(linked).select("p", "rep"))
    sets = staged(points.where("n > 0").select("doc_id", "n", "s1", "s2"))
    classes = sets.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    named = staged(classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")))
    out = skew_join(sets, named, ["s1", "s2"], "left", narrow=True).select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    bare = points.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(bare).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
