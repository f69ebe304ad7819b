"""Operator 4: near-duplicate vectors by a forest of random-projection trees.

Each of `TREES` trees splits the vectors by the median projection on a random direction, again and again, until a leaf
holds few; vectors near a split go to both sides (spill). Splits are fitted on a bounded sample of each node (`SAMPLE`
expected rows by hash), every vector then descends them. A round refines all nodes that are still too large, several
levels at once; its trees are broadcast while they are small (`SPREAD`), and else meet their vectors in a shuffle. A
node stays whole if a split sends too many vectors to both sides (`STALL`), or if the splits above it have made too many
copies already (`COPIES`), as in a tight group of distinct vectors. Within a leaf all vectors are compared exactly, in
double precision, so no link below the threshold is returned; recall depends on the forest (tests measure it). A leaf of
more than `ROWS` vectors is cut into blocks, and each pair of blocks is a group of its own. A pair that shares several
leaves counts in the smallest of their numbers only, so leaves give sums of links and connecting edges, never lists of
all pairs. A vector carries the list of its leaves and is sent once to each of them.

Equal vectors are one class from the start, known by a number given to it when the table of classes is written. Vectors
that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different lengths are
not compared. Rows with equal ids count as vectors of their own, each with the links and the component of its own vector;
rows without an id link with nothing. An empty table gives an empty result; columns other than the key and the vector are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlake.llm.common import components, drop, read, table

TREES, LEAF, SAMPLE = 5, 512, 4096
#: Levels that one round fits; each either splits a node into clearly smaller ones or leaves it whole for good.
LEVELS = 7
#: The most that both sides of a split may hold, as a multiple of the node, and the most copies along a path of splits.
STALL, COPIES = 1.4, 8.0
#: Sampled vectors of a node that suffice to leave it whole for good; with fewer, the next round samples it again.
SURE = 256
#: Half the width of the spilling zone, as a share of a threshold pair's deviation along a random direction.
SPILL = 0.3
#: Numbers in the trees of a round that are broadcast (8 bytes each).
SPREAD = 4 << 20
#: Rows of a block of the comparison within a leaf.
BLOCK = 512
#: Most vectors of a leaf that one task compares, and of each of two blocks of a larger leaf.
ROWS, CUT = 4096, 1024


def _scaled(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors in double precision, divided by powers of two (which is exact), so that huge or tiny ones don't overflow when squared."""
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of length one."""
    x = _scaled(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of all pairs; one division, so that exact ties stay ties."""
    return x @ y.T / np.sqrt(np.multiply.outer(np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values of a column of lists of numbers."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()


def _grow(x: np.ndarray, levels: int, margin: float, r: np.random.Generator, grown: float, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, thresholds, copies of each leaf) of a complete tree in heap order, fitted on x, which is a whole node or a sample.

    A node that stays whole has infinite thresholds, which send all to the left; its copies are infinite if that is for good.
    """
    n = (1 << levels) - 1
    directions = r.normal(size=(n, x.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    thresholds, held, copies = np.zeros(n), {0: np.arange(len(x))}, np.full(2 * n + 1, grown)
    for k in range(n):
        at = held.get(k, np.zeros(0, np.int64))
        copies[[2 * k + 1, 2 * k + 2]] = copies[k]
        if not len(at):
            continue
        if k and np.isinf(thresholds[(k - 1) // 2]):
            thresholds[k], held[2 * k + 1] = np.inf, at
            continue
        p = x[at] @ directions[k]
        thresholds[k] = np.median(p)
        low, high = at[p <= thresholds[k] + margin], at[p >= thresholds[k] - margin]
        growth = (len(low) + len(high)) / len(at)
        if growth > STALL or copies[k] * growth > COPIES:
            thresholds[k], held[2 * k + 1] = np.inf, at
            if whole or len(at) >= SURE:
                copies[2 * k + 1] = np.inf
            continue
        held[2 * k + 1], held[2 * k + 2] = low, high
        copies[[2 * k + 1, 2 * k + 2]] = copies[k] * max(1.0, growth)
    return directions, thresholds, copies[n:]


def _large(placed: DataFrame, least: int) -> DataFrame:
    """(node, dim, count, grown) of nodes above that many vectors that may still be split."""
    nodes = placed.select("dim", F.inline("leaves")).groupBy("node", "dim").agg(F.count("*").alias("count"), F.max("grown").alias("grown"))
    return nodes.where((F.col("count") > least) & (F.col("grown") <= COPIES))


def _fit(placed: DataFrame, large: DataFrame, margin: float, turn: int) -> DataFrame:
    """(node, dim, directions, thresholds, copies): a tree for each large node, fitted on a sample of it."""
    within = F.pmod(F.xxhash64("vec", "node"), F.lit(1 << 30)) / (1 << 30) < SAMPLE / F.col("count")
    picked = placed.select("dim", "vec", F.inline("leaves")).drop("grown").join(large, ["node", "dim"]).where(within)

    def fit(keys: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        x = _vectors(group.column("vec"))
        levels = max(1, min(LEVELS, math.ceil(math.log2(group.column("count")[0].as_py() / LEAF)), int(math.log2(max(2, len(x) / 16)))))
        r = np.random.default_rng(zlib.crc32(f"{keys[0]}:{turn}".encode()))
        by = np.lexsort(x.T[::-1])  # whatever order the rows came in
        whole = group.column("count")[0].as_py() <= len(x)
        directions, thresholds, copies = _grow(x[by], levels, margin / math.sqrt(x.shape[1]), r, group.column("grown")[0].as_py(), whole)
        lists = {"directions": directions.ravel(), "thresholds": thresholds, "copies": copies}
        return pa.table({"node": [keys[0].as_py()], "dim": [keys[1].as_py()]} | {k: [v.tolist()] for k, v in lists.items()}, schema=pa.schema([("node", pa.int64()), ("dim", pa.int32()), *((k, pa.list_(pa.float64())) for k in lists)]))

    return picked.select("node", "dim", "vec", "count", "grown").groupBy("node", "dim").applyInArrow(fit, "node long, dim int, directions array<double>, thresholds array<double>, copies array<double>")


def _leaves(x: np.ndarray, node: int, tree: tuple[np.ndarray, np.ndarray, np.ndarray], margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, copies) of every leaf of a node's tree that a row of x comes to."""
    w, t, copies = tree
    w, near = w.reshape(len(t), -1), margin / math.sqrt(x.shape[1])
    row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(int(math.log2(len(t) + 1))):
        p = np.einsum("ij,ij->i", x[row], w[at]) - t[at]
        low, high = p <= near, p >= -near
        row, at = np.concatenate([row[low], row[high]]), np.concatenate([2 * at[low] + 1, 2 * at[high] + 2])
    return row, node * (2 << LEVELS) + at + 1, copies[at - len(t)]


def _descend(placed: DataFrame, trees: DataFrame, margin: float) -> DataFrame:
    """placed, with each large node in the lists replaced by the leaves of its tree."""
    size = trees.agg(F.coalesce(F.sum(F.size("directions")), F.lit(0))).first()[0]
    if size > SPREAD:
        return _descend_by_shuffle(placed, trees, margin)
    each = {(r["node"], r["dim"]): tuple(np.array(r[k]) for k in ("directions", "thresholds", "copies")) for r in trees.toLocalIterator()}
    shared = placed.sparkSession.sparkContext.broadcast(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = pa.Table.from_batches([b.filter(pa.array(dims == dim))])
                x, lists = _vectors(part.column("vec")), part.column("leaves").combine_chunks()
                lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
                row = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
                node, grown = (lists.flatten().field(k).to_numpy() for k in (0, 1))
                found = []
                for n in np.unique(node).tolist():
                    mine = np.flatnonzero(node == n)
                    if (n, dim) in shared.value:
                        r, leaf, copies = _leaves(x[row[mine]], n, shared.value[n, dim], margin)
                        found.append((row[mine][r], leaf, copies))
                    else:
                        found.append((row[mine], node[mine], grown[mine]))
                row, node, grown = (np.concatenate(c) for c in zip(*found, strict=True))
                by = np.lexsort((node, row))
                sizes = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x))))).astype(np.int32)
                new = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([pa.array(node[by]), pa.array(grown[by])], ["node", "grown"]))
                yield pa.RecordBatch.from_arrays([part.column(k).combine_chunks() for k in ("rep", "dim", "m", "vec")] + [new], ["rep", "dim", "m", "vec", "leaves"])

    return placed.mapInArrow(run, placed.schema)


def _descend_by_shuffle(placed: DataFrame, trees: DataFrame, margin: float) -> DataFrame:
    """As _descend; a large node is dealt over salts, each with its tree."""

    def run(keys: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        node, grown = left.column("node").to_numpy(), left.column("grown").to_numpy()
        row = np.arange(len(node))
        if left.num_rows and right.num_rows:
            tree = tuple(np.array(right.column(k)[0].as_py()) for k in ("directions", "thresholds", "copies"))
            row, node, grown = _leaves(_vectors(left.column("vec")), keys[0].as_py(), tree, margin)
        return pa.table({"rep": left.column("rep").to_numpy()[row], "node": node, "grown": grown}, schema=pa.schema([("rep", pa.int64()), ("node", pa.int64()), ("grown", pa.float64())]))

    salted = placed.select("rep", "dim", "vec", F.inline("leaves")).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(64)).cast("int"))
    many = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    found = salted.groupBy("node", "dim", "salt").cogroup(many.groupBy("node", "dim", "salt")).applyInArrow(run, "rep long, node long, grown double")
    lists = found.groupBy("rep").agg(F.collect_list(F.struct("node", "grown")).alias("leaves"))  # some for each tree
    return placed.drop("leaves").join(lists, "rep").select(placed.columns)


def _labels(near, n: int, rows: int) -> np.ndarray:
    """The smallest position that links reach from each position; near(i) gives the links of the block at i."""
    label = np.arange(n)
    while True:
        new = label.copy()
        for i in range(0, n, rows):
            new[i : i + rows] = np.minimum(label[i : i + rows], np.where(near(i), label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(least: float):
    def compare(keys: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        leaf, group = keys[0].as_py(), group.sort_by("rep")
        x, near = _scaled(group.column("vec")), np.zeros((group.num_rows, group.num_rows), bool)
        for i in range(0, len(x), BLOCK):
            near[i : i + BLOCK] = _cosines(x[i : i + BLOCK], x) >= least
        np.fill_diagonal(near, False)
        linked = np.flatnonzero(near.any(axis=1))
        if not len(linked):
            return schema.empty_table()
        near, n = near[np.ix_(linked, linked)], len(linked)
        rep, m = (group.column(k).to_numpy()[linked] for k in ("rep", "m"))
        # pairs that share a leaf before this one have been counted there
        row, value = _lists(group.column("leaves").take(pa.array(linked)))
        row, value = row[value < leaf], value[value < leaf]
        _, at, times = np.unique(value, return_inverse=True, return_counts=True)
        row, (_, at) = row[times[at] > 1], np.unique(at[times[at] > 1], return_inverse=True)
        member = np.zeros((n, int(at.max(initial=-1)) + 1), np.float32)
        member[row, at] = 1
        links = np.zeros(n, np.int64)
        for i in range(0, n, BLOCK):
            links[i : i + BLOCK] = (near[i : i + BLOCK] & (member[i : i + BLOCK] @ member.T < 0.5)) @ m
        label = _labels(lambda i: near[i : i + BLOCK], n, BLOCK)
        some = (links > 0) | (label != np.arange(n))
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[label][some]}, schema=schema)

    return compare


def _between(least: float):
    def between(keys: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Two blocks of a leaf, or one with itself."""
        leaf, group = keys[0].as_py(), group.sort_by([("side", "ascending"), ("rep", "ascending")])
        side, m = group.column("side").to_numpy(), group.column("m").to_numpy().astype(np.float64)
        x, n = _scaled(group.column("vec")), int((side == 0).sum())
        alone = n == len(x)
        right = slice(0, n) if alone else slice(n, len(x))
        row, value = _lists(group.column("leaves"))
        ids = np.intersect1d(value[(row < n) & (value < leaf)], value[(row >= right.start) & (value < leaf)])
        both = np.isin(value, ids)
        member = np.zeros((len(x), len(ids)), np.float32)
        member[row[both], np.searchsorted(ids, value[both])] = 1
        links, label, near = np.zeros(len(x)), np.arange(len(x)), np.zeros((n, right.stop - right.start), bool)
        for i in range(0, n, BLOCK):
            rows = slice(i, min(n, i + BLOCK))
            near[rows] = _cosines(x[rows], x[right]) >= least
            if alone:
                near[np.arange(i, rows.stop), np.arange(i, rows.stop)] = False
            new = near[rows] & (member[rows] @ member[right].T < 0.5) if len(ids) else near[rows]
            links[rows] += new @ m[right]
            if not alone:
                links[right] += m[rows] @ new
        while True:  # the smallest position that links reach
            new = label.copy()
            for i in range(0, n, BLOCK):
                rows, some = slice(i, min(n, i + BLOCK)), near[i : i + BLOCK]
                new[rows] = np.minimum(new[rows], np.where(some, new[right][None, :], len(x)).min(axis=1, initial=len(x)))
                new[right] = np.minimum(new[right], np.where(some, new[rows][:, None], len(x)).min(axis=0))
            new = new[new]
            if (new == label).all():
                break
            label = new
        rep = group.column("rep").to_numpy()
        some = (links > 0) | (label != np.arange(len(x)))
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[label][some]}, schema=pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    return between


def _blocked(rows: DataFrame, least: float) -> DataFrame:
    """(rep, links, root) of leaves too large for one task: a group for each pair of blocks.

    A block holds vectors of one pool: those of the same smallest leaf, if they are many, or the rest. Pairs within a pool
    of another leaf than this one have been counted there.
    """
    rows = table(rows.withColumn("first", F.array_min("leaves")), "large")
    many = rows.groupBy("node", "dim", "first").count().where(F.col("count") >= ROWS).select("node", "dim", "first", F.col("first").alias("pool"))
    rows = rows.join(F.broadcast(many), ["node", "dim", "first"], "left").withColumn("pool", F.coalesce("pool", F.lit(-1).cast("long")))
    pools = table(rows.groupBy("node", "dim", "pool").agg(F.ceil(F.count("*") / CUT).cast("int").alias("cut")), "pools")
    cells = pools.select("node", "dim", "pool", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("salt")).withColumn("cell", F.struct("pool", "salt"))
    a, b = (cells.select("node", "dim", F.col("cell").alias(x)) for x in "ab")
    pairs = a.join(b, ["node", "dim"]).where("a <= b and (a.pool != b.pool or a.pool in (-1, node))")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("cell")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("cell")), F.struct(F.lit(1).alias("side"), F.col("b").alias("cell"))))
    sides = pairs.select("node", "dim", "a", "b", F.inline(sides)).select("node", "dim", F.xxhash64("a", "b").alias("pair"), "side", F.col("cell.pool").alias("pool"), F.col("cell.salt").alias("salt"))
    cut = rows.join(F.broadcast(pools), ["node", "dim", "pool"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int"))
    return cut.join(sides, ["node", "dim", "pool", "salt"]).select("rep", "m", "dim", "node", "vec", "leaves", "pair", "side").groupBy("node", "dim", "pair").applyInArrow(_between(least), "rep long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id) of every row."""
    kind = vectors.schema[vector].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    ok = F.expr("size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x != 0)")
    rows = vectors.select(F.col(key).alias("id"), (F.col(vector) if plain else F.col(vector).cast("array<double>")).alias("vec"))
    rows = rows.withColumn("ok", F.coalesce(ok & F.col("id").isNotNull(), F.lit(False)))
    same = F.xxhash64("vec")
    classes = rows.where("ok").groupBy(same.alias("h"), "vec").agg(F.min("id").alias("least"), F.count("*").alias("m"))
    # the number holds once the table is written
    classes = table(classes.select(F.monotonically_increasing_id().alias("rep"), F.size("vec").alias("dim"), "m", "vec", "h", "least"), "classes")
    roots = F.transform(F.sequence(F.lit(1), F.lit(TREES)), lambda k: F.struct(k.cast("long").alias("node"), F.lit(1.0).alias("grown")))
    placed, margin, turn = classes.select("rep", "dim", "m", "vec", roots.alias("leaves")), SPILL * math.sqrt(max(0.0, 2 - 2 * least)), 0
    while True:
        large = table(_large(placed, LEAF * (1 if not turn else 4)), "large")
        if large.isEmpty():
            break
        trees = table(_fit(placed, large, margin, turn), "trees")
        before, placed, turn = placed, table(_descend(placed, trees, margin), "placed"), turn + 1
        drop(before, large, trees)
    members = placed.withColumn("leaves", F.col("leaves.node")).select("rep", "dim", "m", "vec", "leaves", F.explode("leaves").alias("node"))
    large = table(placed.select("dim", F.inline("leaves")).groupBy("node", "dim").count().where(F.col("count") > ROWS).select("node", "dim"), "sizes")
    found = members.join(large, ["node", "dim"], "left_anti") if not (none := large.isEmpty()) else members
    found = table(found.groupBy("node", "dim").applyInArrow(_compare(least), "rep long, links long, root long"), "found")
    if not none:
        found = found.union(table(_blocked(members.join(large, ["node", "dim"], "left_semi"), least), "found"))
    drop(placed)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = table(components(classes.select(F.col("rep").alias("id")), found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors-cc"), "comp").toDF("rep", "root")
    of_class = classes.select("rep", "m", "h", "vec", "least").join(links, "rep", "left").join(comp, "rep")
    named = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(named, "root").select("h", "vec", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("ok").withColumn("h", same).join(of_class, ["h", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links with a cosine of 0.9 or more, its component and whether it is kept."""
    out = near_vectors(read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


#: Every link by brute force; the components by the smallest reachable id.
SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id != b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
