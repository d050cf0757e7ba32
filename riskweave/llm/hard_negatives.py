"""Hard negatives by a GNAT-style multiway hyperplane tree (operator 11).

For each anchor the ``positives`` best other rows of its label are its positives; for each of them, the ``negatives``
best rows of other labels whose score lies in a window of the positive's score are its hard negatives. A score is the
integer inner product; ties go to the smaller id.

The tree
    Inner products become distances by one more component: sqrt(M - |x|^2) for rows (M: largest squared length), 0 for
    anchors, so |a - x|^2 = |a|^2 + M - 2 a.x. A window of scores is an annulus around the anchor.
    The split points are fitted on a bounded sample (``SAMPLE`` rows): ``FANOUT`` far-apart rows a node, every row to
    the nearest (a multiway hyperplane split), until a leaf has about ``LEAF`` rows or the sample runs out. Then *every*
    row is sent down the tree, and each node keeps, for each split point and each sibling subtree, the smallest and the
    largest distance from the point to the subtree's rows (partial sums in tasks; the tables grow with the tree only).

A search
    An anchor goes down the tree with its annulus. A sibling subtree is eliminated if, for any split point, its range of
    distances can't meet the annulus: range and [d - outer, d + outer] have no common part, or all of the range lies
    inside the annulus' hole. What the sample itself holds gives each search a first k-th best score, which narrows the
    annulus. Leaves are exact: all integer products are computed, in steps of bounded size, narrowing on the way.

On Spark
    Rows lie by (leaf, block), where a leaf is cut into blocks of about ``BLOCK`` rows by hash, so one common vector or
    one crowded leaf is many groups. Anchors are cut into chunks of about ``CHUNK`` by hash. Rows are given once per
    chunk, anchors once per block of a leaf that they reach; a task reads a group's rows, then its anchors in batches,
    and returns the best few per anchor. Nothing that grows with the table is broadcast or collected, and no group is
    larger than a block and a chunk. First all positives are searched, then all negatives.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part, nor do
vectors of another length than the most frequent one (the longer of equals). Of rows with one id only the one with the
smallest (vector, label) takes part, so repeats count once. Equal vectors are rows like any others. An anchor without
positives, or a positive without a row in its window, gives no rows; so does an empty table. Scores must stay below
2**56. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.tables import share_package
from riskweave.session import reliable_checkpoint

SAMPLE = 8_192
FANOUT = 16
LEAF = 1_024
BLOCK = 65_536
CHUNK = 262_144
STEP = 2_048  # rows, and
AT_ONCE = 256  # anchors, that one step multiplies
SLACK = 1e-6
NONE = -(1 << 62)


def quantized(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """id, label, q (array of long: floor(256 x), x as double) of the rows that take part, one row an id."""
    x = F.col(embedding)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0)).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.when(F.forall(x, lambda v: fine(v.cast("double"))), F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long"))).alias("q"),
    )
    one = rows.filter("q is not null").groupBy("id").agg(F.min(F.struct("q", "label")).alias("r"))
    return one.select("id", "r.label", "r.q")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: in doubles where every partial sum is a whole number below 2**53."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def best_of(search: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each search: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, search))
    s = search[order]
    head = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(head, np.diff(np.append(head, len(s))))
    return order[rank < k]


# -- the tree ---------------------------------------------------------------------------------------------------


@dataclass
class Node:
    points: np.ndarray  # split points, with the added component
    children: list  # Node or number of a leaf
    number: int
    low: np.ndarray = field(default=None)  # [i, j]: distances from split point i to rows of child j
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    root: Node | int
    leaves: int
    nodes: list[Node]
    most: float  # largest squared length

    @property
    def slack(self) -> float:
        return SLACK * (1 + np.sqrt(self.most))


def lifted(q: np.ndarray, most: float) -> np.ndarray:
    """Rows with the added component."""
    x = q.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x**2).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k different rows, each the farthest from those before it."""
    chosen, near = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < k:
        far = int(near.argmax())
        if near[far] <= 1e-3:
            break
        chosen.append(far)
        near = np.minimum(near, distances(x, x[far : far + 1])[:, 0])
    return np.array(chosen)


def fit_tree(sample: np.ndarray, rows: int, most: float, fanout: int = FANOUT, leaf: int = LEAF) -> Tree:
    """Split points for ``rows`` rows from a sample of them."""
    tree = Tree(0, 0, [], most)
    share = rows / max(1, len(sample))

    def grow(x: np.ndarray):
        chosen = _far_apart(x, fanout) if len(x) * share > leaf and len(x) >= 2 * fanout else np.zeros(1, np.int64)
        if len(chosen) < 2:
            tree.leaves += 1
            return tree.leaves - 1
        node = Node(x[chosen], [], len(tree.nodes))
        tree.nodes.append(node)
        near = distances(x, node.points).argmin(axis=1)
        node.children = [grow(x[near == j]) for j in range(len(chosen))]
        return node

    tree.root = grow(lifted(sample, most))
    return tree


def place_rows(tree: Tree, q: np.ndarray, ranges: dict | None = None) -> np.ndarray:
    """Leaf of every row; ``ranges`` (node number: (low, high)) learns the distances met."""
    x = lifted(q, tree.most)
    leaf = np.zeros(len(x), np.int64)

    def down(node, rows: np.ndarray) -> None:
        if not isinstance(node, Node):
            leaf[rows] = node
            return
        d = distances(x[rows], node.points)
        near = d.argmin(axis=1)
        k = len(node.children)
        if ranges is not None and node.number not in ranges:
            ranges[node.number] = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for j in range(k):
            mine = near == j
            if not mine.any():
                continue
            if ranges is not None:
                low, high = ranges[node.number]
                low[:, j] = np.minimum(low[:, j], d[mine].min(axis=0))
                high[:, j] = np.maximum(high[:, j], d[mine].max(axis=0))
            down(node.children[j], rows[mine])

    if len(x):
        down(tree.root, np.arange(len(x)))
    return leaf


def reached_leaves(tree: Tree, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(search, leaf) of the leaves that may hold rows with low <= score <= high."""
    a = np.column_stack([q.astype(float), np.zeros(len(q))])
    base = (a**2).sum(axis=1) + tree.most
    inner = np.sqrt(np.maximum(0, base - 2 * high.astype(float))) - tree.slack
    outer = np.sqrt(np.maximum(0, base - 2 * low.astype(float))) + tree.slack
    outer[base < 2 * low.astype(float) - 2 * tree.slack * np.sqrt(tree.most + 1)] = -1  # no row scores so high
    found = []

    def down(node, some: np.ndarray) -> None:
        if not len(some):
            return
        if not isinstance(node, Node):
            found.append((some, np.full(len(some), node)))
            return
        d = distances(a[some], node.points)
        out, hole = outer[some][:, None], inner[some][:, None]
        for j, child in enumerate(node.children):
            lo, hi = node.low[:, j][None, :], node.high[:, j][None, :]
            gone = (lo > d + out) | (hi < d - out) | (d + hi < hole)
            down(child, some[~gone.any(axis=1)])

    down(tree.root, np.flatnonzero((outer >= 0) & (low <= high)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# -- exact scores of a group ------------------------------------------------------------------------------------


def search_rows(
    ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, anchor: np.ndarray, label: np.ndarray, q: np.ndarray,
    of: np.ndarray, low: np.ndarray, high: np.ndarray, at_least: np.ndarray, k: int, same: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search, id, score) of the k best rows of each search. Search s belongs to anchor ``of[s]`` and takes rows with
    low <= score <= high and score >= at_least, of the anchor's own label (``same``, without itself) or of another."""
    out = []
    for a in range(0, len(anchor), AT_ONCE):
        mine = np.flatnonzero((of >= a) & (of < a + AT_ONCE))
        need = np.maximum(low[mine], at_least[mine])
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # place in mine, id, score
        for r in range(0, len(ids), STEP):
            score = products(q[a : a + AT_ONCE], rows[r : r + STEP])
            equal = label[a : a + AT_ONCE][:, None] == labels[r : r + STEP][None, :]
            takes = equal & (anchor[a : a + AT_ONCE][:, None] != ids[r : r + STEP][None, :]) if same else ~equal
            score = np.where(takes, score, NONE)[of[mine] - a]
            s, at = np.nonzero((score >= need[:, None]) & (score <= high[mine][:, None]) & (score > NONE))
            if not len(s):
                continue
            joined = tuple(np.concatenate([x, y]) for x, y in zip(kept, (s, ids[r + at], score[s, at]), strict=True))
            best = best_of(*joined, k)
            kept = tuple(x[best] for x in joined)
            full = np.flatnonzero(np.bincount(kept[0], minlength=len(mine)) >= k)
            last = np.full(len(mine), np.iinfo(np.int64).max)
            np.minimum.at(last, kept[0], kept[2])
            need[full] = np.maximum(need[full], last[full])
        out.append((mine[kept[0]], kept[1], kept[2]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


@dataclass
class Index:
    """The rows by leaf and block, the tree, and the sample that gives first scores."""

    rows: DataFrame  # id, label, q, leaf, block
    blocks: DataFrame  # leaf, blocks: one row per leaf
    tree: Tree
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]  # id, label, q
    dim: int


def build_index(vectors: DataFrame, fanout: int = FANOUT, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE) -> Index | None:
    """vectors: id, label, q. None if there are none."""
    spark = vectors.sparkSession
    vectors = reliable_checkpoint(vectors)
    sizes = vectors.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return None
    dim = sizes.n
    vectors = vectors.filter(F.size("q") == dim)
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most")).first()
    drawn = vectors.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(sample).collect()  # bounded: the fitting sample
    ids, labels = np.array([r.id for r in drawn]), np.array([r.label for r in drawn])
    q = np.array([r.q for r in drawn], dtype=np.int64)
    tree = fit_tree(q, size.n, size.most, fanout, leaf)
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches):
        for b in batches:
            leaf = place_rows(shared.value, matrix(b.column("q"), dim))
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("id", "label", "q")] + [pa.array(leaf, pa.int32())], names=["id", "label", "q", "leaf"])

    def met(batches):
        ranges = {}
        for b in batches:
            place_rows(shared.value, matrix(b.column("q"), dim), ranges)
        for number, (low, high) in ranges.items():
            i, j = np.nonzero(np.isfinite(low))
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([number] * len(i), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                "low": pa.array(low[i, j]), "high": pa.array(high[i, j]),
            })

    if tree.nodes:
        ranges = vectors.select("q").mapInArrow(met, "node int, i int, j int, low double, high double")
        for node in tree.nodes:
            node.low, node.high = (np.full((len(node.children),) * 2, x) for x in (np.inf, -np.inf))
        for r in ranges.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # the tree's size
            tree.nodes[r.node].low[r.i, r.j], tree.nodes[r.node].high[r.i, r.j] = r.low, r.high
    rows = reliable_checkpoint(vectors.select("id", "label", "q").mapInArrow(placed, "id long, label long, q array<long>, leaf int"))
    blocks = rows.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / block).cast("int").alias("blocks"))  # the tree's size
    rows = rows.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64(F.lit(12), "id"), F.col("blocks")).cast("int"))
    return Index(rows.select("id", "label", "q", "leaf", "block"), blocks, tree, (ids, labels, q), dim)


def search(index: Index, searches: DataFrame, k: int, same: bool, chunk: int = CHUNK) -> DataFrame:
    """id, slot, found, score: the k best rows of each search.

    searches: id, label, q, and per anchor the arrays low and high (scores; one search, or slot, per entry).
    """
    spark, dim = searches.sparkSession, index.dim
    chunks = max(1, -(-searches.count() // chunk))
    shared = spark.sparkContext.broadcast((index.tree, index.sample))

    def unpacked(b: pa.RecordBatch):
        low, high = b.column("low"), b.column("high")
        of = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(low.offsets)))
        return (np.asarray(b.column("id")), np.asarray(b.column("label")), matrix(b.column("q"), dim), of,
                np.asarray(low.flatten(), np.int64), np.asarray(high.flatten(), np.int64))

    def reached(batches):
        tree, (ids, labels, rows) = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(start, AT_ONCE)
                anchor, label, q, of, low, high = unpacked(b)
                least = np.full(len(of), NONE)
                s, _, score = search_rows(ids, labels, rows, anchor, label, q, of, low, high, least, k, same)
                full = np.bincount(s, minlength=len(of)) >= k
                worst = np.full(len(of), np.iinfo(np.int64).max)
                np.minimum.at(worst, s, score)
                least[full] = worst[full]
                hit, leaf = reached_leaves(tree, q[of], np.maximum(low, least), high)
                pairs = np.unique(np.stack([of[hit], leaf]), axis=1)
                at, leaf = pairs if pairs.size else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                edges = np.asarray(b.column("low").offsets)
                per_anchor = pa.ListArray.from_arrays(pa.array(edges - edges[0], pa.int32()), pa.array(least))
                rows_out = b.append_column("at_least", per_anchor).take(pa.array(at))
                yield rows_out.append_column("leaf", pa.array(leaf, pa.int32())).select(["id", "label", "q", "low", "high", "at_least", "leaf"])

    longs = "array<long>"
    went = searches.select("id", "label", "q", "low", "high").mapInArrow(
        reached, f"id long, label long, q {longs}, low {longs}, high {longs}, at_least {longs}, leaf int"
    )
    nothing = F.lit(None).cast(longs)
    anchors = went.join(F.broadcast(index.blocks), "leaf").select(
        F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(chunks)).cast("int").alias("chunk"), "leaf",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"),
        "id", "label", "q", "low", "high", "at_least",
    )
    rows = index.rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "leaf", "block", F.lit(0).alias("kind"), "id", "label", "q",
        nothing.alias("low"), nothing.alias("high"), nothing.alias("at_least"),
    )

    def exact(batches):
        """Groups come one after another, first their rows, then their anchors."""
        group, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(n)) for n in ("chunk", "leaf", "block", "kind")])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if start == stop:
                    continue
                b, key = batch.slice(start, stop - start), tuple(keys[:3, start].tolist())
                if key != group:
                    group, parts, held = key, [], None
                if keys[3, start] == 0:
                    parts.append((np.asarray(b.column("id")), np.asarray(b.column("label")), matrix(b.column("q"), dim)))
                    continue
                if not parts:
                    continue
                if held is None:
                    held = tuple(np.concatenate([p[i] for p in parts]) for i in range(3))
                anchor, label, q, of, low, high = unpacked(b)
                least = np.asarray(b.column("at_least").flatten(), np.int64)
                s, found, score = search_rows(*held, anchor, label, q, of, low, high, least, k, same)
                first = np.searchsorted(of, np.arange(len(anchor)))
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(anchor[of[s]]), "slot": pa.array(s - first[of[s]], pa.int32()), "found": pa.array(found), "score": pa.array(score),
                })

    together = rows.unionByName(anchors).repartition("chunk", "leaf", "block").sortWithinPartitions("chunk", "leaf", "block", "kind")
    best = together.mapInArrow(exact, "id long, slot int, found long, score long")
    order = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "found")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _floor_hundredths(x: str):
    """The greatest whole number not above x / 100, in whole numbers."""
    return F.expr(f"({x} - pmod({x}, 100)) div 100")


def mine(
    vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", index: Index | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: SQL condition over ``id``. ``window``: least and greatest score of a negative in hundredths of the
    positive's score.
    """
    spark = vectors.sparkSession
    share_package(spark)
    index = index or build_index(quantized(vectors, vec_id, embedding, label))
    if index is None:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    anchors = index.rows.filter(is_anchor).select("id", "label", "q")
    every = anchors.withColumns({"low": F.array(F.lit(NONE + 1)), "high": F.array(F.lit(-NONE))})
    pairs = reliable_checkpoint(search(index, every, positives, True, chunk).select("id", F.col("rank").alias("r"), F.col("found").alias("positive_id"), "score"))
    low, high = -_floor_hundredths(f"(-{window[0]} * score)"), _floor_hundredths(f"({window[1]} * score)")
    slots = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", low.alias("low"), high.alias("high")))).alias("s"))
    windows = anchors.join(slots, "id").select("id", "label", "q", F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    found = search(index, windows, negatives, False, chunk)
    named = found.withColumn("r", F.col("slot") + 1).join(pairs.withColumnRenamed("score", "positive_score"), ["id", "r"])
    return named.select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
