"""Vector code compression: product codebooks by Lloyd rounds over partition-local cover trees.

A vector's components become integers, floor(SCALE * x), and it is cut into equal consecutive parts. Each part position has a
codebook, at first the parts of the vectors of least id; a round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replaces each entry by the floor of its parts' mean.

1. Trees. A task takes TREE_ROWS vectors at a time and builds one cover tree for each part position: the members of a node
   lie within its radius of the node's centre, and its children are a greedy net of them, with centres farther apart than the
   children may reach. Members of a node are neighbours in the tree's order, so that a subtree's sum is the difference of two
   cumulative sums. The trees are stored once in the shared folder; every round reads them.
2. Rounds. From the root down, all nodes of a level at once: an entry farther from the centre than the nearest one by more than
   two radii cannot be nearest to any member (triangle inequality) and is ruled out for the whole subtree. A node with one entry
   left is assigned as it is, by its cumulative sums; the others pass the entries left to their children, and leaves compare
   their members exactly. A task sends a count and a sum for each entry that it met, whatever it read.
3. Codebooks are PARTS * ENTRIES rows, fixed by parameters; they alone go through the driver, once a round.

Rows whose vector is null or has a null or non-finite component are left out, as are those with another number of components than
the first row's (least id) or one that does not divide into parts. Components count as at most 2 ** 27 in size after
scaling (131,072 before), so that distances fit 64 bits. Rows with equal ids are rows of their own; those that start the codebook are taken by
id (nulls last), then by vector. Fewer vectors than ENTRIES give a codebook of that many entries; an empty table gives no rows. Only
the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one tree; a node with so few members is a leaf; how much nearer children are than their node.
TREE_ROWS, LEAF, SHRINK = 1024, 4, 1.3
MOST = 1 << 27
#: Integers up to this size have exact squared distances in 64-bit floating point.
PLAIN = 1 << 22
#: Labels up to so many may be broadcast with their sums (some 16 bytes each).
BROADCAST_ROWS = 100_000
NODE = np.dtype([("begin", "<i2"), ("end", "<i2"), ("child", "<i4"), ("children", "<i2"), ("radius", "<f8")])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all of b."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < PLAIN:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y) - 2 * (x @ y.T)
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[:, i]) ** 2
    return out


def tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points and nodes of their cover tree; a node's centre is its first member, its children follow one another."""
    apart = np.sqrt(squares(points, points).astype(np.float64))
    order = np.arange(len(points))
    nodes: list[tuple[int, int, int, int, float]] = [(0, len(points), 0, 0, float(apart[0].max()))]
    at = 0
    while at < len(nodes):
        begin, end, _, _, radius = nodes[at]
        if end - begin > LEAF and radius > 0:
            rest, groups = order[begin:end].copy(), []
            first = len(nodes)
            while len(rest):
                far = apart[rest[0], rest]
                near = far <= radius / SHRINK
                group = rest[near]
                nodes.append((begin, begin + len(group), 0, 0, float(far[near].max())))
                begin += len(group)
                groups.append(group)
                rest = rest[~near]
            order[nodes[at][0] : end] = np.concatenate(groups)
            nodes[at] = (*nodes[at][:2], first, len(groups), radius)
        at += 1
    return order, np.array(nodes, NODE)


def distinct(book: np.ndarray) -> np.ndarray:
    """Indexes of the entries that no entry before them equals; others never win a tie."""
    return np.sort(np.unique(book, axis=0, return_index=True)[1])


def assign(points: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subtrees that have one entry as a whole: begin, end and entry of each; and the entry of each other point, -1 where there is none.

    points are in the tree's order.
    """
    own = distinct(book)
    entries = book[own]
    alone = np.full(len(points), -1, np.int64)
    begins, ends, whole = [], [], []
    at, left = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(at):
        node = nodes[at]
        far = squares(points[node["begin"]], entries).astype(np.float64)
        far[~left] = np.inf
        best = far.argmin(1)
        reach = np.sqrt(far[np.arange(len(at)), best]) + 2 * node["radius"]
        # what rounding may take away is added
        left = far <= ((reach * (1 + 1e-9) + 1e-6) ** 2)[:, None]
        sure = (left.sum(1) == 1) | (node["radius"] == 0)
        begins.append(node["begin"][sure])
        ends.append(node["end"][sure])
        whole.append(best[sure])
        leaf = ~sure & (node["children"] == 0)
        if leaf.any():
            size = (node["end"] - node["begin"])[leaf].astype(np.int64)
            first = np.cumsum(size) - size
            member = np.arange(size.sum()) - np.repeat(first - node["begin"][leaf], size)
            near = squares(points[member], entries)
            near[~np.repeat(left[leaf], size, 0)] = np.iinfo(np.int64).max
            alone[member] = near.argmin(1)
        down = ~sure & ~leaf
        children = node["children"][down].astype(np.int64)
        first = np.cumsum(children) - children
        at = np.arange(children.sum()) + np.repeat(node["child"][down] - first, children)
        left = np.repeat(left[down], children, 0)
    begins, ends, whole = (np.concatenate(x).astype(np.int64) for x in (begins, ends, whole))
    return begins, ends, own[whole], np.where(alone >= 0, own[alone], -1)


def scaled(column: pa.Array, size: int) -> np.ndarray:
    """The vectors' components as integers."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64)


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str | None, parts: int) -> DataFrame:
    """vec_id, label and vector of the rows that are not left out for nulls, non-finite components or length."""
    name = F.lit(None).cast("int") if label is None else F.col(label)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), name.alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.filter(finite & (F.size("vector") > 0) & (F.size("vector") % parts == 0))


def planted(rows: DataFrame, size: int) -> DataFrame:
    """The trees of all rows, one row for each TREE_ROWS of them."""
    kind = rows.schema["label"].dataType

    def plant(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(a, TREE_ROWS)
                points = scaled(part.column("vector"), size)
                found = [tree(p) for p in np.split(points, PARTS, axis=1)]
                columns = [
                    pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in ("vec_id", "label")
                ]
                binary = [points.astype("<i4").tobytes(), b"".join(o.astype("<i2").tobytes() for o, _ in found), b"".join(n.tobytes() for _, n in found)]
                columns += [pa.array([b], pa.binary()) for b in binary] + [pa.array([[len(n) for _, n in found]], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_ids", "labels", "points", "orders", "nodes", "sizes"])

    common.ship(rows.sparkSession)
    schema = f"vec_ids array<long>, labels array<{kind.simpleString()}>, points binary, orders binary, nodes binary, sizes array<int>"
    return common.stored(rows.filter(F.size("vector") == size).mapInArrow(plant, schema), "trees")


def grown(row: dict, size: int):
    """Order, points in that order and nodes of each part's tree of a stored row."""
    points = np.frombuffer(row["points"], "<i4").reshape(-1, size).astype(np.int64)
    orders = np.frombuffer(row["orders"], "<i2").reshape(PARTS, -1).astype(np.int64)
    nodes = np.split(np.frombuffer(row["nodes"], NODE), np.cumsum(row["sizes"])[:-1])
    for order, part, own in zip(orders, np.split(points, PARTS, axis=1), nodes):
        yield order, part[order], own


def means(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks of the next round."""
    parts, count, width = books.shape

    def work(batches):
        total, number = np.zeros((parts, count, width), np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for k, (_, points, nodes) in enumerate(grown(row, parts * width)):
                    begin, end, entry, alone = assign(points, nodes, books[k])
                    sums = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(points, 0)])
                    np.add.at(total[k], entry, sums[end] - sums[begin])
                    np.add.at(number[k], entry, end - begin)
                    some = alone >= 0
                    np.add.at(total[k], alone[some], points[some])
                    number[k] += np.bincount(alone[some], minlength=count)
        part, entry = np.nonzero(number)
        if len(part):
            columns = [part, entry, number[part, entry], *total[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    places = [f"s{i}" for i in range(width)]
    met = trees.select("points", "orders", "nodes", "sizes").mapInArrow(work, "part long, entry long, n long, " + ", ".join(f"{c} long" for c in places))
    table = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in places]).toArrow()
    out = books.copy()
    at = tuple(table.column(c).to_numpy() for c in ("part", "entry"))
    out[at] = np.stack([table.column(c).to_numpy() for c in places], 1) // table.column("n").to_numpy()[:, None]
    return out


def train(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """The stored trees of all usable rows and the codebooks after ROUNDS rounds: integers by part, entry and place in the part."""
    rows = usable(vectors, vec_id, vector, label, PARTS)
    first = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    head = first.limit(1).toArrow()
    size = len(head.column("vector")[0].as_py()) if head.num_rows else PARTS
    trees = planted(rows, size)
    start = first.filter(F.size("vector") == size).limit(ENTRIES).toArrow().combine_chunks()
    points = scaled(start.column("vector").combine_chunks(), size) if start.num_rows else np.zeros((0, size), np.int64)
    books = np.stack(np.split(points, PARTS, axis=1))
    for _ in range(ROUNDS if len(points) else 0):
        books = means(trees, books)
    return trees, books


def encode(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (one byte for each part) and error of each vector of the trees."""
    parts, _, width = books.shape
    kind = trees.schema["labels"].dataType.elementType

    def work(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["points", "orders", "nodes", "sizes"]).to_pylist()):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("vec_ids", "labels"))
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for k, (order, points, nodes) in enumerate(grown(row, parts * width)):
                    begin, end, entry, code = assign(points, nodes, books[k])
                    size = end - begin
                    first = np.cumsum(size) - size
                    code[np.arange(size.sum()) + np.repeat(begin - first, size)] = np.repeat(entry, size)
                    codes[order, k] = code
                    error[order] += ((points - books[k][code]) ** 2).sum(1)
                data = pa.array([bytes(c) for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, labels, data, pa.array(error)], names=["vec_id", "label", "codes", "error"])

    return trees.mapInArrow(work, f"vec_id long, label {kind.simpleString()}, codes binary, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with the errors summed over rows of equal label, nulls together.

    Labels that are few go to every task with their sums; many are joined, where Spark parts a skewed label's rows.
    """
    sums = common.stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error and codebooks_sha256 of each usable vector."""
    trees, books = train(vectors, vec_id, vector, label)
    coded = common.stored(encode(trees, books), "codes")
    return with_label_error(coded).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

