"""Jaccard join of word shingle sets in metric space: pivots, their regions, triangle windows, recursion.

Jaccard distance is a metric, but it is 1 between any two texts that share no shingle, and among such texts no
pivot tells anything. So the first regions are a lossless cover: two sets of similarity t or more share one of
the first n - ceil(t n) + 1 of their shingles in a common order, and one of the two has it among its first
n - ceil(2 t / (1 + t) n) + 1 (its index prefix). The order is by how many texts have a shingle, rarest first.

1. Shared shingles. Each slice of texts asks once for each of its distinct shingles; an aggregation by shingle answers
   those that occur again, with their frequency (as a power of two). A text that more than 1 - t of its shingles
   are its own cannot link to any other and leaves here; of the others only the shared shingles are kept. Of equal texts
   one asks; a bitmap of those, sized by their count, lets some others ask too, which changes nothing.
2. Regions. A root region is a prefix shingle of two texts or more, one of them by its index prefix. Its pivot is its most
   central member: the one whose shingles are the most frequent ones. A pivot that lies within a ring of a more central one that it
   meets gives its regions to that one, so that a cluster has one cell and not one for each of its edits. Regions of one
   pivot make up its cell, and each text goes into the cells of all pivots that it meets.
3. Distances of a cell's members to its pivot are exact, and pairs within 1 - t are links. Nothing is left to do in
   a cell whose members all link to the pivot.
4. Triangle windows. In the other cells members are parted in rings around the pivot, RINGS * (1 - t) wide; a member no
   farther than 1 - t from the next ring is replicated to it. Two sets also differ from each other by what only one of them
   has of their differences from the pivot, which bounds from below how many of these differences a link must share. A prefix of
   them, rarest first, names the regions of the next round: one kind for members that do not link to the pivot, one for those with the
   members that do. Members that both link to the pivot need no such region.
   A cell whose members would go into far more regions than it takes to compare them block by block is compared so at once: those that do
   not link to the pivot with each other and with those that do, in groups of two blocks, some LEAF members. Such are clusters of many
   copies with edits at the same places, where regions have many members too, at any depth.
5. These regions are joined in the same way, each around a pivot of its own, or if they have LEAF members at most, member by member:
   those of up to PAIRED members as pairs, larger ones in a group that takes each member's set once, counts what
   all members share and sends on only links that connect them as all would. A pivot is never in the regions that come out of its cell, and all of their members come after it in the order by which
   pivots are taken, so this ends, and any two texts that link meet in a cell where one is the pivot, or in a leaf, or both link to a pivot.

Near copies of one text cost one distance each. Links are put together to components over stored tables; only
row counts reach the driver. No join has a cap.

Words are lower-cased (A-Z) runs of non-blank characters; a set holds all shingles of five words, or the
whole sequence if there are fewer. Shingles are compared by 51 bits of a hash, texts by 128 bits of their words. Null, empty
and blank texts have the empty set, link to nothing and are their own component. Every row gives one row, an empty
table gives none. Rows with a null id take part, and the component has the least id that is not null (null if there is
none); rows of equal ids with different texts are different sets. Texts of any length are taken whole: a text is one
array in one task. Other columns of the table, whatever their names, are not read by join(); keep() returns them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm import common

SHINGLE = 5
#: Similarity as a fraction, so that bounds are whole-number arithmetic.
NUMERATOR, DENOMINATOR = 80, 100
#: Width of a ring around a pivot, in links.
RINGS = 2
#: Regions of the second round and later are not split further if they have so many members.
LEAF = 256
#: Regions of so many members at most are compared as rows of pairs, fewer than PAIRED / 2 for each member.
PAIRED = 8
#: A cell is compared by blocks if these have up to so many times the rows that its regions have; those of large regions come again in further rounds.
DENSE = 8
#: Members of regions (24 bytes each) up to which the sets are looked up by a broadcast.
BROADCAST_ROWS = 1_000_000
#: Shingles whose holders among a region's members are multiplied out at once.
COLUMNS = 4096
#: Low bits of a hash that give way to a text's number in its slice; the last number stands for several texts.
TEXT_BITS = 13
SEVERAL = (1 << TEXT_BITS) - 1
HASH_BITS = 64 - TEXT_BITS
#: Bits of the largest bitmap of texts.
MOST_BITS = 30
#: At least so many parts of the range of hashes, each answered by itself.
PARTS_BITS = 10
ROWS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32()), ("n", pa.int64()), ("key", pa.binary())])


def firsts(docs: DataFrame) -> np.ndarray:
    """A bitmap of one row of each text, sized by their count."""
    rows = common.stored(docs.groupBy("text_hash", F.hash("text").alias("other")).agg(F.min("row").alias("row")).select("row"), "texts")
    return common.bitmap(rows, "row", min(MOST_BITS, max(16, (16 * rows.count()).bit_length())))


def asked(docs: DataFrame, k: int, bits: int, first: np.ndarray | None = None) -> DataFrame:
    """For each slice of texts: its distinct shingles by part of the hash range (part >= 0), each with the number of the text
    that has it; its rows (odd negative part) and the shingles that several texts have (even negative part). If there is a bitmap, only texts of rows in it ask."""

    def work(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.slices(batch, "text"):
                for a in range(0, part.num_rows, SEVERAL):
                    yield one(part.slice(a, SEVERAL), number)
                    number += 1

    def one(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
        import xxhash

        texts: dict[bytes, int] = {}
        at = [None if t is None else texts.setdefault(t, len(texts)) for t in common.utf8(part.column("text"))]
        h, begins = common.slice_hashes(list(texts), lower=True)
        s, text, _ = common.slice_shingles(h, begins, k)
        words = np.diff(begins)
        few = np.flatnonzero((words > 0) & (words < k))
        s = np.concatenate([s, *(common.shingle_hashes(h[begins[i] : begins[i + 1]], int(words[i])) for i in few)])
        text = np.concatenate([text, few])
        entries = np.sort(s >> np.uint64(TEXT_BITS) << np.uint64(TEXT_BITS) | text.astype(np.uint64))
        entries = entries[common.heads(entries)]
        text = (entries & np.uint64(SEVERAL)).astype(np.int64)
        n = np.bincount(text, minlength=len(texts))
        if first is not None:
            asks = np.zeros(len(texts), bool)
            asks[[i for i, good in zip(at, common.in_bitmap(first, part.column("row").to_numpy().view(np.uint64))) if good and i is not None]] = True
            entries = entries[asks[text]]
        keys = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) if n[i] else None for t, i in texts.items()]
        begin = common.heads(entries >> np.uint64(TEXT_BITS))
        count = np.diff(np.append(begin, len(entries)))
        ask = entries[begin]
        ask[count > 1] |= np.uint64(SEVERAL)
        own = ask >> np.uint64(64 - bits)
        cut = common.heads(own)
        rows = pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_hash"), pa.array(at, pa.int32()), pa.array([0 if i is None else int(n[i]) for i in at], pa.int64()), pa.array([None if i is None else keys[i] for i in at], pa.binary())], schema=ROWS
        )
        several = np.ascontiguousarray(entries[np.repeat(count > 1, count)])
        extra = pa.array([rows.serialize().to_pybytes(), several.tobytes()], pa.binary())
        # a key of its own for each slice, so that its rows meet no other's
        spread = 2 * int(common.mixed(np.array([number], np.uint64))[0] >> np.uint64(35))
        parts = np.concatenate([own[cut].astype(np.int32), np.array([-1 - spread, -2 - spread], np.int32)])
        data = pa.concat_arrays([common.pack(ask, np.append(cut, len(ask))), extra])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), number)), pa.array(parts), data], names=["slice", "part", "data"])

    return docs.select("doc_id", "text_hash", "text", *["row"][: first is not None]).mapInArrow(work, "slice long, part int, data binary")


def answered(asks: DataFrame, bits: int) -> DataFrame:
    """For each slice the shingles that occur again, with their frequency in the highest bits; other rows as they are."""

    def work(batches):
        for table in common.runs(batches, "part"):
            part = table.column("part")[0].as_py()
            if part < 0:
                yield from table.combine_chunks().to_batches()
                continue
            ask, sizes = common.packed(table.column("data"))
            of = np.repeat(np.arange(len(sizes)), sizes)
            hashes = ask >> np.uint64(TEXT_BITS)
            order = np.argsort(hashes, kind="stable")
            ask, of = ask[order], of[order]
            begin = common.heads(hashes[order])
            texts = np.add.reduceat(np.where(ask & np.uint64(SEVERAL) == SEVERAL, 2, 1), begin) if len(begin) else begin
            again = np.repeat(texts > 1, np.diff(np.append(begin, len(ask))))
            power = np.repeat(np.log2(np.maximum(1, texts)).astype(np.uint64), np.diff(np.append(begin, len(ask))))
            reply = power << np.uint64(64 - bits) | ask & np.uint64((1 << 64 - bits) - 1)
            reply, of = reply[again], of[again]
            order = np.argsort(of, kind="stable")
            reply, of = reply[order], of[order]
            cut = common.heads(of)
            if len(cut):
                slices = table.column("slice").to_numpy()[of[cut]]
                yield pa.RecordBatch.from_arrays([pa.array(slices), pa.array(np.full(len(cut), part, np.int32)), common.pack(reply, np.append(cut, len(reply)))], names=["slice", "part", "data"])

    return asks.repartition("part").sortWithinPartitions("part").mapInArrow(work, "slice long, part int, data binary")


def gathered(answers: DataFrame, bits: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n (size of the set) and key for each row; and, once for the rows of a text in a slice, if it may link at
    all: shared (its shared shingles, rarest first), how many of them are its prefix and its index prefix, and its score as a pivot."""
    schema = "doc_id long, text_hash long, n long, key binary, shared array<long>, prefix int, index int, score long"

    def work(batches):
        for table in common.runs(batches, "slice"):
            parts = table.column("part").to_numpy()
            data = table.column("data")
            rows = pa.ipc.read_record_batch(data[int(np.flatnonzero((parts < 0) & (parts % 2 == 1))[0])].as_buffer(), ROWS)
            several, _ = common.packed(data.take(np.flatnonzero((parts < 0) & (parts % 2 == 0))))
            asked_for = np.flatnonzero(parts >= 0)
            reply, sizes = common.packed(data.take(asked_for))
            low = np.uint64(64 - bits)
            high = np.repeat(parts[asked_for].astype(np.uint64), sizes) << low
            power = reply >> low
            entry = high | reply & np.uint64((1 << 64 - bits) - 1)
            hashes = entry >> np.uint64(TEXT_BITS)
            name = power << np.uint64(HASH_BITS) | hashes
            text = (entry & np.uint64(SEVERAL)).astype(np.int64)
            one = text != SEVERAL
            order = np.argsort(hashes[~one])
            names = name[~one][order]
            names = names[np.searchsorted(hashes[~one][order], several >> np.uint64(TEXT_BITS))] if len(several) else names[:0]
            text = np.concatenate([text[one], (several & np.uint64(SEVERAL)).astype(np.int64)])
            name = np.concatenate([name[one], names])
            order = np.lexsort((name, text))
            text, name = text[order], name[order]
            at = rows.column("at").to_numpy(zero_copy_only=False)
            n = rows.column("n").to_numpy()
            out = []
            seen = set()
            edges = np.searchsorted(text, np.arange(int(text.max(initial=-1)) + 2))
            sums = np.concatenate([[0], np.cumsum(name >> np.uint64(HASH_BITS), dtype=np.int64)])
            for i, size in zip(at.tolist(), n.tolist()):
                own = None
                if size and i not in seen and i + 1 < len(edges):
                    seen.add(i)
                    a, b = int(edges[int(i)]), int(edges[int(i) + 1])
                    alone = size - (b - a)
                    prefix = size - -(-num * size // den) + 1 - alone
                    if prefix > 0 and b > a:
                        index = size - -(-2 * num * size // (num + den)) + 1 - alone
                        own = (name[a:b].view(np.int64), prefix, max(0, index), int(1_000_000 * (sums[b] - sums[a]) // size))
                out.append(own or (None, None, None, None))
            shared, prefix, index, score = zip(*out)
            columns = [*(rows.column(c) for c in ("doc_id", "text_hash", "n", "key")), pa.array(shared, pa.list_(pa.int64())), pa.array(prefix, pa.int32()), pa.array(index, pa.int32()), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return answers.repartition("slice").sortWithinPartitions("slice").mapInArrow(work, schema)


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of a text and a pivot (x, score, p, leaf) with linked and near (in the pivot's first ring), and the regions that x goes into next
    from the pivot's cell: open ones for texts that don't link to it, mixed ones for both. Pairs of a leaf have none."""
    left = pairs.join(sets.select(F.col("key").alias("x"), F.col("n").alias("n_x"), F.col("shared").alias("set_x")), "x")
    both = left.join(sets.select(F.col("key").alias("p"), F.col("n").alias("n_p"), F.col("shared").alias("set_p")), "p")
    a, b = den - num, den + num
    width = RINGS * a

    def regions(p: bytes, kind: int, rings: list[int], names: np.ndarray) -> list[np.ndarray]:
        seed = np.frombuffer(p[:8], np.uint64)
        return [common.mixed(common.mixed(names + seed) + np.uint64(2 * r + kind + 1)).view(np.int64) for r in rings]

    def one(p: bytes, leaf: bool, n_x: int, x: np.ndarray, n_p: int, y: np.ndarray) -> tuple[bool, bool, np.ndarray, np.ndarray]:
        at = np.searchsorted(y, x)
        hit = y[np.minimum(at, len(y) - 1)] == x
        both = int(hit.sum())
        union, differ = n_x + n_p - both, n_x + n_p - 2 * both
        linked, close = den * both >= num * union, den * (union - both) < width * union
        none = np.zeros(0, np.int64)
        if leaf:
            return linked, close, none, none
        # how many of its differences from the pivot x shares at least with a text that it links to: one that does not link to the pivot, or one that does
        apart = max(1, (b * differ + a * (n_p - n_x)) // (2 * b) + 1)
        joined = max(1, -(-(b * num * differ - a * (num * n_x + den * min(n_x, n_p))) // (b * num)))
        alone = n_x - len(x)
        take = [differ - least + 1 - alone for least in ([apart] if linked else [apart, joined])]
        if max(take) <= 0:
            return linked, close, none, none
        # those that few of the cell differ in come first: what is rare or what x alone lacks, then what the pivot lacks, and what it has alone
        more = x[~hit]
        often = more >> np.uint64(HASH_BITS) >= max(1, y[len(y) // 2] >> np.uint64(HASH_BITS)) - 1
        missed = np.ones(len(y), bool)
        missed[at[hit]] = False
        names = np.concatenate([more[~often], y[missed], more[often], np.arange(n_p - len(y), dtype=np.uint64)])
        # distance times den, over union; a ring is width / den wide
        ring = den * (union - both) // (width * union)
        near = den * (union - both) + a * union >= width * (ring + 1) * union
        rings = [ring, ring + 1] if near else [ring]
        first, last = names[: max(0, take[0])], names[: max(0, take[-1])]
        return linked, close, np.concatenate([none] if linked else regions(p, 0, rings, first)), np.concatenate(regions(p, 1, rings, last))

    def work(batches):
        for batch in batches:
            found = []
            sets = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column("set_x"), batch.column("set_p"))]
            (u, xs), (v, ys) = sets
            for i, (p, leaf, n_x, n_p) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("p", "leaf", "n_x", "n_p")))):
                found.append(one(p, leaf, n_x, xs[u[i] : u[i + 1]], n_p, ys[v[i] : v[i + 1]]))
            linked, close, open_, mixed = zip(*found) if found else ((), (), (), ())
            columns = [pa.array(linked, pa.bool_()), pa.array(close, pa.bool_()), pa.array(open_, pa.list_(pa.int64())), pa.array(mixed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "score", "p", "leaf")), *columns], names=["x", "score", "p", "leaf", "linked", "near", "open", "mixed"])

    return both.mapInArrow(work, "x binary, score long, p binary, leaf boolean, linked boolean, near boolean, open array<long>, mixed array<long>")


def fewer(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, score, p) with the most central pivot that p is near to, among those that it meets itself, in p's place."""
    pairs = common.stored(pairs, "met")
    pivots = pairs.select("p").distinct()
    among = pairs.join(pivots.withColumnRenamed("p", "x"), "x", "left_semi").withColumn("leaf", F.lit(True))
    near = compared(among, sets, num, den).filter("near").select("x", "p")
    score = sets.select(F.col("key").alias("p"), F.col("score").alias("own"))
    best = near.join(score, "p").groupBy(F.col("x").alias("p")).agg(F.max(F.struct("own", "p")).alias("best"))
    return pairs.join(best, "p", "left").select("x", "score", F.coalesce("best.p", "p").alias("p"))


def shared_counts(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many values each two of the sets share; sets lie one after the other, sizes tells how long each is."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values, kind="stable")
    begin = common.heads(values[order])
    count = np.diff(np.append(begin, len(values)))
    column = np.repeat(np.cumsum(count > 1) - 1, count)
    held = np.repeat(count > 1, count)
    of, column = of[order][held], column[held]
    both = np.zeros((len(sizes), len(sizes)), np.float32)
    edges = np.searchsorted(column, np.arange(0, int((count > 1).sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        has = np.zeros((len(sizes), COLUMNS), np.float32)
        has[of[a:b], column[a:b] - k * COLUMNS] = 1
        both += has @ has.T
    return both.astype(np.int64)


def inside(leaves: DataFrame, num: int, den: int) -> DataFrame:
    """x, p and linked: links between the members of each region (region, x, n, shared) that connect them as all their links would.

    A region's sets are held together, at most LEAF of them; no pair but such a link is a row.
    """

    def work(batches):
        for table in common.runs(batches, "region"):
            x = table.column("x").to_pylist()
            n = table.column("n").to_numpy()
            shared = table.column("shared").combine_chunks()
            both = shared_counts(shared.flatten().to_numpy(), shared.value_lengths().to_numpy())
            linked = den * both >= num * (n[:, None] + n[None, :] - both)
            free = np.ones(len(x), bool)
            found = []
            for root in range(len(x)):
                reached = [root] if free[root] else []
                free[root] = False
                while reached:
                    i = reached.pop()
                    new = np.flatnonzero(linked[i] & free)
                    free[new] = False
                    reached += new.tolist()
                    found += [(x[i], x[j]) for j in new.tolist()]
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([True] * len(a))], names=["x", "p", "linked"])

    return leaves.repartition("region").sortWithinPartitions("region", "x").mapInArrow(work, "x binary, p binary, linked boolean")


def cell_sizes(cells: DataFrame) -> DataFrame:
    """p, in how many blocks the members of its cell go that link to it (joined) and that don't (apart), and whether the cell is dense; cells with none apart are left out."""
    n, half = F.count(F.lit(1)), F.lit(LEAF // 2)
    sums = cells.groupBy("p").agg(n.alias("n"), F.count_if(~F.col("linked")).alias("far"), F.sum(F.size("open") + F.size("mixed")).alias("wide")).filter("far > 0")
    sums = sums.withColumns({"joined": F.ceil((F.col("n") - F.col("far")) / half), "apart": F.ceil(F.col("far") / half)})
    rows = F.when((F.col("joined") == 1) & (F.col("apart") == 1), F.col("n")).otherwise(F.col("n") * F.col("apart") + F.col("far") * F.col("joined"))
    return sums.select("p", "joined", "apart", (rows <= DENSE * F.col("wide")).alias("dense"))


def blocks(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups (region, x) in which each member of the cells (x, p, linked) that does not link to the pivot meets all others, by sizes' blocks."""
    part = F.when(F.col("linked"), F.pmod(F.xxhash64("x"), "joined")).otherwise(F.pmod(F.xxhash64("x"), "apart"))
    rows = cells.join(sizes.filter("dense").select("p", "joined", "apart"), "p").withColumn("b", part)
    other = F.sequence(F.lit(0), F.col("apart") - 1)
    own = F.transform(other, lambda i: F.xxhash64("p", F.lit(0), F.least(i, "b"), F.greatest(i, "b")))
    mine = F.transform(F.sequence(F.lit(0), F.col("joined") - 1), lambda k: F.xxhash64("p", F.lit(1), "b", k))
    linked = F.transform(other, lambda i: F.xxhash64("p", F.lit(1), i, "b"))
    # one group holds a small cell
    groups = F.when((F.col("joined") == 1) & (F.col("apart") == 1), F.array(F.xxhash64("p"))).when(F.col("linked"), linked).otherwise(F.when(F.col("joined") > 0, F.concat(own, mine)).otherwise(own))
    return rows.select(F.explode(groups).alias("region"), "x").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node reachable) for all nodes of the edges but the labels themselves.

    Large-star and small-star steps over stored tables: each node's neighbours are hung on the least
    of them, until nothing changes. Each step is one job, which also sums up the edges it writes.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    last = None
    while True:
        # large star: neighbours greater than a node go to the least of its neighbours and itself
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its lesser neighbours go to the least of those
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        seen = Observation()
        step = small.union(best.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        pairs = common.stored(step.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        if seen.get == last:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
        last = seen.get


def links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """a and b: links that connect all texts (key, n, shared, prefix, index, score) as all pairs of sufficient similarity would."""
    spark = sets.sparkSession
    first = sets.select("key", "score", "index", F.posexplode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("place", "region"))
    # side: what makes a region worth a look; it needs a member with it, and a mixed one also a member without it
    members = first.select("region", F.col("key").alias("x"), "score", (F.col("place") < F.col("index")).alias("side"), F.lit(False).alias("mixed"))
    found = common.scratch(spark, "distances")
    folders = [f"{found}/turn=*"]
    turn = 0

    def together(groups: DataFrame) -> None:
        leaves = common.stored(groups, "leaves")
        n = leaves.count()
        if n:
            held = sets.select(F.col("key").alias("x"), "n", "shared").join(F.broadcast(leaves) if n <= BROADCAST_ROWS else leaves, "x")
            folders.append(common.scratch(spark, "inside"))
            with common.swept(spark):
                inside(held, num, den).write.parquet(folders[-1])

    while True:
        regions = members.groupBy("region").agg(F.max(F.struct("score", "x")).alias("p"), F.max("side").alias("some"), F.min("side").alias("all"), F.max("mixed").alias("mixed"), F.count(F.lit(1)).alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
        regions = regions.filter("some and least <> most and not (mixed and all)").select("region", F.col("p.x").alias("p"), "m")
        pairs = members.join(regions.filter(F.col("m") > (LEAF if turn else 0)), "region").filter("x <> p").groupBy("x", "p").agg(F.first("score").alias("score"))
        if not turn:
            pairs = fewer(pairs, sets, num, den).groupBy("x", "p").agg(F.first("score").alias("score"))
        pairs = pairs.withColumn("leaf", F.lit(False))
        if turn:
            few = members.join(regions.filter(F.col("m") <= PAIRED).select("region"), "region")
            other = few.select("region", F.col("x").alias("p"), F.col("side").alias("other"))
            met = few.join(other, "region").filter("x < p and not (mixed and side = other)").select("x", "p", "score")
            pairs = pairs.unionByName(met.groupBy("x", "p").agg(F.first("score").alias("score"), F.lit(True).alias("leaf")))
            together(members.join(regions.filter(F.col("m").between(PAIRED + 1, LEAF)).select("region"), "region").select("region", "x").distinct())
        seen = Observation()
        here = compared(pairs, sets, num, den).observe(seen, F.count(F.when(~F.col("linked") & ~F.col("leaf"), 1)).alias("n"))
        with common.swept(spark):
            here.write.parquet(f"{found}/turn={turn}")
        if not seen.get["n"]:
            break
        here = spark.read.parquet(f"{found}/turn={turn}").filter("not leaf")
        sizes = common.stored(cell_sizes(here), "sizes")
        kinds = {x["dense"] for x in sizes.select("dense").distinct().collect()}
        if True in kinds:
            together(blocks(here, sizes))
        if False not in kinds:
            break
        cells = here.join(sizes.filter("not dense").select("p"), "p", "left_semi").select("x", "score", (~F.col("linked")).alias("side"), "open", "mixed")
        members = cells.select(F.explode("open").alias("region"), "x", "score", "side", F.lit(False).alias("mixed"))
        members = members.unionByName(cells.select(F.explode("mixed").alias("region"), "x", "score", "side", F.lit(True).alias("mixed")))
        turn += 1
    return spark.read.schema("x binary, p binary, linked boolean").parquet(*folders).filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64 of the text) and component (a key that
    tells components apart even if ids repeat; null for the empty set), one row a row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumns({"text_hash": F.xxhash64("text"), "row": F.xxhash64("doc_id", "text")})
    bits = max(PARTS_BITS, (4 * common.partitions(docs.sparkSession) - 1).bit_length())
    rows = common.stored(gathered(answered(asked(docs, k, bits, firsts(docs)), bits), bits, num, den), "shingles")
    one = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "shared", "prefix", "index", "score")]
    sets = common.stored(rows.filter("shared is not null").groupBy("key").agg(*one), "sets")
    labels = components(links(sets, num, den))
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"))
    classes = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    roots = classes.join(labels.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min("id").alias("root"))
    classes = classes.join(roots, "label", "left").select("key", F.coalesce("root", "id").alias("id"), "label")
    own = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("binary").alias("component"))
    full = rows.filter("n > 0").join(classes, "key").select("doc_id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), "text_hash", F.col("label").alias("component"))
    return full.unionByName(own)


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component: the row of the least id (null ids last), then of the least text hash.

    Texts without words are all kept. Of rows with the same id and text, one stays. All columns come back.
    """
    found = join(docs, doc_id, text, **options).filter("component is not null")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    mark = "_".join(["row", *docs.columns])
    chosen = first.select(F.xxhash64("f.doc_id", "f.text_hash").alias(mark))
    blank = F.coalesce(~docs[text].rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))
    worded = docs.filter(~blank).withColumn(mark, F.xxhash64(docs[doc_id].cast("long"), F.xxhash64(docs[text].cast("string"))))
    good = worded.join(chosen, mark, "left_semi").dropDuplicates([mark]).drop(mark)
    return good.unionByName(docs.filter(blank))
