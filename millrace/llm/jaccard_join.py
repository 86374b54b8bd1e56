"""N-gram Jaccard join with a count-vector R-tree (operator 9).

A document's shingles are hashed into groups. Their counts by group are a point: no two sets share more shingles than
the sum of the smaller counts, and no two boxes of points more than the sum of the smaller upper corners, which is what
the R-tree prunes by. Pairs that survive are verified on the sets themselves.

What makes the join distributed: sets that are alike enough differ in few shingles, so when the shingles of a size class
are hashed into more groups than that, some group is the same in both. Documents meet under the hash of a group's
content, first with the least document there only (one pair a document, never all pairs), and again, through R-trees of
bounded cells, where such a meeting left documents unconnected. No link is lost where only empty groups are the same:
see `keys_of`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, components, discard, hashed_words, materialize, mix, ragged, text_chunks, width, window_hashes

#: Words of a shingle, threshold in hundredths, dimensions of the points and of the tree's boxes, members of an R-tree cell.
SHINGLE, PERCENT, DIMS, BOXES, CELL = 4, 85, 512, 64, 2000

#: Keys of a member that are looked at to see whether a pair has met under a lesser one.
LEAST = 32

#: Largest count that a point holds, and a box; two such counts bound nothing.
FULL, BOX_FULL = (1 << 8) - 1, (1 << 16) - 1

#: The ratio of one size class to the next.
CLASS = 1.6

NONE = np.iinfo(np.int64).min


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the number before each text (one more entry than texts). A-Z are lower-cased."""
    words, offsets = hashed_words(texts, lower=True)
    n = np.diff(offsets)
    count = np.maximum(n - k + 1, 0)
    every = window_hashes(words, k)
    parts, sizes = [], np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n).tolist():
        own = every[offsets[i] : offsets[i] + count[i]] if count[i] else window_hashes(words[offsets[i] : offsets[i + 1]], int(n[i])) + np.uint64(n[i])
        own = np.sort(own)
        if len(own) > 1:
            own = own[np.append(True, own[1:] != own[:-1])]
        parts.append(own)
        sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def needed(a, b, percent: int = PERCENT):
    """Least overlap of sets of a and b shingles that link: percent * union <= 100 * overlap."""
    return -((-percent * (a + b)) // (100 + percent))


def _classes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the size classes, and each one's number of groups: one more than the shingles in which two linked sets of up to that size may differ."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(int(lows[-1] * CLASS) + 1)
    lows = np.array(lows, np.int64)
    most = lows[1:] - 1
    return lows, 2 * most * (100 - percent) // (100 + percent) + 1


def keys_of(hashes: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which linked sets meet, and the set of each.

    Two linked sets meet in the class of the larger one: in its groups they differ in fewer shingles than there are groups,
    so some group is the same in both. Where all that are the same may be empty ones, which is seen from each of the two
    sets alone, they also get the keys of a prefix: of two sets with enough in common, the least-hashed shingles (as many
    as may be missing from the other, and one more) share one.
    """
    n = np.diff(offsets)
    lows, groups = _classes(percent)
    own = np.searchsorted(lows, n, side="right") - 1
    largest = 100 * n // percent  # that it may link with
    above = np.searchsorted(lows, largest, side="right") - 1
    keys, owners = [], []
    for shift in range(int((above - own).max(initial=0)) + 1):
        rows = np.flatnonzero((n > 0) & (above >= own + shift))
        if len(rows) == 0:
            continue
        kind = own[rows] + shift
        g = groups[kind]
        begin = np.cumsum(g) - g
        which = np.repeat(np.arange(len(rows)), n[rows])
        h = hashes[ragged(offsets[rows], n[rows])]
        with np.errstate(over="ignore"):
            cell = begin[which] + (mix(h + BASE) % g[which].astype(np.uint64)).astype(np.int64)
            sums, count = np.zeros(int(g.sum()), np.uint64), np.bincount(cell, minlength=int(g.sum()))
            np.add.at(sums, cell, mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)))
            full = np.flatnonzero(count)
            row = np.repeat(np.arange(len(rows)), g)[full]
            place = full - begin[row]
            keys.append(mix(sums[full] + mix((kind[row] * 4_000_037 + place).astype(np.uint64) * BASE + count[full].astype(np.uint64))))
            owners.append(rows[row])
            differ = (n[rows] + np.minimum(lows[kind + 1] - 1, largest[rows])) * (100 - percent) // (100 + percent)
            lone = np.flatnonzero(np.add.reduceat(count == 0, begin, dtype=np.int64) >= g - differ)
            if len(lone):
                rows, kind = rows[lone], kind[lone]
                lens = n[rows] + (-percent * n[rows]) // 100 + 1
                keys.append(mix(hashes[ragged(offsets[rows], lens)] * BASE + np.repeat(mix(kind.astype(np.uint64) + BASE), lens)))
                owners.append(np.repeat(rows, lens))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def points_of(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts by group, sets by DIMS."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = owner * DIMS + (hashes >> np.uint64(65 - DIMS.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=(len(offsets) - 1) * DIMS), FULL).astype(np.uint8).reshape(-1, DIMS)


def coarse(points: np.ndarray) -> np.ndarray:
    """Points of BOXES dimensions, each the sum of neighbours; the sum of their minima is no less than that of the points'."""
    parts = points.reshape(len(points), BOXES, -1)
    return np.where((parts == FULL).any(2), BOX_FULL, parts.sum(2, dtype=np.uint32)).astype(np.uint16)


def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima, a bound on the overlap of the sets behind the points; no bound where both counts are full."""
    least = np.minimum(a, b)
    return least.sum(1, dtype=np.int64) + (1 << 40) * (least.max(1, initial=0) >= (FULL if a.dtype == np.uint8 else BOX_FULL))


def profiles(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of rows (_a, _b, _t): _a, _b, node (a digest of the set; null: empty set), n, keys."""

    def rows(batches):
        for chunk in text_chunks(batches, "_t"):
            hashes, offsets = shingle_sets(chunk.column("_t"), k)
            n = np.diff(offsets)
            keys, owners = keys_of(hashes, offsets, percent)
            order = np.argsort(owners, kind="stable")
            bounds = np.searchsorted(owners[order], np.arange(len(n) + 1)).astype(np.int32)
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes * BASE + np.uint64(3)), dtype=np.uint64)])
                node = mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(np.uint64) * BASE).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("_a"), chunk.column("_b"), pa.array(node, mask=n == 0), pa.array(n), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[order].view(np.int64)))],
                names=["_a", "_b", "node", "n", "keys"],
            )

    return docs.mapInArrow(rows, "_a bigint, _b bigint, node bigint, n bigint, keys array<bigint>")


class Tree:
    """R-tree over points: nodes of a fixed fan-out, packed along the sum and then the first coordinates; boxes are of coarse points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        boxes = coarse(points)
        self.order = np.lexsort((boxes[:, 1], boxes[:, 0], sizes))
        self.points = points[self.order]
        self.levels = [(boxes[self.order], sizes[self.order], sizes[self.order])]
        self.fan = fan
        while len(self.levels[-1][0]) > fan:
            upper, least, most = self.levels[-1]
            at = np.arange(0, len(upper), fan)
            self.levels.append((np.maximum.reduceat(upper, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int, at_once: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs whose overlap may reach what their sizes need. Nodes are visited `at_once` a step at most, so memory is bounded."""
        boxes, top = coarse(points), len(self.levels) - 1
        width = len(self.levels[top][0])
        step = max(1, at_once // width)
        todo = [(top, np.repeat(np.arange(i, min(i + step, len(points))), width), np.tile(np.arange(width), min(step, len(points) - i))) for i in range(0, len(points), step)]
        queries, entries = [], []
        while todo:
            level, q, e = todo.pop()
            upper, least, most = self.levels[level]
            size = sizes[q]
            near = np.flatnonzero((100 * most[e] >= percent * size) & (percent * least[e] <= 100 * size))
            q, e, size = q[near], e[near], size[near]
            need = needed(size, np.maximum(least[e], -(-percent * size // 100)), percent)
            able = np.flatnonzero(smaller(upper[e], boxes[q]) >= need)
            q, e = q[able], e[able]
            if level == 0:
                able = np.flatnonzero(smaller(self.points[e], points[q]) >= need[able])
                q, e = q[able], e[able]
                queries.append(q)
                entries.append(self.order[e])
                continue
            e = (e[:, None] * self.fan + np.arange(self.fan)).reshape(-1)
            q = np.repeat(q, self.fan)
            there = e < len(self.levels[level - 1][0])
            q, e = q[there], e[there]
            todo += [(level - 1, q[i : i + at_once], e[i : i + at_once]) for i in range(0, len(q), at_once)]
        if not queries:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(queries), np.concatenate(entries)


def _cells(batches):
    """Tables of the rows of one or more whole cells (key, i, j), of batches in which a cell's rows follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        new = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
        if held and (ids[:, 0] != last).any():
            new = np.append(0, new)
        last = ids[:, -1]
        if len(new):
            cut = int(new[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def _tree_pairs(percent: int):
    """Of members of cells (key, i, j, leaf, node, component, n, point, keys), sorted by cell: pairs of different components that the R-tree lets through.

    A cell is a key's leaf (i = j), or two of its leaves, of which one is searched for the members of the other. `keys` are a
    member's least ones, in order: a pair that has met under one of them comes from there only. It may come again where it
    meets under further keys, but never not at all.
    """

    def rows(batches):
        for table in _cells(batches):
            if table.num_rows == 0:
                continue
            key, i, j, leaf, node, part, sizes = (table.column(c).to_numpy() for c in ("key", "i", "j", "leaf", "node", "component", "n"))
            points = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, DIMS)
            lists = _flat(table, "keys")
            values, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            left, right = [], []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(key)]):
                own = part[a:b]
                if (own == own[0]).all():
                    continue
                if i[a] == j[a]:
                    ask = held = np.arange(a, b)
                else:
                    ask, held = a + np.flatnonzero(leaf[a:b] == j[a]), a + np.flatnonzero(leaf[a:b] == i[a])
                    if len(ask) == 0 or len(held) == 0:
                        continue
                q, e = Tree(points[held], sizes[held]).search(points[ask], sizes[ask], percent)
                x, y = ask[q], held[e]
                apart = (part[x] != part[y]) & ((x < y) | (i[a] != j[a]))
                for x, y in zip(x[apart].tolist(), y[apart].tolist()):
                    met = np.intersect1d(values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]], assume_unique=True)
                    if len(met) == 0 or met[0] >= key[a]:
                        left.append(node[x])
                        right.append(node[y])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["x", "y"])

    return rows


def _overlap(percent: int):
    """Pairs with both points, and sets: which link."""

    def rows(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("sx", "sy"))
            good = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(x, y)):
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    both = np.concatenate([a, b])
                    both.sort(kind="stable")  # two sorted runs: one merge
                    o = int((both[1:] == both[:-1]).sum())
                    good[i] = 100 * o >= percent * (len(a) + len(b) - o)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(good)], names=["x", "y", "linked"])

    return rows


def links(keyed: DataFrame, known: DataFrame, slim: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between sets in two written tables, enough of them that what all links connect is connected. known: profiles, deleted once read; slim: the same without keys."""
    met = known.where("node IS NOT NULL").select("node", F.explode("keys").alias("key"))
    # A key of one row says nothing; counts are combined before the exchange, however many meet there. Here and below
    # aggregates are written before they are joined, and joins before what needs a key's rows together, so that both sides
    # of a join are exchanges which adaptive execution can split.
    twice = materialize(met.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "twice")
    both = materialize(met.join(twice, "key"), "both")
    discard(known, twice)
    shared = materialize(both.distinct(), "shared")  # copies of one set are one node
    discard(both)
    # What met under one key met under many: of keys with the same members one stays. Keys that only copies have go.
    sign = [F.count("*").alias("c"), F.min("node").alias("hub"), F.bit_xor("node").alias("s"), F.bit_xor(F.xxhash64("node")).alias("t")]
    blocks = materialize(shared.groupBy("key").agg(*sign).where("c > 1").groupBy("c", "hub", "s", "t").agg(F.min("key").alias("hash")).select("hash", "hub", F.monotonically_increasing_id().alias("key")), "blocks")
    meetings = materialize(shared.withColumnRenamed("key", "hash").join(blocks, "hash").drop("hash"), "meetings")
    discard(shared, blocks)
    nodes = meetings.select("node").distinct()
    wanted = materialize(slim.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("_a", "_b")).alias("one")).select("node", F.col("one._a").alias("_a"), F.col("one._b").alias("_b")), "wanted")

    def sets(batches):
        last = None
        for chunk in text_chunks(batches, "_t"):
            # Rows of equal id and text give equal sets; of those that follow each other all but the first go.
            node = chunk.column("node").to_numpy()
            new = np.append(node[0] != last, node[1:] != node[:-1])
            last = node[-1]
            chunk = chunk.filter(pa.array(new))
            if chunk.num_rows == 0:
                continue
            hashes, offsets = shingle_sets(chunk.column("_t"), k)
            points = points_of(hashes, offsets)
            at = offsets.tolist()
            yield pa.RecordBatch.from_arrays([chunk.column("node"), pa.array(np.diff(offsets)), pa.array([p.tobytes() for p in points], pa.binary()), pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["node", "n", "point", "s"])

    whole = keyed.join(wanted.hint("merge"), ["_a", "_b"]).select("node", "_t").mapInArrow(sets, "node bigint, n bigint, point binary, s binary")
    whole = materialize(whole, "sets")
    discard(wanted)

    # Tables of sets and of documents to look up grow with the corpus: none is broadcast.
    def verified(pairs: DataFrame, name: str) -> DataFrame:
        near = whole.select(F.col("node").alias("x"), F.col("s").alias("sx"))
        far = whole.select(F.col("node").alias("y"), F.col("s").alias("sy"))
        out = pairs.hint("merge").join(near, "x").hint("merge").join(far, "y").select("x", "y", "sx", "sy").mapInArrow(_overlap(percent), "x bigint, y bigint, linked boolean")
        return materialize(out.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")), name)

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs whose points allow the overlap that they need."""
        a = whole.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("point").alias("px"))
        b = whole.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("point").alias("py"))

        def rows(batches):
            for batch in batches:
                p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, DIMS) for c in ("px", "py"))
                nx, ny = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
                able = smaller(p, q) >= needed(nx, ny, percent)
                yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(able)), batch.column("y").filter(pa.array(able))], names=["x", "y"])

        return pairs.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", "px", "py").mapInArrow(rows, "x bigint, y bigint")

    stars = meetings.where("node <> hub").select(F.col("node").alias("x"), F.col("hub").alias("y")).distinct()
    linked = verified(bounded(stars), "linked")
    part = components(linked)
    # Keys where some document is still apart from the others: all that met there are compared, through R-trees, but for
    # pairs of the key's largest component. The others are cut into leaves, and so is that component; a cell is two of them.
    placed = materialize(meetings.join(part, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "placed")
    discard(meetings, part)
    by_part = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = by_part.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"))
    main = main.select("key", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / CELL).cast("int").alias("lm"), F.ceil((F.col("all") - F.col("main.n")) / CELL).cast("int").alias("lo")).where("lo > 0")
    main = materialize(main, "open")
    members = materialize(placed.join(main, "key"), "members")
    discard(placed, main)
    lists = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST).alias("keys"))  # no more than a document has
    facts = materialize(whole.select("node", "n", "point").join(lists, "node"), "facts")
    leaf = F.when(F.col("component") == F.col("main"), -1 - F.pmod(F.xxhash64("node"), F.col("lm"))).otherwise(F.pmod(F.xxhash64("node"), F.col("lo"))).cast("int")
    spread = members.join(facts, "node").withColumn("leaf", leaf)
    others = F.explode(F.sequence(F.when(F.col("leaf") < 0, 0).otherwise(-F.col("lm")), F.col("lo") - 1)).alias("other")
    cell = spread.select("key", "leaf", "node", "component", "n", "point", "keys", others).select("key", F.least("leaf", "other").alias("i"), F.greatest("leaf", "other").alias("j"), "leaf", "node", "component", "n", "point", "keys")
    cell = cell.repartition(width(keyed.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    late = materialize(cell.mapInArrow(_tree_pairs(percent), "x bigint, y bigint").distinct(), "late")
    discard(members, facts)
    more = verified(late, "more")
    discard(whole, late)
    return linked, more


def near_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links), the row's keys _a, _b, and its component (a node; null: empty set).

    Sets are told apart by a 64-bit digest, shingles by a 64-bit hash. Null and empty texts have the empty set and link with
    nothing; fewer words than a shingle's are one shingle; very long texts are sets like others, one of them in memory at a
    time; rows without an id link like others and are passed over for the least one; repeated rows are one set; an empty
    table gives an empty one; other columns are ignored, whatever their names.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("_a"), F.xxhash64(t, F.col(id_col).isNull()).alias("_b"), t.alias("_t"))
    known = materialize(profiles(keyed, k, percent), "profiles")
    slim = materialize(known.select("_a", "_b", "n", "node"), "sizes")
    linked, more = links(keyed, known, slim, k, percent)
    part = components(linked.union(more))
    discard(linked, more)
    rows = slim.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = materialize(rows.withColumn("id", F.when(F.col("_a") != NONE, F.col("_a"))), "rows")
    discard(slim, part)
    least = materialize(rows.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least")), "least")
    found = rows.join(least, "component", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), "_a", "_b", "component")
    found = materialize(found, "groups")
    discard(rows, least)
    return found


def digest(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of every group of `docs` (doc_id and text among its columns), and all rows without words, which link with nothing.

    The row of a group is that of its least id (none: last), then of the least text hash; of rows that are equal in both
    the one whose other columns hash least.
    """
    found = near_groups(docs, k, percent)
    rows = materialize(found.where("component IS NOT NULL").groupBy("component", "_a", "_b").agg(F.count("*").alias("c")), "copies")
    first = materialize(rows.groupBy("component").agg(F.min(F.struct((F.col("_a") == NONE).alias("none"), "_a", "_b")).alias("one")), "first")
    both = rows.join(first, "component").withColumn("drop", (F.col("_a") != F.col("one._a")) | (F.col("_b") != F.col("one._b")))
    marked = materialize(both.where("drop OR c > 1").select("_a", "_b", "drop"), "marked")
    discard(found, rows, first)
    a, b = F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull())
    keyed = docs.select(a.alias("_a"), b.alias("_b"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    single = keyed.join(marked.select("_a", "_b"), ["_a", "_b"], "left_anti").select("_row")
    # Dealt out anew before they are combined, so that a row with very many repeats is not one task's.
    repeated = keyed.join(marked.where("NOT drop").select("_a", "_b"), ["_a", "_b"], "left_semi").repartition(width(docs.sparkSession))
    repeated = repeated.groupBy("_a", "_b").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row")
    return single.union(repeated).select("_row.*")
