"""Embedding near-duplicates by a forest of random-projection trees.

Trees split the space at the median of random projections; vectors near a split go to both sides.
Vectors are compared within leaves, in double precision, and true links are united. A pair that meets in
several leaves counts only in the first: the leaves of linked vectors are found anew from the trees, so no
code is carried and no pair is ever shuffled.

A vector is sent to cells, nodes high in the trees that a task can hold, and parted down to the leaves
there. Cells are compared in passes, one after another, whose shuffles are deleted as they end, so the
copies on disk at a time are bounded by the size of the table, whatever the number and depth of the trees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capframe.llm.common import materialize
from capframe.llm.components import components
from capframe.session import shuffles_dropped

LEAST = 0.9
TREES = 6
LEAF = 768  # vectors a leaf should hold
SPILL = 0.25  # of the spread of a projection between vectors at the least cosine
SAMPLE = 64 << 20  # bytes of the vectors the trees are fitted on; all vectors are filed and compared
SMALLEST = 12  # sample vectors in a node that is split no more
BLOCK, BLOCK_BYTES = 200_000, 48 << 20  # vectors of a cell a task holds; those of larger cells are dealt in blocks
PASS, PASS_BYTES = 1.5, 16 << 20  # copies of vectors sent at once: a share of the table, or so many bytes
HELD = 500_000  # pairs gathered before their first meetings are told
LIES_IN = 32 << 20  # rows x leaves of a matrix that tells many pairs at once
_LEAF_BITS = 24
_ROW_BYTES = 48  # of a copy of a vector, besides its parts


@dataclass
class Tree:
    directions: np.ndarray  # dimension x levels
    cut: np.ndarray  # per node; nan in leaves
    child: np.ndarray  # left child; the right one follows
    margin: float
    level: np.ndarray  # per node
    holds: np.ndarray  # vectors a node should hold

    def file(self, x: np.ndarray, start: int = 0, most: float = -1) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of every leaf under ``start`` each row of ``x`` falls into; a node of ``most`` vectors is not parted."""
        rows, nodes = np.arange(len(x)), np.full(len(x), start, dtype=np.int64)
        done_rows, done_nodes = [], []
        if self.directions.shape[0] != x.shape[1]:
            return rows, nodes
        whole = np.isnan(self.cut) | (self.holds <= most)
        first = int(self.level[start])
        for level in range(first, self.directions.shape[1] + 1):
            end = whole[nodes]
            done_rows.append(rows[end])
            done_nodes.append(nodes[end])
            rows, nodes = rows[~end], nodes[~end]
            if not len(rows):
                break
            if (level - first) % 8 == 0:
                places = x @ self.directions[:, level : level + 8]
            off = places[rows, (level - first) % 8] - self.cut[nodes]
            left, right = off <= self.margin, off >= -self.margin
            rows = np.concatenate([rows[left], rows[right]])
            nodes = np.concatenate([self.child[nodes[left]], self.child[nodes[right]] + 1])
        return np.concatenate(done_rows), np.concatenate(done_nodes)


def fit_tree(sample: np.ndarray, total: int, seed: int, leaf: int, least: float, spill: float) -> Tree:
    """Split until a node should hold ``leaf`` of the ``total`` vectors or is too small in the sample."""
    n, d = sample.shape
    rng = np.random.default_rng(seed)
    levels = 40
    directions = rng.normal(size=(d, levels))
    directions /= np.linalg.norm(directions, axis=0)
    margin = spill * np.sqrt(2 - 2 * least) / np.sqrt(d)
    per_row = total / max(n, 1)
    cut, child, levels_of, holds = [np.nan], [0], [0], [float(total)]
    queue = [(0, np.arange(n), 0)]
    deepest = 0
    while queue:
        node, rows, level = queue.pop()
        if len(rows) * per_row <= leaf or len(rows) < SMALLEST or level >= levels:
            continue
        places = sample[rows] @ directions[:, level]
        at = float(np.median(places))
        left, right = rows[places <= at + margin], rows[places >= at - margin]
        if len(left) ** 2 + len(right) ** 2 >= len(rows) ** 2:
            continue  # too close together: parting them would only add copies
        cut[node], child[node] = at, len(cut)
        cut += [np.nan, np.nan]
        child += [0, 0]
        levels_of += [level + 1, level + 1]
        holds += [len(left) * per_row, len(right) * per_row]
        queue += [(child[node], left, level + 1), (child[node] + 1, right, level + 1)]
        deepest = max(deepest, level + 1)
    return Tree(directions[:, :deepest], np.array(cut), np.array(child, dtype=np.int32), margin, np.array(levels_of, dtype=np.int8), np.array(holds, dtype=np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    odd = ~((norm > 1e-150) & (norm < 1e150)).ravel()
    if odd.any():  # squares of these parts leave the range of doubles
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.linalg.norm(x[odd], axis=1, keepdims=True)
    return x / norm


def fit_forest(classes: DataFrame, number, total: int, values: int, trees: int, leaf: int, least: float, spill: float, most_bytes: int, seed: int) -> dict[int, list[Tree]]:
    """Trees for each vector length, from vectors chosen by hash that take some ``most_bytes`` in double precision."""
    share = min(1.0, most_bytes / max(8 * values, 1))
    rows = classes.where(F.col("draw") < int(share * (1 << 30))).select("size", "vector").toArrow()
    sizes, flat = rows["size"].to_numpy(), _parts(rows["vector"], number)
    starts = np.cumsum(sizes) - sizes
    forest = {}
    for size in np.unique(sizes):
        x = unit(flat[starts[sizes == size][:, None] + np.arange(size)])
        forest[int(size)] = [fit_tree(x, total * len(x) // len(sizes), seed + t, leaf, least, spill) for t in range(trees)]
    return forest


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row each of n rows reaches over links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def filed_codes(x: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all leaves of all trees each row of ``x`` lies in, by row and code; a code has tree and leaf."""
    rows, codes = [], []
    for t, tree in enumerate(trees):
        at, leaves = tree.file(x)
        rows.append(at)
        codes.append(leaves + (t << _LEAF_BITS))
    rows, codes = np.concatenate(rows), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((codes, rows))
    return rows[order], codes[order]


def _least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least code that rows of ``a`` and ``b`` (ascending, padded with -1) share, -1 if none."""
    found, open_ = np.full(len(a), -1, dtype=np.int32), np.arange(len(a))
    for k in range(a.shape[1]):
        own = a[open_, k]
        hit = (own >= 0) & (b[open_] == own[:, None]).any(axis=1)
        found[open_[hit]] = own[hit]
        open_ = open_[~hit & (own >= 0)]
        if not len(open_):
            break
    return found


class _Kinds:
    """The leaves rows of ``x`` lie in, found when asked for; rows that lie in the same ones are of one kind."""

    def __init__(self, x: np.ndarray, trees: list[Tree]):
        self.x, self.trees = x, trees
        self.of = np.full(len(x), -1)
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, 0), dtype=np.int32)

    def _learn(self, rows: np.ndarray) -> None:
        at, codes = filed_codes(self.x[rows], self.trees)
        ends = np.searchsorted(at, np.arange(len(rows) + 1))
        own = [codes[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        before = len(self.known)
        self.of[rows] = [self.known.setdefault(c, len(self.known)) for c in own]
        fresh = [np.frombuffer(c, np.int32) for c in list(self.known)[before:]]
        table = np.full((len(self.known), max([self.table.shape[1], *map(len, fresh)])), -1, dtype=np.int32)
        table[:before, : self.table.shape[1]] = self.table
        for i, codes in enumerate(fresh, before):
            table[i, : len(codes)] = codes
        self.table = table

    def learn(self, rows: np.ndarray) -> None:
        if len(rows := rows[self.of[rows] < 0]):
            self._learn(rows)

    def first_meeting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least code of a leaf both rows lie in."""
        self.learn(np.unique(np.concatenate([a, b])))
        a, b = self.of[a], self.of[b]
        part = max(1, (32 << 20) // (4 * self.table.shape[1]))
        each = [_least_shared(self.table[a[k : k + part]], self.table[b[k : k + part]]) for k in range(0, len(a), part)]
        return np.concatenate(each)

    def earlier(self, rows: np.ndarray, here: int) -> np.ndarray | None:
        """Which of the leaves before ``here`` that any two ``rows`` share each lies in, as 0 and 1; None if too large."""
        self.learn(rows)
        own = self.table[self.of[rows]]
        at, k = np.nonzero((own >= 0) & (own < here))
        _, column, often = np.unique(own[at, k], return_inverse=True, return_counts=True)
        shared = np.cumsum(often > 1) - 1
        if len(rows) * (len(often) and int(shared[-1]) + 1) > LIES_IN:
            return None
        out = np.zeros((len(rows), int(shared[-1]) + 1 if len(often) else 0), dtype=np.float32)
        use = often[column] > 1
        out[at[use], shared[column[use]]] = 1
        return out


def _near(x: np.ndarray, narrow: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple]:
    """Pairs of rows of ``left`` and ``right`` with at least that cosine; each pair once if both are the same array.

    Single precision shows which can reach it, double precision tells. Where they are many, it gives rows,
    other rows, and a matrix of which are pairs.
    """
    same = left is right
    bound = least - (x.shape[1] + 8) * 2.0**-23  # twice what rounding can take off
    own = narrow[left]
    other = own if same else narrow[right]
    step = max(1, min(128, (4 << 20) // max(1, len(right))))
    part = max(1, (16 << 20) // (8 * x.shape[1]))
    for at in range(0, len(left), step):
        after = at if same else 0
        close = own[at : at + step] @ other[after:].T >= bound
        if same:
            k = len(close)
            close[:, :k] = np.triu(close[:, :k], 1)
        many = np.count_nonzero(close)
        if 16 * many > close.size:  # dense: all of them at once
            close &= x[left[at : at + step]] @ x[right[after:]].T >= least
            yield left[at : at + step], right[after:], close
        elif many:
            i, j = np.nonzero(close)
            a, b = left[at + i], right[after + j]
            sure = [np.einsum("ij,ij->i", x[a[k : k + part]], x[b[k : k + part]]) >= least for k in range(0, len(a), part)]
            sure = np.concatenate(sure)
            yield a[sure], b[sure], None


def _cell_links(x: np.ndarray, members: np.ndarray, halves: tuple | None, trees: list[Tree], node: int, least: float):
    """Links that first meet in leaves under a node of the last of ``trees``: members linked with each row, and the smallest row it reaches.

    ``halves``: which rows are of the first and of the second block, if two blocks of a cell are compared.
    """
    n, narrow, top = len(x), x.astype(np.float32), len(trees) - 1
    rows, leaves = trees[top].file(x, node)
    order = np.lexsort((rows, leaves))
    rows, leaves = rows[order], leaves[order]
    starts = np.flatnonzero(np.diff(leaves, prepend=-1))
    links, root, kinds = np.zeros(n), np.arange(n), _Kinds(x, trees)
    held: list[tuple] = []

    def settle():
        nonlocal links, root
        a, b, here = (np.concatenate(part) for part in zip(*held))
        held.clear()
        for at in range(0, len(a), HELD):
            pa, pb, ph = a[at : at + HELD], b[at : at + HELD], here[at : at + HELD]
            meet = kinds.first_meeting(pa, pb)
            new = (meet < 0) | (meet >= ph)
            pa, pb = pa[new], pb[new]
            if len(pa):
                links += np.bincount(pa, weights=members[pb], minlength=n) + np.bincount(pb, weights=members[pa], minlength=n)
                root = _roots(n, np.concatenate([pa, np.arange(n)]), np.concatenate([pb, root]))

    def settle_all(a, b, close, lies_in, rows):
        nonlocal root
        close &= lies_in[np.searchsorted(rows, a)] @ lies_in[np.searchsorted(rows, b)].T == 0
        if not close.any():
            return
        as_numbers = close.astype(np.float64)
        links[a] += as_numbers @ members[b]
        links[b] += members[a] @ as_numbers
        i, j = np.nonzero(close & (root[a][:, None] != root[b]))
        if len(i):
            root = _roots(n, np.concatenate([a[i], np.arange(n)]), np.concatenate([b[j], root]))

    waiting = 0
    for s, e in zip(starts, [*starts[1:], len(rows)]):
        mine, here, both = rows[s:e], leaves[s] + (top << _LEAF_BITS), None
        left, right = (mine, mine) if halves is None else (mine[halves[0][mine]], mine[halves[1][mine]])
        for a, b, close in _near(x, narrow, left, right, least):
            if close is not None:
                if both is None:
                    both = np.union1d(left, right)
                    lies_in = kinds.earlier(both, here)
                if lies_in is not None:
                    settle_all(a, b, close, lies_in, both)
                    continue
                i, j = np.nonzero(close)
                a, b = a[i], b[j]
            held.append((a, b, np.full(len(a), here)))
            waiting += len(a)
            if waiting >= HELD:
                settle()
                waiting = 0
    if waiting:
        settle()
    return links, root


def _parts(column, number) -> np.ndarray:
    """The parts of all vectors of a binary Arrow column, one after another."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, dtype=number)
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    return np.frombuffer(data, np.uint8)[ends[column.offset] : ends[column.offset + len(column)]].view(number)


def _pack(names: list[str], number):
    """Batches with ``names`` as they are, and ``embedding`` as ``size`` and the bytes of its parts, ``vector``."""

    def pack(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int32)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=number) + number(0)  # no -0.0
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) * flat.itemsize
            vectors = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sizes), vectors], [*names, "size", "vector"])

    return pack


def _by_length(batch, number) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors as a matrix) for each length of vector in a batch."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        column = batch.column("vector")
        yield size, at, _parts(column if len(at) == len(sizes) else column.take(at), number).reshape(len(at), size)


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each id: its bits mixed, modulo."""
    z = ids.astype(np.int64).view(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(blocks)).astype(np.int64)


@dataclass
class _Cells:
    """What passes need: the trees of each length of vector and the vectors a task may hold."""

    forest: Broadcast  # trees by length of vector
    number: type
    leaf: int
    block: int
    block_bytes: int

    def trees(self, size: int) -> list[Tree]:
        """Of a length the sample has none of: one leaf."""
        one = Tree(np.zeros((size, 0)), np.array([np.nan]), np.zeros(1, dtype=int), 0.0, np.zeros(1, dtype=int), np.zeros(1))
        return self.forest.value.get(size) or [one]

    def rows(self, size: int) -> int:
        return max(1, min(self.block, self.block_bytes // (size * np.dtype(self.number).itemsize)))

    def file(self, x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of ``x``: a cell is a leaf, or a node above that should fill most of a task, or a part of a small table."""
        most = min(2 * self.rows(x.shape[1]) // 3, max(8 * self.leaf, int(tree.holds[0]) // 24))
        return tree.file(x, most=most)

    def count(self, classes: DataFrame) -> list:
        """(size, code, rows) of all cells; a code has tree and node."""

        def tally(batches: Iterable):
            import pyarrow as pa

            for batch in batches:
                for size, _, x in _by_length(batch, self.number):
                    x = unit(x)
                    for t, tree in enumerate(self.trees(size)):
                        nodes, rows = np.unique(self.file(x, tree)[1], return_counts=True)
                        columns = [np.full(len(nodes), size, np.int32), (nodes + (t << _LEAF_BITS)).astype(np.int32), rows.astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["size", "code", "rows"])

        found = classes.select("size", "vector").mapInArrow(tally, "size int, code int, rows long")
        return sorted(tuple(r) for r in found.groupBy("size", "code").agg(F.sum("rows")).collect())

    def plan(self, counts: list, budget: float) -> Iterator[dict[int, tuple]]:
        """Passes: unit -> (size, code, first, second, blocks). A unit is a cell, or two blocks of one; those of a pass fit the budget."""
        units, taken = {}, 0.0
        for size, code, rows in counts:
            blocks = -(-rows // self.rows(size))
            each = rows / blocks * (size * np.dtype(self.number).itemsize + _ROW_BYTES)
            for first in range(blocks):
                for second in range(first, blocks):
                    cost = each * (1 + (first < second))
                    if units and taken + cost > budget:
                        yield units
                        units, taken = {}, 0.0
                    units[len(units)] = (size, code, first, second, blocks)
                    taken += cost
        if units:
            yield units

    def links(self, classes: DataFrame, units: dict[int, tuple], least: float) -> DataFrame:
        """(id, links, root) of vectors whose links first meet in these units."""
        whole: dict[tuple, dict[int, int]] = {}  # (size, tree) -> cell -> its unit
        dealt: dict[tuple, dict[int, list]] = {}  # (size, tree) -> cell -> units of two blocks
        for number, (size, code, first, second, blocks) in units.items():
            tree, node = (size, code >> _LEAF_BITS), code & ((1 << _LEAF_BITS) - 1)
            if blocks == 1:
                whole.setdefault(tree, {})[node] = number
            else:
                dealt.setdefault(tree, {}).setdefault(node, []).append((number, first, second, blocks))
        wanted = {*whole, *dealt}

        def send(batches: Iterable):
            import pyarrow as pa

            for batch in batches:
                ids = batch.column("id").to_numpy()
                for size, at, x in _by_length(batch, self.number):
                    x = unit(x)
                    for t, tree in enumerate(self.trees(size)):
                        if (size, t) not in wanted:
                            continue
                        rows, nodes = self.file(x, tree)
                        to = np.full(len(tree.cut), -1, dtype=np.int32)
                        if own := whole.get((size, t)):
                            to[[*own]] = [*own.values()]
                        picked = to[nodes] >= 0
                        sent = [(rows[picked], to[nodes[picked]])]
                        for node, pairs in dealt.get((size, t), {}).items():
                            mine = rows[nodes == node]
                            block = _block(ids[at[mine]], pairs[0][3])
                            for number, first, second, _ in pairs:
                                some = mine[(block == first) | (block == second)]
                                sent.append((some, np.full(len(some), number, dtype=np.int32)))
                        rows, to = (np.concatenate(part) for part in zip(*sent))
                        for k in range(0, len(rows), 20_000):
                            some = batch.take(pa.array(at[rows[k : k + 20_000]]))
                            columns = [pa.array(to[k : k + 20_000]), *(some.column(c) for c in ("id", "members", "vector"))]
                            yield pa.RecordBatch.from_arrays(columns, ["unit", "id", "members", "vector"])

        def compare(key, table):
            import pyarrow as pa

            size, code, first, second, blocks = units[key[0].as_py()]
            ids = table["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, members = ids[order], table["members"].to_numpy()[order]
            x = unit(_parts(table["vector"], self.number).reshape(len(ids), size)[order])
            halves = None
            if first < second:
                block = _block(ids, blocks)
                halves = block == first, block == second
            trees = self.trees(size)[: (code >> _LEAF_BITS) + 1]
            links, root = _cell_links(x, members, halves, trees, code & ((1 << _LEAF_BITS) - 1), least)
            some = links > 0
            columns = [ids[some], links[some].astype(np.int64), ids[root[some]]]
            return pa.Table.from_arrays([*map(pa.array, columns)], ["id", "links", "root"])

        copies = classes.select("id", "members", "size", "vector").mapInArrow(send, "unit int, id long, members long, vector binary")
        return materialize(copies.groupBy("unit").applyInArrow(compare, "id long, links long, root long"), "leaf-links")


def _hash(vector) -> F.Column:
    return F.xxhash64(vector)


def _usable(vector) -> F.Column:
    """Not null, not empty, no null or non-finite part, not zero."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame,
    least: float = LEAST,
    trees: int = TREES,
    leaf: int = LEAF,
    spill: float = SPILL,
    sample: int = SAMPLE,
    seed: int = 11,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one class with a count, so copies meet no one twice. Only vectors of the same
    length can link. The sample bounds the trees' depth: they part up to some
    ``sample`` / (8 * length * ``SMALLEST``) leaves, and a larger one is compared block by block, exactly
    but at growing cost. Null, zero or non-finite vectors and rows with a null vec_id link with nothing.
    Rows that repeat a vec_id count as vectors of their own, but share their component.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    number, parts_type = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    good = F.col("vec_id").isNotNull() & _usable(F.col("embedding"))
    # Rows that link with nothing have keys of their own, which no class has.
    key = F.when(good, _hash("embedding")).otherwise(F.xxhash64("vec_id", "embedding"))
    rows = vectors.select("vec_id", "embedding", good.alias("good"), key.alias("hash"))
    with shuffles_dropped(spark):
        draw = F.pmod(F.xxhash64("embedding", F.lit(seed)), F.lit(1 << 30)).cast("int")
        grouped = (
            rows.where("good")
            .groupBy("hash", "embedding")
            .agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("members"))
            .select("hash", "id", "members", draw.alias("draw"), F.col("embedding").cast(parts_type).alias("embedding"))
        )
        packed = _pack(["hash", "id", "members", "draw"], number)
        classes = materialize(grouped.mapInArrow(packed, "hash long, id long, members long, draw int, size int, vector binary"), "vector-classes")
        total, values = classes.agg(F.count("*"), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()
        forest = fit_forest(classes, number, total, values, trees, leaf, least, spill, sample, seed)
        sent = spark.sparkContext.broadcast(forest)  # once for all passes
        cells = _Cells(sent, number, leaf, BLOCK, BLOCK_BYTES)
        budget = max(PASS_BYTES, PASS * (values * np.dtype(number).itemsize + total * _ROW_BYTES))
        passes = [cells.links(classes, units, least) for units in cells.plan(cells.count(classes), budget)]
        sent.destroy()
        found = reduce(DataFrame.unionByName, passes, spark.createDataFrame([], "id long, links long, root long"))
        reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        twins = materialize(classes.groupBy("hash").count().where("count > 1").select("hash"), "twin-hashes")
        alone = twins.isEmpty()
    degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = (
        classes.select("hash", "id", "members", *([] if alone else ["vector"]))
        .join(degrees, "id", "left")
        .join(reached, "id", "left")
        .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("members") - 1)
        .withColumn("component", F.coalesce("component", "id"))
        .withColumn("good", F.lit(True))
        .drop("id", "members")
    )
    on = ["hash", "good"]
    if alone:  # no two vectors have one hash: it stands for the vector
        joined = rows.drop("embedding").join(named.hint("merge"), on, "left")
    else:
        twins = twins.withColumn("good", F.lit(True))
        twin = rows.join(twins, on, "left_semi").withColumn("embedding", F.col("embedding").cast(parts_type))
        kind = vectors.schema["vec_id"].dataType.simpleString()
        twin = twin.mapInArrow(_pack(["vec_id", "hash", "good"], number), f"vec_id {kind}, hash long, good boolean, size int, vector binary")
        wide = twin.drop("size").join(named.hint("merge"), [*on, "vector"], "left").drop("vector")
        rest = rows.drop("embedding").join(twins, on, "left_anti").join(named.drop("vector").hint("merge"), on, "left")
        joined = wide.unionByName(rest)
    component = F.coalesce("component", "vec_id").cast("long")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
