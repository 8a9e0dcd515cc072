"""Exact top-k search by inner product with cover trees on both sides.

Rows are dealt into chunks, queries into groups, both by the nearest of a few pivots, so each lies close together and
has a centre and a radius. A cover tree is built of every chunk and every group, once. No point of a reference node (or
of a whole chunk) scores more with any query of a query node (or of a whole group) than

    q.p + |q| R + |p| r + r R        (centres q and p, radii r and R).

A group first searches the chunk with the best centre, which gives each of its queries a k-th score to beat; then only
the chunks whose bound reaches the group's worst k-th score. Inside a pair of trees, a pair of nodes whose bound is
under the worst k-th score of the query node's queries is left; equal bounds stay, as ties go to the smaller id. The
chunks' lists are merged by rank.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import few_rows, map_groups, stored

SCALE = 256
TOP = 5
CHUNK = 1 << 19  # components in a chunk: 8192 rows of 64
GROUP = 1 << 16  # components in a group of queries
MOST_PIVOTS = 1024
TOGETHER = 32  # groups that one task searches in a chunk
BLOCK = 1024  # chunks and groups whose bounds are worked out at once
SHRINK = 1.6  # a child's radius is at most its parent's over this
LEAF = (16, 96)  # nodes of so few queries, or rows, are not divided,
THIN = (2, 12)  # nor those whose children would hold fewer on average
OPENED = 16  # nodes that are opened or compared before bounds are looked at again
LARGEST = 1 << 20  # under this size of scaled components products are exact in doubles, for vectors shorter than LONGEST
LONGEST = 1 << 13
WHOLE = 1 << 52  # doubles of this size or more are integers
OFFSET = 10**700  # more than any product of doubles: makes ordered texts of large scores


@dataclass
class CoverTree:
    """Nodes in breadth-first order; points are permuted so that each node's lie side by side."""

    points: np.ndarray
    ids: np.ndarray
    centre: np.ndarray  # index of a point, by node
    radius: np.ndarray  # largest distance from the centre to the node's points
    start: np.ndarray
    end: np.ndarray
    children: list[np.ndarray]  # node indices; empty for leaves

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF[1], thin: int = THIN[1]) -> CoverTree:
        order = np.arange(len(points))
        squares = (points * points).sum(1)

        def distances(c: int, members: np.ndarray) -> np.ndarray:
            d = squares[members] - 2 * (points[members] @ points[c]) + squares[c]
            return np.sqrt(np.maximum(d, 0))

        first = distances(0, order)
        nodes = [(0, float(first.max(initial=0)), 0, len(points))]
        children: list[np.ndarray] = []
        at = 0
        while at < len(nodes):
            c, radius, start, end = nodes[at]
            kids: list[int] = []
            if end - start > leaf and radius > 0:
                rest = order[start:end]
                rest = np.concatenate(([c], rest[rest != c]))
                near = radius / SHRINK
                net: list[tuple[int, float, np.ndarray]] = []
                while len(rest):  # greedy: centres are further apart than `near`
                    if len(net) >= 16 and end - start - len(rest) < len(net) * thin:
                        break  # points so far apart from each other that a net of them prunes nothing
                    d = distances(rest[0], rest)
                    inside = d <= near
                    inside[0] = True
                    net.append((int(rest[0]), float(d[inside].max()), rest[inside]))
                    rest = rest[~inside]
                place = start
                for centre, reach, mine in [] if len(rest) else net:
                    order[place : place + len(mine)] = mine
                    kids.append(len(nodes))
                    nodes.append((centre, reach, place, place + len(mine)))
                    place += len(mine)
            children.append(np.array(kids, np.int64))
            at += 1
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        centre, radius, start, end = (np.array(x) for x in zip(*nodes, strict=True))
        # Rounding of the distances must not make a radius too small.
        return cls(points[order], ids[order], where[centre], radius * (1 + 1e-9) + 1e-6, start, end, children)


class DualSearch:
    """The k best reference points for every query of a query tree; those under a query's floor may be missing."""

    def __init__(self, queries: CoverTree, rows: CoverTree, k: int = TOP, floor: np.ndarray | None = None) -> None:
        self.q, self.r, self.k = queries, rows, k
        self.floor = np.full(len(queries.ids), -np.inf) if floor is None else floor
        self.scores = np.full((len(queries.ids), k), -np.inf)
        self.found = np.full((len(queries.ids), k), np.iinfo(np.int64).max)
        self.centres = rows.points[rows.centre]
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.compared = 0

    def bounds(self, node: int, others: np.ndarray) -> np.ndarray:
        c = self.q.points[self.q.centre[node]]
        r = self.q.radius[node]
        R = self.r.radius[others]
        size = np.sqrt(c @ c)
        return self.centres[others] @ c + size * R + self.norms[others] * r + r * R + 1e-3 + 1e-12 * size * self.norms[others]

    def worst(self, node: int) -> float:
        s, e = self.q.start[node], self.q.end[node]
        return np.maximum(self.scores[s:e, -1], self.floor[s:e]).min()

    def run(self) -> DualSearch:
        if len(self.q.ids) and len(self.r.ids):
            stack = [(0, np.array([0]))]
            while stack:
                node, others = stack.pop()
                others = others[self.bounds(node, others) >= self.worst(node)]
                kids = self.q.children[node]
                if len(kids) and len(kids) < self.q.end[node] - self.q.start[node]:
                    stack += [(int(k), others) for k in kids[::-1]]
                else:
                    self.descend(node, others)
        return self

    def descend(self, node: int, others: np.ndarray) -> None:
        """Best bounds first; nodes with children are opened, the points of leaves are compared."""
        while len(others):
            bound = self.bounds(node, others)
            alive = bound >= self.worst(node)
            others, bound = others[alive], bound[alive]
            order = np.argsort(-bound, kind="stable")
            now, others = others[order[:OPENED]], others[order[OPENED:]]
            leaf = np.array([not len(self.r.children[o]) for o in now], bool)
            if leaf.any():
                self.compare(node, now[leaf])
            opened = [self.r.children[o] for o in now[~leaf]]
            if opened:
                others = np.concatenate([*opened, others])

    def compare(self, node: int, leaves: np.ndarray) -> None:
        s, e = self.q.start[node], self.q.end[node]
        columns = np.concatenate([np.arange(self.r.start[o], self.r.end[o]) for o in leaves])
        ids = self.r.ids[columns]
        for a in range(s, e, 256):
            b = min(a + 256, e)
            near = self.q.points[a:b] @ self.r.points[columns].T
            near[self.q.ids[a:b, None] == ids[None, :]] = -np.inf
            self.compared += near.size
            bar = np.maximum(self.scores[a:b, -1], self.floor[a:b])
            if near.shape[1] > self.k:
                bar = np.maximum(bar, np.partition(near, near.shape[1] - self.k, axis=1)[:, -self.k])
            row, col = np.nonzero((near >= bar[:, None]) & (near > -np.inf))
            rows = np.concatenate([row, np.repeat(np.arange(b - a), self.k)])
            scores = np.concatenate([near[row, col], self.scores[a:b].reshape(-1)])
            names = np.concatenate([ids[col], self.found[a:b].reshape(-1)])
            order = np.lexsort((names, -scores, rows))
            first = np.searchsorted(rows[order], np.arange(b - a))
            take = order[first[:, None] + np.arange(self.k)[None, :]]
            self.scores[a:b], self.found[a:b] = scores[take], names[take]


def integers(v: np.ndarray, raw: np.ndarray, scale: int) -> np.ndarray:
    """Scaled components as Python integers; `raw` has the components whose scaled value is beyond doubles."""
    return np.array([[int(c) if np.isfinite(c) else int(r) * scale for c, r in zip(x, y, strict=True)] for x, y in zip(v, raw, strict=True)], object)


def wide_search(queries: tuple[np.ndarray, ...], rows: tuple[np.ndarray, ...], k: int, scale: int) -> Iterator[tuple[int, int, int]]:
    """(query_id, row_id, score) of the k best rows of each query, for components of any size.

    queries, rows: ids, scaled vectors and raw vectors. Doubles with a bound of their error tell which rows can be
    among the best; those are compared in Python integers.
    """
    biggest = max(np.frexp(np.where(np.isfinite(v), v, 0))[1].max(initial=0) for _, v, _ in (queries, rows))
    if any(not np.isfinite(v).all() for _, v, _ in (queries, rows)):
        biggest = 1024 + scale.bit_length()
    small = lambda v, raw: np.where(np.isfinite(v), np.ldexp(np.where(np.isfinite(v), v, 0), -biggest), np.ldexp(raw, -biggest) * scale)
    p = small(rows[1], rows[2])
    size, d = np.abs(p).max(1), p.shape[1]
    exact: dict[int, np.ndarray] = {}
    for i in range(len(queries[0])):
        q = small(queries[1][i : i + 1], queries[2][i : i + 1])[0]
        others = np.flatnonzero(rows[0] != queries[0][i])
        near = p[others] @ q
        slack = (d + 8) * d * 2.0**-52 * np.abs(q).max() * size[others] + 1e-290
        if len(others) > k:
            low = near - slack
            others = others[near + slack >= np.partition(low, len(low) - k)[-k]]
        mine = integers(queries[1][i : i + 1], queries[2][i : i + 1], scale)[0]
        for j in others:
            if j not in exact:
                exact[j] = integers(rows[1][j : j + 1], rows[2][j : j + 1], scale)[0]
        best = sorted((-int(mine @ exact[j]), int(rows[0][j])) for j in others)[:k]
        yield from ((int(queries[0][i]), name, -score) for score, name in best)


def scaled(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, raw) of the vectors that take part: v holds floor(scale * x) as doubles.

    raw is x itself where a scaled component is beyond doubles, else null.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("x") > 0))
    v = F.transform("x", lambda x: F.when(F.abs(x * scale) >= WHOLE, x * scale).otherwise(F.floor(x * scale).cast("double")))
    beyond = F.exists("x", lambda x: F.abs(x * scale) == F.lit(float("inf")))
    rows = rows.select("id", v.alias("v"), F.when(beyond, F.col("x")).alias("raw"), F.size("x").alias("d"))
    return rows.withColumn("wide", (F.exists("v", lambda x: F.abs(x) >= LARGEST) | (F.col("d") >= LONGEST)).cast("int"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, row numbers, matrix) of the rows of each length, from the column v."""
    lengths = np.diff(batch.column("v").offsets.to_numpy())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def with_cells(rows: DataFrame, seed: str = "pivots") -> DataFrame:
    """Rows with `cell`, the number of their nearest pivot (0 without one of their length).

    Pivots are rows chosen by a hash of their ids, about one for each chunk and MOST_PIVOTS.
    """
    size = rows.agg(F.sum("d")).first()[0] or 0
    most = max(1, min(MOST_PIVOTS, -(-size // CHUNK)))
    pivots: dict[int, list] = {}
    for r in few_rows(rows.where("wide = 0").select("id", "v"), most, "id", seed):
        pivots.setdefault(len(r.v), []).append(list(r.v))
    shared = rows.sparkSession.sparkContext.broadcast({d: np.array(p) for d, p in pivots.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = {d: (p * p).sum(1) for d, p in shared.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                cell = np.zeros(batch.num_rows, np.int32)
                for d, mine, x in by_length(batch):
                    if d in squares and len(squares[d]) > 1:
                        cell[mine] = (squares[d][None, :] - 2 * (np.clip(x, -LARGEST, LARGEST) @ shared.value[d].T)).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, "id long, v array<double>, raw array<double>, d int, wide int, cell int")


BALL = "name string, d int, wide int, n long, centre array<double>, radius double, blob binary"


def balls(rows: DataFrame, size: int, side: int) -> DataFrame:
    """One row per group of queries (side 0) or chunk of rows (side 1) of about `size` components: its name, centre,
    radius and (pickled) its cover tree.

    Rows with components that are too large for exact doubles are in chunks of their own, which hold the plain rows.
    """
    keys = ["d", "wide", "cell"]
    parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * F.col("d") / size).alias("parts"))
    dealt = rows.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("id", F.lit(side)), F.col("parts"))).drop("parts")

    def build(table: pa.Table) -> Iterator[pa.RecordBatch]:
        d, wide, cell, part = (table.column(c)[0].as_py() for c in (*keys, "part"))
        ids = table.column("id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        if wide:
            raw = np.array([v if r is None else r for v, r in zip(x, table.column("raw").to_pylist(), strict=True)], np.float64)
            blob, centre, radius = pickle.dumps((ids, x, raw)), [], 0.0
        else:
            blob, centre = pickle.dumps(CoverTree.build(x, ids, LEAF[side], THIN[side])), x.mean(0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-6
        columns = [[f"{d}:{wide}:{cell}:{part}"], [d], [wide], [len(ids)], [list(centre)], [radius], [blob]]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "d", "wide", "n", "centre", "radius", "blob"])

    return map_groups(dealt.select("id", "v", "raw", *keys, "part"), [*keys, "part"], build, BALL)


def bound_blocks(groups: DataFrame, chunks: DataFrame, work, schema: str) -> DataFrame:  # noqa: ANN001
    """work(names, tables) on blocks of group balls and chunk balls of one length. One row stands for a whole ball."""
    sizes = chunks.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    counts = groups.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("rows"))
    number = lambda count: F.pmod(F.xxhash64("name"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = groups.join(sizes, "d").join(counts, "d").select("d", number("rows").alias("i"), every("blocks").alias("j"), F.lit(0).alias("side"), "name", "wide", "n", "centre", "radius", "worst")
    right = chunks.join(sizes, "d").join(counts, "d").select("d", every("rows").alias("i"), number("blocks").alias("j"), F.lit(1).alias("side"), "name", "wide", "n", "centre", "radius", F.lit(0.0).alias("worst"))

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side = table.column("side").to_numpy()
        if (side == 0).any() and (side == 1).any():
            table = table.combine_chunks()
            yield from work(*(table.take(pa.array(np.flatnonzero(side == s))) for s in (0, 1)))

    return map_groups(left.unionByName(right), ["d", "i", "j"], run, schema)


def centres(table: pa.Table) -> np.ndarray:
    """Centres as a matrix; zeros for the chunks of large components, whose bounds nobody asks for."""
    wide = table.column("wide").to_numpy() == 1
    d = int(table.column("d")[0].as_py())
    out = np.zeros((len(wide), d))
    if not wide.all():
        out[~wide] = table.column("centre").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return out


def home_chunks(groups: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(group, chunk): for each group, the chunk of more than k rows whose centre scores best with the group's."""

    def work(g: pa.Table, c: pa.Table) -> Iterator[pa.RecordBatch]:
        near = centres(g) @ centres(c).T
        near[:, (c.column("wide").to_numpy() == 1) | (c.column("n").to_numpy() <= k)] = -np.inf
        best = near.argmax(1)
        top = near[np.arange(len(near)), best]
        good = (g.column("wide").to_numpy() == 0) & (top > -np.inf)
        take = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays([g.column("name").combine_chunks().take(take), c.column("name").combine_chunks().take(pa.array(best[good])), pa.array(top[good])], ["name", "chunk", "near"])

    found = bound_blocks(groups, chunks, work, "name string, chunk string, near double")
    return found.groupBy("name").agg(F.max_by("chunk", F.struct("near", "chunk")).alias("chunk"))


def reachable(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, chunk): pairs of group and chunk whose bound reaches the group's worst k-th score."""

    def work(g: pa.Table, c: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = centres(g), centres(c)
        r, R = (t.column("radius").to_numpy()[:, None] for t in (g, c))
        bound = a @ b.T + np.linalg.norm(a, axis=1)[:, None] * R.T + np.linalg.norm(b, axis=1)[None, :] * r + r * R.T
        bound += 1e-3 + 1e-12 * np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        wide = (g.column("wide").to_numpy() == 1)[:, None] | (c.column("wide").to_numpy() == 1)[None, :]
        i, j = np.nonzero(wide | (bound >= g.column("worst").to_numpy()[:, None]))
        yield pa.RecordBatch.from_arrays([t.column("name").combine_chunks().take(pa.array(x)) for t, x in ((g, i), (c, j))], ["name", "chunk"])

    return bound_blocks(groups, chunks, work, "name string, chunk string")


LIST = [("query_id", pa.int64()), ("row_id", pa.int64()), ("score", pa.int64()), ("size", pa.int32()), ("text", pa.string())]
LIST_SQL = "query_id long, row_id long, score long, size int, text string"


def searched(queries: bytes, rows: bytes, wide: tuple[int, int], k: int, scale: int, floor: bytes | None = None) -> tuple[list, np.ndarray | None]:
    """Columns of LIST for one group and one chunk, and the k-th scores in the order of the group's tree."""
    q, r = pickle.loads(queries), pickle.loads(rows)
    if any(wide):
        q, r = ((t.ids, t.points, t.points) if isinstance(t, CoverTree) else t for t in (q, r))
        best = list(wide_search(q, r, k, scale))
        fits = [-(1 << 63) <= b[2] < 1 << 63 for b in best]
        columns = [[b[0] for b in best], [b[1] for b in best], [b[2] if f else None for b, f in zip(best, fits, strict=True)]]
        # size and text order the scores that a long cannot hold
        size = [0 if f else 1 if b[2] > 0 else -1 for b, f in zip(best, fits, strict=True)]
        return [*columns, size, [None if f else str(OFFSET + b[2]).zfill(701) for b, f in zip(best, fits, strict=True)]], None
    found = DualSearch(q, r, k, None if floor is None else np.frombuffer(floor)).run()
    good = found.scores > -np.inf
    n = int(good.sum())
    return [np.repeat(q.ids, k).reshape(-1, k)[good], found.found[good], found.scores[good].astype(np.int64), np.zeros(n, np.int32), [None] * n], found.scores[:, -1]


def list_batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, LIST, strict=True)], [n for n, _ in LIST])


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """The k best rows of the whole table for each query row, by the integer product of floor(scale * x).

    is_query: condition on the id column. Returns query_id, rank from 1, the id column, score; ties go to the
    smaller id; fewer than k rows where there are fewer. Rows with a query's id are its own and no candidates for
    it; where rows repeat an id, each is a candidate and the queries are one (the first by its components). Vectors
    that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id; only
    vectors of equal length are compared. Scores are exact for components of any size; one that a long cannot hold
    is null, and its rank is right all the same. Other columns are ignored; an empty table gives no rows. What a task
    holds is bounded by CHUNK, GROUP and TOGETHER, whatever the input.
    """
    rows = stored(with_cells(stored(scaled(table, id_col, vector_col, scale), "scaled")), "cells")
    asked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id").groupBy("id")
    asked = asked.agg(F.min(F.struct("v", "d", "raw", "wide", "cell")).alias("r")).select("id", "r.v", "r.raw", "r.d", "r.wide", "r.cell")
    chunks = stored(balls(rows, CHUNK, 1), "chunks")
    groups = stored(balls(asked, GROUP, 0), "groups")
    home = stored(home_chunks(groups.withColumn("worst", F.lit(0.0)), chunks, k), "homes")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, queries, rows = (batch.column(c)[i].as_py() for c in ("name", "queries", "rows"))
                columns, floor = searched(queries, rows, (0, 0), k, scale)
                arrays = [pa.array([c], pa.list_(t)) for c, (_, t) in zip(columns[:3], LIST, strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([float(floor.min())]), pa.array([floor.tobytes()], pa.binary()), *arrays], ["name", "worst", "floor", "query_id", "row_id", "score"])

    pairs = home.join(groups.select("name", F.col("blob").alias("queries")), "name").join(chunks.select(F.col("name").alias("chunk"), F.col("blob").alias("rows")), "chunk")
    begun = stored(pairs.select("name", "queries", "rows").mapInArrow(begin, "name string, worst double, floor binary, query_id array<long>, row_id array<long>, score array<long>"), "begun")
    known = stored(groups.join(begun.select("name", "worst", "floor"), "name", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")))), "known")
    near = stored(reachable(known, chunks).join(home, ["name", "chunk"], "left_anti"), "reachable")
    slots = max(1, -(-groups.count() // TOGETHER))
    near = near.withColumn("slot", F.pmod(F.xxhash64("name"), F.lit(slots)))
    left = near.join(known.select("name", "wide", "blob", "floor"), "name").select("chunk", "slot", F.lit(1).alias("side"), "wide", "blob", "floor")
    right = near.select("chunk", "slot").distinct().join(chunks.select(F.col("name").alias("chunk"), "wide", "blob"), "chunk").select("chunk", "slot", F.lit(0).alias("side"), "wide", "blob", F.lit(None).cast("binary").alias("floor"))

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, wide = table.column("side").to_numpy(), table.column("wide").to_numpy()
        blob, floor = table.column("blob"), table.column("floor")
        at = int(np.flatnonzero(side == 0)[0])
        for i in np.flatnonzero(side == 1).tolist():
            yield list_batch(searched(blob[i].as_py(), blob[at].as_py(), (int(wide[i]), int(wide[at])), k, scale, floor[i].as_py())[0])

    lists = map_groups(left.unionByName(right), ["chunk", "slot"], search, LIST_SQL)
    first = begun.select(F.explode(F.arrays_zip("query_id", "row_id", "score")).alias("l")).select("l.*", F.lit(0).alias("size"), F.lit(None).cast("string").alias("text"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("score"), F.desc("text"), "row_id"))
    return lists.unionByName(first).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias(id_col), "score")
