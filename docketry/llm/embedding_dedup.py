"""Near duplicates of embeddings by NN-descent.

Vectors of one label are neighbours to be. Every vector begins with the nearest ones in its buckets of signed random
projections; in each round, neighbours of neighbours (both ways) meet in the lists' joins and the best stay.
Equal vectors are one from the start and count as often as they occur. Lists that end up full of links are enlarged:
vectors with full lists are compared exactly across components wherever a link is possible, and then the components
they lie in block by block, so a vector may have any number of links. Recall is audited against exact neighbours of a
stated share of vectors; if it stays too low, all vectors of a label are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import few_rows, map_groups, stored
from docketry.llm.graph import components

LEAST = 0.93
NEIGHBOURS = 12
ROUNDS = 5
SETTLED = 0.002  # share of new neighbours under which the rounds end
TABLES = 5  # of signed random projections for the first lists
BUCKET = 512  # vectors that a bucket of the first lists is meant to hold
CHUNK = 1024  # vectors on either side of a block, and in a bucket at most
AUDIT = 256  # vectors whose links are found exactly, over all rows, to measure recall
ENOUGH = 0.98  # recall under which more tables and rounds follow, and after them the exact comparison
ATTEMPTS = 3
NEAR = 1e-3  # lists keep single-precision cosines; pairs so near the threshold are computed again


def usable(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the vectors that may link; vectors of unlike length never share a label."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(fine & finite).where(F.exists("v", lambda x: x != 0))
    return rows.select("id", F.concat(F.size("v").cast("string"), F.lit("|"), "label").alias("label"), F.col("v").cast("array<float>" if dict(table.dtypes)[vector_col] == "array<float>" else "array<double>").alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length 1, in double precision, of a list column whose lists are alike in length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def batch_of(schema: list[tuple[str, pa.DataType]], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


EDGE = [("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float32())]
EDGE_SQL = "a long, b long, sim float"


def first_lists(vectors: DataFrame, seed: int, k: int) -> DataFrame:
    """Edges (a, b, sim): each vector's nearest in its buckets of random projections.

    A label's buckets have as many bits as make them hold about BUCKET vectors; one that holds more than CHUNK is
    dealt into parts by the ids' hash, another way in each table.
    """
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = vectors.join(sizes, "label").withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BUCKET))).cast("int")).drop("n")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lengths = np.diff(batch.column("v").offsets.to_numpy())
                for d in np.unique(lengths):
                    part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                    if d not in planes:
                        planes[d] = np.random.default_rng([seed, int(d)]).normal(size=(int(d), TABLES * 24))
                    signs = (matrix(part.column("v")) @ planes[d] > 0).reshape(part.num_rows, TABLES, 24)
                    bits = np.minimum(part.column("bits").to_numpy(zero_copy_only=False), 24)
                    mask = np.arange(24)[None, None, :] < bits[:, None, None]
                    codes = ((signs & mask) << np.arange(24)).sum(2)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("v"), pa.array(codes.tolist(), pa.list_(pa.int64()))], ["id", "label", "v", "codes"])

    kind = dict(vectors.dtypes)["v"]
    coded = stored(rows.mapInArrow(code, f"id long, label string, v {kind}, codes array<long>"), "codes")
    dealt = coded.select("id", "label", F.posexplode("codes").alias("t", "code"))
    full = dealt.groupBy("label", "t", "code").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CHUNK)
    spread = coded.select("id", "label", "v", F.posexplode("codes").alias("t", "code")).join(full, ["label", "t", "code"], "left")
    part = F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.coalesce(F.ceil(F.col("c") * 2 / CHUNK), F.lit(1)))
    spread = spread.withColumn("part", part.cast("long")).withColumn("bucket", F.xxhash64("label", "t", "code"))

    def nearest(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
        m = min(k, len(ids) - 1)
        if m < 1:
            return
        for at in range(0, len(ids), 256):
            near = x[at : at + 256] @ x.T
            near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
            top = np.argpartition(-near, m - 1, axis=1)[:, :m]
            yield batch_of(EDGE, np.repeat(ids[at : at + 256], m), ids[top].reshape(-1), np.take_along_axis(near, top, 1).reshape(-1))

    return map_groups(spread.select("label", "bucket", "part", "id", "v"), ["label", "bucket", "part"], nearest, EDGE_SQL).where("a <> b")


def best(edges: DataFrame, k: int) -> DataFrame:
    """Of edges (a, b, sim, fresh), each vector's k nearest; an edge that was there before is not fresh."""
    merged = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return merged.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def refined(vectors: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Edges between neighbours of one vector, wherever they beat the worst neighbour of their first end.

    Each vector's neighbours, and the k nearest of those whose neighbour it is, meet with their vectors; pairs of
    which both were there before are left out.
    """
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("x"), "sim", "fresh")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "x"))).where(F.col("r") <= k).drop("r", "sim")
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("x"), "fresh").unionAll(back).groupBy("u", "x").agg(F.min("fresh").alias("fresh"))
    worst = edges.groupBy("a").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("c")).select(F.col("a").alias("x"), F.when(F.col("c") >= k, F.col("worst")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
    active = around.groupBy("u").agg(F.max("fresh").alias("f")).where("f = 1").select("u")
    rows = around.join(active, "u").join(worst, "x").join(vectors.select(F.col("id").alias("x"), "v"), "x").select("u", "x", "fresh", "worst", "v")

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, fresh, worst = (table.column(c).to_numpy() for c in ("x", "fresh", "worst"))
        x = matrix(table.column("v"))
        near = (x @ x.T).astype(np.float32)
        a, b = np.nonzero((near > worst[:, None]) & ((fresh[:, None] + fresh[None, :]) > 0) & (ids[:, None] != ids[None, :]))
        if len(a):
            yield batch_of(EDGE, ids[a], ids[b], near[a, b])

    return map_groups(rows, ["u"], meet, EDGE_SQL)


def descend(vectors: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Rounds of NN-descent, until few neighbours change."""
    edges = stored(best(edges.withColumn("fresh", F.lit(1)), k), "lists")
    for _ in range(ROUNDS):
        found = refined(vectors, edges, k).withColumn("fresh", F.lit(1))
        edges = stored(best(edges.withColumn("fresh", F.lit(0)).unionByName(found), k), "lists")
        fresh, total = edges.agg(F.sum("fresh"), F.count(F.lit(1))).first()
        if (fresh or 0) <= SETTLED * total:
            break
    return edges


def exact_links(vectors: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of the edges whose cosine in double precision is `least` or more."""
    pairs = edges.where(F.col("sim") >= least - NEAR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: vectors.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                lengths = np.diff(batch.column("v_a").offsets.to_numpy())
                for d in np.unique(lengths):
                    part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                    good = (matrix(part.column("v_a")) * matrix(part.column("v_b"))).sum(1) >= least
                    yield part.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


def squares(rows: DataFrame, by: str) -> DataFrame:
    """Each row once on side 0 and once on side 1 of every block (i, j) of its group that it is compared in.

    A group is dealt into chunks of about CHUNK rows by the ids' hash, so a block has about that many on either side.
    """
    sizes = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    rows = rows.join(sizes, by).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    every = lambda i, j, side: F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct((c if i is None else i).alias("i"), (c if j is None else j).alias("j"), F.lit(side).alias("side")))
    dealt = rows.withColumn("at", F.explode(F.concat(every(F.col("chunk"), None, 0), every(None, F.col("chunk"), 1))))
    return dealt.select("*", "at.i", "at.j", "at.side").drop("at", "chunk", "chunks")


def enlarged(vectors: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(id, n_links): links of every member within its component, counted block by block.

    members: (id, component) of the components to look through. A vector counts as often as it occurs (column w). A
    block compares at most about CHUNK by CHUNK vectors and gives sums only, so a component of any size is counted
    with bounded memory.
    """
    blocks = squares(members.join(vectors.select("id", "v", "w"), "id"), "component")

    def count(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, ids, w = (table.column(c).to_numpy() for c in ("side", "id", "w"))
        x = matrix(table.column("v"))
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for at in range(0, len(own), 256):
            o = own[at : at + 256]
            links = ((x[o] @ x[other].T >= least) & (ids[o][:, None] != ids[other][None, :])) @ w[other]
            yield batch_of([("id", pa.int64()), ("n_links", pa.int64())], ids[o], links)

    return map_groups(blocks, ["component", "i", "j"], count, "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links"))


def bridges(vectors: DataFrame, full: DataFrame, least: float) -> DataFrame:
    """(a, b): components that a link between two vectors with full lists joins.

    full: (id, component) of the vectors whose lists hold nothing but links. Only two of them can have a link that is
    in neither list. They lie in units of one component and about CHUNK vectors; a unit has a centre and a radius (an
    angle), and two units whose centres are further apart than both radii and the threshold's angle have no link.
    All other pairs of units are compared, exactly.
    """
    sizes = full.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    rows = full.join(sizes, "component").join(vectors.select("id", "label", "v"), "id")
    rows = rows.withColumn("unit", F.xxhash64("component", F.pmod(F.xxhash64("id"), F.col("chunks"))))
    rows = stored(rows.select("label", "component", "unit", "id", "v"), "full")

    def ball(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x = matrix(table.column("v"))
        mean = x.sum(0)
        size = np.sqrt(mean @ mean)
        centre = mean / size if size > 1e-6 else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        first = [table.column(c)[0].as_py() for c in ("label", "component", "unit")]
        yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array(first[1:2], pa.int64()), pa.array(first[2:], pa.int64()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])], ["label", "component", "id", "v", "radius"])

    balls = map_groups(rows, ["label", "component", "unit"], ball, "label string, component long, id long, v array<double>, radius double")
    reach = float(np.arccos(least)) + 1e-6  # rounding must not part units that touch

    def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, ids, component, radius = (table.column(c).to_numpy() for c in ("side", "id", "component", "radius"))
        x = matrix(table.column("v"))
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for at in range(0, len(own), 256):
            o = own[at : at + 256]
            angle = np.arccos(np.clip(x[o] @ x[other].T, -1, 1))
            touch = (angle <= radius[o][:, None] + radius[other][None, :] + reach) & (component[o][:, None] < component[other][None, :])
            a, b = np.nonzero(touch)
            yield batch_of([("a", pa.int64()), ("b", pa.int64())], ids[o][a], ids[other][b])

    pairs = stored(map_groups(squares(stored(balls, "balls"), "label"), ["label", "i", "j"], near, "a long, b long"), "touching")
    side = lambda c, n: pairs.join(rows.withColumnRenamed("unit", c), c).select("a", "b", F.lit(n).alias("side"), "component", "v")

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, component = table.column("side").to_numpy(), table.column("component").to_numpy()
        x = matrix(table.column("v"))
        own, other = x[side == 0], x[side == 1]
        if any((own[at : at + 256] @ other.T >= least).any() for at in range(0, len(own), 256)):
            yield batch_of([("a", pa.int64()), ("b", pa.int64())], component[side == 0][:1], component[side == 1][:1])

    return map_groups(side("a", 0).unionByName(side("b", 1)), ["a", "b"], meet, "a long, b long").distinct()


def joined(linked: DataFrame, more: DataFrame) -> DataFrame:
    """linked (id, component), with the components that the pairs of `more` (a, b) join made one."""
    if more.isEmpty():
        return linked
    to = components(more).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return linked.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))


def all_links(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join what all links join, found by comparing all vectors of a label block by block.

    Of a block's links only a forest leaves it, so a block gives fewer rows than it has vectors.
    """

    def forest(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        x = matrix(table.column("v"))
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        link = np.concatenate([x[own[at : at + 256]] @ x[other].T >= least for at in range(0, max(1, len(own)), 256)])
        low = ids[own]
        while True:  # both sides take the smallest id that they reach, until nothing changes
            right = np.minimum(ids[other], np.where(link, low[:, None], ids.max()).min(0, initial=ids.max()))
            left = np.minimum(low, np.where(link, right[None, :], ids.max()).min(1, initial=ids.max()))
            if (left == low).all():
                break
            low = left
        a, b = np.concatenate([ids[own], ids[other]]), np.concatenate([low, right])
        yield batch_of([("a", pa.int64()), ("b", pa.int64())], a[a != b], b[a != b])

    return map_groups(squares(vectors.select("label", "id", "v"), "label"), ["label", "i", "j"], forest, "a long, b long").distinct()


def recall_of(vectors: DataFrame, found: DataFrame, least: float) -> float | None:
    """Share of the audited vectors' links that `found` counts. Where none of the sample has links, vectors with links
    are sampled instead; without any the recall is not known."""
    there, got = audit(vectors, vectors, found, least)
    if not there:
        there, got = audit(vectors, vectors.join(found.where("n_links > 0").select("id"), "id", "left_semi"), found, least)
    return got / there if there else None


def audit(vectors: DataFrame, among: DataFrame, found: DataFrame, least: float, sample: int = AUDIT) -> tuple[int, int]:
    """Links that a few vectors have, compared exactly with all rows, and how many of them `found` counts.

    The sample is about `sample` vectors of `among`, chosen by a hash of their ids; it is collected and broadcast.
    """
    asked = few_rows(among.select("id", "label", "v"), sample, "id", "audit")
    if not asked:
        return 0, 0
    shared = vectors.sparkSession.sparkContext.broadcast([(r.id, r.label, [float(x) for x in r.v]) for r in asked])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list] = {}
        for row in shared.value:
            by.setdefault(row[1], []).append(row)
        total = {row[0]: 0 for row in shared.value}
        for whole in batches:
            labels = np.array(whole.column("label").to_pylist(), object)
            for label, rows in by.items():
                mine = np.flatnonzero(labels == label)
                if len(mine):
                    part = whole.take(pa.array(mine))
                    q = np.array([r[2] for r in rows])
                    q = q / np.abs(q).max(1, keepdims=True)
                    q = q / np.sqrt((q * q).sum(1, keepdims=True))
                    same = np.array([r[0] for r in rows])[:, None] == part.column("id").to_numpy(zero_copy_only=False)[None, :]
                    for r, n in zip(rows, ((q @ matrix(part.column("v")).T >= least) & ~same).sum(1), strict=True):
                        total[r[0]] += int(n)
        yield batch_of([("id", pa.int64()), ("n", pa.int64())], np.array(list(total)), np.array(list(total.values())))

    true = vectors.select("id", "label", "v").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    both = true.join(found, "id", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("n_links", F.lit(0))))).first()
    return int(both[0] or 0), int(both[1] or 0)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, k: int = NEIGHBOURS) -> DataFrame:
    """Links between vectors of one label whose cosine, in double precision, is `least` or more.

    Returns one row per input row: the id column (as long), n_links (other vectors linked directly), component_id
    (the smallest id reachable), kept (id = component_id) and audit_recall (share of the audited vectors' links that
    were counted; null where no vector of either sample has any). Vectors that are null, empty, zero, or hold null or non-finite components,
    and rows with a null label or id, link with nothing; a row with a null id has a null component and is kept; rows
    that repeat an id count as one vector, the first in order of its components; other columns are ignored; an
    empty table gives no rows.
    """
    every = usable(table, id_col, vector_col, label_col)
    every = stored(every.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "vectors")
    vectors = stored(every.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "distinct")
    copies = vectors.where("w > 1").select("label", "v", F.col("id").alias("first"))
    members = stored(every.join(copies, ["label", "v"], "left").select(F.coalesce("first", "id").alias("first"), "id"), "members")

    def found_of(linked: DataFrame, n_links: DataFrame) -> DataFrame:
        own = vectors.select("id", "w").join(linked, "id", "left").join(n_links, "id", "left")
        own = own.select(F.col("id").alias("first"), F.coalesce("component", "id").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
        return stored(members.join(own, "first").select("id", "component", "n_links"), "found")

    edges, recall = None, None
    for attempt in range(ATTEMPTS):
        start = first_lists(vectors, 17 + attempt, k)
        edges = descend(vectors, start if edges is None else start.unionByName(edges.select("a", "b", "sim")), k)
        links = stored(exact_links(vectors, edges, least), "exact")
        linked = stored(components(links), "linked").select(F.col("node").alias("id"), "component")
        saturated = stored(edges.groupBy("a").agg(F.count_if(F.col("sim") >= least - NEAR).alias("c")).where(F.col("c") >= k).select(F.col("a").alias("id")), "saturated")
        if not saturated.isEmpty():
            own = vectors.select("id").join(saturated, "id", "left_semi").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
            more = stored(bridges(vectors, own, least), "bridges")
            linked = stored(joined(linked.unionByName(own).distinct(), more), "joined")
        large = linked.join(saturated, "id", "left_semi").select("component").distinct()
        counted = enlarged(vectors, linked.join(large, "component", "left_semi"), least)
        ends = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionAll(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
        plain = ends.join(vectors.select(F.col("id").alias("to"), "w"), "to").groupBy("id").agg(F.sum("w").alias("few"))
        found = found_of(linked, plain.join(counted, "id", "full").select("id", F.coalesce("n_links", "few").alias("n_links")))
        recall = recall_of(every, found.select("id", "n_links"), least)
        if recall is None or recall >= ENOUGH:
            break
    else:
        linked = stored(components(all_links(vectors, least)), "linked").select(F.col("node").alias("id"), "component")
        found = found_of(linked, enlarged(vectors, linked, least))
        recall = recall_of(every, found.select("id", "n_links"), least)
    rows = table.select(F.col(id_col).cast("long").alias("id"))
    out = rows.join(found, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))
