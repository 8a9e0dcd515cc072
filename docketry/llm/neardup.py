"""Near duplicates by SetSketch: band registers, estimate jointly, verify on full shingle sets, join up.

1. One pass over the texts gives each document's set size, the fingerprint of its shingle set and its registers.
   Documents with one fingerprint are a class; from here on its smallest id stands for it. Sets so small that no
   other set can be similar enough stay out of what follows.
2. Classes with the same registers in a band meet in a bucket. Every member is compared with the bucket's head
   (a member chosen by hash, another one in each bucket), so no bucket is expanded into pairs.
3. A pair whose likeliest similarity given both sketches is high enough is verified on the full sets; verified links
   make components. Texts are read again for such pairs alone, and never shuffled: a bit for each row of a file tells
   the scan which texts are wanted.
4. Where members of a bucket are still in several components, those outside the largest one are compared with all
   members of other components: blocks of sketches against blocks of sketches, in which only likely pairs come
   out, each from the first band that it shares. They are verified too, and the components joined.
5. A few documents are compared exactly with all others in the first pass; the share of their links that ended in
   one component is the audited recall.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import few_rows, frugal, marked_rows, marks, positioned, stored
from docketry.llm.graph import components
from docketry.llm.setsketch import SHINGLE, Shingler, Sketcher, band_keys, fingerprint, likely

REGISTERS = 384
BANDS, ROWS = 25, 5  # a pair at 0.8 shares no band once in 20,000 times
SLACK = 0.06  # a pair is verified if its estimate is at most so much too low: three deviations of the estimate
CHUNK = 1024  # sketches on either side of a block
AUDIT, AUDIT_BYTES = 512, 32_768  # audited documents, and the largest text that is audited


def audited_sets(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of about AUDIT documents (id, text): sorted shingles, the set each is of, sizes.

    About AUDIT texts of up to AUDIT_BYTES are collected and broadcast, whatever the input.
    """
    some = few_rows(docs.where(F.col("id").isNotNull()).select("id", F.when(F.octet_length("text") <= AUDIT_BYTES, F.col("text")).alias("text")), AUDIT, "id", "audit")
    sets = [Shingler(size)(r.text) for r in some]
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], np.array([len(s) for s in sets], np.int64)


def audit_links(shingles: np.ndarray, audited: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Numbers k of the audited sets that are similar enough to this one; -1 - k for those that are the same."""
    known, owner, sizes = audited
    lo, hi = np.searchsorted(known, shingles, "left"), np.searchsorted(known, shingles, "right")
    both = np.zeros(len(sizes), np.int64)
    hit = hi > lo
    for a, b in zip(lo[hit].tolist(), hi[hit].tolist(), strict=True):
        both[owner[a:b]] += 1
    union = sizes + len(shingles) - both
    near = np.flatnonzero((both > 0) & (100 * both >= percent * union))
    return np.where(both[near] == union[near], -1 - near, near)


def prints(docs: DataFrame, size: int, percent: int, kind: str) -> DataFrame:
    """(id, n, fp, sketch, audit, __file, __row) of positioned rows (id, text, __file, __row).

    fp and sketch are null for texts without words; audit holds the numbers of the audited sets that it is linked to.
    """
    shared = docs.sparkSession.sparkContext.broadcast(audited_sets(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher, audited = Shingler(size), Sketcher(REGISTERS), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingler(t.as_py()) for t in batch.column(1)]
                columns = [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketcher(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([audit_links(s, audited, percent).tolist() for s in sets], pa.list_(pa.int32())),
                    batch.column(2),
                    batch.column(3),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "fp", "sketch", "audit", "__file", "__row"])

    return docs.select("id", "text", "__file", "__row").mapInArrow(frugal(run), kind)


def sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), np.uint16).reshape(len(column), REGISTERS)


def bands(classes: DataFrame) -> DataFrame:
    """(band, key, rep) of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                keys = band_keys(sketches_of(batch.column(1))[:, : BANDS * ROWS], ROWS)
                reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), pa.array(keys.reshape(-1)), pa.array(reps)], ["band", "key", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "band int, key long, rep long")


def likely_pairs(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose likeliest similarity is `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
                good = likely(sketches_of(batch.column(4)), sketches_of(batch.column(5)), n_a, n_b, least)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda x: sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return joined.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets share percent / 100 of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.intersect1d(a, b, assume_unique=True).size
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"s_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(frugal(run), "a long, b long")


def full_sets(docs: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(rep, set) of the documents at `places` (__file, __row): the texts are read again where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["rep", "set"])

    work = lambda rows: rows.select("id", "text").mapInArrow(frugal(run), "rep long, set binary")
    return stored(marked_rows(docs, marks(places), "sets", work), "sets")


def cross_pairs(members: DataFrame, sketches: DataFrame, linked: DataFrame, least: float) -> DataFrame:
    """Likely pairs across the components that still share a bucket.

    members: (key, band, rep); linked: (node, component). Work in a bucket is its members outside the largest
    component times all its members, in blocks of CHUNK by CHUNK; what is held at once never grows.
    """
    placed = members.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = stored(placed, "placed")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c")).where("parts > 1")
    chunks = F.ceil(F.col("c") / CHUNK).cast("int")
    rows = placed.join(open_.select("key", "main", chunks.alias("chunks")), "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(k.alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("side")))
    outside = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.col("chunk").alias("i"), k.alias("j"), F.lit(0).alias("side")))
    blocks = rows.withColumn("at", F.explode(F.when(F.col("component") == F.col("main"), every).otherwise(F.concat(every, outside))))
    blocks = blocks.select("key", "at.i", "at.j", "at.side", "band", "component", "rep").join(sketches, "rep")
    names = ["key", "i", "j", "side", "band", "component", "rep", "n", "sketch"]
    dealt = blocks.select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def compare(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        side, band, part, rep, n = (group.column(c).to_numpy() for c in ("side", "band", "component", "rep", "n"))
        sketch = sketches_of(group.column("sketch"))
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for o in own:
            near = other[(part[other] != part[o]) & (np.minimum(n[other], n[o]) >= least * np.maximum(n[other], n[o]))]
            if len(near):
                s, t = np.broadcast_to(sketch[o], (len(near), REGISTERS)), sketch[near]
                near = near[likely(s, t, np.full(len(near), float(n[o])), n[near].astype(float), least)]
                if len(near):
                    shared = (sketch[near][:, : BANDS * ROWS] == sketch[o][: BANDS * ROWS]).reshape(len(near), BANDS, ROWS).all(2)
                    near = near[shared.argmax(1) == band[o]]
                    yield np.minimum(rep[near], rep[o]), np.maximum(rep[near], rep[o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            found = list(compare(table.combine_chunks()))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        last = None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], 1)
            starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist()]
            for at, end in zip(starts, [*starts[1:], len(marks)], strict=True):
                mark = tuple(marks[at])
                if held and mark != last:
                    yield from done(pa.Table.from_batches(held))
                    held = []
                last = mark
                held.append(batch.slice(at, end - at))
        if held:
            yield from done(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def small(percent: int) -> int:
    """Sets of up to so many shingles are similar enough to equal sets only."""
    return -(-percent // (100 - percent)) - 1 if percent < 100 else sys.maxsize


def linked_rows(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, float | None]:
    """Positioned rows (id, text, __file, __row); the same rows without text but with n, fp, component_id; recall."""
    least = percent / 100 - SLACK
    rows = positioned(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    printed = stored(prints(rows, size, percent, "id long, n long, fp binary, sketch binary, audit array<int>, __file string, __row long"), "prints")
    classes = printed.where("n > 0 and id is not null").groupBy("fp").agg(F.min(F.struct("id", "__file", "__row")).alias("r"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("fp", F.col("r.id").alias("rep"), "r.__file", "r.__row", "n", "sketch", "copies"), "classes")
    sketches = classes.where(F.col("n") > small(percent)).select("rep", "n", "sketch")
    banded = bands(sketches)
    heads = banded.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", "key")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stored(banded.join(heads, "key").select("key", "band", "rep", "head"), "members")
    first = members.where("rep <> head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    first = stored(likely_pairs(first, sketches, least), "likely")
    ends = lambda pairs: pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).distinct()
    place = classes.select("rep", "__file", "__row")
    sets = full_sets(rows, place.join(ends(first), "rep", "left_semi"), size)
    linked = stored(components(verified(first, sets, percent)), "linked")
    cross = stored(cross_pairs(members.select("key", "band", "rep"), sketches, linked, least), "cross")
    more = place.join(ends(cross), "rep", "left_semi").join(sets.select("rep"), "rep", "left_anti")
    more = verified(cross, sets.unionByName(full_sets(rows, more, size)), percent)
    joined = more.join(linked.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(linked.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    upper = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    whole = linked.unionAll(upper.select("node", F.col("node").alias("component"))).distinct()
    whole = whole.join(upper.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    whole = whole.groupBy("node").agg(F.min(F.coalesce("top", "component")).alias("component"))
    placed = classes.select("fp", "rep", "copies").join(whole.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or component <> rep").select("fp", F.coalesce("component", "rep").alias("component_id"))
    keyed = printed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("fp")).alias("fp"), "audit", "__file", "__row").join(placed, "fp", "left")
    found = stored(keyed.withColumn("component_id", F.coalesce("component_id", "id")), "found")
    near = found.where("id is not null").select(F.explode("audit").alias("k"), "component_id")
    own = near.where("k < 0").groupBy((-1 - F.col("k")).alias("k")).agg(F.min("component_id").alias("own"))
    there, got = near.where("k >= 0").join(own, "k").agg(F.count(F.lit(1)), F.count_if(F.col("component_id") == F.col("own"))).first()
    return rows, found.drop("audit"), got / there if there else None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of word shingles share percent / 100 of their union or more.

    Words are runs of anything but ASCII blanks, A-Z lowered; a text of fewer than `size` words is one shingle.
    Returns per input row: the id column (as long), n_shingles, component_id (the smallest id reachable over links, the
    row's own id included), kept (id = component_id) and audit_recall (share of the audited documents' links to
    different texts that lie within one component; null if they have none). A null or empty text, or one of blanks,
    has no shingles and links with nothing. A row with a null id links with nothing, has a null component_id and is
    kept. Rows that repeat an id are linked by their texts. Other columns are ignored; an empty table gives no rows.
    """
    _, found, recall = linked_rows(docs, id_col, text_col, size, percent)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept, F.lit(recall).cast("double").alias("audit_recall"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = 80, most_marks: int | None = None) -> DataFrame:
    """The rows of docs, whole, less all but the one with the smallest id of each component.

    Rows without an id all stay; where rows repeat an id, one row of each set of shingles stays. No text is shuffled.
    """
    rows = positioned(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")))
    field = lambda c, name: F.col("__doc").getField(c).alias(name)
    _, found, _ = linked_rows(rows.select(field(id_col, "id"), field(text_col, "text")), "id", "text", size, percent)
    once = found.where("id = component_id").groupBy("id", "fp").agg(F.min(F.struct("__file", "__row")).alias("r")).select("r.*")
    kept = once.unionByName(found.where("id is null").select("__file", "__row"))
    return marked_rows(rows, marks(kept), "kept", lambda r: r.select("__doc.*"), most_marks)
