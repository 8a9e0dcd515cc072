"""Small profiles of texts and records: size estimates, copy comparison, modes, agreement of fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docketry.session import settled


def size_estimate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words between blanks, and tokens at four characters each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))
    return docs.select(id_col, words.cast("long").alias("n_words"), F.expr(f"length(coalesce({text_col}, '')) div 4").alias("n_tokens"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha, n_copies, first_id) of texts that occur more than once, byte for byte."""
    return docs.groupBy(F.sha2(F.col(text_col), 256).alias("sha")).agg(F.count(F.lit(1)).alias("n_copies"), F.min(id_col).alias("first_id")).where("n_copies > 1")


#: Classes that a block has, about. The counts of two blocks are made for so many cells at once.
PART, CELLS = 8192, 1 << 23


def line_overlap(docs: DataFrame, least_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, shared, similarity): documents that share lines, by the multiset of their lines.

    The similarity is 2 * shared / (lines of a + lines of b). Documents with equal lines are one class, for which its
    smallest id stands: there is a row for every two classes that share enough lines, whatever the lines' numbers of
    documents, and one for each class and each of its other documents (with similarity 1).

    Classes with fewer common lines than that are in no pair. The others are dealt into blocks, and the lines of two
    blocks meet in one task, which counts their pairs; so a pair that shares a line and no more is never written. A
    line of few classes is made into pairs before, which is less than a copy of it for each block.
    """
    hashed = F.transform(F.filter(F.split(text_col, "\n"), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x, F.lit(1)).alias("h"), F.xxhash64(x, F.lit(2)).alias("g")))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), hashed.alias("lines"))
    whole = lines.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines")).where(F.size("lines") > 0)
    key = F.unhex(F.sha2(F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["h"].cast("string"), x["g"].cast("string"))), ","), 256))
    keyed = settled(whole.withColumn("key", key), "lines")
    classes = keyed.groupBy("key").agg(F.min("id").alias("class"), F.first("lines").alias("lines")).withColumn("total", F.size("lines").cast("long"))
    counts = classes.select("class", "total", F.explode("lines").alias("line")).groupBy("class", "total", "line.h", "line.g").agg(F.count(F.lit(1)).alias("n"))
    common = lambda rows: rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counts = settled(counts, "counts")
    counts = settled(counts.join(common(counts).select("h", "g"), ["h", "g"]), "common")
    some = settled(counts.join(counts.groupBy("class").agg(F.sum("n").alias("s")).where(F.col("s") >= least_lines).select("class"), "class"), "common")
    shared = _counted_in_blocks(some.join(common(some), ["h", "g"]), max(1, -(-some.select("class").distinct().count() // PART)), least_lines)
    apart = shared.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", (2 * F.col("shared") / F.col("totals")).alias("similarity"))
    firsts = keyed.groupBy("key").agg(F.min("id").alias("class"))
    copies = keyed.select("id", "key", F.size("lines").cast("long").alias("total")).join(firsts, "key").where((F.col("id") > F.col("class")) & (F.col("total") >= least_lines))
    return apart.unionByName(copies.select(F.col("class").alias("a"), F.col("id").alias("b"), F.col("total").alias("shared"), F.lit(1.0).alias("similarity")))


def _counted_in_blocks(rows: DataFrame, blocks: int, least: int) -> DataFrame:
    """(x, y, shared, totals) of every two classes that share enough; rows: class, total, h, g, n, c (a line's classes).

    A block's rows are of three kinds: lines of its first side (0) and of its second (1), and pairs (2).
    """
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    few = F.col("c") <= 2 * (blocks + 1)
    left = rows.where(few).select("h", "g", F.col("class").alias("x"), F.col("total").alias("t_x"), F.col("n").alias("n_x"))
    right = left.toDF("h", "g", "y", "t_y", "n_y")
    pairs = left.join(right, ["h", "g"]).where("x < y").withColumn("swap", of("x") > of("y"))
    pick = lambda a, b: F.when(F.col("swap"), F.col(a)).otherwise(F.col(b))
    pairs = pairs.select(F.least(of("x"), of("y")).alias("i"), F.greatest(of("x"), of("y")).alias("j"), F.lit(2).alias("side"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), pick("y", "x").alias("x"), pick("t_y", "t_x").alias("t_x"), pick("x", "y").alias("y"), pick("t_x", "t_y").alias("t_y"), F.least("n_x", "n_y").alias("n"))
    sent = rows.where(~few).withColumn("k", of("class")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(F.least("k", "m").alias("i"), F.greatest("k", "m").alias("j"), (F.col("k") > F.col("m")).cast("int").alias("side"), "h", "g", F.col("class").alias("x"), F.col("total").alias("t_x"), F.col("class").alias("y"), F.col("total").alias("t_y"), "n")
    dealt = pairs.unionByName(sent).repartition(max(1, blocks * (blocks + 1) // 2), "i", "j").sortWithinPartitions("i", "j")
    kind = rows.schema["class"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            place = batch.column("i").to_numpy() * blocks + batch.column("j").to_numpy()
            starts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist()] if len(place) else []
            for at, end in zip(starts, [*starts[1:], len(place)], strict=False):
                if held and place[at] != last:
                    yield from overlaps_of_block(pa.Table.from_batches(held), least)
                    held = []
                last = place[at]
                held.append(batch.slice(at, end - at))
        if held:
            yield from overlaps_of_block(pa.Table.from_batches(held), least)

    return dealt.mapInArrow(run, StructType([StructField("x", kind), StructField("y", kind), StructField("shared", LongType()), StructField("totals", LongType())]))


def overlaps_of_block(table: pa.Table, least: int, cells: int = CELLS) -> Iterator[pa.RecordBatch]:
    """The pairs of one block that share enough lines; of a block with itself, each pair once."""
    side, n, t_x, t_y = (table[c].to_numpy() for c in ("side", "n", "t_x", "t_y"))
    same = table["i"][0].as_py() == table["j"][0].as_py()
    ids = pa.concat_arrays([*table["x"].chunks, *table["y"].chunks]).dictionary_encode()
    code_x, code_y = np.split(ids.indices.to_numpy(), 2)
    totals = np.zeros(len(ids.dictionary), np.int64)
    totals[code_x], totals[code_y] = t_x, t_y
    pair = side == 2
    # Numbers on each side: of the classes that are on it.
    first, second = np.unique(code_x[side != 1]), np.unique(np.concatenate([code_x[side == (0 if same else 1)], code_y[pair]]))
    if same:
        first = second = np.union1d(first, second)
    place = [np.searchsorted(s, c) for s, c in ((first, code_x[pair]), (second, code_y[pair]))]
    if same:
        place = [np.minimum(*place), np.maximum(*place)]
    order = np.argsort(place[0], kind="stable")
    p, q, n_pair = place[0][order], place[1][order], n[pair][order]

    lines = np.stack([table["h"].to_numpy(), table["g"].to_numpy()], 1)
    _, line = np.unique(lines, axis=0, return_inverse=True)
    line = line.reshape(-1)

    def by_line(chosen: np.ndarray, numbers: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """A line's classes in order, and how often each has it."""
        own, at, times = line[chosen], np.searchsorted(numbers, code_x[chosen]), n[chosen]
        order = np.lexsort((at, own))
        own, at, times = own[order], at[order], times[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
        return {int(own[s]): (at[s:e], times[s:e]) for s, e in zip(starts, [*starts[1:], len(own)], strict=False)}

    ours = by_line(side == 0, first)
    theirs = ours if same else by_line(side == 1, second)
    met = [(*ours[k], *theirs[k]) for k in ours if k in theirs]
    height = max(1, cells // max(1, len(second)))
    for low in range(0, len(first), height):
        high = min(len(first), low + height)
        shared = np.zeros((high - low, len(second)), np.int32)
        for a, n_a, b, n_b in met:
            s, e = np.searchsorted(a, (low, high))
            if s < e:
                shared[np.ix_(a[s:e] - low, b)] += np.minimum.outer(n_a[s:e], n_b).astype(np.int32)
        s, e = np.searchsorted(p, (low, high))
        np.add.at(shared, (p[s:e] - low, q[s:e]), n_pair[s:e])
        if same:
            shared[np.arange(low, high)[:, None] >= np.arange(len(second))] = 0
        for at in range(0, high - low, 64):
            r, c = np.nonzero(shared[at : at + 64] >= least)
            if len(r):
                x, y = first[r + at + low], second[c]
                found = shared[r + at, c].astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(x)), ids.dictionary.take(pa.array(y)), pa.array(found), pa.array(totals[x] + totals[y])], ["x", "y", "shared", "totals"])


def mode_first(rows: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """(by, mode, n_mode): the most frequent value; of equally frequent ones the one that comes first in order."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias("mode"), F.max("n").alias("n_mode"))


def field_agreement(records: DataFrame, key: str, source: str, field: str, ordinal: str) -> DataFrame:
    """Per key: records, sources, distinct values of a field, whether all agree, and the values by source.

    Null values are not compared; of a source's values the last by the ordinal counts.
    """
    last = records.where(F.col(field).isNotNull()).groupBy(key, source).agg(F.max_by(field, ordinal).alias("value"))
    per = last.groupBy(key).agg(F.count(F.lit(1)).alias("n_sources"), F.count_distinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", source, F.col("value").cast("string")))), ",").alias("values_by_source"))
    return per.withColumn("agrees", F.col("n_values") == 1)


def identity_gate(records: DataFrame, key: str, origin: str, official: Column, least: int = 2) -> DataFrame:
    """Per key: number of records and origins, whether one is official, and the first gate that fails, if any."""
    grouped = records.groupBy(key).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(origin).alias("n_origins"), F.bool_or(official).alias("has_official"))
    reason = F.when(F.col("n_origins") < least, "fewer than two independent sources").when(~F.col("has_official"), "no official source").otherwise("")
    return grouped.withColumn("reason", reason)


def html_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The visible lines of HTML: scripts, styles and comments go, blocks end lines, entities are read."""
    text = F.regexp_replace(F.col(html_col), "(?is)<(script|style|head)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, "(?i)<(?:br|/?p|/?div|/?h[1-6]|/?li|/?ul|/?tr|/?nav|/?article|/?footer)\\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    rows = pages.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    return rows.withColumn("line", F.trim(F.regexp_replace("raw", "\\s+", " "))).where("line <> ''").select(id_col, (F.col("pos") + 1).alias("line_no"), "line")
