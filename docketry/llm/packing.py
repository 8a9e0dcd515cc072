"""Packing token streams into fixed windows by order-preserving dynamic programming.

The documents of a partition, in stored order, form one stream of token ids. A window may end where a document
ends (free), where a sentence ends (a small penalty for the truncation) or, inside a sentence that is longer than a
window, at every GRID-th token (a larger one). Over these places

    best[j] = min over i, 0 < p[j] - p[i] <= limit, of best[i] + padding(p[j] - p[i]) + cut[j] + WINDOW

is minimised. As padding is limit - length, the minimum is that of best[i] + p[i] over a sliding window, which a
monotone queue gives in constant time; lengths that are powers of two need no padding and are looked at singly.
The stream is cut in buffers of about BUFFER tokens: the windows are the cheapest of a buffer, and its last KEPT_BACK
ones are opened again with the next. A document longer than that passes through in parts. No shuffle: sequences are
cut where the partition's rows lie, and a lost task gives the same rows again.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import frugal

LIMIT = 1024
SENTENCE_CUT = 6  # penalty, in tokens of padding, for a window that ends at a sentence's end inside a document
TOKEN_CUT = 48  # the same inside a sentence
WINDOW = 8  # cost of each window, so that short ones are used only where they save padding
GRID = 16  # a sentence that no window holds may be cut at every so many tokens
BUFFER = 1 << 16  # tokens that are packed at once
KEPT_BACK = 4  # the last windows of a buffer go on to the next
ENDS = (b".", b"!", b"?", b"\n")

LONG_RUN = 4096  # runs of so many blanks or of other signs are left to the library of the vocabulary's file
PART = 1 << 20  # characters that are encoded at once, where the text has a blank to be parted at
_RUN = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")
_SEAM = re.compile(r"(?<=\S)(?=\s)")


class Encoder:
    """Ids of whole texts, with the strings of special tokens read as the tokenizer's file says."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(json_path)
        self.special = sorted(t.content for t in self.plain.get_added_tokens_decoder().values())
        self.fast = None
        if ranks_path and pattern:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            # The same vocabulary and merges; several times faster on whole texts.
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or any(s in text for s in self.special) or (len(text) >= LONG_RUN and _RUN.search(text)):
            return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_ordinary(text), np.uint32)

    def parts(self, text: str | None) -> Iterator[np.ndarray]:
        """The ids of a text of any length, part by part.

        No token of the pattern goes on behind a sign that a blank follows, so the ids are those of the whole text.
        """
        text, at = text or "", 0
        while len(text) - at > PART:
            seam = _SEAM.search(text, at + PART)
            if seam is None:
                break
            yield self(text[at : seam.start()])
            at = seam.start()
        yield self(text[at:] if at else text)

    def sentence_ends(self) -> np.ndarray:
        """Ids whose text ends a sentence or a line."""
        size = self.plain.get_vocab_size()
        texts = self.plain.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
        return np.array([t.encode()[-1:] in ENDS for t in texts])


def padding(length: int, limit: int) -> int:
    return 0 if length & (length - 1) == 0 else limit - length


def cut_windows(places: np.ndarray, costs: np.ndarray, limit: int) -> list[int]:
    """Ends of the cheapest windows over the stream from 0 to places[-1].

    places: increasing token positions, gaps of at most `limit`; costs: penalty of a cut there.
    """
    n = len(places)
    at = [0, *places.tolist()]
    extra = [0.0, *costs.tolist()]
    index = {p: i for i, p in enumerate(at)}
    powers = [1 << k for k in range(limit.bit_length()) if 1 << k <= limit]
    best, came = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (best + place, index), increasing in both
    find = index.get
    for j in range(1, n + 1):
        p = at[j]
        while at[queue[0][1]] < p - limit:
            queue.popleft()
        low, i = queue[0]
        low += limit - p
        for w in powers:
            k = find(p - w)
            if k is not None and best[k] < low:
                low, i = best[k], k
        low += extra[j] + WINDOW
        best[j], came[j] = low, i
        low += p
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, j))
    ends, j = [], n
    while j:
        ends.append(at[j])
        j = came[j]
    return ends[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ending: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the buffer may be cut, and their penalties. doc_ends: positions after a document's last id.

    The end of the buffer is one, and between two that lie more than `limit` apart there are more.
    """
    n = len(ids)
    cost = np.full(n + 1, np.inf)
    cost[np.flatnonzero(ending[ids]) + 1] = SENTENCE_CUT
    cost[doc_ends] = 0
    cost[n] = min(cost[n], TOKEN_CUT)
    marks = np.flatnonzero(np.isfinite(cost[1:])) + 1
    gaps = np.diff(np.concatenate(([0], marks)))
    for k in np.flatnonzero(gaps > limit):
        end = marks[k]
        cost[np.arange(end - gaps[k] + min(GRID, limit), end, min(GRID, limit))] = TOKEN_CUT
    cost[0] = np.inf
    places = np.flatnonzero(np.isfinite(cost))
    return places, cost[places]


def pack(
    docs: DataFrame,
    encoder: Callable[[], Encoder],
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Sequences of at most `limit` tokens from the documents in stored order; each document ends with end_id.

    Returns one row per piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    ids themselves if with_ids. A null or empty text is the single end_id; ids may be null or repeat (each row is
    a document of its own); a text of any length is cut over many sequences; other columns are ignored; an empty
    table gives no rows. sequence_id holds the partition in its upper bits. Beside the ids of one document, a task
    holds about BUFFER tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        ending = encode.sentence_ends()
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[object, int, int, np.ndarray]] = []  # id, start of what is held, tokens in all, ids held
        size = 0
        id_type = None

        def flush(last: bool, whole: bool) -> pa.RecordBatch:
            """Pieces of the buffer's windows. whole: the last document in it is there up to its end."""
            nonlocal held, size, sequence
            ids = np.concatenate([h[3] for h in held])
            doc_ends = np.cumsum([len(h[3]) for h in held])
            ends = cut_windows(*cut_places(ids, doc_ends if whole else doc_ends[:-1], ending, limit), limit)
            if not last:
                ends = ends[:-KEPT_BACK] or ends[:1]
            done = ends[-1]
            cuts = np.union1d(ends, doc_ends[doc_ends <= done])
            begins = np.concatenate(([0], cuts[:-1]))
            doc = np.searchsorted(doc_ends, begins, side="right")
            window = np.searchsorted(ends, begins, side="right")
            starts = np.array([h[1] for h in held])[doc] + begins - (doc_ends - [len(h[3]) for h in held])[doc]
            opened = np.concatenate(([0], ends))[window]
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), cuts.tolist(), strict=True)]
            columns = [
                pa.array([held[d][0] for d in doc.tolist()], id_type),
                pa.array(starts, pa.int64()),
                pa.array(cuts - begins, pa.int64()),
                pa.array(crcs, pa.int64()),
                pa.array(np.array([h[2] for h in held])[doc], pa.int64()),
                pa.array(sequence + window, pa.int64()),
                pa.array(begins - opened, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(begins, cuts, strict=True)], pa.list_(pa.int64())))
            sequence += len(ends)
            first = int(np.searchsorted(doc_ends, done, side="right"))
            rest = held[first:]
            if rest:
                used = done - int(doc_ends[first] - len(rest[0][3]))
                rest[0] = (rest[0][0], rest[0][1] + used, rest[0][2], rest[0][3][used:])
            held, size = rest, len(ids) - done
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([*encode.parts(text.as_py()), np.array([end_id], np.uint32)])
                for at in range(0, len(ids), BUFFER):
                    part = ids[at : at + BUFFER]
                    if at and held and held[-1][1] + len(held[-1][3]) == at:  # what is left of this document's parts
                        _, start, n, before = held.pop()
                        held.append((key, start, n, np.concatenate([before, part])))
                    else:
                        held.append((key, at, len(ids), part))
                    size += len(part)
                    if size >= BUFFER:
                        yield flush(False, at + BUFFER >= len(ids))
        if held:
            yield flush(True, True)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(frugal(run), schema).withColumnRenamed("id", id_col)
