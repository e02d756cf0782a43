"""Benchmark decontamination by greedy string tiling.

Windows of ``minimum`` words are fingerprinted by running Karp-Rabin sums over the document and over each benchmark item. Equal
fingerprints are the seeds; seeds that follow each other on one diagonal are one match. The longest match is marked first, matches that meet
marked words are cut down to what is left, and so on until no match of ``minimum`` words remains. The words an item has under tiles, in
whatever order they stand in the document, are its coverage.

Documents stay where they are; the benchmark comes to them in parts of a bounded number of words, one pass for each part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comptoir.llm._hashing import ngram_hashes, word_hashes

#: Bytes of benchmark text handed to all tasks in one pass.
PART_BYTES = 8 << 20

MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("covered", T.IntegerType()), T.StructField("words", T.IntegerType())])


def tiles(item: np.ndarray, document: np.ndarray, minimum: int, at_item: np.ndarray, at_document: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item position, document position), longest first, from seed pairs of ``minimum`` equal words."""
    order = np.lexsort((at_item, at_document - at_item))
    i, d = at_item[order], (at_document - at_item)[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(i)]])) + minimum - 1
    heap = [(-int(n), int(a + b), int(a)) for n, a, b in zip(length, i[first], d[first], strict=True)]
    heapq.heapify(heap)
    used_item, used_document = np.zeros(len(item), dtype=bool), np.zeros(len(document), dtype=bool)
    out = []
    while heap:
        size, j, k = heapq.heappop(heap)
        free = ~(used_item[k : k - size] | used_document[j : j - size])
        if free.all():
            used_item[k : k - size] = used_document[j : j - size] = True
            out.append((-size, k, j))
            continue
        edge = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a >= minimum:
                heapq.heappush(heap, (a - b, j + a, k + a))
    return out


class _Part:
    """Fingerprints of some items, sorted, with the item and the place of each."""

    def __init__(self, items: list[tuple[int, str]], minimum: int) -> None:
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(text) for _, text in items]
        self.by_length = []
        for n in sorted({min(minimum, len(w)) for w in self.words if len(w)}):
            which = [k for k, w in enumerate(self.words) if min(minimum, len(w)) == n]
            marks = [ngram_hashes(self.words[k], n) for k in which]
            value = np.concatenate(marks)
            owner = np.repeat(which, [len(m) for m in marks])
            place = np.concatenate([np.arange(len(m)) for m in marks])
            order = np.argsort(value, kind="stable")
            self.by_length.append((n, value[order], owner[order], place[order]))

    def matches(self, text: str | None, least: float) -> list[dict]:
        words = word_hashes(text)
        found = []
        for n, value, owner, place in self.by_length:
            marks = ngram_hashes(words, n)
            low = np.searchsorted(value, marks)
            at = np.flatnonzero(value[np.minimum(low, len(value) - 1)] == marks)
            if not len(at):
                continue
            low, high = low[at], np.searchsorted(value, marks[at], side="right")
            count = high - low
            entry = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            where = np.repeat(at, count)
            for k in np.unique(owner[entry]).tolist():
                mine = owner[entry] == k
                item = self.words[k]
                if (len(np.unique(place[entry][mine])) + n - 1) * n < least * len(item):  # every seed covers n words at most
                    continue
                covered = sum(t[0] for t in tiles(item, words, n, place[entry][mine], where[mine]))
                if covered >= least * len(item):
                    found.append({"item_id": self.ids[k], "covered": covered, "words": len(item)})
        return sorted(found, key=lambda m: (m["item_id"] is None, m["item_id"]))


def with_matches(df: DataFrame, benchmark: DataFrame, text: str = "text", *, item_id: str = "item_id", item_text: str = "text", minimum: int = 5, threshold: float = 0.5, matches: str = "matches") -> DataFrame:
    """``df`` with the array ``matches`` of (item_id, covered, words): the items whose words lie under tiles to ``threshold`` or more.

    A tile has ``minimum`` words or more; an item of fewer words has to be there as a whole. Letters A-Z count as lower case. Null or empty
    texts and items match nothing; repeated items are reported as often as they stand in the benchmark. Rows of ``df`` stay as they are,
    without a shuffle; an existing column ``matches`` is replaced.
    """
    keep = [c for c in df.columns if c != matches]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(matches, T.ArrayType(MATCH))])
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int32()), ("words", pa.int32())]))
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).filter("text IS NOT NULL")
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    out = df.select(*[F.col(f"`{c}`") for c in keep]).withColumn(matches, F.array().cast(T.ArrayType(MATCH)))

    def stage(sent):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = _Part(sent.value, minimum)
            for batch in batches:
                before = batch.column(len(keep)).to_pylist()
                now = [had + part.matches(value.as_py(), threshold) for had, value in zip(before, batch.column(keep.index(text)), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(now, arrow)], names=schema.names)

        return run

    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        out = out.mapInArrow(stage(df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])), schema)
    return out
