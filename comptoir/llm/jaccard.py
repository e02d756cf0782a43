"""Exact Jaccard join of word n-gram sets by T-occurrence search.

Shingles are dealt into slices of their hash range; a slice holds the whole inverted lists of its shingles. Lists of one document cannot
link anything, so only shingles of two or more documents return to their documents, with the length of their list. A document of n shingles
needs an overlap of T = ceil(threshold * n) or more with any partner. Following DivideSkip, its T - 1 longest lists are skipped: a partner
must stand in one of the remaining short lists. These are merged by a shuffle on the shingle. Each posting carries its place in the
document's order from rare to common: a pair is a candidate only if as many shingles as its sizes require can follow the shared one in both
documents, which holds for the first shingle that a true pair shares. Candidates are then probed in the long lists by binary search of sorted
hashes, and kept when the whole overlap reaches what the threshold asks of the pair.

Hot lists are not expanded into all their pairs. A first round links every document with one leader of each of its short lists; the
components of the verified links make most lists of a group of copies uniform. The second round pairs members of a list only across the
components left, so no link that changes a component is lost. Equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comptoir.llm._graph import components
from comptoir.llm._hashing import set_key, shingle_set
from comptoir.session import cut_lineage

#: Text bytes whose shingles make up one slice.
SLICE_BYTES = 16 << 20
#: Postings a task gathers before it hands them over.
FLUSH = 1_000_000
#: Documents of a bucket in one batch.
ROWS = 1000


def shingle_keys(df: DataFrame, text: str = "text", *, n: int = 5, key: str = "set_key", count: str = "n_shingles") -> DataFrame:
    """``df`` without ``text``, with the number of distinct shingles and a key that equal sets share; without words 0 and null."""
    keep = [c for c in df.columns if c not in (text, key, count)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(count, T.LongType()), T.StructField(key, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for value in batch.column(batch.num_columns - 1):
                found = shingle_set(value.as_py(), n)
                sizes.append(len(found))
                keys.append(set_key(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


def _postings(texts: DataFrame, n: int, slices: int) -> DataFrame:
    """Rows (slice, keys, sizes, counts, hashes): packed postings; a document's hashes of a slice stand together. The slice stands for
    the upper bits of its hashes, so seven bytes of each travel."""
    schema = "slice int, keys binary, sizes binary, counts binary, hashes binary"
    bounds = np.array([(i << 64) // slices for i in range(1, slices)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        total = 0
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            keys = np.array([h[0] for h in held], dtype=np.int64)
            sizes = np.array([len(h[1]) for h in held], dtype=np.int32)
            cuts = np.array([h[2] for h in held])
            rows = []
            for s in range(slices):
                counts = (cuts[:, s + 1] - cuts[:, s]).astype(np.int32)
                some = counts > 0
                if some.any():
                    parts = [held[i][1][cuts[i, s] : cuts[i, s + 1]] for i in np.flatnonzero(some)]
                    rows.append((s, keys[some].tobytes(), sizes[some].tobytes(), counts[some].tobytes(), np.concatenate(parts).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["slice", "keys", "sizes", "counts", "hashes"])

        for batch in batches:
            for value in batch.column(0):
                found = shingle_set(value.as_py(), n)
                if not len(found) or (key := set_key(found)) in seen:
                    continue
                seen.add(key)
                held.append([key, found, np.concatenate([[0], np.searchsorted(found, bounds), [len(found)]])])
                total += len(found)
                if total >= FLUSH:
                    yield flush()
                    held, total, seen = [], 0, set()
        if held:
            yield flush()

    return texts.mapInArrow(run, schema)


def _shared(table: pa.Table, bits: int) -> pa.Table:
    """Of one slice, each document's shingles whose lists hold two or more documents, with the lists' lengths."""

    def column(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in table.column(name)])

    keys, sizes, counts = column("keys", np.int64), column("sizes", np.int32), column("counts", np.int32)
    lower = column("hashes", np.uint8).reshape(-1, 7)
    hashes = np.zeros((len(lower), 8), dtype=np.uint8)
    hashes[:, :7] = lower
    hashes = hashes.view(np.uint64).ravel() | np.uint64(table.column("slice")[0].as_py() << (64 - bits))
    keys, first, of = np.unique(keys, return_index=True, return_inverse=True)
    once = np.zeros(len(of), dtype=bool)
    once[first] = True
    owner = np.repeat(np.where(once, of, -1), counts)
    hashes, owner = hashes[owner >= 0], owner[owner >= 0]
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([starts, [len(hashes)]]))
    lists = np.repeat(length, length)
    some = lists > 1
    hashes, owner, lists = hashes[some], owner[some], np.minimum(lists[some], 65535).astype(np.uint16)
    order = np.argsort(owner, kind="stable")
    hashes, owner, lists = hashes[order], owner[order], lists[order]
    which, begin, held = np.unique(owner, return_index=True, return_counts=True)
    # The parts of all documents of one bucket travel as one row.
    bucket = keys[which] & ((1 << bits) - 1)
    rows = []
    for one in np.unique(bucket):
        mine = np.flatnonzero(bucket == one)
        at = np.concatenate([np.arange(begin[i], begin[i] + held[i]) for i in mine])
        rows.append((int(one), keys[which[mine]].tobytes(), sizes[first][which[mine]].tobytes(), held[mine].astype(np.int32).tobytes(), hashes[at].tobytes(), lists[at].tobytes()))
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.table(dict(zip(("bucket", "keys", "sizes", "counts", "hashes", "lists"), (pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 5), strict=True)), strict=True)))


def _required(size: int, num: int, den: int) -> int:
    return -(-size * num // den)


def _profiles(table: pa.Table, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of one bucket, rows (key, size, hashes, short) of the documents that share enough: sorted shared hashes, and those of the short lists
    that remain beside the T - 1 longest."""

    def column(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in table.column(name)])

    keys, sizes, counts = column("keys", np.int64), column("sizes", np.int32), column("counts", np.int32)
    hashes, lists = column("hashes", np.uint64), column("lists", np.uint16)
    keys, first, of = np.unique(keys, return_index=True, return_inverse=True)
    sizes, owner = sizes[first], np.repeat(of, counts)
    order = np.lexsort((hashes, owner))
    hashes, lists = hashes[order], lists[order]
    ends = np.cumsum(np.bincount(owner, minlength=len(keys)))
    out: list[list] = [[], [], [], []]
    for key, size, begin, end in zip(keys.tolist(), sizes.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        required = _required(size, num, den)
        if end - begin < required:
            continue
        mine = hashes[begin:end]
        rarest = np.argsort(lists[begin:end], kind="stable")[: len(mine) - required + 1]
        for values, value in zip(out, (key, size, mine.tobytes(), mine[rarest].tobytes()), strict=True):
            values.append(value)
        if len(out[0]) == ROWS:
            yield _profile_batch(out)
            out = [[], [], [], []]
    yield _profile_batch(out)


def _profile_batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["key", "size", "hashes", "short"])


def _short_lists(profiles: DataFrame) -> DataFrame:
    """Rows (shingle, key, size, place): the short lists' postings; places count from 0, shingles of a single document first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_py(), dtype=np.int64) for x in batch.column(3)]
            count = np.array([len(p) for p in parts], dtype=np.int64)
            key, size, alone = (np.repeat(np.asarray(batch.column(i)), count) for i in range(3))
            place = alone + np.arange(len(alone)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])), pa.array(key), pa.array(size), pa.array(place.astype(np.int32))], names=["shingle", "key", "size", "place"])

    return profiles.selectExpr("key", "size", "size - length(hashes) div 8 AS alone", "short").mapInArrow(run, "shingle long, key long, size int, place int")


def _possible(num: int, den: int) -> str:
    """SQL: both documents (sizes na and nb, the shared shingle at pa and pb) have room for the overlap their sizes require."""
    need = f"({num} * (na + nb) + {num + den - 1}) div {num + den}"
    return f"pa <= na - {need} AND pb <= nb - {need}"


def _verified(pairs: DataFrame, profiles: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose overlap, found by binary search of one document's hashes in the other's, reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, ha, nb, hb in ((x.as_py() for x in row) for row in zip(*batch.columns[2:], strict=True)):
                small, large = sorted((np.frombuffer(ha, dtype=np.uint64), np.frombuffer(hb, dtype=np.uint64)), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(both * (den + num) >= num * (na + nb))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = (profiles.select(F.col("key").alias(k), F.col("size").alias(f"n{k}"), F.col("hashes").alias(f"h{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "ha", "nb", "hb").mapInArrow(run, "a long, b long")


def similar_sets(texts: DataFrame, *, n: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """Rows (node, root): for every set key that has links, the smallest key it is connected with. ``texts`` has one column."""
    num, den = threshold
    total = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    slices = 1 << max(3, int(total // SLICE_BYTES).bit_length())
    packed = _postings(texts, n, slices)
    bits = slices.bit_length() - 1
    parts = packed.groupBy("slice").applyInArrow(lambda table: _shared(table, bits), "bucket int, keys binary, sizes binary, counts binary, hashes binary, lists binary")
    profiles = cut_lineage(parts.groupBy("bucket").applyInArrow(lambda table: pa.Table.from_batches(_profiles(table, num, den)), "key long, size int, hashes binary, short binary"))
    postings = _short_lists(profiles)
    # Of each list two leaders: the document with the fewest rarer shingles, which is the middle of a group of variants, and the least key.
    member = F.struct("key", "size", "place")
    leaders = postings.groupBy("shingle").agg(F.min(F.struct("place", "key", "size")).alias("middle"), F.min(member).alias("first"), F.max("key").alias("last")).filter("first.key < last")
    one = leaders.select("shingle", F.explode(F.array_distinct(F.array(F.struct("middle.key", "middle.size", "middle.place"), "first"))).alias("m")).selectExpr("shingle", "m.key AS a", "m.size AS na", "m.place AS pa")
    two = postings.selectExpr("shingle", "key AS b", "size AS nb", "place AS pb")
    possible = F.expr(_possible(num, den))
    stars = one.join(two, "shingle").filter((F.col("a") != F.col("b")) & possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut_lineage(_verified(stars, profiles, num, den))
    roots = components(links)
    named = postings.join(roots, postings["key"] == roots["node"], "left").select("shingle", "key", "size", "place", F.coalesce("root", "key").alias("root"))
    mixed = named.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    across = cut_lineage(named.join(mixed, "shingle"))
    left = across.selectExpr("shingle", "key AS a", "size AS na", "place AS pa", "root AS ra")
    right = across.selectExpr("shingle", "key AS b", "size AS nb", "place AS pb", "root AS rb")
    pairs = left.join(right, "shingle").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & possible).select("a", "b").distinct()
    rest = cut_lineage(_verified(pairs, profiles, num, den))
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", *, n: int = 5, threshold: tuple[int, int] = (3, 4), key_column: str | None = None) -> DataFrame:
    """One row per row of ``df``: its columns without the text, ``n_shingles`` and ``component_id``, the smallest id of its component.

    Two documents link when the Jaccard similarity of their sets of distinct word ``n``-grams is at least ``threshold`` (a fraction, 1/2 or
    more). Fewer than ``n`` words make one shingle of the whole sequence; documents without words are linked with nothing and name
    themselves. Null ids take part in links and never name a component unless it has no other id (then null). Repeated rows stay, as rows of
    one component. Columns of ``df`` named like new ones are replaced. With ``key_column`` there is a key of the component besides, null
    for documents without words; it tells components apart that share an id.
    """
    if not 2 * threshold[0] >= threshold[1] >= threshold[0] > 0:
        raise ValueError("the threshold must lie between 1/2 and 1")
    kept = [c for c in df.columns if c != text and c.lower() not in ("n_shingles", "component_id")]
    inner = [f"in{i}" for i in range(len(kept))]  # no input name can clash with the operator's own
    own_id = inner[kept.index(id_column)]
    keyed = cut_lineage(shingle_keys(df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)], F.col(f"`{text}`").alias("text")), n=n))
    roots = similar_sets(df.select(F.col(f"`{text}`").cast("string").alias("text")), n=n, threshold=threshold)
    ids = keyed.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min(own_id).alias("_id"))
    rooted = ids.join(roots, ids["set_key"] == roots["node"], "left").select("set_key", "_id", F.coalesce("root", "set_key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_id").alias("component_id"))
    joined = keyed.join(rooted.join(least, "root").select("set_key", "component_id", "root"), "set_key", "left")
    named = F.when(F.col("set_key").isNull(), F.col(own_id)).otherwise(F.col("component_id")).alias("component_id")
    out = [F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)]
    return joined.select(*out, "n_shingles", named, *([F.col("root").alias(key_column)] if key_column else []))
