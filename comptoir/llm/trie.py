"""Prefix tree of conversations by union-find over the common prefixes of sorted neighbours.

A conversation is a sequence of turns, and a turn a record of 20 bytes: 16 bytes of the SHA-256 of role and text, and the number of words.
Equal sequences are one sequence with a count. The distinct ones are range-partitioned and sorted, so those with a common prefix are
neighbours. Inside a partition the edges between neighbours are worked off by descending length of the common prefix; an edge joins two
components, and each join makes (or widens) the branching node at that depth. Between branching nodes every component gets the nodes of its
unbranched way.

A node is final when its component touches neither end of its partition. The others lie on the prefixes of the partition's first and last
sequence; these two sequences, with what is known of the nodes on them, are all that goes on: 32 neighbouring partitions at a time are
contracted by the same union-find, until one range is left. Then the names of parents are handed back down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.plans.ordered import accumulate
from comptoir.session import cut_lineage

#: Bytes of a record and of its hash, bytes of sequences in a partition, partitions contracted at once.
RECORD, KEY, PART_BYTES, FAN = 20, 16, 4 << 20, 32
_LARGE = np.iinfo(np.int64).max
_OUT = ("kind int, range long, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "end_id long, in_range long, in_side int, path binary, records binary")
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_FIELDS = [(name, _TYPES[kind]) for name, kind in (part.split() for part in _OUT.split(", "))]
NODE, OPEN, ALIAS = 0, 1, 2


def record(role: Column, text: Column) -> Column:
    """The 20 bytes of a turn; null role or text counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.unhex(F.concat(digest, F.lpad(F.hex(words), 2 * (RECORD - KEY), F.lit("0"))))


def sequences(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turns): the records of each conversation by ``turn``, nulls first, ties by the records themselves.

    Rows without a conversation id belong to none and are left out, other columns too. Turns are numbered in parallel, however many a
    conversation has; its records, 20 bytes a turn, become one row.
    """
    rows = df.filter(F.col(f"`{conversation}`").isNotNull()).select(F.col(f"`{conversation}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("at"), record(F.col(f"`{role}`"), F.col(f"`{text}`")).alias("record"))
    numbered = accumulate(rows.withColumn("row", F.monotonically_increasing_id()), ["conv_id"], [F.col("at"), F.col("record"), F.col("row")], row_number="place")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("place", "record"))), lambda t: t["record"])
    return numbered.groupBy("conv_id").agg(turns.alias("turns"))


def path(turns: Column) -> Column:
    """An array of records as one binary value."""
    return F.encode(F.array_join(F.transform(turns, lambda r: F.decode(r, "ISO-8859-1")), ""), "ISO-8859-1")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    size = min(len(a), len(b))
    differs = (a[:size] != b[:size]).any(axis=1)
    return int(differs.argmax()) if differs.any() else size


class _Forest:
    """The nodes over the sorted ``paths`` of one range. ``records`` holds, for each path, what is known of its nodes: depth -> (members,
    least member, final children, leaves, saved tokens, the least member that ends there or None), without what unfinished children add."""

    def __init__(self, paths: list[np.ndarray], records: list[dict[int, tuple]], last: bool) -> None:
        self.paths, self.records, self.last = paths, records, last
        self.depth: list[int] = []
        self.known: list[list] = []
        self.words: list[int] = []
        self.parent: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.same: list[int] = []
        self.placed: dict[tuple[int, int], int] = {}
        self._grow()

    def find(self, node: int) -> int:
        while self.same[node] != node:
            self.same[node] = self.same[self.same[node]]
            node = self.same[node]
        return node

    def closed(self, node: int) -> bool:
        return self.last or (self.low[node] > 0 and self.high[node] < len(self.paths) - 1)

    def _new(self, depth: int, item: int, span: tuple[int, int], carriers: list[int]) -> int:
        node = len(self.depth)
        known = [0, _LARGE, 0, 0, 0, None]
        for carrier in carriers:
            found = self.records[carrier].get(depth)
            if found:
                known = _sum(known, found)
            self.placed[carrier, depth] = node
        self.depth.append(depth)
        self.known.append(known)
        self.words.append(int.from_bytes(self.paths[item][depth - 1, KEY:].tobytes(), "big") if depth else 0)
        self.parent.append(-1)
        self.low.append(span[0])
        self.high.append(span[1])
        self.same.append(node)
        return node

    def total(self, node: int) -> tuple:
        """Members, least, children, leaves and saved tokens of a node whose children are all final."""
        n, least, children, leaves, saved, end = self.known[node]
        return n, least, children, leaves if children else 1, saved + (n - 1) * self.words[node], end

    def _lift(self, node: int, depth: int, item: int, span: tuple[int, int], carriers: list[int]) -> int:
        """The ancestor at ``depth`` of the top node of a component."""
        while self.depth[node] > depth:
            self.low[node], self.high[node] = span
            up = self._new(self.depth[node] - 1, item, span, carriers)
            self.parent[node] = up
            if self.closed(node):
                n, least, _, leaves, saved, _ = self.total(node)
                known = self.known[up]
                self.known[up] = [known[0] + n, min(known[1], least), known[2] + 1, known[3] + leaves, known[4] + saved, known[5]]
            node = up
        return node

    def _grow(self) -> None:
        count = len(self.paths)
        whole = [[i] for i in range(count)]
        top = [self._new(len(p), i, (i, i), [i]) for i, p in enumerate(self.paths)]
        carriers = [c if len(self.records[i]) > 1 else [] for i, c in enumerate(whole)]
        owner, low, high = list(range(count)), list(range(count)), list(range(count))

        def find(x: int) -> int:
            while owner[x] != x:
                owner[x] = owner[owner[x]]
                x = owner[x]
            return x

        edges = sorted(((_common(self.paths[i], self.paths[i + 1]), i) for i in range(count - 1)), key=lambda e: (-e[0], e[1]))
        for depth, i in edges:
            a, b = find(i), find(i + 1)
            x = self._lift(top[a], depth, a, (low[a], high[a]), carriers[a])
            y = self._lift(top[b], depth, b, (low[b], high[b]), carriers[b])
            self.known[x] = _sum(self.known[x], self.known[y])
            self.same[y] = x
            owner[b] = a
            high[a], top[a] = high[b], x
            carriers[a] = carriers[a] + carriers[b]
            self.low[x], self.high[x] = low[a], high[a]
        if count:
            root = find(0)
            self._lift(top[root], 0, root, (0, count - 1), carriers[root])

    def rows(self, range_id: int, incoming: list[tuple[int, int]] | None = None) -> pa.RecordBatch:
        """Final nodes, the sequences at both ends with the unfinished nodes on them, and what became of each incoming node."""
        out: dict[str, list] = {name: [] for name, _ in _FIELDS}

        def add(**values: object) -> None:
            for name, column in out.items():
                column.append(values.get(name))

        spine: dict[int, list[tuple]] = {0: [], 1: []}
        side = [0 if low == 0 else 1 for low in self.low]
        for node in range(len(self.depth)):
            if self.same[node] != node:
                continue
            if not self.closed(node):
                n, least, children, leaves, saved, end = self.known[node]
                spine[side[node]].append((self.depth[node], n, least, children, leaves, saved, end or 0, end is not None))
                continue
            n, least, children, leaves, saved, end = self.total(node)
            up = self.find(self.parent[node]) if self.depth[node] else -1
            final = up >= 0 and self.closed(up)
            add(kind=NODE, range=range_id, side=None if up < 0 or final else side[up], depth=self.depth[node], conv_id=least, parent_conv_id=self.total(up)[1] if final else None,
                n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved, end_id=end)
        for (item, depth), node in self.placed.items() if incoming else ():
            if depth in self.records[item]:
                node = self.find(node)
                done = self.closed(node)
                add(kind=ALIAS, range=range_id, side=None if done else side[node], depth=depth, conv_id=self.known[node][1] if done else None, in_range=incoming[item][0], in_side=incoming[item][1])
        if not self.last:
            for end, item in ((0, 0), (1, len(self.paths) - 1))[: min(2, len(self.paths))]:
                add(kind=OPEN, range=range_id, side=end, path=self.paths[item].tobytes(), records=np.array(spine[end], dtype=np.int64).reshape(-1, 8).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in _FIELDS], names=[name for name, _ in _FIELDS])


def _sum(a: list | tuple, b: list | tuple) -> list:
    return [a[0] + b[0], min(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4], a[5] if b[5] is None else b[5]]


def _turns(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, RECORD)


def _of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, records, part = [], [], None
    for batch in batches:
        for raw, least, n, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):  # noqa: B007
            paths.append(_turns(raw))
            records.append({len(paths[-1]): (n, least, 0, 0, 0, least)})
    if paths:
        yield _Forest(paths, records, False).rows(part)


def _contract(last: bool):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        items = sorted(table.select(["range", "side", "path", "records"]).to_pylist(), key=lambda r: (r["range"], r["side"]))
        records = [{int(r[0]): (int(r[1]), int(r[2]), int(r[3]), int(r[4]), int(r[5]), int(r[6]) if r[7] else None) for r in np.frombuffer(i["records"], dtype=np.int64).reshape(-1, 8)} for i in items]
        forest = _Forest([_turns(i["path"]) for i in items], records, last)
        return pa.Table.from_batches([forest.rows(items[0]["range"] // FAN, [(i["range"], i["side"]) for i in items])])

    return run


def prefix_tree(paths: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end_id), one for each distinct prefix of ``paths``
    (conv_id, path), from the empty one on.

    ``conv_id`` is the least member of a node and names it together with the depth; ``end_id`` is the least member that ends there, null if
    none does. ``saved_tokens`` sums (members - 1) x words of the last text over the subtree. Sequences without turns are members of the
    root. No rows give no nodes; a null path or id takes no part.
    """
    kept = cut_lineage(paths.filter("conv_id IS NOT NULL AND path IS NOT NULL").select("conv_id", "path"))
    size = kept.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    groups = kept.groupBy("path").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"))
    ordered = groups.repartitionByRange(1 + size // PART_BYTES, "path").sortWithinPartitions("path").select("path", "least", "n", F.spark_partition_id().cast("long").alias("range"))
    rounds = [cut_lineage(ordered.mapInArrow(_of_partition, _OUT))]
    while True:
        open_ = rounds[-1].filter(F.col("kind") == OPEN)
        widest = open_.agg(F.max("range")).first()[0]
        if widest is None:
            break
        last = widest < FAN
        rounds.append(cut_lineage(open_.groupBy((F.col("range") / FAN).cast("long").alias("group")).applyInArrow(_contract(last), _OUT)))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_id"]
    resolved, out = None, None
    for frame in reversed(rounds):
        nodes = frame.filter(F.col("kind") == NODE)
        if resolved is not None:
            up = resolved.select(F.col("in_range").alias("range"), F.col("in_side").alias("side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up"))
            nodes = nodes.join(up, ["range", "side", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
        out = nodes.select(*columns) if out is None else out.unionAll(nodes.select(*columns))
        alias = frame.filter(F.col("kind") == ALIAS).select("in_range", "in_side", "depth", "range", "side", "conv_id")
        if resolved is not None:
            above = resolved.select(F.col("in_range").alias("range"), F.col("in_side").alias("side"), "depth", F.col("conv_id").alias("up"))
            alias = alias.join(above, ["range", "side", "depth"], "left").withColumn("conv_id", F.coalesce("conv_id", "up"))
        resolved = alias.select("in_range", "in_side", "depth", "conv_id")
    return out
