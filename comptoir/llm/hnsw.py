"""Near duplicates among embeddings with one hierarchical navigable small-world graph per shard.

Equal vectors are one vector with a count first. The others are dealt by hash into shards of at most some 32 000, and each shard gets a graph: every
node has a level, drawn from a hash of its place, and the nodes of a level and above are linked on it. A search goes down from the top
level with a beam of one and walks the lowest level with a beam of ``beam`` nodes.

Every vector asks its own shard, and of two shards one asks the other, since a link holds both ways. A query whose whole beam reaches the
similarity may have more links in that shard and is compared with all of it (a beam of hundreds of nodes takes longer), so a group of any
size is found whole. What a search finds counts only after its cosine in double precision. An audit compares a fixed number of queries with all rows by brute force; the beam is widened until the searches find the
demanded share of their links, at last to whole shards.

A task holds one graph and streams queries past it. It gives back the number of links of every vector, and, in place of the links themselves,
a forest that connects the same vectors; the forests of all tasks meet in connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comptoir.llm._graph import components
from comptoir.session import cut_lineage

#: Vectors of a shard and single-precision bytes of them at most, links of a node above and on the lowest level, beam while building, queries
#: worked on at once.
SHARD, SHARD_BYTES, LINKS, LOWEST_LINKS, BUILD_BEAM, TOGETHER = 1 << 15, 1 << 24, 8, 16, 28, 512
#: Queries that pass one copy of a shard's graph, queries of the audit, and the beams it tries before whole shards.
STREAM, AUDITED, BEAMS = 1 << 18, 2048, (8, 16, 32, 64, 128, 256, 512, 1024)
#: How far single precision may be off the cosine.
MARGIN = 1e-4


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not zero."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(wide, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b`` in double precision; scaled first, so no square leaves the range of doubles."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def search(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes each query meets on one level, best first, and their similarities; -1 where it met fewer."""
    n = len(queries)
    seen = np.zeros((n, len(unit)), dtype=bool)
    rows = np.arange(n)
    ids = np.full((n, beam), -1, dtype=np.int32)
    sims = np.full((n, beam), -np.inf, dtype=np.float32)
    done = np.ones((n, beam), dtype=bool)
    ids[:, 0], done[:, 0] = entry, False
    sims[:, 0] = np.einsum("ij,ij->i", queries, unit[entry])
    seen[rows, entry] = True
    wide = max(1, min(4, beam // 8))
    open_ = rows
    while len(open_):
        ahead = np.where(done[open_], -np.inf, sims[open_])
        pick = np.argpartition(-ahead, wide - 1, axis=1)[:, :wide] if wide < beam else np.tile(np.arange(beam), (len(open_), 1))
        some = np.take_along_axis(ahead, pick, 1)
        alive = some.max(axis=1) > -np.inf
        open_, pick, some = open_[alive], pick[alive], some[alive]
        if not len(open_):
            break
        node = np.where(some > -np.inf, ids[open_[:, None], pick], -1)
        done[open_[:, None], pick] = True
        near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(open_), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[open_[:, None], near]
        at, place = np.nonzero(fresh)
        to = near[at, place]
        seen[open_[at], to] = True
        count = fresh.sum(axis=1)
        widest = int(count.max(initial=0))
        if not widest:
            continue
        slot = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        more_ids = np.full((len(open_), widest), -1, dtype=np.int32)
        more = np.full((len(open_), widest), -np.inf, dtype=np.float32)
        more_ids[at, slot] = to
        more[at, slot] = np.einsum("ij,ij->i", queries[open_[at]], unit[to])
        all_ids = np.concatenate([ids[open_], more_ids], axis=1)
        all_sims = np.concatenate([sims[open_], more], axis=1)
        all_done = np.concatenate([done[open_], more_ids < 0], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[open_], sims[open_], done[open_] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _spread(unit: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of the candidates of each row, ``keep`` that are nearer to the row's node than to one taken before; then the nearest left out."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    valid = (ids >= 0) & (ids != own[:, None])
    vectors = unit[ids]
    among = np.matmul(vectors, vectors.transpose(0, 2, 1))
    taken = np.zeros(ids.shape, dtype=bool)
    for c in range(ids.shape[1]):
        blocked = (taken[:, :c] & (among[:, c, :c] > sims[:, c : c + 1])).any(axis=1) if c else np.zeros(len(ids), dtype=bool)
        taken[:, c] = valid[:, c] & ~blocked
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    first = np.argsort(rank, axis=1)[:, :keep]
    out = np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(ids, first, 1), -1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def _link_back(unit: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Every node that a new one links to links back, and keeps a spread choice of its links."""
    keep = links.shape[1]
    source = np.repeat(new, keep)
    target = links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    sim = np.einsum("ij,ij->i", unit[source], unit[target])
    order = np.lexsort((-sim, target))
    source, target, sim = source[order], target[order], sim[order]
    nodes, start, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(start, count)
    inside = place < keep
    back = np.full((len(nodes), keep), -1, dtype=np.int32)
    back[np.repeat(np.arange(len(nodes)), count)[inside], place[inside]] = source[inside]
    for at in range(0, len(nodes), 1024):
        part = slice(at, at + 1024)
        ids = np.concatenate([links[nodes[part]], back[part]], axis=1)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.where(ids >= 0, np.einsum("ij,ikj->ik", unit[nodes[part]], unit[ids]), -np.inf)
        full = (ids >= 0).sum(axis=1) > keep
        packed = np.take_along_axis(ids, np.argsort(-sims, axis=1)[:, :keep], 1)
        if full.any():
            packed[full] = _spread(unit, nodes[part][full], ids[full], sims[full], keep)
        links[nodes[part]] = packed


class Graph:
    """The levels of one shard, from the lowest up: for each, the links of every node (-1 where there is none) and the nodes it holds."""

    def __init__(self, unit: np.ndarray, levels: list[np.ndarray], entry: int) -> None:
        self.unit, self.levels, self.entry = unit, levels, entry

    def descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        at = np.full(len(queries), self.entry, dtype=np.int32)
        for level in range(len(self.levels) - 1, down_to, -1):
            at = search(self.unit, self.levels[level], queries, at, 1)[0][:, 0]
        return at

    def near(self, queries: np.ndarray, beam: int, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As ``search`` on the lowest level, from where the levels above lead, or from ``entry``."""
        return search(self.unit, self.levels[0], queries, self.descend(queries, 0) if entry is None else entry, beam)

    def linked(self, raw: np.ndarray, vectors: np.ndarray, at_least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``vectors``, node) with a cosine of ``at_least``; ``own`` are the places of vectors that are nodes themselves."""
        unit = _unit(vectors)
        rows, nodes = [], []
        left, beam = np.arange(len(unit)), min(beam, len(raw))
        while len(left):
            wider, step = [], max(1, min(TOGETHER, (1 << 23) // beam))
            for at in range(0, len(left), step):
                asked = left[at : at + step]
                if beam < len(raw):
                    ids, sims = self.near(unit[asked], beam, None if own is None else own[asked])
                else:
                    sims, ids = unit[asked] @ self.unit.T, np.broadcast_to(np.arange(len(raw), dtype=np.int32), (len(asked), len(raw)))
                hit = sims >= at_least - MARGIN
                full = hit.all(axis=1) & (beam < len(raw))
                wider.append(asked[full])
                row, place = np.nonzero(hit & ~full[:, None])
                node = ids[row, place]
                row = asked[row]
                if len(row):
                    sure = cosines(vectors[row], raw[node]) >= at_least
                    if own is not None:
                        sure &= node != own[row]
                    rows.append(row[sure])
                    nodes.append(node[sure])
            left, beam = np.concatenate(wider), len(raw)
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *nodes])


def build(vectors: np.ndarray) -> Graph:
    """Levels are built from the top; on each, the nodes of the level above come first and the others in growing batches.

    The nodes of a batch find each other by comparing all of them, the earlier ones by a search.
    """
    unit = _unit(vectors)
    n = len(unit)
    drawn = np.frombuffer(hashlib.shake_128(b"levels").digest(8 * n), dtype=np.uint64).astype(np.float64) / 2.0**64
    height = np.minimum(np.floor(-np.log(np.maximum(drawn, 1e-300)) / np.log(LINKS)).astype(int), 8)
    order = np.argsort(-height, kind="stable").astype(np.int32)
    graph = Graph(unit, [], int(order[0]))
    built: list[np.ndarray] = []
    for level in range(int(height.max()), -1, -1):
        keep = LINKS if level else LOWEST_LINKS
        nodes = order[: int((height >= level).sum())]
        links = np.full((n, keep), -1, dtype=np.int32)
        at = 0
        while at < len(nodes):
            new = nodes[at : at + max(64, min(at, 1024))]
            among = unit[new] @ unit[new].T
            np.fill_diagonal(among, -np.inf)
            width = min(len(new), keep)
            side = np.argpartition(-among, width - 1, axis=1)[:, :width]
            ids, sims = new[side], np.take_along_axis(among, side, 1)
            ids = np.where(sims > -np.inf, ids, -1)
            if at:
                graph.levels = [links, *built]
                parts = [search(unit, links, unit[new[i : i + TOGETHER]], graph.descend(unit[new[i : i + TOGETHER]], 0), BUILD_BEAM) for i in range(0, len(new), TOGETHER)]
                ids, sims = np.concatenate([ids, np.concatenate([p[0] for p in parts])], axis=1), np.concatenate([sims, np.concatenate([p[1] for p in parts])], axis=1)
            for i in range(0, len(new), 1024):
                links[new[i : i + 1024]] = _spread(unit, new[i : i + 1024], ids[i : i + 1024], sims[i : i + 1024], keep)
            _link_back(unit, links, new)
            at += len(new)
        built.insert(0, links)
    graph.levels = built
    return graph


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


_INDEX = "dims int, shard int, nodes binary, copies binary, raw binary, entry int, levels array<binary>"


def _shard_index(table: pa.Table) -> pa.Table:
    raw = _vectors(table.column("v"))
    graph = build(raw)
    levels = [graph.levels[0].tobytes()]
    for links in graph.levels[1:]:
        held = np.flatnonzero((links >= 0).any(axis=1)).astype(np.int32)
        levels.append(np.concatenate([held[:, None], links[held]], axis=1).tobytes())
    return pa.table({
        "dims": table.column("dims").combine_chunks()[:1], "shard": table.column("shard").combine_chunks()[:1], "nodes": [np.asarray(table.column("node")).tobytes()],
        "copies": [np.asarray(table.column("copies")).tobytes()], "raw": [raw.tobytes()], "entry": pa.array([graph.entry], pa.int32()), "levels": pa.array([levels], pa.list_(pa.binary()))})


def _opened(row: dict, kind: type) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(row["raw"], dtype=kind).reshape(-1, row["dims"])
    levels = [np.frombuffer(row["levels"][0], dtype=np.int32).reshape(-1, LOWEST_LINKS)]
    for packed in row["levels"][1:]:
        part = np.frombuffer(packed, dtype=np.int32).reshape(-1, LINKS + 1)
        links = np.full((len(raw), LINKS), -1, dtype=np.int32)
        links[part[:, 0]] = part[:, 1:]
        levels.append(links)
    return Graph(_unit(raw), levels, row["entry"]), raw, np.frombuffer(row["nodes"], dtype=np.int64), np.frombuffer(row["copies"], dtype=np.int64)


def _beams(index: DataFrame, vectors: DataFrame, kind: type, at_least: float, recall: float) -> tuple[int, int]:
    """The smallest beams, for queries to their own shard and to others, whose searches find ``recall`` of the links of the audited queries
    there, on the mean of those that have any.

    The audited queries are those of least hash, at most ``AUDITED``; each shard compares them with all its vectors. In its own shard
    a query starts from itself, and a link may be found from either end, so a smaller beam does there. Where no beam of ``BEAMS`` passes, whole shards are compared.
    """
    asked = vectors.select("dims", "node", "v").orderBy(F.xxhash64("node")).limit(AUDITED).collect()
    by_dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims in {r.dims for r in asked}:
        mine = [r for r in asked if r.dims == dims]
        by_dims[dims] = np.array([r.node for r in mine]), np.array([r.v for r in mine], dtype=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            graph, raw, nodes, _ = _opened(row, kind)
            ids, queries = by_dims.get(row["dims"], (np.zeros(0, dtype=np.int64), np.zeros((0, row["dims"]), dtype=kind)))
            place = {node: at for at, node in enumerate(nodes.tolist())}
            own = np.array([place.get(i, -1) for i in ids.tolist()], dtype=np.int64)

            for mine in (own < 0, own >= 0):
                asked, start = queries[mine], own[mine] if (own[mine] >= 0).any() else None
                row, node = graph.linked(raw, asked, at_least, len(raw), start)
                truth, there = row * len(raw) + node, np.bincount(row, minlength=len(asked))
                some = np.flatnonzero(there)
                found, missing = [], truth
                for beam in BEAMS:
                    if beam >= len(raw):
                        missing = missing[:0]
                    if len(missing):
                        wanted = np.unique(missing // len(raw))
                        row, node = graph.linked(raw, asked[wanted], at_least, beam, None if start is None else start[wanted])
                        missing = truth[~np.isin(truth, wanted[row] * len(raw) + node)]
                        missing = missing[np.isin(missing // len(raw), wanted)]
                    if len(missing) and start is not None:
                        # Inside a shard a link may be found from its other end.
                        other = missing % len(raw)
                        far, back = np.unique(other, return_inverse=True)
                        row, node = graph.linked(raw, raw[far], at_least, beam, far)
                        missing = missing[~np.isin(back * len(raw) + start[missing // len(raw)], row * len(raw) + node)]
                    found.append((there - np.bincount(missing // len(raw), minlength=len(asked)))[some])
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine][some]), pa.array(np.full(len(some), start is not None)), pa.array(there[some]), *[pa.array(h) for h in found]], names=["node", "own", "links", *names])

    names = [f"found_{b}" for b in BEAMS]
    audited = index.mapInArrow(run, "node long, own boolean, links long, " + ", ".join(f"{n} long" for n in names))
    sums = audited.groupBy("own", "node").agg(F.sum("links").alias("links"), *[F.sum(n).alias(n) for n in names])
    shares = {r["own"]: [r[n] for n in names] for r in sums.groupBy("own").agg(*[F.avg(F.col(n) / F.col("links")).alias(n) for n in names]).collect()}

    def smallest(own: bool) -> int:
        return next((b for b, share in zip(BEAMS, shares.get(own, [1.0]), strict=False) if share >= recall), SHARD)

    return smallest(True), smallest(False)


class _Stream:
    """Queries that pass one graph. Links inside the shard are found from both ends, so they are kept as bits, one row for a node that has any:
    at most 128 MB if all vectors of a shard have some."""

    def __init__(self, row: dict, kind: type, at_least: float, beams: tuple[int, int]) -> None:
        self.graph, self.raw, self.nodes, self.copies = _opened(row, kind)
        self.shard, self.at_least, self.beams = row["shard"], at_least, beams
        self.place = np.argsort(self.nodes)
        self.root = np.arange(len(self.nodes))
        self.counts = np.zeros(len(self.nodes), dtype=np.int64)
        self.own: dict[int, np.ndarray] = {}

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def take(self, nodes: np.ndarray, copies: np.ndarray, shards: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (node, other, n): links of a query counted (other is -1), or an edge."""
        inside = shards == self.shard
        own = self.place[np.searchsorted(self.nodes, nodes[inside], sorter=self.place)]
        row, hit = self.graph.linked(self.raw, vectors[inside], self.at_least, self.beams[0], own)
        for a, b in ((own[row], hit), (hit, own[row])):
            order = np.argsort(a, kind="stable")
            found, start = np.unique(a[order], return_index=True)
            for node, others in zip(found.tolist(), np.split(b[order], start[1:]), strict=False):
                bits = self.own.setdefault(node, np.zeros(len(self.nodes) // 8 + 1, dtype=np.uint8))
                np.bitwise_or.at(bits, others >> 3, np.uint8(1) << (others & 7).astype(np.uint8))
        self._union(own[row], hit)
        row, hit = self.graph.linked(self.raw, vectors[~inside], self.at_least, self.beams[1])
        nodes, copies = nodes[~inside], copies[~inside]
        np.add.at(self.counts, hit, copies[row])
        asked, first = np.unique(row, return_index=True)
        least = np.zeros(len(nodes), dtype=np.int64)
        least[asked] = hit[first]
        self._union(least[row], hit)
        found = np.bincount(row, weights=self.copies[hit], minlength=len(nodes)).astype(np.int64)
        return np.concatenate([nodes[asked], nodes[asked]]), np.concatenate([np.full(len(asked), -1), self.nodes[least[asked]]]), np.concatenate([found[asked], np.zeros(len(asked), dtype=np.int64)])

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for node, bits in self.own.items():
            self.counts[node] += self.copies[np.unpackbits(bits, bitorder="little")[: len(self.copies)].astype(bool)].sum()
        some, moved = np.flatnonzero(self.counts), np.flatnonzero(self.root != np.arange(len(self.root)))
        return np.concatenate([self.nodes[some], self.nodes[moved]]), np.concatenate([np.full(len(some), -1), self.nodes[self.root[moved]]]), np.concatenate([self.counts[some], np.zeros(len(moved), dtype=np.int64)])


def _links(index: DataFrame, vectors: DataFrame, kind: type, at_least: float, beams: tuple[int, int], groups: int, tasks: int) -> DataFrame:
    """Rows (node, other, n): a number of links of ``node`` where ``other`` is -1, else an edge of the forest."""
    blank = {"node": "long", "copies": "long", "own": "int", "v": vectors.schema["v"].dataType.simpleString()}
    graphs = index.select("dims", "shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in blank.items()], F.struct("nodes", "copies", "raw", "entry", "levels").alias("graph"))
    asked = vectors.select("dims", F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("to"), "node", "copies", F.col("shard").alias("own"), "v")
    part = F.when(F.col("own") == F.col("to"), 0).otherwise(F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int"))
    queries = asked.select("dims", F.col("to").alias("shard"), part.alias("part"), F.lit(1).alias("kind"), "node", "copies", "own", "v", F.lit(None).cast(graphs.schema["graph"].dataType).alias("graph"))
    dealt = graphs.unionAll(queries).repartition(tasks, "dims", "shard", "part").sortWithinPartitions("dims", "shard", "part", "kind")
    names = ["node", "other", "n"]

    def batch_of(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column(3)) == 0).tolist()
            for start, end in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                rows = batch.slice(start, end - start)
                if rows.num_rows and rows.column(3)[0].as_py() == 0:
                    if now:
                        yield batch_of(now.close())
                    now = _Stream({"dims": rows.column(0)[0].as_py(), "shard": rows.column(1)[0].as_py(), **rows.column(8)[0].as_py()}, kind, at_least, beams)
                    rows = rows.slice(1)
                if rows.num_rows and now and rows.column(0)[0].as_py() == now.raw.shape[1] and rows.column(1)[0].as_py() == now.shard:
                    yield batch_of(now.take(np.asarray(rows.column(4)), np.asarray(rows.column(5)), np.asarray(rows.column(6)), _vectors(rows.column(7))))
        if now:
            yield batch_of(now.close())

    return dealt.mapInArrow(run, "node long, other long, n long")


def near_duplicates(df: DataFrame, at_least: float = 0.9, recall: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (id, n_links, component_id, kept) for every row: the other rows linked with it, and the least id its links reach.

    Two vectors of one length link when their cosine is ``at_least`` or more. A vector that is null or zero, or holds a null or non-finite
    component, links with nothing. Repeated ids are rows of their own; a row without id links too, but no component is named after it,
    so its own is null if it links with no other. ``kept`` says whether the id is the component's. Other columns are left out.
    """
    element = df.schema[vector_column].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    vector = F.col(f"`{vector_column}`") if element == "float" else F.col(f"`{vector_column}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_column}`").alias("id"), vector.alias("v")).withColumn("usable", usable(F.col("v")))
    distinct = rows.filter("usable").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    vectors = cut_lineage(distinct.select(F.monotonically_increasing_id().alias("node"), "least", "copies", F.size("v").alias("dims"), "v"))
    number, dims = vectors.agg(F.count("*"), F.max("dims")).first()
    shards, groups = max(1, -(-number // max(1, min(SHARD, SHARD_BYTES // (4 * (dims or 1)))))), max(1, -(-number // STREAM))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    index = cut_lineage(dealt.groupBy("dims", "shard").applyInArrow(_shard_index, _INDEX))
    beams = _beams(index, vectors, kind, at_least, recall)
    links = cut_lineage(_links(index, dealt, kind, at_least, beams, groups, 2 * shards * groups))

    roots = components(links.filter("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    least = roots.join(vectors.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    counts = links.filter("other < 0").groupBy("node").agg(F.sum("n").alias("n"))
    linked = counts.join(roots, "node", "full").join(least, "root", "left").select("node", "n", "component_id")
    known = vectors.select("node", "least", "copies", "v").join(linked, "node", "left").select(
        "v", "least", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    alone = known.filter("copies = 1").select(F.col("least").alias("id"), "n_links", "component_id")
    copied = rows.filter("usable").join(known.filter("copies > 1"), "v").select("id", "n_links", "component_id")
    unlinked = rows.filter("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return alone.unionAll(copied).unionAll(unlinked).select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
