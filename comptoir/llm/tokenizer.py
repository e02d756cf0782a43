"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark partitions.

Spark splits texts into words with the tokenizer's pattern. Each task gives the distinct words of an Arrow batch to an in-process DuckDB:
rows (word, position, token) join the merge table, and a recursive query contracts the leftmost pair of least rank of every word until no
pair is in the table. An ordered aggregation joins the bytes of a word's tokens again. Long words are first cut where no token of the
vocabulary could lie across, so that no merge is lost and the pieces contract side by side. What DuckDB cannot hold in its memory limit
goes to a folder of the task that ends with it.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the tokenizer's pattern means it (the Unicode property); Java's \s covers only ASCII.
_WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Bytes of words given to one DuckDB query.
BYTES_PER_QUERY = 1 << 19

CONTRACT = """
WITH RECURSIVE step(it, w, pos, id) AS (
    SELECT 0::INTEGER, w, pos, id FROM start
    UNION ALL (
        WITH paired AS (
            SELECT w, pos, id, lead(id) OVER seq AS right_id, lead(pos) OVER seq AS right_pos
            FROM step WINDOW seq AS (PARTITION BY w ORDER BY pos)
        ), best AS (
            SELECT p.w, min(m.rank::BIGINT * 4294967296 + p.pos) AS k, arg_min(p.right_pos, m.rank::BIGINT * 4294967296 + p.pos) AS gone
            FROM paired p JOIN merges m ON m.left_id = p.id AND m.right_id = p.right_id GROUP BY p.w
        )
        SELECT s.it + 1, s.w, s.pos, CASE WHEN s.pos = (b.k & 4294967295) THEN (b.k >> 32)::INTEGER ELSE s.id END
        FROM step s JOIN best b ON s.w = b.w WHERE s.pos <> b.gone
    )
), final AS (
    SELECT s.w, s.pos, s.id FROM step s JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) l ON s.w = l.w AND s.it = l.it
)
SELECT w, pos, id FROM final ORDER BY w, pos
"""
#: For long pieces: the pairs of least rank from left to right in one step, none twice, up to and with the first whose merging puts a pair
#: of still lower rank beside it. Until then the next pair one at a time would be the next of these, so the tokens are the same.
CONTRACT_LONG = """
WITH RECURSIVE step(it, w, pos, id) AS (
    SELECT 0::INTEGER, w, pos, id FROM start
    UNION ALL (
        WITH paired AS (
            SELECT it, w, pos, id, lag(id) OVER seq AS before, lead(id) OVER seq AS right_id, lead(id, 2) OVER seq AS after, row_number() OVER seq AS ix
            FROM step WINDOW seq AS (PARTITION BY w ORDER BY pos)
        ), ranked AS (
            SELECT p.w, p.ix, p.before, p.after, m.rank, min(m.rank) OVER (PARTITION BY p.w) AS least
            FROM paired p JOIN merges m ON m.left_id = p.id AND m.right_id = p.right_id
        ), hits AS (
            SELECT w, ix, before, after, rank, ix - row_number() OVER (PARTITION BY w ORDER BY ix) AS run FROM ranked WHERE rank = least
        ), odd AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY ix) AS k FROM hits) WHERE k % 2 = 1
        ), beside AS (
            SELECT w, ix, rank, after, CASE WHEN lag(ix) OVER (PARTITION BY w ORDER BY ix) = ix - 2 THEN rank ELSE before END AS before FROM odd
        ), falling AS (
            SELECT b.w, min(b.ix) AS ix FROM beside b
            LEFT JOIN merges l ON l.left_id = b.before AND l.right_id = b.rank LEFT JOIN merges r ON r.left_id = b.rank AND r.right_id = b.after
            WHERE l.rank < b.rank OR r.rank < b.rank GROUP BY b.w
        ), chosen AS (
            SELECT b.w, b.ix, b.rank FROM beside b LEFT JOIN falling f ON f.w = b.w WHERE f.ix IS NULL OR b.ix <= f.ix
        )
        SELECT p.it + 1, p.w, p.pos, coalesce(c.rank, p.id)
        FROM paired p LEFT JOIN chosen c ON c.w = p.w AND c.ix = p.ix LEFT JOIN chosen g ON g.w = p.w AND g.ix = p.ix - 1
        WHERE g.ix IS NULL AND p.w IN (SELECT w FROM chosen)
    )
), final AS (
    SELECT s.w, s.pos, s.id FROM step s JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) l ON s.w = l.w AND s.it = l.it
)
SELECT w, pos, id FROM final ORDER BY w, pos
"""
#: Pieces of more bytes than this go through ``CONTRACT_LONG``; it only sets the number of steps.
LONG = 48
DECODE = "SELECT w, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM coded JOIN vocabulary USING (id) GROUP BY w ORDER BY w"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Tables:
    """What all tasks of a worker read: ranks, merges, the vocabulary, and every first part of a token."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        left, right, rank = [], [], []
        for token, merged in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(merged)
        self.merges = pa.table({k: pa.array(v, pa.int32()) for k, v in (("left_id", left), ("right_id", right), ("rank", rank))})
        self.tokens = pa.array(list(self.ranks), pa.large_binary())
        self.ids = np.array(list(self.ranks.values()), dtype=np.int32)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.starts = {token[:n] for token in self.ranks for n in range(1, len(token) + 1)}


_tables: dict[str, _Tables] = {}


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def _ragged(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """The runs of ``data`` between consecutive ``ends`` (counted in elements), as binary values."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends * data.itemsize)), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends and bytes of an array of binary values without nulls."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], raw


class Codec:
    """The tables of a vocabulary and a DuckDB connection of one task. A Python worker outlives its task and keeps only the tables."""

    def __init__(self, path: str) -> None:
        import duckdb

        if path not in _tables:
            _tables[path] = _Tables(path)
        self.tables = _tables[path]
        self.scratch = tempfile.TemporaryDirectory(prefix="bpe-", ignore_cleanup_errors=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": self.scratch.name})
        self._table("merges", self.tables.merges)
        self._table("vocabulary", pa.table({"id": self.tables.ids, "hex": pa.array([token.hex() for token in self.tables.ranks])}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    def close(self) -> None:
        self.db.close()
        self.scratch.cleanup()
        pa.default_memory_pool().release_unused()

    def cuts(self, word: bytes) -> np.ndarray:
        """Places inside ``word`` that no token of the vocabulary, read anywhere in it, lies across; no merge can cross them."""
        starts, ranks, n = self.tables.starts, self.tables.ranks, len(word)
        reach = np.arange(1, n + 1)
        for i in range(n):
            end = i + 2
            while end <= n and word[i:end] in starts:
                if word[i:end] in ranks:
                    reach[i] = end
                end += 1
        return np.flatnonzero(np.maximum.accumulate(reach)[:-1] == np.arange(1, n)) + 1

    def _contract(self, size: np.ndarray, ids: np.ndarray, query: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces of ``size`` bytes each, in a row, and the number of tokens of each piece."""
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self.db.register("start", pa.table({"w": owner, "pos": at, "id": ids}))
        out = self.db.execute(query).fetchnumpy()
        self.db.unregister("start")
        return np.asarray(out["id"], dtype=np.int32), np.bincount(np.asarray(out["w"]), minlength=len(size))

    def contract(self, ends: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words between ``ends`` in a row, and the number of tokens of each word."""
        size = np.diff(ends)
        borders = [ends[:-1]]
        for i in np.flatnonzero(size > LONG).tolist():
            borders.append(self.cuts(raw[ends[i] : ends[i + 1]].tobytes()) + ends[i])
        begin = np.sort(np.concatenate(borders))
        piece = np.diff(np.append(begin, ends[-1]))
        ids = self.tables.byte_ids[raw]
        long = piece > LONG
        counts = np.zeros(len(piece), dtype=np.int64)
        found = []
        for chosen, query in ((~long, CONTRACT), (long, CONTRACT_LONG)):
            if chosen.any():
                tokens, counts[chosen] = self._contract(piece[chosen], ids[np.repeat(chosen, piece)], query)
                found.append((chosen, tokens))
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for chosen, tokens in found:
            out[np.repeat(chosen, counts)] = tokens
        return out, np.add.reduceat(counts, np.searchsorted(begin, ends[:-1]))

    def join_tokens(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Bytes of each run of tokens; ``counts`` gives the runs' lengths."""
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.db.register("coded", pa.table({"w": owner, "pos": np.arange(len(ids), dtype=np.int64), "id": ids}))
        out = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("coded")
        found = out.column("bytes").combine_chunks().cast(pa.large_binary())
        if len(found) == len(counts):
            return found
        at = np.full(len(counts), -1)
        at[out.column("w").to_numpy()] = np.arange(len(found))
        return found.take(pa.array(at, mask=at < 0)).fill_null(b"")

    def words(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each word its token ids (as the bytes of 32-bit integers) and the bytes these decode to."""
        words = words.cast(pa.large_binary())
        coded, decoded = [], []
        begin, ends = 0, _flat(words)[0]
        while begin < len(words):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + BYTES_PER_QUERY, "right")) - 1)
            part = words.slice(begin, end - begin)
            whole = pc.index_in(part, value_set=self.tables.tokens)
            is_loose = whole.is_null().to_numpy(zero_copy_only=False)
            counts = np.ones(len(part), dtype=np.int64)
            loose = np.zeros(0, np.int32)
            if is_loose.any():
                loose, counts[is_loose] = self.contract(*_flat(part.filter(pa.array(is_loose))))
            ids = np.empty(int(counts.sum()), dtype=np.int32)
            mask = np.repeat(is_loose, counts)
            ids[mask] = loose
            ids[~mask] = self.tables.ids[whole.drop_null().to_numpy()]
            coded.append(_ragged(_ends(counts), ids))
            decoded.append(self.join_tokens(ids, counts))
            begin = end
        none = [pa.array([], pa.large_binary())]
        return pa.concat_arrays(coded or none), pa.concat_arrays(decoded or none)


@contextmanager
def codec(path: str) -> Iterator[Codec]:
    tool = Codec(path)
    try:
        yield tool
    finally:
        tool.close()


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern in Java's syntax, with white space in the Unicode sense."""
    return pattern.replace(r"[^\s", rf"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")


def _join(parts: pa.Array, indices: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document, the joined parts of its words: ends and the bytes."""
    ends, raw = _flat(parts.take(indices))
    return ends[offsets], raw


def encode(df: DataFrame, text: str = "text", *, vocabulary: str, pattern: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the column ``ids`` (array of int) and, if ``decoded`` is named, the bytes (binary) that these ids decode to.

    ``vocabulary`` is a rank file, ``pattern`` the expression whose matches are encoded each on its own, without special tokens. Rows stay
    as they are and where they are: there is no shuffle. Null text counts as empty and has no ids. Other columns are kept; columns of
    ``df`` that carry the names of new ones are replaced. Memory is bounded by one Arrow batch and DuckDB's limit.
    """
    keep = [c for c in df.columns if c not in (ids, decoded)]
    split = df.select(*[F.col(f"`{c}`") for c in keep], F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0)).alias("_words"))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.BinaryType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(vocabulary) as tool:
            for whole in batches:
                lists = whole.column(whole.num_columns - 1)
                offsets = np.asarray(lists.offsets, dtype=np.int64)
                values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
                offsets = offsets - offsets[0]
                coded, joined = tool.words(values.dictionary)
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    rows = offsets[at : at + batch.num_rows + 1]
                    indices = values.indices.slice(rows[0], rows[-1] - rows[0])
                    ends, raw = _join(coded, indices, rows - rows[0])
                    out = list(batch.columns[:-1])
                    out.append(pa.ListArray.from_arrays(pa.array((ends // 4).astype(np.int32)), pa.Array.from_buffers(pa.int32(), int(ends[-1]) // 4, [None, pa.py_buffer(raw)])))
                    if decoded:
                        ends, raw = _join(joined, indices, rows - rows[0])
                        out.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]))
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return split.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", *, vocabulary: str, decoded: str = "decoded") -> DataFrame:
    """``df`` with the column ``decoded`` (binary): the bytes of the tokens in ``ids``; null ids count as none, unknown ids raise an error."""
    keep = [c for c in df.columns if c != decoded]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(vocabulary) as tool:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    lists = [np.array(x or [], dtype=np.int32) for x in batch.column(keep.index(ids)).to_pylist()]
                    flat = np.concatenate([*lists, np.zeros(0, np.int32)])
                    if len(flat) and (flat.min() < 0 or flat.max() >= len(tool.tables.ranks)):
                        raise ValueError("an id is not in the vocabulary")
                    texts = tool.join_tokens(flat, np.array([len(x) for x in lists], dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.binary())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
