"""Spelling variants of words by an index of variable-length grams.

Words are framed by ``^`` and ``$``. The gram that starts at a place is the shortest piece of at least two letters that is rare, or ends the
word, or has five letters; so the dictionary holds a long gram only where its shorter beginnings are frequent. An edit of one letter touches
the grams that lie over its place and no others, since where a gram ends depends on its own letters alone. The largest number of grams that
one edit can touch is the word's bound; at least one of its (bound + 1) rarest grams therefore stands in every near word, at the same place
or one further on. Only the lists of those grams are merged, and the other, longer ones are skipped. Since a word of five letters has six
grams and an edit touches at most five, no word is without such a gram. Every pair met is verified by its edit distance.

A gram of five letters may still be frequent. Where a list is, its words are dealt by all that stands up to the gram or by all that stands from
it on: the one edit is on one side of the gram, so the other side is equal.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir.session import cut_lineage

#: Letters of a gram, at least and at most. A gram is frequent when it stands in more than RARE places, and in a larger share of all than 1 in MOST.
SHORTEST, LONGEST, RARE, MOST = 2, 5, 16, 1 << 20
#: Words a task counts before it hands them on.
HELD = 300_000
WORD = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _start(doc: int | None) -> int:
    return zlib.crc32(f"{'' if doc is None else doc}:".encode())


def _shortened(run: str, code: int) -> str:
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def misspell(doc: int | None, run: str, every: int) -> str:
    """The run, without one code point if ``every`` divides the CRC-32 of ``<doc>:<run>``; a null id is written as nothing."""
    code = zlib.crc32(run.encode(), _start(doc))
    return run if code % every else _shortened(run, code)


def count_words(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", drop_every: int = 0) -> DataFrame:
    """Rows (word, n): the runs of letters of all texts, A-Z lower-cased, and how often each stands; null texts have none.

    With ``drop_every`` the runs pass ``misspell`` first. A task holds the words of one text and those counted since it last handed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    start = _start(doc.as_py())
                    for word, n in Counter(WORD.findall(text.as_py())).items():
                        lower = word if word.islower() else word.translate(LOWER)
                        held[_shortened(lower, code) if drop_every and not (code := zlib.crc32(lower.encode(), start)) % drop_every else lower] += n
                if len(held) > HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    some = df.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).mapInArrow(run, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """Places of each frequent gram. All grams stand in some 4 x letters places, so there are at most MOST for each length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["g", "n"])
            held.clear()
            return out

        for batch in batches:
            for word in batch.column(0).to_pylist():
                framed = f"^{word}$"
                for size in range(SHORTEST, LONGEST + 1):
                    held.update([framed[at : at + size] for at in range(len(framed) - size + 1)])
                if len(held) > HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    grams = words.select("word").mapInArrow(run, "g string, n long")
    counts = cut_lineage(grams.groupBy("g").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(RARE, total // MOST)
    return {r.g: r.n for r in counts.filter(F.col("n") > limit).collect()}


def decompose(word: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """Start and end of the gram at each place of the framed ``word``."""
    size, out = len(word), []
    for start in range(size - SHORTEST + 1):
        end = start + SHORTEST
        while end < size and end - start < LONGEST and word[start:end] in frequent:
            end += 1
        out.append((start, end))
    return out


def bound(grams: list[tuple[int, int]], size: int) -> int:
    """The largest number of grams over one letter of a framed word of ``size``, frame excluded; what lies over a gap is never more."""
    over = [0] * (size + 1)
    for start, end in grams:
        over[start] += 1
        over[end] -= 1
    most, now = 0, 0
    for place in range(size - 1):
        now += over[place]
        if place:
            most = max(most, now)
    return most


def rarest(word: str, frequent: dict[str, int]) -> list[tuple[int, int, bool]]:
    """Start, end and whether it is frequent, of the (bound + 1) rarest grams of the framed word."""
    framed = f"^{word}$"
    grams = decompose(framed, frequent)
    ranked = sorted(grams, key=lambda g: (frequent.get(framed[g[0] : g[1]], 0), framed[g[0] : g[1]], g[0]))
    return [(start, end, framed[start:end] in frequent) for start, end in ranked[: bound(grams, len(framed)) + 1]]


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, b, a_n, b_n), one for each two words of ``words`` (word, n) of which one letter inserted, deleted or replaced in one gives
    the other. Words are distinct and have at least five letters."""
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words))
    gram = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("often", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [[{"start": s, "end": e, "often": o} for s, e, o in rarest(word, frequent.value)] for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, gram)], names=["word", "n", "grams"])

    kept = cut_lineage(words.select("word", "n").mapInArrow(run, "word string, n long, grams array<struct<start: int, end: int, often: boolean>>"))
    # A list is named by the words' length, a place and a piece of the word: the gram where it starts, or, if it is frequent, all up to
    # its end (-1) and all from its start on (-2). A word looks into the lists of its own length and into those of words one longer, in
    # which a letter more may have moved the gram.
    at = kept.select("word", "n", F.length("word").alias("size"), F.concat(F.lit("^"), "word", F.lit("$")).alias("w"), F.explode("grams").alias("g"))

    def piece(place: str | int, text: str) -> str:
        return f"struct({place} AS place, {text} AS piece)"

    left, right = piece(-1, "substring(w, 1, g.end)"), piece(-2, "substring(w, g.start + 1)")
    own, moved = piece("g.start", "substring(w, g.start + 1, g.end - g.start)"), piece("g.start + 1", "substring(w, g.start + 1, g.end - g.start)")
    listed = at.select("word", "n", "size", F.explode(F.expr(f"if(g.often, array({left}, {right}), array({own}))")).alias("p"))
    longer = at.select("word", "n", (F.col("size") + 1).alias("size"), F.explode(F.expr(f"if(g.often, array({left}, {right}), array({own}, {moved}))")).alias("p"))

    def keyed(df: DataFrame, word: str, n: str) -> DataFrame:
        return df.select(F.xxhash64("size", "p.place", "p.piece").alias("key"), F.col("word").alias(word), F.col("n").alias(n))

    lists = keyed(listed, "b", "b_n")
    equal = keyed(listed, "a", "a_n").join(lists, "key").filter("a < b")
    unequal = keyed(longer, "a", "a_n").join(lists, "key").filter("length(a) < length(b)")
    return equal.unionAll(unequal).filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "a_n", "b_n").distinct()


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for every row of ``words`` (word, n).

    ``form`` is the most frequent near word (ties: the least) if it stands at least ``times`` as often, ``times`` being over 1; ``root`` is
    where the forms lead in the end. Words of less than five letters are refused, since they may have no gram that an edit leaves whole.
    """
    if times <= 1:
        raise ValueError("times must be over 1, or forms could go round in circles")
    words = cut_lineage(words.select("word", "n"))
    if not words.filter(F.length("word") < LONGEST).isEmpty():
        raise ValueError(f"words need {LONGEST} letters at least")
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.expr("array(struct(a AS word, b AS other, b_n AS m), struct(b AS word, a AS other, a_n AS m))")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("near"), (-F.col("best.less")).alias("near_n"))
    fits = F.col("near_n") >= times * F.col("n")
    formed = cut_lineage(joined.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")))

    # Each step doubles the way; n grows by ``times`` on every link, so there are few.
    way = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = cut_lineage(way.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if way.filter("moved").isEmpty():
            break
        way = way.select("word", "root")
    return formed.join(way.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
