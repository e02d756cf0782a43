"""Approximate matching of names: best reference for each value, approximate joins and comparisons.

The score is twice the longest common subsequence over the total length, in percent; with ``sort_tokens`` the words
are sorted first. Candidates come from an index of framed q-grams: at a threshold s a text may lose a bounded number
of its grams, so of its rarest (bound + 1) grams at least one stands among the rarest of every partner. Lists are kept
by gram and length, and a text looks only into the lists of lengths that can reach the threshold. A long list is
dealt over several tasks. Pairs that meet pass two native bounds, edit distance and common letters, before they are
scored. Values are made distinct, and equal texts are matched by equality, before that.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from comptoir.functions.text import SPACE, none_if_blank
from comptoir.operators.joins import comparison_key
from comptoir.session import cut_lineage

LOWEST = 70  # below this a text may lose all of its grams
LIST = 1000  # texts of a list that stay in one task
CELLS = 1 << 20  # cells of the tables of one step of the score


def common_lengths(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, one row of all their tables at a time.

    With one more letter of the left text, the best up to a place of the right one is the old best there, or one more
    than the old best before an equal letter that stands at the place or earlier.
    """
    out = np.zeros(len(left), dtype=np.int32)
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right)], dtype=np.int64).reshape(-1, 2)
    order = np.lexsort((sizes[:, 0], sizes[:, 1]))
    at = 0
    while at < len(order):
        width = max(int(sizes[order[at], 1]), 1)
        part = order[at:at + max(1, CELLS // (2 * width))]
        part = part[sizes[part, 1] <= 2 * width]
        at += len(part)
        height, width = sizes[part].max(axis=0)
        a, b = (_letters([texts[i] for i in part], size) for texts, size in ((left, height), (right, width)))
        best = np.zeros((len(part), width + 1), dtype=np.int32)
        for i in range(height):
            here = a[:, i:i + 1]
            more = np.where((b == here) & (here > 0), best[:, :-1] + 1, best[:, 1:])
            best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], more), axis=1)
        out[part] = best[:, -1]
    return out


def _letters(texts: list[str], size: int) -> np.ndarray:
    """Code points plus one of each text in a row, zeros after its end."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), size), dtype=np.uint32)
    out[np.arange(size) < lengths[:, None]] = flat + 1
    return out


@F.pandas_udf(IntegerType())
def common_length(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(common_lengths(left.tolist(), right.tolist()))


def score(left: str, right: str) -> Column:
    """Similarity of two text columns in percent."""
    return F.lit(200.0) * common_length(left, right) / (F.length(left) + F.length(right))


def sorted_words(col: Column) -> Column:
    words = F.filter(F.split(col, SPACE + "+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def gram_size(threshold: float) -> int:
    """Longer grams for higher thresholds, such that a text keeps at least some third of them."""
    s = threshold / 100.0
    return int(min(5, max(2, (0.6 / (1 - s) + 1) // 2)))


def _lost(size: Column, threshold: float) -> Column:
    """Largest number of grams a text may lose to a partner that reaches the threshold.

    With x letters dropped and y added, x (2 - s) + y s is at most 2 (1 - s) times the length; a letter dropped costs
    q grams, one added q - 1.
    """
    s, q = threshold / 100.0, gram_size(threshold)
    return F.floor(size * F.lit(max(q / (2 - s), (q - 1) / s) * 2 * (1 - s)) + F.lit(1e-9)).cast("int")


def _grams(texts: DataFrame, threshold: float) -> DataFrame:
    """(t, n, gram) of every text t of n letters; a gram that stands several times is numbered."""
    q = gram_size(threshold)
    frame = F.lit("\u0001" * (q - 1))
    framed = texts.select("t", F.length("t").alias("n"), F.concat(frame, "t", frame).alias("f"))
    cut = F.transform(F.sequence(F.lit(1), F.col("n") + q - 1), lambda i: F.substring("f", i, F.lit(q)))
    grams = F.array_sort(cut)
    numbered = F.transform(grams, lambda g, i: F.struct(g.alias("gram"), (i + 1 - F.array_position(grams, g)).cast("int").alias("k")))
    return framed.select("t", "n", F.explode(numbered).alias("gram"))


def _rarest(grams: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """(t, n, gram) of the rarest grams of each text, as many as one more than it may lose."""
    ranked = grams.join(counts, "gram", "left").groupBy("t", "n").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram"))).alias("g"))
    few = F.slice("g", F.lit(1), _lost(F.col("n"), threshold) + 1)
    return ranked.select("t", "n", F.explode(F.transform(few, lambda g: g["gram"])).alias("gram"))


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (l, r) texts that may reach the threshold; every pair that does is among them."""
    s = threshold / 100.0
    asked, known = (_grams(df.select(F.col(c).alias("t")), threshold) for df, c in ((left, "l"), (right, "r")))
    counts = known.groupBy("gram").agg(F.count("*").alias("texts"))
    lists = cut_lineage(_rarest(known, counts, threshold).select("gram", F.col("n").alias("rn"), F.col("t").alias("r")))
    # A list longer than LIST is dealt into parts; who looks into it looks into all of them.
    parts = lists.groupBy("gram", "rn").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts"))
    dealt = lists.join(parts, ["gram", "rn"]).select("gram", "rn", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int").alias("part"), "r")
    shortest, longest = F.ceil(F.col("n") * F.lit(s / (2 - s)) - F.lit(1e-9)), F.floor(F.col("n") * F.lit((2 - s) / s) + F.lit(1e-9))
    looks = _rarest(asked, counts, threshold).select("gram", F.col("t").alias("l"), F.explode(F.sequence(shortest.cast("int"), longest.cast("int"))).alias("rn"))
    spread = looks.join(parts, ["gram", "rn"]).select("gram", "rn", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "l")
    return spread.join(dealt, ["gram", "rn", "part"]).select("l", "r").distinct()


def may_reach(threshold: float) -> Column:
    """Two bounds of the score of ``l`` and ``r``: the edit distance is at most the letters dropped and added, and the common
    subsequence at most the letters both hold."""
    total = F.length("l") + F.length("r")
    allowed = F.floor(F.lit(1 - threshold / 100.0) * total + F.lit(1e-9)).cast("int")
    within = F.expr(f"levenshtein(l, r, cast(floor({1 - threshold / 100.0!r} * (length(l) + length(r)) + 1e-9) as int)) >= 0")

    def held(text: str, letter: Column) -> Column:
        return F.length(text) - F.length(F.replace(F.col(text), letter, F.lit("")))

    letters = F.array_distinct(F.split("l", ""))
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(held("l", c), held("r", c))))
    return within & (total - 2 * common <= allowed)


def pairs_above(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r, score) of all distinct texts of both sides at or above the threshold, equal texts included."""
    if not LOWEST <= threshold <= 100:
        raise ValueError(f"the threshold must be between {LOWEST} and 100")
    equal = left.join(right, F.col("l") == F.col("r")).select("l", "r", F.lit(100.0).alias("score"))
    if threshold == 100:
        return equal
    close = candidate_pairs(left, right, threshold).where("l <> r").where(may_reach(threshold)).withColumn("score", score("l", "r"))
    return equal.unionByName(close.where(F.col("score") >= threshold))


def _texts(df: DataFrame, column: str, name: str, sort_tokens: bool) -> DataFrame:
    value = F.col(column).cast("string")
    text = sorted_words(value) if sort_tokens else value
    return df.select(none_if_blank(text).alias(name)).where(F.col(name).isNotNull()).distinct()


def best_association(left: DataFrame, left_column: str, reference: DataFrame, reference_column: str, results: Sequence[str],
                     order: str, threshold: float = 80, sort_tokens: bool = True) -> DataFrame:
    """Best reference for each value, with its result columns and score; the first by ``order`` wins a tie.

    A value equal to a reference text needs no search: nothing scores higher.
    """
    def key(column: str) -> Column:
        value = F.col(column).cast("string")
        return none_if_blank(sorted_words(value) if sort_tokens else value)

    known = reference.where(F.col(reference_column).isNotNull()).withColumn("r", key(reference_column))
    row = F.struct(F.col(reference_column).cast("string").alias("valeur"), *[F.col(c) for c in results])
    firsts = known.groupBy("r").agg(F.min(order).alias("__o"), F.min_by(row, F.col(order)).alias("__row"))
    asked = _texts(left, left_column, "l", sort_tokens)
    refs = firsts.select("r")
    exact = asked.join(refs, F.col("l") == F.col("r"), "left_semi")
    rest = asked.join(refs, F.col("l") == F.col("r"), "left_anti")
    pairs = exact.select("l", F.col("l").alias("r"), F.lit(100.0).alias("score"))
    if threshold < 100:
        pairs = pairs.unionByName(pairs_above(rest, refs, threshold))
    best = pairs.join(firsts, "r").groupBy("l").agg(
        F.min_by(F.struct("score", "__row"), F.struct((-F.col("score")).alias("s"), F.col("__o"))).alias("b"))
    found = best.select("l", F.col("b.score").alias("score"), F.col("b.__row").alias("row"))
    joined = left.withColumn("__l", key(left_column)).join(found, F.col("__l") == F.col("l"), "left")
    return joined.select(
        *left.columns, F.col("row.valeur").alias("valeur_associee"), F.col("score").alias("pct_approximation"),
        *[F.col(f"row.{c}").alias(f"{c}_associe") for c in results])


def _matches(left: DataFrame, right: DataFrame, column: str, threshold: float) -> DataFrame:
    """(__left, __match): the best right value for each left value of a column, the smallest text of equal scores."""
    values = right.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().withColumn("__o", F.col("v"))
    matched = best_association(left.select(column).distinct(), column, values, "v", [], "__o", threshold)
    return matched.select(F.col(column).alias("__left"), F.col("valeur_associee").alias("__match")).where("__match IS NOT NULL")


def approximate_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", threshold: float = 90,
                     suffixes: tuple[str, str] = ("_gauche", "_droite")) -> DataFrame:
    """Join on the best match of each left value among the right values, for each key column by itself.

    A row joins where the matches of all its key columns stand together in a right row. Columns of both tables, the key
    columns among them, get a suffix. A null key matches nothing.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError("how must be inner, left, right or outer")
    shared = [c for c in left.columns if c in right.columns]
    linked = left.select(*[F.col(c).alias(c + suffixes[0]) if c in shared else F.col(c) for c in left.columns])
    b = right.select(*[F.col(c).alias(c + suffixes[1]) if c in shared else F.col(c) for c in right.columns])
    for i, key in enumerate(keys):
        link = _matches(left, right, key, threshold).select(F.col("__left").alias(f"__left{i}"), F.col("__match").alias(f"__match{i}"))
        linked = linked.join(link, F.col(key + suffixes[0]) == F.col(f"__left{i}"), "left").drop(f"__left{i}")
    meets = reduce(lambda x, y: x & y, [F.col(f"__match{i}") == F.col(key + suffixes[1]).cast("string") for i, key in enumerate(keys)])
    return linked.join(b, meets, how).drop(*[f"__match{i}" for i in range(len(keys))])


def approximate_join_all(tables: Sequence[DataFrame], on: str | Sequence[str], how: str = "inner", threshold: float = 90,
                         suffixes: tuple[str, str] = ("_gauche", "_droite"), with_source: bool = False) -> DataFrame:
    """Join tables one after the other, each by the keys of the first; a threshold of 100 asks for equal keys.

    The keys keep their names; those of the second table and the following ones get the right suffix and, from the third
    on, the table's number. Other columns found on both sides get a suffix, and a number where that name is taken.
    """
    if len(tables) < 2:
        raise ValueError("at least two tables are needed")
    keys = [on] if isinstance(on, str) else list(on)
    frames = [t.withColumn("Source", F.lit(f"df_{i}")) for i, t in enumerate(tables)] if with_source else list(tables)
    out = frames[0]
    for i, right in enumerate(frames[1:], 1):
        number = "" if i == 1 else f"_{i}"

        def free(name: str, taken: Sequence[str]) -> str:
            return name + number if name in taken else name  # noqa: B023

        joined = approximate_join(out, right, keys, how, threshold, ("\u0001l", "\u0001r"))
        names: list[str] = []
        for c in joined.columns:
            base, side = (c[:-2], c[-1]) if c[-2:-1] == "\u0001" else (c, "")
            if base in keys:
                names.append(base if side == "l" else base + suffixes[1] + number)
            else:
                names.append(free(base + {"l": suffixes[0], "r": suffixes[1], "": ""}[side], names))
        out = joined.toDF(*names)
    return out


def compare_values_approximately(left: DataFrame, left_columns: Sequence[str], right: DataFrame, right_columns: Sequence[str],
                                 threshold: float = 90, clean: bool = True) -> DataFrame:
    """Distinct values with a partner at the threshold on the other side, or without one."""
    a = left.select(comparison_key(left_columns, clean).alias("l")).where("l IS NOT NULL").distinct()
    b = right.select(comparison_key(right_columns, clean).alias("r")).where("r IS NOT NULL").distinct()
    pairs = pairs_above(a, b, threshold)
    mine = a.join(pairs.select("l").distinct().withColumn("hit", F.lit(True)), "l", "left")
    theirs = b.join(pairs.select("r").distinct(), "r", "left_anti")
    marked = mine.select(F.col("l").alias("cle"), F.when(F.col("hit"), "commun").otherwise("premier seulement").alias("presence"))
    return marked.unionByName(theirs.select(F.col("r").alias("cle"), F.lit("second seulement").alias("presence")))
