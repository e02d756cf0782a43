"""Personal data: fixed patterns, and boosted trees over the candidates of wider generators.

Generators with high recall propose spans that may overlap each other and the fixed ones. A candidate is positive if its value, without
separators and written-out signs, is that of a fixed span anywhere, or if its format and context speak for it (``_evident``); whether it meets
a fixed span does not count. Format and context become small bins; one aggregation counts positives and negatives for each combination of
bins, so the trees are fitted on a table whose size is bounded by the bins and not by the corpus. A fold of the texts is held out: for each
kind its candidates that meet no fixed span set the least score at which enough are positive. Those over that score are added.

Everything that touches rows is DataFrame and SQL functions; the trees become CASE expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from comptoir.session import scratch_path

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Fixed patterns. A word before @ is tried once, from its first character or from the end of the match before.
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators: addresses with spaces or written-out signs, and any group of seven or more digits and separators.
_WIDE_ADDRESS = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ {{0,2}}(?:@|[(\[]at[)\]]) {{0,2}}[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++"
_WIDE_DIGITS = r"[+(]?[0-9][0-9\x20().-]{5,}[0-9]"

FEATURES = ("kind", "digits", "spaces", "dashes", "dots", "brackets", "plus", "before", "after", "hint", "length")
TREES, RATE = 40, 0.3
#: Share of positives, by the lower bound of its 95 % interval, that held-out candidates of a kind must reach.
PRECISION = 0.95


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost matches that do not overlap, in code points. A match stands where its own string is next
    found, since that string would have matched there."""
    empty = F.expr("named_struct('found', cast(array() as array<struct<start: int, end: int, value: string>>), 'at', 1)")

    def add(acc: Column, value: Column) -> Column:
        def put(at: Column) -> Column:
            end = at + F.length(value)
            item = F.struct((at - 1).alias("start"), (end - 1).alias("end"), value.alias("value"))
            return F.struct(F.concat(acc["found"], F.array(item)).alias("found"), end.alias("at"))

        return F.transform(F.array(F.call_function("locate", value, text, acc["at"])), put)[0]

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), empty, add, lambda acc: acc["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    size = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, size - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return size.between(14, 19) & (F.when(size.between(14, 19), F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10) == 0)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.right(x, F.lit(3)).cast("int"), F.lit(0)) <= 255))


def _fixed(text: Column) -> Column:
    """Array of (start, kind number, end) of the fixed spans, in order."""
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")
    found = (
        F.when(text.contains("@"), _spans(text, _EMAIL)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_spans(text, _IP), lambda x: _octets(x["value"]))).otherwise(none),
        F.filter(_spans(text, _CARD), lambda x: _luhn(x["value"])),
        F.when(text.contains("+"), F.filter(_spans(text, _PHONE), lambda x: F.length(_digits(x["value"])).between(10, 15))).otherwise(none),
    )
    return F.array_sort(F.concat(*(_of_kind(spans, k) for k, spans in enumerate(found))))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _count(value: Column, kept: str, most: int) -> Column:
    return F.least(F.length(F.regexp_replace(value, f"[^{kept}]", "")), F.lit(most))


def _value_key(value: Column, kind: Column) -> Column:
    """Hash of kind and value: an address in lower case with its signs and without spaces, an IP number as it is, otherwise the digits."""
    signs = F.regexp_replace(F.regexp_replace(F.lower(value), r"[(\[]at[)\]]", "@"), r"[(\[]dot[)\]]", ".")
    return F.xxhash64(kind.cast("int"), F.when(kind == 0, F.regexp_replace(signs, " ", "")).when(kind == 1, value).otherwise(_digits(value)))


def _evident(value: Column, kind: Column, digits: Column, hint: Column) -> Column:
    """Whether the format and the words before a candidate speak for it: check digit, valid octets, or a hint of its kind and a plausible end or length."""
    address = (hint == 3) & F.lower(value).rlike(r"[a-z]{2}$")
    return F.when(kind == 0, address).when(kind == 1, _octets(value)).when(kind == 2, _luhn(value)).otherwise((hint == 1) & digits.between(10, 15))


def _candidates(text: Column) -> Column:
    """Array of (start, end, features..., key, evident) of what the generators propose."""
    address = F.when(text.contains("@") | text.contains("(at)") | text.contains("[at]"), _spans(text, _WIDE_ADDRESS))
    wide = F.concat(F.coalesce(address, F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")), _spans(text, _WIDE_DIGITS))

    def side(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[A-Za-z]$"), 2).when(c.rlike("^[0-9]$"), 3).otherwise(4)

    def describe(x: Column) -> Column:
        v, digits = x["value"], F.length(_digits(x["value"]))
        lead = F.lower(F.substring(text, F.greatest(x["start"] - 15, F.lit(1)), F.least(x["start"], F.lit(16))))
        kind = F.when(v.rlike(r"@|[(\[]at[)\]]"), 0).when(v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 1).when(~v.startswith("+") & (digits >= 14), 2).otherwise(3)
        hint = F.when(lead.rlike("phone|tel|call|fax|mobil"), 1).when(lead.rlike("card|visa|pay|account"), 2).when(lead.rlike("mail|contact|write"), 3).when(lead.rlike(r"ip\b|addr|host|server"), 4).when(lead.rlike(r"[=:#]\W*$"), 5).otherwise(0)
        values = (kind, F.least(digits, F.lit(20)), _count(v, r"\x20", 4), _count(v, r"\-", 4), _count(v, r"\.", 4), _count(v, r"()\[\]", 3), v.startswith("+").cast("int"),
                  F.when(x["start"] == 0, 0).otherwise(side(F.substring(text, x["start"], F.lit(1)))), side(F.substring(text, x["end"] + 1, F.lit(1))), hint, F.least(F.floor(F.length(v) / 4), F.lit(8)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), *(c.cast("int").alias(n) for c, n in zip(values, FEATURES, strict=True)),
                        _value_key(v, kind).alias("key"), _evident(v, kind, digits, hint).alias("evident"))

    return F.transform(wide, describe)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, int] | None:
    best = None
    total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(x[rows, f])[:-1].tolist():
            left = rows & (x[:, f] <= cut)
            right = rows & ~left
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - total
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, f, cut)
    return best


def grow(x: np.ndarray, positives: np.ndarray, negatives: np.ndarray, depth: int = 3) -> list[list]:
    """Boosted trees on counted rows by Newton steps of the logistic loss: each a list of (conditions, value)."""
    score = np.zeros(len(x))
    n = positives + negatives
    trees = []
    for _ in range(TREES):
        p = _sigmoid(score)
        g, h = positives - n * p, n * p * (1 - p)
        leaves, todo = [], [(np.ones(len(x), dtype=bool), [])]
        while todo:
            rows, path = todo.pop()
            found = _split(x, g, h, rows) if len(path) < depth else None
            if found is None:
                leaves.append((path, RATE * float(g[rows].sum() / (h[rows].sum() + 1))))
                score[rows] += leaves[-1][1]
                continue
            _, f, cut = found
            low = x[:, f] <= cut
            todo += [(rows & low, [*path, (f, True, cut)]), (rows & ~low, [*path, (f, False, cut)])]
        trees.append(leaves)
        if np.abs(g).sum() < 1e-3 * max(1, n.sum()):
            break
    return trees


def scores(trees: list[list], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for leaves in trees:
        for path, value in leaves:
            rows = np.ones(len(x), dtype=bool)
            for f, low, cut in path:
                rows &= (x[:, f] <= cut) == low
            out[rows] += value
    return out


def calibrated(score: np.ndarray, positives: np.ndarray, negatives: np.ndarray) -> float | None:
    """The least score at which the held-out candidates from there on are positive often enough; None if none is."""
    best = None
    for cut in np.unique(score)[::-1]:
        n, k = (positives + negatives)[score >= cut].sum(), positives[score >= cut].sum()
        share, z = (k / n, 1.96) if n else (0.0, 1.96)
        low = (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n) if n else 0
        if low >= PRECISION:
            best = float(cut)
    return best


def fit(counts: Sequence[Row]) -> tuple[list[list], dict[int, float]]:
    """Trees of the rows of the even folds, and each kind's least score by those of the odd fold."""
    x = np.array([[r[f] for f in FEATURES] for r in counts], dtype=np.int64).reshape(-1, len(FEATURES))
    held, pos, neg = (np.array([r[c] for r in counts], dtype=float) for c in ("held", "positives", "negatives"))
    train = held == 0
    if not len(x) or not pos[train].sum() or not neg[train].sum():
        return [], {}
    trees = grow(x[train], pos[train], neg[train])
    score = scores(trees, x)
    cuts = {k: calibrated(score[~train & (x[:, 0] == k)], pos[~train & (x[:, 0] == k)], neg[~train & (x[:, 0] == k)]) for k in range(len(KINDS))}
    return trees, {k: cut for k, cut in cuts.items() if cut is not None}


def _score(c: Column, trees: list[list]) -> Column:
    total = F.lit(0.0)
    for leaves in trees:
        value = None
        for path, leaf in leaves:
            test = F.lit(True)
            for f, low, cut in path:
                test = test & ((c[FEATURES[f]] <= cut) if low else (c[FEATURES[f]] > cut))
            value = F.when(test, leaf) if value is None else value.when(test, leaf)
        total = total + value.otherwise(0.0)
    return total


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text, with ``base`` and ``spans``: arrays of (start, kind, end) in code points, ``kind`` a place in ``KINDS``.

    ``base`` has the fixed spans, ``spans`` these and the candidates the trees select, which never meet a fixed span; of selected candidates
    that meet, the first by start and end stays. Null text counts as empty. Texts are read once: what is found is written to the shared folder,
    counted, and read again. Repeated rows stay; columns of ``df`` named like new ones are replaced.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in (text, "base", "spans")]
    value = F.col("_text")
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    some = value.rlike(r"[0-9@]|[(\[]at[)\]]")
    marked = rows.withColumn("base", F.when(some, _fixed(value)))
    keys = F.transform("base", lambda b: _value_key(F.substring(value, b["start"] + 1, b["end"] - b["start"]), b["kind"]))
    marked = marked.withColumn("_keys", keys).withColumn("_candidates", F.when(some, _candidates(value))).withColumn("_held", (F.pmod(F.xxhash64("_text"), F.lit(2))).cast("int"))
    path = scratch_path(spark, "pii")
    marked.drop("_text").write.parquet(path)
    found = spark.read.parquet(path)
    meets = F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    each = found.filter("size(_candidates) > 0").select("_held", "base", F.explode("_candidates").alias("c")).filter((F.col("_held") == 0) | ~meets)
    valued = each.groupBy(F.col("_held").alias("held"), *(F.col(f"c.{f}") for f in FEATURES), "c.evident", "c.key").agg(F.count("*").alias("n"))
    known = found.select(F.explode("_keys").alias("key")).distinct().withColumn("known", F.lit(True))
    judged = valued.join(known, "key", "left").withColumn("positive", F.coalesce("evident", F.lit(False)) | F.coalesce("known", F.lit(False)))
    counts = judged.groupBy("held", *FEATURES).agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("positives"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("negatives"))
    trees, cuts = fit(sorted(counts.collect()))
    nothing = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    base = F.coalesce("base", nothing)
    added = nothing
    if cuts:
        limit = F.create_map(*[F.lit(x) for pair in sorted(cuts.items()) for x in pair])
        chosen = F.filter("_candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])) & (_score(c, trees) >= F.coalesce(limit[c["kind"]], F.lit(float("inf")))))
        ordered = F.array_sort(F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
        added = F.aggregate(ordered, nothing, lambda acc, c: F.when(F.size(acc) == 0, F.array(c)).when(F.element_at(acc, -1)["end"] <= c["start"], F.concat(acc, F.array(c))).otherwise(acc))
    return found.select(*[F.col(f"`{c}`") for c in keep], base.alias("base"), F.array_sort(F.concat(base, F.coalesce(added, nothing))).alias("spans"))


def count_of(spans: Column, kind: int) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
