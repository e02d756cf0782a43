"""URL verdicts: allow and block rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks, one row of eight 32-bit words each, built by an aggregation with bit-or. A URL looks at one block; if one of
its eight bits is missing it is not on the list. Possible hits go to an exact hash join with the list, which removes false positives. The
table of blocks is broadcast up to ``BROADCAST_BYTES`` and joined by block number beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed URL: about 1 % of false positives.
BITS = 12
BLOCK_BITS = 256
BROADCAST_BYTES = 32 << 20
#: Query parameters that canonical URLs leave out.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without slashes at its end, and the sorted parameters without tracking ones; null if there is no host.

    Scheme and fragment are left out, so http and https addresses of a page are one.
    """
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    fields = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    name = F.regexp_replace(host(url), r"^www\.", "")
    return F.when(name != "", F.concat(name, F.regexp_replace(path(url), "/+$", ""), F.when(fields != "", F.concat(F.lit("?"), fields)).otherwise("")))


def rule_of(at_host: Column, at_path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host/path) that fits, and its verdict; both null if none does. Of equally long ones the first in order wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((at_host == name) | at_host.endswith("." + name)) & at_path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _place(url: Column, blocks: int) -> list[Column]:
    """The block of a canonical URL and its bit in each of the eight words."""
    bits = F.xxhash64(url, F.lit(1))
    one = [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(31).cast("int")) for i in range(8)]
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), *(b.alias(f"bit{i}") for i, b in enumerate(one))]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row (block, word0..word7) for each block that holds a URL of ``listed`` (column ``canonical``)."""
    placed = listed.select(*_place(F.col("canonical"), blocks))
    return placed.groupBy("block").agg(*(F.bit_or(f"bit{i}").alias(f"word{i}") for i in range(8)))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``listed`` has canonical URLs in its column ``canonical``; nulls and repetitions in it do nothing. A rule's verdict stands; else a listed
    URL is blocked and any other allowed. Repeated rows of ``pages`` stay; columns named like new ones are replaced.
    """
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    inner = [f"in{i}" for i in range(len(keep))]  # no input name can clash with the operator's own
    listed = listed.select("canonical").filter("canonical IS NOT NULL").distinct()
    blocks = max(1, -(-listed.count() * BITS // BLOCK_BITS))
    table = bloom_filter(listed, blocks)
    value = F.col(f"`{url}`")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)], host(value).alias("host"), path(value).alias("path"), canonical(value).alias("_canonical"))
    rows = rows.withColumns({"rule": rule, "_ruled": verdict})
    rows = rows.select("*", *_place(F.col("_canonical"), blocks))
    probed = rows.join(F.broadcast(table) if blocks * 40 <= BROADCAST_BYTES else table, "block", "left")
    possible = F.coalesce(F.expr(" AND ".join(f"word{i} & bit{i} <> 0" for i in range(8))), F.lit(False)) & F.col("_canonical").isNotNull() & F.col("_ruled").isNull()
    probed = probed.select(*inner, "host", "path", "rule", "_ruled", "_canonical", possible.alias("_possible"))
    clear = probed.filter(~F.col("_possible")).withColumn("verdict", F.coalesce("_ruled", F.lit("allow")))
    exact = listed.select(F.col("canonical").alias("_canonical"), F.lit("block").alias("_listed"))
    hits = probed.filter("_possible").join(exact, "_canonical", "left").withColumn("verdict", F.coalesce("_listed", F.lit("allow")))
    out = [*[F.col(i).alias(c) for c, i in zip(keep, inner, strict=True)], F.col("host"), F.col("path"), F.col("rule"), F.col("verdict")]
    return clear.select(*out).unionAll(hits.select(*out))
