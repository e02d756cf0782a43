"""The registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from comptoir.llm import chat, hnsw, jaccard, lines, pii, quality, spelling, suffix, tiling, tokenizer, topk, trie, urls
from comptoir.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {"pipeline": lambda spark, sf_dir: corpus_pipeline.run(spark, sf_dir)}
SQL: dict[str, str] = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _register(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list stands in for a published one: the canonical URLs of every page on a host with the label ``spam-farm``."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(urls.host(F.col("url")).rlike(r"(^|\.)spam-farm\.")).select(urls.canonical(F.col("url")).alias("canonical"))
    return urls.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


@_register
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = tokenizer.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_register
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantise(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.filter("id % 20 = 0"), 20)


@_register
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@_register
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@_register
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of contaminated document and benchmark item."""
    found = tiling.with_matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", F.col("m.covered").cast("long").alias("n_covered"), F.col("m.words").cast("long").alias("n_words"))


@_register
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents the classifier selects, with expected grade and probability of the top grade."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades_of(_table(spark, sf_dir, "labels")))
    chosen = quality.select(docs.select("doc_id", "text"), model)
    return chosen.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_top", 6).alias("p_top"))


@_register
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_conversations(rows, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@_register
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.remove_spread_lines(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@_register
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations rebuilt on the first turns of every twentieth, as a tree of prefixes."""
    own = cut_lineage(trie.sequences(_table(spark, sf_dir, "conversations")))
    heads = own.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = own.withColumn("base", F.expr("conv_id - conv_id % 20")).withColumn("h", shared).join(heads, "base", "left")
    nothing = F.array().cast("array<binary>")
    rebuilt = F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    paths = cut_lineage(joined.select("conv_id", trie.path(rebuilt).alias("path")))
    ids = F.array_sort(F.collect_list("conv_id"))
    ends = paths.groupBy("path").agg(F.min("conv_id").alias("end_id"), F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ends_sha256")).drop("path")
    nodes = trie.prefix_tree(paths).join(ends, "end_id", "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


@_register
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"), at_least=0.9, recall=0.98)


@_register
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spelling.count_words(_table(spark, sf_dir, "documents"), drop_every=97).filter("length(word) >= 5 AND n >= 3")
    return spelling.variants(counted, times=2)


def _hosted(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END"


_RULE_CASES = [(action, rule, *rule.partition("/")) for action, rule in sorted(RULES, key=lambda r: -len(r[1]))]
_FITS = [f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')" for _, _, name, slash, rest in _RULE_CASES]

SQL["op1_url_filters"] = rf"""
WITH split AS (
  SELECT page_id, {_hosted('url')} AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{urls._UPPER}', '{urls._LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{urls.TRACKING}'))), '&') AS fields
  FROM split
), named AS (
  SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN fields <> '' THEN '?' || fields ELSE '' END END AS canonical
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '(^|\.)spam-farm\.')
)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{c[1]}'" for f, c in zip(_FITS, _RULE_CASES, strict=True))} END AS rule,
  CASE {' '.join(f"WHEN {f} THEN '{c[0]}'" for f, c in zip(_FITS, _RULE_CASES, strict=True))} WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""

SQL["op3_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

SQL["op5_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""

_SAID = r"\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '#', '\#'), '<', '\<')"
SQL["op9_chat_format"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}'))
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(replace({_ESCAPED.format('role')}, ':', '\:')) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

SQL["op10_line_dedup"] = r"""
WITH cut AS (
  SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), copied AS (
  SELECT text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY text HAVING count(DISTINCT source) >= 10
), spread AS (
  SELECT list(line) AS spread FROM (SELECT line FROM cut WHERE trim(line) <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 10)
), shared AS (
  SELECT list(line) AS shared FROM (SELECT line FROM cut WHERE trim(line) <> '' AND source IS NOT NULL AND text NOT IN (SELECT text FROM copied) GROUP BY line HAVING count(DISTINCT source) >= 10)
), kept AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l,
    coalesce(CASE WHEN text IN (SELECT text FROM copied) THEN shared ELSE spread END, []) AS gone FROM documents, spread, shared
)
SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x: list_contains(gone, x)))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(l, lambda x: NOT list_contains(gone, x)), chr(10)), '')) AS text_sha256
FROM kept
"""


_CRC = """list_reduce(list_concat([4294967295::BIGINT], {}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))"""
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_table"

SQL["op11_prefix_trie"] = rf"""
WITH t AS (
  {_CRC_TABLE}
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor({_CRC.format("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")}, 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own), t
), turns AS (
  SELECT c.conv_id, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL SELECT c.conv_id, 1000000 + o.i, o.role, o.text FROM convs c JOIN own o USING (conv_id) WHERE o.i > c.h
), named AS (
  SELECT conv_id, role, text, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY i) OVER w AS p
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), prefixes AS (
  SELECT conv_id, 0 AS d, '' AS p, 0 AS words FROM convs
  UNION ALL SELECT conv_id, d, p, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) FROM named
), sizes AS (
  SELECT conv_id, max(d) AS size FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = size), '') AS ends
  FROM prefixes JOIN sizes USING (conv_id) GROUP BY p, d
), kids AS (
  SELECT left(p, 64 * (d - 1)) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), under AS (
  SELECT left(n.p, 64 * a.d) AS p, count(*) FILTER (k.p IS NULL) AS n_leaves, sum((n.n - 1) * n.words) AS saved
  FROM nodes n LEFT JOIN kids k ON k.p = n.p, LATERAL (SELECT unnest(range(n.d + 1)) AS d) a GROUP BY 1
)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN under u ON u.p = n.p LEFT JOIN kids k ON k.p = n.p LEFT JOIN nodes up ON n.d > 0 AND up.p = left(n.p, 64 * (n.d - 1))
"""

SQL["op12_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), good AS (
  SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN links l ON l.a = reach.b
), least AS (
  SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = v.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (r)
"""

SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE t AS (
  {_CRC_TABLE}
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{urls._UPPER}', '{urls._LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL
), coded AS (
  SELECT run, n, xor({_CRC.format("flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))")}, 4294967295) AS h
  FROM runs, t
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM coded)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS (
  SELECT word, word AS cut, -1 AS i FROM words UNION ALL
  SELECT word, substr(word, 1, i::BIGINT) || substr(word, i::BIGINT + 2), i FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.word <> b.word WHERE (a.i < 0) <> (b.i < 0) OR a.i = b.i
), best AS (
  SELECT near.word, count(*) AS n_near, min((-w.n, encode(near.other))) AS best FROM near JOIN words w ON w.word = near.other GROUP BY near.word
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * n THEN decode(best[2]) END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END::BIGINT AS form_n
  FROM words LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS here, 0 AS step FROM formed UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN formed f ON f.word = way.here WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(here, step) AS root FROM way GROUP BY word) USING (word)
"""
