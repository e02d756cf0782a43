"""The operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from comptoir.llm import _hashing, chat, hnsw, jaccard, lines, pii, quality, spelling, suffix, tiling, tokenizer, topk, trie, urls
from comptoir.llm._graph import components

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(80)]

    def text(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    base = [text(rng.choice([3, 5, 40, 90, 200])) for _ in range(25)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    for i in range(30):
        parts = rng.choice(base).split()
        for _ in range(max(1, len(parts) // 30)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((100 + i, " ".join(parts).upper() if i % 5 == 0 else " ".join(parts)))
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "one"), (204, "one"), (205, base[3] + " " + text(3000)), (None, base[4]), (206, "é" * 300), (207, "ab" * 400), (3, base[3]), (208, "und " * 120)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n_bytes long")


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b:
            parent[max(x, y)] = min(x, y)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rows = _texts()
    sets = []
    for _, text in rows:
        low = (text or "").encode().translate(bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode()))
        w = re.findall(rb"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    ids = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted((str(r[0]), len(s), ids[g] if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True))
    got = jaccard.near_duplicates(_frame(spark, rows))
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got.collect()) == want
    assert jaccard.near_duplicates(_frame(spark, rows).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(values):
    s = np.array([*values, 0], dtype=np.int64)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert suffix.suffix_array(s).tolist() == want
    assert suffix._doubled(s).tolist() == want
    shared = [0] * len(s)
    for a, b in zip(want, want[1:], strict=False):
        shared[b] = next(k for k in range(len(s)) if s[a + k] != s[b + k])
    assert suffix.common_prefixes(s, np.array(want)).tolist() == shared


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=3, max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_repeated_windows(regions):
    seen = Counter(r[i : i + 3] for r in regions for i in range(len(r) - 2))
    assert [m.tolist() for m in suffix.repeated_windows(regions, 3)] == [[seen[r[i : i + 3]] > 1 for i in range(len(r) - 2)] for r in regions]


def test_long_runs_are_sorted():
    for region in (b"a" * 60_000, b"ab" * 30_000):
        assert suffix.repeated_windows([region], 200)[0].all()
    assert not suffix.repeated_windows([b"a" * 200, b"a" * 199 + b"b"], 200)[1].any()


def test_strings_that_cancel_modulo_a_power_of_two(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}
    pool = [one.encode(), other.encode()]
    assert len({int(_hashing.range_hash(_hashing.prefix_sums(np.frombuffer(p, np.uint8)), np.array([0]), np.array([len(p)]))[0]) for p in pool}) == 2


CLASHING = ("set_key", "key", "_key", "text_", "_text", "covered", "block", "word0", "bit0", "canonical", "_canonical", "_ruled", "_possible", "_listed", "node", "root", "_id", "in0", "in1")


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a.com/x", "t"), (1, "http://a.com/x", "t"), (None, None, None)], "doc_id long, text string, other string").withColumns({c: F.lit(c) for c in CLASHING})
    listed = spark.createDataFrame([("a.com/x",)], "canonical string")
    made = {
        "n_shingles component_id": jaccard.near_duplicates(df), "n_bytes removed kept": suffix.remove_repeats(df), "host path rule verdict": urls.judge(df, listed, (), url="text")}
    for new, out in made.items():
        assert out.columns == [c for c in df.columns if c != "text" or "host" in new] + new.split()
        assert all(r[c] == c for r in out.collect() for c in CLASHING) and out.count() == 3
    assert sorted(r.verdict for r in made["host path rule verdict"].collect()) == ["allow", "block", "block"]


def test_remove_repeats(spark):
    rows = _texts() + [(300, "abc" * 100), (301, "q" * 450), (302, "x" + "q" * 199)]
    raw = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    want = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 2, dtype=int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = 1
        want.append((str(i), len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)))
    got = [(str(r.doc_id), r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), bytes(r.kept)) for r in suffix.remove_repeats(_frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    assert suffix.remove_repeats(_frame(spark, rows).limit(0)).count() == 0


def test_tokenizer_matches_library_and_decodes(spark):
    rows = _texts() + [(1, "don't I'LL  x　y  \n\n z"), (2, "x" * 3000), (3, "½²Ⅷ 12³ 🎉👍🏽"), (4, "".join(random.Random(5).choices(string.ascii_letters, k=700)))]
    rng = random.Random(6)
    rows += [(5, "x" * 60_000), (6, "".join(rng.choices(string.ascii_lowercase, k=60_000))), (7, "".join(rng.choices("etaoins", k=20_000)))]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.read_ranks(VOCABULARY), special_tokens={})
    df = spark.createDataFrame([(k, t, "x") for k, (_, t) in enumerate(rows)], "k long, text string, ids string")
    coded = tokenizer.encode(df, vocabulary=VOCABULARY, pattern=public_tokenizers.PATTERN, decoded="decoded")
    out = {r.k: r for r in tokenizer.decode(coded, vocabulary=VOCABULARY, decoded="again").collect()}
    for k, (_, t) in enumerate(rows):
        assert out[k].ids == library.encode_ordinary(t or "")
        assert bytes(out[k].decoded) == bytes(out[k].again) == (t or "").encode()


def test_steps_of_many_pairs_equal_one_at_a_time(monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choices(rng.choice(["a", "ab", "etaoin", "-=_*", "=-", "éàe", string.ascii_lowercase[:16]]), k=rng.randint(1, 150))) for _ in range(1500)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.read_ranks(VOCABULARY), special_tokens={})
    want = [library._core_bpe.encode_single_piece(word.encode()) for word in words]
    for long in (1, 48, 1000):
        monkeypatch.setattr(tokenizer, "LONG", long)
        with tokenizer.codec(VOCABULARY) as tool:
            coded, decoded = tool.words(pa.array(words))
            assert tool.words(pa.array([], pa.string()))[0].to_pylist() == []
        assert [np.frombuffer(x, np.int32).tolist() for x in coded.to_pylist()] == want
        assert decoded.to_pylist() == [word.encode() for word in words]


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(rng.choice([8, 8, 5]))]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(60)]
    rows += [(400, None), (401, [0.1, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [1e5] * 8)]
    df = spark.createDataFrame(rows, "id long, x array<double>").select("id", topk.quantise(F.col("x")).alias("v"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter("id % 20 = 0"), 20).collect())
    fine = {i: [int(np.floor(64 * c)) for c in x] for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)}
    want = []
    for q in sorted(fine):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=False)), i) for i, v in fine.items() if i != q)[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


def test_pii_fixed_spans_and_added_ones(spark):
    rng = random.Random(4)

    def card() -> str:
        body = [rng.randrange(10) for _ in range(15)]
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(body))
        return "".join(map(str, body)) + str(-total % 10)

    rows = [f"reach me at n{i}.x+y@mail{i}.example.com or +1 (555) 010-{i:04d}, host 10.0.{i % 250}.7 card {card()} ref 123-45" for i in range(400)]
    rows += ["a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é +49 30 1234567 12", "", "1" * 5000, "card 4539 1488 0343 6468", "x" * 20000 + "@"]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind: str, s: str) -> bool:
        d = re.sub(r"\D", "", s)
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in s.split("."))) or (kind == "phone" and 10 <= len(d) <= 15)

    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(9999, None, "x")], "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.find(df).collect()}
    for i, text in enumerate(rows):
        quick = text if len(text) < 10000 else ""  # the plain pattern is quadratic there and finds nothing
        want = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, quick) if valid(kind, m[0]))
        assert [tuple(s) for s in out[i].base] == want
        assert set(out[i].base) <= set(out[i].spans)
    assert out[9999].base == [] and out[9999].spans == []


def test_pii_adds_what_no_fixed_pattern_meets(spark):
    rows = [f"call phone 030 555 {i:04d} {i % 10}{i % 7} now" for i in range(600)] + [f"write mail n{i} (at) host{i} (dot) org" for i in range(600)]
    rows += [f"reach +49 30 77{i:05d} or n{i}@site.org" for i in range(300)] + [f"order {i:08d}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(df).collect()}
    assert all(out[i].base == [] for i in range(1200))
    assert [s.kind for i in range(600) for s in out[i].spans] == [3] * 600 and [s.kind for i in range(600, 1200) for s in out[i].spans] == [0] * 600
    assert all(out[i].spans == [] for i in range(1500, 2100))


def test_pii_trees_and_threshold():
    x = np.array([[3, d] + [0] * 9 for d in range(7, 16)])
    pos, neg = np.where(x[:, 1] >= 11, 200.0, 0.0), np.where(x[:, 1] >= 11, 1.0, 200.0)
    trees = pii.grow(x, pos, neg)
    score = pii.scores(trees, x)
    cut = pii.calibrated(score, pos, neg)
    assert cut is not None and ((score >= cut) == (x[:, 1] >= 11)).all()
    assert pii.calibrated(score, neg, pos + 50) is None or score[x[:, 1] >= 11].max() < pii.calibrated(score, neg, pos + 50)


def test_tiling_catches_reordered_passages(spark):
    rng = random.Random(6)
    item = [f"w{i}" for i in range(40)]
    swapped = item[20:] + item[:20]
    noise = [f"n{rng.randrange(500)}" for _ in range(200)]
    docs = [(1, " ".join(noise[:50] + item + noise[50:])), (2, " ".join(noise[:9] + swapped[:20] + noise[9:30] + swapped[20:])), (3, " ".join(noise)), (4, " ".join(noise[:100] + item[:12])), (5, None), (6, ""), (7, "TINY item"), (8, " ".join(item * 50))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "tiny ITEM"), (3, None), (4, ""), (5, " ".join(item))], "item_id long, text string")
    out = {r.doc_id: [(m.item_id, m.covered) for m in r.matches] for r in tiling.with_matches(spark.createDataFrame(docs, "doc_id long, text string").withColumn("matches", F.lit(1)), bench).collect()}
    assert out[1] == out[2] == out[8] == [(1, 40), (5, 40)]
    assert out[3] == out[4] == out[5] == out[6] == [] and out[7] == [(2, 2)]


def test_tiles_are_greedy():
    item, doc = np.arange(12, dtype=np.uint64), np.array([0, 1, 2, 3, 4, 5, 90, 4, 5, 6, 7, 8, 9, 10, 11], dtype=np.uint64)
    pairs = [(i, j) for i in range(10) for j in range(13) if (item[i : i + 3] == doc[j : j + 3]).all()]
    found = tiling.tiles(item, doc, 3, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert found == [(8, 4, 7), (4, 0, 0)]


def test_quality_orders_grades(spark):
    rng = random.Random(7)

    def text(grade: int) -> str:
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(40)]
        return " ".join(words + ["scum"] * (grade == 1) if grade else [w.upper() + "!!" for w in words])

    grades = [rng.choice([0, 1, 2, 2]) for _ in range(900)]
    texts = [text(g) + f" {i}" for i, g in enumerate(grades)]
    model = quality.fit_rows(texts[:600], np.array(grades[:600]))
    assert (np.diff(model.thresholds) > 0).all()
    tails = np.array([model.tails(t) for t in texts[600:]])
    assert ((tails[:, 1] >= 0.5) == (np.array(grades[600:]) == 2)).mean() > 0.97
    assert (np.diff(tails, axis=1) <= 1e-9).all()
    df = spark.createDataFrame([(1, None), (2, ""), (3, texts[0]), (3, texts[0])], "doc_id long, text string").withColumn("p_top", F.lit("x"))
    assert quality.score(df, model).count() == 4
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0)], "doc_id long, grade int")
    assert quality.fit(df, one) is None and quality.select(df, None).count() == 4
    assert quality.fit(df.where("false"), one) is None and quality.score(df.where("false"), model).count() == 0
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:600])] + [(0, texts[0]), (None, "x"), (601, None)], "doc_id long, text string").withColumn("grade", F.lit("x"))
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, g in enumerate(grades[:700])] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    found = quality.fit(docs, quality.grades_of(labels))
    assert ((np.array([found.tails(t)[1] for t in texts[600:]]) >= 0.5) == (np.array(grades[600:]) == 2)).mean() > 0.97
    assert quality.score(spark.createDataFrame([(1, "word " * 60000)], "doc_id long, text string"), found).count() == 1


@pytest.mark.parametrize("n", [400, 2000])
def test_quality_uses_rare_clear_words(n):
    rng = random.Random(8)
    words = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(300)]

    def text(bad: bool) -> str:
        return " ".join(rng.choices(words, k=40) + ["scum", "moron"] * int(bad))

    grades = np.array([1 if i < 20 else 2 if i % 3 else 0 for i in range(n)])
    model = quality.fit_rows([text(g == 1) if g else text(False).upper() for g in grades], grades)
    tails = np.array([model.tails(text(i % 2 == 0))[1] for i in range(100)])
    assert all((model.weights[quality.features(w)[0][:1]] < 0).all() for w in ("scum", "moron"))
    assert (tails[::2] < 0.5).mean() > 0.6 and (tails[1::2] >= 0.5).mean() > 0.95


def test_chat_round_trip(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "a: #<\\", None), (2, 0, "a: #<\\", None), (None, 3, None, "é</turn>\n### assistant: no"), (3, 0, "assistant", ""), (3, 1, "assistant", "👍\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    out = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", said), ("assistant", said)] and out[1].loss == said
    assert [(t.role, t.text) for t in out[2].turns] == [("a: #<\\", "")] * 2 and out[2].loss == ""
    assert [(t.role, t.text) for t in out[None].turns] == [("", rows[4][3])] and out[None].loss == ""
    assert out[3].loss == "👍\\"
    masks = {r.conv_id: r for r in made.collect()}
    assert len(masks[1].ids) == len(masks[1].loss_mask) and 0 < sum(masks[1].loss_mask) < len(masks[1].ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x:y"]), st.text(max_size=40)), max_size=6))
def test_chat_escapes(turns):
    formatted, spans = chat.render(turns)
    assert chat.read_turns(formatted) == turns
    raw = formatted.encode("utf-8", "surrogatepass") if not any("\ud800" <= c <= "\udfff" for _, t in turns for c in t) else b""
    if raw:
        assert "".join(chat.unescape(raw[a:b].decode()) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_lines(spark):
    rows = [(i, f"own {i}\nshared by all, a long boilerplate line", f"s{i % 12}") for i in range(60)]
    rows += [(100 + i, "a copied document\nshared by all, a long boilerplate line\nof three lines", f"s{i}") for i in range(11)]
    rows += [(200 + i, "shared by all, a long boilerplate line", f"s{i}") for i in range(3)] + [(300, "of three lines\nand one", None), (301, None, "s1"), (302, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_removed": F.lit("x"), "_k": F.lit(1), "_n": F.lit(2), "_gone": F.lit(3), "a": F.lit(4)})
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.remove_spread_lines(df).collect()}
    assert all(out[i] == (f"own {i}", 2, 1) for i in range(60))
    assert all(out[100 + i] == ("a copied document\nof three lines", 3, 1) for i in range(11))
    assert all(out[200 + i] == ("", 1, 1) for i in range(3)) and out[300] == ("and one", 2, 1)
    assert out[301] == (None, 0, 0) and out[302] == ("", 1, 0) and len(out) == len(rows)


def test_pipeline_takes_boilerplate_out_of_short_texts(spark):
    import corpus_pipeline

    rows = [(i, f"own {i}\na boilerplate line longer than that", "en", f"s{i % 12}", 0) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.text, r.n_chars) for r in corpus_pipeline.remove_boilerplate(spark, docs, "").collect()} == {(f"own {i}", len(f"own {i}")) for i in range(24)}


@pytest.mark.parametrize("bits", [12, 1])
def test_urls(spark, monkeypatch, bits):
    monkeypatch.setattr(urls, "BITS", bits)
    rows = [(1, "http://www.A.com/x/?b=2&a=1&utm_x=3#f"), (2, "https://a.com/x?a=1&b=2"), (3, "a.com/x"), (4, None), (5, "http://x.example.org/en/12"), (6, "http://x.org"), (7, "http://notexample.org/es/a"), (8, "://Ünï.COM/fr/"), (9, ""), (2, "https://a.com/x?a=1&b=2")]
    rows += [(100 + i, f"http://b{i}.net/p") for i in range(200)]
    listed = spark.createDataFrame([("a.com/x?a=1&b=2",), (None,), ("b7.net/p",), ("b7.net/p",)], "canonical string")
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    out = urls.judge(df, listed, (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/")))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("www.a.com", "/x/", None, "block") and got[2][3] == "block" and got[3] == got[4] == got[9] == ("", "", None, "allow")
    assert got[5] == ("x.example.org", "/en/12", "example.org/en/1", "block") and got[6] == ("x.org", "", None, "allow") and got[7][2:] == ("org/", "allow")
    assert got[8] == ("Ünï.com", "/fr/", "com/fr/", "allow") and [i for i in range(200) if got[100 + i][3] == "block"] == [7]


def test_digests_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lines.remove_spread_lines(empty).count() == 0 and pii.find(empty).count() == 0
    assert tokenizer.encode(empty, vocabulary=VOCABULARY, pattern=public_tokenizers.PATTERN).count() == 0
    vectors = spark.createDataFrame([], "id long, v array<long>")
    assert topk.top_k(vectors, vectors).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        if k == 1:
            assert after.count() == before.count()
        if k == 2:
            groups = {r.doc_id: r.component_id for r in jaccard.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in groups.items() if i == c)
        if k == 3:
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(i in (r.text or "") for r in after.collect() for i in items)
        before = after
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.read_ranks(VOCABULARY), special_tokens={})
    for r in before.collect():
        assert r.ids == library.encode_ordinary(r.text) and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    odd = spark.createDataFrame([(None, "a b", None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0)], docs.select(*corpus_pipeline.COLUMNS).schema)
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, sf)
    assert odd.count() <= 4


def _tree(sequences):
    """Brute force: members of every prefix, children, leaves, saved words."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    kids = {p: sum(1 for q in members if len(q) == len(p) + 1 and q[: len(p)] == p) for p in members}
    out = {}
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].split()) if q else 0) for q in under)
        ends = [c for c in convs if len(sequences[c]) == len(p)]
        out[min(convs), len(p)] = (min(members[p[:-1]]) if p else None, len(convs), kids[p], sum(kids[q] == 0 for q in under), saved, min(ends, default=None))
    return out


@pytest.mark.parametrize(("part", "fan"), [(4 << 20, 32), (40, 2), (200, 3)])
def test_prefix_tree(spark, monkeypatch, part, fan):
    monkeypatch.setattr(trie, "PART_BYTES", part)
    monkeypatch.setattr(trie, "FAN", fan)
    rng = random.Random(part)
    rows, seen = [], {}
    for conv in range(60):
        turns = [(t, rng.choice(["user", None]), rng.choice(["a", "b c", None])) for t in range(rng.choice([1, 2, 3, 5]))]
        if conv % 7 == 0 and conv:
            turns = [(t, r, x) for t, (r, x) in enumerate(seen[rng.choice(list(seen))])] or turns
        seen[conv] = [(r or "", x or "") for _, r, x in turns]
        rows += [(conv, t, r, x, "z") for t, r, x in turns]
    rows += [(99, None, "user", "first", "z"), (99, 0, "user", "b c", "z"), (None, 0, "user", "x", "z"), (98, 0, "user", "long " * 5000, "z")]
    rows += [(97, t, "user", str(t), "z") for t in range(300)]
    seen |= {99: [("user", "first"), ("user", "b c")], 98: [("user", "long " * 5000)], 97: [("user", str(t)) for t in range(300)]}
    rng.shuffle(rows)
    own = trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string"))
    paths = own.select("conv_id", trie.path(F.col("turns")).alias("path")).unionAll(spark.createDataFrame([(500, b""), (None, b""), (501, None)], "conv_id long, path binary"))
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in trie.prefix_tree(paths).collect()}
    assert got == _tree(seen | {500: []})


def test_prefix_tree_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.sequences(none).count() == 0
    assert trie.prefix_tree(spark.createDataFrame([], "conv_id long, path binary")).count() == 0
    alone = trie.prefix_tree(spark.createDataFrame([(4, b"")], "conv_id long, path binary")).collect()
    assert [tuple(r) for r in alone] == [(4, 0, None, 1, 0, 1, 0, 4)]


def _linked(rows):
    ok = {i: np.array(v, dtype=np.float64) for i, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    group, n = list(range(len(rows))), [0] * len(rows)
    for i, a in ok.items():
        for j, b in ok.items():
            if i != j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9:
                n[i] += 1
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in set(group)}
    return sorted(((r[0], n[i], least[group[i]], r[0] == least[group[i]]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("shard", "kind"), [(32768, "float"), (64, "double")])
def test_embedding_near_duplicates(spark, monkeypatch, shard, kind):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16)).astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, (base[i % 20] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(60)]
    rows += [(300 + i, base[7].tolist()) for i in range(30)] + [(400, (base[3] * 4).tolist()), (401, None), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15)]
    rows += [(405, [float("inf")] * 16), (406, []), (407, [1.0, 2.0]), (408, [1.0, 2.1]), (None, base[9].tolist()), (None, rng.normal(size=16).astype(np.float32).tolist()), (5, base[9].tolist()), (5, base[80].tolist())]
    crowd = base[11] + 0.01 * rng.normal(size=(90, 16))
    rows += [(500 + i, v.tolist()) for i, v in enumerate(crowd.astype(np.float32))]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, id string, node int, v int")
    assert sorted((tuple(r) for r in hnsw.near_duplicates(df, recall=1.0).collect()), key=str) == _linked(rows)


def test_embedding_near_duplicates_without_rows(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert hnsw.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0].kept


def test_graph_recall():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 48)).astype(np.float32)
    graph = hnsw.build(vectors)
    near = (vectors[:500] + 0.1 * rng.normal(size=(500, 48))).astype(np.float32)
    row, node = graph.linked(vectors, near, 0.9, 32)
    true = {(i, j) for i, j in zip(*np.nonzero(hnsw._unit(near) @ hnsw._unit(vectors).T >= 0.9), strict=True)}
    assert len(true & set(zip(row.tolist(), node.tolist(), strict=True))) >= 0.95 * len(true)
    assert set(zip(row.tolist(), node.tolist(), strict=True)) <= true


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@given(st.text(alphabet="abé", min_size=5, max_size=9), st.integers(0, 8), st.sampled_from("abé"), st.integers(0, 2), st.sets(st.text(alphabet="abé^$", min_size=2, max_size=5), max_size=40))
@settings(max_examples=400, deadline=None)
def test_near_words_share_a_list(word, at, letter, edit, frequent):
    other = [word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]][edit]
    if len(other) < 5 or not _one_edit(word, other):
        return
    counts = dict.fromkeys(frequent, 20)
    short, long = sorted((word, other), key=len)

    def lists(w, shifts):
        framed, out = f"^{w}$", set()
        for start, end, often in spelling.rarest(w, counts):
            out |= {(-1, framed[:end]), (-2, framed[start:])} if often else {(start + shift, framed[start:end]) for shift in shifts}
        return out

    assert lists(short, (0, 1) if len(short) < len(long) else (0,)) & lists(long, (0,))


@pytest.mark.parametrize("rare", [0, 16])
def test_spelling_variants(spark, monkeypatch, rare):
    monkeypatch.setattr(spelling, "RARE", rare)
    rng = random.Random(rare)
    words = {"".join(rng.choices("abcé", k=rng.randint(5, 7))) for _ in range(400)} | {"a" * 5, "a" * 6, "a" * 400, "a" * 399 + "b"}
    counts = {w: rng.choice([3, 3, 4, 6, 12, 40, 90]) for w in words}
    got = {r.word: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    near = {w: [v for v in words if _one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    assert got == {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in words}


def test_words_are_counted(spark):
    rows = [(1, "Alpha beta ALPHA  Él", "x"), (None, "alpha×beta", "x"), (2, None, "x"), (3, "", "x"), (4, "beta " * 4000, "x"), (4, "beta", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == {"alpha": 2, "beta": 4002, "Él": 1, "alpha×beta": 1}
    wanted: dict[str, int] = {}
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = spelling.misspell(doc, run.translate(spelling.LOWER), 2)
            wanted[word] = wanted.get(word, 0) + 1
    assert {r.word: r.n for r in spelling.count_words(df, drop_every=2).collect()} == wanted
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).count() == 0
    with pytest.raises(ValueError, match="letters"):
        spelling.variants(spark.createDataFrame([("abcd", 3)], "word string, n long"))


def test_long_dotted_addresses(spark):
    text = "a@b" + ".c" * 20000 + " and a (at) b" + " dot c" * 3 + " x@y.zz"
    found = pii.find(spark.createDataFrame([(1, text), (2, "a@" + "b-" * 50000 + ".c")], "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.base) for r in found} == {1: 2, 2: 1}


def test_one_row_of_each_component(spark):
    import corpus_pipeline

    same = " ".join(f"w{i}" for i in range(30))
    rows = [(1, same), (1, "an unlike clean text with the same id as another"), (2, same), (None, same), (None, "no id but words of its own here"), (3, ""), (3, ""), (4, None), (5, same + " x"), (5, same + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=str)
    assert out == sorted([(1, same), (1, rows[1][1]), (None, rows[4][1]), (3, ""), (3, ""), (4, None)], key=str)
