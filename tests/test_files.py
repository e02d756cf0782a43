import os

import pytest
from pyspark.sql import functions as F

from comptoir.sources import files as S


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as handle:
        handle.write(text)
    return str(path)


def test_separator_and_encoding(spark, tmp_path):
    a = write(str(tmp_path / "a.csv"), "nom;montant\nÉva;1,5\n")
    b = write(str(tmp_path / "b.csv"), "prénom|montant\nÉva|2\n", "latin-1")
    assert S.read_csv(spark, a).collect()[0].asDict() == {"nom": "Éva", "montant": "1,5"}
    assert S.read_csv(spark, b).columns == ["prénom", "montant"]
    assert S.detect_separator("a\tb,c\td") == "\t" and S.detect_separator("a,b;c") == ";"
    with pytest.raises(S.LoadError):
        S.read_csv(spark, write(str(tmp_path / "c.csv"), "a,b\n"), reject_empty=True)


def test_header_after_descriptive_lines(spark, tmp_path):
    folder = str(tmp_path / "s")
    write(f"{folder}/one.csv", "Organisation: X\nPeriode\n\nReceipt No.,Currency,Paid In\nR1,CDF,10\nR2,CDF,20\n")
    write(f"{folder}/two.csv", "Receipt No.,Currency,Paid In\nR3,USD,5\n")
    out = S.promote_header(spark, folder, source_column="f")
    assert sorted((r["Receipt No."], r["Paid In"], r["f"]) for r in out.collect()) == [("R1", "10", "one.csv"), ("R2", "20", "one.csv"), ("R3", "5", "two.csv")]


def test_encoding_and_line_breaks_are_seen_in_the_whole_file(spark, tmp_path):
    late = write(str(tmp_path / "late.csv"), "nom,n\nAna,1\nÉva,2\n", "latin-1")
    assert [tuple(r) for r in S.read_csv(spark, late).orderBy("n").collect()] == [("Ana", "1"), ("Éva", "2")]
    broken = write(str(tmp_path / "broken.csv"), 'nom,n\n"a\nb",1\n"c ""d""",2\n')
    assert [tuple(r) for r in S.read_csv(spark, broken).orderBy("n").collect()] == [("a\nb", "1"), ('c "d"', "2")]


def test_statement_rows_with_missing_fields_or_line_breaks(spark, tmp_path):
    folder = str(tmp_path / "s")
    write(f"{folder}/one.csv", 'Note, with, commas\nReceipt No.,Paid In,Details\nR1,10,x\nR2,20\n\nR3,30,"x\n\ny"\nR4,40,z\n')
    write(f"{folder}/two.csv", "Receipt No.,Paid In\nR5,50\nReceipt No.,Paid In\nR6\n")
    out = S.promote_header(spark, folder, source_column="f").orderBy("`Receipt No.`").collect()
    assert [(r["Receipt No."], r["Paid In"], r["Details"]) for r in out] == [
        ("R1", "10", "x"), ("R2", "20", None), ("R3", "30", "x\n\ny"), ("R4", "40", "z"), ("R5", "50", None), ("R6", None, None)]


def test_line_numbers_run_through_a_file(spark, tmp_path):
    write(str(tmp_path / "l" / "a.txt"), "".join(f"{i:05d}\n" for i in range(1, 2001)))
    write(str(tmp_path / "l" / "b.txt"), "00001\n00002\n")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        out = S.with_lineage(spark.read.text(str(tmp_path / "l")), row_numbers=True, first=1)
        assert out.select("bloc_source").distinct().count() > 5
        assert out.where("CAST(value AS INT) <> ligne_source").count() == 0 and out.count() == 2002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_files_that_differ_in_columns(spark, tmp_path):
    a, b = write(str(tmp_path / "a.csv"), "x,y\n1,2\n"), write(str(tmp_path / "b.csv"), "y,z\n3,4\n")
    out = S.load_files(spark, [a, b]).orderBy("ordre_fichier_import").collect()
    assert [(r["x"], r["y"], r["z"], r["fichier_source"], r["ordre_fichier_import"]) for r in out] == [("1", "2", None, "a.csv", 0), (None, "3", "4", "b.csv", 1)]
    with pytest.raises(ValueError):
        S.compile_homogeneous({"a": S.read_csv(spark, a), "b": S.read_csv(spark, b)})
    assert S.compile_homogeneous({"a": S.read_csv(spark, a), "b": S.read_csv(spark, b)}, common_only=True).columns == ["y"]


@pytest.mark.parametrize("name, wanted", [("snap_2026-07-15.csv", "2026-07-15"), ("encours 30-06-2026.xlsx", "2026-06-30"), ("99-99-2026.csv", None), ("x.csv", None)])
def test_snapshot_date(spark, name, wanted):
    value = spark.createDataFrame([(name,)], "f string").select(S.snapshot_date(F.col("f")).cast("string")).first()[0]
    assert value == wanted


def test_export_and_column_presence(spark, tmp_path):
    df = spark.createDataFrame([("N", 1, None), ("S", 2, None)], "zone string, v int, vide string")
    path = str(tmp_path / "out")
    assert S.export_partitioned(df, path, "zone", "parquet", drop_empty_columns=True).columns == ["zone", "v"]
    assert sorted(d for d in os.listdir(path) if d.startswith("zone")) == ["zone=N", "zone=S"]
    table = S.column_presence({"a": df, "b": df.drop("vide")}).orderBy("Colonne").collect()
    assert [tuple(r) for r in table] == [("v", "v", "v"), ("vide", "vide", "-"), ("zone", "zone", "zone")]


def test_a_stray_quote_loses_no_row(spark, tmp_path):
    folder = str(tmp_path / "s")
    write(f"{folder}/one.csv", 'Receipt No.,Details,Paid In\nR1,12" tube,10\nR2,x,20\nR3,y,30\n')
    write(f"{folder}/two.csv", 'Receipt No.,Details,Paid In\nR4,"open,10\nR5,x,20\nR6,y "z" w,30\n')
    out = S.promote_header(spark, folder).orderBy("`Receipt No.`").collect()
    assert [(r["Receipt No."], r["Details"], r["Paid In"]) for r in out][:3] == [("R1", '12" tube', "10"), ("R2", "x", "20"), ("R3", "y", "30")]
    assert [r["Receipt No."] for r in out] == ["R1", "R2", "R3", "R4", "R5", "R6"]
    read = S.read_csv(spark, f"{folder}/one.csv")
    assert read.count() == 3


def _split_records(text, sep=","):
    """Brute force, letter by letter."""
    out, now, inside, start, i = [], "", False, True, 0
    while i < len(text):
        ch, after = text[i], text[i + 1:i + 2]
        if inside and ch == '"' and after == '"':
            now, i = now + '""', i + 2
            continue
        if inside and ch == '"' and (after in ("", sep, "\n")):
            inside = False
        elif not inside and ch == '"' and start:
            inside = True
        start = not inside and ch in (sep, "\n")
        if ch == "\n" and not inside:
            out.append(now)
            now = ""
        else:
            now += ch
        i += 1
    return [r for r in [*out, *(now.split("\n") if inside else [now])] if r]


def test_records_are_cut_in_parallel(spark, tmp_path):
    import random

    from comptoir.sources import records as R
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        wanted = []
        for seed in range(12):
            rng = random.Random(seed)
            text = "".join(rng.choice(['"', '"', ",", "\n", "\n", "a", "bc", ' ']) for _ in range(400))
            write(str(tmp_path / "r" / f"{seed}.csv"), text)
            wanted += [(f"{seed}.csv", r) for r in _split_records(text)]
        write(str(tmp_path / "r" / "long.csv"), '"' + "x\n" * 300 + '",1\n"' + "y" * 5000 + '"\n')
        wanted += [("long.csv", '"' + "x\n" * 300 + '",1'), ("long.csv", '"' + "y" * 5000 + '"')]
        lines = R.read_lines(spark, str(tmp_path / "r"))
        assert lines.select("__file", "__block").distinct().count() > 40
        found = R.records(lines, ",").where("value <> ''").orderBy("__name", "__block", "__line").collect()
        assert sorted((r["__name"], r["value"]) for r in found) == sorted(wanted)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_many_files_of_few_headers(spark, tmp_path):
    paths = [write(str(tmp_path / f"f {i}.csv"), f"nom;n\nA{i};{i}\n" if i % 2 else f'n,"nom",x\n{i},"A\n{i}",1\n') for i in range(9)]
    assert len(S.read_many(spark, paths)) == 2
    out = {r["ordre_fichier_import"]: r for r in S.load_files(spark, paths).collect()}
    assert {i: (r["nom"], r["n"], r["fichier_source"]) for i, r in out.items()} == {i: (f"A{i}" if i % 2 else f"A\n{i}", str(i), f"f {i}.csv") for i in range(9)}
    assert sorted(S.compile_files(spark, paths, common_only=True, source_column="nom").columns) == ["n", "nom", "nom_fusion_2"]
    assert S.compile_standardized_files(spark, paths).columns.count("Provenance") == 1
    with pytest.raises(S.LoadError):
        S.load_files(spark, [*paths, write(str(tmp_path / "none.csv"), "")])
