import os

import pytest
from pyspark.sql import functions as F

from strata.sources import csv as ingest
from strata.sources.tables import SourceError, literal_table, load_table, preview, validate_table


def write(tmp_path, name, data: bytes):
    p = os.path.join(str(tmp_path), name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_sentinels_become_null(spark, tmp_path):
    p = write(tmp_path, "s.csv", b"a,b\n1,x\n2,-\n3,sin dato\n4,y\n")
    df = ingest.read_csv(spark, p)
    assert df.where("b IS NULL").count() == 2
    assert dict(df.dtypes)["a"] == "bigint"


def test_thousands_salvaged_and_binary_kept(spark):
    df = literal_table(spark, {"income": ["32,000", "54000", None, "1,200", "9000"], "g": list("abcab"),
                               "flag": ["0", "1", "0", "1", "1"]})
    out = ingest.salvage_numeric(df)
    types = dict(out.dtypes)
    assert types["income"] == "double" and types["flag"] == "string"
    assert sorted(r["income"] for r in out.collect() if r["income"] is not None) == [1200, 9000, 32000, 54000]


def test_delimiters_and_single_column(spark, tmp_path):
    semi = ingest.read_csv(spark, write(tmp_path, "semi.csv", b"a;b\n1;2\n3;4\n"))
    tab = ingest.read_csv(spark, write(tmp_path, "tab.csv", b"a\tb\n1\t2\n3\t4\n"))
    one = ingest.read_csv(spark, write(tmp_path, "one.csv", b"a\n1\n2\n"))
    assert semi.columns == ["a", "b"] and tab.columns == ["a", "b"] and one.columns == ["a"]


def test_latin1_fallback(spark, tmp_path):
    p = write(tmp_path, "l1.csv", "ciudad,n\nBogotá,1\nMedellín,2\n".encode("latin-1"))
    df = ingest.read_csv(spark, p)
    assert sorted(r["ciudad"] for r in df.collect()) == ["Bogotá", "Medellín"]


def test_dispatch_validate_preview(spark, tmp_path):
    with pytest.raises(SourceError):
        load_table(spark, "x.xlsx")
    one = literal_table(spark, {"a": [1]})
    with pytest.raises(SourceError):
        validate_table(one)
    df = literal_table(spark, {"a": [3, 1, 2, 5, 4, 6], "b": list("xyzuvw")})
    validate_table(df)
    assert [r["a"] for r in preview(df).collect()] == [1, 2, 3, 4, 5]


def test_quotes_line_breaks_and_cp1252(spark, tmp_path):
    p = write(tmp_path, "q.csv", b'a,b\n"he said ""hi, you""",1\n"two\nlines",2\n')
    assert sorted((r["a"], r["b"]) for r in ingest.read_csv(spark, p).collect()) == [('he said "hi, you"', 1), ("two\nlines", 2)]
    p = write(tmp_path, "w.csv", "año,precio\n“uno”,€ 5\nŠkoda,€ 1.200\n".encode("cp1252"))
    assert sorted(r["año"] for r in ingest.read_csv(spark, p, types=False).collect()) == ["Škoda", "“uno”"]
    p = write(tmp_path, "l.csv", b"a,b\n\x81x,1\n")
    assert ingest.read_csv(spark, p).first()["a"] == "\x81x"
    p = write(tmp_path, "bom.csv", "﻿a,b\n1,2\n".encode())
    assert ingest.read_csv(spark, p).columns == ["a", "b"]


def test_number_shapes(spark):
    texts = ["1", " -2.5 ", "1e3", "+.5", "5.", "12abc", "", "--1", "NaN", "9" * 25, "9" * 19, "1 2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = ingest.q("t")
    for kind in ("double", "bigint"):
        for r in df.select("t", ingest._number(c, kind).alias("got"), c.try_cast(kind).alias("want")).collect():
            assert r["got"] == r["want"] or (r["got"] != r["got"] and r["want"] != r["want"]) or "." in r["t"], (kind, r)


def test_large_plain_files_are_split_by_lines(spark, tmp_path):
    rows = "".join(f'{i},"say ""{i}"", twice",x{i % 3}\n' for i in range(20_000))
    plain = write(tmp_path, "plain.csv", ("i,note,g\n" + rows).encode())
    broken = write(tmp_path, "broken.csv", ("i,note,g\n" + rows + '20000,"two\nlines",x\n').encode())
    assert not ingest.breaks_in_quotes(spark, plain) and ingest.breaks_in_quotes(spark, broken)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
        one, two = ingest.read_csv(spark, plain), ingest.read_csv(spark, broken)
        assert tasks(one) > 5 and tasks(two) == 1
        assert one.count() == 20_000 and one.where(F.col("note") == F.concat(F.lit('say "'), F.col("i").cast("string"), F.lit('", twice'))).count() == 20_000
        assert two.count() == 20_001 and two.where("note = 'two\\nlines'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
