"""Records cut by many tasks against readers that take a file whole."""

import csv
import io
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kemptable import session
from kemptable.session import scratch_path
from kemptable.sources import cuts
from kemptable.sources.cuts import json_rows, open_field_pattern, pieces, quoted_records
from kemptable.sources.tables import read_table
from kemptable.sources.text import read_delimited, rejected_lines


@pytest.fixture
def small_blocks(spark):
    """Files are split every few dozen bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


FIELDS = ["", "plain", "a,b", 'say "x"', "two\nlines", '"\n,"\n', "é\n\n日本", "x" * 250, "\n" * 5, 'a"b', " ", ",\n" * 40]


@pytest.mark.parametrize("seed", range(3))
def test_quoted_records_equal_a_whole_file_reader(spark, folder, small_blocks, seed):
    random.seed(seed)
    want = []
    for name in ("a.csv", "b.csv"):
        table = [["id", "x y", "z.w"]] + [[str(i), random.choice(FIELDS), random.choice(FIELDS)] for i in range(60)]
        text = io.StringIO()
        csv.writer(text, lineterminator=random.choice(["\n", "\r\n"])).writerows(table)
        put(folder, name, text.getvalue())
        want += [tuple(x or None for x in r) for r in table[1:]]
    got = read_delimited(spark, str(folder), na_tokens=None)
    assert got.columns == ["id", "x y", "z.w"]
    # Spark's reader trims nothing here and makes an empty field null.
    assert rows(got) == sorted(want, key=repr)
    assert quoted_records(spark, f"{folder}/a.csv").count() == 61
    assert pieces(spark, f"{folder}/a.csv", "\n").select(F.spark_partition_id()).distinct().count() > 9


def test_stray_quotes_stay_in_their_line(spark, folder, small_blocks):
    """A quote inside an unquoted field opens nothing."""
    path = put(folder, "a.csv", 'a,b\n1,5" pipe\n2,"x\ny"\n3,6" pipe\n4,"p" q\n')
    want = [("1", '5" pipe'), ("2", "x\ny"), ("3", '6" pipe'), ("4", '"p" q')]
    assert rows(read_delimited(spark, path)) == want
    assert rows(read_delimited(spark, path, multiline=True)) == want
    pattern = open_field_pattern(",")
    cases = [("", False), ('a,"b', True), ('"a","b""', True), ('"a""b"', False), ('a"b', False), ('"a" x,"', True), ('"a,b",c', False), ('"', True), ('""', False)]
    for text, want_open in cases:
        assert spark.range(1).select(F.lit(text).rlike(pattern)).first()[0] is want_open, text


def test_surplus_fields_are_told_exactly(spark, folder):
    path = put(folder, "a.csv", 'a,b\n1,2\n3,4,,5\n6,7,\n8,"x,y,z"\n9\n10,"p,q",,r\n')
    assert rows(read_delimited(spark, path)) == [("1", "2"), ("8", "x,y,z"), ("9", None)]
    assert rows(rejected_lines(spark, path)) == [('10,"p,q",,r',), ("3,4,,5",), ("6,7,",)]
    many = put(folder, "b.csv", 'a,b\n1,"2\n3"\n3,4,,5\n6,"x\n,",\n')
    assert rows(read_delimited(spark, many)) == [("1", "2\n3")]
    assert rows(rejected_lines(spark, many)) == [("3,4,,5",), ('6,"x\n,",',)]


def values(seed):
    random.seed(seed)

    def made(depth):
        kinds = [lambda: random.choice(["", "}", "{", "a}b{", '"', "\\", "\\\"}", "[]", "é\n", "x" * 300]), lambda: random.randint(-9, 9), lambda: None, lambda: True]
        if depth < 3:
            kinds += [lambda: {random.choice("pqr}"): made(depth + 1) for _ in range(random.randint(0, 3))}, lambda: [made(depth + 1) for _ in range(random.randint(0, 3))]]
        return random.choice(kinds)()

    return [{"id": i, "v": made(0), "w": {"k": made(1)}} for i in range(80)]


@pytest.mark.parametrize("form", ["array", "pretty", "objects", "lines", "bom"])
def test_json_rows_equal_a_parser(spark, folder, small_blocks, form):
    want = []
    for seed in (1, 2):
        found = values(seed)
        want += found
        text = {
            "array": lambda: json.dumps(found), "pretty": lambda: " \n" + json.dumps(found, indent=1, ensure_ascii=False) + "\n",
            "objects": lambda: "\n".join(json.dumps(x, indent=2) for x in found), "lines": lambda: "\n".join(map(json.dumps, found)) + "\n",
            "bom": lambda: "﻿" + json.dumps(found),
        }[form]()
        put(folder, f"{seed}.json", text)
    got = [json.loads(r["value"]) for r in json_rows(spark, str(folder)).collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))


def test_json_blocks_come_in_many_batches(spark, folder):
    """What is open at the end of a batch, and records over several batches and blocks, go on in the next one."""
    table = values(3) + [{"id": 80, "v": "}" * 900, "w": "{" * 900}, {"id": 81, "v": [{"k": [{}]}] * 60, "w": None}]
    put(folder, "a.json", json.dumps(table))
    put(folder, "b.json", "")
    keys = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = [json.loads(r["value"]) for r in json_rows(spark, str(folder)).collect()]
        assert json_rows(spark, str(folder / "b.json")).collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, table))


def test_json_arrays_are_not_kept_again(spark, folder, monkeypatch):
    """What reading an array leaves on disk is a part of the array: its rows once, compressed, not a copy for each step."""
    random.seed(5)
    words = ["".join(random.choices("abcdefghij", k=6)) for _ in range(500)]
    table = [{"id": i, "t": " ".join(random.choices(words, k=400)), "n": [{"k": i}, {}]} for i in range(800)]
    path = put(folder, "a.json", "[" + ",\n".join(map(json.dumps, table)) + "]")
    made = []
    for module in (cuts, session):  # cut_lineage has its own name for it
        monkeypatch.setattr(module, "scratch_path", lambda s, label: made.append(scratch_path(s, label)) or made[-1])
    assert rows(read_table(spark, path).select("id", "t", "n.k")) == sorted(((r["id"], r["t"], [r["id"], None]) for r in table), key=repr)
    kept = sum(f.stat().st_size for x in made for f in Path(x.removeprefix("file:")).rglob("part-*"))
    assert 0 < kept < 0.5 * Path(path).stat().st_size


def test_one_line_array_reads_by_many_tasks(spark, folder):
    """Longer than the head that the format test reads; elements that are no objects are left out."""
    table = [{"id": i, "s": "}" * (i % 3), "n": {"a": [i]}, "pad": "{" * 4000} for i in range(500)]
    path = put(folder, "a.json", '["x{", 1, ' + json.dumps(table)[1:-1] + ", 2, \"}\"]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    df = read_table(spark, path).persist()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows(df.select("id", "s", "n.a")) == sorted(((i, "}" * (i % 3), [i]) for i in range(500)), key=repr)
    assert rows(read_table(spark, put(folder, "e/e.json", "[ ]" + " " * 5000)))== []


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_partition_folders_of_a_mixed_folder(spark, folder, fmt):
    """Rows of all partition folders and of files beside them, with the folders' names as columns."""
    df = spark.range(30).select("id", (F.col("id") % 2).alias("k"), F.lit("a\nb" if fmt == "csv" else "ab").alias("t"))
    df = df.withColumn("s", F.when(F.col("id") % 3 > 0, F.concat(F.lit("x + "), (F.col("id") % 3).cast("string"))))
    df.write.option("header", True).partitionBy("k", "s").mode("append").format(fmt).save(f"{folder}/d")
    put(folder, "d/k=1/other.json", '{"q": 1}\n')
    assert rows(read_table(spark, f"{folder}/d").select("id", F.col("k").cast("long"), "t", "s")) == rows(df)
    extra = spark.range(40, 43).select("id", F.lit("z").alias("t"))
    extra.coalesce(1).write.option("header", True).mode("append").format(fmt).save(f"{folder}/d")
    both = df.unionByName(extra, allowMissingColumns=True)
    assert rows(read_table(spark, f"{folder}/d").select("id", F.col("k").cast("long"), "t", "s")) == rows(both)
