import json
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from kemptable.functions.columns import EmptyData, InvalidArgs
from kemptable.session import scratch_path
from kemptable.sources import files, sniff, storage
from kemptable.sources.arrow import read_arrow, write_arrow
from kemptable.sources.sinks import output_format, publish, write_table
from kemptable.sources.tables import bounded, preview, read_table, row_limited, sample_head, sample_rows
from kemptable.sources.text import null_tokens, read_delimited

BAD_LINES = 'a,b\n1,2\n3\n4,5,6\n4,5,\n7,NA\n"x,y",""\n"p,q"\n4,5,6,7\n'


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_bad_lines_are_skipped_whatever_is_selected(spark, folder):
    path = put(folder, "bad.csv", BAD_LINES)
    df = read_delimited(spark, path)
    kept = [("1", "2"), ("3", None), ("7", None), ("p,q", None), ("x,y", None)]
    assert rows(df) == kept
    assert rows(df.select("a")) == [(a,) for a, _ in kept]
    assert df.count() == 5
    assert df.select("b").filter("b is not null").count() == 1


def test_content_decides_the_format(spark, folder):
    assert rows(read_table(spark, put(folder, "table.json", "a,b\n1,x\n2,y\n"))) == [(1, "x"), (2, "y")]
    assert rows(read_table(spark, put(folder, "lines.csv", '{"a":1}\n{"a":2}\n'))) == [(1,), (2,)]
    assert rows(read_table(spark, put(folder, "tabs.csv", "a\tb\n1\tx,y\n2\tz\n"))) == [(1, "x,y"), (2, "z")]
    assert rows(read_table(spark, put(folder, "odd.dat", "a;b\n1;x\n2;y\n"))) == [(1, "x"), (2, "y")]
    with pytest.raises(EmptyData):
        read_table(spark, put(folder, "blank.csv", "  \n"))


def test_json_shapes(spark, folder):
    assert rows(read_table(spark, put(folder, "x.jsonl", '{"a":1}\n{"a":2}\n'))) == [(1,), (2,)]
    assert rows(read_table(spark, put(folder, "one.json", '[{"a":1},{"a":2},{"a":3}]'))) == [(1,), (2,), (3,)]
    spread = json.dumps([{"a": {"b": 1}}, {"a": {"b": 2}}], indent=1)
    nested = read_table(spark, put(folder, "multi.json", spread))
    assert rows(nested.select("a.b")) == [(1,), (2,)]
    assert rows(read_table(spark, put(folder, "object.json", '{\n "a": 1\n}\n'))) == [(1,)]
    bom = read_table(spark, put(folder, "bom.json", b"\xef\xbb\xbf" + b'{"a":1}\n'))
    assert rows(bom) == [(1,)]


def test_types_and_names(spark, folder):
    text = ' "id" ,score,flag,word\n1,1.5,True,a\n2,NA,False,\n'
    df = read_table(spark, put(folder, "t.csv", text))
    assert df.dtypes == [("id", "bigint"), ("score", "double"), ("flag", "boolean"), ("word", "string")]
    assert rows(df) == [(1, 1.5, True, "a"), (2, None, False, None)]
    assert {t for _, t in read_table(spark, put(folder, "u.csv", text), infer=False).dtypes} == {"string"}
    with pytest.raises(InvalidArgs):
        read_table(spark, put(folder, "d.csv", "a,'a\n1,2\n"))


def test_byte_order_mark_and_other_encodings(spark, folder):
    assert rows(read_table(spark, put(folder, "bom.csv", "이름,v\n한글,1\n".encode("utf-8-sig")))) == [("한글", 1)]
    latin = read_table(spark, put(folder, "l.csv", "n,v\né,1\n".encode("latin-1")), encoding="ISO-8859-1")
    assert rows(latin) == [("é", 1)]


def test_na_tokens(spark):
    df = spark.createDataFrame([(v,) for v in ["NA", "n/a", "", "<NA>", "x", None, "na"]], "v string")
    assert rows(null_tokens(df)) == rows(spark.createDataFrame([(None,)] * 5 + [("na",), ("x",)], "v string"))


def test_sniffed_formats(spark, folder):
    put(folder, "a.csv", "a\tb\n1\t2\n")
    put(folder, "b.json", "[\n 1\n]")
    paths = sniff.text_files(spark, str(folder))
    empty = spark.createDataFrame([(put(folder, "empty.csv", ""),)], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r for r in sniff.sniff_formats(paths.union(empty)).collect()}
    assert (got["a.csv"]["format"], got["a.csv"]["separator"]) == ("tsv", "\t")
    assert got["b.json"]["format"] == "json-array"
    assert got["empty.csv"]["format"] == "error" and "EmptyData" in got["empty.csv"]["error"]


def test_encodings(spark, folder):
    line = "이름,v\n한글,1\n"
    put(folder, "bom.csv", line.encode("utf-8-sig"))
    put(folder, "utf8.csv", line.encode())
    put(folder, "utf8 open.csv", line.strip().encode())
    put(folder, "cp949.csv", line.encode("cp949"))
    put(folder, "late.csv", b"a,b\n" * 1000 + line.encode("cp949"))
    put(folder, "latin.csv", "n\né\xff\n".encode("latin-1"))
    put(folder, "skipped.txt", b"\xff\xfe")
    audit = files.encoding_audit(spark, str(folder))
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["encoding"], r["has_bom"], r["n_bytes"]) for r in audit.collect()}
    size = len(line.encode())
    assert got == {
        "bom.csv": ("utf-8-sig", True, size + 3), "utf8.csv": ("utf-8", False, size),
        "utf8 open.csv": ("utf-8", False, size - 1), "cp949.csv": ("cp949", False, len(line.encode("cp949"))),
        "late.csv": ("cp949", False, 4000 + len(line.encode("cp949"))), "latin.csv": ("latin-1", False, 5),
    }


def test_a_file_is_judged_as_a_whole(spark, folder):
    """Lines of two encodings in one file, and the bytes of every pair against the codecs."""
    put(folder, "mixed.csv", "한글,1\n".encode() + "한글,2\n".encode("cp949"))
    put(folder, "euc.csv", "한글,1\n가나\n".encode("euc-kr"))
    put(folder, "wide.csv", "한글,1\n뷁\n".encode("cp949"))
    audit = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in files.encoding_audit(spark, str(folder)).collect()}
    # 0xED 0x95 begins the first line: no pair of the Korean codecs.
    assert audit == {"mixed.csv": "latin-1", "euc.csv": "cp949", "wide.csv": "cp949"}
    pairs = [bytes([a, b]) for a in range(0, 256, 3) for b in range(256) if a not in (10, 13) and b not in (10, 13)]
    texts = [x for x in pairs + [b"a" + x + b"\xc7\xd1" for x in pairs[::7]]]
    table = spark.createDataFrame([(bytearray(x),) for x in texts], "raw binary").select("raw", F.decode("raw", "ISO-8859-1").alias("t"))
    for codec in ("cp949", "euc-kr"):
        for r in table.select("raw", F.col("t").rlike(files.valid_bytes(codec)).alias("ok")).collect():
            try:
                bytes(r["raw"]).decode(codec)
                valid = True
            except UnicodeDecodeError:
                valid = False
            assert r["ok"] is valid, (codec, r["raw"])
    long = spark.range(1).select((F.repeat(F.lit("\u00c7\u00d1a"), F.lit(2_000_000))).alias("t"))
    assert long.select(F.col("t").rlike(files.valid_bytes("cp949"))).first()[0]


def test_a_file_cut_over_many_tasks_keeps_one_row(spark, folder):
    put(folder, "big.csv", "가나다라,1\n".encode() * 20000 + "é".encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20000)
    try:
        audit = files.encoding_audit(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(audit) == 1 and audit[0]["encoding"] == "latin-1"


def arrow_table():
    return pa.table({"a": pa.array([1, 2, 3, 4], pa.int64()), "s": ["x", None, "y", "z"]})


def test_arrow_file_stream_and_feather(spark, folder):
    table = arrow_table()
    want = sorted(((r["a"], r["s"]) for r in table.to_pylist()), key=repr)
    path = str(folder / "f.arrow")
    with ipc.new_file(path, table.schema) as writer:
        for batch in table.to_batches(max_chunksize=2):
            writer.write_batch(batch)
    assert rows(read_table(spark, path)) == want
    assert read_arrow(spark, path, split_bytes=1).rdd.getNumPartitions() == 2
    assert rows(read_arrow(spark, path, split_bytes=1)) == want
    assert rows(read_arrow(spark, path, columns=["s"])) == [("x",), ("y",), ("z",), (None,)]
    stream = str(folder / "g.arrow")
    with ipc.new_stream(stream, table.schema) as writer:
        writer.write_table(table)
    assert rows(read_table(spark, stream)) == want
    feather.write_feather(table, str(folder / "h.feather"))
    assert rows(read_table(spark, str(folder / "h.feather"))) == want


def test_dictionary_columns_come_as_values(spark, folder):
    path = str(folder / "d.arrow")
    table = pa.table({"c": pa.array(["a", "b", "a"]).dictionary_encode()})
    with ipc.new_file(path, table.schema) as writer:
        writer.write_table(table)
    df = read_table(spark, path)
    assert df.dtypes == [("c", "string")] and rows(df) == [("a",), ("a",), ("b",)]


def test_arrow_sink(spark, folder):
    target = str(folder / "out")
    df = spark.range(1000).select("id", F.array("id").alias("l"), F.lit(None).cast("double").alias("n")).repartition(3)
    write_arrow(df, target)
    assert len(list((folder / "out").glob("*.arrow"))) == 3
    assert not list((folder / "out").glob("_*"))
    assert rows(read_arrow(spark, target)) == rows(df)
    with pytest.raises(Exception, match="already holds files"):
        write_arrow(df, target)
    write_table(spark.range(5), target, "feather", mode="overwrite")
    assert rows(read_arrow(spark, target)) == [(i,) for i in range(5)]


def test_sinks(spark, folder):
    df = spark.createDataFrame([(1, 'a "q", b', [1, 2])], "i long, s string, l array<int>")
    for fmt in ("csv", "tsv", "json", "parquet"):
        back = read_table(spark, write_table(df, f"{folder}/{fmt}", fmt))
        assert rows(back.select("i", "s")) == [(1, 'a "q", b')]
    assert [output_format(n) for n in (None, "arrow", "CSV", ".json", "tab")] == ["csv", "feather", "csv", "json", "tsv"]
    with pytest.raises(InvalidArgs):
        output_format("xlsx")
    with pytest.raises(Exception, match="already exists"):
        write_table(df, f"{folder}/csv", "csv")
    first, second = publish(df, f"{folder}/runs", fmt="parquet"), publish(df, f"{folder}/runs", fmt="parquet")
    assert first != second
    with pytest.raises(Exception, match="already exists"):
        publish(df, f"{folder}/runs", first.rsplit("=", 1)[1], "parquet")


def test_catalog_and_pick(spark, folder):
    spark.range(3).write.parquet(f"{folder}/ds/data/p.parquet")
    put(folder, "ds/t.csv", "a\n1\n")
    put(folder, "ds/dataset_info.json", "{}")
    put(folder, "ds/deep/er/z.arrow", b"x")
    catalog = files.file_catalog(spark, f"{folder}/ds")
    assert not any("dataset_info" in r["path"] for r in catalog.collect())
    picked = files.pick_dataset(catalog).first()
    assert picked["ext"] == "parquet" and "/data/" in picked["path"]
    assert {r["ext"] for r in files.catalog_totals(catalog).collect()} == {"parquet", "csv", "arrow"}
    assert read_table(spark, f"{folder}/ds").count() == 3
    for i in (1, 2):
        put(folder, f"mixed/part-{i}.csv", f"a\n{i}\n")
    put(folder, "mixed/other.csv", "b\n1\n")
    put(folder, "mixed/note.json", '{"a":1}')
    assert rows(read_table(spark, f"{folder}/mixed/part-*.csv")) == [(1,), (2,)]
    # All files of the best format, whatever their names and columns.
    assert sorted(tuple(r) for r in read_table(spark, f"{folder}/mixed").select("a", "b").fillna(0).collect()) == [(0, 1), (1, 0), (2, 0)]
    put(folder, "same/a.csv", "a\n1\n")
    put(folder, "same/b.csv", "a\n2\n")
    assert rows(read_table(spark, f"{folder}/same")) == [(1,), (2,)]


def test_images(spark, folder):
    for name in ("cat/a.jpg", "cat/B.JPG", "dog/c.tiff", "dog/n.txt", "dog/.DS_Store", "__MACOSX/cat/._a.jpg", "__MACOSX/x.jpg"):
        put(folder, f"im/{name}", b"x")
    manifest = files.image_manifest(spark, f"{folder}/im")
    assert rows(manifest.select("filename", "label")) == [("B.JPG", "cat"), ("a.jpg", "cat"), ("c.tiff", "dog")]
    assert rows(files.label_counts(manifest)) == [("cat", 2), ("dog", 1)]
    assert files.image_manifest(spark, f"{folder}/im", ["TIFF"]).count() == 1
    with pytest.raises(EmptyData):
        files.require_images(files.image_manifest(spark, f"{folder}/im", ["bmp"]))


def test_archives(spark, folder):
    with zipfile.ZipFile(folder / "z.zip", "w") as archive:
        archive.writestr("ok.csv", "a\n1\n")
        archive.writestr("../evil.csv", "x")
        archive.writestr("/abs.csv", "x")
        archive.writestr("dir/", "")
        archive.writestr("dir/../in.csv", "y")
        archive.writestr("한글.csv".encode("utf-8").decode("cp437"), "k")
    put(folder, "broken.zip", b"no archive")
    with zipfile.ZipFile(folder / "empty.zip", "w"):
        pass
    got = files.expand_zip(files.zip_files(spark, str(folder)), tasks=3)
    found = {r["member"]: (r["is_safe"], r["content"] and bytes(r["content"])) for r in got.collect()}
    assert found == {
        "ok.csv": (True, b"a\n1\n"), "../evil.csv": (False, None), "/abs.csv": (False, None),
        "dir/../in.csv": (True, b"y"), "한글.csv": (True, b"k"), None: (False, None),
    }


def test_members_of_one_archive_go_to_many_tasks(spark, folder):
    with zipfile.ZipFile(folder / "big.zip", "w") as archive:
        for i in range(200):
            archive.writestr(f"{i}.txt", str(i))
    got = files.expand_zip(files.zip_files(spark, str(folder)), tasks=4)
    spread = got.groupBy(F.spark_partition_id().alias("p")).count()
    assert spread.count() == 4 and got.count() == 200


def test_small_views(spark):
    df = spark.createDataFrame([(i, [i], b"x") for i in range(100)], "i int, l array<int>, b binary")
    shown = preview(df, 500)
    assert shown.count() == 50 and preview(df, 0).count() == 1
    assert dict(shown.dtypes) == {"i": "int", "l": "string", "b": "string"}
    assert sample_head(df, path="x.csv").count() == 30 and sample_head(df, path="x.json").count() == 100
    assert bounded(df, 7).count() == 7 and bounded(df, None).count() == 100
    assert row_limited(df, 99).first()[0] is True and row_limited(df, 100).first()[0] is False
    assert 0 < sample_rows(df, 0.5).count() < 100
    with pytest.raises(InvalidArgs):
        bounded(df, 0)


def test_uris():
    assert storage.normalize_uri("s3://b/k.csv?versionId=1") == "s3a://b/k.csv"
    assert storage.open_filesystem("file:///a/b")[1] == "/a/b"
    assert storage.open_filesystem("file:/a/b")[1] == "/a/b"


def test_a_nested_parquet_file(spark, folder):
    from kemptable.operators import profile

    spark.sql(
        "select named_struct('x', 1) as st, map('k', 1) as m, array(1, 2) as l, binary('ab') as b, "
        "cast(1.5 as decimal(5,2)) as d, double('nan') as f, cast(null as double) as n"
    ).write.parquet(f"{folder}/nested.parquet")
    got = {r["column_name"]: r for r in profile.column_profile(read_table(spark, f"{folder}/nested.parquet")).collect()}
    assert {k: v["samples"] for k, v in got.items()} == {
        "st": ["<dict keys=[x]>"], "m": ["<dict keys=[k]>"], "l": ["<list len=2>"], "b": ["<bytes len=2>"],
        "d": ["1.50"], "f": [], "n": [],
    }
    assert got["f"]["missing"] == 1 and got["n"]["missing"] == 1


def test_json_arrays_grow_in_number(spark, monkeypatch):
    """The query's arrays are valid, hold all rows, and have no more than so many of them, whatever the table."""
    from kemptable.workload import files as module, registry

    path = []
    monkeypatch.setattr(module, "ARRAY_ROWS", 100, raising=False)
    monkeypatch.setattr(module, "scratch_path", lambda s, label: path.append(scratch_path(s, label)) or path[-1])
    got = rows(registry.queries()["scan_json_array_orders"](spark, SMALL), "o_orderkey", "o_totalprice")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    assert got == rows(orders, "o_orderkey", "o_totalprice")
    arrays = [json.loads(f.read_text()) for f in Path(path[0].removeprefix("file:")).glob("part-*")]
    assert sorted(r["o_orderkey"] for a in arrays for r in a) == sorted(r["o_orderkey"] for r in orders.collect())
    assert len(arrays) == -(-orders.count() // 100) and max(map(len, arrays)) < 150
