"""Folders of workbooks, reading in place, and columns that differ."""

import datetime as dt
import shutil

import pytest
from pyarrow import fs
from pyspark.sql.types import StructType

from textloom.sources import xlsx
from textloom.sources.xlsx import load_excel, save_excel


def put(spark, folder, name, rows, schema):
    save_excel(spark.createDataFrame(rows, schema).coalesce(1), f"{folder}/{name}")


def test_folder_of_workbooks(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    put(spark, folder, "a.xlsx", [("one", 1, 2), ("two", 2, 3)], "text string, n long, k long")
    put(spark, folder, "b.xlsx", [(1.5, "three"), (None, "four")], "n double, text string")
    put(spark, folder, "c.XLSX", [("five", True)], "text string, extra boolean")
    (folder / "notes.txt").write_text("no workbook")
    (folder / "~$a.xlsx").write_text("a lock file")
    for path in (str(folder), f"file://{folder}"):
        df = load_excel(spark, path)
        assert dict(df.dtypes) == {"text": "string", "n": "double", "k": "double", "extra": "boolean"}
        assert df.rdd.getNumPartitions() == 3
        assert {tuple(r) for r in df.select("text", "n", "k", "extra").collect()} == {("one", 1.0, 2.0, None), ("two", 2.0, 3.0, None), ("three", 1.5, None, None), ("four", None, None, None), ("five", None, None, True)}
    assert load_excel(spark, str(folder)).select("k").where("k > 2").count() == 1
    with pytest.raises(FileNotFoundError):
        load_excel(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError, match="no workbook"):
        load_excel(spark, str(tmp_path / "empty"))


def two_sheets(tmp_path):
    """A workbook with a small and a large sheet, and one with a second sheet of other kinds."""
    import random
    import zipfile

    path = str(tmp_path / "two.xlsx")
    rnd = random.Random(1)
    big = "".join(f"<row><c t='inlineStr'><is><t>{rnd.random()}</t></is></c></row>" for _ in range(20_000))
    main = xlsx.MAIN.strip("{}")
    rel = xlsx.REL.strip("{}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="small" sheetId="1" r:id="r1"/><sheet name="large" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Q Id="r1" Target="worksheets/sheet1.xml"/><Q Id="r2" Target="worksheets/sheet2.xml"/></R>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>v</t></is></c></row>{big}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>v</t></is></c></row><row><c><v>5</v></c></row></sheetData></worksheet>')
    return path


def test_only_what_is_needed_is_fetched(spark, tmp_path, monkeypatch):
    path = two_sheets(tmp_path)
    read = []

    class Counting(fs.LocalFileSystem):
        def open_input_file(self, at, *a, **b):
            inner = super().open_input_file(at, *a, **b)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *x):
                    inner.close()

                def read(self, n=-1):
                    data = inner.read(None if n is None or n < 0 else n)
                    read.append(len(data))
                    return data

                seek, tell, seekable, close = inner.seek, inner.tell, inner.seekable, inner.close

            return File()

    monkeypatch.setattr(fs, "LocalFileSystem", Counting)
    size = (tmp_path / "two.xlsx").stat().st_size
    part = xlsx.sheet_parts(path, "small")[0]
    schema = xlsx.part_schema(path, part)
    assert schema.simpleString() == "struct<v:bigint>" and size > 100_000 and sum(read) < size / 2
    read.clear()
    (large,) = xlsx.sheet_parts(path, "1")
    assert sum(1 for _ in xlsx.part_tuples(path, large, False, schema)) == 20_000 and sum(read) < 1.3 * size  # its stream once


def test_all_sheets(spark, tmp_path):
    path = two_sheets(tmp_path)
    df = load_excel(spark, path, "*")
    assert df.rdd.getNumPartitions() == 2 and df.dtypes == [("v", "string")] and df.count() == 20_001 and df.where("v = '5'").count() == 1
    folder = tmp_path / "more"
    folder.mkdir()
    for name in ("a", "b"):
        shutil.copy(path, folder / f"{name}.xlsx")
    assert load_excel(spark, str(folder), "small").count() == 2 and load_excel(spark, str(folder), "*").rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="no sheet is called"):
        load_excel(spark, str(folder), "other").count()


def test_merged_kinds():
    read = lambda *s: xlsx.merged_schema([StructType.fromDDL(x) for x in s]).simpleString()
    assert read("a long, b string", "b string, a long") == "struct<a:bigint,b:string>"
    assert read("a long", "a double", "a long") == "struct<a:double>" and read("a long", "a boolean") == "struct<a:string>" and read("a long", "b timestamp_ntz") == "struct<a:double,b:timestamp_ntz>"
    assert dt.datetime(2020, 1, 1) and read("a string") == "struct<a:string>"


def test_tasks_write_side_by_side(spark, tmp_path):
    """Eight partitions in their order, to a path and to an address; a sheet's limit and a target that is there are errors that leave nothing behind."""
    df = spark.range(0, 4000, 1, 8).selectExpr("id", "concat('row ', id) AS text")
    for path in (str(tmp_path / "a.xlsx"), f"file://{tmp_path}/b.xlsx"):
        save_excel(df, path)
        assert [tuple(r) for r in load_excel(spark, path).collect()] == [(i, f"row {i}") for i in range(4000)]
    xlsx.register(spark)
    with pytest.raises(Exception, match="a.xlsx"):
        df.write.format("xlsx").mode("append").save(str(tmp_path / "a.xlsx"))
    save_excel(df.limit(0), str(tmp_path / "none.xlsx"))
    assert load_excel(spark, str(tmp_path / "none.xlsx")).count() == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.xlsx", "b.xlsx", "none.xlsx"]
