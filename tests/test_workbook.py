"""Workbooks, the command line, bundles and the stream."""

import datetime as dt
import os
import zipfile

import pytest

from textloom.bundle import load_bundle, save_bundle
from textloom.cli import main
from textloom.pipeline import cluster
from textloom.sources.xlsx import list_sheets, load_excel, load_report, save_excel
from textloom.spec import ClusterSpec
from textloom.streaming import assign_stream

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TEXTS = ["red apple pie", "red apple tart", "apple pie tart", "blue ocean wave", "blue ocean ship", "ocean wave ship"]


@pytest.fixture
def workbook(tmp_path):
    path = str(tmp_path / "data.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets><sheet name="first" sheetId="1" r:id="r1"/><sheet name="1" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>note</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        cell = lambda r, k, v: f'<c r="{r}" t="{k}"><v>{v}</v></c>'
        rows = [
            cell("A1", "s", 0) + '<c r="B1" t="inlineStr"><is><t>note</t></is></c>' + cell("D1", "str", "n") + cell("E1", "str", "day") + cell("F1", "str", "ok"),
            cell("A2", "s", 1) + cell("B2", "n", 5) + cell("D2", "n", 1.5) + '<c r="E2" s="1"><v>45292</v></c>' + cell("F2", "b", 1),
            cell("A3", "str", "NA") + cell("B3", "n", 7) + cell("F3", "b", 0),
        ]
        z.writestr("xl/worksheets/a.xml", f"<worksheet {MAIN}><sheetData>" + "".join(f'<row r="{i + 1}">{r}</row>' for i, r in enumerate(rows)) + "</sheetData></worksheet>")
        z.writestr("xl/worksheets/b.xml", f"<worksheet {MAIN}><sheetData><row>{cell('A1', 'str', 'c')}</row></sheetData></worksheet>")
    return path


def test_read(spark, workbook):
    df = load_excel(spark, workbook)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("note", "string"), ("note.1", "bigint"), ("Unnamed: 2", "string"), ("n", "double"), ("day", "timestamp_ntz"), ("ok", "boolean")]
    assert [tuple(r) for r in df.collect()] == [("rich text", 5, None, 1.5, dt.datetime(2024, 1, 1), True), (None, 7, None, None, None, False)]
    assert load_excel(spark, workbook, "1").columns == ["c"] and load_excel(spark, workbook, 0).columns[0] == "note"
    assert load_report(df, workbook).first()[:2] == (2, 6) and load_report(df, workbook).first().size_kb > 0
    assert [r.name for r in list_sheets(spark, workbook).orderBy("ordinal").collect()] == ["first", "1"]


def test_read_errors(spark, workbook):
    with pytest.raises(FileNotFoundError):
        load_excel(spark, workbook + "x")
    with pytest.raises(ValueError, match="xls format"):
        load_excel(spark, "/x/old.xls")
    with pytest.raises(Exception, match="no sheet is called"):
        load_excel(spark, workbook, "other").collect()


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a <b> & \x01c", 1, 1.25, True, dt.datetime(2020, 5, 6, 7, 8, 9)), (None, 2, None, False, None)], "t string, i long, d double, b boolean, w timestamp_ntz")
    path = str(tmp_path / "out.xlsx")
    save_excel(df, path)
    save_excel(df, path)
    assert [tuple(r) for r in load_excel(spark, path).collect()] == [("a <b> & c", 1, 1.25, True, dt.datetime(2020, 5, 6, 7, 8, 9)), (None, 2, None, False, None)]
    assert os.listdir(tmp_path) == ["out.xlsx"]
    with pytest.raises(Exception, match="32767"):
        save_excel(spark.createDataFrame([("x" * 40000,)], "t string"), path)


def test_command_line_bundle_and_stream(spark, tmp_path):
    source = str(tmp_path / "in.xlsx")
    save_excel(spark.createDataFrame([(t,) for t in TEXTS], "comments string").coalesce(1), source)
    main(["-i", source, "-c", "comments", "-k", "2", "--save_model", "-v"], spark)
    out = load_excel(spark, str(tmp_path / "in_clustered.xlsx")).collect()
    assert [r.comments for r in out] == TEXTS and [r.cluster_label for r in out] == [0, 0, 0, 1, 1, 1] and all(r.cluster_name for r in out)
    bundle = load_bundle(spark, str(tmp_path / "in_clustered_model"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, comments string")
    got = bundle.assign(docs, "comments", "id").orderBy("id").collect()
    assert [r.cluster_label for r in got] == [0, 0, 0, 1, 1, 1]
    docs.write.parquet(str(tmp_path / "new"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "new"))
    assign_stream(stream, bundle, "comments", "id", str(tmp_path / "placed"), str(tmp_path / "offsets")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "placed")).count() == 6
    assert "circle" in (tmp_path / "in_clustered_vis_pca.svg").read_text()
    assert spark.read.parquet(str(tmp_path / "in_clustered_vis_pca.parquet")).columns == ["row_id", "x", "y", "label"]


@pytest.mark.parametrize("algorithm", ["dbscan", "agglomerative"])
def test_other_algorithms_and_edited_names(spark, tmp_path, algorithm):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    r = cluster(docs, ClusterSpec(id_column="id", algorithm=algorithm, n_clusters=2, eps=0.7, min_samples=2)).rename({1: "sea"})
    rows = r.output().orderBy("id").collect()
    assert [x.cluster_label for x in rows] == [0, 0, 0, 1, 1, 1] and rows[5].cluster_name == "sea"
    save_bundle(r, str(tmp_path / "b"))
    got = load_bundle(spark, str(tmp_path / "b")).assign(docs, "text", "id").orderBy("id").collect()
    assert [x.cluster_label for x in got] == [0, 0, 0, 1, 1, 1] and got[4].cluster_name == "sea"
