"""The data source and the SQL functions."""

from quillspark.sources import datasource
from quillspark.sources import writers as w


def test_source_and_functions(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "a").write_bytes(w.docx(w.docx_paragraph(w.docx_run("hello"))))
    (tmp_path / "b").write_bytes(w.xlsx([("S", [["x", 2], [None, ("s", 0)]])], ["shared"]))
    (tmp_path / "c").write_bytes(b"junk")
    rows = {r["path"][-1]: r for r in spark.read.format("documents").load(str(tmp_path)).collect()}
    assert (rows["a"]["format"], rows["a"]["text"]) == ("docx", "hello") and rows["c"]["error"]
    spark.read.format("binaryFile").load(str(tmp_path)).createOrReplaceTempView("files")
    got = spark.sql("SELECT right(path, 1) AS p, document_format(content) AS f, document_text(content) AS t FROM files ORDER BY p").collect()
    assert [(r["f"], r["t"]) for r in got][0] == ("docx", "hello") and got[1]["f"] == "xlsx" and got[2]["f"] is None
    cells = spark.sql("SELECT t.* FROM files, LATERAL document_cells(content) t ORDER BY row, col").collect()
    assert [(r["row"], r["col"], r["value"]) for r in cells] == [(0, 0, "x"), (0, 1, "2"), (1, 1, "shared")]
