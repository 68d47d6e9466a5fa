"""Readers, sinks and streams."""

from pyspark.sql import functions as F

from foliospark.sources import readers, sinks


def test_files_become_rows_and_bad_ones_too(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 ok")
    (tmp_path / "b.pdf").write_bytes(b"nada")
    (tmp_path / "c.txt").write_bytes(b"x")
    files = readers.scan_files(spark, str(tmp_path))
    got = {r["filename"]: r["error"] for r in files.collect()}
    assert got == {"a.pdf": None, "b.pdf": "INVALID_PDF"}
    readers.register("demo", lambda data: [{"page": 1, "block_no": 0, "line_no": 0, "span_no": 0, "text": data[:4].decode()}])
    assert readers.decode(files, "demo").first()["text"] == "%PDF"
    assert readers.decode(files, "absent").first()["error"]
    assert readers.not_yet_converted(files, files.where("error is null")).count() == 1
    assert readers.capabilities()["decoder:demo"]


def test_markdown_and_html_adapters(spark):
    d = spark.createDataFrame([(1, "# T\n\n- a\n2. b\n> q\r\ntexto"), (2, None), (3, "")], "doc_id bigint, text string")
    got = [(r["kind"], r["text"]) for r in readers.markdown_blocks(d).orderBy("seq").collect()]
    assert got == [("heading", "T"), ("list_item", "a"), ("list_item", "b"), ("quote", "q"), ("paragraph", "texto")]
    h = spark.createDataFrame([("p", "<nav><p>menu</p></nav><h1>A &amp; B</h1><p>x<br>y</p><ul><li>z</li></ul><script>1</script>")], "doc_id string, html string")
    assert [(r["tag"], r["text"]) for r in readers.html_blocks(h).orderBy("pos").collect()] == [("h1", "A & B"), ("p", "x y"), ("li", "z")]


def test_map_box(spark):
    d = spark.createDataFrame([(0.0, 0.0, 100.0, 50.0)], "x0 double, y0 double, x1 double, y1 double")
    r = d.select(readers.map_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), (0, 1, -1, 0, 100, 0), 2.0).alias("b")).first()["b"]
    assert (r["x0"], r["y0"], r["x1"], r["y1"]) == (25.0, 0.0, 50.0, 50.0)


def test_markdown_files_are_whole(spark, tmp_path):
    docs = spark.createDataFrame([("d", "# á\n")], "doc_id string, markdown string")
    names = spark.createDataFrame([("d", "x/y: z.pdf")], "doc_id string, filename string")
    rows = sinks.markdown_files(docs, names)
    assert sinks.write_files(rows, str(tmp_path), "name", "markdown").first()["bytes"] == len("# á\n".encode())
    assert (tmp_path / "y z.md").read_text() == "# á\n"
