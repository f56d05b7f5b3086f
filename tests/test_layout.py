import numpy as np

from docsift.operators import grid, html_table, tables
from docsift.sources.readers import page_selection
from pyspark.sql import functions as F


def token(text, x, y, w=40, h=20):
    return {"text": text, "x1": float(x), "y1": float(y), "x2": float(x + w), "y2": float(y + h)}


def page(rows, columns, shape=(400, 500), image=None):
    image = np.full(shape, 255, "u1") if image is None else image
    for y in rows:
        image[y - 1 : y + 2, columns[0] : columns[-1] + 1] = 0
    for x in columns:
        image[rows[0] : rows[-1] + 1, x - 1 : x + 2] = 0
    return image


def test_rules_of_a_drawn_table():
    rules, segments = grid.detect(page([50, 150, 250], [40, 160, 300, 450]))
    assert [round(r) for r in rules] == [50, 150, 250] and [round(s["x"]) for s in segments] == [40, 160, 300, 450]
    assert all(abs(s["y0"] - 50) <= 2 and abs(s["y1"] - 250) <= 2 for s in segments)
    assert grid.detect(np.full((100, 100, 3), 255, "u1")) == ([], [])


def test_ruled_table_keeps_the_open_row_and_drops_the_footer():
    rules, segments = grid.detect(page([50, 150, 250], [40, 160, 300, 450]))
    tokens = [token("a", 60, 90), token("b", 180, 90), token("wide value", 150, 190, 130), token("c", 320, 190), token("open", 60, 290), token("footer", 60, 390), token("title", 60, 10)]
    cells, rows, columns = tables.ruled(tokens, rules, segments)
    got = {(c["row"], c["col"]): c["text"] for c in cells}
    assert got == {(0, 0): "a", (0, 1): "b", (1, 1): "wide value", (1, 2): "c", (2, 0): "open"} and (rows, columns) == (3, 3)


def test_nested_table_is_narrowed():
    image = page([100, 300, 800, 900], [50, 350, 650, 950], (1000, 1000))
    image = page([300, 550, 800], [90, 200, 380, 500, 620, 800, 910], image=image)
    rules, segments = grid.detect(image)
    band = tables.densest_band(rules, segments)
    assert band and abs(band[0] - 300) < 3 and abs(band[1] - 800) < 3
    tokens = [token("outer", 100, 200), token("in1", 110, 400), token("in2", 220, 400), token("in3", 700, 700)]
    cells, rows, columns = tables.ruled(tokens, rules, segments)
    assert "outer" not in {c["text"] for c in cells} and {c["text"] for c in cells} == {"in1", "in2", "in3"}
    assert rows == 2 and columns >= 6


def test_clusters_lines_and_fallbacks():
    tokens = [token("k1", 0, 0), token("v1", 200, 3), token("k2", 0, 40), token("v", 200, 41), token("2", 250, 42, 10)]
    built = tables.build_page(tokens, None, None, None)
    assert built["strategy"] == "cluster" and built["raw_text"] == "k1 v1\nk2 v 2" and built["n_cols"] == 2
    assert [c["text"] for c in built["cells"]] == ["k1", "v1", "k2", "v 2"]
    assert tables.build_page(tokens, [1.0, 2.0], [], None)["warnings"][0].startswith("morphology")
    assert tables.build_page([token("x", 0, 0)], None, None, None)["strategy"] == tables.build_page([], [], [], [])["strategy"] == "raw_text"
    regions = [{"row": r, "col": c, "row_span": 1, "col_span": 1, "x1": 190.0 * c, "y1": 38.0 * r, "x2": 190.0 * c + 150, "y2": 38.0 * r + 38} for r in (0, 1) for c in (0, 1)]
    assert tables.build_page(tokens, None, None, regions)["strategy"] == "pp_structure"
    assert tables.build_page(tokens, None, None, regions[:1])["strategy"] == "cluster"
    assert tables.clustered_band(token("far", 900, 0), [(0, 10), (50, 60)]) == 0 and tables.ruled_band(token("far", 900, 0), [(0, 10), (50, 60)]) == 1


def test_html_positions():
    at = lambda html: [(c["row"], c["col"], c["row_span"], c["col_span"]) for c in html_table.positions(html)]
    assert at("<tr><th rowspan=2>a<td colspan='2'>b</tr><tr><td>c<td>d") == [(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1)]
    assert at("<td>x") == [(0, 0, 1, 1)] and at("<tr><td rowspan='-1' colspan='q'>") == [(0, 0, 1, 1)]
    assert at(None) == at("") == []


def test_cells_from_boxes(spark):
    boxes = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b)]) for b in ((0, 0, 100, 50), (103, 2, 200, 51), (0, 50, 201, 100))])
    found = spark.range(1).select(html_table.cells_from_boxes(boxes).alias("c")).first()["c"]
    assert [(c["row"], c["col"], c["row_span"], c["col_span"]) for c in found] == [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1)]


def test_page_selection(spark):
    specs = [("2", 5, [1]), ("1,3", 5, [0, 2]), ("2-4", 5, [1, 2, 3]), ("4-2", 5, [1, 2, 3]), ("2,2,2", 5, [1]), ("", 3, [0, 1, 2]), (None, 3, [0, 1, 2]), ("abc,2,99", 3, [1]), ("99", 3, [0, 1, 2]), ("1-2-3,x", 2, [0, 1]), ("1", 0, [])]
    df = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(specs)], "i int, s string, n int")
    found = df.select("i", page_selection(F.col("s"), F.col("n")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in found] == [e for _, _, e in specs]


def test_images_tokens_and_streams(spark, tmp_path):
    from docsift.engine import Extractor
    from docsift.sources.readers import recognise
    from docsift.streaming.extract import extract_stream, start

    image = page([50, 150, 250], [40, 160, 300])
    kind = "doc_id string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    images = spark.createDataFrame([("a", ("x", 400, 500, 1, 0, bytearray(image.tobytes()))), ("bad", ("y", -1, -1, -1, -1, bytearray()))], kind)

    class Fake:
        def tokens(self, height, width, channels, data):
            if height < 0:
                raise ValueError
            return [token("Mã gói", 60, 90), token("PK100", 180, 90), token("SMS", 60, 190), token("55", 180, 190), {"text": " "}]

    found = recognise(images, Fake)
    assert found.count() == 4
    e = Extractor()
    record = e.from_tokens(found, grids=grid.grids(images)).first()
    assert record["strategy"] == "morphology"
    values = {f["name"]: f["value"] for f in record["fields"]}
    assert values["packageCode"]["s"] == "PK100" and values["sms"]["i"] == 55
    spark.createDataFrame([("d", "SMS: 7\nx")], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in"))
    start(extract_stream(stream, e), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert '"sms": 7' in spark.read.text(str(tmp_path / "out")).first()[0]
