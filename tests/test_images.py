import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.engine import Extractor
from docsift.operators import html_table, tables
from docsift.operators import preprocess as P
from docsift.operators.pages import merge_pages
from docsift.plans.schema import schema_of
from docsift.sources import readers


def lines_page(angle=0.0, h=300, w=400):
    y, x = np.mgrid[:h, :w].astype("f8")
    turn = np.radians(angle)
    across = np.cos(turn) * (x - w / 2) + np.sin(turn) * (y - h / 2)
    down = -np.sin(turn) * (x - w / 2) + np.cos(turn) * (y - h / 2)
    ink = (np.abs(across) < 140) & (np.abs(down) < 60) & (np.floor(down / 10) % 2 == 0)
    return np.where(ink, 20, 240).astype("u1")


@pytest.mark.parametrize("angle", [-7.0, -2.0, 0.0, 2.0, 10.0])
def test_skew_is_found_and_undone(angle):
    page = lines_page(angle)
    assert P.skew_angle(page) == pytest.approx(angle, abs=0.4)
    assert abs(P.skew_angle(P.straighten(page))) < 0.5


def test_skew_limits():
    assert P.skew_angle(lines_page(20.0)) == 0.0 and P.skew_angle(np.full((50, 50), 255, "u1")) == 0.0
    page = lines_page()
    assert P.straighten(page) is page


def test_size_smoothing_and_threshold():
    page = lines_page()
    big = P.upscale(page, 1000)
    assert big.shape == (750, 1000) and P.upscale(big, 1000) is big
    noisy = np.clip(page.astype("i4") + np.random.default_rng(1).integers(-12, 13, page.shape), 0, 255).astype("u1")
    assert np.abs(P.smooth(noisy).astype(int) - page).mean() < np.abs(noisy.astype(int) - page).mean()
    shaded = np.clip(page * np.linspace(0.6, 1.0, 400)[None], 0, 255).astype("u1")
    black = P.binarize(shaded) == 0
    assert (black == (page < 128)).mean() > 0.95 and P.otsu(page) < 240


def test_prepared_images(spark):
    page = np.repeat(lines_page()[..., None], 3, 2)
    kind = "doc_id string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    df = spark.createDataFrame([("a", ("x", 300, 400, 3, 16, bytearray(page.tobytes()))), ("bad", ("y", -1, -1, -1, -1, bytearray()))], kind)
    got = {r["doc_id"]: r for r in P.prepared(df).collect()}
    assert got["a"]["processed"] and (got["a"]["image"]["height"], got["a"]["image"]["width"], len(got["a"]["image"]["data"])) == (750, 1000, 750 * 1000 * 3)
    assert not got["bad"]["processed"] and got["bad"]["image"]["height"] == -1


def test_pages_of_files(spark):
    class Fake:
        def page_count(self, pdf):
            return int(pdf)

        def page(self, pdf, number, dpi):
            return dpi, number, 1, b"x"

    files = spark.createDataFrame([("f5", bytearray(b"5")), ("broken", bytearray(b"?"))], "path string, content binary")
    got = readers.render_pages(files, Fake, "2,4-9", 72).collect()
    assert sorted((r["doc_id"], r["page"], r["image"]["height"], r["image"]["width"]) for r in got) == [("f5", 2, 72, 1), ("f5", 4, 72, 3), ("f5", 5, 72, 4)]


def test_engines_and_languages(monkeypatch):
    monkeypatch.setattr(readers, "ENGINES", {})

    def broken():
        raise RuntimeError("no library")

    readers.register_engine("first", lambda: False, broken)
    readers.register_engine("second", lambda: True, lambda size=1: ("second", size))
    readers.register_engine("third", lambda: 1 / 0, lambda: None)
    assert readers.available_engines() == ["second"]
    assert readers.choose_engine("auto", size=4, other=5) == ("second", ("second", 4)) == readers.choose_engine("FIRST", size=4)
    with pytest.raises(readers.EngineError):
        readers.choose_engine("first", strict=True)
    with pytest.raises(readers.EngineError):
        readers.choose_engine("none")
    pick = readers.pick_language
    assert (pick("fra", {"fra"}), pick("fra", {"vie", "eng"}), pick(None, {"eng"}), pick(None, set()), pick("vie+eng", {"vie", "eng"})) == ("fra", "vie", "eng", "eng", "vie+eng")


def test_rendered_tables(spark):
    rows = [("d", 0, 0, 2, 1, "a"), ("d", 0, 1, 1, 2, "b"), ("d", 1, 1, 1, 1, "c"), ("d", 1, 2, 1, 1, "e")]
    cells = spark.createDataFrame(rows, "doc_id string, row int, col int, row_span int, col_span int, text string")
    assert html_table.rendered(cells).first()["text"] == "a | b | b\na | c | e"
    row = spark.range(1).select(html_table.nearest(F.lit(5.0), F.lit([0.0, 10.0])).alias("n")).first()
    assert row["n"] == 0


def page_image(lines, seed=0):
    """A grey page of 200 x 300 whose last rows of pixels hold the text of lines, as the made-up recogniser below reads them."""
    data = np.full((200, 300), 255, "u1")
    raw = "\n".join(lines).encode()
    data[-1, 0], data[-1, 1] = len(raw) // 256, len(raw) % 256
    data.reshape(-1)[-301 - len(raw) : -301] = np.frombuffer(raw, "u1")
    return data


class Reader:
    """Reads what ``page_image`` wrote; fails on other images."""

    prepares = False

    def tokens(self, height, width, channels, data):
        flat = np.frombuffer(data, "u1").reshape(height, width, channels)[..., 0]
        size = int(flat[-1, 0]) * 256 + int(flat[-1, 1])
        if not 0 < size < 20_000:
            raise ValueError
        text = flat.reshape(-1)[-301 - size : -301].tobytes().decode()
        return [{"text": part, "x1": 150.0 * c, "y1": 30.0 * r, "x2": 150.0 * c + 90, "y2": 30.0 * r + 20, "confidence": 0.9} for r, line in enumerate(text.split("\n")) for c, part in enumerate(line.split("|"))]


class Attempts:
    """Sees the label only where the image has black and white alone (or not, by ``best``)."""

    def __init__(self, best=True):
        self.best = best

    def tokens(self, height, width, channels, data):
        clear = set(np.unique(np.frombuffer(data, "u1"))) <= {0, 255}
        lines = ["SMS", "41"] if clear == self.best else ["SMS", "kelp"]
        return [{"text": t, "x1": 200.0 * k, "y1": 10.0, "x2": 200.0 * k + 90, "y2": 30.0} for k, t in enumerate(lines)] + [{"text": "x", "x1": 0.0, "y1": 60.0, "x2": 9.0, "y2": 80.0}]


SMALL = schema_of({"fields": [{"name": "sms", "type": "int", "parser": "int_parser", "aliases": ["SMS"]}, {"name": "cycle", "parser": "cycle_parser", "aliases": ["Chu kỳ"]}, {"name": "packageCode", "aliases": ["Mã gói"]}]})
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def image_rows(spark, pages, kind="doc_id string, page int"):
    rows = [(*k, ("x", *p.shape[:2], 1, 0, bytearray(p.tobytes()))) for k, p in pages]
    return spark.createDataFrame(rows, f"{kind}, image {IMAGE}")


def shade():
    return np.add.outer(np.arange(120), np.arange(160)).astype("u1") // 2 + 80


@pytest.fixture
def engines(monkeypatch):
    monkeypatch.setattr(readers, "ENGINES", {})
    monkeypatch.setattr(readers, "RENDERERS", [])
    readers.register_engine("reader", lambda: True, Reader)
    return readers


def test_images_of_documents(spark, engines):
    pages = [(("a", 1), page_image(["SMS|7", "kelp|yacht"])), (("a", 2), page_image(["Mã gói|QX77", "SMS|9", "Chu kỳ|ngày"])), (("b", 1), np.full((50, 60), 255, "u1"))]
    e = Extractor(SMALL, engine="reader")
    each = e.from_images(image_rows(spark, pages), ("doc_id", "page"))
    got = {r["doc_id"]: json.loads(r["json"]) for r in e.json(merge_pages(each)).collect()}
    assert (got["a"]["packageCode"], got["a"]["sms"], got["a"]["cycle"]) == ("QX77", 9, "ngày")
    assert set(got) == {"a", "b"} and all(v is None for v in got["b"].values())


@pytest.mark.parametrize("best,binarize,sms", [(True, None, 41), (False, None, 41), (True, True, 41), (True, False, None), (False, True, None)])
def test_attempts_of_images(spark, engines, best, binarize, sms):
    readers.register_engine("attempts", lambda: True, Attempts)
    e = Extractor(SMALL, engine="attempts", engine_options={"best": best, "unknown": 1}, binarize=binarize)
    found = e.json(e.from_images(image_rows(spark, [(("d", 1), shade())]), ("doc_id", "page")), "doc_id", "page").collect()
    assert len(found) == 1 and json.loads(found[0]["json"])["sms"] == sms


def test_pdfs_and_engines_that_are_missing(spark, engines):
    class Drawer:
        def page_count(self, pdf):
            return int(pdf)

        def page(self, pdf, number, dpi):
            image = page_image([f"SMS|{number + dpi}", "kelp|yacht", *(["Chu kỳ|tháng"] if number == 1 else [])])
            return (*image.shape, 1, image.tobytes())

    files = spark.createDataFrame([("p.pdf", bytearray(b"4")), ("bad.pdf", bytearray(b"zz"))], "path string, content binary")
    with pytest.raises(readers.EngineError):
        Extractor(SMALL).from_pdfs(files)
    readers.register_renderer(Drawer)
    e = Extractor(SMALL)
    found = e.from_pdfs(files, "2-3", 100)
    row = found.first()
    assert found.count() == 1 and (row["page"], row["pages"]) == (2, 2)
    assert (lambda r: (r["sms"], r["cycle"]))(json.loads(e.json(found).first()["json"])) == (101, "tháng")
    with pytest.raises(readers.EngineError):
        Extractor(SMALL, engine="no such").from_images(image_rows(spark, []))


def test_mean_confidence_and_cells(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), t, float(c)) for d, t, c in zip(rng.integers(0, 5, 200), rng.choice(["kelp", " ", ""], 200), rng.random(200), strict=True)] + [(9, " ", 0.5)]
    found = tables.mean_confidence(spark.createDataFrame(rows, "doc_id int, text string, confidence double")).collect()
    for r in found:
        own = [c for d, t, c in rows if d == r["doc_id"] and t.strip()]
        assert r["n_tokens"] == len(own) and r["mean_conf"] == pytest.approx(sum(own) / len(own) if own else 0.0)
    cells = [(0, 1, 1, 1, "b"), (0, 0, 2, 1, "a"), (1, 1, 1, 2, "c")]
    df = spark.createDataFrame([(cells,)], "cells array<struct<row:int,col:int,row_span:int,col_span:int,text:string>>")
    shown = lambda c: F.transform(c, lambda x: x["text"])
    row = df.select(shown(html_table.row_cells(F.col("cells"), 1)).alias("r"), shown(html_table.column_cells(F.col("cells"), 1)).alias("c"), shown(html_table.iter_cells(F.col("cells"))).alias("i"), html_table.has_table(F.col("cells")).alias("h")).first()
    assert tuple(row) == (["a", "c"], ["b", "c"], ["a", "b", "c"], True)
    built = tables.build_page([{"text": f"t{k}", "x1": 40.0 * k, "y1": 30.0 * r, "x2": 40.0 * k + 9, "y2": 30.0 * r + 9} for k in range(30) for r in (0, 1)], None, None, None)
    assert built["n_cols"] == tables.MAX_COLUMNS and built["confidence"] == tables.CLUSTER_CONFIDENCE and "30 columns" in built["warnings"][0]


def test_the_best_of_several_recognised_tables():
    tokens = [{"text": f"k{r}{c}", "x1": 100.0 * c, "y1": 30.0 * r, "x2": 100.0 * c + 50, "y2": 30.0 * r + 20} for r in range(3) for c in range(2)]
    box = lambda t, r, c: {"table": t, "row": r, "col": c, "row_span": 1, "col_span": 1, "x1": 100.0 * c, "y1": 30.0 * r, "x2": 100.0 * c + 60, "y2": 30.0 * r + 25}
    regions = [box(0, 0, 0), box(0, 0, 1), *(box(1, r, c) for r in range(3) for c in range(2))]
    built = tables.build_page(tokens, None, None, regions)
    assert (built["strategy"], built["n_rows"], built["n_cols"], built["confidence"]) == ("pp_structure", 3, 2, 1.0)
    assert tables.build_page(tokens, None, None, regions[:2])["strategy"] == "cluster"
