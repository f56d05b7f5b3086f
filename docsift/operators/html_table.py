"""Cell positions of HTML tables, and cells from recognised boxes."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

POSITIONS = "array<struct<row:int,col:int,row_span:int,col_span:int>>"
EDGE_GAP = 12.0


def span_of(text: str | None) -> int:
    """A span attribute; 1 for what isn't a positive whole number."""
    try:
        return max(1, int((text or "").strip()))
    except ValueError:
        return 1


class _Grid(HTMLParser):
    """Places each cell in the first column that spans of earlier cells leave free."""

    def __init__(self) -> None:
        super().__init__()
        self.row, self.at = -1, 0
        self.free_from: dict[int, int] = {}  # by column: the first row that is free again
        self.cells: list[dict[str, int]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.row, self.at = self.row + 1, 0
        elif tag in ("td", "th"):
            self.row = max(0, self.row)
            given = dict(attrs)
            rows, columns = span_of(given.get("rowspan")), span_of(given.get("colspan"))
            while self.free_from.get(self.at, 0) > self.row:
                self.at += 1
            for c in range(self.at, self.at + columns):
                self.free_from[c] = max(self.free_from.get(c, 0), self.row + rows)
            self.cells.append({"row": self.row, "col": self.at, "row_span": rows, "col_span": columns})
            self.at += columns


def positions(html: str | None) -> list[dict[str, int]]:
    grid = _Grid()
    try:
        grid.feed(html or "")
        grid.close()
    except Exception:  # noqa: BLE001  damaged markup has no table
        return []
    return grid.cells


def table_positions(html: Column) -> Column:
    """POSITIONS of a table's cells in the order of their tags; empty for null or damaged markup."""

    @pandas_udf(POSITIONS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(positions)

    return run(html)


def edges_of(values: Column) -> Column:
    """Grid edges: sorted values, each more than EDGE_GAP beyond the edge before it."""
    fresh = lambda edges, v: F.when((F.size(edges) == 0) | (v - F.try_element_at(edges, F.lit(-1)) > EDGE_GAP), F.concat(edges, F.array(v))).otherwise(edges)
    return F.aggregate(F.array_sort(values), F.lit([]).cast("array<double>"), fresh)


def nearest(value: Column, edges: Column) -> Column:
    """Index of the nearest edge, the first of equals; 0 without edges."""
    gaps = F.transform(edges, lambda e, i: F.struct(F.abs(e - value).alias("gap"), i.alias("i")))
    return F.coalesce(F.array_min(gaps)["i"], F.lit(0))


def cells_from_boxes(boxes: Column) -> Column:
    """Row, column and spans of each box (array<struct<x1,y1,x2,y2>>) by the edges of all."""
    rows, columns = edges_of(F.transform(boxes, lambda b: b["y1"])), edges_of(F.transform(boxes, lambda b: b["x1"]))

    def cell(b: Column) -> Column:
        r, c = nearest(b["y1"], rows), nearest(b["x1"], columns)
        return F.struct(
            r.alias("row"), c.alias("col"), F.greatest(F.lit(1), nearest(b["y2"], rows) - r).alias("row_span"), F.greatest(F.lit(1), nearest(b["x2"], columns) - c).alias("col_span"),
            b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"),
        )

    return F.transform(boxes, cell)


def regions(df: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, regions from rows with html and boxes: HTML positions where their number is that of the boxes, else by edges."""
    found = df.withColumn("_p", table_positions(F.col("html")))
    zipped = F.zip_with("_p", "boxes", lambda p, b: F.struct(*[p[n].alias(n) for n in ("row", "col", "row_span", "col_span")], *[b[n].alias(n) for n in ("x1", "y1", "x2", "y2")]))
    return found.select(*keys, F.when(F.size("_p") == F.size("boxes"), zipped).otherwise(cells_from_boxes(F.col("boxes"))).alias("regions"))


def grid_of(cells: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, row, col, text of every grid place: a merged cell's text stands in each place that it covers."""
    places = cells.select(*keys, "text", F.explode(F.expr("sequence(row, row + row_span - 1)")).alias("row"), "col", "col_span")
    return places.select(*keys, "row", F.explode(F.expr("sequence(col, col + col_span - 1)")).alias("col"), "text")


def rendered(cells: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, text: a table as lines of its grid's texts, parted by " | "."""
    rows = grid_of(cells, keys).groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " | ").alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("text"))


def cell_at(cells: DataFrame, places: DataFrame, key: str = "doc_id") -> DataFrame:
    """places (key, row, col) with the text of the first cell (by ord) that covers each; null for none."""
    c = cells.select(F.col(key).alias("_k"), "ord", "row_span", "col_span", "text", F.col("row").alias("_r"), F.col("col").alias("_c"))
    on = (F.col(key) == F.col("_k")) & F.expr("row >= _r AND row < _r + row_span AND col >= _c AND col < _c + col_span")
    return places.join(c, on, "left").groupBy(key, "row", "col").agg(F.min_by("text", "ord").alias("text"))


def row_cells(cells: Column, row: Column | int) -> Column:
    """The cells of a table that cover a row, by column; a merged cell is in every row it covers."""
    return _covering(cells, row, "row", "col")


def column_cells(cells: Column, col: Column | int) -> Column:
    """The cells of a table that cover a column, by row."""
    return _covering(cells, col, "col", "row")


def iter_cells(cells: Column) -> Column:
    """All cells by row and column."""
    return F.array_sort(cells)


def _covering(cells: Column, at: Column | int, of: str, by: str) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    found = F.filter(cells, lambda c: (c[of] <= at) & (at < c[of] + c[of + "_span"]))
    return F.array_sort(found, lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0))


def has_table(cells: Column) -> Column:
    """Some cell holds text."""
    return F.coalesce(F.exists(cells, lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != ""), F.lit(False))
