"""Registered queries over the driver's tables, with DuckDB SQL that computes the same from base columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.engine import Extractor
from docsift.functions import geometry as G
from docsift.functions import parsers as P
from docsift.functions import text as T
from docsift.functions.match import match_texts
from docsift.operators import html_table, tables
from docsift.operators.pages import best_run
from docsift.plans import resolve as R
from docsift.plans.schema import Schema, load_schema, schema_of
from docsift.sources.readers import cells_of_rows, page_selection, tokens_of_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt out, as a row here costs far more than its shuffle."""
    df, cores = spark.read.parquet(f"{sf}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def text_of(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Text and parsers.


@query("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def fold_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9+]+', ' ', 'g')) AS label FROM part")
def normalize_label(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.normalize_label(text_of(F.col("p_name"), " (", F.col("p_brand"), ")")).alias("label"))


def _amount(value: Column) -> Column:
    return F.coalesce(value["d"], value["i"].cast("double"))


@query("SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DOUBLE) AS amount FROM orders")
def money_us(spark, sf):
    shown = text_of("Total: ", F.format_number("o_totalprice", 2), " $")
    return table(spark, sf, "orders").select("o_orderkey", _amount(P.parse("money_parser", shown)).alias("amount"))


@query("SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DOUBLE) AS amount FROM orders")
def money_eu(spark, sf):
    shown = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return table(spark, sf, "orders").select("o_orderkey", _amount(P.parse("money_parser", text_of(shown, " đ"), {"min_value": 0})).alias("amount"))


@query("SELECT o_orderkey, CAST(round_even(o_orderkey % 1000 + 0.5, 0) AS BIGINT) AS n FROM orders")
def int_half_even(spark, sf):
    shown = text_of("MP ", F.col("o_orderkey") % 1000, ",5 phút")
    return table(spark, sf, "orders").select("o_orderkey", P.parse("int_parser", shown)["i"].alias("n"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS first_gb, CAST(p_partkey % 97 AS DOUBLE) AS named_gb, CAST(p_size AS DOUBLE) AS bare FROM part")
def gb_parser(spark, sf):
    both = text_of(F.col("p_size"), "GB/tháng, Youtube: ", F.col("p_partkey") % 97, " G B")
    return table(spark, sf, "part").select(
        "p_partkey", _amount(P.parse("gb_parser", both)).alias("first_gb"), _amount(P.parse("gb_parser", both, {"keyword": "youtube"})).alias("named_gb"),
        _amount(P.parse("gb_parser", text_of(F.col("p_size")))).alias("bare"),
    )


@query("SELECT p_partkey, list_extract(['tháng', 'ngày', 'tuần', 'quý', 'năm'], CAST(p_partkey % 5 + 1 AS INT)) AS cycle FROM part")
def cycle_parser(spark, sf):
    words = F.array(*map(F.lit, ("THÁNG", "ngày", "Tuan", "quý", "NAM")))
    shown = text_of("Chu kỳ gia hạn: 30 ", F.get(words, (F.col("p_partkey") % 5).cast("int")))
    return table(spark, sf, "part").select("p_partkey", P.parse("cycle_parser", shown)["s"].alias("cycle"))


@query("SELECT p_partkey, p_brand || '|' || p_type || '|x' || p_partkey % 7 AS items, 3 AS n FROM part")
def list_parser(spark, sf):
    shown = text_of(F.col("p_brand"), ", ", F.col("p_type"), "; x", F.col("p_partkey") % 7, ".,,", F.col("p_brand"))
    items = P.parse("list_parser", shown, {"min_item_length": 2})["a"]
    return table(spark, sf, "part").select("p_partkey", F.array_join(items, "|").alias("items"), F.size(items).alias("n"))


@query("SELECT p_partkey, upper(p_brand) AS code, trim(substr(p_type, 1, 9)) AS short FROM part")
def text_parser(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", P.parse("text_parser", text_of(" : ", F.col("p_brand"), " -"), {"upper": True})["s"].alias("code"), P.parse("text_parser", text_of("Type| ", F.col("p_type")), {"keyword": "type", "max_length": 9})["s"].alias("short")
    )


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '7' AS digits FROM orders")
def fix_ocr_digits(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.fix_ocr_digits(F.concat(F.translate(F.col("o_orderkey").cast("string"), "01258", "OlzSB"), F.lit("7"))).alias("digits"))


# Extraction. Cards are made of base columns; the SQL reads these columns.


def card_lines() -> list[Column]:
    c = F.col
    return [
        text_of("Mã gói cước: pkg", c("c_custkey")),
        text_of("Cước đăng ký ", F.format_number(F.abs(c("c_acctbal")), 2)),
        text_of("Ưu đãi SMS ", c("c_custkey") % 500, " tin nhắn"),
        text_of("Lưu lượng data: ", c("c_custkey") % 90, "GB/tháng"),
        F.concat(F.lit("Chu kỳ gia hạn: "), F.when(c("c_custkey") % 2 == 0, F.lit("ngày")).otherwise(F.lit("tháng"))),
        text_of("Gói cước áp dụng: Basic+, ", F.initcap(c("c_mktsegment"))),
    ]


CARD_SQL = """SELECT c_custkey, upper('pkg' || c_custkey) AS package, CAST(round(abs(c_acctbal), 2) AS DOUBLE) AS fee,
  CAST(c_custkey % 500 AS BIGINT) AS sms, CAST(c_custkey % 90 AS DOUBLE) AS data,
  CASE WHEN c_custkey % 2 = 0 THEN 'ngày' ELSE 'tháng' END AS cycle,
  'Basic+|' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS packages FROM customer"""


def card_columns(records: DataFrame, key: str = "c_custkey") -> DataFrame:
    wide = R.wide(records, load_schema(), key)
    return wide.select(key, F.col("packageCode").alias("package"), F.col("registerFee").alias("fee"), "sms", F.col("dataGB").alias("data"), "cycle", F.array_join("allowedPackages", "|").alias("packages"))


@query(CARD_SQL)
def text_extract(spark, sf):
    cards = table(spark, sf, "customer").select("c_custkey", F.concat_ws("\n", *card_lines()).alias("text"))
    return card_columns(Extractor().from_text(cards, keys=("c_custkey",)))


@query(CARD_SQL)
def page_merge(spark, sf):
    lines = card_lines()
    pages = [F.struct(F.lit(k + 1).alias("page"), F.concat_ws("\n", *lines[k::3], F.lit("Trang")).alias("text")) for k in range(3)]
    cards = table(spark, sf, "customer").select("c_custkey", F.inline(F.array(*pages)))
    return card_columns(Extractor().from_pages(cards, keys=("c_custkey",)))


@query(CARD_SQL)
def attempt_select(spark, sf):
    lines = card_lines()
    good, bad = F.concat_ws("\n", *lines), F.concat_ws("\n", *lines[:2], F.lit("mờ"))
    odd = F.col("c_custkey") % 2 == 1
    tries = [F.struct(F.lit(k).alias("attempt"), F.lit(1).alias("page"), F.when(odd == F.lit(bool(k)), good).otherwise(bad).alias("text")) for k in range(2)]
    cards = table(spark, sf, "customer").select("c_custkey", F.inline(F.array(*tries)))
    return card_columns(Extractor().from_pages(cards, keys=("c_custkey",), attempt="attempt"))


@query("""SELECT c_custkey, 11 AS n, CAST(c_custkey % 7 AS INT) AS found, CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 0.97 END AS DOUBLE) AS mean_score FROM customer""")
def page_score(spark, sf):
    """Cards of 0 to 6 lines; a line begins with its label, so each scores 0.97."""
    from docsift.operators.pages import page_score as score

    lines = F.slice(F.array(*card_lines()), F.lit(1), (F.col("c_custkey") % 7).cast("int"))
    cards = table(spark, sf, "customer").select("c_custkey", F.concat_ws("\n", lines, F.lit("hết")).alias("text"))
    found = Extractor().from_text(cards, keys=("c_custkey",)).select("c_custkey", F.size("fields").alias("n"), score().alias("s"))
    return found.select("c_custkey", "n", F.col("s.found").alias("found"), F.round("s.mean", 9).alias("mean_score"))


PART_SQL = "SELECT p_partkey, upper('P' || p_partkey || 'X') AS package, CAST(round(p_retailprice, 2) AS DOUBLE) AS fee, CAST(p_size AS BIGINT) AS sms FROM part"


def part_record(records: DataFrame) -> DataFrame:
    wide = R.wide(records, load_schema(), "p_partkey")
    return wide.select("p_partkey", F.col("packageCode").alias("package"), F.col("registerFee").alias("fee"), "sms")


def part_values() -> list[Column]:
    return [text_of("p", F.col("p_partkey"), "x"), F.format_number("p_retailprice", 2), F.col("p_size").cast("string")]


LABELS = ("Mã gói", "Cước đăng ký", "SMS")


@query(PART_SQL)
def table_kv(spark, sf):
    rows = F.array(F.array(F.lit("Nội dung"), F.lit("Chi tiết")), *[F.array(F.lit(k), v) for k, v in zip(LABELS, part_values(), strict=True)])
    cells = cells_of_rows(table(spark, sf, "part").select("p_partkey", rows.alias("rows")), keys=("p_partkey",))
    return part_record(Extractor().from_cells(cells, ("p_partkey",)))


@query(PART_SQL)
def table_header(spark, sf):
    rows = F.array(F.array(*map(F.lit, LABELS[::-1])), F.array(*part_values()[::-1]))
    cells = cells_of_rows(table(spark, sf, "part").select("p_partkey", rows.alias("rows")), keys=("p_partkey",))
    return part_record(Extractor().from_cells(cells, ("p_partkey",)))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS offnet, CAST(NULL AS VARCHAR) AS onnet, 1 AS warnings FROM part")
def collision_guard(spark, sf):
    rows = F.array(F.array(F.lit("Thoại ngoại mạng"), F.lit("")), F.array(text_of(F.col("p_size"), " phút"), F.lit("")))
    cells = cells_of_rows(table(spark, sf, "part").select("p_partkey", rows.alias("rows")), keys=("p_partkey",))
    found = Extractor().from_cells(cells, ("p_partkey",))
    wide = R.wide(found, load_schema(), "p_partkey", "warnings")
    return wide.select("p_partkey", F.col("offnetMinutes").alias("offnet"), F.col("onnetMinutes").alias("onnet"), F.size("warnings").alias("warnings"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(p_partkey % 4 + 1 AS INT) END AS at_col,
  CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS data FROM part""")
def value_right(spark, sf):
    """The value stands 1 to 3 places right of its label, or 5, which is too far."""
    gap = F.when(F.col("p_partkey") % 4 == 3, 5).otherwise(F.col("p_partkey") % 4 + 1)
    cells = F.array(F.struct(F.lit(5).alias("row"), F.lit(0).alias("col"), F.lit("Lưu lượng").alias("text")), F.struct(F.lit(5).alias("row"), gap.cast("int").alias("col"), text_of(F.col("p_size"), "GB").alias("text")))
    some = table(spark, sf, "part").select("p_partkey", F.inline(cells))
    blanks = table(spark, sf, "part").select("p_partkey", F.lit(5).alias("row"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("col"), F.lit("").alias("text"))
    grid = some.unionByName(blanks).groupBy("p_partkey", "row", "col").agg(F.max("text").alias("text"))
    found = R.long(Extractor().from_cells(grid, ("p_partkey",)), "p_partkey").where("name = 'dataGB'")
    return found.select("p_partkey", F.when(F.col("value").isNotNull(), F.col("col")).alias("at_col"), _amount(F.col("value")).alias("data"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST(p_partkey % 3 + 1 AS INT) END AS at_row,
  CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS data FROM part""")
def value_below(spark, sf):
    gap = F.when(F.col("p_partkey") % 3 == 2, 5).otherwise(F.col("p_partkey") % 3 + 1)
    rows = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda r: F.array(F.when(r == 0, "Lưu lượng").when(r == gap, text_of(F.col("p_size"), " GB")).otherwise(""), F.lit("")))
    cells = cells_of_rows(table(spark, sf, "part").select("p_partkey", rows.alias("rows")), keys=("p_partkey",))
    found = R.long(Extractor().from_cells(cells, ("p_partkey",)), "p_partkey").where("name = 'dataGB'")
    return found.select("p_partkey", F.when(F.col("value").isNotNull(), F.col("row")).alias("at_row"), _amount(F.col("value")).alias("data"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS fee, 'regex' AS source FROM part")
def regex_strategy(spark, sf):
    """The label stands in running text, too small a part of it to match: only the pattern finds it."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau "
    shown = text_of(words, "phi   duy  tri xx ", F.col("p_size"), " ", words)
    cards = table(spark, sf, "part").select("p_partkey", shown.alias("text"))
    found = R.long(Extractor().from_text(cards, keys=("p_partkey",)), "p_partkey").where("name = 'monthlyFee'")
    return found.select("p_partkey", _amount(F.col("value")).alias("fee"), "source")


@query()
def similarity(spark, sf):
    """Scores of nation and part names against the labels of the schema."""
    schema = load_schema()
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf, "part").select(F.col("p_name").alias("name")))
    scored = names.select("name", F.posexplode(F.get(match_texts(F.array(F.concat(F.lit("Thoại noi "), "name")), schema), F.lit(0))).alias("field", "m"))
    return scored.select("name", "field", F.col("m.score").alias("score"), F.col("m.alias").alias("alias"))


# Layout.


def part_tokens(spark, sf, page: str) -> DataFrame:
    x, row = (F.col("p_partkey") % 7) * 90.0, F.col("p_partkey") * 26.0
    size = 8.0 * (F.length("p_name") % 9 + 1)
    return table(spark, sf, "part").select(F.col(page).alias("page"), F.col("p_partkey").alias("tok"), F.col("p_name").alias("text"), x.alias("x1"), row.alias("y1"), (x + size).alias("x2"), (row + 20).alias("y2"))


@query("""WITH t AS (SELECT p_size AS page, (p_partkey % 7) * 90.0::DOUBLE AS x1, (p_partkey % 7) * 90.0::DOUBLE + 8.0::DOUBLE * (length(p_name) % 9 + 1) AS x2 FROM part),
  s AS (SELECT *, greatest(1.0, max(x2) OVER (PARTITION BY page) - min(x1) OVER (PARTITION BY page)) AS w FROM t),
  n AS (SELECT * FROM (SELECT *, bool_or(x2 - x1 <= 0.45 * w) OVER (PARTITION BY page) AS narrow FROM s) WHERE x2 - x1 <= 0.45 * w OR NOT narrow),
  f AS (SELECT *, CASE WHEN x1 <= max(x2) OVER (PARTITION BY page ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 18.0 THEN 0 ELSE 1 END AS fresh FROM n),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY x1, x2) - 1 AS band FROM f)
  SELECT page, CAST(band AS INT) AS band, CAST(min(x1) AS DOUBLE) AS start_x, CAST(max(x2) AS DOUBLE) AS end_x FROM g GROUP BY ALL""")
def column_bands(spark, sf):
    return tables.column_bands(part_tokens(spark, sf, "p_size"), ("page",)).select("page", "band", F.col("start").alias("start_x"), F.col("end").alias("end_x"))


@query("""SELECT p_partkey, 0 AS row_no, 0 AS col_no, 'Name' AS text FROM part UNION ALL SELECT p_partkey, 0, 1, p_name FROM part
  UNION ALL SELECT p_partkey, 1, 0, 'Size' FROM part UNION ALL SELECT p_partkey, 1, 1, CAST(p_size AS VARCHAR) || ' cm' FROM part""")
def cluster_table(spark, sf):
    c = F.col
    place = lambda n, text, x, y, w: F.struct(F.lit(n).alias("tok"), text.alias("text"), F.lit(float(x)).alias("x1"), F.lit(float(y)).alias("y1"), F.lit(float(x + w)).alias("x2"), F.lit(float(y + 20)).alias("y2"))
    tokens = [place(0, F.lit("Name"), 0, 0, 40), place(1, c("p_name"), 200, 2, 150), place(2, F.lit("Size"), 2, 40, 40), place(3, c("p_size").cast("string"), 202, 41, 20), place(4, F.lit("cm"), 230, 41, 20)]
    df = table(spark, sf, "part").select("p_partkey", F.inline(F.array(*tokens)))
    built = tables.build(df, ("p_partkey",)).select("p_partkey", F.inline("cells"))
    return built.select("p_partkey", F.col("row").alias("row_no"), F.col("col").alias("col_no"), "text")


@query("SELECT doc_id, ln, line FROM (SELECT doc_id, unnest(range(len(l))) AS ln, unnest(l) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))")
def token_lines(spark, sf):
    """Lines of the tokens that the lines of a text stand for."""
    found = tables.lines_of(tokens_of_text(table(spark, sf, "documents")))
    return found.select("doc_id", F.col("ln").cast("long").alias("ln"), F.col("text").alias("line"))


@query("""WITH t AS (SELECT p_size AS page, p_partkey AS tok, CAST(p_partkey % 40 AS DOUBLE) AS x1, CAST(p_partkey % 40 + 10 AS DOUBLE) AS x2 FROM part),
  c AS (SELECT s AS page, k AS ord, 12.0 * k AS x1, 12.0 * k + 12 AS x2 FROM (SELECT DISTINCT p_size AS s FROM part), (SELECT unnest(range(4)) AS k)),
  h AS (SELECT t.page, tok, ord, (least(t.x2, c.x2) - greatest(t.x1, c.x1)) * 10 / 100 AS score FROM t JOIN c ON t.page = c.page AND least(t.x2, c.x2) > greatest(t.x1, c.x1))
  SELECT page, tok, CAST(ord AS INT) AS cell FROM (SELECT *, row_number() OVER (PARTITION BY page, tok ORDER BY score DESC, ord) AS n FROM h) WHERE n = 1 AND score >= 0.3""")
def spatial_assign(spark, sf):
    part = table(spark, sf, "part")
    x = (F.col("p_partkey") % 40).cast("double")
    zero, ten = F.lit(0.0), F.lit(10.0)
    tokens = part.select(F.col("p_size").alias("page"), F.col("p_partkey").alias("tok"), x.alias("x1"), zero.alias("y1"), (x + 10).alias("x2"), ten.alias("y2"))
    cells = part.select(F.col("p_size").alias("page")).distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    cells = cells.select("page", "ord", (F.col("ord") * 12.0).alias("x1"), zero.alias("y1"), (F.col("ord") * 12.0 + 12).alias("x2"), ten.alias("y2"))
    return tables.assign_tokens(tokens, cells, "page").select("page", "tok", F.col("ord").alias("cell"))


@query("""WITH b AS (SELECT p_partkey, CAST(p_partkey % 13 AS DOUBLE) AS x1, CAST(p_partkey % 13 + p_size AS DOUBLE) AS x2, CAST(p_size AS DOUBLE) AS h FROM part),
  i AS (SELECT *, greatest(0, least(x2, 20.0) - greatest(x1, 5.0)) * greatest(0, least(h, 12.0) - 2.0) AS both_area, (x2 - x1) * h AS own FROM b)
  SELECT p_partkey, round(both_area / own, 9) AS share, round(both_area / (own + 150.0 - both_area), 9) AS iou, round(greatest(0, least(h, 12.0) - 2.0) / least(h, 10.0), 9) AS height_share,
  (x1 + x2) / 2 BETWEEN 5 AND 20 AND h / 2 BETWEEN 2 AND 12 AS inside FROM i""")
def geometry(spark, sf):
    x, size = F.col("p_partkey") % 13, F.col("p_size")
    own, other = G.box(x + size, size, x, F.lit(0)), G.box(F.lit(5), F.lit(2), F.lit(20), F.lit(12))
    return table(spark, sf, "part").select(
        "p_partkey", F.round(G.overlap_ratio(own, other), 9).alias("share"), F.round(G.iou(own, other), 9).alias("iou"), F.round(G.vertical_overlap(own, other), 9).alias("height_share"), G.holds_center(other, own).alias("inside")
    )


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN '0,1,2' ELSE array_to_string(list_filter([n_nationkey, n_nationkey + 2, n_nationkey + 1], lambda x: x < 26), ',') END AS pages FROM nation""")
def page_selection_specs(spark, sf):
    key = F.col("n_nationkey")
    spec = F.when(key % 5 == 4, F.lit(" abc ,99")).otherwise(text_of(key + 1, ",", key + 3, "-", key + 3, ",x,", key + 3, "-", key + 2, ",", key + 1))
    count = F.when(key % 5 == 4, 3).otherwise(26)
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(page_selection(spec, count), ",").alias("pages"))


@query("""SELECT n_nationkey, k AS ord, [0, 0, 1, 1, 2][k + 1] AS row_no, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS col_no,
  CASE WHEN k = 0 THEN 2 ELSE 1 END AS row_span, CASE WHEN k = 1 THEN n_nationkey % 3 + 1 ELSE 1 END AS col_span FROM nation, (SELECT CAST(unnest(range(5)) AS INT) AS k)""")
def html_grid(spark, sf):
    html = text_of("<table><tr><th rowspan=2>", F.col("n_name"), "</th><td colspan='", F.col("n_nationkey") % 3 + 1, "'>a</td></tr><tr><td rowspan='x'>b<td>c</tr><tr><td>d</table>")
    found = table(spark, sf, "nation").select("n_nationkey", F.posexplode(html_table.table_positions(html)).alias("ord", "p"))
    return found.select("n_nationkey", "ord", F.col("p.row").alias("row_no"), F.col("p.col").alias("col_no"), F.col("p.row_span").alias("row_span"), F.col("p.col_span").alias("col_span"))


@query("""SELECT r_regionkey, CAST(r * 2 + c AS INT) AS place, CASE WHEN r < 2 AND c = 0 THEN r_name WHEN r = 0 AND c = 1 THEN 'b' WHEN r = 1 AND c = 1 THEN 'c' ELSE NULL END AS text
  FROM region, (SELECT unnest(range(3)) AS r), (SELECT unnest(range(2)) AS c)""")
def merged_cells(spark, sf):
    """Texts by grid place, where the first column's cell covers two rows."""
    cells = F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(s).alias("row_span"), F.lit(1).alias("col_span"), t.alias("text")) for n, (r, c, s, t) in enumerate([(0, 0, 2, F.col("r_name")), (0, 1, 1, F.lit("b")), (1, 1, 1, F.lit("c"))])])
    region = table(spark, sf, "region")
    places = region.select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p")).select("r_regionkey", F.floor(F.col("p") / 2).cast("int").alias("row"), (F.col("p") % 2).cast("int").alias("col"))
    found = html_table.cell_at(region.select("r_regionkey", F.inline(cells)), places, "r_regionkey")
    return found.select("r_regionkey", (F.col("row") * 2 + F.col("col")).cast("int").alias("place"), "text")


@query("""SELECT p_partkey, psm, n_tokens FROM (SELECT p_partkey, psm, n_tokens, row_number() OVER (PARTITION BY p_partkey ORDER BY n_tokens DESC, conf DESC, list_position([4, 11, 6], psm)) AS n
  FROM (SELECT p_partkey, psm, (p_partkey * psm) % 3 AS n_tokens, (p_partkey + psm) % 2 AS conf FROM part, (SELECT unnest([4, 11, 6]) AS psm))) WHERE n = 1""")
def best_psm(spark, sf):
    runs = table(spark, sf, "part").select("p_partkey", F.explode(F.array(F.lit(4), F.lit(11), F.lit(6))).alias("psm"))
    runs = runs.select("p_partkey", "psm", ((F.col("p_partkey") * F.col("psm")) % 3).alias("n_tokens"), ((F.col("p_partkey") + F.col("psm")) % 2).alias("mean_conf"))
    return best_run(runs, ("p_partkey",)).select("p_partkey", "psm", "n_tokens")


@query("""SELECT c_custkey, '{"packageCode": "' || upper('pkg' || c_custkey) || '", "registerFee": ' || CAST(10000000 + (c_custkey * 1000003) % 90000000 AS BIGINT) || '.5, "sms": ' || c_custkey % 500 || ', "cycle": null}' AS json FROM customer""")
def json_output(spark, sf):
    """Fees are beyond 1e7, where a double's own text has an exponent."""
    whole = load_schema()
    schema = Schema(tuple(f for f in whole.fields if f.name in ("packageCode", "registerFee", "sms", "cycle")), whole.settings)
    fee = (F.lit(10000000) + (F.col("c_custkey").cast("long") * 1000003) % 90000000).cast("double") + 0.5
    lines = [card_lines()[0], text_of("Cước đăng ký ", F.format_number(fee, 1)), card_lines()[2], F.lit("hết")]
    cards = table(spark, sf, "customer").select("c_custkey", F.concat_ws("\n", *lines).alias("text"))
    extractor = Extractor(schema)
    return extractor.json(extractor.from_text(cards, keys=("c_custkey",)), "c_custkey")


@query("""SELECT p_partkey, reverse(upper(p_brand)) AS code, CAST(p_size * 2 AS BIGINT) AS twice, 'text_line' AS source FROM part""")
def python_parser(spark, sf):
    """Fields whose parsers are Python callables: they read all candidates of a document in Arrow batches."""
    P.register_python("backwards", lambda text, upper=False: (text.upper() if upper else text)[::-1])
    P.register_python("twice", lambda text: 2 * int(text))
    try:
        fields = [{"name": "code", "parser": "backwards", "parser_args": {"upper": True}, "aliases": ["brand of"]}, {"name": "twice", "type": "int", "parser": "twice", "regex": ["size is\\s(\\d+)"]}]
        schema = schema_of({"fields": fields})
        cards = table(spark, sf, "part").select("p_partkey", text_of("Brand of: ", F.col("p_brand")).alias("text"), text_of("the size is ", F.col("p_size")).alias("more"))
        records = Extractor(schema).from_text(cards.select("p_partkey", "text"), keys=("p_partkey",))
        sizes = Extractor(schema).from_text(cards.select("p_partkey", F.col("more").alias("text")), keys=("p_partkey",))
    finally:
        P.unregister("backwards")
        P.unregister("twice")
    one = R.wide(records, schema, "p_partkey", "fields").select("p_partkey", "code", F.get("fields", F.lit(0))["source"].alias("source"))
    return one.join(R.wide(sizes, schema, "p_partkey").select("p_partkey", "twice"), "p_partkey").select("p_partkey", "code", "twice", "source")


@query("""SELECT p_size AS page, CAST(count(*) FILTER (p_partkey % 5 <> 0) AS BIGINT) AS n_tokens,
  coalesce(round(avg(CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 100) / 100.0 END), 9), 0.0) AS mean_conf FROM part GROUP BY p_size""")
def mean_confidence(spark, sf):
    """Blank tokens don't count."""
    tokens = table(spark, sf, "part").select(F.col("p_size").alias("page"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_name")).alias("text"), ((F.col("p_partkey") % 100) / 100.0).alias("confidence"))
    return tables.mean_confidence(tokens, ("page",)).select("page", "n_tokens", F.round("mean_conf", 9).alias("mean_conf"))


@query("""SELECT p_partkey, p_name || '|b' AS row_0, p_name || '|c' AS row_1, 'b|c' AS col_1 FROM part""")
def table_lines(spark, sf):
    """Rows and columns of a table whose first cell covers two rows."""
    part = lambda r, c, s, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(s).alias("row_span"), F.lit(1).alias("col_span"), t.alias("text"))
    cells = F.array(part(1, 1, 1, F.lit("c")), part(0, 0, 2, F.col("p_name")), part(0, 1, 1, F.lit("b")))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "|")
    df = table(spark, sf, "part").select("p_partkey", cells.alias("cells"))
    return df.select("p_partkey", shown(html_table.row_cells(F.col("cells"), 0)).alias("row_0"), shown(html_table.row_cells(F.col("cells"), 1)).alias("row_1"), shown(html_table.column_cells(F.col("cells"), 1)).alias("col_1"))
