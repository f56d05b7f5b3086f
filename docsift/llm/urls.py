"""URL rules with decisions that spread over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import let
from docsift.llm.components import connected_components
from docsift.llm.shared import drop_table, materialize

#: (verdict, rule); a rule is a host and a path: what stands before and from its first slash.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TAG = r"(?is)<(?:link|meta|base)\b[^>]*>"
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)\bcontent\s*=\s*["'][^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""

#: Comments, and elements whose text is no markup; one that isn't closed reaches to the end.
_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|template|noframes)\b.*?(?:</\1\b|\z)"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path. Null url or one without ``://``: both empty."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return df.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def matched_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits host and path, or null.

    Of rules as long, the one that comes first by text wins; allow goes before block for
    the same text. The rules are literals, so this is one projection without a join.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]], r[0] == "allow")):
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        out = F.when(fits & F.col("path").startswith(slash + path), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): page url to each canonical-link target and each meta-refresh target in its html.

    Targets are resolved against the page's url or its base element, fragments are cut.
    Targets of other schemes without ``//`` are no pages. Tags in comments, scripts and other
    text that is no markup don't count. Null urls or html give none.
    """
    linked = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b"))  # few pages; only these are taken apart
    bare = F.regexp_replace("html", _NO_MARKUP, " ")
    all_tags = linked.select("url", F.regexp_extract_all(bare, F.lit(_TAG), F.lit(0)).alias("tags")).where("size(tags) > 0")
    bases = F.filter("tags", lambda t: t.rlike(r"(?i)^<base\b") & (F.regexp_extract(t, _HREF, 1) != ""))
    tags = all_tags.select("url", F.regexp_extract(F.get(bases, F.lit(0)), _HREF, 1).alias("base"), F.explode("tags").alias("tag"))
    kind = F.lower("tag")
    canonical = F.when(kind.rlike(r"""^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), F.regexp_extract("tag", _HREF, 1))
    refresh = F.when(kind.rlike(r"""\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", _REFRESH, 1))
    to = F.coalesce(canonical, refresh)
    found = tags.select("url", plain("base").alias("base"), plain(to).alias("to")).where("to <> ''")
    based = found.select("url", "to", F.coalesce(F.when(F.col("base") != "", resolved(F.col("url"), F.col("base"))), "url").alias("base"))
    return based.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("base"), F.col("to"))).alias("b")).where("b IS NOT NULL")


def plain(href: Column | str) -> Column:
    return F.replace(href, F.lit("&amp;"), F.lit("&"))


def resolved(base: Column, to: Column) -> Column:
    """The url that a link ``to`` on a page at ``base`` leads to; null if it is of a scheme without ``//``."""
    parts = let(base, lambda b: let(F.regexp_extract(b, _SCHEME + "//[^/?#]*", 0), lambda site: F.struct(
        b.alias("base"),
        site.alias("site"),
        F.regexp_extract(F.substring(b, F.length(site) + 1, F.length(b)), r"^[^?#]*", 0).alias("path"),
    )))
    return let(to, lambda t: let(parts, lambda p: _resolved(p["base"], p["site"], p["path"], t)))


def _resolved(base: Column, site: Column, path: Column, to: Column) -> Column:
    folder = F.concat(F.lit("/"), F.substring(F.regexp_extract(path, r"(?s)^.*/", 0), 2, 1 << 30))
    return (
        F.when(to.rlike(_SCHEME + "//"), to)
        .when(to.rlike(_SCHEME) | (site == ""), F.lit(None))
        .when(to.startswith("//"), F.concat(F.regexp_extract(site, _SCHEME, 0), to))
        .when(to.startswith("#"), base)
        .when(to.startswith("?"), F.concat(site, F.when(path == "", "/").otherwise(path), to))
        .otherwise(F.concat(site, without_dots(F.when(to.startswith("/"), to).otherwise(F.concat(folder, to)))))
    )


def without_dots(target: Column) -> Column:
    """A path from ``/`` on, with query and fragment or without, with its ``.`` and ``..`` steps taken."""

    def after(steps: Column) -> Column:
        return F.aggregate(
            steps,
            F.array().cast("array<string>"),
            lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
            lambda done: F.concat_ws("/", done, F.when(F.element_at(steps, -1).isin(".", ".."), "")),
        )

    def clean(x: Column) -> Column:
        return let(F.regexp_extract(x, r"^[^?#]*", 0), lambda path: F.concat(let(F.split(path, "/"), after), F.substring(x, F.length(path) + 1, F.length(x))))

    return let(target, clean)


def node_of(url: Column) -> Column:
    """The url without fragment, scheme and host in lower case (ASCII letters, as in ``with_parts``)."""

    def lowered(x: Column) -> Column:
        bare = F.regexp_extract(x, _SCHEME + r"//[^/?#@]*(?=[/?#]|$)", 0)  # scheme and host, if no user name is between them
        scheme, user = F.regexp_extract(x, _SCHEME + "//", 0), F.regexp_extract(x, _SCHEME + r"//([^/?#]*@)", 1)
        head = F.when(bare != "", F.translate(bare, UPPER, LOWER)).otherwise(
            F.concat(F.translate(scheme, UPPER, LOWER), user, F.translate(F.regexp_extract(x, _SCHEME + r"//[^/?#]*@([^/?#]*)", 1), UPPER, LOWER))
        )
        return let(head, lambda h: F.concat(h, F.substring(x, F.length(h) + 1, F.length(x))))

    return let(F.substring_index(url, "#", 1), lowered)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, by_alias.

    A url with a rule keeps its rule's verdict. A url without one takes its component's:
    components are of urls (as by ``node_of``) under canonical links, meta refreshes and
    ``redirects(a, b)``. An explicit allow on any member outranks the blocks there, else one
    explicit block blocks every alias; without either it is allowed. by_alias tells that
    the verdict came that way. Null or malformed urls have empty parts and are allowed;
    repeated rows are judged each; an empty table gives no rows; link targets that are no
    page take part with the rule that fits them.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    judged = with_parts(pages.select("page_id", "url")).withColumn("own", matched_rule(rules)).withColumn("node", node_of(F.col("url")))
    parts = connected_components(edges)
    said = with_parts(parts.withColumnRenamed("node", "url")).withColumn("own", matched_rule(rules))
    of_root = said.groupBy("root").agg(
        F.max(F.when(F.col("own.verdict") == "allow", 2).when(F.col("own.verdict") == "block", 1)).alias("said")
    )
    blocked = materialize(of_root.where("said = 1"), "url-roots")  # both sides plain tables: AQE can split a hot root
    spread = materialize(parts.join(blocked, "root").select("node", "said"), "url-blocked")
    drop_table(blocked)
    out = judged.join(spread, "node", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("said") == 1, "block"), F.lit("allow")).alias("verdict"),
        (F.col("own").isNull() & F.col("said").isNotNull()).alias("by_alias"),
    )
