"""Field parsers as expression builders: text column in, value struct out.

A value is struct<i: bigint, d: double, s: string, a: array<string>> with one member set,
or null. Arguments are checked when the plan is built: an unknown argument makes the
value null for every row, as does an invalid pattern.
"""

from __future__ import annotations

import inspect
import logging
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docsift.functions.text import SPACE, VALUE_STRIP, after_keyword, fix_ocr_digits, fold_text, folded, has_keyword, java_quote, let, strip, strip_of

log = logging.getLogger(__name__)
VALUE = "struct<i:bigint,d:double,s:string,a:array<string>>"
# Fixed values.
NUMBER = r"[-+]?\d[\d\s.,]*\d|[-+]?\d"
CYCLES = ("tháng", "ngày", "tuần", "quý", "năm")
CYCLE_PREFIXES = ("chu kỳ", "chu ky", "cycle", "gia hạn", "gia han")
LIST_STRIP = " \t\r\n.;:|-–—"
LIST_SEPARATORS = (",", ";", "\n", "/", "|")

Builder = Callable[..., Column]
REGISTRY: dict[str, Builder] = {}
#: Parsers that are Python callables; their builders can't stand in a lambda of a column.
PYTHON: dict[str, Callable] = {}
_CHANGES: list[str] = []


def null_value() -> Column:
    return F.lit(None).cast(VALUE)


def value_of(i: Column | None = None, d: Column | None = None, s: Column | None = None, a: Column | None = None) -> Column:
    """The value struct of the member that isn't null; null if all are."""
    parts = {"i": (i, "bigint"), "d": (d, "double"), "s": (s, "string"), "a": (a, "array<string>")}
    columns = {k: (F.lit(None).cast(t) if c is None else c.cast(t)) for k, (c, t) in parts.items()}
    return F.when(F.greatest(*[c.isNotNull() for c in columns.values()]), F.struct(*[c.alias(k) for k, c in columns.items()]))


def registry_version() -> int:
    """Grows with every change of the registry, so that plans built before it aren't used after."""
    return len(_CHANGES)


def register(name: str) -> Callable[[Builder], Builder]:
    """Add an expression builder (text column, keyword arguments) by name; the last one of a name wins."""

    def add(builder: Builder) -> Builder:
        if name in REGISTRY:
            log.warning("parser %s is replaced", name)
        REGISTRY[name] = builder
        PYTHON.pop(name, None)
        _CHANGES.append(name)
        return builder

    return add


def register_python(name: str, parse: Callable) -> None:
    """Add a Python callable (text, keyword arguments) as a parser: it may return a string, a number or a list.

    A null text, and one that the callable fails on, has no value. It runs in Arrow batches.
    """

    def builder(col: Column, **args) -> Column:
        one = _value(parse, args)

        @pandas_udf(f"array<{VALUE}>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda x: [one(x)])

        return F.get(run(col), F.lit(0))

    builder.__signature__ = inspect.signature(parse)
    register(name)(builder)
    PYTHON[name] = parse


def unregister(name: str) -> None:
    REGISTRY.pop(name, None)
    PYTHON.pop(name, None)
    _CHANGES.append(name)


def _value(parse: Callable, args: dict) -> Callable[[str | None], dict | None]:
    """What gives a text's VALUE by a Python callable."""

    def member(x) -> dict | None:
        if x is None or isinstance(x, float) and x != x:
            return None
        if isinstance(x, (list, tuple)):
            found = {"a": [str(v) for v in x]}
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            found = {"i": int(x)} if abs(x) < 2**63 and x == int(x) else {"d": float(x)}
        else:
            found = {"s": str(x)}
        return {"i": None, "d": None, "s": None, "a": None} | found

    def one(x: str | None) -> dict | None:
        try:
            return None if x is None else member(parse(x, **args))
        except Exception:  # noqa: BLE001  a parser never fails a document
            return None

    return one


def available() -> list[str]:
    return sorted(REGISTRY)


def _known(name: str, args: dict) -> str | None:
    """The parser that a name means (text_parser if unknown); null if it lacks one of the arguments."""
    if name not in REGISTRY:
        log.warning("unknown parser %s, text_parser is used", name)
        name = "text_parser"
    given = inspect.signature(REGISTRY[name]).parameters
    known = list(given)[1:]
    if any(a not in known for a in args) and not any(p.kind is p.VAR_KEYWORD for p in given.values()):
        log.warning("parser %s has no argument %s: its values are null", name, sorted(set(args) - set(known)))
        return None
    return name


def parse(name: str, col: Column, args: dict | None = None) -> Column:
    """The value of a text column by a parser; an unknown name means text_parser."""
    found = _known(name, args or {})
    return null_value() if found is None else REGISTRY[found](col, **(args or {}))


def python_values(name: str, args: dict | None = None) -> Callable[[str | None], dict | None]:
    """What gives a text's VALUE by a registered Python callable, for use in a worker."""
    return _value(PYTHON[name], args or {}) if _known(name, args or {}) else lambda _: None


def parse_many(jobs: Sequence[tuple[str, str, Column, dict]]) -> list[Column]:
    """Value columns named by field for (field, parser, text column, arguments)."""
    return [parse(name, col, args).alias(field) for field, name, col, args in jobs]


def number_of(found: Column) -> Column:
    """struct(i bigint, d double) of a number string without white space; one is null, or both.

    With both separators the last one is the decimal sign; with one kind only, all are
    thousands if every group behind one has three characters, else the last is decimal.
    """
    last = r"^(.*)[.,]([^.,]*)\z"

    def cleaned(x: Column) -> Column:
        clean = F.btrim(F.regexp_replace(x, "^[-+]+", ""), F.lit(".,"))
        return F.struct(clean.alias("text"), F.when(x.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).alias("sign"))

    def parted(x: Column) -> Column:
        text = x["text"]
        both = text.contains(".") & text.contains(",")
        decimal = text.rlike("[.,]") & (both | ~text.rlike(r"^[^.,]*([.,][^.,]{3})+\z"))
        whole = F.regexp_replace(F.when(decimal, F.regexp_extract(text, last, 1)).otherwise(text), "[.,]", "")
        rest = F.when(decimal, F.regexp_replace(F.regexp_extract(text, last, 2), "[^0-9]", "")).otherwise(F.lit(""))
        return F.struct(F.coalesce(F.nullif(whole, F.lit("")), F.lit("0")).alias("whole"), rest.alias("rest"), text.rlike(r"(?U)\d").alias("ok"), x["sign"].alias("sign"))

    def valued(x: Column) -> Column:
        exact = x["ok"] & x["rest"].rlike(r"^0*\z")
        i = F.when(exact, x["sign"] * x["whole"].try_cast("bigint"))
        d = F.when(x["ok"] & ~exact, x["sign"] * F.concat(x["whole"], F.lit("."), x["rest"]).try_cast("double"))
        return F.struct(i.cast("bigint").alias("i"), d.cast("double").alias("d"))

    return let(let(let(found, cleaned), parted), valued)


def _guarded(number: Column, least: float | None, most: float | None) -> Column:
    """The value of struct(i, d) within the bounds."""

    def keep(n: Column) -> Column:
        size = F.coalesce(n["i"].cast("double"), n["d"])
        ok = size.isNotNull()
        ok = ok & (size >= least) if least is not None else ok
        ok = ok & (size <= most) if most is not None else ok
        return F.when(ok, value_of(i=n["i"], d=n["d"]))

    return let(number, keep)


def _number(col: Column, keyword: str | None, occurrence: int, fix_ocr: bool) -> Column:
    if occurrence < 0:
        raise ValueError("occurrence counts from 0")
    text = after_keyword(strip(col), keyword)
    text = fix_ocr_digits(text) if fix_ocr else text
    found = F.get(F.regexp_extract_all(text, F.lit(f"(?U){NUMBER}"), F.lit(0)), F.lit(occurrence))
    return number_of(F.regexp_replace(found, f"(?U){SPACE}+", ""))


@register("money_parser")
def money_parser(col: Column, keyword: str | None = None, occurrence: int = 0, fix_ocr: bool = True, min_value: float | None = None, max_value: float | None = None) -> Column:
    return _guarded(_number(col, keyword, occurrence, fix_ocr), min_value, max_value)


@register("int_parser")
def int_parser(col: Column, keyword: str | None = None, occurrence: int = 0, fix_ocr: bool = True, min_value: int | None = None, max_value: int | None = None) -> Column:
    """Halves go to the even neighbour."""
    rounded = lambda n: F.struct(F.coalesce(n["i"], F.bround(n["d"], 0).try_cast("bigint")).alias("i"), F.lit(None).cast("double").alias("d"))
    return _guarded(let(_number(col, keyword, occurrence, fix_ocr), rounded), min_value, max_value)


@register("gb_parser")
def gb_parser(col: Column, keyword: str | None = None, unit_pattern: str = r"g\s?b", fallback_to_number: bool = True, require_keyword: bool = False, fix_ocr: bool = True) -> Column:
    """The first amount with the unit behind it, else the first number where that is allowed."""
    text = strip(col)

    def amount(scope: Column) -> Column:
        found = F.nullif(F.regexp_extract(scope, rf"(?iU)([-+]?\d[\d\s.,]*\d|\d)\s*{unit_pattern}", 1), F.lit(""))
        if fallback_to_number:
            found = F.coalesce(found, F.get(F.regexp_extract_all(scope, F.lit(f"(?U){NUMBER}"), F.lit(0)), F.lit(0)))
        return F.regexp_replace(found, f"(?U){SPACE}+", "")

    scope = after_keyword(text, keyword)
    value = _guarded(number_of(let(fix_ocr_digits(scope) if fix_ocr else scope, amount)), None, None)
    return F.when(has_keyword(text, keyword), value) if keyword and require_keyword else value


def java_pattern(pattern: str, flags: str = "iuU") -> str | None:
    """The pattern with Java flags, or null if Python wouldn't compile it."""
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error as why:
        log.warning("invalid pattern %r: %s", pattern, why)
        return None
    return f"(?{flags}){pattern}"


@register("text_parser")
def text_parser(col: Column, pattern: str | None = None, upper: bool = False, lower: bool = False, strip_chars: str = VALUE_STRIP, max_length: int | None = None, keyword: str | None = None) -> Column:
    text = strip_of(after_keyword(strip(col), keyword), strip_chars)
    if pattern:
        java = java_pattern(pattern)
        if java is None:
            return null_value()
        groups = re.compile(pattern).groups
        text = let(text, lambda t: F.when(t.rlike(java), F.regexp_extract(t, java, 1 if groups else 0)))
    text = strip_of(text, strip_chars)
    if max_length is not None:
        text = let(text, lambda t: F.when(F.length(t) > max_length, strip(F.substring(t, 1, max_length))).otherwise(t))
    text = F.upper(text) if upper else F.lower(text) if lower else text
    return let(text, lambda t: F.when(t != "", value_of(s=t)))


@register("cycle_parser")
def cycle_parser(col: Column, keywords: Sequence[str] | None = None, prefer_after: Sequence[str] | None = None, lower: bool = True) -> Column:
    """The keyword that stands first behind the first prefix that occurs, else anywhere."""
    words, prefixes = list(keywords or CYCLES), list(prefer_after or CYCLE_PREFIXES)

    def first(source: Column) -> Column:
        def hit(flat: Column) -> Column:
            hits = [F.struct(F.instr(flat, fold_text(w).lower()).alias("at"), F.lit(k).alias("k"), F.lit(w.lower() if lower else w).alias("word")) for k, w in enumerate(words)]
            return F.array_min(F.filter(F.array(*hits), lambda h: h["at"] > 0))["word"]

        return let(folded(source), hit)

    def scoped(x: Column) -> Column:
        scope = x["text"]
        for prefix in reversed(prefixes):
            at = F.instr(x["flat"], fold_text(prefix).lower())
            scope = F.when(at > 0, F.substring(x["text"], at + len(prefix), F.length(x["text"]))).otherwise(scope)
        return F.coalesce(first(scope), first(x["text"]))

    both = let(strip(col), lambda t: F.struct(t.alias("text"), folded(t).alias("flat")))
    return let(let(both, scoped), lambda w: F.when(w.isNotNull(), value_of(s=w)))


@register("list_parser")
def list_parser(col: Column, separators: Sequence[str] | None = None, strip_chars: str = LIST_STRIP, min_item_length: int = 1, max_items: int | None = None, keyword: str | None = None, unique: bool = True) -> Column:
    text = after_keyword(strip(col), keyword)
    cuts = [s for s in (separators or LIST_SEPARATORS) if s]
    parts = F.split(text, "|".join(map(java_quote, cuts))) if cuts else F.array(text)
    items = F.filter(F.transform(parts, lambda p: strip_of(p, strip_chars)), lambda p: F.length(p) >= max(1, min_item_length))
    items = F.array_distinct(items) if unique else items
    items = F.slice(items, 1, max(1, max_items)) if max_items is not None else items
    return let(items, lambda x: F.when(F.size(x) > 0, value_of(a=x)))


@register("raw_parser")
def raw_parser(col: Column) -> Column:
    return let(strip(col), lambda t: F.when(t != "", value_of(s=t)))
