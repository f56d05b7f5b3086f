"""Text expressions: accent folding, labels, digit repair. All are native columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Python's str.strip beyond what Java's (?U)\s has, and strip sets.
SPACE = r"[\s\x{1c}-\x{1f}]"
LABEL_SEPARATORS = ":-–—|="
VALUE_STRIP = " \t\r\n:;.-–—|"
#: What recognisers take digits for.
DIGIT_LOOKALIKES = {"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "|": "1", "!": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "b": "6"}
RULES = "|!"
#: Where Python's str.splitlines cuts.
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Hangul syllables and how many of them share a leading letter.
HANGUL, PER_LEAD = (0xAC00, 0xD7A3), 588


def let(col: Column, body: Callable[[Column], Column]) -> Column:
    """body of a column that is computed once, however often body uses it.

    Columns are trees: without this, each use repeats everything below it.
    """
    return F.get(F.transform(F.array(col), lambda x: body(x)), F.lit(0))


@cache
def fold_tables() -> tuple[str, str]:
    """(from, to): every accented character but Hangul, and its base letter."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for code in range(0x80, 0x30000):  # no character beyond these planes has a decomposition
        char = chr(code)
        if HANGUL[0] <= code <= HANGUL[1] or 0xD800 <= code <= 0xDFFF or char in "đĐ":
            continue
        base = [c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c)]
        if base and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


@cache
def _fold_map() -> dict[int, str]:
    source, target = fold_tables()
    hangul = {code: hangul_leads()[(code - HANGUL[0]) // PER_LEAD] for code in range(HANGUL[0], HANGUL[1] + 1)}
    return dict(zip(map(ord, source), target, strict=True)) | hangul


@cache
def hangul_leads() -> str:
    """The leading letters of the syllables, in order."""
    return "".join(unicodedata.normalize("NFD", chr(code))[0] for code in range(HANGUL[0], HANGUL[1] + 1, PER_LEAD))


def fold_text(text: str) -> str:
    """As ``fold_accents``, for plan-time strings."""
    return text.translate(_fold_map())


def fold_accents(col: Column) -> Column:
    """Base letters for accented ones; never changes the number of characters.

    A Hangul syllable becomes its leading letter, which is reckoned from its code point.
    """
    first, last = map(chr, HANGUL)
    lead = lambda c: F.substring(F.lit(hangul_leads()), F.floor((F.ascii(c) - HANGUL[0]) / PER_LEAD).cast("int") + 1, F.lit(1))
    without = lambda c: F.concat_ws("", F.transform(F.split(c, ""), lambda x: F.when(x.between(first, last), lead(x)).otherwise(x)))
    return let(F.translate(col, *fold_tables()), lambda c: F.when(c.rlike(f"[{first}-{last}]"), without(c)).otherwise(c))


def folded(col: Column) -> Column:
    return F.lower(fold_accents(col))


def strip(col: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def strip_of(col: Column, chars: str) -> Column:
    return strip(F.btrim(strip(col), F.lit(chars)))


def normalize_label(col: Column) -> Column:
    """Lower-case letters, digits and + only, single spaces between."""
    return F.trim(F.regexp_replace(folded(col), "[^a-z0-9+]+", " "))


def label_text(text: str) -> str:
    return " ".join(re.sub("[^a-z0-9+]+", " ", fold_text(text).lower()).split())


def coerce_text(col: Column, kind: str = "string") -> Column:
    """Any value as stripped text: null and booleans are empty, lists are joined by spaces."""
    if kind == "boolean":
        return F.lit("")
    if kind.startswith("array"):
        return strip(F.coalesce(F.concat_ws(" ", col), F.lit("")))
    return strip(F.coalesce(col.cast("string"), F.lit("")))


def fix_ocr_digits(col: Column) -> Column:
    """Turn look-alikes into digits where digits stand around them.

    A run without white space that has a digit, and else only separators and look-alikes, is
    turned whole; in other runs a look-alike needs a digit beside it. Rules of a table
    (| and !) need a digit or separator on both sides, one of them a digit. Neighbours are
    those of the text as given.
    """
    return let(col, _fix_digits)


def _fix_digits(col: Column) -> Column:
    keys = re.escape("".join(DIGIT_LOOKALIKES)).replace("]", r"\]")
    lookalikes = "".join(DIGIT_LOOKALIKES), "".join(DIGIT_LOOKALIKES.values())
    digit = lambda c: F.coalesce(c.rlike(r"(?U)^\d$"), F.lit(False))
    near = lambda c: digit(c) | F.coalesce(c.isin(".", ","), F.lit(False))

    def fix(run: Column) -> Column:
        whole = run.rlike(rf"(?U)^[\d.,{keys}]+\z") & run.rlike(r"(?U)\d")
        return let(F.struct(F.split(run, "").alias("chars"), whole.alias("whole")), lambda r: F.concat_ws("", F.transform(r["chars"], one_of(r))))

    def one_of(run: Column) -> Callable[[Column, Column], Column]:
        def one(char: Column, i: Column) -> Column:
            before, after = F.get(run["chars"], i - 1), F.get(run["chars"], i + 1)
            rule = near(before) & near(after) & (digit(before) | digit(after))
            turn = F.when(char.isin(*RULES), rule).otherwise(run["whole"] | digit(before) | digit(after))
            return F.when(char.isin(*DIGIT_LOOKALIKES) & turn, F.translate(char, *lookalikes)).otherwise(char)

        return one

    runs = F.regexp_extract_all(col, F.lit(rf"(?U){SPACE}+|[^\s\x{{1c}}-\x{{1f}}]+"), F.lit(0))
    has = rf"[{keys}]"
    fixed = F.concat_ws("", F.transform(runs, lambda r: F.when(r.rlike(has), fix(r)).otherwise(r)))
    return F.when(col.rlike(has) & col.rlike(r"(?U)\d"), fixed).otherwise(col)


def after_keyword(col: Column, keyword: str | None) -> Column:
    """What stands behind the keyword (accents and case ignored), or the whole text without it."""
    if not keyword:
        return col
    key = fold_text(keyword).lower()
    found = F.struct(col.alias("text"), F.instr(folded(col), key).alias("at"))
    return let(found, lambda f: F.when(f["at"] > 0, F.substring(f["text"], f["at"] + len(key), F.length(f["text"]))).otherwise(f["text"]))


def has_keyword(col: Column, keyword: str) -> Column:
    return F.instr(folded(col), fold_text(keyword).lower()) > 0


def remainder_after(col: Column, alias: Column) -> Column:
    """The text behind an alias that is folded and lower-cased already; empty where it isn't found."""

    def rest(f: Column) -> Column:
        tail = strip(F.substring(f["text"], f["at"] + f["size"], F.length(f["text"])))
        tail = strip(F.regexp_replace(tail, "^[" + re.escape(LABEL_SEPARATORS) + "]+", ""))
        return F.when((f["at"] > 0) & (f["size"] > 0), tail).otherwise(F.lit(""))

    found = let(F.struct(col.alias("text"), alias.alias("alias")), lambda x: F.struct(x["text"].alias("text"), F.length(x["alias"]).alias("size"), F.instr(folded(x["text"]), x["alias"]).alias("at")))
    return let(found, rest)


def boundary_pattern(own: list[str], others: list[str], least: int = 5) -> str | None:
    """One pattern for all labels of other fields, as whole words of folded text; null without any."""
    mine = {fold_text(a).lower() for a in own}
    labels = {fold_text(a).lower().strip() for a in others}
    labels = sorted((a for a in labels if len(a) >= least and a not in mine), key=lambda a: (-len(a), a))
    if not labels:
        return None
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(map(java_quote, labels)) + r")(?![\p{L}\p{N}])"


def java_quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", text)


def cut_at_label(col: Column, pattern: str | None) -> Column:
    """The value up to the first label of another field; untouched where none stands in it."""
    if pattern is None:
        return col
    found = let(col, lambda c: F.struct(c.alias("text"), F.regexp_instr(folded(c), F.lit(pattern)).alias("at")))
    return let(found, lambda f: F.when(f["at"] > 0, strip_of(F.substring(f["text"], F.lit(1), f["at"] - 1), LABEL_SEPARATORS)).otherwise(f["text"]))


def split_lines(col: Column) -> Column:
    """Non-blank lines, stripped, cut where Python's str.splitlines does."""
    lines = F.split(F.coalesce(col, F.lit("")), LINE_END)
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def shown_number(col: Column) -> Column:
    """A double as Python and JSON print it: digits without an exponent from 1e-4 up to 1e16."""

    def shown(text: Column) -> Column:
        size = F.abs(text.cast("double"))
        plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"0+\z", ""), r"\.\z", ".0")
        sign, power = F.when(text.contains("E-"), F.lit("e-")).otherwise(F.lit("e+")), F.regexp_extract(text, r"E-?(\d+)\z", 1)
        digits = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0\z", "")
        far = F.concat(digits, sign, F.when(F.length(power) < 2, F.lit("0")).otherwise(F.lit("")), power)
        return F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(far)

    return let(col.cast("string"), shown)
