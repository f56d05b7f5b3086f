"""Parsers and text functions against values that the tests make and know."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.functions import geometry as G
from docsift.functions import parsers as P
from docsift.functions import text as T

WORDS = ("fjord", "kelp", "mango", "quartz", "tundra", "walnut", "yacht")


def values(spark, build, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r["v"] for r in df.select("i", build(F.col("x")).alias("v")).orderBy("i").collect()]


def plain(v):
    return None if v is None else next((x for x in v if x is not None), None)


def parsed(spark, name, texts, **args):
    return [plain(v) for v in values(spark, lambda c: P.parse(name, c, args), texts)]


def grouped(digits, mark):
    """Digits in groups of three from the right."""
    head = len(digits) % 3
    return mark.join(([digits[:head]] if head else []) + [digits[k : k + 3] for k in range(head, len(digits), 3)])


def written(rng, whole, rest, style):
    """A number as people write it. style: us, eu, or none for no groups."""
    dot, comma = {"us": (".", ","), "eu": (",", "."), "none": (".", "")}[style]
    return (grouped(str(whole), comma) if comma else str(whole)) + (dot + rest if rest else "")


def amounts(seed, many=60):
    """(written, value) of numbers whose reading is fixed by their marks: of both kinds, or groups of three only."""
    rng, out = random.Random(seed), []
    for _ in range(many):
        whole = rng.randrange(10 ** rng.randint(4, 11))
        rest = str(rng.randrange(10, 10**4)).rstrip("0") if rng.random() < 0.5 else ""
        if whole < 1000 or (rest and len(rest) == 3):
            rest = ""
        value = float(f"{whole}.{rest}") if rest else whole
        out.append((written(rng, whole, rest, rng.choice(["us", "eu"])), value))
    return out


# Digit repair.


def look_alike(rng, digits, pool="OolISsBZzQDb"):
    """The digits with some replaced by letters that look like them; at least one digit stays."""
    chars = list(digits)
    places = [i for i, c in enumerate(chars) if c.isdigit()]
    for i in rng.sample(places, rng.randrange(len(places))):
        letters = [x for x in pool if T.DIGIT_LOOKALIKES[x] == chars[i]]
        chars[i] = rng.choice(letters) if letters else chars[i]
    return "".join(chars)


def test_look_alikes_within_a_number_are_repaired(spark):
    rng = random.Random(5)
    truth = [written(rng, rng.randrange(10**7), str(rng.randrange(99)), rng.choice(["us", "eu", "none"])) for _ in range(80)]
    assert values(spark, T.fix_ocr_digits, [look_alike(rng, t) for t in truth]) == truth


def test_words_white_space_and_rules_stay(spark):
    rng = random.Random(6)
    clear = [w for w in WORDS if not w[0].isdigit()]
    texts = [f"{rng.choice(clear)}  {rng.randrange(10)}\t{rng.choice(clear)}\n" for _ in range(20)]
    numbers = [str(rng.randrange(100, 10**6)) for _ in range(20)]
    rules = [f(n) for n in numbers for f in ("|{}".format, "{}|".format, "{}!".format, "a|{}".format)]
    assert values(spark, T.fix_ocr_digits, [*texts, *rules, "|", "!!", "So BOld"]) == [*texts, *rules, "|", "!!", "So BOld"]
    inside = [(f"{n}|{n}", f"{n}1{n}") for n in numbers] + [(f"{n}!.{n}", f"{n}1.{n}") for n in numbers]
    assert values(spark, T.fix_ocr_digits, [a for a, _ in inside]) == [b for _, b in inside]


def test_a_look_alike_in_a_word_needs_a_digit_beside_it(spark):
    assert values(spark, T.fix_ocr_digits, ["k7Ox", "kO7x", "kOx7", "hlk9"]) == ["k70x", "k07x", "kOx7", "hlk9"]


# Folding and labels.


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=0x2FFFF, blacklist_categories=("Cs",)), max_size=20))
def test_fold_text_is_the_first_base_letter(text):
    def one(c):
        if c in "đĐ":
            return "d" if c == "đ" else "D"
        base = [b for b in unicodedata.normalize("NFD", c) if not unicodedata.combining(b)]
        return base[0] if base else c

    assert T.fold_text(text) == "".join(map(one, text))


def test_folding_columns_is_folding_text(spark):
    rng = random.Random(7)
    pools = ["ăâđêôơưĂÂĐÊÔƠƯáàảãạ", "ÅÇñüßøİ", "한국어말", chr(0x2F800) + chr(0x1D15E) + "数", "ab +-9"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(12)) for _ in range(60)] + ["", None]
    found = values(spark, T.fold_accents, texts)
    assert found == [None if t is None else T.fold_text(t) for t in texts]
    assert all(len(a) == len(b) for a, b in zip(found, texts, strict=True) if b)


def test_labels_are_words_with_single_spaces(spark):
    rng = random.Random(8)
    cases = []
    for _ in range(20):
        some = rng.sample(WORDS, 3)
        cases.append((rng.choice([" ", "  ("]) + " / ".join(w.title() for w in some) + rng.choice(["", ") ", " :"]), " ".join(some)))
    assert values(spark, T.normalize_label, [a for a, _ in cases]) == [b for _, b in cases]
    assert values(spark, T.normalize_label, ["Quartz++ 2", ""]) == ["quartz++ 2", ""]
    assert [T.label_text(a) for a, _ in cases] == [b for _, b in cases]


def test_any_value_as_text(spark):
    row = spark.sql("SELECT ' kelp ' AS s, 41 AS n, array('kelp', 'mango') AS a, true AS b, cast(null AS string) AS z").select(
        T.coerce_text(F.col("s")).alias("s"), T.coerce_text(F.col("n"), "int").alias("n"), T.coerce_text(F.col("a"), "array<string>").alias("a"), T.coerce_text(F.col("b"), "boolean").alias("b"), T.coerce_text(F.col("z")).alias("z")
    ).first()
    assert tuple(row) == ("kelp", "41", "kelp mango", "", "")


def test_keywords_ignore_accents_and_case(spark):
    text = "Cây Đước: 9 trái; cây bưởi: 4"
    assert values(spark, lambda c: T.after_keyword(c, "cay duoc"), [text, "kelp"]) == [": 9 trái; cây bưởi: 4", "kelp"]
    assert values(spark, lambda c: T.has_keyword(c, "BUOI"), [text, "kelp"]) == [True, False]


def test_numbers_are_shown_without_exponents(spark):
    rng = random.Random(9)
    far = [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 25) for _ in range(300)] + [1e16, 9.9e-5, -2.5e22]
    near = [round(rng.uniform(-1, 1) * 10 ** rng.randint(1, 11), rng.randint(1, 4)) for _ in range(300)] + [1e7, 12345678.5, 1e15, 1e-4, 0.1, 100.0, 0.00025]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(near + far)], "i int, v double")
    found = [r["t"] for r in df.select("i", T.shown_number(F.col("v")).alias("t")).orderBy("i").collect()]
    assert found[: len(near)] == [repr(v) for v in near]
    assert [float(t) for t in found] == near + far and ["e" in t for t in found] == ["e" in repr(v) for v in near + far]


# Number parsers.


def test_amounts_of_both_styles(spark):
    cases = amounts(10)
    rng = random.Random(11)
    around = [(rng.choice(["", "kelp: ", "| ", "đ "]) + t + rng.choice(["", " đ", "|", " VND/kelp"]), v) for t, v in cases]
    assert parsed(spark, "money_parser", [t for t, _ in around]) == [v for _, v in around]
    assert all(isinstance(v, int) == isinstance(w, int) for v, (_, w) in zip(parsed(spark, "money_parser", [t for t, _ in around]), around, strict=True))
    signed = [("-" + t, -v) for t, v in cases]
    assert parsed(spark, "money_parser", [t for t, _ in signed]) == [v for _, v in signed]


def test_one_mark_is_decimal_unless_all_groups_have_three(spark):
    rng, cases = random.Random(12), []
    for _ in range(40):
        whole, mark, size = rng.randrange(1, 999), rng.choice(".,"), rng.choice([1, 2, 4, 5])
        rest = "".join(rng.choice("123456789") for _ in range(size))
        cases.append((f"{whole}{mark}{rest}", float(f"{whole}.{rest}")))
        three = f"{rng.randrange(1000):03d}"
        cases.append((f"{whole}{mark}{three}", int(f"{whole}{three}")))
        cases.append((f"{whole} {three}", int(f"{whole}{three}")))
    assert parsed(spark, "money_parser", [t for t, _ in cases]) == [v for _, v in cases]


def test_misread_amounts(spark):
    rng = random.Random(13)
    cases = [(look_alike(rng, t), v) for t, v in amounts(14, 40)]
    assert parsed(spark, "money_parser", [t for t, _ in cases]) == [v for _, v in cases]
    assert parsed(spark, "money_parser", ["l7.OOO"], fix_ocr=False) == [7]


def test_no_number_and_bounds(spark):
    assert parsed(spark, "money_parser", [*WORDS, "", None, "-,-", "9" * 20]) == [None] * (len(WORDS) + 4)
    rng = random.Random(15)
    numbers = [rng.randrange(-5000, 5000) for _ in range(40)]
    assert parsed(spark, "money_parser", list(map(str, numbers)), min_value=-100, max_value=2500) == [n if -100 <= n <= 2500 else None for n in numbers]
    assert parsed(spark, "int_parser", list(map(str, numbers)), min_value=0) == [n if n >= 0 else None for n in numbers]


def test_which_number_of_several(spark):
    rng, texts, sought = random.Random(16), [], []
    for _ in range(30):
        some = [rng.randrange(100) for _ in range(4)]
        texts.append(" ".join(f"{w} {n}" for w, n in zip(rng.sample(WORDS, 4), some, strict=True)))
        sought.append(some)
    for k in range(4):
        assert parsed(spark, "money_parser", texts, occurrence=k) == [s[k] for s in sought]
    assert parsed(spark, "int_parser", texts, occurrence=4) == [None] * 30
    after = [int(t.split("mango ")[1].split()[0]) if "mango" in t else s[0] for t, s in zip(texts, sought, strict=True)]
    assert parsed(spark, "money_parser", texts, keyword="MANGO") == after


def test_whole_numbers_round_halves_to_even(spark):
    rng = random.Random(17)
    some = [(rng.randrange(500), rng.choice("123456789")) for _ in range(60)]
    assert parsed(spark, "int_parser", [f"kelp {a},{b} mango" for a, b in some]) == [round(float(f"{a}.{b}")) for a, b in some]


def test_volumes(spark):
    rng, texts, first, named = random.Random(18), [], [], []
    for _ in range(30):
        a, b, c = rng.randrange(1, 90), rng.randrange(1, 90), rng.randrange(1, 90)
        texts.append(f"{a} kelp {b}{rng.choice(['GB', ' gb', ' G B', 'Gb'])}/x, Mango: {c}GB")
        first.append(b)
        named.append(c)
    assert parsed(spark, "gb_parser", texts) == first
    assert parsed(spark, "gb_parser", texts, keyword="mango") == named
    assert parsed(spark, "gb_parser", texts, keyword="walnut") == first
    assert parsed(spark, "gb_parser", texts, keyword="walnut", require_keyword=True) == [None] * 30
    bare = [str(n) for n in first]
    assert parsed(spark, "gb_parser", bare) == first and parsed(spark, "gb_parser", bare, fallback_to_number=False) == [None] * 30
    assert parsed(spark, "gb_parser", ["2.25GB", "7 TB", "", None], unit_pattern="[gt]b") == [2.25, 7, None, None]


# Word parsers.


def test_cycles(spark):
    rng, texts, expected = random.Random(19), [], []
    for _ in range(40):
        first, later = rng.sample(P.CYCLES, 2)
        shown = rng.choice([first, first.upper(), T.fold_text(first)])
        head = rng.choice(["", "kelp ", f"{later}; Cycle: ", f"{later}. GIA HAN "])
        texts.append(f"{head}{rng.randrange(9)} {shown} {later}")
        expected.append(first)
    assert parsed(spark, "cycle_parser", texts) == expected
    assert parsed(spark, "cycle_parser", ["Kelp, Mango", "walnut", "", None], keywords=["MANGO", "kelp"], lower=False) == ["kelp", None, None, None]


def test_lists(spark):
    rng, texts, expected = random.Random(20), [], []
    for _ in range(40):
        items = [w + rng.choice(["", "+", "++", " 7"]) for w in rng.sample(WORDS, 4)]
        cut = rng.choice(P.LIST_SEPARATORS)
        texts.append(rng.choice(["", " - "]) + (" " + cut + cut + " ").join([*items, items[0]]) + rng.choice(["", ".", ";"]))
        expected.append(items)
    assert parsed(spark, "list_parser", texts) == expected
    assert parsed(spark, "list_parser", texts, max_items=2) == [e[:2] for e in expected]
    assert parsed(spark, "list_parser", texts, min_item_length=6) == [[x for x in e if len(x) >= 6] or None for e in expected]
    assert parsed(spark, "list_parser", texts, unique=False) == [[*e, e[0]] for e in expected]
    assert parsed(spark, "list_parser", ["kelp: mango, x", ";;", "", None], keyword="kelp") == [["mango", "x"], None, None, None]


def test_texts(spark):
    rng = random.Random(21)
    codes = ["".join(rng.choice("abcxyz789") for _ in range(6)) for _ in range(20)]
    shown = [rng.choice(["", " : ", "- ", "| "]) + c + rng.choice(["", " .", ";", " –"]) for c in codes]
    assert parsed(spark, "text_parser", shown) == codes
    assert parsed(spark, "text_parser", shown, upper=True) == [c.upper() for c in codes]
    assert parsed(spark, "text_parser", shown, max_length=4) == [c[:4] for c in codes]
    assert parsed(spark, "text_parser", [f"kelp no. {c}!" for c in codes], pattern=r"no\. (\w+)") == codes
    assert parsed(spark, "text_parser", [f"Kelp {c}" for c in codes], keyword="kelp") == codes
    assert parsed(spark, "text_parser", ["kelp", ":", "", None], pattern="[0-9]+") == [None] * 4
    assert parsed(spark, "text_parser", ["kelp"], pattern="[") == [None] == parsed(spark, "text_parser", ["kelp"], colour=1)
    assert parsed(spark, "raw_parser", ["  - kelp; ", " \n"]) == ["- kelp;", None]


# The registry.


def test_registry(spark):
    assert P.available() == sorted(P.available()) and "gb_parser" in P.available()
    assert parsed(spark, "parser of no such name", [" - kelp"]) == ["kelp"]
    P.register_python("shout", lambda x, times=1: {"n": len(x), "l": [x] * times, "f": len(x) / 2, "s": x.upper()}[x[0]])
    try:
        assert parsed(spark, "shout", ["nut", "lot", "fog", "sea", "bad", None], times=2) == [3, ["lot", "lot"], 1.5, "SEA", None, None]
        assert parsed(spark, "shout", ["sea"], colour=2) == [None]
    finally:
        P.unregister("shout")
    assert "shout" not in P.available()
    df = spark.createDataFrame([("12 kelp", "7GB")], "a string, b string")
    many = df.select(*P.parse_many([("n", "int_parser", F.col("a"), {}), ("v", "gb_parser", F.col("b"), {}), ("w", "int_parser", F.col("a"), {"min_value": 90})])).first()
    assert (plain(many["n"]), plain(many["v"]), many["w"]) == (12, 7, None)


# Cuts at labels.


def test_values_end_where_another_label_begins(spark):
    rng = random.Random(22)
    labels = ["Giá cây đước", "Loài tảo bẹ", "Walnut"]
    cut = lambda texts: values(spark, lambda c: T.cut_at_label(c, T.boundary_pattern(labels[:1], labels + ["fig"])), texts)
    cases = []
    for _ in range(20):
        value, label = f"{rng.randrange(99)} {rng.choice(WORDS[:5])}", rng.choice([labels[1], T.fold_text(labels[1]).upper(), "walnut"])
        cases += [(f"{value} {label}: 5", value), (f"{value} | {label}", value), (value, value), (f"{value} x{label}x", f"{value} x{label}x"), (f"{value} {labels[0]}", f"{value} {labels[0]}"), (f"{value} fig", f"{value} fig")]
        cases.append((f"{label} 9", ""))
    assert cut([a for a, _ in cases]) == [b for _, b in cases]
    assert T.boundary_pattern(labels, labels) is None and values(spark, lambda c: T.cut_at_label(c, None), ["kelp"]) == ["kelp"]


def test_boxes(spark):
    row = spark.range(1).select(
        G.box(F.lit(5), F.lit(6), F.lit(1), F.lit(2)).alias("b"), G.from_xywh(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("w"),
        G.from_numbers(F.lit([0.0, 0.0, 4.0, 0.0, 4.0, 2.0, 0.0, 2.0])).alias("p"), G.from_numbers(F.lit([1.0])).alias("none"),
    ).first()
    assert tuple(row["b"]) == (1, 2, 5, 6) and tuple(row["w"]) == (1, 2, 4, 6) and tuple(row["p"]) == (0, 0, 4, 2) and row["none"] is None
