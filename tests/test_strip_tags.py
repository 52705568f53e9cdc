"""Markup in submitted text, against a plain loop over the characters."""

import random

import pytest
from pyspark.sql import functions as F

from fareline.functions import text as X

AWKWARD = [
    ("plain", "plain"),
    ("a < b", "a < b"),
    ("a <b", "a "),
    ("a<", "a"),
    ("<>x", "x"),
    ("1 > 0", "1 > 0"),
    ("<b>x</b>y", "xy"),
    ('<a title="x > y">z</a>', "z"),
    ("<a title='x \" > y'>z", "z"),
    ('<a title="never closed>z</a>', ""),
    ("<a <b> c>d", "d"),
    ("<a <b <c> d> e>f", "f"),
    ("x<!-- a > b -- c --->y", "xy"),
    ("x<!-- a --y", "x"),
    ("x<!DOCTYPE html>y", "xy"),
    ("x<?php echo '?>'; (1 > 0) ?>y", "xy"),
    ("x<?php foo(\"(\") ?>y", "xy"),
    ("abc <?xml version='1.0'?>y", "abc y"),
    ("x<! a - > y", "x y"),
    ("<<b>>x", "x"),
    ("< <b>x", "< x"),
    ("a\tb<\nc", "a\tb<\nc"),
    ("漢<i>字</i>🙂<b>", "漢字🙂"),
    ("a\0b<i\0>c", "abc"),
]


def plain(text):
    """The same rules as a loop; the source of truth for made-up texts."""
    text = text.replace("\0", "")
    out, place, depth, quote, last, brackets, xml = [], 0, 0, "", "", 0, False
    for i, c in enumerate(text):
        p1, behind = text[i - 1] if i else "", text[max(0, i - 6) : i]
        if place == 0:
            if c == "<" and not (i + 1 < len(text) and text[i + 1] in " \t\n\x0b\f\r"):
                place, last = 1, c
            else:
                out.append(c)
            continue
        bare = c == "<" and i + 1 < len(text) and text[i + 1] in " \t\n\x0b\f\r"
        if place in (1, 2, 3) and c == ">" and depth:
            depth -= 1
        elif place == 1:
            if c == "<" and not quote and not bare:
                depth += 1
            elif c == ">" and not quote and not (xml and p1 == "-"):
                place, quote, xml = 0, "", False
            elif c in "\"'" and quote in ("", c):
                quote = "" if quote else c
            elif c == "!" and p1 == "<":
                place = 3
            elif c == "?" and p1 == "<":
                place, brackets = 2, 0
        elif place == 2:
            if c in "()" and last not in ("'", '"'):
                last, brackets = c, brackets + (1 if c == "(" else -1)
            elif c == ">" and not quote and not brackets and last != '"' and p1 == "?":
                place, quote = 0, ""
            elif c in "\"'" and p1 != "\\":
                last = "" if last == c else c
                if quote in ("", c):
                    quote = "" if quote else c
            elif c in "lL" and i > 4 and behind[-4:].lower() == "<?xm":
                place, xml = 1, True
        elif place == 3:
            if c == ">" and not quote:
                place = 0
            elif c in "\"'" and p1 != "\\" and quote in ("", c):
                quote = "" if quote else c
            elif c == "-" and behind[-2:] == "!-":
                place = 4
            elif c in "eE" and i > 6 and behind.lower() == "doctyp":
                place = 1
        elif c == ">" and not quote and behind[-2:] == "--":
            place, quote = 0, ""
    return "".join(out)


def stripped(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(rows.select("i", X.strip_tags(F.col("t"))).collect())]


def test_awkward_texts(spark):
    texts, want = zip(*AWKWARD)
    assert [plain(t) for t in texts] == list(want)
    assert stripped(spark, texts) == list(want)


@pytest.mark.parametrize("seed", range(3))
def test_made_up_texts(spark, seed):
    rng = random.Random(seed)
    pieces = ["<", ">", "'", '"', "!", "-", "--", "?", "<?", "<!--", "-->", "?>", " ", "a", "xml", "(", ")", "\\", "<!doctype", "<b>", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    assert stripped(spark, texts) == [plain(t) for t in texts]


def test_long_texts(spark):
    text = "ab <i>cd</i> " * 3000
    assert stripped(spark, [text, "x" * 300_000, "<" + "y" * 100_000]) == ["ab cd " * 3000, "x" * 300_000, ""]
