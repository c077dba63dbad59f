from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papyra.functions import shapes as sh

TEXT = {
    "love": "lower", "Washington": "capitalized",
    "ABC": "allcaps", "U.S.": "capitalizedWithPeriod", "iPhone": "mixedCase", "F35": "endsInDigit",
    "H-P": "containsHyphen", "12.24.2000": "date", "26/2016/TT-BXD": "docNo", "4158/QĐ-UBND": "docNo",
    "ngày_05_tháng_2_năm_2015": "date", "18:01": "time", "0969 0014 80": "numSeq", "77.88": "number", "-80.25": "number",
    "+1.27": "number", "86%": "percentage", "9A": "code", "Modesto, California": "name", "92.9kg": "weight",
    "?": "punctuation", "ab@site.com": "email", "a@b.com": "", "http://site.org/x": "url", "site.group": "url", "日本": "", "": "",
}
DIALOG = {
    "USA": "allcaps", "HN": "allcaps", "1234": "number", "-17,23%": "percentage", "-13.5%": "percentage",
    "3:30": "time", "20/10/1980": "date", "22/07/12": "date", "02/1985": "date", "0969 0014 80": "numSeq",
    ".": "punctuation", ";": "punctuation", "abcd": "", "love": "",
}


def shapes_of(spark, cases, table):
    rows = spark.createDataFrame([(w,) for w in cases], "w string")
    return {r.w: r.s for r in rows.select("w", sh.word_shape(F.col("w"), table).alias("s")).collect()}


def test_text_shapes(spark):
    assert shapes_of(spark, TEXT, sh.TEXT_SHAPES) == TEXT


def test_dialog_shapes(spark):
    assert shapes_of(spark, DIALOG, sh.DIALOG_SHAPES) == DIALOG


@pytest.mark.parametrize(
    "token,normal,dialog,placeholder",
    [
        ("love", "love", "love", "love"),
        ("12", "<number>", "[NUMBER]", "<number>"),
        ("95%", "<percentage>", "[PERCENTAGE]", "<percent>"),
        ("ABC", "ABC", "[ALLCAPS]", "abc"),
    ],
)
def test_token_forms(spark, token, normal, dialog, placeholder):
    t = F.lit(token)
    row = spark.range(1).select(sh.normalize_token(t), sh.dialog_token(t), sh.placeholder(t)).first()
    assert tuple(row) == (normal, dialog, placeholder)
