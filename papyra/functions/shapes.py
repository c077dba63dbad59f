"""Word-shape classification as one CASE chain over a token column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: shape patterns, tried in this order, full match ----------
URL = (
    r"(((\w+)\://)+[a-zA-z][\-\w]*\w+(\.\w[\-\w]*)+(/[\w\-~]+)*(\.\w+)?(/?)"
    r"(\?(\w+=[\w%~]+))*(&(\w+=[\w%~]+))*|[a-z]+((\.)\w+)+)"
)
EMAIL = r"(\w[-._%:\w]*@\w[-._\w]*\w\.\w{2,3})"
NUMBER = r"[\+\-]?([0-9]*)?[0-9]+([\.,]\d+)*"
PERCENTAGE = NUMBER + "%"
DATE1 = (
    r"(([12][0-9]|3[01]|0*[1-9])[-/.](1[012]|0*[1-9])[-/.](\d{4}|\d{2})"
    r"|(1[012]|0*[1-9])[-/.]([12][0-9]|3[01]|0*[1-9])[-/.](\d{4}|\d{2}))"
)
DATE2 = r"(1[012]|0*[1-9])[-/](\d{4}|\d{2})"
DATE3 = r"([12][0-9]|3[01]|0*[1-9])[-/](1[012]|0*[1-9])"
DATE4 = r"([Nn]gày)([\s_]+)\d+([\s_]+)tháng([\s_]+)\d+([\s_]+)năm([\s_]+)(\d+)"
DATE = r"(\d\d\d\d)[-/\.](\d?\d)[-/\.](\d?\d)|((\d?\d)[-/\.])?(\d?\d)[-/\.](\d\d\d\d)"
TIME = r"\d{1,2}:\d{1,2}"
NUM_SEQ = r"\+?\d+(([\s._-]+\d+)){2,}"
ALLCAPS = r"\p{Lu}+([\s_]\p{Lu}+)*"
PUNCTUATION = "[.,?!;:\"…/”“″=^▪•<>&«\\])(\\[\u200b\ufeff+-]+"
PUNCTUATION_DIALOG = "[.,?!;:\"…/”“″'=^▪•<>&«\\])(\\[\u200b\ufeff+-]+"
UNITS = "(Kg|kg|lbs|kilograms|kilogram|kilos|kilo|pounds|pound)"

TEXT_SHAPES: list[tuple[str, str]] = [
    ("docNo", r"(\d+[\p{Lu}-]*/)+[\p{Lu}-]+"),
    ("url", URL),
    ("email", EMAIL),
    ("lower", r"[\p{Ll}_]+"),
    ("capitalized", r"\p{Lu}[\p{Ll}_]*"),
    ("capitalizedWithPeriod", r"(\p{Lu}\p{Ll}?\.)+\p{Lu}?"),
    ("allcaps", ALLCAPS),
    ("mixedCase", r"\p{Ll}+\p{Lu}\p{Ll}+"),
    ("endsInDigit", r"[\p{Lu}\p{Ll}]+\d+"),
    ("containsHyphen", r"[\p{Lu}\p{Ll}]+\-[\p{Lu}\p{Ll}]+"),
    ("date", DATE1),
    ("date", DATE2),
    ("date", DATE3),
    ("date", DATE4),
    ("time", TIME),
    ("numSeq", NUM_SEQ),
    ("number", NUMBER),
    ("percentage", PERCENTAGE),
    ("code", r"\d+\p{Lu}"),
    ("name", r"(\p{Lu}\p{Ll}+)([-_&,\s]+(\p{Lu}\p{Ll}+))+"),
    ("weight", NUMBER + UNITS),
    ("punctuation", PUNCTUATION),
]

DIALOG_SHAPES: list[tuple[str, str]] = [
    ("email", EMAIL),
    ("url", URL),
    ("allcaps", ALLCAPS),
    ("date", DATE),
    ("date", DATE1),
    ("date", DATE2),
    ("date", DATE3),
    ("time", TIME),
    ("numSeq", NUM_SEQ),
    ("number", NUMBER),
    ("percentage", PERCENTAGE),
    ("punctuation", PUNCTUATION_DIALOG),
]

PARSER_SHAPES: list[tuple[str, str]] = [
    ("lower", r"[\p{Ll}_]+"),
    ("capitalized", r"\p{Lu}[\p{Ll}_]*"),
    ("capitalizedWithPeriod", r"(\p{Lu}\p{Ll}?\.)+"),
    ("allcaps", r"\p{Lu}+"),
    ("mixedCase", r"\p{Ll}+\p{Lu}\p{Ll}+"),
    ("endsInDigit", r"[\p{Lu}\p{Ll}]+\d+"),
    ("containsHyphen", r"[\p{Lu}\p{Ll}]+\-[\p{Lu}\p{Ll}]+"),
    ("date", DATE),
    ("number", NUMBER),
    ("code", r"\d+\p{Lu}"),
    ("name", r"(\p{Lu}[\p{Ll}_]+)+"),
    ("weight", NUMBER + UNITS),
]

# shapes whose tokens stay as words when a token is normalised
WORD_SHAPES = [
    "lower", "", "allcaps", "capitalized", "capitalizedWithPeriod",
    "mixedCase", "endsInDigit", "containsHyphen", "name",
]
# ---- end of fixed values ----------------------------------------------------


def full_match(token: Column, pattern: str) -> Column:
    return token.rlike(rf"\A(?:{pattern})\z")


def word_shape(token: Column, shapes: list[tuple[str, str]] = TEXT_SHAPES, wanted: set[str] | None = None) -> Column:
    """Name of the first shape that matches the whole token, else the empty string.

    Plain words are tested up front: no other shape accepts a token made only of
    letters, so the answer is unchanged and most tokens leave after one or two tests.
    Where only some shapes are ``wanted``, the tests that come after them are left out.
    """
    ordered = sorted(shapes, key=lambda s: s[0] not in ("lower", "capitalized"))
    if wanted is not None:
        ordered = ordered[: max((i + 1 for i, (name, _) in enumerate(ordered) if name in wanted), default=0)]
        if not ordered:
            return F.lit("")
    chain = F
    for name, pattern in ordered:
        chain = chain.when(full_match(token, pattern), F.lit(name))
    return chain.otherwise(F.lit(""))


def dialog_shape(token: Column) -> Column:
    return word_shape(token, DIALOG_SHAPES)


def normalize_token(token: Column) -> Column:
    """Words stay; any other shape becomes ``<shape>``."""
    shape = word_shape(token)
    return F.when(shape.isin(WORD_SHAPES), token).otherwise(F.concat(F.lit("<"), shape, F.lit(">")))


def dialog_token(token: Column) -> Column:
    """Any recognised shape becomes ``[SHAPE]``."""
    shape = dialog_shape(token)
    return F.when(shape == "", token).otherwise(F.concat(F.lit("["), F.upper(shape), F.lit("]")))


def shape_or_word(token: Column) -> Column:
    shape = word_shape(token)
    return F.when(shape == "", F.lit("word")).otherwise(shape)


def is_named_entity(token: Column) -> Column:
    return word_shape(token).isin("capitalized", "allcaps", "name")


def placeholder(token: Column) -> Column:
    """Addresses, dates and figures become ``<shape>``; the rest is lower-cased.

    Those have a digit, a dot, a colon or an at sign, so other tokens are not tested for their shape.
    """
    from papyra.functions.text import let

    kept = ["email", "url", "date", "time", "number"]

    def named(shape: Column) -> Column:
        return (
            F.when(shape.isin(kept), F.concat(F.lit("<"), shape, F.lit(">")))
            .when(shape == "percentage", F.lit("<percent>"))
            .otherwise(F.lower(token))
        )

    return F.when(token.rlike("[0-9.:@]"), let(word_shape(token), named)).otherwise(F.lower(token))


def number_punct_token(token: Column) -> Column:
    """``0`` for figures, ``S`` for punctuation."""
    shape = word_shape(token)
    return F.when(shape == "number", "0").when(shape == "punctuation", "S").otherwise(token)
