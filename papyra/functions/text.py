"""Column functions over raw text: all native expressions, no Python rows."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
TONE_MARKS = ["\u0300", "\u0301", "\u0309", "\u0303", "\u0323"]  # grave acute hook tilde dot
PLAIN_VOWELS = "aăâeêioôơuưy"
SENTENCE_CAPITALS = (
    "A-ZĐÀÁẢÃẠẤẦẨẪẬƯỪỨỬỮỰÙÚỦŨỤÔỒỐỔỖỘƠỜỚỞỠỢÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊỲÝỶỸỴ\\d"
)
BAD_TERMS = ["sex", "<div", "class=", "script", "\x00"]
MASKED_PUNCTUATION = [
    ",", ".", ":", ";", "?", "!", '"', "'", "/", "...", "-", "LBKT", "RBKT",
    "--", "``", "''", ")", "(",
]
QUERY_PUNCTUATION = "[.,?!;:\"…/”“″=^▪•<>&«\\])(\\[\u200b\ufeff+-]+"
QUESTION_WORDS = "(hay|không|là|gì|nào|và|hoặc)+"
ADDRESS_RULES: list[tuple[str, str]] = [  # applied in this order, so "TP." comes before "P."
    (r"Q\.", "Quận "),
    (r"Q\.(?!\d)", "Quận "),
    (r"tp\.", "Thành phố"),
    (r"T[Pp]\.", "Thành phố "),
    (r"P\.", "Phường "),
    (r"T\.[Tt]rệt", "Tầng Trệt"),
    (r"H\.", "Huyện "),
    (r"TT", "Thị trấn"),
    (r"T\.[Tt]rấn", "Thị trấn"),
    (r"TX\.", "Thị xã "),
    (r"TPHCM", "Thành phố Hồ Chí Minh"),
    (r"HCM", "Hồ Chí Minh"),
    (r"btân", "Bình Tân"),
    (r"Btan", "Bình Tân"),
    (r"(tp|TP),", "tân phú,"),
    (r"(tb|TB),", "tân bình,"),
    (r"(bt|BT),", "bình thạnh,"),
    (r"(hm|HM),", "hóc môn,"),
    (r"btân,", "bình tân,"),
    (r"qpn", "quận phú phuận"),
    (r"(pn|PN),", "phú nhuận,"),
    (r"(nb|NB),", "nhà bè,"),
    (r"(bc|BC),", "bình chánh,"),
    (r"(gv|GV),", "gò vấp,"),
    (r"\(.+\)", ""),
]
LOG_PATTERN = (
    r'(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})? (\S+) (\S+) (\[.+?\]) "(.*?)" (\d{3}) (\S+) "(.*?)" "(.*?)"'
)
# Vowel units by bare spelling. A star follows the letter that carries the tone.
VOWEL_SINGLES = "a* â* ă* e* ê* o* ô* ơ* i* u* ư* y*"
VOWEL_PAIRS = (
    "a*o a*i a*u â*u a*y â*y e*o ê*u oa* oă* oe* o*i ơ*i ô*i oo* i*a iê* io* iô* iơ* i*u "
    "u*a ư*a uă* uâ* uê* uô* uơ* ươ* u*i ư*i ư*u uy* yê*"
)
VOWEL_TRIPLES = "iê*u yê*u oa*i oa*o oa*y oe*o ua*o uâ*y uô*i ươ*i ươ*u uya uy*u uyê*"
UNIT_SEPARATORS = ".!,?;:()'\" "
# ---- end of fixed values ----------------------------------------------------


def _compose(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def _bare_letter(c: str) -> str:
    if c in "đĐ":
        return "d" if c == "đ" else "D"
    return unicodedata.normalize("NFD", c)[0]


TONED = {_compose(v + t): v for v in PLAIN_VOWELS for t in TONE_MARKS}
ACCENTED = sorted((set(TONED) | set("ăâêôơưđ")))
ACCENTED_UPPER = [c.upper() for c in ACCENTED]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def compose_accents(text: Column) -> Column:
    """Letter + combining tone mark becomes the single precomposed letter."""
    out = text
    for v in PLAIN_VOWELS + PLAIN_VOWELS.upper():
        for t in TONE_MARKS:
            out = F.replace(out, F.lit(v + t), F.lit(_compose(v + t)))
    marks = "".join(TONE_MARKS)
    return F.when(text.rlike(f"[{marks}]"), out).otherwise(text)


def tone_pairs() -> list[tuple[str, str]]:
    """``òa`` -> ``oà`` and its like: oa, oe, uy with five tones each."""
    return [
        (_compose(p[0] + t) + p[1], p[0] + _compose(p[1] + t))
        for p in ("oa", "oe", "uy")
        for t in TONE_MARKS
    ]


def place_tones(text: Column) -> Column:
    out = text
    for old, new in tone_pairs():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"\s+", " ")


def trim_blank(text: Column) -> Column:
    """Trim every kind of ASCII blank, not only spaces."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def split_sentences(text: Column) -> Column:
    """Array of sentences; a quote opening the next sentence stays with the previous one."""
    before = r'(?:(?<=[.?!…;:+\-] ["“]?)|(?<=[a-f]\) ["“]?))'
    parts = F.split(collapse_spaces(text), before + f"(?=[{SENTENCE_CAPITALS}])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column, pattern: str = r"\s+") -> Column:
    """Non-empty pieces of the text between separators."""
    return F.filter(F.split(text, pattern), lambda w: w != "")


def jvm_token_count(text: Column) -> Column:
    """Pieces between single blanks, trailing empty pieces not counted: the inner blanks plus one."""
    kept = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    solid = kept
    for blank in " \t\n\x0b\f\r":
        solid = F.replace(solid, F.lit(blank), F.lit(""))
    count = F.length(kept) - F.length(solid) + 1
    return F.when((kept == "") & (text != ""), F.lit(0)).otherwise(count)


def mask_punctuation(token: Column) -> Column:
    return F.when(token.isin(MASKED_PUNCTUATION), F.lit("PUNCT")).otherwise(
        F.replace(token, F.lit(","), F.lit("."))
    )


def mask_number(token: Column) -> Column:
    from papyra.functions.shapes import NUMBER

    return F.when(token.rlike(rf"\A(?:{NUMBER}%?)\z"), F.lit("[NUM]")).otherwise(token)


def mask_tokens(tokens: Column, punctuation: bool = True, number: bool = True) -> Column:
    out = F.transform(tokens, mask_punctuation) if punctuation else tokens
    return F.transform(out, mask_number) if number else out


def strip_diacritics(text: Column, lower: bool = True) -> Column:
    if lower:
        return F.translate(F.lower(text), "".join(ACCENTED), "".join(map(_bare_letter, ACCENTED)))
    letters = ACCENTED + ACCENTED_UPPER
    return F.translate(text, "".join(letters), "".join(map(_bare_letter, letters)))


def diacritic_diff(token: Column) -> Column:
    """From the first to the last letter that stripping would change; ``S`` if none."""
    letters = "".join(ACCENTED + ACCENTED_UPPER)
    found = F.regexp_extract(token, f"(?s)[{letters}](?:.*[{letters}])?", 0)
    return F.when(~token.rlike(r"[^\x00-\x7f]") | (found == ""), F.lit("S")).otherwise(found)


def _expand_units(templates: str) -> dict[str, list[str]]:
    units: dict[str, list[str]] = {}
    for template in templates.split():
        plain = template.replace("*", "")
        key = "".join(map(_bare_letter, plain))
        forms = [plain]
        if "*" in template:
            at = template.index("*") - 1
            forms += [plain[:at] + _compose(plain[at] + t) + plain[at + 1 :] for t in TONE_MARKS]
        units.setdefault(key, []).extend(forms)
    return units


SINGLE_UNITS = _expand_units(VOWEL_SINGLES) | {"d": ["d", "đ"]}
PAIR_UNITS = _expand_units(VOWEL_PAIRS)
TRIPLE_UNITS = _expand_units(VOWEL_TRIPLES)


def _unit_regex(units: dict[str, list[str]]) -> str:
    forms = {f for fs in units.values() for f in fs} | set(units)
    return "|".join(sorted(forms))


def vowel_units(text: Column, keep_diacritics: bool = True) -> Column:
    """Cut text into onset, vowel group and rest; separators are units of their own.

    Texts repeat their syllables, so each task cuts a syllable once and looks it up from then on.
    """
    from papyra.functions import vowels

    marked = (vowels.marked_units if keep_diacritics else vowels.marked_bare_units)(text)
    return let(marked, lambda m: F.when(m == "", F.array().cast("array<string>")).otherwise(F.split(m, vowels.MARK)))


def joined_vowel_units(text: Column, separator: str) -> Column:
    """The vowel units of a text with a separator between them, without an array in between."""
    from papyra.functions import vowels

    return F.replace(vowels.marked_units(text), F.lit(vowels.MARK), F.lit(separator))


def vowel_group_counts(text: Column) -> Column:
    """``(unit, n)`` structs: the distinct bare units of a text that have accented spellings."""
    from papyra.functions import vowels

    return vowels.bare_group_counts(text)


def vowel_candidates(unit: Column) -> Column:
    """Accented spellings of a bare vowel unit, null for any other unit."""
    entries = {**SINGLE_UNITS, **PAIR_UNITS, **TRIPLE_UNITS}
    literal = F.create_map(
        *[x for k, v in entries.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))]
    )
    return F.try_element_at(literal, unit)


def expand_abbreviations(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Rewrite rules in list order, then tidy spaces."""
    out = text
    for pattern, replacement in rules or ADDRESS_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.replace(F.regexp_replace(out, r"\s+", " "), F.lit(" ,"), F.lit(","))


def apply_mappings(source: Column, predicted: Column, mappings: list[tuple[str, str]]) -> Column:
    """Where ``source`` holds a phrase, its aligned span of ``predicted`` becomes the mapped phrase."""
    out = predicted
    for phrase, value in mappings:
        out = F.when(source.contains(phrase), let(out, _overlay(source, phrase, value))).otherwise(out)
    return out


def _overlay(source: Column, phrase: str, value: str):
    """Copy ``target`` stretch by stretch between the places where ``source`` has the phrase."""

    def apply(target: Column) -> Column:
        gaps = F.transform(F.split(source, re.escape(phrase)), lambda g: F.length(g))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc, gap):
            piece = F.substr(target, acc["at"], gap)
            return F.struct(
                (acc["at"] + gap + F.lit(len(phrase))).alias("at"),
                F.array_append(acc["parts"], piece).alias("parts"),
            )

        return F.aggregate(gaps, start, step, lambda a: F.array_join(a["parts"], value))

    return apply


def wrap_text(text: Column, width: int = 80) -> Column:
    """Lines shorter than ``width`` cut at the last space; an overlong word is cut hard."""
    inner = max(width - 3, 0)
    line = rf"(?s)[^ ](?:.{{0,{inner}}}[^ ])?(?= |\z)|[^ ]{{{width - 1}}}"
    return F.regexp_extract_all(F.trim(text), F.lit(line), F.lit(0))


def chunk_array(values: Column, n: int) -> Column:
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(n))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.slice(values, i, n))


def subtokens(tokens: Column) -> Column:
    """First letter, middle, last letter of each token, ``$NA`` where missing."""

    def cut(t: Column) -> Column:
        n = F.length(t)
        na = F.lit("$NA")
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(
            F.array(
                F.substr(t, F.lit(1), F.lit(1)),
                F.when(n > 2, F.substr(t, F.lit(2), n - 2)).otherwise(na),
                F.when(n > 1, F.right(t, F.lit(1))).otherwise(na),
            )
        )

    return F.flatten(F.transform(tokens, cut))


def char_units(tokens: Column, width: int = 13) -> Column:
    """Exactly ``width`` letters per token, padded with ``$P``."""

    def cut(t: Column) -> Column:
        letters = F.split(t, "")
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(
            F.slice(F.concat(letters, F.array_repeat(F.lit("$P"), width)), 1, width)
        )

    return F.flatten(F.transform(tokens, cut))


def query_terms(question: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(question, QUERY_PUNCTUATION, ""), QUESTION_WORDS, "")
    return words(F.lower(text))


def keyword_score(text: Column, keywords: list[str], strict: bool = True) -> Column:
    """Share of keywords found; with ``strict`` a hit at the very start does not count."""
    floor = 1 if strict else 0
    hits = [(F.instr(text, k) > floor).cast("int") for k in keywords]
    return sum(hits[1:], hits[0]) / F.lit(float(len(keywords)))


def clean_category(name: Column, lower: bool = True) -> Column:
    out = F.regexp_replace(name, "[–,&-]+", "")
    out = F.regexp_replace(F.regexp_replace(out, "[/]+", " "), r"\s+", " ")
    out = place_tones(out)
    return F.lower(out) if lower else out


def parse_log(line: Column) -> Column:
    """Struct of the nine log fields; null where the line has another form.

    One replacement lays the groups out between separators, so the pattern runs once.
    """
    mark = "\x01"
    laid_out = F.regexp_replace(line, rf"\A{LOG_PATTERN}\z", mark.join(f"${i}" for i in range(1, 10)))
    return let(F.split(laid_out, mark), _log_fields)


def _log_fields(group: Column) -> Column:
    def part(i: int) -> Column:
        request = F.split(group[4], " ")
        return F.when(F.size(request) == 3, F.get(request, F.lit(i))).otherwise(F.lit("[error]"))

    fields = F.struct(
        group[0].alias("ip"),
        group[1].alias("client"),
        group[2].alias("user"),
        F.try_to_timestamp(F.regexp_extract(group[3], r"\[(\S+)", 1), F.lit("dd/MMM/yyyy:HH:mm:ss")).alias("ts"),
        part(0).alias("method"),
        part(1).alias("url"),
        part(2).alias("protocol"),
        group[5].try_cast("int").alias("status"),
        group[6].try_cast("long").alias("bytes"),
        group[7].alias("referer"),
        group[8].alias("agent"),
    )
    return F.when(F.size(group) == 9, fields)


def group_slots(slots: Column) -> Column:
    """``["k: v", …]`` to ``map<k, array<v>>``, values in input order."""
    pair = F.transform(
        slots,
        lambda s: F.struct(
            F.trim(F.split_part(s, F.lit(":"), F.lit(1))).alias("k"),
            F.trim(F.split_part(s, F.lit(":"), F.lit(2))).alias("v"),
        ),
    )
    return let(pair, _grouped_pairs)


def _grouped_pairs(pair: Column) -> Column:
    def values(key: Column) -> Column:
        return F.transform(F.filter(pair, lambda p: p["k"] == key), lambda p: p["v"])

    return let(
        F.array_distinct(F.transform(pair, lambda p: p["k"])),
        lambda keys: F.map_from_arrays(keys, F.transform(keys, values)),
    )


def strip_markup(html: Column) -> Column:
    """Visible text of a page: blocks of code and style go, then tags, then extra blanks."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<.+?>", " ")
    for entity, value in (
        ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"),
        ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(value))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_line(line: Column) -> Column:
    out = F.regexp_replace(line, r"\||\t+|_{3,}", "")
    return F.regexp_replace(F.trim(out), r"\s{2,}", " ")


def is_noise_line(line: Column) -> Column:
    return (line == "") | line.rlike(r"\A-{5,}\z") | line.startswith("http")


def slice_between(text: Column, begins: list[str], ends: list[str]) -> Column:
    """From the last-placed begin marker found up to the first-placed end marker found."""
    begin = F.greatest(F.lit(1), *[F.instr(text, b) for b in begins])
    hits = F.filter(F.array(*[F.instr(text, e) for e in ends]), lambda i: i > 0)
    end = F.coalesce(F.array_min(hits), F.length(text) + 1)
    return F.substr(text, begin, F.greatest(end - begin, F.lit(0)))
