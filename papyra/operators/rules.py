"""Token-pattern rules: fixed-length sequences of word classes over sentence arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.shapes import word_shape
from papyra.functions.text import let

# ---- fixed values: word classes and patterns --------------------------------
WORD_CLASSES: dict[str, str] = {
    "province": "tỉnh thành_phố tp. tp huyện quận xã phường thị_trấn thôn bản làng xóm ấp",
    "press": "báo tờ tạp_chí đài thông_tấn_xã",
    "communist": "thành_ủy tỉnh_ủy quận_ủy huyện_ủy xã_ủy đảng_ủy",
    "police": "công_an cảnh_sát",
    "institution": "trường học_viện viện institute university",
    "company": "công_ty công_ty_cổ_phần tập_đoàn hãng xí_nghiệp",
    "union": "liên_hiệp hội hợp_tác_xã câu_lạc_bộ trung_tâm liên_đoàn tổng_liên_đoàn",
    "military": "sư_đoàn lữ_đoàn trung_đoàn tiểu_đoàn quân_khu liên_khu",
    "ministryPrefix": "bộ ủy_ban",
    "ministry": "chính_trị ngoại_giao quốc_phòng công_an tư_pháp tài_chính công_thương xây_dựng "
    "nội_vụ y_tế lao_động giao_thông thông_tin tt giáo_dục gd nông_nghiệp nn kế_hoạch kh "
    "khoa_học văn_hóa tài_nguyên tn dân_tộc",
    "departmentPrefix": "sở phòng ban chi_cục tổng_cục",
    "village": "quận q q. ấp quán khu tổ khóm xóm trạm số ngách ngõ",
    "region": "bang nước vùng miền",
    "locPrefix": "sông núi chợ châu đảo đèo cầu đồi đồn thủ_đô khách_sạn sân_bay nhà_hàng cảng "
    "đường phố đại_lộ chung_cư rạch hồ kênh",
    "road": "tỉnh_lộ quốc_lộ",
}
EXACT_CLASSES: dict[str, str] = {  # compared without lower-casing
    "school": "ĐH CĐ THPT THCS tiểu_học",
    "party": "Đảng đảng",
}
SHAPE_CLASSES: dict[str, list[str]] = {
    "number": ["number"],
    "capital": ["capitalized"],
    "allcaps": ["allcaps"],
    "name": ["name", "allcaps"],
    "code": ["code"],
}
RULES: dict[str, str] = {
    "orgAdmin": "allcaps province name",
    "orgPress": "press name",
    "orgCommunist1": "communist name",
    "orgCommunist2": "communist province name",
    "orgPolice": "police province name",
    "orgSchool1": "school name",
    "orgSchool2": "institution school name",
    "orgSchool3": "name institution",
    "orgCompany": "company name",
    "orgUnion": "union name",
    "orgMilitary": "military number",
    "orgMinistry": "ministryPrefix ministry",
    "orgDepartment1": "departmentPrefix ministry",
    "orgDepartment2": "departmentPrefix ministry province name",
    "orgParty1": "party name",
    "orgParty2": "party capital name",
    "locProvince": "province name",
    "locVillage": "village number",
    "locRegion": "region name",
    "locGeneral": "locPrefix name",
    "locRoad1": "road code",
    "locRoad2": "road number",
    "locAddress": "number name",
}
# ---- end of fixed values ----------------------------------------------------


def token_classes(
    token: Column,
    words: dict[str, str] | None = None,
    exact: dict[str, str] | None = None,
    shapes: dict[str, list[str]] | None = None,
) -> Column:
    """Array of the class names a token belongs to."""
    words = WORD_CLASSES if words is None else words
    exact = EXACT_CLASSES if exact is None else exact
    shapes = SHAPE_CLASSES if shapes is None else shapes
    wanted = {name for names in shapes.values() for name in names}
    return let(word_shape(token, wanted=wanted), lambda shape: _classes(token, shape, words, exact, shapes))


def _classes(token: Column, shape: Column, words: dict, exact: dict, shapes: dict) -> Column:
    lower = F.lower(token)
    tests = [(n, lower.isin(w.split())) for n, w in words.items()]
    tests += [(n, token.isin(w.split())) for n, w in exact.items()]
    tests += [(n, shape.isin(s)) for n, s in shapes.items()]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def match_rules(tokens: Column, classes: Column, rules: dict[str, str] | None = None) -> Column:
    """One label per token: the rule that covers it, else null.

    Every match is a ``(-length, rule order, position)`` triple; taking them in that
    order and leaving out those that touch a taken one is the same as choosing the
    longest match and going on to its left and right.
    """
    rules = RULES if rules is None else rules
    labels = let(_bits(classes, rules), lambda bound: _label(tokens, bound, rules))
    return F.when(F.size(tokens) > 0, labels)


def _parts(rules: dict[str, str]) -> dict[str, int]:
    """The classes that rules ask for, with a number each."""
    return {part: k for k, part in enumerate(sorted({p for pattern in rules.values() for p in pattern.split()}))}


def _bits(classes: Column, rules: dict[str, str]) -> Column:
    """Per token, the classes that rules ask for as bits of whole numbers: names are compared once a token."""
    parts = _parts(rules)

    def word(held: Column, names: list[str]) -> Column:
        bits = [F.when(F.array_contains(held, p), F.lit(1 << parts[p] % 62).cast("long")).otherwise(F.lit(0).cast("long")) for p in names]
        return sum(bits[1:], bits[0])

    words = [[p for p, k in parts.items() if k // 62 == n] for n in range(len(parts) // 62 + 1)]
    return F.transform(classes, lambda held: F.array(*[word(held, names) for names in words if names]))


def _label(tokens: Column, classes: Column, rules: dict[str, str]) -> Column:
    per_rule, number = [], _parts(rules)
    for order, (name, pattern) in enumerate(rules.items()):
        parts = pattern.split()

        def fits(i: Column, parts=tuple(parts)) -> Column:
            test = F.lit(True)
            for k, part in enumerate(parts):
                bits = F.get(F.get(classes, i + k), F.lit(number[part] // 62))
                test = test & F.coalesce(bits.bitwiseAND(F.lit(1 << number[part] % 62).cast("long")) != 0, F.lit(False))
            return test

        hits = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), _one(fits))
        per_rule.append(F.transform(hits, _triple(-len(parts), order)))
    matches = F.array_sort(F.flatten(F.array(*per_rule)))
    start = F.array().cast("array<struct<width:int,rule:int,at:int>>")
    names = F.array(*[F.lit(n) for n in rules])

    def covered(chosen: Column) -> Column:
        def label(token: Column, i: Column) -> Column:
            cover = F.filter(chosen, lambda m: (m["at"] <= i) & (i < m["at"] - m["width"]))
            return F.get(names, F.get(cover, F.lit(0))["rule"])

        return F.transform(tokens, label)

    return let(F.aggregate(matches, start, _take), covered)


def _one(fits):
    return lambda i: fits(i)


def _triple(width: int, order: int):
    return lambda i: F.struct(F.lit(width).alias("width"), F.lit(order).alias("rule"), i.alias("at"))


def _take(taken: Column, m: Column) -> Column:
    touches = F.exists(
        taken, lambda o: (o["at"] < m["at"] - m["width"]) & (m["at"] < o["at"] - o["width"])
    )
    return F.when(touches, taken).otherwise(F.array_append(taken, m))
