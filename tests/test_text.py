from __future__ import annotations

import collections
import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import bricks
from papyra.functions import text as tx
from papyra.operators import segment
from papyra.plans import textual
from papyra.session import shared_dir
from tests import plain_segment


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sentences(spark):
    text = 'Hôm qua. “Anh đi! a) Xong b) C.  Rồi…  Đó là 1 + 2'
    assert one(spark, tx.split_sentences(F.lit(text))) == ["Hôm qua. “", "Anh đi! a)", "Xong b)", "C.", "Rồi…", "Đó là 1 +", "2"]


def test_accents(spark):
    loose = unicodedata.normalize("NFD", "ế").replace("ê", "ê")
    assert one(spark, tx.compose_accents(F.lit(f"ti{loose}ng"))) == "tiếng"
    assert one(spark, tx.place_tones(F.lit("hòa thúy khỏe"))) == "hoà thuý khoẻ"
    assert one(spark, tx.strip_diacritics(F.lit("Đường Huế"))) == "duong hue"
    assert one(spark, tx.strip_diacritics(F.lit("Đường"), lower=False)) == "Duong"
    assert [one(spark, tx.diacritic_diff(F.lit(w))) for w in ("duong", "đường", "huế")] == ["S", "đườ", "ế"]


def test_vowel_units(spark):
    assert one(spark, tx.vowel_units(F.lit("Tôi là giảng viên quyền, nghiêng!"))) == [
        "T", "ôi", " ", "l", "à", " ", "gi", "ả", "ng", " ", "v", "iê", "n", " ", "qu", "yề", "n", ",", " ",
        "ngh", "iê", "ng", "!",
    ]
    assert one(spark, tx.vowel_units(F.lit("đường khuya"), False)) == ["d", "uo", "ng", " ", "kh", "uya"]
    assert one(spark, tx.vowel_candidates(F.lit("eu"))) == ["êu", "ều", "ếu", "ểu", "ễu", "ệu"]
    assert one(spark, tx.vowel_candidates(F.lit("x"))) is None
    assert len(one(spark, tx.vowel_candidates(F.lit("ua")))) == 24


def wrap_by_definition(text: str, width: int) -> list[str]:
    out, s = [], text.strip(" ")
    while s:
        t = min(len(s), width)
        if t == width:
            t -= 1
            while t > 0 and s[t] != " ":
                t -= 1
        if t == 0:
            t = width - 1  # a word that fills the line is cut hard
        out.append(s[:t].strip(" "))
        s = s[t:].strip(" ")
    return out


def test_wrap(spark):
    texts = ["Ý kiến đa chiều về nhà hát giao hưởng ở Thủ Thiêm", "a" * 40, "ab  cd   ef", "x", "", "one two three four five six " * 5]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", tx.wrap_text(F.col("t"), 16).alias("w")).collect():
        assert row.w == wrap_by_definition(row.t, 16), row.t


def test_small_functions(spark):
    assert one(spark, tx.subtokens(F.array(F.lit("a"), F.lit("ab"), F.lit("abcd"), F.lit("")))) == [
        "a", "$NA", "$NA", "a", "$NA", "b", "a", "bc", "d",
    ]
    assert one(spark, tx.char_units(F.array(F.lit("abc")), 5)) == ["a", "b", "c", "$P", "$P"]
    assert one(spark, tx.chunk_array(F.array(*[F.lit(i) for i in range(5)]), 2)) == [[0, 1], [2, 3], [4]]
    assert one(spark, tx.chunk_array(F.array().cast("array<int>"), 2)) == []
    assert one(spark, tx.apply_mappings(F.lit("xx ab yy ab"), F.lit("11 22 33 44"), [("ab", "ZZ")])) == "11 ZZ 33 ZZ"
    assert one(spark, tx.group_slots(F.array(F.lit("a: 1"), F.lit("b:2"), F.lit("a:3")))) == {"a": ["1", "3"], "b": ["2"]}
    assert one(spark, tx.keyword_score(F.lit("abc def"), ["abc", "def"])) == 0.5
    assert one(spark, tx.keyword_score(F.lit("abc def"), ["abc", "def"], strict=False)) == 1.0
    assert one(spark, tx.clean_category(F.lit("Điện – thoại/Máy, tính"))) == "điện thoại máy tính"
    assert one(spark, tx.expand_abbreviations(F.lit("12 Q.3, TP.HCM (cũ)"))) == "12 Quận 3, Thành phố Hồ Chí Minh "
    assert one(spark, tx.slice_between(F.lit("x Kính gửi: A Nơi nhận B"), ["Kính gửi", "Kính gởi"], ["Nơi nhận", "KT."])) == "Kính gửi: A "
    assert one(spark, tx.jvm_token_count(F.lit("a  b c  "))) == 4


def test_log_line(spark):
    line = '1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 23 "-" "x y"'
    got = one(spark, tx.parse_log(F.lit(line)))
    assert (got.ip, got.user, got.url, got.status, got.agent) == ("1.2.3.4", "bob", "/a", 200, "x y")
    assert one(spark, tx.parse_log(F.lit(line.replace("GET /a HTTP/1.0", "GET")))).method == "[error]"
    assert one(spark, tx.parse_log(F.lit("nonsense"))) is None


# --- bricks ---------------------------------------------------------------------------------
def cut_by_definition(text: str) -> list[tuple[str, str]]:
    text = text.replace('"', " ")
    if not text.strip(bricks._EDGE):
        return []
    for name, pattern in bricks._COMPILED:
        m = pattern.search(text)
        if m:
            left, right = text[: m.start()].strip(bricks._EDGE), text[m.end() :].strip(bricks._EDGE)
            return cut_by_definition(left) + [(name, m.group())] + cut_by_definition(right)
    return []


PIECES = st.sampled_from(
    ["a", "b", "Á", "Đ", "đ", "1", "30", " ", "  ", ".", ",", "-", "/", "@", "$", "(", ")", "_", "\n", "%", ":", "“",
     "tháng", "ngày", "năm", "TP", "€", "日", "+", '"', "đường", "quốc lộ", "http://"]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_bricks_follow_the_definition(text):
    assert bricks.cut(text) == cut_by_definition(text)


def test_segment_sentence():
    lexicon = {"quản lý", "nhà nước", "quốc phòng"}
    tokens = plain_segment.segment("Quản lý nhà nước tại Bộ Quốc phòng, số 96/QĐ và 20km", lexicon)
    assert [t for _, t in tokens] == ["Quản_lý", "nhà_nước", "tại", "Bộ", "Quốc_phòng", ",", "số", "96", "/", "QĐ", "và", "20", "km"]


def test_longest_match_directions():
    lexicon = {"a b", "b c", "c d e"}
    assert plain_segment.longest_match("a b c d e".split(), lexicon, True) == ["a b", "c d e"]
    assert plain_segment.longest_match("a b c".split(), lexicon, False) == ["a", "b c"]


def test_segmentation_of_null_and_repeated_keys_and_odd_texts(spark):
    texts = [None, "", " \t", "học sinh", "the of and is and the of", "Bộ Quốc phòng học, số 96/QĐ và 20km", "Of The Of and the of 3 of the and", "   a b c d e\u00a0", "a b " * 300, "Quốc Phòng học sinh, Quốc phòng"]
    rows = [(None if i % 3 == 0 else i % 2, t) for i, t in enumerate(texts * 2)]
    terms = ["học sinh", "phòng học", "quốc phòng", "of and", "the of and", "and is", "a b", "b a b", "a b c d e", "of and the", "of the of", "học"]
    lexicon = spark.createDataFrame([(t,) for t in terms] + [(None,), ("a b",)], "term string")
    table = spark.createDataFrame(rows, "id int, text string").withColumn("_row", F.lit(7)).withColumn("pos", F.lit("x"))
    for forward in (False, True):
        found = segment.segment(table.repartition(3), "id", "text", lexicon, forward=forward)
        assert found.columns == ["id", "text", "_row", "pos", "tokens"]
        got = sorted(((r.id, r.text, r.tokens and [(t.pos, t.shape, t.token) for t in r.tokens]) for r in found.collect()), key=str)
        want = [(i, t, t and [(n, *x) for n, x in enumerate(plain_segment.segment(t, set(terms), forward), 1)]) for i, t in rows]
        assert [(i, t, k or None) for i, t, k in got] == sorted(((i, t, k or None) for i, t, k in want), key=str)
    both = segment.ambiguous(table, "id", "text", lexicon).collect()
    assert len(both) == len(rows)
    for r in both:
        read = [[(x, y) for x, y in plain_segment.segment(r.text or "", set(terms), f)] for f in (False, True)]
        assert r.differs == (read[0] != read[1])


def test_sentences_read_as_defined(spark):
    rows = textual._sentences(spark, "/root/testdata/sf0.001").filter("pmod(hash(sent_id), 4) = 0")
    lexicon = textual._lexicon(spark, "/root/testdata/sf0.001")
    terms = {r.term for r in lexicon.collect()}
    for r in segment.segment(rows, "sent_id", "text", lexicon).collect():
        assert [(t.shape, t.token) for t in r.tokens] == plain_segment.segment(r.text, terms)


def test_segment_with_distributed_lexicon(spark):
    texts = ["Quản lý nhà nước tại Bộ Quốc phòng", "nhà nước và nhà nước cùng Quản lý", "không có gì", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lexicon = spark.createDataFrame([("quản lý",), ("nhà nước",), ("quốc phòng",), ("nhà nước và",)], "term string")
    for forward in (False, True):
        found = segment.segment(rows, "id", "text", lexicon, forward=forward).select("id", "tokens").collect()
        terms = {r.term for r in lexicon.collect()}
        for r in found:
            want = texts[r.id] and plain_segment.segment(texts[r.id], terms, forward)
            assert (r.tokens and [(t.shape, t.token) for t in r.tokens]) == want or not want and not r.tokens
        assert len(found) == len(texts)


def test_places_carry_no_more_than_the_longest_term(spark):
    phrases = spark.createDataFrame([(1, "a b c a b".split()), (2, ["a"]), (3, "b c".split())], "id int, s array<string>")

    def places(*terms):
        found = segment.lexicon_spans(phrases, ["id"], "s", spark.createDataFrame([(t,) for t in terms], "_term string"))
        return found._jdf.queryExecution().optimizedPlan().toString(), {tuple(r) for r in found.collect()}

    plan, found = places("a b", "b c")
    assert "_run#" not in plan and found == {(1, 0, 2), (1, 1, 2), (1, 3, 2), (3, 0, 2)}
    assert places("a b", "b c a")[1] == {(1, 0, 2), (1, 3, 2), (1, 1, 3)}
    assert places("b c a")[1] == {(1, 1, 3)}
    assert places("a")[1] == set()


def test_tokens_stay_where_they_are(spark):
    """Bricks and tokens are cut by row once; what the joins bring is moved to them."""
    table = spark.createDataFrame([(1, "a b c Anh An"), (2, "b c 12")], "id int, text string")
    lexicon = spark.createDataFrame([("a b",), ("b c",)], "term string")
    plan = segment.segment(table, "id", "text", lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan


def test_blocks_travel_packed_and_terms_once(spark, monkeypatch):
    """Neither texts nor tokens go to the lexicon: blocks are small and ask for a term once, whatever its places."""
    monkeypatch.setattr(segment, "BLOCK_BYTES", 20_000)
    plain = [f"the old house of the town {'abcdefg'[i % 7]} Anh of 12 Nam Anh of the house, An of the house" for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(plain)), "id int, text string").repartition(3)
    terms = ["the old", "of the", "anh of", "house of the"]
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    found = segment.segment(rows, "id", "text", lexicon)
    got = {r.id: [(t.shape, t.token) for t in r.tokens] for r in found.collect()}
    assert got == {i: plain_segment.segment(t, set(terms)) for i, t in enumerate(plain)}
    packed = [r.n for r in spark.read.parquet(_last(spark, "blocks")).select(F.length("packed").alias("n")).collect()]
    assert len(packed) > 3 and sum(packed) < sum(map(len, plain)) / 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "packed" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    # a sieve that lets all through, and what is heard sent to all or met in a join
    monkeypatch.setattr(segment, "_sieve", lambda terms: [b"\xff" * (segment.SIEVE_PART // 8)])
    for limit in (segment.DENIED_BYTES, -1):
        monkeypatch.setattr(segment, "DENIED_BYTES", limit)
        assert {r.id: [(t.shape, t.token) for t in r.tokens] for r in segment.segment(rows, "id", "text", lexicon).collect()} == got


def _last(spark, label):
    from pathlib import Path

    return str(max(Path(shared_dir(spark).removeprefix("file://")).glob(f"{label}-*"), key=lambda p: p.stat().st_mtime))


def test_all_that_a_reading_looks_up_has_been_asked():
    """The terms that bricks ask for hold all look-ups of both readings and both repairs."""
    rng = random.Random(7)
    words = ["a", "b", "c d", "Anh", "Nam", "Bộ Quốc", "12", ",", "e", "QĐ", "a\tb"]
    terms = {" ".join(rng.choices(["a", "b", "c", "d", "anh", "nam", "quốc", "12", ",", "e"], k=rng.choice([2, 2, 3, 4]))) for _ in range(400)}
    sizes, most = sorted({len(t.split(" ")) for t in terms}), 4
    for _ in range(300):
        text = " ".join(rng.choices(words, k=12))
        asked: set[str] = set()
        pieces = bricks.cut(text)
        bricks.asked(pieces, sizes, most, asked)
        known = {t: t.lower() in terms for t in asked}
        for forward in (False, True):
            assert bricks.read(pieces, lambda t: t.count(" ") < most and known[t], sizes, forward) == plain_segment.segment(text, terms, forward)


def test_pairs_are_counted_in_their_task(spark, monkeypatch):
    monkeypatch.setattr(segment, "PAIRS_HELD", 40)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "The", "ä", "c1d", "đi", "\n", "x"], k=rng.randrange(60))) for _ in range(200)] + ["", None, "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = collections.Counter()
    for t in texts:
        words = [w for w in re.split(r"[\W\d_]+", t or "") if w and all(c.islower() for c in w)]
        counts.update(map(" ".join, zip(words, words[1:])))
    found = segment.frequent_bigrams(rows, "text", 110)
    assert sorted(r.term for r in found.collect()) == sorted(t for t, n in counts.items() if n >= 110) and 0 < found.count() < len(counts)
