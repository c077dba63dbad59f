"""Queries for the text column functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from papyra.functions import shapes as sh
from papyra.functions import text as tx
from papyra.functions.rows import unnest, unnest_structs
from papyra.operators import features, rules, segment
from papyra.operators.postings import postings, rows_of
from papyra.plans.curation import SENTENCES_SQL
from papyra.plans.registry import query, spread, table

WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def shape_sql(token: str, shapes=sh.TEXT_SHAPES) -> str:
    cases = " ".join(f"when regexp_full_match({token}, {quoted(p)}) then '{n}'" for n, p in shapes)
    return f"case {cases} else '' end"


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _doc_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w"))


def _tokens(spark, sf_dir):
    return unnest(_doc_words(spark, sf_dir), ["doc_id"], "w", "t")


TOKENS_SQL = f"t as (select doc_id, unnest({WORDS.format('text')}) as t from documents)"
VOCAB_SQL = TOKENS_SQL + ", v as (select distinct t from t)"


@query(
    "d1_unicode_compose",
    "select doc_id, nfc_normalize(replace(replace(replace(text, 'é', 'e' || chr(769)), 'è', 'e' || chr(768)), "
    "'ó', 'o' || chr(769))) as text from documents",
)
def unicode_compose(spark, sf_dir):
    loose = F.col("text")
    for whole, parts in (("é", "é"), ("è", "è"), ("ó", "ó")):
        loose = F.replace(loose, F.lit(whole), F.lit(parts))
    return _docs(spark, sf_dir).select("doc_id", tx.compose_accents(loose).alias("text"))


def _tones_sql(col: str) -> str:
    for old, new in tx.tone_pairs():
        col = f"replace({col}, '{old}', '{new}')"
    return col


@query("d2_tone_placement", f"select doc_id, {_tones_sql('text')} as text from documents")
def tone_placement(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.place_tones(F.col("text")).alias("text"))


@query(
    "d3_sentence_split",
    f"""with s as (select doc_id, {SENTENCES_SQL.format('text')} as s from documents)
    select doc_id, generate_subscripts(s, 1) as pos, unnest(s) as sentence from s""",
)
def sentence_split(spark, sf_dir):
    parts = unnest(_docs(spark, sf_dir), ["doc_id"], tx.split_sentences(F.col("text")), "sentence", "i")
    return parts.select("doc_id", (F.col("i") + 1).alias("pos"), "sentence")


def _sentences(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = unnest(docs, ["doc_id"], tx.split_sentences(F.col("text")), "sentence", "sent").withColumnRenamed("sentence", "text")
    return rows.select(F.concat_ws("-", "doc_id", "sent").alias("sent_id"), "text")


def _lexicon(spark, sf_dir):
    return segment.frequent_bigrams(_docs(spark, sf_dir), "text", 5)


@query("d4_token_bricks")
def token_bricks(spark, sf_dir):
    return unnest_structs(_sentences(spark, sf_dir), ["sent_id"], segment.token_bricks("text"))


@query("d5_longest_match")
def longest_match(spark, sf_dir):
    sentences = _sentences(spark, sf_dir)
    return unnest_structs(segment.segment(sentences, "sent_id", "text", _lexicon(spark, sf_dir)), ["sent_id"], "tokens")


@query("d6_name_repair")
def name_repair(spark, sf_dir):
    """Tokens that took in a neighbour: capital runs joined through the lexicon."""
    found = F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}+ \p{Ll}+)"), F.lit(1))
    pairs = unnest(_docs(spark, sf_dir), [], found, "term")
    lexicon = (
        pairs.groupBy(F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("term")
    )
    out = segment.segment(_sentences(spark, sf_dir), "sent_id", "text", lexicon)
    return unnest_structs(out, ["sent_id"], "tokens").filter("shape = 'capital' and token like '%\\_%'")


@query(
    "d7_token_index",
    r"""with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.,\n]+'),
    lambda x: trim(x)), lambda x: x <> '') as a from documents)
    select doc_id, generate_subscripts(a, 1) as pos, regexp_replace(unnest(a), '\s+', '_', 'g') as token from p""",
)
def token_index(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.split("text", r"[.,\n]+").alias("tokens"))
    return features.tokens_to_rows(docs, "doc_id", "tokens")


@query("d8_ambiguity")
def ambiguity(spark, sf_dir):
    both = segment.ambiguous(_sentences(spark, sf_dir), "sent_id", "text", _lexicon(spark, sf_dir))
    plain = [F.array_join(F.transform(c, lambda t: t["token"]), " ").alias(c) for c in ("backward", "forward")]
    return both.filter("differs").select("sent_id", *plain)


@query("d9_tokenized_text")
def tokenized_text(spark, sf_dir):
    out = segment.segment(_sentences(spark, sf_dir), "sent_id", "text", _lexicon(spark, sf_dir))
    text = segment.tokenized_text(F.col("tokens"), punctuation=True, number=True, lower=True)
    return out.select("sent_id", text.alias("text"))


MASKED = ", ".join(quoted(p) for p in tx.MASKED_PUNCTUATION)


@query(
    "d10_punct_number_mask",
    f"""select doc_id, array_to_string(list_transform(list_transform({WORDS.format('text')},
    lambda w: case when w in ({MASKED}) then 'PUNCT' else replace(w, ',', '.') end),
    lambda w: case when regexp_full_match(w, '[+-]?([0-9]*)?[0-9]+([.,]\\d+)*%?') then '[NUM]' else w end), ' ')
    as tokens from documents""",
)
def punct_number_mask(spark, sf_dir):
    docs = _doc_words(spark, sf_dir)
    return docs.select("doc_id", F.array_join(tx.mask_tokens(F.col("w")), " ").alias("tokens"))


@query(
    "d11_word_shape",
    f"""with {VOCAB_SQL}, s as (select t, {shape_sql('t')} as shape, {shape_sql('t', sh.DIALOG_SHAPES)} as dialog,
    {shape_sql('t', sh.PARSER_SHAPES)} as parser from v)
    select doc_id, shape, dialog, parser, count(*) as n from t join s using (t) group by all""",
)
def word_shape(spark, sf_dir):
    t = F.col("t")
    tokens = postings(_doc_words(spark, sf_dir), "doc_id", "w").withColumnRenamed("term", "t")
    shaped = tokens.select(
        "keys", "ns", sh.word_shape(t).alias("shape"), sh.dialog_shape(t).alias("dialog"),
        sh.word_shape(t, sh.PARSER_SHAPES).alias("parser"),
    )
    return rows_of(shaped, "doc_id", ["shape", "dialog", "parser"], "k").groupBy("doc_id", "shape", "dialog", "parser").agg(F.sum("k").alias("n"))


def _token_totals(spark, sf_dir):
    """Distinct tokens and how often they occur, so that each one's shape is found once."""
    return _tokens(spark, sf_dir).groupBy("t").agg(F.count(F.lit(1)).alias("k"))


KEPT_SHAPES = ", ".join(quoted(s) for s in sh.WORD_SHAPES)


@query(
    "d12_shape_normalize",
    f"""with {VOCAB_SQL}, s as (select t, {shape_sql('t')} as x, {shape_sql('t', sh.DIALOG_SHAPES)} as y from v),
    n as (select t, case when x in ({KEPT_SHAPES}) then t else '<' || x || '>' end as normal,
    case when y = '' then t else '[' || upper(y) || ']' end as dialog,
    case when x = '' then 'word' else x end as shape, x in ('capitalized', 'allcaps', 'name') as entity from s)
    select normal, dialog, shape, entity, count(*) as n from t join n using (t) group by all""",
)
def shape_normalize(spark, sf_dir):
    t = F.col("t")
    out = _token_totals(spark, sf_dir).select(
        "k", sh.normalize_token(t).alias("normal"), sh.dialog_token(t).alias("dialog"),
        sh.shape_or_word(t).alias("shape"), sh.is_named_entity(t).alias("entity"),
    )
    return out.groupBy("normal", "dialog", "shape", "entity").agg(F.sum("k").alias("n"))


@query(
    "d13_shape_placeholder",
    f"""with {VOCAB_SQL}, s as (select t, {shape_sql('t')} as x from v),
    n as (select t, case when x in ('email', 'url', 'date', 'time', 'number') then '<' || x || '>'
    when x = 'percentage' then '<percent>' else lower(t) end as placeholder,
    case x when 'number' then '0' when 'punctuation' then 'S' else t end as token from s)
    select placeholder, token, count(*) as n from t join n using (t) group by all""",
)
def shape_placeholder(spark, sf_dir):
    t = F.col("t")
    out = _token_totals(spark, sf_dir).select("k", sh.placeholder(t).alias("placeholder"), sh.number_punct_token(t).alias("token"))
    return out.groupBy("placeholder", "token").agg(F.sum("k").alias("n"))


LOWER_FROM, LOWER_TO = "".join(tx.ACCENTED), "".join(map(tx._bare_letter, tx.ACCENTED))
BOTH_FROM = LOWER_FROM + "".join(tx.ACCENTED_UPPER)
BOTH_TO = LOWER_TO + "".join(map(tx._bare_letter, tx.ACCENTED_UPPER))


@query(
    "d14_strip_diacritics",
    f"""select doc_id, translate(lower(text), '{LOWER_FROM}', '{LOWER_TO}') as lowered,
    translate(text, '{BOTH_FROM}', '{BOTH_TO}') as cased from documents""",
)
def strip_diacritics(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", tx.strip_diacritics(t).alias("lowered"), tx.strip_diacritics(t, lower=False).alias("cased")
    )


@query(
    "d15_diacritic_diff",
    f"""select doc_id, array_to_string(list_transform({WORDS.format('text')}, lambda w:
    coalesce(nullif(regexp_extract(w, '(?s)[{BOTH_FROM}](?:.*[{BOTH_FROM}])?', 0), ''), 'S')), ' ') as labels
    from documents""",
)
def diacritic_diff(spark, sf_dir):
    out = F.transform("w", lambda w: tx.diacritic_diff(w))
    return _doc_words(spark, sf_dir).select("doc_id", F.array_join(out, " ").alias("labels"))


_SINGLE = "".join(sorted({f for fs in tx.SINGLE_UNITS.values() for f in fs}))
_SEP = re.escape(tx.UNIT_SEPARATORS).replace("\\ ", " ").replace("'", "''")


def _cut_sql(rest: str) -> str:
    cases = []
    for p in (tx._unit_regex(tx.TRIPLE_UNITS), tx._unit_regex(tx.PAIR_UNITS), f"[{_SINGLE}]"):
        shape = f"(?s)^(.*?)({p})(.*)$"
        parts = ", ".join(f"regexp_extract({rest}, '{shape}', {i})" for i in (1, 2, 3))
        cases.append(f"when regexp_matches({rest}, '{p}') then [{parts}]")
    return f"case {' '.join(cases)} else [{rest}] end"


UNITS_SQL = f"""t as (select doc_id, unnest(a) as t, generate_subscripts(a, 1) as i from (select doc_id,
    regexp_extract_all({_tones_sql('text')}, '[{_SEP}]|[^{_SEP}~]+') as a from documents)),
    v as (select distinct t from t),
    o as (select t, case when regexp_matches(t, '^[qQ][uU]') or regexp_matches(t, '^[gG][iI][{_SINGLE}]')
    then substr(t, 1, 2) when regexp_matches(t, '^[dđ]') then substr(t, 1, 1) else '' end as o from v),
    u as (select t, array_to_string(list_filter(list_concat([o], {_cut_sql('substr(t, length(o) + 1)')}),
    lambda p: p <> ''), '|') as u from o)"""


@query(
    "d16_vowel_sequence",
    f"with {UNITS_SQL} select doc_id, string_agg(u, '|' order by i) as units from t join u using (t) group by doc_id",
)
def vowel_sequence(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter(F.col("text").rlike("[^~]"))  # a text without any unit has no row
    return docs.select("doc_id", tx.joined_vowel_units(F.col("text"), "|").alias("units"))


CANDIDATES = {**tx.SINGLE_UNITS, **tx.PAIR_UNITS, **tx.TRIPLE_UNITS}
CANDIDATE_VALUES = ", ".join(f"('{k}', '{' '.join(v)}')" for k, v in CANDIDATES.items())


@query(
    "d17_vowel_candidates",
    f"""with {UNITS_SQL}, c(k, candidates) as (values {CANDIDATE_VALUES}),
    n as (select t, translate(unnest(string_split(u, '|')), '{BOTH_FROM}', '{BOTH_TO}') as unit from u),
    k as (select t, unit, candidates from n join c on lower(unit) = c.k)
    select doc_id, unit, candidates, count(*) as n from t join k using (t) group by all""",
)
def vowel_candidates(spark, sf_dir):
    units = unnest_structs(_docs(spark, sf_dir), ["doc_id"], tx.vowel_group_counts(F.col("text")))
    counted = units.groupBy("doc_id", "unit").agg(F.sum("n").alias("n"))
    found = counted.withColumn("candidates", tx.vowel_candidates(F.lower("unit"))).filter("candidates is not null")
    return found.withColumn("candidates", F.array_join("candidates", " "))


ABBREVIATIONS = [(r"th\.", "the "), (r"[Oo]n,", "on ;"), (r"\(.+\)", "")]


@query(
    "d18_abbreviation_expand",
    r"""select doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    'th\.', 'the ', 'g'), '[Oo]n,', 'on ;', 'g'), '\(.+\)', '', 'g'), '\s+', ' ', 'g'), ' ,', ',') as text
    from documents""",
)
def abbreviation_expand(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.expand_abbreviations(F.col("text"), ABBREVIATIONS).alias("text"))


@query(
    "d19_phrase_mapping",
    "select doc_id, replace(replace(text, ' the ', ' thé '), ' of ', ' óf ') as text from documents",
)
def phrase_mapping(spark, sf_dir):
    mapped = tx.apply_mappings(F.col("text"), F.col("text"), [(" the ", " thé "), (" of ", " óf ")])
    return _docs(spark, sf_dir).select("doc_id", mapped.alias("text"))


@query(
    "d20_slice_lines",
    r"""with l as (select doc_id, regexp_extract_all(trim(text),
    '(?s)[^ ](?:.{0,77}[^ ])?(?: +|$)|[^ ]{79}') as a from documents)
    select doc_id, generate_subscripts(a, 1) as line, trim(unnest(a)) as text from l""",
)
def slice_lines(spark, sf_dir):
    rows = unnest(_docs(spark, sf_dir), ["doc_id"], tx.wrap_text(F.col("text"), 80), "piece", "i")
    return rows.select("doc_id", (F.col("i") + 1).alias("line"), F.col("piece").alias("text"))


@query(
    "d21_split_array",
    f"""with w as (select doc_id, {WORDS.format('text')} as w from documents), c as (select doc_id, w,
    unnest(range(0, len(w), 16)) as s from w)
    select doc_id, s // 16 as chunk, array_to_string(w[s + 1 : s + 16], ' ') as words from c""",
)
def split_array(spark, sf_dir):
    rows = unnest(_doc_words(spark, sf_dir), ["doc_id"], tx.chunk_array(F.col("w"), 16), "c", "chunk")
    return rows.select("doc_id", "chunk", F.array_join("c", " ").alias("words"))


@query(
    "d22_subtokens",
    f"""with {VOCAB_SQL}, s as (select t, substr(t, 1, 1) || '|' || case when length(t) > 2
    then substr(t, 2, length(t) - 2) else '$NA' end || '|' || case when length(t) > 1 then right(t, 1) else '$NA' end as s from v),
    i as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as i
    from (select doc_id, {WORDS.format('text')} as w from documents))
    select doc_id, string_agg(s, '|' order by i) as units from i join s using (t) group by doc_id""",
)
def subtokens(spark, sf_dir):
    return _doc_words(spark, sf_dir).select("doc_id", F.array_join(tx.subtokens(F.col("w")), "|").alias("units"))


@query(
    "d23_padded_chars",
    f"""with {VOCAB_SQL}, s as (select t, array_to_string(list_concat(string_split(t, ''),
    ['$P','$P','$P','$P','$P','$P','$P','$P','$P','$P','$P','$P','$P'])[1:13], '') as s from v)
    select s as letters, count(*) as n from t join s using (t) group by 1""",
)
def padded_chars(spark, sf_dir):
    units = tx.char_units(F.array("t"), 13)
    out = _tokens(spark, sf_dir).select(F.array_join(units, "").alias("letters"))
    return out.groupBy("letters").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d24_query_terms",
    f"""select item_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(text,
    {quoted(tx.QUERY_PUNCTUATION)}, '', 'g'), '{tx.QUESTION_WORDS}', '', 'g')), '\\s+'), lambda w: w <> ''), ' ')
    as terms from benchmark""",
)
def query_terms(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms"))


KEYWORDS = ["the", "que", "der", "tion", "and", "la"]


@query(
    "d25_keyword_score",
    "select doc_id, round(s / 6.0, 6) as score, s / 6.0 >= 0.3 as positive from (select doc_id, "
    + " + ".join(f"cast(instr(text, '{k}') > 1 as int)" for k in KEYWORDS)
    + " as s from documents)",
)
def keyword_score(spark, sf_dir):
    score = tx.keyword_score(F.col("text"), KEYWORDS)
    return _docs(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"), (score >= 0.3).alias("positive"))


@query(
    "d26_category_clean",
    f"""select distinct url, lower({_tones_sql("regexp_replace(regexp_replace(regexp_replace(url, '[–,&-]+', '', 'g'), '[/]+', ' ', 'g'), '\\s+', ' ', 'g')")}) as category
    from pages""",
)
def category_clean(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", tx.clean_category(F.col("url")).alias("category"))
    return pages.distinct()


def log_lines(events):
    """Combined-format access log lines made from the event table."""
    day = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    return F.concat(
        F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1 - u"), F.col("user_id").cast("string"),
        F.lit(" ["), day, F.lit(' +0000] "GET /'), F.col("event_type"), F.lit("/"),
        (F.col("event_id") % 7).cast("string"), F.lit(' HTTP/1.1" '), status, F.lit(" "),
        F.col("event_id").cast("string"), F.lit(' "-" "agent/'), (F.col("user_id") % 5).cast("string"), F.lit('"'),
    )


@query(
    "d27_log_parse",
    """select event_id, '10.0.' || (user_id % 256) || '.1' as ip, 'u' || user_id as "user",
    date_trunc('second', ts) as ts, 'GET' as method, '/' || event_type || '/' || (event_id % 7) as url,
    'HTTP/1.1' as protocol, case event_type when 'error' then 500 else 200 end as status, event_id as bytes,
    'agent/' || (user_id % 5) as agent from events""",
)
def log_parse(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    parsed = events.select("event_id", tx.parse_log(log_lines(events)).alias("l"))
    return parsed.select(
        "event_id", "l.ip", "l.user", "l.ts", "l.method", "l.url", "l.protocol", "l.status", "l.bytes", "l.agent"
    )


@query(
    "d28_slot_group",
    f"""with w as (select conv_id, turn, {WORDS.format('text')} as w from conversations),
    s as (select conv_id, turn, list_transform(w, lambda x: [substr(x, 1, 1), x]) as p from w),
    k as (select conv_id, turn, p, unnest(list_distinct(list_transform(p, lambda q: q[1]))) as slot from s)
    select conv_id, turn, slot, array_to_string(list_transform(list_filter(p, lambda q: q[1] = slot),
    lambda q: q[2]), ' ') as values from k where slot <> ':'""",
)
def slot_group(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.words(F.col("text")).alias("w"))
    pairs = F.transform("w", lambda x: F.concat_ws(": ", F.left(x, F.lit(1)), x))
    slots = turns.select("conv_id", "turn", F.explode(tx.group_slots(pairs)).alias("slot", "v"))
    return slots.select("conv_id", "turn", "slot", F.array_join("v", " ").alias("values"))


@query(
    "d29_concept_expand",
    f"""with b as (select {WORDS.format('lower(text)')} as w from benchmark),
    d as (select distinct word, concept from (select unnest(w[1:len(w)-1]) as word, unnest(w[2:len(w)]) as concept from b)),
    t as (select conv_id, turn, unnest(w) as t, generate_subscripts(w, 1) as i from (select conv_id, turn,
    {WORDS.format('text')} as w from conversations))
    select conv_id, turn, string_agg(concept, ' ' order by i, concept) as concepts
    from t join d on t.t = d.word where not contains(concept, t.t) group by 1, 2""",
)
def concept_expand(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(tx.words(F.lower("text")).alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("w", F.lit(1), n).alias("word"), F.slice("w", F.lit(2), n).alias("concept"))
    dictionary = items.select(F.inline(pairs)).toDF("word", "concept").distinct()
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.words(F.col("text")).alias("w"))
    out = features.expand_concepts(turns, ["conv_id", "turn"], "w", dictionary)
    return out.select("conv_id", "turn", F.array_join("concepts", " ").alias("concepts"))


PATTERN_WORDS = {"article": "the la le der die das el los un une", "joint": "of de von du and et und y"}
PATTERN_SHAPES = {"lower": ["lower"], "capital": ["capitalized"]}
PATTERN_RULES = {
    "linked": "lower joint article lower",
    "group": "article lower joint",
    "head": "capital article",
    "noun": "article lower",
}


@query("d30_token_regex")
def token_regex(spark, sf_dir):
    sentences = _sentences(spark, sf_dir).select("sent_id", tx.words(F.col("text")).alias("w"))
    classes = F.transform("w", lambda t: rules.token_classes(t, PATTERN_WORDS, {}, PATTERN_SHAPES))
    labels = rules.match_rules(F.col("w"), F.col("k"), PATTERN_RULES)
    out = unnest(sentences.withColumn("k", classes), ["sent_id"], F.arrays_zip("w", labels.alias("r")), "t", "pos")
    return out.select("sent_id", "pos", F.col("t.w").alias("token"), F.col("t.r").alias("rule")).filter("rule is not null")
