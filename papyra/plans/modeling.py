"""Queries for features and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions.rows import unnest, unnest_structs
from papyra.operators import curate, features, metrics, models, rules, segment
from papyra.plans.curation import SENTENCES_SQL
from papyra.plans.files import ENTITY_SQL, TAG_SQL, entity_of, tag_of
from papyra.plans.registry import query, spread, table
from papyra.plans.textual import (
    PATTERN_RULES,
    PATTERN_SHAPES,
    PATTERN_WORDS,
    TOKENS_SQL,
    WORDS,
    quoted,
    shape_sql,
)
from papyra.session import materialize, new_path
from papyra.sources import writers
from papyra.streaming import streams

WORD_ARRAY = WORDS.format("text")


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _doc_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w"))


def _turns(spark, sf_dir):
    """Turns as sentences: id and word array."""
    turns = spread(table(spark, sf_dir, "conversations"))
    rows = turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), tx.words(F.col("text")).alias("w"))
    return rows.filter("size(w) > 0")


def _turn_sentences(spark, sf_dir):
    turns = spread(table(spark, sf_dir, "conversations"))
    rows = unnest(turns, ["conv_id", "turn"], tx.split_sentences(F.col("text")), "text", "s")
    return rows.select(F.concat_ws("-", "conv_id", "turn", "s").alias("id"), "text")


TURNS_SQL = f"""turns as (select conv_id || '-' || turn as id, {WORD_ARRAY} as w from conversations),
    toks as (select id, unnest(w) as w, generate_subscripts(w, 1) as i from turns)"""


def _tagged_turns(spark, sf_dir):
    return _turns(spark, sf_dir).withColumn("tags", F.transform("w", lambda w: tag_of(w)))


# --- E: features ------------------------------------------------------------------------
@query(
    "e1_simple_tokenizers",
    f"""select doc_id, len(list_filter({WORDS.format('lower(text)')}, lambda w: length(w) >= 2)) as blanks,
    len(list_filter(string_split_regex(lower(text), '[\\s.,;:!?]+'), lambda w: w <> '')) as delimiters,
    len(regexp_extract_all(lower(text), '.')) as letters from documents""",
)
def simple_tokenizers(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id",
        F.size(features.tokenize_simple(t, min_length=2)).alias("blanks"),
        F.size(features.tokenize_simple(t, r"[\s.,;:!?]+")).alias("delimiters"),
        F.size(features.tokenize_simple(t, ".", gaps=False)).alias("letters"),
    )


STOP = ["the", "of", "de", "la", "der", "die", "and", "que", "le", "."]


@query(
    "e2_stop_words",
    f"""select doc_id, array_to_string(list_filter({WORD_ARRAY}, lambda w: lower(w) not in
    ({', '.join(quoted(s) for s in STOP)})), ' ') as kept from documents""",
)
def stop_words(spark, sf_dir):
    kept = features.remove_stopwords(F.col("w"), STOP)
    return _doc_words(spark, sf_dir).select("doc_id", F.array_join(kept, " ").alias("kept"))


@query(
    "e3_ngrams",
    f"""with w as (select {WORDS.format('lower(text)')} as w from documents),
    g as (select unnest(w[1:len(w)-1]) as a, unnest(w[2:len(w)]) as b from w)
    select a || ' ' || b as gram, count(*) as n from g group by 1""",
)
def ngrams(spark, sf_dir):
    words = _docs(spark, sf_dir).select(tx.words(F.lower("text")).alias("w"))
    grams = unnest(words, [], features.ngrams(F.col("w"), 2), "gram")
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


VOCAB_SQL = f"""{TOKENS_SQL}, c as (select doc_id, t as term, count(*) as n from t group by 1, 2),
    v as (select term, sum(n) as tf, count(*) as df from c group by 1 having count(*) >= 2),
    vocab as (select term, tf, df, row_number() over (order by tf desc, term) - 1 as term_id from v)"""


def _vocabulary(spark, sf_dir):
    return features.vocabulary(_doc_words(spark, sf_dir), "doc_id", "w", min_df=2)


@query("e4_vocabulary_counts", f"with {VOCAB_SQL} select doc_id, term_id, n from c join vocab using (term)")
def vocabulary_counts(spark, sf_dir):
    return features.count_vectorize(_doc_words(spark, sf_dir), "doc_id", "w", _vocabulary(spark, sf_dir))


@query("e4b_vocabulary", f"with {VOCAB_SQL} select term, tf, df, term_id from vocab")
def vocabulary_table(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


@query("e5_hashing_tf")
def hashing_tf(spark, sf_dir):
    return features.hash_tf(_doc_words(spark, sf_dir), "doc_id", "w", 1 << 15)


@query(
    "e6_tfidf",
    f"""with {TOKENS_SQL}, c as (select doc_id, t as term, count(*) as n from t group by 1, 2),
    d as (select term, count(*) as df from c group by 1), m as (select count(*) as m from documents)
    select doc_id, term, n, round(n * ln((m + 1.0) / (df + 1)), 6) as weight from c join d using (term), m""",
)
def tfidf(spark, sf_dir):
    return features.tfidf(_doc_words(spark, sf_dir), "doc_id", "w").withColumn("weight", F.round("weight", 6))


@query(
    "e7_index_onehot",
    """with r as (select l_returnflag, row_number() over (order by count(*) desc, l_returnflag) - 1 as flag from lineitem group by 1),
    s as (select l_linestatus, row_number() over (order by count(*) desc, l_linestatus) - 1 as status from lineitem group by 1),
    k as (select (select count(*) from r) as a, (select count(*) from s) as b)
    select l_returnflag, l_linestatus, cast(flag as double) as flag, cast(status as double) as status, a as flag_width,
    b as status_width, count(*) as n from lineitem join r using (l_returnflag) join s using (l_linestatus), k group by all""",
)
def index_onehot(spark, sf_dir):
    from pyspark.ml import Pipeline

    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    out = Pipeline(stages=models.index_onehot_stages(["l_returnflag", "l_linestatus"])).fit(rows).transform(rows)
    flag, status = vector_to_array("l_returnflag_vec"), vector_to_array("l_linestatus_vec")
    hot = out.select(
        "l_returnflag", "l_linestatus",
        (F.array_position(flag, 1.0) - 1).cast("double").alias("flag"),
        (F.array_position(status, 1.0) - 1).cast("double").alias("status"),
        F.size(flag).alias("flag_width"), F.size(status).alias("status_width"),
    )
    return hot.groupBy(*hot.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "e8_assemble_scale",
    """with s as (select stddev_samp(l_quantity) as a, stddev_samp(l_discount) as b from lineitem)
    select l_orderkey, l_linenumber, l_partkey, round(l_quantity / a, 6) as quantity, round(l_discount / b, 6) as discount
    from lineitem, s""",
)
def assemble_scale(spark, sf_dir):
    from pyspark.ml import Pipeline

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    out = Pipeline(stages=models.scale_stages(["l_quantity", "l_discount"])).fit(rows).transform(rows)
    x = vector_to_array("scaled")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(F.get(x, F.lit(0)), 6).alias("quantity"), F.round(F.get(x, F.lit(1)), 6).alias("discount"),
    )


@query(
    "e9_tagging_context",
    f"""with {TURNS_SQL}, s as (select *, {TAG_SQL.format('w')} as tag, nullif(nullif({shape_sql('w')}, ''), 'lower') as sh from toks),
    c as (select *, lag(w, 1, '$BOS') over p as pw, lead(w, 1, '$EOS') over p as nw, lead(sh) over p as ns,
    lag(w, 2, '$BOS') over p as p2w, lead(w, 2, '$EOS') over p as n2w, lag(tag, 1, '$BOS') over p as pt,
    lag(tag, 2, '$BOS') over p as pt2 from s window p as (partition by id order by i))
    select id, i as pos, concat_ws(' ', 'pw=' || pw, 'cw=' || w, 'nw=' || nw, 'cs=' || sh, 'ns=' || ns, 'p2w=' || p2w,
    'n2w=' || n2w, 'pt=' || pt, 'at=' || pt2, 'bt=' || pt2 || ';' || pt) as features from c""",
)
def tagging_context(spark, sf_dir):
    rows = _tagged_turns(spark, sf_dir)
    out = unnest(rows, ["id"], features.tag_context(F.col("w"), F.col("tags"), 2), "features", "i")
    return out.select("id", (F.col("i") + 1).alias("pos"), "features")


@query(
    "e10_entity_context",
    f"""with {TURNS_SQL}, s as (select *, {TAG_SQL.format('w')} as p, {ENTITY_SQL.format('w')} as t,
    nullif({shape_sql('w')}, '') as sh from toks),
    c as (select *, lag(t, 1, 'BOS') over o as t1, lag(t, 2, 'BOS') over o as t2, lag(w, 1, 'BOS') over o as w_1,
    lead(w, 1, 'EOS') over o as w1, lag(p, 1, 'BOS') over o as p_1, lead(p, 1, 'EOS') over o as p1
    from s window o as (partition by id order by i))
    select id, i as pos, concat_ws(' ', 'w(0)=' || w, 'p(0)=' || p, 'c(0)=O', 't(-1)=' || t1, 't(-2)=' || t2, 'shape=' || sh,
    'w(-1)=' || w_1, 'w(0)+w(-1)=' || w || '+' || w_1, 'w(+1)=' || w1, 'w(0)+w(+1)=' || w || '+' || w1,
    'p(-1)=' || p_1, 'p(0)+p(-1)=' || p || '+' || p_1, 'p(+1)=' || p1, 'p(0)+p(+1)=' || p || '+' || p1,
    'p(-1)+p(+1)=' || p_1 || '+' || p1, 'w(0)+t(-1)=' || w || '+' || t1) as features from c""",
)
def entity_context(spark, sf_dir):
    rows = _tagged_turns(spark, sf_dir).withColumn("ne", F.transform("w", lambda w: entity_of(w))).withColumn(
        "chunk", F.transform("w", lambda w: F.lit("O"))
    )
    made = features.entity_context(
        F.col("w"), F.col("tags"), F.col("chunk"), F.col("ne"), sets=("pos", "chunk", "shape", "joint")
    )
    out = unnest(rows, ["id"], made, "features", "i")
    return out.select("id", (F.col("i") + 1).alias("pos"), "features")


@query("e10b_entity_rule_context")
def entity_rule_context(spark, sf_dir):
    """Entity features with the token-pattern classes among them."""
    classes = F.transform("w", lambda t: rules.token_classes(t, PATTERN_WORDS, {}, PATTERN_SHAPES))
    rows = _tagged_turns(spark, sf_dir).withColumn("k", classes)
    rows = rows.withColumn("r", rules.match_rules(F.col("w"), F.col("k"), PATTERN_RULES))
    rows = rows.withColumn("ne", F.transform("w", lambda w: entity_of(w)))
    made = features.entity_context(F.col("w"), F.col("tags"), F.col("tags"), F.col("ne"), F.col("r"))
    return unnest(rows, ["id"], made, "features", "pos")


@query("e11_vowel_context")
def vowel_context(spark, sf_dir):
    return models.restoration_samples(_turn_sentences(spark, sf_dir), "id", "text")


SEQUENCE_SQL = f"""with {VOCAB_SQL}, w as (select doc_id, {WORD_ARRAY} as w from documents),
    h as (select doc_id, unnest({{slice}}) as term, generate_subscripts({{slice}}, 1) as i from w),
    k as (select doc_id, i, coalesce(term_id + {{base}}, {{unknown}}) as id from h left join vocab using (term)),
    g as (select doc_id, string_agg(cast(id as varchar), ' ' order by i) || repeat(' {{pad}}', cast({{length}} - count(*) as int)) as ids
    from k group by doc_id)
    select doc_id, coalesce(ids, trim(repeat(' {{pad}}', {{length}}))) as ids from documents left join g using (doc_id)"""


@query(
    "e13_index_sequence",
    SEQUENCE_SQL.format(slice="w[1:32]", base=1, unknown=1, pad=0, length=32),
)
def index_sequence(spark, sf_dir):
    out = features.to_index_sequence(
        _doc_words(spark, sf_dir), "doc_id", "w", _vocabulary(spark, sf_dir), 32, unknown=1, pad=0, base=1
    )
    return out.select("doc_id", F.array_join("ids", " ").alias("ids"))


@query(
    "e13b_index_sequence_tail",
    SEQUENCE_SQL.format(slice="w[greatest(len(w) - 31, 1):len(w)]", base=0, unknown=-1, pad=-1, length=32),
)
def index_sequence_tail(spark, sf_dir):
    out = features.to_index_sequence(
        _doc_words(spark, sf_dir), "doc_id", "w", _vocabulary(spark, sf_dir), 32, unknown=-1, pad=-1, keep="tail"
    )
    return out.select("doc_id", F.array_join("ids", " ").alias("ids"))


LABELS = ["N", "E", "V"]


@query(
    "e14_index_to_label",
    f"""with {TURNS_SQL} select id, string_agg(case when length(w) % 5 = 0 then 'N' when length(w) % 5 = 1 then 'E'
    when length(w) % 5 = 2 then 'V' else 'NA' end, ' ' order by i) as labels from toks group by id""",
)
def index_to_label(spark, sf_dir):
    ids = F.transform("w", lambda w: F.length(w) % 5)
    names = features.from_index_sequence(ids, LABELS)
    return _turns(spark, sf_dir).select("id", F.array_join(names, " ").alias("labels"))


@query(
    "e15_four_planes",
    f"""with t as (select doc_id, list_transform({WORD_ARRAY}, lambda x: length(x)) as a from documents)
    select doc_id, array_to_string(list_concat(list_concat(a, repeat_pad)[1:24], zeros,
    list_concat(range(0, least(len(a), 24)), repeat_pad)[1:24], list_concat(ones, zeros)[25 - least(len(a), 24) : 48 - least(len(a), 24)]), ' ') as planes
    from t, (select list_transform(range(0, 24), lambda x: cast(0 as bigint)) as repeat_pad,
    list_transform(range(0, 24), lambda x: cast(0 as bigint)) as zeros, list_transform(range(0, 24), lambda x: cast(1 as bigint)) as ones)""",
)
def four_planes(spark, sf_dir):
    planes = features.four_planes(F.transform("w", lambda w: F.length(w)), 24)
    return _doc_words(spark, sf_dir).select("doc_id", F.array_join(planes, " ").alias("planes"))


LETTERS_SQL = """letters as (select term, row_number() over (order by term) - 1 as term_id
    from (select distinct unnest(string_split(text, '')) as term from conversations))"""


def _letters(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("turn", F.split("text", "").alias("c"), F.monotonically_increasing_id().alias("k"))
    return features.vocabulary(rows, "k", "c")


@query(
    "e16_char_planes",
    f"""with {TURNS_SQL}, t as (select id, i - 1 as pos, w from toks where i <= 16),
    x as (select id, pos, 'first' as plane, substr(w, 1, 1) as letter from t
    union all select id, pos, 'middle', unnest(list_distinct(string_split(substr(w, 2, length(w) - 2), ''))) from t where length(w) > 2
    union all select id, pos, 'last', right(w, 1) from t where length(w) > 1)
    select id, pos, plane, count(*) as cells from x group by all""",
)
def char_planes(spark, sf_dir):
    cells = features.char_multihot(_turns(spark, sf_dir), "id", "w", _letters(spark, sf_dir), 16)
    return cells.groupBy("id", "pos", "plane").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "e16b_subtoken_ids",
    f"""with {TURNS_SQL}, u as (select id, flatten(list_transform(w, lambda x: [substr(x, 1, 1),
    case when length(x) > 2 then substr(x, 2, length(x) - 2) else '$NA' end, case when length(x) > 1 then right(x, 1) else '$NA' end])) as u from turns),
    v as (select term, row_number() over (order by count(*) desc, term) - 1 as term_id from (select unnest(u) as term from u) group by 1),
    h as (select id, unnest(u[1:48]) as term, generate_subscripts(u[1:48], 1) as i from u)
    select id, string_agg(cast(coalesce(term_id, 0) as varchar), ' ' order by i) || repeat(' 0', cast(48 - count(*) as int)) as ids
    from h left join v using (term) group by id""",
)
def subtoken_ids(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("u", tx.subtokens(F.col("w")))
    vocab = features.vocabulary(rows, "id", "u")
    out = features.to_index_sequence(rows, "id", "u", vocab, 48, unknown=0, pad=0)
    return out.select("id", F.array_join("ids", " ").alias("ids"))


@query(
    "e17_onehot_sequence",
    f"""with {VOCAB_SQL}, w as (select doc_id, {WORD_ARRAY} as w from documents),
    h as (select doc_id, unnest(w[1:32]) as term, generate_subscripts(w[1:32], 1) - 1 as pos from w)
    select doc_id, pos, term_id from h join vocab using (term)""",
)
def onehot_sequence(spark, sf_dir):
    return features.onehot_sequence(_doc_words(spark, sf_dir), "doc_id", "w", _vocabulary(spark, sf_dir), 32)


@query(
    "e18_vector_steps",
    """select vec_id, len(embedding) * 2 as stacked, cast(len(embedding) as double) as filled,
    (len(embedding) - 1) * len(embedding) // 2 as positions, list_position(embedding, list_min(embedding)) - 1 as smallest,
    100 as padded from embeddings""",
)
def vector_steps(spark, sf_dir):
    e = F.col("embedding")
    total = lambda a, kind: F.aggregate(a, F.lit(0).cast(kind), lambda x, y: x + y.cast(kind))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(features.stack(e, e)).alias("stacked"),
        total(features.fill(e, 1.0), "double").alias("filled"),
        total(features.positions(e), "long").alias("positions"),
        features.smallest_index(e).alias("smallest"),
        F.size(features.pad_to(e, 100, F.lit(0.0).cast("float"))).alias("padded"),
    )


@query(
    "e19_mention_set",
    f"""with {TURNS_SQL} select w as word, count(*) as n from toks where {ENTITY_SQL.format('w')} <> 'O' group by 1""",
)
def mention_set(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("l", F.transform("w", lambda w: entity_of(w)))
    return features.mentions(rows, "w", "l")


@query(
    "e20_embedding_merge",
    """with e as (select vec_id, embedding as a, list_reverse(embedding) as b from embeddings)
    select vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: (cast(z[1] as double) + cast(z[2] as double)) / 2)), 4) as mean_total,
    round((cast(a[1] as double) + cast(b[1] as double)) / 2, 6) as mean_first, len(a) * 2 as width from e""",
)
def embedding_merge(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    other = vectors.select("vec_id", F.reverse("a").alias("b"))
    both = vectors.join(other, "vec_id")
    mean = features.merge_embeddings([F.col("a"), F.col("b")], "mean")
    whole = features.merge_embeddings([F.col("a"), F.col("b")], "concat")
    return both.select(
        "vec_id",
        F.round(F.aggregate(mean, F.lit(0.0), lambda x, y: x + y), 4).alias("mean_total"),
        F.round(F.get(mean, F.lit(0)), 6).alias("mean_first"),
        F.size(whole).alias("width"),
    )




@query(
    "e21_select_labels",
    """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as s from embeddings),
    t as (select vec_id, s, list_filter(range(0, 64), lambda i: s[i + 1] >= 0.2) as hit from e)
    select vec_id, array_to_string(case when len(hit) > 0 then hit else [list_position(s, list_max(s)) - 1] end, ' ') as chosen,
    array_to_string(list_transform(range(0, 64), lambda i: cast(list_contains(case when len(hit) > 0 then hit
    else [cast(list_position(s, list_max(s)) - 1 as bigint)] end, i) as int)), ',') as flags from t""",
)
def select_labels(spark, sf_dir):
    chosen = features.select_labels(F.col("embedding").cast("array<double>"), 0.2)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", chosen.alias("c"))
    return rows.select("vec_id", F.array_join("c", " ").alias("chosen"), features.flag_csv(F.col("c"), 64).alias("flags"))


@query(
    "e21b_top_k_labels",
    """with e as (select vec_id, unnest(embedding) as s, generate_subscripts(embedding, 1) - 1 as i from embeddings),
    r as (select *, row_number() over (partition by vec_id order by cast(s as double) desc, i) as r from e)
    select vec_id, string_agg(cast(i as varchar), ' ' order by r) as chosen from r where r <= 3 and (cast(s as double) >= 0.1 or r = 1)
    group by vec_id""",
)
def top_k_labels(spark, sf_dir):
    chosen = features.select_labels(F.col("embedding").cast("array<double>"), 0.1, k=3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(chosen, " ").alias("chosen"))


@query(
    "e23_majority_sentiment",
    f"""with t as (select doc_id, {TAG_SQL.format('t')} as tag from ({'select doc_id, unnest(' + WORD_ARRAY + ') as t from documents'})),
    c as (select doc_id, tag, row_number() over (partition by doc_id order by count(*) desc, tag) as r from t group by 1, 2)
    select d.doc_id, coalesce(c.tag, 'NA') as majority from documents d left join c on d.doc_id = c.doc_id and r = 1""",
)
def majority_sentiment(spark, sf_dir):
    rows = _doc_words(spark, sf_dir).withColumn("tags", F.transform("w", lambda w: tag_of(w)))
    return features.majority(rows, ["doc_id"], "tags")


@query(
    "e23b_comment_samples",
    f"""with {TURNS_SQL}, c as (select id, {TAG_SQL.format('w')} as tag, count(*) as n from toks group by all),
    b as (select id, arg_max(tag, (n, case tag when 'E' then 3 when 'N' then 2 else 1 end)) as sentiment from c group by id)
    select id, concat_ws(' ', id, array_to_string(w, ' ')) as text, sentiment from turns join b using (id) where sentiment <> 'E'""",
)
def comment_samples(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(
        "id", F.col("id").alias("post"), F.array(F.array_join("w", " ")).alias("comments"),
        F.array(F.transform("w", lambda w: tag_of(w))).alias("votes"),
    )
    return features.comment_samples(rows, ["id"], "post", "comments", "votes", dropped=("NA", "E"))


@query(
    "e24_relative_head",
    f"""with {TURNS_SQL} select id, string_agg(case when i = 1 then '0:root' else '-1:' || {TAG_SQL.format('w')} end, ' ' order by i) as offsets
    from toks group by id having count(*) between 5 and 80""",
)
def relative_head(spark, sf_dir):
    rows = _tagged_turns(spark, sf_dir).filter("size(w) between 5 and 80")
    ids = F.transform("w", lambda _, i: i + 1)
    heads = F.transform("w", lambda _, i: i)
    labels = F.transform("tags", lambda t, i: F.when(i == 0, "root").otherwise(t))
    return rows.select("id", F.array_join(features.head_offsets(ids, heads, labels), " ").alias("offsets"))


@query(
    "e25_word_sets_by_tag",
    f"select distinct tag, word from (select {TAG_SQL.format('t')} as tag, lower(t) as word from "
    f"(select unnest({WORD_ARRAY}) as t from documents)) where tag in ('N', 'V')",
)
def word_sets_by_tag(spark, sf_dir):
    tokens = unnest(_doc_words(spark, sf_dir), [], "w", "t").withColumn("tag", tag_of(F.col("t")))
    return features.words_by_tag(tokens, "t", "tag", ["N", "V"])


@query(
    "e26_filtered_vocabulary",
    f"""with {VOCAB_SQL} select term, tf, df from vocab where length(term) > 1 and not contains(term, '''')
    and not regexp_full_match(term, '[+-]?([0-9]*)?[0-9]+([.,]\\d+)*%?')
    and not regexp_full_match(term, {quoted(tx.QUERY_PUNCTUATION)})""",
)
def filtered_vocabulary(spark, sf_dir):
    return features.clean_vocabulary(_vocabulary(spark, sf_dir)).select("term", "tf", "df")


@query(
    "e27_sliding_id_windows",
    f"""with s as (select doc_id, unnest(list_append({WORD_ARRAY}, '<eos>')) as w,
    generate_subscripts(list_append({WORD_ARRAY}, '<eos>'), 1) as i from documents),
    g as (select length(w) as id, row_number() over (order by doc_id, i) - 1 as n from s),
    x as (select n // 20 as win, n, id from g union all select n // 20 - 1, n, id from g where n % 20 = 0 and n > 0)
    select win as "window", string_agg(cast(id as varchar), ' ' order by n) as ids from x group by win having count(*) = 21""",
)
def sliding_id_windows(spark, sf_dir):
    stream = _doc_words(spark, sf_dir).select(
        "doc_id", F.transform(F.concat("w", F.array(F.lit("<eos>"))), lambda w: F.length(w)).alias("ids")
    )
    return features.lm_windows(stream, "doc_id", "ids", 20).select("window", F.array_join("ids", " ").alias("ids"))


# --- F: models -----------------------------------------------------------------------------
TOLERANCE = 5e-2  # of the loss, between two iterations of the sparse fits


def _labelled(spark, sf_dir, label="quality"):
    return models.labelled_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label)


@query("f1_text_classifier")
def text_classifier(spark, sf_dir):
    """Three classifiers on the labelled documents, with their training scores."""
    rows = _labelled(spark, sf_dir)
    out = []
    for kind in ("count-logistic", "hash-perceptron", "hash-forest"):
        model = models.fit_text_classifier(rows, kind, features=1024, iterations=10, tolerance=TOLERANCE)
        scores = metrics.multiclass_scores(models.predict_labels(rows, model), "category", "prediction")
        out.append(scores.withColumn("kind", F.lit(kind)))
    return curate.union_all(out)


@query("f2_predict_with_probability")
def predict_with_probability(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    model = models.fit_text_classifier(rows, "hash-forest", features=1024)
    out = models.predict_labels(rows, model)
    return out.select("id", "category", "prediction", F.round("probability", 6).alias("probability"))


@query("f3_sentiment")
def sentiment(spark, sf_dir):
    """Area under the curve of both sentiment models on the toxic label."""
    rows, out = _labelled(spark, sf_dir, "toxic"), []
    for kind in ("tfidf-logistic", "tfidf-perceptron"):
        scored = models.score_column(rows, models.fit_sentiment(rows, kind, features=1024, iterations=10, tolerance=TOLERANCE))
        out.append(metrics.auc(scored, "label", "score").withColumn("kind", F.lit(kind)))
    return curate.union_all(out)


@query("f4_tabular_classifiers")
def tabular_classifiers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"
    )
    rows = orders.select(
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_orderpriority", "c_mktsegment", "o_totalprice", "c_acctbal"
    )
    rows, kinds, out = materialize(rows, "rows"), ["logistic", "perceptron"], []
    for kind, model in zip(kinds, models.fit_tabulars(rows, "y", ["o_orderpriority", "c_mktsegment"], kinds, iterations=10), strict=True):
        out.append(metrics.auc(models.score_column(rows, model), "y", "score").withColumn("kind", F.lit(kind)))
    return curate.union_all(out)


@query("f5_topic_model")
def topic_model(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return models.topic_terms(docs, models.fit_topics(docs, "text", k=4, features=1024, iterations=5), 8)


@query("f5b_topic_distribution")
def topic_distribution(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    out = models.topic_distribution(docs, "text", models.fit_topics(docs, "text", k=4, features=1024, iterations=5))
    return out.select("doc_id", F.transform("topics", lambda p: F.round(p, 4)).cast("string").alias("topics"))


@query("f6_word_vectors")
def word_vectors(spark, sf_dir):
    model = models.fit_word_vectors(_docs(spark, sf_dir), "text", size=16)
    return models.synonyms(model, "the", 10).select("word", F.round("similarity", 4).alias("similarity"))


def _tag_rows(spark, sf_dir, reverse=False):
    rows = _tagged_turns(spark, sf_dir)
    if reverse:
        rows = rows.select("id", F.reverse("w").alias("w"), F.reverse("tags").alias("tags"))
    made = features.tag_context(F.col("w"), F.col("tags"), 2)
    pairs = F.arrays_zip(made.alias("features"), F.col("tags").alias("label"))
    return unnest(rows, ["id"], pairs, "t", "pos").select("id", "pos", "t.features", "t.label")


@query("f7_sequence_tag_training")
def sequence_tag_training(spark, sf_dir):
    """Training accuracy of a forward and a backward tagger."""
    out = []
    for reverse in (False, True):
        rows = _tag_rows(spark, sf_dir, reverse)
        model = models.fit_sparse_tagger(rows, tolerance=TOLERANCE)
        tagged = models.predict_sparse(rows, ["id", "pos"], lambda r: models.feature_counts(F.col("features")), model)
        right = tagged.agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))
        out.append(right.select(F.round("accuracy", 4).alias("accuracy"), F.lit("backward" if reverse else "forward").alias("direction")))
    return curate.union_all(out)


@query("f8_greedy_tag_decoding")
def greedy_tag_decoding(spark, sf_dir):
    model = models.fit_sparse_tagger(_tag_rows(spark, sf_dir), tolerance=TOLERANCE)
    rows = _turns(spark, sf_dir).withColumn("shapes", features.useful_shapes(F.col("w")))
    static = features.tag_context(F.col("w"), None, 0, shapes=F.col("shapes"))
    out = models.greedy_tag_sparse(rows, static, model)
    return unnest(out, ["id"], "tags", "tag", "pos")


PATH_SQL = """s as (select vec_id, (i - 1) // 4 as pos, (i - 1) % 4 as label, cast(e as double) as score from (
    select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) as i from embeddings))"""


def _score_rows(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "score")
    )
    return cells.select("vec_id", F.floor(F.col("i") / 4).alias("pos"), (F.col("i") % 4).alias("label"), "score")


@query(
    "f9_lattice_decoding",
    f"""with {PATH_SQL}, r as (select *, row_number() over (partition by vec_id, pos order by score desc, label) as r from s)
    select vec_id, pos, label, round(score, 6) as score from r where r = 1""",
)
def lattice_decoding(spark, sf_dir):
    return models.best_path(_score_rows(spark, sf_dir), "vec_id", "pos", "label", "score").withColumn(
        "score", F.round("score", 6)
    )


def _beam_sql(positions: int, k: int) -> str:
    """One step per position: lengthen the kept paths by every label, keep the best ``k``."""
    steps = ["b0 as (select distinct vec_id, 0.0 as total, '' as path, 1 as place0 from s)"]
    for j in range(positions):
        order = "b.total + s.score desc, path || ' ' || label"
        steps.append(
            f"b{j + 1} as (select vec_id, b.total + s.score as total, trim(path || ' ' || label) as path, "
            f"row_number() over (partition by vec_id order by {order}) as place{j + 1} "
            f"from b{j} b join s using (vec_id) where s.pos = {j} qualify place{j + 1} <= {k})"
        )
    return ", ".join(steps) + (
        f" select vec_id, place{positions} - 1 as rank, round(total, 6) as score, path from b{positions}"
    )


@query("f9b_beam_decoding", f"with {PATH_SQL}, {_beam_sql(16, 3)}")
def beam_decoding(spark, sf_dir):
    scores = tx.chunk_array(F.col("embedding").cast("array<double>"), 4)
    paths = unnest(table(spark, sf_dir, "embeddings"), ["vec_id"], models.beam(scores, 3), "p", "rank")
    return paths.select("vec_id", "rank", F.round("p.score", 6).alias("score"), F.array_join("p.path", " ").alias("path"))


FORWARD_SQL = "case when regexp_matches(w, '^[A-H]') then 'B-ORG' when regexp_matches(w, '^[I-P]') then 'B-PER' else 'O' end"
BACKWARD_SQL = "case when regexp_matches(w, '^[E-R]') then 'B-LOC' when length(w) > 12 then 'I-ORG' else 'O' end"


def _directions(spark, sf_dir):
    forward = F.transform("w", lambda w: F.when(w.rlike("^[A-H]"), "B-ORG").when(w.rlike("^[I-P]"), "B-PER").otherwise("O"))
    backward = F.transform("w", lambda w: F.when(w.rlike("^[E-R]"), "B-LOC").when(F.length(w) > 12, "I-ORG").otherwise("O"))
    return _turns(spark, sf_dir).withColumn("fwd", forward).withColumn("bwd", backward)


@query(
    "f10_forward_backward_merge",
    f"""with {TURNS_SQL}, t as (select id, i, {FORWARD_SQL} as f, {BACKWARD_SQL} as b from toks)
    select id, string_agg(case when ends_with(b, 'LOC') and not ends_with(f, 'ORG') then b else f end, ' ' order by i) as tags
    from t group by id""",
)
def forward_backward_merge(spark, sf_dir):
    merged = models.merge_directions(F.col("fwd"), F.col("bwd"))
    return _directions(spark, sf_dir).select("id", F.array_join(merged, " ").alias("tags"))


RUNS_SQL = f"""{TURNS_SQL}, t as (select id, i, w, case when regexp_matches(w, '^[A-M]') then 'B-ORG'
    when length(w) > 8 then 'I-ORG' else 'O' end as tag from toks),
    r as (select *, sum(cast(tag = 'O' or starts_with(tag, 'B-') as int)) over (partition by id order by i) as run from t)"""


@query(
    "f11_entity_extraction",
    f"""with {RUNS_SQL} select id, min(i) - 1 as start, string_agg(w, ' ' order by i) as entity, 'ORG' as type
    from r group by id, run having min_by(tag, i) = 'B-ORG'""",
)
def entity_extraction(spark, sf_dir):
    tags = F.transform("w", lambda w: F.when(w.rlike("^[A-M]"), "B-ORG").when(F.length(w) > 8, "I-ORG").otherwise("O"))
    rows = _turns(spark, sf_dir).withColumn("tags", tags)
    out = unnest_structs(rows, ["id"], models.extract_entities(F.col("w"), F.col("tags")))
    return out.select("id", "start", "entity", "type")


def _graphs(spark, sf_dir):
    """Toy treebank: a word hangs on the nearest capitalised word before it, else on the previous word."""
    def token(w, i):
        return F.struct(
            (i + 1).cast("string").alias("id"), w.alias("word"), F.lower(w).alias("lemma"), tag_of(w).alias("upos"),
            tag_of(w).alias("pos"), F.lit("_").alias("feats"),
            F.when(i == 0, F.lit("0")).when(tag_of(w) == "E", (i + 2).cast("string")).otherwise(i.cast("string")).alias("head"),
            F.when(i == 0, "root").otherwise(F.lower(tag_of(w))).alias("label"), F.lit("_").alias("supertag"),
        )

    root = F.struct(
        F.lit("0").alias("id"), *[F.lit("ROOT").alias(c) for c in ("word", "lemma", "upos", "pos", "feats")],
        F.lit("-1").alias("head"), F.lit("ROOT").alias("label"), F.lit("ROOT").alias("supertag"),
    )
    sentences = _turn_sentences(spark, sf_dir).select(F.col("id").alias("sent_id"), tx.words(F.col("text")).alias("w"))
    return sentences.select("sent_id", F.concat(F.array(root), F.transform("w", token)).alias("tokens"))


@query("f12_transition_samples")
def transition_samples(spark, sf_dir):
    return models.transition_samples(_graphs(spark, sf_dir))


@query(
    "f13_attachment_rules",
    f"""with {TURNS_SQL}, t as (select *, {TAG_SQL.format('w')} as tag from toks),
    n as (select *, lead(tag) over (partition by id order by i) as nt from t)
    select id, i as dependent, i + 1 as head, case when tag = 'E' and w in ('the', 'la', 'le', 'der') and nt = 'V' then 'det'
    else 'case' end as label from n where (tag = 'E' and w in ('the', 'la', 'le', 'der') and nt = 'V')
    or (tag = 'E' and w in ('of', 'de', 'von') and nt = 'N')""",
)
def attachment_rules(spark, sf_dir):
    wanted = [("E", "the la le der", "V", "det"), ("E", "of de von", "N", "case")]
    arcs = models.attach_rules(F.col("w"), F.col("tags"), wanted)
    return unnest_structs(_tagged_turns(spark, sf_dir), ["id"], arcs)


@query("f14_batch_parse")
def batch_parse(spark, sf_dir):
    """Attachment scores of a parser trained and run on the toy treebank."""
    graphs = _graphs(spark, sf_dir)
    samples = models.transition_samples(graphs)
    model = models.fit_tagger(samples, label="transition", size=4096, min_df=2, iterations=8)
    predicted = models.parse_batch(graphs, models.LinearTagger.of(model))
    gold = graphs.select("sent_id", F.explode("tokens").alias("t")).filter("t.id <> '0'").select(
        "sent_id", "t.id", "t.head", "t.label"
    )
    scores = metrics.attachment_scores(gold, predicted)
    return scores.select("tokens", F.round("uas", 3).alias("uas"), F.round("las", 3).alias("las"))


@query("f15_diacritic_restoration")
def diacritic_restoration(spark, sf_dir):
    """Two best accented readings of each sentence of the conversations."""
    sentences = _turn_sentences(spark, sf_dir).select("id", F.lower("text").alias("text"))
    samples = models.restoration_samples(sentences, "id", "text")
    model = models.fit_tagger(samples, size=4096, min_df=2, iterations=8)
    return models.restore_diacritics(sentences, "id", "text", models.LinearTagger.of(model), k=2)


@query(
    "f16_pair_baseline",
    f"""with {VOCAB_SQL}, p as (select conv_id || '-' || turn as id, {WORD_ARRAY} as w from conversations),
    h as (select id, unnest(w[1:16]) as term, generate_subscripts(w[1:16], 1) as i from p),
    k as (select id, i, coalesce(term_id + 1, 1) as t from h left join vocab using (term)),
    g as (select id, string_agg(cast(t as varchar), ' ' order by i) || repeat(' 1', cast(16 - count(*) as int)) as ids from k group by id)
    select id, ids || ' ' || ids as features from g""",
)
def pair_baseline(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("v", F.col("w"))
    out = models.pair_features(rows, "id", "w", "v", _vocabulary(spark, sf_dir), 16, "bow")
    return out.select("id", F.array_join("features", " ").alias("features"))


@query("f16b_pair_concepts")
def pair_concepts(spark, sf_dir):
    """Pairs of turns with the concepts of their words, here the terms of equal first letters and length."""
    vocab = materialize(_vocabulary(spark, sf_dir), "vocab")
    signature = F.concat_ws("-", F.substring("term", 1, 3), F.length("term"))
    heads = vocab.groupBy(signature.alias("sig")).agg(F.min("term").alias("concept"))
    dictionary = vocab.select(F.col("term").alias("word"), signature.alias("sig")).join(heads, "sig").select("word", "concept")
    rows = _turns(spark, sf_dir).withColumn("v", F.reverse("w"))
    out = models.pair_features(rows, "id", "w", "v", vocab, 8, "concept", dictionary)
    return out.select("id", F.array_join("features", " ").alias("features"))


KEYS = ["the", "que", "der", "tion", "and", "la"]
SCORE_SQL = "(" + " + ".join(f"cast(instr(text, '{k}') > 1 as int)" for k in KEYS) + ") / 6.0"


@query(
    "f17_stream_rule_filter",
    f"""select conv_id, turn, case when {SCORE_SQL} >= 0.3 then 'positive' else 'negative' end as route from conversations""",
)
def stream_rule_filter(spark, sf_dir):
    messages = streams.table_stream(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return streams.append_to_table(streams.with_route(messages, "text", KEYS).select("conv_id", "turn", "route"))


@query(
    "f18_class_remap",
    """select p_partkey, case split_part(p_type || ',x', ',', 1) when 'ECONOMY' then 'BASIC' when 'PROMO' then 'SPECIAL'
    else p_type end as class from part""",
)
def class_remap(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit(",x")).alias("class"))
    return models.remap_classes(parts, "class", {"ECONOMY": "BASIC", "PROMO": "SPECIAL"})
