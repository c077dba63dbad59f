"""Queries for scores and experiment summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import metrics, search
from papyra.plans.files import ENTITY_SQL, TAG_SQL, entity_of, tag_of
from papyra.plans.modeling import TURNS_SQL, _tagged_turns, _turns
from papyra.plans.registry import query, spread, table
from papyra.plans.retrieval import BENCH_QUERIES_SQL, SEARCH_SQL, TERMS, bench_queries, stored_index
from papyra.plans.textual import WORDS

WORD_ARRAY = WORDS.format("text")

# rule predictions of document quality: long documents with few capitals at line starts are good
RULE_SQL = "case when n_chars > 900 then 2 when n_chars > 300 then 1 else 0 end"
PAIRS_SQL = f"""p as (select l.quality + l.toxic as y, {RULE_SQL} as z from documents d join labels l using (doc_id))"""


def _pairs(spark, sf_dir):
    rule = F.when(F.col("n_chars") > 900, 2).when(F.col("n_chars") > 300, 1).otherwise(0)
    docs = table(spark, sf_dir, "documents").select("doc_id", rule.alias("z"), "n_chars")
    labels = table(spark, sf_dir, "labels").withColumn("y", F.col("quality") + F.col("toxic"))
    return docs.join(labels, "doc_id").select("doc_id", "y", "z", "quality", "n_chars")


LABEL_SQL = f"""with {PAIRS_SQL}, k as (select y as label from p union select z from p),
    s as (select label, (select count(*) from p where y = label) as support, (select count(*) from p where z = label) as guessed,
    (select count(*) from p where y = label and z = label) as tp from k),
    r as (select label, support, case when guessed > 0 then tp / guessed else 0 end as p, case when support > 0 then tp / support else 0 end as r from s)"""


@query(
    "g1_multiclass_scores",
    LABEL_SQL + """, f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from r)
    select round(sum(r * support) / sum(support), 6) as accuracy, round(sum(p * support) / sum(support), 6) as weighted_precision,
    round(sum(r * support) / sum(support), 6) as weighted_recall, round(sum(f * support) / sum(support), 6) as weighted_f from f""",
)
def multiclass_scores(spark, sf_dir):
    out = metrics.multiclass_scores(_pairs(spark, sf_dir), "y", "z")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "g1b_label_scores",
    LABEL_SQL + """ select label, support, round(p, 6) as precision, round(r, 6) as recall,
    round(case when p + r > 0 then 1.25 * p * r / (0.25 * p + r) else 0 end, 6) as f from r""",
)
def label_scores(spark, sf_dir):
    out = metrics.label_scores(_pairs(spark, sf_dir), "y", "z", beta=0.5)
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query("g1c_confusion", f"with {PAIRS_SQL} select y as label, z as prediction, count(*) as n from p group by 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(_pairs(spark, sf_dir), "y", "z")


@query(
    "g1d_masked_accuracy",
    f"""with {TURNS_SQL}, t as (select id, length(w) % 4 as y, length(w) * 3 % 4 as z from toks)
    select y as label, z as prediction, count(*) as n from t group by 1, 2""",
)
def masked_accuracy(spark, sf_dir):
    """Token labels padded with -1; the padding does not count."""
    pad = F.array_repeat(F.lit(-1.0), 8)
    rows = _turns(spark, sf_dir).select(
        F.concat(F.transform("w", lambda w: (F.length(w) % 4).cast("double")), pad).alias("gold"),
        F.concat(F.transform("w", lambda w: (F.length(w) * 3 % 4).cast("double")), pad).alias("guess"),
    )
    return metrics.confusion(metrics.masked_pairs(rows, "gold", "guess"), "label", "prediction")


SETS_SQL = f"""w as (select doc_id, {WORD_ARRAY} as w from documents), s as (select doc_id,
    list_distinct(list_transform(w, lambda x: {TAG_SQL.format('x')})) as ys,
    list_distinct(list_transform(w, lambda x: case when length(x) > 9 then 'V' when contains(x, '.') then 'N' else 'E' end)) as zs from w)"""


def _label_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    guess = F.transform("w", lambda x: F.when(F.length(x) > 9, "V").when(x.contains("."), "N").otherwise("E"))
    gold = F.transform("w", lambda x: tag_of(x))
    return docs.select("doc_id", F.array_distinct(gold).alias("ys"), F.array_distinct(guess).alias("zs"))


@query(
    "g2_multilabel_scores",
    f"""with {SETS_SQL}, c as (select len(list_intersect(ys, zs)) as b, len(ys) as a, len(zs) as c from s),
    m as (select avg(cast(b = a and b = c as int)) as subset_accuracy,
    avg(case when a + c - b > 0 then b / (a + c - b) else 0 end) as accuracy,
    avg(case when a + c > 0 then 2 * b / (a + c) else 0 end) as f1, sum(b) / sum(c) as p, sum(b) / sum(a) as r from c)
    select round(subset_accuracy, 6) as subset_accuracy, round(accuracy, 6) as accuracy, round(f1, 6) as f1,
    round(p, 6) as micro_precision, round(r, 6) as micro_recall, round(2 * p * r / (p + r), 6) as micro_f1 from m""",
)
def multilabel_scores(spark, sf_dir):
    out = metrics.multilabel_scores(_label_sets(spark, sf_dir), "ys", "zs")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "g2b_multilabel_label_scores",
    f"""with {SETS_SQL}, y as (select doc_id, unnest(ys) as label from s), z as (select doc_id, unnest(zs) as label from s),
    j as (select coalesce(y.label, z.label) as label, y.doc_id is not null as g, z.doc_id is not null as p
    from y full join z on y.doc_id = z.doc_id and y.label = z.label),
    c as (select label, sum(cast(g and p as int)) as tp, sum(cast(g as int)) as g, sum(cast(p as int)) as p from j group by 1)
    select label, round(case when p > 0 then tp / p else 0 end, 6) as precision, round(case when g > 0 then tp / g else 0 end, 6) as recall,
    round(case when tp > 0 then 2 * (tp / p) * (tp / g) / (tp / p + tp / g) else 0 end, 6) as f from c""",
)
def multilabel_label_scores(spark, sf_dir):
    out = metrics.multilabel_label_scores(_label_sets(spark, sf_dir), "ys", "zs")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(
    "g3_auc",
    """with p as (select quality as y, n_chars as s from documents join labels using (doc_id)),
    r as (select y, s, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from p)
    select round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) as auc from r""",
)
def auc(spark, sf_dir):
    return metrics.auc(_pairs(spark, sf_dir), "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


GUESS_SQL = "case when regexp_matches({0}, '^\\p{{Lu}}') and length({0}) > 4 then 'B-X' else 'O' end"
ENTITY_ROWS_SQL = f"""{TURNS_SQL}, t as (select id, i, {ENTITY_SQL.format('w')} as g0, {GUESS_SQL.format('w')} as p0 from toks),
    l as (select *, lag(g0, 1, 'O') over o as g1, lag(p0, 1, 'O') over o as p1 from t window o as (partition by id order by i)),
    e as (select id, i, case when g0 = 'B-X' and g1 = 'B-X' then 'I-X' else g0 end as g,
    case when p0 = 'B-X' and p1 = 'B-X' then 'I-X' else p0 end as p from l)"""


def _entity_rows(spark, sf_dir):
    """Runs of capitalised words as entities; the guess misses short words."""
    rows = _turns(spark, sf_dir)
    cap = lambda w: w.rlike(r"\A\p{Lu}")
    long_cap = lambda w: cap(w) & (F.length(w) > 4)

    def tags(test):
        return F.transform(
            "w",
            lambda w, i: F.when(~test(w), "O")
            .when((i > 0) & test(F.get("w", i - 1)), "I-X")
            .otherwise("B-X"),
        )

    return rows.select("id", tags(cap).alias("gold"), tags(long_cap).alias("guess"))


@query(
    "g4_entity_scores",
    f"""with {ENTITY_ROWS_SQL}, gs as (select id, i, g, sum(cast(g <> 'I-X' as int)) over (partition by id order by i) as r from e),
    ps as (select id, i, p, sum(cast(p <> 'I-X' as int)) over (partition by id order by i) as r from e),
    a as (select id, min(i) as s, max(i) as t from gs where g <> 'O' group by id, r),
    b as (select id, min(i) as s, max(i) as t from ps where p <> 'O' group by id, r),
    c as (select (select count(*) from a) as gold, (select count(*) from b) as guess,
    (select count(*) from a join b using (id, s, t)) as hit, (select avg(cast(g = p as int)) from e) as acc),
    k as (select unnest(['X', 'ALL']) as type)
    select type, gold, guess, hit, round(hit / guess, 6) as precision, round(hit / gold, 6) as recall,
    round(2 * (hit / guess) * (hit / gold) / (hit / guess + hit / gold), 6) as f1,
    case when type = 'ALL' then round(acc, 6) end as token_accuracy from c, k""",
)
def entity_scores(spark, sf_dir):
    out = metrics.entity_scores(_entity_rows(spark, sf_dir), "gold", "guess")
    return out.select(
        "type", "gold", "guess", "hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "token_accuracy")]
    )


@query(
    "g5_token_recall",
    f"with {ENTITY_ROWS_SQL} select g as label, count(*) as tokens, round(avg(cast(g = p as int)), 6) as recall from e group by 1",
)
def token_recall(spark, sf_dir):
    return metrics.token_recall(_entity_rows(spark, sf_dir), "gold", "guess").withColumn("recall", F.round("recall", 6))


EDGES_SQL = f"""{TURNS_SQL}, g as (select id as sent, i as id, i - 1 as head, {TAG_SQL.format('w')} as label, count(*) over (partition by id) as n from toks),
    p as (select sent, id, case when id % 7 = 0 then (case when id - 3 < 1 or id - 3 > n then 0 else id - 3 end) else id - 1 end as head,
    case when id % 5 = 0 then 'V' else label end as label from g)"""


@query(
    "g6_attachment_scores",
    f"""with {EDGES_SQL} select count(*) as tokens, round(avg(cast(g.head = p.head as int)), 6) as uas,
    round(avg(cast(g.head = p.head and g.label = p.label as int)), 6) as las from g join p using (sent, id)
    where g.label <> 'E'""",
)
def attachment_scores(spark, sf_dir):
    """Predicted heads are shifted at every seventh token, labels replaced at every fifth."""
    rows = _tagged_turns(spark, sf_dir)
    tokens = rows.select("id", F.size("w").alias("n"), F.posexplode("tags").alias("i", "tag"))
    token = F.col("i") + 1
    gold = tokens.select(
        F.col("id").alias("sent_id"), token.alias("id"), F.col("i").alias("head"), F.col("tag").alias("label"), F.col("tag").alias("pos")
    )
    offset = F.when(token % 7 == 0, F.lit(-3)).otherwise(F.lit(-1))
    guess = tokens.select(
        F.col("id").alias("sent_id"), token.alias("id"),
        metrics.head_of_offset(offset, token, F.col("n")).alias("head"),
        F.when(token % 5 == 0, "V").otherwise(F.col("tag")).alias("label"),
    )
    out = metrics.attachment_scores(gold, guess, punctuation="E")
    return out.select("tokens", F.round("uas", 6).alias("uas"), F.round("las", 6).alias("las"))


FROM, TO = "".join(tx.ACCENTED), "".join(map(tx._bare_letter, tx.ACCENTED))


@query(
    "g7_char_token_accuracy",
    f"""with d as (select text as g, translate(text, '{FROM}', '{TO}') as p from documents),
    c as (select unnest(string_split(g, '')) as g, unnest(string_split(p, '')) as p from d),
    w as (select unnest({WORDS.format('g')}) as g, unnest({WORDS.format('p')}) as p from d)
    select (select round(avg(cast(g = p as int)), 6) from c where trim(g) <> '') as char_accuracy,
    (select round(avg(cast(g = p as int)), 6) from w) as token_accuracy""",
)
def char_token_accuracy(spark, sf_dir):
    """Accuracy of text whose lower-case accents are gone."""
    docs = spread(table(spark, sf_dir, "documents").select("text")).select(
        F.col("text").alias("g"), F.translate("text", FROM, TO).alias("p")
    )
    chars = metrics.char_accuracy(docs, "g", "p").select(F.round("char_accuracy", 6).alias("char_accuracy"))
    words = docs.select(tx.words(F.col("g")).alias("g"), tx.words(F.col("p")).alias("p"))
    tokens = metrics.token_accuracy(words, "g", "p")
    return chars.withColumn("token_accuracy", F.round(tokens.scalar(), 6))


@query(
    "g8_reciprocal_rank",
    f"""with {BENCH_QUERIES_SQL}, {SEARCH_SQL}, best as (select * from ranked where rank <= 10),
    gold as (select distinct b.item_id as qid, d.doc_id from benchmark b join documents d on contains(d.text, b.text)
    where len({TERMS.format('b.text')}) > 0),
    f as (select qid, min(rank) as r from best join gold using (qid, doc_id) where rank <= 5 group by qid)
    select count(*) as queries, count(r) as found, round(avg(coalesce(1.0 / r, 0)), 6) as mrr
    from (select distinct qid from gold) left join f using (qid)""",
)
def reciprocal_rank(spark, sf_dir):
    """Relevant documents are those that hold a benchmark passage word for word."""
    index = stored_index(spark, sf_dir)
    ranked = search.and_search(index, bench_queries(spark, sf_dir), 10)
    gold = contained_passages(spark, sf_dir, index)
    return metrics.mrr(ranked, gold, 5).withColumn("mrr", F.round("mrr", 6))


def contained_passages(spark, sf_dir, index):
    """``(qid, doc_id)`` of documents containing a passage as a substring.

    A passage may begin and end inside a word, but a document that holds it has all the words
    between. Passages without such words are looked for by parts of words; those without any
    word have no documents.
    """
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    items = passages.select("qid", search.index_terms(F.col("passage")).alias("t"))
    inner = items.filter("size(t) > 2").select("qid", F.slice("t", F.lit(2), F.greatest(F.size("t") - 2, F.lit(0))).alias("terms"))
    short = items.filter("size(t) between 1 and 2").select("qid", F.get("t", F.lit(0)).alias("part"))
    pairs = search.and_matches(index, inner).select("qid", "doc_id").union(search.part_matches(index, short))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = pairs.join(passages, "qid").join(docs, "doc_id").filter(F.contains("text", "passage"))
    return held.select("qid", "doc_id")


@query(
    "g9_forecast_errors",
    """with p as (select l_extendedprice as y, l_quantity * 2500 as z from lineitem)
    select round(avg((y - z) * (y - z)) / 1e6, 3) as mse_m, round(avg(abs(y - z)), 3) as mae,
    round(avg(100 * abs(y - z) / (abs(y) + abs(z) + 1e-10)), 4) as smape from p""",
)
def forecast_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2500).alias("z")
    )
    out = metrics.forecast_errors(rows, "y", "z")
    return out.select(
        F.round(F.col("mse") / 1e6, 3).alias("mse_m"), F.round("mae", 3).alias("mae"), F.round("smape", 4).alias("smape")
    )


@query(
    "g10_run_aggregation",
    """select l_linenumber, l_returnflag, round(avg(l_discount), 4) as l_discount_mean, round(avg(l_tax), 4) as s_0_mean,
    round(avg(l_quantity), 4) as s_1_mean, round(stddev(l_discount), 4) as l_discount_std, round(stddev(l_tax), 4) as s_0_std,
    round(stddev(l_quantity), 4) as s_1_std from lineitem group by 1, 2""",
)
def run_aggregation(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_returnflag", "l_discount", F.array("l_tax", "l_quantity").alias("s")
    )
    return metrics.aggregate_runs(runs, ["l_linenumber", "l_returnflag"], ["l_discount"], {"s": 2})


@query(
    "g11_best_k_runs",
    """with r as (select *, row_number() over (partition by l_suppkey, l_returnflag order by l_extendedprice desc, l_orderkey * 8 + l_linenumber) as r from lineitem)
    select l_suppkey, l_returnflag, round(avg(l_extendedprice), 4) as mean, round(stddev_pop(l_extendedprice), 4) as std
    from r where r <= 3 group by 1, 2""",
)
def best_k_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").withColumn("run", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    out = metrics.best_k_runs(runs, ["l_suppkey", "l_returnflag"], "l_extendedprice", "run")
    return out.select("l_suppkey", "l_returnflag", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(
    "g12_corpus_profile",
    f"""with w as (select {WORD_ARRAY} as w from documents)
    select count(*) as rows, round(avg(len(w)), 6) as mean_length, max(len(w)) as longest,
    round(avg(cast(len(w) <= 80 as int)), 6) as share_short, sum(cast(len(w) <= 2 as int)) as tiny,
    (select count(distinct t) from (select unnest(w) as t from w)) as vocabulary from w""",
)
def corpus_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(tx.words(F.col("text")).alias("w"))
    out = metrics.corpus_profile(docs, "w")
    return out.select(
        "rows", F.round("mean_length", 6).alias("mean_length"), "longest", F.round("share_short", 6).alias("share_short"),
        "tiny", "vocabulary",
    )


@query(
    "g12b_length_histogram",
    f"select len({WORD_ARRAY}) as length, count(*) as n from documents group by 1",
)
def length_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(tx.words(F.col("text")).alias("w"))
    return metrics.length_histogram(docs, "w")


@query("g12c_class_counts", "select lang, count(*) as n from documents group by 1")
def class_counts(spark, sf_dir):
    return metrics.class_counts(table(spark, sf_dir, "documents"), "lang")


@query(
    "g13_rarity_weights",
    "select event_type, count(*) as n, round((select count(*) from events) / count(*), 6) as weight from events group by 1",
)
def rarity_weights(spark, sf_dir):
    return metrics.rarity_weights(table(spark, sf_dir, "events"), "event_type").withColumn("weight", F.round("weight", 6))
