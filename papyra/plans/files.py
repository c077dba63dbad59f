"""Queries for sources and sinks: given tables written in a file format and read back.

The written files live in the shared checkpoint folder and grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import curate, models, search
from papyra.plans.curation import BAD, TRIM
from papyra.plans.registry import query, spread, table
from papyra.plans.textual import WORDS
from papyra.session import new_path
from papyra.sources import readers, writers
from papyra.streaming import streams

WORD_ARRAY = WORDS.format("text")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _lines(df: DataFrame, value, label: str) -> str:
    path = new_path(df.sparkSession, label)
    df.select(value.alias("value")).write.text(path)
    return path


def _turn_words(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", tx.words(F.col("text")).alias("w")).filter("size(w) > 0")


# tags of a word by simple surface rules, the same in both engines
def tag_of(word):
    return F.when(word.rlike(r"\A\p{Lu}"), "N").when(F.length(word) <= 3, "E").otherwise("V")


def entity_of(word):
    return F.when(word.rlike(r"\A\p{Lu}"), "B-X").otherwise("O")


TAG_SQL = "case when regexp_matches({0}, '^\\p{{Lu}}') then 'N' when length({0}) <= 3 then 'E' else 'V' end"
ENTITY_SQL = "case when regexp_matches({0}, '^\\p{{Lu}}') then 'B-X' else 'O' end"


@query("a1_json_lines", "select doc_id, text from documents")
def json_lines(spark, sf_dir):
    path = new_path(spark, "json")
    _docs(spark, sf_dir).withColumn("part", F.col("doc_id") % 4).write.partitionBy("part").json(path)
    return readers.read_json(spark, path, "doc_id bigint, text string", glob="*.json")


@query("a2_json_multiline", "select page_id, url, length(html) as n from pages")
def json_multiline(spark, sf_dir):
    """Files that each hold one JSON array over several lines, a hundred pages at most."""
    pages = table(spark, sf_dir, "pages")
    hundred = F.floor(F.col("page_id") / 100).alias("hundred")
    item = F.to_json(F.struct("page_id", "url", "html"), {"pretty": "true"})
    arrays = pages.select(hundred, item.alias("item")).groupBy("hundred").agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("item"), ",\n"), F.lit("\n]")).alias("value")
    )
    path = new_path(spark, "pretty")
    arrays.write.partitionBy("hundred").text(path)
    rows = readers.read_json(spark, path, "page_id bigint, url string, html string", multiline=True)
    return rows.select("page_id", "url", F.length("html").alias("n"))


@query(
    "a3_text_lines",
    r"""select l as content, count(*) as n from (select unnest(string_split_regex(text, '\n')) as l from documents)
    where l <> '' group by 1""",
)
def text_lines(spark, sf_dir):
    path = _lines(_docs(spark, sf_dir), F.col("text"), "text")
    return readers.read_text(spark, path).groupBy("content").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a4_tsv_labelled",
    r"""select source as category, trim(replace(text, chr(10), ' ')) as content from documents""",
)
def tsv_labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    path = _lines(docs, F.concat(F.lit(" "), F.col("source"), F.lit("\t"), flat), "tsv")
    return readers.read_labelled(spark, path)


@query("a5_csv_header", "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def csv_header(spark, sf_dir):
    path = new_path(spark, "csv")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    orders.write.option("header", "true").option("sep", ";").option("compression", "gzip").csv(path)
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return readers.read_csv(spark, path, schema, sep=";")


FLAGS = 22


@query(
    "a6_fixed_tail_csv",
    f"""with f as (select doc_id, replace(replace(text, chr(10), ' '), '"', '') as t,
    list_filter(range(1, {FLAGS + 1}), lambda i: contains(text, chr(cast(96 + i as int)) || chr(cast(97 + i as int)))) as p from documents)
    select cast(doc_id as double) as id, t as text,
    case when len(p) = 0 then '0' else array_to_string(list_transform(p, lambda x: cast(x as varchar)), ' ') end as labels
    from f""",
)
def fixed_tail_csv(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    flat = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit(""))
    flags = [
        F.col("text").contains(chr(96 + i) + chr(97 + i)).cast("int").cast("string") for i in range(1, FLAGS + 1)
    ]
    line = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), flat, F.lit('",'), F.concat_ws(",", *flags))
    path = _lines(docs, line, "flags")
    rows = readers.read_flag_csv(spark, path, FLAGS)
    return rows.select("id", "text", F.array_join("labels", " ").alias("labels"))


@query(
    "a7_conll_columns",
    f"""select array_to_string(w, ' ') as words, array_to_string(list_transform(w, lambda x: {TAG_SQL.format('x')}), ' ')
    as pos, array_to_string(list_transform(w, lambda x: {ENTITY_SQL.format('x')}), ' ') as ne
    from (select {WORD_ARRAY} as w from conversations) where len(w) > 0""",
)
def conll_columns(spark, sf_dir):
    turns = _turn_words(spark, sf_dir)
    rows = F.transform("w", lambda w: F.concat_ws("\t", w, tag_of(w), F.lit("O"), entity_of(w)))
    # a comment-free block per turn; every third block is followed by several blank lines
    gap = F.when(F.col("turn") % 3 == 0, F.lit("\n \n\n")).otherwise(F.lit("\n"))
    path = _lines(turns, F.concat(F.array_join(rows, "\n"), gap), "conll")
    out = readers.read_conll(spark, path)
    return out.select(*[F.array_join(c, " ").alias(n) for c, n in (("word", "words"), ("pos", "pos"), ("ne", "ne"))])


@query(
    "a8_tagged_markup",
    f"""select array_to_string(w, ' ') as words, array_to_string(list_transform(w, lambda x: {TAG_SQL.format('x')}), ' ')
    as pos from (select {WORD_ARRAY} as w from conversations) where len(w) > 0""",
)
def tagged_markup(spark, sf_dir):
    turns = _turn_words(spark, sf_dir)
    rows = F.transform("w", lambda w: F.concat_ws(" ", w, tag_of(w), F.lit("O")))
    block = F.concat(F.lit("<s>\nbad line\n"), F.array_join(rows, "\n"), F.lit("\n</s>"))
    out = readers.read_sgml_blocks(spark, _lines(turns, block, "sgml"))
    return out.select(F.array_join("word", " ").alias("words"), F.array_join("pos", " ").alias("pos"))


@query(
    "a9_conllu_graphs",
    f"""with t as (select {WORD_ARRAY} as w from conversations),
    x as (select 'ROOT ' || array_to_string(w, ' ') as words, '-1 ' || array_to_string(range(0, len(w)), ' ') as heads,
    'ROOT ' || array_to_string(list_transform(w, lambda v: case when {TAG_SQL.format('v')} = 'N' then 'nmod' else 'dep' end), ' ')
    as labels from t where len(w) > 0) select * from x""",
)
def conllu_graphs(spark, sf_dir):
    turns = _turn_words(spark, sf_dir)

    def row(w, i):
        label = F.when(tag_of(w) == "N", F.lit("nmod:of")).otherwise(F.lit("dep"))
        return F.concat_ws(
            "\t", (i + 1).cast("string"), w, F.lower(w), tag_of(w), tag_of(w), F.lit("_"), i.cast("string"),
            label, F.lit("_"), F.lit("_"),
        )

    block = F.concat(F.lit("# text\n"), F.array_join(F.transform("w", row), "\n"), F.lit("\n"))
    graphs = readers.read_conllu(spark, _lines(turns, block, "conllu"))
    return graphs.select(
        *[
            F.array_join(F.col(f"tokens.{c}"), " ").alias(n)
            for c, n in (("word", "words"), ("head", "heads"), ("label", "labels"))
        ]
    )


@query(
    "a10_inline_tags",
    f"""select array_to_string(w, ' ') as words, array_to_string(list_transform(w, lambda x: {TAG_SQL.format('x')}), ' ')
    as tags from (select {WORD_ARRAY} as w from conversations) where len(w) > 0""",
)
def inline_tags(spark, sf_dir):
    turns = _turn_words(spark, sf_dir)
    line = F.array_join(F.transform("w", lambda w: F.concat_ws("/", w, tag_of(w))), " ")
    out = readers.read_slash_tagged(spark, _lines(turns, line, "slash"))
    return out.select(F.array_join("words", " ").alias("words"), F.array_join("tags", " ").alias("tags"))


MARKUP_TAGS = {"cq": "ORG", "dd": "LOC", "ng": "PER", "vb": "DOC", "date": "DATE"}
MARKUP_SQL = f"""select cast(conv_id as varchar) || '-' || turn as id, list_transform({WORD_ARRAY},
    lambda w: case when regexp_matches(w, '^[A-M]') then 'cq' when regexp_matches(w, '^[N-Z]') then 'dd' else '' end) as k,
    {WORD_ARRAY} as w from conversations"""


def _marked_turns(spark, sf_dir):
    """Turns whose capitalised words are entities, each one word long."""
    turns = _turn_words(spark, sf_dir)

    def piece(w):
        tag = F.when(w.rlike(r"\A[A-M]"), "cq").when(w.rlike(r"\A[N-Z]"), "dd")
        return F.when(tag.isNull(), w).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), w, F.lit("</"), tag, F.lit(">")))

    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "w", F.array_join(F.transform("w", piece), " ").alias("text")
    )


@query(
    "a11_entity_markup",
    f"""with m as ({MARKUP_SQL}) select id, array_to_string(w, ' ') as words, array_to_string(list_transform(k,
    lambda x: case x when 'cq' then 'B-ORG' when 'dd' then 'B-LOC' else 'O' end), ' ') as labels
    from m where len(w) > 0""",
)
def entity_markup(spark, sf_dir):
    out = readers.markup_to_bio(_marked_turns(spark, sf_dir), "id", "text", MARKUP_TAGS)
    return out.select("id", F.array_join("words", " ").alias("words"), F.array_join("labels", " ").alias("labels"))


@query(
    "a12_span_id_bio",
    f"""with m as (select id, unnest(w) as w, generate_subscripts(w, 1) as i from ({MARKUP_SQL})),
    s as (select *, case when regexp_matches(w, '^[A-Z]') then (i - 1) // 3 + 1 end as span from m),
    l as (select *, lag(span ignore nulls) over (partition by id order by i) as prev from s)
    select id, string_agg(case when span is null then 'O' when span is distinct from prev then 'B-ORG' else 'I-ORG' end, ' ' order by i) as labels
    from l group by id having count(*) > 1""",
)
def span_id_bio(spark, sf_dir):
    turns = _marked_turns(spark, sf_dir).filter("size(w) > 1")
    marks = F.transform(
        "w",
        lambda w, i: F.when(
            w.rlike(r"\A[A-Z]"), F.concat(F.lit("Organization["), (F.floor(i / 3) + 1).cast("string"), F.lit("]"))
        ).otherwise(F.lit("_")),
    )
    labels = readers.spanid_to_bio(F.col("marks"), {"Organization": "ORG"})
    return turns.withColumn("marks", marks).select("id", F.array_join(labels, " ").alias("labels"))


@query(
    "a13_bio_to_markup",
    f"""with m as (select id, unnest(w) as w, unnest(k) as k, generate_subscripts(w, 1) as i from ({MARKUP_SQL})),
    r as (select *, i - row_number() over (partition by id, k order by i) as run from m),
    g as (select id, k, run, min(i) as i, string_agg(w, ' ' order by i) as t from r group by id, k, run),
    x as (select id, string_agg(case when k = '' then t else '<' || k || '>' || t || '</' || k || '>' end, ' ' order by i) as text
    from g group by id) select id, text from x where contains(text, '</')""",
)
def bio_to_markup(spark, sf_dir):
    turns = _marked_turns(spark, sf_dir)
    labels = F.transform(
        "w", lambda w: F.when(w.rlike(r"\A[A-M]"), "B-ORG").when(w.rlike(r"\A[N-Z]"), "I-LOC").otherwise("O")
    )
    text = readers.bio_to_markup(F.col("w"), F.col("l"), {"ORG": "cq", "LOC": "dd"})
    return turns.withColumn("l", labels).select("id", text.alias("text")).filter(F.col("text").contains("</"))


@query(
    "a14_paired_lines",
    f"""select array_to_string(w, ' ') as x, array_to_string(list_transform(w, lambda v: {TAG_SQL.format('v')}), ' ') as y
    from (select {WORD_ARRAY} as w from conversations) where len(w) > 0""",
)
def paired_lines(spark, sf_dir):
    turns = _turn_words(spark, sf_dir)
    tags = F.array_join(F.transform("w", lambda w: tag_of(w)), " ")
    path = _lines(turns, F.concat(tags, F.lit("\n"), F.array_join("w", " ")), "pairs")
    out = readers.read_paired_lines(spark, path)
    return out.select(F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query("a15_bulk_pairs", "select cast(doc_id as varchar) as page_id, substr(text, 1, 1000) as text from documents")
def bulk_pairs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    head = F.to_json(F.struct(F.struct(F.col("doc_id").cast("string").alias("_id")).alias("index")))
    path = _lines(docs, F.concat(head, F.lit("\n"), F.to_json(F.struct("text"))), "bulk")
    return readers.read_bulk_pairs(spark, path)


@query(
    "a16_xml_dialog",
    r"""select cast(conv_id * 100 + turn as varchar) as turn_id, regexp_replace(trim(text), '\s+', ' ', 'g') as utterance,
    role as domains, 'inform ' || substr(role, 1, 1) as acts, 'role: ' || role as slots from conversations""",
)
def xml_dialog(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    act = F.struct(
        F.col("role").alias("domain"),
        F.array(F.lit("inform"), F.substring("role", 1, 1)).alias("communicativeFunction"),
        F.concat(F.lit("role:   "), F.col("role")).alias("slot"),
    )
    rows = turns.select(
        F.struct(
            (F.col("conv_id") * 100 + F.col("turn")).alias("_id"),
            F.trim(F.regexp_replace("text", r"\s+", " ")).alias("_VALUE"),
        ).alias("txt"),
        F.array(act).alias("act"),
    )
    path = new_path(spark, "xml")
    rows.write.format("xml").option("rowTag", "utterance").option("rootTag", "TEI.DIALOG").save(path)
    out = readers.utterances(readers.read_xml(spark, path, "utterance", readers.UTTERANCE_SCHEMA))
    return out.select(
        "turn_id", "utterance", *[F.array_join(c, " ").alias(c) for c in ("domains", "acts", "slots")]
    )


@query(
    "a17_nested_acts_json",
    """select cast(conv_id as varchar) as dialog_id, cast(turn as varchar) as turn_id, 'inform' as acts, role as value,
    0 as start, length(role) as "end" from conversations""",
)
def nested_acts_json(spark, sf_dir):
    out = readers.read_dialog_acts(spark, write_acts(table(spark, sf_dir, "conversations")))
    return out.select("dialog_id", "turn_id", F.array_join("acts", " ").alias("acts"), F.explode("spans").alias("s")).select(
        "dialog_id", "turn_id", "acts", "s.value", "s.start", "s.end"
    )


def write_acts(turns: DataFrame) -> str:
    """One JSON object per turn: dialog id to turn id to acts and spans."""
    act = F.create_map(F.lit("inform"), F.array(F.array(F.lit("role"), F.col("role"))))
    span = F.array(F.array(
        F.lit("inform"), F.lit("role"), F.col("role"), F.lit("0"), F.length("role").cast("string")
    ))
    inner = F.struct(act.alias("dialog_act"), span.alias("span_info"))
    whole = F.create_map(
        F.col("conv_id").cast("string"), F.create_map(F.col("turn").cast("string"), inner)
    )
    return _lines(turns, F.to_json(whole), "acts")


@query(
    "a18_multi_file_union",
    "select doc_id as id, lang as label from documents union all select page_id, 'page' from pages",
)
def multi_file_union(spark, sf_dir):
    one, two = new_path(spark, "part"), new_path(spark, "part")
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label")).write.json(one)
    table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("label")).write.json(two)
    return readers.read_union(spark, [one, two], "id bigint, label string")


@query(
    "a19_embedding_file",
    "select 'v' || vec_id as word, len(embedding) as dims, round(list_sum(embedding), 3) as total from embeddings",
)
def embedding_file(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: x.cast("string"))
    line = F.concat_ws(" ", F.concat(F.lit("/c/v"), F.col("vec_id").cast("string")), values)
    out = readers.read_embeddings(spark, _lines(vectors, line, "vectors"), prefix="/c/")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("word", F.size("vector").alias("dims"), F.round(total, 3).alias("total"))


@query("a20_jdbc_urls", "select distinct url from pages where length(url) < 256")
def jdbc_urls(spark, sf_dir):
    """The database table stands as a parquet table here; a JDBC source takes the same calls."""
    path = new_path(spark, "urls")
    writers.write_known_urls(table(spark, sf_dir, "pages").select("url"), path)
    return readers.known_urls(spark, path)


@query("a21_kafka_source", "select url, length(html) as n from pages")
def kafka_source(spark, sf_dir):
    """Topic records stand as files with the same key and value columns."""
    path = new_path(spark, "topic")
    pages = table(spark, sf_dir, "pages")
    writers.message_rows(pages, "url", "html").select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")
    ).write.parquet(path)
    records = spark.readStream.schema("key binary, value binary").parquet(path)
    out = streams.append_to_table(readers.message_columns(records).select("url", F.length("text").alias("n")))
    return out


@query(
    "a23_file_stream",
    r"""select l as value, count(*) as n from (select unnest(string_split_regex(text, '\n')) as l from documents) group by 1""",
)
def file_stream(spark, sf_dir):
    lines = readers.read_text_stream(spark, _lines(_docs(spark, sf_dir), F.col("text"), "stream"))
    return streams.complete_to_table(lines.groupBy("value").agg(F.count(F.lit(1)).alias("n")))


GRID_SQL = """g as (select event_type as var, cast(ts as date) as time, event_id % 2 as level, user_id % 73 as lat_id,
    event_id % 144 as lon_id, max(value) as value from events group by all),
    s as (select s_suppkey as station, cast(trunc((90 - (s_suppkey % 60)) / 2.5) as int) as lat_id,
    cast(trunc(((s_suppkey * 7) % 360) / 2.5) as int) as lon_id from supplier)"""


@query(
    "a24_grid_series",
    f"""with {GRID_SQL} select station, time, max(case when var = 'view' and level = 0 then value end) as view_0,
    max(case when var = 'view' and level = 1 then value end) as view_1,
    max(case when var = 'click' and level = 0 then value end) as click_0
    from g join s using (lat_id, lon_id) where var in ('view', 'click') group by station, time""",
)
def grid_series(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    grid = events.groupBy(
        F.col("event_type").alias("var"), F.to_date("ts").alias("time"), (F.col("event_id") % 2).alias("level"),
        (F.col("user_id") % 73).cast("int").alias("lat_id"), (F.col("event_id") % 144).cast("int").alias("lon_id"),
    ).agg(F.max("value").alias("value"))
    key = F.col("s_suppkey")
    stations = table(spark, sf_dir, "supplier").select(
        key.alias("station"), (key % 60).cast("double").alias("lat"), ((key * 7) % 360).cast("double").alias("lon")
    )
    return readers.grid_series(grid, stations, [("view", 0), ("view", 1), ("click", 0)])


# --- sinks -------------------------------------------------------------------------------
@query("b1_json_gzip_parts", "select doc_id, text from documents")
def json_gzip_parts(spark, sf_dir):
    path = new_path(spark, "gzip")
    writers.write_corpus(_docs(spark, sf_dir), path, 8)
    return readers.read_json(spark, path, "doc_id bigint, text string", glob="*.json.gz")


@query("b2_json_single", "select doc_id, quality, toxic from labels")
def json_single(spark, sf_dir):
    path = new_path(spark, "single")
    writers.write_json(table(spark, sf_dir, "labels"), path, single=True)
    return readers.read_json(spark, path, "doc_id bigint, quality int, toxic int")


@query("b3_parquet_features", f"select doc_id, len({WORD_ARRAY}) as n_words from documents")
def parquet_features(spark, sf_dir):
    path = new_path(spark, "features")
    writers.write_parquet(_docs(spark, sf_dir).select("doc_id", F.size(tx.words(F.col("text"))).alias("n_words")), path)
    return spark.read.schema("doc_id bigint, n_words int").parquet(path)


@query(
    "b4_csv_tsv_report",
    "select l_returnflag, l_linestatus, count(*) as n, round(avg(l_quantity), 4) as mean from lineitem group by 1, 2",
)
def csv_tsv_report(spark, sf_dir):
    path = new_path(spark, "report")
    report = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean")
    )
    writers.write_report(report, path)
    return readers.read_csv(spark, path, "l_returnflag string, l_linestatus string, n bigint, mean double", sep="\t")


@query(
    "b5_two_column_eval",
    f"""select array_to_string(list_transform(w, lambda x: {ENTITY_SQL.format('x')}), ' ') as gold,
    array_to_string(list_transform(w, lambda x: case when length(x) > 4 then 'B-X' else 'O' end), ' ') as predicted
    from (select {WORD_ARRAY} as w from conversations) where len(w) > 0""",
)
def two_column_eval(spark, sf_dir):
    turns = _turn_words(spark, sf_dir).select(
        F.transform("w", lambda w: entity_of(w)).alias("gold"),
        F.transform("w", lambda w: F.when(F.length(w) > 4, "B-X").otherwise("O")).alias("predicted"),
    )
    path = new_path(spark, "eval")
    writers.write_conll_eval(turns, "gold", "predicted", path)
    back = readers.read_conll(spark, path, ["gold", "predicted"])
    return back.select(F.array_join("gold", " ").alias("gold"), F.array_join("predicted", " ").alias("predicted"))


@query(
    "b6_submission_csv",
    """select d.doc_id, d.n_chars, l.quality, l.toxic, d.lang from documents d join labels l using (doc_id)""",
)
def submission_csv(spark, sf_dir):
    path = new_path(spark, "submission")
    texts = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    writers.write_submission(texts, table(spark, sf_dir, "labels"), path, "doc_id")
    schema = "doc_id bigint, n_chars bigint, quality int, toxic int, lang string"
    return spark.read.schema(schema).option("header", "true").csv(path)


@query("b7_model_store")
def model_store(spark, sf_dir):
    """A fitted pipeline written, loaded again and applied."""
    path = new_path(spark, "model")
    rows = models.labelled_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")
    writers.save_model(models.fit_text_classifier(rows, "hash-forest", features=512), path)
    return models.predict_labels(rows, writers.load_model(path)).select("id", "category", "prediction")


@query("b8_kafka_sink", "select url as key, length(html) as n from pages where length(html) >= 500")
def kafka_sink(spark, sf_dir):
    """Accepted pages as topic records; the topic stands as a table with its columns."""
    pages = table(spark, sf_dir, "pages")
    rows = writers.message_rows(curate.accept_pages(pages, "html", markup=["\x00"]), "url", "html")
    path = new_path(spark, "topic")
    writers.write_parquet(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select("key", F.length("value").alias("n"))


@query("b9_micro_batch_files", "select event_id, event_type from events")
def micro_batch_files(spark, sf_dir):
    events = streams.table_stream(spark, sf_dir, "events").select("event_id", "event_type")
    path = new_path(spark, "batches")
    streams.save_batches(events, path, stop_after=None)
    return spark.read.schema("event_id bigint, event_type string").option("recursiveFileLookup", "true").parquet(path)


@query(
    "b10_bulk_index",
    f"""select w as term, doc_id, count(*) as tf from (select doc_id,
    unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) as w from documents) group by 1, 2""",
)
def bulk_index(spark, sf_dir):
    path = new_path(spark, "index")
    writers.write_index(search.build_index(_docs(spark, sf_dir), "doc_id", "text"), path)
    return spark.read.parquet(path).select("term", "doc_id", "tf")


@query("b11_vector_text")
def vector_text(spark, sf_dir):
    path = new_path(spark, "vectors")
    writers.write_vectors(models.fit_word_vectors(spread(_docs(spark, sf_dir)), "text", size=8, iterations=1), path)
    return readers.read_embeddings(spark, path).select("word", F.size("vector").alias("dims"))


# documents between blank lines, read from lines
@query(
    "c3_assemble_blank_line_docs",
    f"""with d as (select doc_id, array_to_string(list_filter(string_split(text, chr(10)),
    lambda s: {TRIM.format('s')} <> ''), chr(10)) as text from documents)
    select distinct text from d where text <> '' and {BAD}""",
)
def assemble_blank_line_docs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    lines = F.filter(F.split("text", "\n"), lambda s: tx.trim_blank(s) != "")
    path = _lines(docs, F.concat(F.array_join(lines, "\n"), F.lit("\n")), "blank")
    return readers.assemble_docs(spark, path).select("text")
