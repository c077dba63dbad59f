"""Curation queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import curate
from papyra.plans.registry import query, spread, table

TRIM = r"regexp_replace({0}, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')"
BAD = (
    "not contains(text, 'sex') and not contains(text, '<div') and not contains(text, 'class=') "
    "and not contains(text, 'script')"
)
COUNT80 = r"len(string_split_regex(regexp_replace(lower(text), '\s+$', ''), '\s')) >= 80"
PARTS = f"list_filter(list_transform(string_split_regex(text, '\\n+'), lambda p: {TRIM.format('p')}), lambda p: p <> '')"
LINE_FILTER = (
    "array_to_string(list_filter(string_split_regex(text, '\\n+'), "
    "lambda s: length(s) between 40 and 2048 and trim(s) <> ''), chr(10))"
)


def _paragraph_dedup_sql(source: str) -> str:
    return f"""
    l as (select doc_id, unnest(a) as p, generate_subscripts(a, 1) as i
          from (select doc_id, {PARTS} as a from {source})),
    f as (select *, row_number() over (partition by p order by doc_id, i) as rn from l),
    d as (select doc_id, string_agg(p, chr(10) order by i) as text from f where rn = 1 group by doc_id)"""


@query("c1_filter_bad_rows", f"select doc_id, lang, text from documents where {BAD}")
def filter_bad_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return curate.filter_bad_rows(docs, "text")


@query("c2_min_tokens", f"select doc_id, n_chars from documents where {COUNT80}")
def min_tokens(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return curate.filter_min_tokens(docs, "text", 80).select("doc_id", "n_chars")


@query("c4_line_length_filter", f"select doc_id, {LINE_FILTER} as text from documents")
def line_length_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return curate.filter_lines(docs, "text")


@query("c5_exact_doc_dedup", "select min(doc_id) as doc_id, text from documents group by text")
def exact_doc_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return curate.dedup_docs(docs, "doc_id", "text")


@query("c6_paragraph_dedup", f"with {_paragraph_dedup_sql('documents')} select doc_id, text from d")
def paragraph_dedup(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return curate.dedup_paragraphs(docs, "doc_id", "text")


@query(
    "c7_curate_doc_level",
    f"""with g as (select min(doc_id) as doc_id, text from documents where {BAD} and {COUNT80} group by text)
    select doc_id, {LINE_FILTER} as text from g""",
)
def curate_doc_level(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return curate.curate_docs(docs, "doc_id", "text")


@query(
    "c8_curate_crawl",
    f"""with u as (select min(doc_id) as doc_id, text from documents group by text),
    {_paragraph_dedup_sql('u')} select doc_id, text from d where {BAD}""",
)
def curate_crawl(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return curate.curate_crawl(docs, "doc_id", "text")


def _stats_sql(source: str, stage: str) -> str:
    return f"""select '{stage}' as stage, count(*) as docs,
    sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) as tokens,
    sum(len({PARTS})) as paragraphs from {source}"""


@query(
    "c9_corpus_stats",
    f"with {_paragraph_dedup_sql('documents')} {_stats_sql('documents', 'input')} "
    f"union all {_stats_sql('d', 'output')}",
)
def corpus_stats(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return curate.dedup_report(docs, curate.dedup_paragraphs(docs, "doc_id", "text"), "text")


@query(
    "c10_accept_content",
    """select doc_id, 'article' as rule from documents where length(text) >= 500 and not contains(text, '<div')
    and not contains(text, '<table') and not contains(text, '</p>')
    union all select doc_id, 'crawl' from documents where length(text) >= 500 and not contains(text, 'div')
    and not contains(text, 'class=') and not contains(text, 'script')""",
)
def accept_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    article = curate.accept_pages(docs, "text").select("doc_id", F.lit("article").alias("rule"))
    crawl = curate.accept_pages(docs, "text", markup=curate.CRAWL_MARKUP)
    return curate.union_all([article, crawl.select("doc_id", F.lit("crawl").alias("rule"))])


HTML_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
    '(?s)<.+?>', ' ', 'g'),
    '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
    '&amp;', '&'), '\s+', ' ', 'g'))"""
SENTENCES_SQL = (
    "list_filter(list_transform(string_split(regexp_replace("
    "regexp_replace(replace({0}, chr(160), ' '), '\\s+', ' ', 'g'), "
    "'([.?!…;:+-]|[a-f]\\)) ([\"“]?)([" + tx.SENTENCE_CAPITALS + "])', '\\1 \\2' || chr(1) || '\\3', 'g'), chr(1)), "
    "lambda s: trim(s)), lambda s: s <> '')"
)


@query(
    "c11_novelty_filter",
    f"""with p as (select page_id, url, {SENTENCES_SQL.format(HTML_TEXT)} as s from pages),
    k as (select distinct url from pages where page_id % 2 = 0),
    c as (select p.page_id, p.url, trim(array_to_string(list_filter(s,
        lambda x: x not in ('XE 360º', 'TỪ KHÓA', 'Xem thêm', 'Bình luận', '.')), chr(10))) as content
        from p where url not in (select url from k))
    select page_id, url, content from c where length(content) >= 200 and not contains(content, '<div')
    and not contains(content, '<table') and not contains(content, '</p>')""",
)
def novelty_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    new = pages.select("page_id", "url", tx.split_sentences(tx.strip_markup(F.col("html"))).alias("sentences"))
    known = pages.filter(F.col("page_id") % 2 == 0)
    return curate.novel_pages(new, known, "url", "sentences").select("page_id", "url", "content")


@query(
    "c12_url_exclusion",
    r"""select page_id, url from pages where regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) not in
    ('m.therou.example.com', 'blog.ththan.example.net') and not contains(url, '?') and not contains(url, '/de/')
    and contains(url, 'e')""",
)
def url_exclusion(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = ["m.therou.example.com", "blog.ththan.example.net"]
    return curate.filter_urls(pages, "url", hosts, ["?", "/de/"], date="e")


@query(
    "c13_link_extraction",
    r"""select distinct host as site, 'http://' || host || l as link from (
    select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host,
    unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) as l from pages)""",
)
def link_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("site", curate.url_host(F.col("url")))
    links = curate.extract_links(pages, "html", "site", 'href="(/[^"]+)"')
    return links.withColumn("link", F.concat(F.lit("http://"), F.col("link")))


@query("c14_html_to_text", f"select page_id, {HTML_TEXT} as text from pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("text"))


@query("c15_url_host", r"select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", curate.url_host(F.col("url")).alias("host"))


@query(
    "c16_category_merge",
    r"""select case section when 'en' then 'english' when 'fr' then 'romance' when 'es' then 'romance'
    else 'other' end as category, count(distinct url) as urls
    from (select url, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) as section from pages) group by 1""",
)
def category_merge(spark, sf_dir):
    section = F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("url", section.alias("section"))
    mapping = {"en": "english", "fr": "romance", "es": "romance"}
    return curate.merge_categories(pages, mapping, "section", "url")


@query(
    "c17_min_sentences",
    f"""select doc_id, array_to_string(list_filter(s, lambda x: length(x) >= 20 and length(x) < 400
    and not contains(x, '<') and not contains(x, '>')), '|') as kept
    from (select doc_id, {SENTENCES_SQL.format('text')} as s from documents) where len(s) >= 5""",
)
def min_sentences(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", tx.split_sentences(F.col("text")).alias("sentences")
    )
    kept = curate.filter_sentences(docs, "sentences")
    return kept.select("doc_id", F.array_join("sentences", "|").alias("kept"))


@query(
    "c18_noise_line_clean",
    r"""select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
    lambda s: regexp_replace(trim(regexp_replace(s, '\||\t+|_{3,}', '', 'g')), '\s{2,}', ' ', 'g')),
    lambda s: s <> '' and not regexp_full_match(s, '-{5,}') and not starts_with(s, 'http')), chr(10)) as text
    from documents""",
)
def noise_line_clean(spark, sf_dir):
    return curate.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query(
    "c19_body_slice",
    """with m as (select doc_id, text, greatest(1, instr(text, 'the'), instr(text, 'que')) as b,
    coalesce(nullif(least(case when instr(text, 'Re') > 0 then instr(text, 'Re') else 999999999 end,
    case when instr(text, 'La ') > 0 then instr(text, 'La ') else 999999999 end), 999999999), length(text) + 1) as e
    from documents) select doc_id, substr(text, b, greatest(e - b, 0)) as body from m""",
)
def body_slice(spark, sf_dir):
    body = tx.slice_between(F.col("text"), ["the", "que"], ["Re", "La "])
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


@query(
    "c20_sentence_selection",
    f"""select doc_id, array_to_string(list_filter(s[2:len(s)-2], lambda x: length(x) >= 20 and
    len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) >= 5), '|') as kept
    from (select doc_id, {SENTENCES_SQL.format('text')} as s from documents)""",
)
def sentence_selection(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", tx.split_sentences(F.col("text")).alias("sentences")
    )
    kept = curate.select_sentences(docs, "sentences")
    return kept.select("doc_id", F.array_join("sentences", "|").alias("kept"))


@query(
    "c21_union_all",
    """select doc_id as id, text, 'documents' as origin from documents
    union all select item_id, text, 'benchmark' from benchmark""",
)
def union_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("id"))
    return curate.union_all(
        [docs.withColumn("origin", F.lit("documents")), items.withColumn("origin", F.lit("benchmark"))]
    )


@query(
    "c22_split_by_hash",
    """with b as (select doc_id, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 8) as bigint) % 100 as h
    from documents) select doc_id, case when h < 80 then 'train' when h < 90 then 'valid' else 'test' end as split from b""",
)
def split_by_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return curate.split_by_hash(docs, "doc_id", {"train": 80, "valid": 10, "test": 10})


@query(
    "c23_majority_downsample",
    """select doc_id, quality, coalesce(toxic, 0) as toxic from labels where toxic = 1 or (toxic = 0 and
    cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 8) as bigint) % 100 < 10)""",
)
def majority_downsample(spark, sf_dir):
    return curate.rebalance(table(spark, sf_dir, "labels"), "toxic", "doc_id", 10)


@query(
    "c24_truncate_text",
    r"""select doc_id, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:50], ' ')
    as tokens, substr(text, 1, 1000) as head,
    case when length(text) > 80 then substr(text, 1, 80) || '...' else text end as title from documents""",
)
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        curate.first_tokens(F.col("text"), 50).alias("tokens"),
        F.substring("text", 1, 1000).alias("head"),
        curate.ellipsis(F.col("text"), 80).alias("title"),
    )


@query(
    "c25_join_labels",
    """select d.doc_id, l.quality, length(d.text) as n from documents d join labels l using (doc_id)
    where l.quality <> 0 or length(d.text) > 200""",
)
def join_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = curate.join_labels(docs, labels, "doc_id", "text", "quality", 200)
    return joined.select("doc_id", "quality", F.length("text").alias("n"))


@query(
    "c26_vocab_restrict",
    """select vec_id, label, len(embedding) as dims from embeddings where vec_id in
    (select doc_id from labels where quality = 1)""",
)
def vocab_restrict(spark, sf_dir):
    vocabulary = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    kept = curate.restrict_embeddings(table(spark, sf_dir, "embeddings"), vocabulary, "vec_id")
    return kept.select("vec_id", "label", F.size("embedding").alias("dims"))
