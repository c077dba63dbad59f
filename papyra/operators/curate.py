"""Corpus curation: row filters, document assembly, exact deduplication, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions import text as tx
from papyra.functions.rows import unnest
from papyra.operators.ordered import row_index
from papyra.session import materialize

# ---- fixed values -----------------------------------------------------------
PAGE_MARKUP = ["<div", "<table", "</p>"]
CRAWL_MARKUP = ["div", "class=", "script", "\x00"]
BOILERPLATE_SENTENCES = ["XE 360º", "TỪ KHÓA", "Xem thêm", "Bình luận", "."]
# ---- end of fixed values ----------------------------------------------------


INTEGERS = (T.LongType, T.IntegerType, T.ShortType)
LINES = 1 << 30  # more than any text has


def contains_any(text: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(text, F.lit(term))
    return hit


def filter_bad_rows(df: DataFrame, text: str, terms: list[str] | None = None) -> DataFrame:
    """Drop rows whose text holds a term (case-sensitive substring) or is null."""
    return df.filter(~contains_any(F.col(text), terms or tx.BAD_TERMS))


def filter_min_tokens(df: DataFrame, text: str, n: int = 80) -> DataFrame:
    return df.filter(tx.jvm_token_count(F.col(text)) >= n)


def digest(text: Column) -> Column:
    """32-byte content key: rows travel by key instead of by text."""
    return F.unhex(F.sha2(text, 256))


def dedup_docs(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct text, the one with the smallest key; a null key is the largest.

    Only ``(digest, key)`` is shuffled for the grouping, pre-aggregated map-side, so a text
    that makes up a third of the corpus costs one row per map task. Key and digest together, as
    a struct in which nulls are equal, then select the rows; of rows equal in both one stays,
    which needs no further shuffle. Null texts count as one text.
    """
    own = F.struct(F.col(key).alias("key"), digest(F.col(text)).alias("digest"))
    rows = df.withColumn("_row", own)
    keys = rows.select(F.col("_row.digest").alias("_digest"), F.col("_row.key").alias("_own"))
    if isinstance(df.schema[key].dataType, INTEGERS):
        # two numbers keep the aggregation on the hash path
        least = keys.groupBy("_digest").agg(F.min("_own").alias("_own"))
    else:
        least = keys.groupBy("_digest").agg(F.min(F.struct(F.col("_own").isNull().alias("none"), F.col("_own").alias("own")))["own"].alias("_own"))
    kept = least.select(F.struct(F.col("_own").alias("key"), F.col("_digest").alias("digest")).alias("_row"))
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def paragraphs(text: Column, keep_blank: bool = False) -> Column:
    parts = F.transform(F.split(text, r"\n+"), tx.trim_blank)
    return parts if keep_blank else F.filter(parts, lambda p: p != "")


def with_copy_number(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """Rows with equal keys (nulls too) numbered from 0 by their texts; repeated rows once.

    Where no key repeats, which a count over the keys alone shows, the number is 0 and no text moves.
    Otherwise the texts' digests are numbered range by range, so a key may hold a third of all rows.
    """
    again = df.groupBy(F.struct(F.col(key).alias("key")).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    if again.isEmpty():
        return df.withColumn(name, F.lit(0))
    rows = df.withColumn("_id", F.struct(F.col(key).alias("key"))).withColumn("_sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    several = materialize(rows.select("_id", "_sha").join(again, "_id", "left_semi").distinct().withColumn("_order", F.xxhash64("_sha")), "several")
    numbered = row_index(several, ["_id"], ["_order", "_sha"], "_number").select(F.struct("_id", "_sha").alias("_row"), "_number")
    rows = rows.withColumn("_row", F.struct("_id", "_sha")).join(numbered, "_row", "left").dropDuplicates(["_row"])
    return rows.withColumn(name, F.coalesce("_number", F.lit(0)).cast("int")).drop("_id", "_sha", "_row", "_number")


def dedup_paragraphs(df: DataFrame, key: str, text: str, keep_blank: bool = False) -> DataFrame:
    """Keep the first occurrence of each paragraph in the corpus, by key (null last), text digest and line.

    Repeats inside one document go first, with an array function. Across documents the least
    place per paragraph digest decides, a hash aggregate with map-side partials, so boilerplate
    lines do not pile up in one task. What returns to a document is the list of its own
    surviving line numbers, and the text itself is moved once, for the join on the document's
    place. Rows that share a key are documents of their own; a repeated row keeps nothing.
    """
    docs = with_copy_number(df.select(key, text), key, text, "_copy")
    docs = docs.select(key, "_copy", F.array_distinct(paragraphs(F.col(text), keep_blank)).alias("_parts"))
    exact = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    integer = isinstance(df.schema[key].dataType, INTEGERS)
    if integer:
        # key, copy and line in one fixed-width number keep the aggregation on the hash path
        rank = F.coalesce(F.col(key).cast("decimal(20,0)") + exact(1 << 63), exact(1 << 64)).cast("decimal(20,0)")
        doc = ((rank * exact(1 << 31)).cast("decimal(38,0)") + F.col("_copy")).cast("decimal(38,0)") * exact(LINES)
        docs = docs.withColumn("_doc", doc.cast("decimal(38,0)"))
    else:
        docs = docs.withColumn("_doc", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "_copy"))
    lines = unnest(docs, ["_doc"], "_parts", "_part", "_line").select("_doc", "_line", digest(F.col("_part")).alias("_digest"))
    if integer:
        first = lines.groupBy("_digest").agg(F.min((F.col("_doc") + F.col("_line")).cast("decimal(38,0)")).alias("_first"))
        line = F.pmod("_first", exact(LINES))
        owned = first.select((F.col("_first") - line).cast("decimal(38,0)").alias("_doc"), line.cast("int").alias("_line"))
    else:
        first = lines.groupBy("_digest").agg(F.min(F.struct("_doc", "_line")).alias("_first"))
        owned = first.select("_first._doc", "_first._line")
    kept = owned.groupBy("_doc").agg(F.array_sort(F.collect_list("_line")).alias("_kept"))
    rebuilt = F.array_join(F.transform("_kept", lambda i: F.get("_parts", i)), "\n")
    return docs.join(kept, "_doc").select(key, rebuilt.alias(text))


def filter_lines(df: DataFrame, text: str, lo: int = 40, hi: int = 2048) -> DataFrame:
    """Keep the lines of each text that are ``lo`` to ``hi`` letters long and not blank."""
    good = F.filter(
        F.split(F.col(text), r"\n+"),
        lambda s: (F.length(s) >= lo) & (F.length(s) <= hi) & (F.trim(s) != ""),
    )
    return df.withColumn(text, F.array_join(good, "\n"))


def curate_docs(df: DataFrame, key: str, text: str, final_dedup: bool = False) -> DataFrame:
    """Bad rows, short rows, exact dedup, then the line filter."""
    out = filter_min_tokens(filter_bad_rows(df, text), text)
    out = filter_lines(dedup_docs(out, key, text), text)
    return dedup_docs(out, key, text) if final_dedup else out


def curate_crawl(df: DataFrame, key: str, text: str) -> DataFrame:
    """Exact dedup, paragraph dedup, bad rows."""
    return filter_bad_rows(dedup_paragraphs(dedup_docs(df, key, text), key, text), text)


def corpus_stats(df: DataFrame, text: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.size(tx.words(F.col(text)))).alias("tokens"),
        F.sum(F.size(paragraphs(F.col(text)))).alias("paragraphs"),
    )


def dedup_report(before: DataFrame, after: DataFrame, text: str) -> DataFrame:
    """Document and paragraph counts on both sides of a dedup run, one row per side."""
    return (
        corpus_stats(before, text).withColumn("stage", F.lit("input"))
        .unionByName(corpus_stats(after, text).withColumn("stage", F.lit("output")))
    )


def accept_pages(df: DataFrame, content: str, min_chars: int = 500, markup: list[str] | None = None) -> DataFrame:
    text = F.col(content)
    return df.filter((F.length(text) >= min_chars) & ~contains_any(text, markup or PAGE_MARKUP))


def novel_pages(
    new: DataFrame, known: DataFrame, url: str, sentences: str, stop: list[str] | None = None,
    min_chars: int = 200,
) -> DataFrame:
    """Rows with an unseen url, boilerplate sentences dropped, long and free of markup."""
    stop = BOILERPLATE_SENTENCES if stop is None else stop
    content = F.trim(F.array_join(F.filter(F.col(sentences), lambda s: ~s.isin(stop)), "\n"))
    fresh = new.join(known.select(url).distinct(), url, "left_anti")
    return accept_pages(fresh.withColumn("content", content), "content", min_chars)


def filter_urls(
    df: DataFrame, url: str, hosts: list[str] = (), fragments: list[str] = (), date: str | None = None
) -> DataFrame:
    """Drop urls on excluded hosts or with excluded fragments, or without the wanted date."""
    ok = ~F.coalesce(url_host(F.col(url)).isin(list(hosts)), F.lit(False))
    ok = ok & ~contains_any(F.col(url), list(fragments))
    if date:
        ok = ok & F.contains(F.col(url), F.lit(date))
    return df.filter(ok)


def extract_links(pages: DataFrame, html: str, site: str, pattern: str, prefix: str | None = None) -> DataFrame:
    """Distinct ``(site, link)``; relative links get the site in front."""
    found = unnest(pages, [site], F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))), "path")
    base = F.lit(prefix) if prefix is not None else F.col(site)
    return found.select(site, F.concat(base, F.col("path")).alias("link")).distinct()


def url_host(url: Column) -> Column:
    return F.parse_url(url, F.lit("HOST"))


def merge_categories(
    df: DataFrame, mapping: dict[str, str], name: str, url: str, default: str = "other"
) -> DataFrame:
    """Canonical category of each section name, with the number of its distinct urls."""
    cases = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    category = F.coalesce(F.try_element_at(cases, F.col(name)), F.lit(default))
    return (
        df.select(category.alias("category"), F.col(url).alias("url"))
        .distinct()
        .groupBy("category")
        .agg(F.count("url").alias("urls"))
        .orderBy("urls", "category")
    )


def filter_sentences(
    df: DataFrame, sentences: str, at_least: int = 5, lo: int = 20, hi: int = 400
) -> DataFrame:
    """Records with enough sentences, and in them the clean ones of fitting length."""
    good = F.filter(
        F.col(sentences),
        lambda s: (F.length(s) >= lo) & (F.length(s) < hi) & ~s.contains("<") & ~s.contains(">"),
    )
    return df.filter(F.size(sentences) >= at_least).withColumn(sentences, good)


def clean_lines(df: DataFrame, text: str) -> DataFrame:
    """Noise-free lines of each text, joined again."""
    cleaned = F.transform(F.split(F.col(text), "\n"), tx.clean_line)
    return df.withColumn(text, F.array_join(F.filter(cleaned, lambda s: ~tx.is_noise_line(s)), "\n"))


def select_sentences(df: DataFrame, sentences: str, min_chars: int = 20, min_tokens: int = 5) -> DataFrame:
    """Without the first and the last two sentences of a record; long enough in letters and tokens."""
    inner = F.slice(sentences, F.lit(2), F.greatest(F.size(sentences) - 3, F.lit(0)))
    good = F.filter(inner, lambda s: (F.length(s) >= min_chars) & (F.size(tx.words(s)) >= min_tokens))
    return df.withColumn(sentences, good)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Stable bucket of a key, whatever the partitioning."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % buckets


def split_by_hash(df: DataFrame, key: str, weights: dict[str, int]) -> DataFrame:
    """Label rows with split names in proportion to integer percentages."""
    bucket, upper, label = hash_bucket(F.col(key), sum(weights.values())), 0, F
    for name, weight in weights.items():
        upper += weight
        label = label.when(bucket < upper, F.lit(name))
    return df.withColumn("split", label)


def rebalance(df: DataFrame, label: str, key: str, percent: int = 10) -> DataFrame:
    """Keep a fixed share of class 0 and all of class 1; nulls become 0."""
    kept = df.filter((F.col(label) == 1) | ((F.col(label) == 0) & (hash_bucket(F.col(key)) < percent)))
    return kept.na.fill(0)


def first_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(tx.words(text), 1, n), " ")


def ellipsis(text: Column, n: int = 80) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substr(text, F.lit(1), F.lit(n)), F.lit("..."))).otherwise(text)


def join_labels(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, min_chars: int = 20) -> DataFrame:
    """Attach labels; short texts stay only when their label is not 0."""
    return df.join(labels, key).filter((F.col(label) != 0) | (F.length(text) > min_chars))


def restrict_embeddings(embeddings: DataFrame, vocabulary: DataFrame, word: str) -> DataFrame:
    return embeddings.join(vocabulary.select(word).distinct(), word, "left_semi")
