"""Readers: files and streams to DataFrames, without inference and without whole-file rows.

Block formats (sentences between blank lines) are read with the blank line as record
separator, so each block is one record of a splittable scan and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions import text as tx
from papyra.functions.rows import unnest


# --- plain files -----------------------------------------------------------------
def read_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, multiline: bool = False,
    glob: str | None = None,
) -> DataFrame:
    """JSON lines below a folder, or whole JSON files; bad records give nulls."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE")
    reader = reader.option("multiLine", str(multiline).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def read_text(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """Lines as ``content``. Runs of line breaks count as one, so blank lines go."""
    lines = spark.read.text(path).select(F.col("value").alias("content"))
    return lines if keep_blank else lines.filter(F.col("content") != "")


def parse_labelled(line: Column, first_tab: bool = True) -> Column:
    """``category<TAB>content``: cut at the first tab, or at the first run of tabs."""
    cut = r"(?s)\A([^\t]*)\t(.*)\z" if first_tab else r"(?s)\A([^\t]*)\t+([^\t]*).*\z"
    parts = F.struct(
        F.trim(F.regexp_extract(line, cut, 1)).alias("category"),
        F.trim(F.regexp_extract(line, cut, 2)).alias("content"),
    )
    return F.when(F.contains(line, F.lit("\t")), parts)


def read_labelled(spark: SparkSession, path: str, first_tab: bool = True) -> DataFrame:
    row = spark.read.text(path).select(parse_labelled(F.col("value"), first_tab).alias("r"))
    return row.filter("r is not null").select("r.*")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", str(header).lower()).option("sep", sep).csv(path)


def parse_flag_line(line: Column, n_flags: int) -> Column:
    """``id,free text,0,1,…``: id before the first comma, flags are the fixed-width tail."""
    tail = 2 * n_flags - 1
    shape = rf"(?s)\A([^,]*),(.*)(.{{{tail}}})\z"
    body = F.regexp_extract(line, shape, 2)
    # the body ends with the comma that comes before the flags
    quoted = F.substr(body, F.lit(2), F.length(body) - 3)
    text = F.when(body.startswith('"'), quoted).otherwise(F.regexp_replace(body, r",\z", ""))
    flags = F.split(F.regexp_extract(line, shape, 3), ",")
    places = F.filter(F.transform(flags, lambda f, i: F.when(f == "1", i + 1)), lambda p: p.isNotNull())
    labels = F.when(F.size(places) > 0, F.transform(places, lambda p: p.cast("string"))).otherwise(
        F.array(F.lit("0"))
    )
    return F.struct(
        F.regexp_extract(line, shape, 1).try_cast("double").alias("id"),
        text.alias("text"),
        labels.alias("labels"),
        F.transform(flags, lambda f: f.try_cast("double")).alias("vector"),
    )


def read_flag_csv(spark: SparkSession, path: str, n_flags: int = 22) -> DataFrame:
    """Rows of a flag file; the header is the line whose first field is no number."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = lines.select(parse_flag_line(F.col("value"), n_flags).alias("r")).select("r.*")
    return row.filter(F.col("id").isNotNull())


def read_union(spark: SparkSession, paths: list[str], schema: T.StructType | str, percent: int | None = None) -> DataFrame:
    """All JSON files of several folders in one scan, optionally a stable share of the rows."""
    rows = read_json(spark, paths, schema)
    if percent is None:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(100)) < percent)


def read_embeddings(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``word v1 … vn`` lines; ``prefix`` is cut from the words that carry it."""
    parts = F.split(F.trim("value"), r"\s+")
    word = F.regexp_replace(F.get(parts, F.lit(0)), rf"\A\Q{prefix}\E", "") if prefix else F.get(parts, F.lit(0))
    vector = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).cast("array<float>")
    return spark.read.text(path).filter(F.trim("value") != "").select(word.alias("word"), vector.alias("vector"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


UTTERANCE_SCHEMA = (
    "txt struct<_id:bigint,_VALUE:string>, "
    "act array<struct<domain:string,communicativeFunction:array<string>,slot:string>>"
)


def utterances(xml: DataFrame) -> DataFrame:
    """XML utterances to ``(turn_id, utterance, domains, acts, slots)``."""
    slots = F.transform(F.col("act"), lambda a: F.trim(F.coalesce(a["slot"], F.lit(""))))
    cleaned = F.transform(
        F.filter(slots, lambda s: s != ""),
        lambda s: F.split(F.replace(F.regexp_replace(s, r"[^\S\r\n]+", " "), F.lit('"'), F.lit("")), r"(?m),$\s*"),
    )
    return xml.select(
        F.col("txt._id").cast("string").alias("turn_id"),
        F.col("txt._VALUE").alias("utterance"),
        F.transform("act", lambda a: a["domain"]).alias("domains"),
        F.flatten(F.transform("act", lambda a: a["communicativeFunction"])).alias("acts"),
        F.filter(F.flatten(cleaned), lambda s: s != "").alias("slots"),
    )


# --- blank-line blocks --------------------------------------------------------------
def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block_id, lines)``: runs of non-blank lines, one row per block.

    An empty line ends a record of the scan; lines of blanks only are cut afterwards.
    Ids grow with the position inside a file.
    """
    records = spark.read.option("lineSep", "\n\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("value")
    )
    parts = unnest(records, ["file"], F.split("value", r"(?:\A|\n)\s*(?:\n|\z)"), "block")
    lines = F.filter(F.split("block", "\n"), lambda s: F.trim(s) != "")
    return (
        parts.select("file", F.monotonically_increasing_id().alias("block_id"), lines.alias("lines"))
        .filter(F.size("lines") > 0)
    )


def assemble_docs(spark: SparkSession, path: str) -> DataFrame:
    """Documents between blank lines: bad ones dropped, exact copies merged."""
    from papyra.operators import curate

    docs = read_blocks(spark, path).select(F.col("block_id").alias("doc_id"), F.array_join("lines", "\n").alias("text"))
    return curate.dedup_docs(curate.filter_bad_rows(docs, "text"), "doc_id", "text")


def _columns(lines: Column, names: list[str], pattern: str) -> list[Column]:
    fields = F.transform(lines, lambda s: F.split(F.trim(s), pattern))
    return [
        F.transform(fields, _field(i)).alias(name) for i, name in enumerate(names)
    ]


def _field(i: int):
    return lambda f: F.get(f, F.lit(i))


def read_conll(spark: SparkSession, path: str, columns: list[str] = ("word", "pos", "chunk", "ne")) -> DataFrame:
    """One row per sentence, one array per column."""
    blocks = read_blocks(spark, path)
    return blocks.select("file", F.col("block_id").alias("sent_id"), *_columns(F.col("lines"), list(columns), r"\s+"))


def read_sgml_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``<s>`` … ``</s>`` sentences of three-column lines; lines with fewer columns go."""
    records = spark.read.option("lineSep", "</s>").text(path)
    lines = F.filter(
        F.split("value", "\n"),
        lambda s: (F.trim(s) != "<s>") & (F.size(F.split(F.trim(s), r"\s+")) >= 3),
    )
    rows = records.select(F.monotonically_increasing_id().alias("sent_id"), lines.alias("lines"))
    return rows.filter(F.size("lines") > 0).select(
        "sent_id", *_columns(F.col("lines"), ["word", "pos", "chunk"], r"\s+")
    )


CONLLU = ["id", "word", "lemma", "upos", "pos", "feats", "head", "label"]


def read_conllu(spark: SparkSession, path: str, drop_headless: bool = True) -> DataFrame:
    """Dependency graphs: ``tokens`` array of structs, the artificial root first."""
    blocks = read_blocks(spark, path)
    rows = F.filter(F.col("lines"), lambda s: ~s.startswith("#"))

    def token(line: Column) -> Column:
        f = F.split(F.trim(line), r"\t+")
        field = dict(zip(CONLLU, [F.get(f, F.lit(i)) for i in range(8)]))
        field["word"] = F.regexp_replace(field["word"], r"\s+", "_")
        field["label"] = F.regexp_replace(field["label"], r"(?s)\A([^:]+):.*\z", "$1")
        return F.struct(*[field[c].alias(c) for c in CONLLU], F.element_at(f, -1).alias("supertag"))

    root = F.struct(
        *[F.lit("0" if c == "id" else "ROOT" if c != "head" else "-1").alias(c) for c in CONLLU],
        F.lit("ROOT").alias("supertag"),
    )
    tokens = F.transform(rows, token)
    if drop_headless:
        tokens = F.filter(tokens, lambda t: t["head"] != "_")
    out = blocks.select("file", F.col("block_id").alias("sent_id"), rows.alias("rows"), tokens.alias("tokens"))
    return out.filter(F.size("rows") > 0).select("file", "sent_id", F.concat(F.array(root), "tokens").alias("tokens"))


def edges(graphs: DataFrame) -> DataFrame:
    """Graphs as an edge table; the artificial root has no edge of its own."""
    rows = graphs.select("sent_id", F.explode("tokens").alias("t")).filter("t.id <> '0'")
    return rows.select(
        "sent_id", F.col("t.id").try_cast("int").alias("id"), F.col("t.head").try_cast("int").alias("head"),
        F.col("t.label").alias("label"), F.col("t.word").alias("word"), F.col("t.pos").alias("pos"),
    )


def parse_slash_tagged(line: Column) -> Column:
    """``word/TAG word/TAG``: cut at the last slash; tokens with ``//`` are slashes themselves."""
    return F.transform(
        tx.words(line),
        lambda t: F.struct(
            F.when(t.contains("//"), F.lit("/")).otherwise(F.regexp_extract(t, r"\A(.*)/([^/]*)\z", 1)).alias("word"),
            F.when(t.contains("//"), F.lit("/")).otherwise(F.regexp_extract(t, r"\A(.*)/([^/]*)\z", 2)).alias("tag"),
        ),
    )


def read_slash_tagged(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parse_slash_tagged(F.col("value")).alias("t"))
    return rows.select(
        F.transform("t", lambda t: t["word"]).alias("words"), F.transform("t", lambda t: t["tag"]).alias("tags")
    )


# --- lines in pairs --------------------------------------------------------------------
def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)`` with exact 0-based numbers, for files of any size.

    Lines are counted per scanned split (a small table), running totals over the splits
    of a file give each split its first number, and the place inside a split follows
    from the order in which a task reads it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("_mid"),
        "value",
    )
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("first"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(
        "file", "split", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    return lines.join(starts, ["file", "split"]).select(
        "file", (F.col("start") + F.col("_mid") - F.col("first")).alias("line_no"), "value"
    )


def _line_pairs(spark: SparkSession, path: str) -> DataFrame:
    numbered = read_numbered_lines(spark, path)
    even = F.col("line_no") % 2 == 0
    return numbered.groupBy("file", F.floor(F.col("line_no") / 2).alias("pair")).agg(
        F.max(F.when(even, F.col("value"))).alias("first"), F.max(F.when(~even, F.col("value"))).alias("second")
    ).filter("first is not null and second is not null")


def read_paired_lines(spark: SparkSession, path: str) -> DataFrame:
    """Label line, then text line: ``(x, y)`` token arrays."""
    return _line_pairs(spark, path).select(
        tx.words(F.col("second")).alias("x"), tx.words(F.col("first")).alias("y")
    )


def read_bulk_pairs(spark: SparkSession, path: str, chars: int = 1000) -> DataFrame:
    """Index line, then document line: ``(page_id, text)``."""
    return _line_pairs(spark, path).select(
        F.get_json_object("first", "$.index._id").alias("page_id"),
        F.substring(F.get_json_object("second", "$.text"), 1, chars).alias("text"),
    )


# --- annotation formats on sentence rows ---------------------------------------------
def markup_to_bio(
    df: DataFrame, key: str, text: str, mapping: dict[str, str], lexicon: DataFrame | None = None,
    unsegmented: tuple[str, ...] = ("DOC",),
) -> DataFrame:
    """Inline ``<tag>entity</tag>`` text to ``(key, words, labels)``.

    With a lexicon, pieces are word-segmented except for the ``unsegmented`` types.
    """
    piece = F.regexp_extract_all(F.col(text), F.lit(r"<\w+>[^<]*</\w+>|[^<]+"), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    rows = unnest(df, [key], piece, "_p", "_i").select(
        key, "_i",
        F.when(
            F.col("_p").startswith("<"),
            F.coalesce(F.try_element_at(names, F.regexp_extract("_p", r"\A<(\w+)>", 1)), F.lit("UNK")),
        ).alias("_type"),
        F.trim(F.regexp_replace("_p", r"\A<\w+>|</\w+>\z", "")).alias("_text"),
    )
    if lexicon is None:
        rows = rows.withColumn("_words", tx.words(F.col("_text")))
    else:
        from papyra.operators import segment

        rows = rows.withColumn("_row", F.concat_ws("/", key, "_i"))
        rows = segment.segment(rows, "_row", "_text", lexicon).withColumn(
            "_words",
            F.when(F.col("_type").isin(list(unsegmented)), tx.words(F.col("_text"))).otherwise(
                F.transform("tokens", lambda t: t["token"])
            ),
        )
    tagged = F.transform(
        "_words",
        lambda w, i: F.struct(
            w.alias("word"),
            F.when(F.col("_type").isNull(), F.lit("O"))
            .otherwise(F.concat(F.when(i == 0, F.lit("B-")).otherwise(F.lit("I-")), F.col("_type")))
            .alias("label"),
        ),
    )
    listed = F.array_sort(F.collect_list(F.struct("_i", tagged.alias("t"))))
    whole = rows.groupBy(key).agg(F.flatten(F.transform(listed, lambda p: p["t"])).alias("t"))
    return whole.select(
        key, F.transform("t", lambda t: t["word"]).alias("words"), F.transform("t", lambda t: t["label"]).alias("labels")
    )


def spanid_to_bio(labels: Column, mapping: dict[str, str]) -> Column:
    """``Label[7]`` marks to B/I labels: a new number starts an entity."""
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    shape = r"\A(\w+)\[(\d+)\]\z"
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, label: Column) -> Column:
        number = F.regexp_extract(label, shape, 2).cast("int")
        kind = F.try_element_at(names, F.regexp_extract(label, shape, 1))
        prefix = F.when(number != acc["last"], F.lit("B-")).otherwise(F.lit("I-"))
        return F.when(
            label.rlike(shape),
            F.struct(number.alias("last"), F.array_append(acc["out"], F.concat(prefix, kind)).alias("out")),
        ).otherwise(F.struct(acc["last"].alias("last"), F.array_append(acc["out"], F.lit("O")).alias("out")))

    return F.aggregate(labels, start, step, lambda a: a["out"])


def bio_to_markup(words: Column, labels: Column, mapping: dict[str, str]) -> Column:
    """Runs of one entity type wrapped in its tag."""
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    types = F.transform(labels, lambda l: F.coalesce(F.try_element_at(names, F.regexp_extract(l, r"\A[BI]-(.*)\z", 1)), F.lit("O")))

    def build(t: Column) -> Column:
        def piece(word: Column, i: Column) -> Column:
            kind = F.get(t, i)
            opens = (kind != "O") & ~F.equal_null(F.when(i > 0, F.get(t, i - 1)), kind)
            closes = (kind != "O") & ~F.equal_null(F.get(t, i + 1), kind)
            return F.concat(
                F.when(opens, F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(F.lit("")),
                word,
                F.when(closes, F.concat(F.lit("</"), kind, F.lit(">"))).otherwise(F.lit("")),
            )

        return F.array_join(F.transform(words, piece), " ")

    return tx.let(types, build)


DIALOG_ACTS = "map<string,map<string,struct<dialog_act:map<string,array<array<string>>>,span_info:array<array<string>>>>>"


def read_dialog_acts(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Map-of-maps dialog acts to ``(dialog_id, turn_id, acts, spans)``.

    Each line is one JSON object holding any number of dialogs; ``whole_file`` reads an
    object that spans lines.
    """
    records = spark.read.text(path, wholetext=whole_file)
    dialogs = records.select(F.explode(F.from_json("value", DIALOG_ACTS)).alias("dialog_id", "turns"))
    turns = dialogs.select("dialog_id", F.explode("turns").alias("turn_id", "t"))
    spans = F.transform(
        F.col("t.span_info"),
        lambda s: F.struct(
            F.get(s, F.lit(0)).alias("act"), F.get(s, F.lit(1)).alias("slot"), F.get(s, F.lit(2)).alias("value"),
            F.get(s, F.lit(3)).try_cast("int").alias("start"), F.get(s, F.lit(4)).try_cast("int").alias("end"),
        ),
    )
    return turns.select("dialog_id", "turn_id", F.map_keys("t.dialog_act").alias("acts"), spans.alias("spans"))


# --- grids -------------------------------------------------------------------------------
def grid_series(
    grid: DataFrame, stations: DataFrame, columns: list[tuple[str, int]], step: float = 2.5
) -> DataFrame:
    """Daily series per station from a long grid ``(var, time, level, lat_id, lon_id, value)``.

    A station reads its enclosing cell; each wanted ``(var, level)`` becomes a column.
    """
    cells = stations.select(
        "station",
        ((90 - F.col("lat")) / step).cast("int").alias("lat_id"),
        (F.col("lon") / step).cast("int").alias("lon_id"),
    )
    wanted = grid.filter(F.col("var").isin(sorted({v for v, _ in columns})))
    picks = [
        F.max(F.when((F.col("var") == v) & (F.col("level") == l), F.col("value"))).alias(f"{v}_{l}")
        for v, l in columns
    ]
    return wanted.join(cells, ["lat_id", "lon_id"]).groupBy("station", "time").agg(*picks)


# --- tables and streams ----------------------------------------------------------------
def known_urls(spark: SparkSession, source: str, jdbc: dict[str, str] | None = None, url: str = "url") -> DataFrame:
    """Distinct known urls from a database table (``jdbc`` options) or a parquet table."""
    if jdbc is not None:
        rows = spark.read.format("jdbc").options(dbtable=source, **jdbc).load()
    else:
        rows = spark.read.parquet(source)
    return rows.select(url).distinct()


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Topic as a stream of ``(url, text)`` from the earliest offset."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return message_columns(records)


def message_columns(records: DataFrame) -> DataFrame:
    return records.select(F.col("key").cast("string").alias("url"), F.col("value").cast("string").alias("text"))


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def read_text_stream(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
