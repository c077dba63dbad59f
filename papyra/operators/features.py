"""Columns to features: vocabularies, context features, index sequences, small vector steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions.rows import unnest, unnest_structs
from papyra.functions.shapes import full_match, word_shape
from papyra.functions.shapes import NUMBER, PERCENTAGE, PUNCTUATION
from papyra.operators import ordered
from papyra.operators.postings import postings, rows_of, totals
from papyra.session import materialize

# ---- fixed values -----------------------------------------------------------
STOP_WORDS = (
    '"" \\"\\" , . ; ! ? " “ ” ) ( … / : - \' ’ * …/. ", ). ); ), "( ”, và hoặc hay thì là mà những '
    "các cho với khi nếu không chưa chẳng đã sẽ có trong từ về của này đó vậy vào tại như hơn được bị "
    "để vẫn chỉ lại ấy theo bằng đối_với ra nhiều đang đến cũng có_thể rằng nhưng còn đây qua vì sự "
    "trên mà_cả giữa ông bà họ nó người anh chị một hai rất lắm quá nhất '' ./. cô tôi việc phải cùng "
    "bạn mình chúng_tôi chúng_ta ', .\" •_"
).split()
TAGS_KEPT = ["P", "Np", "N", "V", "A"]
BOS, EOS = "$BOS", "$EOS"
# ---- end of fixed values ----------------------------------------------------


# --- tokens and vocabularies ---------------------------------------------------
def tokens_to_rows(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Non-blank tokens with a position from 1, inner blanks as underscores."""
    clean = F.filter(F.transform(tokens, lambda t: tx.trim_blank(t)), lambda t: t != "")
    rows = unnest(df, [key], clean, "token", "_i")
    return rows.select(
        key, (F.col("_i") + 1).alias("pos"), F.regexp_replace("token", r"\s+", "_").alias("token")
    )


def tokenize_simple(
    text: Column, pattern: str = r"\s+", gaps: bool = True, min_length: int = 1, lower: bool = True
) -> Column:
    source = F.lower(text) if lower else text
    parts = F.split(source, pattern) if gaps else F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    return F.filter(parts, lambda t: F.length(t) >= min_length)


def remove_stopwords(tokens: Column, stop: list[str]) -> Column:
    """Without the stop words, compared in lower case."""
    banned = sorted({s.lower() for s in stop})
    return F.filter(tokens, lambda t: ~F.lower(t).isin(banned))


def ngrams(tokens: Column, n: int = 2) -> Column:
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.transform(F.slice(tokens, F.lit(1), count), lambda _, i: F.array_join(F.slice(tokens, i + 1, n), " "))


def vocabulary(
    df: DataFrame, key: str, tokens: str, min_df: int = 1, size: int | None = None, unique: bool = False
) -> DataFrame:
    """``(term, tf, df, term_id)``: terms in at least ``min_df`` rows, numbered by falling frequency.

    All of them, unless the caller asks for the ``size`` most frequent ones.

    Counting is a two-step aggregate: per batch of rows first, then over the corpus. ``unique`` says
    that no key is repeated.
    """
    top = totals(postings(df, key, tokens, unique, listed=False)).filter(F.col("df") >= min_df)
    if size is not None:
        top = top.orderBy(F.desc("tf"), "term").limit(size)
    return numbered(top)


def numbered(top: DataFrame) -> DataFrame:
    """Terms with a ``term_id`` by falling ``tf``."""
    # numbered range by range: the vocabulary does not go through one task
    order = materialize(top.withColumn("_rare", -F.col("tf")), "terms")
    return ordered.row_index(order, [], ["_rare", "term"], "term_id").withColumn("term_id", F.col("term_id").cast("int")).drop("_rare")


def term_counts(df: DataFrame, key: str, tokens: str, binary: bool = False) -> DataFrame:
    """``(key, term, n)``."""
    out = rows_of(postings(df, key, tokens), key, ["term"]).select(key, "term", "n")
    return out.withColumn("n", F.lit(1).cast("long")) if binary else out


def count_vectorize(df: DataFrame, key: str, tokens: str, vocab: DataFrame, binary: bool = False) -> DataFrame:
    """Sparse counts ``(key, term_id, n)`` over a vocabulary table."""
    found = postings(df, key, tokens).join(vocab.select("term", "term_id"), "term")
    out = rows_of(found, key, ["term_id"]).select(key, "term_id", "n")
    return out.withColumn("n", F.lit(1).cast("long")) if binary else out


def hash_tf(df: DataFrame, key: str, tokens: str, buckets: int = 1 << 15, binary: bool = False) -> DataFrame:
    """Sparse hashed counts ``(key, bucket, n)``."""
    bucket = F.pmod(F.hash(F.col("term")), F.lit(buckets)).alias("bucket")
    out = unnest(df, [key], tokens, "term").groupBy(key, bucket).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("n", F.lit(1).cast("long")) if binary else out


def tfidf(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``(key, term, n, weight)`` with weight ``n * ln((rows + 1) / (df + 1))``.

    Terms travel with the keys of their rows behind them, and become rows after the join with the
    document frequencies only.
    """
    found = postings(df, key, tokens)
    documents = totals(found).select("term", F.col("df").alias("_df"))
    counts = rows_of(found.select("term", "keys", "ns").join(documents, "term"), key, ["term", "_df"])
    rows = df.agg(F.count(F.lit(1))).scalar()
    weight = F.col("n") * F.log((rows + 1) / (F.col("_df") + 1))
    return counts.select(key, "term", "n", weight.alias("weight"))


def expand_concepts(df: DataFrame, keys: list[str], tokens: str, dictionary: DataFrame) -> DataFrame:
    """Related concepts of every token, in token order, leaving out those that contain it.

    ``dictionary(word, concept)`` stays a table; Spark broadcasts it when its size allows. Rows go to
    the place of their key before they grow, so a broadcast join sends no concept anywhere.
    """
    rows = unnest(df.select(*keys, tokens).repartition(*keys), keys, tokens, "word", "_pos")
    found = rows.join(dictionary, "word").filter(~F.col("concept").contains(F.col("word")))
    listed = F.array_sort(F.collect_list(F.struct("_pos", "concept")))
    return found.groupBy(*keys).agg(F.transform(listed, lambda c: c["concept"]).alias("concepts"))


def concept_ids(df: DataFrame, key: str, tokens: str, dictionary: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """``(term, tf, term_id)`` of the concepts ``expand_concepts`` would list, and ``(key, ids)``: the first ``length`` of each key.

    How often a concept is met follows from the counts of its words, so all tokens are counted, but
    no row is made of them. The first concepts of most keys stand at their first tokens; only keys that
    have too few there have their other tokens looked up.
    """
    meant = dictionary.filter(~F.col("concept").contains(F.col("word"))).select("word", "concept")
    words = totals(postings(df, key, tokens, unique=True, listed=False)).select(F.col("term").alias("word"), "tf")
    met = words.join(meant, "word").groupBy(F.col("concept").alias("term")).agg(F.sum("tf").alias("tf"))
    known = materialize(numbered(met), "concepts")
    meaning = meant.join(known.select(F.col("term").alias("concept"), "term_id"), "concept")
    first = F.lit(2 * length)

    def looked_up(rows: DataFrame, part: Column, before) -> DataFrame:
        found = unnest(rows, [key], part, "word", "_pos").join(meaning, "word")
        place = F.struct((F.col("_pos") + before).alias("_pos"), "concept", "term_id")
        return found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(place)), 1, length).alias("_found"))

    rows = df.select(key, tokens).filter(F.col(key).isNotNull())
    early = materialize(looked_up(rows, F.slice(tokens, F.lit(1), first), F.lit(0)), "early")
    late = rows.filter(F.size(tokens) > first).join(early.filter(F.size("_found") == length).select(key), key, "left_anti")
    late = looked_up(late, F.slice(tokens, first + 1, F.size(tokens)), first)
    both = early.unionByName(late).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("_found"))).alias("_found"))
    return known, both.select(key, F.transform(F.slice("_found", 1, length), lambda c: c["term_id"]).alias("ids"))


def words_by_tag(df: DataFrame, word: str, tag: str, tags: list[str] | None = None) -> DataFrame:
    """Distinct lower-cased words of the chosen tags, one row per ``(tag, word)``."""
    kept = df.filter(F.col(tag).isin(tags or TAGS_KEPT))
    return kept.select(F.col(tag).alias("tag"), F.lower(word).alias("word")).distinct()


def clean_vocabulary(vocab: DataFrame, term: str = "term") -> DataFrame:
    """Without one-letter terms, figures, punctuation and terms with an apostrophe."""
    t = F.col(term)
    figure = full_match(t, NUMBER) | full_match(t, PERCENTAGE) | full_match(t, PUNCTUATION)
    return vocab.filter((F.length(t) > 1) & ~figure & ~t.contains("'"))


# --- context features: one row per sentence, no shuffle -------------------------
def _at(values: Column, i: Column, before: str, after: str) -> Column:
    n = F.size(values)
    return F.when(i < 0, F.lit(before)).when(i >= n, F.lit(after)).otherwise(F.get(values, i))


def _feature(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), value)


def _useful_shape(token: Column) -> Column:
    shape = F.when(token == "PUNCT", F.lit("PUNCT")).otherwise(word_shape(token))
    return F.when(~shape.isin("", "lower"), shape)


def useful_shapes(words: Column) -> Column:
    """Shape per token, null where it tells nothing."""
    return F.transform(words, lambda w: _useful_shape(w))


def tag_context(words: Column, tags: Column | None, order: int = 2, shapes: Column | None = None) -> Column:
    """Array (per token) of tagging features joined by blanks.

    ``order`` previous tags (1 or 2) take part; 0 leaves them out, as needed before decoding.
    ``shapes`` may be a column that already holds ``useful_shapes``; as the argument of a
    Python function only that form works, Spark takes no nested lambdas there.
    """
    if shapes is not None:
        return _tag_features(words, tags, shapes, order)
    return tx.let(useful_shapes(words), lambda bound: _tag_features(words, tags, bound, order))


def _tag_features(words: Column, tags: Column | None, shapes: Column, order: int) -> Column:
    def features(word: Column, i: Column) -> Column:
        pt, at = (_at(tags, i - 1, BOS, EOS), _at(tags, i - 2, BOS, EOS)) if order else (None, None)
        parts = [
            _feature("pw", _at(words, i - 1, BOS, EOS)),
            _feature("cw", word),
            _feature("nw", _at(words, i + 1, BOS, EOS)),
            _feature("cs", F.get(shapes, i)),
            _feature("ns", F.get(shapes, i + 1)),
            _feature("p2w", _at(words, i - 2, BOS, EOS)),
            _feature("n2w", _at(words, i + 2, BOS, EOS)),
        ]
        parts += [_feature("pt", pt)] if order else []
        if order == 2:
            parts += [_feature("at", at), _feature("bt", F.concat(at, F.lit(";"), pt))]
        return F.concat_ws(" ", *parts)

    return F.transform(words, features)


def entity_context(
    words: Column, pos: Column, chunk: Column, entity: Column, rules: Column | None = None,
    sets: tuple[str, ...] = ("pos", "chunk", "shape", "joint", "regexp"),
) -> Column:
    """Array (per token) of entity features joined by blanks."""
    named = None if rules is None else F.transform(rules, lambda r: F.coalesce(r, F.lit("NA")))
    shapes = F.transform(words, lambda t: F.nullif(word_shape(t), F.lit("")))
    both = F.struct(shapes.alias("shapes"), (F.lit(None) if named is None else named).alias("named"))
    return tx.let(
        both, lambda b: _entity_features(words, pos, chunk, entity, b["shapes"], None if named is None else b["named"], sets)
    )


def _entity_features(
    words: Column, pos: Column, chunk: Column, entity: Column, shapes: Column, named: Column | None,
    sets: tuple[str, ...],
) -> Column:
    def near(values: Column, i: Column) -> Column:
        return _at(values, i, "BOS", "EOS")

    def pair(a: Column, b: Column) -> Column:
        return F.concat(a, F.lit("+"), b)

    def features(word: Column, i: Column) -> Column:
        p0, t1 = F.get(pos, i), near(entity, i - 1)
        w_1, w1, p_1, p1 = near(words, i - 1), near(words, i + 1), near(pos, i - 1), near(pos, i + 1)
        parts = [_feature("w(0)", word)]
        parts += [_feature("p(0)", p0)] if "pos" in sets else []
        parts += [_feature("c(0)", F.get(chunk, i))] if "chunk" in sets else []
        parts += [_feature("t(-1)", t1), _feature("t(-2)", near(entity, i - 2))]
        parts += [_feature("shape", F.get(shapes, i))] if "shape" in sets else []
        if "joint" in sets:
            parts += [
                _feature("w(-1)", w_1), _feature("w(0)+w(-1)", pair(word, w_1)),
                _feature("w(+1)", w1), _feature("w(0)+w(+1)", pair(word, w1)),
            ]
            if "pos" in sets:
                parts += [
                    _feature("p(-1)", p_1), _feature("p(0)+p(-1)", pair(p0, p_1)),
                    _feature("p(+1)", p1), _feature("p(0)+p(+1)", pair(p0, p1)),
                    _feature("p(-1)+p(+1)", pair(p_1, p1)), _feature("w(0)+t(-1)", pair(word, t1)),
                ]
        if "regexp" in sets and named is not None:
            r0, r_1, r1 = F.get(named, i), near(named, i - 1), near(named, i + 1)
            parts += [
                _feature("r(0)", r0), _feature("r(-1)", r_1), _feature("r(0)+r(-1)", pair(r0, r_1)),
                _feature("r(+1)", r1), _feature("r(0)+r(+1)", pair(r0, r1)),
            ]
            for name, left in (("w", word), ("p", p0)):
                parts += [
                    _feature(f"{name}(0)+r({at})", pair(left, r))
                    for at, r in (("0", r0), ("-1", r_1), ("+1", r1))
                ]
        return F.concat_ws(" ", *parts)

    return F.transform(words, features)


def vowel_context(units: Column, labels: Column, order: int = 1) -> Column:
    """Features at the units that are vowel groups: struct array ``(pos, features, label)``.

    Units include single blanks, so the word around a unit is the stretch between blanks.
    """
    text = F.array_join(units, "")
    # blanks in the text up to each unit tell the word the unit lies in
    index = F.aggregate(
        units,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda acc, u: F.struct(
            (acc["n"] + F.when(u == " ", 1).otherwise(0)).alias("n"),
            F.array_append(acc["at"], acc["n"] + F.when(u == " ", 1).otherwise(0)).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    both = F.struct(F.split(text, " ").alias("words"), index.alias("index"))
    return tx.let(both, lambda b: _vowel_features(units, labels, b["words"], b["index"], order))


def _vowel_features(units: Column, labels: Column, words: Column, index: Column, order: int) -> Column:
    triggers = sorted(
        {f for m in (tx.SINGLE_UNITS, tx.PAIR_UNITS, tx.TRIPLE_UNITS) for fs in m.values() for f in fs}
        | set(tx.PAIR_UNITS) | set(tx.TRIPLE_UNITS)
    )

    def features(i: Column) -> Column:
        label = F.get(labels, i)
        c = {k: _at(units, i + k, BOS, EOS) for k in (-2, -1, 0, 1, 2)}
        w = F.get(index, i)
        t1, t2 = _at(labels, i - 1, BOS, EOS), _at(labels, i - 2, BOS, EOS)
        parts = [_feature(f"c({k:+d})" if k else "c(0)", c[k]) for k in (-2, -1, 0, 1, 2)]
        parts += [
            _feature("w(-1)", _at(words, w - 1, BOS, EOS)),
            _feature("w(0)", F.get(words, w)),
            _feature("w(+1)", _at(words, w + 1, BOS, EOS)),
        ]
        parts += [
            _feature(f"{a}{b}", F.concat(c[a - 2], F.lit("+"), c[b - 2]))
            for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (1, 3))
        ]
        parts += [_feature("t(-1)", t1)] if order >= 1 else []
        parts += [_feature("t(-2)", t2), _feature("t(-2)t(-1)", F.concat(t2, t1))] if order == 2 else []
        return F.struct(i.alias("pos"), F.concat_ws(" ", *parts).alias("features"), label.alias("label"))

    places = F.when(F.size(labels) > 0, F.sequence(F.lit(0), F.size(labels) - 1)).when(labels.isNotNull(), F.array().cast("array<int>"))
    return F.transform(F.filter(places, lambda i: F.get(labels, i).isin(triggers)), features)


# --- index sequences -------------------------------------------------------------
def to_index_sequence(
    df: DataFrame, key: str, tokens: str, vocab: DataFrame, length: int, unknown: int = 1, pad: int = 0,
    base: int = 0, keep: str = "head", out: str = "ids",
) -> DataFrame:
    """Token ids (``term_id + base``), cut or right-padded to ``length``.

    ``keep`` is the end that survives a cut: ``head`` or ``tail``. Only the tokens that
    survive are looked up, in a join with the vocabulary table.
    """
    n = F.size(tokens)
    start = F.greatest(n - length, F.lit(0)) + 1 if keep == "tail" else F.lit(1)
    rows = unnest(df, [key], F.slice(tokens, start, F.lit(length)), "term", "_pos")
    ids = rows.join(vocab.select("term", "term_id"), "term", "left").select(
        key, "_pos", F.coalesce(F.col("term_id") + base, F.lit(unknown)).alias("_id")
    )
    listed = F.array_sort(F.collect_list(F.struct("_pos", "_id")))
    found = ids.groupBy(key).agg(F.transform(listed, lambda c: c["_id"]).alias("_ids"))
    none = F.array().cast("array<int>")
    return df.join(found, key, "left").withColumn(
        out, pad_to(F.coalesce(F.col("_ids"), none), length, F.lit(pad))
    ).drop("_ids")


def from_index_sequence(ids: Column, labels: list[str], base: int = 0, default: str = "NA") -> Column:
    names = F.array(*[F.lit(x) for x in labels])
    return F.transform(ids, lambda i: F.coalesce(F.get(names, i.cast("int") - base), F.lit(default)))


def pad_to(values: Column, length: int, filler: Column) -> Column:
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.slice(F.concat(values, F.array_repeat(filler, missing)), 1, length)


def four_planes(ids: Column, length: int, pad: int = 0, mask_on_padding: int = 0) -> Column:
    """Ids, types, positions and mask, each of ``length``, one after the other."""
    n = F.least(F.size(ids), F.lit(length))
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(
        pad_to(ids, length, F.lit(pad)),
        F.array_repeat(F.lit(0), length),
        pad_to(positions, length, F.lit(pad)),
        F.array_repeat(F.lit(1), n),
        F.array_repeat(F.lit(mask_on_padding), missing),
    )


def char_multihot(df: DataFrame, key: str, tokens: str, letters: DataFrame, length: int) -> DataFrame:
    """Active cells ``(key, pos, plane, letter_id)`` of first, middle and last letters.

    The three planes of a dense encoding are kept as rows: first letter, the set of
    middle letters, last letter.
    """
    rows = unnest(df, [key], F.slice(tokens, 1, length), "t", "pos").filter(F.length("t") > 0)
    n = F.length("t")
    middle = F.when(n > 2, F.array_distinct(F.split(F.substr(F.col("t"), F.lit(2), n - 2), ""))).otherwise(
        F.array().cast("array<string>")
    )
    last = F.when(n > 1, F.array(F.right("t", F.lit(1)))).otherwise(F.array().cast("array<string>"))
    cells = F.concat(
        F.array(F.struct(F.lit("first").alias("plane"), F.left("t", F.lit(1)).alias("term"))),
        F.transform(middle, lambda c: F.struct(F.lit("middle").alias("plane"), c.alias("term"))),
        F.transform(last, lambda c: F.struct(F.lit("last").alias("plane"), c.alias("term"))),
    )
    return unnest_structs(rows, [key, "pos"], cells).join(letters.select("term", "term_id"), "term").select(
        key, "pos", "plane", F.col("term_id").alias("letter_id")
    )


def onehot_sequence(df: DataFrame, key: str, tokens: str, vocab: DataFrame, length: int) -> DataFrame:
    """The non-zero cells ``(key, pos, term_id)`` of a length x vocabulary matrix."""
    rows = unnest(df, [key], F.slice(tokens, 1, length), "term", "pos")
    return rows.join(vocab.select("term", "term_id"), "term").select(key, "pos", "term_id")


# --- small vector steps -----------------------------------------------------------
def stack(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def fill(values: Column, constant: float) -> Column:
    return F.transform(values, lambda _: F.lit(constant))


def positions(values: Column) -> Column:
    return F.transform(values, lambda _, i: i)


def smallest_index(values: Column) -> Column:
    """Index of the smallest value, the first one on ties."""
    return F.array_position(values, F.array_min(values)) - 1


def assemble_pair(a: Column, b: Column, separator: str) -> Column:
    return F.concat(a, F.array(F.lit(separator)), b)


def merge_embeddings(parts: list[Column], mode: str = "mean") -> Column:
    """Element-wise mean, or concatenation, of equally keyed embeddings."""
    if mode == "concat":
        return F.concat(*parts)
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda x, y: x + y)
    return F.transform(total, lambda x: x / F.lit(float(len(parts))))


def select_labels(scores: Column, threshold: float = 0.5, k: int | None = None) -> Column:
    """Indices scoring at least the threshold (among the best ``k``), else the single best."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    pool = ranked if k is None else F.slice(ranked, 1, k)
    chosen = F.transform(F.filter(pool, lambda p: -p["s"] >= threshold), lambda p: p["i"])
    chosen = F.sort_array(chosen) if k is None else chosen
    best = F.transform(F.slice(ranked, 1, 1), lambda p: p["i"])
    return F.when(F.size(chosen) > 0, chosen).otherwise(best)


def flag_csv(indices: Column, n: int) -> Column:
    """``0,1,…`` line with ones at the chosen indices."""
    cells = [F.array_contains(indices, i).cast("int").cast("string") for i in range(n)]
    return F.concat_ws(",", *cells)


def mentions(df: DataFrame, words: str, labels: str, outside: str = "O") -> DataFrame:
    """Words with an entity label, most frequent first."""
    pair = F.filter(F.arrays_zip(F.col(words).alias("w"), F.col(labels).alias("l")), lambda p: F.lower(p["l"]) != outside.lower())
    rows = unnest_structs(df, [], pair).select(F.col("w").alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word")


def majority(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Most frequent value of each array (smallest on ties), ``NA`` for an empty one."""
    distinct = F.array_distinct(F.col(values))
    counted = F.transform(
        distinct,
        lambda v: F.struct((-F.size(F.filter(F.col(values), lambda x: x == v))).alias("n"), v.alias("v")),
    )
    best = F.get(F.array_sort(counted), F.lit(0))["v"]
    return df.select(*keys, F.coalesce(best, F.lit("NA")).alias("majority"))


def comment_samples(
    df: DataFrame, keys: list[str], post: str, comments: str, sentiments: str, dropped: tuple[str, ...] = ("NA", "unrelated")
) -> DataFrame:
    """``(keys, text, sentiment)``: each comment behind its post, with the majority sentiment.

    ``comments`` is an array of texts, ``sentiments`` an array of sentiment arrays beside it.
    """
    pairs = F.arrays_zip(F.col(comments).alias("comment"), F.col(sentiments).alias("votes"))
    rows = unnest_structs(df, [*keys, post], pairs)
    voted = majority(rows.withColumn("text", F.concat_ws(" ", post, "comment")), [*keys, "text"], "votes")
    return voted.withColumnRenamed("majority", "sentiment").filter(~F.col("sentiment").isin(list(dropped)))


def head_offsets(ids: Column, heads: Column, labels: Column | None = None) -> Column:
    """Head minus id per token (0 at the root), with ``:label`` when labels are given."""
    offset = F.zip_with(ids, heads, lambda i, h: F.when(h == 0, F.lit(0)).otherwise(h - i))
    if labels is None:
        return F.transform(offset, lambda o: o.cast("string"))
    return F.zip_with(offset, labels, lambda o, l: F.concat(o.cast("string"), F.lit(":"), l))


def lm_windows(df: DataFrame, key: str, ids: str, steps: int) -> DataFrame:
    """The whole corpus as one id stream (by key), cut into windows of ``steps + 1`` ids.

    Windows start every ``steps`` ids, so neighbours share one id. Stream positions come
    from a running total over row lengths; each row then gives its slice of every window
    it touches, and only slices, not single ids, are shuffled.
    """
    sized = df.select(key, F.col(ids).alias("_ids"), F.size(ids).cast("long").alias("_n"))
    placed = ordered.running_total(sized, [key], "_n", "_start")
    start, last = F.col("_start"), F.col("_start") + F.col("_n") - 1
    lowest = F.greatest(F.ceil(start / steps) - 1, F.lit(0))
    windows = F.when(F.col("_n") > 0, F.sequence(lowest, F.floor(last / steps)))

    def piece(w: Column) -> Column:
        """The part of window ``w`` that lies in this row."""
        begin = F.greatest(w * steps, start)
        size = F.least(w * steps + steps, last) - begin + 1
        ids_in = F.slice("_ids", (begin - start + 1).cast("int"), size.cast("int"))
        return F.struct(w.alias("window"), begin.alias("begin"), ids_in.alias("ids"))

    pieces = unnest(placed, [], F.transform(windows, piece), "p").select("p.*")
    grouped = pieces.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("begin", "ids"))).alias("_p"))
    whole = F.flatten(F.transform("_p", lambda p: p["ids"]))
    return grouped.select("window", whole.alias("ids")).filter(F.size("ids") == steps + 1)
