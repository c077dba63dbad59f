"""Models: ML pipelines for text, tables, topics, word vectors and sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mlc
from pyspark.ml import feature as mlf
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions import text as tx
from papyra.functions import transitions
from papyra.functions.arrow import struct_lists
from papyra.functions.rows import unnest, unnest_structs
from papyra.functions.shapes import PARSER_SHAPES, placeholder, word_shape
from papyra.operators import features as fx
from papyra.operators import sparse_linear, word_vectors
from papyra.operators.sparse_linear import SparseModel
from papyra.session import materialize

# ---- fixed values -----------------------------------------------------------
SEED = 220712
CLASS_REWRITES = {
    "1.7.17.5": "1.7.6",
    "1.7.17.3": "1.7.6",
    "1.7.19.5": "1.7.19.4",
    "1.7.19.2": "1.7.19.6",
    "1.7.19.6": "1.7.19.3",
    "1.7.17.0": "1.7.6",
}
ATTACHMENTS: list[tuple[str, str, str, str]] = [  # tag, words, tag of the next token, label
    ("R", "đã sẽ sớm không chưa chẳng", "V", "advmod"),
    ("V", "bị được", "V", "aux:pass"),
    ("E", "để", "V", "case"),
]
# ---- end of fixed values ----------------------------------------------------

WEIGHT_BYTES = 512 << 20


def fit_cached(stages: list, df: DataFrame) -> PipelineModel:
    """Fit with the input kept for the passes of the iterative stages."""
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


# --- documents -----------------------------------------------------------------
def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """``(id, category, text)`` rows."""
    joined = docs.select(key, "text").join(labels.select(key, label), key)
    return joined.select(F.col(key).alias("id"), F.col(label).cast("string").alias("category"), "text")


def _token_stages(stop: list[str], min_length: int = 1) -> list:
    return [
        mlf.RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\s+", minTokenLength=min_length),
        mlf.StopWordsRemover(inputCol="tokens", outputCol="unigrams", stopWords=stop),
    ]


def _layers(df: DataFrame, label: str, inputs: int, hidden: list[int]) -> list[int]:
    return [inputs, *hidden, df.select(label).distinct().count()]


def fit_text_classifier(
    df: DataFrame, kind: str = "count-logistic", features: int = 1 << 16, iterations: int = 20,
    regularization: float = 0.01, hidden: list[int] = (16,), trees: int = 20, depth: int = 5,
    stop: list[str] = fx.STOP_WORDS, tolerance: float = sparse_linear.TOLERANCE,
) -> PipelineModel | SparseModel:
    """``count-logistic``, ``hash-perceptron`` or ``hash-forest`` over ``(id, category, text)``.

    The logistic model has all words and word pairs, whatever their number, and runs to ``tolerance``;
    ``features`` and ``iterations`` are for the hashed ones.
    """
    if kind == "count-logistic":
        rows = df.select(F.col("category").alias("label"), word_counts(F.col("text"), stop).alias("features"))
        return sparse_linear.fit(rows, penalty=regularization, tolerance=tolerance)
    stages = [mlf.StringIndexer(inputCol="category", outputCol="label", handleInvalid="skip"), *_token_stages(stop)]
    if kind == "hash-perceptron":
        stages += [
            mlf.HashingTF(inputCol="unigrams", outputCol="features", numFeatures=features, binary=True),
            mlc.MultilayerPerceptronClassifier(
                maxIter=iterations, seed=123, layers=_layers(df, "category", features, list(hidden))
            ),
        ]
    elif kind == "hash-forest":
        stages += [
            mlf.HashingTF(inputCol="unigrams", outputCol="features", numFeatures=features),
            mlc.RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED),
        ]
    else:
        raise ValueError(f"unknown classifier {kind}")
    return fit_cached(stages, df)


def word_counts(text: Column, stop: list[str] = fx.STOP_WORDS) -> Column:
    """Words without stop words and their neighbouring pairs as ``(feature, value)`` structs; repeated ones add up in a model."""
    words = fx.remove_stopwords(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != ""), stop)

    def counted(kept: Column) -> Column:
        one = lambda t: F.struct(t.alias("feature"), F.lit(1.0).alias("value"))
        pairs = F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(F.transform(kept, one), F.transform(pairs, one))

    return tx.let(words, counted)


def predict_labels(df: DataFrame, model: PipelineModel | SparseModel) -> DataFrame:
    """Rows with the predicted label, its probability, and the whole label → probability map."""
    if isinstance(model, SparseModel):
        return predict_sparse(df, ["id", "text"], lambda r: word_counts(F.col("text")), model)
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return out.select(
        *df.columns,
        F.get(names, F.col("prediction").cast("int")).alias("prediction"),
        F.get("_p", F.col("prediction").cast("int")).alias("probability"),
        F.map_from_arrays(names, F.col("_p")).alias("probabilities"),
    )


def predict_sparse(df: DataFrame, identity: list[str], features, model: SparseModel) -> DataFrame:
    """``sparse_linear.predict`` for rows that may repeat: each distinct identity is scored once."""
    rows = df.withColumn("_row", F.sha2(F.to_json(F.struct(*identity)), 256))
    distinct = rows.dropDuplicates(["_row"]).select("_row", features(rows).alias("_features"))
    scored = sparse_linear.predict(distinct, ["_row"], "_features", model).drop("_features")
    # rows out of arrays are many more than the optimizer expects, so none may be sent whole to the driver
    return rows.hint("merge").join(scored, "_row").drop("_row")


@dataclass
class SentimentModel:
    """A logistic model over tf-idf weights, with the inverse frequencies ``(term, idf)`` as a table."""

    linear: SparseModel
    idf: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``label`` (1.0: the model's second class) and ``probability`` of that class."""
        rows = df.withColumn("_row", F.sha2(F.to_json(F.struct(*df.columns)), 256))
        weighted = tfidf_features(rows.dropDuplicates(["_row"]), "_row", self.idf)
        scored = sparse_linear.predict(weighted, ["_row"], "features", self.linear)
        names = self.linear.labels
        second = F.element_at("probabilities", names[-1])
        return rows.hint("merge").join(scored.select("_row", second.alias("score")), "_row").drop("_row").withColumn("label", (F.col("category") == names[-1]).cast("double"))


def tfidf_features(df: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """``(key, features)``: the terms of a text with count times inverse frequency; terms without one are left out."""
    counts = fx.term_counts(df.select(key, _unigrams(F.col("text")).alias("tokens")), key, "tokens")
    found = counts.join(idf, "term").groupBy(key).agg(F.collect_list(F.struct(F.col("term").alias("feature"), (F.col("n") * F.col("idf")).alias("value"))).alias("features"))
    return df.select(key).join(found, key, "left").select(key, F.coalesce("features", F.array().cast("array<struct<feature:string,value:double>>")).alias("features"))


def _unigrams(text: Column) -> Column:
    return fx.remove_stopwords(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != ""), fx.STOP_WORDS)


def fit_sentiment(
    df: DataFrame, kind: str = "tfidf-logistic", features: int = 1 << 16, iterations: int = 20, hidden: list[int] = (16,),
    tolerance: float = sparse_linear.TOLERANCE,
) -> PipelineModel | SentimentModel:
    """Sentiment of ``(category, text)``: tf-idf with a logistic or a perceptron layer.

    The logistic one has all words and runs to ``tolerance``.
    """
    if kind == "tfidf-logistic":
        rows = materialize(df.select("category", "text", F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("_row")), "rows")
        one = rows.dropDuplicates(["_row"])
        seen = fx.term_counts(one.select("_row", _unigrams(F.col("text")).alias("tokens")), "_row", "tokens")
        total = one.count()
        idf = materialize(seen.groupBy("term").agg(F.log((total + 1) / (F.count(F.lit(1)) + 1)).alias("idf")), "idf")
        made = tfidf_features(one, "_row", idf)
        examples = rows.select("_row", F.col("category").alias("label")).join(made, "_row")
        return SentimentModel(sparse_linear.fit(examples, penalty=0.01, tolerance=tolerance), idf)
    stages = [mlf.StringIndexer(inputCol="category", outputCol="label", handleInvalid="skip"), *_token_stages(fx.STOP_WORDS)]
    stages += [
        mlf.HashingTF(inputCol="unigrams", outputCol="tf", numFeatures=features),
        mlf.IDF(inputCol="tf", outputCol="features"),
    ]
    layers = _layers(df, "category", features, list(hidden))
    stages.append(mlc.MultilayerPerceptronClassifier(maxIter=iterations, seed=123, layers=layers))
    return fit_cached(stages, df)


def index_onehot_stages(columns: list[str]) -> list:
    """Frequency index (unseen values skipped) and a one-hot vector with every value kept."""
    index = mlf.StringIndexer(
        inputCols=columns, outputCols=[f"{c}_idx" for c in columns], handleInvalid="skip", stringOrderType="frequencyDesc"
    )
    onehot = mlf.OneHotEncoder(
        inputCols=[f"{c}_idx" for c in columns], outputCols=[f"{c}_vec" for c in columns], dropLast=False
    )
    return [index, onehot]


def scale_stages(columns: list[str], out: str = "scaled") -> list:
    return [
        mlf.VectorAssembler(inputCols=columns, outputCol="assembled", handleInvalid="skip"),
        mlf.StandardScaler(inputCol="assembled", outputCol=out),
    ]


def fit_tabular(
    df: DataFrame, label: str, categories: list[str], kind: str = "logistic", iterations: int = 20, hidden: list[int] = (16,)
) -> PipelineModel:
    """All double columns and one-hot categories, scaled, into a classifier on a 0/1 label."""
    return fit_tabulars(df, label, categories, [kind], iterations, hidden)[0]


def fit_tabulars(
    df: DataFrame, label: str, categories: list[str], kinds: list[str], iterations: int = 20, hidden: list[int] = (16,)
) -> list[PipelineModel]:
    """One ``fit_tabular`` model for each kind; the rows are kept, and indexed and scaled, once for all of them."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name != label]
    inputs = [f"{c}_vec" for c in categories] + doubles
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        made = Pipeline(stages=[*index_onehot_stages(categories), *scale_stages(inputs, "features")]).fit(rows)
        width = len(doubles) + sum(len(values) for values in made.stages[0].labelsArray)
        vectors, out = made.transform(rows).select(label, "features"), []
        for kind in kinds:
            if kind == "logistic":
                last = mlc.LogisticRegression(labelCol=label, maxIter=iterations)
            else:
                last = mlc.MultilayerPerceptronClassifier(labelCol=label, maxIter=iterations, seed=1234, layers=[width, *hidden, 2])
            out.append(PipelineModel([*made.stages, last.fit(vectors)]))
        return out
    finally:
        rows.unpersist()


def score_column(df: DataFrame, model: PipelineModel | SentimentModel, positive: int = 1, out: str = "score") -> DataFrame:
    """Add the probability of the positive class (for a sparse model, of its second class)."""
    if isinstance(model, SentimentModel):
        return model.transform(df).withColumnRenamed("score", out)
    return model.transform(df).withColumn(out, F.get(vector_to_array("probability"), F.lit(positive)))


# --- topics and word vectors --------------------------------------------------------
def topic_words(text: Column) -> Column:
    """Words of two letters and more, without stop words, figures as placeholders."""
    kept = fx.remove_stopwords(fx.tokenize_simple(text, min_length=2), fx.STOP_WORDS)
    return F.transform(kept, lambda t: placeholder(t))


def fit_topics(
    df: DataFrame, text: str, k: int = 10, features: int = 1 << 13, min_df: int = 2, iterations: int = 20
) -> PipelineModel:
    rows = df.withColumn("words", topic_words(F.col(text)))
    return fit_cached(
        [
            mlf.CountVectorizer(inputCol="words", outputCol="features", minDF=min_df, vocabSize=features),
            LDA(k=k, maxIter=iterations, seed=SEED),
        ],
        rows,
    )


def topic_distribution(df: DataFrame, text: str, model: PipelineModel) -> DataFrame:
    out = model.transform(df.withColumn("words", topic_words(F.col(text))))
    return out.withColumn("topics", vector_to_array("topicDistribution")).select(*df.columns, "topics")


def topic_terms(df: DataFrame, model: PipelineModel, n: int = 10) -> DataFrame:
    """``(topic, rank, term, weight)`` of the heaviest terms."""
    terms = df.sparkSession.createDataFrame(list(enumerate(model.stages[0].vocabulary)), "term_id int, term string")
    rows = model.stages[1].describeTopics(n).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t")
    )
    return rows.select("topic", "rank", F.col("t.termIndices").alias("term_id"), F.col("t.termWeights").alias("weight")).join(
        terms, "term_id"
    ).select("topic", "rank", "term", "weight")


def topic_bound(df: DataFrame, text: str, model: PipelineModel) -> float:
    """Lower bound on the log-likelihood of the corpus."""
    return model.stages[1].logLikelihood(model.stages[0].transform(df.withColumn("words", topic_words(F.col(text)))))


def fit_word_vectors(df: DataFrame, text: str, size: int = 100, window: int = 5, min_count: int = 3, iterations: int = 1) -> DataFrame:
    """Skip-gram vectors as a table ``(word, vector)``."""
    tokens = df.select(tx.words(F.lower(text)).alias("tokens"))
    return word_vectors.fit(tokens, "tokens", size, window, min_count, iterations, SEED)


def synonyms(vectors: DataFrame, word: str, n: int = 10) -> DataFrame:
    return word_vectors.closest(vectors, word, n)


# --- sequence tagging ------------------------------------------------------------------
def feature_counts(features: Column) -> Column:
    """Blank-separated feature strings, in lower case, as ``(feature, value)`` structs."""
    names = F.filter(F.split(F.lower(F.coalesce(features, F.lit(""))), r"\s+"), lambda t: t != "")
    return F.transform(names, lambda t: F.struct(t.alias("feature"), F.lit(1.0).alias("value")))


def fit_sparse_tagger(rows: DataFrame, features: str = "features", label: str = "label", regularization: float = 1e-4, tolerance: float = sparse_linear.TOLERANCE) -> SparseModel:
    """Multinomial regression from all feature strings to labels; weights stay a table."""
    made = rows.select(F.col(label).alias("label"), feature_counts(F.col(features)).alias("features"))
    return sparse_linear.fit(made, penalty=regularization, tolerance=tolerance, multinomial=True)


def fit_tagger(
    rows: DataFrame, features: str = "features", label: str = "label", kind: str = "counts", size: int = 1 << 15,
    min_df: int = 1, iterations: int = 20, regularization: float = 1e-4,
) -> PipelineModel:
    """Multinomial regression from feature strings, counted or hashed, to labels.

    The strings are written once and read for the vocabulary and the vectors; only vectors are kept for the iterations.
    """
    written = materialize(rows.select(features, label), "samples")
    stages = [
        mlf.StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip").fit(written),
        mlf.RegexTokenizer(inputCol=features, outputCol="_tokens", pattern=r"\s+"),
    ]
    tokens = PipelineModel(stages).transform(written)
    if kind == "counts":
        stages.append(mlf.CountVectorizerModel.from_vocabulary(_frequent(tokens.select("_tokens"), size, min_df), "_tokens", "_vector"))
    else:
        stages.append(mlf.HashingTF(inputCol="_tokens", outputCol="_vector", numFeatures=size))
    regression = mlc.LogisticRegression(
        featuresCol="_vector", labelCol="_label", predictionCol="_prediction", family="multinomial",
        maxIter=iterations, regParam=regularization, standardization=False, tol=1e-5,
    )
    fitted = fit_cached([regression], stages[2].transform(tokens).select("_label", "_vector"))
    return PipelineModel([*stages, *fitted.stages])


def _frequent(rows: DataFrame, size: int, min_df: int) -> list[str]:
    """The ``size`` most frequent tokens of those in ``min_df`` rows and more; equal ones by name.

    A row's different tokens come first and its repeated ones after them, so that one map-side count tells both numbers.
    """
    t = F.col("_tokens")
    rows = rows.select("_tokens", F.array_distinct(t).alias("_different"))
    again = F.when(F.size("_different") < F.size(t), F.filter(t, lambda x, i: F.array_position(t, x) != i + 1)).otherwise(F.array().cast("array<string>"))
    terms = unnest(rows.select(F.size("_different").alias("_n"), F.concat("_different", again).alias("_terms")), ["_n"], "_terms", "term", "_pos")
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.count_if(F.col("_pos") < F.col("_n")).alias("df"))
    top = counts.filter(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(size)
    return [r["term"] for r in top.select("term").collect()]


@dataclass
class LinearTagger:
    """Weights of a counted tagger, the part that decoding needs on the workers."""

    ids: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    labels: list[str]

    @staticmethod
    def of(model: PipelineModel) -> LinearTagger:
        regression = model.stages[3]
        weights = regression.coefficientMatrix.toArray().T.copy()
        if weights.nbytes > WEIGHT_BYTES:
            raise ValueError("the weight table is too large to send to every worker")
        return LinearTagger(
            {t: i for i, t in enumerate(model.stages[2].vocabulary)}, weights,
            regression.interceptVector.toArray(), list(model.stages[0].labels),
        )

    def scores(self, names: list[str]) -> np.ndarray:
        found = [i for i in (self.ids.get(n.lower()) for n in names) if i is not None]
        return self.weights[found].sum(axis=0) + self.bias

    def row(self, name: str) -> np.ndarray | float:
        """Weights of one feature, zero for an unknown one."""
        i = self.ids.get(name.lower())
        return 0.0 if i is None else self.weights[i]

    def best(self, names: list[str]) -> str:
        return self.labels[int(self.scores(names).argmax())]

    def ranked(self, names: list[str]) -> list[str]:
        return [self.labels[i] for i in np.argsort(-self.scores(names), kind="stable")]


def tag_history(done: list[str], word: str) -> list[str]:
    """Features of the previous two tags."""
    pt = done[-1] if done else fx.BOS
    at = done[-2] if len(done) > 1 else fx.BOS
    return [f"pt={pt}", f"at={at}", f"bt={at};{pt}"]


def entity_history(done: list[str], word: str) -> list[str]:
    t1 = done[-1] if done else "BOS"
    t2 = done[-2] if len(done) > 1 else "BOS"
    return [f"t(-1)={t1}", f"t(-2)={t2}", f"w(0)+t(-1)={word}+{t1}"]


def greedy_tag(
    df: DataFrame, words: str, static: Column, tagger: LinearTagger, history=tag_history, reverse: bool = False,
    out: str = "tags",
) -> DataFrame:
    """Left-to-right decoding, each tag feeding the next ones.

    ``static`` is the array of feature strings that do not depend on tags, computed by
    Spark; a sentence is one row, so decoding needs no grouping. ``reverse`` decodes from
    the right.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared.value
        for texts, feats in batches:
            result = []
            for sentence, lines in zip(texts, feats):
                done: list[str] = []
                for word, line in zip(sentence, lines):
                    done.append(model.best(line.split() + history(done, word)))
                result.append(done)
            yield pd.Series(result, dtype=object)

    if not reverse:
        return df.withColumn(out, decode(F.col(words), static))
    return df.withColumn(out, F.reverse(decode(F.reverse(F.col(words)), static)))


def greedy_tag_sparse(df: DataFrame, static: Column, model: SparseModel, reverse: bool = False, out: str = "tags") -> DataFrame:
    """``greedy_tag`` with weights that stay a table: the scores of the features that do not depend on tags come
    from a join, added up map-side; only the two previous tags are folded, with the weights of their features.

    Those are of bounded number: at most (labels + 1) squared pairs of tags. Equal scores go to the more frequent
    label. ``static`` is the array of feature strings in reading order; ``reverse`` turns the tags of a reading
    from the right around. Rows may repeat; a null sentence has no tags (null).
    """
    spark = df.sparkSession
    marks = [*model.labels, fx.BOS]
    k, zero = len(marks), [0.0] * len(model.bias)
    names = [*[f"pt={m}" for m in marks], *[f"at={m}" for m in marks], *[f"bt={a};{p}" for a in marks for p in marks]]
    wanted = spark.createDataFrame([(n.lower(),) for n in dict.fromkeys(names)], "feature string")
    known = {r["feature"]: list(r["weights"]) for r in model.weights.join(wanted, "feature").collect()}
    table = [known.get(n.lower(), zero) for n in names]
    history = spark.createDataFrame([(table,)], "h array<array<double>>").select("h").scalar()

    rows = materialize(df.withColumn("_lines", static).withColumn("_sentence", F.monotonically_increasing_id()), "sentences")
    places = unnest(rows, ["_sentence"], "_lines", "_line", "_pos").select("_sentence", "_pos", feature_counts(F.col("_line")).alias("_features"))
    scored = sparse_linear.scores(places, ["_sentence", "_pos"], "_features", model)
    listed = scored.groupBy("_sentence").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "scores"))), lambda p: p["scores"]).alias("_scores"))
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def step(state: Column, own: Column) -> Column:
        last, before = state["last"], state["before"]
        whole = added(added(added(own, F.get("_history", last)), F.get("_history", before + k)), F.get("_history", 2 * k + before * k + last))
        best = tx.let(whole, lambda s: F.array_position(s, F.array_max(s)).cast("int") - 1)
        return tx.let(best, lambda b: F.struct(b.alias("last"), last.alias("before"), F.array_append(state["done"], b).alias("done")))

    start = F.struct(F.lit(k - 1).alias("last"), F.lit(k - 1).alias("before"), F.array().cast("array<int>").alias("done"))
    folded = listed.withColumn("_history", history).select("_sentence", F.aggregate("_scores", start, step)["done"].alias("_best"))
    tags = F.transform("_best", lambda b: F.get(F.array(*[F.lit(x) for x in model.labels]), b))
    tags = F.reverse(tags) if reverse else tags
    empty = F.when(F.col("_lines").isNotNull(), F.array().cast("array<string>"))
    return rows.join(folded, "_sentence", "left").select(*df.columns, F.coalesce(tags, empty).alias(out))


def best_path(scores: DataFrame, sentence: str, pos: str, label: str, score: str) -> DataFrame:
    """Highest-scoring label per position, the smallest one on ties."""
    return scores.groupBy(sentence, pos).agg(
        F.min_by(label, F.struct((-F.col(score)).alias("s"), label)).alias(label), F.max(score).alias(score)
    )


def beam(scores: Column, k: int) -> Column:
    """The ``k`` best ``(score, path)`` structs of a position x label score array."""
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("path")))

    def step(paths: Column, row: Column) -> Column:
        longer = F.transform(
            paths,
            lambda p: F.transform(
                row, lambda s, i: F.struct((p["cost"] - s).alias("cost"), F.array_append(p["path"], i).alias("path"))
            ),
        )
        return F.slice(F.array_sort(F.flatten(longer)), 1, k)

    finish = lambda paths: F.transform(paths, lambda p: F.struct((-p["cost"]).alias("score"), p["path"].alias("path")))
    return F.aggregate(scores, start, step, finish)


def merge_directions(forward: Column, backward: Column) -> Column:
    """The backward tag where it is a location and the forward one no organisation."""
    return F.zip_with(
        forward, backward, lambda f, b: F.when(b.endswith("LOC") & ~f.endswith("ORG"), b).otherwise(f)
    )


def extract_entities(words: Column, tags: Column, swallow: bool = False) -> Column:
    """Array of ``(entity, type, start)``; with ``swallow`` a run goes on over a following ``B-``."""
    n = F.size(tags)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(index, lambda i: F.get(tags, i).startswith("B-"))

    def entity(p: Column) -> Column:
        def ends(j: Column) -> Column:
            tag = F.get(tags, j)
            return (j > p) & ((tag == "O") | (F.lit(not swallow) & tag.startswith("B-")))

        end = F.coalesce(F.array_min(F.filter(index, ends)), n)
        return F.struct(
            F.array_join(F.slice(words, p + 1, end - p), " ").alias("entity"),
            F.substr(F.get(tags, p), F.lit(3)).alias("type"),
            p.alias("start"),
        )

    return F.transform(starts, entity)


def attach_rules(words: Column, tags: Column, rules: list[tuple[str, str, str, str]] = ATTACHMENTS) -> Column:
    """``(dependent, head, label)`` arcs from each token to the next by word rules, ids from 1."""

    def arc(word: Column, i: Column) -> Column:
        label = F
        for tag, anchors, following, name in rules:
            test = (F.get(tags, i) == tag) & word.isin(anchors.split()) & (F.get(tags, i + 1) == following)
            label = label.when(test, F.lit(name))
        return F.struct((i + 1).alias("dependent"), (i + 2).alias("head"), label.alias("label"))

    return F.filter(F.transform(words, arc), lambda a: a["label"].isNotNull())


# --- transition parsing ---------------------------------------------------------------
_HEADS = T.ArrayType(
    T.StructType([T.StructField("id", T.StringType()), T.StructField("head", T.StringType()), T.StructField("label", T.StringType())])
)


def _with_shapes(tokens: Column) -> Column:
    """Token structs with the parser's shape, blank for plain words."""

    def shaped(t: Column) -> Column:
        shape = word_shape(t["word"], PARSER_SHAPES)
        return t.withField("shape", F.when(shape.isin("lower", "ROOT"), F.lit("")).otherwise(shape))

    return F.transform(tokens, shaped)


def transition_samples(graphs: DataFrame, key: str = "sent_id") -> DataFrame:
    """Treebank rows (``tokens`` with the root first) to ``(key, features, transition)``."""
    rows = graphs.select(key, _with_shapes(F.col("tokens")).alias("tokens"))
    return unnest_structs(rows, [key], transitions.gold_steps(F.col("tokens")))


def parse_batch(graphs: DataFrame, tagger: LinearTagger, key: str = "sent_id") -> DataFrame:
    """Predicted ``(key, id, head, label)`` rows of sentences, all sentences of an Arrow batch step by step."""
    shared = graphs.sparkSession.sparkContext.broadcast(tagger)

    @F.arrow_udf(_HEADS)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        parser = transitions.Lockstep(model.ids, model.weights, model.bias, model.labels)
        for sentences in batches:
            yield parser.parse(sentences)

    return unnest_structs(graphs, [key], parse(_with_shapes(F.col("tokens"))))


# --- accents -------------------------------------------------------------------------
def restoration_samples(df: DataFrame, key: str, text: str, order: int = 1) -> DataFrame:
    """``(key, features, label)`` at the vowel units of accented text."""
    units = df.select(key, tx.vowel_units(F.col(text)).alias("y")).withColumn(
        "x", F.transform("y", lambda u: tx.strip_diacritics(u, lower=False))
    )
    made = fx.vowel_context(F.col("x"), F.col("y"), order)
    return unnest_structs(units, [key], made).select(key, "features", "label")


def restore_diacritics(df: DataFrame, key: str, text: str, tagger: LinearTagger, k: int = 1) -> DataFrame:
    """``(key, restored, score)``: the best ``k`` accented readings of bare text.

    Features come from Spark, candidates from the vowel tables. Workers only follow the
    ``k`` best partial readings through a sentence, each adding its own last unit.
    """
    units = df.select(key, tx.vowel_units(F.col(text), False).alias("x"))
    rows = units.select(key, "x", fx.vowel_context(F.col("x"), F.col("x"), 0).alias("places"))
    # a second use of "places" keeps it a column of its own, computed once per row
    candidates = F.transform("places", lambda p: tx.vowel_candidates(p["label"]))
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    schema = T.ArrayType(T.StructType([T.StructField("restored", T.StringType()), T.StructField("score", T.DoubleType())]))

    @F.arrow_udf(schema)
    def restore(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model, fields = shared.value, [("restored", pa.string()), ("score", pa.float64())]
        known = {label: i for i, label in enumerate(model.labels)}
        for batch in batches:
            sentences = zip(*[column.to_pylist() for column in batch])
            yield struct_lists((_restore(model, known, *sentence, k) for sentence in sentences), fields)

    found = unnest_structs(rows, [key], restore(F.col("x"), F.col("places"), candidates))
    return found.select(key, "restored", F.round("score", 6).alias("score"))


def _restore(model: LinearTagger, known: dict[str, int], units, places, candidates, k: int) -> list[tuple[str, float]]:
    """Follow the ``k`` best readings; between two places units are taken over as they are."""
    # a reading is a chain of (text, rest of the chain), so longer readings share their start
    beams: list[tuple[float, tuple | None]] = [(0.0, None)]
    at = 0
    for place, choices, base in zip(places, candidates, _bases(model, places)):
        options = [(c, known[c]) for c in choices or () if c in known]
        if not options:
            continue
        gap = units[at : place["pos"]]
        at = place["pos"] + 1
        if gap:
            beams = [(score, (gap[-1], ("".join(gap[:-1]), done))) for score, done in beams]
        rows = np.array([model.row(f"t(-1)={done[0] if done else fx.BOS}") + base for _, done in beams])
        top = rows.max(axis=1)
        totals, at_options = top + np.log(np.exp(rows - top[:, None]).sum(axis=1)), [i for _, i in options]
        shares = (rows[:, at_options] - totals[:, None]).tolist()
        grown = [(score + share, c, done) for (score, done), own in zip(beams, shares) for share, (c, _) in zip(own, options)]
        grown.sort(key=lambda b: -b[0])
        beams = [(score, (c, done)) for score, c, done in grown[:k]]
    rest = "".join(units[at:])
    return [(("".join(_chain(done)) + rest).strip(), score) for score, done in beams]


def _bases(model: LinearTagger, places: list[dict], at_once: int = 512) -> Iterator[np.ndarray]:
    """Scores of the labels at each place by its own features; so many places at a time that their weights stay small."""
    weights, ids = model.weights, model.ids
    for start in range(0, len(places), at_once):
        found = [[i for i in map(ids.get, p["features"].lower().split(" ")) if i is not None] for p in places[start : start + at_once]]
        sums = np.zeros((len(found), weights.shape[1]))
        some = [n for n, f in enumerate(found) if f]
        if some:
            sizes = np.array([len(found[n]) for n in some])
            sums[some] = np.add.reduceat(weights[[i for n in some for i in found[n]]], np.cumsum(sizes) - sizes)
        yield from sums + model.bias


def _chain(done: tuple | None) -> list[str]:
    units = []
    while done:
        units.append(done[0])
        done = done[1]
    return units[::-1]


# --- pairs and classes -----------------------------------------------------------------
def pair_features(
    df: DataFrame, key: str, premise: str, hypothesis: str, vocab: DataFrame, length: int, mode: str = "bow",
    concepts: DataFrame | None = None,
) -> DataFrame:
    """Index features of token-array pairs.

    ``bow`` and ``par`` index both sides, ``seq`` their concatenation, ``concept`` adds the
    related concepts of all tokens.
    """
    index = dict(vocab=vocab, unknown=1, pad=1, base=1)
    if mode in ("bow", "par"):
        out = fx.to_index_sequence(df, key, premise, length=length, out="_a", **index)
        out = fx.to_index_sequence(out, key, hypothesis, length=length, out="_b", **index)
        return out.withColumn("features", fx.stack(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    both = df.withColumn("_tokens", F.concat(premise, hypothesis))
    if mode == "seq":
        return fx.to_index_sequence(both, key, "_tokens", length=length, out="features", **index).drop("_tokens")
    related = fx.concept_ids(both, key, "_tokens", concepts, 2 * length)[1].withColumnRenamed("ids", "_b")
    out = fx.to_index_sequence(both, key, "_tokens", length=2 * length, out="_a", **index).join(related, key, "left")
    out = out.withColumn("_shift", vocab.agg(F.count(F.lit(1)).cast("int")).scalar())
    ids = F.transform(F.coalesce("_b", F.array().cast("array<int>")), lambda i: i + 1)
    shifted = F.transform(fx.pad_to(ids, 2 * length, F.lit(1)), lambda i: F.when(i > 1, i + F.col("_shift")).otherwise(i))
    return out.withColumn("features", F.concat("_a", shifted)).drop("_a", "_b", "_shift", "_tokens")


def remap_classes(df: DataFrame, column: str, rewrites: dict[str, str] = CLASS_REWRITES) -> DataFrame:
    """First class of a comma list, then one rewrite."""
    first = F.split_part(F.col(column), F.lit(","), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in rewrites.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, first), first))
