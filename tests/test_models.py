from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import transitions
from papyra.operators import features, metrics, models, rules, sparse_linear, word_vectors
from papyra.plans import load_all, modeling
from tests.oracle import DATA

SMALL = f"{DATA}/sf0.001"


# --- decoding ------------------------------------------------------------------------------
def test_beam_against_all_paths(spark):
    rng = np.random.default_rng(3)
    table = rng.random((5, 4)).round(6)
    scores = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table])
    got = spark.range(1).select(models.beam(scores, 6).alias("b")).first().b
    paths = sorted(
        ((sum(table[j][i] for j, i in enumerate(p)), list(p)) for p in itertools.product(range(4), repeat=5)),
        key=lambda x: -x[0],
    )
    assert [list(g.path) for g in got] == [p for _, p in paths[:6]]
    assert [g.score for g in got] == pytest.approx([s for s, _ in paths[:6]])


def test_entities(spark):
    words = F.array(*[F.lit(w) for w in "a b c d e f".split()])
    tags = F.array(*[F.lit(t) for t in "B-X I-X B-Y O I-X B-Z".split()])
    row = spark.range(1).select(
        models.extract_entities(words, tags).alias("own"), models.extract_entities(words, tags, swallow=True).alias("run")
    ).first()
    assert [(e.entity, e.type) for e in row.own] == [("a b", "X"), ("c", "Y"), ("f", "Z")]
    assert [(e.entity, e.type) for e in row.run] == [("a b c", "X"), ("c", "Y"), ("f", "Z")]


def test_spans(spark):
    tags = F.array(*[F.lit(t) for t in "B-X I-X I-Y O I-X B-X I-X".split()])
    got = spark.range(1).select(metrics.spans(tags).alias("s")).first().s
    assert [(s.start, s.end, s.type) for s in got] == [(0, 2, "X"), (2, 3, "Y"), (4, 5, "X"), (5, 7, "X")]


def test_attach_rules(spark):
    words = F.array(*[F.lit(w) for w in "anh đã đi bị phạt để".split()])
    tags = F.array(*[F.lit(t) for t in "N R V V V E".split()])
    got = spark.range(1).select(models.attach_rules(words, tags).alias("a")).first().a
    assert [tuple(a) for a in got] == [(2, 3, "advmod"), (4, 5, "aux:pass")]


def test_merge_directions(spark):
    fwd = F.array(*[F.lit(t) for t in ["B-ORG", "B-PER", "O"]])
    bwd = F.array(*[F.lit(t) for t in ["B-LOC", "B-LOC", "B-PER"]])
    assert spark.range(1).select(models.merge_directions(fwd, bwd).alias("x")).first().x == ["B-ORG", "B-LOC", "O"]


def test_remap(spark):
    rows = spark.createDataFrame([("1.7.17.5,1.2",), ("1.7.19.2",), ("9",)], "c string")
    assert [r.c for r in models.remap_classes(rows, "c").collect()] == ["1.7.6", "1.7.19.6", "9"]


# --- token rules ------------------------------------------------------------------------------
def match_by_definition(classes, table):
    labels = [None] * len(classes)

    def annotate(lo, hi):
        best = None
        for order, (name, pattern) in enumerate(table.items()):
            parts = pattern.split()
            for i in range(lo, hi - len(parts) + 1):
                if all(p in classes[i + k] for k, p in enumerate(parts)):
                    key = (-len(parts), order, i)
                    if best is None or key < best[0]:
                        best = (key, i, len(parts), name)
        if best:
            _, at, n, name = best
            labels[at : at + n] = [name] * n
            annotate(lo, at)
            annotate(at + n, hi)

    annotate(0, len(classes))
    return labels


def test_rules_against_recursion(spark):
    rng = np.random.default_rng(5)
    table = {"abc": "a b c", "ab": "a b", "bcd": "b c d", "dd": "d d", "aaaa": "a a a a", "ca": "c a"}
    sentences = [[[x for x in "abcd" if rng.random() < 0.45] for _ in range(rng.integers(1, 14))] for _ in range(200)]
    rows = spark.createDataFrame([(i, s, [str(j) for j in range(len(s))]) for i, s in enumerate(sentences)],
                                 "id int, k array<array<string>>, w array<string>")
    got = rows.select("id", rules.match_rules(F.col("w"), F.col("k"), table).alias("r")).collect()
    for row in got:
        assert list(row.r) == match_by_definition(sentences[row.id], table)


def test_vietnamese_rules(spark):
    words = "tỉnh Thừa_Thiên UBND tỉnh HÀ_TĨNH quốc_lộ 18 báo TT".split()
    col = F.array(*[F.lit(w) for w in words])
    rows = spark.range(1).select(col.alias("w")).withColumn("k", F.transform("w", lambda t: rules.token_classes(t)))
    got = rows.select(rules.match_rules(F.col("w"), F.col("k")).alias("r")).first().r
    assert got == ["locProvince", "locProvince", "orgAdmin", "orgAdmin", "orgAdmin", "locRoad2", "locRoad2", "orgPress", "orgPress"]


# --- transitions ----------------------------------------------------------------------------------
def sentence(heads):
    tokens = [dict(id="0", head="-1", label="ROOT")] + [
        dict(id=str(i), head=str(h), label=f"l{h % 3}") for i, h in enumerate(heads, 1)
    ]
    for t in tokens:
        t.update(word=f"w{t['id']}", lemma="x", upos="N", pos="N", feats="_", supertag="_", shape="")
    return tokens


def projective(heads):
    arcs = [(min(i, h), max(i, h)) for i, h in enumerate(heads, 1)]
    return not any(a < c < b < d for a, b in arcs for c, d in arcs)


def is_tree(heads):
    for i in range(1, len(heads) + 1):
        seen, at = set(), i
        while at and at not in seen:
            seen.add(at)
            at = heads[at - 1]
        if at:
            return False
    return True


def oracle(sent: list[dict]) -> list[tuple[str, str]]:
    """``(features, transition)`` pairs that rebuild the gold arcs."""
    place = {t["id"]: i for i, t in enumerate(sent)}
    head = [place.get(t["head"], -1) for t in sent]
    first_child: dict[int, int] = {}
    for i in range(len(sent) - 1, 0, -1):
        first_child[head[i]] = i
    state, out = transitions.State(sent), []
    while state.open:
        top, front = state.stack[-1], state.front
        if top > 0 and head[top] == front:
            action = f"LA-{sent[top]['label']}"
        elif head[front] == top:
            action = f"RA-{sent[front]['label']}"
        elif len(state.stack) > 1 and (0 <= head[front] < top or first_child.get(front, top) < top):
            action = "RE"
        else:
            action = "SH"
        out.append((" ".join(state.features()), action))
        state.apply(action)
    return out


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.lists(st.integers(0, n), min_size=n, max_size=n)))
def test_oracle_rebuilds_projective_trees(heads):
    if not is_tree(heads) or not projective(heads):
        return
    sent = sentence(heads)
    steps = oracle(sent)
    state = transitions.State(sent)
    for _, action in steps:
        state.apply(action)
    assert [state.arcs.get(i, (None,))[0] for i in range(1, len(sent))] == heads
    script = iter([a for _, a in steps])
    assert [h for h, _ in transitions.parse(sent, lambda f: [next(script)])] == heads


TOKEN = "id string, word string, lemma string, upos string, pos string, feats string, head string, label string, supertag string, shape string"


def test_gold_steps_are_those_of_the_machine(spark):
    rng = np.random.default_rng(8)
    sentences = [sentence(rng.integers(0, n + 1, n).tolist()) for n in rng.integers(1, 9, 150)]  # trees or not, projective or not
    sentences += [sentence([]), sentence([2, 0, 2]), sentence([0, 1, 2, 1]), sentence([3, 3, 0, 3])]
    sentences[-1][2]["label"] = "nmod-of"
    sentences[-1][3]["word"], sentences[-1][1]["head"] = "a+b", "77"
    names = [c.split()[0] for c in TOKEN.split(", ")]
    rows = [(i, [tuple(t[c] for c in names) for t in s]) for i, s in enumerate(sentences)]
    table = spark.createDataFrame(rows, "id int, tokens array<struct<" + ",".join(c.replace(" ", ":") for c in TOKEN.split(", ")) + ">>")
    got = {r.id: [(x.features, x.transition) for x in r.s] for r in table.select("id", transitions.gold_steps(F.col("tokens")).alias("s")).collect()}
    assert all(got[i] == oracle(s) for i, s in enumerate(sentences))
    kinds = {t[:2] for steps in got.values() for _, t in steps}
    assert kinds == {"SH", "RE", "LA", "RA"}


@pytest.mark.parametrize(
    "heads, want",
    [([0], ["RA-l0"]), ([2, 0], ["SH", "LA-l2", "RA-l0"]), ([0, 1, 1], ["RA-l0", "RA-l1", "RE", "RA-l1"]), ([0, 3, 1], ["RA-l0", "SH", "LA-l0", "RA-l1"])],
)
def test_each_kind_of_transition(spark, heads, want):
    names = [c.split()[0] for c in TOKEN.split(", ")]
    table = spark.createDataFrame([([tuple(t[c] for c in names) for t in sentence(heads)],)], "tokens array<struct<" + ",".join(c.replace(" ", ":") for c in TOKEN.split(", ")) + ">>")
    assert [x.transition for x in table.select(transitions.gold_steps(F.col("tokens")).alias("s")).first().s] == want


def test_transition_features():
    sent = sentence([2, 0, 2])
    state = transitions.State(sent)
    for action in ("SH", "LA-x", "RA-root"):
        state.apply(action)
    got = dict(f.split(":", 1) for f in state.features())
    assert got["ws0"] == "w2" and got["wq0"] == "w3" and got["ds0"] == "root" and got["lcs0"] == "w1"
    assert got["rcs0"] == "None" and got["ws0+ws1"] == "w2+w0" and got["tq0+tq1"] == "N+None"
    assert list(got) == transitions.TEMPLATES


# --- fits: quality floors -------------------------------------------------------------------------
def test_taggers_learn(spark):
    rows = load_all()["f7_sequence_tag_training"].run(spark, SMALL).collect()
    assert all(r.accuracy > 0.9 for r in rows)


def documents_and_words(spark, sf, label):
    rows = models.labelled_documents(spark.read.parquet(f"{DATA}/{sf}/documents.parquet"), spark.read.parquet(f"{DATA}/{sf}/labels.parquet"), label)
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
    return rows.select("id", F.col("category").alias("label"), words.alias("words"))


@pytest.mark.parametrize("sf, multinomial", [("sf0.01", False), ("sf0.001", True)])
def test_sparse_fit_reaches_the_loss_of_the_dense_one(spark, sf, multinomial):
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as mlc
    from pyspark.ml import feature as mlf

    rows = documents_and_words(spark, sf, "quality")
    examples = rows.select("label", F.transform("words", lambda t: F.struct(t.alias("feature"), F.lit(1.0).alias("value"))).alias("features"))
    model = sparse_linear.fit(examples, penalty=0.01, tolerance=1e-2, multinomial=multinomial, shard_weights=20_000)
    dense = Pipeline(stages=[
        mlf.StringIndexer(inputCol="label", outputCol="_y"), mlf.CountVectorizer(inputCol="words", outputCol="_x", minDF=1, vocabSize=1 << 20),
        mlc.LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial" if multinomial else "binomial", maxIter=200, regParam=0.01, standardization=False, tol=1e-8),
    ]).fit(rows)
    assert model.loss <= 1.01 * dense.stages[2].summary.objectiveHistory[-1]
    assert model.weights.count() == len(dense.stages[1].vocabulary)  # no feature is left out


def test_sparse_fit_of_few_and_odd_rows(spark):
    schema = "id int, label string, features array<struct<feature:string,value:double>>"
    assert sparse_linear.fit(spark.createDataFrame([], schema)).labels == []
    one = sparse_linear.fit(spark.createDataFrame([(1, "a", [("x", 1.0)])], schema))
    assert one.labels == ["a"] and one.weights.count() == 0
    rows = [(i, "ab"[i % 2], [("even" if i % 2 else "odd", 1.0), ("same", 2.0), ("same", 1.0), (None, 5.0)]) for i in range(40)]
    rows += [(40, None, [("x", 1.0)]), (41, "a", None), (42, "b", [])]
    table = spark.createDataFrame(rows, schema)
    model = sparse_linear.fit(table, penalty=0.001, tolerance=0.05)
    weights = {r.feature: r.weights for r in model.weights.collect()}
    assert set(weights) == {"even", "odd", "same"} and len(model.bias) == 1
    out = {r.id: r for r in sparse_linear.predict(table.fillna("?", ["label"]), ["id"], "features", model).collect()}
    assert len(out) == len(rows) and all(out[i].prediction == "ab"[i % 2] for i in range(40))
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 and r.probability == max(r.probabilities.values()) for r in out.values())
    # the loss is what the weights say
    z = [sum(weights.get(f, [0.0])[0] * v for f, v in (fs or []) if f) + model.bias[0] for _, label, fs in rows if label]
    y = [model.labels.index(label) for _, label, _ in rows if label]
    own = np.mean([np.logaddexp(0, a) - b * a for a, b in zip(z, y, strict=True)]) + 0.0005 * sum(w[0] ** 2 for w in weights.values())
    assert own == pytest.approx(model.loss, rel=1e-9)


def test_rows_out_of_arrays_are_not_broadcast(spark):
    """The optimizer takes exploded rows for as small as the table they come from."""
    weights = spark.createDataFrame([("a", [1.0]), ("b", [-1.0])], "feature string, weights array<double>")
    model = sparse_linear.SparseModel(weights, [0.0], ["no", "yes"], 0.0, 1)
    turns = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b b"])], "id int, w array<string>")
    rows = turns.select("id", F.posexplode("w").alias("pos", "features"))
    out = models.predict_sparse(rows, ["id", "pos"], lambda r: models.feature_counts(F.col("features")), model)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.pos): r.prediction for r in out.collect()} == {(1, 0): "yes", (1, 1): "no", (1, 2): "no", (2, 0): "no"}


def test_shards_grow_with_what_blocks_ask(spark, monkeypatch):
    rows = spark.range(60).select(
        F.concat(F.lit("c"), F.col("id") % 2).alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.concat(F.lit("w"), (F.col("id") * (i + 1)) % 11).alias("feature"), F.lit(1.0).alias("value"))).alias("features"),
    ).repartition(5)
    one = sparse_linear.fit(rows, penalty=0.01, tolerance=1e-3)
    monkeypatch.setattr(sparse_linear, "SHARD_ASKED", 20)  # five blocks of twelve features ask for 60 weights
    several = sparse_linear.fit(rows, penalty=0.01, tolerance=1e-3)
    assert several.loss == pytest.approx(one.loss, rel=1e-9) and several.iterations == one.iterations
    weights = lambda m: {r.feature: r.weights for r in m.weights.collect()}
    first, second = weights(one), weights(several)
    assert first.keys() == second.keys() and len(first) == 11
    assert all(second[k] == pytest.approx(first[k], abs=1e-6) for k in first)


def test_direction_is_that_of_the_two_loops():
    rng = np.random.default_rng(0)
    steps, hessian = rng.normal(size=(4, 9)), np.diag(rng.uniform(1, 3, 9))
    changes, gradient = steps @ hessian, rng.normal(size=9)
    q, alpha = gradient.copy(), []
    for s, y in zip(steps[::-1], changes[::-1], strict=True):
        alpha.append(s @ q / (s @ y))
        q -= alpha[-1] * y
    q *= steps[-1] @ changes[-1] / (changes[-1] @ changes[-1])
    for s, y, a in zip(steps, changes, alpha[::-1], strict=True):
        q += s * (a - y @ q / (s @ y))
    basis = np.concatenate([steps, changes, [gradient]])
    assert sparse_linear.direction(basis @ basis.T) @ basis == pytest.approx(-q)


def test_sentiment_finds_toxic_texts(spark):
    rows = load_all()["f3_sentiment"].run(spark, SMALL).collect()
    assert {r.kind for r in rows} == {"tfidf-logistic", "tfidf-perceptron"} and all(r.auc > 0.5 for r in rows)


def test_greedy_tagging_is_accurate(spark):
    gold = modeling._tagged_turns(spark, SMALL).select("id", F.posexplode("tags").alias("pos", "gold"))
    out = load_all()["f8_greedy_tag_decoding"].run(spark, SMALL)
    share = out.join(gold, ["id", "pos"]).agg(F.avg((F.col("tag") == F.col("gold")).cast("int"))).first()[0]
    assert share > 0.9


@pytest.mark.parametrize("reverse", [False, True])
def test_folded_tags_are_those_of_a_loop(spark, reverse):
    rng = np.random.default_rng(2)
    labels, words = ["N", "V", "O"], ["a", "b", "c", "D"]
    names = [f"w={w.lower()}" for w in words] + [f"{p}={m}".lower() for p in ("pt", "at") for m in [*labels, features.BOS]]
    names += [f"bt={x};{y}".lower() for x in [*labels, features.BOS] for y in [*labels, features.BOS]][::2]  # some are unknown
    weights = {n: rng.normal(size=3).round(3).tolist() for n in names}
    bias = [0.1, -0.2, 0.0]
    model = sparse_linear.SparseModel(spark.createDataFrame(list(weights.items()), "feature string, weights array<double>"), bias, labels, 0.0, 0)
    rows = [(i, [words[j] for j in rng.integers(0, 4, n)]) for i, n in enumerate(rng.integers(0, 9, 40))] + [(1, ["a", "unseen"]), (None, None), (7, [])]
    table = spark.createDataFrame(rows, "id int, w array<string>")
    given = F.reverse("w") if reverse else F.col("w")
    static = F.transform(given, lambda w: F.concat(F.lit("W="), w))
    got = models.greedy_tag_sparse(table, static, model, reverse).collect()

    def plain(sentence):
        done = []
        for w in sentence[::-1] if reverse else sentence:
            found = [f"w={w}".lower(), *[f.lower() for f in models.tag_history(done, w)]]
            score = np.array(bias) + sum(np.array(weights.get(f, [0.0] * 3)) for f in found)
            done.append(labels[int(score.argmax())])
        return done[::-1] if reverse else done

    want = [(i, w, w if w is None else plain(w)) for i, w in rows]
    assert sorted(((r.id, r.w, r.tags) for r in got), key=str) == sorted(want, key=str)


def test_tagger_vocabulary(spark):
    """The most frequent features by their whole number, in enough rows, equal ones by name; strings are not cached."""
    rows = spark.createDataFrame([("a b a", "x"), ("A c", "y"), ("d d d d", "x"), ("b c", "y"), ("e f", None)], "features string, label string")
    tokens = rows.filter("label is not null").select(F.split(F.lower("features"), " ").alias("_tokens"))
    assert models._frequent(tokens, 9, 2) == ["a", "b", "c"]
    assert models._frequent(tokens, 3, 1) == ["d", "a", "b"]
    model = models.fit_tagger(rows, size=2, min_df=2, iterations=3)
    assert model.stages[2].vocabulary == ["a", "b"] and set(model.stages[0].labels) == {"x", "y"}
    assert model.transform(rows).select("_prediction").count() == 4


def test_backward_tagging(spark):
    rows = modeling._tag_rows(spark, SMALL, reverse=True)
    tagger = models.LinearTagger.of(models.fit_tagger(rows, size=2048, iterations=8))
    turns = modeling._tagged_turns(spark, SMALL).withColumn("s", features.useful_shapes(F.reverse("w")))
    static = features.tag_context(F.reverse("w"), None, 0, shapes=F.col("s"))
    out = models.greedy_tag(turns, "w", static, tagger, reverse=True, out="got")
    same = F.size(F.filter(F.zip_with("tags", "got", lambda a, b: a == b), lambda x: x))
    assert out.agg(F.sum(same) / F.sum(F.size("w"))).first()[0] > 0.9


def test_parser_learns(spark):
    row = load_all()["f14_batch_parse"].run(spark, SMALL).first()
    assert row.uas > 0.7 and row.las > 0.7


def test_parsing_in_step_is_parsing_one_by_one():
    """Also with a plus in words, other case, null fields, equal scores and sentences without tokens."""
    random = np.random.default_rng(5)
    words = ["a", "B", "+", "a+b", "None", None, "c"]
    fields = ["id", "word", "lemma", "upos", "pos", "feats", "head", "label", "supertag", "shape"]

    def token(i):
        one = {f: str(i) if f == "id" else words[random.integers(len(words))] for f in fields}
        return one | {"word": one["word"] or "d"}

    sentences = [[token(i) for i in range(random.integers(0, 9))] for _ in range(300)]
    labels = ["SH", "RE", "LA-x", "RA-Y", "RA-x", "LA-b+c"]
    seen = {f.lower() for sent in sentences if len(sent) > 1 for f in transitions.State(sent).features()}
    seen |= {f"{t}:{v}" for t in ("ds0", "lcs0", "rcs0") for v in ("y", "x", "a", "a+b", "none")} | {"ws0+wq0:a+b+a+b", "ts0+ts1+tq0:+++++"}
    ids = {f: i for i, f in enumerate(sorted(seen))}
    tagger = models.LinearTagger(ids, random.integers(-3, 4, (len(ids), len(labels))) / 4, random.integers(-1, 2, len(labels)) / 1.0, labels)
    kind = pa.list_(pa.struct([(f, pa.string()) for f in fields]))
    made = transitions.Lockstep(ids, tagger.weights, tagger.bias, labels).parse(pa.array([[], *sentences][1:], kind).slice(3))
    want = [[(s[i]["id"], s[h]["id"], label) for i, (h, label) in enumerate(transitions.parse(s, tagger.ranked), 1)] for s in sentences[3:]]
    assert [[(t["id"], t["head"], t["label"]) for t in s] for s in made.to_pylist()] == want


def test_scores_of_places_at_once():
    random = np.random.default_rng(2)
    ids = {f"f={i}": i for i in range(30)}
    tagger = models.LinearTagger(ids, random.random((30, 5)), random.random(5), list("abcde"))
    places = [{"features": " ".join(f"F={j}" for j in random.integers(0, 60, n))} for n in (3, 0, 9, 1, 5, 7, 0)]
    made = list(models._bases(tagger, places, at_once=3))
    assert len(made) == len(places) and not list(models._bases(tagger, []))
    for place, row in zip(places, made):
        assert row == pytest.approx(tagger.scores(place["features"].split(" ")))


def test_restoration(spark):
    out = load_all()["f15_diacritic_restoration"].run(spark, SMALL).cache()
    assert out.groupBy("id").count().agg(F.max("count")).first()[0] == 2
    best = out.groupBy("id").agg(F.max_by("restored", "score").alias("best"))
    text = modeling._turn_sentences(spark, SMALL).select("id", F.lower("text").alias("text"))
    pairs = text.join(best, "id").select(F.trim("text").alias("text"), F.trim("best").alias("best"))
    # letters outside the accent tables (such as n with tilde) are kept, so lengths agree
    assert pairs.filter(F.length("text") != F.length("best")).count() == 0
    assert metrics.char_accuracy(pairs, "text", "best").first()[0] > 0.97


def test_classifiers_learn(spark):
    rows = load_all()["f1_text_classifier"].run(spark, SMALL).collect()
    assert {r.kind for r in rows} == {"count-logistic", "hash-perceptron", "hash-forest"}
    assert max(r.accuracy for r in rows) > 0.8


def test_tabular_fits(spark):
    rows = load_all()["f4_tabular_classifiers"].run(spark, SMALL).collect()
    assert all(0.4 < r.auc <= 1 for r in rows)


def test_word_vectors(spark, monkeypatch):
    """Words of one kind of sentence are closer than others; the vocabulary is a table, and blocks may be small."""
    random = np.random.default_rng(3)
    kinds = [["red", "green", "blue", "pink"], ["one", "two", "three", "four"]]
    rows = [(" ".join(random.choice(kinds[i % 2], 6)),) for i in range(3000)] + [("Rare rare lone",), (None,), ("",)]
    texts = spark.createDataFrame(rows, "text string").repartition(3)
    monkeypatch.setattr(word_vectors, "BLOCK_WORDS", 5000)
    assert models.fit_word_vectors(texts, "text", size=8, min_count=2).filter("word = 'rare'").count() == 1
    found = models.fit_word_vectors(texts, "text", size=8, iterations=4)
    assert sorted(r.word for r in found.collect()) == sorted(sum(kinds, []))
    for kind in kinds:
        near = [r.word for r in models.synonyms(found, kind[0], 3).collect()]
        assert sorted(near) == sorted(kind[1:])
    assert models.synonyms(found, "unknown", 3).count() == 0


def test_topics(spark):
    docs = modeling._docs(spark, SMALL)
    model = models.fit_topics(docs, "text", k=3, features=256, iterations=3)
    shares = models.topic_distribution(docs, "text", model).select(F.aggregate("topics", F.lit(0.0), lambda a, x: a + x).alias("s"))
    # a document without any vocabulary word has no shares at all
    sums = [r.s for r in shares.collect()]
    assert all(abs(x - 1) < 1e-6 or x == 0 for x in sums) and max(sums) > 0
    assert models.topic_bound(docs, "text", model) < 0
