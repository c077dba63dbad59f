"""Secrets in texts: a trigram index narrows down which texts a rule's regular expression must read.

From each rule's expression a Boolean query over trigrams is derived: stretches of literals, with
alternatives and optional parts multiplied out, must occur, so all their trigrams must. The
inverted index lists, for each trigram that some query asks for, the texts that hold it; a
query intersects these lists within each of its clauses and unites the clauses. Only candidates
are read by the expression. A rule without mandatory trigrams reads every text. Everything here
is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.rows import unnest
from papyra.functions.text import let
from papyra.llm.blocks import ready
from papyra.session import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost matches; one counts if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds and their expressions.
BASE = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
RULES = BASE + MORE
EXPAND = 64
CHUNK = 256


def _strings(items) -> list[list[str] | None]:
    """For each part of a parsed expression, the strings it can be, or None if they are too many."""
    out: list[list[str] | None] = []
    for op, value in items:
        if op is ops.LITERAL:
            out.append([chr(value)])
        elif op is ops.SUBPATTERN:
            inner = _strings(value[3])
            out += inner if len(inner) != 1 else [inner[0]]
        elif op is ops.BRANCH:
            options: list[str] | None = []
            for branch in value[1]:
                parts = _strings(branch)
                if options is None or any(p is None for p in parts):
                    options = None
                else:
                    options += ["".join(x) for x in product(*parts)]
            out.append(options)
        elif op is ops.IN and len(value) <= 8 and all(o is ops.LITERAL for o, _ in value):
            out.append([chr(v) for _, v in value])
        elif op is ops.MAX_REPEAT and value[1] <= 2 and value[0] >= 0:
            inner = _strings(value[2])
            if all(p is not None for p in inner):
                once = ["".join(x) for x in product(*inner)]
                out.append([s for n in range(value[0], value[1] + 1) for s in ("".join(x) for x in product(once, repeat=n))])
            else:
                out.append(None)
        elif op is ops.MAX_REPEAT and value[0] >= 1:
            # the first round is mandatory, then anything may follow
            out += [*_strings(value[2]), None]
        else:
            out.append(None)
    return out


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def clauses(pattern: str) -> list[frozenset[str]]:
    """The Boolean query of an expression: a text can only match if it holds all trigrams of one clause.

    Trigrams are in lower case, as in the index. An empty clause holds for every text.
    """
    found: list[frozenset[str]] = [frozenset()]
    run: list[str] = [""]

    def close() -> None:
        nonlocal found, run
        options = {frozenset(trigrams(s.lower())) for s in run}
        options = {o for o in options if not any(p < o for p in options)}  # the weaker one decides
        if len(found) * len(options) <= EXPAND:
            found = list(dict.fromkeys(a | b for a in found for b in options))
        run = [""]

    for part in [*_strings(parser.parse(pattern)), None]:
        if part is None or len(run) * len(part) > EXPAND:
            close()
            run = part if part else [""]
        else:
            run = [a + b for a in run for b in part]
    return found


def build_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings ``(trigram, doc_id, digest)`` of the wanted trigrams in lower-case texts."""
    low = F.lower("text")
    held = let(low, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in wanted])))
    return unnest(docs, ["doc_id", "digest"], held, "trigram").distinct()


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(doc_id, digest, kinds)``: the rules, of those with mandatory trigrams, that may match a text."""
    spark = index.sparkSession
    query = [(r.kind, n, g, len(c)) for r in rules for n, c in enumerate(clauses(r.pattern)) for g in sorted(c)]
    asked = spark.createDataFrame(query, "kind string, clause int, trigram string, needed int")
    hits = index.join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
    met = hits.groupBy("doc_id", "digest", "kind", "clause", "needed").agg(F.count(F.lit(1)).alias("n")).filter("n = needed")
    return met.groupBy("doc_id", "digest").agg(F.collect_set("kind").alias("kinds"))


def running(lengths: Column) -> Column:
    """Sums of the elements before each place of an array, by chunks, so long arrays stay cheap."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def by_chunk(sizes: Column) -> Column:
        many = F.sequence(F.lit(0), F.floor(F.size(sizes) / CHUNK).cast("int"))
        sums = F.transform(many, lambda c: add(F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))))
        return let(
            let(sums, lambda s: F.transform(many, lambda c: add(F.slice(s, F.lit(1), c)))),
            lambda heads: F.transform(sizes, lambda _, i: F.get(heads, F.floor(i / CHUNK).cast("int")) + add(F.slice(sizes, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK))),
        )

    return let(lengths, by_chunk)


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Sorted ``(start, number, end)`` of a rule's matches, in code points, the end exclusive."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)

    def place(matches: Column) -> Column:
        lengths = F.transform(matches, F.length)
        # before match i: the stretches between matches up to it, and the matches before it
        steps = F.zip_with(F.transform(F.slice(between, F.lit(1), F.size(matches)), F.length), lengths, lambda gap, own: F.struct(gap.alias("gap"), own.alias("own")))
        ends = let(steps, lambda z: F.zip_with(running(F.transform(z, lambda s: s["gap"] + s["own"])), z, lambda before, s: F.struct(
            (before + s["gap"]).alias("start"), F.lit(number).alias("kind"), (before + s["gap"] + s["own"]).alias("end"))))
        kept = F.zip_with(ends, judged, lambda span, value: F.when(F.length(value) >= rule.least, span))
        return F.array_compact(kept)

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.regexp_like(text, pattern), let(whole, place)).otherwise(none)


def with_kinds(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text``) and the kinds whose expression has to read each text."""
    free = [r.kind for r in rules if frozenset() in clauses(r.pattern)]
    bound = [r for r in rules if r.kind not in free]
    keyed = docs.withColumn("digest", F.unhex(F.md5("text")))
    wanted = sorted({g for r in bound for c in clauses(r.pattern) for g in c})
    found = materialize(candidates(build_index(keyed.select("doc_id", "digest", "text"), wanted), bound), "candidates")
    found = found.withColumnsRenamed({"doc_id": "_doc", "digest": "_digest"})
    same = keyed["doc_id"].eqNullSafe(found["_doc"]) & (keyed["digest"] == found["_digest"])
    kinds = F.concat(F.coalesce("kinds", F.array().cast("array<string>")), F.array(*map(F.lit, free)).cast("array<string>"))
    return keyed.join(found, same, "left").withColumn("kinds", kinds).drop("_doc", "_digest", "digest")


def scan(docs: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``: an array of ``(start, kind, end)``, sorted, where kind is the rule's number.

    Positions count code points of the whole text. Null texts count as empty and have no span.
    Repeated rows are scanned one by one; null ids are ids like others. Other columns are not read.
    """
    ready(docs)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = [F.when(F.array_contains("kinds", r.kind), rule_spans(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return with_kinds(rows, rules).select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def rendered(spans: Column, rules: list[Rule]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, rule: Rule, mask: str) -> Column:
    """The text with a rule's matches replaced, in the order in which the expression finds them."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    shown = F.zip_with(whole, judged, lambda m, value: F.when(F.length(value) >= rule.least, F.lit(mask)).otherwise(m))
    parts = F.zip_with(F.split(text, rule.pattern, -1), shown, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.array_join(parts, "")).otherwise(text)


def redact(docs: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id", text: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """All documents and columns, with every secret in the text replaced by ``mask``; null texts stay null."""
    ready(docs)
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    place = docs.columns.index(text)
    rows = docs.select(*own, F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = with_kinds(rows, rules)
    clean = F.col("text")
    for rule in rules:
        clean = let(clean, lambda t, rule=rule: F.when(F.array_contains("kinds", rule.kind), masked(t, rule, mask)).otherwise(t))
    rows = rows.withColumn(f"c{place}", F.when(F.col(f"c{place}").isNotNull(), clean))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
