from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from papyra.sources import readers, writers


def write(folder: str, name: str, text: str) -> str:
    path = Path(folder) / name
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture()
def tiny_splits(spark):
    """Scans cut files into splits of a few bytes, as large files are on a cluster."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_blocks_over_splits(spark, folder, tiny_splits):
    blocks = [[f"w{b}_{i}\tN\tO\tB-{b}" for i in range(1 + b % 7)] for b in range(60)]
    gaps = ["\n\n", "\n\n\n", "\n \n", "\n\t\n\n", "\n\n \n\n"]
    text = "\n\n" + "".join("\n".join(b) + gaps[i % len(gaps)] for i, b in enumerate(blocks))
    path = write(folder, "a.conll", text)
    rows = readers.read_conll(spark, path).orderBy("sent_id").collect()
    assert [list(r.word) for r in rows] == [[line.split("\t")[0] for line in b] for b in blocks]
    assert rows[3].ne == ["B-3"] * 4


def test_numbered_lines_over_splits(spark, folder, tiny_splits):
    for name, n in (("a.txt", 301), ("b.txt", 40)):
        write(folder, name, "".join(f"{name} line {i}\n" for i in range(n)))
    rows = readers.read_numbered_lines(spark, folder).collect()
    assert len(rows) == 341
    assert all(r.value == f"{Path(r.file).name} line {r.line_no}" for r in rows)


def test_pairs_over_splits(spark, folder, tiny_splits):
    path = write(folder, "p.inp", "".join(f"y{i} n n\nx{i} b c\n" for i in range(120)) + "dangling\n")
    rows = readers.read_paired_lines(spark, path).collect()
    assert sorted((r.x[0], r.y[0]) for r in rows) == sorted((f"x{i}", f"y{i}") for i in range(120))


def test_conllu(spark, folder):
    text = (
        "# sent 1\n1\tHà Nội\thà nội\tPROPN\tNp\t_\t2\tnsubj:pass\t_\t_\n2\tđẹp\tđẹp\tADJ\tA\t_\t0\troot\t_\t_\n"
        "3-4\tab\t_\t_\t_\t_\t_\t_\t_\t_\n\n\n# only a comment\n\n1\tĐi\tđi\tVERB\tV\t_\t0\troot\t_\tSpaceAfter=No\n"
    )
    graphs = readers.read_conllu(spark, write(folder, "g.conllu", text))
    rows = graphs.orderBy("sent_id").collect()
    assert [[t.word for t in r.tokens] for r in rows] == [["ROOT", "Hà_Nội", "đẹp"], ["ROOT", "Đi"]]
    assert rows[0].tokens[1].label == "nsubj" and rows[1].tokens[1].supertag == "SpaceAfter=No"
    edges = readers.edges(graphs).orderBy("sent_id", "id").collect()
    assert [(e.id, e.head, e.label) for e in edges] == [(1, 2, "nsubj"), (2, 0, "root"), (1, 0, "root")]


def test_labelled_and_slash_lines(spark, folder):
    path = write(folder, "l.tsv", " sport \t a\tb \nno tab here\npolitics\tc\n")
    assert [tuple(r) for r in readers.read_labelled(spark, path).collect()] == [("sport", "a\tb"), ("politics", "c")]
    assert readers.read_labelled(spark, path, first_tab=False).first().content == "a"
    path = write(folder, "pos.txt", "Tôi/P ăn/V 1/2/M ////CH\n\n")
    row = readers.read_slash_tagged(spark, path).first()
    assert (list(row.words), list(row.tags)) == (["Tôi", "ăn", "1/2", "/"], ["P", "V", "M", "/"])


def test_flag_csv(spark, folder):
    zeros, some = ",".join("0" * 22), ",".join("1" if i in (0, 4) else "0" for i in range(22))
    path = write(folder, "f.csv", f"train_id,text,{','.join('abcdefghijklmnopqrstuv')}\n12,plain, text,{zeros}\n13,\"quoted, text\",{some}\n")
    rows = readers.read_flag_csv(spark, path).orderBy("id").collect()
    assert [(r.id, r.text, list(r.labels)) for r in rows] == [(12.0, "plain, text", ["0"]), (13.0, "quoted, text", ["1", "5"])]
    assert sum(rows[1].vector) == 2.0


def test_sgml_and_xml(spark, folder):
    path = write(folder, "t.sgml", "<s>\nTôi P B-NP\nbad\nđi V B-VP\n</s>\n<s>\n</s>\n<s>\nab N O\n</s>\n")
    assert [list(r.word) for r in readers.read_sgml_blocks(spark, path).orderBy("sent_id").collect()] == [["Tôi", "đi"], ["ab"]]
    path = write(
        folder, "d.xml",
        "<TEI.DIALOG><utterance><txt id='3'>xin chào</txt><act><domain>d</domain><communicativeFunction>inform"
        "</communicativeFunction><slot>a:  \"1\",\n b: 2</slot></act></utterance></TEI.DIALOG>",
    )
    schema = "txt struct<_id:bigint,_VALUE:string>, act array<struct<domain:string,communicativeFunction:array<string>,slot:string>>"
    row = readers.utterances(readers.read_xml(spark, path, "utterance", schema)).first()
    assert (row.turn_id, row.utterance, list(row.acts), list(row.slots)) == ("3", "xin chào", ["inform"], ["a: 1", "b: 2"])


def test_annotation_round_trip(spark):
    rows = spark.createDataFrame([("a", "Ông <ng>Nam Cao</ng> ở <dd>Hà Nội</dd> với <vb>Luật 1</vb>")], "id string, text string")
    bio = readers.markup_to_bio(rows, "id", "text", {"ng": "PER", "dd": "LOC", "vb": "DOC"})
    row = bio.first()
    assert list(row.labels) == ["O", "B-PER", "I-PER", "O", "B-LOC", "I-LOC", "O", "B-DOC", "I-DOC"]
    back = bio.select(readers.bio_to_markup(F.col("words"), F.col("labels"), {"PER": "ng", "LOC": "dd", "DOC": "vb"}).alias("t"))
    assert back.first().t == rows.first().text
    lexicon = spark.createDataFrame([("hà nội",)], "term string")
    words = readers.markup_to_bio(rows, "id", "text", {"ng": "PER", "dd": "LOC", "vb": "DOC"}, lexicon).first()
    assert list(words.words) == ["Ông", "Nam_Cao", "ở", "Hà_Nội", "với", "Luật", "1"]


def test_span_ids(spark):
    marks = F.array(*[F.lit(x) for x in ["Location[1]", "Location[1]", "_", "Location[1]", "Person[2]", "_", "Person[3]"]])
    names = {"Location": "LOC", "Person": "PER"}
    got = spark.range(1).select(readers.spanid_to_bio(marks, names).alias("x")).first().x
    assert got == ["B-LOC", "I-LOC", "O", "I-LOC", "B-PER", "O", "B-PER"]


def test_dialog_acts_whole_file(spark, folder):
    path = write(
        folder, "acts.json",
        '{"D1": {"0": {"dialog_act": {"Hotel-Inform": [["area", "north"]]},\n "span_info": [["Hotel-Inform", "area", "north", 3, 4],'
        ' ["x", "y", "z", "?", null]]}},\n "D2": {"1": {"dialog_act": {}, "span_info": []}}}',
    )
    rows = readers.read_dialog_acts(spark, path, whole_file=True).orderBy("dialog_id").collect()
    assert [(r.dialog_id, r.turn_id, list(r.acts)) for r in rows] == [("D1", "0", ["Hotel-Inform"]), ("D2", "1", [])]
    assert [(s.start, s.end) for s in rows[0].spans] == [(3, 4), (None, None)]


def test_bad_json_and_union(spark, folder):
    one, two = Path(folder) / "one", Path(folder) / "two"
    (one / "deep").mkdir(parents=True)
    two.mkdir()
    write(str(one / "deep"), "a.json", '{"id": 1}\nnot json\n')
    write(str(two), "b.json", '{"id": 2}\n')
    write(str(two), "c.txt", '{"id": 3}\n')
    rows = readers.read_json(spark, [str(one), str(two)], "id int", glob="*.json").collect()
    assert sorted((r.id or 0) for r in rows) == [0, 1, 2]
    everything = readers.read_union(spark, [str(one), str(two)], "id int").count()
    assert 0 <= readers.read_union(spark, [str(one), str(two)], "id int", percent=50).count() <= everything == 4


def test_writers(spark, folder):
    rows = spark.range(1000).withColumn("text", F.concat(F.lit("t"), "id"))
    writers.write_corpus(rows, f"{folder}/gz", 3)
    assert len(list(Path(f"{folder}/gz").glob("*.json.gz"))) == 3
    writers.write_json(rows.repartition(5), f"{folder}/one", single=True)
    assert len(list(Path(f"{folder}/one").glob("*.json"))) == 1
    writers.write_json(rows.repartition(5), f"{folder}/many")
    assert len(list(Path(f"{folder}/many").glob("*.json"))) == 5
    eval_rows = spark.createDataFrame([(["B-X", "O"], ["O", "O"])], "g array<string>, p array<string>")
    writers.write_conll_eval(eval_rows, "g", "p", f"{folder}/eval")
    assert "".join(p.read_text() for p in Path(f"{folder}/eval").glob("*.txt")) == "B-X O\nO O\n\n"
    urls = spark.createDataFrame([("u" * 300,), ("v",)], "url string")
    writers.write_known_urls(urls, f"{folder}/urls")
    writers.write_known_urls(urls, f"{folder}/urls")
    assert [r.url for r in readers.known_urls(spark, f"{folder}/urls").collect()] == ["v"]


def test_stream_sources_build(spark, folder):
    assert readers.read_socket(spark, "127.0.0.1", 9999).columns == ["value"]
    assert readers.read_text_stream(spark, folder, "*.log").isStreaming
