"""Report and record plans, outside answers and PDF text: hand-worked cases."""

import hashlib
import hmac
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillmesh.functions import rewrite, text
from quillmesh.operators import similarity, store
from quillmesh.plans import reports
from quillmesh.sources import files, live, pdf


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "code, want",
    [
        ('u = "http://x # y" ; // gone', "ID = ID ;"),
        ("''' two\nlines ''' def f ( x ) :", "def ID ( ID ) :"),
        ("s = 'it\\'s' + 1.5e3", "ID = ID + ID"),
        ("x1y2 3x /* a // b */ if", "ID ID if"),
        ('"open', "ID"),
    ],
)
def test_code(spark, code, want):
    assert one(spark, F.array_join(rewrite.code_tokens(F.col("t")), " "), code) == want


def test_latex(spark):
    source = "A \\textbf{b} \\cite[p. 2]{key} c $$x$$ \\[ y \\] \\begin{equation*}z\\end{equation*} d\\\\ \\item e % note\n\n\n\nf"
    assert one(spark, text.latex_text(F.col("t")), source) == "A b c d\\\\ e \n\nf"


def test_pdf(spark, tmp_path):
    stream = b"BT /F1 12 Tf (Hello \\(you\\)) Tj T* [(wor) -20 (ld) -400 (<end>)] TJ <4f4b> ' ET"
    packed = zlib.compress(stream)
    data = b"%PDF-1.4\n1 0 obj\n<< /Length 3 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n2 0 obj\n<< /Length 9 >>\nstream\nBT (Two) Tj ET\nendstream\nendobj\n"
    assert pdf.pdf_text(data) == "Hello (you)\nworld <end>\nOK\n\nTwo"
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "b.pdf").write_bytes(b"none")
    got = {r["file_name"]: (r["text"], r["error"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.pdf"][0].startswith("Hello") and got["b.pdf"][1].startswith("unreadable")


def test_manifests_are_cut_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_ROWS", 2)
    for n in "ab":
        (tmp_path / f"{n}.csv").write_text("\nname,text\n" + "".join(f"{n}{k},t {k}\n" for k in range(4)))
    assert sorted(r["file_name"] for r in files.csv_manifest(spark, str(tmp_path / "*.csv")).collect()) == ["a0", "a1", "b0", "b1"]


def test_outside_answers(spark):
    long = " ".join(f"w{i}" for i in range(40))
    index = '{"results":[{"id":"i1","title":" T ","abstract_inverted_index":{%s}},{"title":"short","abstract_inverted_index":{"a":[2]}}]}' % ",".join(f'"w{i}":[{i}]' for i in range(40))
    bodies = spark.createDataFrame([("q", index), ("r", None), ("s", "not json")], "query string, body string")
    got = live.works(bodies).collect()
    assert [(r["title"], r["url"], r["content"]) for r in got] == [("T", "i1", f"T. {long}")]
    assert one(spark, live.inverted_text(F.from_json("t", "map<string, array<int>>")), '{"b":[3],"a":[0,4]}') == "a   b a"
    assert one(spark, live.inverted_text(F.from_json("t", "map<string, array<int>>")), "{}") == ""
    entry = live.registry(spark.createDataFrame([("q", '{"message":{"items":[{"DOI":"1/2","title":["E"],"abstract":"<p>%s</p>"}]}}' % long)], "query string, body string"))
    page = live.summaries(spark.createDataFrame([("q", '{"title":"E","extract":"%s","content_urls":{"desktop":{"page":"https://doi.org/1/2"}}}' % long)], "query string, body string"))
    docs = live.live_corpus(live.works(bodies), entry, page).collect()
    assert sorted(r["title"] for r in docs) == ["E", "T"]
    assert live.live_corpus(live.works(bodies), entry, most=1).count() == 1
    answers = live.fetched(spark.createDataFrame([("a",), ("b",), ("a",)], "q string"), "q", lambda q: "x" if q == "a" else 1 / 0)
    assert {tuple(r) for r in answers.collect()} == {("a", "x"), ("b", None)}


@pytest.mark.parametrize("body, want", [('{"documents":[{"completely_generated_prob":0.123456}]}', (0.1235, "nested")), ('{"score":7}', (1.0, "external")), ('{"probability":0.5,"label":"x"}', (0.5, "x")), ("{}", None), ("", None)])
def test_external_score(spark, body, want):
    got = one(spark, live.external_score(F.col("t")), body)
    assert (tuple(got) if got else None) == want


def test_percent(spark):
    for x, digits, want in ((0.125, 1, "12.5"), (0.0004, 1, "0.0"), (1.0, 2, "100.00"), (0.0705, 2, "7.05")):
        assert spark.range(1).select(reports.percent(F.lit(x), digits).alias("p")).first()["p"] == want


def test_signatures(spark):
    rows = spark.createDataFrame([("1", "b"), ("2", None)], "stamp string, body string")
    got = {r["stamp"]: r["signature"] for r in reports.signed_payloads(rows, "k").collect()}
    assert got == {"1": hmac.new(b"k", b"1.b", hashlib.sha256).hexdigest(), "2": None}


def test_records(spark):
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    seed = spark.createDataFrame([("s", 9)], "v string, k long")
    assert [tuple(r) for r in store.seeded(rows, seed).collect()] == [(1, "a")]
    assert [tuple(r) for r in store.seeded(rows.limit(0), seed).collect()] == [(9, "s")]
    assert [r["k"] for r in store.retained(spark.range(9).withColumnRenamed("id", "k"), "k", 2).orderBy("k").collect()] == [7, 8]
    assert one(spark, store.client_ip(F.col("t")), " 1.2.3.4 , 5.6.7.8") == "1.2.3.4" and one(spark, store.client_ip(F.col("t")), None) == "unknown"
    assert one(spark, files.attribute(F.col("t"), "w:lang", "w:val"), '<w:lang w:eastAsia="x" w:val="de"/>') == "de"
    weights = spark.createDataFrame([("a", "g", "x", 1.0), ("b", "g", "x", 0.5), ("c", "g", "x", 0.5), ("d", "h", "x", 1.0)], "key string, group string, term string, weight double")
    assert {tuple(r) for r in similarity.best_match(weights).collect()} == {("a", "b", 0.5), ("b", "a", 0.5), ("c", "a", 0.5)}


def test_a_missing_package_removes_only_its_queries(monkeypatch):
    def broken(name):
        raise ImportError(name)

    monkeypatch.setattr(__spark_entry__, "import_module", broken)
    assert not any(k.startswith("p1_") for k in __spark_entry__.queries()) and "sentence_sources" in __spark_entry__.oracle_sql()
