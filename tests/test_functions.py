"""Golden values worked out by hand from the definitions, and properties of the set functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import cleaning, prints, rewrite, stylometry, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'array<string>'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_sentences_tokens_paragraphs(spark):
    assert one(spark, text.sentences(F.col("t")), t=" One  two. Three! 4.5 is\nfour? ") == ["One two.", "Three!", "4.5 is four?"]
    assert one(spark, text.sentences(F.col("t")), t="") == []
    assert one(spark, text.sentences(F.col("t")), t=None) is None
    assert one(spark, text.tokens(F.col("t")), t="A naïve Fox-trot, x 42!") == ["na", "ve", "fox", "trot", "42"]
    assert one(spark, text.paragraphs(F.col("t")), t="x" * 40 + "\n\n" + "y" * 41 + "\n\n\n z ") == ["y" * 41]


@pytest.mark.parametrize("t, lang", [("der Hund", "de"), ("la maison", "fr"), ("el perro y", "es"), ("a dog", "en"), ("éle le monde entier", "fr"), ("привет мир", "multilingual")])
def test_language(spark, t, lang):
    assert one(spark, text.language(F.col("t")), t=t) == lang


def test_rewrites(spark):
    assert one(spark, text.readable(F.col("t")), t="moreover we utilize it in order to win") == "Also we use it to win"
    assert one(spark, text.safe_name(F.col("t")), t="a/b/ü x.txt") == "__x.txt"
    assert one(spark, text.strip_tags(F.col("t")), t="<p>a</p>\n<b>c</b>") == "a c"
    assert one(spark, text.latex_text(F.col("t")), t="\\section{Hi} % no\n$x^2$ \\begin{figure}z\\end{figure} \\emph{yes} {ok}") == "Hi \n yes ok"
    assert one(spark, F.array_join(rewrite.code_tokens(F.col("t")), " "), t='x = foo ( "s" , 12 ) # c\nreturn y') == "ID = ID ( ID , ID ) return ID"


def test_obfuscation(spark):
    assert one(spark, F.size(cleaning.obfuscation(F.col("t"))), t="plain") == 0
    flags = one(spark, cleaning.obfuscation(F.col("t")), t="а​а ааа")
    assert [(f["type"], f["severity"]) for f in flags] == [("invisible_chars", "HIGH"), ("unusual_whitespace", "MEDIUM"), ("homoglyphs", "MEDIUM")]
    assert one(spark, cleaning.obfuscation(F.col("t")), t="аааааа")[0]["severity"] == "HIGH"
    assert one(spark, cleaning.deobfuscated(F.col("t")), t="ﬁｘ​ а") == "fix a"


@pytest.mark.parametrize("t, cited", [("See [1].", True), ("As said (Smith, 2020, p. 4).", True), ("(Smith 42)", True), ("[12] Something that is long enough to be one.", True), ("x doi: 10.1234/abc y", True), ("", False), ("Plain words.", False), ("A long sentence that is no citation but mentions one in it, namely [1].", False)])
def test_citations(spark, t, cited):
    assert one(spark, cleaning.is_citation(F.col("t")), t=t) is cited


def test_citation_strip(spark):
    assert one(spark, cleaning.without_citations(F.col("t")), t="A (Smith, 2020) b [1] c https://a.b/c d https://e.f") == "A b c d https://e.f"


def test_hash_and_winnowing(spark):
    assert one(spark, prints.poly_hash(F.col("t")), t="hello") == 1335831723
    assert one(spark, prints.kgrams(F.col("t"), 5), t=["a"] * 4) == []
    assert len(one(spark, prints.fingerprint(F.col("t")), t=list("abcdefgh"))) >= 1


words = st.lists(st.sampled_from(["aa", "bb", "cc", "dd", "ee", "ff"]), max_size=14)


@settings(max_examples=12, deadline=None)
@given(words, words)
def test_set_properties(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    fa, fb = prints.fingerprint(F.col("a")), prints.fingerprint(F.col("b"))
    r = df.select(prints.containment(fa, fb).alias("c"), prints.containment(fa, fa).alias("self"), prints.jaccard(F.col("a"), F.col("b")).alias("j"), prints.jaccard(F.col("b"), F.col("a")).alias("k")).first()
    assert 0 <= r["c"] <= 1 and r["j"] == r["k"]
    assert r["self"] == (1.0 if len(a) >= 5 else 0.0)


def test_winnowing_guarantee(spark):
    """A shared run of 8 tokens means a shared fingerprint."""
    run = [f"w{i}" for i in range(8)]
    df = spark.createDataFrame([(["x1", "x2", *run, "x3"], [*run, "y1", "y2"])], "a array<string>, b array<string>")
    assert df.select(F.size(F.array_intersect(prints.fingerprint(F.col("a")), prints.fingerprint(F.col("b")))).alias("n")).first()["n"] > 0


def test_stylometry(spark):
    p = one(spark, stylometry.surprisal(F.col("t")), t=["of", "the"])
    assert p == pytest.approx((-math.log(0.7 * 0.029) - math.log(0.7 * 0.053 + 0.3 * 0.030)) / 2)
    assert one(spark, stylometry.surprisal(F.col("t")), t=[]) is None
    assert one(spark, stylometry.repeated_trigrams(F.col("t")), t=["a", "b", "c", "a", "b", "c"]) == pytest.approx(1 / 3)
    assert one(spark, stylometry.letter_entropy(F.col("t")), t="ab" * 10) == pytest.approx(1.0)
    assert [one(spark, stylometry.calibrated(F.col("v")), v=v) for v in (0.0, 0.2, 0.4, 0.8, 1.0)] == pytest.approx([0, 0.08, 0.22, 0.73, 1])
    assert tuple(one(spark, stylometry.sentence_score(F.col("t"), text.tokens(F.col("t"))), t="Too short it")) == (0.4, 0.2, 0.6)
