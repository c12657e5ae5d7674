"""Look-alikes, sentences, leaks, reading levels and packing: cases with known answers, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import leakage, lookalike, packing, reading, sentences

LONG = "word " * 40_000


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_looks(rows):
    data = [("a", "The cat sleeps."), ("b", "The саt sleeps."), ("c", "The ｃａｔ sle​eps."), ("d", "the cat sleeps."), ("e", "Thé cat sleeps."), ("f", "The cat sleeps."), ("f", "The cat sleeps."), ("g", None), ("h", ""), (None, "The cat sleeps.")]
    got = pairs(lookalike.same_look_pairs(rows(data, "k string, t string"), "k", "t"))
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "f"), ("c", "f")}


def test_looks_by_composition_and_joiners(rows):
    data = [("a", "café ﬁn"), ("b", "café fin"), ("c", "cafe fin"), ("d", "\U0001f469‍\U0001f4bb x"), ("e", "\U0001f469\U0001f4bb x"), ("f", "æther"), ("g", "aether"), ("h", "m²"), ("i", "m2"), ("j", "می‌خ"), ("k", "میخ"), ("l", "½"), ("m", "1/2")]
    assert pairs(lookalike.same_look_pairs(rows(data, "k string, t string"), "k", "t")) == {("a", "b")}


def test_unify_takes_the_plain_member(rows):
    got = lookalike.unify(rows([("a", "саt"), ("b", "cat"), ("c", "ｃat"), ("d", None)], "k string, t string"), "t")
    assert {(r["k"], r["plain"]) for r in got.collect()} == {("a", "cat"), ("b", "cat"), ("c", "cat"), ("d", None)}


def test_lookup_of_names(rows):
    names = rows([("n1", "homoglyphs"), ("n2", None)], "nk string, name string")
    flags = rows([("a", "hоmoglyphs"), ("b", "homoglyphs"), ("c", "homoglyphs "), ("d", "Homoglyphs"), ("e", "homoglyph"), ("f", None)], "k string, t string")
    assert pairs(lookalike.same_look_lookup(flags, "k", "t", names, "nk", "name")) == {("a", "n1"), ("c", "n1")}


def test_python_and_column_looks_agree(spark):
    for t in ("Тhe ｃat sat.", "при​вет мир", "plain"):
        got = spark.createDataFrame([(t,)], "t string").select(lookalike.look(F.col("t")).alias("x")).first()["x"]
        assert [w.lower() for w in got.split()] == lookalike.plain_words(t)


KNOWN = {"en": {"dr", "fig", "no", "e.g", "al", "pp"}, "de": {"bzw", "nr", "z", "dr"}}


def cut(text, lang=None):
    return [text[a:b] for a, b in sentences.split(text, KNOWN, lang)]


@pytest.mark.parametrize(
    "parts",
    [
        ["One cat sat.", "Two dogs ran!", "Why?"],
        ["Dr. Lee saw Fig. 3 at 4.5 mg, e.g. in No. 12, as A. B. Cole et al. (1998) say.", "The end."],
        ['"Is it ready?" asked Tom, who ran.', "The cat sat."],
        ['The note reads: "Stop. Go home."', "This is next."],
        ["This is a case... or so they say.", "pH 5.9 holds.", "1925 was a year."],
        ["The box fell (really!) and the fox ran.", "The end came at 8.30 p.m.", "Then all slept."],
        ["See www.a.example/b2.html for more.", "It is v4.5.1.", "The rest is here."],
    ],
)
def test_english(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("\n".join(parts)) == parts


@pytest.mark.parametrize(
    "parts, glue",
    [
        (["Das ist Nr. 4 bzw. Haus, z. B. außer.", "Dr. Ort sagt: „Halt. Nicht so.“", "Immer noch."], " "),
        (["« Est-ce possible ? » demande Paul.", "La vie est belle."], " "),
        (["Πού είναι η πόλη;", "Το βιβλίο μένει."], " "),
        (["石坊已经工人。", "农民说：“不要走。青湾记录！”", "老师白林？"], ""),
        (["“石庄说明？”校长问，比较测量。", "书信石原。"], ""),
        (["「本当ですか？」と聞いて、時間は。", "海川は（窓。）と記した。"], ""),
        (["«Где ключ?» — спросил А. И. Морев, и ушёл.", "Он был прав."], " "),
        (["घर था।", "मान 35.19 है और पुल?"], " "),
        (["ดอนขาวทุ่งแดง 61.74 ประเทศนา", "เลือกเรารักษา"], " "),
    ],
)
def test_other_languages(parts, glue):
    assert cut(glue.join(parts)) == parts


def test_heading_and_edges(rows):
    assert cut("A heading\n\nThe text.\n \t\nMore here") == ["A heading", "The text.", "More here"]
    data = [("a", "One is. Two is."), ("a", "One is. Two is."), ("b", "Only one."), ("c", ""), ("d", "  "), ("e", None), ("f", LONG)]
    got = pairs(sentences.sentences(rows(data, "k string, t string"), "k", "t"))
    assert got == {("a", 0, 7), ("a", 8, 15), ("b", 0, 9), ("f", 0, len(LONG) - 1)}
    assert pairs(sentences.sentences(rows(data, "k string, t string"), "k", "t", least=2)) == {("a", 0, 7), ("a", 8, 15)}
    assert sentences.sentences(rows([], "k string, t string"), "k", "t").count() == 0


def test_learned_abbreviations(spark):
    rng = random.Random(1)
    nouns = "cat dog fox hen cow box sun hat cup jam".split()
    texts = []
    for i in range(300):
        parts = [f"The {rng.choice(nouns)} saw Dr. {rng.choice(['Lee', 'Cole', 'Ames', 'Voss'])} near the {rng.choice(nouns)}.", f"This {rng.choice(nouns)} ran with a {rng.choice(nouns)}, etc.", f"The {rng.choice(nouns)} sat by Fig. {i} of a {rng.choice(nouns)}."]
        texts.append((" ".join(rng.sample(parts * 2, 6)),))
    got = {r["abbreviation"] for r in sentences.learn(spark.createDataFrame(texts, "text string")).collect()}
    assert {"dr", "fig"} <= got and not got & {"etc", *nouns}


def test_learned_collocations(spark):
    rng = random.Random(2)
    months, starts = ["Mai", "Oktober", "Juni"], "Der Die Das Ein Hans Otto Paris Heute".split()
    texts = []
    for i in range(400):
        body = [f"Am {rng.randint(1, 28)}. {rng.choice(months)} kam er", f"Das war {rng.randint(10, 99)}", "Es war gut", "Das Haus ist alt"]
        texts.append((" ".join(f"{rng.choice(starts)} und {b}." for b in rng.choices(body, k=6)),))
    got = {(r["abbreviation"], r["next"]) for r in sentences.learn(spark.createDataFrame(texts, "text string")).collect() if r["next"]}
    assert {n for _, n in got} == set(months)
    known = {"de": {f"{a}\0{n}" for a, n in got}}
    assert sentences.split("Am 3. Oktober kam er. Das war 42. Der Hund ist da.", known, "de") == [(0, 21), (22, 33), (34, 50)]


def test_leaks_against_brute_force(rows):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(20, "too short"), (21, None)]
    items.append((22, items[3][1]))
    docs = []
    for k in range(60):
        body = rng.choices(words, k=80)
        if k % 3 == 0:
            n = rng.choice([11, 12, 20])
            body[10:10] = items[k % 20][1].split()[4 : 4 + n]
        docs.append((k, "  ".join(w.upper() + ("," if rng.random() < 0.1 else "") for w in body)))
    docs += [(98, None), (99, ""), (100, LONG)]
    want = set()
    for k, t in docs:
        w = leakage.normalise(t or "").split()
        runs = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, p in items:
            v = leakage.normalise(p or "").split()
            if any(tuple(v[j : j + 12]) in runs for j in range(len(v) - 11)):
                want.add((k, i))
    table, told = rows(docs, "page long, t string"), rows(items, "item long, p string")
    got = leakage.leaks(table, "page", "t", told, "item", ["p"]).collect()
    assert {(r["page"], r["item"]) for r in got} == want and want
    with pytest.raises(ValueError):
        leakage.leaks(table, "page", "t", told, "item", ["p"], max_chars=5)
    by = dict(docs)
    for r in got:
        assert len(by[r["page"]][r["start_pos"] : r["end_pos"]].split()) >= 12


def test_answers_count_after_a_leaked_run(rows):
    run = " ".join(f"w{i}" for i in range(14))
    long = " ".join(f"a{i}" for i in range(12))
    items = rows([(1, run, "Yes!"), (2, run + " more", long), (3, "else " + run, None)], "item long, p string, a string")
    pages = rows([(1, f"x {run}. Then yes, no."), (2, f"yes {run} {'z ' * 13} yes"), (3, f"{long}"), (4, "yes")], "page long, t string")
    got = {(r["page"], r["item"]): (r["n_words"], r["answer_start"], r["answer_end"]) for r in leakage.leaks(pages, "page", "t", items, "item", ["p"], answer="a").collect()}
    at = f"x {run}. Then yes".index("yes")
    assert got == {(1, 1): (14, at, at + 4), (1, 2): (14, None, None), (1, 3): (14, None, None), (2, 1): (14, None, None), (2, 2): (14, None, None), (2, 3): (14, None, None), (3, 2): (12, None, None)}


def test_scan_follows_each_word_of_a_run_once():
    import time

    book = leakage.Book([(1, "same " * 3000)], [], 12)
    began = time.time()
    assert book.scan("same " * 3000)[1][0] == 3000
    assert time.time() - began < 30


def test_isotonic():
    x, y = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [1, 2.5, 2.5, 4]


def test_levels_held_out(rows):
    rng = random.Random(3)

    def page(level):
        return " ".join("The " + " ".join("".join(rng.choices("abcdefgh"[: 3 + level], k=2 + level)) for _ in range(3 + 2 * level)) + "." for _ in range(12))

    docs = [(i, page(1 + i % 5)) for i in range(250)] + [(900, None), (901, "")]
    labels = [(i, 1 + i % 5 if i < 150 else None) for i in range(250)] + [(900, None), (777, None)]
    got = {r["key"]: r["level"] for r in reading.estimate(rows(docs, "d long, t string"), "d", "t", rows(labels, "d long, level int"), "d", "level").collect()}
    assert set(got) == {*range(150, 250), 900, 777} and got[900] == 1
    assert sum(got[i] == 1 + i % 5 for i in range(150, 250)) >= 85
    none = reading.estimate(rows(docs[:3], "d long, t string"), "d", "t", rows([(1, None)], "d long, level int"), "d", "level").collect()
    assert [r["level"] for r in none] == [3]


def test_packing(rows):
    rng = random.Random(4)
    sizes = [rng.randint(1, 700) for _ in range(3000)] + [0, 512, 513, 5000]
    items = rows([(i, s) for i, s in enumerate(sizes)], "d long, n long")
    got = packing.pack(items, "d", "n", rows([(1, 512), (2, 0), (3, None)], "t int, c int"), "t", "c", block=1000).collect()
    by, held = {}, {}
    for r in got:
        assert r["target"] == 1
        held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
        by.setdefault(r["key"], []).append((r["piece"], r["first_token"], r["tokens"]))
    assert max(held.values()) <= 512 and sum(held.values()) == sum(sizes)
    for i, s in enumerate(sizes):
        parts = sorted(by[i])
        assert sum(p[2] for p in parts) == s and len(parts) == max(1, -(-s // 512))
        assert [p[1] for p in parts] == [512 * p[0] for p in parts]
    assert sum(held.values()) / (512 * len(held)) > 0.97


def test_pair_exchange():
    assert sorted(map(sorted, packing.best_two_fit(np.array([6, 3, 4, 3]), 10))) in ([[3, 3], [4, 6]], [[3], [3, 4, 3]], [[3, 3, 4], [6]])


def test_token_sizes(rows):
    got = {r["key"]: r["tokens"] for r in packing.token_sizes(rows([(1, "Hello world"), (2, None), (3, ""), (4, LONG)], "d long, t string"), "d", "t").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 40_000
