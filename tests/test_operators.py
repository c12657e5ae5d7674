"""Operators against brute force on small tables."""

import io
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmesh import queries
from quillmesh.plans import listings, reports  # noqa: F401  (they add to the catalogue)
from quillmesh.operators import similarity, store
from quillmesh.sources import files
from quillmesh.streaming.limiter import admit, limited, limited_stream
from quillmesh.tables import scratch_dir, written


def test_target_among_noise(spark):
    target = "The quick brown fox jumps over the lazy dog while the patient farmer counts seventeen golden sheep."
    docs = [(f"noise-{i:03d}", "global", f"Noise document number {i} talks about nothing in particular.") for i in range(250)] + [("target", "global", target)]
    docs = spark.createDataFrame(docs, "id string, org_id string, content string")
    asked = spark.createDataFrame([("org-1", target), ("org-1", "zz"), ("org-1", None)], "org_id string, text string")
    found = similarity.sentence_sources(asked, docs).orderBy("rank").collect()
    assert found[0]["doc_id"] == "target" and found[0]["score"] > 0.7 and found[0]["method"] == "exact"
    assert {r["text"] for r in found} == {target} and len(found) <= 5


def test_sources_stay_within_an_organisation(spark):
    s = "Seven silver spoons shine softly beside the southern sea tonight."
    docs = spark.createDataFrame([("a", "org-1", s), ("b", "org-2", s), ("c", "global", s)], "id string, org_id string, content string")
    found = similarity.sentence_sources(spark.createDataFrame([("org-1", s)], "org_id string, text string"), docs)
    assert {r["doc_id"] for r in found.collect()} == {"a", "c"}


def plain_scores(asked, docs):
    """The three pair scores straight from their definitions: {(org, text, doc): best score}."""
    import math
    import re

    tok = lambda t: [w for w in re.sub("[^a-z0-9]+", " ", t.lower()).split() if len(w) > 1]
    cut = lambda t: [x.strip() for x in re.split(r"(?<=[.!?]) ", re.sub(r"\s+", " ", t).strip()) if x.strip()]

    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 4294967295
        return h

    def prints(t):
        h = [fnv("\0".join(t[i : i + 5])) for i in range(len(t) - 4)]
        return {min(h[i : i + 4]) for i in range(len(h) - 3)} if len(h) >= 4 else set(h)

    def grams(t, k):
        n = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9_\s]", "", t.lower())).strip()
        return {n[i : i + k] for i in range(len(n) - k + 1)}

    inside = lambda a, b: len(a & b) / len(a) if a else 0.0
    out = {}
    for org, q in asked:
        seen = [(d, s) for d, o, t in docs if o in ("global", org) for s in cut(t)]
        df = {}
        for _, s in seen:
            for w in set(tok(s)):
                df[w] = df.get(w, 0) + 1

        def vector(t, df=df, n=len(seen)):
            c = [w for w in t if w not in similarity.STOP_WORDS]
            return {w: c.count(w) / len(c) * (math.log((n + 1) / (df[w] + 1)) + 1 if w in df else math.log(2) + 1) for w in c}

        t = tok(q)
        if len(t) < 3:
            continue
        v = vector(t)
        for d, s in seen:
            u = vector(tok(s))
            norm = math.sqrt(sum(x * x for x in v.values())) * math.sqrt(sum(x * x for x in u.values()))
            cosine = sum(x * u.get(w, 0) for w, x in v.items()) / norm if norm else 0.0
            exact = inside(prints(t), prints(tok(s))) if len(t) >= 6 else 0.0
            shingle = sum(a * inside(grams(q, k), grams(s, k)) for a, k in ((0.25, 4), (0.45, 6), (0.30, 9)))
            out[org, q, d] = max(out.get((org, q, d), 0), exact, cosine, shingle)
    return {k: v for k, v in out.items() if v > 0.12}


def test_sources_against_the_definitions(spark):
    import random

    rng = random.Random(11)
    words = "the fox hill road stone bright river garden machine letter window study of and slowly under seven".split()
    say = lambda: " ".join(rng.choices(words, k=rng.randint(4, 12))).capitalize() + "."
    docs = [(f"d{i}", rng.choice(["global", "o1", "o2"]), " ".join(say() for _ in range(3))) for i in range(12)]
    asked = [(o, say()) for o in ("o1", "o2", "o3") for _ in range(4)] + [("o1", docs[0][2].split(". ")[0] + "."), ("o2", docs[1][2].split(". ")[0] + ".")]
    found = similarity.sentence_sources(spark.createDataFrame(asked, "org_id string, text string"), spark.createDataFrame(docs, "id string, org_id string, content string"), sources=100)
    got = {(r["org_id"], r["text"], r["doc_id"]): r["score"] for r in found.collect()}
    want = plain_scores(dict.fromkeys(asked), docs)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_candidates_without_shared_tokens(spark):
    corpus = spark.createDataFrame([(f"d{i:03d}", "global", 0, "alpha beta gamma") for i in range(130)], "doc_id string, org_id string, sent_idx int, sentence string")
    asked = spark.createDataFrame([(1, "org-1", ["zeta", "eta", "theta"]), (2, "org-1", ["beta", "alpha", "xx"])], "qid long, org_id string, tokens array<string>")
    got = similarity.candidates(asked, corpus).groupBy("qid").agg(F.count("*").alias("n"), F.max("shared").alias("s")).orderBy("qid").collect()
    assert [(r["n"], r["s"]) for r in got] == [(120, 0), (120, 2)]


def test_document_scores(spark):
    rows = spark.createDataFrame([("all", 1.0, 5)] * 4 + [("none", 0.0, 5)] * 4 + [("empty", 0.5, 0)], "key string, score double, n_tokens int")
    assert {r["key"]: r["similarity"] for r in similarity.document_scores(rows).collect()} == {"all": 1.0, "none": 0.0, "empty": 0.0}
    capped = spark.createDataFrame([("k", 0.99, 5)] * 9 + [("k", 0.0, 1)] * 8, "key string, score double, n_tokens int")
    assert similarity.document_scores(capped, aggressive=True).first()["similarity"] <= 0.94


def test_store(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, seq long, v string")
    assert {(r["k"], r["v"]) for r in store.latest(log, "k", F.col("seq")).collect()} == {("a", "y"), ("b", None)}
    patch = spark.createDataFrame([("b", "z"), ("c", "n")], "k string, v string")
    got = {(r["k"], r["v"]) for r in store.patched(log.where("seq > 1").select("k", "v"), patch, "k").collect()}
    assert got == {("a", "y"), ("b", "z"), ("c", "n")}
    assert [r["k"] for r in store.inserted(log, patch.unionByName(patch), "k").collect()] == ["c"]
    assert store.without(log, patch, "k").count() == 2


def test_chains(spark):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("s", "s"), ("p", "q"), ("q", "p"), (None, "a")], "c string, p string")
    got = {r["id"]: (r["root"], r["depth"]) for r in store.chains(links, "c", "p").collect()}
    assert got["d"] == ("a", 3) and got["a"] == ("a", 0) and got["x"] == ("y", 1) and got["s"] == ("s", 0)
    assert {"p", "q"} <= set(got)


def test_written_is_in_the_shared_folder(spark):
    df = written(spark.range(5), "t")
    assert df.count() == 5 and all(scratch_dir(spark) in f for f in df.inputFiles())


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello there.")
    (tmp_path / "b.tex").write_text("\\section{Hi} % x")
    (tmp_path / "empty.md").write_text("  ")
    slides = {"ppt/slides/slide10.xml": "<a:t>ten &amp; more</a:t>", "ppt/slides/slide2.xml": "<a:t>two</a:t><a:t> </a:t>", "ppt/slides/slide3.xml": "<x/>"}
    (tmp_path / "c.pptx").write_bytes(_zip(slides))
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    got = {r["file_name"]: (r["text"], r["error"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("Hello there.", None) and got["b.tex"][0] == "Hi" and got["empty.md"][1] == "empty"
    assert got["c.pptx"][0] == "two\n\nten & more" and got["d.docx"][1].startswith("unreadable")


def test_docx_meta(spark, tmp_path):
    core = "<dc:creator>A</dc:creator><cp:lastModifiedBy>B</cp:lastModifiedBy><cp:revision>2</cp:revision>"
    app = "<TotalTime>2</TotalTime><Words>501</Words><Application>LibreOffice</Application>"
    body = "".join(f'<w:rFonts w:ascii="F{i}"/>' for i in range(7)) + "<w:ins >" * 21
    (tmp_path / "x.docx").write_bytes(_zip({"docProps/core.xml": core, "docProps/app.xml": app, "word/document.xml": body, "word/styles.xml": "<w:style " * 51}))
    row = files.docx_meta(spark, str(tmp_path)).first()
    assert [f["code"] for f in row["flags"]] == ["FAST_CREATION", "LOW_REVISIONS", "FONT_DIVERSITY", "MULTIPLE_AUTHORS", "APP_MISMATCH", "TRACKED_CHANGES", "STYLE_COUNT"]


def test_manifests_and_sniffing(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name,text\n\na.txt, one, two \nno comma\n,missing\n")
    assert [tuple(r) for r in files.csv_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("a.txt", "one, two")]
    (tmp_path / "b.json").write_text('{"documents": [{"filename": "a", "text": "t"}, {"filename": "b"}]}')
    assert [tuple(r) for r in files.json_bulk(spark, str(tmp_path / "b.json")).collect()] == [("a", "t")]
    heads = spark.createDataFrame([(b"%PDF-1.7",), (b"PK\x03\x04zz",), (b"plain\ntext",), (b"\xff\xfe",)], "c binary")
    assert [r["s"] for r in heads.select(files.sniffed(F.col("c")).alias("s")).collect()] == ["pdf", "zip", "plain", None]


def test_limiter(spark, tmp_path):
    assert admit([0, 10, 59, 60, 61], None, 0, 2, 60)[0] == [True, True, False, False, True]
    rows = [("u", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 3))] + [(None, 9, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "who string, n long, at string").withColumn("at", F.to_timestamp("at"))
    assert [r["allowed"] for r in limited(df, "who", "at", "n", 2).orderBy("n").collect()] == [True, True, False, False]
    df.where("who is not null").write.parquet(str(tmp_path / "in"))
    stream = limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "who", "at", 2)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["allowed"] for r in spark.table("limited").collect()) == [False, False, True, True]


def test_stream_scoring(spark, tmp_path):
    from quillmesh.streaming.scoring import score_stream

    s = "Seven silver spoons shine softly beside the southern sea tonight."
    spark.createDataFrame([("org-1", s)], "org_id string, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.createDataFrame([("c", "global", s)], "id string, org_id string, content string")
    stream = spark.readStream.schema("org_id string, text string").parquet(str(tmp_path / "in"))
    score_stream(stream, docs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "out")).first()["doc_id"] == "c"


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, abs=1e-12))


@pytest.mark.parametrize("name", ["split_sentences", "language_infer", "winnow_fingerprints", "tfidf_vectors", "stored_similarity", "document_ai", "scan_history", "rate_limit", "org_stats", "report_lines", "file_versions", "live_corpus"])
def test_against_sql(spark, name):
    """A few of the catalogue's queries with their SQL, on the smallest tables; the driver compares them all."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    import glob
    import os

    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    at = [[c[0] for c in result.description].index(c) for c in cols]
    want = sorted(tuple(r[i] for i in at) for r in result.fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def _scanned(spark, folder):
    """150 documents that share a token, of which one is another organisation's, and sentences with and without shared tokens."""
    docs = [(f"d{i:03d}", "org-2" if i == 7 else "global", f"Alpha word{i} beta{i % 5}. Gamma delta{i} epsilon.") for i in range(150)]
    asked = [("org-1", "Alpha beta3 gamma delta9 here"), ("org-1", "Nothing meets anything whatsoever")]
    spark.createDataFrame(docs, "id string, org_id string, content string").write.parquet(f"{folder}/corpus_docs.parquet")
    spark.createDataFrame(asked, "org_id string, text string").write.parquet(f"{folder}/sentences.parquet")
    return docs, asked


def test_all_candidates_and_their_pairs(spark, tmp_path):
    docs, asked = _scanned(spark, tmp_path)
    words = lambda t: [w for w in re.sub("[^a-z0-9]+", " ", t.lower()).split() if len(w) > 1]
    want, pairs = set(), {}
    for org, t in asked:
        q, met = words(t), []
        seen = [x for x in docs if x[1] in ("global", org)]
        for id_, _, content in seen:
            both = set(q) & set(words(content))
            if both:
                met.append((-len(both), min(map(q.index, both)), id_))
        best = [(-n, id_) for n, _, id_ in sorted(met)[:120]] or [(0, id_) for id_, _, _ in seen[:120]]
        want |= {(t, id_, n, r) for r, (n, id_) in enumerate(best, 1)}
        for _, id_ in best:
            for i, s in enumerate(next(x[2] for x in docs if x[0] == id_).split(". ")):
                pairs[t, id_, i] = round(len(set(q) & set(words(s))) / len(set(q) | set(words(s))), 6)
    got = {(r["text"], r["doc_id"], r["shared"], r["rank"]) for r in queries.QUERIES["candidate_docs"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 240
    scored = queries.QUERIES["candidate_pairs"](spark, str(tmp_path)).collect()
    assert {(r["text"], r["doc_id"], r["sent_idx"]): r["jaccard"] for r in scored} == pytest.approx(pairs, abs=2e-6) and len(scored) == 480


def test_candidates_over_groups_and_blocks(spark, monkeypatch):
    import random

    from quillmesh.operators import candidates

    monkeypatch.setattr(candidates, "GROUP", 7)
    monkeypatch.setattr(candidates, "BLOCK", 5)
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(40)]
    docs = [(f"d{rng.randrange(10**6)}-{i}", rng.choice(["global", "o1", "o2"]), " ".join(rng.choices(words, k=9))) for i in range(90)]
    asked = [(i, rng.choice(["global", "o1", "o2", "o3"]), rng.choices(words, k=6)) for i in range(40)] + [(40, "o1", [*(f"x{i}" for i in range(300)), *words]), (41, "o2", ["none", "of", "these"])]
    got = similarity.candidates(spark.createDataFrame(asked, "qid long, org_id string, tokens array<string>"), spark.createDataFrame([(a, b, 0, c) for a, b, c in docs], "doc_id string, org_id string, sent_idx int, sentence string"), most=12)
    want = set()
    for qid, org, tokens in asked:
        distinct = list(dict.fromkeys(tokens))
        seen = sorted((id_, set(t.split())) for id_, of, t in docs if of in ("global", org))
        met = sorted((-len(both), min(map(distinct.index, both)), id_) for id_, t in seen if (both := t & set(distinct)))
        best = [(-n, id_) for n, _, id_ in met[:12]] or [(0, id_) for id_, _ in seen[:12]]
        want |= {(qid, id_, n, r) for r, (n, id_) in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want
    # Queries and documents meet inside tasks: no join by a term, whose rows would grow with their product.
    assert "term#" not in got._jdf.queryExecution().executedPlan().toString()


def test_sources_and_pairs_over_groups_and_blocks(spark, monkeypatch):
    import random

    from quillmesh.operators import candidates

    monkeypatch.setattr(candidates, "GROUP", 3)
    monkeypatch.setattr(candidates, "BLOCK", 4)
    rng = random.Random(3)
    words = "the fox hill road stone bright river garden machine letter window study of and slowly under seven".split()
    say = lambda: " ".join(rng.choices(words, k=rng.randint(4, 12))).capitalize() + "."
    docs = [(f"d{i}", rng.choice(["global", "o1", "o2"]), " ".join(say() for _ in range(3))) for i in range(25)]
    asked = list(dict.fromkeys((o, say()) for o in ("global", "o1", "o2", "o3") for _ in range(5)))
    both = spark.createDataFrame(asked, "org_id string, text string"), spark.createDataFrame(docs, "id string, org_id string, content string")
    found, pairs = similarity.sentence_sources(*both, sources=100), similarity.pair_scores(*both)
    want = plain_scores(asked, docs)
    assert {(r["org_id"], r["text"], r["doc_id"]): r["score"] for r in found.collect()} == pytest.approx(want, abs=2e-6)
    assert {(r["text"], r["doc_id"], r["sent_idx"]) for r in pairs.collect()} >= {(t, d, i) for _, t, d in want for i in range(3)}
    # Pairs are made inside tasks: no join of queries with documents, whose rows would grow with their product.
    for df in (found, pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "doc_id#" not in "".join(x for x in plan.splitlines() if "Join" in x) and "MapInArrow" in plan


def test_candidate_pairs_are_made_inside_tasks(spark, tmp_path):
    _scanned(spark, tmp_path)
    plan = queries.QUERIES["candidate_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "doc_id#" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_document_similarity_scores_inside_tasks(spark, tmp_path):
    docs, asked = _scanned(spark, tmp_path)
    other = str(tmp_path / "jobs")
    rows = [(f"s{i}", "j", org, i, t) for i, (org, t) in enumerate(asked)]
    spark.createDataFrame(rows, "sent_id string, job_id string, org_id string, sent_idx int, text string").write.parquet(f"{other}/sentences.parquet")
    spark.createDataFrame(docs, "id string, org_id string, content string").write.parquet(f"{other}/corpus_docs.parquet")
    df = queries.QUERIES["document_similarity"](spark, other)
    assert [r["job_id"] for r in df.collect()] == ["j"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "doc_id#" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_long_chains_and_cycles(spark):
    links = [("n000", None)] + [(f"n{i:03d}", f"n{i - 1:03d}") for i in range(1, 201)] + [("p", "q"), ("q", "p"), ("r", "p")]
    got = {r["id"]: (r["root"], r["depth"]) for r in store.chains(spark.createDataFrame(links, "c string, p string"), "c", "p").collect()}
    assert all(got[f"n{i:03d}"] == ("n000", i) for i in range(201))
    assert got["p"] == ("p", 64) and got["q"] == ("q", 64) and got["r"] == ("q", 64) and len(got) == 204


def test_code_sources(spark):
    lines = [f"x{i} = f{i} ( y ) ; if ( a > {i} ) {{ return b ; }} while ( c < d ) {{ e += {i} ; }}" for i in range(6)]
    code = "\n".join(lines)
    renamed = re.sub(r"\b[xyfabcde](?=\d| )", "q", code)
    other = "class A extends B : def import from import try catch throw new : " * 4
    docs = [(f"copy{i}", "global", code) for i in range(6)] + [("renamed", "org-1", renamed), ("hidden", "org-2", code), ("prose", "global", other)]
    asked = [("a", "org-1", code), ("short", "org-1", "x = y ( z ) ;"), ("none", "org-1", None)]
    got = similarity.code_sources(spark.createDataFrame(asked, "key string, org_id string, code string"), spark.createDataFrame(docs, "id string, org_id string, content string")).orderBy("rank").collect()
    assert [(r["key"], r["doc_id"], r["score"], r["rank"]) for r in got] == [("a", f"copy{i}", 1.0, i + 1) for i in range(5)]
    mine = similarity.code_sources(spark.createDataFrame(asked, "key string, org_id string, code string"), spark.createDataFrame(docs[6:], "id string, org_id string, content string"))
    assert [(r["doc_id"], r["score"]) for r in mine.collect()] == [("renamed", 1.0)]
