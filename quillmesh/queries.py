"""Catalogue of the core queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import cleaning, prints, rewrite, stylometry, text
from quillmesh.operators import similarity, store
from quillmesh.operators.candidates import candidate_lists
from quillmesh.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL of the same rows if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL pieces -------------------------------------------------------------------------------

WS = text.SPACE_SET


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def d_trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def d_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({d_collapsed(x)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def d_tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1)"


def d_hash(x: str) -> str:
    return f"list_reduce(list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT), lambda a, b: (xor(a, b) * 16777619) & 4294967295, 2166136261::BIGINT)"


def d_kgrams(t: str) -> str:
    return f"list_transform(range(1, len({t}) - 3), lambda i: {d_hash(f'array_to_string({t}[i:i+4], chr(0))')})"


def d_winnowed(h: str) -> str:
    return f"list_distinct(CASE WHEN len({h}) >= 4 THEN list_transform(range(1, len({h}) - 2), lambda i: list_min({h}[i:i+3])) ELSE {h} END)"


def d_normal(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_{WS}]', '', 'g'), '[{WS}]+', ' ', 'g'))"


def d_shingles(x: str, k: int) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {k - 2}), lambda i: {x}[i:i+{k - 1}]))"


def d_contained(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0.0 END"


def d_rounded(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def d_clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


SENTENCES = "s AS (SELECT DISTINCT sent_id, job_id, org_id, sent_idx, text FROM sentences WHERE text IS NOT NULL)"
DOCS = "d AS (SELECT DISTINCT id, content FROM corpus_docs WHERE content IS NOT NULL)"
CORPUS = f"""one AS (SELECT id, min({{'org_id': org_id, 'content': content}}) AS d FROM corpus_docs WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id),
split AS (SELECT id AS doc_id, d.org_id AS org_id, {d_sentences('d.content')} AS l FROM one),
corpus AS (SELECT doc_id, org_id, unnest(range(0, len(l))) AS sent_idx, unnest(l) AS sentence FROM split)"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences").select("sent_id", "job_id", "org_id", "sent_idx", "text").where("text is not null").distinct()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_docs").select("id", "content").where("content is not null").distinct()


def _neighbours(spark: SparkSession, d: str, *cols: Column) -> DataFrame:
    """Each sentence with the next one of its job; cols are computed once for each sentence."""
    s = _sentences(spark, d).where("job_id is not null and sent_idx is not null").select("sent_id", "job_id", "sent_idx", "text", *cols)
    a = s.select(*[F.col(c).alias(f"{c}_a") for c in s.columns], F.col("job_id"), (F.col("sent_idx") + 1).alias("next"))
    b = s.select(*[F.col(c).alias(f"{c}_b") for c in s.columns], F.col("job_id"), F.col("sent_idx").alias("next"))
    return a.join(b, ["job_id", "next"])


NEXT = "s a JOIN s b ON a.job_id = b.job_id AND b.sent_idx = a.sent_idx + 1"

# --- text -------------------------------------------------------------------------------------


@query(f"WITH {DOCS}, l AS (SELECT id, {d_sentences('content')} AS l FROM d) SELECT id, unnest(range(0, len(l)))::INT AS sent_idx, unnest(l) AS sentence FROM l")
def split_sentences(spark, d):
    return _docs(spark, d).select("id", F.posexplode(text.sentences(F.col("content"))).alias("sent_idx", "sentence"))


@query(f"WITH {SENTENCES} SELECT term, count(*) AS n FROM (SELECT unnest({d_tokens('text')}) AS term FROM s) GROUP BY term")
def token_counts(spark, d):
    return _sentences(spark, d).select(F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SENTENCES}, t AS (SELECT sent_id, text, {d_tokens('text')} AS t FROM s)
    SELECT sent_id, len(t)::INT AS n_tokens, {d_rounded("CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 1.0 END", 6)} AS diversity FROM t"""
)
def sentence_stats(spark, d):
    t = F.col("t")
    return _sentences(spark, d).select("sent_id", text.tokens(F.col("text")).alias("t")).select("sent_id", F.size(t).alias("n_tokens"), text.rounded(stylometry.diversity(t), 6).alias("diversity"))


_LANGUAGE = " ".join(f"WHEN regexp_matches(content, '(?i)\\b({'|'.join(w)})\\b') THEN '{name}'" for name, w in text.LANGUAGE_WORDS)


@query(f"WITH {DOCS} SELECT id, CASE WHEN length(regexp_replace(content, '[\\x00-\\x7F]', '', 'g')) / greatest(1, length(content)) > 0.15 THEN 'multilingual' {_LANGUAGE} ELSE 'en' END AS language FROM d")
def language_infer(spark, d):
    return _docs(spark, d).select("id", text.language(F.col("content")).alias("language"))


@query(
    f"""WITH {DOCS}, l AS (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '\\n{{2,}}'), lambda p: {d_trimmed('p')}), lambda p: length(p) > 40) AS l FROM d)
    SELECT id, unnest(range(0, len(l)))::INT AS para_idx, unnest(l) AS paragraph FROM l"""
)
def paragraphs(spark, d):
    return _docs(spark, d).select("id", F.posexplode(text.paragraphs(F.col("content"))).alias("para_idx", "paragraph"))


@query(f"WITH {DOCS} SELECT id, trim(regexp_replace(regexp_replace('<p class=x>' || content || '</p><br/>end', '<[^>]+>', ' ', 'g'), '[{WS}]+', ' ', 'g')) AS plain FROM d")
def strip_html(spark, d):
    return _docs(spark, d).select("id", text.strip_tags(F.concat(F.lit("<p class=x>"), "content", F.lit("</p><br/>end"))).alias("plain"))


def _d_readable(x: str) -> str:
    out = d_trimmed(x)
    for words, plain in text.PLAIN_PHRASES:
        out = f"regexp_replace({out}, '(?i)\\b({words})\\b', '{plain}', 'g')"
    return f"regexp_replace({out}, '[{WS}]{{2,}}', ' ', 'g')"


@query(
    f"""WITH {SENTENCES}, r AS (SELECT sent_id, {_d_readable("'Moreover, in order to know, ' || text")} AS r FROM s),
    c AS (SELECT sent_id, CASE WHEN length(r) > 220 THEN regexp_replace(r, '(?i),[{WS}]+(which|that|because|while|although)[{WS}]+', '. \\1 ', 'g') ELSE r END AS r FROM r)
    SELECT sent_id, CASE WHEN length(r) > 1 THEN upper(r[1:1]) || r[2:] ELSE r END AS readable FROM c"""
)
def readability_rewrite(spark, d):
    return _sentences(spark, d).select("sent_id", text.readable(F.concat(F.lit("Moreover, in order to know, "), "text")).alias("readable"))


# --- cleaning ---------------------------------------------------------------------------------

_FLAGS = f"""list_filter([
    CASE WHEN regexp_matches(text, '{cleaning.INVISIBLE}') THEN 'invisible_chars:HIGH' END, CASE WHEN regexp_matches(text, '{cleaning.UNUSUAL_SPACE}') THEN 'unusual_whitespace:MEDIUM' END,
    CASE WHEN n > 5 THEN 'homoglyphs:HIGH' WHEN n > 0 THEN 'homoglyphs:MEDIUM' END, CASE WHEN regexp_matches(text, '{cleaning.FULL_WIDTH}') THEN 'fullwidth_ascii:MEDIUM' END], lambda f: f IS NOT NULL)"""


@query(f"WITH {SENTENCES}, c AS (SELECT sent_id, text, len(regexp_extract_all(text, '{cleaning.ANY_LOOK_ALIKE}')) AS n FROM s) SELECT sent_id, unnest({_FLAGS}) AS flag FROM c")
def obfuscation_flags(spark, d):
    flags = _sentences(spark, d).select("sent_id", F.inline(cleaning.obfuscation(F.col("text"))))
    return flags.select("sent_id", F.concat_ws(":", "type", "severity").alias("flag"))


def _d_deobfuscated(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '{cleaning.INVISIBLE}', '', 'g'), '{cleaning.UNUSUAL_SPACE}', ' ', 'g')"
    x = f"translate({x}, {q(''.join(cleaning.SINGLE))}, {q(''.join(cleaning.SINGLE.values()))})"
    for of, to in cleaning.LIGATURES.items():
        x = f"replace({x}, '{of}', '{to}')"
    return x


@query(f"WITH {SENTENCES} SELECT sent_id, {_d_deobfuscated('text')} AS plain FROM s")
def homoglyph_normalise(spark, d):
    return _sentences(spark, d).select("sent_id", cleaning.deobfuscated(F.col("text")).alias("plain"))


def _d_citation(x: str) -> str:
    t = d_trimmed(x)
    short = " OR ".join(f"regexp_matches({t}, '{p}')" for p in (cleaning.IEEE, cleaning.APA, cleaning.MLA))
    return f"({t} <> '' AND (regexp_matches({t}, '{cleaning.REFERENCE}') OR regexp_matches({t}, '\\b{cleaning.DOI}') OR (length({t}) < 60 AND ({short}))))"


_CITED = "CASE WHEN ascii(sent_id[-1:]) % 3 = 0 THEN '[12] ' WHEN ascii(sent_id[-1:]) % 3 = 1 THEN 'As (Smith & Jones, 2019, pp. 3-4) and doi:10.1234/ab.c and https://x.test/y say, ' ELSE '' END || text"


def _cited() -> Column:
    mod = F.ascii(F.substring("sent_id", -1, 1)) % 3
    return F.concat(F.when(mod == 0, "[12] ").when(mod == 1, "As (Smith & Jones, 2019, pp. 3-4) and doi:10.1234/ab.c and https://x.test/y say, ").otherwise(""), "text")


@query(f"WITH {SENTENCES}, c AS (SELECT sent_id, text, {_CITED} AS cited FROM s) SELECT sent_id, {_d_citation('text')} AS as_stored, {_d_citation('cited')} AS with_marker FROM c")
def citation_flags(spark, d):
    return _sentences(spark, d).select("sent_id", cleaning.is_citation(F.col("text")).alias("as_stored"), cleaning.is_citation(_cited()).alias("with_marker"))


def _d_without(x: str) -> str:
    for p in (cleaning.APA, cleaning.MLA, cleaning.IEEE):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\b{cleaning.DOI}', ''), '{cleaning.URL}', '')"
    return d_trimmed(f"regexp_replace({x}, '[{WS}]{{2,}}', ' ', 'g')")


@query(f"WITH {SENTENCES}, c AS (SELECT sent_id, {_CITED} AS cited FROM s) SELECT sent_id, {_d_without('cited')} AS prose FROM c")
def strip_citations(spark, d):
    return _sentences(spark, d).select("sent_id", cleaning.without_citations(_cited()).alias("prose"))


@query("SELECT DISTINCT id, regexp_replace(regexp_replace(url, '^.*/', ''), '[^a-zA-Z0-9._-]', '_', 'g') AS name FROM corpus_docs WHERE url IS NOT NULL")
def filename_sanitise(spark, d):
    return table(spark, d, "corpus_docs").where("url is not null").select("id", text.safe_name(F.col("url")).alias("name")).distinct()


# Three programs around each order: comments of all kinds, docstrings, both quotes, escapes, signs of comments in strings.
_SNIPPETS = (
    "'/* o */ function f' || o_orderkey || '(a, b) { // sum' || chr(10) || ' return a + ' || o_custkey || '.5 * b ; } # done'",
    "'def g ( x ) :' || chr(10) || ' \"\"\" two' || chr(10) || ' lines # \"\"\" ' || chr(10) || ' return h ( ''it\\''s // ' || o_orderkey || ''' , \"a # ' || o_custkey || '\" ) '",
    "''''''' doc '''''' const k' || o_custkey || ' = \"\" ; // ' || o_orderkey || chr(10) || 'let z = 1e-3 + 0.25 ; x1y2 ( '' '' )'",
)


def _d_code(x: str) -> str:
    is_a = lambda p: f"regexp_matches(p, {q(f'^(?:{p})$')})"
    keep = ", ".join(q(k) for k in rewrite.KEYWORDS)
    named = f"list_transform(regexp_extract_all({x}, {q(rewrite.PIECE)}), lambda p: CASE WHEN {is_a(rewrite.COMMENT)} THEN ' ' WHEN {is_a(rewrite.STRING)} THEN p[1:1] || 'STR' || p[1:1] WHEN {is_a(rewrite.NUMBER)} THEN 'NUM' ELSE p END)"
    return f"list_transform(list_filter(regexp_split_to_array(array_to_string({named}, ''), '\\s+'), lambda t: t <> ''), lambda t: CASE WHEN t IN ({keep}) OR regexp_matches(t, {q(f'^{rewrite.SIGNS}')}) THEN t ELSE 'ID' END)"


@query(" UNION ALL ".join(f"SELECT o_orderkey, {n} AS kind, array_to_string({_d_code(x)}, ' ') AS code FROM orders" for n, x in enumerate(_SNIPPETS)))
def code_normalise(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    programs = (
        F.concat(F.lit("/* o */ function f"), o, F.lit("(a, b) { // sum\n return a + "), c, F.lit(".5 * b ; } # done")),
        F.concat(F.lit("def g ( x ) :\n \"\"\" two\n lines # \"\"\" \n return h ( 'it\\'s // "), o, F.lit("' , \"a # "), c, F.lit('" ) ')),
        F.concat(F.lit("''' doc ''' const k"), c, F.lit(' = "" ; // '), o, F.lit("\nlet z = 1e-3 + 0.25 ; x1y2 ( ' ' )")),
    )
    every = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.array(*programs)).alias("kind", "code"))
    return every.select("o_orderkey", "kind", F.array_join(rewrite.code_tokens(F.col("code")), " ").alias("code"))


@query()
def code_sources(spark, d):
    """The documents that hold most of each code submission's fingerprint; submissions are told by their file name, their text is what the stored report has."""
    jobs = table(spark, d, "jobs").where("json is not null").select("job_id", "org_id", F.get_json_object("json", "$.file_name").alias("name"), F.get_json_object("json", "$.report.sentences").alias("sentences"))
    codes = jobs.where(text.is_code(F.col("name"))).select(F.col("job_id").alias("key"), "org_id", F.array_join(F.transform(F.from_json("sentences", "array<struct<text: string>>"), lambda s: s["text"]), "\n").alias("code"))
    return similarity.code_sources(codes, table(spark, d, "corpus_docs").select("id", "org_id", "content")).withColumnRenamed("key", "job_id")


# --- fingerprints and sets --------------------------------------------------------------------


@query(f"WITH {SENTENCES}, t AS (SELECT sent_id, {d_tokens('text')} AS t FROM s), h AS (SELECT sent_id, {d_kgrams('t')} AS h FROM t) SELECT sent_id, unnest(range(0, len(h)))::INT AS pos, unnest(h) AS hash FROM h")
def kgram_hashes(spark, d):
    return _sentences(spark, d).select("sent_id", F.posexplode(prints.kgrams(text.tokens(F.col("text")), 5)).alias("pos", "hash"))


@query(f"WITH {SENTENCES}, t AS (SELECT sent_id, {d_tokens('text')} AS t FROM s), h AS (SELECT sent_id, {d_kgrams('t')} AS h FROM t) SELECT sent_id, unnest({d_winnowed('h')}) AS print FROM h")
def winnow_fingerprints(spark, d):
    return _sentences(spark, d).select("sent_id", F.explode(prints.fingerprint(text.tokens(F.col("text")))).alias("print"))


@query(f"WITH {SENTENCES}, n AS (SELECT sent_id, {d_normal('text')} AS n FROM s) SELECT sent_id, len({d_shingles('n', 4)})::INT AS k4, len({d_shingles('n', 6)})::INT AS k6, len({d_shingles('n', 9)})::INT AS k9 FROM n")
def char_shingles(spark, d):
    n = _sentences(spark, d).select("sent_id", prints.shingle_text(F.col("text")).alias("n"))
    return n.select("sent_id", *[F.size(prints.char_shingles(F.col("n"), k)).alias(f"k{k}") for k in (4, 6, 9)])


_PAIR = "a.sent_id AS sent_a, b.sent_id AS sent_b"


def _pair(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(F.col("sent_id_a").alias("sent_a"), F.col("sent_id_b").alias("sent_b"), *[text.rounded(v, 6).alias(k) for k, v in values.items()])


@query(f"WITH {SENTENCES}, h AS (SELECT *, {d_kgrams(d_tokens('text'))} AS h FROM s), p AS (SELECT *, {d_winnowed('h')} AS p FROM h) SELECT {_PAIR}, {d_rounded(d_contained('a.p', 'b.p'), 6)} AS contained FROM {NEXT.replace('s a', 'p a').replace('s b', 'p b')}")
def winnow_pairs(spark, d):
    df = _neighbours(spark, d, prints.fingerprint(text.tokens(F.col("text"))).alias("p"))
    return _pair(df, contained=prints.containment(F.col("p_a"), F.col("p_b")))


@query(
    f"""WITH {SENTENCES}, n AS (SELECT *, {d_normal('text')} AS n FROM s), k AS (SELECT *, {", ".join(f"{d_shingles('n', k)} AS k{k}" for k in (4, 6, 9))} FROM n)
    SELECT {_PAIR}, {d_rounded("0.25 * (" + d_contained('a.k4', 'b.k4') + ") + 0.45 * (" + d_contained('a.k6', 'b.k6') + ") + 0.30 * (" + d_contained('a.k9', 'b.k9') + ")", 6)} AS blended FROM {NEXT.replace('s a', 'k a').replace('s b', 'k b')}"""
)
def shingle_pairs(spark, d):
    df = _neighbours(spark, d, *[prints.char_shingles(prints.shingle_text(F.col("text")), k).alias(f"k{k}") for k in (4, 6, 9)])
    return _pair(df, blended=prints.blended(*[prints.containment(F.col(f"k{k}_a"), F.col(f"k{k}_b")) for k in (4, 6, 9)]))


@query(
    f"""WITH {SENTENCES}, t AS (SELECT *, list_distinct({d_tokens('text')}) AS t FROM s)
    SELECT {_PAIR}, {d_rounded("CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) ELSE 0.0 END", 6)} AS jaccard FROM {NEXT.replace('s a', 't a').replace('s b', 't b')}"""
)
def jaccard_pairs(spark, d):
    df = _neighbours(spark, d, text.tokens(F.col("text")).alias("t"))
    return _pair(df, jaccard=prints.jaccard(F.col("t_a"), F.col("t_b")))


# --- vectors ----------------------------------------------------------------------------------

_IDF = f"""terms AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({d_tokens('sentence')})) AS term FROM corpus) GROUP BY term),
idf AS (SELECT term, df, ln(((SELECT count(*) FROM corpus) + 1) / (df + 1)) + 1 AS idf FROM terms)"""


@query(f"WITH {CORPUS}, {_IDF} SELECT term, df, {d_rounded('idf', 6)} AS idf FROM idf")
def idf_table(spark, d):
    found = similarity.idf_table(similarity.corpus_sentences(table(spark, d, "corpus_docs")))
    return found.select("term", "df", text.rounded(F.col("idf"), 6).alias("idf"))


_STOP = ", ".join(q(w) for w in similarity.STOP_WORDS)
_WEIGHTS = f"""c AS (SELECT sent_id, list_filter({d_tokens('text')}, lambda w: w NOT IN ({_STOP})) AS c FROM s),
tf AS (SELECT sent_id, term, n, count(*) AS tf FROM (SELECT sent_id, len(c) AS n, unnest(c) AS term FROM c) GROUP BY sent_id, term, n),
w AS (SELECT sent_id, tf.term, tf / n * coalesce(idf, ln(2) + 1) AS w FROM tf LEFT JOIN idf ON tf.term = idf.term)"""


def _weights(spark: SparkSession, d: str) -> DataFrame:
    table_ = similarity.idf_table(similarity.corpus_sentences(table(spark, d, "corpus_docs")))
    return similarity.term_weights(_sentences(spark, d).select(F.col("sent_id").alias("key"), "text"), table_)


@query(f"WITH {CORPUS}, {_IDF}, {SENTENCES}, {_WEIGHTS} SELECT sent_id, term, {d_rounded('w', 6)} AS weight FROM w")
def tfidf_vectors(spark, d):
    return _weights(spark, d).select(F.col("key").alias("sent_id"), "term", text.rounded(F.col("weight"), 6).alias("weight"))


@query(
    f"""WITH {CORPUS}, {_IDF}, {SENTENCES}, {_WEIGHTS}, norm AS (SELECT sent_id, sqrt(sum(w * w)) AS n FROM w GROUP BY sent_id),
    p AS (SELECT {_PAIR} FROM {NEXT}), dots AS (SELECT sent_a, sent_b, sum(x.w * y.w) AS dot FROM p JOIN w x ON x.sent_id = sent_a JOIN w y ON y.sent_id = sent_b AND x.term = y.term GROUP BY sent_a, sent_b)
    SELECT p.sent_a, p.sent_b, {d_rounded("coalesce(dot / (x.n * y.n), 0.0)", 4)} AS cosine FROM p LEFT JOIN dots ON p.sent_a = dots.sent_a AND p.sent_b = dots.sent_b LEFT JOIN norm x ON x.sent_id = p.sent_a LEFT JOIN norm y ON y.sent_id = p.sent_b"""
)
def tfidf_cosine_pairs(spark, d):
    w = _weights(spark, d)
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    p = _neighbours(spark, d).select(F.col("sent_id_a").alias("sent_a"), F.col("sent_id_b").alias("sent_b"))
    side = lambda df, c, v: df.withColumnsRenamed({"key": f"sent_{c}", v: f"{v}_{c}"})
    dots = p.join(side(w, "a", "weight"), "sent_a").join(side(w, "b", "weight"), ["sent_b", "term"]).groupBy("sent_a", "sent_b").agg(F.sum(F.col("weight_a") * F.col("weight_b")).alias("dot"))
    both = p.join(dots, ["sent_a", "sent_b"], "left").join(side(norm, "a", "norm"), "sent_a", "left").join(side(norm, "b", "norm"), "sent_b", "left")
    return both.select("sent_a", "sent_b", text.rounded(F.coalesce(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), F.lit(0.0)), 4).alias("cosine"))


@query(
    f"""WITH f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), g AS (SELECT f.label, e.embedding AS first FROM f JOIN embeddings e ON e.vec_id = f.vec_id)
    SELECT vec_id, {d_rounded("list_sum(list_transform(list_zip(e.embedding, g.first), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))", 5)} AS cosine FROM embeddings e JOIN g ON e.label = g.label"""
)
def embedding_cosine(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", text.rounded(prints.dot(F.col("embedding"), F.col("first")), 5).alias("cosine"))


# --- similarity -------------------------------------------------------------------------------


def _scan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "sentences").select("org_id", "text"), table(spark, d, "corpus_docs").select("id", "org_id", "content")


_ASKED = f"""asked AS (SELECT DISTINCT org_id, text FROM sentences WHERE org_id IS NOT NULL AND text IS NOT NULL),
qt AS (SELECT org_id, text, list_filter(t, lambda x: true) AS t FROM (SELECT org_id, text, {d_tokens('text')} AS t FROM asked) WHERE len(t) >= 3)"""


@query(
    f"""WITH {CORPUS}, {_ASKED}, qd AS (SELECT org_id, text, unnest(list_distinct(t)) AS term FROM qt),
    qp AS (SELECT org_id, text, term, min(pos) AS pos FROM (SELECT org_id, text, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM qt) GROUP BY org_id, text, term),
    posted AS (SELECT DISTINCT doc_id, org_id AS doc_org, term FROM (SELECT doc_id, org_id, unnest({d_tokens('sentence')}) AS term FROM corpus)),
    met AS (SELECT q.org_id, text, doc_id, count(*) AS shared, min(pos) AS pos FROM qp q JOIN posted p ON q.term = p.term AND (p.doc_org = 'global' OR p.doc_org = q.org_id) GROUP BY q.org_id, text, doc_id)
    SELECT org_id, text, doc_id, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY org_id, text ORDER BY shared DESC, pos, doc_id) AS rank FROM met) WHERE rank <= 120
    UNION ALL SELECT org_id, text, doc_id, 0 AS shared, rank FROM (SELECT q.org_id, q.text, c.doc_id, row_number() OVER (PARTITION BY q.org_id, q.text ORDER BY c.doc_id) AS rank
        FROM qt q JOIN (SELECT DISTINCT doc_id, org_id AS doc_org FROM corpus) c ON c.doc_org = 'global' OR c.doc_org = q.org_id WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.org_id = q.org_id AND m.text = q.text)) WHERE rank <= 120"""
)
def candidate_docs(spark, d):
    """The 120 candidates of each scanned sentence; one that shares no token with any document gets the first that it may see, with shared 0."""
    return _candidates(*_scan(spark, d))


def _candidates(asked: DataFrame, docs: DataFrame) -> DataFrame:
    asked = asked.where("org_id is not null and text is not null").distinct().select(F.xxhash64("org_id", "text").alias("qid"), "org_id", "text", text.tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= 3)
    found = candidate_lists(asked, similarity.corpus_sentences(docs), similarity.CANDIDATES)
    return found.select("org_id", "text", F.posexplode("best").alias("n", "b")).select("org_id", "text", "b.doc_id", "b.shared", (F.col("n") + 1).alias("rank"))


@query()
def candidate_pairs(spark, d):
    """Each scanned sentence with every sentence of its candidate documents, and the scores of the pair."""
    scores = similarity.pair_scores(*_scan(spark, d))
    return scores.select("org_id", "text", "doc_id", "sent_idx", F.col("w").alias("contained"), F.col("cos").alias("cosine"), F.col("sh").alias("blended"), "jaccard")


def _d_blended(a: str, b: str) -> str:
    return " + ".join(f"{w} * ({d_contained(f'{a}{k}', f'{b}{k}')})" for w, k in (("0.25", 4), ("0.45", 6), ("0.30", 9)))


_FEATURES = f"""{", ".join(f"{d_shingles('n', k)} AS k{k}" for k in (4, 6, 9))}"""
# Every scanned sentence with every sentence of its candidate documents: best score and method of each document, then the five best.
_SOURCES = f"""{CORPUS}, a1 AS (SELECT DISTINCT org_id, text, {_d_without('text')} AS c FROM sentences WHERE org_id IS NOT NULL AND text IS NOT NULL), a2 AS (SELECT org_id, text, {d_tokens('c')} AS t, {d_normal('c')} AS n FROM a1),
a3 AS (SELECT *, {d_kgrams('t')} AS h, {_FEATURES} FROM a2 WHERE len(t) >= 3), asked AS (SELECT row_number() OVER () AS qid, org_id, text, t, {d_winnowed('h')} AS p, k4, k6, k9 FROM a3),
c1 AS (SELECT sentence, {d_tokens('sentence')} AS t, {d_normal('sentence')} AS n FROM (SELECT DISTINCT sentence FROM corpus)), c2 AS (SELECT *, {d_kgrams('t')} AS h, {_FEATURES} FROM c1), feat AS (SELECT sentence, t, {d_winnowed('h')} AS p, k4, k6, k9 FROM c2),
placed AS (SELECT doc_id, org_id AS doc_org, sent_idx, f.* FROM corpus JOIN feat f USING (sentence)),
qp AS (SELECT qid, org_id, term, min(pos) AS pos FROM (SELECT qid, org_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM asked) GROUP BY ALL), posted AS (SELECT DISTINCT doc_id, doc_org, unnest(t) AS term FROM placed),
met AS (SELECT qid, doc_id, count(*) AS shared, min(pos) AS pos FROM qp JOIN posted USING (term) WHERE doc_org = 'global' OR doc_org = org_id GROUP BY qid, doc_id),
cand AS (SELECT qid, doc_id FROM met QUALIFY row_number() OVER (PARTITION BY qid ORDER BY shared DESC, pos, doc_id) <= 120
    UNION ALL SELECT qid, doc_id FROM asked q JOIN (SELECT DISTINCT doc_id, doc_org FROM placed) c ON c.doc_org = 'global' OR c.doc_org = q.org_id WHERE qid NOT IN (SELECT qid FROM met) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY doc_id) <= 120),
df AS (SELECT doc_org, term, count(*) AS df FROM (SELECT doc_org, unnest(list_distinct(t)) AS term FROM placed) GROUP BY ALL), size AS (SELECT doc_org, count(*) AS n FROM placed GROUP BY doc_org),
viewer AS (SELECT DISTINCT org_id AS v FROM asked), total AS (SELECT v, sum(n) AS n FROM viewer JOIN size ON doc_org = 'global' OR doc_org = v GROUP BY v), seen AS (SELECT v, term, sum(df) AS df FROM viewer JOIN df ON doc_org = 'global' OR doc_org = v GROUP BY v, term),
idf AS (SELECT v, term, ln((n + 1) / (df + 1)) + 1 AS idf FROM seen JOIN total USING (v)),
q1 AS (SELECT qid, org_id AS v, list_filter(t, lambda w: w NOT IN ({_STOP})) AS c FROM asked), q2 AS (SELECT qid, v, len(c) AS n, unnest(c) AS term FROM q1), qw AS (SELECT qid, v, term, count(*) / n * coalesce(any_value(idf), ln(2) + 1) AS w FROM q2 LEFT JOIN idf USING (v, term) GROUP BY qid, v, term, n),
s1 AS (SELECT v, doc_id, sent_idx, list_filter(t, lambda w: w NOT IN ({_STOP})) AS c FROM (SELECT DISTINCT org_id AS v, doc_id FROM cand JOIN asked USING (qid)) JOIN placed USING (doc_id)), s2 AS (SELECT v, doc_id, sent_idx, len(c) AS n, unnest(c) AS term FROM s1),
sw AS (SELECT v, doc_id, sent_idx, term, count(*) / n * coalesce(any_value(idf), ln(2) + 1) AS w FROM s2 LEFT JOIN idf USING (v, term) GROUP BY v, doc_id, sent_idx, term, n),
qn AS (SELECT qid, sqrt(sum(w * w)) AS qn FROM qw GROUP BY qid), sn AS (SELECT v, doc_id, sent_idx, sqrt(sum(w * w)) AS sn FROM sw GROUP BY ALL),
dots AS (SELECT cand.qid, cand.doc_id, sw.sent_idx, sum(qw.w * sw.w) AS dot FROM cand JOIN qw ON qw.qid = cand.qid JOIN sw ON sw.v = qw.v AND sw.doc_id = cand.doc_id AND sw.term = qw.term GROUP BY ALL),
pairs AS (SELECT a.qid, a.org_id, a.text, s.doc_id, s.sent_idx, CASE WHEN len(a.t) >= 6 THEN {d_contained('a.p', 's.p')} ELSE 0.0 END AS w, {_d_blended('a.k', 's.k')} AS sh FROM cand c JOIN asked a USING (qid) JOIN placed s ON s.doc_id = c.doc_id),
scored AS (SELECT p.qid, p.org_id, p.text, p.doc_id, p.sent_idx, {d_rounded('p.w', 6)} AS w, {d_rounded('p.sh', 6)} AS sh, {d_rounded('coalesce(dot / (qn * sn), 0.0)', 6)} AS c
    FROM pairs p LEFT JOIN dots d ON d.qid = p.qid AND d.doc_id = p.doc_id AND d.sent_idx = p.sent_idx LEFT JOIN qn ON qn.qid = p.qid LEFT JOIN sn ON sn.v = p.org_id AND sn.doc_id = p.doc_id AND sn.sent_idx = p.sent_idx),
named AS (SELECT *, greatest(w, c, sh) AS score, CASE WHEN w > 0 AND greatest(w, c, sh) = w THEN 'exact' WHEN c > 0 AND greatest(w, c, sh) = c THEN 'semantic' WHEN sh > 0 THEN 'shingle' ELSE 'none' END AS method FROM scored),
by_doc AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, sent_idx) = 1),
sources AS (SELECT org_id, text, doc_id, score, method, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM by_doc WHERE score > 0.12 QUALIFY rank <= 5)"""


@query(f"WITH {_SOURCES} SELECT * FROM sources")
def sentence_sources(spark, d):
    """The flagship: the best corpus sources of every scanned sentence."""
    return similarity.sentence_sources(*_scan(spark, d))


# The document score of rows t (job_id, s, t): scores and token counts of scorable sentences.
_BLEND = f"""r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s DESC) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM t),
g AS (SELECT job_id, n, sum(t) AS t, sum(s * t) AS st, sum(CASE WHEN s >= 0.20 THEN t ELSE 0 END) AS cov, sum(CASE WHEN s >= 0.12 THEN t ELSE 0 END) AS mc,
    avg(CASE WHEN r <= greatest(1, ceil(n * 0.25)) THEN s END) AS top, avg(CASE WHEN r <= greatest(1, ceil(n * 0.5)) THEN s END) AS ut, avg(CASE WHEN s >= 0.35 THEN 1.0 ELSE 0.0 END) AS high FROM r GROUP BY job_id, n),
b AS (SELECT *, CASE WHEN t > 0 THEN least(1.0, 0.35 * st / t + 0.25 * cov / t + 0.25 * top + 0.15 * ut) END AS b FROM g),
blended AS (SELECT job_id, n, CASE WHEN t > 0 THEN {d_rounded("CASE WHEN mc / t >= 0.92 AND top >= 0.55 AND high >= 0.65 THEN b ELSE least(b, 0.94) END", 4)} ELSE 0.0 END AS similarity FROM b)"""


@query(
    f"""WITH {_SOURCES}, {SENTENCES}, first AS (SELECT org_id, text, score FROM sources WHERE rank = 1),
    t AS (SELECT job_id, {d_rounded('coalesce(score, 0.0)', 4)} AS s, len({d_tokens('s.text')}) AS t FROM s LEFT JOIN first f ON f.org_id = s.org_id AND f.text = s.text WHERE job_id IS NOT NULL AND s.org_id IS NOT NULL AND NOT {_d_citation('s.text')}), {_BLEND} SELECT * FROM blended"""
)
def document_similarity(spark, d):
    """Each job's similarity from its sentences' best sources."""
    best = similarity.sentence_sources(*_scan(spark, d)).where("rank = 1").select("org_id", "text", "score")
    s = _sentences(spark, d).where("job_id is not null and org_id is not null").where(~cleaning.is_citation(F.col("text")))
    rows = s.join(best, ["org_id", "text"], "left").select(F.col("job_id").alias("key"), text.rounded(F.coalesce("score", F.lit(0.0)), 4).alias("score"), F.size(text.tokens(F.col("text"))).alias("n_tokens"))
    return similarity.document_scores(rows).withColumnRenamed("key", "job_id")


@query(
    f"""WITH {SENTENCES.replace('sent_idx, text', 'sent_idx, text, similarity_score')}, t AS (SELECT job_id, coalesce(similarity_score, 0.0) AS s, len({d_tokens('text')}) AS t FROM s WHERE job_id IS NOT NULL AND NOT {_d_citation('text')}),
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s DESC) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM t),
    g AS (SELECT job_id, n, sum(t) AS t, sum(s * t) AS st, sum(CASE WHEN s >= 0.20 THEN t ELSE 0 END) AS cov, sum(CASE WHEN s >= 0.12 THEN t ELSE 0 END) AS mc,
        avg(CASE WHEN r <= greatest(1, ceil(n * 0.25)) THEN s END) AS top, avg(CASE WHEN r <= greatest(1, ceil(n * 0.5)) THEN s END) AS ut, avg(CASE WHEN s >= 0.35 THEN 1.0 ELSE 0.0 END) AS high FROM r GROUP BY job_id, n),
    b AS (SELECT *, CASE WHEN t > 0 THEN least(1.0, 0.35 * st / t + 0.25 * cov / t + 0.25 * top + 0.15 * ut) END AS b FROM g)
    SELECT job_id, n, CASE WHEN t > 0 THEN {d_rounded("CASE WHEN mc / t >= 0.92 AND top >= 0.55 AND high >= 0.65 THEN b ELSE least(b, 0.94) END", 4)} ELSE 0.0 END AS similarity FROM b"""
)
def stored_similarity(spark, d):
    """The document blend over the similarity scores stored with the sentences."""
    s = table(spark, d, "sentences").select("sent_id", "job_id", "org_id", "sent_idx", "text", "similarity_score").where("text is not null and job_id is not null").distinct().where(~cleaning.is_citation(F.col("text")))
    rows = s.select(F.col("job_id").alias("key"), F.coalesce("similarity_score", F.lit(0.0)).alias("score"), F.size(text.tokens(F.col("text"))).alias("n_tokens"))
    return similarity.document_scores(rows).withColumnRenamed("key", "job_id")


@query(
    """SELECT job_id, count(*) FILTER (detection_method = 'exact') AS exact, count(*) FILTER (detection_method = 'semantic') AS semantic, count(*) FILTER (detection_method = 'shingle') AS shingle, count(*) FILTER (detection_method = 'embedding') AS embedding
    FROM (SELECT DISTINCT sent_id, job_id, detection_method FROM sentences WHERE NOT coalesce(is_citation, false)) WHERE job_id IS NOT NULL GROUP BY job_id"""
)
def method_breakdown(spark, d):
    s = table(spark, d, "sentences").where(~F.coalesce("is_citation", F.lit(False))).select("sent_id", "job_id", "detection_method").distinct().where("job_id is not null")
    return s.groupBy("job_id").agg(*[F.count_if(F.col("detection_method") == m).alias(m) for m in ("exact", "semantic", "shingle", "embedding")])


@query(
    """WITH u AS (SELECT DISTINCT sent_id, job_id, sources FROM sentences WHERE job_id IS NOT NULL AND sources IS NOT NULL), x AS (SELECT job_id, unnest(sources) AS m FROM u)
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY best DESC NULLS LAST, url) AS rank FROM (SELECT job_id, m.url AS url, max(m.match_percentage) AS best, count(*) AS matches, count(DISTINCT m.title) AS titles FROM x GROUP BY job_id, m.url)"""
)
def source_rollup(spark, d):
    s = table(spark, d, "sentences").where("job_id is not null").select("sent_id", "job_id", "sources").distinct().select("job_id", F.explode("sources").alias("m"))
    found = s.groupBy("job_id", F.col("m.url").alias("url")).agg(F.max("m.match_percentage").alias("best"), F.count("*").alias("matches"), F.countDistinct("m.title").alias("titles"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("best"), "url")))


@query(
    """WITH u AS (SELECT DISTINCT sent_id, org_id, sources FROM sentences WHERE sources IS NOT NULL), r AS (SELECT u.sent_id, u.sources, coalesce(o.student_source_reveal, false) AS told FROM u LEFT JOIN orgs o ON o.id = u.org_id)
    SELECT sent_id, CASE WHEN told THEN m.title ELSE '[Source hidden]' END AS title, CASE WHEN told THEN m.url ELSE '#' END AS url, m.match_percentage AS match FROM (SELECT sent_id, told, unnest(sources) AS m FROM r)"""
)
def masked_sources(spark, d):
    orgs = table(spark, d, "orgs").select(F.col("id").alias("org_id"), F.coalesce("student_source_reveal", F.lit(False)).alias("show"))
    s = table(spark, d, "sentences").select("sent_id", "org_id", "sources").where("sources is not null").distinct().join(orgs, "org_id", "left")
    hidden = s.select("sent_id", F.explode(store.masked(F.col("sources"), ~F.coalesce("show", F.lit(False)))).alias("m"))
    return hidden.select("sent_id", "m.title", "m.url", F.col("m.match_percentage").alias("match"))


# --- stylometry -------------------------------------------------------------------------------


def _d_map(values: dict[str, float], x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {q(k)} THEN {v!r}" for k, v in values.items()) + " END"


def _d_surprisal(t: str) -> str:
    pair = f"CASE WHEN i > 1 THEN coalesce({_d_map(stylometry.PAIR_PROBABILITY, f'{t}[i-1] || chr(32) || {t}[i]')}, 0.0) ELSE 0.0 END"
    return f"list_sum(list_transform(range(1, len({t}) + 1), lambda i: -ln(greatest(1e-6, 0.7 * coalesce({_d_map(stylometry.WORD_PROBABILITY, f'{t}[i]')}, 1e-6) + 0.3 * {pair})))) / len({t})"


_TOK = f"t AS (SELECT sent_id, job_id, org_id, sent_idx, text, {d_tokens('text')} AS t FROM s)"


@query(f"WITH {SENTENCES}, {_TOK} SELECT sent_id, {d_rounded(_d_surprisal('t'), 6)} AS surprisal FROM t WHERE len(t) > 0")
def token_surprisal(spark, d):
    t = _sentences(spark, d).select("sent_id", text.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("sent_id", text.rounded(stylometry.surprisal(F.col("t")), 6).alias("surprisal"))


_TRI = """j AS (SELECT job_id, t[i] || chr(0) || t[i+1] || chr(0) || t[i+2] AS g FROM (SELECT job_id, t, unnest(range(1, len(t) - 1)) AS i FROM t WHERE len(t) >= 3)),
c AS (SELECT job_id, g, count(*) AS n FROM j GROUP BY job_id, g)"""


@query(f"WITH {SENTENCES}, {_TOK}, {_TRI} SELECT job_id, {d_rounded('count(*) FILTER (n > 1) / count(*)', 6)} AS repeated FROM c WHERE job_id IS NOT NULL GROUP BY job_id")
def trigram_repeat(spark, d):
    t = _sentences(spark, d).where("job_id is not null").select("job_id", text.tokens(F.col("text")).alias("t")).where(F.size("t") >= 3)
    g = t.select("job_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 2), lambda i: F.array_join(F.slice(F.col("t"), i, 3), "\u0000"))).alias("g"))
    counts = g.groupBy("job_id", "g").agg(F.count("*").alias("n"))
    return counts.groupBy("job_id").agg(text.rounded(F.count_if(F.col("n") > 1) / F.count("*"), 6).alias("repeated"))


_LETTERS = "list_filter([{}], lambda c: c > 0)".format(", ".join(f"length(l) - length(replace(l, '{chr(c)}', ''))" for c in range(97, 123)))


@query(
    f"""WITH {SENTENCES}, l AS (SELECT sent_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS l FROM s)
    SELECT sent_id, {d_rounded(f"-list_sum(list_transform({_LETTERS}, lambda c: c / length(l) * log2(c / length(l))))", 6)} AS entropy FROM l WHERE length(l) >= 20"""
)
def letter_entropy(spark, d):
    return _sentences(spark, d).select("sent_id", text.rounded(stylometry.letter_entropy(F.col("text")), 6).alias("entropy")).where("entropy is not null")


def _d_density(x: str, phrases: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower({x}), {q(p)})::INT" for p in phrases) + f") / {len(phrases)}"


def _d_calibrated(x: str) -> str:
    y = stylometry.CALIBRATION["default"]
    return "CASE " + " ".join(f"WHEN {x} <= {(k + 1) / 5!r} THEN {y[k]!r} + ({x} - {k / 5!r}) / 0.2 * ({y[k + 1]!r} - {y[k]!r})" for k in range(5)) + " ELSE 1.0 END"


_SENTENCE_AI = f"""x AS (SELECT sent_id, job_id, sent_idx, text, t, CASE WHEN len(t) > 0 THEN exp({_d_surprisal('t')}) ELSE 999.0 END AS ppl, regexp_replace(lower(text), '[^a-z]', '', 'g') AS l,
    list_transform(range(1, len(t) - 1), lambda i: t[i] || chr(0) || t[i+1] || chr(0) || t[i+2]) AS g FROM t),
y AS (SELECT sent_id, job_id, sent_idx, text, t, ppl, {d_clamp('(80 - ppl) / 60')} AS f1,
    CASE WHEN len(t) < 6 THEN 0.0 ELSE len(list_filter(list_distinct(g), lambda k: len(list_filter(g, lambda h: h = k)) > 1)) / greatest(1, len(list_distinct(g))) END AS f2,
    CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 1.0 END AS ttr,
    CASE WHEN length(l) < 20 THEN 0.5 ELSE {d_clamp(f"(4.5 + list_sum(list_transform({_LETTERS}, lambda c: c / length(l) * log2(c / length(l))))) / 2.5")} END AS f4,
    {_d_density('text', stylometry.CONNECTORS)} AS f5, {_d_density('text', stylometry.TEMPLATES)} AS f6, len(regexp_extract_all(text, '[,:;!?()\\-]')) / greatest(1, length(text)) AS punct FROM x),
z AS (SELECT *, {d_clamp("0.28 * f1 + 0.14 * f2 + 0.12 * (1 - ttr) + 0.11 * f4 + 0.10 * f5 + 0.10 * f6 + 0.15 * " + d_clamp("1 - punct / 0.05"))} AS raw, least(greatest(0.20 - 0.003 * len(t), 0.06), 0.20) AS spread FROM y),
p AS (SELECT *, {_d_calibrated('raw')} AS p FROM z)"""


@query(
    f"""WITH {SENTENCES}, {_TOK}, {_SENTENCE_AI} SELECT sent_id, CASE WHEN len(t) < 4 THEN 0.4 ELSE {d_rounded('p', 4)} END AS p,
    CASE WHEN len(t) < 4 THEN 0.2 ELSE {d_rounded(d_clamp('p - spread'), 4)} END AS lo, CASE WHEN len(t) < 4 THEN 0.6 ELSE {d_rounded(d_clamp('p + spread'), 4)} END AS hi FROM p"""
)
def sentence_ai(spark, d):
    t = _sentences(spark, d).select("sent_id", "text", text.tokens(F.col("text")).alias("t"))
    return t.select("sent_id", stylometry.sentence_score(F.col("text"), F.col("t")).alias("a")).select("sent_id", "a.p", "a.lo", "a.hi")


def _document_signals(spark: SparkSession, d: str) -> DataFrame:
    """One row of signals for each job, from its sentences in order."""
    s = _sentences(spark, d).where("job_id is not null").select("job_id", "sent_id", "text", text.tokens(F.col("text")).alias("t"))
    per = s.groupBy("job_id").agg(
        F.count("*").alias("n"), F.avg(stylometry.perplexity(F.col("t"))).alias("mean"), F.var_pop(stylometry.perplexity(F.col("t"))).alias("var"),
        (F.countDistinct(stylometry.opening(F.col("text"))) / F.count("*")).alias("openings"), F.sum(F.size("t")).alias("tokens"),
        *[F.max(F.lower("text").contains(p).cast("int")).alias(f"c{k}") for k, p in enumerate(stylometry.CONNECTORS)], *[F.max(F.lower("text").contains(p).cast("int")).alias(f"m{k}") for k, p in enumerate(stylometry.TEMPLATES)],
        *[F.sum(F.length(F.lower("text")) - F.length(F.replace(F.lower("text"), F.lit(chr(c)), F.lit("")))).alias(f"l{chr(c)}") for c in range(97, 123)],
    )
    types = s.select("job_id", F.explode("t").alias("w")).groupBy("job_id").agg(F.countDistinct("w").alias("types"))
    every = per.join(types, "job_id", "left").join(trigram_repeat(spark, d), "job_id", "left")
    letters = F.array(*[F.col(f"l{chr(c)}") for c in range(97, 123)])
    total = F.aggregate(letters, F.lit(0).cast("bigint"), lambda a, x: a + x)
    every = every.withColumn("letters", total)
    h = F.aggregate(letters, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / F.col("letters") * F.log2(x / F.col("letters"))).otherwise(0.0))
    mean = lambda p, n: sum((F.col(f"{p}{k}") for k in range(n)), F.lit(0)) / n
    return every.select(
        "job_id", stylometry.perplexity_signal(F.col("mean")).alias("perplexity"), stylometry.burstiness_signal(F.col("var"), F.col("n")).alias("burstiness"),
        F.when(F.col("tokens") < 6, 0.0).otherwise(F.coalesce("repeated", F.lit(0.0))).alias("trigram_repeat"), (1 - F.coalesce(F.col("types") / F.col("tokens"), F.lit(1.0))).alias("lexical_uniformity"),
        F.when(F.col("letters") < 20, 0.5).otherwise(text.clamp((4.5 - h) / 2.5)).alias("entropy"), mean("m", 8).alias("template_density"), mean("c", 9).alias("connector_density"), (1 - F.col("openings")).alias("structure_uniformity"),
    )


def _d_letters(agg: str) -> str:
    return ", ".join(f"{agg}(length(lower(text)) - length(replace(lower(text), '{chr(c)}', ''))) AS l{chr(c)}" for c in range(97, 123))


_DOCUMENT_AI = f"""{_TRI}, rep AS (SELECT job_id, {d_rounded('count(*) FILTER (n > 1) / count(*)', 6)} AS repeated FROM c GROUP BY job_id),
v AS (SELECT job_id, text, t, CASE WHEN len(t) > 0 THEN exp({_d_surprisal('t')}) ELSE 999.0 END AS ppl FROM t WHERE job_id IS NOT NULL),
per AS (SELECT job_id, count(*) AS n, avg(ppl) AS mean, var_pop(ppl) AS var, count(DISTINCT array_to_string(regexp_split_to_array(lower(trim(text)), '\\s+')[1:2], ' ')) / count(*) AS openings, sum(len(t)) AS tokens,
    {", ".join(f"max(contains(lower(text), {q(p)})::INT) AS c{k}" for k, p in enumerate(stylometry.CONNECTORS))}, {", ".join(f"max(contains(lower(text), {q(p)})::INT) AS m{k}" for k, p in enumerate(stylometry.TEMPLATES))}, {_d_letters('sum')} FROM v GROUP BY job_id),
types AS (SELECT job_id, count(DISTINCT w) AS types FROM (SELECT job_id, unnest(t) AS w FROM v) GROUP BY job_id),
e AS (SELECT *, [{", ".join(f"l{chr(c)}" for c in range(97, 123))}]  AS every_letter, {" + ".join(f"l{chr(c)}" for c in range(97, 123))} AS letters FROM per LEFT JOIN types USING (job_id) LEFT JOIN rep USING (job_id)),
sig AS (SELECT job_id, {d_clamp('(80 - mean) / 60')} AS perplexity, CASE WHEN n < 2 THEN 0.5 ELSE {d_clamp('(1200 - var) / 1200')} END AS burstiness, CASE WHEN tokens < 6 THEN 0.0 ELSE coalesce(repeated, 0.0) END AS trigram_repeat,
    1 - coalesce(types / nullif(tokens, 0), 1.0) AS lexical_uniformity, CASE WHEN letters < 20 THEN 0.5 ELSE {d_clamp("(4.5 + list_sum(list_transform(list_filter(every_letter, lambda c: c > 0), lambda c: c / letters * log2(c / letters)))) / 2.5")} END AS entropy,
    ({" + ".join(f"m{k}" for k in range(8))}) / 8 AS template_density, ({" + ".join(f"c{k}" for k in range(9))}) / 9 AS connector_density, 1 - openings AS structure_uniformity FROM e),
raw AS (SELECT *, 0.25 * perplexity + 0.15 * burstiness + 0.10 * trigram_repeat + 0.10 * lexical_uniformity + 0.10 * entropy + 0.30 * (0.35 * connector_density + 0.35 * template_density + 0.30 * structure_uniformity) AS raw FROM sig),
cal AS (SELECT *, {_d_calibrated(d_clamp('raw'))} AS p FROM raw),
doc AS (SELECT *, {d_rounded("CASE WHEN perplexity > 0.75 AND burstiness > 0.75 AND trigram_repeat > 0.55 AND template_density > 0.40 THEN p ELSE least(p, 0.94) END", 4)} AS probability FROM cal)"""


def _document_ai(spark: SparkSession, d: str) -> DataFrame:
    s = _document_signals(spark, d)
    p = stylometry.calibrated(text.clamp(stylometry.document_raw({k: F.col(k) for k in stylometry.REASONS})))
    sure = (F.col("perplexity") > 0.75) & (F.col("burstiness") > 0.75) & (F.col("trigram_repeat") > 0.55) & (F.col("template_density") > 0.40)
    return s.withColumn("probability", text.rounded(F.when(sure, p).otherwise(F.least(p, F.lit(0.94))), 4))


@query(f"WITH {SENTENCES}, {_TOK}, {_DOCUMENT_AI} SELECT job_id, {d_rounded('probability', 3)} AS probability, CASE WHEN probability < 0.40 THEN 'LIKELY_HUMAN' WHEN probability < 0.70 THEN 'UNCERTAIN' ELSE 'LIKELY_AI' END AS band FROM doc")
def document_ai(spark, d):
    return _document_ai(spark, d).select("job_id", text.rounded(F.col("probability"), 3).alias("probability"), stylometry.band(F.col("probability")).alias("band"))


_D_SIGNALS = ", ".join(f"{{'v': {k}, 'n': {n}, 'text': {q(t)}}}" for n, (k, t) in enumerate(stylometry.REASONS.items()))


@query(
    f"""WITH {SENTENCES}, {_TOK}, {_DOCUMENT_AI}, k AS (SELECT job_id, unnest([{_D_SIGNALS}]) AS k FROM doc), t AS (SELECT job_id, k.v AS v, k.text AS reason FROM k QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY k.v DESC, k.n) <= 4)
    SELECT job_id, reason FROM t WHERE v >= 0.55 UNION ALL SELECT job_id, {q(stylometry.NO_REASON)} FROM doc WHERE job_id NOT IN (SELECT job_id FROM t WHERE v >= 0.55)""".replace(", t AS (SELECT job_id, k.v", ", top AS (SELECT job_id, k.v").replace("FROM t WHERE v", "FROM top WHERE v")
)
def ai_reasons(spark, d):
    return _document_ai(spark, d).select("job_id", F.explode(stylometry.reasons({k: F.col(k) for k in stylometry.REASONS})).alias("reason"))


@query(
    f"""WITH u AS (SELECT DISTINCT sent_id, ai_probability AS a, similarity_score AS b FROM sentences)
    SELECT sent_id, CASE WHEN b IS NULL THEN a ELSE {d_rounded(d_clamp('0.35 * a + 0.65 * b'), 4)} END AS fused FROM u WHERE a IS NOT NULL"""
)
def ai_fusion(spark, d):
    u = table(spark, d, "sentences").select("sent_id", "ai_probability", "similarity_score").distinct().where("ai_probability is not null")
    return u.select("sent_id", stylometry.fused(F.col("ai_probability"), F.col("similarity_score")).alias("fused"))


# --- reports ----------------------------------------------------------------------------------

# Conditions and texts of the tips.
_TIPS = (
    ("similarity >= 0.2", "Rewrite matched passages in your own words and add clear citations for borrowed ideas."),
    ("ai >= 0.5", "Add your own examples, personal reasoning, and topic-specific details to make authorship clearer."),
    ("ai >= 0.5", "Vary sentence length and structure naturally instead of repeating template transitions."),
    ("excluded = 0", "Include proper in-text citations and a reference list where external claims are used."),
    ("flags > 0", "Remove hidden characters or unusual symbols before submission and keep formatting clean."),
)
_NO_TIP = "Good result. Do a final proofreading pass for clarity, citations, and originality."
_SCORES = "r AS (SELECT job_id, count(*) AS n, sum((round(similarity_score * 10000))::BIGINT) / (count(similarity_score) * 10000.0) AS similarity, sum((round(ai_probability * 10000))::BIGINT) / (count(ai_probability) * 10000.0) AS ai, count(*) FILTER (is_citation) AS excluded, count(*) FILTER (similarity_score >= 0.30 AND NOT coalesce(is_citation, false)) AS high_similarity, count(*) FILTER (ai_probability >= 0.65) AS high_ai FROM (SELECT DISTINCT sent_id, job_id, similarity_score, ai_probability, is_citation FROM sentences WHERE job_id IS NOT NULL) GROUP BY job_id)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """One row of stored scores for each job."""
    s = table(spark, d, "sentences").where("job_id is not null").select("sent_id", "job_id", "similarity_score", "ai_probability", "is_citation").distinct()
    cited = F.coalesce("is_citation", F.lit(False))
    # Means over whole ten-thousandths: the same double in whatever order rows are added.
    mean = lambda c: F.try_divide(F.sum(F.round(F.col(c) * 10000).cast("bigint")), F.count(c) * 10000.0)
    return s.groupBy("job_id").agg(
        F.count("*").alias("n"), mean("similarity_score").alias("similarity"), mean("ai_probability").alias("ai"), F.count_if(cited).alias("excluded"),
        F.count_if((F.col("similarity_score") >= 0.30) & ~cited).alias("high_similarity"), F.count_if(F.col("ai_probability") >= 0.65).alias("high_ai"),
    )


@query(
    f"""WITH {_SCORES} SELECT job_id, n, {d_rounded('similarity', 3)} AS similarity, {d_rounded('ai', 3)} AS ai, high_similarity, high_ai,
    CASE WHEN similarity >= 0.35 OR ai >= 0.50 THEN 'HIGH' WHEN similarity >= 0.15 OR ai >= 0.22 THEN 'MODERATE' ELSE 'LOW' END AS band FROM r"""
)
def risk_bands(spark, d):
    s, a = F.col("similarity"), F.col("ai")
    band = F.when((s >= 0.35) | (a >= 0.50), "HIGH").when((s >= 0.15) | (a >= 0.22), "MODERATE").otherwise("LOW")
    return _scores(spark, d).select("job_id", "n", text.rounded(s, 3).alias("similarity"), text.rounded(a, 3).alias("ai"), "high_similarity", "high_ai", band.alias("band"))


@query(
    f"""WITH {_SCORES}, f AS (SELECT job_id, count(DISTINCT flag_id) AS flags FROM obfuscation_flags GROUP BY job_id),
    t AS (SELECT r.job_id, list_filter([{", ".join(f"CASE WHEN {c} THEN {q(t)} END" for c, t in _TIPS)}], lambda x: x IS NOT NULL) AS tips FROM (SELECT r.job_id, coalesce(similarity, 0) AS similarity, coalesce(ai, 0) AS ai, excluded, coalesce(flags, 0) AS flags FROM r LEFT JOIN f ON r.job_id = f.job_id) r)
    SELECT job_id, unnest(CASE WHEN len(tips) > 0 THEN tips ELSE [{q(_NO_TIP)}] END) AS tip FROM t"""
)
def improvement_tips(spark, d):
    f = table(spark, d, "obfuscation_flags").groupBy("job_id").agg(F.countDistinct("flag_id").alias("flags"))
    r = _scores(spark, d).join(f, "job_id", "left").na.fill(0, ["similarity", "ai", "flags"])
    tips = F.filter(F.array(*[F.when(F.expr(c), t) for c, t in _TIPS]), lambda t: t.isNotNull())
    return r.select("job_id", tips.alias("t")).select("job_id", F.explode(F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(F.lit(_NO_TIP)))).alias("tip"))


_PARA = f"""p AS (SELECT id, unnest(range(0, len(l))) AS para_idx, unnest(l) AS p FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '\\n{{2,}}'), lambda p: {d_trimmed('p')}), lambda p: length(p) > 40) AS l FROM d)),
x AS (SELECT id, para_idx, unnest({d_sentences('p')}) AS sentence FROM p), m AS (SELECT text, similarity_score AS s, ai_probability AS a FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY sent_id NULLS LAST, sent_idx NULLS LAST, similarity_score NULLS LAST, ai_probability NULLS LAST) AS r FROM sentences WHERE text IS NOT NULL) WHERE r = 1)"""


@query(f"WITH {DOCS}, {_PARA} SELECT id, para_idx::INT AS para_idx, count(*) AS sentence_count, count(m.text) AS matched, {d_rounded('coalesce(avg(s), 0.0)', 4)} AS avg_similarity, {d_rounded('coalesce(avg(a), 0.0)', 4)} AS avg_ai FROM x LEFT JOIN m ON x.sentence = m.text GROUP BY id, para_idx")
def paragraph_scores(spark, d):
    """Paragraphs of corpus documents with the mean stored scores of their sentences; of equal sentences the first one scanned counts."""
    x = paragraphs(spark, d).select("id", "para_idx", F.explode(text.sentences(F.col("paragraph"))).alias("text"))
    order = ["sent_id", "sent_idx", "similarity_score", "ai_probability"]
    first = F.min_by(F.struct("similarity_score", "ai_probability"), F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))]))
    m = table(spark, d, "sentences").where("text is not null").groupBy("text").agg(first.alias("f")).select("text", F.col("f.similarity_score").alias("s"), F.col("f.ai_probability").alias("a"), F.lit(1).alias("hit"))
    zero = F.lit(0.0)
    return x.join(m, "text", "left").groupBy("id", "para_idx").agg(F.count("*").alias("sentence_count"), F.count("hit").alias("matched"), text.rounded(F.coalesce(F.avg("s"), zero), 4).alias("avg_similarity"), text.rounded(F.coalesce(F.avg("a"), zero), 4).alias("avg_ai"))


@query()
def full_report(spark, d):
    """The nested report of each job, assembled from the flat results only here."""
    first = Window.partitionBy("sent_id").orderBy(F.col("scored_at").desc_nulls_last(), "sent_idx", "text", "similarity_score", "ai_probability")
    s = table(spark, d, "sentences").where("job_id is not null").withColumn("r", F.row_number().over(first)).where("r = 1")
    rows = s.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "text", "similarity_score", "ai_probability", "is_citation", "detection_method"))).alias("sentences"))  # of one job
    return risk_bands(spark, d).join(rows, "job_id").join(method_breakdown(spark, d), "job_id", "left").select("job_id", F.to_json(F.struct("similarity", "ai", "band", "high_similarity", "high_ai", "exact", "semantic", "shingle", "sentences")).alias("report"))


# --- records ----------------------------------------------------------------------------------


@query("SELECT job_id, seq, status, batch_no FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS r FROM jobs WHERE job_id IS NOT NULL) WHERE r = 1")
def latest_jobs(spark, d):
    jobs = table(spark, d, "jobs").where("job_id is not null").select("job_id", "seq", "status", "batch_no")
    return store.latest(jobs, "job_id", F.col("seq"))


@query(
    """WITH RECURSIVE l AS (SELECT job_id AS id, min(parent_job_id) AS up FROM jobs WHERE job_id IS NOT NULL GROUP BY job_id), l2 AS (SELECT id, CASE WHEN up <> id THEN up END AS up FROM l),
    w AS (SELECT id, coalesce(up, id) AS root, CASE WHEN up IS NULL THEN 0 ELSE 1 END AS depth FROM l2 UNION ALL SELECT w.id, l2.up, w.depth + 1 FROM w JOIN l2 ON l2.id = w.root WHERE l2.up IS NOT NULL AND w.depth > 0 AND w.depth < (SELECT greatest(64, count(*)) FROM l))
    SELECT id, max_by(root, depth) AS root, max(depth)::INT AS depth FROM w GROUP BY id"""
)
def scan_history(spark, d):
    return store.chains(table(spark, d, "jobs").select("job_id", "parent_job_id"), "job_id", "parent_job_id")


@query(
    """WITH j AS (SELECT DISTINCT seq, job_id, org_id, status, batch_no FROM jobs WHERE org_id IS NOT NULL)
    SELECT seq, job_id, count(*) FILTER (status = 'complete') OVER w + 1 AS version, last_value(CASE WHEN status = 'complete' THEN job_id END IGNORE NULLS) OVER w AS parent FROM j
    WINDOW w AS (PARTITION BY org_id, batch_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def scan_versions(spark, d):
    j = table(spark, d, "jobs").select("seq", "job_id", "org_id", "status", "batch_no").where("org_id is not null").distinct()
    return store.versions(j, ["org_id", "batch_no"], ["seq"], F.col("status") == "complete").select("seq", "job_id", "version", "parent")


_DONE = "l.status = 'complete' AND json_valid(l.json) AND json_type(l.json, '$.report') = 'OBJECT'"


@query(
    f"""WITH {_SCORES}, l AS (SELECT * FROM jobs WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1)
    SELECT l.org_id, count(*) AS total, count(*) FILTER (l.status = 'queued') AS queued, count(*) FILTER (l.status = 'processing') AS processing, count(*) FILTER (coalesce({_DONE}, false)) AS complete, count(*) FILTER (l.status = 'failed') AS failed,
    {d_rounded(f"coalesce(sum(floor(coalesce(r.similarity, 0) * 1e6 + 0.5)::BIGINT) FILTER (coalesce({_DONE}, false)) / (1e6 * count(*) FILTER (coalesce({_DONE}, false))), 0.0)", 4)} AS avg_similarity, {d_rounded(f"coalesce(sum(floor(coalesce(r.ai, 0) * 1e6 + 0.5)::BIGINT) FILTER (coalesce({_DONE}, false)) / (1e6 * count(*) FILTER (coalesce({_DONE}, false))), 0.0)", 4)} AS avg_ai
    FROM l LEFT JOIN r ON r.job_id = l.job_id WHERE l.org_id IS NOT NULL GROUP BY l.org_id"""
)
def org_stats(spark, d):
    """Jobs of each organisation by state, and the mean scores of those that are complete with a report."""
    from quillmesh.plans.listings import last_jobs

    last = last_jobs(spark, d).where("org_id is not null").select("job_id", "org_id", "status", "reported").join(_scores(spark, d).select("job_id", "similarity", "ai"), "job_id", "left")
    done = F.coalesce((F.col("status") == "complete") & F.col("reported"), F.lit(False))
    # Sums of whole millionths: the same double in whatever order rows are added.
    mean = lambda c: text.rounded(F.coalesce(F.try_divide(F.sum(F.when(done, F.floor(F.coalesce(c, F.lit(0.0)) * 1e6 + 0.5).cast("bigint"))), F.lit(1e6) * F.count_if(done)), F.lit(0.0)), 4)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return last.groupBy("org_id").agg(F.count("*").alias("total"), count("queued"), count("processing"), F.count_if(done).alias("complete"), count("failed"), mean("similarity").alias("avg_similarity"), mean("ai").alias("avg_ai"))


@query("SELECT seq, id, event_type, org_id FROM audit_log ORDER BY seq DESC LIMIT 1000")
def audit_tail(spark, d):
    return store.newest(table(spark, d, "audit_log").select("seq", "id", "event_type", "org_id"), "seq", 1000)


@query("SELECT event_type, role, count(DISTINCT id) AS events, count(*) - count(DISTINCT id) AS repeated FROM audit_log WHERE id IS NOT NULL GROUP BY event_type, role")
def audit_counts(spark, d):
    return table(spark, d, "audit_log").where("id is not null").groupBy("event_type", "role").agg(F.countDistinct("id").alias("events"), (F.count("*") - F.countDistinct("id")).alias("repeated"))


@query("SELECT DISTINCT id FROM corpus_docs n WHERE batch_no = 12 AND id NOT IN (SELECT id FROM corpus_docs WHERE batch_no < 12 AND id IS NOT NULL)")
def anti_insert(spark, d):
    """What an idempotent insert of the last batch adds."""
    docs = table(spark, d, "corpus_docs").select("id", "batch_no")
    return store.inserted(docs.where("batch_no < 12"), docs.where("batch_no = 12"), "id").select("id")


@query("SELECT o.id AS org_id, count(DISTINCT d.id) AS docs FROM orgs o JOIN (SELECT DISTINCT id, org_id FROM corpus_docs WHERE org_id IS NOT NULL) d ON d.org_id = o.id OR d.org_id = 'global' GROUP BY o.id")
def corpus_visibility(spark, d):
    """How many documents each organisation sees: its own and the shared ones."""
    docs = table(spark, d, "corpus_docs").where("org_id is not null").groupBy("id", "org_id").agg(F.lit(1).alias("one"))
    shared = docs.where("org_id = 'global'").agg(F.countDistinct("id").alias("n"))
    # An id that is shared and an organisation's own counts once: its own rows are counted where the id is not shared.
    own = docs.where("org_id <> 'global'").join(docs.where("org_id = 'global'").select("id"), "id", "left_anti").groupBy("org_id").agg(F.countDistinct("id").alias("own"))
    orgs = table(spark, d, "orgs").select(F.col("id").alias("org_id"))
    return spark.sql("SELECT org_id, coalesce(own, 0) + (SELECT n FROM {shared}) AS docs FROM {seen} WHERE coalesce(own, 0) + (SELECT n FROM {shared}) > 0", shared=shared, seen=orgs.join(own, "org_id", "left"))


@query("SELECT id, sha256(id) AS key_hash, substr('vk_' || id, 1, 12) AS key_prefix FROM orgs")
def key_hashes(spark, d):
    return table(spark, d, "orgs").select("id", F.sha2("id", 256).alias("key_hash"), F.substring(F.concat(F.lit("vk_"), "id"), 1, 12).alias("key_prefix"))


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(coalesce(title, '')) || '|' || lower(coalesce(url, '')) ORDER BY created_at NULLS LAST, id, batch_no) AS r FROM corpus_docs) WHERE r = 1")
def live_dedupe(spark, d):
    """The first document of each title and address."""
    docs = table(spark, d, "corpus_docs").withColumn("k", F.concat_ws("|", F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("url", F.lit("")))))
    by = Window.partitionBy("k").orderBy(F.col("created_at").asc_nulls_last(), "id", "batch_no")
    return docs.withColumn("r", F.row_number().over(by)).where("r = 1").select("id")


@query(
    f"""WITH {CORPUS}, t AS (SELECT doc_id, sent_idx, sentence, {d_tokens('sentence')} AS t FROM corpus WHERE length(sentence) BETWEEN 70 AND 260),
    k AS (SELECT doc_id, sent_idx, sentence, {d_rounded("len(list_distinct(t)) / len(t) - len(regexp_extract_all(sentence, '[0-9]')) / length(sentence)", 6)} AS score FROM t WHERE len(t) >= 12)
    SELECT doc_id, rank, sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_idx) AS rank FROM k) WHERE rank <= 4"""
)
def query_sentences(spark, d):
    """The four most telling sentences of each document."""
    t = similarity.corpus_sentences(table(spark, d, "corpus_docs")).where(F.length("sentence").between(70, 260)).withColumn("t", text.tokens(F.col("sentence"))).where(F.size("t") >= 12)
    score = text.rounded(stylometry.diversity(F.col("t")) - F.regexp_count("sentence", F.lit("[0-9]")) / F.length("sentence"), 6)
    return store.newest_per(t.withColumn("score", score), "doc_id", 4, F.desc("score"), F.col("sent_idx")).select("doc_id", "rank", "sentence", "score")


@query("SELECT org_id, job_id, rank FROM (SELECT org_id, job_id, row_number() OVER (PARTITION BY org_id ORDER BY seq DESC) AS rank FROM (SELECT org_id, job_id, max(seq) AS seq FROM jobs WHERE status = 'complete' AND org_id IS NOT NULL AND job_id IS NOT NULL GROUP BY org_id, job_id)) WHERE rank <= 250")
def cross_submission_corpus(spark, d):
    """The newest finished jobs of each organisation: what later scans are compared with as well."""
    done = table(spark, d, "jobs").where("status = 'complete' and org_id is not null and job_id is not null").groupBy("org_id", "job_id").agg(F.max("seq").alias("seq"))
    return store.newest_per(done, "org_id", 250, F.desc("seq")).select("org_id", "job_id", "rank")


@query("SELECT time_bucket(INTERVAL '60 seconds', ts) AS window_start, user_id, count(*) AS requests, count(*) > 3 AS limited FROM events GROUP BY 1, 2")
def ip_rate_windows(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "60 seconds").alias("w"), "user_id").agg(F.count("*").alias("requests"))
    return w.select(F.col("w.start").alias("window_start"), "user_id", "requests", (F.col("requests") > 3).alias("limited"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    w AS (SELECT user_id, event_id, r, t AS start, 1 AS used FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN e.t > w.start + 3600 THEN e.t ELSE w.start END, CASE WHEN e.t > w.start + 3600 THEN 1 ELSE w.used + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
    SELECT user_id, event_id, used <= 20 AS allowed FROM w"""
)
def rate_limit(spark, d):
    """Requests allowed and denied by the per-user limiter whose window begins at the first request."""
    from quillmesh.streaming.limiter import limited

    return limited(table(spark, d, "events"), "user_id", "ts", "event_id", most=20, seconds=3600)
