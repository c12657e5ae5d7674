"""SQL that gives the same rows as those queries of the nine problems that SQL can express."""

from __future__ import annotations

import re

from quillmesh.llm import lookalike

_ESCAPE = re.compile(r"\\u([0-9A-F]{4})")


def _re2(pattern: str) -> str:
    return _ESCAPE.sub(lambda m: rf"\x{{{m[1]}}}", pattern)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def look(x: str) -> str:
    """The look of a text, composed: canonically equivalent spellings become equal strings."""
    pictograph, joining, virama = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]", r"[\x{0620}-\x{064A}\x{066E}-\x{06D3}]", r"[\x{094D}\x{09CD}\x{0D4D}]"
    x = f"regexp_replace({x}, '{_re2(lookalike.SPACES)}', ' ', 'g')"
    for _ in range(2):  # neighbours share a pictograph
        x = f"regexp_replace({x}, '({pictograph}\\x{{FE0F}}?)\\x{{200D}}({pictograph})', '\\1{lookalike.SEEN_ZWJ}\\2', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '({virama})\\x{{200D}}', '\\1{lookalike.SEEN_ZWJ}', 'g'), '({joining})\\x{{200C}}({joining})', '\\1{lookalike.SEEN_ZWNJ}\\2', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '({virama})\\x{{200C}}', '\\1{lookalike.SEEN_ZWNJ}', 'g'), '{_re2(lookalike.UNSEEN)}', '', 'g')"
    x = f"translate({x}, {_q(''.join(lookalike.ONE_TO_ONE))}, {_q(''.join(lookalike.ONE_TO_ONE.values()))})"
    for of, to in lookalike.LIGATURES.items():
        x = f"replace({x}, '{of}', '{to}')"
    return f"nfc_normalize({x})"


P1 = f"""WITH r AS (SELECT DISTINCT sent_id AS k, text AS t FROM sentences WHERE sent_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT k, t, {look('t')} AS l FROM r), e AS (SELECT l, t, min(k) AS a, max(k) AS b FROM l GROUP BY l, t),
p AS (SELECT x.k AS x, e.a AS y FROM l x JOIN e ON x.l = e.l AND x.t <> e.t UNION SELECT x.k, e.b FROM l x JOIN e ON x.l = e.l AND x.t <> e.t)
SELECT DISTINCT 'sentence' AS src, least(x, y) AS key_a, greatest(x, y) AS key_b FROM p WHERE x <> y
UNION ALL SELECT DISTINCT 'flag', f.flag_id, n.type_id FROM obfuscation_flags f JOIN flag_types n ON trim({look('f.type')}) = trim({look('n.type')}) AND f.type <> n.type"""

P2 = """WITH v AS (SELECT vec_id, min(embedding) AS e FROM sentence_vectors WHERE len(embedding) = 96 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS c FROM v a, v b WHERE a.vec_id <> b.vec_id),
r AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(c, 6) DESC, y) AS r FROM s WHERE c >= 0.80 - 1e-7) WHERE r <= 5)
SELECT DISTINCT least(x, y) AS vec_a, greatest(x, y) AS vec_b FROM r"""

P3 = """WITH r AS (SELECT id AS k, content AS t FROM corpus_docs WHERE id IS NOT NULL AND content IS NOT NULL UNION SELECT sent_id, text FROM sentences WHERE sent_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT k, t, i, substring(t, i + 1, 100) AS p FROM (SELECT k, t, unnest(range(0, length(t) - 99)) AS i FROM r WHERE length(t) >= 100)),
s AS (SELECT p FROM w GROUP BY p HAVING min(k) <> max(k)), h AS (SELECT k, t, i FROM w JOIN s ON w.p = s.p),
g AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY k, t ORDER BY i) + 100 THEN 1 ELSE 0 END AS n FROM h),
z AS (SELECT *, sum(n) OVER (PARTITION BY k, t ORDER BY i) AS part FROM g)
SELECT DISTINCT k AS rec_key, min(i)::INT AS start_pos, (max(i) + 100)::INT AS end_pos FROM z GROUP BY k, t, part"""


def _words(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '')"


P8 = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.g = iw.g"""

ORACLES = {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p8_found": P8}
