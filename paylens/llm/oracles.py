"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from paylens.functions.numeric import sql_round
from paylens.llm import licenses

_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MINHASH = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 4], ' ') END AS s
       FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) r(k) WHERE len(w) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
comp AS (SELECT x AS doc_id, MIN(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp c USING (doc_id)"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x AS vec_id, MIN(y) AS component_id FROM reach GROUP BY x),
deg AS (SELECT x AS vec_id, COUNT(*) AS n FROM links GROUP BY x)
SELECT vec_id, COALESCE(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN deg USING (vec_id)"""


def _count(chars: str) -> str:
    return f"length(regexp_replace(text, '[^{chars}]', '', 'g'))"


_RATIOS = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
           "echo_ratio": ("n_echoes", "n_words"), "upper_ratio": ("n_upper", "word_chars"),
           "mark_ratio": ("n_marks", "word_chars"), "word_length": ("word_chars", "n_words")}


def _at(ranks: dict[str, float], source: str, by: str) -> str:
    """Values at ranks of the merged sketches of ``source``."""
    picked = ", ".join(f"MIN(CASE WHEN upto >= ceil(total * {q}) THEN v END) AS {name}" for name, q in ranks.items())
    return f"""(SELECT {by}, MAX(total) AS total, {picked} FROM (
      SELECT {by}, CASE WHEN bucket IS NULL THEN 0.0 ELSE 1e-6 * pow(1.02, bucket - 0.5) END AS v,
             SUM(n) OVER (PARTITION BY {by} ORDER BY bucket NULLS FIRST) AS upto, SUM(n) OVER (PARTITION BY {by}) AS total
      FROM (SELECT {by}, bucket, SUM(n) AS n FROM {source} GROUP BY {by}, bucket) s) r GROUP BY {by})"""


_AT = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9}
_PICK = ", ".join(f"CASE WHEN o.total >= 100 THEN o.{q} WHEN l.total >= 100 THEN l.{q} ELSE e.{q} END AS {q}" for q in _AT)
_LIMITS = ", ".join([f"MAX(CASE WHEN ratio = '{r}' THEN q3 + reach END) AS {r}_max" for r in _RATIOS]
                    + ["MAX(CASE WHEN ratio = 'word_length' THEN q1 - reach END) AS word_length_min"])
_OUT = " OR ".join([f"COALESCE(({k} - 2 * sqrt({k})) / greatest({n}, 1) > {r}_max, FALSE)" for r, (k, n) in _RATIOS.items()]
                   + ["COALESCE((word_chars + 2 * sqrt(word_chars)) / greatest(n_words, 1) < word_length_min, FALSE)"])

QUALITY = f"""
WITH d AS (SELECT doc_id, lang, source, COALESCE(text, '') AS text,
                  regexp_extract_all(COALESCE(text, ''), {_WORD}) AS w FROM documents),
lines AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) l
          WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id),
win AS (SELECT doc_id, k, COUNT(*) OVER (PARTITION BY doc_id, array_to_string(w[k:k + 4], ' ')) AS times
        FROM d, unnest(range(1, len(w) - 3)) r(k)),
rep AS (SELECT doc_id, COUNT(DISTINCT k + j) AS n_repeat_words FROM win, range(0, 5) o(j) WHERE times > 1 GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w) AS n_words,
             CAST(COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             {_count('#*$%&|<>')} AS n_symbols, COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words,
             COALESCE(n_lines, 0) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS n_echoes,
             {_count('A-Z')} AS n_upper, {_count('!?')} AS n_marks
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {k} / greatest({n}, 1) AS v FROM b WHERE NOT base_failed" for r, (k, n) in _RATIOS.items())}),
sk AS (SELECT lang, source, ratio, CASE WHEN v >= 1e-6 THEN CAST(ceil(ln(v / 1e-6) / 0.01980262729617973) AS INTEGER) END AS bucket,
              COUNT(*) AS n FROM long GROUP BY ALL),
positive AS (SELECT * FROM sk WHERE bucket IS NOT NULL),
f AS (SELECT o.lang, o.source, o.ratio, {_PICK}, COALESCE(ls.usual, es.usual) AS usual
      FROM {_at(_AT, "sk", "lang, source, ratio")} o
      JOIN {_at(_AT, "sk", "lang, ratio")} l ON o.lang IS NOT DISTINCT FROM l.lang AND o.ratio = l.ratio
      JOIN {_at(_AT, "sk", "ratio")} e ON o.ratio = e.ratio
      LEFT JOIN {_at({"usual": 0.25}, "positive", "lang, ratio")} ls ON o.lang IS NOT DISTINCT FROM ls.lang AND o.ratio = ls.ratio
      LEFT JOIN {_at({"usual": 0.25}, "positive", "ratio")} es ON o.ratio = es.ratio),
g AS (SELECT *, CASE WHEN q3 > q1 THEN 3.0::DOUBLE * (q3 - q1) WHEN q9 > q2 THEN 3.0::DOUBLE * (q9 - q2) ELSE 0.25::DOUBLE * usual END AS reach FROM f),
t AS (SELECT lang, source, {_LIMITS} FROM g GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_OUT}) AS kept,
       {", ".join(f"{sql_round(x, 6)} AS {x}" for x in [f"{r}_max" for r in _RATIOS] + ["word_length_min"])}
FROM b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source"""

_TEMPLATES = ", ".join(f"('{name}', {i}, '{text.lower()}')" for name, texts in sorted(licenses.TEMPLATES.items())
                       for i, text in enumerate(texts))
_TERM = r"'[a-z0-9\x{80}-\x{10FFFF}]+'"

LICENSES = rf"""
WITH tpl AS (SELECT name, i, term, COUNT(*) AS tf FROM (
    SELECT name, i, unnest(regexp_extract_all(text, {_TERM})) AS term FROM (VALUES {_TEMPLATES}) v(name, i, text)) x GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM tpl),
lines AS (SELECT doc_id, no, translate(l[no], '{_UPPER}', '{_LOWER}') AS line, len(l) AS lines FROM (
    SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS l FROM documents) x, unnest(range(1, len(l) + 1)) r(no)),
tf AS (SELECT doc_id, no, term, COUNT(*) AS tf FROM (
    SELECT doc_id, no, unnest(regexp_extract_all(line, {_TERM})) AS term FROM lines) x GROUP BY ALL),
n AS (SELECT COUNT(*) AS n FROM documents),
df AS (SELECT term, COUNT(DISTINCT doc_id) AS df FROM tf JOIN vocabulary USING (term) GROUP BY term),
idf AS (SELECT term, ln((1 + n.n) / (1 + COALESCE(df, 0))) + 1 AS idf FROM vocabulary LEFT JOIN df USING (term), n),
norm AS (SELECT doc_id, no, sqrt(SUM(power(tf * COALESCE(idf, ln(1 + n.n) + 1), 2))) AS norm FROM tf LEFT JOIN idf USING (term), n GROUP BY ALL),
tnorm AS (SELECT name, i, sqrt(SUM(power(tf * idf, 2))) AS norm FROM tpl JOIN idf USING (term) GROUP BY ALL),
dot AS (SELECT doc_id, no, name, i, SUM(tf.tf * tpl.tf * idf * idf) AS dot FROM tf JOIN tpl USING (term) JOIN idf USING (term) GROUP BY ALL),
score AS (SELECT doc_id, no, name, round(dot / (norm.norm * tnorm.norm), 9) AS score
          FROM dot JOIN norm USING (doc_id, no) JOIN tnorm USING (name, i)),
best AS (SELECT doc_id, name, least(score, 1.0) AS score, no FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, no, name) AS rn FROM score WHERE score >= {licenses.COSINE}) x WHERE rn = 1),
f AS (SELECT d.doc_id, COALESCE(source, '_') || '/' || COALESCE(lang, '_') || '/' || CAST(d.doc_id // 1000 AS VARCHAR) AS dir,
             name AS own_license, score AS own_score, no AS line, len(string_split(COALESCE(text, ''), chr(10))) AS lines
      FROM documents d LEFT JOIN best USING (doc_id)),
given AS (SELECT dir, max(struct_pack(s := own_score, l := own_license)).l AS given FROM f
          WHERE lines <= {licenses.NOTICE_LINES} AND (line = 1 OR line = lines) GROUP BY dir),
above AS (SELECT dir, unnest([dir, regexp_replace(dir, '/[^/]*$', ''), regexp_replace(dir, '/[^/]*/[^/]*$', ''), '']) AS up
          FROM (SELECT DISTINCT dir FROM f) x),
near AS (SELECT a.dir, max(struct_pack(d := length(up), u := up, g := given)) AS best FROM above a JOIN given g ON g.dir = a.up GROUP BY a.dir)
SELECT doc_id, f.dir || '/' || CAST(doc_id AS VARCHAR) AS path, own_license, own_score, line, lines,
       COALESCE(own_license, near.best.g) AS license, CASE WHEN own_license IS NULL THEN near.best.u END AS inherited_from
FROM f LEFT JOIN near USING (dir)"""
