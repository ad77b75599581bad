"""The retrieval queries in DuckDB SQL, written apart from the engine: the stemmer is a ladder of CTEs."""

from __future__ import annotations

# Fixed values, stated here once more, so that a wrong one in the engine shows.
_STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot
could couldn't did didn't do does doesn't doing don't down during each few for from further get got had hadn't has hasn't have haven't
having he her here hers herself him himself his how i if in into is isn't it its itself just let's me might more most mustn't my myself no
nor not of off on once only or other ought our ours ourselves out over own same shan't she should shouldn't so some such than that the
their theirs them themselves then there these they this those through to too under until up us very was wasn't we were weren't what when
where which while who whom why will with won't would wouldn't you your yours yourself yourselves
""".split()
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = [(e, "") for e in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()]
_STOP = ", ".join("('" + w.replace("'", "''") + "')" for w in _STOPWORDS)
_MASK = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace({w}, '[^aeiouy]', 'C', 'g'), 'aeiou', 'VVVVV'), '^y', 'C'), 'Vy', 'VC', 'g'), 'yy', 'VC', 'g'), 'y', 'V', 'g')"


def _m(cut: int) -> str:
    return f"len(regexp_extract_all(substr(m, 1, len(w) - {cut}), 'CV'))"


def _vowel(cut: int) -> str:
    return f"contains(substr(m, 1, len(w) - {cut}), 'V')"


def _rung(name: str, before: str, expr: str, extra: str = "") -> str:
    return f"{name}_ AS (SELECT token, w, {_MASK.format(w='w')} AS m{', dropped' if extra == 'use' else ''} FROM {before}),\n{name} AS (SELECT token, {expr} AS w{', ' + extra if extra not in ('', 'use') else ''} FROM {name}_)"


def _suffixes(table: list[tuple[str, str]], least: int) -> str:
    pairs = sorted(table, key=lambda x: -len(x[0]))  # the longest ending that fits
    cases = " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {_m(len(e))} > {least} THEN left(w, len(w) - {len(e)}) || '{to}' ELSE w END" for e, to in pairs)
    return f"CASE WHEN len(w) < 3 THEN w {cases} ELSE w END"


_ED = f"ends_with(w, 'ed') AND NOT ends_with(w, 'eed') AND {_vowel(2)}"
_ING = f"ends_with(w, 'ing') AND {_vowel(3)}"
_CVC = "(len(w) >= 3 AND ends_with(m, 'CVC') AND right(w, 1) NOT IN ('w', 'x', 'y'))"
_STEMS = ",\n".join([
    "s0 AS (SELECT DISTINCT token, token AS w FROM tokens WHERE len(token) > 2)",
    _rung("s1", "s0", "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, len(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, len(w) - 1) ELSE w END"),
    _rung("s2", "s1", f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m(3)} > 0 THEN left(w, len(w) - 1) ELSE w END WHEN {_ED} THEN left(w, len(w) - 2) WHEN {_ING} THEN left(w, len(w) - 3) ELSE w END", f"(({_ED}) OR ({_ING})) AS dropped"),
    _rung("s3", "s2", f"CASE WHEN NOT dropped THEN w WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN w || 'e' WHEN len(w) > 1 AND right(w, 1) = substr(w, len(w) - 1, 1) AND ends_with(m, 'C') THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE left(w, len(w) - 1) END WHEN {_m(0)} = 1 AND {_CVC} THEN w || 'e' ELSE w END", "use"),
    _rung("s4", "s3", f"CASE WHEN len(w) > 1 AND ends_with(w, 'y') AND {_vowel(1)} THEN left(w, len(w) - 1) || 'i' ELSE w END"),
    _rung("s5", "s4", _suffixes(_STEP2, 0)),
    _rung("s6", "s5", _suffixes(_STEP3, 0)),
    _rung("s7", "s6", _suffixes(_STEP4, 1)),
    _rung("s8", "s7", f"CASE WHEN ends_with(w, 'e') AND ({_m(1)} > 1 OR ({_m(1)} = 1 AND NOT (len(w) > 2 AND substr(m, len(w) - 2, 2) = 'CV') AND NOT (len(w) > 3 AND substr(m, len(w) - 3, 3) = 'CVC' AND substr(w, len(w) - 1, 1) NOT IN ('w', 'x', 'y')))) THEN left(w, len(w) - 1) ELSE w END"),
    _rung("s9", "s8", f"CASE WHEN ends_with(w, 'll') AND {_m(0)} > 1 THEN left(w, len(w) - 1) ELSE w END"),
    "stems AS (SELECT token, w AS stem FROM s9 UNION ALL SELECT DISTINCT token, token FROM tokens WHERE len(token) <= 2)",
])

#: Tokens of the documents table, whose key is its title: tokens (doc_id, position, token).
TOKENS = f"""WITH stop(word) AS (VALUES {_STOP}),
corpus AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS title, CAST(doc_id AS VARCHAR) || ' ' || text AS body FROM documents WHERE coalesce(text, '') <> ''),
lists AS (SELECT doc_id, regexp_extract_all(body, '[A-Za-z0-9]+') AS l FROM corpus),
tokens AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS position, lower(unnest(l)) AS token FROM lists)"""
STEMS = f"{TOKENS},\n{_STEMS}"
#: The index: postings (term, doc_id, tf), docs, stats, terms.
INDEX = f"""{STEMS},
kept AS (SELECT doc_id, position, t.token, stem AS term FROM tokens t JOIN stems s ON t.token = s.token
  WHERE t.token NOT IN (SELECT word FROM stop) AND NOT regexp_full_match(t.token, '[0-9]{{1,3}}')),
postings AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(position AS VARCHAR), ' ' ORDER BY position) AS positions FROM kept GROUP BY term, doc_id),
docs AS (SELECT c.doc_id, c.title, CAST(coalesce(sum(tf), 0) AS INTEGER) AS length FROM corpus c LEFT JOIN postings p ON p.doc_id = c.doc_id GROUP BY ALL),
stats AS (SELECT count(*) AS num_docs, avg(length) AS avg_doc_length FROM docs),
terms AS (SELECT term, count(*) AS df, ln((any_value(num_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM postings, stats GROUP BY term)"""


def scored(weights: dict[str, int], k1: float = 1.2, b: float = 0.75) -> str:
    """CTE `scores` (doc_id, score) of all documents that hold one of the words."""
    rows = ", ".join(f"('{t}', {n})" for t, n in weights.items())
    return f"""{INDEX},
words(term, times) AS (VALUES {rows}),
scores AS (SELECT p.doc_id, sum(w.times * t.idf * p.tf * ({k1} + 1) / (p.tf + {k1} * (1 - {b}) + {k1} * {b} * d.length / greatest(s.avg_doc_length, 1.0)) ORDER BY w.term) AS score
  FROM postings p JOIN words w ON w.term = p.term JOIN terms t ON t.term = p.term JOIN docs d ON d.doc_id = p.doc_id, stats s GROUP BY p.doc_id)"""


def has(term: str) -> str:
    return f"(SELECT doc_id FROM postings WHERE term = '{term}')"


def phrase(*terms: str) -> str:
    joins = " ".join(f"JOIN kept k{i} ON k{i}.doc_id = k0.doc_id AND k{i}.position = k0.position + {i} AND k{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"(SELECT DISTINCT k0.doc_id FROM kept k0 {joins} WHERE k0.term = '{terms[0]}')"


def ranked(weights: dict[str, int], candidates: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> str:
    return f"""{scored(weights, k1, b)},
best AS (SELECT doc_id, score AS raw FROM scores WHERE doc_id IN {candidates} AND score > 0)
SELECT CAST(row_number() OVER (ORDER BY raw DESC, b.doc_id) AS INTEGER) AS rank, b.doc_id, round(raw, 6) AS score, title FROM best b JOIN docs d ON d.doc_id = b.doc_id
QUALIFY row_number() OVER (ORDER BY raw DESC, b.doc_id) <= {k}"""
