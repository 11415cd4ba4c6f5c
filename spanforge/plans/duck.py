"""SQL fragments for the twins of the queries, in DuckDB's dialect."""

from __future__ import annotations

from spanforge.functions.text import BLANK_CHAR, LINE_END, PATH_NOISE, STOPWORDS

_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
STOP = _quoted(STOPWORDS)
NOISE = _quoted(PATH_NOISE)


def stem(w: str) -> str:
    base = lambda k: f"left({w}, length({w}) - {k})"
    e = lambda k: f"CASE WHEN {base(k)} LIKE '%at' OR {base(k)} LIKE '%iz' THEN {base(k)} || 'e' ELSE {base(k)} END"
    return f"""CASE WHEN length({w}) <= 3 THEN {w}
      WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN {base(3)} || 'y'
      WHEN regexp_matches({w}, '[shxz]es$') THEN {base(2)}
      WHEN regexp_matches({w}, '[^s]s$') THEN {base(1)}
      WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN {e(3)}
      WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN {e(2)}
      WHEN {w} LIKE '%tion' AND length({w}) > 5 THEN {base(4)} || 'te' ELSE {w} END"""


def camel(w: str) -> str:
    """The parts of a word, the look-ahead written out as cuts."""
    return (
        rf"regexp_extract_all(regexp_replace(regexp_replace({w}, '[A-Z]+_', '_', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'),"
        r" '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    )


def parts(w: str) -> str:
    kept = lambda xs: f"[lower(p) FOR p IN {xs} IF length(p) > 1 AND lower(p) NOT IN ({STOP})]"
    return (
        f"list_concat([lower({w})], list_concat(CASE WHEN contains({w}, '_') THEN {kept(f'''string_split({w}, '_')''')} ELSE []::VARCHAR[] END,"
        f" CASE WHEN len({camel(w)}) > 1 THEN {kept(camel(w))} ELSE []::VARCHAR[] END))"
    )


def tokens(source: str, key: str, text: str, weight: int = 1, where: str = "length(w) > 1") -> str:
    """key, term, weight rows of the words of ``text`` in ``source``, stems included. Distinct
    words are split once."""
    return f"""(
      WITH ws AS (SELECT {key}, unnest(regexp_extract_all(coalesce({text}, ''), '[a-zA-Z0-9_]+')) AS w FROM {source}),
      wc AS (SELECT {key}, w, count(*) AS c FROM ws WHERE {where} GROUP BY ALL),
      vocab AS (SELECT w, unnest({parts('w')}) AS sp FROM (SELECT DISTINCT w FROM wc)),
      kept AS (SELECT w, sp, {stem('sp')} AS st FROM vocab WHERE length(sp) > 1 AND sp NOT IN ({STOP})),
      tv AS (SELECT w, sp AS term FROM kept UNION ALL SELECT w, st FROM kept WHERE st <> sp)
      SELECT {key}, term, c * {weight} AS weight FROM wc JOIN tv USING (w))"""


NORMAL = r"regexp_replace(text, '\r\n?', chr(10), 'g')"

DOCS = f"(SELECT doc_id, file_path, {NORMAL} AS text, source, lang FROM documents)"

#: chunks in force with their text: spans count the characters as they are stored, newlines are
#: normalised after the cut; line_first is where a span begins in the normalised text
CHUNKS = rf"""(
  SELECT chunk_id, doc_id, file_path, first, last, regexp_replace(substr(t, first + 1, last - first), '\r\n?', chr(10), 'g') AS text,
         first - length(substr(t, 1, first + 1)) + length(replace(substr(t, 1, first + 1), chr(13) || chr(10), chr(10))) AS line_first
  FROM (SELECT c.chunk_id, c.doc_id, c.file_path, c.first_character_index AS first, c.last_character_index AS last, d.text AS t
        FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunked_at DESC, doc_id DESC, file_path DESC, first_character_index DESC, last_character_index DESC) AS rn
              FROM chunks WHERE last_character_index > first_character_index AND first_character_index >= 0) c
        JOIN documents d USING (doc_id) WHERE c.rn = 1 AND c.last_character_index <= length(d.text)))"""

QUESTIONS = """(SELECT question_id, question, answer, sources FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY asked_at DESC, question) AS rn
  FROM questions WHERE question_id IS NOT NULL) WHERE rn = 1)"""

LINES = f"""(
  SELECT doc_id, n, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start
  FROM (SELECT doc_id, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no
        FROM (SELECT doc_id, string_split_regex(text, '{LINE_END}') AS l FROM {DOCS} WHERE text IS NOT NULL)))"""

_HEADER = rf"^(#{{1,6}}){BLANK_CHAR}+([\s\S]*)$"

HEADERS = rf"""(
  SELECT doc_id, line_start AS "offset", length(regexp_extract(e, '{_HEADER}', 1)) AS level,
         regexp_replace(regexp_extract(e, '{_HEADER}', 2), '^{BLANK_CHAR}+|{BLANK_CHAR}+$', '', 'g') AS title
  FROM (SELECT *, CASE WHEN line_no < n - 1 THEN line || chr(10) ELSE line END AS e FROM {LINES}) WHERE regexp_matches(e, '{_HEADER}'))"""

CONTEXT = f"""(
  SELECT chunk_id, string_agg(title, ' ' ORDER BY "offset") AS context FROM (
    SELECT c.chunk_id, h."offset", h.title, row_number() OVER (PARTITION BY c.chunk_id ORDER BY h."offset" DESC) AS rn
    FROM {CHUNKS} c JOIN {HEADERS} h ON h.doc_id = c.doc_id AND h."offset" <= c.line_first
    WHERE c.file_path LIKE '%.md' OR c.file_path LIKE '%.txt') WHERE rn <= 2 GROUP BY chunk_id)"""

COUNTS = f"""(
  SELECT chunk_id, term, sum(weight)::BIGINT AS tf FROM (
    SELECT * FROM {tokens(CHUNKS, 'chunk_id', 'text')}
    UNION ALL SELECT * FROM {tokens(CHUNKS, 'chunk_id', 'file_path', 2, f"lower(w) NOT IN ({NOISE})")}
    UNION ALL SELECT * FROM {tokens(CONTEXT, 'chunk_id', 'context', 2)}) GROUP BY ALL)"""

def query_terms(questions: str = QUESTIONS) -> str:
    """question_id, term, pos of the distinct terms of questions (question_id, question)."""
    return rf"""(
  SELECT question_id, term, min(pos) AS pos FROM (
    SELECT question_id, term, row_number() OVER (PARTITION BY question_id ORDER BY wi, pi, si) - 1 AS pos FROM (
      SELECT question_id, wi, pi, unnest(CASE WHEN st <> sp THEN [sp, st] ELSE [sp] END) AS term, generate_subscripts(CASE WHEN st <> sp THEN [sp, st] ELSE [sp] END, 1) AS si FROM (
        SELECT *, {stem('sp')} AS st FROM (
          SELECT question_id, wi, unnest(ps) AS sp, generate_subscripts(ps, 1) AS pi FROM (
            SELECT question_id, wi, {parts('w')} AS ps FROM (
              SELECT question_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS wi FROM (SELECT question_id, regexp_extract_all(coalesce(question, ''), '[a-zA-Z0-9_]+') AS ws FROM {questions})) WHERE length(w) > 1))
        WHERE length(sp) > 1 AND sp NOT IN ({STOP})))) GROUP BY ALL)"""


def bm25(k1: float = 1.2, b: float = 0.75, typed: str | None = None, questions: str = QUESTIONS) -> str:
    """question_id, chunk_id, score, first_pos of every hit."""
    boost = "1.0"
    if typed == "docs":
        boost = "CASE WHEN c.file_path LIKE '%.md' OR c.file_path LIKE '%.txt' OR c.file_path LIKE '%/docs/%' THEN 1.3 ELSE 1.0 END"
    elif typed == "code":
        boost = "CASE WHEN c.file_path LIKE '%.py' THEN 1.3 ELSE 1.0 END"
    return f"""(
      WITH tc AS MATERIALIZED (SELECT * FROM {COUNTS}), ch AS MATERIALIZED (SELECT chunk_id, file_path FROM {CHUNKS}),
      dl AS (SELECT ch.chunk_id, coalesce(sum(tf), 0) AS len FROM ch LEFT JOIN tc USING (chunk_id) GROUP BY ALL),
      cs AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
      ts AS (SELECT term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(*) AS df FROM tc GROUP BY term), cs)
      SELECT question_id, chunk_id, round(sum(idf * (tf * ({k1}::DOUBLE + 1)) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * (len / avgdl)))) * any_value({boost}::DOUBLE), 9) AS score, min(pos) AS first_pos
      FROM {query_terms(questions)} q JOIN ts USING (term) JOIN tc USING (term) JOIN dl USING (chunk_id) JOIN ch c USING (chunk_id), cs GROUP BY ALL)"""


def bm25_top(k: int, **kw) -> str:
    return f"""(SELECT question_id, chunk_id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_pos, chunk_id)::INT AS rank FROM {bm25(**kw)}) WHERE rank <= {k})"""


VECTORS = """(
  SELECT vec_id AS chunk_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS e FROM (
    SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM (
      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY encoded_at DESC) AS rn FROM (SELECT DISTINCT vec_id, embedding, encoded_at FROM chunk_vectors)
      WHERE embedding IS NOT NULL AND len(embedding) = 384 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0) WHERE rn = 1))"""

#: the latest usable vector of each chunk
CHUNK_VECTORS = """(
  SELECT chunk_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS e FROM (
    SELECT chunk_id, [x::DOUBLE FOR x IN embedding] AS e FROM (
      SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY encoded_at DESC, vec_id DESC) AS rn FROM (SELECT DISTINCT vec_id, chunk_id, embedding, encoded_at FROM chunk_vectors)
      WHERE chunk_id IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 384 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0) WHERE rn = 1))"""
