"""DuckDB SQL fragments used by the oracle queries.

These restate each operator's semantics in plain SQL (brute force where that
is simplest) so the Spark result can be checked value by value.
"""

from __future__ import annotations

from lectern.functions.text import WS_CLASS_RE2
from lectern.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE


def clean_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS_CLASS_RE2}+', ' ', 'g'))"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS_CLASS_RE2}+|{WS_CLASS_RE2}+$', '', 'g')"


def _width(start: str, size: int) -> str:
    # length of the window's prefix up to and including its last '.'
    upto = f"length(regexp_extract(substr(t, {start} + 1, {size}), '(?s)^.*\\.'))"
    return (f"CASE WHEN {start} + {size} < n AND {upto} - 1 > {size // 2} "
            f"THEN {upto} ELSE {size} END")


def chunks_cte(source: str, key: str = "doc_id", text: str = "text",
               size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               name: str = "chunks") -> str:
    """Recursive CTE ``name(key, chunk_id, text, start_char, end_char, total_chunks)``.

    Must be placed after ``WITH RECURSIVE``.
    """
    nxt = f"(s + w - {overlap})"
    return f"""
_clean AS (
  SELECT k, t, length(t) AS n
  FROM (SELECT {key} AS k, {clean_sql(text)} AS t FROM {source})
),
_walk(k, t, n, chunk_id, s, w) AS (
  SELECT k, t, n, 0, 0, {_width('0', size)} FROM _clean WHERE n > 0
  UNION ALL
  SELECT k, t, n, chunk_id + 1, {nxt}, {_width(nxt, size)} FROM _walk WHERE {nxt} < n
),
{name} AS (
  SELECT k AS {key}, CAST(chunk_id AS INTEGER) AS chunk_id,
         trim(substr(t, s + 1, w)) AS text,
         CAST(s AS INTEGER) AS start_char, CAST(s + w AS INTEGER) AS end_char,
         CAST(count(*) OVER (PARTITION BY k) AS INTEGER) AS total_chunks
  FROM _walk
)"""


def hash_terms_sql(source: str, ids: str, text: str, dim: int) -> str:
    """Sparse hash-embedding rows ``(ids…, b, w)`` of ``text`` per row of ``source``."""
    return f"""
  SELECT {ids}, b, count(*) AS w FROM (
    SELECT {ids}, CAST(('0x' || substr(md5(lower(tok)), 1, 8))::BIGINT % {dim} AS INTEGER) AS b
    FROM (SELECT {ids}, unnest(regexp_extract_all({text}, '[A-Za-z0-9]+')) AS tok FROM {source})
  ) GROUP BY ALL"""


def user_questions_sql() -> str:
    return f"""
  SELECT conv_id || ':' || turn AS query_id, {strip_sql('text')} AS question,
         CAST(NULL AS BIGINT) AS doc_id, 5 AS top_k
  FROM conversations
  WHERE role = 'user' AND length({strip_sql('text')}) > 0"""


def search_sql(questions: str, dim: int, min_chars: int = 20, model_chars: int = 30000) -> str:
    """Brute-force P1: every valid question against every kept chunk.

    Defines CTEs ``kept``, ``q`` and ``hits(query_id, rank, doc_id, chunk_id, text, score)``.
    Must follow the chunk CTE.
    """
    return f""",
kept AS (SELECT doc_id, chunk_id, text FROM chunks WHERE length(text) >= {min_chars}),
q AS ({questions}),
cterm AS ({hash_terms_sql('kept', 'doc_id, chunk_id', f'substr(text, 1, {model_chars})', dim)}),
qterm AS ({hash_terms_sql('q', 'query_id', 'question', dim)}),
cn AS (SELECT doc_id, chunk_id, sum(w * w) AS n2 FROM cterm GROUP BY ALL),
qn AS (SELECT query_id, sum(w * w) AS n2 FROM qterm GROUP BY ALL),
dots AS (
  SELECT query_id, doc_id, chunk_id, sum(qterm.w * cterm.w) AS dot
  FROM qterm JOIN cterm USING (b) GROUP BY ALL
),
pairs AS (
  SELECT q.query_id, q.top_k, k.doc_id, k.chunk_id, k.text,
         coalesce(d.dot, 0) AS dot, coalesce(qn.n2, 0) AS qn2, coalesce(cn.n2, 0) AS cn2
  FROM q JOIN kept k ON q.doc_id IS NULL OR q.doc_id = k.doc_id
  LEFT JOIN qn ON qn.query_id = q.query_id
  LEFT JOIN cn ON cn.doc_id = k.doc_id AND cn.chunk_id = k.chunk_id
  LEFT JOIN dots d ON d.query_id = q.query_id AND d.doc_id = k.doc_id AND d.chunk_id = k.chunk_id
),
scored AS (
  SELECT query_id, top_k, doc_id, chunk_id, text,
         CASE WHEN qn2 = 0 OR cn2 = 0 THEN 0.0
              ELSE CAST(dot AS DOUBLE) / (sqrt(CAST(qn2 AS DOUBLE)) * sqrt(CAST(cn2 AS DOUBLE))) END AS score
  FROM pairs
),
hits AS (
  SELECT * FROM (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id
                          ORDER BY score DESC, doc_id, chunk_id) AS INTEGER) AS rank,
           doc_id, chunk_id, text, score, top_k
    FROM scored)
  WHERE rank <= top_k
)"""


def lit(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def answers_sql(question_source: str) -> str:
    """P2 per question from ``hits`` and ``q``: CTE ``answers``. Must follow ``search_sql``."""
    from lectern.operators.answer import NO_HITS_ANSWER, PROMPT_TEMPLATE
    before, rest = PROMPT_TEMPLATE.split("{question}")
    mid, after = rest.split("{context}")
    return f""",
agg AS (
  SELECT query_id,
         string_agg('[Document ' || rank || ']' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context,
         arg_min(text, rank) AS best_text,
         count(*) AS chunks_used
  FROM hits GROUP BY query_id
),
answers AS (
  SELECT q.query_id, q.question, a.context,
         CASE WHEN a.query_id IS NOT NULL
              THEN {lit(before)} || q.question || {lit(mid)} || a.context || {lit(after)} END AS prompt,
         coalesce(a.best_text, {lit(NO_HITS_ANSWER)}) AS answer,
         coalesce(a.chunks_used, 0) AS chunks_used,
         CASE WHEN coalesce(a.chunks_used, 0) = 0 THEN 'low'
              WHEN a.chunks_used < 3 THEN 'medium' ELSE 'high' END AS confidence
  FROM {question_source} q LEFT JOIN agg a ON a.query_id = q.query_id
)"""


def in_document_questions_sql() -> str:
    return f"""
  SELECT conv_id || ':' || turn AS query_id, {strip_sql('text')} AS question,
         conv_id AS doc_id, 5 AS top_k
  FROM conversations
  WHERE role = 'user' AND length({strip_sql('text')}) > 0"""


def catalog_sql() -> str:
    """CTEs ``accepted``, ``rejects``, ``catalog``, ``kept``, ``counts``, ``results``. Must follow the chunk CTE."""
    return f""",
accepted AS (SELECT * FROM documents WHERE coalesce(length({strip_sql('text')}), 0) >= 50),
rejects AS (
  SELECT doc_id, 'no extractable text (under 50 characters)' AS reason
  FROM documents WHERE coalesce(length({strip_sql('text')}), 0) < 50
),
catalog AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) || '.pdf' AS filename, 'corpus-' || d.lang AS bucket,
         d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.pdf' AS s3_key,
         TIMESTAMP '2024-01-01 00:00:00' AS upload_date,
         CAST(strlen(d.text) AS BIGINT) AS file_size,
         CAST(length(d.text) AS BIGINT) AS total_characters,
         CAST(c.total_chunks AS BIGINT) AS total_chunks,
         'text_extracted' AS processing_status, 'pending' AS embedding_status
  FROM accepted d JOIN (SELECT doc_id, max(total_chunks) AS total_chunks FROM chunks GROUP BY 1) c USING (doc_id)
),
kept AS (SELECT c.* FROM chunks c SEMI JOIN accepted USING (doc_id) WHERE length(c.text) >= 20),
counts AS (SELECT doc_id, count(*) AS embeddings_count FROM kept GROUP BY 1),
results AS (SELECT c.* FROM counts c SEMI JOIN labels USING (doc_id)),
status AS (
  SELECT k.*, r.embeddings_count,
         CASE WHEN r.doc_id IS NOT NULL THEN 'completed' ELSE k.embedding_status END AS status
  FROM catalog k LEFT JOIN results r USING (doc_id)
)"""


def html_text_sql(expr: str) -> str:
    from lectern.sources.objects import HTML_ENTITIES
    h = expr
    for pat in (r"(?is)<script\b.*?</script[ \t\n\r\f]*>", r"(?is)<style\b.*?</style[ \t\n\r\f]*>",
                r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        h = f"regexp_replace({h}, '{pat}', ' ', 'g')"
    for ent, ch in HTML_ENTITIES:
        h = f"replace({h}, '{ent}', {lit(ch)})"
    return clean_sql(h)


def benchmark_questions_sql() -> str:
    return f"""
  SELECT 'b' || item_id AS query_id, {strip_sql('text')} AS question,
         CAST(NULL AS BIGINT) AS doc_id, 5 AS top_k
  FROM benchmark WHERE length({strip_sql('text')}) > 0"""


def mixed_questions_sql() -> str:
    """Every user turn; some without text, some with a ``top_k`` that is no number, some without one."""
    return """
  SELECT conv_id || ':' || turn AS query_id, CASE WHEN (conv_id + turn) % 6 = 4 THEN '  ' ELSE text END AS question,
         CASE WHEN (conv_id + turn) % 5 = 2 THEN 'many' WHEN (conv_id + turn) % 8 <> 0 THEN '2' END AS top_k
  FROM conversations WHERE role = 'user'"""
