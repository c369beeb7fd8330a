"""Fragments of DuckDB SQL: the adapters' tables and shared expressions."""

from __future__ import annotations

from ..functions.text import FOLDED, MARKED
from ..operators import policy
from ..sources import adapters as ad


def listed(values: list[str]) -> str:
    return "(" + ", ".join("'" + v + "'" for v in sorted({v.lower() for v in values})) + ")"


def array(values: list[str]) -> str:
    return "[" + listed(values)[1:-1] + "]"


def plain_array(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def fold(text: str) -> str:
    return f"translate({text}, '{MARKED}', '{FOLDED}')"


FILES = f"""base AS (
  SELECT doc_id, text, n_chars, {plain_array(ad.EXTENSIONS)}[doc_id % 8 + 1] AS extension,
    'D:\\' || source || '\\' || {plain_array(ad.DIRECTORIES)}[doc_id % 11 + 1] AS parent_path,
    {plain_array(ad.ATTRIBUTES)}[doc_id % 7 + 1] AS attributes
  FROM documents),
files AS (
  SELECT doc_id, text, 'doc' || doc_id || '.' || extension AS name, parent_path || '\\doc' || doc_id || '.' || extension AS full_path, parent_path, extension,
    'file' AS kind, n_chars AS size, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id AS modified_at, attributes,
    lower(parent_path || '\\doc' || doc_id || '.' || extension) AS path_key
  FROM base)"""

CATALOG = (
    FILES
    + """,
catalog AS (
  SELECT name, full_path, parent_path, extension, kind, size, modified_at, attributes, path_key FROM files
  UNION ALL
  SELECT string_split(parent_path, '\\')[-1], parent_path, array_to_string(string_split(parent_path, '\\')[:-2], '\\'), '', 'folder', NULL, NULL, 16, lower(parent_path)
  FROM (SELECT DISTINCT parent_path FROM files))"""
)

EXCLUSIONS = f"""exclusions AS (
  SELECT DISTINCT lower(CASE WHEN lower(name) IN {listed(policy.REPOSITORY_MARKERS)} THEN parent_path WHEN attributes & 16 <> 0 THEN full_path END) AS prefix
  FROM catalog WHERE lower(name) IN {listed(policy.REPOSITORY_MARKERS + policy.EXCLUDED_DIRECTORIES)}
    AND (lower(name) IN {listed(policy.REPOSITORY_MARKERS)} OR attributes & 16 <> 0))"""


def below(prefix: str, path: str = "path_key") -> str:
    return f"({path} = '{prefix}' OR starts_with({path}, '{prefix}\\'))"


PRIORITY = f"""CASE WHEN {' OR '.join(below(p) for p in policy.PRIORITY_ROOTS)} THEN 0
  WHEN COALESCE(modified_at, TIMESTAMP '1970-01-01') >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY THEN 1 ELSE 2 END"""

POLICY = f"""WITH {CATALOG}, {EXCLUSIONS},
hit AS (SELECT DISTINCT doc_id FROM files f JOIN exclusions e ON f.path_key = e.prefix OR starts_with(f.path_key, e.prefix || '\\')),
limits AS (SELECT f.*, CASE extension WHEN 'txt' THEN 5242880 WHEN 'md' THEN 5242880 WHEN 'markdown' THEN 5242880 WHEN 'docx' THEN 10485760 END AS most, h.doc_id IS NOT NULL AS excluded
  FROM files f LEFT JOIN hit h USING (doc_id)),
judged AS (SELECT *, CASE
  WHEN most IS NULL THEN 'unsupported format'
  WHEN size < 0 OR size > most THEN 'file size limit'
  WHEN attributes & {policy.UNSAFE} <> 0 THEN 'unsafe file attributes'
  WHEN NOT starts_with(path_key, 'd:') THEN 'ineligible drive'
  WHEN {below(policy.PROTECTED[0])} THEN 'protected path'
  WHEN {below(policy.USERS_ROOT)} AND NOT {below(policy.USER_ROOT)} THEN 'other user profile'
  WHEN list_has_any(string_split(lower(parent_path), '\\')[2:], {array(policy.EXCLUDED_DIRECTORIES)}) THEN 'excluded directory'
  WHEN excluded THEN 'repository or excluded subtree'
  ELSE 'accepted' END AS reason FROM limits)
SELECT doc_id, full_path, reason = 'accepted' AS accepted, reason, CAST(COALESCE(most, 0) AS BIGINT) AS max_bytes, 1000000 AS max_chars,
  CASE WHEN reason = 'accepted' THEN {PRIORITY} ELSE 2147483647 END AS priority FROM judged"""


def noise(text: str) -> str:
    components = "list_filter(string_split(path_key[3:], '\\'), lambda p: p <> '')"
    dotted = "CASE WHEN extension = '' THEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) ELSE '.' || extension END"
    hard_names = listed([".tmp", ".temp", *policy.HARD_NAMES])
    suffixes = " OR ".join(f"ends_with(lower(name), '{s}')" for s in policy.SOFT_SUFFIXES)
    return f"""CASE WHEN attributes & 256 <> 0 OR {below(policy.TEMPORARY_ROOTS[0])} OR list_has_any({components}, {array(policy.HARD_COMPONENTS)})
      OR {dotted} IN ('.tmp', '.temp') OR lower(name) IN {hard_names} OR starts_with(name, '~$') OR starts_with(lower(name), '.~lock.') THEN 2
    WHEN lower(name) = '{text}' THEN 0
    WHEN attributes & {policy.SOFT_ATTRIBUTES} <> 0 OR {below(policy.SYSTEM_ROOTS[0])} OR list_has_any({components}, {array(policy.SOFT_COMPONENTS)})
      OR starts_with(lower(name), '.tmp') OR {dotted} IN {listed(policy.SOFT_EXTENSIONS)} OR {suffixes} THEN 1
    ELSE 0 END"""


NOISE_AWARE = f"""WITH {CATALOG},
first AS (SELECT *, (row_number() OVER (ORDER BY lower(name), path_key) - 1) // 100 AS page FROM catalog WHERE contains(lower(name), 'doc1') ORDER BY lower(name), path_key LIMIT 500),
judged AS (SELECT *, {noise('doc1')} AS noise FROM first),
pages AS (SELECT page, sum(CASE WHEN noise = 0 THEN 1 ELSE 0 END) AS n FROM judged GROUP BY page),
before AS (SELECT p.page, COALESCE((SELECT sum(q.n) FROM pages q WHERE q.page < p.page), 0) AS n FROM pages p),
kept AS (SELECT j.*, CASE WHEN lower(name) = 'doc1' THEN 0 WHEN starts_with(lower(name), 'doc1') THEN 1 WHEN contains(lower(name), 'doc1') THEN 2 ELSE 3 END AS rank
  FROM judged j JOIN before b USING (page) WHERE b.n < 50 AND noise < 2),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY noise, rank, length(name), lower(name), path_key) AS INTEGER) AS position FROM kept)
SELECT position, name, full_path, noise FROM ranked WHERE position <= 50"""

SNIPPET_MAIL = """WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ') AS flat FROM conversations),
a AS (SELECT *, greatest(greatest(strpos(lower(flat), 'the') - 1, 0) - 70, 0) AS start FROM f),
b AS (SELECT *, least(220, length(flat) - start) AS n FROM a)
SELECT conv_id, turn, CASE WHEN length(flat) <= 220 THEN flat ELSE
  CASE WHEN start > 0 THEN '…' ELSE '' END || trim(substr(flat, CAST(start + 1 AS BIGINT), CAST(n AS BIGINT)), ' ') || CASE WHEN start + n < length(flat) THEN '…' ELSE '' END END AS snippet FROM b"""

WORD = "'[\\p{L}\\p{N}]+'"

TOKENS = f"""{FILES},
fields AS (
  SELECT doc_id, 'title' AS field, regexp_extract_all({fold('lower(name)')}, {WORD}) AS terms FROM files
  UNION ALL SELECT doc_id, 'body', regexp_extract_all({fold('lower(text)')}, {WORD}) FROM files),
toks AS (SELECT doc_id, field, terms[i] AS term, i - 1 AS pos FROM (SELECT doc_id, field, terms, unnest(range(1, len(terms) + 1)) AS i FROM fields)),
stats AS (SELECT doc_id, sum(CASE WHEN field = 'title' THEN len(terms) ELSE 0 END) AS title_len, sum(CASE WHEN field = 'body' THEN len(terms) ELSE 0 END) AS body_len FROM fields GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, avg(title_len + body_len) AS avgdl FROM stats),
q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all({fold('lower(text)')}, {WORD})[1:2]) AS terms FROM benchmark),
qt AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM q)"""


def bm25(fields: str, title: float = 8.0, body: float = 1.0) -> str:
    return f"""hits AS (
  SELECT query_id, n_terms, qt.term, doc_id, sum(CASE WHEN field = 'title' THEN 1 ELSE 0 END) AS tf_title, sum(CASE WHEN field = 'body' THEN 1 ELSE 0 END) AS tf_body
  FROM qt JOIN toks ON qt.term = toks.term WHERE field IN ({fields}) GROUP BY ALL),
nt AS (SELECT query_id, term, count(*) AS n_t FROM hits GROUP BY ALL),
parts AS (
  SELECT h.query_id, h.n_terms, h.doc_id, {title} * tf_title + {body} * tf_body AS f, title_len + body_len AS d, avgdl,
    CASE WHEN ln((n_docs - n_t + 0.5) / (n_t + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n_t + 0.5) / (n_t + 0.5)) END AS idf
  FROM hits h JOIN nt USING (query_id, term) JOIN stats USING (doc_id), corpus),
scored AS (
  SELECT query_id, doc_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgdl))), 6) AS score FROM parts GROUP BY query_id, doc_id, n_terms HAVING count(*) = n_terms)"""


TOP = """ranked AS (
  SELECT s.query_id, s.doc_id, s.score, f.name, f.path_key, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, lower(f.name), f.path_key) AS INTEGER) AS rank
  FROM scored s JOIN files f USING (doc_id))"""

LINES = "lines AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents))"

LOCATE = f"""WITH {LINES},
hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM lines WHERE contains(lower(ls[line]), 'the') OR contains(lower(ls[line]), 'der '))
SELECT doc_id, CAST(line AS INTEGER) AS line, trim(array_to_string(ls[greatest(line - 1, 1):least(line + 1, len(ls))], chr(10)), ' ') AS snippet FROM hit WHERE k <= 3"""

WINDOW = f"""WITH {LINES},
c AS (SELECT doc_id, line, CASE WHEN contains(lower(ls[line]), 'and') THEN line END AS a, CASE WHEN contains(lower(ls[line]), 'with') THEN line END AS b FROM lines),
e AS (SELECT doc_id, line, min(a) OVER w AS a, min(b) OVER w AS b FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT doc_id, line AS start_line, greatest(a, b) AS end_line, row_number() OVER (PARTITION BY doc_id ORDER BY greatest(a, b) - line, line) AS k FROM e WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM s WHERE k = 1"""

HEADINGS = f"""WITH {LINES},
m AS (SELECT doc_id, line, CASE WHEN (line - 1) % 7 = 0 THEN 1 WHEN (line - 1) % 3 = 0 THEN 2 ELSE 0 END AS level, trim(ls[line], ' ') AS title, ls[line] AS raw FROM lines),
r AS (SELECT doc_id, line, CASE WHEN level > 0 THEN level END AS level, title FROM m),
p AS (SELECT doc_id, line, max(CASE WHEN level = 1 THEN line END) OVER w AS l1, max(CASE WHEN level = 2 THEN line END) OVER w AS l2 FROM r
  WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT p.doc_id, p.line, a.title AS t1, CASE WHEN p.l2 > COALESCE(p.l1, 0) THEN b.title END AS t2
  FROM p LEFT JOIN r a ON a.doc_id = p.doc_id AND a.line = p.l1 LEFT JOIN r b ON b.doc_id = p.doc_id AND b.line = p.l2)
SELECT doc_id, CAST(line AS INTEGER) AS line, nullif(concat_ws(' > ', nullif(t1, ''), nullif(t2, '')), '') AS heading_path FROM t"""

FUSED = f"""WITH {CATALOG},
q AS (SELECT * FROM (VALUES (1, 'doc1'), (2, 'doc2.md'), (3, 'doc3')) t(query_id, query)),
nn AS (SELECT q.query_id, q.query, f.path_key, f.name, CASE WHEN attributes & 256 <> 0 THEN 1 ELSE 0 END AS noise,
  row_number() OVER (PARTITION BY q.query_id ORDER BY length(name), lower(name), path_key) - 1 AS rank FROM q JOIN files f ON contains(lower(f.name), q.query)),
names AS (SELECT * FROM nn WHERE rank < 50),
ls AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents)),
hl AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM ls WHERE contains(lower(ls[line]), 'an')),
cd AS (SELECT q.query_id, q.query, f.doc_id, f.path_key, f.name, row_number() OVER (PARTITION BY q.query_id ORDER BY (f.size * q.query_id * 37) % 1009 DESC, f.path_key) AS d
  FROM q, files f),
content AS (SELECT query_id, query, path_key, name, line AS start_line, contains(lower(name), lower(query)) AS title_matched,
  row_number() OVER (PARTITION BY query_id ORDER BY d, line) - 1 AS rank FROM cd JOIN hl USING (doc_id) WHERE d <= 50 AND k <= 3),
ch AS (SELECT *, row_number() OVER (PARTITION BY query_id, path_key ORDER BY rank) AS hit_no FROM content),
fused AS (SELECT COALESCE(n.query_id, c.query_id) AS query_id, COALESCE(n.path_key, c.path_key) AS path_key, COALESCE(c.hit_no, 1) AS hit_no, COALESCE(c.name, n.name) AS name, COALESCE(c.query, n.query) AS query,
  COALESCE(c.start_line, 0) AS start_line, CASE WHEN n.rank IS NOT NULL AND c.rank IS NOT NULL THEN 'both' WHEN n.rank IS NOT NULL THEN 'name' ELSE 'content' END AS match_source,
  COALESCE(n.noise, 0) AS noise, COALESCE(c.title_matched, FALSE) AS title_matched, COALESCE(1.0::DOUBLE / (61 + n.rank), 0) + COALESCE(1.0::DOUBLE / (61 + c.rank), 0) AS rrf
  FROM names n FULL OUTER JOIN ch c ON n.query_id = c.query_id AND n.path_key = c.path_key AND c.hit_no = 1),
boosted AS (SELECT *, round(rrf * CASE WHEN lower(name) = lower(query) THEN 1.5 ELSE 1.0 END * CASE WHEN title_matched THEN 1.2 ELSE 1.0 END, 9) AS score FROM fused),
grouped AS (SELECT *, CASE WHEN match_source <> 'name' THEN 0 WHEN noise = 0 THEN 1 ELSE 2 END AS grp FROM boosted),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grp, score DESC, path_key, hit_no) AS position,
  CASE WHEN lower(name) = lower(query) THEN 0 WHEN match_source = 'name' AND noise > 0 THEN 2 ELSE 1 END AS tier FROM grouped)"""

MESSAGES = """messages AS (SELECT CAST(conv_id AS VARCHAR) AS store_id, CAST(turn AS VARCHAR) AS entry_id, left(text, 40) AS subject, role AS sender, CASE WHEN role = 'user' THEN 'Inbox' ELSE 'Sent' END AS folder,
  text AS body, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (conv_id * 7 + turn) AS ts FROM conversations)"""

FEEDBACK = f"""{FILES},
fb AS (SELECT e.event_id, f.path_key, lower(f.parent_path) AS directory_key, f.extension, CAST(e.ts AS DATE) AS day,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0 + CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 0 END WHEN event_type = 'click' THEN 0.5 ELSE 0 END AS weight
  FROM events e JOIN files f ON f.doc_id = e.event_id % (SELECT count(*) FROM documents) WHERE event_type <> 'error'),
daily AS (SELECT day, path_key, directory_key, extension, sum(weight) AS weight_sum, count(*) AS event_count FROM fb WHERE weight > 0 GROUP BY ALL)"""

CANDIDATES = """WITH c0 AS (SELECT doc_id, doc_id // 12 AS query_id, row_number() OVER (PARTITION BY doc_id // 12 ORDER BY doc_id) - 1 AS idx FROM documents),
v AS (SELECT vec_id, embedding FROM embeddings), z AS (SELECT embedding AS e0 FROM embeddings WHERE vec_id = 0), nv AS (SELECT count(*) AS n FROM embeddings),
c AS (SELECT c0.query_id, CAST(c0.doc_id AS VARCHAR) AS cand_id, c0.idx, (c0.idx // 5) % 3 AS tier, c0.doc_id % 4 AS promotion, 'name' || (c0.doc_id % 1200) AS name,
  CASE c0.doc_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'content' ELSE 'both' END AS match_source,
  round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(e0[i] AS DOUBLE))), 6) AS semantic_score
  FROM c0, z, nv JOIN v ON v.vec_id = c0.doc_id % nv.n)"""

BEHAVED = (
    CANDIDATES
    + """,
b AS (SELECT *, CASE WHEN idx < 10 THEN row_number() OVER (PARTITION BY query_id, idx < 10 ORDER BY tier, idx - least(greatest(promotion, 0), 10), idx) - 1 ELSE idx END AS behavior_index FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY semantic_score DESC, behavior_index) AS semantic_rank, count(*) OVER (PARTITION BY query_id, tier) AS n FROM b WHERE idx < 10),
bl AS (SELECT *, round(0.35 * CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE (n - (behavior_index + 1))::DOUBLE / (n - 1) END + 0.65 * CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE (n - semantic_rank)::DOUBLE / (n - 1) END, 6) AS blended FROM s)"""
)

LOW = """lo AS (SELECT query_id, count(*) AS n, max(semantic_score) AS top, min(semantic_score) AS low,
  max(CASE WHEN r = 1 THEN semantic_score END) AS s1, max(CASE WHEN r = 2 THEN semantic_score END) AS s2, max(CASE WHEN r = 5 THEN semantic_score END) AS s5, max(CASE WHEN r = 6 THEN semantic_score END) AS s6
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, idx) AS r FROM c) GROUP BY query_id),
low AS (SELECT query_id, COALESCE((s1 - s2) / greatest(top - low, 1e-9) < 0.15, FALSE) OR COALESCE(n >= 6 AND (s5 - s6) / greatest(top - low, 1e-9) < 0.15, FALSE) AS low_confidence FROM lo)"""

SNAPSHOTS = f"""{FILES},
a AS (SELECT path_key, upper(sha256(upper(full_path) || '|' || size || '|' || epoch_us(modified_at) || '|1')) AS fingerprint, doc_id FROM files WHERE doc_id % 10 <> 1),
b AS (SELECT path_key, upper(sha256(upper(full_path) || '|' || (size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) || '|' || epoch_us(modified_at) || '|1')) AS fingerprint, doc_id FROM files WHERE doc_id % 10 <> 2)"""

QUEUE = f"""{FILES},
queue AS (SELECT doc_id AS id, path_key, doc_id % 3 AS priority, doc_id % 4 AS attempts, CASE WHEN doc_id % 7 = 0 THEN 'processing' ELSE 'pending' END AS state,
  TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id AS next_attempt_at,
  ['ACCESS_DENIED', 'CORRUPT_DOCUMENT', 'FILE_TOO_LARGE', 'UNSUPPORTED_ENCODING', 'EXTRACTION_TIMEOUT', 'OCR_REQUIRED'][doc_id % 6 + 1] AS error_code FROM files)"""
