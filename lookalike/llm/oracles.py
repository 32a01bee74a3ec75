"""DuckDB SQL for the queries of operators whose results SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4 = rf"""
WITH sized AS (SELECT doc_id, source, len({_WORDS.format(text="coalesce(text, '')")}) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h FROM documents),
per AS (SELECT source, SUM(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
caps AS (SELECT *, 3e0 * source_size AS cap FROM per),
levels AS (SELECT *, (CAST(SUM(source_size) OVER () AS DOUBLE) - coalesce(SUM(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / SUM(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
free AS (SELECT arg_min(level, (cap / w, source IS NULL, coalesce(source, ''))) AS level FROM levels WHERE cap > w * level),
targets AS (SELECT l.source, l.source_size, least(l.cap, coalesce(l.w * f.level, l.cap)) AS target FROM levels l, free f),
tape AS (SELECT *, coalesce(SUM(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM sized)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(list_sum(list_transform([0, 1, 2], lambda e: greatest(0, least(size, CAST(round(target) AS BIGINT) - place - e * source_size)))) AS BIGINT) AS taken
FROM tape t JOIN targets s ON t.source IS NOT DISTINCT FROM s.source"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, x.b FROM reach r JOIN near x ON r.b = x.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.b AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, MIN(b) AS b FROM reach GROUP BY 1) r ON r.a = d.doc_id"""

OP10 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
earliest AS (SELECT h, MIN(doc_id) AS least FROM windows GROUP BY 1 HAVING MIN(doc_id) < MAX(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN earliest USING (h) WHERE least < doc_id),
lost AS (SELECT doc_id, COUNT(*) AS n FROM gone GROUP BY 1),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: Passages, lines, quotes and links as the operator makes them; paths by recursion.
OP6 = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split_regex(coalesce(text, ''), '\r?\n') AS lines FROM conversations),
line AS (SELECT conv_id, turn, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM m),
marked AS (SELECT *, regexp_matches(line, '^[ \t]*>') AS quote, len(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)+)', 1), '[ \t]', '', 'g')) AS level,
  lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', ''), '[\s\x{A0}]+', ' ', 'g'))) AS norm FROM line),
islands AS (SELECT *, SUM(starts) OVER (PARTITION BY conv_id, turn ORDER BY i) AS island
  FROM (SELECT *, CASE WHEN lag(level) OVER o IS DISTINCT FROM level OR norm = '' OR lag(norm) OVER o = '' THEN 1 ELSE 0 END AS starts FROM marked WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i))),
units AS (SELECT conv_id, turn, level, norm, false AS whole FROM marked WHERE norm <> ''
  UNION ALL SELECT conv_id, turn, MIN(level), string_agg(norm, ' ' ORDER BY i), true FROM islands WHERE norm <> '' GROUP BY conv_id, turn, island),
q AS (SELECT conv_id, turn, level, norm, bool_or(whole) AS whole FROM units WHERE level > 0 GROUP BY 1, 2, 3, 4),
own AS (SELECT DISTINCT conv_id, turn, norm FROM units WHERE level = 0),
found AS (SELECT q.conv_id, q.turn, q.level, q.whole, MAX(own.turn) AS source FROM q JOIN own ON own.conv_id = q.conv_id AND own.norm = q.norm AND own.turn < q.turn GROUP BY q.conv_id, q.turn, q.level, q.norm, q.whole),
votes AS (SELECT conv_id, turn, source, MIN(level) AS level, COUNT(*) AS n, COUNT(*) FILTER (WHERE level = 1) AS direct, COUNT(*) FILTER (WHERE level = 1 AND whole) AS passages FROM found GROUP BY 1, 2, 3),
parent AS (SELECT conv_id, turn, arg_max(source, (passages, direct, -level, n, source)) AS parent_turn FROM votes GROUP BY 1, 2),
path(conv_id, turn, above, path) AS (SELECT conv_id, turn, parent_turn, CAST(parent_turn AS VARCHAR) || '/' || turn FROM parent
  UNION ALL SELECT p.conv_id, p.turn, x.parent_turn, x.parent_turn || '/' || p.path FROM path p JOIN parent x ON x.conv_id = p.conv_id AND x.turn = p.above),
longest AS (SELECT conv_id, turn, arg_max(path, length(path)) AS path FROM path GROUP BY 1, 2),
body AS (SELECT conv_id, turn, COUNT(*) FILTER (WHERE quote) AS n_quoted, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT quote AND NOT (announces AND next)), '') AS text
  FROM (SELECT *, regexp_matches(line, '(?i)\b(wrote|writes|said|schrieb|a écrit|escribió)\b.{0,80}:\s*$') AS announces, coalesce(lead(quote) OVER (PARTITION BY conv_id, turn ORDER BY i), false) AS next FROM marked) GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, coalesce(p.parent_turn, -1) AS parent_turn, coalesce(l.path, CAST(m.turn AS VARCHAR)) AS reply_path, CAST(b.n_quoted AS BIGINT) AS n_quoted,
  sha256(CASE WHEN contains(m.text, '>') THEN trim(b.text) ELSE m.text END) AS text_sha256
FROM m JOIN body b USING (conv_id, turn) LEFT JOIN parent p USING (conv_id, turn) LEFT JOIN longest l USING (conv_id, turn)"""

ORACLE_SQL = {"op4_mixing": OP4, "op6_quoting": OP6, "op9_ngram_join": OP9, "op10_repeats": OP10}
