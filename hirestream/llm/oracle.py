"""DuckDB SQL of the training-data queries that SQL can express."""
from __future__ import annotations

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

OP9 = f"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g') AS norm FROM documents)"""

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
           FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1)
        GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{WS}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines
      FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 3 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM s"""

_CONTROLS = r"\\|</?s>|\[/?INST\]"
OP4 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN t ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       sum(length('<s>[INST][/INST]</s>') + length(role) + len(regexp_extract_all(role, '{_CONTROLS}'))
           + length(t) + len(regexp_extract_all(t, '{_CONTROLS}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
early AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
hit AS (SELECT win.doc_id, win.i FROM win JOIN early ON win.g = early.g WHERE early.first_id < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit)),
cut AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN cut.n IS NULL THEN array_to_string(w, ' ')
                   ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(cut.ps, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM inter JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * k >= 75 * (s.n + t.n - k)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM d LEFT JOIN size s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id"""

_CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), "
        "lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
        "lambda b, y: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)")
OP11 = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
                  md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS w FROM conversations),
s AS (SELECT conv_id, list(id ORDER BY k) AS ids, list(w ORDER BY k) AS ws, {_CRC} % 4 AS h FROM t GROUP BY conv_id),
r AS (SELECT s.conv_id, coalesce(b.ids[1:s.h], []) || s.ids[s.h + 1:] AS ids, coalesce(b.ws[1:s.h], []) || s.ws[s.h + 1:] AS ws
      FROM s LEFT JOIN s b ON b.conv_id = s.conv_id - s.conv_id % 20),
p AS (SELECT conv_id, d, len(ids) AS n, array_to_string(ids[1:d], '') AS node, array_to_string(ids[1:d - 1], '') AS up,
             CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w
      FROM (SELECT conv_id, ids, ws, unnest(range(0, len(ids) + 1)) AS d FROM r)),
node AS (SELECT node, d, any_value(up) AS up, min(conv_id) AS c, count(*) AS n, any_value(w) AS w,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = p.n), '')) AS ends
         FROM p GROUP BY node, d),
kids AS (SELECT up AS node, count(*) AS n FROM node WHERE d > 0 GROUP BY up),
below AS (SELECT p.node, sum((u.n - 1) * u.w)::BIGINT AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
          FROM node u LEFT JOIN kids ON kids.node = u.node JOIN p ON p.conv_id = u.c AND p.d <= u.d GROUP BY p.node)
SELECT node.c AS conv_id, node.d::BIGINT AS depth, CASE WHEN node.d > 0 THEN parent.c END AS parent_conv_id, node.n AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves AS n_leaves, below.saved AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN below ON below.node = node.node LEFT JOIN kids ON kids.node = node.node LEFT JOIN node parent ON parent.node = node.up"""

OP12 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 100)) AS g
        FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 48)) AS i FROM d WHERE len(x) >= 100)),
early AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
hit AS (SELECT win.doc_id, win.i FROM win JOIN early ON win.g = early.g WHERE early.first_id < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit)),
cut AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR before < p - 1) AS spans
        FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS x
         FROM (SELECT d.doc_id, unnest(range(1, len(x) // 2 + 1)) AS p, unnest(regexp_extract_all(x, '..')) AS b
               FROM d SEMI JOIN cut ON d.doc_id = cut.doc_id) a
         ANTI JOIN gone ON a.doc_id = gone.doc_id AND a.p = gone.p GROUP BY doc_id)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(cut.n, 0)::BIGINT AS n_removed, coalesce(cut.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN cut.n IS NULL THEN d.x ELSE coalesce(kept.x, '') END)) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = f"""
WITH d AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{TERM}') AS w FROM documents) WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{TERM}')) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d)
       WHERE term IN (SELECT term FROM item) GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT doc_id, tf.term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT
                * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS s
         FROM tf JOIN df ON df.term = tf.term, total),
score AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM part JOIN item ON item.term = part.term GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score WHERE score > 0)
WHERE rank <= 50"""

OP8 = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                   lambda b, y: xor(b >> 1, 3988292384 * (b & 1)))) AS t),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
             xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                             lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM documents, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS prefix,
             row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS row, sum(size) OVER () AS total FROM d),
s AS (SELECT *, ((2 * prefix + size) * 24 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row - min(row) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s"""

ORACLE: dict[str, str] = {"op3_substring_dedup": OP3, "op4_chat": OP4, "op6_jaccard_join": OP6, "op7_quality": OP7,
                          "op8_sharding": OP8, "op9_exact_dedup": OP9, "op11_prefix_trie": OP11,
                          "op12_suffix_dedup": OP12, "op13_lexical_search": OP13}
