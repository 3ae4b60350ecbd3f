"""The corpus operators in DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

_MIX_FILL = """
open{k} AS (
  SELECT r.*, g.gap, sum(r.size) OVER (PARTITION BY r.src ORDER BY r.hash ROWS UNBOUNDED PRECEDING) AS cum
  FROM rest{k} r JOIN gap{k} g USING (src) WHERE {fits}),
in{k} AS (SELECT doc_id FROM open{k} WHERE cum <= gap),
out{k} AS (SELECT * FROM open{k} WHERE cum > gap),
gap{n} AS (
  SELECT src, min(gap) - (SELECT coalesce(max(cum), 0) FROM open{k} i WHERE i.src = o.src AND i.cum <= i.gap) AS gap
  FROM out{k} o GROUP BY src),
rest{n} AS (SELECT doc_id, src, size, hash FROM out{k})"""

OP3 = (
    r"""
WITH r AS (
  SELECT doc_id, coalesce(source, chr(1114111)) AS src, source IS NULL AS no_source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY src),
w AS (
  SELECT src, source_size, CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS cap,
         ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS w
  FROM s),
l AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT src, source_size,
         least(cap, coalesce(w * (SELECT level FROM l WHERE cap / w >= level ORDER BY cap / w, src LIMIT 1), cap)) AS target
  FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t),
gap0 AS (SELECT src, target - repeats * source_size AS gap FROM p WHERE target - repeats * source_size > 0),
rest0 AS (SELECT doc_id, src, size, hash FROM r WHERE size > 0),"""
    + ",".join(
        _MIX_FILL.format(k=k, n=k + 1, fits="r.size <= g.gap" if k else "true") for k in range(3)
    )
    + """,
more AS (SELECT doc_id FROM in0 UNION ALL SELECT doc_id FROM in1 UNION ALL SELECT doc_id FROM in2)
SELECT r.doc_id, r.size, p.source_size, p.target,
       r.size * (p.repeats + CASE WHEN r.doc_id IN (SELECT doc_id FROM more) THEN 1 ELSE 0 END) AS taken
FROM r JOIN p USING (src)
"""
)

OP10 = r"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
n AS (
  SELECT doc_id, i, line,
         len(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM a)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
         sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS cum
  FROM n WHERE w > 0),
enough AS (
  SELECT x.doc_id, x.k AS ka, y.k AS kb FROM f x JOIN f y
  ON y.doc_id = x.doc_id AND y.k >= x.k AND y.cum - x.cum + x.w >= 10),
win AS (
  SELECT doc_id, ka, min(kb) AS kb FROM enough GROUP BY doc_id, ka
  UNION SELECT doc_id, max(ka) AS ka, kb FROM enough GROUP BY doc_id, kb),
runs AS (
  SELECT v.doc_id, v.ka, v.kb, min(f.i) AS i0, max(f.i) AS i1,
         string_agg(f.line, chr(10) ORDER BY f.i) AS content
  FROM win v JOIN f ON f.doc_id = v.doc_id AND f.k BETWEEN v.ka AND v.kb GROUP BY v.doc_id, v.ka, v.kb),
firsts AS (SELECT content, min(row(doc_id, i0)) AS earliest FROM runs GROUP BY content),
gone AS (
  SELECT DISTINCT r.doc_id, n.i FROM runs r JOIN firsts x ON x.content = r.content
  JOIN n ON n.doc_id = r.doc_id AND n.i BETWEEN r.i0 AND r.i1
  WHERE row(r.doc_id, r.i0) > x.earliest),
kept AS (
  SELECT n.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(n.line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL), '') AS text
  FROM n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""

OP11 = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS units
  FROM documents),
g AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) % (len(units) + 1) AS a,
         CAST('0x' || substr(hex, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
         CAST('0x' || substr(hex, 25, 8) AS BIGINT) % 100 AS h4
  FROM h),
p AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(a, b)], '') AS pre, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(units[greatest(a, b) + 1:], '') AS suf
  FROM g)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

OP12 = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tie
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, tie) AS turns,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
             lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                      lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))),
             4294967295::BIGINT) % 6 AS h
  FROM t GROUP BY c),
whole AS (
  SELECT o.c, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
  FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100),
p AS (SELECT c, len(turns) AS size, turns, unnest(range(len(turns) + 1)) AS d FROM whole),
n AS (
  SELECT d, turns[1:d] AS seq, min(c) AS c, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN size = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends
  FROM p GROUP BY d, turns[1:d]),
m AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * coalesce(length(seq[d].text), 0) AS saved
  FROM n LEFT JOIN (SELECT d - 1 AS d, seq[1:d - 1] AS seq, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL) k USING (d, seq)),
up AS (
  SELECT a AS d, seq[1:a] AS seq, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT seq, saved, n_children, unnest(range(d + 1)) AS a FROM m) GROUP BY a, seq[1:a])
SELECT m.c AS conv_id, CAST(m.d AS BIGINT) AS depth, q.c AS parent_conv_id, m.n_convs, m.n_children,
       CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN up USING (d, seq) LEFT JOIN m q ON q.d = m.d - 1 AND q.seq = m.seq[1:m.d - 1]
"""

SQL = {"op3_source_mix": OP3, "op10_line_dedup": OP10, "op11_fill_in_middle": OP11, "op12_prefix_trie": OP12}
