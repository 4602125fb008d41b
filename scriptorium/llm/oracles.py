"""SQL of the operators that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from .quality_rules import LEAST_SPREAD, PRIOR_TEXTS, WIDTH

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BUCKET = "CASE WHEN {0} < 16 THEN {0} ELSE 16 * (length(bin({0})) - 5) + ({0} >> (length(bin({0})) - 5)::INT) END"
_EDGE = "CASE WHEN bucket < 16 THEN bucket ELSE (bucket - 16 * ((bucket - 16) // 16)) << ((bucket - 16) // 16)::INT END"


def quality_rules() -> str:
    names = list(LEAST_SPREAD)
    spread = "CASE feature " + " ".join(f"WHEN '{f}' THEN {s}" for f, s in LEAST_SPREAD.items()) + " END"
    pairs = ", ".join(f"('{f}', {f})" for f in names)

    def fence(keys: str) -> str:
        return f"""
          SELECT {keys}, max(total) AS seen, {", ".join(f"max(CASE WHEN feature = '{f}' THEN fence END) AS {f}" for f in names)} FROM (
            SELECT {keys}, feature, max(total) AS total, max(q75) + {WIDTH} * greatest(max(q75) - max(q25), {spread}) AS fence FROM (
              SELECT {keys}, feature, total, min(CASE WHEN 100 * below >= 25 * total THEN {_EDGE} END) OVER (PARTITION BY {keys}, feature) AS q25,
                     min(CASE WHEN 100 * below >= 75 * total THEN {_EDGE} END) OVER (PARTITION BY {keys}, feature) AS q75 FROM (
                SELECT {keys}, feature, bucket, sum(sum(n)) OVER (PARTITION BY {keys}, feature ORDER BY bucket) AS below, sum(sum(n)) OVER (PARTITION BY {keys}, feature) AS total
                FROM sketch GROUP BY {keys}, feature, bucket)) GROUP BY {keys}, feature) GROUP BY {keys}"""

    return rf"""
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, g) > 1)) GROUP BY k),
    c AS (SELECT k, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_capitals,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN r USING (k)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length, CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_share,
        CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_share,
        CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END AS capital_share FROM c),
    sketch AS (SELECT lang, source, x.feature, {_BUCKET.format("x.v")} AS bucket, count(*) AS n
        FROM (SELECT lang, source, unnest([{", ".join(f"{{'feature': '{f}', 'v': {f}}}" for f in names)}]) AS x FROM f WHERE NOT base_failed) GROUP BY ALL),
    by_source AS ({fence("lang, source")}), by_lang AS ({fence("lang")})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT ({" OR ".join(f"coalesce(f.{n} > (s.seen * s.{n} + {PRIOR_TEXTS} * l.{n}) // (s.seen + {PRIOR_TEXTS}), false)" for n in names)}) AS kept, {", ".join(f"f.{n}::BIGINT AS {n}" for n in names)}
    FROM f LEFT JOIN by_source s USING (lang, source) LEFT JOIN by_lang l USING (lang)
    """


CHAT = r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, 10 + length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), chr(10), '%0A')) AS head,
        length(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B')) + 8 AS body FROM t),
    s AS (SELECT *, sum(head + body) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - body AS context FROM e),
    c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(head + body)::BIGINT AS formatted_chars,
        count(*) FILTER (role = 'assistant') AS n_examples, coalesce(sum(context) FILTER (role = 'assistant'), 0)::BIGINT AS context_chars
        FROM s GROUP BY conv_id)
    SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_examples::BIGINT AS n_examples, context_chars FROM c
"""

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, links.b FROM r JOIN links ON r.other = links.a)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""


_HASH = "('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {}, 8))::BIGINT"

INFILL = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  {", ".join(f"{_HASH.format(8 * k + 1)} AS h{k + 1}" for k in range(4))} FROM documents),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""

#: States 0 to 3: nothing yet, after s, after u, after a.  Costs to the end first, then the least edit that keeps to them, turn by turn.
REPAIR = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
e AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE kind <> 0),
r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM e),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM r),
v AS (SELECT conv_id, i, n, role, text, ini, fault IN ('blank', 'duplicate') AND fault IS NOT NULL AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f),
back AS (
  SELECT conv_id, n AS i, 0 AS c0, 4 AS c1, 2 AS c2, 0 AS c3 FROM v GROUP BY conv_id, n
  UNION ALL
  SELECT conv_id, i, least(d0, 2 + d2, 4 + d3) AS c0, least(d1, 2 + d2, 4 + d3) AS c1, least(d2, 2 + d3) AS c2, least(d3, 2 + d2) AS c3 FROM (
      SELECT v.conv_id, v.i - 1 AS i,
        least(3 + b.c0, CASE WHEN gone THEN 1000000000 WHEN ini = 's' THEN least(b.c1, 2 + b.c2) + cut WHEN ini = 'u' THEN b.c2 + cut ELSE 2 + b.c2 + cut END) AS d0,
        least(3 + b.c1, CASE WHEN gone THEN 1000000000 WHEN ini = 'u' THEN b.c2 + cut ELSE 2 + b.c2 + cut END) AS d1,
        least(3 + b.c2, CASE WHEN gone THEN 1000000000 WHEN ini = 'a' THEN b.c3 + cut ELSE 2 + b.c3 + cut END) AS d2,
        least(3 + b.c3, CASE WHEN gone THEN 1000000000 WHEN ini = 'u' THEN b.c2 + cut ELSE 2 + b.c2 + cut END) AS d3
      FROM back AS b JOIN v ON v.conv_id IS NOT DISTINCT FROM b.conv_id AND v.i = b.i)),
togo AS (SELECT conv_id, i, s, CASE s WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS c FROM back, range(4) AS t(s)),
walk AS (
  SELECT conv_id, 0 AS i, 0 AS s, '' AS audit, '' AS done, NULL::VARCHAR AS line, 0 AS step FROM v GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, s, audit || letter, letter, line, step FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY letter) AS best FROM (
      SELECT w.conv_id, w.audit, w.step + 1 AS step, m.letter, w.i + (m.letter <> 'I')::INT AS i, m.s2 AS s,
        CASE m.letter WHEN 'I' THEN CASE m.s2 WHEN 2 THEN 'user:' ELSE 'assistant:' END WHEN 'K' THEN v.role || ':' || v.text WHEN 'R' THEN CASE m.s2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || v.text END AS line
      FROM walk AS w JOIN togo AS g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i AND g.s = w.s
      JOIN (VALUES ('D', 0, 0), ('D', 1, 1), ('D', 2, 2), ('D', 3, 3), ('I', 0, 2), ('I', 1, 2), ('I', 2, 3), ('I', 3, 2), ('K', 0, 1), ('K', 0, 2), ('K', 1, 2), ('K', 2, 3), ('K', 3, 2), ('R', 0, 2), ('R', 1, 2), ('R', 2, 3), ('R', 3, 2)) AS m(letter, s1, s2) ON m.s1 = w.s
      JOIN togo AS h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i + (m.letter <> 'I')::INT AND h.s = m.s2
      LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND v.i = w.i + 1
      WHERE (m.letter = 'I' OR v.i IS NOT NULL) AND (m.letter NOT IN ('K', 'R') OR NOT v.gone)
        AND (m.letter <> 'K' OR v.ini = CASE m.s2 WHEN 1 THEN 's' WHEN 2 THEN 'u' ELSE 'a' END)
        AND g.c = h.c + CASE m.letter WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'K' THEN v.cut ELSE 2 + v.cut END))
  WHERE best = 1),
a AS (SELECT conv_id, max_by(audit, step) AS audit, string_agg(line, chr(10) ORDER BY step) AS whole FROM walk GROUP BY conv_id),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND (prev || ini) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated, coalesce(k.illegal, 0) AS illegal,
  coalesce(g.c, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(a.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN togo AS g ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.i = 0 AND g.s = 0
"""
