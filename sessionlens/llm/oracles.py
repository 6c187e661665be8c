"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from sessionlens.llm import licenses as lic
from sessionlens.llm import quality as q
from sessionlens.llm import spelling as sp
from sessionlens.llm import urllist as url


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPACE = _text(q.SPACE)
_TRIMMED = f"lower(regexp_replace(l, {_text(f'^{q.SPACE}|{q.SPACE}$')}, '', 'g'))"
_LINE_WORDS = f"len(list_filter(string_split_regex(l, {_SPACE}), lambda x: x <> ''))"
_SEPARATORS = f"len(regexp_extract_all(l, {_text(q.SEPARATORS)}))"

QUALITY = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, {_SPACE}), lambda x: x <> '') AS ws FROM d
), win AS (
  SELECT doc_id, i, list_slice(ws, i, i + {q.WINDOW - 1}) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS i FROM w)
), hit AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {q.WINDOW})) AS p FROM hit WHERE n > 1) GROUP BY doc_id
), line AS (
  SELECT doc_id, l, {_TRIMMED} AS low, {_LINE_WORDS} AS nw, {_SEPARATORS} AS sep
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), judged AS (
  SELECT doc_id, l, length(l) AS chars,
    (sep >= {q.MIN_SEPARATORS} AND sep * 4 >= nw) OR regexp_matches(low, {_text(q.MENU)})
    OR regexp_matches(low, {_text(q.BOILERPLATE)}) OR regexp_matches(low, {_text(q.NO_LETTER)})
    OR (NOT regexp_matches(low, {_text(q.ENDED)}) AND nw < {q.MIN_UNENDED_WORDS}) AS bad
  FROM line
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, sum(chars) AS all_chars,
    coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost_chars
  FROM judged GROUP BY doc_id
), base AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(t, {_text(q.SYMBOLS)})) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost_chars, 0) AS lost, coalesce(all_chars, 0) AS whole
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), verdict AS (
  SELECT *, n_words < {q.MIN_WORDS}
    OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost <= {q.MAX_LOST_SHARE} * whole AS kept
FROM verdict
"""


def _license_rules() -> str:
    """Nested selects that use up one rule after the other."""
    inner = "SELECT doc_id, ids, list_aggregate(list_transform(ids, lambda i: '<' || i || '>'), " \
            "'string_agg', '') AS run, CAST([] AS VARCHAR[]) AS found FROM known"
    inner = f"SELECT doc_id, ids, coalesce(run, '') AS run, found FROM ({inner})"
    for name, ids in lic.RULES:
        run = _text(lic.run_text(ids))
        inner = (f"SELECT doc_id, ids, replace(run, {run}, '|') AS run, CASE WHEN contains(run, {run}) "
                 f"AND NOT list_contains(found, {_text(name)}) THEN list_append(found, {_text(name)}) "
                 f"ELSE found END AS found FROM ({inner})")
    return inner


LICENSES = f"""
WITH sentence AS (
  SELECT column0 AS plain, column1 AS id
  FROM (VALUES {', '.join(f'({_text(k)}, {_text(v)})' for k, v in lic.SENTENCES.items())}) AS v(column0, column1)
), cut AS (
  SELECT doc_id, string_split_regex(
    regexp_replace(coalesce(text, ''), '{lic.SENTENCE_END}', '\\1' || chr(10), 'g'), '[\\r\\n]+') AS ss
  FROM documents
), each AS (
  SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS place FROM cut
), named AS (
  SELECT doc_id, list(id ORDER BY place) AS ids
  FROM each JOIN sentence ON trim(regexp_replace(lower(s), '{lic.NOT_WORD}', ' ', 'g')) = plain
  GROUP BY doc_id
), known AS (
  SELECT doc_id, coalesce(ids, CAST([] AS VARCHAR[])) AS ids FROM documents LEFT JOIN named USING (doc_id)
)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses,
  len(ids) AS n_sentences, len(regexp_extract_all(run, '<')) AS n_unmatched
FROM ({_license_rules()})
"""

_HOST = f"lower(regexp_extract(url, '{url.HOST}', 1))"

_DRAW = "CAST('0x' || substr(md5(url), 1, 7) AS BIGINT)"

URL_LISTS = f"""
WITH capture AS (
  SELECT page_id, url, nullif({_HOST}, '') AS host,
    DATE '2024-01-01' + CAST(page_id * 101 % 366 AS INTEGER) AS fetched, {_DRAW} AS d FROM pages
), entry AS (
  SELECT CASE WHEN (d // 3) % 4 = 0 THEN regexp_replace(host, '^[^.]+\\.', '') ELSE host END AS name,
    CASE WHEN (d // 12) % 3 = 0 THEN 'allow' ELSE 'block' END AS list,
    (d // 36) % 2 = 0 AS adds, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS day
  FROM capture WHERE d % 3 = 0 AND host IS NOT NULL
), state AS (
  SELECT name, list, day, bool_and(adds) AS added FROM entry GROUP BY ALL
), change AS (
  SELECT * FROM (SELECT *, coalesce(lag(added) OVER h, false) AS was FROM state
    WINDOW h AS (PARTITION BY name, list ORDER BY day)) WHERE added <> was
), span AS (
  SELECT * FROM (SELECT name, list, added, day AS valid_from, coalesce(lead(day) OVER (
    PARTITION BY name, list ORDER BY day), DATE '{url.FOREVER}') AS valid_to FROM change) WHERE added
), ranked AS (
  SELECT page_id, s.*, row_number() OVER (PARTITION BY page_id ORDER BY length(name) DESC,
    list = 'allow' DESC) AS place
  FROM capture JOIN span s ON (host = name OR ends_with(host, '.' || name))
    AND fetched >= valid_from AND fetched < valid_to
)
SELECT c.page_id, host, fetched, coalesce(list, 'none') AS verdict, name, valid_from, valid_to
FROM capture c LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (page_id)
"""

#: crc32 by its definition: a table of 256 rests, then a byte at a time
_CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc_table FROM range(256) AS r(i))"""


def _crc(list_of_bytes: str) -> str:
    return (f"xor(list_reduce({list_of_bytes}, lambda c, b: "
            "xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)")


PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT c, c - c % 5 AS b, {_crc("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 9 AS h
  FROM (SELECT DISTINCT c FROM t), {_CRC_TABLE}
), seq AS (
  SELECT conv.c, t.p, 0 AS part, t.r, t.x FROM conv JOIN t ON t.c = conv.b AND t.p <= conv.h
  UNION ALL
  SELECT conv.c, t.p, 1, t.r, t.x FROM conv JOIN t ON t.c = conv.c AND t.p > conv.h
), placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d,
    md5(md5(r) || md5(x)) AS k, strlen(x) AS n FROM seq
), named AS (
  SELECT c, d, n, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS name FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM conv
), last AS (
  SELECT c, max(d) AS d FROM named GROUP BY c
), node AS (
  SELECT name, d, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n FROM named GROUP BY name, d
), kin AS (
  SELECT node.*, up.conv_id AS parent_conv_id
  FROM node LEFT JOIN named ON named.c = node.conv_id AND named.d = node.d - 1
  LEFT JOIN node up ON up.name = named.name AND up.d = named.d
), born AS (
  SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM kin WHERE d > 0 GROUP BY ALL
), own AS (
  SELECT kin.*, coalesce(n_children, 0) AS n_children FROM kin LEFT JOIN born USING (conv_id, d)
), total AS (
  SELECT named.name, named.d, sum((n_children = 0)::BIGINT) AS n_leaves,
    sum((n_convs - 1) * own.n) AS saved_tokens
  FROM own JOIN named ON named.c = own.conv_id AND named.d <= own.d GROUP BY ALL
), ends AS (
  SELECT name, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h
  FROM named JOIN last USING (c, d) GROUP BY ALL
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM own JOIN total USING (name, d) LEFT JOIN ends USING (name, d)
"""

_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
_BYTES = ("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), "
          "lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] "
          "ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END))")

SPELLING = f"""
WITH RECURSIVE run AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
      '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL
), hashed AS (
  SELECT w, n, {_crc(_BYTES)} AS h FROM run, {_CRC_TABLE}
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % {sp.CUT_ONE_IN} = 0
      THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= {sp.MIN_LETTERS} GROUP BY word HAVING sum(n) >= {sp.MIN_COUNT}
), less AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS v
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b USING (i, v) WHERE a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON words.word = less.v
  UNION SELECT words.word, less.word FROM less JOIN words ON words.word = less.v
), best AS (
  SELECT near.word, count(*) AS n_near, max(words.n) AS near_n,
    arg_min(near.near, (-words.n, near.near)) AS near
  FROM near JOIN words ON words.word = near.near GROUP BY near.word
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= {sp.RATIO} * n THEN near END AS form,
    CASE WHEN near_n >= {sp.RATIO} * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT way.word, way.next, formed.form FROM way JOIN formed ON formed.word = way.next
)
SELECT formed.*, root FROM formed JOIN (SELECT word, root FROM way WHERE next IS NULL) USING (word)
"""
