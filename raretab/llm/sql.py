"""DuckDB statements of the training-data queries that SQL can express on whole
tables; written plainly, without the operators' methods."""

from __future__ import annotations

# words of an expression {t}, and the text with only A-Z lower-cased
WORDS_OF = "list_filter(regexp_split_to_array({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH toks AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS_OF.format(t=LOWER)} AS w FROM documents),
stat AS (SELECT count(*)::DOUBLE AS big_n, avg(len(w)) AS mean FROM toks),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n)::DOUBLE AS n, term, count(*)::DOUBLE AS tf
       FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM toks) GROUP BY r, term),
weights AS (SELECT term, ln(1 + (max(big_n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stat GROUP BY term),
asked AS (SELECT doc_id AS query_id, term, sum(tf) AS times FROM tf WHERE doc_id % 20 = 0 GROUP BY doc_id, term),
scored AS (SELECT query_id, r, any_value(doc_id) AS doc_id,
                  round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 8) AS score
           FROM asked JOIN weights USING (term) JOIN tf USING (term), stat GROUP BY query_id, r)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
"""

OP4 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, {WORDS_OF.format(t='t')} AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
grams AS (SELECT r, i, string_agg(word, ' ') OVER five AS g, count(*) OVER five AS size FROM words
          WINDOW five AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
twice AS (SELECT r, i, size = 5 AND count(*) OVER (PARTITION BY r, g, size) > 1 AS hit FROM grams),
covered AS (SELECT r, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS gone FROM twice),
repeated AS (SELECT r, count(*) FILTER (WHERE gone) AS n_repeat_words FROM covered GROUP BY r),
stats AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS capitals,
         length(t) - length(replace(t, '!', '')) AS exclamations
  FROM split LEFT JOIN repeated USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 4 * word_chars OR 100 * exclamations > 5 * word_chars
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * capitals > letters OR 10 * letters < 4 * word_chars) AS kept
FROM judged
"""

OP8 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_OF.format(t="coalesce(text, '')")} AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
windows AS (SELECT r, i, word, string_agg(word, ' ') OVER long AS s, count(*) OVER long AS size FROM words
            WINDOW long AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
twice AS (SELECT r, i, word, size = 35 AND count(*) OVER (PARTITION BY s, size) > 1 AS hit FROM windows),
covered AS (SELECT r, i, word, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
            FROM twice),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS left_over
         FROM covered GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

OP9 = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
bytes AS (SELECT r, doc_id, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM docs),
windows AS (SELECT r, doc_id, i, x, string_agg(x, '') OVER fifty AS s, count(*) OVER fifty AS size FROM bytes
            WINDOW fifty AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
seen AS (SELECT r, i, x, size = 50 AND min(doc_id) OVER (PARTITION BY s, size) < coalesce(doc_id, 9223372036854775807) AS hit
         FROM windows),
covered AS (SELECT r, i, x, coalesce(bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false)
              AS gone FROM seen),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM covered),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
                string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS left_over FROM edged GROUP BY r)
SELECT doc_id, len(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(left_over, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

OP10 = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_OF.format(t=LOWER)} AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM docs),
runs AS (SELECT r, i, n, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g
         FROM words),
sets AS (SELECT r, list_sort(list(DISTINCT g)) AS grams FROM runs WHERE i = 1 OR i <= n - 3 GROUP BY r),
placed AS (SELECT r, doc_id, coalesce(grams, []) AS grams FROM docs LEFT JOIN sets USING (r)),
classes AS (SELECT row_number() OVER () AS c, grams, len(grams) AS size, min(doc_id) AS class_id
            FROM placed WHERE len(grams) > 0 GROUP BY grams),
items AS (SELECT c, size, unnest(grams) AS g FROM classes),
links AS (SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.g = b.g AND a.c <> b.c
          GROUP BY a.c, b.c, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
reach(a, b) AS (SELECT c, c FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS c, min(class_id) AS component_id FROM reach JOIN classes ON classes.c = reach.b GROUP BY reach.a)
SELECT p.doc_id, len(p.grams)::BIGINT AS n_shingles, coalesce(component_id, p.doc_id) AS component_id
FROM placed p LEFT JOIN classes k ON p.grams = k.grams LEFT JOIN least USING (c)
"""

OP11 = """
WITH toks AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents),
stat AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS big_l FROM toks WHERE len(t) > 0),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
       FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM toks) GROUP BY r, term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf, stat WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
           FROM asked JOIN weights USING (term) JOIN tf USING (term), stat GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

# crc32 by its table: the reflected polynomial and the complement at both ends are its definition.
OP12 = """
WITH RECURSIVE poly(b, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
tbl AS (SELECT list(c ORDER BY b) AS t FROM poly WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT d, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY d, run),
seeded AS (
  SELECT run, times, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(d || ':' || run)) + 1),
      lambda i: ('0x' || substr(hex(encode(d || ':' || run)), (2 * i - 1)::INTEGER, 2))::BIGINT)),
    lambda acc, x: xor(acc >> 8, t[xor(acc & 255, x) + 1])), 4294967295) AS h
  FROM counted, tbl),
made AS (
  SELECT times, CASE WHEN h % 97 = 0
    THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run) + 2)::INTEGER) ELSE run END AS word
  FROM seeded),
words AS (SELECT word, sum(times)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
holes AS (SELECT word, n, length(word) AS len, unnest(range(1, length(word) + 1))::INTEGER AS i FROM words),
cuts AS (SELECT word, n, len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM holes),
links AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cuts a JOIN cuts b
    ON a.cut = b.cut AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
ranked AS (SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near,
                  row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS r FROM links),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
                 CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
          FROM words w LEFT JOIN (SELECT * FROM ranked WHERE r = 1) b ON w.word = b.word),
chain(word, root, next) AS (
  SELECT word, word, form FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

OP13 = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '') AS query FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    host || path || query AS whole FROM parts),
globbed AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN suffix(whole, '.exe') THEN '**.exe' WHEN suffix(whole, '.zip') THEN '**.zip'
    WHEN contains(whole, '/login') THEN '**/login**' WHEN contains(whole, '/cart/') THEN '**/cart/**'
    WHEN starts_with(whole, 'ads.') THEN 'ads.**'
    WHEN regexp_matches(whole, '(?s)\\?.*sessionid=') THEN '**\\?**sessionid=**' END AS glob_rule FROM ruled)
SELECT page_id, host, path, rule, glob_rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR glob_rule IS NOT NULL THEN 'block'
  ELSE 'allow' END AS verdict FROM globbed
"""

ORACLES: dict[str, str] = {
    "op1_bm25_search": OP1,
    "op4_quality_rules": OP4,
    "op8_substring_dedup": OP8,
    "op9_suffix_dedup": OP9,
    "op10_jaccard_join": OP10,
    "op11_ranked_search": OP11,
    "op12_spelling_variants": OP12,
    "op13_url_filter": OP13,
}
