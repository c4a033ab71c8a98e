"""DuckDB SQL for the operators that SQL can express."""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents))
  WHERE len(words) > 0),
words AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k))),
freq AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT f.lang, f.phrase, f.a, c, x.a AS l, y.a AS r, CAST(2000000 * CAST(f.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM freq WHERE k > 1) f
  JOIN freq x ON x.lang = f.lang AND x.phrase = array_to_string(f.w[1:c], ' ')
  JOIN freq y ON y.lang = f.lang AND y.phrase = array_to_string(f.w[c + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM freq WHERE k > 2), (SELECT unnest([1, 2, 3]) AS i) WHERE i + m - 1 <= k),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN (SELECT lang, phrase, max(a) AS b FROM inner_ GROUP BY ALL) q USING (lang, phrase)
  WHERE b IS NULL OR 100 * CAST(b AS HUGEINT) < 80 * CAST(s.a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""

MANIFEST = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    text, crc32_even.even
  FROM documents JOIN (
    SELECT doc_id, c % 2 = 0 AS even FROM (
      SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda c, b:
        list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS x, xor(x, 4294967295) AS c
      FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents))) crc32_even USING (doc_id)),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN even THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE leaf END AS tampered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total
  FROM rows_),
nodes AS (
  SELECT source, 0 AS level, pos, leaf AS h, total FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (total + 2) // 3 FROM nodes WHERE total > 1 GROUP BY source, level, pos // 3, total),
subroots AS (SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM nodes WHERE total = 1),
tops AS (
  SELECT 0 AS level, pos, subroot AS h, total FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (total + 2) // 3 FROM tops WHERE total > 1 GROUP BY level, pos // 3, total),
root_ AS (SELECT h AS root FROM tops WHERE total = 1),
places AS (
  SELECT doc_id, source, level, pos // CAST(pow(3, level) AS BIGINT) AS pos FROM leaves, (SELECT unnest(range(0, 30)) AS level) WHERE total > pow(3, level)),
top_places AS (
  SELECT source, height + level AS level, level AS top, pos // CAST(pow(3, level) AS BIGINT) AS pos FROM subroots, (SELECT unnest(range(0, 30)) AS level) WHERE total > pow(3, level)),
siblings AS (
  SELECT p.doc_id, p.level, p.pos AS own, n.pos, n.h FROM places p JOIN nodes n ON n.source IS NOT DISTINCT FROM p.source AND n.level = p.level AND n.pos // 3 = p.pos // 3
  UNION ALL
  SELECT l.doc_id, p.level, p.pos, n.pos, n.h FROM leaves l JOIN top_places p ON l.source IS NOT DISTINCT FROM p.source JOIN tops n ON n.level = p.top AND n.pos // 3 = p.pos // 3),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(h, '' ORDER BY level, pos) FILTER (pos <> own), '')) AS proof_sha256 FROM siblings GROUP BY doc_id),
folds AS (
  SELECT doc_id, 0 AS level, tampered AS node FROM leaves
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(string_agg(CASE WHEN s.pos = s.own THEN f.node ELSE s.h END, '' ORDER BY s.pos)) FROM folds f JOIN siblings s ON s.doc_id = f.doc_id AND s.level = f.level GROUP BY f.doc_id, f.level)
SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN root_
JOIN proofs p USING (doc_id) JOIN (SELECT doc_id, arg_max(node, level) AS node FROM folds GROUP BY doc_id) USING (doc_id)
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
large AS (SELECT lang, count(*) AS docs FROM docs GROUP BY lang HAVING count(*) * 1000 >= (SELECT count(*) FROM docs)),
tokens AS (SELECT row_id, lang, word, count(*) AS c FROM (SELECT row_id, lang, unnest(words) AS word FROM docs) GROUP BY ALL),
common AS (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS bin
  FROM (SELECT lang, word, count(*) AS n FROM tokens WHERE c >= 2 GROUP BY ALL) JOIN large USING (lang) WHERE n * 100 >= docs QUALIFY bin <= 32),
starts AS (
  SELECT row_id, i FROM (
    SELECT row_id, i, count(*) OVER (PARTITION BY row_id, words[i:i + 4]) AS c FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs)) WHERE c >= 2),
repeated AS (SELECT row_id, count(DISTINCT i + k) AS n FROM starts, (SELECT unnest(range(0, 5)) AS k) GROUP BY row_id),
base AS (
  SELECT d.row_id, doc_id, lang, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) AS n_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN repeated r ON r.row_id = d.row_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
char_bins AS (
  SELECT row_id, unnest(range(1, 9)) AS bin, unnest([low, upp, dig, sto, n_symbols, bey, spa, n_chars - low - upp - dig - sto - n_symbols - bey - spa]) AS c FROM (
    SELECT row_id, n_symbols, n_chars, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upp, length(regexp_replace(text, '[^0-9]', '', 'g')) AS dig,
      length(regexp_replace(text, '[^.,;:!?]', '', 'g')) AS sto, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS bey, n_chars - word_chars AS spa FROM base)),
word_counts AS (
  SELECT b.row_id, k.bin, coalesce(t.c, 0) AS c FROM base b JOIN common k ON k.lang = b.lang LEFT JOIN tokens t ON t.row_id = b.row_id AND t.word = k.word),
word_bins AS (
  SELECT * FROM word_counts
  UNION ALL
  SELECT b.row_id, 33, n_words - coalesce((SELECT sum(c) FROM word_counts w WHERE w.row_id = b.row_id), 0) FROM base b JOIN large USING (lang)),
char_shares AS (SELECT j.*, bin, c * 1000000 // greatest(n_chars, 1) AS share FROM judged j JOIN char_bins USING (row_id)),
word_shares AS (SELECT j.*, bin, CAST(c AS BIGINT) * 1000000 // greatest(n_words, 1) AS share FROM judged j JOIN word_bins USING (row_id)),
ref_chars AS (SELECT lang, bin, CAST(sum(share) AS BIGINT) // count(*) AS ref FROM char_shares JOIN large USING (lang) WHERE NOT base_failed AND n_chars >= 200 GROUP BY ALL),
ref_words AS (SELECT lang, bin, CAST(sum(share) AS BIGINT) // count(*) AS ref FROM word_shares WHERE NOT base_failed AND n_words >= 100 GROUP BY ALL),
chars AS (
  SELECT row_id, round(sqrt(greatest(sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END), 0) / 2), 6) AS char_distance
  FROM (SELECT row_id, share / 1e6 AS x, ref / 1e6 AS y FROM char_shares JOIN ref_chars USING (lang, bin) WHERE n_chars >= 200) GROUP BY row_id),
words_ AS (
  SELECT row_id, round(sqrt(greatest(sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END), 0) / 2), 6) AS word_distance
  FROM (SELECT row_id, share / 1e6 AS x, ref / 1e6 AS y FROM word_shares JOIN ref_words USING (lang, bin) WHERE n_words >= 100) GROUP BY row_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= 0.2 AND coalesce(word_distance, 0) <= 0.32 AS kept, char_distance, word_distance
FROM judged LEFT JOIN chars USING (row_id) LEFT JOIN words_ USING (row_id)
"""
