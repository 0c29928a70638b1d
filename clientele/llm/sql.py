"""DuckDB twins of the operators that SQL can state, over the tables as the driver registers them."""

from .mixing import MOST_REPEATS, WEIGHTS
from .token_counts import VERSIONS

SYMBOLS = "[%$#&*!]+"

WORDS = r"length(regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+'))"


def exact_dedup(documents: str = "documents") -> str:
    return f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM {documents} WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def mixing(documents: str = "documents") -> str:
    weights = ", ".join(str(w) for w in WEIGHTS)
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST({WORDS.format(text="text")} AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15)
              AS UBIGINT) AS BIGINT) AS h
  FROM {documents}),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [{weights}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, source_size * {MOST_REPEATS} AS cap, sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY CAST(source_size * {MOST_REPEATS} AS DOUBLE) / weight, source NULLS LAST) AS nth
  FROM ranked),
running AS (
  SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS cap_before,
         CAST(sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left
  FROM ordered),
level AS (
  SELECT CAST(total - cap_before AS DOUBLE) AS rest, weight_left AS rest_weight, nth AS at_nth FROM running
  WHERE CAST(cap AS DOUBLE) * weight_left >= CAST(total - cap_before AS DOUBLE) * weight ORDER BY nth LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN nth < at_nth THEN CAST(cap AS DOUBLE)
              ELSE rest * weight / rest_weight END AS target
  FROM running, level),
planned AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0
                 ELSE least(CAST(floor(target / source_size) AS BIGINT), {MOST_REPEATS}) END AS times FROM targets),
hashes AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
unpaid AS (
  SELECT p.source, h, words, target - times * CAST(source_size AS DOUBLE)
           - CAST(sum(words) OVER (PARTITION BY p.source ORDER BY h) - words AS DOUBLE) AS budget
  FROM hashes JOIN planned p ON hashes.source IS NOT DISTINCT FROM p.source),
cut AS (SELECT source, min(h) AS h FROM unpaid WHERE budget < words GROUP BY source),
thresholds AS (
  SELECT cut.source, CASE WHEN 2 * budget > words THEN cut.h + 1 ELSE cut.h END AS threshold
  FROM cut JOIN unpaid u ON cut.source IS NOT DISTINCT FROM u.source AND cut.h = u.h)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * (p.times + CASE WHEN s.h < coalesce(t.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
     LEFT JOIN thresholds t ON s.source IS NOT DISTINCT FROM t.source"""



def token_counts() -> str:
    counts = " UNION ALL ".join(
        f"SELECT source, lang, '{name}' AS version, length(regexp_extract_all(text, '{rule}')) AS n FROM final"
        for name, rule in VERSIONS.items()
    )
    return f"""
WITH kept AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents
  QUALIFY doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, ''))),
final AS (
  SELECT source, lang,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)
              THEN regexp_replace(text, '{SYMBOLS}', '', 'g') ELSE text END AS text
  FROM kept)
SELECT source, lang, version, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens
FROM ({counts}) GROUP BY source, lang, version"""


def prefix_trie(conversations: str = "conversations") -> str:
    # The CRC-32 table by its rule: eight halvings, with the polynomial where a bit falls out.
    halved = "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], {halved})) AS t),
said AS (
  SELECT conv_id, {WORDS.format(text="text")} AS words,
         sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS name, turn
  FROM {conversations} WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, words, name, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) - 1 AS nth FROM said),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                                                lambda d: CAST(ascii(d) AS BIGINT))),
                         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, nth, words, name FROM convs c JOIN turns ON turns.conv_id = base AND nth < h
  UNION ALL
  SELECT c.conv_id, 1, nth, words, name FROM convs c JOIN turns ON turns.conv_id = c.conv_id AND nth >= h),
prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(name, '') OVER w AS path, words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs),
last AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM prefixes JOIN last USING (conv_id, depth) GROUP BY path),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved
  FROM prefixes GROUP BY path, depth),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtree AS (
  SELECT left(own, 64 * k) AS path, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM (SELECT path AS own, saved, unnest(range(depth + 1)) AS k FROM nodes) LEFT JOIN kids ON kids.path = own GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs,
       CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(subtree.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN subtree USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path)
     LEFT JOIN nodes up ON n.depth > 0 AND up.path = left(n.path, length(n.path) - 64)"""
