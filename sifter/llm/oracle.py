"""DuckDB SQL of the operators that SQL can express over the driver's tables."""

from __future__ import annotations


def sharding_sql(limit: int, table: str = "documents") -> str:
    """Shortest hash prefix whose rows fit, among prefixes of up to 24 bits
    (repeated ids and more bits are left to the tests)."""
    return f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM {table}),
buckets AS (
  SELECT d AS shard_depth, h >> (60 - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM rows_, range(0, 25) t(d) GROUP BY ALL),
placed AS (
  SELECT r.doc_id, r.n_bytes, r.h, b.shard_depth, b.shard_bytes, b.shard_rows,
         row_number() OVER (PARTITION BY r.doc_id ORDER BY b.shard_depth) AS turn
  FROM rows_ r JOIN buckets b ON b.prefix = r.h >> (60 - b.shard_depth)
  WHERE b.shard_bytes <= {limit} OR b.shard_rows = 1)
SELECT doc_id, substr(lpad(bin(h), 60, '0'), 1, shard_depth::INT) AS shard, shard_depth::INT AS shard_depth, n_bytes,
       shard_bytes, shard_rows, shard_bytes <= {limit} AS fits
FROM placed WHERE turn = 1"""


def mixing_sql(seed: int, temperature: float, epochs: float, table: str = "documents") -> str:
    return f"""
WITH RECURSIVE per AS (
  SELECT source, sum(coalesce(length(text), 0))::BIGINT AS size FROM {table} GROUP BY source),
total AS (
  SELECT sum(size)::DOUBLE AS total, sum(pow(size::DOUBLE, {temperature})::DECIMAL(38,9))::DOUBLE AS all_raw FROM per),
rated AS (
  SELECT source, CASE WHEN size > 0 THEN pow(size::DOUBLE, {temperature}) / all_raw * {float(epochs)} * total / size ELSE 1.0 END AS rate
  FROM per, total),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rated
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps
  WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
docs AS (
  SELECT doc_id, source,
         ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE AS u
  FROM {table}),
counted AS (
  SELECT d.doc_id, d.source, count(s.k)::INT AS n_copies
  FROM docs d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u GROUP BY ALL)
SELECT doc_id, source, copy_no::INT AS copy_no, n_copies,
       ('0x' || substr(md5('{seed + 1}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counted)"""


def decontamination_sql(window: int = 10) -> str:
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all({low}, '{rx}') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), {window}) AS k FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM sized)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low}, '{rx}') AS w FROM documents),
spots AS (
  SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT rid, s.k, p, item_id FROM spots s JOIN windows x ON x.k = s.k AND x.win = s.win),
covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hits) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""


def topk_sql(every: int, k: int) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {k}"""


def warc_sql(min_bytes: int) -> str:
    return f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last_page FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {min_bytes} AND page_id < last_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {min_bytes} AND page_id < last_page THEN last_page END AS refers_to
FROM p JOIN m USING (payload_digest)"""


def jaccard_sql(words: int, num: int, den: int) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + {words} - 1], chr(10))) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words} + 2, least(len(w), 1) + 1))) AS p FROM docs)),
sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (
  SELECT x, y FROM pairs JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y WHERE {den} * c >= {num} * (a.n + b.n - c)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT doc_id AS id, doc_id AS r FROM docs UNION SELECT id, y FROM reach JOIN edges ON x = r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM docs JOIN least ON id = doc_id LEFT JOIN sized USING (doc_id)"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 of an expression whose characters are ASCII
    or U+00C0 to U+00FF, where ``crc_table`` (the CTE of ``CRC_TABLE``) is joined."""
    points = f"list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)"
    octets = f"flatten(list_transform(list_filter({points}, lambda c: c >= 0), lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END))"
    step = "lambda crc, b: xor(crc >> 8, crc_of[(xor(crc, b) & 255) + 1])"
    return f"xor(list_reduce({octets}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


_SHIFT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
CRC_TABLE = f"""crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS crc_of FROM (
    WITH RECURSIVE bits AS (
      SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
      UNION ALL SELECT i, {_SHIFT}, k + 1 FROM bits WHERE k < 8)
    SELECT i, c FROM bits WHERE k = 8))"""


def merkle_sql(table: str = "documents") -> str:
    """Trees of 16 by aggregation level by level; proofs and folded roots level
    by level over the siblings' texts."""
    def leaf(text: str) -> str:
        fields = [f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, base: str) -> str:
        return f"""{name} AS (
  {base}
  UNION ALL
  SELECT g, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16
  FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 16, n)"""

    def steps(start: str, tree: str, first: int) -> str:
        return f"""SELECT s.rid, {first} + t.lvl AS step,
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.pos >> (4 * t.lvl)), '') AS before,
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.pos >> (4 * t.lvl)), '') AS after
  FROM {start} s JOIN {tree} t ON t.g IS NOT DISTINCT FROM s.g AND t.n > 1 AND t.pos >> 4 = s.pos >> (4 * t.lvl + 4)
  GROUP BY s.rid, t.lvl"""

    return f"""
WITH RECURSIVE {CRC_TABLE},
rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source AS g, {leaf('text')} AS leaf,
         CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS changed
  FROM {table}, crc_table),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, rid) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM rows_),
{tree('trees', 'SELECT g, 0 AS lvl, pos, leaf AS digest, n FROM leaves')},
subroots AS MATERIALIZED (
  SELECT g AS source, digest, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM trees WHERE n = 1),
{tree('top', "SELECT '' AS g, 0 AS lvl, pos, digest, n FROM subroots")},
above AS (SELECT l.rid, '' AS g, s.pos FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.g),
steps AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY step) AS turn FROM (
  {steps('leaves', 'trees', 0)}
  UNION ALL
  {steps('above', 'top', 100)})),
folds AS (
  SELECT rid, 0::BIGINT AS turn, changed AS digest FROM leaves
  UNION ALL
  SELECT f.rid, s.turn, sha256(s.before || f.digest || s.after) FROM folds f JOIN steps s ON s.rid = f.rid AND s.turn = f.turn + 1),
proved AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY rid)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
       f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.g
CROSS JOIN (SELECT digest FROM top WHERE n = 1) r LEFT JOIN proved p ON p.rid = l.rid
JOIN (SELECT rid, arg_max(digest, turn) AS digest FROM folds GROUP BY rid) f ON f.rid = l.rid"""


def spelling_sql(letters: int, times: int, ratio: int, typo: int, table: str = "documents") -> str:
    """Near words by the strings that one deletion leaves; forms by order, roots by
    recursion."""
    rx = "[A-Za-z\\u00C0-\\u00FF]+".encode().decode("unicode_escape")
    low = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")
    return f"""
WITH RECURSIVE {CRC_TABLE},
raw AS (SELECT doc_id, {low} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{rx}')) AS run FROM {table})),
runs AS (SELECT doc_id, run, count(*) AS c FROM raw WHERE length(run) >= {letters} GROUP BY ALL),
keyed AS (SELECT run, c, {crc} AS h FROM runs, crc_table),
dealt AS (
  SELECT c, CASE WHEN h % {typo} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM keyed),
words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM dealt WHERE length(word) >= {letters} GROUP BY word HAVING sum(c) >= {times}),
cut AS MATERIALIZED (
  SELECT word, i, length(word) AS len, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
near AS (
  SELECT p.word, count(*)::BIGINT AS n_near, arg_min(p.other, (-b.n, encode(p.other))) AS best, max(b.n) AS best_n
  FROM pairs p JOIN words b ON b.word = p.other GROUP BY p.word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {ratio} * w.n THEN best END AS form,
         CASE WHEN best_n >= {ratio} * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS root, form FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL"""
