"""DuckDB SQL for contracts that compare words or vectors, stated over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(name: str, source: str, key: str, pattern: str) -> str:
    """CTEs ``name``_t (id, ws) and ``name`` (id, p, word) of a table's words."""
    return f"""{name}_t AS (SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}') AS ws FROM {source}),
{name} AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM {name}_t)"""


def contamination(window: int) -> str:
    """Words of documents inside any window of an item, windows joined as lists of words."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    sliding = f"list(word) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)"
    return f"""WITH {_words('d', 'documents', 'doc_id', pattern)},
{_words('b', "(SELECT CAST(item_id AS VARCHAR) AS item_id, text FROM benchmark)", 'item_id', pattern)},
dw AS (SELECT id, p, {sliding} AS seen FROM d),
bw AS (SELECT id, p, least({window}, n) AS size, seen FROM (SELECT id, p, {sliding} AS seen, count(*) OVER (PARTITION BY id) AS n FROM b) WHERE p <= greatest(n - {window} + 1, 1)),
sizes AS (SELECT DISTINCT size FROM bw),
cut AS (SELECT id, p, size, array_to_string(seen[1:size], ' ') AS passage FROM dw JOIN sizes ON len(seen) >= size),
hits AS (SELECT c.id, c.p, c.size, w.id AS item, w.p AS item_p FROM cut c JOIN (SELECT id, p, size, array_to_string(seen, ' ') AS passage FROM bw) w USING (size, passage)),
hit AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(p, p + size)) AS place FROM (SELECT DISTINCT id, p, size FROM hits)) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id),
runs AS (SELECT id, item, size, p - item_p AS shift, p, p - row_number() OVER (PARTITION BY id, item, size, p - item_p ORDER BY p) AS run FROM hits),
longest AS (SELECT id, max(n) AS n FROM (SELECT id, size + count(*) - 1 AS n FROM runs GROUP BY id, item, size, shift, run) GROUP BY id)
SELECT t.id AS doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t.ws) AS contaminated, CAST(coalesce(longest.n, 0) AS INT) AS longest_match
FROM d_t t LEFT JOIN hit USING (id) LEFT JOIN items USING (id) LEFT JOIN longest USING (id)"""


#: The least id reachable over links (a, b), of ids in ``nodes``.
_REACH = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


def near_duplicates(words: int) -> str:
    """Sets of shingles joined by their shingles; links at a similarity of 0.8 or more."""
    return f"""WITH RECURSIVE {_words('d', 'documents', 'doc_id', r"[^\x20\x09-\x0D]+")},
s AS (SELECT DISTINCT id, array_to_string(seen, ' ') AS shingle
  FROM (SELECT id, p, count(*) OVER (PARTITION BY id) AS n, list(word) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {words - 1} FOLLOWING) AS seen FROM d)
  WHERE p <= greatest(n - {words} + 1, 1)),
nodes AS (SELECT id, count(shingle) AS n FROM d_t LEFT JOIN s USING (id) GROUP BY id),
both_ AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b FROM both_ JOIN nodes u ON a = u.id JOIN nodes v ON b = v.id WHERE 100 * both_.n >= 80 * (u.n + v.n - both_.n)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
{_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN least USING (id)"""


def near_vectors(cosine: float) -> str:
    """Vectors of one label compared each with each."""
    return f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT u.id AS a, v.id AS b FROM v u JOIN v ON u.label = v.label AND u.id <> v.id WHERE list_cosine_similarity(u.x, v.x) >= {cosine}),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM least"""


#: Starts of strings are taken from pieces of so many bytes and what follows: a position of a text is found by counting to it.
_PIECE = 1000


def repeats(length: int, passage: int) -> str:
    """Every window of bytes (as hex digits) and of words, grouped by its MD5."""
    return rf"""WITH h AS (SELECT doc_id AS id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (SELECT id, {_PIECE} * c AS first, substr(x, 2 * {_PIECE} * c + 1, 2 * ({_PIECE} + {length} - 1)) AS y FROM (SELECT id, x, unnest(range(0, length(x) // {2 * _PIECE} + 1)) AS c FROM h)),
starts AS (SELECT id, first, y, unnest(range(0, length(y) // 2 - {length} + 1)) AS i FROM pieces),
strings AS (SELECT id, first + i AS i, md5_number(substr(y, 2 * i + 1, {2 * length})) AS m FROM starts),
found AS (SELECT id, i FROM strings WHERE m IN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1)),
edges AS (SELECT id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY id ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM found),
runs AS (SELECT id, min(i) AS low, max(i) + {length} AS high FROM (SELECT id, i, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS run FROM edges) GROUP BY id, run),
gaps AS (SELECT id, coalesce(lag(high) OVER w, 0) AS a, low AS b FROM runs WINDOW w AS (PARTITION BY id ORDER BY low)
  UNION ALL SELECT id, max(high), NULL FROM runs GROUP BY id),
kept AS (SELECT id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY a) AS kept_x FROM gaps JOIN h USING (id) GROUP BY id),
removed AS (SELECT id, CAST(sum(high - low) AS BIGINT) AS n, count(*) AS spans FROM runs GROUP BY id),
ws AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM h),
d AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM ws),
w AS (SELECT id, p, md5_number(array_to_string(seen, ' ')) AS m FROM (SELECT id, p, list(word) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {passage - 1} FOLLOWING) AS seen FROM d) WHERE len(seen) = {passage}),
shared AS (SELECT id, p FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(DISTINCT id) > 1)),
covered AS (SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(p, p + {passage})) AS place FROM shared) GROUP BY id)
SELECT h.id AS doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(removed.n, 0) AS n_removed, coalesce(removed.spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept_x, x))) AS kept_sha256, coalesce(covered.n, 0) AS n_passage_words
FROM h LEFT JOIN kept USING (id) LEFT JOIN removed USING (id) LEFT JOIN covered USING (id)"""


def _spans(kind: str, rank: int, pattern: str, good: str) -> str:
    """Of each match x of a pattern that is ``good``: its kind, place and end; texts are cut at matches and counted to them."""
    return rf"""SELECT id, {rank} AS rank, '{kind}' AS kind, text, CAST(place AS BIGINT) AS a, CAST(place + length(x) AS BIGINT) AS b, x FROM (
  SELECT * FROM (SELECT id, x, sum(length(cut) + length(x)) OVER (PARTITION BY id ORDER BY i) - length(x) AS place
    FROM (SELECT id, unnest(xs) AS x, unnest(string_split_regex(text, '{pattern}')[1:len(xs)]) AS cut, generate_subscripts(xs, 1) AS i FROM (SELECT id, text, regexp_extract_all(text, '{pattern}') AS xs FROM t)))
  WHERE {good}) JOIN t USING (id)"""


#: Characters beside which Python's \b sees a word's edge or not.
_EDGE = r"(?i)(^|[^\p{L}\p{N}_])"


def personal_data(context: int, ssn_up: str, ssn_down: str) -> str:
    """Spans by patterns and checksums; numbers of a tax payer only where words before them say so."""
    digits = r"regexp_replace(x, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({digits}, length({digits}) - i, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} ELSE 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    before = f"substr(text, greatest(a - {context}, 0) + 1, a - greatest(a - {context}, 0))"
    value = "CASE WHEN c <= '9' THEN CAST(c AS BIGINT) ELSE ascii(c) - 55 END"
    moved = "substr(w, 5) || left(w, 4)"
    mod97 = f"list_reduce(list_transform(range(1, length(w) + 1), lambda i: substr({moved}, i, 1)).list_transform(lambda c: {value}), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, CAST(0 AS BIGINT)) = 1"
    base = [
        _spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _spans("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(list_transform(string_split(x, '.'), lambda p: ltrim(p, '0')), lambda p: length(p) > 3 OR CAST('0' || left(p, 3) AS INT) > 255)) = 0"),
        _spans("card", 2, r"[0-9](?:[ -]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"),
        _spans("phone", 3, r"\+[0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
    ]
    return rf"""WITH RECURSIVE t AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
words AS ({_spans('iban', 4, '[A-Za-z0-9]+', "regexp_matches(x, '^[A-Z]{2}[0-9]{2}')")}),
tails AS (SELECT id, a, substr(text, a + 1, 69) AS y, unnest(range(15, 69)) AS size FROM words),
able AS (SELECT id, a, size, replace(left(y, size), ' ', '') AS w FROM tails
  WHERE size <= length(y) AND regexp_full_match(left(y, size), '[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9])+') AND NOT regexp_matches(substr(y, size + 1, 1), '[A-Za-z0-9]')),
banks AS (SELECT id, a, a + max(size) AS b FROM able WHERE length(w) BETWEEN 15 AND 34 AND {mod97} GROUP BY id, a),
chosen AS (SELECT id, min_by(a, a) AS a, min_by(b, a) AS b FROM banks GROUP BY id
  UNION ALL SELECT n.id, min_by(n.a, n.a), min_by(n.b, n.a) FROM chosen c JOIN banks n ON n.id = c.id AND n.a >= c.b GROUP BY n.id),
payers AS ({_spans('ssn', 5, '[0-9-]+', "regexp_full_match(x, '[0-9]{3}-[0-9]{2}-[0-9]{4}')")}),
found AS ({' UNION ALL '.join(f'SELECT id, rank, kind, a, b FROM ({s})' for s in base)}
  UNION ALL SELECT id, 4, 'iban', a, b FROM chosen
  UNION ALL SELECT id, rank, kind, a, b FROM payers WHERE left(x, 3) NOT IN ('000', '666') AND left(x, 3) < '900' AND substr(x, 5, 2) <> '00' AND right(x, 4) <> '0000'
    AND regexp_matches({before}, '{_EDGE}(?:{ssn_up})') AND NOT regexp_matches({before}, '{_EDGE}(?:{ssn_down})')),
lists AS (SELECT id, count(*) AS n, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))},
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rank, a) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rank, a) FILTER (rank < 4) AS base FROM found GROUP BY id)
SELECT id AS doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n, 0) AS n_found FROM t LEFT JOIN lists USING (id)"""
