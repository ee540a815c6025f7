"""SQL that gives the same rows as the queries that SQL can express (one row per doc_id is assumed)."""

from __future__ import annotations

from . import trigram_secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


def windows(n: int) -> str:
    """Windows of n words, or all words if they are fewer, joined by spaces."""
    return f"CASE WHEN len(ws) >= {n} THEN list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END"


def decontamination(n: int = 10) -> str:
    split = words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return f"""WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} AS ws FROM benchmark),
  p AS (SELECT DISTINCT item, least(len(ws), {n}) AS k, unnest({windows(n)}) AS phrase FROM i),
  d AS (SELECT doc_id, {split} AS ws FROM documents), ks AS (SELECT DISTINCT k FROM p),
  w AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS b, ws FROM d, ks WHERE len(ws) >= k),
  m AS (SELECT doc_id, b, w.k, item FROM (SELECT doc_id, k, b, array_to_string(ws[b:b + k - 1], ' ') AS phrase FROM w) w JOIN p ON w.phrase = p.phrase AND w.k = p.k),
  h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + k)) AS pos FROM m) q GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) q GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


def crc_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def media() -> str:
    """The payload's bytes as pairs of hexadecimal digits; the checksum by a table, byte by byte."""
    pairs = "[" + ", ".join(f"'{i:02X}'" for i in range(256)) + "]"
    blank = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]*"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS raw FROM documents), p AS (SELECT doc_id, text, octet_length(raw) AS n, greatest(1, (octet_length(raw) + 63) // 64) AS h, raw FROM d),
  q AS (SELECT doc_id, n, h, CASE WHEN regexp_full_match(split_part(text, chr(10), 1), '{blank}') THEN 0 ELSE 1 END AS position, raw || unhex(repeat('00', CAST(h * 64 - n AS BIGINT))) AS payload FROM p),
  x AS (SELECT *, regexp_extract_all(hex(payload), '..') AS x, encode('P5' || chr(10) || '64 ' || h || chr(10) || '255' || chr(10)) || payload AS stored FROM q),
  v AS (SELECT unnest({pairs}) AS pair, unnest(range(256)) AS level), c AS (SELECT doc_id, pair, count(*) AS n FROM (SELECT doc_id, unnest(x) AS pair FROM x) u GROUP BY 1, 2),
  f AS (SELECT doc_id, CAST(sum(n * level) AS BIGINT) AS total, CAST(sum(n * level * level) AS BIGINT) AS squares, count(*) AS many FROM c JOIN v ON c.pair = v.pair GROUP BY doc_id)
  SELECT x.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(h * 64 AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256,
    xor(list_reduce(list_transform(x[-64:], lambda b: CAST(list_position({pairs}, b) - 1 AS BIGINT)), lambda crc, b: xor(crc >> 8, CAST({crc_table()}[CAST((xor(crc, b) & 255) + 1 AS INTEGER)] AS BIGINT)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS tail_crc32,
    CAST(octet_length(stored) AS BIGINT) AS media_bytes, sha256(stored) AS media_sha256, 'h=' || h || ';sum=' || total || ';squares=' || squares || ';values=' || many AS feature, CAST(position AS INTEGER) AS position, n || ' bytes' AS caption FROM x JOIN f ON f.doc_id = x.doc_id"""


def secrets() -> str:
    rules = trigram_secrets.BASE + trigram_secrets.EXTRA

    def spans(k: int, rule: trigram_secrets.Rule) -> str:
        pattern = ("(?i)" if rule.folded else "") + rule.pattern.replace("'", "''")
        sizes = lambda x: f"list_transform({x}, lambda x: length(x))"
        return f"""SELECT doc_id, '{rule.kind}' AS kind, {k} AS rank, CAST(list_sum(a[1:i]) + coalesce(list_sum(b[1:i - 1]), 0) AS BIGINT) AS start, CAST(list_sum(a[1:i]) + list_sum(b[1:i]) AS BIGINT) AS stop
  FROM (SELECT doc_id, a, b, c, unnest(range(1, len(b) + 1)) AS i FROM (SELECT doc_id, {sizes(f"string_split_regex(text, '{pattern}')")} AS a, {sizes(f"regexp_extract_all(text, '{pattern}', 0)")} AS b,
    {sizes(f"regexp_extract_all(text, '{pattern}', {rule.group})")} AS c FROM documents WHERE regexp_matches(text, '{pattern}')) q) r WHERE c[i] >= {rule.least}"""

    every = " UNION ALL ".join(spans(k, r) for k, r in enumerate(rules))
    text = "kind || ':' || start || ':' || stop"
    listed = lambda where: f"string_agg({text}, ',' ORDER BY start, rank){where}"
    base = f" FILTER (WHERE rank < {len(trigram_secrets.BASE)})"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in trigram_secrets.BASE)
    return f"""WITH s AS ({every}), g AS (SELECT doc_id, {counts}, {listed(base)} AS base, {listed('')} AS spans FROM s GROUP BY doc_id)
  SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in trigram_secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""


def near_duplicates(n: int = 3, percent: int = 85, kept: bool = True) -> str:
    split = words(r"[^\x20\x09-\x0D]+")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {split} AS ws FROM documents), s AS (SELECT DISTINCT doc_id, unnest({windows(n)}) AS shingle FROM d),
  c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * p.n >= {percent} * (cx.n + cy.n - p.n)),
  g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), r AS (SELECT x AS node, x AS reach FROM g UNION SELECT r.node, g.y FROM r JOIN g ON r.reach = g.x),
  m AS (SELECT node, min(reach) AS least FROM r GROUP BY node)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id{", d.doc_id = least(d.doc_id, coalesce(m.least, d.doc_id)) AS kept" if kept else ""}
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id"""


def vector_codes(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One CTE for each assignment and each round's codebooks; vectors of one length that ``parts`` divides are assumed."""
    nearest = lambda k: f"""a{k} AS MATERIALIZED (SELECT id, part, min_by(entry, dist * {entries} + entry) AS entry, min(dist) AS dist
    FROM (SELECT v.id, v.part, c.entry, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM v JOIN b{k} c ON c.part = v.part) q GROUP BY id, part)"""  # noqa: E731
    # a floor, as integer division goes towards zero
    moved = lambda k: f"""s{k} AS (SELECT a.part, a.entry, place, sum(v.x[place]) AS s, count(*) AS n FROM a{k} a JOIN v ON v.id = a.id AND v.part = a.part, unnest(range(1, len(v.x) + 1)) AS u(place) GROUP BY 1, 2, 3),
  m{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS x FROM s{k} GROUP BY 1, 2),
  b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""  # noqa: E731
    steps = ",\n  ".join(f"{nearest(k)},\n  {moved(k)}" for k in range(rounds))
    return f"""WITH e AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  v AS MATERIALIZED (SELECT id, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS x FROM e, unnest(range({parts})) AS p(part)),
  b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM v WHERE id <= {entries}),
  {steps},
  {nearest(rounds)},
  r AS (SELECT id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY id),
  h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS books FROM b{rounds})
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT books FROM h) AS codebooks_sha256 FROM e JOIN r ON r.id = e.id"""


def prefix_trie(every: int = 20, kinds: int = 4) -> str:
    """Nodes are lists of (role, text); every subtree is summed by giving a node's share to all of its prefixes."""
    digits = "list_transform(string_split(CAST(o.conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = f"xor(crc >> 8, CAST({crc_table()}[CAST((xor(crc, b) & 255) + 1 AS INTEGER)] AS BIGINT))"
    crc = f"xor(list_reduce({digits}, lambda crc, b: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
  o AS MATERIALIZED (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, sha256(octet_length(encode(r)) || ':' || r || x)) AS own FROM t GROUP BY conv_id),
  c AS (SELECT o.conv_id, o.own, b.own AS head, CAST({crc} % {kinds} AS INTEGER) AS h FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % {every}),
  s AS MATERIALIZED (SELECT conv_id, CASE WHEN head IS NULL THEN own[h + 1:] ELSE list_concat(head[1:h], own[h + 1:]) END AS seq FROM c),
  n AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len(seq)) AS ended
    FROM (SELECT conv_id, seq, d, seq[1:d] AS path FROM s, unnest(range(0, len(seq) + 1)) AS u(d)) q GROUP BY path, d),
  k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
  f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.path[n.d].x, '[^\\x20\\x09-\\x0D]+')) END AS saved
    FROM n LEFT JOIN k ON k.path = n.path AND k.d = n.d),
  a AS (SELECT f.path[1:u.d] AS path, u.d AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved FROM f, unnest(range(0, f.d + 1)) AS u(d) GROUP BY 1, 2)
  SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ended, '')) AS ends_sha256
  FROM f JOIN a ON a.path = f.path AND a.d = f.d LEFT JOIN f p ON f.d > 0 AND p.d = f.d - 1 AND p.path = f.path[1:f.d - 1]"""
