"""DuckDB SQL for the queries opN_<name> that SQL can express."""

from __future__ import annotations

# The base rules of the secret scan, letters of the keywords in either case.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_PREFIX = rf"""(?:{_KEYWORDS})["'']?\x20*[:=]\x20*["'']?"""
_SECRETS = (
    ("assign", _PREFIX + r"[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_PREFIX}', '')) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    ("forge", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "true"),
)


def _spans(k: int, kind: str, pattern: str, keep: str) -> str:
    """Spans of one kind: the pieces between the matches give the offsets."""
    return f"""
      SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
        SELECT doc_id, m, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
          SELECT doc_id, found, pieces, unnest(found) AS m, generate_subscripts(found, 1) AS i FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS pieces FROM d)))
      WHERE {keep}"""


OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans(k, *x) for k, x in enumerate(_SECRETS))}),
g AS (SELECT doc_id,
        count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE k > 2) AS n_more,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k <= 2) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
      FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(n_more, 0) AS n_more, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def _le32(x: str) -> str:
    """The low 32 bits of an integer as hex, little-endian."""
    return " || ".join(f"printf('%02X', ({x} >> {8 * i}) & 255)" for i in range(4))


# The wave header of 8-bit mono at 8,000 samples a second; CRC-32 by its polynomial 0xEDB88320.
OP1 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, length(h) // 2 AS n_bytes, h || repeat('00', CAST(greatest(1, (length(h) // 2 + 63) // 64) * 64 - length(h) // 2 AS BIGINT)) AS h FROM d),
q AS (SELECT *, length(h) // 2 AS n FROM p),
w AS (SELECT *, '52494646' || {_le32("(n + 36)")} || '57415645666D74201000000001000100401F0000401F00000100080064617461' || {_le32("n")} || h AS m,
        list_transform(range(n), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS v FROM q)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(512), lambda i: (v[n - 63 + i // 8] >> (i % 8)) & 1)),
    lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c,
  n + 44 AS media_bytes, sha256(unhex(m)) AS media_sha256,
  n || ':' || list_sum(v) || ':' || CAST(list_sum(list_transform(v, lambda x: (x - 128) * (x - 128))) AS BIGINT) || ':' ||
    CAST(list_sum(list_transform(range(1, n), lambda i: CASE WHEN (v[i] >= 128) <> (v[i + 1] >= 128) THEN 1 ELSE 0 END)) AS BIGINT) AS feature
FROM w
"""
OP1 = f"SELECT doc_id, n_bytes, payload_bytes, payload_sha256, CAST(xor(c, 4294967295) AS BIGINT) AS tail_crc32, media_bytes, media_sha256, feature FROM ({OP1})"

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (
  SELECT a.doc_id, x, p FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) a
  ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON a.doc_id = g.doc_id AND a.p = g.p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.v = d.doc_id
"""

_WORDS7 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
# Proximity: an anchor term of each window (its longest) has places in a document, and some stretch of the window's length + 2 words about one of them holds every term as often.
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS7} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS7} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, w[i:i + 9] AS ts, array_to_string(w[i:i + 9], ' ') AS k, least(10, len(w)) AS n
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, i, bw.n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id),
uw AS (SELECT DISTINCT k, ts, n, list_reduce(ts, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) AS anchor FROM bw),
dp AS (SELECT r, doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p, w FROM d),
c AS (SELECT doc_id, k, ts, n, w[greatest(1, p - n - 1):p + n + 1] AS near FROM dp JOIN uw ON t = anchor),
nm AS (SELECT DISTINCT doc_id, k FROM c WHERE list_has_all(near, ts) AND len(list_filter(range(1, greatest(2, len(near) - n)),
       lambda s: len(list_filter(ts, lambda t: len(list_filter(near[s:s + n + 1], lambda x: x = t)) < len(list_filter(ts, lambda x: x = t)))) = 0)) > 0),
ni AS (SELECT doc_id, count(DISTINCT item) AS n_near, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM nm JOIN bw ON nm.k = bw.k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near_items, sha256(coalesce(ni.items, '')) AS near_items_sha256, ni.doc_id IS NOT NULL AS near
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""

_AFTER8 = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
OP8 = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, coalesce({_AFTER8}, '') AS a FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT *, string_split(host, '.') AS l FROM p),
t AS (SELECT page_id, unnest(CASE WHEN host = '' THEN [] ELSE list_distinct(list_concat(['host:' || host],
    CASE WHEN len(l) >= 2 THEN ['site:' || array_to_string(l[-2:], '.')] ELSE [] END, CASE WHEN len(l) >= 3 THEN ['sub:' || l[1]] ELSE [] END,
    [('path:' || x) FOR x IN string_split(path, '/') IF x <> '' AND NOT regexp_matches(x, '^[0-9]+$') AND NOT contains(x, '.')],
    CASE WHEN regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) <> '' THEN ['ext:' || regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)] ELSE [] END,
    [('key:' || split_part(x, '=', 1)) FOR x IN string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&') IF split_part(x, '=', 1) <> ''],
    CASE WHEN contains(url, '#') THEN ['fragment'] ELSE [] END)) END) AS tok FROM k),
m AS (SELECT doc_id, bool_or(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
tl AS (SELECT page_id, tok, bad FROM t JOIN m ON doc_id = page_id),
n AS (SELECT count(DISTINCT page_id) AS n FROM tl),
least_n AS (SELECT greatest(1, ceil(0.002::DOUBLE * n)) AS c FROM n),
s AS (SELECT page_id, bad, [tok] AS ts, tok AS last FROM tl UNION ALL SELECT s.page_id, s.bad, list_append(ts, tok), tok FROM s JOIN tl ON tl.page_id = s.page_id AND tok > last),
r AS (SELECT ts, count(*) FILTER (WHERE bad) / count(*) AS conf FROM s GROUP BY ts HAVING count(*) FILTER (WHERE bad) >= (SELECT c FROM least_n) AND count(*) FILTER (WHERE bad) / count(*) >= 0.6),
beaten AS (SELECT DISTINCT r.ts FROM (SELECT ts, conf, unnest(ts) AS tok FROM r) r JOIN r o ON o.ts[1] = tok AND o.conf >= r.conf AND len(o.ts) < len(r.ts) AND list_has_all(r.ts, o.ts)),
rules AS (SELECT ts, conf, array_to_string(ts, ' ') AS id FROM r ANTI JOIN beaten ON beaten.ts = r.ts),
pt AS (SELECT page_id, list(tok) AS toks FROM t GROUP BY 1),
b AS (SELECT page_id, max_by(id, (conf, id)) AS mined_rule FROM pt JOIN rules ON list_has_all(toks, ts) GROUP BY 1),
v AS (SELECT p.*, mined_rule, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p LEFT JOIN b USING (page_id))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN mined_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined_rule FROM v
"""

OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(i, r)),
e AS (SELECT *,
    length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x))), 0) AS escaped
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + escaped + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

# CRC-32 of each distinct word, byte by byte by its polynomial.
OP13 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS7} AS w FROM documents),
f AS (SELECT r, unnest(w) AS x FROM d),
b AS (SELECT unnest({_WORDS7}) AS x FROM benchmark),
v AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM b)),
k AS (SELECT x, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(4 * length(h)), lambda i: (CAST('0x' || substr(h, CAST(2 * (i // 8) + 1 AS BIGINT), 2) AS BIGINT) >> (i % 8)) & 1)),
    lambda c, y: CASE WHEN xor(c & 1, y) = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), 4294967295) % 10000 AS bucket FROM v),
fs AS (SELECT bucket, count(*)::DOUBLE AS s FROM f JOIN k USING (x) GROUP BY 1),
bt AS (SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN k USING (x) GROUP BY 1),
n AS (SELECT (SELECT count(*)::DOUBLE FROM f) AS s, (SELECT count(*)::DOUBLE FROM b) AS t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(bt.t, 0) + 1) * (n.s + 10000) / ((coalesce(fs.s, 0) + 1) * (n.t + 10000)))) AS BIGINT) AS gain FROM fs FULL JOIN bt USING (bucket), n),
m AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN k USING (x) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
s AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
e AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS eligible FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM e
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_media_columns": OP1, "op2_secret_scan": OP2, "op3_substring_dedup": OP3, "op5_ngram_jaccard_join": OP5, "op7_benchmark_decontamination": OP7, "op8_url_filters": OP8, "op9_chat_format": OP9, "op12_fill_in_middle": OP12, "op13_importance_resampling": OP13}
