"""The same queries as DuckDB SQL, where SQL can express them. The patterns and
constants are stated here again on purpose."""

from __future__ import annotations

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT k, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
        FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM rep, range(0, 3) r(j) GROUP BY k),
m AS (SELECT w.k, doc_id, t, ws, ls, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.k = cov.k),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters,
      length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS uppers,
      length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks,
      len(list_filter(ws, lambda x: x = '|')) AS pipes,
      len(list_filter(ws, lambda x: list_contains(stops, rtrim(lower(x), '.,;:!?')))) AS stopped
      FROM m, (SELECT string_split('@STOPS@', ' ') AS stops))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.2
  AND marks / n_words <= 0.3 AND pipes / n_words <= 0.2
  AND (letters = 0 OR uppers / letters <= 0.6) AND stopped / n_words >= 0.02
  AND (len(ls) = 0 OR n_dup_lines / len(ls) <= 0.5) AND n_repeat_words / n_words <= 0.5 AS kept
FROM r
"""
STOPS = ("a an and are as at be by for from he in is it of on or that the this to was were with "
         "auf aus bei das dem den der des die ein eine einer er es für im ist mit nicht sich und von war zu "
         "au avec dans de du elle en est et il la le les par pas pour que qui sur un une "
         "al con del el las lo los no para por se su y")

# Pages without canonical links or refreshes; a link in any page would need the
# recursive part, which is tested by brute force instead.
OP5 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, contains(coalesce(url, ''), '://') AS ok FROM pages),
s AS (SELECT page_id, ok, CASE WHEN ok THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM s),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT p.page_id, p.host AS h, p.path AS pa, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
        arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY ALL)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND p.host = fit.h AND p.path = fit.pa
"""

OP6 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                   (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) AS rl,
      length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS tl FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(rl + tl + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP8 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d.h AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h AND d.n >= 1000
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT k, array_to_string(ws[i:least(i + 4, len(ws))], ' ') AS g
       FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
pairs AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.k = x JOIN n ny ON ny.k = y
          WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT k, k FROM d UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.k = n.k
JOIN (SELECT r.x, min(e.doc_id) AS component_id FROM reach r JOIN d e ON e.k = r.y GROUP BY r.x) c ON c.x = d.k
"""


# crc32 of a decimal id, bit by bit: each byte is followed by seven zeros
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(i, ''), "
        "lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
        "lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)")


def merkle_sql(levels: int = 6) -> str:
    """The manifest with up to 16^levels rows a source and as many sources."""
    def level(k: int, groups: str, name: str) -> str:
        below = f"{name}{k - 1}"
        return (f"{name}r{k} AS (SELECT {groups}, i // 16 AS i, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {below} "
                f"GROUP BY {groups}, i // 16),\n"
                f"{name}{k} AS (SELECT {groups}, i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, "
                f"(n + 15) // 16 AS n FROM {name}r{k})")

    def step(k: int, name: str, before: str, on: str, place: str) -> str:
        own = f"{place} // {16 ** (k - 1)} % 16"
        return (f"{before}{name}{k} AS (SELECT f.* EXCLUDE (folded, proof), "
                f"CASE WHEN r.n > 1 THEN sha256(array_to_string(hs[:{own}], '') || folded || array_to_string(hs[{own} + 2:], '')) "
                f"ELSE folded END AS folded, CASE WHEN r.n > 1 THEN proof || array_to_string(hs[:{own}], '') || "
                f"array_to_string(hs[{own} + 2:], '') ELSE proof END AS proof "
                f"FROM {before}{name}{k - 1} f JOIN {name}r{k} r ON {on} AND r.i = f.{place} // {16 ** k})")

    def value(x: str) -> str:
        return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(value(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    every = range(1, levels + 1)
    same = "f.source IS NOT DISTINCT FROM r.source"
    return ",\n".join([
        f"WITH d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(lower)} AS bad, doc_id::VARCHAR AS i FROM documents)",
        f"c AS (SELECT *, CASE WHEN i IS NULL OR {_CRC} % 5 = 0 THEN bad ELSE leaf END AS folded FROM d)",
        "p AS (SELECT doc_id, source, leaf, folded, '' AS proof, row_number() OVER (PARTITION BY source "
        "ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM c)",
        "a0 AS (SELECT source, pos AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM p)",
        *[level(k, "source", "a") for k in every],
        f"b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, source "
        f"FROM a{levels})",
        *[level(k, "one", "b") for k in every],
        f"fa0 AS (SELECT * FROM p)", *[step(k, "a", "f", same, "pos") for k in every],
        f"fb0 AS (SELECT f.*, b0.i AS g, b0.h AS subroot FROM fa{levels} f JOIN b0 ON f.source IS NOT DISTINCT FROM b0.source)",
        *[step(k, "b", "f", "true", "g") for k in every]]) + (
        f"\nSELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, "
        f"folded = top.h AS verified FROM fb{levels}, (SELECT h FROM b{levels}) top")


OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INT AS rank, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3.replace("@STOPS@", STOPS), "op5_url_filters": OP5,
            "op6_chat_formatting": OP6, "op7_ngram_join": OP7, "op8_warc": OP8,
            "op11_merkle_manifest": merkle_sql(), "op13_hard_negatives": OP13}
