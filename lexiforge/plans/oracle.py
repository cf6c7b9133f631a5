"""ANSI SQL (DuckDB dialect) for each registered query: an independent
statement of the same result, used as the correctness oracle.

The analog relations of ``lexiforge.plans.analogs`` are re-derived here as
CTEs over the raw driver tables.
"""

from __future__ import annotations

import string

from lexiforge.functions.codes import identity_display_names
from lexiforge.functions.text import TRAIN_TOKEN, WORD_TOKEN
from lexiforge.plans import queries as Q
from lexiforge.schemas import (
    CHAT_BEGIN, CHAT_END, LAND_NO_MANA_COST, MARKERS, NO_MANA_COST, NO_POWER, NO_TOUGHNESS,
    QUESTIONS, RAG_JOIN, RAG_PREAMBLE, SYSTEM_PROMPT, ZONE_PHRASES,
)


def lit(s: str) -> str:
    """Python string -> SQL expression (control characters via chr())."""
    out, buf = [], []
    for ch in s:
        if ch in "\n\r":
            if buf:
                out.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            out.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not out:
        out.append("'" + "".join(buf).replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


def render(template: str, **vals: str) -> str:
    parts = []
    for literal, fld, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if fld is not None:
            parts.append(f"CAST({vals[fld]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def _bits(x: str = "p_size") -> str:
    parts = ", ".join(f"CASE WHEN ({x} & {b}) <> 0 THEN '{c}' END"
                      for b, c in ((16, "G"), (8, "R"), (4, "B"), (2, "U"), (1, "W")))
    return f"CASE WHEN {x} % 16 = 0 THEN NULL ELSE concat_ws(', ', {parts}) END"


PRINTINGS = f"""printings AS (
  SELECT p_partkey AS uuid,
    CASE WHEN p_size % 10 = 0 THEN p_name || ' // ' || p_brand
         WHEN p_size % 10 = 5 THEN p_name || '//' || p_type ELSE p_name END AS name,
    CASE WHEN p_size % 3 = 0 THEN 'a' WHEN p_size % 3 = 1 THEN 'b' END AS side,
    CASE WHEN p_size % 4 = 0 THEN NULL ELSE '{{' || CAST(p_size % 7 AS VARCHAR) || '}}{{'
         || substr('WUBRG', p_size % 5 + 1, 1) || '}}' END AS manaCost,
    CASE WHEN p_size % 9 = 0 THEN CAST(CAST(p_size AS DOUBLE) + 0.5 AS VARCHAR)
         ELSE CAST(CAST(p_size AS DOUBLE) AS VARCHAR) END AS manaValue,
    CASE WHEN p_size % 6 = 0 THEN 'Basic Land — ' || p_type
         WHEN p_size % 6 = 1 THEN 'Island ' || p_type ELSE 'Creature — ' || p_type END AS type,
    CASE WHEN p_size % 8 = 0 THEN NULL
         ELSE 'Deal ' || CAST(p_size AS VARCHAR) || ' damage to any ' || lower(p_type) || ' target.' END AS text,
    CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '*' ELSE CAST(p_size % 7 AS VARCHAR) END AS power,
    CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 4 AS VARCHAR) END AS toughness,
    CASE WHEN p_size % 11 = 0 THEN CAST(p_size % 6 AS VARCHAR) END AS loyalty,
    {_bits()} AS colors,
    CASE WHEN p_size % 13 = 0 THEN NULL ELSE {_bits()} END AS colorIdentity,
    CASE WHEN p_size % 2 = 0 THEN 'Flying, ' || lower(p_type) END AS keywords,
    CASE WHEN p_size % 12 = 0 THEN upper(p_name) END AS asciiName,
    CASE WHEN p_size % 4 = 0 THEN 'common' WHEN p_size % 4 = 1 THEN 'uncommon'
         WHEN p_size % 4 = 2 THEN 'rare' ELSE '' END AS rarity,
    CASE WHEN p_size % 5 = 0 THEN 'split' ELSE 'normal' END AS layout
  FROM part)"""

RULINGS = """rul AS (
  SELECT l_partkey AS uuid, 'Order ' || CAST(l_orderkey AS VARCHAR) || ' line '
         || CAST(l_linenumber AS VARCHAR) || ' ships ' || l_linestatus AS text
  FROM lineitem)"""


def norm_code(x: str) -> str:
    s = f"replace(replace({x}, ',', ''), ' ', '')"
    pos = "CASE WHEN instr('WUBRGC', ch) = 0 THEN 7 ELSE instr('WUBRGC', ch) END"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {s} = '' THEN '' ELSE array_to_string("
            f"list_transform(list_sort(list_transform(str_split({s}, ''), lambda ch: {pos})), "
            f"lambda i: substr('WUBRGC', i, 1)), '') END")


def to_int(x: str) -> str:
    d = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN {d} = floor({d}) THEN CAST({d} AS INTEGER) END"


CANON = f"""{PRINTINGS},
{RULINGS},
legal AS (SELECT DISTINCT l_partkey AS uuid FROM lineitem WHERE l_returnflag = 'R'),
reps AS (SELECT * EXCLUDE (rn) FROM (
    SELECT p.*, row_number() OVER (PARTITION BY name, side ORDER BY uuid) AS rn
    FROM printings p WHERE uuid IN (SELECT uuid FROM legal)) WHERE rn = 1),
rul_agg AS (SELECT uuid, string_agg(text, chr(10) ORDER BY text) AS rulings
            FROM rul WHERE uuid IN (SELECT uuid FROM reps) GROUP BY uuid),
canon AS (SELECT r.*, a.rulings FROM reps r LEFT JOIN rul_agg a USING (uuid)),
cards AS (SELECT uuid, name, side, manaCost, {to_int('manaValue')} AS cmc, type, text, power,
                 toughness, loyalty, colors, {norm_code('colorIdentity')} AS colorIdentity,
                 keywords, asciiName, rarity, layout, rulings FROM canon)"""


def identity_map(x: str) -> str:
    whens = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in identity_display_names().items())
    return f"CASE {x} {whens} END"


def face(name: str = "name", side: str = "side") -> str:
    return (f"CASE WHEN {side} = 'a' AND contains({name}, '//') THEN string_split({name}, ' // ')[1] "
            f"WHEN {side} = 'b' AND contains({name}, '//') THEN coalesce(string_split({name}, ' // ')[2], {name}) "
            f"ELSE {name} END")


def lines(x: str) -> str:
    """``str.splitlines`` for text whose only breaks are ``\\n`` / ``\\r\\n``."""
    return (f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE "
            f"string_split_regex(regexp_replace({x}, '(?:\\r\\n|[\\n\\r])\\z', ''), '\\r\\n|[\\n\\r]') END")


def ordinal(x: str, start: int = 0, indent: str = "") -> str:
    return (f"array_to_string(list_transform({lines(x)}, lambda l, i: {lit(indent)} || "
            f"CAST(i - 1 + {start} AS VARCHAR) || '. ' || l), chr(10))")


# --- card QA templates -----------------------------------------------------------

def _templates(compat: bool) -> list[tuple[str, str, str, str, str | None]]:
    """(builder, predicate, answer, subject, value) per template, in order."""
    f = face()
    t = []
    if compat:
        t.append(("mana_cost", "manaCost IS NOT NULL", "manaCost", f, None))
        t.append(("mana_cost", "manaCost IS NOT NULL",
                  f"CASE WHEN contains(type, 'Land') THEN {render(LAND_NO_MANA_COST, name=f)} "
                  f"ELSE {render(NO_MANA_COST, name=f)} END", f, None))
    else:
        t.append(("mana_cost", "TRUE",
                  f"CASE WHEN manaCost IS NOT NULL THEN manaCost "
                  f"WHEN coalesce(contains(type, 'Land'), false) THEN {render(LAND_NO_MANA_COST, name=f)} "
                  f"ELSE {render(NO_MANA_COST, name=f)} END", f, None))
    t.append(("cmc", "cmc IS NOT NULL", "CAST(cmc AS VARCHAR)", f, None))
    t.append(("keywords", "keywords IS NOT NULL", "keywords", f, None))
    colors = ("array_to_string(str_split(colors, ''), '|')" if compat
              else "array_to_string(string_split_regex(colors, ', *'), '|')")
    t.append(("colors", "colors IS NOT NULL", colors, f, None))
    if compat:
        t.append(("color_identity", "colorIdentity IS DISTINCT FROM ''",
                  "coalesce(colorIdentity, 'nan')", f, None))
    else:
        t.append(("color_identity", "colorIdentity IS NOT NULL AND colorIdentity <> ''",
                  "colorIdentity", f, None))
    t.append(("ascii_name", "asciiName IS NOT NULL", "asciiName", f, None))
    t.append(("type", "type IS NOT NULL", "type", f, None))
    t.append(("power", "TRUE", f"coalesce(power, {render(NO_POWER, name=f)})", f, None))
    t.append(("text", "text IS NOT NULL", "text", f, None))
    t.append(("loyalty", "loyalty IS NOT NULL", "loyalty", f, None))
    t.append(("rarity", "rarity IS NOT NULL", "rarity", f, None))
    t.append(("toughness", "TRUE", f"coalesce(toughness, {render(NO_TOUGHNESS, name=f)})", f, None))
    t.append(("rulings", "rulings IS NOT NULL", ordinal("rulings", 0), "name", None))
    cmc_pred = ("cmc IS NOT NULL AND side = 'b' AND contains(name, '//')" if compat
                else "cmc IS NOT NULL")
    t.append(("card_with_cmc", cmc_pred, f, f, "cmc"))
    t.append(("side", "side IS NOT NULL", "side", f, None))
    t.append(("side_name", "side IS NOT NULL", f, f, "side"))
    return t


def qa_sql(compat: bool, builders: list[str] | None = None) -> str:
    parts = []
    for b, pred, ans, subj, val in _templates(compat):
        if builders and b not in builders:
            continue
        key = b
        for q in QUESTIONS[key]:
            vals = {"name": subj}
            if val:
                vals["value"] = val
            parts.append(f"SELECT uuid, '{b}' AS builder, {render(q, **vals)} AS question, "
                         f"CAST({ans} AS VARCHAR) AS answer FROM cards WHERE {pred}")
    return "\nUNION ALL\n".join(parts)


# --- combos ------------------------------------------------------------------------

ZONE = {"R": ["B"], "A": ["G", "E"], "N": ["H"]}


def _zone_phrase_by_flag(first_only: bool) -> str:
    whens = []
    for flag, zones in ZONE.items():
        phrase = ZONE_PHRASES[zones[0]] if first_only else " or ".join(ZONE_PHRASES[z] for z in zones)
        whens.append(f"WHEN '{flag}' THEN '{phrase}'")
    return f"CASE (CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag ELSE 'N' END) {' '.join(whens)} END"


COMBO_LINES = """lines AS (
  SELECT l.*, p.p_name, p.p_type,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) AS rn,
         CASE WHEN l.l_linenumber % 3 = 0 THEN 'Infinite ETB'
              WHEN l.l_linenumber % 3 = 1 THEN 'Infinite LTB' ELSE 'ETB then LTB' END AS feature
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def _expand(x: str) -> str:
    return (f"CASE WHEN contains({x}, 'LTB') THEN replace({x}, 'LTB', 'leaves the battlefield') "
            f"WHEN contains({x}, 'ETB') THEN replace({x}, 'ETB', 'enters the battlefield') ELSE {x} END")


def combo_qa_sql() -> str:
    end_steps, end_result, end_prereq, start, end_combo = (lit(m) for m in MARKERS)
    per = f"""per AS (
  SELECT l_orderkey,
    string_agg(p_name, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS names,
    string_agg('  - ' || {_expand('feature')}, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS feats,
    string_agg('  ' || CAST(rn AS VARCHAR) || '. Use ' || p_name || ' x'
               || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS steps,
    count(DISTINCT CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag ELSE 'N' END) AS n_zone_sets,
    min({_zone_phrase_by_flag(True)}) AS single_phrase,
    string_agg('  - ' || p_name || ' must be ' || {_zone_phrase_by_flag(False)}, chr(10)
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS per_card
  FROM lines GROUP BY l_orderkey)"""
    zone_text = ("CASE WHEN per.n_zone_sets = 1 THEN '  - All permanants must be ' || per.single_phrase "
                 "WHEN per.n_zone_sets > 1 THEN per.per_card END")
    other = ("CASE o_orderstatus WHEN 'O' THEN '  - Keep priority ' || o_orderpriority "
             "WHEN 'P' THEN '  - Hold two mana open' || chr(10) || '  - Priority ' || o_orderpriority END")
    prereq = f"concat_ws(chr(10), {zone_text}, {other})"
    names = "coalesce(per.names, '')"
    answer = (f"{start} || 'This combo can be formed with ' || {names} || chr(10) || chr(10) || "
              f"'Color identity: ' || o_orderstatus || chr(10) || 'Mana cost: ' || o_orderpriority || chr(10) || "
              f"'Steps:' || chr(10) || coalesce(per.steps, '') || {end_steps} || chr(10) || chr(10) || "
              f"'Result:' || chr(10) || coalesce(per.feats, '') || {end_result} || {end_combo} || "
              f"CASE WHEN {prereq} <> '' THEN chr(10) || chr(10) || 'Other prerequisites:' || chr(10) || "
              f"{prereq} || chr(10) || {end_prereq} ELSE '' END")
    return (f"WITH {COMBO_LINES},\n{per}\n"
            f"SELECT CAST(o_orderkey AS VARCHAR) AS combo_id, "
            f"'How can you create a combo with ' || {names} || '?' AS question, {answer} AS answer "
            f"FROM orders LEFT JOIN per ON per.l_orderkey = orders.o_orderkey")


def nest_sql() -> str:
    return f"""WITH {COMBO_LINES},
per AS (
  SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS n_req,
    count(DISTINCT CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag ELSE 'N' END) AS n_zone_sets,
    string_agg(p_name, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS card_names,
    string_agg(feature, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS feature_names,
    string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS "of",
    string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS includes
  FROM lines GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS combo_id, o_orderstatus AS identity,
  coalesce(per."of", '') AS "of", coalesce(per.includes, '') AS includes,
  CAST(coalesce(per.n, 0) AS BIGINT) AS n_cards, CAST(coalesce(per.n, 0) AS BIGINT) AS n_features,
  CAST(CASE WHEN per.n_req > 0 THEN per.n_req END AS BIGINT) AS n_requires,
  CAST(coalesce(per.n_zone_sets, 0) AS BIGINT) AS n_zone_sets,
  coalesce(per.card_names, '') AS card_names, coalesce(per.feature_names, '') AS feature_names
FROM orders LEFT JOIN per ON per.l_orderkey = orders.o_orderkey"""


# --- corpus ------------------------------------------------------------------------

TT = TRAIN_TOKEN.replace("'", "''")
WT = WORD_TOKEN.replace("'", "''")
HEADER = "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)"
MESSAGE = f"({HEADER} || coalesce(text, '') || '{CHAT_END}')"
RENDER = f"""rendered AS (
  SELECT conv_id, count(*) AS n_messages,
         '{CHAT_BEGIN}' || string_agg({MESSAGE}, '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)"""


def corpus_union_sql() -> str:
    return f"""WITH {CANON},
pairs AS ({qa_sql(False)}),
allpairs AS (
  SELECT 'cards' AS "group", 0 AS train_order, builder, question, answer FROM pairs
  UNION ALL
  SELECT 'rules', 1, 'supplier_nation', 'Which nation is ' || s_name || ' based in?', n_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'rules', 1, 'customer_segment', 'What market segment is ' || c_name || ' in?', c_mktsegment
  FROM customer
  UNION ALL
  SELECT 'combos', 2, 'combo', question, answer FROM ({combo_qa_sql()}) c)"""


def _token_truncate() -> str:
    return f"""WITH {RENDER},
t AS (SELECT conv_id, regexp_extract_all(text, '{TT}') AS toks FROM rendered)
SELECT conv_id, CAST(len(toks) AS BIGINT) AS n_tokens,
       CAST(len(toks[1:{Q.MAX_SEQ_LEN}]) AS BIGINT) AS n_kept,
       array_to_string(toks[1:{Q.MAX_SEQ_LEN}], ' ') AS kept_text
FROM t"""


def _response_mask() -> str:
    return f"""WITH t AS (
  SELECT conv_id, role,
         len(regexp_extract_all({MESSAGE}, '{TT}')) AS n_tok,
         len(regexp_extract_all({HEADER}, '{TT}')) AS n_head
  FROM conversations)
SELECT conv_id, CAST(sum(n_tok) + 1 AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN role = 'assistant' THEN n_tok - n_head ELSE 0 END) AS BIGINT) AS n_trainable
FROM t GROUP BY conv_id"""


def _response_labels() -> str:
    n = Q.LABEL_LEN
    return f"""WITH t AS (
  SELECT conv_id, turn, role, regexp_extract_all({MESSAGE}, '{TT}') AS toks,
         len(regexp_extract_all({HEADER}, '{TT}')) AS n_head FROM conversations),
l AS (SELECT *, list_transform(range(len(toks)), lambda i: CASE WHEN role = 'assistant' AND i >= n_head THEN 1 ELSE -100 END) AS lab FROM t),
c AS (SELECT conv_id, list_concat(['{CHAT_BEGIN}'], flatten(list(toks ORDER BY turn, toks))) AS toks,
             list_concat([-100], flatten(list(lab ORDER BY turn, toks))) AS lab FROM l GROUP BY conv_id)
SELECT conv_id, CAST(len(toks[1:{n}]) AS BIGINT) AS n_kept, array_to_string(toks[1:{n}], ' ') AS tokens,
       array_to_string(lab[1:{n}], ' ') AS labels FROM c"""


def _padded_batches() -> str:
    return rf"""WITH {RENDER},
e AS (SELECT conv_id, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+')[1:{Q.MAX_SEQ_LEN}],
        lambda w: CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) + 1) AS ids FROM rendered),
p AS (SELECT conv_id, ids, CAST(len(ids) AS BIGINT) AS n_tokens, row_number() OVER (ORDER BY len(ids), conv_id) - 1 AS pos FROM e),
b AS (SELECT *, CAST(pos // {Q.BATCH_ROWS} AS BIGINT) AS batch, CAST(pos % {Q.BATCH_ROWS} AS BIGINT) AS slot,
        max(n_tokens) OVER (PARTITION BY pos // {Q.BATCH_ROWS}) AS width FROM p)
SELECT batch, slot, conv_id, n_tokens, width,
       array_to_string(list_concat(ids, list_transform(range(width - n_tokens), lambda i: 0)), ',') AS input_ids,
       repeat('1', n_tokens) || repeat('0', width - n_tokens) AS attention_mask FROM b"""


def _marker_tokens() -> str:
    marks = "[" + ", ".join(lit(m) for m in MARKERS) + "]"
    return f"""WITH m AS (SELECT conv_id, turn, {marks} AS marks,
  substr(text, 1, 20) || {marks}[turn % {len(MARKERS)} + 1] || substr(text, 21) AS x FROM conversations WHERE text IS NOT NULL),
t AS (SELECT conv_id, turn, marks, regexp_extract_all(x, '{TT}') AS toks FROM m)
SELECT conv_id, turn, CAST(len(toks) AS BIGINT) AS n_tokens,
       CAST(len(list_filter(toks, lambda c: list_contains(marks, c))) AS BIGINT) AS n_markers, array_to_string(toks, ' ') AS tokens FROM t"""


def md5_bucket(x: str, n: int | str) -> str:
    return f"((('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8))::BIGINT) % {n})"


_PACKED = f"""d AS (SELECT doc_id, list_concat(coalesce(regexp_extract_all(lower(text), '{WT}'), []), ['{CHAT_END}']) AS toks
      FROM documents),
o AS (SELECT *, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(coalesce(sum(len(toks)) OVER (
        ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
      FROM d)"""


# --- retrieval ---------------------------------------------------------------------

BM25_BASE = f"""dt AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{WT}') AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(CASE WHEN len(toks) > 0 THEN len(toks) END) AS avgdl FROM dt),
post AS (SELECT token, id, dl, count(*) AS tf FROM (
           SELECT id, len(toks) AS dl, unnest(toks) AS token FROM dt) GROUP BY token, id, dl),
tdf AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""


def _bm25_scores(queries_sql: str) -> str:
    return f"""qt AS (SELECT query_id, token, count(*) AS qn FROM (
           SELECT query_id, unnest(regexp_extract_all(lower(text), '{WT}')) AS token FROM ({queries_sql}))
         GROUP BY query_id, token),
sc AS (
  SELECT qt.query_id, p.id,
    round(sum(qt.qn * ln((s.n + 1.0) / (t.df + 0.5)) * 2.5 *
      ((p.tf / (1 - 0.75 + 0.75 * p.dl / s.avgdl)) + 0.5) /
      (1.5 + (p.tf / (1 - 0.75 + 0.75 * p.dl / s.avgdl)) + 0.5)), 6) AS score
  FROM qt JOIN tdf t ON qt.token = t.token JOIN post p ON p.token = qt.token CROSS JOIN stats s
  GROUP BY qt.query_id, p.id)"""


def _topk(src: str, k: int = Q.TOP_K) -> str:
    return (f"SELECT query_id, CAST(rank AS BIGINT) AS rank, id, score FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank "
            f"FROM {src}) WHERE rank <= {k}")


QUERIES_ALL = "SELECT item_id AS query_id, text FROM benchmark"


def _dense(where: str = "") -> str:
    return f"""qv AS (SELECT b.item_id AS query_id, e.embedding FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id),
vv AS (SELECT vec_id AS id, embedding FROM embeddings {where}),
ds AS (SELECT qv.query_id, vv.id,
         round(list_inner_product(qv.embedding::DOUBLE[], vv.embedding::DOUBLE[]), 6) AS score
       FROM qv CROSS JOIN vv)"""


def _hybrid_cte() -> str:
    return f"""{BM25_BASE},
{_bm25_scores(QUERIES_ALL)},
{_dense("WHERE vec_id IN (SELECT doc_id FROM documents)")},
bm AS ({_topk('sc')}),
dn AS ({_topk('ds')}),
u AS (SELECT query_id, id, score, 0 AS src FROM bm UNION ALL SELECT query_id, id, score, 1 FROM dn),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY src) AS d FROM u)
       WHERE d = 1),
hy AS (SELECT query_id, CAST(rank AS BIGINT) AS rank, id, score,
              CASE src WHEN 0 THEN 'bm25' ELSE 'embedding' END AS retriever FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, id) AS rank FROM dd)
       WHERE rank <= {Q.TOP_K})"""


def _formatted_cte(ranked: str = "") -> str:
    content_lines = lines("d.text")
    extra = ("['Mana Cost: ' || d.source, 'Coverted Mana Cost (cmc): ' || CAST(d.n_chars AS VARCHAR), "
             "'Color Identity: ' || d.lang, 'Rarity: ', chr(10)]")
    return f"""{ranked or _hybrid_cte()},
fmt AS (SELECT hy.query_id, hy.rank,
   'Relevancy Score: ' || CAST(CAST(round(hy.score, 6) AS DECIMAL(38, 2)) AS VARCHAR) || chr(10) ||
   array_to_string(list_concat({content_lines}, {extra}), chr(10)) AS formatted
  FROM hy JOIN documents d ON d.doc_id = hy.id)"""


def _fuzzy() -> str:
    """Best partial ratio: over all windows of the longer string, 200 * LCS / (lengths),
    the LCS by its bit-parallel recurrence (a step a character of the window)."""
    return f"""WITH {PRINTINGS},
nm AS (SELECT name, min(uuid) AS uuid FROM printings WHERE name IS NOT NULL GROUP BY name),
qs AS (SELECT DISTINCT CAST(('0x' || substr(md5(p_name), 1, 12)) AS BIGINT) AS query_id,
              translate(p_name, 'aeiou', 'eioua') AS text FROM part),
pr AS (SELECT query_id, uuid, name, length(text) <= length(name) AS q_short, string_split(text, '') AS qc,
              string_split(name, '') AS nc FROM qs, nm WHERE length(text) > 0),
st AS (SELECT query_id, uuid, name, CASE WHEN q_short THEN qc ELSE nc END AS s, CASE WHEN q_short THEN nc ELSE qc END AS t FROM pr),
mk AS (SELECT query_id, uuid, name, len(s) AS m, len(t) AS n, (1::HUGEINT << len(s)) - 1 AS every,
        list_transform(t, lambda c: list_sum(list_transform(range(len(s)), lambda i:
          CASE WHEN s[i + 1] = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT) AS masks FROM st),
wn AS (SELECT query_id, uuid, name, m, every, masks[greatest(i, 0) + 1:least(i + m, n)] AS w
       FROM (SELECT *, unnest(range(1 - m, n)) AS i FROM mk)),
sc AS (SELECT query_id, uuid, name, max(200.0::DOUBLE * (m - bit_count(list_reduce(list_prepend(every, w), lambda v, x:
          ((v + (v & x)) | (v - (v & x))) & every))) / (m + len(w))) AS score
       FROM wn GROUP BY query_id, uuid, name)
SELECT query_id, uuid AS match_key, name AS match_name, round(score, 6) AS score FROM sc
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uuid) = 1"""


def _prompt_batch() -> str:
    """Filtered lexical search, formatted, as context of a prompt without history."""
    ranked = f"""{BM25_BASE},
{_bm25_scores(QUERIES_ALL)},
f AS (SELECT * FROM sc WHERE id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars <= 20000)),
hy AS ({_topk('f')})"""
    extra = lit("." + RAG_PREAMBLE + RAG_JOIN)
    return f"""WITH {_formatted_cte(ranked)},
ctx AS (SELECT query_id, string_agg(formatted, chr(10) ORDER BY rank) AS context FROM fmt GROUP BY query_id),
q AS ({QUERIES_ALL})
SELECT q.query_id, 0::BIGINT AS msg_index, 'system' AS role, {lit(SYSTEM_PROMPT)} ||
       CASE WHEN coalesce(length(ctx.context), 0) > 0 THEN {extra} || ctx.context ELSE '' END AS content
FROM q LEFT JOIN ctx ON ctx.query_id = q.query_id
UNION ALL
SELECT query_id, 1::BIGINT, 'user', text FROM q"""


def _prompt() -> str:
    system = lit(SYSTEM_PROMPT)
    extra = lit("." + RAG_PREAMBLE + RAG_JOIN)
    return f"""WITH {_formatted_cte()},
ctx AS (SELECT query_id, string_agg(formatted, chr(10) ORDER BY rank) AS context FROM fmt GROUP BY query_id),
q AS ({QUERIES_ALL}),
hist AS (SELECT conv_id AS query_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT)
                AS msg_index, role, text AS content
         FROM conversations WHERE conv_id IN (SELECT query_id FROM q)),
nh AS (SELECT query_id, count(*) AS n FROM hist GROUP BY query_id)
SELECT * FROM hist
UNION ALL
SELECT q.query_id, CAST(coalesce(nh.n, 0) AS BIGINT), 'system',
       {system} || CASE WHEN coalesce(length(ctx.context), 0) > 0 THEN {extra} || ctx.context ELSE '' END
FROM q LEFT JOIN nh ON nh.query_id = q.query_id LEFT JOIN ctx ON ctx.query_id = q.query_id
UNION ALL
SELECT q.query_id, CAST(coalesce(nh.n, 0) + 1 AS BIGINT), 'user', q.text
FROM q LEFT JOIN nh ON nh.query_id = q.query_id"""


def _doc_content() -> str:
    def lab(label: str, c: str) -> str:
        return f"'{label}' || {c}"
    pt = ("CASE WHEN power IS NOT NULL AND toughness IS NOT NULL THEN 'Power/Toughness: ' || power || '/' || toughness "
          "WHEN power IS NOT NULL THEN 'Power: ' || power WHEN toughness IS NOT NULL THEN 'Toughness: ' || toughness END")
    content = (f"concat_ws(chr(10), {lab('Card Name: ', 'name')}, {lab('Mana Cost: ', 'manaCost')}, "
               f"{lab('Type: ', 'type')}, {lab('Card Text: ', 'text')}, {pt}, {lab('Loyalty: ', 'loyalty')}, "
               f"{lab('Side: ', 'side')})")
    e = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
    return f"""WITH {CANON}
SELECT uuid AS id, {content} AS content, {e('name')} AS meta_name, {e('manaCost')} AS meta_mana_cost,
  CAST(cmc AS DOUBLE) AS meta_cmc, {e('colorIdentity')} AS meta_color_identity, {e('type')} AS meta_type,
  {e('power')} AS meta_power, {e('toughness')} AS meta_toughness, {e('rarity')} AS meta_rarity,
  {e('loyalty')} AS meta_loyalty, {e('side')} AS meta_side
FROM cards"""


def _code_contains() -> str:
    parts = []
    colors = {"WHITE": "W", "BLUE": "U", "BLACK": "B", "RED": "R", "GREEN": "G", "COLORLESS": "C"}
    for kind, term in Q.CODE_SEARCHES:
        if kind == "identity":
            col, needle = "colorIdentity", term.upper()
        elif kind == "mana_cost":
            col, needle = "manaCost", term.upper()
        else:
            col, needle = "colors", colors.get(term.upper(), term.upper())
        parts.append(f"SELECT '{kind}' AS search, '{term}' AS term, uuid FROM cards "
                     f"WHERE coalesce(contains(upper({col}), '{needle}'), false)")
    return f"WITH {CANON}\n" + "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    compat_in = ", ".join(f"'{b}'" for b in Q.COMPAT_BUILDERS)
    return {
        "canonical_rows": f"WITH {CANON}\nSELECT {', '.join(Q.A.CANONICAL_OUT)} FROM canon",
        "string_agg": f"""WITH {RULINGS}
SELECT uuid, CAST(count(*) AS BIGINT) AS n_rulings, string_agg(text, chr(10) ORDER BY text) AS rulings
FROM rul GROUP BY uuid""",
        "typed_numeric": f"""WITH {PRINTINGS}
SELECT uuid, manaValue, {to_int('manaValue')} AS cmc,
  coalesce(TRY_CAST(manaValue AS DOUBLE) <> floor(TRY_CAST(manaValue AS DOUBLE)), false) AS bad_numeric
FROM printings""",
        "normalize_codes": f"""WITH {PRINTINGS}
SELECT uuid, colors, replace(replace(colors, ',', ''), ' ', '') AS stripped,
  regexp_replace(manaCost, '[\\[\\](){{}}]', '', 'g') AS mana_plain,
  {norm_code('colorIdentity')} AS identity,
  array_to_string(string_split_regex(colors, ', *'), '|') AS colors_pipe,
  array_to_string(str_split(colors, ''), '|') AS colors_pipe_compat
FROM printings""",
        "identity_name": f"""WITH {PRINTINGS},
n AS (SELECT uuid, {norm_code('colorIdentity')} AS identity FROM printings)
SELECT uuid, identity,
  CASE WHEN identity IS NULL THEN 'Colorless'
       ELSE {identity_map("CASE WHEN identity = '' THEN 'C' ELSE identity END")} END AS identity_name,
  {identity_map("CASE WHEN identity = '' THEN 'C' ELSE identity END")} AS identity_name_compat
FROM n""",
        "face_name": f"WITH {PRINTINGS}\nSELECT uuid, name, side, {face()} AS face_name FROM printings",
        "ordinal_lines": f"""SELECT doc_id, CAST(len({lines('text')}) AS BIGINT) AS n_lines,
  {ordinal('text', 0)} AS rulings_form, {ordinal('text', 1, '  ')} AS steps_form FROM documents""",
        "null_predicates": """WITH t AS (SELECT p_partkey AS uuid,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE p_type END AS value FROM part)
SELECT uuid, value, value IS NULL AS is_null, value IS NOT NULL AS is_not_null,
  value IS DISTINCT FROM '' AS ne_keep_null, coalesce(value <> '', false) AS ne_sql FROM t""",
        "lookup_by_key": f"""WITH {CANON},
firsts AS (SELECT name, min(uuid) AS uuid FROM cards GROUP BY name)
SELECT 'by_id' AS lookup, CAST(r.req AS VARCHAR) AS request, c.uuid, c.name
FROM (SELECT DISTINCT l_partkey AS req FROM lineitem) r JOIN cards c ON r.req = c.uuid
UNION ALL
SELECT 'by_name', r.req, f.uuid, f.name
FROM (SELECT DISTINCT name AS req FROM printings) r JOIN firsts f ON r.req = f.name
UNION ALL
SELECT 'by_cmc', CAST(r.req AS VARCHAR), c.uuid, c.name
FROM (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS req FROM lineitem) r JOIN cards c ON r.req = c.cmc""",
        "code_contains": _code_contains(),
        "type_contains": f"""WITH {CANON}
SELECT 'type_substring' AS search, uuid FROM cards WHERE coalesce(contains(upper(type), 'LAND'), false)
UNION ALL SELECT 'type_word', uuid FROM cards WHERE coalesce(regexp_matches(type, '(?i)\\bLand\\b'), false)
UNION ALL SELECT 'split_name', uuid FROM cards WHERE coalesce(contains(name, '//'), false)
UNION ALL SELECT 'name_bolt', uuid FROM cards WHERE coalesce(contains(name, 'bolt'), false)""",
        "distinct_sorted": f"WITH {CANON}\nSELECT DISTINCT cmc FROM cards WHERE cmc IS NOT NULL ORDER BY cmc",
        "value_counts": """SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY n DESC, event_type""",
        "nest_roundtrip": nest_sql(),
        "combo_qa": combo_qa_sql(),
        "qa_template_fanout": f"WITH {CANON}\n{qa_sql(False)}",
        "qa_null_branch": f"WITH {CANON}\nSELECT * FROM ({qa_sql(True)}) WHERE builder IN ({compat_in})",
        "qa_union_groups": f"""{corpus_union_sql()}
SELECT "group", train_order, builder, CAST(count(*) AS BIGINT) AS n_pairs,
  CAST(sum(length(question) + length(answer)) AS BIGINT) AS n_chars
FROM allpairs GROUP BY "group", train_order, builder""",
        "corpus_store": f"""{corpus_union_sql()},
two AS (SELECT *, count(*) OVER (PARTITION BY "group") AS n_rows FROM allpairs WHERE "group" IN ('rules', 'combos'))
SELECT "group", builder, n_rows, 0::BIGINT AS turn, 'user' AS role, question AS content FROM two
UNION ALL SELECT "group", builder, n_rows, 1::BIGINT, 'assistant', answer FROM two""",
        "corpus_counts": f"""{corpus_union_sql()}
SELECT "group", CAST(count(*) AS BIGINT) AS n_pairs,
  CAST(sum(length(question) + length(answer)) AS BIGINT) AS n_chars
FROM allpairs GROUP BY "group\"""",
        "chat_render": f"WITH {RENDER}\nSELECT conv_id, CAST(n_messages AS BIGINT) AS n_messages, text FROM rendered",
        "token_truncate": _token_truncate(),
        "response_mask": _response_mask(),
        "hash_split": f"""SELECT conv_id, turn,
  CASE WHEN {md5_bucket('conv_id', 100)} < 20 THEN 'test' ELSE 'train' END AS split FROM conversations""",
        "exact_split": """WITH g AS (SELECT conv_id, coalesce(md5('k' || CAST(conv_id AS VARCHAR)), md5('n')) AS h, count(*) AS n
  FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT v.conv_id, v.turn, CASE WHEN c.before < (SELECT ceil(count(*) / 5.0) FROM conversations) THEN 'test' ELSE 'train' END AS split
FROM conversations v JOIN c ON v.conv_id IS NOT DISTINCT FROM c.conv_id""",
        "pack_sequences": f"""WITH {_PACKED}
SELECT doc_id, n_tokens, "offset",
  CAST(floor("offset" / {Q.MAX_SEQ_LEN}) AS BIGINT) AS first_block,
  CAST(floor(("offset" + n_tokens - 1) / {Q.MAX_SEQ_LEN}) AS BIGINT) AS last_block FROM o""",
        "pack_contents": f"""WITH {_PACKED},
t AS (SELECT "offset" + unnest(range(len(toks))) AS g, unnest(toks) AS tok FROM o)
SELECT CAST(floor(g / {Q.MAX_SEQ_LEN}) AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS n_tokens,
  string_agg(tok, ' ' ORDER BY g) AS tokens FROM t GROUP BY 1""",
        "doc_content": _doc_content(),
        "bm25_stats": f"""WITH {BM25_BASE}
SELECT token, df, round(ln((s.n + 1.0) / (df + 0.5)), 6) AS idf FROM tdf CROSS JOIN stats s""",
        "bm25_topk": f"WITH {BM25_BASE},\n{_bm25_scores(QUERIES_ALL)}\n{_topk('sc')}",
        "dense_topk": f"WITH {_dense()}\n{_topk('ds')}",
        "cell_search": f"WITH {_dense()}\n{_topk('ds')}",
        "filtered_search": f"""WITH {BM25_BASE},
{_bm25_scores(QUERIES_ALL)},
ok AS (SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'de') AND n_chars <= 20000),
f AS (SELECT * FROM sc WHERE id IN (SELECT id FROM ok))
{_topk('f')}""",
        "response_labels": _response_labels(),
        "marker_tokens": _marker_tokens(),
        "padded_batches": _padded_batches(),
        "index_search": f"WITH {BM25_BASE},\n{_bm25_scores(QUERIES_ALL)}\n{_topk('sc')}",
        "prompt_batch": _prompt_batch(),
        "fuzzy_match": _fuzzy(),
        "hybrid_search": f"WITH {_hybrid_cte()}\nSELECT * FROM hy",
        "format_results": f"WITH {_formatted_cte()}\nSELECT query_id, rank, formatted FROM fmt",
        "prompt_messages": _prompt(),
    }
