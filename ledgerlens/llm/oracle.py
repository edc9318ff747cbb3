"""SQL for the text queries, where SQL can state their results (8, 10, 11, 12, 13).

Not here: packing (1), a trained model (2, 3, 5), hash trees (4), merges (6), signatures (7), byte strings (9).
Their tests hold plain versions instead.
"""

from __future__ import annotations

from ledgerlens.llm import url_filter
from ledgerlens.llm.queries import RULES

ORACLE: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLE["op8_decontamination"] = f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, w[k:k + n - 1] AS g FROM (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM iw WHERE len(w) > 0)),
places AS (SELECT r, k, n, w[k:k + n - 1] AS g FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
met AS (SELECT r, item, k, n FROM places JOIN win USING (g, n)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM met) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN found USING (r)"""


def _rule(value: str) -> str:
    """The longest rule that fits, or its verdict."""
    cases = []
    for verdict, rule in sorted(RULES, key=lambda x: -len(x[1])):
        host, _, path = rule.partition("/")
        shown = rule if value == "rule" else verdict
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{shown}'")
    return "CASE " + " ".join(cases) + " END"


def _urls() -> str:
    order, steps, size = url_filter.ORDER, url_filter.STEPS, len(url_filter.ALPHABET)
    fold = (
        f"repeat('^', {order}) || regexp_replace(regexp_replace(lower(coalesce(url, '')), '[0-9]', '0', 'g'), "
        "'[^a-z0/.\\-_?=&#%:+]', '~', 'g') || '^'"
    )
    grams = lambda table, extra="": (
        f"SELECT {extra} substr(t, CAST(k AS INTEGER), {order + 1}) AS gram FROM "
        f"(SELECT *, unnest(range(1, length(t) - {order} + 1)) AS k FROM (SELECT *, {fold} AS t FROM {table}))"
    )
    parts = [
        "cut AS (SELECT row_number() OVER () AS r, page_id, url, CASE WHEN position('://' IN url) > 0 "
        "THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest FROM pages)",
        "split AS (SELECT *, coalesce(regexp_extract(rest, '^[^/]*'), '') AS raw_host FROM cut)",
        f"named AS (SELECT r, page_id, url, translate(raw_host, '{_UPPER}', '{_LOWER}') AS host, "
        "coalesce(substr(rest, length(raw_host) + 1), '') AS path FROM split)",
        f"ruled AS (SELECT *, {_rule('rule')} AS rule, {_rule('verdict')} AS ruling FROM named)",
        "examples AS (SELECT DISTINCT coalesce(url, '') AS url, ruling = 'allow' AS accepted FROM ruled WHERE rule IS NOT NULL)",
        "sided AS (SELECT *, CAST('0x' || substr(md5(url), 1, 4) AS INTEGER) % 5 = 0 AS held FROM examples)",
        "train AS (SELECT * FROM sided WHERE NOT held)",
        "tested AS (SELECT * FROM sided WHERE held)",
        f"seen AS ({grams('train', 'accepted,')})",
        "counts AS (SELECT gram, CAST(count(*) FILTER (accepted) AS DOUBLE) AS yes, CAST(count(*) FILTER (NOT accepted) AS DOUBLE) AS no FROM seen GROUP BY 1)",
        f"page_grams AS ({grams('ruled', 'r,')})",
        f"test_grams AS ({grams('tested', 'url, accepted,')})",
        f"l AS (SELECT gram, {1.0 / size!r}::DOUBLE AS yes, {1.0 / size!r}::DOUBLE AS no FROM (SELECT gram FROM page_grams UNION SELECT gram FROM test_grams))",
    ]
    below = "l"
    for k in range(order + 1):
        parts += [
            f"t{k} AS (SELECT right(gram, {k + 1}) AS g, sum(yes) AS yes, sum(no) AS no FROM counts GROUP BY 1)",
            f"x{k} AS (SELECT left(g, {k}) AS c, sum(yes) AS yes, sum(no) AS no, count(*) FILTER (yes > 0) AS k_yes, count(*) FILTER (no > 0) AS k_no FROM t{k} GROUP BY 1)",
        ]
        p = lambda s: (
            f"CASE WHEN coalesce(x.{s}, 0) > 0 THEN (coalesce(t.{s}, 0) + x.k_{s} * b.{s}) / (x.{s} + x.k_{s}) ELSE b.{s} END AS {s}"
        )
        parts.append(
            f"l{k} AS (SELECT b.gram, {p('yes')}, {p('no')} FROM {below} b LEFT JOIN t{k} t ON right(b.gram, {k + 1}) = t.g "
            f"LEFT JOIN x{k} x ON left(right(b.gram, {k + 1}), {k}) = x.c)"
        )
        below = f"l{k}"
    mean = f"avg(ln({below}.yes) - ln({below}.no))"
    parts += [
        f"test_scores AS (SELECT url, accepted, {mean} AS score FROM test_grams JOIN {below} USING (gram) GROUP BY 1, 2)",
        f"bins AS (SELECT accepted, least(greatest(floor((score + 2) * {steps / 4}), 0), {steps - 1}) AS bin FROM test_scores)",
        f"tried AS (SELECT edge, (SELECT count(*) FROM bins WHERE accepted AND bin >= edge) / (SELECT greatest(count(*), 1) FROM bins WHERE accepted) - "
        f"(SELECT count(*) FROM bins WHERE NOT accepted AND bin >= edge) / (SELECT greatest(count(*), 1) FROM bins WHERE NOT accepted) AS gain FROM range({steps}) e(edge))",
        f"best AS (SELECT edge * 4.0::DOUBLE / {steps} - 2 AS threshold FROM tried ORDER BY round(gain, 9) DESC, abs(edge - {steps // 2}), edge LIMIT 1)",
        f"scored AS (SELECT r, {mean} AS score FROM page_grams JOIN {below} USING (gram) GROUP BY 1)",
    ]
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) "
        "AS verdict, round(score, 6) AS score, round(threshold, 6) AS threshold FROM ruled JOIN scored USING (r), best"
    )


ORACLE["op10_url_filter"] = _urls()

# CRC-32 by bytes, with its table of 256 from the polynomial.
_CRC_TABLE = (
    "crc AS (SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps "
    "FROM range(256) t(b))"
)


def _crc32(text: str) -> str:
    code = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(1, length({code}), 2), lambda i: CAST('0x' || substr({code}, CAST(i AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce([4294967295::BIGINT] || {bytes_}, lambda c, x: xor(steps[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"


ORACLE["op11_importance_resampling"] = f"""
WITH {_CRC_TABLE},
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
each_d AS (SELECT r, unnest(w) AS word FROM dw),
each_b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
buckets AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM each_d UNION SELECT word FROM each_b), crc),
s AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS s FROM each_d JOIN buckets USING (word) GROUP BY 1),
t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM each_b JOIN buckets USING (word) GROUP BY 1),
totals AS (SELECT (SELECT count(*) FROM each_d) + 10000.0::DOUBLE AS all_s, (SELECT count(*) FROM each_b) + 10000.0::DOUBLE AS all_t),
gains AS (SELECT word, floor(1000 * ln(((coalesce(t, 0) + 1) * all_s) / ((coalesce(s, 0) + 1) * all_t))) AS gain
  FROM buckets LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
sums AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM each_d JOIN gains USING (word) GROUP BY 1),
scored AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) +
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM dw LEFT JOIN sums USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE n_features >= 20
  QUALIFY rank <= count(*) OVER () * 10 // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (r)"""

_SHINGLES = rf"""dw AS (SELECT row_number() OVER () AS r, doc_id,
  coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (SELECT DISTINCT r, array_to_string(w[k:k + n - 1], ' ') AS g FROM (
  SELECT r, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS k FROM dw WHERE len(w) > 0))"""

ORACLE["op12_ngram_join"] = f"""
WITH RECURSIVE {_SHINGLES},
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY 1),
-- Equal sets are met as one, by their lowest row.
sets AS (SELECT min(r) AS s, any_value(n) AS n, list(r) AS rows_ FROM (SELECT r, list(g ORDER BY g) AS whole, count(*) AS n FROM grams GROUP BY 1) GROUP BY whole),
one AS (SELECT s, g FROM sets JOIN grams ON r = s),
common AS (SELECT a.s AS a, b.s AS b, count(*) AS both_ FROM one a JOIN one b ON a.g = b.g AND a.s < b.s GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sets x ON a = x.s JOIN sets y ON b = y.s WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT s, s AS t FROM sets UNION SELECT reached.s, b FROM reached JOIN both_ways ON t = a),
classes AS (SELECT s, min(t) AS label FROM reached GROUP BY 1),
members AS (SELECT unnest(rows_) AS r, label FROM sets JOIN classes USING (s)),
lowest AS (SELECT label, min(doc_id) AS component_id FROM members JOIN dw USING (r) GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM dw LEFT JOIN sizes USING (r) LEFT JOIN members USING (r) LEFT JOIN lowest USING (label)"""

_NEVER = "{'cost': 1000000000::BIGINT, 'audit': '~'}"
_NEXT = {"start": "u", "s": "u", "a": "u", "u": "a"}


def _chosen(edits: list[str]) -> str:
    return f"list_min([{', '.join(edits)}])" if len(edits) > 1 else edits[0]


def _plus(state: str, cost: str, edits: str) -> str:
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{edits}'}}"


def _turn(x: str, acc: str) -> dict[str, str]:
    """States of the grammar after a row, cheapest (cost, audit) of each: the row's edit, then what is inserted."""
    out = {k: [_plus(f"{acc}.{k}", "3", "D")] for k in _NEXT}
    edit = lambda state, cost, letter, when: f"CASE WHEN {when} THEN {_plus(f'{acc}.{state}', cost, letter)} ELSE {_NEVER} END"
    for state, symbol in _NEXT.items():
        out[symbol].append(edit(state, f"{x}.cut", "K", f"NOT {x}.gone AND {x}.i = '{symbol}'"))
        out[symbol].append(edit(state, f"2 + {x}.cut", "R", f"NOT {x}.gone AND {x}.i <> '{symbol}'"))
    out["s"].append(edit("start", f"{x}.cut", "K", f"NOT {x}.gone AND {x}.i = 's'"))
    return {k: _chosen(v) for k, v in out.items()}


def _inserted(acc: str) -> dict[str, str]:
    once = lambda *states: [_plus(f"{acc}.{s}", "2", "I") for s in states]
    twice = [_plus(f"{acc}.{s}", "4", "II") for s in ("start", "s")]
    return {"start": f"{acc}.start", "s": f"{acc}.s", "u": _chosen([f"{acc}.u", *once("start", "s", "a")]), "a": _chosen([f"{acc}.a", *once("u"), *twice])}


def _struct(states: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in states.items()) + "}"


def _repairs() -> str:
    first = _struct({k: "{'cost': 0::BIGINT, 'audit': ''}" if k == "start" else _NEVER for k in _NEXT})
    blank_row = "{'i': '', 'gone': false, 'cut': 0::BIGINT}"
    white = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM raw WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS p,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen, substr(role, 1, 1) AS i FROM rows_),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{white}') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '({white})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS before FROM placed),
held AS (SELECT conv_id, list(role ORDER BY p) AS roles, list(text ORDER BY p) AS texts, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'i': i, 'gone': fault IN ('blank', 'duplicate'), 'cut': CAST(fault = 'truncated' AS BIGINT)}} ORDER BY p) AS turns FROM faulty GROUP BY conv_id),
step AS (
  SELECT conv_id, turns, 0 AS done, {_struct(_inserted('s0'))} AS acc FROM (SELECT conv_id, turns, {first} AS s0 FROM held)
  UNION ALL
  SELECT conv_id, turns, done + 1, {_struct(_inserted('s1'))} FROM (
    SELECT conv_id, turns, done, {_struct(_turn('x', 'acc'))} AS s1 FROM (SELECT *, coalesce(turns[done + 1], {blank_row}) AS x FROM step WHERE done < len(turns)))),
best AS (SELECT conv_id, list_min([acc.start, acc.a]) AS e FROM step WHERE done = len(turns)),
edits AS (SELECT conv_id, e.audit AS audit, unnest(range(1, length(e.audit) + 1)) AS k FROM best),
letters AS (SELECT conv_id, k, audit[k] AS letter, len(regexp_replace(audit[1:k], 'I', '', 'g')) AS row,
  len(regexp_replace(audit[1:k], 'D', '', 'g')) AS made FROM edits),
named AS (SELECT conv_id, k, letter, roles[row] AS role, texts[row] AS text, made,
  max(CASE WHEN letter = 'K' AND substr(roles[row], 1, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM letters JOIN held USING (conv_id)),
lines AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role ELSE CASE WHEN (made - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' ||
  CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body FROM named WHERE letter <> 'D' GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN held USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN lines USING (conv_id)"""


ORACLE["op13_conversation_repair"] = _repairs()
