"""Pieces of the SQL that DuckDB runs to check queries. Written out beside the Spark code, not made from its plans."""

from __future__ import annotations

from ..functions import vocabulary as V

NONE = "[]::VARCHAR[]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(text: str) -> str:
    return "[" + ", ".join(map(quoted, text.split())) + "]"


def word_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {words(v)}" for k, v in table.items()) + "}"


def lookup(table: dict[str, str], key: str) -> str:
    return f"coalesce(map_extract_value({word_map(table)}, {key}), {NONE})"


def normalize(c: str) -> str:
    for pattern, new in ((r"([a-z])([A-Z])", r"\1 \2"), (r"([A-Za-z])(\d)", r"\1 \2"), (r"(\d)([A-Za-z])", r"\1 \2"), ("`", " "), (r"[\[\]\(\)\{\},:;/\\|]+", " "), (r"[\._$\-]+", " ")):
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(new)}, 'g')"
    for k in sorted(V.KOREAN, key=len, reverse=True):
        c = f"replace({c}, {quoted(k)}, {quoted(f' {V.KOREAN[k]} ')})"
    return rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


def plain_tokens(c: str, normal: bool = True) -> str:
    return f"list_filter(string_split({normalize(c) if normal else c}, ' '), lambda x: x <> '')"


def grams(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) >= {n} THEN list_transform(range(1, length({t}) - {n - 2}), lambda i: substr({t}, i, {n})) ELSE {NONE} END"


def when(condition: str, *tokens: str) -> str:
    return f"CASE WHEN {condition} THEN [{', '.join(tokens)}] ELSE {NONE} END"


def expand(t: str) -> str:
    known = f"list_contains({words(' '.join(V.TOKEN_ALIAS))}, {t})"
    parts = [f"[{t}]", lookup(V.TOKEN_ALIAS, t)]
    for s in V.SUFFIXES:
        parts.append(when(f"NOT {known} AND ends_with({t}, '{s}') AND length({t}) > {len(s) + 1}", f"left({t}, length({t}) - {len(s)})", quoted(s)))
    rest = f"substr({t}, 4)"
    for prefix, new in (("src", ["'source'"]), ("dst", ["'destination'"]), ("sip", ["'source'", "'ip'"]), ("dip", ["'destination'", "'ip'"])):
        parts.append(when(f"starts_with({t}, '{prefix}') AND {t} <> '{prefix}'", *new, rest))
    parts.append(when(f"starts_with({t}, 'nat')", "'nat'"))
    parts.append(f"CASE WHEN starts_with({t}, 'nat') AND {rest} <> '' THEN list_concat([{rest}], {lookup(V.TOKEN_ALIAS, rest)}) ELSE {NONE} END")
    parts += [lookup(V.SYNONYMS, t), lookup(V.SHORT_FORMS, t)]
    parts.append(f"CASE WHEN regexp_full_match({t}, '[a-z0-9]{{4,20}}') THEN list_concat({grams(t, 3)}, {grams(t, 4)}) ELSE {NONE} END")
    return f"flatten([{', '.join(parts)}])"


def rich_tokens(c: str) -> str:
    return f"flatten(list_transform({plain_tokens(c)}, lambda tok: {expand('tok')}))"


def rule_expand(t: str) -> str:
    parts = [
        f"[{t}]",
        lookup(V.COMPACT_SPLITS, t),
        when(f"starts_with({t}, 'src') AND {t} <> 'src'", "'source'", f"substr({t}, 4)"),
        when(f"starts_with({t}, 'dst') AND {t} <> 'dst'", "'destination'", f"substr({t}, 4)"),
        when(f"starts_with({t}, 'dest') AND {t} <> 'dest'", "'destination'", f"substr({t}, 5)"),
        when(f"starts_with({t}, 'sport') AND {t} <> 'sport'", "'source'", "'port'"),
        when(f"starts_with({t}, 'dport') AND {t} <> 'dport'", "'destination'", "'port'"),
    ]
    return f"flatten([{', '.join(parts)}])"


def rule_tokens(tokens: str) -> str:
    return f"list_distinct(list_filter(flatten(list_transform(list_filter({tokens}, lambda x: x <> ''), lambda rt: {rule_expand('rt')})), lambda x: x <> ''))"


def path_tokens(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[\./_\$\[\]:]+'), lambda x: x <> ''))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"


def case_table(table: dict, key: str, default: str = "NULL") -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {quoted(k)} THEN {v if isinstance(v, float) else quoted(v)}" for k, v in table.items()) + f" ELSE {default} END"


def compatibility(table: dict[tuple[str, str], float], a: str, b: str) -> str:
    a, b = f"({a})", f"({b})"
    both = {f"{x}|{y}": v for (x, y), v in (table | {(y, x): v for (x, y), v in table.items()}).items()}
    return f"({case_table(both, f'({a} || ' + quoted('|') + f' || {b})', '0.0')})::DOUBLE"


def canonical_type(c: str) -> str:
    plain = f"regexp_replace(lower(trim({c})), '[^a-z0-9]+', '', 'g')"
    return f"coalesce({case_table({w: g for g, ws in V.TYPE_GROUPS.items() for w in ws.split()}, plain)}, {plain})"


CATALOGS = f"""
src AS (
  SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS field_id, p_name AS name, lower(p_type) AS type,
         concat_ws('.', p_brand, p_type, p_name) AS path FROM part
), tgt AS (
  SELECT row_number() OVER (ORDER BY name, type) - 1 AS pos, name || '/' || type AS field_id, name, type,
         concat_ws('.', type, name) AS path
  FROM (SELECT DISTINCT p_name AS name, lower(p_type) AS type FROM part)
), srcf AS (
  SELECT *, {plain_tokens("lower(name)", False)} AS ntok, {path_tokens("path")} AS ptok FROM src
), tgtf AS (
  SELECT *, {plain_tokens("lower(name)", False)} AS ntok, {path_tokens("path")} AS ptok FROM tgt
)"""

COMPONENTS = f"""{CATALOGS}, parts AS (
  SELECT a.pos AS src_pos, b.pos AS tgt_pos, {jaccard("a.ntok", "b.ntok")} AS name_score,
         (a.type = b.type AND a.type <> '')::INT::DOUBLE AS type_score, {jaccard("a.ptok", "b.ptok")} AS path_score
  FROM srcf a CROSS JOIN tgtf b
)"""

SCORES = f"""{COMPONENTS}, s AS (
  SELECT src_pos, tgt_pos, round(0.3::DOUBLE * name_score + 0.5::DOUBLE * type_score + 0.2::DOUBLE * path_score, 6) AS score FROM parts
)"""

TRUTH = """, t AS (SELECT a.pos AS src_pos, b.pos AS tgt_pos FROM src a JOIN tgt b ON a.name = b.name)"""

RANKED = """, r AS (
  SELECT s.src_pos, s.tgt_pos, s.score, row_number() OVER (PARTITION BY s.src_pos ORDER BY s.score DESC, s.tgt_pos) AS rank,
         t.src_pos IS NOT NULL AS relevant
  FROM s LEFT JOIN t ON s.src_pos = t.src_pos AND s.tgt_pos = t.tgt_pos
)"""


def metrics(ranked: str = "r", by: str = "") -> str:
    """The body of a SELECT of the metric bundle from a table of ranked pairs."""
    key = f"{by}, " if by else ""
    gains = lambda k: f"list_sum(list_transform(range(1, least({k}, n) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE)))"
    return f"""
SELECT {key}count(*) AS n_eval, round(avg((rank <= 1)::INT), 6) AS hit_at_1, round(avg((rank <= 3)::INT), 6) AS hit_at_3,
       round(avg((rank <= 5)::INT), 6) AS hit_at_5, round(avg(1.0::DOUBLE / rank), 6) AS mrr,
       round(avg(dcg3 / {gains(3)}), 6) AS ndcg_at_3, round(avg(dcg5 / {gains(5)}), 6) AS ndcg_at_5
FROM (
  SELECT {key}src_pos, min(rank) FILTER (relevant) AS rank, count(*) FILTER (relevant) AS n,
         sum(CASE WHEN relevant AND rank <= 3 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg3,
         sum(CASE WHEN relevant AND rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg5
  FROM {ranked} GROUP BY {key}src_pos
) WHERE rank IS NOT NULL {"GROUP BY " + by if by else ""}"""


PROBS = """, e AS (
  SELECT src_pos, tgt_pos, score, exp(score - max(score) OVER (PARTITION BY src_pos)) AS e FROM s
), p AS (
  SELECT src_pos, tgt_pos, score, e / greatest(sum(e) OVER (PARTITION BY src_pos), 1e-12) AS prob FROM e
)"""

TOPS = """, top AS (
  SELECT b.src_pos, b.tgt_pos, b.prob AS conf, CASE WHEN t.src_pos IS NULL THEN 0.0 ELSE 1.0 END AS correct
  FROM (SELECT *, row_number() OVER (PARTITION BY src_pos ORDER BY prob DESC, tgt_pos) AS k FROM p) b
  LEFT JOIN t ON b.src_pos = t.src_pos AND b.tgt_pos = t.tgt_pos WHERE b.k = 1
)"""


def ece(tops: str, binning: str) -> str:
    return f"""
SELECT round(coalesce(sum(n / total * abs(acc - c)), 0), 6) AS ece FROM (
  SELECT {binning} AS bin, count(*)::DOUBLE AS n, avg(correct) AS acc, avg(conf) AS c, (SELECT count(*) FROM {tops}) AS total
  FROM {tops} GROUP BY 1
) WHERE bin IS NOT NULL"""


#: (conf, fitted) from pooled(conf, s, n): the max over i <= k of the min over j >= k of the mean of i to j.
ISOTONIC = """, pre AS (
  SELECT conf, row_number() OVER w AS k, sum(s) OVER w AS cs, sum(n) OVER w AS cn, s, n FROM pooled WINDOW w AS (ORDER BY conf)
), spans AS (
  SELECT i.k AS i, j.k AS j, (j.cs - i.cs + i.s) / (j.cn - i.cn + i.n) AS mean FROM pre i JOIN pre j ON i.k <= j.k
), lows AS (
  SELECT i, j, min(mean) OVER (PARTITION BY i ORDER BY j DESC) AS low FROM spans
), fit AS (
  SELECT pre.conf, max(low) AS fitted FROM lows JOIN pre ON pre.k = lows.j GROUP BY pre.conf
)"""


def chance(seed: int, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def ratio(names_a: str, names_b: str) -> str:
    """CTEs that end in ratio(a, b, ratio) for all pairs of names_a(a) and names_b(b): twice the characters in matching
    blocks over all. A block is the longest of a stretch, first in a, then in b; what is left and right of it follows.

    The query must begin WITH RECURSIVE.
    """
    return f"""ra AS ({names_a}), rb AS ({names_b}), rn AS (SELECT a, b FROM ra CROSS JOIN rb),
rc AS (SELECT a, b, i, j FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM rn) CROSS JOIN LATERAL (SELECT unnest(range(1, length(b) + 1)) AS j) WHERE substr(a, i, 1) = substr(b, j, 1)),
rg AS (SELECT a, b, i, j, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS g FROM rc),
rr AS (SELECT a, b, i, j, max(i) OVER (PARTITION BY a, b, i - j, g) - i + 1 AS len FROM rg),
rs(a, b, al, ah, bl, bh, k) AS (
  SELECT a, b, 1::BIGINT, length(a) + 1, 1::BIGINT, length(b) + 1, 0::BIGINT FROM rn
  UNION ALL
  SELECT a, b, CASE side WHEN 0 THEN al ELSE i + len END, CASE side WHEN 0 THEN i ELSE ah END, CASE side WHEN 0 THEN bl ELSE j + len END, CASE side WHEN 0 THEN j ELSE bh END, CASE side WHEN 0 THEN len ELSE 0 END
  FROM (
    SELECT a, b, al, ah, bl, bh, m.len AS len, -m.i AS i, -m.j AS j
    FROM (SELECT rs.a, rs.b, al, ah, bl, bh, max({{'len': least(rr.len, ah - rr.i, bh - rr.j), 'i': -rr.i, 'j': -rr.j}}) AS m FROM rs JOIN rr ON rr.a = rs.a AND rr.b = rs.b AND rr.i >= al AND rr.i < ah AND rr.j >= bl AND rr.j < bh GROUP BY ALL)
  ), (VALUES (0), (1)) sides(side)
), ratio AS (SELECT a, b, CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 2.0::DOUBLE * sum(k) / (length(a) + length(b)) END AS ratio FROM rs GROUP BY a, b)"""
