"""Queries of scans, modes, score parts and bundles, most of them over a catalog of 25 fields that reaches every branch.

The catalog takes one field of each side from every row of nation; names, types and paths are picked by the key.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import assignment, calibration, matchers, pairs, ranking, training
from ..shared import shared_dir
from ..sources import catalog
from . import evaluation, report
from . import oracle as O
from .queries import ALTS, CHAR_TERMS, IDENTIFIERS, RULE_PAIRS, VIEW_TEXT, WORD_TERMS, base_scores, identifiers, query, table, view_lines

NAMES_A = ["srcIp", "dst_port", "sourceAddress", "destination-port", "sessionId", "userName", "usr", "proto", "event.time", "natsrc", "natdport", "ruleid", "svc", "msg", "hostName", "file_path", "macAddr", "count", "bytesIn", "bytesOut", "action", "country_cc", "출발지포트", "", "policyid"]
NAMES_B = ["source_ip", "destinationPort", "source address", "dstport", "session_id", "user", "user_id", "protocol", "timestamp", "source nat ip", "destination nat port", "rule id", "service", "message", "host", "filePath", "macAddress", "total", "in_bytes", "out_bytes", "result", "countryCode", "source port", "", "srcip"]
TYPES_A = ["ip", "port", "string", "integer", "timestamp", "", "float", "int"]
TYPES_B = ["ip", "int", "String", "port", "datetime", "bool"]


def pick(words: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.col(key) % len(words) + 1).cast("int"))


def pick_sql(words: list[str], key: str) -> str:
    return f"[{', '.join(map(O.quoted, words))}][{key} % {len(words)} + 1]"


def fields(spark, sf_dir, side: str) -> DataFrame:
    """field_id, pos, name, type, path: side a are sources, b targets."""
    names, types, top = (NAMES_A, TYPES_A, "event.") if side == "a" else (NAMES_B, TYPES_B, "log.data.")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"))
    named = n.withColumn("name", pick(names, "pos")).withColumn("type", pick(types, "pos"))
    path = F.concat(F.lit(top), F.replace("name", F.lit("_"), F.lit(".")))
    return catalog.with_optional(named.select(F.concat(F.lit(side), F.col("pos").cast("string")).alias("field_id"), "pos", "name", "type", path.alias("path")))


def both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return fields(spark, sf_dir, "a"), fields(spark, sf_dir, "b")


def fields_sql(names: list[str], types: list[str], top: str, side: str) -> str:
    return f"SELECT pos, '{side}' || pos AS field_id, name, type, '{top}' || replace(name, '_', '.') AS path FROM (SELECT n_nationkey AS pos, {pick_sql(names, 'n_nationkey')} AS name, {pick_sql(types, 'n_nationkey')} AS type FROM nation)"


FIELDS = f"src AS ({fields_sql(NAMES_A, TYPES_A, 'event.', 'a')}), tgt AS ({fields_sql(NAMES_B, TYPES_B, 'log.data.', 'b')})"
FIELD_RULES = RULE_PAIRS.replace(O.CATALOGS, FIELDS, 1)


def rounded(scores: DataFrame, digits: int = 6) -> DataFrame:
    return scores.select("src_pos", "tgt_pos", F.round("score", digits).alias("score"))


# --- scans ----------------------------------------------------------------------------------------------------------
def lines_of(df: DataFrame, value: Column, key: str = "p_partkey") -> DataFrame:
    return df.select(F.col(key).cast("long").alias("line_no"), value.alias("value"))


@query("SELECT p_partkey AS line_no, '[NAME] ' || p_name || ' [TYPE] ' || lower(p_type) || ' [PATH] ' || replace(p_brand, '#', '.') AS text FROM part WHERE p_name <> '' UNION ALL SELECT p_partkey, '[NAME] ' || p_name || ' [TYPE] ' || lower(p_type) || ' [PATH] ' || replace(p_brand, '#', '.') FROM part WHERE p_name <> ''".replace("replace(p_brand, '#', '.')", "replace(replace(p_brand, '#', '.'), '.', ' . ')"))
def training_header(spark, sf_dir):
    """CSV lines under a header with another order, a byte order mark and a quoted name; every row twice."""
    part = table(spark, sf_dir, "part").where("p_name <> ''")
    header = "\ufeffPath,\"Name\",EX,type"
    value = F.concat(F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit(',"'), F.col("p_name"), F.lit('","a, b",'), F.lower("p_type"))
    lines = spark.createDataFrame([(-1, header)], "line_no long, value string").union(lines_of(part, value))
    return catalog.parse_training(lines, header, -1, multiplier=2)


@query(
    """SELECT p_partkey AS line_no, CASE p_size % 4 WHEN 0 THEN p_name || ' ' || lower(p_type) || ' p . q . ' || p_brand || ' some text an example' WHEN 1 THEN p_name || ' ' || lower(p_type) || ' p . q . ' || p_brand || ' some text'
WHEN 2 THEN p_name || ' ' || lower(p_type) || ' p . q . ' || p_brand ELSE p_name || ',' || p_brand END AS text FROM part"""
)
def training_positional(spark, sf_dir):
    """Lines of two to five cells without a header, bound by their number."""
    part = table(spark, sf_dir, "part")
    path = F.concat(F.lit("p.q."), "p_brand")
    k = F.col("p_size") % 4
    five = F.concat_ws(",", "p_name", F.lit("some text"), path, F.lower("p_type"))
    value = F.when(k == 0, F.concat(five, F.lit(",an example"))).when(k == 1, five).when(k == 2, F.concat_ws(",", "p_name", F.lower("p_type"), path)).otherwise(F.concat_ws(",", "p_name", "p_brand"))
    return catalog.parse_training(lines_of(part, value), "no words of a head", -1, mode="context")


@query("SELECT p_partkey AS line_no, CASE p_size % 3 WHEN 0 THEN p_name || ' : ' || p_type WHEN 1 THEN '<' || p_name || ' ' || p_type || '>' ELSE '<13>' || p_name END AS text FROM part")
def training_raw(spark, sf_dir):
    """Raw lines: the tag before the first colon goes where a line has angle brackets."""
    k = F.col("p_size") % 3
    value = F.when(k == 0, F.concat_ws(" : ", "p_name", "p_type")).when(k == 1, F.concat(F.lit("<13>tag: <"), F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(">"))).otherwise(F.concat(F.lit("<13>"), "p_name"))
    return catalog.parse_training(lines_of(table(spark, sf_dir, "part"), value), "x", -1, mode="msg")


@query("SELECT 0 AS file_no, '[NAME] ' || replace(n_name, '_', ' ') || ' [TYPE] string [PATH] a . b' AS text FROM nation UNION ALL SELECT 1, '[NAME] ' || replace(r_name, '_', ' ') || ' [TYPE] int [PATH] c' FROM region")
def training_files(spark, sf_dir):
    """Two written files, the first with a header, the second without, and one that does not exist."""
    root = f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    first = spark.createDataFrame([("path,name,type",)], "value string").withColumn("k", F.lit(-1).cast("long")).union(nation.select(F.concat(F.lit("a.b,"), "n_name", F.lit(",string")), F.col("n_nationkey").cast("long")))
    first.coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{root}/a")
    region.select(F.concat("r_name", F.lit(",int,c")).alias("value")).write.text(f"{root}/b")
    return catalog.read_training_files(spark, [f"{root}/a", f"{root}/b", f"{root}/none"]).select("file_no", "text")


# --- texts and tokens -----------------------------------------------------------------------------------------------
SETTINGS = {
    "nmo": {},
    "mask_name": {"mask_name": True},
    "drop_type": {"drop_type": True},
    "drop_path": {"drop_path": True},
    "unknown": {"mode": "other"},
    "context": {"mode": "context"},
    "context_drop": {"mode": "context", "drop_desc": True, "drop_example": True},
    "no_placeholder": {"mode": "context", "no_placeholder": True, "mask_name": True},
    "raw_msg": {"mode": "raw_msg"},
    "msg": {"mode": "msg"},
}
_N, _T, _P, _D, _E = "c_name_", "lower(c_mktsegment)", "'x . ' || c_mktsegment", "'at 10.0.0.1 :80'", "'ex ' || c_nationkey"
_CUSTOMER = "(SELECT *, replace(c_name, '_', ' ') AS c_name_ FROM customer)"


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS setting, c_custkey, {v} AS text FROM {_CUSTOMER}"
        for k, v in {
            "nmo": f"'[NAME] ' || {_N} || ' [TYPE] ' || {_T} || ' [PATH] ' || {_P}",
            "unknown": f"'[NAME] ' || {_N} || ' [TYPE] ' || {_T} || ' [PATH] ' || {_P}",
            "mask_name": f"'[TYPE] ' || {_T} || ' [PATH] ' || {_P}",
            "drop_type": f"'[NAME] ' || {_N} || ' [PATH] ' || {_P}",
            "drop_path": f"'[NAME] ' || {_N} || ' [TYPE] ' || {_T}",
            "context": f"{_N} || ' ' || {_T} || ' ' || {_P} || ' at [IP] :[PORT] ' || {_E}",
            "context_drop": f"{_N} || ' ' || {_T} || ' ' || {_P}",
            "no_placeholder": f"{_T} || ' ' || {_P} || ' ' || {_D} || ' ' || {_E}",
            "raw_msg": "'message of ' || c_name",
            "msg": "'message of ' || c_name",
        }.items()
    )
)
def serialize_modes(spark, sf_dir):
    """Every mode and mask of the serialisation."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("type"), F.concat(F.lit("x."), "c_mktsegment").alias("path"), F.lit("at 10.0.0.1 :80").alias("desc"), F.concat(F.lit("ex "), F.col("c_nationkey").cast("string")).alias("example"), F.concat(F.lit(" message of "), "c_name", F.lit("\n")).alias("raw_msg")
    )
    texts = F.array(*[F.struct(F.lit(k).alias("setting"), X.serialize(**v).alias("text")) for k, v in SETTINGS.items()])
    return c.select("c_custkey", F.explode(texts).alias("x")).select("x.setting", "c_custkey", "x.text")


_COMPACT = "replace(norm, ' ', '')"


@query(
    f"""SELECT v, array_to_string(rich, ' ') AS strong, array_to_string({O.plain_tokens('norm', False)}, ' ') AS plain,
md5(array_to_string(list_concat(rich, CASE WHEN regexp_full_match({_COMPACT}, '[a-z0-9]{{4,64}}') THEN flatten([{O.grams(_COMPACT, 3)}, {O.grams(_COMPACT, 4)}, {O.grams(_COMPACT, 5)}]) ELSE {O.NONE} END), ' ')) AS bm25_md5,
regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS simple, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(v), '[_./\\-]+', ' ', 'g'), '\\s+'), lambda x: x <> ''))), ' ') AS simple_path
FROM (SELECT v, {O.rich_tokens('v')} AS rich, {O.normalize('v')} AS norm FROM ({IDENTIFIERS}))"""
)
def token_kinds(spark, sf_dir):
    """Rich, plain and BM25 tokens of identifiers, and the simple forms."""
    joined = lambda c: F.array_join(c, " ")
    return identifiers(spark, sf_dir).select(
        "v", joined(X.tokens("v", True)).alias("strong"), joined(X.tokens("v", False)).alias("plain"), F.md5(joined(X.bm25_tokens("v")).cast("binary")).alias("bm25_md5"), X.simple_name("v").alias("simple"), joined(F.array_sort(X.simple_path_tokens("v"))).alias("simple_path")
    )


_SPARSE = "trim(concat_ws(' ', " + ", ".join(f"nullif({x}, '')" for x in ("nn", "nn", "array_to_string(rn, ' ')", "np", "array_to_string(rp, ' ')", "nt", "nt")) + "))"


def sparse_sql(t: str) -> str:
    """The CTEs {t}0 and {t}f of catalog t: what sparse matchers compare."""
    return f"""{t}0 AS (SELECT pos, name, path, replace(path, '.', ' ') AS dotless, lower(trim(type)) AS tbase, {O.normalize('name')} AS nn, {O.rich_tokens('name')} AS rn, {O.normalize("replace(path, '.', ' ')")} AS np, {O.rich_tokens("replace(path, '.', ' ')")} AS rp, {O.normalize('type')} AS nt FROM {t}),
{t}1 AS (SELECT *, {_SPARSE} AS full FROM {t}0), {t}f AS (SELECT *, {O.rich_tokens('"full"')} AS ft FROM {t}1)"""


@query(f"WITH {FIELDS}, {sparse_sql('src')} SELECT pos, \"full\" AS text FROM srcf")
def sparse_text(spark, sf_dir):
    return fields(spark, sf_dir, "a").select("pos", X.sparse_text().alias("text"))


@query(f"SELECT c_custkey, array_to_string(list_sort({O.rule_tokens(O.rich_tokens('t'))}), ' ') AS tokens FROM (SELECT c_custkey, trim(concat_ws(' ', lower(c_mktsegment) || ' ip', c_name)) AS t FROM customer)")
def description_tokens(spark, sf_dir):
    """Description and example of a field as rules read them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit(" ip")).alias("desc"), F.col("c_name").alias("example"))
    return c.select("c_custkey", F.array_join(F.array_sort(X.rule_tokens(F.btrim(F.concat_ws(" ", X.text("desc"), X.text("example")), F.lit(" ")))), " ").alias("tokens"))


# --- scores of all pairs of fields ----------------------------------------------------------------------------------
_HAS = lambda side, ws: f"len(list_intersect(list_concat({side}sn, {side}ps), {O.words(' '.join(ws))})) > 0"


@query(
    f"""WITH {FIELD_RULES}, k AS (SELECT *, {O.jaccard('asn', 'bsn')} AS nj, {O.overlap('asn', 'bsn')} AS no, {O.overlap('aps', 'bps')} AS po, an <> '' AND bn <> '' AND (contains(an, bn) OR contains(bn, an)) AS pa,
{O.compatibility(V.TYPE_COMPAT_B, 'ta', 'tb')} AS tc, ({_HAS('a', V.SOURCE_WORDS)} AND {_HAS('b', V.DESTINATION_WORDS)}) OR ({_HAS('a', V.DESTINATION_WORDS)} AND {_HAS('b', V.SOURCE_WORDS)}) AS pol FROM j),
m AS (SELECT *, ex OR nj >= 0.8 OR pa AS sig, CASE WHEN ex THEN 0.06 WHEN p4 THEN 0.008 ELSE 0 END::DOUBLE + CASE WHEN te THEN 0.01 ELSE 0 END::DOUBLE AS hs FROM k),
x AS (SELECT *, CASE WHEN NOT sig AND NOT (tc >= 1 AND pj >= 0.8) THEN 0::DOUBLE ELSE greatest(0::DOUBLE,
  CASE WHEN ex THEN 0.095 ELSE 0 END::DOUBLE + CASE WHEN pa THEN 0.012 ELSE 0 END::DOUBLE + CASE WHEN nj >= 0.8 THEN 0.035 WHEN nj >= 0.5 THEN 0.015 ELSE 0 END::DOUBLE
  + CASE WHEN no >= 0.8 THEN 0.012 WHEN no >= 0.5 THEN 0.004 ELSE 0 END::DOUBLE
  + CASE WHEN NOT sig THEN 0 WHEN pj >= 0.8 THEN 0.008 WHEN pj >= 0.5 THEN 0.003 ELSE 0 END::DOUBLE + CASE WHEN sig AND po >= 0.8 THEN 0.0015 ELSE 0 END::DOUBLE
  + CASE WHEN tc >= 1 THEN 0.006 WHEN tc >= 0.8 THEN 0.002 WHEN tc >= 0.3 THEN 0.0008 WHEN ta <> '' AND tb <> '' THEN -0.18 ELSE 0 END::DOUBLE - CASE WHEN pol THEN 1.15 ELSE 0 END::DOUBLE) END AS st,
  hs + CASE WHEN hs > 0 AND pj >= 0.8 THEN 0.01 WHEN hs > 0 AND pj >= 0.5 THEN 0.004 ELSE 0 END::DOUBLE AS hs2 FROM m)
SELECT src_pos, tgt_pos, round(0.78::DOUBLE * st + 0.1::DOUBLE * hs2, 6) AS enhanced,
round(CASE WHEN ex AND te AND pj >= 0.5 THEN 0.28 WHEN ex AND te AND pj >= 0.2 THEN 0.08 WHEN ex AND pj >= 0.8 THEN 0.01 WHEN ex THEN 0 WHEN p4 AND l4 AND te AND pj >= 0.8 THEN 0.006 WHEN te AND pj >= 0.8 THEN 0.001 WHEN p4 AND l4 THEN 0.004 WHEN pj >= 0.8 THEN 0.002 ELSE 0 END::DOUBLE, 6) AS weak,
round(st, 6) AS strong, round(hs2, 6) AS support, pol::INT::DOUBLE AS conflict FROM x"""
)
def rule_parts(spark, sf_dir):
    """Both rules, their parts and the polarity conflict, of every pair of fields."""
    rows = matchers.rule_pairs(*both(spark, sf_dir))
    strong = matchers.strong(*map(F.col, matchers.STRONG))
    j = F.col("_j")
    (a_src, b_src), (a_dst, b_dst) = matchers.side("is_src"), matchers.side("is_dst")
    conflict = ((a_src & b_dst) | (a_dst & b_src)).cast("double")
    six = lambda c: F.round(c, 6)
    return rows.select(
        "src_pos", "tgt_pos", six(0.78 * strong + 0.10 * matchers.heuristic_support(j)).alias("enhanced"), six(matchers.heuristic(j)).alias("weak"), six(strong).alias("strong"), six(matchers.heuristic_support(j)).alias("support"), conflict.alias("conflict")
    )


def list_of(c: str) -> str:
    return f"list_filter({c}, lambda x: x <> '')"


@query(
    f"""WITH {FIELD_RULES}, l AS (SELECT s.pos, {list_of('s.nt')} AS nt FROM src0 s), m AS (SELECT t.pos, {list_of('t.nt')} AS nt FROM tgt0 t),
k AS (SELECT j.*, l.nt AS x, m.nt AS y, list_concat(asn, aps) AS ac, list_concat(bsn, bps) AS bc, greatest({O.jaccard('asn', 'bps')}, {O.jaccard('bsn', 'aps')}) AS cj, greatest({O.overlap('asn', 'bps')}, {O.overlap('bsn', 'aps')}) AS co FROM j JOIN l ON l.pos = src_pos JOIN m ON m.pos = tgt_pos),
p AS (SELECT *, {_HAS('a', V.SOURCE_WORDS)} AS s1, {_HAS('b', V.SOURCE_WORDS)} AS s2, {_HAS('a', V.DESTINATION_WORDS)} AS d1, {_HAS('b', V.DESTINATION_WORDS)} AS d2 FROM k)
SELECT src_pos, tgt_pos, CASE WHEN (s1 AND d2) OR (d1 AND s2) THEN 1.0 ELSE 0.0 END::DOUBLE AS penalty, CASE WHEN (s1 AND s2) OR (d1 AND d2) THEN 0.35 ELSE 0 END::DOUBLE AS bonus,
round((CASE WHEN len(x) > 0 AND len(y) > 0 AND x[-1] = y[-1] THEN 0.30 ELSE 0 END + CASE WHEN len(x) > 0 AND len(y) > 0 AND x[1] = y[1] THEN 0.15 ELSE 0 END + CASE WHEN len(x) > 1 AND len(y) > 1 AND x[-1] = y[-1] AND x[-2] = y[-2] THEN 0.35 ELSE 0 END
 + CASE WHEN len(x) > 1 AND len(y) > 1 AND x[1] = y[1] AND x[2] = y[2] THEN 0.20 ELSE 0 END)::DOUBLE, 6) AS ends,
round((CASE WHEN cj >= 0.8 THEN 0.55 WHEN cj >= 0.5 THEN 0.30 WHEN cj > 0 THEN 0.10 ELSE 0 END + CASE WHEN co >= 0.8 THEN 0.28 WHEN co >= 0.5 THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS crossed FROM p"""
)
def rule_helpers(spark, sf_dir):
    """The helpers that no rule calls: polarity, equal ends of token lists, names in the other's path."""
    of = lambda c: c.select("pos", X.rule_tokens("name").alias("n"), X.rule_tokens("path").alias("p"), F.filter(X.rich_tokens("name"), lambda t: t != "").alias("l"))
    a, b = both(spark, sf_dir)
    rows = pairs.all_pairs(of(a), of(b))
    c = F.col
    sets = [F.array_union(c(f"{s}_n"), c(f"{s}_p")) for s in ("src", "tgt")]
    return rows.select(
        "src_pos", "tgt_pos", S.polarity_penalty(*sets).alias("penalty"), S.polarity_bonus(*sets).alias("bonus"), F.round(S.end_bonus(c("src_l"), c("tgt_l")), 6).alias("ends"), F.round(S.cross_bonus(c("src_n"), c("tgt_n"), c("src_p"), c("tgt_p")), 6).alias("crossed")
    )


_BARE = "regexp_replace(lower(name), '[^\\p{L}\\p{N}\\p{M}]+', '', 'g')"
_RATIO = O.ratio(f"SELECT DISTINCT {_BARE} AS a FROM src", f"SELECT DISTINCT {_BARE} AS b FROM tgt")


@query(
    f"""WITH RECURSIVE {FIELDS}, {_RATIO}, f AS (SELECT *, {_BARE} AS bare, {O.path_tokens('path')} AS pt, list_distinct({O.plain_tokens('name')}) AS nt, lower(trim(type)) AS tb FROM (SELECT *, 'a' AS side FROM src UNION ALL SELECT *, 'b' FROM tgt))
SELECT a.pos AS src_pos, b.pos AS tgt_pos, round((1.0::DOUBLE * {O.jaccard('a.nt', 'b.nt')} + 0.3 * {O.compatibility(V.TYPE_COMPAT_A, 'a.tb', 'b.tb')} + 0.2 * {O.jaccard('a.pt', 'b.pt')} + 0.1 * r.ratio) / 1.6, 6) AS score
FROM f a JOIN f b ON a.side = 'a' AND b.side = 'b' JOIN ratio r ON r.a = a.bare AND r.b = b.bare"""
)
def constrained_fields(spark, sf_dir):
    """A base score with type, path and character constraints, for every pair of fields."""
    a, b = both(spark, sf_dir)
    base = matchers.component_scores(a, b).select("src_pos", "tgt_pos", F.col("name_score").alias("score"))
    return rounded(matchers.constrained(base, a, b))


_OVERLAPS = f"{FIELDS}, {sparse_sql('src')}, {sparse_sql('tgt')}, o AS (SELECT a.pos AS src_pos, b.pos AS tgt_pos, {O.jaccard('list_distinct(a.ft)', 'list_distinct(b.ft)')} AS overlap, {O.jaccard('list_distinct(a.rp)', 'list_distinct(b.rp)')} AS path_overlap, (a.tbase = b.tbase AND a.tbase <> '')::INT::DOUBLE AS type_score FROM srcf a CROSS JOIN tgtf b)"


@query(f"WITH {_OVERLAPS} SELECT src_pos, tgt_pos, round(overlap, 6) AS overlap, round(path_overlap, 6) AS path_overlap, type_score FROM o")
def overlap_parts(spark, sf_dir):
    """Jaccard similarities of rich tokens of whole sparse texts and of paths, and equal types."""
    s, t = (matchers.sparse_catalog(c, True) for c in both(spark, sf_dir))
    rows = matchers.filled(s, t, {"overlap": matchers.token_overlap(s, t, "full", True), "path_overlap": matchers.token_overlap(s, t, "path", True), "type_score": matchers.same_types(s, t)}, {"overlap": "full", "path_overlap": "path", "type_score": "tbase"})
    return rows.select("src_pos", "tgt_pos", F.round("overlap", 6).alias("overlap"), F.round("path_overlap", 6).alias("path_overlap"), "type_score")


@query(
    f"""WITH {_OVERLAPS}, c3 AS (SELECT 's' || pos AS doc, TRUE AS is_source, "full" AS text, ft AS tok FROM srcf UNION ALL SELECT 't' || pos, FALSE, "full", ft FROM tgtf),
x AS (SELECT doc, 'c' AS block, unnest({CHAR_TERMS}) AS term FROM c3 UNION ALL SELECT doc, 'w', unnest({WORD_TERMS}) FROM c3),
tf AS (SELECT doc, block, term, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT block, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT count(*) AS n FROM c3),
w0 AS (SELECT doc, block, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (block, term) CROSS JOIN n WHERE df <= CASE block WHEN 'c' THEN 0.95::DOUBLE ELSE 0.98::DOUBLE END * n),
w1 AS (SELECT doc, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc, block)) AS w FROM w0), w2 AS (SELECT doc, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w1),
s AS (SELECT a.doc AS a, b.doc AS b, sum(a.w * b.w) AS sparse FROM w2 a JOIN w2 b ON a.block = b.block AND a.term = b.term GROUP BY 1, 2)
SELECT src_pos, tgt_pos, round(0.55::DOUBLE * coalesce(sparse, 0) + 0.15::DOUBLE * overlap + 0.15::DOUBLE * path_overlap + 0.15::DOUBLE * type_score, 6) AS score FROM o LEFT JOIN s ON s.a = 's' || src_pos AND s.b = 't' || tgt_pos"""
)
def tfidf_fields(spark, sf_dir):
    """The TF-IDF ensemble over rich tokens, of every pair of fields."""
    return rounded(matchers.tfidf_ensemble(*both(spark, sf_dir)))


def bm25_sql(name: str, key: str) -> str:
    """CTEs that end in {name}(src_pos, tgt_pos, score): BM25 of catalog column key, divided by each query's largest."""
    compact = "replace(norm, ' ', '')"
    tokens = f"list_concat(rich, CASE WHEN regexp_full_match({compact}, '[a-z0-9]{{4,64}}') THEN flatten([{O.grams(compact, 3)}, {O.grams(compact, 4)}, {O.grams(compact, 5)}]) ELSE {O.NONE} END)"
    side = lambda t: f"(SELECT pos, {tokens} AS tok FROM (SELECT pos, {O.rich_tokens(key)} AS rich, {O.normalize(key)} AS norm FROM {t}f))"
    return f"""{name}q AS (SELECT pos, term, count(*) AS qf FROM (SELECT pos, unnest(tok) AS term FROM {side('src')}) GROUP BY ALL), {name}d AS (SELECT pos, tok, len(tok) AS dl FROM {side('tgt')}),
{name}f AS (SELECT pos, term, count(*) AS f FROM (SELECT pos, unnest(tok) AS term FROM {name}d) GROUP BY ALL), {name}n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}d),
{name}i AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM {name}f CROSS JOIN {name}n GROUP BY term, n),
{name}r AS (SELECT q.pos AS src_pos, f.pos AS tgt_pos, sum(qf * idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (avgdl + 1e-9)))) AS score FROM {name}q q JOIN {name}f f USING (term) JOIN {name}i USING (term) JOIN {name}d d ON d.pos = f.pos CROSS JOIN {name}n GROUP BY 1, 2),
{name} AS (SELECT src_pos, tgt_pos, score / greatest(max(score) OVER (PARTITION BY src_pos), 1e-9) AS score FROM {name}r)"""


@query(
    f"""WITH {_OVERLAPS}, {bm25_sql('bf', '"full"')}, {bm25_sql('bn', 'name')}, {bm25_sql('bp', 'path')}
SELECT o.src_pos, o.tgt_pos, round(0.40::DOUBLE * coalesce(bf.score, 0) + 0.20::DOUBLE * coalesce(bn.score, 0) + 0.10::DOUBLE * coalesce(bp.score, 0) + 0.15::DOUBLE * overlap + 0.05::DOUBLE * path_overlap + 0.10::DOUBLE * type_score, 6) AS score
FROM o LEFT JOIN bf ON bf.src_pos = o.src_pos AND bf.tgt_pos = o.tgt_pos LEFT JOIN bn ON bn.src_pos = o.src_pos AND bn.tgt_pos = o.tgt_pos LEFT JOIN bp ON bp.src_pos = o.src_pos AND bp.tgt_pos = o.tgt_pos"""
)
def bm25_fields(spark, sf_dir):
    """The BM25 ensemble over rich tokens, of every pair of fields."""
    return rounded(matchers.bm25_ensemble(*both(spark, sf_dir)))


# --- bundles --------------------------------------------------------------------------------------------------------
@query(f"WITH {O.SCORES}{O.TRUTH} SELECT a.pos AS src_pos, count(t.tgt_pos) AS n_targets, coalesce(min(t.tgt_pos), -1) AS first_target FROM src a LEFT JOIN t ON t.src_pos = a.pos GROUP BY a.pos")
def truth_sets(spark, sf_dir):
    src, _, truth = evaluation.part_setup(spark, sf_dir)
    return pairs.truth_sets(truth, src).select("src_pos", F.size("targets").cast("long").alias("n_targets"), "first_target")


@query(f"WITH {O.SCORES}{O.PROBS.replace('exp(score - max(score) OVER (PARTITION BY src_pos))', 'exp((score - max(score) OVER (PARTITION BY src_pos)) / 0.2::DOUBLE)')} SELECT src_pos, round(max(prob), 6) AS top, round(min(prob), 6) AS low FROM p GROUP BY src_pos")
def softmax_temperature(spark, sf_dir):
    p = ranking.softmax(base_scores(spark, sf_dir)[0], 0.2)
    return p.groupBy("src_pos").agg(F.round(F.max("prob"), 6).alias("top"), F.round(F.min("prob"), 6).alias("low"))


@query(
    f"""WITH {O.SCORES}{O.TRUTH}, g AS (SELECT unnest([0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0]::DOUBLE[]) AS tau), m AS (SELECT src_pos, tgt_pos, score - max(score) OVER (PARTITION BY src_pos) AS z FROM s),
e AS (SELECT tau, src_pos, sum(exp(z / tau)) AS total, sum(CASE WHEN t.src_pos IS NOT NULL THEN exp(z / tau) ELSE 0 END) AS hit FROM m LEFT JOIN t USING (src_pos, tgt_pos) CROSS JOIN g GROUP BY ALL)
SELECT tau FROM (SELECT tau, avg(-ln(greatest(hit / total, 1e-12))) AS loss FROM e WHERE hit > 0 GROUP BY tau) ORDER BY loss LIMIT 1"""
)
def fitted_temperature(spark, sf_dir):
    src, tgt, truth = evaluation.part_setup(spark, sf_dir)
    known = matchers.records(src)
    tau = calibration.fit_temperature(matchers.overlap_matcher(known, tgt), truth, members=matchers.members(src, known))
    return spark.createDataFrame([(tau,)], "tau double")


@query(
    f"""WITH {O.SCORES}{O.TRUTH}, top AS (SELECT b.src_pos, b.tgt_pos, b.score AS conf, (t.src_pos IS NOT NULL)::INT::DOUBLE AS correct FROM (SELECT *, row_number() OVER (PARTITION BY src_pos ORDER BY score DESC, tgt_pos) AS k FROM s) b LEFT JOIN t ON b.src_pos = t.src_pos AND b.tgt_pos = t.tgt_pos WHERE b.k = 1),
pooled AS (SELECT conf, sum(correct) AS s, count(*) AS n FROM top GROUP BY conf){O.ISOTONIC} SELECT src_pos, tgt_pos, conf, correct, round(fitted, 6) AS fitted FROM top JOIN fit USING (conf)"""
)
def calibrated_maxima(spark, sf_dir):
    """A probability for each source's largest raw score."""
    s, truth, *_ = base_scores(spark, sf_dir)
    return calibration.calibrated_maxima(s, truth).select("src_pos", "tgt_pos", "conf", "correct", F.round("fitted", 6).alias("fitted"))


@query(f"WITH {O.SCORES}{O.TRUTH}{O.RANKED}{O.PROBS}{O.TOPS}, m AS ({O.metrics()}), err AS ({O.ece('top', 'CASE WHEN conf > 0 THEN least(ceil(conf * 15), 15) END')}) SELECT * FROM m CROSS JOIN err")
def all_metrics(spark, sf_dir):
    """The facade's summary and calibration error in one row."""
    s, truth, *_ = base_scores(spark, sf_dir)
    e = ranking.Evaluator(s, truth)
    return e.summary().withColumn("ece", F.lit(e.ece()).cast("double"))


_CELLS = "SELECT r_regionkey AS i, k AS j, (SELECT count(*) FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = r_regionkey AND c.c_mktsegment = seg)::DOUBLE AS s FROM region CROSS JOIN (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS k FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer))"


def cells(spark, sf_dir) -> DataFrame:
    """(src_pos, tgt_pos, score): customers of each region and market segment, none counting 0."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    names = c.select(F.col("c_mktsegment").alias("seg")).distinct()
    smaller = names.select(F.col("seg").alias("other"))
    numbered = names.join(smaller, F.col("other") < F.col("seg"), "left").groupBy("seg").agg(F.count("other").alias("tgt_pos"))  # a handful of segments
    have = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("src_pos"), F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    every = r.select(F.col("r_regionkey").cast("long").alias("src_pos")).crossJoin(numbered)
    return every.join(have, ["src_pos", "seg"], "left").select("src_pos", "tgt_pos", F.coalesce("n", F.lit(0)).cast("double").alias("score"))


def best_permutation(value: str) -> str:
    """SQL of the largest total over all ways to give each region a segment of its own."""
    return f"""WITH RECURSIVE cells AS ({_CELLS}), tau AS (SELECT avg(s) AS tau FROM cells), p(i, used, total) AS (SELECT -1::BIGINT, []::BIGINT[], 0.0::DOUBLE UNION ALL SELECT p.i + 1, list_append(used, c.j), total + {value} FROM p JOIN cells c ON c.i = p.i + 1 CROSS JOIN tau WHERE NOT list_contains(used, c.j))
SELECT round(max(total), 6) AS total FROM p WHERE i = (SELECT max(i) FROM cells)"""


@query(best_permutation("c.s"))
def assignment_total(spark, sf_dir):
    """The total of a one-to-one assignment of regions to market segments, which permutations check."""
    s = cells(spark, sf_dir)
    return assignment.assign(s).join(s, ["src_pos", "tgt_pos"]).agg(F.round(F.sum("score"), 6).alias("total"))


@query(best_permutation("greatest(c.s, tau)"))
def assignment_total_tau(spark, sf_dir):
    """The same where a region may stay unmatched at the mean; what is unmatched counts as that."""
    s = cells(spark, sf_dir)
    tau = s.agg(F.avg("score")).first()[0]
    got = assignment.assign(s, tau=tau).join(s, ["src_pos", "tgt_pos"], "left")
    return got.agg(F.round(F.sum(F.coalesce("score", F.lit(tau))), 6).alias("total"))


@query("SELECT round(avg((n_regionkey = 1)::INT) FILTER (m), 6) AS accuracy, round(avg(m::INT), 6) AS coverage FROM (SELECT n_regionkey, n_nationkey % 3 > 0 AS m FROM nation WHERE n_nationkey % 5 > 0)")
def assigned_accuracy(spark, sf_dir):
    """Accuracy of what is matched and coverage, over the sources with a truth."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src_pos"), F.col("n_regionkey").cast("long").alias("r"))
    assigned = n.select("src_pos", F.when(F.col("src_pos") % 3 > 0, F.col("r")).otherwise(-1).alias("tgt_pos"))
    return assignment.assignment_accuracy(assigned, n.where("src_pos % 5 > 0").select("src_pos", F.lit(1).cast("long").alias("tgt_pos")))


@query(
    f"""WITH {O.SCORES}, tt AS (SELECT a.pos AS src_pos, b.pos AS tgt_pos FROM src a JOIN tgt b ON a.name = b.name), o AS (SELECT src_pos, row_number() OVER (ORDER BY md5('42:' || field_id), field_id) AS k, count(*) OVER () AS n FROM (SELECT pos AS src_pos, field_id FROM src)),
part AS (SELECT src_pos, k <= least(greatest(1, floor(n * 0.2::DOUBLE)), n - 1) AS calib FROM o){O.PROBS}, t AS (SELECT * FROM tt){O.TOPS},
pooled AS (SELECT conf, sum(correct) AS s, count(*) AS n FROM top JOIN part USING (src_pos) WHERE calib GROUP BY conf){O.ISOTONIC},
et AS (SELECT top.* FROM top JOIN part USING (src_pos) WHERE NOT calib),
lo AS (SELECT et.src_pos, max(f.conf) AS x0 FROM et JOIN fit f ON f.conf <= et.conf GROUP BY 1), hi AS (SELECT et.src_pos, min(f.conf) AS x1 FROM et JOIN fit f ON f.conf >= et.conf GROUP BY 1),
c1 AS (SELECT et.src_pos, et.tgt_pos, et.conf AS c0, CASE WHEN x0 IS NULL THEN g.fitted WHEN x1 IS NULL OR x0 = x1 THEN f.fitted ELSE f.fitted + (g.fitted - f.fitted) * (et.conf - x0) / (x1 - x0) END AS c1 FROM et LEFT JOIN lo USING (src_pos) LEFT JOIN hi USING (src_pos) LEFT JOIN fit f ON f.conf = x0 LEFT JOIN fit g ON g.conf = x1),
q AS (SELECT p.src_pos, p.tgt_pos, greatest(CASE WHEN p.tgt_pos = c1.tgt_pos THEN c1 WHEN 1 - c0 <= 1e-12 THEN (1 - c1) / (count(*) OVER (PARTITION BY p.src_pos) - 1) ELSE prob * greatest(1 - c1, 0) / (1 - c0) END, 0) AS q FROM p JOIN c1 ON c1.src_pos = p.src_pos),
w AS (SELECT src_pos, tgt_pos, q / sum(q) OVER (PARTITION BY src_pos) AS prob FROM q), top2 AS (SELECT b.src_pos, b.prob AS conf, (tt.src_pos IS NOT NULL)::INT::DOUBLE AS correct FROM (SELECT *, row_number() OVER (PARTITION BY src_pos ORDER BY prob DESC, tgt_pos) AS k FROM w) b LEFT JOIN tt ON tt.src_pos = b.src_pos AND tt.tgt_pos = b.tgt_pos WHERE k = 1),
before AS ({O.ece('et', 'CASE WHEN conf > 0 THEN least(ceil(conf * 15), 15) END')}), after AS ({O.ece('top2', 'CASE WHEN conf > 0 THEN least(ceil(conf * 15), 15) END')})
SELECT b.ece AS ece_before, a.ece AS ece_after, round(CASE WHEN b.ece > 0 THEN (b.ece - a.ece) / b.ece ELSE 0 END, 6) AS improvement FROM before b CROSS JOIN after a"""
)
def calibration_table(spark, sf_dir):
    """Calibration error of the evaluated sources before and after a fit on the others."""
    s, _, src, tgt = base_scores(spark, sf_dir)
    return evaluation.calibration_table(s, catalog.part_pairs(spark, sf_dir), src, tgt)


# --- training -------------------------------------------------------------------------------------------------------
def protected() -> str:
    return O.words(" ".join(sorted(V.PROTECTED_WORDS)))


_NAME = "list_filter(regexp_split_to_array(regexp_extract(text, '\\[NAME\\] (.*?) \\[TYPE\\]', 1), '[\\s_]+'), lambda x: x <> '')"
_PATH = "list_filter(regexp_split_to_array(regexp_extract(text, '\\[PATH\\] (.*)$', 1), '[\\s_.]+'), lambda x: x <> '')"
_SAFE = f"len(n) > 1 AND len(list_filter(n, lambda x: NOT list_contains({protected()}, lower(x)))) > 0 AND CASE WHEN len(p) <= 3 THEN len(n) >= 2 ELSE len(n) >= least(3, greatest(2, floor(len(p) / 2))) END"


@query(f"SELECT line_no, {_SAFE} AS safe FROM (SELECT line_no, {_NAME} AS n, {_PATH} AS p FROM ({VIEW_TEXT}))")
def varclr_safe(spark, sf_dir):
    return view_lines(spark, sf_dir).select("line_no", training.varclr_safe(F.col("text")).alias("safe"))


_ALTS = O.lookup(ALTS, "lower(n[i + 1])")


@query(
    f"""WITH x AS ({VIEW_TEXT}), a AS (SELECT line_no, text, {_NAME} AS n, {_PATH} AS p, regexp_extract(text, '( \\[TYPE\\].*)$', 1) AS rest FROM x),
b AS (SELECT *, list_filter(range(len(n)), lambda i: len({_ALTS}) > 0) AS w, {_SAFE} AS safe FROM a),
c AS (SELECT *, w[floor({O.chance(43, 'text')} * len(w))::INT + 1] AS f1 FROM b),
d AS (SELECT *, CASE WHEN len(n) >= 4 AND len(w) >= 2 AND {O.chance(44, 'text')} < 0.15 THEN list_filter(w, lambda i: i <> f1)[floor({O.chance(45, 'text')} * (len(w) - 1))::INT + 1] END AS f2 FROM c)
SELECT line_no, CASE WHEN safe AND len(w) > 0 AND len(n) >= 2 AND {O.chance(42, 'text')} < 0.22::DOUBLE + 0.24::DOUBLE * 0.5 THEN '[NAME] ' || array_to_string(list_transform(range(len(n)), lambda i: CASE WHEN i = f1 OR coalesce(i = f2, FALSE) THEN ({_ALTS})[floor({O.chance(47, 'text', 'i::VARCHAR')} * len({_ALTS}))::INT + 1] ELSE n[i + 1] END), ' ') || rest ELSE text END AS view FROM d"""
)
def varclr_views(spark, sf_dir):
    """The softer views, late in training."""
    return training.varclr_views(view_lines(spark, sf_dir), progress=0.5).select("line_no", "view")


@query("SELECT e AS epoch, w AS warmup, CASE WHEN e < 1 THEN 0.0 WHEN w > 0 THEN 0.5::DOUBLE * least(1.0::DOUBLE, e / w::DOUBLE) ELSE 0.5 END::DOUBLE AS weight FROM (SELECT unnest(range(8)) AS e) CROSS JOIN (SELECT unnest(range(4)) AS w)")
def weight_schedule(spark, sf_dir):
    rows = [(e, w, float(training.varclr_weight(0.5, e, 1, w))) for e in range(8) for w in range(4)]
    return spark.createDataFrame(rows, "epoch long, warmup long, weight double")


@query("SELECT epoch, count(*) AS steps, round(avg(loss), 6) AS loss, round(avg(aux), 6) AS aux FROM (SELECT o_orderkey % 5 AS epoch, (o_custkey % 97) / 97.0::DOUBLE AS loss, CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 11) / 11.0::DOUBLE END AS aux FROM orders) GROUP BY epoch")
def epoch_metrics(spark, sf_dir):
    """Means of each epoch's losses, written as CSV with a header and read again."""
    o = table(spark, sf_dir, "orders")
    steps = o.select((F.col("o_orderkey") % 5).alias("epoch"), ((F.col("o_custkey") % 97) / 97.0).alias("loss"), F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 11) / 11.0).alias("aux"))
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    report.write_metrics(training.epoch_averages(steps), path)
    return spark.read.schema("epoch long, steps long, loss double, aux double").csv(path, header=True)


@query("SELECT n_regionkey AS region, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1")
def json_results(spark, sf_dir):
    """Results written as JSON lines and read again."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.count("*").alias("n"), F.max("n_name").alias("last"))
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    report.write_json(n, path)
    return spark.read.schema("region long, n long, last string").json(path)


@query("SELECT 'context' AS mode, 0.3::DOUBLE AS calib_ratio, 15::BIGINT AS ece_bins, TRUE AS default_without_file")
def run_config(spark, sf_dir):
    """Options written beside results and read again; without a file they are the defaults."""
    with tempfile.TemporaryDirectory() as folder:  # the driver's own files, as a run's folder of results is
        catalog.RunConfig(mode="context", calib_ratio=0.3).write(folder)
        read, other = catalog.RunConfig.read(folder), catalog.RunConfig.read(f"{folder}/none")
    return spark.createDataFrame([(read.mode, read.calib_ratio, read.ece_bins, other == catalog.RunConfig())], "mode string, calib_ratio double, ece_bins long, default_without_file boolean")


@query(
    """WITH r AS (SELECT r_regionkey AS i, r_regionkey::VARCHAR AS k, r_name AS n, printf('%.4f', r_regionkey / 3.0::DOUBLE) AS s, printf('%.1f', 100 * (r_regionkey / 7.0::DOUBLE)) || '%' AS h, CASE WHEN r_regionkey = 1 THEN 'N/A' ELSE 'x' END AS m FROM region),
w AS (SELECT greatest(3, max(length(k))) AS k, greatest(4, max(length(n))) AS n, greatest(5, max(length(s))) AS s, greatest(8, max(length(h))) AS h, greatest(4, max(length(m))) AS m FROM r),
cells AS (SELECT i + 3 AS line_no, k, n, s, h, m FROM r UNION ALL SELECT 1, 'key', 'name', 'share', 'hit_at_1', 'note')
SELECT 0::BIGINT AS line_no, 'regions' AS line UNION ALL SELECT 2, repeat('-', w.k::INT) || '-+-' || repeat('-', w.n::INT) || '-+-' || repeat('-', w.s::INT) || '-+-' || repeat('-', w.h::INT) || '-+-' || repeat('-', w.m::INT) FROM w
UNION ALL SELECT line_no, rtrim(rpad(c.k, w.k::INT, ' ') || ' | ' || rpad(c.n, w.n::INT, ' ') || ' | ' || rpad(c.s, w.s::INT, ' ') || ' | ' || rpad(c.h, w.h::INT, ' ') || ' | ' || rpad(c.m, w.m::INT, ' ')) FROM cells c CROSS JOIN w"""
)
def text_tables(spark, sf_dir):
    """Results as a text table: four decimals, rates as percentages, N/A where there is nothing."""
    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # five rows
    rows = [{"key": r.r_regionkey, "name": r.r_name, "share": r.r_regionkey / 3, "hit_at_1": r.r_regionkey / 7, "note": None if r.r_regionkey == 1 else "x"} for r in regions]
    return spark.createDataFrame(list(enumerate(report.text_table("regions", rows).split("\n"))), "line_no long, line string")
