"""The registered queries of the field-matching operators, each over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import assignment, calibration, lexical, matchers, pairs, ranking, stress, training
from ..shipping import ship
from ..sources import catalog
from . import evaluation
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scores, truth, sources, targets) that ranking and calibration queries share."""
    src, tgt, truth = evaluation.part_setup(spark, sf_dir)
    return matchers.overlap_matcher(src, tgt), truth, src, tgt


# --- scans ----------------------------------------------------------------------------------------------------------
@query(
    """
WITH lines AS (SELECT event_id, event_type AS field_id, value, props FROM events),
last AS (SELECT field_id, min(event_id) AS first_line, max_by(props, event_id) AS p FROM lines GROUP BY field_id)
SELECT field_id, row_number() OVER (ORDER BY first_line) - 1 AS pos, json_extract_string(p, '$.k') AS name, 'object' AS type FROM last
"""
)
def catalog_scan(spark, sf_dir):
    """JSON lines into a catalog: the place of an id's first line, the values of its last, `type.base` unwrapped."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("field_id"), F.get_json_object("props", "$.k").alias("name"), F.struct(F.lit("object").alias("base")).alias("type")))
    return catalog.parse_catalog(e.select(F.col("event_id").alias("line_no"), line.alias("value"))).select("field_id", F.col("pos").cast("long").alias("pos"), "name", "type")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS source, CAST(o_orderkey AS VARCHAR) AS target FROM orders WHERE o_orderstatus <> 'F'""")
def pair_scan(spark, sf_dir):
    """Labelled pairs: a finished order has label 0, an open one 1, others none, which is 1."""
    o = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
    rows = o.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("source"), F.col("o_orderkey").cast("string").alias("target"), label.alias("label"))).alias("value"))
    return catalog.parse_pairs(rows)


@query(
    f"""WITH {O.CATALOGS}, lost AS (SELECT a.field_id AS source, b.field_id AS target FROM src a JOIN tgt b ON a.name = b.name AND a.type = b.type UNION ALL SELECT n_name, n_name FROM nation)
SELECT l.source, l.target, coalesce('[NAME] ' || a.name, '') AS text_a, coalesce('[NAME] ' || b.name, '') AS text_b
FROM lost l LEFT JOIN src a ON a.field_id = l.source LEFT JOIN tgt b ON b.field_id = l.target"""
)
def paired_texts(spark, sf_dir):
    """Pairs joined to both catalogs; ids that a catalog lacks give an empty text."""
    src, tgt = catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir)
    text = X.serialize(drop_type=True, drop_path=True)
    lost = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.col("n_name").alias("target"))
    rows = catalog.part_pairs(spark, sf_dir, same_type=True).union(lost)
    return catalog.paired_texts(rows, src.withColumn("text", text), tgt.withColumn("text", text), max_pairs=None)


@query("""SELECT md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS text_md5, min(doc_id) AS line_no FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY 1""")
def dedup_texts(spark, sf_dir):
    out = catalog.distinct_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), "text"))
    return out.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "line_no")


# --- canonical texts ------------------------------------------------------------------------------------------------
@query(f"""WITH {O.CATALOGS} SELECT field_id, '[NAME] ' || name || ' [TYPE] ' || type || ' [PATH] ' || concat_ws(' . ', string_split(path, '.')[1], string_split(path, '.')[2], name) AS text FROM src""")
def nmo_serialize(spark, sf_dir):
    return catalog.part_sources(spark, sf_dir).select("field_id", X.serialize("nmo").alias("text"))


@query(r"""SELECT c_custkey, concat_ws(' ', replace(c_name, '_', ' '), lower(c_mktsegment), 'CUSTOMER . ' || c_mktsegment, 'balance ' || CAST(c_nationkey AS VARCHAR) || ' at [IP] :[PORT]') AS text FROM customer""")
def context_serialize(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    desc = F.concat(F.lit("balance "), F.col("c_nationkey").cast("string"), F.lit(" at 10.0.0.1 :8080"))
    return c.select("c_custkey", X.serialize("context", name="c_name", type=F.lower("c_mktsegment"), path=F.concat(F.lit("CUSTOMER..") , F.col("c_mktsegment")), desc=desc, example=F.lit(None)).alias("text"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[IP]', 'g'), ':\d{1,5}\b', ':[PORT]', 'g'), '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}', '[TIME]', 'g')) AS text_md5,
(length(regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[IP]', 'g')) <> length(text)) AS has_ip FROM documents"""
)
def placeholder_sub(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.substitute_placeholders("text").cast("binary")).alias("text_md5"), (F.length(F.regexp_replace("text", V.IP_PATTERN, "[IP]")) != F.length("text")).alias("has_ip"))


IDENTIFIERS = "SELECT DISTINCT v FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT event_type FROM events UNION ALL SELECT url FROM pages)"


def identifiers(spark, sf_dir) -> DataFrame:
    columns = {"part": ("p_name", "p_brand", "p_type"), "nation": ("n_name",), "customer": ("c_name",), "supplier": ("s_name",), "events": ("event_type",), "pages": ("url",)}
    return reduce(DataFrame.union, [table(spark, sf_dir, t).select(F.col(c).alias("v")) for t, cs in columns.items() for c in cs]).distinct()


@query(f"SELECT v, {O.normalize('v')} AS norm FROM ({IDENTIFIERS})")
def normalize_text(spark, sf_dir):
    return identifiers(spark, sf_dir).select("v", X.normalize("v").alias("norm"))


@query(f"SELECT v, array_to_string({O.rich_tokens('v')}, ' ') AS tokens FROM ({IDENTIFIERS})")
def rich_tokens(spark, sf_dir):
    return identifiers(spark, sf_dir).select("v", F.array_join(X.rich_tokens("v"), " ").alias("tokens"))


@query(f"SELECT v, array_to_string(list_sort({O.rule_tokens(O.rich_tokens('v'))}), ' ') AS tokens FROM ({IDENTIFIERS})")
def rule_tokens(spark, sf_dir):
    return identifiers(spark, sf_dir).select("v", F.array_join(F.array_sort(X.rule_tokens("v")), " ").alias("tokens"))


@query(f"SELECT v, array_to_string(list_sort({O.path_tokens('v')}), ' ') AS tokens FROM ({IDENTIFIERS})")
def path_tokens(spark, sf_dir):
    return identifiers(spark, sf_dir).select("v", F.array_join(F.array_sort(X.path_tokens("v")), " ").alias("tokens"))


@query(f"""WITH {O.CATALOGS} SELECT field_id, name, type, replace(path, '.', ' . ') AS path FROM src""")
def component_extract(spark, sf_dir):
    """The components read back from the serialised text."""
    t = catalog.part_sources(spark, sf_dir).select("field_id", X.serialize("nmo").alias("text"))
    return t.select("field_id", X.component("text", "name").alias("name"), X.tagged_component("text", "TYPE").alias("type"), X.component("text", "path").alias("path"))


TYPES = ["ip", "PORT", "int", " String ", "timestamp", "float", "bool", "list", "json", "integer", "datetime", "var-char", "custom type", "port", "string"]
TYPED = f"SELECT DISTINCT [{', '.join(map(O.quoted, TYPES))}][p_size % {len(TYPES)} + 1] AS type FROM part"


def typed(spark, sf_dir) -> DataFrame:
    """The types that parts have if their sizes name them."""
    return table(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, TYPES)), F.col("p_size") % len(TYPES) + 1).alias("type")).distinct()


@query(f"SELECT type, {O.canonical_type('type')} AS canonical FROM ({TYPED})")
def type_canon(spark, sf_dir):
    return typed(spark, sf_dir).select("type", X.canonical_type("type").alias("canonical"))


def type_pairs(spark, sf_dir) -> DataFrame:
    t = typed(spark, sf_dir)
    return t.select(F.col("type").alias("a")).crossJoin(t.select(F.col("type").alias("b")))


@query(f"SELECT a.type AS a, b.type AS b, {O.compatibility(V.TYPE_COMPAT_A, 'lower(trim(a.type))', 'lower(trim(b.type))')} AS score FROM ({TYPED}) a CROSS JOIN ({TYPED}) b")
def type_compat_a(spark, sf_dir):
    return type_pairs(spark, sf_dir).withColumn("score", S.type_compat_a("a", "b"))


@query(f"SELECT a.type AS a, b.type AS b, {O.compatibility(V.TYPE_COMPAT_B, O.canonical_type('a.type'), O.canonical_type('b.type'))} AS score FROM ({TYPED}) a CROSS JOIN ({TYPED}) b")
def type_compat_b(spark, sf_dir):
    return type_pairs(spark, sf_dir).withColumn("score", S.type_compat_b(X.canonical_type("a"), X.canonical_type("b")))


@query(f"SELECT a.type AS a, b.type AS b, (lower(trim(a.type)) = lower(trim(b.type)))::INT::DOUBLE AS score FROM ({TYPED}) a CROSS JOIN ({TYPED}) b")
def exact_type(spark, sf_dir):
    return type_pairs(spark, sf_dir).withColumn("score", S.exact_type("a", "b"))


SLOT_SQL = ", ".join(
    f"CASE WHEN regexp_matches(text, {O.quoted(V.SLOT_PATTERNS[s])}) OR len(list_intersect(tok, {O.words(V.SLOT_WORDS.get(s, ''))}::VARCHAR[])) > 0 THEN '{s}' END"
    if s in V.SLOT_PATTERNS
    else f"CASE WHEN len(list_intersect(tok, {O.words(V.SLOT_WORDS[s])})) > 0 THEN '{s}' END"
    for s in dict.fromkeys([*V.SLOT_PATTERNS, *V.SLOT_WORDS])
)


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter([{SLOT_SQL}], lambda x: x IS NOT NULL)), ' ') AS slots FROM (SELECT doc_id, text, string_split(lower(text), ' ') AS tok FROM documents)")
def slots(spark, sf_dir):
    """The kinds of value in whole texts, by patterns and by words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.slots("text", F.split(F.lower("text"), " ")), " ").alias("slots"))


# --- pair features --------------------------------------------------------------------------------------------------
@query(f"WITH {O.COMPONENTS} SELECT src_pos, tgt_pos, round(path_score, 6) AS score FROM parts WHERE path_score > 0")
def path_jaccard(spark, sf_dir):
    """By inverted index over distinct paths: pairs that share no token never meet."""
    src, tgt = catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir)
    of = lambda df, key: df.select(F.col("path").alias(key)).distinct().withColumn("tokens", X.path_tokens(key))
    hits = lexical.jaccard_by_index(of(src, "a"), of(tgt, "b"))
    out = hits.join(src.select(F.col("path").alias("a"), F.col("pos").alias("src_pos")), "a").join(tgt.select(F.col("path").alias("b"), F.col("pos").alias("tgt_pos")), "b")
    return out.select("src_pos", "tgt_pos", F.round("score", 6).alias("score"))


@query(
    f"""WITH {O.CATALOGS}, tok AS (SELECT name, {O.rich_tokens('name')} AS t FROM (SELECT DISTINCT p_name AS name FROM part)), u AS (SELECT name, list_distinct(t) AS t FROM tok)
SELECT a.name AS a, b.name AS b, round({O.jaccard('a.t', 'b.t')}, 6) AS score FROM u a CROSS JOIN u b WHERE len(list_intersect(a.t, b.t)) > 0"""
)
def token_overlap(spark, sf_dir):
    """Jaccard similarity of rich tokens of every two names that share one."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    out = lexical.jaccard_by_index(names.withColumn("tokens", X.rich_tokens("a")), names.select(F.col("a").alias("b"), X.rich_tokens("a").alias("tokens")))
    return out.select("a", "b", F.round("score", 6).alias("score"))


TOP3 = "SELECT src_pos, tgt_pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src_pos ORDER BY score DESC, tgt_pos) AS rank FROM s) WHERE rank <= 3"


def top3(scores: DataFrame, digits: int = 6) -> DataFrame:
    return ranking.top_k(scores.withColumn("score", F.round("score", digits)), 3).select("src_pos", "tgt_pos", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {O.COMPONENTS}, s AS (SELECT src_pos, tgt_pos, round((1.0 * name_score + 0.3 * {O.compatibility(V.TYPE_COMPAT_A, 'a.type', 'b.type')} + 0.2 * path_score + 0.1 * type_score) / 1.6::DOUBLE, 6) AS score FROM parts JOIN src a ON a.pos = src_pos JOIN tgt b ON b.pos = tgt_pos) {TOP3}")
def combine_scores(spark, sf_dir):
    """The constraint combination with its default weights, over component similarities."""
    src, tgt = catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir)
    types = lambda df, p: df.select(F.col("pos").alias(f"{p}_pos"), F.col("type").alias(f"{p}_type"))
    rows = matchers.component_scores(src, tgt).join(types(src, "src"), "src_pos").join(types(tgt, "tgt"), "tgt_pos")
    s = matchers.combine(F.col("name_score"), S.type_compat_a("src_type", "tgt_type"), F.col("path_score"), F.col("type_score"))
    return top3(rows.select("src_pos", "tgt_pos", s.alias("score")))


@query(f"WITH {O.COMPONENTS}, s AS (SELECT src_pos, tgt_pos, round((0.4::DOUBLE * name_score + 0.2::DOUBLE * type_score + 0.4::DOUBLE * path_score) / 1.0, 6) AS score FROM parts) {TOP3}")
def weighted_integrated(spark, sf_dir):
    parts = matchers.component_scores(catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir))
    return top3(parts.select("src_pos", "tgt_pos", matchers.weighted(F.col("name_score"), F.col("type_score"), F.col("path_score")).alias("score")))


@query(f"WITH {O.COMPONENTS}, g AS (SELECT max(name_score + path_score) AS top FROM parts), s AS (SELECT src_pos, tgt_pos, round(name_score + 0.3 * type_score + path_score + 0.1::DOUBLE * ((name_score + path_score) / top), 6) AS score FROM parts CROSS JOIN g) {TOP3}")
def integrated_scores(spark, sf_dir):
    """The unnormalised sum with a lexical part that is divided by its largest value of all."""
    parts = matchers.component_scores(catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir)).withColumn("lex", F.col("name_score") + F.col("path_score"))
    lex = ranking.global_max_normalized(parts, "lex")
    return top3(lex.select("src_pos", "tgt_pos", matchers.integrated(F.col("name_score"), F.col("type_score"), F.col("path_score"), F.col("lex")).alias("score")))


@query(f"WITH {O.SCORES}, n AS (SELECT src_pos, tgt_pos, round(score / greatest(max(score) OVER (PARTITION BY src_pos), 1e-9), 6) AS score FROM s) SELECT src_pos, count(*) AS n, round(sum(score), 4) AS total, max(score) AS top FROM n GROUP BY src_pos")
def rowmax_norm(spark, sf_dir):
    s, *_ = base_scores(spark, sf_dir)
    n = ranking.row_max_normalized(s).withColumn("score", F.round("score", 6))
    return n.groupBy("src_pos").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.max("score").alias("top"))


# --- ranking and metrics --------------------------------------------------------------------------------------------
@query(f"WITH {O.SCORES}{O.TRUTH}{O.RANKED} {O.metrics()}")
def rank_metrics(spark, sf_dir):
    return evaluation.flagship(spark, sf_dir)


@query(f"WITH {O.SCORES}{O.TRUTH}{O.RANKED} SELECT src_pos, min(rank) FILTER (relevant) AS rank FROM r GROUP BY src_pos HAVING count(*) FILTER (relevant) > 0")
def rank_hits(spark, sf_dir):
    s, truth, *_ = base_scores(spark, sf_dir)
    return ranking.best_ranks(s, truth).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {O.SCORES} SELECT src_pos, tgt_pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src_pos ORDER BY score DESC, tgt_pos) AS rank FROM s) WHERE rank <= 5")
def topk(spark, sf_dir):
    s, *_ = base_scores(spark, sf_dir)
    return ranking.top_k(s, 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {O.SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY src_pos ORDER BY score DESC, tgt_pos) AS k FROM s) SELECT round(avg(m), 6) AS top1_margin FROM (SELECT src_pos, max(score) FILTER (k = 1) - max(score) FILTER (k = 2) AS m FROM k GROUP BY src_pos)")
def top1_margin(spark, sf_dir):
    return ranking.top1_margin(base_scores(spark, sf_dir)[0])


@query(f"WITH {O.SCORES} SELECT avg(n) AS avg_candidates, min(n) AS min_candidates, max(n) AS max_candidates FROM (SELECT src_pos, count(*) AS n FROM s GROUP BY src_pos)")
def candidate_stats(spark, sf_dir):
    return ranking.candidate_stats(base_scores(spark, sf_dir)[0])


@query(f"WITH {O.SCORES}{O.PROBS} SELECT src_pos, round(sum(prob), 6) AS total, round(max(prob), 6) AS top, round(min(prob), 6) AS low FROM p GROUP BY src_pos")
def softmax(spark, sf_dir):
    p = ranking.softmax(base_scores(spark, sf_dir)[0])
    return p.groupBy("src_pos").agg(F.round(F.sum("prob"), 6).alias("total"), F.round(F.max("prob"), 6).alias("top"), F.round(F.min("prob"), 6).alias("low"))


@query(f"WITH {O.SCORES}{O.PROBS} SELECT bool_and(abs(t - 1) < 1e-3) AS probabilities FROM (SELECT sum(prob) AS t FROM p GROUP BY src_pos)")
def looks_like_probs(spark, sf_dir):
    p = ranking.softmax(base_scores(spark, sf_dir)[0], 1.0)
    return ranking.looks_like_probabilities(p.select("src_pos", "tgt_pos", F.col("prob").alias("score")))


@query(f"WITH {O.SCORES}{O.TRUTH}, r AS (SELECT s.src_pos, s.tgt_pos, row_number() OVER (PARTITION BY s.src_pos ORDER BY s.score DESC, md5('42:' || CAST(s.tgt_pos AS VARCHAR))) AS rank, t.src_pos IS NOT NULL AS relevant FROM s LEFT JOIN t ON s.src_pos = t.src_pos AND s.tgt_pos = t.tgt_pos) SELECT round(avg((k <= 1)::INT), 6) AS random_hit_at_1 FROM (SELECT min(rank) FILTER (relevant) AS k FROM r GROUP BY src_pos) WHERE k IS NOT NULL")
def random_hit1(spark, sf_dir):
    s, truth, *_ = base_scores(spark, sf_dir)
    return ranking.random_hit1(s, truth)


# --- calibration ----------------------------------------------------------------------------------------------------
#: A text's length stands in for the confidence that its label is good.
LABELLED = "SELECT l.doc_id, floor(least(4000, length(d.text)) / 4) / 1000.0::DOUBLE AS conf, l.quality::DOUBLE AS correct FROM labels l JOIN documents d USING (doc_id)"


def labelled(spark, sf_dir) -> DataFrame:
    """(doc_id, conf, correct): a text's length as the confidence that its label is good."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", (F.floor(F.least(F.lit(4000), F.col("n")) / 4) / 1000.0).alias("conf"), F.col("quality").cast("double").alias("correct"))


@query(f"WITH top AS ({LABELLED}) {O.ece('top', 'CASE WHEN conf > 0 THEN least(ceil(conf * 15), 15) END')}")
def ece(spark, sf_dir):
    return calibration.ece(labelled(spark, sf_dir), 15)


@query(f"WITH top AS ({LABELLED}) {O.ece('top', 'CASE WHEN conf < 1 THEN floor(conf * 15) END')}")
def ece_left_closed(spark, sf_dir):
    return calibration.ece(labelled(spark, sf_dir), 15, calibration.lower_bin)


@query(f"WITH {O.SCORES}{O.TRUTH}{O.PROBS}{O.TOPS} {O.ece('top', 'CASE WHEN conf > 0 THEN least(ceil(conf * 15), 15) END')}")
def ece_from_scores(spark, sf_dir):
    s, truth, *_ = base_scores(spark, sf_dir)
    return calibration.ece(ranking.top1(ranking.softmax(s), truth), 15)


@query(f"WITH top AS ({LABELLED}), pooled AS (SELECT conf, sum(correct) AS s, count(*) AS n FROM top GROUP BY conf){O.ISOTONIC} SELECT conf, round(fitted, 6) AS fitted FROM fit")
def isotonic(spark, sf_dir):
    """The isotonic fit at every confidence there is."""
    tops = labelled(spark, sf_dir)
    model = calibration.fit_isotonic(tops)
    return calibration.predict(model, tops.select("conf").distinct()).select("conf", F.round("fitted", 6).alias("fitted"))


PROBS_OF_DOCS = "SELECT doc_id AS src_pos, k AS tgt_pos, CASE k WHEN 0 THEN c WHEN 1 THEN (1 - c) * 0.75 ELSE (1 - c) * 0.25 END AS prob FROM (SELECT doc_id, 0.55::DOUBLE + conf * 0.4 AS c FROM top) CROSS JOIN (SELECT unnest(range(3)) AS k)"


@query(
    f"""WITH top AS ({LABELLED}), p AS ({PROBS_OF_DOCS}), pooled AS (SELECT prob AS conf, sum(correct) AS s, count(*) AS n FROM p JOIN top ON top.doc_id = src_pos WHERE tgt_pos = 0 GROUP BY prob){O.ISOTONIC},
c AS (SELECT src_pos, prob AS c0, fitted AS c1 FROM p JOIN fit ON fit.conf = prob WHERE tgt_pos = 0),
n AS (SELECT p.src_pos, p.tgt_pos, CASE WHEN tgt_pos = 0 THEN c1 WHEN 1 - c0 <= 1e-12 THEN (1 - c1) / 2 ELSE prob * (1 - c1) / (1 - c0) END AS q FROM p JOIN c ON p.src_pos = c.src_pos)
SELECT src_pos, tgt_pos, round(q / sum(q) OVER (PARTITION BY src_pos), 6) AS prob FROM n"""
)
def apply_isotonic(spark, sf_dir):
    """Three classes for each labelled document; the likeliest is calibrated and the others share the rest."""
    top = labelled(spark, sf_dir)
    c = F.lit(0.55) + F.col("conf") * 0.4
    share = F.when(F.col("k") == 0, c).when(F.col("k") == 1, (1 - c) * 0.75).otherwise((1 - c) * 0.25)
    rows = top.select("doc_id", "conf", "correct", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("k")).select(F.col("doc_id").alias("src_pos"), F.col("k").alias("tgt_pos"), share.alias("prob"), "correct")
    model = calibration.fit_isotonic(rows.where("tgt_pos = 0").select(F.col("prob").alias("conf"), "correct"))
    return calibration.apply_isotonic(rows.drop("correct"), model).select("src_pos", "tgt_pos", F.round("prob", 6).alias("prob"))


@query(
    f"""WITH {O.CATALOGS}, pair AS (SELECT a.field_id AS source, b.field_id AS target FROM src a JOIN tgt b ON a.name = b.name AND a.type = b.type),
o AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM pair))
SELECT pair.source, target, CASE WHEN k <= least(greatest(1, floor(n * 0.2::DOUBLE)), n - 1) THEN 'calib' ELSE 'eval' END AS part FROM pair JOIN o ON o.source = pair.source"""
)
def calib_split(spark, sf_dir):
    return pairs.split_by_source(catalog.part_pairs(spark, sf_dir, same_type=True)).select("source", "target", "part")


@query(
    f"""WITH {O.SCORES}{O.TRUTH}, pair AS (SELECT a.field_id AS source, a.pos AS src_pos FROM src a),
o AS (SELECT src_pos, row_number() OVER (ORDER BY md5('42:' || source), source) AS k, count(*) OVER () AS n FROM pair),
part AS (SELECT src_pos, k <= least(greatest(1, floor(n * 0.2::DOUBLE)), n - 1) AS calib FROM o){O.PROBS}{O.TOPS},
et AS (SELECT top.* FROM top JOIN part USING (src_pos) WHERE NOT calib)
SELECT count(*) AS n_eval, round(avg(conf), 6) AS mean_conf, round(avg(correct), 6) AS mean_correct FROM et"""
)
def calibration_split_summary(spark, sf_dir):
    """What the evaluated part of the split looks like before calibration."""
    s, _, src, tgt = base_scores(spark, sf_dir)
    split = pairs.split_by_source(catalog.part_pairs(spark, sf_dir))
    truth = pairs.truth(split.where("part = 'eval'"), src, tgt)
    tops = ranking.top1(ranking.softmax(s.join(truth.select("src_pos").distinct(), "src_pos", "left_semi")), truth)
    return tops.agg(F.count("*").alias("n_eval"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.round(F.avg("correct"), 6).alias("mean_correct"))


@query(
    """WITH v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, quality::DOUBLE AS value FROM labels), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT b, ('0x' || substr(md5('42:' || b || ':' || j), 1, 8))::BIGINT % n AS i FROM (SELECT unnest(range(200)) AS b) CROSS JOIN (SELECT n, unnest(range(n)) AS j FROM n)),
m AS (SELECT b, avg(value) AS m FROM d JOIN v USING (i) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM m"""
)
def bootstrap_ci(spark, sf_dir):
    from pyspark.sql import Window

    # the labels are the values of one metric; they are numbered by one sort
    v = table(spark, sf_dir, "labels").select((F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("i"), F.col("quality").cast("double").alias("value"))
    return ranking.bootstrap_ci(v, 200)


# --- lexical and dense matchers -------------------------------------------------------------------------------------
@query(
    r"""WITH dt AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS f FROM dt GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM dt GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf CROSS JOIN st GROUP BY term, n),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id AS src_pos, tf.doc_id AS tgt_pos, round(sum(qf * idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (avgdl + 1e-9)))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY 1, 2)
SELECT src_pos, tgt_pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src_pos ORDER BY score DESC, tgt_pos) AS rank FROM s) WHERE rank <= 3"""
)
def bm25(spark, sf_dir):
    """Benchmark passages against whole documents by inverted index."""
    tok = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tgt_pos"), tok.alias("tokens"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("src_pos"), tok.alias("tokens"))
    return top3(lexical.bm25(items, docs))


CHAR_TERMS = "flatten(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: flatten([" + ", ".join(f"CASE WHEN length(w) + 2 >= {n} THEN list_transform(range(1, length(w) + {4 - n}), lambda i: substr(' ' || w || ' ', i, {n})) ELSE {O.NONE} END" for n in range(2, 7)) + "])))"
WORD_TERMS = "list_concat(tok, CASE WHEN len(tok) > 1 THEN list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]) ELSE " + O.NONE + " END)"


@query(
    f"""WITH {O.CATALOGS}, c AS (SELECT 's' || CAST(pos AS VARCHAR) AS doc, concat_ws(' ', name, replace(lower(path), '.', ' '), type) AS text0, TRUE AS is_source FROM src UNION ALL SELECT 't' || CAST(pos AS VARCHAR), concat_ws(' ', name, replace(lower(path), '.', ' '), type), FALSE FROM tgt),
c2 AS (SELECT doc, is_source, regexp_replace(regexp_replace(text0, '#', '#', 'g'), '([a-z])(\\d)', '\\1 \\2', 'g') AS text FROM c),
c3 AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS tok FROM c2),
x AS (SELECT doc, 'c' AS block, unnest({CHAR_TERMS}) AS term FROM c3 UNION ALL SELECT doc, 'w', unnest({WORD_TERMS}) FROM c3),
tf AS (SELECT doc, block, term, count(*) AS tf FROM x GROUP BY ALL),
df AS (SELECT block, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT count(*) AS n FROM c3),
w0 AS (SELECT doc, block, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (block, term) CROSS JOIN n WHERE df <= CASE block WHEN 'c' THEN 0.95::DOUBLE ELSE 0.98::DOUBLE END * n),
w1 AS (SELECT doc, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc, block)) AS w FROM w0),
w2 AS (SELECT doc, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w1),
s AS (SELECT a.doc AS src_pos, b.doc AS tgt_pos, round(sum(a.w * b.w), 6) AS score FROM w2 a JOIN w2 b ON a.block = b.block AND a.term = b.term WHERE a.doc[1] = 's' AND b.doc[1] = 't' GROUP BY 1, 2)
SELECT src_pos, tgt_pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src_pos ORDER BY score DESC, tgt_pos) AS rank FROM s) WHERE rank <= 3"""
)
def tfidf(spark, sf_dir):
    """Character and word TF-IDF of plain tokens, sources against targets."""
    s, t = (matchers.sparse_catalog(c(spark, sf_dir), rich=False) for c in (catalog.part_sources, catalog.part_targets))
    best = lexical.tfidf_top_k(matchers.tfidf_corpus(s, t), X.tokens("text", False), F.col("text"), 3)
    return best.select("src_pos", "tgt_pos", "score", F.col("rank").cast("long").alias("rank"))


@query()
def bm25_ensemble(spark, sf_dir):
    """Rich tokens; tests hold it against a plain-Python version."""
    best = matchers.bm25_ensemble(catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir), k=3)
    return best.select("src_pos", "tgt_pos", "score", F.col("rank").cast("long").alias("rank"))


@query()
def tfidf_ensemble(spark, sf_dir):
    """Rich tokens; tests hold it against a plain-Python version."""
    best = matchers.tfidf_ensemble(catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir), k=3)
    return best.select("src_pos", "tgt_pos", "score", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM e),
s AS (SELECT a.vec_id AS src_pos, b.vec_id AS tgt_pos, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT src_pos, tgt_pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src_pos ORDER BY score DESC, tgt_pos) AS rank FROM s) WHERE rank <= 3"""
)
def cosine_topk(spark, sf_dir):
    """Each vector's nearest others by blocked products; the vectors stand in for a model's."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    return matchers.dense_top_k(e, e, 3).select("src_pos", "tgt_pos", "score", F.col("rank").cast("long").alias("rank"))


RULE_FEATURES = ", ".join(
    f"""{t}0 AS (SELECT pos, name, type, {O.rich_tokens('name')} AS nt, {O.rich_tokens('path')} AS pt FROM {t}),
{t}r AS (SELECT pos, {O.canonical_type('type')} AS ct, array_to_string(nt, '') AS nn, {O.rule_tokens('nt')} AS ns, {O.rule_tokens('pt')} AS ps FROM {t}0)"""
    for t in ("src", "tgt")
)
RULE_PAIRS = f"{O.CATALOGS}, {RULE_FEATURES}, j AS (SELECT a.pos AS src_pos, b.pos AS tgt_pos, a.ct AS ta, b.ct AS tb, a.nn AS an, b.nn AS bn, a.ns AS asn, b.ns AS bsn, a.ps AS aps, b.ps AS bps, {O.jaccard('a.ps', 'b.ps')} AS pj, a.nn <> '' AND a.nn = b.nn AS ex, a.ct <> '' AND a.ct = b.ct AS te, left(a.nn, 4) = left(b.nn, 4) AND a.nn <> '' AND b.nn <> '' AS p4, length(a.nn) >= 4 AND length(b.nn) >= 4 AS l4 FROM srcr a CROSS JOIN tgtr b)"


@query(f"WITH {RULE_PAIRS}, s AS (SELECT src_pos, tgt_pos, round(CASE WHEN ex AND te AND pj >= 0.5 THEN 0.28 WHEN ex AND te AND pj >= 0.2 THEN 0.08 WHEN ex AND pj >= 0.8 THEN 0.01 WHEN ex THEN 0 WHEN p4 AND l4 AND te AND pj >= 0.8 THEN 0.006 WHEN te AND pj >= 0.8 THEN 0.001 WHEN p4 AND l4 THEN 0.004 WHEN pj >= 0.8 THEN 0.002 ELSE 0 END::DOUBLE, 6) AS score FROM j) {TOP3}")
def rule_heuristic(spark, sf_dir):
    return top3(matchers.rule_heuristic(catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir)))


HAS = lambda side, ws: f"len(list_intersect(list_concat({side}sn, {side}ps), {O.words(' '.join(ws))})) > 0"


@query(
    f"""WITH {RULE_PAIRS}, k AS (SELECT *, {O.jaccard('asn', 'bsn')} AS nj, {O.overlap('asn', 'bsn')} AS no, {O.overlap('aps', 'bps')} AS po, an <> '' AND bn <> '' AND (contains(an, bn) OR contains(bn, an)) AS pa,
{O.compatibility(V.TYPE_COMPAT_B, 'ta', 'tb')} AS tc, ({HAS('a', V.SOURCE_WORDS)} AND {HAS('b', V.DESTINATION_WORDS)}) OR ({HAS('a', V.DESTINATION_WORDS)} AND {HAS('b', V.SOURCE_WORDS)}) AS pol FROM j),
m AS (SELECT *, ex OR nj >= 0.8 OR pa AS sig, CASE WHEN ex THEN 0.06 WHEN p4 THEN 0.008 ELSE 0 END::DOUBLE + CASE WHEN te THEN 0.01 ELSE 0 END::DOUBLE AS hs FROM k),
x AS (SELECT src_pos, tgt_pos, CASE WHEN NOT sig AND NOT (tc >= 1 AND pj >= 0.8) THEN 0::DOUBLE ELSE greatest(0::DOUBLE,
  CASE WHEN ex THEN 0.095 ELSE 0 END::DOUBLE + CASE WHEN pa THEN 0.012 ELSE 0 END::DOUBLE + CASE WHEN nj >= 0.8 THEN 0.035 WHEN nj >= 0.5 THEN 0.015 ELSE 0 END::DOUBLE
  + CASE WHEN no >= 0.8 THEN 0.012 WHEN no >= 0.5 THEN 0.004 ELSE 0 END::DOUBLE
  + CASE WHEN NOT sig THEN 0 WHEN pj >= 0.8 THEN 0.008 WHEN pj >= 0.5 THEN 0.003 ELSE 0 END::DOUBLE + CASE WHEN sig AND po >= 0.8 THEN 0.0015 ELSE 0 END::DOUBLE
  + CASE WHEN tc >= 1 THEN 0.006 WHEN tc >= 0.8 THEN 0.002 WHEN tc >= 0.3 THEN 0.0008 WHEN ta <> '' AND tb <> '' THEN -0.18 ELSE 0 END::DOUBLE - CASE WHEN pol THEN 1.15 ELSE 0 END::DOUBLE) END AS st,
  hs + CASE WHEN hs > 0 AND pj >= 0.8 THEN 0.01 WHEN hs > 0 AND pj >= 0.5 THEN 0.004 ELSE 0 END::DOUBLE AS hs FROM m),
s AS (SELECT src_pos, tgt_pos, round(0.78::DOUBLE * st + 0.1::DOUBLE * hs, 6) AS score FROM x) {TOP3}"""
)
def rule_enhanced(spark, sf_dir):
    return top3(matchers.rule_enhanced(catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir)))


def bare(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


PART_RATIOS = O.ratio(f"SELECT DISTINCT {bare('p_name')} AS a FROM part", f"SELECT DISTINCT {bare('p_name')} AS b FROM part")


@query(f"WITH RECURSIVE {PART_RATIOS} SELECT a, b, round(ratio, 6) AS ratio FROM ratio")
def lexical_bonus(spark, sf_dir):
    """Character ratio of every two distinct names."""
    ship(spark)
    names = table(spark, sf_dir, "part").select(S.bare_name("p_name").alias("a")).distinct()
    return pairs.product(names, names.select(F.col("a").alias("b")), "a", "b").select("a", "b", F.round(S.name_ratio("a", "b"), 6).alias("ratio"))


@query(
    f"""WITH RECURSIVE {O.COMPONENTS}, {PART_RATIOS}, f AS (SELECT src_pos, tgt_pos, a.type AS ta, b.type AS tb, {bare('a.name')} AS na, {bare('b.name')} AS nb, name_score, type_score, path_score FROM parts JOIN src a ON a.pos = src_pos JOIN tgt b ON b.pos = tgt_pos),
s AS (SELECT src_pos, tgt_pos, round((1.0::DOUBLE * round(0.3::DOUBLE * name_score + 0.5::DOUBLE * type_score + 0.2::DOUBLE * path_score, 6) + 0.3 * {O.compatibility(V.TYPE_COMPAT_A, 'ta', 'tb')} + 0.2 * path_score + 0.1 * ratio) / 1.6::DOUBLE, 6) AS score FROM f JOIN ratio r ON r.a = na AND r.b = nb) {TOP3}"""
)
def constrained_scores(spark, sf_dir):
    """Overlap scores as the cosine, with type, path and character constraints."""
    s, _, src, tgt = base_scores(spark, sf_dir)
    return top3(matchers.constrained(s, src, tgt))


@query()
def hungarian(spark, sf_dir):
    """One-to-one assignment of brands to part names, by how many parts they share."""
    p = table(spark, sf_dir, "part")
    counts = p.groupBy(F.substring("p_brand", 7, 3).cast("long").alias("src_pos"), F.crc32(F.col("p_name").cast("binary")).alias("tgt_pos")).agg(F.count("*").cast("double").alias("score"))
    return assignment.assign(counts)


@query(
    """WITH w AS (SELECT c.c_nationkey AS src_pos, s.s_nationkey AS tgt_pos, 1.0::DOUBLE * (c.c_nationkey = s.s_nationkey)::INT AS score FROM (SELECT DISTINCT c_nationkey FROM customer) c CROSS JOIN (SELECT DISTINCT s_nationkey FROM supplier) s)
SELECT src_pos::BIGINT AS src_pos, (CASE WHEN bool_or(score = 1) THEN src_pos ELSE -1 END)::BIGINT AS tgt_pos FROM w GROUP BY src_pos"""
)
def assignment_with_threshold(spark, sf_dir):
    """Nations of customers to nations of suppliers: equal nations are worth 1, all else 0 and refused."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("src_pos")).distinct()
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("tgt_pos")).distinct()
    return assignment.assign(a.crossJoin(b).withColumn("score", (F.col("src_pos") == F.col("tgt_pos")).cast("double")), tau=0.5)


# --- robustness and statistics --------------------------------------------------------------------------------------
@query(
    f"""WITH {O.CATALOGS}, p AS (SELECT a.field_id AS source, b.field_id AS target, a.pos AS sp, b.pos AS tp FROM src a JOIN tgt b ON a.name = b.name),
o AS (SELECT sp, count(*) AS n FROM p GROUP BY sp), i AS (SELECT tp, count(*) AS n FROM p GROUP BY tp)
SELECT (SELECT count(*) FROM src) AS n_source_fields, (SELECT count(*) FROM tgt) AS n_target_fields, (SELECT count(*) FROM p) AS n_gold_pairs, (SELECT count(*) FROM o) AS n_sources_with_gt,
(SELECT round(avg(n), 4) FROM o) AS avg_targets_per_source, (SELECT max(n) FROM o) AS max_targets_per_source, (SELECT count(*) FROM i) AS n_unique_targets_in_pairs,
(SELECT round(avg(n), 4) FROM i) AS avg_sources_per_target, (SELECT max(n) FROM i) AS max_sources_per_target, (SELECT count(*) FROM i WHERE n > 1) AS n_targets_with_multiple_sources"""
)
def dataset_stats(spark, sf_dir):
    return pairs.dataset_stats(catalog.part_pairs(spark, sf_dir), catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir))


@query(f"""WITH {O.CATALOGS} SELECT field_id, '[NAME] ' || name || ' [TYPE] ' || type || ' [PATH] slot0.slot1.slot2' AS text, 'slot0.slot1.slot2' AS path FROM src""")
def path_drift(spark, sf_dir):
    t = catalog.part_sources(spark, sf_dir).withColumn("text", X.serialize("nmo"))
    return stress.perturb_text(t, path_drift=True).select("field_id", "text", X.drift_path("path").alias("path"))


@query(f"""SELECT type, coalesce({O.case_table(V.TYPE_DRIFT, 'lower(trim(type))')}, 'string') AS drifted FROM ({TYPED})""")
def type_drift(spark, sf_dir):
    return typed(spark, sf_dir).select("type", X.drift_type("type").alias("drifted"))


STRESS_SETTINGS = {"Original": ("", ""), "MaskName": ("name", "name"), "MaskType": ("type", "type"), "MaskPath": ("path", "path"), "PathDrift": ("drift", ""), "TypeDrift": ("tdrift", "")}


def stress_score(a: str, b: str) -> str:
    name = "0.0" if a == "name" else O.jaccard("a.ntok", "b.ntok")
    kind = "0.0" if a == "type" else "(a.type = b.type)::INT::DOUBLE" if a != "tdrift" else "('string' = b.type)::INT::DOUBLE"
    path = "0.0" if a == "path" else O.jaccard("a.ptok" if a != "drift" else "['slot0', 'slot1', 'slot2']", "b.ptok")
    return f"round(0.3::DOUBLE * {name} + 0.5::DOUBLE * {kind} + 0.2::DOUBLE * {path}, 6)"


@query(
    f"WITH {O.CATALOGS}{O.TRUTH}, s AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS setting, a.pos AS src_pos, b.pos AS tgt_pos, {stress_score(*v)} AS score FROM srcf a CROSS JOIN tgtf b" for k, v in STRESS_SETTINGS.items())
    + "), r AS (SELECT s.*, row_number() OVER (PARTITION BY setting, s.src_pos ORDER BY score DESC, s.tgt_pos) AS rank, t.src_pos IS NOT NULL AS relevant FROM s LEFT JOIN t ON t.src_pos = s.src_pos AND t.tgt_pos = s.tgt_pos) "
    + O.metrics("r", "setting")
)
def stress_summary(spark, sf_dir):
    src, tgt, truth = evaluation.part_setup(spark, sf_dir)
    return stress.stress(src, tgt, truth, matchers.overlap_matcher)


@query(
    f"WITH {O.COMPONENTS}{O.TRUTH}, s AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS setting, src_pos, tgt_pos, round({v}, 6) AS score FROM parts" for k, v in {"name": "name_score", "type": "type_score", "path": "path_score", "weighted": "0.4::DOUBLE * name_score + 0.2::DOUBLE * type_score + 0.4::DOUBLE * path_score"}.items())
    + "), r AS (SELECT s.*, row_number() OVER (PARTITION BY setting, s.src_pos ORDER BY score DESC, s.tgt_pos) AS rank, t.src_pos IS NOT NULL AS relevant FROM s LEFT JOIN t ON t.src_pos = s.src_pos AND t.tgt_pos = s.tgt_pos) "
    + O.metrics("r", "setting")
)
def component_table(spark, sf_dir):
    src, tgt, truth = evaluation.part_setup(spark, sf_dir)
    return evaluation.component_table(src, tgt, truth)


@query("SELECT * FROM (SELECT n_nationkey AS ord, n_name AS model, (n_regionkey % 3)::DOUBLE AS hit_at_1, (n_nationkey % 4)::DOUBLE AS mrr, n_regionkey::DOUBLE AS ndcg_at_5 FROM nation) ORDER BY CASE WHEN hit_at_1 = 0 THEN -1 ELSE hit_at_1 END DESC, CASE WHEN mrr = 0 THEN -1 ELSE mrr END DESC, CASE WHEN ndcg_at_5 = 0 THEN -1 ELSE ndcg_at_5 END DESC, ord LIMIT 1")
def choose_best(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("model"), (F.col("n_regionkey") % 3).cast("double").alias("hit_at_1"), (F.col("n_nationkey") % 4).cast("double").alias("mrr"), F.col("n_regionkey").cast("double").alias("ndcg_at_5"))
    return ranking.choose_best(rows)


# --- training values ------------------------------------------------------------------------------------------------
#: Two views of a batch: each vector, and the mean of it and the first vector of its label.
VIEWS = "WITH e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS z1, label FROM embeddings), h AS (SELECT label, min_by(z1, i) AS h FROM e GROUP BY label), v AS (SELECT i, z1, list_transform(range(1, len(z1) + 1), lambda k: (z1[k] + h[k]) / 2) AS z2 FROM e JOIN h USING (label)), z AS (SELECT i, 1 AS view, z1 AS z FROM v UNION ALL SELECT i, 2, z2 FROM v)"


def views(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("z1"), "label")
    heads = e.groupBy("label").agg(F.min_by("z1", "i").alias("h"))
    return e.join(heads, "label").select("i", "z1", F.zip_with("z1", "h", lambda x, y: (x + y) / 2).alias("z2"))


@query(
    f"""{VIEWS}, n AS (SELECT i, view, z, sqrt(list_dot_product(z, z)) AS n FROM z),
l AS (SELECT a.i, a.view, CASE WHEN a.i = b.i AND a.view = b.view THEN -20 ELSE greatest(least(list_dot_product(a.z, b.z) / (a.n * b.n) / 0.05::DOUBLE, 20), -20) END AS l, a.i = b.i AND a.view <> b.view AS pos FROM n a CROSS JOIN n b)
SELECT round(avg(loss), 6) AS nt_xent FROM (SELECT i, view, ln(sum(exp(l - 20))) + 20 - sum(CASE WHEN pos THEN l ELSE 0 END) AS loss FROM l GROUP BY i, view)"""
)
def ntxent_value(spark, sf_dir):
    return training.nt_xent(views(spark, sf_dir))


FLAT = f"{VIEWS}, f AS (SELECT i, view, unnest(range(len(z))) AS d, unnest(z) AS x FROM z)"


@query(f"{FLAT} SELECT round(avg(greatest(1 - sqrt(v + 1e-4), 0)), 6) AS variance_loss FROM (SELECT d, var_pop(x) AS v FROM f GROUP BY d)")
def variance_value(spark, sf_dir):
    return training.variance_loss(training.two_views(views(spark, sf_dir))).select(F.round("variance_loss", 6).alias("variance_loss"))


@query(f"{FLAT} SELECT round(avg(c * c), 9) AS covariance_loss FROM (SELECT covar_samp(a.x, b.x) AS c FROM f a JOIN f b ON a.i = b.i AND a.view = b.view WHERE a.d <> b.d GROUP BY a.d, b.d)")
def covariance_value(spark, sf_dir):
    return training.covariance_loss(training.two_views(views(spark, sf_dir))).select(F.round("covariance_loss", 9).alias("covariance_loss"))


@query(f"{FLAT}, v1 AS (SELECT avg(greatest(1 - sqrt(v + 1e-4), 0)) AS v FROM (SELECT d, var_pop(x) AS v FROM f GROUP BY d)), c1 AS (SELECT avg(c * c) AS c FROM (SELECT covar_samp(a.x, b.x) AS c FROM f a JOIN f b ON a.i = b.i AND a.view = b.view WHERE a.d <> b.d GROUP BY a.d, b.d)) SELECT round(v + 0.25::DOUBLE * least(1, (SELECT count(*) FROM z) / 32.0::DOUBLE) * c, 6) AS varclr FROM v1, c1")
def varclr_value(spark, sf_dir):
    return training.varclr(views(spark, sf_dir), cov_weight=0.25)


@query(f"{VIEWS} SELECT round(avg((1 - list_dot_product(z1, z2) / sqrt(list_dot_product(z1, z1) * list_dot_product(z2, z2))) * CASE WHEN i % 2 = 0 THEN 1.0 ELSE 0.15 END::DOUBLE) * (1 - 0.35::DOUBLE * 0.4::DOUBLE), 6) AS teacher_anchor FROM v")
def teacher_anchor(spark, sf_dir):
    rows = views(spark, sf_dir).select(F.col("z1").alias("student"), F.col("z2").alias("teacher"), (F.col("i") % 2 == 0).alias("changed"))
    return training.teacher_anchor(rows, 0.4)


#: Names made of alias words, two by an order's keys and its status.
VIEW_WORDS = "source destination user session protocol message service address ip target server usr".split()
VIEW_TEXT = f"SELECT o_orderkey AS line_no, '[NAME] ' || {O.words(' '.join(VIEW_WORDS))}[o_orderkey % 12 + 1] || ' ' || {O.words(' '.join(VIEW_WORDS))}[o_custkey % 12 + 1] || ' ' || lower(o_orderstatus) || ' [TYPE] string [PATH] orders . ' || o_custkey AS text FROM orders"


def view_lines(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    w = F.array(*map(F.lit, VIEW_WORDS))
    name = F.concat_ws(" ", F.element_at(w, (F.col("o_orderkey") % 12 + 1).cast("int")), F.element_at(w, (F.col("o_custkey") % 12 + 1).cast("int")), F.lower("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit("[NAME] "), name, F.lit(" [TYPE] string [PATH] orders . "), F.col("o_custkey").cast("string")).alias("text"))


ALTS = {w: " ".join(x for x in g.split() if x != w) for g in V.ALIAS_GROUPS for w in g.split() if w not in V.PROTECTED_WORDS}


@query(
    f"""WITH x AS ({VIEW_TEXT}), a AS (SELECT line_no, text, string_split(regexp_extract(text, '\\[NAME\\] (.*?) \\[TYPE\\]', 1), ' ') AS p, regexp_extract(text, '( \\[TYPE\\].*)$', 1) AS rest FROM x),
b AS (SELECT *, list_transform(range(len(p)), lambda i: CASE WHEN len({O.lookup(ALTS, 'p[i + 1]')}) > 0 AND {O.chance(42, 'text', 'i::VARCHAR')} < 0.2 THEN ({O.lookup(ALTS, 'p[i + 1]')})[floor({O.chance(43, 'text', 'i::VARCHAR')} * len({O.lookup(ALTS, 'p[i + 1]')}))::INT + 1] ELSE p[i + 1] END) AS s FROM a),
c AS (SELECT *, CASE WHEN {O.chance(44, 'text')} < 0.15 THEN list_transform(list_filter(range(len(s)), lambda i: i <> floor({O.chance(45, 'text')} * len(s))::INT), lambda i: s[i + 1]) ELSE s END AS d FROM b)
SELECT line_no, '[NAME] ' || array_to_string(d, ' ') || rest AS view FROM c"""
)
def contrastive_views(spark, sf_dir):
    return training.contrastive_views(view_lines(spark, sf_dir)).select("line_no", "view")


@query(
    """WITH k AS (SELECT o_orderkey AS line_no, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
SELECT line_no, CAST(floor(k / 64) AS BIGINT) AS batch FROM k WHERE floor(k / 64) < floor(n / 64)"""
)
def mini_batches(spark, sf_dir):
    return training.mini_batches(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no")), 64).select("line_no", "batch")


# --- streaming ------------------------------------------------------------------------------------------------------
@query(
    f"""WITH {O.SCORES}, k AS (SELECT s.src_pos, s.score, tgt.field_id, row_number() OVER (PARTITION BY src_pos ORDER BY score DESC, tgt_pos) AS k FROM s JOIN tgt ON tgt.pos = s.tgt_pos)
SELECT CAST(src_pos AS VARCHAR) AS field_id, string_agg(field_id, '|' ORDER BY k) AS best FROM k WHERE k <= 3 GROUP BY src_pos"""
)
def stream_topk(spark, sf_dir):
    """The part table as a stream of arriving fields, each scored against the catalog; the result is its written output."""
    import uuid

    from ..shared import shared_dir
    from ..streaming.scoring import stream_top_k

    schema = table(spark, sf_dir, "part").schema
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/part.parque[t]")
    # a small file is one split, whose rows one task would score
    stream = stream.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    fields = stream.select(F.col("p_partkey").cast("string").alias("field_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("type"), F.concat_ws(".", "p_brand", "p_type", "p_name").alias("path"))
    best = stream_top_k(fields, catalog.part_targets(spark, sf_dir), 3).select("field_id", F.array_join(F.transform("best", lambda b: b["field_id"]), "|").alias("best"))
    best.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("field_id string, best string").parquet(f"{root}/out")
