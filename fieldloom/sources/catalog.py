"""Catalogs of field records, ground-truth pairs and training lines, from files and from tables."""

from __future__ import annotations

import csv
import json
from dataclasses import asdict, dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Every attribute arrives as JSON text, so that scalars, lists and objects can share a column.
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("field_id", "name", "type", "path", "description", "desc", "examples", "example", "raw_msg", "msg", "vendor", "vendor_id", "product_family", "product")])
HEADER_WORDS = "name type path desc description examples example ex".split()


@dataclass
class RunConfig:
    """Options of a run; a run writes them beside its results and a later run reads them."""

    mode: str = "nmo"
    mask_name: bool = False
    drop_type: bool = False
    drop_path: bool = False
    drop_desc: bool = False
    drop_example: bool = False
    no_placeholder: bool = False
    ece_bins: int = 15
    calib_ratio: float = 0.2
    calib_seed: int = 42
    assign_tau: float = 0.5
    alpha: float = 1.0
    beta: float = 0.3
    gamma: float = 0.2
    delta: float = 0.1

    def write(self, folder: str) -> None:
        Path(folder, "run_config.json").write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def read(cls, folder: str) -> RunConfig:
        """The defaults where there is no file; unknown keys are ignored."""
        path = Path(folder, "run_config.json")
        known = json.loads(path.read_text()) if path.exists() else {}
        return cls(**{k: v for k, v in known.items() if k in cls.__dataclass_fields__})

    def serializer(self) -> dict:
        return {k: getattr(self, k) for k in ("mode", "mask_name", "drop_type", "drop_path", "drop_desc", "drop_example", "no_placeholder")}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines that are not blank, in file order. The number orders lines; it is not gapless."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value").where(F.btrim("value", F.lit(X.BLANKS)) != "")


def words_of(c: Column) -> Column:
    """A JSON list as its true items joined by spaces; anything else as its text."""
    items = F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull() & ~x.isin("", "0", "false", "null"))
    return F.when(c.startswith("["), F.array_join(items, " ")).otherwise(F.coalesce(c, F.lit("")))


def normalized_record() -> list[Column]:
    """The string view of a record: aliases resolved, type unwrapped, examples joined, null as empty."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    type_ = F.when(F.col("type").startswith("{"), F.coalesce(F.get_json_object("type", "$.base"), F.lit(""))).otherwise(X.text("type"))
    return [
        X.text("name").alias("name"),
        type_.alias("type"),
        X.text("path").alias("path"),
        pick("description", "desc").alias("desc"),
        words_of(F.col("examples")).alias("example"),
        pick("raw_msg", "msg").alias("raw_msg"),
        pick("vendor", "vendor_id").alias("vendor"),
        pick("product_family", "product").alias("product_family"),
    ]


#: Up to so many records one task numbers a catalog; beyond it, ranges of the order are numbered apart.
NUMBERED_AT_ONCE = 200_000


def positions(df: DataFrame, order: str = "first_line") -> DataFrame:
    """Gapless positions from 0 by `order`, a number that no two rows share."""
    n = df.count()
    if n <= NUMBERED_AT_ONCE:
        return df.withColumn("pos", (F.row_number().over(Window.orderBy(order)) - 1).cast("long")).drop(order)
    parts = -(-n // NUMBERED_AT_ONCE)
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts)
    part = reduce(lambda out, c: out + (F.col(order) > c).cast("int"), cuts, F.lit(0))
    rows = df.withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return rows.join(F.broadcast(before), "_part").withColumn("pos", at.cast("long")).drop(order, "_part", "_before")


def parse_catalog(lines: DataFrame) -> DataFrame:
    """A catalog from (line_no, value) JSON lines: the place of an id's first line, the values of its last.

    A line that is no JSON object, or has no field_id, is an error when it is read.
    """
    rec = F.from_json("value", RECORD, {"mode": "FAILFAST"})
    rows = lines.select("line_no", rec.alias("r")).select("line_no", F.when(F.col("r.field_id").isNull(), F.raise_error(F.lit("a record has no field_id"))).otherwise(F.col("r.field_id")).alias("field_id"), "r")
    last = rows.groupBy("field_id").agg(F.min("line_no").alias("first_line"), F.max_by("r", "line_no").alias("r"))
    rest = [F.col(f"r.{f.name}") for f in RECORD if f.name != "field_id"]
    return positions(last.select("field_id", "first_line", *rest).select("field_id", "first_line", *normalized_record()))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """field_id, pos and the normalized record of a JSON-lines file."""
    return parse_catalog(numbered_lines(spark, path))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """(source, target) of lines(value) of JSON: those with label 1, which is the default. Repeated pairs stay."""
    rows = lines.select(F.from_json("value", "source string, target string, label int").alias("p")).select("p.*")
    return rows.where(F.coalesce("label", F.lit(1)) == 1).select("source", "target")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_pairs(numbered_lines(spark, path))


def paired_texts(pairs: DataFrame, source: DataFrame, target: DataFrame, max_pairs: int | None = 100_000) -> DataFrame:
    """(source, target, text_a, text_b): the first max_pairs pairs, or all, with both texts, an unknown id giving none."""
    a = source.select(F.col("field_id").alias("source"), F.col("text").alias("text_a"))
    b = target.select(F.col("field_id").alias("target"), F.col("text").alias("text_b"))
    first = pairs if max_pairs is None else pairs.withColumn("_n", F.monotonically_increasing_id()).orderBy("_n").limit(max_pairs).drop("_n")
    return first.join(a, "source", "left").join(b, "target", "left").select("source", "target", X.text("text_a").alias("text_a"), X.text("text_b").alias("text_b"))


# --- training lines -------------------------------------------------------------------------------------------------
def looks_like_header(line: str, strict: bool = True) -> bool:
    """strict: one of the cells is a known column name. Otherwise any known name within the line counts, even in data."""
    low = line.replace("\ufeff", "").lower()
    if strict:
        return bool({c.strip().strip('"') for c in low.split(",")} & set(HEADER_WORDS))
    return any(w in low for w in HEADER_WORDS)


def raw_line(c: Column | str) -> Column:
    """A raw log line without the tag before its first colon, where it has angle brackets."""
    c = X.text(c)
    return F.when(c.contains("<") & c.contains(">") & c.contains(":"), X.strip(F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1))).otherwise(c)


def header_cells(line: str) -> list[str]:
    """The names of a header line in lower case, without a byte order mark; quoted commas do not part them."""
    return [c.strip().lower() for c in next(csv.reader([line.replace("\ufeff", "")]))]


def parse_training(lines: DataFrame, first: str, first_no: int, mode: str = "nmo", strict_header: bool = True, multiplier: int = 1, **flags) -> DataFrame:
    """(line_no, text): the serialised rows of lines(line_no, value), of which `first` is the first, numbered first_no.

    With a header, cells are bound by its names. Without one: five or more cells are name, desc, path, type, example;
    four lack the example; three are name, type, path; other lines are taken as they are.
    """
    n = F.size(F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    if looks_like_header(first, strict_header):
        names = header_cells(first)
        cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), {"mode": "PERMISSIVE"})
        at = lambda *keys: F.coalesce(*[F.nullif(F.col(f"r.c{names.index(k)}"), F.lit("")) for k in keys if k in names], F.lit(""))
        rows = lines.where(F.col("line_no") != first_no).select("line_no", "value", cells.alias("r"))
        fields = rows.select("line_no", "value", at("name").alias("name"), at("type").alias("type"), at("path").alias("path"), at("desc", "description").alias("desc"), at("example", "examples", "ex").alias("example"), F.lit(True).alias("structured"))
    else:
        # what follows the fifth cell is not read
        cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(5)), {"mode": "PERMISSIVE"})
        rows = lines.select("line_no", "value", cells.alias("r"), n.alias("n"))
        pick = lambda five, three: F.when(F.col("n") >= 4, F.col(f"r.c{five}") if five is not None else F.lit("")).when(F.col("n") == 3, F.col(f"r.c{three}") if three is not None else F.lit(""))
        fields = rows.select("line_no", "value", pick(0, 0).alias("name"), pick(3, 1).alias("type"), pick(2, 2).alias("path"), pick(1, None).alias("desc"), F.when(F.col("n") >= 5, F.col("r.c4")).otherwise("").alias("example"), (F.col("n") >= 3).alias("structured"))
    shown = raw_line("value") if mode in ("raw_msg", "msg") else F.when(F.col("structured"), X.serialize(mode, raw_msg=F.lit(""), **flags)).otherwise(F.col("value"))
    out = fields.select("line_no", shown.alias("text"))
    return out if multiplier <= 1 else out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(multiplier)))).drop("_copy")


def read_training_lines(spark: SparkSession, path: str, mode: str = "nmo", **options) -> DataFrame:
    """parse_training() of a text file; a file that does not exist, or is empty, is an empty table."""
    empty = spark.createDataFrame([], "line_no long, text string")
    try:
        lines = numbered_lines(spark, path)
        first = lines.orderBy("line_no").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    return empty if first is None else parse_training(lines, first.value, first.line_no, mode, **options)


def read_training_files(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """(file_no, line_no, text) of several files, each with its own header or none, in the order given."""
    files = [read_training_lines(spark, path, **options).select(F.lit(i).alias("file_no"), "line_no", "text") for i, path in enumerate(paths)]
    return reduce(DataFrame.unionByName, files)


def distinct_texts(lines: DataFrame) -> DataFrame:
    """(line_no, text): each stripped text once, at its first line; empty ones go."""
    return lines.select("line_no", X.strip("text").alias("text")).where("text <> ''").groupBy("text").agg(F.min("line_no").alias("line_no")).select("line_no", "text")


# --- catalogs over tables -------------------------------------------------------------------------------------------
def with_optional(df: DataFrame) -> DataFrame:
    for name in ("desc", "example", "raw_msg"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    return df


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a source field: its name, its type in lower case, its path brand.type.name."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return with_optional(
        part.select(
            F.col("p_partkey").cast("string").alias("field_id"),
            F.col("p_partkey").alias("pos"),
            F.col("p_name").alias("name"),
            F.lower("p_type").alias("type"),
            F.concat_ws(".", "p_brand", "p_type", "p_name").alias("path"),
        )
    )


def part_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of part (name and type) as a target field, in the order of name and type."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kinds = part.select(F.col("p_name").alias("name"), F.lower("p_type").alias("type")).distinct()
    kinds = kinds.withColumn("pos", (F.row_number().over(Window.orderBy("name", "type")) - 1).cast("long"))
    return with_optional(kinds.select(F.concat_ws("/", "name", "type").alias("field_id"), "pos", "name", "type", F.concat_ws(".", "type", "name").alias("path")))


def part_pairs(spark: SparkSession, sf_dir: str, same_type: bool = False) -> DataFrame:
    """(source, target) ids that belong together: the kinds of a part's name, or its own kind alone."""
    s, t = part_sources(spark, sf_dir), part_targets(spark, sf_dir)
    s, t = s.select(F.col("field_id").alias("source"), "name", "type"), t.select(F.col("field_id").alias("target"), "name", "type")
    return s.join(t, ["name", "type"] if same_type else ["name"]).select("source", "target") if same_type else s.drop("type").join(t.drop("type"), "name").select("source", "target")
