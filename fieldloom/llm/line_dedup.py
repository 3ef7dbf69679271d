"""Line dedup: explode normalised lines, hash them, count distinct documents per hash, drop, reassemble by position.

Only hashes are exploded and shuffled for the counts, after duplicates within a document are gone and with partial
sums on the map side, so a line that a third of all documents hold costs one row per task; the commonest lines are
broadcast, as no more than some thousands can be so common. The text itself moves once, to meet the few hashes that its
document has to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, join_hot, saved, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """For each line 128 bits of its key (no white space at both ends, A-Z in lower case), null under min_chars code points."""
    keys = F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), lower_ascii)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(k, F.lit(1)).alias("b"))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Every row of docs with the columns n_lines, n_dropped and kept_text in a struct named `lines` added.

    A line whose key has min_chars code points and stands in min_docs distinct ids goes, except in the largest id.
    Null or empty text: one empty line. Rows that share an id count as one document and lose the same lines; rows
    whose id is null count as one document, smaller than any other. An empty table gives an empty table. Columns of
    docs pass through untouched; one that is named `lines` is replaced.
    """
    lines = F.split(text_of(text_col), "\n", -1)
    hashes = saved(docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.array_compact(line_hashes(lines, min_chars)))).alias("h")), "hashes")
    # a null id becomes a value of the struct, so that it counts as a document of its own
    common = hashes.groupBy("h").agg(F.countDistinct(F.struct("id")).alias("ids"), F.count("*").alias("n"), F.max("id").alias("keeper"))
    common = saved(common.where(F.col("ids") >= min_docs).drop("ids"), "common")
    drops = (
        join_hot(hashes, common, ["h"], hashes.count())
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("drop_id"))
        .agg(F.collect_set("h").alias("drops"))
    )
    # the row travels as one struct, so that none of its names can clash
    rows = docs.drop("lines").select(F.struct("*").alias("row"))
    joined = rows.join(drops, F.col(f"row.`{id_col}`").eqNullSafe(drops.drop_id), "left")
    lines = F.split(text_of(f"row.`{text_col}`"), "\n", -1)
    marked = F.arrays_zip(lines.alias("line"), line_hashes(lines, min_chars).alias("h"))
    left = F.filter(marked, lambda x: ~F.coalesce(F.array_contains(F.col("drops"), x["h"]), F.lit(False)))
    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.transform(left, lambda x: x["line"]))
    result = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )
    return joined.withColumn("kept", kept).select("row", result.alias("lines")).select("row.*", "lines")
