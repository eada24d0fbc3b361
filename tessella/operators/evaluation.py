"""Labels against predictions: alignment, counts per class, and shares as whole millionths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(labels: DataFrame, rows: DataFrame, id_col: str = "chunk_id", hash_col: str = "text_hash") -> DataFrame:
    """(label id, row id, way): by text hash first, the rest by id; each label and each row is used once.

    labels and rows have id_col and hash_col. Equal hashes pair up in the order of their ids.
    """
    nth = F.row_number().over(Window.partitionBy(hash_col).orderBy(id_col))
    a = labels.select(F.col(id_col).alias("label_id"), hash_col, nth.alias("nth"))
    b = rows.select(F.col(id_col).alias("row_id"), hash_col, nth.alias("nth"))
    moved = a.join(b, [hash_col, "nth"]).select("label_id", "row_id", F.lit("hash").alias("way"))
    left = a.join(moved, "label_id", "left_anti").select("label_id")
    free = b.join(moved, "row_id", "left_anti").select("row_id")
    same = left.join(free, left.label_id == free.row_id).select("label_id", "row_id", F.lit("id").alias("way"))
    return moved.unionByName(same)


def share(part: Column, whole: Column) -> Column:
    """part / whole in millionths, rounded down; 0 without a whole."""
    return F.when(whole > 0, F.floor(part * 1_000_000 / whole)).otherwise(F.lit(0)).cast("long")


def class_counts(rows: DataFrame, truth: str, guess: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per class: true and false positives, false negatives, support, and precision, recall and F1 in millionths."""
    sides = rows.select(*by, F.explode(F.array_distinct(F.array(truth, guess))).alias("class"), truth, guess)
    hit, said, meant = (F.col(truth) == F.col("class")) & (F.col(guess) == F.col("class")), F.col(guess) == F.col("class"), F.col(truth) == F.col("class")
    count = lambda c: F.count(F.when(c, 1))
    out = sides.groupBy(*by, "class").agg(count(hit).alias("tp"), count(said & ~meant).alias("fp"), count(meant & ~said).alias("fn"), count(meant).alias("support"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision_e6": share(tp, tp + fp), "recall_e6": share(tp, tp + fn), "f1_e6": share(2 * tp, 2 * tp + fp + fn)})
