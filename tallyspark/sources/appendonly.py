"""Whether files were only appended to since an earlier state, without reading that state's files.

A state keeps a digest for each split of a file (so many lines; the last one is shorter). Later the same lines of the files as
they are now are digested again: a split that is there with other content was rewritten, one that has fewer lines was
cut. A task holds the digests of one split's lines at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import SPLIT_ROWS, split_of


def _digests(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("record_index", F.sha2("line", 256).alias("d"))))
    return rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.sha2(F.concat_ws("", F.transform(ordered, lambda x: x["d"])), 256).alias("digest"))


def split_digests(lines: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """lines(file, record_index from 1, line) -> file, split, n, digest: the state to keep."""
    return _digests(lines.withColumn("split", split_of(F.col("record_index"), split_rows)))


def append_only(before: DataFrame, lines: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """before: see split_digests, of an earlier state; lines as they are now -> (file, status): `new`, `same`, `appended`,
    `changed` (a line of the earlier state is another one), `cut` (lines of it are missing at the end), `gone`."""
    now = lines.withColumn("split", split_of(F.col("record_index"), split_rows))
    known = before.select("file", "split", F.col("n").alias("was_n"), F.col("digest").alias("was"))
    place = F.col("record_index") - F.col("split") * split_rows
    again = _digests(now.join(known, ["file", "split"]).where(place <= F.col("was_n")))
    found = known.join(again, ["file", "split"], "left")
    # of a split that is shorter now, the lines that are left may be another's: that shows only where all are there
    same = found.groupBy("file").agg(F.bool_or((F.col("n") == F.col("was_n")) & (F.col("digest") != F.col("was"))).alias("changed"), F.bool_or(F.coalesce(F.col("n"), F.lit(0)) < F.col("was_n")).alias("cut"), F.sum("was_n").alias("was_lines"))
    sizes = now.groupBy("file").agg(F.count("*").alias("lines"))
    status = (
        F.when(F.col("was_lines").isNull(), "new")
        .when(F.col("lines").isNull(), "gone")
        .when(F.coalesce("changed", F.lit(False)), "changed")
        .when(F.col("cut"), "cut")
        .when(F.col("lines") > F.col("was_lines"), "appended")
        .otherwise("same")
    )
    return same.join(sizes, "file", "full").select("file", status.alias("status"))


def refused(statuses: DataFrame) -> DataFrame:
    """Files that were not only appended to."""
    return statuses.where(F.col("status").isin("changed", "cut", "gone"))
