"""Reports as whole documents: lines in order, made in the executors, and one file of them.

A document is a JSON object whose entries are small texts or sections, lists and maps of as many rows as
there are. Every row is a line; lines are numbered by ranges, so no task holds a section.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.numbered import numbered
from quern.plans.materialise import cut

#: Bytes that are copied at a time where a file system cannot join files itself.
BUFFER = 1 << 20


class Section(NamedTuple):
    """Rows with a column ``text`` (JSON; of a map with its key) in the order of other columns, which must tell them apart."""

    rows: DataFrame
    order: list[str]
    brackets: str = "[]"


def document(spark: SparkSession, entries: list[tuple[str, str | Section]]) -> DataFrame:
    """place, line of a JSON object: each entry in turn, a text as it is, a section row by row."""
    fixed, pieces, at = [(0, "{")], [], 1
    for k, (key, value) in enumerate(entries):
        comma = "," if k < len(entries) - 1 else ""
        if isinstance(value, str):
            fixed.append((at, f"{json.dumps(key)}:{value}{comma}"))
        else:
            rows = cut(numbered(value.rows.select(*value.order, "text"), value.order, "n"))
            total = rows.count()
            fixed.append((at, f"{json.dumps(key)}:{value.brackets[0]}"))
            pieces.append(rows.select((F.col("n") + at + 1).cast("bigint").alias("place"), F.when(F.col("n") < total - 1, F.concat("text", F.lit(","))).otherwise(F.col("text")).alias("line")))
            at += total + 1
            fixed.append((at, value.brackets[1] + comma))
        at += 1
    out = spark.createDataFrame([*fixed, (at, "}")], "place bigint, line string")
    for rows in pieces:
        out = out.unionByName(rows)
    return out


def map_entry(key: str) -> Column:
    """The text of a map's entry: the key's column as a JSON text, a colon, the column ``value``."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    return F.concat(quoted, F.lit(":"), F.col("value"))


def page(lines: DataFrame, title: str) -> DataFrame:
    """place, line of an HTML page that holds a document as data: no text in it can end the script it stands in."""
    head = ["<!doctype html>", f"<title>{title.replace('&', '&amp;').replace('<', '&lt;')}</title>", '<script type="application/json" id="report">']
    safe = F.replace(F.replace("line", F.lit("<"), F.lit("\\u003c")), F.lit(" "), F.lit("\\u2028"))
    inner = lines.select((F.col("place") + len(head)).alias("place"), safe.alias("line"))
    last = inner.agg((F.max("place") + 1).alias("place")).select("place", F.lit("</script>").alias("line"))
    return lines.sparkSession.createDataFrame(list(enumerate(head)), "place bigint, line string").unionByName(inner).unionByName(last)


def write(lines: DataFrame, path: str) -> None:
    """Writes the lines to one new file: parts by range of place, joined by the file system in their order.

    Where the file system joins files itself, no byte is moved again; elsewhere
    they are copied, a buffer at a time, as one file needs one writer.
    """
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    target, folder = place(path), f"{path}-{uuid.uuid4().hex}"
    files = target.getFileSystem(conf)
    if files.exists(target):
        raise FileExistsError(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut(lines).repartitionByRange(parts, "place").sortWithinPartitions("place").select("line").write.text(folder)
    found = sorted(s.getPath().toString() for s in files.listStatus(place(folder)) if s.getPath().getName().startswith("part-") and s.getLen())
    made = place(f"{folder}/whole")
    try:
        first, rest = place(found[0]), spark.sparkContext._gateway.new_array(place, len(found) - 1)
        for k, name in enumerate(found[1:]):
            rest[k] = place(name)
        if rest:
            files.concat(first, rest)
        made = first
    except UnsupportedOperationException:
        out = files.create(made, False)
        try:
            for name in found:
                part = files.open(place(name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, BUFFER, False)
                part.close()
        finally:
            out.close()
    # The name appears when the file is whole.
    if not files.rename(made, target):
        raise OSError(f"{path} could not be named")
    files.delete(place(folder), True)
