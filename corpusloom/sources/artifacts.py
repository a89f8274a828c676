"""Tables on disk that are written once, known by a checksum, and swapped or restored whole."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.serving import content_mark


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names below a path of any file system that Spark reads, in order."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def write_artifact(rows: DataFrame, root: str, name: str, mode: str = "error") -> dict:
    """One compressed table `name` below root; its manifest row (name, n, mark) is returned and appended to root/_manifest.

    The commit protocol makes the table appear whole or not at all; without mode="overwrite" it is never written twice."""
    rows.write.mode(mode).option("compression", "zstd").parquet(f"{root}/{name}")
    n, mark = content_mark(rows.sparkSession.read.parquet(f"{root}/{name}"))
    entry = {"name": name, "n": n, "mark": mark}
    number = 1 + max((r.number for r in _entries(rows.sparkSession, root) if r.name == name), default=0)
    rows.sparkSession.createDataFrame([{**entry, "number": number}], _ENTRY).coalesce(1).write.mode("append").json(f"{root}/_manifest")
    return entry


_ENTRY = "name string, n long, mark string, number long"


def _entries(spark: SparkSession, root: str) -> list:
    """The manifest's rows in the order in which they were written; its files have no order of their own."""
    held = spark.read.schema(_ENTRY).json(f"{root}/_manifest").collect() if "_manifest" in _names(spark, root) else []
    return sorted(held, key=lambda r: r.number)


def manifest(spark: SparkSession, root: str) -> dict[str, tuple[int, str]]:
    """name -> (n, mark) of every table below root; of one that was written again the last entry holds."""
    return {r.name: (r.n, r.mark) for r in _entries(spark, root)}


def read_artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table, if it is what the manifest says: checked before the first row is given."""
    wanted, rows = manifest(spark, root).get(name), spark.read.parquet(f"{root}/{name}")
    if wanted is None or content_mark(rows) != wanted:
        raise ValueError(f"{root}/{name} is not what its manifest says")
    return rows


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """All tables below root, each row with the name of its table."""
    names = [n for n in _names(spark, root) if not n.startswith(("_", "."))]
    if not names:
        raise ValueError(f"no table below {root}")
    rows = spark.read.parquet(*[f"{root}/{n}" for n in names])
    return rows.withColumn("artifact", F.element_at(F.split(F.input_file_name(), "/"), -2))


def canonical_json(value) -> str:
    """Sorted keys and two blanks, so that equal values are equal bytes."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write_json_if_changed(value, path: str) -> bool:
    """A small export of the driver, replaced whole, and only if its bytes differ; whether it was written."""
    text = canonical_json(value)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    handle, held = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(held, path)
    return True


def write_original(content: bytes, path: str) -> str:
    """Bytes that are never overwritten: a name that other bytes have gets a part of their hash; the path that holds them."""
    stem, suffix = os.path.splitext(path)
    for name in (path, f"{stem}-{hashlib.sha256(content).hexdigest()[:16]}{suffix}"):
        try:
            with open(name, "xb") as f:
                f.write(content)
            return name
        except FileExistsError:
            with open(name, "rb") as f:
                if f.read() == content:
                    return name
    raise FileExistsError(path)


def claim(rows: DataFrame, key: str, marker: str, wanted, value) -> DataFrame:
    """rows with marker set to value where key is wanted and the marker is still null; `claimed` tells where."""
    free = F.coalesce((F.col(key) == F.lit(wanted)) & F.col(marker).isNull(), F.lit(False))
    return rows.withColumn("claimed", free).withColumn(marker, F.when(F.col("claimed"), F.lit(value)).otherwise(F.col(marker)))


def cache_then_ledger(vectors: DataFrame, ledger: DataFrame, root: str, key: str) -> DataFrame:
    """Write the vector cache first, ordered by key, then mark what it holds: no mark is ever without its vector."""
    write_artifact(vectors.sort(key), root, "vectors", "overwrite")
    held = vectors.sparkSession.read.parquet(f"{root}/vectors").select(key).distinct().withColumn("_held", F.lit(True))
    return ledger.join(held, key, "left").withColumn("embed_status", F.when(F.col("_held"), F.lit("embedded")).otherwise(F.col("embed_status"))).drop("_held")


def replace_table(rows: DataFrame, root: str, name: str) -> dict:
    """Snapshot the table, then write rows in its place; rows may be computed from it, as they are written before it goes."""
    spark = rows.sparkSession
    taken = _names(spark, root)
    number = 1 + max((int(n.rsplit(".", 1)[1]) for n in taken if n.startswith(f"_{name}.")), default=0)
    if name in taken:
        kept = spark.read.parquet(f"{root}/{name}")
        write_artifact(kept, root, f"_{name}.{number}")
    write_artifact(rows, root, f"_new_{name}.{number}")
    return write_artifact(read_artifact(spark, root, f"_new_{name}.{number}"), root, name, "overwrite")


def roll_back(spark: SparkSession, root: str, name: str) -> int:
    """Put the last snapshot back and check its rows against the manifest; how many they are."""
    taken = [n for n in _names(spark, root) if n.startswith(f"_{name}.")]
    if not taken:
        raise ValueError(f"no snapshot of {name}")
    last = max(taken, key=lambda n: int(n.rsplit(".", 1)[1]))
    entry = write_artifact(read_artifact(spark, root, last), root, name, "overwrite")
    if entry["n"] != manifest(spark, root)[last][0]:
        raise ValueError(f"{name} has {entry['n']} rows after the roll-back")
    return entry["n"]


def reembed(points: DataFrame, embed, group: str, key: str) -> DataFrame:
    """group, before, after, same: points with new vectors under the same ids, all embedded before anything is written by the caller.

    embed: points -> points; the counts of each group and the ids must agree."""
    a = points.groupBy(group).agg(F.count("*").alias("before"), F.bit_xor(F.xxhash64(key)).alias("_a"))
    b = embed(points).groupBy(group).agg(F.count("*").alias("after"), F.bit_xor(F.xxhash64(key)).alias("_b"))
    zero = F.lit(0).cast("long")
    out = a.join(b, group, "full_outer").withColumns({"before": F.coalesce("before", zero), "after": F.coalesce("after", zero)})
    return out.select(group, "before", "after", ((F.col("before") == F.col("after")) & F.col("_a").eqNullSafe(F.col("_b"))).alias("same"))
