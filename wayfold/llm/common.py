"""What the corpus operators share: safe column access, written tables, word streams.

Words are maximal runs of anything but the six ASCII white-space characters; on UTF-8 bytes
that is exactly what ``bytes.split()`` returns, so the Python paths never decode a text.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Keys that ``keyed_join`` broadcasts are fewer than this, whatever the tables hold.
HOT = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the columns called ``names``, by position: further columns whose names clash
    with these (also in another case, or twice) or with an operator's own do not matter."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def keep_rows(df: DataFrame, decide) -> DataFrame:
    """The columns of ``df``, row by row as ``decide`` leaves them. ``decide`` gets ``df`` with
    its columns renamed to ``_c0``, ``_c1``... and a function from an old name to a Column."""
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    out = decide(plain, lambda n: F.col(f"_c{names.index(n)}"))
    return out.select(*[F.col(f"_c{i}") for i in range(len(names))]).toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is configured, a temporary one, but only if
    driver and executors are one process: on a cluster that raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wayfold-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/wayfold-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and a lost executor costs
    no more than the tasks it ran."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no DataFrame in use reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key at most. ``counts`` (keys, n) holds the
    rows of ``left`` by key. Keys with more than one in ``HOT`` of all rows, so fewer than ``HOT``, are
    sent to the tasks with their rows of ``right``; of the rest no key can fill a task of the shuffle."""
    total = counts.agg(F.sum("n")).head()[0] or 0
    hot = written(counts.where(F.col("n") * F.lit(HOT) > F.lit(total)).select(*keys), "hot")
    if not hot.head(1):
        return left.join(right, keys, how)
    few = F.broadcast(hot)
    rest = left.join(few, keys, "left_anti").join(right.join(few, keys, "left_anti"), keys, how)
    dense = left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, how)
    return rest.unionByName(dense)


def identified(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``df`` with uid, a hash of the text, and rid, one of id and text. Both follow from a row's
    values, so they stay the same however often and in whatever splits the table is read."""
    return df.withColumn("uid", F.xxhash64(text)).withColumn("rid", F.xxhash64(F.lit(1), doc_id, text))


def one_of_equals(df: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``df`` that the table ``kept`` (uid, rid, copies) names, one of each: of rows with equal id and
    text the one with the least hash of all its columns, found with map-side minima."""
    keys = ["uid", "rid"]
    single = df.join(kept.where("copies = 1").select(*keys), keys, "left_semi")
    several = kept.where("copies > 1")
    if not several.head(1):
        return single
    rows = keyed_join(df, several.select(*keys), keys, several.select(*keys, F.col("copies").alias("n")), "left_semi")
    order = F.struct(F.xxhash64(F.to_json(F.struct(*df.columns))))
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")
    return single.unionByName(one)


def n_words(text: Column) -> Column:
    """Words in a text as a long; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0))), F.lit(0)).cast("long")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def texts_of(batch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch; null becomes empty."""
    import pyarrow as pa

    return [b or b"" for b in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
