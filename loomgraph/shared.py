"""Tables written to the folder that all executors share, so that what follows neither repeats nor plans their making again."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys, counted, that may be broadcast whole: some 25 MB of ids.
FEW = 200_000


def folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.  Where it is unset, a local session gets one of our own; on a
    cluster, whose machines share no such folder, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints_"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read from there: a branching plan stays small, and a lost executor costs no more than its tasks."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(keys: DataFrame) -> DataFrame:
    """``keys``, written once; marked for a broadcast if they are counted to be few, so that what they are joined to is not shuffled."""
    keys = kept(keys)
    return F.broadcast(keys) if keys.count() <= FEW else keys


def _place(key: Column) -> tuple[Column, Column]:
    """The row of ``sieve`` that holds a key's bit, and the bit; keys that are equal as text have the same."""
    at = F.pmod(F.xxhash64(key.cast("string")), F.lit(64 * max(1, FEW)))
    return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """(_row, _bits): a bit set for the hash of each key, in at most ``FEW`` rows however many keys there are, so that it may be broadcast.
    A key's bit is always set; that of another value is by chance: one time in 13 at 1,000,000 keys, one in 5 at 3,000,000."""
    row, bit = _place(F.col(column))
    return kept(keys.groupBy(row.alias("_row")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits")))


def sought(keys: DataFrame, column: str) -> Callable[..., DataFrame]:
    """A function (rows, of, how): the rows whose column ``of`` is among the keys (left_semi), or is not (left_anti).

    Few keys are broadcast.  Of more, their ``sieve`` is: rows that it drops are neither shuffled nor aggregated by what makes them,
    and only the others meet the keys in a shuffled join.
    """
    keys, bits = kept(keys.select(F.col(column).alias("_a")).distinct()), None
    if keys.count() <= FEW:
        keys = F.broadcast(keys)
    else:
        bits = F.broadcast(sieve(keys, "_a"))

    def found(rows: DataFrame, of: str, how: str = "left_semi") -> DataFrame:
        if bits is not None and how == "left_semi":
            row, bit = _place(F.col(of))
            rows = rows.join(bits, (row == F.col("_row")) & (F.getbit("_bits", bit) == 1), "left_semi")
        return rows.join(keys, F.col(of) == F.col("_a"), how)

    return found
