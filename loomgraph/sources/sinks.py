"""Writers: JSON records, CSV manifests, fine-tuning lines, indexes; each is one distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chat_lines(rows: DataFrame, system: str | None = None) -> DataFrame:
    """(conv_id, turn, line): chat messages, the system's first if there is one."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    parts = ([message("system", F.lit(system))] if system else []) + [message("user", F.col("question")), message("assistant", F.col("answer"))]
    keys = [c for c in rows.columns if c not in ("question", "answer")]
    return rows.select(*keys, F.to_json(F.struct(F.array(*parts).alias("messages"))).alias("line"))


def instruction_lines(rows: DataFrame, instruction: str) -> DataFrame:
    """(keys, line): instruction, input and output."""
    keys = [c for c in rows.columns if c not in ("question", "answer")]
    return rows.select(*keys, F.to_json(F.struct(F.lit(instruction).alias("instruction"), F.col("question").alias("input"), F.col("answer").alias("output"))).alias("line"))


def internal_lines(rows: DataFrame) -> DataFrame:
    keys = [c for c in rows.columns if c not in ("question", "answer")]
    return rows.select(*keys, F.to_json(F.struct("question", "answer")).alias("line"))


FORMATS = {"chat": chat_lines, "internal": internal_lines}


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("line").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON record a row; with ``by`` in a folder for each of its values."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_manifest(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV with a header and a fixed order of columns, written once at the end."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_texts(rows: DataFrame, path: str, key: str, text: str) -> None:
    """The text of each document in a folder of its own."""
    rows.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_index(rows: DataFrame, path: str) -> None:
    """The run index, as JSON and as CSV."""
    rows.write.mode("overwrite").json(f"{path}/json")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """A workbook as a folder of CSV sheets; quotes, line ends and outer blanks of cells are kept, as ``readers.sheets`` reads them."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder.rstrip('/')}/{name}.csv")
