"""Formats and sinks of sliced lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from timberline.errors import SpecError, need
from timberline.functions.text import iso


def plain_lines(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("line").alias("value"))


def json_lines(parsed: DataFrame) -> DataFrame:
    """{"timestamp": ISO text or null, "line": text} a line."""
    return parsed.select(F.to_json(F.struct(iso(F.col("timestamp")).alias("timestamp"), "line"), {"ignoreNullFields": "false"}).alias("value"))


def csv_field(c):
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(parsed: DataFrame) -> DataFrame:
    """timestamp,line with minimal quoting; a null timestamp is empty. The header is the file sink's."""
    return parsed.select(F.concat_ws(",", F.coalesce(iso(F.col("timestamp")), F.lit("")), csv_field(F.col("line"))).alias("value"))


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"plain": plain_lines, "json": json_lines, "csv": csv_lines}


def output_format(name: str) -> str:
    chosen = name.strip().lower() if isinstance(name, str) else ""
    need(chosen in FORMATS, f"unknown output format {name!r}; one of {', '.join(FORMATS)}")
    return chosen


def export(parsed: DataFrame, path: str | None = None, fmt: str = "plain", mode: str = "overwrite") -> int:
    """Writes the lines to a folder of text files, or prints them; returns their number, counted as they pass."""
    kind = output_format(fmt)
    watch = Observation()
    rows = parsed.observe(watch, F.count("*").alias("n"))
    if path is None:
        n = 0
        if kind == "csv":
            print("timestamp,line")
        for row in FORMATS[kind](parsed).toLocalIterator():
            print(row[0])
            n += 1
        return n
    if kind == "csv":
        rows.select(iso(F.col("timestamp")).alias("timestamp"), "line").write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    else:
        FORMATS[kind](rows).write.mode(mode).text(path)
    return watch.get["n"]


class OutputRouter:
    """One format to a folder, the console, or both; usable as a context. Writing before it is open raises."""

    def __init__(self, path: str | None = None, to_stdout: bool = False, fmt: str = "plain"):
        need(path is not None or to_stdout, "a path, the console, or both")
        self.path, self.to_stdout, self.fmt, self.opened, self.count = path, to_stdout, output_format(fmt), False, 0

    def open(self) -> "OutputRouter":
        """Makes the folder; a path that can't be one raises now, not at the first line."""
        if self.path is not None:
            jvm = SparkSession.active().sparkContext
            try:
                at = jvm._jvm.org.apache.hadoop.fs.Path(self.path)
                made = at.getFileSystem(jvm._jsc.hadoopConfiguration()).mkdirs(at)
            except Exception as e:
                raise SpecError(f"cannot write to {self.path}: {str(e).splitlines()[0]}") from e
            need(made, f"cannot write to {self.path}")
        self.opened, self.count = True, 0
        return self

    def close(self) -> None:
        self.opened = False

    __enter__ = open

    def __exit__(self, *_):
        self.close()

    def write(self, parsed: DataFrame, *_) -> int:
        """Also fits foreachBatch."""
        need(self.opened, "the router is not open")
        n = export(parsed, self.path, self.fmt, "append" if self.count else "overwrite") if self.path else 0
        if self.to_stdout:
            n = export(parsed, None, self.fmt)
        self.count += n
        return n
