"""Text tables: matrices, manifests, catalogues, and their sinks; Parquet is the native form of all of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_FILES = "id int, sky_area_id int, wavelength string, file_name string"
SKY_AREAS = "id int, field string, field_rect string, sigma_rect string"


def read_matrix(spark: SparkSession, path: str, sep: str = ",", kind: str = "double") -> DataFrame:
    """(path, v): a vector from each line; empty lines are skipped, quotes around values are dropped, and separators inside them belong to the value."""
    parts = _parts(F.trim("value"), sep)
    return spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("path"), F.transform(parts, lambda x: F.trim(x).cast(kind)).alias("v"))


def _parts(line: Column, sep: str) -> Column:
    """Values of a line; only lines with quotes are cut by the rule that counts them."""
    plain = re.escape(sep)
    quoted = F.transform(F.split(line, plain + '(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"|"$', ""), '""', '"'))
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, plain))


def read_pairs(spark: SparkSession, path: str, sep: str = ",", kinds: tuple[str, str] = ("int", "int")) -> DataFrame:
    """(key, value): the first two values of each line, the last line of a key wins within a file."""
    parts = _parts(F.trim("value"), sep)
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).cast(kinds[0]).alias("key"), F.get(parts, F.lit(1)).cast(kinds[1]).alias("value"), F.monotonically_increasing_id().alias("n"))
    return rows.groupBy("key").agg(F.max_by("value", "n").alias("value"))


def write_matrix(rows: DataFrame, v: str, path: str, sep: str = "\t", order: str | None = None) -> None:
    """A line for each vector; ordered within files if asked for."""
    text = rows.select(F.array_join(F.transform(v, lambda x: x.cast("string")), sep).alias("value"), *([order] if order else []))
    (text.sortWithinPartitions(order).select("value") if order else text).write.mode("overwrite").text(path)


def rectangle(text: Column) -> Column:
    """A rectangle b-t-l-r from text; ``None`` is null."""
    part = F.split(text, "-")
    at = lambda i: F.get(part, F.lit(i)).cast("int")
    return F.when(F.trim(text) != "None", F.struct(at(0).alias("bottom"), at(1).alias("top"), at(2).alias("left"), at(3).alias("right")))


def read_manifests(spark: SparkSession, areas: str, files: str, bands: list[str]) -> DataFrame:
    """Areas with the first file of each wanted band; areas that only files name are created."""
    from ..operators.catalog import attach_files

    a = spark.read.csv(areas, header=True, schema=SKY_AREAS).select(F.col("id").alias("sky_area_id"), "field", rectangle(F.col("field_rect")).alias("field_rect"), rectangle(F.col("sigma_rect")).alias("sigma_rect"))
    f = spark.read.csv(files, header=True, schema=IMAGE_FILES).where(F.col("wavelength").isin(bands))
    return attach_files(a, f, "sky_area_id", "wavelength", "id")


def write_manifests(areas: DataFrame, files: DataFrame, area_path: str, file_path: str, ignore: list[int] | None = None) -> None:
    """CSV manifests with headers, without the ignored areas."""
    areas.where(~F.col("id").isin(ignore or [])).write.mode("overwrite").csv(area_path, header=True)
    files.where(~F.col("sky_area_id").isin(ignore or [])).write.mode("overwrite").csv(file_path, header=True)


def read_stacked(spark: SparkSession, path: str, pattern: str, sep: str = ",") -> DataFrame:
    """(image, v): matrices of several files stacked; image is the number in the file name that the pattern captures, less one."""
    rows = read_matrix(spark, path, sep)
    return rows.select((F.regexp_extract("path", pattern, 1).cast("int") - 1).alias("image"), "v")


def field_of(name: Column, names: dict[str, int]) -> Column:
    """The field whose name occurs in a file name."""
    out = F.lit(None).cast("int")
    for text, i in reversed(list(names.items())):
        out = F.when(name.contains(text), F.lit(i)).otherwise(out)
    return out


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Text lines; the header goes to a file of its own, which sorts first."""
    lines.select("line").write.mode("overwrite").text(path)
    if header is not None:
        lines.sparkSession.range(1).select(F.lit(header).alias("line")).coalesce(1).write.mode("append").text(path)


def write_dense(rows: DataFrame, key: str, v: str, path: str) -> None:
    """Histogram rows as comma-separated text: the key, then its counts."""
    rows.select(F.concat_ws(",", F.col(key).cast("string"), F.transform(v, lambda x: x.cast("string"))).alias("line")).select("line").write.mode("overwrite").text(path)


def combined(tables: dict[int, DataFrame], columns: list[str]) -> DataFrame:
    """Tables of several fields stacked, the field's number first."""
    out = None
    for field, rows in tables.items():
        part = rows.select(F.lit(field).alias("field"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Config:
    """Settings of a run; ``read`` takes key=value lines with # comments and <<key>> macros, options win over the file."""

    metric: str = "pspearson"
    bands: tuple[str, ...] = ("g", "r", "i")
    patch: int = 6
    stride: int = 2
    max_nodes: int = 15_000
    target_clusters: int = 500
    n_samples: int = 500_000
    sigmas: tuple[float, ...] = (7.0, 3.0)
    least_patches: int = 8
    k: int = 30
    log: bool = True
    zscore: bool = True
    iterations: int = 0

    def text(self) -> str:
        """The settings as ``read`` takes them."""
        show = lambda v: ",".join(map(str, v)) if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else str(v)
        return "".join(f"{f.name}={show(getattr(self, f.name))}\n" for f in fields(self))

    def write(self, spark: SparkSession, path: str) -> None:
        """A text file folder with the settings."""
        spark.createDataFrame([(line,) for line in self.text().splitlines()], "line string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def read(cls, text: str, options: dict[str, str] | None = None) -> Config:
        pairs = dict(map(str.strip, line.split("#")[0].split("=", 1)) for line in text.splitlines() if "=" in line.split("#")[0])
        pairs |= options or {}
        for _ in pairs:
            pairs = {k: _expand(v, pairs) for k, v in pairs.items()}
        out = cls()
        for f in fields(cls):
            if f.name in pairs:
                setattr(out, f.name, _typed(pairs[f.name], getattr(out, f.name)))
        return out


def _expand(value: str, pairs: dict[str, str]) -> str:
    for k, v in pairs.items():
        value = value.replace(f"<<{k}>>", v)
    return value


def _typed(text: str, like):
    if isinstance(like, bool):
        return text.lower() in ("true", "y", "yes")
    if isinstance(like, tuple):
        return tuple(type(like[0])(p.strip()) for p in text.split(",") if p.strip())
    return type(like)(text)
