"""Datasets: named sets of files, their blocks, and loading one or many of them as one table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reads a dataset's path, or a list of some of its files, with the dataset's options.
Reader = Callable[[SparkSession, str | list[str], dict], DataFrame]


def _read(kind: str) -> Reader:
    return lambda spark, path, options: spark.read.format(kind).options(**options).load(path)


#: Dataset types by name, and the ending of their files where it isn't the name; register_format adds others.
FORMATS: dict[str, Reader] = {kind: _read(kind) for kind in ("parquet", "orc", "json", "csv")}
ENDINGS: dict[str, str] = {}
#: Columns that load(origin=True) adds: the file and row that a row was read from.
ORIGIN = ["kl_file", "kl_row"]


def register_format(name: str, reader: Reader, ending: str | None = None) -> None:
    FORMATS[name] = reader
    if ending:
        ENDINGS[name] = ending


@dataclass(frozen=True)
class DatasetSpec:
    """A path that a node holds. The id defaults to node and path."""

    path: str
    dataset_id: str | None = None
    node_id: str = "local"
    dataset_type: str = "parquet"
    options: dict = field(default_factory=dict)

    @property
    def id(self) -> str:
        return self.dataset_id or f"{self.node_id}@{self.path}"


def check_specs(specs: Iterable[DatasetSpec], nodes_required: bool = False) -> list[DatasetSpec]:
    """The specs as a list; ValueError for none, repeated ids, unknown types, and unbound nodes where they are required."""
    specs = list(specs)
    if not specs:
        raise ValueError("no datasets")
    ids = [s.id for s in specs]
    if len(set(ids)) < len(ids):
        raise ValueError(f"dataset ids repeat: {sorted({i for i in ids if ids.count(i) > 1})}")
    for spec in specs:
        if spec.dataset_type not in FORMATS:
            raise ValueError(f"unknown dataset type {spec.dataset_type!r}; known: {sorted(FORMATS)}")
        if nodes_required and not spec.node_id:
            raise ValueError(f"dataset {spec.id} is bound to no node")
    return specs


def _folder(spark: SparkSession, spec: DatasetSpec) -> tuple[object, object]:
    """The dataset's path and its file system, by Hadoop, so any store that Spark reads will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spec.path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, spec: DatasetSpec) -> list[str]:
    """The dataset's files, sorted: those of its type in the folder and, as Spark reads them, in partition folders below; or one such file.

    Names that begin with a dot or an underscore are left out. FileNotFoundError for missing paths, ValueError for a
    single file with another ending.
    """
    path, system = _folder(spark, spec)
    if not system.exists(path):
        raise FileNotFoundError(spec.path)
    ending = ENDINGS.get(spec.dataset_type, f".{spec.dataset_type}")
    status = system.getFileStatus(path)
    if status.isFile():
        if not path.getName().endswith(ending):
            raise ValueError(f"{spec.path} doesn't end in {ending}")
        return [str(status.getPath())]
    found, files = [], system.listFiles(path, True)
    top = len(str(status.getPath())) + 1
    while files.hasNext():
        name = str(files.next().getPath())
        inside = name[top:].split("/")
        if name.endswith(ending) and not any(part[0] in "._" for part in inside) and all("=" in part for part in inside[:-1]):
            found.append(name)
    return sorted(found)


def with_block(df: DataFrame, spec: DatasetSpec, block: Column | None = None) -> DataFrame:
    """Add dataset_id, node_id, block_id. A block is a file, named by its path inside the dataset, or what the expression says (a virtual block)."""
    if block is None:
        file = F.col("_metadata.file_path")
        root = df.sparkSession._jvm.org.apache.hadoop.fs.Path(spec.path).toUri().getRawPath().rstrip("/") + "/"
        at = F.locate(root, file)
        name = F.when(at > 0, F.substr(file, at + len(root))).otherwise(F.element_at(F.split(file, "/"), -1))
    else:
        name = block.cast("string")
    return df.select(
        "*",
        F.lit(spec.id).alias("dataset_id"),
        F.lit(spec.node_id).alias("node_id"),
        F.concat_ws("|", F.lit(spec.node_id), F.lit(spec.id), name).alias("block_id"),
    )


def load(
    spark: SparkSession,
    specs: Iterable[DatasetSpec],
    columns: list[str] | None = None,
    merge_schema: bool = False,
    blocks: bool = False,
    block: Column | None = None,
    origin: bool = False,
) -> DataFrame:
    """All datasets as one table.

    columns prunes the scan. merge_schema allows datasets, and files inside one, with different columns; what is
    missing is null. blocks adds dataset_id, node_id and block_id; origin adds ORIGIN, which orders rows that are equal otherwise. Files inside a dataset are read by Spark's own listing, never in a
    loop.
    """
    parts = []
    for spec in check_specs(specs):
        options = dict(spec.options)
        if spec.dataset_type in ("parquet", "orc") and merge_schema:
            options["mergeSchema"] = "true"
        df = FORMATS[spec.dataset_type](spark, spec.path, options)
        kept = list(df.columns if columns is None else columns)
        if origin:
            df = df.select("*", "_metadata", F.col("_metadata.file_path").alias(ORIGIN[0]), F.col("_metadata.row_index").alias(ORIGIN[1]))
            kept += ORIGIN
        if blocks:
            df = with_block(df, spec, block)
            kept += ["dataset_id", "node_id", "block_id"]
        if columns is not None or blocks or origin:
            df = df.select(*kept)
        parts.append(df)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=merge_schema)
    return out


def _some(spark: SparkSession, spec: DatasetSpec, files: list[str]) -> DataFrame:
    """Some files of the dataset by its own reader, with the columns of their partition folders."""
    read = FORMATS[spec.dataset_type]
    if not files:
        return read(spark, spec.path, dict(spec.options)).limit(0)
    path, system = _folder(spark, spec)
    inside = {} if system.getFileStatus(path).isFile() else {"basePath": spec.path}
    return read(spark, files, {**inside, **spec.options})


def shard_files(spark: SparkSession, spec: DatasetSpec, shard: int, shards: int) -> DataFrame:
    """The files whose place in the sorted listing is `shard` modulo `shards`; other files aren't opened."""
    if not 0 <= shard < shards:
        raise ValueError("shard must be from 0 to shards - 1")
    return _some(spark, spec, list_files(spark, spec)[shard::shards])


def block_files(df: DataFrame) -> DataFrame:
    """file_path, file_size of each file that a scan reads."""
    return df.select("_metadata.file_path", "_metadata.file_size").distinct()


def read_blocks(spark: SparkSession, spec: DatasetSpec, files: list[str], columns: list[str] | None = None) -> DataFrame:
    """Some files of the dataset, the given columns only."""
    out = _some(spark, spec, files)
    return out if columns is None else out.select(*columns)


def file_groups(spark: SparkSession, spec: DatasetSpec, size: int, columns: list[str] | None = None) -> Iterator[DataFrame]:
    """The dataset in groups of `size` files, in the listing's order, each a lazy table."""
    files = list_files(spark, spec)
    for at in range(0, len(files), size):
        yield read_blocks(spark, spec, files[at : at + size], columns)
