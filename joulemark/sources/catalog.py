"""Datasets by name: where they lie, how they are read and written, and the record of runs."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.helpers import flatten_dict, json_value, parse_options
from ..operators.common import nan_to_null

#: The formats of inputs, and the layers of a store.
FORMATS = {"csv": {"header": "true", "inferSchema": "true"}, "parquet": {}, "json": {}}
LAYERS = {"features": "01_raw", "labels": "01_raw", "validated": "02_intermediate", "preprocessed": "03_primary", "adequacy": "04_reporting", "activity": "05_model_output", "activity-adjusted": "05_model_output", "prediction": "05_model_output", "impact": "05_model_output", "metrics": "06_metrics", "model": "07_models"}
NAMESPACES = ("train", "test", "apply")


@dataclass
class Catalog:
    """A site's datasets below store_uri. tracked: outputs of a run lie below its identifier, so that runs stay apart.

    input_format and load_args are of both inputs, or dicts by input (features, labels)."""

    store_uri: str
    site: str
    namespace: str = "train"
    batch: str | None = None
    input_format: str | dict = "parquet"
    load_args: dict = field(default_factory=dict)
    input_uri: str | None = None
    tracked: bool = False
    run_id: str | None = None

    def __post_init__(self) -> None:
        if self.namespace not in NAMESPACES:
            raise ValueError(f"namespace is one of {', '.join(NAMESPACES)}")
        if any(f not in FORMATS for f in (self.input_format.values() if isinstance(self.input_format, dict) else [self.input_format])):
            raise ValueError(f"format is one of {', '.join(FORMATS)}")
        if self.batch is not None and self.namespace != "apply":
            raise ValueError("only namespace apply has batches")
        if isinstance(self.load_args, (list, tuple)):
            self.load_args = parse_options(self.load_args)
        if self.tracked and self.run_id is None:
            self.run_id = uuid.uuid4().hex

    def path(self, name: str) -> str:
        layer = LAYERS[name.removesuffix("-autoenc")]
        base = f"{self.store_uri.rstrip('/')}/{self.site}"
        scope = self.namespace + (f"/{self.batch}" if self.batch else "")
        if layer == "01_raw":
            return f"{(self.input_uri or f'{base}/{layer}/{scope}').rstrip('/')}/{name}"
        run = f"/runs/{self.run_id}" if self.tracked else ""
        return f"{base}{run}/{layer}/{name}" if name.startswith("model") else f"{base}{run}/{layer}/{scope}/{name}"

    def partitions(self, spark: SparkSession, name: str) -> list[DataFrame]:
        """The files of an input, those with the same columns as one table, by name; with site_id and NaN as null.

        Files whose columns have the same order are read at once; of csv files one job finds the orders."""
        kind = self.input_format.get(name, "parquet") if isinstance(self.input_format, dict) else self.input_format
        by_input = bool(self.load_args) and all(k in ("features", "labels") and isinstance(v, dict) for k, v in self.load_args.items())
        options = FORMATS[kind] | {k: str(v) for k, v in (self.load_args.get(name, {}) if by_input else self.load_args).items()}
        reader = lambda: spark.read.format(kind).options(**options)
        orders: dict[tuple, list[str]] = {}
        if kind == "csv" and options["header"].lower() == "true":
            lines = spark.read.option("recursiveFileLookup", "true").text(self.path(name)).where("value <> '' and _metadata.file_block_start = 0")
            heads = lines.select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("at")).groupBy("file_path").agg(F.min_by("value", "at").alias("head"))
            for r in sorted(heads.collect()):  # a line of each file
                orders.setdefault((r["head"],), []).append(r["file_path"])
        else:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path(name)).select("path")
            for f in sorted(r[0] for r in files.collect()):  # names only
                orders.setdefault(tuple(reader().load(f).columns), []).append(f)
        groups: dict[frozenset, DataFrame] = {}
        for own in orders.values():
            df = reader().load(own)
            columns = frozenset(df.columns)
            groups[columns] = groups[columns].unionByName(df) if columns in groups else df
        return [self._site(nan_to_null(df)) for df in groups.values()]

    def _site(self, df: DataFrame) -> DataFrame:
        return df if "site_id" in df.columns else df.select(F.lit(self.site).alias("site_id"), "*")

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if LAYERS[name.removesuffix("-autoenc")] == "01_raw":
            parts = self.partitions(spark, name)
            if len(parts) != 1:
                raise ValueError(f"{name} has {len(parts)} sets of columns")
            return parts[0]
        return (spark.read.json if name.startswith("metrics") else spark.read.parquet)(self.path(name))

    def exists(self, spark: SparkSession, name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def save(self, df: DataFrame, name: str, csv: bool = False) -> None:
        """Parquet, or csv where asked for; metrics as one JSON file."""
        if name.startswith("metrics"):
            df.coalesce(1).write.mode("overwrite").json(self.path(name))
        elif csv:
            df.write.mode("overwrite").option("header", "true").csv(self.path(name))
        else:
            df.write.mode("overwrite").parquet(self.path(name))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written by save(csv=True), its first column a time."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def load_catalog(spark: SparkSession, catalog: Catalog, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Those of a site's datasets that are there, by name; nothing is read yet but file names and schemas."""
    return {n: catalog.load(spark, n) for n in (names or [k for k in LAYERS if k != "model"]) if catalog.exists(spark, n)}


@dataclass
class RunLog:
    """Parameters and metrics of runs as an append-only table."""

    path: str

    SCHEMA = "run_id string, at timestamp, kind string, key string, value string"

    def _add(self, spark: SparkSession, run_id: str, kind: str, values: dict) -> None:
        rows = [(run_id, dt.datetime.now(), kind, k, json.dumps(json_value(v))) for k, v in flatten_dict(values).items()]
        if rows:
            spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def params(self, spark: SparkSession, run_id: str, values: dict) -> None:
        self._add(spark, run_id, "param", values)

    def metrics(self, spark: SparkSession, run_id: str, values: dict) -> None:
        self._add(spark, run_id, "metric", values)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.SCHEMA).parquet(self.path)


def config(base: str | Path, env: str | Path | None = None, values: dict | None = None) -> dict:
    """Settings of JSON files below base, overridden by those below env; ${name} takes a value. A setting that two files
    of one folder have is an error; names that begin with _ are not settings."""

    def folder(path: str | Path) -> dict:
        out: dict = {}
        for p in sorted(Path(path).rglob("*.json")):
            text = p.read_text()
            for k, v in (values or {}).items():
                text = text.replace(f"${{{k}}}", str(v))
            found = {k: v for k, v in json.loads(text).items() if not k.startswith("_")}
            if twice := sorted(out.keys() & found.keys()):
                raise ValueError(f"{p.name} sets again: {', '.join(twice)}")
            out |= found
        return out

    return folder(base) | (folder(env) if env else {})
