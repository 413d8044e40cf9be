"""Scans and sinks (SRC, SNK)."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import sentinel_to_null


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet, pruned to the columns asked for (SRC-01, SRC-03)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: str, tolerant: bool = True) -> DataFrame:
    """CSV by a stated schema; broken rows keep their text in ``_corrupt`` (SRC-02, SRC-04)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
    if tolerant:
        schema, reader = f"{schema}, _corrupt string", reader.option("columnNameOfCorruptRecord", "_corrupt")
    return reader.schema(schema).csv(path)


def scan_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON lines or whole documents (SRC-05)."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def scan_keyed_json(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """A document that maps keys to records, as rows key, value (SRC-06)."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_type}>")))


def null_sentinels(df: DataFrame) -> DataFrame:
    """Missing-value codes of every number and text become null; a true 0 stays."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("int", "bigint", "double", "float", "smallint"):
            c = sentinel_to_null(c)
        elif kind == "string":
            c = sentinel_to_null(c, text=True)
        out.append(c.alias(name))
    return df.select(*out)


def snapshot_integrity(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below a path (SRC-14)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def id_audit(df: DataFrame, key: str) -> DataFrame:
    """rows, null ids, distinct ids, repeated ids in one aggregation (SRC-14)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(key).isNull(), 1)).alias("null_ids"), F.countDistinct(key).alias("distinct_ids")).withColumn("repeated", F.col("rows") - F.col("null_ids") - F.col("distinct_ids"))


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at ``path``, built and written if it is not there (SRC-15)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if rebuild or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def parse_config(text: str) -> dict:
    """Comments, scalars, inline lists and one level of blocks (SRC-13)."""

    def scalar(v: str):
        v = v.strip().strip("'\"")
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                continue
        return {"true": True, "false": False, "null": None, "": None}.get(v.lower(), v)

    out: dict = {}
    block: dict | None = None
    for line in text.splitlines():
        line = line.split("#")[0].rstrip()
        if ":" not in line:
            continue
        key, _, value = line.strip().partition(":")
        if not line.startswith(" "):
            block = None
        if not value.strip() and block is None:
            block = out[key] = {}
        else:
            (out if block is None else block)[key] = scalar(value)
    return out


def parse_structure(text: str) -> dict:
    """Comment, scaled lattice rows, species with counts and fractional sites of a plain structure file (SRC-12)."""
    lines = text.splitlines()
    scale = float(lines[1])
    lattice = [[float(x) * scale for x in lines[k].split()[:3]] for k in (2, 3, 4)]
    named = not lines[5].split()[0].isdigit()
    names = lines[5].split() if named else lines[0].split()
    counts = [int(x) for x in lines[6 if named else 5].split()]
    at = (7 if named else 6) + 1
    species = [n for n, k in zip(names, counts, strict=False) for _ in range(k)]
    return {"comment": lines[0].strip(), "lattice": lattice, "species": species, "coords": [[float(x) for x in lines[at + k].split()[:3]] for k in range(len(species))]}


def format_structure(comment: str, lattice: Sequence[Sequence[float]], species: Sequence[str], coords: Sequence[Sequence[float]]) -> str:
    """The text that :func:`parse_structure` reads (SNK-10); species are grouped in order of appearance."""
    names = list(dict.fromkeys(species))
    order = [k for n in names for k, s in enumerate(species) if s == n]
    rows = [comment, "1.0", *("  ".join(f"{x:.10f}" for x in v) for v in lattice), " ".join(names), " ".join(str(list(species).count(n)) for n in names), "Direct"]
    return "\n".join([*rows, *("  ".join(f"{x:.10f}" for x in coords[k]) for k in order)]) + "\n"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json_records(df: DataFrame, path: str) -> None:
    """Records with NaN as null (SNK-04)."""
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_typed_empty(spark: SparkSession, schema: str, path: str) -> None:
    """A table of no rows that still has its columns (SNK-06)."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def summary_json(values: dict) -> str:
    return json.dumps(values, indent=2, sort_keys=True, default=str)


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """A report table of at most ``limit`` rows, with a line that says so if there are more (SNK-07)."""
    rows = df.limit(limit + 1).collect()
    more = f"\n\n(the first {limit} rows)" if len(rows) > limit else ""
    rows = rows[:limit]
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return head + "".join("\n| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + more


def freeze_graph(edges: DataFrame, path: str, **metadata) -> None:
    """Edges, nodes with degrees, and metadata (SNK-11)."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    both = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    both.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.sparkSession.createDataFrame([(summary_json(metadata),)], "metadata string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def write_arrays(df: DataFrame, key: str, vector: str, path: str) -> None:
    """A matrix as key and array of doubles (SNK-05)."""
    df.select(key, F.col(vector).cast("array<double>").alias(vector)).write.mode("overwrite").parquet(path)


def scan_arrays(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """A matrix back (SRC-07); the key comes with every row, so nothing relies on the order of rows."""
    return spark.read.schema(f"{key} long, {vector} array<double>").parquet(path)


def structure_round_trip(df: DataFrame, key: str, z: str) -> DataFrame:
    """key, n_sites, formula, height of a three-site layer whose text is written and read again for each row."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = parse_structure(format_structure(f"row {k}", [[3.3, 0, 0], [0, 3.3, 0], [0, 0, 20]], ["Se", "Mo", "Se"], [[0, 0, h], [0.5, 0.5, 0], [0, 0, -h]]))
                names = sorted(set(s["species"]))
                out.append((k, len(s["species"]), "".join(f"{n}{s['species'].count(n)}" for n in names), s["coords"][s["species"].index("Se")][2]))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=[key, "n_sites", "formula", "height"])

    return df.select(F.col(key).cast("long"), z).mapInArrow(run, f"{key} long, n_sites int, formula string, height double")
