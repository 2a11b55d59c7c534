"""Readers and writers of manifests, label tables, sequences and registries."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import LABEL_ALIASES, genome_of_path
from strandline.operators.relational import REQUIRED

MANIFEST = "genome_id string, species string, antibiotic string, phenotype int, partition_label string, sequence_path string, embedding_path string, source_dataset string, split_design string"

# Id columns by preference.
ID_ALIASES = ("genome_id", "genomeid", "genome", "id")


def read_delimited(spark: SparkSession, path: str, required: list[str], sep: str = ",") -> DataFrame:
    """A delimited file with a header, all columns as strings, so ids keep their zeros; missing columns are refused."""
    df = spark.read.option("sep", sep).csv(path, header=True)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest: required columns checked, phenotype as an integer where it is one, extra columns kept."""
    return read_delimited(spark, path, list(REQUIRED)).withColumn("phenotype", F.col("phenotype").try_cast("int"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(genome_id, phenotype, ...) of a label table whose label column has one of the usual names."""
    df = read_delimited(spark, path, ["genome_id"])
    name = next((c for c in LABEL_ALIASES if c in df.columns), None)
    if name is None:
        raise ValueError(f"{path} has none of the columns {', '.join(LABEL_ALIASES)}")
    return df.withColumnRenamed(name, "phenotype").withColumn("phenotype", F.col("phenotype").try_cast("int"))


def read_ids(spark: SparkSession, path: str, aliases: tuple[str, ...] = ID_ALIASES) -> DataFrame:
    """Distinct genome_id of a delimited file, from the first column whose name is an alias in any case; nulls and blanks left out."""
    df = read_delimited(spark, path, [])
    name = next((c for a in aliases for c in df.columns if c.strip().lower() == a), None)
    if name is None:
        raise ValueError(f"{path} has none of the columns {', '.join(aliases)}")
    return df.select(F.trim(F.col(name)).alias("genome_id")).where("genome_id <> ''").distinct()


def read_subsets(spark: SparkSession, paths: list[str], key: str = "genome_id") -> DataFrame:
    """One row per key over several delimited files, columns matched by name; of equal keys the row of the last path stays.

    Rows with a null key are left out; columns that a file lacks are null. All files are read in one job.
    """
    every = None
    for number, path in enumerate(paths):
        df = read_delimited(spark, path, [key]).withColumn("_path", F.lit(number))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    if every is None:
        raise ValueError("no paths")
    names = [c for c in every.columns if c not in (key, "_path")]
    row = F.struct(F.col("_path"), *[F.col(c) for c in names])
    kept = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_row"))
    return kept.select(key, *[F.col("_row").getField(c).alias(c) for c in names])


def read_path_list(spark: SparkSession, path: str, files: DataFrame, column: str = "sequence_path") -> DataFrame:
    """(path, there) of the lines of a text file: whether `files` holds the path. Blank lines and repeats are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''").distinct()
    held = files.select(F.col(column).alias("path")).where("path is not null").distinct().withColumn("_there", F.lit(True))
    return lines.join(held, "path", "left").select("path", F.coalesce("_there", F.lit(False)).alias("there"))


def read_sidecars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(genome_id, ...) of a folder of JSON files named after their genome; a file that is no JSON gives nulls."""
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    rows = spark.read.schema(schema).json(folder, multiLine=True, pathGlobFilter="*.json")
    return rows.select(genome_of_path(name).alias("genome_id"), *[F.col(c) for c in rows.columns])


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """A table as delimited text with a header; arrays and maps are written as JSON."""
    nested = {n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").option("sep", sep).csv(path, header=True)


def fasta_sequences(files: DataFrame, path: str = "sequence_path", text: str = "fasta") -> DataFrame:
    """All records of a FASTA text as one upper-case sequence, without headers, line ends and blanks."""
    lines = F.filter(F.split(text, "[\\r\\n]+"), lambda x: ~x.startswith(">"))
    return files.select(path, F.upper(F.regexp_replace(F.array_join(lines, ""), "[ \\t]", "")).alias("sequence"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_path, fasta) of a folder of FASTA files, plain or gzip."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("sequence_path"), F.col("value").alias("fasta"))


def read_arrays(spark: SparkSession, path: str, names: tuple[str, ...] = ("features", "X", "V", "windows", "embeddings")) -> DataFrame:
    """(path, row, v) of a folder of .npz files: the first of the named arrays, one row for each of its rows."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content)) as held:
                    name = next((n for n in names if n in held), None)
                    if name is not None:
                        x = np.atleast_2d(held[name]).astype(float)
                        yield pd.DataFrame({"path": p, "row": np.arange(len(x)), "v": list(x)})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInPandas(run, "path string, row long, v array<double>")


def append_registry(rows: DataFrame, path: str) -> None:
    """Add extraction rounds to a registry table."""
    rows.select("genome_id", "subset_name", "extraction_round").write.mode("append").parquet(path)


def checked_file(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """The first five rows of a .csv or .tsv file, once it is known to exist, to have the columns and to hold a row; else ValueError says what is wrong."""
    sep = {".csv": ",", ".tsv": "\t"}.get(path[-4:].lower())
    if sep is None:
        raise ValueError(f"{path} is neither .csv nor .tsv")
    try:
        df = read_delimited(spark, path, list(required), sep)
    except AnalysisException as e:
        raise ValueError(f"{path} cannot be read") from e
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df.limit(5)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.{h5,hdf5}") -> DataFrame:
    """(path, length) of the files of a folder whose name fits a pattern, in order; their content is not read. Spark lists no empty files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path")


def write_missing(df: DataFrame, path: str, key: str, by: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """Append rows whose key the table at `path` does not hold yet, partitioned by columns; `overwrite` writes it anew.

    Keys that are null are never held, so such rows are always written.
    """
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(place)
    if there and not overwrite:
        df = df.join(df.sparkSession.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("overwrite" if overwrite else "append").partitionBy(*by).parquet(path)


def write_path_list(rows: DataFrame, path: str, column: str = "sequence_path") -> None:
    """The paths of a table as a text file of lines under <path>/paths, and all its columns as a delimited table under <path>/audit."""
    rows.where(F.col(column).isNotNull()).select(column).write.mode("overwrite").text(f"{path}/paths")
    write_delimited(rows, f"{path}/audit")
