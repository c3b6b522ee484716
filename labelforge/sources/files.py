"""Readers for report sources.

All readers return lazy DataFrames; provenance comes from the file source's
hidden ``_metadata`` column.  Report files, one for each report, are listed and
read by tasks.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions.text import findings, impression, study_id_from_path, subject_id_from_path
from labelforge.session import scratch_path

REPORT_SCHEMA = T.StructType([
    T.StructField("subject_id", T.StringType()),
    T.StructField("study_id", T.StringType()),
    T.StructField("findings", T.StringType()),
    T.StructField("impression", T.StringType()),
])

SENTENCE_VOTE_SCHEMA = T.StructType([
    T.StructField("Result", T.StringType()),
    T.StructField("Explanation", T.StringType()),
    T.StructField("Context", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("parquet_file", T.StringType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("text_file", T.StringType()),
    T.StructField("sentence_index", T.LongType()),
])


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """Stack Parquet shards, keeping ``(parquet_file, row_index)`` provenance."""
    df = spark.read.parquet(*paths)
    return df.select("*", F.col("_metadata.file_name").alias("parquet_file"),
                     F.col("_metadata.row_index").alias("row_index"))


def _fields(schema: T.StructType | str) -> list[T.StructField]:
    return (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields


def read_study_list(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    partitions: int | None = None) -> DataFrame:
    """(gzip) CSV, columns found by their names in the header; a file whose
    header differs from the first one's is an error.  Gzip is unsplittable — one
    task per file — so an optional ``repartition`` spreads the rows for what follows."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if schema is not None:
        df = df.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in _fields(schema)))
    return df.repartition(partitions) if partitions else df


def partition_prefix_filter(df: DataFrame, prefix: str, col: str = "path") -> DataFrame:
    """S3: keep paths under one partition folder (p10 = train, p11 = test)."""
    return df.where(F.col(col).startswith(prefix))


def _store(uri: str):
    """File system and inner path of a URI."""
    from urllib.parse import quote

    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(quote(uri, safe=string.punctuation))


def _in_uri(name: str) -> str:
    """A file name as Spark writes it in a path: letters beyond ASCII stay."""
    from urllib.parse import quote

    return "".join(c if ord(c) > 127 else quote(c, safe="~!$&'()*+,;=:@-._") for c in name)


def _name_patterns(glob: str) -> list[str]:
    """A file-name glob without its alternatives: ``*.{a,b}`` → ``*.a``, ``*.b``."""
    import re

    m = re.search(r"\{([^{}]*)\}", glob)
    if m is None:
        return [glob.replace("[^", "[!")]
    return [p for part in m[1].split(",") for p in _name_patterns(glob[:m.start()] + part + glob[m.end():])]


def _list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path`` of the files below ``root`` whose name matches ``glob``; as Spark's
    readers do, names that begin with ``_`` or ``.`` and empty files are left out.

    A folder is listed by one task, level by level; the names stay in the shared
    scratch folder, so their number is no matter for the driver."""
    import fnmatch

    import pandas as pd

    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise FileNotFoundError(f"no such path: {root}")
    patterns = _name_patterns(glob)

    def entries(batches):
        from pyarrow import fs

        for pdf in batches:
            for path in pdf["path"]:
                store, inner = _store(path)
                one = store.get_file_info(inner)
                inside = [one] if one.is_file else store.get_file_info(fs.FileSelector(inner))
                names = [i.base_name for i in inside]
                rows = pd.DataFrame({"path": [path if one.is_file else f"{path.rstrip('/')}/{_in_uri(n)}" for n in names],
                                     "folder": [i.type == fs.FileType.Directory for i in inside]})
                shown = [not n.startswith((".", "_")) and not n.endswith("._COPYING_") for n in names]
                shown = [s and (f or i.size > 0) for s, f, i in zip(shown, rows["folder"], inside)]
                asked = [f or any(fnmatch.fnmatchcase(n, p) for p in patterns) for n, f in zip(names, rows["folder"])]
                rows = rows[[s and a for s, a in zip(shown, asked)]]
                for start in range(0, len(rows), 10_000):
                    yield rows.iloc[start:start + 10_000]

    schema, here = "path string, folder boolean", scratch_path(spark, "listing")
    level, depth = spark.createDataFrame([(f.getPath().toUri().toString().replace("file:///", "file:/", 1),) for f in found], "path string"), 0
    while True:
        out = f"{here}/{depth}"
        level.repartition(spark.sparkContext.defaultParallelism).mapInPandas(entries, schema).write.parquet(out)
        level = spark.read.schema(schema).parquet(out).where("folder").select("path")
        if level.isEmpty():
            return spark.read.schema(schema).parquet(*[f"{here}/{d}" for d in range(depth + 1)]).where("NOT folder").select("path")
        depth += 1


def read_report_files(spark: SparkSession, root: str, glob: str = "*.txt", partitions: int | None = None,
                      batch_bytes: int = 4 << 20) -> DataFrame:
    """Every ``*.txt`` below ``root`` as one row ``(path, text)``.

    Undecodable bytes are removed, matching a decode with errors ignored, and so
    is U+FFFD.  Tasks list the folders and read the files, in batches of about
    ``batch_bytes`` of text: reports are small and many, so that neither their
    names pass through the driver nor a task is planned for every few of them.
    """
    import pandas as pd

    def texts(batches):
        rows, held = [], 0
        for pdf in batches:
            for path in pdf["path"]:
                store, inner = _store(path)
                with store.open_input_stream(inner) as source:
                    data = source.read()
                rows.append((path, data.decode("utf-8", errors="replace").replace("\ufffd", "")))
                held += len(data)
                if held >= batch_bytes or len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["path", "text"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "text"])

    # a stated number of partitions: the names are short, their files are not
    names = _list_files(spark, root, glob).repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return names.mapInPandas(texts, "path string, text string")


def parse_reports(raw: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """P1 + P2: ``(path, text)`` → ``reports`` rows (missing section is ``""``)."""
    return raw.select(subject_id_from_path(path).alias("subject_id"), study_id_from_path(path).alias("study_id"),
                      findings(text).alias("findings"), impression(text).alias("impression"))


def read_folder_batches(spark: SparkSession, root: str) -> DataFrame:
    """Report files with their folder (the unit of work for resumable runs)."""
    df = read_report_files(spark, root)
    return df.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def unzip_reports(spark: SparkSession, zip_glob: str, part_bytes: int = 32 << 20, batch_bytes: int = 4 << 20,
                  partitions: int | None = None) -> DataFrame:
    """``.txt`` members (case-insensitive) of zip archives as ``(archive, member, text)``.

    An archive is dealt to tasks in ranges of ``part_bytes``: a task opens it as a
    seekable stream, reads the directory and the members that start in its
    range, and hands them on in batches of about ``batch_bytes`` of text.
    """
    import zipfile

    import pandas as pd

    def members(batches):
        names = ["archive", "member", "text"]
        for pdf in batches:
            for path, part in zip(pdf["path"], pdf["part"]):
                store, inner = _store(path)
                rows, held = [], 0
                with store.open_input_file(inner) as stream, zipfile.ZipFile(stream) as zf:
                    for info in zf.infolist():
                        if info.is_dir() or not info.filename.lower().endswith(".txt") or info.header_offset // part_bytes != part:
                            continue
                        if rows and held + info.file_size > batch_bytes:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                        rows.append((path, info.filename, zf.read(info).decode("utf-8", errors="ignore")))
                        held += info.file_size
                yield pd.DataFrame(rows, columns=names)

    last = F.expr(f"cast((length - 1) div {int(part_bytes)} as int)")
    parts = (spark.read.format("binaryFile").load(zip_glob).where("length > 0")
             .select("path", F.explode(F.sequence(F.lit(0), last)).alias("part")))
    # a stated number of partitions: the rows are tiny, their work is not
    parts = parts.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.mapInPandas(members, "archive string, member string, text string")


def read_vote_json(spark: SparkSession, path: str, schema: T.StructType = SENTENCE_VOTE_SCHEMA) -> DataFrame:
    """JSON array file(s) → rows; an empty array ``[]`` gives zero rows
    (the explicit schema is required: inference on ``[]`` yields no columns)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_metrics_glob(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """The rows of every ``*_metrics.csv`` matched by ``pattern``.

    Each file's columns are found by the names in its own header, so files of
    different layouts mix; an absent column and an empty cell are NULL.  The
    files are small (one row per run) and read whole; a cell holds no line break."""

    def cells(line: Column) -> Column:
        outside_quotes = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
        bare = lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"'))
        return F.transform(F.split(line, outside_quotes), bare)

    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = (spark.read.text(pattern, wholetext=True).select(lines.alias("lines")).where(F.size("lines") > 1)
            .select(cells(F.col("lines")[0]).alias("names"), F.explode(F.expr("slice(lines, 2, size(lines))")).alias("line"))
            .select("names", cells(F.col("line")).alias("cells")))

    def value(f: T.StructField) -> Column:
        cell = F.get("cells", (F.array_position("names", F.lit(f.name)) - 1).cast("int"))
        return F.nullif(cell, F.lit("")).try_cast(f.dataType).alias(f.name)

    return rows.select(*(value(f) for f in _fields(schema)))


def describe_source(df: DataFrame, with_counts: bool = True) -> DataFrame:
    """``(position, name, type, nullable[, rows, non_null])`` per column.

    The schema part is metadata; with ``with_counts`` one aggregation pass
    counts rows and non-NULL values of every column (partial aggregation, one
    row out) and ``stack`` turns that row into one row per column — nothing
    but the schema is built on the driver."""
    fields = df.schema.fields
    if not with_counts:
        rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)]
        return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(f"`{f.name}`")).alias(f"_nn{i}")
                                                 for i, f in enumerate(fields)]
    one = df.agg(*aggs)

    def lit(v) -> str:
        return "'" + str(v).replace("'", "''") + "'"

    parts = ", ".join(f"{i}, {lit(f.name)}, {lit(f.dataType.simpleString())}, {str(f.nullable).lower()}, _nn{i}"
                      for i, f in enumerate(fields))
    stacked = one.select("_rows", F.expr(f"stack({len(fields)}, {parts}) AS (position, name, type, nullable, non_null)"))
    return stacked.select("position", "name", "type", "nullable", F.col("_rows").alias("rows"), "non_null")
