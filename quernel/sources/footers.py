"""Value counts of Parquet columns, reading as little as footers and dictionaries allow.

Footers are read in a distributed job. Each column chunk of a row group then goes one of three ways:

settled     its statistics alone tell every value: all NULL, or no NULL and lowest = highest of an
            exact type. It is not read.
dictionary  it has a dictionary page: its dictionary gives the different candidates, its indices are
            counted per load, and no row is decoded. Only this chunk (and the load's, unless that is
            settled too) is read.
scan        neither. The files of such chunks are scanned by Spark, this column and the load only.

Files that only the JVM can open, or that lack a column (partition folders), are scanned as well. The
driver holds names of files, as it does for any scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOOTER_SCHEMA = "uri string, grp int, col_name string, rows bigint, nulls bigint, lo string, hi string, way string, load_settled boolean"
COUNT_SCHEMA = "col_name string, load_id string, text string, number double, n bigint"
#: Longer text extrema may have been shortened by the writer.
WHOLE_TEXT = 48


def _open(uri: str, **how):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, path = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(fs.open_input_file(path), **how)


def _statistics(chunk) -> tuple[int | None, object, object]:
    """(NULLs, lowest, highest) of a chunk where exact, else None. Integers stay integers."""
    s = chunk.statistics if chunk.is_stats_set else None
    if s is None:
        return None, None, None
    nulls = s.null_count if s.has_null_count else None
    exact = s.has_min_max and (
        chunk.physical_type in ("INT32", "INT64") and isinstance(s.min, int)
        # NaN leaves no trace in the extrema of floating columns, so they are bounds of the numbers only.
        or chunk.physical_type == "BYTE_ARRAY" and isinstance(s.min, str) and max(len(s.min.encode()), len(s.max.encode())) <= WHOLE_TEXT
    )
    if exact:
        return nulls, s.min, s.max
    if s.has_min_max and chunk.physical_type in ("DOUBLE", "FLOAT"):
        return nulls, float(s.min), float(s.max)
    return nulls, None, None


def _settled(chunk) -> bool:
    nulls, lo, hi = _statistics(chunk)
    return nulls == chunk.num_values or (nulls == 0 and isinstance(lo, (int, str)) and lo == hi)


def _footer(uri: str, columns: list[str], load: str) -> Iterator[tuple]:
    try:
        meta = _open(uri).metadata
    except (OSError, ValueError, NotImplementedError):  # a store that only the JVM reads
        yield from ((uri, None, c, None, None, None, None, "scan", False) for c in columns)
        return
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        where = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        for c in columns:
            if c not in where or load not in where:
                yield uri, g, c, group.num_rows, None, None, None, "scan", False
                continue
            nulls, lo, hi = _statistics(where[c])
            way = "settled" if _settled(where[c]) else "dictionary" if where[c].has_dictionary_page else "scan"
            yield uri, g, c, group.num_rows, nulls, *(None if x is None else str(x) for x in (lo, hi)), way, _settled(where[load])


def footers(spark: SparkSession, path: str, columns: list[str], load: str) -> DataFrame:
    """One row per column chunk: rows, exact NULLs, extrema as text (of floating columns: of the numbers), and the way it goes."""
    files = spark.read.parquet(path).inputFiles()
    uris = spark.createDataFrame([(u,) for u in files], "uri string").repartition(max(1, min(len(files), 2000)))
    names = [x.split()[0] for x in FOOTER_SCHEMA.split(", ")]

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for u in pdf["uri"] for r in _footer(u, columns, load)]
            yield pd.DataFrame(rows, columns=names).astype({"grp": "Int32", "rows": "Int64", "nulls": "Int64"})

    return uris.mapInPandas(read, FOOTER_SCHEMA)


def _coded(column) -> tuple[np.ndarray, list]:
    """(index per row, different values) of a column, NULL being a value of its own; a dictionary is taken as it lies."""
    import pyarrow as pa

    a = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    if not pa.types.is_dictionary(a.type):
        a = a.dictionary_encode()
    values = a.dictionary.to_pylist()
    index = a.indices.fill_null(len(values)).to_numpy(zero_copy_only=False).astype(np.int64)
    return index, [*values, None]


def _group_counts(uri: str, g: int, ways: dict[str, str], load: str) -> Iterator[tuple]:
    """COUNT_SCHEMA rows of the settled and dictionary chunks of a row group."""
    import pyarrow as pa

    names = [load, *ways]
    f = _open(uri)
    texts = [c for c in names if pa.types.is_string(f.schema_arrow.field(c).type)]
    f = _open(uri, read_dictionary=texts)
    meta = f.metadata.row_group(g)
    where = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}

    def constant(c: str):
        nulls, lo, _ = _statistics(where[c])
        return None if nulls == meta.num_rows else lo

    read = [c for c, w in ways.items() if w == "dictionary"] + ([] if _settled(where[load]) else [load])
    table = f.read_row_group(g, columns=read) if read else None
    loads, load_names = (np.zeros(meta.num_rows, np.int64), [constant(load)]) if load not in read else _coded(table[load])
    for c, w in ways.items():
        index, values = _coded(table[c]) if w == "dictionary" else (np.zeros(meta.num_rows, np.int64), [constant(c)])
        pairs, n = np.unique(loads * len(values) + index, return_counts=True)
        for p, k in zip(pairs.tolist(), n.tolist()):
            v, name = values[p % len(values)], load_names[p // len(values)]
            number = v if isinstance(v, float) and v == v else None  # NaN comes as text: pandas takes it for NULL
            as_text = None if number is not None or v is None else "NaN" if isinstance(v, float) else str(v)
            yield c, None if name is None else str(name), as_text, number, k


def value_counts(spark: SparkSession, path: str, columns: list[str], load: str) -> DataFrame:
    """(col_name, load_id, text or number, n): how often each value of each column lies in each load; whole numbers come as text."""
    whole = spark.read.parquet(path)
    files = whole.inputFiles()
    insufficient = footers(spark, path, columns, load).filter("way = 'scan'").select("uri", "col_name").distinct().collect()
    names = [x.split()[0] for x in COUNT_SCHEMA.split(", ")]
    # Files that are scanned for a column are scanned for all of its chunks.
    scanned = {c: {r.uri for r in insufficient if r.col_name == c} for c in columns}
    uris = spark.createDataFrame([(u,) for u in files], "uri string").repartition(max(1, min(len(files), 2000)))

    def groups(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found: dict[tuple, dict] = {}
            for uri in pdf["uri"]:
                for _, g, c, *_, way, _ in _footer(uri, columns, load):
                    if way != "scan" and uri not in scanned[c]:
                        found.setdefault((uri, g), {})[c] = way
            yield pd.DataFrame([(u, g, list(w), list(w.values())) for (u, g), w in found.items()], columns=["uri", "grp", "cols", "ways"]).astype({"grp": "int32"})

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for uri, g, cs, ws in zip(pdf["uri"], pdf["grp"], pdf["cols"], pdf["ways"]):
                yield pd.DataFrame(list(_group_counts(uri, int(g), dict(zip(cs, ws)), load)), columns=names).astype({"number": "float64"})

    # Row groups are spread by number: their list is tiny, what stands behind it is not, so sizes must not decide.
    tasks = max(len(files), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ways = uris.mapInPandas(groups, "uri string, grp int, cols array<string>, ways array<string>").repartition(tasks)
    parts = [ways.mapInPandas(read, COUNT_SCHEMA)]
    load_id = F.col(f"`{load}`").cast("string").alias("load_id")
    for c in columns:
        if rest := sorted(scanned[c]):
            of = whole if len(rest) == len(files) else spark.read.schema(whole.schema).parquet(*rest)
            floating = whole.schema[c].dataType.typeName() in ("double", "float", "decimal")
            v = F.col(f"`{c}`")
            text, number = (F.lit(None), v) if floating else (v, F.lit(None))
            parts.append(of.select(F.lit(c).alias("col_name"), load_id, text.cast("string").alias("text"), number.cast("double").alias("number"), F.lit(1).cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("col_name", "load_id", "text", "number").agg(F.sum("n").alias("n"))
