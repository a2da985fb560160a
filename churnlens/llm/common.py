"""Shared storage for intermediate tables, and small helpers.

Every intermediate that is read more than once is written as Parquet below ``spark.checkpoint.dir``,
the folder that all executors share. That cuts the lineage, so a lost executor costs only the tasks
it was running, and the table is computed exactly once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import shared_dir, ship

#: ASCII white space, the only separators of words: space, and 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular expression class body that Java, Python and DuckDB read alike.
SPACE_CLASS = r"\x20\x09-\x0D"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/churnlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a checkpoint that Catalyst can prune."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """A column name not yet in ``columns`` (case-insensitive), for tables with extra columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_texts(df: DataFrame, fn, schema: str, text_col: str = "text") -> DataFrame:
    """``fn(list of texts) -> dict of lists`` over Arrow batches; all other columns of ``df`` go through untouched.

    Nulls reach ``fn`` as empty texts. ``schema`` lists the columns that ``fn`` makes; they follow the
    carried ones. A batch is worked on in slices of bounded size, so long texts don't add up.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    carried = [c for c in df.columns if c != text_col]
    made = _parse_datatype_string(schema)
    out = StructType([*(df.schema[c] for c in carried), *made.fields])
    types = {f.name: to_arrow_type(f.dataType) for f in made.fields}

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col)
            for at, end in slices(texts):
                part = batch.slice(at, end - at)
                result = fn([t or "" for t in part.column(text_col).to_pylist()])
                columns = [part.column(c) for c in carried] + [pa.array(result[n], t) for n, t in types.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, *types])

    return df.mapInArrow(run, out)


def slices(texts, most: int = 1 << 22):
    """Index ranges of an Arrow string array that hold at most ``most`` bytes, or one text."""
    import pyarrow.compute as pc

    at = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        n = n or 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
