"""Helpers shared by the corpus operators: tables, shared storage and Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made for local sessions that name no ``spark.checkpoint.dir`` (tests), by application.
_OWN: dict[str, str] = {}
#: Tables and folders written to the shared folder, by application, for ``forget``.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read the table ``name`` below ``sf_dir`` through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a folder of our own on a single
    machine, and an error on a cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="rasterlake-")
    return _OWN[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``forget`` removes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver find the exchanges of steps that are stored already, so that executors remove their files."""
    gc.collect()
    spark._jvm.System.gc()


def forget(spark: SparkSession) -> int:
    """Remove what this application's operators have written to the shared folder so far, and say how many paths that were.

    To be called when no result that reads from them is wanted any more: results are lazy, so the operators cannot tell."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def arrow_schema(df_schema) -> pa.Schema:
    """Arrow schema of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def per_text(
    docs: DataFrame,
    schema: str,
    make: Callable[[], Callable[[list], dict[str, Iterable]]],
    id_col: str = "doc_id",
    text_col: str = "text",
    decode: bool = False,
    rows: int = 512,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Map whole texts to columns in slices of at most ``rows`` texts.

    ``make()`` runs once a task and returns a function from a list of texts (bytes, or str with ``decode``; None for null) to
    a dictionary of columns. The result has ``id_col``, ``carry`` and those columns, named and typed by ``schema`` (which lists
    all of them, the carried ones first).
    """
    spark = docs.sparkSession
    out_type = spark.createDataFrame([], schema).schema
    names = [f.name for f in out_type.fields]
    kept = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out_type)
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = part.column(len(kept))
                made = work(texts.to_pylist() if decode else as_bytes(texts))
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
                for field in list(arrow)[len(kept) :]:
                    v = made[field.name]
                    arrays.append(v if isinstance(v, pa.Array) else pa.array(v, type=field.type))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text_col))).mapInArrow(run, out_type)


def quoted(name: str) -> str:
    """A column name, quoted for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def rewrite_text(docs: DataFrame, make: Callable[[], Callable[[list], list]], rows: int = 512) -> DataFrame:
    """Replace ``text`` (and ``n_chars``, where there is one) of each row; ``make()`` gives a function from texts to new texts.

    A new text of ``False`` drops the row. All columns are carried along by position, so names cannot clash.
    """
    schema = docs.schema
    names = docs.columns
    at_text = names.index("text")
    at_n = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                old = part.column(at_text).to_pylist()
                new = work(old)
                arrays = [c.cast(arrow.field(i).type) for i, c in enumerate(part.columns)]
                if at_n is not None:
                    was = part.column(at_n).to_pylist()
                    n = [w if a == b or b is None or b is False else len(b) for a, b, w in zip(old, new, was)]
                    arrays[at_n] = pa.array(n, type=arrow.field(at_n).type)
                arrays[at_text] = pa.array([None if x is False else x for x in new], type=arrow.field(at_text).type)
                made = pa.RecordBatch.from_arrays(arrays, names=names)
                if any(x is False for x in new):
                    made = made.filter(pa.array([x is not False for x in new]))
                yield made

    return docs.mapInArrow(run, schema)


def crc_mod(column, n: int):
    """crc32 of a key's text form, modulo n (null keys: null)."""
    return F.crc32(column.cast("string").cast("binary")) % n
