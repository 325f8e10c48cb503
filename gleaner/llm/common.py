"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="gleaner-checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there with a short lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for helper columns that no column of `taken` has, whatever case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task would else keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def lean(f: Callable) -> Callable:
    """`f`, a function of one Arrow table or of two, that gives back what it has freed after each call."""
    def one(group):
        out = f(group)
        give_back()
        return out

    def two(left, right):
        out = f(left, right)
        give_back()
        return out

    return two if f.__code__.co_argcount == 2 else one


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of `batches`, about 16 MB at a time."""
    for b in batches:
        step = max(1, int(b.num_rows * 16e6 / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str, rows: Callable[[list], dict[str, list]], done: Callable[[], None] | None = None) -> DataFrame:
    """Apply `rows` (texts of an Arrow batch -> named output lists) batch by batch; `keep` passes through untouched.

    `done` is called at the end of each task, to let go of what `rows` keeps between batches. Null texts reach `rows` as None. Ids never go through pandas, so nulls do not turn them into floats.
    """
    from pyspark.sql.types import _parse_datatype_string

    out = [f.name for f in _parse_datatype_string(schema).fields][len(keep):]
    narrow = df.select(*keep, text)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            got = rows(part.column(len(keep)).to_pylist())
            cols = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            cols += [pa.array(got[n], type=arrow.field(len(keep) + i).type) for i, n in enumerate(out)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        if done is not None:
            done()
        give_back()

    return narrow.mapInArrow(run, schema)


def hex64(col) -> F.Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
