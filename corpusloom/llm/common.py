"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import importable

#: Characters of text that one step of a Python operator holds at once.
STEP_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the session names in ``spark.checkpoint.dir``.  Only a local session that names none (a test) gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def reread(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``reread`` and the folder, for ``removed`` once nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> DataFrame:
    """As ``reread``, and the shuffle files of the write are dropped once it has ended, before the next round adds its own."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return reread(df, name)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def changed(batch: pa.RecordBatch, text: str, new: list, length: str | None) -> pa.RecordBatch:
    """The batch with the texts ``new`` (None: as it was); ``length``, where there is such a column, follows."""
    if all(x is None for x in new):
        return batch
    at = batch.schema.get_field_index(text)
    cols = list(batch.columns)
    cols[at] = pa.array([o if n is None else n for o, n in zip(cols[at].to_pylist(), new)], type=batch.schema.field(at).type)
    if length and (size := batch.schema.get_field_index(length)) >= 0:
        cols[size] = pa.array([o if n is None else len(n) for o, n in zip(cols[size].to_pylist(), new)], type=batch.schema.field(size).type)
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def picked(batch: pa.RecordBatch, keep: list[int]) -> pa.RecordBatch:
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``text`` column holds about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, cum = 0, np.concatenate([[0], np.cumsum(sizes)])
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(cum, cum[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str) -> DataFrame:
    """``df[[id_col, text_col]]`` → the id and the columns that ``make()(texts)`` returns.

    ``make`` runs once in each task, so it can load broadcast models.
    ``schema`` lists the added columns; the id keeps its type and name.
    """
    added = df.sparkSession.createDataFrame([], schema).schema
    out = df.select(id_col, text_col)
    kind = out.schema[id_col]
    names = added.fieldNames()
    full = type(added)([kind, *added.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in steps(batches, text_col):
            got = f(texts(batch, text_col))
            cols = [batch.column(id_col).cast(arrow.field(0).type), *(pa.array(got[n], type=arrow.field(n).type) for n in names)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return out.mapInArrow(run, full)


def hash_sample(df: DataFrame, key: str, bound: int, seed: int = 7) -> DataFrame:
    """At most ``bound`` rows, those whose hashed key is smallest; the choice depends on nothing but the keys.

    ``bound`` is the documented limit of a training sample; the ids travel, never the texts.
    """
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(bound)


# --- hashing of words in numpy -------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hashing base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        m = max(n, 2 * len(_POWERS))
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, _BASE, dtype=np.uint64))])
    return _POWERS[:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """``h[i]`` = sum of mixed(code) * base**(n-1-j) kept so that any slice's hash is one subtraction and product."""
    with np.errstate(over="ignore"):
        c = mixed(codes.astype(np.uint64) + np.uint64(1))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers(len(c)))])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_INVERSES = np.ones(1, dtype=np.uint64)


def inverses(n: int) -> np.ndarray:
    """The first ``n`` powers of the inverse of the hashing base, modulo 2**64."""
    global _INVERSES
    if len(_INVERSES) < n:
        m = max(n, 2 * len(_INVERSES))
        inv = np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _INVERSES = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, inv, dtype=np.uint64))])
    return _INVERSES[:n]


def slice_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``codes[start:end]``, equal for equal slices wherever they stand."""
    with np.errstate(over="ignore"):
        return mixed((h[end] - h[start]) * inverses(len(h))[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``[^\\x20\\x09-\\x0D]``."""
    gap = np.ones(len(codes) + 2, dtype=bool)
    gap[1:-1] = _SPACE[codes]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[::2], turn[1::2]


def word_hashes(text: str) -> np.ndarray:
    codes = codes_of(text)
    start, end = word_bounds(codes)
    return slice_hashes(prefix_hashes(codes), start, end)
