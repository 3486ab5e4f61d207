"""What the operators of this subpackage share: text input, Arrow batches, tokenizer files."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch: texts may be long, and a worker holds a few batches at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, unless someone has set their size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text, *keep)`` of a table; all other columns go, so their names can't clash.  A null text is empty."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)


def trim() -> None:
    """Give freed memory back to the system; Python workers live on after a task, and several stages' leftovers add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that trims the worker's memory every 64 batches and at its end."""

    def run(batches: Iterator) -> Iterator:
        for i, out in enumerate(each(batches), 1):
            yield out
            if not i % 64:
                trim()
        trim()

    return run


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the package is installed wherever executors run, so its own path is asked for there."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """A dict that makes missing values by ``make`` and forgets all of them when it holds ``most``."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
