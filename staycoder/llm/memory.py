"""Memory of Python workers: bounded batches, and what a task has freed goes back to the system when it ends."""

from __future__ import annotations

from contextlib import contextmanager

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark, size: str = "4m"):
    """Queries run inside send Arrow batches of about `size` to Python (Spark 4; older versions ignore the setting).

    A batch of 10,000 whole texts takes tens of megabytes, several times over: in the JVM, whose buffers double as
    they grow, in the pipe and in Python.
    """
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def tidied(run):
    """`run` (batches to batches), after whose end Arrow and the C library give up the pages they keep for later.

    Large numpy arrays leave free pages behind; in a worker that serves many stages these add up to hundreds
    of megabytes which nothing uses.
    """

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim is not None:
                trim(0)

    return tidy
