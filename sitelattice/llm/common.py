"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelattice.session import ensure_checkpoint_dir, materialise, prepare  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_bytes(path: str) -> bytes:
    """A vocabulary file (a few MB), read by the driver and handed to the tasks."""
    with open(path, "rb") as f:
        return f.read()


class Memo(dict):
    """A dictionary that computes what it misses and starts anew when it holds ``most`` entries.

    Words repeat so often that few are computed twice; the bound keeps a worker's memory the
    same at any input size.
    """

    def __init__(self, compute: Callable, most: int = 1 << 19):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


_HELD: dict = {}


def per_process(key, build: Callable):
    """An object that the tasks of one Python worker share, such as an encoder with its memo."""
    if key not in _HELD:
        _HELD[key] = build()
    return _HELD[key]


#: Lets Spark delete the shuffle files of a statement when the statement ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def step(df: DataFrame) -> DataFrame:
    """``materialise`` for a step that is large: the shuffle files of its write go as soon as the table is
    written, not when the driver happens to collect the plan that owns them."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return materialise(df)
    finally:
        conf.set(CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that no plan still to be run reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
