"""Tables written to the shared folder, so that lineage is cut and a lost executor costs no rerun of what went before."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_open: list[Made] = []


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where a single JVM runs everything."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tramo-"))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Made:
    """Folders written in a block. Those of tables given to keep stay."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, whose staged table outlives the block (and belongs to the block around it)."""
        used = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        stay = [p for p in self.paths if p.rpartition("/")[2] in used]
        self.paths = [p for p in self.paths if p not in stay]
        if len(_open) > 1:
            _open[-2].paths += stay
        return df


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[Made]:
    """While the block runs, staged tables are noted; when it ends, they are deleted, but for what was kept."""
    made = Made()
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made.paths:
            drop_folder(spark, path)


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """While an action runs, plans whose generated methods the JVM leaves uncompiled (over 8,000 bytes) run as separate, smaller ones; then the session is as it was."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str, small_methods: bool = True) -> DataFrame:
    """Write df and return what reads it back. small_methods: by plans as in compiled."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    if _open:
        _open[-1].paths.append(path)
    with compiled(spark) if small_methods else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
