"""A store of routed pairs on shared storage: a pair that it has is never asked for again.

Answers are written by the tasks that get them, a few at a time, as small files under log/; when a run is through, Spark
puts them into the table and deletes them. A task that is tried again first reads what its bucket's log has, so that a lost
executor costs only the requests that were under way. Runs of one store follow one another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from threading import local

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramo.sources.routes import ROUTE_SCHEMA, HttpRoutes
from tramo.tables import cleaned, drop_folder, stage

#: Where a row comes from: the router's answer (there may be no route), or none of the tries.
STORED = f"{ROUTE_SCHEMA}, status string"
_ROWS = pa.schema([("pair_key", pa.string()), ("sec", pa.float64()), ("meters", pa.float64()), ("status", pa.string())])
#: Pairs of one task.
BUCKET = 20_000


class _Log:
    """The log of one bucket, from within a task."""

    def __init__(self, folder: str, bucket: int):
        self.fs, top = pafs.FileSystem.from_uri(folder)
        self.folder = f"{top}/log/bucket={bucket}"

    def known(self) -> set[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        names = [f.path for f in found if f.is_file and not f.base_name.startswith("_")]
        return {k for name in names for k in pq.read_table(name, filesystem=self.fs, columns=["pair_key"]).column(0).to_pylist()}

    def write(self, rows: list[tuple]) -> None:
        """Files appear whole: names with an underscore aren't read."""
        self.fs.create_dir(self.folder, recursive=True)
        name = f"{uuid.uuid4().hex}.parquet"
        pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS), f"{self.folder}/_{name}", filesystem=self.fs)
        self.fs.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")


def answers(ask: Callable[[tuple], tuple], pairs: Iterable[tuple], threads: int) -> Iterator[tuple]:
    """ask of every pair, as answers come, `threads` of them under way at most."""
    rest = iter(pairs)
    with ThreadPoolExecutor(threads) as pool:
        going = {pool.submit(ask, p) for p in islice(rest, threads)}
        while going:
            done = next(as_completed(going))
            going.remove(done)
            going |= {pool.submit(ask, p) for p in islice(rest, 1)}
            yield done.result()


@dataclass
class StoredRoutes:
    """Routes from the store in `folder`; those that it hasn't are asked for first, once.

    threads: requests of a task under way; flush: answers that are written together (what a killed task may ask again is
    no more than these two together). retry: pairs of which no try of an earlier run succeeded are asked for again.
    """

    folder: str
    router: HttpRoutes
    threads: int = 4
    flush: int = 64
    retry: bool = False

    def _read(self, spark: SparkSession, part: str) -> DataFrame | None:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        return spark.read.schema(STORED).parquet(f"{self.folder}/{part}") if there else None

    def stored(self, spark: SparkSession) -> DataFrame:
        """pair_key, sec, meters, status: each pair once, with a route rather than without."""
        parts = [x.select(*_ROWS.names) for part in ("table", "log") if (x := self._read(spark, part)) is not None]
        if not parts:
            return spark.createDataFrame([], STORED)
        one = reduce(DataFrame.unionByName, parts).groupBy("pair_key").agg(F.min_by(F.struct("sec", "meters", "status"), F.when(F.col("status") == "failed", 1).otherwise(0)).alias("x"))
        return one.select("pair_key", "x.*")

    def fill(self, pairs: DataFrame) -> int:
        """Asks for the pairs that the store hasn't. How many requests' answers were written."""
        spark = pairs.sparkSession
        have = self.stored(spark)
        have = have.where("status <> 'failed'") if self.retry else have
        with cleaned(spark):
            new = stage(pairs.where("pair_key is not null").dropDuplicates(["pair_key"]).join(have.select("pair_key"), "pair_key", "left_anti"), "pairs")
            n = new.count()
            if not n:
                return 0
            if self.retry:
                self._pack(spark, have)  # a log of failures would tell its task that these are known
            buckets = max(self.router.workers, -(-n // BUCKET))
            dealt = new.withColumn("bucket", F.expr(f"pmod(xxhash64(pair_key), {buckets})").cast("int")).repartition(buckets, "bucket").sortWithinPartitions("bucket")
            written = dealt.mapInArrow(self._asked(), "n long").agg(F.sum("n")).first()[0]
            self._pack(spark, self.stored(spark))
        return written or 0

    def _pack(self, spark: SparkSession, rows: DataFrame) -> None:
        """The log goes into the table. If this ends half-way, both are read, and a pair counts once."""
        log = self._read(spark, "log")
        if log is None:
            return
        table = self._read(spark, "table")
        new = rows if table is None else rows.join(table.where("status <> 'failed'").select("pair_key"), "pair_key", "left_anti")
        new.write.mode("append").parquet(f"{self.folder}/table")
        drop_folder(spark, f"{self.folder}/log")

    def _asked(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        folder, router, threads, flush = self.folder, self.router, self.threads, self.flush

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, logs, wait, written = local(), {}, {}, 0

            def ask(row: tuple) -> tuple:
                if not hasattr(own, "get"):
                    own.get = router.session()  # a connection of each thread
                key, bucket, *ends = row
                return bucket, (key, *router.answer(own.get, *ends))

            def unknown() -> Iterator[tuple]:
                for batch in batches:
                    for row in zip(*(batch.column(c).to_pylist() for c in ("pair_key", "bucket", "lon1", "lat1", "lon2", "lat2")), strict=True):
                        if row[1] not in logs:
                            log = _Log(folder, row[1])
                            logs[row[1]] = (log, log.known())
                        if row[0] not in logs[row[1]][1]:
                            yield row

            def put(bucket: int) -> None:
                nonlocal written
                rows = wait.pop(bucket, [])
                if rows:
                    logs[bucket][0].write(rows)
                    written += len(rows)

            try:
                for bucket, row in answers(ask, unknown(), threads):
                    wait.setdefault(bucket, []).append(row)
                    if len(wait[bucket]) >= flush:
                        put(bucket)
            finally:
                for bucket in [*wait]:
                    put(bucket)
            yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

        return run

    def routes(self, pairs: DataFrame) -> DataFrame:
        """As RouteProvider has it. Asks at once; what it returns only reads."""
        self.fill(pairs)
        return pairs.select("pair_key").join(self.stored(pairs.sparkSession).select("pair_key", "sec", "meters"), "pair_key", "left")
