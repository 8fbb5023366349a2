"""Records of comma-separated files, also of those with line breaks in quoted fields, from any number of tasks.

A file is read by lines, from all its blocks at once. Whether a line begins inside a quoted field depends on all that come
before it; but it has only two answers, so that each block can say, for both, how it ends. These answers, one row a block,
are put one after another for each file; then every block knows how it begins, cuts its lines into records by itself, and
only a record that goes over the end of a block is put together from its pieces.

Rules: a quote opens a field only at its beginning, two quotes inside are one, what follows the closing quote belongs to the
field; blank lines are left out; fields that are missing at a record's end are missing values; records with more fields than
the header are dropped, and kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramo.tables import stage

# Texts that stand for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def ends_open(line: str, is_open: bool) -> bool:
    """Whether a quoted field is open at the line's end; is_open: whether one is at its beginning."""
    i = 0
    while True:
        if not is_open:
            if line[i : i + 1] != '"':
                i = line.find(",", i) + 1
                if not i:
                    return False
                continue
            i += 1
        i = line.find('"', i)
        if i < 0:
            return True
        if line[i + 1 : i + 2] == '"':
            i, is_open = i + 2, True
            continue
        is_open, i = False, line.find(",", i + 1) + 1
        if not i:
            return False


def fields(record: str) -> list[str]:
    """A record with quotes, cut into its fields."""
    out, i = [], 0
    while True:
        if record[i : i + 1] == '"':
            text, j = "", i + 1
            while True:
                k = record.find('"', j)
                if k < 0:
                    return [*out, text + record[j:]]
                if record[k + 1 : k + 2] != '"':
                    break
                text, j = text + record[j : k + 1], k + 2
            end = record.find(",", k + 1)
            out.append(text + record[j:k] + record[k + 1 : end if end >= 0 else len(record)])
        else:
            end = record.find(",", i)
            out.append(record[i : end if end >= 0 else len(record)])
        if end < 0:
            return out
        i = end + 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where another block begins; a block's rows follow one another in a task."""
    for batch in batches:
        file, block = (batch.column(c).to_pylist() for c in ("file", "block"))
        since = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or (file[k], block[k]) != (file[since], block[since]):
                yield (file[since], block[since]), batch.slice(since, k - since)
                since = k


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By block, whether it ends open if it begins closed, and if it begins open."""
    last, state, out = None, [False, True], []
    for key, rows in _by_block(batches):
        if key != last:
            if last:
                out.append((*last, *state))
            last, state = key, [False, True]
        for line in rows.column("line").filter(pc.match_substring(rows.column("line"), '"')).to_pylist():
            state = [ends_open(line, s) for s in state]
    if last:
        out.append((*last, *state))
    yield pa.RecordBatch.from_pydict({"file": [o[0] for o in out], "block": pa.array([o[1] for o in out], pa.int64()), "closed": pa.array([o[2] for o in out], pa.bool_()), "open": pa.array([o[3] for o in out], pa.bool_())})


def _begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over files with their blocks' answers in order, whether each block begins open."""
    for batch in batches:
        out = []
        for file, blocks in zip(batch.column("file").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            state = False
            for b in blocks:
                out.append((file, b["block"], state))
                state = b["open"] if state else b["closed"]
        yield pa.RecordBatch.from_pydict({"file": [o[0] for o in out], "block": pa.array([o[1] for o in out], pa.int64()), "begins": pa.array([o[2] for o in out], pa.bool_())})


_CUT = "file string, block long, at long, kind int, text string"
WHOLE, FIRST, INNER, LAST = range(4)  # a record; its piece at a block's end, over a whole block, at a block's beginning


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of them, numbered in their block."""
    last, is_open, wait, begun, at, out = None, False, [], True, 0, []

    def closed() -> None:
        nonlocal at, wait, begun
        out.append((*last, at, WHOLE if begun else LAST, "\n".join(wait)))
        at, wait, begun = at + 1, [], True

    def left() -> None:
        if last and wait:
            out.append((*last, at, FIRST if begun else INNER, "\n".join(wait)))

    def batch() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "block", "at", "kind", "text"])

    for key, rows in _by_block(batches):
        if key != last:
            left()
            last, is_open, wait, at = key, rows.column("begins")[0].as_py(), [], 0
            begun = not is_open
        quoted = pc.match_substring(rows.column("line"), '"').to_pylist()
        for line, q in zip(rows.column("line").to_pylist(), quoted, strict=True):
            if q:
                is_open = ends_open(line, is_open)
            wait.append(line)
            if not is_open:
                closed()
        if len(out) >= 5_000:
            yield batch()
            out.clear()
    left()
    if out:
        yield batch()


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, at, text: the records of all files; (block, at) is a record's place in its file."""
    lines = _lines(spark, path)
    answers = lines.mapInArrow(_answers, "file string, block long, closed boolean, open boolean")
    # a row for each block of a file
    files = answers.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "closed", "open"))).alias("blocks"))
    begins = stage(files.mapInArrow(_begins, "file string, block long, begins boolean"), "blocks")
    known = F.broadcast(begins) if begins.count() <= 1_000_000 else begins
    if known is begins:  # a shuffle would part a block's lines: they are told by their number, and sorted again
        lines = lines.withColumn("_id", F.monotonically_increasing_id()).join(begins, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "_id").drop("_id")
    else:
        lines = lines.join(known, ["file", "block"])
    cut = stage(lines.mapInArrow(_cut, _CUT), "records")
    return cut.where(F.col("kind") == WHOLE).drop("kind").unionByName(_joined(cut.where(F.col("kind") != WHOLE)))


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces of records, two of a block at most, put together; one that is never closed is a record too."""
    up = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum((F.col("kind") == FIRST).cast("long")).over(up)
    one = pieces.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("p"))
    return one.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"), F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fields of each record that isn't blank."""
    for batch in batches:
        text = pc.replace_substring_regex(batch.column("text"), pattern="\r$", replacement="")
        keep = pc.invert(pc.match_substring_regex(text, pattern=r"^[ \t]*$"))
        batch, text = batch.filter(keep), text.filter(keep)
        cut = pc.split_pattern(text, ",")
        if (quoted := pc.match_substring(text, '"')).to_pylist().count(True):
            cut = pa.array([fields(t) if q else c for t, q, c in zip(text.to_pylist(), quoted.to_pylist(), cut.to_pylist(), strict=True)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("file", "block", "at", "text")], cut.cast(pa.list_(pa.string()))], names=["file", "block", "at", "text", "fields"])


@dataclass
class Read:
    #: Columns by the header's names, all strings.
    rows: DataFrame
    #: file, text and n_fields of records with more fields than the header.
    dropped: DataFrame


def read(spark: SparkSession, path: str | list[str]) -> Read:
    """The records of files that begin with one and the same header each."""
    found = stage(records(spark, path).mapInArrow(_parsed, "file string, block long, at long, text string, fields array<string>"), "fields")
    heads = found.groupBy("file").agg(F.min(F.struct("block", "at", "fields")).alias("head"))  # a row for each file
    first = heads.orderBy("file").first()
    if first is None:
        raise ValueError(f"no header in {path}")
    names = [c.strip() for c in first["head"]["fields"]]
    names[0] = names[0].removeprefix("﻿")
    head = F.broadcast(heads.select(F.col("file").alias("_f"), F.col("head.block").alias("_b"), F.col("head.at").alias("_a")))
    body = found.join(head, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")) & (F.col("at") == F.col("_a")), "left_anti")
    many = F.size("fields")
    value = lambda k: F.when(many > k, F.get("fields", F.lit(k)))
    rows = body.where(many <= len(names)).select(*[F.when(~value(k).isin(*MISSING), value(k)).alias(c) for k, c in enumerate(names)])
    return Read(rows, body.where(many > len(names)).select("file", "text", many.alias("n_fields")))
