"""Prefix trie of conversations, as intervals of its nodes' preorder.

A turn is the digest of its role and text. Distinct conversations are sorted as sequences of these digests, so that all
that begin in one way follow one another: a node is known by the first and the last of them, and nodes sorted by the first
one and their depth are in preorder. With the position where each subtree ends, what a subtree adds up to is the difference
of two running sums over all nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramo.llm.staging import drop_staged, small, stage
from tramo.operators.ranking import numbered, running_sums

#: Conversations are dealt out by hundreds; the head of a hundred's first one is put before the others.
BLOCK, HEADS = 100, 6
#: Parents with more than one of so many of all nodes as children are joined apart: as many of them at most.
HEAVY = 4096
#: Ids that are written as one piece of text.
PIECE = 10_000
ROOT = hashlib.sha256(b"root").digest()


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def placed(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), digest and chars (code points of the text) of every turn, by turn, missing ones first.

    Turns of one number are in order of role, then text; only for such are texts moved. Rows without a conversation are
    left out; a missing role or text is empty.
    """
    base = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.where("conv_id is not null")
    keep = ["conv_id", "turn", F.lit(0).cast("long").alias("tie"), _digest(F.col("role"), F.col("text")).alias("digest"), F.char_length("text").cast("long").alias("chars")]
    tied = stage(base.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")), "tied")
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t"))
    if tied.limit(1).count():
        several = numbered(base.join(small(tied), on, "left_semi"), ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], "tie")
        keep_tie = [*keep[:2], F.col("tie"), *keep[3:]]
        turns = base.join(small(tied), on, "left_anti").select(*keep).unionByName(several.select(*keep_tie))
    else:
        turns = base.select(*keep)
    at = numbered(turns, ["conv_id", F.col("turn").asc_nulls_first(), "tie"], "at").select("conv_id", "digest", "chars", "at")
    first = at.groupBy("conv_id").agg(F.min("at").alias("first"))
    return at.join(small(stage(first, "firsts")), "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """turns: as placed gives them. Each conversation c with the first h turns of conversation c - c % BLOCK instead of its own; h: crc32 of c by HEADS.

    conv_id, digests and chars (arrays, by turn) of all, those without turns too. The turns of a conversation are a row of
    digests, 40 bytes a turn.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("of"))
    heads = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("of"), "pos", "digest", "chars")
    # at most HEADS turns meet 2 * BLOCK conversations
    given = convs.join(heads, "of").where("pos < h").select("conv_id", "pos", "digest", "chars")
    own = turns.where(F.col("pos") >= h)
    there = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    one = given.unionByName(own).unionByName(there).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("x"))
    x = F.filter("x", lambda t: t["pos"] >= 0)
    return one.select("conv_id", F.transform(x, lambda t: t["digest"]).alias("digests"), F.transform(x, lambda t: t["chars"]).alias("chars"))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each beginning of a conversation: its node and that of the beginning one turn shorter."""
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["node", "parent", "depth", "chars", "r", "n", "least"]
    full = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    for batch in batches:
        out: list[tuple] = []
        for r, n, least, digests, chars in zip(*(batch.column(c).to_pylist() for c in ("r", "n", "least", "digests", "chars")), strict=True):
            node = ROOT
            out.append((node, None, 0, 0, r, n, least))
            for d, (x, c) in enumerate(zip(digests, chars, strict=True), 1):
                parent, node = node, hashlib.sha256(node + x).digest()
                out.append((node, parent, d, c, r, n, least))
                if len(out) >= 20_000:
                    yield full(out)
                    out = []
        if out:
            yield full(out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by path and id: pieces of text of ids of one path, with their first id."""
    path, ids, out = None, [], []

    def full(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["path", "first", "ids"])

    for batch in chain(batches, [None]):
        rows = [(None, None)] if batch is None else zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
        for p, c in rows:
            if ids and (p != path or len(ids) >= PIECE):
                out.append((path, ids[0], ",".join(map(str, ids))))
                ids = []
            path = p
            if c is not None:
                ids.append(c)
        if out:
            yield full(out)
            out = []


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pieces sorted by path and first id: the hash of each path's pieces, comma-joined."""
    path, state = None, None
    for batch in chain(batches, [None]):
        out: list[tuple] = []
        for p, ids in [(None, "")] if batch is None else zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if p != path:
                if state is not None:
                    out.append((path, state.hexdigest()))
                path, state = p, hashlib.sha256(ids.encode()) if p is not None else None
            elif state is not None:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.string())], names=["path", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """members: path, conv_id. path and the SHA-256 of its ids in ascending order, comma-joined.

    Ids are dealt out by ranges of path and id and put together there, so that a path of most conversations is a few pieces
    of text when its hash, which must see them in order, passes over them; a task holds one of them at a time.
    """
    pieces = members.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_texts, "path binary, first long, ids string")
    pieces = stage(pieces, "pieces")
    return stage(pieces.repartition("path").sortWithinPartitions("path", "first").mapInArrow(_hashes, "path binary, ends_sha256 string"), "ends")


def nodes(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, digests, chars, as rebuilt gives them. A row for each node of their trie, the root included.

    conv_id (the smallest member), depth, parent_conv_id (null: the root), n_convs, n_children, n_leaves, saved_tokens (over
    the subtree, each node's code points times its members but one), ends_sha256. An empty table has no node.
    """
    hexes = F.array_join(F.transform("digests", lambda x: F.hex(x)), "")
    paths = stage(conversations.select("conv_id", F.unhex(F.sha2(hexes, 256)).alias("path"), "digests", "chars"), "paths")
    distinct = paths.groupBy("path").agg(F.first("digests").alias("digests"), F.first("chars").alias("chars"), F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"))
    ranked = stage(numbered(distinct, ["digests"], "r"), "ranked")
    every = ranked.select("r", "n", "least", "digests", "chars").mapInArrow(_spread, "node binary, parent binary, depth long, chars long, r long, n long, least long")
    one = every.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("r").alias("lo"), F.max("r").alias("hi"),
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"),
    )
    one = stage(one, "nodes")
    total = one.count()
    children = one.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    one = one.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    one = one.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "save": (F.col("n_convs") - 1) * F.col("chars")})
    at = running_sums(numbered(one, ["lo", "depth"], "at"), "at", total, {"leaves": "leaf", "saved": "save"})
    at = stage(at, "preorder")
    # where the last conversation of a subtree ends, so does the subtree
    stops = at.groupBy(F.col("lo").alias("hi")).agg(F.max_by(F.struct(F.col("leaves").alias("to_leaf"), F.col("saved").alias("to_saved")), "at").alias("stop"))
    out = at.join(stops, "hi").select(
        "node", "parent", "conv_id", "depth", "n_convs", "n_children", "lo", (F.col("stop.to_leaf") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("stop.to_saved") - F.col("saved") + F.col("save")).alias("saved_tokens"),
    )
    out = stage(_with_parents(stage(out, "intervals"), total), "trie")
    stop = ranked.select("path", F.col("r").alias("lo"), F.size("digests").cast("long").alias("depth"))
    done = stop.join(ends(paths.select("path", "conv_id")), "path").select("lo", "depth", "ends_sha256")
    out = stage(out.join(done, ["lo", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))), "nodes")
    for table in (paths, ranked, at):
        drop_staged(table)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _with_parents(out: DataFrame, total: int) -> DataFrame:
    """out with its parent's conv_id. Parents of many children are joined where these are read, all others by a shuffle."""
    parents = out.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") > max(16, total // HEAVY)
    heavy = F.broadcast(parents.where(many).drop("n_children"))
    rest = out.join(heavy, "parent", "left_anti").join(parents.where(~many).drop("n_children"), "parent", "left")
    return out.join(heavy, "parent").unionByName(rest)


def trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations of rows. Columns other than the four are not read; repeated rows are turns like others."""
    return nodes(stage(rebuilt(stage(placed(rows, conv_col, turn_col, role_col, text_col), "turns")), "rebuilt"))
