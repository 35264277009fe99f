"""The prefix trie of conversations, built level by level.

Downwards: at each depth the live conversations are grouped by (parent node, next turn); a group is a node and is named by its smallest conversation. Groups of one are no longer live: the rest of such
a conversation is a chain of nodes of its own, which needs no grouping. So the loop runs as deep as conversations share turns, not as deep as the longest one.

Upwards: from the deepest level, children are summed by parent and joined to the level above, which rolls up leaves and savings.

A turn is 128 bits of the SHA-256 of role and text with the length of its text; texts are read once and go no further. Turns are numbered by ranges of (conversation, turn) and prefix counts, so no
conversation is one task. Groups are counted before they are sent; the join that tells members their group is an equi join that Spark may split. The ids of the conversations that end at a node are
sorted by range, joined to pieces where they are, and only the pieces of a node pass one task, as a stream, because its hash is one of a sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, parts_of, written

#: Conversations that share a head, and the most turns that are taken from it.
BLOCK, TURNS = 100, 6
#: Ids in a piece.
PIECE = 4096

EMPTY = hashlib.sha256(b"").hexdigest()


def _numbered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos from 1, h, chars) of every turn. Rows of one turn number are ordered by role, then by the SHA-256 of their text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    h = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.sha2(text.cast("binary"), 256).alias("tie"), F.unhex(F.substring(h, 1, 32)).alias("h"), F.char_length(text).cast("long").alias("chars")
    )
    lots = written(rows.repartitionByRange(parts_of(rows), "conv_id", F.col("turn").asc_nulls_first()).withColumn("lot", F.spark_partition_id()), "trie-turns")
    before = lots.groupBy("lot", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("lot", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie"))
    return lots.withColumn("at", at).join(before, ["lot", "conv_id"]).select("conv_id", (F.col("at") + F.col("before")).alias("pos"), "h", "chars")


def shared_turns(conv: Column) -> Column:
    """Turns that a conversation takes from its head, at most: crc32 of its decimal number modulo ``TURNS``."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(TURNS)).cast("long")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their rebuilt turns (conv_id, depth, h, chars, length), these in order of depth."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"most": shared_turns(F.col("conv_id")), "head": F.col("conv_id") - F.col("conv_id") % BLOCK})
    heads = own.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    taken = F.least("most", F.coalesce("head_n", F.lit(0).cast("long")))
    convs = own.join(heads, "head", "left").select("conv_id", "head", "most", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("most"), F.lit(0))).alias("length"))
    convs = written(convs, "trie-convs")
    first = turns.where(F.col("pos") < TURNS).withColumnRenamed("conv_id", "head").join(convs.select("conv_id", "head", "taken", "length"), "head").where("pos <= taken")
    rest = turns.join(convs.select("conv_id", "most", "taken", "length"), "conv_id").where("pos > most").withColumn("pos", F.col("pos") - F.col("most") + F.col("taken"))
    columns = ["conv_id", F.col("pos").alias("depth"), "h", "chars", "length"]
    both = first.select(*columns).unionByName(rest.select(*columns))
    return convs.select("conv_id", "length"), written(both.repartitionByRange(parts_of(both), "depth", "conv_id").sortWithinPartitions("depth"), "trie-rebuilt")


def _levels(turns: DataFrame, root: int) -> list[DataFrame]:
    """Tables of members by level: conv_id, parent, node (the smallest conv_id of the group), n, chars, length; those of a level are the live ones of the level above."""
    found, live, depth = [], None, 1
    while True:
        here = turns.where(F.col("depth") == depth).drop("depth")
        here = here.withColumn("parent", F.lit(root).cast("long")) if live is None else here.join(live, "conv_id")
        groups = here.groupBy("parent", "h").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"))
        level = written(here.join(groups, ["parent", "h"]).select("conv_id", "parent", "node", "n", "chars", "length"), f"trie-level-{depth}")
        found.append(level)
        live = level.where((F.col("n") > 1) & (F.col("length") > depth)).select("conv_id", F.col("node").alias("parent"))
        if live.isEmpty():
            return found
        depth += 1


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (depth, node, conv_id) in order as pieces: the numbers of a node joined by commas."""
    for rows in batches:
        for i in range(0, len(rows), PIECE):
            part = rows.iloc[i : i + PIECE]
            yield part.assign(piece=part["conv_id"].astype(str)).groupby(["depth", "node"], sort=False).agg(first=("conv_id", "first"), piece=("piece", ",".join)).reset_index()


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One hash a node from its pieces in order."""
    at, hashed = None, None
    for rows in batches:
        done = []
        for depth, node, piece in zip(rows["depth"].tolist(), rows["node"].tolist(), rows["piece"].tolist()):
            if (depth, node) != at:
                if at is not None:
                    done.append((*at, hashed.hexdigest()))
                at, hashed = (depth, node), hashlib.sha256(piece.encode())
            else:
                hashed.update(b"," + piece.encode())
        yield pd.DataFrame(done, columns=["depth", "node", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, hashed.hexdigest())], columns=["depth", "node", "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from (depth, node, conv_id): SHA-256 of the numbers in ascending order, joined by commas."""
    parts = parts_of(ends)
    order = ["depth", "node", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_pieces, "depth long, node long, first long, piece string")
    streams = pieces.repartition(parts, "depth", "node").sortWithinPartitions("depth", "node", "first")
    return streams.mapInPandas(_hashes, "depth long, node long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Every conversation c is rebuilt: the first crc32(c) % 6 turns of conversation c - c % 100 (fewer if it has fewer, none if it is absent), then its own turns after as many. A node of depth d is a distinct
    sequence of d first turns (role, text); the root has none, and all conversations, turnless ones included, are its members.

    Turns are ordered by number, null first; rows with one number by role, then by the SHA-256 of their text, and repeated rows are turns of their own. Null role or text is empty; a row without conv_id belongs
    to no conversation and is left out. Texts are hashed whole at any length. An empty table has no node, not even a root. Other columns are not read.
    """
    turns = written(_numbered(conversations, conv_col, turn_col, role_col, text_col), "trie-numbered")
    convs, rebuilt = _rebuilt(turns)
    dropped(turns)
    whole = convs.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n")).first()
    columns = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    spark = conversations.sparkSession
    if not whole.n:
        return spark.createDataFrame([], columns + ", ends_sha256 string")
    levels = _levels(rebuilt, whole.root)

    zero = F.lit(0).cast("long")
    ends = convs.where("length = 0").select(zero.alias("depth"), F.lit(whole.root).cast("long").alias("node"), "conv_id")
    lone, below, tables = None, None, []
    for depth, level in reversed(list(enumerate([None, *levels]))):
        if level is None:
            nodes = spark.range(1).select(F.lit(whole.root).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole.n).cast("long").alias("n_convs"), zero.alias("own"))
        else:
            nodes = level.where("conv_id = node and n > 1").select("conv_id", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("chars")).alias("own"))
            ends = ends.unionByName(level.where((F.col("n") > 1) & (F.col("length") == depth)).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
            chain = level.where("n = 1").select("conv_id", "parent", "length", F.lit(depth).cast("long").alias("from"))
            lone = chain if lone is None else lone.unionByName(chain)
        if below is None:  # no node of this level has children
            rolled = nodes.withColumns({"n_children": zero, "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.col("own")})
        else:
            up = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            rolled = nodes.join(up, "conv_id", "left").withColumns({"n_children": F.coalesce("children", zero), "n_leaves": F.coalesce("leaves", F.lit(1).cast("long")), "saved_tokens": F.col("own") + F.coalesce("saved", zero)})
        table = written(rolled.select("conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), f"trie-up-{depth}")
        tables.append(table)
        if level is not None:  # groups of one are leaves of the level above with one leaf, and save nothing
            ones = level.where("n = 1").select(F.col("parent").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
            below = table.select("parent_conv_id", "n_leaves", "saved_tokens").unionByName(ones)

    shared = tables[0]
    for t in tables[1:]:
        shared = shared.unionByName(t)
    hashed = ends_hashes(ends)
    shared = shared.join(hashed, (shared.depth == hashed.depth) & (shared.conv_id == hashed.node), "left").select(*[shared[c] for c in shared.columns], F.coalesce(hashed.ends_sha256, F.lit(EMPTY)).alias("ends_sha256"))
    chains = lone.select("conv_id", "parent", "from", "length", F.explode(F.sequence("from", "length")).alias("depth"))
    last = F.col("depth") == F.col("length")
    chains = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, zero).otherwise(zero + 1).alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return shared.unionByName(chains)


#: The same trie in DuckDB's SQL: nodes are lists of turns. DuckDB has no crc32, so it is folded bit by bit; -1 stands for one of the eight shifts after each byte.
SQL = f"""
WITH t AS (SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn_, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(turn_ ORDER BY pos) AS turns FROM t GROUP BY conv_id),
bits AS (SELECT conv_id, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS b FROM own),
hashed AS (SELECT conv_id, xor(list_reduce(b, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295) % {TURNS} AS h FROM bits),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(p.turns[1:h.h], []), o.turns[h.h + 1:]) AS turns FROM own o JOIN hashed h USING (conv_id) LEFT JOIN own p ON p.conv_id = o.conv_id - o.conv_id % {BLOCK}),
prefixes AS (SELECT conv_id, len(turns) AS length, d, turns[1:d] AS p FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d AS depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = d) AS ends,
  CASE WHEN d > 0 THEN (count(*) - 1) * length(p[-1].t) ELSE 0 END AS saved FROM prefixes GROUP BY d, p),
linked AS (SELECT c.*, p.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.p = c.p[1:c.depth - 1]),
children AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.depth = l.depth AND c.p = l.p),
upward AS (SELECT a AS depth, p[1:a] AS p, sum(saved)::BIGINT AS saved_tokens, sum((n_children = 0)::INT)::BIGINT AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM counted) GROUP BY a, p[1:a])
SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, u.n_leaves, u.saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256 FROM counted c JOIN upward u ON u.depth = c.depth AND u.p = c.p
"""
