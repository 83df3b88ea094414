"""The prefix trie of conversations, by smallest-member ownership.

A node is a sequence of turns with which a conversation starts; it is known by its depth and 128 bits that its turns, each bound to its
place, give by exclusive or: so prefixes are a running total, which ranges of a long conversation can share. The smallest member of
a node is its owner. As a child's members are among its parent's, each conversation owns a suffix of its path:
the first node that it owns, the tokens before that node and whether it owns a leaf say all that is needed of it, in a row a conversation.
One group-by over prefixes then sums, for every member, the tokens on its path below here that it doesn't own (its occurrences less
what is owned: each node counts once, with its owner), children that a member owns, and leaves.

Odd rows: rows with a null conv_id belong to no conversation and count nowhere; repeated rows are turns of their own; turns with the same
number follow the SHA-256 digest of role and text (null first, then by number, then digest). An empty table has no conversation and gives no
row. Conversations whose ids are multiples of `family` are their own base; `%` keeps the sign of a negative id. Columns with other names don't matter.

Scale: texts are digested where they are read. Group-bys combine before their shuffle, so the root, a popular first turn or a
crowd of equal conversations is no single task's work; a conversation with more than `LONG` turns is cut into ranges. The parents'
owners meet first owned nodes in a join whose hot keys Spark's skew join can split. The list of a node's ends is
made in blocks of `BLOCK` ids and hashed as a stream, so it's never held whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import running
from . import _kernel as K
from ._shared import partitions, stored

FAMILY = 5  # ids that share a base
HEAD = 9  # of which fewer turns are inherited
LONG = 1_000_000
BLOCK = 4096
COPIES_A_ROW = 10_000
NODE = ["depth", "k1", "k2"]


def turns(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, place, content, size): every turn with its place from 0, digest and bytes of text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    content = F.sha2(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), content.alias("content"), F.octet_length(text("text")).cast("long").alias("size"))
    # equal rows are counted and made again, so a row that is repeated a billion times isn't gathered
    counted = rows.groupBy("conv_id", "turn", "content", "size").agg(F.count("*").alias("n"))
    longest = rows.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = 1 if longest <= long else 64 + longest // long
    ended = running(counted, ["conv_id"], ["turn", "content"], {"end": ("n", "sum")}, min(parts, 2000))
    few, many = ended.filter(F.col("n") <= COPIES_A_ROW), ended.filter(F.col("n") > COPIES_A_ROW)
    blocks = many.withColumn("from", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1, F.lit(COPIES_A_ROW).cast("long")))).repartition(partitions(rows.sparkSession), "conv_id", "from")
    each = few.withColumn("from", F.col("end") - F.col("n")).union(blocks)
    last = F.least(F.col("from") + COPIES_A_ROW, F.col("end")) - 1
    return each.select("conv_id", F.explode(F.sequence("from", last)).alias("place"), "content", "size")


def rebuilt(conversations: DataFrame, family: int = FAMILY, head: int = HEAD, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, content, size, last) of every rebuilt conversation, depth 0 being the root, and whether some conversation is long.

    A conversation has its base's first h turns, h = crc32 of its id modulo `head`, and its own after its first h."""
    own = stored(turns(conversations, long))
    heads = own.filter((F.col("conv_id") % family == 0) & (F.col("place") < head - 1)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "content", "size"))).alias("head"))  # fewer than `head`
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head
    ids = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family})
    facts = ids.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    facts = facts.withColumn("taken", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")))
    facts = stored(facts.select("conv_id", "h", "taken", (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    root = F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("size")))
    inherited = facts.select("conv_id", "length", F.posexplode(F.concat(root, "taken")).alias("depth", "t")).select("conv_id", F.col("depth").cast("long").alias("depth"), "t.content", "t.size", "length")
    shifts = facts.select("conv_id", "h", (F.size("taken") - F.col("h") + 1).alias("shift"), "length")
    rest = own.join(shifts, "conv_id").filter(F.col("place") >= F.col("h")).select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "content", "size", "length")
    return inherited.union(rest), facts


def occurrences(conversations: DataFrame, family: int = FAMILY, head: int = HEAD, long: int = LONG) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, before, size, last): the nodes on each conversation's path, with their keys and their parents', and the bytes before the node's own turn."""
    rows, facts = rebuilt(conversations, family, head, long)
    longest = facts.agg(F.max("length")).first()[0] or 0
    lane = lambda seed: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("depth", "content", F.lit(seed)))
    rows = rows.withColumns({"x1": lane(1), "x2": lane(2)})
    parts = 1 if longest <= long else 64 + longest // long
    out = running(rows, ["conv_id"], ["depth"], {"k1": ("x1", "bit_xor"), "k2": ("x2", "bit_xor"), "total": ("size", "sum")}, min(parts, 2000))
    return out.select("conv_id", *NODE, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), (F.col("total") - F.col("size")).alias("before"), "size", (F.col("depth") == F.col("length")).alias("last"))


def _hashed(batches):
    """SHA-256 of each node's joined ids, whose blocks follow one another."""
    now, digest, done = None, None, []
    for batch in batches:
        for key, block in zip(zip(*[batch.column(k).to_pylist() for k in range(3)]), batch.column(4).to_pylist()):
            if key != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(block.encode())
            else:
                digest.update(b"," + block.encode())
        yield _rows(done)
        done = []
    if now is not None:
        yield _rows([(*now, digest.hexdigest())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found)) if found else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], [*NODE, "ends_sha256"])


def ends(path: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which a conversation ends."""
    block = F.expr(f"(conv_id - pmod(conv_id, {BLOCK})) div {BLOCK}")
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    blocks = path.filter("last").groupBy(*NODE, block.alias("block")).agg(ids.alias("ids"))
    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return dealt.mapInArrow(K.tidy(_hashed), "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, family: int = FAMILY, head: int = HEAD, long: int = LONG) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    path = stored(occurrences(conversations, family, head, long))
    owned = path.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), (F.count("*") == F.count_if("last")).alias("leaf"), F.min("before").alias("before"))
    owners = owned.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("s"), F.max("leaf").alias("leaf"))
    whole = path.filter("last").select("conv_id", F.col("depth").alias("length"), (F.col("before") + F.col("size")).alias("total"))
    # who owns nothing has all of its path from others
    members = whole.join(owners, "conv_id", "left").select("conv_id", "length", F.coalesce("s.depth", F.col("length") + 1).alias("start"), F.coalesce("s.before", "total").alias("until"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    nodes = path.join(members, "conv_id").groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.min_by("start", "conv_id").alias("start"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("depth") < F.col("length")) & (F.col("start") <= F.col("depth") + 1)).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("until") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    nodes = stored(nodes)
    first = nodes.filter((F.col("depth") > 0) & (F.col("depth") == F.col("start"))).select(*NODE, (F.col("depth") - 1).alias("d"), "p1", "p2")
    above = nodes.select(F.col("depth").alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    parents = first.join(above, ["d", "p1", "p2"]).select(*NODE, "above")
    out = nodes.join(parents, NODE, "left").join(ends(path), NODE, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: The same by whole sequences: nodes are lists of turns, and every node is added to all nodes on the path above it.
ORACLE = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list([role, text] ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS own FROM t GROUP BY 1),
i AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(1, 9)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 9 AS h FROM c),
r AS (SELECT i.conv_id, list_concat(coalesce(b.own[1:i.h], []), i.own[i.h + 1:]) AS path FROM i LEFT JOIN i b ON b.conv_id = i.conv_id - i.conv_id % 5),
o AS (SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path FROM r),
p AS (SELECT conv_id, depth, path[1:depth] AS k, path[1:depth - 1] AS above, depth = len(path) AS last FROM o),
n AS (SELECT k, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY k),
f AS (SELECT above AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(n.k[depth][2]) ELSE 0 END AS saved FROM n LEFT JOIN f ON f.k = n.k),
s AS (SELECT k[1:d] AS k, sum(saved) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.k = m.k LEFT JOIN n q ON m.depth > 0 AND q.k = m.above"""
