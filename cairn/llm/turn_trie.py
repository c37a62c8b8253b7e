"""Prefix trie of conversations by vertical bitmaps.

Conversations are cut into segments of 64 turns, and segments are sorted by the prefix
before them and by their own turns, over all tasks in even ranges. A shard is some
thousand neighbouring segments: (position, turn) points to the set of its conversations
that have this turn there, as a bitmap. Going down, a node's bitmap is intersected with
the postings of the next position, which gives its children, their number of members and
the conversations that end there. Shards' counts of a node are then added up.

Sums over subtrees need no walk over the trie: they are sums over a node's members. What
counts once for each distinct node (bytes, leaves) is put down to its smallest member,
which owns a node and all below it on its own path; so a first walk finds owners, and a second
one adds up.

Turns are known by 128 bits of SHA-256, prefixes by 128 bits as well.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Turns of a segment, segments of a shard, and the key of the root.
SEGMENT, SHARD = 64, 2_048
ROOT = bytes(16)
#: A conversation takes its first turns, eight at most, from the conversation that opens its group of five.
GROUP, HEAD = 5, 9


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, size) of the turns, pos from 1 in order of turn (null first; of equal ones in order of role's and text's digest).

    Ranges of the order are numbered apart. Only the first conversation of a range can have begun in
    earlier ones: what it had there is a row for each range, whatever the length of conversations.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("turn_id"), F.octet_length(text).cast("long").alias("size"))
    out = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("turn_id", pa.binary()), ("size", pa.int64())])

    def count(batches):
        part, conv, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            local = []
            for c in b.column("conv_id").to_pylist():
                conv, n = c, n + 1 if c == conv else 1
                local.append(n)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([part] * b.num_rows, pa.int32()), pa.array(local, pa.int64()), b.column("turn_id"), b.column("size")], schema=out)

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_id")]
    found = common.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, "conv_id long, part int, local long, turn_id binary, size long"), "turns")
    each = found.groupBy("conv_id", "part").agg(F.max("local").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begun = each.withColumn("before", before).filter("before is not null").select("conv_id", "part", "before")
    at = found.join(F.broadcast(begun), ["conv_id", "part"], "left")  # a row for each range at most
    return at.select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_id", "size")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, size) of rebuilt conversations; a conversation without turns has one row with nulls.

    Conversation c begins with the first h original turns of conversation c - c % 5, all of them if there
    are fewer and none if there is no such conversation, and goes on with its own turns after its first h; h is
    the CRC-32 of c's decimal digits modulo 9.
    """
    own = common.written(numbered(turns), "numbered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    sizes = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    bases = sizes.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), h.alias("h"), "n").join(bases, "base", "left")
    plan = plan.select("conv_id", "base", "h", "n", F.least("h", F.coalesce("n_base", F.lit(0))).alias("take"))
    heads = own.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD)).withColumnRenamed("conv_id", "base")
    head = plan.filter("take > 0").select("conv_id", "base", "take").join(heads, "base").filter("pos <= take").select("conv_id", "pos", "turn_id", "size")
    tail = own.filter(F.col("pos") > h).join(plan.select("conv_id", (F.col("take") - F.col("h")).alias("shift")), "conv_id").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn_id", "size")
    none = plan.filter("take = 0 and n <= h").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_id"), F.lit(None).cast("long").alias("size"))
    return head.unionByName(tail).unionByName(none)


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, path, sizes, last, prefix, start, rest): the segments of ``rebuilt``'s conversations.

    path is the segment's turns, prefix tells the turns before them (empty: none), start is the key of the node
    that they come to, and rest the bytes of later segments.
    """
    turn = F.struct("pos", "turn_id", "size")
    found = rows.withColumn("segment", F.coalesce(F.floor((F.col("pos") - 1) / SEGMENT), F.lit(0)).cast("int")).groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), turn))).alias("s"))
    path = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["turn_id"]))
    found = found.select("conv_id", "segment", path.alias("path"), F.col("s.size").alias("sizes"))
    # a prefix is a sum of numbers of its segments and their places: sums can be carried on, digests can't
    digest = F.sha2(F.concat(F.col("segment").cast("string").cast("binary"), F.col("path")), 256)
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    order = Window.partitionBy("conv_id").orderBy("segment")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.withColumn("prefix", F.coalesce(F.concat_ws(":", F.sum(number(1)).over(before).cast("string"), F.sum(number(16)).over(before).cast("string")), F.lit("")))
    key = F.unhex(F.substring(F.sha2(F.concat(F.col("prefix").cast("binary"), F.col("path")), 256), 1, 32))
    return found.select(
        "conv_id", "segment", "path", "sizes", "prefix", F.lead("segment").over(order).isNull().alias("last"), F.coalesce(F.lag(key).over(order), F.lit(ROOT)).alias("start"), F.coalesce(F.sum(total).over(after), F.lit(0)).alias("rest")
    )


NODES = "key binary, parent binary, depth long, low long, n long, carried long, owned long, leaves long, first long, ends string"


class Shard:
    """The bitmaps of some segments that have one prefix, and the walk over their nodes."""

    def __init__(self, rows: list[dict]):
        self.rows, self.depth, self.start = rows, rows[0]["segment"] * SEGMENT, rows[0]["start"]
        self.turns = [[p[i : i + 16] for i in range(0, len(p), 16)] for p in (r["path"] for r in rows)]
        self.postings: dict[tuple[int, bytes], int] = {}
        self.longer = [0] * (SEGMENT + 1)  # by number of turns: who has more
        for i, ts in enumerate(self.turns):
            for j, t in enumerate(ts):
                self.postings[j, t] = self.postings.get((j, t), 0) | 1 << i
                self.longer[j] |= 1 << i
        self.below = []  # of each segment and turn: bytes from there on
        for r in rows:
            sums = [r["rest"]]
            for size in reversed(r["sizes"]):
                sums.append(sums[-1] + size)
            self.below.append(sums[::-1])

    def node(self, key: bytes, parent: bytes | None, bits: int, j: int) -> tuple:
        """What the shard has of the node that its members' first j turns come to."""
        low = n = carried = owned = leaves = 0
        ends: list[int] = []
        while bits:
            bit = bits & -bits
            i, bits = bit.bit_length() - 1, bits ^ bit
            r, below = self.rows[i], self.below[i]
            c = r["conv_id"]
            low, n = c if not n else min(low, c), n + 1
            carried += below[max(j - 1, 0)]
            leaves += r["leaf"]
            if r["owns"] is not None:
                owned += below[min(max(j - 1, r["owns"] - self.depth - 1, 0), len(below) - 1)] - r["rest"] + r["rest_owned"]
            if r["last"] and len(self.turns[i]) == j:
                ends.append(c)
        return key, parent, self.depth + j, low, n, carried, owned, leaves, ends[0] if ends else None, ",".join(map(str, ends)) if ends else None

    def walk(self):
        everyone = (1 << len(self.rows)) - 1
        if self.start == ROOT:
            yield self.node(ROOT, None, everyone, 0)
        stack = [(everyone, 0, self.start, hashlib.sha256(self.rows[0]["prefix"].encode()))]
        while stack:
            bits, j, key, digest = stack.pop()
            left = bits & self.longer[j]
            while left:
                t = self.turns[(left & -left).bit_length() - 1][j]
                child = bits & self.postings[j, t]
                left &= ~child
                down = digest.copy()
                down.update(t)
                name = down.digest()[:16]
                yield self.node(name, key, child, j + 1)
                stack.append((child, j + 1, name, down))


def nodes(parts: DataFrame, shard: int = SHARD) -> DataFrame:
    """What shards have of each node, from segments with owns, rest_owned and leaf: columns as NODES says."""
    order = ["segment", "prefix", "path", "last", "conv_id"]
    kinds = [pa.binary(), pa.binary()] + [pa.int64()] * 7 + [pa.string()]
    out = pa.schema([(x.split()[0], k) for x, k in zip(NODES.split(", "), kinds)])

    def found(rows: list[dict]):
        made: list[tuple] = []
        at = 0
        while at < len(rows):
            to = at + 1
            while to < len(rows) and (rows[to]["segment"], rows[to]["prefix"]) == (rows[at]["segment"], rows[at]["prefix"]):
                to += 1
            made.extend(Shard(rows[at:to]).walk())
            at = to
        for i in range(0, len(made), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[i : i + 10_000]), kinds)], schema=out)

    def each(batches):
        rows: list[dict] = []
        for b in batches:
            for i in range(0, b.num_rows, shard):
                rows.extend(b.slice(i, shard).to_pylist())
                if len(rows) >= shard:
                    yield from found(rows[:shard])
                    rows = rows[shard:]
        yield from found(rows)

    return parts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(each, NODES)


def digests(found: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end. Lists come in pieces, in order, and stream through: none is held as a whole."""
    out = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def each(batches):
        key, digest = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], schema=out)

    pieces = found.filter("ends is not null").select("key", "first", "ends").repartition("key").sortWithinPartitions("key", "first")
    return pieces.select("key", "ends").mapInArrow(each, "key binary, ends_sha256 string")


def trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty, null turns come first, and turns of equal number are in order of their
    digest; repeated rows are turns each. Rows without conv_id are no conversation. A conversation that rebuilding
    leaves without turns is a member of the root alone. An empty table gives no rows. Other columns are not looked at.
    """
    parts = common.written(segments(rebuilt(turns)), "segments")
    plain = parts.withColumn("owns", F.lit(None).cast("long")).withColumn("rest_owned", F.lit(0).cast("long")).withColumn("leaf", F.lit(0).cast("long"))
    known = common.written(nodes(plain, shard).groupBy("key", "parent", "depth").agg(F.min("low").alias("low")), "nodes")
    children = known.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    owns = known.groupBy(F.col("low").alias("conv_id")).agg(F.min("depth").alias("owns"))
    leaf = known.join(children, "key", "left_anti").select(F.col("low").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    owned = F.aggregate(F.filter("sizes", lambda s, i: F.col("segment") * SEGMENT + i + 1 >= F.col("owns")), F.lit(0).cast("long"), lambda a, x: a + x)
    after = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(1, Window.unboundedFollowing)
    weighed = parts.join(owns, "conv_id", "left").join(leaf, "conv_id", "left")
    weighed = weighed.withColumn("leaf", F.coalesce("leaf", F.lit(0))).withColumn("rest_owned", F.coalesce(F.sum(F.when(F.col("owns").isNotNull(), owned)).over(after), F.lit(0)))
    found = common.written(nodes(weighed, shard), "counts")
    whole = found.groupBy("key", "parent", "depth").agg(F.min("low").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.col("carried") - F.col("owned")).alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    parents = known.select(F.col("key").alias("parent"), F.col("low").alias("parent_conv_id"))
    out = whole.join(children, "key", "left").join(digests(found), "key", "left").join(parents, "parent", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return trie(common.table(spark, sf_dir, "conversations"))


#: The same rows in SQL: paths are strings of digests, and every node is counted at each of its ancestors.
SQL = f"""
    WITH t AS (SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, k, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM t),
    c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
                 lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % {HEAD} AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS src, o.pos, k, size FROM c JOIN o ON o.conv_id = c.base AND o.pos <= h UNION ALL SELECT c.conv_id, 1, o.pos, k, size FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > h),
    p AS (SELECT conv_id, row_number() OVER w AS d, size, string_agg(k, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY src, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    m AS (SELECT conv_id, d, size, path FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    n AS (SELECT path, d, any_value(size) AS size, min(conv_id) AS low, count(*) AS n FROM m GROUP BY path, d),
    ch AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
    up AS (SELECT left(n.path, 64 * a) AS path, sum((n - 1) * size) AS saved, count(*) FILTER (n_children IS NULL) AS leaves FROM (SELECT n.*, unnest(range(0, d + 1)) AS a FROM n) n LEFT JOIN ch ON ch.path = n.path GROUP BY 1),
    e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, d) AS path FROM m GROUP BY conv_id) GROUP BY path)
    SELECT n.low AS conv_id, CAST(n.d AS BIGINT) AS depth, q.low AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM n JOIN up ON up.path = n.path LEFT JOIN ch ON ch.path = n.path LEFT JOIN e ON e.path = n.path LEFT JOIN n q ON n.d > 0 AND q.path = left(n.path, 64 * (n.d - 1))"""
