"""The trie of conversations' prefixes by distributed MSD radix partitioning.

Turns become dictionary ids, conversations sequences of ids, equal sequences one class that knows its members. A round
deals the classes of all large buckets by one more digit, with counts alone in the shuffle; buckets small enough for a
task leave and are finished there by multikey quicksort. Rounds run until no bucket is large, so a prefix that a third of
all conversations share costs rounds, never a task. Sums over subtrees go up once, from the top of every local bucket to
all its ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

#: A bucket of at most so many turns is finished in one task: between these bounds, one in SHARE of all turns.
LEAST_LOCAL, MOST_LOCAL, SHARE = 20_000, 5_000_000, 10_000
#: A digest's rows are dealt out if it has over one in so many of all turns; there are fewer such digests than that.
HOT_SHARE = 1_000
#: Rows of counts that are broadcast at most; more large buckets than that meet their rows by a shuffle.
MOST_BROADCAST = 200_000
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
_NODE_ROWS = 50_000


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (128 bits of role and text) and bytes (of the text in UTF-8); null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select("conv_id", "turn", F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("digest"), F.octet_length(text).alias("bytes"))


def encoded(turns: DataFrame) -> DataFrame:
    """Turns with id, their digest's number in a dictionary of all distinct ones.

    The dictionary is written once, so ids are settled; turns of the few digests that many have look them up in a
    broadcast, all others by a join.
    """
    counts = turns.groupBy("digest").agg(F.count("*").alias("n"))
    dictionary = stored(counts.withColumn("id", F.monotonically_increasing_id()), "turn-ids")
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    hot = dictionary.where(F.col("n") > max(1_000, total // HOT_SHARE)).select("digest", F.col("id").alias("hot_id"))
    known = turns.join(F.broadcast(hot), "digest", "left")
    # A row that has its id already gets a key of its own, which nothing matches and which lies anywhere.
    key = F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(F.unhex(F.sha2(F.concat_ws(",", "conv_id", "turn"), 256)))
    cold = dictionary.select(F.col("digest").alias("key"), "id")
    return known.withColumn("key", key).join(cold, "key", "left").select("conv_id", "turn", "digest", "bytes", F.coalesce("hot_id", "id").alias("id"))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids and sizes (bytes) of each conversation's turns, by turn (null first), then digest.

    A conversation is one row of twelve bytes a turn; its texts are not in it.
    """
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "bytes"))).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: x["bytes"]).alias("sizes"))


def rebuilt(own: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation with its first h turns from the first of its family, h being crc32(conv_id) mod `most`.

    A family is `family` ids in a row; its first is the largest multiple of `family` that isn't above the id. Where that
    conversation has fewer turns, or there is none, fewer or none are taken; own turns follow after the first h.
    """
    first = F.try_subtract(F.col("conv_id"), F.pmod("conv_id", F.lit(family)))
    heads = own.where(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("first"), F.slice("ids", 1, most - 1).alias("f_ids"), F.slice("sizes", 1, most - 1).alias("f_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.select("*", first.alias("first"), h.alias("h")).join(heads, "first", "left")

    def spliced(head: str, tail: str):
        taken = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.slice(tail, 1, 0))
        return F.concat(taken, F.slice(tail, F.col("h") + 1, F.size(tail))).alias(tail)

    return joined.select("conv_id", spliced("f_ids", "ids"), spliced("f_sizes", "sizes"))


CLASS = "h long, ids array<long>, sizes array<int>, m long, n long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def classes(conversations: DataFrame, chunk_ids: int = 50_000) -> DataFrame:
    """h, ids, sizes, m (smallest member), n (members) and ends_sha256 (of the members' ids) of each distinct sequence.

    Members are sorted by ranges of (hash, conv_id): a sequence that many share spreads over tasks, each of which makes
    pieces of its list; only pieces meet, in order, where the list is hashed as they pass.
    """
    ship(conversations.sparkSession)
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = conversations.withColumn("h", F.xxhash64("ids"))
    dealt = hashed.repartitionByRange(parts, "h", "conv_id").sortWithinPartitions("h", "ids", "conv_id").select("h", "ids", "sizes", "conv_id")
    piece, whole = f"{CLASS}, members string", f"{CLASS}, ends_sha256 string"
    piece_schema, whole_schema = _arrow(piece), _arrow(whole)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, found, members = None, [], []

        def flush() -> None:
            if members:
                found.append((*here, members[0], len(members), ",".join(map(str, members))))
                members.clear()

        for batch in batches:
            for h, ids, sizes, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here is None or h != here[0] or ids != here[1] or len(members) >= chunk_ids:
                    flush()
                    here = (h, ids, sizes)
                members.append(conv)
            if len(found) > 5_000:
                yield _batch(found, piece_schema)
                found = []
        flush()
        if found:
            yield _batch(found, piece_schema)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, found, digest, n = None, [], None, 0

        def flush() -> None:
            if here is not None:
                found.append((*here, n, digest.hexdigest()))

        for batch in batches:
            for h, ids, sizes, m, own, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here is None or h != here[0] or ids != here[1]:
                    flush()
                    here, digest, n = (h, ids, sizes, m), hashlib.sha256(members.encode()), own
                else:
                    digest.update(b"," + members.encode())
                    n += own
            if len(found) > 5_000:
                yield _batch(found, whole_schema)
                found = []
        flush()
        if found:
            yield _batch(found, whole_schema)

    return dealt.mapInArrow(pieces, piece).repartition("h").sortWithinPartitions("h", "ids", "m").mapInArrow(merged, whole)


class _Nodes:
    """Nodes of local buckets as columns, in the order in which they were made."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(9)]

    def chain(self, ids: list, sizes: list, n: int, m: int, ends: str, depth: int, parent: int, path: list | None) -> None:
        """The nodes below `depth` of a sequence that is alone in its bucket."""
        deep = len(ids) - depth
        saved = np.cumsum(np.asarray(sizes[depth:][::-1], dtype=np.int64))[::-1] * (n - 1)
        for column, values in zip(
            self.columns,
            ([m] * deep, range(depth + 1, len(ids) + 1), [parent, *[m] * (deep - 1)], [n] * deep, [*[1] * (deep - 1), 0], [1] * deep, saved.tolist(), [*[NO_MEMBERS] * (deep - 1), ends], [path, *[None] * (deep - 1)]),
            strict=True,
        ):
            column.extend(values)


def multikey_nodes(rows: list[tuple], depth: int, out: _Nodes) -> None:
    """Adds the nodes of one bucket's classes (ids, sizes, m, n, ends_sha256, path), which share their first depth + 1 ids.

    Ternary quicksort on one digit: classes with the pivot's digit are a node, and go on with the next digit; the others
    are sorted by the same one. The nodes come parents first, so one pass back adds up their subtrees.
    """
    path, parent = rows[0][5], rows[0][5][-1]
    if len(rows) == 1:
        ids, sizes, m, n, ends, _ = rows[0]
        out.chain(ids, sizes, n, m, ends, depth, parent, path)
        return
    lens = np.array([len(r[0]) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    flat, sizes = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows]), np.concatenate([np.asarray(r[1], dtype=np.int64) for r in rows])
    m, n = np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64)
    made: list[list] = []  # m, depth, number of the parent here, n, children, leaves, saved, ends
    todo = [(np.arange(len(rows)), depth, -1)]  # classes to sort by the digit at depth, below a node
    while todo:
        group, d, above = todo.pop()
        digits = flat[starts[group] + d]
        pivot = digits[len(digits) // 2]
        same = group[digits == pivot]
        for others in (group[digits > pivot], group[digits < pivot]):
            if len(others):
                todo.append((others, d, above))
        while True:  # down while the node has one child with all that goes on
            number, members = len(made), int(n[same].sum())
            ended, on = same[lens[same] == d + 1], same[lens[same] > d + 1]
            made.append([int(m[same].min()), d + 1, above, members, 0, 0, (members - 1) * int(sizes[starts[same[0]] + d]), rows[ended[0]][4] if len(ended) else NO_MEMBERS])
            if above >= 0:
                made[above][4] += 1
            if len(on) != 1:
                break
            above, d, same = number, d + 1, on
        if len(on):
            todo.append((on, d + 1, number))
    for node in reversed(made):
        node[5] = node[5] or 1
        if node[2] >= 0:
            made[node[2]][5] += node[5]
            made[node[2]][6] += node[6]
    for i, (least, d, above, members, children, leaves, saved, ends) in enumerate(made):
        for column, value in zip(out.columns, (least, d, made[above][0] if above >= 0 else parent, members, children, leaves, saved, ends, None if i else path), strict=True):
            column.append(value)


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _local_nodes(buckets: DataFrame) -> DataFrame:
    """NODE and path (at a bucket's top alone: its ancestors' smallest members) of every node of small buckets."""
    schema = _arrow(f"{NODE}, path array<long>")
    dealt = buckets.repartition("d", "node", "digit").sortWithinPartitions("d", "node", "digit", "h").select("d", "node", "digit", "ids", "sizes", "m", "n", "ends_sha256", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, out = None, [], _Nodes()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out.columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for d, node, digit, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, node, digit) != here:
                    if rows:
                        multikey_nodes(rows, here[0], out)
                        if len(out.columns[0]) > _NODE_ROWS:
                            yield made()
                            out = _Nodes()
                    here, rows = (d, node, digit), []
                rows.append(tuple(row))
        if rows:
            multikey_nodes(rows, here[0], out)
        if out.columns[0]:
            yield made()

    return dealt.mapInArrow(run, f"{NODE}, path array<long>")


def _joined_counts(rows: DataFrame, large: DataFrame, n_large: int) -> DataFrame:
    """Rows with their bucket's next node as `next`, null where the bucket is small; many large buckets aren't broadcast."""
    return rows.join(F.broadcast(large) if n_large <= MOST_BROADCAST else large, ["node", "digit"], "left")


def trie(conversations: DataFrame, local_turns: int | None = None) -> DataFrame:
    """NODE of every distinct prefix of (conv_id, ids, sizes) rows, the root included; no rows without conversations.

    local_turns: how many turns a bucket that one task finishes may have; by default as LEAST_LOCAL, MOST_LOCAL and SHARE
    say. A bucket of one distinct sequence is local at any length.
    """
    found = stored(classes(conversations), "classes")
    size = found.agg(F.sum("n").alias("n"), F.min("m").alias("m"), F.sum(F.size("ids")).alias("turns")).first()
    if not size.n:
        return conversations.sparkSession.createDataFrame([], NODE)
    most = local_turns or max(LEAST_LOCAL, min(MOST_LOCAL, size.turns // SHARE))
    spark = conversations.sparkSession
    root = spark.createDataFrame([(size.m, 0, None, size.n, 0, [size.m])], "conv_id long, depth long, parent_conv_id long, n_convs long, bytes long, path array<long>")
    tops, ended, local = root, None, None
    alive, d = found.withColumn("path", F.array(F.lit(size.m))), 0
    while True:
        # Of a large bucket, all classes that go on are dealt by their digit at d; one class at most ends here.
        done = alive.where(F.size("ids") == d).select(F.element_at("path", -1).alias("conv_id"), F.lit(d).cast("long").alias("depth"), "ends_sha256")
        ended = done if ended is None else ended.unionByName(done)
        on = alive.where(F.size("ids") > d).withColumns({"node": F.element_at("path", -1), "digit": F.col("ids")[d]})
        counts = on.groupBy("node", "digit").agg(F.min("m").alias("next"), F.sum("n").alias("n_convs"), F.first(F.col("sizes")[d]).cast("long").alias("bytes"), F.first("path").alias("above"), F.count("*").alias("classes"), F.sum(F.size("ids") - d).alias("turns"))
        large = stored(counts.where((F.col("turns") > most) & (F.col("classes") > 1)), "large-buckets")
        n_large = large.count()
        dealt = stored(_joined_counts(on, large.select("node", "digit", "next"), n_large).withColumn("d", F.lit(d)), "buckets")
        small = dealt.where("next IS NULL")
        local = small if local is None else local.unionByName(small)
        if not n_large:
            break
        d += 1
        tops = tops.unionByName(large.select(F.col("next").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", "bytes", F.concat("above", F.array("next")).alias("path")))
        alive = dealt.where("next IS NOT NULL").withColumn("path", F.concat("path", F.array("next"))).select(*found.columns, "path")
    nodes = stored(_local_nodes(local), "local-nodes")
    return nodes.drop("path").unionByName(_large_nodes(tops, ended, nodes))


def _large_nodes(tops: DataFrame, ended: DataFrame, nodes: DataFrame) -> DataFrame:
    """NODE of large buckets' nodes: what is below each is summed from the tops of small buckets and large nodes there."""
    below = nodes.where("path IS NOT NULL").select("path", "n_leaves", "saved_tokens", F.lit(True).alias("child"), F.size("path").cast("long").alias("depth"))
    own = tops.select("path", F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), F.lit(False).alias("child"), "depth")
    # A large node stands in its own path, at its depth; its parent is the one before.
    each = below.unionByName(own).select("n_leaves", "saved_tokens", "child", F.col("depth").alias("at"), F.posexplode("path").alias("depth", "conv_id"))
    sums = each.groupBy(F.col("depth").cast("long").alias("depth"), "conv_id").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.count_if(F.col("depth") == F.col("at") - 1).alias("n_children"))
    joined = tops.drop("path").join(sums, ["depth", "conv_id"]).join(ended, ["depth", "conv_id"], "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, local_turns: int | None = None) -> DataFrame:
    """NODE of the trie of all conversations, rebuilt by families (see rebuilt).

    Turns are ordered by turn, null first; ties and repeated rows are turns of their own, ordered by a digest of role and
    text. A null role or text is empty. Rows without conv_id belong to no conversation and are left out. A conversation
    whose rebuilt sequence is empty is a member of the root alone. Other columns aren't read. No rows give no nodes.
    """
    own = stored(sequences(encoded(turn_digests(conversations))), "sequences")
    return trie(rebuilt(own), local_turns)
