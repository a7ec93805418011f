"""A prefix trie of conversations: ternary search trees per range shard, merged along the shards' borders.

A turn is known by its code: 16 bytes of a hash of role and text, then the text's length.  A conversation is
its turns' codes in a row, so bytewise order keeps equal beginnings together.  Equal conversations
become one row with a count.  The rows are dealt to shards by ranges; a shard numbers its codes in
their order and inserts its conversations median first, which keeps the trees balanced.

Nodes that end in one shard are complete there.  Only beginnings that the last conversation of a shard shares with the first of
the next stand in more than one.  Their counts add up across shards, less what both sides of a border
count: so much is known from the two conversations at the border, and one sum per node merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.llm.common import buckets_for, table, tidy
from lintel.session import stored

#: Bytes of a turn's code: hash, then length of the text.
HASH, CODE = 16, 20
#: Bytes of codes per shard.
SHARD = 4 << 20
#: Ids of the same end are put in a row until they have so many bytes.
PIECE = 1 << 20
#: A conversation starts with turns of the first of its five, fewer than so many.
GROUP, SHARED_TURNS = 5, 9
NODE = ("depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "parent_conv_id long, shard int, path binary, parent_path binary, ends binary")
FIELDS = [f.split()[0] for f in NODE.split(", ")]
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def turn_code() -> Column:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 2 * HASH), F.lpad(F.hex(F.octet_length(text)), 2 * (CODE - HASH), "0")))


def sequences(turns: DataFrame) -> DataFrame:
    """``(conv_id, codes)``: each conversation's turns in order as one row of codes; texts are left behind."""
    coded = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", turn_code().alias("code")).alias("t"))
    return coded.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("t")), lambda t: F.hex(t["code"])), "").alias("codes")).select("conv_id", F.unhex("codes").alias("codes"))


def rebuilt(own: DataFrame, group: int = GROUP, shared_turns: int = SHARED_TURNS) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its group."""
    first = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared_turns)).cast("int")
    leader = F.col("conv_id") - F.col("conv_id") % group
    leads = (own.filter(F.col("conv_id") % group == 0)
             .select(F.col("conv_id").alias("leader"), F.substring("codes", 1, CODE * (shared_turns - 1)).alias("lead")))
    lead = F.coalesce(F.substring(F.col("lead"), F.lit(1), first * CODE), F.lit(b""))
    rest = F.substring(F.col("codes"), first * CODE + 1, F.octet_length("codes"))
    return (own.withColumn("leader", leader).join(leads, "leader", "left")
            .select("conv_id", F.concat(lead, rest).alias("codes")))


class Shard:
    """The ternary search tree of one shard; node 0 is the root, a node comes after its parent."""

    def __init__(self, rows: list[tuple[bytes, int, int]]):
        """``rows`` are distinct ``(codes, smallest conv_id, count)`` in order."""
        cut = [[codes[i:i + CODE] for i in range(0, len(codes), CODE)] for codes, _, _ in rows]
        self.codes = sorted({c for codes in cut for c in codes})
        number = {c: i for i, c in enumerate(self.codes)}
        bytes_of = [int.from_bytes(c[HASH:], "big") for c in self.codes]
        self.key, self.low, self.same, self.high, self.up, self.depth = [-1], [-1], [-1], [-1], [-1], [0]
        self.least, self.members, self.ends = [None], [0], [0]
        at = {}
        todo = [(0, len(rows))]
        while todo:  # the median of a range first, then both halves
            a, b = todo.pop()
            if a == b:
                continue
            m = (a + b) // 2
            at[m] = self.insert([number[c] for c in cut[m]])
            todo += [(m + 1, b), (a, m)]
        self.row_of = {at[m]: m for m in at}
        for m, (_, conv, count) in enumerate(rows):
            n = at[m]
            self.members[n] += count
            self.least[n] = conv
        n_nodes = len(self.key)
        self.children, self.leaves, self.saved = [0] * n_nodes, [0] * n_nodes, [0] * n_nodes
        for n in range(n_nodes - 1, -1, -1):  # children before parents
            self.leaves[n] = self.leaves[n] or 1
            if n:
                self.saved[n] += (self.members[n] - 1) * bytes_of[self.key[n]]
                up = self.up[n]
                self.children[up] += 1
                self.leaves[up] += self.leaves[n]
                self.saved[up] += self.saved[n]
                self.members[up] += self.members[n]
                if self.least[up] is None or self.least[n] < self.least[up]:
                    self.least[up] = self.least[n]

    def _new(self, key: int, up: int) -> int:
        for column, value in ((self.key, key), (self.low, -1), (self.same, -1), (self.high, -1), (self.up, up),
                              (self.depth, self.depth[up] + 1), (self.least, None), (self.members, 0)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, keys: list[int]) -> int:
        """The node where the path ends."""
        key, low, same, high = self.key, self.low, self.same, self.high
        top = 0
        for k in keys:
            at = same[top]
            if at < 0:
                same[top] = top = self._new(k, top)
                continue
            while key[at] != k:
                side = low if k < key[at] else high
                if side[at] < 0:
                    side[at] = self._new(k, top)
                at = side[at]
            top = at
        return top

    def path(self, codes: bytes) -> list[int]:
        """The nodes of a conversation of this shard, from the root on."""
        keys = {c: i for i, c in enumerate(self.codes)}
        nodes, key = [0], self.key
        for i in range(0, len(codes), CODE):
            k, at = keys[codes[i:i + CODE]], self.same[nodes[-1]]
            while key[at] != k:
                at = self.low[at] if k < key[at] else self.high[at]
            nodes.append(at)
        return nodes


def path_key(codes: bytes) -> bytes:
    """What a node is known by outside its shard: a hash of its path."""
    return hashlib.sha256(codes).digest()[:HASH]


def shard_nodes(shard: int, rows: list[tuple[bytes, int, int]], before: int, after: int) -> dict[str, list]:
    """All nodes of a shard.

    ``before`` and ``after`` are how many turns its first and last conversation share with the neighbouring
    shard (-1: no neighbour).  Nodes on these borders have a ``path`` and this shard's part of their
    sums, their children a ``parent_path``.
    """
    tree = Shard(rows)
    first, last = rows[0][0], rows[-1][0]
    border: dict[int, bytes] = {}
    for codes, shared in ((first, before), (last, after)):
        for depth, n in enumerate(tree.path(codes)[:shared + 1]):
            border.setdefault(n, path_key(codes[:depth * CODE]))
    children, leaves, saved = tree.children, tree.leaves, tree.saved
    if after >= 0:  # the next shard counts these as well
        is_leaf, twice = len(last) == after * CODE, 0
        for depth in range(after, -1, -1):
            n = tree.path(last)[depth] if depth == after else tree.up[n]
            if depth:
                twice += int.from_bytes(last[depth * CODE - CODE + HASH:depth * CODE], "big")
            saved[n] += twice
            leaves[n] -= is_leaf
            children[n] -= depth < after
    nodes = range(len(tree.key))
    return {
        "depth": tree.depth, "conv_id": tree.least, "n_convs": tree.members, "n_children": children, "n_leaves": leaves,
        "saved_tokens": saved, "parent_conv_id": [tree.least[tree.up[n]] if n and tree.up[n] not in border else None for n in nodes],
        "shard": [shard] * len(nodes), "path": [border.get(n) for n in nodes],
        "parent_path": [border.get(tree.up[n]) if n else None for n in nodes],
        "ends": [path_key(rows[tree.row_of[n]][0]) if n in tree.row_of else None for n in nodes]}


def shared_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // CODE
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid * CODE] == b[:mid * CODE]:
            low = mid
        else:
            high = mid - 1
    return low


@tidy
def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = batch.to_pydict()
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), pa.array([-1 if p is None else shared_turns(p, f) for p, f in zip(cols["previous"], cols["first"])], pa.int64()),
             pa.array([-1 if n is None else shared_turns(c, n) for c, n in zip(cols["last"], cols["next"])], pa.int64())],
            names=["shard", "before", "after"])


@tidy
def _grow(key, rows, border):
    order = rows.sort_by("codes")
    nodes = shard_nodes(key[0].as_py(), list(zip(*(order[c].to_pylist() for c in ("codes", "conv_id", "n")))),
                        border["before"][0].as_py(), border["after"][0].as_py())
    return pa.table({f: pa.array(nodes[f], KINDS[k]) for f, k in (x.split() for x in NODE.split(", "))})


def ends_digest(members: DataFrame, parts: int) -> DataFrame:
    """``(ends, ends_sha256)`` of ``(ends, conv_id)``: a hash of the ids of each end, in order and joined by commas.

    A hash runs over one string.  Ids are put in a row where ranges of them lie, so the task that
    hashes an end of very many conversations reads few rows, a piece at a time.
    """
    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, first, ids, size = None, 0, [], 0
        done: list[tuple[bytes, int, str]] = []
        for batch in batches:
            for e, c in zip(batch.column("ends").to_pylist(), batch.column("conv_id").to_pylist()):
                if e != end or size > PIECE:
                    if ids:
                        done.append((end, first, ",".join(ids)))
                    end, first, ids, size = e, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(done) > 10_000 or size > PIECE:
                yield pieces(done)
                done = []
        if ids:
            done.append((end, first, ",".join(ids)))
        yield pieces(done)

    def pieces(done):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64()),
                                           pa.array([d[2] for d in done], pa.string())], names=["ends", "first", "ids"])

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, state, done = None, None, []
        for batch in batches:
            for e, ids in zip(batch.column("ends").to_pylist(), batch.column("ids")):
                if e != end:
                    if state is not None:
                        done.append((end, state.hexdigest()))
                    end, state = e, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            yield found(done)
            done = []
        if state is not None:
            yield found([(end, state.hexdigest())])

    def found(done):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                                          names=["ends", "ends_sha256"])

    rows = (members.repartitionByRange(parts, "ends", "conv_id").sortWithinPartitions("ends", "conv_id")
            .mapInArrow(join, "ends binary, first long, ids string"))
    return (rows.repartition(parts, "ends").sortWithinPartitions("ends", "first")
            .mapInArrow(digest, "ends binary, ends_sha256 string"))


def prefix_trie(convs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """One row per node of the trie of ``(conv_id, codes)``.

    ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.  Every conversation is a member of the root, so an empty table alone has no nodes.
    """
    spark = convs.sparkSession
    known = stored(convs.withColumn("ends", F.unhex(F.substring(F.sha2("codes", 256), 1, 2 * HASH))), "convs")
    distinct = stored(known.groupBy("ends").agg(F.first("codes").alias("codes"), F.min("conv_id").alias("conv_id"),
                                                F.count(F.lit(1)).alias("n")), "sequences")
    size = distinct.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    parts = buckets_for(spark, size, shard_bytes)
    shards = stored(distinct.select("codes", "conv_id", "n").repartitionByRange(parts, "codes")
                    .withColumn("shard", F.spark_partition_id()), "shards")
    nodes = stored(shards.groupBy("shard").cogroup(borders(shards).groupBy("shard")).applyInArrow(_grow, NODE), "nodes")
    return with_ends(spark, merged(nodes), ends_digest(known.select("ends", "conv_id"), parts))


def borders(shards: DataFrame) -> DataFrame:
    """``(shard, before, after)``: turns that a shard's first and last conversation share with the neighbours."""
    edges = shards.groupBy("shard").agg(F.min("codes").alias("first"), F.max("codes").alias("last"))
    order = Window.orderBy("shard")  # one row per shard
    return (edges.select("shard", "first", "last", F.lag("last").over(order).alias("previous"), F.lead("first").over(order).alias("next"))
            .mapInArrow(_borders, "shard int, before long, after long"))


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes of borders as one row each, and every node with its parent's smallest member."""
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    border = nodes.filter(F.col("path").isNotNull())
    whole = border.groupBy("path").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums),
        F.first("parent_path").alias("parent_path"), F.max("ends").alias("ends"))
    whole = stored(whole, "border")
    least = whole.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    # a border's least member is looked up per shard, so the many children of one node stay apart
    near = border.select("shard", F.col("path").alias("parent_path")).join(least, "parent_path")
    inner = nodes.filter(F.col("path").isNull())
    kept = ["depth", "conv_id", *sums, "parent_conv_id", "ends"]
    return (inner.filter(F.col("parent_path").isNull()).select(*kept)
            .unionByName(inner.filter(F.col("parent_path").isNotNull()).drop("parent_conv_id")
                         .join(near, ["shard", "parent_path"]).select(*kept))
            .unionByName(whole.join(least, "parent_path", "left").select(*kept)))


def with_ends(spark: SparkSession, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = stored(nodes, "trie")
    return (nodes.filter(F.col("ends").isNull()).withColumn("ends_sha256", nothing).select(*names)
            .unionByName(nodes.filter(F.col("ends").isNotNull()).join(ends, "ends").select(*names)))


def conversation_trie(turns: DataFrame, group: int = GROUP, shared_turns: int = SHARED_TURNS, shard_bytes: int = SHARD) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns``, see ``rebuilt`` and ``prefix_trie``.

    ``turns`` needs ``conv_id, turn, role, text``; other columns of whatever name are not looked at.  Turns count in
    order of ``turn``, a null one first, equal ones in order of a hash of role and text; repeated rows are turns of
    their own.  A null role or text is empty.  Rows without a conv_id belong to no conversation and are left out.
    A text of any length counts by its hash and its length.  A conversation travels as 20 bytes per
    turn in one row.  An empty table gives no rows.
    """
    return prefix_trie(rebuilt(stored(sequences(turns), "turns"), group, shared_turns), shard_bytes)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: Paths as lists of numbered turns; a node's subtree by joining every path with all its beginnings; for small tables.
#: crc32 is worked out bit by bit over the digits.
ORACLE = r"""
with recursive c as (select i, i as x, 0 as k from range(256) r(i)
  union all select i, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k + 1 from c where k < 8),
tab as (select list(x order by i) as tab from c where k = 8),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
code as (select role, text, row_number() over (order by role, text) as code, strlen(text) as n from (select distinct role, text from t)),
o as (select conv_id, list(code order by turn nulls first, sha256(strlen(t.role) || ':' || t.role || ':' || t.text)) as codes
      from t join code using (role, text) group by conv_id),
h as (select conv_id, codes, cast(xor(list_reduce(list_concat([4294967295::bigint], list_transform(split(cast(conv_id as varchar), ''), lambda d: cast(ascii(d) as bigint))),
        lambda x, y: xor(x >> 8, tab[cast(xor(x & 255, y) + 1 as bigint)])), 4294967295::bigint) % 9 as bigint) as h from o, tab),
r as (select h.conv_id, list_concat(coalesce(l.codes[1:h.h], []), h.codes[h.h + 1:]) as codes
      from h left join o l on l.conv_id = h.conv_id - h.conv_id % 5),
p as (select codes[1:d] as path, d as depth, conv_id, d = len(codes) as at_end from (select codes, conv_id, unnest(range(0, len(codes) + 1)) as d from r)),
n as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs,
             sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (at_end), '')) as ends_sha256 from p group by path, depth),
q as (select n.*, case when depth > 0 then path[1:depth - 1] end as up, coalesce((n_convs - 1) * code.n, 0) as saved
      from n left join code on code.code = n.path[n.depth]),
k as (select up as path, count(*) as n_children from q where up is not null group by up),
s as (select path[1:d] as path, sum(saved) as saved_tokens, count(*) filter (n_children is null) as n_leaves
      from (select q.path, q.saved, k.n_children, unnest(range(0, q.depth + 1)) as d from q left join k using (path)) group by 1)
select q.conv_id, cast(q.depth as bigint) as depth, u.conv_id as parent_conv_id, cast(q.n_convs as bigint) as n_convs,
       cast(coalesce(k.n_children, 0) as bigint) as n_children, cast(s.n_leaves as bigint) as n_leaves,
       cast(s.saved_tokens as bigint) as saved_tokens, q.ends_sha256
from q join s using (path) left join k using (path) left join n u on u.path = q.up
"""
