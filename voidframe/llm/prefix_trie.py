"""Conversation prefix trie by vertical bitmaps.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. Conversations are dealt into shards of SHARD
neighbours in the order of conv_id, and a shard into bands of BAND turns, so a tile holds at most SHARD * BAND turns whatever one conversation or one
first turn holds. A tile indexes (position, turn) to the bitset of its conversations. Depth first, a node's bitset, cut with the posting of the turn
that its least remaining member says next, is a child; the popcount counts members, and the cut with the bitset of conversations that end there lists
the ends. What tiles found for one node is added up by a merge over rows sorted by node and shard: a node has one row a shard, however many members.

Where a band begins, members that share a parent are known by the parent's key: two 64-bit exclusive-ors of hashes of (position, turn) over the
prefix, with the depth; turns are compared by MD5 of role and text. Sums over subtrees need no walk: every node charges its own figure to its least
member at its depth, and what a node's subtree holds is what its members are charged at its depth or deeper, a running total from the conversation's
end (`plans.order.running`).

Order and odd rows: turns go by `turn`, null first, then role, then MD5 of the text; equal rows stay as often as they occur. A null role or text is
empty. Rows without conv_id are left out. A text counts with all its code points. Without conversations there are no nodes, not even the root. Other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import in_parts, ranked, running
from .common import written

SHARD, BAND = 512, 128

_LOCAL = "depth long, ka long, kb long, pa long, pb long, chars long, n long, conv_id long, shard long, ends string"
_NODE = "depth long, ka long, kb long, pa long, pb long, chars long, n long, conv_id long, ends_sha256 string"
_KEY = ["depth", "ka", "kb"]


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _bits(where: np.ndarray) -> int:
    """A bitset with the given bits."""
    if len(where) < 4:
        return sum(1 << int(b) for b in where)
    full = np.zeros(int(where.max()) + 1, dtype=bool)
    full[where] = True
    return int.from_bytes(np.packbits(full, bitorder="little").tobytes(), "little")


def _each(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def tile(table: pa.Table) -> pa.Table:
    """The nodes of one tile: their keys, members, least member and ends."""
    turn = pc.dictionary_encode(table["tid"].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    col = {c: table[c].to_numpy() for c in ("bit", "pos", "conv_id", "pa", "pb")}
    bit, rel, end = col["bit"], col["pos"] - col["pos"].min(), table["end"].to_numpy().astype(bool)
    said = np.full((int(rel.max()) + 1, int(bit.max()) + 1), -1, dtype=np.int64)
    said[rel, bit] = np.arange(len(rel))
    order = np.lexsort((bit, turn, rel))
    cuts = np.flatnonzero(np.diff(rel[order]) | np.diff(turn[order])) + 1
    posting = {(int(rel[g[0]]), int(turn[g[0]])): _bits(bit[g]) for g in np.split(order, cuts)}
    speak = [_bits(np.flatnonzero(row >= 0)) for row in said]
    ended = [_bits(bit[row[row >= 0]][end[row[row >= 0]]]) for row in said]
    first = said[0][said[0] >= 0]
    entries: dict[tuple[int, int], int] = {}
    for i in first:
        at = (int(col["pa"][i]), int(col["pb"][i]))
        entries[at] = entries.get(at, 0) | 1 << int(bit[i])
    stack, rows, n, ends = [(members, 0) for members in entries.values()], [], [], []
    while stack:
        members, d = stack.pop()
        rest = members & speak[d]
        while rest:
            i = int(said[d, (rest & -rest).bit_length() - 1])
            child = rest & posting[d, int(turn[i])]
            rest ^= child
            rows.append(i)
            n.append(child.bit_count())
            ends.append(",".join(str(col["conv_id"][said[d, b]]) for b in _each(child & ended[d])))
            if d + 1 < len(speak):
                stack.append((child, d + 1))
    of = table.take(pa.array(rows, pa.int64()))
    return pa.table({"depth": pc.add(of["pos"], 1), **{c: of[c] for c in ("ka", "kb", "pa", "pb", "chars")}, "n": pa.array(n, pa.int64()), "conv_id": of["conv_id"], "shard": of["shard"], "ends": pa.array(ends, pa.string())})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a node from rows sorted by node and shard. Shards are ranges of conv_id, so their lists of ends follow each other."""
    open_key, node, digest, filled = None, None, None, False
    names = _NODE.replace(" long", "").replace(" string", "").split(", ")
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            key = (r["depth"], r["ka"], r["kb"])
            if key != open_key:
                if node:
                    out.append(node | {"ends_sha256": digest.hexdigest()})
                open_key, node, digest, filled = key, {k: r[k] for k in names[:-1]}, hashlib.sha256(), False
            else:
                node["n"] += r["n"]
                node["conv_id"] = min(node["conv_id"], r["conv_id"])
            if r["ends"]:
                digest.update((("," if filled else "") + r["ends"]).encode())
                filled = True
        if out:
            yield _rows(out)
    if node:
        yield _rows([node | {"ends_sha256": digest.hexdigest()}])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _NODE.split(", ")])
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (0, 1, ... in the conversation's order), tid (what was said, by whom) and chars of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("_tie"), F.monotonically_increasing_id().alias("_id"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("tid"), F.length(text).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("_tie"), F.col("_id")]
    return running(in_parts(own, "conv_id", *order), ["conv_id"], order, {"at": ("sum", _long(1))}).select("conv_id", "at", "tid", "chars")


def rebuilt(own: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after every conversation's first h turns were replaced by those of the first of its hundred, h = crc32(conv_id) % most:
    (conv_id, pos, tid, chars) and (conv_id, total). own: as from ordered_turns."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = own.where(F.col("conv_id") % group == 0).where(F.col("at") < most - 1).groupBy(F.col("conv_id").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("at", "tid", "chars"))).alias("head"))
    each = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "_base": base}).join(heads, "_base", "left")
    each = each.withColumn("head", F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h").cast("int"))))
    convs = each.select("conv_id", "head", F.coalesce(F.size("head").cast("long"), _long(0)).alias("lent"), "h", "n").withColumn("lent", F.greatest("lent", _long(0)))
    convs = convs.withColumn("total", F.col("lent") + F.greatest(F.col("n") - F.col("h"), _long(0)))
    convs = written(convs, "trie-conversations")
    lent = convs.select("conv_id", F.inline("head")).select("conv_id", F.col("at").alias("pos"), "tid", "chars")
    kept = own.join(convs.select("conv_id", "h", "lent"), "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("pos"), "tid", "chars")
    return lent.unionByName(kept), convs.select("conv_id", "total")


def trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """The nodes of all conversations, the root included. turns: conv_id, pos (gapless from 0), tid, chars; convs: conv_id (unique), total turns, which
    may be 0."""
    placed = ranked(convs, [], ["conv_id"]).select("conv_id", "total", F.floor(F.col("at") / shard).alias("shard"), (F.col("at") % shard).alias("bit"))
    placed = written(placed, "trie-shards")
    own = [F.xxhash64(F.lit(seed), "pos", "tid") for seed in (17, 71)]
    rows = turns.join(placed, "conv_id").withColumns({"part": F.floor(F.col("pos") / band), "end": F.col("pos") == F.col("total") - 1})
    rows = running(rows, ["conv_id"], ["pos"], {"pa": ("xor", own[0]), "pb": ("xor", own[1])})
    rows = written(rows.withColumns({"ka": F.col("pa").bitwiseXOR(own[0]), "kb": F.col("pb").bitwiseXOR(own[1])}).drop("total"), "trie-turns")

    root = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.when(F.col("total") == 0, F.col("conv_id")))).alias("ends"))
    zero, null = _long(0), F.lit(None).cast("long")
    root = root.select(*[zero.alias(c) for c in _KEY], null.alias("pa"), null.alias("pb"), zero.alias("chars"), "n", "conv_id", "shard", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ends"))
    found = rows.groupBy("shard", "part").applyInArrow(tile, _LOCAL).unionByName(root)
    nodes = written(found.repartition(*_KEY).sortWithinPartitions(*_KEY, "shard").mapInArrow(_merge, _NODE), "trie-nodes")

    up = F.col("depth") - 1
    children = nodes.where("depth > 0").groupBy(up.alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    full = written(full, "trie-counted")

    charge = full.where("depth > 0").select("conv_id", up.alias("pos"), ((F.col("n") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    both = charge.select("conv_id", "pos", "saved", "leaf", F.lit(0).alias("asks"), null.alias("ka"), null.alias("kb")).unionByName(rows.select("conv_id", "pos", zero.alias("saved"), zero.alias("leaf"), F.lit(1).alias("asks"), "ka", "kb"))
    both = both.withColumn("part", -F.floor(F.col("pos") / band))
    below = running(both, ["conv_id"], [F.col("pos").desc(), "asks"], {"s": ("sum", F.col("saved")), "l": ("sum", F.col("leaf"))}).where("asks = 1")
    sums = below.groupBy((F.col("pos") + 1).alias("depth"), "ka", "kb").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    all_of = charge.agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l")).select(*[zero.alias(c) for c in _KEY], "s", "l")
    out = full.join(sums.unionByName(all_of), _KEY).join(parents, ["depth", "pa", "pb"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.greatest(F.coalesce("l", zero), _long(1)).alias("n_leaves"), F.coalesce("s", zero).alias("saved_tokens"), "ends_sha256",
    )


def digest(conversations: DataFrame) -> DataFrame:
    """The query's columns: the trie of the rebuilt conversations."""
    return trie(*rebuilt(written(ordered_turns(conversations), "trie-order")))


SQL = """
with o as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as k,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as tid, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null
), c as (
  select conv_id, n, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 as h
  from (select conv_id, count(*) as n from o group by 1)
), lent as (
  select c.conv_id, count(o.k) as lent from c left join o on o.conv_id = c.base and o.k < c.h group by 1
), r as (
  select c.conv_id, o.k as pos, o.tid, o.chars from c join o on o.conv_id = c.base and o.k < c.h
  union all
  select c.conv_id, o.k - c.h + l.lent, o.tid, o.chars from c join lent l on l.conv_id = c.conv_id join o on o.conv_id = c.conv_id and o.k >= c.h
), p as (
  select conv_id, pos + 1 as depth, chars, string_agg(tid, '') over (partition by conv_id order by pos) as path,
    count(*) over (partition by conv_id) as total from r
), m as (
  select conv_id, depth, chars, path, depth = total as ends from p
  union all
  select c.conv_id, 0, 0, '', not exists (select 1 from r where r.conv_id = c.conv_id) from c
), nodes as (
  select depth, path, min(conv_id) as conv_id, count(*) as n, min(chars) as chars,
    sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from m group by 1, 2
), kids as (
  select depth - 1 as depth, left(path, 32 * (depth - 1)) as path, count(*) as n_children from nodes where depth > 0 group by 1, 2
), full_nodes as (
  select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.depth = n.depth and k.path = n.path
)
select v.conv_id, v.depth, any_value(u2.conv_id) as parent_conv_id, v.n as n_convs, v.n_children,
  count(case when u.n_children = 0 then 1 end) as n_leaves, cast(sum((u.n - 1) * u.chars) as bigint) as saved_tokens, v.ends_sha256
from full_nodes v join full_nodes u on starts_with(u.path, v.path)
  left join full_nodes u2 on v.depth > 0 and u2.depth = v.depth - 1 and u2.path = left(v.path, 32 * (v.depth - 1))
group by v.conv_id, v.depth, v.n, v.n_children, v.ends_sha256, v.path
"""
