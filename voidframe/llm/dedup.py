"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct shingles of `words` words. The signature has SLOTS minima of independent hashes, 16 bits of each, and
FINE further ones of 4 bits. Two documents are candidates if at most MOST of the SLOTS differ. To find all of these without comparing all,
the slots are split into CHUNKS chunks: among MOST errors some chunk has at most one (pigeonhole, CHUNKS * 2 > MOST), so every way to
leave one slot of a chunk out is a key, and a candidate pair shares a key. A candidate pair that differs in more than MOST_ALL of all
slots is dropped; the others are confirmed on the full sets.

Equal sets are folded first. Large buckets are not expanded into pairs: in a first round every member meets only the least member
of its bucket; components of the confirmed links follow; then only members of different components that still share a bucket are
compared, inside the bucket's task, each pair in one bucket only. Members that no signature speaks for drop out; the others' full sets
join them, pairs are taken by rising signature distance, those that links have joined by then are passed over, the rest are confirmed,
and only links that join components leave the task, fewer than it has members. So no link that could join two components is lost.
A large bucket is cut into blocks that meet two by two; blocks of its largest component do not meet each other. Where more than FEW_BLOCKS
blocks would have to meet all others, the bucket's members meet by rare shingles instead: sets of similarity 0.8 share one of the rarest
fifth (and one) of the shingles of either, in any order of rarity that all follow, so a group for each shingle that stands there loses no link,
and members that only have frequent shingles in common do not meet.

A pair of similarity 0.8 is missed with a probability below 1e-4 (that more than MOST of SLOTS, or MOST_ALL of all slots differ).

Null or empty text has an empty set and is linked with nothing, whatever else has its doc_id. A null doc_id is kept and linked with
nothing. Rows that share a doc_id count as one node. Very long texts are read whole. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from .common import portions, task, text_of, written

SLOTS, CHUNKS, MOST = 64, 14, 27
#: Blocks of members outside a bucket's largest component, above which they meet by rare shingles.
FEW_BLOCKS = 4
FINE, MOST_ALL = 192, 77
_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 63, SLOTS + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, SLOTS + FINE, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. A-Z are lower-cased; words are cut at ASCII white space."""
    own = text.encode("utf-8", "replace").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    n = min(words, len(own))
    out = np.full(len(own) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SLOTS 16-bit values, four to a long, and FINE 4-bit values, sixteen to a long; found must not be empty."""
    low = np.full(SLOTS + FINE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        low = np.minimum(low, (found[i : i + 512, None] * _MULTIPLIERS + _OFFSETS).min(axis=0))
    mixed = (low ^ (low >> np.uint64(31))) * _MIX
    fine = (mixed[SLOTS:] >> np.uint64(60)).astype(np.uint8)
    return (mixed[:SLOTS] >> np.uint64(48)).astype("<u2").view("<i8"), (fine[::2] | fine[1::2] << 4).view("<i8")


def sketches(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, n (set size), h1, h2 (hash of the set), sig and fine (the signature; null for an empty set)."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", longs), ("fine", longs)])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
                sig, fine = signature(found) if len(found) else (None, None)
                rows.append((len(found), int(both[0]), int(both[1]), sig, fine))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("_text")).mapInArrow(task(sketch), "doc_id long, n long, h1 long, h2 long, sig array<long>, fine array<long>")


_PARTS = np.array_split(np.arange(SLOTS), CHUNKS)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """rows x keys: hashes of every chunk with every one of its slots left out."""
    out = []
    for c, own in enumerate(_PARTS):
        for left in own:
            h = np.full(len(sig), c * SLOTS + int(left) + 1, np.uint64)
            for s in own[own != left]:
                h = (h ^ sig[:, s].astype(np.uint64)) * _MIX
                h ^= h >> np.uint64(32)
            out.append(h)
    return np.stack(out, axis=1)


def keyed(reps: DataFrame) -> DataFrame:
    """(key, slot, rep) for each key of each signature; slot is the one left out."""
    slots = np.concatenate(_PARTS).astype(np.int8)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                keys = chunk_keys(np.ascontiguousarray(flat, "<i8").view("<u2").reshape(-1, SLOTS))
                rep = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(slots, len(keys))), pa.array(rep)], names=["key", "slot", "rep"])

    return reps.select("rep", "sig").mapInArrow(task(spread), "key long, slot byte, rep long")


def _slots(column: pa.ListArray, kind: str, width: int) -> np.ndarray:
    """rows x slots of a column of equally long lists of longs."""
    flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), "<i8")
    return flat.view(kind).reshape(len(column), width)


def _fine_slots(column: pa.ListArray) -> np.ndarray:
    both = _slots(column, np.uint8, FINE // 2)
    return np.concatenate([both & 15, both >> 4], axis=1)


_STARTS = np.array([p[0] for p in _PARTS])


def near(i: np.ndarray, j: np.ndarray, n: np.ndarray, sig: np.ndarray, fine: np.ndarray, at_least: int, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows (i, j), the places of those whose sizes and signatures allow a link, and how many slots differ; with slot, only of
    those for which this bucket stands first: of the first chunk with at most one error, the one that leaves out the error (or the chunk's
    first slot). A slot below 0 is no bucket's, and takes every pair."""
    places, apart = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(i), 20_000):
        a, b = i[at : at + 20_000], j[at : at + 20_000]
        fits = np.flatnonzero(np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * at_least)
        differs = sig[a[fits]] != sig[b[fits]]
        d = differs.sum(axis=1)
        good = np.flatnonzero(d <= MOST)
        fits, differs, d = fits[good], differs[good], d[good]
        d = d + (fine[a[fits]] != fine[b[fits]]).sum(axis=1)
        good = np.flatnonzero(d <= MOST_ALL)
        fits, differs, d = fits[good], differs[good], d[good]
        if slot is not None and len(fits):
            errors = np.add.reduceat(differs, _STARTS, axis=1, dtype=np.int64)
            first = (errors <= 1).argmax(axis=1)
            inside = np.arange(SLOTS) >= _STARTS[first][:, None]
            inside &= np.arange(SLOTS) < np.r_[_STARTS[1:], SLOTS][first][:, None]
            hit = differs & inside
            good = (np.where(hit.any(axis=1), hit.argmax(axis=1), _STARTS[first]) == slot[a[fits]]) | (slot[a[fits]] < 0)
            fits, d = fits[good], d[good]
        places.append(at + fits)
        apart.append(d)
    return np.concatenate(places), np.concatenate(apart)


def near_pairs(pairs: DataFrame, reps: DataFrame, at_least: int) -> DataFrame:
    """Of (a, b), those whose sizes and signatures allow a link."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                n = np.concatenate([batch.column(k).to_numpy() for k in (2, 3)])
                sig = np.concatenate([_slots(batch.column(k), "<u2", SLOTS) for k in (4, 5)])
                fine = np.concatenate([_fine_slots(batch.column(k)) for k in (6, 7)])
                keep, _ = near(np.arange(m), np.arange(m) + m, n, sig, fine, at_least)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).take(pa.array(keep))

    side = lambda s: reps.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "sig", "fine")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "n_b", "sig_a", "sig_b", "fine_a", "fine_b").mapInArrow(task(judge), "a long, b long")


_GROUP = ("key", "lo", "hi")


def _weighed(members: DataFrame, usual: int = 512) -> DataFrame:
    """members with _w, what a set counts for in a block."""
    return members.withColumn("_w", F.greatest(F.lit(1), F.ceil(F.col("n") / usual)).cast("long"))


def mixed_buckets(members: DataFrame, block: int = 256) -> DataFrame:
    """Buckets with several comp: key, _main (the largest comp), how many blocks the others' members and its own members take (_few, _many). A
    block holds about `block` members, fewer if their sets are large."""
    by_comp = _weighed(members).groupBy("key", "comp").agg(F.sum("_w").alias("w"))
    mixed = by_comp.groupBy("key").agg(F.max(F.struct("w", "comp")).alias("_top"), F.sum("w").alias("_all")).where(F.col("_top.w") < F.col("_all"))
    blocks = lambda w: F.ceil(w / block).cast("int")
    return mixed.select("key", F.col("_top.comp").alias("_main"), blocks(F.col("_all") - F.col("_top.w")).alias("_few"), blocks(F.col("_top.w")).alias("_many"))


def in_blocks(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """members (key, slot, rep, comp, n, sig, fine) of the buckets `mixed`, in groups (key, lo, hi) of two blocks at most; own is a member's block.
    Members of a bucket's largest comp have blocks of their own, numbered behind the others', which meet only the others'."""
    own = members.join(mixed, "key").withColumn("_is_main", F.col("comp") == F.col("_main"))
    h = F.xxhash64(F.lit(5), "rep")
    own = own.withColumn("own", F.when(F.col("_is_main"), F.col("_few") + F.pmod(h, F.col("_many"))).otherwise(F.pmod(h, F.col("_few"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("_is_main"), F.col("_few")).otherwise(F.col("_few") + F.col("_many")) - 1)
    meets = F.transform(others, lambda o: F.struct(F.least(o, F.col("own")).alias("lo"), F.greatest(o, F.col("own")).alias("hi")))
    return own.withColumn("g", F.explode(meets)).select("key", "g.lo", "g.hi", "own", "slot", "rep", "comp", "n", "sig", "fine")


def rare_shingles(sets: DataFrame, at_least: int) -> DataFrame:
    """(key, rep): for each set (doc_id, n, set), those of its n - o + 1 rarest shingles that other sets hold too, o being the least number of
    shingles that it shares with any set it is linked with, ceil(at_least * n / 100). Two linked sets share such a key. Rarity is counted over
    the sets given, ties go by the shingle's hash."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(own.as_buffer(), "<i8")
                # rows that share a doc_id may hold several sets
                which = np.int64(xxhash.xxh64_intdigest(found.tobytes()) >> 1)
                for at in range(0, len(found), 1 << 16):
                    part = found[at : at + (1 << 16)]
                    same = [pa.array(np.full(len(part), v, np.int64)) for v in (rep, which, len(found))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(part)], names=["rep", "which", "n", "key"])

    each = written(sets.select("doc_id", "set").mapInArrow(task(spread), "rep long, which long, n long, key long"), "spread")
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("_often")).where("_often > 1")
    own = Window.partitionBy("rep", "which")
    # shingles of this set alone are the rarest and come first
    ranked = each.join(often, "key").select("key", "rep", "n", F.row_number().over(own.orderBy("_often", "key")).alias("_rank"), F.count(F.lit(1)).over(own).alias("_held"))
    return ranked.where(f"_rank <= _held - (n * {at_least} + 99) div 100 + 1").select("key", "rep").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by group."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        # the last group may go on in the next batch
        last = np.logical_and.reduce([c == c[-1] for c in (held.column(k).to_numpy() for k in _GROUP)])
        cut = held.num_rows - int(last.sum())
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()


def _near_in_groups(table: pa.Table, at_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, slots apart) of the rows of one group that differ in comp and may be linked, group after group."""
    col = lambda k: table.column(k).to_numpy()
    own, comp, lo, hi = col("own"), col("comp"), col("lo"), col("hi")
    edges = np.flatnonzero(np.r_[True, (np.diff(col("key")) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0), True])
    n, sig, fine = col("n"), _slots(table.column("sig").chunk(0), "<u2", SLOTS), _fine_slots(table.column("fine").chunk(0))
    slot, found, held, m = col("slot"), [np.zeros((3, 0), np.int64)], [], 0
    for start, end in zip(edges, edges[1:], strict=False):
        x, y = np.array([[start], [start + 1]]) if end - start == 2 else np.array(np.triu_indices(end - start, 1)) + start
        ok = comp[x] != comp[y]
        if lo[start] != hi[start]:
            ok &= own[x] != own[y]
        held.append((x[ok], y[ok]))
        m += len(held[-1][0])
        if m > 20_000 or end == edges[-1]:
            i, j = (np.concatenate(p) for p in zip(*held, strict=True))
            at, apart = near(i, j, n, sig, fine, at_least, slot)
            found.append(np.stack([i[at], j[at], apart]))
            held, m = [], 0
    return tuple(np.concatenate(found, axis=1))


def suspects(groups: DataFrame, at_least: int) -> DataFrame:
    """The rows of groups whose signature allows a link to another row of their group, of another comp."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            i, j, _ = _near_in_groups(table, at_least)
            yield from table.take(pa.array(np.unique(np.r_[i, j]))).to_batches()

    dealt = groups.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(task(judge), groups.schema)


class _Joined(dict):
    """Sets that are joined one by one: each name leads to its set's."""

    def __missing__(self, x: int) -> int:
        return x

    def find(self, x: int) -> int:
        while (up := self[x]) != x:
            self[x] = x = self[up]
        return x


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits per set, for the members that several sets hold."""
    value, number = np.unique(np.concatenate(sets), return_inverse=True)
    several = np.bincount(number, minlength=len(value)) > 1
    column = np.where(several, np.cumsum(several) - 1, -1)[number]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    width = -(-int(several.sum()) // 64)
    out = np.zeros((len(sets), width), np.uint64)
    np.bitwise_or.at(out, (row[column >= 0], column[column >= 0] >> 6), np.uint64(1) << (column[column >= 0] & 63).astype(np.uint64))
    return out


def joining(groups: DataFrame, at_least: int) -> DataFrame:
    """(a, b), a < b, confirmed on full sets, that join the comps of each group; groups has `set` too. A pair whose comps are joined already is
    passed over, so a group gives fewer links than it has members."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            i, j, apart = _near_in_groups(table, at_least)
            rep, comp, n = (table.column(k).to_numpy() for k in ("rep", "comp", "n"))
            group = np.cumsum(np.r_[False, np.logical_or.reduce([np.diff(table.column(k).to_numpy()) != 0 for k in _GROUP])])[i]
            a, b = [], []
            for g in np.split(np.arange(len(i)), np.flatnonzero(np.diff(group)) + 1):
                if not len(g):
                    continue
                g = g[np.argsort(apart[g], kind="stable")]
                rows, place = np.unique(np.r_[i[g], j[g]], return_inverse=True)
                bits = _shared([np.frombuffer(table.column("set")[int(r)].as_buffer(), "<u8") for r in rows])
                x, y = place[: len(g)], place[len(g) :]
                joined = _Joined()
                step = max(1, (1 << 20) // max(1, bits.shape[1]))
                at, much = 0, 64  # few pairs first: they join most
                while at < len(g):
                    part = np.arange(at, min(at + much, len(g)))
                    at, much = part[-1] + 1, min(step, much * 4)
                    part = np.array([k for k in part if joined.find(int(comp[rows[x[k]]])) != joined.find(int(comp[rows[y[k]]]))], np.int64)
                    both = np.bitwise_count(bits[x[part]] & bits[y[part]]).sum(axis=1, dtype=np.int64)
                    for k in part[100 * both >= at_least * (n[rows[x[part]]] + n[rows[y[part]]] - both)]:
                        p, q = joined.find(int(comp[rows[x[k]]])), joined.find(int(comp[rows[y[k]]]))
                        if p != q:
                            joined[max(p, q)] = min(p, q)
                            a.append(min(rep[rows[x[k]]], rep[rows[y[k]]]))
                            b.append(max(rep[rows[x[k]]], rep[rows[y[k]]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(task(judge), "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc_id, n and the set (sorted 64-bit hashes) of the documents wanted."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                packed = [shingles(t, words).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 8 for x in packed], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "set"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("_text")).join(wanted, "doc_id", "left_semi").mapInArrow(task(sets), "doc_id long, n long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, at_least: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets meet 100 * intersection >= at_least * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= at_least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(task(check), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, at_least: int = 80, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) of each document; block is about how many members meet at once."""
    all_docs = written(sketches(docs, words), "sketches")
    linkable = all_docs.where("n > 0 and doc_id is not null")
    reps = written(linkable.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("fine").alias("fine")), "classes")
    keys = written(keyed(reps), "keys")
    several = keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("last")).where("least < last")
    buckets = written(keys.join(several.select("key", "least"), "key"), "buckets")
    sets = written(shingle_sets(docs, buckets.select(F.col("rep").alias("doc_id")).distinct(), words), "sets")

    pairs = buckets.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(near_pairs(pairs, reps, at_least), sets, at_least)
    # a doc_id with rows in several classes ties these together
    repeated = linkable.groupBy("doc_id").agg(F.min("h1").alias("_lo"), F.max("h1").alias("_hi")).where("_lo < _hi").select("doc_id")
    same = linkable.join(repeated, "doc_id", "left_semi").join(reps.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).where("rep < doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = written(links.union(same), "links")
    comp = written(connected_components(links, "a", "b"), "components")

    # members of different components that share a bucket
    placed = buckets.select("key", "slot", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "slot", "rep", F.coalesce("component", "rep").alias("comp"))
    signed = reps.select("rep", "n", "sig", "fine")
    members = placed.join(signed, "rep")
    mixed = written(mixed_buckets(members, block), "mixed")
    groups = in_blocks(members, mixed.where(F.col("_few") <= FEW_BLOCKS))
    crowded = mixed.where(F.col("_few") > FEW_BLOCKS)
    if not crowded.isEmpty():
        crowd = written(placed.join(crowded.select("key"), "key", "left_semi").select("rep", "comp").distinct(), "crowd")
        rare = written(rare_shingles(sets.join(crowd.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), at_least), "rare")
        by_shingle = rare.join(crowd, "rep").join(signed, "rep").select("key", F.lit(-1).cast("byte").alias("slot"), "rep", "comp", "n", "sig", "fine")
        groups = groups.union(in_blocks(by_shingle, mixed_buckets(by_shingle, block)))
    held = written(suspects(groups, at_least), "suspects")
    more = written(joining(held.join(sets.select(F.col("doc_id").alias("rep"), "n", "set"), ["rep", "n"]), at_least), "joining")
    if not more.isEmpty():
        comp = written(connected_components(links.union(more), "a", "b"), "components")
    named = reps.select("n", "h1", "h2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("_comp"))
    out = linkable.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"]).select("doc_id", "n", "_comp")
    alone = all_docs.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("_comp"))
    return out.union(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("_comp").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
