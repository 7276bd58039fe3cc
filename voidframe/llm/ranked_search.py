"""Ranked lexical search over bit-sliced Bloom signatures.

`build` cuts documents into blocks of up to ROWS rows of like size. A document's signature has a bit for each hash of (term, level): level j says that
the term occurs at least LEVELS[j] times. The block keeps the signatures bit-sliced, a bitmap over its rows for each bit, and beside them the counted
terms of its documents for exact scores. BITS bits an entry keep false entries near one in two hundred, for short and long documents alike; above 2^20
bits a signature only gets fuller, which loosens a bound and loses nothing.

`search` takes items in groups of bounded size. The slices of a term's hashes, cut with each other, overestimate the rows that hold it; summed with the
terms' weights, and with what a level can add to a score at most, they give an upper bound for every (item, document). A first pass scores the most
promising rows of each block exactly; the k-th best of these is a floor under the k-th best score. A second pass scores exactly every document whose bound
is not below the floor, so none is excluded without proof. Each task hands on its k best rows an item at most.

Terms are the maximal runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased; they are compared by a 64-bit tabulation hash of
all their bytes. Weights and scores are whole numbers as in `digest`'s contract: w = floor(1000 ln((2N + 2) / (2 df + 1))), a document of n terms has
m = 50 + (50 n N) div L, and a term adds w ((10^9 tf) div (1000 tf + 20 m)).

Odd rows: a null text has no terms, and a document without terms is no document here; a null doc_id is kept and comes first among equal scores;
repeated doc_ids are separate rows. Items without terms, or without a hit, give no rows; equal items give rows each. Empty tables give no rows. A text
of any length is read whole, in stretches of bounded size. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, task, written

ROWS, BITS, HASHES, MOST_BITS = 256, 16, 4, 20
#: Fixed values of the contract.
TOP, SCALE = 50, 1_000_000_000
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512, 2048, 1 << 40], dtype=np.int64)
#: Items handled at once, and bytes of their terms.
ITEMS, ITEM_BYTES = 256, 1 << 18

_INDEX = "bits int, rows int, total long, doc_id array<long>, n array<long>, ends binary, terms binary, counts binary, slices binary"
_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _WORD[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TABLE = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 64, (64, 256), dtype=np.uint64)
_TABLE = _TABLE[:, _LOWER].ravel()  # letters of either case have one value
_ODD, _MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)
_STRETCH = 1 << 18


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _bytes_hash(data: np.ndarray, at: np.ndarray, pos: np.ndarray) -> np.ndarray:
    h = _TABLE[((pos & 63) << 8) + data[at]]
    return h * np.power(_ODD, (pos >> 6).astype(np.uint64)) if len(pos) and pos.max() > 63 else h


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each token, case folded; tokens are read in stretches, and one longer than a stretch piece by piece."""
    out, size = np.zeros(len(starts), dtype=np.uint64), ends - starts
    huge = np.flatnonzero(size > _STRETCH)
    for t in huge:
        for a in range(int(starts[t]), int(ends[t]), _STRETCH):
            at = np.arange(a, min(a + _STRETCH, int(ends[t])))
            out[t : t + 1] += _bytes_hash(data, at, at - starts[t]).sum(dtype=np.uint64)
    rest = np.flatnonzero(size <= _STRETCH)
    groups = np.cumsum(size[rest]) // _STRETCH
    for own in np.split(rest, np.flatnonzero(np.diff(groups)) + 1):
        if len(own):
            first = np.cumsum(size[own]) - size[own]
            pos = np.arange(int(size[own].sum())) - np.repeat(first, size[own])
            out[own] = np.add.reduceat(_bytes_hash(data, np.repeat(starts[own], size[own]) + pos, pos), first)
    return _mixed(out)


def counted_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each distinct term of each text, by row and term, and the terms of each text with repeats."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    word = np.zeros(len(data) + 1, dtype=bool)
    word[:-1] = _WORD[data]
    joint = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
    joint[bounds[:-1]] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | joint))
    ends = np.flatnonzero(before & (~word | joint))
    row = np.searchsorted(bounds, starts, side="right") - 1
    term = token_hashes(data, starts, ends)
    order = np.argsort(term)
    order = order[np.argsort(row[order].astype(np.uint32), kind="stable")]
    row, term = row[order], term[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.zeros(0, dtype=np.int64)
    return row[new], term[new], np.diff(np.append(new, len(row))), np.bincount(row, minlength=len(texts))


def _places(term: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """The HASHES bits of each (term, level) in a signature of 2^bits."""
    h = _mixed(term + (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)) * _STEP)
    step = (h >> np.uint64(32)) | np.uint64(1)
    i = np.arange(HASHES, dtype=np.uint64)
    return ((h[..., None] + i * step[..., None]) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _block(bits: int, docs: list[tuple]) -> dict:
    """docs: (doc_id, n, terms, counts)."""
    size = np.array([len(d[2]) for d in docs])
    term, count = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
    levels = np.searchsorted(LEVELS, count, side="right")
    first = np.cumsum(levels) - levels
    level = np.arange(int(levels.sum())) - np.repeat(first, levels)
    row = np.repeat(np.repeat(np.arange(len(docs)), size), levels)
    plane = np.zeros((1 << bits, len(docs)), dtype=bool)
    plane[_places(np.repeat(term, levels), level, bits), row[:, None]] = True
    return {
        "bits": bits, "rows": len(docs), "total": int(sum(d[1] for d in docs)), "doc_id": [d[0] for d in docs], "n": [int(d[1]) for d in docs], "ends": np.cumsum(size).astype(np.int64).tobytes(),
        "terms": term.tobytes(), "counts": count.astype(np.uint32).tobytes(), "slices": np.packbits(plane, axis=1, bitorder="little").tobytes(),
    }


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _INDEX.split(", ")]))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for part in portions(batch, 1, 2 << 20):
            row, term, count, n = counted_terms(part.column(1))
            ids, cut = part.column(0).to_pylist(), np.searchsorted(row, np.arange(len(n) + 1))
            entries = np.add.reduceat(np.append(np.searchsorted(LEVELS, count, side="right"), 0), cut[:-1]) if len(n) else []
            for i in np.flatnonzero(n):
                bits = min(MOST_BITS, max(8, int(BITS * entries[i] * 2 // 3).bit_length()))
                docs = held.setdefault(bits, [])
                docs.append((ids[i], n[i], term[cut[i] : cut[i + 1]].copy(), count[cut[i] : cut[i + 1]].astype(np.uint32)))
                if len(docs) >= min(ROWS, max(8, (1 << 22) >> bits)):
                    yield _arrow([_block(bits, held.pop(bits))])
        del batch, part  # the next batch comes before this one would go
        pa.default_memory_pool().release_unused()
    for bits, docs in held.items():
        yield _arrow([_block(bits, docs)])


def build(docs: DataFrame) -> DataFrame:
    """The index of all documents, written in the shared folder: one row a block."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(own.mapInArrow(task(_index), _INDEX), "search-index")


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, term, _, _ = counted_terms(batch.column(2))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        own = [term[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["row", "item_id", "terms"])


class Queries:
    """A group of items: their terms, and how they lie in one flat list."""

    def __init__(self, rows: list):
        self.rows = rows
        own = [np.frombuffer(r.terms, dtype=np.uint64) for r in rows]
        self.terms = np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.uint64)
        self.flat = np.concatenate([np.searchsorted(self.terms, t) for t in own]) if own else np.zeros(0, dtype=np.int64)
        self.size = np.array([len(t) for t in own], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size

    def weigh(self, found: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in found], dtype=np.int64)


def _lookup(q: Queries, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where the block's terms are terms of the items: (number among the items' terms, place in the block)."""
    term = np.frombuffer(row["terms"], dtype=np.uint64)
    at = np.minimum(np.searchsorted(q.terms, term), len(q.terms) - 1)
    hit = np.flatnonzero(q.terms[at] == term)
    return at[hit], hit


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 20 * m)


def _bounds(q: Queries, row: dict, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """items x rows: no score of the block exceeds its bound. most: the greatest count of a term in each row."""
    bits, width = row["bits"], -(-row["rows"] // 8)
    slices = np.frombuffer(row["slices"], dtype=np.uint8).reshape(1 << bits, width)
    wide = np.int64 if np.add.reduceat(q.weight[q.flat], q.first).max(initial=0) >= 1 << 31 else np.int32
    bound = np.zeros((len(q.rows), row["rows"]), dtype=np.int64)
    alive, below, held = np.arange(len(q.terms)), np.zeros(row["rows"], dtype=np.int64), None
    for level in range(len(LEVELS) - 1):
        place = _places(q.terms[alive], level, bits)
        bitmap = slices[place[:, 0]]
        for i in range(1, HASHES):
            bitmap = bitmap & slices[place[:, i]]
        bitmap = bitmap if held is None else bitmap & held
        some = bitmap.any(axis=1)
        alive, held = alive[some], bitmap[some]
        if not len(alive):
            break
        top = _gain(np.minimum(LEVELS[level + 1] - 1, most), m)
        number = np.full(len(q.terms), -1)
        number[alive] = np.arange(len(alive))
        use = number[q.flat]
        kept = np.flatnonzero(use >= 0)
        item = np.repeat(np.arange(len(q.rows)), q.size)[kept]
        start = np.flatnonzero(np.diff(item, prepend=-1))
        weighed = np.unpackbits(held, axis=1, count=row["rows"], bitorder="little").astype(wide) * q.weight[alive].astype(wide)[:, None]
        bound[item[start]] += np.add.reduceat(weighed[use[kept]], start, axis=0, dtype=wide).astype(np.int64) * np.maximum(top - below, 0)
        below = np.maximum(below, top)
    return bound


class _Block:
    """A block of the index before a group of items."""

    def __init__(self, q: Queries, row: dict):
        self.q, self.rows = q, row["rows"]
        count, ends = np.frombuffer(row["counts"], dtype=np.uint32).astype(np.int64), np.frombuffer(row["ends"], dtype=np.int64)
        self.m = 50 + (50 * np.array(row["n"], dtype=np.int64) * q.n_docs) // q.n_terms
        self.bound = _bounds(q, row, self.m, np.maximum.reduceat(count, np.append(0, ends[:-1])))
        at, hit = _lookup(q, row)
        doc = np.searchsorted(ends, hit, side="right")
        self.adds = np.zeros((len(q.terms), self.rows), dtype=np.int64)
        self.adds[at, doc] = q.weight[at] * _gain(count[hit], self.m[doc])

    def scores(self, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Exact scores of pairs, in stretches."""
        out, size = np.zeros(len(item), dtype=np.int64), self.q.size[item]
        for own in np.split(np.arange(len(item)), np.flatnonzero(np.diff(np.cumsum(size) // (1 << 20))) + 1):
            if len(own):
                first = np.cumsum(size[own]) - size[own]
                flat = np.arange(int(size[own].sum())) - np.repeat(first - self.q.first[item[own]], size[own])
                out[own] = np.add.reduceat(self.adds[self.q.flat[flat], np.repeat(doc[own], size[own])], first)
        return out


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """Of rows (item, score, has an id, doc_id), each item's k best."""
    all_of = np.concatenate(found)
    all_of = all_of[np.lexsort((all_of[:, 3], all_of[:, 2], -all_of[:, 1], all_of[:, 0]))]
    first = np.flatnonzero(np.diff(all_of[:, 0], prepend=-1))
    rank = np.arange(len(all_of)) - np.repeat(first, np.diff(np.append(first, len(all_of))))
    return all_of[rank < k]


def _pass(q: Queries, keep: int, seeds: int, floors: np.ndarray | None):
    """The task of a pass over blocks. Without floors, the `seeds` rows of each block with the highest bounds are scored; with them, all rows with a
    bound that reaches its item's floor. The task hands on its `keep` best rows an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, found, n = np.zeros((0, 4), dtype=np.int64), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                block = _Block(q, row)
                if floors is None:
                    most = min(seeds, block.rows)
                    doc = np.argpartition(-block.bound, most - 1, axis=1)[:, :most]
                    item, doc = np.repeat(np.arange(len(q.rows)), most), doc.ravel()
                else:
                    item, doc = np.nonzero(block.bound >= np.maximum(floors, 1)[:, None])
                score = block.scores(item, doc)
                good = score >= (1 if floors is None else np.maximum(floors, 1)[item])
                ids = row["doc_id"]
                has = np.array([x is not None for x in ids])[doc[good]]
                value = np.array([0 if x is None else x for x in ids], dtype=np.int64)[doc[good]]
                found.append(np.stack([item[good], score[good], has, value], axis=1))
                n += len(found[-1])
                if n > 1 << 17:
                    best, found, n = _best([best, *found], keep), [], 0
                del row, block
            del batch
            pa.default_memory_pool().release_unused()
        best = _best([best, *found], keep)
        if len(best):
            ids = pa.array(best[:, 3], mask=best[:, 2] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(best[:, 0]), ids, pa.array(best[:, 1])], names=["item", "doc_id", "score"])

    return run


def _frequencies(q: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(q.terms), dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                df += np.bincount(_lookup(q, {"terms": x.as_py()})[0], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "df"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents. items: item_id, text, in any number: groups of ITEMS follow each other, each with two
    passes over the index."""
    spark = index.sparkSession
    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = written(asked.mapInArrow(task(_terms_of), "row long, item_id long, terms binary").where("octet_length(terms) > 0"), "search-items")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("terms")), F.lit(0)).alias("b")).first()
    whole = index.select("rows", "total", F.spark_partition_id().alias("task")).agg(F.sum("rows").cast("long").alias("n"), F.sum("total").alias("l"), F.count(F.lit(1)).alias("blocks"), F.approx_count_distinct("task").alias("tasks")).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    groups = max(-(-size.n // ITEMS), -(-size.b // ITEM_BYTES)) if whole.n else 0
    some = lambda of: max(1, -(-4 * k // max(1, of)))  # noqa: E731  how many of each make a few times k
    for g in range(groups):
        q = Queries(asked.where(F.pmod("row", F.lit(groups)) == g).orderBy("row").collect())  # a bounded group
        if not q.rows:
            continue
        df = np.zeros(len(q.terms), dtype=np.int64)
        for r in index.select("terms").mapInArrow(task(_frequencies(q)), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():  # the group's terms
            df[r["at"]] = r["df"]
        q.weigh(df, whole.n, whole.l)
        seeds = index.drop("total").mapInArrow(task(_pass(q, some(whole.tasks), some(whole.blocks), None)), "item long, doc_id long, score long")
        floors = np.zeros(len(q.rows), dtype=np.int64)
        for r in _ranked(seeds, k).where(F.col("rank") == k).select("item", "score").collect():  # one row an item of the group
            floors[r["item"]] = r["score"]
        best = _ranked(index.drop("total").mapInArrow(task(_pass(q, k, 0, floors)), "item long, doc_id long, score long"), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(q.rows)], "item long, item_id long")
        found = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as many names as a group has items
        out = out.unionByName(found if groups == 1 else written(found, "search-found"))
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    return search(build(docs), benchmark)


SQL = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents where text is not null
), t as (
  select r, doc_id, len(w) as n, unnest(w) as term from d
), tf as (
  select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from t group by r, term
), whole as (
  select count(*) as n_docs, sum(len(w)) as n_terms from d where len(w) > 0
), q as (
  select distinct item_id, i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as i from benchmark where text is not null)
), df as (
  select term, count(*) as df from tf where term in (select term from q) group by term
), s as (
  select q.i, any_value(q.item_id) as item_id, tf.r, any_value(tf.doc_id) as doc_id,
    sum(cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df.df + 1))) as bigint) * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * n_docs) // n_terms)))) as score
  from q join tf on tf.term = q.term join df on df.term = q.term cross join whole group by q.i, tf.r
), ranked as (
  select *, row_number() over (partition by i order by score desc, doc_id nulls first) as rank from s where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from ranked where rank <= 50
"""
