"""Packing documents into sequences of at most `capacity` tokens by Karmarkar-Karp multiway differencing.

Every whole text becomes token ids, with one end id. A document gives full windows first; what remains is cut into near-equal
pieces of at most `piece` tokens. Pieces are dealt at random to groups of about `windows` sequences; in a group, a full window
is a sequence of its own and the rest are partitioned: each piece starts as a partial partition (its length in one window,
nothing in the others); the two partitions with the widest spread are merged, heavy windows of the one onto light windows of
the other, until one is left. Its windows are near-equal. If the heaviest exceeds the capacity, the group gets one more window
and starts again.

Null text counts as empty: such a document has its end id only. A null doc_id is kept. Repeated rows are documents of their
own, and copies may lie in different sequences; ties of length are settled by the order of the pieces. A very long text is encoded
whole, apart from others, and gives as many full windows as it fills. An empty table gives no sequences.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, kept, portions, task, text_of, written

CAPACITY, PIECE, END_ID = 2048, 512, 1
#: What is not among the characters on which the quick split agrees with the tokenizer's own: ASCII without its odd separators, Latin-1 letters and some marks.
_ODD = "[^\\x00-\\x1b\\x20-\\x7eÀ-ÖØ-öø-ÿŒœ–—‘’“”…]|<\\|"
_SPLIT = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Stretches and words that a worker keeps at most before it forgets half of them; about 150 bytes each.
_KEPT = 200_000
_loaded: dict[str, _Quick] = kept.setdefault("packing", {})


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Quick:
    """The tokenizer with the ids of stretches and words met before. Each has a number, in the order met; the ids of all lie one after another.
    When they are many, the half that was asked for most often stays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.words_only = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # words that are cut and lower-cased already need the merges only
        self.words_only.normalizer = None
        self.words_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for token, i in self.model.get_vocab().items() if token.endswith("</w>")]] = True
        self.number: dict[str, int] = {"\n": 0}  # what stands after each stretch when these are cut into words: no ids
        self.ids, self.sizes, self.used = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def put(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keeps names that are not known yet; their numbers."""
        numbers = np.arange(len(self.number), len(self.number) + len(names))
        self.number.update(zip(names, numbers.tolist(), strict=True))
        self.ids, self.sizes, self.used = np.r_[self.ids, ids], np.r_[self.sizes, sizes], np.r_[self.used, np.ones(len(names), np.int64)]
        return numbers

    def forget(self) -> None:
        self.used[0] = self.used.max() + 1
        stay = np.sort(np.argsort(-self.used, kind="stable")[: _KEPT // 2])
        names = list(self.number)
        self.number = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.ids, self.sizes, self.used = self.ids[_expanded(stay, self.sizes)[0]], self.sizes[stay], self.used[stay] // 2

    def numbers(self, names: list[str]) -> np.ndarray:
        """The number of each distinct name; -1 for unknown ones."""
        out = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        self.used[out[out >= 0]] += 1
        return out

    def learn(self, stretches: list[str]) -> np.ndarray:
        """The numbers of unknown stretches, cut into words. New words are encoded as texts of many words; an id that ends a word ends its share."""
        words = pa.array(_SPLIT.findall("\n".join(stretches) + "\n"), pa.string()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        number = self.numbers(distinct)
        new = number < 0
        if new.any():
            part = distinct[new].tolist()
            found = self.words_only.encode_batch_fast([" ".join(part[k : k + 1024]) for k in range(0, len(part), 1024)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
            number[new] = self.put(part, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        word = number[words.indices.to_numpy(zero_copy_only=False)]
        marks = np.flatnonzero(word == 0)
        out, more = word[marks - 1], np.diff(marks, prepend=-1) != 2  # a stretch of one word is that word
        at, ends = _expanded(word, self.sizes)
        sizes = np.diff(ends[marks], prepend=0)
        out[more] = self.put(list(compress(stretches, more)), self.ids[at[np.repeat(more, sizes)]], sizes[more])
        return out

    def of(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct stretches, one after another, and how many each has."""
        if len(self.number) > _KEPT:
            self.forget()
        number = self.numbers(stretches)
        unknown = np.flatnonzero(number < 0)
        for i in range(0, len(unknown), 65536):
            part = unknown[i : i + 65536]
            number[part] = self.learn(stretches[part].tolist())
        return self.ids[_expanded(number, self.sizes)[0]], self.sizes[number]


def _tokenizer(path: str) -> _Quick:
    if path not in _loaded:
        _loaded[path] = _Quick(path)
    return _loaded[path]


def _expanded(number: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts lie one after another, `sizes` of each. The places of the parts of `number`, item by item, and where each item's end."""
    n = sizes[number]
    ends = np.cumsum(n)
    return np.repeat((np.cumsum(sizes) - sizes)[number] - ends + n, n) + np.arange(n.sum()), ends


def encode(texts: list[pa.Array], path: str) -> Iterator[list[bytes]]:
    """For each array, each text's ids as little-endian unsigned 32-bit numbers. The tokenizer's words never cross white space and are treated
    alone, so the stretches between white space are numbered over all arrays, each distinct one is looked up, or cut into words that are looked
    up or encoded, and ids are put in place by number."""
    own = _tokenizer(path)
    odds = [pc.match_substring_regex(t, _ODD).to_numpy(zero_copy_only=False).astype(bool) for t in texts]
    splits = [pc.ascii_split_whitespace(pc.utf8_lower(t.filter(pa.array(~odd)))) for t, odd in zip(texts, odds, strict=True)]
    edges = [s.offsets.to_numpy() - s.offsets[0].as_py() for s in splits]  # each text's stretches
    stretches = pa.concat_arrays([s.flatten() for s in splits]).dictionary_encode()
    del splits
    found, sizes = own.of(stretches.dictionary.to_numpy(zero_copy_only=False))
    numbers = np.split(stretches.indices.to_numpy(zero_copy_only=False), np.cumsum([e[-1] for e in edges])[:-1])
    for text, odd, edge, number in zip(texts, odds, edges, numbers, strict=True):
        out = [b""] * len(text)
        for i in np.flatnonzero(odd):
            out[i] = array("I", own.model.encode(text[i].as_py(), add_special_tokens=False).ids).tobytes()
        at_id, ends = _expanded(number, sizes)
        ids = found[at_id].tobytes()
        cut = (4 * np.r_[0, ends][edge]).tolist()
        for i, a, b in zip(np.flatnonzero(~odd), cut, cut[1:], strict=False):
            out[i] = ids[a:b]
        yield out


def _runs(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[list[pa.RecordBatch]]:
    """Portions of about 4 MB of text, together about `most`: a stretch that several of them have is looked up once."""
    run, size = [], 0
    for part in (part for batch in batches for part in portions(batch, 1, 4 << 20)):
        if run and size + part.nbytes > most:
            yield run
            run, size = [], 0
            give_back()
        run.append(part)
        size += part.nbytes
    if run:
        yield run


def cuts(tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    full, rest = divmod(tokens, capacity)
    out = [(i * capacity, capacity) for i in range(full)]
    n = -(-rest // piece)
    edges = [full * capacity + rest * i // n for i in range(n + 1)] if n else []
    return out + [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document, with its ids if asked for."""
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for run in _runs(batches):
            for part, found in zip(run, encode([p.column(1) for p in run], path), strict=True):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start, length in cuts(n, capacity, piece):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(own), n, own))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(task(cut, "packing"), ddl)


def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The window of each item, and the heaviest window's load, by multiway differencing over k windows."""
    m = len(lengths)
    if m <= k:
        return np.arange(m), int(lengths.max(initial=0))
    loads: dict[int, np.ndarray] = {}
    heap = [(-int(v), i) for i, v in enumerate(lengths)]
    heapq.heapify(heap)
    merges = []
    ident = np.arange(k)

    def ranked(node: int) -> tuple[np.ndarray, np.ndarray]:
        """Loads in falling order, and the window that each rank has in the node."""
        if node < m:
            first = np.zeros(k, np.int64)
            first[0] = lengths[node]
            return first, ident
        own = loads.pop(node)
        order = np.argsort(-own, kind="stable")
        return own[order], order

    for new in range(m, 2 * m - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (la, oa), (lb, ob) = ranked(a), ranked(b)
        total = la + lb[::-1]
        loads[new] = total - total.min()
        merges.append((new, a, b, oa, ob[::-1]))
        heapq.heappush(heap, (-int(loads[new].max()), new))
    windows = {2 * m - 2: ident}
    out = np.zeros(m, np.int64)
    for new, a, b, oa, ob in reversed(merges):
        own = windows.pop(new)
        for node, order in ((a, oa), (b, ob)):
            if node < m:
                out[node] = own[np.flatnonzero(order == 0)[0]]
            else:
                put = np.empty(k, np.int64)
                put[order] = own
                windows[node] = put
    return out, int(np.bincount(out, lengths, k).max())


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece."""
    window, full = np.empty(len(lengths), np.int64), lengths >= capacity
    n = int(full.sum())
    window[full] = np.arange(n)
    rest = lengths[~full]
    k = -(-int(rest.sum()) // capacity)
    while len(rest):
        own, most = differencing(rest, k)
        if most <= capacity:
            window[~full] = own + n
            break
        k += 1
    order = np.argsort(window, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    starts = np.r_[True, np.diff(window[order]) > 0] if len(order) else np.array([], bool)
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(starts, before, 0))
    return window, offset


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, windows: int = 192, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; the token ids too if asked for."""
    found = written(pieces(docs, path or tokenizer_path(), capacity, piece, with_ids).withColumn("_n", F.monotonically_increasing_id()), "pieces")
    total = found.agg(F.sum("length")).first()[0] or 0
    groups = max(1, total // (windows * capacity))
    ids = ", ids binary" * with_ids

    def place(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_n").to_numpy())  # whichever way the rows came
        table = table.take(pa.array(order))
        window, offset = fill(table.column("length").to_numpy(), capacity)
        group = table.column("_group").to_numpy()
        out = table.drop_columns(["_n", "_group"])
        return out.append_column("sequence_id", pa.array(group * (1 << 24) + window)).append_column("offset", pa.array(offset))

    dealt = found.withColumn("_group", F.pmod(F.xxhash64(F.lit(7), "_n"), F.lit(groups)).cast("long"))
    return dealt.groupBy("_group").applyInArrow(place, f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long{ids}, sequence_id long, offset long")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return pack(docs)
