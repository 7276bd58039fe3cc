"""Benchmark decontamination by template canonicalisation.

A text becomes a template: words lower-cased without the punctuation around them, numbers, units (after a number, attached or
not) and names (runs of words capitalised inside a sentence) replaced by typed placeholders, number words like
numbers, a run of them as one. A capitalised word at a sentence
start is read both ways, as a literal and as a name. Windows of WINDOW template tokens of the documents are hash-joined with
those of the benchmark items; an item shorter than that is one window of its own length. Before the join a Bloom filter of
fixed size over the items' windows drops document windows that cannot match, so its size does not grow with either side.

Matches that lie on one diagonal (document place less item place) belong together. On a diagonal the placeholders must be
filled consistently: what the item says twice with one value, the document says with one value too. The share of an item's
windows matched on consistent diagonals is its coverage; `at_least` of it makes a leak. So a question asked with other
numbers, names or units is found, and text that merely shares a shape is not. Windows with fewer than LEAST literal words
do not count; an item without any other is looked for word for word, by windows of its words and values as they stand.

Null texts count as empty and leak nothing; an item of one or two words leaks wherever these stand. A null doc_id matches
like others. Repeated rows with one doc_id give one row per item; an empty table on either side gives an empty result. Very long
texts are read whole; of items that a text leaks equally, each has its row.
Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import portions, task, text_of, written

WINDOW, LEAST = 5, 3
BLOOM_BITS = 1 << 24
#: Units that follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec secs min mins h hr hrs hour hours minute minutes second seconds "
    "day days week weeks month months year years % percent degrees °c °f c f k v w kw a hz khz mhz ghz n j kj cal kcal pa kpa bar "
    "usd eur gbp dollars euros pounds cents dollar euro pound cent meters metres meter metre miles mile inches feet grams kilograms liters litres".split()
)
#: Number words.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
_EDGES = "!\"#$&'()*,./:;<=>?@[\\]^_`{|}~«»“”‘’„…¿¡"
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/:]*")
#: A number with its unit, or %, attached.
_ATTACHED = re.compile(r"([+-]?[$€£]?\d[\d.,/:]*)([^\W\d_]+|%|°[cCfF]?)")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEPT_WORDS = 150_000
#: Kinds of token, then the hashes that stand for the three sorts of placeholder.
_LITERAL, _NUM, _UNITWORD, _CAPITAL = 0, 1, 2, 4
_ENDS, _BREAKS, _SPLIT, _NUMWORD = 8, 16, 32, 64
_SLOT = np.array([0, 0xA1, 0xA2, 0xA3], np.uint64)


class _Tokens(dict):
    """Tokens met before, numbered; hash, kind and the unit split off by number, in arrays that grow by doubling."""

    def __init__(self):
        self.hash, self.kind, self.unit, self.core = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), []

    def __missing__(self, token: str) -> int:
        core, kind, unit = token, _LITERAL, 0
        if not token.isalpha():
            core = token.strip(_EDGES).rstrip("+-")
            if token[-1] in ".!?:|" or token.rstrip("\"')»”’")[-1:] in (".", "!", "?"):
                kind = _ENDS
            if not core.isalpha():
                if _NUMBER.fullmatch(core):
                    kind |= _NUM
                elif (m := _ATTACHED.fullmatch(core)) and m[2].lower() in UNITS:
                    unit, core = self[m[2] + "." * (kind == _ENDS)], m[1].rstrip(".,/:")
                    kind |= _NUM | _SPLIT
            if token[-1] in ",;":
                kind |= _BREAKS
        low = core.lower()
        if low in UNITS:
            kind |= _UNITWORD
        if low in NUMBERS or ("-" in low and NUMBERS.issuperset(low.split("-"))):
            kind |= _NUM | _NUMWORD
        elif core[:1].isupper() and len(core) > 1 and not core.isupper():
            kind |= _CAPITAL
        n = len(self.core)
        if n == len(self.hash):
            self.hash, self.kind, self.unit = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.kind, self.unit))
        self[token] = n
        self.hash[n], self.kind[n], self.unit[n] = xxhash.xxh64_intdigest(low.encode("utf-8", "replace")), kind, unit
        self.core.append(low)
        return n


_tokens = _Tokens()


def _mixed(rows: Iterator[np.ndarray], n: int, m: int) -> np.ndarray:
    out = np.full(m, n, np.uint64)
    for row in rows:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(31)
    return out


class Template:
    """The templates of many texts, one after another: hashes with placeholders put in, which sort each token is, and the words behind.

    A run of names, or of number words, is one token. A capitalised word at a sentence start is open: a literal, or a name together
    with the names after it. Nothing runs on from text to text."""

    def __init__(self, texts: list[str]):
        if len(_tokens) > _KEPT_WORDS:
            _tokens.clear()
            _tokens.core.clear()
        found = [t.split() for t in texts]
        n = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter(map(_tokens.__getitem__, chain.from_iterable(found)), np.int64, n.sum())
        of = np.repeat(np.arange(len(texts)), n)
        k = _tokens.kind[ids]
        split = (k & _SPLIT) > 0
        if split.any():
            ids, of = np.repeat(ids, 1 + split), np.repeat(of, 1 + split)
            second = np.cumsum(1 + split)[split] - 1
            ids[second] = _tokens.unit[ids[second]]
            k = _tokens.kind[ids]
            k[second - 1] &= ~_ENDS
        self.ids, self.values, self.of_value = ids, _tokens.hash[ids], of
        before = lambda x: np.concatenate([[False], x[:-1]])[: len(x)]
        opens = np.diff(of, prepend=-1) > 0
        starts = opens | before((k & _ENDS) > 0)
        number, counted, breaks = (k & _NUM) > 0, (k & _NUMWORD) > 0, (k & _BREAKS) > 0
        unit = ((k & _UNITWORD) > 0) & before(number) & ~opens
        capital = ((k & _CAPITAL) > 0) & ~unit
        name = capital & ~starts
        sort = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
        # of a run of names or number words the first stands for all
        self.first = np.flatnonzero(~(((name & before(name)) | (counted & before(counted) & ~starts)) & ~before(breaks)))
        self.last = np.append(self.first, len(ids))[1:]
        self.of = of[self.first]
        self.sort = sort[self.first]
        self.hash = np.where(self.sort > 0, _SLOT[self.sort], self.values[self.first])
        self.open = np.flatnonzero((capital & starts)[self.first])
        self.joined = np.zeros(len(self.first), bool)  # open, and names follow without a break
        if len(self.open):
            o = self.open[self.open + 1 < len(self.first)]
            self.joined[o] = (self.sort[o + 1] == 3) & ~breaks[self.first[o]]
        # names that an open word may take in have its place, so that places agree whatever the name's length
        self.place = np.arange(len(self.first)) - np.cumsum(before(self.joined))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window hash, position, a, b) of every reading with LEAST literal tokens; the open words at a and b, if not -1, are read as names.

        More than n - LEAST of them leave too few literals, so two at most are."""
        size, m = len(self.hash), len(self.hash) - n + 1
        none = np.zeros(0, np.int64)
        if m <= 0:
            return np.zeros(0, np.uint64), none, none, none
        literal = np.r_[0, np.cumsum(self.sort == 0)]
        at = np.flatnonzero((literal[n:] - literal[:-n] >= LEAST) & (self.of[:m] == self.of[n - 1 :]))
        h = _mixed((self.hash[i : i + m] for i in range(n)), n, m)[at]
        s = self.open
        if not len(s) or n <= LEAST:
            return h, at, np.full(len(at), -1), np.full(len(at), -1)
        w, a, b = [(s[:, None] - np.arange(n)).ravel()], [np.repeat(s, n)], [np.full(len(s) * n, -1)]
        for gap in range(1, min(n, len(s))):
            near = np.flatnonzero(s[gap:] - s[:-gap] <= n)
            if not len(near):
                break
            w.append((s[near][:, None] - np.arange(n)).ravel())
            a.append(np.repeat(s[near], n))
            b.append(np.repeat(s[near + gap], n))
        w, a, b = np.concatenate(w), np.concatenate(a), np.concatenate(b)
        rows = self._positions(w, a, b, n)
        fits = (w >= 0) & (rows[-1] < size) & ((b < 0) | (rows[-1] >= b))
        fits[fits] = self.of[w[fits]] == self.of[rows[-1][fits]]
        w, a, b, rows = w[fits], a[fits], b[fits], [r[fits] for r in rows]
        named = [(r == a) | (r == b) for r in rows]
        fits = sum((self.sort[r] == 0) & ~x for r, x in zip(rows, named, strict=True)) >= LEAST if len(w) else np.zeros(0, bool)
        h2 = _mixed((np.where(x, _SLOT[3], self.hash[r])[fits] for r, x in zip(rows, named, strict=True)), n, int(fits.sum()))
        less = np.full(len(at), -1)
        return np.r_[h, h2], np.r_[at, w[fits]], np.r_[less, a[fits]], np.r_[less, b[fits]]

    def _positions(self, w, a, b, n: int) -> list[np.ndarray]:
        """The positions of n tokens from w, without the names that the words at a and b take in."""
        rows, r = [], w.copy()
        for _ in range(n):
            rows.append(r)
            r = r + 1 + (self.joined[r % len(self.joined)] & ((r == a) | (r == b)))
        return rows

    def exact(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, positions) of all windows of n words as they stand, names and numbers too."""
        m = len(self.values) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.of_value[:m] == self.of_value[n - 1 :])
        return _mixed((self.values[i : i + m] for i in range(n)), n + 64, m)[at], at

    def slots(self, at: int, a: int, b: int, n: int) -> list[str]:
        """What fills the placeholders of a window; * before what stands at a sentence start."""
        out, r = [], at
        for _ in range(n):
            open_ = r in (a, b)
            end = r + 1 if open_ and self.joined[r] else r
            if open_ or self.sort[r]:
                out.append(f"{'*3' if open_ else self.sort[r]}{' '.join(_tokens.core[i] for i in self.ids[self.first[r] : self.last[end]])}")
            r = end + 1
        return out


def template_windows(texts: DataFrame, key: str, lengths: list[int] | None = None, bloom=None) -> DataFrame:
    """(key, at, place, n, h, slots, total) for windows of the texts. Without lengths, each text's own: WINDOW, or all of it if shorter; where none of
    these has LEAST literals, windows of the words as they stand, n negative. bloom: a broadcast bit array; windows that it rules out are left out."""
    schema = pa.schema([(key, pa.int64()), ("at", pa.int32()), ("place", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("slots", pa.list_(pa.string())), ("total", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value if bloom is not None else None

        def passed(h: np.ndarray) -> np.ndarray:
            if bits is None or not len(h):
                return np.arange(len(h))
            a, b = (h % np.uint64(BLOOM_BITS)).astype(np.int64), ((h >> np.uint64(40)) % np.uint64(BLOOM_BITS)).astype(np.int64)
            return np.flatnonzero((bits[a >> 3] >> (a & 7) & 1).astype(bool) & (bits[b >> 3] >> (b & 7) & 1).astype(bool))

        def rows_of(idents: list, texts: list[str], wanted: list[int]) -> list[tuple]:
            own, rows = Template(texts), []
            for n in wanted:
                if n > 0:
                    h, at, a, b = own.windows(n)
                    total = len(np.unique(at)) if lengths is None else 0
                    rows += [(idents[own.of[at[i]]], int(at[i]), int(own.place[at[i]]), n, int(h[i].view(np.int64)), own.slots(int(at[i]), int(a[i]), int(b[i]), n), total) for i in passed(h)]
                else:
                    h, at = own.exact(-n)
                    rows += [(idents[own.of_value[at[i]]], int(at[i]), int(at[i]), n, int(h[i].view(np.int64)), [], len(h)) for i in passed(h)]
            return rows

        def rows_of_item(ident: int | None, text: str) -> list[tuple]:
            own = Template([text])
            found = rows_of([ident], [text], [min(WINDOW, max(1, len(own.hash)))])
            return found or (rows_of([ident], [text], [-min(WINDOW, len(own.ids))]) if len(own.ids) else [])

        for part in (p for batch in batches for p in portions(batch, 1, 2 << 20)):
            idents, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            rows = rows_of(idents, texts, lengths) if lengths else [r for x in zip(idents, texts, strict=True) for r in rows_of_item(*x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return texts.select(F.col(key).cast("long"), text_of().alias("_text")).mapInArrow(task(cut), f"{key} long, at int, place int, n int, h long, slots array<string>, total int")


def bloom_of(windows: DataFrame) -> np.ndarray:
    """BLOOM_BITS bits with two set for each window hash; the set bits are found by Spark, at most BLOOM_BITS / 8 bytes of them kept."""
    h = F.col("h")
    # of the hash as an unsigned number: its low bits, and its top 24 bits
    bits = F.explode(F.array(h.bitwiseAND(F.lit(BLOOM_BITS - 1)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(BLOOM_BITS - 1)))).alias("bit")
    by_byte = windows.select(bits).select(F.shiftright("bit", 3).cast("int").alias("byte"), F.expr("shiftleft(1, cast(bit & 7 as int))").alias("mask"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in by_byte.groupBy("byte").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        out[r["byte"]] = r["mask"]
    return out


def probes(items: DataFrame, at_least: float) -> DataFrame:
    """(n, h, item_id) of each item's rarest windows, one more than it may lack: a text that leaks the item has one of them. So a phrase
    that many items share does not bring each text that has it together with all of these."""
    shared = items.groupBy("n", "h").agg(F.count_distinct("item_id").alias("_items"))
    placed = items.join(shared, ["n", "h"]).groupBy("item_id", "at", "total").agg(F.max("_items").alias("_items"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("_items", "at"))
    rare = placed.withColumn("_rank", rank).where(F.col("_rank") <= F.floor((1 - at_least) * F.col("total") + 1e-9) + 1)
    return items.join(rare.select("item_id", "at"), ["item_id", "at"], "left_semi").select("n", "h", "item_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, at_least: float = 0.8) -> DataFrame:
    """doc_id, item_id, coverage, reparameterised (some placeholder is filled otherwise than in the item) for each leak."""
    spark = docs.sparkSession
    items = written(template_windows(benchmark, "item_id"), "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most 2 WINDOW of them
    hits = written(template_windows(docs, "doc_id", lengths or [WINDOW], spark.sparkContext.broadcast(bloom_of(items))), "hits")
    asked = hits.select("doc_id", "n", "h").join(probes(items, at_least), ["n", "h"]).select(F.col("doc_id").alias("_doc"), "item_id").distinct()
    i = items.select(F.col("item_id"), F.col("at").alias("iat"), F.col("place").alias("iplace"), "n", "h", F.col("slots").alias("islots"), F.col("total").alias("itotal"))
    met = hits.select("doc_id", "place", "n", "h", "slots").join(asked, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(i, ["item_id", "n", "h"])
    bare = lambda c: F.regexp_replace(c, r"^\*", "")
    # a name is told by its last word: at a sentence start its first may be taken for a literal
    last = lambda c: F.concat(F.substring(bare(c), 1, 1), F.substring_index(F.regexp_replace(bare(c), r"^.", ""), " ", -1))
    pairs = F.zip_with("islots", "slots", lambda a, b: F.struct(last(a).alias("item"), last(b).alias("doc"), (a.startswith("*") | b.startswith("*")).alias("open"), (bare(a) != bare(b)).alias("other")))
    met = met.withColumn("_pairs", pairs)
    met = met.withColumns({
        "_fill": F.transform(F.filter("_pairs", lambda x: ~x["open"]), lambda x: F.struct(x["item"].alias("item"), x["doc"].alias("doc"))),
        "_open": F.transform(F.filter("_pairs", lambda x: x["open"]), lambda x: F.struct(x["item"].alias("item"), x["doc"].alias("doc"))),
        "_renamed": F.exists("_pairs", lambda x: x["open"] & x["other"]),
        "_refilled": F.exists("_pairs", lambda x: ~x["open"] & x["other"]),
    })
    win = F.struct("iat", F.col("_open").alias("open"), F.col("_renamed").alias("changed"))
    lined = met.groupBy("doc_id", "item_id", "itotal", (F.col("place") - F.col("iplace")).alias("line")).agg(F.collect_set(win).alias("wins"), F.array_distinct(F.flatten(F.collect_set("_fill"))).alias("fill"), F.max("_refilled").alias("refilled"))
    consistent = F.size("fill") == F.size(F.array_distinct(F.transform("fill", lambda x: x["item"])))
    # a reading of sentence starts as names counts where these agree with every other value; else only that reading is left out
    lined = lined.where(consistent).withColumn("all", F.array_union("fill", F.flatten(F.transform("wins", lambda w: w["open"]))))
    lined = lined.withColumn("clash", F.filter(F.array_distinct(F.transform("all", lambda x: x["item"])), lambda v: F.size(F.filter("all", lambda x: x["item"] == v)) > 1))
    lined = lined.withColumn("good", F.filter("wins", lambda w: ~F.exists(w["open"], lambda x: F.array_contains("clash", x["item"]))))
    kept = F.array_distinct(F.transform("good", lambda w: w["iat"]))
    # a window is renamed where every reading that matches it is
    renamed = F.exists(kept, lambda at: F.forall(F.filter("good", lambda w: w["iat"] == at), lambda w: w["changed"]))
    lined = lined.select("doc_id", "item_id", "itotal", kept.alias("ats"), (F.col("refilled") | renamed).alias("changed"))
    found = lined.groupBy("doc_id", "item_id", "itotal").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("matched"), F.max("changed").alias("reparameterised"))
    return found.select("doc_id", "item_id", (F.col("matched") / F.col("itotal")).alias("coverage"), "reparameterised").where(F.col("coverage") >= at_least)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    return leaks(docs, benchmark)
