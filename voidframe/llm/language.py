"""Language identification by a linear-chain conditional random field over words.

Every word is labelled with a language. A word's features are its affixes, its character n-grams and its identity (the
lexicon), hashed into one weight table; learned transitions tie neighbouring words, so a text that switches languages is
labelled piece by piece. A run of more than LONGEST + 2 letters (a clause of a script without spaces) is read as consecutive
pieces, each a word of its own, so that all of it counts and a switch inside it is seen. Posteriors come from forward-backward over the whole text. The document's language is the one with
the most posterior mass; its share is the score.

Training: a bounded, documented sample (`per_language` documents of each language, chosen by hash among the rows it may learn
from), of which a few runs of words from anywhere in the text are read; runs of different documents are joined so that transitions between languages are seen.

Null text, or text without a letter: `und`, score 0. Without any labelled row every text is `und`. Ties go to the first
language by name. Repeated rows are predicted alike; a null doc_id is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, portions, task

BITS = 16
BUCKETS = 1 << BITS
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+")
LONGEST = 24
_KEPT_WORDS = 150_000


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, long ones in pieces."""
    found = _WORD.findall(text.lower())
    if not text.isascii() and not all(map(str.isalpha, found)):
        found = [x for w in found if (x := w if w.isalpha() else "".join(filter(str.isalpha, w)))]
    if max(map(len, found), default=0) > LONGEST + 2:
        return [p for w in found for p in _pieces(w)]
    return found


def _pieces(run: str) -> list[str]:
    """A piece for every LONGEST letters with the two that follow, so that each n-gram is in one; - stands where the run goes on."""
    n = len(run)
    if n <= LONGEST + 2:
        return [run]
    return [("-" if i else "") + run[i : i + LONGEST + 2] + ("-" if i + LONGEST + 2 < n else "") for i in range(0, n - 2, LONGEST)]


def _mixed(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * _MIX
    return h ^ (h >> np.uint64(29))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of many words, word after word, and how many each has: n-grams of 1 to 3, affixes of up to 3 and the word
    itself, all of whole letters; ^ and $ stand for its ends."""
    marked = [("" if w[0] == "-" else "^") + w + ("" if w[-1] == "-" else "$") for w in words]
    n = np.fromiter(map(len, marked), np.int64, len(marked))
    sizes, first = 3 * n + 7, np.cumsum(n) - n
    if not len(n):
        return np.zeros(0, np.int64), sizes
    none = np.zeros(3, np.uint64)
    code = np.r_[none, np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), none]
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(word)) - first[word]
    start = np.cumsum(sizes) - sizes
    out = np.empty(sizes.sum(), np.uint64)
    h, place = np.full(len(word), 3, np.uint64), start[word] + at
    for k in range(3):  # the n-grams that begin at each letter; beyond the end they read zeros
        h = _mixed(h, np.where(at + k < n[word], code[3 + k : 3 + k + len(word)], 0))
        out[place + k * n[word]] = h
    place = start + 3 * n
    power = np.cumprod(np.full(int(n.max()), _MIX))
    out[place] = _mixed(np.add.reduceat(code[3:-3] * power[at], first), np.uint64(9))
    for side in (0, 1):
        h = np.full(len(n), 1 + side, np.uint64)
        for k in range(4):
            h = _mixed(h, np.where(k < n, code[3 + (first + n - 1 - k if side else first + k)], 0))
            if k:
                out[place + 3 * side + k] = h
    return (out >> np.uint64(64 - BITS)).astype(np.int64), sizes


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x L
    transitions: np.ndarray  # L x L
    start: np.ndarray  # L

    def scores(self, new: list[str]) -> np.ndarray:
        """Each word's label scores."""
        if not new:
            return np.zeros((0, len(self.languages)), np.float32)
        flat, sizes = features(new)
        sums = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        return (sums / np.sqrt(sizes)[:, None]).astype(np.float32)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scores: (sum of lengths) x L, text after text. The posteriors in the same order, and the expected transition counts.

    Texts are walked together, the longest first, so that step t handles those with more than t words."""
    n, L = len(lengths), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    offsets = (np.cumsum(lengths) - lengths)[order]
    sizes, T = lengths[order], int(lengths.max())
    active = np.searchsorted(-sizes, -np.arange(T), side="left")
    e = np.exp(scores - scores.max(axis=1, keepdims=True))  # of the scores' own type, as what is kept of each step is
    A, alpha, beta = np.exp(transitions), np.empty_like(e), np.empty_like(e)
    a = np.exp(start) * e[offsets]
    a /= a.sum(1, keepdims=True)
    alpha[offsets] = a
    for t in range(1, T):
        at = offsets[: active[t]] + t
        a = (a[: active[t]] @ A) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    expected = np.zeros((L, L))
    b = np.ones((0, L))
    for t in range(T - 1, -1, -1):
        k, nxt = active[t], active[t + 1] if t + 1 < T else 0
        own = np.ones((k, L))
        if nxt:
            eb = e[offsets[:nxt] + t + 1] * b[:nxt]
            own[:nxt] = eb @ A.T
            pair = alpha[offsets[:nxt] + t]
            z = (pair * own[:nxt]).sum(1)
            expected += A * ((pair / z[:, None]).T @ eb)
            own[:nxt] /= own[:nxt].sum(1, keepdims=True)
        beta[offsets[:k] + t] = own
        b = own
    post = alpha * beta
    return post / post.sum(1, keepdims=True), expected


def runs(text: str, run: int = 24, most: int = 6) -> list[list[str]]:
    """Runs of words to learn from: all of a short text, of a longer one `most`, drawn from the whole of it."""
    own = words(text)
    if len(own) <= run * most:
        return [own[i : i + run] for i in range(0, len(own), run)]
    drawn = np.random.default_rng(len(own)).choice(len(own) - run, most, replace=False)
    return [own[i : i + run] for i in sorted(drawn)]


def train(rows: list[tuple[list[str], str]], epochs: int = 4, batch: int = 48, rate: float = 0.4, seed: int = 3) -> Model:
    """A model from (run of words, language) rows, by adaptive gradient steps on the conditional likelihood."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    L = len(languages)
    model = Model(languages, np.zeros((BUCKETS, L), np.float32), np.zeros((L, L)), np.zeros(L))
    if not rows:
        return model
    distinct = sorted({w for ws, _ in rows for w in ws})
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    hashed, per_word = features(distinct)
    first = np.cumsum(per_word) - per_word
    coded = [(np.array([number[w] for w in ws]), languages.index(lang)) for ws, lang in rows]
    squares, t_squares, s_squares = np.full((BUCKETS, L), 1e-6, np.float32), np.full((L, L), 1e-6), np.full(L, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for i in range(0, len(order) - len(order) % batch or len(order), batch):
            part = [coded[j] for j in order[i : i + batch]]
            group = [part[k : k + 3] for k in range(0, len(part), 3)]  # runs of several documents in one sequence
            flat_words = np.concatenate([ws for ws, _ in part])
            y = np.concatenate([np.full(len(ws), lang) for ws, lang in part])
            lengths = np.array([sum(len(ws) for ws, _ in g) for g in group])
            sizes = per_word[flat_words]
            ends = np.cumsum(sizes)
            flat = hashed[np.repeat(first[flat_words] - ends + sizes, sizes) + np.arange(ends[-1])]
            scale = 1 / np.sqrt(sizes)
            scores = np.add.reduceat(model.weights[flat], ends - sizes, axis=0) * scale[:, None]
            post, expected = forward_backward(scores, lengths, model.transitions, model.start)
            g = post.copy()
            g[np.arange(len(y)), y] -= 1
            per = np.repeat(g * scale[:, None], sizes, axis=0)
            touched, where = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(where, per[:, c], len(touched)) for c in range(L)], 1).astype(np.float32)
            squares[touched] += grad**2
            model.weights[touched] -= rate * grad / np.sqrt(squares[touched])
            begins = np.cumsum(lengths) - lengths
            sg = g[begins].mean(axis=0)
            s_squares += sg**2
            model.start -= 0.1 * sg / np.sqrt(s_squares)
            inside = np.ones(len(y), bool)
            inside[np.cumsum(lengths) - 1] = False
            seen = np.zeros((L, L))
            at = np.flatnonzero(inside)
            np.add.at(seen, (y[at], y[at + 1]), 1)
            tg = (expected - seen) / max(1, len(at)) * L
            t_squares += tg**2
            model.transitions -= 0.1 * tg / np.sqrt(t_squares)
    return model


def learn(docs: DataFrame, per_language: int = 400) -> Model:
    """A model from about per_language rows of each lang, drawn by hash among the rows with text and lang whose crc32(doc_id) mod 3 is not 1.
    Of each drawn text a few runs of words reach the driver."""
    lean(docs.sparkSession)
    usable = docs.where("text is not null and lang is not null and not (crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 <=> 1)").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Model(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)), np.zeros(1))
    million = 1_000_000
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(million, -(-million * per_language // n))))])
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(million)) < share[F.col("lang")]).select("text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array([runs(t) for t in part.column(0).to_pylist()], pa.list_(pa.list_(pa.string()))), part.column(1)], names=["runs", "lang"])

    rows = drawn.mapInArrow(task(cut), "runs array<array<string>>, lang string").limit(2 * per_language * len(counts)).collect()
    return train(sorted((list(x), r["lang"]) for r in rows for x in r["runs"] if x))


class _Scored:
    """Label scores of words met before, a bounded number of them, in a table that grows by doubling. When it is full, words that were
    met in one call only go."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.table = np.zeros((1 << 12, len(model.languages)), np.float32)
        self.met = np.zeros(1 << 12, np.int32)

    def of(self, words: list[str]) -> np.ndarray:
        """The scores of each word."""
        if len(self.at) > _KEPT_WORDS:
            keep = [(w, i) for w, i in self.at.items() if self.met[i] > 1]
            keep = keep if len(keep) < _KEPT_WORDS // 2 else []
            self.table[: len(keep)] = self.table[[i for _, i in keep]]
            self.at = {w: k for k, (w, _) in enumerate(keep)}
            self.met[:] = 0
        new = list(set(words).difference(self.at))
        n = len(self.at)
        if n + len(new) > len(self.table):
            size = 1 << (n + len(new)).bit_length()
            self.table = np.resize(self.table, (size, self.table.shape[1]))
            self.met = np.r_[self.met, np.zeros(size - len(self.met), np.int32)]
        for i in range(0, len(new), 16384):
            part = new[i : i + 16384]
            self.table[n + i : n + i + len(part)] = self.model.scores(part)
        self.at.update(zip(new, range(n, n + len(new)), strict=True))
        found = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        self.met[np.unique(found)] += 1
        return self.table[found]


def _judged(texts: list[str | None], scored: _Scored) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number (-1: none) and the score of each text."""
    split = [words(t or "") for t in texts]
    lengths = np.array([len(ws) for ws in split], np.int64)
    share = np.zeros((len(split), len(scored.model.languages)))
    some = np.flatnonzero(lengths)
    if len(some) and scored.model.languages != ["und"]:
        post, _ = forward_backward(scored.of([w for ws in split for w in ws]), lengths[some], scored.model.transitions, scored.model.start)
        share[some] = np.add.reduceat(post, np.cumsum(lengths[some]) - lengths[some], axis=0) / lengths[some][:, None]
    most = share.max(axis=1, initial=0)
    return np.where(most > 0, share.argmax(axis=1), -1), np.clip(np.round(most, 9), 0, 1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, from the whole text alone. A task holds the words of about 4 MB of text at a time (or of one longer text)."""
    lean(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the weight table
    columns = docs.columns
    place = columns.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scored(shared.value)
        names = pa.array([*shared.value.languages, "und"], pa.string())
        for batch in batches:
            for part in portions(batch, place, 4 << 20):
                best, score = _judged(part.column(place).to_pylist(), scored)
                named = names.take(pa.array(np.where(best < 0, len(names) - 1, best)))
                yield pa.RecordBatch.from_arrays([*part.columns, named, pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    return docs.mapInArrow(task(label), T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    held_out = F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 = 1")
    return predict(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
