"""Personal data: a character-level bidirectional LSTM with a CRF on top, beside four fixed patterns.

The patterns (email, ip, card, phone) give the base spans. The network adds spans that they cannot see: mail addresses written out
("jane (at) example dot org"), ip addresses with guarded dots or in hexadecimal groups, cards with other separators or 13 to 15 digits,
phone numbers without a plus. It reads windows of characters, its scores on overlapping windows are averaged, and one Viterbi pass over
each whole region decides, so a span that crosses windows is found once. All that it is taught to find holds a digit, an @ or a
written "at" between marks or before a "dot", so stretches of a text without one of these hold nothing for it and are not read.

Training, in numpy, on labelled spans: windows around marks anywhere in a bounded sample of documents with the base spans as
labels, and windows of the same documents into which spans of the four kinds, in base and other forms, or numbers that are none (dates,
prices, versions, references) were planted. An added span must also hold what its kind cannot do without (`_whole`).

Spans are in code points, end exclusive; base matches are leftmost and non-overlapping per kind, and a match that fails its test
(parts at most 255, Luhn, digit counts) is dropped without another try. Of added spans none touches another or a base span. Null
text counts as empty and has no spans. Very long texts are read whole, and texts in portions. Repeated rows are each read; a null doc_id is kept;
an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, text_of
from .language import forward_backward

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
#: Where the network looks: beside digits and @ also at a written "at".
_SEEN = re.compile(r"[0-9@]|[(\[{<] ?at ?[)\]}>]| at (?=[\w-]+ dot )", re.I)
_AT = re.compile(r"\w ?(?:@|[(\[{<] ?at ?[)\]}>]| at ) ?\w", re.I)
_DATE = re.compile(r"\d{1,4}([-/.])\d{1,2}\1\d{1,4}")
_DIGITS = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    if not _MARK.search(text):
        return []
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]


_MARKS = "@.-+()_% \n:/,"
#: Character classes: each mark, digit, lower, upper, other ASCII, beyond ASCII.
CLASSES = len(_MARKS) + 5
_OF = np.full(129, len(_MARKS) + 3, np.int64)
_OF[[ord(c) for c in _MARKS]] = np.arange(len(_MARKS))
_OF[48:58], _OF[97:123], _OF[65:91], _OF[128] = len(_MARKS), len(_MARKS) + 1, len(_MARKS) + 2, len(_MARKS) + 4
TAGS = 1 + 2 * len(KINDS)
WIDTH, STRIDE, MARGIN = 96, 48, 40


def classes(text: str) -> np.ndarray:
    return _OF[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around marks, MARGIN characters either side, merged where they meet."""
    out: list[list[int]] = []
    for m in _SEEN.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tags(spans: list[tuple[str, int, int]], length: int) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in reversed(spans):
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


@dataclass
class Model:
    par: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list]:
        """Tag scores of windows x (windows x steps), and what the backward pass needs. Both directions take a step together: axis 0 of the states
        is the direction."""
        p = self.par
        ids = np.stack([x, x[:, ::-1]])
        (_, n, T), H = ids.shape, p["h"].shape[1]
        scale = np.repeat(np.array([0.5, 1], np.float32), [3 * H, H])  # a logistic function is a tanh of half its argument
        way = np.arange(2)[:, None]
        table = (p["x"] + p["b"][:, None]) * scale
        weights = p["h"] * scale
        h, c = np.zeros((2, n, H), np.float32), np.zeros((2, n, H), np.float32)
        all_h, tape = np.empty((2, T, n, H), np.float32), []
        for t in range(T):
            z = np.tanh(table[way, ids[:, :, t]] + h @ weights)
            s, g = 0.5 * z[:, :, : 3 * H] + 0.5, z[:, :, 3 * H :]
            i, f, o = s[:, :, :H], s[:, :, H : 2 * H], s[:, :, 2 * H :]
            if train:
                tape.append((h, c, i, f, o, g))
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            all_h[:, t] = h
            if train:
                tape[-1] += (tc,)
        both = np.concatenate([all_h[0], all_h[1, ::-1]], axis=2)  # T x n x 2H
        return (both @ p["out"] + p["bo"]).transpose(1, 0, 2), [both, ids, tape]

    def backward(self, de: np.ndarray, kept: list) -> dict[str, np.ndarray]:
        p, (both, ids, tape) = self.par, kept
        d = np.ascontiguousarray(de.transpose(1, 0, 2), np.float32)
        grads = {"out": np.tensordot(both, d, ([0, 1], [0, 1])), "bo": d.sum((0, 1))}
        dh_all = d @ p["out"].T
        H, (_, n, T) = p["h"].shape[1], ids.shape
        own = np.stack([dh_all[:, :, :H], dh_all[::-1, :, H:]])  # direction x T x n x H
        gh, dzs = np.zeros_like(p["h"]), np.empty((2, T, n, 4 * H), np.float32)
        dh, dc = np.zeros((2, n, H), np.float32), np.zeros((2, n, H), np.float32)
        back = p["h"].transpose(0, 2, 1)
        for t in range(T - 1, -1, -1):
            before, c_before, i, f, o, g, tc = tape[t]
            dh = dh + own[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = dzs[:, t]
            dz[:, :, :H], dz[:, :, H : 2 * H] = dc * g * i * (1 - i), dc * c_before * f * (1 - f)
            dz[:, :, 2 * H : 3 * H], dz[:, :, 3 * H :] = dh * tc * o * (1 - o), dc * i * (1 - g * g)
            gh += before.transpose(0, 2, 1) @ dz
            dh, dc = dz @ back, dc * f
        of = (ids.transpose(0, 2, 1)[..., None] == np.arange(CLASSES)).astype(np.float32).reshape(2, T * n, CLASSES)
        flat = dzs.reshape(2, T * n, 4 * H)
        return grads | {"x": of.transpose(0, 2, 1) @ flat, "h": gh, "b": flat.sum(1)}


def _planted(rng: np.random.Generator) -> tuple[str | None, str]:
    """A span of some kind, in one of its forms, or a number that is none (None)."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))
    pick = lambda *xs: xs[rng.integers(0, len(xs))]
    kind = pick(*KINDS, None)
    if kind == "email":
        name = f"{w(2, 9)}{pick('', '.', '_')}{w(1, 6)}{d(rng.integers(0, 4))}"
        top = pick("com", "org", "net", "de", "fr", "edu", "io", w(2, 4))
        at, dot = pick(("@", "."), (" @ ", "."), (" (at) ", "."), (" [at] ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" (at) ", " dot "), (" at ", " dot "), (" AT ", " DOT "))
        return kind, f"{name}{at}{pick('', '', w(3, 7) + dot)}{w(3, 9)}{dot}{top}"
    if kind == "ip":
        if rng.random() < 0.25:
            return kind, ":".join(f"{x:x}" for x in rng.integers(0, 1 << 16, 8))
        return kind, pick(".", ".", "[.]", "(.)", " . ").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        n = pick(16, 16, 15)
        body = d(n - 1)
        body += next(c for c in "0123456789" if luhn(body + c))
        cut = (0, 4, 8, 12, 16) if n == 16 else (0, 4, 10, 15)
        return kind, pick("", " ", "-", ".", "/", "_", " - ").join(body[i:j] for i, j in zip(cut, cut[1:], strict=False))
    if kind == "phone":
        return kind, pick(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(11)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(3)}/{d(7)}")
    y, m, n = int(rng.integers(1900, 2040)), int(rng.integers(1, 13)), int(rng.integers(1, 29))
    return None, pick(f"{y}-{m:02}-{n:02}", f"{n}.{m}.{y}", f"{m}/{n}/{y}", f"{n:02}:{m:02}:{n:02}", f"{d(1)},{d(3)},{d(3)}.{d(2)}", f"${d(4)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"No. {d(8)}", d(rng.integers(1, 10)), f"{d(3)} + {d(2)} = {d(3)}", f"{d(2)}.{d(2)}%", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{y}-{y + 1}", f"{d(3)} {d(3)}", f"pp. {d(3)}-{d(3)}", f"we met at {w(3, 9)} and {w(3, 6)}")


def stretches(text: str, most: int = 5, reach: int = 300) -> list[str]:
    """Parts of a text around `most` of its marks, drawn from all of them."""
    at = [m.start() for m in _SEEN.finditer(text)]
    if len(at) > most:
        at = sorted(np.random.default_rng(len(at)).choice(at, most, replace=False))
    return [text[max(0, i - reach) : i + reach] for i in at]


def examples(texts: list[str], most: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags: a quarter natural ones with base spans, the rest with planted spans."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, at: int, spans: list[tuple[str, int, int]]) -> None:
        a = max(0, min(at - int(rng.integers(0, WIDTH)), len(text) - WIDTH))
        x, y = np.full(WIDTH, _OF[10]), np.zeros(WIDTH, np.int64)
        x[: len(text) - a] = classes(text[a : a + WIDTH])
        y[: len(text) - a] = tags(spans, len(text))[a : a + WIDTH]
        xs.append(x)
        ys.append(y)

    for text in texts[: most // 4]:
        if m := _SEEN.search(text, max(0, len(text) // 2 - 1)) or _SEEN.search(text):
            add(text, m.start(), base_spans(text))
    for i in range(most - len(xs)):
        text = texts[i % len(texts)] if texts else ""
        at = int(rng.integers(0, len(text) + 1))
        kind, span = _planted(rng)
        before, after = text[max(0, at - 150) : at] + " ", f"{['', '.', ','][rng.integers(0, 3)]} {text[at : at + 150]}"
        start = len(before)
        own = [(kind, start, start + len(span))] if kind else []
        others = [(k, s, e) for part, shift in ((before, 0), (after, start + len(span))) for k, s, e in ((k, s + shift, e + shift) for k, s, e in base_spans(part))]
        add(before + span + after, start + int(rng.integers(0, len(span))), own + others)
    return np.array(xs), np.array(ys)


def train(texts: list[str], most: int = 3000, hidden: int = 20, epochs: int = 7, batch: int = 64, rate: float = 0.02, seed: int = 9) -> Model:
    rng = np.random.default_rng(seed)
    x, y = examples(texts, most, seed)
    drawn = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    bias = np.zeros((2, 4 * hidden), np.float32)
    bias[:, hidden : 2 * hidden] = 1
    par = {"out": drawn(0.2, 2 * hidden, TAGS), "bo": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS)), "x": drawn(0.3, 2, CLASSES, 4 * hidden), "h": drawn(0.2, 2, hidden, 4 * hidden), "b": bias}
    model = Model(par)
    m, v, step = {k: np.zeros_like(a) for k, a in par.items()}, {k: np.zeros_like(a) for k, a in par.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            e, kept = model.emissions(x[at], train=True)
            n = e.shape[0] * e.shape[1]
            post, expected = forward_backward(e.reshape(n, TAGS), np.full(len(at), WIDTH), par["trans"], np.zeros(TAGS))
            post[np.arange(n), y[at].ravel()] -= 1
            grads = model.backward(post.reshape(e.shape) / len(at), kept)
            seen = np.zeros((TAGS, TAGS))
            np.add.at(seen, (y[at][:, :-1].ravel(), y[at][:, 1:].ravel()), 1)
            grads["trans"] = (expected - seen) / len(at)
            step += 1
            pace = rate * (1 if epoch < epochs - 2 else 0.3)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                par[k] = (par[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(g.dtype)
    return model


def decode(model: Model, found: list[np.ndarray]) -> list[np.ndarray]:
    """The best tags of each region (an array of classes): windows scored together, overlaps averaged, one Viterbi pass a region."""
    if not found:
        return []
    lengths = np.array([len(r) for r in found])
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate(found)
    at = np.concatenate([s + np.arange(0, max(1, n - WIDTH + STRIDE), STRIDE) for s, n in zip(starts, lengths, strict=True)])
    of = np.repeat(np.arange(len(found)), [len(range(0, max(1, n - WIDTH + STRIDE), STRIDE)) for n in lengths])
    total, times = np.zeros((len(flat), TAGS)), np.zeros(len(flat))
    for i in range(0, len(at), 1024):
        own, ends = at[i : i + 1024, None] + np.arange(WIDTH), (starts + lengths)[of[i : i + 1024], None]
        inside = own < ends
        x = np.where(inside, flat[np.minimum(own, len(flat) - 1)], _OF[10])
        e, _ = model.emissions(x)
        np.add.at(total, own[inside], e[inside])
        np.add.at(times, own[inside], 1)
    e = total / times[:, None]
    order = np.argsort(-lengths, kind="stable")
    first, sizes, trans = starts[order], lengths[order], model.par["trans"]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    back, score = np.zeros((len(flat), TAGS), np.int8), e[first]
    best_end = np.empty(len(found), np.int64)
    for t in range(1, sizes[0] + 1):
        k = active[t] if t < sizes[0] else 0
        best_end[k : len(score)] = score[k:].argmax(1)
        if not k:
            break
        step = score[:k, :, None] + trans
        back[first[:k] + t] = step.argmax(1)
        score = step.max(1) + e[first[:k] + t]
    tag, state = np.empty(len(flat), np.int64), best_end
    for t in range(sizes[0] - 1, -1, -1):
        k = active[t]
        tag[first[:k] + t] = state[:k]
        if t:
            state[:k] = back[first[:k] + t, state[:k]]
    return np.split(tag, np.cumsum(lengths)[:-1])


def _whole(kind: str, text: str) -> bool:
    """What the kind cannot do without."""
    digits = _DIGITS.sub("", text)
    if kind == "email":
        return _AT.search(text) is not None
    if kind == "ip":
        parts = re.split(r"[^0-9A-Fa-f]+", text.strip())
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts) or text.count(":") == 7 and len(parts) == 8 and all(len(p) in (1, 2, 3, 4) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and not _DATE.fullmatch(text.strip())


def tagged_spans(tag: np.ndarray, offset: int, text: str) -> list[tuple[str, int, int]]:
    out, at = [], np.flatnonzero(tag)
    i = 0
    while i < len(at):
        a = at[i]
        kind = (tag[a] - 1) // 2
        b = a + 1
        while b < len(tag) and tag[b] == 2 + 2 * kind:
            b += 1
        if _whole(KINDS[kind], text[offset + a : offset + b]):
            out.append((KINDS[kind], int(offset + a), int(offset + b)))
        i = int(np.searchsorted(at, b))
    return out


def all_spans(model: Model, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text; an added span touches no base span."""
    base = [base_spans(t) for t in texts]
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    coded = {i: classes(texts[i]) for i in {p[0] for p in places}}
    out = [list(x) for x in base]
    for at in range(0, len(places), 20_000):
        part = places[at : at + 20_000]
        for (i, a, _), tag in zip(part, decode(model, [coded[i][a:b] for i, a, b in part]), strict=True):
            if tag.any():
                out[i] += [s for s in tagged_spans(tag, a, texts[i]) if not any(s[1] < e and b < s[2] for _, b, e in base[i])]
    return [(b, sorted(o, key=lambda s: (KINDS.index(s[0]), s[1]))) for b, o in zip(base, out, strict=True)]


def learn(docs: DataFrame, most_docs: int = 600) -> Model:
    """A model from stretches of about most_docs documents with a digit or an @, drawn by hash; at most five stretches of each reach the driver."""
    marked = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64(F.lit(23), "doc_id", "text").alias("_h"), F.col("text").cast("string").alias("text"))
    million = 1_000_000
    share = min(million, -(-million * most_docs // max(1, marked.count())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, 1)):
            found = [stretches(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], names=["_h", "found"])

    rows = marked.where(F.pmod("_h", F.lit(million)) < share).mapInArrow(cut, "_h long, found array<string>").limit(2 * most_docs).collect()
    rows.sort(key=lambda r: (r["_h"], r["found"]))
    return train([x for k in range(5) for r in rows for x in r["found"][k : k + 1]])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans and n_spans (base and added ones) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listing = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            for part in portions(batch, 1, 2 << 20):
                found = all_spans(shared.value, part.column(1).to_pylist())
                n = [pa.array([sum(k == s[0] for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(listing(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *n, sha, pa.array([listing(spans) for _, spans in found], pa.string()), pa.array([len(spans) for _, spans in found], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    schema = docs.select("doc_id").schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(look, schema.add("base_sha256", "string").add("spans", "string").add("n_spans", "long"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return find(docs, learn(docs))
