"""Ranked search: tokens against the regular expression, bounds against exact scores, results against a plain ranking."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from voidframe.llm import ranked_search as rs

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, score string, rank string"


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=rs.TOP):
    own = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    n_docs, n_terms = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in own:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def ordered(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


@pytest.mark.parametrize("stretch", [rs._STRETCH, 16])
def test_terms(stretch, monkeypatch):
    monkeypatch.setattr(rs, "_STRETCH", stretch)
    texts = ["", None, "One two, ONE", "é日本 x", "a" * 200, "b" * 70 + " " + "b" * 71, "...", "no_under-score 12ab", "end", "start end", "İ ĐÀ é", "x" * 40 + " y" * 40]
    row, term, count, n = rs.counted_terms(pa.array(texts))
    hashes = {}
    for i, t in enumerate(texts):
        want = Counter(words(t))
        assert n[i] == sum(want.values()) and sorted(count[row == i]) == sorted(want.values())
        for w in want:
            _, h, _, _ = rs.counted_terms(pa.array([w]))
            assert h[0] in set(term[row == i]) and hashes.setdefault(w, h[0]) == h[0]
    assert len(set(hashes.values())) == len(hashes)


def test_bounds_hold_and_exclude(spark):
    """No score exceeds its bound; most pairs lie below the final floor."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = rs.build(docs).collect()
    q = rs.Queries([type("R", (), {"terms": rs.counted_terms(pa.array([r.text]))[1].tobytes()}) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    df = np.zeros(len(q.terms), dtype=np.int64)
    for r in index:
        df += np.bincount(rs._lookup(q, {"terms": bytes(r.terms)})[0], minlength=len(df))
    q.weigh(df, sum(r["rows"] for r in index), sum(r.total for r in index))
    bound, exact = [], []
    for r in index:
        block = rs._Block(q, {k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()})
        item, doc = (x.ravel() for x in np.indices(block.bound.shape))
        exact.append(block.scores(item, doc).reshape(block.bound.shape))
        bound.append(block.bound)
    bound, exact = np.concatenate(bound, axis=1), np.concatenate(exact, axis=1)
    assert (bound >= exact).all()
    tenth = np.sort(exact, axis=1)[:, -10]
    assert (bound >= tenth[:, None]).mean() < 0.25


@pytest.mark.parametrize("group", [256, 3])
def test_search_against_a_plain_ranking(spark, odd, group, monkeypatch):
    monkeypatch.setattr(rs, "ITEMS", group)
    items = [(1, "alpha beta password word"), (2, None), (3, "..."), (4, "Text WITH digits ünïcödé"), (4, "Text WITH digits ünïcödé"), (None, "one row id"), (7, "absent terms only zz9"), (8, "word " * 5000 + "alpha")]
    asked = spark.createDataFrame([(*i, "x", "y") for i in items], ITEMS)
    got = rs.search(rs.build(odd), asked).select("item_id", "rank", "doc_id", "score").collect()
    assert ordered(got) == ordered(plain([(r.doc_id, r.text) for r in odd.collect()], items))


def test_many_equal_documents(spark):
    """Ties go by doc_id, across tasks and blocks; repeated doc_ids stay apart."""
    docs = spark.range(3000).selectExpr("id % 2500 doc_id", "case when id % 3 = 0 then 'same old text here' else concat('other ', id) end text").repartition(7)
    got = rs.search(rs.build(docs), spark.createDataFrame([(1, "same text")], "item_id long, text string"), k=20).orderBy("rank").collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(1, "same text")], k=20)
    assert [tuple(r) for r in got] == want


def test_empty(spark, none, odd):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert rs.search(rs.build(none), items).count() == 0
    assert rs.search(rs.build(odd), items.where("false")).count() == 0
    assert rs.search(rs.build(odd.where("text = ''")), items).count() == 0


def test_passes_read_few_blocks_at_once(spark, monkeypatch):
    """Blocks of several MB do not meet in one batch."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 640, 1, 1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 3000), x -> cast(id * 3000 + x as string)), ' ') as text")
    index, items = rs.build(docs), spark.createDataFrame([(1, "7 1919999"), (2, "none")], "item_id long, text string")
    seen, own = spark.sparkContext.accumulator(0), rs._frequencies
    blocks = index.count()

    def watched(q):
        run = own(q)

        def counted(batches):
            def each():
                for batch in batches:
                    if batch.num_rows > 2:
                        seen.add(1)
                    yield batch

            yield from run(each())

        return counted

    monkeypatch.setattr(rs, "_frequencies", watched)
    got = rs.search(index, items).collect()
    assert blocks >= 5 and seen.value == 0
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 0), (1, 2, 639)]
