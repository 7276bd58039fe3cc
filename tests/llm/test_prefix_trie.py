"""The prefix trie against its SQL and a plain trie, with tiles of several sizes."""

import hashlib
import random
import zlib

import duckdb
import pytest

from voidframe.llm import prefix_trie

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, part string, shard string, total int, pos int"


def rows():
    rnd, out = random.Random(9), []
    for c in [*range(0, 60), *range(100, 130), *range(-40, 0, 3), 250, 251, 777]:
        for k in range(rnd.randrange(1, 9)):
            out.append((c, k, ("user", "assistant")[k % 2], rnd.choice(["a", "b", "", None, "日本 😀"])))
    out += [(130, k, "user", f"t{k % 7}") for k in range(500)] + [(131, k, "user", f"t{k % 7}") for k in range(700)]  # deep, and a prefix of each other
    out += [(800 + c, k, "user", "same " * 40) for c in range(40) for k in range(6)]  # copies
    out += [(900, None, None, None), (900, None, "user", "x"), (900, 3, "user", "x"), (900, 3, "user", "x"), (None, 0, "user", "left out"), *[(c, 0, "user", "only") for c in range(301, 310)]]
    return [(*r, "x", "y", 3, 4) for r in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def brute():
    own = {}
    for r in rows():
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    said = {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))] for c, v in own.items()}
    full = {}
    for c, v in said.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c > 0 else -1)
        full[c] = tuple(said.get(base, [])[:h] + v[h:])
    assert () in full.values()
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = own_saved + sum(saved[k] for k in kids.get(p, []))
    ends = lambda p: ",".join(str(c) for c in sorted(c for c in members[p] if full[c] == p))
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()]


def ordered(rows):
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in rows)


@pytest.mark.parametrize("shard, band", [(2048, 128), (8, 4)])
def test_trie_against_brute_force(spark, table, shard, band):
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(table)), shard=shard, band=band)
    assert ordered(tuple(r) for r in got.select(COLS).collect()) == ordered(brute())


def test_sql(spark, table):
    conversations = table.select("conv_id", "turn", "role", "text").toArrow()
    db = duckdb.connect()
    db.register("conversations", conversations)
    got = db.execute(f"select {', '.join(COLS)} from ({prefix_trie.SQL})").fetchall()
    assert ordered(got) == ordered(brute())


def test_empty_and_single(spark, table):
    assert prefix_trie.digest(table.where("false")).count() == 0
    alone = prefix_trie.digest(spark.createDataFrame([(5, 0, "user", "a"), (5, 1, "user", "b")], "conv_id long, turn long, role string, text string")).collect()
    # crc32('5') % 6 turns are dropped and there is no conversation 0 to lend any
    h = zlib.crc32(b"5") % 6
    assert len(alone) == 1 + max(0, 2 - h) and max(r.depth for r in alone) == max(0, 2 - h)
