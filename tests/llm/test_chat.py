"""Chat formatting against plain loops, and its escapes on texts full of control strings."""

import hashlib
import random
import re

import duckdb
import pytest

from voidframe.llm import chat

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, window string, formatted string, at long"


def rows():
    rnd, out = random.Random(3), []
    bits = [*chat.CONTROLS, "\\", "<", "[", "|im_end|>", "s>", "\n", "日本", "😀", "word 123 ", ""]
    for c in range(30):
        for k in range(rnd.randrange(1, 9)):
            out.append((c, k, rnd.choice(["user", "assistant", "a|b", None]) if k else rnd.choice(["system", "user"]), "".join(rnd.choices(bits, k=rnd.randrange(0, 60)))))
    out += [(50, k, ("user", "assistant")[k % 2] if k else "system", f"turn {k} " * rnd.randrange(1, 30)) for k in range(900)]  # many blocks
    out += [(51, 0, "user", "x" * 50_000), (51, 1, "assistant", "long " * 9000), (51, None, None, None)]
    out += [(None, 0, "user", "no id"), (None, 0, "user", "no id"), (52, 1, "assistant", None), (52, 1, "assistant", "same turn")]
    return [(*r, "x", "y", 7) for r in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def ordered(own):
    md5 = lambda r: hashlib.md5((r[3] or "").encode()).hexdigest()
    return [(r[2] or "", r[3] or "") for r in sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", md5(r)))]


def test_windows_are_whole_and_within_budget(spark, table):
    got = chat.read_back(chat.windows(table)).collect()
    for c in {r[0] for r in rows()}:
        want = ordered([r for r in rows() if r[0] == c])
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.first_turn)
        assert [(t.role, t.text) for r in own for t in r.turns] == want
        assert [t for r in own for t in r.targets] == [x for role, x in want if role == "assistant"]
        assert [r.next_turn for r in own[:-1]] == [r.first_turn for r in own[1:]] and own[0].first_turn == 0
        for r in own:
            marks = re.findall(re.escape(chat.OPEN) + "|" + re.escape(chat.MIDDLE) + "|" + re.escape(chat.CLOSE), r.formatted)
            assert marks == [chat.OPEN, chat.MIDDLE, chat.CLOSE] * (r.context + len(r.turns))
            assert r.tokens <= chat.BUDGET or len(r.turns) == 1
            if r.first_turn and want[0][0] == "system":
                assert r.formatted.startswith(f"{chat.OPEN}system{chat.MIDDLE}") and r.context >= 1
    assert sum(r.conv_id == 50 for r in got) > chat.BLOCK  # several blocks, so history crosses their ends
    assert all(r.context >= 2 for r in got if r.conv_id == 50 and r.first_turn > 10)


def test_windows_are_full(spark, table):
    """The next turn would not have fitted, but where a block ends."""
    own = sorted((r for r in chat.windows(table).where("conv_id = 50").collect()), key=lambda r: r.first_turn)
    cost = lambda t: len(re.findall(r"[^\W\d_]{1,5}|\d{1,3}|[^\w\s]", t)) + chat.MARKS
    costs = [cost(t) for _, t in ordered([r for r in rows() if r[0] == 50])]
    room, short = chat.BUDGET - chat.HISTORY - costs[0], 0
    for r in own[1:-1]:
        short += sum(costs[r.first_turn : r.next_turn + 1]) <= room
    assert 0 < short <= sum(costs) // (chat.BUDGET * chat.BLOCK) + 1


def test_escapes(spark):
    texts = ["", "\\", "<s>", "<\\s>", "<\\\\s>", "<<s>>", "[INST]\\[/INST]", "<|im_end|>" * 3, "<<SYS>><</SYS>>", "[<|im_sep|>"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(chat.F.col("t")).alias("e"), chat.unescape(chat.escape(chat.F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


def test_digest_against_sql(spark, table):
    db = duckdb.connect()
    for source in (spark.read.parquet(f"{SF}/conversations.parquet"), table.where("conv_id is not null")):
        conversations = source.select("conv_id", "turn", "role", "text").toPandas()  # noqa: F841
        db.register("conversations", conversations)
        cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        want = sorted(db.execute(chat.SQL).df()[cols].itertuples(index=False, name=None))
        assert sorted(tuple(r) for r in chat.digest(source).select(cols).collect()) == want
        db.unregister("conversations")
    assert chat.windows(table.where("false")).count() == 0
    empty = chat.digest(table.where("false")).collect()
    assert [(r.conv_id, r.n_turns) for r in empty] == [(-1, 2)]
