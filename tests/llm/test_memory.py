"""What a Python task gets at once, and what it leaves behind in its worker."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voidframe.llm import common, language, packing

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    """A session without a limit of its own."""
    spark.conf.unset(BATCH)
    yield spark
    spark.conf.unset(BATCH)


def sizes(df):
    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "n"])

    return df.mapInArrow(size, "rows long, n long")


def test_batches_are_bounded(unset):
    big = unset.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    got = common.written(sizes(big), "sizes").collect()
    assert sum(r["rows"] for r in got) == 2000 and max(r.n for r in got) < 5 << 20
    unset.conf.unset(BATCH)
    docs = big.select("id", "text").withColumnRenamed("id", "doc_id").withColumn("lang", F.lit("en"))
    language.predict(docs, language.learn(docs.limit(9)))
    assert max(r.n for r in sizes(big).collect()) < 5 << 20


def test_own_limit_stays(unset):
    unset.conf.set(BATCH, "8m")
    common.written(unset.range(3), "few")
    assert unset.conf.get(BATCH) == "8m"


def test_tasks_leave_no_words_of_others(monkeypatch):
    monkeypatch.setitem(packing._loaded, "a path", "a tokenizer")
    rows = [1, 2, 3]
    assert list(common.task(iter, "packing")(rows)) == rows and packing._loaded
    assert list(common.task(iter)(rows)) == rows and not packing._loaded
