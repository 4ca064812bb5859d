"""What a Python task holds at a time."""

import numpy as np
import pyarrow as pa
import pytest

from pressroll.llm import minhash, packed_ids, repeats


@pytest.mark.parametrize("operator", [repeats.repeated_spans, minhash.near_duplicates, packed_ids.token_ids])
def test_python_tasks_get_rows_by_bytes(spark, operator):
    session = spark.newSession()
    session.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    operator(session.createDataFrame([(1, "some text")], "doc_id long, text string"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = session.range(0, 40, 1, 1).selectExpr("repeat('x', 500000) AS text")
    assert max(r["n"] for r in rows.mapInArrow(size, "n long").collect()) <= 5_000_000


def test_a_bucket_of_many_rows_is_settled_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "ROWS", 1000)
    blobs = [repeats._pack({name: np.arange(1000) + 1000 * k for name in repeats.FIELDS} | {"left": np.zeros(1000), "right": np.zeros(1000)})
             for k in range(3)]
    parts = [rows["anchor"].tolist() for rows in repeats._parts(blobs, "anchor")]
    assert max(map(len, parts)) <= 1000 and sorted(sum(parts, [])) == list(range(3000))
