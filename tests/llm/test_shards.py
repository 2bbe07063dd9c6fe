import io
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabular_insights.llm import audit, packing


def test_words_of_a_shard_and_narrow_integers():
    """Words go to Arrow without a copy as Python strings, integers without widening; the bytes stay the same."""
    for text, words in ((None, []), ("é b é", ["é", "b"])):
        shard = audit._Shard()
        shard.add(text)
        shard.rows = [pa.array([{"id": 1}])]
        assert shard.batch(3).column(2).to_pylist() == [words]
    for kind in ("<i4", "<u4", "<i8", "u1"):
        for values in ([], [0], [200, 7]):
            narrow = np.array(values, kind)
            assert packing.pack(narrow) == packing.pack(narrow.astype("<u8"))
            assert packing.unpack(packing.pack(narrow)).tolist() == values
    numbers = np.arange(1_000_000, dtype=np.int32) % 250
    tracemalloc.start()
    packing.pack(numbers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000


def test_a_shard_holds_no_python_object_for_a_word(monkeypatch):
    """300,000 distinct words of 100 texts, and every white space there is, as `bytes.split` takes them apart."""
    monkeypatch.setattr(audit, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("At", (), {"partitionId": lambda _: 0})())}))
    monkeypatch.setattr(audit, "CHUNK_BYTES", 100_000, raising=False)
    texts = [" ".join(f"w{i}" for i in range(n, n + 3_000)) for n in range(0, 300_000, 3_000)]
    texts += [None, "", " \n", "".join(f"a{chr(c)}é{chr(c)} " for c in range(0x21)), "a\x85b\u2003c w1 w1", "w5 a w1"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    (made,) = audit._shards(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    words = made.column(2).to_pylist()[0]
    ends, terms, counts = (packing.unpack(made.column(i)[0].as_py()).tolist() for i in (3, 4, 5))
    assert len(set(words)) == len(words) and len(ends) == len(texts)
    for text, start, end in zip(texts, [0, *ends], ends, strict=False):
        found = {words[t]: n for t, n in zip(terms[start:end], counts[start:end])}
        split = [w.decode() for w in (text or "").encode().split()]
        assert found == {w: split.count(w) for w in found} and set(found) == set(split)
        assert len(found) == end - start


def test_a_shard_holds_no_text_that_it_has_read(monkeypatch):
    """Batches are freed one by one, though the rows beside their texts wait for the shard to end."""
    monkeypatch.setattr(audit, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("At", (), {"partitionId": lambda _: 0})())}))
    texts, held = ["word " * 200_000] * 2, []
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], ["id", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    stored = sink.getvalue().to_pybytes()

    def batches():
        for _ in range(8):
            yield pa.ipc.open_stream(io.BytesIO(stored)).read_next_batch()
            held.append(pa.total_allocated_bytes())

    (made,) = audit._shards(batches())
    assert made.column(1).to_pylist() == [[{"id": 1}, {"id": 2}] * 8]
    assert held[-1] - held[0] < 2_000_000


def test_totals_without_a_second_worker(spark):
    """The row sums of a shard come from the worker that numbers it, and are those of its matrix."""
    rows = [(1, "a b a"), (2, ""), (3, None), (4, "b\u00e9 c"), (4, "b\u00e9 c"), (None, "a " * 30)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    args = df, F.coalesce("text", F.lit("")), {"id": F.col("id")}
    expected = audit.row_totals(audit.document_terms(*args)[0])
    found = audit.document_totals(*args)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    labels = spark.createDataFrame([(1, 1, 0)], "id long, quality int, toxic int")
    plan = audit.failures(df.withColumn("lang", F.lit("x")), labels, "id", "text", "lang")._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
