from random import Random

import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from tabular_insights.llm import hyperminhash
from tabular_insights.session import stage


def test_texts_go_to_the_exact_check_instead_of_hashes(spark, monkeypatch):
    """What is staged for the exact check is smaller than a hash of 8 bytes for each shingle."""
    words = [[f"w{i}" for i in Random(n // 3).choices(range(977), k=400)] for n in range(60)]
    for n, text in enumerate(words):
        text[n] = f"other{n}"
    df = spark.createDataFrame([(n, " ".join(text)) for n, text in enumerate(words)], "doc_id long, text string")
    staged = {}

    def kept(frame, name, *more):
        return staged.setdefault(name, stage(frame, name, *more)) if name == "sets" else stage(frame, name, *more)

    monkeypatch.setattr(hyperminhash, "stage", kept)
    found = hyperminhash.near_duplicates(df)
    assert rows(found.select("doc_id", "component_id")) == sorted(((n, n // 3 * 3) for n in range(60)), key=repr)
    sets = staged["sets"]
    sizes = [F.octet_length(f.name) for f in sets.schema if f.dataType.typeName() in ("string", "binary")]
    total, shingles = sets.agg(F.sum(sum(sizes)), F.sum("n")).first()
    assert sets.count() == 60 and total < 8 * shingles


def test_a_pair_is_verified_on_its_texts():
    """Sketches alone would link the pair; the sets of the texts do not reach the threshold."""
    one, other = (" ".join(f"w{i}" for i in range(a, a + 50)) for a in (0, 20))
    (same,) = hyperminhash.shingle_sets([one])
    columns = {
        "group": [1, 1], "one": [0, 0], "other": [0, 0], "side": [2, 2], "node": [3, 4], "part": [3, 4],
        "n": [len(same)] * 2, "sketch": [hyperminhash.sketch(same).tobytes()] * 2,
    }
    assert hyperminhash._connected(pa.table(columns), 80).to_pylist() == [{"src": 4, "dst": 3}]
    assert hyperminhash._connected(pa.table(columns | {"text": [one, other]}), 80).num_rows == 0
    assert hyperminhash._connected(pa.table(columns | {"text": [one, one]}), 80).num_rows == 1
