"""What the tasks of the similarity join hold."""

from collections import Counter

import numpy as np
import pyarrow as pa

from placewise.llm import jaccard, queries, units
from placewise.llm.text import shingle_sets, text_blocks


def test_the_last_stages_model_is_let_go():
    units.loaded(("some", "model"), lambda: object())
    rows = pa.RecordBatch.from_pydict({"t": ["a b c d e f"]})
    assert [len(s) for _, sets in jaccard._sets(iter([rows]), 5) for s in sets] == [2]
    assert units._loaded == {}


def test_sketch_counts_shingles_of_several_sets(spark):
    queries.on_workers(spark)
    draw = np.random.default_rng(6)
    texts = [" ".join(draw.choice(list("abc"), draw.integers(1, 9))) for _ in range(200)] + ["", None, "a", "a"]
    sketch = jaccard.frequency_sketch(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), 5).value
    (_, data, offsets), = text_blocks(pa.RecordBatch.from_pydict({"t": texts}), "t")
    sets = {s.tobytes(): s for s in shingle_sets(data, offsets) if len(s)}
    counts = Counter(int(v) for s in sets.values() for v in s)
    want = np.zeros(jaccard.SKETCH, np.int32)
    for v, n in counts.items():
        if n >= jaccard.HEAVY:
            want[v % jaccard.SKETCH] += n
    assert want.any() and (sketch == want).all()
