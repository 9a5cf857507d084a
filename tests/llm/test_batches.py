"""What a Python worker gets at a time is bounded by bytes, without a session setting."""

import pandas as pd
from pyspark.sql import functions as F

MOST = 80 << 20


def test_arrow_batches_of_long_texts_are_bounded_by_bytes(spark):
    """10,000 texts of 100 KB, a gigabyte: no batch of a mapInArrow or a pandas UDF holds more than 80 MB of it."""
    df = spark.range(0, 10_000, 1, 4).select(F.expr("repeat('x', 100000)").alias("t"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    rows = df.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in rows) == 10_000 and max(r.bytes for r in rows) <= MOST

    @F.pandas_udf("long")
    def size(t: pd.Series) -> pd.Series:
        return pd.Series([int(t.str.len().sum())] * len(t))

    assert df.select(F.max(size("t"))).first()[0] <= MOST
