import pyarrow.parquet as pq
import pytest
from brute import SF


@pytest.fixture(scope="session")
def documents():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture()
def frame(spark):
    """Documents with an extra column for each name that an operator uses inside."""

    def make(rows, schema="doc_id bigint, text string", extra=("h", "doc", "pos", "places", "label", "count", "node", "root", "length", "words")):
        df = spark.createDataFrame(rows, schema).repartition(3)
        for name in extra:
            if name not in df.columns:
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make
