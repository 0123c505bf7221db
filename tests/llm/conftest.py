import pytest
from pyspark.sql.types import StructType

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows, extra=""):
        full = [(i, t, (more or ["en"])[0], "s", None if t is None else len(t)) for i, t, *more in rows]
        schema = StructType.fromDDL(DOCS + extra)
        return spark.createDataFrame([r + ("x",) * (len(schema) - 5) for r in full], schema).repartition(3)

    return make
