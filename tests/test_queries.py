"""Each registered query against its SQL equivalent."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import compare

from quillsift.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_suppressor_matrix_beyond_ascii(spark, tmp_path):
    """Customers whose token decodes to valid UTF-8 beyond ASCII, which their SQL doesn't take; the scanner does."""
    import base64
    from hashlib import md5

    from pyspark.sql import functions as F

    from quillsift.operators import detect

    keys = [26836, 44686, 52372, 100483]
    pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64())}), tmp_path / "customer.parquet")
    made = compare(spark, str(tmp_path), catalogue.queries()["suppressor_matrix"], catalogue.oracle_sql()["suppressor_matrix"])
    assert len(made) == len(keys)
    tokens = [base64.b64encode(b"-----BEGIN CERTIFICATE-----\nMIIDdzCC").decode() + md5(str(k).encode()).hexdigest() for k in keys]
    heads = [base64.b64decode(t[:64]) for t in tokens]
    assert all(h.decode() and not h.isascii() for h in heads)
    found = spark.createDataFrame([(t,) for t in tokens], "t string").select(detect.base64_public(F.col("t")), detect.base64_public(F.col("t"), True)).collect()
    assert [tuple(r) for r in found] == [(True, False)] * len(keys)


def test_entry_has_rows():
    import __spark_entry__

    assert {"rule_distribution", "yaml_manifest_scan"} <= set(__spark_entry__.queries())
