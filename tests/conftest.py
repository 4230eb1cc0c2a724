import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ticketlab import constants as K  # noqa: E402

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ticketlab.session import get_spark

    s = get_spark("local[4]", app_name="ticketlab-tests", shuffle_partitions=8)
    yield s
    s.stop()


DEFAULT_ROW = {
    "id": "i1", "case_number": "00000001", "account_name": "Alpha", "group_id": "G1",
    "subject": "subject", "description": "description", "product_area": "Area",
    "product_feature": "Feature", "pod_name": "POD", "created_at": "2025-01-28 10:00:00",
    "closed_at": None, "first_response_at": None, "case_type": "Bug", "case_owner": "Owner",
    "age_days": "1", "is_escalated": "false", "csat": "0", "priority": "P1", "rca": "Cause",
    "status": "Open",
}
RAW_COLUMNS = list(DEFAULT_ROW)


def raw_frame(spark, rows):
    """All-string raw tickets; unspecified fields take DEFAULT_ROW values."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField(c, StringType(), True) for c in RAW_COLUMNS])
    data = []
    for i, r in enumerate(rows):
        d = dict(DEFAULT_ROW)
        d["case_number"] = f"{i:08d}"
        d.update(r)
        data.append(tuple(d[c] for c in RAW_COLUMNS))
    return spark.createDataFrame(data, schema)


@pytest.fixture
def make_raw(spark):
    return lambda rows: raw_frame(spark, rows)


__all__ = ["K", "raw_frame", "SF0001"]
