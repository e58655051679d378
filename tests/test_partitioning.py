"""Results must not depend on how the data is partitioned: every registered
query gives the same rows with 3 and with 17 shuffle partitions (different
range blocks, hash buckets and fold boundaries)."""

import pytest

from conftest import SF_SMALL
from tools.oracle_check import norm

import __spark_entry__ as E

NAMES = sorted(n for n in E.queries() if not n.startswith("stream_"))


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()),
                  key=lambda r: tuple("" if v is None else v for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_partition_count_does_not_change_results(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = rows(E.queries()[name](spark, SF_SMALL))
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = rows(E.queries()[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b
