from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tradelens.functions.period import Period  # noqa: E402
from tradelens.sources.contract import SCHEMAS, Tables  # noqa: E402
from tradelens.sources.dimensions import bill_type_en  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    from tradelens.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app_name="tradelens-tests")
    yield s
    s.stop()


JAN = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 31))


def d(day: int, hour: int = 10, minute: int = 0, second: int = 0, month: int = 1, year: int = 2024):
    return dt.datetime(year, month, day, hour, minute, second)


BASE = dict(
    goods=[dict(goods_id=1, goods_code="G1", goods_name="Goods one", model="M1", class_id=1,
                sale_price=10, ref_cost=6),
           dict(goods_id=2, goods_code="G2", goods_name="Goods two", model="M2", class_id=2,
                sale_price=4, ref_cost=2)],
    goods_class=[dict(class_id=1, class_code="C1", class_name="Class one"),
                 dict(class_id=2, class_code="C2", class_name="Class two")],
    party=[dict(party_id=10, code="P10", name="Ann", function_id=30700, no_use=0),
           dict(party_id=11, code="P11", name="Ann", function_id=30700, no_use=0),
           dict(party_id=12, code="P12", name="Bob", function_id=30700, no_use=0)],
    bill_type=[dict(type_id=t, name=f"type{t}") for t in
               (1101, 1102, 1104, 1199, 1201, 1202, 1204, 1207, 1301, 1302, 1402, 1501)],
    stock_site=[dict(stock_id=1, dept_id=101)],
)


def _value(v, dtype):
    if v is None:
        return None
    if isinstance(dtype, T.DecimalType):
        return Decimal(str(v))
    return v


def make_tables(spark: SparkSession, **rows) -> Tables:
    """Contract tables from small lists of dicts; tables not given are BASE or empty."""
    t = Tables()
    for name, schema in SCHEMAS.items():
        data = rows.get(name, BASE.get(name, []))
        if name == "bill_type_en" and name not in rows:
            t[name] = bill_type_en(spark)
            continue
        tuples = [tuple(_value(r.get(f.name), f.dataType) for f in schema.fields) for r in data]
        t[name] = spark.createDataFrame(tuples, schema)
    return t


def sale_bill(bill_id, party_id, date, bill_type=1201, use_id=0, amount=None, code=None):
    return dict(bill_id=bill_id, party_id=party_id, bill_date=date, bill_type=bill_type, use_id=use_id,
                bill_amount=amount, bill_code=code or f"B{bill_id}")


def line(bill_id, goods_id, qty, amount, price=None, disc=1):
    return dict(bill_id=bill_id, goods_id=goods_id, qty=qty, price=price if price is not None else amount,
                amount=amount, disc_rate=disc)


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture
def no_broadcast(spark):
    """Spark's own size-based broadcast is off: every join shuffles, as at scale."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    conf = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in conf.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)
