"""Derive the ERP contract tables from the TPC-H-like test tables.

This is test-input plumbing, written with the DataFrame API so it scales with
the input: every contract table is a projection / filter / union over
``orders``, ``lineitem``, ``events``, ``part``, ``customer``, ``supplier``
and ``nation``. Keys get ``+1`` because test keys start at 0 while goods id 0
means "no goods" in the source system. The rules are the ones in
``FIXTURES.md`` §2; ``tradelens.oracle`` restates them in SQL for DuckDB.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradelens.operators.chain import bill_browse
from tradelens.sources.contract import MONEY, RATE, Tables, conform
from tradelens.sources.dimensions import bill_type_en

# Fixed values of the derivation (FIXTURES §2).
POS_DAY_SHIFT = 9861          # moves January 2024 events to January 1997
SUPPLIER_PARTY_BASE = 1_000_000
NEVER_SOLD_GOODS_BASE = 5_000_000
CLASS_IDS = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
GOODS_CLASSES = ((1, "EC", "ECONOMY"), (2, "LA", "LARGE"), (3, "ME", "MEDIUM"),
                 (4, "PR", "PROMO"), (5, "SM", "SMALL"))
STOCK_SITES = ((1, 101), (2, 102))
BILL_TYPE_NAMES = ((1101, "n1"), (1102, "n2"), (1199, "n3"), (1201, "n4"), (1202, "n5"),
                   (1207, "n6"), (1301, "n7"), (1302, "n8"), (1501, "n9"))
PAY_BILL_TYPE = 1501
SUPPLIER_FUNCTION = 30600


def _m(col: Column) -> Column:
    return col.cast(MONEY)


def _dec(text: str) -> Column:
    return F.lit(Decimal(text))


def _code(prefix: str, num: Column) -> Column:
    return F.concat(F.lit(prefix), num.cast("string"))


def _plus_days(col: Column, days: int) -> Column:
    if days == 0:
        return col
    sign = "-" if days < 0 else ""
    return col + F.expr(f"INTERVAL '{sign}{abs(days)}' DAY")


def _cash_party(orders_alias: str = "") -> Column:
    return F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).otherwise(
        F.col("o_custkey") + 1)


# customers' contact columns: these prefixes and the customer key
CONTACT_PREFIXES = (("address", "Street "), ("postcode", "Z"), ("contact", "Contact "), ("tele", "T"),
                    ("mobile", "M"), ("fax", "F"), ("email", "mail@"), ("website", "www."), ("company", "Company "))


def _stock_bill_specs(k: Column) -> list[dict]:
    status = F.col("o_orderstatus")
    cash = _cash_party()
    supplier = F.lit(SUPPLIER_PARTY_BASE) + k % 10
    f_status = status == "F"
    return [
        dict(type=1201, offset=0, where=None, days=0, party=cash,
             use_id=F.when(status == "P", F.lit(-1)).when(status == "O", F.lit(0))
             .when(f_status, F.lit(80_000_000) + k + 1),
             use_type=F.when(f_status, F.lit(1302)),
             rel=F.when(f_status, _code("B1302-", k + 1))),
        dict(type=1199, offset=10_000_000, where=k % 4 == 0, days=7, party=cash,
             use_id=F.lit(0), use_type=None, rel=None),
        dict(type=1102, offset=20_000_000, where=k % 3 == 0, days=0, party=supplier,
             use_id=F.lit(60_000_000) + k + 1, use_type=F.lit(1301),
             rel=_code("B1301-", k + 1)),
        dict(type=1104, offset=30_000_000, where=k % 10 == 1, days=0, party=cash,
             use_id=F.lit(0), use_type=None, rel=None),
        dict(type=1204, offset=40_000_000, where=k % 10 == 2, days=0, party=cash,
             use_id=F.lit(0), use_type=None, rel=None),
        dict(type=1101, offset=50_000_000, where=k % 3 == 0, days=3, party=supplier,
             use_id=F.lit(20_000_000) + k + 1, use_type=F.lit(1102),
             rel=_code("B1102-", k + 1)),
        dict(type=1202, offset=70_000_000, where=k % 5 == 0, days=2, party=cash,
             use_id=k + 1, use_type=F.lit(1201), rel=_code("B1201-", k + 1)),
    ]


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def _of_each_spec(src: DataFrame, specs: list[dict]) -> DataFrame:
    """One row per source row and spec that applies to it, from one scan, with the spec's ``bill_type``.

    Only the type is exploded: the other columns pass by, so those that a query doesn't
    use are pruned, and casts made in ``src`` run once per source row.
    """
    types = [F.lit(s["type"]) if s["where"] is None else F.when(s["where"], F.lit(s["type"])) for s in specs]
    return src.select("*", F.explode(F.array_compact(F.array(*types))).alias("bill_type"))


def _by_type(specs: list[dict], value) -> Column:
    """``value(spec)`` of the row's type; None: NULL."""
    out = F
    for s in specs:
        v = value(s)
        out = out.when(F.col("bill_type") == s["type"], F.lit(v) if v is None or isinstance(v, int) else v)
    return out


def _stock_bills_ext(orders: DataFrame) -> DataFrame:
    """stock_bill plus the browse-view link columns (use_bill_type, relation_from)."""
    k = F.col("o_orderkey")
    specs = _stock_bill_specs(k)
    rows = _of_each_spec(orders.withColumn("bill_amount", _m(F.col("o_totalprice"))), specs)
    return rows.select(
        (_by_type(specs, lambda s: s["offset"]) + k + 1).cast("bigint").alias("bill_id"),
        (k % 7 + 1).cast("bigint").alias("dept_id"),
        _by_type(specs, lambda s: s["party"].cast("bigint")).alias("party_id"),
        (k % 11 + 1).cast("bigint").alias("handler_id"),
        _code("memo ", k % 100).alias("memo"),
        _by_type(specs, lambda s: _plus_days(F.col("o_orderdate"), s["days"])).alias("bill_date"),
        F.concat(F.lit("B"), F.col("bill_type").cast("string"), F.lit("-"), (k + 1).cast("string")).alias("bill_code"),
        "bill_type",
        _by_type(specs, lambda s: s["use_id"].cast("bigint")).alias("use_id"),
        "bill_amount",
        _by_type(specs, lambda s: s["use_type"]).cast("int").alias("use_bill_type"),
        _by_type(specs, lambda s: s["rel"]).cast("string").alias("relation_from"))


def _stock_lines(lineitem: DataFrame) -> DataFrame:
    k = F.col("l_orderkey")
    specs = [{**s, "where": s["where"] & (F.col("l_returnflag") == "R")} if s["type"] == 1199 else s
             for s in _stock_bill_specs(k)]
    lines = lineitem.select(
        "l_orderkey", "l_returnflag", (F.col("l_partkey") + 1).alias("goods_id"),
        _m(F.col("l_quantity")).alias("qty"), _m(F.col("l_extendedprice")).alias("price"),
        (F.lit(1) - F.col("l_discount")).cast(RATE).alias("disc_rate"))
    return conform(_of_each_spec(lines, specs).select(
        (_by_type(specs, lambda s: s["offset"]) + k + 1).cast("bigint").alias("bill_id"),
        "goods_id", "qty", "price", F.col("price").alias("amount"), "disc_rate"), "stock_line")


def _pos(events: DataFrame, hist: bool) -> tuple[DataFrame, DataFrame]:
    e = events.filter((F.col("event_type") == "purchase") &
                      (F.col("event_id") % 2 == (1 if hist else 0)))
    eid = F.col("event_id")
    n = F.lit(1) + eid % 5
    amount = _m(_m(F.col("value")) * n)
    bill_cols = [
        (eid + 1).alias("bill_id"),
        (eid % 3 + 1).alias("stock_id"),
        F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_id") + 1)
        .alias("party_id"),
        _plus_days(F.col("ts"), -POS_DAY_SHIFT).alias("bill_date"),
        eid.alias("sequence_id"),
        (eid % 13 + 1).alias("handler_id"),
        _code("till ", eid % 20).alias("memo"),
    ]
    if hist:
        bill_cols += [amount.alias("bill_amount"), _code("R", eid).alias("custom_code")]
    bills = conform(e.select(*bill_cols), "pos_bill_hist" if hist else "pos_bill")
    lines = conform(e.select(
        (eid + 1).alias("bill_id"),
        (eid % 200 + 1).alias("goods_id"),
        _m(n).alias("qty"),
        _m(F.col("value")).alias("price"),
        amount.alias("amount"),
        F.lit(1).cast(RATE).alias("disc_rate"),
    ), "pos_line_hist" if hist else "pos_line")
    return bills, lines


def derive_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All contract tables, lazily derived from ``sf_dir/<name>.parquet``."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    orders, lineitem, events = read("orders"), read("lineitem"), read("events")
    part, customer, supplier, nation = read("part"), read("customer"), read("supplier"), read("nation")
    k = F.col("o_orderkey")
    t = Tables()

    bills_ext = _stock_bills_ext(orders)
    t["stock_bill"] = conform(bills_ext, "stock_bill")
    t["stock_line"] = _stock_lines(lineitem)
    t["stock_bill_browse"] = bill_browse(bills_ext, t["stock_line"])

    t["adj_bill"] = conform(orders.filter(k % 10 == 5).select(
        (F.lit(90_000_000) + k + 1).alias("bill_id"),
        _cash_party().alias("party_id"),
        F.col("o_orderdate").alias("bill_date"),
        _code("B1402-", k + 1).alias("bill_code"),
        (k % 7 + 1).alias("dept_id"),
        (k % 11 + 1).alias("handler_id"),
        _code("adjusted ", k % 100).alias("memo"),
        F.lit(1402).alias("bill_type"),
        _m(F.col("o_totalprice")).alias("bill_amount"),
        F.when(F.col("o_orderstatus") == "P", F.lit(-1)).otherwise(F.lit(0)).alias("use_id"),
    ), "adj_bill")

    t["pos_bill"], t["pos_line"] = _pos(events, hist=False)
    t["pos_bill_hist"], t["pos_line_hist"] = _pos(events, hist=True)
    eid = F.col("event_id")
    hist_events = events.filter((F.col("event_type") == "purchase") & (eid % 2 == 1))
    t["pos_collect_hist"] = conform(hist_events.select(
        (eid + 1).alias("bill_id"),
        F.when(eid % 4 == 1, _m(F.col("value"))).otherwise(_m(F.lit(0))).alias("collect_amount"),
    ), "pos_collect_hist")

    t["stock_site"] = spark.createDataFrame(list(STOCK_SITES), "stock_id bigint, dept_id bigint")

    class_map = F.create_map(*[x for name, cid in CLASS_IDS.items()
                               for x in (F.lit(name), F.lit(cid))])
    parts_goods = part.select(
        (F.col("p_partkey") + 1).alias("goods_id"),
        _code("P", F.col("p_partkey") + 1).alias("goods_code"),
        F.col("p_name").alias("goods_name"),
        F.col("p_brand").alias("model"),
        F.element_at(class_map, F.col("p_type")).alias("class_id"),
        _m(F.col("p_retailprice")).alias("sale_price"),
        (_m(F.col("p_retailprice")) * _dec("0.6")).alias("ref_cost"),
    )
    never_sold = nation.select(
        (F.lit(NEVER_SOLD_GOODS_BASE) + F.col("n_nationkey")).alias("goods_id"),
        _code("X", F.col("n_nationkey")).alias("goods_code"),
        F.lit(None).cast("string").alias("goods_name"),
        F.lit(None).cast("string").alias("model"),
        F.lit(1).alias("class_id"),
        _dec("1").alias("sale_price"),
        _dec("0.6").alias("ref_cost"),
    )
    t["goods"] = conform(parts_goods, "goods").unionByName(conform(never_sold, "goods"))
    t["goods_class"] = spark.createDataFrame(
        list(GOODS_CLASSES), "class_id int, class_code string, class_name string")

    customers = customer.join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    t["party"] = conform(customers.select(
        (F.col("c_custkey") + 1).alias("party_id"),
        _code("C", F.col("c_custkey") + 1).alias("code"),
        F.col("c_name").alias("name"),
        *[_code(prefix, F.col("c_custkey")).alias(column) for column, prefix in CONTACT_PREFIXES],
        F.col("n_name").alias("country"),
        _code("City ", F.col("c_custkey") % 50).alias("city"),
        F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 365 as int))").alias("create_date"),
        F.lit(30700).alias("function_id"),
        F.when(F.col("c_acctbal") < 0, F.lit(1)).otherwise(F.lit(0)).alias("no_use"),
    ), "party").unionByName(conform(supplier.select(
        (F.lit(SUPPLIER_PARTY_BASE) + F.col("s_suppkey")).alias("party_id"),
        _code("S", F.col("s_suppkey")).alias("code"),
        F.col("s_name").alias("name"),
        F.lit(SUPPLIER_FUNCTION).alias("function_id"),
        F.lit(0).alias("no_use"),
    ), "party"))

    t["bill_type"] = spark.createDataFrame(list(BILL_TYPE_NAMES), "type_id int, name string")
    t["bill_type_en"] = bill_type_en(spark)

    t["order_bill"] = conform(
        orders.filter(k % 3 == 0).select(
            (F.lit(60_000_000) + k + 1).alias("bill_id"),
            _plus_days(F.col("o_orderdate"), -5).alias("bill_date"),
            _m(F.col("o_totalprice")).alias("bill_amount"))
        .unionByName(orders.filter(F.col("o_orderstatus") == "F").select(
            (F.lit(80_000_000) + k + 1).alias("bill_id"),
            _plus_days(F.col("o_orderdate"), -5).alias("bill_date"),
            _m(F.col("o_totalprice")).alias("bill_amount"))),
        "order_bill")
    lk = F.col("l_orderkey")
    t["order_line"] = conform(
        lineitem.filter(lk % 3 == 0).select(
            (F.lit(60_000_000) + lk + 1).alias("bill_id"), _m(F.col("l_quantity")).alias("qty"))
        .unionByName(lineitem.select(
            (F.lit(80_000_000) + lk + 1).alias("bill_id"), _m(F.col("l_quantity")).alias("qty"))),
        "order_line")

    pos_payers = events.filter((F.col("event_type") == "purchase") & (eid % 8 == 1))
    t["pay_bill"] = conform(
        orders.filter(k % 2 == 0).select(
            (k + 1).alias("pay_bill_id"),
            _code("V-", k + 1).alias("bill_code"),
            _plus_days(F.col("o_orderdate"), 10).alias("bill_date"),
            F.when(k % 7 == 0, F.lit(-1)).otherwise(F.lit(0)).alias("use_id"))
        .unionByName(orders.filter(k % 4 == 0).select(
            (F.lit(100_000_000) + k + 1).alias("pay_bill_id"),
            _code("W-", k + 1).alias("bill_code"),
            _plus_days(F.col("o_orderdate"), 20).alias("bill_date"),
            F.lit(5).alias("use_id")))
        .unionByName(pos_payers.select(
            (F.lit(200_000_000) + eid + 1).alias("pay_bill_id"),
            _code("X-", eid + 1).alias("bill_code"),
            F.lit(None).cast("timestamp_ntz").alias("bill_date"),
            F.lit(0).alias("use_id")))
        .withColumn("bill_type", F.lit(PAY_BILL_TYPE)),
        "pay_bill")
    total = _m(F.col("o_totalprice"))
    t["pay_line"] = conform(
        orders.filter(k % 2 == 0).select(
            (k + 1).alias("pay_bill_id"), (k + 1).alias("use_id"),
            F.lit(1201).alias("use_bill_type"), _m(total * _dec("0.5")).alias("cleared_amount"))
        .unionByName(orders.filter(k % 4 == 0).select(
            (F.lit(100_000_000) + k + 1).alias("pay_bill_id"), (k + 1).alias("use_id"),
            F.lit(1201).alias("use_bill_type"), _m(total * _dec("0.25")).alias("cleared_amount")))
        .unionByName(pos_payers.select(
            (F.lit(200_000_000) + eid + 1).alias("pay_bill_id"), (eid + 1).alias("use_id"),
            F.lit(1207).alias("use_bill_type"), _m(F.col("value")).alias("cleared_amount"))),
        "pay_line")

    # our definition of the sold-goods view: codes of goods that have a stock line
    t["sold_goods"] = conform(
        t["goods"].join(t["stock_line"].select("goods_id").distinct(), "goods_id", "left_semi")
        .select("goods_code"), "sold_goods")
    return t
