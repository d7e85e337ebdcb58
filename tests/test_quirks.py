"""Hand-computed micro fixtures, one per visible quirk (FIXTURES.md §3)."""

from __future__ import annotations

from decimal import Decimal

from conftest import JAN, d, line, make_tables, rows, sale_bill

from tradelens.operators.facts import sale_facts
from tradelens.plans import reports as R

D = Decimal


def test_m1_returns_negate_amount_not_qty(spark):
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 10, d(5)), sale_bill(2, 10, d(6), bill_type=1199)],
                    stock_line=[line(1, 1, 5, 50), line(2, 1, 2, 20)])
    (r,) = rows(R.product_sale(t, JAN))
    assert r["total_amount"] == D("30.00")
    assert r["total_sale_quantity"] == D("7.00")
    assert r["reference_cost_amount"] == D("42")
    assert r["reference_profit"] == D("-12")
    assert r["reference_profit_rate"] == -0.4


def test_m2_adjustments_and_lineless_bills(spark):
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 12, d(3)), sale_bill(2, 10, d(4))],
                    stock_line=[line(2, 1, 1, 10)],
                    adj_bill=[dict(bill_id=90, party_id=10, bill_date=d(4), bill_type=1402,
                                   bill_amount=15, use_id=0)])
    summary = {r["customer_name"]: (r["total_quantity"], r["total_amount"])
               for r in rows(R.customer_summary(t, JAN))}
    assert summary == {"Ann": (D("1.00"), D("25.00")), "Bob": (None, None)}
    prod = rows(R.customer_product(t, JAN))
    assert [(r["customer_name"], r["product_code"], r["total_quantity"], r["total_amount"]) for r in prod] == \
        [("Ann", "G1", D("1.00"), D("10.00"))]


def test_m3_midnight_after_end_is_inside(spark):
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 10, d(1, 0, month=2)), sale_bill(2, 10, d(1, 0, 0, 1, month=2))],
                    stock_line=[line(1, 1, 1, 10), line(2, 1, 1, 11)])
    got = rows(R.customer_detail(t, JAN))
    assert [r["amount"] for r in got] == [D("10.00")]


def _payment(pay_bill_id, bill_id, amount, use_id=0, bill_type=1201):
    bill = dict(pay_bill_id=pay_bill_id, bill_type=1501, bill_code=f"V{pay_bill_id}",
                bill_date=d(25), use_id=use_id)
    pl = dict(pay_bill_id=pay_bill_id, use_id=bill_id, use_bill_type=bill_type, cleared_amount=amount)
    return bill, pl


def test_m4_whole_extra_day_in_receivables(spark):
    b1, l1 = _payment(501, 1, 5)
    b2, l2 = _payment(502, 2, 5)
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 10, d(1, 18, month=2), amount=50),
                                sale_bill(2, 10, d(2, 0, month=2), amount=60)],
                    pay_bill=[b1, b2], pay_line=[l1, l2])
    assert [r["receivable_amount"] for r in rows(R.receivable_summary(t, JAN))] == [D("50.00")]
    assert [r["receivable_amount"] for r in rows(R.receivable_detail(t, JAN))] == [D("50.00")]


def test_m5_equal_chains_collapse_and_order_qty_adds_up(spark):
    browse = [
        dict(bill_id=1, bill_type=1101, bill_code="PI", bill_date=d(5), bill_amount=100, qty=7,
             use_id=20, use_bill_type=1102, relation_from="REL"),
        dict(bill_id=2, bill_type=1101, bill_code="PI", bill_date=d(5), bill_amount=100, qty=7,
             use_id=20, use_bill_type=1102, relation_from="REL"),
        dict(bill_id=20, bill_type=1102, bill_code="WE", bill_date=d(4), bill_amount=100, qty=7,
             use_id=60, use_bill_type=1301, relation_from="PO-1"),
    ]
    t = make_tables(spark, stock_bill_browse=browse,
                    order_bill=[dict(bill_id=60, bill_date=d(1), bill_amount=100)],
                    order_line=[dict(bill_id=60, qty=3), dict(bill_id=60, qty=4)])
    got = rows(R.bill_relation_purchase(t, JAN))
    assert len(got) == 1
    r = got[0]
    assert r["quantity_3"] == D("14.00")
    assert (r["bill_name_1"], r["bill_name_2"], r["bill_name_3"]) == \
        ("PurchaseInvoice", "WarehouseEntry", "PurchaseOrder")
    assert r["bill_code_3"] == "PO-1" and r["qty_label_1"] == "Qty:"


def test_m6_customers_group_by_name_and_cash(spark):
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 10, d(3)), sale_bill(2, 11, d(3)),
                                sale_bill(3, 99, d(3)), sale_bill(4, None, d(3))],
                    stock_line=[line(1, 1, 1, 10), line(2, 1, 1, 20), line(3, 1, 1, 5), line(4, 1, 1, 7)])
    got = {r["customer_name"]: r["total_amount"] for r in rows(R.customer_summary(t, JAN))}
    assert got == {"Ann": D("30.00"), "General(Cash)": D("12.00")}


def test_m7_one_receivable_per_payment_status(spark):
    b1, l1 = _payment(501, 1, 30, use_id=0)
    b2, l2 = _payment(502, 1, 50, use_id=5)
    t = make_tables(spark, stock_bill=[sale_bill(1, 10, d(3), amount=100)],
                    pay_bill=[b1, b2], pay_line=[l1, l2])
    got = sorted((r["paid_amount"], r["not_paid_amount"]) for r in rows(R.receivable_summary(t, JAN)))
    assert got == [(D("30.00"), D("70.00")), (D("50.00"), D("50.00"))]
    assert len(rows(R.receivable_detail(t, JAN))) == 2


def test_m8_unpaid_vanish_from_summary_but_not_detail(spark):
    b2, l2 = _payment(502, 2, 40, use_id=-1)
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 10, d(3), amount=100), sale_bill(2, 10, d(4), amount=80)],
                    pay_bill=[b2], pay_line=[l2])
    assert rows(R.receivable_summary(t, JAN)) == []
    got = sorted((r["is_pay_canceled"], r["paid_amount"], r["bill_code_2"])
                 for r in rows(R.receivable_detail(t, JAN)))
    assert got == [("", None, None), ("Canceled", D("40.00"), "V502")]


def test_m9_cancelled_sale_is_flagged_not_dropped(spark):
    b1, l1 = _payment(501, 1, 10)
    t = make_tables(spark, stock_bill=[sale_bill(1, 10, d(3), use_id=-1, amount=100)],
                    stock_line=[line(1, 1, 1, 100)], pay_bill=[b1], pay_line=[l1])
    (r,) = rows(R.receivable_summary(t, JAN))
    assert (r["is_bill_canceled"], r["paid_amount"], r["not_paid_amount"]) == \
        ("Canceled", D("10.00"), D("90.00"))
    assert rows(R.customer_summary(t, JAN)) == []


def test_m10_cash_receivables_dropped(spark):
    b1, l1 = _payment(501, 1, 10)
    t = make_tables(spark, stock_bill=[sale_bill(1, None, d(3), amount=100)], pay_bill=[b1], pay_line=[l1])
    assert rows(R.receivable_summary(t, JAN)) == []
    assert rows(R.receivable_detail(t, JAN)) == []


def test_m11_import_totals_ignore_period_and_cancel(spark):
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 10, d(5), amount=50),
                                sale_bill(2, 12, d(5, year=2023), bill_type=1102, use_id=-1),
                                sale_bill(3, 12, d(6), bill_type=1102),
                                sale_bill(4, 12, d(6), bill_type=1104),
                                sale_bill(5, 12, d(7), bill_type=1204)],
                    stock_line=[line(1, 1, 5, 50), line(2, 1, 10, 0), line(3, 1, 4, 0),
                                line(4, 1, 3, 0), line(5, 1, 2, 0)])
    (r,) = rows(R.product_sale(t, JAN))
    assert r["total_wareentry_quantity_cp"] == D("4.00")
    assert r["total_import_quantity"] == D("15.00")
    assert r["move_rate"] == 1 / 3


def test_m12_zero_import_gives_null_rate(spark):
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 10, d(5)), sale_bill(2, 12, d(2), bill_type=1102),
                                sale_bill(3, 12, d(3), bill_type=1204)],
                    stock_line=[line(1, 2, 1, 3), line(2, 2, 5, 0), line(3, 2, 5, 0)])
    (r,) = rows(R.product_sale(t, JAN))
    assert r["total_import_quantity"] == D("0.00") and r["move_rate"] is None
    assert r["total_wareentry_quantity_cp"] == D("5.00")


def test_m13_category_join_on_code_only_fans_out(spark):
    t = make_tables(spark,
                    goods_class=[dict(class_id=1, class_code="A", class_name="Alpha"),
                                 dict(class_id=2, class_code="A", class_name="Beta")],
                    stock_bill=[sale_bill(1, 10, d(5)), sale_bill(2, 10, d(5)),
                                sale_bill(3, 12, d(2), bill_type=1102), sale_bill(4, 12, d(2), bill_type=1102)],
                    stock_line=[line(1, 1, 1, 10), line(2, 2, 1, 10), line(3, 1, 2, 0), line(4, 2, 3, 0)])
    got = sorted((r["category_name"], r["total_import_quantity"]) for r in rows(R.product_category_sale(t, JAN)))
    assert got == [("Alpha", D("2.00")), ("Alpha", D("3.00")), ("Beta", D("2.00")), ("Beta", D("3.00"))]


def test_m14_never_sold_is_null_aware(spark):
    def codes(sold):
        t = make_tables(spark, sold_goods=[dict(goods_code=c) for c in sold])
        return [r["code"] for r in rows(R.product_never_sold(t))]

    assert codes(["G1"]) == ["G2"]
    assert codes(["G1", None]) == []
    assert codes([]) == ["G1", "G2"]


def test_m15_two_credit_rows_double_the_paid_amount(spark):
    t = make_tables(spark,
                    pos_bill_hist=[dict(bill_id=7, stock_id=1, party_id=10, bill_date=d(3), sequence_id=6,
                                        bill_amount=30, custom_code="R6")],
                    pos_collect_hist=[dict(bill_id=7, collect_amount=10), dict(bill_id=7, collect_amount=10)],
                    pay_bill=[dict(pay_bill_id=501, bill_type=1501, bill_code="X1", use_id=0)],
                    pay_line=[dict(pay_bill_id=501, use_id=7, use_bill_type=1207, cleared_amount=4)])
    (r,) = rows(R.receivable_summary(t, JAN))
    assert (r["receivable_amount"], r["paid_amount"], r["not_paid_amount"]) == \
        (D("10.00"), D("8.00"), D("2.00"))
    assert len(rows(R.receivable_detail(t, JAN))) == 2


def test_m16_zero_amount_gives_zero_rate(spark):
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 10, d(5)), sale_bill(2, 10, d(6), bill_type=1199)],
                    stock_line=[line(1, 1, 5, 50), line(2, 1, 5, 50)])
    (r,) = rows(R.product_sale(t, JAN))
    assert (r["total_amount"], r["reference_cost_amount"], r["reference_profit"], r["reference_profit_rate"]) == \
        (D("0.00"), D("60"), D("-60"), 0.0)


def test_m17_only_stock_lines_are_discounted(spark):
    t = make_tables(spark,
                    stock_bill=[sale_bill(1, 10, d(5))],
                    stock_line=[line(1, 1, 1, 9, price=10, disc=0.9)],
                    pos_bill=[dict(bill_id=5, stock_id=1, party_id=10, bill_date=d(5), sequence_id=4)],
                    pos_line=[line(5, 1, 1, 9, price=10, disc=0.9)])
    got = sorted((r["bill_type"], r["price"]) for r in rows(sale_facts(t)))
    assert got == [(1201, D("9.000000")), (1207, D("10.000000"))]


def test_m18_retail_bill_at_unknown_site_is_kept(spark):
    t = make_tables(spark,
                    pos_bill=[dict(bill_id=5, stock_id=3, party_id=10, bill_date=d(5), sequence_id=4)],
                    pos_line=[line(5, 1, 1, 9)])
    (r,) = rows(sale_facts(t))
    assert r["dept_id"] is None and r["bill_code"] == "4" and r["bill_type"] == 1207


def test_import_totals_null_goods_gets_no_period_entry(spark):
    from tradelens.operators.stock import import_by_goods, period_entry_by_goods

    t = make_tables(spark,
                    stock_bill=[sale_bill(3, 12, d(6), bill_type=1102), sale_bill(5, 12, d(7), bill_type=1204)],
                    stock_line=[line(3, None, 4, 0), line(3, 1, 2, 0), line(5, None, 1, 0)])
    got = {r["goods_id"]: (r["total_import_cp"], r["total_import"]) for r in rows(import_by_goods(t, JAN))}
    assert got == {None: (None, D("3.00")), 1: (D("2.00"), D("2.00"))}
    entries = {r["goods_id"]: r["total_import_cp"] for r in rows(period_entry_by_goods(t, JAN))}
    assert entries == {None: D("4.00"), 1: D("2.00")}
