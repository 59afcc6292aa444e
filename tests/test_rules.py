"""Boundary rows of tax, validation, routing, enrichment, evaluation and period rules."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallywork.operators import ledger, resolve as R, review, rules as K, sections as S, tax
from tallywork.plans import evaluation as E, periods as P, runs

BAND = ("rate decimal(5,2), vat_rate decimal(5,2), taxable_base decimal(14,2), base decimal(14,2), tax_amount decimal(14,2), "
        "vat_amount decimal(14,2), amount decimal(14,2), tax_code string")
INVOICE = ("id long, supplier_id long, total_with_vat decimal(14,2), total_without_vat decimal(14,2), vat_total decimal(14,2), "
           f"field_confidence map<string,double>, vat_breakdown array<struct<{BAND}>>")


def band(rate=None, base=None, amount=None, code=None, alt=None):
    d = lambda x: None if x is None else D(str(x))
    return (d(rate), d(alt), None, d(base), None, None, d(amount), code)


@pytest.fixture
def invoices(rows):
    return lambda *data: rows(INVOICE, *data)


def invoice(id=1, supplier=1, gross="123.00", net="100.00", vat="23.00", fc=None, bands=None):
    d = lambda x: None if x is None else D(x)
    return (id, supplier, d(gross), d(net), d(vat), fc or {}, bands)


def test_bands(spark, invoices):
    df = invoices(invoice(1, bands=None), invoice(2, bands=[]), invoice(3, bands=[
        band(23, 100, 23, " mwst "), band(alt=19, base=1), band(base=5), band(0, None, None, "zz"), band(7)]))
    got = tax.tax_rows(df).collect()
    assert [(r.invoice_id, r.tax_code, float(r.rate), float(r.tax_amount), r.is_valid) for r in got] == [
        (3, "MwSt", 23.0, 23.0, True), (3, "IVA", 19.0, 0.0, False), (3, "IVA", 0.0, 0.0, True), (3, "IVA", 7.0, 0.0, False)]


@pytest.fixture
def outcome(rows, invoices):
    def run(inv, items=(), unresolved=False, first=False):
        checked = K.checks(invoices(inv), rows("invoice_id long, gross_amount decimal(14,2)", *items),
                           rows("invoice_id long, needs_review boolean", (inv[0], unresolved)))
        route = K.route(checked, rows("supplier_id long, first_time boolean", (inv[1] or 0, first)))
        failed = {r.rule_code[:2] for r in K.rule_rows(checked).where("NOT passed").collect()}
        r = route.first()
        return failed, r.auto_accept, {x.reason_code: x.priority for x in r.reasons}
    return run


def test_clean_invoice_is_accepted(outcome):
    assert outcome(invoice(bands=[band(23, 100, 23)]), [(1, D("123.00"))]) == (set(), True, {})


def test_tolerance_is_two_cents(outcome):
    assert outcome(invoice(gross="123.02"))[0] == set()
    assert outcome(invoice(gross="123.03"))[0] == {"R1"}


def test_items_and_bands_must_add_up(outcome):
    failed, _, reasons = outcome(invoice(bands=[band(23, 100, 22)]), [(1, D("100.00")), (1, None)])
    assert failed == {"R2", "R5"} and reasons == {"math_mismatch": 1}


def test_absent_parts_pass(outcome):
    assert outcome(invoice(gross=None))[:2] == (set(), True)


def test_only_bad_rate(outcome):
    failed, _, reasons = outcome(invoice(bands=[band(21, 100, 23)]))
    assert failed == {"R6"} and reasons == {"vat_invalid": 1}


def test_confidence_limit_is_strict(outcome):
    assert outcome(invoice(fc={"currency": 0.7}))[1] is True
    assert outcome(invoice(fc={"currency": 0.69}))[2] == {"low_confidence": 2}


def test_amount_limit_is_strict(outcome):
    assert outcome(invoice(gross="10000.00", net="9977.00"))[2] == {}
    assert outcome(invoice(gross="10000.01", net="9977.00"))[2] == {"amount_above_threshold": 1}


def test_first_time_counts_only_when_resolved(outcome):
    assert outcome(invoice(), first=True)[2] == {"first_time_supplier": 2}
    failed, _, reasons = outcome(invoice(), unresolved=True, first=True)
    assert failed == {"R8"} and reasons == {"supplier_unresolved": 1}


@pytest.mark.parametrize("s,v,t,want,gap", [("800.00", "184.00", "990.00", "mismatch", "6"), ("1", "2", "3", "exact", "0"),
                                            (None, "1", "2", "skipped", None), ("x", "1", "2", "unreadable", None),
                                            ("1.000000001", "0", "1", "mismatch", "0.000000001"), ("0.1000000000000000000000001", "0", "0.1", "unreadable", None)])
def test_exact_totals(rows, s, v, t, want, gap):
    r = K.exact_totals(rows("subtotal string, vat_amount string, total string", (s, v, t))).first()
    assert r.outcome == want and r.valid is (want in ("exact", "skipped")) and r.discrepancy == (None if gap is None else D(gap))


def test_issuer_enrichment(rows):
    suppliers = rows("id long, nif string, legal_name string, commercial_name string, country string",
                     (1, "502030712", None, "Padaria Central", "PT"), (2, "516315243", None, "Obras Norte", "PT"), (3, "502030712", None, "Fora SL", "ES"))
    data = [(1, "PT516315242", "x", None), (2, None, "Padaria Centrl", None), (3, None, "Padaria Central", "502030712"),
            (4, "516315243", "Padaria Central", "502030712"), (5, "516315243", "Nobody Known Here", None), (6, "DE351574837", "x", None),
            (7, " ", "Padaria Central", None), (8, "502030712", "x", "PT 502030712"), (9, None, "Obras Norte", None), (10, None, None, None)]
    got = {r.id: r.issuer_nif for r in R.enrich_issuer(rows("id long, issuer_nif string, issuer_name string, receiver_nif string", *data), suppliers).collect()}
    assert got == {1: "516315242", 2: "502030712", 3: None, 4: "502030712", 5: None, 6: "DE351574837", 7: None, 8: None, 9: None, 10: None}


def test_resolution_cascade(rows):
    suppliers = rows("id long, nif string, normalized_name string", (1, "111", "padaria central"), (2, "222", "obras norte"), (3, "333", "padaria central"))
    aliases = rows("supplier_id long, alias_text string, alias_type string", (2, "999", "nif"), (1, "A. Manual", "manual"), (2, "a manual", "name_exact"),
                   (1, "777", "manual"))
    data = [(1, "222", "padaria central"), (2, "999", None), (3, None, "A MANUAL!"), (4, None, "Padaria, Central"), (5, None, "padaria centrol"),
            (6, None, "obras nxxte"), (7, "777", None), (8, None, None), (9, "", "--")]
    req = rows("document_id long, input_nif string, input_name string", *data)
    got = {r.document_id: (r.supplier_id, r.method, r.needs_review) for r in R.resolve(req, suppliers, aliases).collect()}
    assert got == {1: (2, "nif_exact", False), 2: (2, "alias", False), 3: (2, "alias", False), 4: (1, "fuzzy", False), 5: (1, "fuzzy", False),
                   6: (2, "fuzzy_review", True), 7: (None, "new_supplier", True), 8: (None, "new_supplier", True), 9: (None, "new_supplier", True)}
    manual = {r.document_id: r.method for r in R.resolve(req, suppliers, aliases, manual_ids=True).collect()}
    assert manual[7] == "alias"


def test_classification_defaults(rows):
    inv = rows("id long, supplier_id long", (1, 5), (2, 6), (3, None))
    prof = rows("supplier_id long, gl_account_id long, category_id long, match_count int", (5, 9, 1, 2), (5, 8, None, 7))
    got = {r.invoice_id: (r.gl_account_code, r.gl_account_id, r.category_slug, r.confidence) for r in ledger.classify(
        inv, prof, rows("id long, code string", (8, "6221"), (9, "6222"), (1, "62")), rows("id long, slug string", (1, "rent"))).collect()}
    assert got == {1: ("6221", 8, None, 0.9), 2: ("62", 1, None, 0.5), 3: ("62", 1, None, 0.5)}


def test_decisions_latest_wins(rows):
    t = lambda h: datetime(2024, 1, 1, h)
    dec = rows("invoice_id long, decision string, reason string, reviewed_by string, reviewed_at timestamp",
               (1, "rejected", "no", "a", t(1)), (1, "edited", None, "b", t(2)), (2, "strange", "", "c", t(1)))
    q = rows("id long, invoice_id long, status string", (10, 1, "pending"), (11, 1, "in_review"), (12, 3, "pending"))
    out = review.apply_decisions(dec, q, rows("id long, processing_status string", (1, "x"), (2, "y"), (3, "z")))
    assert {r.id: r.processing_status for r in out["invoices"].collect()} == {1: "ok", 2: "ok", 3: "z"}
    assert {r.id: (r.status, r.assigned_to) for r in out["queue"].collect()} == {10: ("resolved", "b"), 11: ("in_review", None), 12: ("pending", None)}
    assert out["reviews"].count() == 3


def test_sections(rows):
    none = []
    h = rows("document_id long, supplier_name string, supplier_nif string, receiver_nif string, invoice_number string, invoice_date string, errors array<string>",
             (1, "A", "502030712", "123", "F1", "2024-01-01", none), (2, "B", None, None, None, None, ["h"]))
    line = "array<struct<description:string,quantity:string,unit_price:string,subtotal:string>>"
    i = rows(f"document_id long, line_items {line}, errors array<string>",
             (1, [("a", "1", None, "3.00"), None, ("b", "1", "1", "x")], none), (2, None, ["l"]))
    t = rows("document_id long, subtotal string, vat_amount string, total string, currency string, vat_rate int, errors array<string>",
             (1, "3", "1", "4.00", "", 19, none), (2, None, None, None, None, None, ["t"]))
    hg, lc, tg = S.header_guards(h), S.line_checks(i), S.totals_guards(t)
    assert [len(r.warnings) for r in hg.orderBy("document_id").collect()] == [1, 2]
    assert [(len(r.line_items), len(r.warnings)) for r in lc.orderBy("document_id").collect()] == [(2, 2), (0, 0)]
    a, b = S.reconcile(hg, lc, tg).orderBy("document_id").collect()
    assert (a.total, a.currency, a.vat_rate, len(a.warnings), a.errors) == (D("4.000000"), "EUR", None, 1, [])
    assert (b.supplier_name, b.currency, b.line_items, b.errors) == (None, None, None, ["h", "l", "t"])


def test_pages_of_a_document_are_one_row(rows):
    df = rows("d long, p int, t string", (1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, None))
    got = [(r.d, r.raw_text, r.page_count) for r in S.assembled_pages(df, "d", "p", "t").orderBy("d").collect()]
    assert got == [(1, "a\nb\nc", 3), (2, "", 1)]
    many = S.assembled_pages(rows("d long, p int, t string", *[(1, i, str(i)) for i in range(1500)]), "d", "p", "t").collect()
    assert len(many) == 1 and many[0].raw_text.split("\n") == [str(i) for i in range(1500)]


def test_periods(rows):
    ends = [(datetime(2024, m, 28), v) for m, v in ((1, 10.0), (2, 20.0), (3, None), (6, 5.0))]
    df = rows("created_at timestamp, value double", *ends)
    month = P.metric_by_period(df, period="ME").collect()
    assert [(r.period, float(r.sum), r["count"]) for r in month] == [
        (date(2024, 1, 31), 10.0, 1), (date(2024, 2, 29), 20.0, 1), (date(2024, 3, 31), 0.0, 0), (date(2024, 4, 30), 0.0, 0),
        (date(2024, 5, 31), 0.0, 0), (date(2024, 6, 30), 5.0, 1)]
    assert month[2]["mean"] is None
    assert [(r.period, r["count"]) for r in P.metric_by_period(df, period="QE").collect()] == [(date(2024, 3, 31), 2), (date(2024, 6, 30), 1)]
    assert P.metric_by_period(df, period="W").first().period == date(2024, 1, 28)
    assert P.metric_by_period(df, period="W").count() == 23
    with pytest.raises(ValueError):
        P.period_end(F.col("created_at"), "D")


def test_savings_and_reduction(rows):
    r = P.hours_saved(rows("manual_minutes int, automated_minutes int", (480, 120))).first()
    assert (r.hours_saved, float(r.savings_pct)) == (6.0, 75.0)
    got = P.error_reduction(rows("before long, after long", (100, 25), (10, 20), (0, 5))).collect()
    assert [(float(x.reduction_pct), x.absolute_change) for x in got] == [(75.0, 75.0), (-100.0, -10.0), (0.0, -5.0)]


def test_empty_runs_give_zeros(rows):
    empty = rows("status string, token_usage string")
    r = runs.run_summary(empty, rows("status string", ("pending",))).first()
    assert (r.total_runs, float(r.success_rate), r.total_tokens, r.pending_approvals) == (0, 0.0, 0, 0)


def test_parity_of_labelled_case(rows):
    schema = "case_id long, supplier_name string, supplier_nif string, invoice_number string, invoice_date string, subtotal string, vat_amount string, total string, vat_rate string, currency string"
    want = rows(schema, (1, "TechSolutions Lda", "500123454", "FT 2026/001", "2026-05-01", "1000.00", "230.00", "1230.00", "23", "EUR"),
                (2, None, "1", "2", "3", "4", "5", "6", "7", "8"))
    assert E.parity_gate(E.parity(want, want)).first().passed is True
    other = rows(schema, (1, "TechSolutions", None, "FT 2026/001", "2026-05-01", "1000.0", "230.00", "1230.00", "23", "EUR"))
    r = E.parity(other, want).first()
    assert r.supplier_name == pytest.approx(26 / 30) and r.supplier_nif == 0.0 and r.subtotal == 0.0 and r.total == 1.0


def test_scores_skip_and_manual_review(rows):
    s = "case_id long, invoice_number string, total_with_vat decimal(14,2), total_without_vat decimal(14,2), vat_total decimal(14,2)"
    e = rows(s + ", manual_review array<string>", (1, " A ", D("1.00"), D("1.00"), D("0"), ["vat_total"]), (2, "B", None, None, None, []))
    scored = E.case_scores(e, rows(s, (1, "a", D("1.02"), D("1.00"), D("9"))))
    assert {(r.field, r.correct) for r in E.field_scores(scored).collect()} == {("invoice_number", True), ("total_with_vat", True), ("total_without_vat", True)}
    o = E.overall_accuracy(scored).first()
    assert (o.total_cases, o.evaluated, o.skipped, o.pass_count, o.math_error_rate) == (2, 1, 1, 1, 100.0)


def test_new_suppliers_keep_every_name(spark):
    from pyspark.sql import functions as F
    from tallywork.operators.resolve import new_suppliers
    names = spark.range(200_000).select(F.lit("new_supplier").alias("method"), F.lit(None).cast("string").alias("input_nif"),
                                        F.concat(F.lit("Name "), F.col("id").cast("string")).alias("input_name"))
    assert new_suppliers(names).count() == 200_000


@pytest.mark.parametrize("blank", ["\n", "\t", "\u00a0", " \r\n"])
def test_blanks_of_every_kind_are_trimmed(rows, blank):
    from pyspark.sql import functions as F
    from tallywork.functions.names import strip
    from tallywork.functions.taxid import normalize_tax_id
    from tallywork.functions.units import normalize_unit
    r = rows("x string, y string", (f"{blank}kg{blank}", blank)).select(
        normalize_unit(F.col("x")).alias("unit"), normalize_tax_id(F.col("y")).alias("nif"), strip(F.col("x")).alias("s")).first()
    assert (r.unit, r.nif, r.s) == ("KG", None, "kg")


def test_unmapped_items_carry_their_count(rows):
    from tallywork.operators.ledger import unmapped_items
    got = unmapped_items(rows("invoice_id long, description string, product_catalog_id long", (1, "a", None), (2, "a", None), (3, "b", 5), (4, None, None)))
    assert sorted((r.invoice_id, r.occurrence_count) for r in got.collect()) == [(1, 2), (2, 2), (4, 1)]


def test_ids_are_checked_once_for_warning_and_value(spark, rows):
    df = rows("supplier_nif string, receiver_nif string", ("502030712", "516315242"), ("302030712", None), ("502030713", "12345678"), ("502030712\n", "abcdefghi"))
    out = S.header_guards(df)
    assert [tuple(r) for r in out.select("supplier_nif", "receiver_nif", F.size("warnings")).collect()] == [
        ("502030712", "516315242", 0), (None, None, 2), (None, None, 2), ("502030712\n", None, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("exists(") == 2


def test_names_are_normalised_once_and_only_if_they_differ(spark, rows):
    texts = ["Acme, Lda.", "ACME lda", "Acmee Lda", "", "  ", "Other\u00a0Name", "other name", "Acme Lda Porto", "Acne Lida", "\u0301x"]
    pairs = rows("e string, a string", *[(x, y) for x in texts for y in texts], (None, "x"), (None, None))
    x, y = (F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")) for c in ("e", "a"))
    edits, longest = F.levenshtein(x, y), F.greatest(F.length(x), F.length(y))
    e, a = F.col("e"), F.col("a")
    both = lambda same: F.when(e.isNull() & a.isNull(), True).when(e.isNull() | a.isNull(), False).otherwise(same)
    for made, want in ((E.close_name(e, a), both(x.contains(y) | y.contains(x) | (edits <= 3))),
                       (E.close_description(e, a), both((edits <= 5) | (edits * 5 <= longest)))):
        assert pairs.where(~made.eqNullSafe(want)).count() == 0
        assert str(made).count("regexp_replace") == 2
