"""Totals from amounts against a search over all pairs."""

from hypothesis import HealthCheck, given, settings, strategies as st

from partflow.operators.extraction import recover_totals

AMOUNT = st.integers(1, 400)


def plain(sub, total, amounts, tax, shipping):
    """The first pair of distinct amounts that fills the gap; else the gap gives what is missing."""
    if tax and shipping or total <= sub:
        return tax, shipping
    gap, seen = total - sub, list(dict.fromkeys(amounts))
    fit = [a for a in seen if a <= gap]
    for i, a in enumerate(fit):
        for b in fit[i + 1 :]:
            if a + b == gap:
                return min(a, b), max(a, b)
    if not tax and shipping:
        return gap - shipping, shipping
    if not shipping and tax:
        return tax, gap - tax
    return tax, shipping


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(AMOUNT, AMOUNT, st.lists(AMOUNT, max_size=12), st.sampled_from([0, 0, 7]), st.sampled_from([0, 0, 9])), min_size=1, max_size=40))
def test_pairs_of_amounts(spark, cases):
    money = lambda n: f"{n // 100}.{n % 100:02d}"
    rows = [(i, "\n".join([f"Subtotal {money(sub)}", *map(money, amounts), f"Total Amount {money(sub + more)}"]), tax / 100, ship / 100) for i, (sub, more, amounts, tax, ship) in enumerate(cases)]
    found = {r.doc_id: (round(r.tax * 100), round(r.shipping * 100)) for r in recover_totals(spark.createDataFrame(rows, "doc_id long, text string, tax double, shipping double")).collect()}
    assert found == {i: plain(sub, sub + more, amounts, tax, ship) for i, (sub, more, amounts, tax, ship) in enumerate(cases)}


def test_ten_thousand_amounts_in_one_document(spark):
    lines = [f"{n}.11" for n in range(10_000)] + ["77.00", "5.00"]
    text = "\n".join(["Sub Total 900000.00", *lines, "Total Amount 900082.00"])
    row = recover_totals(spark.createDataFrame([(1, text, 0.0, 0.0)], "doc_id long, text string, tax double, shipping double")).first()
    assert (row.tax, row.shipping) == (5.0, 77.0)


def test_labels_of_totals_are_looked_up_once(spark, capsys):
    """A text is searched once for each label, whatever the plan does with the results; a label inside a word is none."""
    texts = ["Surtax: 9.00\nTax: 2.50\nairship 7\nShipping & handling charge: $1,004.00", "tax amount 3\nship: 4", "xtax 1\n_ship 2", "é tax=1.5 éship 2.5", None]
    docs = spark.createDataFrame([(i, x, 0.0, 0.0) for i, x in enumerate(texts)], "doc_id long, text string, tax double, shipping double")
    made = recover_totals(docs)
    made.explain()
    plan = capsys.readouterr().out
    assert plan.count("ship(?") == 1 and plan.count("tax(?") == 1
    assert {r.doc_id: (r.tax, r.shipping) for r in made.collect()} == {0: (2.5, 1004.0), 1: (3.0, 4.0), 2: (0.0, 0.0), 3: (1.5, 2.5), 4: (0.0, 0.0)}
