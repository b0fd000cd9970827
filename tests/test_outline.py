"""Hierarchies of headings whose places are told by people, not by the code."""

import pytest

from strataq.operators import chunking

CONTRACT = """MASTER SERVICES AGREEMENT

ARTICLE IV
Term and Termination

4.1 Initial Term
Commences on the Effective Date.

4.2 Termination for Cause
Either party may terminate.

(a) Material breach
Not cured within thirty days.

(b) Insolvency
Upon any bankruptcy filing.

(b) Change of Control
On any change of control.

§ 12.3 Governing Law
Laws of Delaware.

§ 12.5 Notices
All notices in writing.
"""
CASES = {
    "series": (CONTRACT, {
        "Term and Termination": "MASTER SERVICES AGREEMENT", "Initial Term": "MASTER SERVICES AGREEMENT > Term and Termination", "Termination for Cause": "MASTER SERVICES AGREEMENT > Term and Termination",
        "Material breach": "MASTER SERVICES AGREEMENT > Term and Termination > Termination for Cause", "Change of Control": "MASTER SERVICES AGREEMENT > Term and Termination > Termination for Cause",
        "Governing Law": "MASTER SERVICES AGREEMENT", "Notices": "MASTER SERVICES AGREEMENT",
    }),
    "chain": ("§ 12 General\n§ 12.3 Governing Law\n§ 12.4 Notices\n", {"Governing Law": "General", "Notices": "General"}),
    "same number": ("CHAPTER 4\nScope of Work\n\nARTICLE 4\nPayment Terms\n", {"Payment Terms": ""}),
    "inserted": ("§ 12 General\n§ 12A Inserted Provision\n§ 12.1 Detail\n§ 13 Other\n", {"Inserted Provision": "", "Detail": "General", "Other": ""}),
    "deep": ("1. Scope\n1.1 Purpose\n1.1.1 Detail\n1.1.2 More\n1.2 Limits\n2. Terms\n", {"Detail": "Scope > Purpose", "More": "Scope > Purpose", "Limits": "Scope", "Terms": ""}),
    "container": ("PART I\nGeneral\n\nARTICLE 2\nScope\n\nPART II\nSpecial\n", {"Scope": "General", "Special": ""}),
    "a closed number": ("1. Alpha\n# Head\n### Sub\n1.1 Xenon\n", {"Sub": "Head", "Xenon": "Alpha"}),
    "letters": ("4.2 Termination\n(a) First\n(b) Second\n", {"First": "Termination", "Second": "Termination"}),
}


@pytest.mark.parametrize("case", CASES)
def test_parents(spark, case):
    text, wanted = CASES[case]
    rows = chunking.outline(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    found = {r["title"]: r["path"].rpartition(" > ")[0] for r in rows}
    assert {t: found[t] for t in wanted} == wanted
    by_line = {r["line"]: r for r in rows}
    assert all((r["parent"] is None) == (" > " not in r["path"]) for r in rows) and all(r["path"].startswith(by_line[r["parent"]]["path"]) for r in rows if r["parent"])
    roots = chunking.tree([r.asDict() for r in sorted(rows, key=lambda r: r["line"])])
    assert [x["title"] for x in roots] == [r["title"] for r in sorted(rows, key=lambda r: r["line"]) if r["parent"] is None]


@pytest.mark.parametrize(("items", "wanted"), [("h i", [8, 9]), ("iv v", [4, 5]), ("u v", [21, 22]), ("b i", [2, 1]), ("c d", [3, 4]), ("xcix c", [99, 100]), ("a b c", [1, 2, 3]), ("i ii iii", [1, 2, 3])])
def test_letters_and_numerals(items, wanted):
    rows = [{"line": i, "level": 6, "kind": "lettered", "number": n, "title": "x"} for i, n in enumerate(items.split())]
    assert [r["ordinal"][0] for r in chunking.nested(rows)] == wanted


def test_citations(spark):
    from pyspark.sql import functions as F

    from strataq.operators import enrichment

    text = "[todo] [TBD] [Unreleased] [x] [2019smith] [@Knuth84] [knuth84] [v1.2.3] [1.x] [12] [ab] [Smith:2001](page 3) [a b]"
    row = spark.createDataFrame([(text,)], "t string").select(enrichment.citations(F.col("t")).alias("c")).first()
    assert row["c"] == ["2019smith", "Knuth84", "Smith:2001"]
