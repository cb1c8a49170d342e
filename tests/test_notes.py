"""Approval blocks and line rules by hand."""

import pytest

from twinleg.operators import notes as N

TEXT = """prose
source: alpha_feed
approved: yes
source: beta
a line between
approved: yes
source: gamma_rates\t
 \t
approved:   TODO(x) later
Source: delta
approved: yes
source: Upper
approved: yes"""


@pytest.fixture(scope="module")
def known(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "source: alpha_feed\r\napproved: no\r\n"), (3, None), (4, ""), (5, "source: last")], "doc_id long, text string")
    return N.approvals(N.approval_blocks(docs))


def test_blocks_and_lines(spark):
    docs = spark.createDataFrame([(1, TEXT), (1, TEXT), (3, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in N.approval_blocks(docs).collect())
    assert got == [(1, 2, "alpha_feed", "yes")] * 2 + [(1, 7, "gamma_rates", "TODO(x)")] * 2


def test_last_block_counts(known):
    assert {tuple(r) for r in known.collect()} == {("alpha_feed", "no", 2), ("gamma_rates", "pending", 1)}


def test_unknown_sources_are_pending_and_near_keys_listed(spark, known):
    asked = spark.createDataFrame([("gamma_rates",), ("Alpha-rates",), ("nothing_of_it",), ("to_feed",), (None,), ("to_feed",)], "source string")
    got = {r["source"]: tuple(r)[1:] for r in N.approval_status(asked, known).collect()}
    assert got == {"gamma_rates": ("pending", True, ""), "Alpha-rates": ("pending", False, "alpha_feed,gamma_rates"), "nothing_of_it": ("pending", False, ""), "to_feed": ("pending", False, "alpha_feed")}


def test_gate(spark):
    known = spark.createDataFrame([("a", "yes", 1), ("b", "no", 1)], "source string, status string, blocks long")
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "source string, n int")
    assert N.approved_only(rows, known).count() == N.require_approved(rows, known).count() == 2
    for bad in ("b", "c", None):
        more = rows.unionAll(spark.createDataFrame([(bad, 3)], "source string, n int"))
        assert N.approved_only(more, known).count() == 2
        with pytest.raises(Exception, match="source .* is (no|pending)"):
            N.require_approved(more, known).collect()


def test_line_findings(spark):
    long = "ACME Partners held four million shares of it at the last count"
    lines = [long, long + ", dated 2024", "# " + long, "> " + long, "short acme", "  " + long + ", we know  ", "nobody is named here, though the line is long enough"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")
    got = sorted((r["line"], r["rule"]) for r in N.line_findings(docs, ["Acme"], r"(?i)\bwe know\b", r"dated \d{4}").collect())
    assert got == [(1, "uncited"), (6, "forbidden"), (6, "uncited")]
    assert N.line_findings(docs, [], "x", "y").count() == 0


def test_undisclosed(spark):
    docs = spark.createDataFrame([(1, "an appetite line"), (2, "An APPETITE, by proxy"), (3, None), (4, "none")], "doc_id long, text string")
    assert [tuple(r) for r in N.undisclosed(docs, {"proxy": (["appetite"], ["Proxy"])}).collect()] == [(1, "proxy")]
