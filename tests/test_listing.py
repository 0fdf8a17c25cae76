"""Chains of tables, joins that ask only whether, selection, issues, sections, numbered formulas, context of hits."""

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from texloom.operators import corpus, facade, pages
from texloom.plans.registry import Tables
from texloom.sources import chains


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_of(spark, sf_dir):
    t = Tables(spark, sf_dir)
    absent, lacking, empty, full = lambda: t.nothing, lambda: t.labels.select("no_such_column"), lambda: t.labels.where("false"), lambda: t.labels
    assert chains.first_of([absent, lacking, full]).count() == t.labels.count()
    assert chains.first_of([absent, empty, full]).count() == 0  # there, if empty
    assert chains.first_of([absent, empty, full], skip_empty=True).count() == t.labels.count()
    assert chains.first_of([full, empty], skip_empty=True).count() == t.labels.count() and chains.first_of([empty], skip_empty=True).count() == 0
    with pytest.raises(AnalysisException):
        chains.first_of([full and absent, lacking])
    with pytest.raises(ValueError):
        chains.first_of([])


def test_first_of_each(spark):
    make = lambda data: spark.createDataFrame(data, "k int, v string")
    a, b, c = make([(1, "a"), (1, "a"), (None, "a")]), make([(1, "b"), (2, "b"), (2, "c")]), make([(2, "d"), (3, "d"), (None, "d")])
    assert rows(chains.first_of_each([a, b, c], "k")) == sorted([(1, "a"), (1, "a"), (None, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "d")], key=repr)
    assert rows(chains.first_of_each([a.where("false"), b.where("false"), c], "k")) == rows(c)


def test_complete(spark):
    ids = lambda *xs: spark.createDataFrame([(x, "x") for x in xs], "doc_id int, doc string")
    got = corpus.complete({"a": ids(1, 1, 2, 3, None), "b": ids(3, 1, 1, None)}, {"m": ids(3, 3, 9), "n": ids()})
    assert got.columns == ["doc_id", "has_m", "has_n"] and rows(got) == [(1, False, False), (3, True, False)]
    assert rows(corpus.complete({"a": ids(1, 1)}, {})) == [(1,)] and corpus.complete({"a": ids(), "b": ids(1)}, {}).count() == 0


def test_eligible(spark):
    docs = spark.createDataFrame([(1, "text", ["a", "b"]), (2, "", ["a"]), (3, None, ["a"]), (4, "text", []), (5, "text", None), (6, "more", ["c"])], "id int, abstract string, authors array<string>")
    ids = lambda **k: [r[0] for r in rows(corpus.eligible(docs, F.col("abstract"), F.col("authors"), **k).select("id"))]
    assert ids() == [1, 6] and ids(least_authors=2) == [1] and ids(require_abstract=False) == [1, 2, 3, 6] and ids(least_authors=0) == [1, 4, 5, 6]
    assert ids(predicate=F.col("id") > 1) == [6] and ids(predicate=lambda b: b["authors"].map(lambda x: "c" in x)) == [6]
    assert ids(predicate=lambda b: pd.Series([None] * len(b), index=b.index, dtype="object")) == []


def test_issues(spark):
    facts = spark.createDataFrame([(1, 5), (2, None), (3, 50), (3, 5)], "doc_id int, n int")
    found = corpus.issues(facts, {"small": F.col("n") < 10, "tiny": F.col("n") < 6, "none": F.col("n").isNull()})
    assert rows(found) == sorted([(1, ["small", "tiny"]), (2, ["none"]), (3, ["small", "tiny"])], key=repr)
    assert rows(corpus.distinct_issues(found)) == [("none", 1, 2), ("small", 2, 1), ("tiny", 2, 1)]
    assert corpus.distinct_issues(found.where("false")).count() == 0


def test_equations(spark):
    page = (
        '<script>"<math>no</math>"</script><!-- <math>no</math> --><math alttext="a &lt; b">x</math><p>see (7) there</p><math title="t"><mi>y</mi></math><span>(1)</span>'
        '<div class="ltx_equation big"><math><mi>z</mi> <mo>+</mo></math><td>(2)\n</td></div><span class="inline-math">w</span><span class="x">no</span><math alttext="(3)">(3)</math>'
    )
    data = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>(1)</p><math>q")], "page_id int, html string")
    assert rows(pages.equations(data)) == sorted([
        (1, "math", 0, "a < b", "(1)"), (1, "math", 1, "t", "(1)"), (1, "math", 2, "z +", "(2)"), (1, "math", 3, "(3)", None), (1, "div", 0, "z +", "(2)"), (1, "span", 0, "w", None), (4, "math", 0, "q", None),
    ], key=repr)


def test_section_or_start(spark):
    page = "<html><head><title>Results</title></head><body>Before<h2>Our <b>RESULTS</b></h2><p>one</p><h3>Part</h3>two<h2>End</h2>three<h2>Results again</h2></body></html>"
    data = spark.createDataFrame([(1, page), (2, "<body>" + "ab " * 1000 + "</body>"), (3, None), (4, ""), (5, "<h1>results</h1>")], "page_id int, html string")
    got = {r.page_id: (r.found, r.body) for r in pages.section_or_start(data, "results").collect()}
    assert got == {1: (True, "one Part two"), 2: (False, ("ab " * 1000)[:2000]), 3: (None, None), 4: (False, ""), 5: (True, "")}
    assert pages.section_or_start(data, "absent").where("page_id = 1").first().body.startswith("Before Our RESULTS one")


def test_context_when_asked(spark):
    chunks = spark.createDataFrame([("a", 1, "red fox runs", "before", None), ("b", 2, "red fox", None, "after"), ("c", 2, "blue", "", "")], "chunk_id string, doc_id int, text string, context_before string, context_after string")
    s = facade.Search(chunks)
    for kind in ("semantic", "keyword"):
        assert {"context_before", "context_after"} & set(s.query("red fox", kind).rows.columns) == set()
        shown = s.query("red fox", kind, with_context=True).rows
        assert {(r.chunk_id, r.context_before, r.context_after) for r in shown.collect()} == {("a", "before", None), ("b", None, "after")} and "citations" not in shown.columns
    assert [r.chunk_id for r in s.query("red fox", k=1, within=chunks.where("doc_id = 2"), with_context=True).rows.collect()] == ["b"]
