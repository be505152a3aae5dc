"""Long licence expressions, the mix on any partitioning, articles that keep what is theirs."""

import time

import pytest
from pyspark.sql import functions as F

from panelspark.llm import html, licenses, mixing


def test_long_licence_expressions_take_linear_time():
    began = time.time()
    names = {f"l{i}" for i in range(20000)}
    clauses = " and ".join(f"(l{2 * i} or l{2 * i + 1})" for i in range(10000))
    got = licenses.scan_text(f"x\nSPDX-License-Identifier: {clauses}\ny")
    assert set(got["labels"].split(",")) == names
    got = licenses.scan_text("SPDX-License-Identifier: " + " or ".join(sorted(names)))
    assert set(got["labels"].split(",")) == names
    licenses.scan_text("SPDX-License-Identifier: " + "(" * 5000 + "a" + ")" * 5000)
    assert time.time() - began < 3


def test_repeats_of_the_mix_do_not_depend_on_partitions(spark):
    """Rows with the same key and size but other texts, sources or languages."""
    rows = [(i % 3, f"{'ab'[i % 2]}{i // 5} " * 4, "s" + "xy"[i % 2], "en" if i % 4 else "de") for i in range(40)]
    rows += [(7, "one two three", "sx", "en")] * 5 + [(None, "a b c d", None, "fr"), (None, "d c b a", "sx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    runs = []
    for n in (1, 5, 40):
        out = mixing.take_mix(df.repartition(n), weights=(3, 1))
        runs.append(sorted(map(str, out.select(*sorted(out.columns)).collect())))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 5


@pytest.mark.parametrize("page,want", [
    ("<section class=related><p>One</p></section><p>Two</p>", ["One", "Two"]),
    ("<div class='search'><p>One</p></div><div class=\"share widget\">Two</div>", ["One", "Two"]),
    ("<div class=reply>One</div><div class=signup>Two</div><div class=banner>Three</div>", ["One", "Two", "Three"]),
    ("<div class=comments><p>no</p></div><div class=notice>no</div><div class=ad>no</div><div class=sidebar>no</div><p>One</p>", ["One"]),
    ("<div role=banner>no</div><div role=navigation>no</div><div role=complementary>no</div><p>One</p>", ["One"]),
    ("<p title=don't>It's here</p>", ["It's here"]),
    ("<p title='a>b' data-x=\"c>d\">One</p>", ["One"]),
    ("<a href=x=\"y>One</a>", ["One"]),
    ("<p>One</p><p class=\"x>Two", ["One"]),
])
def test_articles_keep_what_is_theirs(page, want):
    got = html.page_lines(f"<body><nav>no</nav><article>{page}")
    assert [x for x, _ in got] == want


def test_nested_elements_take_linear_time():
    began = time.time()
    n = 30000
    got = html.page_lines("<article>" + "<div>" * n + "text" + "</div>" * n + "<p>after</p></article>")
    assert got == [("text", True), ("after", True)]
    html.page_lines("<article>" + "<div><p>x" * n)
    assert time.time() - began < 6


def test_mix_and_pages_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, repeats int")
    assert mixing.take_mix(df).count() == 0
    assert mixing.take_mix(df.unionByName(spark.createDataFrame([(1, None, "a", 5)], df.schema))).filter(F.col("repeats") > 3).count() == 0
