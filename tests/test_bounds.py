"""Steps over the node table hold a bounded part of the input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.operators.extraction import filters as fl
from gleaner.operators.extraction import markdown as mk
from gleaner.operators.extraction import tree as tr
from gleaner.plans.registry import QUERIES


def test_trees_are_sent_in_bounded_chunks():
    page = ["div", "p", "b", "#", "table", "tr", "td", "#", "/table", "#"]
    batch = pa.array([page] * 5_000 + [None, [], page * 3_000])
    sent = list(tr._link(iter([batch])))
    assert sum(map(len, sent)) == len(batch)
    assert all(len(lists.flatten()) <= 2 * tr.CHUNK_TOKENS for lists in sent[:-1]), "only one page alone may be larger"
    fields = ("src", "parent", "last", "depth", "ctx", "near", "ptag", "cells", "table_pos")
    trees = [tree for lists in sent for tree in lists.to_pylist()]
    assert trees[0] == trees[4_999] == [dict(zip(fields, node)) for node in tr.link_nodes(page)]
    assert trees[5_000] == trees[5_001] == [] and len(trees[5_002]) > 3_000


def test_slots_are_sent_in_bounded_chunks():
    table = [{"row_no": r, "rowspan": 1, "colspan": 2} for r in range(1_000)]
    sent = list(mk._slots(iter([(pa.array([table] * 120), pa.array([1_000] * 120, pa.int32()))])))
    assert sum(map(len, sent)) == 120 and len(sent) > 1
    assert all(len(lists.flatten()) < mk.CHUNK_SLOTS + 2_000 for lists in sent)


def test_tasks_follow_the_bytes(spark):
    spread = spark.range(20).withColumn("times", F.lit(tr.TASK_BYTES // 10) + F.col("id") % 2)
    pages = spread.select(F.col("id").alias("page_id"), F.expr("repeat('<p>ü', int(times))").alias("html"))
    assert tr.task_count(pages) == 10 and tr.task_count(pages.unionAll(pages).unionAll(pages)) == 30
    assert tr.task_count(pages.limit(0)) == 1


def test_a_page_without_html_has_no_nodes(spark):
    pages = spark.createDataFrame([(1, None), (2, "<p>x")], "page_id long, html string")
    assert {r.page_id for r in tr.html_tokens(pages).collect()} == {2}


def test_markdown_parses_a_page_once(spark):
    html = "<p>a<table><tr><th>h<th>i<tr><td>1<td>2</table><p>b"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = mk.to_markdown(tr.html_tokens(pages))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("_link(") == 0, "read from the written strings"
    cells = mk.table_cells(tr.html_tokens(pages))
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("_link(") == 1
    assert rows.first().markdown == "a\n\n| h | i |\n| --- | --- |\n| 1 | 2 |\n\nb"


def test_blocks_are_cut_once_before_they_become_rows(spark):
    plan = QUERIES["align_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(replace(") == 2, "one cut of the stored text, one of the current text"


def test_an_answer_is_parsed_once_for_all_retry_modes(spark):
    from gleaner.operators.contracts import parse_triage
    from gleaner.operators.stages import retry_modes, retry_rows

    data = [(1, "{", "stop", None), (2, " ", "stop", None), (3, "{}", "length", None), (4, None, None, "HTTP 500")]
    answers = parse_triage(spark.createDataFrame(data, "id int, raw string, finish_reason string, error string"))
    for found in (retry_rows(answers), retry_modes(answers, ["json_object", "json_schema"])):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") <= 1, plan
    assert sorted(r.id for r in retry_rows(answers).collect()) == [1, 2, 3]
    assert [r.id for r in retry_rows(answers, "json_schema").collect()] == [3]
    both = retry_modes(answers, ["json_object", "json_schema"]).collect()
    assert sorted((r.retry_mode, r.id) for r in both) == [("json_object", 1), ("json_object", 2), ("json_object", 3), ("json_schema", 3)]


def test_requests_do_not_enter_python_as_whole_batches(spark):
    from gleaner.operators.stages import run_stage
    from gleaner.plans.stages import EchoProvider

    payload = '{"content": {"markdown": "' + "word " * 20 + '"}}'
    requests = spark.range(30).select("id", F.concat(F.lit(payload), F.repeat(F.lit(" "), (F.col("id") % 13).cast("int"))).alias("payload"))
    answers = run_stage(requests, EchoProvider(), "triage")
    assert "MapInPandas" not in answers._jdf.queryExecution().optimizedPlan().toString()
    size = {r.id: len(r.payload) for r in requests.collect()}
    found = {r.id: (r.finish_reason, r.error) for r in answers.collect()}
    told = lambda n: (None, "TimeoutError: no answer") if n % 13 == 0 else ("length" if n % 7 == 0 else "stop", None)
    assert found == {k: told(n) for k, n in size.items()}


def test_nodes_are_not_moved_again_after_the_python_step(spark):
    pages = spark.createDataFrame([(k, f"<div><table><tr><td>{k}</table></div>") for k in range(9)], "page_id long, html string")
    plan = fl.data_tables(tr.html_tokens(pages))._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") == 2, plan


def test_intervals_of_whole_pages_against_brute_force():
    rng = np.random.default_rng(3)
    pages = [rng.choice(["p", "b", "#", "div", "/div", "/b"], 40).tolist() for _ in range(20)]
    nodes = [(k, pos, n[2], pages[k][n[0]]) for k, page in enumerate(pages) for pos, n in enumerate(tr.link_nodes(page)) if pos % 7 != 3]
    found = tr.Pages(*(np.array([n[i] for n in nodes]) for i in range(3)))
    flag = np.array([n[3] == "b" for n in nodes])
    spans = [(k, pos, last) for k, pos, last, tag in nodes if tag == "b"]
    around = [[pos for k2, pos, last in spans if k2 == k and pos <= at <= last] for k, at, _, _ in nodes]
    assert found.inside(flag).tolist() == [bool(a) for a in around]
    assert found.inside(flag, or_self=False).tolist() == [any(pos < n[1] for pos in a) for a, n in zip(around, nodes)]
    assert found.latest_pos(flag).tolist() == [max((pos for k2, pos, _ in spans if k2 == k and pos <= at), default=-1) for k, at, _, _ in nodes]
    assert found.of_page(found.pos, np.maximum).tolist() == [max(n[1] for n in nodes if n[0] == k) for k, *_ in nodes]


def test_a_page_is_sorted_once_for_its_strings(spark):
    pages = spark.createDataFrame([(k, f"<ol><li><pre><code>{k}</code></pre></ol><table><tr><td>{k}</table>") for k in range(9)], "page_id long, html string")
    plan = mk._events(tr.html_tokens(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1, plan


def test_a_step_sees_whole_pages_in_any_batches(spark):
    pages = spark.createDataFrame([(k, "<p>x</p>" * (k % 5 * 7 + 1)) for k in range(60)], "page_id long, html string").coalesce(1)
    nodes = tr.html_tokens(pages)
    nodes = tr.page_step(nodes, {"row": F.col("depth")}, lambda found, args: pa.array(found.of_page(found.pos, np.maximum), pa.int32()), "int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = nodes.filter("pos = 0").select("page_id", "_found").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.page_id, r._found) for r in rows) == [(k, (k % 5 * 7 + 1) * 2 - 1) for k in range(60)]


def test_pruning_sorts_a_page_once(spark):
    html = "<h1>The title here</h1><p class=byline>By <b>Ann</b></p><div hidden>x</div><table><tr><td class=sidebar>kept</table><div class=sidebar>y</div><section><br></section><p>z"
    pages = spark.createDataFrame([(1, html), (2, html)], "page_id long, html string")
    meta = spark.createDataFrame([(1, "The title here", None), (2, None, "Bob")], "page_id long, title string, byline string")
    pruned = fl.prune_nodes(tr.html_tokens(pages), meta)
    assert pruned._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    told = tr.inner_text(pruned, ["page_id"], byline=F.max("byline")).collect()
    assert sorted((r.page_id, r.byline, r.inner_text) for r in told) == [(1, "By Ann", "keptz"), (2, "Bob", "The title hereBy Annkeptz")]


def test_rules_and_cleaning_sort_a_page_once(spark):
    pages = spark.createDataFrame([(1, "<div class=x><p>a</p></div><form><input name=q><p>b</p></form><p>c")], "page_id long, html string")
    nodes = tr.html_tokens(pages)
    ruled = fl.remove_by_rules(nodes, spark.createDataFrame([(1, ["div > p", ".x + form input"])], "page_id long, remove array<string>"))
    cleaned = fl.clean_conditionally(nodes.withColumn("data_table", F.lit(None).cast("boolean")), ["form"])
    for found in (ruled, cleaned):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert [r.tag for r in ruled.orderBy("pos").collect()] == ["div", "form", "p", "#text", "p", "#text"]
    assert [r.tag for r in cleaned.orderBy("pos").collect()] == ["div", "p", "#text", "p", "#text"]
