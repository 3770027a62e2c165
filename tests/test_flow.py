from patch_texts import patch
from pyspark.sql import functions as F

from diffloom.operators import control_flow as flow


def nodes(spark, code):
    table = spark.createDataFrame([("d", code)], "doc_id string, code string")
    return flow.flow_nodes(table, ["doc_id"])


def names(spark, code):
    return [r.name for r in nodes(spark, code).orderBy("ord").collect()]


def test_conditions_loops_and_clauses(spark):
    code = """
        if (a > 0) {
        } else {
        else if (b) {
        else {
        if () {
        switch (kind) {
        case A::B:
        case 1:
        default:
        for (int i = 0; i < 10; i++) {
        foreach (x in items) {
        while (ready) {
        try {
        catch (Error e) {
        catch () {
        finally {
        // if (hidden)
        # while (hidden)
    """
    assert names(spark, code) == [
        "if (a > 0)", "else if (b)", "else", "switch (kind)", "case A", "case 1", "default",
        "for (int i = 0; i < 10; i++)", "foreach (items)", "Call: foreach()", "while (ready)", "try",
        "catch (Error e)", "catch", "finally"]


def test_long_conditions_are_whole_and_cut_for_diagrams_only(spark):
    code = "\n".join(f"if ({'x' * 50}{c})" for c in "ab")
    assert names(spark, code) == [f"if ({'x' * 50}{c})" for c in "ab"]
    documents = spark.createDataFrame([("d", code)], "doc_id string, code string")
    drawn = flow.flow_nodes(documents, ["doc_id"], flow.NAME_CHARS)
    assert [r.name for r in drawn.collect()] == [f"if ({'x' * 40}...)"]


def test_events_and_calls(spark):
    code = "\n".join([
        "el.addEventListener('click', go)", "bus.on(\"ready\", f)", "emit('done')", "store.dispatch(save)",
        "subscribe('x')", "obj.method(1)", "ab(1)", "EOF(1)", "MAX_N(1)", "return (x)", "éval(3)"])
    assert names(spark, code) == [
        "Listen: click", "Listen: ready", "Emit: done", "Emit: save", "Listen: x", "Call: method()", "Call: MAX_N()"]


def test_linker_map_is_no_source(spark):
    code = "\n".join(["Section Cross References", "  a.o(i.Foo) refers to b.o(i.Bar)", "====", "if (x) {"])
    assert names(spark, code) == []
    assert names(spark, "\n \n") == []


def test_repeated_call_once_and_chart_cap(spark):
    assert names(spark, "\n".join(["do_it();"] * 10)) == ["Call: do_it()"]
    table = nodes(spark, "\n".join(f"do_action_{i}();" for i in range(50)))
    assert table.count() == 50
    chart = flow.flowcharts(table, ["doc_id"]).first().chart.split("\n")
    assert chart[0] == "graph TD" and '    flow_24["Call: do_action_24()"]' in chart
    assert "    flow_end([End — 25 more not shown])" in chart and chart[-1] == "    flow_24 --> flow_end"
    assert flow.flow_edges(table, ["doc_id"]).count() == 51
    assert flow.flow_edges(table, ["doc_id"], limit=25).count() == 26
    assert "not shown" not in flow.flowcharts(table, ["doc_id"], None).first().chart
    assert flow.sequence_charts(table, ["doc_id"], None).first().chart.count("->>") == 50


def test_sequence_and_state_charts(spark):
    table = nodes(spark, "go_on();\nbus.on('a', f)\nbus.on('EmitX', f)\ncase 1:\nif (a[0] | {b}) {")
    assert flow.sequence_charts(table, ["doc_id"]).first().chart.split("\n")[3:] == [
        "    System->>Main: on(a)", "    Main->>System: emit(EmitX)", "    Main->>System: go_on()"]
    assert flow.state_charts(table, ["doc_id"]).first().chart.split("\n") == [
        "stateDiagram-v2", "    [*] --> Start", "    Start --> State_0: if (a(0) / (b))",
        "    State_0 --> End: completed", "    State_1 --> End: case 1", "    End --> [*]"]


def test_charts_of_documents_without_nodes(spark):
    docs = spark.createDataFrame([("d", "plain text")], "doc_id string, code string")
    for kind, text in flow.EMPTY_CHARTS.items():
        assert flow.code_flow_charts(docs, ["doc_id"], kind).first().chart == text


def test_patch_sources_and_first_files(parse):
    text = "\n".join([patch(f"f{i}.c", [f"call_{i}();"]) for i in range(10)] + [patch("x.map", ["call_x();"])])
    sources = flow.patch_sources(parse(text))
    assert sources.count() == 10
    found = flow.first_flow_files(flow.flow_nodes(sources, ["patch_id", "file_seq"]))
    assert [r.file_seq for r in found.orderBy("rank").collect()] == list(range(1, 9))
    assert sources.where(F.col("file_seq") == 1).first().code == "call_0();"
