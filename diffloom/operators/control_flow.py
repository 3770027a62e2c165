"""Control-flow nodes, edges and diagram texts of source text.

Input is ``doc_id, code`` (any set of key columns works, see ``KEYS``).  Lines
are exploded next to their text, the rules of a line run as one projection, and
a single aggregation removes repeated nodes.  It combines on the map side, so
only distinct nodes travel, never source text.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.dialect import SPACE, WORD, java_regex
from diffloom.functions.rules import (
    CONTROL_WORDS,
    EVENT_PATTERNS,
    MAX_DIAGRAM_NODES,
    MAX_FLOW_FILES,
    NAME_CHARS,
    NON_SOURCE_LINES,
    NON_SOURCE_SHARE,
    NON_SOURCE_SUFFIXES,
)
from diffloom.functions.text import computed, let, matches, strip
from diffloom.operators.parse import changed_only, post_image

IF_ELSE, SWITCH_CASE, LOOP = "if_else", "switch_case", "loop"
TRY_CATCH, EVENT, CALL = "try_catch", "event_trigger", "function_call"
#: A literal of each rule in NON_SOURCE_LINES that is tied to the line start.
_AT_START_WORDS = [".o(", "Execution Region", "Load Region", "***", "===", "---", "References", "Size"]
_NODE = "struct<flow_type:string,name:string,condition:string>"


def likely_source(path: Column) -> Column:
    """Paths whose suffix does not name a build product, log or document."""
    suffixes = "|".join(re.escape(s) for s in NON_SOURCE_SUFFIXES)
    return ~F.lower(path).rlike(rf"(?:{suffixes})\z")


def non_source_line(line: Column) -> Column:
    """Linker or build-report output.  Rules tied to the line start run as one pattern."""
    anchored = [p.removeprefix("^") for p in NON_SOURCE_LINES if p.startswith("^")]
    # The expression is tried only where a literal is that one of its rules cannot do without.
    literal = reduce(or_, [line.contains(word) for word in _AT_START_WORDS])
    at_start = literal & line.rlike(java_regex(rf"\A(?:{'|'.join(anchored)})"))
    inside = [matches(line, p) for p in NON_SOURCE_LINES if not p.startswith("^")]
    return reduce(or_, inside, at_start)


def source_lines(code: Column) -> Column:
    """Numbered lines that can hold control flow, null if the text is no source.

    A text with 34 % or more build output among its non-blank lines is no source;
    neither is a blank one.  Blank, comment and build-output lines are left out.
    """
    lines = F.transform(
        F.split(code, "\n", -1),
        lambda raw, i: F.struct((i + 1).alias("number"), strip(raw).alias("line")),
    )
    judged = F.transform(
        F.filter(lines, lambda x: x["line"] != ""),
        lambda x: x.withField("noise", non_source_line(x["line"])),
    )

    def judge(kept: Column) -> Column:
        noise = F.size(F.filter(kept, lambda x: x["noise"]))
        usable = F.filter(
            kept, lambda x: ~(x["noise"] | x["line"].startswith("#") | x["line"].startswith("//"))
        )
        is_source = (F.size(kept) > 0) & (noise / F.size(kept) < F.lit(NON_SOURCE_SHARE))
        return F.when(is_source, usable)

    return let(judged, judge)


def _node(flow_type: str, name: Column, condition: Column | None = None) -> Column:
    condition = F.lit(None).cast("string") if condition is None else condition
    return F.struct(
        F.lit(flow_type).alias("flow_type"), name.alias("name"), condition.alias("condition")
    ).cast(_NODE)


def _nothing() -> Column:
    return F.lit(None).cast(_NODE)


def _inside(line: Column, pattern: str) -> Column:
    return strip(F.regexp_extract(line, java_regex(pattern), 1))


def _wrapped(word: str, inner: Column, chars: int | None) -> Column:
    """``word (inner)``, with inner shortened to ``chars`` characters (None: whole)."""
    if chars is not None:
        short = F.concat(F.substring(inner, 1, chars), F.lit("..."))
        inner = F.when(F.length(inner) > chars, short).otherwise(inner)
    return F.concat(F.lit(word + " ("), inner, F.lit(")"))


def _at_start(line: Column, pattern: str) -> Column:
    """Match of a rule ``^word...``, tried only on lines that start with the word."""
    word = re.match(r"\^([a-z]+)", pattern).group(1)
    return line.startswith(word) & line.rlike(java_regex(pattern))


def _clause(line: Column, word: str, pattern: str, flow_type: str, chars: int | None) -> tuple:
    """Condition and node of ``word (...)``; empty parentheses give no node."""

    def node(inner: Column) -> Column:
        found = F.when(inner != "", _node(flow_type, _wrapped(word, inner, chars), inner))
        return found.otherwise(_nothing())

    return _at_start(line, pattern), let(_inside(line, pattern), node)


def _fixed(line: Column, word: str, pattern: str, flow_type: str) -> tuple:
    return _at_start(line, pattern), _node(flow_type, F.lit(word))


def _first(*rules: tuple) -> Column:
    chain = F.when(*rules[0])
    for rule in rules[1:]:
        chain = chain.when(*rule)
    return chain.otherwise(_nothing())


def _if_else(line: Column, chars: int | None) -> Column:
    return _first(
        _clause(line, "if", r"^if\s*\((.*?)\)", IF_ELSE, chars),
        _clause(line, "else if", r"^else\s+if\s*\((.*?)\)", IF_ELSE, chars),
        _fixed(line, "else", r"^else\s*[{:]?\s*$", IF_ELSE),
    )


def _switch_case(line: Column) -> Column:
    case = r"^case\s+([^:]+):"
    value = _inside(line, case)
    case_node = F.when(value != "", _node(SWITCH_CASE, F.concat(F.lit("case "), value)))
    return _first(
        _clause(line, "switch", r"^switch\s*\((.*?)\)", SWITCH_CASE, None),
        (_at_start(line, case), case_node.otherwise(_nothing())),
        _fixed(line, "default", r"^default\s*:", SWITCH_CASE),
    )


def _loop(line: Column, chars: int | None) -> Column:
    return _first(
        _clause(line, "for", r"^for\s*\((.*?)\)", LOOP, chars),
        _clause(line, "while", r"^while\s*\((.*?)\)", LOOP, chars),
        _clause(line, "foreach", r"^for(?:each)?\s+\(.*?\s+(?:in|:)\s+(.*?)\)", LOOP, None),
    )


def _try_catch(line: Column) -> Column:
    catch = r"^catch\s*\((.*?)\)"
    what = _inside(line, catch)
    name = F.when(what != "", _wrapped("catch", what, None)).otherwise(F.lit("catch"))
    return _first(
        _fixed(line, "try", r"^try\s*[{:]?\s*$", TRY_CATCH),
        (_at_start(line, catch), _node(TRY_CATCH, name, what)),
        _fixed(line, "finally", r"^finally\s*[{:]?\s*$", TRY_CATCH),
    )


def _callee(line: Column) -> Column:
    """Name before the first parenthesis that follows one, else an empty string."""
    # A letter is looked for before what precedes it, which is the dearer test.
    name = rf"(?=[A-Za-z_])(?<![{WORD}])([A-Za-z_][A-Za-z0-9_]{{2,}})[{SPACE}]*\("
    return F.when(line.contains("("), F.regexp_extract(line, name, 1)).otherwise("")


def _event_or_call(line: Column, callee: Column) -> Column:
    """An event if one of the patterns matches, else the first call on the line."""
    rules = []
    for pattern, action in EVENT_PATTERNS:
        event = F.regexp_extract(line, java_regex(pattern), 1)
        node = _node(EVENT, F.concat(F.lit(f"{action}: "), event), event)
        rules.append((matches(line, pattern), node))
    ignored = F.lower(callee).isin(*CONTROL_WORDS) | callee.rlike(r"\A[A-Z][A-Z0-9]*\z")
    call = _node(CALL, F.concat(F.lit("Call: "), callee, F.lit("()")))
    return _first(*rules, ((callee != "") & ~ignored, call))


def flow_nodes(documents: DataFrame, keys: list[str], name_chars: int | None = None) -> DataFrame:
    """``keys, ord, flow_type, name, condition, line_number`` per distinct node.

    ``documents`` has the key columns and ``code``.  Names are whole and nodes differ by
    whole names; diagrams take nodes with ``name_chars=NAME_CHARS``, whose conditions are
    shortened, and those that then are equal are one.
    """
    lines = documents.select(
        *keys, F.inline_outer(source_lines(F.col("code"))).alias("line_number", "line", "noise")
    ).where("line is not null")
    line = F.col("line")
    detected = computed(
        lines.select(*keys, "line_number", "line", _callee(line).alias("_callee")),
        n1=_if_else(line, name_chars),
        n2=_switch_case(line),
        n3=_loop(line, name_chars),
        n4=_try_catch(line),
        n5=_event_or_call(line, F.col("_callee")),
    )
    nodes = detected.select(
        *keys, "line_number", F.posexplode(F.array("n1", "n2", "n3", "n4", "n5")).alias("slot", "node")
    ).where("node is not null")
    distinct = nodes.groupBy(
        *keys, F.col("node.flow_type").alias("flow_type"), F.col("node.name").alias("name")
    ).agg(F.min(F.struct("line_number", "slot", "node.condition")).alias("first"))
    order = Window.partitionBy(*keys).orderBy("first.line_number", "first.slot")
    return distinct.select(
        *keys,
        F.row_number().over(order).alias("ord"),
        "flow_type",
        "name",
        F.col("first.condition").alias("condition"),
        F.col("first.line_number").alias("line_number"),
    )


def patch_sources(files: DataFrame) -> DataFrame:
    """Post-image of every likely source file: ``patch_id, file_seq, path, code``."""
    sources = changed_only(files).where(likely_source(F.col("path")) & (F.col("n_hunks") > 0))
    return sources.select("patch_id", "file_seq", "path", post_image(F.col("body")).alias("code"))


def flow_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.count("*").alias("flows"))


def first_flow_files(nodes: DataFrame, limit: int | None = MAX_FLOW_FILES) -> DataFrame:
    """The first files of a patch that have at least one node (``limit=None``: all)."""
    order = Window.partitionBy("patch_id").orderBy("file_seq")
    counted = flow_counts(nodes, ["patch_id", "file_seq"])
    ranked = counted.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def flow_edges(nodes: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Chain Start -> flow_0 -> ... -> flow_end as ``keys, ord, src, dst``."""
    order = Window.partitionBy(*keys).orderBy("ord")
    shown = nodes.select(*keys, "ord")
    if limit is not None:
        shown = shown.where(F.col("ord") <= limit)
    name = F.concat(F.lit("flow_"), F.col("ord") - 1)
    following = F.lead("ord").over(order)
    hop = shown.select(*keys, "ord", name.alias("src"), following.alias("next")).select(
        *keys,
        "ord",
        "src",
        F.when(F.col("next").isNull(), F.lit("flow_end"))
        .otherwise(F.concat(F.lit("flow_"), F.col("next") - 1))
        .alias("dst"),
    )
    start = F.when(
        F.col("ord") == 1, F.struct(F.lit(0).alias("ord"), F.lit("Start").alias("src"), F.col("src").alias("dst"))
    )
    edge = F.struct("ord", "src", "dst")
    return hop.select(*keys, F.explode(F.array_compact(F.array(start, edge))).alias("e")).select(
        *keys, "e.ord", "e.src", "e.dst"
    )


def escape_label(text: Column) -> Column:
    return F.translate(text, "\"{}[]|", "'()()/")


def _gather(rows: DataFrame, keys: list[str], text: Column, *order: str) -> Column:
    entries = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return F.array_join(F.transform(entries, lambda e: e["text"]), "\n")


def flowcharts(nodes: DataFrame, keys: list[str], limit: int | None = MAX_DIAGRAM_NODES) -> DataFrame:
    """Flowchart text of every document that has nodes (``keys, chart``)."""
    label = escape_label(F.col("name"))
    flow_id = F.concat(F.lit("    flow_"), F.col("ord") - 1)
    kind = F.col("flow_type")
    shape = (
        F.when(kind.isin(IF_ELSE, SWITCH_CASE, TRY_CATCH), F.concat(flow_id, F.lit("{"), label, F.lit("}")))
        .when(kind == LOOP, F.concat(flow_id, F.lit("(["), label, F.lit("])")))
        .when(kind == EVENT, F.concat(flow_id, F.lit('("'), label, F.lit('")')))
        .otherwise(F.concat(flow_id, F.lit('["'), label, F.lit('"]')))
    )
    arrow = F.concat(
        F.when(F.col("ord") == 1, F.lit("    Start")).otherwise(
            F.concat(F.lit("    flow_"), F.col("ord") - 2)
        ),
        F.lit(" --> flow_"),
        F.col("ord") - 1,
    )
    total = F.count("*").over(Window.partitionBy(*keys))
    # Rows beyond the limit are counted, not gathered.
    counted = nodes.withColumn("total", total)
    shown = counted if limit is None else counted.where(F.col("ord") <= limit)
    parts = shown.groupBy(*keys).agg(
        _gather(shown, keys, shape, "ord").alias("shapes"),
        _gather(shown, keys, arrow, "ord").alias("arrows"),
        F.max("total").alias("total"),
        F.max("ord").alias("last"),
    )
    end = F.when(
        F.col("total") > F.col("last"),
        F.concat(F.lit("    flow_end([End — "), F.col("total") - F.col("last"), F.lit(" more not shown])")),
    ).otherwise(F.lit("    flow_end([End])"))
    last = F.concat(F.lit("    flow_"), F.col("last") - 1, F.lit(" --> flow_end"))
    chart = F.concat_ws(
        "\n", F.lit("graph TD"), F.lit("    Start([Start])"), "shapes", "arrows", end, last
    )
    return parts.select(*keys, chart.alias("chart"))


def _ranked(nodes: DataFrame, keys: list[str], kinds: list[str], limit: int | None) -> DataFrame:
    """Nodes of ``kinds``, one kind after the other, at most ``limit`` per document."""
    group = F.when(F.col("flow_type") == kinds[0], 0).otherwise(1)
    order = Window.partitionBy(*keys).orderBy("group", "ord")
    placed = (
        nodes.where(F.col("flow_type").isin(*kinds))
        .withColumn("group", group)
        .withColumn("place", F.row_number().over(order))
    )
    return placed if limit is None else placed.where(F.col("place") <= limit)


def sequence_charts(nodes: DataFrame, keys: list[str], limit: int | None = MAX_DIAGRAM_NODES) -> DataFrame:
    """Events, then calls, as a message list; only documents that have some."""
    shown = _ranked(nodes, keys, [EVENT, CALL], limit)
    event = escape_label(
        F.when(F.coalesce(F.col("condition"), F.lit("")) != "", F.col("condition")).otherwise(F.col("name"))
    )
    call = escape_label(F.replace(F.replace(F.col("name"), F.lit("Call: "), F.lit("")), F.lit("()"), F.lit("")))
    message = (
        F.when(F.col("flow_type") == CALL, F.concat(F.lit("    Main->>System: "), call, F.lit("()")))
        .when(F.contains(F.col("name"), F.lit("Emit")), F.concat(F.lit("    Main->>System: emit("), event, F.lit(")")))
        .otherwise(F.concat(F.lit("    System->>Main: on("), event, F.lit(")")))
    )
    head = "sequenceDiagram\n    actor Main\n    participant System"
    return shown.groupBy(*keys).agg(
        F.concat_ws("\n", F.lit(head), _gather(shown, keys, message, "place")).alias("chart")
    )


def state_charts(nodes: DataFrame, keys: list[str], limit: int | None = MAX_DIAGRAM_NODES) -> DataFrame:
    """Conditions, then switch cases, as states; only documents that have some."""
    shown = _ranked(nodes, keys, [IF_ELSE, SWITCH_CASE], limit)
    state = F.concat(F.lit("State_"), F.col("place") - 1)
    label = escape_label(F.col("name"))
    text = F.when(
        F.col("flow_type") == IF_ELSE,
        F.concat(
            F.lit("    Start --> "), state, F.lit(": "), label,
            F.lit("\n    "), state, F.lit(" --> End: completed"),
        ),
    ).otherwise(F.concat(F.lit("    "), state, F.lit(" --> End: "), label))
    return shown.groupBy(*keys).agg(
        F.concat_ws(
            "\n",
            F.lit("stateDiagram-v2\n    [*] --> Start"),
            _gather(shown, keys, text, "place"),
            F.lit("    End --> [*]"),
        ).alias("chart")
    )


# What a document without matching nodes gets.
EMPTY_CHARTS = {
    "flowchart": "graph TD\n    Start([Start])\n    Start --> End([No Control Flow Detected])",
    "sequence": "sequenceDiagram\n    Note over Main,System: No event or function calls detected",
    "state": "stateDiagram-v2\n    [*] --> Idle\n    Idle --> [*]",
}


def code_flow_charts(
    documents: DataFrame, keys: list[str], diagram_type: str = "flowchart"
) -> DataFrame:
    """One diagram text per document, also for documents without nodes."""
    draw = {"sequence": sequence_charts, "state": state_charts}.get(diagram_type, flowcharts)
    empty = EMPTY_CHARTS.get(diagram_type, EMPTY_CHARTS["flowchart"])
    charts = draw(flow_nodes(documents, keys, NAME_CHARS), keys)
    return documents.select(*keys).join(charts, keys, "left").select(
        *keys, F.coalesce("chart", F.lit(empty)).alias("chart")
    )
