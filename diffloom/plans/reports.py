"""Report tables: one text or JSON document per patch, one text per file.

``review_rows`` does all work on text inside file rows.  Each report first turns
rows into lines or parts (``summary_lines``, ``changed_file_lines``,
``prompt_parts``, ``file_reports``), which stay distributed; the functions named
after whole reports then put the lines of a patch into one document.  Such a
document is no larger than the patch row it came from.  For a change set that
came as many rows, such as a snapshot comparison, :mod:`diffloom.plans.documents`
writes the same documents in parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.text import join_lines
from diffloom.operators import architecture as arch
from diffloom.operators.context import limit_context
from diffloom.operators.hunk_filters import with_meaningful
from diffloom.operators.redaction import API_SAFE, strip_texts
from diffloom.operators.risk import risk_icon, with_risk
from diffloom.operators.statistics import chars_to_tokens, cost_usd
from diffloom.operators.symbols import symbol_list, with_symbols
from diffloom.storage import stored


@dataclass(frozen=True)
class ReviewOptions:
    """Job options; the defaults are those of a plain export."""

    source: str = "comparison"
    generated_at: str = ""
    context_lines: int = 30
    skip_whitespace: bool = True
    skip_comments: bool = True
    strip_patch: bool = False
    strip_context: int = 1
    redaction_mode: str = API_SAFE
    strict_redaction: bool = False
    include_json: bool = True
    # How many entries the reports show (None: all).  Tables are always complete.
    symbols_in_summary: int | None = 5
    symbols_in_prompt: int | None = 10
    symbols_in_file: int | None = 20
    facts_shown: int | None = 30
    dependencies_per_side: int | None = 20
    signature_chars: int | None = 80
    top_token_paths: int | None = 10


DEFAULTS = ReviewOptions()


def _first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def report_facts(files: DataFrame, options: ReviewOptions = DEFAULTS) -> DataFrame:
    """Facts as reports show them: signatures cut, and merged where they then agree."""
    return arch.marked_facts(files, signature_chars=options.signature_chars)


def review_tables(
    files: DataFrame, options: ReviewOptions = DEFAULTS, hunks: bool = True
) -> tuple[DataFrame, DataFrame]:
    """:func:`review_rows` and :func:`report_facts`, for which every file is built and cut once."""
    entries = _stored_entries(arch.with_facts(files, signature_chars=options.signature_chars), options, hunks)
    facts = arch.marked_facts(entries.select("patch_id", "file_seq", "path", "facts"))
    return _placed_rows(entries.drop("facts")), facts


def review_rows(
    files: DataFrame, options: ReviewOptions = DEFAULTS, hunks: bool = True
) -> DataFrame:
    """All file-level results, one row per entry, identical entries flagged.

    Of several entries for one path, the last one provides score, level,
    reasons and symbols (columns without ``own_``) and the token count.  Results of entries are
    stored once, so each text is analysed once; without ``hunks``, texts are not stored and
    the reports that show them cannot be made.
    """
    return _placed_rows(_stored_entries(files, options, hunks))


def _stored_entries(files: DataFrame, options: ReviewOptions, hunks: bool) -> DataFrame:
    """Results of every entry by itself, with its ``facts`` if ``files`` have them."""
    kept = with_meaningful(files, options.skip_whitespace, options.skip_comments)
    if options.skip_whitespace and options.skip_comments:
        named = kept.withColumn("symbols", symbol_list(F.col("kept_hunks"), F.col("extension")))
    else:
        named = with_symbols(kept)
    facts = with_risk(named).select(
        "patch_id", "file_seq", "path", "binary", "n_hunks", "added", "deleted", "kept_hunks", "n_kept",
        (~F.col("binary") & (F.col("n_hunks") == 0)).alias("identical"),
        F.struct("score", "level", "reasons", "symbols").alias("own"),
        F.length(join_lines(F.col("kept_hunks"))).alias("chars"),
        "path_repeats",
        *(["facts"] if "facts" in files.columns else []),
    )
    return stored(facts if hunks else facts.drop("kept_hunks"), "zstd")


def _placed_rows(facts: DataFrame) -> DataFrame:
    """Results by path, for entries from :func:`_stored_entries`."""
    # Most paths occur once in a patch.  Their rows decide for themselves and pass no
    # exchange; only entries of repeated paths, or of files of which that is not
    # known, meet in a window by patch and path.
    repeats = F.coalesce("path_repeats", F.lit(True))
    single, several = facts.where(~repeats), facts.where(repeats)
    counted = ~F.col("binary") & (F.col("n_kept") > 0)
    deciding = F.when(~F.col("identical"), F.col("file_seq"))
    counted_seq = F.when(counted, F.col("file_seq"))
    same_path = Window.partitionBy("patch_id", "path")
    last = F.struct("file_seq", "own")
    placed = single.select(
        "*", F.when(deciding.isNotNull(), last).alias("_last"),
        counted_seq.alias("_token_seq"), counted_seq.alias("path_seq"),
    ).unionByName(
        several.select(
            "*", F.max_by(last, deciding).over(same_path).alias("_last"),
            F.max(counted_seq).over(same_path).alias("_token_seq"),
            F.min(counted_seq).over(same_path).alias("path_seq"),
        )
    )
    return placed.select(
        *[c for c in facts.columns if c != "path_repeats"],
        "_last.own.*",
        (F.col("file_seq") == F.col("_last.file_seq")).alias("is_last"),
        F.when(counted, F.col("chars")).alias("counted_chars"),
        F.when(F.col("file_seq") == F.col("_token_seq"), chars_to_tokens(F.col("chars"))).alias("tokens"),
        "path_seq",
    )


def _text(*parts) -> Column:
    """Concatenate columns and literal strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _gather(text: Column, *order: Column, where: Column | None = None, sep: str = "\n") -> Column:
    """Ordered text of a group; '' for an empty group."""
    names = [o.alias(f"o{i}") for i, o in enumerate(order)]
    entry = F.struct(*names, text.alias("text"))
    entries = F.array_sort(F.collect_list(entry if where is None else F.when(where, entry)))
    return F.array_join(F.transform(entries, lambda e: e["text"]), sep)


def _pad(text: Column, width: int, right: bool = True) -> Column:
    """Fill up to ``width`` characters, never cut."""
    padded = F.rpad(text, width, " ") if right else F.lpad(text, width, " ")
    return F.when(F.length(text) < width, padded).otherwise(text)


def _quoted(names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`")))


def table_row(*cells: Column) -> Column:
    return _text("| ", F.concat_ws(" | ", *cells), " |")


def table_header(*titles: str) -> str:
    return f"| {' | '.join(titles)} |\n| {' | '.join('---' for _ in titles)} |"


def four_decimals(value: Column) -> Column:
    """``%.4f`` rounded from the exact binary value, halves to even.

    The formatter of the JVM rounds the shortest decimal form instead.  Whether
    the value lies above or below the half is read from the remainder of an
    exact product: the value is split so that both partial products are exact.
    """
    split = F.lit(134217729.0) * value
    high = split - (split - value)
    low = value - high
    half_units = F.floor(value * 20000 + F.lit(0.5)).cast("bigint")
    rest = (high * 20000 - half_units) + low * 20000
    lower = F.floor(half_units / 2).cast("bigint")
    tie = F.when(rest > 0, lower + 1).when(rest < 0, lower).otherwise(lower + lower % 2)
    units = F.when(half_units % 2 == 1, tie).otherwise(lower)
    return _text(F.floor(units / 10000), ".", F.lpad((units % 10000).cast("string"), 4, "0"))


def _changed() -> Column:
    return ~F.col("identical") & ~F.col("binary")


def _by_risk() -> tuple[Column, Column]:
    return -F.col("score"), F.col("file_seq")


def summary_lines(rows: DataFrame, options: ReviewOptions = DEFAULTS) -> DataFrame:
    """File table of the summary, one line per changed text file, with sort keys."""
    symbols, shown_symbols = F.col("symbols"), _first(F.col("symbols"), options.symbols_in_summary)
    left = F.size(symbols) - F.size(shown_symbols)
    more = F.when(left > 0, _text(" +", left, " more")).otherwise("")
    shown = F.concat(F.array_join(_quoted(shown_symbols), ", "), more)
    row = table_row(
        _text("`", F.col("path"), "`"),
        _text("+", F.col("added")),
        _text("-", F.col("deleted")),
        F.col("n_hunks").cast("string"),
        F.when(shown == "", F.lit("—")).otherwise(shown),
        _text(risk_icon(F.col("level")), " ", F.col("level")),
    )
    return rows.withColumn("line", F.when(_changed(), row))


def summary_totals(rows: DataFrame, *lists: Column) -> DataFrame:
    """Totals of each patch, combined on the map side, and whatever else is gathered with them."""
    listed = ~F.col("identical")

    def level_count(level: str) -> Column:
        return F.count_if(F.col("is_last") & (F.col("level") == level))

    totals = rows.groupBy("patch_id").agg(
        F.count_if(_changed()).alias("changed_files"),
        F.count_if(listed & F.col("binary")).alias("binary_files"),
        F.sum(F.when(listed, F.col("added")).otherwise(0)).alias("lines_added"),
        F.sum(F.when(listed, F.col("deleted")).otherwise(0)).alias("lines_deleted"),
        level_count("High").alias("high"),
        level_count("Med").alias("med"),
        level_count("Low").alias("low"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        *lists,
    )
    return totals.withColumn("cost_text", four_decimals(cost_usd(F.col("total_tokens"))))


def summary_head(options: ReviewOptions) -> Column:
    """Text of the summary up to the head of its file table, from :func:`summary_totals`."""
    head = ["# AI Review — Summary", "", f"> Generated: {options.generated_at}", f"> Source: {options.source}"]
    if options.strip_patch:
        head.append("> 🔒 Mode: **Stripped Patch** (context redacted, identifiers pseudonymized)")
    head += ["", "## Overview", "", "| Metric | Value |", "| --- | --- |"]
    return F.concat_ws(
        "\n",
        F.lit("\n".join(head)),
        _text("| Changed files | ", F.col("changed_files"), " |"),
        _text("| Binary files  | ", F.col("binary_files"), " |"),
        _text("| Lines added   | +", F.col("lines_added"), " |"),
        _text("| Lines deleted | -", F.col("lines_deleted"), " |"),
        _text("| 🔴 High risk  | ", F.col("high"), " |"),
        _text("| 🟡 Med risk   | ", F.col("med"), " |"),
        _text("| 🟢 Low risk   | ", F.col("low"), " |"),
        _text("| Est. tokens   | ", F.format_number("total_tokens", 0), " |"),
        _text("| Est. cost     | $", F.col("cost_text"), " (GPT-4o ref) |"),
        F.lit("\n## Changed Files\n"),
        F.lit(table_header("File", "+LOC", "-LOC", "Hunks", "Symbols", "Risk")),
    )


def summaries(rows: DataFrame, options: ReviewOptions = DEFAULTS) -> DataFrame:
    """Overview per patch: totals, risk histogram, tokens, file table."""
    binary = ~F.col("identical") & F.col("binary")
    totals = summary_totals(
        summary_lines(rows, options),
        _gather(F.col("line"), *_by_risk(), where=_changed()).alias("table"),
        _gather(_text("- `", F.col("path"), "`"), F.col("file_seq"), where=binary).alias("binaries"),
    )
    text = F.concat_ws(
        "\n",
        summary_head(options),
        F.when(F.col("table") != "", F.col("table")),
        F.when(F.col("binaries") != "", F.concat(F.lit("\n### Binary Files\n\n"), F.col("binaries"))),
    )
    return totals.select(
        "patch_id", "changed_files", "binary_files", "lines_added", "lines_deleted",
        "high", "med", "low", "total_tokens", text.alias("report"),
    )


def changed_file_lines(rows: DataFrame) -> DataFrame:
    """``patch_id, path, file_seq, line`` of every entry that is not identical."""
    status = F.when(F.col("binary"), F.lit("BINARY")).otherwise(
        _text("+", F.col("added"), "/-", F.col("deleted"))
    )
    line = F.concat_ws(
        " ", _pad(_text("[", F.col("level"), "]"), 8), _pad(status, 16), F.col("path")
    )
    return rows.select("patch_id", "path", "file_seq", F.when(~F.col("identical"), line).alias("line"))


def changed_file_lists(rows: DataFrame) -> DataFrame:
    """One document per patch with the lines in path order."""
    known = F.col("line").isNotNull()
    listing = _gather(F.col("line"), F.col("path"), F.col("file_seq"), where=known)
    lines = F.when(F.col("listing") != "", F.col("listing"))
    return (
        changed_file_lines(rows)
        .groupBy("patch_id")
        .agg(listing.alias("listing"))
        .select("patch_id", F.concat_ws("\n", F.lit("# Changed Files\n"), lines).alias("report"))
    )


def _fact_lists(facts: DataFrame, options: ReviewOptions) -> DataFrame:
    """One array of texts per kind and patch, with the limits of the options."""
    columns = []
    for kind in FACT_KINDS:
        wanted = F.col("kind") == kind
        # Facts are numbered without gaps, so those beyond a limit need not travel.
        if kind == arch.API and options.facts_shown is not None:
            wanted = wanted & (F.col("ord") <= options.facts_shown)
        if kind == arch.DEPENDENCY and options.dependencies_per_side is not None:
            wanted = wanted & (F.col("list_place") <= options.dependencies_per_side)
        entries = F.array_sort(F.collect_list(F.when(wanted, F.struct("ord", "text"))))
        if kind == arch.DEPENDENCY:
            entries = _first(entries, options.facts_shown)
        columns.append(F.transform(entries, lambda e: e["text"]).alias(kind))
    return facts.groupBy("patch_id").agg(*columns)


FACT_KINDS = [
    arch.NEW, arch.REMOVED, arch.API, arch.DEPENDENCY, arch.SUBSYSTEM, arch.SIDE_EFFECT,
    arch.CONCURRENCY, arch.MEMORY,
]
SECTIONS = [
    (arch.NEW, "New Components / Classes", "None detected."),
    (arch.REMOVED, "Removed Components / Classes", "None detected."),
    (arch.API, "API / Interface Changes", "No explicit API changes detected in diff headers."),
    (arch.DEPENDENCY, "Module Dependency Changes", "None detected."),
    (arch.SIDE_EFFECT, "Potential Side Effects", "None detected."),
    (arch.CONCURRENCY, "Concurrency / Threading Risks", "None detected."),
    (arch.MEMORY, "Memory Management Risks", "None detected."),
]
NOTES = (
    "## Notes\n\nThis analysis is heuristic-based. Verify each item manually.\n"
    "Focus attention on High-risk files listed in `summary.md`.\n"
)


def architecture_reports(facts: DataFrame, options: ReviewOptions = DEFAULTS) -> DataFrame:
    """Architecture report per patch from :func:`report_facts`."""
    lists = _fact_lists(facts, options)
    subsystems = F.array_join(_quoted(F.col(arch.SUBSYSTEM)), ", ")
    parts = [
        F.lit(f"# Architecture Changes\n\n> Generated: {options.generated_at}\n"),
        _text(
            "**Affected subsystems:** ",
            F.when(F.size(arch.SUBSYSTEM) > 0, subsystems).otherwise("N/A"),
            "\n",
        ),
    ]
    for kind, title, empty in SECTIONS:
        items = join_lines(F.transform(F.col(kind), lambda i: F.concat(F.lit("- "), i)))
        body = F.when(F.size(kind) > 0, items).otherwise(F.lit(f"*{empty}*"))
        parts.append(_text(f"## {title}\n\n", body, "\n"))
    parts.append(F.lit(NOTES))
    return lists.select("patch_id", F.concat_ws("\n", *parts).alias("report"))


# Instructions in front of the diffs; pass another template to use your own.
PROMPT_TEMPLATE = """\
You are reviewing a change set. The diffs below come from comparing two versions of a code base.

Report on each of these points and name the files and functions you refer to:

1. Executive summary: what changed and how risky it is as a whole
2. Architecture differences: components, interfaces, dependencies
3. Behavioral changes: control flow, state, error handling
4. Regression risks: callers, assumptions, integration points
5. Hidden side effects: performance, security, resources
6. API contract changes: breaking or additive, versioning
7. Concurrency and memory risks
8. Recommended test cases

Mark everything that needs attention before the merge.

---

{diff_content}
"""
STRIPPED_NOTICE = (
    "NOTE: This patch has been stripped and pseudonymized: names, string literals and most of the "
    "surrounding context were removed or replaced by placeholders (such as sym_a1b2c3, <str>, <n>). "
    "Judge the shape of the change (control flow, structure, calls) rather than literal names.\n\n"
)


def _stripped(options: ReviewOptions) -> Column:
    """The kept hunks of a row, each stripped to one text."""
    return strip_texts(
        F.col("kept_hunks"), F.col("path"), options.redaction_mode, options.strip_context, options.strict_redaction
    )


def prompt_parts(rows: DataFrame, options: ReviewOptions = DEFAULTS) -> DataFrame:
    """``patch_id, score, file_seq, part``: the text of each file in the prompt."""
    shown = _changed() & (F.col("n_kept") > 0)
    if options.strip_patch:
        diff = F.array_join(_stripped(options), "\n\n")
    else:
        diff = join_lines(F.col("kept_hunks"))
    symbols = F.when(
        F.size("symbols") > 0,
        _text("\nModified symbols: ", F.array_join(_first(F.col("symbols"), options.symbols_in_prompt), ", ")),
    ).otherwise("")
    part = _text(
        "### FILE: ", F.col("path"), "\nRisk: ", F.col("level"), " | +", F.col("added"), "/-",
        F.col("deleted"), " LOC", symbols, "\n\n```diff\n", diff, "\n```",
    )
    return rows.select("patch_id", "score", "file_seq", F.when(shown, part).alias("part"))


def review_prompts(
    rows: DataFrame, options: ReviewOptions = DEFAULTS, template: str = PROMPT_TEMPLATE
) -> DataFrame:
    """One review prompt per patch, riskiest files first."""
    parts = prompt_parts(rows, options).groupBy("patch_id").agg(
        _gather(F.col("part"), *_by_risk(), where=F.col("part").isNotNull(), sep="\n\n---\n\n").alias("diffs")
    )
    before, after = template.split("{diff_content}")
    notice = STRIPPED_NOTICE if options.strip_patch else ""
    diffs = F.when(F.col("diffs") != "", F.col("diffs")).otherwise("(No meaningful diffs found)")
    return parts.select("patch_id", _text(notice + before, diffs, after).alias("prompt"))


def file_reports(rows: DataFrame, options: ReviewOptions = DEFAULTS) -> DataFrame:
    """One diff report per changed text file, in the row of the file."""
    symbols = F.when(
        F.size("symbols") > 0,
        _text(
            "**Modified symbols:** ",
            F.array_join(_quoted(_first(F.col("symbols"), options.symbols_in_file)), ", "),
            "\n",
        ),
    )
    reasons = _text(
        "**Risk reasons:**\n",
        join_lines(F.transform("reasons", lambda r: F.concat(F.lit("- "), r))),
        "\n",
    )
    if options.strip_patch:
        hunks = _stripped(options)
    else:
        hunks = F.transform("kept_hunks", lambda h: limit_context(h, options.context_lines))
    fenced = F.transform(hunks, lambda h: F.concat(F.lit("```diff\n"), h, F.lit("\n```\n")))
    diff = F.when(F.col("n_kept") > 0, F.concat(F.lit("## Diff\n\n"), join_lines(fenced))).otherwise(
        F.lit("*No meaningful changes after filtering.*\n")
    )
    notice = (
        "> 🔒 **Stripped Patch** — surrounding context and identifiers have been "
        "redacted/pseudonymized. Only the core changed lines remain.\n"
    )
    text = F.concat_ws(
        "\n",
        _text("# `", F.col("path"), "`\n"),
        _text(
            "**Risk:** ", risk_icon(F.col("level")), " ", F.col("level"), "  |  **+", F.col("added"),
            "** / **-", F.col("deleted"), "** LOC  |  **Hunks:** ", F.col("n_kept"), "\n",
        ),
        *([F.lit(notice)] if options.strip_patch else []),
        symbols,
        reasons,
        diff,
    )
    return rows.where(_changed()).select(
        "patch_id", "file_seq", "path",
        _text(F.translate("path", "/\\:", "___"), ".diff.md").alias("file_name"),
        text.alias("report"),
    )


#: Kind of a fact and its name in the JSON document.
JSON_FACTS = {
    arch.NEW: "new_components", arch.REMOVED: "removed_components", arch.API: "api_changes",
    arch.DEPENDENCY: "dependency_changes", arch.SUBSYSTEM: "affected_subsystems",
    arch.SIDE_EFFECT: "potential_side_effects", arch.CONCURRENCY: "concurrency_risks",
    arch.MEMORY: "memory_risks",
}


def file_fields() -> list[Column]:
    """Fields of a file in the JSON document."""
    return [
        F.col("path"), F.col("added"), F.col("deleted"), F.col("n_hunks").alias("hunks"), F.col("binary"),
        F.col("level").alias("risk_level"), F.col("score").alias("risk_score"),
        F.col("reasons").alias("risk_reasons"), F.col("symbols").alias("modified_symbols"),
    ]


def review_documents(
    rows: DataFrame, facts: DataFrame, options: ReviewOptions = DEFAULTS
) -> DataFrame:
    """One JSON document per patch."""
    entry = F.struct("file_seq", F.struct(*file_fields()).alias("file"))
    files = rows.groupBy("patch_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("identical"), entry))), lambda e: e["file"]
        ).alias("files"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
    )
    document = F.struct(
        F.lit(options.generated_at).alias("generated_at"),
        "files",
        F.struct(*[F.col(kind).alias(name) for kind, name in JSON_FACTS.items()]).alias("architecture"),
        F.struct(
            "total_tokens", cost_usd(F.col("total_tokens")).alias("estimated_cost_usd")
        ).alias("token_estimate"),
    )
    return files.join(_fact_lists(facts, options), "patch_id").select(
        "patch_id", F.to_json(document).alias("document")
    )


def token_summaries(rows: DataFrame, options: ReviewOptions = DEFAULTS) -> DataFrame:
    """Totals and the paths with most tokens, as text, per patch.

    Where a limit is given, tasks keep as many rows of a patch as it allows before the
    exchange, and totals are combined apart from them.
    """
    order = Window.partitionBy("patch_id").orderBy(F.desc("tokens"), "path_seq")
    placed = rows.where("tokens is not null").withColumn("place", F.row_number().over(order))
    if options.top_token_paths is not None:
        placed = placed.where(F.col("place") <= options.top_token_paths)
    line = _text("  ", _pad(F.format_number("tokens", 0), 6, right=False), "  ", F.col("path"))
    top = placed.groupBy("patch_id").agg(_gather(line, F.col("place")).alias("top"))
    totals = rows.groupBy("patch_id").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("counted_chars"), F.lit(0)).alias("total_chars"),
    ).withColumn("cost_text", four_decimals(cost_usd(F.col("total_tokens"))))
    text = F.concat_ws(
        "\n",
        _text("Estimated tokens : ", F.format_number("total_tokens", 0)),
        _text("Estimated cost   : $", F.col("cost_text"), " (GPT-4o input ref)"),
        F.lit("\nTop files by token count:"),
        F.col("top"),
    )
    return totals.join(top, "patch_id", "left").select(
        "patch_id", "total_tokens", "total_chars", text.alias("report")
    )
