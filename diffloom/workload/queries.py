"""Registered queries: every operator over the whole of a driver table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.operators import architecture as arch
from diffloom.operators import control_flow as flow
from diffloom.operators import redaction
from diffloom.operators.context import limit_context
from diffloom.operators.hunk_filters import with_meaningful, with_noise_flags
from diffloom.operators.parse import (
    added_text,
    changed_only,
    diff_lines,
    hunk_table,
    parse_patches,
    post_image,
    removed_text,
    text_files,
)
from diffloom.operators.piece_hunks import Pieces
from diffloom.operators.pieces import piece_file_stats
from diffloom.operators.risk import file_risk, risk_histogram, riskiest_files
from diffloom.operators.statistics import (
    file_stats,
    file_tokens,
    last_per_path,
    patch_tokens,
    patch_totals,
    path_breakdown,
    prompt_tokens,
    text_tokens,
    token_breakdown,
    top_paths_by_tokens,
)
from diffloom.operators.symbols import symbol_table
from diffloom.plans import documents, reports
from diffloom.plans.package import export_review_package
from diffloom.sources.compare_report import load_report
from diffloom.sources.file_tree import list_files, read_files, read_text_runs
from diffloom.sources.patches import load_patches, read_patch_pieces
from diffloom.sources.snapshots import (
    as_change_set,
    compare_file_pairs,
    compare_folders,
    compare_snapshots,
    read_snapshot,
    snapshot_status,
)
from diffloom.storage import shared_folder, stored, stored_alone
from diffloom.workload.fixtures import (
    conversation_pieces,
    document_snapshots,
    document_trees,
    parquet,
    patch_line_pieces,
    report_files,
    spread,
    synthetic_patches,
)

Query = Callable[[SparkSession, str], DataFrame]
OPTIONS = reports.ReviewOptions(source="documents", generated_at="2024-05-01 00:00:00")
FILE_KEYS = ["patch_id", "file_seq"]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_patches(synthetic_patches(spark, sf_dir))


def _plain(table: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines return the same types."""
    return table.select(
        *[
            F.col(name).cast("bigint").alias(name) if kind in ("int", "smallint") else F.col(name)
            for name, kind in table.dtypes
        ]
    )


@query
def file_statistics(spark, sf_dir):
    return _plain(file_stats(_files(spark, sf_dir)))


@query
def file_paths(spark, sf_dir):
    files = _files(spark, sf_dir)
    return _plain(files.select(*FILE_KEYS, "old_path", "new_path", "path", "extension"))


@query
def hunk_headers(spark, sf_dir):
    return _plain(hunk_table(_files(spark, sf_dir)).drop("path", "extension", "text"))


@query
def line_kinds(spark, sf_dir):
    lines = diff_lines(_files(spark, sf_dir))
    return _plain(lines.select("patch_id", "file_seq", "hunk_seq", "line_no", "kind", "text"))


@query
def file_texts(spark, sf_dir):
    body = F.col("body")
    return _plain(
        _files(spark, sf_dir).select(
            *FILE_KEYS,
            F.md5(body).alias("body_md5"),
            F.md5(added_text(body)).alias("added_md5"),
            F.md5(removed_text(body)).alias("removed_md5"),
            F.md5(post_image(body)).alias("post_image_md5"),
        )
    )


@query
def hunk_noise(spark, sf_dir):
    flagged = with_noise_flags(hunk_table(_files(spark, sf_dir)))
    return _plain(flagged.select("patch_id", "file_seq", "hunk_seq", "ws_only", "comment_only"))


@query
def meaningful_files(spark, sf_dir):
    kept = with_meaningful(changed_only(_files(spark, sf_dir)))
    return _plain(kept.select(*FILE_KEYS, "n_hunks", "n_kept", (F.col("n_kept") > 0).alias("meaningful")))


@query
def meaningful_keep_comments(spark, sf_dir):
    kept = with_meaningful(changed_only(_files(spark, sf_dir)), skip_comments=False)
    return _plain(kept.select(*FILE_KEYS, "n_kept"))


@query
def change_totals(spark, sf_dir):
    return _plain(patch_totals(_files(spark, sf_dir)))


@query
def risk_scores(spark, sf_dir):
    risk = file_risk(_files(spark, sf_dir))
    return _plain(risk.withColumn("reasons", F.array_join("reasons", " | ")))


@query
def risk_levels(spark, sf_dir):
    return _plain(risk_histogram(file_risk(_files(spark, sf_dir))))


@query
def risk_top10(spark, sf_dir):
    top = riskiest_files(file_risk(_files(spark, sf_dir)), 10)
    return _plain(top.select("patch_id", "rank", "file_seq", "path", "score", "level"))


@query
def last_wins_view(spark, sf_dir):
    last = last_per_path(file_risk(_files(spark, sf_dir)))
    return _plain(last.select("patch_id", "path", "file_seq", "score", "level"))


@query
def symbols(spark, sf_dir):
    return _plain(symbol_table(_files(spark, sf_dir)))


def _facts(*kinds: str) -> Query:
    def run(spark, sf_dir):
        facts = arch.arch_facts(_files(spark, sf_dir), list(kinds))
        return _plain(facts.select("patch_id", "kind", "ord", "path", "name", "text"))

    return run


QUERIES["components"] = _facts(arch.NEW, arch.REMOVED)
QUERIES["api_changes"] = _facts(arch.API)
QUERIES["dependencies"] = _facts(arch.DEPENDENCY)
QUERIES["subsystems"] = _facts(arch.SUBSYSTEM)
QUERIES["side_effects"] = _facts(arch.SIDE_EFFECT)
QUERIES["code_risks"] = _facts(arch.CONCURRENCY, arch.MEMORY)


@query
def token_estimate(spark, sf_dir):
    return _plain(file_tokens(_files(spark, sf_dir)))


@query
def token_totals(spark, sf_dir):
    return _plain(patch_tokens(file_tokens(_files(spark, sf_dir))))


@query
def token_by_path(spark, sf_dir):
    return _plain(path_breakdown(file_tokens(_files(spark, sf_dir))))


@query
def token_map(spark, sf_dir):
    maps = token_breakdown(file_tokens(_files(spark, sf_dir)))
    entries = F.transform(
        F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return maps.select("patch_id", F.array_join(entries, "; ").alias("breakdown"))


@query
def token_top10(spark, sf_dir):
    return _plain(top_paths_by_tokens(file_tokens(_files(spark, sf_dir))))


@query
def prose_tokens(spark, sf_dir):
    docs = parquet(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        text_tokens(F.col("text"), is_code=False).alias("prose_tokens"),
        text_tokens(F.col("text")).alias("code_tokens"),
        prompt_tokens(F.col("text")).alias("quick_tokens"),
    )


@query
def turn_tokens(spark, sf_dir):
    turns = parquet(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", "role", text_tokens(F.col("text"), is_code=False).alias("prose_tokens")
    )


@query
def context_budget(spark, sf_dir):
    hunks = hunk_table(_files(spark, sf_dir))
    return _plain(
        hunks.select(
            "patch_id",
            "file_seq",
            "hunk_seq",
            F.md5(limit_context(F.col("text"), 1)).alias("budget_1"),
            F.md5(limit_context(F.col("text"), 0)).alias("budget_0"),
        )
    )


@query
def collapsed_runs(spark, sf_dir):
    """Kept lines and collapsed runs per hunk of the stripped patch."""
    kept = with_meaningful(text_files(_files(spark, sf_dir)), False, False)
    lines = redaction.strip_files(kept, redaction.API_SAFE, core_context=1)
    count = F.regexp_extract("text", r"\A··· \[(\d+) line", 1)
    return _plain(
        lines.groupBy("patch_id", "file_seq", "hunk_seq").agg(
            F.count_if(count == "").alias("kept_lines"),
            F.count_if(count != "").alias("runs"),
            F.coalesce(F.sum(F.nullif(count, F.lit("")).cast("bigint")), F.lit(0)).alias("redacted_lines"),
        )
    )


def _redacted(mode: str) -> Query:
    def run(spark, sf_dir):
        kept = with_meaningful(text_files(_files(spark, sf_dir)))
        return _plain(redaction.strip_files(kept, mode))

    return run


QUERIES["redact_full"] = _redacted(redaction.FULL)
QUERIES["redact_api_safe"] = _redacted(redaction.API_SAFE)
QUERIES["redact_api_safe_comments"] = _redacted(redaction.API_SAFE_COMMENTS)


def _redacted_lines(table: str, key: str, text: str, mode: str) -> Query:
    def run(spark, sf_dir):
        rows = spread(parquet(spark, sf_dir, table).select(key, text), key).select(
            key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")
        )
        path = F.concat(F.lit(f"{table}/"), F.col(key))
        return _plain(
            rows.select(
                key, "line_no", redaction.pseudonymize_line(F.col("line"), path, mode).alias("redacted")
            )
        )

    return run


QUERIES["redact_documents"] = _redacted_lines("documents", "doc_id", "text", redaction.FULL)
QUERIES["redact_pages"] = _redacted_lines("pages", "page_id", "html", redaction.API_SAFE_COMMENTS)


def _flows(spark, sf_dir, name_chars: int | None = None) -> DataFrame:
    return flow.flow_nodes(flow.patch_sources(_files(spark, sf_dir)), FILE_KEYS, name_chars)


def _drawn_flows(spark, sf_dir) -> DataFrame:
    return _flows(spark, sf_dir, flow.NAME_CHARS)


@query
def flow_nodes(spark, sf_dir):
    return _plain(_flows(spark, sf_dir))


@query
def flow_edges(spark, sf_dir):
    return _plain(flow.flow_edges(_flows(spark, sf_dir), FILE_KEYS))


@query
def flow_edges_shown(spark, sf_dir):
    nodes = _drawn_flows(spark, sf_dir)
    return _plain(flow.flow_edges(nodes, FILE_KEYS, limit=flow.MAX_DIAGRAM_NODES))


@query
def flow_charts(spark, sf_dir):
    return _plain(flow.flowcharts(_drawn_flows(spark, sf_dir), FILE_KEYS))


@query
def flow_calls(spark, sf_dir):
    return _plain(flow.sequence_charts(_drawn_flows(spark, sf_dir), FILE_KEYS))


@query
def flow_states(spark, sf_dir):
    return _plain(flow.state_charts(_drawn_flows(spark, sf_dir), FILE_KEYS))


@query
def flow_first_files(spark, sf_dir):
    return _plain(flow.first_flow_files(_drawn_flows(spark, sf_dir)))


@query
def page_flows(spark, sf_dir):
    pages = parquet(spark, sf_dir, "pages").select("page_id", F.col("html").alias("code"))
    return _plain(flow.flow_nodes(pages, ["page_id"]))


@query
def page_charts(spark, sf_dir):
    pages = parquet(spark, sf_dir, "pages").select("page_id", F.col("html").alias("code"))
    return flow.code_flow_charts(pages, ["page_id"], "sequence")


def _rows(spark, sf_dir, hunks: bool = False) -> DataFrame:
    return reports.review_rows(_files(spark, sf_dir), OPTIONS, hunks)


@query
def summary_report(spark, sf_dir):
    return _plain(reports.summaries(_rows(spark, sf_dir), OPTIONS))


@query
def changed_files(spark, sf_dir):
    return reports.changed_file_lists(_rows(spark, sf_dir))


@query
def arch_report(spark, sf_dir):
    return reports.architecture_reports(reports.report_facts(_files(spark, sf_dir), OPTIONS), OPTIONS)


@query
def prompt_rows(spark, sf_dir):
    prompts = reports.review_prompts(_rows(spark, sf_dir, hunks=True), OPTIONS)
    return prompts.select("patch_id", "prompt", prompt_tokens(F.col("prompt")).alias("prompt_tokens"))


@query
def file_reports(spark, sf_dir):
    return _plain(reports.file_reports(_rows(spark, sf_dir, hunks=True), OPTIONS))


@query
def review_json(spark, sf_dir):
    rows, facts = reports.review_tables(_files(spark, sf_dir), OPTIONS, hunks=False)
    documents = reports.review_documents(rows, facts, OPTIONS)
    # The two engines print doubles differently, so the cost is a column of its own.
    cost = F.get_json_object("document", "$.token_estimate.estimated_cost_usd").cast("double")
    return documents.select(
        "patch_id",
        F.regexp_replace("document", r',"estimated_cost_usd":[^}]*', "").alias("document"),
        cost.alias("estimated_cost_usd"),
    )


def _stored_rows(spark, sf_dir, hunks: bool) -> DataFrame:
    return stored_alone(spark, lambda: _rows(spark, sf_dir, hunks), "zstd")


def _stored_facts(spark, sf_dir) -> DataFrame:
    return stored(reports.report_facts(_files(spark, sf_dir), OPTIONS))


@query
def document_summary(spark, sf_dir):
    """The summary as ordered text files, read back."""
    lines = documents.document_lines(documents.summary_entries(_stored_rows(spark, sf_dir, False), OPTIONS))
    folder = shared_folder(spark)
    documents.write_documents(lines, folder)
    parts = read_text_runs(spark, folder).withColumnRenamed("key", "patch_id")
    ordered = F.array_sort(F.collect_list(F.struct("part", "value")))
    text = F.array_join(F.transform(ordered, lambda p: p["value"]), "")
    return parts.groupBy("patch_id").agg(F.regexp_replace(text, r"\n\z", "").alias("report"))


@query
def document_changed_files(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir, False)
    lines = documents.document_lines(documents.changed_file_entries(rows))
    return documents.joined(lines).withColumnRenamed("document", "report")


@query
def document_architecture(spark, sf_dir):
    facts = _stored_facts(spark, sf_dir)
    lines = documents.document_lines(documents.architecture_entries(facts, OPTIONS))
    return documents.joined(lines).withColumnRenamed("document", "report")


@query
def document_prompt(spark, sf_dir):
    lines = documents.lines_alone(
        spark, lambda: documents.prompt_entries(_stored_rows(spark, sf_dir, True), OPTIONS)
    )
    return documents.joined(lines).withColumnRenamed("document", "prompt")


@query
def document_json(spark, sf_dir):
    def parts() -> list[DataFrame]:
        rows, facts = reports.review_tables(_files(spark, sf_dir), OPTIONS, hunks=False)
        return documents.json_entries(stored(rows), stored(facts), OPTIONS)

    whole = documents.joined(documents.lines_alone(spark, parts), "")
    return whole.select("patch_id", F.regexp_replace("document", r',"estimated_cost_usd":[^}]*', "").alias("document"))


@query
def token_summary(spark, sf_dir):
    return _plain(reports.token_summaries(_rows(spark, sf_dir), OPTIONS))


@query
def snapshot_statuses(spark, sf_dir):
    return snapshot_status(*document_snapshots(spark, sf_dir))


_COMPARED = ["path", "old_path", "new_path", "binary", "n_hunks", "added", "deleted"]


@query
def snapshot_lines(spark, sf_dir):
    files = compare_snapshots(*document_snapshots(spark, sf_dir))
    return _plain(files.select(*_COMPARED))


@query
def snapshot_change_set(spark, sf_dir):
    files = as_change_set(compare_snapshots(*document_snapshots(spark, sf_dir)), "documents")
    return _plain(files.select(*FILE_KEYS, *_COMPARED))


@query
def snapshot_totals(spark, sf_dir):
    files = as_change_set(compare_snapshots(*document_snapshots(spark, sf_dir)), "documents")
    return _plain(patch_totals(files))


@query
def snapshot_exclude(spark, sf_dir):
    files = compare_snapshots(*document_snapshots(spark, sf_dir), exclude=["moved/*", "*.bin"])
    return _plain(files.select(*_COMPARED))


@query
def file_pairs(spark, sf_dir):
    left, right = document_snapshots(spark, sf_dir)
    name = F.substring_index("path", "/", -1)
    old = left.select(name.alias("name"), F.col("path").alias("left_path"), F.col("content").alias("left"))
    new = right.select(name.alias("name"), F.col("path").alias("right_path"), F.col("content").alias("right"))
    return _plain(compare_file_pairs(old.join(new, "name")).select(*_COMPARED))


@query
def xml_report(spark, sf_dir):
    files = load_report(spark, report_files(spark, sf_dir))
    return _plain(files.select("old_path", "new_path", "path", "binary", "n_hunks", "body", "added", "deleted"))


@query
def xml_report_changed(spark, sf_dir):
    return _plain(patch_totals(load_report(spark, report_files(spark, sf_dir))).groupBy().agg(
        *[F.sum(c).alias(c) for c in ("changed_files", "binary_files", "lines_added", "lines_deleted")]
    ))


@query
def piece_statistics(spark, sf_dir):
    return _plain(piece_file_stats(conversation_pieces(spark, sf_dir)))


@query
def piece_totals(spark, sf_dir):
    return _plain(patch_totals(piece_file_stats(conversation_pieces(spark, sf_dir))))


def _pieces(spark, sf_dir) -> Pieces:
    return Pieces(patch_line_pieces(spark, sf_dir))


@query
def piece_noise(spark, sf_dir):
    return _plain(_pieces(spark, sf_dir).hunks.select(*FILE_KEYS, "hunk_seq", "ws_only", "comment_only"))


@query
def piece_meaningful(spark, sf_dir):
    kept = _pieces(spark, sf_dir).meaningful()
    return kept.withColumn("meaningful", F.col("n_kept") > 0)


@query
def piece_token_estimate(spark, sf_dir):
    return _plain(_pieces(spark, sf_dir).file_tokens())


@query
def piece_symbols(spark, sf_dir):
    return _plain(_pieces(spark, sf_dir).symbols())


STRIPPED = replace(OPTIONS, strip_patch=True)


@query
def stripped_file_reports(spark, sf_dir):
    rows = reports.review_rows(_files(spark, sf_dir), STRIPPED)
    return _plain(reports.file_reports(rows, STRIPPED))


@query
def stripped_prompts(spark, sf_dir):
    rows = reports.review_rows(_files(spark, sf_dir), STRIPPED)
    return reports.review_prompts(rows, STRIPPED)


@query
def patch_file_totals(spark, sf_dir):
    """Patches written to files, many to a file, and read back as whole files."""
    folder = shared_folder(spark)
    patches = synthetic_patches(spark, sf_dir).select("content")
    patches.write.option("maxRecordsPerFile", 500).text(folder)
    return _plain(
        load_patches(spark, folder).groupBy("path", "binary").agg(
            F.count("*").alias("entries"),
            F.sum("n_hunks").alias("hunks"),
            F.sum("added").alias("added"),
            F.sum("deleted").alias("deleted"),
        )
    )


@query
def snapshot_folders(spark, sf_dir):
    """Documents written to files by language and read back as a file tree."""
    folder = shared_folder(spark)
    docs = parquet(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 500).text(folder)
    # What Spark writes beside the rows is part of the tree as well.
    files = read_snapshot(spark, folder, exclude=["_SUCCESS", "*.crc"])
    lang = F.regexp_extract("path", "^lang=([^/]*)/", 1)
    return files.groupBy(lang.alias("lang")).agg(F.sum(F.length("content")).alias("bytes"))


@query
def tree_files(spark, sf_dir):
    """All files of a tree most of whose names start with a dot or underscore."""
    folder, _ = document_trees(spark, sf_dir)
    listing = list_files(spark, folder)
    read = read_files(listing, folder).select("path", F.sha2("content", 256).alias("content_sha256"))
    return listing.select("path", "length").join(read, "path")


TREE_EXCLUDE = ["_build/*", "*.log", "src/*/main.c", ".config/*"]


@query
def tree_excluded(spark, sf_dir):
    """Files left by globs that act while the tree is listed."""
    folder, _ = document_trees(spark, sf_dir)
    return list_files(spark, folder, TREE_EXCLUDE).select("path", "length")


@query
def tree_compare(spark, sf_dir):
    return _plain(compare_folders(spark, *document_trees(spark, sf_dir)).select(*_COMPARED))


@query
def patch_range_totals(spark, sf_dir):
    """Patch files cut into byte ranges at file headers, of a size that many entries cross."""
    folder = shared_folder(spark)
    synthetic_patches(spark, sf_dir).select("content").write.option("maxRecordsPerFile", 500).text(folder)
    pieces = read_patch_pieces(spark, folder, exclude=["_SUCCESS", "*.crc"], piece_bytes=20_000)
    return _plain(
        piece_file_stats(pieces).groupBy("path", "binary").agg(
            F.count("*").alias("entries"),
            F.sum("n_hunks").alias("hunks"),
            F.sum("added").alias("added"),
            F.sum("deleted").alias("deleted"),
        )
    )


@query
def package_tokens(spark, sf_dir):
    """Token summaries of a written review package."""
    paths = export_review_package(synthetic_patches(spark, sf_dir), shared_folder(spark), OPTIONS)
    return _plain(spark.read.parquet(paths["token_estimate"]))
