"""Patches, snapshots and reports derived from the driver's tables.

Every word of a document becomes one diff line, so the work grows with the text
and no row or word is left out.  The arithmetic uses only integers, which lets
an independent SQL engine derive the same lines without building a patch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.session import ship_package
from diffloom.sources.file_tree import write_files
from diffloom.storage import shared_folder

EXTENSIONS = ["py", "cpp", "js", "ts", "java", "cs", "c", "h", "sql", "md", "jsx", "sh"]
FOLDERS = [
    "src/auth/", "lib/core/", "app/", "", "ui/widgets/", "services/", "src/", "config/",
    "net\\io/", "tests/",
]
NAMES = ["manager", "index", "router", "util", "base_x", "model", "main"]
# {w} is the word of the line, {i} its number in the document.
LINES = [
    "import {w}",
    "from {w} import thing",
    "#include <{w}.h>",
    "using {w};",
    "const m = require('{w}')",
    "import x from '{w}'",
    "class {w} {",
    "public class Kind{i} {",
    "interface Port{i} {",
    "export class View{i} {",
    "struct Rec{i} {",
    "namespace ns{i} {",
    "def run_{i}(self, a):",
    "def {w}(a, b):",
    "public static int Get{i}(int a) {",
    "int Widget::count{i}(const int a) const {",
    "function do{i}(a) {",
    "const arrow{i} = (a, b) => a + b;",
    "export default function main{i}() {",
    "app.get('/{w}', handler);",
    "[HttpGet]",
    "@GetMapping(\"/{w}\")",
    "module.exports = {w};",
    "    if ({w} > {i}) {",
    "else if (a{i} == 0) {",
    "else {",
    "switch (k{i}) {",
    "case {w}:",
    "default:",
    "for (int i = 0; i < {i}; i++) {",
    "while (p{i}.next() && not_yet_done_with_all_of_it_{i}) {",
    "try {",
    "catch (Error{i} e) {",
    "finally {",
    "bus.on('ev{i}', cb);",
    "emit(\"{w}\");",
    "dispatch(act{i});",
    "value = compute_{i}({w}, 42, 0, 3.14f);",
    "",
    "class Late{i}",
    "y = eval",
    "  ({w});",
    "char *b = malloc(10); memcpy(b, a, 7);",
    "std::unique_ptr<int> p{i};",
    "std::mutex lock_{i}; // {w}",
    "async function go{i}() { await {w}; }",
    "throw {w};",
    "os.system(cmd{i})",
    "virtual ~D{i}();",
    "// TODO fix security {w}",
    "s = \"{w}\" + 'a' + f\"b{i}\";",
    "MAX_SIZE = EOF + Limit{i} + HTTP_OK; /* {w} */",
    "# {w}",
    "*** {w} ***",
    "==== {i}",
    "---- {w}",
    "  part{i}.o(.text) refers to {w}",
    "Code Size {i}",
    "\\ No newline at end of file",
    "{w}",
]

# Integer formulas shared by both engines; d is the document number, i the
# number of the word.
FILE_LINES = "(15 + (d % 6) * 100)"
HUNK_LINES = "(4 + (d % 7) * 5)"


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _literal(text: str) -> str:
    """SQL literal that both engines read the same way."""
    return "'" + text.replace("'", "''") + "'"


def duck_list(items: list[str]) -> str:
    return f"[{', '.join(map(_literal, items))}]"


PATH = (
    "concat({folders}, {names}, d, '_', pf, '.', {extensions})"
)
TEMPLATE_NUMBER = (
    f"(((d * 5 + f * 11) % {len(LINES)} + (j % (3 + (d + f) % 9))) % {len(LINES)})"
)
# Body line of word w at place p of hunk h; prev is the word before it.
BODY_LINE = """
CASE WHEN (d + f + h) % 9 = 0 THEN
       CASE WHEN p % 2 = 0 THEN concat('-', w) ELSE concat('+  ', prev, ' ') END
     WHEN (d + f + h) % 9 = 1 THEN
       concat(CASE p % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '+' ELSE ' ' END,
              CASE WHEN d % 2 = 0 THEN '// ' ELSE '# ' END, w)
     ELSE
       concat(CASE WHEN (j * 3 + d) % 5 < 2 THEN '+' WHEN (j * 3 + d) % 5 = 2 THEN '-'
                   WHEN (j * 3 + d) % 5 = 3 THEN ' ' WHEN d % 2 = 0 THEN '+' ELSE ' ' END,
              replace(replace({template}, '{{w}}', w), '{{i}}', cast(i AS {string})))
END
"""
HUNK_LINE = """
concat('@@ -', 1 + h * hs, CASE WHEN h % 5 = 0 THEN '' ELSE concat(',', hs) END,
       ' +', 1 + h * hs, CASE WHEN h % 5 = 0 THEN '' ELSE concat(',', hs) END, ' @@ ', w)
"""
OLD_PATH = "CASE WHEN (d + f) % 10 = 0 THEN '/dev/null' ELSE concat('a/', {path}) END"
NEW_PATH = "CASE WHEN (d + f) % 10 = 1 THEN '/dev/null' ELSE concat('b/', {path}) END"


def spread(table: DataFrame, key: str) -> DataFrame:
    """Deal rows out to the shuffle partitions: the analysis is heavy next to the reading."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def split_words(text: str) -> list[str]:
    """The text cut at runs of spaces and line ends; such a run at its start or end leaves an empty word."""
    plain = text.replace("\n", " ")
    first = [""] if plain[:1] in ("", " ") else []
    return [*first, *filter(None, plain.split(" ")), *([""] if plain[-1:] == " " else [])]


def patch_text(number: int, words: list[str]) -> str:
    """Patch of document ``number``: the line formulas above, in runs of one file and hunk."""
    d, count = number, len(LINES)
    if d < 0:
        raise ValueError(f"documents are numbered from 0: {d}")
    file_lines, hunk_lines = 15 + (d % 6) * 100, 4 + (d % 7) * 5
    even = "+" if d % 2 == 0 else " "
    marks = [("+", "+", "-", " ", even)[(j * 3 + d) % 5] for j in range(5)]
    comment = "// " if d % 2 == 0 else "# "
    comments = [mark + comment for mark in "+-+ "]
    out: list[str] = []
    for f, start in enumerate(range(0, len(words), file_lines)):
        pf = f - (f % 7 == 6)
        path = (
            f"{FOLDERS[(d + pf) % len(FOLDERS)]}{NAMES[(d + 2 * pf) % len(NAMES)]}{d}_{pf}"
            f".{EXTENSIONS[(d * 3 + pf) % len(EXTENSIONS)]}"
        )
        out.append("--- /dev/null" if (d + f) % 10 == 0 else f"--- a/{path}")
        new_path = "/dev/null" if (d + f) % 10 == 1 else f"b/{path}"
        out.append(f"+++ {new_path}" + ("\t2024-05-01" if f % 3 == 0 else ""))
        if f % 13 == 5:
            out.append("Binary files a and b differ")
        period = 3 + (d + f) % 9
        templates = [LINES[((d * 5 + f * 11) % count + k) % count] for k in range(period)]
        stop = min(start + file_lines, len(words))
        for h, i in enumerate(range(start, stop, hunk_lines)):
            own = words[i:min(i + hunk_lines, stop)]
            size = "" if h % 5 == 0 else f",{hunk_lines}"
            at = f"{1 + h * hunk_lines}{size}"
            out.append(f"@@ -{at} +{at} @@ {own[0]}")
            form = (d + f + h) % 9
            if form == 0:
                out += [f"+  {own[p - 1]} " if p % 2 else f"-{w}" for p, w in enumerate(own)]
            elif form == 1:
                out += [comments[p % 4] + w for p, w in enumerate(own)]
            else:
                first = i - start
                for j, w in enumerate(own, first):
                    line = marks[j % 5] + templates[j % period].replace("{w}", w)
                    out.append(line.replace("{i}", str(start + j)) if "{i}" in line else line)
    if d % 3 == 0:
        out.append("")
    return ("\r\n" if d % 4 == 1 else "\n").join(out)


#: Characters of patches that a batch of rows holds, about.
BATCH_CHARS = 8 << 20


def _write_patches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, texts = batch.column("d").to_pylist(), batch.column("text")
        rows: list[str | None] = []
        held = done = 0
        for at, d in enumerate(numbers):
            text = texts[at].as_py()
            # A document without a number has no lines, one without a text no patch.
            rows.append(text if text is None else "" if d is None else patch_text(d, split_words(text)))
            held += len(rows[-1] or "")
            if held >= BATCH_CHARS or at == len(numbers) - 1:
                keys = [None if n is None else str(n) for n in numbers[done:at + 1]]
                columns = [pa.array(keys, pa.string()), pa.array(rows, pa.string())]
                yield pa.record_batch(columns, ["patch_id", "content"])
                rows, held, done = [], 0, at + 1


def synthetic_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch per document: ``patch_id, content``."""
    ship_package(spark)
    docs = spread(parquet(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    numbered = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    return numbered.mapInArrow(_write_patches, "patch_id string, content string")


def patch_line_pieces(spark: SparkSession, sf_dir: str, lines: int = 97) -> DataFrame:
    """The synthetic patches in pieces of so many lines, which cut files and hunks anywhere."""
    text = F.regexp_replace(F.replace("content", F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    whole = synthetic_patches(spark, sf_dir).select("patch_id", F.split(text, "\n", -1).alias("rows"))
    starts = F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / lines).cast("int"))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("rows", i * lines + 1, lines), "\n"))
    return whole.select("patch_id", F.posexplode(cut).alias("piece_no", "piece")).select(
        "patch_id", F.col("piece_no").cast("long").alias("piece_no"), F.concat("piece", F.lit("\n")).alias("content")
    )


PIECE_FILE, PIECE_HUNK = "(c + t * 5 + i) % 23 = 0", "(t * 3 + i) % 7 = 0"
PIECE_MARK = "CASE (c + t + i) % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN ' ' ELSE '+' END"


def conversation_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch per conversation, one piece per turn, one line per word.

    Files and hunks begin wherever the formulas say, so most of them span turns.
    """
    turns = spread(parquet(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id")
    words = turns.select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.split("text", "[ \n]+", -1).alias("words")
    )
    line = f"""
        transform(words, (w, i) -> concat(
            CASE WHEN {PIECE_FILE} THEN concat('--- a/c', c, '_', t, '_', i, '.py\\n',
                                               '+++ b/c', c, '_', t, '_', i, '.py\\n') ELSE '' END,
            CASE WHEN {PIECE_HUNK} THEN '@@ -1 +1 @@\\n' ELSE '' END,
            {PIECE_MARK}, w))
    """
    return words.select(
        F.col("c").cast("string").alias("patch_id"),
        F.col("t").alias("piece_no"),
        F.array_join(F.expr(line), "\n").alias("content"),
    )


def document_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the documents, one file each.

    By the last digit of the number: 0 moved to another folder, 3 and 4 got one
    line more, 5 lost the first line, 6 has other line ends, 7 is binary.
    """
    docs = parquet(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 10)
    name = F.concat(F.lit("d"), "doc_id", F.when(F.col("k") == 7, ".bin").otherwise(".txt"))
    text = F.concat("text", F.lit("\n"))
    content = F.when(F.col("k") == 7, F.concat(F.unhex(F.lit("FF00")), text.cast("binary")))
    later = (
        F.when(F.col("k").isin(3, 4), F.concat(text, F.lit("appended "), "doc_id", F.lit("\n")))
        .when(F.col("k") == 5, F.regexp_replace(text, r"\A[^\n]*\n", ""))
        .when(F.col("k") == 6, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .otherwise(text)
    )
    folder = F.when(F.col("k") == 0, "moved/").otherwise("docs/")
    left = docs.select(
        F.concat(F.lit("docs/"), name).alias("path"),
        F.coalesce(content, text.cast("binary")).alias("content"),
    )
    right = docs.select(
        F.concat(folder, name).alias("path"),
        F.coalesce(content, later.cast("binary")).alias("content"),
    )
    return left, right


#: Folders and endings of the files of a document tree; most of them start with a dot or underscore.
TREE_FOLDERS = ["src/", "src/.cache/", "_build/", "docs/_draft/.old/", "", "pkg_a/", ".config/"]
TREE_NAMES = ["__init__.py", ".gitignore", "main.c", "_notes.txt", "x.log"]


def _tree_path(key: str) -> str:
    """Path of document ``key`` in SQL that both engines run; one folder holds a third of them."""
    folder = f"CASE WHEN {key} % 3 = 0 THEN 'src/' ELSE {{folders}} END"
    return f"concat({folder}, 'd', {key}, '/', {{names}})"


TREE_PATH = _tree_path("doc_id").format(
    folders="CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {_literal(f)}" for i, f in enumerate(TREE_FOLDERS)) + " END",
    names="CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {_literal(n)}" for i, n in enumerate(TREE_NAMES)) + " END",
)


def document_trees(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Two folders with a file for each document; the second has a line more in every fourth one.

    Every tenth document is missing on the right and every tenth, five later, on the left.
    """
    docs = spread(parquet(spark, sf_dir, "documents"), "doc_id").selectExpr(
        "doc_id", f"{TREE_PATH} AS path", "concat(coalesce(text, ''), '\n') AS content"
    )
    more = F.when(F.col("doc_id") % 4 == 1, F.concat("content", F.lit("appended "), "doc_id", F.lit("\n")))
    sides = {
        "left": docs.where("doc_id % 10 <> 5"),
        "right": docs.where("doc_id % 10 <> 0").withColumn("content", F.coalesce(more, "content")),
    }
    base = shared_folder(spark)
    for name, table in sides.items():
        write_files(table.select("path", "content"), f"{base}/{name}")
    return f"{base}/left", f"{base}/right"


def report_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the orders as XML compare reports and return their folder."""
    orders = parquet(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    statuses = F.array(*map(F.lit, REPORT_STATUSES))
    status = F.get(statuses, (key % len(REPORT_STATUSES)).cast("int"))
    counts = (
        F.when(key % 5 == 0, F.lit(""))
        .when(key % 5 == 1, F.lit("n/a"))
        .when(key % 5 == 2, F.lit("0"))
        .otherwise(F.concat(F.lit(" "), F.col("o_custkey") % 1000))
    )
    item = F.concat(
        F.lit('<item leftfile="src&amp;lib/o'), key, F.lit('.c"'),
        F.when(status == "leftonly", F.lit("")).otherwise(
            F.concat(F.lit(' rightfile="b/src&amp;lib/o'), key, F.lit('.c"'))
        ),
        F.lit(' status="'), status, F.lit('" leftlines="'), counts,
        F.lit('" rightlines="'), F.when(key % 3 == 0, counts).otherwise(key.cast("string")), F.lit('"/>'),
    )
    folder = shared_folder(spark)
    reports = spread(orders.select("o_orderkey", item.alias("value")), "o_orderkey").select("value")
    reports.mapInPandas(_document_writer(), "value string").write.text(folder)
    return folder


def _document_writer():
    """Function for ``mapInPandas``: each partition becomes one file with one root."""

    def as_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["<report><folder>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</folder></report>"]})

    return as_document


REPORT_STATUSES = ["identical", "Different", "leftonly", "rightonly", "binarydiffer", "error", "unknown"]


def duck_body() -> str:
    """SQL of an independent engine for the body lines, hunks and files."""
    path = PATH.format(
        folders=f"{duck_list(FOLDERS)}[(d + pf) % {len(FOLDERS)} + 1]",
        names=f"{duck_list(NAMES)}[(d + 2 * pf) % {len(NAMES)} + 1]",
        extensions=f"{duck_list(EXTENSIONS)}[(d * 3 + pf) % {len(EXTENSIONS)} + 1]",
    )
    body = BODY_LINE.format(template=f"{duck_list(LINES)}[{TEMPLATE_NUMBER} + 1]", string="VARCHAR")
    return f"""
words AS (
  SELECT doc_id AS d, unnest(string_split_regex(text, '[ \\n]+')) AS w,
         unnest(range(len(string_split_regex(text, '[ \\n]+')))) AS i
  FROM documents),
placed AS (
  SELECT d, w, i, lag(w) OVER (PARTITION BY d ORDER BY i) AS prev,
         {FILE_LINES} AS fs, {HUNK_LINES} AS hs
  FROM words),
numbered AS (
  SELECT *, i // fs AS f, i % fs AS j, (i % fs) // hs AS h, (i % fs) % hs AS p,
         i // fs - CASE WHEN (i // fs) % 7 = 6 THEN 1 ELSE 0 END AS pf
  FROM placed),
body AS MATERIALIZED (
  SELECT d, f, h, j, p, pf, hs, w, {body} AS line FROM numbered),
file AS MATERIALIZED (
  SELECT d, f, cast(d AS VARCHAR) AS patch_id, f + 1 AS file_seq, {path} AS path,
         {duck_list(EXTENSIONS)}[(d * 3 + pf) % {len(EXTENSIONS)} + 1] AS extension,
         f % 13 = 5 AS is_binary
  FROM body WHERE j = 0),
lines AS MATERIALIZED (
  SELECT d, f, h, p + 1 AS line_no, line,
         CASE WHEN line LIKE '+%' AND line NOT LIKE '+++%' THEN 'add'
              WHEN line LIKE '-%' AND line NOT LIKE '---%' THEN 'del'
              WHEN line LIKE ' %' THEN 'ctx' ELSE 'other' END AS kind
  FROM body
  UNION ALL
  SELECT d, f, h, 0, {HUNK_LINE}, 'header' FROM body WHERE p = 0)
"""
