"""Equivalent SQL for the registered queries, for an independent engine.

The SQL derives diff lines straight from the base tables: it never builds or
parses a patch, so it checks the parser as well as the operators.
"""

from __future__ import annotations

import re

from diffloom.functions import rules
from diffloom.plans.reports import PROMPT_TEMPLATE, STRIPPED_NOTICE
from diffloom.workload.fixtures import PIECE_FILE, PIECE_HUNK, PIECE_MARK, TREE_PATH, duck_body

_CLASS = {r"\w": r"\p{L}\p{N}_"}


def re2(pattern: str, flags: str = "") -> str:
    """Quoted pattern for RE2, whose \\w is ASCII only."""
    out, in_class = [], False
    for tok in re.findall(r"\\.|\[\^?|\]|.", pattern, re.S):
        if tok.startswith("["):
            in_class = True
        elif tok == "]":
            in_class = False
        elif tok in _CLASS:
            tok = _CLASS[tok] if in_class else f"[{_CLASS[tok]}]"
        out.append(tok)
    prefix = f"(?{flags})" if flags else ""
    return quote(prefix + "".join(out))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HUNKS = """
hunk AS MATERIALIZED (
  SELECT d, f, h, string_agg(line, chr(10) ORDER BY line_no) AS text,
         count(*) FILTER (kind = 'add') AS added, count(*) FILTER (kind = 'del') AS deleted
  FROM lines GROUP BY d, f, h),
file_agg AS MATERIALIZED (
  SELECT d, f, count(*) AS n_hunks, sum(added) AS added, sum(deleted) AS deleted
  FROM hunk GROUP BY d, f)
"""


def _comment_regex(starts: list[str]) -> str:
    return quote(r"^\s*($|" + "|".join(re.escape(s) for s in starts) + ")")


NOISE = f"""
changed AS (SELECT d, f, h, kind, substr(line, 2) AS t FROM lines WHERE kind IN ('add', 'del')),
net AS (
  SELECT d, f, h, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS norm,
         sum(CASE kind WHEN 'add' THEN 1 ELSE -1 END) AS n
  FROM changed GROUP BY ALL),
ws AS (SELECT d, f, h, bool_and(n = 0) AS ws_only FROM net GROUP BY d, f, h),
com AS (
  SELECT d, f, h, bool_and(CASE WHEN extension = 'py'
           THEN regexp_matches(t, {_comment_regex(rules.COMMENT_STARTS['py'])})
           ELSE regexp_matches(t, {_comment_regex(rules.COMMENT_STARTS_OTHER)}) END) AS comment_only
  FROM changed JOIN file USING (d, f) GROUP BY d, f, h),
noise AS MATERIALIZED (
  SELECT d, f, h, hunk.text, hunk.added, hunk.deleted, coalesce(ws_only, false) AS ws_only,
         coalesce(comment_only, false) AS comment_only
  FROM hunk LEFT JOIN ws USING (d, f, h) LEFT JOIN com USING (d, f, h)),
kept AS MATERIALIZED (SELECT * FROM noise WHERE NOT ws_only AND NOT comment_only)
"""

TEXTS = """
texts AS MATERIALIZED (
  SELECT d, f,
    string_agg(line, chr(10) ORDER BY h, line_no) AS body,
    coalesce(string_agg(substr(line, 2), chr(10) ORDER BY h, line_no) FILTER (kind IN ('add', 'del')), '') AS changed_text,
    coalesce(string_agg(substr(line, 2), chr(10) ORDER BY h, line_no) FILTER (kind = 'add'), '') AS added_text,
    coalesce(string_agg(substr(line, 2), chr(10) ORDER BY h, line_no) FILTER (kind = 'del'), '') AS removed_text,
    coalesce(string_agg(substr(line, 2), chr(10) ORDER BY h, line_no) FILTER (kind IN ('add', 'ctx')), '') AS post_image
  FROM lines GROUP BY d, f)
"""


def _first(column: str, patterns: list[tuple[str, str]]) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({column}, {re2(p, flags)}) THEN {quote(p)}" for p, flags in patterns
    )
    return f"CASE {whens} END"


_HIGH = _first("lower(path)", [(p, "i") for p in rules.HIGH_RISK_PATHS])
_ELEVATED = _first("lower(path)", [(p, "i") for p in rules.ELEVATED_PATHS])
_DANGER = _first("changed_text", rules.DANGEROUS_CONTENT)
_NOTABLE = " + ".join(
    f"regexp_matches(changed_text, {re2(p, flags)})::INT" for p, flags in rules.NOTABLE_CONTENT
)
_SENSITIVE = ", ".join(map(quote, rules.SENSITIVE_EXTENSIONS))
RISK = f"""
signals AS (
  SELECT *, added + deleted AS loc, {_HIGH} AS high_rule, {_ELEVATED} AS mid_rule,
         {_DANGER} AS danger_rule, {_NOTABLE} AS notable, extension IN ({_SENSITIVE}) AS sensitive
  FROM file JOIN file_agg USING (d, f) JOIN texts USING (d, f)),
scored AS (
  SELECT *, CASE WHEN loc > 300 THEN 3 WHEN loc > 100 THEN 1 ELSE 0 END
    + CASE WHEN n_hunks > 10 THEN 2 WHEN n_hunks > 5 THEN 1 ELSE 0 END
    + (high_rule IS NOT NULL)::INT * 4 + (mid_rule IS NOT NULL)::INT * 2
    + (danger_rule IS NOT NULL)::INT * 3 + notable + is_binary::INT * 2 + sensitive::INT * 3 AS score,
    list_filter([
      CASE WHEN loc > 300 THEN 'Large change (' || loc || ' LOC modified)'
           WHEN loc > 100 THEN 'Moderate change (' || loc || ' LOC modified)' END,
      CASE WHEN n_hunks > 10 THEN 'Scattered changes (' || n_hunks || ' hunks)' END,
      'High-risk path segment: ''' || high_rule || '''',
      'Risk-elevated path: ''' || mid_rule || '''',
      'Dangerous pattern: `' || danger_rule || '`',
      CASE WHEN is_binary THEN 'Binary file changed' END,
      CASE WHEN sensitive THEN 'Sensitive file type: .' || extension END], lambda x: x IS NOT NULL) AS found
  FROM signals),
risk AS MATERIALIZED (
  SELECT d, f, patch_id, file_seq, path, extension, is_binary, n_hunks, added, deleted, score,
         CASE WHEN score >= 4 THEN 'High' WHEN score >= 2 THEN 'Med' ELSE 'Low' END AS level,
         CASE WHEN len(found) = 0 THEN ['No specific risk signals detected'] ELSE found END AS reasons
  FROM scored)
"""


def _symbol_rows() -> str:
    selects, number = [], 0
    for language, patterns in rules.SYMBOL_PATTERNS.items():
        extensions = ", ".join(map(quote, rules.SYMBOL_EXTENSIONS[language]))
        for pattern in patterns:
            number += 1
            name = f"regexp_extract(t, {re2(pattern)}, 1)"
            if pattern.count(r"(\w+)") > 1:
                name = f"coalesce(nullif({name}, ''), regexp_extract(t, {re2(pattern)}, 2))"
            selects.append(
                f"SELECT d, f, h, line_no, {number} AS rule, {name} AS symbol FROM symbol_lines "
                f"WHERE extension IN ({extensions})"
            )
    return " UNION ALL ".join(selects)


SYMBOLS = f"""
symbol_lines AS MATERIALIZED (
  SELECT d, f, h, line_no, extension, regexp_replace(line, '^[+\\-@ ]+', '') AS t
  FROM lines JOIN kept USING (d, f, h) JOIN file USING (d, f)),
symbol_hits AS ({_symbol_rows()}),
symbol_first AS (
  SELECT d, f, symbol, min((h, line_no, rule)) AS place FROM symbol_hits WHERE symbol <> ''
  GROUP BY d, f, symbol),
symbols AS MATERIALIZED (
  SELECT d, f, symbol, row_number() OVER (PARTITION BY d, f ORDER BY place) AS ord FROM symbol_first)
"""


def _matches(column: str, pattern: str, group: int, sort: int, extra: str = "") -> str:
    found = f"regexp_extract_all({column}, {re2(pattern, 'm')}, {group})"
    return (
        f"SELECT d, f, {sort} AS sort, unnest(range(len({found}))) AS pos, unnest({found}) AS name{extra} "
        "FROM analysed"
    )


def _fact_ctes(signature_chars: int | None = None) -> str:
    new, removed, api, imports = [], [], [], []
    for k, p in enumerate(rules.NEW_COMPONENT_PATTERNS):
        new += [_matches("body", p, 1, 2 * k), _matches("added_text", p, 1, 2 * k + 1)]
    for k, p in enumerate(rules.REMOVED_COMPONENT_PATTERNS):
        removed.append(_matches("body", p, 1, k))
    for k, p in enumerate(rules.API_PATTERNS):
        api.append(_matches("added_text", p, 0, 2 * k, ", '+' AS side"))
        api.append(_matches("removed_text", p, 0, 2 * k + 1, ", '-' AS side"))
    for p in rules.IMPORT_PATTERNS:
        imports.append(_matches("added_text", p, 1, 0, ", '+' AS side"))
        imports.append(_matches("removed_text", p, 1, 0, ", '-' AS side"))

    def any_of(patterns: list[tuple[str, str]]) -> str:
        return " OR ".join(f"regexp_matches(added_text, {re2(p, fl)})" for p, fl in patterns)

    def union(parts: list[str]) -> str:
        return " UNION ALL ".join(parts)

    def first_seen(name: str, text: str, source: str, side: str = "''") -> str:
        return f"""
{name} AS (
  SELECT d, name, side, place, path, {text} AS text,
         row_number() OVER (PARTITION BY d ORDER BY place) AS ord
  FROM (SELECT d, name, side, place, place[1] AS f
        FROM (SELECT d, name, {side} AS side, min((f, sort, pos)) AS place FROM {source} GROUP BY ALL))
  JOIN file USING (d, f))"""

    api_text = (
        "CASE side WHEN '+' THEN 'Added in `' || path || '`: `' || name || '`' "
        "ELSE 'Removed from `' || path || '`: `' || name || '`' END"
    )
    signature = "trim(regexp_replace(name, '^\\s+|\\s+$', '', 'g'))"
    if signature_chars is not None:
        signature = f"substr({signature}, 1, {signature_chars})"
    skip = ", ".join(f"'{name}'" for name in ("src", "lib", "include", "source", "app", ".", ""))
    return ",".join([
        """
analysed AS MATERIALIZED (
  SELECT d, f, path, body, added_text, removed_text
  FROM texts JOIN file USING (d, f) WHERE NOT is_binary)""",
        f"new_hits AS ({union(new)})",
        f"removed_hits AS ({union(removed)})",
        f"api_hits AS (SELECT d, f, sort, pos, {signature} AS name, side FROM ({union(api)}))",
        f"import_hits AS (SELECT DISTINCT d, trim(name) AS name, side FROM ({union(imports)}))",
        first_seen("new_facts", "'`' || name || '` in `' || path || '`'", "new_hits"),
        first_seen("removed_facts", "'`' || name || '` from `' || path || '`'", "removed_hits"),
        first_seen("api_facts", api_text, "api_hits", "side"),
        """
import_sides AS (
  SELECT d, name, bool_or(side = '+') AS in_new, bool_or(side = '-') AS in_old FROM import_hits GROUP BY ALL),
dependency_all AS (
  SELECT d, name, CASE WHEN in_new THEN '+' ELSE '-' END AS side FROM import_sides WHERE in_new <> in_old),
dependency_facts AS (
  SELECT d, name, side, CASE side WHEN '+' THEN 'New dependency: `' ELSE 'Removed dependency: `' END
         || name || '`' AS text,
         row_number() OVER (PARTITION BY d ORDER BY side, name) AS ord,
         row_number() OVER (PARTITION BY d, side ORDER BY name) AS place
  FROM dependency_all)""",
        f"""
folders AS (
  SELECT d, f, string_split(replace(path, '\\', '/'), '/') AS parts FROM analysed),
subsystem_facts AS (
  SELECT d, name, row_number() OVER (PARTITION BY d ORDER BY name) AS ord FROM (
    SELECT DISTINCT d, coalesce(
      list_filter(parts[1:len(parts) - 1], lambda x: lower(x) NOT IN ({skip}))[1], parts[1]) AS name
    FROM folders))""",
        f"""
concurrency_facts AS (
  SELECT d, f, path, '`' || path || '` introduces concurrency primitives' AS text,
         row_number() OVER (PARTITION BY d ORDER BY f) AS ord
  FROM analysed WHERE {any_of(rules.CONCURRENCY_PATTERNS)}),
memory_facts AS (
  SELECT d, f, path, '`' || path || '` has new direct memory operations' AS text,
         row_number() OVER (PARTITION BY d ORDER BY f) AS ord
  FROM analysed WHERE {any_of(rules.MEMORY_PATTERNS)})""",
        """
new_dep_counts AS (SELECT d, count(*) AS n FROM dependency_all WHERE side = '+' GROUP BY d),
effect_rows AS (
  SELECT DISTINCT d, 1 AS k, 'Removed components may break existing callers/consumers.' AS text FROM removed_facts
  UNION ALL SELECT DISTINCT d, 2, 'Public API surface changed — verify backward compatibility.' FROM api_facts
  UNION ALL SELECT d, 3, n || ' new dependencies introduced — check for conflicts.' FROM new_dep_counts
  UNION ALL SELECT DISTINCT d, 4, 'New concurrency code increases risk of race conditions or deadlocks.' FROM concurrency_facts
  UNION ALL SELECT DISTINCT d, 5, 'Direct memory management changes may introduce leaks or UB.' FROM memory_facts),
effect_facts AS (SELECT d, text, row_number() OVER (PARTITION BY d ORDER BY k) AS ord FROM effect_rows)""",
        """
facts AS MATERIALIZED (
  SELECT d, 'new_component' AS kind, ord, path, name, text, ord AS in_list FROM new_facts
  UNION ALL SELECT d, 'removed_component', ord, path, name, text, ord FROM removed_facts
  UNION ALL SELECT d, 'api_change', ord, path, name, text, ord FROM api_facts
  UNION ALL SELECT d, 'dependency_change', ord, NULL, name, text, place FROM dependency_facts
  UNION ALL SELECT d, 'affected_subsystem', ord, NULL, name, name, ord FROM subsystem_facts
  UNION ALL SELECT d, 'side_effect', ord, NULL, text, text, ord FROM effect_facts
  UNION ALL SELECT d, 'concurrency_risk', ord, path, (f + 1)::VARCHAR, text, ord FROM concurrency_facts
  UNION ALL SELECT d, 'memory_risk', ord, path, (f + 1)::VARCHAR, text, ord FROM memory_facts)""",
    ])


FACTS, REPORT_FACTS = _fact_ctes(), _fact_ctes(80)

TOKENS = """
tokens AS MATERIALIZED (
  SELECT d, f, patch_id, file_seq, path, chars,
         greatest(1, floor(chars / 3.5::DOUBLE))::BIGINT AS tokens
  FROM (SELECT d, f, length(string_agg(text, chr(10) ORDER BY h)) AS chars FROM kept GROUP BY d, f)
  JOIN file USING (d, f) WHERE NOT is_binary),
by_path AS MATERIALIZED (
  SELECT d, patch_id, path, max_by(tokens, file_seq) AS tokens, sum(chars) AS chars, min(file_seq) AS first_seq
  FROM tokens GROUP BY d, patch_id, path)
"""

_NOISE_LINE = quote("|".join(rules.NON_SOURCE_LINES))


def _flow_ctes(documents: str, chars: int | None = None) -> str:
    """Nodes of ``documents``, a relation with columns d, f and code."""
    def cut(word: str, inner: str) -> str:
        if chars is None:
            return f"'{word} (' || {inner} || ')'"
        return (
            f"'{word} (' || CASE WHEN length({inner}) > {chars} THEN substr({inner}, 1, {chars}) || '...' "
            f"ELSE {inner} END || ')'"
        )

    def capture(pattern: str, name: str) -> str:
        """Trimmed first group where the pattern matches, else null; tried on likely lines only."""
        word = re.match(r"\^([a-z]+)", pattern).group(1)
        return (
            f"CASE WHEN starts_with(t, '{word}') AND regexp_matches(t, {re2(pattern)}) "
            f"THEN trim(regexp_extract(t, {re2(pattern)}, 1)) END AS {name}"
        )

    def clause(word: str, inner: str, kind: str, shorten: bool) -> str:
        name = cut(word, inner) if shorten else f"'{word} (' || {inner} || ')'"
        return (
            f"WHEN {inner} IS NOT NULL THEN CASE WHEN {inner} <> '' "
            f"THEN {{'k': '{kind}', 'n': {name}, 'c': {inner}}} END"
        )

    def fixed(word: str, pattern: str, kind: str) -> str:
        return (
            f"WHEN starts_with(t, '{word}') AND regexp_matches(t, {re2(pattern)}) "
            f"THEN {{'k': '{kind}', 'n': '{word}', 'c': NULL::VARCHAR}}"
        )

    captures = ", ".join(
        [
            capture(r"^if\s*\((.*?)\)", "c_if"),
            capture(r"^else\s+if\s*\((.*?)\)", "c_else_if"),
            capture(r"^switch\s*\((.*?)\)", "c_switch"),
            capture(r"^case\s+([^:]+):", "c_case"),
            capture(r"^for\s*\((.*?)\)", "c_for"),
            capture(r"^while\s*\((.*?)\)", "c_while"),
            capture(r"^for(?:each)?\s+\(.*?\s+(?:in|:)\s+(.*?)\)", "c_each"),
            capture(r"^catch\s*\((.*?)\)", "c_catch"),
        ]
        + [
            f"CASE WHEN contains(t, '(') AND regexp_matches(t, {re2(p)}) THEN regexp_extract(t, {re2(p)}, 1) "
            f"END AS e_{i}"
            for i, (p, _) in enumerate(rules.EVENT_PATTERNS)
        ]
        + [
            "CASE WHEN contains(t, '(') THEN regexp_extract(t, "
            "'(?:^|[^\\p{L}\\p{N}_])([A-Za-z_][A-Za-z0-9_]{2,})\\s*\\(', 1) ELSE '' END AS callee"
        ]
    )
    events = " ".join(
        f"WHEN e_{i} IS NOT NULL THEN {{'k': 'event_trigger', 'n': '{action}: ' || e_{i}, 'c': e_{i}}}"
        for i, (_, action) in enumerate(rules.EVENT_PATTERNS)
    )
    words = ", ".join(map(quote, rules.CONTROL_WORDS))
    slots = [
        f"""CASE {clause('if', 'c_if', 'if_else', True)} {clause('else if', 'c_else_if', 'if_else', True)}
             {fixed('else', r'^else\s*[{:]?\s*$', 'if_else')} END""",
        f"""CASE {clause('switch', 'c_switch', 'switch_case', False)}
             WHEN c_case IS NOT NULL THEN CASE WHEN c_case <> '' THEN
               {{'k': 'switch_case', 'n': 'case ' || c_case, 'c': NULL::VARCHAR}} END
             {fixed('default', r'^default\s*:', 'switch_case')} END""",
        f"""CASE {clause('for', 'c_for', 'loop', True)} {clause('while', 'c_while', 'loop', True)}
             {clause('foreach', 'c_each', 'loop', False)} END""",
        f"""CASE {fixed('try', r'^try\s*[{:]?\s*$', 'try_catch')}
             WHEN c_catch IS NOT NULL THEN
               {{'k': 'try_catch', 'n': CASE WHEN c_catch <> '' THEN 'catch (' || c_catch || ')' ELSE 'catch' END,
                'c': c_catch}}
             {fixed('finally', r'^finally\s*[{:]?\s*$', 'try_catch')} END""",
        f"""CASE {events} WHEN callee <> '' AND lower(callee) NOT IN ({words})
               AND NOT regexp_matches(callee, '^[A-Z][A-Z0-9]*$')
             THEN {{'k': 'function_call', 'n': 'Call: ' || callee || '()', 'c': NULL::VARCHAR}} END""",
    ]
    node_list = ", ".join(slots)
    return f"""
flow_docs AS MATERIALIZED ({documents}),
raw_lines AS (
  SELECT d, f, unnest(string_split(code, chr(10))) AS raw,
         unnest(range(len(string_split(code, chr(10))))) + 1 AS n
  FROM flow_docs),
source AS (
  SELECT d, f FROM raw_lines WHERE trim(raw) <> '' GROUP BY d, f
  HAVING avg(regexp_matches(raw, {_NOISE_LINE})::INT) < 0.34),
code_lines AS MATERIALIZED (
  SELECT d, f, n, trim(raw) AS t FROM raw_lines JOIN source USING (d, f)
  WHERE trim(raw) <> '' AND trim(raw) NOT LIKE '#%' AND trim(raw) NOT LIKE '//%'
    AND NOT regexp_matches(trim(raw), {_NOISE_LINE})),
captured AS MATERIALIZED (SELECT d, f, n, t, {captures} FROM code_lines),
flow_hits AS (
  SELECT d, f, n, unnest(range({len(slots)})) AS slot, unnest([{node_list}]) AS node FROM captured),
flow_first AS (
  SELECT d, f, node.k AS flow_type, node.n AS name, min((n, slot)) AS place,
         arg_min({{'c': node.c}}, (n, slot)).c AS condition
  FROM flow_hits WHERE node IS NOT NULL GROUP BY ALL),
nodes AS MATERIALIZED (
  SELECT d, f, row_number() OVER (PARTITION BY d, f ORDER BY place) AS ord, flow_type, name,
         condition, place[1] AS line_number
  FROM flow_first)
"""


_SUFFIXES = quote("(" + "|".join(re.escape(s) for s in rules.NON_SOURCE_SUFFIXES) + ")$")
_PATCH_SOURCES = (
    f"SELECT d, f, post_image AS code FROM texts JOIN file USING (d, f) "
    f"WHERE NOT regexp_matches(lower(path), {_SUFFIXES})"
)
PATCH_FLOWS, DRAWN_FLOWS = _flow_ctes(_PATCH_SOURCES), _flow_ctes(_PATCH_SOURCES, 40)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join([duck_body(), HUNKS, *ctes])


ORACLES: dict[str, str] = {}
_ID = "patch_id, file_seq"

ORACLES["file_statistics"] = with_ctes() + f"""
SELECT {_ID}, path, extension, is_binary AS binary, n_hunks::BIGINT AS n_hunks,
       added::BIGINT AS added, deleted::BIGINT AS deleted
FROM file JOIN file_agg USING (d, f)"""

ORACLES["file_paths"] = with_ctes() + f"""
SELECT {_ID}, CASE WHEN (d + f) % 10 = 0 THEN '/dev/null' ELSE 'a/' || path END AS old_path,
       CASE WHEN (d + f) % 10 = 1 THEN '/dev/null' ELSE 'b/' || path END AS new_path, path, extension
FROM file"""

ORACLES["hunk_headers"] = with_ctes() + f"""
SELECT patch_id, file_seq, h + 1 AS hunk_seq, 1 + h * hs AS old_start,
       CASE WHEN h % 5 = 0 THEN 1 ELSE hs END AS old_count, 1 + h * hs AS new_start,
       CASE WHEN h % 5 = 0 THEN 1 ELSE hs END AS new_count, added, deleted
FROM hunk JOIN file USING (d, f) JOIN (SELECT DISTINCT d, hs FROM body) USING (d)"""

ORACLES["line_kinds"] = with_ctes() + """
SELECT patch_id, file_seq, h + 1 AS hunk_seq, line_no, kind, line AS text
FROM lines JOIN file USING (d, f)"""

ORACLES["file_texts"] = with_ctes(TEXTS) + f"""
SELECT {_ID}, md5(body) AS body_md5, md5(added_text) AS added_md5, md5(removed_text) AS removed_md5,
       md5(post_image) AS post_image_md5
FROM texts JOIN file USING (d, f)"""

ORACLES["hunk_noise"] = with_ctes(NOISE) + """
SELECT patch_id, file_seq, h + 1 AS hunk_seq, ws_only, comment_only FROM noise JOIN file USING (d, f)"""

ORACLES["meaningful_files"] = with_ctes(NOISE) + f"""
SELECT {_ID}, count(*) AS n_hunks, count(*) FILTER (NOT ws_only AND NOT comment_only) AS n_kept,
       count(*) FILTER (NOT ws_only AND NOT comment_only) > 0 AS meaningful
FROM noise JOIN file USING (d, f) GROUP BY {_ID}"""

ORACLES["meaningful_keep_comments"] = with_ctes(NOISE) + f"""
SELECT {_ID}, count(*) FILTER (NOT ws_only) AS n_kept FROM noise JOIN file USING (d, f) GROUP BY {_ID}"""

ORACLES["change_totals"] = with_ctes() + """
SELECT patch_id, count(*) FILTER (NOT is_binary) AS changed_files,
       count(*) FILTER (is_binary) AS binary_files, sum(added)::BIGINT AS lines_added,
       sum(deleted)::BIGINT AS lines_deleted
FROM file JOIN file_agg USING (d, f) GROUP BY patch_id"""

ORACLES["risk_scores"] = with_ctes(TEXTS, RISK) + f"""
SELECT {_ID}, path, score::BIGINT AS score, level, array_to_string(reasons, ' | ') AS reasons FROM risk"""

ORACLES["risk_levels"] = with_ctes(TEXTS, RISK) + """
SELECT patch_id, count(*) FILTER (level = 'High') AS high, count(*) FILTER (level = 'Med') AS med,
       count(*) FILTER (level = 'Low') AS low
FROM risk GROUP BY patch_id"""

ORACLES["risk_top10"] = with_ctes(TEXTS, RISK) + """
SELECT patch_id, row_number() OVER (PARTITION BY patch_id ORDER BY score DESC, file_seq) AS rank,
       file_seq, path, score::BIGINT AS score, level
FROM risk QUALIFY rank <= 10"""

ORACLES["last_wins_view"] = with_ctes(TEXTS, RISK) + """
SELECT patch_id, path, file_seq, score::BIGINT AS score, level
FROM risk QUALIFY row_number() OVER (PARTITION BY patch_id, path ORDER BY file_seq DESC) = 1"""

ORACLES["symbols"] = with_ctes(NOISE, SYMBOLS) + f"""
SELECT {_ID}, ord, symbol FROM symbols JOIN file USING (d, f)"""

for _name, _kinds in {
    "components": ["new_component", "removed_component"],
    "api_changes": ["api_change"],
    "dependencies": ["dependency_change"],
    "subsystems": ["affected_subsystem"],
    "side_effects": ["side_effect"],
    "code_risks": ["concurrency_risk", "memory_risk"],
}.items():
    ORACLES[_name] = with_ctes(TEXTS, FACTS) + f"""
SELECT d::VARCHAR AS patch_id, kind, ord, path, name, text FROM facts
WHERE kind IN ({", ".join(map(quote, _kinds))})"""

ORACLES["token_estimate"] = with_ctes(NOISE, TOKENS) + f"""
SELECT {_ID}, path, chars::BIGINT AS chars, tokens FROM tokens"""

ORACLES["token_totals"] = with_ctes(NOISE, TOKENS) + """
SELECT patch_id, sum(chars)::BIGINT AS total_chars, sum(tokens)::BIGINT AS total_tokens,
       sum(tokens)::DOUBLE / 1000::DOUBLE * 0.005::DOUBLE AS cost_usd
FROM by_path GROUP BY patch_id"""

ORACLES["token_by_path"] = with_ctes(NOISE, TOKENS) + """
SELECT patch_id, path, tokens, chars::BIGINT AS chars, first_seq FROM by_path"""

ORACLES["token_map"] = with_ctes(NOISE, TOKENS) + """
SELECT patch_id, string_agg(path || '=' || tokens, '; ' ORDER BY first_seq) AS breakdown
FROM by_path GROUP BY patch_id"""

ORACLES["token_top10"] = with_ctes(NOISE, TOKENS) + """
SELECT patch_id, row_number() OVER (PARTITION BY patch_id ORDER BY tokens DESC, first_seq) AS rank, path, tokens
FROM by_path QUALIFY rank <= 10"""

ORACLES["prose_tokens"] = """
SELECT doc_id, greatest(1, floor(length(text) / 4.0::DOUBLE))::BIGINT AS prose_tokens,
       greatest(1, floor(length(text) / 3.5::DOUBLE))::BIGINT AS code_tokens,
       (length(text) // 4)::BIGINT AS quick_tokens
FROM documents"""

ORACLES["turn_tokens"] = """
SELECT conv_id, turn, role, greatest(1, floor(length(text) / 4.0::DOUBLE))::BIGINT AS prose_tokens
FROM conversations"""

ORACLES["context_budget"] = with_ctes() + """,
grouped AS (
  SELECT *, sum((kind <> 'ctx')::INT) OVER (PARTITION BY d, f, h ORDER BY line_no) AS g,
         last_value(line) OVER (PARTITION BY d, f, h ORDER BY line_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_line
  FROM lines),
counted AS (SELECT *, row_number() OVER (PARTITION BY d, f, h, g ORDER BY line_no) - 1 AS used FROM grouped)
SELECT patch_id, file_seq, h + 1 AS hunk_seq,
       md5(string_agg(line, chr(10) ORDER BY line_no) FILTER (used <= 1 OR line = last_line)) AS budget_1,
       md5(string_agg(line, chr(10) ORDER BY line_no) FILTER (used <= 0 OR line = last_line)) AS budget_0
FROM counted JOIN file USING (d, f) GROUP BY ALL"""

ORACLES["collapsed_runs"] = with_ctes() + """,
masked AS (
  SELECT d, f, h, line_no, max((kind IN ('add', 'del'))::INT) OVER (
           PARTITION BY d, f, h ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS keep
  FROM lines WHERE line_no > 0),
edges AS (
  SELECT *, NOT keep AND coalesce(lag(keep) OVER (PARTITION BY d, f, h ORDER BY line_no), true) AS starts
  FROM masked)
SELECT patch_id, file_seq, h + 1 AS hunk_seq, count(*) FILTER (keep) + 1 AS kept_lines,
       count(*) FILTER (starts) AS runs, count(*) FILTER (NOT keep) AS redacted_lines
FROM edges JOIN file USING (d, f) WHERE NOT is_binary GROUP BY patch_id, file_seq, h"""

ORACLES["flow_nodes"] = with_ctes(TEXTS, PATCH_FLOWS) + f"""
SELECT {_ID}, ord, flow_type, name, condition, line_number FROM nodes JOIN file USING (d, f)"""

_EDGES = f"""
SELECT {_ID}, ord, 'flow_' || (ord - 1) AS src,
       CASE WHEN nxt IS NULL THEN 'flow_end' ELSE 'flow_' || (nxt - 1) END AS dst
FROM shown JOIN file USING (d, f)
UNION ALL SELECT {_ID}, 0, 'Start', 'flow_0' FROM shown JOIN file USING (d, f) WHERE ord = 1"""
_NEXT = "SELECT d, f, ord, lead(ord) OVER (PARTITION BY d, f ORDER BY ord) AS nxt FROM nodes"
ORACLES["flow_edges"] = with_ctes(TEXTS, PATCH_FLOWS) + f", shown AS ({_NEXT})" + _EDGES
ORACLES["flow_edges_shown"] = (
    with_ctes(TEXTS, DRAWN_FLOWS) + f", shown AS ({_NEXT} WHERE ord <= 25)" + _EDGES
)

_LABEL = "translate(name, '\"{}[]|', '''()()/')"
# Rows are cut to those drawn and their text is made first, so that only short lists are put in order.
ORACLES["flow_charts"] = with_ctes(TEXTS, DRAWN_FLOWS) + f""",
totals AS MATERIALIZED (SELECT d, f, count(*) AS total FROM nodes GROUP BY d, f),
shown AS MATERIALIZED (
  SELECT d, f, ord, '    flow_' || (ord - 1) || CASE
      WHEN flow_type IN ('if_else', 'switch_case', 'try_catch') THEN '{{' || {_LABEL} || '}}'
      WHEN flow_type = 'loop' THEN '([' || {_LABEL} || '])'
      WHEN flow_type = 'event_trigger' THEN '("' || {_LABEL} || '")'
      ELSE '["' || {_LABEL} || '"]' END AS shape,
    '    ' || CASE ord WHEN 1 THEN 'Start' ELSE 'flow_' || (ord - 2) END || ' --> flow_' || (ord - 1) AS arrow
  FROM nodes WHERE ord <= 25),
drawn AS MATERIALIZED (
  SELECT d, f, list_sort(list({{'ord': ord, 'shape': shape, 'arrow': arrow}})) AS rows FROM shown GROUP BY d, f)
SELECT {_ID}, array_to_string(list_concat(
    ['graph TD', '    Start([Start])'],
    list_transform(rows, lambda r: r.shape), list_transform(rows, lambda r: r.arrow),
    [CASE WHEN total > 25 THEN '    flow_end([End — ' || (total - 25) || ' more not shown])'
          ELSE '    flow_end([End])' END,
     '    flow_' || (least(total, 25) - 1) || ' --> flow_end']), chr(10)) AS chart
FROM drawn JOIN totals USING (d, f) JOIN file USING (d, f)"""

_SEQUENCE = """
call_lines AS MATERIALIZED (
  SELECT d, f, row_number() OVER (PARTITION BY d, f ORDER BY (flow_type = 'function_call')::INT, ord) AS place,
    CASE WHEN flow_type = 'function_call'
        THEN '    Main->>System: ' || replace(replace(name, 'Call: ', ''), '()', '') || '()'
      WHEN contains(name, 'Emit') THEN '    Main->>System: emit(' || condition || ')'
      ELSE '    System->>Main: on(' || condition || ')' END AS line
  FROM nodes WHERE flow_type IN ('event_trigger', 'function_call')),
charts AS MATERIALIZED (
  SELECT d, f, array_to_string(list_concat(
      ['sequenceDiagram', '    actor Main', '    participant System'],
      list_transform(list_sort(list({'place': place, 'line': line})), lambda r: r.line)), chr(10)) AS chart
  FROM call_lines WHERE place <= 25 GROUP BY d, f)
"""
ORACLES["flow_calls"] = with_ctes(TEXTS, DRAWN_FLOWS, _SEQUENCE) + f"""
SELECT {_ID}, chart FROM charts JOIN file USING (d, f)"""

ORACLES["flow_states"] = with_ctes(TEXTS, DRAWN_FLOWS) + f""",
ordered_nodes AS (
  SELECT *, row_number() OVER (PARTITION BY d, f ORDER BY (flow_type = 'switch_case')::INT, ord) AS place
  FROM nodes WHERE flow_type IN ('if_else', 'switch_case') QUALIFY place <= 25)
SELECT {_ID}, 'stateDiagram-v2' || chr(10) || '    [*] --> Start' || chr(10) || string_agg(
    CASE WHEN flow_type = 'if_else'
      THEN '    Start --> State_' || (place - 1) || ': ' || {_LABEL} || chr(10)
           || '    State_' || (place - 1) || ' --> End: completed'
      ELSE '    State_' || (place - 1) || ' --> End: ' || {_LABEL} END, chr(10) ORDER BY place)
    || chr(10) || '    End --> [*]' AS chart
FROM ordered_nodes JOIN file USING (d, f) GROUP BY {_ID}"""

ORACLES["flow_first_files"] = with_ctes(TEXTS, DRAWN_FLOWS) + f"""
SELECT {_ID}, count(*) AS flows, row_number() OVER (PARTITION BY patch_id ORDER BY file_seq) AS rank
FROM nodes JOIN file USING (d, f) GROUP BY {_ID} QUALIFY rank <= 8"""

_PAGE_SOURCES = "SELECT page_id AS d, 0 AS f, html AS code FROM pages"
_PAGES, _DRAWN_PAGES = _flow_ctes(_PAGE_SOURCES), _flow_ctes(_PAGE_SOURCES, 40)
ORACLES["page_flows"] = f"""WITH {_PAGES}
SELECT d AS page_id, ord, flow_type, name, condition, line_number FROM nodes"""

ORACLES["page_charts"] = f"""WITH {_DRAWN_PAGES}, {_SEQUENCE}
SELECT page_id, coalesce(chart, 'sequenceDiagram' || chr(10)
       || '    Note over Main,System: No event or function calls detected') AS chart
FROM pages LEFT JOIN charts ON page_id = d"""

_STAMP, _SOURCE = "2024-05-01 00:00:00", "documents"
_ICON = "CASE level WHEN 'High' THEN '🔴' WHEN 'Med' THEN '🟡' ELSE '🟢' END"
SYMBOL_LISTS = """
symbol_lists AS MATERIALIZED (SELECT d, f, list(symbol ORDER BY ord) AS names FROM symbols GROUP BY d, f)
"""
REVIEW = """
kept_files AS (
  SELECT d, f, count(*) AS n_kept, string_agg(text, chr(10) ORDER BY h) AS diff FROM kept GROUP BY d, f),
own AS (
  SELECT risk.*, coalesce(names, []) AS names, coalesce(n_kept, 0) AS n_kept, diff
  FROM risk LEFT JOIN symbol_lists USING (d, f) LEFT JOIN kept_files USING (d, f)),
last_of AS (
  SELECT d, path, max(f) AS last_f FROM own GROUP BY d, path),
review AS MATERIALIZED (
  SELECT own.d, own.f, own.patch_id, own.file_seq, own.path, own.is_binary, own.n_hunks, own.added, own.deleted,
         own.n_kept, own.diff, final.score, final.level, final.reasons, final.names, own.f = last_f AS is_last
  FROM own JOIN last_of ON own.d = last_of.d AND own.path = last_of.path
           JOIN own AS final ON final.d = own.d AND final.f = last_f),
money AS MATERIALIZED (
  SELECT d, coalesce(sum(tokens), 0)::BIGINT AS total_tokens, coalesce(sum(chars), 0)::BIGINT AS total_chars,
         coalesce(sum(tokens), 0)::DOUBLE / 1000::DOUBLE * 0.005::DOUBLE AS cost
  FROM (SELECT DISTINCT d FROM file) LEFT JOIN by_path USING (d) GROUP BY d)
"""
_REVIEW_CTES = (TEXTS, NOISE, RISK, SYMBOLS, SYMBOL_LISTS, TOKENS, REVIEW)

ORACLES["summary_report"] = with_ctes(*_REVIEW_CTES) + f""",
counts AS (
  SELECT d, patch_id, count(*) FILTER (NOT is_binary) AS changed_files,
    count(*) FILTER (is_binary) AS binary_files, sum(added)::BIGINT AS lines_added,
    sum(deleted)::BIGINT AS lines_deleted, count(*) FILTER (is_last AND level = 'High') AS high,
    count(*) FILTER (is_last AND level = 'Med') AS med, count(*) FILTER (is_last AND level = 'Low') AS low,
    string_agg('| `' || path || '` | +' || added || ' | -' || deleted || ' | ' || n_hunks || ' | ' ||
      CASE WHEN len(names) = 0 THEN '—' ELSE '`' || array_to_string(names[1:5], '`, `') || '`' ||
        CASE WHEN len(names) > 5 THEN ' +' || (len(names) - 5) || ' more' ELSE '' END END ||
      ' | ' || {_ICON} || ' ' || level || ' |', chr(10) ORDER BY score DESC, file_seq)
      FILTER (NOT is_binary) AS rows_text,
    string_agg('- `' || path || '`', chr(10) ORDER BY file_seq) FILTER (is_binary) AS binary_text
  FROM review GROUP BY d, patch_id)
SELECT patch_id, changed_files, binary_files, lines_added, lines_deleted, high, med, low, total_tokens,
  concat_ws(chr(10), '# AI Review — Summary', '', '> Generated: {_STAMP}', '> Source: {_SOURCE}', '',
    '## Overview', '', '| Metric | Value |', '| --- | --- |',
    '| Changed files | ' || changed_files || ' |', '| Binary files  | ' || binary_files || ' |',
    '| Lines added   | +' || lines_added || ' |', '| Lines deleted | -' || lines_deleted || ' |',
    '| 🔴 High risk  | ' || high || ' |', '| 🟡 Med risk   | ' || med || ' |',
    '| 🟢 Low risk   | ' || low || ' |', '| Est. tokens   | ' || format('{{:,}}', total_tokens) || ' |',
    '| Est. cost     | $' || format('{{:.4f}}', cost) || ' (GPT-4o ref) |', '', '## Changed Files', '',
    '| File | +LOC | -LOC | Hunks | Symbols | Risk |', '| --- | --- | --- | --- | --- | --- |',
    rows_text, CASE WHEN binary_text IS NOT NULL THEN chr(10) || '### Binary Files' || chr(10) || chr(10) || binary_text END
  ) AS report
FROM counts JOIN money USING (d)"""

ORACLES["changed_files"] = with_ctes(*_REVIEW_CTES) + """
SELECT patch_id, '# Changed Files' || chr(10) || chr(10) || string_agg(
  format('{:<8} {:<16} {}', '[' || level || ']',
         CASE WHEN is_binary THEN 'BINARY' ELSE '+' || added || '/-' || deleted END, path),
  chr(10) ORDER BY path, file_seq) AS report
FROM review GROUP BY patch_id"""


def _section(kind: str, title: str, empty: str) -> str:
    limit = " AND place <= 30" if kind in ("api_change", "dependency_change") else ""
    items = f"string_agg('- ' || text, chr(10) ORDER BY ord) FILTER (kind = '{kind}'{limit})"
    return f"'## {title}', '', coalesce({items}, '*{empty}*'), ''"


_NONE = "None detected."
ORACLES["arch_report"] = with_ctes(TEXTS, REPORT_FACTS) + f""",
listed AS (
  SELECT *, row_number() OVER (PARTITION BY d, kind ORDER BY ord) AS place
  FROM facts WHERE kind <> 'dependency_change' OR in_list <= 20),
every AS (SELECT file.d, listed.* EXCLUDE (d) FROM (SELECT DISTINCT d FROM file) AS file LEFT JOIN listed USING (d))
SELECT d::VARCHAR AS patch_id, concat_ws(chr(10), '# Architecture Changes', '', '> Generated: {_STAMP}', '',
  '**Affected subsystems:** ' || coalesce(
    '`' || string_agg(text, '`, `' ORDER BY ord) FILTER (kind = 'affected_subsystem') || '`', 'N/A'), '',
  {_section('new_component', 'New Components / Classes', _NONE)},
  {_section('removed_component', 'Removed Components / Classes', _NONE)},
  {_section('api_change', 'API / Interface Changes', 'No explicit API changes detected in diff headers.')},
  {_section('dependency_change', 'Module Dependency Changes', _NONE)},
  {_section('side_effect', 'Potential Side Effects', _NONE)},
  {_section('concurrency_risk', 'Concurrency / Threading Risks', _NONE)},
  {_section('memory_risk', 'Memory Management Risks', _NONE)},
  '## Notes', '', 'This analysis is heuristic-based. Verify each item manually.',
  'Focus attention on High-risk files listed in `summary.md`.', '') AS report
FROM every GROUP BY d"""

_BEFORE, _AFTER = PROMPT_TEMPLATE.split("{diff_content}")
ORACLES["prompt_rows"] = with_ctes(*_REVIEW_CTES) + f""",
parts AS (
  SELECT patch_id, string_agg('### FILE: ' || path || chr(10) || 'Risk: ' || level || ' | +' || added || '/-' ||
      deleted || ' LOC' || CASE WHEN len(names) > 0
        THEN chr(10) || 'Modified symbols: ' || array_to_string(names[1:10], ', ') ELSE '' END ||
      chr(10) || chr(10) || '```diff' || chr(10) || diff || chr(10) || '```',
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, file_seq)
    FILTER (NOT is_binary AND n_kept > 0) AS diffs
  FROM review GROUP BY patch_id),
prompts AS (
  SELECT patch_id, {quote(_BEFORE)} || coalesce(diffs, '(No meaningful diffs found)') || {quote(_AFTER)} AS prompt
  FROM parts)
SELECT patch_id, prompt, (length(prompt) // 4)::BIGINT AS prompt_tokens FROM prompts"""

_FILE_REPORT = f"""
SELECT patch_id, file_seq, path, translate(path, '/\\:', '___') || '.diff.md' AS file_name,
  concat_ws(chr(10), '# `' || path || '`', '', '**Risk:** ' || {_ICON} || ' ' || level || '  |  **+' || added ||
    '** / **-' || deleted || '** LOC  |  **Hunks:** ' || n_kept, '',
    CASE WHEN len(names) > 0 THEN '**Modified symbols:** `' || array_to_string(names[1:20], '`, `') || '`' || chr(10) END,
    '**Risk reasons:**', '- ' || array_to_string(reasons, chr(10) || '- '), '',
    CASE WHEN n_kept > 0 THEN '## Diff' || chr(10) || chr(10) || diff_text
         ELSE '*No meaningful changes after filtering.*' || chr(10) END) AS report
FROM review LEFT JOIN blocks USING (d, f) WHERE NOT is_binary"""
ORACLES["file_reports"] = with_ctes(*_REVIEW_CTES) + f""",
grouped AS (
  SELECT lines.*, sum((kind <> 'ctx')::INT) OVER (PARTITION BY d, f, h ORDER BY line_no) AS g,
         last_value(line) OVER (PARTITION BY d, f, h ORDER BY line_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_line
  FROM lines JOIN kept USING (d, f, h)),
counted AS (SELECT *, row_number() OVER (PARTITION BY d, f, h, g ORDER BY line_no) - 1 AS used FROM grouped),
shown AS (
  SELECT d, f, h, '```diff' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) || chr(10) || '```' || chr(10) AS block
  FROM counted WHERE used <= 30 OR line = last_line GROUP BY d, f, h),
blocks AS (SELECT d, f, string_agg(block, chr(10) ORDER BY h) AS diff_text FROM shown GROUP BY d, f)
{_FILE_REPORT}"""

ORACLES["token_summary"] = with_ctes(NOISE, TOKENS) + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY tokens DESC, first_seq) AS place FROM by_path),
tops AS (
  SELECT d, sum(tokens)::BIGINT AS total_tokens, sum(chars)::BIGINT AS total_chars,
    string_agg('  ' || format('{:>6}', format('{:,}', tokens)) || '  ' || path, chr(10) ORDER BY place)
      FILTER (place <= 10) AS top
  FROM ranked GROUP BY d),
every AS (
  SELECT d, coalesce(total_tokens, 0) AS total_tokens, coalesce(total_chars, 0) AS total_chars, top
  FROM (SELECT DISTINCT d FROM file) LEFT JOIN tops USING (d))
SELECT d::VARCHAR AS patch_id, total_tokens, total_chars,
  concat_ws(chr(10), 'Estimated tokens : ' || format('{:,}', total_tokens),
    'Estimated cost   : $' || format('{:.4f}', total_tokens::DOUBLE / 1000::DOUBLE * 0.005::DOUBLE) ||
    ' (GPT-4o input ref)', '', 'Top files by token count:', top) AS report
FROM every"""


def _json_list(kind: str, limit: str = "") -> str:
    return f"coalesce(list(text ORDER BY ord) FILTER (kind = '{kind}'{limit}), [])"


ORACLES["review_json"] = with_ctes(*_REVIEW_CTES, REPORT_FACTS) + f""",
listed AS (
  SELECT *, row_number() OVER (PARTITION BY d, kind ORDER BY ord) AS place
  FROM facts WHERE kind <> 'dependency_change' OR in_list <= 20),
fact_lists AS (
  SELECT d, {{
    'new_components': {_json_list('new_component')},
    'removed_components': {_json_list('removed_component')},
    'api_changes': {_json_list('api_change', ' AND place <= 30')},
    'dependency_changes': {_json_list('dependency_change', ' AND place <= 30')},
    'affected_subsystems': {_json_list('affected_subsystem')},
    'potential_side_effects': {_json_list('side_effect')},
    'concurrency_risks': {_json_list('concurrency_risk')},
    'memory_risks': {_json_list('memory_risk')}}} AS architecture
  FROM (SELECT DISTINCT d FROM file) LEFT JOIN listed USING (d) GROUP BY d),
entries AS (
  SELECT d, patch_id, list({{'path': path, 'added': added::BIGINT, 'deleted': deleted::BIGINT, 'hunks': n_hunks,
    'binary': is_binary, 'risk_level': level, 'risk_score': score, 'risk_reasons': reasons,
    'modified_symbols': names}} ORDER BY file_seq) AS files
  FROM review GROUP BY d, patch_id)
SELECT patch_id, to_json({{'generated_at': '{_STAMP}', 'files': files, 'architecture': architecture,
  'token_estimate': {{'total_tokens': total_tokens}}}})::VARCHAR AS document,
       cost AS estimated_cost_usd
FROM entries JOIN fact_lists USING (d) JOIN money USING (d)"""


SNAPSHOT = """
doc AS (
  SELECT doc_id, doc_id % 10 AS k, 'd' || doc_id || CASE WHEN doc_id % 10 = 7 THEN '.bin' ELSE '.txt' END AS name,
         string_split(text, chr(10)) AS ls
  FROM documents),
pair AS (
  SELECT 'docs/' || name AS path, k, ls FROM doc
  UNION ALL SELECT 'moved/' || name, 10, ls FROM doc WHERE k = 0)
"""
ORACLES["snapshot_statuses"] = f"""WITH {SNAPSHOT}
SELECT path, CASE WHEN k = 10 THEN 'added' WHEN k = 0 THEN 'removed' WHEN k IN (3, 4, 5, 7) THEN 'changed'
                  ELSE 'equal' END AS status, k = 7 AS binary, k = 7 AS bytes_equal
FROM pair"""

_COMPARED = """
SELECT path, CASE WHEN k = 10 THEN '/dev/null' ELSE 'a/' || path END AS old_path,
       CASE WHEN k = 0 THEN '/dev/null' ELSE 'b/' || path END AS new_path, k = 7 AS binary,
       (k <> 7)::BIGINT AS n_hunks,
       CASE WHEN k = 10 THEN len(list_filter(ls, lambda x: x NOT LIKE '++%')) WHEN k IN (3, 4) THEN 1 ELSE 0 END::BIGINT AS added,
       CASE WHEN k = 0 THEN len(list_filter(ls, lambda x: x NOT LIKE '--%')) WHEN k = 5 THEN 1 ELSE 0 END::BIGINT AS deleted
FROM pair WHERE k IN (0, 3, 4, 5, 7, 10)"""
ORACLES["snapshot_lines"] = f"WITH {SNAPSHOT} {_COMPARED}"
ORACLES["snapshot_change_set"] = f"""WITH {SNAPSHOT}, compared AS ({_COMPARED})
SELECT 'documents' AS patch_id, row_number() OVER (ORDER BY encode(path)) AS file_seq, * FROM compared"""
ORACLES["snapshot_totals"] = f"""WITH {SNAPSHOT}, compared AS ({_COMPARED})
SELECT 'documents' AS patch_id, count(*) FILTER (NOT "binary") AS changed_files,
       count(*) FILTER ("binary") AS binary_files, sum(added)::BIGINT AS lines_added,
       sum(deleted)::BIGINT AS lines_deleted
FROM compared"""
ORACLES["snapshot_exclude"] = f"WITH {SNAPSHOT} {_COMPARED} AND k NOT IN (7, 10)"

ORACLES["file_pairs"] = f"""WITH {SNAPSHOT}
SELECT CASE WHEN k = 0 THEN 'moved/' ELSE 'docs/' END || name AS path, 'a/docs/' || name AS old_path,
       'b/' || CASE WHEN k = 0 THEN 'moved/' ELSE 'docs/' END || name AS new_path, k = 7 AS binary,
       (k IN (3, 4, 5))::BIGINT AS n_hunks, (k IN (3, 4))::BIGINT AS added, (k = 5)::BIGINT AS deleted
FROM doc"""

REPORT = """
item AS (
  SELECT o_orderkey AS key, o_orderkey % 7 AS status,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE o_custkey % 1000 END AS old_lines
  FROM orders),
both_sides AS (
  SELECT *, CASE WHEN key % 3 = 0 THEN old_lines ELSE key END AS new_lines FROM item WHERE status NOT IN (0, 6)),
entry AS (
  SELECT 'src&lib/o' || key || '.c' AS old_path,
    CASE WHEN status = 2 THEN '' ELSE 'b/src&lib/o' || key || '.c' END AS new_path,
    CASE WHEN status = 2 THEN '' ELSE 'src&lib/o' || key || '.c' END AS path, status = 4 AS binary,
    (old_lines IS NOT NULL OR new_lines IS NOT NULL)::BIGINT AS n_hunks,
    concat_ws(chr(10), CASE WHEN new_lines <> 0 THEN '+[' || new_lines || ' lines in new file]' END,
              CASE WHEN old_lines <> 0 THEN '-[' || old_lines || ' lines in old file]' END) AS body,
    coalesce((new_lines <> 0)::BIGINT, 0) AS added, coalesce((old_lines <> 0)::BIGINT, 0) AS deleted
  FROM both_sides)
"""
ORACLES["xml_report"] = f"WITH {REPORT} SELECT * FROM entry"
ORACLES["xml_report_changed"] = f"""WITH {REPORT}
SELECT count(*) FILTER (NOT "binary") AS changed_files, count(*) FILTER ("binary") AS binary_files,
       sum(added)::BIGINT AS lines_added, sum(deleted)::BIGINT AS lines_deleted
FROM entry WHERE n_hunks > 0 OR "binary" """


_LINE_COMMENT = quote("(?://|#).*")
_BLOCK_COMMENT = quote("(?s)/\\*.*?\\*/|'''.*?'''|\"\"\".*?\"\"\"")
_STRING = quote("\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)*'")
_KEPT_WORDS = ", ".join(map(quote, rules.KEPT_WORDS))
_KEPT_NAMES = ", ".join(map(quote, dict.fromkeys(rules.KEPT_WORDS + rules.KEPT_TYPES)))
_PREFIXES = quote("^(" + "|".join(rules.PUBLIC_PREFIXES) + ").")


def _rewritten(source: str, mode: str) -> str:
    """CTE ``redacted`` (columns of ``source`` and text) for its columns path and line.

    RE2 has no lookbehind, so numbers and names are found by cutting a line into
    runs of word characters and judging each run with its neighbours.
    """
    comments = mode == "api-safe-comments"
    keep = f"t IN ({_KEPT_WORDS})"
    if mode.startswith("api-safe"):
        keep = (
            f"t IN ({_KEPT_NAMES}) OR regexp_full_match(t, '[A-Z][a-z]+(?:[A-Z][a-z]+)*') "
            f"OR (regexp_full_match(t, '[A-Z_][A-Z0-9_]*') AND contains(t, '_')) OR regexp_matches(t, {_PREFIXES})"
        )
    single = f"regexp_extract(body, {_LINE_COMMENT})" if comments else "''"
    code = f"regexp_replace(body, {_LINE_COMMENT}, '____COMMENT_0____')" if comments else "body"
    blocks = f"regexp_extract_all(code, {_BLOCK_COMMENT})" if comments else "[]::VARCHAR[]"
    pieces = f"string_split_regex(code, {_BLOCK_COMMENT})" if comments else "[code]"
    return f"""
r0 AS (SELECT *, regexp_extract(line, '^[+\\- ]?\\s*') AS head FROM {source}),
r1 AS (SELECT *, substr(line, length(head) + 1) AS body FROM r0),
r2 AS (SELECT *, {single} AS line_comment, {code} AS code FROM r1),
r3 AS (
  SELECT *, list_filter([line_comment], lambda c: c <> '') || {blocks} AS comments,
    array_to_string(list_transform({pieces}, lambda x, i: CASE WHEN i = 1 THEN x ELSE
      '____COMMENT_' || (i - 2 + (line_comment <> '')::INT) || '____' || x END), '') AS b3
  FROM r2),
r4 AS (
  SELECT *, array_to_string(list_transform(string_split_regex(b3, {_STRING}), lambda x, i:
      CASE WHEN i = 1 THEN x ELSE '____STR_' || (i - 1) || '____' || x END), '') AS b4
  FROM r3),
r5 AS (
  SELECT *, regexp_extract_all(b4, '[\\p{{L}}\\p{{N}}_.]+|-|[^\\p{{L}}\\p{{N}}_.\\-]+') AS runs FROM r4),
r6 AS (
  SELECT *, list_transform(runs, lambda t: regexp_extract(t,
      '^(\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?(?:[eE]\\p{{Nd}}+)?[fFlLuU]?)(?:$|\\.)', 1)) AS nums,
    list_transform(runs, lambda t, i: t = '-' AND
      (i = 1 OR NOT regexp_matches(runs[i - 1], '[\\p{{L}}\\p{{N}}_.]$'))) AS signs
  FROM r5),
r7 AS (
  SELECT *, array_to_string(list_transform(runs, lambda t, i:
    CASE WHEN signs[i] AND coalesce(nums[i + 1], '') NOT IN ('', '1') THEN ''
         WHEN nums[i] <> '' AND NOT (CASE WHEN i > 1 AND signs[i - 1] THEN '-' || nums[i] ELSE nums[i] END
              IN ('0', '1', '-1')) THEN '____NUM_0____' || substr(t, length(nums[i]) + 1)
         ELSE t END), '') AS b7
  FROM r6),
r8 AS (
  SELECT *, array_to_string(list_transform(
    regexp_extract_all(b7, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda t:
    CASE WHEN NOT regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*') THEN t
         WHEN (t LIKE '\\_\\_\\_\\_%' ESCAPE '\\' AND t LIKE '%\\_\\_\\_\\_' ESCAPE '\\') OR {keep} THEN t
         ELSE 'sym_' || sha256(path || '::' || t)[1:6] END), '') AS b8
  FROM r7),
r9 AS (
  SELECT *, regexp_replace(regexp_replace(b8, '____STR_\\p{{Nd}}+____', '"<str>"', 'g'),
                           '____NUM_\\p{{Nd}}+____', '<n>', 'g') AS b9 FROM r8),
redacted AS MATERIALIZED (
  SELECT *, head || list_reduce([b9] || list_transform(comments, lambda c, i: (i - 1) || ':' || c),
    lambda a, x: replace(a, '____COMMENT_' || split_part(x, ':', 1) || '____', substr(x, strpos(x, ':') + 1))) AS text
  FROM r9)
"""


def _redaction_ctes(mode: str) -> str:
    """CTE ``stripped``: lines of the stripped kept hunks, placed by line_no."""
    comment_list = (
        f"list_filter([regexp_extract(line, {_LINE_COMMENT}), regexp_extract(line, {_BLOCK_COMMENT})], "
        "lambda c: c <> '')"
        if mode == "api-safe-comments"
        else "[]::VARCHAR[]"
    )
    return f"""
kept_numbered AS (
  SELECT d, f, h, row_number() OVER (PARTITION BY d, f ORDER BY h) AS hunk_seq FROM kept),
masked AS MATERIALIZED (
  SELECT d, f, h, line_no, line, patch_id, file_seq, path, hunk_seq,
    line_no = 0 OR max((kind IN ('add', 'del'))::INT) OVER (PARTITION BY d, f, h, line_no = 0 ORDER BY line_no
      ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS keep
  FROM lines JOIN kept_numbered USING (d, f, h) JOIN file USING (d, f) WHERE NOT is_binary),
shown_lines AS (SELECT * FROM masked WHERE keep AND line_no > 0),
{_rewritten('shown_lines', mode)},
islands AS (
  SELECT *, line_no - row_number() OVER (PARTITION BY d, f, h ORDER BY line_no) AS island,
         {comment_list} AS found
  FROM masked WHERE NOT keep),
markers AS (
  SELECT patch_id, file_seq, hunk_seq, min(line_no) AS line_no,
    array_to_string(['··· [' || count(*) || ' line(s) redacted] ···'] ||
                    flatten(list(found ORDER BY line_no)), '  ') AS text
  FROM islands GROUP BY patch_id, file_seq, hunk_seq, island),
stripped AS MATERIALIZED (
  SELECT patch_id, file_seq, hunk_seq, line_no, text FROM redacted
  UNION ALL SELECT patch_id, file_seq, hunk_seq, line_no, line FROM masked WHERE line_no = 0
  UNION ALL SELECT * FROM markers)
"""


def _redaction(mode: str) -> str:
    return with_ctes(NOISE, _redaction_ctes(mode)) + """
SELECT patch_id, file_seq, hunk_seq,
       row_number() OVER (PARTITION BY patch_id, file_seq, hunk_seq ORDER BY line_no) - 1 AS ord, text
FROM stripped"""


ORACLES["redact_full"] = _redaction("full")
ORACLES["redact_api_safe"] = _redaction("api-safe")
ORACLES["redact_api_safe_comments"] = _redaction("api-safe-comments")


def _table_redaction(table: str, key: str, text: str, mode: str) -> str:
    return f"""WITH source_lines AS (
  SELECT {key}, '{table}/' || {key} AS path, unnest(string_split({text}, chr(10))) AS line,
         unnest(range(len(string_split({text}, chr(10))))) AS line_no FROM {table}),
{_rewritten('source_lines', mode)}
SELECT {key}, line_no, text AS redacted FROM redacted"""


ORACLES["redact_documents"] = _table_redaction("documents", "doc_id", "text", "full")
ORACLES["redact_pages"] = _table_redaction("pages", "page_id", "html", "api-safe-comments")


_PIECES = f"""WITH turn_words AS (
  SELECT conv_id AS c, turn AS t, unnest(string_split_regex(text, '[ \\n]+')) AS w,
         unnest(range(len(string_split_regex(text, '[ \\n]+')))) AS i
  FROM conversations),
turn_lines AS (
  SELECT c, t, i, {PIECE_MARK} || w AS line, ({PIECE_FILE})::INT AS opens_file, ({PIECE_HUNK})::INT AS opens_hunk
  FROM turn_words),
in_file AS (
  SELECT *, sum(opens_file) OVER (PARTITION BY c ORDER BY t, i) AS file_seq FROM turn_lines),
in_hunk AS (
  SELECT *, sum(opens_hunk) OVER (PARTITION BY c, file_seq ORDER BY t, i) AS hunk FROM in_file WHERE file_seq > 0),
stats AS (
  SELECT c::VARCHAR AS patch_id, file_seq::BIGINT AS file_seq,
    max(CASE WHEN opens_file = 1 THEN 'c' || c || '_' || t || '_' || i || '.py' END) AS path, 'py' AS extension,
    false AS is_binary, sum(opens_hunk)::BIGINT AS n_hunks,
    count(*) FILTER (hunk > 0 AND line LIKE '+%' AND line NOT LIKE '+++%') AS added,
    count(*) FILTER (hunk > 0 AND line LIKE '-%' AND line NOT LIKE '---%') AS deleted
  FROM in_hunk GROUP BY c, file_seq HAVING sum(opens_hunk) > 0)
"""
ORACLES["piece_statistics"] = _PIECES + """
SELECT patch_id, file_seq, path, extension, is_binary AS binary, n_hunks, added, deleted FROM stats"""
ORACLES["piece_totals"] = _PIECES + """
SELECT patch_id, count(*) AS changed_files, 0::BIGINT AS binary_files, sum(added)::BIGINT AS lines_added,
       sum(deleted)::BIGINT AS lines_deleted
FROM stats GROUP BY patch_id"""


_STRIPPED_BLOCKS = """
stripped_hunks AS (
  SELECT patch_id, file_seq, hunk_seq, string_agg(text, chr(10) ORDER BY line_no) AS text
  FROM stripped GROUP BY patch_id, file_seq, hunk_seq)
"""
_STRIPPED = (*_REVIEW_CTES, _redaction_ctes("api-safe"), _STRIPPED_BLOCKS)
_NOTICE = (
    "'> 🔒 **Stripped Patch** — surrounding context and identifiers have been "
    "redacted/pseudonymized. Only the core changed lines remain.', '',"
)
ORACLES["stripped_file_reports"] = with_ctes(*_STRIPPED) + f""",
blocks AS (
  SELECT d, f, string_agg('```diff' || chr(10) || text || chr(10) || '```' || chr(10), chr(10) ORDER BY hunk_seq) AS diff_text
  FROM stripped_hunks JOIN file USING (patch_id, file_seq) GROUP BY d, f)
""" + _FILE_REPORT.replace("CASE WHEN len(names) > 0 THEN '**Modified", f"{_NOTICE} CASE WHEN len(names) > 0 THEN '**Modified")

ORACLES["stripped_prompts"] = with_ctes(*_STRIPPED) + f""",
diffs AS (
  SELECT patch_id, file_seq, string_agg(text, chr(10) || chr(10) ORDER BY hunk_seq) AS hunks
  FROM stripped_hunks GROUP BY patch_id, file_seq),
parts AS (
  SELECT patch_id, string_agg('### FILE: ' || path || chr(10) || 'Risk: ' || level || ' | +' || added || '/-' ||
      deleted || ' LOC' || CASE WHEN len(names) > 0
        THEN chr(10) || 'Modified symbols: ' || array_to_string(names[1:10], ', ') ELSE '' END ||
      chr(10) || chr(10) || '```diff' || chr(10) || hunks || chr(10) || '```',
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, file_seq)
    FILTER (NOT is_binary AND n_kept > 0) AS diffs
  FROM review LEFT JOIN diffs USING (patch_id, file_seq) GROUP BY patch_id)
SELECT patch_id, {quote(STRIPPED_NOTICE + _BEFORE)} || coalesce(diffs, '(No meaningful diffs found)')
       || {quote(_AFTER)} AS prompt
FROM parts"""


ORACLES["package_tokens"] = ORACLES["token_summary"]
ORACLES["snapshot_folders"] = """
SELECT lang, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes FROM documents GROUP BY lang"""

ORACLES["patch_file_totals"] = with_ctes() + """
SELECT path, is_binary AS binary, count(*) AS entries, sum(n_hunks)::BIGINT AS hunks,
       sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted
FROM file JOIN file_agg USING (d, f) GROUP BY ALL"""
ORACLES["patch_range_totals"] = ORACLES["patch_file_totals"] + " HAVING sum(n_hunks) > 0 OR is_binary"

TREE = f"""
tree AS (
  SELECT doc_id, {TREE_PATH} AS path, coalesce(text, '') || chr(10) AS content FROM documents)
"""
ORACLES["tree_files"] = f"""WITH {TREE}
SELECT path, octet_length(encode(content))::BIGINT AS length, sha256(content) AS content_sha256
FROM tree WHERE doc_id % 10 <> 5"""
ORACLES["tree_excluded"] = f"""WITH {TREE}
SELECT path, octet_length(encode(content))::BIGINT AS length FROM tree
WHERE doc_id % 10 <> 5 AND NOT (starts_with(path, '_build/') OR ends_with(path, '.log')
  OR starts_with(path, '.config/') OR (starts_with(path, 'src/') AND ends_with(path, '/main.c')))"""
ORACLES["tree_compare"] = f"""WITH {TREE},
sides AS (
  SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 10 = 5 THEN 'added' ELSE 'changed' END AS status,
         doc_id, string_split(content, chr(10))[1:-2] || CASE WHEN doc_id % 10 = 5 AND doc_id % 4 = 1
           THEN ['appended ' || doc_id] ELSE [] END AS ls
  FROM tree WHERE doc_id % 10 IN (0, 5) OR doc_id % 4 = 1)
SELECT path, CASE status WHEN 'added' THEN '/dev/null' ELSE 'a/' || path END AS old_path,
       CASE status WHEN 'removed' THEN '/dev/null' ELSE 'b/' || path END AS new_path, false AS binary, 1::BIGINT AS n_hunks,
       CASE status WHEN 'changed' THEN 1 WHEN 'added' THEN len(list_filter(ls, lambda x: x NOT LIKE '++%')) ELSE 0 END::BIGINT AS added,
       CASE status WHEN 'removed' THEN len(list_filter(ls, lambda x: x NOT LIKE '--%')) ELSE 0 END::BIGINT AS deleted
FROM sides"""

# Patches cut into pieces have the results of whole ones.
for _name, _whole in {
    "piece_noise": "hunk_noise", "piece_meaningful": "meaningful_files",
    "piece_token_estimate": "token_estimate", "piece_symbols": "symbols",
}.items():
    ORACLES[_name] = ORACLES[_whole]

# Documents in parts are the documents in one row.
for _name, _whole, _column in (
    ("document_summary", "summary_report", "report"), ("document_changed_files", "changed_files", "report"),
    ("document_architecture", "arch_report", "report"), ("document_prompt", "prompt_rows", "prompt"),
    ("document_json", "review_json", "document"),
):
    ORACLES[_name] = f"SELECT patch_id, {_column} FROM ({ORACLES[_whole]})"
