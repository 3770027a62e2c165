"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from diffloom.llm.license_scan import COPYRIGHT, NOTICES, NOT_A_WORD, SPELLINGS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(line: str) -> str:
    text = f"lower({line})"
    spelled = text
    for pattern, spelling in SPELLINGS:
        to = spelling.replace("$", "\\")
        spelled = f"regexp_replace({spelled}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    words = f"trim(regexp_replace({spelled}, {_quoted(NOT_A_WORD)}, ' ', 'g'))"
    return f"CASE WHEN regexp_matches({text}, {_quoted(COPYRIGHT)}) THEN '' ELSE {words} END"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, four bits at a time, low ones first."""
    table = []
    for bits in range(16):
        for _ in range(4):
            bits = bits >> 1 ^ (0xEDB88320 if bits & 1 else 0)
        table.append(bits)

    def four(value: str) -> str:
        return f"xor({value} >> 4, {table}[({value} & 15) + 1])"

    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = four(four("xor(crc, byte)"))
    return f"xor(list_reduce({bytes_}, lambda crc, byte: {step}, 4294967295::BIGINT), 4294967295)"


def _rendezvous(shards: int) -> str:
    draw = """(('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN s::VARCHAR
               ELSE s || ':' || doc_id END), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE"""
    return f"""list_reduce(list_transform(range({shards}), lambda s: {{'score': 1 / -ln({draw}), 'shard': s}}),
               lambda a, b: CASE WHEN b.score > a.score THEN b ELSE a END).shard::INT"""


def _sized(column: str) -> str:
    text = f"{column}::VARCHAR"
    return f"coalesce(octet_length(encode({text}))::VARCHAR || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join([_sized(c) for c in ('doc_id', 'source', 'lang', 'n_chars')] + [_sized(text)])})"


def _tree(name: str, leaves: str, keys: str, levels: int) -> str:
    """CTEs of the levels of trees over ``leaves(<keys>, pos, h)``: {name}0, {name}1, ..."""
    parts = []
    for k in range(levels):
        source = leaves if k == 0 else (
            f"SELECT {keys}, pos // 8 AS pos, CASE WHEN any_value(n) > 1"
            f" THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{k - 1}"
            f" GROUP BY {keys}, pos // 8"
        )
        parts.append(f"""{name}{k} AS (
  SELECT *, count(*) OVER (PARTITION BY {keys}) AS n,
         coalesce(string_agg(h, '') OVER (PARTITION BY {keys}, pos // 8 ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (PARTITION BY {keys}, pos // 8 ORDER BY pos
                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM ({source}))""")
    return ",\n".join(parts)


def _merkle(levels: int = 8, tops: int = 4) -> str:
    upper = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joins = [
        f"JOIN t{k} ON t{k}.lang IS NOT DISTINCT FROM leaves.lang AND t{k}.pos = leaves.pos // {8**k}"
        for k in range(levels)
    ] + [f"JOIN g{k} ON g{k}.pos = langs.pos // {8**k}" for k in range(tops)]
    steps = [f"t{k}" for k in range(levels - 1)] + [f"g{k}" for k in range(tops - 1)]
    fold = "coalesce(tampered, leaf)"
    for step in steps:
        fold = f"(SELECT CASE WHEN {step}.n > 1 THEN sha256({step}.before || f || {step}.after) ELSE f END FROM (SELECT {fold} AS f))"
    proof = " || ".join(f"CASE WHEN {s}.n > 1 THEN {s}.before || {s}.after ELSE '' END" for s in steps)
    return f"""
WITH hashed AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(upper)} END AS tampered
  FROM documents),
leaves AS (
  SELECT *, leaf AS h,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
{_tree("t", "SELECT lang, pos, h FROM leaves", "lang", levels)},
langs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t{levels - 1}),
{_tree("g", "SELECT 0 AS one, pos, subroot AS h FROM langs", "one", tops)},
paths AS (
  SELECT doc_id, leaf, subroot, g{tops - 1}.h AS root, sha256({proof}) AS proof_sha256, {fold} AS folded_root
  FROM leaves JOIN langs ON langs.lang IS NOT DISTINCT FROM leaves.lang
  {" ".join(joins)})
SELECT *, folded_root = root AS verified FROM paths"""


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in NOTICES)

ORACLES: dict[str, str] = {
    "op2_chat_perspectives": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (ORDER BY conv_id, turn NULLS FIRST, role NULLS FIRST, text) AS seq
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
views AS (
  SELECT t.*, s.speaker,
         CASE WHEN role = speaker THEN '<|assistant|>' || chr(10)
              WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS head
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
sized AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM views),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
         CAST(sum(length(segment)) OVER w - length(segment) AS BIGINT) AS start
  FROM sized WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, position, turn, role,
       CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS tag,
       segment, start, start + length(segment) AS "end",
       CASE WHEN role = speaker THEN start + length(head) END AS target_start
FROM placed""",
    "op4_exact_stream": """
WITH normal AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM normal WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_license_digests": f"""
WITH known AS (
  SELECT sha256({_canonical("t")}) AS digest, min(n) AS license_id
  FROM (VALUES {_KNOWN}) v(n, t) GROUP BY 1),
lines AS (
  SELECT doc_id, list_filter(list_transform(
           regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'),
           lambda line: {_canonical("line")}), lambda line: line <> '') AS lines
  FROM documents),
whole AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest FROM lines),
hits AS (
  SELECT doc_id, list_sort(list_distinct(list(license_id))) AS notices
  FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM lines) JOIN known USING (digest) GROUP BY 1)
SELECT whole.doc_id, whole.digest, known.license_id, coalesce(array_to_string(notices, ','), '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN hits ON whole.doc_id = hits.doc_id""",
    "op11_rendezvous_shards": f"""
WITH dealt AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         {_crc32("coalesce(text, '')")} AS text_crc32,
         {_rendezvous(16)} AS shard, {_rendezvous(17)} AS grown_shard
  FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       grown_shard
FROM dealt""",
    "op12_merkle_butterfly": _merkle(),
    "op13_fill_middle": """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b,
         ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 AS spm,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain
  FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix,
         array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars,
       CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN plain THEN text
                   WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts""",
}
