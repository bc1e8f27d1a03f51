"""DuckDB SQL of the longer operators: spelling variants, manifest, personal data."""

from __future__ import annotations

from .manifest import FAN, FIELDS
from .personal_data import ADDED_KINDS, BASE_KINDS, CONTEXT, IBAN_LENGTHS, KINDS, LOWERED, OTHER_NUMBERS, RAISED, SCORES, THRESHOLD, WORDS
from .shared import LOWER, UPPER

#: One row: the values that a checksum step takes from a byte.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY c) AS steps FROM range(256) t(c)
)"""


def crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text; ``steps`` is the column of ``crc_table``."""
    numbers = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


OP11 = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, {lowered("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents
), counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed, run, count(*) AS c FROM runs GROUP BY doc_id, run
), checked AS (
  SELECT run, c, {crc32("keyed")} AS h FROM counted, crc_table
), vocab AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM checked GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3
), opened AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS before, substr(word, i + 1) AS after FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM opened a JOIN opened b ON a.i = b.i AND a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION SELECT o.word, v.word, v.n FROM opened o JOIN vocab v ON v.word = o.before || o.after
  UNION SELECT v.word, o.word, o.n FROM opened o JOIN vocab v ON v.word = o.before || o.after
), best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs
), forms AS (
  SELECT vocab.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM vocab LEFT JOIN (SELECT * FROM best WHERE place = 1) b ON b.word = vocab.word
), ways AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM ways w JOIN forms f ON w.next = f.word
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w ON w.word = f.word WHERE w.next IS NULL
"""


def _levels(name: str, tree: str, count: int) -> tuple[list[str], str]:
    """CTEs of so many levels over ``name``0 (tree, pos, h), with what stands before and after each node; the last one is the root."""
    parts = []
    for k in range(count):
        run = f"(PARTITION BY {tree}, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        parts.append(
            f"{name}{k}_steps AS (SELECT {tree}, pos, count(*) OVER (PARTITION BY {tree}) > 1 AS live, "
            f"coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})"
        )
        parts.append(
            f"{name}{k + 1} AS (SELECT n.{tree}, n.pos // {FAN} AS pos, CASE WHEN bool_or(live) THEN sha256(string_agg(h, '' ORDER BY n.pos)) ELSE any_value(h) END AS h "
            f"FROM {name}{k} n JOIN {name}{k}_steps s ON n.{tree} = s.{tree} AND n.pos = s.pos GROUP BY n.{tree}, n.pos // {FAN})"
        )
    return parts, f"{name}{count}"


def op12(levels: int = 6) -> str:
    """``levels`` bounds the height of both trees: 16 ** levels leaves of a source, and as many sources."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = "sha256(" + " || ".join(value(c) for c in FIELDS) + ")"
    tampered = "sha256(" + " || ".join(value(c) for c in [*FIELDS[:-1], lowered("text")]) + ")"
    groups, subroots = _levels("g", "tree", levels)
    tops, root = _levels("t", "tree", levels)
    parts = [
        CRC_TABLE,
        f"rows AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {tampered} END AS claimed FROM documents, crc_table)",
        "placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows)",
        "g0 AS (SELECT tree, pos, leaf AS h FROM placed)",
        *groups,
        f"t0 AS (SELECT 0 AS tree, tree AS pos, h FROM {subroots})",
        *tops,
        f"f0 AS (SELECT p.*, s.h AS subroot, coalesce(claimed, leaf) AS folded, '' AS proof FROM placed p JOIN {subroots} s ON p.tree = s.tree)",
    ]
    for k in range(2 * levels):
        steps = f"g{k}_steps s ON s.tree = f.tree AND s.pos = f.pos // {FAN**k}" if k < levels else f"t{k - levels}_steps s ON s.pos = f.tree // {FAN ** (k - levels)}"
        parts.append(
            f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN live THEN sha256(before || folded || after) ELSE folded END AS folded, proof || before || after AS proof) FROM f{k} f JOIN {steps})"
        )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified FROM f{2 * levels}, {root} r"
    )


def _found(kind: str, pattern: str) -> str:
    """CTE with id, begins (code points before) and m of all matches of a pattern."""
    return f"""{kind}_all AS (
  SELECT id, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS begins, found[i] AS m
  FROM (SELECT id, found, parts, unnest(range(1, len(found) + 1)) AS i FROM (SELECT id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS parts FROM texts))
)"""


def _luhn(digits: str) -> str:
    doubled = f"list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse({digits}), i::INT + 1, 1)::INT ELSE (substr(reverse({digits}), i::INT + 1, 1)::INT * 2) // 10 + (substr(reverse({digits}), i::INT + 1, 1)::INT * 2) % 10 END)"
    return f"list_sum({doubled}) % 10 = 0"


def op13() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    lengths = "CASE substr(m, 1, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in IBAN_LENGTHS.items()) + " END"
    account = "replace(whole, ' ', '')"
    moved = f"(substr({account}, 5) || substr({account}, 1, 4))"
    value = f"list_transform(range(1, length({moved}) + 1), lambda i: ascii(substr({moved}, i::INT, 1)) - CASE WHEN substr({moved}, i::INT, 1) <= '9' THEN 48 ELSE 55 END)"
    mod_97 = f"list_reduce(list_prepend(0, {value}), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1"
    before, ends = "substr(t, begins, 1)", "begins + length(m)"
    after = f"substr(t, {ends} + 1, 1)"
    confirmed = {
        "email": "SELECT id, begins, m FROM email_all",
        "ip": "SELECT id, begins, m FROM ip_all WHERE len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0",
        "card": f"SELECT id, begins, m FROM card_all WHERE length({digits}) BETWEEN 12 AND 19 AND {_luhn(digits)}",
        "phone": f"SELECT id, begins, m FROM phone_all WHERE length({digits}) BETWEEN 9 AND 15",
        "iban": f"""SELECT id, begins, whole FROM (
          SELECT id, t, begins, m, regexp_extract(substr(t, begins + 1, 80), '^[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]){{' || ({lengths} - 4) || '}}') AS whole
          FROM iban_all JOIN texts USING (id) WHERE {lengths} IS NOT NULL AND (begins = 0 OR NOT regexp_matches({before}, '[A-Za-z0-9]')))
          WHERE whole <> '' AND NOT regexp_matches(substr(t, begins + length(whole) + 1, 1), '[A-Za-z0-9]') AND {mod_97}""",
        "ssn": f"""SELECT id, begins, m FROM ssn_all JOIN texts USING (id) WHERE (begins = 0 OR NOT regexp_matches({before}, '[A-Za-z0-9-]')) AND NOT regexp_matches({after}, '[A-Za-z0-9-]')
          AND substr(m, 1, 3) NOT IN ('000', '666') AND m < '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000'""",
        "local_phone": f"""SELECT id, begins, m FROM local_phone_all JOIN texts USING (id) WHERE (begins = 0 OR NOT regexp_matches({before}, '[0-9A-Za-z+().-]'))
          AND NOT regexp_matches({after}, '[A-Za-z0-9]') AND (begins < 2 OR NOT regexp_matches(substr(t, begins - 1, 2), '[0-9] '))""",
    }
    patterns = {
        "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "ip": "[0-9]+(?:\\.[0-9]+){3}", "card": "[0-9](?:[ -]?[0-9])+", "phone": "\\+[0-9][ ().0-9-]+[0-9]",
        "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "local_phone": "(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    }
    nearby = lowered(f"substr(t, greatest(begins - {CONTEXT}, 0) + 1, least({CONTEXT}, begins))")
    word = lambda words: f"regexp_matches({nearby}, '(^|[^a-z])({'|'.join(words)})([^a-z]|$)')"
    scored = " UNION ALL ".join(
        f"SELECT id, {KINDS.index(k)} AS place, '{k}' AS kind, begins, begins + length(m) AS ends, least(100, {SCORES[k]} + CASE WHEN {word(WORDS[k])} THEN {RAISED} ELSE 0 END - CASE WHEN {word(OTHER_NUMBERS)} THEN {LOWERED} ELSE 0 END) AS score FROM {k}_ok JOIN texts USING (id)"
        for k in KINDS
    )
    listed = "coalesce(string_agg(kind || ':' || begins || ':' || ends, ',' ORDER BY begins, place){}, '')"
    is_base = f"kind IN ({', '.join(repr(k) for k in BASE_KINDS)})"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(_found(k, p) for k, p in patterns.items())},
{", ".join(f"{k}_ok(id, begins, m) AS ({sql})" for k, sql in confirmed.items())},
spans AS (SELECT * FROM ({scored}) WHERE {is_base} OR score >= {THRESHOLD})
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)}, sha256({listed.format(f" FILTER ({is_base})")}) AS base_sha256, {listed.format("")} AS spans,
  count(*) FILTER (kind IN ({", ".join(repr(k) for k in ADDED_KINDS)})) AS n_added, max(score)::INT AS best_score
FROM texts LEFT JOIN spans USING (id) GROUP BY id
"""
