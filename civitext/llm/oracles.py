"""DuckDB SQL for the queries that SQL can express.

The others rest on hashes or models that SQL has not: their tests compare them with
brute force, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

from civitext.llm.common import UPPER
from civitext.llm.filter_audit import FILTERS, MAX_CAPITALS, MIN_DISTINCT, MIN_WORDS, SYMBOLS
from civitext.llm.licenses import COPYRIGHT_LINE, LICENCES, SPELLINGS
from civitext.llm.urls import RULES, SOFT, SOFT_LIMIT, STRICT
from civitext.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _hit(term: str) -> str:
    return f"CAST(regexp_matches(lower(url), '(^|[^\\p{{L}}\\p{{N}}]){term}([^\\p{{L}}\\p{{N}}]|$)') AS INTEGER)"


def _rule_rows() -> str:
    return ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in RULES)


URL_FILTER = f"""WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{UPPER.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES {_rule_rows()}),
fits AS (
  SELECT page_id, arg_max(struct_pack(rule := h || p, verdict := v), length(h || p)) AS best
  FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
hits AS (
  SELECT page_id, {" + ".join(_hit(t) for t in STRICT)} AS strict_terms,
    {" + ".join(f"{w} * {_hit(t)}" for t, w in SOFT.items())} AS soft_weight FROM parts)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN strict_terms > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(strict_terms AS INTEGER) AS strict_terms, CAST(soft_weight AS INTEGER) AS soft_weight
FROM parts JOIN hits USING (page_id) LEFT JOIN fits USING (page_id)"""


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    out = f"replace({out}, '&', ' and ')"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for pair in SPELLINGS:
        one, other = (" " + "  ".join(words.split()) + " " for words in pair)
        out = f"replace({out}, {_quoted(one)}, {_quoted(other)})"
    return f"trim({out})"


LICENCE_SCAN = f"""WITH known AS (
  SELECT sha256({_canonical("t")}) AS digest, min(name) AS license
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in LICENCES)}) AS v(name, t) GROUP BY 1),
pieces AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
units AS (
  SELECT doc_id, 'text' AS unit, CAST(NULL AS INTEGER) AS line_no, text AS part FROM documents
  UNION ALL SELECT doc_id, 'line', CAST(line_no AS INTEGER), part FROM pieces),
formed AS (SELECT doc_id, unit, line_no, {_canonical("part")} AS form FROM units)
SELECT doc_id, unit, line_no, license FROM formed JOIN known ON sha256(form) = digest WHERE form <> ''"""

def _assigned(books: str) -> str:
    """(vec_id, p, d, e): squared distance and number of the nearest entry of every part."""
    return f"""SELECT vec_id, p, min(d * {ENTRIES} + e) // {ENTRIES} AS d, min(d * {ENTRIES} + e) % {ENTRIES} AS e FROM (
    SELECT vec_id, c.p, c.e, sum((q.x - c.x) * (q.x - c.x))::BIGINT AS d
    FROM q JOIN {books} AS c ON q.p = c.p AND q.pos = c.pos GROUP BY vec_id, c.p, c.e) GROUP BY vec_id, p"""


def _vector_codes() -> str:
    rounds = "".join(
        f""",
a{t} AS MATERIALIZED ({_assigned(f"b{t - 1}")}),
m{t} AS (SELECT a.p, a.e, q.pos, CAST(floor(sum(q.x) / count(*)) AS BIGINT) AS x
  FROM a{t} AS a JOIN q ON q.vec_id = a.vec_id AND q.p = a.p GROUP BY a.p, a.e, q.pos),
b{t} AS MATERIALIZED (SELECT p, e, pos, coalesce(m{t}.x, b.x) AS x FROM b{t - 1} AS b LEFT JOIN m{t} USING (p, e, pos))"""
        for t in range(1, ROUNDS + 1)
    )
    return f"""WITH every AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings),
kept AS (
  SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS w, row_number() OVER (ORDER BY vec_id) - 1 AS no FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM every WHERE x IS NULL OR NOT isfinite(x))),
cells AS (SELECT vec_id, no, w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM kept),
q AS MATERIALIZED (SELECT vec_id, no, i // w AS p, i % w AS pos, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM cells),
b0 AS MATERIALIZED (SELECT p, no AS e, pos, x FROM q WHERE no < {ENTRIES}){rounds},
last AS MATERIALIZED ({_assigned(f"b{ROUNDS}")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, pos)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), books"""


VECTOR_CODES = _vector_codes()


def _filter_audit() -> str:
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(FILTERS))
    names = [f"f{i}" for i in range(len(FILTERS))]
    distinct = " AND ".join(f"{a}.c <> {b}.c" for i, a in enumerate(names) for b in names[:i])
    return f"""WITH cut AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
rated AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS toxic,
    CASE WHEN len(words) < {MIN_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '{SYMBOLS}') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
  FROM cut LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rated GROUP BY part, mask),
l(c, bit) AS (VALUES {letters}),
orders AS (SELECT {" || ".join(f"{a}.c" for a in names)} AS filter_order, [{", ".join(f"{a}.bit" for a in names)}] AS bits
  FROM {", ".join(f"l AS {a}" for a in names)} WHERE {distinct}),
steps AS (SELECT filter_order, s AS step, bits[s] AS bit, CAST(list_sum(list_slice(bits, 1, s)) AS INTEGER) - bits[s] AS done
  FROM orders, (VALUES {", ".join(f"({i + 1})" for i in range(len(FILTERS)))}) AS t(s)),
counted AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN (mask & (done + bit)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & done) = 0 AND (mask & bit) > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & done) > 0 AND (mask & bit) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & done) = 0 AND (mask & bit) > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & done) = 0 AND (mask & bit) > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted"""


FILTER_AUDIT = _filter_audit()

ORACLES: dict[str, str] = {
    "op7_url_filter": URL_FILTER,
    "op8_licenses": LICENCE_SCAN,
    "op11_vector_codes": VECTOR_CODES,
    "op12_filter_audit": FILTER_AUDIT,
}
