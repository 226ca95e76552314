"""DuckDB SQL for the registered queries, written apart from the Spark code.

Every string is self-contained: WITH parts are put together from the named
fragments below.
"""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = "[^" + WS[1:]
WORD = r"[\p{L}\p{N}_]"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS}+'), lambda x: x <> '')"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def straight(t: str) -> str:
    return squeeze(f"translate({t}, '’‘“”', '''''\"\"')")


def letters(t: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({t}, '[^a-zA-Z ]+', ' ', 'g'), ' +', ' ', 'g')))"


def letter_words(t: str) -> str:
    line = letters(t)
    for a, b in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")):
        line = rf"regexp_replace({line}, '\b({a})({b})\b', '\1 \2', 'g')"
    return f"list_filter(string_split({line}, ' '), lambda x: x <> '')"


def numbered(source: str, keys: str, array: str, no: str, name: str) -> str:
    return (
        f"SELECT {keys}, CAST(generate_subscripts(_a, 1) - 1 AS BIGINT) AS {no}, unnest(_a) AS {name} "
        f"FROM (SELECT {keys}, {array} AS _a FROM {source})"
    )


LINES = "lines AS (" + numbered("documents", "doc_id", "string_split(text, chr(10))", "line_no", "text") + ")"
SENTS = (
    "sents AS ("
    + numbered(
        "documents",
        "doc_id",
        rf"string_split(regexp_replace(text, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))",
        "sent_no",
        "text",
    )
    + ")"
)
TURNS = (
    "turns AS ("
    + numbered("conversations", "conv_id, turn, role", "string_split(text, chr(10))", "line_no", "text")
    + ")"
)
LAB = "lab AS (SELECT doc_id, text, toxic AS label FROM documents JOIN labels USING (doc_id))"
FLAGGED = "flagged AS (SELECT doc_id, text, toxic, 1 - quality AS low_quality FROM documents JOIN labels USING (doc_id))"
SPLIT = """hashed AS (
  SELECT doc_id, label, text,
    row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY label) AS n
  FROM lab),
parts AS (
  SELECT doc_id, label, text,
    CASE WHEN rn <= n * 8 // 10 THEN 'train' WHEN rn <= n * 9 // 10 THEN 'val' ELSE 'test' END AS split
  FROM hashed)"""
TOKS = f"""toks AS (SELECT doc_id, line_no, {letter_words('text')} AS tokens FROM lines),
ex AS ({numbered('toks', 'doc_id, line_no', 'tokens', 'pos', 'word')})"""
VOCAB = """first_seen AS (
  SELECT word, count(*) AS n, min({'d': doc_id, 'l': line_no, 'p': pos}) AS f FROM ex GROUP BY word),
vocab AS (
  SELECT word, 3 + row_number() OVER (ORDER BY f) AS id FROM first_seen WHERE n >= 3
  UNION ALL SELECT * FROM (VALUES ('<PAD>', 0), ('<START>', 1), ('<EOS>', 2), ('<UNK>', 3)) s(word, id))"""
ENC = """enc AS (
  SELECT doc_id, line_no, list(coalesce(v.id, 3) ORDER BY pos) || [2] AS ids
  FROM ex JOIN toks USING (doc_id, line_no) LEFT JOIN vocab v USING (word)
  WHERE len(toks.tokens) BETWEEN 2 AND 19
  GROUP BY doc_id, line_no)"""
ENCODED = f"{LINES}, {TOKS}, {VOCAB}, {ENC}"
RT = """rt AS (
  SELECT doc_id, line_no,
    string_agg(CASE WHEN v.word IS NULL THEN '<UNK>' ELSE v.word END, ' ' ORDER BY pos) AS text
  FROM ex JOIN toks USING (doc_id, line_no) LEFT JOIN vocab v USING (word)
  WHERE len(toks.tokens) BETWEEN 2 AND 19
  GROUP BY doc_id, line_no)"""
ROUND_TRIP = f"{LINES}, {TOKS}, {VOCAB}, {RT}"


def cleaned(name: str, source: str, keys: str) -> str:
    """CTE `name`: reason (null if kept) and cleaned text of every row of `source`."""
    return f"""{name} AS (
  SELECT {keys},
    CASE WHEN n = 0 THEN 'empty' WHEN n <= 2 THEN 'too_short'
      WHEN unk / n > 0.3 THEN 'high_unk' WHEN top / n > 0.5 THEN 'repetitive'
      WHEN alpha / n < 0.5 THEN 'non_alpha' WHEN n - unk <= 2 THEN 'short_after_clean' END AS reason,
    array_to_string(list_filter(w, lambda x: lower(x) NOT IN ('<unk>', 'unk')), ' ') AS text
  FROM (SELECT {keys}, w, len(w) AS n,
      len(list_filter(w, lambda x: lower(x) IN ('<unk>', 'unk'))) AS unk,
      len(list_filter(w, lambda x: regexp_matches(x, '[a-zA-Z]'))) AS alpha,
      list_max(map_values(list_aggregate(list_transform(w, lambda x: lower(x)), 'histogram'))) AS top
    FROM (SELECT {keys}, {words('text')} AS w FROM {source})))"""


def ids_text(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


CANDIDATES = f"{ROUND_TRIP}, {cleaned('c', 'rt', 'doc_id, line_no')}, cand AS (SELECT * FROM c WHERE reason IS NULL)"

# Patterns that rule out a neutral sentence.
BAD = "|".join(
    [
        r"^redirect([^\p{L}\p{N}_]|$)",
        r"\|",
        r"\{\{",
        r"\}\}",
        r"\[\[",
        r"\]\]",
        r"http[s]?://",
        r"www\.",
        "^talk:",
        "^category:",
        "^template:",
        "^file:",
        "^user:",
        f"^name{WS}*=",
    ]
)


def good_neutral(t: str) -> str:
    return (
        f"(length({t}) >= 5 AND len({words(t)}) BETWEEN 3 AND 20 AND NOT regexp_matches(lower({t}), '{BAD}') "
        rf"AND length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) / greatest(length({t}), 1) >= 0.55)"
    )


def sanitized(t: str) -> str:
    line = straight(t)
    line = rf"regexp_replace({line}, '^example *\p{{Nd}}+ *[:\-] *', '', 'i')"
    line = rf"regexp_replace({line}, '^output *[:\-] *', '', 'i')"
    line = f"regexp_replace({line}, '^[-*> ]+', '')"
    return squeeze(f"trim({line}, ' \"''`')")


def wordpunct(t: str) -> str:
    punct = r"[^\p{L}\p{N}_" + WS[1:]
    return f"regexp_extract_all(lower({straight(t)}), '{WORD}+|{punct}+')"


SCORED = "scored AS (SELECT doc_id, label, (doc_id % 10) / 10.0 AS prob FROM lab)"


def rates(prediction: str, source: str = "scored") -> str:
    """One row of counts, rates and AUC of `source` for a prediction expression."""
    return f"""SELECT tn, fp, fn, tp,
    (tp + tn) / (tn + fp + fn + tp) AS accuracy,
    CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
  FROM (SELECT count(*) FILTER (label = 0 AND NOT p) AS tn, count(*) FILTER (label = 0 AND p) AS fp,
      count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 1 AND p) AS tp
    FROM (SELECT label, {prediction} AS p FROM {source}))"""


AUC = """SELECT CASE WHEN p > 0 AND n > 0 THEN pairs / (CAST(p AS DOUBLE) * n) END AS auc_roc
  FROM (SELECT sum(pos * (below + neg / 2)) AS pairs, sum(pos) AS p, sum(neg) AS n
    FROM (SELECT pos, neg,
        coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
        FROM scored GROUP BY prob)))"""

TERMS = rf"""words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '{WORD}{{2,}}') AS w FROM lab),
grams AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]),
    lambda z: z[1] || ' ' || z[2])) FROM words WHERE len(w) > 1),
counts AS (SELECT doc_id, term, count(*) AS c FROM grams GROUP BY ALL),
terms AS (
  SELECT term, CAST(sum(c) AS BIGINT) AS tot, count(*) AS df FROM counts GROUP BY term
  ORDER BY tot DESC, term LIMIT 50000)"""

POOL = f"""scored AS (
  SELECT doc_id, line_no, text,
    CASE WHEN len({wordpunct('text')}) BETWEEN 3 AND 19 THEN (doc_id % 10) / 10.0 ELSE 0.0 END AS score
  FROM lines),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, line_no) AS rank, count(*) OVER () AS n FROM scored),
pool AS (SELECT * FROM ranked WHERE rank <= greatest(20, least(n, n // 2)))"""
SHOTS = """shots AS (
  SELECT row_number() OVER (ORDER BY md5('42:' || k), k) AS rank, text
  FROM (SELECT text, doc_id || ':' || line_no AS k FROM pool ORDER BY score DESC, doc_id, line_no LIMIT 100)
  WHERE length(text) > 0
  ORDER BY md5('42:' || k), k LIMIT 5)"""
# Fixed text of the few-shot prompt.
PROMPT = [
    "You generate exactly one neutral, non-toxic online message.",
    "Requirements:",
    "- Output exactly one single-line sentence.",
    "- Keep it natural, plain, and conversational.",
    "- Do not use labels, bullets, quotes, markdown, wiki markup, redirects, usernames, or explanations.",
    "- Do not mention toxicity, hate speech, or safety.",
    "- Keep it under 20 words.",
    "",
    "Examples:",
]
TAGGED = """tagged AS (
  SELECT doc_id, text, 'toxic' AS tag FROM flagged WHERE toxic = 1
  UNION ALL SELECT doc_id, text, 'low_quality' FROM flagged WHERE low_quality = 1
  UNION ALL SELECT doc_id, text, 'nor' FROM flagged WHERE toxic = 0 AND low_quality = 0)"""
VECTORS = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
EXPS = f"(SELECT vec_id, label, e, list_transform(e, lambda x: exp(x - list_max(e))) AS x FROM {VECTORS})"

PADDED = """padded AS (
  SELECT doc_id, line_no,
    CASE WHEN line_no % 3 = 0 THEN [1000000000] ELSE [] END || [1] || ids AS ids
  FROM enc)"""
SPREAD = f"spread AS ({numbered('padded', 'doc_id, line_no', 'ids', 'pos', 'id')})"


def decoded(drop_unknown: bool, keep_eos: bool) -> str:
    word = "v.word" if drop_unknown else "coalesce(v.word, '<UNK>')"
    skip = "(0, 1)" if keep_eos else "(0, 1, 2)"
    return f"""WITH {ENCODED}, {PADDED}, {SPREAD}
SELECT p.doc_id, p.line_no, coalesce(string_agg({word}, ' ' ORDER BY pos), '') AS text
FROM padded p LEFT JOIN spread s ON s.doc_id = p.doc_id AND s.line_no = p.line_no AND s.id NOT IN {skip}
LEFT JOIN vocab v ON v.id = s.id
GROUP BY p.doc_id, p.line_no"""


def fixed(length: int) -> str:
    cut = f"ids[1:{length}]"
    pad = f"list_transform(range({length} - len({cut})), lambda i: 0)"
    closed = f"CASE WHEN len(ids) > {length} THEN ids[1:{length - 1}] || [2] ELSE {cut} END"
    return f"""SELECT doc_id, line_no, CAST({length} AS BIGINT) AS length,
  {ids_text(f"({cut} || {pad})")} AS ids, {ids_text(f"(({closed}) || {pad})")} AS closed,
  len({cut}) AS nonpad FROM enc"""


def gram_counts(name: str, source: str, key: str) -> str:
    """CTE `name`: (k, term, c) of the texts of `source`."""
    return rf"""{name}_w AS (SELECT {key} AS k, regexp_extract_all(lower(text), '{WORD}{{2,}}') AS w FROM {source}),
{name} AS (SELECT k, term, count(*) AS c FROM (
  SELECT k, unnest(w) AS term FROM {name}_w
  UNION ALL
  SELECT k, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2]))
  FROM {name}_w WHERE len(w) > 1) GROUP BY ALL)"""


FIT = """fit AS (
  SELECT row_number() OVER (ORDER BY term) - 1 AS idx, term, ln((1 + (SELECT count(*) FROM lab)) / (1 + df)) + 1 AS idf FROM terms)"""


def linear_sums(name: str, counts: str, coefs: dict[str, str]) -> str:
    """CTE `name`: (k, ...coefs) sums over the unit vectors of the texts counted in `counts`."""
    each = ", ".join(f"({c}) AS {n}" for n, c in coefs.items())
    sums = ", ".join(f"sum(x * {n}) / sqrt(sum(x * x)) AS {n}" for n in coefs)
    return f"""{name} AS (SELECT k, {sums} FROM (
  SELECT k, (1 + ln(c)) * idf AS x, {each} FROM {counts} JOIN fit USING (term)) GROUP BY k)"""


TWO_MODELS = {"b": "((idx * 7) % 23 - 11) / 5.0::DOUBLE", "a": "((idx * 5) % 19 - 9) / 5.0::DOUBLE"}


def two_models(source: str, key: str) -> str:
    """CTE `rated`: (k, label, prob_b, prob_a) of `source`, and `both`, one row per setting."""
    probs = ", ".join(
        f"round(1 / (1 + exp(-(coalesce({m}, 0) + {b}))), 6) AS prob_{m}" for m, b in (("b", -0.3), ("a", 0.1))
    )
    return f"""{gram_counts("seen", source, key)}, {linear_sums("sums", "seen", TWO_MODELS)},
rated AS (SELECT s.*, {probs} FROM {source} AS s LEFT JOIN sums ON sums.k = s.{key}),
both_settings AS (
  SELECT *, 'baseline' AS setting, prob_b AS prob, prob_b > 0.5 AS p FROM rated
  UNION ALL SELECT *, 'augmented', prob_a, prob_a > 0.5 FROM rated)"""


def group_metrics(by: str, source: str) -> str:
    """CTE `long`: (by, metric, value) of `source` (by, label, prob, p)."""
    return f"""cm AS (SELECT {by}, count(*) FILTER (label = 0 AND NOT p) AS tn, count(*) FILTER (label = 0 AND p) AS fp,
    count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 1 AND p) AS tp FROM {source} GROUP BY {by}),
steps AS (SELECT {by}, prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY {by}, prob),
below AS (SELECT {by}, pos, neg,
    coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM steps),
area AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
    THEN sum(pos * (b + neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc_roc FROM below GROUP BY {by}),
wide AS (SELECT {by}, (tp + tn) / (tn + fp + fn + tp) AS accuracy,
    CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, auc_roc FROM cm JOIN area USING ({by})),
long AS (
  SELECT {by}, 'accuracy' AS metric, CAST(accuracy AS DOUBLE) AS value FROM wide
  UNION ALL SELECT {by}, 'precision', precision FROM wide
  UNION ALL SELECT {by}, 'recall', recall FROM wide
  UNION ALL SELECT {by}, 'f1', f1 FROM wide
  UNION ALL SELECT {by}, 'auc_roc', auc_roc FROM wide)"""


def three_classes(step: int) -> dict[str, str]:
    return {f"m{k}": f"((idx * {step} + {k} * 5) % 23 - 11) / 5.0::DOUBLE" for k in range(3)}


EXP3 = [f"exp(coalesce(m{k}, 0) + 0.{k})" for k in range(3)]

THREE_WAY = f"""tw AS (SELECT doc_id || ':' || line_no AS k, text, CASE WHEN (doc_id + line_no) % 4 - 1 = 2 THEN 0 ELSE 1 END AS label FROM lines
  WHERE (doc_id + line_no) % 4 - 1 <> -1 AND regexp_matches(text, '{NON_WS}'))"""
ANNOTATED = f"""votes AS (
  SELECT conv_id, turn, text, conv_id % 5 <> 0 AS has_label, conv_id % 3 AS own,
    turn % 3 AS a, (turn + conv_id) % 3 AS b, length(text) % 3 AS c FROM conversations),
majority AS (
  SELECT *, CASE WHEN turn % 4 <> 3 THEN CASE WHEN b = c THEN b ELSE a END WHEN has_label THEN own END AS value FROM votes),
an AS (SELECT conv_id || ':' || turn AS k, text, CASE WHEN value = 0 THEN 0 ELSE 1 END AS label
  FROM majority WHERE value IS NOT NULL AND regexp_matches(text, '{NON_WS}'))"""


def pool_model(generation: int, rows: str) -> str:
    """CTE `g<generation>`: (doc_id, line_no, k, text, fits, score) of `rows`, scored by the generation's model."""
    n = f"g{generation}"
    return f"""{n}_fit AS (SELECT * FROM {rows} WHERE fits), {gram_counts(f"{n}_c", f"{n}_fit", "k")},
{linear_sums(f"{n}_s", f"{n}_c", three_classes(generation + 3))},
{n} AS (SELECT r.doc_id, r.line_no, r.k, r.text, r.fits,
  CASE WHEN fits THEN round({EXP3[0]} / ({" + ".join(EXP3)}), 6) ELSE 0.0 END AS score FROM {rows} AS r LEFT JOIN {n}_s AS s USING (k))"""


def pool_survivors(generation: int) -> str:
    return f"""s{generation} AS (SELECT * EXCLUDE (rn, n) FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, line_no) AS rn, count(*) OVER () AS n FROM g{generation})
  WHERE rn <= greatest(20, least(n, n // 2)))"""


CLASS_ROWS = f"""real AS (
  SELECT conv_id || ':' || turn || ':' || line_no AS row_id, list_position(['system', 'user', 'assistant'], role) - 1 AS class_idx, text
  FROM turns WHERE regexp_matches(text, '{NON_WS}')
  UNION ALL SELECT 'added:' || doc_id || ':' || line_no, 3, text FROM cand)"""

ORACLES: dict[str, str] = {
    "scan_labelled": """SELECT doc_id, length(text) AS text_length, CAST(toxic AS BIGINT) AS toxic,
  CAST(quality AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id)""",
    "scan_fallback": f"""WITH {FLAGGED}, kept AS (SELECT * FROM flagged WHERE regexp_matches(text, '{NON_WS}'))
SELECT 'with_label' AS "case", 'primary' AS source, count(*) AS rows,
  CAST(sum(toxic) AS BIGINT) AS positives FROM kept
UNION ALL SELECT c, 'fallback', count(*), CAST(sum(greatest(toxic, low_quality)) AS BIGINT)
FROM kept, (VALUES ('without_label'), ('missing')) t(c) GROUP BY c""",
    "split_roundtrip": f"""WITH {LAB}, {SPLIT}
SELECT split, CAST(label AS BIGINT) AS label, count(*) AS rows FROM parts GROUP BY ALL""",
    "gen_json_roundtrip": """SELECT form, CAST(list_position(['system', 'user', 'assistant'], role) - 1 AS VARCHAR) AS class,
  md5(text) AS text_md5, count(*) AS n
FROM conversations, (VALUES ('rows'), ('columns')) t(form) GROUP BY ALL""",
    "read_text_robust": r"""WITH l AS (
  SELECT 'utf8' AS encoding, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS v
  FROM documents
  UNION ALL
  SELECT 'latin', unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'))
  FROM documents WHERE NOT regexp_matches(text, '[^\x{00}-\x{ff}]')
  UNION ALL
  SELECT 'windows', unnest(string_split_regex(translate(text, '.,', '…‚'), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'))
  FROM documents WHERE NOT regexp_matches(text, '[^\x{00}-\x{7f}\x{a0}-\x{ff}]'))
SELECT encoding, md5(v) AS line_md5, count(*) AS n FROM l GROUP BY ALL""",
    "tagged_lines": f"""WITH {TURNS}
SELECT role AS tag, CAST(list_position(['system', 'user', 'assistant'], role) - 1 AS BIGINT) AS tag_no, count(*) AS lines,
  count(*) FILTER (regexp_matches(text, '{NON_WS}')) AS nonblank_lines FROM turns GROUP BY ALL""",
    "class_export": f"""WITH {FLAGGED}, {TAGGED}
SELECT tag, md5(text) AS text_md5, count(*) AS n FROM tagged GROUP BY ALL""",
    "class_counts": f"WITH {FLAGGED}, {TAGGED} SELECT tag, count(*) AS n FROM tagged GROUP BY tag",
    "token_ids_roundtrip": f"""WITH {ENCODED}
SELECT lang AS tag, {ids_text('ids')} AS ids, count(*) AS n FROM enc JOIN documents USING (doc_id) GROUP BY ALL""",
    "vocab_roundtrip": f"WITH {LINES}, {TOKS}, {VOCAB} SELECT CAST(id AS BIGINT) AS id, word FROM vocab",
    "binary_label": f"""WITH {FLAGGED}
SELECT doc_id, CAST(CASE WHEN toxic + low_quality > 0 THEN 1 ELSE 0 END AS BIGINT) AS label FROM flagged
WHERE regexp_matches(text, '{NON_WS}')""",
    "class_rows": f"WITH {FLAGGED}, {TAGGED} SELECT tag, doc_id FROM tagged WHERE tag <> 'nor'",
    "nonblank": f"""SELECT doc_id, 'whole' AS variant FROM documents WHERE regexp_matches(text, '{NON_WS}')
UNION ALL SELECT doc_id, 'bare' FROM documents
WHERE regexp_matches(regexp_replace(text, '{NON_WS}+', ' ', 'g'), '{NON_WS}')""",
    "neutral_subset": f"WITH {FLAGGED} SELECT doc_id FROM flagged WHERE toxic = 0 AND low_quality = 0",
    "adapt_threeway": f"""WITH {LINES}, k AS (SELECT *, (doc_id + line_no) % 4 - 1 AS class FROM lines)
SELECT doc_id, line_no, CAST(CASE WHEN class = 2 THEN 0 ELSE 1 END AS BIGINT) AS label FROM k
WHERE class <> -1 AND regexp_matches(text, '{NON_WS}')""",
    "adapt_annotated": f"""WITH v AS (
  SELECT conv_id, turn, text, conv_id % 5 <> 0 AS has_label, conv_id % 3 AS own,
    turn % 3 AS a, (turn + conv_id) % 3 AS b, length(text) % 3 AS c FROM conversations),
m AS (
  SELECT *, CASE WHEN turn % 4 <> 3 THEN CASE WHEN b = c THEN b ELSE a END
    WHEN has_label THEN own END AS value FROM v)
SELECT conv_id, turn, CAST(CASE WHEN value = 0 THEN 0 ELSE 1 END AS BIGINT) AS label, md5(text) AS text_md5
FROM m WHERE value IS NOT NULL AND regexp_matches(text, '{NON_WS}')""",
    "clean_reasons": f"""WITH {ROUND_TRIP}, {SENTS}, {cleaned('a', 'sents', 'doc_id, sent_no')},
{cleaned('b', 'rt', 'doc_id, line_no')}
SELECT 'sentences' AS source, doc_id, sent_no AS item_no, coalesce(reason, 'kept') AS reason FROM a
UNION ALL SELECT 'decoded', doc_id, line_no, coalesce(reason, 'kept') FROM b""",
    "clean_generated": f"WITH {CANDIDATES} SELECT doc_id, line_no, text FROM cand",
    "clean_report": f"""WITH {ROUND_TRIP}, {cleaned('c', 'rt', 'doc_id, line_no')}
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY 1
UNION ALL SELECT 'input', count(*), 1.0 FROM c""",
    "encode_tokens": f"WITH {ENCODED} SELECT doc_id, line_no, {ids_text('ids')} AS ids FROM enc",
    "encode_framed": f"""WITH {ENCODED}
SELECT doc_id, line_no, {ids_text('[1] || ids')} AS ids FROM enc WHERE len(ids) >= 4""",
    "neutral_candidates": f"""WITH {LINES}, p AS ({numbered('pages', 'page_id', "string_split(html, chr(10))", 'line_no', 'text')})
SELECT 'documents' AS source, doc_id, line_no, CAST({good_neutral('text')} AS BIGINT) AS ok FROM lines
UNION ALL SELECT 'pages', page_id, line_no, CAST({good_neutral('text')} AS BIGINT) FROM p""",
    "quick_cap": f"""WITH {LAB}, {SPLIT}
SELECT split, doc_id FROM (SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn FROM parts)
WHERE rn <= CASE WHEN split = 'train' THEN 50 ELSE 5 END""",
    "decode_tokens": decoded(drop_unknown=False, keep_eos=False),
    "decode_sample": decoded(drop_unknown=True, keep_eos=False),
    "decode_keep_eos": decoded(drop_unknown=False, keep_eos=True),
    "fallback_pool": f"""WITH {TURNS}, ex AS (SELECT DISTINCT text FROM turns WHERE role = 'system'),
drawn AS (
  SELECT text, conv_id || ':' || turn || ':' || line_no AS k FROM turns
  WHERE role = 'assistant' AND text NOT IN (SELECT text FROM ex)
  ORDER BY md5('42:' || k), k LIMIT 100),
s AS (SELECT k, {sanitized('text')} AS text FROM drawn),
g AS (SELECT * FROM s WHERE {good_neutral('text')} AND text NOT IN (SELECT text FROM ex)),
u AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY md5('42:' || k), k) AS rn FROM g)
SELECT row_number() OVER (ORDER BY md5('42:' || k), k) AS rank, text FROM u WHERE rn = 1""",
    "max_anchor_cosine": """SELECT c.vec_id,
  round(max(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS max_cos
FROM embeddings c, embeddings a WHERE c.label <> 0 AND a.label = 0 GROUP BY c.vec_id""",
    "token_counts": f"""SELECT word, count(*) AS n
FROM (SELECT unnest({words('lower(text)')}) AS word FROM documents) GROUP BY word""",
    "vocab_first_seen": f"WITH {LINES}, {TOKS}, {VOCAB} SELECT word, CAST(id AS BIGINT) AS id FROM vocab",
    "vocab_topk": f"""WITH t AS ({numbered('documents', 'doc_id', words('lower(text)'), 'pos', 'word')}),
c AS (SELECT word, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS f FROM t GROUP BY word),
k AS (SELECT * FROM c ORDER BY n DESC, f LIMIT 50000)
SELECT word, 1 + row_number() OVER (ORDER BY n DESC, f) AS id FROM k WHERE n >= 2
UNION ALL SELECT * FROM (VALUES ('<PAD>', 0), ('<UNK>', 1)) s(word, id)""",
    "vocab_size": f"""WITH {LINES}, {TOKS}, c AS (SELECT word, count(*) AS n FROM ex GROUP BY word)
SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) AS distinct_words, count(*) FILTER (n >= 3) AS kept_words FROM c""",
    "label_distribution": f"""WITH {LAB}, c AS (
  SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM lab)
SELECT CAST(l AS BIGINT) AS label, CASE WHEN l = 0 THEN n0 ELSE n1 END AS n,
  round((CASE WHEN l = 0 THEN n0 ELSE n1 END) / (n0 + n1), 6) AS share,
  round(n0 / greatest(n1, 1), 6) AS ratio, CAST(n0 / greatest(n1, 1) > 3 AS BIGINT) AS imbalanced
FROM c, (VALUES (0), (1)) t(l)""",
    "class_weights": f"""WITH {LAB}, {SPLIT}
SELECT CAST(label AS BIGINT) AS label,
  round((SELECT count(*) FROM parts WHERE split = 'train') / (2 * count(*)), 6) AS weight
FROM parts WHERE split = 'train' GROUP BY label""",
    "augmentation_impact": f"""WITH {LAB}, {SPLIT}, {CANDIDATES}, b AS (
  SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1,
    (SELECT count(*) FROM cand) AS added FROM parts WHERE split = 'train')
SELECT 'baseline' AS setting, n0, n1, round(100 * n1 / (n0 + n1), 6) AS pct1 FROM b
UNION ALL SELECT 'augmented', n0, n1 + added, round(100 * (n1 + added) / (n0 + n1 + added), 6) FROM b
UNION ALL SELECT 'delta', 0, added, round(100 * (n1 + added) / (n0 + n1 + added) - 100 * n1 / (n0 + n1), 6) FROM b""",
    "augment_union": f"""WITH {LAB}, {SPLIT}, {CANDIDATES}, r AS (
  SELECT s AS setting, label FROM parts, (VALUES ('baseline'), ('augmented')) t(s) WHERE split = 'train'
  UNION ALL SELECT 'augmented', 1 FROM cand)
SELECT setting, CAST(label AS BIGINT) AS label, count(*) AS n FROM r GROUP BY ALL""",
    "majority_vote": """WITH c AS (
  SELECT conv_id, turn % 3 AS vote, count(*) AS n, min(turn) AS f FROM conversations GROUP BY ALL)
SELECT conv_id, vote FROM (
  SELECT conv_id, vote, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""",
    "confusion_matrix": f"WITH {LAB}, {SCORED} SELECT tn, fp, fn, tp FROM ({rates('prob > 0.5')})",
    "binary_metrics": f"""WITH {LAB}, {SCORED}
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round((SELECT auc_roc FROM ({AUC})), 6) AS auc_roc FROM ({rates('prob > 0.5')})""",
    # The area by its pairwise definition, independent of running counts.
    "roc_auc": f"""WITH {LAB}, {SCORED}
SELECT round((count(*) FILTER (p.prob > n.prob) + 0.5 * count(*) FILTER (p.prob = n.prob)) / count(*), 6) AS auc_roc
FROM scored p, scored n WHERE p.label = 1 AND n.label = 0""",
    "log_loss": f"""WITH {LAB}, {SCORED}, l AS (
  SELECT label + 1.0 AS w, -ln(CASE WHEN label = 1 THEN p ELSE 1 - p END) AS loss
  FROM (SELECT label, least(greatest(CAST(prob AS DOUBLE), 1e-15), 1 - 1e-15) AS p FROM scored))
SELECT 'plain' AS kind, round(avg(loss), 6) AS log_loss FROM l
UNION ALL SELECT 'weighted', round(sum(w * loss) / sum(w), 6) FROM l""",
    "mean_score": f"""SELECT CAST(label AS BIGINT) AS label,
  round(avg(1 - x[label + 1] / list_sum(x)), 6) AS mean_score FROM {EXPS} GROUP BY label""",
    "tfidf_terms": f"WITH {LAB}, {TERMS} SELECT term, tot, df FROM terms",
    "tfidf_weights": f"""WITH {LAB}, {TERMS}, raw AS (
  SELECT doc_id, term, (1 + ln(c)) * (ln((1 + (SELECT count(*) FROM lab)) / (1 + df)) + 1) AS w
  FROM counts JOIN terms USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
    "stratified_split": f"WITH {LAB}, {SPLIT} SELECT doc_id, CAST(label AS BIGINT) AS label, split FROM parts",
    "dedup_first_seen": f"""WITH {LINES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, line_no) AS rn FROM lines)
SELECT doc_id, line_no, text FROM r WHERE rn = 1""",
    "pool_refresh": f"""WITH {LINES}, {POOL}
SELECT rank, doc_id, line_no, CAST(score AS DOUBLE) AS score FROM pool""",
    "fewshot_examples": f"WITH {LINES}, {POOL}, {SHOTS} SELECT rank, text FROM shots",
    "prompt_text": f"""WITH {LINES}, {POOL}, {SHOTS}
SELECT array_to_string([{', '.join(f"'{p}'" for p in PROMPT)}], chr(10)) || chr(10)
  || string_agg(rank || '. ' || {straight('text')}, chr(10) ORDER BY rank) || chr(10) || chr(10)
  || 'Output one new neutral sentence only:' AS prompt FROM shots""",
    "sample_k": "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
    "normalize_text": f"""WITH {LINES}
SELECT doc_id, line_no, {letters('text')} AS letters, {straight('text')} AS straight FROM lines""",
    "sanitize_lines": f"""WITH {LINES}, h AS (
  SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN 'Example 3: ' WHEN 1 THEN 'OUTPUT - '
    WHEN 2 THEN '-* > "' ELSE '' END || text AS t FROM lines)
SELECT doc_id, line_no, {sanitized('t')} AS text FROM h""",
    "tokenize_words": f"""WITH {LINES}, t AS (SELECT doc_id, line_no, {letter_words('text')} AS w FROM lines)
SELECT doc_id, line_no, len(w) AS n, array_to_string(w, ' ') AS tokens FROM t""",
    "tokenize_wordpunct": f"""WITH {LINES}, t AS (SELECT doc_id, line_no, {wordpunct('text')} AS w FROM lines)
SELECT doc_id, line_no, len(w) AS n, array_to_string(w, ' ') AS tokens FROM t""",
    "pad_truncate": f"WITH {ENCODED} {fixed(20)} UNION ALL {fixed(8)}",
    "shift_targets": f"""WITH {ENCODED}
SELECT doc_id, line_no, {ids_text('ids[1:len(ids) - 1]')} AS inputs, {ids_text('ids[2:len(ids)]')} AS targets FROM enc""",
    "one_hot": """SELECT vec_id, array_to_string(list_transform(range(12), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), ' ')
  AS one_hot FROM embeddings""",
    "softmax_argmax": f"""SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS best,
  round(list_max(x) / list_sum(x), 6) AS max_p FROM {EXPS}""",
    "metric_delta": f"""WITH {LAB}, {SCORED}, b AS ({rates('prob > 0.5')}), a AS ({rates('prob > 0.3')}), u AS ({AUC}),
m AS (
  SELECT 'accuracy' AS metric, b.accuracy AS x, a.accuracy AS y FROM b, a
  UNION ALL SELECT 'precision', b.precision, a.precision FROM b, a
  UNION ALL SELECT 'recall', b.recall, a.recall FROM b, a
  UNION ALL SELECT 'f1', b.f1, a.f1 FROM b, a
  UNION ALL SELECT 'auc_roc', auc_roc, auc_roc FROM u)
SELECT metric, round(x, 6) AS baseline, round(y, 6) AS augmented, round(y - x, 6) AS delta,
  CASE WHEN round(y - x, 6) > 0 THEN 'OUTPERFORMS' WHEN round(y - x, 6) < 0 THEN 'UNDERPERFORMS'
    ELSE 'MATCHES' END AS verdict FROM m""",
    "multiclass_table": f"""WITH {TURNS}, {CANDIDATES}, r AS (
  SELECT list_position(['system', 'user', 'assistant'], role) - 1 AS k FROM turns
  WHERE regexp_matches(text, '{NON_WS}')
  UNION ALL SELECT 3 FROM cand)
SELECT CAST(k AS BIGINT) AS class_idx, ['1 0 0 0', '0 1 0 0', '0 0 1 0', '0 0 0 1'][k + 1] AS one_hot, count(*) AS n
FROM r GROUP BY k""",
    "multiclass_rows": f"""WITH {TURNS}, {CANDIDATES}, {CLASS_ROWS}
SELECT row_id, CAST(class_idx AS BIGINT) AS class_idx, md5(text) AS text_md5 FROM real""",
    "encode_cut": f"""WITH t AS ({numbered('documents', 'doc_id', words('lower(text)'), 'pos', 'word')}),
c AS (SELECT word, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS f FROM t GROUP BY word),
k AS (SELECT * FROM c ORDER BY n DESC, f LIMIT 50000),
v AS (SELECT word, 1 + row_number() OVER (ORDER BY n DESC, f) AS id FROM k WHERE n >= 2),
e AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM t LEFT JOIN v USING (word) WHERE pos < 200 GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN e USING (doc_id))
SELECT doc_id, {ids_text('(ids || list_transform(range(200 - len(ids)), lambda i: 0))')} AS ids, CAST(len(ids) AS BIGINT) AS length FROM x""",
    "class_scores": f"""WITH {LAB}, {SPLIT}, {TERMS}, {FIT}, unseen AS (SELECT * FROM parts WHERE split <> 'train'),
{gram_counts("seen", "unseen", "doc_id")}, {linear_sums("s", "seen", three_classes(7))},
p AS (SELECT doc_id, {", ".join(f"{e} AS e{k}" for k, e in enumerate(EXP3))} FROM unseen LEFT JOIN s ON s.k = doc_id)
SELECT doc_id, CAST(CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS BIGINT) AS prediction,
  {", ".join(f"round(e{k} / (e0 + e1 + e2), 6) AS p{k}" for k in range(3))} FROM p""",
    "pool_generations": f"""WITH {LAB}, {TERMS}, {FIT}, {LINES}, pool AS (
  SELECT doc_id, line_no, doc_id || ':' || line_no AS k, text, len({wordpunct('text')}) BETWEEN 3 AND 19 AS fits FROM lines),
{pool_model(0, "pool")}, {pool_survivors(0)}, {pool_model(1, "s0")}, {pool_survivors(1)}, {pool_model(2, "s1")}
SELECT CAST(0 AS BIGINT) AS generation, doc_id, line_no, CAST(score AS DOUBLE) AS score FROM g0
UNION ALL SELECT 1, doc_id, line_no, score FROM g1 UNION ALL SELECT 2, doc_id, line_no, score FROM g2""",
    # At an optimum every slope of the loss is 0, whatever the solver.
    "lr_optimality": f"""WITH {LAB}, {SPLIT}, train AS (SELECT * FROM parts WHERE split = 'train'), {gram_counts("seen", "train", "doc_id")}
SELECT (SELECT count(*) FROM train) AS rows, least(50000, count(DISTINCT term)) AS terms,
  CAST((SELECT count(*) FROM train) AS DOUBLE) AS weight_sum, CAST(1 AS BIGINT) AS flat_by_coefficient,
  CAST(0 AS DOUBLE) AS slope_by_intercept FROM seen""",
    "class_optimality": f"""WITH {LAB}, {SPLIT}, {FLAGGED}, {TAGGED},
train AS (SELECT tag || ':' || doc_id AS k, t.text FROM tagged AS t JOIN parts USING (doc_id)
  WHERE split = 'train' AND regexp_matches(t.text, '{NON_WS}')), {gram_counts("seen", "train", "k")}
SELECT (SELECT count(*) FROM train) AS rows, least(50000, count(DISTINCT term)) AS terms,
  CAST((SELECT count(*) FROM train) AS DOUBLE) AS weight_sum, CAST(1 AS BIGINT) AS flat_by_coefficient,
  CAST(0 AS DOUBLE) AS slope_by_intercept FROM seen""",
    "fixed_predictions": f"""WITH {LAB}, {SPLIT}, {TERMS}, {FIT}, test AS (SELECT doc_id, label, text FROM parts WHERE split = 'test'),
{two_models("test", "doc_id")}
SELECT doc_id, CAST(label AS BIGINT) AS label, CAST(CAST(prob_b > 0.5 AS INTEGER) AS BIGINT) AS pred_b,
  CAST(CAST(prob_a > 0.5 AS INTEGER) AS BIGINT) AS pred_a, prob_b, prob_a FROM rated""",
    "fixed_report": f"""WITH {LAB}, {SPLIT}, {TERMS}, {FIT}, {CANDIDATES},
test AS (SELECT doc_id, label, text FROM parts WHERE split = 'test'),
{two_models("test", "doc_id")}, {group_metrics("setting", "both_settings")},
n AS (SELECT count(*) AS train, count(*) FILTER (label = 1) AS toxic,
  (SELECT count(*) FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS added FROM parts WHERE split = 'train'),
sizes AS (
  SELECT 'train_original' AS metric, train AS value FROM n UNION ALL SELECT 'original_toxic', toxic FROM n
  UNION ALL SELECT 'original_nontoxic', train - toxic FROM n UNION ALL SELECT 'generated_cleaned', added FROM n
  UNION ALL SELECT 'train_augmented', train + added FROM n UNION ALL SELECT 'augmented_toxic', toxic + added FROM n
  UNION ALL SELECT 'test_size', count(*) FROM test)
SELECT setting, metric, round(value, 6) AS value FROM long
UNION ALL SELECT 'sizes', metric, CAST(value AS DOUBLE) FROM sizes
UNION ALL SELECT 'delta', metric, round(a.value - b.value, 6)
  FROM (SELECT * FROM long WHERE setting = 'augmented') a JOIN (SELECT * FROM long WHERE setting = 'baseline') b USING (metric)""",
    "cross_dataset_fixed": f"""WITH {LAB}, {SPLIT}, {TERMS}, {FIT}, {LINES}, {THREE_WAY}, {ANNOTATED},
outside AS (
  SELECT 'three_way:' || k AS id, 'three_way' AS dataset, text, label FROM tw
  UNION ALL SELECT 'annotated:' || k, 'annotated', text, label FROM an
  UNION ALL SELECT 'lang:' || doc_id, 'lang_' || coalesce(lang, 'None'), p.text, label
    FROM parts AS p JOIN documents USING (doc_id) WHERE split <> 'train'),
{two_models("outside", "id")}, joined AS (SELECT dataset || '|' || setting AS g, * FROM both_settings), {group_metrics("g", "joined")}
SELECT 'fixed' AS model, split_part(g, '|', 2) AS setting, split_part(g, '|', 1) AS dataset, metric, round(value, 6) AS value FROM long""",
}
