"""DuckDB SQL of the registered queries, built from the same definitions in RE2 and list functions."""

from __future__ import annotations

from proseline.functions import lint as L
from proseline.functions.lazy import STANDARD
from proseline.functions.metrics import E_WEIGHTS, SPIKE_STOPWORDS, TELLING_VERBS

SP = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SP}+|{SP}+$', '', 'g')"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{SP}+'), lambda x: x <> '')"


def parts(t: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({t}, {q(pattern)}), lambda x: {strip('x')}), lambda x: x <> '')"


def sentences(t: str) -> str:
    return parts(t, "[.!?]+")


def lines(t: str) -> str:
    return f"string_split({t}, {NL})"


def n(t: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({t}, {q((f'(?{flags})' if flags else '') + pattern)}))"


def runs(v: str) -> str:
    return f"map_values(list_aggregate({v}, 'histogram'))"


def repeated(v: str) -> str:
    return f"coalesce(len(list_filter({runs(v)}, lambda x: x > 1)), 0)"


def cv(v: str) -> str:
    """Of a list of whole numbers."""
    total, square = f"list_sum({v})", f"list_sum(list_transform({v}, lambda x: x * x))"
    return f"(CASE WHEN {total} > 0 THEN sqrt(CAST(len({v}) * {square} - {total} * {total} AS DOUBLE)) / {total} ELSE 0 END)"


DOCS = "d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)"
PARTS = f"p AS (SELECT *, {words('t')} AS w, {sentences('t')} AS s, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') AS u FROM d)"
LENGTHS = f"l AS (SELECT *, list_transform(s, lambda y: len({words('y')})) AS k FROM p)"
CV = f"c AS (SELECT *, {cv('k')} AS v FROM l)"
COHERENCE = "CASE WHEN len(k) = 0 THEN 0 WHEN v < 0.15 THEN 0.3 WHEN v < 0.3 THEN 0.3 + (v - 0.15) / 0.15 * 0.5 WHEN v <= 0.8 THEN 0.8 WHEN v <= 1.2 THEN 0.8 - (v - 0.8) / 0.4 * 0.4 ELSE 0.4 END"
AWL = "list_sum(list_transform(u, lambda x: len(x))) / len(u)"
READABILITY = f"CASE WHEN len(u) = 0 THEN 0 ELSE least(greatest((len(list_distinct(u)) / sqrt(len(u)) - 7.0) / 6.0, 0), 1) * (1 - least(0.3, greatest(0, ({AWL} - 5.5) / 3.0))) END"
_BI = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
_TRI = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
REPETITION = f"""r AS (SELECT *,
  CASE WHEN len(w) > 1 THEN {repeated('w')} / len(w) ELSE 0 END AS tok,
  CASE WHEN len(w) > 1 THEN {repeated(_BI)} / (len(w) - 1) ELSE 0 END AS bi,
  CASE WHEN len(w) > 2 THEN {repeated(_TRI)} / (len(w) - 2) ELSE 0 END AS tri,
  CASE WHEN len(w) > 1 THEN len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) / (len(w) - 1) ELSE 0 END AS run,
  CASE WHEN len(w) > 1 AND len(s) >= 2 THEN 1 - len(list_distinct(list_transform(s, lambda y: regexp_replace(lower(y), '{SP}+', ' ', 'g')))) / len(s) ELSE 0 END AS dup,
  CASE WHEN len(w) >= 60 THEN 1 - len(list_distinct(list_transform(range(1, len(w) - 28), lambda i: array_to_string(w[i : i + 29], ' ')))) / (len(w) - 29) ELSE 0 END AS seq
  FROM c)"""
CHEAP = f"""x AS (SELECT *, {COHERENCE} AS coherence_score, {READABILITY} AS readability_score,
  greatest(tok * 0.4 + bi * 0.3 + tri * 0.2 + run * 0.1, dup, seq) AS repetition_penalty, len(t) AS response_length FROM r),
cheap AS (SELECT doc_id, source, lang, coherence_score, readability_score, repetition_penalty, response_length, len(s) AS sentence_count, tok, bi, tri, run, dup, seq FROM x)"""
BASE = f"WITH {DOCS}, {PARTS}, {LENGTHS}, {CV}"

SENTENCE_STATS = f"""{BASE} SELECT doc_id, CAST(len(k) AS BIGINT) AS sentence_count, round(coalesce(list_avg(k), 0), 6) AS avg_sentence_length, round(v, 6) AS sentence_length_variation,
  round({COHERENCE}, 6) AS coherence_score FROM c"""
COHERENCE_BY_SOURCE = f"{BASE} SELECT source, round(avg({COHERENCE}), 6) AS avg_coherence, count(*) AS n FROM c GROUP BY source"
REPETITION_Q = f"""{BASE}, {REPETITION} SELECT doc_id, round(tok, 6) AS token_repetition_rate, round(bi, 6) AS bigram_repetition_rate, round(tri, 6) AS trigram_repetition_rate,
  round(run, 6) AS consecutive_repetition_score, round(dup, 6) AS sentence_duplicate_ratio, round(seq, 6) AS sequence_repetition_score, round(greatest(tok * 0.4 + bi * 0.3 + tri * 0.2 + run * 0.1, dup, seq), 6) AS repetition_penalty FROM r"""
READABILITY_Q = f"""{BASE} SELECT doc_id, CAST(len(u) AS BIGINT) AS word_count, round(coalesce({AWL}, 0), 6) AS avg_word_length,
  round(CASE WHEN len(u) > 0 THEN len(list_distinct(u)) / len(u) ELSE 0 END, 6) AS lexical_diversity, round({READABILITY}, 6) AS readability_score FROM c"""

# --- prose craft -----------------------------------------------------------------------------------------------------
_STOP = "[" + ", ".join(q(w) for w in SPIKE_STOPWORDS) + "]"
_VERB = "(^|[^a-zA-Z])(" + "|".join(TELLING_VERBS) + ")([^a-zA-Z]|$)"
_MARK = "chr(1)"
PROSE = f"""{BASE}, a AS (SELECT *, regexp_extract_all(lower(t), '[a-z]+') AS aw, {parts('t', chr(92) + 'n' + SP + '*' + chr(92) + 'n')} AS pg0,
    list_filter(list_transform(s, lambda y: lower(regexp_extract(y, '^["'']?\\s*([a-zA-Z]+)', 1))), lambda y: y <> '') AS fw FROM c),
b AS (SELECT *, CASE WHEN len(pg0) > 0 THEN pg0 ELSE [t] END AS pg, {runs('fw')} AS fr, len(fw) AS fn,
    coalesce(list_max({runs(f'list_filter(aw, lambda x: len(x) > 3 AND NOT list_contains({_STOP}, x))')}), 0) AS spike FROM a),
e AS (SELECT *, list_transform(pg, lambda y: greatest(1, len({sentences('y')}))) AS pk,
    -list_sum(list_transform(fr, lambda c: c / fn * log2(c / fn))) AS h,
    len(list_filter(s, lambda y: regexp_matches(lower(y), '{_VERB}'))) / len(s) AS tell,
    len(list_filter(s, lambda y: regexp_matches(y, '["“”]') OR regexp_matches(y, '(?i)[''‘’].*said'))) / len(s) AS talk,
    len(list_filter(regexp_extract_all(regexp_replace(t, '\\*{{2,}}', {_MARK}, 'g'), '\\*([^*\\n]+)\\*', 1), lambda m: len({words('m')}) <= 3)) AS emph,
    {n('t', '—| -- ')} / greatest(len(pg), floor(len(aw) / 80), 1) AS dash FROM b),
f AS (SELECT *, list_avg(pk) AS pm, {cv('pk')} AS pv FROM e),
m AS (SELECT doc_id, len(s) >= 3 AND len(aw) >= 20 AS enough,
    CASE WHEN fn = 0 THEN 0 ELSE least(1, greatest(0, 1 - h / CASE WHEN fn > 1 THEN log2(fn) ELSE 1 END, list_max(fr) / fn - 0.3)) END AS sentence_start_monotony,
    least(1, greatest(0, (spike / (len(aw) / 100.0) - 2) / 4)) AS word_frequency_spike,
    CASE WHEN v >= 0.5 THEN 0 WHEN v >= 0.2 THEN (0.5 - v) / 0.3 * 0.7 ELSE 0.7 + (0.2 - v) / 0.2 * 0.3 END AS sentence_length_uniformity,
    CASE WHEN tell <= 0.3 THEN 0 ELSE least(1, (tell - 0.3) / 0.5) END AS telling_verb_density,
    CASE WHEN len(pg) = 1 THEN CASE WHEN len(s) > 8 THEN 0.3 ELSE 0 END
         ELSE greatest(CASE WHEN pm <= 1.5 AND len(pg) >= 6 THEN 0.6 WHEN pm <= 2 AND len(pg) >= 8 THEN 0.4 ELSE 0 END, CASE WHEN pv >= 0.4 THEN 0 ELSE (0.4 - pv) / 0.4 * 0.4 END) END AS paragraph_uniformity,
    CASE WHEN talk BETWEEN 0.10 AND 0.65 THEN 0 WHEN talk < 0.10 THEN (0.10 - talk) / 0.10 * 0.25 ELSE least(0.6, (talk - 0.65) / 0.35 * 0.6) END AS dialogue_narration_balance,
    CASE WHEN emph = 0 THEN 0 WHEN emph <= 2 THEN emph * 0.15 ELSE least(1, 0.3 + (emph - 2) * 0.14) END AS markdown_emphasis_penalty,
    CASE WHEN dash <= 0.5 THEN 0 ELSE 1 - 1 / (1 + (dash - 0.5) * (dash - 0.5) / 2) END AS em_dash_density_penalty FROM f),
z AS (SELECT doc_id, {', '.join(f'CAST(CASE WHEN enough THEN {k} ELSE 0 END AS DOUBLE) AS {k}' for k in E_WEIGHTS)} FROM m),
prose AS (SELECT *, least(1, greatest(0, {' + '.join(f'{k} * {w}' for k, w in E_WEIGHTS.items())})) AS prose_penalty FROM z)"""
PROSE_Q = f"{PROSE} SELECT doc_id, {', '.join(f'round({k}, 6) AS {k}' for k in [*E_WEIGHTS, 'prose_penalty'])} FROM prose"


# --- stock phrases ---------------------------------------------------------------------------------------------------
_W = r"[\p{L}\p{N}_]+"
_NOT_W = r"[^\p{L}\p{N}_\s\v\x1c-\x1f\x{85}\p{Z}]+"
_HEAD, _GAP = r"(?:^|\n|[.!?]\s+)", r"(?:[^\p{L}\p{N}_.!?][^.!?]*)?[.!?]\s+"
#: The two standard regexes with back-references, which RE2 lacks: a word three times or more in a row (runs in the list of words and
#: other signs), and three sentences that begin with the same word (a pattern for each word
#: that begins one; a mark before every full stop takes the place of the boundary after the third).
_THRICE = f"len(regexp_extract_all(array_to_string(list_transform(range(2, len(tk) + 1), lambda i: CASE WHEN tk[i] = tk[i - 1] AND regexp_matches(tk[i], '^{_W}') THEN '1' ELSE '0' END), ''), '1{{2,}}'))"
_STARTS = f"coalesce(list_sum(list_transform(list_filter(list_distinct(st), lambda x: len(list_filter(st, lambda y: y = x)) >= 3), lambda x: len(regexp_extract_all(marked, '{_HEAD}' || x || '{_GAP}' || x || '{_GAP}' || x || '(?:[^\\p{{L}}\\p{{N}}_]|$)')))), 0)"


def _hit_counts(literals, regexes) -> list[str]:
    counted = [f"(len(low) - len(replace(low, {q(s.lower())}, ''))) // {len(s)}" for s in literals]
    return counted + [_THRICE if r.startswith(r"\b(\w+)(?:\s+\1)") else _STARTS if r"\1" in r else n("t", r.replace(r"\u2014", "—"), "i") for r in regexes]


_SCANNED = f"""{BASE}, y AS (SELECT *, lower(t) AS low, regexp_extract_all(lower(t), '{_W}|{_NOT_W}') AS tk, regexp_extract_all(lower(t), '{_HEAD}({_W})', 1) AS st, regexp_replace(lower(t), '([.!?])', chr(1) || '\\1', 'g') AS marked FROM p)"""
_EXCESS = "greatest(0, hits / (greatest(len(w), 1) / 100.0) - 0.3)"


def lazy_table(literals, regexes) -> str:
    """doc_id, hits, excess of z."""
    return f"""{_SCANNED}, y1 AS (SELECT doc_id, w, {' + '.join(_hit_counts(literals, regexes)) or '0'} AS hits FROM y),
z AS (SELECT doc_id, hits, {_EXCESS} AS excess FROM y1)"""


def lazy_hits(literals, regexes) -> str:
    """With the list of hits, as pattern=n."""
    patterns = ", ".join(map(q, [*literals, *regexes]))
    return f"""{_SCANNED}, y1 AS (SELECT doc_id, w, [{', '.join(f'CAST({c} AS BIGINT)' for c in _hit_counts(literals, regexes))}] AS ns FROM y), y2 AS (SELECT *, list_sum(ns) AS hits FROM y1), z AS (SELECT *, {_EXCESS} AS excess FROM y2)
SELECT doc_id, round(CAST(1 - 1 / (1 + excess / 2) AS DOUBLE), 6) AS lazy_score, CAST(hits AS BIGINT) AS lazy_pattern_count,
  array_to_string(list_transform(list_filter(range(1, len(ns) + 1), lambda i: ns[i] > 0), lambda i: ([{patterns}])[i] || '=' || CAST(ns[i] AS VARCHAR)), ';') AS hits FROM z"""


def lazy_entries(literals, regexes) -> str:
    """source, pattern, n: a row for each pattern that a document has."""
    patterns = ", ".join(map(q, [*literals, *regexes]))
    return f"""{_SCANNED}, y1 AS (SELECT source, unnest([{patterns}]) AS pattern, unnest([{', '.join(f'CAST({c} AS BIGINT)' for c in _hit_counts(literals, regexes))}]) AS n FROM y)
SELECT * FROM y1 WHERE n > 0"""


def lazy(literals, regexes) -> str:
    return f"""{lazy_table(literals, regexes)} SELECT doc_id, round(CAST(1 - 1 / (1 + excess / 2) AS DOUBLE), 6) AS lazy_score, hits > 0 AS has_lazy_text, CAST(hits AS BIGINT) AS lazy_pattern_count FROM z"""


# --- linter ----------------------------------------------------------------------------------------------------------
def _line_runs(pattern: str, least: int) -> str:
    """Number of maximal runs of matching lines: the lines as a string of 1 and 0."""
    flags = f"array_to_string(list_transform({lines('t')}, lambda x: CASE WHEN regexp_matches(x, {q(pattern)}) THEN '1' ELSE '0' END), '')"
    return f"len(regexp_extract_all({flags}, '1{{{least},}}'))"


_COLONS = f"list_filter({lines('t')}, lambda x: NOT regexp_matches(x, '^\\s*#'))"
REUSE = f"""g AS (SELECT doc_id, list_filter(list_transform({words('t')}, lambda x: lower(regexp_replace(x, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g'))), lambda x: x <> '') AS w FROM d),
g1 AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram, len(list_filter(w[i : i + size - 1], lambda x: NOT list_contains([{', '.join(q(x) for x in L.REUSE_STOPWORDS)}], x))) > 0 AS good
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM g, (SELECT unnest(range(4, 9)) AS size) WHERE len(w) >= size)),
g2 AS (SELECT doc_id, size, gram, count(*) AS k, min(i) AS pos FROM g1 GROUP BY doc_id, size, gram HAVING count(*) >= 3 AND bool_and(good)),
g3 AS (SELECT * FROM g2 s WHERE NOT EXISTS (SELECT 1 FROM g2 o WHERE o.doc_id = s.doc_id AND (o.size > s.size OR (o.size = s.size AND o.pos < s.pos)) AND o.k >= s.k AND contains(o.gram, s.gram)))"""
REUSE_Q = f"""WITH {DOCS}, {REUSE} SELECT d.doc_id, CAST(count(g3.gram) AS BIGINT) AS n_phrases, coalesce(first(gram ORDER BY size DESC, k DESC, pos) FILTER (WHERE gram IS NOT NULL), '') AS top_phrase
FROM d LEFT JOIN g3 USING (doc_id) GROUP BY d.doc_id"""
_RULES = {
    "slop_words": n("t", L.word_pattern(), "i"),
    "slop_phrases": " + ".join([f"(len(lower(t)) - len(replace(lower(t), {q(p)}, ''))) // {len(p)}" for p in L.PHRASES] + [n("t", L.NOT_JUST_BUT, "i")]),
    "bold": f"CASE WHEN {n('t', L.BOLD_HEADER)} >= 3 THEN 1 ELSE 0 END",
    "bullet_runs": _line_runs(r"^(\s*[-*]\s|\s*\d+\.\s)", 6),
    "triadic": f"least(5, {n('t', f'{_W}, {_W}, and {_W}', 'i')})",
    "tone_phrases": " + ".join(n("t", p, "i") for p in L.META + L.FALSE_NARRATIVITY),
    "openers": " + ".join(n("t", p, "im") for p in L.OPENERS),
    "weasel": " + ".join(n("t", p, "i") for p in L.WEASEL),
    "ai_disclosure": " + ".join(n("t", p, "i") for p in L.DISCLOSURE),
    "placeholder": n("t", L.PLACEHOLDER, "i"),
    "rhythm": f"CASE WHEN len(ck) >= 5 AND list_sum(ck) > 0 AND {cv('ck')} < 0.3 THEN 1 ELSE 0 END",
    "em_dash": f"CASE WHEN len(w) > 0 AND {n('t', L.EM_DASH)} / len(w) * 150 > 1 THEN 1 ELSE 0 END",
    "contrast_pairs": f"least(5, {n('t', f'{_W}, not {_W}')})",
    "colon_density": f"CASE WHEN len(w) > 0 AND (list_sum(list_transform({_COLONS}, lambda x: {n('x', ': [a-z]')} - {n('x', 'https?: [a-z]')} - {n('x', ': (true|false|null)')}))) / len(w) * 150 > 1.5 THEN 1 ELSE 0 END",
    "pithy_fragment": f"len(list_filter(cs, lambda y: len({words('y')}) <= 6 AND regexp_matches(y, '(?i),{SP}+(but|yet|and|not|or)([^\\p{{L}}\\p{{N}}_]|$)')))",
    "setup_resolution": f"{n('t', L.SETUP_A, 'i')} + {n('t', L.SETUP_B, 'i')}",
    "bullet_density": f"CASE WHEN len(fl) > 0 AND len(list_filter(fl, lambda x: regexp_matches(x, '^\\s*([-*]|\\d+[.)])\\s'))) / len(fl) > 0.40 THEN 1 ELSE 0 END",
    "quotes": f"len(list_filter({lines('t')}, lambda x: starts_with(x, '>')))",
    "bold_bullet_list": _line_runs(r"^\s*([-*]|\d+[.)])\s+\*\*", 3),
    "horizontal_rules": f"CASE WHEN {n('t', L.RULE_LINE, 'm')} >= 4 THEN 1 ELSE 0 END",
}
LINT = f"""{BASE}, {REUSE},
li AS (SELECT *, list_filter({lines('t')}, lambda x: {strip('x')} <> '') AS fl, {parts('t', '[.!?]["' + chr(39) + '”’)' + chr(92) + ']]*(' + SP + '|$)')} AS cs FROM c),
lj AS (SELECT *, list_transform(cs, lambda y: len({words('y')})) AS ck FROM li),
ru AS (SELECT doc_id, len(w) AS wc, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in _RULES.items())} FROM lj),
re AS (SELECT ru.*, least(5, coalesce(m, 0)) AS phrase_reuse FROM ru LEFT JOIN (SELECT doc_id, count(*) AS m FROM g3 GROUP BY doc_id) USING (doc_id)),
ws AS (SELECT *, 2 * slop_words + 3 * slop_phrases + 5 * bold + 3 * bullet_runs + triadic + 3 * tone_phrases + 2 * openers + 2 * weasel + 10 * ai_disclosure + 5 * placeholder + 5 * rhythm + 3 * em_dash
  + contrast_pairs * (1 + 2.5 * greatest(0, contrast_pairs - 1)) + 3 * least(5, setup_resolution) * (1 + 2.5 * greatest(0, setup_resolution - 1)) + 3 * colon_density
  + 2 * least(3, pithy_fragment) * (1 + 2.5 * greatest(0, pithy_fragment - 1)) + 8 * bullet_density + CASE WHEN quotes >= 3 THEN 3 * least(quotes - 2, 4) ELSE 0 END + 5 * bold_bullet_list + 3 * horizontal_rules + phrase_reuse AS weighted FROM re),
lint AS (SELECT *, CASE WHEN wc < 10 THEN 100 ELSE greatest(0, least(100, CAST(round_even(100 * exp(-0.04 * CAST(weighted AS DOUBLE) / (wc / 1000.0)), 0) AS BIGINT))) END AS score FROM ws)"""
BAND = "CASE WHEN score >= 80 THEN 'clean' WHEN score >= 60 THEN 'light' WHEN score >= 40 THEN 'moderate' WHEN score >= 20 THEN 'heavy' ELSE 'saturated' END"
_ZERO = lambda e: f"CAST(CASE WHEN wc < 10 THEN 0 ELSE {e} END AS BIGINT)"
LINT_COUNTS = f"""{LINT} SELECT doc_id, {', '.join(f'{_ZERO(e)} AS {k}' for k, e in {
    **{k: k for k in L.COUNT_KEYS if k not in ('structural', 'tone', 'blockquote_density')}, 'structural': 'bold + bullet_runs + triadic', 'tone': 'tone_phrases + openers', 'blockquote_density': 'CASE WHEN quotes >= 3 THEN 1 ELSE 0 END'}.items())} FROM lint"""
LINT_SCORE = f"{LINT} SELECT doc_id, CAST(score AS BIGINT) AS score, {BAND} AS band, CAST(wc AS BIGINT) AS word_count, round(CASE WHEN wc < 10 THEN 0 ELSE CAST(weighted AS DOUBLE) END, 2) AS weighted_sum FROM lint"


#: Violations that are recorded.
_FOUND = " + ".join(k for k in _RULES if k not in ("setup_resolution", "pithy_fragment", "quotes")) + " + least(5, setup_resolution) + least(3, pithy_fragment) + CASE WHEN quotes >= 3 THEN 1 ELSE 0 END + phrase_reuse"


def _own(name: str, sql: str) -> str:
    return f"{name} AS ({sql})"


#: scored: every metric of every document with the standard patterns, and the parameters that reports derive from the id.
FULL = f"""WITH {', '.join([
    _own('qa', f'{BASE}, {REPETITION}, {CHEAP} SELECT * FROM cheap'),
    _own('qb', f'{PROSE} SELECT * FROM prose'),
    _own('qc', f'{lazy_table(STANDARD.literals, STANDARD.regexes)} SELECT doc_id, hits AS lazy_pattern_count, CAST(1 - 1 / (1 + excess / 2) AS DOUBLE) AS lazy_score FROM z'),
    _own('qd', f'{LINT} SELECT doc_id, score, CASE WHEN wc < 10 THEN 0 ELSE {_FOUND} END AS n_found FROM lint'),
])}, qe AS (SELECT *, CASE WHEN response_length > 0 THEN CAST(score AS DOUBLE) ELSE 50.0 END AS lint_score, CASE WHEN response_length > 0 THEN n_found ELSE 0 END AS lint_violations
  FROM qa JOIN qb USING (doc_id) JOIN qc USING (doc_id) JOIN qd USING (doc_id)),
scored AS (SELECT *, CASE WHEN response_length > 0 THEN (coherence_score * 0.25 + readability_score * 0.15 + (1 - lazy_score) * 0.40 + lint_score / 100.0 * 0.20) * (1 - repetition_penalty) * (1 - prose_penalty) ELSE 0 END AS quality_score,
  0.1 * (doc_id % 5) AS temperature, 0.05 * (doc_id % 3) AS min_p, 0.25 * (doc_id % 2) AS adaptive_target, doc_id % 10 <> 0 AS success FROM qe)"""


#: RE2's \w, \s and \b tell ASCII only, the queries' patterns tell all word characters and blanks. With a digit or a space in the place of every other
#: one (no pattern names either sort) both say the same.
_PLAIN = r"regexp_replace(regexp_replace(t, '[^\x00-\x7F\P{L}]|[\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]', '0', 'g'), '[\v\x{85}\p{Z}]', ' ', 'g')"


def unicode_classes(sql: str) -> str:
    """SQL whose patterns over whole texts have Unicode's word characters, boundaries and blanks."""
    return sql.replace("regexp_extract_all(t, ", f"regexp_extract_all({_PLAIN}, ")
