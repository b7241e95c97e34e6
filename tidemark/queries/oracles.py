"""SQL of the text, mining and rule queries that takes more than a line."""

from __future__ import annotations

from tidemark.functions import text as T
from tidemark.operators import routing
from tidemark.queries.base import ACTIVITY, CLIPBOARD, MEMORIES, STORED

_CLIP, _ACT, _MEM = STORED + ", " + CLIPBOARD, STORED + ", " + ACTIVITY, STORED + ", " + MEMORIES
_CAMEL = r"'\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b'"
_PHRASE = r"lower(trim(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')))"
_BLANK = r"[ \t\n\x0b\f\r]"
#: All blanks of Unicode.
_WIDE = r"[\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Letters, digits and marks beyond ASCII: no word begins or ends beside them.
_OTHER_LETTER = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]|[^\x00-\x7F\P{M}]"


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _replaced(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, instead in steps:
        column = f"regexp_replace({column}, '{pattern}', '{instead}', 'g')"
    return column


def debounced_sql(source: str, group: str, key: str, gap: float) -> str:
    """CTEs s, succ and acc of a recursive query: each accepted row finds the next one."""
    return f"""s AS MATERIALIZED (SELECT {group} AS g, timestamp AS t, min({key}) AS k FROM {source} WHERE timestamp IS NOT NULL AND NOT isnan(timestamp) AND {group} IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2),
 succ AS MATERIALIZED (SELECT a.g, a.t, b.t AS next_t, b.k AS next_k FROM s a ASOF JOIN s b ON a.g = b.g AND a.t + {gap} <= b.t),
 acc AS (SELECT g, min(t) AS t, arg_min(k, t) AS k FROM s GROUP BY g UNION ALL SELECT acc.g, next_t, next_k FROM acc JOIN succ ON acc.g = succ.g AND acc.t = succ.t)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_FIXES = "lower(trim(coalesce(p->>'$.original_word', p->>'$.original_text'))) AS original, trim(coalesce(p->>'$.corrected_word', p->>'$.corrected_text')) AS corrected"
_STRIP = "regexp_replace(regexp_replace({0}, '^[.,!?]+', ''), '[.,!?]+$', '')"


def _letters(word: str) -> str:
    return f"list_distinct(list_filter(string_split(lower({word}), ''), lambda c: c <> ''))"


def _overlap(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({_letters(a)}, {_letters(b)})) / nullif(greatest(len({_letters(a)}), len({_letters(b)})), 0), 0.0)"


_PUNCTUATED = _replaced(
    r"regexp_replace(regexp_replace(text, '\.', ' period ', 'g'), ',', ' comma ', 'g')",
    [(rf"(?i)[,;:.!?{_BLANK[1:]}*\b{word}\b[,;:.!?]*", sign) for word, sign in sorted(T.PUNCTUATION.items(), key=lambda x: -len(x[0]))],
)
_PUNCTUATED = f"replace({_PUNCTUATED}, '...', chr(1))"
_PUNCTUATED = _replaced(_PUNCTUATED, [(r"[,;]+([.!?:;\n])", r"\1"), (r"([!?])[.,]+", r"\1"), (r"\.([!?])", r"\1"), (r"([.!?])[.,;:]+", r"\1"), (r"([.!?:;,]) +([.!?:;,])", r"\2")])
_PUNCTUATED = f"replace({_PUNCTUATED}, chr(1), '...')"
_PUNCTUATED = _replaced(_PUNCTUATED, [(r"([.!?:;,])([A-Za-z])", r"\1 \2"), (r"(\() ", r"\1"), (_BLANK + "+$", ""), (r"^ +", ""), (r"\n ", "\n")])

_BAGS = rf"""bag AS (SELECT doc_id, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM (
   SELECT doc_id, 0 AS side, unnest(list_filter(regexp_split_to_array(raw, '{_WIDE}+'), lambda x: x <> '')) AS w FROM d
   UNION ALL SELECT doc_id, 1, unnest(list_filter(regexp_split_to_array(clean, '{_WIDE}+'), lambda x: x <> '')) FROM d) GROUP BY 1, 2),
 one AS (SELECT doc_id, arg_max(w, a - b) AS raw_word, arg_max(w, b - a) AS clean_word, sum(a) AS n, sum(b) AS m FROM bag GROUP BY 1 HAVING sum(greatest(a - b, 0)) = 1 AND sum(greatest(b - a, 0)) = 1),
 plain AS (SELECT *, {_STRIP.format('raw_word')} AS r, {_STRIP.format('clean_word')} AS c FROM one WHERE NOT (n > 3 AND m > 3 AND NOT m BETWEEN 0.7 * n AND 1.3 * n)),
 real_ AS (SELECT * FROM plain WHERE r NOT IN ({_quoted(T.STYLE_WORDS)}) AND c NOT IN ({_quoted(T.STYLE_WORDS)}) AND r <> c AND length(r) > 1 AND length(c) > 1 AND length(r) <= 3.0 * length(c) AND length(r) >= 0.33 * length(c)),
 counts AS (SELECT raw_word, clean_word, count(*) AS n FROM real_ GROUP BY 1, 2)"""

_ROUTED = f"""projects AS (SELECT name, list_distinct(list(lower(w))) AS keywords, lower(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g')) AS alias FROM (SELECT trim(project) AS name, unnest(list_filter(regexp_extract_all(text, {_CAMEL}, 1), lambda x: length(x) >= 6)) AS w FROM documents WHERE project <> '') GROUP BY name),
 low AS (SELECT id, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '{T.KEYWORD}')) AS words FROM clip WHERE text IS NOT NULL AND id IS NOT NULL),
 scored AS (SELECT id, name, len(list_intersect(words, keywords)) + hn + ha AS matched, 5 * hn + 4 * ha AS bonus, greatest(len(keywords), 1) AS n FROM (SELECT *, contains(low, lower(name))::INT AS hn, contains(low, alias)::INT AS ha FROM low, projects)),
 best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY matched + bonus + matched / n DESC, name) AS nth FROM scored WHERE matched > 0)"""


def _words(column: str, fold: str) -> str:
    return rf"list_filter(regexp_split_to_array({fold.format(f'coalesce({column}, {chr(39)}{chr(39)})')}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def oracles(fold: str) -> dict[str, str]:
    """``fold`` is the SQL that folds a text for search."""
    columns = {c: _words(c, fold) for c in ("window_title", "app_name", "ocr_text")}
    phrase = " OR ".join(f"contains(' ' || array_to_string({w}, ' ') || ' ', ' the schedule ')" for w in columns.values())
    prefix = " OR ".join(f"len(list_filter({w}, lambda x: starts_with(x, 'budg'))) > 0" for w in columns.values())
    held = {c: _words(c, fold) for c in ("key", "value", "tags_text")}
    words = " || ".join(held.values())
    bm25 = " + ".join(f"greatest(ln((n - df_{t} + 0.5) / (df_{t} + 0.5)), 1e-6) * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * dl / mean))" for t in "ab")
    cold_words = _words("text_content", fold)
    return {
        "g3_debounced": _recursive(STORED) + ", " + debounced_sql("stored", "modality", "event_id", 20) + " SELECT k AS event_id, g AS modality FROM acc",
        "g4_stored_clips": _recursive(_CLIP) + ", looked AS (SELECT *, 0 AS g FROM clip WHERE text <> ''), " + debounced_sql("looked", "g", "id", 60)
        + rf""", trimmed AS (SELECT id, timestamp, regexp_replace(regexp_replace(text, '^{_WIDE}+', ''), '{_WIDE}+$', '') AS text FROM looked WHERE id IN (SELECT k FROM acc)),
          kept AS (SELECT *, lag(text) OVER (ORDER BY timestamp, id) AS b FROM trimmed WHERE length(text) >= 5)
          SELECT id, timestamp, CASE WHEN length(text) > 10000 THEN substr(text, 1, 10000) || chr(10) || '[truncated]' ELSE text END AS text FROM kept WHERE b IS DISTINCT FROM text""",
        "i11_keywords": f"SELECT word, count(*) AS docs FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(text), '{_OTHER_LETTER}', 'X', 'g'), '{T.KEYWORD}'), lambda x: length(x) >= 4 AND x NOT IN ({_quoted(routing.STOP_WORDS)})))) AS word FROM documents) GROUP BY 1",
        "i26_punctuated": f"SELECT doc_id, {_PUNCTUATED} AS text FROM documents",
        "i27_vocabulary": r"SELECT doc_id, " + _replaced("text", [(r"(?i)\bdim layout\b", "DimLayout"), (r"(?i)\bbudget\b", "Budget$"), (r"(?i)\bdim\b", "Dimmer"), (r"(?i)\bthe\b", "THE")]) + " AS text FROM documents",
        "i31_prompts": f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, {_CAMEL}, 1) AS ws FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i) AS ws FROM w),
          j AS (SELECT doc_id, array_to_string(ws, ', ') AS joined, substr(array_to_string(ws, ', '), 1, 200) AS cut FROM f)
          SELECT doc_id, CASE WHEN length(joined) <= 200 THEN joined WHEN contains(cut, ', ') THEN substr(cut, 1, length(cut) - instr(reverse(cut), ' ,') - 1) ELSE cut END AS prompt FROM j WHERE joined <> ''""",
        "d11_corrections": r"WITH d AS (SELECT doc_id, lower(text) AS clean, regexp_replace(lower(text), '(\w+)e(\w*)(\W*)\z', '\1\2\3') AS raw FROM documents WHERE text <> ''), "
        + _BAGS + ", best AS (SELECT raw_word, max(n) AS n, sum(n) AS total FROM counts GROUP BY 1) SELECT c.raw_word, min(c.clean_word) AS clean_word, c.n, c.n / total AS confidence FROM counts c JOIN best b ON b.raw_word = c.raw_word AND b.n = c.n WHERE c.n >= 3 AND c.n / total >= 0.7 GROUP BY c.raw_word, c.n, total",
        "d13_frequent_terms": rf"""WITH w AS (SELECT list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') AS w FROM documents WHERE text <> ''),
          nouns AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(w[2:], lambda x: regexp_replace(regexp_replace(x, '^[.,!?;:''"]+', ''), '[.,!?;:''"]+$', ''))) AS term FROM w) WHERE length(term) > 2 AND regexp_matches(term, '^\p{{Lu}}') AND upper(term) <> term GROUP BY 1 HAVING count(*) >= 3),
          l AS (SELECT list_transform(w, lambda x: regexp_replace(regexp_replace(lower(x), '^[.,!?]+', ''), '[.,!?]+$', '')) AS l FROM w),
          pairs AS (SELECT * FROM (SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(list_zip(l[:-2], l[2:]), lambda z: z[1] || ' ' || z[2])) AS term FROM l WHERE len(l) > 1) WHERE length(term) > 5 GROUP BY 1 ORDER BY n DESC, term LIMIT 50) WHERE n >= 5)
          SELECT * FROM (SELECT * FROM pairs UNION ALL SELECT * FROM nouns WHERE term NOT IN (SELECT term FROM pairs)) ORDER BY n DESC, term LIMIT 50""",
        "c5_cross_modal": STORED + f""", said AS (SELECT event_id, timestamp FROM stored WHERE modality = 'voice' AND event_type = 'transcription'),
          fixed AS (SELECT event_id, timestamp, {_FIXES} FROM stored WHERE modality = 'keys' AND event_type = 'correction_detected'),
          seen AS (SELECT timestamp, unnest(list_distinct(regexp_extract_all(p->>'$.ocr_text', {_CAMEL}, 1))) AS name FROM stored WHERE modality = 'sight' AND event_type = 'ocr_result' AND TRY_CAST(p->>'$.ocr_confidence' AS DOUBLE) >= 0.5),
          names AS (SELECT said.event_id, list(DISTINCT name) AS names FROM said JOIN seen ON seen.timestamp > said.timestamp - 600 AND seen.timestamp < said.timestamp + 600 GROUP BY 1),
          both_ AS (SELECT said.event_id AS transcription, fixed.event_id AS correction, original, corrected, list_contains(names, corrected) AS exact, len(list_filter(names, lambda x: contains(lower(x), lower(corrected)))) > 0 AS part FROM said JOIN fixed ON fixed.timestamp > said.timestamp AND fixed.timestamp < said.timestamp + 600 JOIN names ON names.event_id = said.event_id WHERE original <> '' AND corrected <> '')
          SELECT transcription, correction, original, corrected, CASE WHEN exact THEN 0.95 ELSE 0.80 END AS confidence, CASE WHEN exact THEN 'cross_modal_screen_verified' ELSE 'cross_modal_app_context' END AS source FROM both_ WHERE exact OR part""",
        "c12_harvest": STORED + rf""", screens AS (SELECT event_id, timestamp, p->>'$.ocr_text' AS text FROM stored WHERE event_type = 'ocr_result'), words AS (SELECT timestamp, unnest(list_filter(list_distinct(regexp_extract_all(text, {_CAMEL}, 1)), lambda x: length(x) >= 6)) AS term FROM screens),
          ph AS (SELECT *, {_PHRASE.format('term')} AS phrase FROM words)
          SELECT DISTINCT 'said ' || s.event_id AS event_id, phrase, term FROM screens s JOIN ph ON ph.timestamp > s.timestamp - 60 AND ph.timestamp < s.timestamp + 60 WHERE contains(phrase, ' ') AND length(phrase) >= 6 AND contains(lower(regexp_replace(s.text, '([a-z])([A-Z])', '\1 \2', 'g')), phrase)""",
        "g8_extracted": STORED + rf""", x AS (SELECT event_id, coalesce(monitor_index = 1, false) AS selected, coalesce(p->>'$.original_word', p->>'$.original_text') AS o, coalesce(p->>'$.corrected_word', p->>'$.corrected_text') AS c FROM stored WHERE event_type = 'correction_detected'),
          y AS (SELECT *, lower('please check the ' || o) AS low, regexp_replace(regexp_replace(lower(trim(c)), '^[.,!? ]+', ''), '[.,!? ]+$', '') AS new FROM x WHERE o <> '' AND c <> ''),
          z AS (SELECT *, lower(trim(substr('please check the ' || o, length('please check the ') + 1))) AS gone, list_filter(list_transform(regexp_split_to_array(low, '{_BLANK}+'), lambda w: regexp_replace(regexp_replace(w, '^[.,!? ]+', ''), '[.,!? ]+$', '')), lambda w: length(w) > 1 AND w <> new AND {_overlap('w', 'new')} > 0.3)[1] AS word FROM y),
          f AS (SELECT event_id, CASE WHEN selected THEN word ELSE gone END AS original_word, new AS corrected_word, CASE WHEN selected THEN 'select_replace' ELSE 'backspace_retype' END AS correction_type, CASE WHEN selected THEN least(0.9, 0.5 + {_overlap('word', 'new')}) ELSE 0.8 END AS confidence FROM z
            WHERE (selected AND len(string_split(new, ' ')) <= 3 AND word IS NOT NULL AND new <> '') OR (NOT selected AND gone <> '' AND NOT contains(gone, ' ') AND new <> '' AND NOT contains(new, ' ') AND gone <> new))
          SELECT event_id, original_word, corrected_word, correction_type FROM f WHERE confidence >= 0.7""",
        "i13_routed": _CLIP + ", " + _ROUTED + " SELECT id, name AS project, matched FROM best WHERE nth <= 3",
        "i14_best_project": _CLIP + ", " + _ROUTED + " SELECT name AS project, count(*) AS n FROM best WHERE nth = 1 GROUP BY 1",
        "j2_activity_search": _ACT + f" SELECT id, timestamp FROM act WHERE {phrase} OR {prefix} ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 20",
        "j5_warm_cold": _MEM + f""", held AS (SELECT key, {words} AS ws FROM (SELECT *, array_to_string(tags, ' ') AS tags_text FROM mem)), counted AS (SELECT key, len(ws) AS dl, len(list_filter(ws, lambda x: x = 'schedule')) AS a, len(list_filter(ws, lambda x: x = 'budget')) AS b FROM held),
          stats AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (a > 0) AS df_a, count(*) FILTER (b > 0) AS df_b FROM counted),
          warm AS (SELECT key, 'warm' AS tier, 0 AS place, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (SELECT key, {bm25} AS score FROM counted, stats WHERE a > 0 OR b > 0) QUALIFY rank <= 40),
          lines AS (SELECT CAST(floor(updated_at / 900) * 900 AS DOUBLE) AS window_start, updated_at, id, CASE WHEN coalesce(key, '') <> '' AND coalesce(value, '') <> '' THEN key || chr(10) || value ELSE coalesce(nullif(key, ''), value, '') END AS line FROM mem WHERE updated_at IS NOT NULL),
          cold AS (SELECT window_start, string_agg(line, chr(10) ORDER BY updated_at, id) FILTER (line <> '') AS text_content FROM lines GROUP BY 1),
          found AS (SELECT CAST(CAST(window_start AS BIGINT) AS VARCHAR) AS key, 'cold' AS tier, 1 AS place, row_number() OVER (ORDER BY window_start DESC) AS rank FROM cold WHERE len(list_filter({cold_words}, lambda x: x IN ('schedule', 'budget'))) > 0 QUALIFY rank <= 40)
          SELECT key, tier FROM (SELECT * FROM warm UNION ALL SELECT * FROM found) ORDER BY place, rank LIMIT 40""",
    }
