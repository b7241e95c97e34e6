"""Queries for text functions (I), mining (D9-D14, C5, C12), routing and search (J)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.payload import display_text, field, indexed_text, text_content
from tidemark.operators import mining, recent, routing, search
from tidemark.operators.ingest import stored_events, upsert_memories
from tidemark.plans.durable import checkpoint_dir, table
from tidemark.queries.base import ACTIVITY, BLOCKLIST, CLIPBOARD, MEMORIES, SAID, STORED, clock, once, stored
from tidemark.queries.oracles import oracles

SEARCH_COLUMNS = (*SAID, "window_title", "app_name")
SEARCHED = "(schedule OR budget OR prompt) AND re* NOT label"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _dictations(spark: SparkSession, folder: str) -> DataFrame:
    """Dictation-like pairs: a raw text in lower case with spaced names, and the text as written."""
    spaced = F.regexp_replace("text", r"([a-z])([A-Z])", "$1 $2")
    return _documents(spark, folder).where("text is not null").select("doc_id", F.lower(spaced).alias("raw"), F.col("text").alias("clean"))


def i1_payload_texts(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("payload")
    return stored(spark, folder, columns=SAID).select("event_id", indexed_text(p).alias("indexed"), display_text(p).alias("shown"), text_content(p).alias("content"))


def i4_camel_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).select("doc_id", F.explode(T.camel_words(F.col("text"), 6)).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def i5_acronyms(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select(F.explode(T.acronyms(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def i7_camel_phrases(spark: SparkSession, folder: str) -> DataFrame:
    words = _documents(spark, folder).select(F.explode(T.camel_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.camel_phrase(F.col("word")).alias("phrase")).where("phrase is not null")


def i11_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select(F.explode(T.keywords(F.col("text"), routing.STOP_WORDS)).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))


def i20_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", T.cleaned(F.col("text")).alias("clean"))


def i25_chatty(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", T.is_chatty(F.col("text")).alias("chatty"))


def i26_punctuated(spark: SparkSession, folder: str) -> DataFrame:
    said = F.regexp_replace(F.regexp_replace("text", r"\.", " period "), ",", " comma ")
    return _documents(spark, folder).select("doc_id", T.punctuated(said).alias("text"))


def i27_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", T.with_vocabulary(F.col("text"), {"dim": "Dimmer", "dim layout": "DimLayout", "budget": "Budget$", "the": "THE"}).alias("text"))


def i30_redacted(spark: SparkSession, folder: str) -> DataFrame:
    seen = once(spark, folder, "activity").select("id", T.redacted(F.col("ocr_text")).alias("text"))
    return seen.select("id", F.regexp_count("text", F.lit(r"\[REDACTED:")).alias("n")).where("n > 0")


def i31_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", T.prompt_of(T.camel_words(F.col("text"))).alias("prompt")).where("prompt <> ''")


def i34_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "clipboard").select("id", T.snippet(F.col("text"), 150).alias("snippet"), T.time_label(F.col("timestamp")).alias("at"))


def d9_terms(spark: SparkSession, folder: str) -> DataFrame:
    return mining.term_counts(_documents(spark, folder), F.concat(T.camel_words(F.col("text"), 6), T.dotted_names(F.col("text"))), 3)


def d9_clipped_terms(spark: SparkSession, folder: str) -> DataFrame:
    return mining.clipped_terms(once(spark, folder, "clipboard"))


def j13_hot_words(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    events = stored(spark, folder, now, now - 86_400, modality="sight", columns=SAID)
    return mining.hot_words(events, now, 86_400, 200)


def d11_corrections(spark: SparkSession, folder: str) -> DataFrame:
    # each text's last word with an "e" is misheard without it
    pairs = _dictations(spark, folder).select(F.regexp_replace(F.lower("clean"), r"(\w+)e(\w*)(\W*)\z", "$1$2$3").alias("raw"), F.lower("clean").alias("clean"))
    return mining.learned_corrections(mining.word_changes(pairs))


def d12_profile(spark: SparkSession, folder: str) -> DataFrame:
    return mining.profile(_dictations(spark, folder).select(F.regexp_replace("raw", r"\s+", " ").alias("raw")))


def d13_frequent_terms(spark: SparkSession, folder: str) -> DataFrame:
    return mining.frequent_terms(_documents(spark, folder).select("text"))


def d14_learned_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return mining.learned_phrases(_dictations(spark, folder))


def c5_cross_modal(spark: SparkSession, folder: str) -> DataFrame:
    return mining.cross_modal(stored(spark, folder, columns=SAID), 0.0, 600.0, 600.0, 0.5)


def c12_harvest(spark: SparkSession, folder: str) -> DataFrame:
    events, p = stored(spark, folder, columns=SAID), F.col("payload")
    screens = events.where("event_type = 'ocr_result'").select("event_id", "timestamp", field(p, "ocr_text").alias("text"))
    said = screens.select(F.concat(F.lit("said "), "event_id").alias("event_id"), "timestamp", F.regexp_replace("text", r"([a-z])([A-Z])", "$1 $2").alias("raw"))
    return mining.harvest_for(said, screens)


def i28_layers(spark: SparkSession, folder: str) -> DataFrame:
    layer = F.element_at(F.array(F.lit("user"), F.lit("learned"), F.lit("context")), (F.pmod(F.col("id"), F.lit(3)) + 1).cast("int"))
    rows = table(spark, folder, "memories").select(layer.alias("layer"), F.split("key", ":")[0].alias("key"), "value")
    return mining.layered(rows)


def c10_new_entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memories").select(F.when(F.col("attention_score") > 0.3, "user").otherwise("context").alias("layer"), F.split("key", ":")[0].alias("key"), "value")
    return mining.new_entries(rows.where("layer = 'context'").select("key", "value"), rows, 6)


def g8_extracted(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("payload")
    fixed = stored(spark, folder, columns=(*SAID, "monitor_index")).where("event_type = 'correction_detected'").select("event_id", "monitor_index", field(p, "original_word", "original_text").alias("o"), field(p, "corrected_word", "corrected_text").alias("c")).where("o <> '' and c <> ''")
    found = mining.extract_correction(F.concat(F.lit("please check the "), F.col("o")), F.col("c"), F.length("o"), F.coalesce(F.col("monitor_index") == 1, F.lit(False)))
    return fixed.select("event_id", found.alias("x")).where("x is not null").select("event_id", "x.original_word", "x.corrected_word", "x.correction_type")


def _projects(spark: SparkSession, folder: str) -> DataFrame:
    """A registry from the documents' own projects: their frequent terms as keywords."""
    named = _documents(spark, folder).where("project <> ''").select(F.trim("project").alias("name"), F.explode(T.camel_words(F.col("text"), 6)).alias("w"))
    return named.groupBy("name").agg(F.array_sort(F.collect_set(F.lower("w"))).alias("keywords")).withColumn("aliases", F.array(F.lower(F.regexp_replace("name", r"([a-z])([A-Z])", "$1 $2"))))


def i13_routed(spark: SparkSession, folder: str) -> DataFrame:
    return routing.routed(once(spark, folder, "clipboard").select("id", "text"), _projects(spark, folder), "id").select("id", "project", "matched")


def i14_best_project(spark: SparkSession, folder: str) -> DataFrame:
    return routing.best_project(once(spark, folder, "clipboard").select("id", "text"), _projects(spark, folder), "id").groupBy("project").agg(F.count("*").alias("n"))


def i15_active_project(spark: SparkSession, folder: str) -> DataFrame:
    known = [("Copper Lantern", []), ("Velvet Anchor", ["velvet"]), ("budget", ["ledger"])]
    shown = once(spark, folder, "activity").select("id", routing.active_project(F.concat(F.lit("/home/u/projects/"), F.lower("app_name"), F.lit("/src")), F.col("window_title"), "/home/u/projects", [*known, ("foldpane.exe", [])]).alias("a"))
    return shown.select("id", "a.project", "a.source")


def _searchable(events: DataFrame) -> DataFrame:
    return events.withColumn("text_content", indexed_text(F.col("payload")))


#: The stored indexes of this application: built at the first query, as the store would have at each write.
_indexes: dict[tuple, search.TextIndex] = {}


def _index(spark: SparkSession, folder: str, name: str, key: str, columns: list[str], rows: Callable[[], DataFrame], carried: tuple[str, ...] = (), stemming: bool = False) -> search.TextIndex:
    at = (spark.sparkContext.applicationId, folder, name)
    if at not in _indexes:
        index = search.TextIndex(spark, f"{checkpoint_dir(spark)}/tidemark-index-{name}-{uuid.uuid4().hex}", key, columns, carried, stemming)
        index.append(rows())
        _indexes[at] = index
    return _indexes[at]


def build_indexes(spark: SparkSession, folder: str) -> None:
    """Write the indexes that the search queries read, as a store has them before anybody searches."""
    for query in (j1_event_search, j2_activity_search, j3_memory_search):
        query(spark, folder)


def _event_index(spark: SparkSession, folder: str, stemming: bool = False) -> search.TextIndex:
    rows = lambda: _searchable(stored(spark, folder, columns=SEARCH_COLUMNS))
    return _index(spark, folder, f"events-{stemming}".lower(), "event_id", ["window_title", "app_name", "text_content"], rows, ("timestamp",), stemming)


def j1_event_search(spark: SparkSession, folder: str) -> DataFrame:
    found = _event_index(spark, folder).search(SEARCHED).where(F.col("timestamp") > clock(spark, folder) - 200_000)
    return search.best(found, 200, "event_id").select("event_id", F.round("score", 6).alias("score"))


def j1_stemmed_search(spark: SparkSession, folder: str) -> DataFrame:
    found = _event_index(spark, folder, True).search("scheduling OR meetings")
    return search.best(found, 500, "event_id").select("event_id", F.round("score", 6).alias("score"))


def j2_activity_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = lambda: once(spark, folder, "activity")
    found = _index(spark, folder, "activity", "id", ["window_title", "app_name", "ocr_text"], rows, ("timestamp",)).search('"the schedule" OR budg*')
    return recent.newest(found, 20, "timestamp", "id").select("id", "timestamp")


def _memories(spark: SparkSession, folder: str) -> DataFrame:
    return upsert_memories(table(spark, folder, "memories")).withColumn("tags_text", F.array_join("tags", " "))


def _vector(memories: DataFrame) -> list[float]:
    """The first usable vector by key."""
    row = memories.where("size(embedding) = 128 and not exists(embedding, x -> x is null or isnan(x)) and exists(embedding, x -> x <> 0)").orderBy("key").select("embedding").first()
    return list(row["embedding"]) if row else [0.0] * 128


def j3_memory_search(spark: SparkSession, folder: str) -> DataFrame:
    found = _index(spark, folder, "memories", "key", ["key", "value", "tags_text"], lambda: _memories(spark, folder)).search("schedule budget OR voice")
    return search.best(found, 20, "key").select("key", F.round("score", 6).alias("score"))


def j5_warm_cold(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators.summaries import cold_windows

    memories = _memories(spark, folder)
    return search.warm_then_cold(memories, cold_windows(memories), "schedule OR budget", 40)


def j6_semantic(spark: SparkSession, folder: str) -> DataFrame:
    memories = _memories(spark, folder)
    return search.semantic(memories, _vector(memories), clock(spark, folder)).select("key", "similarity")


def j7_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    memories = _memories(spark, folder)
    return search.hybrid(memories, "schedule OR budget", _vector(memories), clock(spark, folder))


def j9_search_view(spark: SparkSession, folder: str) -> DataFrame:
    top = F.broadcast(search.best(_event_index(spark, folder).search("meeting OR schedule"), 50, "event_id").select("event_id", "score"))
    raw = table(spark, folder, "spine_events").join(top, "event_id", "left_semi")
    found = _searchable(stored_events(raw, clock(spark, folder), columns=SEARCH_COLUMNS)).join(top, "event_id")
    shown = search.best(found.where(~recent.blocked(F.col("window_title"), BLOCKLIST)), 25, "event_id")
    return shown.select("event_id", T.snippet(F.coalesce("text_content", F.lit("")), 150).alias("snippet"))


def j10_timeline(spark: SparkSession, folder: str) -> DataFrame:
    now, p = clock(spark, folder), F.col("payload")
    top = recent.recent_events(stored(spark, folder, now, now - 7200, columns=(*SAID, "window_title")), now, 7200, limit=100)
    shown = top.where(~recent.blocked(F.col("window_title"), BLOCKLIST)).orderBy("timestamp", "event_id").limit(50)
    return shown.select("event_id", T.time_label(F.col("timestamp")).alias("at"), F.substring(F.coalesce("window_title", F.lit("")), 1, 50).alias("title"), field(p, "wpm", kind="double").alias("wpm"), field(p, "word_count", kind="double").alias("words"))


_NAMES = """i1_payload_texts i4_camel_words i5_acronyms i7_camel_phrases i11_keywords i20_cleaned i25_chatty i26_punctuated i27_vocabulary i30_redacted i31_prompts i34_snippets d9_terms d9_clipped_terms
j13_hot_words d11_corrections d12_profile d13_frequent_terms d14_learned_phrases c5_cross_modal c12_harvest i28_layers c10_new_entries g8_extracted i13_routed i14_best_project i15_active_project
j1_event_search j1_stemmed_search j2_activity_search j3_memory_search j5_warm_cold j6_semantic j7_hybrid j9_search_view j10_timeline"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_ACT, _CLIP, _MEM = STORED + ", " + ACTIVITY, STORED + ", " + CLIPBOARD, STORED + ", " + MEMORIES
_CAMEL = r"'\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b'"
_STOPS = ", ".join(f"'{w}'" for w in routing.STOP_WORDS)
_PHRASE = r"lower(trim(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')))"
_FOLD = f"translate(lower({{0}}), '{search.FOLD_FROM}', '{search.FOLD_TO}')"


def _words_sql(column: str) -> str:
    return rf"list_filter(regexp_split_to_array({_FOLD.format(f'coalesce({column}, {chr(39)}{chr(39)})')}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25_sql(source: str, key: str, columns: list[str], terms: dict[str, str], match: str) -> str:
    """CTE scored(key, score): terms maps a name to a condition on x; every column's words count."""
    words = " || ".join(_words_sql(c) for c in columns)
    counts = ", ".join(f"len(list_filter(ws, lambda x: {cond})) AS {name}" for name, cond in terms.items())
    stats = ", ".join(f"count(*) FILTER ({name} > 0) AS df_{name}" for name in terms)
    score = " + ".join(f"greatest(ln((n - df_{t} + 0.5) / (df_{t} + 0.5)), 1e-6) * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * dl / mean))" for t in terms)
    return f", held AS (SELECT *, {words} AS ws FROM {source}), counted AS (SELECT * EXCLUDE (ws), len(ws) AS dl, {counts} FROM held), stats AS (SELECT count(*) AS n, avg(dl) AS mean, {stats} FROM counted), scored AS (SELECT counted.*, {score} AS score FROM counted, stats WHERE {match}) "


_EVENTS = "(SELECT *, coalesce(p->>'$.ocr_text', p->>'$.transcript', p->>'$.text', '') AS text_content FROM stored)"
_COLUMNS = ["window_title", "app_name", "text_content"]
_VEC = ", q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM mem WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY key LIMIT 1)"
_SEM = _VEC + """, sem AS (SELECT key, round_even(list_dot_product(v, qv) / ((sqrt(list_dot_product(v, v)) + 1e-9) * (sqrt(list_dot_product(qv, qv)) + 1e-9)), 4) AS similarity
  FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM mem WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0), q, clock WHERE expires_at IS NULL OR expires_at > now)"""
_TAGGED = "(SELECT *, array_to_string(tags, ' ') AS tags_text FROM mem)"
ORACLES = {
    "i1_payload_texts": STORED + "SELECT event_id, coalesce(p->>'$.ocr_text', p->>'$.transcript', p->>'$.text', '') AS indexed, coalesce(nullif(p->>'$.ocr_text', ''), nullif(p->>'$.transcript', ''), nullif(p->>'$.text', ''), '') AS shown, concat_ws(' ', nullif(p->>'$.ocr_text', ''), nullif(p->>'$.transcript', ''), nullif(p->>'$.text', ''), nullif(p->>'$.burst_text', ''), nullif(p->>'$.correction_text', '')) AS content FROM stored",
    "i25_chatty": "SELECT doc_id, coalesce(regexp_matches(lower(text), '^(" + "|".join(s.lower().replace("'", "''") for s in T.CHATTY_STARTS) + ")') OR (contains(lower(text), 'voice dictation') AND contains(lower(text), 'clean up')), false) AS chatty FROM documents",
    "i34_snippets": _CLIP + r"SELECT id, regexp_replace(substr(text, 1, 150), '[\r\n]+', ' ', 'g') AS snippet, strftime(make_timestamp(CAST(floor(timestamp * 1000000) AS BIGINT)), '%H:%M:%S') AS at FROM clip",
    "d14_learned_phrases": rf"WITH d AS (SELECT regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g') AS raw, text AS clean FROM documents WHERE text IS NOT NULL), w AS (SELECT lower(raw) AS raw, unnest(regexp_extract_all(clean, {_CAMEL}, 1)) AS corrected FROM d WHERE clean <> '' AND lower(raw) <> clean), ph AS (SELECT *, {_PHRASE.format('corrected')} AS original FROM w) SELECT original, corrected, count(*) AS n, least(0.95, 0.5 + count(*) * 0.1) AS confidence FROM ph WHERE contains(original, ' ') AND length(original) >= 6 AND contains(raw, original) GROUP BY 1, 2 HAVING count(*) >= 2 AND len(list_filter(string_split(original, ' '), lambda x: x NOT IN ({', '.join(chr(39) + w + chr(39) for w in mining.COMMON_WORDS)}))) > 0",
    "i28_layers": "SELECT key, value, layer FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, value) AS nth FROM (SELECT lower(trim(split_part(key, ':', 1))) AS key, value, id % 3 AS rank, CASE id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'learned' ELSE 'context' END AS layer FROM memories) WHERE key <> '' AND value IS NOT NULL) WHERE nth = 1",
    "c10_new_entries": "WITH r AS (SELECT coalesce(attention_score > 0.3, false) AS u, split_part(key, ':', 1) AS key, value FROM memories) SELECT key, value FROM r WHERE NOT u AND trim(key) <> trim(value) AND length(trim(key)) >= 6 AND key NOT IN (SELECT key FROM r WHERE u)",
    "j1_event_search": STORED + _bm25_sql(_EVENTS, "event_id", _COLUMNS, {"a": "x = 'schedule'", "b": "x = 'budget'", "e": "x = 'prompt'", "c": "starts_with(x, 're')", "d": "x = 'label'"}, "(a > 0 OR b > 0 OR e > 0) AND c > 0 AND d = 0") + "SELECT event_id, round(score, 6) AS score FROM scored, clock WHERE timestamp > now - 200000 ORDER BY scored.score DESC, event_id LIMIT 200",
    "j3_memory_search": _MEM + _bm25_sql(_TAGGED, "key", ["key", "value", "tags_text"], {"a": "x = 'schedule'", "b": "x = 'budget'", "c": "x = 'voice'"}, "(a > 0 AND b > 0) OR c > 0") + "SELECT key, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, key LIMIT 20",
    "j6_semantic": _MEM + _SEM + " SELECT key, similarity FROM sem WHERE NOT isnan(similarity) ORDER BY similarity DESC, key LIMIT 20",
    "j7_hybrid": _MEM + _SEM + _bm25_sql(_TAGGED, "key", ["key", "value", "tags_text"], {"a": "x = 'schedule'", "b": "x = 'budget'"}, "a > 0 OR b > 0") + ", l1 AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM scored), l2 AS (SELECT key, row_number() OVER (ORDER BY similarity DESC, key) AS rank FROM sem WHERE NOT isnan(similarity)) SELECT key, round_even(sum(1.0 / (60 + rank)), 6) AS rrf_score FROM (SELECT * FROM l1 WHERE rank <= 60 UNION ALL SELECT * FROM l2 WHERE rank <= 60) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "j9_search_view": STORED + _bm25_sql(_EVENTS, "event_id", _COLUMNS, {"a": "x = 'meeting'", "b": "x = 'schedule'"}, "a > 0 OR b > 0") + r"SELECT event_id, regexp_replace(substr(text_content, 1, 150), '[\r\n]+', ' ', 'g') AS snippet FROM (SELECT * FROM scored ORDER BY score DESC, event_id LIMIT 50) WHERE NOT coalesce(contains(lower(window_title), 'schedule') OR contains(lower(window_title), 'budget'), false) ORDER BY score DESC, event_id LIMIT 25",
    "j10_timeline": STORED + "SELECT event_id, strftime(make_timestamp(CAST(floor(timestamp * 1000000) AS BIGINT)), '%H:%M:%S') AS at, substr(coalesce(window_title, ''), 1, 50) AS title, TRY_CAST(p->>'$.wpm' AS DOUBLE) AS wpm, TRY_CAST(p->>'$.word_count' AS DOUBLE) AS words FROM (SELECT * FROM stored, clock WHERE timestamp > now - 7200 ORDER BY timestamp DESC, event_id DESC LIMIT 100) WHERE NOT coalesce(contains(lower(window_title), 'schedule') OR contains(lower(window_title), 'budget'), false) ORDER BY timestamp, event_id LIMIT 50",
}
ORACLES |= oracles(_FOLD)
_SECRETS_SQL = "ocr_text"
for _pattern, _instead in T.SECRETS:
    _SECRETS_SQL = f"regexp_replace({_SECRETS_SQL}, '{_pattern}', '{_instead}', 'g')"
_ACRONYMS = ", ".join(f"'{w}'" for w in T.COMMON_ACRONYMS)
_TERM = rf"SELECT unnest(list_concat(list_filter(regexp_extract_all(text, {_CAMEL}, 1), lambda x: length(x) >= 6), regexp_extract_all(text, '\b([A-Z][a-z]+\.[a-z]{{1,4}})\b', 1))) AS term"
_SPACED = f"CASE WHEN contains({_PHRASE.format('term')}, ' ') AND length({_PHRASE.format('term')}) >= 6 THEN {_PHRASE.format('term')} ELSE lower(term) END AS phrase"
ORACLES |= {
    "i4_camel_words": f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_CAMEL}, 1)) AS word FROM documents) WHERE length(word) >= 6 GROUP BY 1",
    "i5_acronyms": rf"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b([A-Z]{{2,6}})\b', 1)) AS word FROM documents) WHERE word NOT IN ({_ACRONYMS}) GROUP BY 1",
    "i7_camel_phrases": f"SELECT DISTINCT word, {_PHRASE.format('word')} AS phrase FROM (SELECT unnest(regexp_extract_all(text, {_CAMEL}, 1)) AS word FROM documents) WHERE contains({_PHRASE.format('word')}, ' ') AND length({_PHRASE.format('word')}) >= 6",
    "i15_active_project": _ACT + """SELECT id, coalesce(f, t) AS project, CASE WHEN f IS NOT NULL THEN 'cwd' WHEN t IS NOT NULL THEN 'title' END AS source FROM (SELECT id, CASE WHEN split_part(lower(app_name), '/', 1) IN ('Copper Lantern', 'Velvet Anchor', 'budget', 'foldpane.exe') THEN split_part(lower(app_name), '/', 1) END AS f,
      CASE WHEN contains(lower(window_title), 'copper lantern') THEN 'Copper Lantern' WHEN contains(lower(window_title), 'velvet') THEN 'Velvet Anchor' WHEN contains(lower(window_title), 'budget') OR contains(lower(window_title), 'ledger') THEN 'budget' WHEN contains(lower(window_title), 'foldpane.exe') THEN 'foldpane.exe' END AS t FROM act)""",
    "i30_redacted": _ACT + f"SELECT id, (length(t) - length(replace(t, '[REDACTED:', ''))) // 10 AS n FROM (SELECT id, {_SECRETS_SQL} AS t FROM act) WHERE contains(t, '[REDACTED:')",
    "d9_terms": f"WITH t AS ({_TERM} FROM documents) SELECT term, {_SPACED}, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 3",
    "d9_clipped_terms": _CLIP + rf", t AS (SELECT unnest(list_filter(regexp_extract_all(text, {_CAMEL}, 1), lambda x: length(x) >= 6)) AS term FROM clip WHERE length(text) <= 200 AND NOT regexp_matches(text, '{mining.LINK_OR_PATH}')) SELECT term, {_SPACED}, count(*) AS n FROM t GROUP BY 1",
    "d12_profile": r"SELECT count(*) AS dictations, avg(CASE WHEN raw <> '' THEN len(list_filter(regexp_split_to_array(raw, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) END) AS mean_words FROM (SELECT regexp_replace(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), '[ \t\n\x0b\f\r]+', ' ', 'g') AS raw FROM documents WHERE text IS NOT NULL)",
    "j13_hot_words": STORED + rf", top AS (SELECT * FROM stored, clock WHERE timestamp > now - 86400 AND modality = 'sight' AND event_type = 'ocr_result' ORDER BY timestamp DESC, event_id DESC LIMIT 200), s AS (SELECT p->>'$.ocr_text' AS text FROM top WHERE TRY_CAST(p->>'$.ocr_confidence' AS DOUBLE) >= 0.75), t AS (SELECT unnest(list_concat(list_filter(regexp_extract_all(text, {_CAMEL}, 1), lambda x: length(x) >= 6), list_filter(regexp_extract_all(text, '\b([A-Z]{{2,6}})\b', 1), lambda x: x NOT IN ({_ACRONYMS})))) AS term FROM s WHERE text <> '') SELECT term, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, term LIMIT 50",
}
