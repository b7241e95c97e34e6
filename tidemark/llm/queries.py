"""Queries of the problems tagged llm, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import runs
from tidemark.llm.encode import encode_corpus
from tidemark.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from tidemark.llm.neighbours import similar_vectors
from tidemark.llm.packing import pack_documents
from tidemark.llm.personal import personal_kinds, redacted_texts, revealing_terms
from tidemark.llm.runs import window_runs
from tidemark.llm.truncation import truncated, truncation_by_source
from tidemark.plans.durable import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, folder, "activity"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(table(spark, folder, "activity"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return window_runs(table(spark, folder, "activity")).where("n_captures >= 2").select("monitor_index", "first_id", "last_id")


def p2_runs(spark: SparkSession, folder: str) -> DataFrame:
    return window_runs(table(spark, folder, "activity"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = similar_vectors(table(spark, folder, "memories"))
    return near.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors(table(spark, folder, "memories")).withColumn("cosine", F.round("cosine", 6))


def _private_texts(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {"activity": (table(spark, folder, "activity"), "id", "ocr_text"), "clipboard": (table(spark, folder, "clipboard"), "id", "text")}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_kinds(_private_texts(spark, folder), table(spark, folder, "known_names"))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted_texts(_private_texts(spark, folder), table(spark, folder, "known_names"))


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    return revealing_terms(_private_texts(spark, folder), table(spark, folder, "known_names"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents")).select("doc_id", "ids")


def p7_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), table(spark, folder, "prompt_windows"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(table(spark, folder, "documents"))


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_by_source(table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_runs": p2_runs, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_redacted": p5_redacted, "p5_terms": p5_terms, "p6_ids": p6_ids, "p7_prompts": p7_prompts, "p8_found": p8_found, "p8_sources": p8_sources}
_NEAREST = """WITH once AS (SELECT id, arg_max(embedding, updated_at) AS embedding FROM memories WHERE id IS NOT NULL GROUP BY id),
v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM once WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
pairs AS (SELECT a.id, b.id AS neighbour_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 12) AS cosine FROM u a JOIN u b ON a.id <> b.id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour_id) AS rank FROM pairs) WHERE rank <= 5)
"""
_BAGS = r"""WITH RECURSIVE once AS (SELECT id, max(ocr_text) AS t FROM activity WHERE id IS NOT NULL AND ocr_text IS NOT NULL GROUP BY id),
w AS (SELECT id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM once), n AS (SELECT id, count(*) AS n, string_agg(w, ' ' ORDER BY w) AS bag FROM w GROUP BY id HAVING count(*) >= 20),
cls AS (SELECT bag, min(id) AS rep, any_value(n) AS n FROM n GROUP BY bag), c AS (SELECT id, w, count(*) AS k FROM w WHERE id IN (SELECT rep FROM cls) GROUP BY id, w),
o AS (SELECT x.id AS a, y.id AS b, sum(least(x.k, y.k)) AS o FROM c x JOIN c y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN cls p ON p.rep = a JOIN cls q ON q.rep = b WHERE o >= 0.6 * (p.n + q.n - o) - 1e-9),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT rep AS id, rep AS other FROM cls UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON both_.a = reach.other)
SELECT n.id, rep AS class_id, g.group_id, coalesce(d.n_links, 0) AS n_links FROM n JOIN cls USING (bag) JOIN (SELECT id, min(other) AS group_id FROM reach GROUP BY id) g ON g.id = rep LEFT JOIN (SELECT a, count(*) AS n_links FROM both_ GROUP BY a) d ON d.a = rep"""


def _runs_sql() -> str:
    """Gaps and islands over the captures of a monitor; RE2 has no look-ahead, so what follows is matched and put back."""
    wide = r"[\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    title = f"regexp_replace(lower(window_title), '{wide}+', ' ', 'g')"
    part = runs.OWN_PART.replace(r"(?=\s+[-–—|]\s|\s*$)", r"(\s+[-–—|]\s|\s*$)")
    ending = runs.ENDING.replace(r"(?=\s*(?:[-–—|]\s|$))", r"(\s*(?:[-–—|]\s|$))")
    for pattern, instead in ((runs.BRACKETED, " "), (part, r"\1"), (part, r"\1"), (runs.LEADING, ""), (ending, r"\1"), (ending, r"\1"), (r"\s+", " ")):
        title = f"regexp_replace({title}, '{pattern}', '{instead}', 'g')"
    trim = lambda c: f"regexp_replace(regexp_replace({c}, '^{wide}+', ''), '{wide}+$', '')"
    return f"""WITH once AS (SELECT DISTINCT id, monitor_index, CAST(round(timestamp * 1e6) AS BIGINT) AS us, coalesce({trim(f"regexp_replace({trim('lower(app_name)')}, '[.]exe$', '')")}, '') AS app_name, coalesce({trim(title)}, '') AS subject
 FROM activity WHERE id IS NOT NULL AND timestamp > 0 AND timestamp < 1e11),
marked AS (SELECT *, coalesce(lag(app_name) OVER w = app_name AND lag(subject) OVER w = subject AND us - lag(us) OVER w <= 600000000, false) AS goes_on FROM once WINDOW w AS (PARTITION BY monitor_index ORDER BY us, id)),
numbered AS (SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY monitor_index ORDER BY us, id) AS run FROM marked),
runs AS (SELECT monitor_index, any_value(app_name) AS app_name, any_value(subject) AS subject, arg_min(id, (us, id)) AS first_id, arg_max(id, (us, id)) AS last_id, min(us) / 1e6 AS start_time, max(us) / 1e6 AS end_time, (max(us) - min(us)) / 1e6 AS duration_seconds, count(*) AS n_captures FROM numbered GROUP BY monitor_index, run)
"""


ORACLES: dict[str, str] = {
    "p1_groups": _BAGS,
    "p2_found": _runs_sql() + "SELECT monitor_index, first_id, last_id FROM runs WHERE n_captures >= 2",
    "p2_runs": _runs_sql() + "SELECT * FROM runs",
    "p1_found": r"""WITH once AS (SELECT id, max(ocr_text) AS t FROM activity WHERE id IS NOT NULL AND ocr_text IS NOT NULL GROUP BY id),
w AS (SELECT id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM once), n AS (SELECT id, count(*) AS n FROM w GROUP BY id HAVING count(*) >= 20),
c AS (SELECT id, w, count(*) AS k FROM w WHERE id IN (SELECT id FROM n) GROUP BY id, w),
o AS (SELECT x.id AS id_a, y.id AS id_b, sum(least(x.k, y.k)) AS o FROM c x JOIN c y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2)
SELECT id_a, id_b FROM o JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE o >= 0.6 * (a.n + b.n - o) - 1e-9""",
    "p4_found": _NEAREST + "SELECT DISTINCT least(id, neighbour_id) AS id_a, greatest(id, neighbour_id) AS id_b FROM near",
    "p4_neighbours": _NEAREST + "SELECT id, neighbour_id, rank, round(cosine, 6) AS cosine FROM near",
}
