"""Text-to-project routing over a project registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Words too common to route by.
STOP_WORDS = (
    "about above added after also been before being between both build built called came caused check cloud config could current data does each even every field file first flow follow from full "
    "getting global going have here hold http https info into just know last like look make many model more most much needed never next note only open other over path runs same setup ship show "
    "some spec still such take than that them then they this tool type under used uses using vars very want well were what when where which will with work works would your base based basic browser "
    "capture chat code cost email local platform product release request rules script service system text user admin backend"
).split()
NAME_BONUS, ALIAS_BONUS = 5, 4


def parsed_projects(files: DataFrame) -> DataFrame:
    """(name, overview, goals, tech_stack, keywords, aliases, raw_text) of Markdown files (name, value)."""
    raw = F.regexp_replace("value", "\r\n", "\n")
    overview = F.split(T.section(raw, "Overview"), "\n\n")[0]
    goals, stack = T.bullets(T.section(raw, "Goals")), T.bullets(T.section(raw, "Tech Stack"))
    names = F.filter(T.aliases(raw), lambda a: F.lower(a) != F.lower("name"))
    first = lambda xs: F.transform(xs, lambda g: F.split(g, r"\.")[0])
    flat = lambda xs, fn: F.flatten(F.transform(xs, fn))
    words = F.array_distinct(
        F.concat(T.camel_parts(F.col("name")), flat(stack, lambda s: T.keywords(s, STOP_WORDS, 3)), flat(first(goals), lambda g: T.keywords(g, STOP_WORDS)), T.domains(raw), flat(names, T.camel_parts), T.keywords(overview, STOP_WORDS))
    )
    return files.select("name", overview.alias("overview"), goals.alias("goals"), stack.alias("tech_stack"), words.alias("keywords"), names.alias("aliases"), F.col("value").alias("raw_text"))


def routed(texts: DataFrame, projects: DataFrame, key: str, top: int = 3) -> DataFrame:
    """(key, project, score, matched): the best projects for each text.

    Words meet keywords by an equi-join; names and aliases, of which a registry has few for each
    project, are looked for inside the text. Raw score: matched keywords + 5 for the name + 4 for the first
    alias in the text, where name and alias count as matched too; plus the matched share of the
    project's keywords. Scores are divided by the text's best and rounded to three places; ties by name.
    The registry is small by nature (a row for each project of a user) and its size is checked before it is broadcast.
    """
    if projects.limit(MAX_PROJECTS + 1).count() > MAX_PROJECTS:
        raise ValueError(f"a registry has at most {MAX_PROJECTS} projects")
    registry = projects.select("name", F.greatest(F.size("keywords"), F.lit(1)).alias("n_keywords"), "aliases")
    rows = texts.select(key, F.lower("text").alias("low")).where(F.col(key).isNotNull() & F.col("text").isNotNull())
    words = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(T.KEYWORD), F.lit(0)))).alias("word"))
    listed = projects.select("name", F.explode(F.array_distinct("keywords")).alias("word"))
    hits = words.join(F.broadcast(listed), "word").select(key, "name", F.lit(1).alias("words"), F.lit(0).alias("bonus"))
    # the names and aliases as one array: each text is scanned once, no pair of text and project is built
    named = registry.select(F.struct(F.col("name"), F.lower("name").alias("low_name"), F.transform("aliases", F.lower).alias("low_aliases")).alias("p")).agg(F.collect_list("p").alias("projects"))
    found = rows.withColumn("one", F.lit(1)).join(F.broadcast(named.withColumn("one", F.lit(1))), "one").select(key, F.explode(F.filter("projects", lambda p: F.contains(F.col("low"), p["low_name"]) | F.exists(p["low_aliases"], lambda a: F.contains(F.col("low"), a)))).alias("p"), "low")
    has_name, has_alias = F.contains("low", F.col("p.low_name")).cast("int"), F.exists("p.low_aliases", lambda a: F.contains(F.col("low"), a)).cast("int")
    bonus = found.select(key, F.col("p.name").alias("name"), (has_name + has_alias).alias("words"), (has_name * NAME_BONUS + has_alias * ALIAS_BONUS).alias("bonus"))
    scored = hits.unionByName(bonus).groupBy(key, "name").agg(F.sum("words").alias("matched"), F.sum("bonus").alias("bonus")).join(F.broadcast(registry.select("name", "n_keywords")), "name")
    raw = F.col("matched") + F.col("bonus") + F.col("matched") / F.col("n_keywords")
    order = Window.partitionBy(key).orderBy(F.desc("raw"), "name")
    ranked = scored.withColumn("raw", raw).withColumn("nth", F.row_number().over(order)).withColumn("best", F.max("raw").over(Window.partitionBy(key)))
    return ranked.where(F.col("nth") <= top).select(key, F.col("name").alias("project"), F.bround(F.col("raw") / F.col("best"), 3).alias("score"), "matched")


#: Projects of one registry.
MAX_PROJECTS = 10_000


def best_project(texts: DataFrame, projects: DataFrame, key: str, min_score: float = 0.0) -> DataFrame:
    """(key, project, score): the best project of each text if its score is enough."""
    return routed(texts, projects, key, 1).where(F.col("score") >= min_score).select(key, "project", "score")


def active_project(cwd: Column, title: Column, root: str, projects: list[tuple[str, list[str]]]) -> Column:
    """struct(project, source): the registered folder right under ``root`` that holds the working directory, else the first project named in the window title, else nulls."""
    low = F.lower(title)
    under = F.when(F.startswith(cwd, F.lit(root.rstrip("/") + "/")), F.split(F.substring(cwd, len(root.rstrip("/")) + 2, 100_000), "/")[0])
    by_folder = F.when(under.isin([n for n, _ in projects]), under) if projects else F.lit(None).cast("string")
    in_title = [F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(x.lower())) for x in [name, *others])), F.lit(name)) for name, others in projects]
    by_title = F.coalesce(*in_title) if in_title else F.lit(None).cast("string")
    return F.struct(F.coalesce(by_folder, by_title).alias("project"), F.when(by_folder.isNotNull(), "cwd").when(by_title.isNotNull(), "title").alias("source"))
