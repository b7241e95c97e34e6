"""Full-text, vector and hybrid search: by scans, or over a stored index of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stem import stem

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
RRF_K = 60
OVERFETCH = 3
# Letters with marks and what they fold to.
FOLD_FROM = "àáâãäåāăąçćčďđèéêëēęěìíîïīñńňòóôõöøōřśšşťţùúûüūůýÿźżž"
FOLD_TO = "aaaaaaaaacccddeeeeeeeiiiiinnnooooooorsssttuuuuuuyyzzz"


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def words_of(text: Column, stemming: bool = False) -> Column:
    """The words of a text: runs of letters and digits, folded, optionally stemmed; none for null."""
    words = F.filter(F.split(F.coalesce(folded(text), F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _stemmed(words) if stemming else words


@dataclass
class Term:
    """A word, a prefix or a phrase, in all columns or one; with ``near`` words that stand together with at most so many others between them."""

    words: list[str]
    prefix: bool = False
    column: str | None = None
    near: int | None = None


@dataclass
class Query:
    """An expression of AND, OR and NOT over terms."""

    op: str
    parts: list = field(default_factory=list)


_TOKEN = re.compile(r'\s*(?:(\()|(\))|(\w+)\s*:\s*|"([^"]*)"(\*?)|(?!NEAR\s*\()([^\s()":*]+)(\*?)|NEAR\s*\(([^(),]+?)\s*(?:,\s*(\d+))?\s*\))')
NEAR_WORDS = 10


def parse(text: str, columns: list[str], stemming: bool = False) -> Query | None:
    """Words (all wanted), "phrases", prefix*, AND, OR, NOT, NEAR(words, n), column:term and brackets; None when the text is no query."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        tokens.append(m)
        at = m.end()
    position = 0

    def split(piece: str) -> list[str]:
        low = piece.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
        return [stem(w) if stemming else w for w in re.split(r"[^\w]|_", low) if w]

    def peek(word: str) -> bool:
        return position < len(tokens) and tokens[position][6] == word and not tokens[position][7]

    def either() -> Query | Term | None:
        nonlocal position
        parts = [both()]
        while peek("OR"):
            position += 1
            parts.append(both())
        return None if None in parts else parts[0] if len(parts) == 1 else Query("or", parts)

    def both() -> Query | Term | None:
        nonlocal position
        parts = [single()]
        while position < len(tokens) and not tokens[position][2] and not peek("OR"):
            negated = peek("NOT")
            if negated or peek("AND"):
                position += 1
            part = single()
            parts.append(part if part is None or not negated else Query("not", [part]))
        return None if None in parts else parts[0] if len(parts) == 1 else Query("and", parts)

    def single(column: str | None = None) -> Query | Term | None:
        nonlocal position
        if position >= len(tokens):
            return None
        m = tokens[position]
        position += 1
        if m[1]:
            inner = either()
            if position >= len(tokens) or not tokens[position][2]:
                return None
            position += 1
            return inner
        if m[2]:
            return None
        if m[3]:
            return single(m[3]) if m[3] in columns and column is None else None
        if m[8]:
            words = split(m[8])
            return Term(words, column=column, near=int(m[9] or NEAR_WORDS)) if len(words) > 1 else None
        words = split(m[4] if m[4] is not None else m[6])
        if not words or (m[6] in ("AND", "OR", "NOT") and not m[7]):
            return None
        return Term(words, bool(m[5] or m[7]), column)

    found = either()
    return found if found is not None and position == len(tokens) else None


def _terms(query: Query | Term) -> list[Term]:
    if isinstance(query, Term):
        return [query]
    return [t for p in query.parts for t in _terms(p)]


def _hits(term: Term, column: str) -> Column:
    """How often a term stands in an array of words."""
    words = F.col(f"__{column}")
    last = term.words[-1]
    ends = lambda w: F.startswith(w, F.lit(last)) if term.prefix else w == F.lit(last)
    if term.near is not None:
        wanted = F.array(*(F.lit(w) for w in sorted(set(term.words))))
        inside = lambda i: F.size(F.array_intersect(wanted, F.slice(words, i + 1, F.lit(term.near + 2)))) == F.size(wanted)
        return F.size(F.filter(words, lambda w, i: w.isin(term.words) & inside(i)))
    if len(term.words) == 1:
        return F.size(F.filter(words, ends))
    fits = lambda w, i: reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + n) == F.lit(x), F.lit(False)) for n, x in enumerate(term.words[:-1])]) & F.coalesce(ends(F.get(words, i + len(term.words) - 1)), F.lit(False))
    return F.size(F.filter(words, fits))


def _matches(query: Query | Term, terms: list[Term]) -> Column:
    if isinstance(query, Term):
        return F.col(f"__n{next(i for i, t in enumerate(terms) if t is query)}") > 0
    parts = [_matches(p, terms) for p in query.parts]
    return ~parts[0] if query.op == "not" else reduce((lambda a, b: a | b) if query.op == "or" else (lambda a, b: a & b), parts)


def _no_query(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The fallback when a text is no query: rows that hold it as it stands in any of the columns."""
    found = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns))
    return docs.where(found).withColumn("score", F.lit(0.0))


def full_text(docs: DataFrame, columns: list[str], text: str, stemming: bool = False) -> DataFrame:
    """Rows of ``docs`` that match the query, with a BM25 ``score`` (higher is better).

    Two scans: one counts rows, lengths and matching rows of each term over the whole table, one
    scores. A row counts as one document over all ``columns``; filters by time or kind belong after
    this, so that they do not change the weights. Null columns hold no words; a text that is no
    query finds the rows that contain it literally, with score 0; an empty text finds nothing.
    """
    if not text.strip():
        return docs.limit(0).withColumn("score", F.lit(0.0))
    query = parse(text, columns, stemming)
    if query is None:
        return _no_query(docs, columns, text)
    terms = _terms(query)
    held = docs.select("*", *(words_of(F.col(c), stemming).alias(f"__{c}") for c in columns))
    length = reduce(lambda a, b: a + b, (F.size(f"__{c}") for c in columns))
    counted = held.select("*", length.alias("__length"), *(reduce(lambda a, b: a + b, (_hits(t, c) for c in ([t.column] if t.column else columns))).alias(f"__n{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count("*").alias("n"), F.avg("__length").alias("mean"), *_frequencies(terms)).first()
    return _scored(counted, query, terms, stats["n"], stats["mean"] or 1.0, stats).select(*docs.columns, "score")


def _frequencies(terms: list[Term]) -> list[Column]:
    return [F.count_if(F.col(f"__n{i}") > 0).alias(f"df{i}") for i in range(len(terms))]


def _scored(counted: DataFrame, query: Query | Term, terms: list[Term], n: int, mean: float, frequency: Row) -> DataFrame:
    """Rows with ``__length`` and a count ``__n<i>`` of each term that match the query, with their BM25 score."""
    parts = []
    for i in range(len(terms)):
        df = frequency[f"df{i}"]
        idf = F.greatest(F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"__n{i}").cast("double")
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__length") / mean)))
    return counted.where(_matches(query, terms)).withColumn("score", reduce(lambda a, b: a + b, parts))


def best(df: DataFrame, limit: int, key: str) -> DataFrame:
    """The rows with the best score, ties by key."""
    return df.orderBy(F.desc("score"), key).limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays in doubles, with 1e-9 added to the norms; null when a length differs or a value is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9)))


def semantic(memories: DataFrame, query: list[float], as_of: float, limit: int = 20) -> DataFrame:
    """Live memories by cosine with the query vector, best first, ties by key; unusable vectors are left out."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    kept = memories.where(F.col("embedding").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    scored = kept.withColumn("similarity", F.bround(cosine(F.col("embedding"), vector), 4)).where("similarity is not null and not isnan(similarity)")
    return scored.orderBy(F.desc("similarity"), "key").limit(limit)


def fused(lists: list[DataFrame], key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """(key, rrf_score): reciprocal rank fusion of lists (key, rank from 1): the sum of 1 / (k + rank) over the lists, six places, ties by key."""
    both = reduce(lambda a, b: a.unionByName(b), (x.select(key, "rank") for x in lists))
    return both.groupBy(key).agg(F.bround(F.sum(1.0 / (k + F.col("rank"))), 6).alias("rrf_score")).orderBy(F.desc("rrf_score"), key).limit(limit)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """A short list with its positions from 1."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(memories: DataFrame, text: str, query: list[float], as_of: float, limit: int = 20, stemming: bool = False) -> DataFrame:
    """(key, rrf_score): keyword and vector search over memories, three times the limit from each, fused."""
    words = ranked(best(full_text(memories, ["key", "value", "tags_text"], text, stemming), OVERFETCH * limit, "key"), F.desc("score"), "key")
    vectors = ranked(semantic(memories, query, as_of, OVERFETCH * limit), F.desc("similarity"), "key")
    return fused([words, vectors], "key", limit)


def search_memories(memories: DataFrame, text: str, query: list[float] | None, as_of: float, mode: str = "hybrid", limit: int = 20) -> DataFrame:
    """(key, score) by mode: keyword, semantic or hybrid (any other name is hybrid); without a vector hybrid and semantic become keyword. An empty text is an error."""
    if not text.strip():
        raise ValueError("the query is empty")
    limit = max(1, min(limit, 200))
    if mode == "keyword" or query is None:
        return best(full_text(memories, ["key", "value", "tags_text"], text), limit, "key").select("key", "score")
    if mode == "semantic":
        return semantic(memories, query, as_of, limit).select("key", F.col("similarity").alias("score"))
    return hybrid(memories, text, query, as_of, limit).select("key", F.col("rrf_score").alias("score"))


def warm_then_cold(warm: DataFrame, cold: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(key, tier): keyword hits of the warm tier, topped up by the newest matching roll-ups of the cold one (window_start, text_content)."""
    first = ranked(best(full_text(warm, ["key", "value", "tags_text"], text), limit, "key"), F.desc("score"), "key").select("key", F.lit("warm").alias("tier"), "rank", F.lit(0).alias("place"))
    found = full_text(cold, ["text_content"], text).orderBy(F.desc("window_start")).limit(limit)
    second = ranked(found, F.desc("window_start")).select(F.col("window_start").cast("bigint").cast("string").alias("key"), F.lit("cold").alias("tier"), "rank", F.lit(1).alias("place"))
    return first.unionByName(second).orderBy("place", "rank").limit(limit).select("key", "tier")


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of token vectors where the mask is 1, scaled to norm 1; zeros when nothing is left."""
    kept = F.filter(F.zip_with(tokens, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: x["m"] == 1)
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.transform(F.coalesce(F.get(kept, F.lit(0))["v"], F.get(tokens, F.lit(0))), lambda x: x.cast("double")), lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))).otherwise(F.transform(total, lambda x: F.lit(0.0)))


class TextIndex:
    """A stored index of words: one row for each word, row and column, with the word's places, ordered by word.

    Files hold disjoint stretches of words, so a query reads the row groups of its own words or prefixes. A posting
    carries its row's number of words and the ``carried`` columns, so that nothing else is read to score and filter.
    New rows are appended with their own files; words are folded, and stemmed if so wished, once, at the write.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, columns: list[str], carried: tuple[str, ...] = (), stemming: bool = False):
        self.spark, self.path, self.key, self.columns, self.carried, self.stemming = spark, path, key, columns, carried, stemming

    def append(self, docs: DataFrame) -> None:
        """Add rows, each of which must have a key of its own; rows without key are left out."""
        words = [words_of(F.col(c), self.stemming).alias(f"__{c}") for c in self.columns]
        held = docs.where(F.col(self.key).isNotNull()).select(self.key, *self.carried, *words)
        held = held.withColumn("__length", reduce(lambda a, b: a + b, (F.size(f"__{c}") for c in self.columns)))
        named = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__{c}").alias("words")) for c in self.columns)))
        rows = held.select(self.key, *self.carried, "__length", named.alias("c")).select(self.key, *self.carried, "__length", F.col("c.column").alias("__column"), F.col("c.words").alias("__words"))
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__words")
        postings = rows.mapInArrow(_postings, f"{kept}, __word string, __places array<int>")
        postings.repartitionByRange("__word", self.key).sortWithinPartitions("__word", self.key).write.mode("append").parquet(f"{self.path}/postings")
        held.agg(F.count("*").alias("n"), F.coalesce(F.sum("__length"), F.lit(0)).alias("words")).write.mode("append").parquet(f"{self.path}/totals")

    def search(self, text: str) -> DataFrame:
        """(key, carried columns, score) of the rows that match, with the same scores as ``full_text``.

        A text that is no query, or whose query rows without any of its words could match (NOT alone), is
        refused with an error: it takes a scan.
        """
        query = parse(text, self.columns, self.stemming) if text.strip() else None
        if query is None or not _anchored(query):
            raise ValueError("this text takes a scan of all rows")
        terms = _terms(query)
        word = F.col("__word")
        wanted = [word.isin(t.words if not t.prefix else t.words[:-1]) if not t.prefix or len(t.words) > 1 else F.lit(False) for t in terms]
        wanted += [F.startswith(word, F.lit(t.words[-1])) for t in terms if t.prefix]
        rows = self.spark.read.parquet(f"{self.path}/postings").where(reduce(lambda a, b: a | b, wanted))
        held = rows.groupBy(self.key, "__length", *self.carried).agg(F.collect_list(F.struct("__word", "__column", "__places")).alias("__held"))
        # a row's words of the query put back in their places are all that counting needs
        for c in self.columns:
            held = held.withColumn(f"__{c}", _in_place(c))
        counts = [reduce(lambda a, b: a + b, (_placed_hits(t, c) for c in ([t.column] if t.column else self.columns))).alias(f"__n{i}") for i, t in enumerate(terms)]
        counted = held.select(self.key, *self.carried, "__length", *counts)
        totals = self.spark.read.parquet(f"{self.path}/totals").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        n = totals["n"] or 0
        return _scored(counted, query, terms, n, (totals["words"] or 0) / n if n and totals["words"] else 1.0, counted.agg(*_frequencies(terms)).first()).select(self.key, *self.carried, "score")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., words) as one row for each different word: (..., word, places)."""
    for batch in batches:
        lists, kept = batch.column(batch.num_columns - 1), batch.columns[:-1]
        words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        if not len(words):
            continue
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((place, code, row))
        row, code = row[order], code[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
        at = pa.array(row[first])
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(words)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in kept), coded.dictionary.take(pa.array(code[first])), places], [*batch.schema.names[:-1], "__word", "__places"])


def _in_place(column: str) -> Column:
    """A column's (place, word) in order, from the postings of a row."""
    own = F.filter("__held", lambda h: h["__column"] == column)
    return F.array_sort(F.flatten(F.transform(own, lambda h: F.transform(h["__places"], lambda p: F.struct(p.alias("p"), h["__word"].alias("w"))))))


def _anchored(query: Query | Term) -> bool:
    """Does every matching row hold a word of the query?"""
    if isinstance(query, Term):
        return True
    return {"and": any, "or": all, "not": lambda parts: False}[query.op](_anchored(p) for p in query.parts)


def _placed_hits(term: Term, column: str) -> Column:
    """As _hits, from an array of (place, word) that holds the query's words only."""
    placed = F.col(f"__{column}")
    last = term.words[-1]
    ends = lambda w: F.startswith(w, F.lit(last)) if term.prefix else w == F.lit(last)
    if term.near is not None:
        one = lambda x, w: F.exists(placed, lambda y: (y["w"] == F.lit(w)) & (y["p"] >= x["p"]) & (y["p"] <= x["p"] + term.near + 1))
        inside = lambda x: reduce(lambda a, b: a & b, (one(x, w) for w in sorted(set(term.words))))
        return F.size(F.filter(placed, lambda x: x["w"].isin(term.words) & inside(x)))
    if len(term.words) == 1:
        return F.size(F.filter(placed, lambda x: ends(x["w"])))
    follows = lambda x, n, w: F.exists(placed, lambda y: (y["p"] == x["p"] + n) & (ends(y["w"]) if n == len(term.words) - 1 else y["w"] == F.lit(w)))
    return F.size(F.filter(placed, lambda x: (x["w"] == F.lit(term.words[0])) & reduce(lambda a, b: a & b, (follows(x, n, w) for n, w in enumerate(term.words[1:], 1)))))
