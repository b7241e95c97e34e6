"""Texts that stop before their end, and how often each source cuts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import present
from tidemark.plans.durable import durable, spread

#: Shingle length, similarity (the share of the shorter text's shingles that the other one has), and min-hash bands times rows of
#: whole texts: a pair with a Jaccard index of 0.8 is missed with a chance of 4e-4.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: A block of a bucket has about so many texts and characters; its texts are compared with those of one block at a time.
BLOCK_TEXTS = 256
BLOCK_CHARS = 4_000_000
#: Contexts of a word whose chance to close a text is estimated, from one word to the build of eight.
CONTEXTS = 5
#: A line of so many words without a sentence's end tells nothing about ends: its writer sets no points.
UNPOINTED = 30
#: A closing context seen this rarely is backed off to a shorter one.
BACKOFF = 2.0
#: Chance of an end below which an open end counts as cut.
OPEN_END = 0.25
#: Chance of an end for words that are never seen inside a text.
UNSEEN = 0.05
#: Log-odds: what the closing words can say at most; what an open sign, half a word or a feed's limit adds; what a closed sentence
#: takes off; and what a longer copy, a mark or a broken structure adds.
LARGEST_ODDS, OPEN, CLOSED, PROOF = 9.0, 12.0, 12.0, 40.0

# Articles, pronouns, conjunctions, prepositions and auxiliaries of the texts' languages.
SMALL_WORDS = frozenset(
    "a an the this that these those i you he she it we they my your his her its our their and or but so because while until once when if as than then "
    "which who what whether of in on at to for from by with without into over under after before since behind near between during instead not no nobody is are was were be been has have had do does did will would could should can may must there here already still now "
    "der die das den dem des ein eine einen wir ich sie er es und oder aber weil bis wenn dass ist sind war waren wird wurde haben hat zu von mit ohne nach vor seit im am über unter schon wieder nicht "
    "le la les l un une des du de et ou mais que qui est sont était a ont été sera on nous vous il elle ce tant comme pour dans en sans avant après pendant depuis déjà encore "
    "el los las una y o pero que es está esté fue quedó ha hay como hasta para por con sin antes durante desde ya sigue".split()
)
# Marks that writers leave where they cut.
CUT_WORDS = "truncated|cut|cut off|clipped|snip|snipped|shortened|abridged|more|read more|continued|cont|to be continued|gekürzt|abgeschnitten|tronqué|coupé|suite|recortado|truncado|cortado|sigue"
CUT_MARK = re.compile(rf"(?i)\s*(?:[\[(<{{]\s*(?:(?:text|message|output|content)\s+)?(?:{CUT_WORDS})\s*(?:…|\.\.\.)?\s*[\])>}}]|[\[(]\s*(?:…|\.\.\.)\s*[\])])\s*$")
DOTS = re.compile(r"\s*(?:…|\.{3,})\s*$")
SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»)\]*_`]*$")
SMILEY = re.compile(r"(?:[:;]-?[)(DP]|[\U0001F300-\U0001FAFF☀-➿]️?)$")
INVISIBLE = re.compile("\x1b\\[[0-9;]*m|[​-‏⁠﻿\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
ODD_BLANKS = re.compile(r" +\t[ \t]*|\t+ [ \t]*")
EDGES = re.compile(r"^[\"'“”‘’«»(\[{*_`¿¡]+|[\"'“”‘’«»)\]}*_`,;:.!?…]+$")
CODE_AFTER = re.compile(r"[.!?][\"'”’»)]*(?:[ \t]+(?=\S*[\d_.\-#A-Z])[#\w.\-]{4,}){1,3}$")
LAST_BLANKS = re.compile(r"\S*(?:\s+\S+){0,3}\s*\Z")
#: Lengths in words of a text's beginning that are banded on their own, so that a copy meets its source however much of it is lost.
BEGINNINGS = tuple(16 << n for n in range(10))
BEGINNING_BANDS, BEGINNING_ROWS = 6, 3
#: Rows up to which a table of buckets or of their members is broadcast; beyond it they are joined by shuffles.
BROADCAST_ROWS = 500_000
#: Words that a worker remembers the forms of, and characters of texts that it works on at once.
REMEMBERED = 150_000
CHARS_AT_ONCE = 1_500_000


def visible(text: str) -> str:
    """The text without invisible characters and outer blanks."""
    return ODD_BLANKS.sub(" ", INVISIBLE.sub("", text)).replace("\r\n", "\n").replace("\r", "\n").strip()


def shape(token: str) -> str:
    """A word in lower case; of names, numbers and codes only their form."""
    bare = EDGES.sub("", token)
    if not bare:
        return token
    if bare.isalpha() and (bare.islower() or bare.isupper() or bare.istitle()):
        return bare.lower()
    if any(c.isdigit() for c in bare) and any(c.isalpha() for c in bare) and bare.isalnum() and bare[0] not in "vV":
        return "<mixed>"
    form = re.sub(r"\d+", "9", bare)
    form = re.sub(r"[a-zà-ÿ]+=", lambda m: m.group().upper(), form)
    return re.sub(r"(?<![A-Za-zÀ-ÿ=])[^\W\d_]+(?![A-Za-zÀ-ÿ=])", lambda m: "Aa" if not m.group().islower() else "a", form) if "=" not in form else form.lower()


def mask(token: str) -> str:
    """A word as it counts for the build of a sentence: small words stay, others become '*' with their punctuation."""
    form = shape(token)
    bare = EDGES.sub("", token)
    if form in SMALL_WORDS or not bare:
        return form if bare else token
    at = token.find(bare)
    return token[:at] + ("*" if bare.isalpha() else form) + token[at + len(bare) :].rstrip(".!?…,;:")


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A mark of a sequence and one more element."""
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Forms(dict):
    """(shape mark, build mark, ends a sentence, begins a new one) of each word seen so far."""

    def __missing__(self, token: str) -> tuple[int, int, bool, bool]:
        if len(self) >= REMEMBERED:
            self.clear()
        end = bool(SENTENCE_END.search(token))
        self[token] = found = (xxhash.xxh3_64_intdigest(shape(token)), xxhash.xxh3_64_intdigest(mask(token), seed=1), end, end and len(token) > 1)
        return found


_forms = Forms()
_BEGIN = np.uint64(xxhash.xxh3_64_intdigest("^"))


def contexts(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(marks, ends): for each word of the lines the marks of the contexts that end with it and begin in its sentence, and whether it ends one.

    One and two words, the build of five and of eight, and up to eight words from where the sentence begins (0 if there are more).
    """
    tokens = [word for line in lines for word in line]
    codes = pa.array(tokens, pa.string()).dictionary_encode()
    forms = [_forms[word] for word in codes.dictionary.to_pylist()]
    which = codes.indices.to_numpy(zero_copy_only=False)
    shapes, builds = (np.array([f[n] for f in forms], np.uint64)[which] for n in (0, 1))
    ends, news = (np.array([f[n] for f in forms], bool)[which] for n in (2, 3))
    # a mark stands before the first word of each sentence
    first = np.zeros(len(tokens), bool)
    sizes = np.array([len(line) for line in lines], np.int64)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    first[1:] |= news[:-1]
    place = np.arange(len(tokens)) + np.cumsum(first)
    row = np.full((2, len(tokens) + int(first.sum())), _BEGIN)
    row[0, place], row[1, place] = shapes, builds
    begin = np.maximum.accumulate(np.where(first, place - 1, 0))
    out = np.zeros((len(tokens), CONTEXTS), np.uint64)
    for level, (kind, words) in enumerate(((0, 1), (0, 2), (1, 5), (1, 8), (0, 9))):
        h = np.full(len(tokens), level + 1, np.uint64)
        for back in range(words - 1, -1, -1):
            at = place - back
            inside = at >= begin if level else np.ones(len(tokens), bool)
            h = np.where(inside, _mix(h, row[kind][np.maximum(at, 0)]), h)
        out[:, level] = h if level < 4 else np.where(place - begin <= 8, h | np.uint64(1), 0)
    return out.view(np.int64), ends


def _unbalanced(text: str) -> bool:
    """Does text in JSON's form end inside a string, list or object?"""
    depth, inside, escaped = 0, False, False
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return inside or depth > 0


def broken_structure(text: str) -> bool:
    """Does the text end in mid structure: JSON, a code block, a table row, a bracket, a row of a regular log?"""
    if re.match(r"[{\[]\s*[\"{\[]", text):
        return _unbalanced(text)
    if len(re.findall(r"(?m)^\s*```", text)) % 2:
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    last, before = lines[-1], lines[:-1]
    if before and "\t" in lines[0] and len({x.count("\t") for x in before}) == 1 and last.count("\t") < before[0].count("\t"):
        return True
    if last.count("(") > last.count(")") or last.count("[") > last.count("]") or last.count("{") > last.count("}"):
        return True
    if re.match(r"\s*(?:#{1,6}|[-*+]|\d+[.)]|\|)?$", last) or re.search(r"\s(?:=|\+|\||&|->|:=|==)$", last):
        return True
    if re.match(r"(?:async\s+)?(?:def|class)\s+\w+[^:]*$", last):
        return True
    if len(before) >= 2:
        forms = {re.sub(r"\d+", "9", x.split()[-1]) if x.split() else "" for x in before}
        kinds = {re.sub(r"\d+", "9", x.split()[0]) for x in before}
        if len(forms) == 1 and len(kinds) == 1 and re.search(r"\d", before[-1].split()[-1]):
            return re.sub(r"\d+", "9", last.split()[-1]) not in forms
    code = [x for x in before if re.match(r"\s+\w+ = \w+\(.*\)$", x)]
    if code and re.match(r"\s+\S", last):
        return not re.match(r"\s+(?:\w+ = \w+\(.*\)|return \w+|[\"'#].*)$", last)
    return False


def _mark_begins(text: str) -> int | None:
    """Where the mark of a writer who cut begins, if the text ends with one: it lies behind the last opening bracket."""
    opened = max(text.rfind(c) for c in "[(<{")
    # "((...)" and the like: brackets of a mark may be doubled
    found = CUT_MARK.match(text, opened) if opened >= 0 else None
    return found and len(text[:opened].rstrip())


def _dots_begin(text: str) -> int | None:
    bare = text.rstrip(".")
    if len(text) - len(bare) < 3:
        bare = text[:-1] if text.endswith("…") else None
    return None if bare is None else len(bare.rstrip())


def ending(text: str) -> tuple[dict, list[str]]:
    """What the end of a text says (mark, structure, punctuation), and its last words."""
    text = text.rstrip()
    marked = _mark_begins(text)
    body = text if marked is None else text[:marked]
    dots = _dots_begin(body)
    body = body if dots is None else body[:dots]
    line = body[body.rfind("\n") + 1 :]
    words = line.split()
    last = EDGES.sub("", words[-1]) if words else ""
    json = bool(re.match(r"[{\[]\s*[\"{\[]", text))
    whole = json and not _unbalanced(text) or body.endswith("```")
    plain = last.isalpha() and (last.islower() or last.istitle() or last.isupper())
    return {
        "marked": marked is not None,
        "broken": bool(body) and not whole and broken_structure(body),
        "dots": dots is not None,
        "closed": marked is None and (whole or bool(SENTENCE_END.search(words[-1] if words else "") or SMILEY.search(body[-4:]))),
        "code_after": not plain and len(words) > 1 and bool(CODE_AFTER.search(line[LAST_BLANKS.search(line).start() :])),
        "comma": bool(re.search(r"[,;(\[{/\\&=]$|\w[-–]$", body[-2:])),
        "word": last.isalpha(),
    }, words[-12:]


_SALT = np.random.default_rng(7).integers(1, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def runs(words: list[str]) -> np.ndarray:
    """Marks of the runs of five words, in order."""
    return _runs(np.array([_word_marks[w] for w in words], np.uint64))


class _WordMarks(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = mark = xxhash.xxh3_64_intdigest(word)
        return mark


_word_marks = _WordMarks()


def _runs(marks: np.ndarray) -> np.ndarray:
    n = max(len(marks) - SHINGLE_WORDS + 1, 0)
    h = np.zeros(n, np.uint64)
    for at in range(SHINGLE_WORDS):
        h = _mix(h, marks[at : at + n])
    return h


def _least(values: np.ndarray, begins: np.ndarray, functions: int) -> np.ndarray:
    """Min-hashes (text, function) of the runs that begin at ``begins``, one text after the other; every text has some."""
    out = np.empty((len(begins), functions), np.uint64)
    for n in range(functions):
        mixed = values * _SALT[0, n]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _SALT[1, n]
        out[:, n] = np.minimum.reduceat(mixed, begins)
    return out


def _banded(least: np.ndarray, rows: int, first: int) -> np.ndarray:
    """Marks (text, band) of min-hashes; never 0."""
    parts = least.reshape(len(least), -1, rows)
    h = np.full(parts.shape[:2], 1, np.uint64) * (np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(first + 1))
    for n in range(rows):
        h = _mix(h, parts[:, :, n])
    return (h | np.uint64(1)).view(np.int64)


def bands(texts: list[np.ndarray]) -> list[list[int]]:
    """Min-hash bands of the runs of each text: those of the whole, then those of each beginning it is long enough for.

    A text of fewer than five words has none.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[int]] = [[] for _ in texts]
    some = np.flatnonzero(sizes > 0)
    if not len(some):
        return out
    values, begins = np.concatenate([texts[n] for n in some]), np.cumsum(sizes[some]) - sizes[some]
    for n, row in zip(some, _banded(_least(values, begins, BANDS * ROWS), ROWS, 0).tolist()):
        out[n] += row
    for level, words in enumerate(BEGINNINGS):
        runs_in = words - SHINGLE_WORDS + 1
        long = np.flatnonzero(sizes >= runs_in)
        if not len(long):
            break
        values = np.concatenate([texts[n][:runs_in] for n in long])
        least = _least(values, np.arange(len(long)) * runs_in, BEGINNING_BANDS * BEGINNING_ROWS)
        for n, row in zip(long, _banded(least, BEGINNING_ROWS, BANDS + level * BEGINNING_BANDS).tolist()):
            out[n] += row
    return out


_FEATURES = "doc_id bigint, source string, chars int, bytes int, h1 bigint, h2 bigint, marked boolean, broken boolean, dots boolean, closed boolean, code_after boolean, comma boolean, word boolean, c array<bigint>, bands array<bigint>"
_KINDS = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in _FEATURES.split(", "))])


def closing_counts(lines: list[list[str]], last_of_text: np.ndarray) -> pa.Table:
    """(k, n, ended, inside): of each context inside a text how often it stands there and how often a sentence or line ends after it.

    Lines whose writer sets no points tell nothing about ends; their words count as ``inside`` alone. A text's own end is no evidence.
    """
    marks, ends = contexts(lines)
    sizes = np.array([len(line) for line in lines], np.int64)
    line = np.repeat(np.arange(len(lines)), sizes)
    closing = np.zeros(len(marks), bool)
    closing[np.cumsum(sizes) - 1] = True
    pointed = np.bincount(line[ends & ~closing], minlength=len(lines)) > 0
    told = (pointed | (sizes < UNPOINTED))[line]
    evidence = ~(closing & last_of_text[line])
    use, ended = evidence & told, ends | closing
    silent = marks[evidence & ~told, 0]
    key = np.concatenate([marks[use].T.reshape(-1), silent])
    n = np.ones(len(key), np.int64)
    n[len(key) - len(silent) :] = 0
    table = pa.table({"k": key, "n": n, "ended": np.concatenate([np.tile(ended[use], CONTEXTS), np.zeros(len(silent), bool)]).astype(np.int64), "inside": np.ones(len(key), np.int64)})
    return _added(table.filter(pc.not_equal(table["k"], 0)))


def _added(table: pa.Table) -> pa.Table:
    counted = table.group_by("k", use_threads=False).aggregate([("n", "sum"), ("ended", "sum"), ("inside", "sum")])
    return counted.select(["k", "n_sum", "ended_sum", "inside_sum"]).rename_columns(["k", "n", "ended", "inside"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (..., text) in parts of limited length."""
    for batch in batches:
        begin, held = 0, 0
        for n, size in enumerate(pc.utf8_length(batch.column(batch.num_columns - 1)).to_pylist()):
            held += size
            if held > CHARS_AT_ONCE:
                yield batch.slice(begin, n + 1 - begin)
                begin, held = n + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        rows, lasts, texts = [], [], []
        for doc, source, raw in zip(*(batch.column(n).to_pylist() for n in range(3))):
            text = visible(raw)
            if not text:
                continue
            h1, h2 = np.frombuffer(xxhash.xxh128_digest(text.encode("utf-8", "replace")), np.int64)
            found, last = ending(text)
            rows.append({"doc_id": doc, "source": source, "chars": len(raw), "bytes": len(raw.encode("utf-8", "replace")), "h1": int(h1), "h2": int(h2)} | found)
            lasts.append(last)
            texts.append(runs(re.findall(r"\w+", text.lower())))
        if not rows:
            continue
        marks, _ = contexts(lasts)
        sizes = np.array([len(x) for x in lasts])
        of_last = marks[np.maximum(np.cumsum(sizes) - 1, 0)] * (sizes > 0)[:, None] if len(marks) else np.zeros((len(rows), CONTEXTS), np.int64)
        for row, c, b in zip(rows, of_last.tolist(), bands(texts)):
            row |= {"c": c, "bands": b}
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


#: Contexts that a scan adds up before it hands them on.
HELD_CONTEXTS = 1_000_000


def _closings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in _parts(batches):
        lines, last_of_text = [], []
        for raw in batch.column(0).to_pylist():
            own = [words for words in (line.split() for line in visible(raw).split("\n")) if words]
            lines += own
            last_of_text += [False] * (len(own) - 1) + [True] * bool(own)
        if lines:
            held.append(closing_counts(lines, np.array(last_of_text)))
        if sum(map(len, held)) > HELD_CONTEXTS:
            held = [_added(pa.concat_tables(held))]
            if len(held[0]) > HELD_CONTEXTS // 2:
                yield from held.pop().to_batches(max_chunksize=100_000)
    if held:
        yield from _added(pa.concat_tables(held)).to_batches(max_chunksize=100_000)


def feed_limits(features: DataFrame) -> DataFrame:
    """(source, unit, size): lengths in characters or bytes at which a source's texts pile up, most of them with an open end.

    A pile is three texts or more, not all the same, half again as many as lie within 25 of it; few texts of the source go beyond
    its limit, at most twice as many as lie at it.
    """
    open_end = ~F.col("closed") | F.col("dots") | F.col("marked") | F.col("broken")
    sizes = features.select("source", "h1", "h2", open_end.alias("open"), F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "size"))
    counts = sizes.groupBy("source", "unit", "size").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"), F.min("h1").alias("low"), F.max("h1").alias("high"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-25, 25)
    beyond = Window.partitionBy("source", "unit").orderBy("size").rowsBetween(1, Window.unboundedFollowing)
    piled = counts.withColumn("around", F.sum("n").over(near) - F.col("n")).withColumn("longer", F.coalesce(F.sum("n").over(beyond), F.lit(0)))
    return piled.where("n >= 3 and low <> high and n >= 1.5 * around and 2 * n_open >= n and longer <= 2 * n").select("source", "unit", "size")


class _Copy:
    """A text made ready to be aligned with others."""

    def __init__(self, raw: str):
        text = visible(raw)
        self.text = text.lower()
        self.spans = [m.span() for m in re.finditer(r"\w+", self.text)]
        self.words = [self.text[b:e] for b, e in self.spans]
        self.runs = runs(self.words)
        self.marks = np.unique(self.runs)
        body = re.findall(r"\w+", DOTS.sub("", CUT_MARK.sub("", text)).lower())
        self.length, self.last, self.tail = len(body), body[-1] if body else "", body[-SHINGLE_WORDS - 1 : -1]
        self.tail_run = runs(self.tail)
        self.beginnings = sum(len(self.words) >= words for words in BEGINNINGS)

    def places(self, other: _Copy) -> list[int]:
        """Where the other text's words before its last one stand in this text."""
        whole = np.flatnonzero(self.runs == other.tail_run[0]).tolist() if len(other.tail_run) else []
        if whole:
            return whole
        # a word among the last ones may differ: two in front of the last one are enough
        end = other.tail[-2:]
        n, back = len(end), len(other.tail) - len(end)
        return [i - back for i in range(len(self.words) - n + 1) if self.words[i : i + n] == end] if n else []


def stops_early(short: _Copy, long: _Copy) -> bool:
    """Has the second text enough of the first one, and does the alignment of the first with it end early, in mid sentence?

    The similarity is the share of the first text's shingles that the second one has, so it does not matter how much was cut off.
    """
    places = long.places(short)
    if not places:
        return False
    at = min(places, key=lambda i: abs(i + len(short.tail) + 1 - short.length)) + len(short.tail)  # of the last word
    if at >= len(long.words) or not long.words[at].startswith(short.last):
        return False
    after = long.text[long.spans[at][0] + len(short.last) :]
    if not after.strip() or re.match(r"[.!?…\"'”’»)\]}`]|\s*\n", after):
        return False
    both = len(np.intersect1d(short.marks, long.marks, assume_unique=True))
    return both >= SIMILARITY * len(short.marks)


def _early(tile: pa.Table) -> pa.Table:
    """Texts of two blocks of a bucket (or of one) that a longer near-copy in it shows to stop early: (doc_id)."""
    band, across = tile["band"][0].as_py(), tile["i"][0] != tile["j"][0]
    ids, chars, block = (tile[name].to_numpy() for name in ("doc_id", "chars", "block"))
    values = np.array([(own[:band] + [0] * band)[:band] for own in tile["bands"].to_pylist()], np.int64).reshape(len(ids), band)
    copies = [_Copy(text) for text in tile["text"].to_pylist()]
    sizes = np.array([len(c.marks) for c in copies])
    # in a beginning's bucket a text looks for its source only if it is no longer than the next beginning
    level = 1 + (band - BANDS) // BEGINNING_BANDS
    before = [n for n in range(band) if n < BANDS or n >= BANDS + (level - 1) * BEGINNING_BANDS]
    values = values[:, before]
    out = []
    for n, short in enumerate(copies):
        if band >= BANDS and short.beginnings != level:
            continue
        fit = (chars > chars[n]) & (sizes >= SIMILARITY * sizes[n])
        fit &= ~((values == values[n]) & (values != 0)).any(1)  # two texts meet in the first band they share
        if across:
            fit &= block != block[n]
        if any(stops_early(short, copies[m]) for m in np.flatnonzero(fit)):
            out.append(ids[n])
    return pa.table({"doc_id": pa.array(out, pa.int64())})


def _small(df: DataFrame) -> DataFrame:
    """A table that was written before, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def early_ends(features: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id): texts that a longer near-copy shows to stop early.

    Texts are banded as a whole and by their beginnings; copies of one text count once. In each bucket every text meets all longer ones whose number of
    shingles allows the similarity; large buckets are split into blocks, and every two blocks meet in a group of their own.
    """
    mark = F.shiftrightunsigned("h1", 33).cast("int")
    banded = features.select("doc_id", "chars", "h1", "h2", mark.alias("mark"), F.posexplode("bands").alias("band", "value"))
    # a value belongs to one band; buckets of one text and its copies tell nothing
    shared = banded.groupBy("value").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("value")
    members = banded.join(_small(durable(shared)), "value").groupBy("band", "value", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min("chars").alias("chars"))
    members = durable(members)
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("chars") / BLOCK_CHARS)).cast("int")
    buckets = members.groupBy("band", "value").agg(parts.alias("parts"))
    wanted = _small(durable(members.select("doc_id").distinct()))
    held = features.select("doc_id", "bands").join(wanted, "doc_id").join(texts.join(wanted, "doc_id", "left_semi"), "doc_id")
    placed = members.select("band", "value", "doc_id", "chars").join(buckets, ["band", "value"]).withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)"))
    tiles = placed.join(held, "doc_id").withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    tiles = tiles.select("band", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "chars", "bands", "text")
    flagged = tiles.groupBy("band", "value", "i", "j").applyInArrow(_early, "doc_id bigint").distinct()
    copies = features.select("doc_id", "h1", "h2")
    return copies.join(copies.join(flagged, "doc_id", "left_semi").select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("doc_id")


def endings(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, score, ...flags, cut): for every document with text whether it was cut; it is where the score is above 0.

    Near-copies come first: texts that share min-hash bands of their five-word shingles, or of those of their beginning, are
    compared (the longer one must have 0.8 of the shorter one's shingles) and aligned, and the one whose alignment ends in mid sentence
    is cut. Every text is scored by its closing words: the log-odds that they do not close a sentence or line, from how often
    they do in any other text: the last word, the last two, the build of the last five and eight, and a short last sentence,
    each corrected by the next. A closed sentence, an open sign or structure, half a word (one that stands inside no text; lines of
    30 or more words without a sentence's end count for that alone), a writer's mark, a feed's limit and a longer
    copy add to the score. Texts that are null, empty or blank are left out.
    """
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & present(F.col("text")).isNotNull())
    rows = spread(rows)
    features = durable(rows.mapInArrow(_features, _FEATURES))
    # a second scan, as the counts of all contexts would be several times the texts if they were kept
    counts = rows.select("text").mapInArrow(_closings, "k bigint, n bigint, ended bigint, inside bigint").groupBy(F.col("k").alias("c")).agg(*(F.sum(k).alias(k) for k in ("n", "ended", "inside")))
    limits = feed_limits(features).groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("size"))).alias("char_limits"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("size"))).alias("byte_limits"))
    near = lambda size, limits: F.exists(limits, lambda x: (size <= x) & (size >= x - 2))
    at_limit = F.coalesce(near(F.col("chars"), F.col("char_limits")) | near(F.col("bytes"), F.col("byte_limits")), F.lit(False))
    features = features.join(limits, "source", "left").withColumn("at_limit", at_limit).drop("char_limits", "byte_limits")
    # the ends of texts below their feed's limit are evidence for others: each different text counts once, and not for itself
    ends = features.where("not at_limit").groupBy("h1", "h2").agg(F.any_value("c").alias("c")).select(F.explode("c").alias("c")).where("c <> 0").groupBy("c").agg(F.count("*").alias("ends"))
    wanted = features.select(F.explode("c").alias("c")).where("c <> 0").distinct()
    known = wanted.join(counts, "c", "left").join(ends, "c", "left").na.fill(0)
    others = F.greatest(F.col("ends") - F.when(F.col("at_limit"), 0).otherwise(1), F.lit(0))
    placed = features.select("doc_id", "at_limit", F.posexplode("c").alias("level", "c")).join(known, "c").withColumn("others", others)
    seen = F.struct((F.col("n") + F.col("others")).alias("n"), (F.col("ended") + F.col("others")).alias("ended"), "inside", "others")
    levels = placed.groupBy("doc_id").agg(*(F.max(F.when(F.col("level") == n, seen)).alias(f"c{n}") for n in range(CONTEXTS)))
    early = early_ends(features, rows.select("doc_id", "text"))
    judged = features.drop("bands", "h1", "h2", "c").join(levels, "doc_id", "left").join(early.withColumn("early", F.lit(True)), "doc_id", "left")
    chance = F.lit(UNSEEN)
    for n in range(CONTEXTS):
        closing = (F.col(f"c{n}.ended") + BACKOFF * chance) / (F.col(f"c{n}.n") + BACKOFF)
        chance = F.when(F.col(f"c{n}").isNull(), chance).otherwise(closing)
    judged = judged.withColumn("end_chance", chance).withColumn("early", F.coalesce("early", F.lit(False)))
    # a word that stands inside no text is half a word, unless it closes a short last sentence that others end with too
    closes_others = F.coalesce(F.col(f"c{CONTEXTS - 1}.others") >= 2, F.lit(False))
    mid_word = F.coalesce(F.col("word") & (F.col("c0.inside") == 0) & ~closes_others, F.lit(False))
    finished = (F.col("closed") & ~F.col("dots")) | (F.col("code_after") & ~F.col("at_limit"))
    open_end = F.col("at_limit") | F.col("comma") | mid_word
    odds = lambda p: F.log((1 - p) / p)
    own = F.greatest(F.lit(-LARGEST_ODDS), F.least(F.lit(LARGEST_ODDS), odds(F.greatest(F.least(F.col("end_chance"), F.lit(1 - 1e-9)), F.lit(1e-9))) - odds(F.lit(OPEN_END))))
    evidence = sum((F.when(is_so, F.lit(float(weight))).otherwise(0.0) for is_so, weight in ((F.col("early"), PROOF), (F.col("marked"), PROOF), (F.col("broken"), PROOF), (finished, -CLOSED), (open_end & ~finished, OPEN))), F.lit(0.0))
    judged = judged.withColumn("score", own + evidence).withColumn("mid_word", mid_word)
    return judged.withColumn("cut", F.col("score") > 0).select("doc_id", "source", "score", "end_chance", "mid_word", "at_limit", "early", "marked", "broken", "dots", "closed", "cut")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id): the documents whose text stops before its end."""
    return endings(documents).where("cut").select("doc_id")


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share): how often each source cuts; documents without text do not count."""
    return endings(documents).groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), (F.count_if("cut") / F.count("*")).alias("share"))
