"""Personal information inside free text, found and replaced by typed placeholders."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import durable

KINDS = ("email", "phone", "id_number", "address", "person")

# Cues of each kind, in the languages of the texts.
TOP_LEVEL = "com|net|org|edu|gov|info|biz|example|test|invalid|localhost|io|co|dev|app|me|uk|us|de|fr|es|it|nl|eu|ch|at|se|pl|pt"
#: File endings that look like a top-level domain after an "@2x" or the like.
FILE_ENDINGS = "png|jpg|jpeg|gif|svg|webp|css|js|ts|py|rs|md|sql|csv|toml|json|txt|pdf"
#: What names a number that is nobody's.
THING_CUES = "lot part partno no sku isbn ord tracking build epoch seq serial version rev batch rows pid sha".split()
ID_CUES = r"ssn|social\s+security(?:\s+(?:no|number))?|national\s+(?:id|insurance)(?:\s+(?:no|number))?|passport(?:\s+(?:no|number))?|pasaporte|reisepass|passeport|dni|nif|nie|nino|steuer[-–\s]?id(?:nr)?|tax\s+id|personnummer|personalausweis|id\s+card|driver'?s\s+licen[cs]e|sozialversicherung\w*|sécurité\s+sociale|n°\s*sécu"
STREETS = "street|st|road|rd|avenue|ave|lane|ln|close|row|drive|dr|terrace|court|ct|boulevard|blvd|place|pl|square|sq|crescent|way|walk|hill|gardens|grove|mews|parade|alley"
HONORIFICS = "mr|mrs|ms|miss|mx|dr|prof|mme|mlle|monsieur|madame|herr|frau|sr|sra|señor|señora|don|doña"
GREETINGS = r"dear|hi|hey|hello|hallo|hola|bonjour|salut|liebe|lieber|cher|chère|querido|querida|thanks|thank\s+you|danke|gracias|merci|regards|wishes|cheers|grüße|saludos|cordialement|attn|cc|moin|servus"

DASH = r"[-–—.\s]"
DIGIT = r"[\dO]"

#: Words that stand beside names without being one.
NOT_A_NAME = re.compile(rf"(?:{HONORIFICS}|{GREETINGS}|kind|best|from|to|rückruf|tel|phone|fax|mobile|email|mail)")

_LOCAL = r"[\w.+\-]*\w"
_AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|%40|\s+at\s+(?=[\w\-]+(?:\s+dot\s+[\w\-]+)*\s+dot\s))"
_DOT = r"(?:\s?\.\s?|\s?[\[(]\s?(?:dot|\.)\s?[\])]\s?|\s+dot\s+)"
# a known ending may come with blanks and spelt-out dots, any other only as it should be written
EMAIL = re.compile(
    rf"(?i)(?<![\w@/])(?P<local>{_LOCAL}){_AT}(?P<domain>[\w\-]+(?:{_DOT}[\w\-]+)*?{_DOT}(?P<top>{TOP_LEVEL})(?![\w\-])(?!\.\w)(?!\s?dot\s)|(?:[\w\-]+\.)+(?P<other>[a-z]{{2,6}})(?![\w\-@])(?!\.\w))(?P<after>:[\w/~.])?"
)
#: Every form of _AT holds one of these.
MAY_HOLD_EMAIL = re.compile(r"(?i)@|%40|[\[(]\s?at\s?[\])]|\sdot\s")
LINK = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://\S+|\bwww\.\S+|(?<!\w)@\w+|\b[\w.\-]+@[\w.\-]+(?::\S+)?|\b[a-z]:\\\S+|(?<!\w)~?/\S*|\b(?=[\w/\\]*[^\W\d])\w+(?:[_/\\]\w+)+(?:\.\w+)?")

IDS = [
    re.compile(rf"(?i)(?:\b(?:{ID_CUES})\b\.?\s*[:#]?\s*)(?P<n>(?:[A-Z]{{0,2}} ?)?{DIGIT}[\dO \-–.]{{4,16}}[\dO](?:[-–]?[A-Z]\b)?)"),
    re.compile(rf"(?<![\w\-–.])(?P<n>{DIGIT}{{3}}[-–]{DIGIT}{{2}}[-–]{DIGIT}{{4}})(?![\w\-–])"),
    re.compile(r"(?<![\w\-–.])(?P<n>\d{8}[-–][A-Za-z])(?![\w\-–])"),
    re.compile(r"(?<![\w\-–.])(?P<n>\d{6}[-–+]\d{4})(?![\w\-–])"),
    re.compile(r"(?<![\w\-–.])(?P<n>[A-Z]{2}\d{6}[A-D]|[A-Z]{2} \d{2} \d{2} \d{2} [A-D])(?![\w\-–])"),
    re.compile(r"(?<![\w\-–.:])(?P<n>\d{2} \d{3} \d{3} \d{3})(?![\w\-–])"),
    re.compile(r"(?<![\w\-–.:])(?P<n>[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?)(?![\w\-–])"),
]
PHONES = [
    re.compile(rf"(?<![\w.\-–/@])(?P<n>(?:\+?1{DASH}?)?(?:\(\d{{3}}\){DASH}?|\d{{3}}{DASH}){DIGIT}{{3}}{DASH}[\dOIl]{{4}}(?:\s?(?:x|ext\.?)\s?\d{{1,6}})?)(?![\w\-–])"),
    re.compile(r"(?<![\w.\-–/@])(?P<n>\+\s?\d(?:[\s.\-–/()]{0,2}\d){7,14})(?!\w)"),
    re.compile(r"(?<![\w.\-–/@+])(?P<n>\(?0\d{1,4}\)?(?:[ .\-–/]\d{2,6}){1,5})(?![\w\-–:])"),
]
PHONE_CUE = re.compile(r"(?i)(?:tel|phone|fax|mobile?|mobil|cell|call|rückruf|handy|móvil|téléphone|☎)\W{0,4}(?:\w+\W{1,2})?$")
DATE = re.compile(r"^\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\b|^\d{4}-\d{2}-\d{2}")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]+"
ADDRESSES = [
    re.compile(rf"(?<![\w.\-:/])(?P<n>(?:(?i:flat|apt|apartment|unit|suite)\.?\s+\d+\w?\s*,?\s+)?\d{{1,5}}\s?[a-zA-Z]?\s+(?P<name>{_CAP}(?:\s{_CAP}){{0,2}})\s+(?P<street>(?i:{STREETS}))\b\.?(?P<more>\s*,?\s+(?i:apt|flat|unit|suite)\s+\d+)?)"),
    re.compile(rf"(?<![\w.\-:/])(?P<n>\d{{1,4}}\s?(?:bis|ter|BIS|TER|[a-zA-Z])?,?\s+(?i:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|cours|route)\s+(?i:de\s+la\s+|des\s+|du\s+|de\s+l['’]\s?|d['’]|de\s+)?{_CAP})"),
    re.compile(rf"(?<!\w)(?P<n>(?i:calle|c/|avda\.?|avenida|plaza|paseo|camino|carrera)\s+(?i:de\s+la\s+|del\s+|de\s+los\s+|de\s+las\s+|de\s+)?{_CAP}(?:\s{_CAP})?,?\s+\d{{1,4}}(?:\s*,\s*\d+[ºª]?\s?[A-Z])?)"),
    re.compile(r"(?<!\w)(?P<n>[A-ZÄÖÜ][\wäöüß]+(?i:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm)\s*\d{1,4}\s?[a-z]?)(?!\w)"),
    re.compile(r"(?<!\w)(?P<n>[A-ZÄÖÜ][\wäöüß]+\s(?i:straße|strasse|str\.|weg|gasse|platz|allee)\s+\d{1,4}\s?[a-z]?)(?!\w)"),
]
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: What stands before a name, up to where the name begins: slot h an honorific, g a greeting, k a key, i an initial.
SLOTS = {
    "i": re.compile(r"(?<![\w.@])[A-ZÀ-ÖØ-Þ]\s?\.\s*"),
    "k": re.compile(r"(?i)(?<!\w)(?:name|contact|author|user|owner|signed|kontakt|nom|nombre)[\"']?\s?[=:]\s?[\"']?"),
    "g": re.compile(rf"(?i)(?<!\w)(?:{GREETINGS})\b[\s:,.]*"),
    "h": re.compile(rf"(?i)(?<!\w)(?:{HONORIFICS})\.?\s+"),
}
#: Every identity or phone number holds five digits close to each other; every link, handle and path one of these signs.
MAY_HOLD_NUMBER = re.compile(r"[\dO](?:[\W_]{0,6}[\dOIl]){4}")
MAY_HOLD_LINK = re.compile(r"[/\\@_]|www\.", re.IGNORECASE)
UNBROKEN = re.compile(r"\S+")
DIGITS = re.compile(r"\d")
GAP = re.compile(r"^(?:[ \t\xa0]{1,2}|\s?,\s|[-–]|\s[A-ZÀ-ÖØ-Þ]\s?\.\s*)$")


def _digits(text: str) -> int:
    return sum(c.isdigit() or c == "O" for c in text)


def _letters(text: str) -> str:
    return text.lower().translate(str.maketrans("01359", "olesg"))


def names_a_thing(before: str) -> bool:
    """Does the text before a number name a thing (a lot, an order), also with one letter misread or a blank inside?"""
    if re.search(r"[-–—,;|]\s*$", before) and not before.endswith("-"):
        return False
    words = re.findall(r"\w+", _letters(before[-24:]))
    if not words:
        return False
    for word in (words[-1], "".join(words[-2:])):
        if word in THING_CUES or any(len(c) > 3 and len(c) == len(word) and sum(a != b for a, b in zip(c, word)) <= 1 for c in THING_CUES):
            return True
    return before.rstrip().endswith(("#", "ORD-")) or bool(re.search(r"(?i)[A-Z]{2,}-$", before))


def _blank_all(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with the spans of one pattern, which come in order, blanked out."""
    parts, at = [], 0
    for begin, end, _ in spans:
        parts += [text[at:begin], "\x00" * (end - begin)]
        at = end
    return "".join(parts) + text[at:]


def structured(text: str) -> tuple[list[tuple[int, int, str]], str]:
    """Spans of all kinds but persons, and the text with them, links, handles and paths blanked out (same length)."""
    spans: list[tuple[int, int, str]] = []
    rest = text
    if MAY_HOLD_EMAIL.search(text):
        for m in EMAIL.finditer(text):
            if (m["other"] or "").lower() in FILE_ENDINGS.split("|") or m["after"] or m["local"].lower() in ("git", "npm", "ssh") or "://" in text[max(0, m.start() - 3) : m.start()]:
                continue
            spans.append((m.start(), m.end("domain"), "email"))
        rest = _blank_all(rest, spans)
    if MAY_HOLD_LINK.search(rest):
        # none of them goes over a blank, so only what stands between two and holds a sign is looked at
        signed = (t.span() for t in UNBROKEN.finditer(rest) if MAY_HOLD_LINK.search(t.group()))
        rest = _blank_all(rest, [(m.start(), m.end(), "") for begin, end in signed for m in LINK.finditer(rest, begin, end) if m.end() - m.start() > 2])
    numbers = MAY_HOLD_NUMBER.search(rest) is not None
    for n, pattern in enumerate(IDS if numbers else ()):
        start = len(spans)
        for m in pattern.finditer(rest):
            b, e = m.span("n")
            before = rest[max(0, b - 40) : b]
            if n == 0:
                if _digits(m["n"]) < 5:
                    continue
            elif names_a_thing(before) or re.match(r"\s+rev\b", rest[e : e + 8]):
                continue
            spans.append((b, e, "id_number"))
        rest = _blank_all(rest, spans[start:])
    for n, pattern in enumerate(PHONES if numbers else ()):
        start = len(spans)
        for m in pattern.finditer(rest):
            b, e = m.span("n")
            count = _digits(m["n"])
            if not (9 if n else 10) <= count + sum(c in "Il" for c in m["n"]) <= 18 or DATE.match(m["n"]):
                continue
            before = rest[max(0, b - 30) : b]
            if n != 1 and not PHONE_CUE.search(before) and (names_a_thing(before) or re.match(r"(?:\s+\w+)?\s+\d*\s*pcs\b", rest[e : e + 24])):
                continue
            spans.append((b, e, "phone"))
        rest = _blank_all(rest, spans[start:])
    for n, pattern in enumerate(ADDRESSES if DIGITS.search(rest) else ()):
        start = len(spans)
        for m in pattern.finditer(rest):
            b, e = m.span("n")
            if n == 0 and re.search(r"(?i)\bof\s*$", rest[max(0, b - 40) : b]):
                continue
            if n == 0 and m["street"].islower() and not m["name"].istitle():
                continue
            spans.append((b, e, "address"))
        rest = _blank_all(rest, spans[start:])
    return spans, rest


def name_terms(rest: str) -> list[tuple[int, int, str, str]]:
    """Words that may be names: (begin, end, term, slot); slot: 'h' honorific, 'g' greeting, 'k' key, 'i' initial, '' none."""
    # where each slot ends a name may begin; the stronger slot counts
    slots = {m.end(): slot for slot, pattern in SLOTS.items() for m in pattern.finditer(rest)}
    out = []
    for m in WORD.finditer(rest):
        begin, end = m.span()
        slot = slots.get(begin, "")
        if end - begin > 1 and (rest[begin].isupper() or slot == "k"):
            out.append((begin, end, m.group().lower(), slot))
    return out


_RECORD = "tbl string, rec_id bigint, spans array<struct<b:int,e:int,kind:string>>, terms array<struct<b:int,e:int,term:string,slot:string>>, pairs array<struct<l:string,r:string>>, word string, n bigint"
_SPAN = pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32()), ("kind", pa.string())]))
_TERM = pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32()), ("term", pa.string()), ("slot", pa.string())]))
_PAIR = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with their spans, possible name terms and neighbouring term pairs; then word counts (tbl null)."""
    counts: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        words, n = list(counts), list(counts.values())
        counts.clear()
        size = len(words)
        return pa.RecordBatch.from_arrays([pa.nulls(size, pa.string()), pa.nulls(size, pa.int64()), pa.nulls(size, _SPAN), pa.nulls(size, _TERM), pa.nulls(size, _PAIR), pa.array(words, pa.string()), pa.array(n, pa.int64())], names)

    names = ["tbl", "rec_id", "spans", "terms", "pairs", "word", "n"]
    for batch in batches:
        spans, terms, pairs = [], [], []
        for text in batch.column(2).to_pylist():
            found, rest = structured(text)
            possible = name_terms(rest)
            counts.update(WORD.findall(rest.lower()))
            possible_names = [t for t in possible if not NOT_A_NAME.fullmatch(t[2])]
            near = [("<" + t[3] + ">", t[2]) for t in possible_names if t[3] in ("h", "i", "k")]
            near += [(x[2], y[2]) for x, y in zip(possible_names, possible_names[1:]) if y[0] - x[1] <= 6 and GAP.match(rest[x[1] : y[0]])]
            spans.append([{"b": b, "e": e, "kind": k} for b, e, k in found])
            terms.append([{"b": b, "e": e, "term": t, "slot": s} for b, e, t, s in possible])
            pairs.append([{"l": x, "r": y} for x, y in near])
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPAN), pa.array(terms, _TERM), pa.array(pairs, _PAIR), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64())], names)
        if len(counts) > 500_000:
            yield counted()
    yield counted()


def scan_texts(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One scan of all texts: {name: (table, id column, text column)}; a row delivered again counts once."""
    parts = [df.select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("rec_id"), F.col(text).alias("text")).where("rec_id is not null and text is not null") for name, (df, key, text) in tables.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # a fixed number of parts: the scan behind it is bound by CPU, so small parts must not be put together by their bytes
    session = union.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return union.repartition(parts, "tbl", "rec_id").groupBy("tbl", "rec_id").agg(F.max("text").alias("text")).select("tbl", "rec_id", "text")


def disclosure(scanned: DataFrame, known: DataFrame, rounds: int = 2) -> DataFrame:
    """(term, n, a, known, bits, strong): how strongly a term reveals that a person is named, from the whole corpus.

    Of a term's n occurrences, a stand beside a name, an initial, an honorific or a name key. The
    first round counts beside the known names, the next also beside terms learned before.
    """
    counts = scanned.where("word is not null").groupBy(F.col("word").alias("term")).agg(F.sum("n").alias("n"))
    both = scanned.where("pairs is not null").select(F.explode("pairs").alias("p")).select("p.l", "p.r").groupBy("l", "r").agg(F.count("*").alias("n"))
    sided = durable(both.select(F.col("l").alias("other"), F.col("r").alias("term"), "n").union(both.where("l not like '<%'").select("r", "l", "n")))
    listed = known.select(F.explode(F.split(F.lower(F.trim("name_text")), r"[\s-]+")).alias("term")).where("term <> ''").distinct().withColumn("known", F.lit(True))
    total = durable(counts)
    seeds = listed.select(F.col("term").alias("other"))
    scored = None
    for _ in range(rounds):
        beside = sided.where("other like '<%'").select("term", "n").union(sided.join(seeds, "other").select("term", "n"))
        near = beside.groupBy("term").agg(F.sum("n").alias("a"))
        scored = total.join(near, "term", "left").join(listed, "term", "left").where("a is not null or known")
        scored = scored.select("term", "n", F.least("n", F.coalesce("a", F.lit(0))).alias("a"), F.coalesce("known", F.lit(False)).alias("known"))
        scored = with_bits(scored)
        seeds = scored.where("strong").select(F.col("term").alias("other"))
    return scored


#: Disclosure thresholds in bits: a term reveals a person by itself where that is as likely as not; a listed name needs odds of 3 to 7.
REVEALS = 0.0
LISTED_REVEALS = math.log2(0.3 / 0.7)
#: A listed name seen less often than this reveals a person whatever stands beside it.
RARE = 3


def with_bits(scored: DataFrame) -> DataFrame:
    """(term, n, a, known, bits, strong): the odds, in bits, that a term names a person where it stands, and whether they reach the threshold.

    Of n occurrences a are beside names; a term that is no listed name counts one occurrence more elsewhere.
    """
    elsewhere = F.col("n") - F.col("a") + F.when(F.col("known"), 0).otherwise(1)
    bits = F.log2(F.greatest(F.col("a"), F.lit(1e-9)) / F.greatest(elsewhere, F.lit(1e-9)))
    strong = (F.col("bits") >= REVEALS - 1e-12) | (F.col("known") & ((F.col("bits") >= LISTED_REVEALS - 1e-12) | (F.col("n") < RARE)))
    return scored.withColumn("bits", bits).withColumn("strong", strong)


def _detected(tables: dict[str, tuple[DataFrame, str, str]], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = scan_texts(tables)
    scanned = durable(texts.mapInArrow(_scan, _RECORD))
    lexicon = disclosure(scanned, known).select("term", "known", "strong")
    records = scanned.where("tbl is not null")
    terms = records.select("tbl", "rec_id", F.explode("terms").alias("t")).select("tbl", "rec_id", "t.*")
    in_slot = terms.join(lexicon, "term", "left").where("strong or slot = 'h' or (known and slot in ('g', 'i', 'k'))")
    fixed = records.select("tbl", "rec_id", F.explode("spans").alias("s")).select("tbl", "rec_id", "s.b", "s.e", "s.kind")
    return texts, fixed.unionByName(in_slot.select("tbl", "rec_id", "b", "e", F.lit("person").alias("kind")))


def personal_kinds(tables: dict[str, tuple[DataFrame, str, str]], known: DataFrame) -> DataFrame:
    """(tbl, rec_id, kind): the kinds of personal information each record's text holds at least once.

    Emails, phone and identity numbers and street addresses are found by their forms, also written
    unusually; what numbers of things look like is told apart by the word before. Persons are
    terms whose disclosure, estimated from co-occurrence over all texts with the known names as seeds,
    exceeds the threshold, words after an honorific, and listed names that are ordinary words too
    where somebody is addressed. Names inside emails, links, handles and paths do not count. Rows
    without id or text give nothing; a row delivered again counts once.
    """
    return _detected(tables, known)[1].select("tbl", "rec_id", "kind").distinct()


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            merged: list[list] = []
            for s in sorted(spans or [], key=lambda s: (s["b"], -s["e"])):
                if merged and s["b"] < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["e"])
                elif merged and merged[-1][2] == s["kind"] == "person" and GAP.match(text[merged[-1][1] : s["b"]]):
                    merged[-1][1] = s["e"]
                else:
                    merged.append([s["b"], s["e"], s["kind"]])
            at, parts = 0, []
            for b, e, kind in merged:
                parts += [text[at:b], f"[{kind.upper()}]"]
                at = e
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["tbl", "rec_id", "text"])


def revealing_terms(tables: dict[str, tuple[DataFrame, str, str]], known: DataFrame) -> DataFrame:
    """(term, n, a, bits, strong): every scored term with its disclosure in bits and whether it is above the threshold."""
    return disclosure(durable(scan_texts(tables).mapInArrow(_scan, _RECORD)), known).select("term", "n", "a", "bits", "strong")


def redacted_texts(tables: dict[str, tuple[DataFrame, str, str]], known: DataFrame) -> DataFrame:
    """(tbl, rec_id, text): every record's text with typed placeholders such as [EMAIL] and [PERSON] in place of what was found; names that stand together become one placeholder."""
    texts, spans = _detected(tables, known)
    grouped = spans.groupBy("tbl", "rec_id").agg(F.collect_list(F.struct("b", "e", "kind")).alias("spans"))
    return texts.join(grouped, ["tbl", "rec_id"], "left").select("tbl", "rec_id", "text", "spans").mapInArrow(_replace, "tbl string, rec_id bigint, text string")
