"""Text extraction and rewriting as column expressions. Order is meaning: each step sees the one before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a compound name, an acronym, a dotted name, a keyword.
CAMEL = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"
ACRONYM = r"\b([A-Z]{2,6})\b"
DOTTED = r"\b([A-Z][a-z]+\.[a-z]{1,4})\b"
KEYWORD = r"\b[a-z][a-z0-9_.-]+\b"
DOMAIN = r"\b[\w-]+\.(?:com|io|dev|ai|app|co)\b"
COMMON_ACRONYMS = "OK AM PM US UK EU ID UI UX OS PC TV AC DC IT AI ML OR AN AS AT BE BY DO GO IF IN IS MY NO OF ON SO TO UP WE".split()
MIN_PHRASE = 6

# Fillers, repeated words and contractions of dictated text.
FILLERS = r"(?i)\b(uh|um|uhm|erm|hmm|hm|like,?\s*(?=like)|you know,?\s*(?=you know)|so,?\s*(?=so)|basically|actually,?\s*(?=actually)|literally)\b"
DOUBLED = "the a an is in on to of and it we he she".split()
SPOKEN = {"gonna": "going to", "wanna": "want to", "gotta": "got to", "kinda": "kind of", "sorta": "sort of", "lemme": "let me", "gimme": "give me", "dunno": "don't know", "cuz": "because"}
# Names of punctuation in dictated text.
PUNCTUATION = {
    "period": ".", "full stop": ".", "comma": ",", "exclamation point": "!", "exclamation mark": "!", "question mark": "?", "colon": ":", "semicolon": ";", "semi colon": ";", "dash": " —",
    "hyphen": "-", "open parenthesis": "(", "close parenthesis": ")", "open bracket": "[", "close bracket": "]", "ellipsis": "...", "dot dot dot": "...", "new line": "\n", "newline": "\n", "new paragraph": "\n\n",
}
# How an answer begins that is no cleaned text.
CHATTY_STARTS = [
    "I don't see any text", "I'm ready to", "I can help", "Could you provide", "Could you please", "There doesn't seem", "I notice you", "It seems like you", "Please provide",
    "Please share", "However, I don't", "However, I can't", "I'd be happy to", "I don't have", "No text was provided", "The text appears to be empty", "You haven't provided", "I'm sorry, but",
]
# Secrets, in the order in which they are replaced.
SECRETS = [
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED:AWS_KEY]"),
    (r"(?i)(?:aws_secret|secret_access_key)\s*[:=]\s*\S{20,60}", "[REDACTED:AWS_SECRET]"),
    (r"\bsk-[a-zA-Z0-9_-]{20,}\b", "[REDACTED:API_KEY]"),
    (r"\bsk-ant-[a-zA-Z0-9_-]{20,}\b", "[REDACTED:API_KEY]"),
    (r"\bgh[ps]_[a-zA-Z0-9]{36,}\b", "[REDACTED:GH_TOKEN]"),
    (r"\bgho_[a-zA-Z0-9]{36,}\b", "[REDACTED:GH_TOKEN]"),
    (r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*\S{6,}", "[REDACTED:CREDENTIAL]"),
    (r"\beyJ[a-zA-Z0-9_-]{20,}\.eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}\b", "[REDACTED:JWT]"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[REDACTED:CC]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED:SSN]"),
    (r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "[REDACTED:PRIVATE_KEY]"),
    (r"(?i)(?:mysql|postgres|mongodb|redis)://\S+:\S+@", "[REDACTED:CONN_STRING]://***:***@"),
    (r"(?i)bearer\s+[a-zA-Z0-9_.-]{20,}", "[REDACTED:BEARER]"),
]
# How former names are told of, and names in quotation marks.
FORMER = (r"(?i)(?:formerly|previously|renamed from|was)\s+(\w+)", r"(?i)\((?:was|née|aka)\s+(\w+)\)")
QUOTED = r"[\"']([A-Z][a-zA-Z]{4,})[\"']"
# What is tidied after spoken punctuation, before and after "..." is put back.
DOUBLED_SIGNS = ((r"[,;]+([.!?:;\n])", "$1"), (r"([!?])[.,]+", "$1"), (r"\.([!?])", "$1"), (r"([.!?])[.,;:]+", "$1"), (r"([.!?:;,]) +([.!?:;,])", "$2"))
SPACING = ((r"([.!?:;,])([A-Za-z])", "$1 $2"), (r"(\() ", "$1"), (r"\s+$", ""), (r"^ +", ""), (r"\n ", "\n"))
# Words that mark a change of style, not of hearing.
STYLE_WORDS = "pretty cool great nice good awesome amazing yeah yep yup yes nope no nah kinda gonna wanna gotta lemme okay ok alright sure right just really very quite totally raw cleaned".split()


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def camel_words(text: Column, min_chars: int = 1) -> Column:
    """Compound names such as ReportColumn, in order, repeats kept; none for null."""
    return F.filter(_all(text, CAMEL), lambda w: F.length(w) >= min_chars)


def acronyms(text: Column) -> Column:
    """Acronyms of two to six letters that are no common ones."""
    return F.filter(_all(text, ACRONYM), lambda w: ~w.isin(COMMON_ACRONYMS))


def dotted_names(text: Column) -> Column:
    """Names such as Node.js."""
    return _all(text, DOTTED)


def camel_phrase(name: Column) -> Column:
    """'QueueMaster' -> 'queue master'; null for a single word or a phrase under six characters."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    phrase = F.lower(F.trim(spaced))
    return F.when(F.contains(phrase, F.lit(" ")) & (F.length(phrase) >= MIN_PHRASE), phrase)


def camel_parts(name: Column) -> Column:
    """The whole name and its parts of more than two letters, in lower case, once each."""
    parts = F.filter(F.split(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"\s+"), lambda p: F.length(p) > 2)
    return F.array_distinct(F.concat(F.array(F.lower(name)), F.transform(parts, F.lower)))


def section(text: Column, heading: str) -> Column:
    """The body under '## heading' up to the next such heading, trimmed; '' when there is none."""
    return F.regexp_replace(F.regexp_extract(text, rf"(?ms)^##[ \t]+{heading}[ \t]*\n(.*?)(?=^##\s|\z)", 1), r"^\s+|\s+$", "")


def bullets(body: Column) -> Column:
    """The lines of a list, longer than three characters, without their marks."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x.rlike(r"^[-*]") & (F.length(x) > 3)), lambda x: F.trim(F.regexp_replace(x, r"^[-* ]+", "")))


def keywords(text: Column, stop: list[str], min_chars: int = 4) -> Column:
    """Distinct lower-case keywords that are no stop words."""
    return F.array_distinct(F.filter(_all(F.lower(text), KEYWORD, 0), lambda w: (F.length(w) >= min_chars) & ~w.isin(stop)))


def domains(text: Column) -> Column:
    """Distinct web domains, in lower case."""
    return F.array_distinct(F.transform(_all(text, DOMAIN, 0), F.lower))


def aliases(text: Column) -> Column:
    """Former names a text tells of."""
    return F.array_distinct(F.concat(*(_all(text, pattern) for pattern in FORMER)))


def redacted(text: Column) -> Column:
    """The text with secrets replaced, pattern after pattern."""
    return reduce(lambda t, step: F.regexp_replace(t, step[0], step[1].replace("$", "\\$")), SECRETS, text)


def _capitals(text: Column) -> Column:
    """The first letter of the text and of each sentence after it in upper case."""
    pieces = F.split(text, r"(?<=[.!?]\s{1,9})(?=[a-z])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2_000_000_000))), "")


def untitled(text: Column) -> Column:
    """Lower-cases words capitalised at random: if of at least three longer words after the first at least 40 % are title-cased.

    Words that begin a sentence, 'I' and words in capitals stay. Runs of blanks become one when the rule applies.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1)))
    titled = lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}") & (F.upper(w) != w)
    count = F.size(F.filter(rest, titled))
    alpha = F.size(F.filter(rest, lambda w: (F.length(w) > 1) & w.rlike(r"^\p{L}")))
    lowered = F.transform(words, lambda w, i: F.when((i > 0) & titled(w) & ~((i > 1) & F.get(words, i - 1).rlike(r"[.!?]$")), F.lower(w)).otherwise(w))
    return F.when((F.size(words) > 2) & (alpha >= 3) & (count >= 0.4 * alpha), F.array_join(lowered, " ")).otherwise(text)


def cleaned(text: Column) -> Column:
    """Dictated text tidied: fillers, random capitals, doubled words, contractions, 'i', spacing, capitals, final point. Null and '' stay."""
    t = untitled(F.regexp_replace(text, FILLERS, ""))
    for word in DOUBLED:
        t = F.regexp_replace(t, rf"(?i)\b({word})\s+\1\b", "$1")
    for said, meant in SPOKEN.items():
        t = F.regexp_replace(t, rf"(?i)\b{said}\b", meant)
    t = F.regexp_replace(t, r"\bi\b", "I")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+([,;:.!?])", "$1"), r"([,;:])([A-Za-z])", "$1 $2")
    t = _capitals(F.trim(F.regexp_replace(t, r"\s{2,}", " ")))
    return F.when(text == "", "").otherwise(F.when(t.rlike(r"[.!?]$") | (t == ""), t).otherwise(F.concat(t, F.lit("."))))


def is_chatty(text: Column) -> Column:
    """Is this an answer about the task instead of cleaned text?"""
    low = F.lower(text)
    starts = reduce(lambda a, b: a | b, (F.startswith(low, F.lit(s.lower())) for s in CHATTY_STARTS))
    return F.coalesce(starts | (F.contains(low, F.lit("voice dictation")) & F.contains(low, F.lit("clean up"))), F.lit(False))


def guarded_clean(raw: Column, answer: Column) -> Column:
    """An outside clean-up if it is none of a chat and at most three times as long as the raw text, else the rule-based one."""
    good = answer.isNotNull() & (answer != "") & ~is_chatty(answer) & (F.length(answer) <= 3 * F.length(raw))
    return F.when(F.coalesce(good, F.lit(False)), answer).otherwise(cleaned(raw))


def punctuated(text: Column) -> Column:
    """Spoken names of punctuation replaced by the signs, longest first, and what stands doubled after it tidied."""
    t = text
    for word, sign in sorted(PUNCTUATION.items(), key=lambda x: -len(x[0])):
        t = F.regexp_replace(t, rf"(?i)[,;:.!?\s]*\b{word}\b[,;:.!?]*", sign)
    t = F.replace(t, F.lit("..."), F.lit("\x01"))
    for pattern, sign in DOUBLED_SIGNS:
        t = F.regexp_replace(t, pattern, sign)
    t = F.replace(t, F.lit("\x01"), F.lit("..."))
    for pattern, sign in SPACING:
        t = F.regexp_replace(t, pattern, sign)
    return t


def with_vocabulary(text: Column, vocabulary: dict[str, str]) -> Column:
    """Known mishearings replaced, longest first, whole words, any case; later entries see what earlier ones wrote."""
    escape = lambda s: "".join(c if c.isalnum() or c in " _" else "\\" + c for c in s)
    steps = sorted(vocabulary.items(), key=lambda x: (-len(x[0]), x[0]))
    return reduce(lambda t, step: F.regexp_replace(t, rf"(?i)\b{escape(step[0])}\b", step[1].replace("\\", "\\\\").replace("$", "\\$")), steps, text)


def is_style_change(raw: Column, clean: Column) -> Column:
    """Is the new word a matter of style: a style word, the same but for signs, one letter, or of quite another length?"""
    r, c = (F.regexp_replace(F.lower(x), r"^[.,!?]+|[.,!?]+$", "") for x in (raw, clean))
    n, m = F.length(r), F.length(c)
    return r.isin(STYLE_WORDS) | c.isin(STYLE_WORDS) | (r == c) | (n <= 1) | (m <= 1) | (n > 3.0 * m) | (n < 0.33 * m)


def letter_overlap(a: Column, b: Column) -> Column:
    """Shared letters over the larger of both letter sets; 0 for empty."""
    letters = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), ""), lambda c: c != ""))
    x, y = letters(a), letters(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.greatest(F.size(x), F.size(y))), F.lit(0.0))


def unlike_short_words(a: Column, b: Column) -> Column:
    """Do two words of at most six letters share under 0.4 of the longer's letters?"""
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    return (F.length(a) <= 6) & (F.length(b) <= 6) & (F.size(F.array_intersect(letters(a), letters(b))) < 0.4 * F.greatest(F.length(a), F.length(b)))


def prompt_of(words: Column, max_chars: int = 200) -> Column:
    """Distinct words (any case, first spelling) joined by commas, cut at the last whole word within the length."""
    low = F.transform(words, F.lower)
    first = F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    joined = F.array_join(first, ", ")
    cut = F.substring(joined, 1, max_chars)
    at = F.length(cut) - F.instr(F.reverse(cut), " ,") - 1
    return F.when(F.length(joined) <= max_chars, joined).otherwise(F.when(F.contains(cut, F.lit(", ")), F.substring(cut, F.lit(1), at)).otherwise(cut))


def snippet(text: Column, chars: int) -> Column:
    """The beginning of a text on one line."""
    return F.regexp_replace(F.substring(text, 1, chars), r"[\r\n]+", " ")


def time_label(seconds: Column, pattern: str = "HH:mm:ss") -> Column:
    """An epoch time in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def audio_seconds(n_bytes: Column) -> Column:
    """Length of 16 kHz, 16-bit mono audio."""
    return n_bytes / (16_000 * 2)


def context_names(text: Column, chars: int = 2000) -> Column:
    """Compound names of six letters or more and quoted capitalised names of five or more in the beginning of a text, once each."""
    head = F.substring(text, 1, chars)
    return F.array_distinct(F.concat(camel_words(head, MIN_PHRASE), _all(head, QUOTED)))
