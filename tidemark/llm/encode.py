"""Token ids of a whole corpus by a public byte-level tokenizer."""

from __future__ import annotations

import base64
import itertools
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import spread

#: Where the public vocabularies lie; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes looked at in one step; how many fragments of up to how many bytes a worker remembers the ids of.
WINDOW_BYTES = 8 << 20
REMEMBERED = 400_000
REMEMBERED_BYTES = 64


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def inner_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256 table: does this byte pair occur inside any vocabulary token?"""
    seen = np.zeros((256, 256), bool)
    for token in ranks:
        if len(token) > 1:
            run = np.frombuffer(token, np.uint8)
            seen[run[:-1], run[1:]] = True
    return seen


def _ascii(signs: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(signs.encode())] = True
    return table


_LETTERS, _DIGITS = _ascii(string.ascii_letters), _ascii(string.digits)
_BLANKS, _SIGNS = _ascii(" \n"), _ascii(string.ascii_letters + string.digits + string.punctuation)
#: First bytes of two-byte characters from U+00C0 on: no blanks among them.
_PLAIN_LEADS = np.isin(np.arange(256), np.arange(0xC3, 0xE0))


class ForcedBoundaryEncoder:
    """Cuts texts at all forced boundaries, encodes each different fragment once and puts the ids together.

    A byte pair that no vocabulary token contains can't be merged over, so a token boundary lies
    between its bytes whatever surrounds it. Of these places a cut is made where the
    pre-tokenisation on both sides stays the same too: before a blank that follows a sign, and
    between two letters or two digits. One table lookup for each byte finds them all.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        ranks = read_ranks(vocabulary)
        left, right = np.ogrid[:256, :256]
        free = ~inner_pairs(ranks)
        plain = (_BLANKS[right] & _SIGNS[left]) | (_LETTERS[left] & _LETTERS[right]) | (_DIGITS[left] & _DIGITS[right])
        #: For each byte pair: may a fragment begin at its second byte? 2: if the first one ends a letter beyond ASCII.
        self.places = (np.where(plain, 1, np.where(_BLANKS[right] & (left >= 0x80), 2, 0)) * free).astype(np.uint8).reshape(-1)
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[bytes, list[int]] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in UTF-8 bytes where a fragment may begin; a place at a text's own edge is one more, for the caller to add."""
        found = []
        for begin in range(0, max(len(data) - 1, 0), WINDOW_BYTES):
            left, right = data[begin : begin + WINDOW_BYTES][: len(data) - 1 - begin], data[begin + 1 : begin + 1 + WINDOW_BYTES]
            place = self.places[(left.astype(np.uint16) << 8) | right]
            at = np.flatnonzero(place) + begin + 1
            unsure = at[place[at - begin - 1] == 2]
            unsure = unsure[(unsure < 2) | ~_PLAIN_LEADS[data[unsure - 2]]]
            found.append(np.setdiff1d(at, unsure, assume_unique=True) if len(unsure) else at)
        return np.concatenate(found) if found else np.array([], np.int64)

    def fragments(self, text: str) -> list[str]:
        """Parts of ``text`` whose ids, one after the other, are the ids of ``text``."""
        raw = text.encode()
        edges = [0, *self.cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
        return [raw[b:e].decode() for b, e in zip(edges, edges[1:])]

    def _ids_of(self, fragment: bytes) -> list[int]:
        ids = self.known.get(fragment)
        if ids is None:
            ids = self.encode(fragment.decode())
            if len(fragment) <= REMEMBERED_BYTES:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[fragment] = ids
        return ids

    def batch(self, texts: pa.Array) -> pa.ListArray:
        """Token ids of each text; a null or empty text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        if first == last:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.cuts(data)] = True
        edge[offsets - first] = True  # both ends of every text
        edges = np.flatnonzero(edge)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        distinct = pieces.dictionary_encode()
        ids = [self._ids_of(fragment) for fragment in distinct.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, sizes.sum())
        which = distinct.indices.to_numpy(zero_copy_only=False)
        # fragment k takes its ids from where they begin in flat
        counts = sizes[which]
        ends = np.cumsum(counts)
        starts = (np.cumsum(sizes) - sizes)[which]
        values = flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.searchsorted(edges, offsets - first)]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))

    def ids(self, text: str | None) -> list[int]:
        """Token ids of one text."""
        return self.batch(pa.array([text], pa.string()))[0].as_py()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> ForcedBoundaryEncoder:
    """One encoder for each Python worker."""
    return ForcedBoundaryEncoder(vocabulary)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids, n_tokens) of every row by the tokenizer, without special tokens.

    Null and empty texts have the empty list; blank texts have the ids of their blanks. The strings
    of special tokens inside a text are ordinary text. Every row, also one with a repeated or null key, keeps
    its own row. Other columns are not read. Every text is cut at its forced boundaries, whatever its length, where it was
    read: no text is shuffled for its size.
    """
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), own.batch(batch.column(1))], ["key", "ids"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids", F.size("ids").alias("n_tokens"))
