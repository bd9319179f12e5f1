"""Word-level BPE through a lexicon: a minimal acyclic transducer of frequent words.

Words of letters are counted over all documents. The frequent ones, with their ids, are
compiled into the smallest acyclic automaton that accepts them: equal suffixes share
states. Each arc adds a number, and the sum along a word is its rank, which points at its
ids. The compiled file is sent to the executors by Spark and memory-mapped there. A word
that the automaton does not accept is merged exactly; so are numbers and punctuation. Texts
with special tokens or characters beyond plain Latin are encoded by the tokenizers library
itself. In others, unseen pieces are merged, a text at a time, by tiktoken's merge loop over
the same vocabulary, which takes a fifteenth of the time: the end of a word is one more
byte there, first to be merged, as the vocabulary's symbols with a word end are its first.

Encoding equals the tokenizers library without special tokens added, decoding equals its
``decode(ids, skip_special_tokens=False)`` for a vocabulary without a decoder: tokens joined
by spaces. A null text counts as empty and has no ids.
"""

from __future__ import annotations

import functools
import json
import mmap
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from heatlens.llm.common import chunks, text_of
from heatlens.llm.tokens import byte_alphabet

# The lexicon holds so many words at most; the rest is merged.
LEXICON_WORDS = 1 << 16
LEAST_COUNT = 3
# Merged words that a worker remembers before it starts anew.
MERGED_WORDS = 1 << 17

# The tokenizer's pattern, for texts without ``_OTHER``: \p{L} and \p{N} written out for their characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w]|_)+")
_NO_LETTERS = r"[^a-zß-öø-ÿ]+"
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-įı-ɏ]|<\|")


# ---- compiling


class _State:
    __slots__ = ("arcs", "final", "number")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1

    def key(self) -> tuple:
        return self.final, tuple((b, id(s)) for b, s in self.arcs.items())


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of (word, ids) pairs, ascending by word, as one block of bytes: a line of
    JSON with the place and length of each array, then the arrays."""
    root, shared, path, last = _State(), {}, [], b""
    starts, all_ids = [0], []

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            parent.arcs[byte] = shared.setdefault(child.key(), child)

    for word, ids in words:
        common = len(os.path.commonprefix([word, last]))
        settle(common)
        state = path[-1][2] if path else root
        for byte in word[common:]:
            child = _State()
            state.arcs[byte] = child
            path.append((state, byte, child))
            state = child
        state.final = True
        last = word
        all_ids.extend(ids)
        starts.append(len(all_ids))
    settle(0)

    order: list[_State] = []
    stack = [root]
    while stack:
        state = stack.pop()
        if state.number < 0:
            state.number = len(order)
            order.append(state)
            stack.extend(state.arcs.values())
    accepted: dict[int, int] = {}

    def accepts(state: _State) -> int:  # words from here; depth is that of the longest word
        if state.number not in accepted:
            accepted[state.number] = state.final + sum(map(accepts, state.arcs.values()))
        return accepted[state.number]

    first, labels, targets, adds = [0], bytearray(), [], []
    for state in order:
        rank = int(state.final)
        for byte, child in sorted(state.arcs.items()):
            labels.append(byte)
            targets.append(child.number)
            adds.append(rank)
            rank += accepts(child)
        first.append(len(labels))
    arrays = {
        "first": np.array(first, "<i4"),
        "targets": np.array(targets, "<i4"),
        "adds": np.array(adds, "<i4"),
        "final": np.array([s.final for s in order], "u1"),
        "labels": np.frombuffer(bytes(labels), "u1"),
        "starts": np.array(starts, "<i4"),
        "ids": np.array(all_ids, "<u4"),
    }
    head, body = {}, b""
    for name, array in arrays.items():
        head[name] = (len(body), array.nbytes)
        body += array.tobytes() + b"\0" * (-array.nbytes % 8)
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    return line + body


class Lexicon:
    """A compiled lexicon, memory-mapped. ``get(word)``: its ids as bytes (uint32, little endian), or None."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        begin = self._map.find(b"\n") + 1
        head = json.loads(self._map[:begin])
        view = memoryview(self._map)

        def part(name: str, kind: str):
            at, size = head[name]
            return view[begin + at : begin + at + size].cast(kind)

        self._first, self._targets, self._adds = part("first", "i"), part("targets", "i"), part("adds", "i")
        self._final, self._starts, self._ids = part("final", "B"), part("starts", "i"), part("ids", "I")
        self._labels = begin + head["labels"][0]

    def get(self, word: bytes) -> bytes | None:
        state, rank, base, first = 0, 0, self._labels, self._first
        find = self._map.find
        for byte in word:
            at = find(byte.to_bytes(), base + first[state], base + first[state + 1])
            if at < 0:
                return None
            at -= base
            rank += self._adds[at]
            state = self._targets[at]
        if not self._final[state]:
            return None
        return self._ids[self._starts[rank] : self._starts[rank + 1]].tobytes()


def _word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: lower-case words of plain letters, counted over some rows each time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = pc.split_pattern_regex(pc.utf8_lower(batch["text"]), _NO_LETTERS).flatten()
            counts = pc.value_counts(words)
            yield pa.record_batch({"word": counts.field("values"), "n": counts.field("counts")})

    return docs.select(text_of().alias("text")).mapInArrow(count, "word string, n long").filter("word <> ''")


def frequent_words(docs: DataFrame) -> list[str]:
    """The most frequent lower-case words of plain letters, counted over all documents: all
    words from the smallest power of two of occurrences that leaves at most ``LEXICON_WORDS``."""
    counted = _word_counts(docs).groupBy("word").agg(F.sum("n").alias("count"))
    counted = counted.filter(F.col("count") >= LEAST_COUNT).withColumn("scale", F.floor(F.log2("count")))
    counted.persist()
    try:
        scales = sorted(((r.scale, r["count"]) for r in counted.groupBy("scale").count().collect()), reverse=True)
        total, lowest = 0, None
        for scale, n in scales:
            total += n
            if total > LEXICON_WORDS:
                break
            lowest = scale
        if lowest is None:
            return []
        return [r.word for r in counted.filter(F.col("scale") >= lowest).select("word").collect()]
    finally:
        counted.unpersist()


def build_lexicon(docs: DataFrame, vocabulary: str) -> str:
    """Compile the lexicon of ``docs``, send it to the executors, and return its file's name there."""
    words = sorted((w.encode() for w in frequent_words(docs)))
    tokenizer = Tokenizer.from_file(vocabulary)
    encoded = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False) if words else []
    data = compile_lexicon((w, e.ids) for w, e in zip(words, encoded))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    # Spark's file server copies it at once; executors fetch it from the driver.
    folder = tempfile.mkdtemp(prefix="lexicon-")
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(path)
    return name


# ---- encoding


class WordBpe:
    """Encodes with a lexicon; one instance per Python worker."""

    def __init__(self, vocabulary: str, lexicon: str):
        self.exact = Tokenizer.from_file(vocabulary)
        self.lexicon = Lexicon(SparkFiles.get(lexicon))
        self.tokens = {i: t for t, i in self.exact.get_vocab(with_added_tokens=True).items()}
        self._token_of = np.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], dtype=object)
        self.known: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}
        alphabet, ranks = byte_alphabet(), {}
        for token, i in self.exact.get_vocab(with_added_tokens=False).items():
            word_end = token.endswith("</w>")
            raw = bytes(map(alphabet.__getitem__, token.removesuffix("</w>"))) if not token.startswith("<|") else None
            if raw is not None:
                ranks[raw + b"\0" * word_end] = i
        self._fast = tiktoken.Encoding(vocabulary, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self._ends = np.array([self.tokens.get(i, "").endswith("</w>") for i in range(max(self.tokens) + 1)])

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Exact ids of plain pieces that are not in the lexicon."""
        if not pieces:
            return []
        ids = self._fast.encode_to_numpy("\0".join(pieces) + "\0", disallowed_special=()).astype("<u4", copy=False)
        ends = (4 * np.flatnonzero(self._ends[ids]) + 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids (uint32, little endian) and the decoded text."""
        if _OTHER.search(text):
            ids = self.exact.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes(), " ".join(map(self.tokens.__getitem__, ids))
        pieces = _PIECE.findall(text.lower())
        found = list(map(self.known.get, pieces))
        if None in found:
            unseen = []
            for i in [i for i, f in enumerate(found) if f is None]:
                piece = pieces[i]
                if ids := self.merged.get(piece):
                    found[i] = ids
                elif ids := self.lexicon.get(piece.encode()):  # at most as many as the lexicon has words
                    found[i] = self.known[piece] = ids
                elif len(piece) == 1:  # of a few hundred plain characters
                    found[i] = self.known[piece] = self.merge([piece])[0]
                else:
                    unseen.append(i)
            for i, ids in zip(unseen, self.merge([pieces[i] for i in unseen]), strict=True):
                found[i] = ids
                if len(pieces[i]) <= 64:
                    self.merged[pieces[i]] = ids
            if len(self.merged) > MERGED_WORDS:
                self.merged.clear()
        ids = b"".join(found)
        return ids, " ".join(self._token_of[np.frombuffer(ids, "<u4")].tolist())


@functools.lru_cache(maxsize=2)
def word_bpe(vocabulary: str, lexicon: str) -> WordBpe:
    return WordBpe(vocabulary, lexicon)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` (uint32, little endian), ``decoded`` of every row."""
    name = build_lexicon(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary, name)
        for batch in chunks(batches, 256):
            found = [bpe.encode(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "ids": pa.array([f[0] for f in found], pa.binary()),
                    "decoded": pa.array([f[1] for f in found], pa.string()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")
