"""Operator 9: cost-balanced packing of documents into sequences.

Attention costs a sequence n + n * n / WIDTH for n tokens of one document. Documents go in
descending order to the sequence of the lowest cost so far that still has room for them, of all the
sequences of their group; what has no room in any of them is cut to fill the rooms that are left. A task packs
its own partition in groups of about GROUP tokens in the order of its rows, so which documents share a group
follows the files. Nothing is shuffled, a lost task is simply run again, and memory is
bounded by a group and its last document. A group's sequences hold 4096 tokens each and its rest
goes to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from string import punctuation as PUNCTUATION

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Memo, give_back, need

SEQUENCE, GROUP, WIDTH, END = 4096, 1 << 20, 1024, 2
RESULT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words and pieces of words in each generation of a task's memos: some 65 MB in all.
WORDS, PIECES = 150_000, 100_000
#: Controls that str.split() takes as white space and the tokenizer doesn't.
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space, one word at a time.

    Its pre-tokens never hold white space, so a text's ids are its words' ids in turn; each
    distinct word is tokenised once as long as a bounded memo holds it. A word of Latin-1 letters,
    perhaps with punctuation at its end, is two pre-tokens at most, in lower case, which the
    tokenizer's model takes one by one; all other words pass through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # these two hold no reference to this object, so they go with it
        self.pieces = Memo(self._piece_ids(self.tokenizer.model), PIECES)
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = Memo(self._word_ids(self.tokenizer, self.pieces, {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}), WORDS)

    @staticmethod
    def _piece_ids(model):
        return lambda spelled: array("I", [t.id for t in model.tokenize(spelled)]).tobytes()

    @staticmethod
    def _word_ids(tokenizer, pieces: Memo, spelling: dict[int, str]):
        def ids(word: str) -> bytes:
            core = word.rstrip(PUNCTUATION)
            if core.isalpha() and (core.isascii() or max(core) <= "\xff"):
                found = pieces[core.lower() if core.isascii() else core.lower().translate(spelling)]
                return found + pieces[word[len(core) :]] if len(core) < len(word) else found
            return array("I", tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

        return ids

    def ids(self, text: str) -> bytes:
        if any(c in text for c in CONTROLS):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))


def cost(n: int) -> float:
    return n + n * n / WIDTH


def capacities(total: int, size: int = SEQUENCE) -> list[int]:
    """Lengths of a group's sequences: full ones, then the powers of two that the rest is made of."""
    full, rest = divmod(total, size)
    return [size] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of each piece; a sequence's pieces come in order of their offsets.

    Whole sequences are cut from documents that fill them. The rest, in descending order, goes to
    the sequence of the lowest cost that has room; pieces without room are cut over rooms left.
    """
    rooms = capacities(sum(lengths), size)
    used = sum(n // size for n in lengths)  # the first ones, filled by one document each
    out, parts, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        for k in range(n // size):
            out.append((doc, k * size, size, sequence))
            sequence += 1
        if n % size:
            parts.append((n % size, doc, n - n % size))
    left, costs = np.array(rooms, np.int64), np.zeros(len(rooms))
    left[:used] = 0
    homeless = []
    for n, doc, start in sorted(parts, key=lambda p: (-p[0], p[1])):
        fits = np.flatnonzero(left >= n)
        if not len(fits):
            homeless.append((n, doc, start))
            continue
        s = int(fits[np.argmin(costs[fits])])  # of equal costs the first
        out.append((doc, start, n, s))
        left[s] -= n
        costs[s] += cost(n)
    spare = iter(sorted(np.flatnonzero(left).tolist(), key=lambda s: (-left[s], s)))
    s = None
    for n, doc, start in homeless:
        while n:
            if s is None or not left[s]:
                s = next(spare)
            take = min(n, int(left[s]))
            out.append((doc, start, take, s))
            left[s] -= take
            start, n = start + take, n - take
    return out


def _pack_partition(path: str, size: int, group: int, end: int, types: list[pa.DataType], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words, last = WordIds(path), np.asarray([end], "<u4").tobytes()
        held: list[tuple[object, bytes]] = []
        tokens, first = 0, TaskContext.get().partitionId() << 36

        def flush() -> pa.RecordBatch:
            nonlocal first, tokens
            lengths = [len(b) // 4 for _, b in held]
            offsets: dict[int, int] = {}
            rows = []
            for doc, start, n, s in pack(lengths, size):
                name, ids = held[doc]
                at = offsets.get(s, 0)
                rows.append((name, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), lengths[doc], first + s, at))
                offsets[s] = at + n
            first += len(offsets)
            held.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + last
                held.append((name.as_py(), ids))
                tokens += len(ids) // 4
                if tokens >= group:
                    yield flush()
        if held:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, size: int = SEQUENCE, group: int = GROUP, end: int = END) -> DataFrame:
    """The pieces of the packed documents (doc_id, text): where each lies in its document and its sequence.

    A null or empty text is the end token alone; a null doc_id stays null; each repeated row is
    packed as a document of its own; an empty table gives an empty result; extra columns, whatever
    their names, are not read. Equal lengths keep the order of the rows, equal costs the order of the
    sequences. A very long text fills sequences of its own and is cut there; a task holds its ids.
    Sequence ids are unique, not consecutive.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    rows = need(docs, "doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *T.DataType.fromDDL(RESULT).fields])
    return rows.mapInArrow(_pack_partition(path, size, group, end, list(to_arrow_schema(schema).types), schema.names), schema)
