"""Operator 6: byte-level BPE encoding by overlapping chunks, and decoding.

A long text is cut into chunks that overlap. Chunks are rows of their own, so other tasks
pre-tokenise them in parallel; each gives the ends of its pre-tokens. A chunk that starts inside
a word goes wrong at first, but once one of its ends is an end of the text's true pre-tokens, all
later ones are, as a match depends on nothing before it. So chunks are stitched where their ends
resynchronise in the overlap; where they don't, the pattern goes on from the last true end until
they do. Then the pieces are encoded, each distinct one once as long as a bounded memo holds it.
Decoding puts the raw bytes of the ids together.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, from_texts, need, sha256_hex
from .pretokens import ODD, SPLIT, pieces, spaced

CHUNK, OVERLAP = 32_768, 1_024
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Ranks of a vocabulary file: pieces to ids, ids to bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        # the memos' functions hold no reference to this object, so they go with it
        single = self.single
        self.piece = Memo(lambda piece: np.asarray(single.encode_ordinary(piece), "<u4").tobytes()).__getitem__
        piece = self.piece
        self.cut = Memo(lambda cut: b"".join(map(piece, spaced(cut)))).__getitem__

    def encode_pieces(self, found: list[str]) -> bytes:
        return b"".join(map(self.piece, found))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one chunk that is a whole text."""
        if ODD.search(text):
            return self.encode_pieces(pieces(text))
        first, *rest = text.split(" ")
        return self.encode_pieces(pieces(first)) + b"".join(map(self.cut, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def chunk_ends(chunk: str) -> np.ndarray:
    """The ends of the pre-tokens of a chunk, as offsets in it."""
    return np.fromiter((m.end() for m in SPLIT.finditer(chunk)), np.int64)


def stitch(text: str, starts: list[int], ends: list[np.ndarray], size: int) -> list[str]:
    """The pre-tokens of text from those of its chunks; chunk i is text[starts[i]:starts[i] + size]."""
    out: list[int] = []
    at = 0  # the last true end
    for k, (start, own) in enumerate(zip(starts, ends, strict=True)):
        stop = min(len(text), start + size)
        own = own + start
        if stop < len(text):
            # a match that comes near the chunk's end may have been longer in the text, and so may the white space before it
            own = own[own < stop - 1]
            while len(own) and text[own[-1] - 1].isspace():
                own = own[:-1]
            own = own[:-1]
        if k and at >= stop:
            continue
        while True:
            i = int(np.searchsorted(own, at))
            if at == start or (i < len(own) and own[i] == at):
                more = own[own > at]
                out += more.tolist()
                at = out[-1] if out else at
                break
            if at >= len(text) or at >= stop:
                break
            at = SPLIT.match(text, at).end()
            out.append(at)
    while at < len(text):
        at = SPLIT.match(text, at).end()
        out.append(at)
    return [text[a:b] for a, b in zip([0, *out[:-1]], out, strict=True)] if out else []


def _digests(codec: Codec, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, sha256_hex(ids), sha256_hex(codec.decode(ids))


def _encode_whole(path: str):
    def start():
        codec = Codec(path)
        return lambda texts: [_digests(codec, codec.encode(t or "")) for t in texts]

    return start


def _stitched(path: str, size: int, overlap: int):
    codec = []  # one for each Python worker

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if not codec:
            codec.append(Codec(path))
        rows = rows.sort_values("number")
        text = "".join([c[: size - overlap] for c in rows["chunk"][:-1]] + [rows["chunk"].iloc[-1]])
        starts = [n * (size - overlap) for n in rows["number"]]
        found = stitch(text, starts, list(rows["ends"]), size)
        return pd.DataFrame([(rows["doc_id"].iloc[0], *_digests(codec[0], codec[0].encode_pieces(found)))], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_roundtrip(docs: DataFrame, ranks_path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes of each row of docs (doc_id, text).

    Null and empty texts have no tokens and the digests of nothing; a null doc_id stays null;
    each repeated row has its own row in the result; an empty table gives an empty result; extra
    columns, whatever their names, are not read. Texts of more than `chunk` characters are dealt out by chunks and put
    together, one text in a task at a time; shorter ones are one chunk each.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = need(docs, "doc_id", "text")
    kind = texts.schema["doc_id"].dataType
    short = F.coalesce(F.length("text") <= chunk, F.lit(True))
    whole = from_texts(texts.where(short), _encode_whole(path), RESULT)
    step = chunk - overlap
    number = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - overlap - 1) / step).cast("int")))
    chunks = (
        texts.where(~short)
        # pandas would turn numbers beside a null into doubles, so the id goes as text
        .select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("string").alias("doc_id"), "text")
        .select("rid", "doc_id", number.alias("number"), "text")
        .select("rid", "doc_id", "number", F.expr(f"substring(text, number * {step} + 1, {chunk})").alias("chunk"))
    )
    ends = from_texts(chunks.repartition("rid", "number"), lambda: lambda found: [(chunk_ends(c),) for c in found], "ends array<long>", column="chunk", keep=True)
    long = ends.groupBy("rid").applyInPandas(_stitched(path, chunk, overlap), f"doc_id string, {RESULT}")
    return whole.unionByName(long.withColumn("doc_id", F.col("doc_id").cast(kind)))
