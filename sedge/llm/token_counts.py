"""Operator 1: token counts from the pieces of distinct pre-tokens.

A byte-level BPE merges within pre-tokens only, so a text's token count is the sum, over its
distinct pre-tokens, of frequency times pieces. The pieces are counted once per distinct
pre-token of the corpus, and no ids are ever materialised:

1. one pass gives the corpus's distinct pre-tokens with their frequencies (partly summed in
   each task before the shuffle);
2. each distinct pre-token's pieces are counted once by the tokenizer;
3. a second pass gives each document's pre-token frequencies and joins them to the pieces. The
   most frequent pre-tokens, at most HEAVY of at most HEAVY_CHARS characters (a proven bound of
   size whatever the corpus), are joined inside the pass; what is left of a document is joined
   by a shuffle, and as all frequent keys are gone from it, no key there is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, frequent, from_texts, materialise, need
from .pretokens import ODD, pieces, spaced

HEAVY, HEAVY_CHARS = 1 << 18, 48
#: Different cuts and pre-tokens, or characters of text, that a task counts before it passes them on.
FLUSH, FLUSH_CHARS = 120_000, 32_000_000


def _segments(text: str, special: list[str]) -> tuple[list[str], int]:
    """The text between the strings that the tokenizer takes as one token each, and their number."""
    parts, found = [text], 0
    for s in special:
        if s in text:
            cut = [p.split(s) for p in parts]
            found += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
    return parts, found


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special(tokenizer) -> list[str]:
    return sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)


def _corpus_pretokens(special: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loose, whole = Counter(), Counter()

        def flush():
            for cut, n in loose.items():
                for p in spaced(cut):
                    whole[p] += n
            out = pd.DataFrame({"pretoken": list(whole.keys()), "freq": list(whole.values())})
            loose.clear()
            whole.clear()
            return out

        passed = 0
        for batch in batches:
            for text in batch["text"]:
                passed += len(text)
                for part in _segments(text, special)[0]:
                    if ODD.search(part):
                        whole.update(pieces(part))
                    else:
                        first, *rest = part.split(" ")
                        whole.update(pieces(first))
                        loose.update(rest)
                if len(loose) + len(whole) > FLUSH or passed > FLUSH_CHARS:
                    passed = 0
                    yield flush()
        if loose or whole:
            yield flush()

    return run


def _count_pieces(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers.pre_tokenizers import ByteLevel

        model, spelled = _tokenizer(path).model, ByteLevel(add_prefix_space=False, use_regex=False)
        # each byte's character in the vocabulary; UTF-8 has all bytes from these code points
        spelling = {}
        for c in [*range(128), *range(128, 0x800), *(0x800 * k for k in range(1, 27)), *(0x10000 * k for k in range(1, 17))]:
            for byte, char in zip(chr(c).encode(), spelled.pre_tokenize_str(chr(c))[0][0], strict=True):
                spelling[byte] = char
        for batch in batches:
            batch["n_pieces"] = [len(model.tokenize(p.encode().decode("latin-1").translate(spelling))) for p in batch["pretoken"]]
            yield batch

    return run


def _document_counts(special: list[str], heavy):
    def start():
        known = heavy.value

        def value(cut: str):
            found = spaced(cut)
            return sum(known.get(p, 0) for p in found), tuple(p for p in found if p not in known)

        cache = Memo(value, 60_000)

        def row(text: str | None) -> tuple[int, list[str], list[int]]:
            parts, total = _segments(text or "", special)
            rest = Counter()
            for part in parts:
                if ODD.search(part):
                    own = Counter(pieces(part))
                else:
                    first, *others = part.split(" ")
                    own = Counter(pieces(first))
                    for cut, n in Counter(others).items():
                        k, more = cache[cut]
                        total += n * k
                        for p in more:
                            rest[p] += n
                for p, n in own.items():
                    if p in known:
                        total += n * known[p]
                    else:
                        rest[p] += n
            return total, list(rest), list(rest.values())

        return lambda texts: list(map(row, texts))

    return start


def _heavy_pieces(short: DataFrame, most: int) -> tuple[dict[str, int], Column]:
    """Pieces of the most frequent of the short pre-tokens, and the condition that holds for these."""
    often = frequent(short, F.col("freq"), most)
    if often is None:
        return {}, F.lit(False)
    table = short.where(often).select("pretoken", "n_pieces").toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)), often


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 1024, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs (doc_id, text).

    Null and empty texts count 0 bytes and 0 tokens; a null doc_id stays null; each repeated row
    has its own row in the result; an empty table gives an empty result; extra columns, whatever their names, are not
    read. Strings of special tokens inside a text count as one token, the library's default. Of a very
    long text a task holds the text and its distinct pre-tokens.
    """
    spark = docs.sparkSession
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    special = _special(_tokenizer(path))  # the scans need no more of the tokenizer
    texts = need(docs, "doc_id", "text")
    corpus = (
        texts.where("text is not null")
        .select("text")
        .mapInPandas(_corpus_pretokens(special), "pretoken string, freq long")
        .groupBy("pretoken")
        .agg(F.sum("freq").alias("freq"))
    )
    counted = materialise(corpus.mapInPandas(_count_pieces(path), "pretoken string, freq long, n_pieces long"))
    short = F.length("pretoken") <= HEAVY_CHARS
    known, often = _heavy_pieces(counted.where(short), heavy)
    shared = spark.sparkContext.broadcast(known)
    rows = texts.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    passed = materialise(from_texts(rows, _document_counts(special, shared), "known long, pretokens array<string>, freqs array<long>"))
    shared.destroy()
    rest = passed.select("rid", F.inline(F.arrays_zip(F.col("pretokens").alias("pretoken"), F.col("freqs").alias("freq")))).toDF("rid", "pretoken", "freq").join(
        counted.where(~(often & short)).select("pretoken", "n_pieces"), "pretoken"
    )
    sums = rest.groupBy("rid").agg(F.sum(F.col("freq") * F.col("n_pieces")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return passed.drop("pretokens", "freqs").join(sums, "rid", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
