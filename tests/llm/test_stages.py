"""The pipeline's stages on odd tables, and the whole pipeline against a plain version of it."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers as P
import pytest

import corpus_pipeline
from sedge.llm import secret_scan, toxicity
from sedge.llm.near_dedup import keep_one, near_duplicates
from sedge.llm.secret_scan import mask_secrets, secret_spans

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept_id long, rows_of_id int, component_id long, kept boolean, "
    "score double, toxic int, fold int, part int, n int, `a.b` string, word string, node long, grp long, hash long"
)


def odd(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *[None] * 9, "x", "y", None, None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_stages_keep_all_columns_of_odd_tables(spark, labels):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, same), (2, same + " more"), (3, None), (4, ""), (None, same), (None, None), (5, "one two"), (5, "one two"), (6, "token = abcdefghijklmnop"), (7, "x " * 50_000)]
    docs = odd(spark, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, None, None, 5, 6, 7], key=str)
    masked = mask_secrets(docs)
    assert masked.schema == docs.schema
    assert Counter((r.doc_id, r.text, r.n_chars) for r in masked.collect()) == Counter((i, (u := "[assign]" if i == 6 else t), None if u is None else len(u)) for i, t in rows)
    clean = corpus_pipeline.toxicity(spark, docs, SF)
    assert clean.schema == docs.schema and Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in rows)
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == Counter(i for i, _ in rows)


def test_stages_on_empty_tables(spark):
    docs = odd(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    assert near_duplicates(docs).count() == 0 and secret_spans(docs).count() == 0


def plain_dedup(docs):
    """The smallest id of each component."""
    ids = sorted(docs)
    root = plain.linked([plain.shingles(docs[i], 5) for i in ids])
    return {i: docs[i] for k, i in enumerate(ids) if root[k] == k}


def plain_clean(docs, labels):
    score = plain.toxicity(docs, [(r.doc_id, r.toxic) for r in labels.collect()])
    return {i: t for i, t in docs.items() if score[i] < toxicity.THRESHOLD}


def plain_mask(text):
    """All expressions over the whole text, without keywords."""
    if text is None:
        return None
    rules = {k: (form, fits) for k, form, fits in secret_scan.KEYWORDS.values()} | {"hex": (secret_scan.HEX, lambda m: True)}
    spans = [(m.start(), m.end(), k) for k, (form, fits) in rules.items() for m in form.finditer(text) if fits(m)]
    return secret_scan.mask(text, sorted(spans, key=lambda s: (s[0], secret_scan.KINDS.index(s[2]))))


def test_pipeline_against_a_plain_version(spark, labels):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    clean = plain_clean(docs, labels)
    want = {i: plain_mask(t) for i, t in plain_dedup(clean).items()}
    assert len(want) < len(clean) < len(docs) and any(want[i] != docs[i] for i in want)  # each stage's decisions show
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in want.items()}
    rows, pieces, sequences = corpus_pipeline.run(spark, SF).collect(), defaultdict(list), defaultdict(list)
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, size in [*((p, len(ids[i])) for i, p in pieces.items()), *((p, None) for p in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == size or size is None and at <= 4096
