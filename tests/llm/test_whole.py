"""Rows and notices that an earlier version lost."""

import base64
import textwrap

import pytest

from sedge.llm import licenses, secret_scan
from sedge.llm.near_dedup import keep_one


def test_keep_one_judges_rows_that_share_an_id_by_their_texts(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, c + " more"), (4, c), (5, e), (5, e), (6, d), (7, None), (7, ""), (7, b), (8, ""), (8, a), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    c_kept = next(t for i, t in kept if i == 3 and t != d)  # either of two linked texts of one id
    assert c_kept in (c, c + " more")
    assert kept == sorted([(1, a), (2, b), (3, c_kept), (3, d), (5, e), (7, None), (7, ""), (8, "")], key=str)


def pem(label, data, head=""):
    return f"-----BEGIN {label}-----\n{head}{textwrap.fill(base64.b64encode(data).decode(), 64)}\n-----END {label}-----"


def openssh(cipher=b"none", tag=b""):
    field = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + field(cipher) + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"k" * 51) + field(bytes(range(136))) + tag


LEGACY = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"


@pytest.mark.parametrize(
    "key, fits",
    [
        (pem("OPENSSH PRIVATE KEY", openssh()), True),
        (pem("OPENSSH PRIVATE KEY", openssh(b"aes256-gcm@openssh.com", b"t" * 16)), True),
        (pem("OPENSSH PRIVATE KEY", openssh()[:-1]), False),
        (pem("OPENSSH PRIVATE KEY", b"openssh-key-v1\0" + b"\xff" * 99), False),
        (pem("RSA PRIVATE KEY", bytes(range(160)), LEGACY), True),
        (pem("RSA PRIVATE KEY", bytes(range(160)), LEGACY).replace("\n", "\r\n"), True),
        (pem("RSA PRIVATE KEY", bytes(range(161)), LEGACY), False),
        (pem("RSA PRIVATE KEY", b"\x30" + bytes(99), "Comment: mine\n\n"), True),
        (pem("RSA PRIVATE KEY", bytes(100), "Comment: mine\n\n"), False),
        (pem("PRIVATE KEY", b"\x30" + bytes(99)), True),
        (pem("PRIVATE KEY", bytes(100)), False),
    ],
)
def test_private_keys_of_all_forms(key, fits):
    text = f"before {key} after"
    spans = [s for s in secret_scan.scan(text, secret_scan.automaton()) if s[2] == "pem"]
    assert spans == ([(7, 7 + len(key), "pem")] if fits else [])
    assert not fits or secret_scan.mask(text, spans) == "before [pem] after"


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [18, 30, 48, 60, 72, 79, 100, 200])
def test_wrapped_notices(width, mark):
    found = licenses.Templates(licenses.TEMPLATES)
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            lines = ["Copyright 2020 by some of the authors", "", *textwrap.wrap(notice, width, break_long_words=False, break_on_hyphens=False), "", "def this_is(the, software): of any use"]
            text = "\n".join(mark + x for x in lines)
            spans, _ = licenses.license_spans(text, found)
            words = [w.lower() for w in licenses.WORD.findall(notice)]
            assert [(s[2], [w.lower() for w in licenses.WORD.findall(text[s[0] : s[1]])]) for s in spans] == [(name, words)]


def test_notices_in_a_row_are_all_found():
    found = licenses.Templates(licenses.TEMPLATES)
    text = "Licensed under the MIT\nLicense. Released under the MIT License.\nLicensed under the\nBSD License. Licensed under the MIT\nLicense."
    assert [s[2] for s in licenses.license_spans(text, found)[0]] == ["MIT", "MIT", "BSD", "MIT"]
    assert licenses.license_spans("Licensed under the Apache\nLicense, Version 3.0.", found)[0] == []
