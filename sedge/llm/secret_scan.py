"""Operator 4: secrets by keyword hits, anchored expressions and embedded checksums.

An Aho-Corasick automaton finds all keywords in one pass over the lower-cased text. Only at a hit
is an expression tried, anchored there. Forms that carry a checksum or a structure of their own
(GitHub and npm tokens with a base-62 CRC-32, JSON web tokens, PEM keys) must pass it. Runs of hex
digits have no keyword; their expression is its own prefilter.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, from_texts, map_texts, need, sha256_hex

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]{16,}+")
RUN = re.compile(r"[A-Za-z0-9_-]++")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?>\s*+(?:[ \t]*+[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----)[^\n])*+\n)+)?)([A-Za-z0-9+/=\s]{64,}?)-----END \1-----")
OPENSSH = b"openssh-key-v1\0"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def base62_crc32(body: str) -> str:
    """The six base-62 digits that end a GitHub or npm token."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.rjust(6, "0")


def _crc_fits(m: re.Match) -> bool:
    return base62_crc32(m[1]) == m[2]


def _jwt_fits(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):  # no base64, no JSON, or nested too deeply to be a head
        return False
    return isinstance(head, dict) and "alg" in head


def _openssh_fits(data: bytes) -> bool:
    """Whether the lengths of an OpenSSH key's fields add up: cipher, kdf and its options, public keys, private keys, and a tag of some ciphers."""
    at = len(OPENSSH)

    def number() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError
        at += 4
        return int.from_bytes(data[at - 4 : at], "big")

    def field() -> int:
        nonlocal at
        n = number()
        at += n
        return n

    try:
        cipher, kdf, _, keys = field(), field(), field(), number()
        fits = cipher and kdf and 0 < keys <= len(data) and all(field() for _ in range(keys)) and field()
    except ValueError:
        return False
    return bool(fits) and at in (len(data), len(data) - 16)


def _pem_fits(m: re.Match) -> bool:
    try:
        data = base64.b64decode("".join(m[3].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if "ENCRYPTED" in m[2] and "DEK-Info:" in m[2]:
        return len(data) % 8 == 0  # whole blocks of a cipher, which have no structure to be seen
    return data[:1] == b"\x30" or data.startswith(OPENSSH) and _openssh_fits(data)  # a DER sequence, or OpenSSH's own form


#: Keyword: kind, expression anchored at the keyword's start, what must hold of the match.
KEYWORDS = {k: ("assign", ASSIGN, lambda m: len(m[2]) >= 12) for k in ("password", "passwd", "secret", "token", "apikey", "api_key")}
KEYWORDS |= {"akia": ("access", ACCESS, lambda m: len(m[0]) >= 18)}
KEYWORDS |= {f"gh{c}_": ("github", GITHUB, _crc_fits) for c in "pousr"}
KEYWORDS |= {"npm_": ("npm", NPM, _crc_fits), "eyj": ("jwt", JWT, _jwt_fits), "-----begin ": ("pem", PEM, _pem_fits)}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, rule in KEYWORDS.items():
        found.add_word(word, (len(word), *rule))
    found.make_automaton()
    return found


def scan(text: str, keywords) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's secrets by start, then kind; leftmost and not overlapping in each kind."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(ASCII_LOWER)
    out, upto = [], {}
    for end, (size, kind, form, fits) in keywords.iter(low):
        start = end - size + 1
        if start < upto.get(kind, 0):
            continue
        if m := form.match(text, start):
            upto[kind] = m.end()
            if fits(m):
                out.append((start, m.end(), kind))
        elif kind == "jwt" and (run := RUN.match(text, start)):
            upto[kind] = run.end()  # what follows the run decides, so its later hits fail alike: each run is read once
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind's mark; keywords of assignments go with them."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scanner():
    keywords = automaton()

    def row(text: str | None) -> tuple:
        spans = scan(text or "", keywords)
        base = [s for s in spans if s[2] in BASE]
        return *(sum(s[2] == k for s in base) for k in BASE), sha256_hex(joined(base).encode()), joined(spans)

    return lambda texts: list(map(row, texts))


def secret_spans(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the secrets in each row of docs (doc_id, text).

    Null and empty texts have none (the digest is that of nothing); a null doc_id stays null; each
    repeated row has its own row in the result; an empty table gives an empty result; extra
    columns are not read. Spans count code points, ends exclusive. Equal spans of different kinds are
    all listed. A very long text takes time in proportion to its length, and memory for itself and its spans.
    """
    return from_texts(need(docs, "doc_id", "text"), _scanner, RESULT)


def _masker():
    keywords = automaton()
    return lambda texts: [None if t is None else mask(t, scan(t, keywords)) for t in texts]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in `text` replaced by their kinds in brackets.

    All columns and rows stay, null and empty texts, null ids and repeated rows too; an empty table stays
    empty; columns may have any names. Overlapping secrets go as one, by the kind that begins first, of
    equal starts the first in KINDS. n_chars, where there is such a column, follows the text.
    """
    out = map_texts(docs, _masker)
    if "n_chars" in docs.columns:
        at, of = docs.columns.index("n_chars"), F.col(f"c{docs.columns.index('text')}")
        size = F.coalesce(F.length(of).cast(docs.schema[at].dataType), F.col(f"c{at}"))
        out = by_position(out).withColumn(f"c{at}", size).toDF(*docs.columns)
    return out
