"""Secret scans: fixed patterns, and random strings told by token efficiency.

A byte-pair vocabulary packs words and names into few tokens, but needs a token for every one or two characters of a
random string. Strings of few characters per token are reported unless they have the form of a digest or of an
identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketboard.llm.common import appended, fresh, per_text

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Random base64 has about 1.5 characters a token, random hexadecimal digits 1.8, prose over 3.
MAX_CHARS_PER_TOKEN = 2.0
REPLACEMENT = "[secret]"

# ---- fixed values: the plain patterns, their order and least lengths --------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12
ACCESS_CHARS = 18
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# ---- fixed values: lengths of hexadecimal digests (MD5, SHA-1, SHA-2) and the form of a UUID ------
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
# ---- fixed values: runs of numbers alone that are no secrets, and the longest number beside words ----
DATE = re.compile(r"(19|20)\d\d[-_/]?(0[1-9]|1[0-2])[-_/]?(0[1-9]|[12]\d|3[01])([-_/]?\d\d){0,3}([-_/]\d{1,9})*")
COUNT = re.compile(r"\d{1,2}|(19|20)\d\d")
NUMBER_DIGITS = 9
#: Letters a token in words; random letters of one case have about 1.7.
WORD_CHARS_PER_TOKEN = 3

Span = tuple[int, int, int]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_spans(text: str, raw: bytes) -> list[Span]:
    """(start, kind, end) of the fixed patterns in code points; raw is the text as bytes."""
    spans = []
    lower = raw.lower()
    if any(name in lower for name in ASSIGN_NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def known_form(run: str, path: str) -> bool:
    """A digest, a UUID, or an identifier made of words and numbers."""
    digest = len(run) in DIGEST_CHARS and HEX_ONLY.fullmatch(run)
    return bool(digest or UUID.fullmatch(run) or named(run, path))


def named(run: str, path: str) -> bool:
    """Letters and digits stay apart in each part, and the vocabulary shows the letters to be words; or a date, or small numbers."""
    parts = [p for p in re.split(r"[+/_=-]+", run) if p]
    if all(p.isdigit() for p in parts):
        return bool(DATE.fullmatch(run)) or all(COUNT.fullmatch(p) for p in parts)
    words = []
    for part in parts:
        if not (part.isalpha() or part.isdigit() and len(part) <= NUMBER_DIGITS):
            return False
        if part.isalpha():
            inner = [part] if part.islower() or part.isupper() else re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", part)
            if len(inner) > 1 and len(part) < 3 * len(inner):
                return False
            words += inner
    tokens = [len(vocabulary(path).encode_ordinary(f" {w.lower()}")) for w in words]
    # A short word of one token counts as a word.
    letters = sum(max(len(w), WORD_CHARS_PER_TOKEN * (n == 1)) for w, n in zip(words, tokens, strict=True))
    return letters >= WORD_CHARS_PER_TOKEN * sum(tokens)


def random_spans(text: str, taken: list[Span], path: str, most: float) -> list[Span]:
    """Runs of few characters per token that touch no span found so far."""
    spans = []
    for match in RUN.finditer(text):
        run, (begin, end) = match[0], match.span()
        if known_form(run, path) or any(a < end and begin < b for a, _, b in taken):
            continue
        if len(run) < most * len(vocabulary(path).encode_ordinary(run)):
            spans.append((begin, 3, end))
    return spans


def all_spans(raw: bytes, path: str, most: float) -> tuple[str, list[Span], list[Span]]:
    text = raw.decode("utf-8", "replace")
    plain = plain_spans(text, raw)
    return text, plain, sorted(plain + random_spans(text, plain, path, most))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{begin}:{end}" for begin, kind, end in spans)


def scanned(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary_path: str = VOCABULARY,
    max_chars_per_token: float = MAX_CHARS_PER_TOKEN,
) -> DataFrame:
    """Counts and spans of every document, one row for each row.

    Spans are kind:start:end in code points, by start, then kind. base_sha256 is the digest of the plain ones. Null and
    empty texts have no spans. Repeated rows and repeated or null keys keep a row each; no documents, no rows. Other
    columns are not read.
    """

    def run(texts: list[bytes]) -> dict:
        rows = []
        for raw in texts:
            _, plain, spans = all_spans(raw, vocabulary_path, max_chars_per_token)
            kinds = [kind for _, kind, _ in plain]
            digest = hashlib.sha256(spelled(plain).encode()).hexdigest()
            rows.append((*(kinds.count(k) for k in range(3)), digest, spelled(spans)))
        return dict(zip(["n_assign", "n_access", "n_hex", "base_sha256", "spans"], map(list, zip(*rows, strict=True)), strict=True))

    return per_text(documents, key, text, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", run)


def redact(raw: bytes, path: str, most: float) -> str:
    text, _, spans = all_spans(raw, path, most)
    out, reach = [], 0
    for begin, _, end in spans:
        if begin >= reach:
            out += [text[reach:begin], REPLACEMENT]
        reach = max(reach, end)
    return "".join([*out, text[reach:]])


def redacted(
    documents: DataFrame, text: str = "text", vocabulary_path: str = VOCABULARY, max_chars_per_token: float = MAX_CHARS_PER_TOKEN
) -> DataFrame:
    """The documents with every span replaced in the text; overlapping spans by one mark.

    Null and empty texts stay as they are, and so do all other columns, rows and repeats; no documents, no rows.
    """

    def run(texts: list[bytes | None]) -> pa.Array:
        return pa.array([None if t is None else redact(t, vocabulary_path, max_chars_per_token) for t in texts], pa.string())

    cleaned = fresh(documents, "_cleaned")
    made = appended(documents, text, cleaned, "string", run)
    return made.select(*[F.col(cleaned).alias(c) if c == text else F.col(c) for c in documents.columns])
