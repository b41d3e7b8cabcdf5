"""Byte-level byte-pair encoding by a lazily determinised transducer, and streaming decoding.

A row of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs: a merge over a
border would be the first of all in their pair too. So a nondeterministic machine reads bytes along the vocabulary's
trie and may end a token there if it fits the one before; of all its runs over some bytes one alone has just ended a token.
Its subsets are determinised when a text first asks for them. A state holds, for each token that may still be open, its
trie node and what would be written before it; what all of them agree on is written at once. A token that may be open reaches
back no further than the longest token, which bounds how far the output lags behind.

Matches of a few bytes are merged pair by pair, which is less than making the states of each.

Decoding steps over ids in the same way: a state is the bytes of a character that is not complete yet.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, pairwise
from os.path import commonprefix

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from marketboard.llm.common import appended, fresh, per_text

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: States that a machine keeps before it begins anew; they are made again when asked for.
MOST_STATES = 200_000
#: Distinct matches whose ids are remembered, of at most so many bytes each.
MOST_REMEMBERED, REMEMBERED_BYTES = 300_000, 64
#: Matches of so many bytes at most are merged pair by pair: most are met but once or twice, and states made for them are not met again.
SHORT_BYTES = 48
#: Bytes of text whose ids are held at once when ids themselves are returned.
SLICE_BYTES = 2 << 20
NEVER = 1 << 60
REPLACEMENT = "�"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Transducer:
    """Ids of byte strings by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.ranks, self.most_states = ranks, most_states
        self.spelled = {rank: token for token, rank in ranks.items()}
        # The ranks of all pairs of bytes.
        self.two = [[ranks.get(bytes([a, b]), NEVER) for b in range(256)] for a in range(256)]
        # The trie: child by node and byte, and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.ends = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                following = self.child.get(node << 8 | byte)
                if following is None:
                    following = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                node = following
            self.ends[node] = rank
        self.inner = {key >> 8 for key in self.child}
        self._merges: dict[int, list[tuple[int, bytes, bytes]] | None] = {}
        self._fitting: dict[int, bool] = {}
        self._forget()

    def merges(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """Rank, first and last symbol of each merge by which the token's bytes become it; None if they do not."""
        if token not in self._merges:
            row, steps = [bytes([b]) for b in self.spelled[token]], []
            while len(row) > 1:
                rank, at = min((self.ranks.get(row[i] + row[i + 1], NEVER), i) for i in range(len(row) - 1))
                if rank == NEVER:
                    break
                row[at : at + 2] = [row[at] + row[at + 1]]
                steps.append((rank, row[0], row[-1]))
            self._merges[token] = steps if len(row) == 1 else None
        return self._merges[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, one after the other, are encoded as these two.

        Never if the right one's own bytes do not become it. The merges inside each go on by rank, the left one's first
        among equals, until one over the border would come before them: of a lower rank, or of the right side's next
        rank, as it lies to the left.
        """
        known = self._fitting.get(left << 32 | right)
        if known is None:
            one, two = self.merges(left), self.merges(right)
            if two is None:
                return False
            last, first = self.spelled[left][-1:], self.spelled[right][:1]
            i = j = 0
            while True:
                across = self.ranks.get(last + first, NEVER)
                a = one[i][0] if i < len(one) else NEVER
                b = two[j][0] if j < len(two) else NEVER
                if across < a and across <= b and across < NEVER:
                    known = False
                    break
                if a == b == NEVER:
                    known = True
                    break
                if a <= b:
                    last, i = one[i][2], i + 1
                else:
                    first, j = two[j][1], j + 1
            if len(self._fitting) >= 8 * self.most_states:
                self._fitting.clear()
            self._fitting[left << 32 | right] = known
        return known

    def _forget(self) -> None:
        """Only the first state: nothing written, nothing open."""
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        # Of a state: the last token written, and (node, tokens not written yet) of each that may be open, earliest first.
        self.states = [(-1, ((0, ()),))]
        self.names = {self.states[0]: 0}

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and what is written on the way. States are named by multiples of 256."""
        anchor, open_ = self.states[state >> 8]
        child, inner, ends = self.child.get, self.inner, self.ends
        after, ended = [], None
        for node, waiting in open_:
            node = child(node << 8 | byte)
            if node is None:
                continue
            if node in inner:
                after.append((node, waiting))
            if ended is None and (token := ends[node]) >= 0:
                before = waiting[-1] if waiting else anchor
                if self.fits(before, token) if before >= 0 else self.merges(token) is not None:
                    ended = (*waiting, token)
        after.append((0, ended))
        written = ()
        if after[0][1]:
            written = commonprefix([waiting for _, waiting in after])
            if written:
                anchor = written[-1]
                after = [(node, waiting[len(written) :]) for node, waiting in after]
            if all(waiting for _, waiting in after):
                anchor = -1
        made = (anchor, tuple(after))
        name = self.names.get(made)
        if name is None:
            if len(self.states) >= self.most_states:
                self._forget()
                state = -1
            name = self.names[made] = len(self.states) << 8
            self.states.append(made)
        if state >= 0:
            self.steps[state | byte] = (name, written)
        return name, written

    def lag(self, state: int) -> int:
        """Tokens that a state holds back at most."""
        return max(len(waiting) for _, waiting in self.states[state >> 8][1])

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a short match by merging neighbours, the lowest rank first and the left one among equals."""
        ranks, two = self.ranks.get, self.two
        whole = ranks(piece)
        if whole is not None:
            return [whole]
        cuts = list(range(len(piece) + 1))
        pairs = [two[a][b] for a, b in pairwise(piece)]
        while pairs and (rank := min(pairs)) != NEVER:
            at = pairs.index(rank)
            del pairs[at], cuts[at + 1]
            if at:
                pairs[at - 1] = ranks(piece[cuts[at - 1] : cuts[at + 1]], NEVER)
            if at < len(pairs):
                pairs[at] = ranks(piece[cuts[at] : cuts[at + 2]], NEVER)
        return [ranks(piece[a:b]) for a, b in pairwise(cuts)]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match. As in the library, a match that is in the vocabulary is that token, mergeable or not."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, ids, known = 0, [], self.steps.get
        for byte in piece:
            step = known(state | byte)
            if step is None:
                step = self._step(state, byte)
                # Asked anew, as the table is another one after _forget.
                known = self.steps.get
            state, written = step
            if written:
                ids += written
        ids += self.states[state >> 8][1][-1][1]
        return ids


#: States of the UTF-8 machine by lead byte (bytes still to come, bounds of the next one).
LEADS = (
    (range(0xC2, 0xE0), 1, 0x80, 0xBF),
    (range(0xE0, 0xE1), 2, 0xA0, 0xBF),
    (range(0xE1, 0xED), 2, 0x80, 0xBF),
    (range(0xED, 0xEE), 2, 0x80, 0x9F),
    (range(0xEE, 0xF0), 2, 0x80, 0xBF),
    (range(0xF0, 0xF1), 3, 0x90, 0xBF),
    (range(0xF1, 0xF4), 3, 0x80, 0xBF),
    (range(0xF4, 0xF5), 3, 0x80, 0x8F),
)
_LEAD = {byte: (more, low, high) for bytes_, more, low, high in LEADS for byte in bytes_}


def characters(held: bytes, data: bytes) -> tuple[str, bytes]:
    """The text of held bytes and data up to the last complete character, and the bytes of one that is not complete.

    A sequence that goes on wrongly becomes one replacement character, and so does each byte that can begin none.
    """
    told: list[str] = []
    begin = more = 0
    low = high = 0
    whole = held + data
    for at, byte in enumerate(whole):
        if more and low <= byte <= high:
            more, low, high = more - 1, 0x80, 0xBF
        else:
            if more:
                told.append(REPLACEMENT)
            begin = at
            more, low, high = _LEAD.get(byte, (0, 0, 0))
            if not more and byte >= 0x80:
                told.append(REPLACEMENT)
                continue
        if not more:
            told.append(whole[begin : at + 1].decode())
    return "".join(told), whole[begin:] if more else b""


class Decoder:
    """Text of ids as they come; characters are given out when their last byte is there."""

    def __init__(self, spelled: dict[int, bytes]):
        self.spelled = spelled
        self.size = max(spelled) + 1
        self.held = [b""]
        self.names = {b"": 0}
        self.steps: dict[int, tuple[int, str]] = {}

    def _step(self, state: int, token: int) -> tuple[int, str]:
        text, held = characters(self.held[state // self.size], self.spelled[token])
        if held not in self.names:
            self.names[held] = len(self.held) * self.size
            self.held.append(held)
        step = self.names[held], text
        # Beginnings of characters are few, but wild ids can pair all of them with all tokens.
        if len(self.steps) >= 10 * MOST_STATES:
            self.steps.clear()
        self.steps[state + token] = step
        return step

    def feed(self, ids: Iterable[int], state: int = 0) -> tuple[list[str], int]:
        """Texts of more ids, and the state to go on from; an id that is not in the vocabulary raises KeyError."""
        told, steps = [], self.steps
        for token in ids:
            try:
                state, text = steps[state + token]
            except KeyError:
                state, text = self._step(state, token)
            told.append(text)
        return told, state

    def finish(self, state: int) -> str:
        """What an end adds: a character that stays incomplete is a replacement character."""
        return REPLACEMENT if state else ""

    def decode(self, ids: Iterable[int]) -> str:
        told, state = self.feed(ids)
        return "".join(told) + self.finish(state)


#: A character of each class that the patterns of such vocabularies know, and of none.
CLASSES = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\u3000", "": "\u0378"}


@lru_cache(maxsize=1)
def _odd_characters() -> tuple[frozenset[str], dict[int, str]]:
    """Characters that are of another class to the tiktoken library, which knows another version of Unicode.

    Gives them, and for each a character of the class that it has there.
    """
    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000))))
    here, there = {}, {}
    for name in filter(None, CLASSES):
        library = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=single, special_tokens={})
        here |= dict.fromkeys(regex.findall(name, every), name)
        there |= dict.fromkeys(bytes(library.encode_ordinary(every)).decode(), name)
    odd = frozenset(c for c in here.keys() | there.keys() if here.get(c) != there.get(c))
    return odd, {ord(c): CLASSES[there.get(c, "")] for c in odd}


class Encoding:
    """A vocabulary with its pattern: texts to ids and back."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.machine = Transducer(read_ranks(path))
        compiled = regex.compile(pattern)
        self.findall, self.finditer = compiled.findall, compiled.finditer
        self.odd, self.stand_in = _odd_characters()
        self.decoder = Decoder(self.machine.spelled)
        self.digits = {rank: str(rank) for rank in self.machine.spelled}
        self.remembered: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, with the library's own classes of characters."""
        if not text.isascii() and not self.odd.isdisjoint(text):
            return [text[m.start() : m.end()] for m in self.finditer(text.translate(self.stand_in))]
        return self.findall(text)

    def _ids(self, piece: str) -> list[int]:
        data = piece.encode()
        ids = self.machine.merged(data) if len(data) <= SHORT_BYTES else self.machine.encode(data)
        if len(piece) <= REMEMBERED_BYTES:
            if len(self.remembered) >= MOST_REMEMBERED:
                self.remembered.clear()
            self.remembered[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known = self.remembered.get
        return list(chain.from_iterable([known(piece) or self._ids(piece) for piece in self.split(text)]))


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN) -> Encoding:
    return Encoding(path, pattern)


def _text(data: bytes | None) -> str:
    return (data or b"").decode("utf-8", "replace")


def round_trip(documents: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """n_tokens, digests of the ids (decimal, joined by commas) and of the decoded text of every document.

    Null and empty texts have no ids: n_tokens 0, both digests those of no bytes. Texts are taken whole, of any length.
    Repeated rows and repeated or null keys keep a row each; no documents, no rows. Other columns are not read.
    """

    def run(texts: list[bytes]) -> dict:
        known = encoding(ranks, pattern)
        sizes, digests, decoded = [], [], []
        for data in texts:
            ids = known.encode(_text(data))
            sizes.append(len(ids))
            digests.append(hashlib.sha256(",".join(map(known.digits.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(known.decoder.decode(ids).encode()).hexdigest())
        return {"n_tokens": sizes, "ids_sha256": digests, "decoded_sha256": decoded}

    return per_text(documents, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def encoded(documents: DataFrame, text: str = "text", ids: str = "byte_ids", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """The documents with the ids of their texts (array of int) in a new last column.

    Null and empty texts have an empty array. All other columns, rows and repeats stay; a name that is taken gets an
    underscore. No documents, no rows.
    """

    def run(texts: list[bytes]) -> pa.Array:
        known = encoding(ranks, pattern)
        rows = [np.array(known.encode(_text(t)), np.int32) for t in texts]
        ends = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))

    return appended(documents, text, fresh(documents, ids), "array<int>", run, SLICE_BYTES)


def decoded(tokens: DataFrame, ids: str = "byte_ids", text: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """The rows with the text of their ids in a new last column, named anew if taken; null ids give a null text.

    Bytes that are no UTF-8 become replacement characters. Null ids and ids that the vocabulary lacks raise an error.
    """

    def run(column: pa.Array) -> pa.Array:
        known = encoding(ranks).decoder
        return pa.array([None if row is None else known.decode(row) for row in column.to_pylist()], pa.string())

    return appended(tokens, ids, fresh(tokens, text), "string", run, None)
