"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds.

The distinct words of many texts are laid out as one flat array of symbols. In each round every word looks up its
pairs, takes the best rank that it has and merges all pairs of this rank, from the left; merged places are closed up and
words without pairs leave, until no pair remains. The library is only asked for the vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketboard.llm.common import appended, fresh, per_text

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Text whose words are merged together when ids themselves are returned.
SLICE_BYTES = 2 << 20
NO_RANK = np.int32(1 << 30)
_WORDS = re.compile(" +[^ ]*")


class Vocabulary:
    """Pieces and pair ranks of a byte-pair model with byte fallback, identity normalisation and a space put in front."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        if model.normalize("  ﬁ  x ") != f"{SPACE * 3}ﬁ{SPACE * 2}x{SPACE}":
            raise ValueError("the model normalises texts")
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece reaches over a word's end")
        order = sorted(normal.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        self.bytes = np.zeros(256, np.int64)
        self.surface = [b""] * size
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not special[i]:
                self.surface[i] = piece.replace(SPACE, " ").encode()
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        # Symbols are ids, and beyond them characters: every code point has one, in the vocabulary or not.
        self.beyond = size
        self.char = np.arange(0x110000, dtype=np.int32) + size
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.char[ord(" ")] = self.char[ord(SPACE)]

        def symbol(part: str) -> int | None:
            return int(self.char[ord(part)]) if len(part) == 1 else normal.get(part)

        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[self.pair_key(left, right)] = (rank[i], i)
        self._fill(pairs)
        self.sizes = np.array([len(s) for s in self.surface], np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))[:-1]
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)

    @staticmethod
    def pair_key(left, right):
        return (left << 22) + right

    def _fill(self, pairs: dict[int, tuple[int, int]]) -> None:
        """A hash table with open addresses; the last row stands for no pair."""
        self.slots = 1 << 19
        self.keys = np.full(self.slots + 64, -1, np.int64)
        self.ranks = np.full(self.slots + 64, NO_RANK, np.int32)
        self.merged = np.zeros(self.slots + 64, np.int32)
        self.reach = 0
        for key, (rank, piece) in pairs.items():
            home = int(self.home(np.array([key], np.int64))[0])
            at = home
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, piece
            self.reach = max(self.reach, at - home)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20)) & np.int64(self.slots - 1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (NO_RANK: no pair) and the pieces that they make."""
        keys = self.pair_key(left.astype(np.int64), right.astype(np.int64))
        at = self.home(keys)
        there = self.keys[at]
        for _ in range(self.reach):
            other = np.flatnonzero((there != keys) & (there >= 0))
            if not len(other):
                break
            at[other] += 1
            there[other] = self.keys[at[other]]
        found = there == keys
        return np.where(found, self.ranks[at], NO_RANK), self.merged[at]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merged_stepwise(symbols: np.ndarray, known: Vocabulary) -> np.ndarray:
    """One merge at a time: the best rank, leftmost first."""
    row = symbols.copy()
    while len(row) > 1:
        ranks, made = known.look_up(row[:-1], row[1:])
        i = int(ranks.argmin())
        if ranks[i] == NO_RANK:
            break
        row[i] = made[i]
        row = np.delete(row, i + 1)
    return row


def merge_rounds(symbols: np.ndarray, word: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols and their words. symbols: of all words, one after another; word: the word's number, ascending.

    Merging all places of a rank at once equals merging them one by one unless a merge makes a pair of a better rank
    in between. Where that shows, in the next round or beside an adjoining place, the word is merged stepwise.
    """
    first, first_word, symbols = symbols, word, symbols.copy()
    done: list[tuple[np.ndarray, np.ndarray]] = []
    slow: list[np.ndarray] = []
    last = np.full(int(word[-1]) + 1 if len(word) else 0, -1, np.int32)
    if len(word):
        # Of the pair that begins at each symbol: its rank and the piece that it makes.
        rank, made = _pairs(symbols, word, np.arange(len(symbols)), known)
    while len(symbols):
        begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(rank, begins)
        numbers = word[begins]
        sizes = np.diff(np.append(begins, len(word)))
        wrong = best < last[numbers]
        hit = (rank == np.repeat(best, sizes)) & (rank < NO_RANK)
        spots = np.flatnonzero(hit)
        # In a run of overlapping places every other one is taken, from the left.
        if len(spots):
            new_run = np.append(True, np.diff(spots) > 1)
            order = np.arange(len(spots))
            spots = spots[(order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0]
        several = np.bincount(np.searchsorted(begins, spots, "right") - 1, minlength=len(begins)) > 1
        if len(spots) > 1:
            side = np.flatnonzero(spots[1:] == spots[:-1] + 2)
            side = side[word[spots[side]] == word[spots[side + 1]]]
            between, _ = known.look_up(made[spots[side]], symbols[spots[side] + 2])
            odd = spots[side][between < rank[spots[side]]]
            if len(odd):
                wrong |= np.isin(numbers, word[odd])
        slow.append(numbers[wrong])
        leaves = wrong | (best == NO_RANK)
        finished = np.repeat(leaves & ~wrong, sizes)
        done.append((symbols[finished], word[finished]))
        last[numbers] = np.where(several, best, -1)
        symbols[spots] = made[spots]
        stays = ~np.repeat(leaves, sizes)
        stays[spots + 1] = False
        touched = np.zeros(len(symbols), bool)
        touched[spots] = True
        touched[np.maximum(spots - 1, 0)] = True
        # A merge that follows directly has gone with its second symbol; what stands before it is the one that changed.
        touched[np.maximum(spots - 2, 0)] = True
        symbols, word, rank, made, touched = (x[stays] for x in (symbols, word, rank, made, touched))
        changed = np.flatnonzero(touched)
        rank[changed], made[changed] = _pairs(symbols, word, changed, known)
    for number in np.concatenate(slow) if slow else []:
        begin, end = np.searchsorted(first_word, [number, number + 1])
        row = merged_stepwise(first[begin:end], known)
        done.append((row, np.full(len(row), number)))
    if not done:
        return symbols, word
    symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def _pairs(symbols: np.ndarray, word: np.ndarray, places: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Rank and piece of the pairs that begin at the places."""
    follows = np.minimum(places + 1, len(symbols) - 1)
    rank, made = known.look_up(symbols[places], symbols[follows])
    rank[(word[places] != word[follows]) | (follows == places)] = NO_RANK
    return rank, made


def word_ids(words: list[str], known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and where each word's begin (one more than there are words)."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols, word = merge_rounds(known.char[code], np.repeat(np.arange(len(words)), sizes), known)
    unknown = np.flatnonzero(symbols >= known.beyond)
    if len(unknown):
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[unknown] - known.beyond).tolist()]
        times = np.ones(len(symbols), np.int64)
        times[unknown] = [len(b) for b in spelled]
        ends = np.cumsum(times)
        symbols, word = np.repeat(symbols, times), np.repeat(word, times)
        flat = np.frombuffer(b"".join(spelled), np.uint8)
        symbols[_ranges(ends[unknown] - times[unknown], times[unknown])] = known.bytes[flat]
    return symbols, np.searchsorted(word, np.arange(len(words) + 1))


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Numbers(dict):
    """Numbers new words in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def encode_all(texts: list[str], known: Vocabulary) -> list[np.ndarray]:
    """Ids of every text without begin and end; each distinct word of all texts is merged once."""
    place = _Numbers()
    rows = []
    for text in texts:
        words = _WORDS.findall(" " + text.replace(SPACE, " ")) if text else []
        rows.append(np.array(list(map(place.__getitem__, words)), np.int64))
    ids, begins = word_ids(list(place), known)
    sizes = np.diff(begins)
    return [ids[_ranges(begins[row], sizes[row])] for row in rows]


def decode(ids: np.ndarray, known: Vocabulary) -> bytes:
    """The text of ids: control ids say nothing, byte ids are bytes, the space put in front goes.

    Byte ids that are no valid UTF-8 become one replacement character for each byte, as in the library.
    """
    ids = np.asarray(ids, np.int64)
    data = known.flat[_ranges(known.starts[ids], known.sizes[ids])].tobytes()
    shown = ids[known.sizes[ids] > 0]
    if len(shown) and not known.is_byte[shown[0]] and data.startswith(b" ") and shown[0] != known.unknown:
        data = data[1:]
    try:
        data.decode()
    except UnicodeDecodeError:
        data = data.decode("utf-8", "_each_byte").encode()
    return data


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _register() -> None:
    import codecs

    codecs.register_error("_each_byte", _each_byte)


_register()


def with_ends(ids: np.ndarray, known: Vocabulary) -> np.ndarray:
    return np.concatenate([[known.bos], ids, [known.eos]])


def round_trip(documents: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """n_tokens (with begin and end), digests of the ids and of the decoded text of every document.

    Null and empty texts have the two end ids and decode to nothing. Repeated rows and repeated or null keys keep a row
    each; no documents, no rows. Columns other than key and text are not read.
    """

    def run(texts: list[bytes]) -> dict:
        known = vocabulary(model)
        rows = []
        for ids in encode_all([t.decode("utf-8", "replace") for t in texts], known):
            full = with_ends(ids, known)
            digest = hashlib.sha256(full.astype("<u4").tobytes()).hexdigest()
            rows.append((len(full), digest, hashlib.sha256(decode(full, known)).hexdigest()))
        return dict(zip(["n_tokens", "ids_sha256", "decoded_sha256"], map(list, zip(*rows, strict=True)), strict=True))

    return per_text(documents, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def encoded(documents: DataFrame, text: str = "text", ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """The documents with their ids (array of int, begin and end included) in a new last column.

    Null and empty texts have the two end ids. All other columns, rows and repeats stay; a name that is taken gets an
    underscore. No documents, no rows.
    """

    def run(texts: list[bytes | None]) -> pa.Array:
        known = vocabulary(model)
        made = encode_all([(t or b"").decode("utf-8", "replace") for t in texts], known)
        made = [with_ends(x, known).astype(np.int32) for x in made]
        ends = np.append(0, np.cumsum([len(x) for x in made])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))

    return appended(documents, text, fresh(documents, ids), "array<int>", run, SLICE_BYTES)


def decoded(tokens: DataFrame, ids: str = "token_ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """The rows with the text of their ids; null ids give a null text."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        known = vocabulary(model)
        return pa.array([None if x is None else decode(np.array(x, np.int64), known).decode() for x in column.to_pylist()], pa.string())

    return tokens.withColumn(text, run(F.col(ids)))
