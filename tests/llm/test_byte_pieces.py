"""Byte-level encoding against the tiktoken library, and streaming decoding."""

import hashlib
import random

import pytest
import tiktoken

from marketboard.llm import byte_pieces
from marketboard.llm.byte_pieces import PATTERN, RANKS, Decoder, Encoding, Transducer, characters, encoding


@pytest.fixture(scope="module")
def known():
    return encoding(RANKS)


@pytest.fixture(scope="module")
def library(known):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known.machine.ranks, special_tokens={})


ALPHABETS = ["abc ", "aeiouxyz'\n\t ", "漢字かな한국어", "😀éàüñß", "अआइईउऊक", "0123456789 .,-", "\x1c\x1d\x85\xa0​　  a", "՘֌가덴\U00018d88"]


def test_encodes_as_the_library(known, library):
    random.seed(5)
    for _ in range(4000):
        letters = random.choice(ALPHABETS) + random.choice(ALPHABETS)
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        assert known.encode(text) == library.encode_ordinary(text)
    for _ in range(500):
        spans = [(0x20, 0x7F), (0x80, 0x800), (0x800, 0xD800), (0xE000, 0x110000)]
        text = "".join(chr(random.randrange(*random.choice(spans))) for _ in range(40))
        assert known.encode(text) == library.encode_ordinary(text)


def test_glued_tokens_and_any_bytes(known, library):
    random.seed(6)
    tokens = list(known.machine.ranks)
    for _ in range(3000):
        piece = b"".join(random.choice(tokens) for _ in range(random.randint(1, 6)))
        assert known.machine.encode(piece) == library._core_bpe.encode_single_piece(piece)
    for _ in range(1000):
        piece = random.randbytes(random.randint(1, 30))
        assert known.machine.encode(piece) == library._core_bpe.encode_single_piece(piece)


def test_one_long_word_and_long_runs(known, library):
    random.seed(7)
    for text in ("".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), " " * 5000 + "x", "=" * 5000, "ab" * 50_000):
        ids = known.encode(text)
        assert ids == library.encode_ordinary(text)
        assert known.decoder.decode(ids) == text


def brute(ranks, piece):
    """Merges one after another: the lowest rank, leftmost first; a piece that is a token stays whole."""
    if piece in ranks:
        return [ranks[piece]]
    row = [bytes([b]) for b in piece]
    while True:
        found = min(((ranks[row[i] + row[i + 1]], i) for i in range(len(row) - 1) if row[i] + row[i + 1] in ranks), default=None)
        if found is None:
            return [ranks[x] for x in row]
        row[found[1] : found[1] + 2] = [row[found[1]] + row[found[1] + 1]]


def test_odd_vocabularies_and_few_states():
    """Ranks out of order, tokens that no merge makes, and a machine that often begins anew."""
    random.seed(8)
    for _ in range(150):
        made = {"".join(random.choice("ab") for _ in range(random.randint(2, 6))).encode() for _ in range(random.randint(1, 14))}
        tokens = [bytes([b]) for b in range(256)] + sorted(made)
        numbers = list(range(len(tokens)))
        random.shuffle(numbers)
        ranks = dict(zip(tokens, numbers, strict=True))
        machine = Transducer(ranks, most_states=random.choice([2, 5, 100]))
        for _ in range(40):
            piece = "".join(random.choice("abab c") for _ in range(random.randint(1, 25))).encode()
            assert machine.encode(piece) == brute(ranks, piece)
    with pytest.raises(ValueError, match="lacks"):
        Transducer({b"a": 0})


def test_short_matches_are_merged_without_states(library):
    one = Encoding(RANKS)
    text = "Ndessh thattionble, erhendon 漢字 अआइ"
    assert one.encode(text) == library.encode_ordinary(text) and len(one.machine.states) == 1
    random.seed(10)
    for _ in range(2000):
        piece = random.choice([random.randbytes, lambda n: bytes(random.choices(b"etaoin shrdlu", k=n))])(random.randint(1, 60))
        assert one.machine.merged(piece) == library._core_bpe.encode_single_piece(piece)


def test_output_lags_by_the_longest_token_at_most(known):
    known.encode("internationalisation of unbelievably longwinded wordings")
    longest = max(map(len, known.machine.ranks))
    assert max(known.machine.lag(i << 8) for i in range(len(known.machine.states))) <= longest


def test_decoder_streams_characters(known):
    text = "naïve 漢字 😀 и так\n"
    ids = known.encode(text)
    for size in (1, 2, 5):
        state, told = 0, ""
        for at in range(0, len(ids), size):
            more, state = known.decoder.feed(ids[at : at + size], state)
            told += "".join(more)
            assert text.startswith(told)
        assert told + known.decoder.finish(state) == text


def test_broken_bytes_decode_as_in_python():
    random.seed(9)
    decoder = Decoder({b: bytes([b]) for b in range(256)})
    for _ in range(5000):
        data = bytes(random.choice([random.randrange(256), random.randrange(0x80, 0xC0), 0xE0, 0xED, 0xF0, 0xF4, 0x41]) for _ in range(8))
        assert decoder.decode(data) == data.decode("utf-8", "replace")
        cut = random.randint(0, 8)
        text, held = characters(b"", data[:cut])
        more, held = characters(held, data[cut:])
        assert text + more + ("�" if held else "") == data.decode("utf-8", "replace")


def test_rows_of_all_kinds(spark, library):
    schema = "doc_id long, text string, byte_ids string, _key int, n_tokens string"
    texts = [None, "", " ", "a", "a", "漢字 " * 4000, "x" * 100_000]
    rows = [(i if i != 3 else None, t, "kept", 1, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    out = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_pieces.round_trip(docs).collect()}
    want = set()
    for key, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text or ""))
        want.add((key, len(ids), *digests))
    assert out == want
    assert byte_pieces.round_trip(docs.limit(0)).count() == 0

    made = byte_pieces.encoded(docs)
    assert made.columns == [*docs.columns, "byte_ids_"]
    for row in byte_pieces.decoded(made, ids="byte_ids_", text="text").collect():
        assert row["byte_ids_"] == library.encode_ordinary(row["text"] or "") and row["text_"] == (row["text"] or "")
        assert row["byte_ids"] == "kept"
    assert byte_pieces.encoded(docs.limit(0)).count() == 0


def test_characters_of_another_unicode_version_are_split_as_in_the_library():
    one = Encoding(RANKS)
    assert all(one.stand_in[ord(c)] in "a1　͸" for c in one.odd)


def test_pairs_of_bytes_are_ranked_once_for_all_matches():
    machine = byte_pieces.Transducer(byte_pieces.read_ranks(byte_pieces.RANKS))
    asked = []

    class Watched(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    machine.ranks = Watched(machine.ranks)
    for piece in (b"\xff\xc0" * 10, b" unremarkableness", b"zqxjkvb"):
        asked.clear()
        ids = machine.merged(piece)
        assert b"".join(machine.spelled[i] for i in ids) == piece
        begun = [k for k in asked if len(k) == 2 and k not in {machine.spelled[i] for i in ids}]
        # those asked for are neighbours of a merge, of which there are fewer than bytes
        assert len(begun) <= 2 * (len(piece) - len(ids))
