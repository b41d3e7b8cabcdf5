"""Quality by weak supervision.

Every rule looks at counts of one text and votes good (1), bad (-1) or abstains (0). The votes of all documents are
counted by pattern; expectation-maximisation on these counts estimates how often each rule is right, without labels,
and every pattern gets a posterior probability of good quality. There are at most 3 ** 7 patterns however
large the corpus is, so only they reach the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketboard.llm.common import appended, fresh, per_text, saved

# ---- fixed values: the plain test that comes before the votes --------------------------------
MIN_WORDS = 50
MAX_REPEAT_PCT = 50

KEEP_FROM = 0.5
EM_ROUNDS = 100
PSEUDO_COUNT = 10.0
PRIOR_RANGE = (0.05, 0.98)

# ---- fixed values: frequent words of English, French, German and Spanish ---------------------
STOP_WORDS = frozenset(
    word.encode()
    for word in (
        "the of and to in is that it for on with as are be this by or at "
        "le la les de des et un une du en que qui dans pour par sur est "
        "der die das und von zu den mit ist im nicht ein eine auf "
        "el los las y del se con una su para es al lo como"
    ).split()
)

SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SHAPE = "n_lines long, n_upper long, n_letters long, n_other long, n_stop long"
N_RULES = 7

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_OTHER = bytes(range(128, 256))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, reach = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(reach, i)
            reach = i + 3
    return covered


def counts_of(texts: Iterable[bytes]) -> dict[str, np.ndarray]:
    rows = [_counts(text) for text in texts]
    names = [part.split()[0] for part in f"{COUNTS}, {SHAPE}".split(", ")]
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T, strict=True))


def _counts(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        size - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        size - len(text.translate(None, _UPPER)),
        size - len(text.translate(None, _LETTERS)),
        size - len(text.translate(None, _OTHER)),
        sum(map(STOP_WORDS.__contains__, text.lower().split())),
    )


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Fewer than fifty words, or more than half of them in repeated windows."""
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PCT * counts["n_words"])


def votes(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One column for each rule: 1 good, -1 bad, 0 no opinion."""
    words = np.maximum(counts["n_words"], 1)
    lines = np.maximum(counts["n_lines"], 1)

    def rule(bad, good):
        return np.where(bad, -1, np.where(good, 1, 0))

    symbols = counts["n_symbols"] / words
    copies = counts["n_dup_lines"] / lines
    repeats = counts["n_repeat_words"] / words
    length = counts["word_chars"] / words
    capitals = counts["n_upper"] / np.maximum(counts["n_letters"], 1)
    stops = counts["n_stop"] / words
    foreign = counts["n_other"] > counts["n_letters"]
    return np.column_stack(
        [
            rule(counts["n_words"] < MIN_WORDS, counts["n_words"] >= 2 * MIN_WORDS),
            rule(symbols > 0.25, symbols < 0.05),
            rule(copies > 0.5, (counts["n_dup_lines"] == 0) & (lines >= 3)),
            rule(repeats > 0.3, repeats < 0.1),
            rule((length < 2.5) | (length > 15), (length >= 3) & (length <= 11)),
            rule(capitals > 0.5, capitals < 0.2),
            np.where(foreign, 0, rule(stops < 0.01, stops >= 0.05)),
        ]
    )


def pattern_codes(vote: np.ndarray) -> np.ndarray:
    return (vote + 1) @ (3 ** np.arange(vote.shape[1]))


def patterns(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(N_RULES) % 3 - 1


def fitted(vote: np.ndarray, weight: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float]:
    """How each rule votes on bad and on good documents, and the share of good ones.

    Expectation-maximisation over counted patterns. chance[y, v, j] is the probability that rule j votes
    v - 1 on a document of class y (0 bad, 1 good): a rule may be right about bad documents and say little about
    good ones. It begins from the belief that two objections make a document bad. Pseudo-counts favour
    right votes, which also keeps the classes from changing places.
    """
    belief = np.array([[0.4, 0.3, 0.3], [0.05, 0.25, 0.7]])
    chance = np.repeat(belief[:, :, None], vote.shape[1], axis=2)
    prior = 0.9
    if not weight.sum():
        return chance, prior
    good = np.select([(vote == -1).sum(1) == 0, (vote == -1).sum(1) == 1], [0.98, 0.6], 0.05)
    for _ in range(rounds):
        share = np.stack([weight * (1 - good), weight * good])
        seen = np.stack([share @ (vote == v) for v in (-1, 0, 1)], axis=1) + PSEUDO_COUNT * belief[:, :, None]
        chance = seen / seen.sum(axis=1, keepdims=True)
        prior = float(np.clip(weight @ good / weight.sum(), *PRIOR_RANGE))
        good = posterior(vote, chance, prior)
    return chance, prior


def posterior(vote: np.ndarray, chance: np.ndarray, prior: float) -> np.ndarray:
    """Probability of good quality for rows of votes."""
    told = np.log(chance[1]) - np.log(chance[0])
    odds = np.log(prior / (1 - prior)) + told[vote + 1, np.arange(vote.shape[1])].sum(axis=1)
    return 1 / (1 + np.exp(-odds))


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, the plain test and the code of the vote pattern of every document."""

    def run(texts: list[bytes]) -> dict:
        counts = counts_of(texts)
        return counts | {"base_failed": base_failed(counts), "code": pattern_codes(votes(counts))}

    return per_text(documents, key, text, f"{COUNTS}, {SHAPE}, base_failed boolean, code long", run)


def posteriors(codes: DataFrame) -> DataFrame:
    """code, probability: one row for each pattern that occurs, fitted to the counts of all of them."""
    counted = sorted((r["code"], r["n"]) for r in codes.groupBy("code").agg(F.count("*").alias("n")).collect())
    code = np.array([c for c, _ in counted], np.int64)
    vote, weight = patterns(code), np.array([n for _, n in counted], float)
    chance = posterior(vote, *fitted(vote, weight))
    rows = [(int(c), float(p)) for c, p in zip(code, chance, strict=True)]
    return codes.sparkSession.createDataFrame(rows, "code long, probability double")


def verdicts(documents: DataFrame, key: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts and verdict of every document, one row each.

    A null or empty text has no words and fails. Repeated rows and repeated or null keys give a row each. No
    documents: no rows. Columns other than key and text are not read.
    """
    rows = saved(measured(documents, key, text), "quality")
    return (
        rows.join(posteriors(rows), "code")
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_from))
        .select(key, *[p.split()[0] for p in COUNTS.split(", ")], "base_failed", "kept", "probability")
    )


def good_documents(documents: DataFrame, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents with a good verdict, all columns unchanged. Null and empty texts fail; repeated rows are judged alike.

    No documents, no rows. The patterns are counted in a first pass. The second one reads each text again in place of moving it to its
    verdict by a shuffle.
    """

    def code(texts: list[bytes | None]) -> pa.Array:
        counts = counts_of(t or b"" for t in texts)
        return pa.array(np.where(base_failed(counts), -1, pattern_codes(votes(counts))))

    seen = saved(measured(documents.select(F.lit(0).alias("k"), F.col(text).alias("t")), "k", "t").select("code"), "patterns")
    good = [r["code"] for r in posteriors(seen).filter(F.col("probability") >= keep_from).collect()]
    name = fresh(documents, "_code")
    return appended(documents, text, name, "long", code).filter(F.col(name).isin(good)).drop(name)
