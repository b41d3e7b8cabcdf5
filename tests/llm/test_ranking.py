"""Ranked search against sums over all terms of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marketboard.llm import ranking
from marketboard.llm.ranking import Graph, accumulated, mined, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCUMENTS = "doc_id long, text string, n long, score string, item_id int"
ITEMS = "item_id long, text string, doc_id string, rank int"


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, items, top=10):
    rows = [(i, words(t)) for i, t in documents if words(t)]
    n, total = len(rows), sum(len(w) for _, w in rows)
    df = Counter(t for _, w in rows for t in set(w))
    counted = [(i, len(w), Counter(w)) for i, w in rows]
    out = []
    for item, text in set(items):
        found = []
        for i, size, tf in counted:
            m = 100 - 75 + (75 * size * n) // total
            score = 0
            for t in words(text):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def texts(count, vocabulary, longest, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choice(vocabulary) + draw.choice(["", ".", ", ", "\n"]) for _ in range(draw.randint(0, longest))) for _ in range(count)]


VOCABULARY = ["Der", "der", "ÄPFEL", "äpfel", "x1", "漢字", "a b", "und", "river", "boat", "naïve", "it's", "K", "the"] + [f"w{i}" for i in range(40)]


@pytest.mark.parametrize("item_bytes", [1 << 19, 600])
def test_equals_brute_force(spark, item_bytes):
    docs = list(enumerate(texts(150, VOCABULARY, 60, 1)))
    docs += [(None, docs[3][1]), (None, docs[4][1]), (7, docs[7][1]), (500, None), (501, ""), (502, "!!! --- \x00"), (503, "river " * 30_000), (504, "漢" * 50_000)]
    items = list(enumerate(texts(40, VOCABULARY, 25, 2)))
    items += [(0, items[0][1]), (100, None), (101, ""), (102, "nowhereatall"), (None, "river boat"), (103, "river river river x1")]
    documents = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOCUMENTS).repartition(4)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    out = ranking.ranked(documents, asked, item_bytes=item_bytes)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(docs, items)


def test_nothing_to_search(spark):
    documents = spark.createDataFrame([(1, "river", 1, "x", 2)], DOCUMENTS)
    asked = spark.createDataFrame([(1, "river", "x", 1)], ITEMS)
    assert ranking.ranked(documents.limit(0), asked).count() == 0
    assert ranking.ranked(documents, asked.limit(0)).count() == 0
    assert ranking.ranked(documents.withColumn("text", documents["text"].substr(1, 0)), asked).count() == 0
    named = asked.withColumn("item_id", asked["text"])
    assert ranking.ranked(documents, named).collect()[0]["item_id"] == "river"


def test_terms():
    for text in ["It's ÄÖ 1,5 x_y\x00z\x7fé", "", "ſK", "  漢字 かな"]:
        assert [t.decode() for t in terms(text.encode())] == words(text)


def test_graph_sums_each_item_and_shares():
    draw = random.Random(4)
    common = [draw.sample(range(200), 12) for _ in range(10)]
    items = [sum(draw.sample(common, 3), []) + [draw.randrange(300) for _ in range(draw.randint(0, 10))] for _ in range(60)]
    items += [[], [5], [5, 5, 5], [5, 5, 5]]
    graph = mined(items, 300)
    assert graph.additions() < 0.6 * Graph(300, [], items).additions()
    values = np.random.default_rng(1).integers(0, 1000, (300, 7))
    values[draw.sample(range(300), 100)] = 0
    number, row = np.nonzero(values)
    scores = accumulated(graph, number, row, values[number, row], 7)
    for i, item in enumerate(items):
        assert (scores[i] == (values[item].sum(axis=0) if item else 0)).all()


def test_sums_are_made_of_earlier_symbols():
    items = [[1, 2, 3, 4], [1, 2, 3], [4, 4, 1, 2], [0]]
    graph = mined(items, 6)
    for i, (left, right) in enumerate(graph.sums, graph.terms):
        assert left < i and right < i
