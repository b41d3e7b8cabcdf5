import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_of
from marketboard.config import LANGUAGE_CODES, PROTECTED_TERMS
from marketboard.functions.text import WORD_BREAK, mask_terms, restore_terms, words
from marketboard.operators import advice, chunks, retrieval


def by_hand(text, size=300, overlap=50, min_chars=50):
    """Chunks by the definition: runs of words every size - overlap words."""
    parts = text.split()
    runs = [" ".join(parts[s : s + size]) for s in range(0, len(parts), size - overlap)]
    return [r for r in runs if min_chars is None or len(r) > min_chars]


def chunked(spark, texts, **kwargs):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = chunks.text_chunks(df, **kwargs).orderBy("doc_id", "chunk_pos").collect()
    out = [[] for _ in texts]
    for r in rows:
        assert r["chunk_pos"] == len(out[r["doc_id"]])
        out[r["doc_id"]].append(r["chunk"])
    return out


def test_chunk_lengths(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 250, 251, 300, 301, 550)]
    texts += ["x" * 50, "x" * 51, None or "", "  lead and trail \t\n\x0b\x1c here ", "a b c　d"]
    assert chunked(spark, texts) == [by_hand(t) for t in texts]
    assert chunked(spark, texts, min_chars=None) == [by_hand(t, min_chars=None) for t in texts]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \t\n \x1d é", max_size=120), min_size=1, max_size=12))
def test_chunks_match_split_and_cover_every_word(spark, texts):
    got = chunked(spark, texts, size=5, overlap=2, min_chars=None)
    assert got == [by_hand(t, 5, 2, None) for t in texts]
    for text, runs in zip(texts, got):
        assert set(text.split()) == {w for r in runs for w in r.split(" ") if w}


def test_long_text_is_split_once(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = plan_of(chunks.text_chunks(df))
    assert plan.count("split(") == 1
    assert "Python" not in plan


def documents(spark, pages):
    rows = [(i, "Onion", f"doc{i}", p) for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, "doc_id bigint, crop string, source_doc string, pages array<string>")


def test_chunk_ids_are_dense_in_document_order(spark):
    body = " ".join(["word"] * 600)
    docs = documents(spark, [[body, "short"], [], ["short"], [body], None, ["x" * 60, "y" * 60]])
    got = chunks.chunk_table(docs).orderBy("chunk_id").collect()
    # the third run of a page lies within reach of its end and is kept as well
    assert [(r["chunk_id"], r["source_doc"], r["page"]) for r in got] == [
        (f"chunk_{i:04d}", d, p)
        for i, (d, p) in enumerate(
            [("doc0", 1)] * 3 + [("doc3", 1)] * 3 + [("doc5", 1), ("doc5", 2)]
        )
    ]


def keyed(spark, rows, kind):
    return spark.createDataFrame(rows, f"doc_id {kind}, crop string, source_doc string, pages array<string>")


@pytest.mark.parametrize(
    "kind,keys",
    [
        ("bigint", [0, 1, 7, 2**21 - 1, 2**21, 2**42, -5, 2**61, None, None, 7, 7]),
        ("string", ["b", "a", None, "ä", "a", "", "B", None, "a"]),
        ("date", [dt.date(2026, 1, 2), None, dt.date(2025, 1, 1), dt.date(2026, 1, 2)]),
    ],
)
def test_numbers_of_any_keys(spark, kind, keys):
    """Dense, in the order of the keys, missing ones last, and no chunk of a repeated key lost or doubled."""
    body = "z" * 51
    rows = [(k, "Onion", f"s{i}", [body, body + str(i)]) for i, k in enumerate(keys)]
    got = chunks.numbered_chunks(keyed(spark, rows, kind).repartition(3)).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(2 * len(keys)))
    assert [r["chunk_id"] for r in got] == [f"chunk_{i:04d}" for i in range(2 * len(keys))]
    there = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0].encode() if kind == "string" else r[0], r[2]))
    order = there + sorted((r for r in rows if r[0] is None), key=lambda r: r[2])
    assert [(r["doc_id"], r["source_doc"], r["page"], r["text"]) for r in got] == [
        (k, s, page, text) for k, _, s, pages in order for page, text in enumerate(pages, 1)
    ]


def test_a_hot_key_is_split(spark):
    """A third of all rows alike, most others without a key: no task numbers many times its share."""
    rows = [(None if i % 3 else 1, "Onion", "s", ["z" * 51 if i % 3 == 0 else "y" * 51 + str(i)]) for i in range(6000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df = chunks.numbered(keyed(spark, rows, "bigint"), chunks.document_order(keyed(spark, rows, "bigint")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    path = df.inputFiles()
    sizes = [spark.read.parquet(f).count() for f in path]
    assert sum(sizes) == 6000 and max(sizes) < 3 * 6000 / 4
    assert sorted(r["number"] for r in df.select("number").collect()) == list(range(6000))


def test_no_chunks(spark):
    assert chunks.numbered_chunks(documents(spark, [None, [], ["short"]])).count() == 0
    assert chunks.chunk_table(documents(spark, [["x"]]).limit(0)).count() == 0


def test_ids_grow_beyond_four_digits(spark):
    docs = documents(spark, [["z" * 51] * 6000, ["z" * 51] * 6000])
    ids = {r[0] for r in chunks.chunk_table(docs).select("chunk_id").collect()}
    assert ids == {f"chunk_{i:04d}" for i in range(12000)}


def test_no_text_moves_for_the_numbers(spark, tmp_path):
    documents(spark, [["z" * 51]] * 3).write.parquet(str(tmp_path / "docs"))
    df = chunks.numbered_chunks(spark.read.parquet(str(tmp_path / "docs")))
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    # the stored chunks, and their places alone for the sizes of the ranges
    assert final.count("FileScan") == 2 and final.count("text#") and "BroadcastHashJoin" in final
    assert not [line for line in final.splitlines() if "Exchange" in line and "Broadcast" not in line and "text" in line]


def test_first_passages_move_ranks_only(spark, tmp_path):
    """More splits than cores: each task passes on top_k narrow rows for a crop, and texts stay where they are."""
    path = str(tmp_path / "passages")
    rows = spark.range(0, 4000, 1, 16).select(
        F.col("id").alias("number"), F.concat(F.lit("Crop"), F.col("id") % 3).alias("crop"), F.lit("s").alias("source_doc"),
        F.lit(1).alias("page"), F.repeat(F.lit("words "), 50).alias("text"),
    )
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    seen = []
    held = retrieval.work_path
    retrieval.work_path = lambda s, name: seen.append(held(s, name)) or seen[-1]
    try:
        got = retrieval.first_passages(stored, top_k=2, order="number")
    finally:
        retrieval.work_path = held
    assert sorted((r["crop"], r["rank"], r["number"]) for r in got.collect()) == [
        (f"Crop{c}", k + 1, c + 3 * k) for c in range(3) for k in range(2)
    ]
    assert spark.read.parquet(seen[0]).columns == ["crop_key", "number", "rank"]
    final = plan_of(got).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and "Exchange hashpartitioning" not in final
    stored_plan = plan_of(stored.select(F.lower("crop").alias("crop_key"), "number").withColumn(
        "rank", F.row_number().over(Window.partitionBy("crop_key").orderBy("number"))).filter("rank <= 2"))
    below = stored_plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below and "Partial" in below and "text" not in below


@pytest.fixture(scope="module")
def passages(spark):
    rows = [
        ("p1", "Onion", "onion_storage", 4, "Sell kharif onion within 10 days of harvest in humid weather."),
        ("p2", "Tomato", "tomato_pests", 12, "Tomato prices fall after heavy rain during the harvest season."),
        ("p3", "Onion", "kharif_guide", 7, "Compare prices across two markets before committing to a sale."),
    ]
    return spark.createDataFrame(rows, "id string, crop string, source_doc string, page int, text string")


def test_unscored_retrieval(spark, passages):
    got = retrieval.first_passages(passages, top_k=1).collect()
    assert {(r["crop_key"], r["id"], r["rank"]) for r in got} == {("onion", "p1", 1), ("tomato", "p2", 1)}
    assert {"text", "source_doc", "page", "crop"} <= set(got[0].asDict())
    tomato = retrieval.first_passages(passages, top_k=5).filter("crop_key = 'tomato'").collect()
    assert [r["crop"] for r in tomato] == ["Tomato"]
    assert retrieval.first_passages_any(passages, top_k=10).count() == 3


def test_context_block(spark, passages):
    ranked = passages.filter("crop = 'Onion'").withColumn("rank", F.col("page")).withColumn("k", F.lit(1))
    text = retrieval.context_blocks(ranked, ["k"]).first()["context"]
    first, second = text.split("\n\n")
    assert first.startswith("[Advisory 1] Source: onion_storage | Crop: Onion | Page: 4\nSell kharif")
    assert second.startswith("[Advisory 2] Source: kharif_guide | Crop: Onion | Page: 7\n")
    blank = spark.createDataFrame(
        [(1, 1, None, None, None, "t")], "k int, rank int, source_doc string, crop string, page int, text string"
    )
    assert retrieval.context_blocks(blank, ["k"]).first()["context"] == (
        "[Advisory 1] Source: unknown | Crop: ? | Page: ?\nt"
    )


def masked(spark, text, terms=PROTECTED_TERMS):
    row = advice.with_mask(spark.createDataFrame([(text,)], "text string"), "text", terms).first()
    return row["mask"]["masked"], {e["key"]: e["value"] for e in row["mask"]["found"]}


def test_mask_and_restore(spark):
    text = "Sell your onions at Nashik mandi today for ₹820/quintal"
    hidden, found = masked(spark, text)
    assert "Nashik" not in hidden and "₹" not in hidden
    assert found == {"__TERM0__": "Nashik", "__TERM7__": "quintal", "__TERM8__": "₹"}
    df = spark.createDataFrame([(hidden, found)], "t string, found map<string,string>")
    back = df.select(restore_terms(F.col("t"), PROTECTED_TERMS, F.col("found"))).first()[0]
    assert back == text


def test_mask_follows_list_order(spark):
    # the second term is gone once the first is masked, and a placeholder can hold a later term
    assert masked(spark, "abc", ["abc", "b"]) == ("__TERM0__", {"__TERM0__": "abc"})
    assert masked(spark, "abc x", ["abc", "TERM"]) == (
        "____TERM1__0__ x", {"__TERM0__": "abc", "__TERM1__": "TERM"},
    )


def test_restore_only_what_was_masked(spark):
    df = spark.createDataFrame([("__TERM0__ and __TERM1__", {"__TERM0__": "Nashik"})], "t string, m map<string,string>")
    got = df.select(restore_terms(F.col("t"), PROTECTED_TERMS, F.col("m"))).first()[0]
    assert got == "Nashik and __TERM1__"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from([*PROTECTED_TERMS, "onion", " ", "_", "é"]), max_size=15).map("".join), min_size=1, max_size=10))
def test_mask_then_restore_is_identity(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hidden = mask_terms(F.col("t"), PROTECTED_TERMS)
    for text, hide, back in df.select("t", hidden, restore_terms(hidden, PROTECTED_TERMS)).collect():
        assert back == text and not any(term in hide for term in PROTECTED_TERMS)


def test_language_routing(spark):
    rows = spark.createDataFrame([("Sell in Pune. " + "x" * 600,)], "text string")
    got = {
        r["language"]: r
        for r in advice.route_language(advice.in_languages(rows, [*LANGUAGE_CODES, "Swahili"])).collect()
    }
    assert len(got) == 10
    for home in ("English", "Swahili"):
        assert not got[home]["needs_translation"] and got[home]["source_text"].startswith("Sell in Pune.")
        assert got[home]["placeholders"] is None
    hindi = got["Hindi"]
    assert hindi["language_code"] == "hi-IN" and hindi["placeholders"] == {"__TERM1__": "Pune"}
    assert hindi["source_text"].startswith("Sell in __TERM1__.")
    assert len(hindi["speech_source"]) == 500
    assert all(got[name]["language_code"] == code for name, code in LANGUAGE_CODES.items())


def test_prompt_and_answer(spark):
    row = spark.createDataFrame(
        [("Onion", "Pune", 1100.4, 4.8, "STABLE", "no rain", "MONITOR", "LOW", "Stable.", None)],
        "crop string, mandi string, modal_price double, pct_change_7d double, trend string, description string, "
        "decision string, confidence string, reason_en string, context string",
    )
    got = advice.with_recommendation(advice.with_prompts(row, "Adviser")).first()
    assert got["system_prompt"].startswith("You are Adviser, ")
    assert got["user_prompt"].startswith("Crop: Onion\nMandi (home): Pune\nToday's price: ₹1100/quintal\n7-day price change: +4.8%\n")
    assert got["user_prompt"].endswith('End with: "Source: [advisory name]"')
    assert got["recommendation"] == "MONITOR: Stable. Today's price at Pune is ₹1100/quintal (+4.8% vs last week)."


def routed(spark, make_translator=None, terms=PROTECTED_TERMS, **options):
    rows = spark.createDataFrame(
        [(1, "Sell Onion in Pune", "MSP is ₹20", "Hindi"), (2, "Hold", None, "Tamil"), (3, "Wait in Pune", "ICAR", "English"),
         (4, "Onion bad", "Tomato", "Hindi"), (5, "", "Nashik", "Swahili")],
        "id int, advice string, passage string, language string",
    )
    out = advice.route_texts(rows, ["advice", "passage"], terms=terms, make_translator=make_translator, **options)
    return {r["id"]: r for r in out.collect()}


def some_service():
    """Nested, so that tasks get it by value."""

    def service():
        def translate(texts, code):
            if code == "ta-IN" or any("bad" in t for t in texts):
                raise ConnectionError(code)
            return [f"<{code}> {t}" for t in texts]

        return translate

    return service


def test_both_texts_go_one_route_and_come_back_with_their_terms(spark):
    got = routed(spark, some_service(), batch_texts=2)
    assert got[1]["sources"] == {"advice": "Sell __TERM2__ in __TERM1__", "passage": "__TERM6__ is __TERM8__20"}
    assert got[1]["placeholders"]["passage"] == {"__TERM6__": "MSP", "__TERM8__": "₹"}
    assert got[1]["texts"] == {"advice": "<hi-IN> Sell Onion in Pune", "passage": "<hi-IN> MSP is ₹20"}
    assert got[1]["translated"] == {"advice": True, "passage": True}
    # a service that is down, a text that it cannot take, and texts that need none: the originals
    assert got[2]["texts"] == {"advice": "Hold", "passage": None} and not any(got[2]["translated"].values())
    assert got[4]["texts"] == {"advice": "Onion bad", "passage": "<hi-IN> Tomato"}
    assert got[4]["translated"] == {"advice": False, "passage": True}
    for i, advice_text in ((3, "Wait in Pune"), (5, "")):
        assert got[i]["texts"]["advice"] == got[i]["sources"]["advice"] == advice_text and not got[i]["needs_translation"]
        assert got[i]["placeholders"]["advice"] is None and not any(got[i]["translated"].values())


def test_no_translator_and_one_that_cannot_start(spark):
    def broken():
        raise OSError("no model")

    assert routed(spark, broken)[1]["texts"]["advice"] == "Sell Onion in Pune"
    assert routed(spark, lambda: lambda texts, code: texts[1:])[1]["texts"]["advice"] == "Sell Onion in Pune"
    waiting = routed(spark)
    assert waiting[1]["texts"] == {"advice": None, "passage": None} and waiting[3]["texts"]["advice"] == "Wait in Pune"


def test_words_are_split_at_blanks_without_a_regular_expression(spark):
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000))]
    rows = spark.createDataFrame([(f"ab{c}cd  e{c}",) for c in every] + [("",), (" ",), (None,)], "text string")
    by_pattern = F.array_remove(F.split("text", WORD_BREAK), "")
    assert rows.filter(~words(F.col("text")).eqNullSafe(by_pattern)).count() == 0
    assert "split(text" in (plan := plan_of(rows.select(words(F.col("text"))))) and ",  , -1)" in plan
