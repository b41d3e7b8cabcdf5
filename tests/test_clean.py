import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_of
from marketboard.config import CROP_ALIASES
from marketboard.functions.dates import parsed_date
from marketboard.functions.names import canonical_name
from marketboard.operators import audit, clean

RAW = "date string, crop string, mandi string, modal_price double, min_price double, max_price double, arrivals_tonnes double"


def raw(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2.0, 3.0)[:7] for r in rows], RAW)


def test_names(spark):
    cases = {
        "pyaaz": "Onion", "PYAAZ": "Onion", "ONION": "Onion", "tamatar": "Tomato",
        " onion": " Onion", "spring-onion": "Spring-onion", "green chilli": "Green Chilli", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = dict(df.select("raw", canonical_name(F.col("raw"), CROP_ALIASES)).collect())
    assert got == cases


def test_names_by_table_agree_with_literal(spark):
    aliases = spark.createDataFrame(list(CROP_ALIASES.items()), "alias string, name string")
    rows = raw(spark, [("d", c, "m", 1.0) for c in ["KANDA", "thakkali", "leek", " kanda", None]])
    by_literal = clean.normalise_crops(rows).select("crop").collect()
    by_table = clean.normalise_crops_by_table(rows, aliases).select("crop").collect()
    assert sorted(by_literal, key=str) == sorted(by_table, key=str)


def test_dates(spark):
    cases = {
        "2026-04-05": dt.date(2026, 4, 5), "05/04/2026": None, "2026-4-5": None, None: None,
        "2026-02-30": None, "2026-04-05 ": None, "2026-04-05T10:00:00": None, "2026-04-1T": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert dict(df.select("d", parsed_date(F.col("d"))).collect()) == cases
    both = df.select("d", parsed_date(F.col("d"), ("yyyy-MM-dd", "dd/MM/yyyy"))).collect()
    assert dict(both)["05/04/2026"] == dt.date(2026, 4, 5)


def test_clean_drops_what_it_should(spark):
    rows = raw(
        spark,
        [
            ("2026-01-01", "pyaaz", "Nashik", 10.0),
            ("05/04/2026", "Onion", "Nashik", 10.0),
            (None, "Onion", "Nashik", 10.0),
            ("2026-01-01", "Onion", "Nashik", None),
            ("2026-01-01", "Onion", "Nashik", float("nan")),
            ("2026-01-01", "Onion", "Nashik", 0.0),
            ("2026-01-01", "Onion", "Nashik", -1.0),
            ("2026-01-02", "Onion", "Nashik", 0.01),
            ("2026-01-01", "Onion", "nashik", 10.0),
            ("2026-01-01", " onion", "Nashik", 10.0),
            ("2026-01-01", "Leek", "Nashik", 10.0),
            ("2026-01-01", None, "Nashik", 10.0),
        ],
    )
    kept = clean.clean(rows, ["Onion"], ["Nashik"]).select("date", "crop", "modal_price").collect()
    assert sorted(map(tuple, kept)) == [
        (dt.date(2026, 1, 1), "Onion", 10.0), (dt.date(2026, 1, 2), "Onion", 0.01),
    ]
    counts = audit.stage_counts(rows, ["Onion"], ["Nashik"]).first()
    assert tuple(counts) == (12, 2, 2)


def test_best_price_keeps_whole_row_and_settles_ties(spark):
    rows = spark.createDataFrame(
        [
            ("d", "c", "m", 5.0, 1.0, 9.0, 1.0), ("d", "c", "m", 7.0, 2.0, 8.0, 2.0),
            ("d", "c", "m", 6.0, 3.0, 7.0, 3.0), ("e", "c", "m", 4.0, 1.0, 5.0, 1.0),
            ("e", "c", "m", 4.0, 3.0, 5.0, 9.0),
        ],
        RAW,
    )
    got = sorted(map(tuple, clean.best_price_per_day(rows).collect()))
    assert got == [("d", "c", "m", 7.0, 2.0, 8.0, 2.0), ("e", "c", "m", 4.0, 3.0, 5.0, 9.0)]


def test_hot_key_leaves_map_side_as_one_row_per_task(spark):
    many = spark.range(20_000).select(
        F.lit("2026-01-01").alias("date"), F.lit("c").alias("crop"), F.lit("m").alias("mandi"),
        F.col("id").cast("double").alias("modal_price"),
    )
    df = clean.best_price_per_day(many)
    assert df.first()["modal_price"] == 19_999.0
    plan = plan_of(df)
    assert plan.index("partial_max") > plan.index("Exchange")  # below the exchange


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["2026-01-01", "2026-01-02", "bad", None]),
            st.sampled_from(["onion", "kanda", "Tomato", None]),
            st.sampled_from(["Nashik", "Pune", "Elsewhere"]),
            st.one_of(st.none(), st.floats(-5, 50).map(lambda x: round(x, 2))),
        ),
        min_size=1, max_size=30,
    )
)
def test_silver_is_unique_and_no_longer_than_its_input(spark, rows):
    table = raw(spark, rows)
    out = clean.silver(table, crops=["Onion", "Tomato"], mandis=["Nashik", "Pune"]).collect()
    keys = [(r["date"], r["crop"], r["mandi"]) for r in out]
    assert len(set(keys)) == len(keys) <= len(rows)
    best = {}
    for d, c, m, p in rows:
        name = {"onion": "Onion", "kanda": "Onion", "Tomato": "Tomato"}.get(c)
        if d in ("2026-01-01", "2026-01-02") and name and m != "Elsewhere" and p and p > 0:
            key = (dt.date.fromisoformat(d), name, m)
            best[key] = max(best.get(key, 0), p)
    assert {k: r["modal_price"] for k, r in zip(keys, out)} == best
