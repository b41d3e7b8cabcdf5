"""Expected results as SQL over the same Parquet tables, keyed like the queries."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ---- fixed values: wordings that results must show ----------------------------------------------
PROTECTED_TERMS = ["Nashik", "Pune", "Onion", "Tomato", "APMC", "ICAR", "MSP", "quintal", "₹"]
LANGUAGE_CODES = {
    "English": "en-IN", "Hindi": "hi-IN", "Marathi": "mr-IN", "Telugu": "te-IN", "Tamil": "ta-IN", "Kannada": "kn-IN",
    "Gujarati": "gu-IN", "Bengali": "bn-IN", "Punjabi": "pa-IN",
}
SYSTEM_PROMPT = (
    "You are Market Board, an agricultural advisor for Indian smallholder farmers. "
    "Give clear, concise advice based on the price data and government advisory provided. "
    "Cite the specific advisory source at the end. "
    "Keep the response under 100 words. Do not use markdown formatting."
)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---- fragments ----------------------------------------------------------------------------------

CAP = "upper(left({0}, 1)) || lower(substr({0}, 2))"


def initcap(c: str) -> str:
    return f"(CASE WHEN left({c}, 1) = ' ' THEN ' ' || {CAP.format(f'substr({c}, 2)')} ELSE {CAP.format(c)} END)"


def crop_name(c: str) -> str:
    return f"(CASE lower({c}) WHEN 'large' THEN 'Onion' WHEN 'small' THEN 'Tomato' ELSE {initcap(c)} END)"


BRONZE = """bronze AS (
  SELECT CASE WHEN l_discount = 0.1::DOUBLE AND l_tax = 0.08::DOUBLE
              THEN strftime(l_shipdate, '%d/%m/%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
         CASE WHEN l_discount = 0.1::DOUBLE AND l_tax = 0.01::DOUBLE
              THEN ' ' || p_type ELSE p_type END AS crop,
         r_name AS mandi, n_name AS state,
         CASE WHEN l_discount = 0 AND l_tax = 0 THEN NULL
              WHEN l_discount = 0 AND l_tax = 0.08::DOUBLE THEN 0.0::DOUBLE
              WHEN l_discount = 0 AND l_tax = 0.07::DOUBLE THEN 0.0::DOUBLE - l_extendedprice
              ELSE l_extendedprice END AS modal_price,
         l_extendedprice - l_quantity AS min_price,
         l_extendedprice + l_quantity AS max_price,
         l_quantity AS arrivals_tonnes
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CROPS = "('Onion', 'Tomato', 'Economy', 'Medium', 'Promo', 'Standard')"
CLEAN = f"""cleaned AS (
  SELECT * FROM (
    SELECT CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS date, {crop_name('crop')} AS crop,
           mandi, state, modal_price, min_price, max_price, arrivals_tonnes FROM bronze)
  WHERE date IS NOT NULL AND modal_price > 0 AND crop IN {CROPS})"""
SILVER = """silver AS (
  SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY date, crop, mandi
    ORDER BY modal_price DESC, state DESC, min_price DESC, max_price DESC, arrivals_tonnes DESC) = 1)"""
UNITS = "CAST(floor(modal_price * 10000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def mean_of(total: str, rows: str) -> str:
    return f"CAST((2 * {total} + {rows} * 100) // (2 * {rows} * 100) AS DOUBLE) / 100.0::DOUBLE"


def trailing(rows: int) -> str:
    frame = f"OVER (PARTITION BY crop, mandi ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return mean_of(f"(sum({UNITS}) {frame})", f"(count(*) {frame})")


GOLD = f"""means AS (SELECT *, {trailing(7)} AS avg_7d, {trailing(30)} AS avg_30d FROM silver),
changed AS (SELECT *, round((modal_price - avg_7d) / avg_7d * 100.0::DOUBLE, 2) + 0.0::DOUBLE
            AS pct_change_7d FROM means),
gold AS (SELECT *, CASE WHEN pct_change_7d <= -5 THEN 'FALLING' WHEN pct_change_7d >= 5 THEN 'RISING'
         ELSE 'STABLE' END AS trend FROM changed)"""
LATEST = """latest AS (SELECT * FROM gold
  QUALIFY row_number() OVER (PARTITION BY crop, mandi ORDER BY date DESC) = 1)"""
SLOTS = """slots AS (
  SELECT r_name AS mandi, r_regionkey,
         CAST(DATE '2024-01-01' + 3 * CAST(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3.0) AS INT) AS DATE) AS period,
         (datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 3) * 8 + hour(ts) // 3 AS slot,
         sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) // count(*) AS k
  FROM events JOIN region ON user_id % 5 = r_regionkey GROUP BY ALL)"""
RAIN_ALL = """rain_all AS (
  SELECT mandi, period, coalesce(sum(CASE WHEN k >= 40 THEN k * (30 + 3 * r_regionkey) / 8192.0::DOUBLE END), 0.0::DOUBLE) AS mm
  FROM slots GROUP BY mandi, period)"""
RAIN = """rain AS (SELECT mandi, round(mm, 1) AS rain_3d_mm,
    CASE WHEN mm >= 5 THEN 'WET' ELSE 'DRY' END AS signal,
    printf('%.1f', round(mm, 1)) || ' mm rain forecast over next 3 days near ' || mandi AS description
  FROM rain_all QUALIFY row_number() OVER (PARTITION BY mandi ORDER BY period DESC) = 1)"""


def one(x: str) -> str:
    return f"printf('%.1f', round({x}, 1) + 0.0::DOUBLE)"


def decided(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT *, CASE decision
    WHEN 'SELL NOW' THEN 'Price fell ' || {one('abs(pct_change_7d)')} || '% in 7 days and ' || {one('rain_3d_mm')} || 'mm rain forecast — storage losses likely.'
    WHEN 'SELL SOON' THEN 'Price down ' || {one('abs(pct_change_7d)')} || '% over 7 days. Dry weather allows short storage — sell within 3-5 days.'
    WHEN 'HOLD' THEN 'Price up ' || {one('pct_change_7d')} || '% in 7 days. Dry weather favours continued gains.'
    WHEN 'HOLD SHORT' THEN 'Price rising (' || {one('pct_change_7d')} || '%) but ' || {one('rain_3d_mm')} || 'mm rain expected — hold 2-3 days max.'
    ELSE 'Price is stable. Monitor over next 3 days before deciding.' END AS reason_en
  FROM (SELECT *, CASE WHEN trend = 'FALLING' AND signal = 'WET' THEN 'SELL NOW'
                       WHEN trend = 'FALLING' THEN 'SELL SOON'
                       WHEN trend = 'RISING' AND signal = 'DRY' THEN 'HOLD'
                       WHEN trend = 'RISING' THEN 'HOLD SHORT' ELSE 'MONITOR' END AS decision,
                  CASE WHEN trend = 'STABLE' THEN 'LOW'
                       WHEN (trend = 'FALLING') = (signal = 'WET') THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
        FROM (SELECT g.*, coalesce(w.rain_3d_mm, 0) AS rain_3d_mm, coalesce(w.signal, 'DRY') AS signal,
                     coalesce(w.description, 'No weather data available for ' || g.mandi || '.') AS description
              FROM {source} g LEFT JOIN rain w USING (mandi))))"""


def answered(source: str) -> str:
    return f"""answered AS (SELECT *, decision || ': ' || reason_en || ' Today''s price at ' || mandi || ' is ₹' ||
    printf('%.0f', round(modal_price, 0)) || '/quintal (' || printf('%+.1f', round(pct_change_7d, 1) + 0.0::DOUBLE) || '% vs last week).'
    AS recommendation FROM {source})"""


PRICES = [BRONZE, CLEAN, SILVER]
PRICE_GOLD = [*PRICES, GOLD]
WEATHER = [SLOTS, RAIN_ALL, RAIN]
SERIES_ROWS = """series AS (SELECT crop, mandi, date AS ds, modal_price AS y,
  row_number() OVER (PARTITION BY crop, mandi ORDER BY date) AS pos,
  count(*) OVER (PARTITION BY crop, mandi) AS n_rows FROM silver)"""


def fitted(size: int = 60, suffix: str = "") -> str:
    return f"""train{suffix} AS (SELECT *, min(ds) OVER (PARTITION BY crop, mandi) AS origin FROM series
   WHERE pos <= {size} AND n_rows >= 30),
lines{suffix} AS (SELECT crop, mandi, min(origin) AS origin, max(ds) AS last_train, count(*) AS n_train,
   coalesce(regr_slope(y, CAST(ds - origin AS DOUBLE)), 0) AS slope,
   coalesce(regr_intercept(y, CAST(ds - origin AS DOUBLE)), avg(y)) AS intercept
   FROM train{suffix} GROUP BY crop, mandi),
onto{suffix} AS (SELECT t.crop, t.mandi, t.ds, t.y, dayofweek(t.ds) AS wd,
   l.intercept + l.slope * CAST(t.ds - l.origin AS DOUBLE) AS line
   FROM train{suffix} t JOIN lines{suffix} l USING (crop, mandi)),
wdf{suffix} AS (SELECT crop, mandi, wd, avg(y / line) AS factor FROM onto{suffix} GROUP BY crop, mandi, wd),
sig{suffix} AS (SELECT crop, mandi, sqrt(avg((y - line * factor) * (y - line * factor))) AS sigma
   FROM onto{suffix} JOIN wdf{suffix} USING (crop, mandi, wd) GROUP BY crop, mandi),
models{suffix} AS (SELECT * FROM lines{suffix} JOIN sig{suffix} USING (crop, mandi))"""


def predict(name: str, dates: str, suffix: str = "") -> str:
    """Forecast rows for a relation of (crop, mandi, ds, ...)."""
    return f"""{name} AS (SELECT d.*, (m.intercept + m.slope * CAST(d.ds - m.origin AS DOUBLE)) * coalesce(f.factor, 1) AS yhat, m.sigma
   FROM {dates} d JOIN models{suffix} m USING (crop, mandi)
   LEFT JOIN wdf{suffix} f ON f.crop = d.crop AND f.mandi = d.mandi AND f.wd = dayofweek(d.ds))"""


def ahead(name: str, periods: str, suffix: str = "") -> str:
    return f"""{name} AS (SELECT crop, mandi, CAST(i AS INT) AS pos, CAST(last_train + CAST(i AS INT) AS DATE) AS ds
   FROM models{suffix}, generate_series(1, {periods}) AS g(i))"""


BAND = """round(yhat, 2) + 0.0::DOUBLE AS yhat, round(yhat - 1.2816::DOUBLE * sigma, 2) + 0.0::DOUBLE AS yhat_lower,
   round(yhat + 1.2816::DOUBLE * sigma, 2) + 0.0::DOUBLE AS yhat_upper"""
MODELS = [*PRICES, SERIES_ROWS, fitted()]


def metrics(size: int, suffix: str) -> str:
    held = f"""held{suffix} AS (SELECT s.crop, s.mandi, s.y, CAST(l.last_train + CAST(s.pos - {size} AS INT) AS DATE) AS ds
   FROM series s JOIN lines{suffix} l USING (crop, mandi) WHERE s.pos > {size})"""
    return f"""{held},
{predict(f'pairs{suffix}', f'held{suffix}', suffix)},
metrics{suffix} AS (SELECT m.crop, m.mandi, coalesce(e.mape, 999.0::DOUBLE) AS mape, coalesce(e.mae, 999.0::DOUBLE) AS mae
   FROM models{suffix} m LEFT JOIN (SELECT crop, mandi, round(avg(abs(y - yhat) / abs(y)) * 100, 2) AS mape,
      round(avg(abs(y - yhat)), 2) AS mae FROM pairs{suffix} GROUP BY crop, mandi) e USING (crop, mandi))"""


RUN_STARTED_MS = 1_700_000_000_000
RUN_SIZES = (30, 60, 90)
RUNS = [
    *PRICES, SERIES_ROWS,
    *[part for n in RUN_SIZES for part in (fitted(n, f"_{n}"), metrics(n, f"_{n}"))],
    "runs AS (" + " UNION ALL ".join(
        f"SELECT crop, mandi, mape, mae, {n} AS size, {RUN_STARTED_MS + n}::BIGINT AS start_time, "
        f"{RUN_STARTED_MS + n + 1}::BIGINT AS end_time, "
        f"md5(crop || '|' || mandi || '|seasonality_mode=multiplicative|train_days={n}|{RUN_STARTED_MS + n}') AS run_id, "
        f"'models/' || crop || '_' || mandi AS model_path FROM metrics_{n}"
        for n in RUN_SIZES
    ) + ")",
]

WORD_BREAK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{WORD_BREAK}'), lambda x: x <> '')"


def runs_of_words(size: int, step: int, keep: str) -> str:
    return with_(
        f"listed AS (SELECT doc_id, {words('text')} AS ws FROM documents)",
        f"cut AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + {size}], ' ') AS chunk "
        f"FROM (SELECT doc_id, ws, unnest(range(0, len(ws), {step})) AS s FROM listed))",
    ) + f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_pos, chunk
FROM cut WHERE {keep}"""


PASSAGES = [
    """docs AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Onion' WHEN 'de' THEN 'Tomato' WHEN 'fr' THEN 'Standard'
   WHEN 'es' THEN 'Promo' ELSE upper(left(lang, 1)) || lower(substr(lang, 2)) END AS crop, source AS source_doc,
   string_split(text, chr(10)) AS pages FROM documents)""",
    f"""pages_ AS (SELECT doc_id, crop, source_doc, page, {words('body')} AS ws FROM (
   SELECT doc_id, crop, source_doc, unnest(pages) AS body, generate_subscripts(pages, 1) AS page FROM docs))""",
    """cut AS (SELECT doc_id, crop, source_doc, page, s, array_to_string(ws[s + 1 : s + 300], ' ') AS text FROM (
   SELECT *, unnest(range(0, len(ws), 250)) AS s FROM pages_))""",
    """passages AS (SELECT 'chunk_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS id,
   crop, source_doc, CAST(page AS INT) AS page, text FROM (
   SELECT *, row_number() OVER (ORDER BY doc_id, page, s) - 1 AS n FROM cut WHERE length(text) > 50))""",
]


def firsts(k: int) -> str:
    return f"""firsts AS (SELECT *, lower(crop) AS crop_key, row_number() OVER (PARTITION BY lower(crop) ORDER BY length(id), id) AS rank
   FROM passages QUALIFY rank <= {k})"""


BLOCKS = """blocks AS (SELECT crop_key, string_agg('[Advisory ' || rank || '] Source: ' || coalesce(source_doc, 'unknown') ||
   ' | Crop: ' || coalesce(crop, '?') || ' | Page: ' || coalesce(CAST(page AS VARCHAR), '?') || chr(10) || text,
   chr(10) || chr(10) ORDER BY rank) AS context FROM firsts GROUP BY crop_key)"""


def masked(c: str, terms) -> str:
    for i, t in enumerate(terms):
        c = f"replace({c}, '{t}', '__TERM{i}__')"
    return c


def placeholders(c: str, terms) -> str:
    found = []
    for i, t in enumerate(terms):
        found.append(f"CASE WHEN contains({masked(c, terms[:i])}, '{t}') THEN '__TERM{i}__={t}' END")
    return "concat_ws(',', " + ", ".join(found) + ")"


D = "CAST(date AS VARCHAR) AS date"
GOLD_COLUMNS = f"""{D}, crop, mandi, state, modal_price, min_price, max_price, arrivals_tonnes,
   avg_7d, avg_30d, pct_change_7d, trend"""
SILVER_COLUMNS = f"{D}, crop, mandi, state, modal_price, min_price, max_price, arrivals_tonnes"

# ---- sources and sinks --------------------------------------------------------------------------

ORACLE["csv_stream_ingest"] = with_(BRONZE) + """SELECT date, crop, mandi, modal_price, min_price, max_price,
  arrivals_tonnes FROM bronze"""
ORACLE["stream_rerun"] = with_(BRONZE) + """SELECT step, mandi, count(*) * times AS rows FROM bronze,
  (VALUES ('first', 1), ('again', 1), ('more', 2)) AS v(step, times) GROUP BY step, mandi, times"""
ORACLE["csv_typed_read"] = with_(BRONZE) + """SELECT date, crop, mandi, modal_price, min_price,
  CASE WHEN arrivals_tonnes < 40 THEN max_price END AS max_price, arrivals_tonnes, state FROM bronze"""
ORACLE["csv_export"] = with_(*PRICES) + f"""SELECT {D}, crop, mandi, modal_price, min_price, max_price,
  arrivals_tonnes FROM silver"""
ORACLE["evolving_append"] = with_(*PRICES) + """SELECT crop, NULL AS state, count(*) AS rows, 0 AS with_state
  FROM silver GROUP BY crop UNION ALL SELECT crop, state, count(*), count(state) FROM silver GROUP BY crop, state"""
ORACLE["partitioned_overwrite"] = with_(*PRICES) + f"SELECT {SILVER_COLUMNS} FROM silver"
ORACLE["filtered_table_read"] = ORACLE["partitioned_overwrite"] + " WHERE crop = 'Onion' AND modal_price >= 50000"
ORACLE["namespace_table"] = with_(BRONZE, "n AS (SELECT crop, mandi, count(*) AS rows FROM bronze GROUP BY crop, mandi)") + \
    "SELECT * FROM n UNION ALL SELECT * FROM n"
ORACLE["bronze_batch_load"] = with_(BRONZE) + "SELECT * FROM bronze"
ORACLE["json_price_records"] = with_(BRONZE) + """SELECT date, crop, mandi, modal_price, min_price, max_price,
  arrivals_tonnes FROM bronze UNION ALL SELECT date, crop, mandi, modal_price, NULL, NULL, arrivals_tonnes FROM bronze"""
ORACLE["dimension_mandis"] = """SELECT s_name AS mandi, n_name AS state, s_acctbal / 128 AS lat, s_acctbal / 64 AS lon,
  'MH-' || s_suppkey AS apmc_code FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
ORACLE["dimension_crops"] = """SELECT p_brand || '/' || p_partkey AS crop, replace(p_name, ' ', ',') AS aliases,
  CAST(p_size % 12 + 1 AS VARCHAR) AS harvest_months, p_size AS shelf_life_days, p_type AS rain_sensitivity FROM part"""
ORACLE["dimension_aliases"] = """SELECT unnest(string_split(p_name, ' ')) AS alias, p_brand || '/' || p_partkey AS name
  FROM part"""

# ---- projections and filters ----------------------------------------------------------------------

ORACLE["crop_names"] = with_(BRONZE) + f"""SELECT crop AS raw, {crop_name('crop')} AS crop, count(*) AS rows
  FROM bronze GROUP BY 1, 2"""
ORACLE["crop_names_by_table"] = """WITH a AS (SELECT lower(p_name) AS alias, min(p_brand) AS name FROM part GROUP BY 1)
  SELECT name AS crop, count(*) AS rows FROM part JOIN a ON lower(p_name) = alias GROUP BY 1"""
ORACLE["parsed_dates"] = with_(BRONZE) + """SELECT CAST(CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS VARCHAR) AS date,
  count(*) AS rows FROM bronze GROUP BY 1"""
ORACLE["parsed_dates_two_formats"] = with_(BRONZE) + """SELECT CAST(CAST(coalesce(try_strptime(date, '%Y-%m-%d'),
  try_strptime(date, '%d/%m/%Y')) AS DATE) AS VARCHAR) AS date, count(*) AS rows FROM bronze GROUP BY 1"""
ORACLE["complete_rows"] = with_(BRONZE) + """SELECT crop, mandi, count(*) AS rows FROM bronze
  WHERE try_strptime(date, '%Y-%m-%d') IS NOT NULL AND modal_price IS NOT NULL GROUP BY 1, 2"""
ORACLE["target_rows"] = with_(BRONZE) + f"""SELECT {crop_name('crop')} AS crop, mandi, count(*) AS rows FROM bronze
  WHERE {crop_name('crop')} IN ('Onion', 'Tomato') AND mandi IN ('ASIA', 'EUROPE') GROUP BY 1, 2"""
ORACLE["target_rows_by_table"] = with_(BRONZE) + """SELECT crop, mandi, count(*) AS rows FROM bronze WHERE mandi IN (
  SELECT r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_acctbal > 9000) GROUP BY 1, 2"""
ORACLE["positive_prices"] = with_(BRONZE) + """SELECT crop, mandi, count(*) AS rows FROM bronze
  WHERE modal_price > 0 GROUP BY 1, 2"""
ORACLE["clean_rows"] = with_(BRONZE, CLEAN) + f"SELECT {SILVER_COLUMNS} FROM cleaned"
ORACLE["gold_features"] = with_(*PRICE_GOLD) + f"SELECT {GOLD_COLUMNS} FROM gold"
ORACLE["series_point"] = ORACLE["gold_features"] + " WHERE crop = 'Onion' AND mandi = 'ASIA'"
ORACLE["series_view"] = with_(*PRICES) + """SELECT crop, mandi, CAST(date AS VARCHAR) AS ds, modal_price AS y
  FROM silver"""
ORACLE["lookup_defaults"] = """SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier)
  THEN n_name ELSE 'NO SUPPLIER' END AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

# ---- counts and profiles ----------------------------------------------------------------------------

ORACLE["rows_per_series"] = with_(BRONZE) + "SELECT crop, mandi, count(*) AS rows FROM bronze GROUP BY 1, 2"
ORACLE["coverage"] = with_(*PRICES) + f"""SELECT crop, mandi, count(*) AS rows, CAST(min(date) AS VARCHAR) AS from_date,
  CAST(max(date) AS VARCHAR) AS to_date, {mean_of(f'sum({UNITS})', 'count(*)')} AS avg_price FROM silver GROUP BY 1, 2"""
ORACLE["trend_distribution"] = with_(*PRICE_GOLD) + """SELECT crop, mandi, trend, count(*) AS rows FROM gold
  GROUP BY 1, 2, 3"""
ORACLE["chunks_per_document"] = with_(*PASSAGES) + """SELECT crop, source_doc, count(*) AS chunks FROM passages
  GROUP BY 1, 2"""
ORACLE["value_profile"] = with_(BRONZE) + """SELECT 'date' AS field, date AS value, count(*) AS rows FROM bronze GROUP BY 2
  UNION ALL SELECT 'crop', crop, count(*) FROM bronze GROUP BY 2 UNION ALL SELECT 'mandi', mandi, count(*) FROM bronze
  GROUP BY 2"""
ORACLE["stage_counts"] = with_(*PRICES) + """SELECT (SELECT count(*) FROM bronze) AS bronze_rows,
  (SELECT count(*) FROM cleaned) AS clean_rows, (SELECT count(*) FROM silver) AS silver_rows"""

# ---- windows ----------------------------------------------------------------------------------------

ORACLE["silver_rows"] = ORACLE["partitioned_overwrite"]
ORACLE["rolling_means"] = with_(*PRICE_GOLD) + f"SELECT crop, mandi, {D}, avg_7d AS mean_7, avg_30d AS mean_30 FROM gold"
ORACLE["train_test_split"] = with_(*PRICES, SERIES_ROWS) + """SELECT crop, mandi,
  CASE WHEN pos <= 60 THEN 'train' ELSE 'test' END AS part, count(*) AS rows, CAST(min(ds) AS VARCHAR) AS first,
  CAST(max(ds) AS VARCHAR) AS last FROM series GROUP BY 1, 2, 3"""
ORACLE["long_series"] = with_(*PRICES) + """SELECT crop, mandi, count(*) AS rows FROM silver GROUP BY 1, 2
  HAVING count(*) >= 1300"""

# ---- latest and top-k -------------------------------------------------------------------------------

ORACLE["latest_per_series"] = with_(*PRICE_GOLD, LATEST) + f"SELECT {GOLD_COLUMNS} FROM latest"
ORACLE["latest_table_date"] = ORACLE["partitioned_overwrite"] + " WHERE date = (SELECT max(s.date) FROM silver s)"
ORACLE["latest_by_crop"] = with_(*PRICES) + f"""SELECT crop, mandi, {D}, modal_price FROM silver s
  WHERE date = (SELECT max(t.date) FROM silver t WHERE t.crop = s.crop) AND mandi IN ('ASIA', 'EUROPE', 'AMERICA')"""
BOARD = """board AS (SELECT crop, '{' || string_agg('"' || mandi || '":' || modal_price, ',' ORDER BY mandi) || '}' AS prices
  FROM silver s WHERE date = (SELECT max(t.date) FROM silver t WHERE {0}) GROUP BY crop)"""
ORACLE["price_board"] = with_(*PRICES, BOARD.replace("{0}", "t.crop = s.crop")) + "SELECT * FROM board"
ORACLE["price_board_map"] = with_(*PRICES, BOARD.replace("{0}", "true")) + \
    """SELECT '{' || string_agg('"' || crop || '":' || prices, ',' ORDER BY crop) || '}' AS board FROM board"""
ORACLE["last_prices"] = with_(*PRICES) + f"""SELECT crop, mandi, {D}, modal_price,
  CAST(row_number() OVER (PARTITION BY crop, mandi ORDER BY date) AS INT) AS pos FROM (SELECT * FROM silver
  QUALIFY row_number() OVER (PARTITION BY crop, mandi ORDER BY date DESC) <= 10)"""
ORACLE["newest_rows"] = with_(*PRICE_GOLD) + f"""SELECT {GOLD_COLUMNS} FROM (SELECT * FROM gold
  ORDER BY date DESC, crop, mandi LIMIT 10)"""
ORACLE["result_preview"] = with_(BRONZE, """grouped AS (SELECT CAST(CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS VARCHAR)
  AS date, mandi, count(*) AS ticks FROM bronze GROUP BY 1, 2)""") + """SELECT coalesce(date, '—') AS date,
  mandi, CAST(ticks AS VARCHAR) AS ticks, (SELECT count(*) FROM grouped) AS row_count
  FROM (SELECT * FROM grouped ORDER BY mandi, date NULLS FIRST LIMIT 20)"""
ORACLE["union_extracts"] = with_(*PRICES) + f"""SELECT {D}, crop, mandi, CASE WHEN crop <> 'Standard' THEN state END AS state,
  modal_price, min_price, max_price, arrivals_tonnes FROM silver"""

# ---- weather and verdicts ---------------------------------------------------------------------------

ORACLE["rain_totals"] = with_(SLOTS, RAIN_ALL) + "SELECT mandi, CAST(period AS VARCHAR) AS period, mm FROM rain_all"
ORACLE["weather_signals"] = with_(SLOTS, RAIN_ALL) + """SELECT mandi, CAST(period AS VARCHAR) AS period,
  round(mm, 1) AS rain_3d_mm, CASE WHEN mm >= 5 THEN 'WET' ELSE 'DRY' END AS signal,
  printf('%.1f', round(mm, 1)) || ' mm rain forecast over next 3 days near ' || mandi AS description FROM rain_all"""
ORACLE["weather_defaults"] = with_(*PRICE_GOLD, LATEST, *WEATHER) + """SELECT crop, l.mandi, trend,
  coalesce(rain_3d_mm, 0) AS rain_3d_mm, coalesce(signal, 'DRY') AS signal,
  coalesce(description, 'No weather data available for ' || l.mandi || '.') AS description
  FROM latest l LEFT JOIN rain w ON l.mandi = w.mandi AND w.mandi > 'B'"""
ORACLE["rule_lookup"] = with_(*PRICE_GOLD, *WEATHER, decided("d", "gold")) + """SELECT trend, signal, decision, confidence,
  count(*) AS rows FROM d GROUP BY ALL"""
ORACLE["verdicts"] = with_(*PRICE_GOLD, LATEST, *WEATHER, decided("d", "latest")) + f"""SELECT decision, confidence, reason_en,
  crop, mandi, {D}, trend, pct_change_7d, rain_3d_mm, description FROM d"""
ORACLE["verdicts_all_days"] = with_(*PRICE_GOLD, *WEATHER, decided("d", "gold")) + \
    f"SELECT crop, mandi, {D}, decision, confidence, reason_en FROM d"
ORACLE["trend_verdicts"] = with_(*PRICE_GOLD) + f"""SELECT crop, mandi, {D},
  CASE trend WHEN 'FALLING' THEN 'SELL SOON' WHEN 'RISING' THEN 'HOLD' ELSE 'MONITOR' END AS decision,
  CASE trend WHEN 'FALLING' THEN 'MEDIUM' WHEN 'RISING' THEN 'HIGH' ELSE 'LOW' END AS confidence,
  CASE trend WHEN 'FALLING' THEN 'Price is down ' || {one('abs(pct_change_7d)')} || '% over 7 days at ' || mandi || '. Sell within 3-5 days.'
    WHEN 'RISING' THEN 'Price is up ' || {one('pct_change_7d')} || '% over 7 days at ' || mandi || '. Hold for better returns.'
    ELSE 'Price is stable at ' || mandi || '. Monitor daily before deciding.' END AS reason_en FROM gold"""

# ---- forecasts --------------------------------------------------------------------------------------

ORACLE["fitted_models"] = with_(*MODELS) + """SELECT crop, mandi, CAST(origin AS VARCHAR) AS origin,
  CAST(last_train AS VARCHAR) AS last_train, n_train, round(intercept, 4) + 0.0::DOUBLE AS intercept,
  round(slope, 4) + 0.0::DOUBLE AS slope, round(sigma, 4) + 0.0::DOUBLE AS sigma,
  (SELECT string_agg(wd || ':' || printf('%.4f', round(factor, 4)), ' ' ORDER BY wd) FROM wdf w
   WHERE w.crop = m.crop AND w.mandi = m.mandi) AS weekday_factors FROM models m"""
ORACLE["forecast_bands"] = with_(*MODELS, ahead("days", "10"), predict("p", "days")) + \
    f"SELECT crop, mandi, pos, CAST(ds AS VARCHAR) AS ds, {BAND} FROM p"
ORACLE["forecast_tail"] = with_(*MODELS, ahead("days", "30"), predict("p", "days")) + \
    f"SELECT crop, mandi, CAST(ds AS VARCHAR) AS ds, {BAND} FROM p WHERE pos > 23"
ORACLE["future_dates"] = with_(*PRICES) + """SELECT crop, mandi, CAST(last + CAST(i AS INT) AS VARCHAR) AS ds
  FROM (SELECT crop, mandi, max(date) AS last FROM silver GROUP BY 1, 2), generate_series(1, 10) AS g(i)"""
ORACLE["holdout_metrics"] = with_(*MODELS, metrics(60, "")) + "SELECT * FROM metrics"
ORACLE["paired_by_position"] = with_(*MODELS, ahead("days", "45"), predict("p", "days")) + """SELECT s.crop, s.mandi,
  CAST(s.pos - 60 AS INT) AS pos, CAST(s.ds AS VARCHAR) AS ds, CAST(p.ds AS VARCHAR) AS forecast_ds, s.y,
  round(p.yhat, 2) + 0.0::DOUBLE AS yhat FROM series s JOIN p ON p.crop = s.crop AND p.mandi = s.mandi AND p.pos = s.pos - 60"""
ORACLE["paired_by_date"] = with_(*MODELS, ahead("days", "45"), predict("p", "days")) + """SELECT s.crop, s.mandi,
  CAST(s.ds AS VARCHAR) AS ds, s.y, round(p.yhat, 2) + 0.0::DOUBLE AS yhat
  FROM series s JOIN p ON p.crop = s.crop AND p.mandi = s.mandi AND p.ds = s.ds WHERE s.pos > 60"""
DETAIL = ["held AS (SELECT crop, mandi, ds, y FROM series WHERE pos > 60)", predict("p", "held"),
          "detail AS (SELECT crop, mandi, ds, y, yhat, round((y - yhat) / y * 100, 1) + 0.0::DOUBLE AS error_pct FROM p)"]
ORACLE["backtest_detail"] = with_(*MODELS, *DETAIL) + """SELECT crop, mandi, CAST(ds AS VARCHAR) AS date,
  CAST(trunc(y) AS BIGINT) AS actual, CAST(trunc(yhat) AS BIGINT) AS predicted, error_pct FROM detail"""
ORACLE["backtest_summary"] = with_(*MODELS, *DETAIL) + """SELECT crop, mandi,
  CAST((2 * s + n) // (2 * n) AS DOUBLE) / 100.0::DOUBLE AS mape FROM (SELECT crop, mandi, count(*) AS n,
  sum(CAST(floor(abs(error_pct) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS s FROM detail GROUP BY 1, 2)"""
SUMMARY = "crop, mandi, mape, mae, run_id, model_path"
ORACLE["run_ledger"] = with_(*RUNS) + """SELECT run_id, crop || '_' || mandi AS run_name, crop, mandi, start_time, end_time,
  'FINISHED' AS status, CAST(size AS VARCHAR) AS train_days, crop AS param_crop, mape, mae, model_path FROM runs"""
ORACLE["ranked_runs"] = with_(*RUNS) + f"SELECT {SUMMARY}, CASE WHEN mape < 60 THEN 'GOOD' ELSE 'CHECK' END AS flag FROM runs"
ORACLE["best_run"] = with_(*RUNS) + f"SELECT {SUMMARY} FROM runs ORDER BY mape, run_id LIMIT 1"
BEST = "best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY crop, mandi ORDER BY mape, run_id) = 1)"
ORACLE["best_run_per_series"] = with_(*RUNS, BEST) + f"SELECT {SUMMARY} FROM best"
ORACLE["models_of_best_runs"] = with_(
    *RUNS, BEST, *[p for n in RUN_SIZES for p in (ahead(f"days_{n}", "5", f"_{n}"), predict(f"p_{n}", f"days_{n}", f"_{n}"))],
    "p AS (" + " UNION ALL ".join(
        f"SELECT p.* FROM p_{n} p JOIN best b ON b.crop = p.crop AND b.mandi = p.mandi AND b.size = {n}" for n in RUN_SIZES) + ")",
) + f"SELECT crop, mandi, pos, CAST(ds AS VARCHAR) AS ds, {BAND} FROM p"
# served forecasts are fitted on all rows of a series
ORACLE["price_outlook"] = with_(
    *PRICES, SERIES_ROWS, fitted(1_000_000_000, "_all"), ahead("days", "10", "_all"), predict("p", "days", "_all"), """tail AS (SELECT crop, mandi, date, modal_price
  FROM silver QUALIFY row_number() OVER (PARTITION BY crop, mandi ORDER BY date DESC) <= 10)""",
  f"f AS (SELECT crop, mandi, pos, ds, {BAND} FROM p)") + f"""
  SELECT crop, mandi, 'actual' AS kind, {D}, round(modal_price, 2) + 0.0::DOUBLE AS price, NULL::DOUBLE AS yhat_lower, NULL::DOUBLE AS yhat_upper FROM tail
  UNION ALL SELECT crop, mandi, 'forecast', CAST(ds AS VARCHAR), yhat, yhat_lower, yhat_upper FROM f
  UNION ALL SELECT crop, mandi, 'connector', CAST(ds AS VARCHAR), yhat, NULL, NULL FROM f WHERE pos = 1
  UNION ALL SELECT crop, mandi, 'connector', CAST(max(date) AS VARCHAR), round(arg_max(modal_price, date), 2), NULL, NULL FROM tail GROUP BY crop, mandi"""

# ---- texts ------------------------------------------------------------------------------------------

ORACLE["text_chunks"] = runs_of_words(300, 250, "length(chunk) > 50")
ORACLE["text_chunks_all"] = runs_of_words(120, 90, "true")
ORACLE["chunk_table"] = with_(*PASSAGES) + "SELECT id AS chunk_id, crop, source_doc, page, text FROM passages"
ORACLE["first_passages"] = with_(*PASSAGES, firsts(3)) + \
    "SELECT crop_key, CAST(rank AS INT) AS rank, id, source_doc, page, text FROM firsts"
ORACLE["first_passages_any"] = with_(*PASSAGES) + """SELECT CAST(row_number() OVER (ORDER BY length(id), id) AS INT) AS rank, id,
  source_doc, page, text FROM passages QUALIFY rank <= 10"""
ORACLE["context_blocks"] = with_(*PASSAGES, firsts(3), BLOCKS) + "SELECT * FROM blocks"
ADVISED = [*PRICE_GOLD, *WEATHER, decided("d", "gold"), answered("d")]
LATEST_ADVISED = [*PRICE_GOLD, LATEST, *WEATHER, decided("d", "latest"), answered("d")]
ORACLE["recommendations"] = with_(*ADVISED) + f"SELECT crop, mandi, {D}, recommendation FROM answered"
ORACLE["prompts"] = with_(*LATEST_ADVISED, *PASSAGES, firsts(2), BLOCKS) + f"""SELECT crop, mandi,
  '{SYSTEM_PROMPT}' AS system_prompt,
  'Crop: ' || crop || chr(10) || 'Mandi (home): ' || mandi || chr(10) ||
  'Today''s price: ₹' || printf('%.0f', round(modal_price, 0)) || '/quintal' || chr(10) ||
  '7-day price change: ' || printf('%+.1f', round(pct_change_7d, 1) + 0.0::DOUBLE) || '%' || chr(10) ||
  'Price trend: ' || trend || chr(10) || 'Weather forecast: ' || description || chr(10) ||
  'Verdict: ' || decision || ' (confidence: ' || confidence || ')' || chr(10) || 'Reason: ' || reason_en || chr(10) || chr(10) ||
  'Government Advisory Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) ||
  'Write a farmer-friendly recommendation in plain English (2-3 sentences). End with: "Source: [advisory name]"' AS user_prompt
  FROM answered LEFT JOIN blocks ON crop_key = lower(crop)"""
ORACLE["masked_texts"] = with_(*ADVISED) + f"""SELECT crop, mandi, {D}, {masked('recommendation', PROTECTED_TERMS)} AS masked,
  {placeholders('recommendation', PROTECTED_TERMS)} AS placeholders FROM answered"""
ORACLE["restored_texts"] = f"""SELECT doc_id, md5({masked('text', ['the', 'que', 'und', 'los'])}) AS masked_digest,
  md5(text) AS restored_digest FROM documents"""
ORACLE["speech_texts"] = "SELECT doc_id, left(text, 500) AS speech FROM documents"
LANGUAGES = "languages(language, language_code) AS (VALUES " + ", ".join(
    [f"('{k}', '{v}')" for k, v in LANGUAGE_CODES.items()] + ["('Swahili', NULL)"]) + ")"
COUNT_TERMS = " + ".join(f"contains({masked('recommendation', PROTECTED_TERMS[:i])}, '{t}')::INT" for i, t in enumerate(PROTECTED_TERMS))
ORACLE["language_routing"] = with_(*ADVISED, LANGUAGES, """routed AS (SELECT *, language_code IS NOT NULL AND language <> 'English'
  AS foreign_ FROM answered, languages)""") + f"""SELECT language, language_code, foreign_::INT AS needs_translation, crop, mandi,
  count(*) AS rows, CAST(sum(CAST('0x' || left(md5(CASE WHEN foreign_ THEN {masked('recommendation', PROTECTED_TERMS)} ELSE recommendation END), 8) AS BIGINT)) AS BIGINT) AS digest,
  CAST(sum(CASE WHEN foreign_ THEN {COUNT_TERMS} ELSE 0 END) AS BIGINT) AS placeholders FROM routed GROUP BY 1, 2, 3, 4, 5"""

# ---- vectors ----------------------------------------------------------------------------------------

VECTORS = [
    "vecs AS (SELECT vec_id AS id, label, 'Crop' || label AS crop, embedding::DOUBLE[] AS e FROM embeddings)",
    """sums AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM vecs)
  GROUP BY label, i)""",
    """queries AS (SELECT label AS query_id, list(v / norm ORDER BY i) AS q FROM sums
  JOIN (SELECT label, sqrt(sum(v * v)) AS norm FROM sums GROUP BY label) USING (label) GROUP BY label)""",
    "scored AS (SELECT query_id, id, label, crop, round(list_inner_product(q, e), 6) + 0.0::DOUBLE AS score FROM queries, vecs)",
]
NUMBERED = """SELECT CAST(query_id AS BIGINT) AS query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank,
  id, {cols} score FROM {source} QUALIFY rank <= {k}"""
ORACLE["vector_topk"] = with_(*VECTORS) + NUMBERED.format(cols="", source="scored", k=10)
ORACLE["vector_topk_cells"] = ORACLE["vector_topk"]
ORACLE["retrieve_postfilter"] = with_(*VECTORS, """near AS (SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 12)""",
  "own AS (SELECT * FROM near WHERE label = query_id)") + NUMBERED.format(cols="crop,", source="own", k=4)
ORACLE["retrieve_prefilter"] = with_(*VECTORS, "own AS (SELECT * FROM scored WHERE label = query_id)") + \
    NUMBERED.format(cols="crop,", source="own", k=4)
ORACLE["vector_table"] = """SELECT vec_id AS id, 'Crop' || label AS crop, CAST(len(embedding) AS INT) AS dim,
  round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings"""

# ---- compositions -----------------------------------------------------------------------------------

FIRST = """firstp AS (SELECT crop_key, text AS advisory_text, 'Source: ' || source_doc || ' | Page ' || page AS advisory_source
  FROM firsts WHERE rank = 1)"""
ORACLE["verdict_passages"] = with_(*LATEST_ADVISED, *PASSAGES, firsts(2), FIRST) + """SELECT crop, mandi, decision,
  advisory_text, advisory_source FROM answered LEFT JOIN firstp ON crop_key = lower(crop)"""
BOARD_INT = """board AS (SELECT crop, '{' || string_agg('"' || mandi || '":' || CAST(trunc(modal_price) AS BIGINT), ',' ORDER BY mandi) || '}' AS all_prices
  FROM silver s WHERE date = (SELECT max(t.date) FROM silver t WHERE t.crop = s.crop) GROUP BY crop)"""
ORACLE["advisory_board"] = with_(*LATEST_ADVISED, *PASSAGES, firsts(2), FIRST, BLOCKS, BOARD_INT,
    "languages(language, language_code) AS (VALUES ('English', 'en-IN'), ('Hindi', 'hi-IN'), ('Tamil', 'ta-IN'))") + f"""SELECT
  a.crop, mandi, language, decision, confidence, CAST(trunc(modal_price) AS BIGINT) AS modal_price,
  printf('%+.1f', round(pct_change_7d, 1) + 0.0::DOUBLE) AS pct_change, trend, signal || ' — ' || {one('rain_3d_mm')} || ' mm' AS weather,
  recommendation, CASE WHEN language = 'English' THEN recommendation ELSE {masked('recommendation', PROTECTED_TERMS)} END AS source_text,
  language_code, advisory_text, advisory_source, context, all_prices
  FROM answered a LEFT JOIN firstp f ON f.crop_key = lower(a.crop) LEFT JOIN blocks b ON b.crop_key = lower(a.crop)
  LEFT JOIN board USING (crop), languages"""
ORACLE["medallion_stages"] = with_(*MODELS, *PASSAGES, "held AS (SELECT * FROM series WHERE pos > 60 AND n_rows >= 30)") + """
  SELECT 'bronze' AS stage, (SELECT count(*) FROM bronze) AS rows UNION ALL SELECT 'silver', (SELECT count(*) FROM silver)
  UNION ALL SELECT 'gold', (SELECT count(*) FROM silver) UNION ALL SELECT 'models', (SELECT count(*) FROM models)
  UNION ALL SELECT 'backtest', (SELECT count(*) FROM held) UNION ALL SELECT 'best_runs', (SELECT count(*) FROM models)
  UNION ALL SELECT 'chunks', (SELECT count(*) FROM passages) UNION ALL SELECT 'vectors', (SELECT count(*) FROM passages)"""

# Hashed term vectors: 32-bit murmur3 of each distinct token, written out over its bytes.
M32 = "4294967296::HUGEINT"


def times(x: str, c: int) -> str:
    return f"CAST((CAST({x} AS HUGEINT) * {c}) % {M32} AS BIGINT)"


def turned(x: str, by: int) -> str:
    return f"((({x}) << {by}) & 4294967295 | (({x}) >> {32 - by}))"


def stirred(k: str) -> str:
    return times(turned(times(k, 0xCC9E2D51), 15), 0x1B873593)


def hashed_terms(source: str, key: str, size: int) -> list[str]:
    """Tokens of the texts of a relation and the vector cell of each distinct token."""
    return [
        f"tokens AS (SELECT {key} AS doc_id, unnest({words('lower(text)')}) AS tok FROM {source})",
        "terms AS (SELECT tok, hex(encode(tok)) AS h, octet_length(encode(tok)) AS n FROM (SELECT DISTINCT tok FROM tokens))",
        """bytes AS (SELECT tok, n, list_transform(range(0, n), lambda i:
   CAST((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)) AS b FROM terms)""",
        """blocks4 AS (SELECT tok, n, b, list_transform(range(0, n // 4), lambda i:
   b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) AS ks,
   CAST(list_sum(list_transform(range((n // 4) * 4, n), lambda i: b[i + 1] << (8 * CAST(i % 4 AS INT)))) AS BIGINT) AS tail FROM bytes)""",
        f"""mixed AS (SELECT tok, n, tail, list_reduce(list_prepend(42::BIGINT, list_transform(ks, lambda k: {stirred('k')})),
   lambda h, k: CAST((CAST({turned('xor(h, k)', 13)} AS HUGEINT) * 5 + 3864292196) % {M32} AS BIGINT)) AS h FROM blocks4)""",
        f"ended AS (SELECT tok, xor(CASE WHEN tail IS NULL THEN h ELSE xor(h, {stirred('tail')}) END, CAST(n AS BIGINT)) AS h FROM mixed)",
        f"f1 AS (SELECT tok, {times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM ended)",
        f"f2 AS (SELECT tok, {times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM f1)",
        f"hashed AS (SELECT tok, xor(h, h >> 16) % {size} AS dim FROM f2)",
        "tf AS (SELECT doc_id, dim, count(*) AS n FROM tokens JOIN hashed USING (tok) GROUP BY doc_id, dim)",
    ]


def unit_cells(fitted_on: str, total: str) -> list[str]:
    """Cells of the unit vectors of all texts; document frequencies come from some of them."""
    return [
        f"""idf AS (SELECT dim, ln(({total} + 1.0::DOUBLE) / (count(*) FILTER ({fitted_on}) + 1.0::DOUBLE)) AS w
   FROM tf GROUP BY dim)""",
        "weighted AS (SELECT doc_id, dim, n * w AS v FROM tf JOIN idf USING (dim))",
        "lengths AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM weighted GROUP BY doc_id)",
        """cells AS (SELECT doc_id, dim, CAST(CAST(v / norm AS FLOAT) AS DOUBLE) AS weight
   FROM weighted JOIN lengths USING (doc_id) WHERE v <> 0)""",
    ]


ORACLE["text_embeddings"] = with_(
    *hashed_terms("documents", "doc_id", 64), *unit_cells("true", "(SELECT count(*) FROM documents)")
) + "SELECT doc_id, CAST(dim AS INT) AS dim, round(weight, 4) AS weight FROM cells"

ORACLE["plugged_embeddings"] = with_(
    """words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents)""",
    """counts AS (SELECT doc_id, strpos('0123456789abcdef', left(md5(w), 1)) - 1 AS dim, count(*) AS n FROM words GROUP BY 1, 2)""",
) + """SELECT doc_id, CAST(dim AS INT) AS dim, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 4) AS weight
  FROM counts"""

SEARCHED = [
    # passages have ids from 0 up, the questions ids from -1 down
    """texts AS (SELECT CAST(substr(id, 7) AS BIGINT) AS id, id AS chunk_id, crop, source_doc, page, text FROM passages
   UNION ALL SELECT -row_number() OVER (ORDER BY crop), NULL, crop, NULL, NULL, crop || ' storage harvest price'
   FROM (SELECT DISTINCT crop FROM silver))""",
    *hashed_terms("texts", "id", 256),
    *unit_cells("doc_id >= 0", "(SELECT count(*) FROM passages)"),
    """scored AS (SELECT q.doc_id AS query_id, p.doc_id AS id, round(sum(q.weight * p.weight), 6) AS score
   FROM cells q JOIN cells p ON q.dim = p.dim AND q.doc_id < 0 AND p.doc_id >= 0 GROUP BY 1, 2)""",
]
ORACLE["stored_search"] = with_(*PRICES, *PASSAGES, *SEARCHED,
    """found AS (SELECT q.crop AS asked, p.*, coalesce(score, 0) AS score,
     row_number() OVER (PARTITION BY q.id ORDER BY coalesce(score, 0) DESC, p.id) AS rank
   FROM texts q JOIN texts p ON q.id < 0 AND p.id >= 0 AND lower(p.crop) = lower(q.crop)
   LEFT JOIN scored s ON s.query_id = q.id AND s.id = p.id)""",
) + """SELECT asked, CAST(rank AS INT) AS rank, chunk_id, id, source_doc, page, round(score, 4) + 0.0::DOUBLE AS score, text
  FROM found WHERE rank <= 3"""
ORACLE["chunk_numbers"] = with_(
    """docs AS (SELECT row_number() OVER (ORDER BY CASE WHEN doc_id % 7 > 0 THEN 'doc-' || (doc_id % 97) END NULLS LAST,
     CASE lang WHEN 'en' THEN 'Onion' WHEN 'de' THEN 'Tomato' WHEN 'fr' THEN 'Standard'
     WHEN 'es' THEN 'Promo' ELSE upper(left(lang, 1)) || lower(substr(lang, 2)) END NULLS LAST, source NULLS LAST, md5(text) NULLS LAST) AS place,
   CASE WHEN doc_id % 7 > 0 THEN 'doc-' || (doc_id % 97) END AS doc_id, string_split(text, chr(10)) AS pages FROM documents)""",
    f"""pages_ AS (SELECT place, doc_id, page, {words('body')} AS ws FROM (
   SELECT place, doc_id, unnest(pages) AS body, generate_subscripts(pages, 1) AS page FROM docs))""",
    """cut AS (SELECT place, doc_id, page, s, array_to_string(ws[s + 1 : s + 80], ' ') AS text FROM (
   SELECT *, unnest(range(0, len(ws), 60)) AS s FROM pages_))""",
) + """SELECT n AS number, 'chunk_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS chunk_id,
  doc_id, CAST(page AS INT) AS page, md5(text) AS digest FROM (SELECT *, row_number() OVER (ORDER BY place, page, s) - 1 AS n FROM cut)"""
ORACLE["medallion_resumed"] = with_(*MODELS, fitted(60, "_60"), metrics(60, "_60"), *DETAIL) + """SELECT crop, mandi,
  CAST((2 * s + n) // (2 * n) AS DOUBLE) / 100.0::DOUBLE AS mape, selected_mape,
  'bronze silver gold models' AS kept, 8 AS entries FROM (SELECT crop, mandi, count(*) AS n,
  sum(CAST(floor(abs(error_pct) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS s FROM detail GROUP BY 1, 2)
  JOIN (SELECT crop, mandi, mape AS selected_mape FROM metrics_60) USING (crop, mandi)"""

BOARD_TERMS = ["the", "₹", "quintal", "und", "que"]


def restored(c: str, terms) -> str:
    for i, t in enumerate(terms):
        c = f"replace({c}, '__TERM{i}__', '{t}')"
    return c


def routed(c: str, name: str) -> str:
    """A text as the translator gets it, its placeholders, and as it comes back; Tamil fails, English passes."""
    masked_c = masked(c, BOARD_TERMS)
    return f"""CASE WHEN language = 'English' THEN {c} ELSE {masked_c} END AS {name}_sources,
  CASE WHEN language <> 'English' THEN {placeholders(c, BOARD_TERMS)} END AS {name}_placeholders,
  CASE WHEN language = 'Hindi' THEN 'hi-IN: ' || {restored(f"replace({masked_c}, 'price', 'Preis')", BOARD_TERMS)} ELSE {c} END AS {name}_texts"""


ORACLE["advisory_board_scored"] = with_(
    *LATEST_ADVISED,
    *PASSAGES,
    *SEARCHED,
    # passages that share no cell with the question score 0 and come last
    """near AS (SELECT q.id AS query_id, q.crop AS wanted, p.* EXCLUDE (id), p.id, coalesce(score, 0) AS score
   FROM texts q JOIN texts p ON q.id < 0 AND p.id >= 0 LEFT JOIN scored s ON s.query_id = q.id AND s.id = p.id
   QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY coalesce(score, 0) DESC, p.id) <= 6)""",
    """best AS (SELECT *, 'Source: ' || source_doc || ' | Page ' || page AS advisory_source FROM near WHERE crop = wanted
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1)""",
    SERIES_ROWS, fitted(1_000_000_000, "_all"), ahead("days", "10", "_all"), predict("p", "days", "_all"),
    "tail AS (SELECT crop, mandi, date, modal_price FROM silver QUALIFY row_number() OVER (PARTITION BY crop, mandi ORDER BY date DESC) <= 10)",
    """points AS (SELECT crop, mandi, date AS day, 'actual' AS kind, modal_price AS price FROM tail
   UNION ALL SELECT crop, mandi, ds, 'forecast', yhat FROM p
   UNION ALL SELECT crop, mandi, ds, 'connector', yhat FROM p WHERE pos = 1
   UNION ALL SELECT crop, mandi, max(date), 'connector', arg_max(modal_price, date) FROM tail GROUP BY crop, mandi)""",
    """view_ AS (SELECT crop, mandi, string_agg(CAST(day AS VARCHAR) || ' ' || kind || ' ' || CAST(round(price) AS BIGINT), '; '
   ORDER BY day, kind, price) AS outlook FROM points GROUP BY crop, mandi)""",
    "languages(language) AS (VALUES ('English'), ('Hindi'), ('Tamil'))",
) + f"""SELECT a.crop, a.mandi, language, decision, signal || ' — ' || {one('rain_3d_mm')} || ' mm' AS weather, advisory_source,
  {routed("recommendation", "advice")}, {routed("b.text", "passage")},
  CAST(language = 'Hindi' AND b.text IS NOT NULL AS INT) AS passage_translated, outlook
  FROM answered a LEFT JOIN best b ON b.wanted = a.crop LEFT JOIN view_ v ON v.crop = a.crop AND v.mandi = a.mandi, languages"""
ORACLE["evolving_stream"] = with_(BRONZE) + """SELECT date, crop, mandi, modal_price, min_price, max_price, arrivals_tonnes,
  CASE WHEN date >= '1995-01-01' THEN state END AS state FROM bronze"""
