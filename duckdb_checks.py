"""The registered queries once more, as SQL for DuckDB over the same tables.

Written from the definitions, not from the Spark plans: rolling means use window frames where
Spark uses running sums, ranks use one window, ranges use plain joins.
"""

from __future__ import annotations

BARS = """
px AS (
  SELECT CAST(l_suppkey AS BIGINT) AS tk, CAST(l_shipdate AS DATE) AS date,
         CAST(100 AS DOUBLE) + CAST(100 AS DOUBLE) * l_discount + CAST(10 AS DOUBLE) * l_tax AS p,
         l_quantity AS q, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k
  FROM lineitem),
raw AS (
  SELECT tk, date, min_by(p, k) AS o, max(p) AS h, min(p) AS l, max_by(p, k) AS c,
         CAST(sum(q) AS BIGINT) AS v
  FROM px GROUP BY tk, date),
numbered AS (SELECT raw.*, row_number() OVER (PARTITION BY tk ORDER BY date DESC) AS back FROM raw),
bars AS MATERIALIZED (
  SELECT concat('T', CAST(tk AS VARCHAR)) AS ticker, date,
         CASE WHEN tk % 10 = 9 AND back <= 5 THEN CAST(105 AS DOUBLE) ELSE o END AS open,
         CASE WHEN tk % 10 = 9 AND back <= 5 THEN CAST(105 AS DOUBLE) ELSE h END AS high,
         CASE WHEN tk % 10 = 9 AND back <= 5 THEN CAST(105 AS DOUBLE) ELSE l END AS low,
         CASE WHEN tk % 10 = 9 AND back <= 5 THEN CAST(105 AS DOUBLE) ELSE c END AS close,
         CASE WHEN tk % 10 = 7 AND back <= 3 THEN CAST(0 AS BIGINT)
              WHEN tk % 10 = 3 AND back = 1 THEN v * 12 ELSE v END AS volume,
         tk, back
  FROM numbered),
caps AS (
  SELECT concat('T', CAST(s_suppkey AS VARCHAR)) AS ticker, s_acctbal / 10 AS paid_up_capital
  FROM supplier)"""

POSITIONS = """
positions AS MATERIALIZED (
  SELECT ticker, close * (CAST(0.80 AS DOUBLE) + CAST(0.06 AS DOUBLE) * (tk % 5)) AS buy_price,
         tk + 100 AS quantity,
         close * (CAST(0.80 AS DOUBLE) + CAST(0.06 AS DOUBLE) * (tk % 5)) AS highest_seen,
         date AS purchase_date, concat('lot ', ticker) AS notes
  FROM bars WHERE back = 30)"""


def _exact(x: str) -> str:
    """A double by its shortest text as a decimal, so that sums are exact."""
    return f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18))"


def _mean(total: str, n: str) -> str:
    """Exact total over n, rounded half up to 18 places, then to the nearest double."""
    one = "1000000000000000000"
    q = f"((2 * abs(CAST(replace(CAST({total} AS VARCHAR), '.', '') AS HUGEINT)) + {n}) // (2 * {n}))"
    return (
        f"CAST(CASE WHEN {total} IS NOT NULL THEN concat(CASE WHEN {total} < 0 THEN '-' ELSE '' END, CAST({q} // {one} AS VARCHAR), '.', "
        f"lpad(CAST({q} % {one} AS VARCHAR), 18, '0')) END AS DOUBLE)"
    )


def _total(x: str) -> str:
    return f"CAST(CAST(sum({_exact(x)}) AS VARCHAR) AS DOUBLE)"


def _round2(x: str) -> str:
    return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


def _indicators(bars: str = "bars", name: str = "ind") -> str:
    return f"""
{name}_w AS (
  SELECT ticker, date, open, high, low, close, volume,
         row_number() OVER w AS bar_no,
         row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS from_end,
         sum({_exact('close')}) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS close_sum,
         count(close) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS close_n,
         CAST(sum(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS DOUBLE)
           / count(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS avg_volume_20,
         close / lag(close) OVER w - 1 AS price_change,
         (high - low) / low * 100 AS daily_range,
         max(volume) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v3,
         stddev_samp(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s5,
         max(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5max,
         min(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5min
  FROM {bars} WINDOW w AS (PARTITION BY ticker ORDER BY date)),
{name} AS (
  SELECT *, {_mean('close_sum', 'close_n')} AS sma_200,
         CASE WHEN avg_volume_20 = 0 THEN CAST(0 AS DOUBLE)
                 ELSE CAST(volume AS DOUBLE) / avg_volume_20 END AS rvol,
         price_change * 100 AS price_change_pct,
         bar_no < 200 AS short_history,
         bar_no >= 3 AND v3 = 0 AS ghost,
         bar_no >= 5 AND s5 < 0.01 AS stuck,
         bar_no >= 5 AND c5max = c5min AND volume = 0 AS flat_idle
  FROM {name}_w)"""


def _scored(ind: str = "ind", name: str = "scored") -> str:
    return f"""
{name}_p AS (
  SELECT i.*, c.paid_up_capital,
         CASE WHEN ghost THEN 'Ghost Town - Zero volume for 3 days'
              WHEN stuck THEN 'Price stuck at floor/ceiling'
              WHEN volume < 10 THEN concat('Low volume: ', CAST(volume AS VARCHAR))
              ELSE 'All filters passed' END AS message,
         rvol > 2.5 AS loud,
         coalesce(rvol > 2.5 AND abs(price_change) < CAST(0.02 AS DOUBLE), false) AS quiet,
         coalesce(c.paid_up_capital < 50, false) AS light,
         close > sma_200 AS above
  FROM {ind} i LEFT JOIN caps c ON c.ticker = i.ticker),
{name}_s AS (
  SELECT *, CASE WHEN message = 'All filters passed' THEN 'success' ELSE 'filtered' END AS status,
         CAST((CASE WHEN loud THEN 50 ELSE 0 END) + (CASE WHEN quiet THEN 20 ELSE 0 END)
           + (CASE WHEN light THEN 20 ELSE 0 END) + (CASE WHEN above THEN 10 ELSE -50 END)
           AS INTEGER) AS score,
         concat_ws(' | ',
           CASE WHEN loud THEN format('High RVOL ({{:.1f}}x)', rvol) END,
           CASE WHEN quiet THEN format('Quiet Accumulation (RVOL {{:.1f}}x, Price Change {{:.2f}}%)',
                                       rvol, price_change_pct) END,
           CASE WHEN light THEN format('Low Float ({{:.1f}} Cr)', paid_up_capital) END,
           CASE WHEN above THEN 'Above 200 SMA' ELSE 'Below 200 SMA' END) AS reasons
  FROM {name}_p),
{name} AS (
  SELECT *, CASE WHEN score >= 80 THEN 'BUY' WHEN score >= 45 THEN 'WAIT' ELSE 'IGNORE' END AS signal
  FROM {name}_s)"""


SIGNALS = f"""
signals AS (
  SELECT ticker, status, CAST(date AS VARCHAR) AS date, {_round2('close')} AS close, volume,
         {_round2('rvol')} AS rvol, CAST(trunc(avg_volume_20) AS BIGINT) AS avg_volume_20,
         coalesce({_round2('price_change_pct')}, CAST(0 AS DOUBLE)) AS price_change_pct,
         {_round2('sma_200')} AS sma_200, paid_up_capital, score, signal, reasons,
         open, high, low
  FROM scored WHERE from_end = 1 AND status = 'success')"""

_CSV = """
t AS (
  SELECT CAST(l_suppkey AS BIGINT) AS tk, CAST(l_shipdate AS DATE) AS date, l_quantity AS q,
         CAST(100 AS DOUBLE) + l_discount * CAST(100 AS DOUBLE) AS p,
         row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem),
u AS (SELECT *, row_number() OVER (PARTITION BY tk, date ORDER BY k DESC) AS n
      FROM t WHERE tk % 11 <> 0 AND q <> 13),
files AS (
  SELECT concat('T', CAST(tk AS VARCHAR)) AS ticker,
         CASE WHEN tk % 11 = 0 OR count(*) FILTER (q <> 13) = 0 THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN tk % 11 = 0 THEN 0 ELSE count(*) FILTER (q <> 13) END AS rows,
         CASE WHEN tk % 11 = 0 THEN 0 ELSE count(*) FILTER (q = 13) END AS bad_dates
  FROM t GROUP BY tk)"""

SIGNAL_COLUMNS = (
    "ticker, status, date, close, volume, rvol, avg_volume_20, price_change_pct, sma_200, "
    "paid_up_capital, score, signal, reasons"
)

_OLD = "old AS (SELECT * FROM bars WHERE date <= DATE '2000-01-10')"
_INC = """inc AS (SELECT ticker, date, open, high, low, close + CAST(1 AS DOUBLE) AS close, volume
  FROM bars WHERE date >= DATE '2000-01-01')"""

_ADJUSTED = """
ev AS (
  SELECT ticker, max(CASE WHEN back = 300 THEN date END) AS ex300,
         max(CASE WHEN back = 100 THEN date END) AS ex100
  FROM bars WHERE tk % 4 = 0 GROUP BY ticker),
factors AS (
  SELECT b.*, CASE WHEN b.date < e.ex300
                   THEN CAST(1 AS DOUBLE) / CAST(1.1 AS DOUBLE) / CAST(1.2 AS DOUBLE)
                   WHEN b.date < e.ex100 THEN CAST(1 AS DOUBLE) / CAST(1.2 AS DOUBLE)
                   ELSE CAST(1 AS DOUBLE) END AS fac
  FROM bars b LEFT JOIN ev e ON e.ticker = b.ticker),
adjusted AS (
  SELECT ticker, date, open * fac AS open, high * fac AS high, low * fac AS low,
         close * fac AS close, volume FROM factors)"""

STATE = """
mkt AS MATERIALIZED (
  SELECT b.ticker, max(b.date) AS date,
         max(CASE WHEN back = 1 THEN open END) AS current_open,
         max(CASE WHEN back = 1 THEN close END) AS current_price,
         max(CASE WHEN back = 1 THEN volume END) AS current_volume,
         count(CASE WHEN back <= 20 THEN 1 END) AS n20,
         avg(CASE WHEN back <= 20 THEN volume END) AS mean20,
         max(CASE WHEN b.date >= p.purchase_date THEN close END) AS peak
  FROM bars b JOIN positions p ON p.ticker = b.ticker GROUP BY b.ticker),
state AS (
  SELECT p.ticker, p.buy_price, p.quantity, p.purchase_date, p.notes,
         greatest(p.highest_seen, m.peak) AS highest_seen,
         greatest(p.highest_seen, m.current_price) AS highest_run,
         m.date, m.current_open, m.current_price,
         CASE WHEN n20 >= 20 AND mean20 > 0 THEN current_volume / mean20 ELSE CAST(0 AS DOUBLE) END AS rvol
  FROM positions p JOIN mkt m ON m.ticker = p.ticker),
decided_s AS (
  SELECT *, buy_price * CAST(0.93 AS DOUBLE) AS stop_loss_price,
         highest_seen * CAST(0.95 AS DOUBLE) AS trailing_stop_price,
         (current_price - buy_price) / buy_price * 100 AS profit_pct,
         (current_price - buy_price) * quantity AS profit_amount
  FROM state),
decided_t AS (
  SELECT *, CASE WHEN current_price <= stop_loss_price THEN 'STOP_LOSS'
                 WHEN current_price <= trailing_stop_price THEN 'TAKE_PROFIT'
                 WHEN profit_pct > 20 AND rvol > 1.5
                      AND (current_price < current_open
                           OR (current_open > 0 AND abs(current_price - current_open) / current_open
                               < CAST(0.01 AS DOUBLE))) THEN 'CLIMAX' END AS signal_type
  FROM decided_s),
decided AS (
  SELECT ticker,
         CASE signal_type WHEN 'STOP_LOSS' THEN 'SELL NOW ❌' WHEN 'TAKE_PROFIT' THEN 'SELL NOW 💰'
              WHEN 'CLIMAX' THEN 'SELL HALF ⚠️' ELSE 'HOLD ✅' END AS action,
         signal_type,
         CASE signal_type WHEN 'STOP_LOSS' THEN 'CRITICAL' WHEN 'TAKE_PROFIT' THEN 'HIGH'
              WHEN 'CLIMAX' THEN 'HIGH' ELSE 'LOW' END AS urgency,
         CASE signal_type WHEN 'STOP_LOSS' THEN 'EMERGENCY BRAKE: Hit -7% stop loss limit'
              WHEN 'TAKE_PROFIT' THEN
                format('TRAILING STOP: Dropped 5% from peak of {:.2f}. Trend broken.', highest_seen)
              WHEN 'CLIMAX' THEN
                format('CLIMAX DETECTED: RVOL {:.1f}x with red/doji candle. Possible dump.', rvol)
              ELSE '' END AS reason,
         buy_price, current_price, highest_seen, profit_pct, profit_amount, quantity, rvol,
         stop_loss_price, trailing_stop_price
  FROM decided_t)"""

PATHS = """
entries AS (
  SELECT ticker, bar_no AS entry_no, date AS entry_date, close AS entry_price
  FROM scored WHERE signal = 'BUY' AND status = 'success' AND close IS NOT NULL),
path0 AS (
  SELECT e.*, b.bar_no, b.date, b.close,
         greatest(e.entry_price, max(b.close) OVER (PARTITION BY e.ticker, e.entry_no ORDER BY b.bar_no)) AS peak
  FROM entries e LEFT JOIN ind b
    ON b.ticker = e.ticker AND b.bar_no > e.entry_no AND b.bar_no <= e.entry_no + 60),
path1 AS (
  SELECT *, CASE WHEN close <= entry_price * CAST(0.93 AS DOUBLE) THEN 'STOP_LOSS'
                 WHEN close <= peak * CAST(0.95 AS DOUBLE) THEN 'TAKE_PROFIT' END AS rule
  FROM path0),
firsts AS (
  SELECT ticker, entry_no, min(CASE WHEN rule IS NOT NULL THEN bar_no END) AS hit_no,
         max(bar_no) AS last_no FROM path1 GROUP BY ticker, entry_no),
trades AS (
  SELECT e.ticker, e.entry_no, e.entry_date, e.entry_price,
         coalesce(f.hit_no, CASE WHEN f.last_no >= e.entry_no + 60 THEN f.last_no END) AS exit_no,
         f.hit_no, f.last_no
  FROM entries e JOIN firsts f ON f.ticker = e.ticker AND f.entry_no = e.entry_no),
backtest AS (
  SELECT t.ticker, t.entry_no, CAST(t.entry_date AS VARCHAR) AS entry_date, t.entry_price,
         CAST(x.date AS VARCHAR) AS exit_date, x.close AS exit_price,
         CASE WHEN t.hit_no IS NOT NULL THEN x.rule WHEN t.exit_no IS NOT NULL THEN 'TIMEOUT'
              ELSE 'OPEN' END AS exit_reason,
         t.exit_no - t.entry_no AS bars_held,
         (x.close - t.entry_price) / t.entry_price * 100 AS return_pct
  FROM trades t LEFT JOIN path1 x
    ON x.ticker = t.ticker AND x.entry_no = t.entry_no AND x.bar_no = t.exit_no)"""


def _q(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def oracle_sql() -> dict[str, str]:
    ind, scored = _indicators(), _scored()
    ohlcv = "open, high, low, close, volume"
    day = "CAST(date AS VARCHAR) AS date"
    held = "ticker, buy_price, quantity, highest_seen, CAST(purchase_date AS VARCHAR) AS purchase_date, notes"
    summary_cte = f"""s AS (
              SELECT count(*) AS total_positions,
                {_total('p.buy_price * CAST(p.quantity AS DOUBLE)')} AS total_invested,
                {_total('b.close * CAST(p.quantity AS DOUBLE)')} AS current_value
              FROM positions p JOIN bars b ON b.ticker = p.ticker AND b.back = 1)"""
    summary = """SELECT *, current_value - total_invested AS total_profit,
                (current_value - total_invested) / total_invested * 100 AS profit_pct FROM s"""
    ind_cols = (
        f"ticker, {day}, close, volume, bar_no, sma_200, avg_volume_20, rvol, price_change, "
        "price_change_pct, daily_range, short_history"
    )
    out = {
        "bars_range": _q(BARS, select=f"""SELECT ticker, {day}, {ohlcv} FROM bars
            WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"""),
        "tickers": _q(BARS, select="SELECT DISTINCT ticker FROM bars"),
        "ticker_preview": _q(BARS, "names AS (SELECT DISTINCT ticker FROM bars)", select="""
            SELECT (SELECT string_agg(ticker, ' | ' ORDER BY ticker)
                    FROM (SELECT ticker FROM names ORDER BY ticker LIMIT 50)) AS first,
                   greatest((SELECT count(*) FROM names) - 50, 0) AS more"""),
        "latest_date": _q(BARS, select="""SELECT ticker, CAST(max(date) AS VARCHAR) AS latest_date
            FROM bars GROUP BY ticker"""),
        "bar_stats": _q(BARS, select="""SELECT count(DISTINCT ticker) AS total_tickers,
            count(*) AS total_records,
            concat(CAST(min(date) AS VARCHAR), ' to ', CAST(max(date) AS VARCHAR)) AS date_range
            FROM bars"""),
        "last_20_bars": _q(BARS, select=f"SELECT ticker, {day}, {ohlcv}, back FROM bars WHERE back <= 20"),
        "latest_close": _q(BARS, select=f"SELECT ticker, close, {day} FROM bars WHERE back = 1"),
        "as_of_status": _q(
            BARS, "seen AS (SELECT * FROM bars WHERE date <= DATE '2000-06-15')",
            _indicators("seen"), scored,
            f"""hit AS (SELECT ticker, status, message, {day}, {_round2('close')} AS close, score, signal
                FROM scored WHERE from_end = 1 AND date = DATE '2000-06-15')""",
            select="""SELECT n.ticker, coalesce(h.status, 'error') AS status,
                coalesce(h.message, 'No data for date 2000-06-15') AS message,
                h.date, h.close, h.score, h.signal
                FROM (SELECT DISTINCT ticker FROM bars) n LEFT JOIN hit h ON h.ticker = n.ticker"""),
        "indicators": _q(BARS, ind, select=f"SELECT {ind_cols} FROM ind"),
        "indicators_segmented": _q(BARS, ind, select=f"SELECT {ind_cols} FROM ind"),
        "indicators_continued": _q(BARS, ind, select=f"SELECT {ind_cols} FROM ind"),
        "indicators_refreshed": _q(BARS, ind, select=f"SELECT {ind_cols} FROM ind"),
        "ghost_flag": _q(BARS, ind, select=f"SELECT ticker, {day}, ghost FROM ind WHERE from_end = 1"),
        "stuck_flag": _q(BARS, ind, select=f"""SELECT ticker, {day}, stuck, flat_idle FROM ind
            WHERE from_end = 1"""),
        "screen": _q(BARS, ind, scored, select=f"""SELECT ticker, {day}, volume, status, message
            FROM scored WHERE from_end = 1"""),
        "penny_trap": _q(BARS, ind, scored, select=f"""SELECT ticker, {day}, close, price_change_pct,
            paid_up_capital FROM scored WHERE from_end = 1
            AND NOT coalesce(paid_up_capital > 500 AND abs(price_change_pct) < 0.5, false)"""),
        "idle_floor": _q(BARS, """idle AS (SELECT * REPLACE (
              CASE WHEN open = 105 AND close = 105 AND ticker LIKE '%9' THEN CAST(0 AS BIGINT)
                   ELSE volume END AS volume) FROM bars)""", _indicators("idle"), select=f"""SELECT ticker, {day}, close, volume FROM ind
            WHERE from_end = 1 AND NOT flat_idle"""),
        "category_screen": _q(BARS, select=f"""SELECT ticker, close, {day} FROM bars WHERE back = 1
            AND ticker NOT IN (SELECT ticker FROM caps WHERE paid_up_capital < 0)"""),
        "score_latest": _q(BARS, ind, scored, SIGNALS, select=f"SELECT {SIGNAL_COLUMNS} FROM signals"),
        "score_history": _q(BARS, ind, scored, select=f"""SELECT ticker, {day}, close, rvol, sma_200,
            status, message, score, signal, reasons FROM scored"""),
        "signal_counts": _q(BARS, ind, scored, SIGNALS, select="""SELECT count(*) AS total,
            count(*) FILTER (signal = 'BUY') AS buy, count(*) FILTER (signal = 'WAIT') AS wait,
            count(*) FILTER (signal = 'IGNORE') AS ignore FROM signals"""),
        "top_buy": _q(BARS, ind, scored, SIGNALS, select=f"""SELECT {SIGNAL_COLUMNS},
            (close - sma_200) / sma_200 * 100 AS sma_diff FROM signals WHERE signal = 'BUY'
            ORDER BY score DESC, ticker LIMIT 20"""),
        "top_wait": _q(BARS, ind, scored, SIGNALS, select=f"""SELECT {SIGNAL_COLUMNS} FROM signals
            WHERE signal = 'WAIT' ORDER BY score DESC, ticker LIMIT 10"""),
        "signal_report": _q(BARS, ind, scored, SIGNALS, select="""SELECT
            row_number() OVER (ORDER BY score DESC, ticker) AS rank, ticker, signal, score,
            CASE WHEN score >= 80 THEN 'score-high' WHEN score >= 45 THEN 'score-medium'
                 ELSE 'score-low' END AS band,
            format('{:.2f}', close) AS close, format('{:.2f}', open) AS open,
            format('{:.2f}', high) AS high, format('{:.2f}', low) AS low,
            format('{:.2f}x', rvol) AS rvol, format('{:,}', volume) AS volume,
            format('{:,}', avg_volume_20) AS avg_volume_20,
            format('{:.2f}%', price_change_pct) AS change,
            CASE WHEN sma_200 <> 0 THEN format('{:.2f}', sma_200) ELSE 'N/A' END AS sma_200,
            CASE WHEN paid_up_capital <> 0 THEN format('{:.1f} Cr', paid_up_capital) ELSE 'N/A' END
              AS paid_up_capital,
            replace(reasons, ' | ', ', ') AS reasons,
            CASE signal WHEN 'BUY' THEN 'BUY' WHEN 'WAIT' THEN 'WATCH' ELSE 'SKIP' END AS action
            FROM signals"""),
        "signal_csv": _q(BARS, ind, scored, SIGNALS, select=f"SELECT {SIGNAL_COLUMNS} FROM signals"),
        "clean_rows": _q("""t AS (
              SELECT concat('T', CAST(l_suppkey AS VARCHAR)) AS ticker,
                CASE WHEN l_quantity = 13 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
                CASE WHEN l_quantity IN (17, 18) THEN NULL ELSE p END AS open,
                CASE WHEN l_quantity = 17 THEN NULL ELSE p END AS high,
                CASE WHEN l_quantity = 17 THEN NULL ELSE p END AS low,
                CASE WHEN l_quantity = 17 THEN NULL ELSE p END AS close,
                CASE WHEN l_quantity = 19 THEN 0 ELSE CAST(trunc(l_quantity) AS BIGINT) END AS volume,
                row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k
              FROM (SELECT *, CAST(100 AS DOUBLE) + l_discount * CAST(100 AS DOUBLE) AS p FROM lineitem))""",
            "u AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY k DESC) AS n FROM t"
            " WHERE date IS NOT NULL AND coalesce(open, high, low, close) IS NOT NULL)",
            select=f"""SELECT ticker, {day}, {ohlcv}, 'stocksurferbd' AS source,
                CAST(1 AS BIGINT) AS ingest_seq FROM u WHERE n = 1"""),
        "upsert": _q(BARS, _OLD, _INC, select=f"""
            SELECT ticker, {day}, {ohlcv} FROM old o
            WHERE NOT EXISTS (SELECT 1 FROM inc n WHERE n.ticker = o.ticker AND n.date = o.date)
            UNION ALL SELECT ticker, {day}, {ohlcv} FROM inc"""),
        "stream_ingest": _q(BARS, _OLD, _INC, select=f"""
            SELECT ticker, {day}, {ohlcv} FROM old o
            WHERE NOT EXISTS (SELECT 1 FROM inc n WHERE n.ticker = o.ticker AND n.date = o.date)
            UNION ALL SELECT ticker, {day}, {ohlcv} FROM inc"""),
        "full_refresh": _q(BARS, _OLD, _INC, select=f"""
            SELECT ticker, {day}, {ohlcv} FROM old o
            WHERE NOT EXISTS (SELECT 1 FROM inc n WHERE n.ticker = o.ticker AND n.date = o.date)
            UNION ALL SELECT ticker, {day}, {ohlcv} FROM inc WHERE ticker IN (SELECT ticker FROM old)"""),
        "csv_uniform": _q(BARS, select=f"""SELECT ticker, {day}, floor(open * 100) AS open, floor(high * 100) AS high,
            floor(low * 100) AS low, floor(close * 100) AS close, volume, 'adjusted_data' AS source,
            CAST(5 AS BIGINT) AS ingest_seq FROM bars"""),
        "fundamentals_file": _q(BARS, select="SELECT ticker, floor(paid_up_capital * 100) AS paid_up_capital FROM caps"),
        "disk_table": _q(BARS, _OLD, _INC, select=f"""
            SELECT ticker, {day}, {ohlcv} FROM old o
            WHERE NOT EXISTS (SELECT 1 FROM inc n WHERE n.ticker = o.ticker AND n.date = o.date)
            UNION ALL SELECT ticker, {day}, {ohlcv} FROM inc"""),
        "disk_years": _q(BARS, _INC, select=f"""
            SELECT ticker, {day}, {ohlcv} FROM bars WHERE year(date) = 1999
            UNION ALL SELECT ticker, {day}, {ohlcv} FROM inc WHERE year(date) = 2000"""),
        "disk_newest": _q(BARS, _OLD, _INC, """now AS (
              SELECT ticker, date, open, high, low, close, volume FROM old o
              WHERE NOT EXISTS (SELECT 1 FROM inc n WHERE n.ticker = o.ticker AND n.date = o.date)
              UNION ALL SELECT * FROM inc)""",
            "ends AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM now)",
            select=f"SELECT ticker, {day}, {ohlcv}, back FROM ends WHERE back <= 20"),
        "load_meta": _q(BARS, _OLD, _INC,
            "a AS (SELECT ticker, count(*) AS c FROM old GROUP BY ticker)",
            "b AS (SELECT ticker, count(*) AS c FROM inc GROUP BY ticker)",
            select="""SELECT coalesce(b.ticker, a.ticker) AS ticker,
                CASE WHEN b.ticker IS NOT NULL THEN 'bdshare' ELSE 'adjusted_data' END AS data_source,
                coalesce(b.c, a.c) AS record_count
                FROM a FULL JOIN b ON a.ticker = b.ticker"""),
        "reload": _q(BARS, _OLD, _INC, select=f"""
            SELECT ticker, {day}, {ohlcv} FROM bars WHERE ticker <> 'T1'
            UNION ALL SELECT ticker, {day}, {ohlcv} FROM inc WHERE ticker = 'T1'"""),
        "delete_tickers": _q(BARS, select=f"""SELECT ticker, {day}, {ohlcv} FROM bars
            WHERE ticker NOT IN (SELECT ticker FROM caps WHERE paid_up_capital < 0)"""),
        "increment_range": _q(BARS, _INC, select=f"""SELECT ticker, {day}, {ohlcv} FROM inc
            WHERE date BETWEEN DATE '2000-01-10' AND DATE '2001-06-30'"""),
        "high_water": _q(BARS, """marked AS (
              SELECT b.*, max(CASE WHEN date <= DATE '2000-01-10' AND c.paid_up_capital >= 0 THEN date END)
                OVER (PARTITION BY b.ticker) AS mark
              FROM bars b LEFT JOIN caps c ON c.ticker = b.ticker)""",
            select=f"""SELECT ticker, {day}, {ohlcv} FROM marked WHERE date <= DATE '2001-06-30'
                AND date > coalesce(mark, DATE '1998-12-31')"""),
        "newest_marks": _q(BARS, """marked AS (
              SELECT b.*, max(CASE WHEN date <= DATE '2000-01-10' AND c.paid_up_capital >= 0 THEN date END)
                OVER (PARTITION BY b.ticker) AS mark
              FROM bars b LEFT JOIN caps c ON c.ticker = b.ticker)""",
            select=f"""SELECT ticker, {day}, {ohlcv} FROM marked WHERE date <= DATE '2001-06-30'
                AND date > coalesce(mark, DATE '1998-12-31')"""),
        "delivery": _q(BARS, """got AS (SELECT ticker, count(*) AS c FROM bars
              WHERE date >= DATE '2001-10-31' GROUP BY ticker)""",
            select="""SELECT c.ticker, coalesce(g.c, 0) AS rows, g.c IS NOT NULL AS success
                FROM caps c LEFT JOIN got g ON g.ticker = c.ticker"""),
        "load_status": _q(BARS, """got AS (SELECT ticker, count(*) AS c FROM bars
              WHERE date >= DATE '2001-10-31' GROUP BY ticker)""",
            """d AS (SELECT c.ticker, g.c IS NOT NULL AS ok FROM caps c
              LEFT JOIN got g ON g.ticker = c.ticker)""",
            select="""SELECT count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed,
                count(*) AS total, coalesce((SELECT string_agg(ticker, ' | ' ORDER BY ticker)
                  FROM (SELECT ticker FROM d WHERE NOT ok ORDER BY ticker LIMIT 10)), '')
                  AS failed_first, greatest(count(*) FILTER (NOT ok) - 10, 0) AS failed_more FROM d"""),
        "failed_tickers": _q(BARS, select="""SELECT ticker FROM caps WHERE ticker NOT IN
            (SELECT ticker FROM bars WHERE date >= DATE '2001-10-31')"""),
        "reload_meta": _q(BARS, _INC, select="""
            SELECT ticker, 'adjusted_data' AS data_source, count(*) AS record_count,
                   '2002-01-01 00:00:00' AS last_updated FROM bars WHERE ticker <> 'T1' GROUP BY ticker
            UNION ALL SELECT ticker, 'bdshare', count(*), '2002-01-01 00:00:00' FROM inc
            WHERE ticker = 'T1' GROUP BY ticker"""),
        "smart_update": _q(BARS, _OLD, _INC, """marks AS (
              SELECT ticker, max(date) AS mark FROM old GROUP BY ticker)""",
            select=f"""SELECT ticker, {day}, {ohlcv} FROM old
                UNION ALL SELECT i.ticker, CAST(i.date AS VARCHAR), i.open, i.high, i.low, i.close, i.volume
                FROM inc i JOIN marks m ON m.ticker = i.ticker
                WHERE i.date > m.mark AND i.date <= DATE '2001-06-30'"""),
        "disk_smart_update": _q(BARS, _OLD, _INC, """marks AS (
              SELECT ticker, max(date) AS mark FROM old GROUP BY ticker)""",
            select=f"""SELECT ticker, {day}, {ohlcv} FROM old
                UNION ALL SELECT i.ticker, CAST(i.date AS VARCHAR), i.open, i.high, i.low, i.close, i.volume
                FROM inc i JOIN marks m ON m.ticker = i.ticker
                WHERE i.date > m.mark AND i.date <= DATE '2001-06-30'"""),
        "smart_update_outcome": _q(BARS, _OLD, _INC, """marks AS (
              SELECT ticker, max(date) AS mark FROM old GROUP BY ticker)""",
            """got AS (SELECT i.ticker, count(*) AS c FROM inc i JOIN marks m ON m.ticker = i.ticker
                WHERE i.date > m.mark AND i.date <= DATE '2001-06-30' GROUP BY i.ticker)""",
            select="""SELECT m.ticker, CASE WHEN g.c > 0 THEN 'updated'
                WHEN m.mark >= DATE '2001-06-30' THEN 'up to date' ELSE 'failed' END AS status,
                coalesce(g.c, 0) AS rows FROM marks m LEFT JOIN got g ON g.ticker = m.ticker"""),
        "upsert_duplicates": _q(BARS, _OLD, _INC, select=f"""
            SELECT ticker, {day}, {ohlcv}, CAST(0 AS BIGINT) AS ingest_seq FROM old o
            WHERE NOT EXISTS (SELECT 1 FROM inc n WHERE n.ticker = o.ticker AND n.date = o.date)
            UNION ALL SELECT ticker, {day}, open, high, low, close + CAST(1 AS DOUBLE), volume,
              CAST(2 AS BIGINT) FROM inc"""),
        "vendor_a": _q(BARS, select=f"""SELECT ticker, {day}, {ohlcv}, 'bdshare' AS source,
            CAST(3 AS BIGINT) AS ingest_seq FROM bars"""),
        "csv_lines": _q(_CSV, select="""SELECT concat('T', CAST(tk AS VARCHAR)) AS ticker,
            CAST(date AS VARCHAR) AS date, p AS open, p AS high, p AS low, p AS close,
            CAST(trunc(q) AS BIGINT) AS volume, 'adjusted_data' AS source, CAST(4 AS BIGINT) AS ingest_seq
            FROM u WHERE n = 1"""),
        "csv_files": _q(_CSV, select="SELECT ticker, status, rows, bad_dates FROM files"),
        "csv_stats": _q(_CSV, select="""SELECT count(*) FILTER (status = 'success') AS success,
            count(*) FILTER (status = 'failed') AS failed, CAST(0 AS BIGINT) AS skipped, count(*) AS total,
            CAST(sum(bad_dates) AS BIGINT) AS bad_dates FROM files"""),
        "trades_refused": _q(BARS, POSITIONS, """held AS (SELECT ticker FROM positions
              WHERE ticker IN (SELECT ticker FROM caps WHERE paid_up_capital >= 0))""",
            """t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS turn FROM bars
              WHERE date >= DATE '2001-10-31')""",
            select="""SELECT ticker, close AS buy_price, CAST(10 AS BIGINT) AS quantity,
                CAST(date AS VARCHAR) AS purchase_date, CAST(NULL AS VARCHAR) AS notes FROM t
                WHERE turn > 1 OR ticker IN (SELECT ticker FROM held)"""),
        "adjusted_signals": _q(BARS, _ADJUSTED, _indicators("adjusted"), scored, select=f"""
            SELECT ticker, {day}, close, status, score, signal FROM scored"""),
        "one_ticker": _q(
            BARS, "seen AS (SELECT * FROM bars WHERE date <= DATE '2000-06-15')",
            _indicators("seen"), scored,
            f"""hit AS (SELECT ticker, status, message, {day}, {_round2('close')} AS close, score, signal
                FROM scored WHERE from_end = 1 AND date = DATE '2000-06-15')""",
            """asked AS (SELECT ticker FROM caps UNION ALL SELECT concat('X', ticker) FROM caps)""",
            select="""SELECT a.ticker, coalesce(h.status, 'error') AS status,
                coalesce(h.message, CASE WHEN a.ticker IN (SELECT ticker FROM bars)
                  THEN 'No data for date 2000-06-15' ELSE 'No data available' END) AS message,
                h.date, h.close, h.score, h.signal
                FROM asked a LEFT JOIN hit h ON h.ticker = a.ticker"""),
        "dashboard": _q(BARS, POSITIONS, STATE, summary_cte, select=f"""
            SELECT 'positions' AS part, {held}, buy_price * CAST(0.93 AS DOUBLE) AS stop_loss_price,
              highest_seen * CAST(0.95 AS DOUBLE) AS trailing_stop_price FROM positions
            UNION ALL BY NAME SELECT 'summary' AS part, * FROM ({summary})
            UNION ALL BY NAME SELECT 'signals' AS part, * FROM decided WHERE signal_type IS NOT NULL
            UNION ALL BY NAME SELECT DISTINCT 'tickers' AS part, ticker FROM bars"""),
        "position_add": _q(BARS, POSITIONS, """held AS (SELECT * FROM positions
              WHERE ticker IN (SELECT ticker FROM caps WHERE paid_up_capital >= 0))""",
            select=f"""SELECT {held} FROM held UNION ALL
                SELECT ticker, close, CAST(10 AS BIGINT), close, CAST(date AS VARCHAR), ''
                FROM bars WHERE back = 1 AND ticker NOT IN (SELECT ticker FROM held)"""),
        "position_update": _q(BARS, POSITIONS, select="""
            SELECT p.ticker,
                   CASE WHEN c.paid_up_capital > 500 THEN CAST(101.5 AS DOUBLE) ELSE p.buy_price END
                     AS buy_price,
                   CASE WHEN c.paid_up_capital >= 0 THEN CAST(floor(c.paid_up_capital) AS BIGINT)
                        ELSE p.quantity END AS quantity,
                   p.highest_seen, CAST(p.purchase_date AS VARCHAR) AS purchase_date, p.notes
            FROM positions p LEFT JOIN caps c ON c.ticker = p.ticker"""),
        "position_remove": _q(BARS, POSITIONS, STATE, select=f"""SELECT {held} FROM positions
            WHERE ticker NOT IN (SELECT ticker FROM decided WHERE signal_type IS NOT NULL)"""),
        "position_stops": _q(BARS, POSITIONS, select=f"""SELECT {held},
            buy_price * CAST(0.93 AS DOUBLE) AS stop_loss_price,
            highest_seen * CAST(0.95 AS DOUBLE) AS trailing_stop_price FROM positions"""),
        "break_even_stops": _q(BARS, POSITIONS, STATE, select=f"""SELECT {held},
            CASE WHEN highest_seen >= buy_price * CAST(1.1 AS DOUBLE) THEN buy_price
                 ELSE buy_price * CAST(0.93 AS DOUBLE) END AS stop_loss_price,
            highest_seen * CAST(0.95 AS DOUBLE) AS trailing_stop_price FROM state"""),
        "position_size": _q(BARS, ind, scored, SIGNALS, select="""SELECT ticker, close,
            CAST(1000000 AS DOUBLE) * CAST(0.02 AS DOUBLE) / CAST(0.05 AS DOUBLE) AS amount,
            CAST(floor(CAST(1000000 AS DOUBLE) * CAST(0.02 AS DOUBLE) / CAST(0.05 AS DOUBLE) / close)
              AS BIGINT) AS shares FROM signals"""),
        "ratchet": _q(BARS, POSITIONS, STATE, select=f"SELECT {held} FROM state"),
        "ratchet_since_last_run": _q(BARS, POSITIONS, STATE, select=f"""SELECT
            {held.replace('highest_seen', 'highest_run AS highest_seen')} FROM state"""),
        "ratchet_state": _q(BARS, POSITIONS, STATE, select=f"SELECT ticker, highest_seen, {day} FROM state"),
        "ratchet_stream": _q(BARS, POSITIONS, """now AS (
              SELECT ticker, date, CASE WHEN close > 108 AND day(date) % 2 = 0 THEN close - 6 ELSE close END AS close
              FROM bars)""", """bought AS (
              SELECT t.ticker, coalesce(a.date, p.purchase_date) AS purchase_date,
                CASE WHEN a.date IS NOT NULL THEN a.close * CAST(0.9 AS DOUBLE) ELSE p.highest_seen END AS seed
              FROM (SELECT DISTINCT ticker, tk FROM bars) t
              LEFT JOIN positions p ON p.ticker = t.ticker
              LEFT JOIN bars a ON a.ticker = t.ticker AND a.back = 10 AND t.tk % 3 = 0
              WHERE (p.ticker IS NOT NULL OR a.ticker IS NOT NULL) AND NOT (p.ticker IS NOT NULL AND t.tk % 7 = 0))""",
            """peaks AS (SELECT b.ticker, b.purchase_date, greatest(b.seed, max(n.close)) AS highest_seen, max(n.date) AS date
              FROM bought b JOIN now n ON n.ticker = b.ticker AND n.date >= b.purchase_date
              GROUP BY b.ticker, b.purchase_date, b.seed)""",
            select="""SELECT t.ticker, k.ticker IS NOT NULL AS held, CAST(k.purchase_date AS VARCHAR) AS purchase_date,
                k.highest_seen, CAST(k.date AS VARCHAR) AS date
                FROM (SELECT DISTINCT ticker FROM bars) t LEFT JOIN peaks k ON k.ticker = t.ticker"""),
        "position_check": _q(BARS, POSITIONS, STATE, select="SELECT * FROM decided"),
        "sell_signals": _q(BARS, POSITIONS, STATE, select="""SELECT * FROM decided
            WHERE signal_type IS NOT NULL"""),
        "portfolio_summary": _q(BARS, POSITIONS, summary_cte, select=summary),
        "bonus_adjust": _q(BARS, _ADJUSTED, select=f"SELECT ticker, {day}, {ohlcv} FROM adjusted"),
        "backtest": _q(BARS, ind, scored, PATHS, select="SELECT * FROM backtest"),
        "backtest_segmented": _q(BARS, ind, scored, PATHS, select="SELECT * FROM backtest"),
        "trade_quality": _q(BARS, ind, scored, PATHS, f"""s AS (
              SELECT count(*) AS closed_trades, count(*) FILTER (return_pct > 0) AS wins,
                count(*) FILTER (return_pct < 0) AS losses,
                sum({_exact('return_pct')}) FILTER (return_pct > 0) AS win_sum,
                sum({_exact('return_pct')}) FILTER (return_pct < 0) AS loss_sum
              FROM backtest WHERE exit_reason <> 'OPEN')""",
            f"""m AS (SELECT closed_trades, wins, losses, {_mean('win_sum', 'wins')} AS mean_win_pct,
                {_mean('loss_sum', 'losses')} AS mean_loss_pct FROM s)""",
            select="""SELECT *, CAST(wins AS DOUBLE) / closed_trades AS win_rate,
                mean_win_pct / abs(mean_loss_pct) AS risk_reward FROM m"""),
        "paper_profit": _q(BARS, ind, scored, PATHS, select=f"""SELECT CAST(p.date AS VARCHAR) AS date,
            count(*) AS trades,
            {_total('(p.close - p.entry_price) * 1')} AS profit
            FROM path1 p JOIN trades t ON t.ticker = p.ticker AND t.entry_no = p.entry_no
            WHERE p.bar_no IS NOT NULL AND (t.hit_no IS NULL OR p.bar_no <= t.hit_no)
            GROUP BY p.date"""),
        "paper_profit_segmented": _q(BARS, ind, scored, PATHS, select=f"""SELECT CAST(p.date AS VARCHAR) AS date,
            count(*) AS trades,
            {_total('(p.close - p.entry_price) * 1')} AS profit
            FROM path1 p JOIN trades t ON t.ticker = p.ticker AND t.entry_no = p.entry_no
            WHERE p.bar_no IS NOT NULL AND (t.hit_no IS NULL OR p.bar_no <= t.hit_no)
            GROUP BY p.date"""),
    }
    return out
