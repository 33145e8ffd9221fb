"""Queries of the event-aware evaluator. The signal is a surrogate both engines can compute: a mix of row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev
from tidemark.operators import patterns as pat
from tidemark.operators.rolling import Series
from tidemark.plans.patterns import EVENTS_SQL
from tidemark.plans.registry import BARS_SQL, lag, lead, over, register
from tidemark.sources.bars import lineitem_bars

S = Series()
TOP = 0.97


def scored(spark, d) -> DataFrame:
    """Labelled bars with a score (ties across series), a prediction and a weight."""
    b = pat.events(lineitem_bars(spark, d), S)
    b = b.withColumn("score", F.pmod(S.number() * 7919, F.lit(1009)) / F.lit(1009.0))
    return b.withColumns({"prediction": (F.col("score") > TOP).cast("int"), "weight": (F.col("score") > TOP).cast("double")})


SCORED = f"""{BARS_SQL}, {EVENTS_SQL},
sc AS (SELECT *, ((row_number() OVER (PARTITION BY stock_id ORDER BY date) * 7919) % 1009) / 1009::DOUBLE AS score FROM ev),
sd AS (SELECT *, CASE WHEN score > {TOP}::DOUBLE THEN 1 ELSE 0 END AS prediction, CASE WHEN score > {TOP}::DOUBLE THEN 1::DOUBLE ELSE 0 END AS weight FROM sc)"""


def panel_sql(h: int, source: str = "sd") -> str:
    """Common tables that end in p{h}: the panel of a horizon."""
    ahead = over(back=1, ahead=h)
    return f"""a{h} AS (SELECT *, {lead('open')} AS entry, {lead('open', h + 1)} AS "exit", CASE WHEN count(low) {ahead} = {h} THEN min(low) {ahead} END AS wl FROM {source}),
b{h} AS (SELECT *, "exit" / nullif(entry, 0) - 1 AS raw, wl / nullif(entry, 0) - 1 AS rmae FROM a{h}),
q{h} AS (SELECT quantile_cont(raw, 0.01::DOUBLE) AS lo, quantile_cont(raw, 0.99::DOUBLE) AS hi, quantile_cont(rmae, 0.01::DOUBLE) AS mlo FROM b{h}),
c{h} AS (SELECT b{h}.*, avg(raw) OVER (PARTITION BY date) AS market, CASE WHEN raw IS NOT NULL THEN least(greatest(raw, lo), hi) END AS ret, CASE WHEN rmae IS NOT NULL THEN greatest(rmae, mlo) END AS mae FROM b{h} CROSS JOIN q{h}),
d{h} AS (SELECT *, ret IS NOT NULL AND mae IS NOT NULL AND market IS NOT NULL AS valid FROM c{h}),
p{h} AS (SELECT *, CASE WHEN "PivotLow_event_id" > 0 THEN min(CASE WHEN valid THEN entry END) OVER (PARTITION BY stock_id, "PivotLow_event_id") END AS best_entry FROM d{h})"""


register("forward_panel", lambda spark, d: ev.panel(scored(spark, d), 10), f"{SCORED},\n{panel_sql(10)}\nFINAL\nSELECT * FROM p10", {"entry": 6, "exit": 6, "market": 7, "valid": None, "best_entry": 6})
register("winsorized_returns", lambda spark, d: ev.panel(scored(spark, d), 5), f"{SCORED},\n{panel_sql(5)}\nFINAL\nSELECT * FROM p5", {"ret": 7, "mae": 7})

BUDGETS = ", ".join(f"({b}::DOUBLE)" for b in ev.BUDGETS)
TOP_SQL = f"""bg(budget) AS (VALUES {BUDGETS}), nn AS (SELECT count(*) AS n FROM sd), bk AS (SELECT budget, greatest(1, floor(n * budget))::BIGINT AS k FROM bg, nn),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS r FROM sd),
ct AS (SELECT budget, k, score AS cutoff FROM bk JOIN rk ON r = k),
tp AS (SELECT sd.* EXCLUDE (weight), budget, k, cutoff, sum((score > cutoff)::INTEGER) OVER (PARTITION BY budget) AS above, sum((score = cutoff)::INTEGER) OVER (PARTITION BY budget) AS ties FROM sd JOIN ct ON score >= cutoff),
tw AS (SELECT * FROM (SELECT *, CASE WHEN score > cutoff THEN 1::DOUBLE ELSE least(1, greatest(0, (k - above) / ties)) END AS weight FROM tp) WHERE weight > 0)"""
register("top_frac_weights", lambda spark, d: ev.top_weights(scored(spark, d).drop("weight"), "score"), f"{SCORED},\n{TOP_SQL}\nFINAL\nSELECT * FROM tw", {"weight": 8}, ("budget", "stock_id", "date"))
register("select_top_frac", lambda spark, d: ev.top_weights(scored(spark, d).drop("weight"), "score", (0.005,)), f"{SCORED},\n{TOP_SQL}\nFINAL\nSELECT * FROM tw WHERE budget = 0.005", {"score": 6})


def collapse_sql(source: str, by: str, out: str) -> str:
    """Table ``out``: source rows collapsed by true event inside ``by`` (a column list that ends in a comma, or nothing)."""
    e = f"PARTITION BY {by} stock_id, \"PivotLow_event_id\""
    return f"""{out}0 AS (SELECT *, "PivotLow_event_id" > 0 AS hit, row_number() OVER ({e} ORDER BY date) AS first_, sum(weight) OVER ({e}) AS total_, max("PivotLow_base") OVER ({e}) AS base_, count(*) OVER ({e}) AS n_ FROM {source}),
{out} AS (SELECT * REPLACE (CASE WHEN hit THEN least(1, total_) ELSE weight END AS weight), coalesce(hit AND base_ = 1, FALSE) AS exact_hit, CASE WHEN hit THEN n_ - 1 ELSE 0 END AS duplicate_rows,
  CASE WHEN hit THEN greatest(0, total_ - least(1, total_)) ELSE 0 END AS duplicate_mass FROM {out}0 WHERE NOT hit OR first_ = 1)"""


register("collapse_signals", lambda spark, d: ev.collapse(scored(spark, d).where("weight > 0")), f"{SCORED},\nsel AS (SELECT * FROM sd WHERE weight > 0),\n{collapse_sql('sel', '', 'cl')}\nFINAL\nSELECT * FROM cl", {"weight": 6, "exact_hit": None, "duplicate_rows": None, "duplicate_mass": 6})


def stats_sql(h: int, flat: str, rows: str, by: str) -> str:
    """Table st{h}: counts and rates by selection."""
    return f"""tr{h} AS (SELECT count(DISTINCT CASE WHEN "PivotLow_event_id" > 0 THEN row(stock_id, "PivotLow_event_id") END) AS true_events, sum("PivotLow_base")::BIGINT AS true_bases FROM p{h} WHERE valid),
rw{h} AS (SELECT {by}, count(*) AS raw_rows, sum(weight) AS raw_mass FROM {rows} GROUP BY 1),
s0{h} AS (SELECT {by}, count(*) AS n_rows, sum(weight) AS mass, sum(duplicate_rows)::BIGINT AS duplicate_rows, sum(duplicate_mass) AS duplicate_mass, count(CASE WHEN "PivotLow_event_id" = 0 THEN 1 END) AS false_positives,
  count(CASE WHEN hit THEN 1 END) AS event_hits, count(CASE WHEN exact_hit THEN 1 END) AS exact_hits, coalesce(sum(CASE WHEN hit THEN weight END), 0) AS hit_mass,
  sum(CASE WHEN hit THEN "PivotLow_event_offset"::DOUBLE * weight END) / nullif(sum(CASE WHEN hit THEN weight END), 0) AS avg_offset,
  sum(CASE WHEN hit THEN (entry / best_entry - 1) * weight END) / nullif(sum(CASE WHEN hit THEN weight END), 0) AS avg_slippage FROM {flat} GROUP BY 1),
st{h} AS (SELECT *, coalesce(event_hits / nullif(true_events, 0), 0) AS event_recall, coalesce(exact_hits / nullif(true_bases, 0), 0) AS exact_recall, coalesce(hit_mass / nullif(mass, 0), 0) AS zone_precision
  FROM s0{h} JOIN rw{h} USING ({by}) CROSS JOIN tr{h})"""


STATS = {"n_rows": None, "raw_rows": None, "raw_mass": 6, "mass": 6, "duplicate_rows": None, "duplicate_mass": 6, "false_positives": None, "event_hits": None, "exact_hits": None, "true_events": None, "true_bases": None, "event_recall": 7, "exact_recall": 7, "zone_precision": 7, "avg_offset": 6, "avg_slippage": 6}


def _analytics(spark, d):
    df = scored(spark, d)
    return ev.analytics(df, df.select("stock_id", "date", "weight"), (10,))[1]


def chosen(h: int) -> str:
    return f"""{panel_sql(h)},
r{h} AS (SELECT *, {h} AS horizon FROM p{h} WHERE weight > 0 AND valid),
{collapse_sql(f'r{h}', 'horizon,', f'f{h}')},
{stats_sql(h, f'f{h}', f'r{h}', 'horizon')}"""


register("signal_analytics", _analytics, f"{SCORED},\n{chosen(10)}\nFINAL\nSELECT * FROM st10", STATS, ("horizon",))
WM = lambda x, w="weight": f"sum(({x}) * {w}) / nullif(sum({w}), 0)"
CW = lambda c: f"CASE WHEN {c} THEN weight END"


def forward_sql(h: int) -> str:
    return f"""{chosen(h)},
e{h} AS (SELECT sum(least(1, w)) AS effective_n FROM (SELECT date, sum(weight) AS w FROM f{h} GROUP BY 1)),
m{h} AS (SELECT horizon, {WM('ret')} AS mean_return, {WM('ret - market')} AS excess, {WM('(ret > 0)::INTEGER')} AS win_rate, coalesce(sum(CASE WHEN ret > 0 THEN ret * weight END) / nullif(sum({CW('ret > 0')}), 0), 0) AS avg_win,
  coalesce(sum(CASE WHEN ret < 0 THEN ret * weight END) / nullif(sum({CW('ret < 0')}), 0), 0) AS avg_loss,
  sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / abs(sum(CASE WHEN ret < 0 THEN ret END)) AS profit_factor, {WM('mae')} AS mean_mae, min(mae) AS worst_mae FROM f{h} GROUP BY 1),
g{h} AS (SELECT * FROM m{h} CROSS JOIN e{h} JOIN st{h} USING (horizon))"""


FORWARD = {"mean_return": 6, "excess": 6, "win_rate": 7, "avg_win": 6, "avg_loss": 6, "profit_factor": 5, "mean_mae": 6, "worst_mae": 6, "effective_n": 5} | STATS
register("forward_returns", lambda spark, d: ev.forward_returns(scored(spark, d)), f"{SCORED},\n{forward_sql(5)},\n{forward_sql(10)},\n{forward_sql(20)}\nFINAL\nSELECT * FROM g5 UNION ALL BY NAME SELECT * FROM g10 UNION ALL BY NAME SELECT * FROM g20", FORWARD, ("horizon",))


def quantile_sql(source: str, value: str, q: float, by: str, out: str) -> str:
    w = f"PARTITION BY {by} ORDER BY {value} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""{out} AS (SELECT {by}, coalesce(min(CASE WHEN cdf >= {q}::DOUBLE THEN v END), max(v)) AS v FROM (SELECT {by}, {value} AS v, sum(weight) OVER ({w}) / sum(weight) OVER (PARTITION BY {by}) AS cdf FROM {source}) GROUP BY 1)"""


register("weighted_quantile", lambda spark, d: ev.weighted_quantile(scored(spark, d).withColumn("w", F.col("volume")), "close", "w", 0.1, ("stock_id",), "q10"), f"{SCORED}, ww AS (SELECT * REPLACE (volume AS weight) FROM sd),\n{quantile_sql('ww', 'close', 0.1, 'stock_id', 'qq')}\nFINAL\nSELECT stock_id, v AS q10 FROM qq", {"q10": 6}, ("stock_id",))


def cells_sql(h: int) -> str:
    # the panel is over all rows; the selections of the budgets join it
    return f"""{panel_sql(h)},
r{h} AS (SELECT p.* EXCLUDE (weight), t.weight, t.budget FROM p{h} p JOIN tw t ON p.stock_id = t.stock_id AND p.date = t.date WHERE p.valid),
{collapse_sql(f'r{h}', 'budget,', f'f{h}')},
{stats_sql(h, f'f{h}', f'r{h}', 'budget')},
e{h} AS (SELECT budget, sum(least(1, w)) AS effective_n FROM (SELECT budget, date, sum(weight) AS w FROM f{h} GROUP BY 1, 2) GROUP BY 1),
m{h} AS (SELECT budget, {WM('ret - market')} AS excess, {WM('(ret > 0)::INTEGER')} AS win_rate, {WM('(ret < -0.05::DOUBLE)::INTEGER')} AS knife_rate FROM f{h} GROUP BY 1),
{quantile_sql(f'f{h}', 'ret', 0.1, 'budget', f'w{h}')},
{quantile_sql(f'f{h}', 'mae', 0.25, 'budget', f't{h}')},
y{h} AS (SELECT {h} AS horizon, m.*, e.effective_n, w.v AS worst_decile, t.v AS tail_mae, s.* EXCLUDE (budget), coalesce(abs(avg_slippage), 0) AS entry_slippage
  FROM m{h} m JOIN e{h} e USING (budget) JOIN w{h} w USING (budget) JOIN t{h} t USING (budget) JOIN st{h} s USING (budget))"""


CELLS = f"""{SCORED},
{TOP_SQL},
{cells_sql(5)},
{cells_sql(10)},
{cells_sql(20)},
yy AS (SELECT * FROM y5 UNION ALL BY NAME SELECT * FROM y10 UNION ALL BY NAME SELECT * FROM y20),
cs AS (SELECT *, 100 * (0.4 * excess + 0.2 * (win_rate - 0.5) - 0.1 * abs(least(0, worst_decile)) - 0.1 * knife_rate - 0.05 * abs(tail_mae) - 0.15 * entry_slippage) AS raw_score,
  effective_n / (effective_n + 50) AS damping FROM yy)"""
CELL = {"excess": 6, "win_rate": 6, "knife_rate": 6, "worst_decile": 6, "tail_mae": 6, "effective_n": 5, "entry_slippage": 6, "event_recall": 6, "zone_precision": 6, "n_rows": None, "raw_score": 4, "damping": 6, "score": 4}
register("cell_scores", lambda spark, d: (lambda x: ev.cell_scores(x, ev.top_weights(x.drop("weight"), "score")))(scored(spark, d)), f"{CELLS}\nFINAL\nSELECT *, damping * raw_score AS score FROM cs", CELL, ("budget", "horizon"))
register("multi_budget_composite", lambda spark, d: ev.multi_budget(scored(spark, d).drop("weight"), "score"), f"{CELLS}\nFINAL\nSELECT avg(damping * raw_score) AS composite, count(*) AS valid_cells FROM cs", {"composite": 4, "valid_cells": None}, ())
register("composite_score", lambda spark, d: ev.composite_score(scored(spark, d)), f"""{SCORED},
{forward_sql(10)},
{quantile_sql('f10', 'ret', 0.1, 'horizon', 'wq')},
kn AS (SELECT horizon, {WM('(ret < -0.05::DOUBLE)::INTEGER')} AS knife_rate FROM f10 GROUP BY 1)
FINAL
SELECT *, v AS worst_decile, 100 * (0.3 * excess + 0.25 * (win_rate - 0.5) - 0.2 * abs(least(0, v)) - 0.1 * knife_rate - 0.15 * abs(mean_mae)) AS composite FROM g10 JOIN wq USING (horizon) JOIN kn USING (horizon)""",
         {"excess": 6, "win_rate": 6, "knife_rate": 6, "mean_mae": 6, "worst_decile": 6, "n_rows": None, "composite": 4}, ("horizon",))
register("regime_breakdown", lambda spark, d: ev.regimes(scored(spark, d)), f"""{SCORED},
{chosen(10)},
tl AS (SELECT date, avg(t) AS trail FROM (SELECT date, close / nullif({lag('close', 20)}, 0) - 1 AS t FROM bars) GROUP BY 1),
rg AS (SELECT f10.*, CASE WHEN trail > 0 THEN 'bull' WHEN trail <= 0 THEN 'bear' END AS regime FROM f10 LEFT JOIN tl USING (date))
FINAL
SELECT regime, avg(ret) AS mean_return, avg((ret > 0)::INTEGER) AS win_rate, avg((ret < -0.05::DOUBLE)::INTEGER) AS knife_rate, avg(mae) AS mean_mae, count(*) AS n_signals FROM rg WHERE regime IS NOT NULL GROUP BY 1""",
         {"mean_return": 6, "win_rate": 7, "knife_rate": 7, "mean_mae": 6, "n_signals": None}, ("regime",))
register("roc_auc_ap", lambda spark, d: ev.classification(scored(spark, d), "PivotLow", score="score"), f"""{SCORED},
t AS (SELECT score, sum(("PivotLow" = 1)::INTEGER) AS p, sum(("PivotLow" <> 1)::INTEGER) AS n FROM sd GROUP BY 1),
u AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM t)
FINAL
SELECT sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS roc_auc, sum(p * tp / (tp + fp)) / sum(p) AS avg_precision FROM u""", {"roc_auc": 8, "avg_precision": 8}, ())  # fmt: skip
register("classification_metrics", lambda spark, d: ev.classification(scored(spark, d), "PivotLow", predicted="prediction"), f"""{SCORED},
c AS (SELECT sum(("PivotLow" = 1 AND prediction = 1)::INTEGER)::BIGINT AS tp, sum(("PivotLow" <> 1 AND prediction = 1)::INTEGER)::BIGINT AS fp, sum(("PivotLow" = 1 AND prediction <> 1)::INTEGER)::BIGINT AS fn, sum(("PivotLow" <> 1 AND prediction <> 1)::INTEGER)::BIGINT AS tn FROM sd),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
FINAL
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m""", {"tp": None, "fp": None, "fn": None, "tn": None, "precision": 8, "recall": 8, "f1": 8}, ())  # fmt: skip
register("confusion", lambda spark, d: ev.confusion(scored(spark, d).withColumn("y", F.col("PivotLow").cast("int")), "y", "prediction"), f'{SCORED}\nFINAL\nSELECT "PivotLow"::INTEGER AS actual, prediction AS predicted, count(*) AS n FROM sd GROUP BY ALL', {"n": None}, ("actual", "predicted"))
BACK = f"""{SCORED},
nb AS (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date) AS rn, {lead('date')} AS entry_date, {lead('open')} AS entry_price FROM sd),
sel AS (SELECT * FROM nb WHERE prediction = 1 AND entry_date IS NOT NULL),
{collapse_sql('sel', '', 'cl')},
pa AS (SELECT c.stock_id, c.date AS signal_date, c.entry_date, c.entry_price, b.date, b.rn - c.rn - 1 AS i, b.low, b.close,
         greatest(c.entry_price, max(b.high) OVER (PARTITION BY c.stock_id, c.date ORDER BY b.rn)) AS peak FROM cl c JOIN nb b ON b.stock_id = c.stock_id AND b.rn BETWEEN c.rn + 1 AND c.rn + 31),
sp AS (SELECT *, peak * (1 - 0.07::DOUBLE / pow(2, i // 5)) AS stop FROM pa),
tr AS (SELECT stock_id, entry_date, any_value(entry_price) AS entry_price, min(CASE WHEN low <= stop THEN i END) AS hit, max(date) AS last_date, arg_max(close, i) AS last_close FROM sp GROUP BY 1, 2),
td AS (SELECT tr.stock_id, tr.entry_date, tr.entry_price, coalesce(sp.date, last_date) AS exit_date, coalesce(sp.stop, last_close) AS exit_price, CASE WHEN hit IS NOT NULL THEN 'stop' ELSE 'hold/end' END AS exit_reason
  FROM tr LEFT JOIN sp ON sp.stock_id = tr.stock_id AND sp.entry_date = tr.entry_date AND sp.i = tr.hit),
tt AS (SELECT *, (exit_price - entry_price) / entry_price AS return_pct FROM td)"""
register("backtest_trades", lambda spark, d: ev.backtest(scored(spark, d)), f"{BACK}\nFINAL\nSELECT * FROM tt", {"exit_date": None, "entry_price": 6, "exit_price": 6, "return_pct": 7, "exit_reason": None}, ("stock_id", "entry_date"))
register("backtest_summary", lambda spark, d: ev.backtest_summary(ev.backtest(scored(spark, d))), f"""{BACK}
FINAL
SELECT count(*) AS n_trades, avg((return_pct > 0)::INTEGER) AS win_rate, avg(return_pct) AS mean_return, quantile_cont(return_pct, 0.5) AS median_return,
  coalesce(avg(CASE WHEN return_pct > 0 THEN return_pct END), 0) AS avg_positive, coalesce(avg(CASE WHEN return_pct <= 0 THEN return_pct END), 0) AS avg_negative, sum((return_pct > 0)::INTEGER)::BIGINT AS n_positive FROM tt""",
         {"n_trades": None, "win_rate": 7, "mean_return": 6, "median_return": 6, "avg_positive": 6, "avg_negative": 6, "n_positive": None}, ())
RANDOM = f"""{SCORED},
nb AS (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date) - 1 AS i, {lead('open', 11)} / nullif({lead('open')}, 0) - 1 AS ret, count(*) OVER (PARTITION BY stock_id) AS n FROM sd),
sel AS (SELECT * REPLACE (1::DOUBLE AS weight) FROM nb WHERE prediction = 1),
{collapse_sql('sel', '', 'cl')},
mi AS (SELECT stock_id, date, n - 12 AS m, ret FROM cl WHERE ret IS NOT NULL AND n > 12),
dr AS (SELECT stock_id, sim, ('0x' || substr(md5(stock_id || '|' || strftime(date, '%Y-%m-%d') || '|' || sim || '|42'), 1, 8))::BIGINT % m AS i FROM mi, (SELECT unnest(generate_series(1, 500)) AS sim)),
si AS (SELECT sim, avg(ret) AS mean FROM dr JOIN nb USING (stock_id, i) GROUP BY 1),
o1 AS (SELECT avg(mean) AS random_mean, stddev_pop(mean) AS random_std, count(*) AS n_simulations FROM si),
o2 AS (SELECT *, (signal_mean - random_mean) / nullif(random_std, 0) AS z FROM o1, (SELECT avg(ret) AS signal_mean, count(*) AS n_signals FROM mi)),
o3 AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS t FROM o2),
o4 AS (SELECT *, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z / 2) / 2 AS tail FROM o3)
FINAL
SELECT *, CASE WHEN z >= 0 THEN tail ELSE 1 - tail END AS p_value FROM o4"""
register("random_entry_benchmark", lambda spark, d: ev.random_entries(scored(spark, d)), RANDOM, {"signal_mean": 6, "n_signals": None, "random_mean": 6, "random_std": 6, "n_simulations": None, "z": 5, "p_value": 5}, ())


def ranks_sql(label: str, out: str) -> str:
    """Tables that end in ``out``: one row of AUC and average precision."""
    return f"""{out}t AS (SELECT score, sum(("{label}" = 1)::INTEGER) AS p, sum(("{label}" <> 1)::INTEGER) AS n FROM sd GROUP BY 1),
{out}u AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM {out}t),
{out} AS (SELECT sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS auc, sum(p * tp / (tp + fp)) / sum(p) AS ap FROM {out}u)"""


TIER = {"avg_precision": 8, "roc_auc": 8, "base_avg_precision": 8, "base_roc_auc": 8}
register("tiered_gate", lambda spark, d: ev.ranking(scored(spark, d)), f"""{SCORED},
{ranks_sql('PivotLow', 'rl')},
{ranks_sql('PivotLow_base', 'rb')}
FINAL
SELECT rl.ap AS avg_precision, rl.auc AS roc_auc, rb.ap AS base_avg_precision, rb.auc AS base_roc_auc, rl.ap >= 0.05::DOUBLE AS passes FROM rl, rb""", {**TIER, "passes": None}, ())  # fmt: skip
register("tiered_eval", lambda spark, d: ev.tiered_eval(scored(spark, d).drop("weight"), least=0.01), f"""{CELLS},
{ranks_sql('PivotLow', 'rl')},
{ranks_sql('PivotLow_base', 'rb')},
cm AS (SELECT avg(damping * raw_score) AS composite, count(*) AS valid_cells FROM cs)
FINAL
SELECT rl.ap AS avg_precision, rl.auc AS roc_auc, rb.ap AS base_avg_precision, rb.auc AS base_roc_auc, rl.ap >= 0.01::DOUBLE AS passes, composite, valid_cells, TRUE AS passed FROM rl, rb, cm""",
         {**TIER, "passes": None, "composite": 4, "valid_cells": None, "passed": None}, ())
register("class_report", lambda spark, d: ev.class_report(scored(spark, d).withColumn("y", F.col("PivotLow").cast("int")), "y", "prediction"), f"""{SCORED},
cc AS (SELECT "PivotLow"::INTEGER AS a, prediction AS p, count(*) AS n FROM sd GROUP BY ALL),
kk AS (SELECT unnest([0, 1]) AS class),
pp AS (SELECT class, coalesce((SELECT sum(n) FROM cc WHERE a = class AND p = class), 0) AS hits, coalesce((SELECT sum(n) FROM cc WHERE p = class), 0) AS said, coalesce((SELECT sum(n) FROM cc WHERE a = class), 0)::BIGINT AS support FROM kk),
qq AS (SELECT *, coalesce(hits / nullif(said, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM pp)
FINAL
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM qq""", {"precision": 8, "recall": 8, "f1": 8, "support": None}, ("class",))  # fmt: skip
SIZED = f"""{SCORED},
nb AS (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date) AS rn FROM sd),
sg AS (SELECT *, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS r FROM nb WHERE prediction = 1),
sz AS (SELECT stock_id, date, rn, score, 1 + 4 * r AS units, 0.05::DOUBLE + 0.05::DOUBLE * r AS stop FROM sg),
pa AS (SELECT z.stock_id, z.date AS sd_, z.units, z.stop, b.date, b.rn - z.rn - 1 AS i, b.low, b.close, first_value(b.open) OVER w AS entry_price, max(b.high) OVER w AS hi
  FROM sz z JOIN nb b ON b.stock_id = z.stock_id AND b.rn BETWEEN z.rn + 1 AND z.rn + 31 WINDOW w AS (PARTITION BY z.stock_id, z.date ORDER BY b.rn)),
sp AS (SELECT *, greatest(entry_price, hi) * (1 - stop / pow(2, i // 5)) AS level FROM pa),
tr AS (SELECT stock_id, sd_ AS date, any_value(units) AS units, any_value(stop) AS stop, any_value(entry_price) AS entry_price, min(CASE WHEN low <= level THEN i END) AS hit, count(*) AS n, max(date) AS last_date, arg_max(close, i) AS last_close FROM sp GROUP BY 1, 2),
td AS (SELECT tr.*, coalesce(sp.date, last_date) AS exit_date, coalesce(sp.level, last_close) AS exit_price, CASE WHEN hit IS NOT NULL THEN 'S' WHEN n > 30 THEN 'H' ELSE 'E' END AS code
  FROM tr LEFT JOIN sp ON sp.stock_id = tr.stock_id AND sp.sd_ = tr.date AND sp.i = tr.hit),
tt AS (SELECT *, (exit_price - entry_price) / entry_price AS return_pct, units * (1 + (exit_price - entry_price) / entry_price) AS result FROM td)"""
register("sized_trades", lambda spark, d: ev.sized_trades(scored(spark, d)), f"{SIZED}\nFINAL\nSELECT * FROM tt", {"units": 6, "stop": 8, "entry_price": 6, "exit_date": None, "exit_price": 6, "code": None, "return_pct": 7, "result": 6})
register("top_returners", lambda spark, d: ev.top_stocks(ev.sized_trades(scored(spark, d)), 4), f"""{SIZED}
FINAL
SELECT stock_id, count(*) AS n_signals, sum(units) AS invested, sum(result) AS result, (sum(result) - sum(units)) / sum(units) AS roi FROM tt GROUP BY 1 ORDER BY roi DESC, stock_id LIMIT 4""",
         {"n_signals": None, "invested": 5, "result": 5, "roi": 7}, ("stock_id",))
register("eval_detail", lambda spark, d: (lambda x: ev.eval_detail(ev.cell_scores(x, ev.top_weights(x.drop("weight"), "score", (0.01, 0.02)), (5,)).withColumn("fold", F.lit(1))))(scored(spark, d)), f"{CELLS}\nFINAL\nSELECT *, damping * raw_score AS score FROM cs WHERE budget >= 0.01 AND horizon = 5",
         {"score": 4, "effective_n": 5, "excess": 6, "win_rate": 6, "worst_decile": 6, "knife_rate": 6, "tail_mae": 6, "entry_slippage": 6}, ("budget", "horizon"))
