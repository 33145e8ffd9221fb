"""Event-aware evaluation of ranked signals. A signal is a column; everything joins by (stock_id, date), never by position."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import patterns as pat
from tidemark.operators.order import quantiles, running
from tidemark.operators.rolling import Series, flag

# Fixed evaluation grid and weights.
BUDGETS = (0.001, 0.0025, 0.005, 0.01, 0.02)
HORIZONS = (5, 10, 20)
WINSOR, KNIFE, DAMP = 0.01, -0.05, 50
CELL = {"excess": 0.40, "win_rate": 0.20, "worst_decile": 0.10, "knife_rate": 0.10, "tail_mae": 0.05, "entry_slippage": 0.15}
COMPOSITE = {"excess": 0.30, "win_rate": 0.25, "worst_decile": 0.20, "knife_rate": 0.10, "mean_mae": 0.15}


def wide_panel(df: DataFrame, horizons: Iterable[int]) -> DataFrame:
    """Rows with entry (next open) and for each horizon h exit_h, ret_h, mae_h, market_h, valid_h and best_h.

    The market is the date's mean raw return; only then are returns clipped to their 1 % and 99 % quantiles and worst
    lows to their 1 % quantile. All horizons share one pass by series, one by date and one by event; the quantiles of
    all horizons are taken together, in a job of their own.
    """
    s, horizons = Series(), list(horizons)
    df = pat.ensure_events(df, s)
    new = {"entry": s.lead("open")}
    for h in horizons:
        ahead = s.w.rowsBetween(1, h)
        new |= {f"exit_{h}": s.lead("open", h + 1), f"__low_{h}": F.when(F.count("low").over(ahead) == h, F.min("low").over(ahead))}
    df = df.withColumns(new)
    df = df.withColumns({f"__{n}_{h}": F.try_divide(F.col(c), F.col("entry")) - 1 for h in horizons for n, c in (("raw", f"exit_{h}"), ("mae", f"__low_{h}"))})
    day = Window.partitionBy("date")
    df = df.withColumns({f"market_{h}": F.avg(f"__raw_{h}").over(day) for h in horizons})
    cuts = {f"__{k}_{h}": (f"__{n}_{h}", q) for h in horizons for k, n, q in (("lo", "raw", WINSOR), ("hi", "raw", 1 - WINSOR), ("mlo", "mae", WINSOR))}
    at = {k: F.lit(v) for k, v in quantiles(df.select(*{c for c, _ in cuts.values()}), cuts).first().asDict().items()}  # three numbers a horizon
    clipped = {}
    for h in horizons:
        clipped[f"ret_{h}"] = F.when(F.col(f"__raw_{h}").isNotNull(), F.least(F.greatest(F.col(f"__raw_{h}"), at[f"__lo_{h}"]), at[f"__hi_{h}"]))
        clipped[f"mae_{h}"] = F.when(F.col(f"__mae_{h}").isNotNull(), F.greatest(F.col(f"__mae_{h}"), at[f"__mlo_{h}"]))
    df = df.withColumns(clipped)
    df = df.withColumns({f"valid_{h}": F.col(f"ret_{h}").isNotNull() & F.col(f"mae_{h}").isNotNull() & F.col(f"market_{h}").isNotNull() for h in horizons})
    zone = Window.partitionBy("stock_id", pat.EVENT, F.when(F.col(pat.EVENT) == 0, F.col("date")))  # rows off events stay apart
    df = df.withColumns({f"best_{h}": F.when(F.col(pat.EVENT) > 0, F.min(F.when(F.col(f"valid_{h}"), F.col("entry"))).over(zone)) for h in horizons})
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def panel(df: DataFrame, horizon: int) -> DataFrame:
    """The panel of one horizon: entry, exit, ret, mae, market, valid, best_entry."""
    out = wide_panel(df, (horizon,))
    names = {f"{n}_{horizon}": n for n in ("exit", "ret", "mae", "market", "valid")} | {f"best_{horizon}": "best_entry"}
    return out.withColumnsRenamed(names)


def top_weights(df: DataFrame, score: str, budgets: Iterable[float] = BUDGETS) -> DataFrame:
    """Rows with weight > 0 for each budget: 1 over the cutoff, an even share of what is left at the cutoff.

    The cutoff is the k-th largest score, found by running counts of distinct scores from the top.
    """
    n = df.agg(F.count("*").alias("n"), F.count(score).alias("scored")).first()
    grid = [(float(b), max(1, int(n["n"] * b))) for b in budgets] if n["n"] else []
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("c"))
    ranked = running(counts, score, {"upto": "c"})
    ks = df.sparkSession.createDataFrame(grid, "budget double, k long")
    cut = ranked.join(F.broadcast(ks), F.col("upto") >= F.col("k")).groupBy("budget", "k").agg(F.max(score).alias("cutoff"))
    tied = df.join(F.broadcast(cut), F.col(score) >= F.col("cutoff"))  # a row a budget
    per = tied.groupBy("budget").agg(F.sum((F.col(score) > F.col("cutoff")).cast("long")).alias("above"), F.sum((F.col(score) == F.col("cutoff")).cast("long")).alias("ties"))
    out = tied.join(F.broadcast(per), "budget")
    share = F.greatest(F.lit(0.0), (F.col("k") - F.col("above")) / F.col("ties"))
    return out.withColumn("weight", F.when(F.col(score) > F.col("cutoff"), 1.0).otherwise(F.least(F.lit(1.0), share))).drop("cutoff", "above", "ties").where("weight > 0")


def collapse(selected: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of each true event that the selected rows hit: the earliest, with capped weight; misses as they are.

    Adds exact_hit, duplicate_rows and duplicate_mass. ``by``: columns that separate selections.
    """
    e = Window.partitionBy(*by, "stock_id", pat.EVENT)
    first = F.row_number().over(e.orderBy("date"))
    hit = F.col(pat.EVENT) > 0
    total = F.sum("weight").over(e)
    out = selected.withColumns({
        "__hit": hit, "__first": first, "__total": total, "exact_hit": F.coalesce(hit & (F.max(pat.BASE).over(e) == 1), F.lit(False)), "__n": F.count("*").over(e),
    }).where(~F.col("__hit") | (F.col("__first") == 1))
    return out.withColumns({
        "duplicate_rows": F.when(F.col("__hit"), F.col("__n") - 1).otherwise(F.lit(0)),
        "duplicate_mass": F.when(F.col("__hit"), F.greatest(F.lit(0.0), F.col("__total") - F.least(F.lit(1.0), "__total"))).otherwise(0.0),
        "weight": F.when(F.col("__hit"), F.least(F.lit(1.0), "__total")).otherwise(F.col("weight")),
    }).drop("__hit", "__first", "__total", "__n")


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float, by: tuple[str, ...], out: str) -> DataFrame:
    """(by, out): the first value in order at which the running share of weight reaches q.

    Equal values are summed first. Approximate cuts split each group into at most 64 parts whose weights are summed,
    and only the part that holds the quantile is ordered: no task orders a whole group, and the result is exact.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    cuts = per.groupBy(*by).agg(F.percentile_approx(value, [k / 64 for k in range(1, 64)], 1000).alias("__cuts"))
    per = per.join(cuts, list(by)).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    g = Window.partitionBy(*by)
    parts = per.groupBy(*by, "__part").agg(F.sum("__w").alias("__sum"))
    parts = parts.withColumns({"__upto": F.sum("__sum").over(g.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__sum").over(g)})
    reached = F.when(F.col("__upto") / F.col("__all") >= q, F.col("__part"))
    parts = parts.withColumn("__hit", F.coalesce(F.min(reached).over(g), F.max("__part").over(g))).where("__part = __hit")
    inside = per.join(parts.select(*by, "__part", (F.col("__upto") - F.col("__sum")).alias("__before"), "__all"), [*by, "__part"])
    run = F.sum("__w").over(g.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("__cdf", (F.col("__before") + run) / F.col("__all"))
    return inside.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("__cdf") >= q, F.col(value))), F.max(value)).alias(out))


def _wmean(c, cond=None) -> Column:
    value = c if isinstance(c, Column) else F.col(c)
    w = F.col("weight") if cond is None else F.when(cond, F.col("weight"))
    return F.try_divide(F.sum(value * w), F.sum(w))


def effective_days(df: DataFrame, by: tuple[str, ...], out: str = "effective_n") -> DataFrame:
    per = df.groupBy(*by, "date").agg(F.sum("weight").alias("w"))
    return per.groupBy(*by).agg(F.sum(F.least(F.lit(1.0), "w")).alias(out))


def analytics(df: DataFrame, selected: DataFrame, horizons: Iterable[int], by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(collapsed entries, one row of counts and rates) for each selection and horizon.

    selected: by, stock_id, date, weight. One panel serves all horizons and selections; rows are multiplied by the
    horizons only after the selection.
    """
    horizons = list(horizons)
    keys = (*by, "horizon")
    wide = wide_panel(df.drop("weight", *by), horizons)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{n}_{h}").alias(n) for n in ("ret", "mae", "market", "valid")], F.col(f"best_{h}").alias("best_entry")) for h in horizons]))
    kept = ("stock_id", "date", pat.LABEL, pat.BASE, pat.EVENT, pat.OFFSET, "entry")
    rows = wide.join(selected.where("weight > 0").select(*by, "stock_id", "date", "weight"), ["stock_id", "date"])
    rows = rows.select(*by, *kept, "weight", each.alias("x")).select(*by, *kept, "weight", "x.*").where("valid").drop("valid")
    rows = rows.persist()  # the selected rows only; every measure reads them, and a lost block is computed again
    flat = collapse(rows, keys)
    hit = F.col(pat.EVENT) > 0
    raw = rows.groupBy(*keys).agg(F.count("*").alias("raw_rows"), F.sum("weight").alias("raw_mass"))
    loss, win = F.col("ret") < 0, F.col("ret") > 0
    losses = F.sum(F.when(loss, F.col("ret")))
    stats = flat.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.sum("weight").alias("mass"), F.sum("duplicate_rows").alias("duplicate_rows"), F.sum("duplicate_mass").alias("duplicate_mass"),
        F.sum((F.col(pat.EVENT) == 0).cast("long")).alias("false_positives"), F.sum(hit.cast("long")).alias("event_hits"), F.sum(F.col("exact_hit").cast("long")).alias("exact_hits"),
        F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0.0)).alias("hit_mass"), _wmean(F.col(pat.OFFSET).cast("double"), hit).alias("avg_offset"),
        _wmean(F.col("entry") / F.col("best_entry") - 1, hit).alias("avg_slippage"),
        _wmean("ret").alias("mean_return"), _wmean(F.col("ret") - F.col("market")).alias("excess"), _wmean(flag(win)).alias("win_rate"), _wmean(flag(F.col("ret") < KNIFE)).alias("knife_rate"),
        F.coalesce(_wmean("ret", win), F.lit(0.0)).alias("avg_win"), F.coalesce(_wmean("ret", loss), F.lit(0.0)).alias("avg_loss"),
        F.when(F.coalesce(losses, F.lit(0.0)) == 0, float("inf")).otherwise(F.try_divide(F.coalesce(F.sum(F.when(win, F.col("ret"))), F.lit(0.0)), F.abs(losses))).alias("profit_factor"),
        _wmean("mae").alias("mean_mae"), F.min("mae").alias("worst_mae"),
    )
    truth = wide.where(hit).select("stock_id", pat.EVENT, pat.BASE, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"valid_{h}").alias("valid")) for h in horizons])).alias("x"))
    truth = truth.where("x.valid").groupBy(F.col("x.horizon").alias("horizon")).agg(F.count_distinct("stock_id", pat.EVENT).alias("true_events"), F.sum(F.col(pat.BASE).cast("long")).alias("true_bases"))
    stats = stats.join(raw, list(keys)).join(effective_days(flat, keys), list(keys)).join(F.broadcast(truth), "horizon", "left")  # a row a horizon
    stats = stats.fillna(0, ["true_events", "true_bases"])
    return flat, stats.withColumns({
        "event_recall": F.coalesce(F.try_divide(F.col("event_hits"), F.col("true_events")), F.lit(0.0)),
        "exact_recall": F.coalesce(F.try_divide(F.col("exact_hits"), F.col("true_bases")), F.lit(0.0)),
        "zone_precision": F.coalesce(F.try_divide(F.col("hit_mass"), F.col("mass")), F.lit(0.0)),
    }).drop("hit_mass")


def forward_returns(df: DataFrame, weight: str = "weight", horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """One row a horizon: the measures of the selected entries."""
    return analytics(df, df.select("stock_id", "date", F.col(weight).alias("weight")), horizons)[1]


def cell_scores(df: DataFrame, selected: DataFrame, horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """One row for each (budget, horizon) with valid entries: measures, raw score, damping weight and their product."""
    keys = ("budget", "horizon")
    flat, stats = analytics(df, selected, horizons, ("budget",))
    out = stats.join(weighted_quantile(flat, "ret", "weight", 0.1, keys, "worst_decile"), list(keys)).join(weighted_quantile(flat, "mae", "weight", 0.25, keys, "tail_mae"), list(keys))
    slip = F.coalesce(F.abs(F.col("avg_slippage")), F.lit(0.0))
    raw = 100 * (
        CELL["excess"] * F.col("excess") + CELL["win_rate"] * (F.col("win_rate") - 0.5) - CELL["worst_decile"] * F.abs(F.least(F.lit(0.0), "worst_decile"))
        - CELL["knife_rate"] * F.col("knife_rate") - CELL["tail_mae"] * F.abs("tail_mae") - CELL["entry_slippage"] * slip
    )
    out = out.withColumns({"entry_slippage": slip, "raw_score": raw, "damping": F.col("effective_n") / (F.col("effective_n") + DAMP)})
    return out.withColumn("score", F.col("damping") * F.col("raw_score"))


def multi_budget(df: DataFrame, score: str, budgets: Iterable[float] = BUDGETS, horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """One row: the mean score of the valid cells (-infinity without any) and their number."""
    cells = cell_scores(df, top_weights(df, score, budgets), horizons)
    return cells.agg(F.coalesce(F.avg("score"), F.lit(float("-inf"))).alias("composite"), F.count("*").alias("valid_cells"))


def composite_score(df: DataFrame, weight: str = "weight", horizon: int = 10) -> DataFrame:
    """One row: the single-horizon score of a selection."""
    flat, stats = analytics(df, df.select("stock_id", "date", F.col(weight).alias("weight")), (horizon,))
    m = stats.join(weighted_quantile(flat, "ret", "weight", 0.1, ("horizon",), "worst_decile"), "horizon")
    c = COMPOSITE
    value = 100 * (
        c["excess"] * F.col("excess") + c["win_rate"] * (F.col("win_rate") - 0.5) - c["worst_decile"] * F.abs(F.least(F.lit(0.0), "worst_decile"))
        - c["knife_rate"] * F.col("knife_rate") - c["mean_mae"] * F.abs("mean_mae")
    )
    return m.withColumn("composite", value)


def regimes(df: DataFrame, weight: str = "weight", horizon: int = 10) -> DataFrame:
    """Entries in bull and bear markets: by the date's mean trailing 20-bar return; plain means."""
    s = Series()
    trailing = df.withColumn("__t", s.pct("close", 20)).groupBy("date").agg(F.avg("__t").alias("trailing"))
    flat, _ = analytics(df, df.select("stock_id", "date", F.col(weight).alias("weight")), (horizon,))
    regime = F.when(F.col("trailing") > 0, "bull").when(F.col("trailing") <= 0, "bear")
    rows = flat.join(trailing, "date", "left").withColumn("regime", regime).where("regime is not null")
    return rows.groupBy("regime").agg(F.avg("ret").alias("mean_return"), F.avg(flag(F.col("ret") > 0)).alias("win_rate"), F.avg(flag(F.col("ret") < KNIFE)).alias("knife_rate"), F.avg("mae").alias("mean_mae"), F.count("*").alias("n_signals"))


def classification(df: DataFrame, label: str, predicted: str | None = None, score: str | None = None) -> DataFrame:
    """One row: counts, precision, recall, F1; and with a score the area under the ROC curve and average precision.

    Ranking measures come from running counts over distinct scores (pre-aggregated): ties share their midrank and
    their threshold. Where one class is missing both are NULL.
    """
    out = None
    if predicted is not None:
        y, p = F.col(label) == 1, F.col(predicted) == 1
        c = df.agg(*[F.sum((a & b).cast("long")).alias(n) for n, a, b in (("tp", y, p), ("fp", ~y, p), ("fn", y, ~p), ("tn", ~y, ~p))])
        precision, recall = (F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(k)), F.lit(0.0)) for k in ("fp", "fn"))
        out = c.withColumns({"precision": precision, "recall": recall})
        out = out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    if score is not None:
        per = df.groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
        per = running(per.where(F.col(score).isNotNull()), score, {"tp": "p", "fp": "n"})
        sums = per.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("wins"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("gain"))
        rank = sums.select(F.when(F.col("nn") > 0, F.try_divide(F.col("wins"), F.col("np") * F.col("nn"))).alias("roc_auc"), F.when(F.col("nn") > 0, F.try_divide(F.col("gain"), F.col("np"))).alias("avg_precision"))
        out = rank if out is None else out.crossJoin(F.broadcast(rank))  # one row
    return out


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def _trades(df: DataFrame, entries: DataFrame, hold: int) -> DataFrame:
    """Entries (stock_id, date, stop and others) with the trade that follows each.

    Entry at the next open; a trailing stop under the highest high so far, its width halved every five bars; the first
    bar whose low reaches the stop ends the trade there, else the last close does. Only the bars behind entries are
    gathered: an entry asks for its bars by (series, number).
    """
    s = Series()
    bars = df.select("stock_id", "date", s.number().alias("__no"), "open", "high", "low", "close")
    asked = entries.join(bars.select("stock_id", "date", F.col("__no").alias("__entry")), ["stock_id", "date"])
    asked = asked.select("*", F.posexplode(F.sequence(F.col("__entry") + 1, F.col("__entry") + hold + 1)).alias("i", "__no"))
    bars = bars.withColumnsRenamed({"date": "at"})
    path = Window.partitionBy("stock_id", "date").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.join(bars, ["stock_id", "__no"])
    rows = rows.withColumns({"entry_price": F.first("open").over(path), "__peak": F.max("high").over(path)})
    level = F.greatest("entry_price", "__peak") * (1 - F.col("stop") / F.pow(F.lit(2.0), F.floor(F.col("i") / 5)))
    rows = rows.withColumn("__level", level)
    hit = F.struct("i", F.col("at").alias("date"), F.col("__level").alias("price"))
    kept = [c for c in entries.columns if c not in ("stock_id", "date")]
    out = rows.groupBy("stock_id", "date").agg(
        *[F.first(c).alias(c) for c in kept], F.min("at").alias("entry_date"), F.first("entry_price").alias("entry_price"), F.count("*").alias("__n"),
        F.min(F.when(F.col("low") <= F.col("__level"), hit)).alias("__hit"), F.max(F.struct("i", F.col("at").alias("date"), F.col("close").alias("price"))).alias("__end"),
    )
    out = out.withColumns({
        "exit_date": F.coalesce("__hit.date", "__end.date"), "exit_price": F.coalesce("__hit.price", "__end.price"),
        "code": F.when(F.col("__hit").isNotNull(), "S").when(F.col("__n") > hold, "H").otherwise("E"),
    })
    return out.withColumn("return_pct", (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")).drop("__hit", "__end", "__n")


def backtest(df: DataFrame, signal: str = "prediction", stop: float = 0.07, hold: int = 30) -> DataFrame:
    """Trades of collapsed signals that have a next bar; exit_reason is stop, or hold/end."""
    s = Series()
    df = pat.ensure_events(df, s)
    rows = df.withColumn("__next", s.lead("date")).where((F.col(signal) == 1) & F.col("__next").isNotNull()).withColumn("weight", F.lit(1.0))
    entries = collapse(rows).select("stock_id", "date", F.lit(stop).alias("stop"))
    out = _trades(df, entries, hold)
    return out.select("stock_id", "entry_date", "exit_date", "entry_price", "exit_price", F.when(F.col("code") == "S", "stop").otherwise("hold/end").alias("exit_reason"), "return_pct")


def sized_trades(df: DataFrame, signal: str = "prediction", score: str = "score", hold: int = 30) -> DataFrame:
    """A trade for each signal row: 1 to 5 units and a stop of 5 to 10 % by its score among the signals' scores.

    code: S stopped, H held to the end, E the series ended. invested and result are in units.
    """
    chosen = df.where(F.col(signal) == 1)
    span = chosen.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    rows = chosen.select("stock_id", "date", F.col(score).alias("score")).crossJoin(F.broadcast(span))  # one row
    rank = (F.col("score") - F.col("__lo")) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0)
    entries = rows.select("stock_id", "date", "score", (1 + 4 * rank).alias("units"), (0.05 + 0.05 * rank).alias("stop"))
    out = _trades(df, entries, hold)
    return out.withColumns({"invested": F.col("units"), "result": F.col("units") * (1 + F.col("return_pct"))})


def top_stocks(trades: DataFrame, n: int = 16, by: str = "roi") -> DataFrame:
    """The n series with the best return on what was invested (roi), or with most signals (n_signals)."""
    per = trades.groupBy("stock_id").agg(F.count("*").alias("n_signals"), F.sum("invested").alias("invested"), F.sum("result").alias("result"))
    return per.withColumn("roi", (F.col("result") - F.col("invested")) / F.col("invested")).orderBy(F.desc(by), "stock_id").limit(n)


def backtest_summary(trades: DataFrame) -> DataFrame:
    r = F.col("return_pct")
    out = trades.agg(
        F.count("*").alias("n_trades"), F.avg(flag(r > 0)).alias("win_rate"), F.avg(r).alias("mean_return"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_positive"), F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_negative"), F.sum(flag(r > 0)).alias("n_positive"),
    )
    return out.crossJoin(F.broadcast(quantiles(trades, {"median_return": ("return_pct", 0.5)})))  # one row


def ranking(df: DataFrame, score: str = "score", least: float = 0.05) -> DataFrame:
    """One row, tier 1: average precision and AUC for labels and for base pivots, and whether the first passes."""
    df = pat.ensure_events(df, Series())
    label, base = (classification(df, c, score=score) for c in (pat.LABEL, pat.BASE))
    base = base.withColumnsRenamed({"roc_auc": "base_roc_auc", "avg_precision": "base_avg_precision"})
    return label.crossJoin(F.broadcast(base)).withColumn("passes", F.coalesce(F.col("avg_precision") >= least, F.lit(False)))  # one row


def tiered_eval(df: DataFrame, score: str = "score", least: float = 0.05, budgets: Iterable[float] = BUDGETS, horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """One row: tier 1, and where its gate is passed the composite over budgets and horizons (else NULL, not passed)."""
    one = ranking(df, score, least)
    if not one.first()["passes"]:
        return one.withColumns({"composite": F.lit(None).cast("double"), "valid_cells": F.lit(0).cast("long"), "passed": F.lit(False)})
    both = one.crossJoin(F.broadcast(multi_budget(df, score, budgets, horizons)))  # one row
    return both.withColumn("passed", F.col("composite") > float("-inf"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) of each class that is actual or predicted."""
    per = confusion(df, label, predicted)
    actual = per.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("hits"))
    said = per.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    out = actual.join(said, "class", "full").fillna(0, ["support", "hits", "said"])
    out = out.withColumns({"precision": F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support")


def eval_detail(cells: DataFrame) -> DataFrame:
    """(fold, budget, horizon, measures of cell_scores) to one row a budget and horizon, averaged over folds."""
    names = ("score", "effective_n", "excess", "win_rate", "worst_decile", "knife_rate", "tail_mae", "entry_slippage")
    return cells.groupBy("budget", "horizon").agg(*[F.avg(n).alias(n) for n in names])


def random_entries(df: DataFrame, signal: str = "prediction", horizon: int = 10, simulations: int = 500, seed: int = 42) -> DataFrame:
    """One row: mean return of the collapsed signals against that of random bars of the same series.

    Each signal draws one bar a simulation, uniform over the bars that leave a full window; draws meet bars by
    (series, number), so no series is ever gathered. A draw is a hash of the signal, the simulation and the seed, so a
    task that runs again draws the same.
    """
    s = Series()
    bars = df.select("stock_id", "date", (s.number() - 1).alias("i"), (F.try_divide(s.lead("open", horizon + 1), s.lead("open")) - 1).alias("ret"), F.count("*").over(Window.partitionBy("stock_id")).alias("n"))
    flat = collapse(pat.ensure_events(df, s).where(F.col(signal) == 1).withColumn("weight", F.lit(1.0)))
    mine = flat.select("stock_id", "date").join(bars, ["stock_id", "date"]).where(F.col("ret").isNotNull() & (F.col("n") > horizon + 2))
    draws = mine.select("stock_id", "date", (F.col("n") - horizon - 2).alias("m"), F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("sim"))
    key = F.concat_ws("|", "stock_id", F.date_format("date", "yyyy-MM-dd"), F.col("sim").cast("string"), F.lit(str(seed)))
    number = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")
    draws = draws.withColumn("i", F.pmod(number, F.col("m")).cast("int"))
    sims = draws.join(bars.select("stock_id", "i", "ret"), ["stock_id", "i"]).groupBy("sim").agg(F.avg("ret").alias("mean"))
    one = sims.agg(F.avg("mean").alias("random_mean"), F.stddev_pop("mean").alias("random_std"), F.count("*").alias("n_simulations"))
    own = mine.agg(F.avg("ret").alias("signal_mean"), F.count("*").alias("n_signals"))
    out = own.crossJoin(F.broadcast(one)).withColumn("z", F.try_divide(F.col("signal_mean") - F.col("random_mean"), F.col("random_std")))  # one row
    # the upper tail of the normal distribution (Abramowitz and Stegun 7.1.26, error under 1.5e-7)
    x = F.abs(F.col("z")) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return out.withColumn("p_value", F.when(F.col("z") >= 0, tail).otherwise(1 - tail))


def importances(df: DataFrame) -> DataFrame:
    """(fold, model, feature, value) to each feature's mean and deviation of normalised shares, rank, running share."""
    per = df.groupBy("fold", "feature").agg(F.sum("value").alias("v"))
    share = F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("fold")))
    out = per.withColumn("share", share).groupBy("feature").agg(F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("std_share"))
    w = Window.orderBy(F.desc("mean_share"), "feature")
    return out.withColumns({"rank": F.row_number().over(w), "running_share": F.sum("mean_share").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def fold_summary(df: DataFrame, by: tuple[str, ...], values: Iterable[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return df.groupBy(*by).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def progress(results: DataFrame, score: str = "score", status: str = "status", order: str = "iter") -> DataFrame:
    """Results without crashes, with the best kept score so far."""
    kept = F.when(F.col(status) == "keep", F.col(score))
    return results.where(F.col(status) != "crash").withColumn("best", F.max(kept).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
