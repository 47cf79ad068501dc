"""Fills, first-in first-out round trips of long and short books, and what is measured over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 32  # bars whose extremes are taken together when a trade's whole range is looked up
HORIZONS = (1, 2, 3, 5, 10, 20, 40)
NO_REASON = "(no reason given)"
TRADE = ["run_id", "symbol", "direction", "entry_seq", "exit_seq"]  # what tells trades apart


def nz(c: Column) -> Column:
    return F.when(c != 0, c)


def fills_of(books: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Fills that lead from each book to the next: run_id, symbol, seq, bar_date, shares (signed), price.

    ``books``: run_id, seq (1, 2, …), bar_date, symbol, shares (below 0: short), price; a symbol that is missing from a book is held no
    more and is closed at its last price. ``records``: run_id, seq, bar_date of all books, also of empty ones; without it the books that
    hold something. ``seq`` numbers the books of a run without gaps.
    """
    w = W.partitionBy("run_id", "symbol").orderBy("seq")
    b = books.groupBy("run_id", "seq", "bar_date", "symbol").agg(F.sum("shares").alias("shares"), F.max("price").alias("price"))
    every = (b if records is None else records).select("run_id", "seq", "bar_date").distinct()
    held = b.withColumns({"before": F.lag("shares").over(w), "before_seq": F.lag("seq").over(w), "next_seq": F.lead("seq").over(w)})
    unbroken = F.col("before_seq") == F.col("seq") - 1
    change = F.col("shares") - F.when(unbroken, F.col("before")).otherwise(0.0)
    changed = held.select("run_id", "symbol", "seq", "bar_date", change.alias("shares"), "price")
    gone = held.where("next_seq is null or next_seq > seq + 1").select("run_id", "symbol", (F.col("seq") + 1).alias("seq"), (-F.col("shares")).alias("shares"), "price")
    closed = gone.join(every, ["run_id", "seq"]).select("run_id", "symbol", "seq", "bar_date", "shares", "price")
    return changed.unionByName(closed).where("shares != 0")


def legs_of(fills: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Each fill as what it closes and what it opens: a fill that carries a position through zero does both.

    Columns: run_id, symbol, direction (1 long, -1 short), opens, seq, bar_date, price, unit_cost (of a share), shares (above 0), upto
    (shares opened or closed so far in this direction). Fills without shares or with a price of 0 or less are left out.
    """
    cost = F.coalesce(F.col("cost") / nz(F.abs("shares")), F.lit(0.0)) if "cost" in fills.columns else F.lit(0.0)
    f = fills.where("shares != 0 and price > 0").withColumn("unit_cost", cost)
    after = F.round(F.sum("shares").over(W.partitionBy("run_id", "symbol").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)), 6)
    f = f.withColumn("_after", after).withColumn("_before", F.coalesce(F.lag("_after").over(W.partitionBy("run_id", "symbol").orderBy("seq")), F.lit(0.0)))
    through = F.col("_before") * F.col("_after") < 0
    a, z = F.abs("_before"), F.abs("_after")
    leg = lambda side, opens, q: F.struct(F.signum(side).cast("int").alias("direction"), F.lit(opens).alias("opens"), q.alias("shares"))
    both = F.array(leg(F.col("_before"), False, F.when(through, a).otherwise(F.greatest(a - z, F.lit(0.0)))), leg(F.col("_after"), True, F.when(through, z).otherwise(F.greatest(z - a, F.lit(0.0)))))
    rows = f.select("run_id", "symbol", "seq", "bar_date", "price", "unit_cost", *carried, F.inline(both)).where("shares > 0")
    order = W.partitionBy("run_id", "symbol", "direction", "opens").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("upto", F.round(F.sum("shares").over(order), 6))


def round_trips(fills: DataFrame, carried: tuple[str, ...] = (), marks: DataFrame | None = None) -> DataFrame:
    """Match what closes to what was opened, first in, first out, for long and short positions.

    ``fills``: run_id, symbol, seq (order inside the run), bar_date, shares (signed), price and, if there, cost (commission and slippage of
    the fill). Result: run_id, symbol, direction (``long``, ``short``), entry and exit seq, day and price, shares, open, gross_pnl, costs (of
    both legs, by shares), net_pnl, ret (net over what was committed at entry), days_held. ``carried`` columns (as reason) are kept of both
    fills as entry_<name> and exit_<name>. What is left at the end is open; with ``marks`` (symbol, last_day, last) it is valued at
    the last price, else its results are null.

    In each direction openings and closings are laid end to end by cumulative shares. Every end of one is a cut; each piece between
    two cuts belongs to the opening and the closing that end at or after it, which are carried back from the later cuts. So n fills give
    at most 2n pieces, without joining openings with closings; all is keyed by run, symbol and direction.
    """
    f = legs_of(fills, carried)
    lot = lambda opens: F.when(F.col("opens") == F.lit(opens), F.struct("bar_date", "price", "seq", "unit_cost", *carried))
    book = ["run_id", "symbol", "direction"]
    cuts = f.groupBy(*book, "upto").agg(F.max(lot(True)).alias("b"), F.max(lot(False)).alias("s"))
    later = W.partitionBy(*book).orderBy("upto").rowsBetween(W.currentRow, W.unboundedFollowing)
    prior = F.coalesce(F.lag("upto").over(W.partitionBy(*book).orderBy("upto")), F.lit(0.0))
    pieces = cuts.select(*book, (F.col("upto") - prior).alias("shares"), F.first("b", ignorenulls=True).over(later).alias("b"), F.first("s", ignorenulls=True).over(later).alias("s"))
    side = lambda x, e: [F.col(f"{x}.{c}").alias(f"{e}_{n}") for c, n in (("bar_date", "day"), ("price", "price"), ("seq", "seq"), ("unit_cost", "unit_cost"), *((c, c) for c in carried))]
    t = pieces.where("b is not null").select(*book, "shares", *side("b", "entry"), *side("s", "exit"))
    # pieces of one opening and one closing belong together
    t = t.groupBy(*(c for c in t.columns if c != "shares")).agg(F.sum("shares").alias("shares")).withColumn("open", F.col("exit_day").isNull())
    if marks is not None:
        t = t.join(marks.select("symbol", "last_day", "last"), "symbol", "left").withColumn("exit_price", F.coalesce("exit_price", "last"))
        held = F.datediff(F.coalesce("exit_day", "last_day"), "entry_day")
    else:
        held = F.datediff("exit_day", "entry_day")
    gross = F.col("direction") * (F.col("exit_price") - F.col("entry_price")) * F.col("shares")
    costs = F.col("shares") * (F.col("entry_unit_cost") + F.coalesce("exit_unit_cost", F.lit(0.0)))
    t = t.withColumns({"gross_pnl": gross, "costs": costs, "days_held": F.greatest(held, F.lit(0))}).withColumn("net_pnl", F.col("gross_pnl") - F.col("costs"))
    t = t.withColumns({"ret": F.col("net_pnl") / nz(F.col("entry_price") * F.col("shares")), "direction": F.when(F.col("direction") > 0, "long").otherwise("short")})
    return t.drop("entry_unit_cost", "exit_unit_cost", "last_day", "last")


# -- trades and the bars they were open for ------------------------------------------------------------------------------------


def numbered_bars(bars: DataFrame) -> DataFrame:
    """Bars with ``no``, their place in their symbol's history, from 0."""
    return bars.withColumn("no", (F.row_number().over(W.partitionBy("symbol").orderBy("bar_date")) - 1).cast("long"))


def placed(trades: DataFrame, numbered: DataFrame) -> DataFrame:
    """Adds ``_a`` and ``_b``, the numbers of the first and last bar from entry to exit (to the last bar for open trades); null if there is none.

    Days are looked up in a table of every calendar day of a symbol, so trades meet bars by symbol and day: a symbol that all runs trade is
    spread over its days.
    """
    nxt = F.lead("bar_date").over(W.partitionBy("symbol").orderBy("bar_date"))
    ahead = numbered.select("symbol", "no", "bar_date", F.coalesce(F.date_sub(nxt, 1), F.col("bar_date")).alias("_until"))
    days = ahead.select("symbol", "no", "bar_date", F.explode(F.sequence("bar_date", "_until")).alias("_day"))
    days = days.select("symbol", "_day", F.col("no").alias("_upto"), F.when(F.col("_day") == F.col("bar_date"), F.col("no")).otherwise(F.col("no") + 1).alias("_from"))
    spans = numbered.groupBy("symbol").agg(F.min("bar_date").alias("_first"), F.max("bar_date").alias("_last"))
    t = trades.join(spans, "symbol", "left").withColumns({"_in": F.greatest("entry_day", "_first"), "_out": F.least(F.coalesce("exit_day", "_last"), "_last")})
    t = t.join(days.select("symbol", F.col("_day").alias("_in"), F.col("_from").alias("_a")), ["symbol", "_in"], "left").join(days.select("symbol", F.col("_day").alias("_out"), F.col("_upto").alias("_b")), ["symbol", "_out"], "left")
    some = F.col("_a") <= F.col("_b")
    return t.withColumns({"_a": F.when(some, F.col("_a")), "_b": F.when(some, F.col("_b"))}).drop("_in", "_out", "_first", "_last").select(*trades.columns, "_a", "_b")


def enriched(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds bars_held and the worst and best a trade looked inside the bars: mae_pct (0 or less), mfe_pct (0 or more) of the entry price, mae and mfe in money.

    ``bars``: symbol, bar_date and adjusted h, l. Extremes are looked up by blocks of BLOCK bars and single bars at both ends, so a trade of n
    bars meets n / BLOCK + 2 BLOCK rows, by an equi-join on symbol and place. Without bars: 0 bars and excursions of 0.
    """
    n = numbered_bars(bars.select("symbol", "bar_date", "h", "l"))
    t = placed(trades, n).withColumns({"_lo": F.ceil(F.col("_a") / BLOCK).cast("long"), "_hi": F.floor((F.col("_b") + 1) / BLOCK).cast("long")})
    run = lambda level, a, z: F.when(a <= z, F.transform(F.sequence(a, z), lambda x: F.struct(F.lit(level).alias("_level"), x.alias("_place")))).otherwise(F.array().cast("array<struct<_level:int,_place:bigint>>"))
    a, b, lo, hi = (F.col(c) for c in ("_a", "_b", "_lo", "_hi"))
    wide = lo < hi
    looks = F.when(wide, F.concat(run(0, a, lo * BLOCK - 1), run(1, lo, hi - 1), run(0, hi * BLOCK, b))).when(a.isNotNull(), run(0, a, b))
    extremes = n.select("symbol", F.lit(0).alias("_level"), F.col("no").alias("_place"), "l", "h").unionByName(n.groupBy("symbol", F.floor(F.col("no") / BLOCK).alias("_place")).agg(F.min(F.when(F.col("l") > 0, F.col("l"))).alias("l"), F.max("h").alias("h")).select("symbol", F.lit(1).alias("_level"), "_place", "l", "h"))
    j = t.select(*trades.columns, (b - a + 1).alias("bars_held"), F.explode_outer(looks).alias("_x")).select("*", "_x.*").drop("_x").join(extremes, ["symbol", "_level", "_place"], "left")
    g = j.groupBy(*trades.columns, "bars_held").agg(F.min(F.when((F.col("l") > 0) & (F.col("h") > 0), F.col("l"))).alias("_l"), F.max(F.when((F.col("l") > 0) & (F.col("h") > 0), F.col("h"))).alias("_h"))
    long = F.col("direction") == "long"
    low, high = F.col("_l") / nz(F.col("entry_price")) - 1, F.col("_h") / nz(F.col("entry_price")) - 1
    zero = F.lit(0.0)
    g = g.withColumns({"bars_held": F.coalesce("bars_held", F.lit(0).cast("long")), "mae_pct": F.coalesce(F.least(zero, F.when(long, low).otherwise(-high)), zero), "mfe_pct": F.coalesce(F.greatest(zero, F.when(long, high).otherwise(-low)), zero)})
    return g.withColumns({"mae": F.col("mae_pct") * F.col("entry_price") * F.col("shares"), "mfe": F.col("mfe_pct") * F.col("entry_price") * F.col("shares")}).drop("_l", "_h")


def decay(trades: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """What closed trades had gained so many bars after their entry: run_id, horizon, mean_return, still_open, trades, exit_return, mean_bars.

    Gains are before costs, from the entry price, with the sign of the direction, over the bars from entry to exit; after its exit a trade keeps
    what it ended with. ``still_open`` counts the trades that were held that long. Trades with fewer than two bars say nothing.
    ``bars``: symbol, bar_date and adjusted c.
    """
    n = numbered_bars(bars.select("symbol", "bar_date", "c"))
    t = placed(trades.where("not open and entry_price > 0"), n).where("_b > _a")
    steps = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.least(F.col("_a") + h, F.col("_b")).alias("no"), (F.col("_a") + h <= F.col("_b")).alias("held")) for h in horizons), F.struct(F.lit(0).cast("long").alias("horizon"), F.col("_b").alias("no"), F.lit(True).alias("held")))
    at = t.select(*TRADE, "entry_price", (F.col("_b") - F.col("_a") + 1).alias("bars"), F.inline(steps)).join(n.select("symbol", "no", "c"), ["symbol", "no"])
    at = at.withColumn("v", F.when(F.col("c") > 0, F.when(F.col("direction") == "long", 1).otherwise(-1) * (F.col("c") / F.col("entry_price") - 1)))
    final = F.max(F.when(F.col("horizon") == 0, F.col("v"))).over(W.partitionBy(*TRADE))
    at = at.withColumn("final", final).where("final is not null and horizon > 0")
    return at.groupBy("run_id", "horizon").agg(F.avg(F.coalesce("v", "final")).alias("mean_return"), F.sum(F.col("held").cast("long")).alias("still_open"), F.count("*").alias("trades"), F.avg("final").alias("exit_return"), F.avg("bars").alias("mean_bars"))


def decay_summary(points: DataFrame, floor: float = 0.01) -> DataFrame:
    """Per run: where the mean trade was best, whether it still rose at the last horizon inside the mean holding time, and the share of the peak that
    the exit gave back (null for a peak under ``floor`` or at the last horizon)."""
    w = W.partitionBy("run_id").orderBy("horizon")
    p = points.withColumns({"before": F.lag("mean_return").over(w), "inside": F.col("horizon") <= F.col("mean_bars") - 1})
    g = p.groupBy("run_id").agg(
        F.first("trades").alias("trades"), F.first("exit_return").alias("exit_return"), F.first("mean_bars").alias("mean_bars"), F.max("horizon").alias("_end"), F.max("mean_return").alias("peak_return"),
        F.max(F.struct("mean_return", (-F.col("horizon")).alias("h"))).alias("_peak"), F.max_by(F.struct("mean_return", "before"), F.when(F.col("inside"), F.col("horizon"))).alias("_last"),
    )
    peak = -F.col("_peak.h")
    back = F.when((F.col("peak_return") >= floor) & (peak < F.col("_end")), (F.col("peak_return") - F.col("exit_return")) / F.col("peak_return"))
    rising = F.coalesce(F.col("_last.mean_return") >= F.col("_last.before"), F.lit(True))
    return g.select("run_id", "trades", peak.alias("peak_bars"), "peak_return", "exit_return", "mean_bars", rising.alias("still_rising"), back.alias("given_back"))


# -- aggregates over trades ------------------------------------------------------------------------------------------------------


def trade_stats(trades: DataFrame) -> DataFrame:
    """Per run over its closed trades (open ones are only counted): wins and losses (a trade that gains nothing is a loss), means in shares of the
    capital and in money, payoff, expectancy, profit factor (infinite without losses), best and worst, holding times (the upper median),
    excursions, edge ratio, give-back of losers that had been 1 % in front (each at most 2), and the longest winning and losing streak. One pass
    over the trades.

    ``trades``: of :func:`enriched`.
    """
    won, lost = ~F.col("open") & (F.col("net_pnl") > 0), ~F.col("open") & (F.col("net_pnl") <= 0)
    side = W.partitionBy("run_id", "open")
    t = trades.withColumns({"k": F.row_number().over(side.orderBy("bars_held", *TRADE[1:])), "n": F.count("*").over(side), "_won": won.cast("int"), "_no": F.row_number().over(side.orderBy(*EXITS))})
    t = t.withColumn("_island", F.col("_no") - F.row_number().over(W.partitionBy("run_id", "open", "_won").orderBy("_no")))
    t = t.withColumn("_streak", F.count("*").over(W.partitionBy("run_id", "open", "_won", "_island")))
    closed = ~F.col("open")
    if_ = lambda c, x: F.when(c, x if isinstance(x, Column) else F.col(x))
    of = lambda x: if_(closed, x)
    up, down = F.sum(if_(won, "net_pnl")), F.sum(if_(lost, -F.col("net_pnl")))
    gave = lost & (F.col("mfe_pct") >= 0.01)
    mae, count = F.avg(of("mae_pct")), F.count(of("net_pnl"))
    longest = lambda c: F.coalesce(F.max(if_(c, "_streak")), F.lit(0)).cast("long")
    g = t.groupBy("run_id").agg(
        F.count(F.when(F.col("open"), 1)).alias("open"), count.alias("closed"), F.count(if_(won, "net_pnl")).alias("wins"), F.count(if_(lost, "net_pnl")).alias("losses"), (F.count(if_(won, "net_pnl")) / nz(count)).alias("win_rate"),
        F.avg(if_(won, "ret")).alias("mean_win_pct"), F.avg(if_(lost, "ret")).alias("mean_loss_pct"), F.avg(if_(won, "net_pnl")).alias("mean_win"), F.avg(if_(lost, -F.col("net_pnl"))).alias("mean_loss"),
        F.avg(of("net_pnl")).alias("expectancy"), F.avg(of("ret")).alias("expectancy_pct"), F.when(down > 0, F.coalesce(up, F.lit(0.0)) / nz(down)).when(up > 0, F.lit(float("inf"))).alias("profit_factor"),
        F.max(of("ret")).alias("best"), F.min(of("ret")).alias("worst"), F.max(if_(won, "net_pnl")).alias("largest_win"), F.min(if_(lost, "net_pnl")).alias("largest_loss"),
        F.avg(of("bars_held")).alias("mean_bars"), F.max(if_(closed & (F.col("k") == F.floor(F.col("n") / 2) + 1), "bars_held")).alias("median_bars"), F.max(of("bars_held")).alias("most_bars"), F.avg(of("days_held")).alias("mean_days"),
        mae.alias("mean_mae"), F.avg(of("mfe_pct")).alias("mean_mfe"), (F.avg(of("mfe_pct")) / nz(F.abs(mae))).alias("edge_ratio"), F.avg(if_(won, "mae_pct")).alias("winner_mae"),
        F.avg(if_(gave, F.least(F.lit(2.0), (F.col("mfe_pct") - F.col("ret")) / nz(F.col("mfe_pct"))))).alias("give_back"), F.count(if_(gave, F.lit(1))).alias("give_back_trades"), F.sum(of("net_pnl")).alias("net_pnl"), F.sum(of("costs")).alias("costs"),
        longest(won).alias("longest_wins"), longest(lost).alias("longest_losses"),
    )
    return g.withColumn("payoff", F.when(F.col("mean_loss") > 0, F.coalesce("mean_win", F.lit(0.0)) / nz(F.col("mean_loss"))))


EXITS = ["entry_day", "symbol", "exit_seq", "entry_seq", "direction"]  # the order in which trades follow each other


def streaks(trades: DataFrame) -> DataFrame:
    """Longest runs of winning and of losing closed trades, in order of entry day, symbol and exit."""
    t = trades.where("not open").withColumn("won", (F.col("net_pnl") > 0).cast("int")).withColumn("no", F.row_number().over(W.partitionBy("run_id").orderBy(*EXITS)))
    same = W.partitionBy("run_id", "won").orderBy("no")
    runs = t.withColumn("island", F.col("no") - F.row_number().over(same)).groupBy("run_id", "won", "island").count()
    longest = lambda v: F.coalesce(F.max(F.when(F.col("won") == v, F.col("count"))), F.lit(0)).cast("long")
    return runs.groupBy("run_id").agg(longest(1).alias("longest_wins"), longest(0).alias("longest_losses"))


def by_symbol(trades: DataFrame) -> DataFrame:
    """Net result per run and symbol and its share of the sum of absolute results, closed trades, wins."""
    g = trades.where("not open").groupBy("run_id", "symbol").agg(F.sum("net_pnl").alias("net"), F.count("*").alias("trades"), F.count(F.when(F.col("net_pnl") > 0, 1)).alias("wins"))
    whole = F.sum(F.abs("net")).over(W.partitionBy("run_id"))
    return g.withColumn("contribution", F.col("net") / F.when(whole != 0, whole))


def in_range(trades: DataFrame, first: Column, last: Column) -> DataFrame:
    """The trades whose exit (of open ones: whose entry) lies from ``first`` to ``last``, both included."""
    at = F.coalesce("exit_day", "entry_day")
    return trades.where((at >= first) & (at <= last))


def by_reason(trades: DataFrame, column: str, numberless: bool = False) -> DataFrame:
    """Closed trades by the reason they were opened or closed for (``column``: entry_reason or exit_reason), per run.

    White space is made one, ``numberless`` makes every number ``N``; reasons are compared without case and shown as first spelt; none
    is NO_REASON. Columns: reason, trades, wins, net, mean, win_rate, mean_days, mean_bars, mean_mae, mean_mfe, share (of the absolute value
    of the run's total). The sums over reasons are the run's total, for entries as for exits. ``trades``: of :func:`enriched`.
    """
    from barloom.functions import text

    shown = text.tidy(F.coalesce(F.col(column), F.lit("")))
    if numberless:
        shown = text.numberless(shown)
    t = trades.where("not open").withColumn("_shown", F.when(shown == "", NO_REASON).otherwise(shown)).withColumn("_key", F.lower("_shown"))
    first = F.struct("entry_day", "symbol", "exit_seq", "entry_seq", "_shown")
    g = t.groupBy("run_id", "_key").agg(
        F.min_by("_shown", first).alias("reason"), F.count("*").alias("trades"), F.count(F.when(F.col("net_pnl") > 0, 1)).alias("wins"), F.sum("net_pnl").alias("net"), F.avg("net_pnl").alias("mean"),
        F.avg("days_held").alias("mean_days"), F.avg("bars_held").alias("mean_bars"), F.avg("mae_pct").alias("mean_mae"), F.avg("mfe_pct").alias("mean_mfe"),
    )
    whole = F.abs(F.sum("net").over(W.partitionBy("run_id")))
    return g.withColumns({"win_rate": F.col("wins") / F.col("trades"), "share": F.col("net") / F.when(whole != 0, whole)}).drop("_key")


def both_reasons(trades: DataFrame) -> DataFrame:
    """By entry and by exit (side), verbatim and without numbers (grouping), and which grouping to show: without numbers where that makes at most half of eight or more rows."""
    rows = None
    for side in ("entry", "exit"):
        for name, less in (("verbatim", False), ("numberless", True)):
            part = by_reason(trades, f"{side}_reason", less).select("run_id", F.lit(side).alias("side"), F.lit(name).alias("grouping"), "reason", "trades", "wins", "net", "share")
            rows = part if rows is None else rows.unionByName(part)
    w = W.partitionBy("run_id")
    n = lambda g: F.sum(F.when(F.col("grouping") == g, 1).otherwise(0)).over(w)
    return rows.withColumn("preferred", F.when((n("verbatim") >= 8) & (n("numberless") * 2 <= n("verbatim")), "numberless").otherwise("verbatim"))


def head_and_tail(rows: DataFrame, by: str, value: str, n: int, tie: str) -> DataFrame:
    """Both ends of a table ranked by value: the first n // 2 and the last n - n // 2 rows of each ``by``, with their place and how many rows there are."""
    r = rows.withColumns({"place": F.row_number().over(W.partitionBy(by).orderBy(F.desc(value), tie)).cast("long"), "rows": F.count("*").over(W.partitionBy(by))})
    return r.where((F.col("rows") <= n) | (F.col("place") <= n // 2) | (F.col("place") > F.col("rows") - (n - n // 2)))
