"""Events, barriers, labels, and sample weights. Events are rows (symbol, ts, and where they end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions.columns import DAY, W, micros, prev
from tickweave.operators.stats import daily_volatility


def _time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(micros("ts"))


def _later(n_days: int) -> WindowSpec:
    """Bars at least ``n_days`` later, from the last one back: a frame that only grows, so each bar enters it once."""
    return Window.partitionBy("symbol").orderBy((-micros("ts")).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, -n_days * DAY)


def inverse_cumsum_filter(df: DataFrame, out: str = "quiet", h: float = 0.01, n: int = 2, col: str = "close") -> DataFrame:
    """Whether the return over the last ``n`` bars is under ``h`` either way; false where unknown."""
    return df.withColumn(out, F.coalesce(F.abs(F.try_divide(F.col(col), prev(col, n)) - 1) < h, F.lit(False)))


def event_sampling(df: DataFrame, method: str, long: int = 100, short: int = 10, threshold: float = 2.0, col: str = "close") -> DataFrame:
    """Adds event_flag: the ratio of long to short volatility ("volatility_contraction"), or of short to long ("volatility_expansion"), is over the threshold."""
    if method not in ("volatility_contraction", "volatility_expansion"):
        raise ValueError(f"unknown method {method!r}")
    both = daily_volatility(daily_volatility(df, "_long", long, col), "_short", short, col)
    top, under = ("_long", "_short") if method == "volatility_contraction" else ("_short", "_long")
    return both.withColumn("event_flag", F.coalesce(F.try_divide(F.col(top), F.nullif(F.col(under), F.lit(0.0))) > threshold, F.lit(False))).drop("_long", "_short")


def flag_share(df: DataFrame, flag: str = "event_flag") -> DataFrame:
    return df.groupBy("symbol").agg(F.avg(F.col(flag).cast("int")).alias("share"))


def vertical_barrier(df: DataFrame, out: str = "vb", n_days: int = 1) -> DataFrame:
    """The first bar ``n_days`` calendar days later or after; null where there is none."""
    return df.withColumn(out, F.min("ts").over(_later(n_days)))


def barrier_hit(vb: str = "vb", pt: str = "pt", sl: str = "sl") -> Column:
    """Which barrier came first; the vertical one only where no other did."""
    p, s = F.col(pt), F.col(sl)
    return F.when(p.isNull() & s.isNull(), "vb").when(s.isNull() | (p <= s), "pt").otherwise("sl")


def triple_barrier(df: DataFrame, scale: bool = True, span: int = 10, pt_sl: float = 1.0, n_days: int = 2, events: DataFrame | None = None, col: str = "close") -> DataFrame:
    """Labels of events: the first of profit, loss and time barrier. Returns symbol, ts, hit_date, bin, returns.

    The target is the daily volatility (then a symbol's first ``n_days`` bars are left out), or 0.01; barriers are strictly over or under
    ``pt_sl`` times it. Only bars that are events make paths; without ``events``, all bars. A path holds the bars of ``n_days`` days, as a range
    window, so no join; it runs to the symbol's last bar where time ends first. bin is the sign of the return, 0 if time came first.
    """
    base = df.select("symbol", "ts", F.col(col).alias("price"))
    if scale:
        base = daily_volatility(base, "target", span, "price").withColumn("_row", F.row_number().over(W())).where(F.col("_row") > n_days).drop("_row")
    else:
        base = base.withColumn("target", F.lit(0.01))
    if events is not None:
        base = base.join(events.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_semi")
    base = vertical_barrier(base, "_vb", n_days).withColumn("vb", F.coalesce("_vb", F.max("ts").over(Window.partitionBy("symbol"))))
    # bars up to n_days later; the barrier itself may lie farther
    near = F.collect_list(F.struct("ts", "price")).over(_time().rangeBetween(0, n_days * DAY))
    far = F.min(F.struct("ts", "price")).over(_later(n_days))
    paths = base.withColumn("_far", far).withColumn("_path", F.when(F.col("_far").isNull(), near).otherwise(F.array_append(F.filter(near, lambda b: b["ts"] < F.col("_far.ts")), F.col("_far"))))
    ret = lambda b: F.try_divide(b["price"], F.col("price")) - 1
    low = F.get(F.filter("_path", lambda b: ret(b) < -pt_sl * F.col("target")), F.lit(0))["ts"]
    high = F.get(F.filter("_path", lambda b: ret(b) > pt_sl * F.col("target")), F.lit(0))["ts"]
    hit = paths.withColumn("sl", low).withColumn("pt", high).withColumn("hit_date", F.least("vb", "sl", "pt"))
    at = F.get(F.filter("_path", lambda b: b["ts"] == F.col("hit_date")), F.lit(0))["price"]
    done = hit.withColumn("returns", F.try_divide(at, F.col("price")) - 1).where("target is not null")
    return done.select("symbol", "ts", "hit_date", F.when(barrier_hit() == "vb", 0.0).otherwise(F.signum("returns")).alias("bin"), "returns")


def add_labels(df: DataFrame, method: str = "triple_barrier", only_flagged: bool = False, **options) -> DataFrame:
    """``df`` with hit_date, bin and returns. Event flags restrict events only with ``only_flagged``."""
    if method != "triple_barrier":
        raise ValueError(f"unknown method {method!r}")
    plain = df.drop("hit_date", "bin", "returns")
    events = plain.where("event_flag") if only_flagged else None
    return plain.join(triple_barrier(plain, events=events, **options), ["symbol", "ts"], "left")


def concurrency(bars: DataFrame, events: DataFrame, t_out: str = "hit_date") -> DataFrame:
    """How many events [ts, t_out] are open at each bar, from the first entry to the last exit. An open end is the last bar.

    A sweep: +1 at the entry, -1 after the exit, summed in order of time; bars take the sum at their own time. No event is joined to its bars.
    """
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last"), F.min("ts").alias("_first"))
    ends = events.select("symbol", "ts", F.col(t_out).alias("_out")).join(last, "symbol").withColumn("_out", F.coalesce("_out", "_last")).where("_out >= _first")
    marks = ends.select("symbol", F.explode(F.array(F.struct("ts", F.lit(0).alias("k"), F.lit(1).alias("d")), F.struct(F.col("_out").alias("ts"), F.lit(2).alias("k"), F.lit(-1).alias("d")))).alias("m")).select("symbol", "m.*")
    marks = marks.groupBy("symbol", "ts", "k").agg(F.sum("d").cast("long").alias("d"))
    line = bars.select("symbol", "ts", F.lit(1).alias("k"), F.lit(0).cast("long").alias("d")).unionByName(marks)
    # within a time: entries, then the bar, then exits
    w = Window.partitionBy("symbol").orderBy("ts", "k").rowsBetween(Window.unboundedPreceding, 0)
    swept = line.withColumn("n_open", F.sum("d").over(w))
    scope = ends.groupBy("symbol").agg(F.min("ts").alias("_from"), F.max("_out").alias("_to"))
    return swept.where("k = 1").join(scope, "symbol").where("ts between _from and _to").select("symbol", "ts", "n_open")


def _over_events(bars: DataFrame, events: DataFrame, value: Column, t_out: str) -> DataFrame:
    """Sum and number of ``value`` over the bars of each event, from running sums at its ends."""
    counts = concurrency(bars, events, t_out)
    w = W().rowsBetween(Window.unboundedPreceding, 0)
    line = bars.withColumn("_change", F.ln("close") - prev(F.ln("close"))).join(counts, ["symbol", "ts"], "left").withColumn("_v", F.coalesce(value, F.lit(0.0)))
    line = line.select("symbol", "ts", "_v", F.sum("_v").over(w).alias("_sum"), F.count("*").over(w).alias("_n"))
    ends = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    spans = events.select("symbol", "ts", F.col(t_out).alias("_out")).join(ends, "symbol").withColumn("_out", F.coalesce("_out", "_last"))
    low = line.select("symbol", "ts", (F.col("_sum") - F.col("_v")).alias("_s0"), (F.col("_n") - 1).alias("_n0"))
    high = line.select("symbol", F.col("ts").alias("_out"), F.col("_sum").alias("_s1"), F.col("_n").alias("_n1"))
    return spans.join(low, ["symbol", "ts"]).join(high, ["symbol", "_out"]).select("symbol", "ts", (F.col("_s1") - F.col("_s0")).alias("total"), (F.col("_n1") - F.col("_n0")).alias("bars"))


def average_uniqueness(bars: DataFrame, events: DataFrame, t_out: str = "hit_date") -> DataFrame:
    """Mean of one over the concurrency, over an event's bars."""
    return _over_events(bars, events, F.try_divide(F.lit(1.0), F.col("n_open")), t_out).select("symbol", "ts", F.try_divide(F.col("total"), F.col("bars")).alias("uniqueness"))


def sample_weights(bars: DataFrame, events: DataFrame, t_out: str = "hit_date") -> DataFrame:
    """Size of the sum of log returns over the concurrency, over an event's bars."""
    return _over_events(bars, events, F.try_divide(F.col("_change"), F.col("n_open")), t_out).select("symbol", "ts", F.abs("total").alias("sample_weight"))


def add_sample_weights(df: DataFrame) -> DataFrame:
    """``df`` with sample_weight, from its column hit_date; rows without hit_date end with the last bar."""
    if "hit_date" not in df.columns:
        raise ValueError("no column hit_date; add labels first")
    plain = df.drop("sample_weight")
    return plain.join(sample_weights(plain, plain.select("symbol", "ts", "hit_date")), ["symbol", "ts"], "left")
