"""Column profiles per load, with character-class masks of the values and their distribution held against other loads.

Masks generalise a value: digits become 9, lower-case letters a, upper-case letters A, other letters @; in long texts a run
of one class is written once. Numbers have the mask of their sign, their digits before the point and whether any follow it,
and beside it a band: how many of the column's usual quantiles they exceed. Missing values are a class of their own.

Wide aggregates per load give counts, ranges, moments and quantile sketches without unpivoting anything; distinct sketches
and the counts of (load, column, mask, band) follow in narrow passes with partial aggregation, so a load that holds a third
of the rows arrives as a few small rows per task.

A load's distribution over masks and bands is held against that of the other loads by Jensen-Shannon divergence (base 2, 0
to 1); missing shares, zeros, signs, ranges, levels, spreads, values that recur and text forms all move it, so the
divergence alone says which loads broke a column. Masks that are rare in the column are counted as violations.

Errors: quantiles are sketches of accuracy 2,000 (rank error 1/2,000), distinct counts have a standard error of 2 %; all
other figures are exact.

Defined results: null, NaN and infinite numbers are missing; null strings are missing, empty strings have the empty mask;
a null load is a load of its own; an empty table gives an empty profile; columns absent from the table are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygrain.functions.exprs import finite
from skygrain.sources.scratch import written

#: A mask with a smaller share of its column's values is rare.
RARE_SHARE = 0.005
MISSING_MASK = "<missing>"
MASK_CHARS = 64
#: Quantiles of the profile, whose usual values part a column's numbers into bands.
BANDS = (0.05, 0.25, 0.5, 0.75, 0.95)


def mask(text: Column) -> Column:
    """Character-class mask: 9, a, A, @ for other letters; beyond MASK_CHARS a run of one class is written once."""
    m = F.regexp_replace(text, r"[0-9]", "9")
    m = F.regexp_replace(m, r"[a-z]", "a")
    m = F.regexp_replace(m, r"[A-Z]", "A")
    m = F.regexp_replace(m, r"[\p{L}&&[^aA]]", "@")
    return F.when(F.length(m) <= MASK_CHARS, m).otherwise(F.regexp_replace(m, r"([9aA@])\1+", "$1+"))


def _form(x: Column) -> Column:
    """A number's mask as a whole number: (digits before the point, whether any follow, sign); -1 for null."""
    whole = F.floor(F.abs(x))
    digits = F.when(whole < 1, F.lit(0)).otherwise(F.floor(F.log10(whole) + F.lit(1e-12)) + 1).cast("int")
    more = (whole * F.signum(x) != x).cast("int")
    return F.when(x.isNull(), F.lit(-1)).otherwise((digits * 2 + more) * 3 + F.signum(x).cast("int") + 1)


def _form_text(form: Column) -> Column:
    sign, more, digits = form % 3 - 1, F.floor(form / 3) % 2, F.floor(form / 6).cast("int")
    whole = F.when((digits == 0) & (more == 0), "zero").when(digits == 0, "0").otherwise(F.repeat(F.lit("9"), digits))
    return F.when(form >= 0, F.concat(F.when(sign < 0, "-").otherwise(""), whole, F.when(more == 1, ".9").otherwise("")))


def number_mask(x: Column) -> Column:
    """Mask of a number's form: its sign, the digits before the point, and whether any follow it."""
    return _form_text(_form(x))


def _number(c: str) -> Column:
    return F.when(finite(F.col(c)), F.col(c).cast("double"))


def figures(df: DataFrame, load: str, numeric: list[str], text: list[str] = ()) -> DataFrame:
    """One row per load and column: counts, range, moments, quantiles q and distinct values.

    Counts and moments, quantile sketches and distinct sketches are aggregates of their own: each kind runs fastest alone,
    and a scan of the columns costs less than what they lose together.
    """
    columns = [*numeric, *text]
    df = df.select(F.col(load).alias("load_id"), *[(_number(c) if c in numeric else F.col(c)).alias(f"_v{i}") for i, c in enumerate(columns)])
    no = F.lit(None).cast("double")
    plain, sketches = [], []
    for i, c in enumerate(columns):
        here = F.col(f"_v{i}")
        x = here if c in numeric else no
        plain.append([F.count(here), F.count_if(x == 0), F.count_if(x < 0), F.count_if(x > 0), F.min(x), F.max(x), F.avg(x), F.stddev_samp(x)])
        if c in numeric:
            sketches.append(F.percentile_approx(x, F.array(*map(F.lit, BANDS)), 2000).alias(f"_q{i}"))
    names = ["n_here", "n_zero", "n_negative", "n_positive", "min", "max", "mean", "std"]
    wide = df.groupBy("load_id").agg(F.count("*").alias("n"), *[f.alias(f"_{n}{i}") for i, p in enumerate(plain) for n, f in zip(names, p)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("i"), *[F.col(f"_{n}{i}").alias(n) for n in names]) for i, c in enumerate(columns)]
    out = wide.select("load_id", "n", F.explode(F.array(*rows)).alias("p")).select("load_id", "n", "p.*")
    if sketches:
        q = df.groupBy("load_id").agg(*sketches)
        kept = [F.struct(F.lit(i).alias("i"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(columns) if c in numeric]
        q = q.select("load_id", F.explode(F.array(*kept)).alias("p")).select("load_id", "p.*")
        out = out.join(q, out.load_id.eqNullSafe(q.load_id) & (out.i == q.i), "left").select(out["*"], "q")
    else:
        out = out.withColumn("q", F.lit(None).cast("array<double>"))
    hashes = [F.struct(F.lit(i).alias("i"), F.xxhash64(f"_v{i}").alias("h"), F.col(f"_v{i}").isNotNull().alias("here")) for i in range(len(columns))]
    d = df.select("load_id", F.explode(F.array(*hashes)).alias("p")).select("load_id", "p.i", F.when(F.col("p.here"), F.col("p.h")).alias("h"))
    d = d.groupBy("load_id", "i").agg(F.approx_count_distinct("h", 0.02).alias("n_distinct"))
    return out.join(d, out.load_id.eqNullSafe(d.load_id) & (out.i == d.i), "left").select(out["*"], "n_distinct").drop("i")


def usual_cuts(fig: DataFrame) -> dict[str, list[float]]:
    """Per numeric column the median over the loads of each quantile: a few numbers a column."""
    mid = fig.filter("q is not null").groupBy("column_name").agg(*[F.median(F.col("q")[i]).alias(f"c{i}") for i in range(len(BANDS))])
    return {r["column_name"]: sorted({r[f"c{i}"] for i in range(len(BANDS))}) for r in mid.collect()}


def by_mask(df: DataFrame, load: str, numeric: list[str], text: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    """(load_id, column_name, mask, band, n), missing values under MISSING_MASK."""
    out, at = None, F.col(load).alias("load_id")
    if numeric:
        # Form and band follow from a number after the columns became rows: their expressions stay small.
        marks = lambda c: [F.lit(k).alias(f"k{i}") for i, k in enumerate((cuts.get(c, []) + [float("inf")] * len(BANDS))[: len(BANDS)])]
        flat = df.select(at, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _number(c).alias("x"), *marks(c)) for c in numeric])).alias("p")).select("load_id", "p.*")
        band = sum((F.coalesce((F.col("x") > F.col(f"k{i}")).cast("int"), F.lit(0)) for i in range(len(BANDS))), F.lit(0))
        n = flat.select("load_id", "column_name", _form(F.col("x")).alias("form"), band.alias("band")).groupBy("load_id", "column_name", "form", "band").agg(F.count("*").alias("n"))
        out = n.select("load_id", "column_name", F.coalesce(_form_text(F.col("form")), F.lit(MISSING_MASK)).alias("mask"), "band", "n")
    if text:
        parts = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("s")) for c in text]
        flat = df.select(at, F.explode(F.array(*parts)).alias("p")).select("load_id", "p.column_name", F.coalesce(mask(F.col("p.s")), F.lit(MISSING_MASK)).alias("mask"))
        n = flat.groupBy("load_id", "column_name", "mask").agg(F.count("*").alias("n")).select("load_id", "column_name", "mask", F.lit(0).alias("band"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a.load_id.eqNullSafe(b.load_id) & (a.column_name == b.column_name)


def profile(df: DataFrame, load: str, numeric: list[str], text: list[str] = ()) -> DataFrame:
    """One row per load and column: counts, rates, range, moments, quantiles, distinct values, masks and their divergence."""
    numeric, text = list(numeric), list(text)
    fig = written(figures(df, load, numeric, text), "figures")
    forms = mask_divergence(written(by_mask(df, load, numeric, text, usual_cuts(fig)), "masks"))
    out = fig.join(forms, _same(fig, forms), "left").select(fig["*"], "n_classes", "n_masks", "n_rare", "divergence", "dominant_mask")
    n = F.col("n_here")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return out.select(
        "load_id", "column_name", F.col("n").alias("n_rows"), (F.col("n") - n).alias("n_missing"), (1 - n / F.col("n")).alias("missing_rate"), n.alias("n_non_missing"), "n_zero",
        ratio(F.col("n_zero"), n).alias("zero_rate_non_missing"), "n_negative", "n_positive", "min", "max", "mean", "std", "q", "n_distinct", "n_classes",
        F.coalesce("n_masks", F.lit(0)).alias("n_masks"), ratio(F.coalesce("n_rare", F.lit(0)), F.col("n")).alias("rare_rate"), "divergence", "dominant_mask",
    )


def mask_divergence(masks: DataFrame) -> DataFrame:
    """Per load and column: divergence from the other loads together over masks and bands, masks, rows of rare masks, dominant mask."""
    if "band" not in masks.columns:
        masks = masks.withColumn("band", F.lit(0))
    load, column, kind = Window.partitionBy("load_id", "column_name"), Window.partitionBy("column_name"), ["column_name", "mask", "band"]
    # Classes of one column over all loads: as many rows as classes, joined back to the loads' own.
    overall = masks.groupBy(*kind).agg(F.sum("n").alias("all_n")).withColumn("all_total", F.sum("all_n").over(column))
    per = masks.withColumn("total", F.sum("n").over(load)).join(overall, kind)
    p, rest = F.col("n") / F.col("total"), F.col("all_total") - F.col("total")
    per = per.withColumns({"p": p, "q": F.coalesce(F.when(rest > 0, (F.col("all_n") - F.col("n")) / rest), p)}).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log2(F.col(a) / F.col("m"))).otherwise(0.0)
    # Classes that only other loads have add half their share each: 1 less the shares q that are met here.
    both = (F.sum(part("p")) + F.sum(part("q")) + (1 - F.sum("q"))) / 2
    far = per.groupBy("load_id", "column_name").agg(F.count("*").alias("n_classes"), F.greatest(F.lit(0.0), both).alias("divergence"))
    own = masks.filter(F.col("mask") != MISSING_MASK).groupBy("load_id", "column_name", "mask").agg(F.sum("n").alias("n"))
    known = own.join(_rare(own), ["column_name", "mask"], "left")
    forms = known.groupBy("load_id", "column_name").agg(
        F.count("*").alias("n_masks"), F.sum(F.when(F.col("column_share").isNotNull(), F.col("n")).otherwise(0)).alias("n_rare"), F.max_by("mask", F.struct("n", "mask")).alias("dominant_mask")
    )
    return far.join(forms, _same(far, forms), "left").select(far["*"], "n_masks", "n_rare", "dominant_mask")


def _rare(own: DataFrame) -> DataFrame:
    """(column_name, mask, column_share) of the masks that are rare in their column."""
    overall = own.groupBy("column_name", "mask").agg(F.sum("n").alias("all_n"))
    return overall.withColumn("column_share", F.col("all_n") / F.sum("all_n").over(Window.partitionBy("column_name"))).filter(F.col("column_share") < RARE_SHARE).drop("all_n")


def mask_violations(df: DataFrame, load: str, numeric: list[str], text: list[str] = ()) -> DataFrame:
    """Rare masks of each column with the loads that hold them (load_id, column_name, mask, n, column_share)."""
    per = written(by_mask(df, load, list(numeric), list(text), {}).filter(F.col("mask") != MISSING_MASK).drop("band"), "masks")
    return per.join(_rare(per), ["column_name", "mask"]).select("load_id", "column_name", "mask", "n", "column_share")


#: A load breaks a column if the divergence of its masks lies farther from the column's median than this, than `times`
#: typical deviations, and than what a sample of its size may show: about a quarter of its classes over its rows.
LEAST_DIVERGENCE = 0.015
#: Figures that say in what a broken column is off: the least distance from the column's median that counts.
SHARES = {"missing_rate": 0.05, "zero_share": 0.05, "negative_share": 0.05, "rare_rate": 0.02}


def shifts(profiles: DataFrame, times: float = 6.0) -> DataFrame:
    """Loads whose column lies far outside what it shows in the other loads (load_id, column_name, divergence, signals).

    The divergence of masks decides; `signals` names the figures that are off, `text_form` where none of them is.
    """
    share = lambda c: F.coalesce(F.col(c) / F.when(F.col("n_non_missing") > 0, F.col("n_non_missing")), F.lit(0.0))
    p = profiles.withColumns(
        {
            "zero_share": share("n_zero"), "negative_share": share("n_negative"), "rare_rate": F.coalesce("rare_rate", F.lit(0.0)), "divergence": F.coalesce("divergence", F.lit(0.0)),
            "distinct": share("n_distinct"), "level": F.col("q")[2], "spread": F.col("std"), "range": F.col("max") - F.col("min"),
        }
    )
    signals = ["divergence", *SHARES, "distinct", "level", "spread", "range"]
    one = Window.partitionBy("column_name")
    # One row per load and column: the window is as long as there are loads.
    p = p.withColumns({f"{s}_mid": F.median(s).over(one) for s in signals})
    p = p.withColumns({f"{s}_off": F.abs(F.col(s) - F.col(f"{s}_mid")) for s in signals})
    p = p.withColumn("typical", F.median("divergence_off").over(one))
    least = F.greatest(F.lit(LEAST_DIVERGENCE), F.col("n_classes") / (4 * F.col("n_rows")), F.lit(times) * F.col("typical"))
    broken = p.filter(F.col("divergence_off") > least)
    tests = {s: F.col(f"{s}_off") > k for s, k in SHARES.items()}
    tests |= {"distinct": F.col("distinct_off") > 0.2 * F.greatest(F.lit(0.05), F.col("distinct_mid")), "level": F.col("level_off") > 0.3 * F.col("spread_mid")}
    tests |= {"spread": F.col("spread_off") > 0.3 * F.col("spread_mid"), "range": F.col("range_off") > F.col("range_mid")}
    hits = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]))
    return broken.select("load_id", "column_name", "divergence", F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("text_form"))).alias("signals"))


def wrong_reports(profiles: DataFrame, reports: DataFrame, load: str, column: str, tolerance: float = 0.001) -> DataFrame:
    """Loads and columns with a reported missing_rate, zero_rate_non_missing or n_negative that the rows don't bear out.

    A null report is no case; a report of a load or column without rows can't be judged and is none either.
    """
    r = reports.select(F.col(load).alias("load_id"), F.col(column).alias("column_name"), F.col("missing_rate").alias("r_missing"), F.col("zero_rate_non_missing").alias("r_zero"), F.col("n_negative").alias("r_negative"))
    both = r.join(profiles.select("load_id", "column_name", "missing_rate", "zero_rate_non_missing", "n_negative"), ["load_id", "column_name"])
    # The figures are decimals of six digits; the margin is below that.
    off = lambda a, b: finite(F.col(a)) & (F.abs(F.col(a) - F.coalesce(F.col(b), F.lit(0.0))) > tolerance + 1e-9)
    wrong = off("r_missing", "missing_rate") | off("r_zero", "zero_rate_non_missing") | F.coalesce(F.col("r_negative") != F.col("n_negative"), F.lit(False))
    return both.filter(wrong).select("load_id", "column_name").distinct()
