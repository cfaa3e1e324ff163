"""Giving and promotion summaries, RFA status, RFM cells and segment
aggregates (A11-A16, A22, A23, E11-E13, W7-W9).

Per-member statistics are one ``groupBy(member)`` with conditional
aggregates (partial aggregation map-side, so a member with a third of all
gifts is combined before the shuffle).  Orderings over all members use the
distributed exact positions of ``ordering``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlift.functions import codes as fx
from donorlift.functions.money import cents, from_cents, mean_from_cents
from donorlift.operators.ordering import exact_quantiles, ntile_of, with_positions

# ---- fixed values of the RFA code (reference data dictionary), amounts
# scaled by 16,000 for the stand-in money unit ---------------------------------
# Amount of the last gift: A < 2, B < 3, C < 5, D < 10, E < 15, F < 25, G >= 25 $
RFA_AMOUNT_EDGES = [2.0, 3.0, 5.0, 10.0, 15.0, 25.0]
RFA_AMOUNT_CODES = ["A", "B", "C", "D", "E", "F", "G"]
# Recency classes: F first-time, N new, A active, L lapsing, I inactive, S star
CARD_EVERY = 3  # stand-in rule: campaigns i with i % 3 = 0 are card mailings
# -----------------------------------------------------------------------------



def amount_band(amount: Column, scale: float) -> Column:
    """Third RFA byte: band of the last gift amount."""
    expr = F.lit(RFA_AMOUNT_CODES[-1])
    for edge, code in reversed(list(zip(RFA_AMOUNT_EDGES, RFA_AMOUNT_CODES[:-1]))):
        expr = F.when(amount < F.lit(edge * scale), F.lit(code)).otherwise(expr)
    return F.when(amount.isNotNull(), expr)


def giving_summary(gifts: DataFrame, ref, key: str = "member_id") -> DataFrame:
    """A22 + W8: lifetime total, count, card-gift count, smallest / largest /
    last gift with dates, first and second gift dates, months between them
    and mean gift, per member."""
    ref_idx = fx.month_index(F.lit(ref))
    g = gifts.withColumn(
        "_back", ref_idx - fx.month_index(F.col("gift_date"))
    ).withColumn("_i", F.ceil(F.col("_back") / 3).cast("int") + 2)
    card = (F.col("_i") <= 24) & (F.col("_i") % CARD_EVERY == 0)
    s = g.groupBy(key).agg(
        F.sum(cents(F.col("amount"))).alias("_cents"),
        F.count(F.lit(1)).alias("ngiftall"),
        F.count_if(card).alias("cardgift"),
        F.min(F.struct("amount", "gift_date", "gift_id")).alias("_min"),
        F.min(F.struct((-F.col("amount")).alias("na"), "gift_date", "gift_id")).alias("_max"),
        F.max(F.struct("gift_date", "gift_id", "amount")).alias("_last"),
        F.min(F.struct("gift_date", "gift_id")).alias("_first"),
    )
    # second gift: Spark keeps the two first rows of a key in every map task
    # before the shuffle (window group limit), so a member with a third of all
    # gifts sends two rows a task, and both sides meet on the key they were dealt by
    place = F.row_number().over(Window.partitionBy(key).orderBy("gift_date", "gift_id"))
    second = gifts.select(key, "gift_date", "gift_id", place.alias("_k")).where(F.col("_k") <= 2)
    second = second.groupBy(key).agg(F.max(F.when(F.col("_k") == 2, F.col("gift_date"))).alias("_second"))
    out = s.join(second, key, "left")
    return out.select(
        key,
        from_cents(F.col("_cents")).alias("ramntall"),
        "ngiftall",
        "cardgift",
        F.col("_min.amount").alias("minramnt"),
        F.col("_min.gift_date").alias("minrdate"),
        (-F.col("_max.na")).alias("maxramnt"),
        F.col("_max.gift_date").alias("maxrdate"),
        F.col("_last.amount").alias("lastgift"),
        F.col("_last.gift_date").alias("lastdate"),
        F.col("_first.gift_date").alias("fistdate"),
        F.col("_second").alias("nextdate"),
        fx.months_between_whole(F.col("_second"), F.col("_first.gift_date")).alias("timelag"),
        mean_from_cents("_cents", "ngiftall").alias("avggift"),
    )


def promotion_summary(history: DataFrame, first_gift: DataFrame, ref, key: str = "member_id") -> DataFrame:
    """Promotions received since the member's first gift, lifetime and
    in the last 12 months, all and card mailings; and responses to them.
    history has one row per member and campaign (bounded fan-out)."""
    recent = F.col("send_date") >= F.add_months(F.lit(ref), -12)
    card = F.col("i") % CARD_EVERY == 0
    h = history.join(first_gift, key, "left").where(
        F.col("send_date") >= F.trunc(F.col("first_date"), "month")
    )
    return h.groupBy(key).agg(
        F.count(F.lit(1)).alias("numprom"),
        F.count_if(card).alias("cardprom"),
        F.count_if(recent).alias("numprm12"),
        F.count_if(card & recent).alias("cardpm12"),
        F.count_if(F.col("rdate").isNotNull()).alias("n_responses"),
        F.count_if(card & F.col("rdate").isNotNull()).alias("card_responses"),
    )


def rfa_status(gifts: DataFrame, ref, scale: float, key: str = "member_id") -> DataFrame:
    """Recency class, frequency 1..4 in the class's period and
    amount band of the last gift, from gift events as of ``ref``.

    Star donors (3 consecutive card mailings answered) are found from the
    set of answered card campaigns, a set bounded by the campaign count."""
    ref_idx = fx.month_index(F.lit(ref))
    back = ref_idx - fx.month_index(F.col("gift_date"))
    i = F.ceil(back / 3).cast("int") + 2
    card_i = F.when((i <= 24) & (i % CARD_EVERY == 0), i)
    return _rfa_of(gifts.select(key, "gift_id", "gift_date", "amount", back.alias("back"), card_i.alias("ci")), [key], scale)


def rfa_history(gifts: DataFrame, campaigns: DataFrame, ref, scale: float, key: str = "member_id") -> DataFrame:
    """The status at the sending date of every campaign, from the
    gifts before it.  Gifts are combined on the map side to one entry per member
    and day, and a member's days meet in one row, at most as many as there are
    days; the campaigns (a fixed, small table) are a literal, and each date is
    judged from that row, so no gift is sent once per date."""
    sent = [(r["i"], r["send_date"]) for r in campaigns.orderBy("i").collect()]
    dates = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("sent")) for i, d in sent])
    month = fx.month_index(F.col("gift_date"))
    card = F.ceil((fx.month_index(F.lit(ref)) - month) / 3).cast("int") + 2
    days = gifts.where(F.col("gift_date") < F.lit(max((d for _, d in sent), default=None))).groupBy(key, "gift_date").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("gift_id", "amount")).alias("g"))
    # ordered by date, then as the last gift of a day
    entry = F.struct("gift_date", "g.gift_id", "g.amount", "n", month.alias("m"), F.when((card <= 24) & (card % CARD_EVERY == 0), card).alias("ci"))
    held = days.groupBy(key).agg(F.collect_list(entry).alias("_days"))
    each = held.select(key, "_days", F.explode(dates).alias("c")).select(
        key, F.col("c.i").alias("i"), fx.month_index(F.col("c.sent")).alias("_m"), F.filter("_days", lambda d: d.gift_date < F.col("c.sent")).alias("_d")
    ).where(F.size("_d") > 0)

    def gifts_of(lo: int | None = None, hi: int | None = None):
        back = lambda d: F.col("_m") - d.m
        fits = lambda d: F.lit(True) if hi is None else back(d) <= hi if lo is None else back(d).between(lo, hi)
        return F.aggregate("_d", F.lit(0).cast("long"), lambda n, d: n + F.when(fits(d), d.n).otherwise(0))

    a = each.select(
        key, "i",
        (F.col("_m") - F.array_max("_d").m).alias("last_back"),
        (F.col("_m") - F.array_min("_d").m).alias("first_back"),
        gifts_of().alias("n"), gifts_of(hi=12).alias("n12"), gifts_of(13, 24).alias("n24"), gifts_of(25, 36).alias("n36"),
        F.array_max("_d").alias("_last"),
        F.array_compact(F.transform("_d", lambda d: d.ci)).alias("_cards"),
    )
    return _status_of(a, [key, "i"], scale)


def _rfa_of(g: DataFrame, keys: Sequence[str], scale: float) -> DataFrame:
    """Status per ``keys`` from gifts with their months back and, if they
    answer a card mailing, its number."""
    a = g.groupBy(*keys).agg(
        F.min("back").alias("last_back"),
        F.max("back").alias("first_back"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("back") <= 12).alias("n12"),
        F.count_if((F.col("back") >= 13) & (F.col("back") <= 24)).alias("n24"),
        F.count_if((F.col("back") >= 25) & (F.col("back") <= 36)).alias("n36"),
        F.max(F.struct("gift_date", "gift_id", "amount")).alias("_last"),
        F.collect_set("ci").alias("_cards"),
    )
    return _status_of(a, keys, scale)


def _status_of(a: DataFrame, keys: Sequence[str], scale: float) -> DataFrame:
    """Status from the figures of each of ``keys``.  A class without a gift in
    its own period counts as frequency 1, the least code."""
    star = F.exists(
        "_cards",
        lambda x: F.array_contains("_cards", x + CARD_EVERY) & F.array_contains("_cards", x + 2 * CARD_EVERY),
    )
    rec = (
        F.when(star, "S")
        .when((F.col("first_back") <= 6) & (F.col("n") == 1), "F")
        .when(F.col("first_back") <= 12, "N")
        .when(F.col("last_back") <= 12, "A")
        .when(F.col("last_back") <= 24, "L")
        .otherwise("I")
    )
    freq_n = (
        F.when(F.col("recency").isin("L"), F.col("n24"))
        .when(F.col("recency").isin("I"), F.col("n36"))
        .otherwise(F.col("n12"))
    )
    out = a.withColumn("recency", rec).withColumn("star", star)
    out = out.withColumn("frequency", F.least(F.greatest(freq_n, F.lit(1)), F.lit(4)).cast("int"))
    out = out.withColumn("amount", amount_band(F.col("_last.amount"), scale))
    return out.select(
        *keys,
        "recency",
        "frequency",
        "amount",
        F.concat("recency", F.col("frequency").cast("string"), "amount").alias("rfa"),
        "star",
        F.col("last_back").alias("months_since_last"),
    )


def lapsed(gifts: DataFrame, ref, lo: int = 13, hi: int = 24, key: str = "member_id") -> DataFrame:
    """Members whose last gift is lo..hi months before ``ref``."""
    ref_idx = fx.month_index(F.lit(ref))
    last = gifts.groupBy(key).agg(F.max("gift_date").alias("last_gift_date"))
    back = ref_idx - fx.month_index(F.col("last_gift_date"))
    return last.select(key, "last_gift_date", back.alias("months_since")).where(
        F.col("months_since").between(lo, hi)
    )


def rfm_base(gifts: DataFrame, ref, key: str = "member_id") -> DataFrame:
    ref_idx = fx.month_index(F.lit(ref))
    return gifts.groupBy(key).agg(
        (ref_idx - fx.month_index(F.max("gift_date"))).alias("recency"),
        F.count(F.lit(1)).alias("frequency"),
        from_cents(F.sum(cents(F.col("amount")))).alias("monetary"),
    )


def rfm_cells(base: DataFrame, key: str = "member_id", buckets: int = 5) -> DataFrame:
    """Quintiles for recency (ascending: 1 = most recent), frequency and
    money (descending: 1 = most), ties broken by key; cell = 'RFM'.
    Exact NTILE from distributed positions, no single-task window."""
    out = base
    for col, asc, name in (("recency", True, "r"), ("frequency", False, "f"), ("monetary", False, "m")):
        ranked = with_positions(out, [(col, asc), (key, True)], pos_col=f"_{name}pos", size_col=f"_{name}n")
        out = ranked.withColumn(f"{name}_tile", ntile_of(F.col(f"_{name}pos"), F.col(f"_{name}n"), buckets)).drop(
            f"_{name}pos", f"_{name}n"
        )
    return out.select(
        key, "recency", "frequency", "monetary", "r_tile", "f_tile", "m_tile",
        F.concat(*[F.col(c).cast("string") for c in ("r_tile", "f_tile", "m_tile")]).alias("cell"),
    )


def rfm_alltime(base: DataFrame, first_gift: DataFrame, targets: DataFrame, ref, key: str = "member_id") -> DataFrame:
    """All-time recency, gifts per year and amount per year per member,
    averaged by response."""
    ref_idx = fx.month_index(F.lit(ref))
    years = (ref_idx - fx.month_index(F.col("first_date"))) / 12.0
    m = base.join(first_gift, key).join(targets, key)
    per = m.select(
        "target_b",
        F.col("recency").alias("rec"),
        (F.col("frequency") / years).alias("gpy"),
        (F.col("monetary") / years).alias("apy"),
    )
    return per.groupBy("target_b").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.round(F.avg("rec"), 4).alias("avg_recency"),
        F.round(F.avg("gpy"), 4).alias("avg_gifts_per_year"),
        F.round(F.avg("apy"), 2).alias("avg_amount_per_year"),
    )


def group_quartiles(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """Exact quartiles per group; hot groups are split across tasks."""
    q = exact_quantiles(df, value_col, [0.25, 0.5, 0.75], group_cols=group_cols)
    return q.select(
        *group_cols,
        F.round("q0", 4).alias("q25"),
        F.round("q1", 4).alias("q50"),
        F.round("q2", 4).alias("q75"),
    )


# ---- major donor matrix code (E12) ------------------------------------------------
# Fixed values of the reference's data dictionary (amounts in $, scaled by the
# stand-in money unit): major donor = a gift of $100+ at any time; recency C
# current, L lapsed, I inactive, D dormant; frequency 1, 2 (two to four), 5 (five
# or more); amount L < $100, C $100-499, M $500-999, T $1,000+; 'X' = not a major
# donor.
MAJOR_DONOR_MIN = 100.0
MDMAUD_RECENCY_CODES = ["C", "L", "I", "D"]
MDMAUD_AMOUNT_EDGES = [100.0, 500.0, 1000.0]
MDMAUD_AMOUNT_CODES = ["L", "C", "M", "T"]


def major_donor_code(gifts: DataFrame, ref, scale: float, key: str = "member_id") -> DataFrame:
    """Major donor matrix code from gift events as of ``ref``: the
    recency class of the last gift (<= 12, 13-24, 25-36, 37+ months), the
    number of gifts and the amount given in that class's period; only donors
    with one gift of $100 or more have a code."""
    ref_idx = fx.month_index(F.lit(ref))
    back = ref_idx - fx.month_index(F.col("gift_date"))
    period = (
        F.when(back <= 12, 0).when(back <= 24, 1).when(back <= 36, 2).otherwise(3)
    )
    g = gifts.select(key, period.alias("per"), cents(F.col("amount")).alias("amt"))
    a = g.groupBy(key).agg(
        F.max("amt").alias("_top"),
        F.min("per").alias("_p"),
        *[F.count_if(F.col("per") == i).alias(f"_n{i}") for i in range(4)],
        *[F.sum(F.when(F.col("per") == i, F.col("amt"))).alias(f"_a{i}") for i in range(4)],
    )
    n_in = F.coalesce(*[F.when(F.col("_p") == i, F.col(f"_n{i}")) for i in range(4)])
    a_in = from_cents(F.coalesce(*[F.when(F.col("_p") == i, F.col(f"_a{i}")) for i in range(4)]))
    rec = F.element_at(F.array(*[F.lit(x) for x in MDMAUD_RECENCY_CODES]), (F.col("_p") + 1).cast("int"))
    freq = F.when(n_in == 1, "1").when(n_in <= 4, "2").otherwise("5")
    amt = F.lit(MDMAUD_AMOUNT_CODES[-1])
    for edge, code in reversed(list(zip(MDMAUD_AMOUNT_EDGES, MDMAUD_AMOUNT_CODES[:-1]))):
        amt = F.when(a_in < F.lit(edge * scale), F.lit(code)).otherwise(amt)
    major = from_cents(F.col("_top")) >= F.lit(MAJOR_DONOR_MIN * scale)
    return a.select(
        key,
        F.when(major, rec).alias("mdmaud_r"),
        F.when(major, freq).alias("mdmaud_f"),
        F.when(major, amt).alias("mdmaud_a"),
        F.when(major, F.concat(rec, freq, amt)).otherwise(F.lit("X")).alias("mdmaud"),
    )
