"""Pipeline stages, stage store, file round trip, projections, major donor
code, response rate and top-k queries (X1-X3, S1, S4-S9, P1-P6, P11, E12,
A8, K1, K3, K5)."""

from __future__ import annotations

import re
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorlift.functions import codes as fx
from donorlift.operators import encode as en
from donorlift.operators import sampling as sm
from donorlift.operators import segments as sg
from donorlift.operators import transformers as tr
from donorlift.operators.steps import Chain, Step
from donorlift.plans.oracle_views import REF_MONTH, month_idx, with_views
from donorlift.plans.q_clean import sql_fix_date, sql_parse_yymm
from donorlift.plans.registry import register
from donorlift.session import ensure_checkpoint_dir
from donorlift.sources import files as fl
from donorlift.sources import standin as si

CAMPAIGNS = list(range(si.FIRST_CAMPAIGN, si.LAST_CAMPAIGN + 1))


def _t(spark, sf_dir):
    return si.Tables(spark, sf_dir)


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def clean_stages(ref_year: int):
    """The cleaning stage of the member file as pipeline stages."""
    return [
        tr.DateParser(["odate"], refYear=ref_year),
        tr.ZipFormatter(["zip"]),
        tr.BinaryRecoder(["flag"], trueCode="X", falseCode=" "),
        tr.MultiByteSplitter(["rfa"], suffixes=["R", "F", "A"]),
        tr.OrdinalMapper(["rfaA"], mapping=fx.RFA_AMOUNT_ORDER),
        tr.MultiByteSplitter(["domain"], suffixes=["Urbanicity", "SocioEconomic"]),
    ]


CLEANED_SQL = with_views(["raw_members"], f"""
SELECT member_id, {sql_parse_yymm(sql_fix_date('odate'), si.REF.year)} AS odate,
  CASE WHEN trim(replace(zip, '-', '')) IN ('', '.') THEN NULL
       ELSE TRY_CAST(trim(replace(zip, '-', '')) AS INTEGER) END AS zip,
  CAST(CASE WHEN flag IN ('X', '1') THEN 1 WHEN flag IN (' ', '0') THEN 0 END AS INTEGER) AS flag,
  CASE WHEN length(rfa) = 3 THEN substr(rfa, 1, 1) END AS rfaR,
  CASE WHEN length(rfa) = 3 THEN substr(rfa, 2, 1) END AS rfaF,
  CASE CASE WHEN length(rfa) = 3 THEN substr(rfa, 3, 1) END
       WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4
       WHEN 'E' THEN 5 WHEN 'F' THEN 6 WHEN 'G' THEN 7 END AS rfaA,
  CASE WHEN length(domain) = 2 THEN substr(domain, 1, 1) END AS domainUrbanicity,
  CASE WHEN length(domain) = 2 THEN substr(domain, 2, 1) END AS domainSocioEconomic
FROM raw_members""")


@register("clean_pipeline", CLEANED_SQL, ids="X1 X2 X3 X5 S7 C1 C2 C5 C7 C8 C9 C12 C13 C14 J2 T1")
def q_clean_pipeline(spark, sf_dir):
    """Learn the cleaning pipeline (with the C12 dropper) on the learning
    split, store it, load it back and apply it unchanged to all members."""
    t = _t(spark, sf_dir)
    raw = si.raw_members(t)
    split = sm.stratified_split(si.targets(t).select("member_id", "target_b"), "member_id", "target_b")
    learn = raw.join(split.where("split = 'train'").select("member_id"), "member_id", "left_semi")
    dropper = tr.ZeroVarianceSparseDropper(
        ["flag", "rfaR", "rfaF", "domainUrbanicity", "domainSocioEconomic"])
    model = Pipeline(stages=clean_stages(si.REF.year) + [dropper]).fit(learn)
    path = _scratch(spark, "clean-model")
    model.write().overwrite().save(path)
    return PipelineModel.load(path).transform(raw)


_CHAIN_NUMBERS = ["flag", "rfaF", "rfaA", "domainSocioEconomic"]
_CHAIN_SQL = with_views(["targets"], """
SELECT c.member_id,
  """ + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM numeric WHERE split = 'train')) AS {c}" for c in _CHAIN_NUMBERS) + """,
  """ + ", ".join(f"CAST(COALESCE(domainUrbanicity = '{v}', false) AS INTEGER) AS domainUrbanicity_{v}" for v in "CRSTU") + """,
  """ + ", ".join(f"CAST(((CASE WHEN rfaR IS NULL THEN 7 ELSE COALESCE(strpos('AFILNS', rfaR), 0) END) >> {2 - k}) & 1 AS INTEGER) AS rfaR_{k}" for k in range(3)) + """
FROM numeric c WHERE split = 'test'""",
    [("pos", "SELECT member_id, target_b, ROW_NUMBER() OVER (PARTITION BY target_b ORDER BY md5(CAST(member_id AS VARCHAR) || '42'), member_id) AS pos, COUNT(*) OVER (PARTITION BY target_b) AS n FROM targets"),
     ("cleaned", CLEANED_SQL),
     ("numeric", "SELECT c.* REPLACE (TRY_CAST(rfaF AS INTEGER) AS rfaF, TRY_CAST(domainSocioEconomic AS INTEGER) AS domainSocioEconomic), CASE WHEN pos <= (n + 4) // 5 THEN 'test' ELSE 'train' END AS split FROM cleaned c JOIN pos USING (member_id)")])


@register("stage_chain", _CHAIN_SQL, ids="X1 X2 X3 S4 S5 S6 S7 E6 E7 E8 I1 F2 C13 R1")
def q_stage_chain(spark, sf_dir):
    """raw -> cleaned -> numeric -> imputed -> selected: every stage is fitted
    on the learning split, stored, and the loaded model is applied to the
    validation split; each stage's table is provided from the one before."""
    t = _t(spark, sf_dir)
    split = sm.stratified_split(si.targets(t).select("member_id", "target_b"), "member_id", "target_b")

    def rows(part):
        return si.raw_members(t).join(split.where(F.col("split") == part).select("member_id"), "member_id", "left_semi")

    chain = Chain(spark, _scratch(spark, "chain"), chain_steps())
    chain.learn(lambda: rows("train"))
    return chain.apply(lambda: rows("test"), "validation")


def chain_steps() -> list[Step]:
    """The steps from raw to selected members."""
    kept = [*_CHAIN_NUMBERS, *[f"domainUrbanicity_{v}" for v in "CRSTU"], *[f"rfaR_{k}" for k in range(3)]]
    return [
        Step("cleaned", clean_stages(si.REF.year), drop=["zip", "odate"]),
        Step("numeric", [tr.ToNumber(["rfaF", "domainSocioEconomic"]), tr.NominalEncoder(["domainUrbanicity"]), tr.NominalEncoder(["rfaR"], maxLevels=3)]),
        Step("imputed", [tr.MedianImputer(_CHAIN_NUMBERS)], before=lambda df: df.where(F.col("member_id").isNotNull()), types=dict.fromkeys(_CHAIN_NUMBERS, "double")),
        Step("selected", [tr.KeepColumns(["member_id", *kept])], after=lambda df: df.select("member_id", *[c for c in df.columns if c != "member_id"])),
    ]


@register("stage_store", CLEANED_SQL, ids="S4 S5 S6")
def q_stage_store(spark, sf_dir):
    """Provide the 'cleaned' stage: absent from the store, so it is built
    from the 'raw' stage (itself built and stored first), then stored."""
    store = fl.StageStore(spark, _scratch(spark, "stages"))
    t = _t(spark, sf_dir)
    pipe = PipelineModel(stages=clean_stages(si.REF.year))
    build = {"raw": lambda _: si.raw_members(t), "cleaned": lambda prev: pipe.transform(prev)}
    return store.provide("cleaned", ["raw", "cleaned"], build)


RAW_COLS = ["member_id", "odate", "zip", "flag", "rfa", "domain"]
NA_CODES = {"odate": ["", "nan"], "zip": [" ", "."], "rfa": [" "]}


@register(
    "csv_roundtrip",
    with_views(["raw_members"], """
SELECT member_id, CASE WHEN odate IN ('', 'nan') THEN NULL ELSE odate END AS odate,
       CASE WHEN zip IN (' ', '.') THEN NULL ELSE zip END AS zip, flag,
       CASE WHEN rfa IN (' ') THEN NULL ELSE rfa END AS rfa, domain
FROM raw_members"""),
    ids="S1 S9",
)
def q_csv_roundtrip(spark, sf_dir):
    """Write the member file as CSV, read it back with per-column NA codes
    (a blank flag stays a value), and write the result file."""
    root = _scratch(spark, "csv")
    t = _t(spark, sf_dir)
    raw = si.raw_members(t)
    (raw.select(*[F.col(c).cast("string") for c in RAW_COLS]).write.mode("overwrite")
        .option("header", True).option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(f"{root}/members"))
    back = fl.read_coded_csv(spark, f"{root}/members", RAW_COLS, NA_CODES, {"member_id": "bigint"})
    fl.write_result_csv(si.scored(t), "member_id", "d_hat", f"{root}/result")
    return back


@register(
    "files_read_back",
    with_views(["members", "scored"], """
SELECT c.c_custkey AS member_id, s.target_b, s.target_d, s.d_hat,
  CAST(CASE WHEN c.c_nationkey IS NULL THEN NULL WHEN z.k IS NOT NULL THEN z.lat
       WHEN m.region IN ('MIDDLE EAST') THEN 38.8719 ELSE 0.0 END AS DOUBLE) AS latitude,
  CAST(CASE WHEN c.c_nationkey IS NULL THEN NULL WHEN z.k IS NOT NULL THEN z.lon
       WHEN m.region IN ('MIDDLE EAST') THEN -77.0563 ELSE 0.0 END AS DOUBLE) AS longitude
FROM customer c JOIN members m ON c.c_custkey = m.member_id JOIN scored s ON c.c_custkey = s.member_id
LEFT JOIN (SELECT n_nationkey AS k, n_nationkey * 3.0 - 36.0 AS lat, n_regionkey * 60.0 - 120.0 + n_nationkey AS lon
           FROM nation WHERE n_nationkey % 4 <> 0) z ON c.c_nationkey = z.k"""),
    ids="S2 S3 S9 J1 E1",
)
def q_files_read_back(spark, sf_dir):
    """The targets file, the centroid file and the result file, each written as
    CSV, read back by its reader and attached to the members."""
    root = _scratch(spark, "files")
    t = _t(spark, sf_dir)
    scored = si.scored(t)
    fl.write_result_csv(scored, "member_id", "d_hat", f"{root}/result")
    scored.select("member_id", "target_b", "target_d").write.option("header", True).csv(f"{root}/targets")
    t.nation.where(F.col("n_nationkey") % 4 != 0).select(
        F.col("n_nationkey").alias("ZIP"),
        (F.col("n_nationkey") * 3.0 - 36.0).alias("INTPTLAT"),
        (F.col("n_regionkey") * 60.0 - 120.0 + F.col("n_nationkey")).alias("INTPTLONG"),
    ).write.option("header", True).csv(f"{root}/centroids")
    base = t.customer.select(F.col("c_custkey").alias("member_id"), F.col("c_nationkey").alias("zip")).join(
        si.members(t).select("member_id", "region"), "member_id")
    points = fl.read_centroids(spark, f"{root}/centroids", ["ZIP", "INTPTLAT", "INTPTLONG"])
    located = en.coords_lookup(base, "zip", "region", points, ["MIDDLE EAST"])
    out = located.join(fl.read_targets(spark, f"{root}/targets", "member_id", "target_b", "target_d"), "member_id")
    out = out.join(fl.read_result_csv(spark, f"{root}/result", "member_id", "d_hat"), "member_id")
    return out.select("member_id", "target_b", "target_d", "d_hat", "latitude", "longitude")


def _wide(spark, sf_dir):
    return si.history_wide(_t(spark, sf_dir))


SELECTED = [f"RAMNT_{i}" for i in range(3, 12)]


@register(
    "select_columns",
    with_views(["history"], "SELECT member_id, " + ", ".join(
        f"MAX(CASE WHEN i = {i} THEN ramnt END) AS RAMNT_{i}" for i in range(3, 12) if i != 7
    ) + " FROM history GROUP BY member_id"),
    ids="P1 P2 P3 P4 P5 P6 P11",
)
def q_select_columns(spark, sf_dir):
    """Projections by type, regex, name lists and prefixes on the wide
    history: numeric columns (P2) named RAMNT_* (P3), not starting with
    RDATE_ (P11), kept if still requested (P4), minus a drop list that
    names an absent column too (P1)."""
    w = _wide(spark, sf_dir)
    numeric = [f.name for f in w.schema.fields if isinstance(f.dataType, T.NumericType)]
    by_regex = [c for c in numeric if re.fullmatch(r"RAMNT_.*", c)]
    no_prefix = [c for c in by_regex if not c.startswith("RDATE_")]
    wanted = [c for c in SELECTED if c in set(no_prefix)]
    return w.select("member_id", *wanted).drop("RAMNT_7", "NOT_A_COLUMN")


@register(
    "major_donor_code",
    with_views(["gifts"], f"""
SELECT a.member_id,
  CASE WHEN major THEN substr('CLID', a.p + 1, 1) END AS mdmaud_r,
  CASE WHEN major THEN (CASE WHEN i.n = 1 THEN '1' WHEN i.n <= 4 THEN '2' ELSE '5' END) END AS mdmaud_f,
  CASE WHEN major THEN (CASE WHEN i.s < 250000 THEN 'L' WHEN i.s < 1250000 THEN 'C'
                             WHEN i.s < 2500000 THEN 'M' ELSE 'T' END) END AS mdmaud_a,
  CASE WHEN major THEN substr('CLID', a.p + 1, 1)
                       || (CASE WHEN i.n = 1 THEN '1' WHEN i.n <= 4 THEN '2' ELSE '5' END)
                       || (CASE WHEN i.s < 250000 THEN 'L' WHEN i.s < 1250000 THEN 'C'
                                WHEN i.s < 2500000 THEN 'M' ELSE 'T' END)
       ELSE 'X' END AS mdmaud
FROM (SELECT member_id, MIN(per) AS p, CAST(MAX(amt) AS DOUBLE) >= 250000 AS major FROM g GROUP BY member_id) a
JOIN (SELECT g.member_id, g.per, COUNT(*) AS n, CAST(SUM(g.amt) AS DOUBLE) AS s FROM g GROUP BY g.member_id, g.per) i
  ON a.member_id = i.member_id AND a.p = i.per""", [("g", f"""
SELECT member_id, CAST(amount AS DECIMAL(18,2)) AS amt,
  CASE WHEN {REF_MONTH} - {month_idx('gift_date')} <= 12 THEN 0
       WHEN {REF_MONTH} - {month_idx('gift_date')} <= 24 THEN 1
       WHEN {REF_MONTH} - {month_idx('gift_date')} <= 36 THEN 2 ELSE 3 END AS per
FROM gifts""")]),
    ids="E12",
)
def q_major_donor_code(spark, sf_dir):
    # a money unit under which both major donors and others occur
    return sg.major_donor_code(si.gifts(_t(spark, sf_dir)), si.REF, 2500.0)


@register(
    "response_rate",
    with_views(["targets"], """
SELECT COUNT(*) AS n, COUNT(CASE WHEN target_b = 1 THEN 1 END) AS n_responders,
       round(avg(target_b), 6) AS response_rate,
       round(COUNT(CASE WHEN target_b = 0 THEN 1 END) / COUNT(CASE WHEN target_b = 1 THEN 1 END), 6) AS class_ratio
FROM targets"""),
    ids="A8",
)
def q_response_rate(spark, sf_dir):
    tg = si.targets(_t(spark, sf_dir))
    return tg.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("target_b") == 1).alias("n_responders"),
        F.round(F.avg("target_b"), 6).alias("response_rate"),
        F.round(F.count_if(F.col("target_b") == 0) / F.count_if(F.col("target_b") == 1), 6).alias("class_ratio"),
    )


@register(
    "top_donors",
    with_views(["gifts"], """
SELECT member_id, monetary, CAST(ROW_NUMBER() OVER (ORDER BY monetary DESC, member_id) AS INTEGER) AS rank
FROM (SELECT member_id, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS monetary
      FROM gifts GROUP BY member_id ORDER BY monetary DESC, member_id LIMIT 50)"""),
    ids="K1 K3 K5",
)
def q_top_donors(spark, sf_dir):
    """Top 50 by lifetime giving: the limit is the feature (top-k report);
    Spark plans it as a distributed take-ordered (per-partition top 50)."""
    base = sg.rfm_base(si.gifts(_t(spark, sf_dir)), si.REF).select("member_id", "monetary")
    top = base.orderBy(F.col("monetary").desc(), F.col("member_id")).limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("monetary").desc(), "member_id")))
