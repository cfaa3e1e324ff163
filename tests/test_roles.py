"""The donor file by its role table: read, clean, encode, impute."""

import warnings

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from donorlift.operators import transformers as tr
from donorlift.sources import roles as rl


def test_role_table_counts():
    r = rl.donor_roles()
    of = lambda kind: [x for x in r.values() if x.role == kind]
    assert len(rl.CENSUS) == len(set(rl.CENSUS)) == 286
    assert (len(of("date")), len(of("flag")), len(of("amount")), len(rl.THREE_BYTES)) == (53, 29, 22, 22)
    assert {x.name for x in r.values() if x.drop} == {"MDMAUD", "RFA_2", "FISTDATE", "NEXTDATE", "DOB"}


def test_donor_file_to_numbers(spark, tmp_path):
    header = ["CONTROLN", "ODATEDW", "DOB", "ZIP", "MAJOR", "VETERANS", "NOEXCH", "RFA_3", "DOMAIN", "MDMAUD_R", "MDMAUD", "INCOME", "RAMNT_3", "RDATE_3", "POP901", "GENDER", "UNKNOWN"]
    lines = ["1,8901,0,61081-,X,Y,0,L4E,U3,D,D1L,3,,,992,F,a", "2,704,3712, , , ,X,L4,R2,X,XXXX,,5,9604,.,M,b", "3,9405,.,02134,.,,1,A1G,C1,C,C1C,7,,9601,3611,,c"]
    path = tmp_path / "donors.csv"
    path.write_text("\n".join([",".join(header), *lines]) + "\n")
    raw = rl.read_donor_file(spark, str(path), header)
    assert "DOB" not in raw.columns and "MDMAUD" not in raw.columns
    clean = rl.cleaning_stages(raw.columns).transform(raw)
    rows = {r["CONTROLN"]: r for r in clean.collect()}
    assert [rows[i]["ZIP"] for i in (1, 2, 3)] == [61081, None, 2134]
    assert [rows[i]["MAJOR"] for i in (1, 2, 3)] == [1, 0, None]
    assert [rows[i]["VETERANS"] for i in (1, 2, 3)] == [1, 0, None]
    assert [rows[i]["NOEXCH"] for i in (1, 2, 3)] == [0, 1, 1]
    assert [rows[i]["RFA_3A"] for i in (1, 2, 3)] == [5, None, 7]
    assert [rows[i]["MDMAUD_R"] for i in (1, 2, 3)] == [1, None, 4]
    assert [rows[i]["RAMNT_3"] for i in (1, 2, 3)] == [0.0, 5.0, None]
    assert [rows[i]["POP901"] for i in (1, 2, 3)] == [992.0, None, 3611.0]
    assert rows[2]["ODATEDW"].year == 1907
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        left = tr.left_over_strings(clean, handled=["INCOME", "GENDER"])
    assert left == ["RFA_3R", "RFA_3F", "DOMAINUrbanicity", "DOMAINSocioEconomic", "UNKNOWN"] or set(left) == {"RFA_3R", "RFA_3F", "DOMAINUrbanicity", "DOMAINSocioEconomic", "UNKNOWN"}
    assert said
    model = Pipeline(stages=[tr.ModeImputer(["GENDER"]), tr.NominalEncoder(["GENDER"]), tr.OrdinalEncoder(["INCOME"]), tr.NominalEncoder(["UNKNOWN"], maxLevels=2), tr.MedianImputer(["POP901"])]).fit(clean)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel

    out = {r["CONTROLN"]: r for r in PipelineModel.load(path).transform(clean.withColumn("UNKNOWN", F.when(F.col("CONTROLN") != 3, F.col("UNKNOWN")).otherwise("z"))).collect()}
    assert [out[i]["INCOME"] for i in (1, 2, 3)] == [1, None, 2]
    assert [(out[i]["GENDER_F"], out[i]["GENDER_M"]) for i in (1, 2, 3)] == [(1, 0), (0, 1), (1, 0)]
    assert [(out[i]["UNKNOWN_0"], out[i]["UNKNOWN_1"], out[i]["UNKNOWN_2"]) for i in (1, 2, 3)] == [(0, 0, 1), (0, 1, 0), (0, 0, 0)]
    assert out[2]["POP901"] == 2301.5
