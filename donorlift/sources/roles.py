"""Column roles of the donor file (S1): which columns there are, how each is
typed, which codes mean missing, true or false, and what is dropped.

The table drives the reader (all text, codes to null) and the cleaning
pipeline.  Numbered columns come from rules (name, first, last)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from donorlift.functions import codes as fx
from donorlift.operators import transformers as tr
from donorlift.sources.files import read_coded_csv


@dataclass(frozen=True)
class Role:
    name: str
    role: str  # key, target, date, flag, nominal, bytes, major, ordinal, place, number, amount
    na: tuple[str, ...] = ("",)
    true: str = ""
    false: str = ""
    suffixes: tuple[str, ...] = ()
    drop: bool = False


def numbered(*rules: tuple[str, int, int]) -> list[str]:
    """Names of numbered columns, e.g. ("ADATE_", 2, 24)."""
    return [f"{name}{i}" for name, first, last in rules for i in range(first, last + 1)]


# The file's columns by role, in the order of the data dictionary.
KEY, TARGETS = "CONTROLN", ("TARGET_B", "TARGET_D")
DATES = ["ODATEDW", "DOB", *numbered(("ADATE_", 2, 24), ("RDATE_", 3, 24)), "LASTDATE", "MINRDATE", "MAXRDATE", "FISTDATE", "NEXTDATE", "MAXADATE"]
FLAGS = [  # (true, false, columns)
    ("X", " ", ["PEPSTRFL", "MAJOR", "RECINHSE", "RECP3", "RECPGVG", "RECSWEEP"]),
    ("Y", " ", ["COLLECT1", "VETERANS", "BIBLE", "CATLG", "HOMEE", "PETS", "CDPLAY", "STEREO", "PCOWNERS", "PHOTO", "CRAFTS", "FISHER", "GARDENIN", "BOATS", "WALKER", "KIDSTUFF", "CARDS", "PLATES"]),
    ("E", "I", ["AGEFLAG"]),
    ("H", "U", ["HOMEOWNR"]),
    ("B", " ", ["MAILCODE"]),
    ("1", "0", ["HPHONE_D", "NOEXCH"]),
]
NOMINALS = ["OSOURCE", "TCODE", "STATE", "PVASTATE", "CLUSTER", "CHILD03", "CHILD07", "CHILD12", "CHILD18", "GENDER", "DATASRCE", "SOLP3", "SOLIH", "GEOCODE", "GEOCODE2", "LIFESRC"]
THREE_BYTES = numbered(("RFA_", 3, 24))
ORDINALS = ["WEALTH1", "WEALTH2", "INCOME"]
MAJOR_DONOR = ["MDMAUD_R", "MDMAUD_F", "MDMAUD_A"]
MAJOR_RECENCY, MAJOR_AMOUNT = {"D": 1, "I": 2, "L": 3, "C": 4}, {"L": 1, "C": 2, "M": 3, "T": 4}
AMOUNTS = numbered(("RAMNT_", 3, 24))
SUMMARIES = ["CARDPROM", "NUMPROM", "CARDPM12", "NUMPRM12", "RAMNTALL", "NGIFTALL", "CARDGIFT", "MINRAMNT", "MAXRAMNT", "LASTGIFT", "TIMELAG", "AVGGIFT"]
CENSUS = [
    *numbered(("POP90", 1, 3), ("POP90C", 1, 5), ("ETH", 1, 16), ("AGE90", 1, 7), ("CHIL", 1, 3), ("AGEC", 1, 7), ("CHILC", 1, 5), ("HHAGE", 1, 3), ("HHN", 1, 6), ("MARR", 1, 4), ("HHP", 1, 2), ("DW", 1, 9)),
    *numbered(("HV", 1, 4), ("HU", 1, 5), ("HHD", 1, 12), ("ETHC", 1, 6), ("HVP", 1, 6), ("HUR", 1, 2), ("RHP", 1, 4), ("HUPA", 1, 7), ("RP", 1, 4)),
    "MSA", "ADI", "DMA",
    *numbered(("IC", 1, 23), ("HHAS", 1, 4), ("MC", 1, 3), ("TPE", 1, 13), ("PEC", 1, 2), ("LFC", 1, 10), ("OCC", 1, 13), ("EIC", 1, 16), ("OEDC", 1, 7), ("EC", 1, 8), ("SEC", 1, 5), ("AFC", 1, 6)),
    *numbered(("VC", 1, 4), ("ANC", 1, 15), ("POBC", 1, 2), ("LSC", 1, 4), ("VOC", 1, 3), ("HC", 1, 21), ("MHUC", 1, 2), ("AC", 1, 2)),
]
# Dropped after reading: codes that come split already, and dates contained in others.
PRE_SPLIT, REDUNDANT = ["MDMAUD", "RFA_2"], ["FISTDATE", "NEXTDATE", "DOB"]
BLANK = ("", " ", ".")


def donor_roles() -> dict[str, Role]:
    """The role table, by column name."""
    rows = [Role(KEY, "key"), *(Role(c, "target") for c in TARGETS)]
    rows += [Role(c, "date", BLANK, drop=c in REDUNDANT) for c in DATES]
    rows += [Role(c, "flag", ("", "."), t, f) for t, f, names in FLAGS for c in names]
    rows += [Role(c, "nominal", BLANK) for c in [*NOMINALS, "RFA_2R", "RFA_2F"]]
    rows += [Role("RFA_2A", "bytes", BLANK)]
    rows += [Role(c, "bytes", BLANK, suffixes=("R", "F", "A")) for c in THREE_BYTES]
    rows += [Role("DOMAIN", "bytes", BLANK, suffixes=("Urbanicity", "SocioEconomic"))]
    rows += [Role(c, "major", BLANK) for c in MAJOR_DONOR] + [Role(c, "nominal", drop=True) for c in PRE_SPLIT]
    rows += [Role(c, "ordinal", BLANK) for c in ORDINALS] + [Role("ZIP", "place", BLANK)]
    rows += [Role(c, "amount", BLANK) for c in AMOUNTS] + [Role(c, "number", BLANK) for c in [*SUMMARIES, *CENSUS]]
    return {r.name: r for r in rows}


def read_donor_file(spark: SparkSession, path: str, header: Sequence[str], roles: dict[str, Role] | None = None) -> DataFrame:
    """The raw stage: every column of ``header`` as text with its missing codes
    as null, keys, targets, numbers and amounts typed, dropped columns gone."""
    roles = roles or donor_roles()
    known = [c for c in header if c in roles]
    types = {"key": "bigint", "target": "double", "number": "double", "amount": "double"}
    raw = read_coded_csv(spark, path, header, {c: roles[c].na for c in known}, {c: types[roles[c].role] for c in known if roles[c].role in types})
    return raw.drop(*[c for c in known if roles[c].drop])


def cleaning_stages(columns: Sequence[str], ref_year: int = 1997, roles: dict[str, Role] | None = None) -> PipelineModel:
    """The cleaned stage for the columns that are there, as pipeline stages."""
    roles = roles or donor_roles()
    there = [roles[c] for c in columns if c in roles and not roles[c].drop]
    of = lambda *kinds: [r.name for r in there if r.role in kinds]
    stages: list = [tr.DateParser(of("date"), refYear=ref_year), tr.ZipFormatter(of("place")), tr.XToNull(of("major"))]
    for t, f in dict.fromkeys((r.true, r.false) for r in there if r.role == "flag"):
        same = [r.name for r in there if r.role == "flag" and (r.true, r.false) == (t, f)]
        stages.append(tr.BinaryRecoder(same, trueCode=t, falseCode=f, xIsTrue=(t, f) == ("1", "0")))
    for suffixes in dict.fromkeys(r.suffixes for r in there if r.suffixes):
        stages.append(tr.MultiByteSplitter([r.name for r in there if r.suffixes == suffixes], suffixes=list(suffixes)))
    amount_bytes = [f"{r.name}A" for r in there if r.suffixes == ("R", "F", "A")] + [c for c in of("bytes") if c == "RFA_2A"]
    stages.append(tr.OrdinalMapper(amount_bytes, mapping=fx.RFA_AMOUNT_ORDER))
    stages.append(tr.OrdinalMapper([c for c in of("major") if c.endswith("_R")], mapping=MAJOR_RECENCY))
    stages.append(tr.OrdinalMapper([c for c in of("major") if c.endswith("_A")], mapping=MAJOR_AMOUNT))
    pairs = [(f"RAMNT_{i}", f"RDATE_{i}") for i in range(3, 25) if f"RAMNT_{i}" in columns and f"RDATE_{i}" in columns]
    stages.append(tr.AmountFixer([a for a, _ in pairs], dateCols=[d for _, d in pairs]))
    return PipelineModel(stages=stages)
