"""Change records in INCH text: a command line with field names, a line of values, an end mark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of the change records and the section fields that they take.
_OWNERS = [(f"Own{k}", f"o{k}") if n == 0 else (f"Own{k}%", f"f{k}") for k in range(1, 5) for n in range(2)]
_KEYS = {
    "BUS": ("bus", {"BusNum": "ibus"}),
    "LOAD": ("load", {"BusNum": "ibus", "LoadID": "loadid"}),
    "FXSHUNT": ("fixshunt", {"BusNum": "ibus", "ShuntID": "shntid"}),
    "SWSHUNT": ("swshunt", {"BusNum": "ibus", "ShuntID": "shntid"}),
    "GEN": ("generator", {"BusNum": "ibus", "GenID": "machid"}),
    "BRANCH": ("acline", {"BusNumFr": "ibus", "BusNumTo": "jbus", "CKT": "ckt"}),
    "TRANSFORMER": ("transformer", {"W1Bus#": "ibus", "W2Bus#": "jbus", "W3Bus#": "kbus", "CKT": "ckt"}),
    "AREA": ("area", {"AreaNum": "iarea"}),
    "ZONE": ("zone", {"ZoneNum": "izone"}),
}
_VALUES = {
    "BUS": {"BusName": "name", "BusNomVolt": "baskv", "BusType": "ide", "AreaNum": "area", "ZoneNum": "zone", "OwnerNum": "owner", "BusVoltPU": "vm", "BusAngle": "va", "VmaxNorm": "nvhi", "VminNorm": "nvlo", "VmaxCont": "evhi", "VminCont": "evlo"},
    "LOAD": {"Status": "stat", "LoadArea": "area", "LoadZone": "zone", "LoadOwner": "owner", "ConfrmFlag": "scale", "LoadP0": "pl", "LoadQ0": "ql", "LoadP1": "ip", "LoadQ1": "iq", "LoadP2": "yp", "LoadQ2": "yq"},
    "FXSHUNT": {"Status": "stat", "ShuntMW": "gl", "ShuntMVAr": "bl"},
    "SWSHUNT": {"Mode": "modsw", "Status": "stat", "BlockOrder": "adjm", "VMIN": "vswlo", "VMAX": "vswhi", "BShuntCur": "binit", "CtlBs#": "swreg", "RemPcnt": "rmpct"} | {f"{to}{k}": f"{c}{k}" for k in range(1, 9) for to, c in (("NBank", "n"), ("BankSize", "b"))},
    "GEN": {"Status": "stat", "GenMW": "pg", "GenMVR": "qg", "GenMWMin": "pb", "GenMWMax": "pt", "GenMVRMin": "qb", "GenMVRMax": "qt", "GenRMPCT": "rmpct", "GenRegBusNum": "ireg", "VoltTarg": "vs", "MBase": "mbase", "RSource": "zr", "XSource": "zx", "RTran": "rt", "XTran": "xt", "GenTap": "gtap"} | dict(_OWNERS),
    "BRANCH": {"Mt": "met", "Status": "stat", "LineR": "rpu", "LineX": "xpu", "Charge": "bpu", "ShuntGFr": "gi", "ShuntBFr": "bi", "ShuntGTo": "gj", "ShuntBTo": "bj"} | {f"Rate{k}": f"rate{k}" for k in range(1, 13)} | {"Length": "len", "BranchName": "name"} | dict(_OWNERS),
    "TRANSFORMER": {"XfmrName": "name", "Status": "stat", "CW": "cw", "CZ": "cz", "CM": "cm", "MAG1": "mag1", "MAG2": "mag2", "MtBus": "nmet"} | {f"{to}{p}": f"{c}{q}" for n, (p, q) in enumerate((("1-2", "1_2"), ("2-3", "2_3"), ("3-1", "3_1"))) for to, c in (("R", "r"), ("X", "x"))} | {f"SBAS{n + 1}": f"sbase{q}" for n, q in enumerate(("1_2", "2_3", "3_1"))} | dict(_OWNERS),
    "AREA": {"AreaName": "arname", "DesInter": "pdes", "SlackBusNum": "isw"},
    "ZONE": {"ZoneName": "zoname"},
}
_WINDING = {"WINV": "windv", "NOMV": "nomv", "ANG": "ang"}, {"AdjStatus": "cod", "CtrlBus": "cont", "RegulMax": "rma", "RegulMin": "rmi", "TargetMax": "vma", "TargetMin": "vmi", "NumTapPos": "ntp", "NTable": "tab", "LDropR": "cr", "LDropX": "cx"}
for _k in (1, 2, 3):
    _VALUES["TRANSFORMER"] |= {f"W{_k}{to}": f"{c}{_k}" for to, c in _WINDING[0].items()} | {f"W{_k}Rate{r}": f"wdg{_k}rate{r}" for r in range(1, 13)} | {f"W{_k}{to}": f"{c}{_k}" for to, c in _WINDING[1].items()}
#: action -> (command, section, fields): 34 of them.
ACTIONS = {f"DELETE_{kind}": (f"#DELETE_{kind}", section, keys) for kind, (section, keys) in _KEYS.items()}
ACTIONS |= {f"{verb}_{kind}": (f"#{verb}_{kind}", section, keys | _VALUES[kind]) for kind, (section, keys) in _KEYS.items() for verb in ("ADD", "MODIFY")}
ACTIONS |= {f"MODIFY_{kind}_BUS_NUMBER": (f"#MODIFY_{kind}", _KEYS[kind][0], _KEYS[kind][1] | {"BusNumChn": "new_ibus"}) for kind in ("LOAD", "FXSHUNT", "SWSHUNT", "GEN")}
ACTIONS |= {f"MODIFY_{kind}_NUMBER": (f"#MODIFY_{kind}", _KEYS[kind][0], _KEYS[kind][1] | {f"{kind.title()}NumChn": f"new_{own}"}) for kind, own in (("BUS", "ibus"), ("AREA", "iarea"), ("ZONE", "izone"))}


def render(rows: DataFrame, command: str, fields: dict[str, str], to: str = "record") -> DataFrame:
    """The rows with their record. fields: INCH field -> column; an empty value where a column is null."""
    values = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields.values()])
    return rows.withColumn(to, F.concat(F.lit(f"{command} [{','.join(fields)}]\n"), values, F.lit("\n#END")))


def action(rows: DataFrame, name: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Records of one of ACTIONS, with those of its fields whose columns the rows have; all of its key columns must be there. extra: more
    fields and their columns."""
    if name not in ACTIONS:
        raise ValueError(f"no action {name!r}")
    command, section, fields = ACTIONS[name]
    kind = next(k for k, (s, _) in _KEYS.items() if s == section)
    missing = [c for c in _KEYS[kind][1].values() if c not in rows.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return render(rows, command, {f: c for f, c in fields.items() if c in rows.columns} | (extra or {}))


def from_diff(diff: DataFrame, kind: str) -> DataFrame:
    """Records that turn model 1 into model 2: additions and deletions of what one model lacks, changes of what differs in both. A
    change names all fields of which both models have a column, with model 2's values."""
    keys = _KEYS[kind][1]
    values = {f: f"{c}_model2" for f, c in _VALUES[kind].items() if f"{c}_model2" in diff.columns}
    differs = [~F.col(c.replace("_model2", "_model1")).eqNullSafe(F.col(c)) for c in values.values()]
    new = render(diff.where("presence = 'model2_only'"), f"#ADD_{kind}", keys | values)
    gone = render(diff.where("presence = 'model1_only'"), f"#DELETE_{kind}", keys)
    out = new.unionByName(gone)
    if differs:
        changed = diff.where("presence = 'both'").where(reduce(lambda a, b: a | b, differs))
        out = out.unionByName(render(changed, f"#MODIFY_{kind}", keys | values))
    return out


def write(records: DataFrame, path: str) -> None:
    records.select(F.col("record").alias("value")).write.mode("overwrite").text(path)
