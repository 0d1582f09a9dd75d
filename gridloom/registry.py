"""Sections of a network: their fields and types, primary key and bus columns.

Each section is declared in one line of a small notation: `name:type` with types i (long), s (string), d (double), t (status, int);
`x#[1-4]` repeats for each number, `(a#:i b#:d)[1-4]` repeats a group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES: dict[str, DataType] = {"i": LongType(), "s": StringType(), "d": DoubleType(), "t": IntegerType()}
_OWNERS = "(o#:i f#:d)[1-4]"
_RATES = "rate#:d[1-12]"
_WINDING = "windv{0}:d nomv{0}:d ang{0}:d wdg{0}rate#:d[1-12] cod{0}:i cont{0}:i node{0}:i rma{0}:d rmi{0}:d vma{0}:d vmi{0}:d ntp{0}:i tab{0}:i cr{0}:d cx{0}:d cnxa{0}:d"
_CONVERTER = "ip{0}:i nb{0}:i anmx{0}:d anmn{0}:d rc{0}:d xc{0}:d ebas{0}:d tr{0}:d tap{0}:d tmx{0}:d tmn{0}:d stp{0}:d ic{0}:i nd{0}:i if{0}:i it{0}:i id{0}:s xcap{0}:d"
_VSC = "ibus{0}:i type{0}:i mode{0}:i dcset{0}:d acset{0}:d aloss{0}:d bloss{0}:d minloss{0}:d smax{0}:d imax{0}:s pwf{0}:d maxq{0}:d minq{0}:d vsreg{0}:i nreg{0}:i rmpct{0}:d"

# Section names, field names, keys and bus columns of the file format.
_SECTIONS = [
    ("caseid", "ic:i sbase:d rev:i xfrrat:i nxfrat:i basfrq:d title1:s title2:s", "", ""),
    ("general", "thrshz:d pqbrak:d blowup:d maxisollvls:i camaxreptsln:i chkdupcntlbl:i", "", ""),
    ("gauss", "itmx:i accp:d accq:d accm:d tol:d", "", ""),
    ("newton", "itmxn:i accn:d toln:d vctolq:d vctolv:d dvlim:d ndvfct:d", "", ""),
    ("adjust", "adjthr:d acctap:d taplim:d swvbnd:d mxtpss:i mxswim:i", "", ""),
    ("tysl", "itmxty:i accty:d tolty:d", "", ""),
    ("solver", "method:s actaps:i areain:i phshft:i dctaps:i swshnt:i flatst:i varlim:i nondiv:i", "", ""),
    ("rating", "irate:i name:s desc:s", "", ""),
    ("bus", "ibus:i name:s baskv:d ide:i area:i zone:i owner:i vm:d va:d nvhi:d nvlo:d evhi:d evlo:d", "ibus", "ibus"),
    ("load", "ibus:i loadid:s stat:t area:i zone:i pl:d ql:d ip:d iq:d yp:d yq:d owner:i scale:i intrpt:i dgenp:d dgenq:d dgenm:i loadtype:s", "ibus loadid", "ibus"),
    ("fixshunt", "ibus:i shntid:s stat:t gl:d bl:d", "ibus shntid", "ibus"),
    ("generator", f"ibus:i machid:s pg:d qg:d qt:d qb:d vs:d ireg:i nreg:s mbase:d zr:d zx:d rt:d xt:d gtap:d stat:t rmpct:d pt:d pb:d baslod:i {_OWNERS} wmod:i wpf:d", "ibus machid", "ibus"),
    ("acline", f"ibus:i jbus:i ckt:s rpu:d xpu:d bpu:d name:s {_RATES} gi:d bi:d gj:d bj:d stat:t met:i len:d {_OWNERS}", "ibus jbus ckt", "ibus jbus"),
    ("sysswd", f"ibus:i jbus:i ckt:s xpu:d {_RATES} stat:t nstat:i met:i stype:i name:s", "ibus jbus ckt", "ibus jbus"),
    ("transformer", f"ibus:i jbus:i kbus:i ckt:s cw:i cz:i cm:i mag1:d mag2:d nmet:i name:s stat:t {_OWNERS} vecgrp:s zcod:i r1_2:d x1_2:d sbase1_2:d r2_3:d x2_3:d sbase2_3:d r3_1:d x3_1:d sbase3_1:d vmstar:d anstar:d " + " ".join(_WINDING.format(k) for k in (1, 2, 3)), "ibus jbus kbus ckt", "ibus jbus kbus"),
    ("area", "iarea:i isw:i pdes:d ptol:d arname:s", "iarea", ""),
    ("twotermdc", f"name:s mdc:i rdc:d setvl:d vschd:d vcmod:d rcomp:d delti:d met:s dcvmin:d cccitmx:i cccacc:d {_CONVERTER.format('r')} {_CONVERTER.format('i')}", "name", "ipi ipr"),
    ("vscdc", f"name:s mdc:i rdc:d (o#:i f#:s)[1-4] {_VSC.format(1)} {_VSC.format(2)}", "name", "ibus1 ibus2"),
    ("impcor", "itable:i tap:d refact:d imfact:d", "itable", ""),
    ("ntermdc", "name:s nconv:i ndcbs:i ndcln:i mdc:i vconv:i vcmod:d vconvn:i", "name", ""),
    ("ntermdcconv", "name:s ib:i nbrdg:i angmx:d angmn:d rc:d xc:d ebas:d tr:d tap:d tpmx:d tpmn:d tstp:d setvl:d dcpf:d marg:d cnvcod:i", "name ib", "ib"),
    ("ntermdcbus", "name:s idc:i ib:i area:i zone:i dcname:s idc2:i rgrnd:d owner:i", "name idc", "ib"),
    ("ntermdclink", "name:s idc:i jdc:s dcckt:s met:i rdc:s ldc:s", "name", ""),
    ("msline", "ibus:i jbus:i mslid:s met:i dum#:i[1-9]", "ibus jbus mslid", "ibus jbus"),
    ("zone", "izone:i zoname:s", "izone", ""),
    ("iatrans", "arfrom:i arto:i trid:s ptran:d", "arfrom arto trid", ""),
    ("owner", "iowner:i owname:s", "iowner", ""),
    ("facts", "name:s ibus:i jbus:i mode:i pdes:d qdes:d vset:d shmx:d trmx:d vtmn:d vtmx:d vsmx:d imx:d linx:d rmpct:d owner:i set1:d set2:d vsref:i fcreg:i nreg:i mname:s", "name", "ibus jbus"),
    ("swshunt", "ibus:i shntid:s modsw:i adjm:i stat:t vswhi:d vswlo:d swreg:i nreg:i rmpct:d rmidnt:s binit:d (s#:i n#:i b#:d)[1-8]", "ibus shntid", "ibus"),
    ("gne", "name:s model:s nterm:i bus1:i bus2:i nreal:i nintg:i nchar:i stat:t owner:i nmet:i real#:d[1-10] intg#:i[1-10] char#:s[1-10]", "name", "bus1 bus2"),
    ("indmach", "ibus:i imid:s stat:t sc:i dc:i area:i zone:i owner:i tc:i bc:i mbase:d ratekv:d pcode:i pset:d hconst:d aconst:d bconst:d dconst:d econst:d ra:d xa:d xm:d r1:d x1:d r2:d x2:d x3:d e1:d se1:d e2:d se2:d ia1:d ia2:d xamult:d", "ibus imid", "ibus"),
    ("sub", "isub:i name:s lati:d long:d srg:d", "isub", ""),
    ("subnode", "isub:i inode:i name:s ibus:i stat:t vm:d va:d", "isub inode ibus", "ibus"),
    ("subswd", "isub:i inode:i jnode:i swdid:s name:s type:i stat:t nstat:i xpu:d rate1:d rate2:d rate3:d", "isub inode jnode swdid", ""),
    ("subterm", "isub:i inode:i type:s eqid:s ibus:i jbus:i kbus:i", "isub inode type eqid ibus jbus kbus", "ibus jbus kbus"),
]
#: Sections that give nodes or edges of the graph, by the number of buses that they join.
ONE_BUS = ("load", "fixshunt", "generator", "ntermdcconv", "ntermdcbus")
TWO_BUS = ("acline", "sysswd", "twotermdc", "vscdc", "msline")


def expand(spec: str) -> list[tuple[str, str]]:
    """(name, type letter) of each field in a section's notation."""
    out = []
    for group, single, a, b in re.findall(r"(?:\(([^)]*)\)|(\S+?))(?:\[(\d+)-(\d+)\])?(?:\s+|$)", spec):
        for k in range(int(a), int(b) + 1) if a else [None]:
            out += [tuple(part.replace("#", str(k)).split(":")) for part in (group or single).split()]
    return out


@dataclass(frozen=True)
class Section:
    name: str
    schema: StructType
    id_cols: tuple[str, ...] = ()
    bus_cols: tuple[str, ...] = field(default=())

    @property
    def fields(self) -> list[str]:
        return self.schema.fieldNames()


REGISTRY: dict[str, Section] = {}


def register_section(name: str, schema: StructType, id_cols=(), bus_cols=()) -> Section:
    """Adds a section, or replaces one."""
    REGISTRY[name] = Section(name, schema, tuple(id_cols), tuple(bus_cols))
    return REGISTRY[name]


for _name, _spec, _keys, _buses in _SECTIONS:
    register_section(_name, StructType([StructField(f, _TYPES[t]) for f, t in expand(_spec)]), _keys.split(), _buses.split())


def section(name: str) -> Section:
    """The section's record; an empty one for names that are not registered."""
    return REGISTRY.get(name, Section(name, StructType([])))
