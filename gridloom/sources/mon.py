"""Flowgate definitions (.mon): a state machine over a file's lines, one row an element."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators.flowgate import ELEMENTS

_HEADER = re.compile(r"\s*MONITOR\s+FLOWGATE\s+(\d+)\s+'([^']*)'", re.I)
_CONTINGENCY = re.compile(r"\s*CONTINGENCY\b", re.I)
_BRANCH = re.compile(r"\s*(?:OPEN\s+)?BRANCH\b", re.I)
_MACHINE = re.compile(r"\s*REMOVE\s+MACHINE\b", re.I)
_SC = re.compile(r"\s*SC\s+(\S+)", re.I)


def token(text: str) -> str:
    """18 characters: 12 of a name, 6 of a voltage."""
    text = text.strip("'")
    if len(text) != 18:
        raise ValueError(f"a bus token has 18 characters, not {len(text)}: {text!r}")
    float(text[12:])
    return text


def parse(text: str) -> list[tuple]:
    """Rows of ELEMENTS. ValueError, with the line's number, where blocks are not closed or lines are malformed."""
    out: list[tuple] = []
    state, flowgate, elements = "top", (0, "", ""), []
    for number, line in enumerate(text.splitlines(), 1):
        word = line.strip()
        if not word or word.upper() == "BUSNAMES":
            continue
        try:
            if m := _HEADER.match(line):
                if state != "top":
                    raise ValueError("a flowgate within a flowgate")
                state, flowgate, elements = "monitor", (int(m[1]), m[2], ""), []
            elif _CONTINGENCY.match(line):
                if state != "monitor":
                    raise ValueError("a contingency outside of a flowgate")
                state = "contingency"
            elif word.upper() == "END":
                if state == "contingency":
                    state = "after"
                elif state in ("monitor", "after"):
                    out += [(*flowgate, *e) for e in elements]
                    state = "top"
                else:
                    raise ValueError("END without a block")
            elif state in ("monitor", "contingency") and _BRANCH.match(line):
                tokens, circuit = re.findall(r"'([^']*)'", line), re.search(r"CKT\s+'?([^'\s]+)'?\s*$", line, re.I)
                if len(tokens) != 2 or not circuit:
                    raise ValueError("a branch has two quoted buses and a circuit")
                elements.append((state, "branch", token(tokens[0]), token(tokens[1]), circuit[1], None, None))
            elif state == "contingency" and _MACHINE.match(line):
                tokens, machine = re.findall(r"'([^']*)'", line), re.search(r"MACHINE\s+'?([^'\s]+)'?\s+FROM", line, re.I)
                if len(tokens) != 1 or not machine:
                    raise ValueError("a machine has an id and one quoted bus")
                elements.append((state, "generator", None, None, None, token(tokens[0]), machine[1]))
            elif state == "after" and (m := _SC.match(line)):
                flowgate = (*flowgate[:2], m[1])
            elif not (state == "after" and re.match(r"\s*(CA|TP)\b", line, re.I)):
                logging.getLogger(__name__).warning("line %d is not understood: %s", number, word)
        except ValueError as e:
            raise ValueError(f"line {number}: {e}") from e
    if state != "top":
        raise ValueError("the last block is not closed")
    return out


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    def run(frames):
        import pandas as pd

        columns = [c.split()[0] for c in ELEMENTS.split(", ")]
        for frame in frames:
            for text in frame["value"]:
                yield pd.DataFrame(parse(text), columns=columns)

    return spark.read.text(paths, wholetext=True).mapInPandas(run, ELEMENTS)
