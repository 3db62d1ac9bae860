"""All registered queries."""

from __future__ import annotations

from estatelens.cases import (
    assessment,
    corpus_cases,
    estate_cases,
    etl_cases,
    flow_cases,
    scalar_cases,
    sink_cases,
)
from estatelens.cases.base import Cases

AREAS = [assessment, scalar_cases, corpus_cases, estate_cases, etl_cases, flow_cases, sink_cases]


def all_cases() -> Cases:
    out = Cases()
    for area in AREAS:
        out.include(area.cases)
    return out
