"""All registered queries and their DuckDB oracles, gathered from plan modules."""

from __future__ import annotations

import importlib

PLAN_MODULES = [
    "snipflow.plans.rules_q",
    "snipflow.plans.trace_q",
    "snipflow.plans.dsops_q",
    "snipflow.plans.nested_q",
    "snipflow.plans.eval_q",
    "snipflow.plans.corpus_q",
    "snipflow.plans.features_q",
    "snipflow.plans.policy_q",
    "snipflow.plans.model_q",
    "snipflow.plans.stream_q",
    "snipflow.plans.io_q",
]


def _modules():
    return [importlib.import_module(m) for m in PLAN_MODULES]


def all_queries():
    out = {}
    for m in _modules():
        for k, v in m.queries().items():
            if k in out:
                raise ValueError(f"duplicate query id {k}")
            out[k] = v
    return out


def all_oracles():
    out = {}
    for m in _modules():
        out.update(m.oracle())
    return out
