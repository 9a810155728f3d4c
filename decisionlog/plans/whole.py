"""Queries on the scenes of all orders, those without line items too.

Some of the oracle SQL is on orders with line items. It is left as it is, its queries run on just these scenes, and a
query ``..._all_orders`` has the same operators on every scene, with SQL that keeps every order.
"""

from __future__ import annotations

from decisionlog.plans.registry import ORACLE, QUERIES
from decisionlog.plans.views import CTES, Furnished

_HEADS, _SEEN = CTES["scene_heads"][1], CTES["seen"][1]
_ALL_HEADS = _HEADS.replace(" WHERE o_orderkey IN (SELECT order_key FROM scene_rows)", "")
_ALL_SEEN = _SEEN.replace("scene_heads h JOIN scene_rows s", "scene_heads h LEFT JOIN scene_rows s")

_KEPT = [("scene_heads h JOIN scene_rows s", "scene_heads h LEFT JOIN scene_rows s")]
#: What else has to change in a query's SQL: objects are counted, not joined rows.
_MORE: dict[str, list[tuple[str, str]]] = {
    "object_overlap": [],
    "label_coverage": [("GROUP BY customer) GROUP BY label", "GROUP BY customer) AND label IS NOT NULL GROUP BY label")],
    "symbol_coverage": [],
    "distinct_states": [],
    "policy_ask_if_ambiguous": [],
    "policy_always_ask": [],
    "policy_predict_assist": [],
    "policy_bayes": [],
    "robustness_curve": [],
    "perturb_poses": [],
    "perturb_objects": [("SELECT id, string_agg(", "SELECT id, coalesce(string_agg("), ("AS cells, string_agg(nl, '|' ORDER BY ix) AS labels", "AS cells, coalesce(string_agg(nl, '|' ORDER BY ix), '') AS labels"), ("'|' ORDER BY ix) AS cells", "'|' ORDER BY ix), '') AS cells")],
    "perturb_candidates": [],
    "question_ig": [],
    "simulated_replies": [],
    "contract_ig": [],
    "scenario_rules": [*_KEPT, ("h.id, COUNT(*) AS n,", "h.id, COUNT(s.id) AS n,")],
    "scenario_contract": [*_KEPT, ("COUNT(*) AS objects", "COUNT(s.id) AS objects")],
    "path_lengths": [],
    "label_overlay": [],
    "label_stubs": [],
    "extraction_report": [*_KEPT, ("COUNT(*) < 2 OR", "COUNT(s.id) < 2 OR")],
    "decision_rules": [],
    "contract_rows": [],
    "scenario_round_trip": [*_KEPT, ("string_agg(s.id || ':' || s.label, ',' ORDER BY s.slot) AS digest", "coalesce(string_agg(s.id || ':' || s.label, ',' ORDER BY s.slot), '') AS digest")],
    "contract_ids": [],
    "contract_shapes": [],
    "annotation_queue": [],
    "contract_formats": [],
}


def _all_orders(sql: str, more: list[tuple[str, str]]) -> str:
    for old, new in ((_HEADS, _ALL_HEADS), (_SEEN, _ALL_SEEN), *more):
        if old in (_HEADS, _SEEN) and old not in sql:
            continue
        if old not in sql:
            raise ValueError(f"not in the SQL: {old}")
        sql = sql.replace(old, new)
    return sql


def _furnished(fn):
    return lambda t: fn(Furnished(t.spark, t.directory))


for _name, _changes in _MORE.items():
    QUERIES[f"{_name}_all_orders"] = QUERIES[_name]
    ORACLE[f"{_name}_all_orders"] = _all_orders(ORACLE[_name], _changes)
    QUERIES[_name] = _furnished(QUERIES[_name])
