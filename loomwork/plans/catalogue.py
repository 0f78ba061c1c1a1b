"""Registered queries over the test tables, each with the SQL that other engines answer it by."""

from __future__ import annotations

from loomwork.registry import Registry

registry = Registry()

from loomwork.plans import queries_kernels, queries_relational, queries_sources  # noqa: E402, F401

#: Where the other engine counts in wider types than this one.
CASTS = {
    "agg_pivot": {"F": "BIGINT", "O": "BIGINT", "P": "BIGINT"}, "defect_pareto": {"rank": "INTEGER"}, "fn_compat": {"n": "INTEGER"}, "fn_date": dict.fromkeys(("y", "m", "d", "h", "days"), "INTEGER"),
    "fn_extract": dict.fromkeys(("y", "mo", "d", "h", "mi", "s"), "INTEGER"), "fn_string": {"n": "INTEGER"}, "join_range": {"low": "DOUBLE", "high": "DOUBLE"}, "part_salted_sum": {"sum_o_custkey": "BIGINT"}, "part_slices": {"slice": "INTEGER"},
    "recommend_items": {"rank": "INTEGER"}, "reduce_tree": {"o_orderkey": "BIGINT"}, "win_dense_rank": {"v": "INTEGER"}, "win_ntile": {"v": "INTEGER"}, "win_rank": {"v": "INTEGER"}, "win_row_number": {"v": "INTEGER"}, "win_top_of_each": {"rank": "INTEGER"},
}
for _name, _cols in CASTS.items():
    registry.sql[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in _cols.items())}) FROM ({registry.sql[_name]}) AS answer"
