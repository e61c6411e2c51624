"""Rewrites that the optimizer does not make: the order of chained products."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessel.operators.products import Hint, gemm_spmm, spmm_gemm


def product_cost(nnz: int, n: int, width_in: int, width_out: int) -> dict[str, int]:
    """Multiplications of A (X W) and of (A X) W; both pay the dense product, the sparse one works at either width."""
    dense = n * width_in * width_out
    return {"gemm_first": nnz * width_out + dense, "spmm_first": nnz * width_in + dense}


def graph_product(a: DataFrame, x: DataFrame, w: DataFrame, nnz: int, n: int, width_in: int, width_out: int, hint: Hint = Hint()) -> DataFrame:
    """``A X W`` in the cheaper order."""
    cost = product_cost(nnz, n, width_in, width_out)
    return gemm_spmm(a, x, w, hint=hint) if cost["gemm_first"] <= cost["spmm_first"] else spmm_gemm(a, x, w, hint=hint)


def adjacent_fusable(loops: list[tuple[str, str]]) -> list[int]:
    """Indices k where loop k's exit is loop k+1's entry; ``loops`` are (entry, exit) labels."""
    return [k for k in range(len(loops) - 1) if loops[k][1] == loops[k + 1][0]]
