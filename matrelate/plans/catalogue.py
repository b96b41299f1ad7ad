"""Every operator as a query on the driver's tables, with SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, bounds, density, dense, inverse, polynomial, transcendental
from ..functions.control import SolverParameters
from ..matrix import Matrix, solve
from ..operators import aggregate, algebra, generate, kernels, select
from ..sources import binary, matrix_market, tables
from .sqlchain import Chain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
N = tables.NATIONS
TIGHT = SolverParameters(converge_diff=1e-10, max_iterations=200)
#: For solvers that run as Spark jobs: each round costs some, and errors square from round to round.
FAR = SolverParameters(converge_diff=1e-7, max_iterations=100)


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def rounded(m: Matrix | DataFrame, digits: int = 6) -> DataFrame:
    """Entries as a result: rounded, without negative zero, without what rounds to zero."""
    df = m.df if isinstance(m, Matrix) else m
    values = [c for c in df.columns if c not in ("i", "j")]
    df = df.select("i", "j", *[(F.round(c, digits) + 0.0).alias(c) for c in values])
    keep = F.lit(False)
    for c in values:
        keep = keep | (F.abs(c) > 0)
    return df.where(keep)


def _entries(name: str, make: Callable[[Matrix], Matrix | DataFrame], base: str, body: str) -> None:
    """A query on one base matrix that returns entries, and its SQL body over the base."""
    source = getattr(tables, base.lower())
    chain = Chain(base)
    ORACLES[name] = chain.entries(chain.add(body))
    QUERIES[name] = lambda spark, d: rounded(make(source(spark, d)))


# -- projection and selection --------------------------------------------

_entries("transpose", select.transpose, "SP", "SELECT j AS i, i AS j, v FROM SP")
_entries("scale", lambda m: algebra.scale(m, 0.5), "SP", "SELECT i, j, v * 0.5 AS v FROM SP")
_entries("filter", lambda m: select.filter_small(m, 150.0), "SP", "SELECT * FROM SP WHERE abs(v) > 150")
_entries("slice", lambda m: select.slice_range(m, 11, 30, 41, 50), "SP", "SELECT i - 10 AS i, j - 40 AS j, v FROM SP WHERE i BETWEEN 11 AND 30 AND j BETWEEN 41 AND 50")
_entries("block", lambda m: select.block(m, 5, 20, 60, 90), "SP", "SELECT * FROM SP WHERE i >= 5 AND i < 20 AND j >= 60 AND j < 90")
_entries("resize", lambda m: select.resize(m, 40), "SP", "SELECT * FROM SP WHERE i <= 40 AND j <= 40")
_entries("extract_row", lambda m: select.extract_row(m, 7), "SP", "SELECT 1::BIGINT AS i, j, v FROM SP WHERE i = 7")
_entries("extract_column", lambda m: select.extract_column(m, 9), "SP", "SELECT i, 1::BIGINT AS j, v FROM SP WHERE j = 9")
_entries("shift", lambda m: select.shift(m.df, 100, 200), "SP", "SELECT i + 100 AS i, j + 200 AS j, v FROM SP")
_entries(
    "map_expr", lambda m: select.map_entries(m, F.col("i") >= F.col("j"), i=F.col("j"), j=F.col("i"), v=F.col("v") * 2.0 + 1.0),
    "SP", "SELECT j AS i, i AS j, v * 2 + 1 AS v FROM SP WHERE i >= j",
)


def _halve_upper(batch):
    batch = batch[batch["i"] <= batch["j"]].copy()
    batch["v"] = batch["v"] / 2
    return batch


_entries("map_udf", lambda m: select.map_function(m, _halve_upper), "SP", "SELECT i, j, v / 2 AS v FROM SP WHERE i <= j")


def _by_array(batch, factors):
    batch = batch.copy()
    batch["v"] = batch["v"] * factors[batch["i"].to_numpy() - 1]
    return batch


_entries("map_array", lambda m: select.map_function(m, _by_array, np.arange(1, 101) / 10), "SP", "SELECT i, j, v * (i / 10.0) AS v FROM SP")
_entries(
    "compose_split", lambda m: select.compose([[select.split(m, [40, 60], [70, 30])[1][1], select.split(m, [40, 60], [70, 30])[1][0]]]),
    "SP", "SELECT i - 40 AS i, CASE WHEN j > 70 THEN j - 70 ELSE j + 30 END AS j, v FROM SP WHERE i > 40",
)

# -- generators ------------------------------------------------------------


@query("identity", "SELECT range AS i, range AS j, 1.0::DOUBLE AS v FROM range(1, 101)")
def _identity(spark, d):
    return generate.identity(spark, 100).df


@query("dense_ones", "SELECT a.range AS i, b.range AS j, 1.0::DOUBLE AS v FROM range(1, 41) a, range(1, 41) b")
def _dense_ones(spark, d):
    return generate.dense_ones(spark, 40).df


@query("permutation_rows", "SELECT range AS i, 51 - range AS j, 1.0::DOUBLE AS v FROM range(1, 51)")
def _permutation_rows(spark, d):
    return generate.permutation_matrix(generate.permutation(spark, 50, "reverse"), 50).df


@query("permutation_cols", "SELECT 51 - range AS i, range AS j, 1.0::DOUBLE AS v FROM range(1, 51)")
def _permutation_cols(spark, d):
    return generate.permutation_matrix(generate.permutation(spark, 50, "reverse"), 50, by_rows=False).df


@query("banded", "SELECT i, j, -0.005 * exp(-0.001 * r) / r AS v FROM (SELECT a.range AS i, b.range AS j, abs(a.range - b.range + 0.5) AS r FROM range(1, 201) a, range(1, 201) b WHERE abs(a.range - b.range) <= 4)".join(["SELECT i, j, round(v, 9) + 0.0 AS v FROM (", ")"]))
def _banded(spark, d):
    r = F.abs(F.col("i") - F.col("j") + 0.5)
    m = generate.banded(spark, 200, 4, -0.005 * F.exp(-0.001 * r) / r)
    return m.df.select("i", "j", (F.round("v", 9) + 0.0).alias("v"))


_entries(
    "symmetrize_triplets", lambda m: generate.symmetrize_triplets(m.df.where("i >= j"), "symmetric"),
    "SP", "SELECT i, j, v FROM SP WHERE i >= j UNION ALL SELECT j, i, v FROM SP WHERE i > j",
)
_entries(
    "symmetrize_skew", lambda m: generate.symmetrize_triplets(m.df.where("i > j"), "skew-symmetric"),
    "SP", "SELECT i, j, v FROM SP WHERE i > j UNION ALL SELECT j, i, -v FROM SP WHERE i > j",
)
_entries("from_triplets", lambda m: Matrix.from_triplets(select.merge_lists(m.df, m.df, m.df), 100), "SP", "SELECT i, j, v * 3 AS v FROM SP")
_entries("merge_lists", lambda m: select.merge_lists(m.df, select.shift(m.df, 100, 0)), "SP", "SELECT i, j, v FROM SP UNION ALL SELECT i + 100, j, v FROM SP")


def _complex(spark, d) -> Matrix:
    """NN as real part, NN^T as imaginary part."""
    m = tables.nn(spark, d)
    return generate.to_complex(m).with_df(
        m.df.select("i", "j", F.col("v").alias("re"), F.lit(0.0).alias("im")).unionByName(m.df.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("re"), F.col("v").alias("im"))).groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    )


_CC = "CC AS (SELECT i, j, sum(re) AS re, sum(im) AS im FROM (SELECT i, j, v AS re, 0.0 AS im FROM NN UNION ALL SELECT j, i, 0.0, v FROM NN) GROUP BY i, j)"
_NN = f"WITH NN AS ({tables.SQL['NN']}), {_CC}\n"


@query("to_complex", _NN + "SELECT i, j, v AS re, 0.0::DOUBLE AS im FROM NN")
def _to_complex(spark, d):
    return generate.to_complex(tables.nn(spark, d)).df


@query("to_real", _NN + "SELECT i, j, re AS v FROM CC")
def _to_real(spark, d):
    return generate.to_real(_complex(spark, d)).df


@query("conjugate", _NN + "SELECT i, j, re, -im AS im FROM CC")
def _conjugate(spark, d):
    return select.conjugate(_complex(spark, d)).df


@query("conjugate_transpose", _NN + "SELECT j AS i, i AS j, re, -im AS im FROM CC")
def _conjugate_transpose(spark, d):
    return select.conjugate(select.transpose(_complex(spark, d))).df


@query("gemm_complex", _NN + "SELECT a.i, b.j, sum(a.re * b.re - a.im * b.im) AS re, sum(a.re * b.im + a.im * b.re) AS im FROM CC a JOIN CC b ON a.j = b.i GROUP BY a.i, b.j")
def _gemm_complex(spark, d):
    m = _complex(spark, d).settled()
    return algebra.gemm(m, m, threshold=-1.0).df


@query("gemm_blocked_complex", _NN + "SELECT a.i, b.j, sum(a.re * b.re - a.im * b.im) AS re, sum(a.re * b.im + a.im * b.re) AS im FROM CC a JOIN CC b ON a.j = b.i GROUP BY a.i, b.j")
def _gemm_blocked_complex(spark, d):
    m = _complex(spark, d).settled()
    return kernels.gemm_blocked(m, m, threshold=-1.0, size=8).df.where(f"i <= {N} and j <= {N}")


@query("symmetrize_hermitian", _NN + "SELECT i, j, re, im FROM CC WHERE i >= j UNION ALL SELECT j, i, re, -im FROM CC WHERE i > j")
def _symmetrize_hermitian(spark, d):
    return generate.symmetrize_triplets(_complex(spark, d).df.where("i >= j"), "hermitian")


@query("gemm_mixed", _NN + "SELECT a.i, b.j, sum(a.v * b.re) AS re, sum(a.v * b.im) AS im FROM NN a JOIN CC b ON a.j = b.i GROUP BY a.i, b.j")
def _gemm_mixed(spark, d):
    return algebra.gemm(tables.nn(spark, d), _complex(spark, d), threshold=-1.0).df


@query("dot_complex", _NN + "SELECT sum(a.re * b.v) AS re, sum(-a.im * b.v) AS im FROM CC a JOIN NN b ON a.i = b.i AND a.j = b.j")
def _dot_complex(spark, d):
    return algebra.dot_table(_complex(spark, d), tables.nn(spark, d))


@query("scale_complex", _NN + "SELECT i, j, re * 2 - im * 3 AS re, re * 3 + im * 2 AS im FROM CC")
def _scale_complex(spark, d):
    return algebra.scale(_complex(spark, d), 2 + 3j).df


@query("filter_complex", _NN + "SELECT i, j, re, im FROM CC WHERE re * re + im * im > 4000000")
def _filter_complex(spark, d):
    return select.filter_small(_complex(spark, d), 2000.0).df


@query("grand_sum_complex", _NN + "SELECT sum(re) AS re, sum(im) AS im FROM CC")
def _grand_sum_complex(spark, d):
    return aggregate.grand_sum_table(_complex(spark, d))


# -- joins -------------------------------------------------------------------


def _chain_query(name: str, bases: list[str], build: Callable[[Chain], str], digits: int = 6):
    """Registers the SQL of a chain for the query defined below it."""
    chain = Chain(*bases)
    return query(name, chain.entries(build(chain), digits))


def _gemm_sql(c: Chain) -> str:
    return c.mul("SP", c.transpose("SP"))


@_chain_query("gemm", ["SP"], _gemm_sql)
def _gemm(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(algebra.gemm(m, select.transpose(m)))


@_chain_query("gemm_alpha_beta", ["SP"], lambda c: c.lin((2, c.mul("SP", "SP")), (3, "SP")))
def _gemm_alpha_beta(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(algebra.gemm(m, m, alpha=2.0, beta=3.0, c=m))


@_chain_query("gemm_threshold", ["SP"], lambda c: c.add(f"SELECT i, j, v * 0.5 AS v FROM {c.mul('SP', 'SP')} WHERE abs(v * 0.5) > 1100000"))
def _gemm_threshold(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(algebra.gemm(m, m, alpha=0.5, threshold=1_100_000.0))


@_chain_query("gemm_blocked", ["SP"], _gemm_sql)
def _gemm_blocked(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(kernels.gemm_blocked(m, select.transpose(m), size=32))


@_chain_query("gemm_kernel_choice", ["SP"], lambda c: c.mul("SP", "SP"))
def _gemm_choice(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(kernels.multiply(m, m))


@_chain_query("gemm_rectangular", ["UE"], lambda c: c.mul(c.transpose("UE"), "UE"))
def _gemm_rectangular(spark, d):
    m = Matrix.of(tables.ue(spark, d), rows=1 << 31, cols=6).settled()
    return rounded(algebra.gemm(select.transpose(m), m))


@_chain_query("gram_embeddings", ["EG"], lambda c: c.mul(c.transpose("EG"), "EG"), 4)
def _gram_embeddings(spark, d):
    m = tables.eg(spark, d).settled()
    return rounded(algebra.gemm(select.transpose(m), m), 4)


@_chain_query("axpy", ["SP"], lambda c: c.lin((-0.5, "SP"), (1, c.transpose("SP"))))
def _axpy(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(algebra.axpy(m, select.transpose(m), -0.5))


@_chain_query("axpy_threshold", ["SP"], lambda c: c.add(f"SELECT * FROM {c.lin((-1, 'SP'), (1, c.transpose('SP')))} WHERE abs(v) > 60"))
def _axpy_threshold(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(algebra.axpy(m, select.transpose(m), -1.0, threshold=60.0))


@_chain_query("hadamard", ["SP"], lambda c: c.add("SELECT a.i, a.j, a.v * b.v AS v FROM SP a JOIN SP b ON a.i = b.j AND a.j = b.i"))
def _hadamard(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(algebra.hadamard(m, select.transpose(m)))


@_chain_query("gemm_transposed", ["SP"], lambda c: c.mul(c.transpose("SP"), c.transpose("SP")))
def _gemm_transposed(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(algebra.gemm(m, m, transpose_a=True, transpose_b=True))


@_chain_query("vector_add", ["SP"], lambda c: c.add("SELECT 1::BIGINT AS i, j, sum(v) AS v FROM (SELECT j, v * 2 AS v FROM SP WHERE i = 3 UNION ALL SELECT j, v FROM SP WHERE i = 4) GROUP BY j"))
def _vector_add(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(algebra.axpy(select.extract_row(m, 3), select.extract_row(m, 4), 2.0))


@_chain_query("vector_pairwise", ["SP"], lambda c: c.add("SELECT 1::BIGINT AS i, a.j, a.v * b.v AS v FROM SP a JOIN SP b ON a.j = b.j WHERE a.i = 3 AND b.i = 4"))
def _vector_pairwise(spark, d):
    m = tables.sp(spark, d).settled()
    return rounded(algebra.hadamard(select.extract_row(m, 3), select.extract_row(m, 4)))


def _table_query(name: str, bases: list[str], body: str):
    return query(name, Chain(*bases).select(body))


@_table_query("dot", ["SP"], "SELECT sum(a.v * b.v) AS v FROM SP a JOIN SP b ON a.i = b.j AND a.j = b.i")
def _dot(spark, d):
    m = tables.sp(spark, d).settled()
    return algebra.dot_table(m, select.transpose(m))


@_table_query("dot_columns", ["SP"], "SELECT a.j, sum(a.v * b.v) AS v FROM SP a JOIN SP b ON a.i = b.i WHERE b.j = 5 GROUP BY a.j")
def _dot_columns(spark, d):
    return algebra.dot_columns(tables.sp(spark, d).settled(), 5)


@_table_query("dot_columns_pivoted", ["SP"], "SELECT a.j, sum(a.v * b.v) AS v FROM SP a JOIN SP b ON a.i = b.i WHERE b.j = 5 AND a.j % 10 = 0 GROUP BY a.j")
def _dot_columns_pivoted(spark, d):
    return algebra.dot_columns(tables.sp(spark, d).settled(), 5, spark.range(10, 101, 10).withColumnRenamed("id", "j"))


@_table_query("vector_dot", ["SP"], "SELECT sum(a.v * b.v) AS v FROM SP a JOIN SP b ON a.j = b.j WHERE a.i = 3 AND b.i = 4")
def _vector_dot(spark, d):
    m = tables.sp(spark, d).settled()
    return algebra.dot_table(select.extract_row(m, 3), select.extract_row(m, 4))


@_chain_query("redistribute", ["SP"], lambda c: "SP")
def _redistribute(spark, d):
    return rounded(select.redistribute(tables.sp(spark, d), 7, "ij"))


@_chain_query("diagonal_scale", ["SP"], lambda c: c.add("SELECT i, j, CASE WHEN j % 2 = 0 THEN v * (j / 4.0) ELSE v END AS v FROM SP"))
def _diagonal_scale(spark, d):
    factors = spark.range(2, 101, 2).select(F.col("id").alias("j"), (F.col("id") / 4.0).alias("f"))
    return rounded(algebra.diagonal_scale(tables.sp(spark, d), factors))


@_table_query("snap", ["SP"], "SELECT p.i, p.j, coalesce(s.v, 0.0) AS v FROM (SELECT range AS i, range % 50 + 60 AS j FROM range(1, 121)) p LEFT JOIN SP s ON s.i = p.i AND s.j = p.j")
def _snap(spark, d):
    pattern = Matrix.of(spark.range(1, 121).select(F.col("id").alias("i"), (F.col("id") % 50 + 60).alias("j"), F.lit(1.0).alias("v")), 120)
    return algebra.snap(tables.sp(spark, d), pattern).df


@_chain_query("permute", ["SP"], lambda c: c.add("SELECT 101 - i AS i, 101 - j AS j, v FROM SP"))
def _permute(spark, d):
    return rounded(algebra.permute(tables.sp(spark, d), generate.permutation(spark, 100, "reverse")))


@_chain_query("undo_permute", ["SP"], lambda c: "SP")
def _undo_permute(spark, d):
    perm = generate.permutation(spark, 100, "random", seed=4)
    return rounded(algebra.permute(algebra.permute(tables.sp(spark, d), perm), perm, undo=True))


@_chain_query("permute_limited", ["SP"], lambda c: "SP")
def _permute_limited(spark, d):
    perm = generate.permutation(spark, 100, "random", seed=4, limit=60)
    return rounded(algebra.permute(algebra.permute(tables.sp(spark, d), perm), perm, undo=True))


@_chain_query("similarity", ["DD"], lambda c: c.mul(c.mul("DD", "DD"), c.transpose("DD")))
def _similarity(spark, d):
    m = tables.dd(spark, d).settled()
    return rounded(algebra.similarity(m, m, select.transpose(m)))


# -- aggregations --------------------------------------------------------------


@_table_query("grand_sum", ["SP"], "SELECT sum(v) AS v FROM SP")
def _grand_sum(spark, d):
    return aggregate.grand_sum_table(tables.sp(spark, d))


@_table_query("trace", ["SP"], "SELECT sum(v) AS trace FROM SP WHERE i = j")
def _trace(spark, d):
    return aggregate.trace_table(tables.sp(spark, d))


@_table_query("norm1", ["SP"], "SELECT max(s) AS norm FROM (SELECT sum(abs(v)) AS s FROM SP GROUP BY j)")
def _norm1(spark, d):
    return aggregate.norm1_table(tables.sp(spark, d))


@_table_query("column_norms", ["SP"], "SELECT j, sum(abs(v)) AS norm FROM SP GROUP BY j")
def _column_norms(spark, d):
    return aggregate.column_norms(tables.sp(spark, d))


@_table_query("sigma", ["SP"], "SELECT 1.0 / (norm * norm) AS sigma FROM (SELECT max(s) AS norm FROM (SELECT sum(abs(v)) AS s FROM SP GROUP BY j))")
def _sigma(spark, d):
    return aggregate.sigma_table(tables.sp(spark, d))


@_table_query("gershgorin", ["NS"], "SELECT min(c - r) AS lower, max(c + r) AS upper FROM (SELECT sum(CASE WHEN i = j THEN v ELSE 0 END) AS c, sum(CASE WHEN i <> j THEN abs(v) ELSE 0 END) AS r FROM NS GROUP BY j)")
def _gershgorin(spark, d):
    return aggregate.gershgorin_table(tables.ns(spark, d))


@_table_query("nnz", ["SP"], "SELECT count(*) AS nnz, count(*) / 10000.0 AS fill FROM SP")
def _nnz(spark, d):
    return aggregate.size_table(tables.sp(spark, d))


@_table_query("is_identity", ["SP"], "SELECT false AS is_identity")
def _is_identity(spark, d):
    return aggregate.is_identity_table(tables.sp(spark, d))


@_table_query("is_identity_true", [], "SELECT true AS is_identity")
def _is_identity_true(spark, d):
    return aggregate.is_identity_table(generate.identity(spark, 500))


@_table_query("asymmetry", ["NN"], "SELECT max(s) AS norm FROM (SELECT sum(abs(v)) AS s FROM (SELECT i, j, sum(v) AS v FROM (SELECT i, j, -v AS v FROM NN UNION ALL SELECT j, i, v FROM NN) GROUP BY i, j) GROUP BY j)")
def _asymmetry(spark, d):
    return algebra.asymmetry_table(tables.nn(spark, d).settled())


@_chain_query("symmetrize_matrix", ["NN"], lambda c: c.lin((0.5, "NN"), (0.5, c.transpose("NN"))))
def _symmetrize(spark, d):
    return rounded(algebra.symmetrize(tables.nn(spark, d).settled()))


@_table_query("sort_triplets", ["SP"], "SELECT i, j, v FROM SP ORDER BY j, i")
def _sort(spark, d):
    return select.sort_triplets(tables.sp(spark, d).df)


@_table_query("max_diagonal", ["SP"], "SELECT j, v FROM SP WHERE i = j ORDER BY v DESC, j LIMIT 1")
def _max_diagonal(spark, d):
    return aggregate.max_diagonal(tables.sp(spark, d))


# -- polynomials -----------------------------------------------------------------

HALVES = [2.0**-k for k in range(7)]
_STANDARD = lambda c: c.polynomial("DD", HALVES)


def _dd(spark, d) -> Matrix:
    return tables.dd(spark, d)


@_chain_query("horner", ["E", "DD"], _STANDARD)
def _horner(spark, d):
    return rounded(solve(polynomial.horner, _dd(spark, d), coefficients=HALVES))


@_chain_query("horner_distributed", ["E", "DD"], _STANDARD)
def _horner_distributed(spark, d):
    return rounded(solve(polynomial.horner, _dd(spark, d), distributed=True, coefficients=HALVES))


@_chain_query("paterson_stockmeyer", ["E", "DD"], _STANDARD)
def _paterson(spark, d):
    return rounded(solve(polynomial.paterson_stockmeyer, _dd(spark, d), coefficients=HALVES))


def _recurrence(c: Chain, first: float, step: Callable[[int], float]) -> str:
    before, now = "E", c.lin((first, "DD"))
    out = [(HALVES[0], before), (HALVES[1], now)]
    for k in range(1, len(HALVES) - 1):
        before, now = now, c.lin((2, c.mul("DD", now)), (-step(k), before))
        out.append((HALVES[k + 1], now))
    return c.lin(*out)


@_chain_query("chebyshev", ["E", "DD"], lambda c: _recurrence(c, 1, lambda k: 1))
def _chebyshev(spark, d):
    return rounded(solve(polynomial.chebyshev, _dd(spark, d), coefficients=HALVES))


@_chain_query("chebyshev_factorized", ["E", "DD"], lambda c: _recurrence(c, 1, lambda k: 1))
def _chebyshev_factorized(spark, d):
    return rounded(solve(polynomial.chebyshev_factorized, _dd(spark, d), coefficients=HALVES))


@_chain_query("hermite", ["E", "DD"], lambda c: _recurrence(c, 2, lambda k: 2 * k))
def _hermite(spark, d):
    return rounded(solve(polynomial.hermite, _dd(spark, d), coefficients=HALVES))


# -- inverse, roots, sign --------------------------------------------------------


@_chain_query("invert", ["DD"], lambda c: c.inverse("DD"))
def _invert(spark, d):
    return rounded(solve(inverse.invert, _dd(spark, d), parameters=TIGHT))


@_chain_query("invert_distributed", ["DD"], lambda c: c.inverse("DD"))
def _invert_distributed(spark, d):
    return rounded(solve(inverse.invert, _dd(spark, d), distributed=True, parameters=FAR))


@_chain_query("pseudo_inverse", ["DD"], lambda c: c.inverse("DD"))
def _pseudo_inverse(spark, d):
    return rounded(solve(inverse.pseudo_inverse, _dd(spark, d), parameters=TIGHT))


@_chain_query("sqrt", ["E", "DD"], lambda c: c.sqrt_pair("DD")[0])
def _sqrt(spark, d):
    return rounded(solve(inverse.square_root, _dd(spark, d), parameters=TIGHT))


@_chain_query("inverse_sqrt", ["E", "DD"], lambda c: c.sqrt_pair("DD")[1])
def _inverse_sqrt(spark, d):
    return rounded(solve(inverse.inverse_square_root, _dd(spark, d), parameters=TIGHT))


@_chain_query("sqrt_distributed", ["E", "DD"], lambda c: c.sqrt_pair("DD")[0])
def _sqrt_distributed(spark, d):
    return rounded(solve(inverse.square_root, _dd(spark, d), distributed=True, parameters=FAR))


for _order in (2, 3):
    _chain = Chain("E", "DD")
    ORACLES[f"sqrt_order{_order}"] = _chain.entries(_chain.sqrt_pair("DD")[0])
    QUERIES[f"sqrt_order{_order}"] = lambda spark, d, o=_order: rounded(solve(inverse.square_root, _dd(spark, d), parameters=TIGHT, order=o))


def _newton_root(c: Chain, p: int) -> str:
    """p-th root of DD by the coupled Newton iteration on 2 p + 10 rounds."""
    m, x = c.lin((0.5, "DD")), "E"
    for _ in range(2 * p + 12):
        t = c.lin(((p + 1) / p, "E"), (-1 / p, m))
        x = c.mul(x, t)
        power = t
        for _ in range(p - 1):
            power = c.mul(power, t)
        m = c.mul(power, m)
    # x tends to (DD / 2)^(-1/p)
    return c.lin((0.5 ** (1 / p), x))


for _p in (3, 5):
    _chain = Chain("E", "DD")
    ORACLES[f"inverse_root_{_p}"] = _chain.entries(_newton_root(_chain, _p), 5)
    QUERIES[f"inverse_root_{_p}"] = lambda spark, d, p=_p: rounded(solve(inverse.inverse_root, _dd(spark, d), p=p, parameters=TIGHT), 5)
    _chain = Chain("E", "DD")
    ORACLES[f"root_{_p}"] = _chain.entries(_chain.inverse(_newton_root(_chain, _p)), 5)
    QUERIES[f"root_{_p}"] = lambda spark, d, p=_p: rounded(solve(inverse.root, _dd(spark, d), p=p, parameters=TIGHT), 5)


@_chain_query("sign", ["HH"], lambda c: c.sign("HH"))
def _sign(spark, d):
    return rounded(solve(inverse.sign, tables.hh(spark, d), parameters=TIGHT))


@_chain_query("sign_distributed", ["HH"], lambda c: c.sign("HH"))
def _sign_distributed(spark, d):
    return rounded(solve(inverse.sign, tables.hh(spark, d), distributed=True, parameters=FAR))


def _polar_sql(c: Chain) -> str:
    # DD is positive definite, so the unitary factor of HH DD is what remains of it after dividing by its own modulus
    m = c.mul("HH", "DD")
    x = c.lin((f"1.0 / {c.norm1(m)}", m))
    for _ in range(45):
        x = c.lin((1.5, x), (-0.5, c.mul(x, c.mul(c.transpose(x), x))))
    return x


@_chain_query("polar", ["HH", "DD"], _polar_sql)
def _polar(spark, d):
    m = algebra.gemm(tables.hh(spark, d), tables.dd(spark, d))
    return rounded(solve(inverse.polar, m, parameters=TIGHT)[0])


@_chain_query("polar_factor", ["HH", "DD"], lambda c: c.mul(c.transpose(_polar_sql(c)), c.mul("HH", "DD")))
def _polar_factor(spark, d):
    """The second factor, which is positive semidefinite."""
    m = algebra.gemm(tables.hh(spark, d), tables.dd(spark, d))
    return rounded(solve(inverse.polar, m, parameters=TIGHT)[1])


@_chain_query("cg_solve", ["DD", "HH"], lambda c: c.mul(c.inverse("DD"), "HH"))
def _cg(spark, d):
    return rounded(solve(inverse.conjugate_gradient, _dd(spark, d), tables.hh(spark, d), parameters=TIGHT))


@_chain_query("cg_distributed", ["DD", "HH"], lambda c: c.mul(c.inverse("DD"), "HH"))
def _cg_distributed(spark, d):
    return rounded(solve(inverse.conjugate_gradient, _dd(spark, d), tables.hh(spark, d), distributed=True, parameters=SolverParameters(converge_diff=1e-9)))


# -- transcendental --------------------------------------------------------------


def _exp_sql(c: Chain, a: str = "DD") -> str:
    small = c.lin((0.125, a))
    return c.squared(c.polynomial(small, [1 / math.factorial(k) for k in range(15)]), 3)


for _name, _f in {"exp": transcendental.exponential, "exp_pade": transcendental.exponential_pade, "exp_taylor": transcendental.exponential_taylor}.items():
    _chain = Chain("E", "DD")
    ORACLES[_name] = _chain.entries(_exp_sql(_chain))
    QUERIES[_name] = lambda spark, d, f=_f: rounded(solve(f, _dd(spark, d), parameters=TIGHT))


_chain = Chain("E", "DD")
ORACLES["exp_distributed"] = _chain.entries(_exp_sql(_chain))
QUERIES["exp_distributed"] = lambda spark, d: rounded(solve(transcendental.exponential, _dd(spark, d), distributed=True, parameters=FAR))


def _log_sql(c: Chain) -> str:
    """2^4 times the series of the logarithm of the 16th root, by artanh."""
    x = "DD"
    for _ in range(4):
        x, _inverse = c.sqrt_pair(x)
    low, high = c.lin((1, x), (-1, "E")), c.lin((1, x), (1, "E"))
    t = c.mul(low, c.inverse(high))
    t2 = c.mul(t, t)
    series = c.polynomial(t2, [2.0 / (2 * k + 1) for k in range(8)])
    return c.lin((16, c.mul(t, series)))


for _name, _f in {"log": transcendental.logarithm, "log_taylor": transcendental.logarithm_taylor}.items():
    _chain = Chain("E", "DD")
    ORACLES[_name] = _chain.entries(_log_sql(_chain))
    QUERIES[_name] = lambda spark, d, f=_f: rounded(solve(f, _dd(spark, d), parameters=TIGHT))


def _sin_sql(c: Chain) -> str:
    square = c.mul("DD", "DD")
    return c.mul("DD", c.polynomial(square, [(-1) ** k / math.factorial(2 * k + 1) for k in range(11)]))


def _cos_sql(c: Chain) -> str:
    return c.polynomial(c.mul("DD", "DD"), [(-1) ** k / math.factorial(2 * k) for k in range(12)])


for _name, _f, _sql in [
    ("sin", transcendental.sine, _sin_sql), ("cos", transcendental.cosine, _cos_sql),
    ("sin_taylor", transcendental.sine_taylor, _sin_sql), ("cos_taylor", transcendental.cosine_taylor, _cos_sql),
]:
    _chain = Chain("E", "DD")
    ORACLES[_name] = _chain.entries(_sql(_chain))
    QUERIES[_name] = lambda spark, d, f=_f: rounded(solve(f, _dd(spark, d), parameters=TIGHT))

# -- dense -------------------------------------------------------------------------

_DENSE = {
    "dense_exp": (dense.exponential, _exp_sql), "dense_log": (dense.logarithm, _log_sql), "dense_invert": (dense.invert, lambda c: c.inverse("DD")),
    "dense_sqrt": (dense.square_root, lambda c: c.sqrt_pair("DD")[0]), "dense_inverse_sqrt": (dense.inverse_square_root, lambda c: c.sqrt_pair("DD")[1]),
    "dense_sin": (dense.sine, _sin_sql), "dense_cos": (dense.cosine, _cos_sql),
}
for _name, (_f, _sql) in _DENSE.items():
    _chain = Chain("E", "DD")
    ORACLES[_name] = _chain.entries(_sql(_chain))
    QUERIES[_name] = lambda spark, d, f=_f: rounded(f(_dd(spark, d)))


@_chain_query("dense_sign", ["HH"], lambda c: c.sign("HH"))
def _dense_sign(spark, d):
    return rounded(dense.sign(tables.hh(spark, d)))


def _rounded_values(df: DataFrame) -> DataFrame:
    return df.select("k", (F.round("value", 6) + 0.0).alias("value"))


@query("eigenvalues")
def _eigenvalues(spark, d):
    return _rounded_values(dense.eigendecomposition(tables.ns(spark, d))[0])


@query("eigenvalues_partial")
def _eigenvalues_partial(spark, d):
    return _rounded_values(dense.eigendecomposition(tables.ns(spark, d), 5)[0])


def _moments(values: DataFrame, powers: list[int], scale: float = 1.0) -> DataFrame:
    """Sums of powers of eigenvalues, which are traces of powers of the matrix."""
    sums = [F.sum(F.pow(F.col("value") / scale, F.lit(float(p)))).alias(str(p)) for p in powers]
    return values.agg(*sums).select(F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("power"), (F.round(F.col(f"`{p}`"), 6) + 0.0).alias("value")) for p in powers])).alias("m")).select("m.*")


def _moments_sql(c: Chain, m: str, powers: list[int]) -> str:
    """Traces of powers of a matrix expression."""
    power, found = m, []
    for p in range(1, max(powers) + 1):
        if p > 1:
            power = c.mul(power, m)
        if p in powers:
            found.append(f"SELECT {p}::BIGINT AS power, round({c.trace(power)}, 6) + 0.0 AS value")
    return c.select(" UNION ALL ".join(found))


_chain = Chain("DD")


@query("eigenvalue_moments", _moments_sql(_chain, "DD", [1, 2, 3, 4, 5]))
def _eigenvalue_moments(spark, d):
    return _moments(dense.eigendecomposition(_dd(spark, d))[0], [1, 2, 3, 4, 5])


_chain = Chain("HH", "DD")
_chain_product = _chain.mul("HH", "DD")


@query("singular_value_moments", _moments_sql(_chain, _chain.mul(_chain.transpose(_chain_product), _chain_product), [1, 2, 3]))
def _singular_value_moments(spark, d):
    """Squares of the singular values of a matrix that is not symmetric, against traces of powers of M^T M."""
    values = dense.singular_values(algebra.gemm(tables.hh(spark, d), tables.dd(spark, d)))[1]
    return _moments(values.select("k", (F.col("value") * F.col("value")).alias("value")), [1, 2, 3])


@_chain_query("eigen_reconstruction", ["NS"], lambda c: "NS")
def _eigen_reconstruction(spark, d):
    values, vectors = dense.eigendecomposition(tables.ns(spark, d))
    scaled = algebra.diagonal_scale(vectors, values.select(F.col("k").alias("j"), F.col("value").alias("f")))
    return rounded(algebra.gemm(scaled, select.transpose(vectors)), 4)


@query("singular_values")
def _singular_values(spark, d):
    return _rounded_values(dense.singular_values(tables.dd(spark, d))[1])


@_chain_query("svd_reconstruction", ["DD"], lambda c: "DD")
def _svd_reconstruction(spark, d):
    left, values, right = dense.singular_values(tables.dd(spark, d))
    scaled = algebra.diagonal_scale(left, values.select(F.col("k").alias("j"), F.col("value").alias("f")))
    return rounded(algebra.gemm(scaled, select.transpose(right)))


# -- factorizations ------------------------------------------------------------------


def _cholesky_sql(base: str, n: int) -> str:
    """Column by column, each a common table expression."""
    c = Chain(base)
    rest, columns = base, []
    for k in range(1, n + 1):
        column = c.add(f"SELECT i, {k}::BIGINT AS j, v / sqrt((SELECT v FROM {rest} WHERE i = {k} AND j = {k})) AS v FROM {rest} WHERE j = {k} AND i >= {k}")
        columns.append(column)
        if k < n:
            rest = c.add(f"SELECT r.i, r.j, r.v - coalesce(a.v * b.v, 0) AS v FROM {rest} r LEFT JOIN {column} a ON a.i = r.i LEFT JOIN {column} b ON b.i = r.j WHERE r.i > {k} AND r.j > {k}")
    return c.entries(c.add(" UNION ALL ".join(f"SELECT * FROM {x}" for x in columns)))


@query("cholesky", _cholesky_sql("RR", tables.REGIONS))
def _cholesky(spark, d):
    return rounded(solve(analysis.cholesky, tables.rr(spark, d)))


@query("cholesky_blocked", _cholesky_sql("RR", tables.REGIONS))
def _cholesky_blocked(spark, d):
    return rounded(analysis.cholesky_blocked(tables.rr(spark, d).settled(), panel=2))


@_chain_query("pivoted_cholesky", ["DD"], lambda c: "DD")
def _pivoted_cholesky(spark, d):
    """The factor differs with pivots; its product with its transpose does not."""
    factor = solve(analysis.pivoted_cholesky, _dd(spark, d), rank=N)
    return rounded(algebra.gemm(factor, select.transpose(factor)))


@_chain_query("pivoted_cholesky_distributed", ["RR"], lambda c: "RR")
def _pivoted_cholesky_distributed(spark, d):
    factor = solve(analysis.pivoted_cholesky, tables.rr(spark, d), rank=tables.REGIONS, distributed=True)
    return rounded(algebra.gemm(factor, select.transpose(factor)))


def _reduced_sql(c: Chain) -> str:
    return c.mul(_projector_sql(c), "HH")


def _trace_powers(m: Matrix, count: int) -> list[float]:
    array, power, out = m.to_numpy(), None, []
    for _ in range(count):
        power = array if power is None else power @ array
        out.append(float(np.trace(power)))
    return out


def _reduce_dimension(spark, d):
    """The reduced matrix is defined up to a rotation; traces of its powers are not."""
    m = solve(analysis.reduce_dimension, tables.hh(spark, d), dim=OCCUPIED, parameters=TIGHT)
    rows = [(k + 1, round(x, 5) + 0.0) for k, x in enumerate(_trace_powers(m, 4))]
    return spark.createDataFrame(rows, "power long, value double")


def _dominant_sql(c: Chain, m: str, rounds: int) -> str:
    """Largest eigenvalue in magnitude: powers by squaring tend to the projector on its vector."""
    x = m
    for _ in range(rounds):
        x = c.lin((f"1.0 / {c.norm1(x)}", x))
        x = c.mul(x, x)
    return f"({c.trace(c.mul(x, m))} / {c.trace(x)})"


_chain = Chain("NS")
_largest = _dominant_sql(_chain, "NS", 10)


@query("power_bounds", _chain.select(f"SELECT round({_largest}, 2) AS value"))
def _power_bounds(spark, d):
    value = solve(bounds.power_bounds, tables.ns(spark, d), parameters=SolverParameters(max_iterations=60, converge_diff=1e-9))
    return spark.createDataFrame([(round(value, 2),)], "value double")


@_table_query("load_balance", ["SP"], "SELECT min(n) AS smallest, max(n) AS largest FROM (SELECT count(*) AS n FROM SP GROUP BY j % 7)")
def _load_balance(spark, d):
    return aggregate.load_balance_table(select.redistribute(tables.sp(spark, d), 7, "cyclic"))


@_table_query("process_grid", ["SP"], "SELECT (floor((i - 1) * 3 / 100) * 4 + floor((j - 1) * 4 / 100))::BIGINT AS cell, count(*) AS entries FROM SP GROUP BY 1")
def _process_grid(spark, d):
    """Entries by the partition that holds them."""
    placed = select.ProcessGrid(3, 4).place(tables.sp(spark, d)).df
    return placed.groupBy(F.spark_partition_id().cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("entries"))


@_table_query("frobenius2", ["SP"], "SELECT sum(v * v) AS norm2 FROM SP")
def _frobenius2(spark, d):
    return aggregate.frobenius2_table(tables.sp(spark, d))


@_chain_query("gather_compose", ["SP"], lambda c: "SP")
def _gather_compose(spark, d):
    return rounded(select.gather_compose(select.split(tables.sp(spark, d).settled(), [30, 70], [55, 45]), 5))


@_chain_query("triplet_list", ["SP"], lambda c: c.add("SELECT j AS i, i AS j, v * 2 AS v FROM (SELECT * FROM SP WHERE NOT (i = 3 AND j = 4) UNION ALL SELECT 3, 4, 7.5) WHERE v < 180"))
def _triplet_list(spark, d):
    changed = select.set_triplet(tables.sp(spark, d).df, 3, 4, 7.5)
    return rounded(select.map_list(changed, F.col("v") < 180, i=F.col("j"), j=F.col("i"), v=F.col("v") * 2.0))


@_chain_query("split_computation", ["SP"], lambda c: c.lin((1, c.mul("SP", "SP")), (1, c.transpose("SP"))))
def _split_computation(spark, d):
    """Two independent products that run side by side, added up."""
    m = tables.sp(spark, d).settled()
    left, right = select.together(lambda: algebra.gemm(m, m).settled(), lambda: select.transpose(m).settled())
    return rounded(algebra.axpy(left, right))


# -- density matrices ------------------------------------------------------------------

OCCUPIED = 10


def _projector_sql(c: Chain) -> str:
    """(E - sign(H)) / 2: the gap of HH holds zero."""
    return c.lin((0.5, "E"), (-0.5, c.sign("HH")))


_chain = Chain("E", "HH")
ORACLES["reduce_dimension"] = _moments_sql(_chain, _reduced_sql(_chain), [1, 2, 3, 4]).replace(", 6) + 0.0 AS value", ", 5) + 0.0 AS value")
QUERIES["reduce_dimension"] = _reduce_dimension


def _density(name: str, f, digits: int = 5, **options) -> None:
    chain = Chain("E", "HH")
    ORACLES[name] = chain.entries(_projector_sql(chain), digits)

    def run(spark, d):
        h = tables.hh(spark, d)
        return rounded(solve(f, h, generate.identity(spark, N), **options)[0], digits)

    QUERIES[name] = run


for _name, _f in {"pm": density.pm, "trs2": density.trs2, "trs4": density.trs4, "hpcp": density.hpcp}.items():
    _density(_name, _f, ne=float(OCCUPIED), parameters=TIGHT)
_density("scale_and_fold", density.scale_and_fold, ne=float(OCCUPIED), homo=-0.9, lumo=0.5, parameters=TIGHT)
_density("dense_density", density.dense_density, ne=float(OCCUPIED))


_chain = Chain("E", "HH")
ORACLES["trs2_distributed"] = _chain.entries(_projector_sql(_chain), 5)


def _trs2_distributed(spark, d):
    return rounded(solve(density.trs2, tables.hh(spark, d), generate.identity(spark, N), distributed=True, ne=float(OCCUPIED), parameters=SolverParameters(converge_diff=1e-9))[0], 5)


QUERIES["trs2_distributed"] = _trs2_distributed

BETA = 3.0


def _boltzmann_sql(c: Chain) -> str:
    """exp(BETA H), by the exponential series of a 64th part."""
    return c.squared(c.polynomial(c.lin((BETA / 64, "HH")), [1 / math.factorial(k) for k in range(13)]), 6)


def _fermi_sql(c: Chain, boltzmann: str, mu: str) -> str:
    """(E + exp(BETA (H - mu)))^-1."""
    return c.inverse(c.lin((1, "E"), (f"exp(-{BETA} * {mu})", boltzmann)), 30)


def _canonical_sql(c: Chain) -> str:
    """Fermi occupation with OCCUPIED states: Newton's iteration for the chemical potential."""
    boltzmann, mu = _boltzmann_sql(c), "0.0"
    for _ in range(5):
        f = _fermi_sql(c, boltzmann, mu)
        slope = f"{BETA} * ({c.trace(f)} - {c.dot(f, f)})"
        mu = c.scalar(f"{mu} + ({OCCUPIED} - {c.trace(f)}) / ({slope})")
    return _fermi_sql(c, boltzmann, mu)


@_chain_query("dense_foe", ["E", "HH"], _canonical_sql)
def _dense_foe(spark, d):
    return rounded(solve(density.dense_density, tables.hh(spark, d), generate.identity(spark, N), ne=float(OCCUPIED), beta=BETA)[0])


#: Steps so small that the adaptive integration agrees with the closed form to four digits.
FINE_STEPS = SolverParameters(step_thresh=1e-8, converge_diff=1e-12, max_iterations=200_000)


@_chain_query("wom_gc", ["E", "HH"], lambda c: _fermi_sql(c, _boltzmann_sql(c), "0.0"), 4)
def _wom_gc(spark, d):
    return rounded(solve(density.wom_gc, tables.hh(spark, d), generate.identity(spark, N), mu=0.0, beta=BETA, parameters=FINE_STEPS)[0], 4)


@_chain_query("wom_c", ["E", "HH"], _canonical_sql, 4)
def _wom_c(spark, d):
    return rounded(solve(density.wom_c, tables.hh(spark, d), generate.identity(spark, N), ne=float(OCCUPIED), beta=BETA, parameters=FINE_STEPS)[0], 4)


_chain = Chain("E", "HH")
_occupied = _projector_sql(_chain)
# the highest occupied level: K (H - lowest bound) has the occupied levels as its spectrum, shifted, and zeros
_low = _chain.scalar("min(c - r) FROM (SELECT sum(CASE WHEN i = j THEN v ELSE 0 END) AS c, sum(CASE WHEN i <> j THEN abs(v) ELSE 0 END) AS r FROM HH GROUP BY j)")
_highest = _dominant_sql(_chain, _chain.mul(_occupied, _chain.lin((1, "HH"), (f"-1.0 * {_low}", "E"))), 12)
ORACLES["estimate_gap"] = _chain.select(f"SELECT round({_highest} + {_low}, 4) AS homo")

_METHODS = {"hpcp": density.hpcp, "pm": density.pm, "trs2": density.trs2, "trs4": density.trs4}
_chain = Chain("E", "HH")
_occupied = _projector_sql(_chain)
ORACLES["chemical_potential"] = _chain.select(" UNION ALL ".join(f"SELECT '{name}' AS method, round({_chain.trace(_occupied)})::BIGINT AS below, {N} - round({_chain.trace(_occupied)})::BIGINT AS above FROM (SELECT 1)" for name in _METHODS))


@query("chemical_potential", ORACLES["chemical_potential"])
def _chemical_potential(spark, d):
    """How many levels lie below and above the chemical potential that each method finds."""
    h, one = tables.hh(spark, d).settled(), generate.identity(spark, N)
    levels = np.linalg.eigvalsh(h.to_numpy())
    found = {name: solve(f, h, one, ne=float(OCCUPIED), parameters=TIGHT)[2] for name, f in _METHODS.items()}
    return spark.createDataFrame([(name, int((levels < mu).sum()), int((levels > mu).sum())) for name, mu in found.items()], "method string, below long, above long")


@_chain_query("energy_density", ["DD", "HH"], lambda c: c.mul(c.mul("DD", "HH"), "DD"))
def _energy_density(spark, d):
    return rounded(solve(density.energy_density, tables.hh(spark, d), _dd(spark, d)))


def _mcweeny_sql(c: Chain) -> str:
    ds = c.mul("DD", "HH")
    dsd = c.mul(ds, "DD")
    return c.lin((3, dsd), (-2, c.mul(ds, dsd)))


@_chain_query("mcweeny_step", ["DD", "HH"], _mcweeny_sql)
def _mcweeny(spark, d):
    return rounded(solve(density.mcweeny_step, _dd(spark, d), tables.hh(spark, d)))


def _lowdin_sql(c: Chain) -> str:
    # the old overlap is DD, the new one (DD + E) / 2
    new = c.lin((0.5, "DD"), (0.5, "E"))
    left = c.mul(c.sqrt_pair(new)[1], c.sqrt_pair("DD")[0])
    return c.mul(c.mul(left, "HH"), c.transpose(left))


@_chain_query("lowdin_extrapolate", ["E", "DD", "HH"], _lowdin_sql)
def _lowdin(spark, d):
    old = tables.dd(spark, d).settled()
    new = algebra.axpy(algebra.scale(old, 0.5), algebra.scale(generate.identity(spark, N), 0.5))
    return rounded(solve(density.lowdin_extrapolate, tables.hh(spark, d), old, new, parameters=TIGHT))


@_chain_query("purification_extrapolate", ["E", "HH"], _projector_sql, 4)
def _purification_extrapolate(spark, d):
    """A slightly scaled projector, purified with the identity as overlap, is the projector again."""
    one = generate.identity(spark, N)
    k = solve(density.trs4, tables.hh(spark, d), one, ne=float(OCCUPIED), parameters=TIGHT)[0]
    return rounded(solve(density.purification_extrapolate, algebra.scale(k, 0.97), one, ne=float(OCCUPIED), parameters=TIGHT), 4)


@query("estimate_gap", ORACLES["estimate_gap"])
def _estimate_gap(spark, d):
    """The gap is twice the distance from the chemical potential to the highest occupied level, which is what SQL can tell."""
    h, one = tables.hh(spark, d).settled(), generate.identity(spark, N)
    k, _, mu = solve(density.trs4, h, one, ne=float(OCCUPIED), parameters=TIGHT)
    gap = solve(density.estimate_gap, h, k, mu=mu, parameters=TIGHT)
    return spark.createDataFrame([(round(mu - gap / 2, 4),)], "homo double")


# -- files ---------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    from .. import scratch

    return scratch.path(spark, name)


@_chain_query("matrix_market_roundtrip", ["SP"], lambda c: "SP")
def _matrix_market(spark, d):
    path = _scratch(spark, "market")
    matrix_market.write(tables.sp(spark, d), path)
    return rounded(matrix_market.read(spark, path))


@_chain_query("market_array_roundtrip", ["NN"], lambda c: "NN")
def _market_array(spark, d):
    path = _scratch(spark, "market-array")
    matrix_market.write(tables.nn(spark, d), path, "array")
    return rounded(matrix_market.read(spark, path))


@_chain_query("binary_roundtrip", ["SP"], lambda c: "SP")
def _binary(spark, d):
    path = _scratch(spark, "binary")
    binary.write(tables.sp(spark, d), path)
    return rounded(binary.read(spark, path))


@query("binary_roundtrip_complex", _NN + "SELECT i, j, re, im FROM CC")
def _binary_complex(spark, d):
    path = _scratch(spark, "binary")
    binary.write(_complex(spark, d), path)
    return binary.read(spark, path).df


@_chain_query("parquet_roundtrip", ["SP"], lambda c: "SP")
def _parquet(spark, d):
    path = _scratch(spark, "matrix")
    binary.write_parquet(tables.sp(spark, d), path)
    return rounded(binary.read_parquet(spark, path))


@_table_query("market_lines", ["SP"], "SELECT i || ' ' || j || ' ' || v AS value FROM SP")
def _market_lines(spark, d):
    return matrix_market.lines(tables.sp(spark, d))


@_table_query("information", ["SP"], "SELECT 100::BIGINT AS rows, 100::BIGINT AS columns, count(*) AS entries, count(*) / 10000.0::DOUBLE AS fill FROM SP")
def _information(spark, d):
    found = aggregate.information(tables.sp(spark, d).settled())
    return spark.createDataFrame([(found["rows"], found["columns"], found["entries"], found["fill"])], "rows long, columns long, entries long, fill double")


@_table_query("sparsify", ["DD"], "SELECT i, j, round(v, 6) + 0.0 AS v FROM DD WHERE abs(v) > 0.1")
def _sparsify(spark, d):
    """Through a dense array and back, entries above a threshold only."""
    array = tables.dd(spark, d).to_numpy()
    return rounded(Matrix.from_numpy(spark, np.where(np.abs(array) > 0.1, array, 0.0)))
