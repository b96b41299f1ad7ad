"""SQL for matrix expressions: a chain of materialised common table expressions."""

from __future__ import annotations

from ..sources.tables import NEEDS, SQL


class Chain:
    """Collects expressions under fresh names; matrices are (i, j, v)."""

    def __init__(self, *bases: str):
        self.parts: list[tuple[str, str]] = []
        for base in bases:
            for name in [*NEEDS.get(base, []), base]:
                self.named(name, SQL[name])

    def named(self, name: str, body: str) -> str:
        if name not in dict(self.parts):
            self.parts.append((name, body))
        return name

    def add(self, body: str) -> str:
        return self.named(f"t{len(self.parts)}", body)

    def mul(self, a: str, b: str) -> str:
        return self.add(f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON a.j = b.i GROUP BY a.i, b.j")

    def lin(self, *terms: tuple[str | float, str]) -> str:
        """Sum of factor * matrix; factors are numbers or SQL."""
        parts = " UNION ALL ".join(f"SELECT i, j, ({f})::DOUBLE * v AS v FROM {m}" for f, m in terms)
        return self.add(f"SELECT i, j, sum(v) AS v FROM ({parts}) GROUP BY i, j")

    def scalar(self, expression: str) -> str:
        """A one-value expression, as SQL to be used in a factor."""
        column, _, source = expression.partition(" FROM ") if expression.lower().startswith(("min(", "max(")) else (expression, "", "")
        return f"(SELECT x FROM {self.add(f'SELECT {column} AS x' + (f' FROM {source}' if source else ''))})"

    def trace(self, m: str) -> str:
        return f"(SELECT sum(v) FROM {m} WHERE i = j)"

    def dot(self, a: str, b: str) -> str:
        return f"(SELECT sum(a.v * b.v) FROM {a} a JOIN {b} b ON a.i = b.i AND a.j = b.j)"

    def norm1(self, m: str) -> str:
        return f"(SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM {m} GROUP BY j))"

    def transpose(self, m: str) -> str:
        return self.add(f"SELECT j AS i, i AS j, v FROM {m}")

    def polynomial(self, a: str, coefficients: list[float], one: str = "E") -> str:
        out = self.lin((coefficients[-1], one))
        for c in reversed(coefficients[:-1]):
            out = self.lin((1, self.mul(a, out)), (c, one))
        return out

    def squared(self, m: str, times: int) -> str:
        for _ in range(times):
            m = self.mul(m, m)
        return m

    def inverse(self, a: str, rounds: int = 14) -> str:
        """Newton's iteration for a symmetric matrix."""
        x = self.lin((f"1.0 / ({self.norm1(a)} * {self.norm1(a)})", a))
        for _ in range(rounds):
            x = self.lin((2, x), (-1, self.mul(x, self.mul(a, x))))
        return x

    def sqrt_pair(self, a: str, one: str = "E", rounds: int = 16) -> tuple[str, str]:
        """Coupled Newton-Schulz: root and inverse root of a matrix with norm below two."""
        y, z = a, one
        for _ in range(rounds):
            t = self.lin((1.5, one), (-0.5, self.mul(z, y)))
            y, z = self.mul(y, t), self.mul(t, z)
        return y, z

    def sign(self, a: str, rounds: int = 40) -> str:
        x = self.lin((f"1.0 / {self.norm1(a)}", a))
        for _ in range(rounds):
            x = self.lin((1.5, x), (-0.5, self.mul(x, self.mul(x, x))))
        return x

    def select(self, body: str) -> str:
        chain = ",\n".join(f"{name} AS MATERIALIZED ({part})" for name, part in self.parts)
        return f"WITH {chain}\n{body}" if chain else body

    def entries(self, m: str, digits: int = 6) -> str:
        """The matrix as a rounded result; entries that round to zero are left out."""
        return self.select(f"SELECT i, j, round(v, {digits}) + 0.0 AS v FROM {m} WHERE abs(round(v, {digits})) > 0")
