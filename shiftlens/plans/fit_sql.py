"""SQL that fits the penalised logistic regression by itself: Newton steps in a recursive query.

A step builds the system from all rows of a group and eliminates one column at a time, so
the state is (step, column, coefficients, system).
"""

from __future__ import annotations

STEPS = 40


def logistic_fit(train: str, width: int, name: str = "fit", steps: int = STEPS) -> str:
    """Return CTEs; ``{name}_n`` has (g, v, mu, sd) for each group of ``train`` (g, y, f).

    ``f`` is a list of ``width`` doubles and y is 0 or 1.
    """
    size = width + 1
    chance = "list_transform(data, lambda r: 1 / (1 + exp(-list_dot_product(v, r.z))))"
    cell = "list_sum(list_transform(data, lambda r, n: r.w * q[n] * (1 - q[n]) * r.z[i] * r.z[j]))"
    side = "list_sum(list_transform(data, lambda r, n: r.w * (r.y - q[n]) * r.z[i]))"
    columns = f"range(1, {size + 1})"
    build = (
        f"list_transform({columns}, lambda i: list_append(list_transform({columns}, lambda j: {cell} "
        f"+ CASE WHEN i = j THEN pen[i] ELSE 0 END), {side} - pen[i] * v[i]))"
    )
    pivot = (
        "list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / m[k][k]) "
        "ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END)"
    )
    return f"""{name}_t AS MATERIALIZED ({train}),
{name}_s AS MATERIALIZED (SELECT g, list(a ORDER BY j) AS mu, list(CASE WHEN b > 0 THEN b ELSE 1 END ORDER BY j) AS sd
  FROM (SELECT g, j, avg(f[j]) AS a, stddev_pop(f[j]) AS b FROM {name}_t, range(1, {width + 1}) t(j) GROUP BY g, j) GROUP BY g),
{name}_c AS (SELECT g, count(*) AS n, sum(y) AS p FROM {name}_t GROUP BY g),
{name}_x AS MATERIALIZED (SELECT g, list({{'y': y::DOUBLE, 'w': CASE WHEN y = 1 THEN n / (2.0::DOUBLE * p) ELSE n / (2.0::DOUBLE * (n - p)) END,
    'z': list_prepend(1.0::DOUBLE, list_transform(f, lambda x, j: (x - mu[j]) / sd[j]))}}) AS data,
    list_prepend(0.0::DOUBLE, list_transform(first(sd), lambda s: 1 / (s * s))) AS pen
  FROM {name}_t JOIN {name}_c USING (g) JOIN {name}_s USING (g) GROUP BY g),
{name}_r AS (SELECT g, 0 AS step, 0 AS k, list_transform({columns}, lambda i: 0.0::DOUBLE) AS v, []::DOUBLE[][] AS m FROM {name}_x
  UNION ALL
  SELECT g, CASE WHEN k > {size} THEN step + 1 ELSE step END, CASE WHEN k > {size} THEN 0 ELSE k + 1 END,
    CASE WHEN k > {size} THEN list_transform(v, lambda x, i: x + m[i][{size + 1}]) ELSE v END,
    CASE WHEN k = 0 THEN {build} WHEN k <= {size} THEN {pivot} ELSE m END
  FROM (SELECT r.*, data, pen, CASE WHEN k = 0 THEN {chance} END AS q FROM {name}_r r JOIN {name}_x USING (g) WHERE step < {steps})),
{name}_n AS MATERIALIZED (SELECT g, v, mu, sd FROM {name}_r JOIN {name}_s USING (g) WHERE step = {steps} AND k = 0)"""


def score(features: str) -> str:
    """Return SQL for the probability of a list of features, given v, mu and sd."""
    scaled = f"list_transform({features}, lambda x, j: (x - mu[j]) / sd[j])"
    return f"1 / (1 + exp(-list_dot_product(v, list_prepend(1.0::DOUBLE, {scaled}))))"
