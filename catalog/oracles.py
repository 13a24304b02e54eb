"""DuckDB SQL with the same result as the registered query of the same name."""

from __future__ import annotations

from mirrorframe.functions.draws import XXH_P1, XXH_P2, XXH_P3, XXH_P4, XXH_P5

SEED = 200

# -- the 64-bit hash in SQL ------------------------------------------------------------

_WRAP = "18446744073709551616::UHUGEINT"


def _let(value, name, body):
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _times(a, c):
    return f"(({a}) * {c}::UHUGEINT) % {_WRAP}"


def _rotate(v, r):
    return f"((({v} * {2**r}::UHUGEINT) % {_WRAP}) + ({v} >> {64 - r}))"


def _hash_long(value, seed):
    word = _let(f"({value})::UHUGEINT", "hx", _times(_let(_times("hx", XXH_P2), "ha", _rotate("ha", 31)), XXH_P1))
    h = f"xor((({seed}) + {(XXH_P5 + 8) % 2**64}::UHUGEINT) % {_WRAP}, {word})"
    h = _let(h, "hb", f"({_times(_rotate('hb', 27), XXH_P1)} + {XXH_P4}::UHUGEINT) % {_WRAP}")
    h = _let(h, "hc", _times("xor(hc, hc >> 33)", XXH_P2))
    h = _let(h, "hd", _times("xor(hd, hd >> 29)", XXH_P3))
    return _let(h, "he", "xor(he, he >> 32)")


def hash_bits(seed, *keys):
    h = _hash_long(str(seed), "42::UHUGEINT")
    for k in keys:
        h = _hash_long(k, h)
    return f"({h} >> 11)"


def uniform(seed, *keys):
    return f"({hash_bits(seed, *keys)}::DOUBLE / {2**53}.0)"


# -- shared tables ---------------------------------------------------------------------

PAIR = """
f AS (SELECT p_partkey AS vec_id, p_size / 50.0::DOUBLE AS f0, p_size / 50.0::DOUBLE + p_retailprice / 100.0::DOUBLE AS f1 FROM part),
c AS (SELECT avg(f0) AS m0, avg(f1) AS m1, covar_samp(f0, f0) AS a, covar_samp(f0, f1) AS b, covar_samp(f1, f1) AS d, count(*) AS n FROM f),
r AS (SELECT *, b / sqrt(a * d) AS rho FROM c)"""

EQUI = PAIR + """,
s AS (SELECT *, least(1.0, greatest(0.0, 2 * (1 - abs(rho) - 0.001))) AS sc FROM r)"""

SDP = PAIR + """,
s AS (SELECT *, least(1.0, 2 * (1 - abs(rho)) - 0.001) AS sc FROM r)"""

PLAN = EQUI + """,
pl AS (SELECT *, a * d - b * b AS det, sc * a AS s0, sc * d AS s1 FROM s),
pr AS (SELECT *, d * s0 / det AS p00, -b * s1 / det AS p01, -b * s0 / det AS p10, a * s1 / det AS p11 FROM pl),
vv AS (SELECT *, 2 * s0 - s0 * p00 AS v00, -s0 * p01 AS v01, 2 * s1 - s1 * p11 AS v11 FROM pr),
ll AS (SELECT *, sqrt(v00 + 1e-10) AS l00, v01 / sqrt(v00 + 1e-10) AS l10 FROM vv),
lo AS (SELECT *, sqrt(v11 + 1e-10 - l10 * l10) AS l11 FROM ll)"""

COPIES = PLAN + f""",
u AS (SELECT vec_id, f0, f1, {uniform(SEED, 'vec_id', '0')} AS u0, {uniform(SEED, 'vec_id', '1')} AS u1 FROM f),
z AS (SELECT *, sqrt(-2 * ln(1 - u0)) * cos(2 * pi() * u1) AS z0, sqrt(-2 * ln(1 - u0)) * sin(2 * pi() * u1) AS z1 FROM u),
k AS (SELECT vec_id, f0, f1, sc,
        f0 - ((f0 - m0) * p00 + (f1 - m1) * p10) + z0 * l00 AS k0,
        f1 - ((f0 - m0) * p01 + (f1 - m1) * p11) + z0 * l10 + z1 * l11 AS k1
      FROM z, lo)"""

LONG = "l AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"

COV64 = LONG + """,
cov AS (SELECT x.i::INTEGER AS i, y.i::INTEGER AS j, covar_samp(x.v, y.v) AS v FROM l x JOIN l y USING (vec_id) GROUP BY ALL)"""

CORR64 = COV64 + """,
var AS (SELECT i, v FROM cov WHERE i = j),
corr AS (SELECT cov.i, cov.j, cov.v / sqrt(a.v * b.v) AS v FROM cov JOIN var a ON a.i = cov.i JOIN var b ON b.i = cov.j)"""

# -- all 64 features, pairwise mixed: blocks of two have a closed form, the rest is elimination by recursion ----------

PAIRS = f"""
l AS MATERIALIZED (SELECT vec_id, i, CASE WHEN i % 2 = 0 THEN embedding[i + 1]::DOUBLE ELSE embedding[i]::DOUBLE + (0.25::DOUBLE + (i + 1) / 64.0::DOUBLE) * embedding[i + 1]::DOUBLE END AS v FROM embeddings, range(64) t(i)),
mu AS MATERIALIZED (SELECT i, avg(v) AS m FROM l GROUP BY i),
cov AS MATERIALIZED (SELECT x.i AS i, y.i AS j, covar_samp(x.v, y.v) AS v FROM l x JOIN l y USING (vec_id) GROUP BY ALL),
var AS MATERIALIZED (SELECT i, v FROM cov WHERE i = j),
corr AS MATERIALIZED (SELECT cov.i, cov.j, cov.v / sqrt(a.v * b.v) AS v FROM cov JOIN var a ON a.i = cov.i JOIN var b ON b.i = cov.j),
bl AS MATERIALIZED (SELECT i, least(1.0::DOUBLE, 2 * (1 - abs(v))) AS s FROM corr WHERE i // 2 = j // 2 AND i <> j)"""


def _pivots(name, grid):
    """Smallest pivot of 2 corr - g diag(s) for each g of a grid: the matrix is feasible if it is positive."""
    return f"""
{name}_e AS (SELECT g, 0 AS k, i, j, 2 * v - CASE WHEN i = j THEN g * s ELSE 0 END AS v FROM corr JOIN bl USING (i), ({grid}) x(g)
  UNION ALL SELECT g, k + 1, i, j, v - rk * ck / d FROM (
    SELECT *, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY g, j) AS rk, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY g, i) AS ck,
           max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY g) AS d FROM {name}_e) WHERE i > k AND j > k AND d > 0),
{name} AS MATERIALIZED (SELECT max(g) AS g FROM (SELECT g, min(v) AS low, count(*) AS n FROM {name}_e WHERE i = k AND j = k GROUP BY g) WHERE low > 0 AND n = 64)"""


# halving [0, 1] to steps of 1/128: first sixteenths, then single steps above the largest feasible one
PAIRS_S = PAIRS + "," + _pivots("coarse", "SELECT g / 8.0::DOUBLE FROM range(9) t(g)") + "," + _pivots("fine", "SELECT least(1.0, g + f / 128.0::DOUBLE) FROM coarse, range(16) t(f) WHERE g < 1.0 OR f = 0") + """,
s AS MATERIALIZED (SELECT i, least(1.0::DOUBLE, g * s) AS sc, least(1.0::DOUBLE, g * s) * v AS s, 1 - least(1.0::DOUBLE, g * s) AS target FROM bl JOIN var USING (i), fine)"""

PAIRS_PLAN = PAIRS_S + """,
gj AS (SELECT 0 AS k, i, j, v FROM cov UNION ALL SELECT k + 1, i, j,
    CASE WHEN i = k AND j = k THEN 1 / d WHEN i = k THEN rk / d WHEN j = k THEN -ck / d ELSE v - ck * rk / d END FROM (
    SELECT *, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS rk, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS ck,
           max(CASE WHEN i = k AND j = k THEN v END) OVER () AS d FROM gj WHERE k < 64)),
pr AS MATERIALIZED (SELECT gj.i, gj.j, gj.v * s.s AS p FROM gj JOIN s ON s.i = gj.j WHERE k = 64),
vv AS MATERIALIZED (SELECT pr.i, pr.j, CASE WHEN pr.i = pr.j THEN 2 * s.s ELSE 0 END - s.s * pr.p AS v FROM pr JOIN s ON s.i = pr.i)"""

PAIRS_COPIES = PAIRS_PLAN + f""",
ch AS (SELECT 0 AS k, i, j, v + CASE WHEN i = j THEN 1e-10 ELSE 0 END AS v FROM vv UNION ALL SELECT k + 1, i, j, v - rk * ck / d FROM (
    SELECT *, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS rk, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS ck,
           max(CASE WHEN i = k AND j = k THEN v END) OVER () AS d FROM ch) WHERE i > k AND j > k),
lo AS MATERIALIZED (SELECT a.i, a.k AS j, a.v / sqrt(b.v) AS v FROM ch a JOIN ch b ON b.k = a.k AND b.i = b.k AND b.j = b.k WHERE a.j = a.k),
u AS MATERIALIZED (SELECT vec_id, i, v, {uniform(SEED, 'vec_id', 'i')} AS u FROM l),
z AS MATERIALIZED (SELECT a.vec_id, a.i, sqrt(-2 * ln(1 - CASE WHEN a.i % 2 = 0 THEN a.u ELSE b.u END)) * CASE WHEN a.i % 2 = 0 THEN cos(2 * pi() * b.u) ELSE sin(2 * pi() * a.u) END AS z
      FROM u a JOIN u b ON a.vec_id = b.vec_id AND b.i = CASE WHEN a.i % 2 = 0 THEN a.i + 1 ELSE a.i - 1 END),
sh AS MATERIALIZED (SELECT vec_id, pr.j AS i, sum((l.v - m) * p) AS d FROM l JOIN mu USING (i) JOIN pr ON pr.i = l.i GROUP BY ALL),
nz AS MATERIALIZED (SELECT vec_id, lo.i AS i, sum(z * lo.v) AS e FROM z JOIN lo ON lo.j = z.i GROUP BY ALL),
k AS MATERIALIZED (SELECT vec_id, i, l.v AS x, l.v - d + e AS xk FROM l JOIN sh USING (vec_id, i) JOIN nz USING (vec_id, i))"""

LINKED = CORR64 + """,
g AS (SELECT i, min(j) AS group_id FROM corr WHERE abs(v) >= 0.12 GROUP BY i),
keep AS (SELECT min(i) AS i FROM g GROUP BY group_id)"""

THREE = """
f AS (SELECT embedding[3]::DOUBLE AS f0, embedding[1]::DOUBLE AS f1, embedding[1]::DOUBLE + 0.2::DOUBLE * embedding[2]::DOUBLE AS f2 FROM embeddings)"""

# rows of a 3 x 3 matrix (aa, ab, ac, bb, bc, cc) and the distances between them
_ROWS3 = """
d AS (SELECT sqrt((aa - ab) ** 2 + (ab - bb) ** 2 + (ac - bc) ** 2) AS d01,
             sqrt((aa - ac) ** 2 + (ab - bc) ** 2 + (ac - cc) ** 2) AS d02,
             sqrt((ab - ac) ** 2 + (bb - bc) ** 2 + (bc - cc) ** 2) AS d12 FROM m3),
lo AS (SELECT *, least(d01, d02, d12) AS low, greatest(d01, d02, d12) AS high FROM d)"""

HIGH = """
q AS (SELECT quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem),
h AS (SELECT l_extendedprice AS x, (l_extendedprice > med)::INTEGER::DOUBLE AS y FROM lineitem, q),
hc AS (SELECT covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS d, count(*) AS n FROM h)"""

SETS = """
l AS (SELECT vec_id, label AS run_id, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS v FROM embeddings),
by_feature AS (SELECT run_id, feature, avg(v) FILTER (vec_id % 2 = 0) AS even, avg(v) AS total FROM l GROUP BY ALL),
m AS (SELECT run_id, feature, coalesce(even > 0.01, FALSE) AS s, total > 0.01 AS t FROM by_feature)"""

SCORED = "sc AS (SELECT n_chars::DOUBLE AS score, quality FROM labels JOIN documents USING (doc_id))"

ROC = """
st AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM sc GROUP BY score),
cu AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
         row_number() OVER w AS rn, lead(pos) OVER w AS np, lead(neg) OVER w AS nn
       FROM st WINDOW w AS (ORDER BY score DESC))"""


def _quantile_code(col, q, edges):
    inner = " + ".join(f"({col} > {edges}[{k}])::INTEGER" for k in range(2, q + 1))
    return f"({inner})::INTEGER"


def _edges(col, q):
    probs = ", ".join(f"{k}/{q}.0" for k in range(q + 1))
    return f"quantile_cont({col}, [{probs}])"


_SAMPLE = f"""o AS (SELECT o_orderkey, o_totalprice, {hash_bits(SEED, 'o_orderkey')} AS h FROM orders),
rk AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY h, o_orderkey) AS rn, count(*) OVER () AS n FROM o)"""

_NOISE_ROWS = f"""
lg AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE * 10.0 AS v FROM embeddings, range(64) t(i)),
ny AS (SELECT vec_id, i, CASE WHEN i < 4 THEN 0 WHEN i < 7 THEN 1 WHEN i < 9 THEN 2 WHEN i < 19 THEN 3 WHEN i < 39 THEN 4 ELSE 5 END AS ch,
         (v + -ln(-ln({uniform(SEED, 'vec_id', 'i')} + 1e-20) + 1e-20)) / 0.5 AS y FROM lg)"""


def _merges(matrix, linkage, last=59):
    """Agglomeration of the rows of a matrix: ``me`` has the lowest member of each feature's group."""
    out = f"""
ds AS MATERIALIZED (SELECT a.i AS i, b.i AS j, {'sqrt' if linkage == 'complete' else ''}(sum((a.v - b.v) ** 2)) AS d FROM {matrix} a JOIN {matrix} b ON a.j = b.j AND a.i < b.i GROUP BY ALL),
cu AS MATERIALIZED (SELECT 0.5 * max(d) AS cut FROM ds),
ag AS (SELECT 0 AS st, i, j, d, 1 AS ni, 1 AS nj FROM ds UNION ALL"""
    nearest = """SELECT *, CASE WHEN i = mb THEN ma ELSE i END AS x, CASE WHEN j = mb THEN ma ELSE j END AS y,
        CASE WHEN i IN (ma, mb) THEN ni ELSE nj END AS np, CASE WHEN i IN (ma, mb) THEN nj ELSE ni END AS no FROM (
      SELECT *, first_value(i) OVER w AS ma, first_value(j) OVER w AS mb, first_value(ni) OVER w AS na, first_value(nj) OVER w AS nb, min(d) OVER () AS md FROM ag WINDOW w AS (ORDER BY d, i, j))"""
    if linkage == "complete":
        out += f"""
  SELECT DISTINCT st + 1, least(x, y), greatest(x, y), max(d) OVER (PARTITION BY least(x, y), greatest(x, y)), 1, 1 FROM ({nearest}), cu WHERE x <> y AND md <= cut),
mg AS MATERIALIZED (SELECT st, arg_min(i, (d, i, j)) AS a, arg_min(j, (d, i, j)) AS b FROM ag, cu GROUP BY st HAVING min(d) <= any_value(cut)),"""
    else:
        out += f"""
  SELECT DISTINCT st + 1, least(x, y), greatest(x, y),
    CASE WHEN x = ma OR y = ma THEN (sum((np + no) * d) OVER p - no * md) / (na + nb + no) ELSE d END,
    CASE WHEN least(x, y) = ma THEN na + nb WHEN x < y THEN ni ELSE nj END, CASE WHEN greatest(x, y) = ma THEN na + nb WHEN x < y THEN nj ELSE ni END
  FROM ({nearest}) WHERE x <> y AND st < {last} WINDOW p AS (PARTITION BY least(x, y), greatest(x, y))),
mg AS MATERIALIZED (SELECT st, arg_min(i, (d, i, j)) AS a, arg_min(j, (d, i, j)) AS b FROM ag GROUP BY st),"""
    return out + """
me AS (SELECT 0 AS st, i, i AS g FROM (SELECT DISTINCT i FROM cov) UNION ALL SELECT st + 1, i, CASE WHEN g = b THEN a ELSE g END FROM me JOIN mg USING (st)),
gp AS MATERIALIZED (SELECT i, g, dense_rank() OVER (ORDER BY g)::INTEGER AS group_id FROM me WHERE st = (SELECT count(*) FROM mg))"""


def _tyler64_sql(steps):
    """Fixed-point steps on all features; each but the first inverts the last scatter by elimination."""
    out = [LONG.replace("l AS (", "l AS MATERIALIZED ("), "w0 AS MATERIALIZED (SELECT vec_id, 1 / sum(v * v) AS w FROM l GROUP BY vec_id HAVING sum(v * v) > 0)"]
    for k in range(steps):
        out.append(f"z{k} AS MATERIALIZED (SELECT a.i AS i, b.i AS j, 64.0 * sum(w * a.v * b.v) / (SELECT count(*) FROM w0) AS v FROM l a JOIN l b USING (vec_id) JOIN w{k} USING (vec_id) GROUP BY ALL)")
        if k < steps - 1:
            out.append(f"""gj{k} AS (SELECT 0 AS k, i, j, v FROM z{k} UNION ALL SELECT k + 1, i, j,
    CASE WHEN i = k AND j = k THEN 1 / d WHEN i = k THEN rk / d WHEN j = k THEN -ck / d ELSE v - ck * rk / d END FROM (
    SELECT *, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS rk, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS ck,
           max(CASE WHEN i = k AND j = k THEN v END) OVER () AS d FROM gj{k} WHERE k < 64))""")
            out.append(f"w{k + 1} AS MATERIALIZED (SELECT vec_id, 1 / sum(a.v * g.v * b.v) AS w FROM l a JOIN l b USING (vec_id) JOIN (SELECT * FROM gj{k} WHERE k = 64) g ON g.i = a.i AND g.j = b.i JOIN w0 USING (vec_id) GROUP BY vec_id)")
    return "WITH RECURSIVE " + ",\n".join(out) + f"\nSELECT i::INTEGER AS i, j::INTEGER AS j, round(v, 7) + 0.0 AS v FROM z{steps - 1}"


def _kernel(d2):
    return "(" + " + ".join(f"exp(-({d2}) / {2.0 * a * a})" for a in (1, 2, 4, 8, 16, 32, 64, 128)) + ") / 8.0"


def _mcd_sql(steps):
    """Two-feature C-steps: distances, the h closest rows, their moments; then correction and reweighting."""
    out = [PAIR, "z0 AS (SELECT avg(f0) AS m0, avg(f1) AS m1, covar_pop(f0, f0) AS a, covar_pop(f0, f1) AS b, covar_pop(f1, f1) AS d FROM f)",
           "hh AS (SELECT ceil(0.5 * (count(*) + 3)) AS h FROM f)"]

    def distance(z):
        return (f"SELECT f0, f1, (d * (f0 - m0) ** 2 - 2 * b * (f0 - m0) * (f1 - m1) + a * (f1 - m1) ** 2) / (a * d - b * b) AS d2 FROM f, {z}")

    for k in range(steps):
        out.append(f"d{k} AS ({distance(f'z{k}')})")
        out.append(f"t{k} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY d2) AS rn FROM d{k}), hh WHERE rn <= h)")
        out.append(f"z{k + 1} AS (SELECT avg(f0) AS m0, avg(f1) AS m1, covar_pop(f0, f0) AS a, covar_pop(f0, f1) AS b, covar_pop(f1, f1) AS d FROM t{k})")
    out.append(f"df AS ({distance(f'z{steps}')})")
    # chi-square quantiles for two features are closed: -2 ln(1 - p)
    out.append("co AS (SELECT quantile_cont(d2, 0.5) / (-2 * ln(0.5)) AS k FROM df)")
    out.append("w AS (SELECT covar_pop(f0, f0) AS a, covar_pop(f0, f1) AS b, covar_pop(f1, f1) AS d FROM df, co WHERE d2 / k <= -2 * ln(0.025))")
    return "WITH" + ",\n".join(out) + "\n" + _cells("w")


def _mcd_sign_sql(steps):
    """The fit from the spatial signs for two features: scaling, start, C-steps with shared ties, correction, reweighting."""
    out = ["""x AS MATERIALIZED (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b FROM lineitem)""",
           "md AS MATERIALIZED (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb, count(*) AS n, ceil(0.5 * (count(*) + 3)) AS h, ceil(count(*) / 2) AS h0 FROM x)",
           "sc AS MATERIALIZED (SELECT 1.4826 * quantile_cont(abs(a - ma), 0.5) AS sa, 1.4826 * quantile_cont(abs(b - mb), 0.5) AS sb FROM x, md)",
           "z AS MATERIALIZED (SELECT (a - ma) / sa AS u, (b - mb) / sb AS v FROM x, md, sc)",
           "sg AS MATERIALIZED (SELECT sum(u * u / (u * u + v * v)) AS p, sum(u * v / (u * u + v * v)) AS q, sum(v * v / (u * u + v * v)) AS r FROM z WHERE u <> 0 OR v <> 0)",
           "ax AS MATERIALIZED (SELECT 0.5 * atan2(2 * q, p - r) AS t FROM sg)",
           "pr AS MATERIALIZED (SELECT u, v, u * cos(t) + v * sin(t) AS e, v * cos(t) - u * sin(t) AS g FROM z, ax)",
           "pm AS MATERIALIZED (SELECT quantile_cont(e, 0.5) AS me, quantile_cont(g, 0.5) AS mg FROM pr)",
           "ps AS MATERIALIZED (SELECT (1.4826 * quantile_cont(abs(e - me), 0.5)) ** 2 AS le, (1.4826 * quantile_cont(abs(g - mg), 0.5)) ** 2 AS lg FROM pr, pm)",
           """s0 AS MATERIALIZED (SELECT me * cos(t) - mg * sin(t) AS m0, me * sin(t) + mg * cos(t) AS m1, le * cos(t) ** 2 + lg * sin(t) ** 2 AS a,
             (le - lg) * sin(t) * cos(t) AS b, le * sin(t) ** 2 + lg * cos(t) ** 2 AS d FROM ax, pm, ps)"""]

    def distance(s):
        return f"SELECT u, v, (d * (u - m0) ** 2 - 2 * b * (u - m0) * (v - m1) + a * (v - m1) ** 2) / (a * d - b * b) AS d2 FROM z, {s}"

    for k in range(steps + 1):
        h = "h0" if k == 0 else "h"
        out.append(f"d{k} AS MATERIALIZED ({distance(f's{k}')})")
        out.append(f"c{k} AS MATERIALIZED (SELECT max(d2) AS cut FROM (SELECT d2, row_number() OVER (ORDER BY d2) AS rn FROM d{k}), md WHERE rn <= {h})")
        out.append(f"n{k} AS MATERIALIZED (SELECT count(*) FILTER (d2 < cut * (1 - 1e-12)) AS below, count(*) FILTER (d2 >= cut * (1 - 1e-12) AND d2 <= cut * (1 + 1e-12)) AS ties FROM d{k}, c{k})")
        out.append(f"w{k} AS MATERIALIZED (SELECT u, v, CASE WHEN d2 < cut * (1 - 1e-12) THEN 1.0::DOUBLE WHEN d2 <= cut * (1 + 1e-12) THEN ({h} - below) / ties ELSE 0.0::DOUBLE END AS w FROM d{k}, c{k}, n{k}, md)")
        out.append(f"m{k} AS MATERIALIZED (SELECT sum(w * u) / sum(w) AS m0, sum(w * v) / sum(w) AS m1 FROM w{k})")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT m0, m1, sum(w * (u - m0) ** 2) / sum(w) AS a, sum(w * (u - m0) * (v - m1)) / sum(w) AS b, sum(w * (v - m1) ** 2) / sum(w) AS d FROM w{k}, m{k} GROUP BY m0, m1)")
    out.append(f"df AS MATERIALIZED ({distance(f's{steps + 1}')})")
    out.append("co AS MATERIALIZED (SELECT quantile_cont(d2, 0.5) / (-2 * ln(0.5)) AS k FROM df)")
    out.append("w AS (SELECT covar_pop(u, u) * any_value(sa * sa) AS a, covar_pop(u, v) * any_value(sa * sb) AS b, covar_pop(v, v) * any_value(sb * sb) AS d FROM df, co, sc WHERE d2 <= -2 * ln(0.025) * k)")
    return "WITH " + ",\n".join(out) + "\n" + _cells("w", 3)


def _cells(table, digits=9):
    return (f"SELECT i, j, round(CASE WHEN i <> j THEN b WHEN i = 0 THEN a ELSE d END, {digits}) AS v "
            f"FROM {table}, (SELECT range::INTEGER AS i FROM range(2)) x, (SELECT range::INTEGER AS j FROM range(2)) y")


def _tyler_sql(steps):
    out = [PAIR, "x AS (SELECT f0 / sqrt(f0 * f0 + f1 * f1) AS f0, f1 / sqrt(f0 * f0 + f1 * f1) AS f1 FROM f WHERE f0 <> 0 OR f1 <> 0)",
           "z0 AS (SELECT 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS d)"]
    for k in range(steps):
        out.append(f"w{k} AS (SELECT f0, f1, (a * d - b * b) / (d * f0 * f0 - 2 * b * f0 * f1 + a * f1 * f1) AS w FROM x, z{k})")
        out.append(f"z{k + 1} AS (SELECT 2.0 * avg(w * f0 * f0) AS a, 2.0 * avg(w * f0 * f1) AS b, 2.0 * avg(w * f1 * f1) AS d FROM w{k})")
    return "WITH" + ",\n".join(out) + "\n" + _cells(f"z{steps}", 8)


def _short(c):
    return f"regexp_replace(CAST(round_even({c}, 4)::DECIMAL(20,4) AS VARCHAR), '(\\.\\d*?[1-9]|\\.0)0*$', '\\1')"


def _run_params(model, t_df, test_n, first_id):
    return f"""WITH {HIGH.strip()},
hr AS (SELECT *, least(1.0, 2 * (1 - abs(b / sqrt(a * d)) - 0.001)) AS sc FROM hc),
gr AS (SELECT (li * 5 + di + {first_id})::INTEGER AS run_id,
         CASE WHEN li = 4 THEN 0.001 ELSE 0.01 + li * ((0.001::DOUBLE - 0.01::DOUBLE) / 4) END AS lam,
         CASE WHEN di = 4 THEN 0.001 ELSE 0.01 + di * ((0.001::DOUBLE - 0.01::DOUBLE) / 4) END AS del
       FROM range(5) x(li), range(5) y(di))
SELECT run_id, '{model}_' || {_short('lam')} || '_' || {_short('del')} AS run_label, '{model}' AS model,
  round(lam, 7) AS lambda, round(del, 7) AS delta, 1.0::DOUBLE AS gamma, {t_df} AS t_df, {test_n} AS test_n, 2 AS p, n, n // 2 AS batch_size,
  20 AS dim_h, round(1 - sc, 7) AS target_first, 8 AS n_alphas FROM gr, hr"""


_RUN_PARAMS = _run_params("mstudent", "10", "200", 0)

_LINE_SCORE = "0.0 + l_quantity * 0.1::DOUBLE + l_discount * (-20.0)::DOUBLE + l_tax * (-25.0)::DOUBLE"

_LINES4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_ENCODED = ["(l_returnflag = 'A')::INTEGER", "(l_returnflag = 'N')::INTEGER", "(l_returnflag = 'R')::INTEGER",
            "(l_linestatus = 'F')::INTEGER", "(l_linestatus = 'O')::INTEGER", "l_quantity", "l_discount"]

# halving [0, 1] down to steps of 1/128 keeps the largest feasible multiple
_SINGLE = f"WITH {PAIR.strip()}, g AS (SELECT *, least(1.0::DOUBLE, floor(2 * (1 - abs(rho)) * 128) / 128) AS g FROM r) SELECT i, round(g, 9) AS s_corr, round(g * CASE WHEN i = 0 THEN a ELSE d END, 9) AS s FROM g, (VALUES (0), (1)) x(i)"


def _group3(stat, cond):
    return (f"WITH {THREE.strip()}, m3 AS (SELECT {stat('f0', 'f0')} AS aa, {stat('f0', 'f1')} AS ab, {stat('f0', 'f2')} AS ac, {stat('f1', 'f1')} AS bb, "
            f"{stat('f1', 'f2')} AS bc, {stat('f2', 'f2')} AS cc FROM f), {_ROWS3.strip()}, "
            f"j AS (SELECT CASE WHEN NOT ({cond}) THEN [1, 2, 3] WHEN d01 = low THEN [1, 1, 2] WHEN d02 = low THEN [1, 2, 1] ELSE [1, 2, 2] END AS g FROM lo) "
            "SELECT i, g[i + 1]::INTEGER AS group_id FROM j, (VALUES (0), (1), (2)) x(i)")


def _equi_part(data_type, names, x, y, reg):
    pick = f"CASE WHEN i = 0 THEN '{names[0]}' ELSE '{names[1]}' END"
    rho = f"covar_samp({x}, {y}) / sqrt((var_samp({x}) + {reg}) * (var_samp({y}) + {reg}))"
    return (f"SELECT '{data_type}' AS data_type, {pick} AS feature, i, round(1 - least(1.0, 2 * (1 - abs(rho) - 0.001)), 7) + 0.0 AS v "
            f"FROM (SELECT {rho} AS rho FROM t), (VALUES (0), (1)) z(i)")


_STATUS = {c: f"(o_orderstatus = '{c}')::INTEGER" for c in "FOP"}
_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

ORACLES = {
    "read_features": "SELECT p_partkey AS row_id, p_size, p_retailprice FROM part",
    "write_train_index": f"WITH {_SAMPLE} SELECT o_orderkey AS row_id FROM rk WHERE rn <= round_even(0.8 * n, 0)",
    "drop_columns": "SELECT c_custkey, c_mktsegment FROM customer",
    "split_by_kind_categorical": "SELECT o_orderkey AS row_id, " + ", ".join(f'{e} AS "o_orderstatus_{c}"' for c, e in _STATUS.items()) + " FROM orders",
    "split_by_kind_continuous": "SELECT o_orderkey AS row_id, o_totalprice FROM orders",
    "hconcat": "SELECT o_orderkey AS row_id, " + ", ".join(f'{e} AS "o_orderstatus_{c}"' for c, e in _STATUS.items()) + ", o_totalprice FROM orders",
    "cast_labels": f"WITH e AS (SELECT {_edges('p_retailprice', 4)} AS q FROM part) SELECT p_partkey, CAST({_quantile_code('p_retailprice', 4, 'q')} AS VARCHAR) AS p_retailprice FROM part, e",
    "standardize": "SELECT event_id, round((value - 10.0) / sqrt(25.0::DOUBLE), 9) + 0.0 AS value FROM events",
    "standardize_array": f"WITH {LONG}, st AS (SELECT i, avg(v) AS m, var_samp(v) AS s FROM l GROUP BY i) SELECT vec_id, i::INTEGER AS i, round((v - m) / sqrt(s), 7) + 0.0 AS v FROM l JOIN st USING (i)",
    "linear_score_array": f"WITH {LONG} SELECT vec_id, round(sum(v * i / 64.0::DOUBLE), 8) + 0.0 AS xbeta FROM l GROUP BY vec_id",
    "hconcat_parts": "SELECT o_orderkey AS row_id, " + ", ".join(f'{e} AS "o_orderstatus_{c}"' for c, e in _STATUS.items()) + ", o_totalprice FROM orders",
    "quantile_bin_array": f"WITH {LONG}, e AS (SELECT i, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM l GROUP BY i) SELECT vec_id, i::INTEGER AS i, (v > q[1])::INTEGER + (v > q[2])::INTEGER + (v > q[3])::INTEGER AS code FROM l JOIN e USING (i)",
    "feature_histogram_array": f"WITH {LONG}, e AS (SELECT i, min(v) AS lo, max(v) AS hi FROM l GROUP BY i), c AS (SELECT i, least(floor((v - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, count(*) AS n FROM l JOIN e USING (i) GROUP BY ALL) SELECT 'embedding_' || e.i AS feature, b::INTEGER AS bin, round(lo + b * (hi - lo) / 10, 6) + 0.0 AS low, round(lo + (b + 1) * (hi - lo) / 10, 6) + 0.0 AS high, coalesce(n, 0) AS n FROM e CROSS JOIN range(10) t(b) LEFT JOIN c ON c.i = e.i AND c.bin = b",
    "row_normalize": f"WITH {LONG}, nn AS (SELECT vec_id, sqrt(sum(v * v)) AS len FROM l GROUP BY vec_id) SELECT vec_id, i::INTEGER AS i, round(CASE WHEN len = 0 THEN v ELSE v / len END, 9) + 0.0 AS v FROM l JOIN nn USING (vec_id)",
    "linear_score": f"SELECT l_orderkey, l_linenumber, round({_LINE_SCORE}, 9) + 0.0 AS xbeta FROM lineitem",
    "logistic_label": f"WITH x AS (SELECT l_orderkey, l_linenumber, {_LINE_SCORE} AS xb FROM lineitem), y AS (SELECT *, 1.0 / (1.0 + exp(-xb)) AS p FROM x) SELECT l_orderkey, l_linenumber, round(xb, 9) + 0.0 AS xbeta, round(p, 9) + 0.0 AS pr, (p >= 0.5)::INTEGER AS label FROM y",
    "binarize": "SELECT l_orderkey, l_linenumber, l_discount, (l_discount >= 0.05::DOUBLE)::INTEGER AS is_high FROM lineitem",
    "sample_exact": f"WITH {_SAMPLE} SELECT o_orderkey, o_totalprice FROM rk WHERE rn <= round_even(0.8 * n, 0)",
    "train_holdout_split": f"WITH {_SAMPLE} SELECT o_orderkey, rn <= round_even(0.2 * n, 0) AS is_train FROM rk",
    "assign_batches": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // (SELECT floor(0.2 * count(*))::BIGINT FROM orders) AS batch_id FROM orders",
    "assign_small_batches": "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch_id FROM events",
    "shuffle_within_row": f"WITH {LONG}, h AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY {hash_bits(SEED, 'vec_id', 'i')}, i) - 1 AS i FROM l) SELECT vec_id, i::INTEGER AS i, round(v, 9) + 0.0 AS v FROM h",
    "gumbel_onehot": f"WITH {_NOISE_ROWS.strip()} SELECT vec_id, i::INTEGER AS i, (row_number() OVER (PARTITION BY vec_id, ch ORDER BY y DESC, i) = 1)::INTEGER::DOUBLE AS v FROM ny",
    "soft_probs": f"WITH {_NOISE_ROWS.strip()}, ex AS (SELECT *, exp(y - max(y) OVER (PARTITION BY vec_id, ch)) AS e FROM ny) SELECT vec_id, i::INTEGER AS i, round(e / sum(e) OVER (PARTITION BY vec_id, ch), 7) + 0.0 AS v FROM ex",
    "quantile_bin": "WITH e AS (SELECT " + ", ".join(f"{_edges(c, 4)} AS q{k}" for k, c in enumerate(_LINES4)) + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{_quantile_code(c, 4, f'q{k}')} AS {c}" for k, c in enumerate(_LINES4)) + " FROM lineitem, e",
    "quantile_bin_var": "WITH e AS (SELECT " + ", ".join(f"{_edges(c, q)} AS q{q}" for c, q in (("l_quantity", 3), ("l_extendedprice", 4), ("l_discount", 2))) + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{_quantile_code(c, q, f'q{q}')} AS {c}" for c, q in (("l_quantity", 3), ("l_extendedprice", 4), ("l_discount", 2))) + " FROM lineitem, e",
    "one_hot": "SELECT o_orderkey, " + ", ".join(f'{e} AS "status_{c}"' for c, e in _STATUS.items()) + ", "
    + ", ".join(f"(o_orderpriority = '{c}')::INTEGER AS \"prio_{c}\"" for c in _PRIORITY) + " FROM orders",
    "expand_factors": "SELECT l_orderkey, l_linenumber, " + ", ".join(f'(l_returnflag = \'{c}\')::INTEGER AS "l_returnflag_{c}"' for c in "ANR") + ", "
    + ", ".join(f'(l_linestatus = \'{c}\')::INTEGER AS "l_linestatus_{c}"' for c in "FO")
    + ", (SELECT count(DISTINCT l_returnflag) || ',' || count(DISTINCT l_linestatus) FROM lineitem) AS chunk_list FROM lineitem",
    "derive_catalog": "WITH s AS (SELECT 0 AS chunk_id, 'p_brand' AS factor, count(DISTINCT p_brand)::INTEGER AS chunk_size FROM part UNION ALL SELECT 1, 'p_type', count(DISTINCT p_type)::INTEGER FROM part) SELECT *, (sum(chunk_size) OVER (ORDER BY chunk_id) - chunk_size)::INTEGER AS first_pos FROM s",
    "rebin_like": f"WITH {COPIES.strip()}, e AS (SELECT {_edges('f0', 4)} AS q0, {_edges('f1', 3)} AS q1 FROM f) SELECT vec_id, {_quantile_code('k0', 4, 'q0')} AS f0, {_quantile_code('k1', 3, 'q1')} AS f1 FROM k, e",
    "mean_vector": f"WITH {LONG} SELECT i::INTEGER AS i, round(avg(v), 9) + 0.0 AS v FROM l GROUP BY i",
    "covariance": f"WITH {COV64} SELECT i, j, round(v, 9) + 0.0 AS v FROM cov",
    "covariance_few_columns": " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_samp({a}, {b}), 4) + 0.0 AS v FROM lineitem" for i, a in enumerate(_LINES4) for j, b in enumerate(_LINES4)),
    "cov_to_corr": f"WITH {CORR64} SELECT i, j, round(v, 8) + 0.0 AS v FROM corr",
    "ridge": f"WITH {COV64} SELECT i, j, round(v + CASE WHEN i = j THEN 0.002 ELSE 0 END, 9) + 0.0 AS v FROM cov",
    "ridge_by_kind": " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, round(covar_samp({a}, {b}) + {0.001 if i == j and i < 5 else 0.0}, 7) + 0.0 AS v FROM lineitem" for i, a in enumerate(_ENCODED) for j, b in enumerate(_ENCODED)),
    "ridge_if_not_psd": f"WITH {PAIR.strip()}, x AS (SELECT a - 0.05 AS a, b, d - 0.05 AS d FROM c), y AS (SELECT *, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS low FROM x), w AS (SELECT CASE WHEN low < 0 THEN a + 0.5 ELSE a END AS a, b, CASE WHEN low < 0 THEN d + 0.5 ELSE d END AS d FROM y) " + _cells("w"),
    "mcd_fixed_steps": _mcd_sql(2),
    "mcd_sign_start": _mcd_sign_sql(6),
    "tyler_fixed_steps": _tyler_sql(3),
    "correlation_summary": f"WITH {HIGH.strip()}, t AS (SELECT 1 - least(1.0, 2 * (1 - abs(b / sqrt(a * d)) - 0.001)) AS v FROM hc) SELECT kind, round(v, 7) AS mean_corr, n_features FROM t, (VALUES ('all', 2::BIGINT), ('cat', 1::BIGINT), ('cont', 1::BIGINT)) x(kind, n_features)",
    "corr_deviation": f"WITH {CORR64} SELECT i, j, round(v, 8) + 0.0 AS v, round(0.5 ** abs(i - j), 8) + 0.0 AS ref, round(v - 0.5 ** abs(i - j), 8) + 0.0 AS deviation FROM corr",
    "corr_deviation_constant": f"WITH {CORR64}, x AS (SELECT *, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS ref FROM corr) SELECT i, j, round(v, 8) + 0.0 AS v, round(ref, 8) + 0.0 AS ref, round(v - ref, 8) + 0.0 AS deviation FROM x",
    "s_equi": f"WITH {EQUI.strip()} SELECT i, round(sc, 9) AS s_corr, round(sc * CASE WHEN i = 0 THEN a ELSE d END, 9) AS s FROM s, (VALUES (0), (1)) x(i)",
    "s_sdp": f"WITH {SDP.strip()} SELECT i, round(sc, 5) AS s_corr, round(sc * CASE WHEN i = 0 THEN a ELSE d END, 5) AS s FROM s, (VALUES (0), (1)) x(i)",
    "s_asdp_single_blocks": _SINGLE,
    "s_asdp_cluster_single": _SINGLE,
    "knockoff_plan": f"WITH {PLAN.strip()} SELECT i, j, round(CASE WHEN i = 0 AND j = 0 THEN p00 WHEN i = 0 THEN p01 WHEN j = 0 THEN p10 ELSE p11 END, 8) + 0.0 AS p, round(CASE WHEN i <> j THEN v01 WHEN i = 0 THEN v00 ELSE v11 END, 8) + 0.0 AS v FROM vv, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j)",
    "target_correlation": f"WITH {SDP.strip()} SELECT i, round(1 - sc, 5) AS v FROM s, (VALUES (0), (1)) x(i)",
    "generate_knockoffs": f"WITH {COPIES.strip()} SELECT vec_id, round(k0, 7) + 0.0 AS k0, round(k1, 7) + 0.0 AS k1 FROM k",
    "second_order_run": f"WITH {HIGH.strip()}, t AS (SELECT 1 - least(1.0, 2 * (1 - abs(b / sqrt((a + 0.001) * (d + 0.001))) - 0.001)) AS v FROM hc) SELECT i, round(v, 7) AS v, round(v, 7) AS mean_corr FROM t, (VALUES (0), (1)) x(i)",
    "feature_distance": f"WITH {CORR64} SELECT a.i, b.i AS j, round(sqrt(sum((a.v - b.v) ** 2)), 8) AS d FROM corr a JOIN corr b ON a.j = b.j AND a.i < b.i GROUP BY a.i, b.i",
    "s_asdp_pairs": f"WITH RECURSIVE {PAIRS_S.strip()} SELECT i::INTEGER AS i, round(sc, 7) AS s_corr, round(s, 7) AS s FROM s",
    "target_correlation_pairs": f"WITH RECURSIVE {PAIRS_S.strip()} SELECT i::INTEGER AS i, round(target, 7) + 0.0 AS v FROM s",
    "correlation_summary_pairs": f"WITH RECURSIVE {PAIRS_S.strip()}, kd AS (SELECT *, CASE WHEN i < 20 THEN 'cat' ELSE 'cont' END AS kind FROM s) SELECT coalesce(kind, 'all') AS kind, round(avg(target), 7) AS mean_corr, count(*) AS n_features FROM kd GROUP BY ROLLUP (kind)",
    "knockoff_plan_pairs": f"WITH RECURSIVE {PAIRS_PLAN.strip()} SELECT i::INTEGER AS i, j::INTEGER AS j, round(p, 6) + 0.0 AS p, round(v, 6) + 0.0 AS v FROM pr JOIN vv USING (i, j)",
    "generate_knockoffs_pairs": f"WITH RECURSIVE {PAIRS_COPIES.strip()} SELECT vec_id, i::INTEGER AS i, round(xk, 4) + 0.0 AS v FROM k",
    "copy_moments_pairs": f"""WITH RECURSIVE {PAIRS_COPIES.strip()}
SELECT a.i::INTEGER AS i, round(avg(a.xk), 6) + 0.0 AS mean, round(avg(a.xk * a.xk), 6) AS second, round(avg(a.x * a.xk), 6) + 0.0 AS original, round(avg(a.xk * coalesce(b.xk, 0.0)), 6) + 0.0 AS neighbour
FROM k a LEFT JOIN k b ON b.vec_id = a.vec_id AND b.i = a.i + 1 GROUP BY a.i""",
    "second_order_gap_pairs": f"""WITH RECURSIVE {PAIRS_COPIES.strip()},
mg AS (SELECT sqrt(sum(d * d)) AS mean_gap FROM (SELECT avg(x) - avg(xk) AS d FROM k GROUP BY i)),
cc AS MATERIALIZED (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS xx, covar_samp(a.xk, b.xk) AS kk, covar_samp(a.x, b.xk) AS xk FROM k a JOIN k b USING (vec_id) GROUP BY ALL)
SELECT round(any_value(mean_gap), 5) AS mean_gap, round(sqrt(sum((xx - kk) ** 2)), 5) AS cov_gap, round(sqrt(sum((xx - xk) ** 2) FILTER (i <> j)), 5) AS cross_gap FROM cc, mg""",
    "decorrelation_gap_pairs": f"WITH RECURSIVE {PAIRS_COPIES.strip()}, x AS (SELECT i, corr(x, xk) AS c FROM k GROUP BY i) SELECT i::INTEGER AS i, round(c, 5) + 0.0 AS corr, round(target, 5) + 0.0 AS target, round(c - target, 5) + 0.0 AS gap FROM x JOIN s USING (i)",
    "mmd_pairs": f"""WITH RECURSIVE {PAIRS_COPIES.strip()},
rw AS (SELECT *, dense_rank() OVER (ORDER BY vec_id) - 1 AS pos FROM k),
nn AS (SELECT max(pos) + 1 AS n FROM rw),
tw AS (SELECT a.pos AS pos, (a.x - b.x) ** 2 + (a.xk - b.xk) ** 2 AS same, (a.x - b.xk) ** 2 + (a.xk - b.x) ** 2 AS swap, {uniform(SEED, 'a.i')} < 0.5 AS chosen
       FROM rw a JOIN rw b ON a.i = b.i AND b.pos = a.pos + 1, nn WHERE a.pos % 2 = 0 OR (n % 2 = 1 AND a.pos = n - 2)),
dd AS (SELECT sum(same) AS same, sum(swap) AS fully, sum(CASE WHEN chosen THEN swap ELSE same END) AS part FROM tw GROUP BY pos)
SELECT round(avg(2 * {_kernel('same')} - 2 * {_kernel('fully')}), 6) + 0.0 AS full_swap,
       round(avg(2 * {_kernel('same')} - 2 * {_kernel('part')}), 6) + 0.0 AS partial_swap, count(*) AS n_pairs FROM dd""",
    "quality_kernel": f"""WITH RECURSIVE {PAIRS_COPIES.strip()},
rw AS (SELECT *, dense_rank() OVER (ORDER BY vec_id) - 1 AS pos FROM k),
tw AS (SELECT a.pos AS pos, b.pos AS other, (a.x - b.x) ** 2 + (a.xk - b.xk) ** 2 AS same, (a.x - b.xk) ** 2 + (a.xk - b.x) ** 2 AS swap, {uniform(SEED, '(a.pos // 16)', 'a.i')} < 0.5 AS chosen
       FROM rw a JOIN rw b ON a.i = b.i AND b.pos // 16 = a.pos // 16 AND b.pos > a.pos),
dd AS (SELECT sum(same) AS same, sum(swap) AS fully, sum(CASE WHEN chosen THEN swap ELSE same END) AS part FROM tw GROUP BY pos, other)
SELECT round(avg(2 * {_kernel('same')} - 2 * {_kernel('fully')}), 6) + 0.0 AS full_swap,
       round(avg(2 * {_kernel('same')} - 2 * {_kernel('part')}), 6) + 0.0 AS partial_swap, count(*) AS n_pairs FROM dd""",
    "group_features": f"WITH RECURSIVE {CORR64.replace('corr AS (', 'corr AS MATERIALIZED (')}, {_merges('corr', 'complete').strip()} SELECT i::INTEGER AS i, group_id FROM gp",
    "group_features_ward": f"WITH RECURSIVE {COV64.replace('cov AS (', 'cov AS MATERIALIZED (')}, {_merges('cov', 'ward').strip()} SELECT i::INTEGER AS i, group_id FROM gp",
    "group_features_pairs": f"WITH RECURSIVE {PAIRS.strip()}, {_merges('corr', 'complete').strip()} SELECT i::INTEGER AS i, group_id FROM gp",
    "group_sizes_pairs": f"WITH RECURSIVE {PAIRS.strip()}, {_merges('corr', 'complete').strip()}, z AS (SELECT g, count(*) AS n FROM gp GROUP BY g) SELECT count(*) AS n_groups, max(n) AS largest, round(avg(n), 9) AS mean_size FROM z",
    "representatives_pairs": f"WITH RECURSIVE {PAIRS.strip()}, {_merges('corr', 'complete').strip()}, kp AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS at FROM (SELECT DISTINCT g FROM gp)) SELECT a.at::INTEGER AS i, b.at::INTEGER AS j, round(v, 8) + 0.0 AS v FROM corr JOIN kp a ON a.g = i JOIN kp b ON b.g = j",
    "max_offdiag_pairs": f"WITH RECURSIVE {PAIRS.strip()}, {_merges('corr', 'complete').strip()} SELECT round(max(abs(v - (i = j)::INTEGER)), 8) + 0.0 AS max_offdiag FROM corr WHERE i IN (SELECT g FROM gp) AND j IN (SELECT g FROM gp)",
    "tyler_three_steps": _tyler64_sql(3),
    "group_three_features": _group3(lambda a, b: f"corr({a}, {b})", "low <= 0.5 * high"),
    "group_three_features_ward": _group3(lambda a, b: f"covar_samp({a}, {b})", "TRUE"),
    "group_sizes": f"WITH {LINKED}, z AS (SELECT group_id, count(*) AS n FROM g GROUP BY group_id) SELECT count(*) AS n_groups, max(n) AS largest, round(avg(n), 9) AS mean_size FROM z",
    "group_representatives": f"WITH {LINKED} SELECT group_id, min(i) AS i FROM g GROUP BY group_id",
    "submatrix": f"WITH {LINKED} SELECT i, j, round(v, 8) + 0.0 AS v FROM corr WHERE i IN (SELECT i FROM keep) AND j IN (SELECT i FROM keep)",
    "max_offdiag": f"WITH {LINKED} SELECT round(max(abs(v - (i = j)::INTEGER)), 8) + 0.0 AS max_offdiag FROM corr WHERE i IN (SELECT i FROM keep) AND j IN (SELECT i FROM keep)",
    "group_first_pc": f"WITH {PAIR.strip()}, e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS lam FROM c), w AS (SELECT m0, m1, b / sqrt(b * b + (lam - a) ** 2) AS w0, (lam - a) / sqrt(b * b + (lam - a) ** 2) AS w1 FROM e), sg AS (SELECT *, CASE WHEN (CASE WHEN abs(w0) >= abs(w1) THEN w0 ELSE w1 END) < 0 THEN -1.0 ELSE 1.0 END AS sg FROM w) SELECT vec_id, round(f1 * 2.0 - f0, 8) + 0.0 AS f2, round(sg * ((f0 - sg.m0) * w0 + (f1 - sg.m1) * w1), 8) + 0.0 AS group_3_pc FROM f, sg",
    "fdr": f"WITH {SETS.strip()} SELECT run_id, round_even(count(*) FILTER (s AND NOT t) / greatest(1, count(*) FILTER (s)), 2) AS fdr FROM m GROUP BY run_id",
    "power": f"WITH {SETS.strip()} SELECT run_id, round_even(count(*) FILTER (s AND t) / greatest(1, count(*) FILTER (t)), 2) AS power FROM m GROUP BY run_id",
    "fnp": f"WITH {SETS.strip()} SELECT run_id, round_even(count(*) FILTER (NOT s AND t) / greatest(1, count(*) FILTER (NOT s)), 2) AS fnp FROM m GROUP BY run_id",
    "confusion": f"WITH {SCORED}, x AS (SELECT count(*) FILTER (score >= 500 AND quality = 1) AS a11, count(*) FILTER (score >= 500 AND quality = 0) AS a12, count(*) FILTER (score < 500 AND quality = 1) AS a21, count(*) FILTER (score < 500 AND quality = 0) AS a22 FROM sc) SELECT *, round_even(100.0::DOUBLE * a11 / (a11 + a21), 1) AS sensitivity, round_even(100.0::DOUBLE * a22 / (a22 + a12), 1) AS specificity, round_even(100.0::DOUBLE * (a11 + a22) / (a11 + a12 + a21 + a22), 1) AS accuracy FROM x",
    "roc_curve": f"WITH sc AS (SELECT n_chars::DOUBLE AS score, quality AS y FROM labels JOIN documents USING (doc_id)), {ROC.strip()} SELECT score AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM cu WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg UNION ALL SELECT score + 1.0, 0.0::DOUBLE, 0.0::DOUBLE FROM cu WHERE rn = 1",
    "roc_auc": f"WITH sc AS (SELECT n_chars::DOUBLE AS score, quality AS y FROM labels JOIN documents USING (doc_id)), {ROC.strip()} SELECT max(p)::BIGINT AS n_pos, max(n)::BIGINT AS n_neg, round(sum(neg * (tp - pos / 2)) / (max(p)::DOUBLE * max(n)), 9) AS auc FROM cu",
    "roc_auc_many_scores": f"WITH sc AS (SELECT o_totalprice AS score, (o_orderstatus = 'F')::INTEGER AS y FROM orders), {ROC.strip()} SELECT max(p)::BIGINT AS n_pos, max(n)::BIGINT AS n_neg, round(sum(neg * (tp - pos / 2)) / (max(p)::DOUBLE * max(n)), 9) AS auc FROM cu",
    "feature_histogram": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, b::INTEGER AS bin, round(lo + b * (hi - lo) / 10, 6) AS low, round(lo + (b + 1) * (hi - lo) / 10, 6) AS high, (SELECT count(*) FROM lineitem WHERE least(floor(({c} - lo) / ((hi - lo) / 10)), 9) = b) AS n FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem), range(10) t(b)"
        for c in ("l_quantity", "l_extendedprice")),
    "run_params": _RUN_PARAMS,
    "write_run_params": _RUN_PARAMS,
    "accumulate_run_params": f"SELECT * FROM ({_RUN_PARAMS}) UNION ALL SELECT * FROM ({_run_params('gaussian', 'NULL::INTEGER', '150', 25)})",
    "sweep_dimension": f"""WITH {CORR64},
gr AS (SELECT (li * 2 + di) AS g, CASE WHEN li = 1 THEN 0.001 ELSE 0.01 END::DOUBLE AS lam, CASE WHEN di = 1 THEN 0.001 ELSE 0.01 END::DOUBLE AS del FROM range(2) x(li), range(2) y(di)),
ps AS (SELECT k, p::INTEGER AS p, (SELECT max(abs(v - (i = j)::INTEGER)) FROM corr WHERE i < p AND j < p) AS m FROM (VALUES (0, 2), (1, 16), (2, 64)) t(k, p))
SELECT (g * 3 + k)::INTEGER AS run_id, lam AS lambda, del AS delta, p, round(m, 8) AS max_offdiag FROM gr, ps""",
    "read_csv_features": f"""WITH t AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS row_id, p_partkey, p_size, p_retailprice, count(*) OVER () AS n FROM part),
rk AS (SELECT *, row_number() OVER (ORDER BY {uniform(SEED, 'row_id')}, row_id) AS rn FROM t)
SELECT row_id, p_partkey, p_size, p_retailprice, rn <= round_even(0.8 * n, 0) AS is_train FROM rk""",
    "read_feature_lists": """WITH c AS (SELECT DISTINCT 0 AS chunk_id, 'p_brand' AS factor, p_brand AS v FROM part UNION SELECT DISTINCT 1, 'p_type', p_type FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY chunk_id, v) + 1 AS pos, row_number() OVER (PARTITION BY chunk_id ORDER BY v) - 1 AS level FROM c)
SELECT pos::INTEGER AS pos, factor || '_' || v AS feature, 'cat' AS kind, chunk_id::INTEGER AS chunk_id, level::VARCHAR AS category, CASE WHEN factor = 'p_brand' THEN 2 END AS group_id FROM r
UNION ALL SELECT 0, 'p_size', 'cont', NULL, NULL, 1 UNION ALL SELECT 1, 'p_retailprice', 'cont', NULL, NULL, NULL""",
    "two_part_plan": "WITH t AS (SELECT (l_extendedprice >= 30000)::INTEGER::DOUBLE AS mid, (l_extendedprice >= 60000)::INTEGER::DOUBLE AS top, l_extendedprice AS gross, l_extendedprice * (1.0::DOUBLE - 3.0::DOUBLE * l_discount) AS net FROM lineitem) "
    + _equi_part("discrete", ("mid", "top"), "mid", "top", 0.0001) + " UNION ALL " + _equi_part("continuous", ("gross", "net"), "gross", "net", 0.0001),
    "estimator_sweep": f"WITH {PAIR.strip()}, gr AS (SELECT * FROM (VALUES (0, 0.0), (1, 0.001), (2, 0.01)) x(run_id, reg)) SELECT run_id, i, round(1 - least(1.0, 2 * (1 - abs(b / sqrt((a + reg) * (d + reg)))) - 0.001), 5) AS v FROM c, gr, (VALUES (0), (1)) y(i)",
    "second_order_gap": f"WITH {COPIES.strip()} SELECT round(sqrt((avg(f0) - avg(k0)) ** 2 + (avg(f1) - avg(k1)) ** 2), 8) AS mean_gap, round(sqrt((var_samp(f0) - var_samp(k0)) ** 2 + 2 * (covar_samp(f0, f1) - covar_samp(k0, k1)) ** 2 + (var_samp(f1) - var_samp(k1)) ** 2), 8) AS cov_gap, round(sqrt((covar_samp(f0, f1) - covar_samp(f0, k1)) ** 2 + (covar_samp(f0, f1) - covar_samp(f1, k0)) ** 2), 8) AS cross_gap FROM k",
    "decorrelation_gap": f"WITH {COPIES.strip()}, x AS (SELECT 0 AS i, corr(f0, k0) AS corr, any_value(1 - sc) AS target FROM k UNION ALL SELECT 1, corr(f1, k1), any_value(1 - sc) FROM k) SELECT i, round(corr, 7) AS corr, round(target, 7) AS target, round(corr - target, 7) + 0.0 AS gap FROM x",
    "mmd": f"""WITH {COPIES.strip()},
rw AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM k),
tw AS (SELECT a.f0 AS a0, a.f1 AS a1, a.k0 AS c0, a.k1 AS c1, b.f0 AS b0, b.f1 AS b1, b.k0 AS e0, b.k1 AS e1
       FROM rw a JOIN rw b ON b.pos = a.pos + 1 AND a.pos % 2 = 0),
sw AS (SELECT {uniform(SEED, '0')} < 0.5 AS s0, {uniform(SEED, '1')} < 0.5 AS s1),
ds AS (SELECT (a0 - b0) ** 2 + (c0 - e0) ** 2 AS same0, (a1 - b1) ** 2 + (c1 - e1) ** 2 AS same1,
         (a0 - e0) ** 2 + (c0 - b0) ** 2 AS swap0, (a1 - e1) ** 2 + (c1 - b1) ** 2 AS swap1 FROM tw),
dd AS (SELECT same0 + same1 AS same, swap0 + swap1 AS fully, CASE WHEN s0 THEN swap0 ELSE same0 END + CASE WHEN s1 THEN swap1 ELSE same1 END AS part FROM ds, sw)
SELECT round(avg(2 * {_kernel('same')} - 2 * {_kernel('fully')}), 8) + 0.0 AS full_swap,
       round(avg(2 * {_kernel('same')} - 2 * {_kernel('part')}), 8) + 0.0 AS partial_swap, count(*) AS n_pairs FROM dd""",
}
ORACLES["quality_second_order"] = ORACLES["second_order_gap_pairs"]
ORACLES["quality_decorrelation"] = ORACLES["decorrelation_gap_pairs"]
ORACLES["sparse_covariance"] = """WITH c AS (SELECT DISTINCT 0 AS chunk, p_brand AS v FROM part UNION SELECT DISTINCT 1, p_size::VARCHAR FROM part),
ps AS (SELECT *, (row_number() OVER (ORDER BY chunk, v) - 1)::INTEGER AS pos FROM c),
f AS (SELECT p_partkey, pos, ((chunk = 0 AND p_brand = v) OR (chunk = 1 AND p_size::VARCHAR = v))::INTEGER::DOUBLE AS x FROM part, ps
  UNION ALL SELECT p_partkey, (SELECT max(pos) + 1 FROM ps), p_retailprice FROM part)
SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.x, b.x), 7) + 0.0 AS v FROM f a JOIN f b USING (p_partkey) GROUP BY ALL"""

# every feature of the first half mixed into one of the second: Ward blocks join features that aren't neighbours
_FAR = PAIRS.replace("CASE WHEN i % 2 = 0 THEN embedding[i + 1]::DOUBLE ELSE embedding[i]::DOUBLE +", "CASE WHEN i < 32 THEN embedding[i + 1]::DOUBLE ELSE embedding[i - 31]::DOUBLE +")
_FAR = _FAR[: _FAR.index("bl AS MATERIALIZED")] + _merges("cov", "ward", 31).strip() + """,
bl AS MATERIALIZED (SELECT a.i AS i, coalesce(min(least(1.0::DOUBLE, 2 * (1 - abs(v)))), 1.0::DOUBLE) AS s
  FROM gp a LEFT JOIN (SELECT corr.i AS i, corr.v AS v FROM corr JOIN gp x ON x.i = corr.i JOIN gp y ON y.i = corr.j AND y.g = x.g WHERE corr.i <> corr.j) m ON m.i = a.i GROUP BY a.i)"""
ORACLES["s_asdp_cluster_pairs"] = f"WITH RECURSIVE {_FAR.strip()}{PAIRS_S[len(PAIRS):]} SELECT i::INTEGER AS i, round(sc, 7) AS s_corr, round(s, 7) AS s FROM s"
# the sign start has the lowest determinant, so the fit from all starts is its fit
ORACLES["mcd_all_starts"] = ORACLES["mcd_sign_start"]


def _ridged_pairs(run_id, reg):
    plain = "cov AS MATERIALIZED (SELECT x.i AS i, y.i AS j, covar_samp(x.v, y.v) AS v FROM l x JOIN l y USING (vec_id) GROUP BY ALL),"
    ridged = PAIRS_S.replace(plain, plain.replace("cov AS", "plain AS") + f" cov AS MATERIALIZED (SELECT i, j, v + CASE WHEN i = j THEN {reg}::DOUBLE ELSE 0 END AS v FROM plain),")
    return f"SELECT * FROM (WITH RECURSIVE {ridged.strip()} SELECT {run_id} AS run_id, i::INTEGER AS i, round(target, 6) + 0.0 AS v FROM s)"


ORACLES["estimator_sweep_pairs"] = " UNION ALL ".join(_ridged_pairs(k, reg) for k, reg in enumerate((0.0, 0.001, 0.01)))
