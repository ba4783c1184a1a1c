"""SQL (DuckDB) for the inference queries: pruning over the three levels of the derived tree.

Transition probabilities come from a spectral form and not from the series that the kernels use.
"""

from __future__ import annotations

import numpy as np

from ..functions.models import NucleotideModel, RateMixture, spectral_form


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(float(x)) if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)


def prelude(model: NucleotideModel, mixture: RateMixture) -> str:
    """CTEs: cat, eig, root_pi, obs, and for suppliers, nations and regions their messages and partial likelihoods.

    nat, reg and top hold log partials l by site, category c and state a.
    """
    form = spectral_form(model)
    cats = [(c, float(mixture.rate(c)), float(np.log(mixture.weight(c)))) for c in range(mixture.count)]
    eig = [(k, a, b, float(form.lam[k]), float(form.coef[k, a, b])) for k in range(4) for a in range(4) for b in range(4)]
    root = [(a, float(x)) for a, x in enumerate(model.root)]
    p = "sum(f * exp(lam * r * len))"
    return f"""
cat(c, r, lw) AS (VALUES {_values(cats)}),
eig(k, a, b, lam, f) AS (VALUES {_values(eig)}),
root_pi(a, pi) AS (VALUES {_values(root)}),
obs AS (SELECT l_orderkey % 512 AS site, l_suppkey AS s, bit_or(CAST(1 << CAST(l_partkey % 4 AS INTEGER) AS INTEGER)) AS mask
        FROM lineitem GROUP BY 1, 2),
sites AS (SELECT DISTINCT site FROM obs),
psup AS (SELECT u, c, a, b, {p} AS p FROM (SELECT DISTINCT s_suppkey % 1000 AS u, 0.01 + 0.0001 * (s_suppkey % 1000) AS len FROM supplier), cat, eig GROUP BY 1, 2, 3, 4),
pnat AS (SELECT n_nationkey AS n, c, a, b, {p} AS p FROM (SELECT n_nationkey, 0.02 + 0.01 * (n_nationkey % 7) AS len FROM nation), cat, eig GROUP BY 1, 2, 3, 4),
preg AS (SELECT r_regionkey AS g, c, a, b, {p} AS p FROM (SELECT r_regionkey, 0.05 + 0.01 * r_regionkey AS len FROM region), cat, eig GROUP BY 1, 2, 3, 4),
masks AS (SELECT CAST(range AS INTEGER) AS mask FROM range(1, 16)),
msup AS (SELECT u, c, a, mask, ln(sum(CASE WHEN (mask >> b) & 1 = 1 THEN p ELSE 0 END)) AS lm FROM psup, masks GROUP BY 1, 2, 3, 4),
nsum AS (SELECT site, s_nationkey AS n, c, a, sum(lm) AS l FROM obs JOIN supplier ON s = s_suppkey JOIN msup ON u = s_suppkey % 1000 AND msup.mask = obs.mask GROUP BY 1, 2, 3, 4),
st(a) AS (VALUES (0), (1), (2), (3)),
nat1 AS (SELECT x.site, x.n_nationkey AS n, x.n_regionkey AS g, x.c, x.a, coalesce(nsum.l, 0) AS l
         FROM (SELECT site, n_nationkey, n_regionkey, c, a FROM sites, nation, cat, st) x
         LEFT JOIN nsum ON nsum.site = x.site AND nsum.n = x.n_nationkey AND nsum.c = x.c AND nsum.a = x.a),
ntop AS (SELECT site, n, c, max(l) AS t FROM nat1 GROUP BY 1, 2, 3),
nmsg AS (SELECT nat1.site, nat1.n, nat1.g, nat1.c, pnat.a, max(t) + ln(sum(p * exp(l - t))) AS lm
         FROM nat1 JOIN ntop USING (site, n, c) JOIN pnat ON pnat.n = nat1.n AND pnat.c = nat1.c AND pnat.b = nat1.a GROUP BY 1, 2, 3, 4, 5),
rsum AS (SELECT site, g, c, a, sum(lm) AS l FROM nmsg GROUP BY 1, 2, 3, 4),
reg AS (SELECT x.site, x.r_regionkey AS g, x.c, x.a, coalesce(rsum.l, 0) AS l
        FROM (SELECT site, r_regionkey, c, a FROM sites, region, cat, st) x
        LEFT JOIN rsum ON rsum.site = x.site AND rsum.g = x.r_regionkey AND rsum.c = x.c AND rsum.a = x.a),
rtop AS (SELECT site, g, c, max(l) AS t FROM reg GROUP BY 1, 2, 3),
rmsg AS (SELECT reg.site, reg.g, reg.c, preg.a, max(t) + ln(sum(p * exp(l - t))) AS lm
         FROM reg JOIN rtop USING (site, g, c) JOIN preg ON preg.g = reg.g AND preg.c = reg.c AND preg.b = reg.a GROUP BY 1, 2, 3, 4),
top AS (SELECT site, c, a, sum(lm) AS l FROM rmsg GROUP BY 1, 2, 3),
ttop AS (SELECT site, c, max(l) AS t FROM top GROUP BY 1, 2),
bycat AS (SELECT top.site, top.c, max(t) + ln(sum(pi * exp(l - t))) + max(lw) AS lc
          FROM top JOIN ttop USING (site, c) JOIN root_pi USING (a) JOIN cat USING (c) GROUP BY 1, 2),
ctop AS (SELECT site, max(lc) AS t FROM bycat GROUP BY 1),
ll AS (SELECT site, max(t) + ln(sum(exp(lc - t))) AS ll FROM bycat JOIN ctop USING (site) GROUP BY 1),
catp AS (SELECT site, c, exp(lc - ll) AS w FROM bycat JOIN ll USING (site))
"""


#: Downward pass: what lies outside of each region and nation, as logs, by state of its own and of its parent.
DOWN = """,
rout AS (SELECT top.site, rmsg.g, top.c, top.a, ln(pi) + top.l - rmsg.lm AS l FROM top JOIN rmsg USING (site, c, a) JOIN root_pi USING (a)),
redge AS (SELECT rout.site, rout.g, rout.c, rout.a AS pa, reg.a AS ca, rout.l + ln(p) + reg.l AS l
          FROM rout JOIN preg ON preg.g = rout.g AND preg.c = rout.c AND preg.a = rout.a JOIN reg ON reg.site = rout.site AND reg.g = rout.g AND reg.c = rout.c AND reg.a = preg.b),
rnorm AS (SELECT site, g, c, max(l) AS t FROM redge GROUP BY 1, 2, 3),
rz AS (SELECT site, g, c, max(t) + ln(sum(exp(l - t))) AS z FROM redge JOIN rnorm USING (site, g, c) GROUP BY 1, 2, 3),
rin AS (SELECT redge.site, redge.g, redge.c, redge.ca AS a, max(t) + ln(sum(exp(redge.l - t))) AS l FROM redge JOIN rnorm USING (site, g, c) GROUP BY 1, 2, 3, 4),
nout AS (SELECT rin.site, nmsg.n, rin.g, rin.c, rin.a, rin.l - nmsg.lm AS l FROM rin JOIN nmsg ON nmsg.site = rin.site AND nmsg.g = rin.g AND nmsg.c = rin.c AND nmsg.a = rin.a),
nedge AS (SELECT nout.site, nout.n, nout.c, nout.a AS pa, nat1.a AS ca, nout.l + ln(p) + nat1.l AS l
          FROM nout JOIN pnat ON pnat.n = nout.n AND pnat.c = nout.c AND pnat.a = nout.a JOIN nat1 ON nat1.site = nout.site AND nat1.n = nout.n AND nat1.c = nout.c AND nat1.a = pnat.b),
nnorm AS (SELECT site, n, c, max(l) AS t FROM nedge GROUP BY 1, 2, 3),
nz AS (SELECT site, n, c, max(t) + ln(sum(exp(l - t))) AS z FROM nedge JOIN nnorm USING (site, n, c) GROUP BY 1, 2, 3)
"""


def log_likelihood(model: NucleotideModel, mixture: RateMixture) -> str:
    return f"WITH {prelude(model, mixture)} SELECT CAST(site AS BIGINT) AS site, round(ll, 6) AS log_likelihood FROM ll"


def category_posterior(model: NucleotideModel, mixture: RateMixture) -> str:
    return f"WITH {prelude(model, mixture)} SELECT CAST(site AS BIGINT) AS site, CAST(c AS INTEGER) AS category, round(w, 6) AS p FROM catp"


def node_marginals(model: NucleotideModel, mixture: RateMixture) -> str:
    return f"""WITH {prelude(model, mixture)} {DOWN},
tz AS (SELECT site, c, max(t) + ln(sum(pi * exp(l - t))) AS z FROM top JOIN ttop USING (site, c) JOIN root_pi USING (a) GROUP BY 1, 2)
SELECT CAST(site AS BIGINT) AS site, CAST(node_id AS BIGINT) AS node_id, CAST(a AS INTEGER) AS state, round(sum(w * q), 6) AS p FROM (
  SELECT top.site, 0 AS node_id, top.a, top.c, pi * exp(l - z) AS q FROM top JOIN tz USING (site, c) JOIN root_pi USING (a)
  UNION ALL SELECT site, 1 + g, ca, c, sum(exp(l - z)) FROM redge JOIN rz USING (site, g, c) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT site, 6 + n, ca, c, sum(exp(l - z)) FROM nedge JOIN nz USING (site, n, c) GROUP BY 1, 2, 3, 4
) JOIN catp USING (site, c) GROUP BY 1, 2, 3"""


def edge_marginals(model: NucleotideModel, mixture: RateMixture) -> str:
    return f"""WITH {prelude(model, mixture)} {DOWN}
SELECT CAST(site AS BIGINT) AS site, CAST(child_id AS BIGINT) AS child_id, CAST(pa AS INTEGER) AS parent_state, CAST(ca AS INTEGER) AS child_state, round(sum(w * q), 6) AS p FROM (
  SELECT site, 1 + g AS child_id, pa, ca, c, exp(l - z) AS q FROM redge JOIN rz USING (site, g, c)
) JOIN catp USING (site, c) GROUP BY 1, 2, 3, 4"""


def joint_maximum(model: NucleotideModel, mixture: RateMixture) -> str:
    """site, category, log_weight, and the states of the root, regions and nations as one string."""
    return f"""WITH {prelude(model, mixture)},
xsup AS (SELECT u, c, a, mask, max(CASE WHEN (mask >> b) & 1 = 1 THEN ln(p) END) AS lm FROM psup, masks GROUP BY 1, 2, 3, 4),
xall AS (SELECT x.site, s_nationkey AS n, c, a, sum(lm) AS l
         FROM (SELECT sites.site, s_suppkey, s_nationkey, coalesce(mask, 15) AS mask FROM sites CROSS JOIN supplier LEFT JOIN obs ON obs.site = sites.site AND obs.s = s_suppkey) x
         JOIN xsup ON u = s_suppkey % 1000 AND xsup.mask = x.mask GROUP BY 1, 2, 3, 4),
xnat AS (SELECT z.site, z.n_nationkey AS n, z.n_regionkey AS g, z.c, z.a, coalesce(xall.l, 0) AS l
         FROM (SELECT site, n_nationkey, n_regionkey, c, a FROM sites, nation, cat, st) z
         LEFT JOIN xall ON xall.site = z.site AND xall.n = z.n_nationkey AND xall.c = z.c AND xall.a = z.a),
xn AS (SELECT xnat.site, xnat.n, xnat.g, xnat.c, pnat.a, max(ln(p) + l) AS lm, arg_max(pnat.b, ln(p) + l) AS b
       FROM xnat JOIN pnat ON pnat.n = xnat.n AND pnat.c = xnat.c AND pnat.b = xnat.a GROUP BY 1, 2, 3, 4, 5),
xrs AS (SELECT site, g, c, a, sum(lm) AS l FROM xn GROUP BY 1, 2, 3, 4),
xr AS (SELECT xrs.site, xrs.g, xrs.c, preg.a, max(ln(p) + l) AS lm, arg_max(preg.b, ln(p) + l) AS b
       FROM xrs JOIN preg ON preg.g = xrs.g AND preg.c = xrs.c AND preg.b = xrs.a GROUP BY 1, 2, 3, 4),
xt AS (SELECT site, c, a, sum(lm) + max(ln(pi)) + max(lw) AS l FROM xr JOIN root_pi USING (a) JOIN cat USING (c) GROUP BY 1, 2, 3),
best AS (SELECT site, c, a, l FROM xt QUALIFY row_number() OVER (PARTITION BY site ORDER BY l DESC, c, a) = 1),
breg AS (SELECT best.site, best.c, xr.g, xr.b AS a FROM best JOIN xr USING (site, c, a)),
bnat AS (SELECT xn.site, xn.n, xn.b AS a FROM breg JOIN xn ON xn.site = breg.site AND xn.c = breg.c AND xn.g = breg.g AND xn.a = breg.a),
states AS (SELECT site, 0 AS node, a FROM best UNION ALL SELECT site, 1 + g, a FROM breg UNION ALL SELECT site, 6 + n, a FROM bnat)
SELECT CAST(site AS BIGINT) AS site, CAST(any_value(best.c) AS BIGINT) AS category, round(any_value(l), 6) AS log_weight, string_agg(CAST(states.a AS VARCHAR), '' ORDER BY node) AS states
FROM best JOIN states USING (site) GROUP BY 1"""


def posterior_sample(model: NucleotideModel, mixture: RateMixture) -> str:
    """All draws 0.5: category, then states from the root down, each the first whose running share exceeds 0.5."""
    pick = "QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY CASE WHEN upto > 0.5 THEN 0 ELSE 1 END, {x}) = 1"
    share = "sum(q) OVER (PARTITION BY {by} ORDER BY {x}) / sum(q) OVER (PARTITION BY {by}) AS upto"
    return f"""WITH {prelude(model, mixture)},
sc AS (SELECT site, c FROM (SELECT site, c, sum(w) OVER (PARTITION BY site ORDER BY c) AS upto FROM catp) {pick.format(by="site", x="c")}),
s0 AS (SELECT site, c, a FROM (SELECT site, c, a, {share.format(by="site", x="a")} FROM (SELECT top.site, top.c, top.a, pi * exp(l - t) AS q FROM top JOIN sc USING (site, c) JOIN ttop USING (site, c) JOIN root_pi USING (a))) {pick.format(by="site", x="a")}),
s1 AS (SELECT site, c, g, a FROM (SELECT site, c, g, a, {share.format(by="site, g", x="a")} FROM
  (SELECT s0.site, s0.c, preg.g, preg.b AS a, p * exp(reg.l - t) AS q FROM s0 JOIN preg ON preg.c = s0.c AND preg.a = s0.a JOIN reg ON reg.site = s0.site AND reg.g = preg.g AND reg.c = s0.c AND reg.a = preg.b JOIN rtop ON rtop.site = s0.site AND rtop.g = preg.g AND rtop.c = s0.c)) {pick.format(by="site, g", x="a")}),
s2 AS (SELECT site, n, a FROM (SELECT site, n, a, {share.format(by="site, n", x="a")} FROM
  (SELECT s1.site, pnat.n, pnat.b AS a, p * exp(nat1.l - t) AS q FROM s1 JOIN nation ON n_regionkey = s1.g JOIN pnat ON pnat.n = n_nationkey AND pnat.c = s1.c AND pnat.a = s1.a JOIN nat1 ON nat1.site = s1.site AND nat1.n = pnat.n AND nat1.c = s1.c AND nat1.a = pnat.b JOIN ntop ON ntop.site = s1.site AND ntop.n = pnat.n AND ntop.c = s1.c)) {pick.format(by="site, n", x="a")}),
states AS (SELECT site, 0 AS node, a FROM s0 UNION ALL SELECT site, 1 + g, a FROM s1 UNION ALL SELECT site, 6 + n, a FROM s2)
SELECT CAST(site AS BIGINT) AS site, CAST(any_value(sc.c) AS BIGINT) AS category, string_agg(CAST(states.a AS VARCHAR), '' ORDER BY node) AS states FROM sc JOIN states USING (site) GROUP BY 1"""
