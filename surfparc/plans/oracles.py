"""The same results as plain SQL, for comparison on the same tables."""

from __future__ import annotations


def r6(e: str) -> str:
    return f"(case when abs({e}) < 5e-7 then 0::double else round(({e})::double, 6) end)"


MESH = """mesh as materialized (
  select vec_id // 250 as sub, vec_id % 250 as v, (vec_id % 250) // 25 as gr, vec_id % 25 as gc, label,
         (vec_id % 25)::double * 10 as x, ((vec_id % 250) // 25)::double * 10 as y, embedding[1]::double * 10 as z,
         case when label = 0 then 1 else 2 end as mars, embedding
  from embeddings)"""
EMB = "emb as (select sub, v, label, mars, generate_subscripts(embedding, 1) - 1 as d, unnest(embedding)::double as e from mesh)"
BRAINS = "brain as materialized (select sub // 2 as sub, v + 250 * (sub % 2) as v, case when sub % 2 = 0 then 'lh' else 'rh' end as hemi, label, mars, embedding from mesh)"
EDGES = """edges as materialized (
  select a.sub, a.v as src, b.v as dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as w
  from mesh a join mesh b on a.sub = b.sub
   and ((a.gr = b.gr and abs(a.gc - b.gc) = 1) or (a.gc = b.gc and abs(a.gr - b.gr) = 1)))"""
FACES = """faces as materialized (
  select a.sub, t.f, t.v0, t.v1, t.v2 from mesh a join mesh b on a.sub = b.sub and b.v = a.v + 26,
    lateral (select unnest([{'f': a.v*2, 'v0': a.v, 'v1': a.v+1, 'v2': a.v+25}, {'f': a.v*2+1, 'v0': a.v+1, 'v1': a.v+26, 'v2': a.v+25}]) as t)
  where a.gc < 24)"""
FACE_EDGES = """fedges as materialized (
  select q.sub, q.src, q.dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as w from (
    select sub, v0 as src, v1 as dst from faces union select sub, v1, v0 from faces union select sub, v1, v2 from faces
    union select sub, v2, v1 from faces union select sub, v2, v0 from faces union select sub, v0, v2 from faces) q
  join mesh a on a.sub = q.sub and a.v = q.src join mesh b on b.sub = q.sub and b.v = q.dst)"""
GEOMETRY = """corner as materialized (
  select f.*, a.x x0, a.y y0, a.z z0, b.x x1, b.y y1, b.z z1, c.x x2, c.y y2, c.z z2 from faces f
  join mesh a on a.sub = f.sub and a.v = f.v0 join mesh b on b.sub = f.sub and b.v = f.v1 join mesh c on c.sub = f.sub and c.v = f.v2),
facen as materialized (
  select sub, v0, v1, v2, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) as nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) as ny, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) as nz from corner),
vn as (
  select sub, v, sum(nx) nx, sum(ny) ny, sum(nz) nz, sum(sqrt(nx*nx+ny*ny+nz*nz)/2)/3 as area
  from (select sub, unnest([v0, v1, v2]) as v, nx, ny, nz from facen) group by 1, 2),
geom as materialized (
  select sub, v, nx/sqrt(nx*nx+ny*ny+nz*nz) as nx, ny/sqrt(nx*nx+ny*ny+nz*nz) as ny, nz/sqrt(nx*nx+ny*ny+nz*nz) as nz, area from vn)"""
UNFOLDED = """half as (
  select sub, f, least(v0,v1) lo, greatest(v0,v1) hi, v2 third from faces union all
  select sub, f, least(v1,v2), greatest(v1,v2), v0 from faces union all select sub, f, least(v2,v0), greatest(v2,v0), v1 from faces),
duo as materialized (select sub, lo, hi, arg_min(third, f) as base, arg_max(third, f) as far from half group by 1, 2, 3 having count(*) = 2),
q1 as materialized (select d.*, l.x lx, l.y ly, l.z lz from duo d join mesh l on l.sub=d.sub and l.v=d.lo),
q2 as materialized (select d.*, h.x-lx ex, h.y-ly ey, h.z-lz ez from q1 d join mesh h on h.sub=d.sub and h.v=d.hi),
q3 as materialized (select d.*, f.x-lx fx, f.y-ly fy, f.z-lz fz from q2 d join mesh f on f.sub=d.sub and f.v=d.far),
q4 as materialized (select d.*, b.x-lx bx, b.y-ly by_, b.z-lz bz from q3 d join mesh b on b.sub=d.sub and b.v=d.base),
frame as (select *, sqrt(ex*ex+ey*ey+ez*ez) as len from q4),
along as (
  select *, (fx*ex+fy*ey+fz*ez)/len as fa, (bx*ex+by_*ey+bz*ez)/len as ba, fx*fx+fy*fy+fz*fz as ff, bx*bx+by_*by_+bz*bz as bb from frame where len > 0),
perp as (select *, sqrt(greatest(0, ff-fa*fa)) as fp, sqrt(greatest(0, bb-ba*ba)) as bp from along),
unfold1 as (
  select sub, base, far, sqrt((fa-ba)*(fa-ba)+(bp+fp)*(bp+fp)) as w from perp
  where bp > 0 and ba+(fa-ba)*bp/(bp+fp) > 0 and ba+(fa-ba)*bp/(bp+fp) < len),
unfolded as materialized (select sub, base as src, far as dst, w from unfold1 union all select sub, far, base, w from unfold1)"""
THRESH = """ranked as (select sub, e, row_number() over (partition by sub order by e desc) as rk, count(*) over (partition by sub) as n from emb),
thr as (select sub, e as threshold from ranked where rk = greatest(1, least(n, floor(n * 0.1 + 0.5))))"""
BITS = """bits as (select emb.sub, v, label, mars, d, case when mars = 2 and e >= threshold then 1 else 0 end as b from emb join thr using (sub)),
ones as (select sub, v, sum(b)::bigint as ones from bits group by 1, 2),
stats as (select sub, v, ones, ones/64.0::double as row_mean, ones - 64 * (ones/64.0::double) * (ones/64.0::double) as row_sumsq,
   case when ones > 0 and ones < 64 then 1 else 0 end as is_scaled from ones),
packed as (select *, (1 - row_mean) * case when is_scaled = 1 then 1/sqrt(row_sumsq) else 1 end as value_on,
   -row_mean * case when is_scaled = 1 then 1/sqrt(row_sumsq) else 1 end as value_off from stats)"""
CENT = """csum as (select sub, label as l, d, sum(e) as s from emb where label > 0 group by 1, 2, 3),
cent as (select sub, l, d, s / sqrt(sum(s*s) over (partition by sub, l)) as m from csum)"""
ACC = "acc as (select emb.sub, v, label, l, sum(e * m) as acc from emb join cent on emb.sub = cent.sub and emb.d = cent.d where mars = 2 group by 1, 2, 3, 4)"


def soft(k: float, name: str = "soft") -> str:
    return f"""{name}_e as (select sub, v, label, l, acc, exp({k}*acc - max({k}*acc) over (partition by sub, v)) as ex from acc),
{name} as (select sub, v, label, l, acc, ex / sum(ex) over (partition by sub, v) as lam from {name}_e)"""


SOFT = soft(20.0)
POTTS = """sent as (select e.sub, e.dst as v, s.l, sum(s.lam) as same from soft s join edges e on e.sub = s.sub and e.src = s.v group by 1, 2, 3),
rowsum as (select sub, v, sum(same) as tot from sent group by 1, 2),
potts as (select s.*, coalesce(r.tot, 0) - coalesce(n.same, 0) as v_potts from soft s left join rowsum r using (sub, v) left join sent n using (sub, v, l))"""
PIECES = "p as (select * replace (case when label = 0 then 0 else label % 3 + 1 end as label) from mesh)"
COMPONENTS = """same as (select e.sub, e.src, e.dst from edges e join p a on a.sub=e.sub and a.v=e.src join p b on b.sub=e.sub and b.v=e.dst where a.label=b.label and a.label<>0),
walk as (select sub, v, v as seen from p where label <> 0 union select w.sub, w.v, s.dst from walk w join same s on s.sub=w.sub and s.src=w.seen),
comp as (select w.sub, w.v, p.label, min(seen) as comp from walk w join p on p.sub=w.sub and p.v=w.v group by 1, 2, 3)"""
SPAN = "span as (select min(ts)::date as d0, max(ts)::date as d1 from events), n_days as (select d1 - d0 + 1 as n from span)"
DAYS = """daily as (select event_type as run, user_id as v, ts::date - (select d0 from span) as t, avg(value) as x from events group by 1, 2, 3),
grid as (select run, v, t from (select distinct run, v from daily), (select unnest(range((select n from n_days))) as t)),
series as (select g.run, g.v, g.t, coalesce(x, 0) as x from grid g left join daily d on d.run=g.run and d.v=g.v and d.t=g.t)"""
ZS = """cen as (select run, v, t, x - avg(x) over (partition by run, v) as c from series),
zs as (select run, v, t, case when sqrt(sum(c*c) over (partition by run, v)) = 0 then 0 else c / sqrt(sum(c*c) over (partition by run, v)) end as z from cen)"""
CORR = "corr as (select a.run, a.v, b.v as seed, sum(a.z * b.z) as c from zs a join zs b on a.run=b.run and a.t=b.t where b.v < 42 group by 1, 2, 3)"
PRIOR = """own as (select v, label as l from mesh where label > 0),
theta as (select o.v, o.l, count(*) / any_value(n)::double as theta from own o join (select v, count(*) as n from mesh group by 1) using (v) group by 1, 2),
mask as (select v, l from own union select e.dst, m.label from edges e join mesh m on m.sub=e.sub and m.v=e.src where m.label > 0)"""
DEBYE = {
    1: "(3*p - 5*p**3)/24",
    2: "(81*p**2 - 462*p**4 + 385*p**6)/1152",
    3: "(30375*p**3 - 369603*p**5 + 765765*p**7 - 425425*p**9)/414720",
    4: "(4465125*p**4 - 94121676*p**6 + 349922430*p**8 - 446185740*p**10 + 185910725*p**12)/39813120",
    5: "(1519035525*p**5 - 49286948607*p**7 + 284499769554*p**9 - 614135872350*p**11 + 566098157625*p**13 - 188699385875*p**15)/6688604160",
}


def cdln(table: str, kappa: str, nu: float, keep: str, out: str) -> str:
    """CTE adding ``out = nu log k - log I_nu(k)`` to ``table`` as ``{table}_c``."""
    series = " + ".join(f"({e})/{nu}**{i}" for i, e in DEBYE.items())
    return f"""{table}_p as (select {keep}, ({kappa})::double as k, 1/sqrt(1 + ({kappa})*({kappa})/({nu}*{nu})) as p from {table}),
{table}_c as (select {keep}, {nu}*ln(k) - ({nu}*(1/p + ln(k/{nu}/(1 + 1/p))) - 0.5*ln(2*pi()*{nu}) - 0.5*ln(1/p) + ln(1 + {series})) as {out} from {table}_p)"""


REGION = """reg as (select *, [18, 23, 25, 36, 19, 30, 4, 29, 32, 11][((gr + gc) // 4 + 1)::int] as region0 from base),
reg2 as (select *, case when region0 in (4, 29) then 19 when region0 = 32 then 30 else region0 end as region from reg),
ovl as (select sub, label, region, count(*) / sum(count(*)) over (partition by sub, label)::double as share from reg2 where label >= 1 and region >= 1 group by 1, 2, 3),
six as (select sub, label, coalesce(max(share) filter (region = 18), 0) g0, coalesce(max(share) filter (region = 23), 0) g1, coalesce(max(share) filter (region = 25), 0) g2,
   coalesce(max(share) filter (region = 36), 0) g3, coalesce(max(share) filter (region = 19), 0) g4, coalesce(max(share) filter (region = 30), 0) g5 from ovl group by 1, 2),
six2 as (select *, nullif(greatest(g0, g1, g2, g3, g4, g5), 0) as top from six),
central as (select sub, label, coalesce(g0/top, 0) c0, case when g1 <> 0 and g2 = 0 then 1 else coalesce(g1/top, 0) end c1,
   case when g1 = 0 and g2 <> 0 then 1 else coalesce(g2/top, 0) end c2, coalesce(g3/top, 0) c3, coalesce(g4/top, 0) c4, coalesce(g5/top, 0) c5 from six2)"""
LINKS = f"""{UNFOLDED},
links as materialized (select sub, src, dst, min(w) as w from (select sub, src, dst, w from fedges union all select sub, src, dst, w from unfolded) group by 1, 2, 3),
near as (select sub, v as src, v as tgt, 0::double as d from mesh union all select sub, src, dst, w from links where w <= 15),
raww as (select n.sub, src, tgt, exp(-d*d/50) * g.area as w0 from near n join geom g on g.sub=n.sub and g.v=n.tgt join mesh m on m.sub=n.sub and m.v=n.src where m.mars = 2),
weights as (select r.sub, r.tgt, r.src, r.w0 * o.area / sum(r.w0) over (partition by r.sub, r.src) as w, t.mars as tmars
   from raww r join geom o on o.sub=r.sub and o.v=r.src join mesh t on t.sub=r.sub and t.v=r.tgt)"""


def q(*ctes: str, tail: str) -> str:
    rec = "recursive " if any("walk as" in c or "hops as" in c or "using key" in c for c in ctes) else ""
    return f"with {rec}" + ",\n".join(ctes) + "\n" + tail


ORACLES: dict[str, str] = {
    "unit_norm_vectors": f"""with emb as (select vec_id, generate_subscripts(embedding, 1) - 1 as d, unnest(embedding)::double as e from embeddings),
      c as (select vec_id, d, e - avg(e) over (partition by vec_id) as c from emb)
      select vec_id, d, {r6("c / sqrt(sum(c*c) over (partition by vec_id))")} as value from c""",
    "bold_zscore": q(SPAN, DAYS, ZS, tail=f"select run, v as user_id, t, {r6('z')} as z from zs"),
    "clean_ratios": f"select l_orderkey, l_linenumber, case when l_discount = 0 then 0 else {r6('l_tax / l_discount')} end as ratio from lineitem",
    "log_policies": f"""select l_discount, count(*) as n, case when l_discount <= 0 then 1 else 0 end as score_is_neg_inf,
      {r6("case when l_discount <= 0 then 20 * ln(2.220446049250313e-16::double) else ln(l_discount) end")} as log_cost from lineitem group by l_discount""",
    "sphere_projection": q(MESH, "s as (select sub, v, x-100 as a, y-45 as b, z+50 as c, sqrt((x-100)*(x-100)+(y-45)*(y-45)+(z+50)*(z+50)) as r from mesh)",
      tail=f"select sub, v, {r6('a/r')} as ux, {r6('b/r')} as uy, {r6('c/r')} as uz from s"),
    "renumber_labels": """with c as (select c_custkey, c_mktsegment, case when c_acctbal < 0 then 0 else c_nationkey * 3 end as gap_label from customer),
      ids as (select c_mktsegment, gap_label, row_number() over (partition by c_mktsegment order by gap_label) as label
        from (select distinct c_mktsegment, gap_label from c where gap_label > 0))
      select c.c_custkey, c.c_mktsegment, c.gap_label, coalesce(label, 0) as label from c left join ids using (c_mktsegment, gap_label)""",
    "icosphere_counts": "select c_nationkey % 7 as mesh_order, count(*) as n, (10 * 4 ** (c_nationkey % 7) + 2)::bigint as n_vertices from customer group by 1, 3",
    "top_fraction_binarize": q(MESH, EMB, THRESH, tail=f"""select emb.sub, v, {r6("any_value(threshold)")} as threshold,
      sum(case when e >= threshold then 1 else 0 end)::bigint as n_on from emb join thr using (sub) group by 1, 2"""),
    "bit_profile_pack": q(MESH, EMB, THRESH, BITS, tail="""select sub, v, 0::bigint as word_index,
      (case when sum(case when d = 63 then b else 0 end) = 1 then sum(case when d < 63 then b::hugeint << d else 0 end) - 9223372036854775808::hugeint
        else sum(case when d < 63 then b::hugeint << d else 0 end) end)::bigint as word from bits group by 1, 2"""),
    "popcount_stats": q(MESH, EMB, THRESH, BITS, tail=f"""select sub, v, ones, {r6('row_mean')} as row_mean, {r6('row_sumsq')} as row_sumsq, {r6('value_on')} as value_on,
      {r6('value_off')} as value_off, is_scaled from packed"""),
    "packed_normalize": q(MESH, EMB, THRESH, BITS, tail=f"select b.sub, b.v, d, {r6('case when b = 1 then value_on else value_off end')} as value from bits b join packed p on p.sub=b.sub and p.v=b.v"),
    "cohort_mean_profile": q(MESH, EMB, THRESH, BITS, tail=f"select v, d as pos, {r6('avg(b)')} as mean from bits group by 1, 2"),
    "merged_mean_profile": q(MESH, EMB, THRESH, BITS, tail=f"select v, d as pos, sum(b)::bigint as ones, count(*) as n, {r6('avg(b)')} as mean from bits group by 1, 2"),
    "parcel_centroids": f"""with emb as (select label, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as e from embeddings where label > 0),
      s as (select label, pos, sum(e) as s from emb group by 1, 2)
      select label, pos, {r6("s / sqrt(sum(s*s) over (partition by label))")} as mtc from s""",
    "own_parcel_cosine": f"""with emb as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as e from embeddings where label > 0),
      s as (select label, pos, sum(e) as s from emb group by 1, 2), c as (select label, pos, s / sqrt(sum(s*s) over (partition by label)) as m from s),
      o as (select vec_id, sum(e*m) as cosine from emb join c using (label, pos) group by 1) select {r6('avg(cosine)')} as rbar, count(*) as n from o""",
    "soft_assign": q(MESH, EMB, CENT, ACC, SOFT, tail=f"select sub, v, l, {r6('lam')} as lam from soft"),
    "argmax_labels": q(MESH, EMB, CENT, ACC, SOFT, tail=f"""select sub, v, l as label, {r6('lam')} as best from
      (select *, row_number() over (partition by sub, v order by lam desc, l) as rk from soft) where rk = 1"""),
    "row_softmax_masked": q(MESH, EMB, CENT, ACC, """m as (select *, exp(20*acc - max(20*acc) over (partition by sub, v)) * case when abs(l - label) <= 2 then 1 else 0 end as ex from acc)""",
      tail=f"select sub, v, l, {r6('ex / sum(ex) over (partition by sub, v)')} as lam from m"),
    "weighted_group_sum": q(MESH, EMB, CENT, ACC, SOFT, tail=f"select s.sub, s.l, d as pos, {r6('sum(lam * e)')} as xdot from soft s join emb on emb.sub=s.sub and emb.v=s.v group by 1, 2, 3"),
    "mean_resultant": q(MESH, EMB, CENT, ACC, SOFT, "xd as (select s.sub, s.l, d, sum(lam * e) as xdot from soft s join emb on emb.sub=s.sub and emb.v=s.v group by 1, 2, 3)",
      "nm as (select xd.sub, sum(xdot * m) as num from xd join cent using (sub, l, d) group by 1)", "dn as (select sub, sum(lam) as den from soft group by 1)",
      tail=f"select sub, {r6('num')} as num, {r6('den')} as den, {r6('num/den')} as rbar from nm join dn using (sub)"),
    "theta_mean": q(MESH, EMB, CENT, ACC, SOFT, tail=f"select v, l, {r6('sum(lam) / (select count(distinct sub) from mesh)')} as theta from soft group by 1, 2"),
    "theta_init": q(MESH, EMB, CENT, ACC, SOFT, tail=f"""select v, l, {r6('coalesce(sum(case when lam > 0.1 then lam else 0 end) / (select count(distinct sub) from mesh) / nullif(count(*) filter (lam > 0.1), 0), 0) + 2.220446049250313e-16')} as theta
      from soft group by 1, 2"""),
    "group_direction": q(MESH, EMB, CENT, "t as (select l, d, sum(m) as s from cent group by 1, 2)", tail=f"select l, d as pos, {r6('s / sqrt(sum(s*s) over (partition by l))')} as mu from t"),
    "subject_direction": q(MESH, EMB, CENT, "mu as (select l, d, arg_min(m, sub) as mu from cent group by 1, 2)", "r as (select c.sub, c.l, c.d, 3*c.m + 2*mu.mu as raw from cent c join mu using (l, d))",
      tail=f"select sub, l, d as pos, {r6('raw / sqrt(sum(raw*raw) over (partition by sub, l))')} as psi from r"),
    "em_cost": q(MESH, EMB, EDGES, CENT, ACC, SOFT, POTTS, tail=f"""select sub, {r6('sum(lam * (1.5 + 20*acc + ln(0.1*l) - 0.5*(case when lam <= 0 then 20*ln(2.220446049250313e-16::double) else ln(lam) end) - 0.25*v_potts + 2*(-abs(acc))))')} as cost
      from potts group by 1"""),
    "outer_cost": q(MESH, EMB, CENT, "mu as (select l, d, arg_min(m, sub) as mu from cent group by 1, 2)", "ns as (select count(distinct sub) as n from mesh)",
      "par as (select distinct l, 30+l as sigma, 40+l as eps from cent)", cdln("par", "sigma", 31.0, "l, sigma, eps", "cs"), cdln("par_c", "eps", 31.0, "l, cs", "ce"),
      "ab as (select sum((30+c.l)*c.m*c.m) + sum((40+c.l)*c.m*mu.mu) as ab from cent c join mu using (l, d))",
      tail=f"select {r6('ab + (select sum(cs) + sum(ce) from par_c_c) * (select n from ns)')} as cost from ab"),
    "mean_abs_drift": q(MESH, EMB, CENT, ACC, soft(10.0, "cool"), soft(20.0, "warm"), tail=f"select a.sub, {r6('sum(abs(a.lam - b.lam)) / 2250')} as drift from cool a join warm b using (sub, v, l) group by 1"),
    "dead_columns": q(MESH, EMB, CENT, ACC, tail="select sub, l, case when bool_and(case when l % 3 = 0 then 0 else acc end = 0) then 1 else 0 end as all_zero, 0 as any_nan from acc group by 1, 2"),
    "value_extent": f"select event_type, {r6('min(value)')} as lo, {r6('max(value)')} as hi, {r6('max(abs(value))')} as abs_hi from events group by 1",
    "converged_flags": q(MESH, EMB, CENT, "t as (select l, d, sum(m) as s from cent group by 1, 2)", "mu as (select l, d, s / sqrt(sum(s*s) over (partition by l)) as mu from t)",
      "cs as (select c.sub, c.l, sum(c.m*mu.mu) as cosine from cent c join mu using (l, d) group by 1, 2)", tail="select l, case when bool_and(1 - cosine < 0.5) then 1 else 0 end as converged from cs group by 1"),
    "connect_prior": q(MESH, EMB, CENT, ACC, SOFT, "g as (select sub, v, d, e from emb)",
      "u as (select s.sub, s.l, d, sum(lam*e)/sum(lam) as u from soft s join g on g.sub=s.sub and g.v=s.v group by 1, 2, 3)",
      tail=f"select s.sub, s.v, s.l, {r6('-sum((e-u)*(e-u))')} as scv from soft s join g on g.sub=s.sub and g.v=s.v join u on u.sub=s.sub and u.l=s.l and u.d=g.d group by 1, 2, 3"),
    "sphere_prior": q(MESH, EMB, CENT, ACC, SOFT, "sp as (select sub, v, (x-100)/r as ux, (y-45)/r as uy, (z+50)/r as uz from (select *, sqrt((x-100)*(x-100)+(y-45)*(y-45)+(z+50)*(z+50)) as r from mesh))",
      "mm as (select s.sub, s.l, sum(lam*ux) mx, sum(lam*uy) my, sum(lam*uz) mz from soft s join sp on sp.sub=s.sub and sp.v=s.v group by 1, 2)",
      "j as (select s.sub, s.v, s.l, (s.l % 3) * 1000::double as g, (ux*mx+uy*my+uz*mz)/sqrt(mx*mx+my*my+mz*mz) as cs from soft s join sp on sp.sub=s.sub and sp.v=s.v join mm on mm.sub=s.sub and mm.l=s.l)",
      tail=f"select sub, v, l, {r6('case when g <= 0 then 0 else 0.5*ln(g) - (0.5*ln(2/(pi()*g)) + g - ln(2) + ln(1 - exp(-2*g))) + g*cs end')} as sxv from j"),
    "assignment_round": q(MESH, EMB, EDGES, CENT, ACC, SOFT, POTTS,
      "sc as (select sub, v, l, 5*(case when l = 9 then 0 else acc end) + (case when l = 9 then 0 else 1.5 end) + 0.5*ln(0.1*l) - 0.5*v_potts as s from potts)",
      "ex as (select *, exp(s - max(s) over (partition by sub, v)) as ex from sc)", tail=f"select sub, v, l, {r6('case when l = 9 then 0 else ex / sum(ex) over (partition by sub, v) end')} as lam from ex"),
    "bessel_cdln": "with " + "e as (select vec_id, abs(embedding[1]::double)*500 + 1 as kappa from embeddings),\n" + cdln("e", "kappa", 31.0, "vec_id, kappa", "c64")
      + f" select vec_id, {r6('c64')} as cdln64, {r6('0.5*ln(kappa) - (0.5*ln(2/(pi()*kappa)) + kappa - ln(2) + ln(1 - exp(-2*kappa)))')} as cdln3 from e_c",
    "inv_ad_round_trip": q(MESH, EMB, CENT, "o as (select emb.sub, v, label, sum(e*m) as cosine from emb join cent on cent.sub=emb.sub and cent.l=emb.label and cent.d=emb.d where label > 0 group by 1, 2, 3)",
      tail=f"select sub, label, {r6('avg(cosine)')} as rbar, {r6('avg(cosine)')} as back from o group by 1, 2"),
    "run_mean_correlation": q(SPAN, DAYS, ZS, CORR, tail=f"select v as user_id, seed, {r6('avg(c)')} as corr from corr group by 1, 2"),
    "run_correlation_profile": q(SPAN, DAYS, ZS, CORR, "rk as (select *, row_number() over (partition by run order by c desc) as k, count(*) over (partition by run) as n from corr)",
      "th as (select run, c as threshold from rk where k = greatest(1, least(n, floor(n*0.1+0.5))))",
      tail=f"select corr.run, v as user_id, {r6('any_value(threshold)')} as threshold, sum(case when c >= threshold then 1 else 0 end)::bigint as n_on from corr join th using (run) group by 1, 2"),
    "session_mean_correlation": q(SPAN, DAYS, ZS, CORR,
      "ids as (select run, seed, row_number() over (partition by run order by seed) as pos from (select distinct run, seed from corr))",
      "mm as (select case when run in ('view', 'click') then 'browse' else 'act' end as pair, v, pos, avg(c) as m from corr join ids using (run, seed) group by 1, 2, 3)",
      tail=f"select pair, v as user_id, {r6('sum(m)')} as total from mm group by 1, 2"),
    "fc_similarity": q(SPAN, DAYS, ZS, "verts as (select distinct run, v // 250 as sub, v from series)", "nn as (select run, sub, count(*) as n from verts group by 1, 2)",
      "ref as (select run, v from (select verts.*, row_number() over (partition by verts.run, verts.sub order by md5('1:' || v), v) as k, n from verts join nn using (run, sub)) where k <= round_even(n/5.0::double, 0))",
      "col as (select run, v from (select verts.*, row_number() over (partition by verts.run, verts.sub order by md5('2:' || v), v) as k, n from verts join nn using (run, sub)) where k <= round_even(n/10.0::double, 0))",
      "fc as (select a.run, a.v, b.v as r, sum(a.z*b.z) as c from zs a join zs b on a.run=b.run and a.t=b.t and a.v//250=b.v//250 join ref on ref.run=b.run and ref.v=b.v group by 1, 2, 3)",
      "fcc as (select run, v, r, c - avg(c) over (partition by run, v) as c from fc)",
      "fz as (select run, v, r, case when sqrt(sum(c*c) over (partition by run, v)) = 0 then 0 else c/sqrt(sum(c*c) over (partition by run, v)) end as z from fcc)",
      tail=f"select a.run, a.v as user_id, b.v as other, {r6('sum(a.z*b.z)')} as similarity from fz a join fz b on a.run=b.run and a.r=b.r and a.v//250=b.v//250 join col on col.run=b.run and col.v=b.v group by 1, 2, 3"),
    "censored_series": q(SPAN, DAYS, "cnt as (select event_type as run, ts::date - (select d0 from span) as t, count(*) as n from events group by 1, 2)",
      "av as (select run, sum(n) / (select n from n_days)::double as a from cnt group by 1)", "keep as (select run, t from cnt join av using (run) where n >= a)",
      tail=f"select s.run, s.v as user_id, count(k.t) as n_kept, {r6('coalesce(sum(case when k.t is not null then s.x end), 0)')} as kept_sum from series s left join keep k on k.run=s.run and k.t=s.t group by 1, 2"),
    "concat_hemispheres": q(MESH, EMB, tail=f"select sub, case when v < 125 then 'lh' else 'rh' end as hemi, v, {r6('sum(e)')} as total from emb where label <> 0 group by 1, 2, 3"),
    "wall_zeroing": q(MESH, EMB, tail=f"select sub, v, case when any_value(mars) = 1 then 0 else 1 end as keep, {r6('sum(case when mars = 1 then 0 else e end)')} as total from emb group by 1, 2"),
    "wall_words_check": q(MESH, EMB, THRESH, BITS, tail="select sub, v, ones from ones"),
    "seed_selection": q(MESH, tail="select sub, v from mesh where v < 42 and mars = 2"),
    "two_sided_seeds": q(MESH, BRAINS, tail="select sub, hemi, v from brain where v % 250 < 42 and mars = 2"),
    "two_sided_profile": q(MESH, BRAINS, "be as (select sub, v, hemi, mars, unnest(embedding)::double as e, unnest(range(64)) as d from brain)",
      "ms as (select sub, v, avg(e) as m, sqrt(sum((e - a) * (e - a))) as s from (select *, avg(e) over (partition by sub, v) as a from be) group by 1, 2)",
      "z as (select be.sub, be.v, be.mars, d, case when s > 0 then (e - m) / s else 0 end as z from be join ms using (sub, v))",
      "c as (select a.sub, a.v, a.mars, b.v as seed, sum(a.z * b.z) as corr from z a join z b on a.sub = b.sub and a.d = b.d where b.v % 250 < 42 and b.mars = 2 group by 1, 2, 3, 4)",
      "k as (select sub, greatest(1, least(count(*), floor(count(*) * 0.1 + 0.5))) as k from c group by 1)",
      "t as (select sub, min(corr) as t from (select sub, corr, row_number() over (partition by sub order by corr desc) as r from c) join k using (sub) where r <= k group by 1)",
      tail="select c.sub, c.v, CAST(count(*) filter (where mars <> 1 and corr >= t) AS BIGINT) as n_on from c join t using (sub) group by 1, 2"),
    "cross_hemisphere_cells": q(MESH, BRAINS, "cl as (select sub, v, case when hemi = 'rh' then label + 9 else label end as l from brain where label > 0)",
      tail="select distinct b.sub, b.v, b.hemi, CAST(cl.l AS BIGINT) as l from cl join brain b on b.sub = cl.sub and b.v - cl.v in (-250, -1, 0, 1, 250) where (b.hemi = 'lh') = (cl.l <= 9)"),
    "neighbour_filter": q(MESH, EDGES, "ids as (select sub, v, row_number() over (partition by sub order by v) - 1 as id from mesh where mars = 2)",
      tail="select e.sub, a.id as new_src, b.id as new_dst from edges e join ids a on a.sub=e.sub and a.v=e.src join ids b on b.sub=e.sub and b.v=e.dst"),
    "active_edges": q(MESH, EDGES, tail="select e.sub, src, dst from edges e join mesh a on a.sub=e.sub and a.v=src join mesh b on b.sub=e.sub and b.v=dst where a.label % 4 <> 0 and b.label % 4 <> 0"),
    "candidate_cells": q(MESH, EDGES, PRIOR, tail=f"select v, l, {r6('theta')} as theta from theta join mask using (v, l)"),
    "scatter_cells": q(MESH, EDGES, PRIOR, tail=f"select v, l, {r6('coalesce(theta, 0)')} as theta from mask left join theta using (v, l)"),
    "boundary_mask": q(MESH, EDGES, PRIOR, tail="select case when v < 125 then 'lh' else 'rh' end as hemi, v, (l + case when v < 125 then 0 else 9 end)::bigint as l from mask"),
    "random_subset": q(MESH, tail="""select sub, v, draw from (select sub, v, row_number() over (partition by sub order by md5('7:' || v), v) as draw, count(*) over (partition by sub) as n from mesh)
      where draw <= round_even(n/12.0::double, 0)"""),
    "edge_table": q(MESH, EDGES, tail=f"select sub, src, dst, {r6('w')} as w from edges"),
    "face_edges": q(MESH, FACES, FACE_EDGES, tail=f"select sub, src, dst, {r6('w')} as w from fedges"),
    "vertex_face_counts": q(MESH, FACES, tail="select sub, v, count(*) as n, min(f) as first_face from (select sub, f, unnest([v0, v1, v2]) as v from faces) group by 1, 2"),
    "vertex_geometry": q(MESH, FACES, GEOMETRY, tail=f"select sub, v, {r6('nx')} as nx, {r6('ny')} as ny, {r6('nz')} as nz, {r6('area')} as area from geom"),
    "unfolded_edges": q(MESH, FACES, UNFOLDED, tail=f"select sub, src, dst, {r6('w')} as w from unfolded"),
    "khop_neighbours": q(MESH, EDGES, "hops as (select sub, src, dst, 1 as h from edges union select h.sub, h.src, e.dst, h.h + 1 from hops h join edges e on e.sub=h.sub and e.src=h.dst where h.h < 3)",
      tail="select distinct sub, src, dst from hops where src <> dst"),
    "padded_neighbours": q(MESH, tail="""select sub, src, dst from (select sub, v as src, unnest([case when gc < 24 then v + 1 end, case when gc > 0 then v - 1 end, case when gr > 0 then v - 25 end]) as dst from mesh) where dst is not null"""),
    "local_minima": q(MESH, EDGES, "two as (select a.sub, a.src, b.dst from edges a join edges b on a.sub=b.sub and a.dst=b.src union select sub, src, dst from edges)",
      "low as (select t.sub, t.src as v, bool_and(m.z < n.z) as ok from two t join mesh m on m.sub=t.sub and m.v=t.src join mesh n on n.sub=t.sub and n.v=t.dst where t.src <> t.dst group by 1, 2)",
      tail="select m.sub, m.v, case when coalesce(ok, true) then 1 else 0 end as is_min from mesh m left join low using (sub, v)"),
    "potts_term": q(MESH, EMB, EDGES, CENT, ACC, SOFT, POTTS, tail=f"select sub, v, l, {r6('v_potts')} as v_potts from potts"),
    "components": q(MESH, EDGES, PIECES, COMPONENTS, tail="select sub, v, label, comp from comp"),
    "component_counts": q(MESH, EDGES, PIECES, COMPONENTS, tail="select sub, label, count(distinct comp) as n_comp from comp group by 1, 2"),
    "component_sizes": q(MESH, EDGES, PIECES, COMPONENTS, tail="select sub, label, comp, count(*) as size from comp group by 1, 2, 3"),
    "boundary_vertices": q(MESH, EDGES, PIECES, "f as (select sub, v, case when label = 0 then 7 else label end as label from p)",
      "dd as (select e.sub, e.src as v, sum(b.label - a.label) as s from edges e join f a on a.sub=e.sub and a.v=e.src join f b on b.sub=e.sub and b.v=e.dst group by 1, 2)",
      tail="select p.sub, p.v, p.label from p join dd using (sub, v) where s <> 0"),
    "remove_isolated": q(MESH, EDGES, PIECES, COMPONENTS, "small as (select sub, comp, label from comp group by 1, 2, 3 having count(*) < 3)",
      "vote as (select c.sub, c.comp, b.label as vote, count(*) as n from comp c join small s on s.sub=c.sub and s.comp=c.comp join edges e on e.sub=c.sub and e.src=c.v join p b on b.sub=e.sub and b.v=e.dst where b.label <> 0 and b.label <> c.label group by 1, 2, 3)",
      "win as (select sub, comp, vote from (select *, row_number() over (partition by sub, comp order by n desc, vote) as k from vote) where k = 1)",
      tail="select p.sub, p.v, coalesce(w.vote, p.label) as label from p left join comp c on c.sub=p.sub and c.v=p.v left join win w on w.sub=c.sub and w.comp=c.comp"),
    "bounded_reach": q(MESH, EDGES, "hops as (select sub, label as l, v, 0::double as d from mesh where label > 0 union select h.sub, h.l, e.dst, h.d + e.w from hops h join edges e on e.sub=h.sub and e.src=h.v where h.d + e.w <= 30)",
      tail=f"select sub, l, v, {r6('min(d)')} as d from hops group by 1, 2, 3"),
    "radius_mask": q(MESH, EDGES, "rim as (select distinct e.sub, a.label as l, e.src as v from edges e join mesh a on a.sub=e.sub and a.v=e.src join mesh b on b.sub=e.sub and b.v=e.dst where a.label > 0 and a.label <> b.label)",
      "hops as (select sub, l, v, 0::double as d from rim union select h.sub, h.l, e.dst, h.d + e.w from hops h join edges e on e.sub=h.sub and e.src=h.v where h.d + e.w <= 30)",
      tail="select distinct sub, v, l from hops union select sub, v, label from mesh where label > 0"),
    "smoothing_weights": q(MESH, FACES, FACE_EDGES, GEOMETRY, LINKS, tail=f"select sub, tgt, src, {r6('w')} as w from weights where tmars = 2"),
    "gauss_smooth": q(MESH, FACES, FACE_EDGES, GEOMETRY, LINKS, EMB, "sm as (select w.sub, w.tgt as v, m.d, sum(w.w * m.e)/sum(w.w) as s from weights w join emb m on m.sub=w.sub and m.v=w.src where tmars = 2 group by 1, 2, 3)",
      tail=f"select m.sub, m.v, CAST(m.d AS INTEGER) as k, {r6('coalesce(s, 0)')} as value from emb m left join sm using (sub, v, d)"),
    "surface_gradient": q(MESH, FACES, FACE_EDGES, GEOMETRY, EMB,
      "here as materialized (select m.sub, m.v, x, y, z, nx, ny, nz, area from mesh m join geom g on g.sub=m.sub and g.v=m.v where mars = 2)",
      "e0 as materialized (select s.*, o.x-s.x ox, o.y-s.y oy, o.z-s.z oz, o.area wt, o.v as dst, case when abs(s.nx) > abs(s.ny) then 0 else 1 end sx, case when abs(s.nx) > abs(s.ny) then 1 else 0 end sy from fedges f join here s on s.sub=f.sub and s.v=f.src join here o on o.sub=f.sub and o.v=f.dst)",
      "e1 as (select *, -nz*sy hx, nz*sx hy, nx*sy-ny*sx hz, sqrt(ox*ox+oy*oy+oz*oz) mag, ox*nx+oy*ny+oz*nz rise from e0)",
      "e2 as (select * replace (hx/hl as hx, hy/hl as hy, hz/hl as hz) from (select *, sqrt(hx*hx+hy*hy+hz*hz) hl from e1))",
      "e3 as (select *, ny*hz-nz*hy kx, nz*hx-nx*hz ky, nx*hy-ny*hx kz, case when abs(rise) > 0.035*mag then mag*asin(least(1, greatest(-1, rise/mag)))*mag/rise else mag end as unr from e2)",
      "e4 as (select *, ox*hx+oy*hy+oz*hz p0, ox*kx+oy*ky+oz*kz q0 from e3)",
      "e5 as (select *, p0*unr/sqrt(p0*p0+q0*q0) p, q0*unr/sqrt(p0*p0+q0*q0) q from e4)",
      "g as (select sub, v, sum(p*p*wt) a00, sum(p*q*wt) a01, sum(p*wt) a02, sum(q*q*wt) a11, sum(q*wt) a12, sum(wt)+any_value(area) a22, any_value(hx) hx, any_value(hy) hy, any_value(hz) hz, any_value(kx) kx, any_value(ky) ky, any_value(kz) kz from e5 group by 1, 2 having count(*) >= 2)",
      "h as (select e5.sub, e5.v, a.d, sum(p*wt*(b.e-a.e)) b0, sum(q*wt*(b.e-a.e)) b1, sum(wt*(b.e-a.e)) b2 from e5 join emb a on a.sub=e5.sub and a.v=e5.v join emb b on b.sub=e5.sub and b.v=e5.dst and b.d=a.d group by 1, 2, 3)",
      "s as (select *, a00*(a11*a22-a12*a12)-a01*(a01*a22-a12*a02)+a02*(a01*a12-a11*a02) as det, b0*(a11*a22-a12*a12)-a01*(b1*a22-a12*b2)+a02*(b1*a12-a11*b2) as na, a00*(b1*a22-a12*b2)-b0*(a01*a22-a12*a02)+a02*(a01*b2-b1*a02) as nb from g join h using (sub, v))",
      "r as (select sub, v, d, sqrt((hx*na/det+kx*nb/det)**2+(hy*na/det+ky*nb/det)**2+(hz*na/det+kz*nb/det)**2) as gr from s)",
      tail=f"select m.sub, m.v, CAST(m.d AS INTEGER) as k, {r6('coalesce(r.gr, 0)')} as gradient from emb m left join r using (sub, v, d)"),
    "edge_density": q(MESH, tail=f"select v, count(*) filter (label = 0) as n_edge, count(*) as n_samples, {r6('count(*) filter (label = 0) / count(*)::double')} as density from mesh group by 1"),
    "conditional_mean": f"""select user_id, event_type, count(*) filter (value - 5.0::double > 1e-10) as n_positive,
      {r6("case when count(*) filter (value - 5.0::double > 1e-10) = 0 then 0 else sum(value - 5.0::double) / count(*) filter (value - 5.0::double > 1e-10) end")} as mean from events group by 1, 2""",
    "mode_smallest": """select l_suppkey, qty as mode, n from (select *, row_number() over (partition by l_suppkey order by n desc, qty) as k from
      (select l_suppkey, l_quantity::int as qty, count(*) as n from lineitem group by 1, 2)) where k = 1""",
    "label_overlap": f"select quality, lang, count(*) as n, {r6('count(*) / (sum(count(*)) over (partition by quality))::double')} as share from documents join labels using (doc_id) group by 1, 2",
    "region_profile": q(MESH, "base as (select * from mesh)", REGION, tail=f"""select sub, label, t.pos, {r6('t.share')} as share from central,
      lateral (select unnest([{{'pos': 0, 'share': c0}}, {{'pos': 1, 'share': c1}}, {{'pos': 2, 'share': c2}}, {{'pos': 3, 'share': c3}}, {{'pos': 4, 'share': c4}}, {{'pos': 5, 'share': c5}}]) as t)"""),
    "truncate_mask": q(MESH, EDGES, "base as (select * replace (case when label = 0 then 0 else ((gr + gc)//4 + 1)::int end as label) from mesh)", REGION,
      "dist as (select sub, label, avg(x) as pre, 90.0::double as post from base where label > 0 group by 1, 2)",
      "cd as (select c.*, coalesce(pre - post < 0, false) as np from central c left join dist using (sub, label))",
      """gone as (select sub, label as l, unnest([
         case when (c1 >= .999 and false) then 18 end,
         case when ((c0 >= .999 or c3 >= .999) and np) or (c2 >= .999 and c1 < .999) or c4 >= .999 then 23 end,
         case when ((c0 >= .999 or c3 >= .999) and not np) or (c1 >= .999 and c2 < .999) or c5 >= .999 then 25 end,
         case when (c0 >= .999 and c3 <= .2) then 36 end,
         case when c1 >= .999 and c4 < .999 then 19 end,
         case when c2 >= .999 and c5 < .999 then 30 end,
         case when c3 >= .999 and c0 <= .2 then 18 end]) as region from cd)""",
      "msk as (select sub, v, label as l from base where label > 0 union select e.sub, e.src, b.label from edges e join base b on b.sub=e.sub and b.v=e.dst where b.label > 0)",
      tail="""select m.sub, m.v, m.l from msk m join reg2 r on r.sub=m.sub and r.v=m.v
        where not exists (select 1 from gone g where g.sub=m.sub and g.l=m.l and g.region=r.region)"""),
    "cohort_merge": """with old as (select c_custkey as id, c_nationkey as run_id, case when c_acctbal > 0 then 'old-p' || c_custkey end as profile, case when c_acctbal > 3000 then 'old-g' || c_custkey end as gradient from customer where c_custkey % 5 <> 0),
      new as (select c_custkey as id, case when c_mktsegment = 'BUILDING' then -1 else c_nationkey end as run_id, case when c_acctbal > 6000 then 'new-p' || c_custkey end as profile, case when c_acctbal < 1000 then 'new-g' || c_custkey end as gradient from customer where c_custkey % 7 <> 0)
      select new.id, new.run_id, coalesce(new.profile, old.profile) as profile, coalesce(new.gradient, old.gradient) as gradient from new left join old using (id, run_id)""",
    "cohort_run_id": """select l_orderkey, sha256('{"n_grad_components":100,"seed":"seed","sessions":["' || string_agg(distinct l_linenumber::varchar, '","' order by l_linenumber::varchar) ||
      '"],"subjects":["' || string_agg(distinct l_suppkey::varchar, '","' order by l_suppkey::varchar) || '"],"targ":"target"}') as run_id from lineitem group by 1""",
    "manifest_explode": "select conv_id as sub, turn as sess, trim(role) as lh, length(text)::varchar as rh from conversations",
    "manifest_checks": """select conv_id as sub, turn + 1 as sess, case when max(turn + 1) over (partition by conv_id) <> count(*) over (partition by conv_id) then 1 else 0 end as gap,
      0 as bad_lh, 1 as bad_rh from conversations""",
    "cost_lag": f"""with e as (select event_type, day(ts)::int as iteration, sum(value) as cost from events group by 1, 2),
      p as (select *, coalesce(lag(cost) over (partition by event_type order by iteration), 0) as previous from e)
      select event_type, iteration, {r6('cost')} as cost, {r6('previous')} as previous, {r6('case when previous = 0 then -1 else abs((cost - previous)/previous) end')} as ratio,
        case when previous <> 0 and abs((cost - previous)/previous) <= 0.05 then 1 else 0 end as converged from p""",
    "artifact_names": """select s_suppkey, 'Ind_parcellation_sub' || s_suppkey || '_w' || (case when s_nationkey % 2 = 0 then (s_nationkey // 2)::varchar else (s_nationkey // 2)::varchar || '.5' end)
      || '_MRF10_beta' || s_nationkey as name from supplier""",
    "component_distance": q(MESH, EDGES, PIECES, COMPONENTS, "nc as (select sub, label, count(distinct comp) as n_comp from comp group by 1, 2)",
      "z as (select p.*, case when n_comp > 1 then p.label else 0 end as kept, case when n_comp > 1 then p.label else 7 end as fake from p left join nc on nc.sub=p.sub and nc.label=p.label)",
      "rim as (select e.sub, e.src as v from edges e join z a on a.sub=e.sub and a.v=e.src join z b on b.sub=e.sub and b.v=e.dst group by 1, 2 having sum(b.fake - a.fake) <> 0)",
      "pts as (select z.sub, z.kept as label, z.v, c.comp, z.x, z.y, z.z from z join rim using (sub, v) join comp c on c.sub=z.sub and c.v=z.v where kept <> 0)",
      "gap as (select a.sub, a.label, a.comp, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) as d from pts a join pts b on a.sub=b.sub and a.label=b.label and a.comp<>b.comp group by 1, 2, 3)",
      "far as (select sub, label, max(d) as d from gap group by 1, 2)", tail=f"select nc.sub, nc.label, nc.n_comp, {r6('coalesce(d, 0)')} as distance from nc left join far using (sub, label)"),
}


def shortest(seeds: str, links: str) -> str:
    """Keyed recursion keeping the best distance per source and vertex."""
    return f"""paths(sub, src, v, d) using key (sub, src, v) as ({seeds}
  union
  select h.sub, h.src, p.dst, min(h.d + p.w) from paths h join {links} p on p.sub=h.sub and p.src=h.v
    left join recurring.paths r on r.sub=h.sub and r.src=h.src and r.v=p.dst
  where h.d + p.w < coalesce(r.d, 1e300::double) group by 1, 2, 3)"""


ORACLES["geodesic_distance"] = q(
    MESH, EDGES,
    "price as materialized (select e.sub, e.src, e.dst, (abs(a.z) + 0.1::double + abs(b.z) + 0.1::double)/2 as w from edges e join mesh a on a.sub=e.sub and a.v=e.src join mesh b on b.sub=e.sub and b.v=e.dst)",
    shortest("select sub, v, v, 0::double from mesh", "price"),
    tail=f"select sub, src, v as pos, {r6('d / max(d) over (partition by sub)')} as distance from paths",
)
ORACLES["central_distance"] = q(
    MESH, EDGES, shortest("select sub, v, v, 0::double from mesh where label in (1, 2)", "edges"),
    tail=f"""select p.sub, t.label, case when s.label = 1 then 'pre' else 'post' end as side, {r6('avg(d)')} as mean_distance
      from paths p join mesh s on s.sub=p.sub and s.v=p.src join mesh t on t.sub=p.sub and t.v=p.v where t.label > 0 group by 1, 2, 3""",
)
_cd = ORACLES["component_distance"]
ORACLES["connectedness"] = _cd.replace(
    f"select nc.sub, nc.label, nc.n_comp, {r6('coalesce(d, 0)')} as distance",
    f"select nc.sub, nc.label, case when coalesce(d, 0) > 15 or nc.n_comp > 12 then 1000::double else 0::double end as gamma, nc.n_comp, {r6('coalesce(d, 0)')} as distance",
)
