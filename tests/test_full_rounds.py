"""Whole runs of the parcellation, all loops to their end, against dense NumPy."""

from itertools import product

import numpy as np
import pytest

from surfparc.functions.special import cdln, initial_concentration, inv_ad
from surfparc.functions.vectors import LOG_FLOOR
from surfparc.operators import subject
from surfparc.plans import parcellation

ROWS, COLS, L, D, T, S = 6, 9, 4, 64, 2, 2
N, DIM = ROWS * COLS, D - 1


def world(seed=5):
    """Parcel 1 holds two far corners, so that variants that forbid scattered parcels have to act."""
    rng = np.random.default_rng(seed)
    r, c = np.divmod(np.arange(N), COLS)
    own = np.where(c < 3, 1, np.where(c < 6, np.where(r < 3, 2, 3), np.where(r < 3, 4, 1)))
    mu = rng.normal(size=(L + 1, D))
    mu /= np.linalg.norm(mu, axis=1, keepdims=True)
    x = mu[own][None, None] * 1.6 + rng.normal(size=(S, T, N, D)) * 0.5
    x -= x.mean(-1, keepdims=True)
    x /= np.linalg.norm(x, axis=-1, keepdims=True)
    x[:, :, 4] = 0
    theta = rng.uniform(0.02, 0.15, size=(N, L + 1))
    theta[np.arange(N), own] = 0.6
    theta[rng.random(theta.shape) < 0.15] = 0
    theta[:, 0] = 0
    theta[4] = theta[40] = 0
    xyz = np.stack([c * 10.0 + 40, r * 10.0, np.full(N, 35.0)], 1)
    near = [[] for _ in range(N)]
    for v in range(N):
        for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            if 0 <= r[v] + dr < ROWS and 0 <= c[v] + dc < COLS:
                near[v].append(int((r[v] + dr) * COLS + c[v] + dc))
    grad = rng.normal(size=(S, N, 6)) * 0.2 + mu[own][None, :, :6]
    return mu, x, theta, xyz, near, grad


def parts(labels, near):
    """Pieces of equal labels by flooding: (label, sorted vertices)."""
    seen, out = set(), []
    for v in range(len(labels)):
        if labels[v] and v not in seen:
            piece, todo = set(), [v]
            while todo:
                u = todo.pop()
                if u not in piece:
                    piece.add(u)
                    todo += [k for k in near[u] if labels[k] == labels[v]]
            seen |= piece
            out.append((int(labels[v]), sorted(piece)))
    return out


def cleaned(labels, near, smallest):
    out = labels.copy()
    for name, piece in parts(labels, near):
        votes = [int(labels[k]) for v in piece for k in near[v] if labels[k] not in (0, name)]
        if len(piece) < smallest and votes:
            out[piece] = min(set(votes), key=lambda a: (-votes.count(a), a))
    return out


def scattered(labels, near, xyz, far, most):
    bad, found = set(), parts(labels, near)
    for name in {n for n, _ in found}:
        mine = [p for n, p in found if n == name]
        gap = 0.0
        if len(mine) > 1:
            fake = lambda v: labels[v] if len([1 for n, _ in found if n == labels[v]]) > 1 else 2 * L + 1
            rim = [[v for v in p if sum(fake(k) - fake(v) for k in near[v]) != 0] for p in mine]
            for a in range(len(mine)):
                ds = [np.linalg.norm(xyz[v] - xyz[u]) for b in range(len(mine)) if b != a for v in rim[a] for u in rim[b]]
                gap = max(gap, min(ds, default=0.0))
        if gap > far or len(mine) > most:
            bad.add(name)
    return bad


def dense(variant, s, mu, x, theta, xyz, near, grad):
    """One subject. Arrays over all vertices and parcels; returns labels, posterior, costs and what happened."""
    v = parcellation.VARIANTS[variant]
    live = theta.sum(1) > 0
    near = [[k for k in near[a] if live[k]] if live[a] else [] for a in range(N)]
    far = v.connect_distance if s.connect_distance is None else s.connect_distance
    beta, mask = s.beta * v.beta_scale, theta > 0
    unit = xyz / np.linalg.norm(xyz, axis=1, keepdims=True)
    sigma, log = 60.0, lambda a: np.where(a > 0, np.log(np.where(a > 0, a, 1)), LOG_FLOOR)
    lam, sxv, gamma, psi = theta.copy(), np.zeros_like(theta), np.zeros(L + 1), mu.copy()
    costs, seen = [], {"em": 0, "pieces": 0, "lambda": 0}
    used = mask.any(0)

    def argmax():
        return np.where(lam.sum(1) != 0, lam.argmax(1), 0)

    def sphere():
        mean = np.einsum("vl,vc->lc", lam, unit)
        with np.errstate(all="ignore"):
            out = cdln(gamma, 3)[None] + gamma[None] * (unit @ mean.T) / np.linalg.norm(mean, axis=1)[None]
        return np.where(np.isnan(out), 0, out)

    for _ in range(s.max_intra):
        nu, kappa, before = np.stack([mu] * T), initial_concentration(DIM), 0.0
        for em_round in range(1, s.max_em + 2):
            seen["em"] += 1
            xdot, mass = np.einsum("vl,tvd->tld", lam, x), T * lam.sum()
            done, i = np.zeros(T, bool), 0
            while True:
                i += 1
                k = float(inv_ad(DIM, (nu * xdot)[:, used].sum() / mass)[0])
                new = k * xdot + sigma * psi[None]
                new /= np.linalg.norm(new, axis=-1, keepdims=True)
                done |= (1 - (new * nu).sum(-1) < s.epsilon)[:, used].all(1)
                drift, kappa, nu = abs(kappa - k) / kappa, k, new
                if (done.all() and drift < s.epsilon) or i > s.max_m:
                    break
            acc = np.einsum("tvd,tld->vl", x, nu)
            dead = (np.where(mask, acc, 0) == 0).all(0)
            with np.errstate(divide="ignore"):
                base = kappa * acc + np.where(dead, 0, T * cdln(kappa, DIM)[0])[None] + s.w * np.log(theta)
            scv = np.zeros_like(theta)
            if v.gradient_prior:
                u = np.einsum("vl,vd->ld", lam, grad) / lam.sum(0)[:, None] if lam.sum(0)[1:].all() else None
                scv = -((grad[:, None] - u[None]) ** 2).sum(-1)
            elif v.sphere_prior:
                sxv = sphere()
            checks = v.check_pieces and em_round >= v.first_check
            for _ in range(s.max_pieces_rounds if checks else 1):
                score0 = base + (beta * scv + sxv if v.gradient_prior else beta * sxv if v.sphere_prior else 0)
                last = 0.0
                for i in range(1, s.max_lambda + 2):
                    seen["lambda"] += 1
                    pot = np.zeros_like(lam)
                    for a in range(N):
                        for b in near[a]:
                            pot[a] += lam[b].sum() - lam[b]
                    score = np.where(mask, score0 - 2 * s.c * pot, -np.inf)
                    top = np.where(live, score.max(1), 0)[:, None]
                    e = np.exp(score - top)
                    new = np.where(dead[None], 0, np.divide(e, e.sum(1, keepdims=True), out=np.zeros_like(e), where=live[:, None]))
                    drift = np.abs(new - lam).sum() / (N * L)
                    stop, last, lam = abs(drift - last) <= s.epsilon, drift, new
                    if stop:
                        break
                if not checks:
                    break
                lab = argmax()
                if v.clean_before_check:
                    lab = cleaned(lab, near, s.isolated_below)
                bad = scattered(lab, near, xyz, far, v.max_pieces)
                seen["pieces"] += bool(bad)
                gamma[list(bad)] += 1000.0
                sxv = sphere()
                if not bad:
                    break
            body = T * cdln(kappa, DIM)[0] + kappa * acc + log(theta) - s.w * log(lam) - s.c * pot + (beta * scv if v.cost_uses_prior else 0)
            cost = float((lam * body)[mask].sum())
            if before != 0 and abs((cost - before) / before) <= 1e-4:
                break
            before = cost
        total = nu.sum(0)
        psi = sigma * total + 60.0 * mu
        psi /= np.linalg.norm(psi, axis=1, keepdims=True)
        outer = before + sum(sigma * psi[k] @ total[k] + T * cdln(sigma, DIM)[0] + 60.0 * mu[k] @ psi[k] + cdln(60.0, DIM)[0] for k in range(1, L + 1))
        costs.append(float(outer))
        if len(costs) > 1 and abs((costs[-1] - costs[-2]) / costs[-2]) <= 1e-4:
            break
    return argmax(), lam, costs, seen


@pytest.mark.parametrize("variant", ["distributed", "gradient", "contiguous"])
def test_whole_run_matches_dense_numpy(spark, variant):
    mu, x, theta, xyz, near, grad = world()
    prof = spark.createDataFrame([(q, t, v, x[q, t, v].tolist()) for q in range(S) for t in range(T) for v in range(N)], "sub long, t int, v long, x array<double>")
    vert = spark.createDataFrame([(q, v, *xyz[v].tolist()) for q in range(S) for v in range(N)], "sub long, v long, x double, y double, z double")
    edges = spark.createDataFrame([(q, v, k) for q in range(S) for v in range(N) for k in near[v]], "sub long, src long, dst long")
    th = spark.createDataFrame([(v, k, float(theta[v, k])) for v in range(N) for k in range(L + 1) if theta[v, k] > 0], "v long, l int, theta double")
    par = spark.createDataFrame([(k, mu[k].tolist(), 60.0, 60.0) for k in range(1, L + 1)], "l int, mu array<double>, sigma double, eps double")
    g = spark.createDataFrame([(q, v, grad[q, v].tolist()) for q in range(S) for v in range(N)], "sub long, v long, grad array<double>")
    s = parcellation.Settings(sessions=T, n_labels=L, n_vertices=N, w=1.0, c=0.3, beta=0.002)
    got = parcellation.parcellate(prof, th, par, vert, edges, variant, s, DIM, g)
    lam = np.zeros((S, N, L + 1))
    for r in got["cells"].collect():
        lam[r["sub"], r.v, r.l] = r.lam
    labels = {(r["sub"], r.v): r.label for r in got["labels"].collect()}
    costs = {}
    for r in sorted(got["cost"].collect(), key=lambda r: r.round):
        costs.setdefault(r["sub"], []).append(r.cost)
    acted = 0
    for q in range(S):
        lab, want, history, seen = dense(variant, s, mu, x[q], theta, xyz, near, grad[q])
        acted += seen["pieces"]
        assert seen["em"] > 1 and seen["lambda"] > seen["em"]
        np.testing.assert_allclose(costs[q], history, rtol=1e-9)
        np.testing.assert_allclose(lam[q], want, atol=1e-7)
        if variant == "contiguous":
            lab = cleaned(lab, near, s.isolated_below)
        assert [labels[q, v] for v in range(N)] == lab.tolist()
    # The piece check has flagged a parcel at least once and fed back into the next rounds.
    assert (acted > 0) == (variant != "distributed")


def test_piece_rules_on_random_labels():
    rng = np.random.default_rng(1)
    _, _, _, xyz, near, _ = world()
    src, dst = (np.array(a) for a in zip(*[(v, k) for v in range(N) for k in near[v]], strict=True))
    mesh = subject.Mesh(np.arange(N), xyz, src, dst, np.zeros((N, 1)))
    for _, far, most, few in product(range(40), (5.0, 25.0), (1, 3), (None, 4)):
        labels = rng.integers(0, L + 1, N) if rng.random() < 0.3 else np.repeat(rng.integers(0, L + 1, N // 3), 3)
        want = scattered(labels if few is None else cleaned(labels, near, few), near, xyz, far, most)
        assert subject.scattered(mesh, labels, L, far, most, few) == want


def test_large_gaps_by_blocks():
    rng = np.random.default_rng(2)
    points, piece = rng.normal(size=(60, 3)), rng.integers(0, 4, 60)
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    want = max(d[np.ix_(piece == k, piece != k)].min() for k in range(4))
    assert subject.largest_gap(points, piece, block=7) == pytest.approx(want)
    assert subject.largest_gap(points, np.zeros(60, int)) == 0.0


def small_world(spark, short=None):
    """Three subjects, the last of them with only ``short`` vertices in its profile, as ``parcellate`` takes them."""
    mu, x, theta, xyz, near, grad = world()
    of = lambda q: N if short is None or q < S else short
    prof = spark.createDataFrame([(q, t, v, x[q % S, t, v].tolist()) for q in range(S + 1) for t in range(T) for v in range(of(q))], "sub long, t int, v long, x array<double>")
    vert = spark.createDataFrame([(q, v, *xyz[v].tolist()) for q in range(S + 1) for v in range(N)], "sub long, v long, x double, y double, z double")
    edges = spark.createDataFrame([(q, v, k) for q in range(S + 1) for v in range(N) for k in near[v]], "sub long, src long, dst long")
    th = spark.createDataFrame([(v, k, float(theta[v, k])) for v in range(N) for k in range(L + 1) if theta[v, k] > 0], "v long, l int, theta double")
    par = spark.createDataFrame([(k, mu[k].tolist(), 60.0, 60.0) for k in range(1, L + 1)], "l int, mu array<double>, sigma double, eps double")
    s = parcellation.Settings(sessions=T, n_labels=L, n_vertices=N, w=1.0, c=0.3, beta=0.002)
    return prof, th, par, vert, edges, "distributed", s, DIM


def test_subjects_of_one_block_take_no_spark_rounds(spark, monkeypatch):
    monkeypatch.delattr(parcellation, "em_rounds")
    assert parcellation.parcellate(*small_world(spark))["labels"].count() == (S + 1) * N


def test_subjects_of_several_blocks_agree_with_whole_ones(spark, monkeypatch):
    given = small_world(spark, short=20)
    once = parcellation.parcellate(*given)
    whole = parcellation.em.observations
    monkeypatch.setattr(parcellation.em, "observations", lambda profile: whole(profile, rows_per_block=30))
    blocks = parcellation.parcellate(*given)
    assert {tuple(r) for r in once["labels"].collect()} == {tuple(r) for r in blocks["labels"].collect()}
    lam = lambda got: {(r["sub"], r.v, r.l): r.lam for r in got["cells"].collect()}
    assert lam(blocks) == pytest.approx(lam(once), abs=1e-7)
    cost = lambda got: {(r["sub"], r["round"]): r.cost for r in got["cost"].collect()}
    assert cost(blocks) == pytest.approx(cost(once), rel=1e-9)
