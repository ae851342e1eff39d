"""Bad readings of one series by a four-state hidden Markov model (numpy only, one series at a time or batched)."""

from __future__ import annotations

import numpy as np

NORMAL, SPIKE, STUCK, OUT = 0, 1, 2, 3

#: Readings on each side that give a reading's surroundings.
SIDE = 7
#: Spread of normal deviations in units of the series' own scale; spikes are spread evenly from SPIKE_FROM to SPIKE_TO.
SPREAD, SPIKE_FROM, SPIKE_TO = 1.55, 1.5, 132.0
#: Deviation at which a lone reading is as likely a spike as not, under the spike rate that is assumed before any is seen.
SPIKE_AT = 6.2
#: Share of normal readings that a spike follows, before any is seen, the readings that this is worth, and the chance that a
#: spike lasts another reading.
SPIKE_RATE, RATE_WORTH, SPIKE_STAYS = 0.0456, 500.0, 0.5
#: Rounds of expectation and maximisation for the spike rate of each series.
ROUNDS = 2
#: A run stands apart if it is RUN_FACTOR times as long as the next shorter one; where that one is at most SHORT_RUN long, twice
#: as long is enough if chance repeats would give such a run less than once in RUN_CHANCE series. At least RUN_LEAST readings.
RUN_FACTOR, SHORT_RUN, RUN_CHANCE, RUN_LEAST = 2.9, 6, 1e-4, 8
#: Log odds against a run of equal values being frozen, which its length must overcome; chance of a reading out of bounds.
ENTER_STUCK, OUT_RATE = 18.0, 1e-4
#: Steps that the batched recursion takes at once; longer series are cut and joined exactly by matrix products.
CHUNK = 256


def rolling_median7(x: np.ndarray) -> np.ndarray:
    """Medians of ``x[i:i + 7]``; selection by pairwise minima and maxima on shifted views, without sorting rows."""
    a, b, c, d, e, f, g = (x[i : len(x) - 6 + i] for i in range(7))
    lo, hi = np.minimum, np.maximum
    # the least and the greatest of five can't be the median of seven, nor those of the three left and a sixth
    a, b = lo(a, b), hi(a, b)
    c, d = lo(c, d), hi(c, d)
    a, c = lo(a, c), hi(a, c)
    b, d = lo(b, d), hi(b, d)  # a least, d greatest of four
    a, e = lo(a, e), hi(a, e)
    e, d = lo(e, d), hi(e, d)  # a least, d greatest of five; left: b, c, e
    b, c = lo(b, c), hi(b, c)
    e, f = lo(e, f), hi(e, f)
    e, c = hi(b, e), lo(c, f)  # left: e, c
    return hi(lo(c, e), lo(hi(c, e), g))


def deviation(x: np.ndarray) -> np.ndarray:
    """Distance of each value from both its surroundings, 0 where it lies between or agrees with either side.

    The lesser of the distances to the medians of the SIDE values before and after. After a lasting change of level a
    value agrees with what follows, so only values that leave both sides count. Ends are mirrored.
    """
    n = len(x)
    if n <= SIDE:
        return np.zeros(n)
    padded = np.concatenate([x[SIDE:0:-1], x, x[-2 : -SIDE - 2 : -1]])
    med = rolling_median7(padded)
    a, b = x - med[:n], x - med[SIDE + 1 : SIDE + 1 + n]
    return np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0.0)


def stuck_length(lengths: np.ndarray) -> float:
    """The run length from which on a run of equal values counts as stuck, from the lengths of all runs of the series.

    Stuck runs stand apart from the body of run lengths. Going down from the longest, the deepest one that stands apart
    separates them, as long as they are the lesser part of all runs; the length asked for lies midway (in ratio) between it and the
    longest normal run. If none stands apart it is RUN_FACTOR times the longest run.
    """
    longest = np.sort(lengths)[::-1]
    if len(longest) < 2:
        return float(RUN_LEAST)
    few = max(1, (len(longest) - 1) // 2)
    top, below = longest[:few].astype(float), longest[1 : few + 1].astype(float)
    left = len(longest) - np.arange(1, few + 1)
    repeats = 1.0 - left / np.maximum(lengths.sum() - np.cumsum(top), 1.0)
    chance = left * np.maximum(repeats, 1e-12) ** (top - 1)
    apart = (top >= RUN_FACTOR * below) | ((below <= SHORT_RUN) & (top >= 2 * below) & (chance < RUN_CHANCE))
    found = np.flatnonzero(apart & (top >= RUN_LEAST))
    if not len(found):
        return max(RUN_LEAST, RUN_FACTOR * float(longest[0]))
    k = found[-1]
    return max(RUN_LEAST - 0.5, float(np.sqrt(top[k] * below[k])))


def _forward_backward(emission: np.ndarray, chain: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior state probabilities of several series laid end to end, and the probability that each reading begins a spike.

    emission: (rows, 4) likelihoods; chain: (series, kinds, 4, 4) transition matrices; kind: which of them leads to each row;
    starts: first row of each series. Series are cut into chunks of CHUNK rows that advance together; the products of the
    chunks' matrices give the messages at the cuts, so the result is that of the uncut recursion.
    """
    rows = len(emission)
    ends = np.append(starts[1:], rows)
    series_of, first = [], []
    for s, (a, b) in enumerate(zip(starts, ends)):
        cuts = np.arange(a, b, CHUNK)
        first.append(cuts)
        series_of.append(np.full(len(cuts), s))
    first, series_of = np.concatenate(first), np.concatenate(series_of)
    size = np.minimum(ends[series_of] - first, CHUNK)
    order = np.argsort(-size, kind="stable")
    first, series_of, size = first[order], series_of[order], size[order]
    chunks, kinds = len(first), chain.shape[1]
    flat, base = chain.reshape(-1, 4, 4), series_of * kinds
    steps = int(size[0])
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]  # chunks longer than t
    is_start = first == starts[series_of]

    def matrices(k: int, at: np.ndarray) -> np.ndarray:
        return flat[base[:k] + kind[at]]

    # messages at the cuts
    enter = np.tile(np.array([1.0, 0.0, 0.0, 0.0]), (chunks, 1))
    leave = np.ones((chunks, 4))
    if not is_start.all():
        product = np.tile(np.eye(4), (chunks, 1, 1))
        for t in range(steps):
            k = alive[t]
            at = first[:k] + t
            p = np.matmul(product[:k], matrices(k, at)) * emission[at][:, None, :]
            product[:k] = p / p.max(axis=(1, 2), keepdims=True)
        by_place = {(int(s), int(f)): i for i, (s, f) in enumerate(zip(series_of, first))}
        for s in np.flatnonzero(ends - starts > CHUNK):
            ids = [by_place[(int(s), int(f))] for f in range(int(starts[s]), int(ends[s]), CHUNK)]
            for i, j in zip(ids, ids[1:]):
                m = enter[i] @ product[i]
                enter[j] = m / m.sum()
            for i, j in zip(ids[-2::-1], ids[:0:-1]):
                m = product[j] @ leave[j]
                leave[i] = m / m.sum()

    alpha, ahead = np.empty((rows, 4)), np.empty((rows, 4))
    now = enter
    for t in range(steps):
        k = alive[t]
        at = first[:k] + t
        ahead[at] = now = np.matmul(now[:k, None, :], matrices(k, at))[:, 0, :]
        now = now * emission[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    beta = leave.copy()
    out, begins = np.empty((rows, 4)), np.empty(rows)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        gamma = alpha[at] * beta[:k]
        out[at] = gamma / gamma.sum(axis=1, keepdims=True)
        seen = emission[at] * beta[:k]
        a = matrices(k, at)
        before = alpha[at - 1, NORMAL] if t else enter[:k, NORMAL]
        begins[at] = before * a[:, NORMAL, SPIKE] * seen[:, SPIKE] / (ahead[at] * seen).sum(axis=1)
        back = np.matmul(a, seen[:, :, None])[:, :, 0]
        beta[:k] = back / back.sum(axis=1, keepdims=True)
    return out, begins


#: What is normal for a series: its readings, the scale of its deviations, the chance that a normal reading repeats the one before, its spike rate.
NORMS = ("readings", "scale", "repeats", "spikes")
_FRESH, _FIRST_REPEAT, _REPEAT = 0, 1, 2


def _chain(spikes: float) -> np.ndarray:
    """Transition matrices of a series, each row summing to one: to a value that differs from the one before, to the first that repeats
    it, to a later repeat. A sensor freezes at the first repeat and stays frozen as long as the value does."""
    stuck, out = np.exp(-ENTER_STUCK), OUT_RATE
    from_normal = lambda k: (1.0 - spikes - k - out, spikes, k, out)
    from_spike = lambda k: (1.0 - SPIKE_STAYS - k - out, SPIKE_STAYS, k, out)
    from_out = lambda k: (0.5 - spikes - k, spikes, k, 0.5)
    still = (0.0, 0.0, 1.0, 0.0)
    thawed = from_normal(0.0)
    free = [from_normal(0.0), from_spike(0.0), thawed, from_out(0.0)]
    freezing = [from_normal(stuck), from_spike(stuck), thawed, from_out(stuck)]
    frozen = [from_normal(0.0), from_spike(0.0), still, from_out(0.0)]
    return np.array([free, freezing, frozen])


def bad_readings(value: np.ndarray, impossible: np.ndarray, starts: np.ndarray, quantity: np.ndarray, norms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, probability of being bad, and NORMS for the readings of several series laid end to end.

    value: readings in time order; impossible: those outside hard bounds; starts: first row of each series;
    quantity: per series, True where values are amounts (volumes), for which zero is legal and only upward spikes
    count. Each series is judged by its own NORMS: the scale of its usual change and its usual deviation from its surroundings,
    the chance of a repeat that its normal runs of equal values give, and its spike rate, found by ROUNDS of expectation and
    maximisation. Where ``norms`` (a row a series, NaN where unknown) has them they are taken from there.

    A reading is bad if its probability is at least one half; its state is then the most likely of the bad ones, else NORMAL.
    """
    rows = len(value)
    if not rows:
        return np.zeros(0, dtype=int), np.zeros(0), np.zeros((0, len(NORMS)))
    emission, kind = np.zeros((rows, 4)), np.full(rows, _FRESH)
    ends = np.append(starts[1:], rows)
    own = np.empty((len(starts), len(NORMS)))
    spike_density = 1.0 / (SPIKE_TO - SPIKE_FROM)
    calm_density = 2.0 / (SPREAD * np.sqrt(2 * np.pi))
    given = norms if norms is not None else np.full((len(starts), len(NORMS)), np.nan)
    for s, (a, b) in enumerate(zip(starts, ends)):
        v, bad, amount = value[a:b], impossible[a:b], quantity[s]
        fit = ~bad & (v > 0)
        scaled, scale = np.zeros(b - a), given[s, 1]
        if fit.sum() > SIDE:
            x = np.log(v[fit])
            dev = deviation(x)
            if amount:
                dev = np.where(x > np.median(x), np.maximum(dev, 0), 0)
            size = np.abs(dev)
            if np.isnan(scale):
                step = np.abs(np.diff(x))
                step = step[step > 0]
                scale = max(np.median(step) if len(step) else 0.0, np.quantile(size, 0.95) / 1.25)
            if scale > 0:
                scaled[fit] = size / scale
        equal = np.zeros(b - a, dtype=bool)
        equal[1:] = v[1:] == v[:-1]
        repeats = given[s, 2]
        if np.isnan(repeats):
            edges = np.flatnonzero(~(equal & fit))
            repeats = np.exp(-ENTER_STUCK / (stuck_length(np.diff(np.append(edges, b - a))) - 1))
        own[s] = b - a, scale, repeats, given[s, 3] if not np.isnan(given[s, 3]) else SPIKE_RATE
        e = emission[a:b]
        calm = calm_density * np.exp(-0.5 * np.minimum(scaled / SPREAD, 12.0) ** 2)
        same = np.where(equal, repeats, 1.0 - repeats)
        e[:, NORMAL] = calm * same
        e[:, SPIKE] = np.where(scaled > SPIKE_FROM, spike_density * same, 0.0)
        e[:, STUCK] = np.where(equal & (v != 0 if amount else True), calm, 0.0)
        e[bad] = (0.0, 0.0, 0.0, 1.0)
        e[bad & equal, STUCK] = 1.0  # a frozen value may also be impossible
        now = kind[a:b]
        now[equal] = _REPEAT
        now[1:][equal[1:] & ~equal[:-1]] = _FIRST_REPEAT
    emission = np.maximum(emission, 1e-300)
    known = ~np.isnan(given[:, 3])
    for last in range(ROUNDS, -1, -1):
        posterior, begins = _forward_backward(emission, np.stack([_chain(r) for r in own[:, 3]]), kind, starts)
        if not last or known.all():
            break
        normal, begun = np.add.reduceat(posterior[:, NORMAL], starts), np.add.reduceat(begins, starts)
        rate = (begun + SPIKE_RATE * RATE_WORTH) / (normal + RATE_WORTH)
        own[~known, 3] = np.clip(rate, 1e-6, 0.2)[~known]
    p = np.where(impossible, 1.0, 1.0 - posterior[:, NORMAL])
    state = np.where(p >= 0.5, SPIKE + posterior[:, SPIKE:].argmax(axis=1), NORMAL)
    state[impossible] = OUT
    return state, p, own
