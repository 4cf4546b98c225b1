"""Secret scans: fixed patterns, and a character convolutional network over every other candidate in its context.

Candidates are all maximal runs of [A-Za-z0-9+/_-] of LEAST_RUN bytes or more, the shortest value that a pattern takes. The network
reads a window of bytes: LEFT before the candidate, BODY of it, RIGHT after it. A candidate longer than BODY is read by windows that
begin SLIDE bytes after each other, up to its end, and the greatest output counts. Each byte has a learnt vector and a mark for
the candidate; a convolution of WIDTH bytes, ReLU, and the greatest and mean activation over the window feed a logistic output.

All windows train it, in two steps. A start is trained in numpy on a bounded sample of windows, TRAINED at most of each kind and the
least hashes first: candidates that
hold the value of a finding; others with a digit; without one, those with a mark, with capitals behind the first letter, and the
rest, so that no kind of harmless run is rare in the sample. Candidates beside a value, within a finding, are in none. Of runs
without a digit POOL times as many are drawn; those of them that a trained network calls findings join the sample AGAIN times each, and
it is trained anew, for ROUNDS rounds or until there are none.
Half of the findings' windows have their left context swapped for that of another
candidate, so that the value itself has to tell; half as many copies have their value behind the beginning of another candidate;
as many harmless windows as there are findings get one before them; and after DOUBT passes, unlabelled windows that look more like findings than not leave
it, for the patterns don't know every secret.
Then each task goes on from the start through every window of its texts (`descended`). The loss is a hinge: a window on its side of the
margin has no gradient and is only read, all others are learnt from, findings with contexts swapped and behind others as well. Again a
run with a digit that looks more like a finding than not is in doubt and moves nothing; one without counts as harmless. The network
is the mean of the tasks' weights, each by the windows it read, so it depends on how the rows are dealt to tasks.
Windows whose hash is a multiple of 3 train nothing, in either step (but a start
whose sample would lack a label without them). All of them, which lose none, calibrate the output (Platt, from counts of
outputs in steps of 1/GRAIN); the threshold is the highest that finds RECALL of all distinct findings among them, each asked with its
own and with a swapped context. Only if none is among them, or the start
had no others, the start and its own threshold stand. Candidates from there on
are findings of kind `model`; the patterns' findings all stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.kernels import chunks, lower_ascii, mix, utf8
from tesserae.session import bound_batches, cut, give_back

# The patterns, the least characters of what they capture, and the order of kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

LEAST_RUN = LEAST_ASSIGN
LEFT, BODY, RIGHT, SLIDE = 24, 48, 8, 8
WINDOW = LEFT + BODY + RIGHT
TRAINED, RECALL = 6000, 0.99
VECTOR, WIDTH, FILTERS, STEPS, BATCH, SEED = 8, 5, 16, 1500, 64, 7
POOL, AGAIN, ROUNDS = 4, 8, 3
#: Passes over the sample before doubt, and in all; STEPS is the most in any case.
DOUBT, PASSES = 4, 15
#: Of the steps through all windows: the hinge's margin, half of a batch; Adam's rate (in the start, too). Outputs are counted in steps of 1/GRAIN up to FURTHEST.
MARGIN, HALF, RATE = 2.0, 32, 0.005
GRAIN, FURTHEST = 64, 64
NAMES = ("vectors", "filters", "shift", "out", "bias")
#: Places that one matrix product yields.
PLACES = 4


def pattern_findings(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) in code points of the patterns' findings; leftmost, non-overlapping within a kind."""
    out = [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out, key=lambda x: (x[0], x[2]))


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of pattern_findings."""
    return [x[:3] for x in pattern_findings(text)]


def overlaps(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each span (first, last) meets one of the spans (starts, ends), in any order; by sorting once."""
    if not len(starts):
        return np.zeros(len(first), bool)
    order = np.argsort(starts, kind="stable")
    furthest = np.maximum.accumulate(ends[order])
    before = np.searchsorted(starts[order], last)  # those that begin before a span's end
    return (before > 0) & (furthest[np.maximum(before - 1, 0)] > first)


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


ALNUM = bytes([*range(48, 58), *range(65, 91), *range(97, 123)])
RUN_BYTES, HEX_BYTES, DIGITS = byte_class(ALNUM + b"+/_-"), byte_class(b"0123456789abcdef"), byte_class(b"0123456789")

#: What tells the kinds of harmless runs: bytes, and how many at the beginning don't count.
RUN_TRAITS = ((DIGITS, 0), (byte_class(b"+/_-"), 0), (byte_class(bytes(range(65, 91))), 1))
KINDS_OF_RUNS = len(RUN_TRAITS) + 2


def long_runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of maximal runs of `inside` of `least` bytes or more; they don't cross documents."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    starts[cuts], ends[cuts - 1] = inside[cuts], inside[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    long = e - s >= least
    return s[long], e[long]


def candidates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) in bytes of all candidates."""
    s, e = long_runs(RUN_BYTES[raw], offsets, LEAST_RUN)
    return s, e, np.searchsorted(offsets, s, "right") - 1


def first_only(most: int) -> np.ndarray:
    """Row k: k ones, then zeros, `most` in all."""
    return (np.arange(most)[None, :] < np.arange(most + 1)[:, None]).astype(np.uint8)


KEPT_LEFT, KEPT_BODY, KEPT_RIGHT = first_only(LEFT)[:, ::-1].copy(), first_only(BODY), first_only(RIGHT)


def windows(raw: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One row of WINDOW bytes a candidate, 0 outside of the document; what follows a long candidate is left out."""
    if not len(s):
        return np.zeros((0, WINDOW), np.uint8)
    low = max(int(s.min()) - LEFT, 0)
    high = min(int(max(e.max(), s.max() + BODY)) + RIGHT, len(raw))
    near = np.concatenate([np.zeros(LEFT, np.uint8), raw[low:high], np.zeros(BODY + RIGHT, np.uint8)])
    read = np.lib.stride_tricks.sliding_window_view
    out = np.empty((len(s), WINDOW), np.uint8)
    out[:, : LEFT + BODY] = read(near, LEFT + BODY)[s - low]
    out[:, LEFT + BODY :] = read(near, RIGHT)[e - low + LEFT]
    out[:, :LEFT] *= KEPT_LEFT[np.minimum(s - offsets[doc], LEFT)]
    out[:, LEFT : LEFT + BODY] *= KEPT_BODY[np.minimum(e - s, BODY)]
    out[:, LEFT + BODY :] *= KEPT_RIGHT[np.minimum(offsets[doc + 1] - e, RIGHT)]
    return out


def all_windows(raw: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray):
    """(candidates, their windows) of all windows of all candidates, in blocks of bounded size."""
    n = 1 + np.maximum(-(-(e - s - BODY) // SLIDE), 0)
    ends = np.cumsum(n)
    for a in range(0, int(n.sum()), 4096):
        at = np.arange(a, min(a + 4096, int(ends[-1])))
        of = np.searchsorted(ends, at, "right")
        yield of, windows(raw, offsets, s[of] + (at - ends[of] + n[of]) * SLIDE, e[of], doc[of])


def greatest(net: dict, raw: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each candidate: the greatest output, before calibration, of its windows."""
    out = np.full(len(s), -np.inf)
    for of, x in all_windows(raw, offsets, s, e, doc):
        np.maximum.at(out, of, logits(net, x))
    return out


def hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window."""
    h = np.zeros(len(x), np.uint64)
    for column in np.ascontiguousarray(x).view("<u8").T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def held_out(h: np.ndarray) -> np.ndarray:
    """Whether windows with these hashes are kept out of training, for calibration."""
    return h % np.uint64(3) == 0


def scan(raw: np.ndarray, offsets: np.ndarray):
    """(findings of each document in code points, candidates' start, end, document in bytes, whether each meets a finding, whether
    the value of one, code-point start and end)."""
    n = len(offsets) - 1
    flagged = np.zeros(n, bool)
    low = lower_ascii(raw).tobytes()
    for word, data in [*((k, low) for k in KEYWORDS), (b"AKIA", raw.tobytes())]:
        at = data.find(word)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            flagged[d] = True
            at = data.find(word, int(offsets[d + 1]))
    hs, _ = long_runs(HEX_BYTES[raw], offsets, LEAST_HEX)
    flagged[np.searchsorted(offsets, hs, "right") - 1] = True
    s, e, doc = candidates(raw, offsets)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first = points[offsets]
    cs, ce = points[s] - first[doc], points[e] - first[doc]
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    meets, holds = np.zeros(len(s), bool), np.zeros(len(s), bool)
    of = np.searchsorted(doc, np.arange(n + 1))
    for d in np.flatnonzero(flagged):
        own = pattern_findings(raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
        found[d] = [x[:3] for x in own]
        start, end, _, value = np.array(own, np.int64).reshape(-1, 4).T
        a, b = of[d], of[d + 1]
        meets[a:b], holds[a:b] = overlaps(start, end, cs[a:b], ce[a:b]), overlaps(value, end, cs[a:b], ce[a:b])
    return found, s, e, doc, meets, holds, cs, ce


def _forward(net: dict, x: np.ndarray):
    """Activations of windows x: (logit, all that training needs)."""
    mark = np.zeros((1, WINDOW, 1))
    mark[:, LEFT : LEFT + BODY] = 1
    v = np.concatenate([net["vectors"][x], np.broadcast_to(mark, (len(x), WINDOW, 1)) * (x != 0)[:, :, None]], axis=2)
    patches = np.lib.stride_tricks.sliding_window_view(v, WIDTH, axis=1).reshape(len(x), WINDOW - WIDTH + 1, -1)
    z = patches @ net["filters"] + net["shift"]
    a = np.maximum(z, 0)
    top = a.argmax(axis=1)
    pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(axis=1)], axis=1)
    return pooled @ net["out"] + net["bias"], (patches, z, top, pooled)


def tables(net: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes' vectors with their mark, unmarked and then marked; the filters as one matrix that yields PLACES places; their shifts."""
    vectors = np.zeros((512, VECTOR + 1), np.float32)
    vectors[:256, :VECTOR] = vectors[256:, :VECTOR] = net["vectors"]
    vectors[257:, VECTOR] = 1
    filters = np.zeros((PLACES + WIDTH - 1, VECTOR + 1, PLACES, FILTERS), np.float32)
    for p in range(PLACES):
        for j in range(WIDTH):
            filters[p + j, :, p] = net["filters"].reshape(VECTOR + 1, WIDTH, FILTERS)[:, j]
    return vectors, filters.reshape(-1, PLACES * FILTERS), np.tile(net["shift"].astype(np.float32), PLACES)


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    """The network's output before calibration, by matrix products in blocks of bounded size.

    Windows go by the length of their candidates: where all of a block have zeros behind these, the filters give their shifts.
    """
    if "tables" not in net:
        net["tables"] = tables(net)
    vectors, filters, shift = net["tables"]
    body = np.where((x[:, LEFT : LEFT + BODY] != 0).any(axis=1), BODY - (x[:, LEFT : LEFT + BODY][:, ::-1] != 0).argmax(axis=1), 0)
    order = np.argsort(body, kind="stable")
    size, out, channels = WINDOW - WIDTH + 1, np.zeros(len(x)), VECTOR + 1
    marks = np.zeros(WINDOW, np.intp)
    marks[LEFT : LEFT + BODY] = 256
    behind_ = (LEFT + BODY - WIDTH + 1) // PLACES * PLACES  # places from there on read what follows the candidate
    for a in range(0, len(x), 256):
        own = order[a : a + 256]
        first = min(-(-(LEFT + int(body[own[-1]])) // PLACES) * PLACES, behind_)  # places from there to `behind_` read zeros only
        idle = np.maximum(0, -shift)  # all outputs are taken less `shift`, which is added at the end
        top = np.tile(idle if first < behind_ else -shift, (len(own), 1))
        total = np.tile(idle * np.float32((behind_ - first) // PLACES), (len(own), 1))
        for start, end in ((0, first), (behind_, size)) if first < behind_ else ((0, size),):
            v = vectors.take(x[own, start : end + WIDTH - 1] + marks[start : end + WIDTH - 1], axis=0, mode="clip").reshape(len(own), -1)
            for p in range(0, end - start, PLACES):
                z = v[:, p * channels :][:, : len(filters)] @ filters
                np.maximum(z, -shift, out=z)
                np.maximum(top, z, out=top)
                total += z
        n = PLACES * FILTERS
        while n > FILTERS:
            n //= 2
            top, total = np.maximum(top[:, :n], top[:, n:]), total[:, :n] + total[:, n:]
        top, total = top + shift[:FILTERS], total / np.float32(size) + shift[:FILTERS]
        out[own] = np.concatenate([top, total], axis=1) @ net["out"] + net["bias"]
    return out


def squashed(net: dict, logit: np.ndarray) -> np.ndarray:
    """Calibrated probabilities of outputs."""
    return 1 / (1 + np.exp(-np.clip(net["platt"][0] * logit + net["platt"][1], -30, 30)))


def probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    """Calibrated probabilities of windows."""
    return squashed(net, logits(net, x))


def gradients(net: dict, x: np.ndarray, d: np.ndarray, activations: tuple) -> dict:
    """Of the loss by all weights, from that by the outputs of windows x, and what _forward gave for them."""
    patches, z, top, pooled = activations
    back = d[:, None] * net["out"][None, :]
    da = np.repeat(back[:, None, FILTERS:] / z.shape[1], z.shape[1], axis=1)
    np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + back[:, None, :FILTERS], 1)
    dz = da * (z > 0)
    dp = (dz @ net["filters"].T).reshape(len(x), z.shape[1], VECTOR + 1, WIDTH)
    dv = np.zeros((len(x), WINDOW, VECTOR))
    for j in range(WIDTH):
        dv[:, j : j + z.shape[1]] += dp[:, :, :VECTOR, j]
    dvec = np.zeros_like(net["vectors"])
    np.add.at(dvec, x.ravel(), dv.reshape(-1, VECTOR))
    dvec[0] = 0
    return {"vectors": dvec, "filters": np.einsum("npc,npf->cf", patches, dz), "shift": dz.sum((0, 1)), "out": pooled.T @ d, "bias": np.array([d.sum()])}


def adam(net: dict, rate: float):
    """A function that takes gradients and moves the weights of `net`."""
    m, v, step = {k: 0.0 for k in NAMES}, {k: 0.0 for k in NAMES}, 0

    def move(grads: dict) -> None:
        nonlocal step
        step += 1
        net.pop("tables", None)
        for k in NAMES:
            m[k], v[k] = 0.9 * m[k] + 0.1 * grads[k], 0.999 * v[k] + 0.001 * grads[k] ** 2
            net[k] = net[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    return move


def swapped(rng, x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Windows with the left contexts of others."""
    x = x.copy()
    x[:, :LEFT] = others[rng.integers(0, len(others), len(x)), :LEFT]
    return x


def beside(rng, x: np.ndarray, findings: np.ndarray) -> np.ndarray:
    """As many of the windows as there are findings, each with a finding and a space before it: neighbours aren't secrets."""
    x = x[rng.integers(0, len(x), len(findings))]
    body = findings[:, LEFT : LEFT + BODY]
    size = (body != 0).sum(axis=1)
    at = size[:, None] - (LEFT - 1) + np.arange(LEFT - 1)[None, :]
    left = np.where(at >= 0, np.take_along_axis(body, np.maximum(at, 0), 1), 32)
    return np.concatenate([left.astype(np.uint8), np.full((len(x), 1), 32, np.uint8), x[:, LEFT:]], axis=1)


def behind(rng, findings: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Findings' windows with 4 to 28 bytes of another candidate at the beginning of the body, as in a key at the end of a path."""
    out = findings.copy()
    for i, (k, other) in enumerate(zip(rng.integers(4, 29, len(out)), others[rng.integers(0, len(others), len(out)), LEFT : LEFT + BODY], strict=True)):
        out[i, LEFT + k : LEFT + BODY] = findings[i, LEFT : LEFT + BODY - k]
        out[i, LEFT : LEFT + k] = np.resize(other[other != 0], k)
    return out


def train(x: np.ndarray, y: np.ndarray) -> dict | None:
    """The start and its threshold from windows and labels; None without both kinds."""
    if y.sum() < 3 or (1 - y).sum() < 3:
        return None
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    x, y = x[order].copy(), y[order].astype(float)
    out = held_out(hashes(x))
    if len(set(y[~out])) < 2 or len(set(y[out])) < 2:
        out[:] = False
    kept_x, kept_y = (x[out], y[out]) if out.any() else (x, y)
    x, y = x[~out], y[~out]
    positive = np.flatnonzero(y == 1)
    half = positive[: len(positive) // 2 + 1]
    more, late = beside(rng, x[y == 0], x[positive]), behind(rng, x[positive[::2]], x[y == 0])
    x[half] = swapped(rng, x[half], x[y == 0])
    x, y = np.concatenate([x, more, late]), np.concatenate([y, np.zeros(len(more)), np.ones(len(late))])
    channels = (VECTOR + 1) * WIDTH
    net = {"vectors": rng.normal(0, 0.5, (256, VECTOR)), "filters": rng.normal(0, 1 / np.sqrt(channels), (channels, FILTERS)), "shift": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "bias": np.zeros(1), "platt": (1.0, 0.0)}
    net["vectors"][0] = 0
    move = adam(net, RATE)
    xs, ys = x, y
    weight = np.where(ys == 1, 0.5 / ys.mean(), 0.5 / (1 - ys.mean()))
    # Few passes: a network that knows its windows by heart no longer says which labels are odd.
    rounds = min(STEPS, max(300, PASSES * len(xs) // BATCH))
    doubt = min(rounds // 3, max(60, DOUBT * len(xs) // BATCH))
    for round_ in range(rounds):
        if round_ == doubt:  # what the patterns don't know may be a secret all the same: it doesn't count as harmless
            sure = (ys == 1) | (np.concatenate([_forward(net, xs[i : i + 512])[0] for i in range(0, len(xs), 512)]) < 0)
            if len(set(ys[sure])) < 2:
                return None
            xs, ys = xs[sure], ys[sure]
            weight = np.where(ys == 1, 0.5 / ys.mean(), 0.5 / (1 - ys.mean()))
        at = rng.integers(0, len(xs), BATCH)
        logit, activations = _forward(net, xs[at])
        d = weight[at] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - ys[at]) / len(at)
        move(gradients(net, xs[at], d, activations))
    logit = logits(net, kept_x)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        target = np.where(kept_y == 1, (kept_y.sum() + 1) / (kept_y.sum() + 2), 1 / ((1 - kept_y).sum() + 2))
        a, b = a - 0.1 * float(((p - target) * logit).mean()), b - 0.5 * float((p - target).mean())
    net["platt"] = (a, b)
    own = kept_x[kept_y == 1]
    scores = np.sort(probabilities(net, np.concatenate([own, swapped(rng, own, kept_x[kept_y == 0])])))
    net["threshold"] = float(scores[int(np.floor((1 - RECALL) * len(scores)))])
    return net


def drawn(kind: int, trained: int) -> int:
    """Windows that are drawn of a kind of run: 0 findings, 1 with a digit, others without."""
    return trained if kind < 2 else POOL * trained


def keep_least(kept: list, k: int, h: np.ndarray, x: np.ndarray, most: int) -> None:
    """kept[k] (sorted hashes, windows) with those of more windows, the least `most` hashes, each once."""
    hs, xs = kept[k]
    if len(hs) >= most:
        low = h < hs[-1]
        h, x = h[low], x[low]
    if len(h):
        hs, least = np.unique(np.concatenate([hs, h]), return_index=True)
        kept[k] = hs[:most], np.concatenate([xs, x])[least[:most]]


class Descent:
    """Steps of a copy of the start through windows of one task, by a hinge loss; `known` are findings that every task has."""

    def __init__(self, start: dict, known: np.ndarray):
        self.net = {k: start[k].copy() for k in NAMES}
        self.move, self.rng = adam(self.net, RATE), np.random.default_rng(SEED)
        self.findings, self.others = known, np.zeros((0, WINDOW), np.uint8)
        self.wait = [np.zeros((0, WINDOW), np.uint8)] * 2  # windows with a loss: harmless, findings'

    def forms(self, x: np.ndarray) -> np.ndarray:
        """Findings' windows as they are, with contexts swapped, and behind others."""
        return np.concatenate([x, swapped(self.rng, x, self.others), behind(self.rng, x, self.others)]) if len(x) and len(self.others) else x

    def read(self, x: np.ndarray, digit: np.ndarray) -> None:
        """Harmless windows, and whether their candidates have a digit."""
        if len(x):
            logit = logits(self.net, x)
            self.others = x
            self.wait[0] = np.concatenate([self.wait[0], x[(logit > -MARGIN) & ((logit < 0) | ~digit)]])
            self.steps(HALF)

    def read_findings(self, x: np.ndarray) -> None:
        if len(x):
            self.findings = np.concatenate([self.findings, x])
            x = self.forms(x)
            self.wait[1] = np.concatenate([self.wait[1], x[logits(self.net, x) < MARGIN]])
            self.steps(HALF)

    def steps(self, least: int = 1) -> None:
        """Steps while `least` windows of a label wait; each batch is filled up with others, half of it findings,
        and taken until it has no loss, AGAIN times at most."""
        while max(map(len, self.wait)) >= least:
            batch, self.wait = [w[:HALF] for w in self.wait], [w[HALF:] for w in self.wait]
            for _ in range(AGAIN):
                no, yes = batch
                more = self.findings[self.rng.integers(0, len(self.findings), HALF)]
                if len(self.others):
                    no = np.concatenate([no, beside(self.rng, self.others, more[: HALF // 8]), self.others[self.rng.integers(0, len(self.others), HALF - len(no))]])
                forms = self.forms(more)
                x = np.concatenate([no, yes, forms[self.rng.permutation(len(forms))[: HALF - len(yes)]]])
                side = np.where(np.arange(len(x)) < len(no), -1.0, 1.0)
                logit, activations = _forward(self.net, x)
                d = np.where(side * logit < MARGIN, -side, 0.0) / len(x)
                if not d.any():
                    break
                self.move(gradients(self.net, x, d, activations))


def labelled(batches):
    """(bytes, offsets, candidates' start, end, document, whether beside a value, whether the value of a finding) by blocks of documents."""
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        for a, b in chunks(offsets):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            _, s, e, doc, meets, holds, _, _ = scan(part, at)
            yield part, at, s, e, doc, meets & ~holds, holds


def descended(docs: DataFrame, start: dict, known: np.ndarray) -> dict:
    """The mean of networks that go on from the start in each task, through all windows of its texts that aren't held out.

    Of the tasks' weights only sums come to the driver. `read` is the number of windows that were read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(({k: start[k] for k in NAMES}, known))

    def run(batches):
        descent, n = Descent(*shared.value), 0
        for part, at, s, e, doc, beside_, holds in labelled(batches):
            rest = np.flatnonzero(~holds & ~beside_)
            digits = np.concatenate([[0], np.cumsum(DIGITS[part])])
            digit = digits[e[rest]] > digits[s[rest]]
            for of, x in all_windows(part, at, s[rest], e[rest], doc[rest]):
                own = ~held_out(hashes(x))
                n += int(own.sum())
                descent.read(x[own], digit[of][own])
            x = windows(part, at, s[holds], e[holds], doc[holds])
            x = np.unique(x[~held_out(hashes(x))], axis=0)
            n += len(x)
            descent.read_findings(x)
        descent.steps()
        if n:
            v = np.concatenate([descent.net[k].ravel() for k in NAMES])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(v)), pa.int32()), pa.array(v), pa.array([n] * len(v), pa.int64())], names=["i", "v", "n"])

    sums = cut(docs.select("text").mapInArrow(run, "i int, v double, n long"), "weights").groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n")).orderBy("i").toArrow()
    shared.unpersist()
    if not len(sums):
        return dict(start)
    ends = np.cumsum([start[k].size for k in NAMES])
    parts = np.split(sums.column("v").to_numpy(), ends[:-1])
    return dict(start) | {k: v.reshape(start[k].shape) for k, v in zip(NAMES, parts, strict=True)} | {"read": int(sums.column("n")[0].as_py())}


def platt(logit: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibration from outputs, labels and how often each occurs; by Newton's method, with halved steps."""
    target = np.where(y == 1, (n[y == 1].sum() + 1) / (n[y == 1].sum() + 2), 1 / (n[y == 0].sum() + 2))
    features = np.stack([logit, np.ones(len(logit))])
    loss = lambda w: float((n * (np.logaddexp(0, w @ features) - target * (w @ features))).sum())
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ features, -30, 30)))
        step = np.linalg.solve((features * (n * p * (1 - p))) @ features.T + 1e-6 * np.eye(2), features @ (n * (p - target)))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() <= 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def calibrated(docs: DataFrame, net: dict) -> dict | None:
    """`net` with its calibration and threshold from all windows of docs(text) that are held out; None without findings there.

    A finding counts once, however often its window occurs; of the contexts that it gets, that with the least hash holds. `asked` is
    the number of outputs that the threshold is taken from.
    """
    shared = docs.sparkSession.sparkContext.broadcast({k: net[k] for k in NAMES})

    def run(batches):
        own, counts = dict(shared.value), np.zeros(2 * GRAIN * FURTHEST + 1, np.int64)
        for part, at, s, e, doc, beside_, holds in labelled(batches):
            others, found = [], []
            for a in range(0, len(s), 4096):
                i = np.flatnonzero(~beside_[a : a + 4096]) + a
                x = windows(part, at, s[i], e[i], doc[i])
                h = hashes(x)
                out = held_out(h)
                i, x, h = i[out], x[out], h[out]
                found.append((x[holds[i]], h[holds[i]]))
                i, h = i[~holds[i]], h[~holds[i]]
                others.append((i, h))
                logit = greatest(own, part, at, s[i], e[i], doc[i])
                counts += np.bincount(np.rint((np.clip(logit, -FURTHEST, FURTHEST) + FURTHEST) * GRAIN).astype(int), minlength=len(counts))
            x, h = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.uint64))
            if len(x):
                first, swap, context = logits(own, x), np.full(len(x), np.nan), np.zeros(len(x), np.uint64)
                i, contexts = (np.concatenate(v) for v in zip(*others, strict=True))
                if len(i):
                    taken = mix(h) % np.uint64(len(i))
                    x[:, :LEFT] = windows(part, at, s[i[taken]], e[i[taken]], doc[i[taken]])[:, :LEFT]
                    swap, context = logits(own, x), contexts[taken]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(first), pa.array(swap), pa.array(context.view(np.int64))], names=["h", "first", "swap", "n"])
        at = np.flatnonzero(counts)
        if len(at):  # null hashes: counts of harmless outputs
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at / GRAIN - FURTHEST), pa.array(np.zeros(len(at))), pa.array(counts[at])], names=["h", "first", "swap", "n"])

    rows = cut(docs.select("text").mapInArrow(run, "h long, first double, swap double, n long"), "outputs")
    shared.unpersist()
    once = rows.where("h is not null").groupBy("h").agg(F.min("first").alias("first"), F.min(F.when(~F.isnan("swap"), F.struct("n", "swap")))["swap"].alias("swap"))
    scores = cut(once.select(F.explode(F.array("first", "swap")).alias("v")).where("v is not null"), "scores")
    asked = scores.count()
    if not asked:
        return None
    least = scores.orderBy("v").limit(int((1 - RECALL) * asked) + 1).agg(F.max("v")).first()[0]
    clipped = F.rint(F.greatest(F.least(F.col("v"), F.lit(FURTHEST)), F.lit(-FURTHEST)) * GRAIN) / GRAIN
    counts = rows.where("h is null").groupBy(F.col("first").alias("v"), F.lit(0).alias("y")).agg(F.sum("n").alias("n")).unionByName(scores.groupBy(clipped.alias("v"), F.lit(1).alias("y")).agg(F.count("*").alias("n"))).orderBy("v", "y").toArrow()
    net = net | {"platt": platt(*(counts.column(c).to_numpy().astype(float) for c in ("v", "y", "n"))), "asked": asked}
    return net | {"threshold": float(squashed(net, np.array([least]))[0])}


def train_on(docs: DataFrame, trained: int = TRAINED) -> dict | None:
    """A network from all windows of docs(text); its start from `trained` distinct ones at most of each kind, least hash first."""
    net, known = start_on(docs, trained)
    if net is None or not len(known):
        return net
    return calibrated(docs, descended(docs, net, known)) or net


def start_on(docs: DataFrame, trained: int) -> tuple[dict | None, np.ndarray]:
    """(the start, the findings' windows that it was trained on) from `trained` distinct windows at most of each kind."""

    def run(batches):
        """The least `trained` hashes of each kind among a task's windows; kind 0: a finding's value."""
        kept = [(np.zeros(0, np.uint64), np.zeros((0, WINDOW), np.uint8))] * KINDS_OF_RUNS
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                _, s, e, doc, meets, holds, _, _ = scan(part, at)
                has = [(c := np.concatenate([[0], np.cumsum(within[part])]))[e] > c[s + skip] for within, skip in RUN_TRAITS]
                kind = np.where(holds, 0, np.where(meets, -1, np.select(has, range(1, KINDS_OF_RUNS - 1), KINDS_OF_RUNS - 1)))
                for i in range(0, len(s), 4096):
                    own = slice(i, i + 4096)
                    x = windows(part, at, s[own], e[own], doc[own])
                    h = hashes(x)
                    for k in range(KINDS_OF_RUNS):
                        keep_least(kept, k, h[kind[own] == k], x[kind[own] == k], drawn(k, trained))
        for k, (hs, xs) in enumerate(kept):
            if len(hs):
                yield pa.RecordBatch.from_arrays([pa.array(hs.view(np.int64)), pa.array([k] * len(hs), pa.int32()), pa.array([r.tobytes() for r in xs], pa.binary())], names=["h", "kind", "window"])

    found = cut(docs.select("text").mapInArrow(run, "h long, kind int, window binary"), "windows")
    chosen = [found.where(F.col("kind") == k).distinct().orderBy("h", "window").limit(drawn(k, trained)).select("window").toArrow().column(0) for k in range(KINDS_OF_RUNS)]
    by_kind = [np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, WINDOW) for x in chosen]  # bounded by `drawn`
    del chosen
    pa.default_memory_pool().release_unused()
    give_back()
    x = np.concatenate([w[:trained] for w in by_kind])
    y = np.repeat([1] + [0] * (KINDS_OF_RUNS - 1), [len(w[:trained]) for w in by_kind])
    if not len(x):
        return None, x
    known = x[y == 1]
    known = known[~held_out(hashes(known))]
    net = train(x, y)
    pool = np.concatenate(by_kind[2:])
    for _ in range(ROUNDS):
        hard = pool[probabilities(net, pool) >= net["threshold"]] if net is not None else pool[:0]
        if not len(hard):
            break
        x, y = np.concatenate([x, np.repeat(hard, AGAIN, axis=0)]), np.concatenate([y, np.zeros(AGAIN * len(hard), y.dtype)])
        net = train(x, y)
    del x, y, pool, by_kind
    give_back()
    return net, known


def _scanned(docs: DataFrame, trained: int, finish, schema) -> DataFrame:
    """finish(rows, texts' bytes, their offsets, findings of each) for all of docs(text, ...), as Arrow batches of the schema."""
    spark = bound_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train_on(docs.select(F.col("text").cast("string").alias("text")), trained))

    def run(batches):
        net = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found, s, e, doc, meets, _, cs, ce = scan(part, at)
                new = np.flatnonzero(~meets)
                if net is not None and len(new):
                    p = squashed(net, greatest(net, part, at, s[new], e[new], doc[new]))
                    new = new[p >= net["threshold"]]
                    for i in new:
                        found[doc[i]].append((int(cs[i]), int(ce[i]), 3))
                    for d in set(doc[new].tolist()):
                        found[d].sort(key=lambda x: (x[0], x[2]))
                yield finish(batch.slice(a, b - a), part, at, found)

    return docs.mapInArrow(run, schema)


def spans_of(docs: DataFrame, trained: int = TRAINED) -> DataFrame:
    """Each row of docs (doc_id, text and any other columns) with `found`: array<struct<start, end, kind>> in code points.

    By start, then by kind in the order of KINDS; `model` findings never overlap others. A null or empty text has none. Repeated
    rows get equal findings, and a column `found` is replaced. Without findings of both labels nothing is learnt and no `model`
    span is added. A text of any length is read whole, in time that is in proportion but for the sort of its findings.
    """
    docs = docs.drop("found")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))

    def finish(rows, raw, offsets, found):
        spans = pa.array([[{"start": x, "end": y, "kind": k} for x, y, k in f] for f in found], kind)
        return pa.RecordBatch.from_arrays([*rows.columns, spans], names=[*rows.schema.names, "found"])

    return _scanned(docs, trained, finish, docs.select("*", F.expr("cast(array() as array<struct<start: long, end: long, kind: int>>)").alias("found")).schema)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans) from the rows of spans_of."""
    written = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda xs: F.array_join(F.transform(xs, written), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_model"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def blacked_out(text: str, found: list[tuple[int, int, int]]) -> str:
    """A text with its findings, sorted by start, replaced by their kinds; overlapping ones become one, named after the first."""
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, trained: int = TRAINED) -> DataFrame:
    """docs with every found secret replaced by <KIND>, and n_chars (where there is such a column) counted anew.

    Overlapping findings become one, named after the first. Null texts stay null; all rows and columns stay. Repeated rows get
    equal texts; a text of any length is read whole.
    """
    place = docs.columns.index("text")

    def finish(rows, raw, offsets, found):
        texts = rows.column(place)
        if any(found):
            texts = pa.array([t.as_py() if not f else blacked_out(t.as_py(), f) for t, f in zip(texts, found, strict=True)], texts.type)
        return pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(rows.columns)], schema=rows.schema)

    docs = docs.withColumn("text", F.col("text").cast("string"))
    out = _scanned(docs, trained, finish, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
