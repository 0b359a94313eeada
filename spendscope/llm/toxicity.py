"""Toxicity by a subsequence string kernel with Nystrom landmarks and a support vector machine.

A unit is a word, lower-cased, with digits read as the letters they imitate, or
two short neighbouring words read as one (an insult cut by a space), or a run of
single letters read as one word. Two units are as similar as the four-letter
subsequences they share, each weighted by DECAY to the power of the span it takes
in either (spans up to SPAN), so dropped, inserted or starred letters only weaken
a match. Landmarks are the units that tell labelled sentences apart best, and
frequent other ones; features of a unit are its kernel values to the landmarks
times the inverse root of the landmarks' kernel matrix. A linear support vector
machine is trained on them. A toxic sentence says that some of its units are toxic:
those that occur in toxic ones too often for chance, those that share runs of letters
which do so twice in a text, and where there is none, the one that the machine of
the turn before scores highest (multiple-instance learning). An insult made of several long harmless words is out of the kernel's reach.

Evidence is counted by distinct text, and texts that share most of their units have
one vote together, so copies of a labelled text teach no more than the text
itself. The logistic curve that turns margins into scores is fitted on texts that
the machine has not seen (two halves judge each other), over all of their units.

The trained machine is a sum over subsequences, so scoring needs one table of
1,048,576 values: units of a batch are made distinct by hash and summed up in
numpy. A document scores by its three highest units and by how dense its units
above 0 are, through a logistic curve.

Bounds of the training sample: SAMPLE_DOCS distinct texts of each label of at most
SAMPLE_CHARS characters, SAMPLE_UNITS units of harmless texts as examples of
harmless ones, CALIBRATION_DOCS texts of each label for the curve. Each takes
those first by hash. Scoring has no bound.

Defined cases: null and empty texts, and texts without a unit of three letters,
score as if all units were harmless; rows without label teach nothing; a text with both
labels counts as toxic; without labels of both kinds all scores are equal to the share of label 1
(0 without any label); whole texts are scored, however long; repeated rows score alike and
teach once; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import Words, documents, mapped, mix, utf8

#: Distinct labelled texts to fit on, of each label, and characters of a text that may be among them.
SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 50_000
#: Units of harmless texts to learn from, and texts of each label that the curve is fitted on.
SAMPLE_UNITS, CALIBRATION_DOCS = 40_000, 1_000
#: How much harmless texts weigh against toxic ones when the curve is fitted, whatever their numbers in the sample.
HARMLESS = 3.0
#: Units added to a text's own when the density of toxic ones is taken.
_FEW = 20
#: Texts whose letter runs are counted at once.
_TEXTS_AT_ONCE = 500
#: Bytes of a word that may be half of a unit of two.
_SHORT = (2, 5)
_ODD = np.uint64(0x9E3779B97F4A7C15)
LANDMARKS = 48
LETTERS, DECAY, SPAN = 4, 0.6, 9
#: Margin below which units don't differ.
FLOOR = -0.5
_SYMBOLS = 32
_CODES = _SYMBOLS**LETTERS
#: Letter classes: a-z are 1..26; imitating digits and signs; other letters by their last byte; 0 is no letter.
_CLASS = np.zeros(256, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = _i + 1
for _c, _d in zip("013457@", "oieasta"):
    _CLASS[ord(_c)] = ord(_d) - 96
for _i in range(128, 192):
    _CLASS[_i] = 27 + _i % 3  # last bytes of a character; first bytes are no letter
_BEGIN, _END = 30, 31
_KNOWN_UNITS = 1 << 19


def subsequences(letters: np.ndarray, bounds: np.ndarray):
    """(unit, code, weight) of all subsequences of LETTERS letters; letters of unit u are bounds[u]:bounds[u + 1]."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.int64)
    n, codes = len(letters), letters.astype(np.int32)
    for span in range(LETTERS - 1, SPAN):
        same = np.flatnonzero(owner[:-span] == owner[span:]) if n > span else np.zeros(0, np.int64)
        if not len(same):
            return
        unit, ends = owner[same], codes[same] * _SYMBOLS ** (LETTERS - 1) + codes[same + span]
        for inner in combinations(range(1, span), LETTERS - 2):
            code = ends
            for place, step in enumerate(inner):
                code = code + codes[same + step] * _SYMBOLS ** (LETTERS - 2 - place)
            yield unit, code, DECAY ** (span + 1)


def lengths_norm(n: np.ndarray) -> np.ndarray:
    """Root of a unit's kernel with itself if no subsequence occurs twice; never 0."""
    total = np.zeros(len(n))
    for span in range(LETTERS - 1, SPAN):
        total += np.maximum(n - span, 0) * comb(span - 1, LETTERS - 2) * DECAY ** (2 * (span + 1))
    return np.sqrt(np.maximum(total, DECAY ** (2 * LETTERS)))


def profiles(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (unit, code, value) of normed subsequence weights, and the lengths."""
    letters, bounds = _spelled(units)
    return *_profiles(letters, bounds), np.diff(bounds)


def _profiles(letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [(u * _CODES + c, np.full(len(u), w)) for u, c, w in subsequences(letters, bounds)]
    key = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    keys, inverse = np.unique(key, return_inverse=True)
    summed = np.bincount(inverse, value, len(keys))
    unit, code = np.divmod(keys, _CODES)
    return unit, code, summed / lengths_norm(np.diff(bounds))[unit]


def _spelled(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(units), np.uint8)
    offsets = np.r_[0, np.cumsum([len(u) for u in units])].astype(np.int64)
    return _only_letters(raw, offsets)


def _only_letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of each unit between a mark of its begin and one of its end; nothing for a unit without letters."""
    classes = _CLASS[raw]
    upto = np.r_[0, np.cumsum(classes > 0)]
    count = np.diff(upto[offsets])
    bounds = np.r_[0, np.cumsum(np.where(count > 0, count + 2, 0))]
    letters = np.zeros(bounds[-1], np.uint8)
    some = count > 0
    letters[bounds[:-1][some]], letters[bounds[1:][some] - 1] = _BEGIN, _END
    letters[letters == 0] = classes[classes > 0]
    return letters, bounds


def _single_letters(words: Words) -> tuple[list[int], list[bytes]]:
    """Runs of three or more words of one letter in a row of a text, each as one unit."""
    single = (words.ends - words.starts == 1) & (_CLASS[words.raw[np.minimum(words.starts, max(len(words.raw) - 1, 0))]] > 0)
    if single.sum() < 3:
        return [], []
    run = np.r_[True, (single[1:] != single[:-1]) | (words.owner[1:] != words.owner[:-1])]
    first = np.flatnonzero(run)
    length = np.diff(np.r_[first, len(single)])
    rows, units = [], []
    for at, n in zip(first.tolist(), length.tolist()):
        if n >= 3 and single[at]:
            rows.append(int(words.owner[at]))
            units.append(words.raw[words.starts[at : at + n]].tobytes())
    return rows, units


class Units:
    """Units of texts: which text has which (owner, key), and their letters."""

    def __init__(self, column: pa.Array):
        self.raw, offsets = utf8(pc.utf8_lower(column))
        words = self.words = Words(self.raw, offsets)
        size = words.ends - words.starts
        short = (size >= _SHORT[0]) & (size <= _SHORT[1])
        first = np.flatnonzero(short[:-1] & short[1:] & (words.owner[:-1] == words.owner[1:])) if len(size) else np.zeros(0, np.int64)
        rows, self.runs = _single_letters(words)
        none = np.zeros(len(size), np.int64)
        self.at = np.r_[words.starts, words.starts[first]], np.r_[none, words.starts[first + 1]]
        self.size = np.r_[size, size[first]], np.r_[none, size[first + 1]]
        runs = np.array([int.from_bytes(hashlib.blake2b(u, digest_size=8).digest(), "little") for u in self.runs], np.uint64)
        self.keys = np.r_[words.hashes, mix(words.hashes[first] * _ODD ^ mix(words.hashes[first + 1])), runs]
        self.owner = np.r_[words.owner, words.owner[first], np.array(rows, np.int64)]

    def __len__(self) -> int:
        return len(self.keys)

    def spelled(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters and bounds of units, given in rising order."""
        some, runs = some[some < len(self.at[0])], some[some >= len(self.at[0])] - len(self.at[0])
        starts = np.c_[self.at[0][some], self.at[1][some]].ravel()
        size = np.c_[self.size[0][some], self.size[1][some]].ravel()
        at = np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        letters, bounds = _only_letters(self.raw[at], np.r_[0, np.cumsum(size)][::2])
        more, ends = _spelled([self.runs[i] for i in runs.tolist()])
        return np.r_[letters, more], np.r_[bounds, ends[1:] + bounds[-1]]

    def text(self, i: int) -> bytes:
        n = len(self.at[0])
        return self.runs[i - n] if i >= n else b"".join(self.raw[a[i] : a[i] + s[i]].tobytes() for a, s in zip(self.at, self.size))


@dataclass
class Model:
    table: np.ndarray  # margin of a subsequence of weight 1
    bias: float
    slope: tuple[float, ...]
    offset: float

    def margins(self, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        total = np.zeros(n)
        for unit, code, weight in subsequences(letters, bounds):
            value = self.table[code]
            hit = np.flatnonzero(value)
            total += np.bincount(unit[hit], value[hit] * weight, n)
        return total / lengths_norm(np.diff(bounds)) + self.bias

    def probability(self, top: np.ndarray) -> np.ndarray:
        """From the rows of best()."""
        return 1 / (1 + np.exp(-np.clip(top @ np.array(self.slope) + self.offset, -30, 30)))


def best(owner: np.ndarray, margin: np.ndarray, n: int) -> np.ndarray:
    """(rows, 3): each row's highest margin, the mean of its second and third, nothing counting below FLOOR, and how dense its units above 0 are."""
    at = np.flatnonzero(margin > FLOOR)
    at = at[np.lexsort((-margin[at], owner[at]))]
    first = np.searchsorted(owner[at], np.arange(n + 1))
    out = np.full((n, 3), FLOOR)
    for k in range(3):
        has = np.flatnonzero(np.diff(first) > k)
        out[has, k] = margin[at[first[has] + k]]
    above = np.bincount(owner[margin > 0], minlength=n)
    return np.c_[out[:, 0], out[:, 1:].mean(1), np.log1p(100 * above / (np.bincount(owner, minlength=n) + _FEW))]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weighted linear machine with squared hinge loss, by accelerated gradient descent."""
    x1 = np.c_[x, np.ones(len(x))]
    weight = weight / weight.sum()
    step = 1 / (2 * np.linalg.norm((x1 * weight[:, None]).T @ x1, 2) + reg)
    w = v = np.zeros(x1.shape[1])
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = -2 * x1.T @ (weight * y * slack) + reg * np.r_[v[:-1], 0]
        new = v - step * grad
        v = new + i / (i + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _logistic(top: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and offset of the logistic curve; labels are smoothed, kinds weigh 1 to HARMLESS, steps are halved until the loss falls."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 1 / max(pos, 1), HARMLESS / max(neg, 1)) / (1 + HARMLESS)
    x, start = np.c_[top, np.ones(len(top))], np.array([1.0, 0.5, 0.5, 0.0])
    w, ridge = start, 0.002

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - t * z) + ridge / 2 * ((w - start) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(4)
        move = np.linalg.solve(h, x.T @ (weight * (p - t)) + ridge * (w - start))
        now, step = loss(w), 1.0
        while step > 1e-8 and loss(w - step * move) > now:
            step /= 2
        if step <= 1e-8:
            break
        w = w - step * move
    return tuple(float(max(x, 0.0)) for x in w[:3]), float(w[3])


def _nystrom(letters: np.ndarray, bounds: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Subsequences of the landmarks (code, landmark, value), the inverse root of their kernel, and all units' features."""
    n = len(bounds) - 1
    unit, code, value = _profiles(np.concatenate([letters[bounds[i] : bounds[i + 1]] for i in marks]), np.r_[0, np.cumsum(np.diff(bounds)[marks])])
    order = np.argsort(code, kind="stable")
    code, mark, value = code[order], unit[order], value[order]
    begin = np.searchsorted(code, np.arange(_CODES + 1))
    kernel = np.zeros(n * len(marks), np.float32)
    for u, c, w in subsequences(letters, bounds):
        count = begin[c + 1] - begin[c]
        hit = np.flatnonzero(count)
        at = np.repeat(begin[c[hit]] - np.r_[0, np.cumsum(count[hit])[:-1]], count[hit]) + np.arange(count[hit].sum())
        np.add.at(kernel, np.repeat(u[hit], count[hit]) * len(marks) + mark[at], value[at] * w)
    kernel = kernel.reshape(n, len(marks))
    kernel /= lengths_norm(np.diff(bounds))[:, None].astype(np.float32)
    own = kernel[marks].astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-5 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    return code, mark, value, root, kernel @ root.astype(np.float32)


def _voters(owner: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """Which texts vote together: those of a bucket of equal minima of three hashes that share half of their units, by their first one."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    some = np.flatnonzero(np.diff(bounds) > 0)
    least = []
    for seed in range(1, 10):
        spread = mix(unit * _ODD + np.uint64(seed))
        least.append(np.minimum.reduceat(spread, bounds[some]) if len(some) else np.zeros(0, np.uint64))
    leader = np.arange(n)

    def find(i: int) -> int:
        while leader[i] != i:
            i = leader[i]
        return i

    sets: dict[int, np.ndarray] = {}
    own = lambda i: sets.setdefault(i, unit[bounds[i] : bounds[i + 1]])
    for band in range(0, 9, 3):
        heads: dict[tuple, list[int]] = {}
        for i, key in zip(some.tolist(), zip(*(x.tolist() for x in least[band : band + 3]))):
            for j in heads.setdefault(key, []):
                shared = len(np.intersect1d(own(i), own(j), assume_unique=True))
                if 2 * shared >= len(own(i)) + len(own(j)) - shared:
                    a, b = find(i), find(j)
                    leader[max(a, b)] = min(a, b)
                    break
            else:
                heads[key].append(i)
    return np.array([find(i) for i in range(n)], np.int64)


def _votes(voter: np.ndarray, owner: np.ndarray, place: np.ndarray, texts: np.ndarray, size: int) -> np.ndarray:
    """How many groups of voters among the chosen texts have each unit."""
    chosen = texts[owner]
    pairs = np.unique(voter[owner[chosen]] * size + place[chosen])
    return np.bincount(pairs % size, minlength=size).astype(float)


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model of texts with labels 0 and 1."""
    joint: dict[str, int] = {}
    for text, label in zip(texts, labels):
        joint[text] = max(label, joint.get(text, 0))
    # in the order of their hashes, so that halves do not hang on the order of rows
    hashed = lambda x: hashlib.blake2b(x.encode(), digest_size=8).digest()
    column = sorted(joint, key=hashed)
    y = np.array([joint[x] for x in column], np.int64)
    if not y.any() or y.all():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(_CODES, np.float32), 0.0, (0.0, 0.0, 0.0), float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))))
    units = Units(pa.array(column, pa.large_string()))
    n = len(column)
    keys, first, place = np.unique(units.keys, return_index=True, return_inverse=True)
    pairs = np.unique(units.owner * len(keys) + place)
    owner, place = pairs // len(keys), pairs % len(keys)
    voter = _voters(owner, keys[place], n)
    runs = _runs_of(units, first, owner, place, n)
    everyone = np.ones(n, bool)
    model = _machine(units, keys, first, owner, place, runs, voter, y, everyone)
    if model is None:
        rate = float(y.mean())
        return Model(np.zeros(_CODES, np.float32), 0.0, (0.0, 0.0, 0.0), float(np.log(rate / (1 - rate))))
    # two halves of the voters judge each other's texts
    half = (mix(voter.astype(np.uint64) * _ODD) & np.uint64(1)).astype(bool)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    tops, truth = [], []
    for side in (half, ~half):
        judge = _machine(units, keys, first, owner, place, runs, voter, y, ~side) or model
        some = np.concatenate([np.flatnonzero(side & (y == label) & (voter == np.arange(n)))[: CALIBRATION_DOCS // 2] for label in (0, 1)])
        if not len(some):
            continue
        mine = np.concatenate([place[bounds[i] : bounds[i + 1]] for i in some])
        whose = np.repeat(np.arange(len(some)), np.diff(bounds)[some])
        spoken, at = np.unique(mine, return_inverse=True)
        tops.append(best(whose, _margins(judge, units, first[spoken])[at], len(some)))
        truth.append(y[some])
    model.slope, model.offset = _logistic(np.concatenate(tops), np.concatenate(truth))
    return model


def _margins(model: Model, units: Units, some: np.ndarray) -> np.ndarray:
    """Margins of units, a unit of too few letters being as the bias."""
    order = np.argsort(some, kind="stable")
    letters, bounds = units.spelled(some[order])
    out = np.empty(len(some))
    out[order] = np.where(np.diff(bounds) >= LETTERS + 1, model.margins(letters, bounds), model.bias)
    return out


@dataclass
class Runs:
    """Runs of LETTERS letters: those of each unit, and which of them each text has in two units or more."""

    bounds: np.ndarray
    run: np.ndarray
    owner: np.ndarray
    twice: np.ndarray
    n: int


def _runs_of(units: Units, first: np.ndarray, owner: np.ndarray, place: np.ndarray, n: int) -> Runs:
    order = np.argsort(first, kind="stable")
    letters, ends = units.spelled(first[order])
    size = np.maximum(np.diff(ends) - LETTERS + 1, 0)
    begin = np.repeat(ends[:-1] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    code = np.zeros(len(begin), np.int32)
    for k in range(LETTERS):
        code = code * _SYMBOLS + letters[begin + k]
    known, code = np.unique(code, return_inverse=True)
    # back to the order of the units
    spot = np.empty(len(order), np.int64)
    spot[order] = np.arange(len(order))
    start = np.r_[0, np.cumsum(size)]
    count = size[spot]
    bounds = np.r_[0, np.cumsum(count)]
    run = code[np.repeat(start[spot] - bounds[:-1], count) + np.arange(bounds[-1])].astype(np.int32)
    cut, owners, twice = np.searchsorted(owner, np.arange(0, n + _TEXTS_AT_ONCE, _TEXTS_AT_ONCE)), [], []
    for a, b in zip(cut, cut[1:]):
        p, size = place[a:b], count[place[a:b]]
        at = np.repeat(bounds[p] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(p) else np.zeros(0, np.int64)
        both, times = np.unique(np.repeat(owner[a:b], size) * len(known) + run[at], return_counts=True)
        both = both[times > 1]
        owners.append(both // max(len(known), 1))
        twice.append(both % max(len(known), 1))
    return Runs(bounds, run, np.concatenate(owners), np.concatenate(twice), len(known))


def _telling(pos: np.ndarray, neg: np.ndarray, n_bad: int, n_good: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds, and whether label 1 is so frequent that chance is ruled out over all of them."""
    rate, prior, n = n_bad / (n_bad + n_good), 4.0, pos + neg
    odds = np.log((pos + prior * rate) / (n_bad + prior)) - np.log((neg + prior * rate) / (n_good + prior))
    share = np.clip(pos / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    surprise = n * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    return odds, (odds > np.log(4.0)) & (surprise > np.log(max(len(pos), 2))) & (pos > 1)


def _machine(
    units: Units, keys: np.ndarray, first: np.ndarray, owner: np.ndarray, place: np.ndarray, runs: Runs, voter: np.ndarray, y: np.ndarray, texts: np.ndarray,
) -> Model | None:
    """A machine of the chosen texts; None where nothing tells their labels apart."""
    bad, good = texts & (y == 1), texts & (y == 0)
    pos, neg = (_votes(voter, owner, place, x, len(keys)) for x in (bad, good))
    n_bad, n_good = len(np.unique(voter[bad])), len(np.unique(voter[good]))
    if not n_bad or not n_good:
        return None
    odds, sure = _telling(pos, neg, n_bad, n_good)
    run_votes = [_votes(voter, runs.owner, runs.twice, x, runs.n) for x in (bad, good)]
    sure_runs = _telling(*run_votes, n_bad, n_good)[1] if runs.n else np.zeros(0, bool)
    held = np.add.reduceat(np.r_[sure_runs[runs.run], False].astype(np.int64), runs.bounds[:-1]) * (np.diff(runs.bounds) > 0)
    sure |= (held > 1) & (pos > 0) & (neg == 0)
    harmless = np.flatnonzero((neg > 0) & ~sure)
    harmless = harmless[np.lexsort((keys[harmless], neg[harmless] < 2))][:SAMPLE_UNITS]
    open_texts = np.setdiff1d(np.flatnonzero(bad & (voter == np.arange(len(y)))), owner[sure[place]])
    bounds = np.searchsorted(owner, np.arange(len(y) + 1))
    # the units of toxic texts without a sure one may turn out to be toxic
    maybe = [place[bounds[i] : bounds[i + 1]] for i in open_texts.tolist()]
    maybe = [p[neg[p] == 0] for p in maybe]
    pool = np.unique(np.concatenate([np.flatnonzero(sure), harmless]))
    spot = np.argsort(first[pool], kind="stable")
    pool = pool[spot]
    letters, ends = units.spelled(first[pool])
    long_enough = np.diff(ends) >= LETTERS + 1
    pool_sure, pool_odds, pool_neg = sure[pool] & long_enough, odds[pool], neg[pool]
    evidence = np.where(long_enough & (pos[pool] > 0), pool_odds * np.sqrt(pos[pool]), -np.inf)
    telling = np.argsort(-evidence, kind="stable")[: LANDMARKS // 2]
    common = np.argsort(-np.where(long_enough, pool_neg, -1), kind="stable")[: LANDMARKS // 4]
    marks = np.unique(np.r_[telling[np.isfinite(evidence[telling])], common[long_enough[common]]])
    negative = np.flatnonzero(long_enough & (pool_neg > 0) & ~pool_sure)
    if not pool_sure.any() or not len(negative) or not len(marks):
        return None
    model, score = None, np.where(long_enough, pool_odds, -np.inf)
    for turn in range(4):
        if turn < 2:  # the second time with the harmless units that look most toxic among the landmarks
            hard = negative[np.argsort(-score[negative], kind="stable")[: LANDMARKS // 4]] if turn else []
            marks = np.unique(np.r_[marks, hard].astype(np.int64))
            code, mark, value, root, features = _nystrom(letters, ends, marks)
        x, votes = [features[pool_sure]], [np.sqrt(pos[pool[pool_sure]])]
        if turn > 1 and any(len(p) for p in maybe):
            told = np.unique(np.concatenate(maybe))
            told = told[np.argsort(first[told], kind="stable")]
            margin = np.full(len(keys), -np.inf)
            margin[told] = _margins(model, units, first[told])
            tops = np.array([p[np.argmax(margin[p])] for p in maybe if len(p) and margin[p].max() > 0], np.int64)
            if len(tops):
                tops, times = np.unique(tops, return_counts=True)
                order = np.argsort(first[tops], kind="stable")
                x.append(_features(*units.spelled(first[tops[order]]), code, mark, value, root))
                votes.append(np.sqrt(times[order]))
        # every unit of a harmless text is harmless; those that look toxic count most
        near = negative[np.argsort(-score[negative], kind="stable")[: max(5000, 20 * sum(map(len, votes)))]]
        x, weights = np.concatenate([*x, features[near]]), np.concatenate(votes)
        t = np.r_[np.ones(len(weights)), -np.ones(len(near))]
        w, b = _svm(x, t, np.r_[weights / weights.sum(), np.full(len(near), 2 / len(near))])
        score = np.where(long_enough, features @ w + b, -np.inf)
        model = Model(np.bincount(code, value * (root @ w)[mark], _CODES).astype(np.float32), b, (1.0, 0.0, 0.0), 0.0)
    return model


def _features(letters: np.ndarray, bounds: np.ndarray, code: np.ndarray, mark: np.ndarray, value: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Features of further units to landmarks that are known."""
    unit, own, weight = _profiles(letters, bounds)
    begin = np.searchsorted(code, np.arange(_CODES + 1))
    count = begin[own + 1] - begin[own]
    at = np.repeat(begin[own] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    kernel = np.bincount(np.repeat(unit, count) * len(root) + mark[at], np.repeat(weight, count) * value[at], (len(bounds) - 1) * len(root))
    return kernel.reshape(-1, len(root)) @ root


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from about SAMPLE_DOCS distinct labelled texts of each label, those first by hash."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("y in (0, 1)")
    rows = documents(docs, id_col, text_col).filter(F.length("text").between(1, SAMPLE_CHARS)).select("id", "text", F.xxhash64("text").alias("h"))
    # copies meet by the hash of their text, as one narrow row each; texts are fetched for the sample alone
    distinct = rows.select("id", "h").join(known, "id").groupBy("h").agg(F.max("y").alias("y"), F.min("id").alias("id"))
    counts = {r.y: r.n for r in distinct.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lowest = F.shiftrightunsigned(F.xxhash64(F.lit(11), "h"), 24)
    share = lambda y: int(min(1.0, SAMPLE_DOCS / max(counts.get(y, 0), 1)) * (1 << 40))
    picked = distinct.filter(lowest < F.when(F.col("y") == 1, F.lit(share(1))).otherwise(F.lit(share(0)))).limit(4 * SAMPLE_DOCS)
    # the sample's keys are 4 * SAMPLE_DOCS at most
    sample = rows.join(F.broadcast(picked), ["id", "h"]).select("text", "y").toArrow()
    return fit(sample.column("text").to_pylist(), sample.column("y").to_pylist())


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, unit): the unit is the one with the highest margin, null where none exceeds FLOOR."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memory: dict[str, np.ndarray] = {}

    def work(batch: pa.RecordBatch) -> dict:
        model = shared.value
        units, n = Units(batch.column("text")), len(batch)
        hashes, first, inverse = np.unique(units.keys, return_index=True, return_inverse=True)
        known, values = memory.get("known", np.zeros(0, np.uint64)), memory.get("values", np.zeros(0))
        spot = np.searchsorted(known, hashes)
        old = np.zeros(len(hashes), bool)
        if len(known):
            old = known[np.minimum(spot, len(known) - 1)] == hashes
        margin = np.zeros(len(hashes))
        margin[old] = values[spot[old]]
        new = np.flatnonzero(~old)
        if len(new):
            margin[new] = _margins(model, units, first[new])
            if len(known) + len(new) > _KNOWN_UNITS:
                known, values = hashes, margin
            else:
                known, values = np.r_[known, hashes[new]], np.r_[values, margin[new]]
                order = np.argsort(known, kind="stable")
                known, values = known[order], values[order]
            memory["known"], memory["values"] = known, values
        each, owner = margin[inverse], units.owner
        top = best(owner, each, n)
        which = np.full(n, -1)
        hit = np.flatnonzero((each == top[owner, 0]) & (each > FLOOR))[::-1]
        which[owner[hit]] = hit
        unit = [None if i < 0 else units.text(i).decode("utf-8", "replace") for i in which.tolist()]
        score = model.probability(top)
        return {"doc_id": batch.column("id"), "score": score, "predicted": (score >= threshold).astype(np.int32), "unit": pa.array(unit, pa.string())}

    return mapped(documents(docs, id_col, text_col), work, "doc_id long, score double, predicted int, unit string")
