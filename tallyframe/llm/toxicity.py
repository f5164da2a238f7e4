"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Segments are words (and runs of single characters, for insults spelled out
with blanks); their kernel counts common subsequences, gaps decayed, so
inserted characters and other endings cost a little instead of everything.
Landmark strings give each segment a short feature vector.  A linear SVM is
trained on all segments of the labelled sentences, in multiple-instance rounds:
every segment of label 0 is a negative, and of a text of label 1 those that
score best are the positives.  The best segments of a text, weighted by rank,
become a probability by a fitted logistic curve.
"""

from __future__ import annotations

import math
import pickle
import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import cut, text_blocks
from .wavelet import gather
from .words import docs_words, mix, powers, split_words

#: Length of the counted subsequences and decay of a gap.
ORDER, DECAY = 3, np.float32(0.6)
#: Labelled texts used for training, at most.
TRAIN_TEXTS = 3000
#: Landmarks among the common segments, from each family of telling segments, and like each family.
PLAIN, MEMBERS, LOOKALIKES = 12, 12, 2
#: No further family gives landmarks once there are this many (the rank of the Nystroem form); the SVM sees all segments.
LANDMARKS = 160
#: Texts of label 1, without copies, in which a piece is found before it can tell anything.
LEAST = 3
#: Lengths of the pieces of segments (with a mark before the first character) by which families are found.
PIECES = (4, 5, 6, 7)
#: Best segments of a text that count, rounds of training, and the score from which a segment tells something.
BEST, ROUNDS, NOTHING, COST, POWER = 8, 4, -0.6, 3.0, 2
MARK = "\x02"
#: Longer words are read in overlapping windows of this many characters.
WIDE = 32
#: Numbers of subsequences up to which a table has a place for each; beyond, they are searched (8 bytes each).
DENSE = 1 << 20
#: Scores after which a task drops those of segments that it has not met since it last did so.
CACHE = 150_000
THRESHOLD = 0.7
OUTER = re.compile(r"^[^\w]+|[^\w]+$")
SENTENCE = re.compile(r"[.!?\n]+")


def codes(words: list[str]) -> np.ndarray:
    """Characters of equally long words, a mark before each, as uint32 [places, words]."""
    flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "replace"), np.uint32)
    return np.ascontiguousarray(flat.reshape(len(words), -1).T)


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All a < b < c below n, and what the span of each counts."""
    a, b, c = np.array(list(combinations(range(n), ORDER))).T
    return a, b, c, DECAY ** (c - a + 1).astype(np.float32)


def raw_kernel(same) -> np.ndarray:
    """The subsequence kernel from same[a][b], arrays that tell where characters a and b are equal."""
    n, m = len(same), len(same[0]) if len(same) else 0
    if not n or not m:
        return np.float32(0)
    zero = np.zeros_like(same[0][0], np.float32)
    one = np.ones_like(zero)
    square = DECAY * DECAY
    # prime[i][b]: subsequences of length i, up to the characters read so far and landmark position b.
    prime = [[one] * (m + 1)] + [[zero] * (m + 1) for _ in range(ORDER - 1)]
    total = zero.copy()
    for a in range(n):
        hit = [same[a][b] * square for b in range(m)]
        for b in range(ORDER - 1, m):
            total += hit[b] * prime[ORDER - 1][b]
        new = [prime[0]]
        for i in range(1, ORDER):
            row, run = [zero], zero
            for b in range(m):
                run = DECAY * run + hit[b] * prime[i - 1][b]
                row.append(DECAY * prime[i][b + 1] + run)
            new.append(row)
        prime = new
    return total


class Kernel:
    """Normalised kernel values between words and fixed landmarks; a mark before each lets beginnings count.

    The kernel is the product of what each subsequence counts in either word, so
    a landmark is a row of numbers, one for each subsequence that any landmark
    has, and a weighted sum over landmarks is a single such row.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.own = self.selves(landmarks)
        self.letters = np.unique(np.frombuffer((MARK + "".join(landmarks)).encode("utf-32-le", "replace"), np.uint32))
        found, of, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for at, names, count in self.named(landmarks):
            found.append(names.ravel())
            of.append(np.tile(at, len(names)))
            counts.append(np.repeat(count, len(at)))
        self.names, place = np.unique(np.concatenate(found), return_inverse=True)
        #: Entry by entry: place of the subsequence, landmark, what it counts there; by place.
        pairs, same = np.unique(place * len(landmarks) + np.concatenate(of), return_inverse=True)
        self.place, self.of = pairs // max(1, len(landmarks)), pairs % max(1, len(landmarks))
        self.counts = np.bincount(same, np.concatenate(counts), len(pairs)).astype(np.float32)

    @staticmethod
    def selves(words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.float32)
        for at, group in by_length(words):
            c = codes(group)
            n = len(c)
            fall = np.subtract.outer(np.arange(n), np.arange(n))
            fall = np.where(fall >= 0, DECAY ** np.maximum(fall, 0), 0).astype(np.float32)
            # As in raw_kernel, all places of the second word at a time; upto[i][b]: subsequences of length i + 1 up to b.
            total, upto = np.zeros(len(group), np.float32), [np.zeros((n + 1, len(group)), np.float32) for _ in range(ORDER - 1)]
            for a in range(n):
                hit = (c == c[a]) * (DECAY * DECAY)
                total += (hit * upto[-1][:-1]).sum(0)
                for i in range(ORDER - 2, -1, -1):
                    upto[i] *= DECAY
                    upto[i][1:] += fall @ (hit * upto[i - 1][:-1] if i else hit)
            out[at] = total
        return out

    def named(self, words: list[str], most: int = 1 << 19):
        """(indices, [triples, words] numbers of the subsequences or -1, what each counts) of groups of equally long words."""
        n = len(self.letters)
        kind = np.int32 if n <= 512 else np.int64
        for at, group in by_length(words):
            a, b, c, count = triples(len(group[0]) + len(MARK))
            some = max(1, most // len(a))
            for s in range(0, len(group), some):
                x = codes(group[s : s + some])
                letter = np.minimum(np.searchsorted(self.letters, x), n - 1).astype(kind)
                # A character that no landmark has makes every number negative.
                none = self.letters[letter] != x
                first, second, third = (np.where(none, kind(-(n**ORDER)), letter * kind(n**i)) for i in (2, 1, 0))
                names = first[a]
                names += second[b]
                names += third[c]
                yield at[s : s + some], np.maximum(names, kind(-1), out=names), count

    def table(self, values: np.ndarray):
        """A function from numbers of subsequences to the last axis of ``values`` (one for each name, and one for no name)."""
        n = len(self.letters) ** ORDER
        if n > DENSE:

            def find(names):
                at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
                return values[np.where(self.names[at] == names, at, len(self.names))]

            return find
        whole = np.full(n + 1, values[-1], values.dtype)
        whole[self.names] = values[:-1]
        return whole.take

    def __call__(self, words: list[str], most: int = 1 << 20) -> np.ndarray:
        """[words, landmarks]; 0 where either is too short."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not len(self.names):
            return out
        rows = np.zeros((len(self.names), len(self.landmarks)), np.float32)
        rows[self.place, self.of] = self.counts
        find = self.table(np.arange(len(self.names) + 1, dtype=np.int32))
        for at, names, count in self.named(words):
            found = find(names).T
            word, triple = np.nonzero(found < len(self.names))
            found, weight = found[word, triple], count[triple]
            step = max(1, most // max(1, rows.shape[1]))
            for s in range(0, len(word), step):
                e = s + step
                firsts = np.flatnonzero(np.diff(word[s:e], prepend=-1))
                out[at[word[s:e][firsts]]] += np.add.reduceat(rows[found[s:e]] * weight[s:e, None], firsts, 0)
        own = self.selves(words)
        return out / np.sqrt(np.maximum(own[:, None] * self.own[None, :], 1e-12))

    def weighted(self, weights: np.ndarray):
        """A function from words to the sums of their kernel values, times ``weights`` of the landmarks."""
        scale = weights / np.sqrt(np.maximum(self.own, 1e-12))
        values = np.append(np.bincount(self.place, self.counts * scale[self.of], len(self.names)), 0.0)
        find = self.table(values)

        def run(words: list[str]) -> np.ndarray:
            out = np.zeros(len(words))
            for at, names, count in self.named(words):
                out[at] = count @ find(names)
            return out / np.sqrt(np.maximum(self.selves(words), 1e-12))

        return run


def by_length(words: list[str], most: int = 512):
    """(indices, words) of equal length, in groups of bounded size; words too short for the kernel are left out."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(n, kind="stable")
    cuts = np.flatnonzero(np.diff(n[order], prepend=-1))
    for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)]):
        for s in range(a, e if n[order[a]] >= ORDER else a, most):
            some = order[s : min(e, s + most)]
            yield some, [words[i] for i in some.tolist()]


def bare(low: str) -> str:
    """A lowered word without what stands around it."""
    return low if low.isalnum() else OUTER.sub("", low)


def normal(word: str) -> str:
    return bare(word.lower())


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted different values, by a sort in place: a hash table of so many would take several times their memory."""
    x.sort()
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WIDE else [word[i : i + WIDE] for i in range(0, len(word) - WIDE // 2, WIDE // 2)]


def spelled(tokens: list[str]) -> list[str]:
    """Runs of three and more single characters, joined."""
    out, run = [], []
    for t in [*tokens, ""]:
        if len(t) == 1 and t.isalnum():
            run.append(t)
        else:
            if len(run) >= ORDER:
                out.append("".join(run))
            run = []
    return out


def segments(text: str) -> set[str]:
    tokens = [normal(w) for w in text.split()]
    return {w for t in [*tokens, *spelled(tokens)] for w in windows(t) if len(w) >= ORDER}


def product(x: np.ndarray, w: np.ndarray, step: int = 16384) -> np.ndarray:
    """x @ w, a few rows at a time, so that x may be of half precision."""
    w = w.astype(np.float32)
    return np.concatenate([x[s : s + step].astype(np.float32) @ w for s in range(0, len(x), step)] or [np.zeros(0, np.float32)]).astype(float)


def svm(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, steps: int = 50, rows: int = 8192) -> np.ndarray:
    """A linear SVM (squared hinge) by Newton steps, from each row's costs as a positive and as a negative.

    The last column of x is the offset's 1 and is not penalised much.
    """
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def value(w):
        f = product(x, w)
        return (ridge * w * w).sum() / 2 + (positive * np.maximum(1 - f, 0) ** 2 + negative * np.maximum(1 + f, 0) ** 2).sum(), f

    now, f = value(w)
    for _ in range(steps):
        up, down = positive * (f < 1), negative * (f > -1)
        g, h = ridge * w, np.diag(ridge)
        on = np.flatnonzero(up + down)
        for s in range(0, len(on), rows):
            k = on[s : s + rows]
            some = x[k].astype(float)
            g += 2 * some.T @ ((up[k] + down[k]) * f[k] - up[k] + down[k])
            h += 2 * some.T @ ((up[k] + down[k])[:, None] * some)
        step, size = np.linalg.solve(h, g), 1.0
        while (new := value(w - size * step))[0] > now and size > 1e-4:
            size /= 2
        if new[0] >= now - 1e-7 * abs(now):
            break
        w, now, f = w - size * step, *new
    return w


def logistic(s: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (at least 0) and offset of P(1 | s), with Platt's smoothed targets, by damped Newton steps."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, math.log((pos + 1) / (neg + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        h = weight * (p * (1 - p) + 1e-9)
        g = np.array([(weight * (t - p) * s).sum() - 1e-3 * a, (weight * (t - p)).sum()])
        m = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(m, g)
        scale = min(1.0, 4.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + scale * da, b + scale * db
    return max(a, 0.0), b


def rank_weights(best: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 3000) -> np.ndarray:
    """Weights of the best segments by rank, 0 at least and 1 in all, by projected gradient steps on the logistic loss."""
    v, b, weight = np.full(best.shape[1], 1.0), 0.0, weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(best @ v + b, -40, 40)))
        v, b = np.maximum(v + 0.5 * ((weight * (y - p)) @ best - 1e-4 * v), 0), b + 0.5 * (weight * (y - p)).sum()
    return v / v.sum() if v.sum() > 0 else np.full(len(v), 1 / len(v))


class Model:
    """A trained scorer; ``kernel`` is None where nothing could be learnt and the prior answers."""

    def __init__(self, kernel, weights, offset, slope, shift, ranks=(1.0,)):
        self.kernel, self.weights, self.offset, self.slope, self.shift, self.ranks = kernel, weights, offset, slope, shift, np.array(ranks)
        self.sums = None

    def __getstate__(self):
        """The table of sums is made anew where it is used."""
        return self.__dict__ | {"sums": None}

    def raw(self, words: list[str], step: int = 8192) -> np.ndarray:
        """What single segments tell, 0 at least."""
        if self.kernel is None or not words:
            return np.zeros(len(words))
        if self.sums is None:
            self.sums = self.kernel.weighted(self.weights)
        return told(np.concatenate([self.sums(words[s : s + step]) for s in range(0, len(words), step)]) + self.offset)

    def pooled(self, best: np.ndarray) -> np.ndarray:
        """Scores of texts from those of their best segments in falling order, [texts, BEST], filled up with 0."""
        return best[:, : len(self.ranks)] @ self.ranks

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


def told(score: np.ndarray) -> np.ndarray:
    """What segments tell by the SVM's score; one strong segment counts for more than two weak ones."""
    return np.maximum(score - NOTHING, 0.0) ** POWER


def prior(n_pos: int, n: int) -> Model:
    p = (n_pos + 1) / (n + 2)
    return Model(None, None, 0.0, 0.0, math.log(p / (1 - p)))


class Bags:
    """The segments of labelled texts: distinct segments by index, and for each text (with label and weight) those it has."""

    def __init__(self, texts: list[str], labels: list[int]):
        index: dict[str, int] = {}
        self.of = []
        for text in texts:
            own = set()
            for sentence in SENTENCE.split(text):
                own.update(index.setdefault(w, len(index)) for w in segments(sentence))
            self.of.append(np.sort(np.fromiter(own, np.int32, len(own))))
        self.words = list(index)
        self.y = np.array(labels, np.int64)
        self.weight = copy_weights(texts)
        sizes = np.fromiter(map(len, self.of), np.int64, len(self.of))
        flat, text = np.concatenate([*self.of, np.zeros(0, np.int32)]), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        #: The texts of each segment: texts[at[w] : at[w + 1]].
        self.texts, self.at = text[order], np.searchsorted(flat[order], np.arange(len(index) + 1))
        self.positive, self.negative = (np.bincount(flat, self.weight[text] * (self.y[text] == k), len(index)) for k in (1, 0))

    def total(self, label: int) -> float:
        return float(self.weight[self.y == label].sum())

    def pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, text) for every text of every one of ``words``."""
        n = self.at[words + 1] - self.at[words]
        return np.repeat(np.arange(len(words)), n), gather(self.texts, self.at[words], n)


def copy_weights(texts: list[str], rounds: int = 9) -> np.ndarray:
    """1 over the number of near copies of each text (itself included), so that copied texts prove no more than one.

    The number is the median, over ``rounds`` hash functions, of the texts that
    have the same smallest hash of two words in a row.
    """
    least = np.zeros((len(texts), rounds), np.uint64)
    for first, words, at in docs_words(pa.array(texts, pa.large_string())):
        two = words[:-1] * np.uint64(3) + words[1:]
        for r, (a, e) in enumerate(zip(at.tolist(), at[1:].tolist())):
            own = two[a : e - 1] if e - a > 1 else words[a:e]
            if len(own):
                least[first + r] = [mix(own + np.uint64(j)).min() for j in range(1, rounds + 1)]
    groups = np.empty(least.shape)
    for j in range(rounds):
        _, inverse, counts = np.unique(least[:, j], return_inverse=True, return_counts=True)
        groups[:, j] = counts[inverse]
    return 1 / np.median(groups, axis=1)


def piece_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the word) of every piece of ``n`` characters of the marked words; n = 0: of the whole words."""
    marked = [MARK + w for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.int32).astype(np.uint64)
    ends = np.cumsum(sizes)
    if n == 0:
        up, _ = powers(len(flat) + 1)
        place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat) * up[place], dtype=np.uint64)])
        return mix(sums[ends] - sums[ends - sizes]), np.arange(len(words))
    h = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for j in range(n):
        h = h * np.uint64(0x100000001B3) + flat[j : len(flat) - n + 1 + j]
    word = np.repeat(np.arange(len(words)), sizes)
    fits = np.arange(len(h)) + n <= ends[word[: len(h)]]
    return mix(h[fits] + np.uint64(n)), word[: len(h)][fits]


def families(bags: Bags) -> list[list[int]]:
    """Segments of label 1 by the piece they share, for pieces in far more texts of label 1 than chance; their number is open.

    The most telling piece comes first; segments that have it are explained and
    no longer count for the next.
    """
    n_pos, n_neg = bags.total(1), bags.total(0)
    of_one = np.flatnonzero(bags.positive > 0)
    found, tried = [], 0

    def counts(piece, word, n):
        """Weighted texts of label 1 and 0 of each of n pieces."""
        k, text = bags.pairs(word)
        both = distinct(piece[k].astype(np.int64) * len(bags.y) + text)
        piece, text = both // len(bags.y), both % len(bags.y)
        return [np.bincount(piece, bags.weight[text] * (bags.y[text] == label), n) for label in (1, 0)]

    for n in (0, *PIECES):
        h, word = piece_hashes([bags.words[i] for i in of_one.tolist()], n)
        names, piece = np.unique(h, return_inverse=True)
        often, _ = counts(piece, of_one[word], len(names))
        names = names[often >= LEAST]
        tried += len(names)
        h, word = piece_hashes(bags.words, n)
        at = np.searchsorted(names, h)
        same = at < len(names)
        same[same] = names[at[same]] == h[same]
        pairs = distinct(at[same] * np.int64(len(bags.words)) + word[same])
        piece, word = pairs // len(bags.words), pairs % len(bags.words)
        c, rest = counts(piece, word, len(names))
        keep = c > 4 * (rest + 1) * n_pos / n_neg
        cuts = np.searchsorted(piece, np.arange(len(names) + 1))
        found += [(n, word[cuts[i] : cuts[i + 1]]) for i in np.flatnonzero(keep).tolist()]
    # The bound of a Poisson tail below which one of that many pieces would come up by chance.
    least = math.log(20 * (tried + 1))
    explained = np.zeros(len(bags.words), bool)

    def evidence(words: np.ndarray) -> float:
        text = np.zeros(len(bags.y), bool)
        text[bags.pairs(words[~explained[words]])[1]] = True
        w, y = bags.weight[text], bags.y[text]
        c, expected = float(w[y == 1].sum()), (float(w[y == 0].sum()) + 1) * n_pos / n_neg
        tail = c * math.log(c / expected) - (c - expected) if c > 4 * expected else 0.0
        return tail if tail > least else 0.0

    out, open_ = [], {k: e for k, (_, words) in enumerate(found) if (e := evidence(words))}
    while open_:
        top = max(open_, key=lambda k: (open_[k], -found[k][0], -k))
        words = found[top][1]
        words = words[~explained[words]]
        own = words[bags.positive[words] > 0]
        told = bags.positive[own] / n_pos - bags.negative[own] / n_neg
        out.append([own[i] for i in np.lexsort((own, -told)).tolist()])
        explained[words] = True
        open_ = {k: e for k, old in open_.items() if k != top and (e := evidence(found[k][1]) if explained[found[k][1]].any() else old)}
    return out


def features(kernel: Kernel, root: np.ndarray, words: list[str], step: int = 4096) -> np.ndarray:
    """Nystroem features of all words, and a 1, in half precision."""
    out = np.ones((len(words), len(root) + 1), np.float16)
    for s in range(0, len(words), step):
        out[s : s + step, :-1] = kernel(words[s : s + step]) @ root
    return out


def fit(texts: list[str], labels: list[int]) -> Model:
    """Train on labelled texts, cut into sentences of which each has the label of its text."""
    n_pos, n_neg = sum(labels), len(labels) - sum(labels)
    if not n_pos or not n_neg:
        return prior(n_pos, len(labels))
    bags = Bags(texts, labels)
    groups = families(bags)
    if not groups:
        return prior(n_pos, len(labels))
    words = bags.words
    telling = np.array(sorted({w for g in groups for w in g}))
    clean = np.flatnonzero((bags.positive <= 0) | (bags.negative > 0))
    clean = clean[~np.isin(clean, telling)]
    clean = clean[np.argsort(-bags.negative[clean], kind="stable")]
    near: list[list[int]] = []
    for g in groups:
        if sum(map(len, near)) < LANDMARKS:
            near.append(g[:MEMBERS])
    # Lookalikes of each family that are frequent in texts of label 0 keep it apart from plain words.
    usual = clean[bags.negative[clean] > 1]
    like = [np.zeros((0, len(near)))]
    kernel, ends = Kernel([words[w] for g in near for w in g]), np.cumsum([len(g) for g in near])
    for s in range(0, len(usual), 4096):
        some = kernel([words[w] for w in usual[s : s + 4096].tolist()])
        like.append(np.stack([some[:, e - len(g) : e].mean(1) for g, e in zip(near, ends)], 1) * np.log1p(bags.negative[usual[s : s + 4096]])[:, None])
    close = np.argsort(-np.concatenate(like), axis=0, kind="stable")[:LOOKALIKES]
    hard = [int(usual[i]) for i in close.T.ravel().tolist()]
    chosen = list(dict.fromkeys([w for g in near for w in g] + hard + clean[:PLAIN].tolist()))
    kernel = Kernel([words[w] for w in chosen])
    values, vectors = np.linalg.eigh(kernel(kernel.landmarks).astype(float) + 1e-4 * np.eye(len(chosen)))
    root = (vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T).astype(np.float32)
    x = features(kernel, root, words)
    score = np.full(len(words), -1.0)
    score[telling] = 1.0
    for _ in range(ROUNDS):
        positive = np.zeros(len(words))
        for b, label, weight in zip(bags.of, bags.y, bags.weight):
            if label and len(b):
                best = b[np.argsort(-score[b], kind="stable")[:BEST]]
                best = best[(score[best] > 0) | (np.arange(len(best)) == 0)]
                positive[best] += weight
        # All texts of label 1 together weigh as much as all those of label 0.
        w = svm(x, COST * positive * bags.total(0) / bags.total(1), COST * bags.negative)
        score = product(x, w)
    model = Model(kernel, root @ w[:-1], float(w[-1]), 1.0, 0.0)
    score = told(score)
    best = np.zeros((len(bags.of), BEST))
    for i, b in enumerate(bags.of):
        top = np.sort(score[b])[::-1][:BEST]
        best[i, : len(top)] = top
    model.ranks = rank_weights(best, bags.y, bags.weight)
    model.slope, model.shift = logistic(model.pooled(best), bags.y, bags.weight)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_TEXTS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled texts whose crc32(doc_id as text) mod 3 is not 1, chosen by hash."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known), "doc_id").select("text", "toxic")


def best_of(rows: np.ndarray, ids: np.ndarray, told: np.ndarray, n: int) -> np.ndarray:
    """[n, BEST]: what the best different segments of each row tell, in falling order, filled up with 0."""
    out = np.zeros((n, BEST))
    order = np.lexsort((ids, -told, rows))
    rows, ids, told = rows[order], ids[order], told[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    rows, told = rows[fresh], told[fresh]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < BEST
    out[rows[keep], rank[keep]] = told[keep]
    return out


def scorer(held, text_at: int, name: str):
    """A mapInArrow function that appends the score as ``name``; the text is column ``text_at``."""

    def run(batches):
        model, cache, older = held.value, {}, {}
        for t in text_blocks(batches, text_at):
            column = t.column(text_at)
            best = []
            for data, hashes, at, starts, ends in split_words(column):
                _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                # The different words, decoded and lowered all at once with a blank after each.
                sizes = ends[first] - starts[first] + 1
                raw = gather(np.append(data, np.uint8(0x20)), starts[first], sizes)
                raw[np.cumsum(sizes) - 1] = 0x20
                words = [bare(w) for w in raw.tobytes().decode().lower().split(" ")[:-1]]
                length = np.fromiter(map(len, words), np.int64, len(words))
                parts, n_parts = words, np.ones(len(words), np.int64)
                if len(words) and length.max() > WIDE:
                    many = [windows(w) for w in words]
                    parts, n_parts = [v for own in many for v in own], np.fromiter(map(len, many), np.int64, len(many))
                if len(cache) > CACHE:
                    cache, older = {}, cache
                here = [v for v in dict.fromkeys(parts) if v not in cache]
                cache.update((v, older[v]) for v in here if v in older)
                new = [v for v in here if v not in older]
                cache.update(zip(new, model.raw(new).tolist()))
                # What the parts of words tell that tell something, with a number for each different one.
                tells = np.fromiter(map(cache.__getitem__, parts), float, len(parts))
                some, ids = np.flatnonzero((tells > 0) & (np.fromiter(map(len, parts), np.int64, len(parts)) >= ORDER)), {}
                number = np.fromiter((ids.setdefault(parts[i], len(ids)) for i in some.tolist()), np.int64, len(some))
                n_known = np.bincount(np.repeat(np.arange(len(words)), n_parts)[some], minlength=len(words))
                flat = np.stack([number, tells[some]], 1)
                # Places of words that tell something, with their segments and what these tell.
                places = np.flatnonzero(n_known[inverse] > 0)
                rows = np.searchsorted(at, places, "right") - 1
                of = inverse[places]
                took = gather(flat, (np.cumsum(n_known) - n_known)[of], n_known[of])
                rows = np.repeat(rows, n_known[of])
                # Insults spelled out with blanks: runs of words of one character, within a row.
                single = length == 1
                single[single] = [words[i].isalnum() for i in np.flatnonzero(single).tolist()]
                single = single[inverse]
                of_word = np.repeat(np.arange(len(at) - 1), np.diff(at))
                joins = single[1:] & single[:-1] & (of_word[1:] == of_word[:-1])
                a, e = np.flatnonzero(single & ~np.concatenate([[False], joins])[: len(single)]), np.flatnonzero(single & ~np.concatenate([joins, [False]])[: len(single)]) + 1
                more = []
                for i in np.flatnonzero(e - a >= ORDER).tolist():
                    row, own = int(of_word[a[i]]), windows("".join(words[k] for k in inverse[a[i] : e[i]].tolist()))
                    more += [(row, ids.setdefault(v, len(ids)), x) for v, x in zip(own, model.raw(own).tolist()) if x > 0]
                extra = np.array(more).reshape(-1, 3)
                best.append(best_of(np.concatenate([rows, extra[:, 0].astype(np.int64)]), np.concatenate([took[:, 0], extra[:, 1]]), np.concatenate([took[:, 1], extra[:, 2]]), len(at) - 1))
            raw = np.concatenate(best) if best else np.zeros((0, BEST))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(model.probability(model.pooled(raw)))], [*t.schema.names, name])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_TEXTS) -> Model:
    """A model fitted on :func:`training_rows`, in one task: their number is bounded, and the driver gets the model only."""

    def run(batches):
        rows = sorted((t, int(y)) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for t, _ in rows], [y for _, y in rows]))], pa.binary())], ["model"])

    # The model is kept in the shared folder, so that a lost executor does not cost a second fit.
    fitted = cut(training_rows(docs, labels, most).repartition(1).mapInArrow(run, "model binary"), "toxicity-model").collect()
    return pickle.loads(fitted[0].model) if fitted else fit([], [])


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with all its columns (none called ``name``) and the score of ``text`` as ``name``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(scorer(held, docs.columns.index("text"), name), schema)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text).

    score is the probability of label 1; predicted is 1 from ``threshold`` on.
    held_out tells that crc32(doc_id as text) mod 3 is 1 (false for a null
    doc_id).  Null and empty texts get the score of a text without any
    telling word; repeated rows stay repeated; other columns are ignored; an
    empty table gives an empty result.
    """
    scored = with_score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
