"""Toxicity by a support vector machine with a gapped subsequence string kernel and Nyström landmarks.

The kernel of two strings sums, over every triple of letters that both hold in order within a window of SPAN
characters, the product of DECAY^(characters spanned), and is normalised to 1 for a string with itself.
Marks and inserted characters only stretch the span, so "i.d.i.o.t", "idxiot" and "i d i o t" stay near
"idiot". Strings are the units of a sentence: its words, and each run of three or more single letters joined.
Besides, the letters of each run of neighbouring words of a document, of REACH letters at most, are a string
without the white space, line ends and marks between and inside the words ("id iot", "i. d. i. o. t.",
"i---d---i---o---t"); such a run counts if it is on the toxic side. All runs are looked at: sums of the triples'
weights over a text's letters bound each run's value from above, and the runs whose bound passes are scored.
A sentence's value is that of its highest string.

The machine is trained on labelled sentences, each with its document's label, though a sentence of a toxic
document need not be toxic. The documents are parted in two folds. A sentence
of one fold's toxic documents counts as toxic only if the other fold, which has not seen its document, gives one of
its strings (a word, a spelled run, or a phrase) a value that hardly any clean text of its own fold reaches: first
by a guess (how much more often toxic texts hold the string than clean ones, in standard errors), then by the
machine trained on the other fold's sentences, which knows strings near to those it was trained on, too.
These strings, the sentences' witnesses,
are the landmarks of the Nyström features (whitened kernels with them) and the positive rows; all strings of clean
sentences are negative, and of these the hardest are chosen anew in each round, with runs of clean documents that
come near the toxic side. Pairs and triples of words that are each as frequent in clean documents, but together
are not, are strings, too.
A document's score is the logistic value of its highest sentence.

As the decision is linear in the triples of a unit, landmarks and machine fold into one weight for each triple.

Defined results: null text counts as empty, and has the least score; without labels of both kinds, or without
any sentence that tells them apart, every score is 0 and predicted 0; repeated rows score alike. Other columns are
never read. Fitting reads at most DOCUMENTS rows and BYTES bytes of text of each label (bounds on the sample,
parameters of ``fit``); scoring reads every row and every word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import release
from logsieve.llm.folds import held_out, labelled

DOCUMENTS = 2500
BYTES = 24 << 20
LANDMARKS = 256
DECAY, SPAN = 0.7, 7
#: Longer units are cut into overlapping pieces of this many characters; a unit's value is the highest of its pieces.
PIECE = 48
#: Bytes of the memo of one task, which holds units with their values, as reckoned by 150 bytes for each and its own.
MEMO_BYTES = 96 << 20
#: Of a fold's clean texts, the share that may hold a string above a witness.
RARE = 0.02
#: Standard errors from which a first guess is taken for more than chance.
CHANCE = 3.0
#: Clean units that the machine is first trained on; each round adds a quarter as many of those it scores highest.
NEGATIVES = 16_000
#: Letters of a run of words.
REACH = 24
#: Letters whose triples are summed up at a time.
LETTERS = 1 << 19
#: Units whose triples are laid out at a time.
ROWS = 500
_ALPHABET = 64
_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)|\n")
_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")
_CODES = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {d: ord(c) - 96 for d, c in zip("01345$@", "oieassa", strict=False)}


def _pairs() -> list[tuple[int, int]]:
    return [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def _code(c: str) -> int:
    return _CODES.get(c) or (27 + ord(c) % 37 if c.isalpha() else 0)


def letters(word: str) -> str:
    """A word in lower case without its marks."""
    word = word.lower()
    return word if word.isascii() and word.isalpha() else "".join(c for c in word if _code(c))


def codes(units: list[str]) -> np.ndarray:
    """Letters as numbers from 1 to 63, marks as 0; one row for each unit, filled up with 0."""
    width = max((len(u) for u in units), default=1)
    known = {c: _code(c) for c in set("".join(units))}
    out = np.zeros((len(units), width + SPAN), np.int32)
    for i, u in enumerate(units):
        out[i, : len(u)] = [known[c] for c in u]
    return out


def triples(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Triple numbers of each unit and their weights (0 where there is none); equal triples stand apart."""
    x = codes(units)
    n = x.shape[1] - SPAN
    a = x[:, :n]
    number, weight = [], []
    for j, k in _pairs():
        b, c = x[:, j : j + n], x[:, k : k + n]
        number.append((a * _ALPHABET + b) * _ALPHABET + c)
        weight.append(np.where((a > 0) & (b > 0) & (c > 0), DECAY ** (k + 1), 0.0).astype(np.float32))
    return np.concatenate(number, 1), np.concatenate(weight, 1)


def _merged(number: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal triples of a row added up at the last of them; weights scaled to length 1."""
    order = np.argsort(number, axis=1)
    s, w = np.take_along_axis(number, order, 1), np.take_along_axis(weight, order, 1).astype(np.float64)
    total = np.cumsum(w, 1)
    last = np.ones(s.shape, bool)
    last[:, :-1] = s[:, 1:] != s[:, :-1]
    before = np.zeros_like(total)
    marked = np.where(last, total, 0.0)
    before[:, 1:] = np.maximum.accumulate(marked, 1)[:, :-1]
    own = np.where(last, total - before, 0.0)
    size = np.sqrt((own * own).sum(1, keepdims=True))
    return s, own / np.where(size > 0, size, 1)


class Model:
    """One weight for each triple, and the logistic values' slope and place."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0, slope: float = 1.0, place: float = 0.0):
        self.weights, self.bias, self.slope, self.place = weights, bias, slope, place

    def units(self, units: list[str]) -> np.ndarray:
        """Value of each unit."""
        return np.concatenate([np.zeros(0), *(self._units(units[i : i + 20_000]) for i in range(0, len(units), 20_000))])

    def _units(self, units: list[str]) -> np.ndarray:
        pieces, of = [], []
        for i, u in enumerate(units):
            for a in range(0, max(1, len(u) - SPAN), PIECE - SPAN):
                pieces.append(u[a : a + PIECE].lower())
                of.append(i)
        by_size = np.argsort([len(p) for p in pieces], kind="stable")
        of, value = np.array(of, np.int64), np.zeros(len(pieces))
        for at in np.array_split(by_size, max(1, -(-len(by_size) // ROWS))):
            s, w = _merged(*triples([pieces[i] for i in at]))
            value[at] = (self.weights[s] * w).sum(1)
        top = np.full(len(units), -np.inf)
        np.maximum.at(top, of, value)
        return self.bias + np.where(np.isfinite(top), top, 0.0)

    def runs(self, words: list[str], which: np.ndarray, bounds: np.ndarray, floor: np.ndarray) -> tuple[list[int], list[str]]:
        """Runs of neighbouring words whose letters may have a value above their document's ``floor``: documents and strings.

        ``words`` are distinct ones, ``which`` their numbers in the order of the text, ``bounds`` where documents begin.
        A run's weights add up to those of the triples inside it; its length is at least that of its triples taken apart.
        """
        held = [letters(w) for w in words]
        known = {c: _code(c) for c in set("".join(held))}
        coded = [bytes(known[c] for c in w[: REACH + 1]) for w in held]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        pool, begin = np.frombuffer(b"".join(coded), np.uint8), np.cumsum(size) - size
        kept = np.flatnonzero(size[which] > 0)
        word, doc = which[kept], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[kept]
        total = np.cumsum(size[word])
        least = np.sqrt([max(1e-9, sum((k - 1) * max(0, n - k) * DECAY ** (2 * k + 2) for k in range(2, SPAN))) for n in range(REACH + 1)])
        table = self.weights.astype(np.float32)
        docs, strings, a = [], [], 0
        while a < len(word):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LETTERS)))
            mine, of = word[a : b + REACH], doc[a : b + REACH]
            n = size[mine]
            end = np.cumsum(n)
            start = end - n
            x = np.zeros(end[-1] + SPAN, np.int32)
            x[: end[-1]] = pool[np.repeat(begin[mine] - start, n) + np.arange(end[-1])]
            sums = []
            for k in range(2, SPAN):
                outer = x[: end[-1]] * _ALPHABET**2 + x[k : k + end[-1]]
                own = sum(table[outer + x[j : j + end[-1]] * _ALPHABET] for j in range(1, k))
                sums.append(np.concatenate([[0.0], np.cumsum(own, dtype=np.float64) * DECAY ** (k + 1)]))
            first = np.arange(min(b, len(word)) - a)
            for m in range(REACH):
                first = first[first + m < len(mine)]
                length = end[first + m] - start[first]
                fits = (length <= REACH) & (of[first + m] == of[first])
                first, length = first[fits], length[fits]
                if not len(first):
                    break
                s, e = start[first], end[first + m]
                value = sum(c[np.maximum(e - k, s)] - c[s] for k, c in enumerate(sums, 2))
                for i in first[(value > 0) & (self.bias + value / least[length] + 1e-4 > floor[of[first]])]:
                    docs.append(int(of[i]))
                    strings.append("".join(held[w] for w in mine[i : i + m + 1]))
            a = b
        return docs, strings

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (value - self.place), -40, 40)))


def spelled(text: str) -> list[str]:
    """Runs of three or more single characters, each run as one unit."""
    return [re.sub(r"\s+", "", m[0]) for m in _SPELLED.finditer(text)]


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts, their numbers in the order of the texts, and where each text begins."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()


def phrases(texts: list[str], toxic: np.ndarray) -> list[tuple[str, int, int]]:
    """Pairs and triples of words that toxic texts hold far more often than clean ones while none of their words does: letters, and the texts of either label that hold them."""
    words, which, bounds = _words(pa.array(texts, pa.large_string()))
    number: dict[str, int] = {}
    which = np.array([number.setdefault(letters(w), len(number)) for w in words] or [0], np.int64)[which]
    of, names = np.repeat(np.arange(len(texts)), np.diff(bounds)), list(number)
    bad = toxic.astype(bool)
    ratio, out = bad.sum() / (~bad).sum(), []
    common = np.zeros(0, bool)
    for size in (1, 2, 3):
        last = max(0, len(which) - size + 1)
        at = np.flatnonzero(of[:last] == of[size - 1 :])
        if size > 1:
            at = at[np.logical_and.reduce([common[which[at + j]] for j in range(size)])]
        key = sum(which[at + j] * len(names) ** (size - 1 - j) for j in range(size))
        keys, key = np.unique(key, return_inverse=True)
        pair = np.unique(key * len(texts) + of[at])
        p, n = (np.bincount((pair // len(texts))[bad[pair % len(texts)] == side], minlength=len(keys)) for side in (True, False))
        excess = (p - n * ratio) / np.sqrt(np.maximum(1, p + n * ratio))
        if size == 1:
            common = np.zeros(len(names), bool)
            common[keys] = excess <= 3
            continue
        for i in np.flatnonzero((excess > 5) & (p >= 2)):
            text = "".join(names[int(keys[i]) // len(names) ** (size - 1 - j) % len(names)] for j in range(size))
            if 3 <= len(text) <= REACH:
                out.append((text, int(p[i]), int(n[i])))
    return out


def pieces(unit: str) -> list[str]:
    """Overlapping pieces of a long unit."""
    return [unit[a : a + PIECE] for a in range(0, max(1, len(unit) - SPAN), PIECE - SPAN)]


def sentence_units(text: str) -> list[list[str]]:
    """Units of each sentence, long ones in pieces."""
    return [[x for w in u for x in pieces(w)] for s in _SENTENCE.split(text) if s and (u := s.lower().split() + [x.lower() for x in spelled(s)])]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of least squared hinge loss, by Newton steps on the rows inside the margin."""
    n = z.shape[1] + 1
    b, ridge = np.zeros(n), np.eye(n)
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        inside = y * (z @ b[:-1] + b[-1]) < 1
        left, right = ridge.copy(), np.zeros(n)
        for rows in np.array_split(np.flatnonzero(inside), max(1, int(inside.sum()) // 2000)):
            x = np.hstack([z[rows], np.ones((len(rows), 1))])
            w = cost * weight[rows]
            left += x.T @ (w[:, None] * x)
            right += x.T @ (w * y[rows])
        new = np.linalg.solve(left, right)
        if np.allclose(new, b, atol=1e-6):
            break
        b = new
    return b[:-1], float(b[-1])


def _features(units: list[str], columns: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Whitened kernels of units with the landmarks, some units at a time: the triples' matrix is wide."""
    parts = [(_dense(units[i : i + ROWS], columns) @ white).astype(np.float32) for i in range(0, len(units), ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, white.shape[1]))


def _dense(units: list[str], columns: np.ndarray) -> np.ndarray:
    """Triples of units, of those in ``columns`` (sorted)."""
    s, w = _merged(*triples(units))
    out = np.zeros((len(units), len(columns) + 1))
    at = np.searchsorted(columns, s)
    at = np.where((at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == s), at, len(columns))
    np.add.at(out, (np.arange(len(units))[:, None], at), w)
    return out[:, :-1]


class _Sample:
    """Strings of labelled texts: their numbers in each text, and in each sentence of toxic texts."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.texts, self.toxic = texts, toxic
        self.number: dict[str, int] = {}
        extra = list(dict.fromkeys(x[0] for x in phrases(texts, toxic)))
        self.ids, self.bags = [], []
        for text, bad in zip(texts, toxic, strict=True):
            bag = [np.unique(np.array([self.number.setdefault(u, len(self.number)) for u in s], np.int32)) for s in sentence_units(text)]
            self.ids.append(np.unique(np.concatenate([np.zeros(0, np.int32), *bag])))
            self.bags.append(bag if bad else [])
        for x in extra:
            self.number.setdefault(x, len(self.number))
        # a phrase is a string of each sentence that holds it
        numbers = np.array([self.number[x] for x in extra], np.int32)
        for i, text in enumerate(texts) if extra else ():
            whole = letters(text)
            if any(x in whole for x in extra):
                held = np.array([x in whole for x in extra])
                self.ids[i] = np.union1d(self.ids[i], numbers[held])
                if self.bags[i]:
                    self.bags[i].append(numbers[held])
        self.units = list(self.number)
        # half of the texts of each label are of either fold
        self.fold = np.zeros(len(texts), np.int64)
        for label in (0, 1):
            mine = np.flatnonzero(toxic == label)
            self.fold[np.random.default_rng(label).permutation(mine)] = np.arange(len(mine)) % 2

    def clean(self, folds: tuple[int, ...]) -> np.ndarray:
        """Strings of clean texts of the folds."""
        mine = np.flatnonzero((self.toxic == 0) & np.isin(self.fold, folds))
        return np.unique(np.concatenate([np.zeros(0, np.int32), *(self.ids[i] for i in mine)]))

    def guess(self, fold: int) -> np.ndarray:
        """How much more often toxic texts of a fold hold each string than clean ones, in standard errors; chance finds nearly as many among rare strings."""
        mine = lambda label: [self.ids[i] for i in np.flatnonzero((self.toxic == label) & (self.fold == fold))]
        p, n = (np.bincount(np.concatenate([np.zeros(0, np.int32), *mine(label)]), minlength=len(self.units)) for label in (1, 0))
        ratio = len(mine(1)) / max(1, len(mine(0)))
        return (p - n * ratio) / np.sqrt(p + n * ratio**2 + 1)

    def values(self, model: Model) -> np.ndarray:
        return model.units(self.units)

    def witnesses(self, fold: int, value: np.ndarray, least: float) -> np.ndarray:
        """Of the sentences of a fold's toxic texts, the strings of highest value, one for each sentence, if that is above ``least`` and what nearly all clean texts of the fold hold."""
        bags = [b for i in np.flatnonzero((self.toxic == 1) & (self.fold == fold)) for b in self.bags[i] if len(b)]
        calm = [value[self.ids[i]].max() for i in np.flatnonzero((self.toxic == 0) & (self.fold == fold)) if len(self.ids[i])]
        bar = max(least, float(np.quantile(calm, 1 - RARE)) if calm else least)
        tops = np.array([b[np.argmax(value[b])] for b in bags], np.int64)
        return tops[value[tops] > bar] if len(tops) else tops


def _machine(sample: _Sample, found: np.ndarray, folds: tuple[int, ...], landmarks: int, rounds: int, r: np.random.Generator) -> Model:
    """The machine on witnesses against strings of clean sentences, over Nyström features; no weights where there is no witness."""
    chosen, held = np.unique(found, return_counts=True)
    strong = np.argsort(-held, kind="stable")
    keep = [i for i in strong if len(letters(sample.units[chosen[i]])) >= 3]
    if not keep:
        return Model()
    chosen, held = chosen[keep], held[keep]
    marks = [sample.units[i] for i in chosen[:landmarks]]
    columns = np.unique(_merged(*triples(marks))[0])
    base = _dense(marks, columns)
    values, vectors = np.linalg.eigh(base @ base.T)
    wide = values > 1e-3 * values.max()
    white = base.T @ (vectors[:, wide] / np.sqrt(values[wide]))  # from triples to whitened kernels with the landmarks
    clean = np.setdiff1d(sample.clean(folds), chosen)
    hard = r.permutation(clean)[:NEGATIVES]
    calm = [t for t, y, f in zip(sample.texts, sample.toxic, sample.fold, strict=True) if y == 0 and f in folds]
    words, near = _words(pa.array(calm, pa.large_string())), []
    zp, wp = _features([sample.units[i] for i in chosen], columns, white), np.minimum(held, 200.0)
    for i in range(rounds):
        zn = _features([*(sample.units[i] for i in hard), *near], columns, white)
        y = np.concatenate([np.ones(len(zp)), -np.ones(len(zn))])
        weights, bias = _svm(np.concatenate([zp, zn]), y, np.concatenate([wp / wp.mean(), np.ones(len(zn))]))
        model = Model(_fold(columns, white @ weights), bias)
        if i + 1 == rounds:
            break
        # the clean strings that come nearest to the toxic side join the negative ones
        every = model.units([sample.units[i] for i in clean])
        hard = np.union1d(hard, clean[np.argsort(-every, kind="stable")[: NEGATIVES // 4]])
        runs = sorted({x for x in model.runs(*words, np.full(len(calm), -0.5))[1] if x not in sample.number})
        runs = [runs[i] for i in np.argsort(-model.units(runs), kind="stable")[: NEGATIVES // 4]]
        near = sorted({*near, *runs})
    return model


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 3, seed: int = 0) -> Model:
    """A model from labelled texts."""
    if not len(toxic) or toxic.min() == toxic.max():
        return Model()
    sample, r = _Sample(texts, toxic), np.random.default_rng(seed)
    # a fold's sentences are judged by what the other fold teaches: first by a guess, then by the machine trained on it
    found = [sample.witnesses(f, sample.guess(1 - f), CHANCE) for f in (0, 1)]
    models = [_machine(sample, found[f], (f,), landmarks, 1, r) for f in (0, 1)]
    if all(m.weights is not None for m in models):
        found += [sample.witnesses(f, sample.values(models[1 - f]), 0.0) for f in (0, 1)]
    model = _machine(sample, np.concatenate(found), (0, 1), landmarks, rounds, r)
    if model.weights is None:
        return model
    every = model.units(sample.units)
    top = np.array([every[i].max() if len(i) else -1.5 for i in sample.ids])
    model.slope, model.place = _logistic(top, toxic)
    return model


def _fold(columns: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(_ALPHABET**3)
    out[columns] = w
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and place of the logistic curve through the values, both labels weighing as they occur."""
    a, b = 4.0, 0.0
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(a * (x - b), -40, 40)))
        ga = ((s - y) * (x - b)).mean() + 1e-4 * (a - 4)
        gb = -((s - y) * a).mean()
        h = s * (1 - s) + 1e-4
        a = float(np.clip(a - ga / max(1e-3, (h * (x - b) ** 2).mean()), 0.5, 20))
        b = float(np.clip(b - np.clip(gb / max(1e-3, (h * a * a).mean()), -0.2, 0.2), -2, 2))
    return a, b


class Scorer:
    """Highest unit of each text of a batch; a task's memo keeps units' values."""

    def __init__(self, model: Model):
        self.model, self.memo, self.held = model, {}, 0

    def _values(self, units: list[str]) -> np.ndarray:
        if self.held > MEMO_BYTES:
            self.memo, self.held = {}, 0
        new = [u for u in units if u not in self.memo]
        memo = self.memo
        memo.update(zip(new, self.model.units(new).tolist(), strict=True))
        out = np.fromiter(map(memo.__getitem__, units), float, len(units))
        self.held += sum(map(len, new)) + 150 * len(new)
        for u in new:
            if len(u) > 4 * PIECE and memo.pop(u, None) is not None:
                self.held -= len(u) + 150
        return out

    def tops(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lengths = pc.binary_length(texts).to_numpy()
        out, i = np.full(len(texts), -np.inf), 0
        sizes = np.cumsum(lengths)
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + (8 << 20))))
            part = texts.slice(i, j - i)
            words, which, bounds = _words(part)
            value = self._values([w.lower() for w in words])
            full = np.flatnonzero(np.diff(bounds))
            if len(which):
                out[i + full] = np.maximum.reduceat(value[which], bounds[:-1][full])
                single = np.fromiter((len(w) == 1 for w in words), bool, len(words))[which]
                run = single[:-2] & single[1:-1] & single[2:] if len(which) > 2 else np.zeros(0, bool)
                for d in np.unique(np.searchsorted(bounds, np.flatnonzero(run), side="right") - 1):
                    if joined := [x.lower() for x in spelled(part[int(d)].as_py())]:
                        out[i + d] = max(out[i + d], self._values(joined).max())
                docs, strings = self.model.runs(words, which, bounds, np.maximum(out[i:j], self.model.place))
                if docs:
                    value = self._values(strings)
                    toxic = value > self.model.place
                    np.maximum.at(out, i + np.array(docs)[toxic], value[toxic])
            i = j
        return np.where(np.isfinite(out), out, -1.5)


def fit(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS, most: int = BYTES) -> Model:
    """A model from training rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): at most ``documents`` rows and ``most`` bytes of text of each label, in the order of a hash."""
    chosen = F.broadcast(labelled(labels, "toxic", documents))
    rows = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.withColumn("lot", F.xxhash64("doc_id", "text"))
    # which rows fit is settled on their sizes, before any text is fetched
    taken: dict[int, int] = {}
    for label in (0, 1):
        sizes = rows.where(F.col("label") == label).select("lot", F.octet_length("text").alias("n")).distinct().orderBy("lot").limit(documents).collect()
        total = np.cumsum([r.n for r in sizes])
        taken |= {r.lot: label for r, n in zip(sizes, total, strict=True) if n <= most}
    wanted = docs.sparkSession.createDataFrame([(k,) for k in taken] or [(0,)], "lot long")
    found = rows.join(F.broadcast(wanted), "lot").dropDuplicates(["lot"]).select("doc_id", "text", "label").toPandas().sort_values(["doc_id", "text"])
    return train(found["text"].tolist(), found["label"].to_numpy()) if taken else Model()


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score double and predicted int; columns of those names are replaced, all others kept."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    if model.weights is None:
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(scorer.tops(b.column("text"))))], [*b.schema.names, "score"])
        scorer.memo = {}
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    out = docs.select(*kept).mapInArrow(run, f"{schema}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
