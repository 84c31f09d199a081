"""Toxicity by a support vector machine on a gap-weighted subsequence kernel.

A text is read as words of folded symbols: letters in lower case, digits that
stand for letters beside them, marks inside a word dropped, runs of single letters joined,
each word opened by a start sign. Letters outside Latin are dealt to ``OTHER`` symbols by
a hash of the code point. Two words are alike by the subsequences of ``ORDER`` symbols they
share, each step at most ``REACH`` symbols long and each skipped symbol costing a factor
``DECAY`` - so inserted characters only weaken a match. A Nystroem map on landmark words
makes the machine linear; and because the kernel is a product of explicit subsequence
counts, the sum over landmarks folds into one weight for each subsequence, so that whole
texts are scored by table look-ups.

The labels are those of whole texts. Words are first taken as toxic by the stretches that
they hold: one that toxic texts hold ``TELLING`` times as often as others, by the lower
bound of its odds, whatever the language and however rare. The machine learns those words
against words of the other texts, each as far as its stretch is a mark of toxic texts. A text is
then judged by how many of its words the machine finds toxic, how toxic the worst is, and
how dense they are: one insult that clean texts never hold is enough, a stem that clean
texts hold now and then must come often. That step is logistic, learnt from the labelled
texts, and gives the score.

The fit reads at most ``FIT_ROWS`` distinct toxic and ``2 * FIT_ROWS`` distinct other
labelled texts, those with the smallest hashes, of at most ``FIT_CHARS`` code points for
either kind. A text labelled both ways is toxic. Null texts count as empty; a text without
words has the lowest score. Without both kinds of label, or without a word in any toxic
text, every score is 0. Repeated rows repeat; a null doc_id isn't held out, and no label
belongs to it.
"""

from __future__ import annotations

import gc
import hashlib
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, release, slices, spread, table, texts_of

#: Most toxic labelled texts that the fit reads, and half the most others; most code points of either kind.
FIT_ROWS, FIT_CHARS = 2000, 1 << 25
ORDER, REACH, DECAY = 4, 2, 0.8
LANDMARKS = 240
#: A stretch tells if its odds are this many times even, less so many deviations.
TELLING, DEVIATIONS = 6.0, 3.5
#: Word margins above which a text's words are counted.
CUTS = (-0.4, 0.0, 0.5, 0.95)
#: Symbols: 0 between words, 1 the start of a word, 2-27 letters, 28-34 accented letters by base, then other letters by a hash.
OTHER = 13
SYMBOLS = 35 + OTHER
_BREAK, _DROP = 255, 254
_LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
STEPS = list(product(range(1, REACH + 1), repeat=ORDER - 1))


def _other(units):
    """Symbols of letters outside Latin."""
    return 35 + (np.asarray(units, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(OTHER)


def _fold() -> np.ndarray:
    out = np.full(0x3003, _DROP, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c.isspace():
            out[i] = _BREAK
        elif c.isalpha():
            plain = unicodedata.normalize("NFKD", c.lower())[0]
            if c.lower() == plain and "a" <= plain <= "z":
                out[i] = ord(plain) - 95
            elif plain in "aeiounc":
                out[i] = 28 + "aeiounc".index(plain)
            else:
                out[i] = ord(plain) - 95 if "a" <= plain <= "z" else _other(i)
    out[0x3000:] = _BREAK  # space and stops of wide scripts
    return out


FOLD = _fold()
LOOKS = np.array([ord(_LOOKS_LIKE[chr(i)]) - 95 if chr(i) in _LOOKS_LIKE else 0 for i in range(128)], np.uint8)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One stream of the words of all texts, where each word begins (its 0), and its text."""
    units = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    raw = np.where(units < len(FOLD), FOLD[np.minimum(units, len(FOLD) - 1)], _other(units)).astype(np.uint8)
    # Digits and signs are letters where a letter stands beside them (signs: follows them).
    sign = np.flatnonzero((units < 128) & (LOOKS[np.minimum(units, 127)] > 0))
    follows = raw[np.minimum(sign + 1, len(raw) - 1)] < SYMBOLS
    beside = follows | ((units[sign] >= 48) & (units[sign] < 58) & (raw[np.maximum(sign - 1, 0)] < SYMBOLS))
    sign = sign[beside]
    raw[sign] = LOOKS[units[sign]]
    at = np.flatnonzero(raw != _DROP)
    raw = raw[at]
    edge = np.diff((raw != _BREAK).astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = last - first
    text = np.searchsorted(begins, at[first], side="right") - 1
    joined = np.zeros(len(first), bool)
    joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1])
    ends = np.cumsum(size + np.where(joined, 0, 2))
    starts = ends - size
    out = np.zeros((ends[-1] if len(ends) else 0) + 1 + ORDER * REACH, np.uint8)
    own = ~joined
    out[starts[own] - 1] = 1
    out[np.repeat(starts - first, size) + np.flatnonzero(raw != _BREAK)] = raw[raw != _BREAK]
    return out, starts[own] - 2, text[own]


def grams(stream: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pattern of steps, the code of the subsequence from each place, and its weight."""
    wide = stream.astype(np.int32)
    n = len(wide) - ORDER * REACH
    pairs = [wide[: len(wide) - d] * SYMBOLS + wide[d:] for d in range(1, REACH + 1)]
    high = [p[:n] * SYMBOLS**2 for p in pairs]
    for a, b, c in STEPS:
        yield high[a - 1] + pairs[c - 1][a + b : a + b + n], DECAY ** (a + b + c - ORDER + 1)


def margins(stream: np.ndarray, begins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's subsequences."""
    if not len(begins):
        return np.zeros(0)
    total = np.zeros(len(stream) - ORDER * REACH, np.float32)
    for code, decay in grams(stream):
        total += weights[code] * np.float32(decay)
    return np.add.reduceat(total, begins)


def _stream(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The stream of given words (each with its start sign)."""
    data = b"".join(b"\0" + w for w in words) + bytes(1 + ORDER * REACH)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    return np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes


def words_of(text: str) -> set[bytes]:
    """Distinct folded words of a text, each with its start sign."""
    stream, begins, _ = symbols([text])
    return set(stream[: len(stream) - ORDER * REACH].tobytes().split(b"\0")) - {b""} if len(begins) else set()


def subsequences(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and unit-norm counts of a word's subsequences: the kernel's explicit features."""
    stream, _ = _stream([word])
    codes, counts = [], []
    for code, decay in grams(stream):
        for i, x in enumerate(code):
            d = [x // SYMBOLS**k % SYMBOLS for k in range(ORDER)]
            if all(d) and 1 not in d[:-1] and i < len(word) + 1:
                codes.append(x)
                counts.append(decay)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0)
    found, inverse = np.unique(codes, return_inverse=True)
    sums = np.bincount(inverse, weights=counts)
    return found, sums / np.sqrt((sums * sums).sum())


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Likeness of words to landmarks, a row for each word."""
    stream, begins = _stream(words)
    weights = np.zeros(SYMBOLS**ORDER, np.float32)
    out = np.zeros((len(words), len(landmarks)))
    for j, mark in enumerate(landmarks):
        codes, counts = subsequences(mark)
        weights[codes] = counts
        out[:, j] = margins(stream, begins, weights)
        weights[codes] = 0
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine of squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return float((penalty * w * w).sum() + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    for _ in range(40):
        inside = y * (x @ w) < 1
        own, c = x[inside], cost[inside]
        grad = penalty * w - own.T @ (c * (y[inside] - own @ w))
        step = np.linalg.solve((own * c[:, None]).T @ own + np.diag(penalty), grad)
        rate, now = 1.0, loss(w)
        while rate > 1e-3 and loss(w - rate * step) > now:
            rate /= 2
        if rate <= 1e-3 or now - loss(w - rate * step) < 1e-7 * now:
            break
        w = w - rate * step
    return w[:-1], float(w[-1])


def _variants(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with a symbol inserted at two places, and with one doubled."""
    if len(word) < 6:
        return []
    i, j, k = rng.integers(2, len(word) - 1, 3)
    put = lambda at: word[:at] + bytes([int(rng.integers(2, 28))]) + word[at:]
    return [put(i), put(k), word[:j] + word[j : j + 1] + word[j:]]


def _judged(worst: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the logistic step reads: the worst margin, and for each cut how many words lie above it and how densely."""
    dense = counts / np.maximum(words, 1)[:, None]
    return np.column_stack([np.clip(worst, -2, 2), np.log1p(counts), np.log1p(100 * dense), np.ones(len(worst))])


@dataclass
class Model:
    """The machine (landmarks and their shares, folded into a weight for each subsequence, and a bias) and the logistic step."""

    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    landmarks: tuple[bytes, ...] = ()
    shares: tuple[float, ...] = ()
    judge: np.ndarray | None = None
    _table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}  # a worker spreads the weights out itself

    def word_margins(self, stream: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(SYMBOLS**ORDER, np.float32)
            self._table[self.codes] = self.values
        return margins(stream, begins, self._table) + np.float32(self.bias)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each whole text its worst word margin (-2 without words), words above each cut, and words."""
        worst, counts, words = np.full(len(texts), -2.0), np.zeros((len(texts), len(CUTS))), np.zeros(len(texts))
        for a, b in slices([len(t) + 1 for t in texts]):
            stream, begins, text = symbols(texts[a:b])
            if len(begins):
                value = self.word_margins(stream, begins)
                first = np.flatnonzero(np.diff(text, prepend=-1))
                at = a + text[first]
                worst[at] = np.maximum.reduceat(value, first)
                words[at] = np.diff(np.append(first, len(text)))
                for k, cut in enumerate(CUTS):
                    counts[at, k] = np.add.reduceat((value > cut).astype(np.int64), first)
        return worst, counts, words

    def score(self, texts: list[str]) -> np.ndarray:
        if self.judge is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(_judged(*self.read(texts)) @ self.judge, -40, 40)))


def _spread_out(words: list[bytes], n: int) -> list[bytes]:
    """Up to n words, in their order, none nearly like an earlier one."""
    found: list[bytes] = []
    for at in range(0, len(words), 200):
        part = [w for w in words[at : at + 200] if len(subsequences(w)[0])]
        if not part or len(found) >= n:
            continue
        inner = kernel(part, part)
        norm = np.sqrt(np.maximum(np.diag(inner), 1e-9))
        near = kernel(part, found).max(1) if found else np.zeros(len(part))
        for i, w in enumerate(part):
            if near[i] < 0.85 * norm[i] and len(found) < n:
                found.append(w)
                near = np.maximum(near, inner[:, i])
    return found


def _families(texts: list[str]) -> list[int]:
    """Number of the family of each text: texts that share a smallest hash of four words are near copies of one."""
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    seen: list[dict[bytes, int]] = [{} for _ in range(4)]
    for i, t in enumerate(texts):
        words = t.split()
        least = [b"\xff" * 9] * len(seen)
        for j in range(max(1, len(words) - 3)):
            run = hashlib.blake2b(" ".join(words[j : j + 4]).encode("utf-8", "surrogatepass"), digest_size=32).digest()
            least = [min(m, run[8 * k : 8 * k + 8]) for k, m in enumerate(least)]
        for own, key in zip(seen, least, strict=True):
            root[top(i)] = top(own.setdefault(key, i))
    return [top(i) for i in range(len(texts))]


def _parts(word: bytes) -> set[bytes]:
    return {word[i : i + ORDER] for i in range(len(word) - ORDER + 1)}


def _telling_words(toxic: Counter, clean: Counter) -> list[tuple[bytes, float, list[bytes]]]:
    """First guess of the toxic words, in groups of one stretch of symbols each, with the share of toxic texts among those that hold it.

    The counts are of texts that hold a word.

    Stretches are taken one by one, the most telling first; the words that hold one are then
    explained, so that their other stretches (a common ending, say) don't seem telling.
    """
    words = sorted(toxic)
    number: dict[bytes, int] = {}
    flat, ends = array("i"), array("i", [0])
    for w in words:
        flat.extend(sorted(number.setdefault(g, len(number)) for g in _parts(w)))
        ends.append(len(flat))
    flat, ends = np.array(flat, np.int32), np.array(ends, np.int64)
    held = lambda i: flat[ends[i] : ends[i + 1]]  # noqa: E731  stretches of a word
    times = np.array([toxic[w] for w in words], np.float64)
    hot = np.bincount(flat, np.repeat(times, np.diff(ends)), len(number))
    cold = np.zeros(len(number))
    order = np.argsort(flat, kind="stable")
    holders, begins = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends))[order], np.searchsorted(flat[order], np.arange(len(number) + 1))
    for w, n in clean.items():
        for g in _parts(w):
            if (k := number.get(g)) is not None:
                cold[k] += n
    base = np.log((sum(clean.values()) + 1) / (sum(toxic.values()) + 1))
    odds = lambda n, m: base + np.log((n + 0.1) / (m + 0.5))
    found, open_ = [], np.ones(len(words), bool)
    while len(hot):
        low = odds(hot, cold) - DEVIATIONS * np.sqrt(1 / (hot + 0.5) + np.where(cold > 0, 1 / (cold + 0.5), 0))
        best = int(low.argmax())
        if hot[best] < 2 or low[best] < np.log(TELLING):
            return found
        share = (hot[best] + 0.1) / (hot[best] + cold[best] + 0.1)
        group = [i for i in holders[begins[best] : begins[best + 1]].tolist() if open_[i]]
        for i in group:
            open_[i] = False
            hot[held(i)] -= times[i]
        hot[best] = 0
        good = [words[i] for i in group if odds(toxic[words[i]], clean[words[i]]) > 0]
        if good:
            found.append((next(g for g, k in number.items() if k == best), float(share), sorted(good, key=lambda w: (-toxic[w], w))))
    return found


def _worst_words(texts: list[str], toxic: Counter, clean: Counter) -> list[tuple[bytes, float, list[bytes]]]:
    """Where nothing tells: the word of each toxic text that is most often in toxic ones."""
    worst = sorted({max(bag, key=lambda w: ((toxic[w] + 0.1) / (clean[w] + 0.5), w)) for bag in map(words_of, texts) if bag})
    return [(w, (toxic[w] + 0.1) / (toxic[w] + clean[w] + 0.1), [w]) for w in worst]


def _logistic(x: np.ndarray, label: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a ridge logistic regression, by damped Newton steps; the last column is constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - label) + penalty * w)
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[str], other: list[str], rounds: int = 2) -> Model:
    """A model from labelled texts."""
    rng = np.random.default_rng(3)
    # Near copies count once, else each of their chance words would seem telling.
    families, hot = _families(toxic), Counter()
    for family in sorted(set(families)):
        hot.update(set().union(*(words_of(t) for t, f in zip(toxic, families, strict=True) if f == family)))
    if not other or not hot:
        return Model()
    clean = Counter(w for t in other for w in words_of(t))
    groups = _telling_words(hot, clean) or _worst_words(toxic, hot, clean)
    # The first of each stretch, the second of each, and so on: no language or insult takes all landmarks.
    positive = list(dict.fromkeys(w for turn in zip_longest(*[own for _, _, own in groups]) for w in turn if w is not None))
    share = {w: p for _, p, own in groups for w in own}
    # Words of the other texts that hold such a stretch are no counterexamples: its share speaks for them.
    stretches = {g for g, _, _ in groups}
    ordinary = [w for w in sorted(clean, key=lambda w: (-clean[w], w)) if not any(g in w for g in stretches)]
    hard = rng.choice(len(ordinary), min(len(ordinary), 3000), replace=False) if ordinary else []
    against = {ordinary[i] for i in hard} | set(ordinary[:500])
    model = Model()
    for _ in range(rounds):
        sure = [w for w in positive if share[w] > 0.98]
        extra = [v for w in sure[:400] for v in _variants(w, rng)]
        extra = [v for v in extra if v not in clean]
        negative = sorted(against - set(positive))
        marks = _spread_out(positive, LANDMARKS * 3 // 5)
        if model.landmarks and negative:
            negative = [negative[i] for i in np.argsort(-model.word_margins(*_stream(negative)), kind="stable")]
        marks += _spread_out(negative, LANDMARKS - len(marks))
        if not marks:
            return Model()
        gram = kernel(marks, marks)
        scale = np.sqrt(np.diag(gram))
        inner = (gram / scale[:, None] + (gram / scale[:, None]).T) / 2  # of unit-norm words
        value, vector = np.linalg.eigh(inner)
        held = value > 1e-6 * value.max()
        whiten = vector[:, held] / np.sqrt(value[held])
        # A word of share p is an example of either kind, by its share: its margin tends to 2 p - 1.
        words = positive + extra + negative + positive
        y = np.array([1.0] * (len(positive) + len(extra)) + [-1.0] * (len(negative) + len(positive)))
        own = np.array([share[w] for w in positive])
        cost = 4 * np.concatenate([own, np.ones(len(extra) + len(negative)), 1 - own])
        w, bias = _machine(kernel(words, marks) @ whiten, y, cost)
        alpha = whiten @ w
        weights = np.zeros(SYMBOLS**ORDER, np.float32)
        for a, mark in zip(alpha, marks, strict=True):
            codes, counts = subsequences(mark)
            weights[codes] += a * counts
        codes = np.flatnonzero(weights)
        model = Model(codes, weights[codes].astype(np.float32), bias, tuple(marks), tuple(map(float, alpha)))
        if ordinary:
            value = model.word_margins(*_stream(ordinary))
            against |= {ordinary[i] for i in np.argsort(-value, kind="stable")[:2000] if value[i] > -0.9}
    # Texts with one insult that has an inserted symbol stand for toxic texts as well, so that the step leaves room for
    # them: those insults that are worse than the worst words of all but one in a hundred other texts.
    bad, good = model.read(toxic), model.read(other)
    x = [_judged(*bad), _judged(*good)]
    label = [np.ones(len(toxic)), np.zeros(len(other))]
    clear = [v for v, value in zip(extra, model.word_margins(*_stream(extra)), strict=True) if value > np.quantile(good[0], 0.99)] if extra else []
    if clear:
        chosen = [clear[i] for i in rng.integers(0, len(clear), len(toxic) // 3 + 1)]
        value, host = model.word_margins(*_stream(chosen)), rng.integers(0, len(other), len(chosen))
        worst, counts, words = (part[host] for part in good)
        x.append(_judged(np.maximum(worst, value), counts + (value[:, None] > np.array(CUTS)), words + 1))
        label.append(np.ones(len(chosen)))
    model.judge, model._table = _logistic(np.concatenate(x), np.concatenate(label)), None
    return model


def _learnable(df: DataFrame) -> DataFrame:
    return df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[list[str], list[str]]:
    """Distinct toxic and other labelled texts of rows that may be learnt from; at most ``rows`` and twice as many, and ``chars`` each."""
    own = _learnable(labels).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = _learnable(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("h", F.xxhash64("text"))
    keys = texts.select("doc_id", "h", F.length("text").alias("n")).join(own, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.max("n").alias("n"))
    chosen = {}
    for toxic, n in ((1, rows), (0, 2 * rows)):
        total = 0
        for r in keys.where(F.col("toxic") == toxic).orderBy("h").limit(n).collect():
            total += r.n
            if total <= chars or total == r.n:
                chosen[r.h] = toxic
    if not chosen:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(h,) for h in sorted(chosen)], "h long")
    found = texts.join(F.broadcast(wanted), "h").dropDuplicates(["h"]).select("h", "text").collect()
    found = {r.h: r.text for r in found}
    gc.collect()
    release()
    return tuple([found[h] for h in sorted(chosen) if chosen[h] == toxic] for toxic in (1, 0))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(texts_of(batch["text"])), pa.float64())], ["doc_id", "score"])
        model._table = None

    return spread(docs.select("doc_id", "text")).transform(mapped, run, "doc_id long, score double")


def clean_documents(docs: DataFrame, model: Model, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """The given columns (text among them) of the rows whose score is below the threshold."""
    schema = docs.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(texts_of(batch["text"])) < threshold))
        model._table = None

    return spread(docs.select(*columns)).transform(mapped, run, schema)


def learnt(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled texts; the driver's memory of the fit is given back."""
    model = fit(*training_texts(docs, labels))
    gc.collect()
    release()
    return model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every whole document by a model of the learnable rows."""
    docs = table(spark, sf_dir, "documents")
    model = learnt(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
