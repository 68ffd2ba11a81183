"""Language identification with interpolated Kneser-Ney character models.

Per language, a model of character n-grams up to ``ORDER`` is learned from words
(runs of letters, lower case) between a begin and an end mark. The n-grams of
all languages are kept per order as one sorted array of 64-bit hashes with a
column of interpolated probabilities per language; contexts likewise with their
back-off weights. A text's language is that of the lowest cross-entropy per
character. Its score is a calibrated probability of being right; a text whose
cross-entropy is out of the range of its language's calibration texts is
rejected.

Learning uses a bounded sample: per language the rows of smallest hash, at most
``SAMPLE_DOCS`` of them and ``SAMPLE_CHARS`` characters (whole texts), so the
model, which is broadcast, grows with the number of labels only. Prediction is a map over the input without a
shuffle; each distinct word is scored once as long as a bounded memo holds it.

Defined results: a text that is null or has no letter is ``und`` with score 0
and is rejected; without any labelled row every text is; of languages that tie
the first by name wins; rows without doc_id are predicted, but not learned from;
repeated rows are each predicted, and each count towards the sample; a text of any
length is read whole; an empty table gives an empty result and no model; other
columns pass through, the added ones take a free name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name
from .tokens import give_back, groups, texts_of

ORDER = 5
SAMPLE_DOCS, SAMPLE_CHARS = 400, 1_000_000
MEMO_LIMIT = 300_000
UNKNOWN = "und"
BEGIN, END = 2, 32
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W\d_]+")
#: Texts within SLACK times the range that covers this share of the rightly classified calibration texts are never rejected.
REACH = 0.98
SLACK = 1.5
LEAST_RANGE = 15.0


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each symbol of all marked words, symbols before it in its word, first place of each word)."""
    joined = "".join(f"\x02{w} " for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes), starts


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """out[k][i]: hash of the k symbols ending at i (out[0] is zero); beyond a word's begin it is not to be used."""
    out, power = [np.zeros(len(codes), np.uint64)], np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(1, order + 1):
            left = np.zeros(len(codes), np.uint64)
            left[k - 1 :] = codes[: len(codes) - k + 1] + np.uint64(1)
            out.append(out[-1] + left * power)
            power *= BASE
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in the sorted table, -1 where missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # per order from 1: sorted hashes
    probability: list[np.ndarray]  # per order: rows as grams, a column per language
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float  # probability of a character that no language has
    centre: np.ndarray | None = None  # calibration: cross-entropy's middle per language,
    spread: np.ndarray | None = None  # (of texts, of characters) per language,
    reach: float = LEAST_RANGE  # deviations within which texts are accepted,
    slope: tuple[float, float] = (0.0, 4.0)  # and the score's logistic curve

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Per word and language the summed log-probability of its symbols and end mark."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        codes, depth, starts = _symbols(words)
        hashes = _hashes(codes, len(self.grams))
        places = np.flatnonzero(depth > 0)
        p = np.empty((len(places), len(self.languages)), np.float32)
        weight = np.ones_like(p)
        todo = np.arange(len(places))
        for k in range(len(self.grams), 0, -1):  # from the longest n-gram down, as far as one is missing
            long = depth[places[todo]] >= k - 1
            here = todo[long]
            at = _find(self.grams[k - 1], hashes[k][places[here]])
            hit = here[at >= 0]
            p[hit] = weight[hit] * self.probability[k - 1][at[at >= 0]]
            miss = here[at < 0]
            before = _find(self.contexts[k - 1], hashes[k - 1][places[miss] - 1]) if k > 1 else np.zeros(len(miss), np.int64)
            known = before >= 0
            weight[miss[known]] *= self.backoff[k - 1][before[known]]
            todo = np.concatenate((todo[~long], miss))
        p[todo] = weight[todo] * self.floor
        out = np.log(p)
        first = starts - np.arange(len(starts))  # begin marks aren't predicted
        return np.add.reduceat(out, first, axis=0)

    def decide(self, total: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language's place, score, rejected) from summed log-probabilities and counts of symbols."""
        entropy = -total / np.maximum(symbols, 1)[:, None]
        best = entropy.argmin(axis=1)
        return best, 1 / (1 + np.exp(-np.clip(self.slope[0] * self._margin(entropy, symbols) + self.slope[1], -30, 30))), self._deviation(entropy, best, symbols) > self.reach

    @staticmethod
    def _margin(entropy: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        two = np.sort(entropy, axis=1)[:, :2]
        return (two[:, 1] - two[:, 0]) * np.sqrt(symbols) if entropy.shape[1] > 1 else np.sqrt(symbols)

    def _deviation(self, entropy: np.ndarray, best: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        texts, chars = self.spread[best, 0], self.spread[best, 1]
        return (entropy[np.arange(len(best)), best] - self.centre[best]) / np.sqrt(texts**2 + chars**2 / np.maximum(symbols, 1))


def _counted(words: Counter, order: int) -> list[dict[str, np.ndarray]]:
    """Per order the distinct n-grams: hash, adjusted count, hash of the context and of the shorter n-gram."""
    names = sorted(words)
    weights = np.array([words[w] for w in names], np.float64)
    codes, depth, _ = _symbols(names)
    hashes = _hashes(codes, order)
    weight = np.repeat(weights, [len(w) + 2 for w in names])
    out: list[dict[str, np.ndarray]] = []
    for k in range(order, 0, -1):
        at = np.flatnonzero((depth >= k - 1) & (depth > 0))
        gram, first, inverse = np.unique(hashes[k][at], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weight[at])
        if out:  # of what isn't at a word's begin, the different symbols before it are counted
            longer = out[-1]
            count = np.where(depth[at[first]] == k - 1, count, np.bincount(np.searchsorted(gram, longer["shorter"]), minlength=len(gram)))
        place = at[first]
        out.append({"gram": gram, "count": np.maximum(count, 1), "context": hashes[k - 1][place - 1] if k > 1 else np.zeros(len(place), np.uint64), "shorter": hashes[k - 1][place]})
    return out[::-1]


def train(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """A model of the languages' texts; see calibrate()."""
    languages = sorted(samples)
    counted = [_counted(Counter(chain.from_iterable(map(words_of, samples[name]))), order) for name in languages]
    model = Model(languages, [], [], [], [], 0.0)
    characters = np.unique(np.concatenate([c[0]["gram"] for c in counted]))
    model.floor = 1 / (len(characters) + 1)
    for k in range(order):
        gram, first = np.unique(np.concatenate([c[k]["gram"] for c in counted]), return_index=True)
        context = np.concatenate([c[k]["context"] for c in counted])[first]
        shorter = np.concatenate([c[k]["shorter"] for c in counted])[first]
        contexts = np.unique(context)
        seen, weight = np.zeros((len(gram), len(languages))), np.ones((len(contexts), len(languages)))
        for n, c in enumerate(counted):
            count, own = c[k]["count"], np.searchsorted(contexts, c[k]["context"])
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            total, kinds = np.bincount(own, count, len(contexts)), np.bincount(own, minlength=len(contexts))
            has = total > 0
            weight[has, n] = discount * kinds[has] / total[has]
            seen[np.searchsorted(gram, c[k]["gram"]), n] = np.maximum(count - discount, 0) / total[own]
        lower = model.probability[-1][np.searchsorted(model.grams[-1], shorter)] if k else model.floor
        model.grams.append(gram)
        model.contexts.append(contexts)
        model.backoff.append(weight.astype(np.float32))
        model.probability.append((seen + weight[np.searchsorted(contexts, context)] * lower).astype(np.float32))
    return model


def calibrate(model: Model, texts: list[tuple[str, str]]) -> None:
    """Fit the score's curve and the range of accepted cross-entropies to (language, text) pairs not trained on."""
    totals, sizes, truth, squares = [], [], [], []
    for name, text in texts:
        words = words_of(text)
        if words and name in model.languages:
            each = model.log_probabilities(words)
            totals.append(each.sum(axis=0))
            sizes.append(sum(map(len, words)) + len(words))
            truth.append(model.languages.index(name))
            own, length = -each[:, truth[-1]], np.array([len(w) + 1 for w in words])
            squares.append(float(np.mean((own - own.sum() / sizes[-1] * length) ** 2 / length)))
    count = len(model.languages)
    model.centre, model.spread = np.full(count, 3.0), np.full((count, 2), 1.0)
    if not totals:
        return
    symbols, real = np.array(sizes, float), np.array(truth)
    entropy = -np.array(totals, float) / symbols[:, None]
    right = entropy.argmin(axis=1) == real
    for n in range(count):
        mine = real == n if (real == n).any() else np.ones(len(real), bool)
        own = entropy[mine, n if (real == n).any() else 0]
        middle = float(np.median(own))
        model.centre[n] = middle
        told = mine & right if (mine & right).any() else mine
        model.spread[n] = max(0.1, 1.4826 * float(np.median(np.abs(own - middle)))), max(0.8, float(np.sqrt(np.mean(np.array(squares)[told]))))
    sound = right if right.any() else np.ones(len(real), bool)  # a wrong label or junk does not set the limit
    model.reach = max(LEAST_RANGE, SLACK * float(np.quantile(model._deviation(entropy, real, symbols)[sound], REACH, method="lower")))
    x, y = Model._margin(entropy, symbols), right.astype(float)
    slope, offset = 0.5, 0.0
    for _ in range(50):  # logistic regression, drawn a little towards the start: all may be right
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 0.5 * (slope - 0.5), (y - p).sum() - 0.5 * offset])
        h = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.5]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = max(0.0, slope + step[0]), offset + step[1]
    model.slope = (slope, offset)


def is_held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text leaves 2 on division by 4 are for testing only."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Learn from the labelled rows that aren't held out; None if there are none."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & ~is_held_out("doc_id"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row per label
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30))
    wanted = F.lit(False)  # about four times as many as are used, so that the window below is small whatever the input
    for name, n in counts:
        wanted = wanted | ((F.col("lang") == name) & (draw < int(min(1.0, 4 * sample_docs / n) * (1 << 30))))
    rows = rows.where(wanted).withColumn("size", F.length("text").cast("long"))
    by = Window.partitionBy("lang").orderBy(F.col("size") > sample_chars, draw, "doc_id", "text")  # a text that never fits is used only if all are such
    drawn = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= sample_docs)
    fits = lambda total, size: F.when(total + size <= sample_chars, total + size).otherwise(total)
    taken = F.aggregate(F.collect_list("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"), fits)
    drawn = drawn.withColumn("taken", taken).where((F.col("taken") + F.col("size") <= sample_chars) | (F.col("rank") == 1))
    drawn = drawn.withColumn("rank", F.row_number().over(by))
    samples: dict[str, list[str]] = {}
    checks: list[tuple[str, str]] = []
    for row in drawn.select("lang", "rank", "text").orderBy("lang", "rank").collect():
        if row["rank"] % 5 == 0:
            checks.append((row["lang"], row["text"]))
        else:
            samples.setdefault(row["lang"], []).append(row["text"])
    samples = {k: v for k, v in samples.items() if any(map(words_of, v))}
    if not samples:
        return None
    model = train(samples)
    calibrate(model, checks or [(k, t) for k, v in samples.items() for t in v])
    return model


class _Scorer:
    """Sums of texts' log-probabilities; remembers words."""

    def __init__(self, model: Model, limit: int = MEMO_LIMIT):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.value = np.zeros((1024, len(self.model.languages)), np.float32)

    def _places(self, flat: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if not missing:
            return at
        new = list(dict.fromkeys([flat[i] for i in missing]))
        if len(self.index) + len(new) > self.limit and self.index:
            self._forget()
            return self._places(flat)
        n, k = len(self.index), len(new)
        while n + k > len(self.value):
            self.value = np.concatenate((self.value, np.zeros_like(self.value)))
        self.value[n : n + k] = self.model.log_probabilities(new)
        self.index.update(zip(new, range(n, n + k), strict=True))
        at[missing] = [self.index[flat[i]] for i in missing]
        return at

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed log-probabilities, symbols) per text; no symbols: no letter."""
        cut = [words_of(t) for t in texts]
        cut = [w if any(map(_has_letter, w)) else [] for w in cut]
        size = np.array([sum(map(len, w)) + len(w) for w in cut], np.int64)
        flat = list(chain.from_iterable(cut))
        total = np.zeros((len(texts), len(self.model.languages)))
        if flat:
            ends = np.cumsum([len(w) for w in cut])
            sums = np.zeros((len(flat) + 1, total.shape[1]))
            at = self._places(flat)  # may replace self.value
            np.cumsum(self.value[at], axis=0, dtype=np.float64, out=sums[1:])
            total = sums[ends] - sums[np.concatenate(([0], ends[:-1]))]
        return total, size


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


ADDED = ("lang_pred", "score", "rejected")


def added_names(docs: DataFrame) -> list[str]:
    """Names of the columns that predict() adds: ADDED, with underscores where ``docs`` has them already."""
    return [free_name(n, docs.columns) for n in ADDED]


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the predicted language, the score and whether the text is rejected, under added_names()."""
    keep, added = docs.columns, added_names(docs)
    if model is None:
        return docs.withColumns(dict(zip(added, (F.lit(UNKNOWN), F.lit(0.0), F.lit(True)), strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    place = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        scorer = _Scorer(found)
        for batch in batches:
            texts = texts_of(batch.column(place))
            for a, b in groups(texts):
                total, size = scorer(texts[a:b].to_pylist())
                best, score, odd = found.decide(total, size)
                none = size == 0
                names = [UNKNOWN if n else found.languages[i] for i, n in zip(best.tolist(), none.tolist(), strict=True)]
                columns = [*batch.slice(a, b - a).columns, pa.array(names, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(none | odd)]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])
            give_back()

    plain = docs.toDF(*[f"c{i}" for i in range(len(keep))]).withColumn(f"c{place}", F.col(f"c{place}").cast("string"))
    kinds = [f"c{i} {kind}" for i, (_, kind) in enumerate(plain.dtypes)]
    extra = [f"c{len(keep) + i} {kind}" for i, kind in enumerate(("string", "double", "boolean"))]
    return plain.mapInArrow(run, ", ".join(kinds + extra)).toDF(*keep, *added)
