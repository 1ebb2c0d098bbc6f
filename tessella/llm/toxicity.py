"""Toxicity of documents: noisy-channel restoration of obfuscated words, then a lexical classifier.

A character model is counted over all documents: trigrams of letters inside words, exactly, so that the model grows
with what the corpus holds. Letters without case (of scripts in which nothing is disguised this way) count as one
letter, which bounds the trigrams by the cased alphabets. A token that looks disguised (digits or signs among
letters, letters repeated, single letters spaced out) becomes a lattice: each character may stand for itself, for the
letters it imitates, for nothing (separators) or for the letter before it (repetitions), each at a cost of the channel.
Viterbi search over all pairs of last letters finds the likeliest words, whatever the token's length; the ``READINGS``
likeliest of its ends are the token's readings. Other tokens stand for themselves.

The classifier is learned from at most ``TRAIN_DOCS`` labelled documents, the first by a hash of their id, of which
copies and near copies count once. Features are restored words and their beginnings. One is taken in when the number of
documents that have it once, twice or four times speaks for toxicity more than chance among all features would; it
weighs the more the further it is beyond chance, so nothing depends on an absolute count. A document's evidence is how
far the occurrences of these features, counted over distinct words, exceed what a clean text of its length has
(a Poisson deviance, so each further word adds to it). A logistic curve fitted to the training documents turns
evidence into a score.

Edge cases: null and empty texts, and texts without letters, have no evidence and score the curve's lowest value; rows
with one id are scored one by one; a null id is never held out and never learned from; of copies whose labels clash
the toxic label holds; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, map_batches, materialise, release, sliced, texts, tidied

#: Most labelled documents that the classifier learns from.
TRAIN_DOCS = 16_000
THRESHOLD = 0.7
#: How often a document has a feature, at least, to count for each level.
LEVELS = (1, 2, 4)
#: Share of the chance level (the logarithm of the number of features) that a feature must exceed.
CHANCE = 0.8
#: Evidence beyond which documents are alike for the curve.
MOST_EVIDENCE = 40.0
#: Minwise tokens of a text's words in each of two signatures; texts that share a signature count once in training.
SIGNATURE = 4
READINGS = 4
#: Characters that a task remembers readings of.
MEMO_CHARS = 4 << 20
#: Features that a task counts before it passes its counts on.
MOST_COUNTED = 150_000
#: Characters that are counted at once.
PIECE = 1 << 20
#: Letters that a character imitates.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i",
}
#: Characters that may stand between the letters of one word.
BETWEEN = set(".-_*~·'’`^,:;/\\​‌‍­#%&=")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
DISGUISED = re.compile(r"([^\W\d_])\1\1|[^\W\d_][^a-z]*[\W\d_]+[^a-z]*[^\W\d_]|[\d@$!|+€£(<¡][^\W\d_]|[^\W\d_][\d@$]")
ENDS = re.compile(r"^\W+|\W+$|(?:(\W)\1+)$|^(?:(\W)\2+)")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
SUBSTITUTE, DROP, REPEAT, STRAY = -1.2, -0.7, -0.6, -9.0
BLANK, CASELESS = 32, 0xFFFF


def _letters() -> np.ndarray:
    """For each code of the basic plane: itself for lower-case letters, one code for letters without case, else a blank."""
    out = np.full(1 << 16, BLANK, np.int64)
    for code in range(1 << 16):
        ch = chr(code)
        if ch.isalpha():
            out[code] = code if ch.upper() != ch else CASELESS
    return out


LETTERS = _letters()


def packed(a: int, b: int, c: int) -> int:
    return a << 32 | b << 16 | c


def letter(ch: str) -> int:
    code = ord(ch)
    return int(LETTERS[code]) if code < 1 << 16 else CASELESS if ch.isalpha() else BLANK


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text's words, packed, and their counts; every word lies between two blanks."""
    code = np.frombuffer(("  " + text + "  ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 1 << 16, LETTERS[np.minimum(code, 0xFFFF)], CASELESS)
    # Two blanks part words wherever one does.
    code = np.insert(code, np.flatnonzero(code == BLANK), BLANK)
    a, b, c = code[:-2], code[1:-1], code[2:]
    live = (c != BLANK) | (b != BLANK)
    return np.unique((a << 32 | b << 16 | c)[live], return_counts=True)


def pieces(column: Iterable[str]) -> Iterator[str]:
    """Joined texts of about ``PIECE`` characters; a longer text is cut at white space, or with two characters in common."""
    held, size = [], 0
    for text in column:
        at = 0
        while len(text) - at > PIECE:
            stop = text.rfind(" ", at, at + PIECE)
            stop = stop if stop > at else at + PIECE
            yield text[at:stop]
            at = stop if text[stop] == " " else stop - 2
        held.append(text[at:])
        size += len(held[-1])
        if size > PIECE:
            yield " ".join(held)
            held, size = [], 0
    if held:
        yield " ".join(held)


def character_model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of all texts, packed and sorted, and their counts. Tasks send one row for each of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for part in sliced(batch, 1000):
                for piece in pieces(texts(part.column(0))):
                    new, n = trigrams(piece)
                    keys, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
                    counts = np.bincount(at, np.concatenate((counts, n)), len(keys)).astype(np.int64)
        for at in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000]), pa.array(counts[at : at + 50_000])], ["key", "n"])

    found = docs.select("text").mapInArrow(tidied(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    return found["key"].to_numpy(), found["n"].to_numpy()


class CharacterModel:
    """Smoothed log probabilities of a letter after two others, relative to the mean trigram."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mean = counts.sum() / (1 << 16) if len(counts) else 0.0
        self.log = dict(zip(keys.tolist(), np.log((counts + 0.2) / (mean + 0.2)).tolist(), strict=True))
        self.unseen = math.log(0.2 / (mean + 0.2))

    def __call__(self, a: int, b: int, c: int) -> float:
        return self.log.get(packed(a, b, c), self.unseen)


class Restorer:
    """Finds the words that a token may stand for."""

    def __init__(self, model: CharacterModel, best: int = READINGS) -> None:
        self.model, self.best = model, best

    @staticmethod
    def options(token: str, k: int) -> list[tuple[str, float]]:
        """What the k-th character may stand for, and at what cost; '' is nothing."""
        ch = token[k]
        if ch.isalpha():
            out = [(ch, 0.0)]
            if k and token[k - 1] == ch:
                out.append(("", REPEAT if k > 1 and token[k - 2] == ch else 2 * REPEAT))
            return out
        out = [(x, SUBSTITUTE) for x in LOOKS.get(ch, "")]
        drop = DROP if ch in BETWEEN or ch.isspace() else STRAY if ch in LOOKS else 2 * DROP
        if k and token[k - 1] == ch:
            drop = max(drop, REPEAT + SUBSTITUTE)
        return [*out, ("", drop)]

    def viterbi(self, token: str) -> list[str]:
        """The likeliest readings of a lattice, best first: the best path to each pair of last letters is kept, none is cut."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BLANK, BLANK): (0.0, None)}
        for k in range(len(token)):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            choices = [(x, letter(x) if x else 0, cost) for x, cost in self.options(token, k)]
            for (a, b), (score, path) in states.items():
                for x, code, cost in choices:
                    key, now = ((b, code), score + cost + self.model(a, b, code)) if x else ((a, b), score + cost)
                    if (old := new.get(key)) is None or now > old[0]:
                        new[key] = now, (path, x) if x else path
            states = new
        ended = heapq.nsmallest(self.best + 1, ((-s - self.model(a, b, BLANK), a, b) for (a, b), (s, _) in states.items()))
        out = []
        for _, a, b in ended:
            letters, path = [], states[a, b][1]
            while path is not None:
                path, x = path
                letters.append(x)
            if letters:
                out.append("".join(reversed(letters)))
        return list(dict.fromkeys(out))[: self.best]

    def words(self, token: str) -> list[str]:
        """Readings of one token between white space, in lower case."""
        if token.isalpha() and not re.search(r"(.)\1\1", token):
            return [token]
        core = token
        while core and (cut := ENDS.sub("", core)) != core:
            core = cut
        plain = WORD.findall(token)
        for t in {core, token.rstrip(".,;:!?\"')")}:
            if DISGUISED.search(t):
                plain += self.viterbi(t)
        return list(dict.fromkeys(plain))

    def spaced(self, text: str) -> set[str]:
        """Readings of letters that stand one by one: what begins at each place, as far as a beginning can tell."""
        out: set[str] = set()
        most = PREFIXES[-1] + 1
        for m in SPACED.finditer(text):
            for word in self.viterbi(re.sub(r"\s", "", m[0])):
                out.update(word[k : k + most] for k in range(max(1, len(word) - 2)))
        return out


def features(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k <= len(word))]


class Memo(dict):
    """What ``make`` gives for a token, remembered for ``MEMO_CHARS`` characters of tokens."""

    def __init__(self, make) -> None:
        self.make, self.size = make, 0

    def __missing__(self, token: str):
        made = self.make(token)
        if len(token) <= 64:
            self.size += len(token) + 8
            if self.size > MEMO_CHARS:
                self.clear()
                self.size = len(token) + 8
            self[token] = made
        return made


def tokens(text: str, restorer: Restorer) -> tuple[set[str], set[str]]:
    """The distinct tokens of a text in lower case, and the readings of its letters that stand one by one."""
    low = text.lower()
    return set(low.split()), restorer.spaced(low)


def signatures(text: str) -> tuple[str, str]:
    """Two independent groups of minwise tokens of a text's words: near copies share one of them at least."""
    words = {w.encode() for w in text.lower().split()}
    least = [min((xxhash.xxh32_intdigest(w, seed) for w in words), default=0) for seed in range(2 * SIGNATURE)]
    return "-".join(map(str, least[:SIGNATURE])), "-".join(map(str, least[SIGNATURE:]))


def _signed(rows: pa.RecordBatch) -> pa.RecordBatch:
    both = [signatures(t) for t in texts(rows.column(1))]
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array([x for x, _ in both], pa.string()), pa.array([x for _, x in both], pa.string())], ["doc_id", "text", "toxic", "one", "two"])


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, toxic of at most ``most`` labelled documents that aren't held out, near copies once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most TRAIN_DOCS rows of two numbers: safe to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = map_batches(rows.select("doc_id", "text", "toxic"), _signed, "doc_id bigint, text string, toxic int, one string, two string")
    for key in ("one", "two"):
        rows = rows.groupBy(key).agg(F.min_by(F.struct("doc_id", "text", "one" if key == "two" else "two"), F.struct("doc_id", F.xxhash64("text"))).alias("s"), F.max("toxic").alias("toxic")).select("s.*", "toxic", key)
    return rows.select("doc_id", "text", "toxic")


def _restorer(shipped) -> Restorer:
    return Restorer(CharacterModel(*shipped.value))


def _learned(shipped):
    """feature, toxic, clean (documents at each level), toxic_words, clean_words: of the feature '', documents and distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counted = _restorer(shipped), Counted()
        memo = Memo(lambda t: counted.numbers({f for w in restorer.words(t) for f in features(w)}))
        for batch in batches:
            for part in sliced(batch):
                for text, label in zip(texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                    plain, spaced = tokens(text, restorer)
                    found = [*map(memo.__getitem__, plain), *(counted.numbers(set(features(w))) for w in spaced)]
                    counted.add(b"".join(found), len(found), label)
                    if len(counted.number) > MOST_COUNTED:
                        yield from counted.rows()
                        memo.clear()  # its numbers are void
                        memo.size, counted = 0, Counted()
        yield from counted.rows()

    return tidied(run)


class Counted:
    """Counts of features over documents. Features go by number, so that what a token has is a few bytes."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.counts = np.zeros((1 << 12, 2, len(LEVELS) + 1), np.int64)
        self.any = False

    def numbers(self, names: set[str]) -> bytes:
        number = self.number
        return array("i", [number.setdefault(f, len(number)) for f in names]).tobytes()

    def add(self, found: bytes, words: int, label: int) -> None:
        """A document of so many distinct words, with the numbers of each one's features end to end."""
        if len(self.number) > len(self.counts):
            more = np.zeros((2 * len(self.number), *self.counts.shape[1:]), np.int64)
            more[: len(self.counts)] = self.counts
            self.counts = more
        of, n = np.unique(np.frombuffer(found, np.int32), return_counts=True)
        self.counts[of, label, 0] += n
        for k, level in enumerate(LEVELS, 1):
            self.counts[of, label, k] += n >= level
        self.counts[0, label] += [words] + [1] * len(LEVELS)
        self.any = True

    def rows(self, most: int = 50_000) -> Iterator[pa.RecordBatch]:
        names = list(self.number) if self.any else []
        for at in range(0, len(names), most):
            part = names[at : at + most]
            counts = self.counts[at : at + len(part)]
            ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(LEVELS))
            sides = [pa.ListArray.from_arrays(ends, pa.array(counts[:, x, 1:].ravel())) for x in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *sides, *(pa.array(counts[:, x, 0]) for x in (1, 0))], NAMES)


NAMES = ["feature", "toxic", "clean", "toxic_words", "clean_words"]


def _deviance(a: F.Column, n: float, b: F.Column, m: float) -> F.Column:
    """How far a of n and b of m documents are from one share, where the first's is larger; 0 elsewhere."""
    share = (a + b) / (n + m)
    part = lambda k, of, p: F.when(k > 0, k * F.ln(k / (of * p))).otherwise(0.0)
    return F.when(a / n > b / m, part(a, n, share) + part(n - a, n, 1 - share) + part(b, m, share) + part(m - b, m, 1 - share)).otherwise(0.0)


class Model:
    """Weights and clean rates of features, and the curve that turns evidence into a score."""

    def __init__(self, weights: dict[str, tuple[float, float]], curve: tuple[float, float] | None = None) -> None:
        self.weights, self.curve = weights, curve

    def feature(self, words: Iterable[str]) -> str | None:
        """The heaviest feature of any of a token's readings."""
        return max((f for w in words for f in features(w) if f in self.weights), key=lambda f: (self.weights[f], f), default=None)

    def evidence(self, n: int, found: Counter) -> float:
        """Of ``n`` distinct words, of which ``found`` have each feature."""
        out = 0.0
        for f, k in found.items():
            weight, rate = self.weights[f]
            if k > (usual := n * rate):
                out += weight * (k * math.log(k / usual) - k + usual)
        return out

    def score(self, evidence: float) -> float:
        if self.curve is None:
            return 0.0
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * evidence))))


def _measured(shipped, model: Model, keep: list[str], column: str, name: str, finish):
    """Rows with ``finish(evidence)`` arrays after the kept columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(shipped)
        memo = Memo(lambda t: model.feature(restorer.words(t)))
        for batch in batches:
            for rows in sliced(batch):
                out = []
                for text in texts(rows.column(column)):
                    plain, spaced = tokens(text, restorer)
                    found = Counter(f for f in map(memo.__getitem__, plain) if f)
                    found.update(f for f in (model.feature([w]) for w in spaced) if f)
                    out.append(model.evidence(len(plain) + len(spaced), found))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *finish(out)], [*keep, *name.split()])

    return tidied(run)


def fitted_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic intercept and slope (not negative), by Newton's method; the labels are smoothed as if one more of each kind were wrong."""
    x, n = np.minimum(evidence, MOST_EVIDENCE), (len(toxic) - toxic.sum(), toxic.sum())
    y = np.where(toxic == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    at = np.zeros(2)

    def loss(t: np.ndarray) -> float:
        z = t[0] + t[1] * x
        return float((np.logaddexp(0, z) - y * z).sum() + t[1] ** 2 / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(at[0] + at[1] * x, -500, 500)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1]], [(y - p).sum(), ((y - p) * x).sum() - at[1]])
        size = 1.0
        while loss(at + size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0]), max(0.0, float(at[1]))


def fit(docs: DataFrame, labels: DataFrame, shipped) -> Model:
    """The classifier learned from labelled documents that aren't held out; ``shipped`` broadcasts the character model."""
    spark = docs.sparkSession
    rows_path, learned_path = fresh_path(spark, "training"), fresh_path(spark, "learned")
    rows = materialise(training(docs, labels), "training", rows_path)
    counts = rows.mapInArrow(_learned(shipped), "feature string, toxic array<bigint>, clean array<bigint>, toxic_words bigint, clean_words bigint")
    sums = [F.sum(F.col(side)[k]).alias(f"{side}_{k}") for side in ("toxic", "clean") for k in range(len(LEVELS))]
    learned = materialise(counts.groupBy("feature").agg(*sums, F.sum("toxic_words").alias("toxic_words"), F.sum("clean_words").alias("clean_words")), "learned", learned_path)
    total = learned.where("feature = ''").first()
    if total is None or not min(total.toxic_0, total.clean_0):
        return Model({})
    chance = CHANCE * math.log(max(3, learned.count()))
    strength = F.greatest(*[_deviance(F.col(f"toxic_{k}"), total.toxic_0, F.col(f"clean_{k}"), total.clean_0) for k in range(len(LEVELS))])
    frequent = F.col("toxic_words") / total.toxic_words > 2 * F.col("clean_words") / max(1, total.clean_words)
    # Of features of at most TRAIN_DOCS documents, those that speak for toxicity.
    strong = learned.where(F.col("feature") != "").withColumn("g", strength).where((F.col("g") > chance) & frequent).select("feature", "g", "clean_words").collect()
    model = Model({r.feature: (1 - chance / r.g, (r.clean_words + 0.5) / (total.clean_words + 1)) for r in strong})
    finish = lambda out: [pa.array(out, pa.float64())]
    seen = rows.select("text", "toxic").mapInArrow(_measured(shipped, model, ["toxic"], "text", "evidence", finish), "toxic int, evidence double").collect()
    release(spark, rows_path, learned_path)
    model.curve = fitted_curve(np.array([r.evidence for r in seen]), np.array([r.toxic for r in seen]))
    return model


def scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row of ``docs``, then score and predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(character_model(docs))
    model = fit(docs, labels, shipped)

    def finish(out: list[float]) -> list[pa.Array]:
        found = [model.score(x) for x in out]
        return [pa.array(found, pa.float64()), pa.array([int(s >= THRESHOLD) for s in found], pa.int32())]

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_measured(shipped, model, list(keep), "text", "score predicted", finish), f"{kinds}, score double, predicted int")
