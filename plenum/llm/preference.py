"""A quality classifier from preferences: Bradley-Terry scores of documents, cut at a quantile.

A document's strength is a linear function of features of its whole text: measures of its form, and hashed words and
pairs of words. A preference pair is a document that is marked good over one that is marked bad; the chance that
the good one wins is the logistic function of the difference of strengths, and the weights minimise the mean
logistic loss over all such pairs of all labelled documents. The strengths of all these documents are then cut at
the quantile that their bad share names, and the distance from the cut becomes a score from 0 to 1.

The labelled documents' features are a table in the shared folder, which each step of the fit reads whole. The
loss of all pairs needs no list of pairs: counts of strengths by class say for each strength how much of the other
class it should have won against. The driver gets sums and counts only.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import scratch, written
from plenum.llm.words import cut, hashes

THRESHOLD = 0.7
#: Labels up to which they go to all executors; beyond that, features and labels meet in a join. Tasks of a step, each with a few kB for the driver.
LABELS, TASKS = 1_000_000, 512
#: The weight of squared weights, how far the loss may be above the least, steps at most, lengths of a step that are tried, and the finest unit of strength in counts of pairs.
L2, GAP, STEPS, TRIALS, UNIT = 5e-3, 1e-5, 200, (2, 1, 1 / 2, 1 / 4, 1 / 8), 1 / 64

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
MARKS = b"#$%&*+/<=>@\\^_`{|}~[]"
CLOSERS = b"!?;:,."

NAMES = [
    "words", "short", "distinct", "repeats", "upper", "letters", "digits", "marks", "mark_words", "exclaims", "stops", "commas",
    "word_bytes", "lines", "distinct_lines", "line_words", "bigrams", "runs", "one_byte", "capitals",
]


#: Hash buckets for words, and for pairs of words, as a power of two; features of a text; share of each class left outside in finding the cut.
HASH_BITS = 8
WIDTH = 3 * len(NAMES) + (2 << HASH_BITS)
EDGE = 0.002
#: Texts, and bytes of text, whose features are taken at a time.
RUN_TEXTS, RUN_BYTES = 512, 2 << 20


def features(body: bytes) -> list[float]:
    """Numbers about a whole text, each bounded in size; zeros for an empty one."""
    size, ws = len(body), body.lower().split()
    n = len(ws)
    if not n:
        return [0.0] * len(NAMES)
    lines = [x for x in body.split(b"\n") if x.strip()]
    share = lambda chars: (size - len(body.translate(None, chars))) / size
    pairs = sum(map(operator.eq, ws, ws[1:]))
    some = ws if n < 4 else list(zip(ws, ws[1:]))
    runs = sum(map(operator.eq, ws, ws[2:])) + sum(map(operator.eq, ws, ws[3:]))
    letters = share(LETTERS)
    return [
        np.log1p(n), float(n < 20), len(set(ws)) / n ** 0.9, pairs / n, share(UPPER), letters, share(DIGITS), share(MARKS),
        sum(len(w.strip(MARKS + CLOSERS)) == 0 for w in set(ws)) / n + body.count(b" | ") / n, body.count(b"!") / n, body.count(b".") / n, body.count(b",") / n,
        min(4.0, sum(map(len, ws)) / n / 8), np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)), len(set(some)) / len(some), runs / n,
        sum(len(w) == 1 for w in ws) / n, sum(map(bytes.istitle, body.split())) / n,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their square roots and squares, so that a linear strength can bend."""
    return np.hstack([x, np.sqrt(np.abs(x)), x * x])


def hashed(bodies: list[bytes]) -> np.ndarray:
    """What each text is made of: square roots of the shares of its words, and of its pairs of words, that fall in each hash bucket."""
    low, starts, sizes, counts = cut(bodies)
    own = hashes(low, starts, sizes)
    doc, ends = np.repeat(np.arange(len(bodies)), counts), np.cumsum(counts)
    one = (own >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    pair = (own[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ own[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - HASH_BITS)
    inside = doc[1:] == doc[:-1]
    width = 2 << HASH_BITS
    cells = np.concatenate([doc * width + one, doc[:-1][inside] * width + (1 << HASH_BITS) + pair[inside].astype(np.int64)])
    out = np.bincount(cells, minlength=len(bodies) * width).reshape(len(bodies), width).astype(np.float32)
    out /= np.maximum(np.diff(np.concatenate([[0], ends])), 1)[:, None]
    return np.sqrt(out, out=out)


def rows_of(bodies: list[bytes]) -> np.ndarray:
    """A row of features for each text."""
    if not bodies:
        return np.zeros((0, WIDTH), np.float32)
    return np.hstack([expand(np.array([features(x) for x in bodies], float)).astype(np.float32), hashed(bodies)])


def some(bodies: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of bounded number and size."""
    start = held = 0
    for k, body in enumerate(bodies):
        if k > start and (held + len(body) > RUN_BYTES or k - start >= RUN_TEXTS):
            yield bodies[start:k]
            start, held = k, 0
        held += len(body)
    if start < len(bodies):
        yield bodies[start:]


def featured(docs: DataFrame) -> DataFrame:
    """docs(..., text) -> (..., x): the features as bytes of half precision; a null text counts as empty."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist()
            found = [row.tobytes() for part in some(bodies) for row in np.clip(rows_of(part), -6e4, 6e4).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found, pa.binary())], [*names, "x"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in names]
    return docs.select(*names, "text").mapInArrow(run, ", ".join([*kinds, "x binary"]))


@dataclass
class Model:
    """strength = (x - mean) / scale . weights; score = logistic(slope * (strength - cut) + logit(0.7))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Runs of (good, features) of documents; what adds up a function of such runs over all documents: (function, its number of values) -> sum.
Runs = Iterable[tuple[np.ndarray, np.ndarray]]
Each = Callable[[Callable[[Runs], np.ndarray], int], np.ndarray]


def reached(weight: np.ndarray, before: float, target: float) -> tuple[int, float]:
    """The first place up to which the weights, and what is before them, add up to the target; and what is before it."""
    share = before + np.cumsum(weight)
    k = min(int(np.searchsorted(share, target)), int(np.flatnonzero(weight)[-1]))
    return k, float(share[k - 1]) if k else before


def quantile(scores: np.ndarray, weight: np.ndarray, at: float) -> float:
    """The smallest score up to which the weights add up to the share `at` of all."""
    order = np.argsort(scores, kind="stable")
    return float(scores[order[reached(weight[order], 0.0, at * weight.sum() * (1 - 1e-9))[0]]])


def pair_sums(counts: np.ndarray, unit: float) -> tuple[float, np.ndarray, np.ndarray]:
    """From counts of strengths in whole units, of bad and good ones: the mean loss of all pairs, and for each place the
    mean chance that a bad (good) document of this strength wins (loses) against those of the other class."""
    n = counts.shape[1]
    bad, good = counts / counts.sum(axis=1, keepdims=True)
    apart = np.arange(1 - n, n) * unit
    wins = 1 / (1 + np.exp(-np.clip(apart, -500, 500)))
    loss = np.correlate(good, bad, "full") @ np.logaddexp(0, -apart)
    return float(loss), np.convolve(good, wins)[n - 1 : 2 * n - 1], np.convolve(bad, wins[::-1])[n - 1 : 2 * n - 1]


def direction(g: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse Hessian that the last moves of weights and gradients tell (L-BFGS)."""
    d, shares = g.copy(), []
    for s, y in reversed(moves):
        shares.append(s @ d / (s @ y))
        d -= shares[-1] * y
    if moves:
        s, y = moves[-1]
        d *= s @ y / (y @ y)
    for (s, y), share in zip(moves, reversed(shares)):
        d += s * (share - y @ d / (s @ y))
    return d


def minimum(each: Each, standard: Callable[[Runs], Runs], totals: np.ndarray, width: int, l2: float) -> np.ndarray:
    """The weights with the least loss over all pairs, totals being the numbers of bad and good documents.

    A loss with this l2 lies at most g^2 / (2 l2) above the least, g being its gradient; the steps end when that is GAP.
    """
    w, moves, last = np.zeros(width), [], None
    grid, (loss, lost, missed) = np.zeros(1), pair_sums(totals[:, None].astype(float), 1.0)
    for _ in range(STEPS):

        def gradient(runs, w=w, grid=grid, lost=lost / totals[0], missed=missed / totals[1]):
            out = np.zeros(width)
            for good, x in standard(runs):
                s = x @ w.astype(np.float32)
                out += np.where(good, -np.interp(s, grid, missed), np.interp(s, grid, lost)).astype(np.float32) @ x
            return out

        g = each(gradient, width) + l2 * w
        if g @ g <= 2 * l2 * GAP:
            break
        if last is not None and (w - last[0]) @ (g - last[1]) > 0:
            moves = [*moves[-9:], (w - last[0], g - last[1])]
        last, d = (w, g), direction(g, moves)
        for reach in (1, 1 / 32, 1 / 1024):
            tried = w - reach * np.outer(TRIALS, d)
            most = 8 * np.abs(tried).sum(axis=1).max()
            unit = max(UNIT, most / (1 << 14))
            half = int(most / unit) + 3
            shape = (len(TRIALS), 2, 2 * half + 1)

            def counts(runs, tried=tried, unit=unit, half=half, shape=shape):
                out = np.zeros(shape)
                for good, x in standard(runs):
                    s = (x @ tried.T.astype(np.float32)).astype(float) / unit + half
                    for k in range(len(TRIALS)):  # a document counts at the places below and above its strength, more at the nearer
                        at = s[:, k].astype(np.int64)
                        for place, share in ((at, 1 - s[:, k] + at), (at + 1, s[:, k] - at)):
                            out[k] += np.bincount(good * shape[2] + place, share, 2 * shape[2]).reshape(2, -1)
                return out.ravel()

            found = []
            for k, part in enumerate(each(counts, int(np.prod(shape))).reshape(shape)):
                there = np.flatnonzero(part.any(axis=0))
                low, high = there[0], there[-1] + 1
                found.append((*pair_sums(part[:, low:high], unit), (np.arange(low, high) - half) * unit))
            total = [f[0] + l2 / 2 * v @ v for f, v in zip(found, tried)]
            k = int(np.argmin(total))
            if total[k] < loss:
                break
        else:
            break
        w, loss, (_, lost, missed, grid) = tried[k], total[k], found[k]
    return w


def ordered(s: np.ndarray) -> np.ndarray:
    """Numbers in single precision as unsigned integers of the same order."""
    bits = s.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def number(key: int) -> float:
    """What ordered made the key of."""
    return float(np.array([key & 0x7FFFFFFF if key >> 31 else ~key & 0xFFFFFFFF], np.uint32).view(np.float32)[0])


def fitted(each: Each, width: int, bad_share: float | None = None, l2: float = L2) -> Model:
    """The model of all documents that each() runs over; bad_share is theirs unless it is given.

    The cut is the quantile of strengths at bad_share, taken as the middle between the quantiles at EDGE of
    either class inside of it. Without one of the classes there is no preference: every score is then 1 (or 0
    where all are bad).
    """

    def sums(runs):
        out = np.zeros((2, 1 + width))
        for good, x in runs:
            out[0, 0] += good.sum()
            out[1, 0] += len(good) - good.sum()
            out[0, 1:] += x.sum(axis=0, dtype=float)
            out[1, 1:] += np.einsum("ij,ij->j", x, x, dtype=float)
        return out.ravel()

    first, second = each(sums, 2 + 2 * width).reshape(2, -1)
    totals = np.array([second[0], first[0]])
    if not totals.all():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 1e9 if totals[0] else -1e9, 1.0)
    mean = first[1:] / totals.sum()
    scale = np.maximum(np.sqrt(np.maximum(second[1:] / totals.sum() - mean * mean, 0)), 1e-3)

    def standard(runs):
        for good, x in runs:
            x = x - mean.astype(np.float32)
            x /= scale.astype(np.float32)
            yield good, np.clip(x, -8, 8, out=x)

    w = minimum(each, standard, totals, width, l2)
    bad_share = totals[0] / totals.sum() if bad_share is None else bad_share
    weight = np.array([bad_share, 1 - bad_share]) / totals
    targets = [at * (1 - 1e-9) for at in (bad_share * (1 - EDGE), bad_share + EDGE * (1 - bad_share))]

    def heads(runs):
        out = np.zeros(2 + (2 << 16))
        for good, x in standard(runs):
            s = x @ w
            out[:2] += s.sum(), s @ s
            out[2:] += np.bincount(good * (1 << 16) + (ordered(s) >> 16), minlength=2 << 16)
        return out

    found = each(heads, 2 + (2 << 16))
    spread = np.sqrt(max(0.0, found[1] / totals.sum() - (found[0] / totals.sum()) ** 2))
    tops = [reached(weight @ found[2:].reshape(2, -1), 0.0, at) for at in targets]

    def tails(runs):
        out = np.zeros((len(tops), 2 << 16))
        for good, x in standard(runs):
            keys = ordered(x @ w)
            for k, (top, _) in enumerate(tops):
                inside = keys >> 16 == top
                out[k] += np.bincount(good[inside] * (1 << 16) + (keys[inside] & 0xFFFF), minlength=2 << 16)
        return out.ravel()

    low, high = (number(top << 16 | reached(weight @ part.reshape(2, -1), before, at)[0]) for (top, before), at, part in zip(tops, targets, each(tails, len(tops) * (2 << 16)).reshape(len(tops), -1)))
    return Model(mean, scale, w, (low + high) / 2, float(4 / max(1e-6, spread)))


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float, l2: float = L2) -> Model:
    """The model of documents at hand; good and bad are rows of features."""
    width = (good if good.ndim == 2 else bad).shape[1] if good.ndim == 2 or bad.ndim == 2 else WIDTH
    runs = [(np.full(len(x), k, np.int64), x.reshape(-1, width).astype(np.float32)) for k, x in enumerate((bad, good)) if len(x)]
    return fitted(lambda f, size: f(runs), width, bad_share, l2)


def taught(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, x) of every labelled document that is not held out.

    A document with several labels counts by their majority, with a draw not at all; null ids and null
    labels are left out.
    """
    votes = labels.where(~held_out()).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("q")).where("q <> 0.5")
    votes = votes.select("doc_id", (F.col("q") > 0.5).alias("good"))
    docs = docs.select("doc_id", "text").where(~held_out())
    rows = featured(docs.join(F.broadcast(votes), "doc_id")) if votes.count() <= LABELS else featured(docs.where("doc_id is not null")).join(votes, "doc_id")
    return rows.select("good", "x")


def over(rows: DataFrame) -> Each:
    """What adds up functions over a table of (good, x)."""
    rows = rows.coalesce(TASKS)

    def runs(batches: Iterator[pa.RecordBatch]) -> Runs:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float16).reshape(part.num_rows, WIDTH)
                yield part.column("good").to_numpy(zero_copy_only=False).astype(np.int64), x.astype(np.float32)

    def each(f: Callable[[Runs], np.ndarray], size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = f(runs(batches))
            places = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (places, found[places])], ["places", "found"])

        out = np.zeros(size)
        for places, found in rows.mapInArrow(run, "places binary, found binary").collect():
            out[np.frombuffer(places, np.int64)] += np.frombuffer(found, float)
        return out

    return each


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled docs; rows that are held out teach nothing."""
    with scratch(docs.sparkSession):
        return fitted(over(written(taught(docs, labels), "features")), WIDTH)


def held_out(key: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    bodies = pc.fill_null(column.cast(pa.binary()), b"").to_pylist()
    return np.concatenate([np.zeros(0), *(model.score(rows_of(part)) for part in some(bodies))])


def score_documents(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """(doc_id, held_out, score) of every document; the fit sees only rows that are not held out."""
    model = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(_scores(shared.value, batch.column("text")))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"), model


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns as they are, without the rows that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op9_preference(spark, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows, _ = score_documents(docs, labels)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
