"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). The first factor is a softmax over CLASSES
classes whose logits are sums of weight rows, found by hashing features of the history: the last word
(bigram), the classes of the last two (trigram), and the second and third last word (skips). The second is a
softmax within the class, over its TOP most frequent words and BINS bins of all others, from weight rows for
the last and the second last word together with the class. Only within a bin do counts decide alone, with
one added to each and one place in each bin for words never seen.

The most frequent words are classes of their own, the end of a text is one, and the others are grouped by
their last bytes; which endings belong together is learned from the words that stand before them.

Words are counted over the whole training part. Weights are learned by distributed gradient updates in
ROUNDS rounds, among which the training texts are dealt by hash, so that each text teaches once. In a round
every shard runs over its documents from the common weights, and the shards' changes are averaged, each row
by how often a shard saw it, in a tree of sums. The number of weight rows grows with the number of tokens up
to what a worker can hold, and a shard's size with the number of rows. Which texts make up a shard follows
from the files, so scores may differ a little between layouts of the same rows.

Only the most frequent words, a bounded number, go to the executors as a dictionary. The counts of all
others are found by a join of the words that a text has with the table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import bodies, written
from plenum.llm.words import WordTable, cut, distinct, hashes, same

#: Words in the dictionary, classes of one word, groups of endings, endings.
HOT, SINGLES, GROUPS, ENDINGS = 200_000, 15, 16, 4096
CLASSES = 1 + SINGLES + GROUPS
#: Outcomes within a class: words of their own and bins of the others.
TOP, BINS = 28, 4
INNER = TOP + BINS
#: Weight rows of each factor as a power of two: for up to TOKENS tokens, and at most; one more for four times as many tokens.
LEAST_BITS, MOST_BITS, TOKENS = 15, 18, 1 << 29
#: Tokens of a shard for each weight row, about; updates that are summed in one place.
SHARD, BRANCH = 64, 64
#: Columns of the profile of an ending: the words before it, hashed.
PROFILE = 64
#: Rounds (the documents are dealt to them), tokens of a step, step size.
ROUNDS, STEP, RATE = 2, 8192, 0.5
#: Bytes of text whose words are counted at a time.
COUNTED = 8 << 20
BLOCK = 256
#: What stands in the place of a word's hash: the end of a text, and what is before its start.
END, BEFORE = np.uint64(7919), np.uint64(1)
CLOSERS = b".,;:!?\"')"
#: Bytes that close a word.
CLOSING = np.isin(np.arange(256), list(CLOSERS))


def row_bits(n: int) -> int:
    """Weight rows for n tokens, as a power of two."""
    return min(MOST_BITS, LEAST_BITS + max(0, (max(n - 1, 0) // TOKENS).bit_length() + 1) // 2)


def ending(word: bytes) -> int:
    """The group of endings that a word falls in: its last three bytes without closing punctuation, hashed."""
    return (int.from_bytes((word.rstrip(CLOSERS) or word)[-3:], "big") * 2654435761 & 0xFFFFFFFF) * ENDINGS >> 32


def endings(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ending() of the words of a buffer."""
    left, open_ = sizes.copy(), np.arange(len(sizes))
    while len(open_):
        open_ = open_[CLOSING[low[starts[open_] + left[open_] - 1]]]
        left[open_] -= 1
        open_ = open_[left[open_] > 0]
    left = np.where(left > 0, left, sizes)
    key = np.zeros(len(sizes), np.uint64)
    for back in range(3):
        at = left > back
        key[at] |= low[starts[at] + left[at] - 1 - back].astype(np.uint64) << np.uint64(8 * back)
    return ((key * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) * np.uint64(ENDINGS) >> np.uint64(32)).astype(np.int64)


def counted(rows: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(doc_id, body) -> the table (word, c), the profile of each ending, and the number of texts.

    Words are counted for some COUNTED bytes of text at a time, and then over all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, ends = np.zeros(ENDINGS * PROFILE, np.int64), 0
        for _, texts in bodies(batches, COUNTED):
            low, starts, sizes, counts = cut(texts)
            own, ends = hashes(low, starts, sizes), ends + len(texts)
            first, number = distinct(low, starts, sizes, own)
            times, text = np.bincount(number, minlength=len(first)), low.tobytes()
            words = [text[a : a + n] for a, n in zip(starts[first].tolist(), sizes[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(times), pa.nulls(len(words), pa.int32())], ["word", "c", "cell"])
            before = 1 + (own >> np.uint64(58)).astype(np.int64) % (PROFILE - 1)
            before = np.concatenate([[0], before[:-1]]) if len(before) else before
            before[(np.cumsum(counts) - counts)[counts > 0]] = 0
            profile += np.bincount(endings(low, starts, sizes) * PROFILE + before, minlength=len(profile))
        cells = np.flatnonzero(profile)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cells), pa.binary()), pa.array(profile[cells]), pa.array(cells.astype(np.int32))], ["word", "c", "cell"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([ends], pa.int64()), pa.array([-1], pa.int32())], ["word", "c", "cell"])

    found = written(rows.mapInArrow(run, "word binary, c long, cell int").groupBy("word", "cell").agg(F.sum("c").alias("c")), "counts")
    profile, ends = np.zeros((ENDINGS, PROFILE)), 0
    cells = found.where("cell is not null").select("cell", "c").toArrow()
    for cell, c in zip(cells.column("cell").to_pylist(), cells.column("c").to_pylist()):
        if cell < 0:
            ends = c
        else:
            profile.flat[cell] = c
    return found.where("word is not null").select("word", "c"), profile, int(ends)


def grouped(profile: np.ndarray, groups: int = GROUPS, rounds: int = 25) -> np.ndarray:
    """The group of each ending: k-means over what stands before it, weighted by how often it occurs."""
    weight = profile.sum(axis=1)
    out = np.arange(len(profile)) % groups
    used = np.flatnonzero(weight > 0)
    if not len(used):
        return out.astype(np.int32)
    share = (profile.sum(axis=0) + 1) / (profile.sum() + profile.shape[1])
    x = np.sqrt((profile[used] + 5 * share) / (weight[used, None] + 5)) - np.sqrt(share)
    w = weight[used]
    centres = [x[np.argmax(w)]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(groups, len(used)):
        centres.append(x[np.argmax(far * np.sqrt(w))])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(rounds):
        near = ((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = np.average(x[near == k], axis=0, weights=w[near == k])
    out[used] = near
    return out.astype(np.int32)


@dataclass
class Vocabulary:
    """What executors know of words: the hot ones, their classes, places in these (-1: the class is the word) and logs of
    counts, the end's last; the groups of endings; logs of the sizes of bins; and the shares of classes and of places in them."""

    hot: list[bytes]
    hot_class: np.ndarray
    hot_inner: np.ndarray
    logs: np.ndarray
    groups: np.ndarray
    log_bin: np.ndarray
    share: np.ndarray
    inner_share: np.ndarray


def bins(own: np.ndarray) -> np.ndarray:
    """The bin of a class that a word falls in, by its hash."""
    return (own >> np.uint64(40)).astype(np.int64) % BINS


class Coder:
    """Texts as classes, places in them, hashes and log10(count + 1) of their tokens."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.hot = WordTable(max(4, (4 * len(words.hot)).bit_length()), len(words.hot))
        low, starts, sizes, _ = cut(words.hot)
        own = hashes(low, starts, sizes)
        first = np.sort(np.unique(own, return_index=True)[1])  # of words that share a hash the first is hot
        self.hot.add(own[first], [words.hot[k] for k in first.tolist()])
        self.place = first

    def read(self, texts: list[bytes]):
        """(classes, inner, code, logs, sizes, words): tokens of all texts, each text's last the end; logs are nan where a word
        is not hot; words is (buffer, starts, sizes, hashes, token) of those that are not."""
        low, starts, lengths, counts = cut(texts)
        own, w = hashes(low, starts, lengths), self.words
        hot = self.hot.find(own, low, starts, lengths)
        hot = np.where(hot >= 0, self.place[hot] if len(self.place) else hot, -1)
        sizes = counts + 1
        place = np.arange(len(starts)) + np.repeat(np.arange(len(texts)), counts)
        n = int(sizes.sum())
        classes, inner, code, logs = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, END), np.full(n, w.logs[-1])
        rest = np.flatnonzero(hot < 0)
        kind, at, log = (x[hot] if len(w.hot) else np.zeros(len(hot), x.dtype) for x in (w.hot_class, w.hot_inner, w.logs))
        kind[rest] = 1 + SINGLES + w.groups[endings(low, starts[rest], lengths[rest])]
        at[rest], log[rest] = TOP + bins(own[rest]), np.nan
        classes[place], inner[place], code[place], logs[place] = kind, at, own, log
        return classes, inner, code, logs, sizes, (low, starts[rest], lengths[rest], own[rest], place[rest])


def frequent(counts: DataFrame) -> DataFrame:
    """The most frequent words, at most HOT: those above a count that a histogram of counts gives, so that nothing is sorted."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 32)
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > HOT:
            break
        least = r["step"]
    return counts.where(step >= least) if least is not None else counts.limit(0)


def vocabulary(counts: DataFrame, groups: np.ndarray, ends: int) -> tuple[Vocabulary, int, int]:
    """The vocabulary, the number of training tokens and that of distinct ones."""
    top = frequent(counts).toArrow()
    pairs = sorted(zip((-top.column("c").to_numpy()).tolist(), top.column("word").to_pylist()))
    names, most = [w for _, w in pairs], -np.array([c for c, _ in pairs], np.int64)
    low, starts, sizes, _ = cut(names)
    kind = 1 + SINGLES + groups[endings(low, starts, sizes)].astype(np.int64)
    inner = TOP + bins(hashes(low, starts, sizes))
    kind[:SINGLES], inner[:SINGLES] = 1 + np.arange(min(SINGLES, len(names))), -1
    n, v = np.zeros((CLASSES, INNER), np.int64), np.zeros((CLASSES, INNER), np.int64)
    for c in range(1 + SINGLES, CLASSES):
        own = np.flatnonzero(kind == c)[:TOP]
        inner[own] = np.arange(len(own))
        n[c, : len(own)], v[c, : len(own)] = most[own], 1
    exact = np.flatnonzero(inner < TOP)
    apart = {names[k] for k in exact.tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(GROUPS * BINS, np.int64), np.zeros(GROUPS * BINS, np.int64)
        for batch in batches:
            words = batch.column("word").to_pylist()
            low, starts, sizes, _ = cut(words)
            cell = groups[endings(low, starts, sizes)].astype(np.int64) * BINS + bins(hashes(low, starts, sizes))
            rest = np.fromiter((w not in apart for w in words), bool, len(words))
            c = batch.column("c").to_numpy()
            n += np.bincount(cell[rest], weights=c[rest], minlength=len(n)).astype(np.int64)
            v += np.bincount(cell[rest], minlength=len(v))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(v)], ["cell", "n", "v"])

    for r in counts.mapInArrow(run, "cell long, n long, v long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        c, b = divmod(r["cell"], BINS)
        n[1 + SINGLES + c, TOP + b], v[1 + SINGLES + c, TOP + b] = r["n"], r["v"]
    logs = np.log10(np.append(most, ends) + 1.0)
    whole = n.sum(axis=1)
    whole[0] = ends
    whole[1 : 1 + min(SINGLES, len(names))] = most[:SINGLES]
    used = (v > 0) | (np.arange(INNER) >= TOP)
    inner_share = np.where(used, (n + 1) / np.maximum((n + used).sum(axis=1), 1)[:, None], 1e-20).astype(np.float32)
    live = (np.arange(CLASSES) <= len(names)) | (np.arange(CLASSES) > SINGLES)
    share = np.where(live, (whole + 1) / (whole + live).sum(), 1e-20).astype(np.float32)
    distinct_words = int(v.sum()) + min(SINGLES, len(names)) + (ends > 0)
    made = Vocabulary(names, kind.astype(np.int32), inner.astype(np.int32), logs, groups, np.log10(n + v + 1.0)[:, TOP:], share, inner_share)
    return made, int(whole.sum()), int(distinct_words)


def history(classes: np.ndarray, code: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of every token, four of its class and two of its place in it; nothing is seen across the start of a text."""
    n, code = len(code), code.astype(np.uint64)
    inside = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    far, kinds = np.zeros((3, n), np.uint64), np.zeros((2, n), np.uint64)
    for back in (1, 2, 3):
        far[back - 1, back:] = code[:-back] if n > back else 0
        far[back - 1, inside < back] = BEFORE
        if back < 3:
            kinds[back - 1, back:] = classes[:-back] + 1 if n > back else 0
            kinds[back - 1, inside < back] = 0
    own = (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    keys = np.stack([far[0], kinds[0] * np.uint64(997) + kinds[1], far[1], far[2], far[0] ^ own, far[1] ^ own])
    keys = (keys + np.arange(1, 7, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    rows = ((keys ^ keys >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int32)
    return rows[:4], rows[4:]


def logits(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = np.take(weights, features[0], axis=0, mode="clip")
    more = np.empty_like(z)
    for row in features[1:]:
        z += np.take(weights, row, axis=0, out=more, mode="clip")
    z += bias
    return np.minimum(z, 60, out=z)


def descend(p: np.ndarray, right: np.ndarray, features: np.ndarray, own: np.ndarray, speed: np.ndarray, met: np.ndarray) -> None:
    """One gradient step of a softmax: p holds the logits and is overwritten, right the outcomes, features the rows of own that each sums.

    A row's step shrinks with the squares of its gradients so far, which speed holds.
    """
    np.exp(p, out=p)
    p /= (p @ np.ones(p.shape[1], np.float32))[:, None]
    p[np.arange(len(right)), right] -= 1
    held = np.empty_like(p)
    for row in features:
        order = np.argsort(row, kind="stable")
        in_order = row[order]
        first = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
        g, rows = np.add.reduceat(np.take(p, order, axis=0, out=held, mode="clip"), first, axis=0), in_order[first].astype(np.intp)
        fast = speed[rows] + np.einsum("ij,ij->i", g, g) / 2
        speed[rows] = fast
        g *= (np.float32(RATE) / np.sqrt(fast))[:, None]
        now = np.take(own, rows, axis=0, mode="clip")
        now -= g
        own[rows] = now
        met[rows] += np.diff(np.append(first, len(row)))


def learn(texts: Iterator[list[bytes]], words: Vocabulary, tables: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One pass of gradient steps over the texts from the given weights, of classes and within them: what changed in each, and how often each row was met."""
    coder, bits = Coder(words), len(tables[0]).bit_length() - 1
    own, speed, met = [t.copy() for t in tables], [np.ones(len(t), np.float32) for t in tables], [np.zeros(len(t), np.int64) for t in tables]
    bias, inner_bias = np.log(words.share), np.log(words.inner_share)
    for part in texts:
        classes, inner, code, _, sizes, _ = coder.read(part)
        features, inner_features = history(classes, code, sizes, bits)
        for at in range(0, len(classes), STEP):
            k, f = classes[at : at + STEP], features[:, at : at + STEP]
            descend(logits(own[0], bias, f), k, f, own[0], speed[0], met[0])
        among = np.flatnonzero(inner >= 0)
        for at in range(0, len(among), STEP):
            some = among[at : at + STEP]
            f = np.take(inner_features, some, axis=1)
            descend(logits(own[1], inner_bias[classes[some]], f), inner[some], f, own[1], speed[1], met[1])
    return [(o - t, m) for o, t, m in zip(own, tables, met)]


def trained(rows: DataFrame, words: Vocabulary, n: int) -> list[np.ndarray]:
    """The weights of classes and within them after all rounds over (doc_id, body), which hold n tokens."""
    sc, bits = rows.sparkSession.sparkContext, row_bits(n)
    shards = max(1, n // ROUNDS // (SHARD << bits))
    tables = [np.zeros((1 << bits, width), np.float32) for width in (CLASSES, INNER)]
    blocks = (1 << bits) // BLOCK
    for at in range(ROUNDS):
        shared = sc.broadcast((words, tables))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            changes = learn((texts for _, texts in bodies(batches, 2 << 20)), *shared.value)
            shard = TaskContext.get().partitionId()
            for which, (delta, met) in enumerate(changes):
                for k in range(0, len(delta), BLOCK):
                    times = met[k : k + BLOCK].astype(np.float32)
                    if times.any():
                        moved = (delta[k : k + BLOCK] * (times[:, None] if shards > BRANCH else 1)).astype(np.float32 if shards > BRANCH else np.float16)
                        yield pa.RecordBatch.from_arrays([pa.array([which * blocks + k // BLOCK], pa.int32()), pa.array([shard], pa.int64()), pa.array([times.tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary())], ["block", "shard", "met", "delta"])

        part = rows.where(F.pmod(F.xxhash64("body"), F.lit(ROUNDS)) == at).coalesce(max(shards, BRANCH))
        updates = averaged(part.mapInArrow(run, "block int, shard long, met binary, delta binary"), max(shards, BRANCH), shards > BRANCH)
        tables = [t.copy() for t in tables]
        for r in updates.toLocalIterator():
            which, k = divmod(r["block"], blocks)
            tables[which][k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(r["delta"], np.float32).reshape(BLOCK, -1)
        shared.destroy()
    return tables


def averaged(updates: DataFrame, shards: int, summed: bool) -> DataFrame:
    """Updates (block, shard, met, delta) of all shards -> (block, delta): the mean change of each row, by how often shards met it.

    At most BRANCH updates of a block meet in one place; with more shards sums of such groups are summed again.
    summed says that deltas are multiplied by met already, and single precision; else they are half precision.
    """

    def total(group: pd.DataFrame, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        times, moved = np.zeros(BLOCK, np.float64), 0.0
        for met, delta in zip(group["met"], group["delta"]):
            n = np.frombuffer(met, np.float32)
            change = np.frombuffer(delta, np.float32 if wide else np.float16).reshape(BLOCK, -1).astype(np.float64)
            times += n
            moved = moved + (change if wide else n[:, None] * change)
        return times, moved

    def add(group: pd.DataFrame) -> pd.DataFrame:
        times, moved = total(group, True)
        return pd.DataFrame({"block": group["block"][:1], "shard": group["shard"][:1] // BRANCH, "met": [times.astype(np.float32).tobytes()], "delta": [moved.astype(np.float32).tobytes()]})

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        times, moved = total(group, summed)
        return pd.DataFrame({"block": group["block"][:1], "delta": [(moved / np.maximum(times, 1)[:, None]).astype(np.float32).tobytes()]})

    while shards > BRANCH:
        updates = updates.groupBy("block", F.floor(F.col("shard") / BRANCH)).applyInPandas(add, "block int, shard long, met binary, delta binary")
        shards = -(-shards // BRANCH)
    return updates.groupBy("block").applyInPandas(mean, "block int, delta binary")


def probabilities(words: Vocabulary, tables: list[np.ndarray], classes: np.ndarray, inner: np.ndarray, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of each token's probability, but for a bin's word, that of its bin divided by the bin's size."""
    features, inner_features = history(classes, code, sizes, len(tables[0]).bit_length() - 1)
    out, bias, inner_bias = np.zeros(len(classes)), np.log(words.share), np.log(words.inner_share)

    def chances(z: np.ndarray, right: np.ndarray) -> np.ndarray:
        own = z[np.arange(len(right)), right].astype(np.float64)
        np.exp(z, out=z)
        return (own - np.log((z @ np.ones(z.shape[1], np.float32)).astype(np.float64))) / np.log(10)

    for at in range(0, len(classes), STEP):
        k = classes[at : at + STEP]
        out[at : at + STEP] = chances(logits(tables[0], bias, features[:, at : at + STEP]), k)
    among = np.flatnonzero(inner >= 0)
    for at in range(0, len(among), STEP):
        some = among[at : at + STEP]
        out[some] += chances(logits(tables[1], inner_bias[classes[some]], np.take(inner_features, some, axis=1)), inner[some])
    binned = np.flatnonzero(inner >= TOP)
    out[binned] -= words.log_bin[classes[binned], inner[binned] - TOP]
    return out


def scored(rows: DataFrame, words: Vocabulary, tables: list[np.ndarray]) -> DataFrame:
    """(doc_id, held_out, body) -> a table with what the dictionary gives and each text's other words, counted.

    Columns: uid, doc_id, held_out, n, known, logs (sum of log10(count + 1) of hot words), rest (what is to be
    added to the sum of log10(count + 1) of all words to give the model's), tail (word, times).
    """
    shared = rows.sparkSession.sparkContext.broadcast((words, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables = shared.value
        coder, uid = Coder(words), TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for keys, texts in bodies(iter([batch]), 2 << 20):
                classes, inner, code, logs, sizes, (low, at_, lengths, own_, place) = coder.read(texts)
                rest = probabilities(words, tables, classes, inner, code, sizes)
                exact = inner < TOP
                rest[exact] -= logs[exact]
                tail, starts = np.isnan(logs), np.cumsum(sizes) - sizes
                doc = np.searchsorted(starts, place, side="right") - 1
                order = np.lexsort((own_, doc))
                doc, own_, at_, lengths = doc[order], own_[order], at_[order], lengths[order]
                edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (own_[1:] != own_[:-1]), [True]]) if len(order) else np.zeros(1, bool)
                run_of = np.maximum.accumulate(np.where(edge[:-1], np.arange(len(order)), 0)) if len(order) else order
                odd = np.flatnonzero(~same(low, at_, lengths, low, at_[run_of], lengths[run_of]))  # words that share another's hash
                edge[odd] = edge[odd + 1] = True
                first = np.flatnonzero(edge[:-1])
                text = low.tobytes()
                names = [text[a : a + n] for a, n in zip(at_[first].tolist(), lengths[first].tolist())]
                edges = np.searchsorted(doc[first], np.arange(len(sizes) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(np.diff(np.append(first, len(order))))], ["word", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(len(sizes))), keys, batch.column("held_out").slice(done, len(sizes)), pa.array(sizes), pa.array(np.add.reduceat(~tail, starts, dtype=np.int64)), pa.array(np.add.reduceat(np.where(tail, 0, logs), starts)), pa.array(np.add.reduceat(rest, starts)), lists],
                    ["uid", "doc_id", "held_out", "n", "known", "logs", "rest", "tail"],
                )
                uid, done = uid + len(sizes), done + len(sizes)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n long, known long, logs double, rest double, tail array<struct<word: binary, times: long>>"), "scored")


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    held_out is a column: its rows are scored but teach nothing. A null text counts as empty, which is one
    token, the end. Rows that repeat are scored each by itself, as are rows without a doc_id. Without any
    training row every token is unknown, and the end and every group as likely.
    """
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    training = rows.where("not held_out").select("doc_id", "body")
    counts, profile, ends = counted(training)
    words, n, v = vocabulary(counts, grouped(profile), ends)
    tables = trained(training, words, n)
    table = scored(rows, words, tables)
    tail = table.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.times")
    known = tail.join(counts, "word").groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    ends_known = F.lit(0 if ends else -1)
    return table.drop("tail").join(known, "uid", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0)) + ends_known).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (F.col("rest") + logs).alias("score"),
    )


def op3_maxent(spark, sf_dir: str) -> DataFrame:
    """Every document with its probability under the model and under counts alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_documents(docs, out)
