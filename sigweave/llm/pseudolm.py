"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network sees the two words on either side of a position and predicts the word in it, in
two steps: a class, then one of the class's words. Words are counted over all documents. Every
word that occurs often enough has a place of its own, so the network grows with the corpus;
rarer words share hash buckets, and within its bucket a word has its share of the bucket's
occurrences, joined from the table of counts. The probabilities of all words of the corpus
thus add up to one. Training is data-parallel: in a round every partition trains a copy in
numpy on its own documents, and Spark averages the copies, weighted by the positions they saw.
Each round takes another part of the documents, all rounds together take each once, and the
masks of a round take turns until every position has been a target once. Scoring then predicts
every token of every text from both sides and sums the conditional log-probabilities.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BATCH_ROWS, arrow_map, settle, text_last, whole_text

CLASSES = 32  # of the smallest network; a class holds as many words as there are classes
VOCABULARY = CLASSES * CLASSES
BUCKETS = 64  # hash buckets for words outside the frequent ones, in the smallest network
PAD = VOCABULARY
OFTEN = 1000  # a word that occurs so often has a place of its own, however many there are
CONTEXT = (-2, -1, 1, 2)
EMBED, HIDDEN = 12, 24
COMMON = 262_144  # words without a place of their own, at most, whose shares every task holds
COUNTED = 1_200_000  # counts of words that a task holds before it adds them up
BLOCK = 4096  # parameters per row while copies are averaged
FAN = 64  # first-level means of a block
BATCH = 8192  # positions of a training step
PIECE = 1024  # rows whose logits are computed together
SMALL = 256  # rows of a product that sums over them: more cost twice as much a row
SCORED = 65_536  # positions that are scored together
SAFE = 60.0  # logits below it are exponentiated as they are
LOG2E = np.float32(math.log2(math.e))  # powers of two are cheaper than those of e

Network = dict[str, np.ndarray]


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    return {"embed": (classes * classes + 1, EMBED), "mix": (len(CONTEXT) * EMBED, HIDDEN), "mix_bias": (HIDDEN,),
            "cls": (HIDDEN, classes), "cls_bias": (classes,), "word": (classes, HIDDEN, classes), "word_bias": (classes, classes)}


def classes_for(n_frequent: int) -> int:
    """Classes that hold the frequent words and one bucket for each fifteen of them."""
    return max(CLASSES, math.ceil(math.sqrt(n_frequent * VOCABULARY / (VOCABULARY - BUCKETS))))


class Ids:
    """Word to id; ids from ``first_bucket`` on are buckets, ``pad`` is no word.

    ``common`` (word, bucket, log_share) are words without a place of their own that need not be hashed.
    """

    def __init__(self, frequent: dict[bytes, int], common: pa.Table | None = None):
        self.frequent, self.first_bucket = frequent, max(len(frequent), VOCABULARY - BUCKETS)
        self.pad = classes_for(len(frequent)) ** 2
        words, share = pa.array(frequent, pa.binary()), np.zeros(len(frequent))
        ids = np.fromiter(frequent.values(), np.int64, len(frequent))
        if common is not None:
            words = pa.concat_arrays([words, *common.column("word").cast(pa.binary()).chunks])
            ids = np.concatenate([ids, common.column("bucket").to_numpy() + self.first_bucket])
            share = np.concatenate([share, common.column("log_share").to_numpy()])
        self.known, self.ids, self.share = words, ids, share

    def __getitem__(self, word: bytes) -> int:
        n = self.frequent.get(word)
        return self.first_bucket + zlib.crc32(word) % (self.pad - self.first_bucket) if n is None else n

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and the log of their share of that id: 0 for frequent words, NaN for those that are not known."""
        found = pc.index_in(words, value_set=self.known)
        known, at = found.is_valid().to_numpy(zero_copy_only=False), found.drop_null().to_numpy()
        rest = words.filter(found.is_null()).to_numpy(zero_copy_only=False)
        ids, share = np.empty(len(words), np.int64), np.full(len(words), np.nan)
        ids[known], share[known] = self.ids[at], self.share[at]
        ids[~known] = self.first_bucket + np.fromiter(map(zlib.crc32, rest), np.int64, len(rest)) % (self.pad - self.first_bucket)
        return ids, share


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per text, the number of every word's entry, and the distinct words (as ``words_of`` cuts them)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # a text that begins or ends with space has empty ends
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.asarray(split.offsets) - split.offsets[0].as_py()
    coded = flat.filter(real).dictionary_encode()
    return np.diff(before[ends]), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary())


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; partitions add up their own words before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added() -> Iterator[pa.RecordBatch]:
            both = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            yield from both.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(TEXT_BATCH_ROWS * 128)

        held: list[pa.Table] = []
        for batch in batches:
            for start in range(0, batch.num_rows, TEXT_BATCH_ROWS):
                _, entry, words = batch_words(batch.column(0).slice(start, TEXT_BATCH_ROWS))
                held.append(pa.table({"word": words, "n": pa.array(np.bincount(entry, minlength=len(words)), pa.int64())}))
                if sum(t.num_rows for t in held) > COUNTED:
                    yield from added()
                    held.clear()
        if held:
            yield from added()

    return docs.select(whole_text(text).alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> dict[bytes, int]:
    """Ids, by rank, ties by bytes, of the words that occur ``OFTEN`` times; of the first 960 if those are fewer."""
    top = counts.filter(F.col("n") >= OFTEN).collect()
    if len(top) < VOCABULARY - BUCKETS:
        top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - BUCKETS).collect()
    return {w: i for i, (_, w) in enumerate(sorted((-r["n"], bytes(r["word"])) for r in top))}


def bucket_shares(counts: DataFrame, frequent: dict[bytes, int]) -> DataFrame:
    """(word, n, bucket, log_share) of every word without a place of its own: the log of its share of its bucket."""
    ids = Ids(frequent)
    own = counts.sparkSession.createDataFrame(pa.table({"word": pa.array(frequent, pa.binary())}))
    rare = counts.join(F.broadcast(own), "word", "left_anti").withColumn(
        "bucket", F.crc32("word") % F.lit(ids.pad - ids.first_bucket))
    total = settle(rare.groupBy("bucket").agg(F.sum("n").alias("total")))  # fewer rows than the network has words
    return rare.join(F.broadcast(total), "bucket").select("word", "n", "bucket", F.log(F.col("n") / F.col("total")).alias("log_share"))


def split_shares(counts: DataFrame, frequent: dict[bytes, int], most: int = COMMON) -> tuple[pa.Table, DataFrame]:
    """The shares of the more common words, at most ``most``, as a local table, and those of all other words."""
    shares, least, held = bucket_shares(counts, frequent), OFTEN + 1, -len(frequent)
    times = counts.groupBy(F.least("n", F.lit(OFTEN)).alias("n")).count().collect()
    for n, words in sorted(times, reverse=True):
        held += words
        if held > most:
            break
        least = n
    return shares.filter(F.col("n") >= least).drop("n").toArrow(), shares.filter(F.col("n") < least).select("word", "log_share")


def class_of(ids: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and place in the class: words of neighbouring rank lie in different classes."""
    place = ids // classes
    return ids - place * classes, place


def fresh(seed: int = 11, classes: int = CLASSES) -> Network:
    rng, shape = np.random.default_rng(seed), shapes(classes)
    out = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in shape.items()}
    return out | {k: np.zeros(shape[k], np.float32) for k in ("mix_bias", "cls_bias", "word_bias")}


def flatten(net: Network) -> np.ndarray:
    return np.concatenate([v.ravel() for v in net.values()])


def unflatten(flat: np.ndarray, classes: int) -> Network:
    at, out = 0, {}
    for k, shape in shapes(classes).items():
        n = math.prod(shape)
        out[k] = np.asarray(flat[at:at + n], np.float32).reshape(shape)
        at += n
    return out


def lay_out(lens: np.ndarray, ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts' words with two pads around each text, and the positions of the words."""
    flat = np.full(len(ids) + 2 * len(lens) + 2, pad, np.int32)
    at = np.arange(len(ids)) + 2 + 2 * np.repeat(np.arange(len(lens)), lens)
    flat[at] = ids
    return flat, at


def stream(lens: np.ndarray, entry: np.ndarray, words: pa.Array, ids: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts' words with two pads around each text; positions of the words; ids of the distinct words."""
    own, _ = ids.look_up(words)
    return *lay_out(lens, own[entry], ids.pad), own


def with_one(h: np.ndarray) -> np.ndarray:
    """Hidden states with a last 1, which a bias as last row of the weights meets."""
    return np.column_stack([h, np.ones(len(h), h.dtype)])


def with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with their bias as last row."""
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def stays_safe(*weights: np.ndarray) -> bool:
    """Whether no logit can leave exp's range: states are within [-1, 1]."""
    return max(np.abs(w).sum(-2).max() for w in weights) < SAFE


def hidden(net: Network, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near = flat[at[:, None] + np.array(CONTEXT)[None, :]]
    seen = net["embed"].take(near, axis=0).reshape(len(at), -1)
    h = seen @ net["mix"]
    h += net["mix_bias"]
    return near, seen, np.tanh(h, out=h)


def by_class(cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups equal classes, and where each class begins in it."""
    order = np.argsort(cls.astype(np.uint16) if classes < 1 << 16 else cls, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=classes))])


def pieces(starts: np.ndarray) -> Iterator[tuple[slice, list[tuple[int, slice]]]]:
    """Whole classes, few enough rows at a time that their logits stay in cache, with each one's rows within the piece.

    ``starts`` are where the classes begin; a class of many rows is a piece of its own.
    """
    groups: list[tuple[int, slice]] = []
    first = 0
    for c in np.flatnonzero(np.diff(starts)).tolist():
        groups.append((c, slice(int(starts[c]) - first, int(starts[c + 1]) - first)))
        if starts[c + 1] - first >= PIECE or starts[c + 1] == starts[-1]:
            yield slice(first, int(starts[c + 1])), groups
            groups, first = [], int(starts[c + 1])


def word_logits(words: np.ndarray, h: np.ndarray, groups: list[tuple[int, slice]]) -> np.ndarray:
    """Logits within the class, for rows grouped by class; ``words`` are the weights of the ``groups`` in turn."""
    x = np.empty((len(h), words.shape[2]), np.float32)
    for own, (_, rows) in zip(words, groups, strict=True):
        np.matmul(h[rows], own, out=x[rows])
    return x


def at_places(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where in the flat ``x`` the ``place`` of every row is."""
    return np.arange(0, x.size, x.shape[1]) + place


def exp_sums(x: np.ndarray) -> np.ndarray:
    """Raises two to ``x`` in place and sums the rows, each in the same way wherever it is (a product with ones does not)."""
    np.exp2(x, out=x)
    return np.einsum("ij->i", x)


def softmax_slope(x: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean negative log-softmax at ``place`` over ``n`` rows of base-2 logits, and a factor for each row.

    Their product is the gradient: states are scaled at less cost than logits. Overwrites ``x``.
    """
    if x.max() > SAFE or x.min() < -SAFE:
        x -= x.max(-1, keepdims=True)
    sums = exp_sums(x)
    x.reshape(-1)[at_places(x, place)] -= sums
    return x, (1 / (sums * n))[:, None]


def chosen_log(x: np.ndarray, place: np.ndarray, safe: bool) -> np.ndarray:
    """Log, base 2, of the softmax of every row of base-2 logits at its ``place``; overwrites ``x``."""
    if not safe:
        x -= x.max(-1, keepdims=True)
    chosen = x.reshape(-1)[at_places(x, place)]
    return chosen - np.log2(exp_sums(x))


def log_probabilities(net: Network, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Conditional log-probability of the word at every position ``at``."""
    out, classes = np.empty(len(at)), len(net["cls_bias"])
    cls_w, word_w = with_bias(net["cls"], net["cls_bias"]), with_bias(net["word"], net["word_bias"])
    safe = stays_safe(cls_w, word_w)
    for s in range(0, len(at), SCORED):
        here = at[s:s + SCORED]
        cls, place = class_of(flat[here], classes)
        order, starts = by_class(cls, classes)
        h = with_one(hidden(net, flat, here[order])[2]) * LOG2E
        cls, place = cls[order], place[order]
        for piece, groups in pieces(starts):
            x = word_logits(word_w[[c for c, _ in groups]], h[piece], groups)
            out[s + order[piece]] = chosen_log(x, place[piece], safe) + chosen_log(h[piece] @ cls_w, cls[piece], safe)
    return out / LOG2E


def descend(value: np.ndarray, speed: np.ndarray, grad: np.ndarray, rate: float, rows: object = ...) -> None:
    """AdaGrad on the ``rows`` that have a gradient; a zero gradient would leave the others as they are."""
    grad = grad.astype(np.float32, copy=False)
    gathered = isinstance(rows, np.ndarray)
    step = grad * grad
    step += speed.take(rows, axis=0) if gathered else speed[rows]
    speed[rows] = step
    step += np.float32(1e-10)
    np.divide(grad, np.sqrt(step, out=step), out=step)
    step *= np.float32(rate)
    if gathered:
        value[rows] = value.take(rows, axis=0) - step
    else:
        value[rows] -= step


def train_step(net: Network, speed: Network, flat: np.ndarray, at: np.ndarray, rate: float) -> None:
    """One AdaGrad step on the masked positions ``at``; costs what they touch, not the vocabulary."""
    classes, n = len(net["cls_bias"]), len(at)
    cls, place = class_of(flat[at], classes)
    order, starts = by_class(cls, classes)
    near, seen, states = hidden(net, flat, at[order])
    cls, place, h = cls[order], place[order], with_one(states)
    cls_w = with_bias(net["cls"], net["cls_bias"])
    h2 = h * LOG2E
    d_h, d_cls = np.empty_like(h), np.zeros_like(cls_w)
    for piece, groups in pieces(starts):
        mine, back = h[piece], d_h[piece]
        d, scale = softmax_slope(h2[piece] @ cls_w, cls[piece], n)
        scaled = mine * scale
        for k in range(0, len(d), SMALL):
            d_cls += scaled[k:k + SMALL].T @ d[k:k + SMALL]
        np.multiply(d @ cls_w.T, scale, out=back)
        here = [c for c, _ in groups]
        own = slice(here[0], here[-1] + 1) if here[-1] - here[0] < len(here) else here
        words = with_bias(net["word"][own], net["word_bias"][own])
        d, scale = softmax_slope(word_logits(words, h2[piece], groups), place[piece], n)
        scaled, d_words = mine * scale, np.empty_like(mine)
        for weights, (_, rows) in zip(words, groups, strict=True):
            np.matmul(d[rows], weights.T, out=d_words[rows])
            np.matmul(scaled[rows].T, d[rows], out=weights)  # the gradient takes the place of the weights
        d_words *= scale
        back += d_words
        # The classes of a piece are in no other, so their weights move while they are in cache.
        descend(net["word"], speed["word"], words[:, :HIDDEN], rate, own)
        descend(net["word_bias"], speed["word_bias"], words[:, HIDDEN], rate, own)
    d_mix = states * states
    np.subtract(1, d_mix, out=d_mix)
    d_mix *= d_h[:, :HIDDEN]
    by_part = net["mix"].reshape(len(CONTEXT), EMBED, HIDDEN).swapaxes(0, 1).reshape(-1, HIDDEN)
    d_seen = (by_part @ d_mix.T).reshape(EMBED, len(CONTEXT) * n)
    near = near.T
    touched = np.flatnonzero(np.bincount(near.ravel(), minlength=len(net["embed"])))
    short = np.empty(len(net["embed"]), np.int64)
    short[touched] = np.arange(len(touched))
    short = short[near.ravel()]
    d_embed = np.column_stack([np.bincount(short, part, len(touched)) for part in d_seen])
    descend(net["embed"], speed["embed"], d_embed, rate, touched)
    for k, grad in (("cls", d_cls[:HIDDEN]), ("cls_bias", d_cls[HIDDEN]), ("mix", seen.T @ d_mix), ("mix_bias", d_mix.sum(0))):
        descend(net[k], speed[k], grad, rate)


def masks(at: np.ndarray, masked: float, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Masks of a share ``masked`` of the positions each, in steps of bounded size: every position is in one of them."""
    at = rng.permutation(at)
    share = max(1, math.ceil(len(at) * masked))
    for m in range(0, len(at), share):
        mask = at[m:m + share]
        for s in range(0, len(mask), BATCH):
            yield mask[s:s + BATCH]


def block_mean(rows: pa.Table) -> pa.Table:
    """Weighted mean of the copies of one block of parameters, with their summed weight."""
    weight = rows.column("weight").to_numpy()
    order = np.argsort(rows.column("copy").to_numpy(), kind="stable")
    values = np.stack(rows.column("values").to_numpy(zero_copy_only=False)).astype(np.float64)
    mean = (values[order] * weight[order, None]).sum(0) / weight.sum()
    return pa.table({"at": rows.column("at").slice(0, 1), "copy": rows.column("copy").slice(order[0], 1),
                     "weight": pa.array([weight.sum()], pa.int64()), "values": pa.array([mean], pa.list_(pa.float64()))})


def train(docs: DataFrame, frequent: dict[bytes, int], common: pa.Table | None = None, *, key: str = "doc_id",
          text: str = "text", rounds: int = 2, masked: float = 0.15, rate: float = 0.05, seed: int = 11) -> Network:
    """Rounds of local training and averaging; a document takes part in the round its key draws, with all its positions."""
    sc = docs.sparkSession.sparkContext
    words, classes = sc.broadcast((frequent, common)), classes_for(len(frequent))
    net = fresh(seed, classes)
    for r in range(rounds):
        start = sc.broadcast(flatten(net))

        def run(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            ids, mine = Ids(*words.value), unflatten(start.value.copy(), classes)
            speed = {k: np.zeros_like(v) for k, v in mine.items()}
            rng = np.random.default_rng([seed, r, TaskContext.get().partitionId()])
            weight = 0
            for batch in batches:
                flat, at, _ = stream(*batch_words(batch.column(0)), ids)
                for mask in masks(at, masked, rng):
                    train_step(mine, speed, flat, mask, rate)
                weight += len(at)
            values = flatten(mine)
            starts = np.arange(0, len(values), BLOCK)
            ends = pa.array([*starts, len(values)], pa.int32())
            if weight:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(starts, pa.int64()), pa.array(np.full(len(starts), TaskContext.get().partitionId()), pa.int64()),
                     pa.array(np.full(len(starts), weight), pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(values, pa.float32()))], names=["at", "copy", "weight", "values"])

        own = docs.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == r).select(whole_text(text).alias("t"))
        copies = own.mapInArrow(run, "at long, copy long, weight long, values array<float>")
        # In two levels, so that no task holds a block of every copy.
        some = copies.groupBy("at", F.pmod("copy", F.lit(FAN)).alias("_part")).applyInArrow(
            block_mean, "at long, copy long, weight long, values array<double>")
        mean = some.groupBy("at").applyInArrow(block_mean, "at long, copy long, weight long, values array<double>")
        got = sorted((row["at"], row["values"]) for row in mean.select("at", "values").toLocalIterator())
        if got:
            net = unflatten(np.round(np.concatenate([values for _, values in got]), 6), classes)
    return net


def rare_words(text_of: np.ndarray, entry: np.ndarray, words: pa.Array, rare: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` texts the words whose entry is ``rare``, with how often each occurs in it."""
    here = rare[entry]
    pair, times = np.unique(text_of[here] * max(1, len(words)) + entry[here], return_counts=True)
    of, which = np.divmod(pair, max(1, len(words)))
    found = pa.StructArray.from_arrays([words.take(pa.array(which)), pa.array(times, pa.int32())], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), found)


def score(docs: DataFrame, net: Network, frequent: dict[bytes, int], common: pa.Table, shares: DataFrame, *,
          text: str = "text") -> DataFrame:
    """All columns but the text, with n_tokens, log_likelihood (sum) and mean_log_likelihood.

    The network gives the probability of a word or of its bucket; that of the word within the
    bucket is in the table ``common`` or, for all other words, joined from ``shares`` (word,
    log_share). These are the rarest, so no key of the join is hot.
    """
    new = ["n_tokens", "log_likelihood", "mean_log_likelihood"]
    rest = [c for c in docs.columns if c != text and c not in new]
    frame = text_last(docs, rest, text)
    names = [f"_c{i}" for i in range(len(rest))]
    fields = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, frame.schema.fields[:len(rest)], strict=True)]
    sc = docs.sparkSession.sparkContext
    model, words, classes = sc.broadcast(flatten(net)), sc.broadcast((frequent, common)), len(net["cls_bias"])
    memo: list[Ids] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not memo:
            memo.append(Ids(*words.value))
        lens, entry, distinct = batch_words(batch.column(len(rest)))
        own, share = memo[0].look_up(distinct)
        p = log_probabilities(unflatten(model.value, classes), *lay_out(lens, own[entry], memo[0].pad))
        p += np.nan_to_num(share)[entry]
        text_of = np.repeat(np.arange(len(lens)), lens)
        total = np.bincount(text_of, p, len(lens))
        rare = rare_words(text_of, entry, distinct, np.isnan(share), len(lens))
        return pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(lens), pa.array(total), rare],
                                          names=[*names, "_n", "_total", "_rare"])

    scored = arrow_map(frame, work, ", ".join([*fields, "_n long", "_total double", "_rare array<struct<word:binary,n:int>>"]))
    scored = settle(scored.withColumn("_row", F.monotonically_increasing_id()))
    # Rounded: the order of a sum must not tell copies of a text apart.
    within = scored.select("_row", F.inline("_rare")).join(shares, "word").groupBy("_row").agg(
        F.round(F.sum(F.col("n") * F.col("log_share")), 6).alias("_within"))
    total = F.col("_total") + F.coalesce("_within", F.lit(0.0))
    return scored.drop("_rare").join(within, "_row", "left").select(
        *[F.col(n).alias(c) for n, c in zip(names, rest, strict=True)], F.col("_n").alias("n_tokens"),
        total.alias("log_likelihood"), F.when(F.col("_n") > 0, total / F.col("_n")).alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rounds: int = 2, masked: float = 0.15) -> DataFrame:
    """Train on all positions of all documents, then score each of them.

    A null or empty text has no tokens, log-likelihood 0 and a null mean. Repeated rows count
    as often as they occur and get equal scores; an empty table gives an empty result.
    """
    counts = settle(word_counts(docs, text))
    frequent = frequent_words(counts)
    common, shares = split_shares(counts, frequent)
    net = train(docs, frequent, common, key=key, text=text, rounds=rounds, masked=masked)
    return score(docs, net, frequent, common, shares, text=text)
