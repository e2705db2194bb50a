"""LM scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

Counts of all training words give the base score. The model predicts a word from the two words before it. All training
words that occur MIN_COUNT times or more are words of the model, however many they are, each with a context vector of
its own; the others share one. The most frequent words are classes of their own, all others share a class, and the end
is one: noise-contrastive estimation trains the classes. Below the shared class a Huffman tree of classes within classes
leads down to each word; its nodes are two-way log-bilinear models. One leaf holds the words too rare for the model, and
within it a word has its smoothed share of the counts. Each step is normalised, so the probabilities of all words, known
or not, add up to at most 1.
Every task trains from the same start on all training documents of its partitions, in batches with shared noise words;
the models are averaged for each of a few rounds, weighted by tokens; a vector by the tokens that touched it. As each task
sends up to a whole model, partitions are joined into tasks with text in proportion to the model.

Scoring reads each text where it lies: words of the model bring their counts with them, and only the words too rare for it
are joined with the counts, by document, so texts are not shuffled and no table of all words goes to one place. A batch's
distinct contexts are normalised once by matrix products.

Null and empty texts have one token, the end. Repeated rows are scored alike. A null doc_id is in training. Other
columns are ignored. Without training documents every word has count 0; an empty table gives none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import hashed_words, pieces
from .common import discard, fresh_path, small_batches, stash, table

CLASSES, WIDTH, NOISE, ROUNDS, RATE = 510, 16, 64, 2, 0.05
#: Words that occur so often in training are words of the model.
MIN_COUNT = 5
#: Step of context vectors and tree nodes, and what their squared gradients start at.
STEP, DAMP = 0.1, 0.1
#: Inner nodes next to the root whose scores are taken by one product with all of them.
TOP = 255
#: Rows with more parts than that are added up one by one.
EACH = 16
#: Vectors sent as one row when models are averaged.
CHUNK = 1024
#: Training tokens of a task for each word of the model, or more: what tasks send then stays in proportion to the text, however large the model is.
TOKENS_A_WORD = 12
#: Bytes of texts whose words are hashed and scored at once.
PIECE = 1 << 20
END = "\n"  # no word holds a line feed


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def hashed_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Offsets and hashes of the tokens, with an end after each text; which of them are words; (bytes, first, end) of the words."""
    bounds, h, spans = hashed_words(texts, lower=True)
    at = bounds + np.arange(len(bounds))
    inner = np.ones(at[-1], dtype=bool)
    inner[at[1:] - 1] = False
    out = np.full(at[-1], word_hashes(pa.array([END]))[0])
    out[inner] = h
    return at, out, inner, spans


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of single words as in running text; the end's is 0."""
    bounds, h, _ = hashed_words(words, lower=True)
    out = np.zeros(len(words), dtype=np.uint64)
    out[np.diff(bounds) > 0] = h
    return out


def word_strings(spans: tuple[np.ndarray, np.ndarray, np.ndarray], which: np.ndarray) -> pa.Array:
    """The words with these numbers, lower-cased."""
    data, first, end = spans
    n = end[which] - first[which]
    at = np.concatenate([[0], np.cumsum(n)])
    raw = data[np.arange(at[-1]) + np.repeat(first[which] - at[:-1], n)]
    raw = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.astype(np.uint8))]).cast(pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: of all documents given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, size=PIECE):
                _, h, spans = hashed_words(b.column("text"), lower=True)
                _, at, n = np.unique(h, return_index=True, return_counts=True)
                words = pa.concat_arrays([word_strings(spans, at), pa.array([END])])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, len(b)), pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Numbers of words: the end 0, frequent words, the words of the tree, and last all words too rare for the model."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, total: int):
        end = word_hashes(pa.array([END]))[0]
        order = np.lexsort((hashes, -counts))
        self.classes = 1 + min(CLASSES, len(order))  # with the end; the number of the shared class
        self.rare = 1 + len(order)
        self.counts = np.concatenate([[ends], counts[order], [total - ends - counts.sum()]]).astype(float)
        own = np.concatenate([[end], hashes[order]])
        self.number = np.argsort(own)
        self.hashes = own[self.number]
        # Where the hashes with the same first bits begin; these are as many as words or fewer.
        self.shift = np.uint64(64 - min(24, max(1, len(own).bit_length())))
        self.begin = np.searchsorted(self.hashes, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)
        self.class_counts = np.append(self.counts[: self.classes], self.counts[self.classes :].sum())
        self.parent, self.side, self.odds = huffman(self.counts[self.classes :])
        # Inner nodes are numbered by weight, the root last; how many steps of each leaf lie below the top ones.
        self.top, leaves = max(0, len(self.odds) - TOP), len(self.odds) + 1
        self.deep, at = np.zeros(leaves, dtype=np.int64), np.arange(leaves)
        while (low := (self.parent[at] >= 0) & (self.parent[at] - leaves < self.top)).any():
            at = np.where(low, self.parent[at], at)
            self.deep += low

    def numbers(self, words: pa.Array) -> np.ndarray:
        return self.numbers_of(word_hashes(words))

    def numbers_of(self, h: np.ndarray) -> np.ndarray:
        slot, last = self.begin.take((h >> self.shift).astype(np.int64)), len(self.hashes) - 1
        slot = np.minimum(slot, last)
        found = self.hashes.take(slot)
        at = np.flatnonzero(found < h)
        while len(at):  # few hashes share their first bits
            ahead = np.minimum(slot[at] + 1, last)
            there = self.hashes.take(ahead)
            slot[at], found[at] = ahead, there
            at = at[(there < h[at]) & (ahead < last)]
        return np.where(found == h, self.number.take(slot), self.rare)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent and side of each node of a Huffman tree (leaves first, the root last), and the log odds of sides at inner nodes."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    weight = [*(counts[order] + 0.5).tolist(), *[0.0] * (n - 1)]
    ids = [*order.tolist(), *range(n, 2 * n - 1)]
    parent, side, odds = np.full(2 * n - 1, -1, dtype=np.int32), np.zeros(2 * n - 1, dtype=np.int8), np.zeros(n - 1)
    leaf, inner = 0, n
    for new in range(n, 2 * n - 1):
        pair = []
        for _ in range(2):
            if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                pair.append(leaf)
                leaf += 1
            else:
                pair.append(inner)
                inner += 1
        x, y = pair
        weight[new], odds[new - n] = weight[x] + weight[y], np.log(weight[y] / weight[x])
        parent[ids[x]] = parent[ids[y]] = new
        side[ids[y]] = 1
    return parent, side, odds


def start_model(counts: np.ndarray, odds: np.ndarray | None = None, seed: int = 7) -> list[np.ndarray]:
    """Context vectors, two position weights, class vectors and biases, then tree nodes with a bias each; without odds no tree.

    Biases start at the log frequencies, so that the model starts at the shares of the counts.
    """
    rng, n = np.random.default_rng(seed), len(counts)
    bias = np.log((counts + 1) / (counts.sum() + n))
    odds = np.zeros(0) if odds is None else odds
    words = n + len(odds)
    parts = rng.normal(0, 0.1, (words, WIDTH)), np.ones((2, WIDTH)) / 2, rng.normal(0, 0.1, (n, WIDTH)), bias, np.column_stack([np.zeros((len(odds), WIDTH)), odds])
    return [x.astype(np.float32) for x in parts]


def way(v: Vocabulary, leaf: np.ndarray):
    """Steps from leaves to the root; ``leaf`` comes by falling v.deep.

    Below the top nodes for each level how many rows (always the first ones) take it, the inner nodes and sides of all
    levels; of the top nodes rows, columns and sides.
    """
    leaves, deep, at = len(v.parent) // 2 + 1, -v.deep[leaf], leaf.copy()
    counts = [int(np.searchsorted(deep, -level)) for level in range(-deep[0] if len(deep) else 0)]
    inner, sides = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
    for k in counts:
        up = v.parent.take(at[:k])
        inner.append(up - leaves)
        sides.append(v.side.take(at[:k]))
        at[:k] = up
    rows, top = np.arange(len(leaf)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8))]
    up = v.parent.take(at)
    while len(keep := np.flatnonzero(up >= 0)):
        if len(keep) < len(rows):
            rows, at, up = rows[keep], at[keep], up[keep]
        top.append((rows, up - leaves - v.top, v.side.take(at)))
        at = up
        up = v.parent.take(at)
    return counts, np.concatenate(inner), np.concatenate(sides), *(np.concatenate(x) for x in zip(*top, strict=True))


class Groups:
    """Equal numbers among many: the distinct ones, how many there are of each, and where each of the many is among them."""

    def __init__(self, rows: np.ndarray):
        # Sorted together with their places, which is faster than finding an order of the numbers alone.
        key = np.sort((rows.astype(np.int64) << 31) | np.arange(len(rows)))
        self.order, ordered = key & ((1 << 31) - 1), key >> 31
        self.first = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), bool), ordered[1:] != ordered[:-1]]))
        self.rows, self.n = ordered.take(self.first), np.diff(np.append(self.first, len(rows)))
        self.which = np.empty(len(rows), dtype=np.int64)
        self.which[self.order] = np.repeat(np.arange(len(self.rows)), self.n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of x for each distinct number: the second of each is added, the third and so on; what has very many at once."""
        # The most frequent first, so that those with a further part are always the first ones.
        by = np.sort((-self.n << 31) | np.arange(len(self.n))) & ((1 << 31) - 1)
        first, n = self.first.take(by), self.n.take(by)
        out = x.take(self.order.take(first), axis=0)
        more = np.searchsorted(-n, -np.arange(1, EACH + 1))
        for j, k in enumerate(more[:-1].tolist(), 1):
            if not k:
                break
            out[:k] += x.take(self.order.take(first[:k] + j), axis=0)
        for i in range(more[-1]):
            out[i] += x.take(self.order[first[i] + EACH : first[i] + n[i]], axis=0).sum(axis=0)
        place = np.empty(len(n), dtype=np.int64)
        place[by] = np.arange(len(n))
        return out.take(place, axis=0)


def step_rows(table: np.ndarray, squares: np.ndarray, touched: np.ndarray, rows: np.ndarray, old: np.ndarray, g: np.ndarray, n: np.ndarray, rate: float) -> None:
    """A step from the old values of some rows, smaller the more they have moved, so that rare rows learn too. Writes over g."""
    moved = squares.take(rows) + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
    squares[rows] = moved
    touched[rows] += n
    g *= (np.float32(rate) / np.sqrt(moved + np.float32(DAMP)))[:, None]
    g += old
    table[rows] = g


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def with_one(x: np.ndarray) -> np.ndarray:
    """The rows with a last column of ones, for the biases."""
    out = np.empty((len(x), x.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = x, 1
    return out


def log_one_and_exp(x: np.ndarray) -> np.ndarray:
    """log(1 + exp(x)), without overflow."""
    return np.maximum(x, 0) + np.log(1 + np.exp(-np.abs(x)))


def contexts(classes: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token; before a text stand ends."""
    one, two = np.roll(classes, 1), np.roll(classes, 2)
    first = at[:-1]
    one[first], two[first] = end, end
    second = (first + 1)[first + 1 < at[1:]]
    two[second] = end
    return one, two


def nce_batch(model: list[np.ndarray], moved: list[np.ndarray], v: Vocabulary, one, two, word, log_noise, noise, rate: float) -> None:
    """One step on a batch; the noise words are shared by its tokens. Unnormalised scores are taken as log-probabilities."""
    vec, pos, out, bias, node = model
    n, scale, pace = len(word), rate * 256 / len(word), STEP * rate / RATE
    near = Groups(np.concatenate([one, two]))
    vectors = vec.take(near.rows, axis=0)
    a, b = vectors.take(near.which[:n], axis=0), vectors.take(near.which[n:], axis=0)
    q = a * pos[0] + b * pos[1]
    bar = bias - log_noise - np.float32(np.log(len(noise)))
    leaf, word = word - v.classes, np.minimum(word, v.classes)
    own = out.take(word, axis=0)
    up = 1 - sigmoid(np.einsum("ij,ij->i", q, own) + bar.take(word))
    down = q @ out[noise].T
    down += bar[noise]
    down = np.negative(sigmoid(down), out=down)
    own *= up[:, None]
    gq = own + down @ out[noise]
    cells = (word[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    g_out = np.bincount(cells, (up[:, None] * q).ravel(), minlength=out.size).astype(np.float32).reshape(out.shape)
    g_bias = np.bincount(word, up, minlength=len(out))
    np.add.at(g_out, noise, down.T @ q)
    np.add.at(g_bias, noise, down.sum(axis=0))
    inside = np.flatnonzero(leaf >= 0)
    inside = inside[np.argsort(-v.deep[leaf[inside]], kind="stable")]
    counts, inner, side, rows, columns, top_side = way(v, leaf[inside])
    qi, g_in = with_one(q.take(inside, axis=0)), np.zeros((len(inside), WIDTH), np.float32)
    if len(inner):
        deep = Groups(inner)
        old = node.take(deep.rows, axis=0)
        steps, at = old.take(deep.which, axis=0), 0
        for k in counts:
            x = steps[at : at + k]
            g = side[at : at + k] - sigmoid(np.einsum("ij,ij->i", qi[:k], x))
            g_in[:k] += g[:, None] * x[:, :-1]
            np.multiply(g[:, None], qi[:k], out=x)
            at += k
        step_rows(node, moved[2], moved[3], deep.rows, old, deep.sums(steps), deep.n, pace)
    if len(rows):
        old = node[v.top :]
        every, cells = np.zeros((len(qi), len(old)), np.float32), rows * len(old) + columns
        every.ravel()[cells] = top_side - sigmoid((qi @ old.T).ravel().take(cells))
        g_in += every @ old[:, :-1]
        times = np.bincount(columns, minlength=len(old))
        used = np.flatnonzero(times)
        step_rows(node, moved[2], moved[3], used + v.top, old[used], (every.T @ qi)[used], times[used], pace)
    gq[inside] += g_in
    step_rows(vec, moved[0], moved[1], near.rows, vectors, near.sums(np.concatenate([gq * pos[0], gq * pos[1]])), near.n, pace)
    pos += rate * np.stack([np.einsum("ij,ij->j", gq, a), np.einsum("ij,ij->j", gq, b)]) / n
    out += np.clip(scale * g_out, -0.5, 0.5)
    bias += np.clip(scale * g_bias, -0.5, 0.5)


def put(spark, what) -> str:
    """Write to the shared folder once; in a closure each executor would store it."""
    path = fresh_path(spark, "model")
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        pickle.dump(what, out, protocol=5)
    return path


def get(path: str):
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return pickle.loads(f.read())


def remove(path: str) -> None:
    store, at = fs.FileSystem.from_uri(path)
    store.delete_file(at)


def training_tasks(v: Vocabulary) -> int:
    """How many tasks train at most."""
    return max(1, int(v.counts.sum()) // (TOKENS_A_WORD * (v.rare + 1)))


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> list[np.ndarray]:
    """The averaged model, trained on all documents given."""
    model = start_model(v.class_counts, v.odds)
    noise_p = (v.class_counts + 1) / (v.class_counts.sum() + len(v.class_counts))
    shapes = [x.shape for x in model]
    for step in range(rounds):
        path = put(docs.sparkSession, (v, model))

        def fit(batches: Iterator[pa.RecordBatch], path=path, step=step) -> Iterator[pa.RecordBatch]:
            v, own = get(path)
            rng, seen = np.random.default_rng(step), 0
            moved = [np.zeros(len(own[k]), t) for k in (0, 4) for t in (np.float32, np.int64)]
            log_noise = np.log(noise_p).astype(np.float32)
            for b in batches:
                parts = [hashed_tokens(x.column("text"))[:2] for x in pieces(b, size=PIECE)]
                if not parts:
                    continue
                numbers = v.numbers_of(np.concatenate([h for _, h in parts]))
                starts = np.cumsum([0, *(len(h) for _, h in parts)])
                at = np.concatenate([*(x[:-1] + i for (x, _), i in zip(parts, starts[:-1], strict=True)), starts[-1:]])
                one, two = contexts(numbers, at, 0)
                for i in range(0, len(numbers), 4096):
                    s = slice(i, i + 4096)
                    nce_batch(own, moved, v, one[s], two[s], numbers[s], log_noise, rng.choice(len(noise_p), NOISE, p=noise_p), rate / (1 + step))
                seen += len(numbers)
            if seen:
                for part, x in enumerate(own):
                    x = x if x.ndim > 1 else x[:, None]
                    n = {0: moved[1], 4: moved[3]}.get(part, np.full(len(x), seen))
                    rows = np.flatnonzero(n)
                    cut = np.searchsorted(rows, np.arange(0, len(x) + CHUNK, CHUNK))
                    for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                        if i < j:
                            yield pa.RecordBatch.from_pydict({"part": [part], "chunk": [k], "rows": [rows[i:j].astype(np.int32).tobytes()], "n": [n[rows[i:j]].tobytes()], "x": [x[rows[i:j]].tobytes()]})

        def mean(key, t):
            part, chunk = (k.as_py() for k in key)
            width = int(np.prod(shapes[part][1:]))
            total, weight = np.zeros((CHUNK, width)), np.zeros(CHUNK)
            for rows, n, x in zip(*(t.column(c).to_pylist() for c in ("rows", "n", "x")), strict=True):
                rows, n = np.frombuffer(rows, np.int32) - chunk * CHUNK, np.frombuffer(n, np.int64)
                weight[rows] += n
                total[rows] += n[:, None] * np.frombuffer(x, np.float32).reshape(len(rows), width)
            rows = np.flatnonzero(weight)
            return pa.table({"part": [part], "rows": [(rows + chunk * CHUNK).astype(np.int32).tobytes()], "x": [(total[rows] / weight[rows, None]).astype(np.float32).tobytes()]})

        # As many vectors as the model has.
        models = docs.select("text").coalesce(training_tasks(v)).mapInArrow(fit, "part long, chunk long, rows binary, n binary, x binary")
        means = stash(models.groupBy("part", "chunk").applyInArrow(mean, "part long, rows binary, x binary"), "model")
        for got in means.toLocalIterator():
            rows = np.frombuffer(got.rows, np.int32)
            model[got.part][rows] = np.frombuffer(got.x, np.float32).reshape(len(rows), *shapes[got.part][1:])
        discard(means)
        remove(path)
    return model


def log_probabilities(model: list[np.ndarray], one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Normalised natural log-probabilities of classes; each distinct context is normalised once."""
    vec, pos, out, bias = model[:4]
    q = lambda a, b: with_one(vec.take(a, axis=0) * pos[0] + vec.take(b, axis=0) * pos[1])
    weights = np.column_stack([out, bias])
    across, ones = np.ascontiguousarray(weights.T), np.ones(len(weights), np.float32)
    longest = np.sqrt(np.einsum("ij,ij->i", weights, weights).max())
    pair, which = np.unique(one * len(vec) + two, return_inverse=True)
    first, second = np.divmod(pair, len(vec))
    z = np.empty(len(pair))
    for i in range(0, len(pair), 256):  # so that a block stays in the processor's cache
        x = q(first[i : i + 256], second[i : i + 256])
        s = x @ across
        if longest * np.sqrt(np.einsum("ij,ij->i", x, x).max()) < 60:  # no score is beyond it, so no exponential leaves the range of its type
            z[i : i + 256] = np.log(np.exp(s, out=s) @ ones)
            continue
        top = s.max(axis=1)
        s -= top[:, None]
        z[i : i + 256] = top + np.log(np.exp(s, out=s) @ ones)
    score = np.empty(len(word))
    for i in range(0, len(word), 8192):
        s = slice(i, i + 8192)
        score[s] = np.einsum("ij,ij->i", q(one[s], two[s]), weights.take(word[s], axis=0))
    return score - z[which]


def tree_log_probabilities(model: list[np.ndarray], v: Vocabulary, one: np.ndarray, two: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of leaves within the shared class."""
    vec, pos, node = model[0], model[1], model[4]
    p = np.zeros(len(leaf))
    for i in range(0, len(leaf), 4096):
        own = i + np.argsort(-v.deep[leaf[i : i + 4096]], kind="stable")
        q = with_one(vec.take(one[own], axis=0) * pos[0] + vec.take(two[own], axis=0) * pos[1])
        counts, inner, side, rows, columns, top_side = way(v, leaf[own])
        at, sums = 0, np.zeros(len(own))
        for k in counts:
            s = np.einsum("ij,ij->i", q[:k], node.take(inner[at : at + k], axis=0))
            sums[:k] += log_one_and_exp(np.where(side[at : at + k] == 1, -s, s))
            at += k
        if len(rows):
            s = (q @ node[v.top :].T).ravel().take(rows * (len(node) - v.top) + columns)
            sums += np.bincount(rows, log_one_and_exp(np.where(top_side == 1, -s, s)), minlength=len(own))
        p[own] = -sums
    return p


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    training = rows.where("NOT held_out")
    counts = stash(word_counts(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = (counts.where(F.col("word") == END).first() or [END, 0])[1]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(b.column("word")).view(np.int64)), b.column("c")], names=["h", "c"])

    # As many rows as the model has words.
    got = counts.where((F.col("word") != END) & (F.col("c") >= MIN_COUNT)).mapInArrow(hashed, "h long, c long").toArrow()
    v = Vocabulary(got.column("h").to_numpy().astype(np.int64).view(np.uint64), got.column("c").to_numpy(), ends, total)
    path, rare, rare_count = put(spark, (v, train(training, v))), v.rare, v.counts[-1]

    share = lambda c, n, kinds: (c + 0.5) / (n + 0.5 * (kinds + 1))
    n_rare = max(0, distinct - rare)
    names_ = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "row", "word", "times"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.int64()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, without what words too rare for the model add, and a row for each of these and document."""
        v, model = get(path)
        known = np.append(v.counts[: v.rare] > 0, False)
        base = np.append(np.log10(share(v.counts[: v.rare], total, distinct)), 0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for b in pieces(batch, size=PIECE):
                at, h, inner, spans = hashed_tokens(b.column("text"))
                numbers = v.numbers_of(h)
                one, two = contexts(numbers, at, 0)
                p = log_probabilities(model, one, two, np.minimum(numbers, v.classes)).astype(float)
                inside = np.flatnonzero(numbers >= v.classes)
                p[inside] += tree_log_probabilities(model, v, one[inside], two[inside], numbers[inside] - v.classes)
                sums = [np.add.reduceat(x, at[:-1]) for x in (known[numbers].astype(np.int64), base[numbers], p / np.log(10))]
                ids = row + np.arange(len(b))
                cols = [b.column("doc_id"), b.column("held_out"), np.diff(at), *sums, ids]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types[:7], strict=True)), *(pa.nulls(len(b), t) for t in types[7:])], names=names_)
                few = np.flatnonzero((numbers == v.rare) & inner)
                words = pc.dictionary_encode(word_strings(spans, (np.cumsum(inner) - 1)[few]))
                code, times = np.unique(np.repeat(np.arange(len(b)), np.diff(at))[few] * (len(words.dictionary) + 1) + words.indices.to_numpy(), return_counts=True)
                which, code = np.divmod(code, len(words.dictionary) + 1)
                cols = [ids[which], words.dictionary.take(pa.array(code)), times]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(times), t) for t in types[:6]), *(pa.array(c, t) for c, t in zip(cols, types[6:], strict=True))], names=names_)
                row += len(b)

    spec = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, row long, word string, times long"
    # Numbered and written once, so that both kinds of rows agree.
    judged = stash(rows.mapInArrow(judge, spec), "judged")
    remove(path)
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    few = judged.where("word IS NOT NULL").select("row", "word", "times").join(counts.where(F.col("c") < MIN_COUNT), "word", "left")
    add = few.groupBy("row").agg(
        F.sum(F.when(c > 0, times).otherwise(0)).alias("known"),
        F.sum(times * F.log10(share(c, total, distinct))).alias("base"),
        F.sum(times * F.log10(share(c, float(rare_count), n_rare))).alias("p"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    out = judged.where("word IS NULL").drop("word", "times").join(add, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "known"), F.lit(int(total)).cast("long").alias("train_tokens"), plus("base_score", "base"), plus("score", "p"))


def op3(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


#: Without the model's score, which SQL cannot express; the tests hold base columns against it.
BASE_SQL = r"""
WITH t AS (SELECT doc_id, held, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10))) AS w FROM docs),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, count(*) AS n_tokens, count(c.c) AS n_known, max(n) AS train_tokens, sum(log10((coalesce(c.c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id
"""
