"""Language-model scores of a log-bilinear model fitted by noise-contrastive estimation.

The model predicts a token's vector from the vectors of the two tokens before it,
each scaled dimension by dimension, and gives every class of tokens a score: the
product with its own vector plus a bias.  Classes are the most frequent words, the
end of a text, and one for all other words; within that one a word has its
smoothed share of the counts, unseen words together the share of one.  So the
probabilities of all possible next tokens add up to one.

Counts come from all training texts.  Training goes over all of them, too, once,
in ``ROUNDS`` parts: every task starts from the last round's parameters and tells
data from noise words on its own rows (shared noise for each batch of tokens);
the parameters are averaged by the number of tokens.  What comes to the driver is
the size of the model, or at most ``LISTED`` words.

The most frequent words, at most ``LISTED``, are known to every task with their
counts.  All other words meet their counts in a join; each makes up little more
than one token in ``LISTED`` at most, so none is hot.

Odd rows: a null text is empty and has one token, its end.  A null id counts as
the empty text in the choice of held-out rows.  Repeated rows count and are scored
each for itself.  Words over ``LONG_WORD`` bytes are told apart by their SHA-256.
Long texts are read in pieces.  Without any training text all known words are
equally likely.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import body, saved

LISTED = 200_000
# Frequencies are told apart by this many steps to the power of two when the list is cut.
STEPS = 16
CLASSES = 1024
WIDTH = 16
ROUNDS = 3
BATCH = 2048
# Noise words drawn for a batch, and how many a token counts as compared with.
NOISE = 32
RATIO = 20
RATE = 0.1
LONG_WORD = 64
# Bytes of text that are handled at once, and classes times contexts in scoring.
PIECE = 8 << 20
_CELLS = 4 << 20
# Parameters travel as whole numbers, so that their sums do not depend on the order of tasks.
_FIXED = 1 << 20

END, REST = b"", 0
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut at white space into pieces a task can hold."""
    at = 0
    while len(text) - at > PIECE:
        cut = _GAP.search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about a piece of text each."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch["text"])), dtype="int64")
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Row numbers and lower-cased words of the texts, a part of them at a time."""
    if len(texts) == 1 and len(texts[0].as_buffer()) > PIECE:
        parts = (pa.array([piece.decode()]) for piece in pieces(texts[0].as_py().encode()))
    else:
        parts = iter([texts])
    for part in parts:
        # Arrow's white space is the six ASCII characters, and its lower case A-Z only.
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part))
        found = lists.flatten()
        size = np.asarray(pc.binary_length(found))
        at = np.repeat(np.arange(len(part)), np.asarray(pc.list_value_length(lists)))
        if not size.all():
            found, at, size = found.filter(pa.array(size > 0)), at[size > 0], size[size > 0]
        found = found.cast(pa.binary())
        if (size > LONG_WORD).any():
            long = pa.array(size > LONG_WORD)
            named = [b" " + hashlib.sha256(w.as_buffer()).hexdigest().encode() for w in found.filter(long)]
            found = pc.replace_with_mask(found, long, pa.array(named, pa.binary()))
        yield at, found


# --- counts ---------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of each slice: in all rows (n), in those to learn from (c)."""

    def counts(found: pa.Array, training: bool) -> pa.RecordBatch:
        seen = found.value_counts()
        n = seen.field("counts")
        return pa.record_batch({"word": seen.field("values"), "n": n, "c": n if training else pa.array(np.zeros(len(n), "int64"))})

    for batch in batches:
        for training in (True, False):
            rows = batch.filter(batch["training"] if training else pc.invert(batch["training"]))
            if len(rows):
                yield counts(pa.array([END] * len(rows), pa.binary()), training)
            for part in slices(rows):
                for _, found in words(part["text"]):
                    yield counts(found, training)


@dataclass
class Vocabulary:
    """Totals and the listed words with their class and the logarithms of their shares."""

    tokens: int
    kinds: int
    words: list[bytes]
    classes: np.ndarray
    base: np.ndarray
    known: np.ndarray
    rest: np.ndarray
    sizes: np.ndarray
    rest_tokens: int
    rest_kinds: int

    @property
    def base_total(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)

    @property
    def rest_total(self) -> float:
        return self.rest_tokens + 0.5 * (self.rest_kinds + 1)


def vocabulary(counts: DataFrame, classes: int = CLASSES) -> Vocabulary:
    tokens, kinds = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    tokens = tokens or 0
    # The lowest step of frequencies down to which the words still fit the list.
    step = F.floor(F.log2("n") * STEPS)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    least, held = None, 0
    for row in sorted(sizes, reverse=True):
        held += row["words"]
        if held > LISTED:
            break
        least = row["step"]
    rows = counts.filter(step >= F.lit(least if least is not None else 1 << 62)).select("word", "c").toArrow()
    listed = list(zip(rows["word"].to_pylist(), rows["c"].to_pylist()))
    listed = sorted((w for w in listed if w[0] != END), key=lambda w: (-w[1], w[0]))
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    listed.insert(0, (END, ends))
    chosen = [k for k, (w, c) in enumerate(listed) if w == END or c > 0][: classes - 1]
    class_of = np.zeros(len(listed) + 1, dtype="uint16")
    class_of[chosen] = np.arange(1, len(chosen) + 1)
    c = np.array([n for _, n in listed] + [0], dtype="float64")
    in_class = c[chosen]
    rest_tokens = int(tokens - in_class.sum())
    rest_kinds = int(kinds - (in_class > 0).sum())
    base = np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))
    rest = np.where(class_of == REST, np.log10((c + 0.5) / (rest_tokens + 0.5 * (rest_kinds + 1))), 0.0)
    base[-1] = rest[-1] = 0.0
    sizes = np.concatenate([[rest_tokens], in_class]) + 0.5
    return Vocabulary(
        int(tokens), int(kinds), [w for w, _ in listed], class_of, base, c > 0, rest, sizes, rest_tokens, rest_kinds
    )


def _encoded(vocab: Vocabulary):
    """Each text as classes, with what its listed words add up to, and its other words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, last = pa.array(vocab.words, pa.binary()), len(vocab.words)
        end = vocab.words.index(END)
        tail = vocab.classes[end].tobytes()
        for batch in (part for whole in batches for part in slices(whole)):
            n = len(batch)
            classes, others, owner = [b""] * n, [], []
            sums = np.zeros((3, n))
            sizes = np.zeros(n, dtype="int64")
            for at, found in words(batch["text"]):
                coded = np.asarray(pc.index_in(found, value_set=listed).fill_null(last))
                for s, table in enumerate((vocab.base, vocab.known, vocab.rest)):
                    sums[s] += np.bincount(at, weights=table[coded], minlength=n)
                counted = np.bincount(at, minlength=n)
                sizes += counted
                kinds = vocab.classes[coded].tobytes()
                edges = np.concatenate([[0], np.cumsum(counted)]) * 2
                for i in np.flatnonzero(counted).tolist():
                    classes[i] += kinds[edges[i] : edges[i + 1]]
                new = coded == last
                others.append(found.filter(pa.array(new)))
                owner.append(at[new])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(owner), minlength=n))]).astype("int32")
            yield pa.record_batch(
                {
                    "row": batch["row"],
                    "doc_id": batch["doc_id"],
                    "training": batch["training"],
                    "n_tokens": pa.array(sizes + 1),
                    "classes": pa.array([x + tail for x in classes], pa.binary()),
                    "base": pa.array(sums[0] + vocab.base[end]),
                    "known": pa.array(sums[1].astype("int64") + int(vocab.known[end])),
                    "rest": pa.array(sums[2]),
                    "others": pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(others)),
                }
            )

    return task


# --- the model ------------------------------------------------------------------------


@dataclass
class Model:
    """Vectors of context tokens (one more for the start) and of predicted classes, biases, scales of the two places."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    place: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.bias, self.place]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def filled(self, values: np.ndarray) -> Model:
        cuts = np.cumsum([x.size for x in self.parts()])[:-1]
        return Model(*[v.reshape(x.shape).astype("float32") for v, x in zip(np.split(values, cuts), self.parts())])


def initial(sizes: np.ndarray, width: int = WIDTH) -> Model:
    """Small random vectors; biases are the logarithms of the classes' shares."""
    rng, k = np.random.default_rng(13), len(sizes)
    small = lambda rows: rng.normal(0, 0.1, (rows, width)).astype("float32")
    return Model(small(k + 1), small(k), np.log(sizes / sizes.sum()).astype("float32"), np.ones((2, width), dtype="float32"))


def contexts(classes: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; ``start`` before a text's first."""
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("int64")
    one, two = np.roll(classes, 1), np.roll(classes, 2)
    one[firsts] = two[firsts] = start
    seconds = firsts[sizes > 1] + 1
    two[seconds] = start
    return one, two


def _tokens(batch: pa.RecordBatch | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = batch if isinstance(batch, list) else batch["classes"].to_pylist()
    return np.frombuffer(b"".join(rows), dtype="uint16").astype("int64"), np.array([len(x) // 2 for x in rows], dtype="int64")


def _added(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` at each index."""
    width = values.shape[1]
    flat = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(flat, weights=values.ravel(), minlength=rows * width).reshape(rows, width)


class Trainer:
    """Noise-contrastive estimation by batches, with steps scaled by past gradients (Adagrad)."""

    def __init__(self, model: Model, sizes: np.ndarray, seed: int):
        self.model = Model(*[x.copy() for x in model.parts()])
        share = sizes / sizes.sum()
        self.edges = np.cumsum(share)
        self.offset = np.log(RATIO * share).astype("float32")
        self.seen = [np.full(x.shape, 1.0, dtype="float32") for x in model.parts()]
        self.rng = np.random.default_rng(seed)

    def step(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, k = self.model, len(self.edges)
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), k - 1)
        r1, r2, q, qn = m.context[one], m.context[two], m.target[token], m.target[noise]
        h = m.place[0] * r1 + m.place[1] * r2
        data = np.einsum("bd,bd->b", h, q) + m.bias[token] - self.offset[token]
        other = h @ qn.T + (m.bias[noise] - self.offset[noise])
        up = 1 / (1 + np.exp(np.clip(data, -30, 30)))
        down = (-RATIO / NOISE) / (1 + np.exp(-np.clip(other, -30, 30)))
        dh = up[:, None] * q + down @ qn
        target = _added(token, up[:, None] * h, k) + _added(noise, down.T @ h, k)
        bias = np.bincount(token, weights=up, minlength=k) + np.bincount(noise, weights=down.sum(axis=0), minlength=k)
        context = _added(one, m.place[0] * dh, k + 1) + _added(two, m.place[1] * dh, k + 1)
        place = np.stack([(dh * r1).sum(axis=0), (dh * r2).sum(axis=0)])
        for x, past, slope in zip(m.parts(), self.seen, (context, target, bias, place)):
            slope = slope.astype("float32")
            past += slope * slope
            x += RATE * slope / np.sqrt(past)

    def learn(self, classes: np.ndarray, sizes: np.ndarray) -> None:
        one, two = contexts(classes, sizes, len(self.edges))
        for lo in range(0, len(classes), BATCH):
            cut = slice(lo, lo + BATCH)
            self.step(classes[cut], one[cut], two[cut])


def _trained(model: Model, sizes: np.ndarray, seed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, tokens = Trainer(model, sizes, seed), 0
        for batch in batches:
            if len(batch):
                classes, lengths = _tokens(batch)
                trainer.learn(classes, lengths)
                tokens += len(classes)
        if tokens:
            values = np.rint(trainer.model.flat().astype("float64") * _FIXED).astype("int64")
            yield pa.record_batch({"at": pa.array(np.arange(len(values))), "value": pa.array(values), "tokens": pa.array(np.full(len(values), tokens))})

    return task


def fit(encoded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, width: int = WIDTH) -> Model:
    """Each round trains on its part of all training rows and averages the tasks' parameters."""
    model = initial(vocab.sizes, width)
    rows = encoded.filter("training").select("classes", F.pmod(F.xxhash64("row"), F.lit(rounds)).alias("part"))
    for r in range(rounds):
        found = rows.filter(F.col("part") == r).select("classes").mapInArrow(_trained(model, vocab.sizes, r), "at long, value long, tokens long")
        sums = found.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)") * F.col("tokens")).alias("v"), F.sum("tokens").alias("t"))
        means = sums.select("at", (F.col("v").cast("double") / F.col("t") / _FIXED).alias("mean")).toPandas()
        if len(means):
            values = model.flat().astype("float64")
            values[means["at"].to_numpy()] = means["mean"].to_numpy()
            model = model.filled(values)
    return model


def log_probabilities(model: Model, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token's class given the two before it, normalised over all classes."""
    start = len(model.bias)
    one, two = contexts(classes, sizes, start)
    pair = one * (start + 1) + two
    here = np.zeros((start + 1) ** 2, dtype=bool)
    here[pair] = True
    distinct = np.flatnonzero(here)
    number = np.zeros(len(here), dtype="int32")
    number[distinct] = np.arange(len(distinct))
    at = number[pair]
    h = model.place[0] * model.context[distinct // (start + 1)] + model.place[1] * model.context[distinct % (start + 1)]
    norm = np.empty(len(distinct))
    step = max(1, _CELLS // start)
    for lo in range(0, len(distinct), step):
        s = h[lo : lo + step] @ model.target.T
        s += model.bias
        top = s.max(axis=1)
        s -= top[:, None]
        norm[lo : lo + step] = np.log(np.exp(s, out=s).sum(axis=1)) + top
    out = np.empty(len(classes))
    for lo in range(0, len(classes), 1 << 18):
        cut = slice(lo, lo + (1 << 18))
        out[cut] = np.einsum("bd,bd->b", h[at[cut]], model.target[classes[cut]]) + model.bias[classes[cut]] - norm[at[cut]]
    return out


def _class_scores(model: Model):
    def scored(column: pa.Array) -> pa.Array:
        """log10 of the probability of each row's classes."""
        if not len(column):
            return pa.array([], pa.float64())
        out, rows, lo = [], column.to_pylist(), 0
        while lo < len(rows):
            hi, held = lo, 0
            while hi < len(rows) and (hi == lo or held + len(rows[hi]) <= PIECE // 4):
                held += len(rows[hi])
                hi += 1
            classes, sizes = _tokens(rows[lo:hi])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("int64")
            out.append(np.add.reduceat(log_probabilities(model, classes, sizes), starts) / np.log(10))
            lo = hi
        return pa.array(np.concatenate(out))

    return F.arrow_udf(scored, "double")


def language_scores(docs: DataFrame, held_out: Column, classes: int = CLASSES, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``base_score`` adds up the log10 of smoothed shares of single tokens, ``score``
    the log10 of the model's probabilities; both learn from rows not held out.
    """
    texts = docs.select("doc_id", (~held_out).alias("training"), body().alias("text"))
    counts = texts.select("text", "training").mapInArrow(_counted, "word binary, n long, c long")
    counts = saved(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "counts")
    vocab = vocabulary(counts, classes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "training", "text").mapInArrow(
        _encoded(vocab),
        f"row long, doc_id {kind}, training boolean, n_tokens long, classes binary, base double, known long, rest double, "
        "others array<binary>",
    )
    encoded = saved(encoded, "encoded")
    model = fit(encoded, vocab, rounds, width)
    others = encoded.select("row", F.explode("others").alias("word"))
    others = others.join(counts.filter(F.col("word") != F.lit(END)).select("word", "c"), "word")
    share = lambda total: F.sum(F.log10((F.col("c") + 0.5) / F.lit(total)))
    others = others.groupBy("row").agg(
        share(vocab.base_total).alias("o_base"), F.count_if(F.col("c") > 0).alias("o_known"), share(vocab.rest_total).alias("o_rest")
    )
    scored = encoded.select("row", "doc_id", "training", "n_tokens", "base", "known", "rest", _class_scores(model)("classes").alias("model"))
    zero = F.lit(0.0)
    return scored.join(others, "row", "left").select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("o_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("o_base", zero)).alias("base_score"),
        (F.col("model") + F.col("rest") + F.coalesce("o_rest", zero)).alias("score"),
    )
