"""Toxicity by a bidirectional gated recurrent network with attention (operator 3)."""

import functools
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import kept, table, utf8, words, worker_tables

# The sample that the network is fitted to: at most so many labelled rows of each class.
SAMPLE_PER_CLASS = 900
WINDOW, STRIDE = 24, 12
WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN = 1 << 14, 1 << 13, 8, 8
EPOCHS, RATE = 4, 0.02
# A worker keeps the table rows of so many words at most, and works out the triples of so many
# words at once.
KNOWN_WORDS, WORDS_AT_ONCE = 1 << 16, 1 << 13


class _Buckets(dict):
    """word -> row of the word table."""

    def __missing__(self, word):
        self[word] = row = zlib.crc32(word) % WORD_ROWS
        return row


@functools.lru_cache(maxsize=1)
def _rows():
    return _Buckets()


def features(distinct):
    """Of distinct words: their rows in the word table, and the rows of the table of
    character triples (with the word's ends) with where each word's triples begin."""
    import numpy as np

    known = _rows()
    rows, grams, sizes = [], [], np.array([len(w) for w in distinct], np.int64)  # as many triples as bytes
    for at in range(0, len(distinct), WORDS_AT_ONCE):
        part, own = distinct[at:at + WORDS_AT_ONCE], sizes[at:at + WORDS_AT_ONCE]
        if len(known) + len(part) > KNOWN_WORDS:
            known.clear()
        rows.append(np.fromiter(map(known.__getitem__, part), np.int64, len(part)))
        data = np.frombuffer(b" " + b"  ".join(part) + b" ", np.uint8).astype(np.int64)
        starts = np.repeat(np.arange(len(part)) * 2, own) + np.arange(int(own.sum()))
        triples = (data[starts] * 961 + data[starts + 1] * 31 + data[starts + 2]) * 40503 >> 4
        grams.append((triples % GRAM_ROWS).astype(np.int32))
    empty = np.empty(0, np.int64)
    return (np.concatenate([empty, *rows]), np.concatenate([empty.astype(np.int32), *grams]),
            np.cumsum(sizes) - sizes, sizes)


def initial(seed=7):
    import numpy as np

    draw = np.random.default_rng(seed)

    def made(*shape, scale=None):
        return (draw.standard_normal(shape) * (scale or (1 / shape[0]) ** 0.5)).astype(np.float32)

    model = {
        "word": made(WORD_ROWS, WIDTH, scale=0.3), "gram": made(GRAM_ROWS, WIDTH, scale=0.3),
        "attend": made(2 * HIDDEN, HIDDEN), "attend_b": np.zeros(HIDDEN, np.float32), "ask": made(HIDDEN),
        "out": made(2 * HIDDEN), "out_b": np.zeros(1, np.float32),
    }
    for side in ("f", "b"):
        model |= {f"in_{side}": made(2 * WIDTH, 3 * HIDDEN), f"u_{side}": made(HIDDEN, 3 * HIDDEN),
                  f"bias_{side}": np.zeros(3 * HIDDEN, np.float32)}
    return model


def inputs(model, found):
    """Vectors of distinct words: word row and mean of its character triples."""
    import numpy as np

    rows, grams, begins, sizes = found
    if not len(rows):
        return np.zeros((0, 2 * WIDTH), np.float32)
    vectors = np.empty((len(rows), 2 * WIDTH), np.float32)
    for at in range(0, len(rows), WORDS_AT_ONCE):
        part = slice(at, at + WORDS_AT_ONCE)
        first, last = begins[part][0], begins[part][-1] + sizes[part][-1]
        sums = np.add.reduceat(model["gram"][grams[first:last]], begins[part] - first, axis=0)
        vectors[part, :WIDTH] = model["word"][rows[part]]
        vectors[part, WIDTH:] = sums / sizes[part, None].astype(np.float32)
    return vectors


def windows(n):
    """Starts of overlapping windows over n words; every word lies in one at least."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE))


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _turn(gates, u, mask, states=None):
    """One direction: gates (steps, rows, 3H) of the inputs; the hidden states (steps, rows,
    H), and with `states` a list of what the way back needs."""
    import numpy as np

    h = np.zeros((gates.shape[1], HIDDEN), np.float32)
    out = np.empty((gates.shape[0], gates.shape[1], HIDDEN), np.float32)
    for t in range(gates.shape[0]):
        g, own = gates[t], h @ u
        zr = _sigmoid(g[:, :2 * HIDDEN] + own[:, :2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN:] + r * own[:, 2 * HIDDEN:])
        step = mask[t][:, None]
        if states is not None:
            states.append((h, z, r, n, own[:, 2 * HIDDEN:]))
        h = h + step * (1 - z) * (n - h)
        out[t] = h
    return out


def _turn_back(d_out, states, u, mask):
    """Gradients of the gates and of u."""
    import numpy as np

    d_gates, d_u = np.empty(d_out.shape[:2] + (3 * HIDDEN,), np.float32), np.zeros_like(u)
    d_h = np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(states) - 1, -1, -1):
        h, z, r, n, own = states[t]
        d_h = d_h + d_out[t]
        step = mask[t][:, None] * d_h
        d_n = step * (1 - z) * (1 - n * n)
        d_z = -step * (n - h) * z * (1 - z)
        d_r = d_n * own * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_own = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_u += h.T @ d_own
        d_h = d_h - step * (1 - z) + d_own @ u.T
    return d_gates, d_u


def logits(model, vectors, ids, mask, back=None):
    """Of windows: ids (steps, rows) of distinct words, mask of what is a word. With `back`
    (gradients of the logits), the gradients of the model and of the vectors instead."""
    import numpy as np

    gates = {s: vectors @ model[f"in_{s}"] + model[f"bias_{s}"] for s in "fb"}
    states = {"f": [], "b": []} if back is not None else {"f": None, "b": None}
    forth = _turn(gates["f"][ids], model["u_f"], mask, states["f"])
    reverse = _turn(gates["b"][ids[::-1]], model["u_b"], mask[::-1], states["b"])[::-1]
    both = np.concatenate([forth, reverse], axis=2)
    heard = np.tanh(both @ model["attend"] + model["attend_b"])
    weight = np.exp(np.clip(heard @ model["ask"], -30, 30)) * mask
    total = weight.sum(axis=0) + np.float32(1e-9)
    weight = weight / total
    context = (weight[:, :, None] * both).sum(axis=0)
    if back is None:
        return context @ model["out"] + model["out_b"]
    grads = {"out": context.T @ back, "out_b": back.sum(keepdims=True)}
    d_context = back[:, None] * model["out"]
    d_weight = (both * d_context).sum(axis=2)
    d_both = weight[:, :, None] * d_context
    d_ask = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grads["ask"] = np.einsum("trh,tr->h", heard, d_ask)
    d_heard = d_ask[:, :, None] * model["ask"] * (1 - heard * heard)
    grads["attend"] = np.einsum("trc,trh->ch", both, d_heard)
    grads["attend_b"] = d_heard.sum(axis=(0, 1))
    d_both = d_both + d_heard @ model["attend"].T
    d_vectors = np.zeros_like(vectors)
    for side, turned in (("f", slice(None)), ("b", slice(None, None, -1))):
        part = d_both[:, :, :HIDDEN] if side == "f" else d_both[:, :, HIDDEN:]
        d_gates, grads[f"u_{side}"] = _turn_back(part[turned], states[side], model[f"u_{side}"], mask[turned])
        by_word = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        np.add.at(by_word, ids[turned].ravel(), d_gates.reshape(-1, 3 * HIDDEN))
        grads[f"in_{side}"] = vectors.T @ by_word
        grads[f"bias_{side}"] = by_word.sum(axis=0)
        d_vectors += by_word @ model[f"in_{side}"].T
    return grads, d_vectors


def _laid_out(lengths, codes):
    """Windows of several texts: ids (steps, rows), mask, and the text of each."""
    import numpy as np

    starts, owner, begin = [], [], 0
    for text, n in enumerate(lengths):
        own = windows(n)
        starts += [begin + s for s in own]
        owner += [text] * len(own)
        begin += n
    ends = np.cumsum(lengths)[owner] if len(lengths) else np.empty(0, np.int64)
    at = np.array(starts, np.int64) + np.arange(WINDOW)[:, None]
    mask = at < ends
    padded = np.concatenate([codes, np.zeros(1, codes.dtype)])
    return padded[np.where(mask, at, len(codes))], mask.astype(np.float32), np.array(owner, np.int64)


def _coded(texts):
    """Distinct words of UTF-8 texts, their numbers in text order and the texts' lengths."""
    import numpy as np

    numbers, codes, lengths = {}, [], []
    for text in texts:
        found = words(text)
        for word in found:
            if word not in numbers:
                numbers[word] = len(numbers)
        codes.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
        lengths.append(len(found))
    return list(numbers), np.concatenate([*codes, np.empty(0, np.int64)]), lengths


def scores(model, texts, rows_at_once=1024):
    """Score of each whole text: its most toxic window's."""
    import numpy as np

    distinct, codes, lengths = _coded(texts)
    # One vector more, for the windows of texts without words.
    vectors = np.concatenate([inputs(model, features(distinct)), np.zeros((1, 2 * WIDTH), np.float32)])
    ids, mask, owner = _laid_out(lengths, codes)
    found = np.full(len(texts), -np.inf, np.float32)
    for at in range(0, len(owner), rows_at_once):
        part = slice(at, at + rows_at_once)
        np.maximum.at(found, owner[part], logits(model, vectors, ids[:, part], mask[:, part]))
    return _sigmoid(found.astype(np.float64))


def fit(texts, labels, seed=7):
    """The network fitted to whole texts. A text's windows share its label; the first time
    over, all of a text's (up to 40 drawn ones) count, later its most toxic and two drawn."""
    import numpy as np

    draw, model = np.random.default_rng(seed), initial(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    distinct, codes, lengths = _coded(texts)
    found = features(distinct)
    rows, grams, begins, sizes = found
    ids, mask, owner = _laid_out(lengths, codes)
    labels = np.array(labels, np.float32)
    steps = 0
    for epoch in range(EPOCHS):
        if epoch:
            vectors = inputs(model, found)
            z = np.concatenate([
                logits(model, vectors, ids[:, i:i + 1024], mask[:, i:i + 1024]) for i in range(0, len(owner), 1024)])
        else:
            z = draw.random(len(owner)).astype(np.float32)
        order = np.lexsort((-z, owner))
        rank = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
        count = np.bincount(owner, minlength=len(texts))[owner[order]]
        if epoch == 0:
            chosen, weight = order[rank < 40], (1 / np.minimum(count, 8))[rank < 40]
        else:
            drawn = draw.random(len(owner)) < 2 / count
            take = (rank == 0) | drawn & (labels[owner[order]] == 0)
            chosen, weight = order[take], np.where(rank == 0, 1.0, 0.3)[take]
        mixed = draw.permutation(len(chosen))
        chosen, weight = chosen[mixed], weight[mixed].astype(np.float32)
        size = 256 if epoch == 0 else 64
        for at in range(0, len(chosen), size):
            part, steps = chosen[at:at + size], steps + 1
            own, local = np.unique(ids[:, part], return_inverse=True)
            local = local.reshape(ids[:, part].shape)
            picked = np.concatenate([np.arange(begins[w], begins[w] + sizes[w]) for w in own])
            small = (rows[own], grams[picked], np.cumsum(sizes[own]) - sizes[own], sizes[own])
            vectors = inputs(model, small)
            p = _sigmoid(logits(model, vectors, local, mask[:, part]))
            d = weight[at:at + size] * (p - labels[owner[part]]) / len(part)
            grads, d_vectors = logits(model, vectors, local, mask[:, part], d.astype(np.float32))
            scaled = np.repeat(d_vectors[:, WIDTH:] / sizes[own][:, None].astype(np.float32), sizes[own], axis=0)
            for name, index, grad in (("word", rows[own], d_vectors[:, :WIDTH]), ("gram", grams[picked], scaled)):
                touched, where = np.unique(index, return_inverse=True)
                total = np.zeros((len(touched), WIDTH), np.float32)
                np.add.at(total, where, grad)
                _step(model[name], moments[name], total, steps, touched)
            for name, grad in grads.items():
                _step(model[name], moments[name], grad.reshape(model[name].shape), steps, slice(None))
    return model


def _step(value, moments, grad, steps, at):
    """Adam, on the rows that have a gradient."""
    import numpy as np

    first, second = moments
    first[at] = 0.9 * first[at] + 0.1 * grad
    second[at] = 0.99 * second[at] + 0.01 * grad * grad
    value[at] -= RATE * (first[at] / (1 - 0.9 ** steps)) / (np.sqrt(second[at] / (1 - 0.99 ** steps)) + 1e-6)


def trained(docs: DataFrame, labels: DataFrame, per_class=SAMPLE_PER_CLASS):
    """The network fitted to a bounded sample of labelled rows: of each class, the
    `per_class` ids of least hash. Ids whose crc32 modulo 5 is 0 are held out. Fitting is
    one small task; the driver gets only the weights, whose size is fixed. None if a class
    has no usable row."""
    known = labels.where(f"toxic in (0, 1) and doc_id is not null and {HELD_OUT} <> 0").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    sample = kept(picked[0].unionByName(picked[1]))
    texts = kept(docs.where("text is not null").join(F.broadcast(sample), "doc_id"))

    def one(part):
        import pickle

        import pandas as pd

        worker_tables("toxicity", _rows())
        part = part.sort_values(["doc_id", "text"])
        found = part["toxic"].to_numpy()
        if not 0 < found.sum() < len(found):
            return pd.DataFrame({"weights": [None]})
        return pd.DataFrame({"weights": [pickle.dumps(fit([t.encode() for t in part["text"]], found))]})

    row = texts.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(one, "weights binary").first()
    import pickle

    return pickle.loads(row[0]) if row and row[0] else None


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5"


def score_documents(docs: DataFrame, model, id_column="doc_id", text_column="text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`: whole texts, all
    overlapping windows; the highest window's score counts.

    Null, empty and blank texts get the score of a window without words. A null id is not
    held out. Without a model (no labels to learn from) every score is 0. Repeated rows are
    scored alike; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed

    def score(batches):
        import pyarrow as pa

        worker_tables("toxicity", _rows())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                found = [0.0] * len(rows) if shared.value is None else scores(shared.value, utf8(rows.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.expr(HELD_OUT) == 0, F.lit(False))
    return docs.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model, threshold=0.5, text_column="text") -> DataFrame:
    """The rows of `docs`, with all their columns, that score below `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def keep(batches):
        import pyarrow as pa

        worker_tables("toxicity", _rows())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                found = scores(shared.value, utf8(rows.column(place))) if shared.value else [0.0] * len(rows)
                yield rows.filter(pa.array([x < threshold for x in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score_documents(docs, trained(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
