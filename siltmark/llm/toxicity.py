"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Each step of the network reads one word: a hashed word embedding beside the mean of hashed embeddings of the
word's character n-grams. A document is cut into overlapping windows that cover all of it; its score is the
highest of its windows' scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import sole_cache
from siltmark.sources.durable import stored

#: Words of a window, and words from one window's start to the next.
WINDOW, STRIDE = 64, 48
#: Rows of the word table and of the n-gram table, width of each, units in each direction and in the attention.
WORD_ROWS, GRAM_ROWS, WIDTH, UNITS, ATTENTION = 1 << 14, 1 << 14, 8, 8, 6
#: At most so many labelled documents of each class are drawn for training, those of the smallest hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000
#: Longer texts than this (code points) are left out of the training sample; scoring takes whole texts.
SAMPLE_CHARS = 12_000
EPOCHS = 6
#: Words whose inputs a worker keeps.
CACHE_WORDS = 200_000
#: A document is toxic from this score on.
THRESHOLD = 0.7


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its row in the word table; rows in the n-gram table and where each word's begin.

    N-grams are of 3, 4 and 5 bytes of the word between two marks, so every word has at least one.
    """
    buffer = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(buffer)) - starts[owner]
    power = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(buffer), np.uint64)
    rows, owners = [], []
    padded = np.concatenate([buffer, np.zeros(8, np.uint64)])
    with np.errstate(over="ignore"):
        for n in range(1, 6):
            rolled = (rolled + padded[n - 1 : n - 1 + len(buffer)] + np.uint64(1)) * power
            rolled ^= rolled >> np.uint64(29)
            if n >= 3:
                fits = place + n <= lengths[owner]
                if n == 3:
                    fits |= place == 0
                rows.append((rolled[fits] >> np.uint64(20)) % np.uint64(GRAM_ROWS))
                owners.append(owner[fits])
        weights = (np.arange(int(lengths.max()) if len(words) else 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * power
        mixed = (buffer + np.uint64(7)) * weights[place]
        mixed ^= mixed >> np.uint64(31)
        word = (np.add.reduceat(mixed * power, starts[:-1]) >> np.uint64(17)) % np.uint64(WORD_ROWS) if len(words) else np.zeros(0, np.uint64)
    grams, own = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    begins = np.searchsorted(own[order], np.arange(len(words)))
    return word.astype(np.int64), grams[order].astype(np.int64), begins


class Network:
    """Parameters, forward pass, training step. All arrays are float32 when scoring."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        size = 2 * WIDTH
        p = {"word": draw.normal(0, 0.1, (WORD_ROWS, WIDTH)), "gram": draw.normal(0, 0.1, (GRAM_ROWS, WIDTH))}
        for d in "fb":
            p |= {f"w{d}": draw.normal(0, size**-0.5, (size, 3 * UNITS)), f"u{d}": draw.normal(0, UNITS**-0.5, (UNITS, 3 * UNITS)), f"c{d}": np.zeros(3 * UNITS)}
        p |= {"att": draw.normal(0, 0.3, (2 * UNITS, ATTENTION)), "att_v": draw.normal(0, 0.3, ATTENTION), "out": draw.normal(0, 0.3, 2 * UNITS), "bias": np.full(1, -1.0)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of words: (n, 2 * WIDTH)."""
        if not words:
            return np.zeros((0, 2 * WIDTH), np.float32)
        word, grams, begins = word_features(words)
        counts = np.diff(np.append(begins, len(grams)))[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][word], np.add.reduceat(self.p["gram"][grams], begins, axis=0) / counts * 2], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What words add to the gates of both directions: (n, 6 * UNITS); row 0 of a table is for padding."""
        p = self.p
        return np.concatenate([x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]], axis=1)

    def _run(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """One direction over (T, B, 3U) gate inputs; states (T, B, U). Padding passes the state on."""
        steps, batch = mask.shape
        h = np.zeros((batch, UNITS), np.float32)
        states = np.empty((steps, batch, UNITS), np.float32)
        ug, un = u[:, : 2 * UNITS], u[:, 2 * UNITS :]
        for t in range(steps):
            g = gates[t]
            zr = 1 / (1 + np.exp(-(g[:, : 2 * UNITS] + h @ ug)))
            hu = h @ un
            n = np.tanh(g[:, 2 * UNITS :] + zr[:, UNITS:] * hu)
            z = np.where(mask[t][:, None], zr[:, :UNITS], np.float32(1))
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, z, zr[:, UNITS:], n, hu))
            states[t] = h = new
        return states

    def forward(self, table: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. ``index`` (T, B): rows of ``table`` (from project), 0 for padding."""
        p, mask = self.p, index > 0
        gates = table[index]
        traces: tuple[list | None, list | None] = ([], []) if keep is not None else (None, None)
        states = np.empty((*index.shape, 2 * UNITS), np.float32)
        states[..., :UNITS] = self._run(gates[..., : 3 * UNITS], mask, p["uf"], traces[0])
        states[..., UNITS:] = self._run(gates[::-1, :, 3 * UNITS :], mask[::-1], p["ub"], traces[1])[::-1]
        a = np.tanh(states @ p["att"])
        e = np.where(mask, a @ p["att_v"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w *= mask
        w /= w.sum(axis=0) + np.float32(1e-9)
        pooled = np.einsum("tb,tbk->bk", w, states)
        if keep is not None:
            keep |= {"traces": traces, "states": states, "a": a, "w": w, "pooled": pooled, "mask": mask}
        return pooled @ p["out"] + p["bias"][0]

    def backward(self, keep: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of the gate inputs (T, B, 6U)."""
        p, states, w, a, mask = self.p, keep["states"], keep["w"], keep["a"], keep["mask"]
        grads = {"out": keep["pooled"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = w[..., None] * d_pooled
        d_w = np.einsum("tbk,bk->tb", states, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        grads["att_v"] = np.einsum("tb,tbk->k", d_e, a)
        d_a = d_e[..., None] * p["att_v"] * (1 - a * a)
        grads["att"] = np.einsum("tbi,tbj->ij", states, d_a, optimize=True)
        d_states += d_a @ p["att"].T
        d_gates = np.zeros((*mask.shape, 6 * UNITS), np.float32)
        for side, (d, trace) in enumerate(zip("fb", keep["traces"], strict=True)):
            u, steps = p[f"u{d}"], len(trace)
            d_u, d_h = np.zeros_like(u), np.zeros((mask.shape[1], UNITS), np.float32)
            for i in range(steps - 1, -1, -1):
                t = i if side == 0 else steps - 1 - i
                h, z, r, n, hu = trace[i]
                d_h = d_h + d_states[t][:, side * UNITS : (side + 1) * UNITS]
                live = mask[t][:, None]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_z = np.where(live, d_h * (h - n) * z * (1 - z), np.float32(0))
                d_r = d_n * hu * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_hu = d_n * r
                out = d_gates[t]
                out[:, 3 * UNITS * side : 3 * UNITS * side + 2 * UNITS] = d_zr
                out[:, 3 * UNITS * side + 2 * UNITS : 3 * UNITS * (side + 1)] = d_n
                d_u[:, : 2 * UNITS] += h.T @ d_zr
                d_u[:, 2 * UNITS :] += h.T @ d_hu
                d_h = d_h * z + d_zr @ u[:, : 2 * UNITS].T + d_hu @ u[:, 2 * UNITS :].T
            grads[f"u{d}"] = d_u
        return grads, d_gates


def windows_of(rows: np.ndarray) -> np.ndarray:
    """Overlapping windows of a document's word rows, as (n, WINDOW) padded with 0; all words are covered."""
    n = len(rows)
    padded = np.zeros((window_count(n) - 1) * STRIDE + WINDOW, np.int64)
    padded[:n] = rows
    return padded[np.arange(window_count(n))[:, None] * STRIDE + np.arange(WINDOW)]


def window_count(n: int) -> int:
    """Windows of a document of ``n`` words."""
    return 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)


def train(texts: Iterable[str], labels: list[int], seed: int = 7) -> Network:
    """Fit a network to labelled texts. The highest window of each text carries its label.

    The first epochs take texts of few windows only, where the label says most about the window. Of a text only the
    numbers of its words are kept (4 bytes a word), and of words one entry for each distinct one.
    """
    net, draw = Network(seed), np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs = []
    for text in texts:
        words = words_of(text)
        docs.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), np.int32, len(words)))
    counts = np.array([window_count(len(d)) for d in docs])
    y = np.array(labels, np.float32)
    if not vocabulary or len(set(labels)) < 2:
        net.p["bias"][:] = -6.0 if not len(y) or y.mean() < 0.5 else 6.0
        net.p["out"][:] = 0
        return net
    word, grams, begins = word_features(list(vocabulary))
    ends = np.append(begins[1:], len(grams))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    weight = np.minimum(weight, 3.0).astype(np.float32)
    for epoch in range(EPOCHS):
        fits = np.flatnonzero(counts <= (4 if epoch < 2 else 10 if epoch < 4 else 1 << 30))
        draw.shuffle(fits)
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.002
        for at in range(0, len(fits), 48):
            chosen = fits[at : at + 48]
            index = np.concatenate([windows_of(docs[i]) for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), counts[chosen])
            used, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            if used[0] != 0:
                used, local = np.concatenate([[0], used]), local + 1
            ids = used[1:] - 1
            n_grams = (ends - begins)[ids]
            offsets = np.concatenate([[0], np.cumsum(n_grams)[:-1]])
            own = grams[np.repeat(begins[ids] - offsets, n_grams) + np.arange(n_grams.sum())]
            x = np.concatenate([net.p["word"][word[ids]], np.add.reduceat(net.p["gram"][own], offsets, axis=0) / n_grams[:, None].astype(np.float32) * 2], axis=1)
            table = np.concatenate([np.zeros((1, 6 * UNITS), np.float32), net.project(x)])
            if len(owner) > len(chosen):
                logits = net.forward(table, local.T)
                order = np.lexsort((logits, owner))
                best = order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)]
            else:
                best = np.arange(len(chosen))
            keep: dict = {}
            logits = net.forward(table, local[best].T, keep)
            chance = 1 / (1 + np.exp(-logits))
            target = y[chosen] * 0.96 + 0.02
            grads, d_gates = net.backward(keep, ((chance - target) * weight[chosen] / len(chosen)).astype(np.float32))
            d_table = np.zeros((len(table), 6 * UNITS), np.float32)
            np.add.at(d_table, local[best].T.ravel(), d_gates.reshape(-1, 6 * UNITS))
            d_table = d_table[1:]
            grads |= {"wf": x.T @ d_table[:, : 3 * UNITS], "wb": x.T @ d_table[:, 3 * UNITS :], "cf": d_table[:, : 3 * UNITS].sum(axis=0), "cb": d_table[:, 3 * UNITS :].sum(axis=0)}
            d_x = d_table[:, : 3 * UNITS] @ net.p["wf"].T + d_table[:, 3 * UNITS :] @ net.p["wb"].T
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            for k, rows, g in (("word", word[ids], d_x[:, :WIDTH]), ("gram", own, np.repeat(d_x[:, WIDTH:] * (2 / n_grams[:, None].astype(np.float32)), n_grams, axis=0))):
                seen, place = np.unique(rows, return_inverse=True)
                total_g = np.zeros((len(seen), WIDTH), np.float32)
                np.add.at(total_g, place, g)
                v = moments[k][1]
                v[seen] += total_g * total_g
                net.p[k][seen] -= 4 * rate * total_g / (np.sqrt(v[seen]) + 1e-6) + np.float32(1e-4) * net.p[k][seen]
    return net


class Scorer:
    """Scores of whole texts by one network; keeps the gate inputs of the words it met."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1, 6 * UNITS), np.float32)

    def scores(self, texts: list[str], windows_at_once: int = 2048) -> np.ndarray:
        """Highest window score of each text; a text without words has the score of an empty window.

        Texts of any length: their windows go through the network in blocks.
        """
        best = np.full(len(texts), -np.inf, np.float32)
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, owners, size
            if held:
                index, owner = np.concatenate(held), np.repeat(owners, [len(x) for x in held])
                for at in range(0, len(index), windows_at_once):
                    part = index[at : at + windows_at_once]
                    np.maximum.at(best, owner[at : at + windows_at_once], self.net.forward(self.table, np.ascontiguousarray(part.T)))
            held, owners, size = [], [], 0

        pending: list[tuple[int, list[bytes]]] = []
        fresh: dict[bytes, int] = {}

        def admit() -> None:
            """Give the new words of the pending texts their rows, then cut the texts."""
            nonlocal pending, fresh, size
            if fresh:
                self.table = np.concatenate([self.table, self.net.project(self.net.inputs(list(fresh)))])
                self.rows |= fresh
            get = self.rows.__getitem__
            for i, words in pending:
                held.append(windows_of(np.fromiter(map(get, words), np.int64, len(words))))
                owners.append(i)
                size += len(held[-1])
            pending, fresh = [], {}
            flush()
            if len(self.rows) > CACHE_WORDS:
                self._reset()

        waiting = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            known, base = self.rows, len(self.rows) + 1
            for w in words:
                if w not in known and w not in fresh:
                    fresh[w] = base + len(fresh)
            pending.append((i, words))
            waiting += len(words)
            if waiting > windows_at_once * STRIDE:
                admit()
                waiting = 0
        admit()
        return (1 / (1 + np.exp(-best.astype(np.float64)))).astype(np.float64)


@lru_cache(maxsize=1)
def _scorer(blob: bytes) -> Scorer:
    return Scorer(pickle.loads(blob))


def held_out(id_col: str) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit_toxicity(documents: DataFrame, labels: DataFrame) -> Network:
    """A network fitted to a bounded sample of the labelled documents that are not held out.

    At most SAMPLE_TOXIC and SAMPLE_CLEAN texts of at most SAMPLE_CHARS come to the driver, chosen by a hash of the
    id, so the sample is the same however the tables are partitioned. Labels that are null, or without a
    document, are not used; of repeated ids every row counts, within the bounds. Texts come one partition at a time
    and are numbered as they come. Without both classes all scores are the same.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y")).where("_id is not null and _y is not null").where(~held_out("_id"))
    share = documents.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    # the ids are chosen first, so that only texts of the sample travel
    ids = known.join(share.select(F.col("doc_id").alias("_id")), "_id").select("_id", (F.col("_y") == 1).cast("int").alias("_y")).distinct().withColumn("_h", F.xxhash64("_id"))
    order = ["_h", "_id"]
    chosen = ids.where("_y = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionAll(ids.where("_y = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    drawn = share.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(*order, "text", F.col("_y").alias("y"))
    # ids that repeat bring more rows than ids
    order.append("text")
    drawn = stored(drawn.where("y = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionAll(drawn.where("y = 0").orderBy(*order).limit(SAMPLE_CLEAN)), "toxicity_sample")
    labels_of: list[int] = []

    def texts() -> Iterator[str]:
        for row in drawn.orderBy(*order, "y").toLocalIterator():
            labels_of.append(row[3])
            yield row[2]

    return train(texts(), labels_of)


def score_toxicity(documents: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text: doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD), text_hash.

    Null and empty texts get the score of an empty window. Null ids are scored and count as not held out; tied and
    repeated ids are scored row by row; other columns are ignored; an empty table gives no rows.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    blob = documents.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("toxicity", _scorer.cache_clear)
        own = _scorer(blob.value)
        for batch in batches:
            score = own.scores([x.as_py() or "" for x in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32)), batch.column(3)], ["doc_id", "held_out", "score", "predicted", "text_hash"])

    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, text_hash bigint")
