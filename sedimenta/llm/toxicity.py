"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of three widths, max pooling, in numpy.

A word (a run of letters and digits, A-Z folded) has the sum of three embeddings: of its hash and of the hashes of its
first four and six bytes, so words of a known stem are known. Hashes fall into 2**22 buckets, and those met in MIN_DOCS
training texts or more have rows of their own. Filters of one, two and three words slide over the whole text, each keeps
its maximum, and a linear layer gives a logit. The embeddings start from each bucket's log-odds in the training texts and
are trained with everything else by Adagrad.

Thresholds are calibrated by language on a fifth of the training texts that isn't trained on. The language is guessed
from common words of the text itself; the logit less the language's threshold gives the score, so .5 is the threshold.

Training takes a bounded sample of labelled rows: at most MOST_TOXIC toxic and MOST_CLEAN others, the first by a hash of
their ids, one row an id (the least text of those that repeat it), no text over MOST_TEXT bytes and no more than MOST_BYTES
together. Texts are scored whole, however long. Null texts are empty ones, which get the model's bias like any text
without known words. Null ids aren't labelled and are held out of nothing. Rows repeat if documents repeat; only the
id and text columns are read. Without labelled rows of both kinds every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.words import hashed_texts, letters_only
from sedimenta.session import give_back, scratch, written

MOST_TOXIC, MOST_CLEAN = 4000, 8000
MOST_BYTES, MOST_TEXT = 40 << 20, 1 << 20
BUCKET_BITS, MIN_DOCS = 22, 3
DIMS, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PREFIXES = (4, 6)
EPOCHS, RATE, BATCH = 4, 0.08, 64
PAD = max(WIDTHS) - 1

#: Common words by language.
COMMON = {
    "en": "the of and to in that is was for on with as at this be by or from are it not an",
    "de": "der die und den zu das von mit dem des ein eine für auf ist sich nicht im auch als",
    "fr": "le la les et des un une du est que qui dans pour au pas sur en par ce il",
    "es": "el la los las que y un una del se en es por con no su para al lo como",
}
LANGUAGES = tuple(COMMON)
_SPACES = letters_only()


def bucketed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, buckets of their words by kind of hash, offset of each row's words and the end)."""
    for row, words, edges in hashed_texts(column, _SPACES, PREFIXES):
        yield row, (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), edges


def _language_table() -> np.ndarray:
    """For a bucket of whole words: bits of the languages that it's a common word of."""
    table = np.zeros(1 << BUCKET_BITS, np.uint8)
    for i, words in enumerate(COMMON.values()):
        for _, buckets, _ in bucketed(pa.array(words.split())):
            table[buckets[:, 0]] |= 1 << i
    return table


def _language(bits: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The language with most common words in each text; the first of equals."""
    counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(bits >> i & 1)])[edges]) for i in range(len(LANGUAGES))], 1)
    return counts.argmax(1)


class Model:
    """Embeddings, filters and thresholds."""

    def __init__(self, rows: np.ndarray, table: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, shift: float, thresholds: np.ndarray, constant: float | None = None):
        self.rows, self.table, self.filters, self.bias, self.out, self.shift, self.thresholds, self.constant = rows, table, filters, bias, out, shift, thresholds, constant
        self.languages = _language_table()

    def __getstate__(self) -> dict:
        """The tables by their entries: few buckets have rows."""
        state = self.__dict__.copy()
        state["table"] = [(np.flatnonzero(t).astype(np.int32), t[t != 0]) for t in self.table]
        del state["languages"]
        return state

    def __setstate__(self, state: dict) -> None:
        table = np.zeros((len(state["table"]), 1 << BUCKET_BITS), np.int32)
        for row, (at, value) in zip(table, state["table"], strict=True):
            row[at] = value
        self.__dict__.update(state | {"table": table, "languages": _language_table()})

    def padded(self, buckets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers (words and pads by kind), first place of each text, embedded words."""
        n = len(edges) - 1
        lengths = np.diff(edges)
        ids = np.zeros((len(buckets) + PAD * n, 1 + len(PREFIXES)), np.int32)
        at = np.arange(len(buckets)) + PAD * np.repeat(np.arange(n), lengths)
        for kind in range(ids.shape[1]):
            ids[at, kind] = self.table[kind][buckets[:, kind]]
        x = self.rows[ids[:, 0]]
        for kind in range(1, ids.shape[1]):
            x += self.rows[ids[:, kind]]
        return ids, edges[:-1] + PAD * np.arange(n), x

    def convolved(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            z = x @ f[0]
            for j in range(1, width):
                z[:-j] += x[j:] @ f[j]
            out.append(z)
        return out

    def logits(self, buckets: np.ndarray, edges: np.ndarray) -> np.ndarray:
        _, starts, x = self.padded(buckets, edges)
        top = np.concatenate([np.maximum.reduceat(z, starts, axis=0) for z in self.convolved(x)], 1)
        return np.maximum(top + self.bias, 0) @ self.out + self.shift

    def scores(self, buckets: np.ndarray, edges: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(edges) - 1, self.constant)
        logits = self.logits(buckets, edges) - self.thresholds[_language(self.languages[buckets[:, 0]], edges)]
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kinds = 1 + len(PREFIXES)
    return np.concatenate([np.empty((0, kinds), np.int32), *texts]), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def split(texts: pa.Array) -> list[np.ndarray]:
    """The buckets of each text's words."""
    docs: list[np.ndarray] = []
    for _, buckets, edges in bucketed(texts):
        docs += [buckets[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return docs


def train(texts: pa.Array, labels: np.ndarray, held: np.ndarray, seed: int = 11) -> Model:
    """Fit on the texts that aren't held, then calibrate a threshold for each language on those that are."""
    return trained(split(texts), labels, held, seed)


def trained(docs: list[np.ndarray], labels: np.ndarray, held: np.ndarray, seed: int = 11) -> Model:
    """train() on the buckets of the texts' words."""
    kinds = 1 + len(PREFIXES)
    if len(labels) == 0 or labels.min() == labels.max():
        zero = np.zeros((kinds, 1 << BUCKET_BITS), np.int32)
        return Model(np.zeros((1, DIMS), np.float32), zero, [np.zeros((w, DIMS, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), np.zeros(FILTERS * len(WIDTHS)), 0.0, np.zeros(len(LANGUAGES)), float(labels.mean()) if len(labels) else 0.0)
    seen, once = set(), []
    for i, d in enumerate(docs):  # copies count once
        if (key := hashlib.blake2b(d.tobytes(), digest_size=12).digest()) not in seen:
            seen.add(key)
            once.append(i)
    fit = [i for i in once if not held[i]]
    toxic, clean = np.zeros((kinds, 1 << BUCKET_BITS), np.uint16), np.zeros((kinds, 1 << BUCKET_BITS), np.uint16)
    for i in fit:
        for kind in range(kinds):
            (toxic if labels[i] else clean)[kind][np.unique(docs[i][:, kind])] += 1
    n_toxic = max(1, sum(labels[i] for i in fit))
    n_clean = max(1, len(fit) - n_toxic)
    table, odds = np.zeros((kinds, 1 << BUCKET_BITS), np.int32), [np.zeros(1)]
    for kind in range(kinds):
        known = np.flatnonzero(toxic[kind] + clean[kind] >= MIN_DOCS)  # the bounds of the sample keep the counts in 16 bits
        table[kind][known] = np.arange(len(known)) + sum(map(len, odds))
        t, c = toxic[kind][known] + 0.5, clean[kind][known] + 0.5
        odds.append((np.log(t / (n_toxic + 1)) - np.log(c / (n_clean + 1))) / np.sqrt(1 / t + 1 / c))
    del toxic, clean
    rng = np.random.default_rng(seed)
    odds = np.concatenate(odds)
    rows = (rng.normal(0, 0.05, (len(odds), DIMS))).astype(np.float32)
    rows[:, 0] += np.clip(odds, -6, 6) / 6
    rows[0] = 0
    filters = [rng.normal(0, 0.2, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] += 1
    out = rng.normal(0, 0.2, FILTERS * len(WIDTHS))
    for w in range(len(WIDTHS)):
        out[w * FILTERS : w * FILTERS + FILTERS // 2] += 0.5
    model = Model(rows, table, filters, np.full(FILTERS * len(WIDTHS), -0.3), out, -1.0, np.zeros(len(LANGUAGES)))
    _descend(model, docs, labels, fit, rng)
    check = [i for i in once if held[i]] or fit
    _calibrate(model, docs, labels, check, fit)
    return model


def _descend(model: Model, docs: list[np.ndarray], labels: np.ndarray, fit: list[int], rng: np.random.Generator) -> None:
    """Adagrad over the texts; only the places that won a maximum have gradients."""
    names = ("bias", "out")
    sums = {k: np.full_like(getattr(model, k), 1e-3) for k in names} | {"shift": 1e-3, "rows": np.full(model.rows.shape, 1e-3, np.float32), "filters": [np.full(f.shape, 1e-3, np.float32) for f in model.filters]}
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            buckets, edges = _joined([docs[i] for i in some])
            ids, starts, x = model.padded(buckets, edges)
            ends = np.append(starts[1:], len(x))
            convolved = model.convolved(x)
            places = [np.stack([a + z[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)]) for z in convolved]
            top = np.concatenate([np.take_along_axis(z, p, 0) for z, p in zip(convolved, places, strict=True)], 1) + model.bias
            hidden = np.maximum(top, 0)
            logit = hidden @ model.out + model.shift
            wrong = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[some]
            back = (wrong[:, None] * model.out) * (top > 0)
            grads = {"bias": back.sum(0), "out": hidden.T @ wrong}
            touched, steps = [], []
            for w, (width, f, p) in enumerate(zip(WIDTHS, model.filters, places, strict=True)):
                g = back[:, w * FILTERS : (w + 1) * FILTERS]
                gf = np.zeros_like(f)
                for j in range(width):
                    q = np.minimum(p + j, len(x) - 1)
                    gf[j] = np.einsum("nfe,nf->ef", x[q], g)
                    touched.append(ids[q].reshape(-1, ids.shape[1]))
                    steps.append((g[:, :, None] * f[j].T[None]).reshape(-1, DIMS))
                sums["filters"][w] += gf**2
                f -= RATE * gf / np.sqrt(sums["filters"][w])
            who, what = np.concatenate(touched), np.concatenate(steps)
            flat = who.ravel()
            known, place = np.unique(flat, return_inverse=True)
            total = np.zeros((len(known), DIMS), np.float32)
            np.add.at(total, place, np.repeat(what, ids.shape[1], 0))
            total[known == 0] = 0
            sums["rows"][known] += total**2
            model.rows[known] -= RATE * total / np.sqrt(sums["rows"][known])
            for k in names:
                sums[k] += grads[k] ** 2
                getattr(model, k)[...] -= RATE * grads[k] / np.sqrt(sums[k])
            sums["shift"] += wrong.sum() ** 2
            model.shift -= RATE * wrong.sum() / np.sqrt(sums["shift"])


def _calibrate(model: Model, docs: list[np.ndarray], labels: np.ndarray, check: list[int], fit: list[int]) -> None:
    """The threshold of each language that errs least on its texts, in the middle of the best gap; few texts share all languages'."""

    def scored(some: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits, languages = [], []
        for at in range(0, len(some), 256):
            buckets, edges = _joined([docs[i] for i in some[at : at + 256]])
            logits.append(model.logits(buckets, edges))
            languages.append(_language(model.languages[buckets[:, 0]], edges))
        return np.concatenate(logits), np.concatenate(languages), labels[some]

    def best(logits: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(logits, kind="stable")
        s, t = logits[order], y[order]
        errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
        edges = np.concatenate([[s[0] - 2], (s[1:] + s[:-1]) / 2, [s[-1] + 2]])
        gaps = np.concatenate([[0], s[1:] - s[:-1], [0]])
        least = np.flatnonzero(errors == errors.min())
        return float(edges[least[gaps[least].argmax()]])

    logits, languages, y = scored(check)
    if y.min() == y.max():
        logits, languages, y = scored(fit)
    common = best(logits, y)
    for i in range(len(LANGUAGES)):
        mine = languages == i
        enough = mine.sum() >= 50 and 5 <= y[mine].sum() < mine.sum()
        model.thresholds[i] = best(logits[mine], y[mine]) if enough else common


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, text, label, crc and h of the training rows: those whose crc32 of the id isn't divisible by five, bounded by kind and bytes."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("id is not null and label in (0, 1)").where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("label").alias("label"))
    first = lambda kind, n: rows.where(F.col("label") == kind).orderBy(F.xxhash64("id"), "id").limit(n)
    some = F.broadcast(first(1, MOST_TOXIC).unionByName(first(0, MOST_CLEAN)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    met = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.octet_length("text") <= MOST_TEXT).join(some, "id")
    one = met.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    folder = scratch(docs.sparkSession, "toxicity")
    kept = written(one.select("*", crc.alias("crc"), F.xxhash64("id").alias("h"), F.octet_length("text").alias("size")), folder)  # MOST_TOXIC + MOST_CLEAN rows at most
    held = F.sum("size").over(Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = kept.select("id", held.alias("held")).where(F.col("held") <= MOST_BYTES).select("id")
    return kept.join(F.broadcast(fitting), "id", "left_semi").select("id", "text", "label", "crc", "h")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the bounded sample, in the order of a hash of its ids. Texts go from the driver batch by batch, as their
    words are hashed, and what training has taken goes back to the system."""
    table = labelled_sample(docs, labels, id_col, text_col, label_col).toArrow()
    order = pc.sort_indices(table.select(["h", "id"]), [("h", "ascending"), ("id", "ascending")])
    rest, texts, words = table.select(["label", "crc"]).take(order), table.column("text").chunks[::-1], []
    del table
    while texts:
        words += split(texts.pop())
    words = [words[i] for i in order.to_pylist()]
    model = trained(words, np.asarray(rest.column("label")).astype(np.int64), np.asarray(rest.column("crc")) % 5 == 1)
    del words
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, score and predicted of every row (and the extra columns as they are); no shuffle.

    The model, of a size bounded by its sample, is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = docs.select(*extra).schema if extra else None
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kinds) if extra else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(len(batch))
            for row, buckets, edges in bucketed(batch.column(1)):
                out[row : row + len(edges) - 1] = shared.value.scores(buckets, edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), *batch.columns[3:]], names=[id_col, "held_out", "score", "predicted", *extra])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col), F.col(text_col).cast("string"), held.alias("held_out"), *extra]
    return docs.select(*columns).mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int{more}")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic; no shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.empty(len(batch), bool)
            for row, buckets, edges in bucketed(batch.column(at).cast(pa.string())):
                keep[row : row + len(edges) - 1] = shared.value.scores(buckets, edges) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
