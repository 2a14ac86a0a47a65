"""Toxicity: a convolutional text classifier in numpy.

Words (lower case, punctuation as space) are hashed to ``BUCKETS`` embeddings; filters one, two and three words wide run
over the whole text, each keeps its largest response anywhere in it, and a logistic unit scores those. Training is Adam on
logistic loss over every labelled document that may be learnt from, whole: a tenth of them (by hash of doc_id) chooses the
epoch and calibrates for each language the threshold with the best F1, on scores in steps of 1 / ``STEPS_OF_SCORE``; the
others make the weights. Up to ``FEW`` of them are gone over in the driver. More are gone over where they lie: in each
epoch at most ``WORKERS`` tasks go on from the same weights, each streaming its rows, and the mean of what they come to,
weighted by rows, begins the next; so neither driver nor task holds more as the labels grow. Scores see the text alone. All
documents are scored, whole.

Null texts are empty; an empty text is scored as one padding word. A null doc_id is not held out. Without labelled rows
of both kinds every score is the share of toxic rows among those there are (0 without any). Only doc_id, text and lang
(for the threshold) are read; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_id, chunks, doc_key, flat, lean, table, word_hash, words, written

BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 24
EPOCHS, STEPS, BATCH, RATE, DECAY, DROP = 8, 500, 32, 0.005, 3e-4, 0.2
#: Words scored at once in training.
WORDS = 100_000
#: Documents, and bytes of their hashed words, that the driver goes over; documents for each task otherwise, and tasks.
FEW, FEW_BYTES, SHARE, WORKERS = 4096, 32 << 20, 2048, 24
#: Bytes of hashed words that a task shuffles together.
MIXED = 8 << 20
STEPS_OF_SCORE = 10_000
#: A hashed word as it is written; BUCKETS fits.
PACKED = "<u2"
#: For within_bytes: bytes of texts by label.
BYTES = {0: 48 << 20, 1: 24 << 20}
#: Rows whose crc32 of doc_id has this remainder by four are never learnt from.
HELD = 2
PREDICTED = 0.3

# What becomes a space (ASCII that is neither letter nor digit) and A-Z to a-z.
PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all rows and the rows' offsets; bucket 0 is padding."""
    buf, off = flat(column)
    s, e, at = words(PLAIN[buf], off)
    return (word_hash(PLAIN[buf], s, e) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1, at


def layout(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with padding after each row, the places where windows start, and each row's first among those."""
    n = np.diff(at)
    pad = max(WIDTHS) - 1
    room = np.maximum(n, 1)
    begin = np.cumsum(room + pad) - (room + pad)
    x = np.zeros(int((room + pad).sum()), np.int32)
    row = np.repeat(np.arange(len(n)), n)
    x[begin[row] + np.arange(len(ids)) - at[:-1][row]] = ids
    lead = np.cumsum(room) - room
    places = np.repeat(begin - lead, room) + np.arange(room.sum())
    return x, places, lead


class Net:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.02, (BUCKETS, SIZE))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 0.3, (w, SIZE, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"], self.p["c"] = r.normal(0, 0.3, len(WIDTHS) * FILTERS), np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["e"][0] = 0
        self.shift = 0.0

    def pooled(self, x, places, lead):
        """Largest response of each filter in each row; the filters' parts are looked up by word."""
        best = []
        for w in WIDTHS:
            maps = [self.p["e"] @ self.p[f"w{w}"][j] for j in range(w)]
            z = maps[0][x[places]]
            for j in range(1, w):
                z += maps[j][x[places + j]]
            best.append(np.maximum.reduceat(z, lead, axis=0) + self.p[f"b{w}"])
        return np.concatenate(best, axis=1)

    def logits(self, x, places, lead) -> np.ndarray:
        return np.maximum(self.pooled(x, places, lead), 0) @ self.p["o"] + self.p["c"][0] + self.shift

    def gradient(self, x, places, lead, y):
        """Gradients of the mean loss; that of the embeddings as touched rows and their values."""
        near = self.p["e"][x]
        ends = np.append(lead[1:], len(places))
        best, at = [], []
        for w in WIDTHS:
            z = near[places] @ self.p[f"w{w}"][0]
            for j in range(1, w):
                z += (near @ self.p[f"w{w}"][j])[places + j]
            at.append(np.stack([places[a + z[a:b].argmax(axis=0)] for a, b in zip(lead, ends, strict=True)]))
            best.append(np.maximum.reduceat(z, lead, axis=0) + self.p[f"b{w}"])
        h = np.concatenate(best, axis=1)
        a = np.maximum(h, 0)
        d = (1 / (1 + np.exp(-(a @ self.p["o"] + self.p["c"][0]))) - y) / len(y)
        g = {"o": a.T @ d, "c": d.sum(keepdims=True)}
        dh = d[:, None] * self.p["o"] * (h > 0)
        rows, values = [], []
        for k, w in enumerate(WIDTHS):
            dz = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"], g[f"w{w}"] = dz.sum(axis=0), np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                g[f"w{w}"][j] = np.einsum("rf,rfs->sf", dz, near[at[k] + j])
                rows.append(x[at[k] + j].ravel())
                values.append((dz[:, :, None] * self.p[f"w{w}"][j].T[None]).reshape(-1, SIZE))
        touched, which = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.stack([np.bincount(which, v, len(touched)) for v in np.concatenate(values).T], axis=1)
        return g, touched[touched > 0], total[touched > 0]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Steps over documents' hashed words."""

    def __init__(self, net: Net, r: np.random.Generator):
        self.net, self.r, self.t = net, r, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))

    def learn(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """Once over the rows, in an order of its own."""
        net, m, v, r = self.net, self.m, self.v, self.r
        mine = r.permutation(len(rows))
        for a in range(0, len(mine), BATCH):
            which = mine[a : a + BATCH]
            self.t += 1
            grads, touched, g = net.gradient(*packed([np.where(r.random(len(rows[i])) < DROP, 0, rows[i]) for i in which]), y[which])
            for k, at_, g in [*((k, slice(None), g) for k, g in grads.items()), ("e", touched, g)]:  # embeddings where touched
                g = g + DECAY * net.p[k][at_]
                m[k][at_] += 0.1 * (g - m[k][at_])
                v[k][at_] += 0.001 * (g * g - v[k][at_])
                net.p[k][at_] -= RATE * (m[k][at_] / (1 - 0.9**self.t)) / (np.sqrt(v[k][at_] / (1 - 0.999**self.t)) + 1e-8)


def packed(own: list[np.ndarray]):
    return layout(np.concatenate(own) if own else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum([len(o) for o in own], dtype=np.int64))))


def logits(net: Net, rows: list[np.ndarray]) -> np.ndarray:
    load = np.cumsum([len(x) for x in rows]) // WORDS
    parts = np.split(np.arange(len(rows)), np.flatnonzero(np.diff(load)) + 1) if rows else []
    return np.concatenate([net.logits(*packed([rows[i] for i in p])) for p in parts]) if parts else np.zeros(0)


def losses(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.sum(np.logaddexp(0, z) - y * z))


def epochs(n: int) -> int:
    """Few rows are gone over more often, up to STEPS steps or five times EPOCHS."""
    return max(EPOCHS, min(5 * EPOCHS, -(-STEPS * BATCH // max(1, n))))


def train(rows: list[np.ndarray], y: np.ndarray, held: np.ndarray, seed: int = 5) -> Net:
    """The net of the epoch that suits the held rows best (all, where none is held)."""
    net, best = Net(seed), (np.inf, None)
    adam = Adam(net, np.random.default_rng(seed))
    mine, other = np.flatnonzero(~held), np.flatnonzero(held)
    judge = other if len(other) else mine
    for _ in range(epochs(len(mine))):
        adam.learn([rows[i] for i in mine], y[mine])
        loss = losses(logits(net, [rows[i] for i in judge]), y[judge])
        if loss < best[0]:
            best = (loss, {k: a.copy() for k, a in net.p.items()})
    net.p = best[1] or net.p
    return net


def ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", PACKED).astype(np.int32) for x in batch.column("ids")]


def passed(own: DataFrame, net: Net, workers: int, epoch: int, learn: bool) -> tuple[float, dict]:
    """One pass over the learnt rows (ids, toxic, held): the loss of the held ones by net, and the weights the others lead to."""

    def run(batches):
        now, loss, n = Net(), 0.0, 0
        now.p = {k: a.copy() for k, a in net.p.items()}
        adam = Adam(now, np.random.default_rng(epoch))
        rows, y, size = [], [], 0

        def take():
            nonlocal n, rows, y, size
            adam.learn(rows, np.array(y, np.float32))
            n, rows, y, size = n + len(rows), [], [], 0

        for b in batches:
            ids, toxic, held = ids_of(b), b.column("toxic").to_numpy().astype(np.float32), b.column("held").to_numpy(zero_copy_only=False)
            away = np.flatnonzero(held)
            loss += losses(logits(net, [ids[i] for i in away]), toxic[away])
            for i in np.flatnonzero(~held) if learn else ():
                rows.append(ids[i])
                y.append(toxic[i])
                size += ids[i].nbytes
                if size > MIXED:
                    take()
        if rows:
            take()
        flat_ = [now.p[k].astype(np.float32).tobytes() if n else b"" for k in sorted(now.p)]
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([flat_], pa.list_(pa.binary()))], ["loss", "n", "p"])

    found = own.select("ids", "toxic", "held").coalesce(workers).mapInArrow(lean(run), "loss double, n long, p array<binary>").collect()  # WORKERS rows
    total = max(1, sum(x.n for x in found))
    # Means of what was added, so that what no task touched stays as it is.
    mean = lambda j, k: net.p[k] + sum((np.frombuffer(x.p[j], np.float32).reshape(net.p[k].shape) - net.p[k]) * np.float32(x.n / total) for x in found if x.n)
    weights = {k: mean(j, k) for j, k in enumerate(sorted(net.p))} if any(x.n for x in found) else net.p
    return sum(x.loss for x in found), weights


def train_apart(own: DataFrame, n: int, seed: int = 5) -> Net:
    """train() for rows that stay where they are."""
    net, best, workers = Net(seed), (np.inf, None), max(1, min(WORKERS, n // SHARE))
    for epoch in range(epochs(n) + 1):
        loss, weights = passed(own, net, workers, epoch, epoch < epochs(n))
        if epoch and loss < best[0]:
            best = (loss, net.p)
        if epoch < epochs(n):
            net.p = weights
    net.p = best[1] or net.p
    return net


def binned(own: DataFrame, net: Net) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Of the held rows for each language and step of the score: language, toxic rows, score, rows."""

    def run(batches):
        for b in batches:
            z = sigmoid(logits(net, ids_of(b)))
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(np.floor(z * STEPS_OF_SCORE).astype(np.int64))], ["lang", "toxic", "step"])

    steps = own.where("held").select("ids", "lang", "toxic").mapInArrow(lean(run), "lang string, toxic int, step long")
    found = steps.groupBy("lang", "step").agg(F.sum("toxic").alias("hit"), F.count("*").alias("n")).orderBy("lang", "step").collect()
    get = lambda c: np.array([r[c] for r in found], np.float64)
    return [r.lang for r in found], get("hit"), get("step") / STEPS_OF_SCORE, get("n")


def thresholds(langs: list[str | None], y: np.ndarray, scores: np.ndarray, n: np.ndarray | None = None, least: int = 20) -> dict[str | None, float]:
    """For each language with enough rows of both labels the threshold of best F1; for the rest, that of all rows (key "").

    n: how many rows each entry stands for (one), y of them toxic."""
    n = np.ones(len(y)) if n is None else n

    def best(own):
        order = np.argsort(-scores[own], kind="stable")
        hit = np.cumsum(y[own][order])
        f1 = 2 * hit / (np.cumsum(n[own][order]) + max(1, y[own].sum()))
        return float(scores[own][order][f1.argmax()])

    out = {"": best(np.arange(len(y))) if len(y) and y.any() else PREDICTED}
    for lang in set(langs):
        own = np.array([k for k, x in enumerate(langs) if x == lang])
        if n[own].sum() >= least and 0 < y[own].sum() < n[own].sum():
            out[lang] = best(own)
    return out


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD, F.lit(False))


def within_bytes(sample: DataFrame) -> DataFrame:
    """Whole rows (doc_id, text, lang, toxic) of the sample in the order of the ids' hashes, as far as BYTES of each label allow.

    For trials on a part of the rows; fit() takes all of them."""
    order = [F.xxhash64("doc_id"), "doc_id", "text"]
    sizes = sample.withColumn("_size", F.octet_length("text").cast("long"))
    so_far = F.sum("_size").over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    most = F.lit(None).cast("long")
    for label, size in BYTES.items():
        most = F.when(F.col("toxic") == label, F.lit(size)).otherwise(most)
    return sizes.withColumn("_sum", so_far).where(F.col("_sum") <= most).drop("_size", "_sum").orderBy(*order)


def fit(docs: DataFrame, labels: DataFrame):
    """(net, thresholds), or the share of toxic rows where there is nothing to learn from."""
    usable = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if not 0 < share < 1:
        return share, {"": PREDICTED}
    def run(batches):
        for b in chunks(batches):
            ids, at = tokens(b.column("text"))
            blobs = pa.array([ids[x:y].astype(PACKED).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), blobs, b.column("lang")], ["doc_id", "ids", "lang"])

    # Words are hashed before ids meet labels: two bytes a word are dealt out, not texts. Repeated labels count as often as they are there.
    texts = docs.where(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    known = texts.mapInArrow(lean(run), "doc_id long, ids binary, lang string").hint("merge")
    own = known.join(usable.where("toxic IN (0, 1)"), "doc_id").withColumn("held", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(10)) == 9)
    own = written(own.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "toxic", "ids"))
    n, size, part = own.agg(F.count("*"), F.sum(F.octet_length("ids").cast("long")), F.avg("toxic")).first()
    if not n or not 0 < part < 1:
        return share, {"": PREDICTED}
    if n <= FEW and size <= FEW_BYTES:
        rows = own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "ids").select("ids", "toxic", "held").collect()
        net = train([np.frombuffer(r.ids, PACKED).astype(np.int32) for r in rows], np.array([r.toxic for r in rows], np.float32), np.array([r.held for r in rows]))
    else:
        net = train_apart(own, n)
    net.shift = float(np.log(share / (1 - share)) - np.log(part / (1 - part)))
    langs, hit, at, many = binned(own, net)
    return net, thresholds(langs, hit, at, many)


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged) for each row of docs; flagged is by the language's threshold."""
    net, limits = model

    def run(batches):
        for b in chunks(batches):
            if not b.num_rows:
                continue
            if isinstance(net, float):
                s = np.full(b.num_rows, net)
            else:
                s = sigmoid(net.logits(*layout(*tokens(b.column("text")))).astype(np.float64))
            limit = np.array([limits.get(x, limits[""]) for x in b.column("lang").to_pylist()])
            out = [b.column("doc"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= PREDICTED).astype(np.int32)), pa.array(s >= limit)]
            yield pa.RecordBatch.from_arrays(out, ["doc", "held_out", "score", "predicted", "flagged"])

    own = docs.select(doc_key().alias("doc"), held_out().alias("held_out"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc long, held_out boolean, score double, predicted int, flagged boolean").select(as_id(), "held_out", "score", "predicted", "flagged")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
