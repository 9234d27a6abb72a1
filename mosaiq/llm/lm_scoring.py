"""Operator 1: scores of a log-bilinear language model trained with noise-contrastive estimation.

Tokens are the words between ASCII white space, A-Z lower-cased, and one end token a text. The
model has ``CLASSES`` classes: the end, the most frequent words, and one class for the others.
Two previous classes predict the next: their vectors, each through its own matrix, add up to
a vector whose products with the classes' vectors, plus biases, are log-probabilities but for
a constant. A word of the common class has the class's probability times its add-one share in it, all
unknown words together counting as one; so the probabilities of all tokens sum to one.

Word counts come from all training texts. Training, too, reads all of them: a round on an
eighth gives all partitions a common start, and a full round follows; in either each partition
runs noise-contrastive estimation on its own texts and the weighted mean of the models is kept
(tree reduction; a model has a fixed size). The constants of all pairs of classes are found by
batched matrix products, once. The ``HEAD`` most frequent words, of ``HEAD_BYTES`` at most, go to
every worker; counts of the other words are joined.

A null text counts as an empty one: its end token alone. A row with a null id learns. Repeated
rows count and are scored repeatedly. Without any training text N and V are 0 and every score
is that of the untrained model. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import held_out, materialise

CLASSES, WIDTH, BATCH, NOISE = 1024, 24, 512, 32
HEAD, HEAD_BYTES = 1 << 18, 64
COUNTER_ENTRIES = 400_000
RATE = 0.15
END = b""  # no word is empty


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def word_counts(training: DataFrame) -> DataFrame:
    """word (binary; the end is empty) and c, over all texts."""

    def count(batches):
        import pyarrow as pa

        def made(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update(tokens_of(text))
                if len(counts) >= COUNTER_ENTRIES:
                    yield made(counts)
                    counts = Counter()
        if counts:
            yield made(counts)

    return training.select("text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class LogBilinear:
    """Vectors of context and target classes, two context matrices, biases."""

    NAMES = ("context", "first", "second", "target", "bias")

    def __init__(self, params: dict):
        self.params = params

    @classmethod
    def start(cls, noise, width: int = WIDTH, seed: int = 1) -> LogBilinear:
        import numpy as np

        rng, n = np.random.default_rng(seed), len(noise)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        eye = np.eye(width, dtype=np.float32)
        return cls({"context": draw(n, width), "first": eye + draw(width, width), "second": 0.5 * eye + draw(width, width), "target": draw(n, width), "bias": np.log(noise).astype(np.float32)})

    def predict(self, before):
        p = self.params
        return p["context"][before[:, 0]] @ p["first"] + p["context"][before[:, 1]] @ p["second"]

    def train(self, stream, noise, seed: int) -> int:
        """One step of adaptive gradients for each (next, before) batch; returns the tokens seen."""
        import numpy as np

        p = self.params
        rng, seen = np.random.default_rng(seed), 0
        sums = {k: np.full_like(v, 1e-2) for k, v in p.items()}
        cumulated, log_noise = np.cumsum(noise), np.log(noise * NOISE).astype(np.float32)

        def rows(name, index, grad):
            shape = p[name].shape
            cells = index if grad.ndim == 1 else (index[:, None] * shape[1] + np.arange(shape[1])).ravel()
            whole(name, np.bincount(cells, grad.ravel(), p[name].size).reshape(shape).astype(np.float32))

        def whole(name, grad):
            sums[name] += grad * grad
            p[name] -= RATE * grad / np.sqrt(sums[name])

        for following, before in stream:
            n = len(following)
            drawn = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), len(noise) - 1)
            guess = self.predict(before)
            target, noisy = p["target"][following], p["target"][drawn]
            true = (guess * target).sum(axis=1) + p["bias"][following] - log_noise[following]
            false = guess @ noisy.T + p["bias"][drawn] - log_noise[drawn]
            g_true = -1 / (1 + np.exp(np.clip(true, -30, 30)))
            g_false = 1 / (1 + np.exp(np.clip(-false, -30, 30)))
            g_true, g_false = (g_true / n).astype(np.float32), (g_false / n).astype(np.float32)
            g_guess = g_true[:, None] * target + g_false @ noisy
            a, b = p["context"][before[:, 0]], p["context"][before[:, 1]]
            g_a, g_b = g_guess @ p["first"].T, g_guess @ p["second"].T
            g_first, g_second = a.T @ g_guess, b.T @ g_guess
            which = np.concatenate((following, drawn))
            rows("target", which, np.concatenate((g_true[:, None] * guess, g_false.T @ guess)))
            rows("bias", which, np.concatenate((g_true, g_false.sum(axis=0))))
            rows("context", before.T.ravel(), np.concatenate((g_a, g_b)))
            whole("first", g_first)
            whole("second", g_second)
            seen += n
        return seen

    def constants(self):
        """(classes, classes) log of the sum over next classes, by the two classes before."""
        import numpy as np

        p = self.params
        a, b = p["context"] @ p["first"], p["context"] @ p["second"]
        out = np.empty((len(a), len(a)), np.float32)
        for k in range(len(a)):
            scores = (a[k] + b) @ p["target"].T + p["bias"]
            top = scores.max(axis=1)
            out[k] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return out

    def dump(self) -> bytes:
        return b"".join(self.params[k].astype("<f4").tobytes() for k in self.NAMES)

    @classmethod
    def load(cls, data: bytes, classes: int, width: int = WIDTH) -> LogBilinear:
        import numpy as np

        flat, at, params = np.frombuffer(data, "<f4"), 0, {}
        for name, shape in zip(cls.NAMES, ((classes, width), (width, width), (width, width), (classes, width), (classes,)), strict=True):
            size = int(np.prod(shape))
            params[name] = flat[at : at + size].reshape(shape).copy()
            at += size
        return cls(params)


def _contexts(classes, starts, end_class):
    """The two classes before each token; those before a text's first are the end's."""
    import numpy as np

    before = np.empty((len(classes), 2), np.int32)
    before[0:1], before[1:, 0] = end_class, classes[:-1]
    before[:2, 1], before[2:, 1] = end_class, classes[:-2]
    before[starts] = end_class
    second = starts + 1
    before[second[second < len(classes)], 1] = end_class
    return before


def _train(training: DataFrame, model: LogBilinear, noise, class_of: dict) -> LogBilinear:
    import numpy as np

    n_classes = len(noise)
    sent = training.sparkSession.sparkContext.broadcast((model.dump(), noise, class_of))

    def train(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        data, noise, class_of = sent.value
        mine = LogBilinear.load(data, n_classes)

        def stream():
            for batch in batches:
                texts = batch["text"].to_pylist()
                for at in range(0, len(texts), 500):
                    docs = [tokens_of(t) for t in texts[at : at + 500]]
                    sizes = np.array([len(d) for d in docs])
                    flat = itertools.chain.from_iterable(docs)
                    classes = np.fromiter(map(class_of.get, flat, itertools.repeat(0)), np.int32, sizes.sum())
                    before = _contexts(classes, np.cumsum(sizes) - sizes, class_of[END])
                    for k in range(0, len(classes), BATCH):
                        yield classes[k : k + BATCH], before[k : k + BATCH]

        seen = mine.train(stream(), noise, TaskContext.get().partitionId())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([mine.dump()], pa.binary())], ["seen", "model"])

    def mean(x, y):
        n = x[0] + y[0]
        mixed = (np.frombuffer(x[1], "<f4") * np.float64(x[0] / n) + np.frombuffer(y[1], "<f4") * np.float64(y[0] / n)).astype("<f4")
        return n, mixed.tobytes()

    trained = training.select("text").mapInArrow(train, "seen bigint, model binary").rdd.map(lambda r: (r[0], bytes(r[1])))
    seen, data = trained.treeAggregate((0, b""), lambda x, y: mean(x, y) if x[0] else y, lambda x, y: (mean(x, y) if x[0] and y[0] else x if x[0] else y), 3)
    return LogBilinear.load(data, n_classes) if seen else model


def score_documents(docs: DataFrame, modulus: int = 7, classes: int = CLASSES, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    import numpy as np

    named = docs.select(F.col("doc_id").cast("bigint"), "text").withColumn("held_out", held_out(F.col("doc_id"), modulus))
    training = named.filter("not held_out")
    counts = materialise(word_counts(training), "word-counts")
    n_all, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(head).toArrow()
    words, tally = top["word"].to_pylist(), top["c"].to_pylist()
    common = [END, *[w for w in words[: classes - 1] if w != END]][: classes - 1]
    class_of = {w: k + 1 for k, w in enumerate(common)}
    known = dict(zip(words, tally, strict=True))
    in_classes = np.array([known.get(w, 0) for w in common], np.float64)
    rest = n_all - in_classes.sum()
    noise = np.concatenate(([rest], in_classes)) + 1
    noise /= noise.sum()
    # shares in the common class: (c + 1) / rest_mass, and 1 / rest_mass for unknown words
    rest_mass = float(rest + (n_types - np.count_nonzero(in_classes)) + 1)

    model = LogBilinear.start(noise)
    model = _train(training.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 8 == 1), model, noise, class_of)
    model = _train(training, model, noise, class_of)
    place = {w: k for k, w in enumerate([*words, *[w for w in common if w not in known]])}
    tallies = np.array([known.get(w, 0) for w in place], np.float64)
    to_class = np.array([class_of.get(w, 0) for w in place], np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((place, np.append(np.log10(tallies + 1), 0.0), np.append(to_class, 0).astype(np.int32), np.append(tallies > 0, False), model.dump(), model.constants()))
    n_classes, log_rest = len(noise), float(np.log10(rest_mass))

    def score(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        place, log_tally, to_class, is_known, data, constants = sent.value
        model = LogBilinear.load(data, n_classes)
        target, bias = model.params["target"], model.params["bias"]
        end_class, key = to_class[place[END]], TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts, out = batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["held_out"].to_pylist()
            for at in range(0, len(texts), 300):
                docs = [tokens_of(t) for t in texts[at : at + 300]]
                sizes = np.array([len(d) for d in docs])
                flat = list(itertools.chain.from_iterable(docs))
                placed = np.fromiter(map(place.get, flat, itertools.repeat(-1)), np.int32, len(flat))
                following, starts = to_class[placed], np.cumsum(sizes) - sizes
                before = _contexts(following, starts, end_class)
                logs = np.empty(len(flat))
                for k in range(0, len(flat), 1 << 15):
                    b, f = before[k : k + (1 << 15)], following[k : k + (1 << 15)]
                    logs[k : k + (1 << 15)] = (model.predict(b) * target[f]).sum(axis=1) + bias[f] - constants[b[:, 0], b[:, 1]]
                logs /= np.log(10)
                shares = log_tally[placed]
                logs += np.where(following == 0, shares - log_rest, 0)
                missing = np.flatnonzero(placed < 0)
                owner = np.searchsorted(starts, missing, "right") - 1
                far: list[Counter] = [Counter() for _ in docs]
                for d, t in zip(owner.tolist(), missing.tolist(), strict=True):
                    far[d][flat[t]] += 1
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + n)),
                        pa.array(ids[at : at + 300], pa.int64()),
                        pa.array(out[at : at + 300], pa.bool_()),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(np.add.reduceat(is_known[placed].astype(np.int64), starts)),
                        pa.array(np.add.reduceat(shares, starts)),
                        pa.array(np.add.reduceat(logs, starts)),
                        pa.array([list(c) for c in far], pa.list_(pa.binary())),
                        pa.array([list(c.values()) for c in far], pa.list_(pa.int64())),
                    ],
                    ["row_key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "words", "times"],
                )
                key += n

    kind = "row_key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, words array<binary>, times array<bigint>"
    scored = materialise(named.mapInArrow(score, kind), "lm-scored")
    far = scored.select("row_key", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row_key", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    found = far.join(counts, "word")  # unknown words add nothing
    added = found.groupBy("row_key").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("more_logs"))
    joined = scored.drop("words", "times").join(added, "row_key", "left")
    more = F.coalesce("more_logs", F.lit(0.0))
    log_all = F.log10(F.lit(float(n_all + n_types + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
