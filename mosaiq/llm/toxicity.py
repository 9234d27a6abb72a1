"""Operator 2: toxicity scores of a bidirectional gated recurrent network.

A word's input is a hashed word vector beside two means of hashed vectors of its characters: of its
beginnings of ``HEADS`` bytes, and of all runs of three and four bytes, ends of the word included.
Digits and signs within words are characters like letters; only sentence marks part words. Two gated recurrent networks read a window of ``WINDOW``
words from either side; attention pools their states, and a logistic unit scores the window.
All windows of a text are scored, each ``STRIDE`` words after the one before and the last at the
text's end, so they overlap and cover every word; a text has the score of its worst window.

Training reads all labelled texts that are not held out, whole. The first component of each vector
starts at its smoothed log-odds in all of them. A text teaches by its worst window, as its score
is that window's. A common start is learnt in numpy by one
task, from at most ``SAMPLE`` texts of each label, those with the smallest hashes of their ids,
none longer than ``SAMPLE_BYTES``, with ``SAMPLE_WINDOWS`` more windows of clean texts at most: at first by the windows with the highest log-odds, then by those that
the network itself finds worst. If that is not all there is, the start names the worst windows of
every text, and in each of ``FULL_ROUNDS`` rounds every partition trains on its own; the mean of the
models, weighted by windows, is kept (tree reduction; a model has a fixed size).

A null text counts as an empty one; a text without words scores 0. Null ids and repeated rows
are scored like others. A label of null is no label; of several labels of an id the highest
counts. Without a labelled text the untrained network scores. Labels, lang, source and doc_id
are no inputs. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import held_out, materialise, trim_memory

WINDOW, STRIDE = 48, 24
WORD_BUCKETS, WORD_WIDTH = 1 << 13, 8
GRAM_BUCKETS, GRAM_WIDTH = 1 << 14, 16
HEADS, HEAD_BUCKETS, HEAD_WIDTH = (4, 5, 6), 1 << 14, 8
HIDDEN, ATTENTION = 8, 8
SAMPLE, SAMPLE_BYTES, SAMPLE_WINDOWS = 2000, 20_000, 8_000
BATCH, RATE, SLOW_RATE, ROUNDS, PRIOR = 256, 6e-3, 3e-4, (3, 3), 6
#: Steps of a round of training at least, so small samples are read again and again; how many of a bucket's
#: toxic texts are left out of its log-odds.
LEAST_STEPS, OWN = 40, 1
#: Rounds over all texts, windows that a task mixes, labels that are sent to all at most (else texts are shuffled).
FULL_ROUNDS, MIXED, BROADCAST_LABELS = 2, 8192, 1 << 20
THRESHOLD = 0.3
#: Words that a task gathers before it scores their windows.
BLOCK_WORDS = 100_000
WINDOWS_AT_ONCE = 2048
#: Windows that go through the network at once, in arrays of always this shape, and a multiple of 48, for matrix
#: products to take all rows alike: its company does not change how a window's sums are rounded, and equal texts have equal scores.
SCORED = 384
#: Words whose parts of the gates a task keeps before it starts anew, and words that it takes up at once.
KEPT_WORDS, LEARNT_WORDS = 1 << 16, 1 << 12
#: Texts whose buckets are marked at once.
TALLIED = 64

_MARKS = b" \t\n\x0b\x0c\r.,;:!?()[]{}<>\"'`|/\\"
_SEPARATED = bytes(32 if b in _MARKS or b < 32 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but white space and sentence marks, A-Z lower-cased."""
    return (text or "").encode().translate(_SEPARATED).split()


def window_starts(n_words: int) -> list[int]:
    if n_words <= WINDOW:
        return [0] if n_words else []
    return [*range(0, n_words - WINDOW, STRIDE), n_words - WINDOW]


class Inputs:
    """Hashes of distinct words: a word bucket, and buckets of their beginnings and character grams."""

    def __init__(self, words: list[bytes]):
        import numpy as np

        sizes = np.array([len(w) + 2 for w in words], np.int64)
        data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint32)
        begins = np.cumsum(sizes) - sizes
        mix = lambda x: (x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        rolled = np.zeros(len(data), np.uint32)
        weights = np.arange(len(data)) - np.repeat(begins, sizes)
        powers = np.cumprod(np.full(max(sizes, default=1), 0x01000193, np.uint32), dtype=np.uint32)
        rolled = data * powers[weights]
        self.words = (mix(np.add.reduceat(rolled, begins)) % WORD_BUCKETS).astype(np.int64)
        # a beginning has the mark of a word's start, and that of its end if the word is short
        sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(rolled, dtype=np.uint32)))
        stops = begins[:, None] + np.minimum(np.array(HEADS) + 1, sizes[:, None])
        self.heads = (mix(sums[stops] - sums[begins][:, None]) % HEAD_BUCKETS).astype(np.int64)
        grams, owners = [], []
        for n in (3, 4):
            code = np.zeros(len(data) - n + 1 if len(data) >= n else 0, np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) + data[k : k + len(code)]
            count = np.maximum(sizes - n + 1, 0)
            own = np.repeat(np.arange(len(words)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins, count)
            grams.append(mix(code[at] + np.uint32(n)) % GRAM_BUCKETS)
            owners.append(own)
        order = np.argsort(np.concatenate(owners), kind="stable")
        self.owner = np.concatenate(owners)[order]
        self.grams = np.concatenate(grams)[order].astype(np.int64)
        self.count = np.bincount(self.owner, minlength=len(words)).astype(np.float32)
        self.first = np.searchsorted(self.owner, np.arange(len(words)))

    def vectors(self, words, heads, grams):
        """(n, width) inputs; each word has a gram, as its ends count."""
        import numpy as np

        mean = np.add.reduceat(grams[self.grams], self.first, axis=0) / self.count[:, None]
        return np.concatenate((words[self.words], heads[self.heads].mean(axis=1), mean), axis=1)


def _sum_rows(index, rows, n):
    import numpy as np

    width = rows.shape[1]
    cells = (index[:, None] * width + np.arange(width)).ravel()
    return np.bincount(cells, rows.ravel(), n * width).reshape(n, width).astype(np.float32)


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, params: dict):
        self.p = params

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        import numpy as np

        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        width, h = WORD_WIDTH + HEAD_WIDTH + GRAM_WIDTH, HIDDEN
        p = {"words": draw(WORD_BUCKETS, WORD_WIDTH, scale=0.05), "heads": draw(HEAD_BUCKETS, HEAD_WIDTH, scale=0.05), "grams": draw(GRAM_BUCKETS, GRAM_WIDTH, scale=0.05)}
        for side in "fb":
            p[f"in_{side}"] = draw(width, 3 * h, scale=0.3)
            p[f"bias_{side}"] = np.zeros(3 * h, np.float32)
            p[f"state_{side}"] = draw(h, 3 * h, scale=0.3)
        p |= {"look": draw(2 * h, ATTENTION, scale=0.3), "look_bias": np.zeros(ATTENTION, np.float32), "weigh": draw(ATTENTION, scale=0.3), "out": draw(2 * h, scale=0.3), "out_bias": np.full(1, -1, np.float32)}
        return cls(p)

    def packed(self, names: list[str]) -> bytes:
        return b"".join(self.p[k].astype("<f4").tobytes() for k in names)

    def unpacked(self, data: bytes, names: list[str]) -> Network:
        """A network of this one's shapes."""
        import numpy as np

        shapes = [self.p[k].shape for k in names]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return Network({k: part.reshape(s).copy() for k, s, part in zip(names, shapes, np.split(np.frombuffer(data, "<f4"), ends), strict=True)})

    def project(self, inputs: Inputs):
        x = inputs.vectors(self.p["words"], self.p["heads"], self.p["grams"])
        return x, {s: x @ self.p[f"in_{s}"] + self.p[f"bias_{s}"] for s in "fb"}

    def states(self, projected, index, mask, keep=None):
        """(time, windows, 2 * hidden) states; ``keep`` collects what the gradient needs."""
        import numpy as np

        n, steps = index.shape
        h, out = HIDDEN, np.empty((index.shape[1], len(index), 2 * HIDDEN), np.float32)
        for side in "fb":
            state, state_in, at = np.zeros((n, h), np.float32), self.p[f"state_{side}"], slice(0, h) if side == "f" else slice(h, 2 * h)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                given = projected[side][index[:, t]]
                told = state @ state_in
                gates = _sigmoid(given[:, : 2 * h] + told[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(given[:, 2 * h :] + r * told[:, 2 * h :])
                after = new + z * (state - new)
                if mask is not None:
                    after = np.where(mask[:, t, None], after, state)
                if keep is not None:
                    keep[side, t] = (state, z, r, new, told[:, 2 * h :])
                state = after
                out[t, :, at] = state
        return out

    def pool(self, states, mask):
        import numpy as np

        looked = np.tanh(states @ self.p["look"] + self.p["look_bias"])
        weight = looked @ self.p["weigh"]
        if mask is not None:
            weight = np.where(mask.T, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return looked, weight, pooled, pooled @ self.p["out"] + self.p["out_bias"]

    def gradients(self, inputs: Inputs, index, mask, labels):
        import numpy as np

        p, h, g, keep = self.p, HIDDEN, {}, {}
        x, projected = self.project(inputs)
        states = self.states(projected, index, mask, keep)
        looked, weight, pooled, logit = self.pool(states, mask)
        d_logit = ((_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        g["out"], g["out_bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=2)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["weigh"] = np.einsum("tna,tn->a", looked, d_weight)
        d_look = d_weight[:, :, None] * p["weigh"] * (1 - looked**2)
        g["look"], g["look_bias"] = np.einsum("tns,tna->sa", states, d_look), d_look.sum(axis=(0, 1))
        d_states += d_look @ p["look"].T
        d_x = np.zeros_like(x)
        steps = index.shape[1]
        for side in "fb":
            back, d_given = np.zeros((len(index), h), np.float32), np.empty((steps, len(index), 3 * h), np.float32)
            state_in, g_state = p[f"state_{side}"], np.zeros((h, 3 * h), np.float32)
            at = slice(0, h) if side == "f" else slice(h, 2 * h)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                state, z, r, new, told = keep[side, t]
                d = d_states[t, :, at] + back
                on = mask[:, t, None]
                d_after = d * on
                d_new = d_after * (1 - z) * (1 - new**2)
                d_z = d_after * (state - new) * z * (1 - z)
                d_r = d_new * told * r * (1 - r)
                d_told = np.concatenate((d_z, d_r, d_new * r), axis=1)
                d_given[t] = np.concatenate((d_z, d_r, d_new), axis=1)
                g_state += state.T @ d_told
                back = d * ~on + d_after * z + d_told @ state_in.T
            d_projected = _sum_rows(index.T.ravel(), d_given.reshape(-1, 3 * h), len(x))
            g[f"state_{side}"], g[f"bias_{side}"], g[f"in_{side}"] = g_state, d_projected.sum(axis=0), x.T @ d_projected
            d_x += d_projected @ p[f"in_{side}"].T
        g["words"] = _sum_rows(inputs.words, d_x[:, :WORD_WIDTH], WORD_BUCKETS)
        of_heads = np.repeat(d_x[:, WORD_WIDTH : WORD_WIDTH + HEAD_WIDTH] / len(HEADS), len(HEADS), axis=0)
        g["heads"] = _sum_rows(inputs.heads.ravel(), of_heads, HEAD_BUCKETS)
        shared = d_x[:, WORD_WIDTH + HEAD_WIDTH :] / inputs.count[:, None]
        g["grams"] = _sum_rows(inputs.grams, shared[inputs.owner], GRAM_BUCKETS)
        return g


def _numbers() -> defaultdict:
    """Numbers words in the order in which they are first asked for."""
    return defaultdict(count().__next__)


class _Windows:
    """Windows of a list of texts: distinct words, word numbers by window, mask, owner.

    ``number``: that of words met before, to go on from.
    """

    def __init__(self, docs: list[list[bytes]], number: defaultdict | None = None):
        import numpy as np

        number = _numbers() if number is None else number
        sizes = np.array([len(d) for d in docs], np.int64)
        self.flat = np.fromiter(map(number.__getitem__, chain.from_iterable(docs)), np.int32, sizes.sum())
        self.begins, self.sizes = np.cumsum(sizes) - sizes, sizes
        starts = [window_starts(n) for n in sizes.tolist()]
        self.owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        self.start = np.array([s for own in starts for s in own], np.int64)
        self.words = list(number)

    def cut(self, some):
        """Words of some windows, their numbers by window, and which places have a word."""
        import numpy as np

        begin, at = self.begins[self.owner[some]][:, None], self.start[some][:, None] + np.arange(WINDOW)
        mask = at < self.sizes[self.owner[some]][:, None]
        distinct, index = np.unique(self.flat[np.where(mask, begin + at, begin)], return_inverse=True)
        return [self.words[w] for w in distinct.tolist()], index.reshape(mask.shape), mask

    def logits(self, network: Network):
        return Reader(network).logits(self)


class Reader:
    """Scores windows by one network; what a word gives to the gates is worked out once."""

    def __init__(self, network: Network):
        import numpy as np

        p, h = network.p, HIDDEN
        self.network, self.in_both = network, np.concatenate((p["in_f"], p["in_b"]), axis=1)
        self.bias = np.concatenate((p["bias_f"], p["bias_b"]))
        # exp(-x) of the gates and exp(2x) of the new state's tanh: their factors go into the weights
        factors = np.repeat(np.array([-1, -1, 2], np.float32), h)
        self.in_both, self.bias = self.in_both * np.tile(factors, 2), self.bias * np.tile(factors, 2)
        both = np.stack((p["state_f"], p["state_b"])) * factors
        self.state_in = [np.ascontiguousarray(both[:, :, k * h : (k + 1) * h]) for k in range(3)]
        self.clear()

    def clear(self):
        import numpy as np

        self.number, self.gates = _numbers(), np.empty((3, 0, 2, HIDDEN), np.float32)

    def windows(self, docs: list[list[bytes]]) -> _Windows:
        """Windows whose words are numbered as this reader knows them."""
        if len(self.number) > KEPT_WORDS:
            self.clear()
        return _Windows(docs, self.number)

    def _gates(self, words: list[bytes]):
        """(gate, word, side, hidden) parts that words give to the gates."""
        import numpy as np

        p, parts = self.network.p, [np.empty((3, 0, 2, HIDDEN), np.float32)]
        for k in range(0, len(words), LEARNT_WORDS):
            x = Inputs(words[k : k + LEARNT_WORDS]).vectors(p["words"], p["heads"], p["grams"])
            # unlike a product of matrices, this sums a row alike wherever it stands
            given = np.einsum("ij,jk->ik", x, self.in_both) + self.bias
            parts.append(given.reshape(-1, 2, 3, HIDDEN).transpose(2, 0, 1, 3))
        return np.concatenate(parts, axis=1)

    def logits(self, windows: _Windows):
        """Of windows that ``windows`` gave."""
        import numpy as np

        if len(windows.words) <= 2 * KEPT_WORDS:
            new = windows.words[self.gates.shape[1] :]
            if new:
                self.gates = np.concatenate((self.gates, self._gates(new)), axis=1)
            size = np.minimum(windows.sizes[windows.owner], WINDOW)
            return self._scores(self.gates, windows.flat, windows.begins[windows.owner] + windows.start, size)
        out = np.empty(len(windows.owner), np.float32)
        for k in range(0, len(out), WINDOWS_AT_ONCE):  # a text of very many words: nothing is kept
            words, index, mask = windows.cut(some := np.arange(k, min(k + WINDOWS_AT_ONCE, len(out))))
            out[some] = self._scores(self._gates(words), index.ravel(), np.arange(len(some)) * WINDOW, mask.sum(axis=1))
        return out

    def _scores(self, gates, flat, begin, size):
        """Logits of windows, each ``size`` word numbers of ``flat`` from ``begin`` on."""
        import numpy as np

        out = np.empty(len(begin), np.float32)
        whole, short = np.flatnonzero(size == WINDOW), np.flatnonzero(size < WINDOW)
        short = short[np.argsort(size[short], kind="stable")]
        for some in [part[k : k + SCORED] for part in (whole, short) for k in range(0, len(part), SCORED)]:
            chosen = np.resize(some, SCORED)
            steps = np.arange(size[some[-1]])[:, None]
            on = None if size[some[0]] == WINDOW else steps < size[chosen]
            index = flat[begin[chosen] + (steps if on is None else np.where(on, steps, 0))]
            with np.errstate(over="ignore"):  # an infinite exp is a gate that is shut
                out[some] = self._forward(gates, index, on)[: len(some)]
        return out

    def _forward(self, gates, index, on):
        """Logits of SCORED windows; (time, windows) word numbers, and which places have a word (None: all)."""
        import numpy as np

        (steps, n), h, p = index.shape, HIDDEN, self.network.p
        # forward rows, then those of the way back, which takes the times from the last on
        rows = np.concatenate((2 * index, 2 * index[::-1] + 1), axis=1)
        tables = gates.reshape(3, -1, h)
        both = None if on is None else np.stack((on, on[::-1]), axis=1).astype(np.float32)[..., None]
        z, r, new, told = np.empty((4, 2, n, h), np.float32)
        state, states = np.zeros((2, n, h), np.float32), np.empty((steps, 2, n, h), np.float32)
        for t in range(steps):
            for table, gate in zip(tables, (z, r, new), strict=True):
                np.take(table, rows[t], axis=0, out=gate.reshape(2 * n, h), mode="clip")
            for weights, gate in zip(self.state_in, (z, r), strict=False):
                gate += np.matmul(state, weights, out=told)
                np.exp(gate, out=gate)
                gate += 1
            np.matmul(state, self.state_in[2], out=told)
            told /= r
            new += told
            np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1  # tanh(x) is 1 - 2 / (1 + exp(2x))
            state -= new
            state /= z
            state += new
            if both is not None:
                state *= both[t]  # the way back starts from nothing at a text's last word
            states[t] = state
        forth, back = states[:, 0], states[::-1, 1]
        looked = forth @ p["look"][:h]
        looked += back @ p["look"][h:]
        looked += p["look_bias"]
        weight = np.tanh(looked, out=looked) @ p["weigh"]
        if on is not None:
            weight = np.where(on, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        told = forth @ p["out"][:h] + back @ p["out"][h:]
        return (weight * told).sum(axis=0) / weight.sum(axis=0) + p["out_bias"]


def _tally(windows: _Windows, labels):
    """Texts by label, and by label those with each bucket: of words, heads and grams, one after another."""
    import numpy as np

    width = WORD_BUCKETS + HEAD_BUCKETS + GRAM_BUCKETS
    seen, n = np.zeros((2, width), np.int64), len(windows.words)
    if n:
        inputs = Inputs(windows.words)
        count = inputs.count.astype(np.int64)
    for k in range(0, len(labels) if n else 0, TALLIED):
        sizes = windows.sizes[k : k + TALLIED]
        flat = windows.flat[windows.begins[k] : windows.begins[k] + sizes.sum()]
        pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + flat)
        row, word = pairs // n, pairs % n
        held = np.zeros((len(sizes), width), bool)
        held[row, inputs.words[word]] = True
        held[row[:, None], WORD_BUCKETS + inputs.heads[word]] = True
        size = count[word]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - inputs.first[word], size)
        held[np.repeat(row, size), WORD_BUCKETS + HEAD_BUCKETS + inputs.grams[at]] = True
        for label in (0, 1):
            seen[label] += held[labels[k : k + TALLIED] == label].sum(axis=0)
    return np.bincount(labels, minlength=2), seen


def _log_odds(texts, seen, params: dict):
    """Puts into the first components of the vectors how much likelier a text with that bucket is
    toxic; rare buckets are drawn to the share of toxic texts."""
    import numpy as np

    share = (texts[1] + 1) / (texts.sum() + 2)
    parts = np.split(seen, [WORD_BUCKETS, WORD_BUCKETS + HEAD_BUCKETS], axis=1)
    for name, counts in zip(("words", "heads", "grams"), parts, strict=True):
        # less one: what a single toxic text holds tells nothing, least of all about that text
        odds = (np.maximum(counts[1] - OWN, 0) + PRIOR * share) / (counts[0] + PRIOR * (1 - share))
        params[name][:, 0] = np.clip(np.log(odds * (1 - share) / share), -1, 5)


def _first_ranks(windows: _Windows, params: dict):
    """The highest log-odds of a word in each window."""
    import numpy as np

    out = np.empty(len(windows.owner))
    for k in range(0, len(out), WINDOWS_AT_ONCE):
        words, index, mask = windows.cut(some := np.arange(k, min(k + WINDOWS_AT_ONCE, len(out))))
        inputs = Inputs(words)
        odds = params["words"][inputs.words, 0] + params["heads"][inputs.heads, 0].mean(axis=1) + np.add.reduceat(params["grams"][inputs.grams, 0], inputs.first) / inputs.count
        out[some] = np.where(mask, odds[index], -np.inf).max(axis=1)
    return out


class _Steps:
    """Steps of adaptive gradients."""

    def __init__(self, network: Network):
        import numpy as np

        self.network, self.step = network, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}

    def take(self, windows: _Windows, some, labels):
        import numpy as np

        words, index, mask = windows.cut(some)
        self.step += 1
        for name, value in self.network.gradients(Inputs(words), index, mask, labels).items():
            m, v = self.moments[name]
            m += 0.1 * (value - m)
            v += 0.01 * (value * value - v)
            rate = SLOW_RATE if name in ("words", "heads", "grams") else RATE
            self.network.p[name] -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)


def train_network(texts: list[str | None], labels: list[int], seed: int = 7, tally: tuple | None = None) -> Network:
    """A network learnt from whole texts and their labels; ``tally``: that of more texts, for the log-odds."""
    import numpy as np

    network = Network.start(seed)
    windows, rng = _Windows([words_of(t) for t in texts]), np.random.default_rng(seed)
    if not windows.words and tally is None:
        return network
    label = np.array(labels, np.int64)
    _log_odds(*(tally or _tally(windows, label)), network.p)
    if not windows.words:
        return network
    mine = label[windows.owner]
    steps = _Steps(network)
    for stage, rounds in enumerate(ROUNDS):
        rank = windows.logits(network) if stage else _first_ranks(windows, network.p)
        worst = np.full(len(label), -np.inf)
        np.maximum.at(worst, windows.owner, rank)
        top = rank >= worst[windows.owner]
        toxic = np.flatnonzero((mine == 1) & top)
        clean = np.concatenate((np.flatnonzero((mine == 0) & top), rng.permutation(np.flatnonzero((mine == 0) & ~top))[:SAMPLE_WINDOWS]))
        used = np.concatenate((toxic, clean))
        for _ in range(max(rounds, -(-rounds * LEAST_STEPS * BATCH // max(len(used), BATCH)))):
            used = rng.permutation(used)
            for k in range(0, len(used), BATCH):
                some = used[k : k + BATCH]
                steps.take(windows, some, mine[some])
    return network


def _known(labels: DataFrame, modulus: int) -> DataFrame:
    """doc_id and toxic of all labels to learn from."""
    known = labels.select(F.col("doc_id").cast("bigint"), "toxic").where("doc_id is not null and toxic is not null")
    return known.where(~held_out(F.col("doc_id"), modulus)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _sample_rows(docs: DataFrame, labels: DataFrame, modulus: int, sample: int) -> DataFrame:
    """text and label (0 or 1) of the rows to start from, in one partition and in order; 2 * sample at most."""
    known = _known(labels, modulus)
    parts = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * sample rows at most, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    first = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sample)
    return first.select("text", (F.col("toxic") > 0).cast("int").alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, modulus: int = 4, sample: int = SAMPLE) -> tuple[list, list]:
    """Texts and labels to start from; bounded, so they fit on the driver."""
    rows = _sample_rows(docs, labels, modulus, sample).collect()
    return [r.text for r in rows], [r.label for r in rows]


def training_texts(docs: DataFrame, labels: DataFrame, modulus: int = 4) -> DataFrame:
    """text and label (0 or 1) of every row to learn from."""
    known = materialise(_known(labels, modulus), "labels")
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").join(known, "doc_id")
    return texts.select("text", (F.col("toxic") > 0).cast("int").alias("label"))


def _blocks(batches):
    """Lists of words and labels of some rows at a time."""
    texts, labels, held = [], [], 0
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"].to_pylist(), strict=True):
            texts.append(words_of(text.as_py()))
            labels.append(label)
            held += len(texts[-1])
            if held >= BLOCK_WORDS:
                yield texts, labels
                texts, labels, held = [], [], 0
    if texts:
        yield texts, labels


def tally_texts(training: DataFrame) -> tuple:
    """``_tally`` of all texts; what a task gives and the driver takes has a fixed size."""
    import numpy as np

    def count(batches):
        import numpy as np
        import pyarrow as pa

        n, seen = np.zeros(2, np.int64), np.zeros((2, WORD_BUCKETS + HEAD_BUCKETS + GRAM_BUCKETS), np.int64)
        for texts, labels in _blocks(batches):
            more_n, more = _tally(_Windows(texts), np.array(labels))
            n += more_n
            seen += more
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes() + seen.tobytes()], pa.binary())], ["tally"])
        trim_memory()

    def add(x, y):
        return (np.frombuffer(x, np.int64) + np.frombuffer(y, np.int64)).tobytes() if x and y else x or y

    parts = training.mapInArrow(count, "tally binary").rdd.map(lambda r: bytes(r[0]))
    found = np.frombuffer(parts.treeAggregate(b"", add, add, 3) or bytes(8 * (2 + 2 * (WORD_BUCKETS + HEAD_BUCKETS + GRAM_BUCKETS))), np.int64)
    return found[:2], found[2:].reshape(2, -1)


def _worst_windows(training: DataFrame, network: Network) -> DataFrame:
    """text (the words of the worst window) and label of every text that has words."""
    sent = training.sparkSession.sparkContext.broadcast(network.p)

    def choose(batches):
        import numpy as np
        import pyarrow as pa

        reader = Reader(Network(sent.value))
        for texts, labels in _blocks(batches):
            windows, label = reader.windows(texts), np.array(labels)
            order = np.lexsort((-reader.logits(windows), windows.owner))
            owner, first = np.unique(windows.owner, return_index=True)
            start = windows.start[order[first]]
            made = [b" ".join(texts[d][a : a + WINDOW]).decode() for d, a in zip(owner.tolist(), start.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(label[owner], pa.int32())], ["text", "label"])
        trim_memory()

    return training.mapInArrow(choose, "text string, label int")


def _train_round(windows: DataFrame, network: Network, seed: int) -> Network:
    """The mean of the networks that each partition learns from its own windows."""
    import numpy as np

    names = list(network.p)
    sent = windows.sparkSession.sparkContext.broadcast(network.p)

    def train(batches):
        import numpy as np
        import pyarrow as pa

        mine, rng, seen = Network({k: v.copy() for k, v in sent.value.items()}), np.random.default_rng(seed), 0
        steps, texts, labels = _Steps(mine), [], []

        def learn():
            own, label = _Windows(texts), np.array(labels)
            used = rng.permutation(len(own.owner))
            for k in range(0, len(used), BATCH):
                steps.take(own, used[k : k + BATCH], label[own.owner[used[k : k + BATCH]]])
            return len(used)

        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                texts.append(text.encode().split(b" "))
                labels.append(label)
                if len(texts) >= MIXED:
                    seen += learn()
                    texts, labels = [], []
        if texts:
            seen += learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([mine.packed(names)], pa.binary())], ["seen", "model"])
        trim_memory()

    def mean(x, y):
        if not x[0] or not y[0]:
            return x if x[0] else y
        n = x[0] + y[0]
        mixed = np.frombuffer(x[1], "<f4") * np.float64(x[0] / n) + np.frombuffer(y[1], "<f4") * np.float64(y[0] / n)
        return n, mixed.astype("<f4").tobytes()

    trained = windows.mapInArrow(train, "seen bigint, model binary").rdd.map(lambda r: (r[0], bytes(r[1])))
    seen, data = trained.treeAggregate((0, b""), mean, mean, 3)
    return network.unpacked(data, names) if seen else network


def learn_start(rows: DataFrame, tally: tuple) -> tuple[int, Network]:
    """How many texts ``rows`` (text, label, one partition) has, and ``train_network`` of them.

    A task learns: the driver holds neither the texts nor what learning needs, some hundred MB.
    """
    blank = Network.start()
    names = list(blank.p)
    sent = rows.sparkSession.sparkContext.broadcast(tally)

    def train(batches):
        import pyarrow as pa

        texts, labels = [], []
        for batch in batches:
            texts += batch["text"].to_pylist()
            labels += batch["label"].to_pylist()
        if texts:
            made = train_network(texts, labels, tally=sent.value).packed(names)
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)], pa.int64()), pa.array([made], pa.binary())], ["seen", "model"])
        del texts
        trim_memory()

    found = rows.mapInArrow(train, "seen bigint, model binary").collect()
    if not found:
        return 0, train_network([], [], tally=tally)
    (row,) = found
    return row.seen, blank.unpacked(bytes(row.model), names)


def learn_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, sample: int = SAMPLE) -> Network:
    """A network learnt from every labelled text that is not held out."""
    training = training_texts(docs, labels, modulus)
    texts, seen = tally_texts(training)
    known, network = learn_start(_sample_rows(docs, labels, modulus, sample), (texts, seen))
    if texts.sum() == known:
        return network
    windows = materialise(_worst_windows(training, network), "toxic-windows")
    for k in range(FULL_ROUNDS):
        network = _train_round(windows, network, k)
    return network


def score_toxicity(docs: DataFrame, network: Network, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (doc_id by default) of every row, with score, n_windows and the first
    word of the worst window (null without words)."""
    carry = carry or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(network.p)

    def score(batches):
        import numpy as np
        import pyarrow as pa

        reader = Reader(Network(sent.value))

        def scored(batch, texts):
            windows = reader.windows(texts)
            logit = reader.logits(windows).astype(np.float64)
            n = np.bincount(windows.owner, minlength=len(texts))
            made, first = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            has = n > 0
            begins = (np.cumsum(n) - n)[has]
            if has.any():
                worst = np.maximum.reduceat(logit, begins)
                made[has] = _sigmoid(worst)
                at = np.flatnonzero(logit == np.repeat(worst, n[has]))
                owner, where = np.unique(windows.owner[at], return_index=True)
                first[owner] = windows.start[at[where]]
            columns = [batch.column(c) for c in carry] + [pa.array(made), pa.array(n.astype(np.int64)), pa.array(first, mask=~has)]
            return pa.RecordBatch.from_arrays(columns, [*carry, "score", "n_windows", "worst_word"])

        for batch in batches:
            begin, held, texts = 0, 0, []
            for k, text in enumerate(batch["text"].to_pylist()):
                texts.append(words_of(text))
                held += len(texts[-1])
                if held >= BLOCK_WORDS:
                    yield scored(batch.slice(begin, len(texts)), texts)
                    begin, held, texts = k + 1, 0, []
            if texts:
                yield scored(batch.slice(begin, len(texts)), texts)
        trim_memory()

    kept = docs.select(*dict.fromkeys([*carry, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "score double, n_windows bigint, worst_word bigint"])
    return kept.mapInArrow(score, schema)
