"""Language-model scores of review comments: a gated recurrent network over word symbols beside a smoothed word count.

Counts cover every training comment. The commonest words are symbols of their own; all others fall into symbols by spelling,
inside which a word has its smoothed share, so the network's score is the log-probability of the very text. Symbols are
factored into classes: a softmax over classes and one within the class. The network is trained by truncated backpropagation
through time, each task on its own comments, and the tasks' weights are averaged after every round. Scoring carries the state
from window to window through the whole comment.

Every comment is split and looked up once, against a table of bounded size that every task holds, and staged as its symbols
(two bytes each); training and scoring read those alone. The rest of the vocabulary grows with the corpus and is joined by a
shuffle of (comment, word, count) rows. Weights are a few hundred kilobytes whatever the input.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siliscope.llm.common import crc_remainder, small_batches, text_of
from siliscope.sources.staging import stage

ALPHA = 0.1
TABLE_WORDS = 200_000  # words of the table that tasks hold
TABLE_BYTES = 64  # longer words are never in it
CLASSES, PER_CLASS = 33, 32
SPELLINGS = 32  # symbols for all words without a symbol of their own
SYMBOLS = CLASSES * PER_CLASS
END = 0  # ends a comment, and starts it
HIDDEN = 16
WINDOW = 32
STREAMS = 512  # comments trained side by side
SCORED = 2048  # comments scored side by side
CHUNK_TOKENS = 2_000_000  # trained at once
SCORED_TOKENS = 8_000_000  # scored at once: long comments are walked through beside as many others as possible
SLICE = 8192  # states whose outputs are worked out at once, few enough for a processor's cache
FAN = 32  # tasks that add up the weights of all others
MOST = 60.0  # of a logit, so that its exponential fits a single-precision number
ONES = {n: np.ones(n, np.float32) for n in (CLASSES, PER_CLASS)}


def spelling(word: bytes) -> int:
    """The symbol of a word by its last two bytes."""
    return 1 + zlib.crc32(word[-2:]) % SPELLINGS


class _Table(dict):
    """Word to place; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Vocabulary:
    """Counts of the common words, their symbols, and the mass of each spelling symbol."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, ends: int, masses: np.ndarray):
        self.words, self.counts = words, counts.astype(float)
        self.total, self.distinct, self.ends = total, distinct, ends
        own = min(len(words), SYMBOLS - 1 - SPELLINGS)
        self.symbols = np.array([*range(1 + SPELLINGS, 1 + SPELLINGS + own), *map(spelling, words[own:])], np.int64)
        self.own = own
        #: summed count + ALPHA of the words behind each spelling symbol, with ALPHA for unseen words
        self.log_mass = np.log10(masses + ALPHA)
        self.log_scale = float(np.log10(total + ALPHA * (distinct + 1)))
        self.log_count = np.log10(self.counts + ALPHA)
        self.table: _Table | None = None

    def lookup(self) -> _Table:
        if self.table is None:
            self.table = _Table(zip(self.words, range(len(self.words))))
        return self.table

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def unigram(self) -> np.ndarray:
        """Share of every symbol in the training tokens, slightly smoothed."""
        p = np.full(SYMBOLS, 1e-3)
        p[END] += self.ends
        p[1:1 + SPELLINGS] += 10 ** self.log_mass - ALPHA
        p[1 + SPELLINGS:1 + SPELLINGS + self.own] += self.counts[:self.own]
        return p / p.sum()

    def ids(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """Table index of every word, -1 for those outside, and the words."""
        words = text.lower().split()
        return np.fromiter(map(self.lookup().__getitem__, words), np.int64, len(words)), words

    def sequence(self, ids: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Symbols of a text and its end."""
        out = np.empty(len(ids) + 1, np.int64)
        out[-1] = END
        if len(self.symbols):
            out[:-1] = self.symbols[ids]
        for i in np.flatnonzero(ids < 0).tolist():
            out[i] = spelling(words[i])
        return out


SHAPES = (("inputs", (SYMBOLS, 3 * HIDDEN)), ("state", (HIDDEN, 3 * HIDDEN)), ("state_bias", (3 * HIDDEN,)),
          ("classes", (HIDDEN, CLASSES)), ("class_bias", (CLASSES,)), ("within", (CLASSES, HIDDEN, PER_CLASS)), ("within_bias", (CLASSES, PER_CLASS)))


def class_of(symbols: np.ndarray) -> np.ndarray:
    """Symbols are dealt to classes in turn, so every class has common and rare ones."""
    return symbols % CLASSES


class Network:
    """Gated recurrent unit with a class-factored output."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, unigram: np.ndarray) -> Network:
        """Small random weights; the biases alone give the unigram shares."""
        rng = np.random.default_rng(11)
        w = {name: (rng.standard_normal(shape) * (0.0 if "bias" in name else 0.1)).astype(np.float32) for name, shape in SHAPES}
        w["classes"] *= 0
        w["within"] *= 0
        by_class = unigram.reshape(PER_CLASS, CLASSES).T  # symbol = place * CLASSES + class
        w["class_bias"] = np.log(by_class.sum(1)).astype(np.float32)
        w["within_bias"] = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
        return cls(w)

    def packed(self) -> bytes:
        return np.concatenate([self.w[name].ravel() for name, _ in SHAPES]).astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Network:
        flat, out, at = np.frombuffer(data, np.float32), {}, 0
        for name, shape in SHAPES:
            n = int(np.prod(shape))
            out[name] = flat[at:at + n].reshape(shape).copy()
            at += n
        return cls(out)

    def step(self, symbols: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states after one more symbol each."""
        return self._step(self.w["inputs"].take(symbols, 0), h)[0]

    def _step(self, gate: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        own = h @ self.w["state"]
        own += self.w["state_bias"]
        rz = gate[:, :2 * HIDDEN] + own[:, :2 * HIDDEN]
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        r, z, own_n = rz[:, :HIDDEN], rz[:, HIDDEN:], own[:, 2 * HIDDEN:]
        n = r * own_n
        n += gate[:, 2 * HIDDEN:]
        np.tanh(n, out=n)
        after = h - n
        after *= z
        after += n
        return after, rz, n, own_n

    def output(self, h: np.ndarray, target: np.ndarray, gradients: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target after its state; with ``gradients``, adds the weights' and returns the states'."""
        w, cls, place = self.w, class_of(target), target // CLASSES
        # a state's entries are below 1 in size, so weights tell whether any logit can be too large
        clip = max(float((np.abs(w[n]).sum(-2) + np.abs(w[b])).max()) for n, b in (("classes", "class_bias"), ("within", "within_bias"))) > MOST
        d = h @ w["classes"]  # logits, then their exponentials, then the loss's slopes, in place
        d += w["class_bias"]
        if clip:
            np.minimum(d, MOST, out=d)
        rows = np.arange(len(target))
        logp = d[rows, cls]
        np.exp(d, out=d)
        total = d @ ONES[CLASSES]
        logp -= np.log(total)
        dh = None
        if gradients is not None:
            d *= (1 / total)[:, None]
            d[rows, cls] -= 1
            gradients["classes"] += h.T @ d
            gradients["class_bias"] += np.ones(len(d), d.dtype) @ d
            dh = d @ w["classes"].T
        # classes in turn, each a slice of the rows sorted by class
        order = np.argsort(cls.astype(np.uint8), kind="stable")  # a radix sort for so small a type
        cuts = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])
        by_class, places, logs = h.take(order, 0), place[order], np.empty(len(order), h.dtype)
        back = None if gradients is None else np.empty_like(by_class)
        for c in range(CLASSES):
            lo, hi = cuts[c], cuts[c + 1]
            if lo == hi:
                continue
            hc = by_class[lo:hi]
            here, at = rows[:hi - lo], places[lo:hi]
            d = hc @ w["within"][c]
            d += w["within_bias"][c]
            if clip:
                np.minimum(d, MOST, out=d)
            logs[lo:hi] = d[here, at]
            np.exp(d, out=d)
            total = d @ ONES[PER_CLASS]
            logs[lo:hi] -= np.log(total)
            if gradients is not None:
                d *= (1 / total)[:, None]
                d[here, at] -= 1
                gradients["within"][c] += hc.T @ d
                gradients["within_bias"][c] += np.ones(len(d), d.dtype) @ d
                back[lo:hi] = d @ w["within"][c].T
        logp[order] += logs
        if gradients is not None:
            unsorted = np.empty_like(order)
            unsorted[order] = rows
            dh += back.take(unsorted, 0)
        return logp, dh

    def log10_of(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Log10-probability of whole symbol sequences; the state is carried through all windows of each."""
        out = np.zeros(len(sequences))
        if not sequences:
            return out
        flat, all_lengths = np.concatenate(sequences), np.array([len(s) for s in sequences])
        starts = np.cumsum(all_lengths) - all_lengths
        by_length = np.argsort(-all_lengths, kind="stable")
        for lo in range(0, len(sequences), SCORED):
            part = by_length[lo:lo + SCORED]
            lengths, at = all_lengths[part], starts[part]
            h = np.zeros((len(part), HIDDEN), np.float32)
            last = np.full(len(part), END)
            for t0 in range(0, int(lengths[0]), WINDOW):
                states, targets, owner = [], [], []
                for t in range(t0, min(t0 + WINDOW, int(lengths[0]))):
                    live = int(np.searchsorted(-lengths, -t))  # longest first, so those longer than t lead
                    h = self.step(last[:live], h[:live])
                    last = flat[at[:live] + t]
                    states.append(h)
                    targets.append(last)
                    owner.append(part[:live])
                states, targets, owner = np.concatenate(states), np.concatenate(targets), np.concatenate(owner)
                logp = np.concatenate([self.output(states[i:i + SLICE], targets[i:i + SLICE])[0] for i in range(0, len(owner), SLICE)])
                out += np.bincount(owner, logp, len(sequences))
        return out / np.log(10)

    def learn(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, dict]:
        """Summed loss, last state and gradients of one window (time x streams), backpropagated to its start only.

        The state is set to zero where a comment begins (``fresh``).
        """
        w = self.w
        g = {name: np.zeros(shape, np.float32) for name, shape in SHAPES}
        held, gates = (~fresh)[:, :, None], w["inputs"].take(inputs, 0)
        before, states, n, own_n = (np.empty((*inputs.shape, HIDDEN), h.dtype) for _ in range(4))
        rz = np.empty((*inputs.shape, 2 * HIDDEN), h.dtype)
        for t in range(len(inputs)):
            np.multiply(h, held[t], out=before[t])
            h, rz[t], n[t], own_n[t] = self._step(gates[t], before[t])
            states[t] = h
        logp, d_states = self.output(states.reshape(-1, HIDDEN), targets.ravel(), g)
        d_states = d_states.reshape(states.shape)
        r, z = rz[:, :, :HIDDEN], rz[:, :, HIDDEN:]
        # slopes of a state by its parts, for the whole window; only the carried part goes step by step
        keep = 1 - z
        by_n, by_z, by_r = 1 - n * n, before - n, 1 - r
        by_n *= keep
        by_z *= z
        by_z *= keep
        by_r *= r
        by_r *= own_n
        d_gate, turned = np.empty((*inputs.shape, 3 * HIDDEN), h.dtype), np.ascontiguousarray(w["state"].T)
        d_own, carry = np.empty_like(d_gate), np.zeros_like(h)
        for t in range(len(inputs) - 1, -1, -1):
            dh = d_states[t] + carry
            dn = dh * by_n[t]
            dr = dn * by_r[t]
            own = d_own[t]
            own[:, :HIDDEN], own[:, 2 * HIDDEN:] = dr, dn * r[t]
            np.multiply(dh, by_z[t], out=own[:, HIDDEN:2 * HIDDEN])
            d_gate[t, :, 2 * HIDDEN:] = dn
            carry = own @ turned
            dh *= z[t]
            carry += dh
            carry *= held[t]
        d_gate[:, :, :2 * HIDDEN] = d_own[:, :, :2 * HIDDEN]
        flat = d_own.reshape(-1, 3 * HIDDEN)
        g["state"] += before.reshape(-1, HIDDEN).T @ flat
        g["state_bias"] += np.ones(len(flat), flat.dtype) @ flat
        order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")
        seen = inputs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
        by_symbol = np.ascontiguousarray(d_gate.reshape(-1, 3 * HIDDEN).take(order, 0).T)
        g["inputs"][seen[first]] = np.add.reduceat(by_symbol, first, axis=1).T
        return -float(logp.sum()), h, g


def fresh_squares() -> dict[str, np.ndarray]:
    """Adagrad's sums of squared gradients before the first step."""
    return {name: np.full(shape, 1e-6, np.float32) for name, shape in SHAPES}


def train_on(network: Network, sequences: list[np.ndarray], rate: float, seen: dict[str, np.ndarray] | None = None) -> int:
    """One pass of Adagrad over symbol sequences laid into parallel streams; the state starts anew with each comment. Returns tokens.

    ``seen`` carries the sums of squared gradients from one call to the next.
    """
    if not sequences:
        return 0
    order = np.random.default_rng(len(sequences)).permutation(len(sequences))
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    shifted = np.concatenate([[END], flat[:-1]])
    starts = np.zeros(len(flat), bool)
    starts[np.cumsum([0, *[len(sequences[i]) for i in order[:-1]]])] = True
    streams = min(STREAMS, max(1, len(flat) // WINDOW))
    length = len(flat) // streams
    cut = lambda x: x[:streams * length].reshape(streams, length).T
    inputs, targets, fresh = cut(shifted), cut(flat), cut(starts)
    seen = fresh_squares() if seen is None else seen

    def update(x, y, new, h):
        _, h, g = network.learn(x, y, new, h)
        for name, grad in g.items():
            grad /= streams
            np.clip(grad, -5, 5, out=grad)
            seen[name] += grad * grad
            network.w[name] -= rate * grad / np.sqrt(seen[name])
        return h

    h = np.zeros((streams, HIDDEN), np.float32)
    for t in range(0, length, WINDOW):
        part = slice(t, t + WINDOW)
        h = update(inputs[part], targets[part], fresh[part], h)
    # fewer tokens than streams are left over; they go on where the last stream ends
    at = streams * length
    if at < len(flat):
        update(shifted[at:, None], flat[at:, None], starts[at:, None], h[-1:])
    return len(flat)


def _binary_texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, ends = Counter(), 0

    def flush():
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})

    for batch in batches:
        for text in _binary_texts(batch):
            counts.update(text.lower().split())
        if len(counts) > 400_000:
            yield flush()
            counts = Counter()
    if counts:
        yield flush()


def _vocabulary(texts: DataFrame, counts: DataFrame, documents: int) -> Vocabulary:
    size = F.length("word")
    # the last two bytes' checksum, as spelling() has it
    symbol = (F.crc32(F.substring("word", -2, 2)) % SPELLINGS).cast("int")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    common = counts.filter(size <= TABLE_BYTES).orderBy(F.desc("c"), "word").limit(TABLE_WORDS).toArrow()
    words, c = common.column("word").to_pylist(), common.column("c").to_numpy()
    masses = np.zeros(SPELLINGS)
    for r in counts.groupBy(symbol.alias("s")).agg(F.sum(F.col("c") + F.lit(ALPHA)).alias("m")).collect():
        masses[r.s] = r.m
    for w, n in zip(words[:SYMBOLS - 1 - SPELLINGS], c[:SYMBOLS - 1 - SPELLINGS].tolist()):  # these have symbols of their own
        masses[spelling(w) - 1] -= n + ALPHA
    return Vocabulary(words, c, (total.n or 0) + documents, total.v + (documents > 0), documents, np.maximum(masses, 0))


def _lesson(texts: DataFrame, k: int, share: int) -> DataFrame:
    """The comments of round k: one fold of ``share``, dealt by hash of the id."""
    return texts.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(share)) == k % share)


def _encode(vocabulary):
    """What is known of a comment from one look at its words: symbols, the sums over common words, and its rare words."""
    names = ("id", "h", "learns", "n_tokens", "known", "base", "spelled", "rare", "symbols", "words", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        end_base = float(np.log10(v.ends + ALPHA)) - v.log_scale
        table, log_count = v.lookup().__getitem__, np.append(v.log_count, 0.0)  # the last stands for words outside the table
        symbol_of = np.append(v.symbols, 0)
        for batch in batches:
            words, lengths = [], []
            for text in _binary_texts(batch):
                own = text.lower().split()
                words += own
                lengths.append(len(own))
            n, lengths = len(lengths), np.array(lengths, np.int64)
            ids, owner = np.fromiter(map(table, words), np.int64, len(words)), np.repeat(np.arange(n), lengths)
            rare = np.flatnonzero(ids < 0)
            symbols, logs = symbol_of[ids], log_count[ids]
            symbols[rare] = [spelling(words[i]) for i in rare.tolist()]
            inside = symbols <= SPELLINGS  # words that stand behind a spelling symbol
            spelled = np.where(inside, logs - v.log_mass[np.where(inside, symbols, 1) - 1], 0.0)
            common = lengths - np.bincount(owner[rare], minlength=n)
            base = np.bincount(owner, logs, n) - common * v.log_scale + end_base
            edges = np.concatenate([[0], np.cumsum(lengths + 1)])  # every text's symbols and its end
            flat = np.full(edges[-1], END, "<u2")
            flat[np.arange(len(words)) + owner] = symbols
            of_text = Counter(zip(owner[rare].tolist(), [words[i] for i in rare.tolist()]))  # text by text, as owners rise
            per_text = np.bincount(np.fromiter((i for i, _ in of_text), np.int64, len(of_text)), minlength=n)
            rare_ends = pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), batch.column("learns"), pa.array(lengths + 1), pa.array(common + (v.ends > 0)), pa.array(base),
                 pa.array(np.bincount(owner, spelled, n)), pa.array(lengths - common),
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * 2).astype("<i4").tobytes()), pa.py_buffer(flat.tobytes())]),
                 pa.ListArray.from_arrays(rare_ends, pa.array([w for _, w in of_text], pa.binary())),
                 pa.ListArray.from_arrays(rare_ends, pa.array(list(of_text.values()), pa.int64()))], names)

    return run


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), "<u2") for s in batch.column("symbols")]


def _add_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights times tokens, summed over what one task receives."""
    tokens, flat = 0, None
    for batch in batches:
        for n, weights in zip(batch.column("tokens").to_pylist(), batch.column("weights")):
            own = np.frombuffer(weights.as_buffer(), np.float32).astype(float) * n
            tokens, flat = tokens + n, own if flat is None else flat + own
    if tokens:
        yield pa.RecordBatch.from_pydict({"tokens": [tokens], "sums": [flat.tobytes()]})


def _train(encoded: DataFrame, network: Network, rounds: int, share: int, rate: float) -> Network:
    """Rounds of local training on one in ``share`` comments each, other ones in each round, and averaging weighted by tokens."""
    for k in range(rounds):
        weights = encoded.sparkSession.sparkContext.broadcast(network.packed())
        speed = rate / (1 + k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen, held, tokens, waiting = Network.unpacked(weights.value), fresh_squares(), [], 0, 0
            for batch in batches:
                for sequence in _symbols(batch):
                    held.append(sequence)
                    waiting += len(sequence)
                    if waiting >= CHUNK_TOKENS:
                        tokens, waiting = tokens + train_on(own, held, speed, seen), 0
                        held.clear()
            tokens += train_on(own, held, speed, seen)
            if tokens:
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "tokens": [tokens], "weights": [own.packed()]})

        local = _lesson(encoded.filter("learns").select("id", "symbols"), k, share).select("symbols").mapInArrow(
            run, "part int, tokens long, weights binary")
        sums = local.repartition(FAN, "part").select("tokens", "weights").mapInArrow(_add_weights, "tokens long, sums binary").collect()  # at most FAN rows
        if sums:
            flat = sum(np.frombuffer(r.sums, float) for r in sums) / sum(r.tokens for r in sums)
            network = Network.unpacked(flat.astype(np.float32).tobytes())
    return network


def _scored(weights):
    names = ("id", "h", "n_tokens", "known", "base", "score", "rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.unpacked(weights.value)

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                lm = network.log10_of([s for batch in held for s in _symbols(batch)])
                yield pa.RecordBatch.from_arrays([rows.column(c) if c != "score" else pa.array(rows.column("spelled").to_numpy() + lm) for c in names], names)

        held, waiting = [], 0
        for batch in batches:
            lengths = batch.column("n_tokens").to_numpy().cumsum()
            lo = 0
            while lo < batch.num_rows:  # a batch may hold far more tokens than are scored at once
                done_before = lengths[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(lengths, done_before + SCORED_TOKENS - waiting, side="right")))
                held.append(batch.slice(lo, hi - lo))
                waiting += int(lengths[hi - 1] - done_before)
                lo = hi
                if waiting >= SCORED_TOKENS or lo < batch.num_rows:
                    yield from done(held)
                    held, waiting = [], 0
        yield from done(held)

    return run


def score(reviews: DataFrame, folds: int = 10, rounds: int = 3, share: int | None = None, rate: float = 0.15,
          review_case_id: str = "review_case_id", comment: str = "safe_comment") -> DataFrame:
    """Score every whole comment after learning from those whose crc32(id as text) mod ``folds`` is not 0.

    Words are runs of anything but ASCII white space, A-Z lower-cased; each comment ends with an end token. Returns the id,
    ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (smoothed word counts) and ``score`` (the network),
    both log10-probabilities of the text, one row per input row. Training takes ``rounds`` rounds of one in ``share`` training
    comments, dealt by hash; ``share`` is ``rounds`` unless given and never more, so that every training comment is learnt from. A
    missing comment is empty: its end token is scored. A row without an id teaches nothing and is not held out. Repeated rows count each.
    """
    share = rounds if share is None else share
    if not 1 <= share <= rounds:
        raise ValueError("share is at most rounds, or comments would be left out of training")
    small_batches(reviews)
    spark = reviews.sparkSession
    own, said = f"`{review_case_id}`", text_of(f"`{comment}`")
    texts = reviews.select(F.col(own).alias("id"), said.alias("text"), F.xxhash64(said).alias("h"),
                           F.coalesce(crc_remainder(own, folds) != 0, F.lit(False)).alias("learns"))
    documents = texts.filter("learns").count()
    counts = stage(texts.filter("learns").select("text").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    words = _vocabulary(texts, counts, documents)
    vocabulary = spark.sparkContext.broadcast(words)
    id_type = texts.schema["id"].dataType.simpleString()
    encoded = stage(texts.mapInArrow(_encode(vocabulary), f"id {id_type}, h long, learns boolean, n_tokens long, known long, base double, "
                                     "spelled double, rare long, symbols binary, words array<binary>, times array<long>"))
    network = _train(encoded, Network.start(words.unigram()), rounds, share, rate)
    weights = spark.sparkContext.broadcast(network.packed())
    rare = encoded.filter("rare > 0").select("id", "h", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "id", "h", F.col("w.words").alias("word"), F.col("w.times").alias("k")).join(counts, "word", "left").groupBy("id", "h").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"), F.sum("k").alias("all_rare"))
    scored = encoded.select("id", "h", "n_tokens", "known", "base", "spelled", "rare", "symbols").mapInArrow(
        _scored(weights), f"id {id_type}, h long, n_tokens long, known long, base double, score double, rare long")
    # rows that repeat id and text were summed together: each has its share
    part = F.when(F.col("all_rare") > 0, F.col("rare") / F.col("all_rare")).otherwise(F.lit(0.0))
    log = F.coalesce(F.col("rare_log") * part, F.lit(0.0))
    both = scored.alias("s").join(rare.alias("r"), F.col("s.id").eqNullSafe(F.col("r.id")) & (F.col("s.h") == F.col("r.h")), "left")
    return both.select(
        F.col("s.id").alias(review_case_id), F.coalesce(crc_remainder("s.id", folds) == 0, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce(F.round(F.col("rare_known") * part), F.lit(0.0)).cast("long")).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("rare") * F.lit(words.log_scale)).alias("base_score"), (F.col("score") + log).alias("score"))
