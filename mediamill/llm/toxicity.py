"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import U, put, slices, span_hashes, with_fields
from .letters import letter_words

#: Words of a window, and how far the next one begins: each passage of half a window lies whole in one; all windows of a text are scored.
WINDOW, STRIDE = 48, 24
WORD_BITS, GRAM_BITS, GRAMS = 14, 16, (3, 4, 5, 6)
WIDTH, HIDDEN, ATTENTION = 6, 8, 8
#: Bound of the training sample: documents of each class, and bytes of the longest of them.
DOCUMENTS, LONGEST = 2500, 16_000
#: Rounds over the chosen windows at least and at most (small samples: until SEEN windows), and windows a step at least and at most.
EPOCHS, SEEN, BATCH = (6, 40), 80_000, (32, 256)
#: Step sizes; small ones for the vectors, whose first coordinates start at counted odds.
RATE, VECTOR_RATE = 0.01, 0.0015
#: Signs of a text from its windows' logits: the largest, the mean of the TOP largest, the (logarithmic) sum and the mean of their probabilities.
SIGNS = 4
#: Of the final scale's slopes; windows of a text whose mean counts beside the likeliest.
RIDGE, TOP = 0.1, 4
#: Windows by which a text of label 1 teaches, and places of a word or n-gram in one text that count for its odds, and texts that must hold it.
TAUGHT, OFTEN, RARE = 2, 3, 6
#: Characters of text read at once, and distinct words whose n-grams are found at once.
CHUNK, BLOCK = 1 << 19, 1 << 14


@dataclass
class Words:
    """The windows of some texts over their distinct words."""

    word: np.ndarray  # bucket of each distinct word
    gram: np.ndarray  # buckets of the n-grams of all distinct words
    gram_at: np.ndarray  # where each distinct word's n-grams begin
    sequence: np.ndarray  # distinct word of each word in turn
    at: np.ndarray  # where each text's words begin

    def grams_of(self, words: np.ndarray) -> np.ndarray:
        """The n-grams of these words, one word after the other."""
        begin = self.gram_at[words]
        sizes = self.gram_at[words + 1] - begin
        return self.gram[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - begin, sizes)]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of each window (one row; a short text is filled up with the count of words), and the text of each window."""
        sizes = np.diff(self.at)
        n = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1), 0)
        owner = np.repeat(np.arange(len(sizes)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.minimum(k * STRIDE, np.maximum(0, sizes[owner] - WINDOW))
        place = (self.at[owner] + first).astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
        inside = place < self.at[owner + 1][:, None]
        return np.where(inside, self.sequence[np.minimum(place, len(self.sequence) - 1)], np.int32(len(self.word))), owner


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part or not texts:
        yield part


def words_of(texts: list[str]) -> Words:
    """Words by hash; texts are read in chunks, of which only words not met before are kept spelled."""
    hashes, sizes_of, spelled, seen = [], [], [], np.zeros(0, U)
    for part in _chunks(texts):
        codes, starts, ends, at = letter_words(part)
        h = span_hashes(codes, starts, ends)
        names, index = np.unique(h, return_index=True)
        new = index[~np.isin(names, seen)] if len(seen) else index
        seen = np.union1d(seen, names) if len(seen) else names
        size = ends[new] - starts[new]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[new], size)
        spelled.append((h[new], size, codes[inside]))
        hashes.append(h)
        sizes_of.append(np.diff(at))
    names = np.unique(np.concatenate([np.unique(h) for h in hashes]))
    sequence = np.concatenate([np.searchsorted(names, h).astype(np.int32) for h in hashes])
    del hashes
    met, sizes, codes = (np.concatenate([s[i] for s in spelled]) for i in range(3))
    order = np.argsort(met)
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    at = np.concatenate(([0], np.cumsum(np.concatenate(sizes_of))))
    grams, counts = zip(*(_grams(codes, starts[k : k + BLOCK], sizes[k : k + BLOCK]) for k in range(0, max(1, len(names)), BLOCK)))
    return Words((names >> U(64 - WORD_BITS)).astype(np.int32), np.concatenate(grams), np.concatenate(([0], np.cumsum(np.concatenate(counts)))), sequence, at)


def _grams(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words, each word between marks, one word after the other, and their number in each."""
    total = np.cumsum(sizes + 2)
    line = np.zeros(int(total[-1]) if len(total) else 0, np.uint32)
    begin = total - sizes - 2
    line[begin] = ord("<")
    line[total - 1] = ord(">")
    offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    line[np.repeat(begin + 1, sizes) + offset] = codes[np.repeat(starts, sizes) + offset]
    buckets, owners = [], []
    h = np.zeros(len(line), U)
    left = np.repeat(total, sizes + 2) - np.arange(len(line))  # codes left in the word
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)
    for n in range(1, max(GRAMS) + 1):
        m = len(line) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ line[n - 1 :]) * U(0x9FB21C651E98DF25)
        h ^= h >> U(29)
        if n in GRAMS:
            ok = left[:m] >= n
            buckets.append(((h * U(0xC2B2AE3D27D4EB4F)) >> U(64 - GRAM_BITS))[ok].astype(np.int32))
            owners.append(owner[:m][ok])
    gram, own = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (buckets, owners))
    return gram[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(sizes))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name; inputs of a word are its own vector and the scaled sum of its n-grams' vectors."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, word_odds: np.ndarray, gram_odds: np.ndarray) -> Network:
        """Small random weights; one coordinate of each vector starts at how much likelier it is in texts of label 1."""
        r = np.random.default_rng(7)
        make = lambda *shape, scale=0.3: r.normal(0, scale, shape).astype(np.float32)
        w = {"word": make(1 << WORD_BITS, WIDTH, scale=0.05), "gram": make(1 << GRAM_BITS, WIDTH, scale=0.05)}
        w["word"][:, 0], w["gram"][:, 0] = word_odds, gram_odds
        for d in "fb":
            w |= {f"x{d}": make(2 * WIDTH, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": make(HIDDEN, 3 * HIDDEN)}
        return cls(w | {"attend": make(2 * HIDDEN, ATTENTION), "query": make(ATTENTION), "out": make(2 * HIDDEN), "bias": np.zeros(1, np.float32)})

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """A row for each distinct word, and the scales of the n-gram sums."""
        n = np.diff(words.gram_at)
        scale = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
        sums = np.zeros((len(n), WIDTH), np.float32)
        at, k = words.gram_at, 0
        while k < len(n):  # about a quarter of a million n-grams at a time
            to = max(k + 1, int(np.searchsorted(at, at[k] + (1 << 18), "right")) - 1)
            sums[k:to] = np.add.reduceat(self.weights["gram"][words.gram[at[k] : at[to]]], at[k:to] - at[k], axis=0)
            k = to
        return np.hstack([self.weights["word"][words.word], sums * scale[:, None]]), scale

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of the windows (rows of places in x; len(x) fills up) and, if asked, what the gradient needs."""
        w, steps, n = self.weights, windows.shape[1], len(windows)
        filled = windows < len(x)
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        tape: dict = {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates = np.vstack([x @ w[f"x{d}"] + w[f"b{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            gates[-1, HIDDEN : 2 * HIDDEN] = 40  # the state stays as it is
            h = np.zeros((n, HIDDEN), np.float32)
            part = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            for t in order:
                g, a = gates[windows[:, t]], h @ w[f"u{d}"]
                rz = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if keep:
                    tape[d, t] = (h, r, z, c, a[:, 2 * HIDDEN :])
                states[t, :, part] = h = new
        mixed = np.tanh(states @ w["attend"])
        pull = np.where(filled.T, mixed @ w["query"], -1e9)
        pull = np.exp(pull - pull.max(axis=0))
        share = pull / pull.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        return pooled @ w["out"] + w["bias"][0], {"tape": tape, "states": states, "mixed": mixed, "share": share, "pooled": pooled} if keep else {}

    def gradient(self, x: np.ndarray, windows: np.ndarray, kept: dict, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights above the inputs, and of x, for the slopes of the loss by logit."""
        w, states, mixed, share = self.weights, kept["states"], kept["mixed"], kept["share"]
        out = {"out": kept["pooled"].T @ slope, "bias": np.array([slope.sum()])}
        by_pooled = slope[:, None] * w["out"]
        by_share = np.einsum("nh,tnh->tn", by_pooled, states)
        by_pull = share * (by_share - (share * by_share).sum(axis=0))
        by_mixed = by_pull[:, :, None] * w["query"] * (1 - mixed**2)
        out["query"] = np.einsum("tn,tnk->k", by_pull, mixed)
        out["attend"] = np.einsum("tnh,tnk->hk", states, by_mixed)
        by_state = share[:, :, None] * by_pooled + by_mixed @ w["attend"].T
        by_x = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        steps = windows.shape[1]
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            part = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            back = np.zeros((len(windows), HIDDEN), np.float32)
            by_gates = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            by_u = np.zeros_like(w[f"u{d}"])
            for t in order:
                h, r, z, c, a = kept["tape"][d, t]
                grad = back + by_state[t, :, part]
                dc = grad * (1 - z) * (1 - c**2)
                dz = grad * (h - c) * z * (1 - z)
                dr = dc * a * r * (1 - r)
                da = np.hstack([dr, dz, dc * r])
                by_u += h.T @ da
                back = grad * z + da @ w[f"u{d}"].T
                np.add.at(by_gates, windows[:, t], np.hstack([dr, dz, dc]))
            by_gates = by_gates[:-1]
            out |= {f"u{d}": by_u, f"x{d}": x.T @ by_gates, f"b{d}": by_gates.sum(axis=0)}
            by_x[:-1] += by_gates @ w[f"x{d}"].T
        return out, by_x[:-1]


def _odds(seen: Iterator[np.ndarray], labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of label 1 by bucket from its places in the texts (at most OFTEN in each), shrunk where few texts hold it; whether at least RARE do."""
    counts, texts = np.full((2, size), 0.5), np.zeros(size)
    for s, y in zip(seen, labels):
        buckets, n = np.unique(s, return_counts=True)
        counts[y, buckets] += np.minimum(n, OFTEN)
        texts[buckets] += 1
    n = np.bincount(labels, minlength=2) + 1
    return (np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])) * texts / (texts + 5), texts >= RARE


@dataclass
class ToxicityModel:
    network: Network
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(SIGNS))
    shift: float = 0.0
    base: float = 0.0  # score without words

    def signs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What the logits of all windows say of each text, and whether it has any words."""
        out = np.zeros((len(texts), SIGNS))
        words = words_of(texts)
        sizes = np.diff(words.at)
        if len(words.word):
            windows, owner = words.windows()
            x, _ = self.network.inputs(words)
            z = np.concatenate([self.network.forward(x, windows[k : k + 4096])[0] for k in range(0, len(windows), 4096)]).astype(np.float64)
            order = np.lexsort((-z, owner))
            z, owner = z[order], owner[order]
            n = np.bincount(owner, minlength=len(texts))
            first = np.cumsum(n) - n
            some = n > 0
            total = np.concatenate(([0], np.cumsum(z)))
            top = np.minimum(n, TOP)
            likely = np.bincount(owner, _sigmoid(z), len(texts))
            out[some, 0] = z[first[some]]
            out[:, 1] = (total[first + top] - total[first]) / np.maximum(top, 1)
            out[:, 2] = np.log1p(likely)
            out[:, 3] = likely / np.maximum(n, 1)
        return out, sizes > 0

    def score(self, texts: list[str]) -> np.ndarray:
        signs, some = self.signs(texts)
        return np.where(some, _sigmoid(signs @ self.slopes + self.shift), self.base)


def _scale(z: np.ndarray, y: np.ndarray, share: float | None) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic fit by Newton steps with a ridge on the slopes of the scaled signs; ``share`` of label 1 weighs the texts."""
    middle, spread = z.mean(axis=0), z.std(axis=0) + 1e-6
    rows = np.hstack([(z - middle) / spread, np.ones((len(z), 1))])
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    share = n1 / max(1, len(y)) if share is None else share
    each = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    ridge = np.diag([RIDGE] * z.shape[1] + [1e-6])
    w = np.zeros(rows.shape[1])
    for _ in range(100):
        p = _sigmoid(rows @ w)
        hess = (rows * ((p * (1 - p) + 1e-9) * each)[:, None]).T @ rows + ridge
        w -= np.clip(np.linalg.solve(hess, rows.T @ ((p - y) * each) + ridge @ w), -2, 2)
    return w[:-1] / spread, float(w[-1] - (w[:-1] * middle / spread).sum())


def fit(texts: list[str], labels: np.ndarray, share: float | None = None) -> ToxicityModel:
    """Train on labelled texts: a fifth of them only fit the final scale.

    A text of label 1 teaches by the window that the first log-odds find likeliest, a text of label 0
    by that window, later by the network's likeliest, and by a random one. ``share`` of label 1 among all labelled
    rows, if given, weighs the texts of the final scale. Without both labels the score is the share of label 1.
    """
    labels = np.asarray(labels, np.int64)
    base = float(labels.mean()) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(Network.fresh(np.zeros(1 << WORD_BITS), np.zeros(1 << GRAM_BITS)), shift=float(np.log((base + 1e-3) / (1 - base + 1e-3))), base=base)
    r = np.random.default_rng(11)
    turn = r.permutation(len(labels))
    held = np.zeros(len(labels), bool)
    for y in (0, 1):
        own = turn[labels[turn] == y]
        held[own[: len(own) // 5]] = True
    learn = np.flatnonzero(~held)
    words = words_of([texts[i] for i in learn])
    y = labels[learn]
    per_text = [words.sequence[a:b] for a, b in zip(words.at[:-1], words.at[1:])]
    word_odds, word_met = _odds((words.word[s] for s in per_text), y, 1 << WORD_BITS)
    gram_odds, gram_met = _odds(map(words.grams_of, per_text), y, 1 << GRAM_BITS)
    net = Network.fresh(word_odds * 0.3, gram_odds * 0.3)
    met = {"word": word_met[:, None].astype(np.float32), "gram": gram_met[:, None].astype(np.float32)}
    for name, own in met.items():  # what few texts hold says nothing and can't be learnt by heart
        net.weights[name] *= own
    windows, owner = words.windows()
    x, _ = net.inputs(words)
    hot = np.append(x[:, 0] + x[:, WIDTH], -1e9)[windows].max(axis=1)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.append(first, len(owner)))

    none = y[owner[first]] == 0

    def likeliest(by: np.ndarray, of: np.ndarray, most: int) -> np.ndarray:
        """Of these texts the windows that are likeliest, at most so many of each."""
        order = np.lexsort((-by, owner))
        return np.concatenate([order[first[of & (counts > k)] + k] for k in range(most)])

    ones, zeros = likeliest(hot, ~none, TAUGHT), likeliest(hot, none, 1)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    settled = {k: np.zeros_like(v) for k, v in net.weights.items()}  # mean of the weights after each of the later rounds
    step = 0
    size = min(BATCH[1], max(BATCH[0], len(first) // 8))
    rounds = max(EPOCHS[0], min(EPOCHS[1], SEEN // (2 * len(first))))
    for turn_no in range(rounds):
        if turn_no == (rounds + 1) // 2:  # from here on the network itself names the likeliest window of a text of label 0
            x, _ = net.inputs(words)
            now = np.concatenate([net.forward(x, windows[k : k + 4096])[0] for k in range(0, len(windows), 4096)])
            zeros = likeliest(now, none, 1)
        chosen = np.concatenate([ones, zeros, (first + (r.random(len(first)) * counts).astype(int))[none]])
        target = y[owner[chosen]].astype(np.float32)
        weight = np.where(target == 1, len(target) / (2 * max(1, target.sum())), len(target) / (2 * max(1, (1 - target).sum()))).astype(np.float32)
        turn = r.permutation(len(chosen))
        for k in range(0, len(turn), size):
            pick = turn[k : k + size]
            used, local = np.unique(windows[chosen[pick]], return_inverse=True)
            local = local.reshape(len(pick), WINDOW)
            used = used[used < len(words.word)]
            sizes = np.diff(words.gram_at)[used]
            grams = words.grams_of(used)
            part = Words(words.word[used], grams, np.concatenate(([0], np.cumsum(sizes))), local, local)
            x, scale = net.inputs(part)
            logit, kept = net.forward(x, local, keep=True)
            slope = ((_sigmoid(logit) - target[pick]) * weight[pick] / len(pick)).astype(np.float32)
            grads, by_x = net.gradient(x, local, kept, slope)
            for name, where, rows in (("word", part.word, by_x[:, :WIDTH]), ("gram", grams, np.repeat(by_x[:, WIDTH:] * scale[:, None], sizes, axis=0))):
                grads[name] = np.stack([np.bincount(where, rows[:, c], len(net.weights[name])) for c in range(WIDTH)], axis=1).astype(np.float32) * met[name]
            step += 1
            for name, g in grads.items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.weights[name] -= ((VECTOR_RATE if name in ("word", "gram") else RATE) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if turn_no >= rounds // 2:
            for name, v in net.weights.items():
                settled[name] += v / (rounds - rounds // 2)
    net.weights = settled
    model = ToxicityModel(net, base=base)
    check = np.flatnonzero(held) if held.any() else learn
    z, ok = model.signs([texts[i] for i in check])
    z, y = z[ok], labels[check][ok]
    model.slopes, model.shift = _scale(z, y, share)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", documents: int = DOCUMENTS, longest: int = LONGEST) -> ToxicityModel:
    """Fit on a bounded sample: of each label at most ``documents`` labelled rows, by hash of the id, whose texts have at most ``longest`` bytes.

    Rows of several labels count by the largest; a null label, id or text doesn't count.
    """
    own = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    # by hash about a third more than needed of each label, as some texts are too long or missing
    n = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, documents * 4 / 3 / max(1, n.get(1, 0))).otherwise(documents * 4 / 3 / max(1, n.get(0, 0)))
    ids = own.where(F.pmod(F.xxhash64("i"), F.lit(1 << 40)) < share * (1 << 40))
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") <= longest))
    rows = texts.join(F.broadcast(ids), "i").select("i", "y", "t").toArrow()  # texts stay packed, one copy of them
    i, y, t = rows.column("i").to_pylist(), rows.column("y").to_numpy(), rows.column("t")
    sample = [k for label in (0, 1) for k in sorted(np.flatnonzero(y == label).tolist(), key=lambda k: (hash_order(i[k]), i[k], t[k].as_py()))[:documents]]
    texts_, labels_ = t.take(pa.array(sample, pa.int64())).to_pylist(), y[sample].astype(np.int64)
    del rows, i, y, t
    return fit(texts_, labels_, n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0)))


def hash_order(i: int) -> int:
    return i * 0x9E3779B97F4A7C15 & (1 << 64) - 1


def _scores(shared, text_col: str, name: str, most: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, CHUNK):
                score = pa.array(shared.value.score([t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]), pa.float64())
                yield put(batch, **{name: score}) if most is None else batch.filter(pa.array(score.to_numpy() < most))

    return run


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1: all overlapping windows of the whole text, the largest counts.

    Null, empty and wordless texts get the training sample's share of label 1, at most 0.29; repeated
    rows get equal scores; an empty table gives an empty one; a column named as the output gives way.
    """
    model.base = min(model.base, 0.29)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    return docs.mapInArrow(_scores(shared, text_col, name, None), with_fields(docs.schema, (name, T.DoubleType())))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model.base = min(model.base, 0.29)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scores(shared, text_col, "", threshold), docs.schema)
