"""Document quality by a linear-chain conditional random field over lines.

Every line is a node with features of itself and of the lines before and after it; the chain labels it good or
bad. Forward-backward gives the probability of "good" for every line, and a document's quality is their mean
weighted by line length, calibrated on the training documents.

The field is fitted on the driver on a bounded sample of labelled documents; scoring runs in the tasks.
"""

import pickle
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, only

TRAIN_DOCS = 4_000  # labelled documents used for fitting, at most
TRAIN_CHAINS = 4_000  # chains of lines of these, at most
CHAIN_LINES = 64  # lines in a training chain; longer documents give several
STEPS, RATE, DECAY = 160, 0.15, 1e-3
CUT = 0.3  # a score of at least this predicts label 1
GROUP_BYTES = 4_000_000  # text featurized together
LONG_LINE = 40.0

#: Classes of bytes that line features count.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"!?", b"|", b".,;:'\"()-", bytes(set(b"#$%&*@~^<>{}[]=+_/\\`"))]
_TABLE = np.full(256, len(CLASSES), dtype=np.int64)  # all else: letters
for _k, _c in enumerate(CLASSES):
    _TABLE[list(_c)] = _k
_MARKS = np.isin(_TABLE, [3, 4, 5, 6])
OWN = len(CLASSES) + 13  # features of one line
FEATURES = 3 * OWN + 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features, lines per text, bytes per line) of all lines of some texts; an empty text has one empty line."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    lines = [r.split(b"\n") for r in raw]
    counts = np.array([len(x) for x in lines])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    n, k = len(starts), len(CLASSES) + 1
    line = np.repeat(np.arange(n), ends - starts + 1)
    kind = _TABLE[buf]
    kind[ends] = len(CLASSES)
    share = np.bincount(line * k + kind, minlength=n * k).reshape(n, k)[:, :-1].astype(np.float64)
    twice = np.zeros(n)
    if len(buf) > 1:
        again = (buf[1:] == buf[:-1]) & _MARKS[buf[1:]]
        twice = np.bincount(line[1:][again], minlength=n).astype(np.float64)
    spaces = share[:, 2].copy()
    seen_before, seen_after, same, stutter = (np.zeros(n) for _ in range(4))
    base = 0
    for doc in lines:
        first: dict[bytes, int] = {}
        for i, text in enumerate(doc):
            if not text:
                continue
            ws = text.split()
            if len(ws) > 3:
                same[base + i] = 1.0 - len(set(ws)) / len(ws)
                stutter[base + i] = sum(map(eq, ws, ws[1:])) / len(ws)
            j = first.setdefault(text, i)
            if j != i:
                seen_before[base + i] = seen_after[base + j] = 1.0
        base += len(doc)
    safe = np.maximum(size, 1.0)
    share /= safe[:, None]
    twice /= safe
    word = size / (spaces + 1.0)
    own = np.column_stack([
        share, twice, np.log1p(size) / 8.0, np.minimum(word, LONG_LINE) / 10.0, seen_before, seen_after, same, stutter, (stutter > 0.2).astype(float), (size == 0).astype(float),
        (share[:, 0] > 0.4).astype(float), (share[:, 6] > 0.03).astype(float), (share[:, 4] > 0.01).astype(float), (share[:, 3] > 0.03).astype(float),
    ])
    return own, counts, size


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of every line, of the one before and of the one after within its text, and a constant."""
    last = np.cumsum(counts) - 1
    first = last - counts + 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0.0, 0.0
    return np.column_stack([own, before, after, np.ones(len(own))])


def _padded(values: np.ndarray, counts: np.ndarray):
    """Chains sorted by falling length as (values by step, chains alive by step, order of rows)."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
    rows = [starts[:a] + t for t, a in enumerate(alive)]
    return rows, alive


def forward_backward(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray):
    """Log of the partition function of every chain, probability of label 1 of every line, expected transitions.

    ``unary`` is the score of label 1 (label 0 has 0); ``trans[a, b]`` scores label b after label a.
    """
    rows, alive = _padded(unary, counts)
    n = len(unary)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    u = np.column_stack([np.zeros(n), unary])
    for t, r in enumerate(rows):
        if t == 0:
            fwd[r] = u[r]
            continue
        p = fwd[rows[t - 1][: len(r)]]
        fwd[r] = u[r] + np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
    for t in range(len(rows) - 2, -1, -1):
        r = rows[t][: alive[t + 1]]
        nxt = rows[t + 1]
        v = u[nxt] + bwd[nxt]
        bwd[r] = np.logaddexp(v[:, :1] + trans[:, 0], v[:, 1:] + trans[:, 1])
    both = fwd + bwd
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - log_z)
    moves = np.zeros((2, 2))
    for t in range(1, len(rows)):
        r, p = rows[t], rows[t - 1][: len(rows[t])]
        v = u[r] + bwd[r]
        for a in (0, 1):
            for b in (0, 1):
                moves[a, b] += np.exp(fwd[p, a] + trans[a, b] + v[:, b] - log_z[r]).sum()
    return log_z, good, moves


@dataclass
class Field:
    """Fitted field: feature scaling, weights, transition scores, and the calibration of document scores."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, own, counts) -> np.ndarray:
        """Probability of "good" of every line."""
        x = (with_neighbours(own, counts) - self.mean) / self.scale
        return forward_backward(x @ self.weights, self.trans, counts)[1]

    def documents(self, own, counts, size) -> np.ndarray:
        """Length-weighted mean of the line probabilities of every text, before calibration."""
        first = np.cumsum(counts) - counts
        weight = size + 1.0
        return np.add.reduceat(self.lines(own, counts) * weight, first) / np.add.reduceat(weight, first)

    def score(self, texts: list[str]) -> list[float]:
        if not texts:
            return []
        q = _logit(self.documents(*line_features(texts)))
        return (1.0 / (1.0 + np.exp(-(self.slope * q + self.shift)))).tolist()


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _calibrate(q: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression of the labels on the raw scores, lightly damped, by Newton steps."""
    x = np.column_stack([_logit(q), np.ones(len(q))])
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.1
        w = w - np.linalg.solve(hess, x.T @ (p - y) + 0.1 * (w - np.array([1.0, 0.0])))
    return max(float(w[0]), 1e-3), float(w[1])


def fit(own: np.ndarray, counts: np.ndarray, size: np.ndarray, labels: np.ndarray) -> Field:
    """Fit on chains of lines; the lines of a chain carry the label (0 or 1) of its document. Adam steps on the mean
    log-likelihood of the lines, with weight decay."""
    x = with_neighbours(own, counts)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1.0
    mean[-1], scale[-1] = 0.0, 1.0
    x = (x - mean) / scale
    y = np.repeat(labels, counts).astype(float)
    moves = np.zeros((2, 2))
    for a in (0, 1):
        moves[a, a] = (counts[labels == a] - 1).sum()
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    n = len(x)
    for step in range(1, STEPS + 1):
        w, trans = params[:-4], params[-4:].reshape(2, 2)
        _, good, expected = forward_backward(x @ w, trans, counts)
        grad = np.concatenate([x.T @ (y - good), (moves - expected).ravel()]) / n - DECAY * params
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        params = params + RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    field = Field(mean, scale, params[:-4], params[-4:].reshape(2, 2))
    field.slope, field.shift = _calibrate(field.documents(own, counts, size), labels)
    return field


def default_field() -> Field:
    """Without labels of both kinds nothing can be learned: every text scores 0.5."""
    return Field(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)))


def held_out(id_col):
    """Whether a row is kept from training: crc32 of its id as text is divisible by five."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS, max_chains: int = TRAIN_CHAINS) -> Field:
    """Fit on labelled documents that are not held out: those of smallest hash, at most ``max_docs`` of them, and of
    their chains of ``CHAIN_LINES`` lines at most ``max_chains``. Labels other than 0 and 1 are ignored; of several
    labels of one document the smaller counts.
    """
    key = F.col(f"`{id_col}`")
    marked = labels.where(F.col("quality").isin(0, 1) & key.isNotNull() & ~held_out(key)).groupBy(key.alias("_id")).agg(F.min("quality").cast("int").alias("_y"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)  # bounded, so it may be sent to all tasks
    rows = only(docs, id_col, text_col).join(F.broadcast(chosen), key == F.col("_id")).select("_id", "_y", text_col)

    def make():
        def run(batches):
            for b in batches:
                for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    own, _, size = line_features([t or ""])
                    for lo in range(0, len(own), CHAIN_LINES):
                        part = own[lo:lo + CHAIN_LINES]
                        data = np.column_stack([part, size[lo:lo + CHAIN_LINES]]).astype("<f8").tobytes()
                        yield [[y], [len(part)], [data]]

        return run

    chains = map_batches(rows, make, "y int, n int, data binary")

    def fitted():
        def run(batches):
            ys, ns, data = [], [], []
            for b in batches:
                for column, values in zip((ys, ns, data), b.columns):
                    column += values.to_pylist()
            if len(set(ys)) == 2:
                x = np.concatenate([np.frombuffer(d, dtype="<f8").reshape(n, -1) for n, d in zip(ns, data)])
                yield [[pickle.dumps(fit(x[:, :-1], np.array(ns), x[:, -1], np.array(ys)))]]

        return run

    # one task, as the bounded sample is one partition: the driver gets the weights alone
    found = map_batches(chains.orderBy(F.xxhash64("data"), "y").limit(max_chains).coalesce(1), fitted, "field binary").collect()
    return pickle.loads(found[0]["field"]) if found else default_field()


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), cut: float = CUT) -> DataFrame:
    """(id, keep columns, score, predicted) of every row; ``keep`` may name the id. Only the text is looked at; null counts as empty, and an
    empty text is one empty line. Copies score alike; other columns are ignored."""
    kinds = dict(docs.dtypes)
    names = list(dict.fromkeys([id_col, *keep]))
    carried = [f"_c{i}" for i in range(len(names))]

    def make():
        def run(batches):
            for b in batches:
                texts = [t or "" for t in b.column(0).to_pylist()]
                lo = 0
                while lo < len(texts):
                    hi, held = lo, 0
                    while hi < len(texts) and (hi == lo or held < GROUP_BYTES):
                        held += len(texts[hi])
                        hi += 1
                    s = field.score(texts[lo:hi])
                    yield [*[c.slice(lo, hi - lo) for c in b.columns[1:]], s, [int(v >= cut) for v in s]]
                    lo = hi

        return run

    ddl = ", ".join(f"{c} {kinds[n]}" for c, n in zip(carried, names)) + ", score double, predicted int"
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{n}`").alias(c) for n, c in zip(names, carried)])
    out = map_batches(source, make, ddl)
    return out.select(*[F.col(c).alias(n) for c, n in zip(carried, names)], "score", "predicted")
