"""Language ID by a byte convolutional network, trained in numpy.

Text is cut into fixed-length byte windows.  A byte embedding, filters of several widths,
a maximum over the window and a softmax give each window's scores; a
document's are their mean, weighted by bytes.  An embedded byte under one filter
position is a row of a table, so a convolution is a sum of table rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import lowest, with_arrow

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Labelled rows at most that the network learns from, one window of each.
SAMPLE_ROWS = 4000
EPOCHS = 6
UNKNOWN = "und"
#: Score below which the pipeline rejects a document.
MIN_SCORE = 0.3
_PAD = -1e3
_letter = regex.compile(r"\p{L}").search


class ByteCnn:
    """Multi-width byte filters, max pooling and softmax."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.4, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def tables(self) -> list[np.ndarray]:
        """For each place in a filter, a row of filter sums for each byte, of the widths that reach so far."""
        made = []
        for j in range(max(WIDTHS)):
            t = np.concatenate([self.embed @ self.filters[w][j] for w in WIDTHS if w > j], axis=1)
            t[0] = _PAD
            made.append(np.ascontiguousarray(t))
        return made

    def pooled(self, windows: np.ndarray, tables: list[np.ndarray], where: bool = False):
        """Largest filter sums of each window (n, features), and where they are."""
        total = tables[0][windows]
        for j in range(1, len(tables)):
            skip = total.shape[2] - tables[j].shape[1]
            total[:, : WINDOW - j, skip:] += tables[j][windows[:, j:]]
            total[:, WINDOW - j :, skip:] = _PAD
        if not where:
            return total.max(axis=1) + self.bias
        at = total.argmax(axis=1)
        return np.take_along_axis(total, at[:, None, :], 1)[:, 0] + self.bias, at

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 6) -> None:
        """Adam over batches of 64 windows; gradients reach the filters only where they were largest."""
        rng = np.random.default_rng(seed)
        params = [self.embed, *self.filters.values(), self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), 64):
                batch = windows[order[i : i + 64]].copy()
                for row, length in enumerate(rng.integers(12, 2 * WINDOW, len(batch))):
                    batch[row, length:] = 0  # short texts occur too
                step += 1
                for p, g, m, v in zip(params, self._gradients(batch, labels[order[i : i + 64]]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        pooled, at = self.pooled(windows, self.tables(), True)
        active = np.maximum(pooled, 0)
        error = _softmax(active @ self.out + self.out_bias)
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        back = (error @ self.out.T) * (pooled > 0)
        embed, filters = np.zeros_like(self.embed), []
        for n, w in enumerate(WIDTHS):
            part = slice(n * FILTERS, (n + 1) * FILTERS)
            g, place = back[:, part], at[:, part]
            of = np.zeros_like(self.filters[w])
            for j in range(w):
                byte = np.take_along_axis(windows, np.minimum(place + j, WINDOW - 1), 1)
                of[j] = np.einsum("nfe,nf->ef", self.embed[byte], g)
                np.add.at(embed, byte, g[:, :, None] * self.filters[w][j].T[None])
            filters.append(of)
        return [embed, *filters, back.sum(0), active.T @ error, error.sum(0)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def byte_windows(texts: list[bytes]) -> np.ndarray:
    """Windows of all texts, one text's after another's; the last of each is padded by zeros."""
    sizes = [-(-len(t) // WINDOW) * WINDOW for t in texts]
    return np.frombuffer(b"".join(t.ljust(n, b"\0") for t, n in zip(texts, sizes)), np.uint8).reshape(-1, WINDOW)


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> ByteCnn | None:
    """A network from at most ``rows`` labelled rows, taken by hash of the id; None if no row has a label and a text.

    One window of each row, at a place hashed from the id, comes to the driver: at most ``rows`` times WINDOW characters.
    """
    text, chance = F.col(text_col), F.xxhash64(F.lit(3), id_col)
    place = F.pmod(chance, F.greatest(F.char_length(text) - WINDOW, F.lit(1)).cast("long")).cast("int") + 1
    sample = docs.where(F.col(label_col).isNotNull() & text.isNotNull()).select(F.col(label_col).alias("label"), text.substr(place, F.lit(WINDOW)).alias("part"), chance.alias("h"))
    taken = lowest(sample, F.col("h"), rows, "label", "part").collect()
    if not taken:
        return None
    classes = sorted({r.label for r in taken})
    net = ByteCnn(classes)
    windows = np.concatenate([byte_windows([r.part.encode()[:WINDOW] or b"\0"]) for r in taken])
    net.fit(windows, np.array([classes.index(r.label) for r in taken]))
    return net


def identify(docs: DataFrame, net: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from every window of the whole text.

    A null text, one without a letter, or any text if there is no network gets
    ``und`` with score 0.  Columns of these names are replaced.  No shuffle; the
    network (some 10 KB) goes to the tasks, which hold one slice of texts.
    """

    def work():
        tables = net.tables() if net else None

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t if net and t and _letter(t) else None for t in batch.column(text_col).to_pylist()]
            known = [i for i, t in enumerate(texts) if t]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for at in range(0, len(known), 64):
                part = known[at : at + 64]
                raw = [texts[i].encode() for i in part]
                windows = byte_windows(raw)
                logits = np.concatenate([net.logits(net.pooled(windows[k : k + 64], tables)) for k in range(0, len(windows), 64)])
                counts = np.array([-(-len(r) // WINDOW) for r in raw])
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                weight = np.full(len(windows), float(WINDOW))
                weight[first + counts - 1] = [len(r) - (n - 1) * WINDOW for r, n in zip(raw, counts)]
                mean = np.add.reduceat(logits * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
                share = _softmax(mean)
                for i, best, s in zip(part, share.argmax(axis=1), share.max(axis=1)):
                    langs[i], scores[i] = net.classes[best], float(min(max(s, 0.0), 1.0))
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return each

    return with_arrow(docs, "lang_pred string, score double", text_col, work)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: CRC-32 of its id as text leaves 2 when divided by 4; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, net: ByteCnn | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs`` whose language is known with at least ``min_score``."""
    clash = [c for c in ("lang_pred", "score") if c in docs.columns]
    if clash:  # keep the caller's columns of these names
        packed = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text"))
        return identify(packed, net, "__text").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("__row.*")
    # The text goes to Python once.
    return identify(docs, net, text_col).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*docs.columns)
