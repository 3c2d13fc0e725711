"""Quality classifier: gated attention over the passages of a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blocks

PASSAGE = 512  # bytes
BLOCK = 2_000_000  # bytes of texts encoded together
FINE, BUCKETS = 1024, 128  # hashes of triples; each bucket sums FINE / BUCKETS of them
AT_ONCE = 2048  # passages whose fine counts are in memory together
LEARNED = 65_536  # passages whose gradients are made together, those of whole documents
#: Classes of bytes: upper case, lower case and beyond ASCII, digits, spaces, line ends, full stops, commas, exclamation marks, symbols, the rest.
CLASSES = np.full(256, 9, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(97, 123)) + bytes(range(128, 256)), b"0123456789", b" \t", b"\n\r", b".?;:", b",", b"!", b"#*$%&|<>=_")):
    CLASSES[list(_chars)] = _i
N_CLASSES = 10
PLACES = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
WIDTH = N_CLASSES + BUCKETS + 5


def repeats(data: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` passages, the share of its words that equal the word before."""
    space = (CLASSES[data] == 3) | (CLASSES[data] == 4)
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1] | (owner[1:] != owner[:-1])])) if len(data) else np.zeros(0, int)
    if not len(begins):
        return np.zeros(n)
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(data)]])))
    weight = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * PLACES[place & 63])
    words = np.add.reduceat(weight, begins)
    of = owner[begins]
    same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    return np.bincount(of[1:][same], minlength=n) / np.maximum(1, np.bincount(of, minlength=n))


def _features(ahead: np.ndarray, left: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Features of ``n`` passages from their bytes, two bytes more ahead if there are; ``left`` says
    how many bytes of its text follow each."""
    data = ahead[: len(left)]
    some = np.maximum(1, np.bincount(owner, minlength=n))[:, None]
    classes = np.bincount(owner * N_CLASSES + CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / some
    x = np.zeros(len(data) + 2, np.uint32)
    x[: len(ahead)] = ahead
    triples = x[:-2] * np.uint32(0x9E3779B1)
    triples += np.where(left > 0, x[1:-1], np.uint32(0)) * np.uint32(0x85EBCA77)
    triples += np.where(left > 1, x[2:], np.uint32(0)) * np.uint32(0xC2B2AE3D)
    triples ^= triples >> np.uint32(15)
    triples *= np.uint32(0x2C1B3C6D)
    bucket = (triples >> np.uint32(12)) % np.uint32(FINE)
    fine = (np.bincount(owner * FINE + bucket, minlength=n * FINE).reshape(n, FINE) / some).astype(np.float32)
    coarse = fine.reshape(n, BUCKETS, FINE // BUCKETS).sum(axis=2)
    return np.concatenate([classes, coarse, np.sqrt((fine**2).sum(axis=1))[:, None], fine.max(axis=1)[:, None], repeats(data, owner, n)[:, None]], axis=1).astype(np.float32)


class Passages:
    """The passages of texts: each text is cut into equal ones of about 512 bytes, one at least.

    ``counts`` holds the number of each text's passages. Nulls are empty texts. The bytes of an Arrow
    column are not copied, and features are made of ``AT_ONCE`` passages at a time.
    """

    def __init__(self, texts: pa.Array | list[str | None]):
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = column.fill_null("") if column.null_count else column
        sizes = pc.binary_length(column).to_numpy().astype(np.int64)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        self.counts = np.maximum(1, np.rint(sizes / PASSAGE).astype(np.int64))
        first = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(sizes)), self.counts)
        nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.starts = first[self.doc] + nth * sizes[self.doc] // self.counts[self.doc]
        self.ends = first[self.doc] + (nth + 1) * sizes[self.doc] // self.counts[self.doc]
        self.last, self.sizes, self.kept = first + sizes, sizes, column

    def features(self) -> Iterator[np.ndarray]:
        """Features of the passages, in order, in several parts.

        Shares of byte classes, shares of hashed character triples, the evenness of those, the share of
        words that repeat the word before, and lengths. Texts don't influence each other.
        """
        for a in range(0, len(self.doc), AT_ONCE):
            b = min(len(self.doc), a + AT_ONCE)
            low, high = int(self.starts[a]), int(self.ends[b - 1])
            lengths = self.ends[a:b] - self.starts[a:b]
            owner = np.repeat(np.arange(b - a), lengths)
            left = np.repeat(self.last[self.doc[a:b]], lengths) - np.arange(low, high) - 1
            made = _features(self.data[low : high + 2], left, owner, b - a)
            size = np.stack([np.log1p(lengths) / 6, np.log1p(self.sizes[self.doc[a:b]]) / 10], axis=1)
            yield np.concatenate([made, size.astype(np.float32)], axis=1)


def encode_passages(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, about 1.2 times its bytes, and the number of passages of each text."""
    passages = Passages(texts)
    return np.concatenate([np.zeros((0, WIDTH), np.float32), *passages.features()]), passages.counts


class AttentionModel:
    """Gated attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

    A passage x becomes h = tanh(xW + b); its weight is a softmax, over its document, of
    w · (tanh(hV) * sigmoid(hU)); the document's score is sigmoid(c · sum of weighted h + d).
    """

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        shape = {"W": (WIDTH, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": (1,)}
        self.p = {k: (r.normal(0, s[0] ** -0.5, s) if len(s) > 1 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)

    def gated(self, x: np.ndarray) -> dict:
        """Each passage for itself: its state h, the gate's halves v and u, and the weight e before the softmax."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return {"x": x, "h": h, "v": v, "u": u, "e": (v * u) @ p["w"]}

    def pooled(self, h: np.ndarray, e: np.ndarray, counts: np.ndarray) -> dict:
        """Attention a of the passages of each document, their weighted sum z and the document's score."""
        starts = np.cumsum(counts) - counts
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"a": a, "z": z, "score": 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["d"]))), "starts": starts}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        made = self.gated(x)
        return made | self.pooled(made["h"], made["e"], counts)

    def score(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """Scores to six digits. Of a passage only its state is kept, so a text takes a fifth of its bytes beside itself."""
        if not len(texts):
            return np.zeros(0)
        passages = Passages(texts)
        states, weights = [], []
        for x in passages.features():
            made = self.gated(x)
            states.append(made["h"])
            weights.append(made["e"])
        h, e = np.concatenate(states), np.concatenate(weights)
        return np.round(self.pooled(h, e, passages.counts)["score"].astype(np.float64), 6)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, of: int = 0) -> dict[str, np.ndarray]:
        """Those of the mean log loss, by parameter; or their part in the mean over ``of`` documents."""
        f, p = self.forward(x, counts), self.p
        h, v, u, a = f["h"], f["v"], f["u"], f["a"]
        s = (f["score"] - y) / np.float32(of or len(y))
        dz = s[:, None] * p["c"]
        per = np.repeat(dz, counts, axis=0)
        da = (per * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, f["starts"]), counts))
        dg = de[:, None] * p["w"]
        dv, du = dg * u * (1 - v**2), dg * v * u * (1 - u)
        dh = (a[:, None] * per + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": f["z"].T @ s, "d": np.array([s.sum()], np.float32)}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 150, rate: float = 0.02, decay: float = 1e-3) -> AttentionModel:
        """Full-batch Adam on log loss; deterministic. With one label only, the score is constant.

        Gradients are sums over parts of about ``LEARNED`` passages, so beside ``x``, of 16 or 32 bits,
        memory holds the numbers of one part.
        """
        if not len(y) or y.min() == y.max():
            self.p = {k: np.zeros_like(v) for k, v in self.p.items()}
            self.p["d"][:] = 0 if not len(y) else 4 if y[0] else -4
            return self
        ends = np.cumsum(counts)
        cuts = [0, *(np.flatnonzero(np.diff(ends // LEARNED)) + 1).tolist(), len(counts)]
        parts = [(slice(ends[i] - counts[i], ends[j - 1]), slice(i, j)) for i, j in zip(cuts, cuts[1:], strict=False)]
        mean = sum(x[at].sum(axis=0, dtype=np.float64) for at, _ in parts) / len(x)
        spread = np.sqrt(sum(((x[at] - mean) ** 2).sum(axis=0) for at, _ in parts) / len(x))
        self.mean, self.scale = mean.astype(np.float32), spread.astype(np.float32) + np.float32(1e-3)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for step in range(1, epochs + 1):
            p = self.p
            whole: dict[str, np.ndarray] = {}
            for at, docs in parts:
                for k, g in self.gradients(x[at].astype(np.float32), counts[docs], y[docs], len(y)).items():
                    whole[k] = whole[k] + g if k in whole else g
            for k, g in whole.items():
                g = g + np.float32(decay) * p[k]
                m = moments[k]
                m[0] = np.float32(0.9) * m[0] + np.float32(0.1) * g
                m[1] = np.float32(0.999) * m[1] + np.float32(0.001) * g * g
                p[k] = (p[k] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 4000, most_passages: int = 256, id_col: str = "doc_id", text: str = "text", label: str = "quality", prepare: Callable[[DataFrame, str], DataFrame] | None = None) -> AttentionModel:
    """Fit on at most ``most_labels`` labelled documents, the first by hash of their id.

    Rows whose crc32 of the id as text is divisible by 5 are held out, and so are labels other
    than 0 and 1. Several labels of one id count as their majority, several texts as the first by
    hash. ``prepare`` may change the sample's texts, given with the name of their column. Texts of over ``most_passages`` passages (about 512 bytes each) are left out of the sample.
    What reaches the driver is the sample's features, whole texts encoded on the executors:
    ``most_labels * most_passages`` rows of 16-bit numbers at most, 300 MB as set here, and about
    2 MB where texts are 2,000 bytes long. They come partition by partition and stay 16-bit numbers.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    own = own.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.avg("y").alias("y"))
    sample = own.orderBy(F.xxhash64("id"), "id").limit(most_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "t", BLOCK):
            x, counts = encode_passages(part.column("t"))
            ends = np.cumsum(counts)
            raw = [x[e - c : e].astype(np.float16).tobytes() for c, e in zip(counts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), part.column("h"), pa.array(raw, pa.binary())], names=["id", "y", "h", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).where(F.coalesce(F.octet_length(text), F.lit(0)) <= most_passages * PASSAGE)
    joined = arrow_rows(texts.join(F.broadcast(sample.select(F.col("id").cast("long").alias("id"), "y")), "id"))  # most_labels rows
    joined = (prepare(joined, "t") if prepare else joined).select("id", "y", F.xxhash64("t").alias("h"), "t")
    made = joined.mapInArrow(run, "id long, y double, h long, x binary").groupBy("id").agg(F.min("y").alias("y"), F.min_by("x", "h").alias("x"))
    rows = sorted(((r["id"], r["y"], np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH)) for r in made.toLocalIterator()), key=lambda r: r[0])
    counts, y = np.array([len(r[2]) for r in rows], int), np.array([r[1] >= 0.5 for r in rows], np.float32)
    x, start = np.empty((counts.sum(), WIDTH), np.float16), 0
    for i, n in enumerate(counts):
        x[start : start + n], rows[i], start = rows[i][2], None, start + n
    return AttentionModel().fit(x, counts, y)


def classify(docs: DataFrame, model: AttentionModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``threshold`` up).

    Every passage of the whole text counts. Null and empty texts are one empty passage and have a
    score too. Texts are scored in blocks of about 2 MB; a longer one is a block of its own, of whose
    passages only the states are in memory together, a fifth of its bytes. Rows are independent: a score depends on the text
    alone, repeated rows and null ids stay, and no rows give none. Older columns ``score`` and
    ``predicted`` are replaced.
    """
    docs = docs.drop("score", "predicted")
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text, BLOCK):
            scores = model.score(part.column(text))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, "score"])

    return arrow_rows(docs).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
