"""Toxicity by compression distance: window lengths under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import crc_of_id, map_arrow

#: Words to a window.
WINDOW = 8


def windows(text: str | None) -> list[bytes]:
    """Whole text, lower case, as runs of WINDOW words with one space before and after each word."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


@dataclass
class Model:
    """Two dictionaries (raw content) and the calibration of what their lengths differ by.

    A window is compressed behind an anchor, the end of the content that both dictionaries hold, so that
    no window is too short to be worth compressing and each byte saved shows.
    """

    toxic: bytes
    ordinary: bytes
    anchor: int = 40
    weights: tuple[float, ...] = (0.0,) * 6
    bias: float = 0.0

    def __post_init__(self):
        self._both = None

    def __getstate__(self):
        return self.__dict__ | {"_both": None}

    def gaps(self, text: str | None) -> np.ndarray:
        """Per window: bytes that the toxic dictionary saves against the ordinary one."""
        if self._both is None:
            self._both = tuple(map(self._compressor, (self.toxic, self.ordinary)))
        t, o = self._both
        lead = self.ordinary[-self.anchor :]
        return np.array([len(o(w)) - len(t(w)) for w in (lead + x for x in windows(text))], dtype=float)

    @staticmethod
    def _compressor(content: bytes):
        reach = max(13, len(content).bit_length())  # the tables hold every position of the content
        p = zstandard.ZstdCompressionParameters(
            window_log=max(15, reach + 1), hash_log=reach, chain_log=reach, search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

    def features(self, text: str | None) -> tuple[float, ...]:
        """Largest gap, windows whose gap is 2, 3, 4, more (log), windows (log)."""
        g = self.gaps(text)
        if not len(g):
            return (0.0,) * 6
        return (float(min(max(g.max(), 0), 10)), *(math.log1p(float(n)) for n in ((g == 2).sum(), (g == 3).sum(), (g == 4).sum(), (g > 4).sum(), len(g))))

    def score(self, text: str | None) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train_dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary that zstandard trains on all samples, of segments of so many bytes; all the
    samples themselves where there are too few to train on.

    Samples come once each, in an order of their hashes: the trainer goes through them in stretches and
    ends where many in a row bring nothing new, as those of one long text of repeated lines do."""
    samples = sorted(set(samples), key=xxhash.xxh64_intdigest)
    try:
        d = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        return d[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)


def train_dictionaries(toxic: list[str], ordinary: list[str], size: int, ordinary_size: int) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, each trained on all windows of the texts of its class.

    The toxic one goes on with the ordinary content, so that what both classes say costs the same under
    both. The ordinary one is the larger by far, as noise is what it lacks and the other has by chance."""
    common = train_dictionary([w for t in ordinary for w in windows(t)], ordinary_size, 64) or b" " * 8
    return train_dictionary([w for t in toxic for w in windows(t)], size, 16) + common, common


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic fit by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w, r = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(r), a.T @ (y - p) - r * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]], sizes: tuple[int, ...] = (2048, 8192, 32768), ordinary_size: int = 1 << 20) -> Model:
    """Model from (text, label) rows.

    Three rows of four train the dictionaries. The fourth, which no dictionary has seen, chooses the size
    of the toxic one and calibrates: a logistic fit over the gaps, then the threshold that errs least
    becomes score 0.5. One class or no rows: a model that scores everything with the base rate.
    """
    rows = [(t or "", int(y)) for t, y in rows]
    kinds = [[t for t, y in rows if y == k] for k in (0, 1)]
    if min(map(len, kinds)) < 4:
        p = (len(kinds[1]) + 1) / (len(rows) + 2) if rows else 0.1
        return Model(b" " * 8, b" " * 8, bias=math.log(p / (1 - p)))
    fold = [t for k in kinds for t in k[::4]]
    y = np.array([k for k in (0, 1) for _ in kinds[k][::4]], dtype=float)
    train = [[t for i, t in enumerate(k) if i % 4] for k in kinds]
    best = None
    for size in sizes:
        model = Model(*train_dictionaries(train[1], train[0], size, ordinary_size))
        x = np.array([model.features(t) for t in fold])
        w = _logistic(x, y)
        z = np.c_[x, np.ones(len(x))] @ w
        order = np.argsort(z, kind="stable")
        errors = y.sum() + np.cumsum(np.r_[0, np.where(y[order] > 0, 1, -1)]) - y.sum()
        zs = np.r_[z[order[0]] - 1, (z[order][1:] + z[order][:-1]) / 2, z[order[-1]] + 1]
        if best is None or errors.min() < best[0]:
            at = np.flatnonzero(errors == errors.min())
            model.weights, model.bias = tuple(w[:-1]), float(w[-1] - zs[at[len(at) // 2]])
            best = (errors.min(), model)
    return best[1]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most per_class labelled texts of each class, the first by a hash of the key, none held out.

    per_class bounds what reaches the driver and what is broadcast: keys of at most 2 * per_class rows.
    Where rows repeat a key, at most 4 * per_class texts come, those of the smallest keys."""
    fold = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (crc_of_id(key, modulus) != held_out))
    picks = [fold.where(F.col(label) == y).select(F.col(key).alias("k"), F.col(label).alias("y")).orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).join(F.broadcast(picks[0].union(picks[1])), F.col("d") == F.col("k"))
    return [(r.t, r.y) for r in rows.select("t", "y", "k").orderBy("k").limit(4 * per_class).collect()]


def score(docs: DataFrame, model: Model, text: str = "text", score_col: str = "score", predicted_col: str = "predicted", threshold: float = 0.5) -> DataFrame:
    """docs with a score and a 0/1 prediction; columns of those names are replaced, all others stay.

    Null and empty texts get the score of a text without any window; texts of any length are read whole.
    """
    keep = [c for c in docs.columns if c not in (score_col, predicted_col)]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text)
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{score_col}` double", f"`{predicted_col}` int"])

    def run(batch: pa.RecordBatch):
        s = np.array([model.score(t) for t in batch.column(at).to_pylist()], dtype=float)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, score_col, predicted_col])

    return map_arrow(docs, run, kinds)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, modulus: int = 5, held_out: int = 0) -> Model:
    return fit(training_rows(docs, labels, "toxic", modulus, held_out, per_class))
