"""Sentences to token matrices."""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, product, repeat
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship


#: Numbers of an Arrow batch that an encoder's worker sends.
SENT_VALUES = 4_000_000


class Encoder(Protocol):
    """encode() gives a matrix for each sentence; its first row stands for the whole. Made once by each Python worker, from max_tokens."""

    def encode(self, sentences: list[str]) -> list[np.ndarray]: ...


class _Words:
    """The vectors of the words that a worker has met, by row of a table; row 0 is the padding word's."""

    #: Words that are kept: some 100 MB.
    MOST = 400_000

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, self.dimensions), np.float32)
        self.rows(["[PAD]"])

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.MOST:
            self.forget()
        rows = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0).tolist()
        new = list(dict.fromkeys(words[i] for i in missing))
        if new:
            begin = len(self.known)
            self.known.update(zip(new, range(begin, begin + len(new)), strict=True))
            while len(self.table) < len(self.known):
                self.table = np.concatenate([self.table, np.zeros((max(1024, len(self.table)), self.dimensions), np.float32)])
            seeds = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:8] for w in new), "<u4").reshape(-1, 2)
            for row, state in enumerate(seed_states(seeds), begin):
                v = np.random.Generator(np.random.PCG64(_Seeded(state))).standard_normal(self.dimensions)
                self.table[row] = v / math.sqrt(v.dot(v))
            rows[missing] = [self.known[words[i]] for i in missing]
        return rows


def seed_states(seeds: np.ndarray) -> np.ndarray:
    """What np.random.SeedSequence gives PCG64 for each 64-bit seed (a row of its low and high half), for all at once: by itself it costs more than the numbers drawn."""
    u = np.uint32

    def hashed(x: np.ndarray, const: int, factor: int) -> tuple[np.ndarray, int]:
        after = const * factor & 0xFFFFFFFF
        x = (x ^ u(const)) * u(after)
        return x ^ x >> u(16), after

    const, pool = 0x43B0D7E5, []
    for x in (*seeds.astype(u).T, *np.zeros((2, len(seeds)), u)):
        x, const = hashed(x, const, 0x931E8875)
        pool.append(x)
    for i, k in product(range(4), range(4)):
        if i != k:
            x, const = hashed(pool[i], const, 0x931E8875)
            x = pool[k] * u(0xCA01F9DD) - x * u(0x4973F715)
            pool[k] = x ^ x >> u(16)
    const, out = 0x8B51F9DD, []
    for i in range(8):
        x, const = hashed(pool[i % 4], const, 0x58F38DED)
        out.append(x)
    return np.ascontiguousarray(np.stack(out, axis=1)).view(np.uint64)


class _Seeded(np.random.bit_generator.ISeedSequence):
    """A state that is known already."""

    def __init__(self, state: np.ndarray):
        self.state = state

    def generate_state(self, n_words: int, dtype=np.uint64) -> np.ndarray:
        return self.state


#: Those of this Python worker by their length: tasks that follow each other know what the earlier ones met.
_WORDS: dict[int, _Words] = {}


class HashEncoder:
    """A fixed pseudo-random unit vector for each word; the first row is their mean. All matrices have max_tokens rows.

    It stands in for a language model where none is at hand: equal words are alike and nothing else is. Rows beyond the sentence are
    the vector of the padding word, and take part in every comparison, as the rows of a padded model output do.
    """

    #: Matrices are some twenty times as large as sentences and cost little: a run makes them again where they are compared.
    cheap = True

    def __init__(self, dimensions: int = 16, max_tokens: int = 128):
        self.dimensions, self.max_tokens = dimensions, max_tokens

    def encode(self, sentences: list[str]) -> list[np.ndarray]:
        if self.dimensions not in _WORDS:
            _WORDS[self.dimensions] = _Words(self.dimensions)
        known = _WORDS[self.dimensions]
        words = [s.split()[: self.max_tokens - 1] for s in sentences]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.zeros((len(sentences), self.max_tokens - 1), np.int64)
        rows[np.arange(self.max_tokens - 1) < counts[:, None]] = known.rows(list(chain.from_iterable(words)))
        out = np.empty((len(sentences), self.max_tokens, self.dimensions), np.float32)
        out[:, 1:] = known.table[rows]
        for n in np.unique(counts).tolist():
            at = np.flatnonzero(counts == n)
            out[at, 0] = out[at, 1 : max(1, n) + 1].mean(axis=1)  # the mean of no words is the padding word
        return list(out)


class TransformerEncoder:
    """A transformer whose weights come from a file: subword ids of the tokenizers library, and the last layer's output for each token.

    The file is a NumPy archive of the arrays below and of `settings`, JSON text with heads, eps and the strings first, last and pad of special tokens
    in the tokenizer's vocabulary. Sequences begin with `first`, end with `last`, are cut at max_tokens and padded to it; padding is hidden from attention,
    and its rows are output like any other. Layers are post-normalised: attention, residual, norm, two dense maps with an erf GELU between, residual, norm.

        word (vocabulary, d), position (at least max_tokens, d), norm_scale and norm_shift (d);
        of layer i: i_qkv (d, 3 d), i_qkv_bias, i_out (d, d), i_out_bias, i_norm1_scale, i_norm1_shift, i_up (d, h), i_up_bias, i_down (h, d), i_down_bias, i_norm2_scale, i_norm2_shift
    """

    #: Sentences that are computed at a time.
    STEP = 16

    def __init__(self, weights: str, tokenizer: str, max_tokens: int = 128):
        import json

        from tokenizers import Tokenizer
        from tokenizers.processors import TemplateProcessing

        with np.load(io.BytesIO(read_bytes(weights))) as z:
            self.w = {k: z[k] for k in z.files}
        settings = json.loads(str(self.w.pop("settings")))
        self.heads, self.eps = settings["heads"], settings.get("eps", 1e-12)
        self.layers = sum(k.endswith("_qkv") for k in self.w)
        self.tokenizer = Tokenizer.from_str(read_bytes(tokenizer).decode())
        first, last, pad = (settings[k] for k in ("first", "last", "pad"))
        ids = {t: self.tokenizer.token_to_id(t) for t in (first, last, pad)}
        if None in ids.values():
            raise ValueError(f"the tokenizer lacks one of {sorted(ids)}")
        if max_tokens > len(self.w["position"]):
            raise ValueError(f"the weights have {len(self.w['position'])} positions")
        self.tokenizer.post_processor = TemplateProcessing(single=f"{first} $A {last}", special_tokens=[(first, ids[first]), (last, ids[last])])
        self.tokenizer.enable_truncation(max_tokens)
        self.tokenizer.enable_padding(length=max_tokens, pad_id=ids[pad], pad_token=pad)

    def ids(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and which of them are no padding, a row for each sentence."""
        found = self.tokenizer.encode_batch(sentences)
        return np.array([e.ids for e in found], np.int64), np.array([e.attention_mask for e in found], bool)

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        x = x - x.mean(axis=-1, keepdims=True)
        return x / np.sqrt((x**2).mean(axis=-1, keepdims=True) + self.eps) * self.w[f"{name}_scale"] + self.w[f"{name}_shift"]

    def forward(self, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
        w = self.w
        n, length = ids.shape
        x = self._norm(w["word"][ids] + w["position"][:length], "norm")
        size = x.shape[-1] // self.heads
        hidden = np.where(real, 0.0, -np.inf)[:, None, None, :].astype(x.dtype)
        for i in range(self.layers):
            qkv = (x @ w[f"{i}_qkv"] + w[f"{i}_qkv_bias"]).reshape(n, length, 3, self.heads, size).transpose(2, 0, 3, 1, 4)
            a = qkv[0] @ qkv[1].swapaxes(-1, -2) / np.sqrt(x.dtype.type(size)) + hidden
            a = np.exp(a - a.max(axis=-1, keepdims=True))
            mixed = (a / a.sum(axis=-1, keepdims=True)) @ qkv[2]
            x = self._norm(x + mixed.transpose(0, 2, 1, 3).reshape(n, length, -1) @ w[f"{i}_out"] + w[f"{i}_out_bias"], f"{i}_norm1")
            up = x @ w[f"{i}_up"] + w[f"{i}_up_bias"]
            x = self._norm(x + (up * 0.5 * (1 + _erf(up / np.sqrt(x.dtype.type(2))))) @ w[f"{i}_down"] + w[f"{i}_down_bias"], f"{i}_norm2")
        return x

    def encode(self, sentences: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(sentences), self.STEP):
            out += list(self.forward(*self.ids(sentences[i : i + self.STEP])))
        return out


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function by a rational approximation that errs by 1.5e-7 at most (fixed values of Abramowitz and Stegun, 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def read_bytes(path: str) -> bytes:
    """A whole file, of any file system that Arrow knows; tasks read weights and vocabularies by it."""
    path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    system, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with system.open_input_file(name) as f:
        return f.read()


#: Encoders by the names that RunConfig.encoder takes. A user adds a model's class or function of max_tokens here.
ENCODERS: dict[str, Callable[..., Encoder]] = {"hash": HashEncoder}


def named(name: str, max_tokens: int) -> Callable[[], Encoder]:
    """What makes the encoder of a name, or of a weights file (.npz, with the tokenizer in a .json file of the same name beside it), with so many tokens a sentence."""
    if name in ENCODERS:
        return partial(ENCODERS[name], max_tokens=max_tokens)
    if name.endswith(".npz"):
        return partial(TransformerEncoder, name, name.removesuffix(".npz") + ".json", max_tokens=max_tokens)
    raise ValueError(f"no encoder {name!r}; there are {sorted(ENCODERS)}, and weights files")


def register(name: str, weights: str, tokenizer: str) -> None:
    """Lets RunConfig.encoder name a weights file and a tokenizer that all tasks can read."""
    ENCODERS[name] = partial(TransformerEncoder, weights, tokenizer)


def encode(uniques: DataFrame, make_encoder=HashEncoder, batch_size: int = 8192) -> DataFrame:
    """uid, tokens array<array<float>> of uid, sentence: the encoder is made once by each worker and given at most batch_size sentences at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_encoder()
        for whole in batches:
            for i in range(0, whole.num_rows, batch_size):
                b = whole.slice(i, batch_size)
                matrices = model.encode(b.column("sentence").fill_null("").to_pylist())
                step = max(1, SENT_VALUES // max(1, max(m.size for m in matrices)))
                for k in range(0, len(matrices), step):
                    yield pa.RecordBatch.from_arrays([b.column("uid").slice(k, step), _lists(matrices[k : k + step])], ["uid", "tokens"])

    ship(uniques.sparkSession)
    return uniques.select(F.col("uid").cast("long").alias("uid"), F.col("sentence").cast("string").alias("sentence")).mapInArrow(run, "uid long, tokens array<array<float>>")


def is_cheap(make_encoder: Callable) -> bool:
    """Whether an encoder, or what makes it, says that its matrices are better made again than written."""
    return getattr(getattr(make_encoder, "func", make_encoder), "cheap", False)


def first_rows(uniques: DataFrame, make_encoder=HashEncoder, batch_size: int = 8192) -> DataFrame:
    """uid, sentence, n, cls of uid, sentence, n: of each sentence's matrix the first row alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_encoder()
        for whole in batches:
            for i in range(0, whole.num_rows, batch_size):
                b = whole.slice(i, batch_size)
                rows = [m[:1] for m in model.encode(b.column("sentence").fill_null("").to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(rows).flatten()], ["uid", "sentence", "n", "cls"])

    ship(uniques.sparkSession)
    columns = [F.col(c).cast(t).alias(c) for c, t in (("uid", "long"), ("sentence", "string"), ("n", "long"))]
    return uniques.select(*columns).mapInArrow(run, "uid long, sentence string, n long, cls array<float>")


def matrices_of(sentences: pa.ChunkedArray, make_encoder: Callable, only_cls: bool = False) -> pa.ChunkedArray:
    """The token matrices of sentences, as a column of them."""
    found = make_encoder().encode(sentences.fill_null("").to_pylist())
    return pa.chunked_array([_lists([m[:1] for m in found] if only_cls else found)])


def _lists(matrices: list[np.ndarray]) -> pa.Array:
    """Matrices as lists of rows, without a Python object for each number."""
    rows = np.array([len(m) for m in matrices])
    widths = np.repeat([m.shape[1] for m in matrices], rows)
    flat = np.concatenate([np.asarray(m, np.float32).reshape(-1) for m in matrices])
    offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets(rows), pa.ListArray.from_arrays(offsets(widths), pa.array(flat)))


def pass_through(vectors: DataFrame, key: str, column: str, tokens: int) -> DataFrame:
    """uid, cls, tokens from vectors that exist: the whole vector stands for the sentence, equal slices of it for its tokens. A length that `tokens` does not divide is an error."""
    size = F.size(F.col(column))
    whole = F.when(size % tokens == 0, F.col(column)).otherwise(F.raise_error(F.format_string(f"{tokens} does not divide %d", size)).cast("array<double>"))
    v = F.transform(whole, lambda x: x.cast("double"))
    width = size / tokens
    cut = F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda i: F.slice(v, (i * width + 1).cast("int"), width.cast("int")))
    return vectors.withColumn("uid", F.col(key)).withColumn("cls", v).withColumn("tokens", cut)
