"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Two GRUs read a window of bytes from either end; their states at a byte give a probability of each language there.
A document's probabilities are the mean over all its bytes. Whole texts are read, cut into windows of ``WINDOW`` bytes
that overlap: each is read with ``CONTEXT`` bytes of the text before and after it, over which the states warm up and which
are not pooled, so that no byte, and no character of several bytes, is read without what stands around it. Thousands of
windows of a batch advance together, byte by byte.

The model is fitted on the driver from a bounded sample: of at most about ``SAMPLE`` documents of each language all
windows of the whole texts are candidates, of which a hash draws about ``CUTS`` a document. Training rows have a known
language and crc32(doc_id) mod 3 other than 1; a prediction sees the text.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text if no row can be
learned from; a null id is never learned from and not held out; equal texts get equal results; of equally likely languages
the first by name is taken; a very long text is more windows; an empty table gives an empty result; more than
``LANGUAGES`` languages are an error. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import fold_of

#: Documents of a language and windows of a document that are learned from, about; bytes of a window and around it.
SAMPLE, CUTS, WINDOW, CONTEXT = 1200, 4, 64, 8
#: Languages that are learned at most.
LANGUAGES = 500
#: Units of a direction, training steps, windows of a step, learning rate.
UNITS, STEPS, BATCH, RATE = 8, 300, 128, 0.02
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Windows that advance together in a prediction.
ROWS = 2048


def windows_of(data: bytes, width: int = WINDOW, context: int = CONTEXT) -> np.ndarray:
    """All bytes of a text in rows of ``width``, each with ``context`` bytes before and after it, zeros beyond the ends."""
    n = -(-len(data) // width)
    if not n:
        return np.zeros((0, width + 2 * context), np.uint8)
    padded = b"\0" * context + data + b"\0" * (n * width - len(data) + context)
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(padded, np.uint8), width + 2 * context)[::width]


def _cuts(width: int):
    """Windows drawn by a hash of text and place, each with the row's probability."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, pieces = [], []
            for lang, share, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = text.encode("utf-8", "surrogatepass")
                rows = windows_of(data, width)
                x = (np.arange(len(rows), dtype=np.uint64) + np.uint64(zlib.crc32(data) << 20)) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                for k in np.flatnonzero((x >> np.uint64(33)).astype(float) < share * 2.0**31):
                    langs.append(lang)
                    pieces.append(rows[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], names=["lang", "piece"])

    return run


def has_letter(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string").rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, per_language: int = SAMPLE, cuts: int = CUTS, width: int = WINDOW) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, window bytes with their context (n, bytes) and language numbers (n): about per_language * cuts a language."""
    usable = docs.where(F.col("lang").isNotNull() & (fold_of(FOLDS) != HELD_OUT) & has_letter()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    counts = {r["lang"]: r for r in usable.groupBy("lang").agg(
        F.count("*").alias("n"), F.avg(F.ceil(F.octet_length("text") / width)).alias("windows")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if not counts:
        return [], np.zeros((0, width + 2 * CONTEXT), np.uint8), np.zeros(0, np.int64)

    def shares(value) -> Column:
        return F.create_map(*[F.lit(x) for lang, r in counts.items() for x in (lang, float(value(r)))])[F.col("lang")]

    of_documents = shares(lambda r: 2**31 * min(1.0, per_language / r["n"]))
    of_windows = shares(lambda r: min(1.0, cuts * max(1.0, per_language / r["n"]) / r["windows"]))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(2**31)) < of_documents).select("lang", of_windows.alias("share"), "text")
    table = drawn.mapInArrow(_cuts(width), "lang string, piece binary").toArrow()
    rows = sorted(zip(table.column("lang").to_pylist(), table.column("piece").to_pylist()))
    kept, seen = [], dict.fromkeys(counts, 0)
    for lang, piece in rows:
        seen[lang] += 1
        if seen[lang] <= per_language * cuts * 2:  # the draw is of about per_language * cuts; this makes the bound hold
            kept.append((lang, piece))
    langs = sorted({lang for lang, _ in kept})
    number = {lang: k for k, lang in enumerate(langs)}
    x = np.frombuffer(b"".join(p for _, p in kept), np.uint8).reshape(-1, width + 2 * CONTEXT)
    return langs, x, np.array([number[lang] for lang, _ in kept], np.int64)


def initial(languages: int, units: int = UNITS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights: a table of gate inputs per byte and a recurrent matrix for each direction, and the output layer."""
    rng = np.random.default_rng(seed)
    w = {}
    for side in "fb":
        w["e" + side] = rng.normal(0, 0.3, (256, 3 * units)).astype(np.float32)
        w["u" + side] = rng.normal(0, units**-0.5, (units, 3 * units)).astype(np.float32)
    w["v"] = rng.normal(0, 0.3, (2 * units, languages)).astype(np.float32)
    w["c"] = np.zeros(languages, np.float32)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run_gates(x: np.ndarray, e: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, rows, units) of one direction over bytes x (time, rows); ``keep`` collects what the gradient needs."""
    n = u.shape[0]
    h = np.zeros((x.shape[1], n), np.float32)
    out = np.empty((*x.shape, n), np.float32)
    for t in range(x.shape[0]):
        a, b = e[x[t]], h @ u
        gates = _sigmoid(a[:, : 2 * n] + b[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(a[:, 2 * n:] + r * b[:, 2 * n:])
        if keep is not None:
            keep.append((h, z, r, b[:, 2 * n:], new))
        h = new + z * (h - new)
        out[t] = h
    return out


def _gradient_of_gates(x: np.ndarray, u: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = u.shape[0]
    de, du, dh = np.zeros((256, 3 * n), np.float32), np.zeros_like(u), np.zeros(dout.shape[1:], np.float32)
    for t in range(x.shape[0] - 1, -1, -1):
        h, z, r, b, new = kept[t]
        dh = dh + dout[t]
        dnew = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dnew * b * r * (1 - r)
        da = np.concatenate([dz, dr, dnew], axis=1)
        db = np.concatenate([dz, dr, dnew * r], axis=1)
        np.add.at(de, x[t], da)
        du += h.T @ db
        dh = dh * z + db @ u.T
    return de, du


def loss_and_gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions that hold a byte, and its gradient; x is (time, rows)."""
    n = w["uf"].shape[0]
    keep_f, keep_b = [], []
    back = x[::-1]
    both = np.concatenate([_run_gates(x, w["ef"], w["uf"], keep_f), _run_gates(back, w["eb"], w["ub"], keep_b)[::-1]], axis=2)
    logits = both @ w["v"] + w["c"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    there = (x != 0).astype(np.float32)
    total = max(1.0, float(there.sum()))
    rows = np.arange(x.shape[1])
    loss = -float((np.log(p[:, rows, y] + 1e-9) * there).sum()) / total
    p[:, rows, y] -= 1
    d = p * (there / total)[:, :, None]
    dboth = d @ w["v"].T
    ef, uf = _gradient_of_gates(x, w["uf"], keep_f, dboth[:, :, :n])
    eb, ub = _gradient_of_gates(back, w["ub"], keep_b, dboth[::-1, :, n:])
    v = both.reshape(-1, 2 * n).T @ d.reshape(-1, d.shape[2])
    return loss, {"ef": ef, "uf": uf, "eb": eb, "ub": ub, "v": v, "c": d.sum(axis=(0, 1))}


def fit(x: np.ndarray, y: np.ndarray, languages: int, steps: int = STEPS, batch: int = BATCH, units: int = UNITS,
        rate: float = RATE, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over batches that draw every language equally often."""
    w, rng = initial(languages, units, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    rows = [np.flatnonzero(y == k) for k in range(languages)]
    for step in range(1, steps + 1):
        drawn = np.concatenate([rng.choice(r, batch // languages + 1) for r in rows])
        _, g = loss_and_gradient(w, x[drawn].T, y[drawn])
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k in w:
            d = g[k] / max(1.0, size)
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.99 * s[k] + 0.01 * d * d
            w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w


def _states(x: np.ndarray, e: np.ndarray, u: np.ndarray) -> np.ndarray:
    """As ``_run_gates`` without what the gradient needs, in place and with rows last: (time, units, rows)."""
    n, rows = u.shape[0], x.shape[1]
    half = np.r_[np.full(2 * n, 0.5), np.ones(n)].astype(np.float32)  # sigmoid(x) = 0.5 + 0.5 tanh(0.5 x)
    e, ut = e * half, np.ascontiguousarray((u * half).T)
    taken, a, b = np.empty((rows, 3 * n), np.float32), np.empty((3 * n, rows), np.float32), np.empty((3 * n, rows), np.float32)
    out, h = np.empty((x.shape[0], n, rows), np.float32), np.zeros((n, rows), np.float32)
    for t in range(x.shape[0]):
        np.take(e, x[t], axis=0, out=taken, mode="clip")
        a[...] = taken.T
        np.matmul(ut, h, out=b)
        gates, new = b[: 2 * n], b[2 * n:]
        gates += a[: 2 * n]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new *= gates[n:]
        new += a[2 * n:]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out[t])
        out[t] *= gates[:n]
        out[t] += new
        h = out[t]
    return out


def position_probabilities(w: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Probability of each language at each byte of windows (n, width): (width, languages, n)."""
    x = np.ascontiguousarray(rows.T)
    n, v = w["uf"].shape[0], np.ascontiguousarray(w["v"].T)
    p = np.matmul(v[:, :n], _states(x, w["ef"], w["uf"]))
    p += np.matmul(v[:, n:], _states(x[::-1], w["eb"], w["ub"])[::-1])
    p += w["c"][:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def pooled(w: dict[str, np.ndarray], texts: list[bytes], width: int = WINDOW, context: int = CONTEXT) -> np.ndarray:
    """Mean probability of each language over all bytes of each text (texts hold at least one byte)."""
    parts = [windows_of(t, width, context) for t in texts]
    rows = np.concatenate(parts)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    total = np.zeros((len(texts), len(w["c"])))
    for at in range(0, len(rows), ROWS):
        part = rows[at:at + ROWS]
        p = position_probabilities(w, part)[context:context + width]
        p *= (part.T[context:context + width] != 0)[:, None, :]
        sums = p.sum(axis=0)
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(owner[at:at + ROWS], sums[k], len(texts))
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def _predict(w: dict[str, np.ndarray] | None, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            letters = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)) if w is not None else []
            texts = batch.column(3)
            for at in range(0, len(letters), 256):
                some = letters[at:at + 256]
                p = pooled(w, [texts[int(i)].as_py().encode("utf-8", "surrogatepass") for i in some])
                best = p.argmax(axis=1)
                score[some] = p[np.arange(len(some)), best]
                for i, k in zip(some, best):
                    label[i] = langs[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1)), batch.column(4)],
                                             names=["doc_id", "text_sha256", "lang_pred", "score", "learnable"])

    return run


def identify(docs: DataFrame, per_language: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, text_sha256, learnable."""
    langs, x, y = sample(docs, per_language)
    w = fit(x, y, len(langs), steps) if langs else None
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
                        has_letter().alias("letters"), F.col("text").cast("string").alias("text"),
                        F.coalesce(F.col("lang").isNotNull() & (fold_of(FOLDS) != HELD_OUT) & has_letter(), F.lit(False)).alias("learnable"))
    found = light.mapInArrow(_predict(w, langs), "doc_id long, text_sha256 string, lang_pred string, score double, learnable boolean")
    return found.select("doc_id", F.coalesce(fold_of(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "text_sha256", "learnable")


def query(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_sha256", "learnable")
