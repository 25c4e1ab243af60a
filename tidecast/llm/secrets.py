"""Secret scans: known patterns, and a battery of randomness tests for the rest.

Base spans come from three patterns. The method adds tokens that look drawn at random. A token of 16 or more characters
of ``A-Za-z0-9+/_-`` is read in the encoding it seems to have (hex, base32 or base64). Three tests ask whether its
symbols are uniform: chi-squared over classes of the alphabet, runs above and below the alphabet's middle, and serial
correlation. Fisher's method combines their p-values; ordinary words fail them by many orders of magnitude.

How far ordinary text gets by chance depends on the length, so the false discovery rate is held per length class. The
null is measured: the letters of each document's words, without the tokens under test, run together and cut to that length,
go through the same battery; what is left at a document's end, shorter than the length, is the only text not in it. So the
null depends on the rows alone, not on how they are dealt out. Over the whole corpus the class's threshold is the lowest at which (tokens tested) * (null share beyond it) is at most
``RATE`` times the tokens beyond it (Benjamini and Hochberg). Both counts are one small histogram a task.

Spans are code points, end exclusive. Defined cases: a null text is empty and has no spans; equal rows get equal results
and count each in the histograms; added spans don't overlap base spans; spans of equal start are in order of kind; without
any text, or in an empty table, there is no threshold and nothing is added; a very long text is read whole. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Words that a match of ASSIGN begins with, without their endings: texts without one are not searched for it.
_HINTS = ("passw", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-])")
WORD = re.compile(r"[A-Za-z]+")
ENCODINGS = (
    ("hex", re.compile(r"[0-9A-F]*|[0-9a-f]*"), "0123456789ABCDEF"),
    ("base32", re.compile(r"[A-Z2-7]*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", re.compile(r".*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Symbols that go through the battery at a time.
BLOCK = 1 << 19
#: Lower ends of the length classes, bins per decade of the p-value, bins, false discovery rate, classes of an alphabet.
LENGTHS, PER_DECADE, N_BINS, RATE, PARTS = (16, 20, 24, 32, 48, 64), 4, 64, 0.01, 4


def _symbols(alphabet: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, c in enumerate(alphabet):
        table[ord(c)] = table[ord(c.lower()) if len(alphabet) == 16 else ord(c)] = k
    if len(alphabet) == 64:
        table[ord("-")], table[ord("_")] = 62, 63
    return table


_TABLES = {name: (_symbols(alphabet), len(alphabet)) for name, _, alphabet in ENCODINGS}


def encoding_of(token: str) -> str:
    """hex or base32 only where letters and digits both occur: else words in capitals would pass for them."""
    mixed = any(c.isdigit() for c in token) and any(c.isalpha() for c in token)
    return next(name for name, pattern, _ in ENCODINGS if (mixed or name == "base64") and pattern.fullmatch(token))


def battery(symbols: np.ndarray, k: int) -> np.ndarray:
    """Combined p-value of randomness for rows of ``symbols`` (n, length) from an alphabet of k."""
    n, length = symbols.shape
    if n > BLOCK // length + 1:
        step = BLOCK // length + 1
        return np.concatenate([battery(symbols[at:at + step], k) for at in range(0, n, step)])
    erfc = np.vectorize(math.erfc, otypes=[float])
    parts = np.arange(k) * PARTS // k
    expected = np.bincount(parts, minlength=PARTS) / k * length
    counts = np.stack([(parts[symbols] == p).sum(axis=1) for p in range(PARTS)], axis=1)
    x = ((counts - expected) ** 2 / expected).sum(axis=1)
    uniform = erfc(np.sqrt(x / 2)) + np.sqrt(2 * x / np.pi) * np.exp(-x / 2)  # chi-squared with 3 degrees of freedom
    runs = (np.diff((symbols >= k // 2).astype(np.int8), axis=1) != 0).sum(axis=1)
    run = erfc(np.abs(runs - (length - 1) / 2) / np.sqrt((length - 1) / 4) / np.sqrt(2))
    z = (symbols - (k - 1) / 2) / np.sqrt((k * k - 1) / 12)
    serial = erfc(np.abs((z[:, 1:] * z[:, :-1]).sum(axis=1)) / np.sqrt(length - 1) / np.sqrt(2))
    half = -np.log(np.maximum(np.stack([uniform, run, serial]), 1e-30)).sum(axis=0)
    return np.exp(-half) * (1 + half + half * half / 2)  # Fisher: chi-squared with 6 degrees of freedom


def p_values(tokens: list[str]) -> np.ndarray:
    groups: dict[tuple[str, int], list[int]] = {}
    for i, token in enumerate(tokens):
        groups.setdefault((encoding_of(token), len(token)), []).append(i)
    out = np.zeros(len(tokens))
    for (name, length), where in groups.items():
        table, k = _TABLES[name]
        raw = np.frombuffer("".join(tokens[i] for i in where).encode(), np.uint8).reshape(-1, length)
        out[where] = battery(table[raw], k)
    return out


def length_class(length: int) -> int:
    return int(np.searchsorted(LENGTHS, length, "right")) - 1


def bin_of(p: np.ndarray) -> np.ndarray:
    return np.clip((-PER_DECADE * np.log10(np.maximum(p, 1e-300))).astype(np.int64), 0, N_BINS - 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans, low = [], text.lower()
    if any(h in low for h in _HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def null_windows(text: str) -> list[np.ndarray]:
    """For each length class the letters of the text's words, without its tokens, in rows of that length."""
    letters = "".join(WORD.findall(TOKEN.sub(" ", text)))
    symbols = _TABLES["base64"][0][np.frombuffer(letters.encode(), np.uint8)]
    return [symbols[: len(symbols) // n * n].reshape(-1, n) for n in LENGTHS]


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per length class and bin, of tokens (seen) and of ordinary text (null): one table a task."""
    seen, null = np.zeros((len(LENGTHS), N_BINS), np.int64), np.zeros((len(LENGTHS), N_BINS), np.int64)
    k = _TABLES["base64"][1]
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            texts = batch.column(0).slice(at, 64).to_pylist()
            tokens = [t for x in texts for t in TOKEN.findall(x)]
            if tokens:
                np.add.at(seen, ([length_class(len(t)) for t in tokens], bin_of(p_values(tokens))), 1)
            for c, rows in enumerate(zip(*map(null_windows, texts))):
                null[c] += np.bincount(bin_of(battery(np.concatenate(rows), k)), minlength=N_BINS)
    c, b = np.nonzero(seen + null)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (c, b, seen[c, b], null[c, b])], names=["c", "b", "seen", "null"])


def thresholds(texts: DataFrame, rate: float = RATE) -> list[int]:
    """Per length class the last bin of p-values that is a discovery, over all of ``texts`` (text); -1 where none is."""
    rows = texts.mapInArrow(_histograms, "c long, b long, seen long, null long").groupBy("c", "b").agg(F.sum("seen").alias("seen"), F.sum("null").alias("null")).collect()
    seen, null = np.zeros((len(LENGTHS), N_BINS)), np.zeros((len(LENGTHS), N_BINS))
    for r in rows:  # at most classes * bins
        seen[r["c"], r["b"]], null[r["c"], r["b"]] = r["seen"], r["null"]
    chance = (1 + np.cumsum(null, axis=1)) / (1 + null.sum(axis=1, keepdims=True))
    found = np.cumsum(seen, axis=1)
    good = (seen.sum(axis=1, keepdims=True) * chance <= rate * found) & (found > 0)
    return [int(np.flatnonzero(g)[-1]) if g.any() else -1 for g in good]


def spans_of(texts: list[str], last_bins: list[int]) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by start and then by kind."""
    found, tokens, where = [base_spans(x) for x in texts], [], []
    for i, x in enumerate(texts):
        for m in TOKEN.finditer(x):
            tokens.append(m[0])
            where.append((i, *m.span()))
    bins = bin_of(p_values(tokens)) if tokens else []
    base = [list(f) for f in found]
    for (i, a, b), token, k in zip(where, tokens, bins):
        if k <= last_bins[length_class(len(token))] and not any(s < b and a < e for _, s, e in base[i]):
            found[i].append(("random", a, b))
    return [sorted(f, key=lambda s: (s[1], KINDS.index(s[0]))) for f in found]


def _scan(last_bins: list[int]):
    def line(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                for spans in spans_of(batch.column(1).slice(at, 256).to_pylist(), last_bins):
                    base = [s for s in spans if s[0] != "random"]
                    rows.append((*(sum(s[0] == k for s in spans) for k in KINDS), hashlib.sha256(line(base).encode()).hexdigest(), line(spans)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return light.mapInArrow(_scan(thresholds(light.select("text"), rate)),
                            "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def query(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
