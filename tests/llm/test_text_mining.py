"""Collocations, substring dedup and spelling variants against brute force on small tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import collocations, spelling, substrings

CLASH = "doc_id long, text string, lang string, source string, word string, n long, phrase string, kept string, `a.b` int"
LONG = " ".join(f"w{i % 97} x{i % 31}" for i in range(15_000))


def _table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "clash", 1, "clash", "clash", 2) for i, t, lang in rows], CLASH).repartition(3)


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _removed(rows, window):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, hashlib.sha256((rows[k][1] or "").encode()).digest()))
    seen, out = set(), []
    for k in order:
        words = _words(rows[k][1])
        gone = set()
        for at in range(len(words) - window + 1):
            gram = tuple(words[at:at + window])
            if gram in seen:
                gone.update(range(at, at + window))
            seen.add(gram)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((rows[k][0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def _texts(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["a", "b", "c", "É", "dd", "ee"])
    passage = " ".join(rng.choice(vocabulary, 30))
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 50))) for _ in range(n)]
    for k in range(0, n, 3):
        texts[k] = f"u{k}  {texts[k]}\t{passage}\n\x1cv{k} {texts[(k * 7) % n]}"
    return texts


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 300, "chunk_bytes": 400, "sample": 1}])
def test_substring_dedup_against_brute_force(spark, sizes):
    texts = _texts(1)
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts)] + [(7, "other text of id seven a b c a b c a b c a b c"), (9, texts[9]), (9, texts[9])]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "a " * 700), (904, LONG), (905, LONG), (None, LONG), (906, "a b c"), (906, "a b c")]
    table = _table(spark, [(i, t, "en") for i, t in rows])
    found = substrings.judge(table, window=6, kept_text=True, **sizes).collect()
    want = _removed(rows, 6)
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found], key=key) == sorted([w[:4] for w in want], key=key)
    left = substrings.without_repeats(table, window=6, **sizes)
    assert left.columns == table.columns
    partial = Counter((i, kept) for i, n, gone, _, kept in want if 0 < gone < n)
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert all(got[x] for x in partial)
    stay = {(i, _sha(t)) for i, t in rows}
    assert left.count() == len(stay) - len({(i, _sha(t)) for (i, t) in rows if _words(t) and all(w[2] == w[1] for w in want if w[0] == i and w[1] == len(_words(t)) and w[1])})
    assert substrings.judge(table.where("false"), window=6).count() == 0


def _sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_substring_dedup_agrees_over_layouts(spark):
    table = _table(spark, [(k, t, "en") for k, t in enumerate(_texts(2, 40))])
    one = sorted(substrings.judge(table.coalesce(1), window=5).collect())
    assert one == sorted(substrings.judge(table.repartition(13), window=5, bucket_bytes=500, chunk_bytes=200).collect())


def test_equal_windows_meet_in_one_bucket():
    texts = [substrings._spaced(t) for t in _texts(3) if len(_words(t)) > 6]
    for split in (np.zeros(0, np.uint64), None):
        packer = substrings.Packer(6, np.zeros(0, np.uint64))
        if split is None:
            packer.split = np.unique(packer.pack(texts)[1][5])[::2]
        joined, (text, start, n, low, high, route) = packer.pack(texts)
        where, covered = {}, 0
        for t, s, c, a, b, r in zip(text, start, n, low, high, route):
            words = joined[a:b].split(b" ")
            assert len(words) == c + 5 and words == texts[t].split(b" ")[s:s + c + 5]
            for k in range(c):
                assert where.setdefault(tuple(words[k:k + 6]), r) == r
            covered += c
        assert covered == sum(len(t.split()) - 5 for t in texts)


def _collocations(rows, least, share, top):
    langs = {}
    for _, text, lang in rows:
        langs.setdefault(lang or "und", []).append(_lower(text))
    out = []
    for lang, texts in langs.items():
        f, n = Counter(), 0
        for piece in (p for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", t)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n += len(words)
            f.update(tuple(words[i:i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
        scored = []
        for phrase, a in f.items():
            m = len(phrase)
            if m < 2 or a < least:
                continue
            longer = (f[x] for x in f if len(x) > m and f[x] >= least and any(x[i:i + m] == phrase for i in range(len(x) - m + 1)))
            if any(100 * b >= share * a for b in longer):
                continue
            score, _, left, right = min((2000000 * a // (f[phrase[:k]] + f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, m))
            scored.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 400, "held": 50, "burst": 3, "sample": 1}])
def test_collocations_against_brute_force(spark, sizes, monkeypatch):
    if sizes:  # texts are counted in parts of a few words
        monkeypatch.setattr(collocations, "WORDS", 7)
    rng = np.random.default_rng(4)
    vocabulary = np.array(["the", "Of", "é", "\x1c", "a|b", "x"])
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 60))), ["en", "de", None][k % 3]) for k in range(80)]
    rows = [(i, t.replace("x", rng.choice(["x", ".", "y\tz", "q\x0bw", ";;", "ho ho ho ho"])), g) for i, t, g in rows]
    rows += [(1, rows[1][1], rows[1][2])] * 3 + [(None, None, "en"), (None, "", "fr"), (5, "the of the of the of", "und"), (6, LONG, "long")]
    found = collocations.mine(_table(spark, rows), least=4, top=25, **sizes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == _collocations(rows, 4, 80, 25)
    assert collocations.mine(_table(spark, rows).where("false")).count() == 0


def test_hat_trie_counts_through_bursts_and_spills():
    rng = np.random.default_rng(5)
    trie, want = collocations.HatTrie(burst=4), Counter()
    for _ in range(5):
        first = rng.integers(1, 4, 300)
        rest = rng.integers(0, 3, 300) << 42 | rng.integers(0, 3, 300) << 21 | rng.integers(0, 3, 300)
        trie.add(first, rest)
        want.update(zip(first.tolist(), rest.tolist()))
    assert trie.size == len(want) and any(type(c) is dict for c in trie.root.values())
    got = Counter()
    while trie.size:
        a, b, n = trie.take(trie.largest(5))
        got.update(dict(zip(zip(a.tolist(), b.tolist()), n.tolist())))
    assert got == want and not trie.root


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long").selectExpr(
        "(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0))) AS s").first()
    assert row.s == big * 2000000 // (2 * big + 3)


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def _spelling(rows, letters, least, slips):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_spelling_variants_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = ["bananas", "Ünïversal", "aaaaaaa", "abababab", "collect", "straße"]
    words = []
    for w in base:
        words += [w] * 150
        for k in range(12):
            at, c = rng.integers(0, len(w) + 1), chr(rng.choice([97, 98, 0xE9, 0xFF]))
            one = [w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]][k % 3]
            words += [one] * int(rng.integers(1, 40)) + [one[:-1] + "zz"] * int(rng.integers(1, 4)) + [one + "s"] * 3
    rng.shuffle(words)
    rows = [(k if k % 4 else None, ["  ", " 1", "-", "."][k % 4].join(words[k * 17:(k + 1) * 17]), "en") for k in range(len(words) // 17)]
    rows += [(1, None, "en"), (2, "", "en"), (3, "b" * 30_000, "en"), (3, "b" * 30_000, "en"), (4, LONG, "en"), rows[5], rows[5]]
    for slips in (199, 3):
        found = spelling.group(_table(spark, rows), letters=5, least=2, slips=slips)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == _spelling(rows, 5, 2, slips)
    assert spelling.group(_table(spark, rows).where("false")).count() == 0


def test_pivots_are_the_lightest_disjoint_pair():
    rng = np.random.default_rng(7)
    for _ in range(300):
        places = sorted(rng.choice(12, rng.integers(3, 8), replace=False).tolist())
        weighed = [(p, int(rng.integers(1, 9))) for p in places]
        best = min(a[1] + b[1] for a, b in itertools.combinations(weighed, 2) if b[0] - a[0] > 1)
        chosen = spelling.pivots_of(weighed)
        assert len(chosen) == 2 and chosen[1] - chosen[0] > 1 and sum(dict(weighed)[p] for p in chosen) == best


def test_few_rows_are_broadcast_and_many_are_not(spark):
    from tidecast.llm import common

    df = spark.range(10).select(F.col("id").alias("k"))
    small, large = (spark.range(5).join(common.few(df, n), F.col("id") == F.col("k")) for n in (10, 9))
    assert "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
