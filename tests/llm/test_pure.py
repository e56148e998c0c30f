"""What needs no Spark: codes, packing, rounding, hashing, learning."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from planwright.llm import common, encoding, lm, mixing, neardup, packing, quality_knn, rules, simple8b, token_output, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n", [0, 1, 5, 127, 128, 129, 1000, 20000])
def test_simple8b(n):
    r = np.random.default_rng(n)
    for high in (1, 2, 50257, 2**31, 2**59):
        v = r.integers(0, high, n).astype(np.uint64)
        assert (simple8b.decode(*simple8b.encode(v), n) == v).all()
    v = r.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1)
    v[::3] = 5
    v[::7] = 0  # escapes among small values; a raw word may look like any selector
    assert (simple8b.decode(*simple8b.encode(v), n) == v).all()


def test_segments():
    ids = [np.array(x, "<u4") for x in ([0], [5, 0], [70000, 3, 0])]
    docs, lengths, flat = token_output.unpack_segment(token_output.pack_segment([1, None, -3], ids))
    assert docs == [1, None, -3] and lengths.tolist() == [1, 2, 3] and flat.tolist() == [0, 5, 0, 70000, 3, 0]
    with pytest.raises(ValueError):
        token_output.unpack_segment(b"x" * 40)


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    e = encoding.Encoder(encoding.definition(path))
    r = random.Random(1)
    bits = ["a", "b", "foo", "The", "'s", "'re", "1", "²", "é", "中", "😀", ".", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u2003", "\x1c", "\x85", ",", "...", "!", "#", "\r\n", "_", "ª", "<|endoftext|>", "3.14", "x.,", "\x01", "\x01.", "Ω", "ö", "foo.bar", ")."]
    texts = ["", " ", "\n", *("".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(4000))]
    for t, ids in zip(texts, e(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_slices():
    t = pa.array(["a" * n for n in (5, 50, 5, 0, 500)], pa.string())
    assert [x for a, b in encoding.slices(t, 40) for x in range(a, b)] == list(range(5))
    assert list(encoding.slices(pa.array([], pa.string()))) == []


def test_shortest_pack_first():
    r = random.Random(2)
    h = {n: r.randint(0, 50) for n in range(1, 65)}
    patterns = packing.shortest_pack_first(h, 64)
    used: dict[int, int] = {}
    for count, pack in patterns:
        assert sum(pack) <= 64
        for n in pack:
            used[n] = used.get(n, 0) + count
    assert used == {k: v for k, v in h.items() if v}
    total = sum(k * v for k, v in h.items())
    assert total / (64 * sum(c for c, _ in patterns)) > 0.95


def test_targets():
    t = mixing.targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)])
    assert t["c"] == 0 and t["a"] == 30  # capped at three times its size
    assert abs(sum(t.values()) - 1110) < 1e-6 and all(t[k] <= 3 * n + 1e-9 for k, n in (("b", 100), (None, 1000)))


@pytest.mark.parametrize("p", [0.02, 0.39, 0.5, 0.97])
def test_pivoting_keeps_words(p):
    r = random.Random(3)
    sizes = [r.randint(1, 30) for _ in range(300)] + [900]
    rows = [(i, s, p) for i, s in enumerate(sizes)]
    out = mixing.reduce_chunk(rows, 1, 0.01 * p * sum(sizes))
    assert set(out) <= {0.0, 1.0}
    assert abs(sum(s for s, x in zip(sizes, out) if x) - p * sum(sizes)) < 30
    half = mixing.reduce_chunk(rows, 1, None)
    assert sum(0 < x < 1 for x in half) <= 1 and abs(sum(s * x for s, x in zip(sizes, half)) - p * sum(sizes)) < 1e-6
    assert half == mixing.reduce_chunk(rows, 1, None)


@pytest.mark.parametrize("p", [0.3, 0.75])
def test_pivoting_keeps_every_documents_odds(p):
    """Each document of any size is taken as often as its share says: two levels of a tree, 1,500 seeds."""
    r = random.Random(8)
    sizes = [r.choice((1, 2, 3, 8, 20, 50, 120, 400)) + r.randint(0, 9) for _ in range(60)]
    n, words = 1500, []
    taken = np.zeros(len(sizes))
    for seed in range(n):
        out = {}
        for half in (range(0, 30), range(30, 60)):
            out |= dict(zip(half, mixing.reduce_chunk([(i, sizes[i], p) for i in half], seed, None), strict=True))
        left = [i for i, x in out.items() if 0 < x < 1]
        out |= dict(zip(left, mixing.reduce_chunk([(i, sizes[i], out[i]) for i in left], seed + n, 1e9), strict=True))
        taken += np.array([out[i] for i in range(60)])
        words.append(sum(sizes[i] * out[i] for i in range(60)))
    off = (taken / n - p) / np.sqrt(p * (1 - p) / n)
    assert np.abs(off).max() < 4 and abs(off.mean()) < 0.5
    assert np.abs(np.array(words) - p * sum(sizes)).mean() < 0.03 * sum(sizes)


def brute_repeats(words):
    from collections import Counter

    c = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i in range(len(words) - 2) if c[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_repeated_words():
    r = random.Random(4)
    for n in (0, 1, 2, 3, 4, 50, 400):
        for letters in ("ab", "abcdefgh"):
            w = [r.choice(letters) for _ in range(n)]
            assert rules.repeated_words(w) == brute_repeats(w)


def test_counts_of_a_text():
    assert rules.count("")[:5] == (0, 0, 0, 0, 0)
    n, chars, symbols, dups, repeats, lines, upper = rules.count("A b#\n \nA b#\n\xa0x\nA b#")
    assert (n, chars, symbols, dups, lines) == (7, 11, 3, 2, 4)
    assert repeats == brute_repeats(["A", "b#", "A", "b#", "\xa0x", "A", "b#"])


def test_minmax_estimates_likeness():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    errors = []
    for share in (0.2, 0.5, 0.8):
        other = np.concatenate([base[: int(1000 * 2 * share / (1 + share))], r.integers(0, 1 << 63, 1000 - int(1000 * 2 * share / (1 + share))).astype(np.uint64)])
        j = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        errors.append((neardup.signature(base) == neardup.signature(other)).mean() - j)
    assert np.abs(errors).max() < 0.12


def test_shingles():
    f = neardup.Shingler(2)
    assert len(f("")) == 0 and len(f("one")) == 1 and (f("One\tTWO three") == f(" one two  three ")).all()
    assert len(f("a b a b")) == 2 and len(neardup.Shingler(5)("a b c")) == 1
    assert not np.array_equal(f("a b"), f("b a"))
    assert len(f("x\xa0y z")) == 1  # a no-break space is part of a word


def test_packed_arrays():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    some = np.random.default_rng(2).random(70_000)
    again = [np.tile([0.1, -3.0, 1e300], 50), np.concatenate([some, some]), np.concatenate([some, -some, some])]  # by number, and above 2 ** 16
    arrays = [keys, np.arange(10, dtype="<u4"), np.empty(0, "<u8"), np.array([1.5, -2.0]), np.empty(0), *again, keys]
    for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True):
        assert len(a) == len(b) and (a == b).all() and a.dtype == b.dtype
    places = np.array([0, 0, 3, 9, lm.START_PLACE])
    assert (np.cumsum(lm.steps(places), dtype="u4") == places).all()


def test_discounts():
    d = lm.discounts([0, 1000, 350, 200, 130, 95, 60])
    assert all(0 < x <= 1 for x in d[1:]) and d[1] < d[3]
    assert (lm.discounts([0] * 7) == 1).all()


def brute_toxicity(m, text):
    """The same score, term by term and pair by pair."""
    at = {int(b): i for i, b in enumerate(m.buckets)}
    words = {t for w in set(text.lower().split()) if (t := toxicity.terms(w))}
    columns = [[at[b] for b in t if b in at] for t in words]
    raw = m.bias + sum(m.w[i] for c in columns for i in c)
    for x in range(len(columns)):
        for y in range(x):
            raw += sum(float(m.v[i] @ m.v[j]) for i in columns[x] for j in columns[y])
    return 1 / (1 + np.exp(-raw))


def paired_texts(n, fillers=30):
    """Neither word alone is toxic (1), both are, and neither is: weights that add up cannot tell."""
    r = random.Random(6)
    texts, y = [], []
    for _ in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join(["w%d" % r.randint(0, fillers) for _ in range(5)] + ["insultword"] * a + ["groupname"] * b))
        y.append(float(a == b))
    return texts, np.array(y)


def test_factorization_learns_pairs():
    texts, y = paired_texts(1500)
    f = toxicity.Featurizer()
    rows = [f(t) for t in texts]
    m = toxicity.train(rows, y, np.ones(len(y)))
    probes = ["w1 insultword groupname", "w1 insultword", "w1 groupname", "", "Insultword, insultword! GROUPNAME w7 w8 w9 x"]
    got = toxicity.Scorer(m)(probes)
    assert got[0] > 0.5 > got[1] and got[2] < 0.5
    assert np.allclose(got, [brute_toxicity(m, t) for t in probes])
    again = toxicity.Scorer(m)
    assert np.allclose([again([t])[0] for t in probes], got)  # words met one by one
    flat = toxicity.train(rows, y, np.ones(len(y)), factors=False)
    right = lambda m: ((toxicity.Scorer(m)(texts) >= 0.5) == (y > 0.5)).mean()
    assert right(m) > 0.95 and right(flat) < 0.7
    empty = toxicity.train([], np.array([]), np.array([]))
    assert toxicity.Scorer(empty)(["", "a b"]).tolist() == [0.5, 0.5]


def test_scorer_holds_the_words_of_few_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN", 10_000, raising=False)
    monkeypatch.setattr(toxicity, "AT_ONCE", 50_000, raising=False)
    m = toxicity.Machine(np.unique([toxicity.bucket(f"w{i}x7") for i in range(300)]), -1.0)
    m.w[:-1], texts = 0.5, [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(300)] + ["", "w0x7", "w1x7 " * 20_000]
    want = [toxicity.Scorer(m)([t])[0] for t in texts]
    scorer = toxicity.Scorer(m)
    tracemalloc.start()
    got = scorer(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want) and got[0] > got[300] and len(scorer([])) == 0
    assert peak < 20_000_000


def test_tasks_empty_the_stores_of_others():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    run = lambda batches: (len(encoding._ENCODERS) for _ in batches)
    encoding.encoder(encoding.definition(path))
    assert list(common.tidied(run, encoding.STORE)([0])) == [1]
    assert list(common.tidied(run)([0])) == [0]


def test_screen_keeps_what_tells_in_pairs(monkeypatch):
    """'groupname' says nothing by itself; beside 'insultword' it does."""
    r = random.Random(9)
    f = toxicity.Featurizer()
    rows, y = [], []
    for _ in range(3000):
        a, b = r.random() < 0.3, r.random() < 0.5
        rows.append(f(" ".join(["w%d" % r.randint(0, 300) for _ in range(5)] + ["insultword"] * a + ["groupname"] * b)))
        y.append(float(r.random() < (0.9 if a and b else 0.3 if b else 0.1 if a else 0.6)))
    y = np.array(y)
    monkeypatch.setattr(toxicity, "KEEP", 40)
    assert toxicity.bucket("groupname") in toxicity.train(rows, y, np.ones(len(y))).buckets


def test_neighbours():
    f = quality_knn.Terms()
    good = [" ".join(f"word{i}" for i in range(k, k + 30)) for k in range(40)]
    bad = [" ".join(f"WORD{i}!!" for i in range(k, k + 30)) for k in range(40)]
    v = quality_knn.Voters([f(t) for t in good + bad], np.array([1.0] * 40 + [0.0] * 40), np.ones(80), 0.5)
    s = v.score([f("word3 word4 word90"), f("WORD3!! WORD77!!"), f("")])
    assert s[0] > 0.9 and s[1] < 0.1 and s[2] == 0.5
    assert quality_knn.Voters([], np.array([]), np.array([]), 0.5).score([f("a")])[0] == 0.5
    assert quality_knn.shape("STOP!!") == "A!" and quality_knn.shape("Über...") == "Aa." and quality_knn.shape("x12") == "a9"


def test_fold_key():
    assert zlib.crc32(b"17") % 5 == zlib.crc32(str(17).encode()) % 5
