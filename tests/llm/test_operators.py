"""Operators against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from planwright.llm import chat, fingerprint, lm, mixing, neardup, packing, quality_knn, queries, rules, token_output, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, sequence_id string"


def make(seed=0, n=120):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "do", "Ki", "lu", "ÉR", "mo") for b in ("n", "r", "st", "ng", "t.", "x,")]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 6):  # near copies, exact copies
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts[(i + 1) % n] = " ".join(w)
        texts[(i + 2) % n] = texts[i]
    rows = [(i * 7, t, "en", f"s{i % 3}" if i % 10 else None, len(t), 0.5, "x") for i, t in enumerate(texts)]
    rows += [(100000, None, None, None, 0, None, None), (100001, "", "en", "s0", 0, None, None), (100002, " \n\t ", "de", "s1", 4, None, None), (100003, "word " * 30000, "en", "s2", 150000, None, None), (100004, "lone", "en", "s2", 4, None, None)]
    rows += [rows[3], rows[3], (None, "a text without an id", "en", "s1", 20, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return path, lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")


def test_token_output(docs, none, tokenizer):
    path, encode = tokenizer
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = encode(r["text"])
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_output.token_id_output(docs, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_output.token_id_output(none, path).count() == 0


def test_packing(docs, none, tokenizer):
    path, encode = tokenizer
    got = packing.pack_documents(docs, path, 64)
    rows = got.collect()
    texts = {(r["doc_id"], len(encode(r["text"]))): encode(r["text"]) for r in docs.collect()}
    seen, fill = Counter(), defaultdict(list)
    for r in rows:
        ids = texts[(r["doc_id"], r["doc_tokens"])]
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and 0 < r["length"] <= 64
        seen[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(seen.values()) == sum(len(encode(r["text"])) for r in docs.collect())
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(fill) == list(range(len(fill)))
    small = docs.filter("doc_id < 100").dropDuplicates(["doc_id"])
    pieces = packing.pack_documents(small, path, 64)
    whole = packing.sequence_ids(pieces, small, path).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(len(encode(r["text"])) for r in small.collect())
    assert packing.pack_documents(none, path).count() == 0


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "### x: </turn> \\</turn>"), (2, 0, "user", None), (2, 0, "user", None), (2, 1, "assistant", "tail\\"),
    (3, None, None, "no turn"), (3, 5, "a:b\\n\nc", "\n</turn>\n### user:\n"), (None, 1, "assistant", "no id"), (4, 1, "\\0", "x\r\n" * 2000), (5, 0, "assistant", "\\\\### deep"), (6, 0, "", ""),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "other") for r in CHATS], "conv_id long, turn long, role string, text string, rendered string").repartition(3)
    found = chat.format_chats(df)
    rows = {r["conv_id"]: r for r in chat.with_spans(found).collect()}
    assert all(r["identical"] for r in rows.values()) and len(rows) == 7
    for c, r in rows.items():
        turns = sorted([x for x in CHATS if x[0] == c], key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["parsed"]] == [(t[2], t[3] or "") for t in turns]
        for s in r["spans"]:
            part = r["rendered"][s["start"] : s["end"]]
            assert part in r["rendered"] and s["loss"] == (s["role"] == "assistant")
    assert rows[1]["escape_level"] == 1 and rows[6]["escape_level"] == 0
    d = {r["conv_id"]: r for r in chat.digest(found).collect()}
    assert d[1]["loss_sha256"] == hashlib.sha256(CHATS[1][3].encode()).hexdigest() and d[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n" + CHATS[1][3].encode() + b"\n").hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_roles_are_read_back(spark):
    roles = ["a\r\\", "\\n", "\\\\n", "\r\n", "\\", "\\\\", "\\0", "a\\\n", ":", "", "\n", "x\\\\\nn", None]
    rows = [(i, 0, x, "text") for i, x in enumerate(roles)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for i, x in enumerate(roles):
        assert got[i]["identical"] and got[i]["parsed"][0]["role"] == x


def test_quality_rules(spark, docs, none):
    got = rules.quality_rules(docs)
    rows = {(r["doc_id"], r["n_words"]): r for r in got.collect()}
    assert got.count() == docs.count()
    for r in docs.collect():
        w = WORD.findall(r["text"] or "")
        g = rows[(r["doc_id"], len(w))]
        c = Counter(zip(w, w[1:], w[2:]))
        repeats = len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}) if len(w) < 5000 else g["n_repeat_words"]
        assert (g["word_chars"], g["n_repeat_words"]) == (sum(map(len, w)), repeats)
        assert g["base_failed"] == (len(w) < 50 or 100 * repeats > 50 * len(w)) and not (g["base_failed"] and g["kept"])
    r = random.Random(1)
    clean = [(i, " ".join(r.choice("abcdefgh") * r.randint(2, 7) + str(r.randint(0, 999)) for _ in range(r.randint(60, 300))), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(f"W{r.randint(0, 9999)}###" for _ in range(100)), "en", "s") for i in range(30)]
    judged = {x["doc_id"]: x["kept"] for x in rules.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(judged[i] for i in range(300)) >= 298 and not any(judged[1000 + i] for i in range(30))
    kept = rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()
    assert rules.quality_rules(none).count() == 0 and rules.filter_documents(none).count() == 0


def brute_mcd(x, share):
    """Centre and covariance (with the floor) of the smallest determinant over many random starts."""
    r, h, floor = np.random.default_rng(0), math.ceil(share * len(x)), np.diag(np.square(rules.FLOOR))
    best = (math.inf,)
    for _ in range(60):
        near = r.choice(len(x), h, replace=False) if _ % 2 else r.choice(len(x), 12, replace=False)
        last = math.inf
        while True:
            mean, cov = x[near].mean(0), np.cov(x[near].T, bias=True) * rules.consistency() + floor
            det = np.linalg.slogdet(cov)[1]
            if len(near) == h and det >= last - 1e-9:
                break
            last = det if len(near) == h else math.inf
            near = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean), kind="stable")[:h]
        best = min(best, (last, mean.tolist(), cov.tolist()))
    return best[0], np.array(best[1]), np.array(best[2])


def test_minimum_covariance_determinant(spark):
    """Distances and verdicts of two groups with a fifth of planted outliers, against many starts row by row."""
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for i in range(500):
        odd = i % 5 == 0
        words = [(word(r.randint(6, 9)).upper() + "#" * r.randint(1, 3)) if odd and r.random() < 0.9 else word(r.randint(2, 9)) for _ in range(r.randint(60, 400))]
        rows.append((i, " ".join(words), "en", "a" if i < 300 else "b", odd))
    got = {x["doc_id"]: x for x in rules.judge(rules.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, odd boolean"))).collect()}
    for source in "ab":
        mine = [x for x in rows if x[3] == source]
        n = np.array([rules.count(x[1]) for x in mine], float)
        words, chars, symbols, dups, repeats, lines, upper = n.T
        x = np.stack([np.log(words), np.minimum(chars / words, 64), np.sqrt(symbols / words), dups / lines, repeats / words, upper / words], 1)
        _, mean, cov = brute_mcd(x, rules.SHARE)
        want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        have = np.array([got[d[0]]["distance"] for d in mine])
        assert np.abs(have / want - 1).max() < 0.05
        assert [got[d[0]]["kept"] for d in mine] == (want <= rules.cutoff()).tolist() == [not d[4] for d in mine]


def test_chi_square():
    assert rules.quantile(0.975) == pytest.approx(14.449, abs=1e-3) and rules.quantile(0.999) == pytest.approx(22.458, abs=1e-3)
    x = np.random.default_rng(1).normal(size=(200_000, rules.P))
    near = x[np.argsort(np.square(x).sum(1))[: int(rules.SHARE * len(x))]]
    assert rules.consistency() * near.var() == pytest.approx(1, abs=0.01)


def test_quality_rules_tell_rows_of_one_id_apart(spark):
    r = random.Random(3)
    clean = [" ".join(f"{a}{b}" for a, b in ((r.choice("abcdefgh") * r.randint(2, 7), r.randint(0, 999)) for _ in range(100))) for _ in range(80)]
    repeated = " ".join(["one two three four"] * 25)  # as many words, in repeated windows
    junk = " ".join(f"W{r.randint(0, 9999)}###" for _ in range(100))
    rows = [(None, t, "en", "s") for t in clean] + [(None, t, "en", "s") for t in (repeated, junk)] + [(7, t, "en", "s") for t in (clean[0], repeated, junk)]
    kept = rules.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()
    assert not {repeated, junk} & {x["text"] for x in kept}
    assert [x["text"] for x in kept if x["doc_id"] == 7] == [clean[0]] and len(kept) >= 79


def brute_groups(rows, width, percent):
    sets = {}
    for i, t in enumerate(rows):
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, none, width):
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    sets, group = brute_groups([r["text"] for r in rows], width, 80)
    least = defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        least[g].append(r["doc_id"])
    got = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(docs, width).collect()}
    for i, (r, g) in enumerate(zip(rows, group, strict=True)):
        x = got[(r["doc_id"], len(sets[i]))]
        want = min(least[g]) if sets[i] else r["doc_id"]
        assert (x["component_id"], x["kept"]) == (want, want == r["doc_id"])
    kept = neardup.filter_documents(docs, width)
    assert kept.columns == docs.columns
    empties = sum(1 for s in sets.values() if not s)
    groups = len({g for i, g in enumerate(group) if sets[i]}) + 1  # and the one without an id
    assert kept.count() == groups + empties
    assert neardup.near_duplicates(none).count() == 0 and neardup.filter_documents(none).count() == 0


@pytest.mark.parametrize("percent", [30, 50, 60, 70])
def test_near_duplicates_of_less_likeness(spark, percent):
    r = random.Random(percent)
    rows = []
    for i in range(40):  # a pair each, at the likeness asked for or a little above
        n = 200
        same = math.ceil(2 * n * percent / (100 + percent)) + r.randint(0, 2)
        rows += [" ".join([f"{i}x{j}" for j in range(same)] + [f"{i}{side}{j}" for j in range(n - same)]) for side in "yz"]
    _, group = brute_groups(rows, 1, percent)
    assert len(set(group)) == 40
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df, 1, percent).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_bands_and_sketches_fit_the_likeness():
    assert (neardup.band_rows(80), neardup.sketch_least(80)) == (neardup.band_rows(95), neardup.sketch_least(95)) == (5, 0.63)
    assert neardup.band_rows(50) == 2 and neardup.sketch_least(60) < 0.4
    with pytest.raises(ValueError):
        neardup.band_rows(2)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in r.sample(range(120), r.choice([2, 5, 8])):
            w[k] = f"z{r.randint(0, 10**6)}"
        rows.append(" ".join(w))
    _, group = brute_groups(rows, 2, 80)
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 2).collect()}
    want = defaultdict(list)
    for i, g in enumerate(group):
        want[g].append(i)
    assert all(got[i] == min(ids) for ids in want.values() for i in ids) and len(want) > 1


@pytest.mark.parametrize("at_once", [0, 1_000_000])
def test_near_dedup_tells_rows_of_one_id_apart(spark, monkeypatch, at_once):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", at_once)
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    near = lambda k: text(k) + " more"
    rows = [
        (None, text("a"), 1), (None, text("b"), 2), (None, text("b"), 3), (None, None, 4), (None, " ", 5),  # two texts, one of them twice
        (None, near("c"), 6), (1, text("c"), 7),  # a null-id near copy takes no other null-id row along
        (2, text("d"), 8), (2, text("e"), 9), (3, text("e"), 10), (0, near("d"), 11),  # one id with two texts, one of them a copy
        (5, text("f"), 12), (5, near("f"), 13), (5, text("g"), 14),  # a group under one id
    ]
    kept = neardup.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3))
    assert kept.columns == ["doc_id", "text", "row"]
    found = sorted(r["row"] for r in kept.collect())
    assert len(found) == len(set(found)) == 9
    assert {1, 4, 5, 7, 9, 11, 14} < set(found) and len({2, 3} & set(found)) == 1 and len({12, 13} & set(found)) == 1
    assert not {6, 8, 10} & set(found)


@pytest.mark.parametrize("at_once", [0, 1_000_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", at_once)
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix_report(docs)
    got = rows.collect()
    assert len(got) == docs.count() and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()), key=str)
    size = defaultdict(int)
    by_source = {}
    for r in docs.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
        by_source[r["doc_id"]] = r["source"]
    want = mixing.targets(list(size.items()))
    taken = defaultdict(int)
    for r in got:
        s = by_source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 130) or s == "s2"  # s2 holds one document of 30,000 words
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0
    small = mixing.copies(docs, chunk=7)
    assert small.agg({"copies": "max"}).first()[0] <= 3


def test_fingerprints(docs, none):
    rows = docs.dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.edited_report(rows).collect()}
    order = sorted(rows.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    sets = lambda t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if (w) else set()) if (w := t.lower().split()) else set()
    errors = []
    for i, r in enumerate(order):
        t, nxt = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = sets(t), sets(edited)
        errors.append(g["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02
    assert got[100001]["fingerprint"] == "" and got[100000]["near_edited"] in (0.0, 1.0)
    f = {(r["doc_id"], r["fingerprint"]) for r in fingerprint.fingerprints(docs).collect()}
    assert len({x for d, x in f if d == 21}) == 1
    assert fingerprint.edited_report(none).count() == 0
    plan = fingerprint.edited_report(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprint_bins_by_hand(spark):
    """One text's digits, computed step by step with another implementation of the hash."""
    import xxhash

    def h64(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else int(v).to_bytes(8, "little", signed=True) if isinstance(v, int) else v, seed)
        return seed

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    text = "The quick brown fox jumps over the lazy dog again and again"
    words = [signed(h64([w.lower().encode()])) for w in text.split()]
    shingles = [h64(words[i : i + 5]) >> 1 for i in range(len(words) - 4)]
    least: dict[int, int] = {}
    for s in shingles:
        least[s >> 55] = min(s, least.get(s >> 55, s))
    got = fingerprint.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["fingerprint"]
    int32 = lambda b: xxhash.xxh64_intdigest(int(b).to_bytes(4, "little"), 42)
    for b, v in least.items():  # filled bins: the low bits of the value hashed with its bin
        first = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), 42)
        assert int(got[b], 16) == xxhash.xxh64_intdigest(int(b).to_bytes(4, "little"), first) & 15
    assert int32(1) != int32(2) and len(got) == 256


def test_katz(docs, none):
    folds, held = 7, 2
    tokens, is_held = [], []
    for r in docs.collect():
        d = "null" if r["doc_id"] is None else str(r["doc_id"])
        tokens.append((r["doc_id"], WORD.findall((r["text"] or "").translate(LOWER)) + ["</s> "]))
        is_held.append(zlib.crc32(d.encode()) % folds == held)
    c, b = Counter(), Counter()
    for (_, t), h in zip(tokens, is_held, strict=True):
        if not h:
            c.update(t)
            b.update(zip(["<s> ", *t[:-1]], t))
    n, v = sum(c.values()), len(c)
    counts = lambda x: [0, *(sum(1 for y in x.values() if y == r) for r in range(1, lm.K + 2))]
    e = lm.Estimates({lm.WORD_STATS: {"tokens": n, "types": v, "of_counts": counts(c)}, lm.PAIR_STATS: {"tokens": n, "types": len(b), "of_counts": counts(b)}})
    p1 = lambda w: float(e.word(np.array([c[w]]))[0])
    mass = lambda r: float(e.pair_mass(np.array([r]))[0])
    context, took, gave = Counter(), defaultdict(float), defaultdict(float)
    for (h, w), r in b.items():
        context[h] += r
        took[h] += p1(w)
        gave[h] += r - mass(r)
    weight = {h: gave[h] / context[h] / (1 - took[h]) for h in context}
    for h in list(context)[:30]:  # each context sums to one, the unknown word with it
        total = sum(mass(b[h, w]) / context[h] if b[h, w] else weight[h] * p1(w) for w in c) + weight[h] * e.unknown
        assert total == pytest.approx(1, abs=1e-9)
    got = defaultdict(list)
    for r in lm.katz_scores(docs).collect():
        got[r["doc_id"]].append(r)
    for (d, t), h in zip(tokens, is_held, strict=True):
        score = sum(math.log10(mass(b[x]) / context[x[0]]) if b[x] else math.log10(p1(x[1])) + (math.log10(weight[x[0]]) if context[x[0]] else 0) for x in zip(["<s> ", *t[:-1]], t))
        r = next(r for r in got[d] if r["n_tokens"] == len(t))
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (h, sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    assert lm.katz_scores(none).count() == 0


@pytest.mark.parametrize("order", [1, 3, 4])
def test_katz_recurses(docs, none, order):
    tokens = [(r["doc_id"], WORD.findall((r["text"] or "").translate(LOWER)) + ["</s> "]) for r in docs.collect()]
    grams = lambda t, k: zip(*(["<s> "] * (k - 1 - i) + t for i in range(k)))
    counts = [Counter() for _ in range(order)]
    for d, t in tokens:
        if zlib.crc32(("null" if d is None else str(d)).encode()) % 7 != 2:
            for k in range(order):
                counts[k].update(grams(t, k + 1))
    n = sum(counts[0].values())
    of = lambda x: [0, *(sum(1 for y in x.values() if y == r) for r in range(1, lm.K + 2))]
    e = lm.Estimates({lm.STATS + k: {"tokens": n, "types": len(c), "of_counts": of(c)} for k, c in enumerate(counts)})
    context, after = Counter(), defaultdict(list)
    for c in counts[1:]:
        for g, r in c.items():
            context[g[:-1]] += r
            after[g[:-1]].append(g[-1])
    mass = lambda g: float(e.mass(np.array([counts[len(g) - 1][g]]), len(g) - 1)[0])
    weights = {}

    def weight(h):
        if h not in weights:
            gave = sum(counts[len(h)][(*h, w)] - mass((*h, w)) for w in after[h])
            weights[h] = gave / context[h] / (1 - sum(p((*h[1:], w)) for w in after[h]))
        return weights[h]

    def p(g):
        if len(g) == 1:
            return float(e.word(np.array([counts[0][g]]))[0])
        if counts[len(g) - 1][g]:
            return mass(g) / context[g[:-1]]
        return p(g[1:]) * (weight(g[:-1]) if context[g[:-1]] else 1.0)

    for h in [h for h in context if len(h) == order - 1][:10]:
        assert sum(p((*h, w)) for (w,) in counts[0]) + p((*h, "never seen")) == pytest.approx(1, abs=1e-9)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.katz_scores(docs, order=order).collect()}
    for d, t in tokens:
        assert got[d, len(t)] == pytest.approx(sum(math.log10(p(g)) for g in grams(t, order)), rel=1e-7)
    assert lm.katz_scores(none, order=order).count() == 0


def test_katz_lets_go_of_what_each_round_has_used(spark, monkeypatch, tmp_path):
    docs = spark.range(0, 40, 1, 4).selectExpr("id as doc_id", "concat('a b c a b d', id % 3, ' e f', id) as text")  # four chunks
    want = sorted(map(tuple, lm.katz_scores(docs, order=3).collect()))
    stage, held = lm.common.stage, []
    parts = lambda folder: len(list(tmp_path.glob(f"planwright/{folder}")))

    def watched(df, name, *by):
        held.append((name, parts("lm-chunks-*/*=*"), parts("lm-tables-*/kind=[012]/*=*"), parts("lm-partial-*/*=*")))
        return stage(df, name, *by)

    monkeypatch.setattr(lm.common, "stage", watched)
    monkeypatch.setattr(lm.common, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = sorted(map(tuple, lm.katz_scores(docs, order=3).collect()))
    assert got == want and len(got) == 40
    assert sum(name == "lm-tables" for name, *_ in held) == 3  # the longest grams in two turns
    at = [(chunks, answers, partial) for name, chunks, answers, partial in held if name in ("lm-partial", "lm-weighed")]
    assert [x[0] for x in at] == [4, 3, 2, 1, 0, 0, 0, 0]
    assert [x[1] for x in at] == [16, 12, 8, 4, 0, 0, 0, 0]  # three levels, the longest twice
    assert [x[2] for x in at] == [0, 4, 8, 12, 16, 12, 8, 4]


def test_katz_query_counts_three_words(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(queries.common, "read", lambda *_: None)
    monkeypatch.setattr(queries.lm, "katz_scores", lambda docs, **options: asked.update(options))
    queries.op4_katz(spark, "")
    assert asked == {"order": 3}


def auc(y, p):
    rank = np.argsort(np.argsort(p))
    one = y == 1
    return (rank[one].sum() - one.sum() * (one.sum() - 1) / 2) / (one.sum() * (~one).sum())


@pytest.mark.parametrize("operator,label", [(toxicity, "toxic"), (quality_knn, "quality")])
def test_held_out_accuracy(spark, operator, label):
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no sample data")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = operator.held_out_score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(got[label].to_numpy(), got["score"].to_numpy()) > 0.8
    assert got["score"].between(0, 1).all()


@pytest.mark.parametrize("operator", [toxicity, quality_knn])
def test_classifiers_on_odd_tables(spark, docs, none, operator):
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, 1), (14, None, None), (999999, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        rows = operator.held_out_score(docs, table).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert operator.held_out_score(none, labels).count() == 0


def test_pipeline(spark):
    import os

    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no sample data")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "MinHash near-dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    _, stage = corpus_pipeline.STAGES[0]
    kept = stage(spark, docs, d)
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_queries_are_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
