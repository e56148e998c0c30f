"""Language-model scoring by Katz backoff over words.

Counts of words, of word pairs and so on up to ``order`` words are Good-Turing discounted; what a context's
grams give up goes to the words not seen after it, in proportion to their probability after the context
less its first word, by a weight that makes each context's probabilities sum to one exactly.

The corpus is turned once into chunks (word numbers of whole documents, a local vocabulary of 64-bit word
hashes).  Chunks ask hash-partitioned tables for totals: sorted hashes with local counts go out, packed
by partition, and totals come back in the same order.  A second exchange by context sums what each
distinct gram contributes, sets the backoff weight there and adds it up for the tokens that need it.  No
table is ever held whole; a frequent word costs one entry a chunk.

Tokens: words, A-Z lower-cased, then one end.  A gram's context is the words before; a text is preceded by
starts.

Nulls: a null text is empty (its end alone).  A null doc_id counts as the text 'null' for the fold.
Repeated rows are counted and scored each.  Other columns are ignored.  An empty table gives no rows; with
nothing to learn from, every token is unknown and has probability one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encoding
from .neardup import mix

U = np.uint64
START, END = U(0x51A27), U(0xE2D)  # hashes that stand for no word (a word's are mixed)
#: Counts up to K are discounted by Good-Turing; greater ones give up KEEP_BACK each, so that every
#: context has something for words not seen after it.
K, KEEP_BACK = 5, 0.01
CHUNK_TOKENS = 1_500_000
GROUP_TOKENS = 1_500_000
#: Chunks are evaluated, and contexts weighed, in so many rounds, for the shuffles of one at a time to stand; what
#: a round has used goes when it ends.  The longest grams are asked for in so many turns, some parts in each.
ROUNDS, TURNS = 4, 2
LOG10 = np.log(10.0)


def _planes(a: np.ndarray, kind: str) -> bytes:
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return kind.encode().ljust(4) + len(a).to_bytes(8, "little") + planes.tobytes()


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as bytes, byte planes apart; ascending 64-bit keys as differences, doubles that recur as numbers of distinct ones."""
    import zstandard

    parts = []
    for a in arrays:
        kind = a.dtype.str[1:]
        if kind == "u8" and len(a):
            a = np.concatenate([a[:1], np.diff(a)])
        if kind == "f8" and len(a):
            values, of = np.unique(a.view("<u8"), return_inverse=True)
            if 5 * len(values) <= 4 * len(a):
                parts += [_planes(np.diff(values, prepend=U(0)), "d8"), _planes(of.astype("<u2" if len(values) <= 1 << 16 else "<u4"), "n")]
                continue
        parts.append(_planes(a, kind))
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out, values = zstandard.ZstdDecompressor().decompress(data), 0, [], None
    while at < len(raw):
        kind, n = raw[at : at + 4].decode().strip(), int.from_bytes(raw[at + 4 : at + 12], "little")
        if kind == "n":
            kind = "u2" if len(values) <= 1 << 16 else "u4"
        width = int(kind[1:])
        planes = np.frombuffer(raw, np.uint8, n * width, at + 12).reshape(width, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view("<" + kind.replace("d", "u"))
        at += 12 + n * width
        if kind == "d8":
            values = np.cumsum(a, dtype=U).view("<f8")
        elif values is not None:  # the numbers behind their doubles
            out.append(values[a])
            values = None
        else:
            out.append(np.cumsum(a, dtype=U) if kind == "u8" else a)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds of each text's)."""
    import xxhash

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = parts.offsets.to_numpy().astype(np.int64)
    values = parts.flatten()
    bounds = bounds - bounds[0]
    coded = values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = mix(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U, len(words)))
    codes = coded.indices.to_numpy()
    full = np.array([w != "" for w in words], bool)[codes] if words else np.empty(0, bool)
    return hashes[codes][full], np.concatenate([[0], np.cumsum(full)])[bounds]


CHUNKS = "chunk long, n_tokens long, payload binary"


def chunks(docs: DataFrame) -> DataFrame:
    """Whole documents as word numbers: doc ids, lengths, vocabulary, its counts, each token's rank by them."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        tokens: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, size
            words, n = np.concatenate(tokens), np.concatenate(lengths) + 1
            all_ = np.full(int(n.sum()), END, U)
            word = np.ones(len(all_), bool)
            word[np.cumsum(n) - 1] = False
            all_[word] = words
            vocabulary, numbers, counts = np.unique(all_, return_inverse=True, return_counts=True)
            rank = np.empty(len(counts), "<u4")  # words are numbered by frequency: small numbers compress
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
            payload = pack(np.array([d or 0 for d in ids], "<i8"), np.array([d is None for d in ids], "u1"), n.astype("<u4"), vocabulary, counts.astype("<u4"), rank[numbers], level=3)
            row = pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([len(all_)], pa.int64()), pa.array([payload], pa.binary())], ["chunk", "n_tokens", "payload"])
            ids.clear(), tokens.clear(), lengths.clear()
            seq, size = seq + 1, 0
            return row

        for b in batches:
            if not b.num_rows:
                continue
            for i, j in encoding.slices(b.column(1), 6_000_000):
                h, bounds = word_hashes(b.column(1).slice(i, j - i))
                ids.extend(b.column(0).slice(i, j - i).to_pylist())
                tokens.append(h)
                lengths.append(np.diff(bounds))
                size += len(h)
                if size >= CHUNK_TOKENS:
                    yield close()
        if ids:
            yield close()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"))
    return rows.mapInArrow(common.tidied(run), CHUNKS)


class Chunk:
    """A chunk's documents and its grams of one word up to ``order``, in the order in which tables are asked.

    By level (0 for words): ``keys`` of the distinct grams, ``of`` (each token's gram); above words also
    ``context`` and ``at`` (each gram's context and a token where it stands) and ``hashes`` of the contexts,
    which are the grams of the level below and then the start.
    """

    def __init__(self, payload: bytes, learn, order: int = 2):
        import zlib

        ids, null, self.n, vocabulary, counts, ranks = unpack(payload)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.learn = np.fromiter((learn(zlib.crc32(("null" if d is None else str(d)).encode())) for d in self.doc_ids), bool, len(ids))
        word = np.argsort(-counts.astype(np.int64), kind="stable").astype(np.int32)[ranks]
        del ranks
        self.starts = np.cumsum(self.n, dtype=np.int64) - self.n
        self.taught = np.repeat(self.learn, self.n)
        self.keys, self.of, self.context, self.at, self.hashes = [vocabulary], [word], [None], [None], [None]
        start, words = np.array([START]), mix(vocabulary)
        for level in range(1, order):
            hashes = np.append(self.keys[-1], start)
            context = self.before(self.of[-1], len(self.keys[-1]))
            keys, of = np.unique(mix((hashes * U(0x9E3779B97F4A7C15))[context] + words[word]), return_inverse=True)
            start = mix(start * U(0x9E3779B97F4A7C15) + mix(np.array([START])))
            of = of.astype(np.int32)
            at = np.empty(len(keys), np.int32)
            at[of] = np.arange(len(of), dtype=np.int32)
            self.keys.append(keys)
            self.of.append(of)
            self.context.append(context[at])
            self.at.append(at)
            self.hashes.append(hashes)

    def before(self, x: np.ndarray, start: object) -> np.ndarray:
        """What the token before has of ``x`` (a value a token); ``start`` where a text starts."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.starts] = start
        return out

    def counts(self, level: int) -> np.ndarray:
        return np.bincount(self.of[level][self.taught], minlength=len(self.keys[level]))


#: Stands for the start of a text, which has no place in the tables of grams.
START_PLACE = (1 << 32) - 1


def steps(places: np.ndarray) -> np.ndarray:
    """Ascending places as differences; ``np.cumsum(..., dtype="u4")`` undoes it."""
    return np.diff(places.astype("<u4"), prepend=np.uint32(0)).astype("<u4")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> U(32)) * U(parts) >> U(32)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of each part's stretch of ascending keys."""
    return np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=U))


def _learn_rule(folds: int, held: int):
    return lambda crc: crc % folds != held


BLOBS = "kind int, part int, chunk long, payload binary"
#: Kinds of blobs: a gram's level, and that with STATS or TABLE added.
WORDS, PAIRS, STATS, TABLE = 0, 1, 100, 200
WORD_STATS, PAIR_STATS = STATS + WORDS, STATS + PAIRS


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "part", "chunk", "payload"])


def requests(chunked: DataFrame, parts: int, folds: int, held: int, order: int, level: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """The grams of at most ``order`` words from ``level`` on, with each chunk's counts; of every ``turns``-th part from ``turn`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn = _learn_rule(folds, held)
        for b in batches:
            for chunk, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = Chunk(payload.as_py(), learn, order)
                for kind, keys in list(enumerate(c.keys))[level:]:
                    counts = c.counts(kind)
                    at = cuts(keys, parts)
                    yield _blobs([(kind, p, chunk, pack(keys[i:j], counts[i:j].astype("<u4"))) for p, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i and p % turns == turn])

    return chunked.select("chunk", "payload").mapInArrow(common.tidied(run), BLOBS)


def tables(asked: DataFrame, order: int) -> DataFrame:
    """Totals for every chunk, statistics, and the tables themselves: kind, part, chunk, payload."""

    def run(table: pa.Table) -> pa.Table:
        common.give_back()  # what the group before has left
        by = np.argsort(table.column("chunk").to_numpy(), kind="stable")
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        chunk = table.column("chunk").to_numpy()[by]
        payloads = table.column("payload")
        got = [unpack(payloads[int(i)].as_py()) for i in by]
        keys, counts = np.concatenate([k for k, _ in got]), np.concatenate([n for _, n in got]).astype(np.int64)
        unique, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, weights=counts, minlength=len(unique)).astype(np.int64)
        taught = np.flatnonzero(counts)
        owner = np.zeros(len(keys), np.uint8)  # one chunk speaks for each distinct gram
        owner[taught[np.unique(of[taught], return_index=True)[1]]] = 1
        seen = total > 0
        place = np.maximum(np.cumsum(seen) - 1, 0)  # where the gram stands in this part's table
        rows, at = [], 0
        for c, (k, _) in zip(chunk, got, strict=True):
            here = of[at : at + len(k)]
            rows.append((kind, part, int(c), pack(total[here].astype("<u4"), owner[at : at + len(k)], *([steps(place[here])] if kind < order - 1 else []))))
            at += len(k)
        of_counts = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2].tolist()
        stats = {"tokens": int(total.sum()), "types": int(seen.sum()), "of_counts": of_counts}
        rows.append((STATS + kind, part, -1, json.dumps(stats).encode()))
        rows.append((TABLE + kind, part, -1, pack(unique[seen], total[seen].astype("<u4"))))
        return pa.Table.from_batches([_blobs(rows)])

    return asked.groupBy("kind", "part").applyInArrow(run, BLOBS)


def discounts(of_counts: list[int]) -> np.ndarray:
    """Factors d_0 (unused), d_1 ... d_K by Good-Turing; 1 where counts of counts allow none."""
    d, n = np.ones(K + 1), of_counts
    top = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    for r in range(1, K + 1):
        if n[r] and top < 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top)
            if 0 < x < 1:
                d[r] = x
    return d


class Estimates:
    """Discounted masses of the counts of words and of longer grams."""

    def __init__(self, stats: dict[int, dict]):
        words = stats[WORD_STATS]
        self.tokens, self.types = words["tokens"], words["types"]
        self.d = [discounts(stats[k]["of_counts"]) for k in sorted(stats)]
        given = sum((1 - self.d[WORDS][r]) * r * words["of_counts"][r] for r in range(1, K + 1))
        least = 1 / (self.tokens + self.types + 1)
        self.scale = 1.0
        self.unknown = given / self.tokens if self.tokens else 1.0
        if self.unknown < least:  # no discount: room for the unknown all the same
            self.scale, self.unknown = (1 - least) / (1 - self.unknown), least

    def word(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word of count c; of the unknown word for 0."""
        d = self.d[WORDS][np.minimum(c, K)]
        d = np.where(c > K, 1.0, d)
        return np.where(c > 0, self.scale * d * c / max(self.tokens, 1), self.unknown)

    def mass(self, c: np.ndarray, level: int) -> np.ndarray:
        """Discounted count of a gram of ``level`` (pairs or longer) seen c times."""
        return np.where(c > K, c - KEEP_BACK, self.d[level][np.minimum(c, K)] * c * (1 - 1e-12))

    def pair_mass(self, c: np.ndarray) -> np.ndarray:
        return self.mass(c, PAIRS)


PARTIAL = "kind int, part int, chunk long, at int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, payload binary"
DOCUMENT, GIVE, NEED, CONTEXTS, ADD = range(5)
FIELDS = [x.split()[0] for x in PARTIAL.split(", ")]
ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]


def _partial(rows: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[f], t) if f in columns else pa.nulls(rows, t) for f, t in zip(FIELDS, ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, FIELDS)


def evaluate(chunked: DataFrame, answers: DataFrame, e: Estimates, parts: int, folds: int, held: int, order: int) -> DataFrame:
    """Document sums but for backoff weights; what grams give to contexts; what documents need of them."""

    def run(chunk_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        common.give_back()
        chunk = chunk_rows.column("chunk")[0].as_py()
        c = Chunk(chunk_rows.column("payload")[0].as_py(), _learn_rule(folds, held), order)
        kind, part = answer_rows.column("kind").to_numpy(), answer_rows.column("part").to_numpy()
        blobs = answer_rows.column("payload")

        def totals(level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            mine = np.flatnonzero(kind == level)
            got = [unpack(blobs[int(i)].as_py()) for i in mine[np.argsort(part[mine])]]
            total, owner = (np.concatenate([g[x] for g in got]) for x in range(2))
            return total.astype(np.int64), owner.astype(bool), np.concatenate([np.cumsum(x, dtype="u4") for g in got for x in g[2:]] or [np.empty(0, "u4")])

        count, _, place = totals(WORDS)
        end = count[np.searchsorted(c.keys[WORDS], END)]  # as many starts as ends
        n = now = count[c.of[WORDS]]
        lower = e.word(n)  # each token's probability by the level below, where that has seen it
        log = np.log10(lower)
        token_doc = np.repeat(np.arange(len(c.doc_ids), dtype="<u4"), c.n)
        give = []
        for level in range(1, order):
            context_count, places = np.append(count, end), np.append(place, np.uint32(START_PLACE))
            bounds = cuts(c.keys[level - 1], parts)
            bounds[-1] = len(places)  # the start goes with the last part
            before = c.before(now, end)
            count, owner, place = totals(level)
            now = count[c.of[level]]
            seen = now > 0
            higher = np.zeros(len(now))
            higher[seen] = e.mass(now[seen], level) / before[seen]
            log[seen] = np.log10(higher[seen])
            # Every distinct gram gives its context the mass it takes below and the count it gives up, once.
            context, r = c.context[level][owner], count[owner]
            size = len(places)
            took = np.bincount(context, weights=lower[c.at[level][owner]], minlength=size)
            gave = np.bincount(context, weights=r - e.mass(r, level), minlength=size)
            some = np.flatnonzero(np.bincount(context, minlength=size))
            at = np.searchsorted(some, bounds)
            for p, (i, j) in enumerate(zip(at, at[1:], strict=False)):
                if j > i:
                    x = some[i:j]
                    give.append((GIVE, level, p, pack(steps(places[x]), took[x], gave[x], context_count[x].astype("<u4"))))
            lacking = np.flatnonzero(~seen & (before > 0))
            context = c.context[level][c.of[level][lacking]]
            by = np.argsort(context, kind="stable")
            context, doc = context[by], token_doc[lacking[by]]
            at = np.searchsorted(context, bounds)
            give += [(NEED, level, p, pack(steps(places[context[i:j]]), doc[i:j])) for p, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i]
            lower = higher
        sums = lambda x: np.add.reduceat(x, c.starts)
        docs = len(c.doc_ids)
        out = [_partial(
            docs, kind=[DOCUMENT] * docs, part=np.arange(docs) % parts, chunk=[chunk] * docs, at=np.arange(docs), doc_id=c.doc_ids,
            held_out=~c.learn, n_tokens=c.n.astype(np.int64), n_known=sums((n > 0).astype(np.int64)),
            base_score=sums(np.log10((n + 1) / (e.tokens + e.types + 1))), score=sums(log),
        )]
        if give:
            k, at, p, payload = zip(*give, strict=True)
            out.append(_partial(len(k), kind=k, at=at, part=p, chunk=[chunk] * len(k), payload=payload))
        return pa.Table.from_batches(out)

    left = chunked.select("chunk", "payload").groupBy("chunk")
    right = answers.filter(F.col("kind").isin(*range(order))).select("kind", "part", "chunk", "payload").groupBy("chunk")
    return left.cogroup(right).applyInArrow(run, PARTIAL)


def weigh(partial: DataFrame) -> DataFrame:
    """Backoff weights by context, added to the documents that need them; documents pass through.

    A row of kind CONTEXTS holds one part's weights for grams of level ``at``: where each context stands in
    the part's table of the level below (START_PLACE: the start of a text), and its weight.
    """

    def run(table: pa.Table) -> pa.Table:
        common.give_back()
        kind, level = table.column("kind").to_numpy(), table.column("at").to_numpy()
        part = table.column("part")[0].as_py()
        chunk, payloads = table.column("chunk").to_numpy(), table.column("payload")
        out = table.filter(pa.array(kind == DOCUMENT)).combine_chunks().to_batches()

        def blobs(kind_: int, level_: int) -> list[tuple[int, list[np.ndarray]]]:
            found = [(int(chunk[i]), unpack(payloads[int(i)].as_py())) for i in np.flatnonzero((kind == kind_) & (level == level_))]
            return [(c, [np.cumsum(x[0], dtype="u4").astype(np.int64), *x[1:]]) for c, x in found]

        for of in np.unique(level[kind == GIVE]):
            gives = [x for _, x in blobs(GIVE, of)]
            place, took, gave, before = (np.concatenate(x) for x in zip(*gives, strict=True))
            size = int(place[place < START_PLACE].max(initial=-1)) + 1  # places are dense; the start comes behind them
            place = np.minimum(place, size)
            took, gave, count = (np.bincount(place, weights=x, minlength=size + 1) for x in (took, gave, np.ones(len(place))))
            total = np.zeros(size + 1)
            total[place] = before
            some = np.flatnonzero(count)
            weight = gave[some] / total[some] / np.maximum(1 - took[some], 1e-300)
            out.append(_partial(1, kind=[CONTEXTS], at=[of], part=[part], payload=[pack(steps(np.where(some == size, START_PLACE, some)), weight)]))
            log = np.zeros(size + 1)
            log[some] = np.log10(weight)
            for c, (place, doc) in blobs(NEED, of):
                docs, back = np.unique(doc, return_inverse=True)
                add = np.bincount(back, weights=log[np.minimum(place, size)])
                out.append(_partial(1, kind=[ADD], chunk=[c], payload=[pack(docs.astype("<u4"), add)]))
        return pa.Table.from_batches(out or [_partial(0)])

    return partial.groupBy("part").applyInArrow(run, PARTIAL)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def summed(weighed: DataFrame) -> DataFrame:
    """A chunk's documents with what its parts add to them."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        docs = table.filter(pa.array(kind == DOCUMENT)).sort_by("at")
        score = docs.column("score").to_numpy().copy()
        payloads = table.column("payload")
        for i in np.flatnonzero(kind == ADD):
            at, add = unpack(payloads[int(i)].as_py())
            score[at] += add
        names = [x.split()[0] for x in SCORED.split(", ")]
        return docs.select(names).set_column(len(names) - 1, "score", pa.array(score))

    return weighed.filter(F.col("kind").isin(DOCUMENT, ADD)).groupBy("chunk").applyInArrow(run, SCORED)


def katz_scores(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a row of ``docs``.

    ``order``: words in the longest gram.  What stays in the shared folder is the model, in parts by hash: each
    level's grams and counts (lm-tables, kinds from TABLE on) and the backoff weights (lm-weighed, CONTEXTS).
    """
    spark = docs.sparkSession
    neighbours = F.pmod(F.shiftright("chunk", 32) + F.col("chunk"), F.lit(ROUNDS)).cast("int")  # go to different rounds
    chunked, chunk_path = common.stage(chunks(docs).withColumn("round", neighbours), "lm-chunks", ["round"])
    total = chunked.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(common.shuffle_width(spark), total // GROUP_TOKENS)
    # The longest grams are asked for after the others, and in turns, so that their shuffles never stand together.
    asking = [(0, order - 1, 0, 1), *((order - 1, order, i, TURNS) for i in range(TURNS))] if order > 1 else [(0, 1, 0, 1)]
    found = []
    for level, upto, turn, turns in asking:
        told = tables(requests(chunked, parts, folds, held, upto, level, turn, turns), order)
        found.append(common.stage(told.withColumn("round", neighbours), "lm-tables", ["kind", "round"]))
    answers = found[0][0]
    for more, _ in found[1:]:
        answers = answers.unionByName(more)
    stats = {k: {"tokens": 0, "types": 0, "of_counts": [0] * (K + 2)} for k in range(STATS, STATS + order)}
    for r in answers.filter(F.col("kind").isin(*stats)).select("kind", "payload").collect():  # a row a part
        x, s = json.loads(bytes(r["payload"])), stats[r["kind"]]
        s["tokens"] += x["tokens"]
        s["types"] += x["types"]
        s["of_counts"] = [a + b for a, b in zip(s["of_counts"], x["of_counts"], strict=True)]
    e = Estimates(stats)
    partial, partial_paths = None, []
    for i in range(ROUNDS):
        mine = F.col("round") == i
        asked = answers.filter(F.col("kind") < order).filter(mine)
        told = evaluate(chunked.filter(mine), asked, e, parts, folds, held, order).withColumn("turn", F.col("part") % ROUNDS)
        more, path = common.stage(told, "lm-partial", ["turn"])
        partial = more if partial is None else partial.unionByName(more)
        partial_paths.append(path)
        common.discard(spark, f"{chunk_path}/round={i}", *(f"{path}/kind={level}/round={i}" for _, path in found for level in range(order)))  # the tables stay
    weighed = None
    for i in range(ROUNDS):
        more = common.staged(weigh(partial.filter(F.col("turn") == i).select(*FIELDS)), "lm-weighed", ["kind"])
        weighed = more if weighed is None else weighed.unionByName(more)
        common.discard(spark, *(f"{path}/turn={i}" for path in partial_paths))
    common.discard(spark, chunk_path, *partial_paths)
    return summed(weighed).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(e.tokens).cast("long").alias("train_tokens"), "base_score", "score")
