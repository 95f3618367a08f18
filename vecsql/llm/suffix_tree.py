"""Language-model scores from a probabilistic suffix tree over words.

The root is the distribution of all training tokens. Below it stand contexts of one to ``DEPTH``
preceding words whose next-word distribution differs enough from that of the context without its
oldest word (the divergence test). A text is scored token by token with the longest context that
is a state of the tree; a distribution is discounted and interpolated with its parent's:

    p(t | c) = max(N(ct) - DISCOUNT, 0) / N(c) + left(c) * p(t | parent of c)

``N`` counts occurrences in all training texts. An n-gram that occurs ``LEAST_COUNT`` times or more
is listed in its context, whatever the size of the corpus; ``left(c)`` is what listed n-grams leave.
A context is a state if over its training occurrences the mean of log p(t | c) / p(t | parent) is
``LEAST_GAIN`` or more. Since p(t | c) runs through all suffixes of c, these need not be states.

How it stays distributed. Texts are cut into tokens once and written as *segments* of about
``SEGMENT`` tokens. Whatever concerns a context or n-gram of the whole corpus is a sum over its
occurrences: its count; how many n-grams a context lists (an occurrence adds 1 / N) and how often others follow;
the logarithms of the divergence test. So the work is a few rounds of one exchange: each segment
adds up its own part for each different key, sends sorted keys and sums to the shards that own
these ranges of keys, and gets the sums of all segments back in the order of its keys. A key, however
frequent, is sent once by a segment, and n-grams whose parts are rare are not sent at all; once
counted, a frequent one is named by its number in its shard. Nothing is
collected, broadcast or bounded by a number that doesn't grow: shards and segments grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .training import fold
from .words import NON_SPACE, mix, row_chunks, text_buffer, words

#: Words of the longest contexts.
DEPTH = 3
#: Occurrences an n-gram needs to be listed.
LEAST_COUNT = 2
#: Tokens of a segment, about; a longer text is a segment of its own.
SEGMENT = 1 << 20
#: Tokens for each shard of the keys, about.
SHARD_TOKENS = 5_000_000
PSEUDO = 0.1
DISCOUNT = 0.75
#: Natural logarithm's gain a token that a context must bring over its parent.
LEAST_GAIN = 0.02

_ODD = np.uint64(0x9E3779B97F4A7C15)
START, END = mix(np.array([11, 13], np.uint64))
#: What is asked of the shards: counts of n-grams, n-grams listed in contexts, gains of contexts.
COUNT, LISTED, GAIN = range(3)


def ranked(keys: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the place of each key among them.

    Their indices ride in the low bits of a plain sort; only keys that then can't be told apart (beside
    those of one text, next to none) make it sort in full. shift: leading bits that all keys share.
    """
    n = len(keys)
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    order = ((keys << np.uint64(shift)) & ~low) | np.arange(n, dtype=np.uint64)
    order.sort()
    order = (order & low).astype(np.int64)
    found = keys[order]
    if n and (found[1:] < found[:-1]).any():
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    new = np.ones(n, bool)
    new[1:] = found[1:] != found[:-1]
    place = np.empty(n, np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return found[new], place


def _pack(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as hold the largest of them, fractions in four; their first bytes, their second ones, ... compressed."""
    if x.dtype.kind == "f":
        kind, planes = b"f", x.astype(np.float32).view(np.uint8).reshape(-1, 4).T
    else:
        wide = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        kind, planes = b"%d" % wide, x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T[:wide]
    return kind + len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[1:5], "little")
    wide = 4 if x[:1] == b"f" else int(x[:1])
    planes = np.frombuffer(pa.decompress(x[5:], n * wide, "zstd"), np.uint8).reshape(wide, n)
    if x[:1] == b"f":
        return np.ascontiguousarray(planes.T).view(np.float32).ravel()
    if wide == 1:
        return planes[0]
    kind = np.uint32 if wide <= 4 else np.uint64
    out = planes[0].astype(kind)
    for k in range(1, wide):
        out |= planes[k].astype(kind) << kind(8 * k)
    return out


def _gaps(x: np.ndarray, least: int = 0) -> np.ndarray:
    """Ascending numbers by their distances, the first from ``least``; np.cumsum brings them back."""
    return np.diff(x, prepend=x.dtype.type(least))


@dataclass
class Level:
    """The n-grams of one length in a segment: where they end, their different keys, and what is known of these."""

    keys: np.ndarray
    place: np.ndarray | None  # by position; -1 where none ends, or only ones too rare to be known; of words only once counts are known
    count: np.ndarray | None = None
    known: np.ndarray | None = None  # by position, the place if the n-gram is frequent enough to be listed, else -1
    often: np.ndarray | None = None  # places of those, and their numbers in their shards
    numbers: np.ndarray | None = None
    left: np.ndarray | None = None
    state: np.ndarray | None = None


@dataclass
class Segment:
    """Texts as positions: a start, their words and an end each, one text after the other."""

    tokens: np.ndarray
    rows: np.ndarray
    before: np.ndarray
    learn: np.ndarray
    levels: list[Level] = field(default_factory=list)
    key: np.ndarray | None = None  # by position, of the longest n-grams so far

    @classmethod
    def read(cls, vocabulary: np.ndarray, codes: np.ndarray, sizes: np.ndarray, learn: np.ndarray) -> Segment:
        size = sizes.astype(np.int64) + 2
        first = np.cumsum(size) - size
        every = np.concatenate([vocabulary, [START, END]])
        code = np.empty(int(size.sum()), np.int32)
        inside = np.ones(len(code), bool)
        inside[first] = inside[first + size - 1] = False
        code[inside] = codes
        code[first], code[first + size - 1] = len(vocabulary), len(vocabulary) + 1
        keys, place = ranked(every)
        rows = np.repeat(np.arange(len(size), dtype=np.int32), size)
        before = (np.arange(len(code)) - np.repeat(first, size)).astype(np.int32)
        out = cls(every[code], rows, before, np.repeat(learn, size))
        out.levels.append(Level(keys, place[code]))
        out.key = out.tokens
        return out

    def deepen(self) -> None:
        """The next length: only n-grams both of whose parts are frequent can be."""
        n = len(self.levels) + 1
        often = self.levels[-1].known >= 0
        fits = often[1:] & often[:-1]
        fits &= self.before[1:] >= n - 1
        at = np.flatnonzero(fits) + 1
        key = self.key[at - 1] * _ODD
        key += self.tokens[at]
        key += np.uint64(n)
        key = mix(key)
        keys, own = ranked(key)
        place = np.full(len(self.tokens), -1, np.int32)
        place[at] = own
        self.key = np.zeros(len(self.tokens), np.uint64)
        self.key[at] = key
        self.levels.append(Level(keys, place))

    def contexts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of tokens after a frequent context of n words, and the contexts' places."""
        before = np.concatenate([np.array([-1], np.int32), self.levels[n - 1].known[:-1]])
        at = np.flatnonzero((before >= 0) & (self.before >= n))
        return at, before[at]

    def share(self, n: int, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        """What the n-grams of n + 1 words that end there take of their contexts' probability."""
        longer = self.levels[n]
        pair = longer.known[at]
        taken = np.append(np.maximum(longer.count - DISCOUNT, 0), 0.0)[pair]  # the last for n-grams that aren't listed
        taken /= self.levels[n - 1].count[context]
        return taken

    def probabilities(self, norm: float, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, positions, contexts, p of the parents there, p) for contexts of n words; p is by position, of the token after its suffixes so far.

        It is one array that the next step changes.
        """
        p = ((self.levels[0].count + PSEUDO) / norm)[self.levels[0].place]
        yield 0, np.flatnonzero(self.before > 0), np.zeros(0, np.int64), np.zeros(0), p
        for n in range(1, depth + 1):
            at, context = self.contexts(n)
            above = p[at]
            p[at] = self.share(n, at, context) + self.levels[n - 1].left[context] * above
            yield n, at, context, above, p

    def ask(self, kind: int, n: int, norm: float) -> tuple[np.ndarray, ...]:
        """Sorted keys (for counts) or numbers of frequent n-grams, and this segment's parts of the sums that are wanted."""
        if kind == COUNT:
            while len(self.levels) < n:
                self.deepen()
            level = self.levels[n - 1]
            own = level.place[self.learn & (level.place >= 0)]
            return level.keys, np.bincount(own, minlength=len(level.keys))
        level = self.levels[n - 1]
        if kind == LISTED:
            at, context = self.contexts(n)
            pair, learn = self.levels[n].known[at], self.learn[at]
            found, other = np.flatnonzero((pair >= 0) & learn), context[(pair < 0) & learn]
            sums = np.bincount(context[found], 1 / self.levels[n].count[pair[found]], len(level.keys)), np.bincount(other, minlength=len(level.keys))
        else:
            for _, at, context, above, p in self.probabilities(norm, n):  # noqa: B007
                pass
            own = self.learn[at]
            gain = np.log(p[at[own]] / above[own]) - LEAST_GAIN
            sums = (np.bincount(context[own], gain, len(level.keys)),)
        return level.numbers, *(x[level.often] for x in sums)

    def told(self, kind: int, n: int, x: np.ndarray, y: np.ndarray) -> None:
        """The sums over all segments, in the order of what was asked; of counts also the numbers of the frequent ones."""
        if kind == COUNT:
            while len(self.levels) < n:
                self.deepen()
            level = self.levels[n - 1]
            level.count = x.astype(np.int64)
            frequent = level.count >= LEAST_COUNT
            named = np.where(frequent, np.arange(len(frequent), dtype=np.int32), np.int32(-1))
            level.known = np.append(named, np.int32(-1))[level.place]  # the last for places of -1
            level.often, level.numbers = np.flatnonzero(frequent), y
            if n > 1:
                level.place = None
            return
        level = self.levels[n - 1]
        if kind == LISTED:
            level.left = np.ones(len(level.keys))
            level.left[level.often] = (y + DISCOUNT * x) / level.count[level.often]  # occurrences that aren't listed, and what listed n-grams give up
        else:
            level.state = np.zeros(len(level.keys), bool)
            level.state[level.often] = x > 0

    def scores(self, norm: float, depth: int) -> np.ndarray:
        """log10 of the probability of each text, by the longest state before each token."""
        best = np.ones(len(self.tokens))
        for n, at, context, _, p in self.probabilities(norm, depth):
            own = at[self.levels[n - 1].state[context]] if n else at
            best[own] = p[own]
        return self.by_text(np.log10(best))

    def base(self, norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text, those that training texts hold, and the sum of the root's logarithms."""
        count = self.levels[0].count[self.levels[0].place]
        inside = self.before > 0
        return self.by_text(inside).astype(np.int64), self.by_text(inside & (count > 0)).astype(np.int64), self.by_text(np.where(inside, np.log10((count + PSEUDO) / norm), 0))

    def by_text(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, x, int(self.rows[-1]) + 1)


def _segments(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (size, ids, learn, sizes, vocabulary, codes) from rows (doc_id, text, learn)."""

    def whole() -> pa.RecordBatch:
        vocabulary, codes = ranked(np.concatenate([h for *_, h in held]))
        counts = np.bincount(codes, minlength=len(vocabulary))
        by_count = np.argsort(-counts, kind="stable")  # small codes for frequent words
        code_of = np.empty(len(vocabulary), np.int64)
        code_of[by_count] = np.arange(len(vocabulary))
        vocabulary, codes = vocabulary[by_count], code_of[codes]
        flags, sizes = np.concatenate([f for _, f, _, _ in held]), np.concatenate([s for _, _, s, _ in held])
        ids = pa.concat_arrays([i for i, *_ in held])
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        often = int((counts > 1).sum())  # the others, most words, are in order
        packed = often.to_bytes(4, "little") + vocabulary[:often].tobytes() + _pack(_gaps(vocabulary[often:]))
        blobs = [np.packbits(flags).tobytes(), _pack(sizes), packed, _pack(codes)]
        size = pa.array([len(codes) + 2 * len(sizes)], pa.int64())
        return pa.RecordBatch.from_arrays([size, listed, *(pa.array([b], pa.binary()) for b in blobs)], ["size", "ids", "learn", "sizes", "vocabulary", "codes"])

    held: list[tuple] = []
    n = 0
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        flags = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
        for a, b in row_chunks(offsets):
            own = offsets[a : b + 1]
            found = words(data[own[0] : own[-1]], own - own[0], NON_SPACE)
            held.append((batch.column(0).slice(a, b - a), flags[a:b], found.counts, found.hashes))
            n += len(found.hashes) + 2 * (b - a)
            if n >= most:
                yield whole()
                held, n = [], 0
    if held:
        yield whole()


_ASKS = "shard int, seg long, kind int, n int, keys binary, x binary, y binary"
_SUMS = "seg long, kind int, n int, shard int, x binary, y binary"


def _read(done: list[tuple[int, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Segment, pa.Array]]:
    """Segments with all that the shards have told them, from rows sorted by segment, kind (-1: the segment itself), n and shard."""
    now: tuple[int, Segment, pa.Array] | None = None
    told: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}

    def whole() -> tuple[int, Segment, pa.Array]:
        for kind, n in sorted(done):  # counts of n-grams before what is said of contexts
            parts = told.get((kind, n), [])
            both = [[_unpack(p[k]) for p in parts] for k in (0, 1)]
            if kind == COUNT:
                both[1] = [np.cumsum(x, dtype=np.int64) for x in both[1]]
            now[1].told(kind, n, *(np.concatenate([np.zeros(0, np.uint8), *x]) for x in both))
        return now

    for batch in batches:
        seg, kind, n, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("seg", "kind", "n", "x", "y"))
        for i in range(len(batch)):
            if kind[i].as_py() < 0:
                if now:
                    yield whole()
                learn, sizes, vocabulary, codes = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("learn", "sizes", "vocabulary", "codes"))
                sizes = _unpack(sizes)
                flags = np.unpackbits(np.frombuffer(learn, np.uint8), count=len(sizes)).astype(bool)
                ids = batch.column(batch.schema.get_field_index("ids"))[i].values
                often = 4 + 8 * int.from_bytes(vocabulary[:4], "little")
                words_ = np.concatenate([np.frombuffer(vocabulary[4:often], np.uint64), np.cumsum(_unpack(vocabulary[often:]), dtype=np.uint64)])
                now, told = (seg[i].as_py(), Segment.read(words_, _unpack(codes), sizes, flags), ids), {}
            else:
                told.setdefault((kind[i].as_py(), n[i].as_py()), []).append((x[i].as_py(), y[i].as_py()))
    if now:
        yield whole()


def _ask(asked: list[tuple[int, int]], done: list[tuple[int, int]], bits: int, norm: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    firsts = [s << 64 - bits for s in range(1 << bits)]
    names = ["shard", "seg", "kind", "n", "keys", "x", "y"]
    for seg, own, _ in _read(done, batches):
        for kind, n in asked:
            keys, *sums = own.ask(kind, n, norm)
            level = own.levels[n - 1]
            cuts = np.append(np.searchsorted(keys if kind == COUNT else level.keys[level.often], np.array(firsts, np.uint64)), len(keys))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            for at in range(0, len(full), 256):
                some = full[at : at + 256]
                sent = [_pack(_gaps(keys[cuts[s] : cuts[s + 1]], firsts[s] if kind == COUNT else 0)) for s in some]
                parts = [[_pack(v[cuts[s] : cuts[s + 1]]) for s in some] for v in sums] + [[None] * len(some)] * (2 - len(sums))
                same = [pa.array([v] * len(some), t) for v, t in ((seg, pa.int64()), (kind, pa.int32()), (n, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *same, *(pa.array(p, pa.binary()) for p in (sent, *parts))], names)


def _add(bits: int, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each ask the sums of all segments in the order of what it asks for; for the counts of words a row of no segment with how many there are, too.

    Counts come with the numbers of the frequent n-grams: dense and ascending within a shard, and all
    that later rounds need to send. The longest n-grams are no contexts and need none.
    """
    names = ["seg", "kind", "n", "shard", "x", "y"]
    now, held = None, []

    def whole() -> Iterator[pa.RecordBatch]:
        shard, kind, n = now
        ends = np.cumsum([len(k) for _, k, *_ in held])
        own = [slice(int(e) - len(h[1]), int(e)) for e, h in zip(ends, held, strict=True)]
        place = np.concatenate([k for _, k, *_ in held])
        numbers = None
        if kind == COUNT:
            keys, place = ranked(place + np.uint64(shard << 64 - bits), bits)
            sums = [np.rint(np.bincount(place, np.concatenate([h[2] for h in held]))).astype(np.int64)]
            frequent = sums[0] >= LEAST_COUNT
            numbers = np.cumsum(frequent) - 1
        else:
            place = place.astype(np.int64)
            sums = [np.bincount(place, np.concatenate([h[c] for h in held])) for c in ((2, 3) if kind == LISTED else (2,))]
            sums = [np.rint(s).astype(np.int64) for s in sums] if kind == LISTED else [(sums[0] >= 0).astype(np.uint8)]
        for at in range(0, len(held), 64):
            some = range(at, min(at + 64, len(held)))
            parts = [[_pack(s[place[own[i]]]) for i in some] for s in sums]
            if kind == COUNT and n < longest:
                parts.append([_pack(_gaps(numbers[p[frequent[p]]])) for p in (place[own[i]] for i in some)])
            elif kind != LISTED:
                parts.append([_pack(np.zeros(0, np.uint8))] * len(some))
            same = [pa.array([v] * len(some), pa.int32()) for v in (kind, n, shard)]
            yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in some], pa.int64()), *same, *(pa.array(p, pa.binary()) for p in parts)], names)
        if (kind, n) == (COUNT, 1):
            words_ = sums[0][keys != START]
            both = [str(int(v)).encode() for v in (words_.sum(), (words_ > 0).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *(pa.array([v], pa.int32()) for v in (kind, n, shard)), *(pa.array([b], pa.binary()) for b in both)], names)

    for batch in batches:
        shard, seg, kind, n, *blobs = batch.columns
        for i in range(len(batch)):
            group = shard[i].as_py(), kind[i].as_py(), n[i].as_py()
            if group != now and held:
                yield from whole()
                held = []
            now = group
            keys, *sums = (b[i].as_py() for b in blobs)
            keys = _unpack(keys)
            held.append((seg[i].as_py(), np.cumsum(keys, dtype=np.uint64), *(_unpack(v) for v in sums if v is not None)))
    if held:
        yield from whole()


def _score(done: list[tuple[int, int]], norm: float, total: int, depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, own, ids in _read(done, batches):
        n_tokens, n_known, base = own.base(norm)
        columns = [ids, *map(pa.array, (n_tokens, n_known, np.full(len(ids), total, np.int64), base, own.scores(norm, depth)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, learn: Column, depth: int = DEPTH, segment: int = SEGMENT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id and the scores of ``docs(doc_id, text)`` by a model of those of them for which ``learn`` is true.

    n_tokens (words and the end), n_known (seen in training texts), train_tokens, base_score, score. A null text is
    empty: it has the end only; null ids stay. Equal rows get equal scores and are learned each; very long texts are
    one segment. Where ``learn`` is null it is false. An empty table gives an empty one; without texts to
    learn from, every token has the probability 1 of the only thing known. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffix-tree")
    save = partial(scratch.save, compression="zstd")
    kind = docs.schema["doc_id"].dataType.simpleString()
    blobs = "learn binary, sizes binary, vocabulary binary, codes binary"
    cut = docs.select("doc_id", "text", learn.alias("learn")).mapInArrow(partial(_segments, segment), f"size long, ids array<{kind}>, {blobs}")
    segments = save(cut.withColumn("seg", F.monotonically_increasing_id()), "segments")
    n_segments, tokens = segments.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = int(tokens // shard_tokens).bit_length()
    fields = [f.strip().split(" ")[0] for f in f"{_SUMS}, ids a, {blobs}".split(",")]
    own = segments.withColumns({"kind": F.lit(-1), "n": F.lit(0), "shard": F.lit(0), "x": F.lit(None).cast("binary"), "y": F.lit(None).cast("binary")}).select(*fields)
    nothing = {"ids": F.lit(None).cast(f"array<{kind}>")} | {b.split(" ")[0]: F.lit(None).cast("binary") for b in blobs.split(", ")}
    told = own

    def together() -> DataFrame:
        return told.repartition(max(1, n_segments // 2), "seg").sortWithinPartitions("seg", "kind", "n", "shard")

    norm, total, done = PSEUDO, 0, []
    # what is asked needs the answers to what is asked before it: counts of longer n-grams, what contexts list, their gains
    last = {COUNT: depth + 1, LISTED: depth, GAIN: depth}
    rounds = [[(kind, r - late) for kind, late in ((COUNT, 0), (LISTED, 2), (GAIN, 3)) if 1 <= r - late <= last[kind]] for r in range(1, depth + 4)]
    for r, asked in enumerate(rounds, 1):
        asks = (together() if done else own).mapInArrow(partial(_ask, asked, list(done), bits, norm), _ASKS)
        dealt = asks.repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("shard", "kind", "n", "seg")
        sums = save(dealt.mapInArrow(partial(_add, bits, depth + 1), _SUMS), f"sums-{r}")
        if r == 1:
            whole = [F.coalesce(F.sum(F.col(c).cast("string").cast("long")), F.lit(0)) for c in ("x", "y")]
            total, distinct = sums.filter("seg < 0").agg(*whole).first()
            norm = total + PSEUDO * (distinct + 1)
            sums = sums.filter("seg >= 0")
        done += asked
        told = told.union(sums.withColumns(nothing).select(*fields))
    result = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together().mapInArrow(partial(_score, done, norm, total, depth), result)


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fold(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), *scored.columns[1:])
