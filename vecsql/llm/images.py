"""Cropped and edited copies of pictures by local descriptors.

Corners are found on several scales, each gets an orientation from the centroid of the intensities
around it and 256 binary tests of smoothed intensities in the turned patch. Windows of ``KEY_WORDS``
times 16 bits of a descriptor are keys of Hamming tables; pictures that share a key are candidates (see
``linking``). A candidate pair is confirmed by geometry: descriptors that are each other's nearest
propose a shift, turn and scale, and enough others must follow the same one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linking import linked_groups
from .scratch import Scratch, small_batches

SCALES = (1.0, 0.91, 0.83, 0.75, 0.68, 0.62, 0.56, 0.5)
PATCH = 13
APART = 6
#: Harris response a corner needs, as a share of the largest of the picture.
LEAST_CORNER = 0.01
#: Where the windows of the tables begin in a descriptor's 16 words, and how many they hold; the last ones go round.
TABLES, KEY_WORDS = (0, 3, 6, 8, 11, 14), 3
MOST_BITS = 48
LEAST_INLIERS = 5
#: Of descriptors, what a block of pictures holds and what a row of them does, and what is shuffled at once; more goes in several rounds, for less disk.
BLOCK_BYTES, PIECE_BYTES, ROUND_BYTES = 4 << 20, 1 << 20, 300 << 20
#: Bytes of a descriptor and its place.
CORNER_BYTES = 48
#: Candidate pairs that a task lists at once, about.
LISTED = 1 << 20
TOLERANCE = 3.0

_rng = np.random.default_rng(2024)
_TESTS = np.clip(_rng.normal(0, PATCH / 2.2, (256, 2, 2)), -PATCH * 0.7, PATCH * 0.7)
_DY, _DX = (v.ravel() for v in np.mgrid[-7:8, -7:8])
_DISC = _DY**2 + _DX**2 <= 49


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM or of a PNG picture of 8 bits a sample; None for anything else."""
    if (data or b"")[:8] == _PNG:
        return _decode_png(data)
    head = re.match(rb"P([56])(?:\s+|#[^\n]*\n)+?(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head or not 0 < int(head[4]) < 256:
        return None
    width, height, planes = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
    body = np.frombuffer(data, np.uint8, offset=head.end())
    if not width * height or len(body) < width * height * planes:
        return None
    return body[: width * height * planes].reshape(height, width, planes).mean(axis=2)


#: The signature of a PNG file, and the samples of a pixel by colour type.
_PNG = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _decode_png(data: bytes) -> np.ndarray | None:
    """Grey values, without regard to opacity; None if it is broken, interlaced or not of 8 bits a sample."""
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and size == 13:
            head = int.from_bytes(part[:4], "big"), int.from_bytes(part[4:8], "big"), *part[8:]
        elif kind == b"PLTE":
            palette = np.frombuffer(part[: len(part) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if not head or head[2] != 8 or head[3] not in _SAMPLES or head[6] or not head[0] * head[1]:
        return None
    width, height, samples = head[0], head[1], _SAMPLES[head[3]]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error:
        return None
    if len(lines) < height * (1 + width * samples):
        return None
    lines = lines[: height * (1 + width * samples)].reshape(height, -1)
    out = np.zeros((height, width, samples), np.int64)
    above = np.zeros((width, samples), np.int64)
    for y in range(height):
        how, line = int(lines[y, 0]), lines[y, 1:].reshape(width, samples).astype(np.int64)
        if how == 1:  # the difference to the left: sums bring it back
            line = np.cumsum(line, axis=0) & 255
        elif how == 2:
            line = line + above & 255
        elif how in (3, 4):
            left = corner = np.zeros(samples, np.int64)
            for x in range(width):
                up = above[x]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x] = left = line[x] + guess & 255
                corner = up
        elif how:
            return None
        out[y] = above = line
    if head[3] == 3:
        return palette[np.minimum(out[..., 0], len(palette) - 1)].mean(axis=2) if palette is not None and len(palette) else None
    return out[..., : samples - 1 + samples % 2].mean(axis=2)


def encode(picture: np.ndarray) -> bytes:
    height, width = picture.shape
    return b"P5 %d %d 255\n" % (width, height) + np.clip(np.rint(picture), 0, 255).astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1 of the last two axes; edges are repeated."""
    for axis in (-2, -1):
        n = x.shape[axis]
        total = np.cumsum(np.take(x, np.clip(np.arange(-r - 1, n + r), 0, n - 1), axis), axis=axis)
        low, high = [slice(None)] * x.ndim, [slice(None)] * x.ndim
        low[axis], high[axis] = slice(0, n), slice(2 * r + 1, 2 * r + 1 + n)
        x = total[tuple(high)] - total[tuple(low)]
    return x


def _shrunk(x: np.ndarray, scale: float, soft: np.ndarray | None = None) -> np.ndarray:
    """The smoothed picture between its pixels, so that one pyramid's pictures are like another's."""
    if scale == 1:
        return x
    out = _box(x, 1) / 9 if soft is None else soft
    for axis in (0, 1):
        n = x.shape[axis]
        at = np.clip((np.arange(max(1, int(n * scale))) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        part = np.expand_dims(at - low, 1 - axis)
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, n - 1), axis) * part
    return out


def describe(picture: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) of x, y, angle and size of the corners in the picture's own pixels, and (n, 4) uint64 of their bits."""
    places, bits = [np.zeros((0, 4))], [np.zeros((0, 4), np.uint64)]
    smooth = _box(picture, 1) / 9 if picture is not None else None
    for scale in SCALES if picture is not None else ():
        x = _shrunk(picture, scale, smooth)
        if min(x.shape) < 2 * PATCH + 3:
            break
        soft = _box(_box(x, 1), 1) / 81
        gy, gx = np.gradient(soft)
        a, b, c = _box(np.stack([gx * gx, gy * gy, gx * gy]), 2)
        reply = a * b - c * c - 0.05 * (a + b) ** 2
        peak = reply
        for axis in (0, 1):
            reach = 0
            while reach < APART:  # the largest within reach, then within the reach of two such
                step = min(2 * reach + 1, APART - reach)
                peak = np.maximum(peak, np.maximum(np.roll(peak, step, axis), np.roll(peak, -step, axis)))
                reach += step
        inside = np.zeros(x.shape, bool)
        inside[PATCH : x.shape[0] - PATCH, PATCH : x.shape[1] - PATCH] = True
        ys, xs = np.nonzero((reply == peak) & (reply > max(LEAST_CORNER * reply.max(), 1.0)) & inside)
        if not len(ys):
            continue
        around = soft[ys[:, None] + _DY[_DISC], xs[:, None] + _DX[_DISC]]
        angle = np.arctan2((around * _DY[_DISC]).sum(1), (around * _DX[_DISC]).sum(1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        tx = np.rint(xs[:, None, None] + cos * _TESTS[..., 0] - sin * _TESTS[..., 1]).astype(int).clip(0, x.shape[1] - 1)
        ty = np.rint(ys[:, None, None] + sin * _TESTS[..., 0] + cos * _TESTS[..., 1]).astype(int).clip(0, x.shape[0] - 1)
        value = soft[ty, tx]
        bits.append(np.packbits(value[:, :, 0] < value[:, :, 1], axis=1).view(np.uint64))
        places.append(np.stack([xs / scale, ys / scale, angle, np.full(len(xs), 1 / scale)], 1))
    return np.concatenate(places), np.concatenate(bits)


def inliers(places_a: np.ndarray, bits_a: np.ndarray, places_b: np.ndarray, bits_b: np.ndarray, least: int = 1) -> int:
    """Mutually nearest descriptors that agree best on one shift, turn and scale; 0 where fewer than ``least`` are near at all."""
    if len(bits_a) < least or len(bits_b) < least:
        return 0
    apart = np.zeros((len(bits_a), len(bits_b)), np.uint16)
    for a, b in zip(bits_a.T, bits_b.T, strict=True):
        apart += np.bitwise_count(a[:, None] ^ b)
    near_b, own = apart.argmin(1), np.arange(len(apart))
    near = apart[own, near_b] <= MOST_BITS
    if np.count_nonzero(near) < least:
        return 0
    i = np.flatnonzero(near & (apart.argmin(0)[near_b] == own))
    if len(i) < least:
        return 0
    p, q = places_a[i], places_b[near_b[i]]
    turn, scale = (q[:, 2] - p[:, 2])[:, None], (q[:, 3] / p[:, 3])[:, None]
    dx, dy = p[None, :, 0] - p[:, None, 0], p[None, :, 1] - p[:, None, 1]
    fx = q[:, None, 0] + scale * (np.cos(turn) * dx - np.sin(turn) * dy)
    fy = q[:, None, 1] + scale * (np.sin(turn) * dx + np.cos(turn) * dy)
    off = np.hypot(fx - q[None, :, 0], fy - q[None, :, 1])
    return int((off <= TOLERANCE * np.maximum(1, q[None, :, 3])).sum(1).max())


def _keys(bits: np.ndarray) -> np.ndarray:
    """(tables, n): the keys of descriptors, the table's number above the bits of its window."""
    word = np.ascontiguousarray(bits).view(np.uint16).reshape(len(bits), 16).T.astype(np.int64)
    out = np.empty((len(TABLES), len(bits)), np.int64)
    for n, first in enumerate(TABLES):
        out[n] = n
        for k in range(KEY_WORDS):
            out[n] = out[n] << 16 | word[(first + k) % 16]
    return out


def table_keys(bits: np.ndarray) -> np.ndarray:
    """The different keys of the descriptors of a picture in all tables."""
    return np.unique(_keys(bits))


def _shared_keys(bits: np.ndarray, owner: np.ndarray, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the keys that two descriptors or more have, each once; of all pictures of a task together, since most keys occur once."""
    keys = _keys(bits).ravel()
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    again = np.r_[same, False] | np.r_[False, same]
    bucket = np.cumsum(np.r_[True, ~same])[again] if len(keys) else keys
    codes = np.unique(bucket * n_owners + np.tile(owner, len(TABLES))[order[again]]) if len(keys) else keys
    bucket, owner = np.divmod(codes, max(1, n_owners))
    return owner, np.unique(bucket, return_inverse=True)[1]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, n, places, bits): key names the image's bytes."""
    names = ["id", "key", "n", "places", "bits"]
    for batch in batches:
        out = []
        for own, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = image.as_py()
            places, bits = describe(decode(data))
            key = f"null {own}" if data is None else hashlib.sha256(data).hexdigest()
            out.append((key, len(places), places.astype(np.float32).tobytes(), bits.tobytes()))
        key, n, places, bits = zip(*out, strict=True) if out else ((),) * 4
        columns = [pa.array(key, pa.string()), pa.array(n, pa.int64()), pa.array(places, pa.binary()), pa.array(bits, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)


def _pack(block: pa.Table) -> pa.Table:
    """(block, data): the pictures of a block in rows of about PIECE_BYTES."""
    size = np.array([len(p) + len(b) for p, b in zip(block.column("places").to_pylist(), block.column("bits").to_pylist(), strict=True)])
    piece = (np.cumsum(size) - size) // PIECE_BYTES
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]).tolist()
    data, rows = [], block.select(["node", "places", "bits"])
    for n, end in zip(starts, [*starts[1:], len(block)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows.slice(n, end - n))
        data.append(sink.getvalue().to_pybytes())
    return pa.table({"block": block.column("block").slice(0, 1).to_pylist() * len(data), "data": pa.array(data, pa.binary())}, schema=_PIECES)


_PIECES = pa.schema([("block", pa.int32()), ("data", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(pieces: pa.Table) -> pa.Table:
    """Confirmed pairs (a, b) of pictures of two blocks, or of one, that share a key. Each pair that shares one is looked at unless those
    found before have already put both into one group, so the links are no more than the pictures."""
    first, second = (pieces.column(c)[0].as_py() for c in "ij")
    parts = [(block, pa.ipc.open_stream(data).read_all()) for block, data in zip(pieces.column("block").to_pylist(), pieces.column("data").to_pylist(), strict=True)]
    node = np.concatenate([t.column("node").to_numpy() for _, t in parts])
    side = np.repeat([block for block, _ in parts], [len(t) for _, t in parts])
    blobs = [list(zip(*(t.column(c).to_pylist() for c in ("places", "bits")), strict=True)) for _, t in parts]
    seen = [(np.frombuffer(p, np.float32).reshape(-1, 4), np.frombuffer(b, np.uint64).reshape(-1, 4)) for part in blobs for p, b in part]
    order = np.argsort(node, kind="stable")
    node, side, seen = node[order], side[order], [seen[n] for n in order]
    owner, bucket = _shared_keys(np.concatenate([bits for _, bits in seen]), np.repeat(np.arange(len(node)), [len(bits) for _, bits in seen]), len(node))
    n = np.bincount(bucket)
    # keys of one picture only, or of one block only where two meet, make no pairs
    of_first = np.bincount(bucket, side[owner] == first, len(n))
    use = ((n > 1) if first == second else (of_first > 0) & (of_first < n))[bucket]
    owner, bucket = owner[use], bucket[use]
    reach = np.bincount(owner, n[bucket], len(node))
    own_side = np.zeros(len(node), bool) if first == second else side == second
    # within a bucket by side, the hub of each first
    order = np.lexsort((owner, -reach[owner], own_side[owner], bucket))
    owner, bucket = owner[order], bucket[order]
    root, links, tested = np.arange(len(node)), [], np.zeros(0, np.int64)

    def look(a: np.ndarray, b: np.ndarray) -> None:
        """Confirm these pairs, those that share most keys first."""
        nonlocal tested
        codes, shared = np.unique(np.minimum(a, b) * len(node) + np.maximum(a, b), return_counts=True)
        new = ~np.isin(codes, tested, assume_unique=True)
        codes, shared = codes[new], shared[new]
        tested = np.union1d(tested, codes)
        for code in codes[np.argsort(-shared, kind="stable")].tolist():
            a, b = divmod(code, len(node))
            if root[a] != root[b] and inliers(*seen[a], *seen[b], LEAST_INLIERS) >= LEAST_INLIERS:
                links.append((node[a], node[b]))
                low, high = sorted((root[a], root[b]))
                root[root == high] = low

    if len(owner):
        start = np.r_[True, bucket[1:] != bucket[:-1]]
        begin = np.flatnonzero(start)[np.cumsum(start) - 1]
        if first == second:
            look(owner[begin[~start]], owner[~start])
        else:
            turn = np.flatnonzero(own_side[owner] & ~np.r_[False, own_side[owner][:-1] & ~start[1:]])  # where the second side begins, once a bucket
            turn = turn[np.cumsum(start) - 1]
            later = own_side[owner]
            look(np.r_[owner[begin[later]], owner[turn[~later]]], np.r_[owner[later], owner[~later]])
        # then whatever is still apart
        end = np.r_[np.flatnonzero(start)[1:], len(owner)][np.cumsum(start) - 1]
        at, step, held, a, b = np.arange(len(owner)), 1, 0, [], []
        while len(at):
            at = at[at + step < end[at]]
            p, q = owner[at], owner[at + step]
            apart = (root[p] != root[q]) & ((first == second) | (own_side[p] != own_side[q]))
            a.append(p[apart])
            b.append(q[apart])
            held, step = held + int(apart.sum()), step + 1
            if held >= LISTED or not len(at):
                look(np.concatenate(a), np.concatenate(b))
                held, a, b = 0, [], []
    return pa.table(dict(zip("ab", np.array(links, np.int64).reshape(-1, 2).T, strict=True)), schema=_LINKS)


def copies(media: DataFrame) -> DataFrame:
    """One row a row of ``media(id, image)``: id, n_corners, class_id (smallest id of the group), n_links, kept.

    n_links counts the confirmed pairs of the image with different ones; pairs within a group that are linked
    through others need no confirmation, and which of them do depends on how the blocks fall. Equal images, repeated rows among them, are one and are looked at once. A null,
    undecodable or featureless image is alike only to its equals; null images are each on their own. Null ids are never
    a group's smallest. Large pictures are looked at whole. An empty table gives an empty one; other columns are not read.
    """
    spark = media.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "images")
    kind = media.schema["id"].dataType.simpleString()
    # the pictures are read once and never shuffled, only what was found in them
    rows = media.select("id", "image").mapInArrow(_describe, f"id {kind}, key string, n long, places binary, bits binary")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    same = rows.groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.first("n").alias("n"))
    looked = scratch.save(same, "nodes")
    described = rows.select(F.col("row").alias("node"), "places", "bits")
    # blocks meet blocks, each two in a task: no pair is a row before it is confirmed
    blocks = max(1, -(-(looked.agg(F.sum("n")).first()[0] or 0) * CORNER_BYTES // BLOCK_BYTES))
    full = described.join(looked.filter("n > 0").select("node"), "node", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    pieces = scratch.save(full.groupBy("block").applyInArrow(_pack, "block int, data binary"), "pieces")
    meet = pieces.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "data")
    rounds = max(1, -(-blocks * blocks * BLOCK_BYTES // ROUND_BYTES))
    found = spark.createDataFrame([], "a long, b long")
    for n in range(rounds):
        some = meet.filter(F.pmod(F.xxhash64("i", "j"), F.lit(rounds)) == n)
        met = some.repartition(max(1, blocks * (blocks + 1) // 2 // rounds), "i", "j").groupBy("i", "j").applyInArrow(_compare, "a long, b long")
        found = found.union(scratch.save(met, f"confirmed-{n}"))
    # each confirmed pair is a bucket of its own
    confirmed = scratch.save(found.withColumn("bucket", F.monotonically_increasing_id()), "confirmed")
    members = confirmed.select(F.explode(F.array("a", "b")).alias("node"), "bucket")
    _, roots = linked_groups(members, lambda pairs, _: pairs, lambda apart, every: (apart, every, F.lit(True)), scratch)
    degree = members.groupBy("node").agg(F.count("*").alias("n_links"))
    known = looked.join(roots, "node", "left").join(degree, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    heads = known.groupBy("root").agg(F.min("least_id").alias("class_id"))
    known = known.join(heads, "root").select(F.col("key").alias("its_key"), F.col("n").alias("n_corners"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = rows.select("id", "key").join(known, F.col("key") == F.col("its_key"))
    return out.select("id", "n_corners", "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def drawing(vector: np.ndarray, number: int) -> bytes:
    """A picture for a vector, as the tables hold none: the order of its three largest components
    picks shapes and grain; the number picks a crop, a contrast, a brightness and noise. So vectors that
    point the same way mostly give edited copies of one picture."""
    big = np.argsort(-np.abs(vector), kind="stable")[:3]
    rng = np.random.default_rng([*(int(b) * 2 + int(vector[b] < 0) for b in big), 77])
    picture = np.full((96, 96), 120.0)
    for _ in range(40):
        y, x, h, w = rng.integers(0, 90), rng.integers(0, 90), rng.integers(6, 30), rng.integers(6, 30)
        picture[y : y + h, x : x + w] = rng.integers(10, 245)
    picture += _box(_box(rng.normal(0, 1, (96, 96)), 1), 1) * 5
    edit = np.random.default_rng([number & (1 << 63) - 1, 78])
    top, left, bottom, right = edit.integers(0, 9, 4)
    cut = picture[top : 96 - bottom, left : 96 - right]
    return encode((cut - 128) * edit.uniform(0.75, 1.1) + 128 + edit.uniform(-10, 10) + edit.normal(0, 1.5, cut.shape))


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        drawn = []
        for n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = np.nan_to_num(np.array([0.0 if x is None else x for x in v or []]))
            drawn.append(drawing(v, n or 0) if len(v) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn, pa.binary())], ["id", "image"])


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    media = vectors.mapInArrow(_draw, "id long, image binary")
    return copies(media).withColumnRenamed("id", "vec_id")
