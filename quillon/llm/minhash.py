"""Near-duplicate documents by MinHash bands, verified by odd sketches and then on full shingle sets.

1. Rows with the same shingle set form a class, which gets a number. The row of its smallest doc_id goes on.
2. Its MinHash samples give band keys and an odd sketch: every sample flips one bit of a parity bitmap, so the XOR of
   two sketches counts the samples that differ, most precisely where similarity is high.
3. In every band bucket each member meets the smallest member, and takes the one it shares most bands with. Pairs whose
   sketches are too far apart for the threshold are dropped (the bound lies six standard deviations out), the others
   compared on full sets; this joins most groups, and step 4 finds what is left.
4. Links give components. In buckets whose members are in different components, sketches find the members that may
   be linked across components; these fall into families. Buckets with very many members are first dealt anew by their
   members' other bands, which joins most, and then compared whole where they are still in different components, so
   that their size decides on the work alone. In each family, in blocks, every class outside the family's largest component is held against
   all its classes by an inverted index of full sets, and of the links found those that join components are kept. So no
   link between components is lost, and no pairs are made.

Two documents of similarity 0.8 share no band with probability (1 - 0.8^5)^40 = 1.3e-7; more similar ones less.
Bands, sketches and bounds are set for this, so smaller similarities are refused.
Null text, or text without words, has an empty set and is linked with nothing. Rows without doc_id are not compared.
Rows that repeat a doc_id are one document: their sets are linked, whatever they are, and so is all that any is linked with.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, mix64, partitions, short
from quillon.llm.components import components
from quillon.llm.shingles import shingle_sets

BANDS, ROWS = 40, 5
SKETCH_WORDS = 8
#: Differing bits of two sketches at most. At similarity 0.8, 200 samples and 512 bits: mean 69, deviation 10.
MOST_BITS = 130
#: Members of a bucket or family that one task compares with as many others; of large ones more, so that the copies
#: made of a member grow with the root of their number. A bucket of more than MANY is first dealt anew by other bands, to
#: have less to compare when it is compared whole.
CHUNK, MANY = 1024, 8192
#: Members that one task compares.
TASK = 2048
#: Compressed bytes of texts that a chunk holds on average at most.
CHUNK_BYTES = 8 << 20
#: Hundredths of similarity that the bands and the sketches' bound are made for.
LEAST_SHARE = 80

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_SALT = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def minimums(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of one set."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        np.minimum(least, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=least)
    return least


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches, a row of SKETCH_WORDS integers per row of samples."""
    bits = 64 * SKETCH_WORDS
    at = (mix64(samples.astype(np.uint64) + _SALT) >> np.uint64(40)).astype(np.int64) % bits
    flips = np.bincount((at + np.arange(len(at))[:, None] * bits).ravel(), minlength=len(at) * bits).reshape(-1, bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1).view("<i8").reshape(-1, SKETCH_WORDS)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key per band and row of samples; the band's number is part of it."""
    by_band = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), by_band.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E6C63D0876A9A47) + by_band[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, same (a digest of the text), n_shingles, set_a and set_b (a 128-bit digest of the set), bands, sketch."""
    schema = "doc_id bigint, same bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>"

    def run(batches):
        for b in short(batches):
            counts, digests, samples = [], [], []
            for s in shingle_sets(b.column(2), size):
                counts.append(len(s))
                digests.append((mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64)))
                samples.append(minimums(s))
            if not counts:
                continue
            samples = np.array(samples).reshape(-1, BANDS * ROWS)
            digests = np.array(digests, np.uint64).view(np.int64)
            flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), flat(band_keys(samples)), flat(sketches(samples))],
                names=["doc_id", "same", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )

    return _texts(docs).mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("same"), "text")


def _apart(x: str, y: str) -> Column:
    """Bits in which two sketches differ."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_WORDS)])


def _squeezed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc and the compressed text z of the wanted rows (doc, doc_id, same)."""

    def squeeze(batches):
        zip_up = zstandard.ZstdCompressor(level=1)
        for b in short(batches, 128):
            texts = [zip_up.compress((t or "").encode()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["doc_id", "same", "z"])

    known = _texts(docs).where(F.col("doc_id").isNotNull())
    # rows that repeat the id and the text give the same z
    return known.mapInArrow(squeeze, "doc_id bigint, same bigint, z binary").join(wanted, ["doc_id", "same"]).select("doc", "z").dropDuplicates(["doc"])


def _sets_of(column, size: int) -> list[np.ndarray]:
    unzip = zstandard.ZstdDecompressor()
    return list(shingle_sets(pa.array([unzip.decompress(z.as_py()) for z in column], pa.binary()), size))


def _linked(pairs: DataFrame, chosen: DataFrame, docs: DataFrame, size: int, share: int) -> DataFrame:
    """The pairs (a, b) that are linked on full sets. Texts travel compressed, once for each pair."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(chosen.select("doc", "doc_id", "same"), "doc")
    kept, at = materialize(docs.sparkSession, _squeezed(docs, wanted), "texts")

    def compare(batches):
        known: dict[int, np.ndarray] = {}
        for b in short(batches):
            needed = {}
            for ids, texts in ((0, 2), (1, 3)):
                for i, z in zip(b.column(ids).to_pylist(), b.column(texts), strict=True):
                    if i not in known:
                        needed[i] = z
            known.update(zip(needed, _sets_of(needed.values(), size), strict=True))
            verdicts = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s, t = known[x], known[y]
                shared = len(np.intersect1d(s, t, assume_unique=True))
                verdicts.append(100 * shared >= share * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(verdicts, pa.bool_()))
            if sum(map(len, known.values())) > 4_000_000:
                known.clear()

    left, right = kept.select(F.col("doc").alias("a"), F.col("z").alias("za")), kept.select(F.col("doc").alias("b"), F.col("z").alias("zb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb")
    out, _ = materialize(docs.sparkSession, joined.mapInArrow(compare, "a bigint, b bigint").distinct(), "links")
    discard(docs.sparkSession, at)
    return out


def _dealt(members: DataFrame, group: str, *columns: str, rows: int, weight: Column | None = None) -> DataFrame:
    """group, r, c, rest, doc, comp and the columns: members of groups with several components, in blocks.

    rows: how many members there are, by which the blocks are dealt to tasks: their work is not in their bytes.
    weight: bytes of a member, by which the chunks are bounded as well. A group's largest component is compared with the rest only. Large groups are dealt in chunks; each chunk of the
    rest meets each chunk of all.
    """
    n_of = members.groupBy(group, "comp").agg(F.count("*").alias("n"), F.sum(F.lit(0) if weight is None else weight).alias("b"))
    main = n_of.groupBy(group).agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("comps"), F.max(F.struct("n", "comp", "b")).alias("m"))
    size = F.greatest(F.lit(float(CHUNK)), F.sqrt(F.col("n") * (CHUNK / 16)))
    parts = lambda n, b: F.ceil(F.greatest(n / size, b / CHUNK_BYTES)).cast("int")
    dealt = members.join(main.where("comps > 1"), group).withColumn("rests", parts(F.col("n") - F.col("m.n"), F.col("b") - F.col("m.b"))).withColumn("chunks", parts(F.col("n"), F.col("b")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    chunk = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    one = dealt.where(F.col("comp") != F.col("main")).select(group, chunk("rests").alias("r"), spread("chunks").alias("c"), F.lit(True).alias("rest"), "doc", "comp", *columns)
    other = dealt.select(group, spread("rests").alias("r"), chunk("chunks").alias("c"), F.lit(False).alias("rest"), "doc", "comp", *columns)
    # dealt anew by block: by group alone, a large group would stay in one task
    tasks = min(4 * partitions(members.sparkSession), rows // TASK + 1)
    return one.union(other).repartition(tasks, group, "r", "c")


class _Joined:
    """Which components a task has joined so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _may_link(group: pa.Table) -> pa.Table:
    """Members whose sketch is near that of a member of another component, and which components that joins.

    Rows (doc, comp, other): a member, or with doc null two components.
    """
    x, y = (group.filter(pa.compute.equal(group["rest"], v)) for v in (True, False))
    sx, sy = (np.array(t["sketch"].combine_chunks().flatten()).reshape(-1, SKETCH_WORDS).view(np.uint64) for t in (x, y))
    dx, dy, cx, cy = x["doc"].to_numpy(), y["doc"].to_numpy(), x["comp"].to_numpy(), y["comp"].to_numpy()
    docs, edges, joined = {}, [], _Joined()
    hit = np.zeros(len(dy), bool)
    for i in range(len(dx)):
        near = (np.bitwise_count(sx[i] ^ sy).sum(axis=1) <= MOST_BITS) & (cy != cx[i])
        if near.any():
            docs[int(dx[i])] = int(cx[i])
            hit |= near
            edges += [(int(cx[i]), c) for c in np.unique(cy[near]).tolist() if joined.join(int(cx[i]), c)]
    docs |= dict(zip(dy[hit].tolist(), cy[hit].tolist(), strict=True))
    kinds = pa.int64()
    return pa.table({"doc": pa.array([*docs, *[None] * len(edges)], kinds), "comp": pa.array([*docs.values(), *[e[0] for e in edges]], kinds), "other": pa.array([*[None] * len(docs), *[e[1] for e in edges]], kinds)})


def _links(group: pa.Table, size: int, share: int) -> pa.Table:
    """Links between components in a block of a family, as many as join them: a, b."""
    x, y = (group.filter(pa.compute.equal(group["rest"], v)) for v in (True, False))
    if not x.num_rows or not y.num_rows:  # a chunk may be empty
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    sets = _sets_of(y["z"].combine_chunks(), size)
    counts = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    dy, cy = y["doc"].to_numpy(), y["comp"].to_numpy()
    found, joined = [], _Joined()
    for doc, comp, s in zip(x["doc"].to_pylist(), x["comp"].to_pylist(), _sets_of(x["z"].combine_chunks(), size), strict=True):
        begin = np.searchsorted(flat, s, side="left")
        n = np.searchsorted(flat, s, side="right") - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((100 * shared >= share * (len(s) + counts - shared)) & (cy != comp))
        found += [(min(doc, int(dy[j])), max(doc, int(dy[j]))) for j in near if joined.join(comp, int(cy[j]))]
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _split(labelled: DataFrame) -> DataFrame:
    """Keys whose members are in different components, with the number of members."""
    return labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x < y").select("key", "n")


def _across(members: DataFrame, parts: DataFrame, chosen: DataFrame, docs: DataFrame, size: int, share: int, *, whole: bool = False) -> DataFrame:
    """The links that join components in buckets with more than one. whole: large buckets are not dealt anew first."""
    spark = docs.sparkSession
    labelled = members.select("key", "doc").join(parts.withColumnRenamed("id", "doc"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    torn, torn_at = materialize(spark, labelled.join(_split(labelled), "key"), "torn")
    large = torn.where(F.lit(not whole) & (F.col("n") > MANY))
    dealt = torn.where(F.lit(whole) | (F.col("n") <= MANY)).select("key", "doc", "comp")
    twice = not large.isEmpty()
    if twice:
        # nearly all members of similarity 0.8 or more share another band, too
        bands = chosen.join(large.select("doc").distinct(), "doc", "left_semi").select("doc", F.explode("bands").alias("band"))
        finer = large.join(bands, "doc").where("band <> key").select(F.xxhash64("key", "band").alias("key"), "doc", "comp")
        dealt = dealt.union(finer.join(_split(finer).select("key"), "key", "left_semi").select("key", "doc", "comp"))
    blocks = _dealt(dealt.join(chosen.select("doc", "sketch"), "doc"), "key", "sketch", rows=torn.count())
    may, may_at = materialize(spark, blocks.groupBy("key", "r", "c").applyInArrow(_may_link, "doc bigint, comp bigint, other bigint").distinct(), "may")
    families = components(may.where("doc is null").select(F.col("comp").alias("a"), F.col("other").alias("b")))
    of_family = may.where("doc is not null").select("doc", "comp").distinct().join(families.select(F.col("id").alias("comp"), F.col("comp").alias("family")), "comp")
    listed, listed_at = materialize(spark, of_family, "families")
    texts = _squeezed(docs, listed.select("doc").distinct().join(chosen.select("doc", "doc_id", "same"), "doc"))
    given, given_at = materialize(spark, listed.join(texts, "doc"), "family-texts")
    found = _dealt(given, "family", "z", rows=listed.count(), weight=F.octet_length("z")).groupBy("family", "r", "c").applyInArrow(lambda g: _links(g, size, share), "a bigint, b bigint").distinct()
    out, _ = materialize(spark, found, "links")
    discard(spark, may_at, listed_at, given_at)
    if twice:
        # those that share this one band only are found as in any other bucket
        joined = components(parts.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(out))
        out = out.union(_across(large.select("key", "doc"), joined, chosen, docs, size, share, whole=True))
    discard(spark, torn_at)
    return out


def near_duplicates(docs: DataFrame, *, size: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; size: words a shingle, share: similarity in hundredths."""
    if not LEAST_SHARE <= share <= 100:
        raise ValueError(f"bands and sketches are made for similarities from {LEAST_SHARE} to 100 hundredths")
    spark = docs.sparkSession
    signed, signed_at = materialize(spark, signatures(docs, size), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    sets = usable.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "same")).alias("rep"))
    # a class's number is fixed as the table is written; numbers follow the order of doc_id, so that copies meet what they are copied from
    in_order = sets.select("set_a", "set_b", "rep.doc_id", "rep.same").repartitionByRange(partitions(spark), "doc_id", "set_a", "set_b").sortWithinPartitions("doc_id", "set_a", "set_b")
    classes, classes_at = materialize(spark, in_order.withColumn("doc", F.monotonically_increasing_id()), "classes")
    chosen, chosen_at = materialize(spark, usable.join(classes, ["set_a", "set_b", "doc_id", "same"]).select("doc", "doc_id", "same", "bands", "sketch").dropDuplicates(["doc"]), "chosen")
    rows, rows_at = materialize(spark, usable.select("doc_id", "n_shingles", "set_a", "set_b").join(classes.select("set_a", "set_b", "doc"), ["set_a", "set_b"]).select("doc_id", "n_shingles", "doc"), "rows")
    again = rows.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("last")).where("a < last").select("doc_id", "a")
    same_id, same_at = materialize(spark, rows.join(again, "doc_id").where("doc <> a").select("a", F.col("doc").alias("b")).distinct(), "same-id")
    dealt = chosen.select(F.explode("bands").alias("key"), "doc")
    buckets, buckets_at = materialize(spark, dealt.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key", "least"), "buckets")
    members, members_at = materialize(spark, dealt.join(buckets, "key"), "members")
    # of the smallest members that a class meets, the one it shares most bands with: one row a class, however large the group
    star = members.where("doc <> least").groupBy(F.col("least").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("n"))
    best = star.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("last"))).alias("x")).select("b", (-F.col("x.last")).alias("a"))
    sketch = chosen.select("doc", "sketch")
    near = (
        best.join(sketch.select(F.col("doc").alias("b"), F.col("sketch").alias("sb")), "b")
        .join(sketch.select(F.col("doc").alias("a"), F.col("sketch").alias("sa")), "a")
        .where(_apart("sa", "sb") <= MOST_BITS)
        .select("a", "b")
    )
    near, near_at = materialize(spark, near, "near")
    links = _linked(near, chosen, docs, size, share).union(same_id)
    parts = components(links)
    more = _across(members, parts, chosen, docs, size, share)
    if not more.isEmpty():
        parts = components(links.union(more))
    placed = classes.select("doc", "doc_id").join(parts.withColumnRenamed("id", "doc"), "doc", "left").select("doc", "doc_id", F.coalesce("comp", "doc").alias("comp"))
    first = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named, named_at = materialize(spark, placed.join(first, "comp").select("doc", "component_id"), "placed")
    light = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found, _ = materialize(spark, rows.join(named, "doc").select("doc_id", "n_shingles", "component_id").union(light), "groups")
    discard(spark, signed_at, classes_at, chosen_at, rows_at, same_at, buckets_at, members_at, near_at, named_at)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, size: int = 5, share: int = 80) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; rows without doc_id stay."""
    gone = near_duplicates(docs, size=size, share=share).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
