"""Near-duplicate documents by MinHash, banding, verification and connected components.

Documents with equal sets of word shingles are one class, found by a 128-bit
digest of the set; only classes are compared.  Each class has many universal
hash minima; bands of minima give buckets.  Within a bucket not all pairs are
formed: every class meets the bucket's least class and one drawn by a hash,
pairs are verified by their minima and then on full sets, and links become
components.  A bucket whose classes already lie in one component has nothing to
add.  Of the others, small ones form the pairs between their components; large
ones are dealt out in blocks, in which the classes of the smaller components
are held against all others on full sets, and only links come out.  So each
pair that shares a bucket is either verified or lies inside a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import scratch, slots, text_of, written
from cellmill.llm.components import connected_components
from cellmill.llm.splits import hashed, mix

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class MinHashParams:
    """words: words of a shingle.  similar: documents are linked if 100 * |intersection| >= similar * |union|.

    bands * rows minima; a pair at the threshold shares no band with probability (1 - (similar / 100)**rows)**bands, which
    is 7e-9 at 85 and 2e-6 at 80 for the given numbers.  Pairs whose minima agree in a share that lies more than slack under
    the threshold, over six standard deviations, are not confirmed on full sets.
    member_limit, small_bucket, block_rows: sizes of groups in verification; they bound memory and drop nothing.
    """

    words: int = 5
    similar: int = 80
    bands: int = 32
    rows: int = 5
    slack: float = 0.2
    member_limit: int = 250
    small_bucket: int = 16
    block_rows: int = 3000
    seed: int = 5


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.  Texts with fewer words than a shingle have one, of all their
    words.  A text is held as a whole, with some 10 bytes per byte and 60 per word."""
    raws = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) < 1 << 20):
            size += len(raws[end]) + 1
            end += 1
        out += _block(raws[at:end], words)
        at = end
    return out


def _block(raws: list[bytes], words: int) -> list[np.ndarray]:
    joined = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    gap = (joined == 0x20) | ((joined >= 0x09) & (joined <= 0x0D))
    before = np.concatenate([[True], gap[:-1]])
    begin, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    named = hashed(joined, begin, end)
    edges = np.searchsorted(begin, np.cumsum([0] + [len(r) + 1 for r in raws]))
    out = []
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        own = named[a:b]
        k = min(words, len(own))
        if not k:
            out.append(np.zeros(0, U))
            continue
        n = len(own) - k + 1
        value = np.full(n, U(k), U)
        for j in range(k):
            value = mix(value * _BASE + own[j : j + n])
        out.append(np.unique(value))
    return out


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each universal hash a * x + b modulo 2**32, over a set."""
    x = (values >> U(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (a[:, None] * x[None, i : i + 2048] + b[:, None]).min(1))
    return low


def _family(p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(p.seed)
    n = p.bands * p.rows
    return r.integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n).astype(np.uint32)


def signatures(df: DataFrame, id_col: str, text_col: str, p: MinHashParams) -> DataFrame:
    """id, n_shingles, set_key (128-bit digest of the set; null if empty), minima (16 bits each), bands array<long>."""

    def sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(p)
        for whole in rows:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = shingle_sets(batch.column(1).to_pylist(), p.words)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                known: dict[bytes, tuple[bytes, np.ndarray]] = {}
                for key, s in zip(keys, sets, strict=True):
                    if key is not None and key not in known:
                        low = minima(s, a, b)
                        band = np.zeros(p.bands, U) + np.arange(p.bands, dtype=U)
                        for j in range(p.rows):
                            band = mix(band * _BASE + low[j :: p.rows].astype(U))
                        known[key] = ((low >> np.uint32(16)).astype("<u2").tobytes(), band.view(np.int64))
                flat = [known[k][1] for k in keys if k is not None]
                ends = np.cumsum([0] + [p.bands * (k is not None) for k in keys])
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                counts = pa.array([len(s) for s in sets], pa.int64())
                low = pa.array([None if k is None else known[k][0] for k in keys], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(keys, pa.binary()), low, bands], ["id", "n_shingles", "set_key", "minima", "bands"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(df, text_col).alias("_text"))
    return rows.mapInArrow(sign, "id long, n_shingles long, set_key binary, minima binary, bands array<long>")


def _sets(texts: DataFrame, p: MinHashParams) -> DataFrame:
    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = shingle_sets(batch.column(1).to_pylist(), p.words)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

    return texts.mapInArrow(make, "id long, shingles binary")


def _likely(pairs: DataFrame, low: DataFrame, p: MinHashParams) -> DataFrame:
    """Pairs (u, v) whose minima agree often enough."""
    left, right = low.select(F.col("id").alias("u"), F.col("minima").alias("_a")), low.select(F.col("id").alias("v"), F.col("minima").alias("_b"))
    least = (p.similar / 100 - p.slack) * p.bands * p.rows

    def agree(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.num_rows
            if n:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(n, -1) for k in (2, 3))
                keep = pa.array((a == b).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    both = pairs.join(left, "u").select("v", "u", "_a").join(right, "v").select("u", "v", "_a", "_b")
    return both.mapInArrow(agree, "u long, v long")


def _confirm(pairs: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """Pairs (u, v) that are similar on full sets.

    The set of v travels to u.  A u of very many pairs is dealt out in salted groups of about member_limit pairs, each with
    a copy of its set, and a task reads its groups in order, holding one set of a u at a time.
    """
    pairs = written(pairs, "near-pairs")
    salts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / p.member_limit).cast("int").alias("_n"))
    salts = written(salts, "near-salts")
    members = pairs.join(salts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("_n")).cast("int").alias("salt"), F.col("v").alias("id"))
    centres = salts.select("u", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("salt"), F.col("u").alias("id"))
    rows = members.unionAll(centres).join(sets, "id").select("u", "salt", (F.col("id") != F.col("u")).alias("member"), "id", "shingles")
    sized = rows.repartition(slots(pairs.sparkSession), "u", "salt").sortWithinPartitions("u", "salt", "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, U)
        for batch in batches:
            us, vs = [], []
            for u, member, i, raw in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                s = np.frombuffer(raw, U)
                if not member:
                    centre, own = u, s
                    continue
                if u != centre:
                    raise RuntimeError("a group came without its centre")
                small, large = (s, own) if len(s) < len(own) else (own, s)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                if 100 * both >= p.similar * (len(s) + len(own) - both):
                    us.append(u), vs.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return sized.mapInArrow(compare, "u long, v long")


def _in_blocks(open_members: DataFrame, mixed: DataFrame, sets: DataFrame, low: DataFrame, p: MinHashParams) -> DataFrame:
    """Links (u, v) between different components of large buckets.

    A bucket of n classes is dealt into n / block_rows blocks by a hash, and each pair of blocks is a group.  A pair of
    classes that shares several buckets is compared in that of the first band.
    """
    blocks = mixed.select("key", F.ceil(F.col("n") / p.block_rows).cast("int").alias("_b"))
    placed = open_members.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("_b")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    placed = placed.select("key", "id", "label", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    rows = placed.join(low.select("id", "bands"), "id").join(sets, "id")

    def compare(t: pa.Table) -> pa.Table:
        ids, label, own = (t.column(c).to_numpy() for c in ("id", "label", "own"))
        n = len(ids)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
        band = int(np.flatnonzero(bands[0] == t.column("key")[0].as_py())[0])
        tokens = [np.frombuffer(x, U) for x in t.column("shingles").to_pylist()]
        size = np.array([len(x) for x in tokens])
        end = np.cumsum(size)
        known, which = np.unique(np.concatenate(tokens), return_inverse=True)
        _, group, count = np.unique(label, return_inverse=True, return_counts=True)
        order = np.lexsort((label, count[group]))  # members of the largest component come last
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        apart = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        us, vs = [], []
        for x in order[: n - int(count.max())].tolist():
            need = (place > place[x]) & (label != label[x]) & (100 * np.minimum(size, size[x]) >= p.similar * np.maximum(size, size[x]))
            if apart:
                need &= own != own[x]
            if band:
                need &= ~(bands[:, :band] == bands[x, :band]).any(1)
            if not need.any():
                continue
            mark = np.zeros(len(known), bool)
            mark[which[end[x] - size[x] : end[x]]] = True
            some = np.flatnonzero(need)
            if len(some) * 4 < n:
                both = np.array([mark[which[end[y] - size[y] : end[y]]].sum() for y in some.tolist()])
            else:
                sums = np.concatenate([[0], np.cumsum(mark[which])])
                both = (sums[end] - sums[end - size])[some]
            linked = some[100 * both >= p.similar * (size[some] + size[x] - both)]
            us.append(np.full(len(linked), ids[x])), vs.append(ids[linked])
        u, v = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (us, vs))
        return pa.table({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})

    return rows.groupBy("key", "lo", "hi").applyInArrow(compare, "u long, v long")


def _components(df: DataFrame, id_col: str, text_col: str, p: MinHashParams) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and the component of each set_key; both written."""
    signed = written(signatures(df, id_col, text_col, p), "near-signatures")
    named = signed.where("set_key IS NOT NULL AND id IS NOT NULL")
    classes = written(named.groupBy("set_key").agg(F.min("id").alias("cid")), "near-classes")
    # a row of the least id of each class stands for it
    firsts = named.join(classes, "set_key").where("id = cid").select("id", "minima", "bands")
    firsts = written(firsts, "near-firsts")
    low = firsts.dropDuplicates(["id"])
    banded = firsts.select("id", F.explode("bands").alias("key"))
    drawn = F.min_by("id", F.xxhash64("id", "key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"), drawn.alias("rep2")).where("n > 1")
    buckets = written(buckets, "near-buckets")
    members = written(banded.join(buckets, "key").select("key", "id", "rep", "rep2", "n"), "near-members")

    ids = written(members.select("id").distinct(), "near-ids")
    texts = df.select(F.col(id_col).cast("long").alias("id"), text_of(df, text_col).alias("_text")).join(ids, "id", "left_semi")
    sets = written(_sets(texts, p).dropDuplicates(["id"]), "near-sets")
    low = written(low.join(ids, "id", "left_semi"), "near-minima")

    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    met = members.select("id", F.explode(F.array_distinct(F.array("rep", "rep2"))).alias("rep")).where("id <> rep")
    tested = written(_likely(met.select(*ordered(F.col("id"), F.col("rep"))).distinct(), low, p), "near-likely")
    links = written(_confirm(tested, sets, p), "near-links")
    labels = written(connected_components(links), "near-labels")

    labelled = members.where("n > 2").select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")  # of two, the only pair is verified
    labelled = written(labelled.select("key", "id", F.coalesce("component", "id").alias("label")), "near-labelled")
    parts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = written(parts.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1"), "near-mixed")
    open_members = written(labelled.join(mixed.select("key", "n"), "key"), "near-open")
    small = open_members.where(F.col("n") <= p.small_bucket)
    other = small.select("key", F.col("id").alias("id2"), F.col("label").alias("label2"))
    between = small.join(other, "key").where("label < label2").select(*ordered(F.col("id"), F.col("id2"))).distinct()
    new = written(_likely(between.join(tested, ["u", "v"], "left_anti"), low, p), "near-likely")
    large = open_members.where(F.col("n") > p.small_bucket).drop("n")
    more = _confirm(new, sets, p).unionAll(_in_blocks(large, mixed.where(F.col("n") > p.small_bucket), sets, low, p))
    more = written(more, "near-links")
    if not more.isEmpty():
        stars = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        labels = written(connected_components(stars.unionAll(more)), "near-labels")

    joined = classes.join(labels, F.col("cid") == F.col("node"), "left").select("set_key", F.coalesce("component", "cid").alias("component_id"))
    joined = written(joined, "near-components")
    return signed, joined


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: MinHashParams = MinHashParams()) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (least id reachable over links), kept (it is its own id).

    Letters A-Z count as a-z and words are parted by ASCII white space.  Texts without words, null ones too, have no
    shingles and are linked with nothing.  Rows with a null id are linked with nothing and kept, with a null component.
    Rows that repeat an id share its component.  An empty table gives an empty result; see shingle_sets for very long texts.
    """
    with scratch(df.sparkSession) as s:
        signed, joined = _components(df, id_col, text_col, p)
        s.keep(signed)
        s.keep(joined)
    rows = signed.select("id", "n_shingles", "set_key").join(joined, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
