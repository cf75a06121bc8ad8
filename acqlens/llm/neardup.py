"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, verification on full shingle sets.

1. Texts with the same set of five-word shingles form one class (a copy group is
   summed before the shuffle), and only classes are compared.
2. Band and row counts follow from the target recall (``banding``). Classes that
   share a band hash hang on the least class of the bucket, so a bucket of m
   classes makes m - 1 edges, never m^2 pairs.
3. Components of these edges are the candidate groups. Every link with a band
   collision lies inside one. Chance collisions can chain many texts over one template
   into a large group although few of them are similar, so a group of more than one
   chunk is tightened without loss (``_tightened``): two sets with a Jaccard similarity
   of t share one of the q - ceil(t q) + 1 shingles of each that come first in any
   common order. The order is by how often a shingle occurs in large groups, so what
   all copies of a template share comes last. Texts that share such a shingle form
   the new, smaller groups.
4. Inside a group all pairs are verified on the full shingle sets. Small groups
   are dealt together to tasks of bounded size; a large one is cut into chunks and
   each pair of chunks is a task, so one group is spread over many tasks. The
   tasks return one row per class (its number of links and the least class it is
   joined with), not the pairs.

Result per input row: ``class_id``, the least id of its group (transitively
linked rows), and ``n_links``, the number of other rows whose shingle sets have a
similarity of at least the threshold.

Defined cases: a null or word-free text has no shingles and no links (its class
is its own id). A text of one to four words has one shingle of all its words.
Repeated rows count as copies of each other. A null id is kept; it is the class
id only where a group has no other id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acqlens.llm import words as W
from acqlens.llm.components import components
from acqlens.llm.storage import bitmap, few, filter_bits, held, list_of, now_named, set_aside, settle

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.995
CHUNK_SHINGLES = 1 << 20  # shingles of one chunk of classes (8 MB of keys)
CHUNK_CLASSES = 1024
CELLS = 1 << 16  # cells of the table of shingle counts that orders the shingles of large groups (512 kB)
PACK_SHINGLES = CHUNK_SHINGLES >> 3  # shingles that small groups bring to a task, on average at most
DENSE = 64  # shingles in more classes than this are counted by matrix product


def banding(threshold: float = THRESHOLD, recall: float = RECALL, chance: float = 0.02) -> tuple[int, int]:
    """(bands, rows) with the fewest hashes that find a pair at the threshold with
    probability ``recall`` and one at half the threshold with at most ``chance``."""
    for rows in range(1, 64):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= chance:
            return bands, rows
    raise ValueError("no banding meets these targets")


def minima(values: np.ndarray, starts: np.ndarray, n: int, seed: int = 3) -> Iterator[np.ndarray]:
    """n MinHash values (32 bits) of each run of shingle keys that begins at ``starts``."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    factor = (W.stream(seed, n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shift = (W.stream(seed + 1, n) >> np.uint64(32)).astype(np.uint32)
    for k in range(n):
        yield np.minimum.reduceat(high * factor[k] + shift[k], starts)


def _digest(sorted_keys: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_keys.tobytes(), digest_size=16).digest()


def _digests(values: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes | None], np.ndarray]:
    """For each document the digest and size of its shingle set; None without shingles."""
    digests: list[bytes | None] = []
    sizes = np.zeros(len(bounds) - 1, dtype=np.int32)
    for d in range(len(bounds) - 1):
        keys = np.unique(values[bounds[d] : bounds[d + 1]])
        sizes[d] = len(keys)
        digests.append(_digest(keys) if len(keys) else None)
    return digests, sizes


def _marks(digests: list[bytes | None]) -> np.ndarray:
    return np.array([int.from_bytes(x[:8], "little") if x else 0 for x in digests], dtype=np.uint64)


def signer(bands: int, rows: int):
    """Arrow function: (id, text) to (id, cls, mark, size, bands); mark is a part of cls as a number."""

    def sign(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                values, bounds = W.shingles(batch.column("text"), SHINGLE)
                digests, sizes = _digests(values, bounds)
                there = np.diff(bounds) > 0
                keys = np.zeros((int(there.sum()), bands), dtype=np.uint64)
                if len(keys):
                    low = minima(values, bounds[:-1][there], bands * rows)
                    for band in range(bands):
                        total = np.full(len(keys), band + 1, dtype=np.uint64)
                        for _ in range(rows):
                            total = (total ^ next(low)) * W.STEP
                            total ^= total >> np.uint64(29)
                        keys[:, band] = W.mix(total)
                ends = np.concatenate([[0], np.cumsum(there * bands)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(digests, type=pa.binary()), pa.array(_marks(digests).view(np.int64)),
                     pa.array(sizes), list_of(keys.reshape(-1).view(np.int64), ends, pa.int64())],
                    names=["id", "cls", "mark", "size", "bands"])

    return sign


def _passing(bits: np.ndarray):
    """Arrow function: (text) to (cls, text) for the texts whose class may be a candidate."""

    def keep(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                digests, _ = _digests(*W.shingles(batch.column("text"), SHINGLE))
                ok = held(bits, _marks(digests)) & np.array([x is not None for x in digests], dtype=bool)
                if ok.any():
                    kept = pa.RecordBatch.from_arrays(
                        [pa.array(digests, type=pa.binary()), batch.column("text")], names=["cls", "text"])
                    yield kept.filter(pa.array(ok))

    return keep


def _cells(keys: np.ndarray) -> np.ndarray:
    return (W.mix(keys) >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def _count_cells(batches):
    """Arrow function: (text) to (cell, n), the shingles of each cell, summed over the task."""
    total = np.zeros(CELLS, dtype=np.int64)
    for whole in batches:
        for batch in W.slices(whole, "text"):
            values, _ = W.shingles(batch.column("text"), SHINGLE)
            total += np.bincount(_cells(values), minlength=CELLS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])


def prefix(keys: np.ndarray, often: np.ndarray, threshold: float) -> np.ndarray:
    """Those keys of a set, rarest first, of which it shares one with every set as similar as the threshold."""
    need = max(1, math.ceil(threshold * len(keys) - 1e-9))
    return keys[np.lexsort((keys, often[_cells(keys)]))[: len(keys) - need + 1]]


def _prefixes(often: np.ndarray, threshold: float):
    """Arrow function: (node, root, text) to (node, root, keys)."""

    def first(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                values, bounds = W.shingles(batch.column("text"), SHINGLE)
                keys = [prefix(np.unique(values[a:b]), often, threshold).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("root"), pa.array(keys, type=pa.list_(pa.int64()))], names=["node", "root", "keys"])

    return first


def _bucket_edges(members: DataFrame, *key: str) -> DataFrame:
    """Each node of a bucket hangs on the bucket's least node; a bucket of m nodes makes m - 1 edges."""
    least = members.groupBy(*key).agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(least, list(key)).select("node", "low").where("node <> low")


def _tightened(large: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of the smaller groups within large ones: nodes joined by shingles of their prefixes."""
    with_text = large.select("node", "root", "cls").join(texts, "cls").select("node", "root", "text")
    counts = with_text.select("text").mapInArrow(_count_cells, "cell bigint, n bigint").groupBy("cell").agg(
        F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    often = np.zeros(CELLS, dtype=np.int64)
    often[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    keyed = settle(with_text.mapInArrow(_prefixes(often, threshold), "node bigint, root bigint, keys array<bigint>"))
    return components(_bucket_edges(keyed.select("node", "root", F.explode("keys").alias("key")), "root", "key"), "node", "low")


def _loose(large: DataFrame, classes: DataFrame, bands: int, agree: float) -> DataFrame:
    """The roots of large groups whose members have less than the share ``agree`` of bands in common with the least member."""
    member = large.select("node", "root").join(classes.select("node", "bands"), "node")
    least = member.groupBy("root").agg(F.min_by("bands", "node").alias("low_bands"))
    return settle(member.join(least, "root").groupBy("root").agg(
        F.avg(F.size(F.array_intersect("bands", "low_bands"))).alias("common")).where(F.col("common") < agree * bands).select("root"))


def _placed(members: DataFrame) -> DataFrame:
    """Members (node, root, ..., size) with the number of chunks of their group and their chunk."""
    totals = members.groupBy("root").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).select(
        "root", F.greatest(F.ceil(F.col("s") / CHUNK_SHINGLES), F.ceil(F.col("c") / CHUNK_CLASSES)).alias("chunks"))
    return members.join(totals, "root").withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the number of keys that each two of these sorted key sets share."""
    n = len(sets)
    if n == 2:
        both = float(len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    spread = np.diff(np.append(start, len(flat)))
    shared = np.zeros(n * n)
    for width in np.unique(spread[(spread > 1) & (spread <= DENSE)]):
        at = start[spread == width]
        for part in np.array_split(at, max(1, len(at) * int(width) ** 2 >> 22)):
            who = owner[part[:, None] + np.arange(width)]
            shared += np.bincount((who[:, :, None] * n + who[:, None, :]).ravel(), minlength=n * n)
    shared = shared.reshape(n, n)
    wide = np.flatnonzero(spread > DENSE)
    for part in np.array_split(wide, max(1, len(wide) >> 11)):
        if len(part):
            table = np.zeros((n, len(part)), dtype=np.float32)
            for column, k in enumerate(part):
                table[owner[start[k] : start[k] + spread[k]], column] = 1
            shared += table @ table.T
    np.fill_diagonal(shared, [len(s) for s in sets])
    return shared


def _joined(linked: np.ndarray) -> np.ndarray:
    """For each node the least node of its component in a small boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    around = linked | np.eye(n, dtype=bool)
    while True:
        low = np.where(around, label[None, :], n).min(axis=1)
        if (low == label).all():
            return label
        label = low


def verifier(threshold: float):
    """Grouped Arrow function: the candidate classes of a task to their links inside it."""

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out: dict[str, list] = {"node": [], "links": [], "near": [], "many": []}
        if table.num_rows:
            values, bounds = W.shingles(table.column("text").chunk(0), SHINGLE)
            node, root, chunk, copies = (table.column(c).to_numpy() for c in ("node", "root", "chunk", "copies"))
            same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            many = bool(table.column("many")[0].as_py())
            order = np.lexsort((node, root))
            for rows in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
                if len(rows) < 2:
                    continue
                sets = [np.unique(values[bounds[d] : bounds[d + 1]]) for d in rows]
                shared = overlaps(sets)
                size = np.array([len(s) for s in sets], dtype=float)
                linked = shared / (size[:, None] + size[None, :] - shared) >= threshold
                np.fill_diagonal(linked, False)
                if not same:
                    linked &= chunk[rows][:, None] != chunk[rows][None, :]
                some = linked.any(axis=1)
                least = node[rows][_joined(linked)]
                out["node"] += node[rows][some].tolist()
                out["links"] += (linked @ copies[rows].astype(float)).astype(np.int64)[some].tolist()
                out["near"] += least[some].tolist()
                out["many"] += [many] * int(some.sum())
        return pa.table({k: pa.array(v, type=pa.bool_() if k == "many" else pa.int64()) for k, v in out.items()})

    return verify


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links) for every row of ``docs``; see the module text."""
    bands, rows = banding(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = settle(source.mapInArrow(signer(bands, rows), f"id {kind}, cls binary, mark bigint, size int, bands array<bigint>"))

    classes = settle(
        signed.where(F.col("cls").isNotNull()).groupBy("cls")
        .agg(F.min("id").alias("low_id"), F.count(F.lit(1)).alias("copies"),
             F.first("mark").alias("mark"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()))

    groups = components(_bucket_edges(classes.select("node", F.explode("bands").alias("band")), "band"), "node", "low")
    placed = settle(_placed(classes.join(groups, "node").select("node", "root", "cls", "mark", "copies", "size")))
    texts = (source.select("text").mapInArrow(_passing(bitmap(placed, "mark", filter_bits(placed.count()))), "cls binary, text string")
             .groupBy("cls").agg(F.first("text").alias("text")))
    loose = _loose(placed.where("chunks > 1"), classes, bands, threshold**rows / 2)
    if loose.limit(1).count():
        large = placed.join(loose, "root", "left_semi")
        texts = settle(texts)
        members = large.drop("root", "chunks", "chunk").join(_tightened(large, texts, threshold), "node")
        placed = settle(placed.join(loose, "root", "left_anti").unionByName(_placed(members)))
    whole = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first().s
    packs = max(1, math.ceil(whole / PACK_SHINGLES))

    # One task for each pair of chunks of a large group; small groups are dealt together.
    pair = F.expr("""
        inline(if(chunks = 1, array(struct(0L as i, 0L as j)),
          transform(sequence(0L, chunks - 1), c -> struct(least(c, chunk) as i, greatest(c, chunk) as j))))""")
    tasks = placed.join(texts, "cls").select(
        "node", "root", "chunk", "copies", "text", (F.col("chunks") > 1).alias("many"),
        F.when(F.col("chunks") == 1, -1 - F.expr(f"pmod(xxhash64(root), {packs}L)")).otherwise(F.col("root")).alias("pack"),
        pair)
    found = settle(tasks.groupBy("pack", "i", "j").applyInArrow(
        verifier(threshold), "node bigint, links bigint, near bigint, many boolean"))

    per_node = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("near").alias("near"))
    across = components(found.where("many"), "node", "near")
    linked = per_node.join(across, "node", "left").select(
        "node", "links", F.coalesce("root", "near").alias("root"))
    ids = classes.select("node", "cls", "low_id", "copies").join(linked, "node", "left").select(
        "cls", "low_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    named = ids.join(ids.groupBy("root").agg(F.min("low_id").alias("class_id")), "root").select(
        "cls", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    members = signed.select("id", "cls")
    return (
        members.where("cls is not null").join(named, "cls").select(F.col("id").alias(id_col), "class_id", "n_links")
        .union(members.where("cls is null").select("id", F.col("id"), F.lit(0).cast("bigint"))))



def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the least id stays.

    Rows that repeat an id and its text count once. Rows of one id with
    different texts stay or go together, by whether the id is the least of any of
    their groups.
    """
    found = jaccard_join(docs, id_col, text_col, **options)
    verdict = settle(found.groupBy(id_col).agg(F.max(F.col(id_col).eqNullSafe(F.col("class_id"))).alias("stays"),
                                               F.count(F.lit(1)).alias("rows")))
    if verdict.where("rows > 1").limit(1).count():
        docs = docs.dropDuplicates([id_col, text_col])
    gone = few(verdict.where("not stays").select(F.col(id_col).alias("gone")))
    docs, back = set_aside(docs, "gone")
    key = now_named(back, id_col)
    return docs.join(gone, docs[key].eqNullSafe(F.col("gone")), "left_anti").withColumnsRenamed(back)
