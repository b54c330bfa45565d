"""N-gram Jaccard self-join as a blocked sparse matrix product.

Rows of the matrix are documents' sets of word n-gram hashes. Documents with equal sets are one row
(a class). Two rows link when the overlap is at least ``percent`` % of the union.

1. One scan digests every set and counts n-grams in a fixed number of buckets; with that the
   n-grams have a global order, rare first.
2. Size-derived bound: rows that link share one of the n - ceil(percent/100 n) + 1 first n-grams of
   either row. A second scan hands out those n-grams, one copy of a class per task; the rows of one
   n-gram meet at its first row, the hub, so a group of g rows makes g - 1 rows and not g^2 pairs.
   Members whose sizes and shared heads rule out every other member go.
3. Each cluster is multiplied in tiles of bounded size: the tile's n-grams form an inverted index, the
   product accumulates overlap counts, and pairs are discarded by their sizes. A tile gives back only
   the links that join its components. Most clusters are one tile.
4. In larger ones the overlaps with the hub come first: rows that link with it are one component
   already. Only the others go into tiles, against all, and the triangle inequality of the Jaccard
   distance to the hub rules out further pairs.
5. Components of all links, carried over to the classes and their documents.

No pair is lost: every pair of rows that can link has a common n-gram in both heads, so both belong
to that n-gram's hub; pairs that tile and hub pass over are linked through the hub already.

Null and empty texts have no set, link with nothing and are their own component. Repeated rows are
equal texts. Set members are 64-bit hashes, classes 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declara.llm.common import OWN, broadcast_if_small, shingles, utf8, word_hashes
from declara.llm.components import components
from declara.runtime import stage

ORDER_BUCKETS = 1 << 21
ORDER_BLOCK = 1 << 15  # buckets whose counts travel as one value
TILE = 1 << 20  # n-grams in one block of a tile, besides the last document
PRUNED = 2048  # larger clusters are multiplied without a look at their members' bounds first


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _arrays(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([*values, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def digests(documents: DataFrame, width: int) -> DataFrame:
    """Staged rows (id, n, digest) of all documents, and rows (block, counts) with their n-gram counts."""
    kind = documents.schema["id"].dataType.simpleString()

    def scan(batches):
        seen, id_type = np.zeros(ORDER_BUCKETS, np.int64), None
        for b in batches:
            id_type = b.column("id").type
            n, made, all_sets = [], [], []
            for raw in utf8(b.column("text")):
                s = shingles(word_hashes(raw), width) if raw is not None else np.empty(0, np.uint64)
                n.append(len(s))
                made.append(_digest(s) if len(s) else None)
                all_sets.append(s)
            flat = np.concatenate(all_sets) if all_sets else np.empty(0, np.uint64)
            seen += np.bincount((flat & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64), minlength=ORDER_BUCKETS)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(made, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                names=["id", "n", "digest", "block", "counts"],
            )
        if id_type is not None:
            blocks = [_packed(x) for x in seen.reshape(-1, ORDER_BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(blocks), id_type), pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.binary()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())],
                names=["id", "n", "digest", "block", "counts"],
            )

    return stage(documents.select("id", "text").mapInArrow(scan, f"id {kind}, n long, digest binary, block int, counts binary"))


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // ORDER_BLOCK}").astype(np.int64)


def _add_counts(batches):
    blocks: dict[int, np.ndarray] = {}
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
            blocks[block] = blocks.get(block, 0) + _unpacked(raw)
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(list(map(_packed, blocks.values())), pa.binary())], names=["block", "counts"])


def _order(rows: DataFrame) -> np.ndarray:
    """How often the n-grams of every bucket occur: the tasks' counts, added block by block."""
    blocks = rows.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_add_counts, "block int, counts binary")
    counts = np.zeros(ORDER_BUCKETS, np.uint32)
    for r in blocks.collect():  # ORDER_BUCKETS numbers; only their order matters, so 32 bits do
        counts[r.block * ORDER_BLOCK : (r.block + 1) * ORDER_BLOCK] = np.minimum(_unpacked(r.counts), 0xFFFFFFFF)
    return counts


def heads(documents: DataFrame, counts, width: int, percent: int) -> DataFrame:
    """(gram, key): the rare ends of all sets, one copy of a set per task."""

    def scan(batches):
        met: set[bytes] = set()
        for b in batches:
            grams, keys = [], []
            for raw in utf8(b.column("text")):
                s = shingles(word_hashes(raw), width) if raw is not None else ()
                if not len(s) or (d := _digest(s)) in met:
                    continue
                met.add(d)
                order = np.argsort(counts.value[(s & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64)], kind="stable")
                head = s[order[: len(s) - -(-percent * len(s) // 100) + 1]]
                grams.append(head)
                keys.append(np.full(len(head), _key(d), np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(keys))], names=["gram", "key"]
                )

    return documents.select("text").mapInArrow(scan, "gram long, key long")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(key, digest, grams) of the texts, one copy of a set per task."""

    def scan(batches):
        met: set[bytes] = set()
        for b in batches:
            keys, made, grams = [], [], []
            for raw in utf8(b.column("text")):
                s = shingles(word_hashes(raw), width) if raw is not None else ()
                if not len(s) or (d := _digest(s)) in met:
                    continue
                met.add(d)
                keys.append(_key(d))
                made.append(d)
                grams.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(made, pa.binary()), _arrays(grams)], names=["key", "digest", "grams"]
            )

    return texts.select("text").mapInArrow(scan, "key long, digest binary, grams array<long>")


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Views of a list column of longs as unsigned hashes."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _overlap_with_hub(batches):
    for b in batches:
        ours, hubs = _rows(b.column("grams")), _rows(b.column("hub_grams"))
        both = []
        for x, h in zip(ours, hubs):
            at = np.minimum(np.searchsorted(h, x), len(h) - 1)
            both.append(int((h[at] == x).sum()))
        yield pa.RecordBatch.from_arrays(
            [b.column("hub_digest"), b.column("digest"), pa.array(both, pa.int64()), pa.array([len(x) for x in ours], pa.int64()), pa.array([len(h) for h in hubs], pa.int64())],
            names=["hub", "digest", "both", "n", "hub_n"],
        )


def _tile_links(rows: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join the components of one tile. ``rows``: (hub, linked to the hub, left block?,
    right block?, digest, distance to the hub, grams); pairs are unlinked left rows x right rows."""
    name = [r[4] for r in rows]
    linked = np.array([r[1] for r in rows])
    right = np.flatnonzero([r[3] for r in rows])
    distance = np.array([r[5] for r in rows])
    size = np.array([len(r[6]) for r in rows])
    grams = np.concatenate([rows[i][6] for i in right]) if len(right) else np.empty(0, np.uint64)
    owner = np.repeat(right, size[right])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    parent = list(range(len(rows) + 1))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(linked):
        parent[i] = len(rows)  # the hub's component
    links, far = [], 1 - percent / 100 + 1e-9
    for i, row in enumerate(rows):
        if row[1] or not row[2]:
            continue
        may = np.zeros(len(rows), bool)
        may[right] = True
        may &= (100 * size >= percent * size[i]) & (100 * size[i] >= percent * size) & (abs(distance - distance[i]) <= far)
        may[i] = False
        if not may.any():
            continue
        low, high = np.searchsorted(grams, row[6], "left"), np.searchsorted(grams, row[6], "right")
        n = high - low
        places = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[places], minlength=len(rows))
        for j in np.flatnonzero(may & (100 * both >= percent * (size + size[i] - both))):
            if (a := root(i)) != (b := root(int(j))):
                parent[a] = b
                links.append((name[i], name[j]))
    return links


def _multiply(percent: int):
    columns = ("hub", "linked", "is_left", "is_right", "digest", "distance")

    def scan(batches):
        tile, rows = None, []
        for b in batches:
            where = list(zip(*(b.column(c).to_pylist() for c in ("hub", "left", "right"))))
            values = list(zip(*(b.column(c).to_pylist() for c in columns), _rows(b.column("grams"))))
            found = []
            for at, value in zip(where, values):
                if at != tile:
                    found += _tile_links(rows, percent) if rows else []
                    tile, rows = at, []
                rows.append((*value[:6], value[6].copy()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["u", "v"])
        if rows and (found := _tile_links(rows, percent)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["u", "v"])

    return scan


def _may_link(percent: int):
    """Drop members of a cluster that cannot link with any other: by size, and because the pair
    shares too few n-grams of the heads. A pair shares at most what both share with the hub's
    n-grams plus what both share elsewhere; below the bound even equal tails do not make up for it."""

    def prune(rows: list[tuple]) -> list[int]:
        if len(rows) > PRUNED:
            return list(range(len(rows)))
        shared, elsewhere, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in (2, 3, 4))
        x, y = n[:, None], n[None, :]
        most = np.minimum(shared[:, None], shared[None, :]) + np.minimum(elsewhere[:, None], elsewhere[None, :])
        needed = -(-percent * (x + y) // (100 + percent))
        tail = np.maximum(-(-percent * x // 100), -(-percent * y // 100)) - 1  # of the row whose head ends first
        may = (100 * x >= percent * y) & (100 * y >= percent * x) & (most + tail >= needed)
        np.fill_diagonal(may, False)
        return np.flatnonzero(may.any(axis=0)).tolist()

    def scan(batches):
        held: list[tuple] = []
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("hub", "key", "shared", "elsewhere", "n"))):
                if held and held[0][0] != row[0]:
                    out += [held[i] for i in prune(held)]
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1, 4)], names=["hub", "key", "n"])
                out = []
        if held and (out := [held[i] for i in prune(held)]):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1, 4)], names=["hub", "key", "n"])

    return scan


def clusters(documents: DataFrame, classes: DataFrame, counts, width: int, percent: int) -> DataFrame:
    """(hub, key, n): rows that meet at a hub, the hub among them, and may link there."""
    group = Window.partitionBy("gram").orderBy("key")
    met = heads(documents, counts, width, percent).select(
        "key", *(f("key").over(group).alias(name) for f, name in ((F.first, "hub"), (F.lag, "before"), (F.lead, "next")))
    )
    # one row of every key in the group, and of the hub only where another row follows
    met = met.where("(before IS NULL AND next IS NOT NULL) OR (before <> key AND key <> hub)")
    shared = stage(met.groupBy("hub", "key").agg(F.count("*").alias("shared")))
    sizes = shared.groupBy("key").agg(F.sum("shared").alias("total")).join(classes.groupBy("key").agg(F.max("n").alias("n")), "key")
    rows = shared.join(sizes, "key").withColumn("elsewhere", F.col("total") - F.col("shared"))
    rows = rows.select("hub", "key", "shared", "elsewhere", "n").repartition("hub").sortWithinPartitions("hub")
    return stage(rows.mapInArrow(_may_link(percent), "hub long, key long, n long"))


def links(documents: DataFrame, classes: DataFrame, counts, width: int, percent: int) -> DataFrame:
    """(u, v): links between digests, enough to join all that link."""
    members = clusters(documents, classes, counts, width, percent)
    wanted = members.select("key").unionAll(members.select(F.col("hub").alias("key"))).distinct()
    needed = classes.join(wanted, "key", "left_semi").select(F.col("id").alias("_id")).distinct()
    texts = documents.join(broadcast_if_small(needed), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    sets = stage(sets_of(texts, width).join(broadcast_if_small(wanted), "key", "left_semi"))
    weight = members.groupBy("hub").agg(F.sum("n").alias("weight"))
    weighed = stage(members.join(weight, "hub"))
    small = sets.join(broadcast_if_small(weighed.where(F.col("weight") <= TILE).select("hub", "key")), "key").select(
        F.col("hub").cast("string").cast("binary").alias("hub"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(False).alias("linked"),
        F.lit(True).alias("is_left"), F.lit(True).alias("is_right"), "digest", F.lit(0.0).alias("distance"), "grams",
    )
    in_one = small.repartition("hub").sortWithinPartitions("hub").mapInArrow(_multiply(percent), "u binary, v binary")
    return in_one.unionAll(_large_links(weighed.where(F.col("weight") > TILE).select("hub", "key"), sets, percent))


def _large_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside clusters beyond one tile: first with the hub, then the rest in tiles."""
    wanted = members.select("key").unionAll(members.select(F.col("hub").alias("key"))).distinct()
    sets = sets.join(broadcast_if_small(wanted), "key", "left_semi")
    hubs = sets.select(F.col("key").alias("hub"), F.col("digest").alias("hub_digest"), F.col("grams").alias("hub_grams"))
    star = stage(
        members.join(sets, "key").join(hubs, "hub").where("digest <> hub_digest")
        .select("hub_digest", "digest", "grams", "hub_grams")
        .mapInArrow(_overlap_with_hub, "hub binary, digest binary, both long, n long, hub_n long")
        .withColumn("linked", F.expr(f"100 * both >= {percent} * (n + hub_n - both)"))
        .withColumn("distance", F.expr("1 - both / (n + hub_n - both)"))
    )
    # blocks of the rows not linked to their hub, against those and the linked ones
    blocks = star.groupBy("hub").agg(
        *(F.sum(F.when(side, F.col("n"))).alias(f"{name}_grams") for name, side in (("left", ~F.col("linked")), ("all", F.lit(True))))
    ).where("left_grams IS NOT NULL").select(
        "hub", *(F.ceil(F.col(f"{name}_grams") / TILE).cast("int").alias(f"{name}_blocks") for name in ("left", "all"))
    )
    place = F.xxhash64("digest")
    placed = star.join(blocks, "hub").withColumn("own_left", F.pmod(place, F.col("left_blocks")).cast("int")).withColumn(
        "own_right", F.pmod(place, F.col("all_blocks")).cast("int")
    )

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    row = ["hub", "digest", "linked", "distance", "own_left", "own_right"]
    as_right = placed.select(*row, every("left_blocks").alias("left"), F.col("own_right").alias("right"))
    as_left = placed.where("NOT linked").select(*row, F.col("own_left").alias("left"), every("all_blocks").alias("right"))
    tiles = as_right.unionAll(as_left).distinct().join(sets.select("digest", "grams"), "digest").select(
        "hub", "left", "right", "linked", F.expr("NOT linked AND left = own_left").alias("is_left"),
        F.expr("right = own_right").alias("is_right"), "digest", "distance", "grams",
    )
    inner = tiles.repartition("hub", "left", "right").sortWithinPartitions("hub", "left", "right").mapInArrow(_multiply(percent), "u binary, v binary")
    return star.where("linked").select(F.col("hub").alias("u"), F.col("digest").alias("v")).unionAll(inner)


def ngram_join(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``documents`` (id, text)."""
    documents = documents.select("id", "text")
    rows = digests(documents, width)
    found = rows.where("block IS NULL").select("id", "n", "digest")
    classes = found.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    kind = documents.schema["id"].dataType.simpleString()
    classes = stage(classes.mapInArrow(_with_key, f"digest binary, id {kind}, n long, key long"))
    # the order of the n-grams reaches the tasks once per executor; its size is the parameter's
    order = documents.sparkSession.sparkContext.broadcast(_order(rows))
    joined = components(links(documents, classes, order, width, percent))
    ends = classes.join(joined, classes.digest == joined.node, "left").select(
        "digest", F.col("id").alias("least"), F.coalesce("root", "digest").alias("root")
    )
    ends = stage(ends)
    least = ends.groupBy("root").agg(F.min("least").alias("component_id"))
    final = ends.join(least, "root").select("digest", "component_id")
    return found.join(final, "digest", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "digest"
    )


def _with_key(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column("digest"), b.column("id"), b.column("n"), pa.array([_key(d) for d in b.column("digest").to_pylist()], pa.int64())],
            names=["digest", "id", "n", "key"],
        )


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return ngram_join(documents).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def keep_one(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: one document of each group stays, the one with the least id. Rows are told apart by
    id and text, so different texts under one id are documents of their own; of rows that repeat both, one
    stays, unless they are empty and so in no group."""
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("text_hash"))  # null ids come last
    found = ngram_join(documents.select(own.alias("id"), "text")).where(F.col("id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy(F.col("id.doc_id").alias(f"{OWN}id"), F.col("id.text_hash").alias(f"{OWN}hash")).agg(F.min("n_shingles").alias(f"{OWN}n"))
    kept = documents.join(keep, F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & (F.xxhash64("text") == F.col(f"{OWN}hash")))
    nth = F.row_number().over(Window.partitionBy("doc_id", f"{OWN}hash").orderBy(F.lit(0)))
    return kept.withColumn(f"{OWN}nth", nth).where((F.col(f"{OWN}nth") == 1) | (F.col(f"{OWN}n") == 0)).select(documents.columns)
