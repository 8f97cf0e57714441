"""Near-duplicate grouping: SuperMinHash signatures, banding, exact verification, union-find.

1. One pass over the texts gives each document the size of its shingle set, a 128-bit digest of the set, and band keys
   of its SuperMinHash signature.  Texts and sets are not kept.
2. Documents with equal sets are one *class* (their similarity is 1); only the class's smallest doc_id goes on, so a
   group of thousands of copies costs one row from here.
3. Classes that share a band key become candidates.  A bucket is split by SALTS; each part links its members to its
   smallest one, and these to the smallest of the bucket: linear in the bucket, and no task has more than a salt's share
   of a hot key.  Components of these links are *clusters*: whoever shares a bucket is in one cluster, so no pair is lost.
4. Texts of clustered classes are picked in a second pass by a Bloom filter.  First each class is compared, on full sets,
   with the smallest of its centres; a group of near copies is joined by that alone, in linear work.
5. Clusters that are still in pieces (more than two classes, and not all joined) are compared exactly: sets with too
   many shingles that no other member has are ruled out first, the rest meet in one sparse count of common shingles.
   Large clusters are dealt into blocks of bounded size, a task for each pair of blocks.  Tasks emit spanning links, never
   pairs.
6. All links meet in the components step again; the smallest doc_id names each component.

Bands: with 25 bands of 5 rows a pair at similarity 0.85 shares no band with probability 4e-7 (0.8: 5e-5).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.components import connected_components
from spanloom.llm.shingles import Words, buffers, shingle_sets, shingles, slices
from spanloom.llm.superminhash import band_keys, signatures
from spanloom.llm.tables import drop, keep, kept_at, map_arrow, text_or_empty

M, ROWS, BANDS = 128, 5, 25
BLOCK_SETS, BLOCK_SHINGLES = 512, 2_000_000
BLOOM_BITS, BLOOM_MOST, BITS_EACH = 1 << 23, 1 << 29, 12
SALTS = 16


def _sketch_batches(width: int, m: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            sizes, digests, keys = [], [], []
            for a, b in slices(offs):
                words = Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                h, owner = shingles(words.hash, words.row, words.counts(), width)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                sets = [np.unique(h[cut[i] : cut[i + 1]]) for i in range(b - a)]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                sizes.append(n)
                digests += [blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                sig = signatures(np.concatenate(sets), np.repeat(np.arange(b - a), n), b - a, m)
                keys.append(band_keys(sig, bands, rows).view(np.int64))
            n = np.concatenate(sizes) if sizes else np.empty(0, dtype=np.int64)
            flat = np.concatenate(keys).reshape(-1) if keys else np.empty(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])

    return run


def sketches(docs: DataFrame, width: int = 5, m: int = M, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest (null without words), bands: one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_arrow(texts, _sketch_batches(width, m, bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>")


def bloom_bits(n: int) -> int:
    """Size of the filter for ``n`` ids: a power of two with BITS_EACH bits for each, from 1 MB to 64 MB."""
    bits = BLOOM_BITS
    while bits < min(BITS_EACH * n, BLOOM_MOST):
        bits *= 2
    return bits


def bloom_words(places: DataFrame, bits: int) -> np.ndarray:
    """The words of a filter of ``bits`` bits, set at the places (column at) of the table."""
    words = places.selectExpr("cast(at div 64 as int) i", "shiftleft(1L, cast(at % 64 as int)) w").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()  # as columns: rows would be a Python object each
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words["i"].to_numpy()] = words["w"].to_numpy()
    return table


def bloom_filter(ids: DataFrame, name: str) -> Column:
    """A test that holds for every id of the column and for few others.

    The driver gets the filter's words, 64 MB at most; above some 40 million ids more rows are let through, and the join
    that follows decides."""
    bits = bloom_bits(ids.count())

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    shared = ids.sparkSession.sparkContext.broadcast(bloom_words(ids.select(place(F.col(name)).alias("at")), bits))

    @F.pandas_udf("boolean")
    def hit(position):
        p = position.to_numpy(dtype=np.int64)
        return position.__class__(((shared.value[p >> 6] >> (p & 63)) & 1).astype(bool))

    return hit(place(F.col("doc_id")))


def _common_counts(code: np.ndarray, owner: np.ndarray, df: np.ndarray, live: np.ndarray, n: int) -> np.ndarray:
    """(n, n) counts of common shingles among live sets: common codes by dense products, rarer ones by their pairs."""
    common = np.zeros((n, n), dtype=np.float32)
    use = (df[code] > 1) & live[owner]
    code, owner = code[use], owner[use]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    codes, opens, lens = np.unique(code, return_index=True, return_counts=True)
    often = np.flatnonzero(lens >= 16)
    for k in range(0, len(often), 2048):
        chunk = often[k : k + 2048]
        at = np.repeat(opens[chunk] - np.concatenate(([0], np.cumsum(lens[chunk])[:-1])), lens[chunk]) + np.arange(lens[chunk].sum())
        x = np.zeros((n, len(chunk)), dtype=np.float32)
        x[owner[at], np.repeat(np.arange(len(chunk)), lens[chunk])] = 1
        common += x @ x.T
    flat = common.reshape(-1)
    for d in range(2, 16):
        start = opens[lens == d]
        for p in range(d):
            for q in range(d):
                if p != q:
                    np.add.at(flat, owner[start + p] * n + owner[start + q], 1)
    return common


def spanning_links(sets: list[np.ndarray], side: np.ndarray, per_cent: int) -> list[tuple[int, int]]:
    """Pairs (i, root) that join linked sets of one block or of two.

    ``side`` tells the block of each set; with two blocks only pairs across them count, as each block also meets itself.
    Exact: linked means 100 * common >= per_cent * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n < 2:
        return []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.bincount(owner, weights=df[code] > 1, minlength=n).astype(np.int64)
    live = 100 * shared >= per_cent * size  # common <= shared and union >= size
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    common = _common_counts(code, owner, df, live, n)
    both = side.min() != side.max()
    for i in np.flatnonzero(live):
        ok = 100 * common[i, :i] >= per_cent * (size[i] + size[:i] - common[i, :i])
        if both:
            ok &= side[:i] != side[i]
        root = find(i)
        for j in np.flatnonzero(ok):
            other = find(j)
            if other != root:
                parent[max(root, other)] = min(root, other)
                root = min(root, other)
    return [(i, find(i)) for i in range(n) if find(i) != i]


def _verify_batches(width: int, per_cent: int):
    """Rows (cluster, i, j, side, doc_id, text) come sorted by (cluster, i, j, doc_id); one group is held at a time."""

    def links(ids: list[int], side: list[int], texts: list[str]) -> list[tuple[int, int]]:
        sets = list(shingle_sets(pa.array(texts, pa.large_string()), width))
        return [(ids[a], ids[b]) for a, b in spanning_links(sets, np.array(side), per_cent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, side, texts = None, [], [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for k, s, d, t in zip(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True), *(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
                if k != key:
                    out += links(ids, side, texts) if len(ids) > 1 else []
                    key, ids, side, texts = k, [], [], []
                ids.append(d)
                side.append(s)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
        out = links(ids, side, texts) if len(ids) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _star_batches(width: int, per_cent: int):
    """Rows (center, salt, member, doc_id, text) come sorted so that a centre's own text precedes its members; the sets of
    one centre and one batch are held at a time."""

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < per_cent * max(len(a), len(b)):
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= per_cent * (len(a) + len(b) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            rows = zip(*(batch.column(c).to_pylist() for c in range(4)), shingle_sets(batch.column(4), width), strict=True)
            for center, salt, member, doc_id, shingle_set in rows:
                if (center, salt) != key:
                    key, own = (center, salt), []
                if not member:
                    own.append(shingle_set)
                elif len(shingle_set) and any(linked(shingle_set, x) for x in own):
                    out.append((doc_id, center))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _every_salt() -> Column:
    """A row for each salt: the small side of a join whose other side has hot keys."""
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _bucket_links(classes: DataFrame) -> DataFrame:
    """(rep, center) for classes (rep, bands) that share a band key; no key is held by one task as a whole."""
    band = classes.select("rep", F.explode("bands").alias("key")).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    part = Window.partitionBy("key", "salt")
    parts = band.withColumn("center", F.min("rep").over(part))
    tops = band.groupBy("key", "salt").agg(F.min("rep").alias("rep")).withColumn("center", F.min("rep").over(Window.partitionBy("key")))
    tops = tops.filter("rep <> center").select("rep", "center")
    return parts.filter("rep <> center").select("rep", "center").union(tops).distinct()


def star_links(texts: DataFrame, star: DataFrame, width: int, per_cent: int) -> DataFrame:
    """(a, b) for the pairs (rep, center) of ``star`` whose sets are linked; the members of a centre are dealt over SALTS tasks.

    ``texts`` has doc_id and text, of these documents at least."""
    star = star.select("rep", "center").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    own = star.select("center", "salt").distinct().select("center", "salt", F.lit(False).alias("member"), F.col("center").alias("id"))
    ask = own.union(star.select("center", "salt", F.lit(True), "rep"))
    rows = texts.join(ask, F.col("doc_id") == F.col("id")).select("center", "salt", "member", "doc_id", "text")
    return map_arrow(rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "member", "doc_id"), _star_batches(width, per_cent), "a long, b long")


def block_links(texts: DataFrame, clusters: DataFrame, pieces: DataFrame, sizes: DataFrame, width: int, per_cent: int, block_sets: int, block_shingles: int, held=keep) -> DataFrame:
    """(a, b) that span the links within clusters (node, component) that ``pieces`` (node, component) leaves apart.

    ``sizes`` (node, n) tells the shingles of each node; ``held`` writes a table that the result reads.  Clusters are dealt into blocks of bounded size, a task for each pair of blocks."""
    # a cluster of two has no pair but the one that was tried
    told = clusters.join(pieces.withColumnRenamed("component", "piece"), "node", "left").withColumn("piece", F.coalesce("piece", "node"))
    open_ = told.groupBy("component").agg(F.count("*").alias("members"), F.min("piece").alias("lo"), F.max("piece").alias("hi")).filter("members > 2 and lo <> hi")
    open_ = open_.select("component", _every_salt())
    salted = clusters.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    members = held(salted.join(open_, ["component", "salt"], "left_semi").join(sizes, "node"))
    dealt = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")).select("component", "blocks", _every_salt())
    placed = members.join(dealt, ["component", "salt"]).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.select("node", "component", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "node", F.col("component").alias("cluster"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side"
    )
    rows = texts.join(spread, F.col("doc_id") == F.col("node")).select("cluster", "i", "j", "side", "doc_id", "text")
    return map_arrow(rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id"), _verify_batches(width, per_cent), "a long, b long")


def near_duplicates(docs: DataFrame, per_cent: int = 85, width: int = 5, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (needs doc_id and text).

    Documents are linked where 100 * intersection >= per_cent * union of their shingle sets; component_id is the
    smallest doc_id reachable.  Null and empty texts have no shingles and are linked with nothing.  A row whose doc_id
    is null is never linked: its component_id is null and it is kept.  Rows repeated with the same doc_id and text agree in
    everything.  kept: doc_id = component_id.  Very long texts are compared whole; an empty table gives an empty table; other
    columns of ``docs``, clashing ones too, are not read."""
    spark, spent = docs.sparkSession, []

    def held(df: DataFrame) -> DataFrame:
        """Kept until the result's last step is written."""
        table, path = kept_at(df)
        spent.append(path)
        return table

    base = keep(sketches(docs, width))
    linked = base.filter("digest is not null and doc_id is not null")
    classes = keep(linked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.max("n_shingles").alias("n"), F.count("*").alias("rows")))
    links = held(_bucket_links(classes))
    clusters = held(connected_components(links, "rep", "center"))
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).filter("doc_id is not null").filter(bloom_filter(clusters, "node"))
    # each class against the smallest of its centres
    star = links.groupBy("rep").agg(F.min("center").alias("center"))
    joined = held(star_links(texts, star, width, per_cent))
    pieces = held(connected_components(joined, "a", "b"))
    sizes = classes.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("n"))
    pairs = held(block_links(texts, clusters, pieces, sizes, width, per_cent, block_sets, block_shingles, held))
    final = connected_components(joined.union(pairs), "a", "b")
    # only classes that have copies or links are told to the rows; a hot class in SALTS parts
    root = classes.select("digest", "rep", "rows").join(final, F.col("rep") == F.col("node"), "left").filter("rows > 1 or component is not null")
    root = keep(root.select("digest", F.coalesce("component", "rep").alias("root"), _every_salt()))
    for path in spent:
        drop(spark, path)
    thin = base.drop("bands").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    alone = thin.filter("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("root"))
    out = thin.filter("digest is not null").join(root, ["digest", "salt"], "left").select("doc_id", "n_shingles", "root").union(alone)
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("root", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def representatives(docs: DataFrame, per_cent: int = 80, width: int = 5) -> DataFrame:
    """``docs``, all columns, with one document of each group: the one whose doc_id names the component.

    Rows that a Bloom filter of the dropped and repeated ids rules out pass as they are, so texts are shuffled only for
    documents that are likely to go.  Rows that repeat a doc_id and text count as one document; rows without a doc_id stay."""
    groups = near_duplicates(docs, per_cent, width)
    fate = keep(groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).filter("n > 1 or not kept"))
    cols = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.col("doc_id").cast("long").alias("doc_id"))
    hit = plain.withColumn("hit", F.col("doc_id").isNotNull() & bloom_filter(fate, "doc_id"))
    told = hit.filter("hit").join(fate, "doc_id", "left")
    stay = told.filter("n is null")
    again = told.filter("n > 1 and kept").dropDuplicates(["doc_id", f"c{cols.index('text')}"])
    names = [f"c{i}" for i in range(len(cols))]
    out = hit.filter("not hit").select(names).union(stay.select(names)).union(again.select(names))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
