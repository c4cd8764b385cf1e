"""Similarity search and near-duplicate clusters over sets of bits.

No operator forms all pairs of a group: candidates come from prefixes of rare bits, from
one rare bit, or as star edges between a bucket's least member and the others; copies
are folded into one representative first.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmine.functions import partenum
from docmine.functions import scalars as N
from docmine.operators.components import connected_components
from docmine.session import drop_finished_shuffles, materialise, release


def rare_first(fingerprints: DataFrame, frequency: DataFrame) -> DataFrame:
    """The rows with their bits in one global order, rare ones first, by a table (bit, n).

    A row's list is as long as its own bits."""
    exploded = fingerprints.select("id", F.explode("bits").alias("bit")).join(frequency, "bit", "left")
    item = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "bit")
    listed = exploded.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("o"))
    return listed.select("id", F.transform("o", lambda x: x["bit"]).alias("bits"))


def bit_frequency(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))


def fold_copies(fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct bit set with its least id, id to representative). The bits and
    their digests are computed once and stored; both results read the table."""
    keyed = materialise(fingerprints.withColumn("_key", F.unhex(F.md5(F.array_join("bits", ",")))), "bits")
    reps = keyed.groupBy("_key").agg(F.min("id").alias("rep"), F.any_value("bits").alias("bits"))
    members = keyed.select("id", "_key").join(reps.select("_key", "rep"), "_key").select("id", "rep")
    return reps.select(F.col("rep").alias("id"), "bits"), members


def _overlap_needed(size: Column, lo: float) -> Column:
    return F.greatest(F.ceil(size * F.lit(lo) - 1e-9), F.lit(1))


def similarity_range(
    query: DataFrame, db: DataFrame, lo: float, hi: float = 1.0, metric: str = "tanimoto"
) -> DataFrame:
    """(query_id, id, sim) for all pairs with ``lo <= sim <= hi``, exactly.

    Both sides are tables (id, bits). A pair that similar shares a bit among the first
    ``size - needed + 1`` of each side in a common order, so only those bits are joined;
    with rare bits first the lists behind them are short. Metrics: ``tanimoto``, and
    ``euclid-sub``, the share of the query's bits found.
    """
    if lo <= 0:
        raise ValueError("the lower bound must be positive; at zero everything matches")
    if metric not in ("tanimoto", "euclid-sub"):
        raise ValueError(f"unknown metric {metric}")
    left = materialise(query, "query-bits").filter(F.size("bits") > 0)
    # Equal rows of the database are looked up once.
    folded, members = fold_copies(db)
    folded = folded.filter(F.size("bits") > 0)
    right = materialise(folded, "fingerprints")
    frequency = materialise(bit_frequency(right), "bit-frequency")

    def prefix(df, name, whole):
        n = F.size("bits")
        length = n if whole else n - _overlap_needed(n, lo) + 1
        bits = F.slice(F.col("bits"), F.lit(1), length.cast("int"))
        return (df if whole else rare_first(df, frequency)).select(F.col("id").alias(name), n.alias(f"{name}_n"), F.explode(bits).alias("bit"))

    candidates = prefix(left, "query_id", False).join(
        prefix(right, "id", metric == "euclid-sub"), "bit"
    )
    if metric == "tanimoto":
        a, b = F.col("query_id_n"), F.col("id_n")
        candidates = candidates.filter((b >= a * lo - 1e-9) & (b * lo <= a + 1e-9))
    else:
        candidates = candidates.filter(F.col("id_n") >= F.col("query_id_n") * lo - 1e-9)
    pairs = candidates.select("query_id", "id").distinct()
    both = pairs.join(
        left.select(F.col("id").alias("query_id"), F.col("bits").alias("_q")), "query_id"
    ).join(right.select("id", F.col("bits").alias("_d")), "id")
    shared = N.common_bits(F.col("_q"), F.col("_d"))
    if metric == "tanimoto":
        sim = shared / (F.size("_q") + F.size("_d") - shared).cast("double")
    else:
        sim = shared / F.size("_q").cast("double")
    hits = both.withColumn("sim", sim).filter((F.col("sim") >= lo - 1e-12) & (F.col("sim") <= hi + 1e-12))
    renamed = members.select(F.col("rep"), F.col("id").alias("_id"))
    return (
        hits.select("query_id", F.col("id").alias("rep"), "sim")
        .join(renamed, "rep")
        .select("query_id", F.col("_id").alias("id"), "sim")
    )


def signature_rows(fingerprints: DataFrame, least: float) -> DataFrame:
    """(sig, id): PartEnum signatures of every row's bits."""
    kind = fingerprints.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [partenum.signatures(np.asarray(b, np.int64), least) for b in part.column("bits").to_pylist()]
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                # Two bytes less to send; what meets by chance is compared.
                found = np.concatenate([np.zeros(0, np.int64), *found]) >> 16
                yield pa.RecordBatch.from_arrays([pa.array(found), part.column("id").take(pa.array(owner))], names=["sig", "id"])

    return fingerprints.select("id", "bits").mapInArrow(run, f"sig long, id {kind}")


def compared_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """(id, other, sim) of the pairs (id, other, _a, _b) whose sets of non-negative bits have a
    Tanimoto similarity of ``least`` and up."""
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_a", "_b")]
                sizes = [part.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_a", "_b")]
                shared = partenum.shared_counts(flat[0], sizes[0], flat[1], sizes[1])
                sim = shared / (sizes[0] + sizes[1] - shared)
                hit = pa.array(sim >= least - 1e-12)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).filter(hit) for c in ("id", "other")] + [pa.array(sim).filter(hit)], names=["id", "other", "sim"]
                )

    return pairs.select("id", "other", "_a", "_b").mapInArrow(run, f"id {kind}, other {kind}, sim double")


def similar_pairs(fingerprints: DataFrame, least: float) -> DataFrame:
    """(query_id, id, sim) for all ordered pairs of rows of one table, a row with itself
    included, with a Tanimoto similarity of ``least`` and up, exactly.

    Copies are folded. Similar sets share a PartEnum signature, a hash of several of their
    bits, so what is compared follows the similar sets and not, as lists behind single bits
    do, the square of the rows. Rows without bits match nothing; null bits neither.
    """
    if not 0 < least <= 1:
        raise ValueError("the lower bound must be positive and at most one")
    spark = fingerprints.sparkSession
    key = F.unhex(F.md5(F.array_join("bits", ",")))
    kept = materialise(fingerprints.filter(F.size("bits") > 0).withColumn("_key", key), "bits")
    # Bits are not shuffled to find copies: only their keys are.
    keyed = kept.select("id", "_key")
    reps = keyed.groupBy("_key").agg(F.min("id").alias("rep"))
    members = materialise(keyed.join(reps, "_key").select("id", "rep"), "members")
    first = members.filter("id = rep").select("id").distinct()
    rows = kept.join(first, "id", "left_semi")

    sent = signature_rows(rows, least)
    met = sent.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("sig"))).filter("_n > 1").select("sig", "id")
    met = materialise(met, "met")
    drop_finished_shuffles(spark)
    other = met.select("sig", F.col("id").alias("other"))
    pairs = materialise(met.join(other, "sig").filter("id < other").select("id", "other").distinct(), "pairs")
    release(met)
    drop_finished_shuffles(spark)

    asked = pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct()
    compared = materialise(rows.join(asked, "id", "left_semi").select("id", "bits"), "compared")
    both = pairs.join(compared.select("id", F.col("bits").alias("_a")), "id")
    both = both.join(compared.select(F.col("id").alias("other"), F.col("bits").alias("_b")), "other")
    small, large = F.least(F.size("_a"), F.size("_b")), F.greatest(F.size("_a"), F.size("_b"))
    hits = materialise(compared_pairs(both.filter(small >= large * least - 1e-9), least), "hits")
    same = first.select("id", F.col("id").alias("other"), F.lit(1.0).alias("sim"))
    ordered = hits.unionByName(hits.select(F.col("other").alias("id"), F.col("id").alias("other"), "sim")).unionByName(same)
    release(pairs, compared, kept)
    asking = members.select(F.col("rep").alias("id"), F.col("id").alias("query_id"))
    found = members.select(F.col("rep").alias("other"), F.col("id").alias("_id"))
    return ordered.join(asking, "id").join(found, "other").select("query_id", F.col("_id").alias("id"), "sim")


def substructure_screen(query: DataFrame, db: DataFrame) -> DataFrame:
    """(query_id, id) where all bits of the query occur in the row. Each query is looked up
    by its rarest bit only. A query without bits, which every row would match, is refused."""
    folded, members = fold_copies(db)
    rows = materialise(folded, "fingerprints")
    asked = materialise(query, "query-bits")
    refused = F.when(F.size("bits") == 0, F.raise_error("a query without bits matches everything").cast("boolean"))
    asked = asked.filter(refused.otherwise(F.lit(True)))
    first = rare_first(asked, bit_frequency(rows)).select("id", F.get("bits", 0).alias("bit"))
    keyed = asked.join(first, "id").select(F.col("id").alias("query_id"), F.col("bits").alias("_q"), "bit")
    postings = rows.select("id", F.explode("bits").alias("bit"))
    pairs = keyed.join(postings, "bit").select("query_id", "_q", "id")
    checked = pairs.join(rows.select("id", F.col("bits").alias("_d")), "id").filter(
        F.size(F.array_except("_q", "_d")) == 0
    )
    renamed = members.select(F.col("rep"), F.col("id").alias("_id"))
    return (
        checked.select("query_id", F.col("id").alias("rep"))
        .join(renamed, "rep")
        .select("query_id", F.col("_id").alias("id"))
    )


def exact_groups(df: DataFrame, key: Column, item: str) -> DataFrame:
    """Rows of equal key as (key, rep, n); joins on it replace pairs of copies."""
    return df.select(key.alias("key"), item).groupBy("key").agg(
        F.min(item).alias("rep"), F.count(F.lit(1)).alias("n")
    )


def exact_search(query: DataFrame, db: DataFrame, key: str) -> DataFrame:
    """Database ids with the same key as each query."""
    return query.select(F.col("id").alias("query_id"), key).join(db.select("id", key), key).select("query_id", "id")


def rows_by_id(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a structure table with one of the ids."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """A new version of the table without the rows of the ids."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def with_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A new version of the table with the rows added; a row replaces one of the same id."""
    return without_ids(table, rows, key).unionByName(rows)


# --- near-duplicate clusters ---------------------------------------------------------


def least_hashes(bits: np.ndarray, heads: np.ndarray, pairs: list[tuple[int, int]]) -> list[np.ndarray]:
    """The least value of each hash function over every run of bits, runs given by their heads."""
    prime = N.MINHASH_PRIME
    if bits.min() < 0:
        return [np.minimum.reduceat((bits * a + b) % prime, heads) for a, b in pairs]
    bits, most, out = bits.astype(np.uint64), int(bits.max()), []
    value, part = np.empty_like(bits), np.empty_like(bits)
    for a, b in pairs:
        np.multiply(bits, np.uint64(a), out=value)
        value += np.uint64(b)
        top = most * a + b
        # The prime lies just below 2**32: taken off once per 2**32, it leaves little more than
        # the remainder, and no division is needed.
        while top >= 2 * prime:
            np.right_shift(value, np.uint64(32), out=part)
            part *= np.uint64(prime)
            value -= part
            top = (top >> 32) * ((1 << 32) - prime) + (1 << 32) - 1
        np.subtract(value, np.uint64(prime), out=part)
        np.minimum(value, part, out=value)
        out.append(np.minimum.reduceat(value, heads).astype(np.int64))
    return out


def minhash(fingerprints: DataFrame, n: int = 128, keyed: bool = False) -> DataFrame:
    """Signature per row as columns s0..: the least value of each hash function over the
    row's bits. Rows are folded where they are, in slices of their batch, and nothing is
    shuffled; rows without bits are left out. With ``keyed`` a digest of the row's bits comes
    along as ``_key``, and rows without bits stay, with nulls."""
    kind = fingerprints.schema["id"].dataType.simpleString()
    pairs = N.hash_pairs(n)
    names = ["id", *["_key"] * keyed, *[f"s{i}" for i in range(n)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                some = pc.fill_null(pc.greater(part.column("bits").value_lengths(), 0), False)
                none, part = part.filter(pc.invert(some)), part.filter(some)
                if keyed and none.num_rows:
                    empty = [pa.nulls(none.num_rows, pa.binary()), *[pa.nulls(none.num_rows, pa.int64())] * n]
                    yield pa.RecordBatch.from_arrays([none.column("id"), *empty], names=names)
                if part.num_rows:
                    bits = part.column("bits").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    sizes = part.column("bits").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    heads = np.cumsum(sizes) - sizes
                    keys = [pa.array([md5(bits[h : h + k].tobytes()).digest() for h, k in zip(heads, sizes)], pa.binary())] * keyed
                    least = [pa.array(x) for x in least_hashes(bits, heads, pairs)]
                    yield pa.RecordBatch.from_arrays([part.column("id"), *keys, *least], names=names)

    schema = ", ".join([f"id {kind}", *["_key binary"] * keyed, *[f"s{i} long" for i in range(n)]])
    rows = fingerprints if keyed else fingerprints.filter(F.size("bits") > 0)
    return rows.select("id", "bits").mapInArrow(run, schema)


def band_columns(bands: int, rows: int) -> list[Column]:
    """One 128-bit bucket key per band."""
    return [
        F.unhex(F.md5(F.concat_ws(",", F.lit(b), *[F.col(f"s{b * rows + r}") for r in range(rows)])))
        for b in range(bands)
    ]


def band_keys(signatures: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, bucket): the bucket keys of every row."""
    return signatures.select("id", F.explode(F.array(*band_columns(bands, rows))).alias("bucket"))


def lsh_buckets(fingerprints: DataFrame, threshold: float = 0.5, n: int = 128) -> DataFrame:
    bands, rows = N.band_shape(threshold, n)
    return band_keys(minhash(fingerprints, bands * rows), bands, rows)


def star_edges(buckets: DataFrame) -> DataFrame:
    """Every bucket's members tied to its least member: (id, hub), one edge per member. The
    buckets are computed once and stored; hubs and members read the table."""
    buckets = materialise(buckets, "buckets")
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return (
        buckets.join(hubs.select("bucket", "hub"), "bucket").filter("id <> hub").select("id", "hub").distinct()
    )


def lsh_candidates(fingerprints: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Candidate edges (id, hub). Edges stand for the bucket's pairs: two members of a bucket
    are linked through its hub."""
    return star_edges(lsh_buckets(fingerprints, threshold))


def verified_pairs(fingerprints: DataFrame, threshold: float = 0.5, least: float | None = None, tile: int = 256) -> DataFrame:
    """(id, other, sim), id < other: all pairs that share a bucket and have a Tanimoto
    similarity of ``least`` (``threshold`` if not given) and up.

    A row goes, once for all its buckets, to the families of their hubs, where a hub's family
    is named by its own least hub; so the rows of a bucket meet in one. A family is cut into
    blocks of about ``tile`` members that meet block by block, and small families share a block,
    so one of any size is spread over its pairs of blocks. Only similar pairs leave a block.
    Fold copies first: ids of equal bits are pairs of similarity 1.
    """
    least = threshold if least is None else least
    bands, rows = N.band_shape(threshold, 128)
    stored = materialise(fingerprints, "fingerprints")
    signed = materialise(minhash(stored, bands * rows).select("id", F.array(*band_columns(bands, rows)).alias("keys")), "band-keys")
    buckets = signed.select("id", F.explode("keys").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    linked = materialise(buckets.join(hubs, "bucket").select("id", "hub").distinct(), "linked")
    family = linked.groupBy("id").agg(F.min("hub").alias("family")).withColumnRenamed("id", "hub")
    homes = materialise(linked.join(family, "hub").select("id", "family").distinct(), "families")
    sizes = homes.groupBy("family").agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") <= tile
    bins = F.ceil(sizes.filter(small).agg(F.sum("_n")).scalar() / tile)
    spread = homes.join(sizes, "family").select(
        "id",
        F.when(small, F.pmod(F.xxhash64("family"), bins)).otherwise(F.xxhash64("family")).alias("place"),
        F.when(small, 1).otherwise(F.ceil(F.col("_n") / tile)).alias("blocks"),
    )
    spread = spread.select("id", "place", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    sent = spread.select(
        "id", "place", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("_o")
    ).select("id", "place", "block", F.least("block", "_o").alias("x"), F.greatest("block", "_o").alias("y"))
    whole = sent.distinct().join(signed.select("id", F.array_join(F.transform("keys", F.hex), "").alias("keys")), "id").join(stored, "id")
    kind = fingerprints.schema["id"].dataType.simpleString()
    met = whole.groupBy("place", "x", "y").applyInArrow(
        lambda rows: _tile_pairs(rows, bands, least), f"id {kind}, other {kind}, sim double"
    )
    ordered = met.filter("id <> other").select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), "sim")
    return ordered.distinct()


def _tile_pairs(rows: pa.Table, bands: int, least: float) -> pa.Table:
    """Pairs of rows of a tile, from its two blocks if they differ, that share a bucket key and
    are similar."""
    rows = rows.combine_chunks()
    ids, bits, block = rows.column("id").chunk(0), rows.column("bits").chunk(0), rows.column("block").to_numpy()
    sizes = bits.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = bits.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes) - sizes
    keys = np.frombuffer(bytes.fromhex("".join(rows.column("keys").to_pylist())), np.uint64).reshape(-1, 2)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    equal = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], equal, [0]]).astype(np.int8)))
    met = np.zeros((len(sizes), len(sizes)), bool)
    for start, end in turns.reshape(-1, 2):
        members = order[start : end + 1] // bands
        met[np.ix_(members, members)] = True
    if block.min() < block.max():
        met &= block[:, None] != block
    left, right = np.nonzero(np.triu(met, 1))
    low, high = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    near = low >= high * least - 1e-9
    left, right = left[near], right[near]

    def listed(which):
        length = sizes[which]
        return flat[np.arange(length.sum()) + np.repeat(starts[which] - (np.cumsum(length) - length), length)], length

    found = [np.zeros(0)]
    # Slices of about a million bits are compared at a time.
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[left] + sizes[right]) >> 20)) + 1
    for a, b in zip(np.split(left, cuts), np.split(right, cuts), strict=True):
        if len(a):
            shared = partenum.shared_counts(*listed(a), *listed(b))
            found.append(shared / (sizes[a] + sizes[b] - shared))
    sim = np.concatenate(found)
    hit = sim >= least - 1e-12
    return pa.table({"id": ids.take(pa.array(left[hit])), "other": ids.take(pa.array(right[hit])), "sim": sim[hit]})


def with_bits(fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with bits, the others as (id, null cluster))."""
    some = F.coalesce(F.size("bits") > 0, F.lit(False))
    kind = fingerprints.schema["id"].dataType
    return fingerprints.filter(some), fingerprints.filter(~some).select("id", F.lit(None).cast(kind).alias("cluster"))


def signed_copies(fingerprints: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(buckets of one row per distinct bit set, id to representative, rows without bits as
    (id, null cluster)). The bits are read once and neither stored nor shuffled: what goes on
    are their digests and bucket keys."""
    bands, rows = N.band_shape(threshold, 128)
    signed = minhash(fingerprints, bands * rows, keyed=True)
    signed = materialise(signed.select("id", "_key", F.array(*band_columns(bands, rows)).alias("keys")), "signed")
    kind = fingerprints.schema["id"].dataType
    failed = signed.filter("_key IS NULL").select("id", F.lit(None).cast(kind).alias("cluster"))
    usable = signed.filter("_key IS NOT NULL")
    reps = usable.groupBy("_key").agg(F.min("id").alias("rep"))
    members = materialise(usable.select("id", "_key").join(reps, "_key").select("id", "rep"), "members")
    first = usable.join(reps.select(F.col("rep").alias("id"), "_key"), ["id", "_key"], "left_semi")
    return first.select("id", F.explode("keys").alias("bucket")), members, failed


def component_clusters(fingerprints: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, cluster): closure of the bucket links; a row without links is its own cluster,
    one without bits has failed and has none."""
    buckets, members, failed = signed_copies(fingerprints, threshold)
    closed = connected_components(star_edges(buckets), "id", "hub")
    renamed = closed.select(F.col("vertex").alias("rep"), "component")
    named = members.join(renamed, "rep", "left").select("id", F.coalesce("component", "rep").alias("cluster"))
    return named.unionByName(failed)


def founders(buckets: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Ids that found a cluster when rows arrive in id order: a row joins if it shares a
    bucket with an earlier founder, else it founds.

    Each round settles the rows that are the least open row of all their buckets, and the
    rows that share a bucket with one of them; rounds repeat until none is open.
    """
    open_rows = materialise(buckets, "open-buckets")
    found = []
    for _ in range(max_rounds):
        least = open_rows.groupBy("bucket").agg(F.min("id").alias("_least"))
        lead = (
            open_rows.join(least, "bucket")
            .groupBy("id")
            .agg(F.min("_least").alias("_min"))
            .filter("_min = id")
            .select("id")
        )
        lead = materialise(lead, "founders")
        found.append(lead)
        taken = open_rows.join(lead, "id", "left_semi").select("bucket").distinct()
        settled = open_rows.join(taken, "bucket", "left_semi").select("id").distinct()
        open_rows = materialise(open_rows.join(settled, "id", "left_anti"), "open-buckets")
        if open_rows.isEmpty():
            break
    else:
        raise RuntimeError(f"founders did not settle in {max_rounds} rounds")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def leader_clusters(fingerprints: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, cluster) as if rows were added one by one in id order: the cluster is the least
    earlier founder sharing a bucket, or the row itself; a row without bits has none."""
    buckets, members, failed = signed_copies(fingerprints, threshold)
    buckets = materialise(buckets, "buckets")
    # A bucket of one row links nothing: a row that has no other founds, as the join below leaves it.
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    buckets = materialise(buckets.join(shared, "bucket", "left_semi"), "shared-buckets")
    lead = founders(buckets)
    posts = buckets.join(lead, "id", "left_semi").groupBy("bucket").agg(F.min("id").alias("cluster"))
    owner = buckets.join(posts, "bucket").groupBy("id").agg(F.min("cluster").alias("cluster"))
    renamed = owner.select(F.col("id").alias("rep"), "cluster")
    named = members.join(renamed, "rep", "left").select("id", F.coalesce("cluster", "rep").alias("cluster"))
    return named.unionByName(failed)


def cluster_stats(clusters: DataFrame, total: DataFrame) -> DataFrame:
    """Rows offered, clustered and failed, and the number of clusters."""
    sizes = clusters.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    done = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("processed"), F.count(F.lit(1)).alias("clusters"))
    offered = total.agg(F.count(F.lit(1))).scalar()
    return done.select(
        offered.alias("total"), "processed", (offered - F.col("processed")).alias("failed"), "clusters"
    )
