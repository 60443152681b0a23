"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, connected components.

Weighted shingles: five consecutive words (normalised as letters, digits and non-ASCII characters in lower case), each
weighted by its count; a text of fewer words is one shingle. ProbMinHash sees each shingle as a Poisson process whose
rate is its weight: arrivals hit random registers, a register keeps its earliest arrival, and a shingle stops as soon as
its next arrival is later than the latest register. Registers of two texts agree with the probability Jaccard similarity.

A link needs an exact similarity of 0.8: probability Jaccard of the counts, or plain Jaccard of the shingle sets,
whichever is larger. 30 bands of 6 registers find candidates (a pair at 0.8 is missed with probability 1e-4). A text that
repeats a shingle has a second signature with all weights 1, banded beside the weighted one, so that pairs alike in either
sense meet; in a text without repeats the two are the same. A class is a connected component of links, named by its
smallest doc_id.

Groups of any size stay cheap, without pairs within a group:

1. Texts of equal normalised words are one node from the start (partial aggregation by digest).
2. Star rounds: within a bucket every member is compared with one leader only, another one each round; buckets whose
   members already share a class are dropped.
3. The rest, members of unresolved buckets outside the leader's class, meets all other members in tasks of bounded
   size, where full signatures decide which pairs are worth an exact comparison, until nothing more can be joined. No
   partner or candidate is capped.

Components come from rounds of hooking to the smallest neighbour and pointer jumping on tables in the shared folder.

Defined results: null texts and texts without words form no links, each row its own class, unless their texts are equal
and not empty; a null doc_id gets a null class and takes no part; repeated doc_ids are one node per distinct text and all
rows of one doc_id share its class; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import LOWER, PLAIN, U64, listed, mapped, mix, normalise, remove, rows_of, shared_path, shuffles_end, slices, stage, utf8, window_hashes, window_starts, word_bounds, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 6
REGISTERS = BANDS * ROWS
STAR_ROUNDS = 2
#: Members of a bucket that meet as many others in one task of the last step.
BLOCK = 256
#: Bytes of text whose shingles are in memory at once.
SLICE = 512 << 10
#: Pairs of one leader that meet one copy of it.
SHARE = 256
#: Estimated similarity from which a pair is compared exactly: four standard deviations below the threshold.
ESTIMATE = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row, sorted by row and hash."""
    data, at = utf8(texts)
    data = LOWER[data]
    start, end, first = word_bounds(data, at, PLAIN)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    words = word_hashes(data, start, end)
    n = np.diff(first)
    position = window_starts(first, SHINGLE)
    rows, hashes = [rows_of(position, first)], [window_hashes(words, position, SHINGLE)]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n == size)
        rows.append(short)
        hashes.append(mix(window_hashes(words, first[short], size) + U64(size)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    edge = np.flatnonzero(new)
    return row[edge], h[edge], np.diff(np.append(edge, len(h)))


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers, n_rows x registers of 32 bits, 0 where a row has no element."""
    first = np.full(n_rows * registers, np.inf)
    kept = np.zeros(n_rows * registers, np.uint32)
    active, time, arrival = np.arange(len(h)), np.zeros(len(h)), 0
    while len(active):
        arrival += 1
        x = mix(h[active] + U64(arrival * 0x9E3779B97F4A7C15 % (1 << 64)))
        time[active] -= np.log(((x >> U64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[active]
        register = ((mix(x ^ U64(0xD6E8FEB86659FD93)) >> U64(32)) * U64(registers) >> U64(32)).astype(np.int64)
        slot, now = row[active] * registers + register, time[active]
        np.minimum.at(first, slot, now)
        won = first[slot] == now
        kept[slot[won]] = (h[active[won]] >> U64(32)).astype(np.uint32)
        if arrival % 4 == 1 or len(active) > n_rows * registers:
            rows = np.unique(row[active])
            latest = np.zeros(n_rows)
            latest[rows] = first.reshape(n_rows, registers)[rows].max(1)
            active = active[time[active] < latest[row[active]]]
    return kept.reshape(n_rows, registers)


def set_signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that repeat a shingle, their registers with all weights 1); in other rows ``weighted`` is that already."""
    again = np.unique(row[weight > 1])
    own = np.isin(row, again)
    return again, signatures(np.searchsorted(again, row[own]), h[own], np.ones(own.sum()), len(again), weighted.shape[1])


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key * U64(0x100000001B3) ^ parts[:, :, k])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of plain and probability Jaccard of two sorted (hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(both)
    plain = len(both) / union
    if a[1].max() == 1 and b[1].max() == 1 or not len(both) or plain >= THRESHOLD:
        return plain
    common, n = np.unique(np.stack([a[1][i], b[1][j]], 1), axis=0, return_counts=True)
    only_a, only_b = np.delete(a[1], i).sum(), np.delete(b[1], j).sum()
    total = 0.0
    for (x, y), times in zip(common, n, strict=True):
        total += times / ((np.maximum(common[:, 0] / x, common[:, 1] / y) * n).sum() + only_a / x + only_b / y)
    return max(plain, total)


def _digests(texts: pa.Array) -> list[bytes | None]:
    """128 bits of each text's normalised words, or of its bytes if it has no word; None if it is empty."""
    data, at = utf8(texts)
    whole = data.tobytes()
    out: list[bytes | None] = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        words = normalise(whole[a:b])
        if words:
            out.append(hashlib.blake2b(words, digest_size=16).digest())
        else:
            out.append(hashlib.blake2b(whole[a:b], digest_size=15).digest() if b > a else None)
    return out


def _sign(rows: DataFrame) -> DataFrame:
    """(id, digest, keys) of (id, t): keys are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE):
            row, h, n = shingles(batch.column(1))
            sig = signatures(row, h, n, batch.num_rows)
            key = bands(sig).view(np.int64)
            some = np.bincount(row, minlength=batch.num_rows) > 0
            keys = [key[k] if some[k] else None for k in range(batch.num_rows)]
            again, plain = set_signatures(row, h, n, sig)
            for k, more in zip(again, bands(plain).view(np.int64), strict=True):
                keys[k] = np.append(keys[k], more)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_digests(batch.column(1)), pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "keys"])

    return mapped(rows, run, "id long, digest binary, keys array<long>")


def _contents(texts: DataFrame, ids: DataFrame, name: str, room: str) -> DataFrame:
    """(id, h, n, sig, plain) of the texts whose id is in ``ids``: shingle hashes, their counts (empty if all are 1),
    registers, and registers with all weights 1 (empty if all counts are).

    Texts do not move, their shingles do once; the table is bucketed by id, so later joins on id move the other side only.
    """

    rows, part, lists = listed(texts, "id", ids, room)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (batch.filter(lists(batch.column(2), batch.column(0))) for batch in batches)
        for batch in slices(wanted, "t", SLICE):
            row, h, n = shingles(batch.column(1))
            sig = signatures(row, h, n, batch.num_rows)
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            hashes, counts, plain = [], [], [b""] * batch.num_rows
            for k, registers in zip(*set_signatures(row, h, n, sig), strict=True):
                plain[k] = registers.tobytes()
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                hashes.append(h[x:y].astype("<u8").tobytes())
                counts.append(n[x:y].astype("<u4").tobytes() if (n[x:y] > 1).any() else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(plain, pa.binary())], names=["id", "h", "n", "sig", "plain"])

    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = mapped(rows.select("id", "t", part.alias("part")), run, "id long, h binary, n binary, sig binary, plain binary")
    with shuffles_end(spark):
        made.repartition(n, "id").write.bucketBy(n, "id").option("path", f"{room}/shingles").saveAsTable(name)
    return spark.table(name)


def _unpacked(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.frombuffer(h, "<u8")
    return hashes, np.frombuffer(n, "<u4") if n else np.ones(len(hashes), np.uint32)


def _verified(pairs: DataFrame, content: DataFrame, threshold: float, room: str) -> DataFrame:
    """The (a, b) of ``pairs`` whose exact similarity reaches the threshold, staged.

    A leader ``b`` may be in most pairs, so it is dealt in a copy for each ``SHARE`` of its pairs.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("copies"))
    hot = many.where("copies > 1").select(F.col("b").bitwiseXOR(F.lit(1)).alias("_k"), "copies")
    dealt = pairs.withColumn("_j", F.col("b").bitwiseXOR(F.lit(1))).join(hot, F.col("_j") == F.col("_k"), "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).alias("copy"))
    leaders = many.join(content.withColumnRenamed("id", "b"), "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.struct("h", "n").alias("y"))
    left = dealt.join(content.select(F.col("id").alias("a"), F.struct("h", "n").alias("x")), "a")
    both = left.join(leaders, ["b", "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = lambda s: _unpacked(s["h"].as_py(), s["n"].as_py())
        for batch in batches:
            kept = [similarity(unpack(x), unpack(y)) >= threshold - 1e-9 for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return stage(mapped(both.select("a", "b", "x", "y"), run, "a long, b long"), "links", room)


def _relabel(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``column`` replaced by its root in ``to`` (id, root), where it has one.

    The join key is the id with one bit turned, so that both sides are dealt anew and Spark can split a skewed key.
    """
    mapped = to.select(F.col("id").bitwiseXOR(F.lit(1)).alias("_k"), F.col("root").alias("_to"))
    return df.withColumn("_j", F.col(column).bitwiseXOR(F.lit(1))).join(mapped, F.col("_j") == F.col("_k"), "left").withColumn(column, F.coalesce("_to", column)).drop("_j", "_k", "_to")


def components(links: DataFrame, room: str | None = None) -> DataFrame:
    """(id, root) of ids in ``links`` (a, b) that are not roots: root is the smallest id of the connected component.

    Every vertex hooks to its smallest neighbour, chains of hooks are halved until they end at roots, and the edges
    between roots go on: at most as many rounds as the logarithm of the number of vertices.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges", room)
    roots = None
    while not edges.isEmpty():
        hooks = stage(edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id"), "hooks", room)
        while True:
            hooks = stage(_relabel(hooks.select("id", "root", F.col("root").alias("before")), "root", hooks), "hooks", room)
            if hooks.where("root != before").isEmpty():
                break
        hooks = hooks.select("id", "root")
        roots = hooks if roots is None else stage(_relabel(roots, "root", hooks).unionByName(hooks), "roots", room)
        for c in ("u", "v"):
            edges = _relabel(edges, c, hooks)
        edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges", room)
    return roots if roots is not None else edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _classes(texts: DataFrame, keys: DataFrame, ties: DataFrame, threshold: float, star_rounds: int, name: str, room: str) -> DataFrame:
    """(id, root) for texts (id, t) with band keys (id, keys) and links known beforehand (a, b)."""
    turned = F.col("key").bitwiseXOR(F.lit(1))
    members = keys.select("id", F.explode("keys").alias("key")).distinct()
    many = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(turned.alias("key1"))
    members = stage(members.withColumn("key1", turned).join(many, "key1", "left_semi").select("id", "key"), "members", room)
    content = _contents(texts, members.select("id").distinct(), name, room)
    links, tested = ties, None
    roots = None if ties.isEmpty() else components(ties, room)
    for turn in range(star_rounds + 1):
        held = members.withColumn("root", F.col("id"))
        if roots is not None:
            held = _relabel(held, "root", roots)
        order = F.struct((F.xxhash64("id", F.lit(turn)) if turn else F.col("id")).alias("o"), F.col("id"), F.col("root"))
        buckets = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(order).alias("l"), F.count(F.lit(1)).alias("n"))
        buckets = buckets.where("low != high").select(turned.alias("key1"), F.col("l.id").alias("leader"), F.col("l.root").alias("leading"), "n")
        unresolved = held.withColumn("key1", turned).drop("key").join(buckets, "key1")
        if turn == star_rounds:
            found = stage(_rest(stage(unresolved, "unresolved", room), content, threshold, room), "links", room)
        else:
            pairs = unresolved.where("root != leading").select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stage(pairs, "pairs", room)
            tested = pairs if tested is None else tested.unionByName(pairs)
            found = _verified(pairs, content, threshold, room)
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links, room)
    return roots if roots is not None else ties.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _rest(unresolved: DataFrame, content: DataFrame, threshold: float, room: str | None = None) -> DataFrame:
    """Links between members of unresolved buckets that are in different classes, enough to connect what is connected.

    The members of a bucket are dealt in blocks, and those outside the leader's class in rows; a task holds the members
    of one block and one row, at most about 2 x BLOCK of them, however large the bucket. Signatures first tell which
    members have a partner worth an exact comparison; only their shingles move, and the comparisons stay inside the
    task, which returns links that join two classes, fewer than it has members.
    """
    others = F.col("root") != F.col("leading")
    rests = unresolved.where(others & (F.col("n") > BLOCK)).groupBy("key1").agg(F.count(F.lit(1)).alias("n_rest")).select(F.col("key1").alias("key2"), "n_rest")
    unresolved = unresolved.join(rests, F.col("key1").bitwiseXOR(F.lit(1)) == F.col("key2").bitwiseXOR(F.lit(1)), "left")
    blocks, lines = (F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / BLOCK)).cast("int") for c in (F.col("n"), F.col("n_rest")))
    block, line = (F.pmod(F.xxhash64("id", F.lit(k)), n).cast("int") for k, n in enumerate((blocks, lines)))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # a member stands in its block for every line, and, outside the leader's class, in its line for every block
    places = F.transform(every(lines), lambda x: F.struct(block.alias("block"), x.alias("line"), (others & (x == line)).alias("rest")))
    more = F.transform(every(blocks), lambda x: F.struct(x.alias("block"), line.alias("line"), F.lit(True).alias("rest")))
    more = F.filter(more, lambda x: x["block"] != block)
    dealt = unresolved.select("key1", "id", "root", F.explode(F.when(others, F.concat(places, more)).otherwise(places)).alias("x")).select("key1", "x.block", "x.line", "id", "root", "x.rest")
    signed = dealt.join(content.select("id", "sig", "plain"), "id")

    def both(pdf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted registers, the rows that repeat a shingle, and all rows' registers with all weights 1 (the same in others)."""
        sig = np.stack([np.frombuffer(s, np.uint32) for s in pdf["sig"]])
        again = np.flatnonzero([len(p) > 0 for p in pdf["plain"]])
        plain = sig if not len(again) else sig.copy()
        for k in again:
            plain[k] = np.frombuffer(pdf["plain"].iloc[k], np.uint32)
        return sig, again, plain

    def near(sigs: tuple[np.ndarray, np.ndarray, np.ndarray], root: np.ndarray, i: int) -> np.ndarray:
        """Which members of other classes agree with member i in either sense as far as a link may."""
        sig, again, plain = sigs
        other = np.flatnonzero(root != root[i])
        same = np.zeros(len(root))
        same[other] = (sig[other] == sig[i]).mean(1)
        if len(again):
            k = other if i in again else np.intersect1d(again, other, assume_unique=True)
            same[k] = np.maximum(same[k], (plain[k] == plain[i]).mean(1))
        return same >= ESTIMATE

    def worth(pdf):
        sigs = both(pdf)
        root, some = pdf["root"].to_numpy(), np.zeros(len(pdf), bool)
        for i in np.flatnonzero(pdf["rest"].to_numpy()):
            found = near(sigs, root, i)
            some |= found
            some[i] |= found.any()
        return pdf[some]

    kept = signed.groupBy("key1", "block", "line").applyInPandas(worth, "key1 long, block int, line int, id long, root long, rest boolean, sig binary, plain binary")
    full = stage(kept, "worth", room).join(content.select("id", "h", "n"), "id")

    def meet(pdf):
        import pandas as pd

        sigs = both(pdf)
        ids, root = pdf["id"].to_numpy(), pdf["root"].to_numpy().copy()
        sets = [_unpacked(h, n) for h, n in zip(pdf["h"], pdf["n"], strict=True)]
        size = np.array([len(h) for h, _ in sets])
        start, repeats = np.cumsum(size) - size, np.array([len(n) > 0 for n in pdf["n"]])
        # shingles by number: those shared with one member are counted for all others at once
        _, number = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
        mark, out = np.zeros(len(number), bool), []
        for i in np.flatnonzero(pdf["rest"].to_numpy()):
            some = np.flatnonzero(near(sigs, root, i))
            if not len(some):
                continue
            own = number[start[i] : start[i] + size[i]]
            mark[own] = True
            shared = np.add.reduceat(mark[number], start)[some]
            mark[own] = False
            plain = shared / (size[some] + size[i] - shared)
            for k in np.argsort(-plain, kind="stable"):
                j = some[k]
                if root[i] != root[j] and (plain[k] >= threshold - 1e-9 or shared[k] and (repeats[i] or repeats[j]) and similarity(sets[i], sets[j]) >= threshold - 1e-9):
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return full.groupBy("key1", "block", "line").applyInPandas(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``; class_id is the smallest doc_id of its class."""
    spark = docs.sparkSession
    name = f"shingles_{uuid.uuid4().hex}"
    room = shared_path(spark, "near")
    known = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    signed = stage(_sign(known.where("id is not null")), "signed", room)
    # one node for each distinct text: the smallest doc_id that has it
    heads = stage(signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("node")), "heads", room)
    again = F.concat(F.col("digest"), F.lit(b"\x01")).alias("d1")
    placed = stage(signed.select("id", again).join(heads.select(again, "node"), "d1", "left").select("id", F.coalesce("node", "id").alias("node")), "placed", room)
    # a doc_id with several texts ties their nodes together
    several = placed.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    ties = stage(placed.join(several, "id").select(F.greatest("node", "low").alias("a"), F.least("node", "low").alias("b")).where("a != b").distinct(), "ties", room)
    ids = heads.select(F.col("node").alias("id")).distinct()
    try:
        roots = _classes(known, signed.where("keys is not null").join(ids, "id", "left_semi"), ties, threshold, star_rounds, name, room)
        classes = stage(_relabel(placed, "node", roots).select(F.col("id").alias(doc_id), F.col("node").alias("class_id")), "classes")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, room)
    lost = known.where("id is null").select(F.col("id").alias(doc_id), F.lit(None).cast("long").alias("class_id"))
    return classes.unionByName(lost)
