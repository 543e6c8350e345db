"""Plumbing that several operators share: scratch tables, row gates and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh

#: Bits of a row gate: GATE_SPREAD for each key, from 1 MB to 16 MB whatever the size of the input.
LEAST_GATE, MOST_GATE, GATE_SPREAD = 1 << 23, 1 << 27, 8
#: Slices in which the bitmap of a PackedGate is put together.
SLICES = 64
#: Rows that go to a Python worker at once, where the session has Spark's own setting: 10 000 long texts are too much.
BATCH_ROWS = 2000


def gate_size(keys: int) -> int:
    """Bits of a gate for so many keys, a power of two; with more keys than fit, a gate lets more rows through."""
    return min(MOST_GATE, max(LEAST_GATE, 1 << max(0, keys * GATE_SPREAD - 1).bit_length()))


def small_batches(spark: SparkSession) -> None:
    """Set BATCH_ROWS for the session unless it has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow; once its rows end, the worker gives freed memory back, as idle workers stay beside the busy ones."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        wh.forget()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs in this process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder in place of lineage; drop() frees those no later step reads, close() all but the named.

    What a returned DataFrame still reads stays until the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.live: set[str] = set()
        small_batches(spark)
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            delete_path(self.spark, self.root)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back: a lost executor costs a re-read, not a re-run."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        self.live.add(path)
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            path = getattr(df, "_scratch", None)
            if path in self.live:
                self.live.discard(path)
                delete_path(self.spark, path)

    def settle(self) -> None:
        """Free the shuffle files of steps that are over: Spark removes them once the driver's garbage is collected, which may be long."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self, *kept: DataFrame) -> None:
        """Free every table but those of `kept`."""
        for path in self.live - {getattr(df, "_scratch", None) for df in kept}:
            self.live.discard(path)
            delete_path(self.spark, path)


def _bitmap(spark: SparkSession, positions: DataFrame, bits: int):
    """The broadcast bitmap of the column p of positions."""
    words = (
        positions.select(F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    table = np.zeros(bits >> 6, np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    return spark.sparkContext.broadcast(table.view(np.uint64))


class Gate:
    """A one-hash bitmap of bounded size over a set of 64-bit marks; a mark's position is its low bits.

    It answers "certainly not in the set" or "maybe", and keeps rows that cannot match out of a shuffle. What it lets
    through is still matched exactly, so it never decides a result. Its size is bounded by MOST_GATE: a fuller bitmap
    only lets more rows through.
    """

    def __init__(self, spark: SparkSession, marks: DataFrame, bits: int | None = None):
        bits = bits or gate_size(marks.count())
        self.bits, self.table = bits, _bitmap(spark, marks.select(F.col(marks.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("p")), bits)


class PackedGate:
    """A Gate over rows that hold many 64-bit marks each, as bytes; the bitmap comes together in slices, without a row for each mark."""

    def __init__(self, spark: SparkSession, packed: DataFrame, bits: int):
        slices = min(SLICES, bits >> 6)
        step = bits // slices

        @trimmed
        def cut(batches):
            for b in batches:
                buf, offs = wh.strings(b.column(0))
                p = np.unique(np.frombuffer(buf[offs[0] : offs[-1]].tobytes(), np.uint64) & np.uint64(bits - 1)).astype(np.uint32)
                at = np.searchsorted(p, np.arange(slices + 1) * step)
                some = np.flatnonzero(np.diff(at)).tolist()
                places = [(p[at[k] : at[k + 1]] - np.uint32(k * step)).tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(places, pa.binary())], names=["slice", "places"])

        @trimmed
        def join(batches):
            for t, at in runs_of(batches, ["slice"]):
                for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    marks = np.zeros(step, np.uint8)
                    for raw in t["places"].slice(i, j - i):
                        marks[np.frombuffer(raw.as_buffer(), np.uint32)] = 1
                    words = pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([t["slice"].slice(i, 1).combine_chunks().cast(pa.int32()), words], names=["slice", "words"])

        dealt = packed.mapInArrow(cut, "slice int, places binary").repartition("slice").sortWithinPartitions("slice")
        table = np.zeros(bits >> 6, np.uint64)
        for row in dealt.mapInArrow(join, "slice int, words binary").toArrow().to_pylist():
            table[row["slice"] * (step >> 6) :][: step >> 6] = np.frombuffer(row["words"], np.uint64)
        self.bits, self.table = bits, spark.sparkContext.broadcast(table)


class KeyGate:
    """A Gate over 64-bit keys that are mixed with a salt first."""

    def __init__(self, spark: SparkSession, df: DataFrame, column: str, salt: int, bits: int):
        @trimmed
        def run(batches):
            for b in batches:
                x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((wh.mix(x, salt) & np.uint64(bits - 1)).astype(np.int64))], names=["p"])

        self.bits, self.table = bits, _bitmap(spark, df.select(column).mapInArrow(run, "p long"), bits)


def test_bits(table: np.ndarray, positions: np.ndarray) -> np.ndarray:
    p = positions.astype(np.uint64)
    return (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for every node that has an edge.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each is one group-by on a node, with a
    map-side minimum, so a hub is not gathered in one task; every round is written to the shared folder.
    A null or empty edge set gives no rows. Nodes may be of any ordered type.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = scratch.keep(pairs, "links")
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = scratch.keep(small, "small")
        scratch.drop(pairs, large)
        pairs = small
        # done once every node points at one other, which points nowhere
        ends = small.select(F.col("a").alias("n"), F.lit(1).alias("p"), F.lit(0).alias("q")).unionAll(small.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("n").agg(F.sum("p").alias("p"), F.max("q").alias("q")).where("p > 1 or (p > 0 and q > 0)").take(1):
            break
    else:
        raise RuntimeError("components did not converge")
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _verified(pairs: DataFrame, payloads: DataFrame, linked: Callable[[list[bytes], list[bytes]], list[int]]) -> DataFrame:
    @trimmed
    def run(batches):
        for b in batches:
            for at in range(0, len(b), VERIFIED):
                c = b.slice(at, VERIFIED)
                keep = pa.array(linked(c.column(2).to_pylist(), c.column(3).to_pylist()), pa.int32())
                yield pa.RecordBatch.from_arrays([c.column(0).take(keep), c.column(1).take(keep)], names=["a", "b"])

    one = payloads.select(F.col("node").alias("a"), F.col("payload").alias("pa"))
    two = payloads.select(F.col("node").alias("b"), F.col("payload").alias("pb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


#: Pairs unpacked at a time.
VERIFIED = 512
#: Members of a list whose sketches are compared at once; a longer list is cut into parts, and pairs of parts are compared.
LIST_PART = 1024
#: Members of a group that are verified at once, and their tokens or characters; a larger group is cut into parts likewise.
GROUP_PART, GROUP_SIZE = 512, 1 << 20
#: Groups are dealt in turns, each of this many times what their members hold once each; a group in many parts, or a member of many groups, is dealt often.
DEALT = 2
#: Pivots that the lists with a common member name in one round.
PIVOTS = 4


def parity_sketch(tokens: np.ndarray, words: int) -> bytes:
    """Bit i of 64 * words is the parity of the tokens that hash to i, so two sketches differ in no more bits than their sets in tokens."""
    places = (wh.mix(tokens, 0x5EC7) >> np.uint64(20)) % np.uint64(64 * words)
    odd = (np.bincount(places.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def parity_sketches(tokens: np.ndarray, counts: np.ndarray, words: int) -> list[bytes]:
    """parity_sketch() of the first counts[0] tokens, the next counts[1] and so on, some 4096 at a time."""
    size, out = 64 * words, []
    ends = np.append(0, np.cumsum(counts))
    places = ((wh.mix(tokens, 0x5EC7) >> np.uint64(20)) % np.uint64(size)).astype(np.int64)
    for at in range(0, len(counts), 4096):
        some = counts[at : at + 4096]
        own = places[ends[at] : ends[at + len(some)]] + np.repeat(np.arange(len(some)) * size, some)
        odd = (np.bincount(own, minlength=len(some) * size) & 1).astype(np.uint8)
        out += [x.tobytes() for x in np.packbits(odd.reshape(len(some), size), axis=1, bitorder="little")]
    return out


class _Sketches:
    """Parity sketches of one or several widths, each a multiple of the narrower ones, that are compared at the narrower width."""

    def __init__(self, column: pa.Array):
        buf, offs = wh.strings(column)
        self.width = np.diff(offs) // 8
        self.rows = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.rows[w] = np.ascontiguousarray(buf[offs[at][:, None] + np.arange(8 * w)[None]]).view(np.uint64)
        self.place = np.zeros(len(self.width), np.int64)
        for w in self.rows:
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))

    def _at(self, rows: np.ndarray, wide: int, narrow: int) -> np.ndarray:
        """Sketches of this width, folded: the parity at a place of the narrower one is that of all places it stands for."""
        found = self.rows[wide][self.place[rows]]
        return found if wide == narrow else np.bitwise_xor.reduce(found.reshape(len(rows), wide // narrow, narrow), 1)

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which each of a differs from each of b."""
        out = np.zeros((len(a), len(b)), np.int64)
        for p in np.unique(self.width[a]).tolist():
            i = np.flatnonzero(self.width[a] == p)
            for q in np.unique(self.width[b]).tolist():
                j, w = np.flatnonzero(self.width[b] == q), min(p, q)
                two = self._at(b[j], q, w)
                step = max(1, (1 << 20) // max(1, two.size))
                for x in range(0, len(i) if w else 0, step):
                    some = i[x : x + step]
                    out[some[:, None], j[None]] = np.bitwise_count(self._at(a[some], p, w)[:, None, :] ^ two[None]).sum(2, dtype=np.int64)
        return out

    def paired(self, other: _Sketches) -> np.ndarray:
        """Bits in which each row differs from the same row of `other`."""
        out = np.zeros(len(self.width), np.int64)
        for p, q in {*zip(self.width.tolist(), other.width.tolist(), strict=True)}:
            at, w = np.flatnonzero((self.width == p) & (other.width == q)), min(p, q)
            if w:
                out[at] = np.bitwise_count(self._at(at, p, w) ^ other._at(at, q, w)).sum(1, dtype=np.int64)
        return out


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups of rows that agree in `keys`, with the numbers of the rows at which a group begins."""
    held = None
    for b in _with_end(batches):
        if b is not None:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
        if held is None or not len(held):
            continue
        new = np.zeros(len(held), bool)
        new[0] = True
        for k in keys:
            v = held[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        at = np.append(np.flatnonzero(new), len(held))
        last = len(at) - 1 if b is None else len(at) - 2  # the last group may go on in the next batch
        if last > 0:
            yield held.slice(0, int(at[last])), at[: last + 1]
            held = held.slice(int(at[last]))


def _with_end(batches):
    yield from batches
    yield None


def _dealt(rows: DataFrame, key: str, parts: Column, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """rows once for each other part of their group, with lo and hi, the parts that meet, and own, the row's part; sorted by group.

    Of several turns (i, turns) each has its own meetings of parts.
    """
    rows = rows.withColumn("_parts", parts.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    rows = rows.withColumn("lo", F.least("own", "q")).withColumn("hi", F.greatest("own", "q")).drop("q")
    if turn[1] > 1:
        rows = rows.where(F.pmod(F.xxhash64(key, "lo", "hi", F.lit(0x7075)), F.lit(turn[1])) == turn[0])
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _turns(sizes: DataFrame, parts: Column, size: Column, once: float) -> int:
    """In how many turns groups (one row of sizes each) are dealt so that a turn deals some DEALT times `once`, the size of all members once each."""
    dealt = sizes.agg(F.sum(parts * size)).first()[0] or 0
    return max(1, -(-int(dealt) // max(1, int(DEALT * once))))


def _in_turns(scratch: Scratch, turns: int, name: str, deal: Callable[[tuple[int, int]], DataFrame]) -> DataFrame:
    """The rows of all turns; what a turn has shuffled is freed before the next."""
    out = None
    for i in range(turns):
        found = scratch.keep(deal((i, turns)), name)
        out = found if out is None else out.unionByName(found)
        if turns > 1:
            scratch.settle()
    return out


def _list_parts() -> Column:
    return F.ceil(F.col("c") / LIST_PART)


def _near_groups(rest: DataFrame, most: Near, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """(key, node): groups of nodes that a chain of pairs joins whose sketches don't rule them out, within lists of rest(key, node, n, root, sketch, c).

    Only pairs of different components count. No pair is made as a row: at most 2 * LIST_PART members are compared in
    memory, and a group is named by its smallest node, so that lists with the same members give the same group.
    """
    rows = _dealt(rest.select("key", "node", "n", "root", "sketch", "c"), "key", _list_parts(), turn).drop("c")

    def compare(node, n, root, own, sketch: _Sketches, at: int, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        right = np.arange(len(node)) if lo == hi else np.flatnonzero(own == hi)
        left = right if lo == hi else np.flatnonzero(own == lo)
        name = node.copy()
        touched = np.zeros(len(node), bool)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for x in range(0, len(left), 128):
            some = left[x : x + 128]
            far = sketch.far(at + some, at + right)
            p, q = np.nonzero((root[some][:, None] != root[right][None]) & (far <= most(n[some][:, None], n[right][None])))
            ends.append((some[p], right[q]))
        p, q = (np.concatenate(e) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 2
        touched[p] = touched[q] = True
        while True:  # the smallest name spreads along the pairs
            low = np.minimum(name[p], name[q])
            before = name.copy()
            np.minimum.at(name, p, low)
            np.minimum.at(name, q, low)
            if (name == before).all():
                return name[touched], node[touched]

    @trimmed
    def run(batches):
        for t, at in runs_of(batches, ["key", "lo", "hi"]):
            t = t.combine_chunks()
            node, n, root, own, lo, hi = (t[c].to_numpy() for c in ("node", "n", "root", "own", "lo", "hi"))
            sketch = _Sketches(t["sketch"])
            found = [compare(node[i:j], n[i:j], root[i:j], own[i:j], sketch, i, lo[i], hi[i]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if j - i > 1]
            if found:
                pairs = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["key", "node"])

    return rows.mapInArrow(run, "key long, node long").distinct()


def _group_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.sum("n").alias("_size"), F.count(F.lit(1)).alias("_c"))


def _group_parts() -> Column:
    return F.greatest(F.ceil((F.col("_size") + 1) / GROUP_SIZE), F.ceil(F.col("_c") / GROUP_PART))


def _spanning(members: DataFrame, payloads: DataFrame, most: Near, which: Callable[[list, np.ndarray, np.ndarray], np.ndarray], unpack: Callable[[bytes], object], turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """Links (a, b) that join what the linked pairs in each group of members(key, node, n, root, sketch) join.

    Groups are verified in memory, in parts of GROUP_PART members and GROUP_SIZE. A pair is verified only while its ends are in different
    components, so a group gives fewer links than it has members. payloads(node, payload) is read once.
    """
    rows = _dealt(members.join(_group_sizes(members), "key").join(payloads, "node"), "key", _group_parts(), turn).drop("_size", "_c")

    def join(node, n, root, own, sketch: _Sketches, at: int, raw, lo, hi) -> list[tuple[int, int]]:
        right = np.arange(len(node)) if lo == hi else np.flatnonzero(own == hi)
        left = right if lo == hi else np.flatnonzero(own == lo)
        if not len(left):  # all members of this group are in the other part
            return []
        ends = []
        for x in range(0, len(left), 128):
            some = left[x : x + 128]
            far = sketch.far(at + some, at + right)
            p, q = np.nonzero((root[some][:, None] != root[right][None]) & (far <= most(n[some][:, None], n[right][None])) & ((some[:, None] < right[None]) | (lo != hi)))
            ends.append((some[p], right[q], far[p, q]))
        p, q, far = (np.concatenate(e) for e in zip(*ends, strict=True))
        order = np.argsort(far, kind="stable")  # the nearest pairs first, as each link rules out others
        p, q = p[order], q[order]
        part, sets, out = root.copy(), [unpack(x) for x in raw], []
        x, step = 0, 64
        while x < len(p):
            i, j = p[x : x + step], q[x : x + step]
            x, step = x + step, min(4 * step, 4096)
            open_ = part[i] != part[j]
            i, j = i[open_], j[open_]
            for k in np.flatnonzero(which(sets, i, j)).tolist() if len(i) else ():
                if part[i[k]] != part[j[k]]:
                    out.append((int(node[i[k]]), int(node[j[k]])))
                    part[part == part[j[k]]] = part[i[k]]
        return out

    @trimmed
    def run(batches):
        for t, at in runs_of(batches, ["key", "lo", "hi"]):
            t = t.combine_chunks()
            node, n, root, own, lo, hi = (t[c].to_numpy() for c in ("node", "n", "root", "own", "lo", "hi"))
            sketch, found = _Sketches(t["sketch"]), []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i > 1:
                    found += join(node[i:j], n[i:j], root[i:j], own[i:j], sketch, i, t["payload"].slice(i, j - i).to_pylist(), lo[i], hi[i])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _possible(pairs: DataFrame, known: DataFrame, most: Near) -> DataFrame:
    """(a, b) of the pairs (a, n, b, m) that their sketches don't rule out."""

    @trimmed
    def run(batches):
        for b in batches:
            n, m = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "m"))
            far = _Sketches(b.column("sa")).paired(_Sketches(b.column("sb")))
            yield b.select(["a", "b"]).filter(pa.array(far <= most(n, m)))

    one = known.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    two = known.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "sa", "sb").mapInArrow(run, "a long, b long")


def resolve_lists(
    scratch: Scratch,
    lists: DataFrame,
    close: Callable[[Column, Column], Column],
    fetch: Callable[[DataFrame], DataFrame],
    linked,
    sketches: Callable[[DataFrame], DataFrame],
    most: Near,
    rounds: int,
    finer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Links (a, b) whose components are those of all linked pairs that share a list.

    lists(key, node, n) holds each member once. sketches(nodes) gives (node, sketch), and may give payloads as well;
    two members that differ in more than most(n, m) bits can't be linked. In each of `rounds` rounds every list that
    holds several components names a pivot, its other members are verified against that, and components contract; a
    pivot leaves its lists. After that, members of different components that still share a list form groups by their
    sketches, and inside each group pairs are verified until its components are known. finer(nodes) gives wider
    sketches, by which groups fall apart before payloads are read. close(n, m) may rule out a pair
    by its sizes, fetch(nodes) gives (node, payload); linked(payloads, payloads) picks the pairs that link, and
    linked.which(unpacked, i, j) says which pairs do of members that linked.unpack has taken apart.
    """
    spark, links, done, labels = scratch.spark, None, None, None
    company = lists.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    given, lists = lists, scratch.keep(lists.join(company, "key", "left_semi"), "company")
    scratch.drop(given)
    scratch.settle()
    if not lists.take(1):
        return spark.createDataFrame([], "a long, b long")
    known = scratch.keep(sketches(lists.select("node").distinct()), "sketches")

    def open_lists() -> DataFrame:
        out = lists
        if labels is not None:
            out = out.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        else:
            out = out.withColumn("root", F.col("node"))
        if done is not None:  # a pivot has been held against every member of its list
            out = out.join(done, ["key", "node"], "left_anti")
        return out

    def payloads(nodes: DataFrame) -> DataFrame:
        return known if "payload" in known.columns else scratch.keep(fetch(nodes.distinct()), "payloads")

    def add(found: DataFrame) -> DataFrame:
        # the labels stand for the links that gave them
        return found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))

    for turn in range(rounds):
        open_ = open_lists()
        # lists with common members choose among the same few pivots, so a member meets few of them
        order = F.xxhash64("node", F.pmod("key", F.lit(PIVOTS)), F.lit(turn))
        several = open_.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.struct(order.alias("o"), "node", "n", "root")).alias("p")).where("r0 <> r1")
        several = scratch.keep(several.select("key", F.col("p.node").alias("b"), F.col("p.n").alias("m"), F.col("p.root").alias("rb")), "pivots")
        pairs = open_.join(several, "key").where((F.col("root") != F.col("rb")) & (F.col("node") != F.col("b")) & close(F.col("n"), F.col("m")))
        pairs = scratch.keep(_possible(pairs.select(F.col("node").alias("a"), "n", "b", "m").distinct(), known, most), "pairs")
        now = several.select("key", F.col("b").alias("node"))
        done = now if done is None else done.unionByName(now)
        if not pairs.take(1):
            continue
        texts = payloads(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
        links = add(scratch.keep(_verified(pairs, texts, linked), "links"))
        scratch.drop(pairs, *([] if texts is known else [texts]))
        labels = components(scratch, links)
        scratch.settle()

    open_ = open_lists()
    several = open_.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("c")).where("r0 <> r1")
    rest = scratch.keep(open_.join(several.select("key", "c"), "key").select("key", "node", "n", "root", "c"), "rest")
    scratch.drop(lists)
    scratch.settle()
    facts = rest.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"))

    def groups_of(lists: DataFrame, sketches: DataFrame, name: str) -> DataFrame:
        """(key, node, n, root) of the groups that these sketches leave of lists(key, node, n, root, c)."""
        sizes = lists.groupBy("key").agg(F.first("c").alias("c"))
        turns = _turns(sizes, _list_parts(), F.col("c"), lists.count())
        near = _in_turns(scratch, turns, name, lambda turn: _near_groups(lists.join(sketches.select("node", "sketch"), "node"), most, turn))
        return scratch.keep((near.distinct() if turns > 1 else near).join(facts, "node"), "members")

    members = groups_of(rest, known, "groups")
    scratch.settle()
    if finer is not None and members.take(1):
        wide = scratch.keep(finer(members.select("node").distinct()), "finer")
        some = scratch.keep(members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key"), "some")
        members, known = groups_of(some, wide, "closer"), wide
        scratch.settle()
    if members.take(1):
        once = members.groupBy("node").agg(F.first("n").alias("n")).agg(F.sum("n")).first()[0]
        turns = _turns(_group_sizes(members), _group_parts(), F.col("_size"), once)
        members = scratch.keep(members.join(known.select("node", "sketch"), "node"), "sketched")
        # the payloads go from the texts to their groups without a table between, unless they are dealt in turns
        texts = known if "payload" in known.columns else fetch(members.select("node").distinct())
        if turns > 1 and texts is not known:
            texts = scratch.keep(texts, "payloads")
        scratch.settle()
        links = add(_in_turns(scratch, turns, "links", lambda turn: _spanning(members, texts.select("node", "payload"), most, linked.which, linked.unpack, turn)))
        scratch.drop(rest, members, known, texts)
        scratch.settle()
    return links if links is not None else spark.createDataFrame([], "a long, b long")
