"""N-gram Jaccard join: size-aware, heavy and light, without all pairs of a group.

Documents become sets of word shingles; equal sets are one node. Two nodes are linked when their Jaccard similarity
reaches NUM / DEN.

Light sets (fewer shingles than a boundary) enumerate their subsets of the fixed sizes that a linked partner must
share; heavy sets, and light ones large enough to be linked with a heavy one, stand in inverted lists under the
necessary prefix of their shingles, rare ones first. The boundary is where enumerating stops being cheaper than
scanning the lists, by the counts of the corpus.

A list is not expanded into its pairs. Each list names one pivot, every other member is verified against it, and
components contract. Only lists that still hold several components go on: their members are compared in memory by
parity sketches, whose distance is a lower bound of the sets' difference. Those of different components that the
sketches can't rule out form groups, and a group's pairs are verified in memory until its components are known. So a
group of n near copies gives at most n - 1 links, and no link between different components stays untested.

Counts, orders and lists are over all documents. Frequent shingles are named by a list of at most MOST_FREQUENT
entries, which is broadcast; it only orders shingles, so it decides cost and never results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import KeyGate, Scratch, components, gate_size, parity_sketch, resolve_lists, test_bits, trimmed

WORDS, NUM, DEN = 4, 85, 100
MOST_FREQUENT = 1 << 18
#: A shingle in fewer prefixes than this is never held to be frequent.
LEAST_FREQUENT = 8
#: Rounds with pivots before the rest of the lists is compared member by member.
PIVOT_ROUNDS = 1
#: Words of 64 bits of the sketch that rules out pairs, for sets of up to SKETCHED shingles; four and sixteen times as many for larger sets.
SKETCH_WORDS, SKETCHED = 16, 1800
#: Sets of this size or more are never enumerated: their subsets are too many at any price.
MOST_LIGHT = 24
U = np.uint64
KEYS, NODES = 0x6A7E, 0x40DE  # salts of the two gates


class Measure:
    """Sizes and overlaps that a similarity of num / den asks for, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least_size(self, n):
        """The smallest set that can be linked with one of n."""
        return -(-self.num * n // self.den)

    def overlap(self, a, b):
        """The overlap that links sets of a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n):
        return n - self.least_size(n) + 1

    def subset_sizes(self, n: int, below: int) -> list[int]:
        """Overlaps with all partners of another or the same size under `below`; equal sets are one node already."""
        partners = range(self.least_size(n), min(below, n * self.den // self.num + 1))
        return sorted({o for m in partners if (o := self.overlap(n, m)) <= min(n, m) and not (m == n and o == n)})

    def subsets(self, n: int, below: int) -> int:
        return sum(comb(n, o) for o in self.subset_sizes(n, below))


def shingle_sets(batches: Iterator[pa.RecordBatch], column: int, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """For each batch the sorted distinct shingle hashes of each text. Fewer than k words are one shingle, no words none."""
    for b in batches:
        out: list[np.ndarray] = []
        for _, _, part, offs in wh.pieces(*wh.strings(b.column(column))):
            starts, ends, first = wh.words(part, offs, wh.SPACE_WORDS)
            h = wh.word_hashes(part, starts, ends, fold=True)
            grams = wh.window_hashes(h, k)
            n = np.diff(first)
            whole = wh.span_hashes(h, first[:-1], first[1:]) if (n < k).any() else None
            for d, (a, m) in enumerate(zip(first[:-1].tolist(), n.tolist(), strict=True)):
                if m >= k:
                    x = np.sort(grams[a : a + m - k + 1])
                    keep = np.empty(len(x), bool)
                    keep[0] = True
                    np.not_equal(x[1:], x[:-1], out=keep[1:])
                    out.append(x[keep])
                else:
                    out.append(whole[d : d + 1] if m else h[:0])
        yield b, out


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set, 0 of an empty one."""
    out = np.zeros(len(sets), np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    # some sets at a time, to bound what is copied
    for at in np.split(full, np.flatnonzero(np.diff(np.cumsum(sizes[full]) >> 20)) + 1):
        if len(at):
            n = sizes[at]
            with np.errstate(over="ignore"):
                total = np.add.reduceat(wh.mix(np.concatenate([sets[i] for i in at.tolist()]), 0x5EED), np.cumsum(n) - n)
                out[at] = wh.mix(total + n.astype(U) * U(0x9E3779B97F4A7C15), 0x0DD).view(np.int64)
    return out


def _nodes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n, node) of every row; no node without shingles."""

    @trimmed
    def run(batches):
        for b, sets in shingle_sets(batches, 2, k):
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(nodes_of(sets), mask=n == 0)], names=["doc_id", "text_hash", "n", "node"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, rows.select("doc_id", "text_hash").withColumn("n", F.lit(0).cast("long")).withColumn("node", F.lit(None).cast("long")).schema)


def _wanted(sets: list[np.ndarray], gate: KeyGate) -> tuple[list[int], list[np.ndarray]]:
    """The nodes that the gate lets through and their sets, once each."""
    nodes, first = np.unique(nodes_of(sets), return_index=True)
    ok = test_bits(gate.table.value, wh.mix(nodes.view(U), NODES) & U(gate.bits - 1)) & (nodes != 0)
    return nodes[ok].tolist(), [sets[i] for i in first[ok].tolist()]


class _Peek:
    """What a task needs of a gate: its bits and the broadcast table."""

    def __init__(self, gate: KeyGate):
        self.bits, self.table = gate.bits, gate.table


def _of_nodes(docs: DataFrame, k: int, gate: KeyGate, name: str, form) -> DataFrame:
    """(node, `name`) by form(set), of the nodes that the gate lets through, once each."""
    gate = _Peek(gate)

    @trimmed
    def run(batches):
        for _, sets in shingle_sets(batches, 0, k):
            keep, found = _wanted(sets, gate)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array([form(s) for s in found], pa.binary())], names=["node", name])

    return docs.select("text").mapInArrow(run, f"node long, {name} binary").groupBy("node").agg(F.first(name).alias(name))


def _wide_sketches(docs: DataFrame, k: int, gate: KeyGate) -> DataFrame:
    """Sketches of 4 to 8 bits a shingle, in widths that are powers of two: an eighth of a payload at most."""
    return _of_nodes(docs, k, gate, "sketch", lambda s: parity_sketch(s, max(SKETCH_WORDS, 1 << (len(s) // 16).bit_length())))


def _sketches(docs: DataFrame, k: int, gate: KeyGate) -> DataFrame:
    return _of_nodes(docs, k, gate, "sketch", lambda s: parity_sketch(s, SKETCH_WORDS * (1 if len(s) <= SKETCHED else 4 if len(s) <= 4 * SKETCHED else 16)))


def _sets(docs: DataFrame, k: int, gate: KeyGate) -> DataFrame:
    """(node, payload): the sorted 64-bit hashes of each shingle."""
    return _of_nodes(docs, k, gate, "payload", lambda s: s.astype("<u8").tobytes())


class _Order:
    """Rare shingles first: those that are not frequent by hash, then the frequent ones by frequency and hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.level = tokens[at], np.log2(np.maximum(counts[at], 1)).astype(np.int8) + 1
        self.flags = np.zeros(1 << 22, bool)
        self.flags[(self.tokens >> U(42)).astype(np.int64)] = True

    def prefix(self, tokens: np.ndarray, size: int) -> np.ndarray:
        maybe = np.flatnonzero(self.flags[(tokens >> U(42)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens[maybe]
            if hit.any():
                level = np.zeros(len(tokens), np.int8)
                level[maybe[hit]] = self.level[at[hit]]
                return tokens[np.argsort(level, kind="stable")[:size]]
        return tokens[:size]


_NO_ORDER = (np.zeros(0, U), np.zeros(0, np.int64))


def _emit(docs: DataFrame, k: int, measure: Measure, boundary: int, order, gate: KeyGate | None, counting: bool) -> DataFrame:
    """Rows (key[, node, n]) of inverted lists and of subsets; with a gate, of keys that may have two members."""
    lists_from = measure.least_size(boundary)
    shared_order = docs.sparkSession.sparkContext.broadcast(order)
    gate_bits, gate_table = (gate.bits, gate.table) if gate else (0, None)

    @trimmed
    def run(batches):
        rank = _Order(*shared_order.value)
        for _, sets in shingle_sets(batches, 0, k):
            keys, nodes, sizes = [], [], []
            names = np.zeros(len(sets), np.int64) if counting else nodes_of(sets)
            for s, name in zip(sets, names.tolist(), strict=True):
                n = len(s)
                if not n:
                    continue
                own = []
                if n >= lists_from:
                    own.append(rank.prefix(s, int(measure.prefix(n))))
                if n < boundary:
                    mixed = wh.mix(s, 0x50B5)
                    for o in measure.subset_sizes(n, boundary):
                        drop = np.array(list(combinations(range(n), n - o)), np.int64).reshape(comb(n, o), n - o)
                        with np.errstate(over="ignore"):
                            left = mixed.sum(dtype=U) - mixed[drop].sum(1, dtype=U)
                            own.append(wh.mix(left + U(o), 0x50B6))
                if own:
                    own = np.concatenate(own)
                    keys.append(own)
                    nodes.append(np.full(len(own), name, np.int64))
                    sizes.append(np.full(len(own), n, np.int32))
            key = np.concatenate(keys) if keys else np.zeros(0, U)
            if counting:
                yield pa.RecordBatch.from_arrays([pa.array(wh.signed(key))], names=["key"])
                continue
            node, n = np.concatenate(nodes) if nodes else np.zeros(0, np.int64), np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
            ok = test_bits(gate_table.value, wh.mix(key, KEYS) & U(gate_bits - 1))
            # copies of a text in one batch would give the same rows
            rows = np.unique(np.stack([wh.signed(key[ok]), node[ok], n[ok].astype(np.int64)], 1), axis=0) if ok.any() else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1])), pa.array(rows[:, 2].astype(np.int32))], names=["key", "node", "n"])

    return docs.select("text").mapInArrow(run, "key long" if counting else "key long, node long, n int")


class _Linked:
    """Which of the paired sets are linked."""

    def __init__(self, measure: Measure):
        self.measure = measure

    @staticmethod
    def unpack(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<u8")

    def _ok(self, n, m, o):
        return self.measure.den * o >= self.measure.num * (n + m - o)

    def __call__(self, left: list[bytes], right: list[bytes]) -> list[int]:
        keep = []
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            a, b = self.unpack(x), self.unpack(y)
            both = np.concatenate([a, b])
            both.sort()
            if self._ok(len(a), len(b), int((both[1:] == both[:-1]).sum())):
                keep.append(i)
        return keep

    def which(self, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the sets i are linked with the sets j."""
        out = np.zeros(len(i), bool)
        order = np.argsort(i, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
            a, some = sets[i[at[0]]], [sets[y] for y in j[at].tolist()]
            sizes = np.array([len(s) for s in some])
            tokens = np.concatenate(some)
            same = a[np.minimum(np.searchsorted(a, tokens), len(a) - 1)] == tokens
            out[at] = self._ok(len(a), sizes, np.add.reduceat(same, np.cumsum(sizes) - sizes, dtype=np.int64))
        return out


def _boundary(nodes: DataFrame, counts: DataFrame, measure: Measure) -> int:
    """The size from which scanning lists is cheaper than enumerating subsets."""
    seen = counts.agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
    scanned = (seen[0] or 0) / max(seen[1] or 1, 1)
    sizes = {r["n"]: r["c"] for r in nodes.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    best, cheapest = 1, None
    for x in range(1, MOST_LIGHT + 1):
        light = sum(c * measure.subsets(n, x) for n, c in sizes.items() if n < x)
        heavy = sum(c * float(measure.prefix(n)) * scanned for n, c in sizes.items() if n >= measure.least_size(x))
        if cheapest is None or light + heavy < cheapest:
            best, cheapest = x, light + heavy
    return best


def groups(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, boundary: int | None = None, gate_bits: int | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, leads of every row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach, itself included; a component without any doc_id has none.
    Letters A-Z are lower-cased; words are runs of anything but ASCII white space. Null, empty and blank texts have no
    shingles and are linked with nothing: their component is their own doc_id. Rows with the same words are one node,
    so copies cost one set; rows that repeat a doc_id, or have none, are told apart by their words. text_hash is Spark's
    xxhash64 of the text. One (doc_id, text) of each component leads: that of the smallest doc_id, null ids last, then of the
    smallest text_hash; texts without shingles all lead. doc_id may be of any ordered type. An empty table gives no
    rows; other columns are ignored.
    """
    spark, measure = docs.sparkSession, Measure(num, den)
    docs = docs.select("doc_id", "text")
    scratch = Scratch(spark, "jaccard")
    rows = scratch.keep(_nodes(docs, k), "nodes")
    links = _links(spark, scratch, docs, rows, k, measure, boundary, gate_bits)
    labels = components(scratch, links)

    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = rows.where("node is not null").groupBy("node").agg(F.min(name).alias("low"))
    named = first.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("lead"))
    by_node = named.select("node", "root").join(lowest, "root").select("node", "lead")
    out = rows.join(by_node, "node", "left")
    leads = F.col("node").isNull() | (name == F.col("lead")) | (F.col("doc_id").isNull() & F.col("lead.none") & (F.col("text_hash") == F.col("lead.text_hash")))
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("component_id"), F.coalesce(leads, F.lit(False)).alias("leads"))
    out = scratch.keep(out, "groups")
    scratch.close(out)
    return out


def join(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, boundary: int | None = None, gate_bits: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text), as groups() has them."""
    return groups(docs, k, num, den, boundary, gate_bits).select("doc_id", "n_shingles", "component_id")


def _links(spark, scratch: Scratch, docs: DataFrame, rows: DataFrame, k: int, measure: Measure, boundary: int | None, gate_bits: int | None) -> DataFrame:
    def counted(boundary: int, order) -> DataFrame:
        return _emit(docs, k, measure, boundary, order, None, True).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")

    plain = scratch.keep(counted(1, _NO_ORDER), "counts")
    if boundary is None:
        boundary = _boundary(rows, plain, measure)
    sizes = sorted(((r["c"], r["n"]) for r in plain.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for c, n in sizes:
        total += n
        if total > MOST_FREQUENT or c < LEAST_FREQUENT:
            break
        least = c
    frequent = plain.where(F.col("c") >= least).toArrow()
    order = (frequent["key"].to_numpy().view(U), frequent["c"].to_numpy())
    shared = counted(boundary, order)
    key_bits, node_bits = gate_bits or gate_size(plain.count()), gate_bits or gate_size(rows.count())
    gate = KeyGate(spark, shared, "key", KEYS, key_bits)
    lists = scratch.keep(_emit(docs, k, measure, boundary, order, gate, False).distinct(), "lists")
    scratch.drop(plain)
    scratch.settle()
    return resolve_lists(
        scratch,
        lists,
        close=lambda n, m: F.least(n, m) * measure.den >= F.greatest(n, m) * measure.num,
        fetch=lambda wanted: _sets(docs, k, KeyGate(spark, wanted, "node", NODES, node_bits)),
        linked=_Linked(measure),
        sketches=lambda wanted: _sketches(docs, k, KeyGate(spark, wanted, "node", NODES, node_bits)),
        most=lambda n, m: n + m - 2 * measure.overlap(n, m),
        rounds=PIVOT_ROUNDS,
        finer=lambda wanted: _wide_sketches(docs, k, KeyGate(spark, wanted, "node", NODES, node_bits)),
    )


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
with recursive words_ as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select distinct rid, md5(array_to_string(w[i + 1 : i + {WORDS}], ' ')) as g
  from words_, unnest(range(greatest(1, len(w) - {WORDS - 1}))) as u(i) where len(w) > 0),
sized as (select rid, count(*) as n from grams group by rid),
keyed as (
  select rid, n, g, row_number() over (partition by rid order by c, g) as p
  from grams join sized using (rid) join (select g, count(*) as c from grams group by g) using (g)),
heads as (select rid, n, g from keyed where p <= n - (({NUM} * n + {DEN - 1}) // {DEN}) + 1),
pairs as (select distinct a.rid as a, b.rid as b, a.n as na, b.n as nb from heads a join heads b on a.g = b.g and a.rid < b.rid
          where {DEN} * least(a.n, b.n) >= {NUM} * greatest(a.n, b.n)),
shared as (select a, b, na, nb, count(*) as o from pairs join grams x on x.rid = a join grams y on y.rid = b and x.g = y.g group by all),
links as (select a, b from shared where {DEN} * o >= {NUM} * (na + nb - o)),
sym as (select a, b from links union all select b, a from links),
reach(a, b) as (select distinct a, a from sym union select r.a, sym.b from reach r join sym on sym.a = r.b),
lowest as (select r.a as rid, min(d.doc_id) as low from reach r join words_ d on d.rid = r.b group by r.a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(low, doc_id) as component_id
from words_ left join sized using (rid) left join lowest using (rid)
"""
