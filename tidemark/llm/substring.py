"""Removal of long repeated spans by de Bruijn compaction.

An edge is a k-mer of WINDOW consecutive words of one document. Edges are bucketed by their minimizer, the leftmost
ANCHOR-word k-mer of least hash inside, and its arm: the minimizer with as many words before or after it as any edge
around it must have on one side at least (15 of 29). A few words repeat by chance, the more the larger the corpus; an arm
of 21 words hardly does. Consecutive edges of a document with one minimizer position and arm are a path, compacted into
one row (arm, hash of the path's words, source coordinates). Equal edges have equal minimizers at equal offsets and so
equal arms, and all that can repeat an edge meets under its arm:

1. paths whose arm occurs once hold no repeated edge;
2. a path that occurs at two coordinates is repeated whole: it has no branch, and none of its edges is looked at again;
3. where paths of an arm branch, the edges of those that occur once are held, edge by edge, against one source of each
   path of that arm;
4. a repeated path or edge whose every occurrence follows one other, which nothing else ever follows, is joined to it:
   neighbours in a source become one row, from branch to branch.

The rows that are left are glued by their source coordinates into maximal spans of words, and removed.
64-bit hashes choose minimizers, arms and what passes a gate. What counts as repeated is decided on the text itself, read
at its source coordinates: two paths or edges are equal if a 128-bit BLAKE2 digest of their words is.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import wordhash as wh
from .shared import Gate, Scratch, gate_size, test_bits, trimmed

WINDOW, ANCHOR = 35, 6
_POS = (1 << 26) - 1
U = np.uint64


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, by minima over blocks from both sides."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def paths(part: np.ndarray, offs: np.ndarray, window: int, anchor: int):
    """(doc, first edge, edges, arm, word starts, word ends, first words) of the paths of a run of texts.

    doc is the text within the run; the first edge is counted in words over the run, so an edge is words[i : i + window].
    """
    starts, ends, first = wh.words(part, offs, wh.SPACE_WORDS)
    h = wh.word_hashes(part, starts, ends, fold=False)
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, np.zeros(0, U), starts, ends, first
    kmers = wh.window_hashes(h, anchor, salt=0xA11)
    key = (kmers & ~U(_POS)) | (np.arange(len(kmers), dtype=U) & U(_POS))
    low = _sliding_min(key, window - anchor + 1)
    counts = np.maximum(0, np.diff(first) - window + 1)
    edges = wh.ranges(first[:-1], counts)
    if not len(edges):
        return none, none, none, np.zeros(0, U), starts, ends, first
    doc = np.repeat(np.arange(len(counts)), counts)
    # positions are taken modulo the mask; the minimizer lies within the edge
    at = edges + (((low[edges] & U(_POS)).astype(np.int64) - edges) & _POS)
    # an edge with `reach` words or more before its minimizer holds the arm to the left, any other one that to the right
    reach = -(-(window - anchor) // 2)
    left = at - edges >= reach
    new = np.ones(len(edges), bool)
    new[1:] = (at[1:] != at[:-1]) | (left[1:] != left[:-1]) | (doc[1:] != doc[:-1])
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(edges)))
    begin = edges[lead]
    with np.errstate(over="ignore"):
        arm = wh.mix(wh.window_hashes(h, anchor + reach, salt=0xA12)[at[lead] - reach * left[lead]] + left[lead].astype(U))
    return doc[lead], begin, n, arm, starts, ends, first


def digests(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """A digest of the words begin[i] to end[i] - 1, joined by one blank, for each i; a span lies within one text."""
    if not len(begin):
        return []
    depth = np.zeros(len(part) + 1, np.int8)
    depth[starts] += 1
    depth[ends] -= 1  # of two texts that meet, a word may start where one ends: two steps that cancel
    keep = np.cumsum(depth[:-1], dtype=np.int8) > 0
    after = ends[ends < len(part)]
    gap = after[~keep[after]]
    flat = part.copy()
    flat[gap] = 0x20
    keep[gap] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    raw = flat[keep].tobytes()
    return [blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(place[starts[begin]].tolist(), place[ends[end - 1]].tolist(), strict=True)]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a 64-bit key; rows that agree in id and text share it, and share their result."""
    return docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("key"))


def _run_mark(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return wh.mix(key.view(U) + at.astype(U) * U(0xD1342543DE82EF95), 0x4B)


def _arms(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [paths(part, offs, window, anchor)[3] for _, _, part, offs in wh.pieces(*wh.strings(b.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(wh.signed(np.concatenate(found)) if found else np.zeros(0, np.int64))], names=["arm"])

    return docs.select("text").mapInArrow(run, "arm long")


def _paths_of(docs: DataFrame, window: int, anchor: int, gate: Gate) -> DataFrame:
    bits, table = gate.bits, gate.table

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(1).to_numpy(zero_copy_only=False)
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            text: list[bytes] = []
            for at, _, part, offs in wh.pieces(*wh.strings(b.column(0))):
                doc, begin, n, arm, starts, ends, first = paths(part, offs, window, anchor)
                ok = test_bits(table.value, arm & U(bits - 1))
                k, i0 = key[at + doc[ok]], (begin - first[doc])[ok]
                text += digests(part, starts, ends, begin[ok], begin[ok] + n[ok] - 1 + window)
                for c, v in zip(cols, (wh.signed(arm[ok]), k, i0, n[ok], wh.signed(_run_mark(k.astype(np.int64), i0))), strict=True):
                    c.append(v)
            out = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(text, pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int32)), pa.array(out[4])], names=["arm", "text", "key", "at", "n", "mark"])

    return docs.select("text", "key").mapInArrow(run, "arm long, text binary, key long, at int, n int, mark long")


def _edges_of(docs: DataFrame, window: int, anchor: int, gate: Gate, marks: Gate) -> DataFrame:
    """Edges (text, key, at) of the marked paths. A path that passes both gates by chance only adds true edges."""
    arm_bits, arm_table, bits, table = gate.bits, gate.table, marks.bits, marks.table

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            cols: list[list[np.ndarray]] = [[], []]
            text: list[bytes] = []
            for at, _, part, offs in wh.pieces(*wh.strings(b.column(0))):
                doc, begin, n, arm, starts, ends, first = paths(part, offs, window, anchor)
                k, i0 = key[at + doc], begin - first[doc]
                ok = test_bits(arm_table.value, arm & U(arm_bits - 1)) & test_bits(table.value, _run_mark(k, i0) & U(bits - 1))
                edge = wh.ranges(begin[ok], n[ok])
                text += digests(part, starts, ends, edge, edge + window)
                cols[0].append(np.repeat(k[ok], n[ok]))
                cols[1].append(wh.ranges(i0[ok], n[ok]))
            out = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(out[0]), pa.array(out[1].astype(np.int32))], names=["text", "key", "at"])

    return docs.select("text", "key").mapInArrow(run, "text binary, key long, at int")


def compacted(nodes: DataFrame) -> DataFrame:
    """(key, at, n): rows of nodes(kind, node, key, at, n), with neighbours joined wherever neither has a branch.

    A node follows another one in a source if it starts where that ends. It is joined to it if all its occurrences follow
    that one and all occurrences of that one are followed by it; what is joined covers the same words.
    """
    within = Window.partitionBy("key", "kind").orderBy("at")
    before = F.when(F.lag("at").over(within) + F.lag("n").over(within) == F.col("at"), F.lag("node").over(within))
    links = nodes.withColumn("before", before).groupBy("kind", "node", "before").agg(F.count(F.lit(1)).alias("c"))
    ends = links.groupBy("kind", "node").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("ways"), F.max("before").alias("before"))
    # one way in, and as often as the node before occurs
    lone = ends.where("ways = 1 and before is not null").select("kind", "node", "before", "c")
    joined = lone.join(ends.select("kind", F.col("node").alias("before"), "c"), ["kind", "before", "c"]).select("kind", "node", F.lit(0).alias("begins"))
    rows = nodes.join(joined, ["kind", "node"], "left").withColumn("piece", F.sum(F.coalesce("begins", F.lit(1))).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "kind", "piece").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n")).select("key", "at", "n")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, gate_bits: int | None = None) -> DataFrame:
    """(key, spans): for each row key of _keyed(docs) the edge runs (first edge, edges) that occur elsewhere too.

    A kept table; what led to it is freed step by step.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring")
    twice = scratch.keep(_arms(docs, window, anchor).groupBy("arm").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("arm"), "arms")
    gate_bits = gate_bits or gate_size(twice.count())
    gate = Gate(spark, twice, gate_bits)
    scratch.drop(twice)
    scratch.settle()
    found = scratch.keep(_paths_of(docs, window, anchor, gate), "paths")
    variants = scratch.keep(found.groupBy("arm", "text").agg(F.count(F.lit(1)).alias("c"), F.min("mark").alias("source")), "variants")
    buckets = variants.groupBy("arm").agg(F.count(F.lit(1)).alias("paths"), F.min("c").alias("least")).where("paths > 1 and least = 1").select("arm")
    # one source of every path under a branching arm that has a path of one occurrence
    marks = Gate(spark, variants.join(buckets, "arm", "left_semi").select("source"), gate_bits)
    twofold = found.join(variants.where("c > 1").select("arm", "text"), ["arm", "text"], "left_semi")
    # a node's number only says which neighbours are joined, never what is equal
    whole = scratch.keep(twofold.select(F.lit(0).alias("kind"), F.xxhash64("text").alias("node"), "key", "at", "n"), "whole")
    scratch.drop(found, variants)
    scratch.settle()
    edges = scratch.keep(_edges_of(docs, window, anchor, gate, marks), "edges")
    again = edges.groupBy("text").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("text")
    single = scratch.keep(edges.join(again, "text", "left_semi").select(F.lit(1).alias("kind"), F.xxhash64("text").alias("node"), "key", "at", F.lit(1).alias("n")), "single")
    scratch.drop(edges)
    scratch.settle()
    spans = scratch.keep(compacted(whole.unionByName(single)).groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
    scratch.close(spans)
    scratch.settle()
    return spans


def strip(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, gate_bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row of docs(doc_id, text); kept is the kept words joined by one blank.

    Words are runs of anything but ASCII white space. A word goes if a window of `window` words over it starts anywhere
    else as well, in the same document too; windows are judged on the input. Null, empty and blank texts have no words
    and an empty `kept`. Rows that repeat, even with their id, repeat each other's windows. Texts of fewer words than
    the window are left whole. An empty table gives no rows, and other columns are ignored.
    """
    docs = _keyed(docs)
    spans = repeated_spans(docs, window, anchor, gate_bits)
    schema = StructType([docs.schema["doc_id"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            bounds = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
            first_edge, count = (lists.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("at", "n"))
            total, gone, kept = [], [], []
            for at, _, part, offs in wh.pieces(*wh.strings(b.column(1))):
                starts, ends, first = wh.words(part, offs, wh.SPACE_WORDS)
                raw = part.tobytes()
                s, e = starts.tolist(), ends.tolist()
                for d in range(len(offs) - 1):
                    x, z = first[d], first[d + 1]
                    lo, hi = bounds[at + d], bounds[at + d + 1]
                    keep = range(x, z)
                    if hi > lo and lists[at + d].is_valid:
                        depth = np.zeros(z - x + 1, np.int64)
                        np.add.at(depth, first_edge[lo:hi], 1)
                        np.add.at(depth, first_edge[lo:hi] + count[lo:hi] - 1 + window, -1)
                        keep = (np.flatnonzero(np.cumsum(depth)[:-1] == 0) + x).tolist()
                    total.append(z - x)
                    gone.append(z - x - len(keep))
                    kept.append(b" ".join([raw[s[i] : e[i]] for i in keep]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return strip(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
with words_ as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
spots as (
  select rid, i, md5(array_to_string(w[i + 1 : i + {WINDOW}], ' ')) as g
  from words_, unnest(range(len(w) - {WINDOW - 1})) as u(i) where len(w) >= {WINDOW}),
twice as (select g from spots group by g having count(*) > 1),
gone as (select distinct rid, i + j as p from spots join twice using (g), unnest(range({WINDOW})) as u(j)),
flat as (select rid, unnest(w) as word, unnest(range(len(w))) as p from words_),
kept as (
  select f.rid, string_agg(word, ' ' order by f.p) as t, count(*) as n
  from flat f left join gone g on f.rid = g.rid and f.p = g.p where g.p is null group by f.rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words_ left join kept using (rid)
"""
