"""Benchmark decontamination as a prefix-filtered set join with exact verification.

An item is cut into windows of WINDOW words (an item of fewer words is one window). A window occurs in a document only
if all its word shingles do, so one shingle is a sufficient prefix: the rarest, by occurrences in the documents. The
documents are probed for those prefix shingles alone. A probe that hits at shingle offset k of a window of L words fixes
where the window would lie; it is dropped unless that span lies within the document (positional bound k, length
bound L), and what remains is compared word for word.

Items are a query set: they are worked through in blocks of at most BLOCK windows, each broadcast, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import wordhash as wh
from .shared import Scratch, trimmed

WINDOW, SHINGLE = 10, 5
#: Most windows of one broadcast (about 30 MB).
BLOCK = 200_000
U = np.uint64


def _hashed(buf, offsets):
    starts, ends, first = wh.words(buf, offsets, wh.ALNUM_WORDS)
    return starts, ends, first, wh.word_hashes(buf, starts, ends, fold=True)


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(content, length, item): distinct windows of every item; the shingles of a window follow from its content."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            buf, offsets = wh.strings(b.column(1))
            content, length, item = [], [], []
            for at, _, part, offs in wh.pieces(buf, offsets):
                starts, ends, first, _ = _hashed(part, offs)
                low = wh.FOLD[part].tobytes()
                for d in range(len(offs) - 1):
                    ws = [low[s:e] for s, e in zip(starts[first[d] : first[d + 1]].tolist(), ends[first[d] : first[d + 1]].tolist(), strict=True)]
                    for i in range(max(1, len(ws) - window + 1) if ws else 0):
                        content.append(b" ".join(ws[i : i + window]).decode("utf-8", "replace"))
                        length.append(min(len(ws), window))
                        item.append(ids[at + d].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.string()), pa.array(length, pa.int32()), pa.array(item, pa.string())], names=["content", "length", "item"])

    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text")).mapInArrow(run, "content string, length int, item string")
    return cut.groupBy("content", "length").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Block:
    """The windows of one block, their prefix shingles, and what is needed to verify a hit."""

    def __init__(self, contents: list[str], items: list[list[str]], shingle: int):
        self.contents, self.items, self.shingle = [c.encode() for c in contents], items, shingle
        buf, offsets = wh.strings(pa.array(contents, pa.string()))
        self.length = np.zeros(len(contents), np.int64)
        self.hash = np.zeros(len(contents), U)
        every, owner, place, size = [], [], [], []
        for at, to, part, offs in wh.pieces(buf, offsets):
            _, _, first, h = _hashed(part, offs)
            n = np.diff(first)
            self.length[at:to] = n
            self.hash[at:to] = wh.span_hashes(h, first[:-1], first[1:])
            for s in np.unique(np.minimum(n, shingle)).tolist():
                rows = np.flatnonzero(np.minimum(n, shingle) == s)
                counts = n[rows] - s + 1
                pos = wh.ranges(first[:-1][rows], counts)
                every.append(wh.window_hashes(h, s)[pos])
                owner.append(np.repeat(rows + at, counts))
                place.append(wh.ranges(np.zeros(len(rows), np.int64), counts))
                size.append(np.full(len(pos), s))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.every, self.owner, self.place, self.size = cat(every, U), cat(owner, np.int64), cat(place, np.int64), cat(size, np.int64)

    def probes(self, rank: dict[int, np.ndarray]) -> dict[int, tuple]:
        """For each shingle size: sorted prefix shingles, and for each the windows that have it as their prefix."""
        order = np.lexsort((self.place, self.every, rank, self.owner))
        lead = order[np.unique(self.owner[order], return_index=True)[1]]
        out = {}
        for s in np.unique(self.size[lead]).tolist():
            mine = lead[self.size[lead] == s]
            mine = mine[np.argsort(self.every[mine], kind="stable")]
            keys, at, n = np.unique(self.every[mine], return_index=True, return_counts=True)
            out[s] = (keys, at, n, self.owner[mine], self.place[mine], _flags(keys))
        return out


def _flags(keys: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << 22, bool)
    flags[(keys >> U(42)).astype(np.int64)] = True
    return flags


def _find(h: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of h that are in keys, and where in keys."""
    maybe = np.flatnonzero(flags[(h >> U(42)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    good = keys[at] == h[maybe]
    return maybe[good], at[good]


def _rarity(docs: DataFrame, block: _Block) -> np.ndarray:
    """Occurrences in the documents of each shingle of the block."""
    spark = docs.sparkSession
    sizes = {s: np.unique(block.every[block.size == s]) for s in np.unique(block.size).tolist()}
    shared = spark.sparkContext.broadcast(sizes)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {s: np.zeros(len(k), np.int64) for s, k in shared.value.items()}
        flags = {s: _flags(k) for s, k in shared.value.items()}
        for b in batches:
            for _, _, part, offs in wh.pieces(*wh.strings(b.column(0))):
                _, _, _, h = _hashed(part, offs)
                for s, keys in shared.value.items():
                    counts[s] += np.bincount(_find(wh.window_hashes(h, s), keys, flags[s])[1], minlength=len(keys))
        for s, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(some), pa.array(n[some])], names=["s", "at", "n"])

    rank = np.zeros(len(block.every), np.int64)
    found = docs.select("text").mapInArrow(run, "s int, at long, n long").groupBy("s", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    for s, keys in sizes.items():
        n, part = np.zeros(len(keys), np.int64), found[found["s"] == s]
        n[part["at"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
        mine = block.size == s
        rank[mine] = n[np.searchsorted(keys, block.every[mine])]
    return rank


def _spans_type() -> ArrayType:
    return ArrayType(StructType([StructField("first", IntegerType()), StructField("end", IntegerType())]))


def _results(id_field: StructField) -> StructType:
    return StructType([id_field, StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", _spans_type())])


def _probe(docs: DataFrame, block: _Block, keep: list[str], counted: DataFrame | None = None) -> DataFrame:
    """keep columns, n_words, n_hit, items and spans of every row of docs under one block of windows; rarity is that in `counted`, docs and more."""
    rank = _rarity(docs if counted is None else counted, block)
    at = keep.index("text") if "text" in keep else len(keep)
    alive = np.zeros(len(block.contents), bool)
    probes = block.probes(rank) if len(block.every) else {}
    # a window whose rarest shingle never occurs cannot occur
    least = np.full(len(block.contents), np.iinfo(np.int64).max)
    np.minimum.at(least, block.owner, rank)
    alive[:] = least > 0
    shared = docs.sparkSession.sparkContext.broadcast((probes, block.length, block.hash, block.contents, block.items, alive))
    schema = StructType([*[docs.schema[c] for c in keep], *_results(docs.schema[keep[0]]).fields[1:]])

    def hits(part, offs, data):
        probes, length, hashes, contents, _, alive = data
        starts, ends, first, h = _hashed(part, offs)
        begin, window = [], []
        for s, (keys, at, n, owner, place, flags) in probes.items():
            pos, key = _find(wh.window_hashes(h, s), keys, flags)
            many = n[key]
            entry = wh.ranges(at[key], many)
            w, start = owner[entry], np.repeat(pos, many) - place[entry]
            doc = np.searchsorted(first, np.repeat(pos, many), "right") - 1
            ok = alive[w] & (start >= first[doc]) & (start + length[w] <= first[doc + 1])
            w, start = w[ok], start[ok]
            ok = wh.span_hashes(h, start, start + length[w]) == hashes[w]
            begin.append(start[ok])
            window.append(w[ok])
        begin, window = np.concatenate(begin or [np.zeros(0, np.int64)]), np.concatenate(window or [np.zeros(0, np.int64)])
        if len(begin):
            low = wh.FOLD[part].tobytes()
            s, e = starts.tolist(), ends.tolist()
            same = [b" ".join([low[x:y] for x, y in zip(s[i : i + k], e[i : i + k], strict=True)]) == contents[w] for i, k, w in zip(begin.tolist(), length[window].tolist(), window.tolist(), strict=True)]
            begin, window = begin[same], window[same]
        return first, begin, window

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        length, items = data[1], data[4]
        for b in batches:
            n_words, n_hit, found, spans = [], [], [], []
            for _, _, part, offs in wh.pieces(*wh.strings(b.column(at))):
                first, begin, window = hits(part, offs, data)
                depth = np.zeros(int(first[-1]) + 1, np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + length[window], -1)
                hit = np.cumsum(depth)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words.append(np.diff(first))
                n_hit.append(total[first[1:]] - total[first[:-1]])
                mine: dict[int, tuple[set, list]] = {}
                doc = np.searchsorted(first, begin, "right") - 1
                for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
                    mine.setdefault(d, (set(), []))[0].update(items[w])
                for d, (_, out) in mine.items():
                    own = np.concatenate([[False], hit[first[d] : first[d + 1]], [False]])
                    edge = np.flatnonzero(own[1:] != own[:-1])
                    out += [{"first": a, "end": z} for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                empty = (set(), [])
                for d in range(len(first) - 1):
                    a, z = mine.get(d, empty)
                    found.append(sorted(a))
                    spans.append(z)
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(keep))], cat(n_words), cat(n_hit), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))],
                names=[*keep, "n_words", "n_hit", "items", "spans"],
            )

    return docs.select(*keep, *["text"][at < len(keep) :]).mapInArrow(run, schema)


def _blocks(docs: DataFrame, items: DataFrame, window: int, shingle: int, block: int) -> tuple[int, Callable[[int], _Block]]:
    windows = Scratch(docs.sparkSession, "decontaminate").keep(_windows(items, window, shingle), "windows")
    blocks = max(1, -(-windows.count() // block))
    part = F.pmod(F.xxhash64("content"), F.lit(blocks))

    def load(k: int) -> _Block:
        t = windows.where(part == k).toArrow().to_pandas()
        return _Block(t["content"].tolist(), [list(x) for x in t["items"]], shingle)

    return blocks, load


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item: those of which contamination() has no hit.

    A row is judged by its own text, whatever ids are null or repeated. Items of fewer words than a window are windows
    too, so one word of a one-word item is enough. Docs need a column text; the other columns may have any names.
    """
    blocks, load = _blocks(docs, items, window, shingle, block)
    names = [f"c{i}" for i in range(len(docs.columns))]
    names[docs.columns.index("text")] = "text"
    rest = all_rows = docs.toDF(*names)
    for k in range(blocks):
        rest = _probe(rest, load(k), names, all_rows).where("n_hit = 0").select(*names)
    return rest.toDF(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), spans (word ranges) of every row of docs(doc_id, text).

    items(item_id, text) may be of any size. Null or empty texts have no words and no hits; null or empty items have
    no windows; repeated rows and items each count; words of one document never join those of another. Columns other
    than these are ignored. Without windows, or without documents, the result is that of no hits.
    """
    docs = docs.select("doc_id", "text")
    blocks, load = _blocks(docs, items, window, shingle, block)
    if blocks == 1:
        return _probe(docs, load(0), ["doc_id"])
    keyed = docs.withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    base = _probe(keyed, load(0), ["doc_id", "_h"])
    more = None
    for k in range(1, blocks):
        found = _probe(keyed, load(k), ["doc_id", "_h"]).where("n_hit > 0").select("doc_id", "_h", "items", "spans")
        more = found if more is None else more.unionByName(found)
    more = more.groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("_spans"))
    both = base.join(more, base["doc_id"].eqNullSafe(more["_d"]) & (base["_h"] == more["_g"]), "left")
    empty = F.array().cast(_spans_type())
    spans = F.array_sort(F.concat("spans", F.coalesce("_spans", empty)))
    # words under at least one span: each span adds what lies beyond the furthest end before it
    state = F.aggregate("_all", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["first"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")))
    return both.withColumn("_all", spans).select("doc_id", "n_words", state["n"].cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>"))))).alias("items"), F.col("_all").alias("spans"))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The digest of contamination(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, items, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with iw as (select item_id, {_WORDS} as w from benchmark),
wins as (
  select distinct item_id, least(len(w), {WINDOW}) as l, array_to_string(w[i + 1 : i + {WINDOW}], ' ') as c
  from iw, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) as u(i) where len(w) > 0),
dw as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
sizes as (select distinct l from wins),
spots as (
  select rid, l, i, array_to_string(w[i + 1 : i + l], ' ') as c
  from dw, sizes, unnest(range(len(w) - l + 1)) as u(i) where len(w) >= l),
hits as (select distinct rid, i, wins.l, item_id from spots join wins on spots.c = wins.c and spots.l = wins.l),
covered as (select rid, count(distinct i + j) as n_hit from hits, unnest(range(l)) as u(j) group by rid),
named as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct rid, cast(item_id as varchar) as item from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (rid) left join named using (rid)
"""
