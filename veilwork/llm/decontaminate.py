"""Benchmark decontamination with an FM-index for each shard of training documents.

A shard is one Arrow batch of documents. Its words become numbers: those of the benchmark's words, and 0
for any other, which no window holds. Stretches of numbered words shorter than the shortest window cannot
hold one and are left out. Over the rest the task builds an FM-index: suffix order, Burrows-Wheeler
transform, a wavelet matrix for ranks and suffix positions sampled by text position. All test windows
are searched backwards at once, occurrences are located through the samples, and their word spans merged.

Documents are never shuffled for a benchmark of up to PASS_BLOCKS blocks of bounded size. A larger one is searched in passes of as many
blocks, and the few rows that later passes hit are joined with those of the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.shared import broadcast_parameter, free_name, once_per_worker, staged, tidy

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Bytes of benchmark text that one broadcast holds; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20
#: Blocks that a task holds at once; more are searched in further passes over the table.
PASS_BLOCKS = 2
#: What stands between words, case aside.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every so many-th text position has its suffix position stored.
SAMPLE = 8
#: Numbered words in one index; a batch with more is indexed in several parts, cut between documents.
INDEX_WORDS = 4_000_000

#: Lower-cases A-Z and makes every other ASCII character but a-z and 0-9 a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

RESULT = "struct<n_words:long,spans:array<struct<start:int,end:int>>,items:array<string>>"


def words(text: bytes) -> list[bytes]:
    """The words of a text: runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z."""
    return text.translate(FOLD).split()


class Windows:
    """The test windows of one benchmark block, as word numbers from 1 on."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.numbers: dict[bytes, int] = {}
        self.items: list[str] = []
        of: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            if not ids:
                continue
            self.items.append(item)
            for i in range(max(1, len(ids) - size + 1)):
                of.setdefault(tuple(ids[i : i + size]), set()).add(len(self.items) - 1)
        self.shortest = min(map(len, of), default=0)
        self.by_length = [(n, np.array(p, np.int64), [sorted(of[x]) for x in p]) for n in sorted({len(x) for x in of}) if (p := [x for x in of if len(x) == n])]


class WaveletMatrix:
    """Ranks of symbols below 2 ** levels in a sequence."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        for shift in range(levels - 1, -1, -1):
            bits = symbols >> shift & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.levels.append((shift, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        first, last = np.zeros_like(ends), ends
        for shift, ones, zeros in self.levels:
            bit = symbols >> shift & 1
            a, b = ones[first], ones[last]
            first, last = np.where(bit, zeros + a, first - a), np.where(bit, zeros + b, last - b)
        return last - first


class FMIndex:
    """An index of word numbers; 0 separates stretches, and no search goes over it."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = self.suffixes(text)
        self.symbols = text[order - 1]  # Burrows-Wheeler transform; the text ends with a separator
        top = int(text.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))]).astype(np.int64)
        self.matrix = WaveletMatrix(self.symbols, max(1, (top - 1).bit_length()))
        # A walk back stops at a sampled position or at the beginning of a stretch.
        sampled = (order % SAMPLE == 0) | (self.symbols == 0)
        self.is_sampled, self.sample_at, self.samples = sampled, np.cumsum(sampled) - 1, order[sampled]
        self.n = n

    @staticmethod
    def suffixes(text: np.ndarray) -> np.ndarray:
        """Positions in suffix order, by doubling. Each separator counts as a symbol of its own, by place, so
        comparisons end with the stretch; places already alone in rank are sorted no more."""
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        order = np.argsort(rank, kind="stable")
        step = 1
        while True:
            keys = rank[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[order] = group
            tied = ~(new & np.concatenate([new[1:], [True]]))
            if not tied.any():
                return order
            at = np.flatnonzero(tied)
            rows = order[at]
            second = rank[np.minimum(rows + step, n - 1)]
            by = np.lexsort((second, group[at]))
            order[at] = rows[by]
            # Ranks of tied groups split where the second key changes.
            g, s = group[at][by], second[by]
            split = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
            rank[order[at]] = np.maximum.accumulate(np.where(split, at, 0))
            step *= 2

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns: the row range [first, last) of each."""
        first, last = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        going = np.arange(len(patterns))
        top = len(self.before) - 2
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[going, j]
            known = c <= top
            last[going[~known]] = first[going[~known]]
            going, c = going[known], c[known]
            first[going] = self.before[c] + self.matrix.rank(c, first[going])
            last[going] = self.before[c] + self.matrix.rank(c, last[going])
            going = going[first[going] < last[going]]
        last = np.maximum(first, last)
        found = np.zeros(len(patterns), bool)
        found[going] = True
        return np.where(found, first, 0), np.where(found, last, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, steps, going = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(going := going[~self.is_sampled[rows[going]]]):
            c = self.symbols[rows[going]]
            rows[going] = self.before[c] + self.matrix.rank(c, rows[going])
            steps[going] += 1
        return self.samples[self.sample_at[rows]] + steps


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of ranges, and which range each is of."""
    size = last - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def shard_hits(docs: list[np.ndarray], windows: Windows) -> tuple[list[np.ndarray], list[set[int]]]:
    """For each document of a shard: merged (start, end) word spans of windows, and the items they are of."""
    spans, items = [np.zeros((0, 2), np.int64)] * len(docs), [set() for _ in docs]
    if not docs or not windows.shortest:
        return spans, items
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
    flat = np.zeros(starts[-1] + 1, np.int64)
    for d, s in zip(docs, starts, strict=False):
        flat[s + 1 : s + 1 + len(d)] = d
    known = np.diff(np.concatenate([[0], (flat > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(known == 1), np.flatnonzero(known == -1)
    long = end - begin >= windows.shortest
    place, _ = _expand(begin[long], end[long] + 1)  # with the separator behind each stretch
    if not len(place):
        return spans, items
    index = FMIndex(flat[place])
    cover = np.zeros(len(flat) + 1, np.int32)
    pairs = []
    for length, patterns, owners in windows.by_length:
        rows, which = _expand(*index.search(patterns))
        if not len(rows):
            continue
        at = place[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        doc = np.searchsorted(starts, at, "right") - 1
        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            pairs.append((d, owners[w]))
    for d, own in pairs:
        items[d].update(own)
    hit = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]]))
    first, last = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    doc = np.searchsorted(starts, first, "right") - 1
    for d in np.unique(doc).tolist():
        own = doc == d
        spans[d] = np.stack([first[own], last[own]], 1) - starts[d] - 1
    return spans, items


def _arrow(n_words: list[int], spans: list[np.ndarray], items: list[list[str]]) -> pa.StructArray:
    ends = np.cumsum([0, *map(len, spans)]).astype(np.int32)
    both = np.concatenate([np.zeros((0, 2), np.int64), *spans]).astype(np.int32)
    pair = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["start", "end"])
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pair), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])


def _search(windows: Windows, batch: pa.Array) -> pa.StructArray:
    n_words, spans, items = [], [], []
    part, size = [], 0

    def flush() -> None:
        nonlocal part, size
        s, i = shard_hits(part, windows)
        spans.extend(s)
        items.extend([windows.items[x] for x in own] for own in i)
        part, size = [], 0

    get = windows.numbers.get
    for v in batch:
        w = words(v.as_py() or b"")
        n_words.append(len(w))
        ids = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
        part.append(ids)
        size += len(ids)
        if size >= INDEX_WORDS:
            flush()
    flush()
    return _arrow(n_words, spans, [sorted(set(x)) for x in items])


def _pieces(items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """Items whose text is larger than a block as pieces that overlap by all but one word of a window: each window is
    in a piece. Pieces are small beside a block unless words have hundreds of bytes on average."""
    step = max(1, block_bytes // 512)
    cut = items.where(F.octet_length("text") > block_bytes).withColumn("words", F.filter(F.split("text", BETWEEN), lambda w: w != ""))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1), F.lit(step))
    cut = cut.select("item", "words", F.explode(starts).alias("start")).select("item", F.array_join(F.slice("words", F.col("start"), F.lit(step + window - 1)), " ").alias("text"))
    return items.where(F.octet_length("text") <= block_bytes).unionByName(cut)


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[tuple[list[tuple[str, bytes]], int]]:
    """The items in blocks of about block_bytes, each collected on its own; rows of one id may be in several."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("string").alias("text"))
    total, largest = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if (largest or 0) > block_bytes:
        items = _pieces(items, window, block_bytes)
        total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n = -(-(total or 0) // block_bytes) or 1
    for b in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        rows = [(r.item, bytes(r.text)) for r in block.select("item", F.col("text").cast("binary")).collect()]
        yield rows, sum(len(t) for _, t in rows)


def _searcher(shared: Broadcast, window: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    key = uuid.uuid4().hex

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = once_per_worker(("windows", key), lambda: Windows(shared.value, window))
        for batch in batches:
            yield _search(windows, batch)

    return search


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add n_words, spans and items: the merged word spans [start, end) in which windows of benchmark items occur,
    and the ids of those items, distinct, as strings in string order.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A window is any `window`
    consecutive words of an item; an item with fewer words, but some, is one window. Null or empty texts
    have no words; items without words have no windows; a null item id counts as the empty string, and
    items that share an id are one item. Rows are kept as they are; columns that already have one of the
    three names are replaced. Empty tables, of documents or items, give no hits. Texts are searched whole.

    A task holds PASS_BLOCKS blocks of items at most. A larger benchmark is searched in several passes over the table, which is
    written once with the hits of the first; later passes give the rows that they hit, and only those rows' hits are put together.
    """
    spark, names = df.sparkSession, ("n_words", "spans", "items")

    def searched(rows: DataFrame, blocks: list[tuple[list[tuple[str, bytes]], int]]) -> tuple[DataFrame, list[Broadcast]]:
        """Rows with what some blocks hit in them, and the broadcasts that this takes."""
        shared = [broadcast_parameter(spark, items, n_bytes) for items, n_bytes in blocks]
        found = [F.arrow_udf(tidy(_searcher(b, window)), RESULT)(F.col(f"`{text}`").cast("binary")) for b in shared]
        hits = f"hits_{uuid.uuid4().hex}"
        out = rows.withColumn(hits, found[0] if len(found) == 1 else F.arrow_udf(_merged, RESULT)(*found))
        return out.withColumns({x: F.col(f"{hits}.{x}") for x in names}).drop(hits), shared

    blocks = _blocks(benchmark, item_id, item_text, window, block_bytes)
    first, more = list(islice(blocks, PASS_BLOCKS)), list(islice(blocks, PASS_BLOCKS))
    out, shared = searched(df, first)
    if not more:
        return out
    row, late = free_name(out, "row"), None
    out = staged(out.withColumn(row, F.monotonically_increasing_id()), "searched")
    while more:
        for b in shared:
            b.destroy()
        hit, shared = searched(out.select(row, F.col(f"`{text}`")), more)
        hit = staged(hit.where(F.size("items") > 0).select(row, *names), "hits")
        late = hit if late is None else late.unionByName(hit)
        more = list(islice(blocks, PASS_BLOCKS))
    for b in shared:
        b.destroy()
    own = [f"late_{uuid.uuid4().hex}" for _ in range(2)]
    late = late.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias(own[0]), F.flatten(F.collect_list("items")).alias(own[1]))
    joined = out.join(late, row, "left").withColumns({
        "spans": F.when(F.col(own[0]).isNull(), F.col("spans")).otherwise(_united(F.concat("spans", own[0]))),
        "items": F.when(F.col(own[1]).isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", own[1])))),
    })
    return joined.drop(row, *own)


def _united(spans: Column) -> Column:
    """Spans in order, those that meet or overlap as one."""
    last = lambda done: F.try_element_at(done, F.lit(-1))

    def add(done: Column, s: Column) -> Column:
        longer = F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= last(done)["end"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def _merged(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for arrays in batches:
        out_words, out_spans, out_items = [], [], []
        for parts in zip(*(a.to_pylist() for a in arrays), strict=True):
            out_words.append(parts[0]["n_words"])
            merged: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for p in parts for x in p["spans"]):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            out_spans.append(np.array(merged, np.int64).reshape(-1, 2))
            out_items.append(sorted({i for p in parts for i in p["items"]}))
        yield _arrow(out_words, out_spans, out_items)


def words_hit(spans: Column) -> Column:
    """The number of words inside merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of df in which no benchmark window occurs, with the columns that df has. See find_contamination."""
    found = find_contamination(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{options.pop('text', 'text')}`").alias("text")), benchmark, text="text", **options)
    return found.where(F.size("items") == 0).select("row.*")
