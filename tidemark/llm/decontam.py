"""Benchmark decontamination by an FM-index of every shard of the corpus.

Benchmark items give windows of 13 words (an item with fewer words is one
window). A task gathers documents to a shard, indexes the shard's words and
searches all windows backwards through the ranks of a wavelet matrix. Rows that
are left are located by sampled suffix positions, and the occurrences of a
document are merged to removal spans.

Words that no window holds cannot be inside an occurrence; in the index a run of
them is one separator, which also ends a document.
"""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from .common import col, free_names, parts, slices, texts, words

WINDOW = 13
SHARD_WORDS = 1 << 20
BENCHMARK_BYTES = 32 << 20
SAMPLE = 16

FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text_key", T.StringType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


class Phrases:
    """The distinct windows of some items as rows of word numbers, by length."""

    def __init__(self, items, window=WINDOW):
        self.vocabulary, owners = {}, {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            width = min(window, len(ids))
            for i in range(len(ids) - width + 1 if ids else 0):
                owners.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.windows = {}
        for key, own in owners.items():
            self.windows.setdefault(len(key), ([], []))
            self.windows[len(key)][0].append(key)
            self.windows[len(key)][1].append(sorted(own))
        self.windows = {n: (np.array(k, dtype=np.int64), own) for n, (k, own) in self.windows.items()}
        self.shortest = min(self.windows, default=0)


def suffix_order(seq):
    """Suffix array of numbers in which every 0 is a separator that differs from all others.

    Prefix doubling; only suffixes that still share their rank are sorted again.
    """
    n = len(seq)
    gaps = seq == 0
    first = seq.astype(np.int64) + int(gaps.sum())
    first[gaps] = np.arange(int(gaps.sum()))
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    keys, slots, h = first[order], np.arange(n), 1
    while len(slots):
        head = np.concatenate(([True], keys[1:] != keys[:-1]))
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(keys)))
        rank[order[slots]] = np.repeat(slots[at], size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            break
        rows = order[slots]
        keys = rank[rows] * (n + 1) + rank[rows + h]
        by = np.argsort(keys, kind="stable")
        order[slots], keys = rows[by], keys[by]
        h *= 2
    return order


class FMIndex:
    """Counts and positions of phrases in a sequence of numbers, 0 being a separator."""

    def __init__(self, seq, sample=SAMPLE):
        order = suffix_order(seq)
        before = np.concatenate(([0], seq[:-1]))
        last = before[order]
        top = int(seq.max(initial=0))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top + 1))))
        # A walk back never crosses a separator, as the row after one is always sampled.
        marked = (order % sample == 0) | (last == 0)
        self.marked, self.places = marked, order[marked]
        self.mark_rank = np.concatenate(([0], np.cumsum(marked)))
        self.levels = []
        for bit in reversed(range(max(1, top.bit_length()))):
            ones = (last >> bit) & 1
            rank = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            self.levels.append((bit, rank, len(last) - int(rank[-1])))
            last = np.concatenate((last[ones == 0], last[ones == 1]))
        self.base = self._descend(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))
        self.top = top

    def _descend(self, symbol, at):
        for bit, rank, zeros in self.levels:
            ones = rank[at]
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def back(self, symbol, at):
        """Rows before ``at`` whose suffixes follow ``symbol``, as rows of the longer suffixes."""
        return self.first[symbol] + self._descend(symbol, at) - self.base[symbol]

    def search(self, phrases):
        """Numbers of the phrases that occur, with the bounds of their rows."""
        alive = np.flatnonzero((phrases <= self.top).all(axis=1))
        lo = np.zeros(len(alive), dtype=np.int64)
        hi = np.full(len(alive), self.first[-1])
        for step in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, step]
            lo, hi = self.back(symbol, lo), self.back(symbol, hi)
            kept = lo < hi
            alive, lo, hi = alive[kept], lo[kept], hi[kept]
        return alive, lo, hi

    def locate(self, rows):
        """Positions of rows: walk back to a sampled one and add the steps."""
        out = np.zeros(len(rows), dtype=np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            done = self.marked[at]
            out[open_[done]] = self.places[self.mark_rank[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            place, symbol = at, np.zeros(len(at), dtype=np.int64)
            for bit, rank, zeros in self.levels:
                ones = rank[place]
                one = rank[place + 1] > ones
                symbol += one.astype(np.int64) << bit
                place = np.where(one, zeros + ones, place - ones)
            at = self.first[symbol] + place - self.base[symbol]
            steps += 1
        return out


def _search_shard(phrases, ids, ends):
    """Occurrences in a shard: arrays of document, start, length and window."""
    known = ids > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
    cut = np.zeros(len(ids) + 1, dtype=bool)
    cut[ends] = True
    # Runs of known words, parted where a document ends.
    starts = np.unique(np.concatenate((edge[::2], np.flatnonzero(cut[:-1] & np.concatenate(([False], known[:-1])) & known))))
    stops = np.minimum(edge[1::2][np.searchsorted(edge[1::2], starts, side="right")],
                       ends[np.searchsorted(ends, starts, side="right")]) if len(starts) else starts
    long = stops - starts >= phrases.shortest
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 2 + ([],)
    size = stops - starts
    to = np.cumsum(size + 1)
    seq = np.zeros(int(to[-1]), dtype=np.int64)
    where = np.full(int(to[-1]), -1, dtype=np.int64)
    source = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    target = source + np.repeat(to - 1 - size - starts, size)
    seq[target], where[target] = ids[source], source
    index = FMIndex(seq)
    at, lengths, owners = [], [], []
    for width, (keys, own) in phrases.windows.items():
        found, lo, hi = index.search(keys)
        n = hi - lo
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at.append(where[index.locate(rows)])
        lengths.append(np.full(len(rows), width))
        owners += [own[k] for k, times in zip(found, n) for _ in range(times)]
    return np.concatenate(at), np.concatenate(lengths), owners


def _findings(phrases, rows):
    """Result rows of the documents of one shard; ``rows`` are (id, key, word numbers)."""
    size = np.array([len(r[2]) for r in rows], dtype=np.int64)
    ends = np.cumsum(size)
    ids = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, dtype=np.int64)
    at, length, owners = _search_shard(phrases, ids, ends) if phrases.shortest else (ids[:0], ids[:0], [])
    items, spans, hits = [[] for _ in rows], [[] for _ in rows], np.zeros(len(rows), dtype=np.int64)
    if len(at):
        doc = np.searchsorted(ends, at, side="right")
        for d, own in zip(doc, owners):
            items[d].append(own)
        change = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        hit = np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False]))
        # A hit document next to another is parted at the end of the first.
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        for start, stop in zip(edge[::2], edge[1::2]):
            while start < stop:
                d = int(np.searchsorted(ends, start, side="right"))
                base, upto = ends[d] - size[d], min(stop, ends[d])
                spans[d].append({"start": int(start - base), "end": int(upto - base)})
                hits[d] += upto - start
                start = upto
    return pa.RecordBatch.from_pydict({
        "doc_id": [r[0] for r in rows], "text_key": [r[1] for r in rows], "n_words": size, "n_hit": hits,
        "items": [sorted({i for own in x for i in own}) for x in items], "spans": spans,
    }, schema=_ARROW)


def _scan_block(docs, phrases, shard_words):
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def scan(batches):
        p = sent.value
        get, none = p.vocabulary.get, itertools.repeat(0)
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch):
                for doc, key, text in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
                    w = words(text)
                    held.append((doc, key, np.fromiter(map(get, w, none), np.int64, len(w))))
                    size += len(w)
                    if size >= shard_words:
                        yield _findings(p, held)
                        held, size = [], 0
        if held:
            yield _findings(p, held)

    return docs.mapInArrow(scan, FOUND)


def scan(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
         window=WINDOW, shard_words=SHARD_WORDS, benchmark_bytes=BENCHMARK_BYTES, keyed=False):
    """Words, hit words, items and merged removal spans of every document.

    A row per input row. Null or empty texts have no words and no hits; an item
    of no words has no window; a null item id is written ``null``; repeated rows
    are judged one by one. Spans count words and end before ``end``.

    The benchmark is sent out in blocks of about ``benchmark_bytes``; a larger one
    is searched block after block, and the spans of the blocks are merged.
    """
    items = benchmark.select(
        F.coalesce(col(item_col).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(col(item_text_col).cast("string"), F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts(total, benchmark_bytes)
    rows = texts(docs, id_col, text_col)
    # The key parts rows of one id that hold different texts, where blocks are merged.
    rows = rows.select("doc_id", F.sha2("text", 256).alias("text_key") if keyed or n > 1 else F.lit(None).cast("string").alias("text_key"), "text")
    blocks = []
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()
        blocks.append(_scan_block(rows, Phrases([(r[0], r[1]) for r in part], window), shard_words))
    if n == 1:
        return blocks[0] if keyed else blocks[0].drop("text_key")
    every = blocks[0]
    for other in blocks[1:]:
        every = every.unionByName(other)
    merged = _merge(F.array_sort(F.flatten(F.collect_list("spans"))))
    # Equal rows give equal findings; each block counts them alike.
    out = (
        every.groupBy("doc_id", "text_key")
        .agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            merged.alias("spans"), (F.count("*") / n).cast("int").alias("_times"),
        )
        .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
        .withColumn("_", F.explode(F.sequence(F.lit(1), "_times")))
        .select("doc_id", "text_key", "n_words", "n_hit", "items", "spans")
    )
    return out if keyed else out.drop("text_key")


def _merge(spans):
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))),
        )
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), add)


def contaminated():
    """The rule: at least a twentieth of the words lie in occurrences."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(found):
    """The findings with a digest of the items and the decision."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"), "spans",
    )


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_spans(text, spans):
    """A text without the stretch from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for s in spans:
        out.append(text[done : at[s["start"]][0]])
        done = at[s["end"] - 1][1]
    return "".join(out) + text[done:]


def _cut():
    return F.udf(lambda text, spans: cut_spans(text, spans) if spans else text, "string", useArrow=True)


def clean(docs, benchmark, id_col="doc_id", text_col="text", **options):
    """Drop contaminated documents and cut the removal spans out of all others.

    All columns stay as they are, but for a text where something was cut.
    """
    hits = scan(docs, benchmark, id_col, text_col, keyed=True, **options).where("n_hit > 0")
    own, item, item_key, spans, bad = free_names(docs, "own_key", "hit_id", "hit_key", "hit_spans", "hit_bad")
    hits = hits.dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias(item), F.col("text_key").alias(item_key), F.col("spans").alias(spans), contaminated().alias(bad),
    )
    key = F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")), 256)
    joined = docs.withColumn(own, key).join(
        hits, F.col(item).eqNullSafe(col(id_col).cast("long")) & (F.col(item_key) == F.col(own)), "left"
    ).where(~F.coalesce(bad, F.lit(False)))
    return joined.withColumn(text_col, _cut()(col(text_col), spans)).select(*map(col, docs.columns))
