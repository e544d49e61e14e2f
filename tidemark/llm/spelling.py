"""Spelling variants by dynamic programming over sorted word lists.

Two words one edit apart agree before the edit and after it. Positions of the edit are
split in windows [a, b); a word's key for a window is what stands before it and after it,
its middle what stands inside. Words of one key form a list of middles in sorted order,
and every near pair meets in exactly one list, that of the window its first difference
lies in. Two windows, the halves of a word, serve until a list gets longer than
``LIST``; the words of such a list are keyed anew by the halves of its window, so a very
common prefix or suffix never ends in one task.

A list is scanned as its middles' shared prefixes stand in it: the row of the edit matrix
for a prefix (three cells, as one edit is allowed) is computed once for the whole range of
middles that share it, from the row of the prefix one shorter, and a range whose row
exceeds one edit is left at once with all it holds. All words of the list, and of further
lists, take each step together as arrays.

Defined cases: null and empty texts hold no words; a null id reads as an empty one in the
hashed string; repeated documents count as often as they stand; equal counts go to the
word that is smaller in code-point order; an empty table gives no rows. Other columns are
not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from .common import col, store

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
ONE_IN = 31
# Characters of the middles of one list, and cells of lists that take a step together.
LIST, STEP_CELLS = 100_000, 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()),
    T.StructField("near_n", T.LongType()), T.StructField("near", T.StringType()),
])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def vocabulary(docs, id_col="doc_id", text_col="text", least_length=LEAST_LENGTH, least_count=LEAST_COUNT):
    """``word`` and its occurrences ``n``: lower-cased runs of letters, one in 31 with a code point left out."""
    runs = docs.select(
        F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"),
        # Leaving a letter out makes no run longer, so shorter runs are no words either way.
        F.explode(F.regexp_extract_all(col(text_col).cast("string"), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"),
    )
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = low.withColumn("h", h).withColumn("at", at).select(
        F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word")
    )
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _keyed(words):
    """A row of a word in a window [a, b): ``size`` is the length of the shorter of two near words."""
    return words.withColumn("extra", F.length("word") - F.col("size")).select(
        "word", "n", "size", "a", "b", F.expr("substring(word, a + 1, b - a + extra)").alias("middle"),
        F.xxhash64("size", "a", "b", F.expr("substring(word, 1, a)"), F.expr("substring(word, b + extra + 1)")).alias("key"),
    )


def lists(vocab, longest=LIST, least_length=LEAST_LENGTH):
    """Every word once in each list that may hold a near word of it. The middles of a list have at most
    ``longest`` characters, or the list's window is a single position, so that they are the letters there are."""
    n = F.length("word")
    half = F.floor(F.col("size") / 2).cast("int")
    windows = vocab.withColumn(
        "size", F.explode(F.when(n > least_length, F.array(n - 1, n)).otherwise(F.array(n)))
    ).withColumn("w", F.explode(F.array(
        F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("size") + 1).alias("b"))
    )))
    open_rows = store(_keyed(windows.select("word", "n", "size", "w.a", "w.b")), "spelling-lists")
    done = None
    while True:
        long = store(
            open_rows.groupBy("key").agg(F.sum(F.length("middle")).alias("chars"), F.max(F.expr("b - a")).alias("width"))
            .where((F.col("chars") > longest) & (F.col("width") > 1)).select("key"), "spelling-long",
        )
        fits = open_rows.join(long, "key", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        if long.isEmpty():
            return done
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = open_rows.join(long, "key", "left_semi").withColumn("w", F.explode(F.array(
            F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b")
        )))
        open_rows = store(_keyed(halves.select("word", "n", "size", "w.a", "w.b")), "spelling-lists")


def _matrix(middles):
    """Code points of all middles, one row each, 0 behind the end; and their lengths."""
    lengths = np.array([len(m) for m in middles], dtype=np.int64)
    out = np.zeros((len(middles), int(lengths.max(initial=0)) + 3), dtype=np.uint32)
    flat = np.frombuffer("".join(middles).encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(len(middles)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths


def near_pairs(lists_of, middles):
    """Pairs i < j of rows of one list whose middles are one edit apart, and the length of the prefix they share.

    ``lists_of`` numbers the lists; rows stand in order of list and middle, and a list has no middle twice.
    """
    chars, lengths = _matrix(middles)
    n = len(middles)
    differs = chars[1:] != chars[:-1]
    # Prefix that each middle shares with the one above it, -1 where a list begins.
    lcp = np.full(n, -1)
    lcp[1:] = np.where(np.diff(lists_of) == 0, differs.argmax(axis=1), -1)

    def ranges(depth):
        """Begins and ends of the ranges that share a prefix of this length."""
        begin = np.flatnonzero(lcp < depth)
        end = np.append(begin[1:], n)
        long = lengths[begin] >= depth
        return begin[long], end[long]

    # Every word asks its own list. A state is a word, a range and the row of the matrix for the range's prefix.
    ask = np.arange(n)
    begin, end = np.flatnonzero(lcp < 0), np.append(np.flatnonzero(lcp < 0)[1:], n)
    own = np.repeat(np.arange(len(begin)), end - begin)
    begin, end = begin[own], end[own]
    row = np.tile(np.array([2, 0, 1], dtype=np.int8), (n, 1))
    left, right, depth = [], [], 0
    while len(ask):
        # The middle that is the prefix itself stands first in its range.
        gap = lengths[ask] - depth
        whole = np.flatnonzero((lengths[begin] == depth) & (begin > ask) & (abs(gap) <= 1))
        hit = whole[row[whole, gap[whole] + 1] == 1]
        left.append(ask[hit])
        right.append(begin[hit])
        # Go on to the ranges inside that share one character more and reach behind the word itself.
        inner_begin, inner_end = ranges(depth + 1)
        lo, hi = np.searchsorted(inner_begin, begin), np.searchsorted(inner_begin, end)
        state = np.repeat(np.arange(len(ask)), hi - lo)
        inner = np.arange(len(state)) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
        behind = inner_end[inner] > ask[state] + 1
        state, inner = state[behind], inner[behind]
        ask, old, c = ask[state], row[state], chars[inner_begin[inner], depth]
        row = np.empty((len(ask), 3), dtype=np.int8)
        row[:, 0] = np.minimum(old[:, 0] + (c != chars[ask, depth - 1]), old[:, 1] + 1)
        row[:, 1] = np.minimum(np.minimum(old[:, 1] + (c != chars[ask, depth]), old[:, 2] + 1), row[:, 0] + 1)
        row[:, 2] = np.minimum(old[:, 2] + (c != chars[ask, depth + 1]), row[:, 1] + 1)
        np.minimum(row, 2, out=row)
        # A range whose prefix is more than one edit away is skipped with all it holds.
        alive = row.min(axis=1, initial=2) <= 1
        ask, row, inner = ask[alive], row[alive], inner[alive]
        begin, end = inner_begin[inner], inner_end[inner]
        depth += 1
    i, j = np.concatenate(left), np.concatenate(right)
    return i, j, (chars[i] != chars[j]).argmax(axis=1)


def _whole_lists(batches):
    """Rows of sorted Arrow batches, cut where the key changes."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column("key").to_numpy()
        turns = np.flatnonzero(np.diff(keys)) + 1
        if len(turns):
            yield from _steps(held.slice(0, turns[-1]), np.concatenate([[0], turns]))
            held = held.slice(turns[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield from _steps(held, np.array([0, held.num_rows]))


def _steps(table, edges):
    """Runs of whole lists of about ``STEP_CELLS`` cells (one list at least)."""
    width = np.maximum.reduceat(table.column("width").to_numpy(), edges[:-1])
    start, widest = 0, 0
    for k in range(len(width)):
        widest = max(widest, width[k])
        if k > start and (edges[k + 1] - edges[start]) * (widest + 3) > STEP_CELLS:
            yield table.slice(edges[start], edges[k] - edges[start])
            start, widest = k, width[k]
    yield table.slice(edges[start], edges[-1] - edges[start])


def _scan(batches):
    """For every word of each list its near words: how many, and the most frequent."""
    for table in _whole_lists(batches):
        frames = {}
        words = table.column("word").to_pylist()
        size, a, b = (table.column(c).to_numpy() for c in ("size", "a", "b"))
        # Keys are hashes, so a list is told by the very text around its window.
        of = np.fromiter((
            frames.setdefault((s, x, y, w[:x], w[y + len(w) - s :]), len(frames))
            for w, s, x, y in zip(words, size.tolist(), a.tolist(), b.tolist())
        ), np.int64, len(words))
        order = np.argsort(of, kind="stable")
        middles = table.column("middle").to_pylist()
        i, j, shared = near_pairs(of[order], [middles[k] for k in order])
        i, j = order[i], order[j]
        longer = np.fromiter(map(len, words), np.int64, len(words)) - size
        # A first difference behind the window, or between two words of the longer size, belongs to another list.
        mine = (shared < (b - a)[i]) & (longer[i] + longer[j] < 2)
        i, j = np.concatenate([i[mine], j[mine]]), np.concatenate([j[mine], i[mine]])
        if not len(i):
            continue
        n = table.column("n").to_numpy()
        by_word = np.argsort(np.array(words, dtype=object), kind="stable")
        place = np.empty(len(words), dtype=np.int64)
        place[by_word] = np.arange(len(words))
        order = np.lexsort((place[j], -n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        yield pa.RecordBatch.from_arrays([
            pa.array([words[k] for k in i[first]], pa.string()), pa.array(np.diff(np.append(first, len(i))), pa.int64()),
            pa.array(n[j[first]], pa.int64()), pa.array([words[k] for k in j[first]], pa.string()),
        ], schema=_NEAR)


def near_words(vocab, longest=LIST, least_length=LEAST_LENGTH):
    """Every word with a near one: how many there are (``n_near``), and the most frequent with its count."""
    keyed = lists(vocab, longest, least_length).select("key", "word", "n", "size", "a", "b", "middle", F.length("middle").alias("width"))
    found = keyed.repartition("key").sortWithinPartitions("key", "middle").mapInArrow(_scan, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")
    )


def roots(forms):
    """Last word of the chain of forms from each word; counts grow tenfold at each step, so chains are short."""
    jumps = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = store(jumps.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        ), "spelling-roots")
        jumps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return jumps


def variants(docs, id_col="doc_id", text_col="text", ratio=RATIO, longest=LIST):
    """Every word: its occurrences, near words, form (its most frequent near word, if ``ratio`` times as frequent) and root."""
    vocab = store(vocabulary(docs, id_col, text_col), "spelling-words")
    near = store(near_words(vocab, longest), "spelling-near")
    formed = vocab.join(near, "word", "left").withColumn("takes", F.col("near_n") >= ratio * F.col("n"))
    out = store(formed.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("takes"), F.col("near")).alias("form"), F.when(F.col("takes"), F.col("near_n")).alias("form_n"),
    ), "spelling-forms")
    last = roots(out.where("form IS NOT NULL"))
    return out.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
