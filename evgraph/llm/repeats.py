"""Removal of byte strings that occur more than once, by backward extension over sorted contexts.

Every string of `least` bytes has an anchor: the leftmost of its grams with the least hash, and a second gram at a
fixed distance from it, on the side where more than half of the string's other bytes lie. Equal strings have equal
grams at equal places, so all strings with one pair of grams can be handled on their own. There the contexts to the
right of the anchor are sorted with the lengths of their common prefixes (a suffix array of the anchor's
occurrences, and the bytes to the left are its Burrows-Wheeler column). Level by level, intervals are extended
backwards by one byte: an interval splits by that byte, keeps its order, and lives on while it has two members.
With d bytes on the left, neighbours whose common prefix on the right reaches least - d hold a repeated string.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import ROWS_AT_ONCE, map_documents
from evgraph.llm.jaccard_join import _bitmap
from evgraph.session import materialize

BYTES_AT_ONCE = 500_000
STRING_BYTES_AT_ONCE = 8_000_000
KNOWN_TEXTS = 100_000
BITMAP_BITS = 1 << 25


def gram_bytes(least: int) -> int:
    """Largest power of two of at most a sixth of `least`: the longer a gram, the more anchors there are."""
    return 1 << max(0, (least // 6).bit_length() - 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    factor = 0x9E3779B97F4A7C15
    while width < gram:  # doubles the width: hash of a string from the hashes of its halves
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = (factor * factor + 2 * width) % 2**64 | 1, 2 * width
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each `width` neighbouring keys."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document, key, anchor, first start, last start), places in `data`: concatenated documents ending at `ends`.

    Each start of a string of `least` bytes inside a document belongs to exactly one row; the key is made of the two grams
    that all strings of the row hold.
    """
    gram = gram_bytes(least)
    if len(data) < least:
        return (np.empty(0, np.int64),) * 5
    hashes = _gram_hashes(data, gram)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_window_least(keys, least - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(place))
    doc = np.searchsorted(ends, starts, "right")
    inside = starts + least <= ends[doc]
    starts, place, doc = starts[inside], place[inside], doc[inside]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))[: len(place)]
    last = np.concatenate((first[1:], [len(place)]))[: len(first)] - 1
    doc, at, lo, hi = doc[first], place[first], starts[first], starts[last]
    half = (least - gram) // 2
    ahead, behind = hi >= at - half, lo < at - half  # bytes before the anchor: at most half, or more
    second = np.concatenate((at[ahead] + least - half - gram, at[behind] - half - 1))
    doc, lo = np.concatenate((doc[ahead], doc[behind])), np.concatenate((np.maximum(lo, at - half)[ahead], lo[behind]))
    hi = np.concatenate((hi[ahead], np.minimum(hi, at - half - 1)[behind]))
    side = np.repeat(np.array([1, 2], np.uint64), (ahead.sum(), behind.sum()))
    at = np.concatenate((at[ahead], at[behind]))
    key = hashes[at] * np.uint64(0x94D049BB133111EB) + hashes[second] * np.uint64(0xD6E8FEB86659FD93) + side
    return doc, (key ^ key >> np.uint64(32)).view(np.int64), at, lo, hi


class _RangeLeast:
    """Least of values[i + 1 .. j] for arrays i < j."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            top = self.rows[-1]
            self.rows.append(np.minimum(top[:-step], top[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = j - i
        level = np.frexp(size)[1] - 1
        out = np.empty(len(i), self.rows[0].dtype)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.rows[k][i[m] + 1], self.rows[k][j[m] + 1 - (1 << k)])
        return out


def repeated_starts(group: np.ndarray, strings: list[bytes], before: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(string, first, last): runs of offsets in the distinct `strings` where a `least`-byte string starts that another one
    of its group holds at the same distance from the anchor; `before` are the bytes ahead of the anchor."""
    n = len(strings)
    if n < 2:
        return (np.empty(0, np.int64),) * 3
    sizes = np.fromiter(map(len, strings), np.int64, n)
    after = sizes - before
    right, left = np.zeros((n, least), np.uint8), np.zeros((n, int(before.max()) + 1), np.uint8)
    for i, s in enumerate(strings):
        b = int(before[i])
        own = np.frombuffer(s, np.uint8)
        right[i, : after[i]] = own[b:]
        left[i, :b] = own[:b][::-1]
    # intervals of the empty extension: the members of a group, in the order of their right contexts
    ranked = np.lexsort((right.view(f"S{least}").ravel(), group))
    common = np.concatenate(([0], [_common(right[i], right[j]) for i, j in zip(ranked[:-1].tolist(), ranked[1:].tolist())]))
    del right
    common_between = _RangeLeast(common.astype(np.int32))
    rank = np.empty(n, np.int64)
    rank[ranked] = np.arange(n)
    lowest = least - after  # a string shorter to the right than least - d holds no such start
    rows, interval = ranked, np.unique(group[ranked], return_inverse=True)[1]
    opened, latest = np.full(n, -2), np.full(n, -2)
    runs = []
    for d in range(least):
        fits = before[rows] >= d
        rows, interval = rows[fits], interval[fits]
        if d:
            key = interval * 256 + left[rows, d - 1]
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            interval = np.concatenate(([0], (key[1:] != key[:-1]).cumsum()))[: len(key)]
        shared = np.bincount(interval, minlength=1)[interval] > 1 if len(interval) else np.empty(0, bool)
        rows, interval = rows[shared], interval[shared]
        if not len(rows):
            break
        judged = np.flatnonzero(lowest[rows] <= d)
        r, v = rows[judged], interval[judged]
        if len(r) > 1:
            same = np.flatnonzero(v[1:] == v[:-1])
            long = same[common_between(rank[r[same]], rank[r[same + 1]]) >= least - d]
            hit = np.unique(np.concatenate((r[long], r[long + 1])))
            fresh = hit[latest[hit] != d - 1]
            ended = fresh[latest[fresh] >= 0]
            runs.append((ended, before[ended] - latest[ended], before[ended] - opened[ended]))
            opened[fresh], latest[hit] = d, d
    ended = np.flatnonzero(latest >= 0)
    runs.append((ended, before[ended] - latest[ended], before[ended] - opened[ended]))
    return tuple(np.concatenate(c) for c in zip(*runs))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    differ = a != b
    at = int(differ.argmax())
    return at if differ[at] else len(a)


def _identity(text):
    """128 bits of a text, in two columns."""
    return F.xxhash64(F.lit(1), text).alias("b1"), F.xxhash64(F.lit(2), text).alias("b2")


def _buffers(batches, least: int):
    """(b1, b2, piece, place of the piece in its text), together at most about twice BYTES_AT_ONCE.

    A longer text is cut into pieces, each of which holds the strings that start in its first BYTES_AT_ONCE bytes. Copies of a text bring nothing new: those of the latest KNOWN_TEXTS texts are passed over.
    """
    held, size, seen = [], 0, set()
    for batch in batches:
        b1, b2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if (b1[i], b2[i]) in seen:
                continue
            if len(seen) >= KNOWN_TEXTS:
                seen.clear()
            seen.add((b1[i], b2[i]))
            text = batch.column(2)[i].as_py()
            for at in range(0, max(1, len(text) - least + 1), BYTES_AT_ONCE):
                held.append((b1[i], b2[i], text[at : at + BYTES_AT_ONCE + least - 1], at))
                size += len(held[-1][2])
                if size > BYTES_AT_ONCE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _shared_bitmap(hashes: DataFrame):
    """A bitmap of one column of 64-bit hashes, broadcast; 4 MB whatever their number: it may hold more, never fewer."""
    return hashes.sparkSession.sparkContext.broadcast(_bitmap(hashes, BITMAP_BITS))


def _in_bitmap(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (BITMAP_BITS - 1)
    return np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1) > 0


def _passing(rows: DataFrame, column: str, bits) -> DataFrame:
    """The rows whose hash in `column` is in the bitmap."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                yield rows.filter(pa.array(_in_bitmap(bits.value, rows.column(column).to_numpy())))

    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes))


def _anchored(least: int):
    """For mapInArrow: what `anchors` finds in each buffer, with the buffer's pieces and where the text of each begins."""

    def run(batches):
        for held in _buffers(batches, least):
            data = np.frombuffer(b"".join(t for _, _, t, _ in held), np.uint8)
            ends = np.cumsum([len(t) for _, _, t, _ in held])
            yield held, ends - [len(t) + at for _, _, t, at in held], anchors(data, ends, least)

    return run


def _anchor_counts(texts: DataFrame, least: int) -> DataFrame:
    """(h, n): the keys of anchors that are found more than once; copies that a task passes over do not count."""
    found = _anchored(least)

    def run(batches):
        for _, _, (_, h, _, _, _) in found(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], names=["h"])

    every = texts.select("b1", "b2", "text").mapInArrow(run, "h long")
    return every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")


def _repeated_anchors(texts: DataFrame, least: int, counts: DataFrame, portion: int) -> DataFrame:
    """(h, b1, b2, at, lo, hi, large): the anchors whose key is in `counts`.

    A bitmap of the keys passes over most others before anything is shuffled, and the join decides. Anchors with more than `portion`
    rows (and the few that share a bit with one) are `large`: they stay out of the join, which so has no hot key.
    """
    found = _anchored(least)
    often, crowded = _shared_bitmap(counts.select("h")), _shared_bitmap(counts.filter(F.col("n") > portion).select("h"))
    shape = pa.schema([(n, pa.int64()) for n in ("h", "b1", "b2")] + [(n, pa.int32()) for n in ("at", "lo", "hi")] + [("large", pa.bool_())])

    def run(batches):
        for held, begins, rows in found(batches):
            seen = _in_bitmap(often.value, rows[1])
            doc, h, at, lo, hi = (r[seen] for r in rows)
            begin = begins[doc]
            b1, b2 = (np.array([t[k] for t in held], np.int64)[doc] for k in (0, 1))
            columns = (h, b1, b2, at - begin, lo - begin, hi - begin, _in_bitmap(crowded.value, h))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    rows = texts.select("b1", "b2", "text").mapInArrow(run, "h long, b1 long, b2 long, at int, lo int, hi int, large boolean")
    met = rows.withColumn("key", F.when(F.col("large"), F.xxhash64("b1", "at")).otherwise(F.col("h")))
    return met.join(counts.withColumnRenamed("h", "key"), "key", "left").filter("large OR n IS NOT NULL").drop("key", "n")


STRING = "h long, s1 long, s2 long, before int, string binary, weight long"
OWNER = "s1 long, s2 long, b1 long, b2 long, lo int"


def _signed(digest: int) -> tuple[int, int]:
    return tuple(x - 2**64 if x >= 2**63 else x for x in (digest >> 64, digest & (2**64 - 1)))


def _rows(batches, at_once: int = 50):
    """Rows as dicts, a few of a batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            yield from batch.slice(at, at_once).to_pylist()


def _strings(found: DataFrame, least: int, owners: bool) -> DataFrame:
    """The strings of the listed anchors of each text: themselves (equal ones of a few texts together), or who owns them."""

    def run(batches):
        names = [f.split()[0] for f in (OWNER if owners else STRING).split(", ")]
        kinds = {"string": pa.binary(), "before": pa.int32(), "lo": pa.int32()}

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.int64())) for i, n in enumerate(names)], names=names)

        for batch in batches:
            rows, known, size = [], {}, 0
            for row in _rows([batch]):
                for p in row["places"]:
                    if size > STRING_BYTES_AT_ONCE:
                        yield out(rows)
                        rows, known, size = [], {}, 0
                    string = row["text"][p["lo"] : p["hi"] + least]
                    before = p["at"] - p["lo"]
                    name = _signed(xxhash.xxh3_128_intdigest(string + before.to_bytes(4, "little")))
                    size += 150
                    if owners:
                        rows.append((*name, row["b1"], row["b2"], p["lo"]))
                    elif (name, p["h"]) in known:
                        known[name, p["h"]][-1] += row["copies"]
                    else:
                        known[name, p["h"]] = one = [p["h"], *name, before, string, row["copies"]]
                        rows.append(one)
                        size += len(string)
            yield out(rows)

    return found.mapInArrow(run, OWNER if owners else STRING)


def _verdicts(strings: DataFrame, least: int) -> DataFrame:
    """(s1, s2, first, last): runs of repeated starts in each string, groups compared in whole."""
    shape = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def out(table):
        h, s1, s2 = (table.column(n).to_numpy() for n in ("h", "s1", "s2"))
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))[: len(h)]
        own = np.flatnonzero(new)
        weight = np.add.reduceat(table.column("weight").to_numpy(), own)
        table = table.take(pa.array(own))
        before, group = table.column("before").to_numpy().astype(np.int64), h[own]
        lengths = pc.binary_length(table.column("string")).to_numpy()
        alone = np.concatenate(([True], group[1:] != group[:-1])) & np.concatenate((group[1:] != group[:-1], [True]))
        meet = np.flatnonzero(~alone)
        k, first, last = repeated_starts(group[meet], table.column("string").take(pa.array(meet)).to_pylist(), before[meet], least)
        k = meet[k] if len(k) else k
        whole = np.flatnonzero(weight > 1)  # strings that occur more than once repeat in full
        mine = weight[k] == 1
        row = own[np.concatenate((whole, k[mine]))]
        rows = (s1[row], s2[row], np.concatenate((0 * whole, first[mine])), np.concatenate((lengths[whole] - least, last[mine])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, shape)], schema=shape)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column("h")[-1]
            if held[0].column("h")[0] != last:
                table = pa.Table.from_batches(held).combine_chunks()
                whole = int(np.searchsorted(table.column("h").to_numpy(), last.as_py()))
                yield out(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks())

    dealt = strings.repartition("h").sortWithinPartitions("h", "s1", "s2")
    return dealt.mapInArrow(run, "s1 long, s2 long, first int, last int")


def _counted_windows(found: DataFrame, least: int) -> DataFrame:
    """(b1, b2, first, last) for anchors whose group is too large for one task: every string counts by its hash."""

    def run(batches):
        names = ["w1", "w2", "b1", "b2", "start", "copies"]
        for row in _rows(batches):
            text, rows = row["text"], []
            for p in row["places"]:
                for start in range(p["lo"], p["hi"] + 1):
                    name = _signed(xxhash.xxh3_128_intdigest(text[start : start + least]))
                    rows.append((*name, row["b1"], row["b2"], start, row["copies"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=names)

    windows = found.mapInArrow(run, "w1 long, w2 long, b1 long, b2 long, start long, copies long")
    often = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).filter("n > 1").select("w1", "w2")
    start = F.col("start").cast("int")
    return windows.join(often, ["w1", "w2"]).select("b1", "b2", start.alias("first"), start.alias("last"))


def repeats(texts: DataFrame, least: int = 400, portion: int = 50_000) -> DataFrame:
    """(b1, b2, first, last): runs of starts of strings of `least` bytes that start elsewhere too, by text identity.

    `texts` has doc_id, b1, b2 and the binary text. Of equal texts one is read. Anchors are looked for twice: first their keys are
    counted, then the places of repeated ones are listed. Anchors found in more than `portion` rows go by counting, all others
    by interval expansion, which gives the same.
    """
    counts = materialize(_anchor_counts(texts, least), "anchors")
    readers = texts.groupBy("b1", "b2").agg(F.min("doc_id").alias("reader"), F.count("*").alias("copies"))
    places = (
        _repeated_anchors(texts, least, counts, portion)
        .groupBy("b1", "b2", "large")  # the anchors of one text
        .agg(F.collect_set(F.struct("h", "at", "lo", "hi")).alias("places"))
    )
    asked = materialize(places.join(readers, ["b1", "b2"]).withColumnsRenamed({"b1": "r1", "b2": "r2"}), "places")
    # only the texts that are read for their anchors are shuffled
    named = _shared_bitmap(asked.select(F.xxhash64("reader", "r1").alias("name")))
    wanted = _passing(texts.withColumn("name", F.xxhash64("doc_id", "b1")), "name", named)
    same = wanted.doc_id.eqNullSafe(F.col("reader")) & (F.col("b1") == F.col("r1")) & (F.col("b2") == F.col("r2"))
    found = materialize(wanted.join(asked, same).select("b1", "b2", "text", "places", "copies", "large"), "readers")
    grouped = found.filter(~F.col("large")).drop("large")
    verdicts = _verdicts(_strings(grouped, least, owners=False), least)
    owners = _strings(grouped, least, owners=True)
    expanded = owners.join(verdicts, ["s1", "s2"]).select(
        "b1", "b2", (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last")
    )
    return expanded.union(_counted_windows(found.filter("large").drop("large"), least))


def remove_repeats(docs: DataFrame, least: int = 400, portion: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (remaining bytes) of every row of `docs` (doc_id, text).

    Removed is each byte covered by a string of `least` bytes that also starts anywhere else in the table, on the
    input as it stands. A null text is empty; texts under `least` bytes stay whole; rows that repeat are copies of
    each other; an empty table gives an empty result; other columns are ignored.
    """
    if least < 3:
        raise ValueError("least must be 3 or more")
    plain = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select("doc_id", *_identity(plain), plain.alias("text"))
    long = texts.filter(F.octet_length("text") >= least)
    runs = repeats(long, least, portion)
    copied = long.groupBy("b1", "b2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).filter("n > 1")
    whole = copied.select("b1", "b2", F.lit(0).alias("first"), (F.col("size") - least).cast("int").alias("last"))
    per_text = (
        runs.union(whole)
        .groupBy(F.col("b1").alias("r1"), F.col("b2").alias("r2"))  # the runs of one text
        .agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))
    )
    per_text = materialize(per_text, "repeats")
    cut_texts = _shared_bitmap(per_text.select("r1"))
    # merged, not broadcast: a stage then has one Python worker a task
    told = _passing(texts, "b1", cut_texts).join(per_text.hint("merge"), (F.col("b1") == F.col("r1")) & (F.col("b2") == F.col("r2")), "left")
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(rows):
        made = [_cut(t, r or [], least) for t, r in zip(rows["text"], rows["runs"])]
        return {"doc_id": rows["doc_id"]} | {n: [m[i] for m in made] for i, n in enumerate(names)}

    def leave(rows):
        at = np.flatnonzero(~_in_bitmap(cut_texts.value, np.array(rows["b1"], np.int64))).tolist()
        return cut({"doc_id": [rows["doc_id"][i] for i in at], "text": [rows["text"][i] for i in at], "runs": [None] * len(at)})

    changed = map_documents(told.select("doc_id", "text", "runs"), cut, shape)
    return changed.union(map_documents(texts.select("doc_id", "b1", "text"), leave, shape))


def _cut(text: bytes, runs: list[dict], least: int) -> tuple:
    kept, at, spans, removed = [], 0, 0, 0
    for run in runs:
        start, end = run["first"], run["last"] + least
        if start > at or not spans:  # touching runs are one span
            kept.append(text[at:start])
            spans += 1
            removed += end - start
        else:
            removed += max(0, end - at)
        at = max(at, end)
    kept.append(text[at:])
    rest = b"".join(kept)
    return len(text), removed, spans, hashlib.sha256(rest).hexdigest(), rest
