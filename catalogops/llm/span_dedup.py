"""Removal of repeated byte spans by a depth-limited radix sort of suffixes.

Suffixes are ordered only through WINDOW bytes, by most-significant-digit
passes.  After each pass only groups that hold suffixes of several documents go on;
groups still equal after the last digit are exactly the repeated windows.

The first digit is not taken at every position but at anchors: in every window the
GRAM-byte string with the smallest hash.  Equal windows have the same
anchors at the same offsets, so nothing is lost, and one suffix in fifteen is
shuffled.  An anchor stands for all windows around it, which lie in
LEFT bytes before it and WINDOW after it: its context.

Pass 1 deals the anchors by the first digit (the gram).  Anchors whose whole
context a smaller document has are settled there; the smallest document of
each other context goes on.  Pass 2 deals those by gram and sorts the windows of
each offset by digits of eight bytes.  Grams with very many contexts are dealt
by whole window instead, combined before the shuffle, so that no task gets an unbounded group.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import slices
from catalogops.plans.staging import written

WINDOW = 50
GRAM = 20
LEFT = WINDOW - GRAM
CONTEXT = LEFT + WINDOW
#: Bytes of text whose hashes a task holds at a time; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Contexts of one gram that one task sorts; grams with more are dealt by window.
MAX_CONTEXTS = 4000
#: Rows that pass 2 sorts at a time.
SORT_ROWS = 20_000
#: Bytes of text for each bucket of pass 1.
BUCKET_BYTES = 2 << 20

FULL, HEAD, HOT = 0, 1, 2
_U = np.uint64
_A = 0x9E3779B97F4A7C15
_NULL_ID = 2**63 - 1  # rows without an id come after all others


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(_A))
_WEIGHTS = _mix(np.arange(1, 40, dtype=_U) * _U(_A)) | _U(1)


def gram_hashes(data: np.ndarray, length: int = GRAM) -> np.ndarray:
    """Hash of the ``length`` bytes from each position, by doubling."""
    one, done, total, width = _BYTE[data], 0, None, 1
    while True:
        if length & width:
            if total is None:
                total, done = one, width
            else:
                n = len(data) - done - width + 1
                total = total[:n] * _U(pow(_A, width, 1 << 64)) + one[done : done + n]
                done += width
        width *= 2
        if width > length:
            return _mix(total)
        one = one[: -(width // 2)] * _U(pow(_A, width // 2, 1 << 64)) + one[width // 2 :]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values, by doubling."""
    span, n = 1, len(values) - width + 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[:n], values[width - span : width - span + n])


class Pieces:
    """Texts of a batch, cut to pieces of bounded size with the context their windows need, and joined by zeros."""

    def __init__(self):
        self.parts, self.rows, self.first, self.size = [], [], [], CONTEXT

    def add(self, row: int, text: bytes, at: int, stop: int) -> None:
        """The windows of ``text`` that start in [at, stop)."""
        low, high = max(0, at - LEFT), min(len(text), stop + LEFT + WINDOW)
        self.parts.append((row, at, min(stop, len(text) - WINDOW + 1), low, high, self.size))
        self.rows.append(text[low:high])
        self.size += high - low + CONTEXT

    def anchors(self):
        """(row, position, gram hash, context bytes, left and right length) of every anchor."""
        gap = bytes(CONTEXT)
        data = np.frombuffer(gap + gap.join(self.rows) + gap, np.uint8)
        grams = gram_hashes(data)
        order = (grams >> _U(32)).astype(np.uint32) | np.uint32(1)
        least = _sliding(order, LEFT + 1, np.minimum)
        valid = np.zeros(len(least) + 1, np.int8)
        row, at, stop, low, high, base = (np.array(x, np.int64) for x in zip(*self.parts))
        np.add.at(valid, base + at - low, 1)
        np.add.at(valid, base + stop - low, -1)
        least[np.cumsum(valid[:-1]) == 0] = 0
        padded = np.concatenate([np.zeros(LEFT, np.uint32), least, np.zeros(LEFT, np.uint32)])
        where = np.flatnonzero(_sliding(padded, LEFT + 1, np.maximum) == order)
        part = np.searchsorted(base, where, "right") - 1
        pos = where - base[part] + low[part]
        return row[part], pos, grams[where], data, where


def context_matrix(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, CONTEXT)[where - LEFT]


def context_hash(data: np.ndarray, where: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hash of each anchor's context; zeros stand outside the text, so its lengths count too."""
    words = np.ascontiguousarray(context_matrix(data, where)).view(_U)
    total = _mix((left * 64 + right).astype(_U) + _U(1))
    for i in range(words.shape[1]):
        total = total + _mix(words[:, i] * _WEIGHTS[i] + _U(i))
    return _mix(total)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of the values, all first bytes first: sorted values then compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1)[:, :width].T).tobytes()


def _from_planes(blob: pa.Buffer, at: int, n: int, width: int, kind) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view(kind)


#: A bucket has its grams by the upper half of their hash, so that the lower half tells them apart.
#: The tag takes room only where ids repeat.
_FIELDS = (("gram", 4, _U), ("context", 8, _U), ("doc", 8, np.int64), ("pos", 5, np.int64))
_TAGGED = (*_FIELDS, ("tag", 8, np.int64))


def _pack(columns: dict, fields: tuple) -> bytes:
    return b"".join(_planes(columns[name].astype(kind), width) for name, width, kind in fields)


def _unpack(blobs: list[pa.Buffer], fields: tuple) -> dict:
    got = {name: [] for name, _, _ in fields}
    row_bytes = sum(w for _, w, _ in fields)
    for blob in blobs:
        n, at = len(blob) // row_bytes, 0
        for name, width, kind in fields:
            got[name].append(_from_planes(blob, at, n, width, kind))
            at += n * width
    return {k: np.concatenate(v) for k, v in got.items()}


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in rows sorted by the keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _several(sorted_keys: np.ndarray) -> np.ndarray:
    """Whether a row's key occurs more than once."""
    new = _starts(sorted_keys)
    return ~(new & np.append(new[1:], True))


def _piece_batches(batch: pa.RecordBatch):
    """Pieces of bounded size, with the rows' ids and tags and each row's text as bytes."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    held = Pieces()
    for row, text in enumerate(texts):
        text = text or b""
        for at in range(0, len(text) - WINDOW + 1, PIECE):
            if held.parts and held.size > PIECE:
                yield held, texts
                held = Pieces()
            held.add(row, text, at, at + PIECE)
    if held.parts:
        yield held, texts


def _first_pass(buckets: int, fields: tuple):
    """Anchors by bucket of their gram; contexts repeated within the piece are settled here."""

    def run(batches):
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            for held, texts in _piece_batches(batch):
                row, pos, gram, data, where = held.anchors()
                size = np.array([len(t or b"") for t in texts], np.int64)[row]
                hashed = context_hash(data, where, np.minimum(pos, LEFT), np.minimum(size - pos, WINDOW))
                doc, tag = ids[row], tags[row]
                order = np.argsort(gram)
                same = order[_several(gram[order])]
                same = same[np.lexsort((doc[same], hashed[same], gram[same]))]
                new = _starts(gram[same], hashed[same])
                later = np.zeros(len(gram), bool)
                later[same] = doc[same] > doc[same][new][np.cumsum(new) - 1]
                got = {"gram": gram[order], "context": hashed[order], "doc": doc[order], "tag": tag[order], "pos": pos[order]}
                later = later[order]
                yield from _mark_rows(got["doc"][later], got["tag"][later], got["pos"][later] * 4 + FULL, buckets)
                kept = {k: v[~later] for k, v in got.items()}
                bucket = ((kept["gram"] >> _U(32)) * _U(buckets)) >> _U(32)
                kept["gram"] &= _U(2**32 - 1)
                order = np.lexsort((kept["gram"], bucket))
                kept, bucket = {k: v[order] for k, v in kept.items()}, bucket[order]
                edges = np.flatnonzero(_starts(bucket))
                rows = [_pack({k: v[a:b] for k, v in kept.items()}, fields) for a, b in zip(edges, [*edges[1:], len(bucket)])]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[edges].astype(np.int64)), "blob": pa.array(rows, pa.binary()), **_no_marks(len(rows))})

    return run


def _no_marks(n: int) -> dict:
    return {"doc": pa.nulls(n, pa.int64()), "tag": pa.nulls(n, pa.int64()), "mark": pa.nulls(n, pa.int64())}


def _mark_rows(doc, tag, mark, buckets):
    """Settled marks travel with the anchors, dealt evenly."""
    if len(doc):
        bucket = (_mix(doc.astype(_U) * _U(_A) + mark.astype(_U)) % _U(buckets)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket), "blob": pa.nulls(len(doc), pa.binary()), "doc": pa.array(doc), "tag": pa.array(tag), "mark": pa.array(mark)})


def _settle_bucket(blobs: list[pa.Buffer], max_contexts: int, fields: tuple) -> pa.RecordBatch:
    """Marks (doc, tag, position * 4 + kind) of a bucket: settled contexts, and heads that go on."""
    got = _unpack(blobs, fields)
    order = np.argsort(got["gram"])
    order = order[_several(got["gram"][order])]  # the first digit alone settles most suffixes
    got = {k: v[order] for k, v in got.items()}
    if not len(order):
        return pa.RecordBatch.from_pydict(_no_marks(0))
    order = np.lexsort((got["doc"], got["context"], got["gram"]))
    got = {k: v[order] for k, v in got.items()}
    new_gram, new_context = _starts(got["gram"]), _starts(got["gram"], got["context"])
    gram, context = np.cumsum(new_gram) - 1, np.cumsum(new_context) - 1
    least = got["doc"][np.flatnonzero(new_context)][context]
    contexts = np.bincount(gram[new_context])[gram]
    low = np.minimum.reduceat(got["doc"], np.flatnonzero(new_gram))[gram]
    high = np.maximum.reduceat(got["doc"], np.flatnonzero(new_gram))[gram]
    later = got["doc"] > least
    goes_on = ~later & (contexts > 1) & (low < high)
    kind = np.where(later, FULL, np.where(contexts > max_contexts, HOT, HEAD))
    out = later | goes_on
    tag = got["tag"][out] if "tag" in got else np.zeros(int(out.sum()), np.int64)
    return pa.RecordBatch.from_pydict({"doc": pa.array(got["doc"][out]), "tag": pa.array(tag), "mark": pa.array((got["pos"] * 4 + kind)[out])})


def _first_groups(max_contexts: int, fields: tuple):
    """Rows come sorted by bucket; a bucket is settled when all its blobs are there, which are held as views of their batches."""

    def run(batches):
        held, current = [], None
        for batch in batches:
            done = batch.column("mark").is_valid()
            yield batch.select(["doc", "tag", "mark"]).filter(done)
            buckets, blobs = batch.column("bucket").to_numpy(), batch.column("blob")
            for i in np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if buckets[i] != current:
                    if held:
                        yield _settle_bucket(held, max_contexts, fields)
                    held, current = [], buckets[i]
                held.append(blobs[i].as_buffer())
        if held:
            yield _settle_bucket(held, max_contexts, fields)

    return run


_ROW = ("key", "context", "left", "right", "offsets", "doc", "tag", "mark")
_ROW_DDL = "key long, context binary, left int, right int, offsets long, doc long, tag long, mark long"


def _rows(key, context, left, right, offsets, doc, tag, mark) -> pa.RecordBatch:
    n = len(key)
    if context is None:
        blobs = pa.nulls(n, pa.binary())
    else:
        blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CONTEXT), n, [None, pa.py_buffer(np.ascontiguousarray(context))]).cast(pa.binary())
    i32 = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), blobs, i32(left), i32(right), pa.array(offsets.astype(np.int64)), pa.array(doc), pa.array(tag), pa.array(mark)], list(_ROW))


def _valid_offsets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit o: the window that starts o bytes before the anchor lies in the text."""
    low, high = np.maximum(WINDOW - right, 0), np.minimum(left, LEFT)
    bits = (_U(1) << (high + 1).astype(_U)) - (_U(1) << np.minimum(low, high + 1).astype(_U))
    return bits.astype(np.int64)


def _second_pass(batches):
    """Contexts of the heads, for each row (id, tag, text, marks)."""
    for batch in batches:
        ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
        marks = batch.column("marks")
        counts = pa.compute.list_value_length(marks).to_numpy()
        flat = pa.compute.list_flatten(marks).to_numpy()
        texts = batch.column("text").cast(pa.binary())
        start = np.concatenate([[0], np.cumsum(counts)])
        row = 0
        while row < len(ids):
            stop, size = row, 0
            while stop < len(ids) and (stop == row or size + len(texts[stop].as_buffer()) <= 4 * PIECE):
                size += len(texts[stop].as_buffer())
                stop += 1
            part = [texts[i].as_py() for i in range(row, stop)]
            base = np.cumsum([CONTEXT, *(len(t) + CONTEXT for t in part[:-1])])
            gap = bytes(CONTEXT)
            data = np.frombuffer(gap + gap.join(part) + gap, np.uint8)
            of = np.repeat(np.arange(stop - row), counts[row:stop])
            packed = flat[start[row] : start[stop]]
            pos, kind = packed >> 2, packed & 3
            left, right = np.minimum(pos, LEFT), np.minimum(np.array([len(t) for t in part], np.int64)[of] - pos, WINDOW)
            offsets, doc, tag = _valid_offsets(left, right), ids[row:stop][of], tags[row:stop][of]
            yield from _contexts(data, base[of] + pos, kind, left, right, offsets, doc, tag, pos)
            row = stop


def _contexts(data, where, kind, left, right, offsets, doc, tag, pos):
    for at in range(0, len(where), SORT_ROWS):
        s = slice(at, at + SORT_ROWS)
        head = np.flatnonzero(kind[s] == HEAD) + at
        if len(head):
            context = context_matrix(data, where[head])
            gram = np.ascontiguousarray(context[:, LEFT:WINDOW])
            key = _hash_bytes(gram)
            yield _rows(key, context, left[head], right[head], offsets[head], doc[head], tag[head], pos[head])
        hot = np.flatnonzero(kind[s] == HOT) + at
        if len(hot):
            context = context_matrix(data, where[hot])
            for o in range(LEFT + 1):
                has = np.flatnonzero(offsets[hot] >> o & 1)
                if not len(has):
                    continue
                window = np.ascontiguousarray(context[has, LEFT - o : LEFT - o + WINDOW])
                key = _hash_bytes(window) + _U(o)
                rows = hot[has]
                order = np.lexsort((doc[rows], key))
                new = _starts(key[order])
                least = doc[rows][order][new][np.cumsum(new) - 1]
                later = doc[rows][order] > least
                gone = rows[order][later]
                yield _passed(doc[gone], tag[gone], pos[gone], np.full(len(gone), 1 << o))
                left_over = order[~later]
                keep = rows[left_over]
                only = np.zeros((len(keep), CONTEXT), np.uint8)  # zeros around the window compress
                only[:, LEFT - o : LEFT - o + WINDOW] = window[left_over]
                yield _rows(key[left_over], only, left[keep], right[keep], np.full(len(keep), 1 << o), doc[keep], tag[keep], pos[keep])


def _passed(doc, tag, pos, offsets) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.int32)
    return _rows(_mix(doc.astype(_U) + pos.astype(_U) * _U(_A)), None, none, none, offsets, doc, tag, pos)


def _hash_bytes(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(_U)
    total = np.zeros(n, _U)
    for i in range(words.shape[1]):
        total = total + _mix(words[:, i] * _WEIGHTS[i] + _U(i + 1))
    return _mix(total)


def radix_groups(windows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal windows within a group, by most-significant-digit passes: (rows, group of each), sorted by group.

    After each digit of eight bytes, rows alone in their group leave.
    """
    rows = np.arange(len(windows))
    width = windows.shape[1]
    for at in range(0, width, 8):
        digit = np.zeros((len(rows), 8), np.uint8)
        digit[:, : min(8, width - at)] = windows[rows, at : at + 8]
        digit = digit.view(">u8").reshape(-1)
        order = np.lexsort((digit, group))
        rows, group, digit = rows[order], group[order], digit[order]
        group = np.cumsum(_starts(group, digit)) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        rows, group = rows[several], group[several]
        if not len(rows):
            break
    return rows, group


def _sorted_groups(key, context, offsets, doc, tag, pos):
    """Offsets at which a smaller document has the same window, for rows sorted by key."""
    group = np.cumsum(_starts(key)) - 1
    found = np.zeros(len(key), np.int64)
    for o in range(LEFT + 1):
        has = np.flatnonzero(offsets >> o & 1)
        if len(has) < 2:
            continue
        rows, equal = radix_groups(context[has, LEFT - o : LEFT - o + WINDOW], group[has])
        if len(rows):
            rows = has[rows]
            first = np.flatnonzero(_starts(equal))
            least = np.repeat(np.minimum.reduceat(doc[rows], first), np.diff([*first, len(rows)]))
            found[rows[doc[rows] > least]] |= 1 << o
    hit = found != 0
    return _marks(doc[hit], tag[hit], pos[hit], found[hit])


def _marks(doc, tag, pos, offsets) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc": pa.array(doc), "tag": pa.array(tag), "mark": pa.array((pos << 31) | offsets)})


def _second_groups(batches):
    """Rows come sorted by key; as many whole keys as fit are sorted at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(table):
        context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(-1, CONTEXT)
        return _sorted_groups(*(context if c == "context" else table.column(c).to_numpy() for c in ("key", "context", "offsets", "doc", "tag", "mark")))

    for batch in batches:
        passed = pa.compute.is_null(batch.column("context"))
        done = batch.filter(passed)
        yield _marks(*(done.column(c).to_numpy() for c in ("doc", "tag", "mark", "offsets")))
        rest = batch.filter(pa.compute.invert(passed))
        if rest.num_rows:
            held.append(rest)
            size += rest.num_rows
        if size >= SORT_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield settle(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = table.num_rows - cut
    if held:
        yield settle(pa.Table.from_batches(held).combine_chunks())


def _cut(batches):
    """Spans to remove and what is left of each text, from the marks of both passes."""
    for batch in chain.from_iterable(slices(b, "text") for b in batches):
        kept, sizes, gone, spans = [], [], [], []
        for text, settled, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("marks"), batch.column("found")):
            text = text or b""
            settled, found = (m.values.to_numpy() if m.is_valid else np.zeros(0, np.int64) for m in (settled, found))
            full = settled[settled & 3 == FULL] >> 2
            pos = np.concatenate([full, found >> 31])
            offsets = np.concatenate([_valid_offsets(np.minimum(full, LEFT), np.minimum(len(text) - full, WINDOW)), found & (2**31 - 1)])
            change = np.zeros(len(text) + 1, np.int32)
            for o in range(LEFT + 1):
                at = pos[(offsets >> o & 1) == 1] - o
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
            inside = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            kept.append(np.frombuffer(text, np.uint8)[~inside].tobytes() if len(edge) else text)
            sizes.append(len(text))
            gone.append(int(inside.sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(kept, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            ["id", "kept", "n_bytes", "n_removed", "spans"],
        )


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """One row per row of ``docs``: ``id_col, kept, n_bytes, n_removed, spans``.

    Every byte that lies in a 50-byte string which also starts in a row with a
    smaller id is removed; strings are judged on the input and never cross
    texts.  ``kept`` holds the other bytes (binary: cuts may split a
    character), ``spans`` the maximal removed runs.  A null text is empty; texts below 50 bytes lose
    nothing.  Rows with the same id do not count against each other; rows
    without an id come after all others.  An empty table gives no rows; other columns are not used.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.lit(0).cast("long").alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    keys, fields = ["id"], _FIELDS
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        # A number tells rows of one id apart.  It is written with its text, so that both joins see the same one.
        keys, fields = ["id", "tag"], _TAGGED
        rows = written(rows.withColumn("tag", F.monotonically_increasing_id()), "numbered-texts")
    # One exchange of the texts serves both joins.
    texts = rows.repartition(*keys)
    marks = "doc long, tag long, mark long"
    first = rows.mapInArrow(_first_pass(buckets, fields), f"bucket long, blob binary, {marks}").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_first_groups(max_contexts, fields), marks)
    by_row = lambda m, name: m.select(F.col("doc").alias("id"), *keys[1:], "mark").groupBy(*keys).agg(F.collect_list("mark").alias(name))
    # Settled marks go to the end at once; one exchange of the first marks serves both joins.
    settled = by_row(first, "marks")
    heads = texts.join(settled.hint("shuffle_hash"), keys)
    second = heads.mapInArrow(_second_pass, _ROW_DDL).repartition("key").sortWithinPartitions("key").mapInArrow(_second_groups, marks)
    cut = texts.join(settled.hint("shuffle_hash"), keys, "left").join(by_row(second, "found").hint("shuffle_hash"), keys, "left")
    out = cut.mapInArrow(_cut, "id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>")
    return out.select(F.when(F.col("id") != _NULL_ID, F.col("id")).alias(id_col), "kept", "n_bytes", "n_removed", "spans")
