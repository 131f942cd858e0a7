"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of 50 bytes that covers it also starts in a document
with a smaller doc_id. Every 50-byte string has one anchor, its 20-byte
substring of least hash, so equal strings have equal anchors, and consecutive
strings with one anchor form a unit of at most 80 bytes.

1. Anchors are counted over all documents (packed arrays, one row for each
   batch of documents and hash range). Most anchors stand in one text only;
   nothing that hangs on them can repeat. Whole copies are told apart by a
   fingerprint of the text, so their anchors alone don't count as repeated:
   a copy of a document with a smaller doc_id just goes.
2. Units of repeated anchors are dealt by anchor. Where an anchor stands in
   very many documents its strings are dealt one by one, by their own hash, so
   no task holds a hot group. Equal units of a batch travel once.
3. A task sorts the suffixes of a few shards of its units, to 50 bytes, and
   takes each shard's Burrows-Wheeler transform. The transforms are merged by
   refining the interleave: after k rounds of stable partition by symbol, the
   interleave is right for the first k symbols, and no suffix is compared or
   sorted again. Symbols are pairs of bytes. Units that share no string, by
   hash, stay out. The rounds also split the ranks into intervals of suffixes
   with a common prefix; those left after 50 bytes are the repeated intervals,
   and the least doc_id of an interval decides for all its strings.
4. Verdicts go back to the batches as bits, become byte ranges of documents
   and meet the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._bytes import TABLE, U, Block, as_bytes, blocks, mix, powers, range_hash
from textloom.llm._util import Workspace, key128

SPAN = 50
ANCHOR = 20
WINDOW = SPAN - ANCHOR + 1
_POS = 28  # bits of a position inside a block; the rest orders anchors
NO_ID = np.iinfo(np.int64).max


def units_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash, text number) of each unit of a block, and the prefix sums."""
    sums = block.sums(TABLE)
    n = len(block.data) - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if len(block.data) < SPAN:
        return none, none, np.zeros(0, U), none, sums
    g = mix((sums[ANCHOR:] - sums[:n]) * powers(len(sums))[1][:n])
    ranked = (g & ~U((1 << _POS) - 1)) | np.arange(n, dtype=U)
    rows = -(-n // WINDOW)
    padded = np.full(rows * WINDOW, np.iinfo(np.uint64).max, U)
    padded[:n] = ranked
    grid = padded.reshape(rows, WINDOW)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - WINDOW + 1
    at = (np.minimum(behind[:m], ahead[WINDOW - 1 : WINDOW - 1 + m]) & U((1 << _POS) - 1)).astype(np.int64)
    room = np.maximum(block.ends - SPAN + 1 - block.starts, 0)  # strings of each text
    total = int(room.sum())
    if not total:
        return none, none, np.zeros(0, U), none, sums
    text = np.repeat(np.arange(len(room)), room)
    start = np.arange(total) - np.repeat(np.cumsum(room) - room, room) + np.repeat(block.starts, room)
    anchor = at[start]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[first, total])
    return start[first], count, g[anchor[first]], text[first], sums


def _slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes of text, so that what hangs on a batch stays small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // size)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def _batch_id(k: int) -> int:
    return (TaskContext.get().partitionId() << 24) + k


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return batch.column("doc_id").to_numpy(), batch.column("row").to_numpy(), as_bytes(batch.column("text"))


_EXCHANGE = "kind int, batch long, part int, a binary, b binary, c binary, d binary"


def _exchange_row(kind: int, batch: int, part: int, *data: np.ndarray) -> dict:
    return {"kind": kind, "batch": batch, "part": part} | {k: x.tobytes() for k, x in zip("abcd", [*data, *[np.zeros(0, np.uint8)] * (4 - len(data))])}


def _emit(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    types = {"kind": pa.int32(), "batch": pa.int64(), "part": pa.int32()} | {k: pa.binary() for k in "abcd"}
    for i in range(0, len(rows), 64):
        yield pa.record_batch({k: pa.array([r[k] for r in rows[i : i + 64]], t) for k, t in types.items()})


def _split40(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40-bit numbers as their upper 32 and lower 8 bits."""
    return (x >> U(8)).astype(np.uint32), (x & U(255)).astype(np.uint8)


def count_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """For each batch: distinct anchors by part with document counts and the text's fingerprint (kind 0);
    each unit's place among them (kind 1). The fingerprint (40 bits) is 0 where several texts have the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(_slices(batches)):
            _, row, texts = _rows(batch)
            prints = (batch.column("k1").to_numpy().view(U) & U((1 << 40) - 1)) | U(1)
            keys, docs_, per_doc = [], [], np.zeros(len(texts), np.int32)
            for block in blocks(texts, 1 << 19):
                _, _, anchor, text, _ = units_of(block)
                keys.append(anchor)
                docs_.append(text + block.lo)
                per_doc[block.lo : block.hi] = np.bincount(text, minlength=block.hi - block.lo)
            key = np.concatenate(keys) if keys else np.zeros(0, U)
            doc = np.concatenate(docs_) if docs_ else np.zeros(0, np.int64)
            if not len(key):
                continue
            part = ((key >> U(40)) % U(parts)).astype(np.int64)
            low = key & U((1 << 40) - 1)
            # Texts in the order of their fingerprints, so equal texts stand together.
            order = np.lexsort((prints[doc], (part.astype(U) << U(40)) | low))
            p, q, d = part[order], low[order], doc[order]
            new = np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
            fresh = np.r_[True, d[1:] != d[:-1]] | new
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            f = prints[d]
            f = np.where(np.minimum.reduceat(f, heads) == np.maximum.reduceat(f, heads), f[heads], U(0))
            held = np.minimum(np.add.reduceat(fresh.astype(np.int64), heads), 255).astype(np.uint8)
            place = np.empty(len(key), np.int32)
            place[order] = group
            p, q = p[new], q[new]
            cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            out = [
                _exchange_row(0, _batch_id(k), int(p[i]), *_split40(q[i:j]), held[i:j], np.frombuffer(b"".join(x.tobytes() for x in _split40(f[i:j])), np.uint8))
                for i, j in zip(cut, np.r_[cut[1:], len(p)])
            ]
            out.append(_exchange_row(1, _batch_id(k), -1, row.astype(np.int64), per_doc, place))
            yield from _emit(out)

    return docs.mapInArrow(run, _EXCHANGE)


def judge_anchors(counts: DataFrame, hot: int) -> DataFrame:
    """For each batch and part, one byte for each distinct anchor: 0 in one text, 1 repeated, 2 in more than ``hot`` documents."""

    def run(table: pa.Table) -> pa.Table:
        a, b, c = ([np.frombuffer(x, t) for x in table.column(n).to_pylist()] for n, t in (("a", np.uint32), ("b", np.uint8), ("c", np.uint8)))
        key = (np.concatenate(a).astype(U) << U(8)) | np.concatenate(b).astype(U)
        packed = table.column("d").to_pylist()
        prints = np.concatenate([(np.frombuffer(x, np.uint32, n).astype(U) << U(8)) | np.frombuffer(x, np.uint8, n, 4 * n) for x, n in zip(packed, map(len, a))])
        order = np.argsort(key, kind="stable")
        s, f = key[order], prints[order]
        new = np.r_[True, s[1:] != s[:-1]]
        heads = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate(c).astype(np.int64)[order], heads)
        low = np.minimum.reduceat(f, heads)
        several = (low == 0) | (low != np.maximum.reduceat(f, heads))
        verdict = (several.astype(np.uint8) + (several & (total > hot)).astype(np.uint8))[np.cumsum(new) - 1]
        back = np.empty(len(key), np.uint8)
        back[order] = verdict
        edges = np.cumsum([len(x) for x in a])[:-1]
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "v": pa.array([x.tobytes() for x in np.split(back, edges)], pa.binary())})

    return counts.filter("kind = 0").drop("kind").groupBy("part").applyInArrow(run, "batch long, part int, v binary")


def mark_units(counts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """row, n, marks: one byte for each unit of the documents that have a repeated anchor."""

    def run(own: pa.Table, said: pa.Table) -> pa.Table:
        rows: list[int] = []
        marks: list[bytes] = []
        if own.num_rows and said.num_rows:
            said = said.sort_by("part")
            v = np.frombuffer(b"".join(said.column("v").to_pylist()), np.uint8)
            row, per_doc, place = (np.frombuffer(own.column(c)[0].as_py(), t) for c, t in (("a", np.int64), ("b", np.int32), ("c", np.int32)))
            unit = v[place]
            ends = np.cumsum(per_doc)
            hits = np.r_[0, np.cumsum(unit > 0)]
            for i in np.flatnonzero(hits[ends] > hits[ends - per_doc]):
                rows.append(int(row[i]))
                marks.append(unit[ends[i] - per_doc[i] : ends[i]].tobytes())
        n = [sum(map(bool, m)) for m in marks]
        return pa.table({"row": pa.array(rows, pa.int64()), "n": pa.array(n, pa.int64()), "marks": pa.array(marks, pa.binary())})

    own = counts.filter("kind = 1").select("batch", "a", "b", "c")
    return own.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(run, "row long, n long, marks binary")


def cut_units(marked: DataFrame, parts: int) -> DataFrame:
    """For each batch: distinct units by part (kind 0: starts, least doc_id, bytes) and every occurrence (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(_slices(batches)):
            ids, row, texts = _rows(batch)
            marks = [np.frombuffer(m, np.uint8) for m in batch.column("marks").to_pylist()]
            found: list[tuple] = []
            pieces: list[np.ndarray] = []
            for block in blocks(texts, 1 << 19):
                start, count, anchor, text, sums = units_of(block)
                if not len(start):
                    continue
                mark = np.concatenate(marks[block.lo : block.hi])
                keep, hot = mark == 1, mark == 2
                s, c, t, key = start[keep], count[keep], text[keep], anchor[keep] >> U(40)
                if hot.any():  # strings one by one
                    many = count[hot]
                    each = np.repeat(start[hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    s, c = np.r_[s, each], np.r_[c, np.ones(len(each), np.int64)]
                    t = np.r_[t, np.repeat(text[hot], many)]
                    key = np.r_[key, range_hash(sums, each, each + SPAN) >> U(40)]
                    order = np.lexsort((s, t))
                    s, c, t, key = s[order], c[order], t[order], key[order]
                name = range_hash(sums, s, s + c + SPAN - 1) ^ (c.astype(U) << U(58))
                found.append((s - block.starts[t], c, t + block.lo, (key % U(parts)).astype(np.int64), name, s))
                pieces.append(block.data)
            if not found:
                continue
            pos, c, doc, part, name = (np.concatenate([f[i] for f in found]) for i in range(5))
            offset = np.cumsum([0, *[len(p) for p in pieces[:-1]]])
            src = np.concatenate([f[5] + o for f, o in zip(found, offset)])
            data = np.concatenate(pieces)
            order = np.lexsort((ids[doc], name, part))
            p, q = part[order], name[order]
            new = np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
            place = np.empty(len(pos), np.int32)
            place[order] = np.cumsum(new) - 1
            lead = order[new]  # the occurrence with the least doc_id
            least, size = ids[doc[lead]], c[lead] + SPAN - 1
            flat = np.repeat(src[lead] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            text_bytes, ends = data[flat], np.cumsum(size)
            p = p[new]
            cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            out = [
                _exchange_row(0, _batch_id(k), int(p[i]), c[lead][i:j].astype(np.uint8), least[i:j], text_bytes[ends[i] - size[i] : ends[j - 1]])
                for i, j in zip(cut, np.r_[cut[1:], len(p)])
            ]
            seen = np.column_stack([doc, pos, c, place]).astype(np.int32)
            out.append(_exchange_row(1, _batch_id(k), -1, row.astype(np.int64), ids, seen, least))
            yield from _emit(out)

    return marked.mapInArrow(run, _EXCHANGE)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number."""
    out = np.zeros(len(data), U)
    padded = np.r_[data, np.full(8, 255, np.uint8)]
    for i in range(8):
        out = (out << U(8)) | padded[i : i + len(data)].astype(U)
    return out


def _names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key among the distinct ones, and an order of the keys."""
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]])
    return out, order


def shard_transform(data: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order to 50 bytes and the Burrows-Wheeler transform of one shard (cyclic).

    Its symbols are pairs of bytes: the two before each suffix.
    """
    n = len(data)
    name, order = _names(words)
    for step in (8, 16, SPAN - 32):  # prefixes of 16, 32 and 50 bytes
        shifted = np.zeros(n, np.int64)
        shifted[: n - step] = name[step:] + 1 if n > step else 0
        name, order = _names(name * (n + 2) + shifted)
    return order, (data[order - 2].astype(np.uint16) << np.uint16(8)) | data[order - 1]


def merge_transforms(transforms: list[np.ndarray], rounds: int = SPAN // 2) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes: the shard of every rank, and the number of its interval.

    Round k partitions the merged transform stably by symbol, which puts the
    suffixes that begin two bytes earlier in order of 2 k bytes. Suffixes in
    one interval have these bytes in common: they begin with one symbol, and
    the suffixes behind it were in one interval before.
    """
    z = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    interval = np.zeros(len(z), np.int64)
    symbols = np.empty(len(z), np.uint16)
    settled = False
    for _ in range(rounds):
        if not settled:
            for s, t in enumerate(transforms):
                symbols[z == s] = t
            order = np.argsort(symbols, kind="stable")
            new = z[order]
            # An interleave that a round leaves as it is stays so; only the intervals go on to split.
            settled = np.array_equal(new, z)
            z, ahead = new, symbols[order]
            edge = ahead[1:] != ahead[:-1]
        behind = interval[order]
        was = int(interval[-1]) if len(interval) else 0
        interval = np.r_[0, np.cumsum(edge | (behind[1:] != behind[:-1]))] if len(z) else interval
        if settled and len(z) and int(interval[-1]) == was:
            break
    return z, interval


def shared_units(data: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which units hold a string that another start holds too, by hash; equal strings have equal hashes."""
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(TABLE[data] * powers(len(data))[0], out=sums[1:])
    h = (sums[flat + SPAN] - sums[flat]) * powers(len(data) + 1)[1][flat]
    order = np.argsort(h)
    twin = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(flat), bool)
    shared[order[1:][twin]] = True
    shared[order[:-1][twin]] = True
    return np.logical_or.reduceat(shared, np.cumsum(starts) - starts)


def least_ids(strings: list[np.ndarray], starts: np.ndarray, ids: np.ndarray, shards: int = 2) -> np.ndarray:
    """For every start of every unit: the least id of a unit that has the same 50 bytes there or elsewhere.

    ``strings`` are the bytes of the units, ``starts`` how many strings begin
    in each. Units are parted by a byte that UTF-8 never uses.
    """
    pieces, begin, at = [], np.zeros(len(strings), np.int64), 0
    gap = np.full(1, 255, np.uint8)
    for i, s in enumerate(strings):
        begin[i] = at
        pieces += [s, gap]
        at += len(s) + 1
    data = np.concatenate([*pieces, np.full(SPAN, 255, np.uint8)])
    # Shards end with a unit; the last one takes the padding.
    edge = [begin[len(strings) * s // shards] if s else 0 for s in range(shards)] + [len(data)]
    orders, transforms = [], []
    for a, b in zip(edge, edge[1:]):
        if b > a:
            order, bwt = shard_transform(data[a:b], _words(data[a:b]))
            orders.append(order + a)
            transforms.append(bwt)
    z, interval = merge_transforms(transforms)
    merged = np.empty(len(data), np.int64)
    for s, order in enumerate(orders):
        merged[z == s] = order
    owner = np.full(len(data), -1, np.int64)
    flat = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    owner[flat] = np.repeat(np.arange(len(strings)), starts)
    # Intervals of the last round hold the suffixes that share all 50 bytes.
    starts_here = owner[merged] >= 0
    ranked, group = merged[starts_here], interval[starts_here]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(ids[owner[ranked]], first)
    out = np.empty(len(data), np.int64)
    out[ranked] = np.repeat(least, np.diff(np.r_[first, len(ranked)]))
    return out[flat]


def judge_units(cuts: DataFrame, shards: int) -> DataFrame:
    """For each batch and part, 32 bits for each unit: set where a smaller doc_id has the string."""

    def run(table: pa.Table) -> pa.Table:
        sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table.column("a").to_pylist()]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("b").to_pylist()])
        data = b"".join(table.column("c").to_pylist())
        starts = np.concatenate(sizes)
        ends = np.cumsum(starts + SPAN - 1)
        whole = [data[e - s - SPAN + 1 : e] for s, e in zip(starts.tolist(), ends.tolist())]
        number: dict[bytes, int] = {}
        place = np.array([number.setdefault(x, len(number)) for x in whole])  # equal units of other batches
        first = np.full(len(number), NO_ID)
        np.minimum.at(first, place, ids)
        count = np.array([len(x) - SPAN + 1 for x in number])
        at = np.cumsum(count) - count
        least = np.repeat(first, count)
        strings = [np.frombuffer(x, np.uint8) for x in number]
        flat = np.arange(len(least)) + np.repeat((np.arange(len(count)) * (SPAN - 1)), count)
        keep = np.flatnonzero(shared_units(np.concatenate(strings), flat, count))
        if len(keep):
            own = np.repeat(at[keep] - (np.cumsum(count[keep]) - count[keep]), count[keep]) + np.arange(count[keep].sum())
            least[own] = least_ids([strings[i] for i in keep], count[keep], first[keep], shards)
        bits = np.zeros(len(whole), np.uint32)
        for i in range(int(starts.max())):
            has = np.flatnonzero(starts > i)
            bits[has] |= (least[at[place[has]] + i] < ids[has]).astype(np.uint32) << np.uint32(i)
        edges = np.cumsum([len(s) for s in sizes])[:-1]
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "v": pa.array([x.tobytes() for x in np.split(bits, edges)], pa.binary())})

    return cuts.filter("kind = 0").drop("kind", "d").groupBy("part").applyInArrow(run, "batch long, part int, v binary")


def removed_ranges(cuts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """row, ranges (pairs of 32-bit begin and end): the bytes each document loses."""

    def run(own: pa.Table, said: pa.Table) -> pa.Table:
        rows: list[int] = []
        ranges: list[bytes] = []
        if own.num_rows and said.num_rows:
            bits = np.frombuffer(b"".join(said.sort_by("part").column("v").to_pylist()), np.uint32)
            row, ids, least = (np.frombuffer(own.column(c)[0].as_py(), np.int64) for c in "abd")
            doc, pos, count, place = np.frombuffer(own.column("c")[0].as_py(), np.int32).reshape(-1, 4).T
            lost = np.where(ids[doc] > least[place], np.uint32(0xFFFFFFFF), bits[place])
            i = np.arange(WINDOW, dtype=np.uint32)
            u, j = np.nonzero(((lost[:, None] >> i) & np.uint32(1)).astype(bool) & (i < count[:, None]))
            d, s = doc[u].astype(np.int64), pos[u].astype(np.int64) + j
            if len(s):
                new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + SPAN)])
                a, b, d = s[new], s[np.r_[new[1:], len(s)] - 1] + SPAN, d[new]
                first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                for x, y in zip(first, np.r_[first[1:], len(d)]):
                    rows.append(int(row[d[x]]))
                    ranges.append(np.column_stack([a[x:y], b[x:y]]).astype(np.int64).tobytes())
        return pa.table({"row": pa.array(rows, pa.int64()), "ranges": pa.array(ranges, pa.binary())})

    own = cuts.filter("kind = 1").select("batch", "a", "b", "c", "d")
    return own.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(run, "row long, ranges binary")


def drop_repeats(
    docs: DataFrame, anchors_per_part: int = 1_000_000, bytes_per_part: int = 1_500_000, hot: int = 20_000, shards: int = 2
) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans for every row.

    Texts are judged as UTF-8 bytes on the input, not on what is left; matches
    never cross documents; a null text is empty. Rows with equal doc_id do not
    remove from each other; a null doc_id counts as larger than any other.
    Other columns are ignored; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "repeats")
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(doc_id.alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"), *key128(F.col("text"), "k"))
    narrow = ws.put(rows.select("doc_id", "row", "k1", "k2", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")))
    size = narrow.agg(F.sum("n")).first()[0] or 0
    parts = max(8, -(-int(size) // (16 * anchors_per_part)))
    counts = ws.put(count_anchors(rows.drop("k2"), parts))
    marks = ws.put(mark_units(counts, judge_anchors(counts, hot)).dropDuplicates(["row"]))
    ws.drop(counts)
    held = marks.agg(F.sum("n")).first()[0] or 0
    parts = max(8, -(-int(held) * 68 // bytes_per_part))
    marked = rows.drop("k1", "k2").hint("merge").join(marks.select("row", "marks"), "row")
    cuts = ws.put(cut_units(marked, parts))
    ws.drop(marks)
    # Copies of a document with a smaller doc_id go as a whole.
    first = narrow.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    copies = narrow.filter(F.col("n") >= SPAN).join(first, ["k1", "k2"]).filter("doc_id > first").select("row", F.lit(True).alias("whole"))
    found = removed_ranges(cuts, judge_units(cuts, shards)).withColumn("whole", F.lit(False))
    gone = found.unionByName(copies, allowMissingColumns=True).groupBy("row").agg(F.max("ranges").alias("ranges"), F.max("whole").alias("whole"))
    gone = ws.put(gone)
    ws.drop(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            kept, n, gone, spans = [], [], [], []
            for text, packed, whole in zip(as_bytes(b.column("text")), b.column("ranges").to_pylist(), b.column("whole").to_pylist()):
                pairs = [(0, len(text))] if whole else np.frombuffer(packed, np.int64).reshape(-1, 2).tolist() if packed else []
                parts_, at = [], 0
                for x, y in pairs:
                    parts_.append(text[at:x])
                    at = y
                kept.append(b"".join([*parts_, text[at:]]))
                n.append(len(text))
                gone.append(len(text) - len(kept[-1]))
                spans.append(len(pairs))
            yield pa.record_batch(
                {"doc_id": b.column("doc_id"), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
            )

    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    both = texts.hint("merge").join(gone, "row", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ranges", "whole")
    return both.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
