"""Windows that repeat across a corpus, found from content-chosen anchors.

A window is `size` neighbouring symbols of one document; a symbol is a word or a byte. Each window is governed by one
*anchor*: the start of the least of the rolling hashes of its `gram` symbols, leftmost first. Equal windows have equal
anchors at the same place, and neighbouring windows mostly share theirs, so the windows of a document fall into few
maximal runs, called *phrases*: all windows governed by one anchor, with the text they cover. Five steps follow.

1. ``phrases``: each task gives its documents' phrases, equal ones but once (the others are settled there).
2. ``dictionary``: phrases meet by the prefix of `gram` symbols at their anchor, in the order of prefix, phrase and
   place. Equal phrases become one; a prefix with different phrases asks for the text of each. Beyond that, a prefix with
   one phrase has no two equal windows, as an anchor lies at different places of the windows that it governs.
3. ``texts_asked``: the documents give the texts of those phrases. Prefixes with more than `hot` phrases lengthen: their
   phrases are cut to single windows, dealt out by the first half, three quarters or all of their own symbols, whichever
   first holds no more than `crowd` windows.
4. a method's own structure (suffix trees or the dictionary's suffix array) says of each window whether it repeats.
5. ``by_document``: each document meets its removed ranges.

All steps but the third take rows in the order of their groups and hold a bounded slice of them; a group that is larger
consists of equal phrases or windows, of which it is enough to keep the first beside the others. Equal phrases are told
by two 64-bit hashes (of prefix and text); windows by their symbols.

Order counts if `first` is set: then a window goes only if an equal one starts at a smaller (doc, position).
Positions hold the part of a doc_id above bit 32, so that (doc, position) orders windows as (doc, part, start).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Rolling, chunks, flat, lean, mix, signed, sliding_min, spread, squeeze, unsqueeze, word_hash, words, written

PART = 32
AT = (1 << PART) - 1
U = np.uint64


@dataclass(frozen=True)
class Windows:
    """What repeats: windows of `size` symbols, anchored by `gram` symbols; `unit` is word or byte."""

    unit: str
    size: int
    gram: int
    first: bool
    #: Phrases of one prefix above which they are cut to single windows; windows of one longer prefix above which it lengthens.
    hot: int = 2000
    crowd: int = 4000
    chunk: int = CHUNK_BYTES
    #: Rows of phrases, and of texts, that are held at once.
    rows: int = 200_000
    texts: int = 5000

    def prefixes(self) -> tuple[int, int]:
        """The lengths between `gram` and `size` to which prefixes lengthen."""
        return max(1, self.size // 2), max(1, self.size * 3 // 4)


# Fixed random 64-bit numbers for the 256 byte values, from their rule.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))

PHRASE = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("d", pa.int32())])
PHRASE_DDL = "key long, fp long, doc long, pos long, n int, d int"
#: d of rows that say: the n windows from pos go.
GONE = -1
ASKED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("d", pa.int32())])
ASKED_DDL = "kind int, key long, doc long, pos long, n int, d int"
TEXT = pa.schema([("g", pa.int64()), ("g2", pa.int64()), ("g1", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("d", pa.int32()), ("text", pa.binary())])
TEXT_DDL = "g long, g2 long, g1 long, key long, doc long, pos long, n int, d int, text binary"
RANGE = pa.schema([("doc", pa.int64()), ("pos", pa.int64()), ("n", pa.int32())])
RANGE_DDL = "doc long, pos long, n int"


def symbols(w: Windows, buf: np.ndarray, off: np.ndarray):
    """Symbols of all rows, the rows' offsets among them, and (words only) where each starts and ends in buf."""
    if w.unit == "byte":
        return BYTE[buf], off, None, None
    s, e, at = words(buf, off)
    return word_hash(buf, s, e), at, s, e


def starts(at: np.ndarray, size: int) -> np.ndarray:
    """Where the windows of all rows start."""
    n = np.maximum(np.diff(at) - size + 1, 0)
    total = int(n.sum())
    return np.repeat(at[:-1] - (np.cumsum(n) - n), n) + np.arange(total)


def split_phrases(w: Windows, roll: Rolling, at: np.ndarray):
    """First window, number of windows, anchor, and anchor hash of each phrase."""
    i = starts(at, w.size)
    if not len(i):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    g = roll.all(w.gram)
    low = U((1 << len(g).bit_length()) - 1)
    least = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), w.size - w.gram + 1)
    a = (least & low).astype(np.int64)[i]
    new = np.ones(len(i), bool)
    new[1:] = (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1)
    lead = np.flatnonzero(new)
    return i[lead], np.diff(np.append(lead, len(i))), a[lead], g[a[lead]]


def differs(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    return new


def joined_ranges(doc: np.ndarray, pos: np.ndarray, n: np.ndarray, size: int):
    """Ranges of windows made one where the symbols they cover touch."""
    if not len(doc):
        return doc, pos, n
    order = np.lexsort((pos, doc))
    doc, pos, n = doc[order], pos[order], n[order].astype(np.int64)
    part = np.ones(len(doc), bool)
    part[1:] = (doc[1:] != doc[:-1]) | (pos[1:] >> PART != pos[:-1] >> PART)
    lead = np.flatnonzero(part)
    lo = pos & AT
    room = np.maximum.reduceat(lo + n, lead) + size + 1  # documents laid end to end, so that one running maximum does
    base = (np.cumsum(room) - room)[np.cumsum(part) - 1]
    far = np.maximum.accumulate(base + lo + n + size - 1)
    new = part.copy()
    new[1:] |= base[1:] + lo[1:] > far[:-1]
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(doc)) - 1
    return doc[lead], pos[lead], far[last] - base[last] - lo[lead] - size + 1


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def places(w: Windows, order: np.ndarray, key, fp, doc, pos) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of (key, fp, doc, pos): where each phrase has its first, and the rows whose windows all go.

    One document's row may come twice; it is one place then.
    """
    lead = np.flatnonzero(differs(order, key, fp))
    other = differs(order, key, fp, doc, pos)
    first = np.zeros(len(order), bool)
    first[lead] = True
    if w.first:
        return lead, order[other & ~first]
    many = np.add.reduceat(other.astype(np.int64), lead) > 1 if len(lead) else lead.astype(bool)
    return lead, order[other & np.repeat(many, np.diff(np.append(lead, len(order))))]


def phrases(docs: DataFrame, w: Windows) -> DataFrame:
    """Rows of PHRASE for (doc, part, text) rows."""

    def settled(held):
        key, fp, doc, pos, n, d = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((pos, doc, fp, key))
        lead, gone = places(w, order, key, fp, doc, pos)
        keep = order[lead]
        yield _batch(PHRASE, signed(key[keep]), signed(fp[keep]), doc[keep], pos[keep], n[keep], d[keep])
        if len(gone):
            gd, gp, gn = joined_ranges(doc[gone], pos[gone], n[gone], w.size)
            yield _batch(PHRASE, signed(mix(gd.astype(U))), np.zeros(len(gd), np.int64), gd, gp, gn, np.full(len(gd), GONE))

    def run(batches):
        held = []
        for b in chunks(batches, most=w.chunk):
            buf, off = flat(b.column("text"))
            sym, at, _, _ = symbols(w, buf, off)
            roll = Rolling(sym)
            lo, n, a, key = split_phrases(w, roll, at)
            if not len(lo):
                continue
            row = np.searchsorted(at, lo, "right") - 1
            doc = b.column("doc").to_numpy()[row]
            pos = (b.column("part").to_numpy().astype(np.int64)[row] << PART) + lo - at[row]
            d = a - lo
            fp = mix(roll.of(lo, lo + n + w.size - 1) + mix(d.astype(U) * U(1 << 32) + n.astype(U)))
            held.append((key, fp, doc, pos, n.astype(np.int32), d.astype(np.int32)))
            if sum(len(x[0]) for x in held) >= w.rows:
                yield from settled(held)
                held = []
        if held:
            yield from settled(held)

    return docs.mapInArrow(lean(run), PHRASE_DDL)


def slices(batches, schema: pa.Schema, group: str, kind: str, most: int):
    """Sorted rows in tables of `most` rows at most, each with whether it holds a part of one group only.

    Groups stay whole up to that many rows. A larger one is parted between its kinds, and a larger kind anywhere, its first
    row going before the others once more.
    """

    def edge(column) -> int:
        """Where the last value begins among the first `most` rows and the one after; 0 if there is but one."""
        v = column[: most + 1].to_numpy()
        found = np.flatnonzero(v[1:] != v[:-1])
        return int(found[-1]) + 1 if len(found) else 0

    held, fresh, parted = schema.empty_table(), [], None
    for b in chain(batches, [None]):
        if b is not None:
            fresh.append(b)
            if held.num_rows + sum(x.num_rows for x in fresh) <= most:
                continue
        held = pa.concat_tables([held, pa.Table.from_batches(fresh, schema)]).combine_chunks()
        fresh = []
        while held.num_rows > (0 if b is None else most):
            v = held.column(group).to_numpy()
            own = int(np.argmax(v != v[0])) or len(v)
            parted = parted if v[0] == parted else None
            if parted is None and own <= most:
                at = len(v) if len(v) <= most else edge(held.column(group))
                yield held.slice(0, at), False
            elif own <= most:
                at = own
                yield held.slice(0, at), True
            else:
                parted = v[0]
                at = edge(held.column(kind)) or most
                yield held.slice(0, at), True
                if held.column(kind)[at - 1] == held.column(kind)[at]:
                    held = pa.concat_tables([held.slice(0, 1), held.slice(at)]).combine_chunks()
                    continue
            held = held.slice(at)


def columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(name).to_numpy() for name in names]


def dictionary(found: DataFrame, w: Windows) -> DataFrame:
    """Rows of ASKED: kind 0 are ranges of windows that go, kind 1 and 2 (of prefixes that must lengthen) are phrases whose text is asked for."""

    def run(batches):
        for t, part in slices(batches, PHRASE, "key", "fp", w.rows):
            key, fp, doc, pos, n, d = columns(t, *PHRASE.names)
            said = d == GONE
            if said.any():
                x = joined_ranges(doc[said], pos[said], n[said], w.size)
                yield _batch(ASKED, np.zeros(len(x[0])), np.zeros(len(x[0])), *x, np.zeros(len(x[0])))
                key, fp, doc, pos, n, d = (c[~said] for c in (key, fp, doc, pos, n, d))
            lead, gone = places(w, np.arange(len(key)), key, fp, doc, pos)
            if len(gone):
                x = joined_ranges(doc[gone], pos[gone], n[gone], w.size)
                yield _batch(ASKED, np.zeros(len(x[0])), np.zeros(len(x[0])), *x, np.zeros(len(x[0])))
            many = np.flatnonzero(differs(lead, key))
            many = np.diff(np.append(many, len(lead)))
            many = np.repeat(many, many)  # phrases of the prefix of each
            kind = np.full(len(lead), 2) if part else (many > 1) + (many > w.hot)
            ask = lead[kind > 0]
            if len(ask):
                yield _batch(ASKED, kind[kind > 0], key[ask], doc[ask], pos[ask], n[ask], d[ask])

    met = found.repartition(spread(found.sparkSession), "key").sortWithinPartitions("key", "fp", "doc", "pos")
    return met.mapInArrow(lean(run), ASKED_DDL)


def packed(docs: DataFrame) -> DataFrame:
    """(doc, part, copies, text) with compressed texts, for a shuffle."""

    def run(batches):
        for b in chunks(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("part"), b.column("copies"), pa.array(squeeze(texts), pa.binary())], ["doc", "part", "copies", "text"])

    return docs.mapInArrow(lean(run), "doc long, part int, copies int, text binary")


def beside(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents (kind -1) and rows (key, doc, pos, n, d, kind) in the same partitions, each document before its rows."""
    left = packed(docs).selectExpr("doc", "part", "-1 AS kind", "0L AS key", "0L AS pos", "copies AS n", "0 AS d", "text")
    right = rows.selectExpr("doc", f"CAST(shiftright(pos, {PART}) AS INT) AS part", "kind", "key", "pos", "n", "d", "CAST(NULL AS BINARY) AS text")
    both = left.unionByName(right).repartition(spread(docs.sparkSession), "doc", "part")
    return both.sortWithinPartitions("doc", "part", "kind")


#: Bytes of a word above which its digest stands for it; no UTF-8 text has the byte 255.
LONG = 64


def brief(word: bytes) -> bytes:
    return word if len(word) <= LONG else b"\xff" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def texts_asked(docs: DataFrame, asked: DataFrame, w: Windows) -> DataFrame:
    """Rows of TEXT for kinds 1 and 2 of `asked`; windows under hot anchors are settled within a batch first (n < 0 says: gone)."""

    def run(batches):
        last = None
        for b in batches:
            kind = b.column("kind").to_numpy()
            ask = np.flatnonzero(kind > 0)
            own = np.flatnonzero(kind < 0)
            upto = np.searchsorted(own, ask, "right") - 1
            have = b.column("text").take(pa.array(own)).to_pylist()
            if last is not None:
                have, upto = [last, *have], upto + 1
            if have:
                last = have[-1]
            if not len(ask):
                continue
            step = max(1, len(ask) // max(1, sum(map(len, have)) // (w.chunk // 4)))
            for i in range(0, len(ask), step):
                yield from cut(b, ask[i : i + step], upto[i : i + step], have)

    def cut(b, ask, upto, have):
        used, row = np.unique(upto, return_inverse=True)
        buf, off = flat(pa.array(unsqueeze([have[u] for u in used]), pa.binary()))
        if w.unit == "byte":
            at, s, e = off, None, None
        else:
            s, e, at = words(buf, off)
        key, doc, pos, n, d, kind = (b.column(c).to_numpy()[ask] for c in ("key", "doc", "pos", "n", "d", "kind"))
        lo = at[row] + (pos & AT)
        hot = kind == 2
        if hot.any():
            k = np.flatnonzero(hot)
            each = np.repeat(k, n[k])
            j = np.arange(len(each)) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
            more = (key[each], doc[each], pos[each] + j, np.ones(len(each), np.int32), (d[each] - j).astype(np.int32), lo[each] + j)
            key, doc, pos, n, d, lo = (np.concatenate((c[~hot], m)) for c, m in zip((key, doc, pos, n, d, lo), more, strict=True))
            roll = Rolling(BYTE[buf] if w.unit == "byte" else word_hash(buf, s, e))
            single = np.arange(len(key)) >= (~hot).sum()
            fp = np.where(single, roll.of(lo, lo + w.size), U(0))
            g = np.where(single, mix(fp + key.view(U)), key.view(U))
            g1, g2 = (np.where(single, mix(roll.of(lo, lo + length) + U(length)) | U(1), U(0)) for length in w.prefixes())
            order = np.lexsort((pos, doc, fp, d, key, ~single))
            order = order[single[order]]
            text, other = differs(order, key, d, fp), differs(order, key, d, fp, doc, pos)
            lead = np.flatnonzero(text)
            many = np.add.reduceat(other.astype(np.int64), lead) > 1
            gone = order[(~text & other) if w.first else (other & many[np.cumsum(text) - 1])]
            if len(gone):
                x = joined_ranges(doc[gone], pos[gone], n[gone], w.size)
                none = np.zeros(len(x[0]))
                yield _batch(TEXT, signed(mix(x[0].astype(U))), none, none, none, *x, np.full(len(x[0]), GONE), [None] * len(x[0]))
            keep = np.concatenate((np.flatnonzero(~single), order[lead]))
            g, g2, g1, key, doc, pos, n, d, lo = (c[keep] for c in (g, g2, g1, key, doc, pos, n, d, lo))
        else:
            g = key.view(U)
            g1 = g2 = np.zeros(len(key), U)
        hi = lo + n + w.size - 1
        x, y = (lo, hi) if w.unit == "byte" else (s[lo], e[hi - 1])
        raw = buf.tobytes()
        texts = [raw[p:q] for p, q in zip(x.tolist(), y.tolist())]
        if w.unit == "word":
            long = np.concatenate(([0], np.cumsum(e - s > LONG)))
            for k in np.flatnonzero(long[hi] > long[lo]).tolist():
                texts[k] = b" ".join(brief(raw[p:q]) for p, q in zip(s[lo[k] : hi[k]].tolist(), e[lo[k] : hi[k]].tolist()))
        yield _batch(TEXT, signed(g), signed(g2), signed(g1), key, doc, pos, n, d, pa.array(texts, pa.binary()))

    return beside(docs, asked.where("kind > 0")).mapInArrow(lean(run), TEXT_DDL)


def dealt(texts: DataFrame, w: Windows) -> DataFrame:
    """texts with g the hash of each single window's shortest prefix that no more than `crowd` windows share, or of all of it."""
    own = texts.where("g1 <> 0")
    for g in ("g1", "g2"):
        over = own.groupBy(g).count().where(f"count > {w.crowd}").select(g, F.lit(True).alias(f"over_{g}"))
        own = own.join(over, g, "left")
    g = F.when(F.col("over_g1").isNull(), F.col("g1")).when(F.col("over_g2").isNull(), F.col("g2")).otherwise(F.col("g"))
    return texts.where("g1 = 0").unionByName(own.withColumn("g", g).select(*texts.columns))


def phrase_windows(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of phrases whose symbols begin at `at`: its phrase, its place there, and its place among all symbols."""
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, j, at[row] + j


def removed(docs: DataFrame, w: Windows, compare) -> DataFrame:
    """(doc, pos, n): ranges of windows that go. compare(w, doc, pos, n, text) has a row for each phrase and tells of each
    window, named by its phrase and its place there, whether it goes."""
    asked = written(dictionary(phrases(docs, w), w))

    def run(batches):
        for t, _ in slices(batches, TEXT, "g", "key", w.texts):
            doc, pos, n, d = columns(t, "doc", "pos", "n", "d")
            said = d == GONE
            if said.any():
                yield _batch(RANGE, *joined_ranges(doc[said], pos[said], n[said], w.size))
            own = np.flatnonzero(~said)
            if len(own):
                text = t.column("text").take(pa.array(own)).combine_chunks()
                row, j, goes = compare(w, doc[own], pos[own], n[own].astype(np.int64), text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
                r = own[row[goes]]
                yield _batch(RANGE, *joined_ranges(doc[r], pos[r] + j[goes], np.ones(len(r), np.int64), w.size))

    texts = texts_asked(docs, asked, w)
    if asked.where("kind = 2").limit(1).count():
        texts = dealt(written(texts), w)
    met = texts.repartition(spread(docs.sparkSession), "g").sortWithinPartitions("g", "key", "doc", "pos")
    return asked.where("kind = 0").select("doc", "pos", "n").unionByName(met.mapInArrow(lean(run), RANGE_DDL))


def by_document(docs: DataFrame, gone: DataFrame, w: Windows, finish, schema: pa.Schema, ddl: str) -> DataFrame:
    """finish(doc, text, removed ranges of symbols) -> row of schema, for each row of docs, as often as it has copies."""
    schema, ddl = pa.schema([("__copies", pa.int32()), *schema]), f"__copies int, {ddl}"

    def rows(batches):
        now, blobs, ranges = None, [], []
        for b in batches:
            kind, doc, part, pos, n = (b.column(c).to_numpy() for c in ("kind", "doc", "part", "pos", "n"))
            text = b.column("text")
            edge = np.flatnonzero((doc[1:] != doc[:-1]) | (part[1:] != part[:-1])) + 1
            edge = np.concatenate(([0], edge, [len(doc)])) if len(doc) else np.zeros(1, np.int64)
            texts = np.concatenate(([0], np.cumsum(kind < 0)))[edge]
            for i, k, m in zip(edge[:-1].tolist(), edge[1:].tolist(), np.diff(texts).tolist(), strict=True):
                if (doc[i], part[i]) != now:
                    yield from ready(now, blobs, ranges)
                    now, blobs, ranges = (doc[i], part[i]), [], []
                blobs += zip(text.slice(i, m).to_pylist(), n[i : i + m].tolist(), strict=True)
                if k > i + m:
                    ranges.append((pos[i + m : k] & AT, n[i + m : k]))
        yield from ready(now, blobs, ranges)

    def ready(now, blobs, ranges):
        lo = np.concatenate([r[0] for r in ranges]) if ranges else np.zeros(0, np.int64)
        hi = lo
        if len(lo):
            hi = lo + np.concatenate([r[1] for r in ranges]) + w.size - 1
            order = np.argsort(lo)
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            new = np.append(True, lo[1:] > hi[:-1])
            lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:], len(hi)) - 1]
        for blob, copies in blobs:
            yield (copies, *finish(int(now[0]), unsqueeze([blob])[0], lo, hi))

    def run(batches):
        out = []
        for row in rows(batches):
            out.append(row)
            if len(out) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    side = gone.selectExpr("1 AS kind", "0L AS key", "doc", "pos", "n", "0 AS d")
    out = beside(docs, side).mapInArrow(lean(run), ddl)
    return out.withColumn("__copies", F.explode(F.sequence(F.lit(1), "__copies"))).drop("__copies")
