"""Exact n-gram Jaccard self-join with vertical partitioning, and its components.

A document's set holds its distinct 5-word shingles (words split at white
space, A-Z lower-cased; fewer words give one shingle of the whole sequence).
Two documents link when their Jaccard similarity is at least 0.8.

1. One scan turns texts into shingle keys. Equal sets within a piece of input
   fold into their smallest document at once. Keys travel as packed arrays to
   the bucket of their range.
2. Per bucket, the number of different sets that hold a key is its frequency.
   The global order is (frequency, key): rare first. Keys of a single set can
   match nothing and stay behind.
3. Per document, the repeated keys return. Linked sets share a key among the
   first ``n - ceil(0.8 n) + 1`` of the order; a document whose prefix holds
   only keys of its own drops out.
4. In the group of a prefix key, every member is paired with one centre (the
   member with the largest share of repeated keys): group size minus one
   pairs. Overlaps of pairs are counted apart in each vertical fragment of
   the global order and summed per pair. Verified links form components.
5. Pairs of a group that are then in different components, pass the bounds by
   size, repeated keys, position and overlap with their centre, and were not
   counted yet are counted the same way. Pairs within a component are never expanded. So the components
   are those of all links, without listing the pairs of a group.

Keys keep 44 bits of a 64-bit shingle hash and are compared only between
candidate pairs.

Defined results: NULL or empty text has an empty set, linked with nothing;
rows with a NULL doc_id name no document and are left out; rows that repeat a
doc_id are one document (one result row, the largest set size); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textops
from lectern.llm.common import shuffle_partitions, stored
from lectern.llm.components import components
from lectern.llm.packing import bucket_of, concat, pack, unpack

K = 5
PIECE_KEYS = 1_500_000            # shingles of a piece that fold and pack together
KEY_SHIFT = np.uint64(20)

TOKENS = ("bucket int, kind string, keys binary, idx binary, ids binary, fps binary, ns binary")
RETURNED = "home int, kind string, ids binary, ns binary, keys binary, freqs binary, links binary"
ENTRIES = "kind string, doc bigint, n int, rep bigint, e int, key bigint, rank int, fragment int, keys array<bigint>"


def _tokens_row(bucket, kind, keys=b"", idx=b"", ids=b"", fps=b"", ns=b""):
    return (bucket, kind, keys, idx, ids, fps, ns)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


_TOKENS_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.string())] + [
    (c, pa.binary()) for c in ("keys", "idx", "ids", "fps", "ns")])
_RETURNED_ARROW = pa.schema([("home", pa.int32()), ("kind", pa.string())] + [
    (c, pa.binary()) for c in ("ids", "ns", "keys", "freqs", "links")])
_ENTRIES_ARROW = pa.schema([("kind", pa.string()), ("doc", pa.int64()), ("n", pa.int32()), ("rep", pa.int64()),
                            ("e", pa.int32()), ("key", pa.int64()), ("rank", pa.int32()), ("fragment", pa.int32()),
                            ("keys", pa.list_(pa.int64()))])
#: Cuts of the global order (frequency, key) into vertical fragments.
CUTS = np.array([3, 4, 6, 9, 15, 30, 100, 1000])


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    return bucket_of(textops.mix(ids.astype(np.uint64)), homes)


def _fold(doc: np.ndarray, sh: np.ndarray, row: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of one piece: documents ``doc``, shingles ``sh`` of rows ``row`` (ascending)."""
    order = np.argsort(sh, kind="stable")
    s, r = sh[order], row[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[fresh], r[fresh]
    n = np.bincount(r, minlength=len(doc)).astype(np.int32)
    f1, f2 = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
    np.add.at(f1, r, textops.mix(s ^ np.uint64(0xA5A5A5A5)))
    np.add.at(f2, r, textops.mix(s + np.uint64(0x5BD1E995)))
    fp = textops.mix(f1 ^ textops.mix(f2 + n.astype(np.uint64)))
    by = np.lexsort((doc, fp))
    first = np.ones(len(by), bool)
    first[1:] = fp[by][1:] != fp[by][:-1]
    lead = np.empty(len(by), np.int64)
    lead[by] = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    full = n > 0
    own = full & (lead == np.arange(len(doc)))
    # documents: leaders meet at the bucket of their set, folded copies and empty sets are settled
    where = bucket_of(fp, buckets)
    for b in np.unique(where[own]):
        m = own & (where == b)
        yield _tokens_row(int(b), "doc", ids=pack(doc[m]), fps=pack(fp[m]), ns=pack(n[m]))
    rest = ~own
    if rest.any():
        link = np.where(full, doc[lead], doc)
        yield _tokens_row(int(where[0]), "settled", ids=pack(doc[rest]), keys=pack(link[rest]), ns=pack(n[rest]))
    keep = own[r]
    s, r = s[keep], r[keep]
    edge = np.searchsorted(bucket_of(s, buckets), np.arange(buckets + 1))
    seen = np.empty(len(doc), np.int64)
    for b in np.flatnonzero(np.diff(edge)):
        lo, hi = edge[b], edge[b + 1]
        present = np.zeros(len(doc), bool)
        present[r[lo:hi]] = True
        docs = np.flatnonzero(present)
        seen[docs] = np.arange(len(docs))
        idx = seen[r[lo:hi]]
        yield _tokens_row(int(b), "keys", pack(s[lo:hi] >> KEY_SHIFT, delta=True),
                          pack(idx.astype(np.uint16 if len(docs) < 65536 else np.uint32)),
                          pack(doc[docs]), pack(fp[docs]), pack(n[docs]))


def _scan(buckets: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, shs, rows, base, held = [], [], [], 0, 0

        def flush():
            rows_out = _fold(np.concatenate(docs), concat(shs, np.uint64), concat(rows, np.int64), buckets)
            chunk = []
            for x in rows_out:
                chunk.append(x)
                if len(chunk) >= 64:
                    yield _batch(chunk, _TOKENS_ARROW)
                    chunk = []
            if chunk:
                yield _batch(chunk, _TOKENS_ARROW)
        for batch in batches:
            for part in textops.pieces(batch, 1):
                w = textops.words_of(*textops.text_bytes(part.column(1)))
                sh, row, _ = textops.shingles_of(textops.word_hashes(w), w.first, K)
                docs.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                shs.append(sh)
                rows.append(row + base)
                base += part.num_rows
                held += len(sh)
                if held >= PIECE_KEYS:
                    yield from flush()
                    docs, shs, rows, base, held = [], [], [], 0, 0
        if docs:
            yield from flush()
    return scan


def _count(homes: int):
    """Per bucket of keys: frequencies; per bucket of sets: the smallest document of each."""
    def count(table: pa.Table) -> pa.Table:
        out, key, fp, doc, n = [], [], [], [], []
        d_id, d_fp, d_n = [], [], []

        def send(kind, ids, ns, keys=None, freqs=None, links=None):
            h = _home(ids, homes)
            by = np.argsort(h, kind="stable")
            edge = np.searchsorted(h[by], np.arange(homes + 1))
            for b in np.flatnonzero(np.diff(edge)):
                m = by[edge[b]:edge[b + 1]]
                out.append((int(b), kind, pack(ids[m]), pack(ns[m]), *(b"" if a is None else pack(a[m]) for a in (keys, freqs, links))))
        for row in table.to_pylist():
            if row["kind"] == "settled":
                send("copy", unpack(row["ids"]), unpack(row["ns"]), links=unpack(row["keys"]))
            elif row["kind"] == "doc":
                d_id.append(unpack(row["ids"]))
                d_fp.append(unpack(row["fps"]))
                d_n.append(unpack(row["ns"]))
            else:
                i = unpack(row["idx"]).astype(np.int64)
                key.append(unpack(row["keys"]))
                doc.append(unpack(row["ids"])[i])
                fp.append(unpack(row["fps"])[i])
                n.append(unpack(row["ns"])[i])
        if d_id:
            i, f, m = np.concatenate(d_id), np.concatenate(d_fp), np.concatenate(d_n)
            by = np.lexsort((i, f))
            i, f, m = i[by], f[by], m[by]
            first = np.ones(len(i), bool)
            first[1:] = f[1:] != f[:-1]
            rep = i[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))]
            send("doc", i, m, links=rep)
        if key:
            k = np.concatenate(key)
            by = np.argsort(k, kind="stable")
            same = k[by][1:] == k[by][:-1]
            many = np.zeros(len(k), bool)
            many[by[1:]] |= same
            many[by[:-1]] |= same
            at = np.flatnonzero(many)
            k, f, i, m = k[at], np.concatenate(fp)[at], np.concatenate(doc)[at], np.concatenate(n)[at]
            by = np.lexsort((i, f, k))
            k, f, i, m = k[by], f[by], i[by], m[by]
            one = np.ones(len(k), bool)              # the smallest document of each (key, set)
            one[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
            k, i, m = k[one], i[one], m[one]
            _, inverse, freq = np.unique(k, return_inverse=True, return_counts=True)
            freq = freq[inverse].astype(np.int32)
            rep = freq > 1
            if rep.any():
                send("keys", i[rep], m[rep], k[rep], freq[rep])
        return pa.Table.from_batches([_batch(out, _RETURNED_ARROW)] if out else [], _RETURNED_ARROW)
    return count


def _entry_rows(kind: str, size: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size)] + [cols[f.name] if f.name in cols else pa.nulls(size, f.type) for f in list(_ENTRIES_ARROW)[1:]],
        schema=_ENTRIES_ARROW)


def _order(table: pa.Table) -> pa.Table:
    """Per home of documents: prefix keys and vertical fragments of documents with a candidate prefix."""
    parts = {"keys": [], "doc": [], "copy": []}
    for row in table.to_pylist():
        parts[row["kind"]].append(row)
    out = []
    for kind in ("doc", "copy"):
        for row in parts[kind]:
            ids = unpack(row["ids"])
            out.append(_entry_rows(kind, len(ids), doc=pa.array(ids), n=pa.array(unpack(row["ns"])),
                                   rep=pa.array(unpack(row["links"]))))
    if parts["keys"]:
        i, n, k, f = (np.concatenate([unpack(r[c]) for r in parts["keys"]]) for c in ("ids", "ns", "keys", "freqs"))
        by = np.lexsort((k, f, i))
        i, n, k, f = i[by], n[by], k[by].astype(np.int64), f[by]
        _, start, e = np.unique(i, return_index=True, return_counts=True)
        rank = (np.arange(len(i)) - np.repeat(start, e)).astype(np.int32)
        e = np.repeat(e, e).astype(np.int32)
        alpha = (4 * n + 4) // 5
        m = e >= alpha                               # otherwise the prefix holds only keys of its own
        p = m & (rank < e - alpha + 1)
        if p.any():
            out.append(_entry_rows("prefix", int(p.sum()), doc=pa.array(i[p]), n=pa.array(n[p]), e=pa.array(e[p]),
                                   key=pa.array(k[p]), rank=pa.array(rank[p])))
            i, n, e, k, f = i[m], n[m], e[m], k[m], f[m]
            cut = np.searchsorted(CUTS, f, side="right").astype(np.int32)
            first = np.flatnonzero((np.diff(i, prepend=i[0] - 1) != 0) | (np.diff(cut, prepend=-1) != 0))
            keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(k)).astype(np.int32)), pa.array(k))
            out.append(_entry_rows("part", len(first), doc=pa.array(i[first]), fragment=pa.array(cut[first]), keys=keys))
    return pa.Table.from_batches(out, _ENTRIES_ARROW)


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table of documents (``doc``, ``copy``), their ``prefix`` keys and vertical fragments (``part``)."""
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    tokens = rows.where(F.col("doc_id").isNotNull()).mapInArrow(_scan(2 * parts), TOKENS)
    counted = tokens.groupBy("bucket").applyInArrow(_count(2 * parts), RETURNED)
    return stored(counted.groupBy("home").applyInArrow(_order, ENTRIES), "ngram-entries")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``a, b, overlap`` of candidate pairs, counted per vertical fragment and summed per pair."""
    left = pairs.select("a", "b").join(parts.select(F.col("doc").alias("a"), "fragment", F.col("keys").alias("ka")), "a")
    both = left.join(parts.select(F.col("doc").alias("b"), "fragment", F.col("keys").alias("kb")), ["b", "fragment"])
    partial = both.select("a", "b", F.size(F.array_intersect("ka", "kb")).alias("part"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("overlap"))


def _similar(counted: DataFrame) -> DataFrame:
    """Links among ``counted(a, b, na, nb, overlap)``: 100 * intersection >= 80 * union."""
    o = F.col("overlap")
    return counted.where(100 * o >= 80 * (F.col("na") + F.col("nb") - o)).select("a", "b")


def links(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified links ``a, b`` that span all components, components ``id, component`` of linked sets)."""
    parts = table.where("kind = 'part'").select("doc", "fragment", "keys")
    prefix = table.where("kind = 'prefix'").select("doc", "n", "e", "key", "rank")
    centre = prefix.groupBy("key").agg(
        F.max(F.struct((F.col("e") / F.col("n")).alias("share"), (-F.col("doc")).alias("minus"), "n")).alias("c"),
        F.count(F.lit(1)).alias("members")).where("members > 1").select(
        "key", (-F.col("c.minus")).alias("c"), F.col("c.n").alias("nc"))
    grouped = stored(prefix.join(centre, "key"), "ngram-groups")
    star = grouped.where((F.col("doc") != F.col("c")) & (5 * F.least("n", "nc") >= 4 * F.greatest("n", "nc"))).select(
        F.col("c").alias("a"), F.col("doc").alias("b"), F.col("nc").alias("na"), F.col("n").alias("nb"))
    star = stored(star.distinct(), "ngram-pairs")
    star = stored(star.join(overlaps(star, parts), ["a", "b"], "left").fillna(0, ["overlap"]), "ngram-counted")
    found = stored(_similar(star), "ngram-links")
    comps = components(found)

    # what is left: pairs of a group in different components
    placed = grouped.join(comps.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn(
        "comp", F.coalesce("component", "doc"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    placed = placed.join(mixed, "key", "left_semi").join(
        star.select(F.col("a").alias("c"), F.col("b").alias("doc"), F.col("overlap").alias("o")), ["c", "doc"], "left")
    lists = prefix.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("rank", "key")))["key"].alias("ks"))
    placed = stored(placed.join(lists, "doc").select("key", "doc", "n", "e", "rank", "comp", "o", "ks"), "ngram-mixed")
    x, y = placed.alias("x"), placed.alias("y")
    need = F.ceil(4 * (F.col("x.n") + F.col("y.n")) / 9)
    # common keys lie in the centre, which both were counted with, or among the repeated keys outside it
    by_centre = F.least("x.o", "y.o") + F.least(F.col("x.e") - F.col("x.o"), F.col("y.e") - F.col("y.o"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc") < F.col("y.doc"))
                  & (F.col("x.comp") != F.col("y.comp"))
                  & (5 * F.least("x.n", "y.n") >= 4 * F.greatest("x.n", "y.n"))
                  # met at their first common key: all others come after it
                  & (F.least(F.col("x.e") - F.col("x.rank"), F.col("y.e") - F.col("y.rank")) >= need)
                  & F.when(F.col("x.o").isNull() | F.col("y.o").isNull(), F.lit(True)).otherwise(by_centre >= need)
                  & (F.element_at(F.array_intersect("x.ks", "y.ks"), 1) == F.col("x.key"))
                  ).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"),
                           F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    seen = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(seen, ["a", "b"], "left_anti"), "ngram-pairs")
    if rest.isEmpty():
        return found, comps
    more = _similar(rest.join(overlaps(rest, parts), ["a", "b"]))
    found = stored(found.unionByName(more), "ngram-links")
    return found, components(found)


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document."""
    table = entries(docs, id_col, text_col)
    _, comps = links(table)
    own = table.where("kind = 'doc'").select("doc", "n", "rep").dropDuplicates(["doc"])
    leaders = own.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "doc", "n", F.coalesce("component", "rep").alias("component_id"))
    folded = table.where("kind = 'copy'").select("doc", "n", "rep")
    copies = folded.join(leaders.select(F.col("doc").alias("rep"), "component_id"), "rep", "left").select(
        "doc", "n", F.coalesce("component_id", "rep").alias("component_id"))
    return leaders.unionByName(copies).groupBy(F.col("doc").alias("doc_id")).agg(
        F.max(F.col("n").cast("bigint")).alias("n_shingles"), F.min("component_id").alias("component_id"))
